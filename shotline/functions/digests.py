"""MD5 of many texts that differ in two numbers, in numpy."""

from __future__ import annotations

import math

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
PIECE = 8_192  # numbers hashed together, so that the state stays in the cache


def _block(state: list, words: list) -> list:
    """One block of MD5 (RFC 1321); words and state are arrays of 32-bit numbers, or of one."""
    a, b, c, d = state
    for i in range(64):
        turn, at = divmod(i, 16)
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), at
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * at + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * at + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * at) % 16
        f = f + (words[g] + np.uint32(_SINES[i])) + a
        left = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(left)) | (f >> np.uint32(32 - left)))
    return [x + y for x, y in zip((a, b, c, d), state)]


def _decimals(numbers: np.ndarray, width: int) -> list[np.ndarray]:
    return [(numbers // 10 ** (width - 1 - j) % 10 + 48).astype(np.uint32) for j in range(width)]


def _hashed(parts: list) -> np.ndarray:
    """Hashes of texts of one length; a part is bytes, or a list of arrays with a character each."""
    length = sum(len(part) for part in parts)
    whole = bytearray(b"".join(part if isinstance(part, bytes) else bytes(len(part)) for part in parts) + b"\x80")
    whole += bytes(-(len(whole) + 8) % 64) + (8 * length).to_bytes(8, "little")
    words = [np.array([[w]], dtype=np.uint32) for w in np.frombuffer(bytes(whole), dtype="<u4")]
    place = 0
    for part in parts:
        for j, character in enumerate([] if isinstance(part, bytes) else part):
            at = place + j
            words[at // 4] = words[at // 4] + (character << np.uint32(8 * (at % 4)))
        place += len(part)
    state = [np.array([[x]], dtype=np.uint32) for x in _START]
    for at in range(0, len(words), 16):
        state = _block(state, words[at : at + 16])
    return state[0].byteswap()


def _equal_widths(first: int, end: int, most: int):
    while first < end:
        last = min(end, first + most, 10 ** len(str(first)))
        yield first, last
        first = last


def leading_numbers(head: str, rows: range, middle: str, first: int, end: int) -> np.ndarray:
    """The first eight hexadecimal digits of md5(head + row + middle + number), as numbers.

    One line for each of ``rows``, one column for each number from ``first`` below ``end``.
    """
    out = np.empty((len(rows), end - first), dtype=np.uint32)
    for a, b in _equal_widths(first, end, PIECE):
        columns = _decimals(np.arange(a, b)[None, :], len(str(a)))
        for c, d in _equal_widths(rows.start, rows.stop, max(1, PIECE // (b - a))):
            lines = _decimals(np.arange(c, d)[:, None], len(str(c)))
            found = _hashed([head.encode(), lines, middle.encode(), columns])
            out[c - rows.start : d - rows.start, a - first : b - first] = found
    return out
