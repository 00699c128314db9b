"""Multinomial draws through a binary tree, the same in every task, language and engine.

The cells of a class are numbered; node (h, p) holds the cells whose number shifted by h bits is
p. The draws that reach a node are split between its halves by one binomial number. It is found
by inversion from the mode outwards: only sums, products, quotients and square roots of doubles
are used, which are exactly rounded everywhere, and the uniform number comes from whole-number
mixing of the node's hash and the iteration. A task can therefore walk from the root to its own
cells alone; all tasks, and the SQL twin, see the same numbers at every node.
"""

from __future__ import annotations

import hashlib

import numpy as np

# The two multipliers of the public 32-bit finalizer of MurmurHash3.
MULTIPLIERS = (2246822507, 3266489909)
LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers (as uint64) scattered over the 32-bit numbers, one to one."""
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MULTIPLIERS[0])) & LOW
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(MULTIPLIERS[1])) & LOW
    return x ^ (x >> np.uint64(16))


def node_seeds(seed: int, key: str, height: int, prefixes: list[int]) -> np.ndarray:
    """Two 32-bit numbers for each node, shape (nodes, 2)."""
    texts = [hashlib.md5(f"{seed}~{key}~{height}~{p}".encode()).hexdigest() for p in prefixes]
    return np.array([[int(t[:8], 16), int(t[8:16], 16)] for t in texts], dtype=np.uint64).reshape(-1, 2)


def uniforms(seeds: np.ndarray, iterations: np.ndarray) -> np.ndarray:
    """Numbers below 1 in steps of 2**-52, shape (nodes, iterations)."""
    turn = mixed(iterations.astype(np.uint64) + np.uint64(1))
    high = mixed(seeds[:, :1] ^ turn)
    low = mixed(seeds[:, 1:] ^ turn)
    return (high * np.uint64(1 << 20) + (low >> np.uint64(12))).astype(np.float64) / float(1 << 52)


def reach(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Steps from the mode beyond which all probability left is below the steps of ``uniforms``."""
    return np.minimum(m, np.ceil(10.0 * np.sqrt(m * a * b) / (a + b)) + 20.0)


def binomials(m: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial(m, a / (a + b)) at the uniform numbers ``u``; a and b above zero, arrays of one length.

    Weights relative to the mode are added in the order mode, +1, -1, +2, -2, ...; the answer is
    the value at which the sum first exceeds ``u`` times the whole sum.
    """
    m, a, b = (np.asarray(v, dtype=np.float64) for v in (m, a, b))
    steps = reach(m, a, b)
    mode = np.minimum(m, np.floor((m + 1.0) * a / (a + b)))

    def walk(state: np.ndarray, step) -> None:
        """Call step(i, state, up, down) -> keep; elements that it gives up drop out at times."""
        at = np.arange(len(m))
        mm, aa, bb, top, last = m, a, b, mode, steps
        up, down = np.ones(len(m)), np.ones(len(m))
        held, i = state, 0
        while len(at):
            i += 1
            j = top + float(i - 1)
            up = up * (((mm - j) * aa) / ((j + 1.0) * bb))
            j = top - float(i - 1)
            down = down * ((j * bb) / ((mm - j + 1.0) * aa))
            inside = last >= i
            up, down = np.where(inside, up, 0.0), np.where(inside, down, 0.0)
            keep = step(i, at, held, up, down) & inside
            if i % 4 == 0 or not keep.any():
                state[at] = held
                at, mm, aa, bb, top, last = (v[keep] for v in (at, mm, aa, bb, top, last))
                up, down, held = up[keep], down[keep], held[keep]

    def add(i, at, sums, up, down):
        sums[:] = (sums + up) + down
        # the weights only fall: what no longer changes the sum never will
        return (up + down) > sums * 2.0**-60

    total = np.ones(len(m))
    walk(total, add)
    target = u * total
    value = mode.copy()
    found = target < 1.0

    def choose(i, at, sums, up, down):
        first = sums + up
        second = first + down
        goal, waiting = target[at], ~found[at]
        value[at[waiting & (first > goal)]] += i
        value[at[waiting & (first <= goal) & (second > goal)]] -= i
        found[at] |= second > goal
        sums[:] = second
        return ~found[at]

    walk(np.ones(len(m)), choose)
    return value.astype(np.int64)


def subtree(
    weights: np.ndarray, m: np.ndarray, iterations: np.ndarray, seed: int, key: str, first: int, height: int
) -> np.ndarray:
    """Draws (iterations, cells) of the 2**height cells from number ``first`` on, of which ``m`` are drawn."""
    levels = [weights.astype(np.float64)]
    for _ in range(height):
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    counts = m.reshape(1, -1).astype(np.int64)  # nodes, iterations
    for h in range(height, 0, -1):
        halves = levels[h - 1].reshape(-1, 2)
        left = np.where(halves[:, 1:] > 0, 0, counts)  # all, where nothing lies to the right
        both = np.nonzero((halves > 0).all(axis=1))[0]
        if len(both):
            seeds = node_seeds(seed, key, h, [(first >> h) + int(p) for p in both])
            u = uniforms(seeds, iterations)
            a, b = (np.repeat(halves[both, side], len(iterations)) for side in (0, 1))
            left[both] = binomials(counts[both].ravel(), a, b, u.ravel()).reshape(len(both), -1)
        counts = np.stack([left, counts - left], axis=1).reshape(-1, len(iterations))
    return counts.T


def descend(
    splits: list[tuple[int, int, int]], group: int, below: int, iterations: np.ndarray, seed: int, key: str
) -> np.ndarray:
    """Draws that reach a group of cells in each iteration, from its ancestors' splits (level, left, right).

    Levels count from the groups (1: parents of groups); the highest one is the root.
    """
    splits = sorted(splits, reverse=True)
    _, left, right = splits[0]
    m = np.full(len(iterations), left + right, dtype=np.int64)
    for level, left, right in splits:
        k = m
        if right > 0:
            u = uniforms(node_seeds(seed, key, level + below, [group >> level]), iterations)[0]
            k = binomials(m, np.full(len(m), left), np.full(len(m), right), u)
        m = m - k if group >> (level - 1) & 1 else k
    return m
