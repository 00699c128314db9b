"""Packing into training sequences: vector bin packing by the dot-product heuristic.

An example has three sizes: tokens, segments (one a piece) and loss-bearing tokens. A
sequence has a limit for each. One sequence is open at a time; of the pieces that
fit, the one with the largest dot product of its sizes (as shares of the limits) and
what is still free is placed next, so that long pieces go into empty sequences, and
many short ones never use up the segments of a sequence while tokens stay free.

Where cutting is allowed (plain documents) the piece that closes a sequence is cut to
fill it, and a sequence that reaches another limit first is cut back to a power of
two, so nothing is padded. Where it is not (instruction examples) pieces stay whole.

Packing works on runs of ``RUN_TOKENS`` tokens inside a partition; what a run leaves
over goes on to the next one. There is no shuffle, a run's memory is bounded, and rows
keep the neighbourhood of their input order: a mixed order stays mixed in the sequences. Sequence ids are the
partition number and a count, the same again when a lost task is repeated.

Nulls and edge cases: a null or empty text is the end token alone; a text that is
longer than a sequence is spread over several; repeated rows and null ids are packed row
by row; an empty table gives no pieces; a whole example beyond a limit is a
sequence of its own, marked ``oversize``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm.common import long_texts, text_slices

TOKENS = 4096
SEGMENTS = 128
RUN_TOKENS = 1 << 20
RUN_PIECES = 2_000
END = 2
CACHE = 300_000  # pieces of words whose ids a worker remembers
CHUNK = 4 << 20  # bytes of text whose words are encoded together
GAP = re.compile(rb"[ \t-\r]")

#: Letters whose lower case and composition do not depend on their neighbours.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[!-~{LETTERS}]+")


class Pieces(dict):
    """A number for each piece, in order of appearance; ``fresh`` holds those that have no ids yet."""

    def __init__(self) -> None:
        super().__init__({" ": 0})
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts by a tokenizer that never joins across white space.

    A text's ids are those of its words in order, so each distinct word of a batch is cut
    into pieces once, and each distinct piece goes through the merges once for as long as
    it is remembered. Words of plain letters skip the tokenizer's own frame; any other
    word runs through the whole tokenizer.
    """

    def __init__(self, definition: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        steps = json.loads(definition)
        pattern = steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # among plain words the classes of the pattern are these characters
        self.pieces = re.compile(pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9") + "| ")
        self.special = "|".join(re.escape(t["content"]) for t in steps["added_tokens"])
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0xC0, 0x100)) if PLAIN.fullmatch(c)]
        pairs = {b for c in letters for b in zip(c.encode().decode("latin-1"), mapped.pre_tokenize_str(c)[0][0])}
        self.odd = sorted((a, b) for a, b in pairs if a != b)  # bytes the tokenizer writes as another character
        # the same merges without the library's own cache, which new pieces only slow down
        model = {k: v for k, v in steps["model"].items() if k != "type" and v is not None}
        model["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Tokenizer(models.BPE(**model, cache_capacity=0))
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        self.number = Pieces()
        self.ids, self.lengths = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # of the numbered pieces

    def _learn(self) -> None:
        """Ids of the fresh pieces, all in one call."""
        fresh, self.number.fresh = self.number.fresh, []
        if fresh:
            low = " ".join(fresh).encode().decode("latin-1")  # a character for each byte
            for byte, letter in self.odd:
                low = low.replace(byte, letter)
            low = low.split(" ")
            found = self.merges.encode(low, is_pretokenized=True, add_special_tokens=False)
            self.lengths = np.concatenate((self.lengths, np.bincount(np.array(found.word_ids, np.int64), minlength=len(low))))
            self.ids = np.concatenate((self.ids, np.array(found.ids, "<u4")))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (UTF-8) in order and how many each has."""
        text = words.view(pa.string())
        plain = pc.match_substring_regex(text, f"^[!-~{LETTERS}]+$")
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(text, self.special))
        plain = plain.to_numpy(zero_copy_only=False)
        if len(self.number) > self.cache:
            self._forget()
        some = words.filter(pa.array(plain))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), b" ")[0].as_py().decode().lower()
        found = self.pieces.findall(joined)
        code = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        self._learn()
        starts = np.cumsum(self.lengths) - self.lengths
        count = self.lengths[code]
        ids = gathered(self.ids, starts[code], count)
        cut = np.flatnonzero(code == 0)
        upto = np.concatenate(([0], np.cumsum(count)))
        lengths = np.zeros(len(words), np.int64)
        if plain.any():
            lengths[plain] = np.diff(np.concatenate(([0], upto[cut], [upto[-1]])))
        others = np.flatnonzero(~plain)
        if not len(others):
            return ids, lengths
        rest = [w.decode("utf-8", "replace") for w in words.take(pa.array(others)).to_pylist()]
        rest = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)]
        lengths[others] = [len(x) for x in rest]
        order = np.argsort(np.concatenate((np.flatnonzero(plain), others)), kind="stable")
        flat = np.concatenate((ids, *rest))
        sizes = np.concatenate((lengths[plain], lengths[others]))
        return gathered(flat, (np.cumsum(sizes) - sizes)[order], lengths), lengths

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = split.flatten().view(pa.large_binary()).cast(pa.binary()).dictionary_encode()
        flat, lengths = self._words(words.dictionary)
        starts = np.cumsum(lengths) - lengths
        at = words.indices.to_numpy()
        ids = gathered(flat, starts[at], lengths[at])
        upto = np.concatenate(([0], np.cumsum(lengths[at])))
        ends = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text; a long text is cut at white space on the way."""
        parts: list[bytes] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            text, at = text or b"", 0
            while len(text) - at > CHUNK and (gap := GAP.search(text, at + CHUNK)):
                parts.append(text[at : gap.start()])
                owner.append(i)
                at = gap.start()
            parts.append(text[at:])
            owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        first = 0
        while first < len(parts):
            size, last = 0, first
            while last < len(parts) and (last == first or size + len(parts[last]) <= CHUNK):
                size += len(parts[last])
                last += 1
            for i, ids in zip(owner[first:last], self._batch(parts[first:last])):
                out[i].append(ids)
            first = last
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def encode(self, text: bytes | None) -> np.ndarray:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's encoder: tasks that follow each other in one process share it."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


@dataclass
class Packer:
    """Open pieces of a run and the sequences made of them.

    ``tokens``, ``loss``: sizes of the waiting pieces. ``take`` returns one sequence as
    [(piece, tokens used from its front)], cutting only if ``cut``.
    """

    limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)
    cut: bool = True
    sizes: list[tuple[int, int]] = field(default_factory=list)

    def pack(self, sizes: np.ndarray, flush: bool) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
        """Sequences of (piece, first token, tokens) and what is left of each piece.

        ``sizes`` is (n, 2): tokens and loss-bearing tokens. Unless ``flush``, packing
        stops when the waiting pieces cannot fill a sequence any more.
        """
        most = np.array(self.limits, float)
        left = sizes.astype(np.int64).copy()
        begun = np.zeros(len(left), np.int64)
        sequences: list[list[tuple[int, int, int]]] = []
        while True:
            waiting = np.flatnonzero(left[:, 0] > 0)
            if not len(waiting) or not flush and left[waiting, 0].sum() < 2 * self.limits[0]:
                return sequences, left
            need = np.stack([left[waiting, 0], np.ones(len(waiting), np.int64), left[waiting, 1]], 1) / most
            free, used, alive = np.ones(3), [], np.ones(len(waiting), bool)
            while alive.any() and free.min() > 1e-12:
                fits = alive & (need <= free + 1e-12).all(1)
                if fits.any():
                    gain = np.where(fits, need @ free, -1)
                elif self.cut:
                    gain = np.where(alive, np.minimum(need, free) @ free, -1)
                else:
                    break
                i = int(np.argmax(gain))
                p = int(waiting[i])
                share = int(left[p, 0])
                if not fits.any():
                    share = min(share, self._share(left[p], free, most))
                    if share <= 0:
                        alive[i] = False
                        continue
                loss = int(round(left[p, 1] * share / left[p, 0]))
                used.append((p, int(begun[p]), share))
                free = free - np.array([share, 1, loss]) / most
                begun[p] += share
                left[p] -= (share, loss)
                alive[i] = False
            if not used:  # a whole piece beyond a limit
                p = int(waiting[np.argmax(need.max(1))])
                used = [(p, int(begun[p]), int(left[p, 0]))]
                left[p] = 0
            if self.cut:
                self._trim(used, begun, left, sizes)
            sequences.append(used)

    def _share(self, size: np.ndarray, free: np.ndarray, most: np.ndarray) -> int:
        tokens = int(round(free[0] * most[0]))
        if size[1]:
            tokens = min(tokens, int(round(free[2] * most[2])) * int(size[0]) // int(size[1]))
        return tokens

    def _trim(self, used: list, begun: np.ndarray, left: np.ndarray, sizes: np.ndarray) -> None:
        """Give tokens back until the sequence is full or a power of two long."""
        total = sum(n for _, _, n in used)
        if total >= self.limits[0]:
            return
        over = total - (1 << (total.bit_length() - 1))
        while over:
            p, at, n = used.pop()
            back = min(n, over)
            over -= back
            begun[p] -= back
            left[p] += (back, int(round(sizes[p, 1] * back / sizes[p, 0])))
            if n > back:
                used.append((p, at, n - back))


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " loss_tokens long"
)


def pack_documents(docs: DataFrame, tokenizer: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)) -> DataFrame:
    """One row per piece of the whole texts of ``docs``; all tokens bear loss.

    ``tokenizer`` is the path of a word tokenizer's definition; the driver reads it
    (its size is fixed) and sends it along.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(definition.value), Packer(limits)
        base, count = TaskContext.get().partitionId() << 36, 0
        ids: list[np.ndarray] = []  # of the documents in hand, from where they are not yet placed
        head: list[tuple[int | None, int, int]] = []  # (doc_id, first token in hand, all tokens)

        def place(flush: bool) -> pa.RecordBatch:
            nonlocal count, ids, head
            rows = []
            lengths = np.array([len(x) for x in ids], np.int64)
            sequences, left = packer.pack(np.stack([lengths, lengths], 1), flush)
            for used in sequences:
                offset = 0
                for p, at, n in used:
                    doc_id, first, total = head[p]
                    crc = zlib.crc32(ids[p][at : at + n].tobytes())
                    rows.append((doc_id, first + at, n, crc, total, base + count, offset, n))
                    offset += n
                count += 1
            keep = np.flatnonzero(left[:, 0] > 0)
            head = [(head[p][0], head[p][1] + int(lengths[p] - left[p, 0]), head[p][2]) for p in keep]
            ids = [ids[p][lengths[p] - left[p, 0] :] for p in keep]
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")[:7]] + ["loss_tokens"]
            )

        held = 0
        for batch in batches:
            doc_ids = iter(batch["doc_id"].to_pylist())
            for texts in text_slices(batch["text"]):
                for tokens in encoder.encode_all(texts):
                    ids.append(np.concatenate((tokens, np.array([END], "<u4"))))
                    head.append((next(doc_ids), 0, len(ids[-1])))
                    held += len(ids[-1])
                    if held >= RUN_TOKENS or len(ids) >= RUN_PIECES:
                        yield place(False)
                        held = sum(map(len, ids))
        if ids:
            yield place(True)

    rows = long_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES)


def pack_examples(
    examples: DataFrame, example: Column, tokens: Column, loss: Column, limits: tuple[int, int, int]
) -> DataFrame:
    """Place whole examples: (example, sequence_id, offset, tokens, loss_tokens, oversize).

    Negative or null sizes count as zero tokens; an example without tokens gets no place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, count = Packer(limits, cut=False), TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_PIECES):
                part = batch.slice(at, RUN_PIECES)
                sizes = np.stack([part["tokens"].to_numpy(), part["loss_tokens"].to_numpy()], 1)
                index, sequence, offset = [], [], []
                for used in packer.pack(sizes, True)[0]:
                    upto = 0
                    for p, _, n in used:
                        index.append(p)
                        sequence.append(base + count)
                        offset.append(upto)
                        upto += n
                    count += 1
                placed = part.take(pa.array(index, pa.int64()))
                over = (sizes[index] > np.array([limits[0], limits[2]])).any(1) if index else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        placed["example"],
                        pa.array(sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                        placed["tokens"],
                        placed["loss_tokens"],
                        pa.array(over),
                    ],
                    names=["example", "sequence_id", "offset", "tokens", "loss_tokens", "oversize"],
                )

    rows = examples.select(
        example.cast("string").alias("example"),
        F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("tokens"),
        F.greatest(F.coalesce(loss.cast("long"), F.lit(0)), F.lit(0)).alias("loss_tokens"),
    )
    return rows.mapInArrow(
        run, "example string, sequence_id long, offset long, tokens long, loss_tokens long, oversize boolean"
    )
