"""SimHash near-duplicates with a Gray-order hierarchical index.

1. ``fingerprints``: 64 majority bits over the hashed word shingles of each whole text.
2. Equal fingerprints are one row from here on, so exact copies cost nothing more.
3. ``links``: if two fingerprints differ in at most two bits, one of three bit
   blocks is the same in both. Each fingerprint is dealt out three times by
   (block, its value), with that block moved to the front; all rows that can
   link then meet in one partition. A value that more than ``HEAD_ROWS`` distinct
   fingerprints share is dealt out again by thirds of the bits left. Four
   levels leave at most 2 ** 13 fingerprints a value, so no group is unbounded.
4. In a partition the rearranged fingerprints are sorted by Gray rank, which puts
   similar bit patterns side by side. Nodes over runs of them hold the bits all
   their members share (pattern and mask); nodes over runs of nodes do the same.
   Two nodes whose shared bits differ more than allowed cannot hold a link, so
   the pair of whole groups is dropped; the rest is opened level by level.
5. A partition reports each linked fingerprint with the smallest one of its local
   group (at most one row each, never all pairs); ``common.components`` joins the
   groups across partitions.

``representatives`` takes fingerprints of five-word shingles. Pairs within two bits are only
candidates there, and two bits reach few pairs of Jaccard similarity 0.8 (they differ
in about ten), so pairs also meet by bands of minimum hashes: 25 keys of 6 hashes, by which a
pair at 0.8 meets with probability 0.9995. In a key each id meets its 4 neighbours in Gray
order and the first one, and each such pair is verified on the texts' shingle sets. Keys of more
ids are then closed (``closing_links``): all their pairs that are not yet in one group are
compared in blocks of bounded size, whose overlaps are matrix products over the shingles (64-bit
hashes) both sides have, and of which only star edges come back. A large group of near copies is
one group by then and has no such pair.

Nulls and edge cases: a null or word-less text has fingerprint zero and is linked
like any other; a null doc_id takes part but is never a component_id unless its
component has no other; repeated rows give one result row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.llm.common import broadcast_small, components, fresh, long_texts, stored, text_bytes, text_slices
from shotline.llm.hashing import P1, mix, xxh64

HEAD_ROWS = 16_384
LEVELS = 4
FAN = 8  # members of a node
CHUNK = 65_536  # rows indexed together
LANES = np.uint64(0x0001000100010001)
SEGMENT = 60_000  # shingles counted in 16-bit lanes
BANDS = 25  # keys of a text, each of ROWS minimum hashes
ROWS = 6
NEAR = 4  # neighbours of an id among those of a key, before larger keys are closed
BLOCK = 256  # ids of a key compared with as many others in one task
COLUMNS = 8_192  # shingles in a matrix product
PAIRS = 8_192  # pairs of nodes opened together, each into FAN * FAN pairs


def _shingles(texts: list[bytes | None], words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts that have words, their numbers of shingles, and the shingles' hashes one after another."""
    split = [t.lower().split() if t else [] for t in texts]
    used = np.array([i for i, w in enumerate(split) if w], np.int64)
    if not len(used):
        return used, used, np.zeros(0, np.uint64)
    data = b" ".join(b" ".join(split[i]) for i in used)
    count = np.array([len(split[i]) for i in used], np.int64)
    del split
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    start = np.concatenate(([0], gaps + 1))
    end = np.concatenate((gaps, [len(data)]))
    shingles = np.maximum(count - words + 1, 1)
    first = np.repeat(np.cumsum(count) - count - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = first + np.repeat(np.minimum(count, words) - 1, shingles)
    return used, shingles, xxh64(data, start[first], end[last], seed)


def _majority(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Majority bits (uint64) of each text's shingle hashes."""
    # each document's shingles are summed in pieces short enough for 16-bit lanes
    pieces = -(-shingles // SEGMENT)
    doc = np.repeat(np.arange(len(shingles)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = (np.cumsum(shingles) - shingles)[doc] + nth * SEGMENT
    by_doc = np.cumsum(pieces) - pieces
    value = np.zeros(len(shingles), np.uint64)
    for shift in range(16):
        sums = np.add.reduceat((h >> np.uint64(shift)) & LANES, cut)
        for lane in range(4):
            ones = np.add.reduceat((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), by_doc).astype(np.int64)
            value |= (2 * ones > shingles).astype(np.uint64) << np.uint64(shift + 16 * lane)
    return value


def fingerprint_texts(texts: list[bytes | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of whole texts; letters A-Z count as a-z."""
    out = np.zeros(len(texts), np.uint64)
    used, shingles, h = _shingles(texts, words, seed)
    if len(used):
        out[used] = _majority(h, shingles)
    return out


def sketch_texts(texts: list[bytes | None], words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, hashes of the word sequences, and (texts x BANDS) keys of minimum hashes; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    same = np.zeros(len(texts), np.uint64)
    bands = np.zeros((len(texts), BANDS), np.uint64)
    used, shingles, h = _shingles(texts, words, seed)
    if not len(used):
        return out, same, bands
    out[used] = _majority(h, shingles)
    same[used] = [xxhash.xxh64_intdigest(b" ".join(texts[i].lower().split()), seed) for i in used]
    start = np.cumsum(shingles) - shingles
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(used), band, np.uint64)
            for factor in factors[band]:
                key = mix(key * P1 + np.minimum.reduceat(h * factor, start))
            bands[used, band] = key
    return out, same, bands


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a (signed) long."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [fingerprint_texts(t, words, seed) for t in text_slices(column)]
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))

    return of(text)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    rank = code.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level, leaves first."""
    pattern, mask = codes, np.full(len(codes), ~np.uint64(0))
    out = [(pattern, mask)]
    while len(pattern) > FAN:
        cut = np.arange(0, len(pattern), FAN)
        ones, some = np.bitwise_and.reduceat(pattern, cut), np.bitwise_or.reduceat(pattern, cut)
        mask = np.bitwise_and.reduceat(mask, cut) & ~(ones ^ some)
        pattern = ones & mask
        out.append((pattern, mask))
    return out


def gray_links(codes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``codes``, sorted by Gray rank, at ``bits`` or fewer differences.

    Pairs of nodes are opened depth first in blocks of bounded size.
    """
    levels = _levels(codes)
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    stack = [(len(levels) - 1, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits
        a, b = a[near], b[near]
        if level == 0:
            apart = a < b
            yield a[apart], b[apart]
            continue
        below = len(levels[level - 1][0])
        i = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, 2).ravel()
        j = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, 1).ravel()
        ok = (i <= j) & (j < below)
        stack.append((level - 1, i[ok], j[ok]))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (index of the smallest member) after the links a-b."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if np.array_equal(labels[a], labels[b]):
            return labels
        for side in (labels[a], labels[b]):
            np.minimum.at(labels, side, low)
        while not np.array_equal(labels, deeper := labels[labels]):
            labels = deeper


def _local_groups(fp: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gray_rank(code), kind="stable")
    fp, code = fp[order], code[order]
    labels = np.arange(len(fp))
    for a, b in gray_links(code, bits):
        labels = merged(labels, a, b)
    other = labels != np.arange(len(fp))
    return fp[other].view(np.int64), fp[labels[other]].view(np.int64)


def _index_partition(bits: int):
    """Index runs of whole (path, head) groups of a partition sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def emit(parts):
            key, fp, code = (np.concatenate(x) for x in zip(*parts))
            # a path's codes are compared with each other only: other paths order the bits differently
            for path in np.unique(key[:, 0]):
                rows = key[:, 0] == path
                u, v = _local_groups(fp[rows], code[rows], bits)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch["path"].to_numpy(), batch["head"].to_numpy()], 1)
            part = (key, batch["fp"].to_numpy().view(np.uint64), batch["code"].to_numpy().view(np.uint64))
            held.append(part)
            size += len(key)
            if size >= CHUNK:
                key, fp, code = (np.concatenate(x) for x in zip(*held))
                end = len(key) - 1
                while end > 0 and (key[end] == key[-1]).all():
                    end -= 1
                if (key[end] != key[-1]).any():  # keep the last, perhaps unfinished group
                    end += 1
                    yield from emit([(key[:end], fp[:end], code[:end])])
                    held, size = [(key[end:], fp[end:], code[end:])], len(key) - end
        if held:
            yield from emit(held)

    return run


def _moved(code: Column, fixed: int, start: int, width: int) -> Column:
    """``code`` with bits start..start+width (from the top) moved behind its first ``fixed`` bits."""

    def field(at: int, size: int, to: int) -> Column:
        if size <= 0:
            return F.lit(0).cast("long")
        value = F.shiftrightunsigned(F.shiftleft(code, at), 64 - size)
        return F.shiftleft(value, 64 - to - size)

    kept = field(0, fixed, 0) if fixed else F.lit(0).cast("long")
    front = field(start, width, fixed)
    middle = field(fixed, start - fixed, fixed + width)
    rest = field(start + width, 64 - start - width, start + width)
    return kept.bitwiseOR(front).bitwiseOR(middle).bitwiseOR(rest)


def _dealt(rows: DataFrame, fixed: dict[int, int], blocks: int) -> tuple[DataFrame, dict[int, int]]:
    """Deal each row out once per block of its free bits; paths name the blocks chosen so far."""
    options, ends = None, {}
    for path, kept in fixed.items():
        cuts = [kept + (64 - kept) * i // blocks for i in range(blocks + 1)]
        new = []
        for i in range(blocks):
            number, width = path * (blocks + 1) + i + 1, cuts[i + 1] - cuts[i]
            ends[number] = kept + width
            code = _moved(F.col("code"), kept, cuts[i], width)
            head = F.shiftrightunsigned(code, 64 - ends[number])
            new.append(F.struct(F.lit(number).cast("long").alias("path"), code.alias("code"), head.alias("head")))
        array = F.array(*new)
        options = array if options is None else F.when(F.col("path") == path, array).otherwise(options)
    return rows.select("fp", F.inline(options)), ends


def links(distinct: DataFrame, bits: int = 2, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Star edges (u, v) that connect all fingerprints ``fp`` at ``bits`` or fewer differences."""
    blocks = bits + 1
    rows, fixed = distinct.select("fp", F.col("fp").alias("code"), F.lit(0).cast("long").alias("path")), {0: 0}
    out = None
    for level in range(LEVELS):
        dealt, fixed = _dealt(rows, fixed, blocks)
        hot = None
        if level < LEVELS - 1:
            hot = stored(dealt.groupBy("path", "head").count().where(F.col("count") > head_rows).drop("count"), "heads")
            if hot.isEmpty():
                hot = None
        cold = dealt if hot is None else dealt.join(hot, ["path", "head"], "left_anti")
        found = (
            cold.repartition("path", "head")
            .sortWithinPartitions("path", "head")
            .mapInArrow(_index_partition(bits), "u long, v long")
        )
        out = found if out is None else out.union(found)
        if hot is None:
            return out
        rows = stored(dealt.join(hot, ["path", "head"], "left_semi").select("fp", "code", "path"), "hot")
    return out


def _classes(distinct: DataFrame, bits: int) -> DataFrame:
    """(fp, root, least) for the distinct fingerprints (fp, least)."""
    classes = stored(distinct, "classes")
    roots = components(links(classes, bits), "simhash")
    return classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )


def near_duplicates(docs: DataFrame, bits: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    marked = stored(long_texts(docs).select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")), "fingerprints")
    named = _classes(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), bits)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(named.join(smallest, "root").select("fp", "component_id"), "members")
    return marked.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _sketches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch["text"]):
                fp, same, bands = sketch_texts(texts, words, seed)
                size = len(texts)
                keys = pa.ListArray.from_arrays(np.arange(0, size * BANDS + 1, BANDS, np.int32), pa.array(bands.ravel().view(np.int64)))
                columns = [*(batch[c].slice(at, size) for c in ("oid", "tid")), *(pa.array(x.view(np.int64)) for x in (same, fp, gray_rank(fp)))]
                yield pa.RecordBatch.from_arrays([*columns, keys], names=["oid", "tid", "id", "fp", "rank", "bands"])
                at += size

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of ids of one key: each with the NEAR before it and with the key's first one, in a partition sorted by key."""
    key, ids, first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        new = batch.num_rows
        if not new:
            continue
        held = len(key)
        key = np.concatenate((key, batch["key"].to_numpy()))
        ids = np.concatenate((ids, batch["id"].to_numpy()))
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.concatenate((begins, [len(key)])))
        head = np.repeat(ids[begins], runs)
        if held:  # the held rows of the key that goes on know its first id
            head[key == key[held - 1]] = first[held - 1]
            head[:held] = first
        first = head
        far = ids[held:] != first[held:]
        u, v = [first[held:][far]], [ids[held:][far]]
        for by in range(1, min(NEAR, len(key) - 1) + 1):
            to = np.arange(max(by, held), len(key))
            to = to[key[to] == key[to - by]]
            u.append(ids[to - by])
            v.append(ids[to])
        u, v = np.concatenate(u), np.concatenate(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])
        key, ids, first = key[-NEAR:], ids[-NEAR:], first[-NEAR:]


def shingle_set(text: bytes | None, words: int) -> set[tuple[bytes, ...]]:
    split = text.lower().split() if text else []
    if len(split) <= words:
        return {tuple(split)} if split else set()
    return set(zip(*(split[i:] for i in range(words))))


def _similar(words: int, similarity: float):
    """Keep the pairs whose texts' shingle sets reach the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(text_bytes(batch["tu"]), text_bytes(batch["tv"])):
                a, b = shingle_set(a, words), shingle_set(b, words)
                both = len(a & b)
                keep.append(both + 1e-9 >= similarity * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch[c].filter(mask) for c in ("u", "v")], names=["u", "v"])

    return run


def candidates(classes: DataFrame, bits: int) -> DataFrame:
    """Pairs (u < v) of ids that may be similar, with the number of times they met.

    They meet by a fingerprint at ``bits`` or fewer differences or by a band of minimum hashes.
    """
    keys = classes.where("id <> 0").select(F.explode("bands").alias("key"), "rank", "id")
    met = keys.repartition("key").sortWithinPartitions("key", "rank", "id").mapInArrow(_neighbours, "u long, v long")
    first = stored(classes.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    equal = classes.join(first, "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    near = links(first.select("fp"), bits).toDF("a", "b").distinct()
    near = near.join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select("u", "v")
    pairs = met.union(equal.union(near).select(F.least("u", "v"), F.greatest("u", "v")))
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    both = pairs.select("u", "v").join(texts.toDF("u", "tu"), "u").join(texts.toDF("v", "tv"), "v")
    return stored(long_texts(both, 200).mapInArrow(_similar(words, similarity), "u long, v long"), "similar")


def _shingle_sets(words: int, seed: int):
    """(id, set): the sorted hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch["text"]):
                used, shingles, h = _shingles(texts, words, seed)
                sets = [np.zeros(0, np.uint64)] * len(texts)
                for i, part in zip(used, np.split(h, np.cumsum(shingles)[:-1])):
                    sets[i] = np.unique(part)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, len(texts)), lists], names=["id", "set"])
                at += len(texts)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a and b (sorted, no repeats)."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = [np.concatenate(x) for x in (a, b)]
    common = np.intersect1d(*flat)
    marked = []  # (row, column) of the shingles both sides have
    for x, sets in zip(flat, (a, b)):
        row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        column = np.searchsorted(common, x)
        shared = np.isin(x, common, assume_unique=False)
        marked.append((row[shared], column[shared]))
    for at in range(0, len(common), COLUMNS):
        sides = []
        for (row, column), sets in zip(marked, (a, b)):
            inside = (column >= at) & (column < at + COLUMNS)
            matrix = np.zeros((len(sets), min(COLUMNS, len(common) - at)), np.float32)
            matrix[row[inside], column[inside] - at] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def _close(similarity: float):
    """Star edges of the links between the two sides of a block pair, or within a block if there is one side."""

    def run(table: pa.Table) -> pa.Table:
        ids, root, side = (table[c].to_numpy() for c in ("id", "root", "side"))
        column = table["set"].combine_chunks()
        flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum([0, *column.value_lengths().to_pylist()])
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        labels = np.arange(len(ids))
        if len(left):
            a, b = [sets[i] for i in left], [sets[i] for i in right]
            both = overlaps(a, b)
            sizes = [np.array(list(map(len, x)), float) for x in (a, b)]
            linked = both + 1e-9 >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both)
            linked &= root[left][:, None] != root[right][None, :]
            i, j = np.nonzero(linked)
            labels = merged(labels, left[i], right[j])
        other = labels != np.arange(len(ids))
        return pa.table({"u": ids[other], "v": ids[labels[other]]})

    return run


def closing_links(
    classes: DataFrame, texts: DataFrame, roots: DataFrame, words: int, similarity: float, seed: int, block: int = BLOCK
) -> DataFrame | None:
    """Links between ids of one key that are in different groups so far, for the keys of more than NEAR + 1 ids.

    The ids of a key's largest group are compared with the rest only, the rest also with
    each other, each pair of blocks in a task of its own.
    """
    keys = classes.where("id <> 0").select(F.explode("bands").alias("key"), "id")
    hot = stored(keys.groupBy("key").count().where(F.col("count") > NEAR + 1).select("key"), "hot-keys")
    if hot.isEmpty():
        return None
    members = keys.join(hot, "key", "left_semi").join(roots.toDF("id", "root"), "id", "left")
    members = stored(members.select("key", "id", F.coalesce("root", "id").alias("root")), "members-of-keys")
    groups = members.groupBy("key", "root").count()
    main = groups.groupBy("key").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("n"))
    main = main.where("main.count < n").select(
        "key", F.col("main.root").alias("main"), F.ceil(F.col("main.count") / block).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("main.count")) / block).cast("int").alias("rests"),
    )
    main = stored(main, "open-keys")
    if main.isEmpty():
        return None
    rows = members.join(main, "key").withColumn("in_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))

    def pairs(others, make):
        return F.transform(F.sequence(F.lit(0), others - 1), make)

    def task(kind, a, b, side):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))

    own, zero, one = F.col("own"), F.lit(0), F.lit(1)
    rest = F.concat(
        pairs(F.col("rests"), lambda x: task(0, F.least(own, x), F.greatest(own, x), own > x)),
        pairs(F.col("mains"), lambda x: task(1, own, x, zero)),
    )
    mains = pairs(F.col("rests"), lambda x: task(1, x, own, one))
    dealt = rows.select("key", "id", "root", F.inline(F.when(F.col("in_main"), mains).otherwise(rest)))
    sets = long_texts(texts.join(rows.select("id").distinct(), "id", "left_semi")).mapInArrow(_shingle_sets(words, seed), "id long, set array<long>")
    together = dealt.join(stored(sets, "shingle-sets"), "id").select("key", "kind", "a", "b", "side", "id", "root", "set")
    return stored(together.groupBy("key", "kind", "a", "b").applyInArrow(_close(similarity), "u long, v long"), "closing")


def similar_groups(
    classes: DataFrame, texts: DataFrame, bits: int, words: int, similarity: float, seed: int = 42
) -> DataFrame:
    """(node, root) for the ids that verified links connect.

    The pairs are tested in rounds, the likeliest of each id first: pairs whose ids are
    in one group by then need no test, which keeps large groups of near copies linear.
    """
    open_pairs = stored(candidates(classes, bits), "candidates")
    texts = stored(
        texts.join(open_pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"), "texts"
    )
    found, roots = _linked(open_pairs, texts, words, similarity)
    closing = closing_links(classes, texts, roots, words, similarity, seed)
    return roots if closing is None else components(found.union(closing), "closed")


def _linked(open_pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The verified links of ``open_pairs``, up to those inside a group, and the groups (node, root)."""
    found, roots = None, None
    for most in (1, 4, None):
        if most is None:
            chosen = open_pairs
        else:
            ends = open_pairs.select(F.explode(F.array("u", "v")).alias("id"), "u", "v", "n")
            order = Window.partitionBy("id").orderBy(F.desc("n"), "u", "v")
            picked = ends.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most)
            chosen = stored(picked.select("u", "v").distinct(), "chosen-pairs")
        links_now = _verified(chosen, texts, words, similarity)
        found = links_now if found is None else found.union(links_now)
        roots = components(found, "similar")
        if most is None:
            break
        left = open_pairs.join(chosen, ["u", "v"], "left_anti")
        for side in ("u", "v"):
            left = left.join(roots.toDF(side, f"_{side}"), side, "left")
        left = left.where(F.coalesce("_u", "u") != F.coalesce("_v", "v"))
        open_pairs = stored(left.select("u", "v", "n"), "candidates")
        if open_pairs.isEmpty():
            break
    return found, roots


def representatives(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2, seed: int = 42
) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest doc_id (null last), then text hash.

    Groups are connected by links verified on the texts: Jaccard similarity of the
    sets of ``words``-word shingles at least ``similarity``. Texts of the same words are one class
    (by a 64-bit hash) from the start; all texts without words are one.
    """
    oid, tid = fresh(docs, "_oid"), fresh(docs, "_tid")
    key = {oid: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), tid: F.xxhash64("text")}
    plain = long_texts(docs).select(key[oid].alias("oid"), key[tid].alias("tid"), "text")
    sketched = "oid long, tid long, id long, fp long, rank long, bands array<long>"
    marked = stored(plain.mapInArrow(_sketches(words, seed), sketched), "sketches")
    same = stored(marked.groupBy("id").agg(F.min(F.struct("oid", "tid")).alias("least")).select("id", "least.*"), "same")
    classes = stored(
        marked.join(same, ["id", "oid", "tid"], "left_semi").select("id", "fp", "rank", "bands").dropDuplicates(["id"]),
        "classes",
    )
    texts = plain.join(broadcast_small(same), ["oid", "tid"]).select("id", "text")
    roots = similar_groups(classes, texts, bits, words, similarity, seed)
    rooted = same.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct("oid", "tid")).alias("one")).select("one.*")
    chosen = stored(chosen, "chosen")
    repeated = marked.groupBy("oid", "tid").count().where("count > 1")
    kept = docs.withColumns(key).join(broadcast_small(chosen.toDF(oid, tid)), [oid, tid], "left_semi")
    if not repeated.join(chosen, ["oid", "tid"], "left_semi").isEmpty():
        kept = kept.dropDuplicates([oid, tid])
    return kept.drop(oid, tid)
