import re

import numpy as np
import pytest
import xxhash
from cases import frame, rows

from shotline.llm import simhash
from shotline.llm.hashing import xxh64


def brute(data, bits=2):
    prints = []
    for _, text, *_ in data:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    least = list(range(len(data)))
    changed = True
    while changed:
        changed = False
        for i in range(len(data)):
            for j in range(len(data)):
                if bin(prints[i] ^ prints[j]).count("1") <= bits and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    out = []
    for i, row in enumerate(data):
        ids = [r[0] for k, r in enumerate(data) if least[k] == least[i] and r[0] is not None]
        out.append((row[0], f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_xxh64_of_every_length():
    data = bytes(np.random.default_rng(1).integers(0, 256, 4000, np.uint8))
    start = np.arange(600)
    end = start + np.arange(600)
    assert xxh64(data, start, end, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(start, end)]


def test_components_equal_brute_force(spark):
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=str) == brute(rows())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("head_rows", [16_384, 3])
def test_links_connect_what_is_near(spark, head_rows):
    """Dense groups, dealt out again when a head holds more than ``head_rows`` fingerprints."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, np.uint64)
    codes = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            codes.add(int(c) ^ sum(1 << int(f) for f in flips))
    fp = np.array(sorted(codes), np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    want = simhash.merged(np.arange(len(fp)), *np.nonzero(near))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(df, 2, head_rows).collect()]
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    a = np.array([place[u] for u, _ in edges])
    b = np.array([place[v] for _, v in edges])
    assert near[a, b].any() and (want[a] == want[b]).all()
    assert np.array_equal(simhash.merged(np.arange(len(fp)), a, b), want)


def copies(groups=60, size=4, hot=150, seed=11):
    """Texts with copies of every similarity, one large group, and the indices of each text's words."""
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(groups + 1):
        base = [f"w{x}" for x in rng.integers(0, 3_000, rng.integers(60, 400))]
        for _ in range(hot if g == groups else size):
            words = list(base)
            for at in rng.choice(len(words), int(len(words) * rng.uniform(0, 0.03)), replace=False):
                words[at] = f"n{rng.integers(0, 10**9)}"
            texts.append(" ".join(words))
    return texts


def jaccard_groups(texts, words=5, similarity=0.8):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
    sets = [set(zip(*(w[i:] for i in range(words)))) if len(w) > words else {tuple(w)} for w in split]
    i, j = np.triu_indices(len(sets), 1)
    keep = []
    for a, b in zip(i, j):
        both = len(sets[a] & sets[b])
        keep.append(both and both >= similarity * (len(sets[a]) + len(sets[b]) - both))
    keep = np.array(keep, bool)
    return i[keep], j[keep], simhash.merged(np.arange(len(sets)), i[keep], j[keep])


def test_representatives_equal_jaccard_join(spark):
    """One row of each group that pairs of five-word Jaccard similarity 0.8 or more connect."""
    texts = copies()
    _, _, want = jaccard_groups(texts)
    docs = frame(spark, [(i, t, None, "s", len(t)) for i, t in enumerate(texts)])
    got = sorted(r.doc_id for r in simhash.representatives(docs).collect())
    assert got == sorted(set(want.tolist()))
    assert len(got) < len(texts) / 2


def test_unlike_texts_are_not_linked(spark):
    """Equal fingerprints or a chain of near ones do not drop a text that is not similar."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([f"x{k}-{i}" if i % 12 == 0 else w for i, w in enumerate(base)]) for k in range(8)]
    assert len(jaccard_groups(texts)[0]) == 0
    docs = frame(spark, [(i, t, None, "s", len(t)) for i, t in enumerate(texts)])
    assert simhash.representatives(docs, bits=8).count() == len(texts)


def test_overlaps_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(n)] for n in (9, 12))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert simhash.overlaps(a, b).tolist() == want


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_a_large_family_just_below_the_threshold_loses_no_link(spark, monkeypatch, block):
    """Boilerplate makes all texts meet in all keys; only the two texts of a pair are similar enough."""
    monkeypatch.setattr(simhash.closing_links, "__defaults__", (block,))
    common = [f"c{i}" for i in range(176)]
    texts = []
    for pair in range(150):
        for k in range(2):
            texts.append(" ".join(common + [f"p{pair}-{i}" for i in range(8)] + [f"t{pair}-{k}-{i}" for i in range(20)]))
    texts += [" ".join(common + [f"e{k}" for k in range(60)] + [f"d{i}"]) for i in range(100)]  # near copies in the same keys
    i, j, want = jaccard_groups(texts)
    assert len(set(want.tolist())) == 151
    docs = frame(spark, [(i, t, None, "s", len(t)) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == sorted(set(want.tolist()))
