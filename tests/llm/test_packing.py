import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import frame, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_by_word_ids_equal_the_tokenizer():
    texts = [t for _, t, *_ in rows() if t] + [
        "It's we'll THE İstanbul ΣΑΣ naïve  nbsp em x<|endoftext|>y 12 3,4 é ﬁ ½ ª º µ ß ÿ × ÷ 'S I'M don't''t",
        "á b ́c zero​width \x1c sep \x85 nel",
    ]
    texts += ["".join(c + e for e in (" ", ". ", "x ", "' ")) for c in map(chr, range(1, 0x250))]
    texts += [f"a{c}b {c}{c} A{c}'s {c}5" for c in map(chr, range(0x20, 0x180))]
    whole = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read(), cache=200)
    for t in texts * 2:
        assert encoder.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:60]


def check(pieces, limits, data):
    """Every id in one piece, sequences gapless, limits kept, nothing padded."""
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        upto = 0
        for r in parts:
            assert r.offset == upto and r.length > 0
            upto += r.length
        assert upto <= limits[0] and len(parts) <= limits[1] and sum(r.loss_tokens for r in parts) <= limits[2]
        assert upto == limits[0] or upto & (upto - 1) == 0
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, *_ in data:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, len(ids), ids))
    assert sum(r.length for r in pieces) == sum(n for _, n, _ in want)
    for doc_id, n, ids in want:
        if sum(d == doc_id for d, *_ in want) > 1:
            continue
        parts = sorted((r for r in pieces if r.doc_id == doc_id), key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert sum(r.length for r in parts) == n == parts[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)


@pytest.mark.parametrize("limits", [(4096, 128, 4096), (512, 3, 512), (512, 64, 100)])
def test_pieces_round_trip(spark, limits):
    check(packing.pack_documents(frame(spark), PATH, limits).collect(), limits, rows())


def test_runs_go_on_from_each_other(spark, monkeypatch):
    packer = packing.Packer((64, 8, 64))
    sizes = np.random.default_rng(1).integers(1, 200, (300, 1)).repeat(2, 1)
    sequences, left = packer.pack(sizes, False)
    assert sum(n for s in sequences for _, _, n in s) + left[:, 0].sum() == sizes[:, 0].sum()
    assert left[:, 0].sum() < 2 * 64 and all(sum(n for *_, n in s) & 63 == 0 for s in sequences if len(s) < 8)


def test_whole_examples(spark):
    turns = spark.createDataFrame(
        [(str(i), i % 90 + 1, i % 40) for i in range(500)] + [("long", 700, 3), (None, None, None)],
        "id string, t int, l int",
    )
    limits = (256, 6, 120)
    got = packing.pack_examples(turns, F.col("id"), F.col("t"), F.col("l"), limits).collect()
    assert sorted(r.example for r in got) == sorted([str(i) for i in range(500)] + ["long"])
    assert [r.example for r in got if r.oversize] == ["long"]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        if not parts[0].oversize:
            assert sum(r.tokens for r in parts) <= 256 and len(parts) <= 6 and sum(r.loss_tokens for r in parts) <= 120


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
