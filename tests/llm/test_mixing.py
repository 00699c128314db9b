import math
import random
from fractions import Fraction

import pytest
from cases import frame, rows

from shotline.llm import mixing


def naive(blocks, weights):
    """Slot by slot: of the released blocks the one with the earliest deadline, all in fractions."""
    weight = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
    ends = sorted((blocks[s] / weight[s], s) for s in weight)

    def full(s, k):
        share, time, before, left = k / weight[s], Fraction(0), Fraction(0), sum(weight.values())
        for end, x in ends:
            time += (min(end, share) - before) * left
            before, left = min(end, share), left - weight[x]
        return time

    done, out = dict.fromkeys(weight, 0), []
    for slot in range(sum(blocks.values())):
        open_ = [s for s in weight if done[s] < blocks[s] and math.floor(full(s, done[s])) <= slot]
        best = min(open_, key=lambda s: (math.ceil(full(s, done[s] + 1)), s))
        out.append((best, done[best]))
        done[best] += 1
    return out


@pytest.mark.parametrize("slots", [7, 64, mixing.WINDOW])
def test_schedule_equals_a_naive_earliest_deadline_scheduler(slots):
    rng = random.Random(2)
    cases = [({"a": 40, "b": 40}, {"a": 1, "b": 1}), ({"a": 9}, {"a": 0.3}), ({}, {}), ({"a": 0, "b": 3}, {"a": 2, "b": 1})]
    cases += [({chr(97 + i): 20 for i in range(12)}, {chr(97 + i): (i + 1) ** 2 for i in range(12)})]
    cases += [({f"s{i}": 12 for i in range(20)}, {f"s{i}": 0.1 for i in range(20)})]
    for _ in range(8):
        blocks = {f"s{i}": rng.choice([0, 1, 7, 60, 150]) for i in range(rng.randint(1, 9))}
        cases.append((blocks, {s: rng.choice([rng.random() + 0.01, 1 / 3, 1, 5]) for s in blocks}))
    for blocks, weights in cases:
        assert list(mixing.turns(blocks, weights, slots)) == naive(blocks, weights)


def data(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        out.append((i, "x" * rng.randint(0, 400), None, rng.choice(["hot", "hot", "hot", "b", "c", None]), None))
    return out


def test_schedule_equals_brute_force(spark, monkeypatch):
    """Blocks by running sums, slots by the naive scheduler."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    docs = frame(spark, data() + [data()[5]])
    got = mixing.schedule(docs, {"hot": 1.0, "b": 2.0, "c": 1.0}, block=1_000).collect()
    assert sorted(r.oid for r in got) == list(range(600))
    sizes = {i: len(t) + 1 for i, t, *_ in data()}
    sizes[5] *= 2  # the repeated row
    totals = {}
    by_stream = {}
    for r in got:
        by_stream.setdefault(r.stream, []).append(r)
    assert len(by_stream) == 4
    target = {}
    for s, members in by_stream.items():
        members.sort(key=lambda r: (r.slot, r.place))
        upto = 0
        for r in members:
            assert r.block == upto // 1_000
            upto += sizes[r.oid]
        totals[s] = upto
        target[s] = {"hot": 1.0, "b": 2.0, "c": 1.0}.get(min((r.source for r in members if r.source), default=None), 1.0)
    turns = naive({s: -(-n // 1_000) for s, n in totals.items()}, target)
    slot_of = {turn: slot for slot, turn in enumerate(turns)}
    assert all(r.slot == slot_of[r.stream, r.block] for r in got)
    assert len({(r.slot, r.place) for r in got}) == len(got)


def test_documents_keep_rows_and_columns(spark):
    docs = frame(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.report(docs).count() == len(rows())
    assert mixing.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "weights", [{"a": 0.5, **{f"s{i}": 0.5 / 199 for i in range(199)}}, {"a": 0.5, "b": 0.49999, "c": 0.00001}, {"a": 1 / 3, "b": 0.7, "c": 2}]
)
def test_every_slot_is_within_one_block_of_the_stated_weights(weights):
    """Against exact shares, with no rounding to a period; sources that are used up leave theirs to the rest."""
    rng = random.Random(7)
    blocks = {s: 20_000 if s == "a" else rng.randint(1, 90) for s in weights}
    out = list(mixing.turns(blocks, weights))
    assert sorted(out) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    exact = {s: Fraction(w) for s, w in weights.items()}
    total, fluid, at = sum(blocks.values()), dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    done, left = dict.fromkeys(blocks, 0), set(blocks)
    for slot, (s, _) in enumerate(out[:3_000], 1):
        done[s] += 1
        while at < slot and left:
            rate = sum(exact[x] for x in left)
            step = min(slot - at, *((blocks[x] - fluid[x]) * rate / exact[x] for x in left))
            for x in left:
                fluid[x] += step * exact[x] / rate
            at += step
            left -= {x for x in left if fluid[x] == blocks[x]}
        assert all(abs(done[x] - fluid[x]) < 1 for x in blocks)
    assert len(out) == total


def test_each_of_many_sources_keeps_its_weight(spark):
    """More than 256 sources: a stream each, within one block of its own share."""
    docs = frame(spark, [(i, "x" * 99, None, f"s{i % 300}", None) for i in range(3_000)])
    weights = {f"s{i}": 5.0 if i < 10 else 1.0 for i in range(300)}
    got = mixing.schedule(docs, weights, block=100).collect()
    assert {r.stream for r in got} == {f"ss{i}" for i in range(300)}
    assert sorted(r.slot for r in got) == list(range(3_000))
    total = sum(weights.values())
    for s, w in weights.items():
        mine = sorted(r.slot for r in got if r.source == s)
        for upto in range(1, int(10 * total / 5)):  # until the heavy sources are used up
            assert abs(sum(x < upto for x in mine) - w / total * upto) < 1
