import random

import numpy as np
from cases import frame, prose, rows

from shotline.llm import lines


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(data):
    every = set()
    for doc_id, text, *_ in data:
        key = ((1, 0) if doc_id is None else (0, doc_id), text or "")
        for number, line in enumerate((text or "").encode().split(b"\n")):
            if line.split():
                every.add((key[0], text, number, tuple(line.split())))
    every = sorted(every, key=lambda r: (r[0], r[2]))
    out = []
    for doc_id, text, *_ in data:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        kept, gone = [], 0
        split = text.split("\n")
        own = (1, 0) if doc_id is None else (0, doc_id)
        for number, line in enumerate(split):
            words = tuple(line.encode().split())
            hit = False
            for other, _, place, seen in every if words else ():
                if (other, place) >= (own, number):
                    break
                if seen == words or min(len(seen), len(words)) >= lines.SHORT and distance_at_most_one(list(seen), list(words)):
                    hit = True
            gone += hit
            if not hit:
                kept.append(line)
        out.append((doc_id, len(split), gone, "\n".join(kept)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    base = [prose(rng, n).replace("\n", " ") for n in (9, 10, 11, 12, 20, 33, 34)]
    data = rows(n=12)
    data = [r for r in data if r[0] is not None and len(r[1] or "") < 5000]
    for i in range(60):
        made = []
        for line in rng.sample(base, 3):
            w = line.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w[at] = "new" + str(rng.randrange(4))
                elif kind == 1:
                    w.insert(at, "in" + str(rng.randrange(4)))
                else:
                    del w[at]
            made.append("  ".join(w) if rng.random() < 0.1 else " ".join(w))
        data.append((200 + i, "\n".join(made), None, None, None))
    return data + [(None, base[4] + "\nonly here", None, None, None), data[0]]


def test_equals_brute_force(spark):
    data = cases()
    got = [tuple(r) for r in lines.report(frame(spark, data)).collect()]
    assert sorted(got, key=str) == brute(data)


def test_half_hashes_meet_for_every_edit():
    """A line and any line within one word share a half hash, the neighbourhoods an entry."""
    for n in range(lines.SHORT, 25):
        words = [f"w{i}".encode() for i in range(n)]
        for i in range(n + 1):
            for other in (words[:i] + [b"x"] + words[i + 1 :], words[:i] + [b"x"] + words[i:], words[:i] + words[i + 1 :]):
                if len(other) < lines.SHORT:
                    continue
                runs = lines.Runs(words + other)
                keys = []
                for a, size in ((0, n), (n, len(other))):
                    b, m = a + size, size // 2
                    cuts = ((a, a + m, lines.LEFT), (a, a + m - 1, lines.LEFT), (a + m, b, lines.RIGHT), (a + m + 1, b, lines.RIGHT))
                    keys.append({int(runs.whole(0, np.array([x]), np.array([y]), t)[0]) for x, y, t in cuts})
                assert keys[0] & keys[1]


def test_columns_stay_and_empty_table(spark):
    docs = frame(spark)
    out = lines.deduplicated_documents(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    assert lines.report(frame(spark, [])).count() == 0
