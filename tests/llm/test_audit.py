import random
import re
from itertools import permutations

import pytest
from cases import frame, prose, rows, twin

from shotline.llm import audit
from shotline.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, extra string"


def data():
    rng = random.Random(3)
    base = prose(rng, 260)
    out = rows()
    for i in range(60):
        words = base.split(" ")[: rng.choice([150, 199, 200, 230])]
        if rng.random() < 0.4:
            words = words[:20] * 12
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|@"))
        out.append((1000 + i, " ".join(words), rng.choice(["en", "fr", "", None]), "s", None))
    out += [(2000 + i, base, rng.choice(["en", "de"]), "s", None) for i in range(30)]
    return out


def labels():
    rng = random.Random(4)
    out = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for d, *_ in data() if d is not None and rng.random() < 0.7]
    return out + [(None, 1, 1, "x"), (2001, 0, 0, "x"), (2001, 1, 1, "x"), (99999, 1, 1, "x")]


def brute(docs, marks):
    texts = [(d, t or "", lang or "") for d, t, lang, *_ in docs]
    good, toxic = ({d for d, q, t, _ in marks if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    failed = []
    for d, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(e is not None and e < d and u == t for e, u, _ in texts),
        }
        failed.append((part, d, {k for k, v in f.items() if v}))
    out = {}
    for part in {p for p, *_ in failed}:
        mine = [(d, f) for p, d, f in failed if p == part]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d, f in mine if name in f and not f & before]
                out[part, "".join(order), step] = [
                    sum(not f & (before | {name}) for _, f in mine),
                    len(here),
                    sum(name in f and bool(f & before) for _, f in mine),
                    sum(f == {name} for _, f in mine),
                    sum(d in good for d in here),
                    sum(d in toxic for d in here),
                ]
        for name in "ABCDE":
            places = [(part, "".join(o), o.index(name) + 1) for o in permutations("ABCDE")]
            value = sum(out[p][1] for p in places)
            for p in places:
                out[p].append(value)
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("copies", [audit.COPIES, 5])
def test_equals_brute_force(spark, copies):
    got = audit.audit(frame(spark, data()), spark.createDataFrame(labels(), LABELS), copies)
    assert sorted(tuple(r) for r in got.collect()) == brute(data(), labels())


def test_query_equals_sql(spark, tmp_path):
    docs, marks = frame(spark, data()), spark.createDataFrame(labels(), LABELS)
    columns, want = twin("op12_filter_audit", tmp_path, documents=docs.toArrow(), labels=marks.toArrow())
    got = QUERIES["op12_filter_audit"](spark, str(tmp_path))
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_different_texts_of_one_hash_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a", "", 5), (2, "b", "", 5), (3, "a", "", 5), (3, "a", "", 5)], "doc_id long, text string, lang string, h long")
    assert [r.doc_id for r in audit.repeated(docs).collect()] == [3, 3]


def test_empty_tables(spark):
    docs, marks = frame(spark, []), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, marks).count() == 0
    assert audit.audit(frame(spark), marks).where("good_lost + toxic_lost > 0").count() == 0
