import numpy as np
from cases import frame, rows

from shotline.llm import language


def test_pair_tables_equal_plain_filters():
    rng = np.random.default_rng(2)
    net = language.learn(np.zeros((0, language.WINDOW), np.uint8), np.zeros(0, int), [])
    data = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    want = []
    for f in net.filters:
        places = language.WINDOW - len(f) + 1
        want.append(np.max([sum(f[k][data[:, i + k]] for k in range(len(f))) for i in range(places)], axis=0))
    assert np.allclose(net.peaks(data, net.tables()), np.maximum(np.concatenate(want, 1) + net.bias, 0), atol=1e-5)


def test_held_out_languages(spark):
    rng = np.random.default_rng(6)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["straß", "ung", "der"], "zz": ["ción", "que", "los"]}
    data = []
    for i in range(240):
        lang = sorted(syllables)[i % 3]
        text = " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(rng.integers(5, 400)))
        data.append((i, text, lang if i % 2 else None, "s", None))
    docs = frame(spark, data)
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    hits = [got[i].lang_pred == sorted(syllables)[i % 3] for i in range(0, 240, 2)]
    assert np.mean(hits) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_awkward_rows(spark):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(frame(spark), language.fit(frame(spark))).collect()}
    for doc_id, text, *_ in rows():
        letters = text is not None and any(c.isalpha() for c in text)
        langs = {p for d, p in got if d == doc_id}
        assert letters or "und" in langs
        assert not letters or langs & {"en", "de"}
    empty = frame(spark, [])
    assert language.identify(empty, language.fit(empty)).count() == 0
