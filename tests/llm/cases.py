"""Small documents with every awkward case: nulls, ties, repeats, long texts, clashing column names."""

import random
import zlib

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SYLLABLES = "an the in of er on re st ou ti ed nd and éa ße ñi".split()


def prose(rng, words):
    out = []
    for i in range(words):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out[-1] += "."
    lines, at = [], 0
    while at < len(out):
        step = rng.randint(4, 25)
        lines.append(" ".join(out[at : at + step]))
        at += step
    return "\n".join(lines)


def rows(seed=5, n=40):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 40, 120, 300])) for _ in range(n)]
    base = prose(rng, 200)
    passage = prose(rng, 90).replace("\n", " ")
    for i in range(6):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [base, base, base.upper(), passage, "start " + passage + " end", "x " * 300, passage + "\n" + passage]
    texts += [None, "", " \t\n", None, "word", "a b", " wide space İß 中文 🙂 é", "Тест ΣΑΣ <|endoftext|> it's 42%"]
    texts += [prose(rng, 6000)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base, None, None, None))
    out.append((None, None, "en", "s0", None))
    return out


def frame(spark, data=None, parts=3):
    """The rows with further columns whose names the operators use inside."""
    data = rows() if data is None else data
    df = spark.createDataFrame(data, DOCUMENTS).repartition(parts)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("key", "fp", "line", "score", "path", "stats", "head", "position")})


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def twin(name, folder, **tables):
    """A registered query and its SQL over the given tables (arrow), stored as Parquet in ``folder``; sorted rows of both."""
    import duckdb
    import pyarrow.parquet as pq

    from shotline.llm.queries import SQL

    con = duckdb.connect()
    for table, data in tables.items():
        pq.write_table(data, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    return columns, sorted(result.fetchall(), key=str)
