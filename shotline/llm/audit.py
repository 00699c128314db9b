"""How filters overlap: what each of five filters removes at each place of every order.

Filters (a document fails one when its condition holds; words are maximal runs of
bytes other than space and 0x09-0x0D):

A  under 200 words                      D  holds any of ``#$%&*|``
B  distinct words under half the words  E  the text of a smaller doc_id is identical
C  A-Z above 3 % of the characters

A to D look at one text. E is an existential self-join: left semi on the text's hash, the
exact text and a smaller doc_id. Only texts whose hash two ids share are moved for it; the other
side holds each of them once, under its smallest id, so a group of N copies makes N rows and not
N * N, and a large group is dealt over as many tasks as it has runs of ``COPIES`` rows.
The marks of E are united with the other failures by id; the bit combinations are
counted per part, at most 32 of them, and all 120 orders are read off these counts.

Nulls and edge cases: a null text counts as empty (it fails A only, and E when a smaller id is
empty too); a null ``lang`` is the part ''; a row without doc_id has no smaller or larger id and
never fails E, it is counted in its part; repeated rows are each counted and are not copies
of each other; of several labels of an id any 1 counts, null labels do not; an empty table has no
part and no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.llm.common import long_texts, stored, text_bytes

FILTERS = "ABCDE"
MARKS = b"#$%&*|"
COPIES = 2_000  # rows of one text that meet in one task
ORDERS = ["".join(p) for p in permutations(FILTERS)]
EACH = len(ORDERS)


def text_bits(text: bytes | None) -> int:
    """Bits 0 to 3 for the failures A to D."""
    text = text or b""
    words = text.split()
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(at[0x80:0xC0].sum())
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * int(at[65:91].sum()) > 3 * points) << 2
        | (int(at[list(MARKS)].sum()) > 0) << 3
    )


@F.arrow_udf(T.IntegerType())
def failures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bits of each text."""
    for column in batches:
        yield pa.array([text_bits(t) for t in text_bytes(column)], pa.int32())


def repeated(docs: DataFrame, copies: int = COPIES) -> DataFrame:
    """The rows (doc_id, h, lang) whose text a smaller doc_id has as well; ``docs`` (doc_id, text, lang, h)."""
    shared = stored(
        docs.where("doc_id is not null")
        .groupBy("h")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low < high")
        .select("h", (F.col("n") / copies).cast("int").alias("more")),
        "audit-shared",
    )
    texts = docs.where("doc_id is not null").join(shared, "h")
    first = texts.groupBy("h", "text").agg(F.min("doc_id").alias("smaller"), F.max("more").alias("more"))
    first = first.withColumn("deal", F.explode(F.sequence(F.lit(0), "more"))).select(
        F.col("h").alias("h2"), F.col("text").alias("text2"), "deal", "smaller"
    )
    left = texts.withColumn("deal", F.pmod(F.xxhash64("doc_id", "lang"), F.col("more") + 1).cast("int"))
    same = (
        (F.col("l.h") == F.col("r.h2"))
        & (F.col("l.deal") == F.col("r.deal"))
        & (F.col("l.text") == F.col("r.text2"))
        & (F.col("r.smaller") < F.col("l.doc_id"))
    )
    return left.alias("l").join(first.alias("r"), same, "left_semi").select("doc_id", "h", "lang")


def combinations(docs: DataFrame, labels: DataFrame, copies: int = COPIES) -> DataFrame:
    """(part, bits, n, good, toxic): documents per part and combination of failed filters."""
    rows = long_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    own = rows.select("doc_id", "h", "lang", failures("text").alias("bits"), F.lit(1).cast("long").alias("n"))
    again = repeated(rows, copies).select("doc_id", "h", "lang", F.lit(16).alias("bits"), F.lit(0).cast("long").alias("n"))
    each = own.unionByName(again).groupBy("doc_id", "h", "lang").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = each.join(marks, "doc_id", "left")
    count = lambda mark: F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0))
    return known.groupBy(F.col("lang").alias("part"), "bits").agg(
        F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame, copies: int = COPIES) -> DataFrame:
    """part, filter_order, step and the counts of the step's filter at that place."""
    found = F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("found")
    parts = combinations(docs, labels, copies).groupBy("part").agg(found)
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda i: F.instr("filter_order", FILTERS[i])
    bits = lambda holds: sum((F.when(holds(place(i)), 1 << i).otherwise(0) for i in range(len(FILTERS))), F.lit(0))
    steps = steps.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})

    def total(holds, value="n", weight=lambda x: F.lit(1).cast("long")):
        rows = F.filter("found", lambda x: holds(x["bits"]))
        return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x[value] * weight(x["bits"]))

    fails = lambda x: x.bitwiseAND(F.col("own")) != 0
    here = lambda x: fails(x) & (x.bitwiseAND(F.col("before")) == 0)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: x.bitwiseAND(F.col("own") + F.col("before")) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: fails(x) & (x.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(lambda x: x == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        # of all orders, the filters a document fails are each first equally often
        total(fails, "n", lambda x: (F.lit(EACH) / F.bit_count(x)).cast("long")).alias("shapley"),
    )
