"""Stratified bootstrap over prediction cells.

Resampling a class with replacement only changes how often each distinct
prediction tuple of that class occurs. Predictions are therefore counted into
cells first; what is drawn and joined afterwards does not grow with the items
but with the cells. All classifiers share the draws (paired design), because a
cell holds the answers of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions.digests import leading_numbers
from shotline.operators import draws
from shotline.operators.scan import running
from shotline.session import lookup, materialize

SLOTS = 65_536  # hashed draws made by one task row
BELOW = 8  # levels of the tree below a task: 256 cells
BLOCK = 250  # iterations drawn together
DRAWN = 1 << 19  # draws held at once
HASHES = 1 << 25  # hashed draws of one task of ``hash_cells``, or one iteration
CLASS_CELLS, CLASS_ITEMS = 65_536, 1 << 24  # a larger class is drawn by joins
TASKS = 1_000  # partitions that draws are dealt over, at most


def joint_cells(predictions: DataFrame, series: list[str]) -> DataFrame:
    """Cells (y_true, cell, answers, n): the answers of all series, as text and as an array.

    Items with the same true label and the same answers are one cell. Items are told apart by sums of
    hashes of their answers (128 bits), which need no lists; one item of each kind is then read for its answers.
    """
    hashes = [F.xxhash64(F.lit(i), *series, "y_pred") for i in range(2)]
    halves = [half for h in hashes for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    marks = [f"_h{i}" for i in range(len(halves))]
    items = predictions.groupBy("item_id", "y_true").agg(*[F.sum(half).alias(m) for half, m in zip(halves, marks)])
    kinds = items.groupBy("y_true", *marks).agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    kinds = lookup(kinds.select(F.col("item_id").alias("_i"), F.col("y_true").alias("_y"), "n"))
    same = F.col("item_id").eqNullSafe(F.col("_i")) & F.col("y_true").eqNullSafe(F.col("_y"))
    answer = F.struct(F.concat_ws("|", *series).alias("series"), F.col("y_pred"))
    shown = predictions.join(kinds, same).groupBy("item_id", "y_true", "n").agg(F.array_sort(F.collect_list(answer)).alias("answers"))
    text = F.array_join(F.transform("answers", lambda a: F.concat(a["series"], F.lit("="), a["y_pred"])), ",")
    return shown.groupBy("y_true", text.alias("cell")).agg(F.first("answers").alias("answers"), F.sum("n").alias("n"))


def placed_cells(cells: DataFrame) -> DataFrame:
    """Cells with ``upto``: the items of their class up to them, in the order of md5(cell).

    Hash prefixes cut a class into even chunks, so a class is never one task.
    """
    return running(
        cells.withColumn("_h", F.md5("cell")), ["y_true"], ["_h", "cell"], F.substring("_h", 1, 2), sums={"upto": F.col("n")}
    ).drop("_h")


def hash_draws(cells: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Reproducible draws, one hash per slot: (iteration, y_true, cell, times).

    Slot i of a class draws a position below its size; positions number the items
    of the class in cell order. Slots are generated in bounded runs and found
    again by an equi-join on (class, position), so a large class is spread over
    many tasks. The work is iterations times items, and so are the rows of the join; ``hash_cells``
    counts the same draws inside tasks, ``tree_cells`` draws cells instead of items.
    """
    groups = cells.groupBy("y_true").agg(F.sum("n").alias("n_class"))
    runs = groups.select(
        "y_true",
        "n_class",
        F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"),
    ).select(
        "*",
        F.explode(
            F.sequence(F.lit(0), F.floor((F.col("n_class") - 1) / SLOTS).cast("int"))
        ).alias("run"),
    )
    spread = runs.repartition("iteration", "y_true", "run")
    first = F.col("run").cast("bigint") * SLOTS
    last = F.least(first + SLOTS, F.col("n_class")) - 1
    slots = spread.select(
        "iteration", "y_true", "n_class", F.explode(F.sequence(first, last)).alias("slot")
    )
    text = F.md5(F.concat_ws("~", F.lit(str(seed)), "iteration", "y_true", "slot"))
    number = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")
    drawn = slots.select("iteration", "y_true", (number % F.col("n_class")).alias("position"))
    ranges = placed_cells(cells.select("y_true", "cell", "n")).select(
        "y_true",
        "cell",
        F.explode(F.sequence(F.floor((F.col("upto") - F.col("n")) / SLOTS), F.floor((F.col("upto") - 1) / SLOTS))).alias("run"),
        (F.col("upto") - F.col("n")).alias("first"),
        F.col("upto").alias("end"),
    )
    bounded = ranges.select(
        "y_true",
        "cell",
        F.greatest("first", F.col("run") * SLOTS).alias("first"),
        F.least("end", (F.col("run") + 1) * SLOTS).alias("end"),
    )
    positions = bounded.select(
        "y_true", "cell", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("position")
    )
    return (
        drawn.join(positions, ["y_true", "position"])
        .groupBy("iteration", "y_true", "cell")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def hash_cells(cells: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Confusion cells of the resamples of ``hash_draws``: (iteration, series, y_true, y_pred, n).

    A task holds one class's cells and some iterations: it hashes the slots in numpy, finds the cell of
    every drawn position and adds up by answer, so nothing that grows with the draws is
    shuffled. Classes of more cells or items than a task may hold go through ``hash_draws``.
    """
    cells = cells.where("y_true IS NOT NULL")
    coded, codes = _coded(cells)
    sizes = cells.groupBy("y_true").agg(F.sum("n").alias("n_class"), F.count(F.lit(1)).alias("n_cells"))
    sizes = materialize(sizes.withColumn("held", (F.col("n_cells") <= CLASS_CELLS) & (F.col("n_class") <= CLASS_ITEMS)))
    counts = sizes.agg(F.sum(F.when(F.col("held"), F.col("n_class"))).alias("held"), F.count_if(~F.col("held")).alias("large")).first()
    held = lookup(sizes.where("held").select("y_true", "n_class"))
    placed = placed_cells(cells.select("y_true", "cell", "n").join(held.select("y_true"), "y_true", "left_semi"))
    step = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(HASHES) / F.col("n_class")))).cast("int")
    tasks = (
        placed.join(coded, ["y_true", "cell"], "left")
        .join(held, "y_true")
        .select("y_true", "n_class", "n", "upto", "codes", step.alias("step"))
        .withColumn("first", F.explode(F.expr(f"sequence(0, {iterations - 1}, step)")))
    )

    def draw(task: pa.Table) -> pa.Table:
        row = task.select(["y_true", "n_class", "step", "first"]).slice(0, 1).to_pylist()[0]
        codes_of = task.column("codes").combine_chunks().fill_null([])
        width = np.diff(codes_of.offsets.to_numpy())
        names, where = np.unique(codes_of.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(width)), width)
        ends, n = task.column("upto").to_numpy(), task.column("n").to_numpy()
        order = np.argsort(ends)
        cell_at = np.repeat(order.astype(np.uint16), n[order])
        found = []
        n_class, n_cells, stop = row["n_class"], len(n), min(row["first"] + row["step"], iterations)
        together = max(1, DRAWN // max(min(n_class, SLOTS), n_cells))
        for start in range(row["first"], stop, together):
            rounds = range(start, min(start + together, stop))
            times = np.zeros(len(rounds) * n_cells, dtype=np.int64)
            base = np.arange(len(rounds))[:, None] * n_cells
            for at in range(0, n_class, SLOTS):
                number = leading_numbers(f"{seed}~", rounds, f"~{row['y_true']}~", at, min(at + SLOTS, n_class))
                drawn = cell_at[number % np.uint32(n_class)] + base
                times += np.bincount(drawn.ravel(), minlength=len(times))
            for iteration, each in zip(rounds, times.reshape(-1, n_cells)):
                total = np.bincount(where, each[owner], len(names)).astype(np.int64)  # whole numbers below 2**53: exact
                column = np.nonzero(total)[0]
                found.append((np.full(len(column), iteration, dtype=np.int32), names[column], total[column]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table(dict(zip(("iteration", "code", "n"), columns)))

    n_tasks = (counts["held"] or 0) * iterations // HASHES + held.count() * (iterations // BLOCK + 1)
    dealt = tasks.repartition(max(1, min(TASKS, n_tasks)), "y_true", "first").groupBy("y_true", "first")
    out = _named(dealt.applyInArrow(draw, "iteration int, code bigint, n bigint"), codes)
    if counts["large"]:
        large = cells.join(lookup(sizes.where("NOT held").select("y_true")), "y_true", "left_semi")
        out = out.unionByName(resampled_cells(hash_draws(large, iterations, seed), large))
    return out


def tree_cells(cells: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Confusion cells of resamples drawn through a tree: (iteration, series, y_true, y_pred, n).

    The cells of a class are numbered in the order of md5(cell) and drawn as in ``draws``. A
    task holds 2**BELOW cells, the splits above them (one a level) and BLOCK iterations, never a
    whole class; it adds up its draws by answer before anything is shuffled. The work follows
    cells times iterations; items are only counted, beforehand.
    """
    coded, codes = _coded(cells)
    numbered = running(
        cells.select("y_true", "cell", "n").withColumn("_h", F.md5("cell")),
        ["y_true"],
        ["_h", "cell"],
        F.substring("_h", 1, 2),
        sums={"upto": F.lit(1)},
    )
    place = F.col("upto") - 1
    numbered = materialize(
        numbered.select("y_true", "cell", "n", place.alias("place"), F.shiftright(place, BELOW).alias("part"))
    )
    parts = numbered.groupBy("y_true", "part").agg(F.sum("n").alias("w"))
    top = max(1, int(parts.agg(F.max("part")).first()[0] or 0).bit_length())
    level = F.explode(F.sequence(F.lit(1), F.lit(top))).alias("level")
    half = F.expr("shiftright(part, level - 1)")
    splits = (
        parts.select("y_true", "part", "w", level)
        .groupBy("y_true", "level", F.expr("shiftright(part, level)").alias("node"))
        .agg(
            F.sum(F.when(half % 2 == 0, F.col("w")).otherwise(0)).alias("a"),
            F.sum(F.when(half % 2 == 1, F.col("w")).otherwise(0)).alias("b"),
        )
    )
    paths = (
        parts.select("y_true", "part", level)
        .withColumn("node", F.expr("shiftright(part, level)"))
        .join(lookup(splits), ["y_true", "level", "node"])
        .groupBy("y_true", "part")
        .agg(F.collect_list(F.struct("level", "a", "b")).alias("path"))
    )
    inside = (
        numbered.join(coded, ["y_true", "cell"])
        .groupBy("y_true", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "n", "codes"))).alias("members"))
    )
    block = F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // BLOCK))).alias("block")
    tasks = inside.join(paths, ["y_true", "part"]).select("y_true", "part", "members", "path", block)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rounds = np.arange(row.block * BLOCK, min((row.block + 1) * BLOCK, iterations))
                path = [(s["level"], s["a"], s["b"]) for s in row.path]
                drawn = draws.descend(path, row.part, BELOW, rounds, seed, row.y_true)
                first = row.part << BELOW
                weights = np.zeros(1 << BELOW)
                weights[[c["place"] - first for c in row.members]] = [c["n"] for c in row.members]
                times = draws.subtree(weights, drawn, rounds, seed, row.y_true, first, BELOW)
                names, where = np.unique(np.concatenate([c["codes"] for c in row.members]), return_inverse=True)
                owner = np.repeat([c["place"] - first for c in row.members], [len(c["codes"]) for c in row.members])
                holds = np.zeros((1 << BELOW, len(names)))
                np.add.at(holds, (owner, where), 1)
                n = (times @ holds).astype(np.int64)  # whole numbers below 2**53: exact
                at, column = np.nonzero(n)
                yield pd.DataFrame({"iteration": rounds[at], "code": names[column], "n": n[at, column]})

    # a stated number: left to sizes, many draws of few bytes would be put into one task
    n_tasks = parts.count() * ((iterations - 1) // BLOCK + 1)
    spread = tasks.repartition(max(1, min(TASKS, n_tasks)), "y_true", "part", "block")
    counted = spread.mapInPandas(draw, "iteration int, code bigint, n bigint")
    return _named(counted.groupBy("iteration", "code").agg(F.sum("n").alias("n")), codes)


def _coded(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(y_true, cell, codes) and the stored codes (series, y_true, y_pred, code) of the answers."""
    given = cells.select("y_true", "cell", F.inline("answers"))
    names = given.select("y_true", "series", "y_pred").distinct()
    codes = materialize(names.withColumn("code", F.monotonically_increasing_id()))
    coded = given.join(codes, ["y_true", "series", "y_pred"]).groupBy("y_true", "cell")
    return coded.agg(F.collect_list("code").alias("codes")), codes


def _named(counted: DataFrame, codes: DataFrame) -> DataFrame:
    return counted.join(lookup(codes), "code").select("iteration", "series", "y_true", "y_pred", "n")


def resampled_cells(draws_of: DataFrame, cells: DataFrame) -> DataFrame:
    """Confusion cells of every series in every iteration: (iteration, series, y_true, y_pred, n).

    The rows that grow with iterations times cells times series carry two numbers
    as their key, an iteration and a code; the few codes get their names back last.
    """
    coded, codes = _coded(cells)
    counted = (
        draws_of.join(coded, ["y_true", "cell"])
        .select("iteration", "times", F.explode("codes").alias("code"))
        .groupBy("iteration", "code")
        .agg(F.sum("times").alias("n"))
    )
    return _named(counted, codes)


def iteration_scores(cells: DataFrame) -> DataFrame:
    """Accuracy and macro F1 (over the true labels) per iteration and series."""
    from shotline.operators.metrics import accuracy, macro_scores

    by = ["iteration", "series"]
    acc = accuracy(cells, by).select(*by, "accuracy")
    f1 = macro_scores(cells, by, labels="true").select(*by, "f1")
    return acc.join(f1, by).unpivot(by, ["accuracy", "f1"], "metric", "value")


def interval(values: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean and percentile interval over the iterations (a bounded number per group)."""
    low = (1 - confidence) / 2
    bounds = F.percentile("value", F.array(F.lit(low), F.lit(1 - low)))
    return (
        values.groupBy(*by)
        .agg(F.avg("value").alias("mean"), bounds.alias("b"))
        .select(
            *by,
            "mean",
            F.col("b")[0].alias("ci_lower"),
            F.col("b")[1].alias("ci_upper"),
            (F.col("b")[1] - F.col("b")[0]).alias("ci_width"),
        )
    )


def basic_interval(point: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Reflected interval: twice the point value minus the percentile bounds."""
    return 2 * point - upper, 2 * point - lower
