"""Exact quantiles without gathering a column in one task.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer. Here each value is cut into three ordered digits (its
exponent and leading mantissa bits, then the middle and the last bits) and the
wanted ranks are found digit by digit: count values per digit, add the counts
up, keep the digit that holds the rank, and look one digit deeper inside it.

Each pass is a hash aggregate with map-side combine whose result has at most a
few million rows per group however long the table is, and a value repeated in
a third of all rows is a single counter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_BITS, MIDDLE_BITS, LAST_BITS = 9, 21, 22  # 52 mantissa bits in all
EXPONENT_SHIFT = 1100  # lifts every double exponent above zero
GROUP_BROADCAST_ROWS = 20_000
SORTED_ROWS = 200_000  # most rows sorted together instead of looking deeper


def few_groups(df: DataFrame, by: Sequence[str], limit: int = GROUP_BROADCAST_ROWS) -> bool:
    """Whether the grouping has at most `limit` groups (reads the keys only)."""
    return df.select(*by).distinct().limit(limit + 1).count() <= limit


def _digits(v: Column) -> list[Column]:
    """Three whole numbers whose lexicographic order is the order of `v`."""
    size = F.abs(v)
    # log2 of zero is NULL; an infinity ends above every finite value
    exponent = F.floor(F.least(F.log2(size), F.lit(1024.0)))
    scaled = (size / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * (1 << TOP_BITS)
    top = F.floor(scaled)
    rest = (scaled - top) * (1 << MIDDLE_BITS)
    middle = F.floor(rest)
    last = F.floor((rest - middle) * (1 << LAST_BITS))
    sign = F.signum(v).cast("long")
    lead = (exponent + EXPONENT_SHIFT) * (1 << TOP_BITS) + top + 1
    return [F.coalesce(d * sign, F.lit(0)) for d in (lead, middle, last)]


def _narrow(counts: DataFrame, group: list[str], digit: str) -> DataFrame:
    """Keep the digits that hold a wanted rank, with the rank counted inside."""
    running = Window.partitionBy(*group).orderBy(digit).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = F.col("_upto") - F.col("_n")
    return (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .withColumn(
            "_inside",
            F.transform(
                F.filter(
                    "_want",
                    lambda w: (w["rest"] >= before) & (w["rest"] < F.col("_upto")),
                ),
                lambda w: F.struct(w["rank"].alias("rank"), (w["rest"] - before).alias("rest")),
            ),
        )
        .filter(F.size("_inside") > 0)
    )


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per known value: its column number, itself, its first digit."""
    named = F.array(*[F.col(c).cast("double") for c in columns])
    cells = df.select(*by, F.posexplode(named).alias("_c", "_v"))
    cells = cells.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    for key in by:
        cells = cells.filter(F.col(key).isNotNull())
    return cells.withColumn("_d1", _digits(F.col("_v"))[0])


def _positions(probs: Sequence[float]) -> list[Column]:
    return [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]


def _first_level(cells: DataFrame, group: list[str], probs: Sequence[float]) -> DataFrame:
    """The first digits that hold a wanted rank."""
    ranks = F.array_distinct(
        F.array(*[f(x).cast("long") for x in _positions(probs) for f in (F.floor, F.ceil)])
    )
    counts = (
        cells.groupBy(*group, "_d1").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
        .withColumn("_want", F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("rest"))))
    )
    return _narrow(counts, group, "_d1")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    small_groups: bool | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of each column, per group of `by`.

    Returns `by..., column, n, q` where `q` lists the quantiles in the order of
    `probs`. Rows with a NULL group key or value are left out; a column
    without values has no row.
    """
    by = list(by)
    if small_groups is None:
        small_groups = not by or few_groups(df, by)
    cells = _cells(df, columns, by)
    d2, d3 = _digits(F.col("_v"))[1:]
    group = [*by, "_c"]
    level = _first_level(cells, group, probs).select(
        *group, "_d1", "_total", F.col("_inside").alias("_want")
    )
    for kept, digit, value in ((["_d1"], "_d2", d2), (["_d1", "_d2"], "_d3", d3)):
        inside = [*group, *kept]
        # without `by` this side has at most two rows per column and quantile
        side = F.broadcast(level) if small_groups else level
        counts = (
            cells.join(side, inside)
            .withColumn(digit, value)
            .groupBy(*inside, "_total", "_want", digit)
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_value"))
        )
        level = _narrow(counts, inside, digit).select(
            *inside, digit, "_total", F.col("_inside").alias("_want"), *(["_value"] if digit == "_d3" else [])
        )
        cells = cells.withColumn("_d2", d2)
    found = (
        level.select(*group, "_total", "_value", F.explode("_want").alias("_w"))
        .groupBy(*group, "_total")
        # at most two entries per quantile
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("_w.rank"), F.col("_value")))).alias("_at"))
    )
    position = _positions(probs)
    at = [
        (F.element_at("_at", F.floor(x).cast("long")), F.element_at("_at", F.ceil(x).cast("long")), x)
        for x in position
    ]
    values = [F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (x - F.floor(x))) for lo, hi, x in at]
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(
        *by,
        F.element_at(names, F.col("_c") + 1).alias("column"),
        F.col("_total").alias("n"),
        F.array(*values).alias("q"),
    )


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """The quantiles of whole columns as plain numbers; None without values.

    Runs the passes at once. When the digits found by the first pass hold few
    rows (counted, not guessed), one sorted pass over just those rows ends the
    search; otherwise it goes on digit by digit.
    """
    spark = df.sparkSession
    cells = _cells(df, columns, ())
    first = _first_level(cells, ["_c"], probs)
    # at most two rows per column and quantile
    hits = first.select("_c", "_d1", "_n", "_total", "_inside").collect()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not hits:
        return out
    if max(h["_n"] for h in hits) > SORTED_ROWS:
        found = exact_quantiles(df, columns, probs).collect()
        return out | {r["column"]: list(r["q"]) for r in found}
    wanted = [
        (h["_c"], h["_d1"], r["rest"] + 1, r["rank"]) for h in hits for r in h["_inside"]
    ]
    places = spark.createDataFrame(wanted, "_c int, _d1 long, _place int, _rank long")
    order = Window.partitionBy("_c", "_d1").orderBy("_v")
    inside = cells.join(F.broadcast(places.select("_c", "_d1").distinct()), ["_c", "_d1"])
    ranked = inside.select("_c", "_d1", "_v", F.row_number().over(order).alias("_place"))
    at = {
        (r["_c"], r["_rank"]): r["_v"]
        for r in ranked.join(F.broadcast(places), ["_c", "_d1", "_place"]).collect()
    }
    for h in hits:
        values = []
        for p in probs:
            x = p * (h["_total"] - 1)
            low, high = at.get((h["_c"], math.floor(x))), at.get((h["_c"], math.ceil(x)))
            values.append(low if low == high else low + (high - low) * (x - math.floor(x)))
        out[columns[h["_c"]]] = values
    return out


def group_quantiles(
    df: DataFrame, columns: Sequence[str], prob: float, by: Sequence[str], small_groups: bool
) -> DataFrame:
    """One row per group with one `column` -> quantile column each."""
    table = exact_quantiles(df, columns, [prob], by, small_groups)
    picks = [F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in columns]
    return table.groupBy(*by).agg(*picks)


def with_rank(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Rank by `value`, largest first, ties sharing a place, NULLs last.

    Counts the rows above each distinct value digit by digit, so no window
    holds more than the values that share their leading digits; equal values
    are one counter however many rows have them.
    """
    rows = df.withColumn("_v", value.cast("double") + 0.0)
    d1, d2, _ = _digits(F.col("_v"))
    counts = (
        rows.filter(F.col("_v").isNotNull())
        .groupBy("_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_d1": d1, "_d2": d2})
    )

    def above(parts: DataFrame, inside: list[str], key: str, alias: str) -> DataFrame:
        larger = Window.partitionBy(*inside) if inside else Window.partitionBy()
        larger = larger.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
        return parts.withColumn(alias, F.coalesce(F.sum("_n").over(larger), F.lit(0)))

    # one row per leading digit: a few million at most
    tops = above(counts.groupBy("_d1").agg(F.sum("_n").alias("_n")), [], "_d1", "_a1")
    middles = above(counts.groupBy("_d1", "_d2").agg(F.sum("_n").alias("_n")), ["_d1"], "_d2", "_a2")
    values = above(counts, ["_d1", "_d2"], "_v", "_a3")
    places = (
        values.join(tops.select("_d1", "_a1"), "_d1")
        .join(middles.select("_d1", "_d2", "_a2"), ["_d1", "_d2"])
        .select("_v", (F.col("_a1") + F.col("_a2") + F.col("_a3") + 1).alias(name))
    )
    known = F.coalesce(counts.agg(F.sum("_n")).scalar(), F.lit(0))
    return (
        rows.join(places, "_v", "left")
        .withColumn(name, F.coalesce(F.col(name), known + 1))
        .drop("_v")
    )
