"""Sums of doubles in any order."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from impactspark.functions.exact import exact_mean, exact_mean_sql, exact_sum, exact_sum_sql, merged_sum, partial_sums
from impactspark.operators import groups, impact


def values():
    rng = random.Random(4)
    some = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-4, 9) for _ in range(3000)]
    return some + [-v for v in some[:1500]] + [0.1] * 700 + [1e15, -1e15, 0.0, -0.0, 2.0**-60, None, None]


def test_sum_is_the_exact_one_in_any_order(spark):
    rng = random.Random(1)
    xs = values()
    want = sum(map(Fraction, (x for x in xs if x is not None)))
    seen = set()
    for parts in (1, 2, 8, 31):
        rng.shuffle(xs)
        rows = spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)
        seen.add(tuple(rows.agg(exact_sum("x"), exact_mean("x")).first()))
        halves = rows.groupBy((F.xxhash64("x") % 7).alias("k")).agg(*partial_sums("x", "s"))
        assert halves.agg(merged_sum("s")).first()[0] == next(iter(seen))[0]
    assert len(seen) == 1
    total, mean = seen.pop()
    # digits below 2^-72 are cut off per value, and the result is rounded twice at most
    assert abs(Fraction(total) - want) <= Fraction(len(xs), 1 << 72) + 2 * Fraction(math.ulp(total))
    assert mean == total / (len(xs) - 2)


def test_sql_gives_the_same_bits(spark):
    xs = values()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in xs])
    mine = spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x"), exact_mean("x")).first()
    assert tuple(mine) == con.execute(f"SELECT {exact_sum_sql('x')}, {exact_mean_sql('x')} FROM t").fetchone()


def test_odd_values(spark):
    of = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x")).first()[0]
    assert of() is None and of(None) is None and of(-0.25, None) == -0.25 and of(1e300, 1.0) == 1e300
    assert of(float("inf"), 1.0) == float("inf") and math.isnan(of(float("nan"), 1.0)) and math.isnan(of(float("inf"), float("-inf")))
    assert spark.createDataFrame([(1.5, "a")], "x double, k string").filter("x > 9").groupBy("k").agg(exact_mean("x")).collect() == []


@pytest.mark.parametrize("parts", [2, 8])
def test_group_totals_are_the_same_on_any_cluster(spark, parts):
    rng = random.Random(9)
    rows = [(i, f"s{i % 3}", rng.uniform(-1e5, 1e5), rng.uniform(0, 900), "High" if i % 4 else "Low", f"n{i}") for i in range(4000)]
    rows += [(9000 + i, f"s{3 + i % 2}", x, 1.0, "Low", "n") for i in range(2) for x in ((0.1, 0.2, 0.3) if i else (0.3, 0.2, 0.1))]
    schema = "institution_id long, state string, tuition_change_dollars double, students_affected double, equity_risk_class string, name string"
    frame = spark.createDataFrame(rows, schema).withColumns({"enrollment_change_pct": F.col("students_affected") / 7, "grad_rate_change": F.lit(0.1)})
    one, many = frame.coalesce(1), frame.repartition(parts)
    for of in (impact.equity_table, groups.kpis, lambda d: groups.rank_groups(d, "state", "tuition_change_dollars"), groups.state_lod, lambda d: impact.impact_summary(d, ["state"])):
        assert sorted(map(str, of(one).collect())) == sorted(map(str, of(many).collect()))
    ranks = {r.state: r.impact_rank for r in groups.rank_groups(frame, "state", "tuition_change_dollars").collect()}
    assert ranks["s3"] == ranks["s4"]  # 0.1 + 0.2 + 0.3, whatever the order
