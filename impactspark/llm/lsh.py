"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian (2-stable) directions, shifted and cut
into cells; the cells of a table's directions name a bucket. On unit vectors
the nearest by distance is the one of largest cosine. A query visits buckets in
the order of estimated success: where it lies in its cells and how far its
neighbours are expected tell how likely a neighbour is in each perturbed
bucket, and it stops when the buckets visited hold one with the wanted
probability. What the tables find is merged and ranked by the exact cosine.

A query is done when it has found k others within the distance that was planned
for. One that has not, since it lies apart from the rest or the rest is closer
together than it is to them, goes through wider cells, if such queries are very
many, and in the end against all rows in blocks.

Equal vectors are one entry with their smallest ids; a bucket with very many
entries or visitors is dealt over several groups, each entry meeting each
visitor once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactspark.llm.common import ship, stored

TABLES = 3
FOUND_PER_TABLE = 0.65  # so that three tables miss 4 in 100
SAMPLE_ROWS, SAMPLE_QUERIES = 4_000, 200  # what the plan is fitted on, at most
FAR_NEIGHBOUR = 0.9  # quantile of the sample's k-th distances that is planned for
REACH = 4  # cells to each side that a probe may lie from the query's
LEAST_LIKELY = 1e-6  # buckets less likely than this are not listed
GROUP_ROWS = 4_096
WIDER = 1.6  # times the distance, for queries that are not done
BLOCK_PAIRS = 10**10  # up to so many pairs, such queries meet all rows at once
SEED = 11


@dataclass(frozen=True)
class Plan:
    """Directions per table, cell width, and the distance neighbours are at."""

    hashes: int
    width: float
    distance: float

    def projected(self, unit: np.ndarray, table: int) -> np.ndarray:
        rng = np.random.default_rng([SEED, table, unit.shape[1]])
        return (unit @ rng.standard_normal((unit.shape[1], self.hashes)) + rng.random(self.hashes) * self.width) / self.width


def _bucket(cells: np.ndarray, dims: int) -> np.ndarray:
    """One number per row of cells; two buckets that share it are one."""
    out = np.full(len(cells), dims, np.uint64)
    for m in range(cells.shape[1]):
        out = (out ^ cells[:, m].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution, accurate to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def probes(place: np.ndarray, plan: Plan, wanted: float = FOUND_PER_TABLE) -> np.ndarray:
    """Cells to visit for one query's projections, most likely first, until
    they hold a neighbour at the planned distance with probability `wanted`."""
    home = np.floor(place)
    steps = np.arange(-REACH, REACH + 1)
    low = (steps[None, :] - (place - home)[:, None]) * plan.width / plan.distance
    chance = _normal_cdf(low + plan.width / plan.distance) - _normal_cdf(low)
    total, offsets = np.ones(1), np.zeros((1, 0), np.int64)
    for row in chance:
        total = (total[:, None] * row[None, :]).ravel()
        offsets = np.concatenate([np.repeat(offsets, len(steps), 0), np.tile(steps, len(offsets))[:, None]], axis=1)
        keep = total >= LEAST_LIKELY
        total, offsets = total[keep], offsets[keep]
    order = np.argsort(-total, kind="stable")
    stop = int(np.searchsorted(np.cumsum(total[order]), wanted)) + 1
    return home.astype(np.int64) + offsets[order[:stop]]


def _double(vectors: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in vectors]


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, k: int) -> Plan:
    """The plan for `vectors` (id, vec): the number of rows sets the directions,
    a sample of at most SAMPLE_ROWS rows, those with the smallest hashes of
    their ids, the neighbours' distance. A sample's neighbours lie farther than
    those among all rows, so the plan errs to more probes."""
    n = vectors.count()
    sample = vectors.withColumn("__h", F.xxhash64("id")).orderBy("__h", "id").limit(SAMPLE_ROWS).select("vec").toPandas()
    found = []
    by_size: dict[int, list[np.ndarray]] = {}
    for v in _double(sample["vec"]):
        by_size.setdefault(len(v), []).append(v)
    for rows in by_size.values():
        unit = _unit(np.stack(rows))
        cosines = unit[:SAMPLE_QUERIES] @ unit.T
        cosines[np.arange(len(cosines)), np.arange(len(cosines))] = -1
        near = -np.sort(-cosines, axis=1)[:, : min(k, len(unit))][:, -1]
        found += np.sqrt(np.maximum(2 - 2 * near, 0)).tolist()
    distance = max(float(np.quantile(found, FAR_NEIGHBOUR)) if found else 1.0, 0.05)
    return Plan(int(np.clip(round(np.log2(max(n, 2)) / 4), 2, 8)), distance, distance)


def usable(vec: Column) -> Column:
    """Neither NULL nor zero, and no NULL or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found for each query row: query_id, rank, vec_id, score.

    Candidates are all usable rows but the query's own id, and every query gets
    k of them, or all if they are fewer; ties go to smaller ids; vectors of
    another length are never compared. Rows with a NULL id have no part. Of a
    repeated (id, vector) one counts.
    """
    spark = rows.sparkSession
    ship(spark)
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("__q"))
    base = stored(base.filter(usable(F.col("vec")) & F.col("id").isNotNull()), "vectors")
    plan = fit(base.select("id", "vec"), k)
    # of equal vectors only the k + 1 smallest ids can be among the nearest k
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = base.select("id", "vec").distinct().withColumn("__n", first).filter(F.col("__n") <= k + 1)
    entries = entries.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stored(entries.select(F.monotonically_increasing_id().alias("entry"), "vec", "ids"), "entries")
    asked = base.filter("__q").select("id", "vec").distinct()
    visitors = stored(asked.groupBy("vec").agg(F.min("id").alias("visitor")), "visitors")
    listed, left = None, visitors
    for step in (plan, replace(plan, width=plan.width * WIDER, distance=plan.distance * WIDER), None):
        if listed is not None and step is not None and left.count() * entries.count() <= BLOCK_PAIRS:
            continue
        found = stored(_listed(entries, left, step, k), "found")
        if step is not None:
            # others within the planned distance; a visitor is an entry itself
            done = found.filter(F.col("score") >= 1 - step.distance**2 / 2).groupBy("visitor").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > k)
            done = stored(done.select("visitor"), "done")
            found, left = found.join(done, "visitor", "left_semi"), stored(left.join(done, "visitor", "left_anti"), "left")
        listed = found if listed is None else listed.unionByName(found)
        if left.isEmpty():
            break
    # equal queries share a visitor; each leaves out its own id only
    back = asked.join(visitors, "vec").select(F.col("id").alias("query_id"), "visitor")
    mine = back.join(listed, "visitor").filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _listed(entries: DataFrame, visitors: DataFrame, plan: Plan | None, k: int) -> DataFrame:
    """(visitor, score, vec_id), the k + 1 best found for each visitor; without
    a plan all entries of its length are one bucket."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _double(batch["vec"])
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                unit = _unit(np.stack([vectors[i] for i in at]))
                for table in range(TABLES if plan else 1):
                    bucket = _bucket(np.floor(plan.projected(unit, table)), size) if plan else size
                    yield pd.DataFrame({"t": table, "bucket": bucket, "entry": batch["entry"].to_numpy()[at], "least": [batch["ids"].iloc[i][0] for i in at], "vec": [vectors[i] for i in at]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for who, v in zip(batch["visitor"], _double(batch["vec"]), strict=True):
                unit = _unit(v[None, :])
                for table in range(TABLES if plan else 1):
                    buckets = np.unique(_bucket(probes(plan.projected(unit, table)[0], plan), len(v))) if plan else [len(v)]
                    yield pd.DataFrame({"t": table, "bucket": buckets, "visitor": who})

    placed = stored(entries.mapInPandas(index, "t int, bucket long, entry long, least long, vec array<double>"), "buckets")
    calls = stored(visitors.mapInPandas(visit, "t int, bucket long, visitor long"), "visits")
    parts = lambda df, name: df.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias(name))
    met = stored(parts(placed, "r").join(parts(calls, "c"), ["t", "bucket"]), "met-buckets")
    groups = max(1, -(-entries.count() // GROUP_ROWS))
    share = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    group = F.pmod(F.xxhash64("bucket", "rp", "cp"), F.lit(groups)).alias("g")
    left = placed.join(met, ["t", "bucket"]).withColumn("rp", share("entry", "r")).withColumn("cp", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    right = calls.join(met, ["t", "bucket"]).withColumn("cp", share("visitor", "c")).withColumn("rp", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    left = left.select("t", group, "bucket", "rp", "cp", "entry", "least", "vec")
    right = right.join(visitors, "visitor").select("t", group, "bucket", "rp", "cp", "visitor", "vec")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        keys = ["bucket", "rp", "cp"]
        calls_of = dict(tuple(b.groupby(keys, sort=False)))
        for key, own in a.groupby(keys, sort=False):
            asking = calls_of.get(key)
            if asking is None:
                continue
            found += _ranked(own, asking, k + 1)
        if not found:
            return pd.DataFrame({"visitor": [], "entry": [], "score": []})
        out = pd.concat(found)
        # of what the group found, the best of each visitor
        out = out.sort_values(["visitor", "score", "least"], ascending=[True, False, True])
        return out.groupby("visitor", sort=False).head(k + 1)[["visitor", "entry", "score"]]

    pairs = left.groupBy("t", "g").cogroup(right.groupBy("t", "g")).applyInPandas(meet, "visitor long, entry long, score double")
    merged = pairs.groupBy("visitor", "entry").agg(F.max("score").alias("score"))
    best = Window.partitionBy("visitor").orderBy(F.col("score").desc(), "vec_id")
    listed = merged.join(entries.select("entry", "ids"), "entry").select("visitor", "score", F.explode("ids").alias("vec_id"))
    return listed.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k + 1).drop("__n")


def _ranked(own: pd.DataFrame, asking: pd.DataFrame, k: int) -> list[pd.DataFrame]:
    """The k best entries of one bucket for each visitor, by the exact cosine."""
    lengths = {len(v) for v in own["vec"]}
    out = []
    for size in lengths:
        a = own[[len(v) == size for v in own["vec"]]]
        b = asking[[len(v) == size for v in asking["vec"]]]
        if not len(a) or not len(b):
            continue
        rows, calls = np.stack(_double(a["vec"])), np.stack(_double(b["vec"]))
        row_sizes, call_sizes = (np.sqrt((x * x).sum(axis=1)) for x in (rows, calls))
        unit = rows / row_sizes[:, None]
        entry, least, who = a["entry"].to_numpy(), a["least"].to_numpy(), b["visitor"].to_numpy()
        for at in range(0, len(calls), 256):
            cut = slice(at, at + 256)
            rough = (calls[cut] / call_sizes[cut, None]) @ unit.T
            edge = np.partition(rough, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(rough), -np.inf)
            # what rounding might order otherwise is ranked by the exact measure
            i, j = np.nonzero(rough >= edge[:, None] - 1e-9)
            exact = (calls[cut][i] * rows[j]).sum(axis=1) / (call_sizes[cut][i] * row_sizes[j])
            order = np.lexsort((least[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < k
            out.append(pd.DataFrame({"visitor": who[cut][i[top]], "entry": entry[j[top]], "score": exact[top], "least": least[j[top]]}))
    return out


def exact_nearest(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """Brute force over arrays, for measuring recall."""
    sizes = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for q in queries:
        own = int(np.flatnonzero(ids == q)[0])
        scores = (vectors * vectors[own]).sum(axis=1) / (sizes * sizes[own])
        scores[own] = -np.inf
        order = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
        out[int(q)] = ids[order].tolist()
    return out
