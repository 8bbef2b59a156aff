"""Mixing sources to target weights by Sainte-Laguë apportionment.

Everything is DataFrame operations. Words are handed out in blocks of equal
size. Sources get blocks by highest quotients target / (2n - 1); a source's
blocks go to its shards the same way, by the shards' sizes, so each shard has
an integer quota of its own and selects blocks without regard to the others.
A source has one shard per `SHARD_WORDS` words, so that a source with a third
of all rows is many shards.

Quotients are not listed one by one: a divisor known to be too large gives
every member seats it surely has, one known to be too small the most it can
have, and only the few seats between are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactspark.llm.common import WORD, stored, whole_text

BLOCK_WORDS = 64
SHARD_WORDS = 500_000
MOST_TIMES = 3  # copies of a source, at most
WEIGHTS = 3  # sources weigh 1, 2, 3, 1, 2, 3, ...
SEED = "mix"
STRIDE = 2_147_483_647  # a prime beyond any shard's number of blocks


def _hex_number(text: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source (source, source_size): its position by code point with
    NULL last, weight and target. A target over three times the source stops
    there and the rest is shared again: sources are taken by cap per weight, and
    one is capped while the share of what is left exceeds its cap."""
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "pos")
    size = F.col("source_size")
    return (
        sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", (F.col("pos") - 1) % WEIGHTS + 1)
        .withColumn("cap", size * MOST_TIMES)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum(size).over(every))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", (F.col("total") - F.col("spent")).cast("double") / F.col("weights") * F.col("weight") > F.col("cap"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left").cast("double") / F.col("open") * F.col("weight")),
        )
        .select("source", "pos", "source_size", "total", "target")
    )


def seats(members: DataFrame, group: Sequence[str], member: str, weight: str, number: str) -> DataFrame:
    """Sainte-Laguë: share `number` seats of each group among its members by the
    highest quotients weight / (2n - 1); ties go to the lower member. Adds `quota`."""
    whole = Window.partitionBy(*group)
    w, k = F.col(weight), F.col(number)
    bounded = (
        members.withColumn("__sum", F.sum(w).over(whole).cast("double"))
        .withColumn("__half", F.count(F.lit(1)).over(whole) / 2)
        # a divisor that gives too few seats, and one that gives too many
        .withColumn("__base", F.when(k - F.col("__half") - 1 > 0, F.floor(w * (k - F.col("__half") - 1) / F.col("__sum") + 0.5)).otherwise(0))
        .withColumn("__most", F.when(w > 0, F.floor(w * (k + F.col("__half") + 1) / F.col("__sum") + 0.5)).otherwise(0))
        .withColumn("__base", F.least("__base", "__most"))
        .withColumn("__left", k - F.sum("__base").over(whole))
    )
    by_quotient = Window.partitionBy(*group).orderBy(F.col("__quotient").desc(), member, "__n")
    more = (
        bounded.filter("__most > __base")
        .select(*group, member, weight, "__left", F.explode(F.sequence(F.col("__base") + 1, F.col("__most"))).alias("__n"))
        .withColumn("__quotient", F.col(weight).cast("double") / (2 * F.col("__n") - 1))
        .withColumn("__rank", F.row_number().over(by_quotient))
        .filter("__rank <= __left")
        .groupBy(*group, member)
        .agg(F.count(F.lit(1)).alias("__more"))
    )
    joined = bounded.join(more, [*group, member], "left")
    return joined.withColumn("quota", F.col("__base") + F.coalesce("__more", F.lit(0))).drop("__sum", "__half", "__base", "__most", "__left", "__more")


def _selected(block: Column) -> Column:
    """Whether the shard's seeded permutation puts a block among those taken."""
    return (block * STRIDE + F.col("__offset")) % F.col("__blocks") < F.col("__rest")


def mix(docs: DataFrame, carry: Sequence[str] = (), block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> DataFrame:
    """Decide how many words of each row (doc_id, text, source) the mix takes.

    Returns doc_id, size, source_size, target, taken, the columns in `carry`,
    and what the selection is made of: __start (the row's first word in its
    shard's order), __full (whole passes over the shard), and the blocks taken
    besides. A NULL text has size 0 and NULL is a source, the last. Rows of a
    shard are ordered by a hash of seed and doc_id, then doc_id and size, so
    reruns agree; repeated rows are rows like others.
    """
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    seeded = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", F.col("source").alias("__source"), size.alias("size"), seeded.alias("__h"), *carry)
    narrow = stored(rows.select("doc_id", "__source", "size", "__h"), "sizes")
    if not carry:
        rows = narrow
    sums = narrow.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
    blocks = F.floor(F.col("total") / block + 0.5)
    sources = seats(targets(sums).withColumn("__k", blocks), (), "pos", "target", "__k").withColumn(
        "shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1))
    )
    sources = stored(sources.select("source", "pos", "source_size", "target", "quota", "shards"), "sources")
    named = sources.select(F.col("source").alias("__name"), "pos", "shards")
    keyed = lambda df: df.join(named, df["__source"].eqNullSafe(named["__name"])).drop("__name").withColumn("shard", _hex_number(F.col("__h")) % F.col("shards"))
    cells = keyed(narrow).groupBy("pos", "shard").agg(F.sum("size").alias("cell"))
    cells = seats(cells.join(sources.withColumnRenamed("quota", "__k"), "pos"), ("pos",), "shard", "cell", "__k")
    take = F.least(F.col("quota") * block, F.col("cell") * MOST_TIMES)
    cells = (
        cells.withColumn("__full", F.when(F.col("cell") > 0, F.floor(take / F.col("cell"))).otherwise(0))
        .withColumn("__rest", F.floor((take - F.col("__full") * F.col("cell")) / block + 0.5))
        .withColumn("__blocks", F.greatest(F.ceil(F.col("cell") / block), F.lit(1)))
        .withColumn("__offset", _hex_number(F.md5(F.concat_ws(":", F.lit(SEED), "pos", "shard"))))
        .select("pos", "shard", "source_size", "target", "__full", "__rest", "__blocks", "__offset")
    )
    cells = stored(cells, "shards")
    upto = Window.partitionBy("pos", "shard").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed(rows).withColumn("__start", F.sum("size").over(upto) - F.col("size")).join(cells, ["pos", "shard"])
    end = F.col("__start") + F.col("size")
    first, last = F.floor(F.col("__start") / block), F.floor((end - 1) / block)
    inside = lambda j: F.least((j + 1) * block, end) - F.greatest(j * block, F.col("__start"))
    picked = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda n, j: n + F.when(_selected(j), inside(j)).otherwise(0))
    return placed.withColumn("__picked", F.when(F.col("size") > 0, picked).otherwise(F.lit(0))).select(
        "doc_id", "size", "source_size", "target", (F.col("__full") * F.col("size") + F.col("__picked")).alias("taken"),
        "__picked", "__start", "__full", "__rest", "__blocks", "__offset", *carry,
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row per pass over it, and
    one with the words of the blocks taken besides; rows not taken go. White
    space inside is kept; `n_chars`, if there, is counted anew."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    chosen = mix(docs.withColumnsRenamed({c: f"__c_{c}" for c in rest}), ("text", "source", *[f"__c_{c}" for c in rest]), block)
    start, end = F.col("__start"), F.col("__start") + F.col("size")
    words = F.regexp_extract_all(whole_text(), F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), 0)
    taken = F.filter(F.sequence(F.floor(start / block), F.floor((end - 1) / block)), _selected)
    run = lambda j: F.array_join(F.slice(F.col("__words"), (F.greatest(j * block, start) - start + 1).cast("int"), (F.least((j + 1) * block, end) - F.greatest(j * block, start)).cast("int")), "")
    partial = (F.col("__picked") > 0) & (F.col("__picked") < F.col("size"))
    chosen = chosen.withColumn("__words", F.when(partial, words))
    part = F.when(partial, F.array_join(F.transform(taken, run), "")).otherwise(F.col("text"))
    passes = F.array_repeat(F.col("text"), F.col("__full").cast("int"))
    texts = F.when(F.col("size") > 0, F.concat(passes, F.when(F.col("__picked") > 0, F.array(part)).otherwise(F.array().cast("array<string>"))))
    out = chosen.withColumn("text", F.explode(texts))
    named = {c: F.char_length("text").cast(dict(docs.dtypes)[c]) if c == "n_chars" else F.col(f"__c_{c}") for c in rest}
    return out.select(*[named.get(c, F.col(c)).alias(c) for c in docs.columns])


def sql(block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> str:
    """The same decisions for DuckDB."""

    def seat_sql(name: str, source: str, group: str, member: str, weight: str) -> str:
        part = f"PARTITION BY {group}" if group else ""
        key = f"{group + ', ' if group else ''}{member}"
        return f"""
{name}_b AS (SELECT *, greatest(0, least(lo, most)) AS base FROM (SELECT *,
    CASE WHEN k - half - 1 > 0 THEN floor({weight} * (k - half - 1) / tot + 0.5e0)::BIGINT ELSE 0 END AS lo,
    CASE WHEN {weight} > 0 THEN floor({weight} * (k + half + 1) / tot + 0.5e0)::BIGINT ELSE 0 END AS most
  FROM (SELECT *, CAST(sum({weight}) OVER ({part}) AS DOUBLE) AS tot,
    CAST(count(*) OVER ({part}) AS DOUBLE) / 2 AS half FROM ({source})))),
{name}_l AS (SELECT *, k - sum(base) OVER ({part}) AS seats_left FROM {name}_b),
{name}_m AS (SELECT {key}, count(*) AS more FROM (SELECT *, row_number() OVER ({part}
    ORDER BY CAST({weight} AS DOUBLE) / (2 * n - 1) DESC, {member}, n) AS rk
  FROM (SELECT *, unnest(range(base + 1, most + 1)) AS n FROM {name}_l)) WHERE rk <= seats_left GROUP BY {key}),
{name} AS (SELECT l.*, base + coalesce(more, 0) AS quota FROM {name}_l l LEFT JOIN {name}_m USING ({key}))"""

    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
s2 AS (SELECT *, source_size * {MOST_TIMES} AS cap, (pos - 1) % {WEIGHTS} + 1 AS weight,
  CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight > cap AS capped FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight
  END AS target FROM s3),
{seat_sql("src", f"SELECT *, floor(total / {block} + 0.5e0)::BIGINT AS k FROM s4", "", "pos", "target")},
r AS (SELECT d.*, src.pos, src.source_size, src.target, src.quota AS source_quota,
    ('0x' || substr(h, 1, 8))::BIGINT % greatest(ceil(src.source_size / {float(shard)}e0)::BIGINT, 1) AS shard
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
{seat_sql("cell", "SELECT pos, shard, sum(size)::BIGINT AS cell_size, any_value(source_quota) AS k FROM r GROUP BY pos, shard", "pos", "shard", "cell_size")},
c AS (SELECT *, floor((take - passes * cell_size) / {float(block)}e0 + 0.5e0)::BIGINT AS rest,
    greatest(ceil(cell_size / {float(block)}e0)::BIGINT, 1) AS blocks,
    ('0x' || substr(md5('{SEED}:' || pos || ':' || shard), 1, 8))::BIGINT AS off
  FROM (SELECT *, CASE WHEN cell_size > 0 THEN take // cell_size ELSE 0 END AS passes
    FROM (SELECT *, least(quota * {block}, cell_size * {MOST_TIMES})::BIGINT AS take FROM cell))),
p AS (SELECT r.*, c.passes, c.rest, c.blocks, c.off, sum(size) OVER (PARTITION BY r.pos, r.shard ORDER BY h, doc_id, size
    ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM r JOIN c USING (pos, shard))
SELECT doc_id, size, source_size, target, passes * size + coalesce(CASE WHEN size > 0 THEN list_sum(list_transform(
    range(start // {block}, (start + size - 1) // {block} + 1),
    lambda j: CASE WHEN (j * {STRIDE} + off) % blocks < rest
      THEN least((j + 1) * {block}, start + size) - greatest(j * {block}, start) ELSE 0 END)) END, 0)::BIGINT AS taken
FROM p
"""
