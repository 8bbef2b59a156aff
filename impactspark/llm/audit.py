"""How filters interact, counted by a stream that takes back what it has said.

All files are processed as micro-batches of one available-now stream. A
document's failures are a mask of five bits. Four depend on its text alone; the
fifth, being a copy of a document with a smaller id, is known only when all
files are there. So each text has a state: the smallest id so far, and what the
rows of that id have added to the counters (the states of some hundred texts, by
digest, lie under one key, since a call of Python for each text is dear). When a smaller id comes, those rows
are taken back from the counter of their mask and put under the mask with the
fifth bit; the sums over all batches are what one look at the whole table gives.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from impactspark.llm.common import ship, stored, whole_text
from impactspark.sources.folders import fresh_dir

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
MIN_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
BATCHES = 4  # micro-batches that the files are dealt over
HELD_TEXTS = 200_000  # texts a task keeps before it passes them on
BUCKET_TEXTS = 256  # texts whose states lie together, about
# state on local disk, without space held in advance, and what changed in the shared folder after each batch
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

SEEN = "h string, id long, part string, mask int, good int, toxic int, n long"
DELTA = "part string, mask int, good int, toxic int, n long"


def text_mask(text: str) -> int:
    """Bits of the failures that depend on the text alone: A, B, C, D."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (
        n < MIN_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * len(text),
        len(raw.translate(None, SIGNS)) < len(raw),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


class Firsts:
    """The smallest id of each text, and counters of what is certain: every
    other row of it is a copy. Its parts can be merged in any order."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[int, int, Counter]] = {}
        self.counts: Counter = Counter()

    def add(self, h: str, doc_id: int | None, mask: int, rows: Counter) -> None:
        """Rows of one text and id, counted by (part, good, toxic)."""
        if doc_id is None:  # no id is smaller or larger
            return self.count(mask, rows)
        least = self.held.get(h)
        if least is None or doc_id < least[0]:
            self.held[h] = (doc_id, mask, Counter(rows))
            if least is not None:
                self.count(mask | COPY, least[2])
        elif doc_id == least[0]:
            least[2].update(rows)
        else:
            self.count(mask | COPY, rows)

    def count(self, mask: int, rows: Counter, sign: int = 1) -> None:
        for (part, good, toxic), n in rows.items():
            self.counts[part, mask, good, toxic] += sign * n


def firsts_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per text for the smallest id a task has met, and counters of its
    other rows: of a hot text each task passes one id on."""
    columns = ["h", "id", "part", "mask", "good", "toxic", "n"]
    own = f"#{TaskContext.get().partitionId()}"  # counters need no text's state

    def flush(found: Firsts) -> pd.DataFrame:
        rows = [(h, i, *key[:1], mask, *key[1:], n) for h, (i, mask, held) in found.held.items() for key, n in held.items()]
        rows += [(own, None, part, mask, good, toxic, n) for (part, mask, good, toxic), n in found.counts.items()]
        return pd.DataFrame(rows, columns=columns).astype({"id": "Int64"})

    found = Firsts()
    for batch in batches:
        ids = batch["id"].astype("Int64")
        for h, i, null, part, mask, good, toxic in zip(batch["h"], ids.fillna(0), ids.isna(), batch["part"], batch["mask"], batch["good"], batch["toxic"], strict=True):
            found.add(h, None if null else int(i), int(mask), Counter({(part, int(good), int(toxic)): 1}))
        if len(found.held) >= HELD_TEXTS:
            yield flush(found)
            found = Firsts()
    yield flush(found)


def retracted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters that a batch's rows bring to the texts of a bucket."""
    found = Firsts()
    if state.exists:
        for h, (least, mask, rows) in json.loads(state.get[0]).items():
            found.held[h] = (least, mask, Counter({(part, good, toxic): n for part, good, toxic, n in rows}))
    before: dict[str, tuple | None] = {}
    for frame in frames:
        for h, i, part, mask, good, toxic, n in zip(*[frame[c] for c in ("h", "id", "part", "mask", "good", "toxic", "n")], strict=True):
            rows = Counter({(part, int(good), int(toxic)): int(n)})
            if pd.isna(i):
                found.count(int(mask), rows)
                continue
            if h not in before:
                old = found.held.get(h)
                before[h] = old and (old[1], Counter(old[2]))
            found.add(h, int(i), int(mask), rows)
    for h, old in before.items():
        if old is not None:
            found.count(*old, -1)
        found.count(*found.held[h][1:])
    if before:
        kept = {h: (i, mask, [[*k, n] for k, n in rows.items()]) for h, (i, mask, rows) in found.held.items()}
        state.update((json.dumps(kept),))
    rows = [(*k, n) for k, n in found.counts.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


@contextmanager
def state_on_disk(spark: SparkSession):
    """State beyond memory spills to disk while a stream starts in this block."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def marks(labels: DataFrame) -> DataFrame:
    """Ids with a label of 1, once each; a NULL id or label is none."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    found = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return found.filter("good + toxic > 0")


def masked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(h, id, part, mask, good, toxic) per row; texts are read where they lie,
    and only ids and digests meet the labels."""

    @F.pandas_udf("int")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(text_mask).astype("int32")

    body = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.sha2(body, 256).alias("h"), mask(body).alias("mask")
    )
    # a NULL id meets no label: spread such rows by their text
    rows = rows.withColumn("k", F.coalesce("id", F.xxhash64("h"))).withColumn("has", F.col("id").isNotNull())
    known = known.select(F.col("doc_id").alias("k"), F.lit(True).alias("has"), "good", "toxic").hint("merge")  # labels grow: never broadcast
    out = rows.join(known, ["k", "has"], "left")
    return out.select("h", "id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def counted(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(part, mask, good, toxic, n) over all parquet files under `path`.

    The files are dealt over `batches` micro-batches. A batch's changes are
    written under its number, so that a batch which is repeated leaves one set.
    """
    ship(spark)
    files = spark.read.parquet(path)
    per_batch = max(1, math.ceil(len(files.inputFiles()) / batches))
    known = stored(marks(labels), "marks")
    folder = fresh_dir(spark, "audit")
    deltas = f"{folder}/deltas"
    spark.createDataFrame([], DELTA).write.parquet(f"{deltas}/batch=-1")  # a table without files has no batch

    def keep(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}")

    # a stream wants a folder or a pattern, and a table may be one file: a pattern that only `path` matches
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", per_batch).parquet(pattern)
    # a row has one text at most: from the files' footers
    buckets = max(1, files.count() // BUCKET_TEXTS)
    firsts = masked(stream, known).mapInPandas(firsts_of_task, SEEN).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    changes = firsts.groupBy("bucket").applyInPandasWithState(retracted, DELTA, "held string", "update", GroupStateTimeout.NoTimeout)
    with state_on_disk(spark):
        run = changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/stream").foreachBatch(keep).start()
        run.awaitTermination()
    found = spark.read.schema(DELTA).parquet(deltas)
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def orders() -> list[dict]:
    """Every step of every order: its filter's bit and the bits before it."""
    bit = {c: 1 << i for i, c in enumerate(LETTERS)}
    return [
        {"filter_order": "".join(p), "step": i + 1, "bit": bit[c], "before": sum(bit[x] for x in p[:i])}
        for p in permutations(LETTERS)
        for i, c in enumerate(p)
    ]


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order and step, from at most 32 counters a part."""
    some = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    cells = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good"), some("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = parts.select("part", "cells", F.inline(steps))
    total = lambda what, where: F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (a, c) -> a + c.{what})").alias
    here = "c.mask & bit <> 0 AND c.mask & before = 0"
    rows = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", "c.mask & (before | bit) = 0")("kept"),
        total("n", here)("removed"),
        total("n", "c.mask & bit <> 0 AND c.mask & before <> 0")("redundant"),
        total("n", "c.mask = bit")("unique_fails"),
        total("good", here)("good_lost"),
        total("toxic", here)("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per part (source), order of the five filters and step: documents kept,
    removed, redundant, failing this filter only, good and toxic ones removed
    here, and the filter's removals summed over all orders.

    A NULL text is empty, a NULL source the part ''. A NULL id has no label and
    is neither copy nor original, whatever its text. Rows that share text and
    smallest id are all originals; a repeated row counts again. An empty table
    gives no rows. Other columns of the files have no part.
    """
    return report(counted(spark, path, labels, batches))


def sql() -> str:
    """For DuckDB, from the whole table at once."""
    word = "[^\\x20\\x09-\\x0D]+"
    letters = f"(SELECT unnest(string_split('{LETTERS}', '')) AS x)"
    names = "abcde"
    joined = " || ".join(f"{n}.x" for n in names)
    apart = " AND ".join(f"{a}.x <> {b}.x" for i, a in enumerate(names) for b in names[:i])
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[{SIGNS.decode()}]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o AS (SELECT {joined} AS filter_order FROM {", ".join(f"{letters} {n}" for n in names)} WHERE {apart}),
s AS (SELECT filter_order, step, 1 << (instr('{LETTERS}', filter_order[step]) - 1) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (instr('{LETTERS}', filter_order[i]) - 1)))::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(earlier, 0) AS earlier, mask, n, good, toxic FROM s, cells),
t AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit) REPLACE (CAST(step AS INTEGER) AS step), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM t
"""
