"""Merkle manifest of a data set: a tree per group, and one over the groups.

A row is a leaf. The leaves of a group stand in order, and every eight
consecutive nodes become their parent until one is left, the group's subroot;
the subroots of all groups become the root in the same way. Levels are windows:
lag and lead by a fixed offset reach the other nodes of a run, masked by the
node's slot and the run's length, and the row of a run's first child hashes the
parent. Three levels are worked within a block of 512 rows, so that no window
holds more; the blocks' own nodes are the rows of the next round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactspark.llm.common import stored

ARITY = 8
LEVELS = 3  # within a block
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: partitions times groups whose counts are broadcast, at most (some 40 bytes each)
COUNTED = 100_000
PATH = "array<struct<before: string, after: string>>"
ROW_BITS = 33  # of monotonically_increasing_id, for the row within its partition


def field(value: Column) -> Column:
    """`-` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """Never NULL, in the same order: NULL first, then by UTF-8 bytes."""
    return F.when(value.isNull(), "n").otherwise(F.concat(F.lit("v"), value))


def numbered(rows: DataFrame, order: Sequence[str], group: str = "g") -> DataFrame:
    """Rows with `pos`, the place from 0 on within the group, and `n`, its size.

    One sort by ranges, so that a hot group lies in many partitions; equal rows
    are dealt by a tie-breaker and are interchangeable. A row's place is its
    place in the partition plus the rows of its group in earlier ones.
    """
    keys = [group, *order, "__tie"]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", ROW_BITS).alias("__part")
    counts = ranged.groupBy(group, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(group)  # a row per partition that holds the group
    before = F.sum("__n").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(over).alias("n")), "counts")
    counts = counts.hint("broadcast" if counts.count() <= COUNTED else "merge")
    return ranged.withColumn("__part", part).join(counts, [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


# Expressions of a level are SQL text: some hundred windows, built in a few calls.
OVER = "OVER (PARTITION BY g, block ORDER BY pos)"


def level_size(k: int) -> str:
    """Nodes of the group at level k of the block: a lone node stays."""
    return f"CAST(ceil(n / {ARITY**k}) AS BIGINT)"


def _slot(k: int) -> str:
    """The place of the row's ancestor at level k in its run."""
    return f"(pos DIV {ARITY**k}) % {ARITY}"


def _run(k: int) -> str:
    """The length of that run."""
    return f"least({ARITY}, {level_size(k)} - (pos DIV {ARITY**k} - {_slot(k)}))"


def _joined(parts: list[str]) -> str:
    return f"concat({', '.join(f"coalesce({p}, '')" for p in parts)})"


def _before(k: int) -> str:
    return _joined([f"CASE WHEN slot{k} >= {j} THEN lag(h{k}, {j * ARITY**k}) {OVER} END" for j in range(ARITY - 1, 0, -1)])


def _after(k: int) -> str:
    return _joined([f"CASE WHEN slot{k} + {j} < run{k} THEN lead(h{k}, {j * ARITY**k}) {OVER} END" for j in range(1, ARITY)])


def climbed(rows: DataFrame) -> DataFrame:
    """`h1` to `h3` beside `h0`: a node's hash, on the row of its first leaf."""
    places = [f"{f(k)} AS {name}{k}" for k in range(LEVELS) for name, f in (("slot", _slot), ("run", _run))]
    out = rows.selectExpr("*", f"pos DIV {BLOCK} AS block", *places)
    for k in range(LEVELS):
        out = out.selectExpr("*", f"CASE WHEN pos % {ARITY ** (k + 1)} <> 0 THEN NULL WHEN {level_size(k)} > 1 THEN sha2(concat(h{k}, {_after(k)}), 256) ELSE h{k} END AS h{k + 1}")
    return out


def siblings(rows: DataFrame) -> DataFrame:
    """`path`: for each level of the block that has a run, what stands before and
    after the row's ancestor in it. The first row of a node hands its own on to
    the node's other rows."""
    own = [f"CASE WHEN pos % {ARITY**k} = 0 AND {level_size(k)} > 1 THEN struct({_before(k)} AS before, {_after(k)} AS after) END AS s{k}" for k in range(LEVELS)]
    out = climbed(rows).selectExpr(*rows.columns, "block", *own)
    spread = ", ".join(["s0", *[f"last(s{k}, true) {OVER}" for k in range(1, LEVELS)]])
    return out.selectExpr(*rows.columns, "block", f"filter(array({spread}), s -> s IS NOT NULL) AS path")


def alone(rows: DataFrame) -> DataFrame:
    """The end of a tree without another one above: a node is its own root."""
    return rows.select("*", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("h0").alias("subroot"), F.col("h0").alias("root"))


def over_groups(rows: DataFrame) -> DataFrame:
    """The end of each group's tree, a row per group, in a tree over all groups."""
    nodes = stored(rows.select(F.lit("").alias("g"), F.col("g").alias("name"), "h0"), "subroots")
    above = stored(tree(numbered(nodes, ["name"]), alone).select(F.col("name").alias("g"), "path", "root"), "top")
    return rows.withColumn("subroot", F.col("h0")).join(above, "g")


def tree(rows: DataFrame, end: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (g, pos, n, h0 ...) with `path`, `subroot` and `root`. `end` gets a
    row per group and adds the three; its path goes on after the group's."""
    most = rows.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return end(rows)
    blocks = climbed(rows).filter(F.col("pos") % BLOCK == 0)
    above = blocks.select("g", F.col("block").alias("pos"), F.expr(level_size(LEVELS)).alias("n"), F.col(f"h{LEVELS}").alias("h0"))
    above = tree(stored(above, "blocks"), end)
    up = above.select("g", F.col("pos").alias("block"), F.col("path").alias("__up"), "subroot", "root")
    # the blocks' rows are where their windows have put them: only `up` is shuffled
    return siblings(rows).join(up, ["g", "block"]).withColumn("path", F.concat("path", "__up")).drop("__up", "block")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def proofs(docs: DataFrame, changed: Column, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """Per row: the key, `leaf`, `path` (per level the hashes before and after),
    `subroot`, `root`, and `folded_root`, which leads from the leaf up the path;
    where `changed` holds, from the leaf of the row with A-Z of its text in lower
    case. Only keys and hashes are shuffled.

    A NULL field is `-`, and a NULL text stays as it is; NULL is a group of its
    own and comes first, like a NULL key. Rows of the same key are ordered by
    their leaf; equal rows are a leaf each, in neighbouring places. An empty
    table has no rows; a lone row is its group's subroot, and the root if there
    is no other group. Other columns, whatever their names, have no part.
    """
    upper, lower = ("".join(chr(ord(a) + i) for i in range(26)) for a in "Aa")
    values = {c: F.col(c) for c in fields}
    other = leaf([F.translate(v, upper, lower) if c == text else v for c, v in values.items()])
    rows = docs.select(
        group_key(F.col(group)).alias("g"), F.col(key).alias("key"), leaf(list(values.values())).alias("h0"),
        F.when(changed & F.col(text).isNotNull(), other).alias("other"),
    )
    out = tree(numbered(stored(rows, "leaves"), ["key", "h0"]), over_groups)
    return out.select(
        F.col("key").alias(key), F.col("h0").alias("leaf"), "path", "subroot", "root", fold(F.coalesce("other", "h0"), F.col("path")).alias("folded_root")
    )


def manifest(docs: DataFrame, tampered_of: int = 3) -> DataFrame:
    """Proofs by digest over `docs`, tampered with where crc32 of the decimal
    doc_id is divisible by `tampered_of` (never for a NULL id)."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tampered_of == 0, F.lit(False))
    out = proofs(docs, changed)
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def crc32_sql(value: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit, in DuckDB."""
    codes = f"list_transform(string_split({value}, ''), lambda s: ascii(s)::UBIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def sql(levels: int = 9) -> str:
    """For DuckDB, by lists of a run's nodes in place of windows; groups of at
    most 8 to the power of `levels` rows."""
    upper, lower = ("".join(chr(ord(a) + i) for i in range(26)) for a in "Aa")
    value = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    hashed = lambda text: f"sha256({' || '.join(value(text if c == 'text' else c) for c in FIELDS)})"
    parts = [
        f"d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS g, {hashed('text')} AS leaf, "
        f"CASE WHEN text IS NOT NULL AND {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {hashed(f"translate(text, '{upper}', '{lower}')")} END AS other FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "a0 AS (SELECT g, pos, leaf AS h FROM l)",
    ]

    def climb(at: str) -> None:
        for k in range(levels):
            counted = f"(SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {at}{k})"
            parts.append(f"{at}{k}_runs AS (SELECT g, pos // {ARITY} AS up, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {counted} GROUP BY g, pos // {ARITY})")
            parts.append(f"{at}{k + 1} AS (SELECT g, up AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {at}{k}_runs)")

    def follow(rows: str, at: str, to: str) -> str:
        for k in range(levels):
            slot = f"((t.pos // {ARITY**k}) % {ARITY})"
            before, after = f"array_to_string(hs[1:{slot}], '')", f"array_to_string(hs[{slot} + 2:], '')"
            parts.append(
                f"{to}{k} AS (SELECT t.* REPLACE (CASE WHEN n > 1 THEN sha256({before} || cur || {after}) ELSE cur END AS cur, "
                f"CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof) "
                f"FROM {rows} t JOIN {at}{k}_runs r ON t.g = r.g AND t.pos // {ARITY ** (k + 1)} = r.up)"
            )
            rows = f"{to}{k}"
        return rows

    climb("a")
    parts.append(f"b0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS pos, h FROM a{levels})")
    climb("b")
    up = follow("(SELECT *, coalesce(other, leaf) AS cur, '' AS proof FROM l)", "a", "u")
    parts.append(f"m AS (SELECT doc_id, leaf, cur, proof, b0.h AS subroot, '' AS g, b0.pos FROM {up} x JOIN b0 ON b0.name = x.g)")
    up = follow("m", "b", "v")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified FROM {up} x, b{levels} r"""
