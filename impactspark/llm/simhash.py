"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Two nodes of the trie are traversed together: the pair carries the number of
bits in which the paths to them differ, its children pairs add the bits of one
level, and a pair over the error budget is dropped with all below it.

The trie is cut into blocks, subtrees of bounded size. Above the blocks each
fingerprint is led to the pairs of blocks within the budget that it belongs to;
each such pair is one group of a Spark job, in which a sorted array of
fingerprints is the subtree: a node is a range of it and a level splits ranges
at one bit. A group is taken in portions of bounded size, depth first, so its
memory does not grow with what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import ship, stored, whole_text
from impactspark.llm.graph import components

SEED = 42
BITS = 64
SMALLEST_BLOCK, LARGEST_BLOCK = 4_096, 65_536  # fingerprints in a subtree
DEEPER = 4  # levels by which a subtree that is too large is cut again
PORTION = 200_000  # node pairs taken together
ROUNDS = 5  # turns that take large groups of copies away before all pairs are joined
TOGETHER = 1_000  # rows of a class with a shingle in common that one task pairs
NAMELESS = 3 << 61  # ids from here on stand for rows without doc_id


def _shingles(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased, space-joined words and where each shingle is in them;
    fewer words than a shingle has are one, no words are none."""
    parts = text.encode().lower().split()  # A-Z only; ASCII white space
    if not parts:
        return b"", [], []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[words - 1 :].tolist() if len(parts) >= words else [len(joined)]
    return joined, starts[: len(last)], last


def shingle_hashes(text: str, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    joined, starts, ends = _shingles(text, words)
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3, distinct: bool = False) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats
    included unless `distinct`."""
    hashes = shingle_hashes(text, words)
    hashes = (np.unique(hashes) if distinct else hashes).astype(">u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, distinct: bool = False) -> DataFrame:
    """Add `fp`, the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words, distinct) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", run(whole_text(text)))


def _masks(bits: int, budget: int) -> np.ndarray:
    """All patterns of `bits` bits with at most `budget` ones."""
    ones = [sum(1 << i for i in c) for k in range(min(bits, budget) + 1) for c in combinations(range(bits), k)]
    return np.array(sorted(ones), np.uint64)


def _depth(total: int, tasks: int, budget: int) -> int:
    """Levels above the blocks: enough that an even block is of bounded size and
    that there are as many pairs of blocks as tasks."""
    if total <= SMALLEST_BLOCK // 2:
        return 0
    depth = 1
    while depth < BITS and (total >> depth > LARGEST_BLOCK // 2 or ((len(_masks(depth, budget)) + 1) << depth) // 2 < tasks):
        depth += 1
    return depth


def _prefix(depth: int) -> Column:
    if not depth:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned("fp", BITS - depth) if depth < BITS else F.col("fp")


def _heavy(nodes: DataFrame, depth: int, size: int) -> dict[int, np.ndarray]:
    """Per depth the prefixes with more than `size` fingerprints, which are cut
    deeper. At most one in `size` fingerprints is such a prefix."""
    found = {}
    while True:
        large = nodes.groupBy(_prefix(depth).alias("p")).count().filter(F.col("count") > size).select("p").collect()
        if not large or depth == BITS:
            return found
        found[depth] = np.sort(np.array([r["p"] for r in large], np.int64).view(np.uint64))
        depth = min(BITS, depth + DEEPER)


def _block_pairs(fp: np.ndarray, depth: int, heavy: dict[int, np.ndarray], budget: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The traversal above the blocks, for many fingerprints: with which blocks
    within the budget each must meet. Yields (row, depth, own, other)."""
    masks = _masks(depth, budget)
    row = np.repeat(np.arange(len(fp)), len(masks))
    own = _top(fp, depth)[row]
    other = own ^ np.tile(masks, len(fp))
    while True:
        deeper = np.zeros(len(row), bool)
        if depth in heavy:
            deeper = np.isin(own, heavy[depth]) | np.isin(other, heavy[depth])
        yield row[~deeper], np.full((~deeper).sum(), depth), own[~deeper], other[~deeper]
        if not deeper.any():
            return
        row, own, other = row[deeper], own[deeper], other[deeper]
        more = min(DEEPER, BITS - depth)
        depth += more
        masks = _masks(more, budget)
        errors = np.bitwise_count(own ^ other)
        below = _top(fp, depth)[row]
        beside = other << np.uint64(more) | below & np.uint64((1 << more) - 1)
        at = np.repeat(np.arange(len(row)), len(masks))
        flips = np.tile(masks, len(row))
        fits = errors[at] + np.bitwise_count(flips) <= budget
        at, flips = at[fits], flips[fits]
        row, own, other = row[at], below[at], beside[at] ^ flips


def _top(fp: np.ndarray, depth: int) -> np.ndarray:
    return fp >> np.uint64(BITS - depth) if depth else np.zeros_like(fp)


def _middles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each sorted range [lo, hi) of common higher bits turns from 0 to 1."""
    turn = (values[lo] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(values, turn), lo, hi)


def trie_pairs(left: np.ndarray, right: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of fingerprints of two sorted arrays within the budget.

    With `same` both are one tree and each pair is found once."""
    if not len(left) or not len(right):
        return
    first = [np.array([x], np.int64) for x in (0, len(left), 0, len(right), 0)]
    stack = [(BITS - 1, first)]
    while stack:
        bit, (al, ah, bl, bh, errors) = stack.pop()
        if len(al) > PORTION:
            half = len(al) // 2
            stack += [(bit, [x[:half] for x in (al, ah, bl, bh, errors)]), (bit, [x[half:] for x in (al, ah, bl, bh, errors)])]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if bit < 0:
            leaf[:] = True
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, errors = (x[~leaf] for x in (al, ah, bl, bh, errors))
        if not len(al):
            continue
        am, bm = _middles(left, al, ah, bit), _middles(right, bl, bh, bit)
        kids = []
        for x, (a0, a1) in enumerate(((al, am), (am, ah))):
            for y, (b0, b1) in enumerate(((bl, bm), (bm, bh))):
                sums = errors + (x != y)
                keep = (a0 < a1) & (b0 < b1) & (sums <= budget)
                if same and x > y:  # the mirrored pair of a node with itself
                    keep &= al != bl
                kids.append([v[keep] for v in (a0, a1, b0, b1, sums)])
        stack.append((bit - 1, [np.concatenate([k[i] for k in kids]) for i in range(5)]))


def _star(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Union the pairs; each linked position with its set's root."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def links(nodes: DataFrame, budget: int = 2, forest: bool = False, depth: int | None = None, size: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ in at most `budget` bits.

    `nodes` has one row per distinct fingerprint: fp, id. With `forest`, each
    group's pairs are reduced to a spanning star per linked set before they
    leave the task, which joins the same ids with fewer rows. `depth` levels
    are traversed above the blocks, more where a block is over `size`.
    """
    spark = nodes.sparkSession
    ship(spark)
    nodes = nodes.select("fp", "id")
    total = nodes.count()
    if depth is None:
        depth = _depth(total, int(spark.conf.get("spark.sql.shuffle.partitions")), budget)
    heavy = _heavy(nodes, depth, size or min(LARGEST_BLOCK, max(SMALLEST_BLOCK, total >> depth << 2)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                fp, key = (batch[c].to_numpy()[at : at + 2_000] for c in ("fp", "id"))
                for row, level, own, other in _block_pairs(fp.view(np.uint64), depth, heavy, budget):
                    ends = np.minimum(own, other), np.maximum(own, other)
                    yield pd.DataFrame(
                        {"fp": fp[row], "id": key[row], "depth": level, "i": ends[0].view(np.int64), "j": ends[1].view(np.int64), "side": (own > other).astype(np.int32)}
                    )

    placed = nodes.mapInPandas(place, "fp long, id long, depth int, i long, j long, side int")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        value, key, side = pdf["fp"].to_numpy().view(np.uint64), pdf["id"].to_numpy(), pdf["side"].to_numpy()
        trees = []
        for s in (0,) if same else (0, 1):
            own = np.flatnonzero(side == s)
            trees.append(own[np.argsort(value[own], kind="stable")])
        l, r = trees[0], trees[-1]
        found = trie_pairs(value[l], value[r], bool(same), budget)
        if not forest:
            ends = [(key[l[i]], key[r[j]]) for i, j in found]
            a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        else:
            shift = 0 if same else len(l)
            keys = key[l] if same else np.concatenate([key[l], key[r]])
            member, root = _star(len(keys), ((i, j + shift) for i, j in found))
            a, b = keys[member], keys[root]
        return pd.DataFrame({"a": a, "b": b})

    return placed.groupBy("depth", "i", "j").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, words: int = 3) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, fp, component_id.

    A component is all documents that links of at most `budget` differing bits
    join (a distinct fingerprint goes to 1 + d(d + 1)/2 blocks at depth d for two
    bits, 191 at depth 19; the prefixes of full blocks, at most one in 65,536
    fingerprints, come to the driver); its id is the smallest doc_id in it. A NULL text is empty, an empty
    one has fingerprint 0, and rows of equal fingerprint are one node, however
    many they are. Rows without doc_id get the component of the others, or NULL
    if there is none with an id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stored(fingerprints(rows, words=words).select("doc_id", "fp"), "fingerprints")
    named = classes(marked, budget).select("fp", F.when(F.col("root") < NAMELESS, F.col("root")).alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def classes(marked: DataFrame, budget: int) -> DataFrame:
    """The class of each fingerprint of `marked` (doc_id, fp): fp, root. A root
    is the smallest doc_id, or from NAMELESS on where no row of it has one."""
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # a fingerprint of rows without doc_id still joins others: order it last
    known = F.coalesce("least", F.lit(NAMELESS) + F.monotonically_increasing_id())
    nodes = stored(least.select("fp", known.alias("id")), "nodes")
    roots = components(links(nodes, budget, forest=True), "a", "b")
    return nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, budget: int = 2, words: int = 3) -> DataFrame:
    """`docs` (doc_id, text, ...) with one row of each component of
    `near_duplicates`: that of the smallest doc_id, a row with one before rows
    without, and of repeated rows any. Same columns.

    A fingerprint's rows are reduced to their first before they meet its class,
    and a class's fingerprints before the shuffle, so no group of copies comes
    together; texts are shuffled once, to the rows that stay.
    """
    # the row itself in one column, so that no name of its own clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").cast("long").alias("__id"))
    rows = stored(fingerprints(rows, "__doc.text", words=words).withColumn("__row", F.monotonically_increasing_id()), "fingerprinted")
    named = classes(rows.select(F.col("__id").alias("doc_id"), "fp"), budget)
    order = F.struct(F.col("__id").isNull().alias("nameless"), F.col("__id").alias("id"), "__row")
    firsts = rows.select("fp", order.alias("__first")).groupBy("fp").agg(F.min("__first").alias("__first"))
    stay = firsts.join(named, "fp").groupBy("root").agg(F.min("__first").alias("__first")).select(F.col("__first")["__row"].alias("__row"))
    return rows.join(stay, "__row", "left_semi").select("__doc.*")


def deduplicated(docs: DataFrame, budget: int = 2, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` (doc_id, text, ...) with one row of each group of copies, by the
    smallest doc_id. Same columns.

    Fingerprints are taken over the distinct single words, whose bits an edit
    moves least, and classes of linked fingerprints are then checked exactly: a
    row goes if its shingles of `words` words have at least `similarity` in
    common (Jaccard) with those of a row before it. All rows of a class are
    held against its first; those unlike it are held against the first of their
    own least shingle, in `ROUNDS` orders of shingles, which takes large groups
    of copies away without their pairs; among the rows that are left every
    pair that can be alike is joined (`alike_rows`). So no two rows that stay in
    a class are alike, and none is dropped for a link of bits alone. Empty texts
    are alike.
    """
    # the row itself in one column, so that no name of its own clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").cast("long").alias("__id"))
    rows = fingerprints(rows, "__doc.text", words=1, distinct=True)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "fingerprinted")
    named = stored(classes(rows.select(F.col("__id").alias("doc_id"), "fp"), budget), "classes")
    placed = rows.select("fp", "__row").join(named, "fp").select("root", "__row")
    # stored, so that the join below is by two plain shuffles and a hot class can be split
    shared = stored(placed.groupBy("root").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("root"), "shared")
    members = stored(placed.join(shared, "root"), "members")

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts], dtype="object")

    first = F.struct(F.col("__id").isNull().alias("nameless"), F.col("__id").alias("id"), "__row")
    open_rows = rows.join(members, "__row").select("root", "__row", first.alias("__first"), hashes(whole_text("__doc.text")).alias("__s"))
    gone = None
    for turn in range(ROUNDS + 1):
        least = F.array_min(F.transform("__s", lambda h, t=turn: F.xxhash64(h, F.lit(t)))) if turn else F.lit(0).cast("long")
        open_rows = stored(open_rows.withColumn("__g", F.coalesce(least, F.lit(0))), "open")
        if open_rows.isEmpty():
            break
        leaders = open_rows.groupBy("root", "__g").agg(F.min("__first").alias("__lead")).select(F.col("__lead")["__row"].alias("__lead"))
        lead = open_rows.join(leaders, open_rows["__row"] == leaders["__lead"]).select("root", "__g", "__lead", F.col("__s").alias("__ls"))
        both = F.size(F.array_intersect("__s", "__ls"))
        either = F.size("__s") + F.size("__ls") - both
        alike = (F.col("__row") != F.col("__lead")) & ((either == 0) | (both >= similarity * either))
        beside = open_rows.join(lead, ["root", "__g"]).withColumn("__alike", alike)
        beside = stored(beside.select("root", "__row", "__lead", "__first", "__s", "__alike"), "beside")
        out = beside.filter("__alike").select("__row")
        gone = out if gone is None else gone.unionByName(out)
        # in the first turn the leader has met all of its class
        rest = beside.filter("NOT __alike") if turn else beside.filter("NOT __alike AND __row != __lead")
        open_rows = rest.select("root", "__row", "__first", "__s")
    else:
        gone = gone.unionByName(alike_rows(open_rows, similarity))
    kept = rows if gone is None else rows.join(gone, "__row", "left_anti")
    return kept.select("__doc.*")


def alike_rows(rows: DataFrame, similarity: float) -> DataFrame:
    """Of `rows` (root, __row, __first, __s) the `__row` of each that is alike to
    one before it in its class, exactly, by a prefix filter.

    A row's shingles are ordered from the rarest in its class to the commonest.
    Two rows that are alike have one in common among the first of both, and the
    first that they have in common leaves enough behind it in both; only such
    pairs are held against each other. Shingles of one row alone only count as
    places, and a row that has too many of them meets nobody.
    """
    rows = stored(rows.withColumn("__n", F.size("__s")), "unlike")
    shingles = rows.select("__row", F.explode("__s").alias("__h"), "root").select("__row", F.xxhash64("root", "__h").alias("__k"))
    counts = shingles.groupBy("__k").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1")
    common = shingles.join(counts, "__k").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__c", "__k"))).alias("__common"))
    # 1e-6: no pair is lost to the rounding of a product
    prefix = F.col("__n") - F.ceil(similarity * F.col("__n") - 1e-6) + 1
    placed = rows.select("root", "__row", "__first", "__n").join(common, "__row")
    placed = placed.withColumn("__own", F.col("__n") - F.size("__common")).filter(F.col("__own") < prefix)
    placed = placed.withColumn("__lead", F.slice("__common", F.lit(1), F.greatest(F.lit(0), prefix - F.col("__own")).cast("int")))
    placed = placed.select("root", "__row", "__first", "__n", "__own", F.posexplode("__lead").alias("__i", "__t"))
    placed = stored(
        placed.select("root", "__row", "__first", "__n", (F.col("__own") + F.col("__i")).alias("__at"), F.col("__t.__k").alias("__k"), F.col("__t.__c").alias("__c")),
        "prefixes",
    )
    # a common shingle's pairs are dealt over tasks
    parts = F.ceil(F.col("__c") / TOGETHER)
    after = placed.withColumn("__part", F.pmod(F.xxhash64("__row"), parts))
    before = placed.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    a, b = after.alias("a"), before.alias("b")
    rest = F.least(F.col("a.__n") - F.col("a.__at"), F.col("b.__n") - F.col("b.__at"))
    sizes = F.col("a.__n") + F.col("b.__n")
    met = a.join(
        b,
        (F.col("a.__k") == F.col("b.__k"))
        & (F.col("a.__part") == F.col("b.__part"))
        & (F.col("a.root") == F.col("b.root"))
        & (F.col("b.__first") < F.col("a.__first"))
        & (F.least("a.__n", "b.__n") >= similarity * F.greatest("a.__n", "b.__n") - 1e-6)
        & (rest * (1 + similarity) >= similarity * sizes - 1e-6),
    )
    pairs = stored(met.select(F.col("a.__row").alias("__row"), F.col("b.__row").alias("__before")).distinct(), "pairs")
    left = pairs.join(rows.select("__row", "__s"), "__row")
    both = F.size(F.array_intersect("__s", "__bs"))
    found = left.join(rows.select(F.col("__row").alias("__before"), F.col("__s").alias("__bs")), "__before")
    return found.filter(both >= similarity * (F.size("__s") + F.size("__bs") - both)).select("__row").distinct()
