"""Quality rules: repetition inside a document, frequent lines across documents.

Lines are normalised and hashed. Per host and line the documents are counted,
copies as one: documents of the same set of lines. A line above the limit is
boilerplate of its host. Its lines are removed, and a document of which too
little is left is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.llm import simhash
from impactspark.llm.common import WORD, ship, stored, whole_text

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of the words
LINE_LIMIT = 20  # documents with a line within a host
NEAR_BITS = 2  # that link near copies
LEAST_LEFT = 30  # percent of the words
WINDOW = 3

_digits = re.compile(rb"[0-9]+")


def normal_line(line: bytes) -> bytes:
    """A-Z in lower case, runs of digits as 0, words joined by one space."""
    return _digits.sub(b"0", b" ".join(line.lower().split()))


def line_hash(normal: bytes) -> int:
    return xxhash.xxh64_intdigest(normal) - (1 << 63)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    keys = ids[:n]
    for k in range(1, window):  # renumber after each word, so that no key overflows
        keys = keys * len(numbers) + ids[k : n + k]
        if k + 1 < window and len(numbers) > 1_000_000:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= again
    return int(covered.sum())


def facts(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, copy_key, lines."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    again = 0
    hashes, counts = [], []
    for line in raw.split(b"\n"):
        normal = normal_line(line)
        if not normal:
            continue
        again += line in seen
        seen.add(line)
        hashes.append(line_hash(normal))
        counts.append(normal.count(b" ") + 1)
    total: Counter[int] = Counter()
    for h, n in zip(hashes, counts, strict=True):
        total[h] += n
    lines = [{"h": h, "words": n} for h, n in total.items()]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(b"".join(words).decode()), symbols, again, repeated_words(words), set_hash(total), lines


def set_hash(hashes: Iterable[int]) -> int:
    """The same for all documents of the same lines, however often and in what order."""
    return xxhash.xxh64_intdigest(np.sort(np.array([*hashes], np.int64)).tobytes()) - (1 << 63)


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FACTS = ", ".join(f"{c} long" for c in NUMBERS) + ", copy_key long, lines array<struct<h: long, words: long>>"


def judged(docs: DataFrame, host: str = "source", text: str = "text", carry: tuple[str, ...] = (), near: bool = False) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, n_boilerplate_words, kept,
    `__frequent` (hashes of the lines to remove) and the columns in `carry`.

    A NULL text counts as empty and fails; NULL is a host of its own. Repeated
    rows are judged alike, and rows of the same lines count as one document.
    With `near`, so do all rows of a class of near copies (fingerprints of
    single words linked within two bits), whose common text is no boilerplate.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(FACTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = pd.DataFrame([facts(t) for t in texts], columns=[*NUMBERS, "copy_key", "lines"])
            if near:  # in the same worker: a second one would hold the texts, too
                found["copy_key"] = np.array([simhash.fingerprint(t, 1, True) for t in texts], np.uint64).view(np.int64)
            yield found

    rows = docs.select("doc_id", F.col(host).alias("__host"), run(whole_text(text)).alias("__f"), *carry)
    rows = stored(rows.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "__host", *[F.col(f"__f.{c}") for c in NUMBERS], F.col("__f.copy_key").alias("__copy"), "__f.lines", *carry), "facts")
    lines = rows.select("__row", "__copy", "__host", F.inline("lines")).withColumn("__key", F.xxhash64("__host", "h"))
    once = lines.select("__key", "__copy").distinct()
    if near:
        named = simhash.classes(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__copy").alias("fp")), NEAR_BITS)
        once = once.join(stored(named, "near").withColumnRenamed("fp", "__copy"), "__copy").select("__key", F.col("root").alias("__copy")).distinct()
    frequent = once.groupBy("__key").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > LINE_LIMIT).select("__key")
    # at most as many lines meet here as one document has
    gone = lines.join(frequent, "__key").groupBy("__row").agg(F.sum("words").alias("__gone"), F.collect_list("h").alias("__frequent"))
    out = rows.drop("lines", "__copy").join(gone, "__row", "left")
    n = F.col("n_words")
    out = out.withColumn("n_boilerplate_words", F.coalesce("__gone", F.lit(0))).withColumn(
        "base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    )
    depleted = 100 * (n - F.col("n_boilerplate_words")) < LEAST_LEFT * n
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("__gone", "__row")


def cleaned(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that are kept, without their frequent lines; `n_chars`, if
    there, is counted anew where lines went. Near copies count as one document,
    so that a group of them stays for deduplication. Same columns."""
    rest = [c for c in docs.columns if c not in ("doc_id",)]
    names = {c: f"__c_{c}" for c in rest}
    found = judged(docs.select("doc_id", *[F.col(f"`{c}`").alias(names[c]) for c in rest]), names["source"], names["text"], tuple(names.values()), near=True)

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hashes in batches:
            yield pd.Series([drop_lines(t, set(h)) for t, h in zip(texts, hashes, strict=True)])

    kept = found.filter("kept")
    some = kept.filter("__frequent IS NOT NULL").withColumn("__new", without(F.col(names["text"]), F.col("__frequent")))
    same = kept.filter("__frequent IS NULL").withColumn("__new", F.col(names["text"]))
    out = same.unionByName(some)
    values = {c: F.col(names[c]) for c in rest} | {"text": F.col("__new")}
    if "n_chars" in rest:
        values["n_chars"] = F.when(F.col("__frequent").isNull(), F.col(names["n_chars"])).otherwise(F.char_length("__new").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_lines(text: str, hashes: set[int]) -> str:
    keep = [x for x in text.split("\n") if not ((n := normal_line(x.encode())) and line_hash(n) in hashes)]
    return "\n".join(keep)


def sql() -> str:
    """For DuckDB, with the lines themselves in place of their hashes, and a
    document's sorted lines as its copy key."""
    upper, lower = (bytes(range(ord(c), ord(c) + 26)).decode() for c in "Aa")
    signs = SYMBOLS.decode()
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM
  (SELECT rid, regexp_extract_all(text, '{WORD}') AS ws FROM d)),
t AS (SELECT rid, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY rid),
ln AS (SELECT rid, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT rid, source, string_split(text, chr(10)) AS ls FROM d)),
lw AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words, regexp_replace(translate(
  array_to_string(regexp_extract_all(line, '{WORD}'), ' '), '{upper}', '{lower}'), '[0-9]+', '0', 'g') AS norm
  FROM ln WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT rid, count(*) AS n FROM (SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k FROM lw) WHERE k > 1 GROUP BY rid),
once AS (SELECT rid, source, norm, sum(words) AS words FROM lw GROUP BY rid, source, norm),
copies AS (SELECT rid, list(norm ORDER BY norm) AS copy FROM once GROUP BY rid),
freq AS (SELECT source, norm FROM once JOIN copies USING (rid) GROUP BY source, norm HAVING count(DISTINCT copy) > {LINE_LIMIT}),
gone AS (SELECT rid, sum(words)::BIGINT AS n FROM once o JOIN freq f ON o.norm = f.norm AND o.source IS NOT DISTINCT FROM f.source GROUP BY rid),
a AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '{signs}', '')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_boilerplate_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
    AND NOT (100 * (n_words - n_boilerplate_words) < {LEAST_LEFT} * n_words) AS kept FROM a
"""
