"""Quality classifier: naive Bayes log-count ratios under a linear SVM.

A document is the set of its n-grams: lower-cased words, and runs of one to
three word shapes (letters, capitals, digits and signs; a word that repeats the
one before has a shape of its own). Each n-gram indicator is scaled by the log
ratio of its smoothed counts in both classes, counted over all labelled rows;
a hinge-loss model is fitted on the scaled, length-normalised vectors of a
bounded sample by dual coordinate descent; a sigmoid on rows kept out of a
first fit turns margins into scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import Memo, ship, stored, whole_text

BUCKETS = 1 << 18
FIT_ROWS = 12_000  # labelled rows the linear model is fitted on, at most
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
COST = 1.0
EPOCHS = 12
SMOOTHING = 1.0
SAME = zlib.crc32(b"same as before")
EDGE = zlib.crc32(b"edge")


def shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _of_word(word: bytes) -> tuple[int, int]:
    text = word.decode()
    return zlib.crc32(shape(text).encode()), zlib.crc32(b"w " + text.lower().encode()) % BUCKETS


_words = Memo(_of_word)


def features(text: str) -> np.ndarray:
    """Sorted buckets of a text's n-grams; an empty text has its edges."""
    words = text.encode().split()
    known = [_words[w] for w in words]
    found = {k[1] for k in known}
    shapes = [EDGE, *[SAME if a == b else k[0] for a, b, k in zip(words, [b"", *words], known, strict=False)], EDGE]
    found.update(s % BUCKETS for s in set(shapes))
    found.update((a * 31 + b * 7 + 1) % BUCKETS for a, b in set(zip(shapes, shapes[1:], strict=False)))
    found.update((a * 961 + b * 217 + c * 13 + 2) % BUCKETS for a, b, c in set(zip(shapes, shapes[1:], shapes[2:], strict=False)))
    return np.array(sorted(found), np.int32)


def pack(at: np.ndarray) -> bytes:
    """Sorted buckets as 16-bit gaps; a gap of 65535 goes on in the next one."""
    gaps = np.diff(at.astype(np.int64), prepend=0)
    longer = gaps // 65535
    if not longer.any():
        return gaps.astype("<u2").tobytes()
    out = np.full(len(gaps) + int(longer.sum()), 65535, "<u2")
    out[np.arange(len(gaps)) + np.cumsum(longer)] = gaps % 65535
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2")
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def featured(docs: DataFrame) -> DataFrame:
    """Per row doc_id and its n-grams, stored: texts are read once, and only
    the n-grams, a fraction of their size, are shuffled. NULL is an empty text."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pack(features(t)) for t in texts], dtype="object")

    return stored(docs.select("doc_id", run(whole_text()).alias("x")), "ngrams")


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        size = float(np.sqrt((r * r).sum()))
        return (float((r * self.weight[at]).sum()) / size if size else 0.0) + self.bias

    def score(self, at: np.ndarray) -> float:
        z = self.slope * self.margin(at) + self.shift
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss, the bias as one input more."""
    w, bias = np.zeros(len(ratio)), 0.0
    inputs = []
    for at in rows:
        r = ratio[at]
        size = np.sqrt((r * r).sum())
        inputs.append(r / size if size else r)
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            y, at, x = labels[i], rows[i], inputs[i]
            gradient = y * (x @ w[at] + bias) - 1
            after = min(max(alpha[i] - gradient / 2, 0.0), COST)  # squared length: 1, and 1 for the bias
            if after != alpha[i]:
                step = (after - alpha[i]) * y
                w[at] += step * x
                bias += step
                alpha[i] = after
    return w, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton steps, with smoothed targets."""
    up, down = (labels > 0).sum(), (labels <= 0).sum()
    goal = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        error, spread = p - goal, p * (1 - p) + 1e-9
        grad = np.array([(error * margins).sum() + 1e-3 * a, error.sum()])
        hessian = np.array([[(spread * margins**2).sum() + 1e-3, (spread * margins).sum()], [(spread * margins).sum(), spread.sum()]])
        step = np.linalg.solve(hessian, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents (`featured`) outside the held-out fold.

    Counts cover all of them; the linear model sees at most `rows`, those whose
    ids have the smallest hashes. Rows with a NULL label or id have no part.
    With one class alone, or none, every score is the share of ones, smoothed.
    """
    ship(docs.sparkSession)
    marks = labels.select("doc_id", (F.col(label) > 0).cast("int").alias("__y")).dropna().filter(fold() != HELD_OUT)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for x, y in zip(batch["x"], batch["__y"], strict=True):
                seen[y, unpack(x)] += 1
                n[y] += 1
        at = np.flatnonzero(seen.any(0))
        yield pd.DataFrame({"at": [-1, *at], "down": [n[0], *seen[0, at]], "up": [n[1], *seen[1, at]]})

    # labels grow with the documents: the same join at every size, no broadcast
    counted = docs.join(marks.hint("merge"), "doc_id").select("x", "__y").mapInPandas(count, "at int, down long, up long")
    # one row per bucket, whatever the number of documents
    sums = counted.groupBy("at").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).toPandas()
    n = sums[sums["at"] < 0]
    down, up = (int(n[c].sum()) for c in ("down", "up"))
    if not down or not up:
        share = (up + 1) / (up + down + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    seen = np.full((2, BUCKETS), SMOOTHING)
    sums = sums[sums["at"] >= 0]
    seen[0, sums["at"]] += sums["down"]
    seen[1, sums["at"]] += sums["up"]
    ratio = np.log(seen[1] / (up + 2 * SMOOTHING)) - np.log(seen[0] / (down + 2 * SMOOTHING))
    few = marks.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id", "__y").limit(rows)
    # `few` has at most `rows` rows
    sample = docs.join(F.broadcast(few), "doc_id").select("x", F.col("__y").alias("y"), F.col("__h").alias("h")).toPandas()
    sample = sample.sort_values(["h", "y", "x"], kind="stable")
    inputs = [unpack(x) for x in sample["x"]]
    signs = np.where(sample["y"].to_numpy() > 0, 1.0, -1.0)
    apart = np.arange(len(inputs)) % 5 == 0
    w, bias = descend([x for x, out in zip(inputs, apart, strict=True) if not out], signs[~apart], ratio)
    first = Model(ratio, w, bias, 1.0, 0.0)
    slope, shift = calibrate(np.array([first.margin(x) for x, out in zip(inputs, apart, strict=True) if out]), signs[apart])
    w, bias = descend(inputs, signs, ratio)
    return Model(ratio, w, bias, slope, shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of `docs` (`featured`): doc_id, held_out, score, predicted. Only
    the text's n-grams have a part in the score; equal texts score alike."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(unpack(x)) for x in batch], dtype="float64")

    out = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), run("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
