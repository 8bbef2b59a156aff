"""Secret scans: fixed patterns, and a character network over every candidate.

Candidates are long runs of key characters. The network reads a candidate and
the text around it, character by character: embeddings (a character inside the
candidate is another symbol than the same outside), one convolution, the
strongest response of each filter, a linear layer. It is written in numpy and
trained on labelled findings: what the patterns find in all documents and runs
they pass over, with the keywords blanked in copies so that the value itself has
to be learned, and seeded made-up findings of kinds the documents may lack. Every
share of the findings takes its steps in a task of its own, and after some
epochs the shares' parameters are averaged. Scores are calibrated on findings kept
apart, and the thresholds, one for candidates after a keyword and one for bare
ones, are the most precise that still find the wanted share of those.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.functions.exact import exact_mean
from impactspark.llm.common import ship, stored, whole_text

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 or more; shorter ones fail
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "net")

WORDS_OF_ASSIGN = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KEYWORD = re.compile(r"(?:pass|secret|token|key|auth|bearer|credential|pwd)", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
NAME = re.compile(r"[A-Za-z_.-]{1,40}=(?=[^=]{16})")
LONG_RUN = 24  # from here on a run without digit is a candidate, too
_RUN_BYTES = bytes(1 if RUN.match(chr(c) * 16) else 0 for c in range(128)) + bytes(128)
_HEX_BYTES = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))

INSIDE, AROUND = 48, 16  # characters of a window: of the candidate, to each side
WIDTH = AROUND + INSIDE + AROUND
SYMBOLS = 97  # 95 printable characters, any other one, none
EMBEDDING, FILTERS, REACH = 12, 24, 5
EPOCHS, BATCH, RATE = 16, 128, 3e-3
SHARE = 12_000  # findings of a share, about
ROUND = 4  # epochs between two averages
STEPS = 64  # logits are counted in cells of 1 / STEPS
FARTHEST = 30  # ... from -FARTHEST on
MADE_UP = 8_000
RECALL = 0.95
SEED = 3

Span = tuple[int, int, int]  # start, kind's number, end


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' findings, by start and kind, in code points."""
    out: list[Span] = []
    raw = text.encode()
    low = raw.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\1" * LEAST_HEX in raw.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters: all with a digit, long ones without."""
    if b"\1" * 16 not in text.encode().translate(_RUN_BYTES):
        return []
    spans = []
    for m in RUN.finditer(text):
        name = NAME.match(m[0])  # an assignment without spaces: the value alone
        start = m.start() + (name.end() if name else 0)
        run = text[start : m.end()]
        if len(run) >= LONG_RUN or not run.isalpha() and any(c.isdigit() for c in run):
            spans.append((start, m.end()))
    return spans


_CODES = np.full(0x80, SYMBOLS - 2, np.int16)
_CODES[32:127] = np.arange(95)


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _CODES[np.minimum(points, 127)]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Symbols of the windows that cover a candidate, with their surroundings."""
    out = []
    for a in range(start, end, INSIDE):
        b = min(a + INSIDE, end)
        row = np.full(WIDTH, SYMBOLS - 1, np.int16)
        left, inside, right = _codes(text[max(0, a - AROUND) : a]), _codes(text[a:b]), _codes(text[b : b + AROUND])
        row[AROUND - len(left) : AROUND] = left
        row[AROUND : AROUND + len(inside)] = inside + SYMBOLS
        row[AROUND + INSIDE : AROUND + INSIDE + len(right)] = right
        out.append(row)
    return out


def keyed(text: str, start: int) -> bool:
    return KEYWORD.search(text[max(0, start - AROUND) : start]) is not None


@dataclass
class Network:
    """Parameters, calibration (slope, shift) and thresholds (bare, keyed)."""

    embed: np.ndarray
    kernel: np.ndarray
    offset: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)
    reached: tuple[float, float, float] = (1.0, 1.0, 0.0)  # on findings kept apart: recall of both classes, false finds

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        return Network(
            draw(2 * SYMBOLS, EMBEDDING, s=0.3), draw(REACH * EMBEDDING, FILTERS, s=(2 / (REACH * EMBEDDING)) ** 0.5),
            np.zeros(FILTERS, np.float32), draw(FILTERS, s=0.2), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.offset, self.weight, self.bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, places = len(x), WIDTH - REACH + 1
        embedded = self.embed[x]
        columns = np.concatenate([embedded[:, k : k + places] for k in range(REACH)], axis=2)
        response = columns.reshape(n * places, -1) @ self.kernel
        response = response.reshape(n, places, FILTERS) + self.offset
        at = response.argmax(axis=1)
        top = np.maximum(np.take_along_axis(response, at[:, None], axis=1)[:, 0], 0)
        return top @ self.weight + self.bias[0], (columns, at, top)

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean logistic loss."""
        logit, (columns, at, top) = self.forward(x)
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        back = error[:, None] * self.weight[None, :] * (top > 0)
        rows = np.arange(len(x))[:, None]
        chosen = columns[rows, at]  # n, filters, reach * embedding
        kernel = np.einsum("nf,nfc->cf", back, chosen)
        embed = np.zeros_like(self.embed)
        for k in range(REACH):
            part = self.kernel[k * EMBEDDING : (k + 1) * EMBEDDING].T
            np.add.at(embed, x[rows, at + k].ravel(), (back[:, :, None] * part[None]).reshape(-1, EMBEDDING))
        return [embed, kernel, back.sum(0), error @ top, error.sum(keepdims=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 1024])[0] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.float32)

    def probable(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.probable(self.logits(x))

    def found(self, z: np.ndarray, after_key: np.ndarray) -> np.ndarray:
        """Whether logits reach the threshold of their class."""
        return self.probable(z) >= np.where(after_key, self.thresholds[1], self.thresholds[0])


def _made_up(n: int, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """Seeded findings (text, start, end, label) of kinds a sample may lack."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = lambda k: [pick(lower, int(rng.integers(2, 10))) for _ in range(k)]
    size = lambda a, b: int(rng.integers(a, b))
    secret = (
        lambda: pick(upper + lower + digits, size(20, 60)),
        lambda: pick(upper + lower + digits + "+/", size(24, 64)) + "=" * size(0, 3),
        lambda: pick(digits + "abcdef", size(24, 64)),
        lambda: pick(digits + "ABCDEF", size(32, 64)),
        lambda: pick(upper, 4) + pick(upper + digits, size(16, 20)),
        lambda: pick(lower, size(2, 5)) + "_" + pick(upper + lower + digits, size(20, 48)),
        lambda: "_".join(pick(lower, size(2, 5)) for _ in range(2)) + "_" + pick(upper + lower + digits, size(16, 40)),
        lambda: ".".join(pick(upper + lower + digits + "_-", size(20, 48)) for _ in range(3)),
    )
    plain = (
        lambda: "".join(words(size(3, 8)))[:60].ljust(16, "a"),
        lambda: "_".join(words(size(3, 6))) + pick(digits, 2),
        lambda: "-".join(words(size(3, 7))) + "-" + pick(digits, size(1, 4)),
        lambda: "/".join(words(size(3, 6))) + "/" + pick(digits, size(1, 5)) + ".html",
        lambda: "".join(w.capitalize() for w in words(size(3, 6))) + pick(digits, 1),
        lambda: pick(digits, size(16, 30)),
        lambda: f"{pick('12', 1)}{pick(digits, 3)}-{pick('01', 1)}{pick(digits, 1)}-{pick('012', 1)}{pick(digits, 1)}T{pick(digits, 2)}.{pick(digits, 8)}",
        lambda: pick(".-=_", 1) * size(16, 60) + pick(digits, size(0, 2)),
        lambda: ".".join(pick(digits, size(1, 4)) for _ in range(size(5, 9))),
        lambda: "".join(words(size(4, 8))).upper() + pick(digits, size(1, 3)),
        lambda: ".".join(words(size(3, 6))) + "." + pick(digits, 1) + ".com",
        lambda: "-".join(pick(digits, 4) for _ in range(4)),
    )
    before = ("", "key: ", "Authorization: Bearer ", "export X=", '{"value": "', "secret=", "password: ", "credential ", "auth=")
    out = []
    for i in range(n):
        label = i % 2
        value = (secret if label else plain)[int(rng.integers(len(secret if label else plain)))]()
        lead = " ".join(words(size(0, 5))) + " "
        if label or rng.random() < 0.2:
            lead += before[int(rng.integers(len(before)))]
        text = lead + value + ("" if rng.random() < 0.3 else " " + " ".join(words(size(1, 5))))
        out.append((text, len(lead), len(lead) + len(value), label))
    return out


def _labelled(text: str) -> list[tuple[bytes, int, bool]]:
    """Windows of a text's findings: label 1 where a pattern found it. Each of
    these comes once more among other surroundings."""
    spans = base_spans(text)
    out = []
    for s, e in candidates(text):
        found = any(a < e and s < b for a, _, b in spans)
        for w in windows(text, s, e):
            out.append((w, int(found), keyed(text, s)))
    for a, kind, b in spans:
        if kind == 0:  # the value behind the keyword, where it is no run of its own
            m = ASSIGN.match(text, a)
            if m and (m.end(2) - m.start(2) < 16):
                out.append((windows(text, m.start(2), b)[0], 1, True))
    blind = []
    for w, y, _ in out:
        if y:
            other = w.copy()
            other[:AROUND] = SYMBOLS - 1
            blind.append((other, 1, False))
    return [(w.tobytes(), y, k) for w, y, k in out + blind]


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, place, part, x, y, keyed): the labelled findings of every document.
    A document's findings are all for fitting (parts 2 to 4), all for
    calibration (part 0), or all for the test (part 1)."""
    ship(docs.sparkSession)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "place", "part", "x", "y", "keyed"]
        for batch in batches:
            rows = []
            for doc, t in zip(batch["doc"], batch["t"], strict=True):
                part = zlib.crc32(str(doc).encode()) % 5
                rows += [(doc, i, part, *f) for i, f in enumerate(_labelled(t))]
                if len(rows) >= SHARE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    texts = docs.select(F.xxhash64("doc_id").alias("doc"), whole_text(text).alias("t"))
    return texts.mapInPandas(extract, "doc long, place int, part int, x binary, y int, keyed boolean")


def _matrix(values: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int16).reshape(-1, WIDTH) if values else np.zeros((0, WIDTH), np.int16)


def train(docs: DataFrame, text: str = "text") -> Network:
    """Train and calibrate on the labelled findings of all documents and on
    made-up ones: three fifths to fit, one to calibrate, one to state what the
    thresholds reach (`reached`). The findings stay on the workers; parameters
    and counts of logits come back, of a size that does not depend on the data.
    The same documents give the same network."""
    made = [(windows(t, s, e)[0], y, keyed(t, s), i % 5) for i, (t, s, e, y) in enumerate(_made_up(MADE_UP))]
    made_x = np.stack([m[0] for m in made])
    made_y, made_key, made_part = (np.array([m[k] for m in made]) for k in (1, 2, 3))
    found = stored(labelled(docs, text), "findings")
    n = found.filter("part > 1").count()
    shares = max(1, -(-n // SHARE))
    net = fitted(found.filter("part > 1"), shares, made_x[made_part > 1], made_y[made_part > 1])
    # made-up findings count as often as they were fitted on
    cells = _cells(net.logits(made_x))
    counts = counted(found.filter("part < 2"), net) + [(int(p), int(y), bool(k), int(c), shares) for p, y, k, c in zip(made_part, made_y, made_key, cells, strict=True) if p < 2]
    part, y, key, cell, weight = (np.array(c) for c in zip(*counts, strict=True))
    apart, test = part == 0, part == 1
    net = calibrated(net, cell[apart], y[apart], key[apart].astype(bool), weight[apart])
    passed = net.found(_edges(cell), key.astype(bool))
    share = lambda of: float((weight * passed)[of].sum() / weight[of].sum()) if of.any() else float("nan")
    key = key.astype(bool)
    net.reached = (share(test & (y > 0) & ~key), share(test & (y > 0) & key), share(test & (y <= 0)))
    return net


@dataclass
class Adam:
    """Where fitting stands: parameters, their two moments and the steps taken."""

    net: Network
    first: list[np.ndarray]
    second: list[np.ndarray]
    steps: float = 0.0

    @staticmethod
    def fresh() -> Adam:
        net = Network.fresh()
        return Adam(net, [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()])

    def flat(self) -> np.ndarray:
        arrays = [*self.net.parts(), *self.first, *self.second]
        return np.concatenate([np.asarray(a, float).ravel() for a in arrays] + [np.array([self.steps])])

    @staticmethod
    def of(flat: np.ndarray) -> Adam:
        out, at = Adam.fresh(), 0
        for a in [*out.net.parts(), *out.first, *out.second]:
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        out.steps = float(flat[at])
        return out

    def epoch(self, x: np.ndarray, y: np.ndarray, seed: Sequence[int]) -> None:
        order = np.random.default_rng(seed).permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            self.steps += 1
            t = self.steps
            for p, g, m, v in zip(self.net.parts(), self.net.step(x[at], y[at]), self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _round_of_a_share(begin: Broadcast, made: Broadcast, epochs: range) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        share = int(group["share"].iloc[0])
        own = group.dropna(subset="x").sort_values(["doc", "place", "x"], kind="stable")
        x = np.concatenate([_matrix(list(own["x"])), made.value[0]])
        y = np.concatenate([own["y"].to_numpy(np.float32), made.value[1].astype(np.float32)])
        state = Adam.of(begin.value)
        for epoch in epochs:
            state.epoch(x, y, (SEED, epoch, share))
        return pd.DataFrame({"share": [share], "state": [state.flat()]})

    return one


def fitted(found: DataFrame, shares: int, made_x: np.ndarray, made_y: np.ndarray) -> Network:
    """Fit to the findings in `shares` shares by hash, each with all made-up
    ones. The shares go through a round of epochs side by side; its result is the
    mean of what they come to, added in a way that does not depend on the order."""
    context = found.sparkSession.sparkContext
    made, state = context.broadcast((made_x, made_y)), Adam.fresh()
    # a share without findings still has the made-up ones
    empty = found.sparkSession.range(shares).select(
        F.col("id").alias("share"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("doc", "place", "x", "y")]
    )
    rows = found.select(F.pmod(F.xxhash64("doc", "place", "x"), F.lit(shares)).alias("share"), "doc", "place", "x", "y").unionByName(empty)
    for epoch in range(0, EPOCHS, ROUND):
        begin = context.broadcast(state.flat())
        one = _round_of_a_share(begin, made, range(epoch, min(epoch + ROUND, EPOCHS)))
        each = rows.groupBy("share").applyInPandas(one, "share long, state array<double>").select(F.posexplode("state").alias("at", "value"))
        mean = each.groupBy("at").agg(exact_mean("value").alias("value")).toPandas().sort_values("at")
        state = Adam.of(mean["value"].to_numpy(float))
        begin.unpersist()
    return state.net


def _cells(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -FARTHEST, FARTHEST) * STEPS).astype(np.int64)


def _edges(cell: np.ndarray) -> np.ndarray:
    """The least logit of a cell; nothing lies below the first one."""
    return np.where(cell <= -FARTHEST * STEPS, -np.inf, cell / STEPS).astype(np.float32)


def counted(found: DataFrame, net: Network) -> list[tuple[int, int, bool, int, int]]:
    """How many findings there are per part, label, class and cell of the logit."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = shared.value.logits(_matrix(list(batch["x"])))
            yield batch[["part", "y", "keyed"]].assign(cell=_cells(z))

    cells = found.select("part", "y", "keyed", "x").mapInPandas(run, "part int, y int, keyed boolean, cell long")
    rows = cells.groupBy("part", "y", "keyed", "cell").agg(F.count(F.lit(1)).alias("n")).orderBy("part", "y", "keyed", "cell").collect()
    return [tuple(r) for r in rows]


def calibrated(net: Network, cell: np.ndarray, y: np.ndarray, after_key: np.ndarray, weight: np.ndarray) -> Network:
    """Fit slope and shift to findings kept apart, counted by the cells of their
    logits, then set for each class, of the thresholds at a cell's edge that find
    RECALL of its secrets, the most precise, and of these the lowest; 0.5 for a
    class without secrets."""
    z, a, b = (np.maximum(cell, -FARTHEST * STEPS) + 0.5) / STEPS, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        spread = weight * (p * (1 - p) + 1e-6)
        error = weight * (p - y)
        grad = np.array([(error * z).sum() + 1e-2 * (a - 1), error.sum() + 1e-2 * b])
        hessian = np.array([[(spread * z * z).sum() + 1e-2, (spread * z).sum()], [(spread * z).sum(), spread.sum() + 1e-2]])
        step = np.linalg.solve(hessian, grad)
        a, b = a - step[0], b - step[1]
    net.slope, net.shift = max(float(a), 1e-3), float(b)
    limits = []
    for group in (False, True):
        of = after_key == group
        if not (of & (y > 0)).any():
            limits.append(0.5)
            continue
        places = np.unique(cell[of & (y > 0)])
        from_on = lambda label: np.array([weight[of & ((y > 0) == label) & (cell >= c)].sum() for c in places])
        right, wrong = from_on(True), from_on(False)
        # thresholds that find enough, each at a secret's cell, from the lowest on
        enough = right >= right[0] - int((1 - RECALL) * right[0])
        precision = np.where(enough, right / (right + wrong), -1.0)
        # a hair below the edge, so that rounding loses no finding of the cell
        limits.append(float(net.probable(_edges(places[precision.argmax()]) - np.float32(1e-4))))
    net.thresholds = (limits[0], limits[1])
    return net


def findings(texts: list[str], net: Network) -> list[list[Span]]:
    """Per text all spans: those of the patterns, and candidates beside them
    that the network scores at or above the threshold."""
    out = [base_spans(t) for t in texts]
    rows, owner = [], []
    for i, text in enumerate(texts):
        for s, e in candidates(text):
            if not any(a < e and s < b for a, _, b in out[i]):
                parts = windows(text, s, e)
                rows += parts
                owner += [(i, s, e)] * len(parts)
    if rows:
        best: dict[tuple[int, int, int], float] = {}
        for key, score in zip(owner, net.scores(np.stack(rows)), strict=True):
            best[key] = max(best.get(key, 0.0), float(score))
        for (i, s, e), score in best.items():
            if score >= net.thresholds[keyed(texts[i], s)]:
                out[i].append((s, 3, e))
    return [sorted(spans) for spans in out]


def _portions(texts: pd.Series) -> Iterator[list[str]]:
    """Texts a few million characters at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > 2_000_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(docs: DataFrame, net: Network, text: str = "text", name: str = "spans") -> DataFrame:
    """Add `spans`, an array of (start, end, kind) by start and kind, in code
    points of the whole text. A NULL or empty text has none, however long a text
    is it is read whole, and repeated rows are scanned alike. A column called
    `name` is replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.pandas_udf("array<struct<start: long, end: long, kind: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [spans for texts in _portions(batch) for spans in findings(texts, shared.value)]
            yield pd.Series([[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans] for spans in found], dtype="object")

    return docs.withColumn(name, run(whole_text(text)))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or stretch of overlapping ones, replaced."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` with secrets in `text` replaced; `n_chars`, if there, counted anew
    where something was. Same rows and columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [x for texts in _portions(batch) for x in zip(texts, findings(texts, shared.value), strict=True)]
            yield pd.Series([redact(t, [(s, e) for s, _, e in spans]) if spans else None for t, spans in found], dtype="object")

    out = docs.withColumn("__new", run(whole_text()))
    values = {"text": F.coalesce("__new", "text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(F.char_length("__new").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
