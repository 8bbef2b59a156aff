"""Toxicity: a learned lexicon, misspellings included, read in context.

Terms are words and stems that labelled toxic documents hold far more often
than others. They form a trie; the Levenshtein automata of all terms run over a
word together, as sets of (trie node, edits), so that one automaton, made
deterministic as words come, finds the nearest term within its number of edits.
A find counts by its term's log-odds and by its context: quotation marks and
words of mention around it speak for quotation, words of address, exclamation
and other finds nearby for abuse. A logistic model over a document's sums gives
the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import Memo, ship, stored, whole_text
from impactspark.llm.nbsvm import HELD_OUT, fold

FIT_ROWS = 12_000  # labelled rows that terms and weights are learned from, at most
LEAST_TOXIC = 5  # toxic documents a term occurs in
LEAST_GAIN = 20.0  # log-likelihood ratio of a term
MOST_TERMS = 500
STEM = (4, 12)  # letters of a stem
THRESHOLD = 0.5
REACH = 6  # words on either side of a find

# Signs that stand for letters, and words of mention and of address.
LOOKALIKES = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
QUOTES = "\"'“”„«»‘’‹›`"
MENTION = frozenset(
    "word words term terms called call calls said says say wrote writes quote quoted quotes saying phrase slur insult insults means meaning "
    "wort begriff sagte schrieb nannte zitat mot terme dit écrit citation palabra término dijo escribió llamó cita".split()
)
ADDRESS = frozenset("you your youre yours u ur are du dein deine dich bist ihr euch tu toi ton ta vous votre es eres tú usted ustedes".split())
# weights of the context: what it starts from, and what each sign adds
START, QUOTED, MENTIONED, ADDRESSED, EXCLAIMED, CROWDED = 1.5, -2.5, -1.5, 1.0, 0.5, 1.0

_letters = re.compile(r"[^\W\d_]+")


def spellings(token: str) -> list[str]:
    """The words of a token, and what it reads with signs taken for letters or
    with single letters put together."""
    low = token.lower()
    found = _letters.findall(low)
    if len(found) > 2 and all(len(x) == 1 for x in found):
        found.append("".join(found))
    elif low.isalpha():
        return found
    core = low.strip(".,;:!?()[]{}*#%&-" + QUOTES)
    if not core.isalpha() and any(c.isalpha() for c in core):
        found += [x for x in _letters.findall(core.translate(LOOKALIKES)) if x not in found]
    return found


def stems(word: str) -> list[str]:
    low, high = STEM
    return [word[:k] for k in range(low, min(high, len(word) - 1) + 1)]


def terms_of(text: str) -> set[str]:
    """Words, as `=word`, and stems, as `^stem`, of a text."""
    words = {w for t in set(text.split()) for w in spellings(t)}
    return {f"={w}" for w in words} | {f"^{s}" for w in words for s in stems(w)}


def gain(up: int, down: int, ups: int, downs: int) -> float:
    """Log-likelihood ratio of a term in `up` of `ups` and `down` of `downs`
    documents; negative where it is rarer in the former."""
    total, out = ups + downs, 0.0
    for n, row, column in ((up, up + down, ups), (down, up + down, downs), (ups - up, total - up - down, ups), (downs - down, total - up - down, downs)):
        if n:
            out += n * math.log(n * total / (row * column))
    return 2 * out if up * downs >= down * ups else -2 * out


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Term:
    text: str
    stem: bool
    weight: float  # log-odds of a find as it stands
    fuzzy: float = 0.0  # of a find with edits


def choose(counts: Iterable[tuple[str, int, int]], ups: int, downs: int) -> list[Term]:
    """Terms from (term, toxic documents, others), the best first; of a word and
    its stems, and of a stem and longer ones, only the best."""
    ranked = sorted(((gain(up, down, ups, downs), len(t), t, up, down) for t, up, down in counts if up >= LEAST_TOXIC), reverse=True)
    taken: list[Term] = []
    for value, _, t, up, down in ranked:
        if value < LEAST_GAIN or len(taken) == MOST_TERMS:
            break
        name = t[1:]
        if any(name.startswith(x.text) or x.text.startswith(name) for x in taken):
            continue
        odds = math.log((up + 0.5) / (ups + 1)) - math.log((down + 0.5) / (downs + 1))
        taken.append(Term(name, t[0] == "^", odds, 0.75 * odds))
    return taken


class Trie:
    """Terms as a trie: children by letter, terms that end, edits still of use below."""

    def __init__(self, terms: list[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.allowed = [0]
        for i, t in enumerate(terms):
            at, most = 0, edits_allowed(len(t.text))
            self.allowed[0] = max(self.allowed[0], most)
            for c in t.text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.allowed.append(0)
                at = self.children[at][c]
                self.allowed[at] = max(self.allowed[at], most)
            self.ends[at] = i


NOTHING = (9, -1)  # edits and term of no find


class Automaton:
    """The Levenshtein automata of all terms over their trie, made deterministic
    state by state. A state is a set of (node, edits, letter that a swap still
    owes); edits are insertions, deletions, substitutions and swaps of
    neighbours. `find` gives edits and number of the nearest term, or NOTHING."""

    def __init__(self, terms: list[Term], limit: int = 200_000):
        self.terms, self.trie = terms, Trie(terms)
        self.most = [edits_allowed(len(t.text)) for t in terms]
        self.states: list[tuple] = []
        self.numbers: dict[frozenset, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.best: list[tuple[int, int]] = []  # of words that end here
        self.passed: list[tuple[int, int]] = []  # of stems that end here
        self.limit = limit
        self._number(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """With letters of a term left out; per node the fewest edits only."""
        fewest: dict[tuple, int] = {}
        queue = list(items)
        while queue:
            node, edits, owed = queue.pop()
            if edits > self.trie.allowed[node] or fewest.get((node, owed), 9) <= edits:
                continue
            fewest[node, owed] = edits
            if not owed:
                queue += [(child, edits + 1, "") for child in self.trie.children[node].values()]
        return frozenset((n, e, o) for (n, o), e in fewest.items())

    def _number(self, state: frozenset) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
            ends = [(e, self.trie.ends[n]) for n, e, o in state if not o and self.trie.ends[n] >= 0 and e <= self.most[self.trie.ends[n]]]
            self.best.append(min((x for x in ends if not self.terms[x[1]].stem), default=NOTHING))
            self.passed.append(min((x for x in ends if self.terms[x[1]].stem), default=NOTHING))
        return number

    def _step(self, number: int, letter: str) -> int:
        out = set()
        for node, edits, owed in self.states[number]:
            children = self.trie.children[node]
            if owed:
                if letter == owed[0]:  # the swapped pair is complete
                    out.add((self.trie.children[children[owed[0]]][owed[1]], edits, ""))
                continue
            if letter in children:
                out.add((children[letter], edits, ""))
            if edits < self.trie.allowed[node]:
                out.add((node, edits + 1, ""))  # a letter too many
                for other, child in children.items():
                    if other != letter:
                        out.add((child, edits + 1, ""))
                    if letter in self.trie.children[child] and letter != other:
                        out.add((node, edits + 1, other + letter))
        return self._number(self._closed(out))

    def find(self, word: str) -> tuple[int, int]:
        if len(self.states) > self.limit:  # begin anew: states are a cache of the automaton
            self.__init__(self.terms, self.limit)
        at, found = 0, NOTHING
        for letter in word:
            arcs = self.arcs[at]
            to = arcs.get(letter)
            if to is None:
                to = arcs[letter] = self._step(at, letter)
            at = to
            if not self.states[at]:
                return found
            found = min(found, self.passed[at])
        return min(found, self.best[at])


@dataclass
class Lexicon:
    """Terms, their automaton, and words near a term that are no misspelling."""

    terms: list[Term] = field(default_factory=list)
    plain: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.terms)
        self.known = Memo(self._weigh)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "plain": self.plain}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def find(self, word: str) -> tuple[int, int]:
        edits, at = self.automaton.find(word)
        return NOTHING if edits and word in self.plain else (edits, at)

    def _weigh(self, token: str) -> tuple[float, str]:
        """The heaviest find in a token, and its word; (0, '') if there is none."""
        best = (0.0, "")
        for word in spellings(token):
            edits, at = self.find(word)
            if at >= 0:
                term = self.terms[at]
                best = max(best, (term.fuzzy if edits else term.weight, word))
        return best


def context(tokens: list[str], finds: list[int], at: int) -> float:
    """From 0, quotation, to 1, abuse, for the token `finds[at]`."""
    i = finds[at]
    before, after = tokens[max(0, i - REACH) : i], tokens[i + 1 : i + 1 + REACH]
    own = tokens[i]
    opened = next((k for k, t in enumerate(reversed([*before, own])) if t[0] in QUOTES), None)
    closed = next((k for k, t in enumerate([own, *after]) if t.rstrip(".,;:!?")[-1:] in QUOTES), None)
    shut = opened and any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in [*before, own][-1 - opened : -1])
    quoted = opened is not None and closed is not None and not shut
    near = {w for t in [*before, *after] for w in _letters.findall(t.lower())}
    crowd = sum(1 for j in (at - 1, at + 1) if 0 <= j < len(finds) and abs(finds[j] - i) <= REACH)
    z = START + QUOTED * quoted + MENTIONED * bool(near & MENTION) + ADDRESSED * bool(near & ADDRESS)
    z += EXCLAIMED * any("!" in t for t in (own, *after)) + CROWDED * bool(crowd)
    return 1 / (1 + math.exp(-z))


# what `features` gives: a constant, abuse, abuse by length, the strongest find, forms, quotation, length;
# the weights that fitting starts from, and how firmly it holds them: few labelled texts quote
PRIOR = np.array([-3.0, 1.0, 1.0, 0.3, 1.0, -0.5, 0.0])
TRUST = np.array([0.5, 0.5, 0.5, 0.5, 0.5, 1000.0, 0.5])


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Sums over a text's finds; all zero but for the length without any."""
    tokens = text.split()
    known = lexicon.known
    finds = [i for i, t in enumerate(tokens) if known[t][0] > 0]
    length = math.log1p(len(tokens))
    if not finds:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, length]
    abuse = quotation = most = 0.0
    forms = set()
    for k, i in enumerate(finds):
        weight, word = known[tokens[i]]
        share = context(tokens, finds, k)
        abuse += share * weight
        quotation += (1 - share) * weight
        most = max(most, share * weight)
        if share > 0.5:
            forms.add(word)
    return [1.0, math.log1p(abuse), math.log1p(100 * abuse / (len(tokens) + 20)), most, math.log1p(len(forms)), math.log1p(quotation), length]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to `PRIOR`: without labels they are it."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + TRUST * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(TRUST)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, features(text, self.lexicon)))
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def with_spelling(terms: list[Term], found: Iterable[tuple[str, int, int]], ups: int, downs: int) -> Lexicon:
    """A lexicon whose terms' finds with edits weigh what (word, toxic documents,
    others) of such words say; few say little, and the weight stays near three
    quarters of the term's. Words that clean documents use are no misspellings."""
    rough, plain = Automaton(terms), set()
    seen = [Counter(), Counter()]
    for word, up, down in found:
        if down >= 3 and up * downs < 3 * down * ups:
            plain.add(word)
            continue
        at = rough.find(word)[1]
        seen[0][at] += up
        seen[1][at] += down
    few = 2 / max(downs, 1)
    for i, t in enumerate(terms):
        t.fuzzy = math.log((seen[0][i] / max(ups, 1) + few * math.exp(0.75 * t.weight)) / (seen[1][i] / max(downs, 1) + few))
    return Lexicon(terms, frozenset(plain))


def _counts(of: Callable[[str], Iterable[str]]) -> Callable:
    """A counter per task of what `of(text)` gives, as rows (what, n); a task
    without any gives no batch, since empty columns have no type of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(of(text))
        if seen:
            yield pd.DataFrame({"what": list(seen), "n": list(seen.values())})

    return run


def _sums(rows: DataFrame, of: Callable[[str], Iterable[str]], least: int = 1) -> dict[str, int]:
    found = rows.select("text").mapInPandas(_counts(of), "what string, n long")
    return {r.what: r.n for r in found.groupBy("what").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learn terms and weights from labelled documents (doc_id, text) outside
    the held-out fold: at most `rows`, those whose ids have the smallest hashes
    (ties by id and label). Equal texts of one label count once, and of rows
    with the same id the smallest text has part.

    Rows with a NULL label or id have no part, and a NULL text is empty. With no
    labels, or one class alone, there are no terms and every score is low. What
    comes to the driver is bounded by `rows`: terms of five toxic documents or
    more, words near a term, and seven numbers a document.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select("doc_id", (F.col(label) > 0).cast("int").alias("y")).dropna().filter(fold() != HELD_OUT).distinct()
    few = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(rows).drop("h")
    # `few` has at most `rows` rows
    met = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(few), "doc_id")
    sample = stored(met.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text").distinct(), "labelled")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    ups, downs = n.get(1, 0), n.get(0, 0)
    if not ups or not downs:
        return Model(Lexicon(), PRIOR)
    toxic, others = sample.filter("y = 1"), sample.filter("y = 0")
    up = _sums(toxic, terms_of, LEAST_TOXIC)
    wanted = spark.sparkContext.broadcast(frozenset(up))
    down = _sums(others, lambda text: terms_of(text) & wanted.value)
    terms = choose([(t, k, down.get(t, 0)) for t, k in up.items()], ups, downs)
    rough = spark.sparkContext.broadcast(Lexicon(terms))

    def near(text: str) -> set[str]:
        words = {w for t in set(text.split()) for w in spellings(t)}
        return {w for w in words if 0 < rough.value.find(w)[0] < NOTHING[0]}

    up, down = _sums(toxic, near), _sums(others, near)
    lexicon = with_spelling(terms, sorted((w, up.get(w, 0), down.get(w, 0)) for w in {*up, *down}), ups, downs)
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def inputs(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, shared.value) for t in texts], dtype="object")

    found = sample.select("y", inputs("text").alias("x")).toPandas()
    x, y = np.array(found["x"].tolist()), found["y"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # sums in an order of their own: the same weights on any cluster
    return Model(lexicon, fit(x[order], y[order]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.
    Only the text has a part in the score: equal texts score alike, whatever
    their length, and a NULL text is empty. A NULL id counts as the empty text
    for `held_out`. An empty table gives no rows; other columns do not matter."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_TERMS terms

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    out = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), run(whole_text()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
