"""BPE as a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that merging
would produce. It starts as one state with an arc for every base symbol; each
merge (u, v) -> w, in order of priority, is one gadget: the state after u is
copied without its arc v, the u arcs are led to the copy, and w is an arc
wherever u could be followed by v, leading to where v led. A copy differs from
its origin by one missing arc, so states are kept as "what v's state was then,
less these arcs", and an arc's presence is looked up by walking those origins.

A word is encoded by running over its symbols: for every prefix there is one
last token whose arc leaves the state of the token before it. Looked-up arcs
are kept in a transition table. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import Memo, ship, whole_text

NEVER = 1 << 30
END = 256  # the symbol after the last byte of a word
TABLE_ROWS = 2_000_000  # arcs a worker keeps looked up
PORTION = 256  # texts a worker holds as strings, with their codes
PORTION_BYTES = 1_000_000  # from this size of texts on, fewer


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Automaton:
    """Merge gadgets over `merges`, pairs of token strings by priority."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], end: str):
        size = max(vocab.values(), default=-1) + 1
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.cut: list[dict[int, int] | None] = [None] * size
        live = {t: i for t, i in vocab.items()}
        for m, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            if not self._arc(u, v, m):  # never side by side at that point
                live.pop(a + b, None)
                continue
            self.born[w], self.left[w], self.right[w] = m, u, v
            if self.cut[u] is None:
                self.cut[u] = {}
            self.cut[u][v] = m
        # labels as bytes, the end mark as one symbol more, in a trie
        code = {c: i for i, c in enumerate(byte_letters())}
        self.step: dict[int, int] = {}
        self.token = [-1]
        for label, i in live.items():
            marked = bool(end) and label.endswith(end)
            path = [code[c] for c in (label[: -len(end)] if marked else label)] + [END] * marked
            node = 0
            for x in path:
                if node << 9 | x not in self.step:
                    self.step[node << 9 | x] = len(self.token)
                    self.token.append(-1)
                node = self.step[node << 9 | x]
            self.token[node] = i
        self.tail = [END] if end else []
        self.table: dict[int, bool] = {}

    def _arc(self, state: int, token: int, before: int) -> bool:
        """Whether the state after token `state` has the arc `token` when the
        gadgets of merges below `before` are in place."""
        born, left, right, cut = self.born, self.left, self.right, self.cut
        while True:
            at, limit = state, before
            while True:
                gone = cut[at]
                if gone is not None and gone.get(token, NEVER) < limit:
                    return False
                if born[at] < 0:
                    break
                limit = min(limit, born[at])
                at = right[at]
            m = born[token]
            if m < 0:
                return True
            # a token made of two equal halves cannot follow that half
            before = m + (left[token] == right[token])
            token = left[token]

    def follows(self, state: int, token: int) -> bool:
        key = state << 32 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ROWS:
                self.table.clear()
            known = self.table[key] = self._arc(state, token, NEVER)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word.

        Walks the arcs from the longest label down. A position has one valid
        path to it, so one that leads nowhere is never entered again."""
        if not word:
            return []
        text = [*word, *self.tail]
        n, step, tokens, follows = len(text), self.step, self.token, self.follows
        ids: list[int] = []
        untried: list[list[tuple[int, int]]] = []  # per position on the path
        places: list[int] = []
        dead: set[int] = set()
        at = 0
        while True:
            arcs, node = [], 0
            for k in range(at, n):
                node = step.get(node << 9 | text[k])
                if node is None:
                    break
                if tokens[node] >= 0:
                    arcs.append((tokens[node], k + 1))
            untried.append(arcs)
            places.append(at)
            while True:
                if not arcs:  # back to the token before
                    dead.add(places.pop())
                    untried.pop()
                    if not untried:
                        raise ValueError(f"no path spells {word!r}")
                    arcs = untried[-1]
                    ids.pop()
                    continue
                token, to = arcs.pop()
                if to not in dead and (not ids or follows(ids[-1], token)):
                    break
            ids.append(token)
            if to == n:
                return ids
            at = to


class Codec:
    """Pre-splitting, the automaton and its labels, from a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        size = max([*model["vocab"].values(), *self.special.values()], default=-1) + 1
        self.labels = [""] * size
        for label, i in [*model["vocab"].items(), *self.special.items()]:
            self.labels[i] = label
        self.of_word = Memo(self._word)
        self.of_piece = Memo(self._piece)

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.encode(word.encode()), "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a run without ASCII white space; such white space always ends
        a word, so a text's ids are those of its pieces."""
        text, out = piece.decode(), []
        for part in self.cutter.split(text) if self.cutter and "<" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            low = part if part.isascii() else unicodedata.normalize("NFC", part)
            # letter by letter: a final sigma is no special case
            low = "".join([c.lower() for c in low]) if "\u03a3" in low else low.lower()
            out += [self.of_word[w] for w in self.words.findall(low)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        of_piece, raw = self.of_piece, text.encode()
        if b"<" not in raw:  # no special token, whose case would matter
            raw = raw.lower()
        return b"".join([of_piece[p] for p in raw.split()])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, space-joined as a file without decoder asks."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[str, Codec] = {}


def codec(text: str) -> Codec:
    """The codec of a tokenizer file's text, built once per worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(text)
    return _codecs[key]


def portions(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of texts. A batch has rows by the thousand: as strings,
    ids and decoded texts at once it would be many times its size."""
    each = max(1, min(PORTION, PORTION_BYTES * len(batch) // max(batch.nbytes, 1)))
    for at in range(0, len(batch), each):
        yield batch.slice(at, each)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (binary, little-endian unsigned 32-bit) and, if named, `decoded`.

    A NULL text counts as empty; empty texts and texts of white space have no
    ids and decode to the empty string. Every row is encoded, repeated ones
    alike. Columns of the same names as the results are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    # a vocabulary file: its size does not depend on the data
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = codec(shared.value)
        for batch in batches:
            for texts in portions(batch):
                out = [codes.encode(t) for t in texts.to_pylist()]
                back = [codes.decode(x) if decoded else None for x in out]
                yield pa.StructArray.from_arrays([pa.array(out, kind[0].type), pa.array(back, kind[1].type)], fields=list(kind))

    made = docs.withColumn("__codes", run(whole_text(text)))
    columns = [c for c in docs.columns if c not in (ids, decoded)]
    results = [F.col("__codes.ids").alias(ids)] + ([F.col("__codes.decoded").alias(decoded)] if decoded else [])
    return made.select(*[F.col(f"`{c}`") for c in columns], *results)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the decoded text."""
    coded = encode(docs.select("doc_id", "text"), tokenizer, ids="ids", decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
