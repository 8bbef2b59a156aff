"""Filter audit, Merkle manifest and toxicity against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from impactspark.llm import audit, merkle, queries, toxicity
from impactspark.sources.folders import fresh_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text: str) -> list[bool]:
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]


def plain_audit(docs, labels):
    """Rows of the report from (doc_id, text, source) and (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, source in docs:
        text = text or ""
        bits = [*fails(text), d is not None and d > least[text]]
        parts[source or ""].append((dict(zip("ABCDE", bits, strict=True)), d in good, d in toxic))
    out, removed = [], Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            for i, c in enumerate(order):
                gone = lambda f, k: any(f[x] for x in order[:k])
                here = [r for r in rows if r[0][c] and not gone(r[0], i)]
                removed[part, c] += len(here)
                out.append((part, "".join(order), i + 1, sum(not gone(f, i + 1) for f, *_ in rows), len(here), sum(f[c] and gone(f, i) for f, *_ in rows),
                            sum(f[c] and sum(f.values()) == 1 for f, *_ in rows), sum(g for _, g, _ in here), sum(t for *_, t in here)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("batches", [1, 20])
def test_audit_takes_back(spark, awkward, batches, monkeypatch):
    monkeypatch.setattr(audit, "HELD_TEXTS", 3)
    rng = random.Random(5)
    body = [" ".join(f"w{rng.randrange(40 * (k + 1))}" for _ in range(rng.choice((3, 150, 260)))) for k in range(9)] + ["A B C", "", None, "x | y"]
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    rows += [(rng.choice((None, *range(100, 160))), rng.choice(body), rng.choice(("a", "b", None, ""))) for _ in range(300)]
    rows += [(1000 - i, "copied everywhere", "hot") for i in range(150)]  # each id is smaller than all before
    path = fresh_dir(spark, "docs")
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, part string, mask int")
    for k in range(5):
        frame.filter(f"pmod(coalesce(doc_id, 3), 5) = {4 - k}").coalesce(1).write.mode("append").parquet(path)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 200)] + [(5, 0, 1), (5, 1, None), (None, 1, 1), (900, 1, 1)]
    found = audit.audit(spark, path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), batches)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == plain_audit(rows, labels)
    assert dict(found.dtypes)["step"] == "int" and {dict(found.dtypes)[c] for c in COLUMNS[3:]} == {"bigint"}


def test_audit_of_nothing(spark, no_docs):
    path = fresh_dir(spark, "docs")
    no_docs.write.parquet(path)
    assert audit.audit(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and per leaf its path of (before, after)."""
    paths = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(i, min(i + 8, len(leaves))) for i in range(0, len(leaves), 8)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    paths[i].append((leaves[run[0] : k], leaves[k + 1 : run[-1] + 1]))
        under = [[i for k in run for i in under[k]] for run in runs]
        leaves = [sha(*(leaves[k] for k in run)) for run in runs]
    return leaves[0], paths


def plain_manifest(rows):
    def leaf(r, text):
        values = (r[0], r[3], r[2], r[4], text)
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] is not None, (r[2] or "").encode())].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    trees = {g: plain_tree([x[2] for x in sorted(own, key=lambda x: x[:3])]) for g, own in groups.items()}
    order = sorted(trees)
    root, over = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, over, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            at = own
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                at = leaf(r, r[1].translate(lower))
            for before, after in path + up:
                at = sha(*before, at, *after)
            out.append((str(r[0]), own, trees[g][0], root, sha(*(h for b, a in path + up for h in b + a)), at, at == root))
    return sorted(out)


def test_manifest(spark, awkward, no_docs):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r[c] for c in names) for r in awkward.collect()]
    rows += [(i % 640, f"Text {i % 650}" if i % 7 else None, "en", "s", i % 5 or None) for i in range(1300)]  # three rounds of blocks, ids twice
    rows += [(i, "SAME", f"l{i:02}é", "s", 1) for i in range(20)] + [(3, "Twice", "de", None, 1)] * 9
    for own in (rows, rows[:1], rows[-9:], [(1, "a", "x", None, None), (2, "B", None, None, None)]):
        frame = spark.createDataFrame([(*r, "clash", 1, "c") for r in own], "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, leaf string")
        got = [(str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(frame).collect()]
        assert sorted(got) == plain_manifest(own)
    assert merkle.manifest(no_docs).collect() == []


def distance(a: str, b: str) -> int:
    """Edits, swaps of neighbours included."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i])
        for j in range(1, len(b) + 1):
            d = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, rows[i - 2][j - 2] + 1)
            rows[i].append(d)
    return rows[-1][-1]


def test_automaton_is_exact():
    terms = [toxicity.Term(t, stem, 1.0) for t, stem in (("idiot", False), ("scum", False), ("moron", False), ("worthless", False), ("bocas", True), ("achlichen", True), ("losing", False), ("loser", True))]
    automaton = toxicity.Automaton(terms, limit=40)
    rng = random.Random(2)
    words = {"", "x", "idoit", "idiiot", "morno", "wortless", "worhtlses", "bocsa", "ahclichx", "scums", "scm"}
    for t in terms:
        for _ in range(150):
            w = list(t.text) + [rng.choice("abz") for _ in range(rng.choice((0, 0, 2)))]
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w))
                w[k : k + 2] = rng.choice(([], w[k : k + 1], [rng.choice("aeos"), *w[k : k + 2]], [rng.choice("aeos"), *w[k + 1 : k + 2]], w[k : k + 2][::-1])) or ["q"]
            words.add("".join(w))
    for w in sorted(words):
        near = []
        for i, t in enumerate(terms):
            edits = min(distance(w[:k], t.text) for k in (range(len(w) + 1) if t.stem else [len(w)]))
            if edits <= toxicity.edits_allowed(len(t.text)):
                near.append((edits, i))
        assert automaton.find(w) == min(near, default=toxicity.NOTHING), w


def test_spellings():
    assert toxicity.spellings("Idiot!!") == ["idiot"] and toxicity.spellings("1d10t,") == ["d", "t", "idiot"]
    assert "idiot" in toxicity.spellings("i.d.i.o.t") and toxicity.spellings("||") == toxicity.spellings("12") == []


def test_toxicity(spark, awkward, no_docs):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = toxicity.scored(docs, model).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    hit = np.mean([r.predicted for r in held if r.toxic])
    false = np.mean([r.predicted for r in held if not r.toxic])
    assert len(held) > 500 and hit > 0.9 and false < 0.01
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert again.lexicon.terms == model.lexicon.terms and (again.weights == model.weights).all()
    s = model.score
    assert s("you are an idiot") > 0.9 and s("you idoit, st0pid m0ron!") > 0.9 and s("you are a teacher") < 0.1 and 0 < s("") < 0.1
    assert s('The word "idiot" is an insult, says the dictionary of our language, and was a term of law') < 0.3
    rows = toxicity.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.scored(no_docs, model).collect() == []
    nothing = toxicity.train(no_docs, labels)
    assert nothing.lexicon.terms == [] and {r.predicted for r in toxicity.scored(awkward, nothing).collect()} == {0}
    assert toxicity.train(awkward, labels.filter("toxic = 0")).lexicon.terms == []


def test_audit_query_names():
    assert {"op11_filter_audit", "op12_merkle_manifest"} <= set(queries.ORACLES) and "op13_levenshtein_lexicon" in queries.QUERIES


def test_counts_of_tasks_that_find_nothing(spark):
    """A task of no rows, or of texts without any find, adds nothing and does not fail."""
    rows = spark.createDataFrame([("a b",), ("",), ("b",)], "text string").repartition(8)
    assert toxicity._sums(rows, str.split) == {"a": 1, "b": 2}
    assert toxicity._sums(rows, lambda text: ()) == {}
    assert toxicity._sums(rows.limit(0), str.split) == {}
