"""Fingerprints, trie join, components and deduplication by brute force."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from impactspark.llm import graph, simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_by_brute_force(some_docs, awkward, no_docs):
    for docs in (some_docs, awkward):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
        got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
        prints = sorted({f for _, f in rows})
        cls = roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
        least = {}
        for d, f in rows:
            if d is not None:
                least[cls[f]] = min(d, least.get(cls[f], d))
        assert got == sorted(((d, f, least.get(cls[f])) for d, f in rows), key=str)
    assert simhash.near_duplicates(no_docs).collect() == []


def _values():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [base]
    for _ in range(3):
        near.append(near[-1] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    return np.unique(np.concatenate([*near, rng.integers(0, 2000, 200).astype(np.uint64)]))


def test_trie_join_finds_every_pair_once(spark):
    v = _values()
    far = np.bitwise_count(v[:, None] ^ v[None, :])
    for budget in (0, 1, 2, 3):
        want = sorted((int(i), int(j)) for i, j in zip(*np.where(far <= budget), strict=True) if i < j)
        assert sorted((int(i), int(j)) for a, b in simhash.trie_pairs(v, v, True, budget) for i, j in zip(a, b, strict=True)) == want
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(v.view(np.int64))], "fp long, id long")
    want = sorted((int(i), int(j)) for i, j in zip(*np.where(far <= 2), strict=True) if i < j)
    # even blocks, and blocks that are cut deeper because they are too large
    for depth, size in ((0, None), (3, None), (2, 40)):
        got = simhash.links(nodes, 2, depth=depth, size=size).collect()
        assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in got) == want, (depth, size)
    forest = simhash.links(nodes, 2, forest=True, depth=3).collect()
    assert roots(range(len(v)), [(r.a, r.b) for r in forest]) == roots(range(len(v)), want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    links = [*chain, *star, (500, 400), (400, 500), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {n: r for n, r in roots({x for e in links for x in e}, links).items() if n != r}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_one_of_each_group_stays(spark, awkward, no_docs):
    text = " ".join(f"w{i * i % 1009}" for i in range(300))
    edited = text.replace(" w4 ", " changed ")
    other = " ".join(f"v{i * i % 1013}" for i in range(300))
    rows = [(3, text, "x"), (1, edited, "y"), (2, other, "z"), (2, other, "z"), (None, text, None), (5, None, None), (4, "", None)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4]
    assert {r.doc_id: r.fp for r in kept} == {1: "y", 2: "z", 4: None}
    out = simhash.deduplicated(awkward)
    assert out.columns == awkward.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {4, 5, 7, 8, 9, 11} <= set(ids) and 6 not in ids
    assert simhash.deduplicated(no_docs).collect() == []


def test_links_of_bits_alone_drop_nothing(spark, monkeypatch):
    # all fingerprints one class: only the shingles decide
    monkeypatch.setattr(simhash, "links", lambda nodes, *a, **k: nodes.crossJoin(nodes.selectExpr("min(id) AS m")).selectExpr("id AS a", "m AS b"))
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(10 * k + j, t + (" end" if j else "")) for k, t in enumerate(texts) for j in range(3)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 10, 20]


def test_all_pairs_of_a_mixed_class_are_met(spark, monkeypatch):
    # one class whose members share a third of their text, so that the least shingle is often the passage's
    monkeypatch.setattr(simhash, "links", lambda nodes, *a, **k: nodes.crossJoin(nodes.selectExpr("min(id) AS m")).selectExpr("id AS a", "m AS b"))
    monkeypatch.setattr(simhash, "TOGETHER", 16, raising=False)
    passage = [f"p{i}" for i in range(40)]
    texts = {}
    for k in range(60):
        own = [f"d{k}w{i}" for i in range(80)]
        texts[k] = passage + own
        if k % 2:
            # a copy with edits: from well over the similarity to under it
            copy = [*own]
            for i in range(k % 7):
                copy[9 + 11 * i] = "edit"
            texts[100 + k] = passage + copy
    sets = {k: set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for k, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = [k for k in sets if not any(alike(k, q) for q in sets if q < k)]
    assert 60 < len(want) < len(sets) - 10
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(frame).collect()) == sorted(want)


def test_prefix_join_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):  # small sets over few values, two classes, sizes around each other
        rows.append((i % 2, i, sorted(rng.choice(14, rng.integers(1, 13), replace=False).tolist())))
    frame = spark.createDataFrame(rows, "root long, __row long, __s array<long>").selectExpr("root", "__row", "struct(false AS nameless, __row AS id, __row) AS __first", "__s")
    want = {r for c, r, s in rows if any(d == c and q < r and len({*s} & {*t}) >= 0.8 * len({*s} | {*t}) for d, q, t in rows)}
    assert 20 < len(want) < 140
    assert {r["__row"] for r in simhash.alike_rows(frame, 0.8).collect()} == want
