"""Automaton and id files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from impactspark.llm import bpe, dac

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def codes():
    return bpe.Codec(open(PATH, encoding="utf-8").read())


def binary(ids):
    return np.array(ids, "<u4").tobytes()


def test_small_automaton_by_hand():
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    auto = bpe.Automaton({x: i for x, i in vocab.items()}, [("a", "a"), ("a", "b"), ("a", "ab")], "")
    names = {i: x for x, i in vocab.items()}
    spell = lambda w: [names[i] for i in auto.encode(w)]
    assert spell(b"aaa") == ["aa", "a"]
    assert spell(b"aab") == ["aa", "b"]
    assert spell(b"aaab") == ["aa", "ab"]
    assert spell(b"") == []


def test_random_texts_equal_the_library(library, codes):
    random.seed(4)
    pieces = "a b th e he in İ Σ ß é é 's 'll 1 ２ <|endoftext|> <|startoftext|> <| 中 文 🙂 AAAA haha !!! ... ﬁ ς \x00 ०".split(" ") + [" ", "\n", "\x1c", " ", "́"]
    for _ in range(4000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codes.encode(text) == binary(ids), text
        assert codes.decode(binary(ids)) == library.decode(ids, skip_special_tokens=False)
    for _ in range(4000):
        text = "".join(random.choice("aabehinrstuo") for _ in range(random.randint(1, 40)))
        assert codes.encode(text) == binary(library.encode(text, add_special_tokens=False).ids), text


def test_a_batch_is_encoded_in_portions():
    """A worker holds some hundred texts with their codes, not a batch of thousands."""
    batch = pa.array([f"text {i}" for i in range(2000)] + ["long " * 500_000] * 3)
    cut = list(bpe.portions(batch))
    assert pa.concat_arrays(cut).equals(batch) and max(map(len, cut)) <= bpe.PORTION
    assert max(len(c) for c in bpe.portions(batch[1900:])) <= 15
    assert list(bpe.portions(batch[:0])) == [] and [len(c) for c in bpe.portions(batch[2000:])] == [1, 1, 1]


def test_documents(spark, awkward, no_docs, some_docs, library):
    for docs in (awkward, some_docs):
        got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(binary(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert bpe.digests(no_docs, PATH).collect() == []


def test_id_files(spark, awkward, no_docs, some_docs, library):
    for docs in (awkward, some_docs):
        got = [tuple(r) for r in dac.documents_of_files(spark, docs, PATH, 1).orderBy("start").collect()]
        assert len(got) == docs.count()
        assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
        keys = [(g[0] is not None, g[0] or 0) for g in got]
        assert keys == sorted(keys)
        want = sorted((str(r.doc_id), zlib.crc32(binary([*library.encode(r.text or "", add_special_tokens=False).ids, 1]))) for r in docs.collect())
        assert sorted((str(g[0]), g[3]) for g in got) == want
    assert dac.documents_of_files(spark, no_docs, PATH, 1).collect() == []


def test_levels_random_access():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 2 ** rng.integers(1, 33), n).astype("<u4") for n in (0, 1, 700, 513, 5)]
    file = dac.Reader(dac.pack([3, None, 5, 6, 7], [x.tobytes() for x in ids]))
    every = np.concatenate(ids)
    assert file.doc_ids == [3, None, 5, 6, 7]
    assert [file.token(i) for i in range(len(every))] == every.tolist()
    for a, b in ((0, 0), (0, len(every)), (511, 514), (700, 1201)):
        assert file.tokens(a, b).tolist() == every[a:b].tolist()
    with pytest.raises(IndexError):
        file.token(len(every))


def test_files_of_bounded_size(spark, some_docs):
    from impactspark.sources.folders import fresh_dir

    manifest = dac.write(some_docs, PATH, 1, fresh_dir(spark, "small-files"), file_ids=5000)
    assert manifest.count() > 8
    back = dac.read(manifest).orderBy("start").collect()
    assert [r.doc_id for r in back] == [r.doc_id for r in some_docs.orderBy("doc_id").collect()]
