"""Token ids in files of directly addressable codes.

An id is cut into chunks of `CHUNK_BITS` bits, lowest first. Level 0 holds the
first chunk of every id, level 1 the second chunk of those ids that have one,
and so on. Each level has a bitmap that marks the ids that continue and a rank
directory with the number of marks before every block of `BLOCK` bits, so the
place of id i on the next level is one directory entry and a few counted bits:
any id is read without decoding others.

A file, all integers little-endian:

    8 bytes   magic
    4 x u8    documents, ids, levels, chunk bits
    per level u8: entries
    documents i8 doc ids, u1 whether the doc id is known, u8 end positions
    per level: entries u1 chunks, bitmap padded to whole blocks,
               u8 marks before each block
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impactspark.llm.bpe import byte_letters
from impactspark.llm.common import Memo, ship, stored, whole_text
from impactspark.llm.files import attempt_name, make_folder, opened, written
from impactspark.sources.folders import fresh_dir

MAGIC = b"IDLEVELS"
CHUNK_BITS = 8
BLOCK = 512
CACHED = 250_000  # pieces a worker keeps
FILE_IDS = 4_000_000  # ids after which a task begins the next file
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
_ENDS = "<u8"


def _levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chunks and continuation marks of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK_BITS)
        marks = more > 0
        out.append(((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8), marks))
        if not marks.any():
            return out
        rest = more[marks]


def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file's bytes; `ids` are little-endian unsigned 32-bit integers."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=_ENDS)
    levels = _levels(np.frombuffer(b"".join(ids), "<u4"))
    parts = [MAGIC, np.array([len(docs), ends[-1] if len(ends) else 0, len(levels), CHUNK_BITS], "<u8").tobytes()]
    parts.append(np.array([len(c) for c, _ in levels], "<u8").tobytes())
    parts += [docs.tobytes(), known.tobytes(), ends.tobytes()]
    for chunks, marks in levels:
        padded = np.zeros(-(-len(marks) // BLOCK) * BLOCK, bool)
        padded[: len(marks)] = marks
        per_block = padded.reshape(-1, BLOCK).sum(1, dtype=np.uint64)
        parts += [chunks.tobytes(), np.packbits(padded).tobytes(), (np.cumsum(per_block, dtype="<u8") - per_block).astype("<u8").tobytes()]
    return b"".join(parts)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of id levels")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n_docs, self.n_ids, n_levels, self.bits = (int(x) for x in take("<u8", 4))
        entries = take("<u8", n_levels)
        docs, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known, strict=True)]
        self.ends = take(_ENDS, n_docs)
        self.levels = []
        for n in map(int, entries):
            blocks = -(-n // BLOCK)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK // 8), take("<u8", blocks)))

    def _rank(self, level: int, at: int) -> int:
        """Marks before position `at`: the block's entry and the bits in it."""
        _, bitmap, before = self.levels[level]
        block = at // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : at // 8 + 1])[: at - block * BLOCK]
        return int(before[block]) + int(bits.sum())

    def token(self, at: int) -> int:
        """The id at one position, touching one place per level."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (level * self.bits)
            if not bitmap[at >> 3] >> (7 - (at & 7)) & 1:
                break
            at = self._rank(level, at)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: on each level they are one run."""
        out = np.zeros(max(end - start, 0), np.uint64)
        at, n, places = start, len(out), slice(None)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not n:
                break
            out[places] |= chunks[at : at + n].astype(np.uint64) << np.uint64(level * self.bits)
            bits = np.unpackbits(bitmap[at // 8 : (at + n + 7) // 8])[at % 8 : at % 8 + n].astype(bool)
            if not bits.any():
                break
            at = self._rank(level, at)
            places = np.flatnonzero(bits) if isinstance(places, slice) else places[bits]
            n = len(places)
        return out.astype("<u4")


class Encoder:
    """The tokenizers library over the pieces of a text, each piece met once.

    Where the file's normalizer and pre-tokenizer let no word cross white space
    (lower-casing, words of letters, single digits or signs), a text's ids are
    those of its pieces; with any other file the whole text is encoded.
    """

    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    SIGNS = b".,;:!?*#$%&"

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(text)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": self.SPLIT} and splits[0].get("invert")
        self.letters = byte_letters()
        self.of_core = Memo(self._core, CACHED)
        self.of_piece = Memo(self._piece, CACHED)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: bytes) -> bytes:
        text = core.decode()
        if not text.isalpha() or not (text.isascii() or unicodedata.is_normalized("NFC", text) and text == text.lower()):
            return self._library(text)
        # letters alone, as the normalizer leaves them, are one word of the model
        word = text if text.isascii() else "".join([self.letters[b] for b in core])
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        # signs after a last ASCII letter or digit are a word of their own
        core = piece.rstrip(self.SIGNS)
        if not core[-1:].isalnum():
            return self.of_core[piece]
        ids = self.of_core[core]
        return ids + self.of_core[piece[len(core) :]] if len(core) < len(piece) else ids

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self._library(text)
        of_piece, raw = self.of_piece, text.encode()
        if b"<" not in raw:  # no special token, whose case would matter
            raw = raw.lower()
            return b"".join([of_piece[p] for p in raw.split()])
        return b"".join([of_piece[p] if p.islower() else self._library(p.decode()) for p in raw.split()])


_encoders: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text)
    return _encoders[key]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode `docs` (doc_id, text) in ascending doc_id order into files under
    `folder` and return the stored manifest, one row per file.

    NULL doc ids come first, rows that share a doc id follow each other in the
    order of their texts' hashes. A NULL text is empty: its ids are the end id
    alone. A task holds one file's ids at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    make_folder(folder)
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, part, seq = encoder(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, ids, n = [], [], 0

        def close() -> pd.DataFrame:
            path = f"{folder}/{attempt_name(f'ids-{part:06d}-{seq:06d}', '.idl')}"
            with written(path) as out:
                out.write(pack(doc_ids, ids))
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(ids)], "n_ids": [n]})

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(codes.encode(text) + end)
                doc_ids.append(None if key is None else int(key))
                n += len(ids[-1]) // 4
                if n >= file_ids:
                    yield close()
                    doc_ids, ids, n, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"), F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h"))
    ordered = rows.repartitionByRange("__d", "__h").sortWithinPartitions("__d", "__h").select("doc_id", "text")
    return stored(ordered.mapInPandas(run, MANIFEST), "id-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add `base`, the ids in all files before. Only one row per part meets in
    the window without partition."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    parts = parts.select("part", F.coalesce(F.sum("__n").over(before(Window.orderBy("part"))), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return manifest.withColumn("__inside", inside).join(parts, "part").withColumn("base", F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, read back from its file: doc_id, start, ids (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                with opened(path) as source:
                    file = Reader(source.read())
                ends = file.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for a in range(0, len(ends), 2000):
                    cut = slice(a, a + 2000)
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(file.doc_ids[cut], "Int64"),
                            "start": base + starts[cut],
                            "ids": [file.tokens(x, y).tobytes() for x, y in zip(starts[cut], ends[cut], strict=True)],
                        }
                    )

    ship(manifest.sparkSession)
    # one file per task, as far as there are tasks
    spread = with_starts(manifest).select("path", "base").repartition(F.col("path"))
    return spread.mapInPandas(run, "doc_id long, start long, ids binary")


def documents_of_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents, read them back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write(docs.select("doc_id", "text"), tokenizer, end_id, fresh_dir(spark, "id-files"))
    return read(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )

