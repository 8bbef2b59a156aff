"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm import audit, bpe, dac, html, lsh, merkle, mixing, nbsvm, quality, secrets, simhash, toxicity, warc
from impactspark.llm.common import documents
from impactspark.sources.scan import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"
END_ID = 1


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extract(read_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op2_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), budget=2, words=3)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op3_char_network(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "net")
    return found.select(
        "doc_id", of_kind("assign").alias("n_assign"), of_kind("access").alias("n_access"), of_kind("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query
def op4_sainte_lague(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_sainte_lague"] = mixing.sql()


@query
def op5_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read_table(spark, folder, "pages")).drop("payload", "url")


ORACLES["op5_warc_normaliser"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest),
j AS (SELECT p.*, CASE WHEN first <> p.page_id OR (first IS NOT NULL AND p.page_id IS NULL) THEN first END AS refers_to
  FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= {warc.MIN_REVISIT})
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""


@query
def op6_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path(WORD_BPE))


@query
def op7_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(documents(spark, folder))
    return found.select("doc_id", *quality.NUMBERS, "base_failed", "kept", "n_boilerplate_words")


ORACLES["op7_line_frequency"] = quality.sql()


@query
def op8_id_levels(spark: SparkSession, folder: str) -> DataFrame:
    return dac.documents_of_files(spark, documents(spark, folder), public_tokenizers.path(WORD_BPE), END_ID)


@query
def op9_nb_svm(spark: SparkSession, folder: str) -> DataFrame:
    docs = nbsvm.featured(documents(spark, folder))
    return nbsvm.scored(docs, nbsvm.train(docs, read_table(spark, folder, "labels")))


@query
def op10_multiprobe_lsh(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    return lsh.nearest(rows, F.col("vec_id") % 50 == 0, k=5)


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(spark, f"{folder}/documents.parquet", read_table(spark, folder, "labels"))


ORACLES["op11_filter_audit"] = audit.sql()


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(documents(spark, folder))


ORACLES["op12_merkle_manifest"] = merkle.sql()


@query
def op13_levenshtein_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.scored(docs, toxicity.train(docs, read_table(spark, folder, "labels")))
