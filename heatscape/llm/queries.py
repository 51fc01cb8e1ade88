"""Registered queries of this folder over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatscape.llm import bpe, credentials, decontaminate, licenses, lines, pages, periodic, phrases, pii, simhash, tokenfile, toxicity, vectors
from heatscape.llm.common import doc_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bpe_digest(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=["doc_id"])
    return coded.select(doc_column(), F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digest(_table(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.write_and_read(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    rows = simhash.groups(docs)
    return rows.select(doc_column(), simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, _table(spark, folder, "benchmark"))
    return found.select(
        doc_column(), "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"))


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest_columns(licenses.scan(_table(spark, folder, "documents").select("doc_id", "text")))


def op2_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, folder, "embeddings"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    rows = toxicity.score(docs, model)
    return rows.select(doc_column(), F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    gone = lines.decisions(docs).withColumnRenamed("id", "doc_id")
    whole = docs.select("doc_id", F.size(lines.lines_of(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_lines"))
    return whole.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("removed"), F.lit(0))).alias("n_kept"), "removed")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.digest_columns(credentials.scan(_table(spark, folder, "documents").select("doc_id", "source", "text")))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest_columns(pii.scan(_table(spark, folder, "documents").select("doc_id", "text")))


def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "pages")
    found = pages.extract(table.select("page_id", "url", "html"), pages.fit(table))
    return found.select(doc_column("page_id"), doc_column("url"), "text", F.length("text").cast("bigint").alias("n_chars"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return periodic.digest_columns(periodic.find_runs(periodic.with_planted_runs(docs)))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


for _query in (op1_license_scan, op2_vector_graph, op3_byte_bpe, op4_toxicity, op5_line_dedup, op6_token_files, op7_secret_scan,
               op8_simhash_groups, op9_decontamination, op10_pii, op11_main_text, op12_periodic_runs, op13_collocations):
    QUERIES[_query.__name__] = _query

SQL["op1_license_scan"] = licenses.sql()
SQL["op7_secret_scan"] = credentials.sql()
SQL["op13_collocations"] = phrases.sql()
