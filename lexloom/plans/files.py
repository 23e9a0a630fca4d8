"""Sources and sinks: what is written comes back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import identifier, word_count
from lexloom.operators import annotate
from lexloom.plans import quotas
from lexloom.plans.base import Plans
from lexloom.plans.annotate import _DOC_WORDS
from lexloom.sources import files
from lexloom.storage import fresh_path
from lexloom.tables import table

plans = Plans()
_DOCS = "SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL"


def _place(spark: SparkSession) -> str:
    return fresh_path(spark, "files")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text", "source")


@plans.query(_DOCS)
def io_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    at = _place(spark)
    _documents(spark, folder).write.json(at)
    return files.read_jsonl(spark, at, "doc_id bigint, text string, source string", strict=True)


@plans.query("SELECT doc_id, text, source FROM documents")
def io_csv(spark: SparkSession, folder: str) -> DataFrame:
    """CSV whose quoted fields hold line ends; empty and missing texts stay apart."""
    at = _place(spark)
    files.write_csv(table(spark, folder, "documents").select("doc_id", "text", "source"), at)
    return files.read_csv(spark, at, "doc_id bigint, text string, source string")


@plans.query("SELECT candidate_id, seed, 'csv' AS form FROM unsafe_candidates UNION ALL SELECT candidate_id, seed, 'jsonl' FROM unsafe_candidates")
def io_append_pair(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines and CSV that grow together over two overlapping runs: each candidate comes once in both."""
    at = _place(spark)
    rows = table(spark, folder, "unsafe_candidates").select("candidate_id", "seed")
    files.append_pair(rows.filter(F.col("candidate_id") % 3 != 0), at, "candidate_id")
    files.append_pair(rows, at, "candidate_id")
    if not files._exists(spark, f"{at}/csv"):
        return rows.select("*", F.lit("csv").alias("form"))
    csv = files.read_csv(spark, f"{at}/csv", "candidate_id bigint, seed string").select("*", F.lit("csv").alias("form"))
    return csv.unionByName(files.read_jsonl(spark, f"{at}/jsonl", "candidate_id bigint, seed string").select("*", F.lit("jsonl").alias("form")))


@plans.query("SELECT row_ix, printf('%.6f', row_norm) AS row_norm FROM word_matrix")
def io_ranked_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A ranking by norm as CSV with six digits, read back as text."""
    at = _place(spark)
    files.write_ranked_csv(table(spark, folder, "word_matrix").select("row_ix", "row_norm"), at, [F.desc_nulls_last("row_norm"), F.col("row_ix")])
    return files.read_csv(spark, at, "row_ix bigint, row_norm string")


@plans.query("SELECT DISTINCT trim(words) AS word FROM word_list WHERE trim(words) <> ''")
def io_word_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct words of the list, one a line."""
    at = _place(spark)
    words = table(spark, folder, "word_list").select(F.trim("words").alias("word"))
    files.write_list(words.filter(F.col("word") != ""), at)
    return files.read_lines(spark, at).select(F.col("value").alias("word"))


@plans.query(f"SELECT position AS aug_type, ord, aug_head || aug_mid || aug_tail AS text FROM {_DOC_WORDS} WHERE trim(aug_head || aug_mid || aug_tail) <> ''")
def io_routed_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Training records in one folder of JSON lines per position, read back with the position from the path."""
    at = _place(spark)
    rows = annotate.augment_documents(quotas.gated(spark, folder), annotate.DOCUMENT_WORDS, "ord", quoted=True, change_case=True)
    files.write_routed(annotate.routed(rows, ("ord",)).drop("token"), at, ["aug_type"])
    return spark.read.schema("ord bigint, text string, aug_type string").json(at)


def document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(model, word, name, text) of all documents with a source and a text, through a tree of files."""
    at = _place(spark)
    rows = table(spark, folder, "documents").filter(F.col("source").isNotNull() & (F.col("text") != ""))
    files.write_documents(rows.select("source", F.coalesce("lang", F.lit("und")).alias("lang"), F.format_string("%08d", "doc_id").alias("name"), "text"), at)
    return files.read_documents(spark, at)


@plans.query("SELECT source AS model, coalesce(lang, 'und') AS word, count(*) AS files, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')))::BIGINT AS words FROM documents WHERE text <> '' AND source IS NOT NULL GROUP BY ALL")
def io_document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """One file per document of every source under source/language, read back as whole texts."""
    tree = document_tree(spark, folder)
    return tree.groupBy("model", "word").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(word_count(F.col("text"))).alias("words"))


@plans.query("SELECT candidate_id, seed FROM unsafe_candidates")
def io_resumed_append(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates appended in two overlapping runs: each comes once."""
    at = _place(spark)
    rows = table(spark, folder, "unsafe_candidates").select("candidate_id", "seed")
    files.append_new(rows.filter(F.col("candidate_id") % 3 != 0), at, "candidate_id")
    files.append_new(rows, at, "candidate_id")
    return spark.read.parquet(at)


@plans.query("SELECT row_ix, len(matrix) AS size, model_id FROM word_matrix WHERE matrix IS NOT NULL")
def io_published_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix written, checked and only then published."""
    at = _place(spark)
    rows = files.require_columns(table(spark, folder, "word_matrix"), ["row_ix", "matrix", "model_id"]).filter(F.col("matrix").isNotNull())
    files.publish(rows, at, rows.count(), lambda back: back.filter(F.col("matrix").isNull()).isEmpty())
    return spark.read.parquet(at).select("row_ix", F.size("matrix").alias("size"), "model_id")


@plans.query("SELECT count(*) AS n, count(DISTINCT record_id) AS records, max(ingested_at) AS last_ingested FROM toxic_document")
def io_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A one-row manifest, written as JSON and read back."""
    at = _place(spark)
    rows = table(spark, folder, "toxic_document").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"), F.max("ingested_at").alias("last_ingested"))
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    rows.coalesce(1).write.option("timestampNTZFormat", exact).json(at)
    return spark.read.schema("n bigint, records bigint, last_ingested timestamp_ntz").option("timestampNTZFormat", exact).json(at)


_IDENTIFIER = "coalesce(nullif(left(trim(regexp_replace(coalesce(source, ''), '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 80), ''), 'x')"


@plans.query(f"SELECT source, count(*) AS n FROM (SELECT {_IDENTIFIER} AS source FROM documents UNION ALL SELECT {_IDENTIFIER} FROM toxic_document) GROUP BY source")
def io_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Records of named sources from a registry, with a fallback for one that can't be opened."""
    sources = files.Sources()
    missing = lambda: spark.read.parquet(f"{folder}/no_such_table.parquet")
    sources.add("documents", lambda s: files.first_readable([missing, lambda: table(s, folder, "documents")]).select(F.col("doc_id").alias("key"), identifier(F.col("source")).alias("source")))
    sources.add("records", lambda s: table(s, folder, "toxic_document").select(F.col("record_id").alias("key"), identifier(F.col("source")).alias("source")))
    return sources.read(spark).groupBy("source").agg(F.count("*").alias("n"))
