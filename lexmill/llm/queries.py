"""Queries of the training-text problems p3, p7, p8 and p9."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.leak import find_leaks, leak_spans
from lexmill.llm.mix import mix
from lexmill.llm.normalize import normalize_text
from lexmill.llm.quality import document_forms, document_statistics
from lexmill.sources.tables import table


#: Rank file of the tokenizer that sizes are measured with.
TOKENIZER = os.environ.get("LEXMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _normalized(spark: SparkSession, sf_dir: str, name: str, rec_id: str, text: str, *more: str) -> DataFrame:
    """Plain forms; text_key keeps the rows of one rec_id apart (by their text and ``more``)."""
    rows = table(spark, sf_dir, name).where(F.col(text).isNotNull()).select(F.col(rec_id).cast("string").alias("rec_id"), F.xxhash64(text, *more).alias("text_key"), F.col(text).alias("text"))
    return normalize_text(rows, "text", ["rec_id", "text_key"]).select(F.lit(name).alias("src"), "rec_id", "text_key", "plain", "altered")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds characters that only look like, or invisibly accompany, the plain form."""
    parts = [_normalized(spark, sf_dir, *x).where("altered").select("src", "rec_id") for x in (("ordinances", "mst", "body_xml"), ("citations", "id", "law_name"), ("findings", "id", "law_name"))]
    # Ids of citations and findings are unique; an mst may have several rows.
    return parts[0].distinct().unionByName(parts[1]).unionByName(parts[2])


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body of ordinances and law name of citations and findings in its consistent form."""
    parts = [_normalized(spark, sf_dir, *x) for x in (("ordinances", "mst", "body_xml", "fetched_at"), ("citations", "id", "law_name"), ("findings", "id", "law_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("src", "rec_id", "text_key", "plain")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that reproduce at least half of an evaluation item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents to remove, with the item they reproduce and how much of it."""
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), path=TOKENIZER)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens each listed source reaches."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), path=TOKENIZER)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose text is a list, a table or junk rather than prose."""
    forms = document_forms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "common_words"))
    return forms.where("form != 'prose'").select("doc_id", "form")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text statistics of every document."""
    return document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


QUERIES = {"p3_found": p3_found, "p3_plain": p3_plain, "p7_found": p7_found, "p7_spans": p7_spans, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_statistics": p9_statistics}
ORACLE_SQL: dict[str, str] = {}
