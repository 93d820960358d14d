"""Landed files of the collecting side: pages of lists and links, as tables.

There is no network code here. Pages are dropped as XML files, one response each, and
are read with Spark's own XML source; every page is a split of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_items(spark: SparkSession, path: str, row_tag: str, fields: list[str]) -> DataFrame:
    """The repeated element of landed pages as rows of text columns, with the file they came from; damaged pages give no rows."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.format("xml").schema(schema).option("rowTag", row_tag).option("mode", "DROPMALFORMED").option("ignoreSurroundingSpaces", "true").load(path)
    return rows.withColumn("page", F.input_file_name())


def link_index(links: DataFrame, name: str, law_id: str, order: str) -> DataFrame:
    """(name_key, law_id) of official links; of several links of one name the last wins."""
    rows = links.where(F.col(name).isNotNull() & (F.col(law_id) != ""))
    return rows.groupBy(F.replace(F.col(name), F.lit(" "), F.lit("")).alias("name_key")).agg(F.max(F.struct(order, law_id)).alias("m")).select("name_key", F.col(f"m.{law_id}").alias("law_id"))


def best_hit(hits: DataFrame, asked: str, name: str, law_id: str, rank: str, exact_only: bool = False) -> DataFrame:
    """Of the hits of each asked name: the exact one (spaces aside), else the first unless ``exact_only``."""
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    rows = hits.withColumn("__far", F.when(plain(asked) == plain(name), 0).otherwise(1))
    rows = rows.where("__far = 0") if exact_only else rows
    return rows.groupBy(asked).agg(F.min(F.struct("__far", rank, law_id)).alias("m")).select(asked, F.col(f"m.{law_id}").alias("law_id"))


def numbered(rows: DataFrame, order: list[str | Column], limit: int | None = None) -> DataFrame:
    """Rows of one list in order with their place from 1; ``limit`` keeps the first (a collecting batch is a list of pages, not the corpus)."""
    out = rows.orderBy(*order)
    out = out.limit(limit) if limit is not None else out
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two states of a table whose columns were only ever added to."""
    return old.unionByName(new, allowMissingColumns=True)


def first_body(asked: DataFrame, key: str, *lookups: tuple[DataFrame, str]) -> DataFrame:
    """asked(key) with the body of the first landed table that has one: lookups(frame with body_xml, its column equal to the key), asked in turn.

    So a rule is looked up by its own id, then by that of its series; '' if no table has it.
    """
    out, found = asked, []
    for k, (df, column) in enumerate(lookups):
        body = df.where(F.length("body_xml") > 0).groupBy(F.col(column).alias(key)).agg(F.max("body_xml").alias(f"__body{k}"))
        out = out.join(body, key, "left")
        found.append(f"__body{k}")
    return out.select(*asked.columns, F.coalesce(*found, F.lit("")).alias("body_xml"))
