"""Changes of laws and their articles between deliveries, opened only where Merkle digests differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.dates import norm_version_key
from lexmill.operators.shred import IS_ARTICLE, RecordSpec, article_label, parse_record, record_units
from lexmill.operators.snapshot_diff import merkle_diff
from lexmill.session import write_shared
from lexmill.sources.tables import latest

SPEC = RecordSpec()
CONTENT = {"항": "항내용", "호": "호내용", "목": "목내용"}


def _plain(s: str | None) -> str:
    return "".join((s or "").split())


def _texts(el, out: list[str]) -> None:
    for c in el:
        tag = CONTENT.get(c.tag)
        if tag:
            out.append(_plain(c.findtext(tag)))
            _texts(c, out)


def article_digests(xml: str | None) -> list[tuple[str, int]] | None:
    """(label, 64-bit digest) of each article; several units of one label make one digest. None if unreadable."""
    root = parse_record(xml)
    if root is None:
        return None
    parts: dict[str, list[str]] = {}
    for u in record_units(root, SPEC):
        if (u.findtext("조문여부") or "").strip() not in IS_ARTICLE:
            continue
        label = article_label(u.tag, u.findtext("조문번호"), u.findtext("조문가지번호"), u.findtext("조문키"))
        text = [_plain(u.findtext("조문내용") or u.findtext("조내용"))]
        _texts(u, text)
        title = _plain(u.findtext("조문제목") or u.findtext("조제목"))
        parts.setdefault(label, []).append("\x1f".join((title, _plain(u.findtext("조문시행일자")), "".join(text))))
    return [(k, int.from_bytes(hashlib.blake2b("\x1e".join(v).encode(), digest_size=8).digest(), "little", signed=True)) for k, v in parts.items()]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("label", pa.string()), ("digest", pa.int64())]))
    for b in batches:
        rows = []
        for x in b.column(2):
            found = article_digests(x.as_py())
            rows.append(None if found is None else [{"label": k, "digest": d} for k, d in found])
        yield pa.record_batch([b.column(0), b.column(1), pa.array(rows, kind)], names=["law_id", "body_hash", "articles"])


def article_changes(snapshots: DataFrame, depth: int | None = None) -> DataFrame:
    """(batch_date, law_id, label, change) between consecutive deliveries.

    Of several rows of a law in one delivery the last fetched counts. A missing key
    (null, blank, ``|``) or a missing or unreadable body is no difference. Bodies are
    compared by article only where the raw digests of a law differ, and each distinct
    body is parsed once. Fewer than two deliveries give no rows; rows without law_id
    or batch_date are ignored.
    """
    body_hash = F.when(F.length(F.trim("body_xml")) > 0, F.xxhash64("body_xml"))
    rows = snapshots.where("law_id IS NOT NULL AND batch_date IS NOT NULL").select(
        "batch_date", "law_id", "fetched_at", norm_version_key(F.col("version_key")).alias("version_key"), body_hash.alias("body_hash")
    )
    # Narrow tables that several steps read are written once, which also keeps the plans small.
    current = write_shared(latest(rows, ["batch_date", "law_id"], "fetched_at", ["version_key", "body_hash"]), "current")
    sizes = {r[0]: r[1] for r in current.groupBy("batch_date").count().collect()}  # one row per delivery
    differing = write_shared(merkle_diff(current, "batch_date", "law_id", F.struct("version_key", "body_hash"), sorted(sizes), depth, max(sizes.values(), default=0)), "differing")
    side = lambda name, p: current.select(F.col("batch_date").alias(name), F.col("law_id").alias("key"), F.col("version_key").alias(f"{p}_key"), F.col("body_hash").alias(f"{p}_hash"))
    pairs = write_shared(
        differing.where("change = 'differs'")
        .join(side("old_snapshot", "old"), ["old_snapshot", "key"])
        .join(side("new_snapshot", "new"), ["new_snapshot", "key"])
        .select(F.col("new_snapshot").alias("batch_date"), F.col("key").alias("law_id"), "old_key", "new_key", "old_hash", "new_hash"),
        "pairs",
    )
    # Written, so that its size is known when bodies are read: held against them where they lie if small enough, else by a shuffle.
    wanted = write_shared(pairs.where("old_hash != new_hash").select("law_id", F.explode(F.array("old_hash", "new_hash")).alias("body_hash")).distinct(), "wanted")
    bodies = snapshots.select("law_id", F.xxhash64("body_xml").alias("body_hash"), "body_xml").join(wanted, ["law_id", "body_hash"], "left_semi")
    bodies = bodies.groupBy("law_id", "body_hash").agg(F.first("body_xml").alias("body_xml"))
    parsed = write_shared(bodies.mapInArrow(_digest_batches, "law_id string, body_hash bigint, articles array<struct<label:string,digest:bigint>>").where("articles IS NOT NULL"), "articles")
    half = lambda p: parsed.select("law_id", F.col("body_hash").alias(f"{p}_hash"), F.col("articles").alias(f"{p}_articles"))
    both = pairs.join(half("old"), ["law_id", "old_hash"], "left").join(half("new"), ["law_id", "new_hash"], "left")
    label_of = lambda c: F.transform(c, lambda x: x["label"])
    gone = F.array_except(label_of("old_articles"), label_of("new_articles"))
    fresh = F.array_except(label_of("new_articles"), label_of("old_articles"))
    moved = F.array_intersect(label_of(F.array_except("old_articles", "new_articles")), label_of(F.array_except("new_articles", "old_articles")))
    tagged = lambda c, change: F.transform(c, lambda x: F.struct(x.alias("label"), F.lit(change).alias("change")))
    # A missing body leaves the list null: nothing is known of its articles.
    known = F.concat(tagged(gone, "removed"), tagged(fresh, "added"), tagged(moved, "changed"))
    none = F.array().cast("array<struct<label:string,change:string>>")
    lines = both.select("batch_date", "law_id", F.coalesce(F.col("old_key") != F.col("new_key"), F.lit(False)).alias("new_version"), F.coalesce(known, none).alias("lines"))
    of_law = F.array(F.struct(F.lit("").alias("label"), F.lit("changed").alias("change")))
    told = F.when(F.col("new_version") | (F.size("lines") > 0), F.concat(of_law, F.filter("lines", lambda x: x["label"] != "")))
    changed = lines.select("batch_date", "law_id", F.explode(told).alias("x")).select("batch_date", "law_id", "x.label", "x.change")
    come_and_gone = differing.where("change != 'differs'").select(F.col("new_snapshot").alias("batch_date"), F.col("key").alias("law_id"), F.lit("").alias("label"), "change")
    return come_and_gone.unionByName(changed)
