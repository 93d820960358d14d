"""What the judged pipeline reads: stored tables, or frames of a collector."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import table

RULE, COMPARISON = "ADM:", "ADMONV:"  # fixed values: prefixes of the ids of administrative rules and of their comparison documents


@runtime_checkable
class Source(Protocol):
    """Frames by the columns the pipeline uses."""

    def ordinances(self) -> DataFrame:
        """mst, body_xml, enforce_date, fetched_at."""

    def laws(self) -> DataFrame:
        """law_id, name, body_xml: laws, administrative rules (ADM:) and comparisons of their last amendment (ADMONV:)."""

    def versions(self) -> DataFrame:
        """law_id, version_mst, enforce_date, body_xml, fetched_at."""

    def names(self) -> DataFrame:
        """name, law_id, prio, place: what names were resolved to, the smallest (prio, place) of a name counting."""


def ranked_names(*sources: tuple[DataFrame, str, str]) -> DataFrame:
    """(name, law_id, prio, place) of frames with law_id, given with their columns of the name and of the place, the first source first."""
    parts = [t.where(F.col(name).isNotNull() & (F.col("law_id") != "")).select(F.col(name).alias("name"), "law_id", F.lit(prio).alias("prio"), F.lpad(F.col(place).cast("string"), 20, "0").alias("place")) for prio, (t, name, place) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


@dataclass(frozen=True)
class TableSource:
    """The stored tables of a folder; ``links`` (mst, law_id, law_name) are official links, asked last."""

    spark: SparkSession
    folder: str
    links: DataFrame | None = None

    def ordinances(self) -> DataFrame:
        return table(self.spark, self.folder, "ordinances")

    def laws(self) -> DataFrame:
        return table(self.spark, self.folder, "laws")

    def versions(self) -> DataFrame:
        return table(self.spark, self.folder, "law_versions")

    def names(self) -> DataFrame:
        stored = [(table(self.spark, self.folder, t), name, place) for t, name, place in (("citations", "law_name", "id"), ("findings", "law_name", "id"), ("laws", "name", "law_id"))]
        return ranked_names(*stored, *([(self.links, "law_name", "mst")] if self.links is not None else []))


@dataclass(frozen=True)
class FrameSource:
    """Frames of a collector, as they are."""

    _ordinances: DataFrame
    _laws: DataFrame
    _versions: DataFrame
    _names: DataFrame

    def ordinances(self) -> DataFrame:
        return self._ordinances

    def laws(self) -> DataFrame:
        return self._laws

    def versions(self) -> DataFrame:
        return self._versions

    def names(self) -> DataFrame:
        return self._names
