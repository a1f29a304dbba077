"""Results that stay between runs: pieces of a stage, committed under a digest of the settings that made them.

A stage is three tables in the shared folder: the rows of each piece, the keys the piece was made for, and one commit line
per piece, written last. A piece without its commit line, such as one of a run that was cut short, is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

COMMIT = "piece string, settings string, keys bigint, rows bigint"


def settings_digest(settings: Mapping[str, object]) -> str:
    """One digest for equal settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def content_key(columns: Sequence[str], settings: Mapping[str, object]) -> Column:
    """Digest of a row's content together with the settings; null and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)], F.lit(settings_digest(settings)).alias("s"))), 256)


class SettingsChanged(ValueError):
    """The folder holds pieces that other settings made."""


class Stages:
    """Stages in ``folder``. With ``strict`` pieces of other settings are refused, otherwise they are left aside."""

    def __init__(self, spark: SparkSession, folder: str, settings: Mapping[str, object] | None = None, strict: bool = True):
        self.spark, self.folder, self.strict = spark, folder.rstrip("/"), strict
        self.digest = settings_digest(settings or {})

    def pieces(self, stage: str) -> list[str]:
        """Committed pieces of these settings; there is one for each run that had something to do."""
        try:
            found = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/{stage}/commits").select("piece", "settings").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if self.strict and any(r["settings"] != self.digest for r in found):
            raise SettingsChanged(f"{self.folder}/{stage} was made with other settings; take another folder or the same settings")
        return sorted(r["piece"] for r in found if r["settings"] == self.digest)

    def _committed(self, stage: str, part: str) -> DataFrame | None:
        paths = [f"{self.folder}/{stage}/{part}/{p}" for p in self.pieces(stage)]
        return self.spark.read.parquet(*paths) if paths else None

    def rows(self, stage: str) -> DataFrame | None:
        return self._committed(stage, "rows")

    def keys(self, stage: str) -> DataFrame | None:
        return self._committed(stage, "keys")

    def pending(self, stage: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Keys of ``wanted`` that no committed piece was made for, whether it gave rows for them or not."""
        asked, done = wanted.select(*keys).distinct(), self.keys(stage)
        return asked if done is None else asked.join(done.select(*keys), list(keys), "left_anti")

    def commit(self, stage: str, keys: DataFrame, rows: DataFrame) -> None:
        piece = f"p-{uuid.uuid4().hex}"
        home = f"{self.folder}/{stage}"
        rows.write.parquet(f"{home}/rows/{piece}")
        keys.write.parquet(f"{home}/keys/{piece}")
        sizes = [self.spark.read.parquet(f"{home}/{part}/{piece}").count() for part in ("keys", "rows")]
        self.spark.createDataFrame([(piece, self.digest, *sizes)], COMMIT).coalesce(1).write.mode("append").parquet(f"{home}/commits")

    def advance(self, stage: str, wanted: DataFrame, keys: Sequence[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of the stage for the keys of ``wanted``; ``make`` is called once, with the keys that are missing, if any are."""
        missing = cut_lineage(self.pending(stage, wanted, keys))
        if not missing.isEmpty() or not self.pieces(stage):
            self.commit(stage, missing, make(missing))
        rows = self.rows(stage)
        return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def cached_bundles(stages: Stages, requests: DataFrame, content: Sequence[str], settings: Mapping[str, object],
                   build: Callable[[DataFrame], DataFrame], stage: str = "bundles") -> tuple[DataFrame, DataFrame]:
    """Bundles for distinct contents, built once: (requests with ``bundle_key``, rows of the bundles with ``bundle_key``).

    Requests with equal ``content`` columns share a bundle. ``build`` gets one row for each content that no earlier run built under
    the same settings, and returns rows with ``bundle_key``; a content it returns nothing for isn't asked for again.
    """
    keyed = requests.withColumn("bundle_key", content_key(content, settings))
    distinct = keyed.select("bundle_key", *content).dropDuplicates(["bundle_key"])

    def make(missing: DataFrame) -> DataFrame:
        return build(distinct.join(missing, "bundle_key", "left_semi"))

    return keyed, stages.advance(stage, distinct, ["bundle_key"], make)
