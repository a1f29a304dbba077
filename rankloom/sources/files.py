"""Directory, CSV and JSON scans and the matching sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import matrix as M
from ..functions.keys import normal_path
from ..operators.grouping import positions
from ..operators.selection import first_per_key
from ..operators.summaries import duplicate_keys, require_empty

# Accepted file names per kind, the first existing one is used.
VOLUME_NAMES = ("CBCT.nii.gz", "cbct.nii.gz")
MESH_NAMES = {"upper": ("ios_upper.stl", "upper.stl"), "lower": ("ios_lower.stl", "lower.stl")}
MATRIX_NAMES = {"upper": ("upper_gt.npy",), "lower": ("lower_gt.npy",)}


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times below a folder; the content column is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")


def _kind(name: Column, jaw: str) -> Column:
    chain = None
    for kind, names in (("volume", VOLUME_NAMES), ("mesh", MESH_NAMES[jaw]), ("matrix", MATRIX_NAMES[jaw])):
        for place, wanted in enumerate(names):
            value = F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"))
            chain = F.when(name == wanted, value) if chain is None else chain.when(name == wanted, value)
    return chain


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per (split, case, jaw) of ``root/split/case/file``; complete = volume and mesh exist."""
    return manifest_of(list_files(spark, root))


def manifest_of(files: DataFrame) -> DataFrame:
    """The manifest of a table of paths."""
    files = files.withColumn("_p", F.split("path", "/"))
    files = files.select("path", F.element_at("_p", -1).alias("name"), F.element_at("_p", -2).alias("case_id"), F.element_at("_p", -3).alias("split"))
    parts = []
    for jaw in ("upper", "lower"):
        tagged = files.withColumn("_k", _kind(F.col("name"), jaw)).where(F.col("_k").isNotNull())

        def first(kind: str) -> Column:
            return F.min_by(F.when(F.col("_k.kind") == kind, F.col("path")), F.when(F.col("_k.kind") == kind, F.col("_k.place")))

        parts.append(tagged.groupBy("split", "case_id").agg(
            F.lit(jaw).alias("jaw"), first("volume").alias("cbct_path"), first("mesh").alias("ios_path"), first("matrix").alias("transform_path")))
    both = parts[0].unionByName(parts[1])
    return both.withColumn("complete", F.col("cbct_path").isNotNull() & F.col("ios_path").isNotNull())


def discover_cases(spark: SparkSession, root: str, requested: DataFrame | None = None) -> DataFrame:
    """Cases of an arbitrary tree; a case with a volume but without a mesh is an error."""
    return checked_cases(build_manifest(spark, root), requested)


def checked_cases(cases: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The requested cases of a manifest; a case with a volume but without a mesh is an error."""
    if requested is not None:
        cases = cases.join(requested.select("case_id"), "case_id", "left_semi")
    require_empty(cases.where(F.col("cbct_path").isNotNull() & F.col("ios_path").isNull()).select("case_id", "jaw"), "cases without a mesh")
    return cases


def read_csv(spark: SparkSession, path: str, schema: T.StructType, unique: Sequence[str] = ()) -> DataFrame:
    """Typed CSV with a header; a repeated key is an error."""
    out = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)
    if unique:
        require_empty(duplicate_keys(out, unique), f"repeated keys in {path}")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV; a missing ``complete`` counts as true, older files may lack the last columns."""
    wanted = schemas.MANIFEST.names
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    columns = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    out = raw.select(*columns)
    return out.withColumn("complete", F.coalesce(F.lower(F.trim("complete")), F.lit("true")) == "true")


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """CSV with a header; with ``order`` the files, taken by name, hold the rows in that order."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("header", "true").partitionBy(*partition_by).csv(path)


def _documents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Whole text of every matching file and the parts of its path; one row per file."""
    reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(root).withColumn("_p", F.split(F.col("_metadata.file_path"), "/"))


def _listed(docs: DataFrame, schema: T.DataType) -> tuple[DataFrame, DataFrame]:
    """Rows (pos, _row) of documents that hold a JSON list, and the paths of those that do not.

    A list that is cut off, or holds anything but objects, is no list: the whole document is rejected.
    """
    value = F.col("value")
    parsed = F.from_json(value, T.ArrayType(schema))
    whole = parsed.isNotNull() & F.rlike(value, F.lit(r"(?s)^\s*\[.*\]\s*$")) & F.coalesce(F.json_array_length(value) == F.size(parsed), F.lit(False))
    tagged = docs.withColumn("_rows", F.when(whole, parsed))
    good = tagged.where(F.col("_rows").isNotNull()).select("*", F.posexplode("_rows").alias("_pos", "_row")).drop("_rows", "value")
    return good, tagged.where(F.col("_rows").isNull()).select(F.array_join("_p", "/").alias("path"), F.lit("unreadable").alias("reason"))


def _over_runs(spark: SparkSession, runs: Sequence[str], pattern: str) -> DataFrame:
    parts = [_documents(spark, run, pattern).select("value", "_p", F.lit(run).alias("_name"), F.lit(order).alias("_run")) for order, run in enumerate(runs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_candidates(spark: SparkSession, runs: Sequence[str], pattern: str = "candidates.json") -> tuple[DataFrame, DataFrame]:
    """``run/<case>_<jaw>/candidates.json`` of several runs, numbered by run order and list position; and the unreadable files."""
    rows, bad = _listed(_over_runs(spark, runs, pattern), schemas.CANDIDATE)
    group = F.regexp_extract(F.element_at("_p", -2), r"^(?:[^=]*=)?(.+)_(upper|lower)$", 1), F.regexp_extract(F.element_at("_p", -2), r"^.+_(upper|lower)$", 1)
    out = rows.select(group[0].alias("case_id"), group[1].alias("jaw"), F.col("_name").alias("candidate_run"), "_run", "_pos", "_row.*").where(F.col("jaw") != "")
    out = positions(out, ["case_id", "jaw"], [F.col("_run"), F.col("_pos")], "_n")
    flat = {c: F.flatten(c) for c in ("transform", "transform_initial")}
    return out.withColumn("candidate_index", F.col("_n") - 1).withColumns(flat).drop("_n", "_run", "_pos"), bad


def read_results(spark: SparkSession, root: str, pattern: str = "result.json") -> tuple[DataFrame, DataFrame]:
    """Result files that hold every section, and the rejected ones with a reason."""
    docs = _documents(spark, root, pattern).select(F.regexp_replace(F.element_at("_p", -2), "^[^=]*=", "").alias("folder"), F.from_json("value", schemas.RESULT).alias("r"), F.get_json_object("value", "$").isNull().alias("_broken"))
    named = F.concat_ws("_", "r.record.case_id", "r.record.jaw")
    reason = (F.when(F.col("r").isNull() | F.col("_broken"), "unreadable").when(F.col("r.record").isNull() | F.col("r.target").isNull() | F.col("r.registration").isNull()
              | F.col("r.selection").isNull(), "section_missing").when(named != F.col("folder"), "wrong_case"))
    tagged = docs.withColumn("reason", reason)
    good = tagged.where(F.col("reason").isNull()).select(
        F.col("r.record.case_id").alias("case_id"), F.col("r.record.jaw").alias("jaw"), F.flatten("r.registration.transform").alias("transform"),
        F.col("r.registration.score").alias("score"), F.col("r.metrics.mean_tre_mm").alias("mean_tre_mm"))
    return good, tagged.where(F.col("reason").isNotNull()).select("folder", "reason")


def read_audits(spark: SparkSession, runs: Sequence[str], pattern: str = "audit.json") -> tuple[DataFrame, DataFrame]:
    """Audit rows of several runs with run order and list position; and the unreadable files."""
    rows, bad = _listed(_over_runs(spark, runs, pattern), schemas.AUDIT)
    return rows.select(F.col("_name").alias("run"), F.col("_run").alias("run_order"), F.col("_pos").alias("pos"), "_row.*"), bad


def read_hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON map path -> (size, mtime, hash) as rows keyed by the normalised path."""
    text = spark.read.option("wholetext", "true").text(path)
    rows = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schemas.HASH_ENTRY))).alias("path", "_e"))
    return rows.select(normal_path("path").alias("path"), "_e.size", "_e.mtime_ns", F.col("_e.sha256").alias("content_hash"))


def write_candidates(df: DataFrame, path: str) -> None:
    """Candidates back by source run and group; only the partitions at hand are replaced.

    Rows are dealt over tasks by ranges of run, group and a hash, so a run or group of any size is written by many tasks, and small ones share tasks.
    """
    out = df.drop(*[c for c in df.columns if c.startswith("_")])
    parts = ["candidate_run", "case_id", "jaw"]
    (out.repartitionByRange(*parts, F.xxhash64(*[c for c in out.columns if c not in parts])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def candidates_from_labels(labels: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One candidate per pseudo label, its centroid carried by the matrix; labels without a mesh are rejected."""
    both = labels.join(centroids.select("case_id", "jaw", F.array("cx", "cy", "cz").alias("source_full_centroid")), ["case_id", "jaw"], "left")
    rejected = both.where(F.col("source_full_centroid").isNull()).select("case_id", "jaw", F.lit("mesh_missing").alias("reason"))
    c = [F.col("source_full_centroid")[i] for i in range(3)]
    good = both.where(F.col("source_full_centroid").isNotNull()).select(
        "case_id", "jaw", F.lit(0).alias("candidate_index"), F.col("teacher").alias("method"), "transform", "source_full_centroid",
        F.array(*M.apply_point("transform", *c)).alias("predicted_full_centroid"), M.det_sign("transform").alias("chirality"),
        (1.0 - F.col("confidence")).alias("selection_score_mm"))
    return good, rejected


def write_priors(priors: DataFrame, path: str) -> None:
    priors.write.mode("overwrite").json(path)


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """Only the matrix is read back; the quantiles in the file are for audits."""
    return spark.read.schema("jaw string, mean_rotation array<double>").json(path)


def resolve_volumes(candidates: DataFrame, keys: Sequence[str], default: str) -> DataFrame:
    """Volume of every candidate: its own, its coarse target's, the only one of the group, else the default."""
    keys = list(keys)
    known = candidates.where(F.col("volume_path").isNotNull())
    coarse = first_per_key(known.select(*keys, F.col("target").alias("coarse_target"), F.col("volume_path").alias("_coarse"), "candidate_index"),
                           [*keys, "coarse_target"], [F.col("candidate_index")]).drop("candidate_index")
    only = known.groupBy(*keys).agg(F.count_distinct("volume_path").alias("_n"), F.min("volume_path").alias("_only"))
    out = candidates.join(coarse, [*keys, "coarse_target"], "left").join(only, keys, "left")
    return out.withColumn("resolved_volume", F.coalesce(
        "volume_path", "_coarse", F.when(F.col("_n") == 1, F.col("_only")), F.lit(default))).drop("_coarse", "_n", "_only")
