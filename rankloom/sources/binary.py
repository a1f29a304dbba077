"""Decoders of binary files: Spark lists and splits the files, a task decodes one file at a time.

Each decoder takes a table (path, content), so files can come from a folder or from anywhere else; what a decoder
cannot read is left out of its rows and named, with a reason, by ``rejected``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

# Sample types of a volume header by code.
SAMPLES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER = 352
BAD = (ValueError, KeyError, IndexError, EOFError, OSError, zlib.error)
_VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)")


def files_below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")


def matrix_of(raw: bytes) -> list[float]:
    value = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
    if value.shape != (4, 4) or not np.isfinite(value).all():
        raise ValueError("no finite 4x4 matrix")
    return value.reshape(-1).tolist()


def corners_of(raw: bytes) -> np.ndarray:
    """Corners of all triangles of an STL file, binary or text."""
    if raw[:5].lower() == b"solid" and b"facet" in raw[:2048]:
        found = np.array(_VERTEX.findall(raw), dtype="S64").astype(float).reshape(-1, 3)
        if len(found) % 3:
            raise ValueError("a triangle is cut off")
        return found.astype("<f4")
    count = int(np.frombuffer(raw, "<u4", 1, 80)[0])
    record = np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("tag", "<u2")])
    return np.frombuffer(raw, record, count, 84)["corner"].reshape(-1, 3)


def header_of(raw: bytes) -> tuple[tuple[int, ...], np.ndarray, np.dtype, int, float, float]:
    """Shape, affine, sample type, offset, slope and intercept; of a packed file only the head is unpacked."""
    head = zlib.decompressobj(31).decompress(raw, HEADER) if raw[:2] == b"\x1f\x8b" else raw[:HEADER]
    order = "<" if np.frombuffer(head, "<i4", 1, 0)[0] in (0, 348) else ">"
    dims = np.frombuffer(head, order + "i2", 8, 40)
    kind = np.dtype(SAMPLES[int(np.frombuffer(head, order + "i2", 1, 70)[0])]).newbyteorder(order)
    offset = int(np.frombuffer(head, order + "f4", 1, 108)[0])
    slope, inter = (float(v) for v in np.frombuffer(head, order + "f4", 2, 112))
    affine = np.eye(4)
    affine[:3] = np.frombuffer(head, order + "f4", 12, 280).reshape(3, 4)
    shape = tuple(int(d) for d in dims[1:4])
    if min(shape) < 1:
        raise ValueError("empty volume")
    return shape, affine, kind, offset, slope, inter


def volume_of(raw: bytes) -> tuple[np.ndarray, float, float]:
    """Samples in their own type, slope and intercept."""
    shape, _, kind, offset, slope, inter = header_of(raw)
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    volume = np.frombuffer(data, kind, int(np.prod(shape)), offset).reshape(shape, order="F")
    return volume, (slope if slope else 1.0), (inter if slope else 0.0)


def unpacked(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


READERS = {"matrix": matrix_of, "mesh": corners_of, "volume": volume_of, "header": header_of, "payload": unpacked}


def readable(batches: Iterable[pd.DataFrame], kind: str) -> Iterator[tuple[str, object]]:
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            try:
                yield path, READERS[kind](bytes(raw))
            except BAD:
                continue


def rejected(files: DataFrame, kind: str) -> DataFrame:
    """(path, reason) of the files that the decoder of ``kind`` cannot read."""
    ship_package(files.sparkSession)

    def judge(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    READERS[kind](bytes(raw))
                except BAD as error:
                    rows.append((path, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "reason"])

    return files.select("path", "content").mapInPandas(judge, "path string, reason string")


def decode_matrices(files: DataFrame) -> DataFrame:
    """(path, transform); a file that does not hold a finite 4x4 matrix gives a null one."""
    ship_package(files.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decode(content: pd.Series) -> pd.Series:
        out = []
        for raw in content:
            try:
                out.append(matrix_of(bytes(raw)))
            except BAD:
                out.append(None)
        return pd.Series(out)

    return files.select("path", decode("content").alias("transform"))


def decode_meshes(files: DataFrame) -> DataFrame:
    """Distinct vertices of STL files as rows (path, point_id, x, y, z), in order of first use."""
    ship_package(files.sparkSession)

    def decode(batches):
        for path, corners in readable(batches, "mesh"):
            _, first = np.unique(corners, axis=0, return_index=True)
            points = corners[np.sort(first)].astype(float)
            for start in range(0, len(points), 65536):
                part = points[start:start + 65536]
                yield pd.DataFrame({"path": path, "point_id": np.arange(start, start + len(part)), "x": part[:, 0], "y": part[:, 1], "z": part[:, 2]})

    return files.select("path", "content").mapInPandas(decode, "path string, point_id long, x double, y double, z double")


def pooled(parts: Iterable[dict], rows: int = 65536) -> Iterator[pd.DataFrame]:
    """Columns of many small files in frames of about ``rows`` rows; a part is a dictionary of equally long columns."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part["path"])
        if size >= rows:
            yield pd.DataFrame({c: list(chain.from_iterable(p[c] for p in held)) if c in ("path", "affine") else np.concatenate([p[c] for p in held]) for c in part})
            held, size = [], 0
    if held:
        yield pd.DataFrame({c: list(chain.from_iterable(p[c] for p in held)) if c in ("path", "affine") else np.concatenate([p[c] for p in held]) for c in held[0]})


def decode_volumes(files: DataFrame, minimum: float) -> DataFrame:
    """Voxels at or above ``minimum`` as rows (path, i, j, k, hu); one slab at a time becomes double."""
    ship_package(files.sparkSession)

    def slabs(batches):
        for path, (volume, slope, inter) in readable(batches, "volume"):
            for i in range(volume.shape[0]):
                slab = volume[i].astype(float) * slope + inter
                j, k = np.nonzero(slab >= minimum)
                if len(j):
                    yield {"path": [path] * len(j), "i": np.full(len(j), i, "int32"), "j": j.astype("int32"), "k": k.astype("int32"), "hu": slab[j, k]}

    return files.select("path", "content").mapInPandas(lambda batches: pooled(slabs(batches)), "path string, i int, j int, k int, hu double")


def decode_headers(files: DataFrame) -> DataFrame:
    """Shape and affine of every volume; no voxel is unpacked."""
    ship_package(files.sparkSession)

    def heads(batches):
        for path, (shape, affine, *_) in readable(batches, "header"):
            yield {"path": [path], "nx": [shape[0]], "ny": [shape[1]], "nz": [shape[2]], "affine": [affine.reshape(-1).tolist()]}

    return files.select("path", "content").mapInPandas(lambda batches: pooled(heads(batches)), "path string, nx int, ny int, nz int, affine array<double>")


def read_matrices(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    return decode_matrices(files_below(spark, root, pattern))


def read_meshes(spark: SparkSession, root: str, pattern: str = "*.stl") -> DataFrame:
    return decode_meshes(files_below(spark, root, pattern))


def read_volumes(spark: SparkSession, root: str, minimum: float, pattern: str = "*.nii*") -> DataFrame:
    return decode_volumes(files_below(spark, root, pattern), minimum)


def read_volume_headers(spark: SparkSession, root: str, pattern: str = "*.nii*") -> DataFrame:
    return decode_headers(files_below(spark, root, pattern))


def mesh_bounds(points: DataFrame) -> DataFrame:
    aggs = [f(c).alias(f"{tag}_{c}") for c in "xyz" for f, tag in ((F.min, "low"), (F.max, "high"))]
    return points.groupBy("path").agg(*aggs)


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return files_below(spark, root, pattern).select("path", "length", F.sha2("content", 256).alias("digest"))


def hash_payloads(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """SHA-256 of the unpacked payload of (path, length, mtime, content): the same bytes packed twice have one hash.

    Files whose path, size and time are in the cache are not opened; their hash comes from it.
    """
    ship_package(files.sparkSession)
    known = ["path", "length", "mtime"]
    todo = files if cache is None else files.join(cache.select(*known), known, "left_anti")

    @F.pandas_udf(T.StringType())
    def digest(content: pd.Series) -> pd.Series:
        out = []
        for raw in content:
            try:
                out.append(hashlib.sha256(unpacked(bytes(raw))).hexdigest())
            except BAD:
                out.append(None)
        return pd.Series(out, dtype=object)

    fresh = todo.select(*known, digest("content").alias("digest"))
    if cache is None:
        return fresh
    return fresh.unionByName(files.select(*known).join(cache, known).select(*known, "digest"))


def payload_hashes(spark: SparkSession, root: str, pattern: str = "*", cache: DataFrame | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    listed = reader.load(root).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return hash_payloads(listed.withColumn("mtime", F.unix_micros("modificationTime")), cache)
