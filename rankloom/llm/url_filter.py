"""Web address rules held in a sorted array of 64-bit digests that tasks map into memory."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table
from rankloom.session import ship_package


@dataclass(frozen=True)
class Rule:
    """``host`` is a lower-case domain, ``path`` empty or starting with a slash, ``verdict`` allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_column(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def write_array(rules: list[Rule], folder: Path) -> list[Path]:
    """Digests in ascending order, with the full rule texts and verdicts in the same order.

    Of two rules for one host and path the blocking one stays.
    """
    best = {(r.host, r.path): r for r in sorted(rules, key=lambda r: r.verdict)}  # block sorts after allow
    ordered = sorted(best.values(), key=lambda r: (digest(r.host + "\n" + r.path), r.text))
    texts = [(r.host + "\n" + r.path).encode() for r in ordered]
    ends = np.cumsum([0] + [len(t) for t in texts])
    files = {
        "digests": np.array([digest(t.decode()) for t in texts], np.uint64),
        "ends": ends.astype(np.int64),
        "texts": np.frombuffer(b"".join(texts), np.uint8),
        "blocks": np.array([r.verdict == "block" for r in ordered], np.uint8),
        "sizes": np.array(sorted({len(r.path) for r in ordered}), np.int64),
    }
    paths = []
    for name, values in files.items():
        (path := folder / f"{folder.name}-{name}.bin").write_bytes(values.tobytes())
        paths.append(path)
    return paths


class DigestArray:
    """The array as a task sees it: mapped, not read; equal digests are told apart by the stored text."""

    def __init__(self, prefix: str):
        kinds = {"digests": np.uint64, "ends": np.int64, "texts": np.uint8, "blocks": np.uint8, "sizes": np.int64}
        for name, kind in kinds.items():
            path = Path(SparkFiles.get(f"{prefix}-{name}.bin"))
            setattr(self, name, np.memmap(path, kind, "r") if path.stat().st_size else np.zeros(0, kind))

    def find(self, keys: list[str]) -> np.ndarray:
        """Position of each key, -1 where it is absent: one vectorised binary search, then the texts are compared."""
        if not len(self.digests) or not keys:
            return np.full(len(keys), -1, np.int64)
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)):
            place, key = int(at[i]), keys[i].encode()
            while place < len(self.digests) and self.digests[place] == wanted[i]:
                if self.texts[self.ends[place]:self.ends[place + 1]].tobytes() == key:
                    found[i] = place
                    break
                place += 1
        return found

    def judge(self, hosts: list[str], paths: list[str], default: str) -> tuple[list[str | None], list[str]]:
        """Longest fitting rule of each address; of two equally long ones that with the longer host."""
        keys, owner, sizes = [], [], [int(n) for n in self.sizes]
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            while host:
                for n in sizes:
                    if n <= len(path):
                        keys.append(host + "\n" + path[:n])
                        owner.append(i)
                _, _, host = host.partition(".")
        found, best = self.find(keys), {}
        for k in np.flatnonzero(found >= 0):
            host, _, path = keys[k].partition("\n")
            rank = (len(host) + len(path), len(host))
            if owner[k] not in best or rank > best[owner[k]][0]:
                best[owner[k]] = rank, host + path, "block" if self.blocks[found[k]] else "allow"
        rules = [best[i][1] if i in best else None for i in range(len(hosts))]
        return rules, [best[i][2] if i in best else default for i in range(len(hosts))]


_OPEN: dict[str, DigestArray] = {}


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", limit: int = 1 << 30) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    The array of ``rules`` is written once by the driver and sent to each executor as a file
    (``limit`` bytes at most, checked), where tasks map it. Each address probes its host and parent
    domains with those lengths of path that occur in the rules. No rule: rule is null and verdict is
    ``default``. Null addresses and ones without ``://``: host and path empty. Repeated rows are
    judged each; an empty table or no rules give no matches. Columns of the four names are replaced.
    Nothing is shuffled, so a host with a third of all rows is no hot key.
    """
    ship_package(pages.sparkSession)
    folder = Path(tempfile.mkdtemp(prefix="digests"))
    files = write_array(rules, folder)
    if sum(f.stat().st_size for f in files) > limit:
        raise ValueError("the rules exceed the limit of the digest array")
    for file in files:
        pages.sparkSession.sparkContext.addFile(str(file))
    prefix = folder.name

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if prefix not in _OPEN:
            _OPEN.clear()
            _OPEN[prefix] = DigestArray(prefix)
        found, verdicts = _OPEN[prefix].judge(hosts.to_pylist(), paths.to_pylist(), default)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["rule", "verdict"])

    named = pages.withColumns({"host": host_column(F.col(url)), "path": path_column(F.col(url))})
    judged = named.withColumn("__judged", judge("host", "path"))
    return judged.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), list(RULES)).select("page_id", "host", "path", "rule", "verdict")


def _fits(rule: Rule) -> str:
    return (f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))")


def rule_sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.text), -len(r.host)))
    rule = " ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in ordered)
    verdict = " ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in ordered)
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), named AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    )
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM named"""


SQL = {"op3_url_filter": rule_sql()}
