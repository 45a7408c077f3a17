"""Writing tables and reports so that readers never see half of them."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.hashing import canonical_hash
from tidegraph.operators.graph import first_wins
from tidegraph.operators.validate import privacy_findings
from tidegraph.sources import remote
from tidegraph.sources.files import checksum


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "overwrite") -> None:
    """Zstandard Parquet; Spark's commit makes the job's files visible together."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def write_edges(edge: DataFrame, path: str) -> None:
    """Edges under snapshot=s/relation=r, clustered so that each partition is few files."""
    named = edge.withColumnsRenamed({"snapshot_id": "snapshot", "relation_id": "relation"})
    write_table(named.repartition("snapshot", "relation", F.pmod("src_index", F.lit(16))), path, ["snapshot", "relation"])


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """A table sorted over all its files."""
    df.orderBy(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def insert_ignore(new: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Adds the rows whose key is not there yet; of several new ones with a key the first by ``order``."""
    one = first_wins(new, keys, order)
    if remote.children(path):  # a table that cannot be read or lacks the keys is an error, not an empty one
        there = new.sparkSession.read.parquet(path).select(*keys)
        one = one.join(there, keys, "left_anti")
    write_table(one, path, mode="append")


def upsert(new: DataFrame, path: str, out: str, keys: list[str], version: str) -> None:
    """``path`` with its rows replaced by newer ones of the same key, written to ``out``; the latest version wins."""
    old = new.sparkSession.read.parquet(path)
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    won = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*").select(*both.columns)
    write_table(won, out)


def write_json(value: Any, path: str | Path) -> str:
    """A JSON file, complete or not there; its hash. Addresses with a scheme go to Spark's file systems, others to this machine's."""
    text = json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False, allow_nan=False)
    if "://" in str(path):
        remote.write_text(str(path), text)
        return hashlib.sha256(text.encode()).hexdigest()
    at = Path(path)
    part = at.with_name(at.name + ".part")
    part.parent.mkdir(parents=True, exist_ok=True)
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, at)
    return checksum(at)


def seal(reports: Mapping[str, Any], folder: str | Path, fingerprint: str) -> dict:
    """Reports as JSON with a manifest of their hashes; refuses what must not be published.

    The scientific hash covers the reports and the settings, not times or places.
    """
    found = privacy_findings(dict(reports))
    if found:
        raise ValueError("; ".join(found))
    files = {name: write_json(value, f"{folder}/{name}.json") for name, value in sorted(reports.items())}
    manifest = {"files": files, "settings": fingerprint, "scientific_hash": canonical_hash({"reports": dict(reports), "settings": fingerprint})}
    write_json(manifest, f"{folder}/manifest.json")
    return manifest


def _text(path: str) -> str | None:
    """A file's text, NULL if it is not there."""
    if "://" in path:
        return remote.read_text(path) if remote.exists(path) else None
    return Path(path).read_text(encoding="utf-8") if Path(path).exists() else None


def verify(folder: str | Path) -> list[str]:
    """What is wrong with a sealed folder: missing or changed files."""
    manifest = json.loads(_text(f"{folder}/manifest.json") or '{"files": {"manifest": ""}}')
    out = []
    for name, expected in manifest["files"].items():
        try:
            text = _text(f"{folder}/{name}.json")
        except OSError:
            text = ""
        if text is None:
            out.append(f"{name} is missing")
        elif hashlib.sha256(text.encode()).hexdigest() != expected:
            out.append(f"{name} has changed")
    return out


def small_report(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a report as dictionaries; raises if it is no small report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]
