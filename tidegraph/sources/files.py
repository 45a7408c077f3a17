"""Listing of files, caches of copies, and readers that check what they read."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.schemas import mismatches


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime").orderBy("path")


def natural_key(name: str) -> tuple:
    """Sorts numbers inside names as numbers."""
    return tuple(int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name))


def natural_order(path: str = "path"):
    """The same as columns, by the first number in a path."""
    return [F.coalesce(F.regexp_extract(path, r"(\d+)(?!.*/)", 1).try_cast("bigint"), F.lit(-1)), F.col(path)]


def safe_path(root: str | Path, relative: str) -> Path:
    """A path below ``root``; absolute ones and those that lead out of it are an error."""
    base = Path(root).resolve()
    if os.path.isabs(relative) or ".." in Path(relative).parts:
        raise ValueError(f"unsafe path: {relative!r}")
    made = (base / relative).resolve()
    if base != made and base not in made.parents:
        raise ValueError(f"unsafe path: {relative!r}")
    return made


def checksum(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class Cache:
    """Copies of source files, used again while their size is the same; an index keeps their checksums."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.index_path = self.folder / "index.json"
        self.index = json.loads(self.index_path.read_text()) if self.index_path.exists() else {}

    def get(self, name: str, size: int, fetch: Callable[[Path], None]) -> Path:
        at = safe_path(self.folder, name)
        if not (at.exists() and at.stat().st_size == size):
            part = at.with_name(at.name + ".part")
            part.parent.mkdir(parents=True, exist_ok=True)
            fetch(part)
            os.replace(part, at)
        known = self.index.get(name)
        if not known or known["size"] != at.stat().st_size:
            self.index[name] = {"size": at.stat().st_size, "sha256": checksum(at)}
            part = self.index_path.with_suffix(".part")
            part.write_text(json.dumps(self.index, indent=1, sort_keys=True))
            os.replace(part, self.index_path)
        return at


class LocalSource:
    """Files of a local folder; the interface other schemes would implement."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def list_files(self) -> list[dict]:
        found = [p for p in self.root.rglob("*") if p.is_file()]
        return [{"name": str(p.relative_to(self.root)), "size": p.stat().st_size, "modified": p.stat().st_mtime} for p in sorted(found, key=lambda p: natural_key(str(p)))]

    def fetch(self, name: str, to: Path) -> None:
        shutil.copyfile(safe_path(self.root, name), to)


def build_source(address: str) -> LocalSource:
    """The source for an address: a folder, or file://; remote schemes need a plug-in that is not part of this package."""
    scheme, _, rest = address.partition("://")
    if rest and scheme != "file":
        raise NotImplementedError(f"no source for {scheme}://")
    return LocalSource(rest or address)


def checked_table(spark: SparkSession, path: str, ddl: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table that has the columns of a schema; raises with what is wrong."""
    df = spark.read.parquet(path)
    wrong = mismatches(df, ddl)
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*(columns or [p.rsplit(" ", 1)[0] for p in ddl.split(", ")]))


def canonical_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges written under snapshot=s/relation=r, in their canonical names; partition filters prune folders."""
    df = spark.read.parquet(path)
    return df.withColumnsRenamed({"snapshot": "snapshot_id", "relation": "relation_id"})
