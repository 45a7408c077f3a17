"""Resumable ingestion of files, each row committed once.

A finite set of files is read in micro-batches that never split a row. Each batch
writes the folder ``batch_id=<n>`` of its target and then a digest of its rows beside it. A batch that
is run again after a failure is skipped if its rows are those committed and refused if they are others; the stream's
checkpoint says where to go on. All paths may be of any file system Spark knows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidegraph.sources import remote


def guard(folder: str | Path, fingerprint: str, inputs: Mapping[str, str] | None = None) -> None:
    """Refuses to go on with other settings, or other content of an input, than those a run began with.

    ``inputs``: checksums by name; new names are added, a known one with another checksum is drift.
    """
    at = f"{folder}/settings.json"
    before = json.loads(remote.read_text(at)) if remote.exists(at) else {"settings": fingerprint, "inputs": {}}
    if before["settings"] != fingerprint:
        raise ValueError("the settings have changed since this run began")
    changed = sorted(n for n, c in (inputs or {}).items() if before.get("inputs", {}).get(n, c) != c)
    if changed:
        raise ValueError(f"inputs have changed since this run began: {', '.join(changed)}")
    remote.write_text(at, json.dumps({"settings": fingerprint, "inputs": {**before.get("inputs", {}), **(inputs or {})}}, sort_keys=True))


def digest(df: DataFrame) -> dict[str, int]:
    """Rows and an order-insensitive hash of them."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"rows": r.rows, "sum": r.sum}


def commit_batch(batch: DataFrame, target: str, batch_id: int) -> bool:
    """Writes one batch and its digest; False if it was committed already. Raises if it was committed with other rows."""
    made, at = digest(batch), f"{target}/_digests/{batch_id}.json"
    if remote.exists(at):
        if json.loads(remote.read_text(at)) != made:
            raise ValueError(f"batch {batch_id} was committed with other rows")
        return False
    batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch_id={batch_id}")
    remote.write_text(at, json.dumps(made, sort_keys=True))
    return True


def ingest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 8, fmt: str = "parquet", seconds: float | None = None
) -> int:
    """Reads the files of ``source`` that are not committed yet and returns how many batches that took.

    With ``seconds`` it stops gracefully after that time; the next call goes on from there.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    done: list[int] = []

    def commit(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        commit_batch(out, target, batch_id)
        done.append(batch_id)

    query: StreamingQuery = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(int(seconds)) if seconds else query.awaitTermination():
        query.stop()
    if query.exception():
        raise query.exception()
    return len(done)


def committed(spark: SparkSession, target: str) -> DataFrame:
    """All committed rows."""
    return spark.read.parquet(target).drop("batch_id")


def running_counts(spark: SparkSession, source: str, schema: StructType, keys: list[str], folder: str) -> DataFrame:
    """Row counts per key as a stateful aggregation whose changed states are written batch by batch below ``folder``.

    Counts only grow, so a key's largest state is its last. States stay in the checkpoint, so a restart goes
    on with them, and nothing is held by the driver.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/states/batch_id={batch_id}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(counts.schema).parquet(f"{folder}/states").groupBy(*keys).agg(F.max("rows").alias("rows"))


def missing_batches(expected: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Expected batches that were not committed."""
    return expected.select(key).distinct().join(target.select(key).distinct(), key, "left_anti")


def _batches(folder: str | Path) -> dict[str, bool]:
    """The batch folders and whether each is complete."""
    return {n: remote.exists(f"{folder}/{n}/_SUCCESS") for n in remote.children(str(folder)) if n.startswith("batch_id=")}


def assess(folder: str | Path, expected: int, replace: bool = False) -> str:
    """absent, empty, incomplete or completed: how far a run's committed batches go; 'replace' if a run that is not completed may be begun anew."""
    if not remote.exists(str(folder)):
        return "absent"
    got = [n for n, whole in _batches(folder).items() if whole]
    state = "empty" if not got else "completed" if len(got) >= expected else "incomplete"
    return "replace" if replace and state == "incomplete" else state


def quarantine(folder: str | Path, aside: str | Path) -> list[str]:
    """Moves unfinished batches (without a commit marker) aside and names them."""
    broken = [n for n, whole in _batches(folder).items() if not whole]
    for n in broken:
        remote.move(f"{folder}/{n}", f"{aside}/{n}")
    return broken
