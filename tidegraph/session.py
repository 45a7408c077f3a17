"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config(PARTITIONS, str((os.cpu_count() or 1) if cores == "*" else cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary
    folder of this machine. On a cluster a missing setting is an error, since a
    machine-local folder would not be seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"tidegraph-{os.getpid()}")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


_WRITTEN: list[str] = []


@atexit.register
def _release_at_exit() -> None:
    """What this process wrote goes when it ends, as far as its session still runs then."""
    session = SparkSession.getActiveSession() if _WRITTEN else None
    if session is not None:
        try:
            release(session)
        except Exception:  # noqa: BLE001 - the session is ending; what is left is in the folder named for it
            pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    The plan is computed once, survives lost executors and starts afresh from
    the files, so later stages do not repeat what came before. The files stay
    until ``release`` is called, as results may be read from them later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegraph/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables ``written`` made in this process; how many. Results that still depend on them can no longer be read."""
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the Python workers of the session's executors, once per application.

    Functions that run in workers import it there; a cluster need not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tidegraph-")) / "tidegraph.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a side to broadcast if it has at most ``most`` rows, which is counted first; otherwise as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Session setting: into how many partitions ``spread`` puts rows before costly work row by row.
PARTITIONS = "spark.tidegraph.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as ``spark.tidegraph.partitions`` names, by a hash of ``keys``; as it is read where that is not set.

    For tables of a few files with one row group each, which leave most cores idle. It is set for sessions of
    one machine; a cluster that reads many files needs no such step. The rows are the same either way.
    """
    wanted = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted), *keys) if wanted else df
