"""Spark session and the settings that every plan relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes of their values, that may be broadcast by a size-checked hint.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "talverk", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used as it is."""
    cpus = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALVERK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    let_workers_import(spark)
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the path of Python workers, whatever folder the driver was started in."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH", ""), here]))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; only a local master gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talverk-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of what precedes."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def _write(df: DataFrame) -> str:
    path = _path(df.sparkSession)
    df.write.parquet(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """A new folder among the shared checkpoints, which `clean` deletes with the tables of `written`."""
    path = _path(spark)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: read several times, computed once.

    The table stays until `clean` or the end of the driver, as a lazy result may read it at any time.
    """
    path = _write(df)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """The frame as such a table for the length of a block; nothing that is read after the block may stand on it."""
    path = _write(df)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _delete(df.sparkSession, path)


def clean() -> None:
    """Delete the tables of `written`: for long sessions, once the results that stand on them have been used."""
    while _written:
        with suppress(Exception):  # the session may have ended
            _delete(*_written.pop())


atexit.register(clean)


def _bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row: of strings and binaries as they are, of other columns as their text, as an estimate."""
    sizes = [F.octet_length(f"`{c}`") if t in ("string", "binary") else F.lit(8) if t in ("bigint", "int", "double", "date", "timestamp", "boolean") else F.octet_length(F.to_json(F.struct(f"`{c}`"))) for c, t in df.dtypes]
    return sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the rows and bytes of a materialized frame prove the bound; else the plain frame."""
    kept = materialize(df)
    number, total = kept.agg(F.count("*"), F.coalesce(F.sum(_bytes(kept)), F.lit(0))).first()
    return F.broadcast(kept) if number <= rows and total <= size else kept
