"""Session settings, and the one shared folder for checkpoints and written tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Tables stored by this driver and not yet removed, oldest first.
_STORED: list[str] = []


def local_session(cores: str = "*", app_name: str = "trialstats", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is made up only where nothing is set and the session is local; a cluster
    without a shared folder is an error, since a machine-local one would be lost with its machine.
    """
    context = spark.sparkContext
    active = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named is None and active.isDefined():
        return active.get()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="trialstats-")
    if not active.isDefined():
        context.setCheckpointDir(named)
        return context._jsc.sc().getCheckpointDir().get()
    return active.get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder now; later plans read the stored rows, on any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder now and read it from there.

    Like ``cut_lineage``, but columnar, and Spark knows the true size of what it reads when it plans
    joins. Row order is not kept.
    """
    path = shared_path(df.sparkSession, "stored")
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    _STORED.remove(path)


def remove_stored(df: DataFrame) -> None:
    """Remove a ``stored_table`` that no plan reads any more."""
    for path in [p for p in _STORED if any(f"{p.rsplit('/', 1)[-1]}/" in f for f in df.inputFiles()[:1])]:
        _remove(df.sparkSession, path)


@contextlib.contextmanager
def removing_stored(spark: SparkSession) -> Iterator[None]:
    """Own the tables stored inside the block: all of them are removed at its end.

    Results of the block must be written or collected inside it, because they read those tables.
    """
    before = len(_STORED)
    try:
        yield
    finally:
        for path in _STORED[before:]:
            _remove(spark, path)
