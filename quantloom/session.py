"""Session settings, reliable lineage cuts and stored intermediates."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
#: Shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: The plan is fixed before it runs, so what is written keeps its partitions and order for later steps.
FIXED = {"spark.sql.adaptive.enabled": "false"}
#: Sides that lie in the same partitions by a part of the join's keys are joined where they are.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
_SCRATCH: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A laptop session for tests and bench; clusters bring their own session.

    ``folder`` holds checkpoints and stored intermediates; a new temporary one if not given.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quantloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Window stages are bound by processor time, not bytes: keep one task per core.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(FOLDER_SETTING, folder or tempfile.mkdtemp(prefix="quantloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application, so that Python stages run wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    place = f"{scratch_folder(spark)}/quantloom.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    context.addPyFile(place)
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only on a local master without the setting."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(FOLDER_SETTING, None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {FOLDER_SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="quantloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder for stored intermediates, in the shared folder.

    It is removed when the driver ends, or by ``clear_scratch``.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{checkpoint_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
        atexit.register(clear_scratch, spark)
    return _SCRATCH[app]


def clear_scratch(spark: SparkSession) -> None:
    """Remove what ``stored`` wrote for this application; frames read from it end with it."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    folder = _SCRATCH.pop(context.applicationId, None)
    if folder is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what is planned inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written as Parquet in the scratch folder and read again.

    Unlike a checkpoint the copy is columnar: later readers take only the
    columns and rows they need, and a lost executor reads them again.
    """
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, RELEASED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    Later stages then read one fixed copy, so a lost executor cannot bring back
    rows in another order, and several consumers do not compute it twice. The
    shuffle files of the write are removed as soon as it ends.
    """
    checkpoint_folder(df.sparkSession)
    with settings(df.sparkSession, RELEASED):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made with the settings
