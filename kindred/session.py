"""Session defaults and the few places where an action decides a plan."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast, or a catalogue shipped whole to the tasks, only below this.
BROADCAST_BYTES = 64 * 1024 * 1024
_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "2000"
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def build_session(app: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides any default."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once per application.

    Workers also get one BLAS thread each unless the session says otherwise: Spark already
    runs a task per core. They return freed memory to the system, and batches of rows for them
    are kept small, unless the session names another size: rows may be long texts.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    for threads in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        context.environment.setdefault(threads, "1")
    for setting, value in WORKER_MEMORY.items():
        context.environment.setdefault(setting, value)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kindred-py-")) / "kindred.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names.

    Only a local session that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="kindred-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all paths of an application lie in one folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/kindred-{application}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    For results that are used several times or that close a round of an iteration: they
    are computed once, a lost executor replays no earlier step, later steps read only the
    columns they need, and the size on disk lets Catalyst choose broadcasts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_width(df: DataFrame) -> int:
    """Tasks for work that is heavy per row: stated, so that few bytes are not one task."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows by a hash of ``key`` over ``spread_width`` tasks.

    By an expression and not by the key itself: a plan already partitioned by the key would
    drop the step and let adaptive execution merge its few bytes into one task.
    """
    return df.repartition(spread_width(df), F.xxhash64(key))


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit / row_bytes`` rows.

    Reads no more than that many rows plus one, so the check itself is bounded.
    """
    most = max(1, limit // max(1, row_bytes))
    return df.limit(most + 1).count() <= most


def broadcast_if_fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after checking the size; otherwise leave the join to Catalyst."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df
