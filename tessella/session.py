"""Session helpers shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    One machine may go without: a folder in its temporary directory is taken. A cluster may not, as its
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/tessella-checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage.

    The folder is that of ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tune(spark: SparkSession) -> None:
    """Runtime settings the operators count on; values a user has set are left alone.

    The JVM never compiles methods over 8000 bytes of bytecode, and pair predicates fused with
    their join easily get there. Under this limit Spark splits such a stage into smaller
    methods instead of fusing it, which makes pair joins several times faster.
    """
    _set_unless_changed(spark, "spark.sql.codegen.hugeMethodLimit", "65535", "8000")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of about 4 MB; a value a user has set is left alone.

    Spark's own 64 MB are held several times: by the task's writer, whose buffers double, by the worker, and by what it makes of them.
    """
    _set_unless_changed(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def _set_unless_changed(spark: SparkSession, key: str, default: str, value: str) -> None:
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, value)


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    import uuid

    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
