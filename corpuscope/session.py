"""Session helpers shared by jobs, streams, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shuffle files go when the action that wrote them ends. Otherwise those of all steps of a query stay on disk until the driver
#: happens to collect its garbage. What a lost executor takes with it is computed again either way.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "corpuscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        FREE_SHUFFLES: "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return _spread(builder.getOrCreate())


def _spread(spark: SparkSession) -> SparkSession:
    """Local sessions deal small scans over their cores."""
    if spark.sparkContext.master.startswith("local[") and spark.conf.get("spark.corpuscope.spread", None) is None:
        spark.conf.set("spark.corpuscope.spread", spark.sparkContext.defaultParallelism)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the registered queries rely on, for a session that ``build_session`` did not make.

    Only a local session that names no shared folder gets a scratch folder for checkpoints.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set(FREE_SHUFFLES, "true")
    if not checkpoint_folder(spark) and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return _spread(spark)


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``, or one that was set on the context."""
    sc = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables; all executors must share it."""
    folder = checkpoint_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder: for large texts, which a checkpoint would write as they are."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
