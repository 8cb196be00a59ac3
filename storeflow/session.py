"""Session helpers: a local session for tests and benches, and a reliable
checkpoint directory taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_stages: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "storeflow") -> SparkSession:
    """Session used by tests and the bench (single JVM, UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset and the master is local (tests, bench,
    smoke checks) a private folder is created; a cluster without the
    setting is an error, since a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; point it at a shared folder of the cluster")
    path = tempfile.mkdtemp(prefix="storeflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def python_workers(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver was
    told its folder (a cluster has it installed or sent by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started in here keep their state in RocksDB, in bounded memory
    and on disk, whatever the session's provider (the default one keeps all of
    it in the executors' heaps, and has no column families for timers)."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
              "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}  # a read less for each write
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint directory for written tables
    (stream sinks, table versions)."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing a table into the shared checkpoint folder and
    reading it back: the input is computed once (an eager ``checkpoint()``
    would compute it twice), and the written files survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    _stages.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remember_stage(path: str) -> None:
    """Let ``drop_stages`` delete a table that was written elsewhere."""
    _stages.append(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables written so far; for when their readers are done."""
    while _stages:
        p = spark._jvm.org.apache.hadoop.fs.Path(_stages.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
