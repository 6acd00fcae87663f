"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Above this many rows a side is never hinted for broadcast; Spark then chooses the
# join itself from sizes it measured.
BROADCAST_ROWS = 200_000


def build_session(app: str = "evenfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="evenfold-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    A written table is computed once; ``DataFrame.checkpoint`` would compute it a second time to write it.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Partitions for steps whose output is far larger than their input.

    Spark joins small shuffle partitions by their size in bytes, which would leave a pair join
    or a round loop over compact profiles to a task or two.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cores = spark.sparkContext.defaultParallelism
    return max(cores, min(configured, 4 * cores))


def slot_count(spark: SparkSession) -> int:
    """Tasks that surely run side by side, for barrier jobs: the cores known to the session."""
    return max(1, spark.sparkContext.defaultParallelism if spark.sparkContext.master.startswith("local") else
               spark._jsc.sc().maxNumConcurrentTasks(spark._jsc.sc().resourceProfileManager().defaultResourceProfile()))
