"""Session factory, table access and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

#: Tables whose rows are worth a core's time.
TEXTS = ("documents", "pages")


def get_spark(app: str = "quarry", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables by its Parquet path; columns are pruned and filters pushed by Catalyst. Texts
    that come in fewer splits than there are cores are dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, where a small file gives fewer; large inputs,
    which have more, stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Bytes of texts that a Python worker gets at once, and Spark's own default.
BATCH, DEFAULT_BATCH = "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """From now on batches of Arrow are of BATCH, unless the session has a size of its own: JVM and worker hold some
    batches each, and texts make large ones (10,000 texts are tens of megabytes)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH:
        spark.conf.set(name, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    (a local session, tests) a temporary folder of this machine, which is then set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quarry-"))
        current = context._jsc.sc().getCheckpointDir()
    return named.rstrip("/") if named else os.path.dirname(current.get().rstrip("/"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder; cuts lineage and outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, each: int) -> DataFrame:
    """The frame in as many tasks as so many rows ask for, `each` to a task, and one for each core at least;
    never in more than it has. Tasks of few rows cost more than their work."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def small(df: DataFrame, most: int) -> bool:
    """True if the frame has no more rows than `most`; reads no further than that."""
    return df.limit(most + 1).count() <= most
