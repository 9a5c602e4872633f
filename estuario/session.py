"""Session builder and the few settings every operator relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of Parquet that one shuffle partition stands for; rows take several times their Parquet size in a shuffle.
PARTITION_BYTES = 64 << 20
#: More shuffle partitions than this cost more in blocks than they save; beyond it partitions grow and spill.
MOST_PARTITIONS = 50_000
_MADE: list[str] = []


def build(master: str = "local[*]", *, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; without a partition count the tables read raise it as needed."""
    b = (
        SparkSession.builder.master(master)
        .appName("estuario")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local master may do without it and gets a temporary one: on a cluster
    a folder of one machine would lose the data with that machine, so an unset folder is an error there.
    The data survive the loss of an executor, which a local checkpoint would not.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="estuario-ckpt-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables below the shared checkpoint folder (see :func:`checkpoint`)."""
    from uuid import uuid4

    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="estuario-")
    _MADE.append(f"{folder.rstrip('/')}/{name}-{uuid4().hex}")
    return _MADE[-1]


def forget(spark: SparkSession) -> int:
    """Deletes the written tables this process has made below the shared folder; call it when no frame that reads them is needed any more."""
    n = 0
    while _MADE:
        p = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table below the shared folder and read back, so many readers prune its columns and none recomputes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions_for(size: int, current: int) -> int:
    """The shuffle partitions for an input of ``size`` bytes: never fewer than ``current``, and one for every PARTITION_BYTES up to MOST_PARTITIONS.

    Adaptive execution merges small partitions but never splits those of an aggregate, so the count must follow the input.
    """
    return max(current, min(MOST_PARTITIONS, -(-size // PARTITION_BYTES)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; raises the session's shuffle partitions where the table's size asks for more."""
    path = f"{sf_dir}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if (n := partitions_for(size, now)) > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return spark.read.parquet(path)
