"""Session factory, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that any session of this engine wants; existing values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    b = SparkSession.builder.master(master).appName("chunkweave")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("CHUNKWEAVE_DRIVER_MEMORY", "8g"),
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "chunkweave-warehouse"),
    }
    for key, value in (settings | conf).items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    A local session that names none (tests, a laptop) gets a private one.  On a
    cluster that is an error: a folder of one machine is not seen by the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chunkweave-shared-")
    return _LOCAL[app]


def spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer splits than they are: for heavy work on few files.

    A scan of enough splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else df


#: Rows of one Arrow batch where texts go to Python: a batch of whole texts stays a few MB.
TEXT_BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read many times.

    A lost executor costs nothing: the files are on shared storage.  Tables stay
    until `drop` is called on them, because a lazy result may still read them;
    who has written that result can `release` all that was made on the way.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str, *by: str) -> None:
        """Appends to a table, compressed well; by: columns whose values are folders."""
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of what has been written: its cleaner waits for a collection of the driver's heap."""
        self.spark._jvm.System.gc()

    @classmethod
    def release(cls, since: int) -> None:
        """Drops the folders made after the first `since` ones."""
        for s in cls.made[since:]:
            s.drop()
        del cls.made[since:]
