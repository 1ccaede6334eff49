"""Session helpers shared by the operators: scratch tables in the shared folder, and batch sizes.

Intermediate results that are read more than once, or that cut a long lineage, are written as
Parquet below ``spark.checkpoint.dir``, the folder which every executor of a cluster can reach.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.session import shared_dir, ship

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches of at most 1,000 rows: whole texts travel in them, and a worker holds one at a time."""
    ship(spark)
    if int(spark.conf.get(BATCH_ROWS, "10000")) > 1000:
        spark.conf.set(BATCH_ROWS, "1000")
    return spark


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """Within, an eager write's shuffle files go as soon as it has ended: nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """A folder of written tables below the shared folder; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = tune(spark)
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with dropping_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
