"""Session set-up that the rest of the library relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once per application: they unpickle kernels by module name."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="strandlake-")) / "strandlake.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset in local mode (tests), a temporary folder is made and
    set.  On a cluster it has to be set: a machine's own folder can't be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Bytes a core below which a table counts as small.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, which its few row groups would leave to a core or two, dealt to all cores; a large one as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
