"""Session helpers: input tables, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


SHIPPED: set[str] = set()
#: Intermediate tables of this process.
WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="textloom-package-")) / "textloom.zip"  # of the driver alone: Spark serves it from there
    atexit.register(shutil.rmtree, path.parent, True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(package.rglob("*")):
            if file.suffix in (".py", ".npz"):
                packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (tests, local runs), a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a parquet table in the shared folder and read it again.

    A written table survives the loss of executors, is compressed, and lets later scans prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables written since ``len(WRITTEN)`` was ``since``; only after all results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in WRITTEN[since:]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del WRITTEN[since:]


def _leave() -> None:
    """Delete what is left of the intermediate tables when the process ends in order, while its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and WRITTEN:
        try:
            purge(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone
            pass


atexit.register(_leave)

#: Operators after which partitions follow from a shuffle; counting them would run it.
SHUFFLING = re.compile(r"^[\s:+-]*(?:Join|Aggregate|Window|Sort|Repartition\w*|Distinct|Deduplicate|Intersect|Except|GlobalLimit|Generate)\b", re.MULTILINE)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few partitions as many as the cluster has cores, so that Python stages use all of them.

    A scan of a large table already has more partitions than that and stays as it is, without a shuffle; so does whatever comes
    out of a shuffle.
    """
    ship(df.sparkSession)
    if SHUFFLING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
