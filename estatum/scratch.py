"""Where intermediate tables and round trips are written, and read back from."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders by application and base.
RUNS: dict[tuple[str, str], str] = {}


def _run(spark: SparkSession, base: str) -> str:
    """One folder an application below ``base``, gone when its driver ends."""
    key = (spark.sparkContext.applicationId, base)
    if key in RUNS:
        return RUNS[key]
    path = RUNS[key] = f"{base}/estatum/{key[0]}-{uuid.uuid4().hex[:8]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is the cluster's to clear then
            pass

    atexit.register(remove)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name below the shared one that ``spark.checkpoint.dir`` names;
    where that is unset, a temporary one for local masters and the warehouse else."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = (spark.sparkContext.master or "").startswith("local[")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{_run(spark, base)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet, written and read again: cuts the lineage, and a lost executor
    costs no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
