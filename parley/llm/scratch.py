"""Tables written in the cluster's shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only where all of Spark is this one process, as
    in tests, a folder of our own stands in for it; on a cluster a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = own = tempfile.mkdtemp(prefix="spark-parley-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{_LOCAL[context.applicationId]}"


class Scratch:
    """Tables of one run of an operator; drop() removes those that no later step reads.

    Shuffle files of finished jobs go when the driver collects their plans as garbage, which a driver with
    room to spare would put off until disks are full: drop() asks for it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{folder(spark).rstrip('/')}/parley-{uuid.uuid4().hex}"
        self.tables = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.at}/{self.tables}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["scratch_path"] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            if path := df.__dict__.pop("scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        gc.collect()
        jvm.java.lang.System.gc()
