"""Tables cut out of the lineage, in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder.  Where it is unset and all runs on
one machine, as in tests, a temporary folder serves and goes with the driver; on
a cluster that is an error.  A cut is written as
Parquet and read back: it survives lost executors, since nothing upstream of it
is ever computed again, and columns are pruned on the way back in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinloom.session import shared_folder


class Scratch:
    """A folder of its own for one job's intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/kinloom/{name}-{uuid.uuid4().hex}"
        self._next = 0

    def path(self, name: str) -> str:
        self._next += 1
        return f"{self.root}/{self._next:03d}-{name}"

    def cut(self, frame: DataFrame, name: str) -> DataFrame:
        """Write the frame and read it back."""
        return self._written(frame, frame, name)

    def cut_with_state(self, frame: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
        """The cut, its number of rows and the sum of its rows' hashes, taken as it is written."""
        seen = Observation()
        watched = frame.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")).alias("h"))
        out = self._written(watched, frame, name)
        return out, (seen.get["n"], seen.get["h"])

    def _written(self, watched: DataFrame, frame: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        watched.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._kinloom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete cut tables that no later step reads."""
        for frame in frames:
            if path := getattr(frame, "_kinloom_path", None):
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
