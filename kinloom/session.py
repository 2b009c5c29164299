"""Tables cut out of the lineage, for operators that iterate."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='kinloom-')}"
        _made.append(folder.removeprefix("file://"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@atexit.register
def _clear() -> None:
    """Temporary folders go with the driver."""
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


def cut(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    A frame that a query returns reads these tables when it is evaluated, so
    they stay until the folder's owner clears it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/kinloom/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def cut_and_count(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The cut and its number of rows, taken as it is written."""
    seen = Observation()
    out = cut(frame.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]
