"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of written tables under spark.checkpoint.dir, which every executor shares.

    Lineage is cut by writing a table and reading it back, so a lost executor only costs the stage at hand.
    Only where the setting is absent and the master is local (tests) is a folder of the machine taken instead; on a
    cluster its absence is an error, as executors would write where nobody else reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = _fallback()
        self.spark, self.path = spark, f"{base.rstrip('/')}/chronolith/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str | None = None) -> None:
        """Deletes one table of the folder, or the folder; nothing happens once the session has ended."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone, and its folder with it
            pass


_LOCAL: list[str] = []


def _fallback() -> str:
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="chronolith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append(f"file://{folder}")
    return _LOCAL[0]


def sized(df: DataFrame) -> bool:
    """Whether a DataFrame has any row."""
    return bool(df.take(1))
