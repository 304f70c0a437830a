"""Tables in the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster, whose machines would not share that, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = current.rsplit("/", 1)[0] if current else "file://" + tempfile.mkdtemp(prefix="tabulon-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def free_name(name: str, columns: list[str]) -> str:
    """`name`, with underscores added until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Written tables of one operator call. `keep` writes a frame and returns it reread; `drop` deletes what is no longer needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/tabulon/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def keyed(self, df: DataFrame) -> tuple[DataFrame, str]:
        """`df` with a key of each row, and that column's name; written, as the keys of a frame computed twice may differ."""
        key = free_name("row__key", df.columns)
        return self.keep(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key

    def drop_but(self, *names: str) -> None:
        """Deletes every table but those named."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        found = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        rest = [f.getPath().getName() for f in found if f.getPath().getName() not in names]
        if rest:
            self.drop(*rest)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(conf).delete(path, True)
