"""Row identity and tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a list of row ids is sent to every executor (8 bytes each
#: and hash-table overhead: tens of MB); longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; if that is unset, a temporary one in local mode and an error on a cluster, where no machine's folder is shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quillgrid-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> SparkSession:
    """Unless the session says otherwise, at most 8 MB of rows go to a Python worker at once, long texts or not."""
    for key, default, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1), str(8 << 20)),):
        if spark.conf.get(key, default) in (default, None):
            spark.conf.set(key, value)
    return spark


class Scratch:
    """Parquet tables of one run below the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = small_batches(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: lineage ends at files that every executor sees."""
        path, schema = self.path(name), df.schema
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def tidy(self) -> None:
        """Let Spark's cleaner take the shuffle files of ended steps."""
        self.spark._jvm.System.gc()


def rows_with_uid(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """docs with a column ``_uid`` (long) that names each row and is the same in every scan.

    A table whose ids are distinct and not null is used as it is. If ids repeat
    or are missing, a numbered copy is written first, for a number that depends
    on how a scan is split would change when executors come and go.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        clash = docs.groupBy(F.col(id_col).alias("k")).count().where("count > 1 or k is null")
        if not clash.take(1):
            return docs.withColumn("_uid", F.col(id_col).cast("long"))
    return scratch.table(docs.withColumn("_uid", F.monotonically_increasing_id()), "numbered")


def own_uid_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with a column ``_uid`` of its own under a free name, and what makes a result's columns those of docs again."""
    names = docs.columns
    taken = {c.lower() for c in names}
    if "_uid" not in taken:
        return docs, lambda out: out.drop("_uid")
    own, free = next(c for c in names if c.lower() == "_uid"), "_own_uid"
    while free in taken:
        free += "_"
    return docs.withColumnRenamed(own, free), lambda out: out.drop("_uid").withColumnRenamed(free, own).select(names)


def filter_by(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of df on ``_uid``: a broadcast for a counted, short list, else a shuffle."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "_uid", how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
