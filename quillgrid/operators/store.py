"""Tables as snapshots of Parquet files, with keyed upserts."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that the cluster shares (spark.checkpoint.dir; if that is unset, a temporary one in local mode and an error on a cluster).

    For a result that several branches of a plan read and that is dear to compute."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillgrid-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of source in place of target's with the same key, and source's others added."""
    return target.join(source.select(*key).distinct(), key, "left_anti").unionByName(source, allowMissingColumns=True)


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows with one key, the last; ``first_seen`` has the place of the first."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("first_seen"))
    return got.select(*key, "r.*", "first_seen")


def cascade(child: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Children without those whose parent is gone."""
    return child.join(gone.select(column).distinct(), column, "left_anti")


def missing(items: DataFrame, done: DataFrame, key: str = "item_key") -> DataFrame:
    """Items that have no row in done yet."""
    return items.join(done.select(key), key, "left_anti")


def of_keys(table: DataFrame, keys: DataFrame, key: str = "item_key") -> DataFrame:
    """The rows of table whose key is in keys."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def first_per_name(files: DataFrame, path: str = "path", prefer: str = "disclosure checklists") -> DataFrame:
    """Of files with one name but for case, the one below the preferred folder, then the first by path."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    w = Window.partitionBy("_n").orderBy((~F.contains(F.lower(path), F.lit(prefer))).cast("int"), F.col(path))
    return files.withColumn("_n", name).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r").orderBy(path)


class Snapshots:
    """Named tables below a folder, dealt out into buckets of one column.

    A write makes files for the buckets that it touches and then a manifest, a small file that names the folder of each bucket;
    the manifest with the greatest number is the table. So an upsert reads and rewrites the buckets of its own rows alone, and a reader
    sees one snapshot or the next. A manifest is created, never overwritten: of two writers at once the later one fails.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, name: str) -> dict | None:
        """version, by (the column that rows are dealt by; none: one bucket) and buckets (number: folder)."""
        p, fs = self._files(f"{self.root}/{name}/_manifest")
        if not fs.exists(p):
            return None
        last = max((str(f.getPath().getName()) for f in fs.listStatus(p) if str(f.getPath().getName()).endswith(".json")), default=None)
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{p}/{last}").collect())) if last else None

    def version(self, name: str) -> int:
        now = self.manifest(name)
        return now["version"] if now else 0

    def _read(self, now: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(now["buckets"][b] for b in buckets))

    def read(self, name: str) -> DataFrame | None:
        now = self.manifest(name)
        return self._read(now, sorted(now["buckets"])) if now else None

    def _bucket(self, by: str | None) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.BUCKETS)).cast("int") if by else F.lit(0)

    def _put(self, name: str, df: DataFrame, by: str | None, old: dict | None, gone: list[str]) -> DataFrame:
        version = (old["version"] if old else 0) + 1
        folder = f"{self.root}/{name}/v{version}-{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket(by)).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(folder)
        p, fs = self._files(folder)
        made = {str(f.getPath().getName()).split("=")[1]: f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(p) if str(f.getPath().getName()).startswith("_bucket=")}
        kept = {b: f for b, f in (old["buckets"] if old else {}).items() if b not in gone}
        now = {"version": version, "by": by, "schema": df.schema.jsonValue(), "buckets": kept | made}
        p, fs = self._files(f"{self.root}/{name}/_manifest/{version:08d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        return self._read(now, sorted(now["buckets"]))

    def write(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """df as the whole table."""
        old = self.manifest(name)
        return self._put(name, df, by, old, sorted(old["buckets"]) if old else [])

    def _touched(self, now: dict, rows: DataFrame) -> list[str]:
        """Buckets of the table that rows fall in: at most BUCKETS numbers."""
        found = {str(r["b"]) for r in rows.select(self._bucket(now["by"]).alias("b")).distinct().collect()}
        return sorted(found & set(now["buckets"]))

    def upsert(self, name: str, source: DataFrame, key: list[str], by: str | None = None) -> DataFrame:
        """U1. ``by``: one of the key's columns (the first if not given). Only buckets of source's rows are read and rewritten; of rows of source with one key one stays."""
        source = source.dropDuplicates(key)
        old, by = self.manifest(name), by or key[0]
        if old is None:
            return self.write(name, source, by)
        by = old["by"]
        mine = self._touched(old, source)
        return self._put(name, upsert(self._read(old, mine), source, key), by, old, mine)

    def replace(self, name: str, source: DataFrame, by: str, owners: DataFrame | None = None) -> DataFrame:
        """source in place of all rows whose ``by`` is in source, or in owners (rows that may have nothing any more)."""
        old = self.manifest(name)
        if old is None:
            return self.write(name, source, by)
        owners = (source if owners is None else owners).select(by).distinct()
        mine = self._touched(old, owners)
        return self._put(name, self._read(old, mine).join(owners, by, "left_anti").unionByName(source, allowMissingColumns=True), by, old, mine)

    def delete(self, name: str, gone: DataFrame, column: str) -> None:
        """Without the rows whose ``column`` is in gone; if the table is dealt by it, in their buckets alone."""
        old = self.manifest(name)
        if old is not None:
            mine = self._touched(old, gone) if old["by"] == column else sorted(old["buckets"])
            self._put(name, cascade(self._read(old, mine), gone, column), old["by"], old, mine)
