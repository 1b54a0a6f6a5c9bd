"""A set of tables that changes as a whole: versions of buckets, published together.

A table's rows lie in buckets by the hash of their key. A version writes the buckets
that it touches and lists, for every table and bucket, the version that holds it; it
is there once its list is. So a change costs the touched buckets, readers see all
tables before it or all after it, and writing a version again writes the same.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


@dataclass
class Versions:
    spark: SparkSession
    root: str
    #: Some 100 MB of a table to a bucket serve well.
    buckets: int = 64

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def newest(self) -> int | None:
        fs, p = self._fs(f"{self.root}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=None)

    def manifest(self, version: int) -> dict:
        """schema and, for each bucket with rows, the version that holds it, by table."""
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()[0])

    def table(self, name: str, version: int, only: list[int] | None = None) -> DataFrame:
        """A table as of a version; with ``only``, those buckets of it."""
        held = self.manifest(version)[name]
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.root}/data/{name}/{v}/{BUCKET}={b}" for b, v in held["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, version: int, frames: dict[str, tuple[DataFrame, Column]], touched: dict[str, list[int]] | None = None, base: int | None = None) -> dict[str, int]:
        """Writes and publishes a version: of each table its rows and their key. With
        ``touched`` the rows are those of these buckets, and all else is as in
        ``base``. Returns the bytes written for each table."""
        before = self.manifest(base) if base is not None else {}
        lists, sizes = dict(before), {}
        for name, (df, key) in frames.items():
            path = f"{self.root}/data/{name}/{version}"
            rows = df.withColumn(BUCKET, self.bucket(key))
            rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
            fs, p = self._fs(path)
            found = {f.getPath().getName().split("=")[1]: version for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{BUCKET}=")}
            gone = set(map(str, touched[name])) if touched is not None else None
            kept = {b: v for b, v in before.get(name, {"buckets": {}})["buckets"].items() if gone is not None and b not in gone}
            lists[name] = {"schema": df.schema.jsonValue(), "buckets": kept | found}
            sizes[name] = fs.getContentSummary(p).getLength()
        # The list takes its name when it is complete.
        fs, draft = self._fs(f"{self.root}/drafts/{version}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(lists).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/versions/{version}")
        fs.mkdirs(final.getParent())
        fs.delete(final, False)
        if not fs.rename(draft, final):
            raise OSError(f"version {version} was not published")
        return sizes
