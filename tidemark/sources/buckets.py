"""A table laid out by the hash of its key, of which a change rewrites the touched buckets only.

path/data/<version>/bucket=<n>/ holds the rows of a bucket as of a version, and
path/versions/<version>/ which version each bucket has now. A change writes new files beside
the old ones and then its list of buckets, which takes effect as a whole: readers see the
table before or after it, and a change that fails halfway leaves nothing behind that is
read. A change may carry a stamp (the number of a micro-batch); one whose stamp is not above
that of the table has been made before, and is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LISTED = "bucket int, version long, buckets int, stamp long"


class BucketedTable:
    """Rows with a key of one or more columns, in a fixed number of buckets. The number is that
    of the first change; a bucket should hold what a task can rewrite."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 256):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    # --- versions ---

    def _folders(self, path: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def current(self) -> tuple[int, dict[int, int], int]:
        """The last version (0: none), the version of each bucket, and the stamp."""
        done = [int(n) for n in self._folders(f"{self.path}/versions") if n.isdigit() and "_SUCCESS" in self._folders(f"{self.path}/versions/{n}")]
        if not done:
            return 0, {}, -1
        rows = self.spark.read.schema(_LISTED).parquet(f"{self.path}/versions/{max(done)}").collect()  # a row a bucket
        if rows[0].buckets != self.buckets:
            raise ValueError(f"the table has {rows[0].buckets} buckets, not {self.buckets}")
        return max(done), {r.bucket: r.version for r in rows if r.bucket >= 0}, rows[0].stamp

    def _commit(self, version: int, held: dict[int, int], stamp: int) -> None:
        rows = [(b, v, self.buckets, stamp) for b, v in held.items()] or [(-1, 0, self.buckets, stamp)]
        self.spark.createDataFrame(rows, _LISTED).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{version}")

    def vacuum(self) -> None:
        """Remove what only earlier versions of the table have."""
        version, held, _ = self.current()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind, name in [("versions", n) for n in self._folders(f"{self.path}/versions")] + [("data", n) for n in self._folders(f"{self.path}/data")]:
            for folder in [name] if kind == "versions" else [f"{name}/{b}" for b in self._folders(f"{self.path}/data/{name}") if b.startswith("bucket=")]:
                live = folder == str(version) if kind == "versions" else held.get(int(folder.split("bucket=")[1])) == int(name)
                if not live:
                    target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{folder}")
                    target.getFileSystem(conf).delete(target, True)

    # --- rows ---

    def bucket(self) -> Column:
        """The bucket of a row: nulls of a key are a value."""
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(held.items())))

    def read(self) -> DataFrame:
        return self._read(self.current()[1])

    def read_keys(self, rows: DataFrame) -> DataFrame:
        """The buckets that the keys of rows lie in; other keys of these buckets are there too."""
        wanted = {r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()}  # numbers of buckets
        return self._read({b: v for b, v in self.current()[1].items() if b in wanted})

    def _same(self, other: DataFrame, prefix: str) -> tuple[DataFrame, Column]:
        names = {k: f"{prefix} {k}" for k in self.keys}
        renamed = other.select(*self.keys).distinct().withColumnsRenamed(names)
        return renamed, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()))

    def _change(self, touching: DataFrame, change: Callable[[DataFrame], DataFrame], stamp: int | None) -> list[int]:
        """Rewrite the buckets of the rows of touching; the numbers of these buckets."""
        version, held, last = self.current()
        if stamp is not None and stamp <= last:
            return []
        touched = sorted(r.bucket for r in touching.select(self.bucket().alias("bucket")).distinct().collect())  # numbers of buckets
        if touched:
            old = self._read({b: v for b, v in held.items() if b in set(touched)})
            columns = [f.name for f in old.schema.fields]
            rows = change(old).select(*columns).withColumn("bucket", self.bucket())
            folder = f"{self.path}/data/{version + 1}"
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            written = {int(n.split("=")[1]) for n in self._folders(folder) if n.startswith("bucket=")}
            held = {b: v for b, v in held.items() if b not in set(touched)} | dict.fromkeys(written, version + 1)
        self._commit(version + 1, held, last if stamp is None else stamp)
        return touched

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, stamp: int | None = None) -> list[int]:
        """All rows of the keys of gone (default: of rows) are replaced by rows, whose keys have
        to be among these. Done twice it leaves what it leaves done once."""
        keys = (rows if gone is None else gone).select(*self.keys)

        def change(old: DataFrame) -> DataFrame:
            names, same = self._same(keys, "gone")
            return old.join(names, same, "left_anti").unionByName(rows.select(*old.columns))

        return self._change(keys, change, stamp)

    def insert_if_absent(self, rows: DataFrame, order: list[str], stamp: int | None = None) -> list[int]:
        """Add the rows whose key is new; of several, the first by order."""
        first = Window.partitionBy(*self.keys).orderBy(*order)
        new = rows.withColumn("nth new", F.row_number().over(first)).filter("`nth new` = 1").drop("nth new")

        def change(old: DataFrame) -> DataFrame:
            names, same = self._same(old, "old")
            return old.unionByName(new.select(*old.columns).join(names, same, "left_anti"))

        return self._change(rows, change, stamp)

    def upsert(self, rows: DataFrame, newest: list[str], stamp: int | None = None) -> list[int]:
        """The newest row of each key by the columns newest, of the table and of rows."""
        by = Window.partitionBy(*self.keys).orderBy(*(F.desc(c) for c in newest))

        def change(old: DataFrame) -> DataFrame:
            both = old.unionByName(rows.select(*old.columns))
            return both.withColumn("nth newest", F.row_number().over(by)).filter("`nth newest` = 1").drop("nth newest")

        return self._change(rows, change, stamp)
