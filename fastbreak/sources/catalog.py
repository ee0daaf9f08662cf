"""Tables as parquet folders under a root.

A table is a folder of versions. A version holds a folder of rows for each write; `write` and `upsert`
make a new version, appends add a folder of their own rows to the current one and touch no other. A
folder counts once its `_SUCCESS` mark is there, so readers never see half a write. The schema of a
version is the row-less folder it begins with; a column added later is a newer row-less folder, and
older rows read as null there.

An upsert keeps rows in buckets by key. Its version holds the buckets that incoming rows touch, written
anew, and a list of all bucket folders the table now consists of, those of older versions included; the
untouched ones stay where they are. Old versions, but for folders the current one lists, stay until `vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Buckets of a table that is upserted for the first time.
BUCKETS = 64
LINKS = "part string, bucket int, buckets int, key array<string>"


class Catalog:
    """Append by shared columns, tolerant append, upsert by key, idempotent creation, incremental filters."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self, path: str) -> list[str]:
        """Names of the finished folders in a folder, in order."""
        p, fs = self._fs(path)
        if not fs.exists(p):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        return sorted(n for n in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))

    def _versions(self, name: str) -> list[str]:
        p, fs = self._fs(f"{self.root}/{name}")
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(v for v in found if self._done(f"{self.root}/{name}/{v}"))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def _current(self, name: str) -> tuple[str, list[str]]:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no table {name}")
        path = f"{self.root}/{name}/{versions[-1]}"
        return path, self._done(path)

    def schema(self, name: str) -> T.StructType:
        path, parts = self._current(name)
        return self.spark.read.parquet(f"{path}/{[p for p in parts if p.endswith('-schema')][-1]}").schema

    def table(self, name: str) -> DataFrame:
        path, parts = self._current(name)
        schema = self.schema(name)
        # partition columns live in the folders' names, so each write is read below its own base
        reads = [(p, [p]) for p in (f"{path}/{p}" for p in parts if p.endswith("-rows"))]
        return self._read(reads + self._buckets(name, self._links(path, parts)), schema)

    def _read(self, reads: list[tuple[str, list[str]]], schema: T.StructType) -> DataFrame:
        """Rows of folders, given as a base and folders below it."""
        out = None
        for base, folders in reads:
            df = self.spark.read.schema(schema).option("basePath", base).parquet(*folders).select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _links(self, path: str, parts: list[str]) -> list:
        """The bucket folders of a version: at most buckets times upserts since the last rewriting, or none."""
        own = [p for p in parts if p.endswith("-links")]
        return self.spark.read.schema(LINKS).parquet(f"{path}/{own[-1]}").collect() if own else []

    def _buckets(self, name: str, links: list) -> list[tuple[str, list[str]]]:
        by: dict[str, list[str]] = {}
        for x in links:
            base = f"{self.root}/{name}/{x['part']}"
            by.setdefault(base, []).append(f"{base}/_bucket={x['bucket']}")
        return sorted(by.items())

    def columns(self, name: str) -> dict[str, str]:
        return dict(self.table(name).dtypes) if self.exists(name) else {}

    def _add(self, version: str, n: int, df: DataFrame, kind: str, partition_by: Iterable[str] = ()) -> None:
        df.write.partitionBy(*partition_by).parquet(f"{version}/{n:08d}-{uuid.uuid4().hex[:8]}-{kind}")

    def write(self, name: str, df: DataFrame, partition_by: Iterable[str] = ()) -> None:
        """A complete new version; readers see the old one until its rows, which come before its schema, are whole."""
        made = self._begin(name, df.schema)
        self._add(made, 1, df, "rows", partition_by)
        self._finish(made)

    def _begin(self, name: str, schema: T.StructType) -> str:
        n = int(self._versions(name)[-1].split("-")[0]) + 1 if self.exists(name) else 0
        made = f"{self.root}/{name}/.{n:08d}-{uuid.uuid4().hex[:8]}"
        self._add(made, 0, self.spark.createDataFrame([], schema), "schema")
        return made

    def _finish(self, made: str) -> None:
        p, fs = self._fs(made)
        if not fs.rename(p, self._fs(made.replace("/.", "/"))[0]):
            raise OSError(f"cannot finish {made}")

    def vacuum(self, name: str) -> None:
        """Delete what the current version does not consist of."""
        links = self._links(*self._current(name)) if self.exists(name) else []
        used, folders = {x["part"] for x in links}, {f"{x['part']}/_bucket={x['bucket']}" for x in links}
        for v in self._versions(name)[:-1]:
            if not any(part.startswith(f"{v}/") for part in used):
                self._delete(f"{name}/{v}")
                continue
            for part in self._done(f"{self.root}/{name}/{v}"):
                if f"{v}/{part}" not in used:
                    self._delete(f"{name}/{v}/{part}")
                    continue
                p, fs = self._fs(f"{self.root}/{name}/{v}/{part}")
                for x in fs.listStatus(p):
                    own = x.getPath().getName()
                    if own.startswith("_bucket=") and f"{v}/{part}/{own}" not in folders:
                        self._delete(f"{name}/{v}/{part}/{own}")

    def _delete(self, below: str) -> None:
        p, fs = self._fs(f"{self.root}/{below}")
        fs.delete(p, True)

    def create(self, name: str, schema: T.StructType | str) -> None:
        if not self.exists(name):
            self.write(name, self.spark.createDataFrame([], schema))

    def init(self, schemas: dict[str, T.StructType | str]) -> None:
        for name, schema in schemas.items():
            self.create(name, schema)

    def append(self, name: str, df: DataFrame) -> None:
        """Only columns the table has; missing ones null; types must fit. A table is made by its first rows."""
        if not df.columns or df.isEmpty():
            return
        if not self.exists(name):
            return self.write(name, df)
        self._append(name, self._shaped(df, self.table(name), tolerant=False))

    def _append(self, name: str, df: DataFrame) -> None:
        path, parts = self._current(name)
        self._add(path, int(parts[-1].split("-")[0]) + 1, df, "rows")

    def append_tolerant(self, name: str, df: DataFrame) -> None:
        """As append, but values that do not convert are null, and columns that cannot be cast are dropped."""
        if not df.columns or df.isEmpty():
            return
        if not self.exists(name):
            return self.write(name, df)
        self._append(name, self._shaped(df, self.table(name), tolerant=True))

    def _shaped(self, df: DataFrame, like: DataFrame, tolerant: bool) -> DataFrame:
        cols = []
        for f in like.schema:
            if f.name not in df.columns:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            own = df.schema[f.name].dataType
            nested = isinstance(own, (T.StructType, T.ArrayType, T.MapType)) != isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
            if own == f.dataType:
                cols.append(F.col(f.name))
            elif tolerant and nested:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif tolerant:
                cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
            else:
                cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        return df.select(*cols)

    def upsert(self, name: str, df: DataFrame, key: list[str], buckets: int = BUCKETS) -> None:
        """New rows replace old rows of the same key; null keys never match.

        Only buckets that new rows fall in are read and written. The first upsert, and one by another key,
        rewrites the table into `buckets` buckets, a number that stays until then; rows appended since
        the last upsert are dealt into theirs.
        """
        if not df.columns or df.isEmpty():
            return
        if not self.exists(name):
            return self.write(name, df)
        path, parts = self._current(name)
        schema, links = self.schema(name), self._links(path, parts)
        new = self._shaped(df, self.table(name), tolerant=False)
        same = bool(links) and links[0]["key"] == key
        count = links[0]["buckets"] if same else buckets
        at = F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")
        if same:
            touched = {x[0] for x in new.select(at).distinct().collect()}  # at most `count` numbers
            loose = [(p, [p]) for p in (f"{path}/{p}" for p in parts if p.endswith("-rows"))]
            old = self._read(loose + self._buckets(name, [x for x in links if x["bucket"] in touched]), schema)
        else:
            touched, old = None, self.table(name)
        rows = old.join(new.select(*key).distinct(), key, "left_anti").select(*schema.names).unionByName(new)
        made = self._begin(name, schema)
        version = made.rsplit("/", 1)[1].removeprefix(".")
        self._add(made, 1, rows.withColumn("_bucket", at).repartition("_bucket"), "buckets", ["_bucket"])
        own = next(p for p in self._done(made) if p.endswith("-buckets"))
        p, fs = self._fs(f"{made}/{own}")
        filled = [int(n.split("=")[1]) for n in (x.getPath().getName() for x in fs.listStatus(p)) if n.startswith("_bucket=")]
        kept = [(x["part"], x["bucket"], count, key) for x in links if same and x["bucket"] not in touched]
        self._add(made, 2, self.spark.createDataFrame([*kept, *((f"{version}/{own}", b, count, key) for b in filled)], LINKS).coalesce(1), "links")
        self._finish(made)

    def add_column(self, name: str, column: str, kind: str) -> None:
        """Rows stay as they are; the column reads as null in those written before."""
        schema = self.schema(name)
        if column not in schema.names:
            added = self.spark.createDataFrame([], f"`{column}` {kind}").schema.fields
            path, parts = self._current(name)
            self._add(path, int(parts[-1].split("-")[0]) + 1, self.spark.createDataFrame([], T.StructType([*schema.fields, *added])), "schema")

    def execute(self, name: str, sql: str, args: dict | list | None = None) -> None:
        """CREATE TABLE AS: the rows of a query over the catalog's tables as a new version of `name`."""
        self.write(name, self.query(sql, args))

    def values(self, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
        """A literal table."""
        return self.spark.createDataFrame(rows, schema)

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        """SQL over the catalog's tables, with named or positional parameters."""
        p, fs = self._fs(self.root)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if self.exists(name):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args)

    def missing(self, incoming: DataFrame, name: str, key: str) -> DataFrame:
        """Rows whose key the table does not hold yet."""
        return incoming.join(self.table(name).select(key).distinct(), key, "left_anti") if self.exists(name) else incoming

    def log_failures(self, name: str, df: DataFrame) -> None:
        self.append(name, df.withColumn("failed_at", F.current_timestamp()))


def restrict(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    if include is not None:
        df = df.join(include.select(key).distinct(), key, "left_semi")
    return df.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else df
