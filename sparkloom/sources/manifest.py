"""Stored tables and models under an address that follows from all they were made of.

An address is a digest of a name, of what went in (windows, digests of fitted
tables, settings) and of the code's VERSION.  Data are written under a name of
their own first, and a manifest that names them last: without a manifest there
is nothing, so a run that was killed is made again, and who reads an older
manifest isn't disturbed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: To be raised when features or models of the same input come out otherwise than before.
VERSION = 3


def _hashable(c: str, kind: T.DataType) -> Column:
    """A column as what a hash takes: maps as entries in the order of their keys."""
    return F.sort_array(F.map_entries(f"`{c}`")) if isinstance(kind, T.MapType) else F.col(f"`{c}`")


def digest(df: DataFrame) -> str:
    """Of the rows of a table, in whatever order and partitions; columns count by name."""
    columns = [_hashable(f.name, f.dataType) for f in sorted(df.schema, key=lambda f: f.name)]
    each = df.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    n, a, b = each.agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(20,0)"))).first()
    return hashlib.sha256(json.dumps([n, a, str(b), sorted(df.columns)]).encode()).hexdigest()[:20]


def window_of(df: DataFrame, column: str = "datetime") -> list:
    """First and last partition value of a table, its rows, and its columns: a scan of the partition column alone."""
    ends = [F.min(column), F.max(column)] if column in df.columns else [F.lit(None), F.lit(None)]
    return [*df.agg(*ends, F.count("*")).first(), sorted(df.columns)]


@dataclass(frozen=True)
class Store:
    """A folder of tables and models with manifests, in any store that Spark reads."""

    spark: SparkSession
    folder: str

    def address(self, name: str, made_of: dict) -> str:
        text = json.dumps({"name": name, "made_of": made_of, "version": VERSION}, sort_keys=True, default=str)
        return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:20]}"

    def manifest(self, address: str) -> dict | None:
        """What the manifest says, None if there is none (or one that was never finished)."""
        try:
            row = self.spark.read.text(f"{self.folder}/{address}/manifest", wholetext=True).first()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return json.loads(row[0]) if row and row[0] else None

    def commit(self, address: str, **says) -> None:
        self.spark.createDataFrame([(json.dumps(says, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{address}/manifest")

    def table(self, name: str, made_of: dict, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
        """The table of that address; built, written and committed if it isn't there or is to be rebuilt."""
        return self.filled(name, made_of, lambda path: build().write.parquet(path), rebuild)

    def filled(self, name: str, made_of: dict, fill: Callable[[str], None], rebuild: bool = False, data: str | None = None, rows: str | None = None) -> DataFrame:
        """As table(), where `fill` writes to the path it gets (the rows to a folder `rows` in it, if named); a fixed `data` name lets it go on where it was stopped."""
        address = self.address(name, made_of)
        found = None if rebuild else self.manifest(address)
        if found is None:
            data = data or f"data-{uuid.uuid4().hex}"
            fill(f"{self.folder}/{address}/{data}")
            found = {"data": f"{data}/{rows}" if rows else data}
            self.commit(address, **found, made_of=made_of)
        return self.spark.read.parquet(f"{self.folder}/{address}/{found['data']}")

    def bucketed(self, name: str, made_of: dict, build: Callable[[], DataFrame], key: str = "row_id", buckets: int = 64, rebuild: bool = False) -> DataFrame:
        """As table(), dealt into buckets by a hash of `key` and sorted by it: bucketed tables of one number of buckets join by the key without a shuffle.

        A session that doesn't know the table yet is told of it by its manifest;
        the data stay where they are.
        """
        address = self.address(name, made_of | {"buckets": buckets, "key": key})
        found = None if rebuild else self.manifest(address)
        if found is None:
            data = f"data-{uuid.uuid4().hex}"
            df = build()
            self._known(address, data, df.schema, key, buckets)
            df.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(self._name(address, data))
            self.commit(address, data=data, made_of=made_of, schema=df.schema.json(), key=key, buckets=buckets)
            found = {"data": data, "schema": df.schema.json()}
        self._known(address, found["data"], T.StructType.fromJson(json.loads(found["schema"])), key, buckets)
        return self.spark.table(self._name(address, found["data"]))

    def _name(self, address: str, data: str) -> str:
        return f"bucketed_{hashlib.sha256(f'{self.folder}/{address}/{data}'.encode()).hexdigest()[:24]}"

    def _known(self, address: str, data: str, schema: T.StructType, key: str, buckets: int) -> None:
        """The session's name for a bucketed table, made if it has none."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(address, data)} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.folder}/{address}/{data}'")

    def model(self, name: str, made_of: dict, fit: Callable[[], object], load: Callable[[str], object], rebuild: bool = False):
        """Models with a save() of that address, or what load() reads."""
        address = self.address(name, made_of)
        found = None if rebuild else self.manifest(address)
        if found is not None:
            return load(f"{self.folder}/{address}/{found['data']}")
        models, data = fit(), f"data-{uuid.uuid4().hex}"
        models.save(f"{self.folder}/{address}/{data}")
        self.commit(address, data=data, made_of=made_of)
        return models

    def record(self, name: str, **says) -> None:
        """What the last run of a name made: addresses that later runs look up."""
        self.commit(f"run-{name}", **says)

    def recorded(self, name: str) -> dict:
        found = self.manifest(f"run-{name}")
        if found is None:
            raise ValueError(f"no run {name} in {self.folder}")
        return found

    def read(self, address: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{address}/{self.manifest(address)['data']}")


def all_of(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """Tables of one schema as one, with their names in a column."""
    return reduce(DataFrame.unionByName, (t.withColumn(column, F.lit(n)) for n, t in tables.items()))
