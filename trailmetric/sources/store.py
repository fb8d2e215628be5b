"""A collection store on Parquet: keyed writes, reads, deletes and progress, by experiment partition.

A write makes a new snapshot folder and then moves the pointer, a one-line file, so readers
see whole collections and a failed write leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import find, insert_new, last_by, upsert


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _current(self, name: str) -> str | None:
        fs, path = self._fs()
        pointer = path(f"{self.root}/{name}/CURRENT")
        if not fs.exists(pointer):
            return None
        return self.spark.read.text(str(pointer)).first()[0]

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str, **equal) -> DataFrame:
        """The collection's records that equal the given values (``a__b`` for a.b)."""
        at = self._current(name)
        if at is None:
            raise KeyError(name)
        return find(self.spark.read.parquet(f"{self.root}/{name}/{at}"), **equal)

    def write(self, name: str, df: DataFrame) -> None:
        at = uuid.uuid4().hex
        writer = df.write
        (writer.partitionBy("experiment_id") if "experiment_id" in df.columns and len(df.columns) > 1 else writer).parquet(f"{self.root}/{name}/{at}")
        fs, path = self._fs()
        new, pointer = path(f"{self.root}/{name}/CURRENT.{at}"), path(f"{self.root}/{name}/CURRENT")
        out = fs.create(new)
        out.writeBytes(at)
        out.close()
        fs.delete(pointer, False)
        fs.rename(new, pointer)

    def append(self, name: str, df: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(df, allowMissingColumns=True) if self.exists(name) else df)

    def save(self, name: str, df: DataFrame, keys: list[str], keep: str = "new") -> None:
        """Upsert; repeats inside ``df`` are last wins by ``ord`` if it has one."""
        rows = last_by(df, keys, [F.col("ord")]) if "ord" in df.columns else df.dropDuplicates(keys)
        self.write(name, upsert(self.read(name), rows, keys, keep) if self.exists(name) else rows)

    def insert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        self.write(name, insert_new(self.read(name), df, keys) if self.exists(name) else df)

    def delete(self, name: str, **equal) -> int:
        """Removes the matches; says how many."""
        gone = self.read(name, **equal)
        n = gone.count()
        if n:
            self.write(name, self.read(name).exceptAll(gone))
        return n

    def update(self, name: str, values: dict, **equal) -> None:
        """Sets columns where the given values are equal."""
        match = F.lit(True)
        for column, value in equal.items():
            match = match & (F.col(column.replace("__", ".")) == F.lit(value))
        self.write(name, self.read(name).withColumns({c: F.when(F.coalesce(match, F.lit(False)), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def progress(self, experiment: str, names: list[str]) -> dict[str, int]:
        """Records of an experiment by collection, counted from the data."""
        return {n: self.read(n, experiment_id=experiment).count() if self.exists(n) else 0 for n in names}

    def distinct(self, names: list[str], column: str) -> DataFrame:
        from ..operators.relational import union_ids

        return union_ids([self.read(n) for n in names if self.exists(n)], column)
