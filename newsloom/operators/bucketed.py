"""A table in hash buckets with a log of commits: upserts and deletes rewrite only the buckets that they touch.

A commit is one file of the log, named by its version. It says where the files of every bucket lie, so a snapshot is one
version, and files are never changed. Data are written first, to a folder of their own, and seen once the commit's
file has its name. A name is given once only: of two writers the later finds the name taken, looks at what has happened
since, and either takes over the buckets that it doesn't touch or does its work again on the new snapshot. A writer that fails
before its commit leaves files that nothing names, which vacuum() removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.operators.tables import conform, last_of, upsert


class Taken(Exception):
    """The version that a commit wanted exists."""


class Table:
    """The table at a path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """Versions in order; none before create()."""
        fs, log = self._fs(), self._path("log")
        if not fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(log) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))

    def snapshot(self, version: int | None = None) -> dict:
        """A commit: the latest, or that of a version."""
        if version is None:
            known = self.versions()
            if not known:
                raise LookupError(f"no table at {self.path}")
            version = known[-1]
        stream = self._fs().open(self._path(f"log/{version:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        """Give a new snapshot the version that it states; Taken if another has it."""
        own = self._path(f"log/.{uuid.uuid4().hex}")
        out = self._fs().create(own, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else self._fs().getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs().makeQualified(own), self._fs().makeQualified(self._path(f"log/{state['version']:020d}.json")), options)
        except Exception as e:
            self._fs().delete(own, False)
            if "FileAlreadyExistsException" in str(e):
                raise Taken(state["version"]) from e
            raise

    def create(self, schema: StructType, keys: list[str], buckets: int = 64) -> Table:
        """An empty table, unless there is one."""
        if not self.versions():
            try:
                self.commit({"version": 0, "schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "at": {}, "touched": [], "done": {}})
            except Taken:
                pass
        return self

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A snapshot's rows; only: those of some buckets."""
        state = self.snapshot(version)
        schema = StructType.fromJson(state["schema"])
        places = [f"{folder}/_bucket={b}" for b, folder in state["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def bucket(self, state: dict) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def _changed(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType | None, batch: tuple[str, int] | None) -> int:
        """Rewrite the buckets of the changes' keys; the new version. Work on buckets that another writer has changed meanwhile is done again."""
        while True:
            state = self.snapshot()
            if batch and state["done"].get(batch[0], -1) >= batch[1]:
                return state["version"]
            placed = changes.withColumn("_bucket", self.bucket(state))
            touched = sorted(r["_bucket"] for r in placed.select("_bucket").distinct().collect())  # at most as many as there are buckets
            if not touched and schema is None and not batch:
                return state["version"]
            kind = schema or StructType.fromJson(state["schema"])
            made = merge(conform(self.read(state["version"], touched), kind), changes).withColumn("_bucket", self.bucket(state))
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            made.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(folder)
            written = {int(s.getPath().getName().split("=")[1]) for s in self._fs().listStatus(self._path(f"data/{folder.rsplit('/', 1)[1]}")) if "=" in s.getPath().getName()}
            base = state["version"]
            while True:
                at = {b: f for b, f in state["at"].items() if int(b) not in touched} | {str(b): folder for b in touched if b in written}
                done = state["done"] | ({batch[0]: batch[1]} if batch else {})
                try:
                    self.commit(state | {"version": state["version"] + 1, "schema": kind.jsonValue(), "at": at, "touched": touched, "done": done})
                    return state["version"] + 1
                except Taken:
                    newest = self.snapshot()
                    between = [self.snapshot(v) for v in range(base + 1, newest["version"] + 1)]
                    if any(set(s["touched"]) & set(touched) or s["schema"] != state["schema"] or (batch and s["done"].get(batch[0], -1) >= batch[1]) for s in between):
                        break  # our work rests on rows that have changed
                    state = newest

    def upsert(self, source: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """Put source's rows in place of those of equal keys (of several the last by order); columns that the table lacks are added to it, those that source lacks are null.

        batch: (name of a stream, number of its batch); a number that isn't above the last one committed changes nothing.
        Rows with a null in their key are refused.
        """
        state = self.snapshot()
        schema = StructType.fromJson(state["schema"])
        more = [f for f in source.schema if f.name not in schema.names]
        kind = StructType([*schema, *more]) if more else None
        valid = F.lit(True)
        for k in state["keys"]:
            valid &= F.col(k).isNotNull()
        checked = source.withColumn(state["keys"][0], F.when(valid, F.col(state["keys"][0])).otherwise(F.raise_error(F.lit("a row's key has a null")).cast(schema[state["keys"][0]].dataType)))
        newest = last_of(checked, state["keys"], order)
        return self._changed(newest, lambda old, new: upsert(old, conform(new, kind or schema), state["keys"]), kind, batch)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of these keys."""
        own = self.snapshot()["keys"]
        return self._changed(keys.select(own).distinct(), lambda old, new: old.join(new, own, "left_anti").select(old.columns), None, None)

    def vacuum(self, keep: int = 1) -> int:
        """Remove the log before the last ``keep`` versions and folders that none of these names; the number of folders removed. No writer may be at work."""
        known = self.versions()
        stay = {f.rsplit("/", 1)[1] for v in known[-keep:] for f in self.snapshot(v)["at"].values()}
        fs, data, removed = self._fs(), self._path("data"), 0
        for v in known[:-keep]:
            fs.delete(self._path(f"log/{v:020d}.json"), False)
        for s in fs.listStatus(data) if fs.exists(data) else ():
            if s.getPath().getName() not in stay:
                removed += fs.delete(s.getPath(), True)
        return removed


def ingest(stream: DataFrame, table: Table, name: str, checkpoint: str, order: str) -> None:
    """Upsert all that a stream has, micro-batch by micro-batch, and end; a batch that is repeated after a restart changes nothing."""
    stream.writeStream.foreachBatch(lambda df, number: table.upsert(df, F.col(order), (name, number)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
