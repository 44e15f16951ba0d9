"""Objects of a folder or bucket as a source: discovered, told by their hash, and read by the executors, in batch or as a stream that takes new and changed objects alone."""

from __future__ import annotations

import hashlib
import json
import mimetypes
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

OBJECTS = "object_id string, uri string, mime string, size long, content_hash string, content binary"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Objects(InputPartition):
    """Some objects that one task reads: their ids."""

    def __init__(self, ids: list[str]) -> None:
        self.ids = ids


class _Folder:
    """Listing and reading below a root. An object's id is its path below the root, its version its size and time of change."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.per_task = options["path"], int(options.get("objectsPerTask", "64"))

    def versions(self) -> dict[str, str]:
        from pyarrow import fs

        store, base = _store(self.root)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {f.path[len(base) :].lstrip("/"): f"{f.size}:{f.mtime_ns}" for f in found if f.type == fs.FileType.File}

    def dealt(self, ids: list[str]) -> list[Objects]:
        return [Objects(ids[i : i + self.per_task]) for i in range(0, len(ids), self.per_task)] or [Objects([])]

    def read(self, partition: Objects) -> Iterator[tuple]:
        store, base = _store(self.root)
        for id_ in partition.ids:
            try:
                with store.open_input_stream(f"{base}/{id_}") as f:
                    content = f.read()
            except FileNotFoundError:
                continue  # gone since it was listed
            yield id_, f"{self.root.rstrip('/')}/{id_}", mimetypes.guess_type(id_)[0] or "application/octet-stream", len(content), hashlib.sha256(content).hexdigest(), content


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Objects]:
        return self.dealt(sorted(self.versions()))


class FolderStream(_Folder, DataSourceStreamReader):
    """An offset is the number of a listing that is kept in the folder `state`: a batch is what the later listing has that the earlier hasn't, new or changed. Listings outlive the query, so a batch that is run again after a restart is the same."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.state = options["state"]

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        last = max(self._kept(), default=-1)
        now = self.versions()
        if now != self._listing(last):
            last += 1
            store, base = _store(self.state)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{last}.tmp") as f:
                f.write(json.dumps(now).encode())
            store.move(f"{base}/{last}.tmp", f"{base}/{last}.json")
        return {"listing": last}

    def _kept(self) -> list[int]:
        from pyarrow import fs

        store, base = _store(self.state)
        return [int(f.base_name[:-5]) for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".json")]

    def _listing(self, number: int) -> dict[str, str]:
        if number < 0:
            return {}
        store, base = _store(self.state)
        with store.open_input_stream(f"{base}/{number}.json") as f:
            return json.loads(f.read())

    def partitions(self, start: dict, end: dict) -> list[Objects]:
        before, now = self._listing(start["listing"]), self._listing(end["listing"])
        return self.dealt(sorted(i for i, v in now.items() if before.get(i) != v))

    def commit(self, end: dict) -> None:
        """Listings before the one that is done are no longer asked for, but for its own."""
        store, base = _store(self.state)
        for number in self._kept():
            if number < end["listing"]:
                store.delete_file(f"{base}/{number}.json")


class KnowledgeSource(DataSource):
    """format("knowledge") with path, state (for streams) and objectsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "knowledge"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)


def discover(spark: SparkSession, path: str, per_task: int = 64) -> DataFrame:
    """All objects below path."""
    spark.dataSource.register(KnowledgeSource)
    return spark.read.format("knowledge").option("path", path).option("objectsPerTask", per_task).load()


def ingest(spark: SparkSession, path: str, folder: str, per_task: int = 64):
    """Takes what is new or changed below path since the last run into folder/objects, a folder a batch, and returns the ended query.

    An object whose content was taken before under its id is left out, also if it was touched. A batch that is run again replaces itself. The listing is held by the
    driver; contents are read by tasks.
    """
    spark.dataSource.register(KnowledgeSource)
    stream = spark.readStream.format("knowledge").option("path", path).option("state", f"{folder}/listings").option("objectsPerTask", per_task).load()

    def take(batch: DataFrame, batch_id: int) -> None:
        taken = taken_objects(batch.sparkSession, folder, batch_id)
        fresh = batch if taken is None else batch.join(taken.select("object_id", "content_hash"), ["object_id", "content_hash"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/objects/batch={batch_id}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def taken_objects(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """Objects taken by the batches so far, or by those below a number; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/objects")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/objects/{s.getPath().getName()}/_SUCCESS"))]
    chosen = [f"{folder}/objects/{n}" for n in sorted(done) if before is None or int(n.split("=")[1]) < before]
    return spark.read.schema(OBJECTS).parquet(*chosen) if chosen else None


def latest_objects(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last content of every object taken."""
    every = taken_objects(spark, folder)
    if every is None:
        return None
    number = F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long")
    last = every.withColumn("_n", number).groupBy("object_id").agg(F.max_by(F.struct(*every.columns), "_n").alias("o"))
    return last.select("o.*")
