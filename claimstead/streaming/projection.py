"""The event log as a stream: projection state by batch, and the status of a projection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.operators.identity import roots, settle, shared_folder
from claimstead.plans.fixtures import event_log
from claimstead.sources import sinks
from claimstead.sources.sinks import CLAIM_EVENTS, MERGE_EVENTS, RELEVANT

#: Buckets of a projection's table.
BUCKETS = 16

STATE = "claim_id long, occurred_at timestamp_ntz, event_id long, kind string"


def newest(events: DataFrame) -> DataFrame:
    """The last claim event of each claim; a maximum, so the order of events within or across batches doesn't matter. Events of other kinds don't count, even if they name a claim."""
    own = events.where(F.col("kind").isin(CLAIM_EVENTS) & F.col("claim_id").isNotNull())
    return own.groupBy("claim_id").agg(F.max(F.struct("occurred_at", "event_id", "kind")).alias("e")).select("claim_id", "e.*")


def rebuild(events: DataFrame) -> DataFrame:
    """claim_id, occurred_at, event_id of claims whose last event asserts them."""
    return newest(events).where("kind = 'claim.asserted'").drop("kind")


class Versions:
    """A table kept as versions of its buckets below a folder: v<n> replaces the buckets it holds, r<n> the whole table.

    A batch rewrites only the buckets that it touches, a batch that is run again writes the same version, so delivery counts once, and of
    each bucket the last few versions are kept. A version counts once it is complete.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, keep: int = 3, key: str = "claim_id") -> None:
        self.spark, self.folder, self.buckets, self.keep, self.key = spark, folder, buckets, keep, key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _places(self, before: int | None) -> dict[int, list[str]]:
        """The folders of each bucket, newest first, back to the last whole rewrite."""
        found: dict[int, list[str]] = {}
        done = [(int(n[1:]), n) for n in self._names(self.folder) if n[:1] in "vr" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        for number, name in sorted(done, reverse=True):
            if before is not None and number >= before:
                continue
            for part in self._names(f"{self.folder}/{name}"):
                if part.startswith("bucket="):
                    found.setdefault(int(part[7:]), []).append(f"{self.folder}/{name}/{part}")
            if name[0] == "r":
                break
        return found

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, of versions below `before` and some buckets only if they are given; None if it has no rows yet."""
        places = [p[0] for b, p in sorted(self._places(before).items()) if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", "false").parquet(*places) if places else None

    def write(self, rows: DataFrame, number: int, whole: bool = False) -> None:
        name = f"{self.folder}/{'r' if whole else 'v'}{number}"
        rows.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(name)
        for places in self._places(None).values():
            for old in places[self.keep :]:
                self._fs.delete(self._path(old), True)


def touched_buckets(rows: DataFrame, table: Versions) -> list[int]:
    return [r["b"] for r in rows.select(table.bucket().alias("b")).distinct().collect()]  # numbers of buckets


def merge_batch(folder: str):
    """For foreachBatch: merges the batch's newest events into the state's buckets that they fall in."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = Versions(batch.sparkSession, folder)
        fresh = settle(newest(batch))
        before = table.read(batch_id, touched_buckets(fresh, table))
        table.write(newest(fresh if before is None else before.select(fresh.columns).unionByName(fresh)), batch_id)

    return merge


def state(spark: SparkSession, folder: str) -> DataFrame:
    found = Versions(spark, folder).read()
    return spark.createDataFrame([], STATE) if found is None else found.select("claim_id", "occurred_at", "event_id", "kind")


def _stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that a table may be one file or a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)


def _run(log: DataFrame, merge, folder: str):
    query = log.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sync(spark: SparkSession, path: str, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Reads what is new of the events at path, merges it batch by batch below folder, and returns the live claims."""
    _run(event_log(_stream(spark, path, files_per_batch)), merge_batch(f"{folder}/state"), folder)
    return state(spark, f"{folder}/state").where("kind = 'claim.asserted'").drop("kind")


def merges_of(events: DataFrame) -> DataFrame:
    """Merge rows of merge events (absorbed_id, surviving_id): each pair's last event tells whether it is reverted."""
    own = events.where(F.col("kind").isin(MERGE_EVENTS)).groupBy("absorbed_id", "surviving_id")
    last = own.agg(F.max(F.struct("occurred_at", "event_id", "kind")).alias("e"))
    return last.select("absorbed_id", "surviving_id", (F.col("e.kind") == "entity.merge_reverted").alias("reverted"), F.struct("e.occurred_at", "e.event_id").alias("event_seq"))


def content(claims: DataFrame, events: DataFrame, embed) -> DataFrame:
    """The projection of claims under all events: canonical ends by the merges that hold, text and vector."""
    return sinks.projection(claims, events, roots(merges_of(events)), embed)


def content_batch(folder: str, claims, embed, buckets: int = BUCKETS):
    """For foreachBatch: keeps the projection's content in step with the events, from state and not from past events.

    State below folder: the claims that some claim event has named, the last event of each pair of merged entities, the roots that follow, and the content. A batch writes the
    buckets of the claims it names; with a merge or revert it works out the roots of the merges that there are and projects anew, besides, the claims at whose ends a root has
    changed, and no others. A batch that is run again reads the state below its number. claims: a function of the session, as rows are read when a batch runs.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table, named = Versions(spark, f"{folder}/content", buckets), Versions(spark, f"{folder}/named", buckets)
        pairs, held_roots = Versions(spark, f"{folder}/merges", buckets, key="absorbed_id"), Versions(spark, f"{folder}/roots", buckets, key="entity_id")
        own = settle(batch.where(F.col("kind").isin(RELEVANT)))
        touched = settle(own.where(F.col("kind").isin(CLAIM_EVENTS) & F.col("claim_id").isNotNull()).select("claim_id").distinct())
        before = named.read(batch_id, touched_buckets(touched, named))
        named.write(touched if before is None else before.select("claim_id").union(touched).distinct(), batch_id)
        known = claims(spark)
        none = spark.createDataFrame([], "entity_id string, canonical_id string")
        last = held_roots.read(batch_id)
        now = none if last is None else last.select("entity_id", "canonical_id")
        changes = own.where(F.col("kind").isin(MERGE_EVENTS)).select("absorbed_id", "surviving_id", "occurred_at", "event_id", "kind")
        if not changes.isEmpty():
            old = pairs.read(batch_id, touched_buckets(changes, pairs))
            both = changes if old is None else changes.unionByName(old.select(changes.columns))
            newest_ = both.groupBy("absorbed_id", "surviving_id").agg(F.max(F.struct("occurred_at", "event_id", "kind")).alias("e")).select("absorbed_id", "surviving_id", "e.*")
            pairs.write(newest_, batch_id)
            was, now = now, settle(roots(merges_of(pairs.read(batch_id + 1))))
            moved = was.select("entity_id", F.col("canonical_id").alias("_was")).join(now, "entity_id", "full").where(~F.coalesce("_was", "entity_id").eqNullSafe(F.coalesce("canonical_id", "entity_id"))).select("entity_id")
            held_roots.write(now, batch_id, whole=True)
            moved = settle(moved)
            ends = [known.join(moved, known[c] == moved["entity_id"], "left_semi").select("claim_id") for c in ("subject_id", "object_entity_id")]
            touched = settle(touched.union(ends[0]).union(ends[1]).distinct())
        every = named.read(batch_id + 1)
        spoken = (touched.where("false") if every is None else every.select("claim_id")).withColumn("kind", F.lit(CLAIM_EVENTS[0]))
        rows = sinks.projection(known.join(touched, "claim_id", "left_semi"), spoken, now, embed)
        held = table.read(batch_id, touched_buckets(touched, table))
        table.write(rows if held is None else sinks.upsert(held.select(rows.columns), touched, rows), batch_id)

    return merge


def sync_content(spark: SparkSession, path: str, folder: str, claims, embed, log, files_per_batch: int = 64) -> DataFrame | None:
    """Reads what is new of the events at path as log(rows), keeps the projection's content below folder, and returns it; None as long as it is empty."""
    _run(log(_stream(spark, path, files_per_batch)), content_batch(folder, claims, embed), folder)
    return Versions(spark, f"{folder}/content").read()


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/projection-{uuid.uuid4().hex}"


def pending(events: DataFrame, processed: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(RELEVANT)).join(processed.select("event_id"), "event_id", "left_anti")


def status(events: DataFrame, processed: DataFrame, now: Column, max_lag_ms: int = 30_000) -> DataFrame:
    """pending, latest_event, lag_ms of the newest unprocessed event, stale, ready: one row. progress() adds what a stream query tells of its last batch."""
    left = pending(events, processed).agg(F.count(F.lit(1)).alias("pending"), F.max("occurred_at").alias("newest"))
    seen = events.where(F.col("kind").isin(RELEVANT)).agg(F.max("occurred_at").alias("latest_event"))
    lag = F.coalesce(F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 1000)), F.lit(0).cast("long"))
    return left.join(seen).select("pending", "latest_event", lag.alias("lag_ms"), (F.col("pending") > 0).alias("stale"), ((F.col("pending") == 0) | (lag <= max_lag_ms)).alias("ready"))


def process_requests(requests: DataFrame, handlers: dict, checkpoint: str):
    """A stream of landed requests, each kind given to its handler batch by batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        for kind, handler in handlers.items():
            handler(batch.where(F.col("kind") == kind), batch_id)

    return requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def progress(query) -> dict:
    """The last batch of a stream: its number, instant and rows; empty before the first."""
    last = query.lastProgress
    return {} if last is None else {"batch_id": last["batchId"], "synced_at": last["timestamp"], "rows": last["numInputRows"]}
