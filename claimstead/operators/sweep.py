"""Plane sweep over validity: claims of a group in the order of their starts, with the ones that hold at the moment as running state, in ranges of bounded size."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from claimstead.operators.identity import settle

#: Claims of a range in expectation.
RANGE = 20_000


def _ranges(live: DataFrame, group: list[str], per_range: int) -> tuple[DataFrame, DataFrame]:
    """live with `part`, its range of (group, start, id), and the ranges (group, part, lo) of groups that have several: two rows a range at most.

    Ranges cut through groups, so a group of any size is spread evenly.
    """
    held = settle(live.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group)))
    n = max(1, -(-held.count() // per_range))
    dealt = settle(held.repartitionByRange(n, *group, "valid_from", "claim_id").withColumn("part", F.spark_partition_id()))
    lows = dealt.groupBy(*group, "part").agg(F.min("valid_from").alias("lo"))
    lows = lows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("_n > 1").drop("_n")
    return dealt, settle(lows)


def _carried(dealt: DataFrame, lows: DataFrame, group: list[str]) -> DataFrame:
    """Claims that still hold where a later range of their group begins, once for each such range."""
    later = lows.withColumnsRenamed({**{c: f"_{c}" for c in group}, "part": "_part"})
    on = [F.col(c) == F.col(f"_{c}") for c in group] + [F.col("_part") > F.col("part"), F.col("lo") < F.col("valid_end")]
    return dealt.join(F.broadcast(later), on).withColumn("part", F.col("_part")).drop("lo", "_part", *[f"_{c}" for c in group])


def _swept(dealt: DataFrame, carried: DataFrame, group: list[str], step: Callable[[Iterator[dict]], Iterator[tuple]], shape: str) -> DataFrame:
    """step over the rows of each range and group in turn: those carried in first, then the range's own by start and id."""
    rows = dealt.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    order = ["part", *group, "own", "valid_from", "claim_id"]
    schema = to_arrow_schema(dealt.sparkSession.createDataFrame([], shape).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        every = (row for b in batches for row in b.to_pylist())
        for key, members in groupby(every, key=lambda r: (r["part"], *(r[c] for c in group))):
            for found in step(members):
                made.append((*key[1:], *found))
                if len(made) == 4096:
                    yield _batch(made, schema)
                    made = []
        if made:
            yield _batch(made, schema)

    parts = (dealt.agg(F.max("part").alias("p")).first()["p"] or 0) + 1
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).mapInArrow(run, shape)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _types(live: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {live.schema[c].dataType.simpleString()}" for c in columns)


def overlap_pairs(live: DataFrame, group: list[str], per_range: int = RANGE) -> DataFrame:
    """group, left_id, right_id: pairs of claims of a group with different objects whose validity overlaps; the lesser id comes first.

    live: group, claim_id, object, valid_from, valid_end. A claim meets those that hold when it starts, kept by object, so only pairs of the result are formed. A range
    that begins within a group is given what still holds there.
    """
    columns = [*group, "claim_id", "object", "valid_from", "valid_end"]
    dealt, lows = _ranges(live.select(columns), group, per_range)

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        ends: list[tuple] = []  # (end, number), so that what has ended is found first
        active: dict[object, dict[int, tuple]] = {}
        for number, r in enumerate(rows):
            if r["own"]:
                while ends and ends[0][0] <= r["valid_from"]:
                    _, gone, object_ = heapq.heappop(ends)
                    del active[object_][gone]
                    if not active[object_]:
                        del active[object_]
                for object_, others in active.items():
                    if object_ != r["object"]:
                        for other, since in others.values():
                            if since < r["valid_end"]:
                                yield (other, r["claim_id"]) if other < r["claim_id"] else (r["claim_id"], other)
            heapq.heappush(ends, (r["valid_end"], number, r["object"]))
            active.setdefault(r["object"], {})[number] = (r["claim_id"], r["valid_from"])

    id_ = live.schema["claim_id"].dataType.simpleString()
    return _swept(dealt, _carried(dealt, lows, group), group, step, f"{_types(live, group)}, left_id {id_}, right_id {id_}")


def held_sets(live: DataFrame, group: list[str], most: str, per_range: int = RANGE) -> DataFrame:
    """group, claim_ids: at the starts of a group's claims, the claims that hold, the least id of each object, where they are more than `most`; a set within the next one is left out, others may lie within a set further on.

    live: group, `most`, claim_id, object, valid_from, valid_end. Into a later range only those claims are carried that no claim of the same object, range and a lesser id outlasts.
    """
    columns = [*group, most, "claim_id", "object", "valid_from", "valid_end"]
    dealt, lows = _ranges(live.select(columns), group, per_range)
    before = Window.partitionBy(*group, "part", "object").orderBy("claim_id").rowsBetween(Window.unboundedPreceding, -1)
    lasting = dealt.join(F.broadcast(lows.select(*group).distinct()), group, "left_semi").withColumn("_until", F.max("valid_end").over(before)).where("_until IS NULL OR valid_end > _until").drop("_until")

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        ends: list[tuple] = []
        active: dict[object, list] = {}  # ids that hold, as a heap whose ended ones are dropped when they come first
        until: dict[object, object] = {}
        last: dict[object, object] = {}
        changed: set = set()
        bound = None

        def least(object_: object, now: object) -> object:
            ids = active.get(object_, [])
            while ids and until[ids[0]] <= now:
                heapq.heappop(ids)
            return ids[0] if ids else None

        for now, started in groupby(rows, key=lambda r: r["valid_from"] if r["own"] else None):
            for r in started:
                bound = r[most]
                until[r["claim_id"]] = r["valid_end"]
                heapq.heappush(active.setdefault(r["object"], []), r["claim_id"])
                heapq.heappush(ends, (r["valid_end"], r["claim_id"], r["object"]))
                changed.add(r["object"])
            if now is None:
                continue
            while ends and ends[0][0] <= now:
                changed.add(heapq.heappop(ends)[2])
            new = {o: least(o, now) for o in changed}
            changed = set()
            if len(last) > bound and any(o in last and last[o] != c for o, c in new.items()):
                yield (sorted(last.values()),)
            for o, c in new.items():
                if c is None:
                    last.pop(o, None)
                else:
                    last[o] = c
        if bound is not None and len(last) > bound:
            yield (sorted(last.values()),)

    id_ = live.schema["claim_id"].dataType.simpleString()
    found = _swept(dealt, _carried(lasting, lows, group), group, step, f"{_types(live, group)}, claim_ids array<{id_}>")
    return found.distinct()


def widest(sets: DataFrame, group: list[str]) -> DataFrame:
    """Sets (group, claim_ids) that lie in no larger one of their group: a set is held against those that have the member which the fewest sets have."""
    sets = settle(sets)
    members = sets.withColumn("_member", F.explode("claim_ids"))
    often = members.groupBy(*group, "_member").agg(F.count(F.lit(1)).alias("_n"))
    rarest = settle(members.join(often, [*group, "_member"]).groupBy(*group, "claim_ids").agg(F.min(F.struct("_n", "_member")).alias("_m")).where("_m._n > 1"))
    larger = members.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("claim_ids").alias("_wider"), "_member")
    inside = [F.col(c) == F.col(f"_{c}") for c in group] + [F.col("_m._member") == F.col("_member"), F.size("_wider") > F.size("claim_ids"), F.size(F.array_except("claim_ids", "_wider")) == 0]
    within = rarest.join(larger, inside, "left_semi").select(*group, "claim_ids")
    return sets.join(within, [*group, "claim_ids"], "left_anti")
