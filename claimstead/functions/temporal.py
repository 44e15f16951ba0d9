"""Bitemporal predicates. Intervals are half-open; a null end is open."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = dt.datetime(9999, 12, 31, 23, 59, 59, 999000)


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def open_end(valid_to: Column) -> Column:
    return F.coalesce(valid_to, F.lit(OPEN_END.isoformat(sep=" ")).cast("timestamp_ntz"))


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    return at.isNull() | ((valid_from <= at) & (valid_to.isNull() | (at < valid_to)))


def known_at(recorded_at: Column, at: Column) -> Column:
    return at.isNull() | (recorded_at <= at)


def visible_at(status: Column, valid_from: Column, valid_to: Column, recorded_at: Column, valid: Column, known: Column) -> Column:
    """Superseded and conflicted claims stay visible; retracted ones don't."""
    return (status != "retracted") & valid_at(valid_from, valid_to, valid) & known_at(recorded_at, known)


def overlaps(left_from: Column, left_to: Column, right_from: Column, right_to: Column) -> Column:
    return (left_from < open_end(right_to)) & (right_from < open_end(left_to))


def perspective(temporal: Column, as_of: Column) -> Column:
    """valid_at and known_at of a request: its temporal struct if there is one, else the older as_of for both."""
    legacy = F.struct(as_of.alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("known_at"))
    return F.when(temporal.isNotNull(), F.struct(temporal["valid_at"].alias("valid_at"), temporal["known_at"].alias("known_at"))).otherwise(legacy)
