"""What a question may be answered from: its reader's tenant and first namespace at its instants. Filters act before any limit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.temporal import perspective, visible_at

#: Columns of a claim that tell where and when it counts, and of a question that tell where and when it asks.
CLAIM = ["tenant_id", "namespace_id", "valid_from", "valid_to", "recorded_at"]
QUESTION = ["tenant_id", "namespace_id", "valid_at", "known_at"]

FIRST, LAST = -(1 << 62), 1 << 62


def asked(questions: DataFrame) -> DataFrame:
    """questions with the perspective's columns: tenant and first namespace of `reader`, and valid_at and known_at of `temporal` or else `as_of`.

    Columns `temporal` (struct of valid_at and known_at) and `as_of` may be missing; a null instant doesn't restrict. A reader without a namespace raises an error.
    """
    none = F.lit(None).cast("timestamp_ntz")
    temporal = F.col("temporal") if "temporal" in questions.columns else F.lit(None).cast("struct<valid_at: timestamp_ntz, known_at: timestamp_ntz>")
    at = perspective(temporal, F.col("as_of") if "as_of" in questions.columns else none)
    space = F.coalesce(F.get(F.col("reader.namespace_ids"), F.lit(0)), F.raise_error(F.lit("principal has no namespace")))
    return questions.withColumns({"tenant_id": F.col("reader.tenant_id"), "namespace_id": space, "valid_at": at["valid_at"], "known_at": at["known_at"]})


def seen(claim: str, question: str) -> Column:
    """Whether a claim, not retracted, lies in a question's perspective; both are aliases of frames with CLAIM and QUESTION."""
    c, q = (lambda n: F.col(f"{claim}.{n}")), (lambda n: F.col(f"{question}.{n}"))
    here = (c("tenant_id") == q("tenant_id")) & (q("namespace_id").isNull() | (c("namespace_id") == q("namespace_id")))
    return here & visible_at(F.lit("asserted"), c("valid_from"), c("valid_to"), c("recorded_at"), q("valid_at"), q("known_at"))


def micros(instant: Column, otherwise: int) -> Column:
    return F.coalesce(F.unix_micros(instant.cast("timestamp")), F.lit(otherwise)).cast("long")


def claim_columns() -> list[Column]:
    """CLAIM with instants as numbers, for tasks in Python."""
    return [F.col("tenant_id"), F.col("namespace_id"), micros(F.col("valid_from"), FIRST).alias("valid_from"), micros(F.col("valid_to"), LAST).alias("valid_to"), micros(F.col("recorded_at"), FIRST).alias("recorded_at")]


def question_columns() -> list[Column]:
    """QUESTION likewise; a null instant is null."""
    return [F.col("tenant_id"), F.col("namespace_id"), F.unix_micros(F.col("valid_at").cast("timestamp")).alias("valid_at"), F.unix_micros(F.col("known_at").cast("timestamp")).alias("known_at")]


def open_to(claims: pa.RecordBatch | pa.Table, questions: Sequence[tuple]) -> np.ndarray:
    """A row of truth values for each question (tenant, namespace, valid_at, known_at): which claims of a batch lie in its perspective. Equal perspectives are worked out once."""
    array = lambda c: claims.column(c).to_numpy(zero_copy_only=False) if isinstance(claims, pa.RecordBatch) else claims.column(c).to_numpy()
    tenant, space, since, until, known = (array(c) for c in CLAIM)
    found: dict[tuple, np.ndarray] = {}
    out = np.zeros((len(questions), len(tenant)), bool)
    for at, q in enumerate(questions):
        key = tuple(q)
        if key not in found:
            fits = tenant == q[0]
            if q[1] is not None:
                fits = fits & (space == q[1])
            if q[2] is not None:
                fits = fits & (since <= q[2]) & (q[2] < until)
            if q[3] is not None:
                fits = fits & (known <= q[3])
            found[key] = np.broadcast_to(np.asarray(fits, bool), len(tenant))
        out[at] = found[key]
    return out
