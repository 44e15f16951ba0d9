"""Places where own models plug in: embedding, extraction, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding(model: Callable[[list[str]], list[list[float]]], batch: int = 256) -> Callable[[Column], Column]:
    """A column function from a model of batches of texts to vectors; null texts have null vectors."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), batch):
                for i, v in zip(at[k : k + batch], model([texts.iloc[i] for i in at[k : k + batch]]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return lambda text: F.pandas_udf(run, "array<double>")(text)


def extraction(extractor: Callable[[str], list[tuple[str, str, str, float]]]) -> Callable[[DataFrame], DataFrame]:
    """documents (doc_id, text) to drafts (doc_id, place, subject_label, predicate, object_value, confidence) by an extractor of one text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, i, *draft) for d, t in zip(part["doc_id"], part["text"], strict=True) for i, draft in enumerate(extractor(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "subject_label", "predicate", "object_value", "confidence"])

    return lambda docs: docs.select("doc_id", "text").mapInPandas(run, "doc_id long, place int, subject_label string, predicate string, object_value string, confidence double")


def reranking(reranker: Callable[[str, list], list]) -> Callable[[DataFrame], DataFrame]:
    """hits (query_id, query, claim_id, rank) to (query_id, claim_id, place) by a reranker of one query's bounded list."""

    def run(hits: pd.DataFrame) -> pd.DataFrame:
        hits = hits.sort_values(["rank", "claim_id"])
        order = reranker(hits["query"].iloc[0], hits["claim_id"].tolist())
        return pd.DataFrame({"query_id": hits["query_id"].iloc[0], "claim_id": order, "place": range(1, len(order) + 1)})

    return lambda hits: hits.groupBy("query_id").applyInPandas(run, "query_id long, claim_id long, place int")
