"""Scalar functions over claims, names, queries and vectors, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
# XSD types of the literal datatypes; uri has none.
XSD_TYPES = {"string": "string", "integer": "integer", "number": "double", "boolean": "boolean", "date": "date", "date-time": "dateTime"}


def claim_text(predicate: Column, value: Column, entity_id: Column) -> Column:
    return F.concat_ws(" ", predicate, F.coalesce(value, entity_id))


def objects_equal(left: Column, right: Column) -> Column:
    """Equality of tagged objects (kind, entity_id, value, datatype); a missing datatype equals a missing one."""
    same = lambda f: left[f].eqNullSafe(right[f])
    return same("kind") & F.when(left["kind"] == "entity", same("entity_id")).otherwise(same("value") & same("datatype"))


def object_key(kind: Column, root: Column, datatype: Column, value: Column) -> Column:
    """Key by which objects are equal: the canonical entity, or datatype and value."""
    return F.when(kind == "entity", F.concat_ws(":", F.lit("entity"), root)).otherwise(F.concat(F.lit("literal:"), F.coalesce(datatype, F.lit("")), F.lit(":"), value))


def claim_object(claims: DataFrame) -> Column:
    """The object key of claim rows: object_entity_id, where there is such a column and it has a value, else object_datatype, if there is one, and object_value."""
    value = F.col("object_value").cast("string")
    datatype = F.col("object_datatype") if "object_datatype" in claims.columns else F.lit(None).cast("string")
    entity = F.col("object_entity_id") if "object_entity_id" in claims.columns else F.lit(None).cast("string")
    return object_key(F.when(entity.isNotNull(), "entity").otherwise("literal"), entity.cast("string"), datatype, value)


def lexical_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two or more characters, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


def lexical_score(tokens: Column, text: Column) -> Column:
    """How many query tokens occur in the text as substrings."""
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + F.contains(F.lower(text), t).cast("int"))


def explain_hit(lexical: Column, vector: Column, graph: Column) -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(lexical.isNotNull(), F.concat(F.lit("lexical "), F.regexp_replace(lexical.cast("string"), r"\.0$", ""))),
        F.when(vector.isNotNull(), F.format_string("vector %.2f", vector)),
        F.when(graph.isNotNull(), F.lit("graph neighborhood")),
    )
    return F.when(parts == "", "metadata match").otherwise(parts)


def normal_predicate(predicate: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(predicate)), r"\s+", "_")


def nfkc(text: Column) -> Column:
    """Compatibility normal form, which Spark has no function for."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(text)


def normal_name(name: Column) -> Column:
    """NFKC, lower case, other characters than letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.lower(nfkc(name)), r"[^\p{L}\p{N}]+", " "))


def normal_external(system: Column, value: Column) -> Column:
    return F.struct(F.lower(F.trim(nfkc(system))).alias("system"), F.trim(nfkc(value)).alias("value"))


def name_tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda x: x != ""))


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(left, right)))


def name_signal(query: Column, candidate: Column, source: Column) -> Column:
    """kind and score of the strongest relation of two normalised names; null if none."""
    overlap = jaccard(name_tokens(query), name_tokens(candidate))
    pair = lambda kind, score: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    return (
        F.when((query == "") | (candidate == ""), None)
        .when((query == candidate) & (source == "label"), pair("label-exact", 1.0))
        .when(query == candidate, pair("alias-exact", 0.92))
        .when(overlap >= 0.8, pair("strong-token-overlap", 0.82))
        .when(overlap >= 0.5, pair("partial-token-overlap", 0.68))
        .when((F.length(query) >= 3) & (F.contains(candidate, query) | F.contains(query, candidate)), pair("substring", 0.58))
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine over the common prefix; 0 for empty or zero vectors."""
    n = F.least(F.size(left), F.size(right))
    a, b = F.slice(left, F.lit(1), F.greatest(n, F.lit(0))), F.slice(right, F.lit(1), F.greatest(n, F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x)))
    return F.when(norms > 0, dot / norms).otherwise(0.0)


def code_sums(text: Column) -> Column:
    """s0 and s1 of a text that isn't null: the sum of its characters' codes, and that of the codes times their places from 0. A text is one array of codes; per character Spark's own functions take a hundred times as long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = np.arange(1 << 12)
        for texts in batches:
            sums = np.zeros((2, len(texts)), np.int64)
            for i, t in enumerate(texts):  # no list of a whole batch's strings
                codes = np.frombuffer(t.as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
                if len(codes) > len(places):
                    places = np.arange(2 * len(codes))
                sums[:, i] = codes.sum(), codes @ places[: len(codes)]
            yield pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1])], ["s0", "s1"])

    return F.arrow_udf(run, "s0 long, s1 long")(text)


def hash_embedding(text: Column, dimensions: int) -> Column:
    """Unit vector of sines of weighted character codes; two sums per text give every dimension. Those of a null text are null."""
    sums = F.when(text.isNotNull(), code_sums(F.coalesce(text, F.lit(""))))
    raw = F.transform(F.array(sums), lambda s: F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda d: F.sin((d * s["s0"] + s["s1"]).cast("double"))))[0]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(raw), lambda v: F.transform(v, lambda x: F.when(norm(v) > 0, x / norm(v)).otherwise(x)))[0]


def stable_sample(key: Column) -> Column:
    """A percentage from 0 to 100 that depends on the key alone: 32-bit FNV-1a over its characters."""
    h = F.aggregate(
        F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, "")),
        F.lit(2_166_136_261).cast("long"),
        lambda a, c: (a.bitwiseXOR(F.ascii(c).cast("long")) * 16_777_619).bitwiseAND(F.lit(4_294_967_295).cast("long")),
    )
    return h / 42_949_672.96


def policy_key(version_id: Column, version: Column) -> Column:
    return F.concat(version_id, F.lit("@"), version.cast("string"))


def parse_policy_key(key: Column) -> Column:
    """id and integer version from a legacy id@version key; null if it has no such form."""
    pattern = r"^(.+)@(-?\d+)$"
    return F.when(key.rlike(pattern), F.struct(F.regexp_extract(key, pattern, 1).alias("id"), F.regexp_extract(key, pattern, 2).cast("int").alias("version")))


def claim_set_key(ids: Column) -> Column:
    return F.array_join(F.sort_array(ids), "\u0000")


def conflict_identity(cause: Column, ids: Column) -> Column:
    return F.concat_ws("\u0001", cause, claim_set_key(ids))


def datatype_iri(datatype: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, xsd in XSD_TYPES.items():
        chain = F.when(datatype == name, XSD + xsd).otherwise(chain)
    return chain


def term_iri(iri: Column, base: Column, term: Column) -> Column:
    return F.coalesce(iri, F.concat(base, term))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def mime_of(name: Column) -> Column:
    return (
        F.when(name.endswith(".md"), "text/markdown").when(name.endswith(".json"), "application/json").when(name.endswith(".txt"), "text/plain").when(name.endswith(".pdf"), "application/pdf").otherwise("application/octet-stream")
    )


def is_text_mime(mime: Column) -> Column:
    return mime.startswith("text/") | (mime == "application/json") | mime.endswith("+json")
