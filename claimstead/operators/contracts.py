"""Semantic contracts: term resolution, claim issues, contract lint and entity shape."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.operators.identity import small


def terms(items: DataFrame) -> DataFrame:
    """term, id: every id, IRI and alias of items (position, id, iri, aliases); the first definition of a term wins."""
    spread = items.select("position", "id", F.posexplode(F.array_compact(F.concat(F.array("id", "iri"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("kind", "term"))
    first = Window.partitionBy("term").orderBy("position", "kind")
    return spread.withColumn("n", F.row_number().over(first)).where("n = 1").select("term", "id")


def matches_datatype(value: Column, datatype: Column) -> Column:
    """Whether a literal has its datatype; unknown datatypes never match."""
    safe = F.abs(F.try_to_number(value, F.lit("S9999999999999999999"))) <= 9007199254740991
    number = value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return (
        F.when(datatype == "string", True)
        .when(datatype == "integer", value.rlike(r"^-?\d+$") & F.coalesce(safe, F.lit(False)))
        .when(datatype == "number", number & F.coalesce(F.abs(value.try_cast("double")) < float("inf"), F.lit(False)))
        .when(datatype == "boolean", value.isin("true", "false"))
        .when(datatype == "date", value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull())
        .when(datatype == "date-time", value.try_cast("timestamp").isNotNull())
        .when(datatype == "uri", F.try_parse_url(value, F.lit("PROTOCOL")).isNotNull())
        .otherwise(False)
    )


def breaks_rules(value: Column, rules: Column) -> Column:
    """Kinds of the value rules (kind, values, pattern, length) that a literal breaks, in order. Patterns match anywhere."""
    fits = lambda r: (
        F.when(r["kind"] == "enum", F.array_contains(r["values"], value)).when(r["kind"] == "pattern", F.regexp_like(value, r["pattern"]))
        .when(r["kind"] == "min-length", F.length(value) >= r["length"]).when(r["kind"] == "max-length", F.length(value) <= r["length"]).otherwise(True)
    )
    return F.transform(F.filter(F.coalesce(rules, F.array().cast("array<struct<kind:string,values:array<string>,pattern:string,length:int>>")), lambda r: ~F.coalesce(fits(r), F.lit(False))), lambda r: r["kind"])


def claim_issues(claims: DataFrame, predicates: DataFrame) -> DataFrame:
    """claim_id, issues: codes of a claim against the contract's predicates.

    claims: claim_id, predicate, object_kind, object_value, object_datatype, subject_types, object_types; predicates: id, iri, aliases,
    position, domain, range_kind, range_types, datatype, datatype_iri, rules. Predicates are broadcast if they are few.
    """
    known = terms(predicates).join(predicates.withColumnRenamed("id", "pid"), F.col("id") == F.col("pid"))
    found = claims.join(small(known.withColumnRenamed("term", "_term")), claims["predicate"] == F.col("_term"), "left")
    outside = lambda listed, types: (F.size(listed) > 0) & (F.size(types) > 0) & ~F.arrays_overlap(listed, types)
    literal = (F.col("range_kind") == "literal") & (F.col("object_kind") == "literal")
    entity = (F.col("range_kind") == "entity") & (F.col("object_kind") == "entity")
    broken = breaks_rules(F.col("object_value"), F.col("rules"))
    issues = F.when(F.col("_term").isNull(), F.array(F.lit("UNKNOWN_PREDICATE"))).when(
        F.col("range_kind") != F.col("object_kind"), F.array_compact(F.array(F.when(outside(F.col("domain"), F.col("subject_types")), "DOMAIN_MISMATCH"), F.lit("RANGE_KIND_MISMATCH")))
    ).otherwise(F.concat(
        F.array_compact(F.array(
            F.when(outside(F.col("domain"), F.col("subject_types")), "DOMAIN_MISMATCH"),
            F.when(entity & outside(F.col("range_types"), F.col("object_types")), "RANGE_ENTITY_TYPE_MISMATCH"),
            F.when(literal & ~matches_datatype(F.col("object_value"), F.col("datatype")), "DATATYPE_MISMATCH"),
            F.when(literal & (F.col("datatype_iri") != F.col("object_datatype")), "DATATYPE_MISMATCH"),
        )),
        F.when(literal, F.transform(broken, lambda _: F.lit("VALUE_RULE_VIOLATION"))).otherwise(F.array().cast("array<string>")),
    ))
    return found.select("claim_id", issues.alias("issues"))


def compiles(pattern: Column) -> Column:
    """Whether a pattern is a valid regular expression; null is."""

    def good(p: str | None) -> bool:
        try:
            return p is None or re.compile(p) is not None
        except re.error:
            return False

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for patterns in batches:
            yield patterns.map(good)

    return F.pandas_udf(run, "boolean")(pattern)


def duplicates(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lint(types: DataFrame, parents: DataFrame, predicates: DataFrame, cyclic: DataFrame) -> DataFrame:
    """code, path for a registry of contracts: duplicate ids, IRIs and aliases (where there are such columns), unknown parents and ranges, cycles, bad cardinality, patterns and lengths."""
    rules = predicates.select("id", F.explode("rules").alias("r"))
    parts = [
        duplicates(types, ["id"]).select(F.lit("DUPLICATE_ID").alias("code"), F.col("id").alias("path")),
        duplicates(predicates, ["id"]).select(F.lit("DUPLICATE_ID").alias("code"), F.col("id").alias("path")),
        *[duplicates(own.where("iri IS NOT NULL"), ["iri"]).select(F.lit("DUPLICATE_IRI").alias("code"), F.col("iri").alias("path")) for own in (types, predicates) if "iri" in own.columns],
        *[duplicates(own.select(F.explode("aliases").alias("alias")), ["alias"]).select(F.lit("DUPLICATE_ALIAS").alias("code"), F.col("alias").alias("path")) for own in (types, predicates) if "aliases" in own.columns],
        parents.join(types.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("UNKNOWN_PARENT").alias("code"), F.col("type_id").alias("path")),
        predicates.select("id", F.explode("domain").alias("t")).join(types.select(F.col("id").alias("t")), "t", "left_anti").select(F.lit("UNKNOWN_DOMAIN").alias("code"), F.col("id").alias("path")),
        predicates.select("id", F.explode("range_types").alias("t")).join(types.select(F.col("id").alias("t")), "t", "left_anti").select(F.lit("UNKNOWN_RANGE").alias("code"), F.col("id").alias("path")),
        cyclic.select(F.lit("INHERITANCE_CYCLE").alias("code"), F.col("type_id").alias("path")),
        predicates.where("min_count < 0 OR max_count < 1 OR max_count < min_count").select(F.lit("BAD_CARDINALITY").alias("code"), F.col("id").alias("path")),
        rules.where((F.col("r.kind") == "pattern") & ~compiles(F.col("r.pattern"))).select(F.lit("BAD_PATTERN").alias("code"), F.col("id").alias("path")),
        rules.where("r.kind IN ('min-length', 'max-length') AND r.length < 0").select(F.lit("BAD_LENGTH").alias("code"), F.col("id").alias("path")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def conflict_rules(predicates: DataFrame, contract: str) -> DataFrame:
    """Maximum-cardinality rules of a contract: rule_id, terms (id, IRI and aliases, sorted), max, source. Where predicates have a status, only active ones make rules."""
    predicates = predicates.where("status = 'active'") if "status" in predicates.columns else predicates
    names = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("id", "iri"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    return predicates.where("max_count IS NOT NULL").select(F.col("id").alias("rule_id"), names.alias("terms"), F.col("max_count").alias("max"), F.lit(f"semantic-contract:{contract}").alias("source"))


def changed_bodies(contracts: DataFrame) -> DataFrame:
    """id, version of contracts that were put twice with different bodies."""
    return contracts.groupBy("id", "version").agg(F.count_distinct(F.sha2("body", 256)).alias("n")).where("n > 1").select("id", "version")


def latest_active(contracts: DataFrame) -> DataFrame:
    return contracts.where("status = 'active'").groupBy("id").agg(F.max(F.struct("version", "body")).alias("c")).select("id", "c.*")


def closed_types(claims: DataFrame, entities: DataFrame, closure: DataFrame, predicates: DataFrame, closed: DataFrame) -> DataFrame:
    """entity_id, predicate of claims on an entity of a closed type (closed: type_id) by a predicate that applies to none of its types."""
    own = entities.join(closed, "type_id", "left_semi").select("entity_id").distinct()
    applies = entities.join(closure, "type_id").join(small(predicates.select(F.col("id").alias("pid"), F.explode("domain").alias("ancestor"))), "ancestor").select("entity_id", "pid").distinct()
    said = claims.join(small(terms(predicates)), claims["predicate"] == F.col("term"), "left").select(F.col("subject_id").alias("entity_id"), "predicate", F.col("id").alias("pid"))
    return said.join(own, "entity_id", "left_semi").join(applies, ["entity_id", "pid"], "left_anti").select("entity_id", "predicate").distinct()


def entity_shape(claims: DataFrame, entities: DataFrame, closure: DataFrame, predicates: DataFrame) -> DataFrame:
    """entity_id, predicate_id, n, code: counts of a predicate on an entity outside its minimum or maximum, where the predicate applies to its type."""
    typed = entities.join(closure, "type_id")
    need = predicates.select(F.col("id").alias("predicate_id"), "min_count", "max_count", F.explode("domain").alias("ancestor"))
    due = typed.join(small(need), "ancestor").select("entity_id", "predicate_id", "min_count", "max_count").distinct()
    resolved = claims.join(small(terms(predicates)), claims["predicate"] == F.col("term")).groupBy(F.col("subject_id").alias("entity_id"), F.col("id").alias("predicate_id")).agg(F.count(F.lit(1)).alias("n"))
    counted = due.join(resolved, ["entity_id", "predicate_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("n") < F.col("min_count"), "MIN_ITEMS").when(F.col("n") > F.col("max_count"), "MAX_ITEMS")
    return counted.withColumn("code", code).where("code IS NOT NULL").select("entity_id", "predicate_id", "n", "code")
