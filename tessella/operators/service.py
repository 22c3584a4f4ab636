"""Shapes in which results leave the engine: ordered look-ups, JSON, traces and answer lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(asked: DataFrame, rows: DataFrame, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """query_id, position and the rows that each query's list of ids names, in the list's order; unknown ids are left out."""
    return asked.select("query_id", F.posexplode(ids).alias("position", key)).join(rows, key)


def preview(text: Column, width: int = 400) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, width)


def day(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd")


def edge_json(edge: DataFrame) -> DataFrame:
    """edge_id and the edge as JSON."""
    body = F.struct("edge_id", "src", "rel", "dst", day(F.col("valid_from")).alias("valid_from"), day(F.col("valid_to")).alias("valid_to"), F.col("valid_to").isNull().alias("is_current"), "contested", "superseded_by", "source", "docs", "confidence")
    return edge.select("edge_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def surface_forms(*lists: Column) -> Column:
    """All surfaces of an entity, each once, sorted."""
    return F.array_sort(F.array_remove(F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))), ""))


def entity_json(entities: DataFrame) -> DataFrame:
    forms = surface_forms(F.col("names"), F.col("handles"), F.col("emails"))
    return entities.select("canonical_id", F.to_json(F.struct("canonical_id", "label", "name", forms.alias("surface_forms"))).alias("json"))


def answer_line(answers: DataFrame) -> DataFrame:
    """question_id, and the line that an answers file has for it."""
    return answers.select("question_id", F.to_json(F.struct("question_id", "answer", "document_ids", "abstained")).alias("line"))


def flat_trace(traces: DataFrame) -> DataFrame:
    """Traces (question_id, route, retrieved, paths: array of node and document lists, reason, retries) with each path as its length and documents."""
    paths = F.transform("paths", lambda p: F.struct(F.size(p["edges"]).alias("length"), F.array_distinct(F.flatten(p["docs"])).alias("doc_ids")))
    return traces.select("question_id", "route", "retrieved", paths.alias("paths"), "reason", "retries")


def cited_or_retrieved(cited: Column, retrieved: Column, k: int = 6) -> Column:
    """The cited documents, or the first that were retrieved."""
    return F.when(F.size(F.coalesce(cited, F.array().cast("array<string>"))) > 0, cited).otherwise(F.slice(retrieved, 1, k))
