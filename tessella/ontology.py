"""The graph's fixed vocabulary as small tables, and the check that rows keep to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Node types, relations with their usual ends, relations that hold one counterpart, priorities of sources.
NODE_TYPES = tuple("person bot team role organization channel document ticket pull_request meeting incident component product project topic alias".split())
RELATIONS = {
    "HAS_ALIAS": ("person", "alias"),
    "MEMBER_OF": ("person", "team"),
    "HAS_ROLE": ("person", "role"),
    "WORKS_FOR": ("person", "organization"),
    "REPORTS_TO": ("person", "person"),
    "SENT": ("person", "document"),
    "RECEIVED": ("person", "document"),
    "MENTIONS": ("document", "person"),
    "POSTED_IN": ("person", "channel"),
    "PARTICIPATED_IN": ("person", "meeting"),
    "REPORTED": ("person", "ticket"),
    "ASSIGNED_TO": ("ticket", "person"),
    "AUTHORED": ("person", "pull_request"),
    "OWNS": ("person", "component"),
    "REFERENCES": ("document", "ticket"),
    "RELATES_TO": ("ticket", "ticket"),
    "RESOLVES": ("pull_request", "ticket"),
    "PART_OF": ("ticket", "project"),
    "ABOUT": ("document", "component"),
    "INVOLVES": ("meeting", "organization"),
    "ACTION_ITEM": ("person", "document"),
    "CUSTOMER_OF": ("organization", "organization"),
}
ONE_FOR_EACH_SOURCE = ("MEMBER_OF", "WORKS_FOR", "HAS_ROLE", "REPORTS_TO", "ASSIGNED_TO")
ONE_FOR_EACH_TARGET = ("OWNS",)
PRIORITY = {"jira": 9, "linear": 9, "github": 8, "confluence": 7, "google_drive": 7, "hubspot": 6, "gmail": 5, "fireflies": 4, "slack": 3}
#: Types that are told apart by their normalized surface alone.
BY_KEY = ("ticket", "pull_request", "meeting", "project", "channel", "team", "role", "organization", "incident", "component", "product", "topic", "document")


def node_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in NODE_TYPES], "entity_type string")


def relation_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, *ends) for r, ends in RELATIONS.items()], "rel string, src_type string, dst_type string")


def priorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRIORITY.items()), "source string, priority int")


def known(rows: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """rows whose `column` (entity_type or rel) the vocabulary has; with strict, any other row fails the job."""
    allowed = NODE_TYPES if column == "entity_type" else tuple(RELATIONS)
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    if not strict:
        return rows.where(ok)
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(column, F.lit("null"))))))
