"""Nested product records (chats, transcripts, changes, teams), and the teams that their traces suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.evaluation import prf
from tessella.operators.linkage import disambiguated

SCHEMA = "product string, slack array<struct<Message:struct<User:struct<userId:string>,text:string>>>, meeting_transcripts array<struct<transcript:string>>, prs array<struct<title:string,body:string,user:string>>, team array<string>"
# Forms of employee ids and of names in transcripts.
EMPLOYEE = r"\beid_[0-9a-z]+\b"
ATTENDEE = r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"
SAID = r"(?m)^([A-Z][a-z]+ [A-Z][a-z]+):"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def evidence(products: DataFrame) -> DataFrame:
    """group, id: employees seen by id in a product's chats and changes."""
    written = F.transform(F.coalesce("slack", F.expr("array()").cast("array<struct<Message:struct<User:struct<userId:string>,text:string>>>")), lambda m: F.concat_ws(" ", m["Message"]["User"]["userId"], m["Message"]["text"]))
    changes = F.transform(F.coalesce("prs", F.expr("array()").cast("array<struct<title:string,body:string,user:string>>")), lambda p: F.to_json(p))
    found = F.regexp_extract_all(F.array_join(F.concat(written, changes), "\n"), F.lit(EMPLOYEE), F.lit(0))
    return products.select(F.col("product").alias("group"), F.explode(F.array_distinct(found)).alias("id"))


def named(products: DataFrame) -> DataFrame:
    """group, name: people in the heads of transcripts or speaking there."""
    one = products.select(F.col("product").alias("group"), F.explode("meeting_transcripts.transcript").alias("t"))
    head = F.regexp_extract_all(F.substring_index("t", "Transcript", 1), F.lit(ATTENDEE), F.lit(1))
    return one.select("group", F.explode(F.concat(head, F.regexp_extract_all("t", F.lit(SAID), F.lit(1)))).alias("name")).distinct()


def teams(products: DataFrame, employees: DataFrame) -> DataFrame:
    """group, found (sorted ids): those seen by id and those named, where employees (id, name) and context leave one choice."""
    seen = evidence(products)
    by_name = disambiguated(named(products), employees.select("name", "id"), seen).select("group", "id")
    return seen.unionByName(by_name).distinct().groupBy("group").agg(F.array_sort(F.collect_set("id")).alias("found"))


def team_scores(products: DataFrame, employees: DataFrame) -> DataFrame:
    """group, precision, recall, f1 against the products' own team lists."""
    gold = products.select(F.col("product").alias("group"), "team")
    none = F.array().cast("array<string>")
    return gold.join(teams(products, employees), "group", "left").select("group", *prf(F.coalesce("found", none), F.coalesce("team", none)))
