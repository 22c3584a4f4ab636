"""Raw text files to normalized documents, and the tables that stages exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

DOCUMENT = "doc_id string, source_type string, title string, body string, timestamp timestamp_ntz, author_refs array<string>, mention_refs array<string>, thread_id string, path string, raw_metadata map<string,string>"

# What shapes speakers, addresses and roles have, by source.
HEADER = r"(?m)^(From|To|Cc|Bcc|Date|Subject):[ \t]*(.*)$"
ADDRESS = r"([^<,;]+?)\s*<([^>]+)>|([\w.+-]+@[\w-]+\.[\w.-]+)"
SPEAKER = r"(?m)^([A-Za-z][A-Za-z0-9._\-]{0,24}(?:\s+[A-Z][A-Za-z.]{0,14})?)(?:\s*\(([^)]{1,40})\))?:\s"
PAREN = r"(?m)^([A-Z][A-Za-z.\-' ]{1,40}?)\s*\(([^)]{1,40})\):"
ACTION = r"(?m)^([A-Z][\w.\-' ]{1,40}?)\s*\(([^)]{1,40})\)\s+to\s+"
INLINE_ROLE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*\((AE|SE|PM|EM|SRE|CSM|AM)\)"

# Words before a colon that are no speakers.
LABELS = (
    "http", "https", "note", "notes", "summary", "impact", "timeline", "scope", "purpose", "goal", "goals", "problem", "requirements", "required",
    "example", "examples", "steps", "repro", "result", "results", "status", "owner", "owners", "next", "action", "actions", "context", "background",
    "solution", "mitigation", "root", "cause", "detail", "details", "issue", "update", "updates", "warning", "error", "errors", "response", "request",
    "logic", "design", "testing", "tests", "rollout", "migration", "motivation", "definitions", "objective", "overview", "principles", "process", "sla",
    "eta", "tldr", "tl;dr", "faq", "q", "a", "auto-summary", "post-meeting notes", "attendees", "agenda", "decisions", "risks", "blockers", "asks", "ask",
    "priority", "severity", "environment",
)
PAREN_SOURCES, CHAT_SOURCES, MAIL_SOURCES = ("jira", "fireflies", "hubspot"), ("slack",), ("gmail",)


def read_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, source_type, doc_id, slug, content of the documents under the roots; a doc_id that two roots have is the first root's.

    The folder above a file is its source; files with other names are left out.
    """
    ordinal = F.coalesce(*(F.when(F.col("path").startswith(r.rstrip("/")) | F.col("path").contains(r.rstrip("/") + "/"), F.lit(i)) for i, r in enumerate(roots)), F.lit(len(roots)))
    raw = spark.read.option("recursiveFileLookup", "true").text(roots, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.withColumn("doc_id", F.lower(F.regexp_extract(name, T.DOC_FILE, 1))).where("doc_id <> ''").withColumn("slug", F.regexp_extract(name, T.DOC_FILE, 2)).withColumn("source_type", F.element_at(F.split("path", "/"), -2))
    first = Window.partitionBy("doc_id").orderBy("root", "path")
    return rows.withColumn("root", ordinal).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "root")


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(1, n + 1)]


def _nonempty(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def header_fields(body: Column) -> Column:
    """Array of (field, value) of the header lines."""
    field, value = _groups(body, HEADER, 2)
    return F.zip_with(field, value, lambda f, v: F.struct(F.lower(f).alias("field"), v.alias("value")))


def addresses(value: Column) -> Column:
    """Names and addresses of a header value, in order."""
    name, addr, bare = _groups(value, ADDRESS, 3)
    return _nonempty(F.flatten(F.transform(F.arrays_zip(name.alias("n"), addr.alias("a"), bare.alias("b")), lambda x: F.array(x["n"], x["a"], x["b"]))))


def _of_fields(fields: Column, *names: str) -> Column:
    return F.flatten(F.transform(F.filter(fields, lambda x: x["field"].isin(*names)), lambda x: addresses(x["value"])))


def speakers(body: Column) -> Column:
    """Names before a colon at the start of a line that are people: known by recurring, or by their shape."""
    names = _groups(body, SPEAKER, 1)[0]
    often = lambda n: F.size(F.filter(names, lambda m: m == n)) >= 2
    return F.filter(names, lambda n: ~F.lower(F.trim(n)).isin(*LABELS) & (F.length(F.trim(n)) >= 2) & (often(n) | n.rlike(r"[._\-\d ]")))


def pairs(body: Column) -> tuple[Column, Column]:
    """People and roles of `X (Y):`, `X (Y) to …` and `Name (ROLE)`."""
    found = F.concat(*(F.arrays_zip(*(g.alias(n) for g, n in zip(_groups(body, p, 2), ("x", "y")))) for p in (PAREN, ACTION, INLINE_ROLE)))
    ok = F.filter(found, lambda p: ~F.lower(F.trim(p["x"])).isin(*LABELS) & (F.length(F.trim(p["x"])) >= 2))
    return F.transform(ok, lambda p: F.trim(p["x"])), F.filter(F.transform(ok, lambda p: F.trim(p["y"])), lambda y: ~F.lower(y).isin(*LABELS))


def normalize(files: DataFrame) -> DataFrame:
    """Files (path, source_type, doc_id, slug, content) as documents of one shape, by the rules of their source."""
    content = F.regexp_replace("content", r"\r\n?", "\n")
    rows = files.withColumn("title", F.trim(F.substring_index(content, "\n", 1))).withColumn("body", F.when(content.contains("\n"), F.regexp_extract(content, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(""))
    body, kind = F.col("body"), F.col("source_type")
    fields, mails = header_fields(body), T.emails(body)
    mail, chat, paren = kind.isin(*MAIL_SOURCES), kind.isin(*CHAT_SOURCES), kind.isin(*PAREN_SOURCES)
    value = lambda name: F.try_element_at(F.transform(F.filter(fields, lambda x: x["field"] == name), lambda x: x["value"]), F.lit(1))
    people, roles = pairs(body)
    talk, teams = speakers(body), _nonempty(_groups(body, SPEAKER, 2)[1])
    at = F.regexp_extract_all(body, F.lit(T.MENTION), F.lit(1))
    inline = F.flatten(F.zip_with(*_groups(body, INLINE_ROLE, 2), lambda a, b: F.array(F.trim(a), b)))
    authors = F.when(mail, _of_fields(fields, "from")).when(chat, talk).when(paren, F.slice(people, 1, 1)).otherwise(F.array().cast("array<string>"))
    mentioned = F.when(mail, F.concat(_of_fields(fields, "to", "cc", "bcc"), mails)).when(chat, F.concat(talk, at, mails)).when(paren, F.concat(people, roles, mails)).otherwise(F.concat(mails, inline))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    names = ("from", "to", "cc", "bcc", "date", "subject")
    headers = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(value, names))), lambda _, v: v.isNotNull())
    extra = F.when(mail, headers).when(chat, F.create_map(F.lit("channel"), F.col("title"), F.lit("teams"), F.array_join(T.ordered_distinct(teams, 40), ","))).when(paren, F.create_map(F.lit("roles"), F.array_join(T.ordered_distinct(roles, 40), ","))).otherwise(empty)
    refs = F.create_map(F.lit("slug"), F.col("slug"), F.lit("cross_refs"), T.cross_references(F.concat_ws("\n", "title", "body", "slug")))
    return rows.select(
        "doc_id",
        "source_type",
        "title",
        "body",
        F.when(mail, T.header_date(value("date"))).otherwise(T.first_date(body)).alias("timestamp"),
        T.ordered_distinct(authors).alias("author_refs"),
        T.ordered_distinct(mentioned).alias("mention_refs"),
        F.when(mail, value("subject")).when(chat, F.col("title")).alias("thread_id"),
        "path",
        F.map_concat(extra, refs).alias("raw_metadata"),
    )


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("source_type").option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Normalized documents; the schema is given, never inferred."""
    return spark.read.schema(DOCUMENT).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path).where(F.lit(True)).dropna("all")


def append_jsonl(rows: DataFrame, path: str, key: str, schema: str) -> None:
    """Append the rows whose key is not there yet."""
    spark = rows.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows = rows.join(read_jsonl(spark, path, schema).select(key), key, "left_anti")
    rows.write.mode("append").json(path)
