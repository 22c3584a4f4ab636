"""Questions answered without a model: routing, entities, context, a verdict and an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

# Cues of each route, in order of precedence (without any it is a lookup), and words with a capital that name nothing.
CUES = {
    "aggregate": ("how many", "how much", "count", "number of", "list all", "list every", "all the", "every ", "total", "which ones", "name all", "what are all"),
    "conflict": (
        "current", "currently", "now", "still", "changed", "change", "used to", "previously", "latest", "up to date", "up-to-date", "no longer", "anymore",
        "which is correct", "conflict", "contradict", "who owns", "who is the owner", "most recent", "as of", "today",
    ),
    "multihop": (
        " who ", "through", "connected", "related to", "linked", "reported by", "assigned to", "worked on", "involved in", "responsible for", "between",
        "same ", "both ", "that also", "which team", "whose",
    ),
}
OPENERS = (
    "The", "A", "An", "What", "Who", "Which", "When", "Where", "Why", "How", "Is", "Are", "Was", "Were", "Did", "Does", "Do", "Can", "Will", "Would",
    "Should", "In", "On", "At", "For", "Of", "To", "And", "Or", "But", "This", "That",
)
CONFIDENT, UNSURE = 0.85, 0.55
K, WIDER_K, FACTS, CITED = 12, 25, 3, 3


def route(question: Column) -> Column:
    low = F.lower(question)
    out = None
    for name, cues in CUES.items():
        hit = low.rlike("|".join(cues))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("lookup")


def entities_of(question: Column) -> Column:
    """What a question names, each once, in order of kind: tickets, pull requests, addresses, quoted spans, handles, capitalised spans without openers."""
    found = lambda pattern: F.regexp_extract_all(question, F.lit(pattern), F.lit(1))
    spans = F.transform(found(r"\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*)"), lambda s: F.array_join(F.filter(F.split(s, r"\s+"), lambda w: ~w.isin(*OPENERS)), " "))
    pulls = F.transform(found(T.PULL_REQUEST), lambda n: F.concat(F.lit("PR#"), n))
    return T.ordered_distinct(F.concat(found(T.TICKET), pulls, T.emails(question), found('"([^"]{2,40})"'), found("'([^']{2,40})'"), found(T.MENTION), spans))


def fallback_names(question: Column) -> Column:
    """The first six words of a question that may name something, for when nothing else is found."""
    useful = F.filter(T.words(question), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS))
    return F.slice(F.array_distinct(useful), 1, 6)


def context(facts: Column, hits: Column) -> Column:
    """Facts and titled snippets in one text."""
    docs = F.transform(F.slice(hits, 1, 6), lambda h: F.concat(F.lit("["), h["doc_id"].cast("string"), F.lit("] "), h["title"], F.lit(": "), h["snippet"]))
    return F.concat_ws("\n", F.array_join(facts, "\n"), F.array_join(docs, "\n"))


def answers(gathered: DataFrame) -> DataFrame:
    """question_id, answer, document_ids, abstained, confidence, route from gathered (question_id, question, hits, facts).

    hits: array of doc_id, title, snippet, score in order; facts: array of lines. Without context it abstains; with
    facts it states the first three and cites three documents, else it gives the best hit and cites that.
    """
    empty = (F.size("hits") == 0) & (F.size("facts") == 0)
    first = F.try_element_at("hits", F.lit(1))
    said = F.when(empty, F.lit("")).when(F.size("facts") > 0, F.array_join(F.slice("facts", 1, FACTS), " ")).otherwise(F.concat(first["title"], F.lit(": "), first["snippet"]))
    ids = F.transform("hits", lambda h: h["doc_id"])
    cited = F.when(empty, F.slice(ids, 1, 0)).when(F.size("facts") > 0, F.slice(ids, 1, CITED)).otherwise(F.slice(ids, 1, 1))
    sure = F.when(empty, 0.0).when(F.size("facts") > 0, CONFIDENT).otherwise(UNSURE)
    return gathered.select("question_id", said.alias("answer"), cited.alias("document_ids"), empty.alias("abstained"), sure.alias("confidence"), route(F.col("question")).alias("route"))


def with_path_documents(hits: Column, docs: Column) -> Column:
    """hits, followed by the documents of paths that are not among them, with a score of 0 and no text."""
    more = F.array_except(docs, F.transform(hits, lambda h: h["doc_id"]))
    return F.concat(hits, F.transform(more, lambda d: F.struct(d.alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit(0.0).alias("score"))))


def merge_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, rank) of two searches, each document once, the first search's before."""
    both = first.withColumn("turn", F.lit(0)).unionByName(second.withColumn("turn", F.lit(1)))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("turn", "rank"))).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "rank"))).drop("turn")
