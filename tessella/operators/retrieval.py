"""Keyword, vector and hybrid retrieval, snippets and retrieval scores."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import text as T
from tessella.functions.udfs import porter
from tessella.session import ship

K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60
#: Terms that are handed to the scan of an index as a filter; more are joined with it.
PUSHED_TERMS = 256


def postings(docs: DataFrame, stems: bool = False) -> DataFrame:
    """doc_id, term, position (from 0), length of the document in terms; terms without marks and as stems, if asked for."""
    listed = docs.select("doc_id", T.words(T.plain_latin(F.col("text")) if stems else F.col("text")).alias("terms"))
    flat = listed.select("doc_id", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    if not stems:
        return flat
    ship(docs.sparkSession)
    known = flat.select("term").distinct().withColumn("stem", porter("term"))
    return flat.join(known, "term").select("doc_id", "length", "position", F.col("stem").alias("term"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df, cf."""
    once = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return once.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase, size, offset, term: each term of a query is a phrase of one or more words."""
    terms = queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("phrase"))
    cut = terms.withColumn("parts", T.words(F.col("phrase"))).where(F.size("parts") > 0)
    return cut.select("query_id", "phrase", F.size("parts").alias("size"), F.posexplode("parts").alias("offset", "term"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, sources: list[str] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents for any of a query's terms.

    Statistics are over all docs; `sources` restricts what is returned, before ranking. Only postings of the queries'
    own words are shuffled; a document's length is counted where it is read.
    """
    sized = docs.select("doc_id", T.words(F.col("text")).alias("terms"))
    facts = sized.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"))
    flat = sized.select("doc_id", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    return _ranked(flat, facts, docs, queries, k, sources)


def _ranked(flat: DataFrame, facts: DataFrame, docs: DataFrame, queries: DataFrame, k: int, sources: list[str] | None) -> DataFrame:
    """bm25 over flat (doc_id, length, position, term), facts (n, mean: one row) and docs (doc_id, source)."""
    asked = phrases(queries)
    hits = flat.join(asked.select("phrase", "size", "offset", "term").distinct(), "term")
    whole = hits.groupBy("phrase", "size", "doc_id", "length", (F.col("position") - F.col("offset")).alias("at")).agg(F.count("*").alias("c")).where("c = size")
    tf = whole.groupBy("phrase", "doc_id", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = tf.join(df, "phrase").crossJoin(F.broadcast(facts)).select("phrase", "doc_id", part.alias("part"))
    total = asked.select("query_id", "phrase").distinct().join(scored, "phrase").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    if sources is not None:
        total = total.join(docs.where(F.col("source").isin(sources)).select("doc_id"), "doc_id", "left_semi")
    return top(total, "query_id", "doc_id", k)


class Index(NamedTuple):
    """An inverted index: postings (term, doc_id, length, positions), documents (doc_id, source) and facts (n, mean)."""

    postings: DataFrame
    documents: DataFrame
    facts: DataFrame


def write_index(docs: DataFrame, path: str) -> Index:
    """The index of docs (doc_id, source, text), written below path and read back.

    Postings lie in order of term and document, dealt by ranges of both, so that a term that most documents have is
    spread over files and a search reads the row groups of its own terms only.
    """
    listed = docs.select("doc_id", T.words(F.col("text")).alias("terms"))
    flat = listed.select("doc_id", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    held = flat.groupBy("term", "doc_id", "length").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    held.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    docs.select("doc_id", "source").write.mode("overwrite").parquet(f"{path}/documents")
    listed.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).write.mode("overwrite").parquet(f"{path}/facts")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in Index._fields))


def bm25_stored(index: Index, queries: DataFrame, k: int, sources: list[str] | None = None) -> DataFrame:
    """bm25 from a written index: no text is read. The terms of a few queries go to the scan as a filter; those of more are joined."""
    terms = [r["term"] for r in phrases(queries).select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    held = index.postings.where(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else index.postings
    return _ranked(held.select("doc_id", "length", "term", F.explode("positions").alias("position")), index.facts, index.documents, queries, k, sources)


def top(scored: DataFrame, query: str | list[str], key: str, k: int) -> DataFrame:
    """The k highest scores of each query (or of each of several columns' values), ties to the smaller key."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hashed(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: an encoder that needs no model."""
    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % size] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed, width: int = 2000) -> DataFrame:
    """doc_id, vector of title and the first `width` characters of the body, by an encoder of lists of texts (model inputs are that long)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = np.asarray(encoder([t or "" for t in batch.column(1).to_pylist()]), np.float32)
                yield pa.record_batch([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["doc_id", "vector"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.concat_ws("\n", "title", F.substring("body", 1, width)).alias("t")).mapInArrow(run, f"doc_id {kind}, vector array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: cosine similarity of every query (query_id, vector) to every vector (vec_id, vector).

    A stated set of queries against all rows; the queries are the small side.
    """
    norm = lambda v: F.sqrt(dot(v, v))
    q = queries.select("query_id", F.col("vector").alias("q"), norm(F.col("vector")).alias("qn"))
    v = vectors.select("vec_id", "vector", norm(F.col("vector")).alias("vn"))
    near = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("vector")) / (F.col("qn") * F.col("vn")), 6).alias("score"))
    return top(near, "query_id", "vec_id", k)


def cosine_top_blocked(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None, block: int = 256) -> DataFrame:
    """cosine_top for a set of queries that grows with the table; with `by`, a column of vectors, the k best of each of its values.

    Queries and vectors are dealt into blocks of about `block` rows by hash; each pair of blocks is one product of
    matrices of which only the best of each query (and value) are kept, so that no side is broadcast or collected.
    Vectors that are null or of another size than the query's have no score. Ids that are not of one type name
    different things, else a query is not among its own results.
    """
    ship(vectors.sparkSession)
    kinds = [queries.schema["query_id"].dataType, vectors.schema["vec_id"].dataType]
    itself = kinds[0] != kinds[1]
    types = [*(to_arrow_type(x) for x in kinds), pa.string(), pa.float64()]
    value = F.col(by).cast("string") if by else F.lit("")

    def blocks(rows: DataFrame, name: str, *columns: Column) -> DataFrame:
        # the count is of blocks, not of rows: one number
        n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("blocks"))
        dealt = rows.select(*columns).crossJoin(F.broadcast(n)).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
        return dealt.groupBy("at").agg(F.collect_list(F.struct("id", "v", "g")).alias(name)).drop("at")

    v = blocks(vectors.where("vector IS NOT NULL"), "d", F.col("vec_id").alias("id"), F.col("vector").alias("v"), value.alias("g"))
    q = blocks(queries.where("vector IS NOT NULL"), "q", F.col("query_id").alias("id"), F.col("vector").alias("v"), F.lit("").alias("g"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                d, q = ([(x["id"], x["v"], x["g"]) for x in batch.column(c)[i].as_py()] for c in (0, 1))
                out: list[tuple] = []
                for size in {len(x[1]) for x in q}:
                    qs, ds = ([x for x in side if len(x[1]) == size] for side in (q, d))
                    if not ds:
                        continue
                    a, b = (np.array([x[1] for x in side], float) for side in (qs, ds))
                    ids, groups = np.array([x[0] for x in ds]), np.array([str(x[2]) for x in ds])
                    with np.errstate(all="ignore"):
                        scores = np.round(a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)), 6)
                    for g in set(groups.tolist()):
                        own = np.flatnonzero(groups == g)
                        for j, (query, *_) in enumerate(qs):
                            near = own[np.isfinite(scores[j, own]) & (itself or ids[own] != query)]
                            best = near[np.lexsort((ids[near], -scores[j, near]))[:k]]
                            out += [(query, ds[x][0], None if ds[x][2] is None else g, float(scores[j, x])) for x in best]
                yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["query_id", "vec_id", "value", "score"])

    near = q.crossJoin(v).select("d", "q").mapInArrow(run, f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, value string, score double")
    return top(near, ["query_id", "value"], "vec_id", k)


def fuse(*ranked: DataFrame, k: int, weights: tuple[float, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank)."""
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part")) for r, w in zip(ranked, weights or (1.0,) * len(ranked))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score")), "query_id", "doc_id", k)


def pool(k: int) -> int:
    """How many hits of each system are fused for k results."""
    return max(3 * k, 30)


def snippet(body: Column, terms: Column, width: int = 8000, most: int = 3) -> Column:
    """The whole body if it is short, else windows around the first places of up to `most` distinct terms.

    Overlapping windows are one; clipped ends are marked. Without a hit, the head of the body.
    """
    flat = F.trim(F.translate(body, "\n", " "))
    low = F.lower(body)
    useful = F.filter(F.array_distinct(terms), lambda t: (F.length(t) > 2) & ~t.isin(*T.STOP_WORDS))
    places = F.array_sort(F.slice(F.filter(F.transform(useful, lambda t: F.position(t, low)), lambda p: p > 0), 1, most))
    span = F.greatest((F.lit(width) / F.greatest(F.size(places), F.lit(1))).cast("int"), F.lit(200))
    windows = F.transform(places, lambda p: F.struct(F.greatest(p - 1 - (span / 3).cast("int"), F.lit(0)).alias("a"), F.least(F.greatest(p - 1 - (span / 3).cast("int"), F.lit(0)) + span, F.length(body)).alias("b")))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda m: F.element_at(m, -1)
    merged = F.aggregate(
        windows,
        empty,
        lambda m, w: F.when((F.size(m) > 0) & (w["a"] <= F.try_element_at(m, F.lit(-1))["b"]), F.concat(F.slice(m, 1, F.size(m) - 1), F.array(F.struct(F.try_element_at(m, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(m, F.lit(-1))["b"], w["b"]).alias("b"))))).otherwise(F.concat(m, F.array(w))),
    )
    pieces = F.transform(merged, lambda w: F.trim(F.translate(F.substring(body, w["a"] + 1, w["b"] - w["a"]), "\n", " ")))
    joined = F.concat(F.when(F.element_at(merged, 1)["a"] > 0, "...").otherwise(""), F.array_join(pieces, " ... "), F.when(last(merged)["b"] < F.length(body), "...").otherwise(""))
    head = F.concat(F.trim(F.translate(F.substring(body, 1, width), "\n", " ")), F.lit("..."))
    return F.when(F.length(body) <= width, flat).when(F.size(places) == 0, head).otherwise(joined)


def hydrate(hits: DataFrame, docs: DataFrame, width: int = 8000, terms: Column | None = None) -> DataFrame:
    """Hits with title and snippet of their documents; late, so that ranking never carries texts."""
    title = F.substring_index("text", "\n", 1)
    found = hits.join(docs.select("doc_id", "source", "text"), "doc_id")
    return found.withColumn("title", title).withColumn("snippet", snippet(F.col("text"), terms if terms is not None else F.array().cast("array<string>"), width)).drop("text")


def recall_report(gold: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """question_type (ALL for all), k, questions, recall, hit_rate from gold (query_id, question_type, doc_id) and ranks."""
    hits = gold.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    cut = hits.crossJoin(F.broadcast(hits.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    each = cut.groupBy("query_id", "question_type", "k").agg(F.count("*").alias("gold"), F.count_if(F.col("rank") <= F.col("k")).alias("found"))
    out = each.rollup("k", "question_type").agg(F.count("*").alias("questions"), F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("recall"), F.round(F.sum("found") / F.sum("gold"), 6).alias("hit_rate"))
    return out.where("k IS NOT NULL").withColumn("question_type", F.coalesce("question_type", F.lit("ALL")))


def ranked_at(ks: tuple[int, ...], search: Callable[[int], DataFrame]) -> DataFrame:
    """k, query_id, doc_id of one search for each k: a fused search sizes its pool by k, so a cut of a longer one differs."""
    out = None
    for k in ks:
        one = search(k).select(F.lit(k).alias("k"), "query_id", "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


def recall_summary(gold: DataFrame, ranked: DataFrame, indexed: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """question_type (OVERALL for all), k, n, reachable, ceiling, recall, recall_reachable, hit_rate.

    gold: query_id, question_type, doc_id; ranked: as ranked_at gives it; indexed: doc_id of what can be found at all. A
    question is reachable if one of its documents is indexed; the ceiling is the share of those.
    """
    kind = F.coalesce("question_type", F.lit("unknown")).alias("question_type")
    held = gold.select("query_id", kind, "doc_id").distinct().join(indexed.select("doc_id").distinct().withColumn("held", F.lit(1)), "doc_id", "left")
    each = held.crossJoin(F.broadcast(gold.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    each = each.join(ranked.distinct().withColumn("hit", F.lit(1)), ["k", "query_id", "doc_id"], "left")
    asked = each.groupBy("query_id", "question_type", "k").agg(F.count("*").alias("gold"), F.count("hit").alias("found"), (F.count("held") > 0).alias("near"))
    hit = (F.col("found") > 0).cast("double")
    out = asked.rollup("k", "question_type").agg(
        F.grouping("question_type").alias("all"),
        F.count("*").alias("n"),
        F.count_if("near").alias("reachable"),
        F.round(F.avg(F.col("near").cast("double")), 6).alias("ceiling"),
        F.round(F.avg(hit), 6).alias("recall"),
        F.round(F.coalesce(F.avg(F.when(F.col("near"), hit)), F.lit(0.0)), 6).alias("recall_reachable"),
        F.round(F.sum("found") / F.sum("gold"), 6).alias("hit_rate"),
    )
    return out.where("k IS NOT NULL").withColumn("question_type", F.when(F.col("all") == 1, "OVERALL").otherwise(F.col("question_type"))).drop("all")
