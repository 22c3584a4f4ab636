"""One object over the tables of a built corpus: build it from files or documents, then ask it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import ontology
from tessella.functions import text as T
from tessella.operators import agent, extraction, graph, linkage, retrieval, service, temporal
from tessella.sources import documents as sources

#: Relations whose facts answer a question about an entity.
FACTS = ["MEMBER_OF", "WORKS_FOR", "HAS_ROLE", "OWNS", "REPORTS_TO", "ASSIGNED_TO"]


def linked(mentions: DataFrame, scored: bool = False) -> DataFrame:
    """mention_id, canonical_id of the mentions: people and bots by keys (or, scored, by learned probabilities), bridges
    and the surname guard, other types by key."""
    people = mentions.where("entity_type IN ('person', 'bot')").groupBy("mention_id").agg(F.min("surface_form").alias("surface"))
    frame = linkage.person_frame(people, "mention_id", "surface")
    sure = (linkage.predicted_pairs(frame) if scored else linkage.deterministic_pairs(frame)).unionByName(linkage.bridges(frame).withColumn("probability", F.lit(linkage.MERGE)))
    pairs = sure.groupBy("id_l", "id_r").agg(F.max("probability").alias("probability")).where(F.col("probability") >= linkage.MERGE)
    grouped = linkage.guarded_clusters(pairs, frame).select(F.col("id").alias("mention_id"), T.mint_id("c", F.lit("person"), F.col("cluster")).alias("canonical_id"))
    keyed = linkage.by_key(mentions.where(F.col("entity_type").isin(*ontology.BY_KEY)).withColumnRenamed("surface_form", "surface"))
    return grouped.unionByName(keyed.select("mention_id", "canonical_id")).distinct()


def entities_of(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Canonical entities with their aliases, handles and addresses."""
    rows = mentions.join(clusters, "mention_id").select(F.col("canonical_id").alias("cluster"), "entity_type", F.col("surface_form").alias("surface"), F.col("source_type").alias("source"), "ord")
    made = linkage.canonical_entities(rows).drop("canonical_id").withColumnRenamed("cluster", "canonical_id")
    return made.withColumn("handles", F.filter("aliases", lambda a: a.rlike(r"^[a-z][\w.\-]{1,30}$")))


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id, source, text (title and body): what is searched."""
    return documents.select("doc_id", F.col("source_type").alias("source"), F.concat_ws("\n", "title", "body").alias("text"))


class Engine:
    """documents, entities, aliases and edges of a corpus, and the questions that can be put to them.

    With an encoder of lists of texts, searches fuse keyword hits with those of vectors; without one they have keywords only.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, entities: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, encoder: Callable[[list[str]], np.ndarray] | None = None, index: retrieval.Index | None = None):
        self.spark, self.documents, self.edges = spark, documents, edges
        self.vectors, self.encoder, self.index = vectors, encoder, index
        self.entities = entities
        self.nodes, self.aliases = graph.nodes(entities), graph.aliases(entities)
        self.texts = texts_of(documents)

    @classmethod
    def build(cls, spark: SparkSession, documents: DataFrame, ingested_at: Column, path: str | None = None, encoder: Callable[[list[str]], np.ndarray] | None = None, scored: bool = False) -> Engine:
        """From normalized documents; scored: people are linked by learned probabilities. With a path every table is written there and read back, stage by stage."""

        def kept(df: DataFrame, name: str) -> DataFrame:
            if path is None:
                return df
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        docs = kept(documents, "documents")
        found = kept(extraction.assertions(docs), "assertions")
        mentions = ontology.known(extraction.mentions(found), "entity_type")
        clusters = kept(linked(mentions, scored), "clusters")
        entities = kept(entities_of(mentions, clusters), "entities")
        lifted = temporal.lift(ontology.known(extraction.relations(found), "rel"), clusters)
        edges = temporal.resolve_conflicts(temporal.edges(lifted, ingested_at), F.broadcast(ontology.priorities(spark)), list(ontology.ONE_FOR_EACH_SOURCE), list(ontology.ONE_FOR_EACH_TARGET))
        vectors = kept(retrieval.embed(docs, encoder), "vectors") if encoder else None
        index = retrieval.write_index(texts_of(docs), f"{path}/index") if path is not None else None
        return cls(spark, docs, entities, kept(edges, "edges"), vectors, encoder, index)

    @classmethod
    def open(cls, spark: SparkSession, path: str, encoder: Callable[[list[str]], np.ndarray] | None = None) -> Engine:
        """From the tables that build has written to path; with the encoder that it was built with, if any."""
        docs, entities, edges = (spark.read.parquet(f"{path}/{name}") for name in ("documents", "entities", "edges"))
        vectors = spark.read.parquet(f"{path}/vectors") if encoder else None
        return cls(spark, docs, entities, edges, vectors, encoder, retrieval.read_index(spark, f"{path}/index"))

    @classmethod
    def from_files(cls, spark: SparkSession, roots: list[str], ingested_at: Column, path: str | None = None, encoder: Callable[[list[str]], np.ndarray] | None = None) -> Engine:
        return cls.build(spark, sources.normalize(sources.read_files(spark, roots)), ingested_at, path, encoder)

    def _node(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "node string")

    def _keywords(self, asked: DataFrame, k: int, kinds: list[str] | None) -> DataFrame:
        return retrieval.bm25_stored(self.index, asked, k, kinds) if self.index else retrieval.bm25(self.texts, asked, k, kinds)

    def _hits(self, asked: DataFrame, k: int, kinds: list[str] | None = None) -> DataFrame:
        """query_id, doc_id, score, rank for asked (query_id, text): by keywords, or fused with the nearest vectors."""
        if self.encoder is None:
            return self._keywords(asked, k, kinds)
        pool, held = retrieval.pool(k), self.vectors.withColumnRenamed("doc_id", "vec_id")
        if kinds is not None:
            held = held.join(self.texts.where(F.col("source").isin(kinds)).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        shaped = asked.select(F.col("query_id").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
        meant = retrieval.embed(shaped, self.encoder).withColumnRenamed("doc_id", "query_id")
        near = retrieval.cosine_top_blocked(held, meant, pool).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
        return retrieval.fuse(self._keywords(asked, pool, kinds), near, k=k)

    def search(self, question: str, k: int = 12, kinds: list[str] | None = None, width: int = 8000) -> DataFrame:
        """The best documents with title, snippet, score and rank."""
        asked = self.spark.createDataFrame([(1, question)], "query_id long, text string")
        hits = self._hits(asked, k, kinds)
        return retrieval.hydrate(hits, self.texts, width, T.query_terms(F.lit(question))).drop("query_id").orderBy("rank")

    def docs(self, ids: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(1, ids)], "query_id long, ids array<string>")
        return service.in_order(asked, self.documents).drop("query_id").orderBy("position")

    def find_entity(self, name: str, types: list[str] | None = None) -> DataFrame:
        found = graph.find_entity(self.nodes, self.aliases, self.spark.createDataFrame([(name,)], "name string"), types)
        return found.join(self.nodes.select("canonical_id", "entity_type", F.col("name").alias("canonical_name")), "canonical_id").drop("name")

    def entity(self, canonical_id: str) -> DataFrame:
        return graph.hydrate(self.nodes.where(F.col("canonical_id") == canonical_id).drop("aliases", "handles", "emails"), self.aliases)

    def neighbors(self, canonical_id: str, at: Column | None = None, everything: bool = False) -> DataFrame:
        """Edges at an entity: current ones, those of a time, or all."""
        held = self.edges if everything else temporal.as_of(self.edges, at) if at is not None else temporal.current(self.edges)
        return temporal.touching(held, self._node(canonical_id)).drop("node")

    def facts_about(self, canonical_id: str, rels: list[str] | None = None, k: int = 50) -> DataFrame:
        return temporal.facts_about(self.edges, self._node(canonical_id), rels or FACTS, k).orderBy("rel", "rank")

    def paths(self, src: str, dst: str | None = None, hops: int = 3) -> DataFrame:
        """Up to ten shortest paths between two entities, or 25 from one."""
        return graph.paths(self.edges, self._node(src), hops, self._node(dst) if dst else None, 10 if dst else 25).orderBy("length")

    def subgraph(self, ids: list[str], rels: list[str] | None = None) -> DataFrame:
        return graph.subgraph(self.edges, self._node(*ids), rels or FACTS)

    def stats(self) -> DataFrame:
        """Entities of each label and edges of each relation."""
        a, b = graph.stats(self.nodes, "label"), graph.stats(self.edges, "rel")
        return a.select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n").unionByName(b.select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), "n"))

    def verify(self) -> None:
        """Raise if surrogate ids collide or an edge's end is no entity."""
        if graph.collisions(self.nodes, "node_id", "canonical_id").limit(1).count():
            raise ValueError("surrogate ids collide")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("canonical_id"))
        if ends.join(self.nodes, "canonical_id", "left_anti").limit(1).count():
            raise ValueError("an edge's end is no entity")

    def sql(self, query: str) -> DataFrame:
        """Any SQL over documents, entities, aliases and edges."""
        for name in ("documents", "entities", "aliases", "edges"):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def _facts(self, questions: DataFrame) -> DataFrame:
        """question_id, facts, path_docs: lines about the entities that questions name, and of paths between the first two in
        a multihop question, with the documents behind the paths."""
        named = questions.select("question_id", F.posexplode(agent.entities_of(F.col("question"))).alias("at", "name"))
        met = named.join(graph.find_entity(self.nodes, self.aliases, named.select("name").distinct()), "name").groupBy("question_id", F.col("canonical_id").alias("node")).agg(F.min("at").alias("at"))
        route = questions.select("question_id", agent.route(F.col("question")).alias("route"))
        facts = temporal.facts_about(self.edges, met.select("node").distinct(), FACTS, 20).join(met, "node").join(route.where("route <> 'multihop'"), "question_id")
        first = met.join(route.where("route = 'multihop'"), "question_id").groupBy("question_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "node"))), 1, 2).alias("two")).where(F.size("two") == 2)
        ends = first.select("question_id", F.col("two")[0]["node"].alias("start"), F.col("two")[1]["node"].alias("end"))
        found = graph.paths(self.edges, ends.select(F.col("start").alias("node")).distinct(), 3, ends.select(F.col("end").alias("node")).distinct(), 5).join(ends, ["start", "end"])
        steps = found.select("question_id", F.posexplode("edges").alias("at", "edge_id")).join(self.edges, "edge_id")
        names = self.nodes.select("canonical_id", "name")
        columns = ["question_id", "at", "edge_id", "src", "rel", "dst", "valid_to", "contested", "source"]
        every = facts.select(*columns).unionByName(steps.select(*columns))
        every = every.join(names.select(F.col("canonical_id").alias("src"), F.col("name").alias("src_name")), "src", "left").join(names.select(F.col("canonical_id").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
        line = temporal.fact_line(F.col("rel"), F.coalesce("src_name", "src"), F.coalesce("dst_name", "dst"), F.col("valid_to"), F.col("contested"), F.col("source"))
        listed = every.withColumn("line", line).groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct(F.col("valid_to").isNotNull().alias("past"), "at", "line"))).alias("l"))
        behind = steps.select("question_id", F.explode("docs").alias("doc_id")).groupBy("question_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("path_docs"))
        return listed.select("question_id", F.array_distinct(F.transform("l", lambda x: x["line"])).alias("facts")).join(behind, "question_id", "left")

    def answer(self, questions: DataFrame) -> DataFrame:
        """question_id, answer, document_ids, abstained, confidence, route for questions (question_id, question), all at once.

        Questions that find nothing are searched once more, wider, by the words that may name something. Documents behind
        the paths of a multihop question follow its hits.
        """
        numbered = questions.select("question_id", "question", F.xxhash64("question_id").alias("query_id"))
        first = self._hits(numbered.select("query_id", F.col("question").alias("text")), agent.K)
        missed = numbered.join(first.select("query_id"), "query_id", "left_anti")
        second = self._hits(missed.select("query_id", F.array_join(agent.fallback_names(F.col("question")), " ").alias("text")), agent.WIDER_K)
        hits = retrieval.hydrate(agent.merge_hits(first, second), self.texts, 300)
        listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "title", "snippet", "score"))).alias("l"))
        shaped = listed.select("query_id", F.transform("l", lambda h: F.struct(h["doc_id"].alias("doc_id"), h["title"].alias("title"), h["snippet"].alias("snippet"), h["score"].alias("score"))).alias("hits"))
        none = F.array().cast("array<struct<doc_id:string,title:string,snippet:string,score:double>>")
        gathered = numbered.join(shaped, "query_id", "left").join(self._facts(questions), "question_id", "left")
        hits = agent.with_path_documents(F.coalesce("hits", none), F.coalesce("path_docs", F.array().cast("array<string>")))
        return agent.answers(gathered.select("question_id", "question", hits.alias("hits"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts")))
