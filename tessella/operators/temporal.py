"""Bi-temporal facts: lifting assertions to edges, conflicts, and current and as-of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import linkage


def lift(relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Relations between mentions as relations between entities; unresolved ends and loops go."""
    src = clusters.select(F.col("mention_id").alias("src_mention_id"), F.col("canonical_id").alias("src"))
    dst = clusters.select(F.col("mention_id").alias("dst_mention_id"), F.col("canonical_id").alias("dst"))
    return relations.join(src, "src_mention_id").join(dst, "dst_mention_id").where("src <> dst")


def edges(assertions: DataFrame, ingested_at: Column) -> DataFrame:
    """One edge for each (src, rel, dst) of assertions (src, rel, dst, stated_at, source, doc_id, confidence, ord).

    stated_at is the earliest, confidence the greatest, source that of the first by ord, docs distinct in order of ord.
    """
    docs = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc_id"))), lambda x: x["doc_id"]))
    one = assertions.groupBy("src", "rel", "dst").agg(F.min("stated_at").alias("stated_at"), F.max("confidence").alias("confidence"), F.min_by("source", "ord").alias("source"), F.min("ord").alias("ord"), docs.alias("docs"))
    return one.withColumn("edge_id", T.mint_id("e", F.col("src"), F.col("rel"), F.col("dst"))).withColumn("ingested_at", ingested_at).withColumn("valid_from", F.col("stated_at"))


def resolve_conflicts(edge: DataFrame, priority: DataFrame, by_src: list[str], by_dst: list[str]) -> DataFrame:
    """Edges with valid_to, superseded_by and contested.

    Relations in by_src hold one counterpart for each src, those in by_dst one for each dst; others never conflict. In
    a group with two counterparts or more the greatest (priority of source, stated_at) wins and every lower edge ends
    when the winner was stated; several at the top are contested and stay. If all are at the top nothing changes.
    """
    anchor = F.when(F.col("rel").isin(by_src), F.col("src")).when(F.col("rel").isin(by_dst), F.col("dst"))
    other = F.when(F.col("rel").isin(by_src), F.col("dst")).otherwise(F.col("src"))
    free = edge.where(anchor.isNull()).withColumns({"valid_to": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string"), "contested": F.lit(False)})
    ranked = edge.where(anchor.isNotNull()).join(priority, "source", "left").withColumn("anchor", anchor).withColumn("other", other).withColumn("priority", F.coalesce("priority", F.lit(0)))
    group = Window.partitionBy("anchor", "rel")
    key = F.struct("priority", F.coalesce("stated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"))
    top = F.max(key).over(group)
    several = F.min("other").over(group) < F.max("other").over(group)
    marked = ranked.withColumn("_key", key).withColumn("_top", top).withColumn("_several", several)
    marked = marked.withColumn("_is_top", F.col("_key") == F.col("_top"))
    conflict = F.col("_several") & (F.count_if(~F.col("_is_top")).over(group) > 0)
    winner = F.min(F.when(F.col("_is_top"), F.struct("ord", "edge_id", F.coalesce("stated_at", "ingested_at").alias("until")))).over(group)
    marked = marked.withColumn("_conflict", conflict).withColumn("_winner", winner).withColumn("_tops", F.count_if(F.col("_is_top")).over(group))
    lost = F.col("_conflict") & ~F.col("_is_top")
    out = marked.withColumn("valid_to", F.when(lost, F.col("_winner.until"))).withColumn("superseded_by", F.when(lost, F.col("_winner.edge_id")))
    out = out.withColumn("contested", F.col("_conflict") & F.col("_is_top") & (F.col("_tops") > 1))
    out = out.drop("_key", "_top", "_several", "_is_top", "_conflict", "_winner", "_tops", "anchor", "other", "priority")
    return out.unionByName(free)


def chains(edge: DataFrame, rounds: int = 32) -> DataFrame:
    """edge_id, depth, final_edge of every superseded edge (edge_id, superseded_by): the edge at the end of its chain.

    Each round doubles the steps that are known, so 32 rounds walk chains of any length; one that still has somewhere
    to go is a circle and raises.
    """
    now = edge.where("superseded_by IS NOT NULL").select("edge_id", F.col("superseded_by").alias("final_edge"), F.lit(1).cast("long").alias("depth"))
    for _ in range(rounds):
        ahead = now.select(F.col("edge_id").alias("final_edge"), F.col("final_edge").alias("further"), F.col("depth").alias("more"))
        now = linkage.kept(now.join(ahead, "final_edge", "left").select("edge_id", F.coalesce("further", "final_edge").alias("final_edge"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if now.join(edge.where("superseded_by IS NOT NULL").select(F.col("edge_id").alias("final_edge")), "final_edge", "left_semi").isEmpty():
            return now
    raise ValueError("a chain of superseded edges is a circle")


def current(edge: DataFrame) -> DataFrame:
    return edge.where("valid_to IS NULL")


def as_of(edge: DataFrame, at: Column) -> DataFrame:
    """Edges that held at a time: from valid_from on, before valid_to; an unknown start always holds."""
    return edge.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def touching(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the edges that start or end there, each once: two equi-joins, never an OR."""
    out = nodes.select(F.col("node").alias("src"), "node").join(edge, "src")
    into = nodes.select(F.col("node").alias("dst"), "node").join(edge, "dst")
    return out.unionByName(into).dropDuplicates(["node", "edge_id"])


def facts_about(edge: DataFrame, nodes: DataFrame, rels: list[str], k: int) -> DataFrame:
    """The first k facts of each node and relation: current ones, then the newest."""
    order = Window.partitionBy("node", "rel").orderBy(F.col("valid_to").isNotNull(), F.desc_nulls_last("stated_at"), "edge_id")
    return touching(edge.where(F.col("rel").isin(rels)), nodes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def conflict_pairs(edge: DataFrame, k: int) -> DataFrame:
    """Each superseded edge beside the first current edge of its src and relation, k of them for each src."""
    first = Window.partitionBy("src", "rel").orderBy(F.desc_nulls_last("stated_at"), "edge_id")
    now = current(edge).withColumn("n", F.row_number().over(first)).where("n = 1").select("src", "rel", F.col("edge_id").alias("current_edge"), F.col("dst").alias("current_dst"))
    old = edge.where("valid_to IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("stated_at"), "edge_id"))).where(F.col("rank") <= k)
    return old.join(now, ["src", "rel"], "left")


def fact_line(edge_name: Column, src: Column, dst: Column, valid_to: Column, contested: Column, source: Column) -> Column:
    """A fact in words."""
    state = F.when(valid_to.isNotNull(), F.concat(F.lit("until "), F.date_format(valid_to, "yyyy-MM-dd"))).when(contested, F.lit("CONTESTED")).otherwise(F.lit("current"))
    return F.concat(src, F.lit(" "), F.lower(F.translate(edge_name, "_", " ")), F.lit(" "), dst, F.lit(" ["), state, F.lit("; "), source, F.lit("]"))
