"""The property graph as DataFrames: nodes, aliases, edges, bounded paths and subgraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

# Entity types whose surfaces are aliases, and the labels of entity types.
ALIASED = ("person", "bot", "organization", "team", "role")
LABELS = {t: "".join(w.capitalize() for w in t.split("_")) for t in "person bot team role organization channel ticket project pull_request meeting document incident component product topic".split()}
#: Hops that a path may have at most.
MAX_HOPS = 3


def nodes(entities: DataFrame) -> DataFrame:
    """Node rows: label by entity type, a name (the id if there is none), its lower case, and a surrogate id. Unknown types go."""
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("entity_type")]
    name = F.coalesce(F.nullif(F.trim("canonical_name"), F.lit("")), F.col("canonical_id"))
    rows = entities.withColumn("label", label).where("label IS NOT NULL").withColumn("name", name)
    return rows.withColumn("name_lc", F.lower(F.trim("name"))).withColumn("node_id", T.surrogate_id(F.col("canonical_id")))


def aliases(entities: DataFrame) -> DataFrame:
    """canonical_id, kind, surface, surface_lc, alias_id: each surface of a kind once; the id is the owner's own."""
    kinds = {"name": "aliases", "handle": "handles", "email": "emails"}

    def of_kind(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda s: F.struct(F.lit(kind).alias("kind"), F.trim(s).alias("surface")))

    listed = [of_kind(k, c) for k, c in kinds.items() if c in entities.columns]
    flat = entities.where(F.col("entity_type").isin(*ALIASED)).select("canonical_id", F.inline(F.concat(*listed))).where("surface <> ''")
    once = flat.dropDuplicates(["canonical_id", "kind", "surface"]).withColumn("surface_lc", F.lower("surface"))
    return once.withColumn("alias_id", T.mint_id("al", F.col("canonical_id"), F.col("kind"), F.col("surface")))


def edge_rows(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose ends are nodes, with both labels and is_current: ready to be written by (src_label, rel, dst_label)."""
    known = nodes(entities).select("canonical_id", "label")
    src = known.select(F.col("canonical_id").alias("src"), F.col("label").alias("src_label"))
    dst = known.select(F.col("canonical_id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(src, "src").join(dst, "dst").withColumn("is_current", F.col("valid_to").isNull())


def write_graph(path: str, entities: DataFrame, edges: DataFrame) -> None:
    """nodes by label, aliases by kind and edges by relation, each overwritten as a whole."""
    nodes(entities).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    aliases(entities).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/aliases")
    edge_rows(edges, entities).write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "aliases", "edges")}


def collisions(rows: DataFrame, surrogate: str, key: str) -> DataFrame:
    """Surrogates that stand for more than one key; there must be none."""
    return rows.groupBy(surrogate).agg(F.count_distinct(key).alias("keys")).where("keys > 1")


def find_entity(nodes_: DataFrame, aliases_: DataFrame, names: DataFrame, types: list[str] | None = None) -> DataFrame:
    """name, canonical_id of the nodes that have a name (names.name) as alias or canonical name."""
    asked = names.select("name", F.lower(F.trim("name")).alias("key"))
    by_alias = asked.join(aliases_.select(F.col("surface_lc").alias("key"), "canonical_id"), "key")
    by_name = asked.join(nodes_.select(F.col("name_lc").alias("key"), "canonical_id"), "key")
    found = by_alias.unionByName(by_name).select("name", "canonical_id").distinct()
    return found.join(nodes_.where(F.col("entity_type").isin(types)).select("canonical_id"), "canonical_id", "left_semi") if types else found


def hydrate(nodes_: DataFrame, aliases_: DataFrame) -> DataFrame:
    """Nodes with their aliases by kind as sorted lists."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("surface")))).alias(n) for k, n in (("name", "names"), ("handle", "handles"), ("email", "emails"))]
    return nodes_.join(aliases_.groupBy("canonical_id").agg(*lists), "canonical_id", "left")


def both_ways(edges: DataFrame) -> DataFrame:
    """from, to, edge_id: every edge from either end, without alias links."""
    plain = edges.where("rel <> 'HAS_ALIAS'")
    there = plain.select(F.col("src").alias("from"), F.col("dst").alias("to"), "edge_id")
    return there.unionByName(plain.select(F.col("dst").alias("from"), F.col("src").alias("to"), "edge_id"))


def paths(edges: DataFrame, starts: DataFrame, hops: int, targets: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """start, end, length, nodes, edges of simple paths of one to three hops from starts (node), to targets (node) if given.

    k: so many paths for each start and end (each start without targets), the shortest first, then by edges. Each hop
    is one equi-join; visited nodes are not entered again. The last hop keeps only steps to a target.
    """
    steps = both_ways(edges)
    now = starts.select(F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    found = []
    for _ in range(max(1, min(hops, MAX_HOPS))):
        now = now.join(steps, F.col("end") == F.col("from")).where(~F.array_contains("nodes", F.col("to")))
        now = now.select("start", F.col("to").alias("end"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array(F.col("edge_id").cast("string"))).alias("edges"))
        found.append(now.join(targets.select(F.col("node").alias("end")), "end", "left_semi") if targets is not None else now)
    out = reduce(DataFrame.unionByName, found).withColumn("length", F.size("edges"))
    if k:
        part = ["start", "end"] if targets is not None else ["start"]
        order = Window.partitionBy(*part).orderBy("length", F.array_join("edges", ","))
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return out.select("start", "end", "length", "nodes", "edges")


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node, hops: the nodes that up to three hops reach and the fewest hops it takes. Each round keeps nodes once."""
    steps = both_ways(edges).select("from", "to").distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    for d in range(1, max(1, min(hops, MAX_HOPS)) + 1):
        next_ = seen.where(F.col("hops") == d - 1).join(steps, F.col("node") == F.col("from")).select("start", F.col("to").alias("node"), F.lit(d).alias("hops"))
        seen = seen.unionByName(next_).groupBy("start", "node").agg(F.min("hops").alias("hops"))
    return seen.where("hops > 0")


def subgraph(edges: DataFrame, seeds: DataFrame, rels: list[str]) -> DataFrame:
    """Edges of the given relations that touch a seed (node), or lie on a path of two hops between two seeds."""
    touched = edges.where(F.col("rel").isin(rels))
    near = touched.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").unionByName(touched.join(seeds.select(F.col("node").alias("dst")), "dst", "left_semi"))
    on_path = paths(edges, seeds, 2, seeds).select(F.explode("edges").alias("_edge")).distinct()
    between = edges.join(on_path, F.col("edge_id").cast("string") == F.col("_edge"), "left_semi")
    return near.unionByName(between).dropDuplicates(["edge_id"])


def within(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes (node)."""
    return edges.join(nodes_.select(F.col("node").alias("src")), "src", "left_semi").join(nodes_.select(F.col("node").alias("dst")), "dst", "left_semi")


def citations(steps: Column) -> Column:
    """The documents of a path's steps (array of arrays), each once, in order."""
    return F.array_distinct(F.flatten(steps))


def stats(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))
