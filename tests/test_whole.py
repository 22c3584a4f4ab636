import re
from collections import Counter

import duckdb
import numpy as np

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def run(spark, name, folder=SF):
    return entry.queries()[name](spark, str(folder)).collect()


def rows(table, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{table}.parquet' order by 1").fetchall()


def test_postings_of_every_source(spark):
    want = [(i, w, k) for i, text in rows("documents", "doc_id, text") for k, w in enumerate(re.findall(r"[^\W_]+", text.lower()))]
    assert sorted((r.doc_id, r.term, r.position) for r in run(spark, "tokens_postings")) == sorted(want)


def small(spark, folder):
    """A passage whose only known words come after its eighth, and the documents that have them."""
    far = "one two three four five six seven eight zebra giraffe"
    docs = [(1, "zebra giraffe here", "src0"), (2, "zebra alone", "src3"), (3, "giraffe elsewhere", "src5")] + [(10 + i, f"other text {i}", "src0") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, far)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_whole_passages_are_asked(spark, tmp_path):
    small(spark, tmp_path)
    got = run(spark, "bm25_topk", tmp_path)
    assert {r.doc_id for r in got} == {1, 2, 3} and min(got, key=lambda r: r["rank"]).doc_id == 1
    assert {r.doc_id for r in run(spark, "bm25_source_filtered", tmp_path)} == {1, 2}
    assert {r.doc_id for r in run(spark, "merged_hits", tmp_path)} == {1, 2, 3}
    assert "1" in run(spark, "grade_and_answer", tmp_path)[0].document_ids.split(",")
    report = {r.k: r.recall for r in run(spark, "recall_at_k") if r.question_type == "ALL"}
    assert report[20] >= report[6] > 0.9


def test_every_twentieth_vector_is_asked(spark):
    every = rows("embeddings", "vec_id, embedding, label")
    x = np.array([v for _, v, _ in every], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, labels = np.array([i for i, *_ in every]), np.array([label for *_, label in every])
    top, each = {}, {}
    for r in run(spark, "vector_topk_cosine"):
        top.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for r in run(spark, "vector_topk_per_label"):
        each.setdefault((r.query_id, r.label), {})[r["rank"]] = r.vec_id
    asked = ids[ids % 20 == 0]
    assert set(top) == set(asked) and set(each) == {(q, g) for q in asked for g in set(labels)}
    for q in asked:
        score = np.round(x @ x[ids == q][0], 6)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q]
        assert [top[q][k][0] for k in range(1, 11)] == ids[order[:10]].tolist()
        for g in set(labels):
            assert [each[q, g][k] for k in range(1, 4)] == [ids[i] for i in order if labels[i] == g][:3]


def test_passages_and_vectors_are_fused(spark):
    passages = {i for (i,) in rows("benchmark", "item_id")}
    asked = {i for (i,) in rows("embeddings", "vec_id") if i % 20 == 0}
    got = {}
    for r in run(spark, "hybrid_search_topk"):
        got.setdefault(r.query_id, set()).add(r.doc_id)
    top = {r.query_id: r.vec_id for r in run(spark, "vector_topk_cosine") if r["rank"] == 1}
    assert set(got) == passages | asked and all(len(got[q]) == 10 for q in asked)
    assert 20 in passages & set(top) and top[20] in got[20]


def test_every_node_has_its_facts(spark):
    edges = run(spark, "bitemporal_edges")
    want = {(n, e.edge_id) for e in edges if e.valid_to is None for n in (e.src, e.dst)}
    assert {(r.node, r.edge_id) for r in run(spark, "neighbors")} == want
    counts = Counter((n, e.rel) for e in edges if e.rel in ("purchase", "error") for n in (e.src, e.dst))
    assert Counter((r.node, r.rel) for r in run(spark, "facts_about")) == {x: min(5, n) for x, n in counts.items()}


def places(spark, folder):
    """One nation with two regions' worth of customers, half of them numbered from 300 on."""
    put = lambda name, made, kinds: spark.createDataFrame(made, kinds).write.parquet(f"{folder}/{name}.parquet")
    nations = [(k, k % 2 + 1) for k in range(4)]
    suppliers, customers = [(1, 1), (3, 2)], [(i, i % 4) for i in range(290, 310)]
    put("nation", nations, "n_nationkey int, n_regionkey int")
    put("supplier", suppliers, "s_suppkey long, s_nationkey int")
    put("customer", customers, "c_custkey long, c_nationkey int")
    return [(f"n{a}", f"r{b}") for a, b in nations] + [(f"s{a}", f"n{b}") for a, b in suppliers] + [(f"c{a}", f"n{b}") for a, b in customers]


def walks(edges, start, most):
    """Every simple path of up to `most` edges from a node, as its nodes and its edges."""
    at, out = [((start,), ())], []
    for _ in range(most):
        at = [((*ns, b), (*es, f"{x}>{y}")) for ns, es in at for x, y in edges for a, b in ((x, y), (y, x)) if a == ns[-1] and b not in ns]
        out += at
    return out


def test_graph_of_all_customers(spark, tmp_path):
    edges = places(spark, tmp_path)
    for name, start, k, by_end in (("paths_n_m", "s1", 10, True), ("paths_single_source", "s3", 25, False)):
        groups: dict = {}
        for ns, es in walks(edges, start, 3):
            if not by_end or ns[-1][0] == "n":
                groups.setdefault(ns[-1] if by_end else None, []).append((len(es), ",".join(es), "-".join(ns)))
        want = {x for g in groups.values() for x in sorted(g)[:k]}
        assert {(r.length, r.edges, r.nodes) for r in run(spark, name, tmp_path)} == want
    got = {(r.start, r.node): r.hops for r in run(spark, "reachable_1_3", tmp_path)}
    hops: dict = {}
    for start in ("s1", "r2"):
        for ns, es in walks(edges, start, 3):
            hops[start, ns[-1]] = min(len(es), hops.get((start, ns[-1]), 9))
    assert got == hops and ("s1", "c309") in got
    seeds = {"n1", "n2", "r1"}
    on_path = {e for s in seeds for ns, es in walks(edges, s, 2) if ns[-1] in seeds for e in es}
    want = {(a, b) for a, b in edges if (b[0] == "r" and {a, b} & seeds) or f"{a}>{b}" in on_path}
    assert {(r.src, r.dst) for r in run(spark, "subgraph", tmp_path)} == want


def test_mentions_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """8,000 parts in a small file; the names of their mentions have more than may be broadcast here."""
    parts = duckdb.sql(f"select i * 200 + p_partkey as p_partkey, p_name, p_size from '{SF}/part.parquet', range(40) t(i)")
    duckdb.sql(f"copy parts to '{tmp_path}/part.parquet'")
    duckdb.sql(f"create or replace temp view part as select * from '{tmp_path}/part.parquet'")
    want = duckdb.sql(f"select doc_id, src, rel, dst from ({entry.oracle_sql()['extract_issue_facts']})").fetchall()
    duckdb.sql("drop view part")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = run(spark, "extract_issue_facts", tmp_path)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert Counter(map(tuple, got)) == Counter(want) and len(got) == 80_000
