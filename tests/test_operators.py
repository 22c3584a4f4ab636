import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import agent, evaluation, extraction, graph, linkage, retrieval, temporal
from tessella.sources import documents as D

DAY = lambda n: dt.datetime(2024, 1, n)
NOW = lambda: F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def facts(spark, rows):
    return spark.createDataFrame([(s, r, d, t, src, doc, c, i) for i, (s, r, d, t, src, doc, c) in enumerate(rows)], "src string, rel string, dst string, stated_at timestamp_ntz, source string, doc_id string, confidence double, ord long")


def resolved(spark, rows, by_src=("MEMBER_OF",), by_dst=("OWNS",)):
    priority = spark.createDataFrame([("jira", 9), ("slack", 3)], "source string, priority int")
    out = temporal.resolve_conflicts(temporal.edges(facts(spark, rows), NOW()), priority, list(by_src), list(by_dst))
    return {(r.src, r.dst): r for r in out.collect()}


def test_repeated_assertions_are_one_edge(spark):
    got = temporal.edges(facts(spark, [("a", "MEMBER_OF", "t", DAY(2), "slack", "d2", 0.5), ("a", "MEMBER_OF", "t", DAY(1), "jira", "d1", 0.9), ("a", "MEMBER_OF", "t", DAY(3), "jira", "d2", 0.1)]), NOW()).collect()
    assert len(got) == 1 and got[0].docs == ["d2", "d1"] and got[0].stated_at == DAY(1) and got[0].confidence == 0.9 and got[0].source == "slack"


def test_newer_fact_ends_older(spark):
    got = resolved(spark, [("a", "MEMBER_OF", "t1", DAY(1), "slack", "d", 1.0), ("a", "MEMBER_OF", "t2", DAY(5), "slack", "d", 1.0)])
    assert got["a", "t1"].valid_to == DAY(5) and got["a", "t1"].superseded_by == got["a", "t2"].edge_id and got["a", "t2"].valid_to is None


def test_priority_beats_recency(spark):
    got = resolved(spark, [("a", "MEMBER_OF", "t1", DAY(1), "jira", "d", 1.0), ("a", "MEMBER_OF", "t2", DAY(5), "slack", "d", 1.0)])
    assert got["a", "t2"].valid_to == DAY(1) and got["a", "t1"].valid_to is None


def test_full_tie_is_no_conflict_and_top_tie_is_contested(spark):
    tie = [("a", "MEMBER_OF", f"t{i}", DAY(5), "slack", "d", 1.0) for i in (1, 2)]
    assert not any(r.contested or r.valid_to for r in resolved(spark, tie).values())
    got = resolved(spark, [*tie, ("a", "MEMBER_OF", "t3", DAY(1), "slack", "d", 1.0)])
    assert got["a", "t1"].contested and got["a", "t2"].contested and got["a", "t3"].valid_to == DAY(5)


def test_relations_with_many_counterparts_and_by_target(spark):
    assert all(r.valid_to is None for r in resolved(spark, [("a", "MENTIONS", f"x{i}", DAY(i), "slack", "d", 1.0) for i in (1, 2)]).values())
    got = resolved(spark, [("a", "OWNS", "p", DAY(1), "slack", "d", 1.0), ("b", "OWNS", "p", DAY(2), "slack", "d", 1.0)])
    assert got["a", "p"].valid_to == DAY(2) and got["b", "p"].valid_to is None


def test_as_of_is_half_open(spark):
    rows = [("a", "MEMBER_OF", "t1", DAY(1), "slack", "d", 1.0), ("a", "MEMBER_OF", "t2", DAY(5), "slack", "d", 1.0), ("a", "MEMBER_OF", "t0", None, "slack", "d", 1.0)]
    priority = spark.createDataFrame([("slack", 3)], "source string, priority int")
    edge = temporal.resolve_conflicts(temporal.edges(facts(spark, rows), NOW()), priority, ["MEMBER_OF"], [])
    at = lambda n: {r.dst for r in temporal.as_of(edge, F.lit(str(DAY(n))).cast("timestamp_ntz")).collect()}
    assert at(4) == {"t1", "t0"} and at(5) == {"t2"}
    assert {r.dst for r in temporal.current(edge).collect()} == {"t2"}


def test_phrases_need_adjacent_words(spark):
    docs = spark.createDataFrame([(1, "fix eng 30521 now", "a"), (2, "eng was 30521", "a"), (3, "other", "b"), (4, "more", "b"), (5, None, "b")], "doc_id long, text string, source string")
    ask = spark.createDataFrame([(1, "ENG-30521")], "query_id long, text string")
    assert [r.doc_id for r in retrieval.bm25(docs, ask, 5).collect()] == [1]
    assert retrieval.bm25(docs, ask, 5, ["b"]).count() == 0
    assert retrieval.bm25(docs, ask.where("false"), 5).count() == 0


def test_fusion_prefers_agreement(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in retrieval.fuse(a, b, k=3).orderBy("rank").collect()] == [11, 10, 12]


def test_snippets(spark):
    body = "x" * 500 + " needle " + "y" * 500 + " other " + "z" * 2000
    rows = spark.createDataFrame([(body, ["needle", "other"]), ("short\nbody", ["needle"]), (body, ["absent"])], "b string, t array<string>")
    long, short, head = (r[0] for r in rows.select(retrieval.snippet(F.col("b"), F.col("t"), 600)).collect())
    assert "needle" in long and "other" in long and long.startswith("...") and long.endswith("...") and len(long) < 700
    assert short == "short body" and head.startswith("xxx") and head.endswith("...")


def test_scores(spark):
    q = spark.createDataFrame([("1", "basic", ["a", "b"]), ("2", "basic", []), ("3", "info_not_found", []), ("4", "basic", ["c"])], "question_id string, question_type string, gold array<string>")
    a = spark.createDataFrame([("1", "x", ["a", "z", "a"]), ("2", "x", []), ("3", "I cannot answer that.", [])], "question_id string, answer string, cited array<string>")
    t = spark.createDataFrame([("1", False)], "question_id string, abstained boolean")
    got = {r.question_id: r for r in evaluation.score_each(q, a, t).collect()}
    assert (got["1"].recall, got["1"].precision, got["1"].extra) == (0.5, 0.5, 1)
    assert got["2"].recall == 0 and got["2"].precision is None and got["3"].abstained and got["3"].recall is None and not got["4"].answered
    totals = evaluation.score_totals(evaluation.score_each(q, a, t)).first()
    assert totals.abstention_accuracy == 1 and totals.false_confidence == 0 and totals.recall == 0.5


def test_quota_floor_and_cap(spark):
    take = lambda n, **c: {r.source: r["take"] for r in evaluation.quota(spark.createDataFrame(list(c.items()), "source string, size long"), n).collect()}
    assert take(10, a=50, b=50) == {"a": 5, "b": 5}
    assert take(3, a=1, b=1, c=1000) == {"a": 1, "b": 1, "c": 1}
    assert take(100, a=2, b=3) == {"a": 2, "b": 3}


def test_streak_trips_and_stays(spark):
    rows = spark.createDataFrame([(1, i, i in (2, 3, 5)) for i in range(1, 7)], "k int, i int, bad boolean")
    got = evaluation.streak(rows, ["k"], ["i"], F.col("bad"), 2).orderBy("i").collect()
    assert [r.streak for r in got] == [0, 1, 2, 0, 1, 0] and [r.tripped for r in got] == [False, False, True, True, True, True]


def test_bridges_and_guard(spark):
    people = linkage.person_frame(spark.createDataFrame([("1", "Mei Chen"), ("2", "mei.chen@x.com"), ("3", "Mei Park"), ("4", "mei")], "id string, s string"), "id", "s")
    assert {(r.id_l, r.id_r) for r in linkage.bridges(people).collect()} == {("1", "2")}
    pairs = spark.createDataFrame([("1", "4", 0.99), ("3", "4", 0.98), ("1", "2", 0.97)], "id_l string, id_r string, probability double")
    got = {r.id: r.cluster for r in linkage.guarded_clusters(pairs, people).collect()}
    assert got == {"1": "1", "4": "1", "2": "1", "3": "3"}
    assert linkage.surname_violations(linkage.guarded_clusters(pairs, people), people).count() == 0


PEOPLE = "id int, name_norm string, surname string, email_local string, handle_stem string"


def test_chance_and_prior_are_counts(spark):
    rows = [(1, "ann lee", "lee", "ann", None), (2, "ann lee", "lee", "ann", None), (3, "ann lee", "lee", None, "a"), (4, "bo ray", "ray", "ann", "a"), (5, None, None, None, None)]
    people = spark.createDataFrame(rows, PEOPLE)
    met = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    same = sum(a[1] == b[1] is not None or a[3] == b[3] is not None for a, b in met)
    assert linkage.expected_matches(people) == (len(met), same / 0.8) and linkage.coincidence(people, "handle_stem") == (1, 1)
    name, mail, handle = linkage.chance(people)
    assert abs(name[4] - 3.5 / 7) < 1e-12 and all(abs(x.sum() - 1) < 1e-12 for x in (name, mail, handle)) and abs(mail[1] - 3.5 / 4) < 1e-12


def test_probabilities_of_pairs(spark):
    first, last = ["ann", "bo", "cy", "dana", "eli", "fay", "gus", "hana", "ivo", "jo"], ["lee", "ray", "fox", "moreno"]
    rows, n = [], 0
    for i, (f, s) in enumerate((f, s) for f in first for s in last):
        for k in range(3):
            n += 1
            mail = f"{f}.{s}" if k < 2 else "info" if i % 2 else None
            rows.append((n, f"{f} {s}", s, mail, f"{f}{s[0]}" if k else None))
    people = spark.createDataFrame(rows, PEOPLE)
    got = {(r.id_l, r.id_r): r.probability for r in linkage.predicted_pairs(people, 0.0).collect()}
    own = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]}
    assert own <= set(got) and min(got[x] for x in own) > max(p for x, p in got.items() if x not in own)
    assert all(0 <= p <= 1 for p in got.values())
    # of one person: a handle that agrees counts for the pair, an address that differs against it
    assert got[2, 3] > got[1, 3] and got[5, 6] < got[2, 3]
    assert {(r.id_l, r.id_r) for r in linkage.predicted_pairs(people).collect()} == own


def test_without_evidence_rules_decide(spark):
    people = spark.createDataFrame([(1, "ann lee", None, "ann", None), (2, "bo ray", None, "ann", None)], PEOPLE)
    assert [tuple(r) for r in linkage.predicted_pairs(people).collect()] == [(1, 2, 1.0)]
    assert linkage.predicted_pairs(people.where("false")).count() == 0


def test_context_decides_between_candidates(spark):
    names = spark.createDataFrame([("g", "Ann"), ("g", "Bob"), ("g", "Cy")], "group string, name string")
    candidates = spark.createDataFrame([("Ann", 1), ("Ann", 2), ("Bob", 3), ("Cy", 4), ("Cy", 5)], "name string, id int")
    context = spark.createDataFrame([("g", 2)], "group string, id int")
    assert {(r.name, r.id) for r in linkage.disambiguated(names, candidates, context).collect()} == {("Ann", 2), ("Bob", 3)}


def test_paths_do_not_return(spark):
    edges = spark.createDataFrame([("a", "R", "b", "1"), ("b", "R", "c", "2"), ("c", "R", "a", "3"), ("a", "HAS_ALIAS", "x", "4")], "src string, rel string, dst string, edge_id string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = {tuple(r.nodes) for r in graph.paths(edges, node("a"), 3, node("c")).collect()}
    assert got == {("a", "c"), ("a", "b", "c")}
    assert {(r.node, r.hops) for r in graph.reachable(edges, node("a"), 9).collect()} == {("b", 1), ("c", 1)}


def test_answers(spark):
    hit = "array<struct<doc_id:string,title:string,snippet:string,score:double>>"
    rows = spark.createDataFrame([("1", "q", [("d", "T", "S", 1.0)], []), ("2", "q", [], []), ("3", "q", [("d", "T", "S", 1.0)], ["f1", "f2"])], f"question_id string, question string, hits {hit}, facts array<string>")
    got = {r.question_id: r for r in agent.answers(rows).collect()}
    assert got["1"].answer == "T: S" and got["2"].abstained and got["2"].confidence == 0 and got["3"].answer == "f1 f2" and got["3"].confidence == 0.85


def test_question_entities(spark):
    q = spark.createDataFrame([('Who fixed ENG-7 with Mei Chen in "blue room"?',)], "t string")
    assert q.select(agent.entities_of(F.col("t"))).first()[0] == ["ENG-7", "blue room", "ENG", "Mei Chen"]


MAIL = "Launch plan\nFrom: Ann Lee <ann@north.com>\nTo: Bob <bob@home.ai>, cy@west.org\nDate: Tue, 5 Mar 2024 09:08:07 -0800\nSubject: Launch\n\nSee ENG-12."
CHAT = "ops-room\njin: hello ENG-4\nSummary: all fine\nMaria R. (sales): ask @bob please\njin: done\ndeploy-bot: deployed"
ISSUE = "Login fails\nOwner: Ann Lee\nMei Chen (Support): fixed by PR #9, see SUP-2\nSteps (staging): none"


def files(spark):
    rows = [("a/gmail/1", "gmail", "d1", "launch", MAIL), ("a/slack/2", "slack", "d2", "ops", CHAT), ("a/jira/3", "jira", "d3", "ENG-1-login", ISSUE), ("a/hubspot/4", "hubspot", "d4", "acme", "Company Acme Labs\nDana (AE) signed"), ("a/github/5", "github", "d5", "pr-99-x", "Fix\nfixes ENG-5 and ENG-6"), ("a/other/6", "other", "d6", "x", "")]
    return spark.createDataFrame(rows, "path string, source_type string, doc_id string, slug string, content string")


def test_normalize_by_source(spark):
    got = {r.doc_id: r for r in D.normalize(files(spark)).collect()}
    assert got["d1"].title == "Launch plan" and got["d1"].timestamp == dt.datetime(2024, 3, 5, 9, 8, 7) and got["d1"].author_refs == ["Ann Lee", "ann@north.com"] and got["d1"].thread_id == "Launch"
    assert got["d1"].raw_metadata["cross_refs"] == "ENG-12"
    assert got["d2"].author_refs == ["jin", "Maria R.", "deploy-bot"] and "Summary" not in got["d2"].mention_refs and got["d2"].raw_metadata["teams"] == "sales"
    assert got["d3"].author_refs == ["Mei Chen"] and got["d6"].body == ""


def test_extraction_by_source(spark):
    found = extraction.assertions(D.normalize(files(spark)))
    got = {(r.doc_id, r.src, r.rel, r.dst) for r in found.collect()}
    want = {
        ("d1", "Ann Lee", "SENT", "Launch plan"), ("d1", "Ann Lee", "WORKS_FOR", "North"), ("d1", "Bob", "RECEIVED", "Launch plan"), ("d1", "cy@west.org", "WORKS_FOR", "West"),
        ("d2", "jin", "POSTED_IN", "ops-room"), ("d2", "Maria R.", "MEMBER_OF", "sales"), ("d2", "ops-room", "MENTIONS", "bob"),
        ("d3", "ENG-1", "PART_OF", "ENG"), ("d3", "Ann Lee", "OWNS", "ENG-1"), ("d3", "Mei Chen", "HAS_ROLE", "Support"), ("d3", "ENG-1", "RELATES_TO", "SUP-2"), ("d3", "Login fails", "REFERENCES", "PR#9"),
        ("d4", "Acme Labs", "CUSTOMER_OF", "home"), ("d4", "Dana", "WORKS_FOR", "Acme Labs"), ("d5", "PR#99", "RESOLVES", "ENG-5"), ("d5", "PR#99", "RELATES_TO", "ENG-6"),
    }
    assert want <= got, want - got
    assert not any(r[1] == "Steps" for r in got)
    types = {(r.surface_form, r.entity_type) for r in extraction.mentions(found).collect()}
    assert ("deploy-bot", "bot") in types and ("jin", "person") in types
    related, known = extraction.relations(found), extraction.mentions(found).select("mention_id").distinct()
    assert related.join(known, related.src_mention_id == known.mention_id, "left_anti").count() == 0


def test_documents_become_edges(spark):
    found = extraction.assertions(D.normalize(files(spark)))
    mentions = linkage.by_key(extraction.mentions(found).withColumnRenamed("surface_form", "surface"))
    lifted = temporal.lift(extraction.relations(found), mentions.select("mention_id", "canonical_id").distinct())
    edges = temporal.edges(lifted, NOW())
    assert edges.count() == lifted.select("src", "rel", "dst").distinct().count() > 15


def test_empty_tables(spark):
    none = files(spark).where("false")
    found = extraction.assertions(D.normalize(none))
    assert extraction.mentions(found).count() == extraction.relations(found).count() == 0


def test_chains_of_any_length_and_circles(spark):
    rows = [(f"e{i}", f"e{i + 1}") for i in range(40)] + [("e40", None), ("x", "y"), ("y", None)]
    edge = spark.createDataFrame(rows, "edge_id string, superseded_by string")
    got = {r.edge_id: (r.depth, r.final_edge) for r in temporal.chains(edge).collect()}
    assert got == {f"e{i}": (40 - i, "e40") for i in range(40)} | {"x": (1, "y")}
    with pytest.raises(ValueError):
        temporal.chains(spark.createDataFrame([("a", "b"), ("b", "a")], "edge_id string, superseded_by string"), 4)


def test_components_raise_when_rounds_run_out(spark):
    nodes = spark.createDataFrame([(i,) for i in range(200)], "id long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(199)], "id_l long, id_r long")
    assert {r.component for r in linkage.components(pairs, nodes).collect()} == {0}
    with pytest.raises(ValueError):
        linkage.components(pairs, nodes, 1)
