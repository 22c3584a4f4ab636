import json

import pytest
from pyspark.sql import functions as F

from tessella import ontology
from tessella.engine import Engine
from tessella.operators import agent, completion, graph, retrieval, service
from tessella.sources import documents as D
from tessella.sources import products as P
from tests.test_operators import NOW, files

ID = "dsid_" + "0123456789abcdef" * 2


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine.build(spark, D.normalize(files(spark)), NOW(), f"file://{tmp_path_factory.mktemp('corpus')}")
    made.verify()
    return made


def test_search_and_documents(engine):
    assert [r.doc_id for r in engine.search("what about ENG-12", 3).collect()] == ["d1"]
    assert engine.search("signed", 3, ["slack"]).count() == 0
    assert [r.doc_id for r in engine.docs(["d3", "nope", "d1"]).collect()] == ["d3", "d1"]


def test_entities_and_facts(engine):
    ann = engine.find_entity("ann lee").collect()
    assert len(ann) == 1 and ann[0].entity_type == "person"
    full = engine.entity(ann[0].canonical_id).first()
    assert full.names == ["Ann Lee"]
    facts = {(r.rel, r.source) for r in engine.facts_about(ann[0].canonical_id).collect()}
    assert facts == {("WORKS_FOR", "gmail"), ("OWNS", "jira")}
    assert engine.neighbors(ann[0].canonical_id).count() == 3 and engine.neighbors(ann[0].canonical_id, F.lit("2020-01-01").cast("timestamp_ntz")).count() == 1
    ticket = engine.find_entity("ENG-1", ["ticket"]).first().canonical_id
    assert engine.paths(ann[0].canonical_id, ticket).first().length == 1
    assert engine.subgraph([ticket]).count() >= 1 and engine.stats().where("kind = 'edge' AND name = 'OWNS'").first().n == 1


def test_sql_and_answers(engine, spark):
    assert engine.sql("SELECT count(*) AS n FROM edges JOIN entities ON src = canonical_id").first().n == engine.edges.count()
    asked = spark.createDataFrame([("1", "Who owns ENG-1 and what does Ann Lee do?"), ("2", "zzzz qqqq"), ("3", "What is the connection between Ann Lee and Mei Chen?")], "question_id string, question string")
    got = {r.question_id: r for r in engine.answer(asked).collect()}
    assert not got["1"].abstained and "Ann Lee" in got["1"].answer and got["1"].confidence == 0.85 and got["2"].abstained and got["3"].route == "multihop"


def test_files_are_found_once(spark, tmp_path):
    for root, text in (("new", "Newer\nbody"), ("old", "Older\nbody")):
        folder = tmp_path / root / "confluence"
        folder.mkdir(parents=True)
        (folder / f"{ID}__page-one.txt").write_text(text)
        (folder / "notes.txt").write_text("left out")
    got = D.normalize(D.read_files(spark, [str(tmp_path / "new"), str(tmp_path / "old")])).collect()
    assert len(got) == 1 and got[0].title == "Newer" and got[0].source_type == "confluence" and got[0].raw_metadata["slug"] == "page-one"


def test_tables_round_trip(spark, tmp_path, engine):
    path = f"file://{tmp_path}/docs"
    docs = D.normalize(files(spark))
    D.write_documents(docs, path)
    assert D.read_documents(spark, path).count() == 6 and D.read_documents(spark, path).where("source_type = 'jira'").count() == 1
    graph.write_graph(f"file://{tmp_path}/graph", engine.entities, engine.edges)
    back = graph.read_graph(spark, f"file://{tmp_path}/graph")
    assert back["edges"].count() == engine.edges.count() and back["nodes"].count() == engine.nodes.count()


def test_lines_are_appended_once(spark, tmp_path):
    rows, path = spark.createDataFrame([("1", "a"), ("2", "b")], "question_id string, answer string"), f"{tmp_path}/answers"
    for part in (rows.where("question_id = '1'"), rows):
        D.append_jsonl(part, path, "question_id", "question_id string, answer string")
    assert sorted(r.answer for r in D.read_jsonl(spark, path, "question_id string, answer string").collect()) == ["a", "b"]


def test_vocabulary(spark):
    rows = spark.createDataFrame([("person",), ("planet",), (None,)], "entity_type string")
    assert ontology.known(rows, "entity_type").count() == 1
    with pytest.raises(Exception, match="unknown entity_type"):
        ontology.known(rows, "entity_type", strict=True).collect()
    assert ontology.relation_types(spark).count() == 22 and ontology.node_types(spark).count() == 16


def test_json_shapes(spark, engine):
    edge = json.loads(service.edge_json(engine.edges.where("rel = 'OWNS'")).first().json)
    assert edge["is_current"] is True and edge["valid_to"] is None and edge["docs"] == ["d3"]
    line = json.loads(service.answer_line(spark.createDataFrame([("1", "x", ["d"], False)], "question_id string, answer string, document_ids array<string>, abstained boolean")).first().line)
    assert line == {"question_id": "1", "answer": "x", "document_ids": ["d"], "abstained": False}
    trace = spark.createDataFrame([("1", "multihop", ["d"], [(["e1", "e2"], [["d1"], ["d2", "d1"]])], "", 0)], "question_id string, route string, retrieved array<string>, paths array<struct<edges:array<string>,docs:array<array<string>>>>, reason string, retries int")
    assert service.flat_trace(trace).first().paths[0].asDict() == {"length": 2, "doc_ids": ["d1", "d2"]}
    shown = spark.createDataFrame([([], ["a", "b"]), (["c"], ["a"])], "c array<string>, r array<string>")
    assert [r[0] for r in shown.select(service.cited_or_retrieved(F.col("c"), F.col("r"), 1)).collect()] == [["a"], ["c"]]


def test_teams_from_nested_records(spark, tmp_path):
    record = {"product": "p", "slack": [{"Message": {"User": {"userId": "eid_1"}, "text": "ask eid_2"}}], "meeting_transcripts": [{"transcript": "Attendees: Ann Lee\nTranscript\nBob Ray: hi\nCy Fox: no"}], "prs": [], "team": ["eid_1", "eid_2", "eid_3"]}
    (tmp_path / "p.json").write_text(json.dumps(record, indent=1))
    products = P.read_products(spark, str(tmp_path))
    employees = spark.createDataFrame([("eid_1", "Ann Lee"), ("eid_3", "Bob Ray"), ("eid_4", "Cy Fox"), ("eid_5", "Cy Fox")], "id string, name string")
    assert P.teams(products, employees).first().found == ["eid_1", "eid_2", "eid_3"]
    assert tuple(P.team_scores(products, employees).first())[1:] == (1.0, 1.0, 1.0)


def test_a_built_corpus_is_opened_and_searched_by_its_index(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    made = Engine.build(spark, D.normalize(files(spark)), NOW(), path)
    again, plain = Engine.open(spark, path), Engine(spark, made.documents, made.entities, made.edges)
    for question in ("Who owns the release of Runtime?", "the of", "", "nothingofthekind"):
        for kinds in (None, ["jira"], []):
            want = [tuple(r) for r in plain.search(question, kinds=kinds).collect()]
            assert [tuple(r) for r in again.search(question, kinds=kinds).collect()] == want
    assert again.stats().count() == made.stats().count()


def test_an_index_is_searched_by_filter_and_by_join(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "new york new york"), (2, "b", "york"), (3, "a", ""), (4, None, None), (5, "b", "new")], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(1, "new york"), (2, "york-new"), (3, "")], "query_id long, text string")
    index = retrieval.write_index(docs, f"file://{tmp_path}/index")
    want = sorted(map(tuple, retrieval.bm25(docs, asked, 5).collect()))
    assert want and sorted(map(tuple, retrieval.bm25_stored(index, asked, 5).collect())) == want
    monkeypatch.setattr(retrieval, "PUSHED_TERMS", 0)
    assert sorted(map(tuple, retrieval.bm25_stored(index, asked, 5).collect())) == want


def test_search_with_vectors(spark, engine, tmp_path):
    made = Engine.build(spark, D.normalize(files(spark)), NOW(), f"file://{tmp_path}/corpus", retrieval.hashed)
    assert made.vectors.count() == 6
    hits = made.search("what about ENG-12", 6).collect()
    assert hits[0].doc_id == "d1" and [h.rank for h in hits] == list(range(1, len(hits) + 1)) and len(hits) > len(engine.search("what about ENG-12", 6).collect())
    assert {r.doc_id for r in made.search("signed", 3, ["slack"]).collect()} == {"d2"}
    assert made.search("", 3).count() == 0


def test_people_linked_by_learned_probabilities(spark, tmp_path):
    made = Engine.build(spark, D.normalize(files(spark)), NOW(), f"file://{tmp_path}/corpus", scored=True)
    made.verify()
    assert [r.entity_type for r in made.find_entity("ann lee").collect()] == ["person"]


def test_vector_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("n", None)], "vec_id string, vector array<float>")
    asked = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vector array<float>")
    assert [r.vec_id for r in retrieval.cosine_top_blocked(rows, asked, 3).orderBy("rank").collect()] == ["c", "b"]
    other = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.query_id, r.vec_id) for r in retrieval.cosine_top_blocked(rows, other, 2).orderBy("rank").collect()] == [(7, "a"), (7, "c")]


def test_path_documents_follow_hits(spark):
    row = spark.createDataFrame([([("d1", "T", "S", 1.0)], ["d2", "d1"])], "h array<struct<doc_id:string,title:string,snippet:string,score:double>>, p array<string>")
    got = row.select(agent.with_path_documents(F.col("h"), F.col("p"))).first()[0]
    assert [(h.doc_id, h.score) for h in got] == [("d1", 1.0), ("d2", 0.0)]


def test_recall_among_what_can_be_found(spark):
    gold = spark.createDataFrame([(1, "basic", "a"), (1, "basic", "b"), (2, "basic", "x"), (3, None, "c")], "query_id long, question_type string, doc_id string")
    ranks = {1: [(1, "z"), (3, "c")], 2: [(1, "a"), (2, "a"), (3, "c")]}
    ranked = retrieval.ranked_at((1, 2), lambda k: spark.createDataFrame(ranks[k], "query_id long, doc_id string"))
    got = {(r.question_type, r.k): r for r in retrieval.recall_summary(gold, ranked, spark.createDataFrame([("a",), ("c",), ("z",)], "doc_id string"), (1, 2)).collect()}
    assert set(got) == {(t, k) for t in ("basic", "unknown", "OVERALL") for k in (1, 2)}
    assert (got["basic", 2].n, got["basic", 2].reachable, got["basic", 2].ceiling, got["basic", 2].recall, got["basic", 2].recall_reachable) == (2, 1, 0.5, 0.5, 1.0)
    assert got["basic", 1].recall == 0 and got["basic", 2].hit_rate == 0.333333 and got["OVERALL", 2].recall == 0.666667 and got["unknown", 1].recall == 1


def test_prompts_are_asked_once(spark, tmp_path):
    cache, log = f"file://{tmp_path}/cache", tmp_path / "asked"

    def model(system, prompt, temperature):
        with log.open("a") as out:
            out.write(prompt + "\n")
        return None if prompt == "hush" else f'Sure: {{"n": {len(prompt)}}} ok'

    prompts = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, "hush"), (5, None)], "id long, prompt string")
    for _ in range(2):
        got = {r.id: r.n for r in completion.completed(prompts, model, "m", cache).select("id", completion.as_json(F.col("text"), "n int")["n"].alias("n")).collect()}
        assert got == {1: 3, 2: 5, 3: 3, 4: None, 5: None}
    assert sorted(log.read_text().split()) == ["hush", "hush", "one", "three"]
    assert completion.completed(prompts, None, "m", cache).where("text IS NOT NULL").count() == 0


def test_failures_are_asked_again():
    waits, left = [], [3]

    def model(system, prompt, temperature):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("busy")
        return "done"

    assert completion.patiently(model, waits.append)(None, "p", 0.0) == "done" and waits == [2.0, 4.0, 8.0]
    left[0] = 9
    with pytest.raises(OSError):
        completion.patiently(model, waits.append)(None, "p", 0.0)
