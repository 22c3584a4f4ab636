import re

import corpus_pipeline
from tests.llm.test_dedup import near_by_brute_force

WORD = re.compile(r"\w")


def test_stages_against_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t, *_ in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, "")
    assert {r.doc_id for r in one.collect()} == {i for i, t, *_ in texts if t and any(c.isalpha() for c in t)} and one.columns == docs.columns
    left = [(r.doc_id, r.text) for r in one.collect()]
    two = stage["minhash_near_dedup"](spark, one, "")
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in near_by_brute_force(left, 5).items() if i == c} and two.columns == docs.columns
    before = {r.doc_id: r.text for r in two.collect()}
    three = stage["suffix_array_dedup"](spark, two, "")
    after = {r.doc_id: r for r in three.collect()}
    assert set(after) == set(before) and three.columns == docs.columns and all(r.n_chars == len(r.text) for r in after.values())
    seen: dict = {}
    for t in before.values():
        b = t.encode()
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    for i, t in before.items():
        b = t.encode()
        assert (after[i].text == t) == all(seen[b[k : k + 200]] == 1 for k in range(len(b) - 199))
    four = stage["best_fit_packing"](spark, three, "").collect()
    assert {r.doc_id for r in four} == set(after)
    room: dict = {}
    for r in four:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048


def test_columns_of_any_name_stay(spark, texts):
    extra = "_id _n _cut _sha _lettered score rejected lang_pred sha kept component_id".split()
    rows = [(i, t, "xx", "s", len(t or ""), *(f"{i}{c}" for c in extra)) for i, t, *_ in texts]
    rows += [(None, texts[0][1], None, None, None, *extra), rows[0], (rows[5][0], "another text under a doc_id that is there", "xx", "s", 1, *extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        own = [r for r in got if r.doc_id is not None and r.score.endswith("score") and r.score != "score"]
        assert len(own) >= len(got) - 2 and all(r[c] == f"{r.doc_id}{c}" for r in own for c in extra)
        assert all(r[c] == c for r in got if r not in own for c in extra)
        assert sum(r.doc_id is None for r in got) == 1
    assert corpus_pipeline.STAGES[3][1](spark, docs, "").count() >= docs.count()


def test_empty_tables_go_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_is_whole(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and corpus_pipeline.ORACLE_SQL is None
