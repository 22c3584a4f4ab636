import hashlib
import html as H
import re
import struct

import duckdb
import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from tessella.llm import html, language, neighbours, simhash

SF = "/root/testdata/sf0.001"


def rows(table, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{table}.parquet' order by 1").fetchall()


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in language.op7_language_id(spark, SF).collect()}
    held = [(i, lang) for i, lang in rows("documents", "doc_id, lang") if got[i].held_out]
    assert len(held) > 20 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark, empty):
    dictionaries = {"en": b"the of and to in is that it was for on are with as his they be at " * 40, "de": b"der die und in den von zu das mit sich des auf ist im dem nicht ein " * 40}
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "und der die das nicht mit", "x"), (5, "the of and that was for", None)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language.classify(docs, dictionaries).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "de", "en"] and [got[i].rejected for i in range(1, 6)] == [True] * 3 + [False] * 2
    assert language.classify(docs, {}).where("lang_pred = 'und'").count() == 5
    assert language.classify(empty, dictionaries).count() == 0


def test_short_texts_make_dictionaries(spark):
    own = {"de": "der hund und die katze sind nicht in dem haus", "en": "the dog and the cat are not in that house"}
    rows_ = [(i, f"{own[lang]} {i}", lang) for i, lang in enumerate(["de", "en"] * 20)]
    long = [(100 + i, f"{own['en']} " * 9, "en") for i in range(5)]
    docs = spark.createDataFrame([*rows_, *long, (200, "12 34", "zz"), (201, None, "zz")], "doc_id long, text string, lang string")
    for frame in (docs, docs.where("doc_id < 100")):
        found = language.fit(frame)
        assert set(found) == {"de", "en"}
        got = language.classify(frame.where("doc_id < 100"), found).collect()
        assert all(r.lang_pred == r.lang and not r.rejected for r in got)
    assert language.with_known_language(docs).count() == 45


def hashed(term, seed=42):
    """Spark's xxhash64 of a string, from another hash or the seed."""
    return xxhash.xxh64_intdigest(term.encode(), seed)


def voted(text):
    """The 128 bits of a text, counted one by one."""
    words = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
    while len(words) > 1 and not words[-1] and text == "":
        words.pop()
    votes, total = [0] * 128, 0
    for a, b in zip(words, [*words[1:], None]):
        x = hashed(a) if b is None else hashed(b, hashed(a))
        y = xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<Q", x), 42))
        weight = 1 + min(len(a), 24) // 4
        total += weight
        for k in range(128):
            votes[k] += weight * (((x << 64 | y) >> k) & 1)
    return f"{sum(1 << k for k in range(128) if 2 * votes[k] > total):032x}"


def test_votes_are_counted_one_by_one(docs, texts, spark):
    long = " ".join(f"word{i % 977}{'o' * (i % 40)}" for i in range(20_000))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, long)], "doc_id long, text string"))
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(frame, ["doc_id"], "text").collect()}
    for i, t, *_ in [*texts, (-1, long)]:
        assert got[i] == voted(t or "")


def test_sizes_are_recounted_and_decide(docs, texts):
    made = {"aa": b"the of and to in is that it was for on are with as his they be at " * 40, "bb": b"der die und in den von zu das mit sich des auf ist im dem nicht ein " * 40, "cc": b"der die und in den von zu das mit sich des auf ist im dem nicht eine " * 40}
    got = {r.doc_id: r for r in language.classify(docs.select("doc_id", "text"), made).collect()}
    for i, t, *_ in texts:
        letters = re.sub(r"[\W\d_]+", " ", (t or "").lower()).encode()
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        sizes = []
        for d in made.values():
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=language._parameters())
            sizes.append(sum(len(tool.compress(letters[k : k + 4096])) for k in range(0, len(letters), 4096)))
        low, second = sorted(sizes)[:2]
        assert got[i].lang_pred == list(made)[sizes.index(low)] and got[i].rejected == (second - low + 1 <= 0.005 * low)
        assert abs(got[i].score - 1 / sum(2.0 ** (-8 * min(x - low, 100)) for x in sizes)) < 1e-12


def test_edited_texts_and_likeness(docs, texts):
    order = sorted(texts, reverse=True, key=lambda r: r[0])
    got = {r.doc_id: r for r in simhash.fingerprint_edits(docs).collect()}
    prints: dict = {}
    for (i, t, *_), (j, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + u[:cut]
        a, b, c = (int(x, 16) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[j].fingerprint))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].fingerprint == voted(t) and got[i].edited_fingerprint == voted(edited)
        assert abs(got[i].near_edited - (1 - (a ^ b).bit_count() / 128)) < 1e-12 and abs(got[i].near_next - (1 - (a ^ c).bit_count() / 128)) < 1e-12
        assert prints.setdefault(t, a) == a
    every = {r.fingerprint for r in got.values()}
    for r in got.values():
        assert r.n_near == sum(f != r.fingerprint and (int(f, 16) ^ int(r.fingerprint, 16)).bit_count() <= 3 for f in every)
    long = [got[i] for i, t, *_ in texts if t and len(t) > 600]
    assert np.median([r.near_edited for r in long]) > np.median([r.near_next for r in long]) + 0.1


def test_next_text_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(3)
    made = [(int(i), f"t{k}") for k, i in enumerate(rng.integers(-10**15, 10**15, 150))]
    made += [(7, f"same {k % 40}") for k in range(120)] + [(None, f"none {k}") for k in range(60)] + [(2**63 - 1, "top"), (-(2**63), "bottom")]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    order = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1]) >> 1))
    want = [(i, t, u) for (i, t), (_, u) in zip(order, order[1:] + order[:1])]
    got = [(r.doc_id, r.text, r.next_text) for r in simhash.with_next(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_copies_are_within_the_radius(spark, tmp_path):
    rng, made = np.random.default_rng(8), []
    for i in range(60):
        words = [f"w{x}" + "o" * (x % 8) for x in rng.integers(0, 3_000, 300).tolist()]
        made.append((2 * i, " ".join(words)))
        words[int(rng.integers(0, 300))] = "changed"
        made.append((2 * i + 1, " ".join(words)))
    spark.createDataFrame(made, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op6_simhash(spark, str(tmp_path)).collect()
    every = {r.fingerprint for r in got}
    assert all(r.n_near == sum(f != r.fingerprint and (int(f, 16) ^ int(r.fingerprint, 16)).bit_count() <= simhash.RADIUS for f in every) for r in got)
    assert len(got) == 120 and sum(r.n_near > 0 for r in got) >= 0.9 * 120


def test_fingerprints_vote(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    bits = simhash.fingerprints(docs, ["doc_id"], "text").first()
    h = docs.select(F.xxhash64(F.lit("alpha"), F.lit(None).cast("string")).alias("h")).select(F.lower(F.hex("h"))).first()[0]
    assert bits.fingerprint[:16] == h.rjust(16, "0")


def test_all_fingerprints_within_the_radius(spark):
    rng = np.random.default_rng(4)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(40)]
    for b in base[:20]:
        for k in range(5):
            base.append(b ^ sum(1 << int(x) for x in rng.choice(128, k + 1, replace=False)))
    halves = [tuple(struct.unpack(">qq", x.to_bytes(16, "big"))) for x in base]
    frame = spark.createDataFrame([*halves, halves[0], (None, None), (1, None)], "x long, y long")
    whole = dict(zip(halves, base))
    for radius in (1, 2, 3, 8):
        want = {(a, b, (whole[a] ^ whole[b]).bit_count()) for a in whole for b in whole if a < b and (whole[a] ^ whole[b]).bit_count() <= radius}
        got = [((r.ax, r.ay), (r.bx, r.by), r.distance) for r in simhash.near_fingerprints(frame, radius).collect()]
        assert set(got) == want and len(got) == len(want)


def test_block_tables_are_not_broadcast(spark, tmp_path):
    """Prints of 16 KB in a file; their 45 tables have 1 MB, more than may be broadcast here."""
    rng = np.random.default_rng(6)
    halves = rng.integers(-(2**63), 2**63 - 1, (1_000, 2)).tolist()
    halves += [[x ^ 5, y] for x, y in halves[:20]]
    spark.createDataFrame(halves, "x long, y long").write.parquet(f"{tmp_path}/prints")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        got = simhash.near_fingerprints(spark.read.parquet(f"{tmp_path}/prints"), simhash.RADIUS).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 20 and all(r.distance == 2 for r in got)


def test_simhash_edges(empty, odd):
    assert simhash.fingerprint_edits(empty).count() == 0
    got = simhash.fingerprint_edits(odd).collect()
    assert len(got) == 8 and len({r.fingerprint for r in got if r.doc_id == 2}) == 1


def test_neighbours_recall(spark):
    got: dict = {}
    for r in neighbours.op5_ivf_pq(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    every = rows("embeddings", "vec_id, embedding")
    ids, x = np.array([i for i, _ in every]), np.array([v for _, v in every], float)
    hit = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]])
        mine = got[ids[q]]
        hit += len(best & {v for v, _ in mine})
        assert [s for _, s in mine] == sorted(s for _, s in mine) and all(abs(s - d[np.searchsorted(ids, v)]) < 1e-12 for v, s in mine)
    assert hit >= 0.9 * 10 * len(got)


def test_clustered_vectors_need_few_lists_and_large_lists_have_parts(monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(200, 16)) * 20
    x = centers[rng.integers(0, 200, 4_000)] + rng.normal(size=(4_000, 16))
    few, many = neighbours.Index(x, 10_000), neighbours.Index(rng.normal(size=(4_000, 16)), 10_000)
    assert few.probes <= 20 < many.probes
    monkeypatch.setattr(neighbours, "BLOCK", 1_000)
    sizes = np.full(len(few.coarse), 100)
    sizes[7] = 4_500
    few.deal(sizes)
    assert few.parts_of[7] == 5 and (np.delete(few.parts_of, 7) == 1).all()
    load = np.bincount(np.delete(few.first, 7), np.delete(sizes, 7))
    assert load.max() <= 1_000 and not np.isin(np.delete(few.first, 7), np.arange(few.first[7], few.first[7] + 5)).any()
    assert len(few.blocks_of(x[0])) < len(load) / 2


def test_neighbours_edges(spark):
    one = [1.0, 0.0, 0.0]
    vectors = [(i, one) for i in range(0, 30)] + [(100, [0.0, 1.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 0.0]), (104, [float("nan"), 1.0, 0.0]), (105, [1.0, 2.0]), (None, one), (100, [0.0, 1.0, 0.0]), (200, [0.0, 0.9, 0.1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, vector int")
    got: dict = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == list(range(1, 11)) and got[100][0] == 200 and got[100][1:3] == [0, 1] and set(got) == {0, 100, 200}
    assert neighbours.nearest(frame.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(frame, F.lit(False)).count() == 0
    assert [r.vec_id for r in neighbours.nearest(frame.where("vec_id in (0, 100)"), F.col("vec_id") == 0).collect()] == [100]


def test_formulas_and_drawings_are_read():
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 500, n))
    paragraphs = [f"{words(60)}." for _ in range(6)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{body}<p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc2</mi></math> as {words(40)}.</p><script>var x = 1;</script></article></body></html>"
    (got,) = html.main_text([page], html.fitted())
    assert "Energy is E=mc2 as" in got and "var x" not in got and got.startswith(paragraphs[0])


def test_main_text_of_made_pages():
    rng = np.random.default_rng(2024)
    sources, wanted = zip(*(html.made_page(rng) for _ in range(150)))
    got = html.main_text(list(sources), html.fitted())
    right = sum(len(b) for g, w in zip(got, wanted) for b in g.split("\n\n") if b in w)
    assert right >= 0.98 * sum(len(b) for w in wanted for b in w) and right >= 0.98 * sum(len(b) for g in got for b in g.split("\n\n"))


def test_main_text_of_the_pages(spark):
    got = {r.page_id: r for r in html.op9_html_main_text(spark, SF).collect()}
    for i, source in rows("pages", "page_id, html"):
        inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?[bia]\b[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inside)]
        assert got[i].text == "\n\n".join(filter(None, blocks)) and got[i].n_chars == len(got[i].text)


def test_wrong_markup(spark):
    body = "".join(f"<p>{'Some words, in a sentence that goes on. ' * 8}" for _ in range(4))
    rows_ = [(1, "u", None, 0), (2, "u", "", 0), (3, "u", "<", 0), (4, "u", "<div><p>unclosed <b>bold<script>if (a<b) '</p>'", 0), (5, None, f"<body><nav><a href='x'>Home</a></nav><article><h1>A &amp; B</h1>{body}</article></div></body>", 0), (None, "u", f"<a title=\"x>{body}", 0)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows_, "page_id long, url string, html string, text int")).collect()}
    assert len(got) == 6 and got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[5].text.startswith("A & B\n\nSome words, in") and "Home" not in got[5].text and got[5].text.count("\n\n") == 4 and "if (a" not in got[4].text
