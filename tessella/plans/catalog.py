"""Registered queries of the engine's own operators over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.udfs import jaro_winkler
from tessella.operators import agent, evaluation, extraction, graph, linkage, retrieval, service, temporal
from tessella.sources import documents as sources
from tessella.session import shared_folder, ship
from tessella.streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- documents -----------------------------------------------------------------------------------


@query("SELECT doc_id, split_part(text, chr(10), 1) AS title, length(text) - length(split_part(text, chr(10), 1)) AS rest_chars FROM documents")
def doc_title_body(spark, d):
    title = F.substring_index("text", "\n", 1)
    return _t(spark, d, "documents").select("doc_id", title.alias("title"), (F.length("text") - F.length(title)).cast("long").alias("rest_chars"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def doc_source_counts(spark, d):
    return graph.stats(_t(spark, d, "documents"), "source")


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedupe_first(spark, d):
    return _t(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def per_source_head_n(spark, d):
    return evaluation.head_of_each(_t(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 3)


_EMAILS = f"regexp_extract_all(text, '{T.EMAIL}')"


@query(f"SELECT doc_id, len({_EMAILS}) AS n, array_to_string({_EMAILS}, ',') AS emails FROM documents WHERE len({_EMAILS}) > 0")
def extract_emails(spark, d):
    found = _t(spark, d, "documents").select("doc_id", T.emails(F.col("text")).alias("e")).where(F.size("e") > 0)
    return found.select("doc_id", F.size("e").cast("long").alias("n"), F.array_join("e", ",").alias("emails"))


@query(f"""SELECT lower(regexp_extract(e, '@([\\w.\\-]+)', 1)) AS domain, lower(regexp_extract(e, '([\\w.+-]+)@', 1)) AS local, count(*) AS n
FROM (SELECT unnest({_EMAILS}) AS e FROM documents) GROUP BY 1, 2""")
def email_domain_counts(spark, d):
    one = _t(spark, d, "documents").select(F.explode(T.emails(F.col("text"))).alias("e"))
    return one.groupBy(T.email_domain(F.col("e")).alias("domain"), T.email_local(F.col("e")).alias("local")).agg(F.count("*").alias("n"))


@query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark, d):
    return _t(spark, d, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:40], ' ') AS refs FROM w""")
def ordered_distinct_refs(spark, d):
    split = F.split(F.translate("text", "\n", " "), " ")
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.ordered_distinct(split, 40), " ").alias("refs"))


# --- names ---------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9@._+\\-]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT p_partkey, {_NORM.format("p_name")} AS name_norm FROM part)
SELECT p_partkey, name_norm, string_split(name_norm, ' ')[-1] AS surname, 'n_' || substr(sha1('part' || chr(31) || name_norm), 1, 16) AS id FROM n""")
def normalize_name_keys(spark, d):
    named = _t(spark, d, "part").select("p_partkey", T.normalize_name(F.col("p_name")).alias("name_norm"))
    return named.select("p_partkey", "name_norm", T.surname(F.col("name_norm")).alias("surname"), T.mint_id("n", F.lit("part"), F.col("name_norm")).alias("id"))


@query("SELECT c_custkey, nullif(split_part(trim(replace(trim(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9@._+\\-]+', ' ', 'g')), '.', ' ')), ' ', 1), '') AS stem FROM customer")
def handle_stem(spark, d):
    return _t(spark, d, "customer").select("c_custkey", T.handle_stem(F.col("c_name")).alias("stem"))


_FIRST_LAST = "string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS l"


@query(f"""SELECT p_name, f || '.' || l || ',' || f || '_' || l || ',' || f || l || ',' || f[1] || l || ',' || f || l[1] AS locals
FROM (SELECT DISTINCT p_name, {_FIRST_LAST} FROM part WHERE p_name LIKE '% %')""")
def name_locals(spark, d):
    named = _t(spark, d, "part").select("p_name").where("p_name LIKE '% %'").distinct()
    return named.select("p_name", F.array_join(T.name_locals(T.normalize_name(F.col("p_name"))), ",").alias("locals"))


def _people(spark, d) -> DataFrame:
    """Distinct part names with a number each, as people."""
    names = _t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return linkage.person_frame(names, "id", "p_name")


_PEOPLE = "people AS (SELECT min(p_partkey) AS id, p_name AS name_norm, string_split(p_name, ' ')[-1] AS surname, string_split(p_name, ' ')[1] AS stem FROM part GROUP BY p_name)"


@query(f"""WITH {_PEOPLE} SELECT a.id AS id_l, b.id AS id_r, CASE WHEN a.surname = b.surname THEN 'surname' ELSE 'handle_stem' END AS rule
FROM people a JOIN people b ON a.id < b.id AND (a.surname = b.surname OR a.stem = b.stem)""")
def blocking_pairs(spark, d):
    return linkage.blocked_pairs(_people(spark, d), ["surname", "handle_stem"])


@query(f"WITH {_PEOPLE} SELECT a.id AS id_l, b.id AS id_r, 0.97::DOUBLE AS probability FROM people a JOIN people b ON a.id < b.id AND a.stem = b.stem")
def deterministic_pairs(spark, d):
    return linkage.deterministic_pairs(_people(spark, d))


@query(f"WITH {_PEOPLE} SELECT a.id AS id_l, b.id AS id_r, round(jaro_winkler_similarity(a.name_norm, b.name_norm), 6) AS similarity FROM people a JOIN people b ON a.id < b.id AND a.surname = b.surname")
def jw_similarity(spark, d):
    ship(spark)
    p = _people(spark, d).select("id", "name_norm", "surname")
    both = p.alias("a").join(p.alias("b"), (F.col("a.surname") == F.col("b.surname")) & (F.col("a.id") < F.col("b.id")))
    return both.select(F.col("a.id").alias("id_l"), F.col("b.id").alias("id_r"), F.round(jaro_winkler("a.name_norm", "b.name_norm"), 6).alias("similarity"))


@query(f"""WITH {_PEOPLE}, pairs AS (SELECT a.name_norm AS x, b.name_norm AS y, a.stem = b.stem AS h, jaro_winkler_similarity(a.name_norm, b.name_norm) AS s
FROM people a JOIN people b ON a.id < b.id AND (a.surname = b.surname OR a.stem = b.stem))
SELECT CASE WHEN x = y THEN 4 WHEN s >= 0.92 THEN 3 WHEN s >= 0.88 THEN 2 WHEN s >= 0.70 THEN 1 ELSE 0 END AS gamma_name, -1 AS gamma_email, h::INT AS gamma_handle, count(*) AS pairs FROM pairs GROUP BY ALL""")
def gamma_histogram(spark, d):
    people = _people(spark, d)
    return linkage.agreement_patterns(linkage.compared(linkage.blocked_pairs(people, ["surname", "handle_stem"]), people))


@query()
def fs_scores(spark, d):
    people = _people(spark, d)
    scored = linkage.predicted_pairs(people, 0.0)
    return scored.select("id_l", "id_r", F.round("probability", 6).alias("probability"), linkage.band(F.col("probability")).alias("band"))


@query("""WITH names AS (SELECT min(c_custkey) AS id, c_nationkey FROM customer GROUP BY c_nationkey), t AS (
SELECT id, 'maria ' || lower(n_name) AS name FROM names JOIN nation ON c_nationkey = n_nationkey), p AS (
SELECT n_nationkey + 1000000000 AS id, 'maria.' || lower(n_name) AS local FROM nation WHERE n_name NOT LIKE '% %')
SELECT id AS id_l, pid AS id_r FROM (SELECT t.id, p.id AS pid FROM t JOIN p ON split_part(t.name, ' ', 1) || '.' || string_split(t.name, ' ')[-1] = p.local)""")
def name_email_bridge(spark, d):
    nation = _t(spark, d, "nation")
    first = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("id"))
    names = first.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("id", F.concat(F.lit("Maria "), F.initcap("n_name")).alias("s"))
    mails = nation.where("n_name NOT LIKE '% %'").select((F.col("n_nationkey").cast("long") + 1_000_000_000).alias("id"), F.concat(F.lit("maria."), F.lower("n_name"), F.lit("@example.com")).alias("s"))
    return linkage.bridges(linkage.person_frame(names.unionByName(mails), "id", "s"))


_REACH = f"""WITH RECURSIVE {_PEOPLE}, e AS (SELECT a.id AS x, b.id AS y FROM people a JOIN people b ON a.id <> b.id AND a.stem = b.stem),
r AS (SELECT id AS x, id AS y FROM people UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"""


@query(_REACH + " SELECT x AS id, min(y) AS component FROM r GROUP BY x")
def connected_components(spark, d):
    people = _people(spark, d)
    return linkage.components(linkage.deterministic_pairs(people), people)


def _mixed_people(spark, d) -> DataFrame:
    """Every name twice, and each first word by itself: names unite with their like, a first word with the first of its names."""
    names = _t(spark, d, "part").where("p_name LIKE '% %'").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    again = names.select(F.upper("p_name").alias("p_name"), (F.col("id") + 1_000_000_000).alias("id"))
    bare = names.groupBy(F.substring_index("p_name", " ", 1).alias("p_name")).agg((-1 - F.min("id")).alias("id"))
    return linkage.person_frame(names.unionByName(again).unionByName(bare), "id", "p_name")


_CLUSTERS = """nm AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_name LIKE '% %' GROUP BY 1), fi AS (SELECT split_part(p_name, ' ', 1) AS stem, min(id) AS first FROM nm GROUP BY 1),
tw AS (SELECT p_name, id, id AS own FROM nm UNION ALL SELECT p_name, id + 1000000000, id FROM nm),
cl AS (SELECT tw.id, CASE WHEN own = first THEN -1 - first ELSE own END AS cluster, string_split(p_name, ' ')[-1] AS surname FROM tw JOIN fi ON stem = split_part(p_name, ' ', 1) UNION ALL SELECT -1 - first, -1 - first, NULL FROM fi)"""


@query(f"WITH {_CLUSTERS} SELECT id, cluster FROM cl")
def guarded_clusters(spark, d):
    """Names that share a first word have different surnames: unions of other names are refused."""
    people = _mixed_people(spark, d)
    return linkage.guarded_clusters(linkage.deterministic_pairs(people), people)


@query(f"WITH {_CLUSTERS}, n AS (SELECT cluster, count(*) AS members, count(DISTINCT surname) AS surnames FROM cl GROUP BY 1) SELECT count(*) AS clusters, max(members) AS largest, count(*) FILTER (surnames > 1) AS violations FROM n")
def surname_invariant(spark, d):
    people = _mixed_people(spark, d)
    clusters = linkage.guarded_clusters(linkage.deterministic_pairs(people), people)
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members")).agg(F.count("*").alias("clusters"), F.max("members").alias("largest"))
    return sizes.crossJoin(linkage.surname_violations(clusters, people).agg(F.count("*").alias("violations")))


@query("""WITH m AS (SELECT o_custkey AS cluster, o_orderpriority AS surface, o_orderkey AS ord, o_orderstatus AS source FROM orders),
f AS (SELECT cluster, surface, count(*) AS n, min(ord) AS ord FROM m GROUP BY ALL),
b AS (SELECT cluster, surface, row_number() OVER (PARTITION BY cluster ORDER BY (surface LIKE '% %') DESC, n DESC, length(surface) DESC, ord) AS k FROM f),
a AS (SELECT cluster, string_agg(surface, '|' ORDER BY ord) AS aliases FROM f GROUP BY cluster)
SELECT m.cluster, any_value(b.surface) AS canonical_name, any_value(a.aliases) AS aliases, count(*)::INT AS mention_count, string_agg(DISTINCT source, '|' ORDER BY source) AS source_types
FROM m JOIN b ON b.cluster = m.cluster AND b.k = 1 JOIN a ON a.cluster = m.cluster GROUP BY m.cluster""")
def canonical_entities(spark, d):
    m = _t(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.lit("person").alias("entity_type"), F.col("o_orderpriority").alias("surface"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("ord"))
    return linkage.canonical_entities(m).select("cluster", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "mention_count", F.array_join("source_types", "|").alias("source_types"))


# --- retrieval -----------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"SELECT doc_id, len({_TOKENS}) AS length FROM documents")
def doc_lengths(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("length"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    return retrieval.document_frequency(_t(spark, d, "documents"))


@query(f"SELECT doc_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) - 1 AS position FROM documents")
def tokens_postings(spark, d):
    return retrieval.postings(_t(spark, d, "documents")).select("doc_id", "term", F.col("position").cast("long").alias("position"))


_STOP = "'the','a','an','and','or','of','to','in','on','for','is','are','was','were','be','been','what','which','who','whom','whose','when','where','why','how','did','does','do','with','that','this','it','at','by','from','as','we','our','us'"
_TERMS = f"""qt AS (SELECT item_id, list_transform(regexp_extract_all(text, '{T.QUERY_TERM}'), lambda x: lower(x)) AS f FROM benchmark),
qu AS (SELECT item_id, CASE WHEN len(u) > 0 THEN u ELSE f END AS t FROM (SELECT item_id, f, list_filter(f, lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS u FROM qt)),
q AS (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM qu)"""


@query(f"WITH {_TERMS} SELECT item_id, array_to_string(t, ' ') AS terms FROM q")
def fts_query_terms(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def _asked(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_BM25 = f"""qt AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '{T.QUERY_TERM}'), lambda x: lower(x)) AS f FROM benchmark),
qu AS (SELECT query_id, CASE WHEN len(u) > 0 THEN u ELSE f END AS t FROM (SELECT query_id, f, list_filter(f, lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS u FROM qt)),
qp AS (SELECT DISTINCT query_id, unnest(t) AS phrase FROM qu),
ph AS (SELECT phrase, regexp_extract_all(phrase, '[\\p{{L}}\\p{{N}}]+') AS parts FROM (SELECT DISTINCT phrase FROM qp)),
pp AS (SELECT phrase, len(parts) AS size, unnest(parts) AS term, generate_subscripts(parts, 1) - 1 AS o FROM ph),
dt AS (SELECT doc_id, {_TOKENS} AS l FROM documents),
st AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM dt),
po AS (SELECT doc_id, len(l) AS length, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS p FROM dt),
oc AS (SELECT phrase, size, doc_id, length, p - o AS at FROM po JOIN pp USING (term) GROUP BY ALL HAVING count(*) = size),
tf AS (SELECT phrase, doc_id, length, count(*) AS tf FROM oc GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
sc AS (SELECT phrase, doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM tf JOIN df USING (phrase), st),
al AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM qp JOIN sc USING (phrase) GROUP BY ALL)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al QUALIFY rank <= 10")
def bm25_topk(spark, d):
    return retrieval.bm25(_t(spark, d, "documents"), _asked(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src3')) QUALIFY rank <= 5")
def bm25_source_filtered(spark, d):
    return retrieval.bm25(_t(spark, d, "documents"), _asked(spark, d), 5, ["src0", "src3"]).withColumn("rank", F.col("rank").cast("long"))


def _index(spark, d) -> retrieval.Index:
    return retrieval.write_index(_t(spark, d, "documents").select("doc_id", "source", "text"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


@query(f"SELECT term, doc_id, len({_TOKENS}) AS length, count(*) AS tf FROM (SELECT doc_id, text, unnest({_TOKENS}) AS term FROM documents) GROUP BY term, doc_id, text")
def stored_index(spark, d):
    """The postings of an index, written and read back."""
    return _index(spark, d).postings.select("term", "doc_id", F.col("length").cast("long").alias("length"), F.size("positions").cast("long").alias("tf"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2')) QUALIFY rank <= 10")
def stored_index_topk(spark, d):
    """Keyword search that reads a written index and no text."""
    return retrieval.bm25_stored(_index(spark, d), _asked(spark, d), 10, ["src0", "src1", "src2"]).withColumn("rank", F.col("rank").cast("long"))


_COSINE = """nv AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
nn AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM nv),
cs AS (SELECT q.vec_id AS query_id, d.vec_id, d.label, round(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) / (q.n * d.n), 6) AS score FROM nn q JOIN nn d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)"""


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")


@query(f"WITH {_COSINE} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs QUALIFY rank <= 10")
def vector_topk_cosine(spark, d):
    """Every vector whose number is divisible by 20 as a query, against all."""
    return retrieval.cosine_top_blocked(*_vectors(spark, d), 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_COSINE} SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM cs QUALIFY rank <= 3")
def vector_topk_per_label(spark, d):
    """The nearest three within each label."""
    found = retrieval.cosine_top_blocked(*_vectors(spark, d), 3, "label")
    return found.select("query_id", F.col("value").cast("int").alias("label"), "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25}, {_COSINE},
kw AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al QUALIFY rank <= 30),
ve AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs QUALIFY rank <= 30),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM ve) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= 10""")
def hybrid_search_topk(spark, d):
    """Whole passages as queries over documents, fused with the nearest vectors of those whose number is divisible by 20."""
    pool = retrieval.pool(10)
    keyword = retrieval.bm25(_t(spark, d, "documents"), _asked(spark, d), pool)
    vector = retrieval.cosine_top_blocked(*_vectors(spark, d), pool).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.fuse(keyword, vector, k=10).withColumn("rank", F.col("rank").cast("long"))


_GOLD = "gold AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS question_type, doc_id FROM benchmark b JOIN documents t ON contains(t.text, b.text))"


def _gold(spark, d) -> DataFrame:
    """A stated set of passages against all documents: which contain which."""
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    kind = F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("question_type")
    return _t(spark, d, "documents").join(F.broadcast(b), F.contains("text", "passage")).select("query_id", kind, "doc_id")


@query(f"""WITH {_BM25}, {_GOLD}, rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al QUALIFY rank <= 20),
ks AS (SELECT unnest([6, 12, 20]) AS k), ea AS (SELECT query_id, question_type, k, count(*) AS gold, count(*) FILTER (rank <= k) AS found FROM gold LEFT JOIN rk USING (query_id, doc_id), ks GROUP BY ALL)
SELECT k::INT AS k, coalesce(question_type, 'ALL') AS question_type, count(*) AS questions, round(avg((found > 0)::INT::DOUBLE), 6) AS recall, round(sum(found)::DOUBLE / sum(gold), 6) AS hit_rate
FROM ea GROUP BY GROUPING SETS ((k, question_type), (k))""")
def recall_at_k(spark, d):
    return retrieval.recall_report(_gold(spark, d), retrieval.bm25(_t(spark, d, "documents"), _asked(spark, d), 20), (6, 12, 20))


@query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN trim(replace(text, chr(10), ' ')) ELSE trim(replace(substr(text, 1, 1000), chr(10), ' ')) || '...' END AS snippet FROM documents")
def snippet_whole(spark, d):
    """Short texts whole, and the heads of long ones that hold no term."""
    return _t(spark, d, "documents").select("doc_id", retrieval.snippet(F.col("text"), F.array(F.lit("\u2603")), 1000).alias("snippet"))


@query("""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'ver') AS pos FROM documents), w AS (SELECT *, greatest(pos - 1 - 333, 0) AS a FROM p)
SELECT doc_id, CASE WHEN length(text) <= 1000 THEN trim(replace(text, chr(10), ' ')) WHEN pos = 0 THEN trim(replace(substr(text, 1, 1000), chr(10), ' ')) || '...'
ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || trim(replace(substr(text, a + 1, 1000), chr(10), ' ')) || CASE WHEN a + 1000 < length(text) THEN '...' ELSE '' END END AS snippet FROM w""")
def snippet_windows(spark, d):
    """A window around the first place of a term."""
    return _t(spark, d, "documents").select("doc_id", retrieval.snippet(F.col("text"), F.array(F.lit("ver")), 1000).alias("snippet"))


@query("""WITH a AS (SELECT item_id AS query_id, [item_id * 3, item_id, -1] AS ids FROM benchmark)
SELECT query_id, position, doc_id, source FROM (SELECT query_id, unnest(ids) AS doc_id, generate_subscripts(ids, 1) - 1 AS position FROM a) JOIN documents USING (doc_id)""")
def ordered_multiget(spark, d):
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.col("item_id") * 3, "item_id", F.lit(-1).cast("long")).alias("ids"))
    return service.in_order(asked, _t(spark, d, "documents").select("doc_id", "source")).select("query_id", F.col("position").cast("long").alias("position"), "doc_id", "source")


@query(f"""WITH {_BM25}, rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al QUALIFY rank <= 4),
b AS (SELECT query_id, doc_id, 0 AS turn, rank FROM rk UNION ALL SELECT item_id, item_id, 1, 1 FROM benchmark), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY turn, rank) = 1)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank) AS rank FROM o""")
def merged_hits(spark, d):
    return _merged(spark, d, _asked(spark, d))


def _merged(spark, d, asked) -> DataFrame:
    first = retrieval.bm25(_t(spark, d, "documents"), asked, 4).select("query_id", "doc_id", "rank")
    second = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"), F.lit(1).alias("rank"))
    return agent.merge_hits(first, second).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query()
def stemmed_postings(spark, d):
    """How often each stem stands in documents."""
    return retrieval.postings(_t(spark, d, "documents"), stems=True).groupBy("term").agg(F.count("*").alias("n"))


@query()
def document_vectors(spark, d):
    """Hashed vectors of documents; unit length."""
    docs = _t(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return retrieval.embed(docs).select("doc_id", F.round(retrieval.dot(F.col("vector"), F.col("vector")), 3).alias("norm"))


# --- evaluation ----------------------------------------------------------------------------------


def _answered(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    status = {"O": "basic", "F": "semantic", "P": "info_not_found"}
    kind = F.create_map(*(F.lit(x) for p in status.items() for x in p))[F.col("o_orderstatus")]
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey").cast("string"))).alias("gold"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey").cast("string"))).alias("cited"))
    asked = o.select(F.col("o_orderkey").alias("question_id"), kind.alias("question_type")).join(lines, "question_id", "left")
    questions = asked.select("question_id", "question_type", F.when(F.col("question_type") != "info_not_found", F.col("gold")).alias("gold"))
    answers = asked.where("question_id % 10 <> 0").select("question_id", F.when(F.col("question_id") % 7 == 0, "We do not have enough information.").when(F.col("question_id") % 11 == 0, "That is Not in the data").otherwise("yes").alias("answer"), "cited")
    traces = asked.where("question_id % 5 = 0").select("question_id", (F.col("question_id") % 3 == 0).alias("abstained"))
    return evaluation.score_each(questions, answers, traces)


_EACH = """l AS (SELECT l_orderkey AS question_id, list_distinct(list(l_suppkey) FILTER (l_returnflag <> 'R')) AS g, list_distinct(list(l_suppkey) FILTER (l_linestatus = 'O')) AS c FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey AS question_id, CASE o_orderstatus WHEN 'O' THEN 'basic' WHEN 'F' THEN 'semantic' WHEN 'P' THEN 'info_not_found' END AS question_type, coalesce(g, []) AS g0, coalesce(c, []) AS c0 FROM orders LEFT JOIN l ON question_id = o_orderkey),
b AS (SELECT question_id, question_type, question_id % 10 <> 0 AS answered, CASE WHEN question_type <> 'info_not_found' THEN g0 ELSE [] END AS gold, CASE WHEN question_id % 10 <> 0 THEN c0 ELSE [] END AS cited,
 CASE WHEN question_id % 5 = 0 THEN question_id % 3 = 0 END AS traced, question_id % 7 = 0 OR question_id % 11 = 0 AS declined FROM a),
e AS (SELECT question_id, question_type, answered, answered AND coalesce(traced, len(cited) = 0 AND declined) AS abstained, len(gold) > 0 AS has_gold,
 CASE WHEN answered AND len(gold) > 0 THEN len(list_intersect(cited, gold))::DOUBLE / len(gold) WHEN answered AND question_type NOT IN ('info_not_found', 'high_level') THEN 0 END AS recall,
 CASE WHEN answered AND len(gold) > 0 THEN CASE WHEN len(cited) = 0 THEN 0 ELSE len(list_intersect(cited, gold))::DOUBLE / len(cited) END END AS prec,
 CASE WHEN answered AND len(gold) > 0 THEN len(cited) - len(list_intersect(cited, gold)) END AS extra FROM b)"""


@query(f"WITH {_EACH} SELECT question_type, count(*) FILTER (answered) AS answered, count(*) FILTER (NOT answered) AS unanswered, count(*) FILTER (abstained) AS abstained, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS precision, round(avg(extra), 6) AS extra FROM e GROUP BY 1")
def answer_scoring(spark, d):
    return evaluation.score_types(_answered(spark, d))


@query(f"""WITH {_EACH} SELECT round(avg(recall) FILTER (has_gold AND answered), 6) AS recall, round(avg(prec) FILTER (has_gold AND answered), 6) AS precision,
round(count(*) FILTER (question_type = 'info_not_found' AND answered AND NOT abstained)::DOUBLE / nullif(count(*) FILTER (question_type = 'info_not_found' AND answered), 0), 6) AS false_confidence,
round(count(*) FILTER (question_type = 'info_not_found' AND answered AND abstained)::DOUBLE / nullif(count(*) FILTER (question_type = 'info_not_found' AND answered), 0), 6) AS abstention_accuracy,
round(count(*) FILTER (has_gold AND answered AND abstained)::DOUBLE / nullif(count(*) FILTER (has_gold AND answered), 0), 6) AS false_abstention FROM e""")
def scoring_totals(spark, d):
    return evaluation.score_totals(_answered(spark, d))


@query("""WITH s AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey) FILTER (l_returnflag <> 'R')) AS f, list_distinct(list(l_suppkey) FILTER (l_linestatus = 'O')) AS g FROM lineitem GROUP BY 1),
t AS (SELECT k, coalesce(f, []) AS f, coalesce(g, []) AS g FROM s), u AS (SELECT k, len(list_intersect(f, g))::DOUBLE AS c, len(f) AS nf, len(g) AS ng FROM t),
v AS (SELECT k, CASE WHEN nf = 0 OR ng = 0 THEN 0 ELSE c / nf END AS p, CASE WHEN nf = 0 OR ng = 0 THEN 0 ELSE c / ng END AS r FROM u)
SELECT k, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM v""")
def prf_f1(spark, d):
    sets = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("f"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("g"))
    return sets.select("k", *evaluation.prf(F.col("f"), F.col("g")))


@query("""WITH c AS (SELECT source, count(*) AS s FROM documents GROUP BY 1), w AS (SELECT source, greatest(1, round_even(100 * s / (SELECT sum(s) FROM c), 0))::INT AS k FROM c)
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) JOIN w USING (source) WHERE n <= k""")
def stratified_sample(spark, d):
    return evaluation.stratified(_t(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 100)


_QUOTA = """c AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), x AS (SELECT source, size, 77 * size / sum(size) OVER () AS ex FROM c),
y AS (SELECT *, greatest(1, floor(ex)) AS base, row_number() OVER (ORDER BY ex - floor(ex) DESC, source) AS up FROM x),
z AS (SELECT *, 77 - sum(base) OVER () AS short, count(*) OVER () AS m, row_number() OVER (ORDER BY base DESC, source) AS down FROM y),
take AS (SELECT source, least(base + CASE WHEN short > 0 THEN floor(short / m) + (up <= short % m)::INT WHEN short < 0 AND down <= -short AND base > 1 THEN -1 ELSE 0 END, size)::BIGINT AS take FROM z)"""


@query(f"WITH {_QUOTA} SELECT source, take FROM take")
def quota_largest_remainder(spark, d):
    return evaluation.quota(_t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size")), 77)


@query(f"""WITH {_QUOTA} SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('7:' || source || ':' || doc_id), doc_id) AS n FROM documents) JOIN take USING (source) WHERE n <= take""")
def hash_sample(spark, d):
    docs = _t(spark, d, "documents").select("source", "doc_id")
    return evaluation.hash_sample(docs, "source", "doc_id", evaluation.quota(docs.groupBy("source").agg(F.count("*").alias("size")), 77), 7)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return evaluation.still_to_do(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def attempted_semi(spark, d):
    return evaluation.attempted(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("""WITH m AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM events),
s AS (SELECT event_id, user_id, ts, count(*) FILTER (bad) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS streak FROM m)
SELECT event_id, streak, max((streak >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS tripped FROM s""")
def failure_streak(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return evaluation.streak(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3).select("event_id", "streak", "tripped")


# --- facts in time -------------------------------------------------------------------------------

#: Which events hold one counterpart for each user, and which one user for each counterpart.
BY_SRC, BY_DST = ["purchase", "signup"], ["error"]


def _facts(spark, d, at) -> DataFrame:
    e = _t(spark, d, "events")
    facts = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("src"), F.col("event_type").alias("rel"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dst"), at.alias("stated_at"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("source"), F.col("event_id").cast("string").alias("doc_id"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    return facts.where("dst IS NOT NULL")


def _edges(spark, d) -> DataFrame:
    return temporal.edges(_facts(spark, d, F.col("ts")), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


def _resolved(spark, d) -> DataFrame:
    priority = spark.createDataFrame([("s0", 9), ("s1", 7), ("s2", 7), ("s3", 3)], "source string, priority int")
    return temporal.resolve_conflicts(_edges(spark, d), F.broadcast(priority), BY_SRC, BY_DST)


_LIFT = """ev AS (SELECT 'u' || user_id AS src, event_type AS rel, 'k' || json_extract_string(props, '$.k') AS dst, ts, 's' || (event_id % 4) AS source, event_id, value FROM events),
ed AS (SELECT src, rel, dst, min(ts) AS stated_at, max(value) AS confidence, arg_min(source, event_id) AS source, min(event_id) AS ord, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS docs,
 'e_' || substr(sha1(src || chr(31) || rel || chr(31) || dst), 1, 16) AS edge_id FROM ev WHERE dst IS NOT NULL GROUP BY src, rel, dst)"""
_TEMPORAL = f"""{_LIFT}, pr AS (SELECT *, CASE source WHEN 's0' THEN 9 WHEN 's1' THEN 7 WHEN 's2' THEN 7 WHEN 's3' THEN 3 ELSE 0 END AS prio,
 CASE WHEN rel IN ('purchase', 'signup') THEN src WHEN rel = 'error' THEN dst END AS anchor, CASE WHEN rel IN ('purchase', 'signup') THEN dst ELSE src END AS other FROM ed),
rk AS (SELECT *, rank() OVER (PARTITION BY anchor, rel ORDER BY prio DESC, stated_at DESC) AS r, anchor IS NOT NULL AND min(other) OVER g < max(other) OVER g AS several FROM pr WINDOW g AS (PARTITION BY anchor, rel)),
cf AS (SELECT *, several AND count(*) FILTER (r > 1) OVER g > 0 AS conflict, count(*) FILTER (r = 1) OVER g AS tops, first(edge_id) OVER (PARTITION BY anchor, rel ORDER BY r, ord) AS w_id, first(stated_at) OVER (PARTITION BY anchor, rel ORDER BY r, ord) AS w_at FROM rk WINDOW g AS (PARTITION BY anchor, rel)),
bt AS (SELECT edge_id, src, rel, dst, stated_at, stated_at AS valid_from, confidence, source, docs, ord, CASE WHEN conflict AND r > 1 THEN w_at END AS valid_to, CASE WHEN conflict AND r > 1 THEN w_id END AS superseded_by, conflict AND r = 1 AND tops > 1 AS contested FROM cf)"""


@query(f"WITH {_LIFT} SELECT edge_id, src, rel, dst, stated_at, round(confidence, 6) AS confidence, source, docs FROM ed")
def lift_edges(spark, d):
    return _edges(spark, d).select("edge_id", "src", "rel", "dst", "stated_at", F.round("confidence", 6).alias("confidence"), "source", F.array_join("docs", ",").alias("docs"))


@query(f"WITH {_TEMPORAL} SELECT edge_id, src, rel, dst, valid_from, valid_to, superseded_by, contested FROM bt")
def bitemporal_edges(spark, d):
    return _resolved(spark, d).select("edge_id", "src", "rel", "dst", "valid_from", "valid_to", "superseded_by", "contested")


@query(f"WITH {_TEMPORAL} SELECT rel, count(*) AS n FROM bt WHERE valid_to IS NULL GROUP BY rel")
def edges_current(spark, d):
    return graph.stats(temporal.current(_resolved(spark, d)), "rel")


@query(f"WITH {_TEMPORAL} SELECT edge_id FROM bt WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def edges_as_of(spark, d):
    return temporal.as_of(_resolved(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("edge_id")


_WEEKLY = _TEMPORAL.replace("AS dst, ts,", "AS dst, date_trunc('week', ts)::TIMESTAMP AS ts,")


@query(f"WITH {_WEEKLY} SELECT edge_id, rel, valid_to, superseded_by, contested FROM bt WHERE contested OR valid_to IS NOT NULL")
def contested_edges(spark, d):
    """Facts known to the week: several of one source are at the top together."""
    priority = spark.createDataFrame([("s0", 9), ("s1", 7), ("s2", 7), ("s3", 3)], "source string, priority int")
    edges = temporal.edges(_facts(spark, d, F.date_trunc("week", "ts").cast("timestamp_ntz")), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    return temporal.resolve_conflicts(edges, F.broadcast(priority), BY_SRC, BY_DST).where("contested OR valid_to IS NOT NULL").select("edge_id", "rel", "valid_to", "superseded_by", "contested")


def _nodes(spark, d) -> DataFrame:
    edge = _edges(spark, d)
    return edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()


_NODES = "no AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed)"


@query(f"WITH {_TEMPORAL}, {_NODES} SELECT node, rel, edge_id, row_number() OVER (PARTITION BY node, rel ORDER BY valid_to IS NOT NULL, stated_at DESC, edge_id) AS rank FROM bt JOIN no ON node = src OR node = dst WHERE rel IN ('purchase', 'error') QUALIFY rank <= 5")
def facts_about(spark, d):
    return temporal.facts_about(_resolved(spark, d), _nodes(spark, d), ["purchase", "error"], 5).select("node", "rel", "edge_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TEMPORAL}, {_NODES} SELECT DISTINCT node, edge_id FROM bt JOIN no ON node = src OR node = dst WHERE valid_to IS NULL")
def neighbors(spark, d):
    return temporal.touching(temporal.current(_resolved(spark, d)), _nodes(spark, d)).select("node", "edge_id")


@query(f"""WITH {_TEMPORAL}, cu AS (SELECT src, rel, edge_id AS current_edge, dst AS current_dst FROM bt WHERE valid_to IS NULL QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY stated_at DESC, edge_id) = 1),
ol AS (SELECT src, rel, edge_id FROM bt WHERE valid_to IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src ORDER BY stated_at DESC, edge_id) <= 4)
SELECT src, rel, edge_id, current_edge, current_dst FROM ol LEFT JOIN cu USING (src, rel)""")
def conflict_pairs(spark, d):
    return temporal.conflict_pairs(_resolved(spark, d), 4).select("src", "rel", "edge_id", "current_edge", "current_dst")


@query(f"WITH {_TEMPORAL} SELECT edge_id, src || ' ' || lower(replace(rel, '_', ' ')) || ' ' || dst || ' [' || CASE WHEN valid_to IS NOT NULL THEN 'until ' || strftime(valid_to, '%Y-%m-%d') WHEN contested THEN 'CONTESTED' ELSE 'current' END || '; ' || source || ']' AS line FROM bt")
def fact_lines(spark, d):
    line = temporal.fact_line(F.col("rel"), F.col("src"), F.col("dst"), F.col("valid_to"), F.col("contested"), F.col("source"))
    return _resolved(spark, d).select("edge_id", line.alias("line"))


@query("""SELECT o_orderkey::VARCHAR AS edge_id, depth, final_edge FROM (SELECT o_orderkey, count(*) OVER w - 1 AS depth, max(o_orderkey) OVER (PARTITION BY o_custkey)::VARCHAR AS final_edge
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE depth > 0""")
def supersession_chain(spark, d):
    """A customer's orders, each superseded by the next: chains of many steps."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return temporal.chains(_t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("edge_id"), after.cast("string").alias("superseded_by")))


# --- graph ---------------------------------------------------------------------------------------


def _places(spark, d) -> DataFrame:
    """Suppliers, customers, nations and regions as a graph."""
    c, n, s = _t(spark, d, "customer"), _t(spark, d, "nation"), _t(spark, d, "supplier")
    rows = [n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("PART_OF").alias("rel"), F.concat(F.lit("r"), "n_regionkey").alias("dst")), s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("IN").alias("rel"), F.concat(F.lit("n"), "s_nationkey").alias("dst")), c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.lit("IN").alias("rel"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("edge_id", F.concat_ws(">", "src", "dst"))


_PLACES = """pl AS (SELECT 'n' || n_nationkey AS src, 'PART_OF' AS rel, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'IN', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'IN', 'n' || c_nationkey FROM customer),
st AS (SELECT src AS f, dst AS t, src || '>' || dst AS e FROM pl UNION ALL SELECT dst, src, src || '>' || dst FROM pl),
p1 AS (SELECT f AS s, t AS n, [f, t] AS ns, [e] AS es FROM st), p2 AS (SELECT s, t AS n, list_append(ns, t) AS ns, list_append(es, e) AS es FROM p1 JOIN st ON n = f WHERE NOT list_contains(ns, t)),
p3 AS (SELECT s, t AS n, list_append(ns, t) AS ns, list_append(es, e) AS es FROM p2 JOIN st ON n = f WHERE NOT list_contains(ns, t))"""


def _node(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


_PATH = """SELECT s AS start, n AS "end", len(es) AS length, array_to_string(ns, '-') AS nodes, array_to_string(es, ',') AS edges"""


@query(f"WITH {_PLACES}, al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) {_PATH} FROM al WHERE s = 's1' AND n IN (SELECT 'n' || n_nationkey FROM nation) QUALIFY row_number() OVER (PARTITION BY s, n ORDER BY len(es), array_to_string(es, ',')) <= 10")
def paths_n_m(spark, d):
    found = graph.paths(_places(spark, d), _node(spark, "s1"), 3, _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")), 10)
    return found.select("start", "end", F.col("length").cast("long").alias("length"), F.array_join("nodes", "-").alias("nodes"), F.array_join("edges", ",").alias("edges"))


@query(f"WITH {_PLACES}, al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) {_PATH} FROM al WHERE s = 's3' QUALIFY row_number() OVER (PARTITION BY s ORDER BY len(es), array_to_string(es, ',')) <= 25")
def paths_single_source(spark, d):
    found = graph.paths(_places(spark, d), _node(spark, "s3"), 3, None, 25)
    return found.select("start", "end", F.col("length").cast("long").alias("length"), F.array_join("nodes", "-").alias("nodes"), F.array_join("edges", ",").alias("edges"))


@query(f"WITH {_PLACES}, al AS (SELECT s, n, 1 AS h FROM p1 UNION ALL SELECT s, n, 2 FROM p2 UNION ALL SELECT s, n, 3 FROM p3) SELECT s AS start, n AS node, min(h) AS hops FROM al WHERE s IN ('s1', 'r2') AND n <> s GROUP BY ALL")
def reachable_1_3(spark, d):
    return graph.reachable(_places(spark, d), _node(spark, "s1", "r2"), 3)


@query(f"""WITH {_PLACES}, se AS (SELECT unnest(['n1', 'n2', 'r1']) AS node), al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT src, dst FROM pl WHERE (rel = 'PART_OF' AND (src IN (FROM se) OR dst IN (FROM se))) OR src || '>' || dst IN (SELECT unnest(es) FROM al WHERE s IN (FROM se) AND n IN (FROM se))""")
def subgraph(spark, d):
    return graph.subgraph(_places(spark, d), _node(spark, "n1", "n2", "r1"), ["PART_OF"]).select("src", "dst")


def _entities(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    name = F.initcap(F.translate("c_name", "#", " "))
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("canonical_id"), F.when(F.col("c_custkey") % 5 == 0, "document").otherwise("person").alias("entity_type"), name.alias("canonical_name"), F.array(name, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")), name).alias("aliases"), F.array().cast("array<string>").alias("handles"), F.array(F.concat(F.lit("c"), "c_custkey", F.lit("@example.com"))).alias("emails"))


_ALIASES = """al AS (SELECT 'c' || c_custkey AS canonical_id, 'name' AS kind, replace(c_name, '#', ' ') AS surface FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'c' || c_custkey, 'name', trim(c_mktsegment) FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'c' || c_custkey, 'email', 'c' || c_custkey || '@example.com' FROM customer WHERE c_custkey % 5 <> 0)"""


@query(f"WITH {_ALIASES} SELECT canonical_id, kind, surface, 'al_' || substr(sha1(canonical_id || chr(31) || kind || chr(31) || surface), 1, 16) AS alias_id FROM al")
def alias_explode(spark, d):
    return graph.aliases(_entities(spark, d)).select("canonical_id", "kind", "surface", "alias_id")


@query(f"""WITH {_ALIASES}, a AS (SELECT unnest(['BUILDING', 'customer 000000010', 'c7@example.com']) AS name)
SELECT DISTINCT name, canonical_id FROM (SELECT name, canonical_id FROM a JOIN al ON lower(trim(name)) = lower(surface) UNION ALL SELECT name, 'c' || c_custkey FROM a JOIN customer ON lower(trim(name)) = lower(replace(c_name, '#', ' ')))""")
def find_entity(spark, d):
    e = _entities(spark, d)
    names = spark.createDataFrame([("BUILDING",), ("customer 000000010",), ("c7@example.com",)], "name string")
    return graph.find_entity(graph.nodes(e), graph.aliases(e), names)


@query(f"WITH {_ALIASES} SELECT canonical_id, string_agg(surface, '|' ORDER BY surface) FILTER (kind = 'name') AS names, string_agg(surface, '|' ORDER BY surface) FILTER (kind = 'email') AS emails FROM al GROUP BY 1 UNION ALL SELECT 'c' || c_custkey, NULL, NULL FROM customer WHERE c_custkey % 5 = 0")
def hydrate_entity(spark, d):
    e = _entities(spark, d)
    plain = graph.nodes(e).drop("aliases", "handles", "emails")
    return graph.hydrate(plain, graph.aliases(e)).select("canonical_id", F.array_join("names", "|").alias("names"), F.array_join("emails", "|").alias("emails"))


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Document' ELSE 'Person' END AS label, count(*) AS n FROM customer GROUP BY 1")
def graph_stats(spark, d):
    return graph.stats(graph.nodes(_entities(spark, d)), "label")


@query("""WITH n AS (SELECT 'c' || c_custkey AS id, ('0x' || substr(sha256('c' || c_custkey), 1, 16))::UBIGINT % 4611686018427387904 AS node_id FROM customer),
a AS (SELECT node_id AS k, count(*) AS m FROM n GROUP BY 1), b AS (SELECT node_id % 997 AS k, count(*) AS m FROM n GROUP BY 1)
SELECT (SELECT count(*) FROM a WHERE m > 1) AS collisions, (SELECT count(*) FROM b WHERE m > 1) AS coarse_collisions""")
def surrogate_collisions(spark, d):
    """Of the surrogates there are none; cut down to 997 values there must be many."""
    rows = graph.nodes(_entities(spark, d)).withColumn("coarse", F.col("node_id") % 997)
    count = lambda key, name: graph.collisions(rows, key, "canonical_id").agg(F.count("*").alias(name))
    return count("node_id", "collisions").crossJoin(count("coarse", "coarse_collisions"))


# --- questions -----------------------------------------------------------------------------------


@query("""WITH h(k, head) AS (VALUES (0, 'How many '), (1, 'What changed in '), (2, 'What is the connection between '), (3, ''), (4, 'What is the current owner of '), (5, 'Tell me who fixed '), (6, 'Which ones are '), (7, 'Is it up-to-date: ')),
q AS (SELECT item_id, lower(head || text) AS t FROM benchmark JOIN h ON item_id % 8 = k)
SELECT item_id, CASE WHEN list_bool_or(list_transform(['how many', 'how much', 'count', 'number of', 'list all', 'list every', 'all the', 'every ', 'total', 'which ones', 'name all', 'what are all'], lambda c: contains(t, c))) THEN 'aggregate'
WHEN list_bool_or(list_transform(['current', 'currently', 'now', 'still', 'changed', 'change', 'used to', 'previously', 'latest', 'up to date', 'up-to-date', 'no longer', 'anymore', 'which is correct', 'conflict', 'contradict', 'who owns', 'who is the owner', 'most recent', 'as of', 'today'], lambda c: contains(t, c))) THEN 'conflict'
WHEN list_bool_or(list_transform([' who ', 'through', 'connected', 'related to', 'linked', 'reported by', 'assigned to', 'worked on', 'involved in', 'responsible for', 'between', 'same ', 'both ', 'that also', 'which team', 'whose'], lambda c: contains(t, c))) THEN 'multihop' ELSE 'lookup' END AS route FROM q""")
def route_classify(spark, d):
    heads = ("How many ", "What changed in ", "What is the connection between ", "", "What is the current owner of ", "Tell me who fixed ", "Which ones are ", "Is it up-to-date: ")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("item_id") % 8 + 1).cast("int"))
    return _t(spark, d, "benchmark").select("item_id", agent.route(F.concat(head, "text")).alias("route"))


@query("SELECT p_partkey, 'ENG-' || p_partkey || '|PR#' || p_size || '|p' || p_partkey || '@parts.example.com|' || p_brand || '|jin.k|ENG|PR|Brand|Mei Chen' AS entities FROM part")
def question_entities(spark, d):
    asked = F.concat(F.lit("Who fixed ENG-"), "p_partkey", F.lit(" in PR #"), "p_size", F.lit(' for "'), "p_brand", F.lit('" with @jin.k and What Mei Chen wrote to p'), "p_partkey", F.lit("@parts.example.com?"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(agent.entities_of(asked), "|").alias("entities"))


@query()
def grade_and_answer(spark, d):
    """Each passage asked as a question: searched, given its facts' place empty, answered or declined."""
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = retrieval.hydrate(retrieval.bm25(_t(spark, d, "documents"), _asked(spark, d), agent.K), _t(spark, d, "documents"), 300)
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "title", "snippet", "score"))), lambda h: F.struct(h["doc_id"].alias("doc_id"), h["title"].alias("title"), h["snippet"].alias("snippet"), h["score"].alias("score"))).alias("hits"))
    empty = F.array().cast("array<struct<doc_id:string,title:string,snippet:string,score:double>>")
    gathered = asked.join(listed, "query_id", "left").select(F.col("query_id").alias("question_id"), "question", F.coalesce("hits", empty).alias("hits"), F.array().cast("array<string>").alias("facts"))
    return agent.answers(gathered).withColumn("document_ids", F.array_join("document_ids", ","))


# --- documents to facts --------------------------------------------------------------------------


@query()
def extract_mentions(spark, d):
    """Mentions of the documents, each source's rules by its number."""
    docs = _t(spark, d, "documents")
    kinds = F.array(*map(F.lit, extraction.RULES))
    title = F.substring_index("text", "\n", 1)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.element_at(kinds, (F.col("doc_id") % len(extraction.RULES) + 1).cast("int")).alias("source_type"), title.alias("title"), F.col("text").alias("body"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), T.emails(F.col("text")).alias("mention_refs"), F.create_map(F.lit("slug"), F.concat(F.lit("pr-"), "doc_id"), F.lit("cross_refs"), F.lit("")).alias("raw_metadata"))
    found = extraction.mentions(extraction.assertions(rows))
    return found.groupBy("entity_type").agg(F.count("*").alias("mentions"), F.count_distinct("mention_id").alias("distinct_mentions"))


def _normalized(spark, d, kind: str, slug, content, key: str, table: str, tasks: int | None = None) -> DataFrame:
    """Rows of a table written as files of a source, and normalized; in so many tasks, if given."""
    rows = _t(spark, d, table)
    files = (rows.repartition(tasks) if tasks else rows).select(F.lit("p").alias("path"), F.lit(kind).alias("source_type"), F.col(key).cast("string").alias("doc_id"), slug.alias("slug"), content.alias("content"))
    return sources.normalize(files)


def _said(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


@query("""SELECT c_custkey::VARCHAR AS doc_id, 'Order of ' || c_custkey AS title, 'Re: ' || c_mktsegment AS thread_id, 'Mei Chen ' || 'c' || c_custkey || '|' || 'c' || c_custkey || '@mail.example.com' AS author_refs,
'Ops Desk|ops@home.example|jin@home.example|' || 'c' || c_custkey || '@mail.example.com' AS mention_refs, make_timestamp(2024, 1, (1 + c_custkey % 28)::BIGINT, 9, (c_custkey % 60)::BIGINT, 0) AS stated, 'ENG-' || c_custkey || ',PR#' || c_nationkey AS cross_refs FROM customer""")
def normalize_mail(spark, d):
    """Customers as mails: folded names, addresses, a date with a zone that is dropped, references in the body."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    clock = F.concat(F.lit("09:"), F.lpad((c % 60).cast("string"), 2, "0"))
    content = _said("Order of ", c, "\r\nFrom: Mei Chen c", c, " <c", c, "@mail.example.com>\nTo: Ops Desk <ops@home.example>, jin@home.example\nDate: Mon, ", (1 + c % 28).cast("string"), " Jan 2024 ", clock, ":00 +0530\nSubject: Re: ", F.col("c_mktsegment"), "\n\nSee ENG-", c, ", PR #", n, " and ENG-", c, " again.")
    out = _normalized(spark, d, "gmail", F.lit("mail"), content, "c_custkey", "customer")
    return out.select("doc_id", "title", "thread_id", F.array_join("author_refs", "|").alias("author_refs"), F.array_join("mention_refs", "|").alias("mention_refs"), F.col("timestamp").alias("stated"), F.col("raw_metadata")["cross_refs"].alias("cross_refs"))


@query("""SELECT p_partkey::VARCHAR AS doc_id, '#parts-' || p_size AS channel, 'lena.s|Jo K' AS author_refs, 'Runtime' AS teams, 'lena.s|Jo K|bot-' || p_size AS mention_refs FROM part""")
def normalize_chat(spark, d):
    """Parts as threads: speakers by their shape or by recurring, labels that are none, teams and mentions."""
    content = _said("#parts-", F.col("p_size"), "\nlena.s (Runtime): is ", F.col("p_name"), " there?\nJo K: yes, ask @bot-", F.col("p_size"), "\nRollout: today\nFAQ: none\nFAQ: still none\nlena.s: thanks")
    out = _normalized(spark, d, "slack", F.lit("chat"), content, "p_partkey", "part")
    return out.select("doc_id", F.col("raw_metadata")["channel"].alias("channel"), F.array_join("author_refs", "|").alias("author_refs"), F.col("raw_metadata")["teams"].alias("teams"), F.array_join("mention_refs", "|").alias("mention_refs"))


def _issue_rows(spark, d, tasks: int | None = None) -> DataFrame:
    p = F.col("p_partkey")
    content = _said("Broken ", F.col("p_name"), "\nOwner: Mei Chen\nReporter (Sam Lee): it fails since 2024-03-0", (1 + p % 9).cast("string"), "T10:30\nTaken by Ana Diaz (SRE). See SUP-", F.col("p_size"), " and pr #", p, " of ff_20240101_ab12.")
    return _normalized(spark, d, "jira", _said("ENG-", p, "-broken"), content, "p_partkey", "part", tasks)


@query("""SELECT p_partkey::VARCHAR AS doc_id, make_timestamp(2024, 3, (1 + p_partkey % 9)::BIGINT, 10, 30, 0) AS stated, 'Reporter' AS author_refs, 'Reporter|Ana Diaz|Sam Lee|SRE' AS mention_refs,
'SUP-' || p_size || ',ENG-' || p_partkey || ',PR#' || p_partkey || ',ff_20240101_ab12' AS cross_refs FROM part""")
def normalize_issue(spark, d):
    """Parts as tickets: pairs of people and roles in either order, a date in the text, references of three kinds."""
    return _issue_rows(spark, d).select("doc_id", F.col("timestamp").alias("stated"), F.array_join("author_refs", "|").alias("author_refs"), F.array_join("mention_refs", "|").alias("mention_refs"), F.col("raw_metadata")["cross_refs"].alias("cross_refs"))


@query("""WITH x AS (SELECT p_partkey::VARCHAR AS d, 'Broken ' || p_name AS t, 'ENG-' || p_partkey AS e, 'SUP-' || p_size AS s, 'PR#' || p_partkey AS pr FROM part)
SELECT doc_id, src, rel, dst FROM (SELECT d AS doc_id, unnest([{'src': e, 'rel': 'PART_OF', 'dst': 'ENG'}, {'src': e, 'rel': 'RELATES_TO', 'dst': s}, {'src': t, 'rel': 'REFERENCES', 'dst': e}, {'src': e, 'rel': 'PART_OF', 'dst': 'ENG'}, {'src': t, 'rel': 'REFERENCES', 'dst': s}, {'src': s, 'rel': 'PART_OF', 'dst': 'SUP'},
{'src': t, 'rel': 'REFERENCES', 'dst': pr}, {'src': t, 'rel': 'REFERENCES', 'dst': 'ff_20240101_ab12'}, {'src': 'Mei Chen', 'rel': 'OWNS', 'dst': e}, {'src': 'Ana Diaz', 'rel': 'HAS_ROLE', 'dst': 'SRE'}], recursive := true) FROM x)""")
def extract_issue_facts(spark, d):
    """The relations that the rules for tickets find.

    A part becomes some 20 mentions, so a small file is dealt to all tasks first. Spark estimates mentions by the size of
    that file and would broadcast them; the joins are hinted.
    """
    said = extraction.assertions(_issue_rows(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = extraction.relations(said)
    named = extraction.mentions(said).select("mention_id", "surface_form").distinct()
    src, dst = (named.select(F.col("mention_id").alias(f"{s}_mention_id"), F.col("surface_form").alias(s)).hint("merge") for s in ("src", "dst"))
    return found.join(src, "src_mention_id").join(dst, "dst_mention_id").select("doc_id", "src", "rel", "dst")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'alias' WHEN 1 THEN 'bot' WHEN 2 THEN 'role' WHEN 3 THEN 'organization' WHEN 4 THEN 'person' WHEN 5 THEN 'person' WHEN 6 THEN NULL ELSE NULL END AS kind FROM part""")
def classify_surfaces(spark, d):
    """Surface forms of every kind, those of two words in the vocabulary among them."""
    forms = (_said("p", F.col("p_partkey"), "@x.example.com"), F.lit("triage-bot"), F.lit("Runtime Oncall"), _said("Acme", F.col("p_partkey"), " Labs"), F.lit("Mei Chen"), F.lit("lena.s"), F.lit("Recent activity"), F.lit("Rollout"))
    at = (F.col("p_partkey") % 8 + 1).cast("int")
    return _t(spark, d, "part").select("p_partkey", extraction.classify(F.element_at(F.array(*forms), at)).alias("kind"))


@query("""SELECT p_partkey, 'ENG-' || p_partkey || ',SUP-' || p_size AS tickets, 'PR#' || p_size AS pulls, 'ff_20240101_0a' AS meetings, 'ENG' AS project, regexp_matches('l_' || p_partkey, '^[A-Za-z_]') AS safe, false AS unsafe, '{"k": ' || p_size || '}' AS inside,
printf('%.1f%%', p_size / 10.0::DOUBLE) AS share FROM part""")
def text_rules(spark, d):
    """Identifiers, labels, JSON inside talk, and shares as text."""
    p, z = F.col("p_partkey"), F.col("p_size")
    blob = _said("SUP-", z, " then ENG-", p, ", PR#", z, " pr # PR #", z, " in ff_20240101_0a; ENG-", p)
    return _t(spark, d, "part").select(
        "p_partkey",
        F.array_join(T.ticket_ids(blob), ",").alias("tickets"),
        F.array_join(T.pull_request_ids(blob), ",").alias("pulls"),
        F.array_join(T.meeting_ids(blob), ",").alias("meetings"),
        T.project_of(_said("eng-", p)).alias("project"),
        T.is_identifier(_said("l_", p)).alias("safe"),
        T.is_identifier(_said("l-", p)).alias("unsafe"),
        T.json_inside(_said("Sure:\n```json\n{\"k\": ", z, "}\n``` done")).alias("inside"),
        T.percent(z / 1000).alias("share"),
    )


@query("""SELECT 'n' || n_nationkey AS src, 'PART_OF' AS rel, 'r' || n_regionkey AS dst, 'Document' AS src_label, 'Team' AS dst_label, n_nationkey % 2 = 0 AS is_current FROM nation WHERE n_regionkey <> 3""")
def edge_rows(spark, d):
    """Edges whose ends are known, with both labels; those to region 3, which is no node, go."""
    n, g = _t(spark, d, "nation"), _t(spark, d, "region").where("r_regionkey <> 3")
    entity = lambda key, kind, name: [key.alias("canonical_id"), F.lit(kind).alias("entity_type"), name.alias("canonical_name")]
    known = n.select(*entity(_said("n", F.col("n_nationkey")), "document", F.col("n_name"))).unionByName(g.select(*entity(_said("r", F.col("r_regionkey")), "team", F.col("r_name"))))
    edges = n.select(_said("n", F.col("n_nationkey")).alias("src"), F.lit("PART_OF").alias("rel"), _said("r", F.col("n_regionkey")).alias("dst"), F.when(F.col("n_nationkey") % 2 == 1, F.lit("2024-01-01")).alias("valid_to"))
    return graph.edge_rows(edges, known).select("src", "rel", "dst", "src_label", "dst_label", "is_current")


@query("""SELECT src, dst FROM (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, s_nationkey AS n, s_suppkey AS k FROM supplier) WHERE n < 10 AND k % 2 = 0""")
def edges_within(spark, d):
    """Edges both of whose ends were returned."""
    s = _t(spark, d, "supplier")
    edges = s.select(_said("s", F.col("s_suppkey")).alias("src"), _said("n", F.col("s_nationkey")).alias("dst"))
    ends = s.where("s_suppkey % 2 = 0").select(_said("s", F.col("s_suppkey")).alias("node")).unionByName(_t(spark, d, "nation").where("n_nationkey < 10").select(_said("n", F.col("n_nationkey")).alias("node")))
    return graph.within(edges, ends)


@query("""SELECT l_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey::VARCHAR) AS l FROM lineitem GROUP BY 1)""")
def path_citations(spark, d):
    """The documents of a path's steps, each once, in order of the steps."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("doc")))), lambda x: F.array(x["doc"]))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(steps.alias("steps")).select("l_orderkey", F.array_join(graph.citations(F.col("steps")), ",").alias("cited"))


@query("""SELECT p_partkey, 'c_' || substr(sha1(kind || chr(31) || CASE WHEN kind = 'document' THEN p_partkey::VARCHAR ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9@._+\\-]+', ' ', 'g')) END), 1, 16) AS canonical_id
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'document' WHEN p_partkey % 3 = 1 THEN 'team' ELSE 'ticket' END AS kind FROM part)""")
def clusters_by_key(spark, d):
    """Types that are told apart by their normalized surface, documents by their id."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "document").when(F.col("p_partkey") % 3 == 1, "team").otherwise("ticket")
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("doc_id"), kind.alias("entity_type"), F.upper("p_brand").alias("surface"))
    return linkage.by_key(rows).select("p_partkey", "canonical_id")


@query("""WITH c AS (SELECT DISTINCT p_brand AS name, p_partkey AS id FROM part), g AS (SELECT DISTINCT s_nationkey AS grp, s_suppkey AS id FROM supplier), n AS (SELECT DISTINCT n_nationkey AS grp, p_brand AS name FROM nation, part),
m AS (SELECT n.grp, n.name, c.id, g.id IS NOT NULL AS here FROM n JOIN c USING (name) LEFT JOIN g ON g.grp = n.grp AND g.id = c.id)
SELECT grp AS "group", name, CASE WHEN count(*) FILTER (here) = 1 THEN max(id) FILTER (here) ELSE max(id) END AS id FROM m GROUP BY ALL HAVING count(*) FILTER (here) = 1 OR count(*) = 1""")
def disambiguated_names(spark, d):
    """A name's candidates, told apart by what the context holds: exactly one hit wins."""
    candidates = _t(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id")).distinct()
    names = _t(spark, d, "nation").select(F.col("n_nationkey").alias("group")).crossJoin(F.broadcast(candidates.select("name").distinct()))
    context = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("id")).distinct()
    return linkage.disambiguated(names, candidates, context)


@query("""SELECT o_orderkey, coalesce(o_orderkey % 3 = 0, false) AND (starts_with(CASE o_orderkey % 4 WHEN 0 THEN 'router error: x' WHEN 1 THEN '' ELSE 'weak evidence' END, 'router error') OR (o_orderkey % 4 = 1 AND o_orderkey % 5 = 0)) AS failed FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def failed_traces(spark, d):
    """Abstentions that came from an error, for the chosen types of question."""
    k = F.col("o_orderkey")
    reason = F.when(k % 4 == 0, "router error: x").when(k % 4 == 1, "").otherwise("weak evidence")
    return _t(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", evaluation.failed(k % 3 == 0, reason, (k % 5).cast("int")).alias("failed"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem) SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS src, 's' || (l_partkey % 50) AS dst FROM l WHERE l_suppkey <> l_partkey % 50 AND l_suppkey % 7 <> 0""")
def lifted_relations(spark, d):
    """Relations between mentions as relations between entities: loops and unresolved ends go."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _said("m", F.col("l_suppkey")).alias("src_mention_id"), _said("x", F.col("l_partkey") % 50).alias("dst_mention_id"))
    ids = rows.select(F.col("src_mention_id").alias("mention_id")).distinct().where("cast(substr(mention_id, 2) AS long) % 7 <> 0").unionByName(rows.select(F.col("dst_mention_id").alias("mention_id")).distinct())
    return temporal.lift(rows, ids.withColumn("canonical_id", F.concat(F.lit("s"), F.substring("mention_id", 2, 20)))).select("l_orderkey", "l_linenumber", "src", "dst")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def limited_edges(spark, d):
    """The first hundred by a stated order: a report's head."""
    return _t(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


# --- streams -------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_events_tumbling(spark, d):
    return S.drained(S.tumbling(S.read_events(spark, d)), "complete", f"tumbling_{uuid.uuid4().hex}")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedupe_watermark(spark, d):
    return S.drained(S.once(S.read_events(spark, d)), "append", f"once_{uuid.uuid4().hex}").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, isl, count(*) FILTER (bad) AS n FROM m GROUP BY ALL) GROUP BY user_id""")
def stream_streak_state(spark, d):
    out = S.drained(S.longest_streaks(S.read_events(spark, d)), "update", f"streaks_{uuid.uuid4().hex}")
    return out.groupBy("user_id").agg(F.max("longest").alias("longest"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Complete mode gives the sessions that the stream's end leaves open, too."""
    return S.drained(S.sessions(S.read_events(spark, d)), "complete", f"sessions_{uuid.uuid4().hex}")
