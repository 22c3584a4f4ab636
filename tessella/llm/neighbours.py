"""Nearest neighbours by an inverted file of coarse centroids with product-quantised residuals and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, ship, table

#: The bound of the sample that centroids and codebooks are fitted on.
SAMPLE = 16_384
#: Sub-vectors, and codewords of each.
PARTS, WORDS = 16, 256
#: A query looks into so many lists that they hold this share of the nearest neighbours within the sample, and into so
#: many at least. Vectors in clusters need few; vectors without clusters need more than half of all.
FOUND, PROBE_LEAST = 0.975, 16
#: Vectors of the sample that this is measured with.
MEASURED = 256
#: Candidates by table distance that are measured exactly, for each neighbour wanted.
RERANK = 40
#: Index entries in one task, about: a block is some lists that lie near each other, or a part of a large one.
BLOCK = 16_384


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids by Lloyd's rounds; an empty one starts again at a random vector."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(at, x[:, j], len(c)) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = ((c * c).sum(1)[None] - 2 * x[at : at + 4096] @ c.T).argmin(1)
    return out


class Index:
    """Coarse centroids and codebooks of residuals; small, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, count: int, k: int = 10):
        rng = np.random.default_rng(7)
        lists = int(min(4096, max(1, round(count**0.5)), max(1, len(sample) // 8)))
        self.coarse = _lloyd(sample, lists, 8, rng)
        residual = sample - self.coarse[_nearest(sample, self.coarse)]
        cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        self.books = [_lloyd(residual[:, p], WORDS, 8, rng) for p in self.parts]
        self.probes = min(lists, max(PROBE_LEAST, self._needed(sample, k)))

    def _needed(self, sample: np.ndarray, k: int) -> int:
        """How many lists, nearest first, hold FOUND of the k nearest of some of the sample's vectors."""
        own, ranks = _nearest(sample, self.coarse), []
        for q in sample[:MEASURED]:
            away = ((sample - q) ** 2).sum(1)
            near = np.argsort(away, kind="stable")[1 : k + 1]
            rank = np.empty(len(self.coarse), np.int64)
            rank[np.argsort(((self.coarse - q) ** 2).sum(1), kind="stable")] = np.arange(len(self.coarse))
            ranks.append(rank[own[near]])
        ranks = np.sort(np.concatenate(ranks))
        return int(ranks[min(len(ranks) - 1, int(FOUND * len(ranks)))]) + 1 if len(ranks) else 1

    def deal(self, sizes: np.ndarray) -> None:
        """Blocks of lists: `first` and `parts` say which blocks hold a list of the given size."""
        groups = _nearest(self.coarse, _lloyd(self.coarse, max(1, len(self.coarse) // 16), 4, np.random.default_rng(7)))
        self.first, self.parts_of = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        block = held = 0
        for at in np.argsort(groups, kind="stable"):
            if held and held + sizes[at] > BLOCK:
                block, held = block + 1, 0
            self.first[at], self.parts_of[at] = block, max(1, -(-int(sizes[at]) // BLOCK))
            block, held = (block + self.parts_of[at], 0) if self.parts_of[at] > 1 else (block, held + sizes[at])

    def blocks_of(self, q: np.ndarray) -> np.ndarray:
        """The blocks of the lists that a query looks into."""
        at = np.flatnonzero(np.isfinite(self.tables(q)[0]))
        return np.unique(np.concatenate([np.arange(f, f + n) for f, n in zip(self.first[at], self.parts_of[at])]))

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its residual's codewords."""
        at = _nearest(x, self.coarse)
        residual = x - self.coarse[at]
        return at, np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)

    def bias(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What of a coded vector's squared distance to any query depends on the vector alone."""
        out = np.zeros(len(at))
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            word = b[code[:, j]]
            out += (word * word).sum(1) + 2 * (self.coarse[at][:, p] * word).sum(1)
        return out

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A query's squared distances to the lists it looks into (infinite for others), and its products with all codewords by part."""
        near = ((q - self.coarse) ** 2).sum(1)
        if self.probes < len(near):
            near[np.argpartition(near, self.probes)[self.probes :]] = np.inf
        products = np.zeros((len(self.parts), WORDS))
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            products[j, : len(b)] = b @ q[p]
        return near, products


def _usable(v: Column) -> Column:
    """Not null or zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _coded(index: Index):
    schema = pa.schema([("list", pa.int32()), ("class_id", pa.int64()), ("code", pa.binary()), ("bias", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, code = index.code(_matrix(batch.column(1)))
                yield pa.record_batch([pa.array(at.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(index.bias(at, code))], schema=schema)

    return run, "list int, class_id long, code binary, bias double"


def _asked(index: Index):
    """A query for each block that holds lists that it looks into, and how many those are."""
    schema = pa.schema([("query_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("block", pa.int64()), ("blocks", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, vector in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                to = index.blocks_of(vector)
                yield pa.record_batch([pa.array(np.full(len(to), batch.column(0)[i].as_py())), pa.array([vector] * len(to), pa.list_(pa.float64())), pa.array(to), pa.array(np.full(len(to), len(to)))], schema=schema)

    return run, "query_id long, vector array<double>, block long, blocks long"


def _scanned(index: Index, wanted: int, least: int):
    """A query's best codes of one block by its distance tables: `least`, and its share of `wanted`."""
    schema = pa.schema([("query_id", pa.int64()), ("class_id", pa.int64()), ("near", pa.float64())])

    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if queries.num_rows and codes.num_rows:
            code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            lists, ids, bias = (codes.column(c).to_numpy() for c in ("list", "class_id", "bias"))
            part = np.arange(code.shape[1])
            for q, vector, blocks in zip(queries.column("query_id").to_numpy(), _matrix(queries.column("vector").combine_chunks()), queries.column("blocks").to_pylist()):
                away, products = index.tables(vector)
                most = wanted // blocks + least
                at = np.flatnonzero(np.isfinite(away[lists]))
                near = away[lists[at]] + bias[at] - 2 * products[part, code[at]].sum(1)
                best = np.argpartition(near, most - 1)[:most] if len(near) > most else np.arange(len(near))
                out.append(pa.table([np.full(len(best), q), ids[at[best]], near[best]], schema=schema))
        return pa.concat_tables(out)

    return run, "query_id long, class_id long, near double"


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, components in order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding; other columns are ignored) that
    `queries` holds for, the k nearest other rows found, nearest first, ties to the smaller vec_id.

    Equal vectors are one entry of the index, which keeps the k + 1 smallest vec_ids of each, as no query can use more;
    so a vector that a third of all rows have is one entry too. Every entry is in the index; centroids and codebooks
    are fitted on SAMPLE entries with the smallest hashes, and so is the number of nearest lists that a query looks
    into. Queries go only to blocks that hold such a list. Table distances choose RERANK * k entries, which are then
    measured exactly; a block gives twice its share of them. With few vectors every list is looked into.

    Vectors that are null, zero, or hold nulls, NaN or infinities, and rows without vec_id take no part; nor do vectors
    whose length isn't the most common (of equals, the longest). A repeated vec_id is one vector: the smallest. Empty table or no query: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = queries
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vector") == sizes["size"])
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vec_id", "vector").withColumn("n", F.row_number().over(same)).where(f"n <= {k + 1}")
    classes = materialize(few.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("members")).select("class_id", "vector", "members"), "classes")
    count = classes.count()
    sample = np.array([r["vector"] for r in classes.orderBy(F.xxhash64("class_id", F.lit(7)), "class_id").select("vector").limit(SAMPLE).collect()])
    index = Index(sample, count, k)
    run, schema = _coded(index)
    codes = materialize(classes.select("class_id", "vector").mapInArrow(lean(run), schema), "codes")
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in codes.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    index.deal(sizes)
    places = spark.createDataFrame(list(zip(range(len(sizes)), index.first.tolist(), index.parts_of.tolist())), "list int, first long, parts long")
    codes = codes.join(F.broadcast(places), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("class_id"), F.col("parts"))).drop("first", "parts")
    mine = rows.where("asked").select(F.col("vec_id").alias("query_id"), "vector")
    run, schema = _asked(index)
    asking = mine.mapInArrow(lean(run), schema)
    run, schema = _scanned(index, 2 * RERANK * k, k)
    found = asking.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(run, schema)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "class_id"))).where(f"n <= {RERANK * k}").select("query_id", "class_id")
    best = materialize(best, "candidates")
    exact = best.join(mine.withColumnRenamed("vector", "q"), "query_id").join(classes, "class_id")
    pairs = exact.select("query_id", distance(F.col("q"), F.col("vector")).alias("score"), F.explode("members").alias("vec_id")).where("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op5_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table; queries are the rows whose vec_id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
