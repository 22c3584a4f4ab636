"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, lean, materialize, mix64, signed, spare, table, text_chunks, texts, word_hashes, word_spans
from .graph import components

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Two-bit coordinates that may differ before a pair is set aside: at similarity 0.8 the mean is 19.2, this is 6.4 standard deviations more.
MAX_DIFFER = 45
#: One-bit coordinates of the second sketch, and how many may differ: at similarity 0.8 the mean is 102.4, this is 6.4 standard deviations more.
SKETCH, SKETCH_DIFFER = 1024, 164

_U = np.uint64
_STEP = Rolling(0x9E3779B97F4A7C15 | 1)
_SHIFT = np.arange(SKETCH, dtype=np.uint32)[:, None]


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    starts, ends, of = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    for i in range(len(of) - 1):
        lo, hi = of[i], of[i + 1]
        if hi == lo:
            yield np.zeros(0, _U)
            continue
        at = np.arange(lo, max(lo + 1, hi - width + 1))
        block = words[lo:hi]
        size = min(width, hi - lo)
        total = np.zeros(len(at), _U)
        for j in range(size):
            total = total * _U(0xD6E8FEB86659FD93) + block[j : j + len(at)]
        yield np.unique(mix64(total + _U(size)))


def circulant_signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """All coordinates from two permutations of the 32-bit ring: the first reorders the shingles once, the second is
    looked up at places shifted by the coordinate's number."""
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    first = (shingles >> _U(32)).astype(np.uint32)
    step = max(1, 131_072 // coordinates)
    for at in range(0, len(first), step):
        x = first[None, at : at + step] + _SHIFT[:coordinates]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(_U)
    key = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(ROWS):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def _two_bits(signature: np.ndarray) -> np.ndarray:
    bits = (signature & np.uint32(3)).astype(_U).reshape(4, 32) << (np.arange(32, dtype=_U) * _U(2))
    return bits.sum(axis=1, dtype=_U)


def _fingerprints(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64())), *((f"w{j}", pa.int64()) for j in range(4))])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            sizes, hashes, keys, bits = [], [], [], []
            for s in _sets(data, offsets, width):
                n = len(s)
                sizes.append(n)
                hashes.append((np.bitwise_xor.reduce(mix64(s)) if n else _U(0), mix64(s + _U(n)).sum(dtype=_U) if n else _U(0)))
                signature = circulant_signature(s)
                keys.append(_band_keys(signature) if n else np.zeros(0, _U))
                bits.append(_two_bits(signature))
            h, w = np.array(hashes, _U), np.array(bits, _U)
            listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), signed(np.concatenate(keys)))
            yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), signed(h[:, 0]), signed(h[:, 1]), listed, *(signed(w[:, j]) for j in range(4))], schema=schema)

    return run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, w0 long, w1 long, w2 long, w3 long"


def _full_sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            found = list(_sets(data, offsets, width))
            h = np.array([(np.bitwise_xor.reduce(mix64(s)) if len(s) else _U(0), mix64(s + _U(len(s))).sum(dtype=_U) if len(s) else _U(0)) for s in found], _U)
            yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")), signed(h[:, 0]), signed(h[:, 1]), pa.array([s.tobytes() for s in found], pa.binary())], schema=schema)

    return run, "doc_id long, s1 long, s2 long, shingles binary"


def _linked(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "x", "y"))
            keep = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U)
                if len(p) < len(q):
                    p, q = q, p
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                same = int((p[at] == q).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([a.filter(mask), b.filter(mask)], schema=schema)

    return run, "a long, b long"


def _close(x: str, y: str, percent: int, most: int | None) -> F.Column:
    """Sizes allow the similarity, and at most so many of the two-bit coordinates differ, if a number is given."""
    least, greatest = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    sizes = 100 * least >= percent * greatest
    if most is None:
        return sizes
    differ = None
    for j in range(4):
        bits = F.col(f"{x}.w{j}").bitwiseXOR(F.col(f"{y}.w{j}"))
        count = F.bit_count((bits.bitwiseOR(F.shiftrightunsigned(bits, 1))).bitwiseAND(F.lit(0x5555555555555555)))
        differ = count if differ is None else differ + count
    return sizes & (differ <= most)


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(class_id, shingles) of the classes in ids (class_id, s1, s2), from their whole texts. The merge hint keeps the plan alike at every size."""
    run, schema = _full_sets(width)
    wanted = ids.withColumnRenamed("class_id", "doc_id")
    sets = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id").mapInArrow(lean(run), schema)
    return materialize(sets.join(wanted, ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("class_id"), "shingles"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets are similar enough."""
    run, schema = _linked(percent)
    return (
        pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y")), "b")
        .mapInArrow(lean(run), schema)
        .distinct()
    )


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(class_id, own): how many of a class's shingles no other class in `sets` has."""
    schema = pa.schema([("shingle", pa.int64()), ("class_id", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, found = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                s = np.frombuffer(found[i].as_buffer(), np.int64)
                for at in range(0, len(s), 1 << 16):
                    part = s[at : at + (1 << 16)]
                    yield pa.record_batch([pa.array(part), pa.array(np.full(len(part), ids[i].as_py()))], schema=schema)

    rows = sets.select("class_id", "shingles").mapInArrow(lean(run), "shingle long, class_id long")
    lone = rows.groupBy("shingle").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("last")).where("class_id = last")
    return lone.groupBy("class_id").agg(F.count("*").alias("own"))


def _sketched(batches):
    """class_id and the 1024 one-bit coordinates of its set, in 16 longs."""
    for batch in batches:
        found = [circulant_signature(np.frombuffer(x.as_buffer(), _U), SKETCH) & np.uint32(1) for x in batch.column(1)]
        if found:
            bits = np.packbits(np.array(found, np.uint8), axis=1).view(np.int64)
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(SKETCH // 64))], names=["class_id", *(f"z{j}" for j in range(SKETCH // 64))])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, most_differ: int | None = MAX_DIFFER, sketch_differ: int | None = SKETCH_DIFFER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Words are lower-cased (A-Z) and split at ASCII white space; a document is its set of distinct `width`-word
    shingles, or of its one shorter sequence. Documents are linked when 100 * intersection >= percent * union.
    Equal sets are one class. Classes meet in bands of the circulant signature. Within a bucket each class is first
    checked against the one with the fewest shingles of its own; what these verified links join is one component, and
    only classes that a bucket holds outside its main component are then checked against the others there. A pair is
    left out only where sizes, signatures, or shingles that no other class has rule the similarity out, and is looked
    at in one of its buckets. So a group of
    copies costs rows in proportion to its size, and yet no link between two components goes unchecked. A link of
    exactly similarity 0.8 fails to share any of 32 bands of 4 with probability 5e-8. The signatures' cut-offs lose such
    a pair with probability 1e-10 each; with most_differ and sketch_differ None, only what cannot be similar by its
    sizes and shared shingles is left out.

    Null or wordless texts: n_shingles 0, linked with nothing, kept. Null doc_id: linked with nothing, component_id
    null, kept. Rows that repeat a doc_id share its component. Empty table: no rows.
    """
    docs = texts(docs)
    run, schema = _fingerprints(width)
    prints = materialize(docs.mapInArrow(lean(run), schema), "prints")
    real = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    ids = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"))
    columns = ["n_shingles", "keys", *(f"w{j}" for j in range(4))]
    first = real.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").alias("class_id"), *columns)).alias("at"))
    classes = materialize(first.select("s1", "s2", "at.*"), "classes")
    keyed = classes.select("class_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least < most").select("key")
    buckets = materialize(keyed.join(shared, "key").join(classes.drop("keys", "s1", "s2"), "class_id"), "buckets")
    sets = _sets_of(classes.select("class_id", "s1", "s2").join(buckets.select("class_id").distinct(), "class_id"), docs, width)
    common = F.col("n_shingles") - F.coalesce("own", F.lit(0))
    buckets = buckets.join(_own_shingles(sets), "class_id", "left").withColumn("common", common).drop("own")
    buckets = materialize(buckets.where(100 * F.col("common") >= percent * F.col("n_shingles")), "buckets")
    same = F.least("m.common", "c.common")
    able = (100 * same >= percent * (F.col("m.n_shingles") + F.col("c.n_shingles") - same)) & _close("m", "c", percent, most_differ)
    centers = buckets.groupBy("key").agg(F.max_by(F.struct(*buckets.columns), F.struct(F.col("common") / F.col("n_shingles"), F.col("class_id"))).alias("at")).select("at.*")
    star = buckets.alias("m").join(centers.alias("c"), (F.col("m.key") == F.col("c.key")) & (F.col("m.class_id") != F.col("c.class_id")) & able)
    star = materialize(star.select(F.col("c.class_id").alias("a"), F.col("m.class_id").alias("b")).distinct(), "pairs")
    links = materialize(_verified(star, sets, percent), "links")
    label = materialize(components(links), "labels")
    named = buckets.join(label.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    counts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = materialize(named.join(main, "key"), "mixed")
    if sketch_differ is not None:
        left = mixed.select("class_id").distinct()
        sketches = sets.join(left, "class_id").select("class_id", "shingles").mapInArrow(lean(_sketched), "class_id long, " + ", ".join(f"z{j} long" for j in range(SKETCH // 64)))
        mixed = mixed.join(sketches, "class_id")
        differ = sum((F.bit_count(F.col(f"m.z{j}").bitwiseXOR(F.col(f"c.z{j}"))) for j in range(SKETCH // 64)), F.lit(0))
        able = able & (differ <= sketch_differ)
    mixed = materialize(mixed.join(classes.select("class_id", "keys"), "class_id"), "mixed")
    once = F.array_min(F.array_intersect("m.keys", "c.keys")) == F.col("m.key")
    cross = mixed.where("component != main").alias("m").join(mixed.alias("c"), (F.col("m.key") == F.col("c.key")) & (F.col("m.component") != F.col("c.component")) & able & once)
    cross = cross.select(F.least("m.class_id", "c.class_id").alias("a"), F.greatest("m.class_id", "c.class_id").alias("b")).distinct()
    more = _verified(materialize(cross, "pairs"), sets, percent)
    label = components(links.unionByName(more)).withColumnRenamed("node", "class_id")
    out = prints.select("doc_id", "n_shingles", "s1", "s2").join(ids, ["s1", "s2"], "left").join(label, "class_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the smallest doc_id; all columns stay, whatever their names.

    Rows that repeat a doc_id are one document: the first by text stays. Rows without doc_id all stay, and so do
    documents without words, each by itself. Empty table: no rows.
    """
    id_, n = spare(docs, "_id", "_n")
    kept = near_duplicates(docs, width, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_)).distinct()
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col(id_))
    first = named.withColumn(n, F.row_number().over(Window.partitionBy(id_).orderBy("text"))).where(F.col(n) == 1)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return first.select(*own).unionByName(docs.where("doc_id IS NULL").select(*own))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table with shingles of four words at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
