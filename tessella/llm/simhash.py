"""Document fingerprints: 128-bit SimHash with DataFrame functions alone."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, texts

#: Terms voted on together; a lane of 16 bits holds their weights, which are at most 7.
CHUNK = 8_192
#: Bits of the 128 in which near copies of the registered query may differ, from measured distances: nine of ten texts of
#: 300 words with one word changed are to be found; README.md has the shares.
RADIUS = 8
LANES = 0x0001000100010001
_HALVES = ("x", "y")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _terms(text: Column) -> Column:
    """Pairs of neighbouring words (the last word alone) as (hash, weight); long words weigh more."""
    words = F.split(F.lower(text), r"\s+")
    after = F.slice(words, 2, 2_000_000_000)
    return F.zip_with(words, after, lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), (1 + F.least(F.length(a), F.lit(24)) / 4).cast("long").alias("w")))


def _voted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, x, y (the fingerprint's halves) for rows whose keys are unique.

    Every term's 128-bit hash votes with its weight for or against each bit. Votes are summed in 16-bit lanes, four to
    a long, for CHUNK terms of a text at a time, and then over the chunks. Where the rows are dealt by one of the keys
    already, nothing is shuffled. Null or empty texts have the one empty term.
    """
    terms = rows.select(*keys, F.posexplode(_terms(F.coalesce(F.col(text), F.lit("")))).alias("at", "term"))
    votes = terms.select(*keys, F.floor(F.col("at") / CHUNK).cast("int").alias("part"), F.col("term.w").alias("w"), F.col("term.h").alias("x"), F.xxhash64(F.col("term.h"), F.lit(1)).alias("y"))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}{i}") for h in _HALVES for i in range(16)]
    chunks = votes.groupBy(*keys, "part").agg(F.sum("w").alias("w"), *sums)
    lanes = [F.sum(F.shiftrightunsigned(f"{h}{i}", 16 * j).bitwiseAND(F.lit(0xFFFF))).alias(f"{h}{16 * j + i}") for h in _HALVES for j in range(4) for i in range(16)]
    total = chunks.groupBy(*keys).agg(F.sum("w").alias("w"), *lanes)

    def word(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(64):
            out = out.bitwiseOR(F.when(2 * F.col(f"{h}{i}") > F.col("w"), F.lit(_signed(1 << i)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*keys, *(word(h).alias(h) for h in _HALVES))


def _written(x: str, y: str) -> Column:
    """The 32 hex digits of two halves."""
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (x, y))))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fingerprint (32 hex digits) for rows whose keys are unique; null or empty texts are the one empty term. No rows, no rows."""
    return _voted(rows, keys, text).select(*keys, _written("x", "y").alias("fingerprint"))


def likeness(ax: str, ay: str, bx: str, by: str) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - (F.bit_count(F.col(ax).bitwiseXOR(F.col(bx))) + F.bit_count(F.col(ay).bitwiseXOR(F.col(by)))) / F.lit(128.0)


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(ax, ay, bx, by, distance) for every two different fingerprints in prints (x, y) that differ in at most `radius`
    bits, each pair once, the smaller (x, y) first.

    The 128 bits are cut into radius + 2 blocks, half of them in each half. Two such fingerprints have at least two
    blocks alike, so for each pair of blocks there is a table keyed by both, in which fingerprints meet and are
    compared. A pair is given by the first table that it meets in. Equal fingerprints are one row; those with a null
    half take no part. No rows, no pairs. The join is hinted: Spark takes the exploded tables to be as small as prints and
    would broadcast them.
    """
    blocks = radius + 2
    if blocks > 20:
        raise ValueError("radius must be at most 18")
    places = []
    for h, n in zip(_HALVES, (blocks - blocks // 2, blocks // 2)):
        cuts = [64 * i // n for i in range(n + 1)]
        places += [(h, low, high - low) for low, high in zip(cuts, cuts[1:])]

    def block(of: Column, low: int, bits: int) -> Column:
        return F.shiftrightunsigned(of, low).bitwiseAND(F.lit(_signed((1 << bits) - 1)).cast("long"))

    def key(i: int, j: int) -> Column:
        low = F.xxhash64(*(block(F.col(places[k][0]), *places[k][1:]) for k in (i, j))).bitwiseAND(F.lit((1 << 44) - 1))
        return low.bitwiseOR(F.lit(_signed((1 << i | 1 << j) << 44)).cast("long"))

    one = prints.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    tables = one.select("x", "y", F.explode(F.array(*(key(i, j) for i in range(blocks) for j in range(i + 1, blocks)))).alias("key"))
    a, b = (tables.select(F.col("key").alias(f"{t}_key"), F.col("x").alias(f"{t}x"), F.col("y").alias(f"{t}y")) for t in "ab")
    differ = {h: F.col(f"a{h}").bitwiseXOR(F.col(f"b{h}")) for h in _HALVES}
    distance = F.bit_count(differ["x"]) + F.bit_count(differ["y"])
    alike = F.lit(0).cast("long")
    for k, (h, low, bits) in enumerate(places):
        alike = alike + F.when(block(differ[h], low, bits) == 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = alike.bitwiseAND(alike - 1)
    first = (alike - rest.bitwiseAND(rest - 1)) == F.shiftrightunsigned("a_key", 44)
    apart = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pairs = a.join(b.hint("merge"), (F.col("a_key") == F.col("b_key")) & apart & (distance <= radius) & first)
    return pairs.select("ax", "ay", "bx", "by", distance.cast("int").alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text, the text of the next row, and slot, place, last: where a row is.

    The order is by descending doc_id (null last); rows that repeat a doc_id follow each other by a hash of their text;
    the first row comes after the last. Rows are dealt to ranges of doc_id, once, with their texts. A doc_id that
    fills a range by itself, and null, are dealt to 64 slots by that hash. The last row of a slot gets the first text
    of the slot after it, so no window holds more than a slot.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("b")).first()
    bounds = found["b"] or []
    often = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    bounds = sorted(set(bounds))
    low = found["low"] or 0
    span = (found["high"] or 0) - low + 1
    cells = [(b - low) * ranges // span for b in bounds]
    begin = [bisect_left(cells, c) for c in range(ranges + 1)]
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    d = F.col("doc_id")
    at = F.expr(f"CAST((CAST(doc_id AS decimal(38, 0)) - ({low})) * {ranges} DIV {span} AS int)")
    here, after = F.element_at(listed(begin), at + 1), F.element_at(listed(begin), at + 2)
    near = F.filter(F.slice(listed(bounds), (here + 1).cast("int"), (after - here).cast("int")), lambda b: b < d) if bounds else F.array()
    number = 2 * (here + F.size(near)) + (d.isin(often).cast("int") if often else F.lit(0))
    mixed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    crowded = d.isNull() | (d.isin(often) if often else F.lit(False))
    slot = 64 * F.coalesce(-number, F.lit(1)) + F.when(crowded, F.shiftrightunsigned(mixed, 57)).otherwise(F.lit(0))
    dealt = docs.select(slot.cast("long").alias("slot"), "doc_id", "text").repartition("slot")
    window = Window.partitionBy("slot").orderBy(d.desc_nulls_last(), mixed)
    placed = dealt.select("*", F.row_number().over(window).cast("long").alias("place"), F.lead("text").over(window).alias("ahead"))
    heads = dealt.groupBy("slot").agg(F.max_by("text", F.struct(d, (-mixed).alias("mixed"))).alias("head"))
    by_slot = Window.orderBy("slot")
    whole = by_slot.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select("slot", F.coalesce(F.lead("slot").over(by_slot), F.first("slot").over(whole)).alias("follower"))
    heads = follows.join(heads.withColumnRenamed("slot", "follower"), "follower").select("slot", "head")
    joined = placed.join(heads.hint("merge"), "slot")
    return joined.select("slot", "place", "doc_id", "text", F.coalesce("ahead", "head").alias("next_text"), F.col("ahead").isNull().alias("last"))


def fingerprint_edits(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near for every row of
    docs (doc_id, text; other columns are ignored).

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the next document's.
    Likeness is the share of equal bits. n_near counts the other fingerprints of documents that differ in at most
    `radius` bits. Null texts are empty. A null doc_id comes last; rows that repeat a doc_id
    follow each other by a hash of their text; a single row is its own next. Empty table: no rows.
    """
    rows = with_next(texts(docs))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.col("next_text"), F.lit(1), third))
    own = rows.select("slot", "place", "doc_id", size.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    kinds = rows.select("slot", "place", F.stack(F.lit(3), F.lit(0), F.col("text"), F.lit(1), edited, F.lit(2), F.when(F.col("last"), F.col("next_text"))).alias("kind", "t"))
    voted = _voted(kinds.where("t IS NOT NULL").select("slot", (4 * F.col("place") + F.col("kind")).alias("id"), "t"), ["slot", "id"], "t")
    of = lambda k, h: F.max(F.when(F.col("id") % 4 == k, F.col(h))).alias(f"{h}{k}")
    wide = voted.groupBy("slot", F.floor(F.col("id") / 4).alias("place")).agg(*(of(k, h) for k in range(3) for h in _HALVES))
    window = Window.partitionBy("slot").orderBy("place")
    after = [F.coalesce(f"{h}2", F.lead(f"{h}0").over(window)).alias(f"next_{h}") for h in _HALVES]
    wide = wide.select("slot", "place", F.col("x0").alias("x"), F.col("y0").alias("y"), "x1", "y1", *after)
    found = materialize(own.join(wide.hint("merge"), ["slot", "place"]).drop("slot", "place"), "fingerprints")
    pairs = near_fingerprints(found, radius)
    ends = F.array(*(F.struct(F.col(f"{t}x").alias("x"), F.col(f"{t}y").alias("y")) for t in "ab"))
    near = pairs.select(F.explode(ends).alias("e")).groupBy("e.x", "e.y").agg(F.count("*").alias("n_near"))
    out = found.join(near, ["x", "y"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", _written("x", "y").alias("fingerprint"), _written("x1", "y1").alias("edited_fingerprint"), likeness("x", "y", "x1", "y1").alias("near_edited"), likeness("x", "y", "next_x", "next_y").alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; near copies within RADIUS bits."""
    return fingerprint_edits(table(spark, sf_dir, "documents"), RADIUS)
