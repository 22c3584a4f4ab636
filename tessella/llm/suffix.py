"""Removal of repeated byte strings by a collection suffix array that is built column by column.

Inserting one symbol of every document in each round takes as many rounds as the longest document has bytes, each of
them over all that is sorted so far. So documents enter as anchored fragments: of every 200-byte window the smallest
100-byte hash is its anchor, windows with one anchor are a fragment of at most 300 bytes, and a window can only repeat
under an anchor that repeats. Fragments that are alike are one. The fragments of a few thousand anchors at a time are
the collection; a round inserts one symbol of each fragment, from the right, and updates the order, the Burrows-Wheeler
column and the common prefixes.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import EMPTY_SHA, anchor_rows, doc_slices, documents_with_repeats
from .common import _BYTES, Rolling, lean, materialize, mix64, signed, spare, table, text_chunks, texts

#: Fragments sorted together, at least; a collection ends with its last anchor.
COLLECTION = 16_384
#: Anchors with more different fragments than this have their windows counted one by one, over all executors.
CROWDED = 512
#: Bytes whose windows are looked at together; no result depends on it, a worker's memory does, by some 130 bytes for each.
SEGMENT = 1 << 18

_U = np.uint64
_GRAM, _LONG, _TWO = Rolling(0x8EBC6AF09C88C6E3), Rolling(0x589965CC75374CC3), Rolling(0x1D8E4E27C47D124F)
_PLACE = _U((1 << 21) - 1)


def _fragments(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, anchor place, first window and window count of each fragment; places within `data`."""
    gram = width // 2
    span = width - gram + 1
    found = []
    cuts = sorted({0, *range(SEGMENT, len(data), SEGMENT)})
    for base in cuts:
        part = data[base : base + SEGMENT + width - 1]
        n = len(part) - gram + 1
        if len(part) < width:
            continue
        at = np.arange(n)
        hashes = mix64(_GRAM.runs(_BYTES[part], at, at + gram))
        keys = (hashes & ~_PLACE) | at.astype(_U)
        rows = -(-n // span)
        grid = np.full(rows * span, ~_U(0), _U)
        grid[:n] = keys
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        start = np.arange(len(part) - width + 1)
        anchor = (np.minimum(back[start], ahead[start + span - 1]) & _PLACE).astype(np.int64)
        doc = np.searchsorted(offsets, start + base, "right") - 1
        whole = start + base + width <= offsets[doc + 1]
        start, anchor, doc = start[whole], anchor[whole], doc[whole]
        if not len(start):
            continue
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.concatenate([first, [len(start)]]))
        found.append((hashes[anchor[first]], doc[first], anchor[first] + base, start[first] + base, count))
    if not found:
        return np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(rolling: Rolling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT)))
        base = starts[at]
        out[at:stop] = rolling.runs(_BYTES[data[base : ends[at:stop].max()]], starts[at:stop] - base, ends[at:stop] - base)
        at = stop
    return mix64(out + (ends - starts).astype(_U))


def column_wise_repeats(buffer: np.ndarray, bases: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, width: int):
    """(fragment, window place) of every window of `width` symbols that another fragment of the collection has too.

    Fragment i is buffer[bases[i]:bases[i] + lengths[i]], its anchor at anchors[i]. Columns are numbered from the
    anchor. They are written to one external file, from the right, and read back one a round; the round's
    Burrows-Wheeler column and common prefixes are appended to another, which the search for repeats then reads.
    """
    m = len(bases)
    right, left = int((lengths - anchors).max()), -int(anchors.max())
    columns = range(right - 1, left - 1, -1)
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as sorted_file:
        for c in columns:
            at = anchors + c
            there = (at >= 0) & (at < lengths)
            column = np.full(m, 256, np.uint16)
            column[there] = buffer[bases[there] + at[there]]
            column.tofile(symbols)
        symbols.seek(0)
        order, common = np.arange(m, dtype=np.int32), np.zeros(m, np.uint16)
        for _ in columns:
            bwt = np.fromfile(symbols, np.uint16, m)[order]
            moved = np.argsort(bwt, kind="stable")
            bwt = bwt[moved]
            fresh = np.zeros(m, np.uint16)
            heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
            for lo, hi in zip(heads, np.concatenate([heads[1:], [m]])):
                if hi - lo > 1 and bwt[lo] != 256:
                    places = moved[lo:hi]
                    fresh[lo + 1 : hi] = np.minimum.reduceat(common[: places[-1] + 1], places[:-1] + 1) + 1
            order, common = order[moved], fresh
            order.tofile(sorted_file)
            common.tofile(sorted_file)
        sorted_file.seek(0)
        for c in columns:
            order, common = np.fromfile(sorted_file, np.int32, m), np.fromfile(sorted_file, np.uint16, m)
            long = common >= width
            hit = long.copy()
            hit[:-1] |= long[1:]
            mine = order[hit]
            if len(mine):
                yield mine, anchors[mine] + c


def _meta(width: int):
    schema = pa.schema([("hash", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("weight", pa.int32())])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            hashes, doc, anchor, start, count = _fragments(data, offsets, width)
            wanted = part.column(part.schema.get_field_index("hashes"))
            lists, values = np.asarray(wanted.offsets), wanted.values.to_numpy()
            keep = np.zeros(len(doc), bool)
            order = np.argsort(doc, kind="stable")
            for i in range(len(offsets) - 1):
                lo, hi = np.searchsorted(doc[order], (i, i + 1))
                mine = order[lo:hi]
                keep[mine] = np.isin(signed(hashes[mine]), values[lists[i] : lists[i + 1]])
            hashes, doc, anchor, start, count = (x[keep] for x in (hashes, doc, anchor, start, count))
            ends = start + count - 1 + width
            f1, f2 = _runs(_LONG, data, start, ends), _runs(_TWO, data, start, ends)
            ids, weight = (part.column(part.schema.get_field_index(n)).take(pa.array(doc)) for n in ("doc_id", "weight"))
            yield pa.record_batch([pa.array(signed(hashes)), pa.array(signed(f1)), pa.array(signed(f2)), ids, pa.array(start - offsets[doc]), pa.array(count.astype(np.int32)), pa.array((anchor - start).astype(np.int32)), weight], schema=schema)

    return run, "hash long, f1 long, f2 long, doc_id long, start long, windows int, anchor int, weight int"


def _bytes_of(width: int):
    """The fragments' own bytes, from documents with lists of wanted fragments."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("n", pa.int32()), ("crowded", pa.bool_()), ("piece", pa.binary())])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            wanted, ids = part.column(part.schema.get_field_index("wanted")), part.column(part.schema.get_field_index("doc_id"))
            rows: list[list] = [[] for _ in schema]
            for i, raw in enumerate(doc_slices(offsets, data)):
                for w in wanted[i].as_py():
                    for to, x in zip(rows, (w["hash"], ids[i].as_py(), w["start"], w["windows"], w["anchor"], w["n"], w["crowded"], raw[w["start"] : w["start"] + w["windows"] - 1 + width])):
                        to.append(x)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return run, "hash long, doc_id long, start long, windows int, anchor int, n int, crowded boolean, piece binary"


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])


def _sort_collections(width: int):
    def solve(batch: pa.RecordBatch):
        pieces = batch.column(batch.schema.get_field_index("piece")).cast(pa.large_binary())
        offsets = np.asarray(pa.array(pieces.to_pylist(), pa.large_binary()).buffers()[1]).view(np.int64)
        buffer = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
        n, start, anchor = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("n", "start", "anchor"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for mine, place in column_wise_repeats(buffer, offsets[: len(n)], np.diff(offsets[: len(n) + 1]), anchor.astype(np.int64), width):
            lone = n[mine] == 1
            mine, place = mine[lone], place[lone]
            yield pa.record_batch([ids.take(pa.array(mine)), pa.array(start[mine] + place), pa.array(np.ones(len(mine), np.int32))], schema=_FOUND)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < COLLECTION:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            hashes = whole.column(0).to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))
            if cut:
                yield from solve(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run, "doc_id long, start long, windows int"


def _each_window(width: int):
    """Every window of the fragments under crowded anchors, by a 128-bit hash."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for part, data, offsets in text_chunks(batches, "piece"):
            n, start = (part.column(part.schema.get_field_index(x)).to_numpy() for x in ("n", "start"))
            count = np.diff(offsets) - width + 1
            of = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[of] + place
            one, two = _runs(_LONG, data, at, at + width), _runs(_TWO, data, at, at + width)
            ids = part.column(part.schema.get_field_index("doc_id")).take(pa.array(of))
            for k in range(0, len(of), 1 << 16):
                to = slice(k, k + (1 << 16))
                yield pa.record_batch([pa.array(signed(one[to])), pa.array(signed(two[to])), ids.slice(k, 1 << 16), pa.array(start[of[to]] + place[to]), pa.array(n[of[to]])], schema=schema)

    return run, "w1 long, w2 long, doc_id long, start long, n int"


def _cut(width: int):
    """n_removed, n_spans and the hash of what is left; `kept` is what is left with the characters whole that lost only a part."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            found = part.column(part.schema.get_field_index("found"))
            out = []
            for i, raw in enumerate(doc_slices(offsets, data)):
                own = found[i].values
                start, count = own.field(0).to_numpy(), own.field(1).to_numpy()
                marks = np.zeros(len(raw) + 1, np.int32)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + count - 1 + width, -1)
                gone = np.cumsum(marks[:-1]) > 0
                bytes_ = np.frombuffer(raw, np.uint8)
                left = bytes_[~gone].tobytes()
                lead = np.flatnonzero((bytes_ & 0xC0) != 0x80)
                whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(raw)))) if len(lead) else gone
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                out.append((int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), bytes_[~whole].tobytes().decode("utf-8", "replace")))
            yield pa.record_batch([part.column(part.schema.get_field_index(x)) for x in ("doc_id", "sha")] + [pa.array([r[j] for r in out], f.type) for j, f in enumerate(list(schema)[2:])], schema=schema)

    return run, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string, kept string"


def repeated_bytes(docs: DataFrame, width: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text; other columns are ignored).

    Texts are UTF-8 bytes. A byte goes if a `width`-byte string over it also starts anywhere else in the collection,
    the same document included. with_text adds `cut` (where bytes were removed the remaining text, in which characters
    that lost only a part are whole; else null) and `sha` (sha256 of the text). Equal texts are sorted once; as their strings all start elsewhere too, they go whole from `width` bytes on.
    A string of two texts is under one anchor in both; anchors and fragments that are there once are left out before
    anything is sorted. An anchor with over 512 different fragments has its windows counted by 128-bit hashes
    instead, over all executors, so that no task holds a crowded anchor.

    Null or empty text: no bytes. Rows count as different places whatever their doc_id, repeated and null ones too: what
    is sorted is keyed by 64 bits of the text's sha256. Empty table: no rows.
    """
    docs = texts(docs)
    raw = docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    key = F.conv(F.substring("sha", 2, 15), 16, 10).cast("long")
    scan = materialize(raw.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "scan")
    copies = scan.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    reps = scan.where(f"n_bytes >= {width}").join(copies, "sha").where("doc_id <=> first").select(key.alias("doc_id"), "first", "sha", F.least(F.lit(2), "copies").cast("int").alias("weight")).distinct()

    def anchors(data, offsets):
        return _fragments(data, offsets, width)[:2]

    again = materialize(documents_with_repeats(anchor_rows(raw.select(key.alias("doc_id"), "text"), anchors), reps).join(reps, "doc_id"), "anchored")
    own = raw.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "text")
    zone = own.join(again, (F.col("_sha") == F.col("sha")) & F.col("_id").eqNullSafe(F.col("first"))).drop("_id", "_sha", "first")
    zone = materialize(zone.dropDuplicates(["doc_id", "sha"]), "zone")
    run, schema = _meta(width)
    meta = materialize(zone.mapInArrow(lean(run), schema), "fragments")
    alike = materialize(meta.groupBy("hash", "f1", "f2").agg(F.least(F.lit(2), F.sum("weight")).cast("int").alias("n"), F.min(F.struct("doc_id", "start", "windows", "anchor")).alias("at")), "alike")
    groups = alike.groupBy("hash").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1")
    wanted = alike.join(groups, "hash").select("at.doc_id", F.struct("hash", "at.start", "at.windows", "at.anchor", "n", (F.col("k") > CROWDED).alias("crowded")).alias("w"))
    run, schema = _bytes_of(width)
    pieces = zone.select("doc_id", "text").join(wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted")), "doc_id").mapInArrow(lean(run), schema)
    pieces = materialize(pieces, "pieces")
    run, schema = _sort_collections(width)
    sorted_ = pieces.where("NOT crowded").repartition("hash").sortWithinPartitions("hash").mapInArrow(lean(run), schema)
    run, schema = _each_window(width)
    single = pieces.where("crowded").mapInArrow(lean(run), schema)
    often = single.groupBy("w1", "w2").agg(F.sum("n").alias("k")).where("k > 1").select("w1", "w2")
    counted = single.where("n = 1").join(often, ["w1", "w2"]).select("doc_id", "start", F.lit(1).alias("windows"))
    whole = meta.join(alike.where("n > 1").select("hash", "f1", "f2"), ["hash", "f1", "f2"]).select("doc_id", "start", "windows")
    found = whole.unionByName(sorted_).unionByName(counted).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    run, schema = _cut(width)
    cut = zone.where("weight = 1").select("doc_id", "sha", "text").join(found, "doc_id").mapInArrow(lean(run), schema)
    if not with_text:
        cut = cut.drop("kept")
    out = scan.join(copies, "sha").join(cut.drop("doc_id"), "sha", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    columns = [
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("cut"), "sha"] if with_text else []))


def without_repeated_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """docs with the repeated strings gone from text, and n_chars anew where there is such a column.

    Rows and other columns stay, whatever their names; a null text stays null. Everything else is as in repeated_bytes.
    """
    id_, sha, cut = spare(docs, "_id", "_sha", "_cut")
    found = repeated_bytes(docs, width, with_text=True).where("cut IS NOT NULL").select(F.col("doc_id").alias(id_), F.col("sha").alias(sha), F.col("cut").alias(cut)).dropDuplicates([id_, sha])
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.sha2(F.col("text").cast("binary"), 256) == F.col(sha)), "left")
    text = F.coalesce(cut, "text")
    changed = {"text": text} | ({"n_chars": F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return joined.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table with strings of 200 bytes."""
    return repeated_bytes(table(spark, sf_dir, "documents"), 200)
