"""Removal of repeated word sequences by difference-cover anchors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import EMPTY_SHA, anchor_rows, doc_slices, documents_with_repeats
from .common import _SPACE, Rolling, discard, lean, materialize, mix64, signed, table, text_chunks, texts, word_hashes, word_spans

#: A perfect difference set: for any two positions some shift below PERIOD puts both on the cover.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

#: Bytes of one document looked at together.
SEGMENT = 2 << 20

_U = np.uint64
_GAP = re.compile(rb"[ \t-\r]")
_ONE, _TWO = Rolling(0xA0761D6478BD642F), Rolling(0xE7037ED1A0B428DB)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _segments(data: np.ndarray, offsets: np.ndarray, tail: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int | None]]:
    """Bytes, offsets, first word's place and own words of what is looked at together.

    A chunk of documents is one segment (all words are its own). A longer document is cut between words; each segment
    is followed by `tail` words of the next, which are not its own.
    """
    if len(data) <= SEGMENT:
        yield data, offsets, 0, None
        return
    at = base = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not _SPACE[data[end]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + SEGMENT]])
            end = min(len(data), end + (int(ahead[0]) if len(ahead) else SEGMENT))
        own = len(word_spans(data[at:end], np.array([0, end - at]))[0])
        stop, reach = end, 64 * tail
        while stop < len(data):
            stop = min(len(data), end + reach)
            starts, ends, _ = word_spans(data[end:stop], np.array([0, stop - end]))
            if len(starts) > tail:
                stop = end + int(ends[tail - 1])
                break
            reach *= 2
        yield data[at:stop], np.array([0, stop - at]), base, own
        at, base = end, base + own


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + SEGMENT)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def _joined(lists: Iterable[list[bytes]]) -> tuple[int, str]:
    """How many words there are, and the hash of them joined by spaces."""
    n, made = 0, hashlib.sha256()
    for words in lists:
        if words:
            made.update(b" " * (n > 0) + b" ".join(words))
            n += len(words)
    return n, made.hexdigest()


def _anchors(of: np.ndarray, hashes: np.ndarray, width: int, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and word position of each cover position's window of width - PERIOD + 1 words."""
    short = width - PERIOD + 1
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    place = np.arange(len(hashes)) - of[doc] + base
    at = np.flatnonzero(_ON_COVER[place % PERIOD] & (np.arange(len(hashes)) + short <= of[doc + 1]))
    return mix64(_ONE.runs(hashes, at, at + short)), doc[at], at


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
    for part, data, offsets in text_chunks(batches):
        found = [_joined(_pieces(raw)) for raw in doc_slices(offsets, data)]
        yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], schema=schema)


def _own(batches):
    """Rows whose text has the word sequence that sha stands for: a doc_id may repeat with another text."""
    for part, data, offsets in text_chunks(batches):
        sha = part.column(part.schema.get_field_index("sha")).to_pylist()
        own = [_joined(_pieces(raw))[1] == s for raw, s in zip(doc_slices(offsets, data), sha)]
        yield part.filter(pa.array(own, pa.bool_()))


def _windows(width: int):
    """From documents and their repeated anchors: every window that holds one (the extension of each anchor)."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("doc_id", pa.int64()), ("twin", pa.int32()), ("start", pa.int32())])

    def run(batches):
        for part, whole, bounds in text_chunks(batches):
            wanted, doc_id, twin = (part.column(part.schema.get_field_index(n)) for n in ("hashes", "doc_id", "twin"))
            lists, values = np.asarray(wanted.offsets), wanted.values.to_numpy()
            for data, offsets, base, own in _segments(whole, bounds, width):
                starts, ends, of = word_spans(data, offsets)
                hashes = word_hashes(data, starts, ends)
                anchor, doc, at = _anchors(of, hashes, width, base)
                marks = np.zeros(len(hashes) + 1, np.int32)
                for i in range(len(of) - 1):
                    lo, hi = np.searchsorted(doc, (i, i + 1))
                    hit = at[lo:hi][np.isin(signed(anchor[lo:hi]), values[lists[i] : lists[i + 1]])]
                    np.add.at(marks, np.maximum(of[i], hit - (PERIOD - 1)), 1)
                    np.add.at(marks, hit + 1, -1)
                owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
                window = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (np.arange(len(hashes)) + width <= of[owner + 1]))
                window = window if own is None else window[window < own]
                for k in range(0, len(window), 1 << 16):
                    now = window[k : k + (1 << 16)]
                    one, two = mix64(_ONE.runs(hashes, now, now + width)), mix64(_TWO.runs(hashes, now, now + width))
                    of_doc = pa.array(owner[now])
                    yield pa.record_batch([pa.array(signed(one)), pa.array((two >> _U(32)).astype(np.uint32).view(np.int32)), doc_id.take(of_doc), twin.take(of_doc), pa.array((now - of[owner[now]] + base).astype(np.int32))], schema=schema)

    return run, "w1 long, w2 int, doc_id long, twin int, start int"


def _cut(width: int):
    """n_removed and kept_sha256 from the starts of repeated windows, 64 places to a number."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            found = part.column(part.schema.get_field_index("starts"))
            removed, kept = [], []
            for i, raw in enumerate(doc_slices(offsets, data)):
                row, bits = (found[i].values.field(k).to_numpy() for k in (0, 1))
                at, places = np.nonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                begin = row[at].astype(np.int64) * 64 + places
                marks = np.zeros(int(begin.max()) + width + 1, np.int32)
                np.add.at(marks, begin, 1)
                np.add.at(marks, begin + width, -1)
                gone = np.cumsum(marks) > 0
                base, lists = 0, []
                for words in _pieces(raw):
                    here = gone[base : base + len(words)]
                    lists.append([w for w, g in zip(words, here) if not g] + words[len(here) :])
                    base += len(words)
                n, sha = _joined(lists)
                removed.append(base - n)
                kept.append(sha)
            yield pa.record_batch([part.column(part.schema.get_field_index(n)) for n in ("doc_id", "sha")] + [pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run, "doc_id long, sha string, n_removed long, kept_sha256 string"


def drop_repeated_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text; other columns are ignored).

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id. Windows of
    width - 30 words are hashed at the cover positions modulo 31 of each document; two equal long windows share an
    aligned one, whatever their places. Every window around an anchor that the corpus repeats is then compared by a
    96-bit hash of all its words. Of documents with one word sequence only the smallest doc_id takes part. A document
    longer than SEGMENT bytes is looked at in segments, so a task's memory is that of its text and a bounded rest.

    Null or empty text: no words. Fewer than `width` words: nothing removed. Null doc_id: never removed from and
    never a reason to remove. Rows that repeat a doc_id are judged each by itself, against smaller doc_ids only.
    Empty table: no rows.
    """
    if width < PERIOD:
        raise ValueError(f"width must be at least {PERIOD}")
    docs = texts(docs)
    scan = materialize(docs.mapInArrow(lean(_scan), "doc_id long, n_words long, sha string"), "scan")
    first = scan.groupBy("sha").agg(F.min("doc_id").alias("first"))
    reps = scan.where(f"n_words >= {width} AND doc_id IS NOT NULL").join(first, "sha").where("doc_id = first").select("doc_id", "sha").distinct()
    reps = reps.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id").orderBy("sha")))

    def anchors(whole, bounds):
        found = []
        for data, offsets, base, own in _segments(whole, bounds, width):
            starts, ends, of = word_spans(data, offsets)
            hashes, doc, at = _anchors(of, word_hashes(data, starts, ends), width, base)
            found.append((hashes, doc) if own is None else (hashes[at < own], doc[at < own]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, _U), np.zeros(0, np.int64))

    again = documents_with_repeats(anchor_rows(docs.where("doc_id IS NOT NULL"), anchors), reps)
    again = materialize(again.join(reps, "doc_id"), "anchored")
    zone = docs.join(again, "doc_id")
    zone = materialize(zone.mapInArrow(lean(_own), zone.schema), "zone")
    discard(again)
    run, schema = _windows(width)
    windows = materialize(zone.mapInArrow(lean(run), schema), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = materialize(least, "least")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("start") % 64)
    words = windows.join(least, ["w1", "w2"]).where("doc_id > least").groupBy("doc_id", "twin", F.floor(F.col("start") / 64).cast("int").alias("row")).agg(F.bit_or(bit).alias("bits"))
    starts = words.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("row", "bits")).alias("starts"))
    starts = materialize(starts, "starts")
    discard(windows)
    discard(least)
    run, schema = _cut(width)
    cut = zone.select("doc_id", "twin", "sha", "text").join(starts, ["doc_id", "twin"]).mapInArrow(lean(run), schema).dropDuplicates(["doc_id", "sha"])
    out = scan.join(first, "sha").join(cut, ["doc_id", "sha"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= width)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table with windows of fifty words."""
    return drop_repeated_windows(table(spark, sf_dir, "documents"), 50)
