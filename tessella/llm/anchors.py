"""Parts that the two substring operators share: scans of whole documents and hashes that repeat in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, signed, text_chunks

#: sha256 of nothing
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def anchor_rows(docs: DataFrame, anchors: Callable) -> DataFrame:
    """(hash, doc_id, n): each document's distinct anchor hashes and how often it has them.

    anchors(data, offsets) gives a chunk's anchor hashes and the document number of each.
    """
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for part, data, offsets in text_chunks(batches):
            hashes, of = anchors(data, offsets)
            if not len(hashes):
                continue
            order = np.lexsort((hashes, of))
            hashes, of = hashes[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]))
            n = np.diff(np.concatenate([first, [len(hashes)]])).astype(np.int32)
            ids = part.column(part.schema.get_field_index("doc_id")).take(pa.array(of[first]))
            for at in range(0, len(first), 1 << 16):
                to = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array(signed(hashes[first[to]])), ids.slice(at, 1 << 16), pa.array(n[to])], schema=schema)

    return docs.mapInArrow(lean(run), "hash long, doc_id long, n int")


def documents_with_repeats(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, hashes): for the documents in reps, their anchor hashes that the corpus has more than once.

    Hashes are counted with partial aggregates; a hash that a third of all documents have is split by AQE in the join.
    """
    often = rows.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    return rows.select("hash", "doc_id").join(reps.select("doc_id").distinct(), "doc_id", "left_semi").join(often, "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))


def doc_slices(offsets: np.ndarray, data: np.ndarray):
    """Each document's bytes."""
    raw = data.tobytes()
    for i in range(len(offsets) - 1):
        yield raw[offsets[i] : offsets[i + 1]]
