"""Packing of token pieces into sequences by linear grouping, configurations and best fit.

The plan is made from the histogram of piece lengths, which has at most as many entries as a sequence has tokens, so
its cost doesn't depend on the number of documents; documents then look up their place by length and rank.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, table, texts
from .tokens import crc, encoded, tokenizer_path

#: (share of a sequence from which a length is large, groups of equal cardinality) to plan with; the plan with the fewest sequences holds.
SCHEMES = ((1 / 2, 48), (1 / 4, 80), (1 / 8, 48))
#: Rows that one (length, bucket) window should hold about.
BUCKET_ROWS = 1_000


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the linear programme over few sizes by column generation, rounded down."""
    k = len(sizes)
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    need, most = np.array(demand, float), capacity // min(sizes)
    basis = list(range(k))
    for _ in range(60 * k):
        b = np.array([columns[i] for i in basis], float).T
        price = np.linalg.solve(b.T, np.ones(k))
        value, choice = np.zeros(capacity + 1), []
        for _ in range(most):
            best, pick = value.copy(), np.full(capacity + 1, -1)
            for g, size in enumerate(sizes):
                if price[g] <= 1e-12:
                    continue
                gain = np.full(capacity + 1, -1.0)
                gain[size:] = value[: capacity + 1 - size] + price[g]
                better = gain > best + 1e-12
                best[better], pick[better] = gain[better], g
            choice.append(pick)
            value = best
        if value[capacity] <= 1 + 1e-9:
            break
        column, at = np.zeros(k, np.int64), capacity
        for pick in reversed(choice):
            if pick[at] >= 0:
                column[pick[at]] += 1
                at -= sizes[pick[at]]
        x, step = np.linalg.solve(b, need), np.linalg.solve(b, column.astype(float))
        usable = step > 1e-9
        if not usable.any():
            break
        out = int(np.argmin(np.where(usable, x / np.where(usable, step, 1), np.inf)))
        columns.append(column)
        basis[out] = len(columns) - 1
    x = np.linalg.solve(np.array([columns[i] for i in basis], float).T, need)
    return [(columns[i], int(n + 1e-9)) for i, n in zip(basis, x) if n >= 1 - 1e-9]


def plan_sequences(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """The best of the plans that SCHEMES gives."""
    return min((_plan(lengths, capacity, *scheme) for scheme in SCHEMES), key=lambda plan: plan[1])


def _plan(lengths: dict[int, int], capacity: int, share: float, wanted: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """([(sequences, [(length, pieces in each)])], number of sequences) that use up the histogram.

    Large lengths, longest first, go to groups of equal cardinality and are rounded up to their group's longest. The
    best configurations of the rounded lengths are filled with the actual ones. What is left, longest first, goes to
    the sequence with the least room that still fits, and opens a new one where none does.
    """
    left = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    rows: list[tuple[int, list[tuple[int, int]]]] = []
    large = sorted((n for n in left if n > capacity * share), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        each = -(-total // wanted)
        groups: list[list[list[int]]] = [[]]
        room = each
        for n in large:
            count = left[n]
            while count:
                if not room:
                    groups.append([])
                    room = each
                take = min(count, room)
                groups[-1].append([n, take])
                count, room = count - take, room - take
        sizes, demand = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
        for column, times in _configurations(sizes, demand, capacity):
            slots = []
            for g in np.flatnonzero(column):
                for _ in range(column[g]):
                    part, want = [], times
                    while want and groups[g]:
                        n, c = groups[g][0]
                        take = min(c, want)
                        part.append((n, take))
                        want -= take
                        groups[g][0][1] -= take
                        if not groups[g][0][1]:
                            groups[g].pop(0)
                    slots.append(part + [(0, want)] * bool(want))
            ends = sorted({int(e) for s in slots for e in np.cumsum([c for _, c in s])})
            for start, end in zip([0, *ends], ends):
                held: dict[int, int] = defaultdict(int)
                for s in slots:
                    place = int(np.searchsorted(np.cumsum([c for _, c in s]), start, "right"))
                    if s[place][0]:
                        held[s[place][0]] += 1
                        left[s[place][0]] -= end - start
                if held:
                    rows.append((end - start, sorted(held.items(), reverse=True)))
    open_: dict[int, list] = defaultdict(list)
    mask = 0
    for times, held in rows:
        room = capacity - sum(n * c for n, c in held)
        open_[room].append((times, held))
        mask |= 1 << room

    def put(room: int, times: int, held: list) -> None:
        nonlocal mask
        open_[room].append((times, held))
        mask |= 1 << room

    for n in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[n]
        while count:
            fit = mask >> n
            room = n + (fit & -fit).bit_length() - 1 if fit else capacity
            times, held = open_[room].pop() if fit else (count, [])
            if fit and not open_[room]:
                mask &= ~(1 << room)
            many = min(room // n, count)
            used = min(times, count // many)
            put(room - many * n, used, [*held, (n, many)])
            if fit and times > used:
                put(room, times - used, held)
            count -= used * many
    done = [(times, held) for room in sorted(open_) for times, held in open_[room] if held]
    return done, sum(times for times, _ in done)


def _slots(done: list) -> tuple[np.ndarray, ...]:
    """For each (length, first rank): pieces in a sequence, its first sequence and the first piece's offset there; sorted."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for times, held in done:
        offset = 0
        for n, many in held:
            out.append((n, used[n], many, sequence, offset))
            used[n] += times * many
            offset += n * many
        sequence += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(out))) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _pieces(path: str, spaced: bool, end: int, capacity: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches):
        for part, ids in encoded(batches, path, spaced, end):
            docs = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            rows = []
            for doc, own in zip(docs, ids):
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                rows += [(doc, i, a, b - a, crc(own[a:b])) + ((own[a:b].astype("<u4").tobytes(),) if with_ids else ()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.record_batch([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids


def pack(docs: DataFrame, path: str, spaced: bool = True, end: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text; others are ignored).

    A document is its text's ids and the end id; only a document longer than a sequence is cut, into full pieces after
    a first one with the rest. with_ids adds the piece's ids (little-endian unsigned 32-bit). The driver gets the
    histogram of lengths, at most `capacity` rows.

    Null or empty text: the end id alone. Null or repeated doc_ids are documents like others. Empty table: no rows.
    """
    run, schema = _pieces(path, spaced, end, capacity, with_ids)
    pieces = materialize(texts(docs).mapInArrow(lean(run), schema), "pieces")
    buckets = max(1, min(4096, pieces.count() // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = materialize(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    done, _ = plan_sequences({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    length, first, many, sequence, offset = _slots(done)
    keys = (length << 44) | first
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(counts.withColumn("before", before).drop("n"), ["length", "bucket"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(keys, (n << 44) | rank, "right") - 1
            k = rank - first[at]
            named = [batch.column(batch.schema.get_field_index(x)) for x in columns]
            yield pa.record_batch([*named, pa.array(sequence[at] + k // many[at]), pa.array(offset[at] + k % many[at] * n)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(lean(place), schema + ", sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table by byte_bpe_50k.json, end id 0, sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
