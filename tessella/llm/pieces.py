"""Sampled segmentations over the piece lattice of a SentencePiece model, and lossless decoding."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, lean, mix64, ship, table, texts
from .tokens import crc, tokenizer_path

#: Weight of a piece's score in a segmentation's log probability; a larger one keeps closer to the best segmentation.
THETA = 0.002
#: Log weight of a character spelled in bytes, which only characters without a piece are.
BYTES = -80.0
#: Words whose lattices a Python worker keeps, and their edges (beyond that those go that were met once since the last time), and characters encoded together.
CACHED, CACHED_EDGES, TOGETHER = 400_000, 16_000_000, 4 << 20
#: Words filtered together, and characters whose pieces are looked up together; sums are carried from tile to tile.
BLOCK, TILE = 16_384, 1 << 17
#: Seed of the registered query.
SEED = 20_240_601

_SPACE = "\u2581"
#: Stands for a mark that the text has itself; no word has a space.
_MARK = " "
_LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64
_POINTS = Rolling(0xBF58476D1CE4E5B9 | 1)


def _spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key for each run of code points."""
    return mix64(_POINTS.runs(mix64(points.astype(_U) + _U(1)), starts, ends) + (ends - starts).astype(_U))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its count."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class _Table:
    """Numbers by 64-bit key; two direct tables, the second for what collides in the first."""

    def __init__(self, keys: np.ndarray):
        for seed in range(64):
            with np.errstate(over="ignore"):
                mixed = mix64(keys + _U(seed))
            self.seed = seed
            self.first, self.second = np.full(1 << 18, -1, np.int32), np.full(1 << 20, -1, np.int32)
            a, b = (mixed >> _U(46)).astype(np.int64), (mixed & _U((1 << 20) - 1)).astype(np.int64)
            self.first[a] = np.arange(len(keys))
            rest = np.flatnonzero(self.first[a] != np.arange(len(keys)))
            self.second[b[rest]] = rest
            if len(np.unique(b[rest])) == len(rest):
                break
        else:
            raise ValueError("keys collide")
        self.keys = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        with np.errstate(over="ignore"):
            mixed = mix64(keys + _U(self.seed))
        at = self.first[(mixed >> _U(46)).astype(np.int64)]
        out = np.where((at >= 0) & (self.keys[at] == keys), at, -1)
        miss = np.flatnonzero(out < 0)
        at = self.second[(mixed[miss] & _U((1 << 20) - 1)).astype(np.int64)]
        out[miss] = np.where((at >= 0) & (self.keys[at] == keys[miss]), at, -1)
        return out


class Lattice:
    """Forward sums of the words' piece lattices, and backward samples for many words at once.

    A text has its spaces replaced by the model's mark and one mark put before it; marks that a text has itself are
    spelled in bytes, so that decoding is exact. It is cut only where no piece of the model reaches over: before every
    run of marks, between letters and a character that follows a letter in no piece, and around characters that are in no piece of several. The segmentations of the parts are independent, so filtering
    each word once gives the distribution over the text. Any other character without a piece is spelled in bytes.
    """

    def __init__(self, model: str):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = tool.get_piece_size()
        self.pieces = [tool.id_to_piece(i) for i in range(self.size)]
        usable = [i for i in range(self.size) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))]
        if any(_SPACE in self.pieces[i].lstrip(_SPACE) for i in usable):
            raise ValueError("a piece has a mark after other characters")
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if tool.is_byte(i)}
        self.raw = [b""] * self.size
        for i in usable:
            self.raw[i] = self.pieces[i].replace(_SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.score = np.array([THETA * tool.get_score(i) for i in usable])
        self.number = np.array(usable, np.int64)
        points = np.array([ord(c) for i in usable for c in self.pieces[i]], np.int64)
        ends = np.cumsum([len(self.pieces[i]) for i in usable])
        self.table = _Table(_spans(points, ends - np.diff(ends, prepend=0), ends))
        after = {b for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:]) if _LETTER.match(a) and not _LETTER.match(b)}
        joined = {c for i in usable if len(self.pieces[i]) > 1 for c in self.pieces[i]} - {_SPACE}
        after, joined, letters = ("".join(map(re.escape, sorted(x))) for x in (after, joined, filter(_LETTER.match, joined)))
        ahead = f"(?![{after}])" if after else ""
        several = f"{_SPACE}*+[{letters}]++{ahead}|" if letters else ""
        several += f"{_SPACE}*+[{joined}]++|" if joined else ""
        self.cut = re.compile(rf"{several}{_SPACE}*+[^{_SPACE}]|{_SPACE}++", re.S)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        # of a word: its first and last node, how often it was met; of a node: its first incoming edge
        self.base, self.ends, self.met, self.first = (np.zeros(n, np.int32) for n in (0, 0, 0, 1))
        # of an edge: cumulative probability, node before, piece or character, spelled or not
        self.edges = (np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool))

    def _purge(self) -> None:
        """Keep the words met more than once, or none if those are too many."""
        keep = self.met > 1
        if keep.sum() > CACHED // 2:
            return self.clear()
        base, nodes = self.base[keep].astype(np.int64), (self.ends - self.base + 1)[keep].astype(np.int64)
        low, high = self.first[base].astype(np.int64), self.first[base + nodes].astype(np.int64)
        if (high - low).sum() > CACHED_EDGES // 2:
            return self.clear()
        incoming = np.diff(self.first)[_ranges(base, nodes)]
        at, new = _ranges(low, high - low), np.cumsum(nodes) - nodes
        chance, before, piece, spelled = (x[at] for x in self.edges)
        self.edges = (chance, (before + np.repeat(new - base, high - low)).astype(np.int32), piece, spelled)
        self.first = np.concatenate([[0], np.cumsum(incoming)]).astype(np.int32)
        self.base, self.ends, self.met = new.astype(np.int32), (new + nodes - 1).astype(np.int32), np.zeros(len(new), np.int32)
        self.place = {w: i for i, w in enumerate(w for w, k in zip(self.place, keep.tolist()) if k)}

    def _filter(self, words: list[str]) -> None:
        """Add words' nodes and incoming edges with their backward probabilities, all words of a block together."""
        plain = [_SPACE if w == _MARK else w for w in words]
        length = np.fromiter(map(len, plain), np.int64, len(plain))
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(length) - length
        word = np.repeat(np.arange(len(plain)), length)
        within = np.arange(len(points)) - start[word]
        node = np.arange(len(points)) + word + 1  # in this block, of the place after a character
        reach = np.arange(1, self.longest + 1)
        literal = np.repeat([w == _MARK for w in words], length)
        sums = np.zeros(len(points) + len(plain))
        count = np.zeros(len(points) + len(plain), np.int64)
        made = [self.edges]
        nodes, known = len(self.first) - 1, len(self.edges[0])
        for low in range(0, len(points), TILE):
            here = slice(low, low + TILE)
            made.append(self._tile(points, within[here], node[here], literal[here], low, reach, sums, count, nodes))
        self.edges = tuple(np.concatenate([x.astype(old.dtype) for x in all_]) for old, all_ in zip(self.edges, zip(*made)))
        self.first = np.concatenate([self.first, (known + np.cumsum(count)).astype(np.int32)])
        self.place.update(zip(words, range(len(self.ends), len(self.ends) + len(words))))
        root = nodes + start + np.arange(len(plain))
        self.base, self.ends = (np.concatenate([old, new.astype(np.int32)]) for old, new in ((self.base, root), (self.ends, root + length)))
        self.met = np.concatenate([self.met, np.zeros(len(plain), np.int32)])

    def _tile(self, points, within, node, literal, low, reach, sums, count, nodes):
        """The incoming edges of the nodes after the characters from `low` on; sums and count are filled for these nodes."""
        begin = max(0, low - self.longest + 1)
        own = points[begin : low + len(within)]
        piece = np.full((len(within), self.longest), -1, np.int64)
        for k in reach:
            at = np.flatnonzero(within >= k - 1)
            piece[at, k - 1] = self.table.find(_spans(own, at + low - begin - k + 1, at + low - begin + 1))
        piece[literal] = -1
        spelled = piece[:, 0] < 0
        gain = np.where(piece >= 0, self.score[piece], -np.inf)
        gain[spelled, 0] = BYTES
        chance = np.empty(gain.shape)
        order = np.argsort(within, kind="stable")
        cuts = np.flatnonzero(np.diff(within[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            near = min(within[at[0]] + 1, self.longest)  # pieces that are longer begin before the word
            whole = np.full((len(at), self.longest), -np.inf)
            whole[:, :near] = gain[at, :near] + sums[node[at][:, None] - reach[:near]]
            top = whole.max(1)
            weight = np.exp(whole - top[:, None])
            total = np.cumsum(weight, 1)
            chance[at] = total / total[:, -1:]
            sums[node[at]] = top + np.log(total[:, -1])
        rows, k = np.nonzero(gain > -np.inf)
        count[node] = np.bincount(rows, minlength=len(within))
        odd = spelled[rows] & (k == 0)
        return chance[rows, k], nodes + node[rows] - k - 1, np.where(odd, own[low - begin + rows], self.number[piece[rows, k]]), odd

    def words(self, text: str) -> list[str]:
        """The parts of a text, marks in place of spaces."""
        out = []
        for k, part in enumerate(text.split(_SPACE)):
            out += [_MARK] if k else []
            out += self.cut.findall(part.replace(" ", _SPACE) if k else _SPACE + part.replace(" ", _SPACE))
        return out

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """A segmentation of each text, drawn by its key alone: neighbours and batches make no difference."""
        if len(self.place) > CACHED or len(self.edges[0]) > CACHED_EDGES:
            self._purge()
        split = [self.words(t) for t in texts]
        new = [w for w in {w for s in split for w in s} if w not in self.place]
        for at in range(0, len(new), BLOCK):
            self._filter(new[at : at + BLOCK])
        (chance, before, piece, spelled), first, ends = self.edges, self.first, self.ends
        every = [w for s in split for w in s]
        if not every:
            return [np.zeros(0, np.uint32) for _ in texts]
        of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        number = np.arange(len(every)) - np.repeat(np.cumsum([0, *map(len, split)])[:-1], [len(s) for s in split])
        at = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        self.met += np.bincount(at, minlength=len(self.met)).astype(np.int32)
        node = ends[at]
        seed = mix64(keys[of] ^ mix64(number.astype(_U) + _U(1)))
        taken, live = [], np.arange(len(every))
        while len(live):
            draw = (mix64(seed[live] + _U((len(taken) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(11)) * 2.0**-53
            at = node[live]
            edge, last = first[at], first[at + 1] - 1
            on = np.arange(len(live))
            while len(on):
                on = on[(edge[on] < last[on]) & (chance[edge[on]] <= draw[on])]
                edge[on] += 1
            taken.append((live, edge))
            node[live] = before[edge]
            live = live[first[node[live] + 1] > first[node[live]]]
        steps = np.zeros(len(every), np.int64)
        for live, _ in taken:
            steps[live] += 1
        ends = np.cumsum(steps)
        edge = np.empty(ends[-1], np.int64)
        for k, (live, one) in enumerate(taken):
            edge[ends[live] - 1 - k] = one
        word = np.repeat(np.arange(len(every)), steps)
        ids, odd = piece[edge].astype(np.int64), spelled[edge].astype(bool)
        owner = of[word]
        if odd.any():
            spelled_out = [[self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in ids[odd]]
            counts = np.ones(len(ids), int)
            counts[odd] = [len(x) for x in spelled_out]
            wide = np.repeat(ids, counts)
            wide[np.repeat(odd, counts)] = [b for x in spelled_out for b in x]
            ids, owner = wide, np.repeat(owner, counts)
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        return [x.astype(np.uint32) for x in np.split(ids, cuts)]

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded."""
        return b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


_LATTICES: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    """This process's lattice, kept from task to task."""
    if model not in _LATTICES:
        _LATTICES[model] = Lattice(model)
    return _LATTICES[model]


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    """A 64-bit key for each row from its doc_id (null as 0) and the seed."""
    with np.errstate(over="ignore"):
        return mix64(mix64(np.array([i or 0 for i in ids], np.int64).view(_U)) + _U(seed))


def _batched(batch: pa.RecordBatch, texts_: list[str]):
    at = 0
    while at < len(texts_):
        stop, size = at, 0
        while stop < len(texts_) and (stop == at or size + len(texts_[stop]) <= TOGETHER):
            size += len(texts_[stop])
            stop += 1
        yield batch.slice(at, stop - at), texts_[at:stop]
        at = stop


def encode_sampled(docs: DataFrame, model: str, seed: int = SEED) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs (doc_id, text; other columns are ignored): one segmentation of the
    whole text, drawn by forward filtering and backward sampling with doc_id and seed as key.

    The same doc_id, text and seed give the same ids in any partitioning. Null or empty text: the mark's piece alone.
    Null doc_ids share one key. Empty table: no rows.
    """

    def run(batches):
        tool = lattice(model)
        for batch in batches:
            for part, own in _batched(batch, batch.column(1).to_pylist()):
                ids = tool.encode(own, row_keys(part.column(0).to_pylist(), seed))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids (array<int>): exactly the text that was encoded; null ids give null."""

    ship(rows.sparkSession)

    def run(batches):
        tool = lattice(model)
        for batch in batches:
            texts_ = [None if x is None else tool.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts_, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, text string")


def sampled_digest(docs: DataFrame, model: str, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32, round_trip for every row of docs: what encode_sampled gives, and whether
    decoding it returns the whole text. Nulls as there."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        tool = lattice(model)
        for batch in batches:
            for part, own in _batched(batch, batch.column(1).to_pylist()):
                ids = tool.encode(own, row_keys(part.column(0).to_pylist(), seed))
                yield pa.record_batch([part.column(0), pa.array([len(t) for t in own], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc(x) for x in ids], pa.int64()), pa.array([tool.decode(x) == t for x, t in zip(ids, own)], pa.bool_())], schema=schema)

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_chars long, n_pieces long, ids_crc32 long, round_trip boolean")


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table by piece_bpe_32k.model."""
    return sampled_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
