"""Token ids of whole texts by a public tokenizer, and flat token-id files."""

from __future__ import annotations

import os
import re
import threading
import uuid
import zlib
from collections.abc import Iterable
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lean, materialize, shared_dir, table, texts, trim

#: Parts of texts whose ids a Python worker keeps; beyond that those go that were met once since the last time.
CACHED = 700_000
#: Characters encoded together.
TOGETHER = 2 << 20
#: Seconds after which an idle Python worker gives its encoder up, so that other stages have the memory.
IDLE_S = 4.0
#: The doc_id that stands for null in a .doc file.
NO_ID = -(1 << 63)


#: What may stand in a text that is cut here: below U+0180, letters and numbers are these, and nothing composes.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_WIDE = re.compile("[\u0180-\U0010ffff\x85\xa0]")
_SPACED = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_LOWERED = re.compile(rf"'(?:[sdmt]|ll|ve|re)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class _Places(dict):
    """Numbers of parts; a part that is new gets the next number and is listed."""

    def __init__(self, known: Iterable[str] = ()):
        super().__init__((p, k) for k, p in enumerate(known))
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self[part] = place = len(self)
        return place


#: Stands between parts that are encoded together; texts that hold it are encoded whole.
_BETWEEN = "\x1f"
#: Parts in one such string.
_STRING = 256
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_letters() -> np.ndarray:
    """The character that a byte-level vocabulary has for each byte; _BETWEEN stays."""
    out = np.empty(256, "<u2")
    out[_PLAIN] = _PLAIN
    rest = np.setdiff1d(np.arange(256), _PLAIN)
    out[rest] = 256 + np.arange(len(rest))
    out[ord(_BETWEEN)] = ord(_BETWEEN)
    return out


_LETTERS = _byte_letters()


def _joined(path: str):
    """(a tokenizer for strings of parts in byte letters with _BETWEEN after each, the id it gives to that), or None.

    Only where a part's ids are its merges alone: byte-level merges without normalization, chance or other special
    tokens than those that texts are looked through for.
    """
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Split

    made = Tokenizer.from_file(path)
    cut, model = made.pre_tokenizer, made.model
    simple = made.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
    bare = isinstance(model, BPE) and not any((model.dropout, model.unk_token, model.continuing_subword_prefix, model.end_of_word_suffix, model.byte_fallback))
    if not (simple and bare and all(t.content.startswith("<|") for t in made.get_added_tokens_decoder().values())):
        return None
    made.add_tokens([AddedToken(_BETWEEN, normalized=False)])
    made.pre_tokenizer = Split(_BETWEEN, "isolated")
    return made, made.token_to_id(_BETWEEN)


class Encoder:
    """Ids of texts, as tokenizer.encode(text, add_special_tokens=False) gives them.

    Both public tokenizers cut every text by a pattern before they merge anything, so parts are encoded once and kept.
    Texts with characters from U+0180 on, rare white space or special tokens are encoded whole.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.spaced = path, spaced
        self.joined = _joined(path) if spaced else None
        self.clear()

    @cached_property
    def tokenizer(self):
        """The library's, for whole texts and, where nothing is joined, for parts."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        self.place = _Places()
        self.flat, self.start, self.length, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _purge(self) -> None:
        """Keep the parts met more than once, or none if those are too many."""
        keep = self.met > 1
        if keep.sum() > CACHED // 2:
            return self.clear()
        sizes = self.length[keep]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes) + np.repeat(self.start[keep], sizes)]
        self.start, self.length, self.met = ends - sizes, sizes, np.zeros(len(sizes), np.int64)
        self.place = _Places([p for p, k in zip(self.place, keep.tolist()) if k])

    def _parts(self, text: str) -> list[str] | None:
        """The parts, or None if the text must be encoded whole."""
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or not text.isascii() and _WIDE.search(text):
            return None
        return _SPACED.findall(text) if self.spaced else _LOWERED.findall(text.lower())

    def _learn(self) -> None:
        """Encode the new parts."""
        new, self.place.new = self.place.new, []
        if new:
            lengths, flat = self._together(new) if self.joined else self._alone(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length, self.met = np.concatenate([self.length, lengths]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.flat = np.concatenate([self.flat, flat])

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and all ids."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, from strings of many parts: most of a short part's time goes into an encoding of its own."""
        tokenizer, mark = self.joined
        strings = (_BETWEEN.join([*parts[i : i + _STRING], ""]).encode() for i in range(0, len(parts), _STRING))
        letters = [_LETTERS[np.frombuffer(x, np.uint8)].tobytes().decode("utf-16-le") for x in strings]
        found = np.fromiter(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(letters, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(found == mark)
        return np.diff(ends, prepend=-1) - 1, found[found != mark]

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of every text with `end` after them."""
        if len(self.place) > CACHED:
            self._purge()
        parts = [self._parts(t) for t in texts]
        every = chain.from_iterable(x for x in parts if x)
        at = np.fromiter(map(self.place.__getitem__, every), np.int64, sum(len(x) for x in parts if x))
        self._learn()
        self.met += np.bincount(at, minlength=len(self.met))
        sizes = self.length[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.start[at], sizes)]
        ends = np.concatenate([[0], ends])
        bounds = np.cumsum([0, *(len(x or ()) for x in parts)])
        last = np.array([end], np.uint32)
        out = []
        for text, own, a, b in zip(texts, parts, bounds, bounds[1:]):
            found = ids[ends[a] : ends[b]] if own is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            out.append(np.concatenate([found, last]))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


_IDLE: list[threading.Timer] = []


def _rest() -> None:
    """Give the encoder up unless it is asked for soon."""

    def give_up() -> None:
        _ENCODERS.clear()
        trim()

    timer = threading.Timer(IDLE_S, give_up)
    timer.daemon = True
    _IDLE.append(timer)
    timer.start()


def encoder(path: str, spaced: bool) -> Encoder:
    """This process's encoder, kept from task to task."""
    while _IDLE:
        _IDLE.pop().cancel()
    if (path, spaced) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; TESSELLA_TOKENIZERS names another folder."""
    folder = os.environ.get("TESSELLA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(batches, path: str, spaced: bool, end: int):
    """(rows of the batch, their ids) for about TOGETHER characters at a time."""
    tool = encoder(path, spaced)
    try:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
                    size += len(texts[stop])
                    stop += 1
                yield batch.slice(at, stop - at), tool.encode(texts[at:stop], end)
                at = stop
    finally:
        _rest()


def crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def id_kind(path: str, end: int) -> str:
    """The smallest of two and four unsigned bytes that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size() - 1, end) < 1 << 16 else "<u4"


def _write(folder: str, path: str, spaced: bool, end: int, kind: str):
    """Each task writes three files under a name of its own; only files named in its row count, so retries do no harm."""
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        shard, files, opened = TaskContext.get().partitionId(), pyarrow.fs.FileSystem.from_uri(folder), []
        base = f"{files[1]}/{shard:06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        try:
            for part, ids in encoded(batches, path, spaced, end):
                if not opened:
                    files[0].create_dir(files[1])
                    opened = [files[0].open_output_stream(f"{base}.{x}") for x in ("ids", "off", "doc")]
                for out, values in zip(opened, (np.concatenate(ids).astype(kind), (n_tokens + np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]).astype("<i8"), part.column(part.schema.get_field_index("doc_id")).fill_null(NO_ID).to_numpy().astype("<i8"))):
                    out.write(values.tobytes())
                n_docs += len(ids)
                n_tokens += sum(map(len, ids))
            if opened:
                opened[1].write(np.array([n_tokens], "<i8").tobytes())
        finally:
            for out in opened:
                out.close()
        if n_docs:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([base]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], schema=schema)

    return run, "shard int, path string, n_docs long, n_tokens long"


class _Stored:
    """Ranges of a file's integers: mapped into memory where the file is local, read range by range elsewhere."""

    def __init__(self, files, path: str, kind: str):
        self.kind = np.dtype(kind)
        self.map = np.memmap(path, self.kind, "r") if isinstance(files, pyarrow.fs.LocalFileSystem) else None
        self.file = None if self.map is not None else files.open_input_file(path)

    def part(self, start: int, end: int) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[start:end])
        return np.frombuffer(self.file.read_at((end - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def _documents(stored: _Stored, offsets: np.ndarray, together: int = TOGETHER):
    """The ids between each two offsets, read in ranges of at most `together` ids; a longer document is a range by itself."""
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + together, "right")) - 1)
        held = stored.part(int(offsets[i]), int(offsets[j]))
        yield from (held[a:b] for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]))
        i = j


def write_token_files(docs: DataFrame, path: str, spaced: bool, end: int) -> DataFrame:
    """Write ids in ascending doc_id order (null first); a row per shard: shard, path, n_docs, n_tokens, kind, base.

    A shard is path.ids (unsigned integers of kind `kind`, 16-bit where the vocabulary fits), path.off (64-bit offsets there, one more than documents) and path.doc
    (64-bit doc_ids). base, the ids in the shards before, is a prefix sum over as many rows as there are partitions.
    """
    spark = docs.sparkSession
    kind = id_kind(path, end)
    run, schema = _write(fresh_path(spark, "tokens"), path, spaced, end, kind)
    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = sorted(materialize(ordered.mapInArrow(lean(run), schema), "shards").collect())
    base, rows = 0, []
    for s in shards:
        rows.append((*s, kind, base))
        base += s.n_tokens
    return spark.createDataFrame(rows, schema + ", kind string, base long")


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, which lie in the shared folder."""
    folder = shared_dir(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = (_Stored(files, f"{row['path']}.{x}", k) for x, k in (("ids", row["kind"]), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, row["n_docs"], 10_000):
                    stop = min(row["n_docs"], at + 10_000)
                    o, d = offsets.part(at, stop + 1), docs.part(at, stop)
                    sums = [crc(own) for own in _documents(ids, o)]
                    yield pa.record_batch([pa.array(d, mask=d == NO_ID), pa.array(row["base"] + o[:-1]), pa.array(np.diff(o)), pa.array(sums, pa.int64())], schema=schema)

    return shards.repartition(max(1, shards.count())).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, spaced: bool = False, end: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row of docs (doc_id, text; other columns are ignored), from the files.

    Null or empty text: the end id alone. Null doc_ids come first; rows that repeat a doc_id follow each other, by
    text. Empty table: no rows. Documents are read and encoded whole.
    """
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, path, spaced, end))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table by word_bpe_49k.json, end id 1."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), spaced=False, end=1)
