import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import common, packing, pieces, tokens

BYTES, WORDS, PIECES = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = ["a", "Be", " ", "  ", "\n", "'s", "'", "É", "9", "12", "!", "<|endoftext|>", "<|", "\t", "\xa0", "́", "ß", "İ", "'ll", "\x1c", "Σ", "ſ", "½", "木", "😀", "▁", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_encoder_agrees_with_the_library(text):
    for path, spaced in ((BYTES, True), (WORDS, False)):
        want = tokens.encoder(path, spaced).tokenizer.encode(text, add_special_tokens=False).ids
        assert tokens.encoder(path, spaced).encode([text, "between", text], 7)[2].tolist() == want + [7]


def test_parts_are_encoded_in_few_strings(monkeypatch):
    """Parts of all letters that are cut, and controls: ids as the library's, from an encoding for hundreds of parts."""
    tool, plain = tokens.Encoder(BYTES, True), Tokenizer.from_file(BYTES)
    letters = "".join(chr(c) for c in range(0x180) if c not in (0x85, 0xA0) and not 0x1C <= c <= 0x1F)
    odd = [letters, letters[::-1], "\x00\x00 \x7f\xad \t\n  don't  ", " ".join(letters), *(f"{a}x{b}" for a in letters for b in "é 7\x01'")]
    want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in odd]
    asked = []
    monkeypatch.setattr(tokens, "_STRING", 100)
    monkeypatch.setattr(tool, "tokenizer", None)
    made, mark = tool.joined

    class Counted:
        def encode_batch_fast(self, strings, **how):
            asked.extend(strings)
            return made.encode_batch_fast(strings, **how)

    monkeypatch.setattr(tool, "joined", (Counted(), mark))
    assert [x.tolist() for x in tool.encode(odd, 0)] == want
    assert len(asked) == -(-len(tool.place) // 100)
    assert tokens.Encoder(WORDS, False).joined is None


def test_purging_keeps_ids_right(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    tool, plain = tokens.Encoder(BYTES, True), Tokenizer.from_file(BYTES)
    for k in range(20):
        text = " ".join(f"word{i % (k + 3)} and{i}" for i in range(60))
        assert tool.encode([text], 0)[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


def test_token_files_are_in_order(docs, texts):
    got = {r.doc_id: r for r in tokens.token_files(docs, WORDS).collect()}
    plain, start = Tokenizer.from_file(WORDS), 0
    for i, t, *_ in sorted(texts, key=lambda x: x[0]):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ranges_are_read_off_any_file_system(tmp_path):
    path, held = str(tmp_path / "x.ids"), np.arange(1000, dtype="<u2")
    held.tofile(path)
    local = pyarrow.fs.LocalFileSystem()
    for files, name in ((local, path), (pyarrow.fs.SubTreeFileSystem(str(tmp_path), local), "x.ids")):
        stored = tokens._Stored(files, name, "<u2")
        assert stored.part(990, 1000).tolist() == list(range(990, 1000)) and stored.part(5, 5).tolist() == []
        offsets = np.array([0, 3, 4, 500, 501, 502, 1000])
        for together in (1, 4, 50, 5000):
            assert [d.tolist() for d in tokens._documents(stored, offsets, together)] == [list(range(a, b)) for a, b in zip(offsets, offsets[1:])]


def test_packing_uses_every_piece_once(docs, texts):
    plain, capacity = Tokenizer.from_file(BYTES), 128
    rows = packing.pack(docs, BYTES, capacity=capacity, with_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in texts:
        own, ids = sorted(by_doc[i], key=lambda r: r.piece), plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and all(r.length == capacity for r in own[1:])
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0, *(n for _, n in held)])[:-1]) and sum(n for _, n in held) <= capacity
    assert len(places) <= -(-sum(r.length for r in rows) // capacity) * 1.05 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plan_is_whole_and_fits(lengths):
    done, n = packing.plan_sequences(dict(Counter(lengths)), 64)
    used = Counter()
    for times, held in done:
        assert 0 < sum(a * b for a, b in held) <= 64
        for a, b in held:
            used[a] += times * b
    assert used == Counter(lengths) and n == sum(t for t, _ in done)
    assert n <= 11 / 9 * -(-sum(lengths) // 64) + 0.67 * len([x for x in lengths if x > 21]) + 2


def _least(sizes: list[int], capacity: int) -> int:
    """The least number of sequences, by trying every place for every piece."""
    best = len(sizes)

    def put(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(r for r in rooms if r >= sizes[i]):
            at = rooms.index(room)
            put(i + 1, (*rooms[:at], room - sizes[i], *rooms[at + 1 :]))
        put(i + 1, (*rooms, capacity - sizes[i]))

    sizes = sorted(sizes, reverse=True)
    put(0, ())
    return best


def test_small_cases_take_the_least_number_of_sequences():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sizes = [int(x) for x in rng.integers(1, 21, rng.integers(1, 10))]
        assert packing.plan_sequences(dict(Counter(sizes)), 20)[1] == _least(sizes, 20)


def test_linear_grouping_beats_best_fit_where_large_lengths_must_match():
    lengths = {n: 40 for n in range(600, 1100)}
    assert packing._plan(lengths, 2048, 1 / 8, 48)[1] < packing._plan(lengths, 2048, 1 / 2, 48)[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), st.integers(0, 1 << 40))
def test_sampled_pieces_decode_to_the_text(text, key):
    tool = pieces.lattice(PIECES)
    a = tool.encode([text], pieces.row_keys([key], 1))[0]
    b = tool.encode(["before", text], pieces.row_keys([0, key], 1))[1]
    assert tool.decode(a) == text and a.tolist() == b.tolist()


def test_samples_follow_the_lattice():
    tool, word, n = pieces.lattice(PIECES), "▁hello", 20_000
    score = {tool.pieces[i]: s for i, s in zip(tool.number.tolist(), tool.score.tolist())}

    def cuts(rest):
        if not rest:
            yield ()
        for j in range(1, len(rest) + 1):
            if rest[:j] in score:
                for more in cuts(rest[j:]):
                    yield (rest[:j], *more)

    weight = {c: np.exp(sum(score[p] for p in c)) for c in cuts(word)}
    total = sum(weight.values())
    seen = Counter(tuple(tool.pieces[i] for i in ids) for ids in tool.encode(["hello"] * n, pieces.row_keys(list(range(n)), 3)))
    for c, w in weight.items():
        assert seen[c] / n == pytest.approx(w / total, abs=0.012)


def test_whole_lattice_is_sampled(monkeypatch):
    tool, n = pieces.lattice(PIECES), 4_000
    keys = pieces.row_keys(list(range(n)), 3)
    score = {tool.pieces[i]: s for i, s in zip(tool.number.tolist(), tool.score.tolist())}
    assert all("▁" * k in score for k in range(1, 17) if k != 15)
    for text in ("a" + " " * 21 + "b", "=" * 45 + "-" * 30, "x" * 60 + "http://www.example.com/" * 4):
        plain = "▁" + text.replace(" ", "▁")
        ahead, back = np.full(len(plain) + 1, -np.inf), np.full(len(plain) + 1, -np.inf)
        ahead[0] = back[-1] = 0
        for j in range(len(plain)):
            for k in range(1, 17):
                if plain[j : j + k] in score and j + k <= len(plain):
                    ahead[j + k] = np.logaddexp(ahead[j + k], ahead[j] + score[plain[j : j + k]])
        for j in reversed(range(len(plain))):
            for k in range(1, 17):
                if plain[j : j + k] in score and j + k <= len(plain):
                    back[j] = np.logaddexp(back[j], back[j + k] + score[plain[j : j + k]])
        cut = np.zeros(len(plain) + 1)  # how often a piece ends at each place
        tool.clear()
        drawn = tool.encode([text] * n, keys)
        for ids in drawn:
            cut[np.cumsum([len(tool.pieces[i]) for i in ids])] += 1 / n
        assert cut[1:] == pytest.approx(np.exp(ahead + back - ahead[-1])[1:], abs=0.045)
        with monkeypatch.context() as m:
            m.setattr(pieces, "TILE", 7)
            tool.clear()
            assert all(a.tolist() == b.tolist() for a, b in zip(drawn, tool.encode([text] * n, keys)))
        tool.clear()


def test_no_piece_reaches_over_a_cut():
    tool = pieces.lattice(PIECES)
    usable = [tool.pieces[i] for i in tool.number.tolist()]
    for p in usable:
        for a in ("", "a", "é-", "1", "木"):
            parts = tool.cut.findall(f"{a}{p}{a}")
            ends = np.cumsum([len(x) for x in parts])
            assert "".join(parts) == f"{a}{p}{a}" and not any(len(a) < e < len(a) + len(p) for e in ends)


def test_pieces_over_a_table(docs, texts):
    ids = pieces.encode_sampled(docs, PIECES)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(ids, PIECES).collect()}
    assert back == {i: t or "" for i, t, *_ in texts}
    again = {r.doc_id: r.ids for r in pieces.encode_sampled(docs.repartition(5), PIECES).collect()}
    assert {r.doc_id: r.ids for r in ids.collect()} == again
    other = {r.doc_id: r.ids for r in pieces.encode_sampled(docs, PIECES, seed=9).collect()}
    assert other != again and all(r.round_trip for r in pieces.sampled_digest(docs, PIECES).collect())


def test_clean_deletes_what_was_written(spark, docs):
    shards = tokens.write_token_files(docs, WORDS, False, 1)
    path = shards.first().path
    assert os.path.exists(path + ".ids")
    common.clean(spark)
    assert not os.path.exists(path + ".ids")


def test_empty_and_odd(empty, odd):
    assert tokens.token_files(empty, WORDS).count() == packing.pack(empty, BYTES).count() == pieces.sampled_digest(empty, PIECES).count() == 0
    assert tokens.token_files(odd, WORDS).count() == packing.pack(odd, BYTES).count() == pieces.sampled_digest(odd, PIECES).count() == 8
    assert {r.n_tokens for r in tokens.token_files(odd, WORDS).where("doc_id = 1").collect()} == {1}
