import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import common, minhash, substring, suffix
from tessella.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def test_repeated_bytes_against_brute_force(docs, texts):
    whole = {i: (t or "").encode() for i, t, *_ in texts}
    seen = Counter(b[k : k + 200] for b in whole.values() for k in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix.repeated_bytes(docs).collect()}
    assert len(got) == len(whole)
    for i, b in whole.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    assert sum(r.n_removed > 0 for r in got.values()) > 10


def test_crowded_anchors_give_the_same(docs, monkeypatch):
    want = sorted(suffix.repeated_bytes(docs).collect())
    monkeypatch.setattr(suffix, "CROWDED", 1)
    assert sorted(suffix.repeated_bytes(docs).collect()) == want


def test_text_without_repeats_keeps_characters_whole(docs, texts):
    got = {r.doc_id: r.text for r in suffix.without_repeated_bytes(docs).collect()}
    assert len(got) == len(texts) and got[[i for i, t, *_ in texts if t is None][0]] is None
    cut = [t for i, t, *_ in texts if t and got[i] != t]
    assert len(cut) > 10 and all("�" not in t for t in got.values() if t)


def test_columns_are_sorted_with_common_prefixes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(200)]
    buffer, bases = np.frombuffer(b"".join(texts), np.uint8), np.arange(200) * 30
    found = {(int(i), int(p)) for mine, place in suffix.column_wise_repeats(buffer, bases, np.full(200, 30), np.zeros(200, np.int64), 12) for i, p in zip(mine, place)}
    want = {(i, p) for p in range(19) for i, t in enumerate(texts) if sum(u[p : p + 12] == t[p : p + 12] for u in texts) > 1}
    assert found == want


def test_repeated_windows_against_brute_force(docs, texts):
    words = {i: WORD.findall(t or "") for i, t, *_ in texts}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    got = {r.doc_id: r for r in substring.drop_repeated_windows(docs).collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    assert sum(r.n_removed > 0 for r in got.values()) >= 10


def test_segments_of_a_long_text_give_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    raw = b" ".join(b"w%d" % x for x in rng.integers(0, 90_000, 9_000)) + b" " + b"x" * 40_000 + b" " + b"\n ".join(b"v%d" % x for x in range(300))
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    starts, ends, of = substring.word_spans(data, offsets)
    want = substring._anchors(of, substring.word_hashes(data, starts, ends), 50)
    columns = [pa.array([raw.decode()]), pa.array([7]), pa.array([1], pa.int32()), pa.array([substring.signed(want[0])[::2].tolist()], pa.list_(pa.int64()))]
    batch = pa.record_batch(columns, names=["text", "doc_id", "twin", "hashes"])
    windows = lambda: pa.Table.from_batches(list(substring._windows(50)[0](iter([batch]))))
    whole, joined = windows(), substring._joined(substring._pieces(raw))
    assert joined == (len(raw.split()), sha(b" ".join(raw.split()))) and len(whole) > 5_000
    monkeypatch.setattr(substring, "SEGMENT", 3_000)
    assert windows().equals(whole) and substring._joined(substring._pieces(raw)) == joined
    parts = list(substring._segments(data, offsets, 50))
    assert sum(own for *_, own in parts) == len(starts) and len(parts) > 10


def test_long_texts_and_repeated_ids_lose_their_passages(spark):
    lone = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two = lone("p", 60), lone("q", 70)
    made = [(5, lone("a", 400_000) + " " + one), (6, lone("b", 10) + " " + one), (6, two + " " + lone("c", 90)), (7, lone("d", 350_000) + "\n" + two + " tail"), (None, one)]
    assert len(made[0][1]) > substring.SEGMENT
    got = substring.drop_repeated_windows(spark.createDataFrame(made, "doc_id long, text string")).collect()
    kept = {5: [made[0][1].split()], 6: [made[1][1].split()[:10], made[2][1].split()], 7: [[w for w in made[3][1].split() if w[0] != "q"]], None: [one.split()]}
    assert sorted((r.doc_id or 0, r.kept_sha256) for r in got) == sorted((i or 0, sha(" ".join(w).encode())) for i, ws in kept.items() for w in ws)


def test_cover_meets_every_shift():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def near_by_brute_force(texts, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in texts:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(docs, texts):
    for width, cuts in ((4, {}), (5, {}), (4, {"most_differ": None, "sketch_differ": None})):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width, **cuts).collect()}
        assert got == near_by_brute_force(texts, width)


def test_one_document_of_each_group_stays(docs, texts):
    want = {i for i, (_, c) in near_by_brute_force(texts, 5).items() if i == c}
    kept = minhash.without_near_duplicates(docs)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 100).astype(np.uint64)]) for _ in range(2))
    same = (minhash.circulant_signature(a, 1024) == minhash.circulant_signature(b, 1024)).mean()
    assert abs(same - 0.8) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (None, 1), (5, 6)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8}
    assert components(edges.where("false")).count() == 0


def test_empty_tables(empty):
    for out in (suffix.repeated_bytes(empty), substring.drop_repeated_windows(empty), minhash.near_duplicates(empty), suffix.without_repeated_bytes(empty), minhash.without_near_duplicates(empty)):
        assert out.count() == 0


def test_odd_rows(odd):
    a = suffix.repeated_bytes(odd).collect()
    assert len(a) == 8 and {r.n_removed for r in a if r.doc_id == 2} == {660}
    b = substring.drop_repeated_windows(odd).collect()
    assert len(b) == 8 and all(r.n_removed == 0 for r in b if r.doc_id in (None, 1, 2))
    c = minhash.near_duplicates(odd).collect()
    assert len(c) == 8 and all(r.kept for r in c) and {r.component_id for r in c if r.doc_id is None} == {None}
    d = minhash.without_near_duplicates(odd).collect()
    assert sorted(r.doc_id or 0 for r in d) == [0, 0, 1, 2, 3, 4]


def test_long_texts_under_one_or_no_doc_id(spark):
    shared, other = ("".join(chr(97 + (i * i * k + i) % 26 ^ i % 7) for i in range(300)) for k in (3, 5))
    lone = lambda c, n: c + "".join(f"{c}{i:05d}" for i in range(n)) + c
    made = [(1, lone("p", 40)), (1, lone("q", 500) + shared), (2, lone("r", 50) + shared), (None, lone("s", 60) + other), (3, other + lone("t", 70))]
    got = suffix.repeated_bytes(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted((len(t), len(t) - len(t.replace(shared, "").replace(other, ""))) for _, t in made)


def test_very_long_text(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(50_000)) * 60
    rows = spark.createDataFrame([(1, long), (2, "short " + long[100:700])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.repeated_bytes(rows).collect()}
    assert got[1].n_removed == len(long) and got[2].n_removed == 600


def test_segments_have_every_window_once_and_bound_memory(monkeypatch):
    rng = np.random.default_rng(3)
    data, offsets = rng.integers(97, 123, 2 << 20).astype(np.uint8), np.array([0, 7, 900_000, 900_150, 2 << 20])

    def windows():
        _, doc, _, start, count = suffix._fragments(data, offsets, 200)
        return np.sort(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))

    want = np.concatenate([np.arange(a, max(a, b - 199)) for a, b in zip(offsets, offsets[1:])])
    monkeypatch.setattr(suffix, "_GRAM", common.Rolling(suffix._GRAM.base))
    tracemalloc.start()
    suffix._fragments(data, offsets, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(windows(), want) and peak < 64e6
    monkeypatch.setattr(suffix, "SEGMENT", 5_000)
    assert np.array_equal(windows(), want)
