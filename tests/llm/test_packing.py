"""Packing and mixing: exact token pieces, whole results, quality of the packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pixelloom.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_bins(lengths, capacity):
    sequence, offset = packing.pack_lengths(np.array(lengths), capacity)
    used = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
        used[s].append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(used)


def optimum(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_packing_is_near_the_optimum():
    rng = np.random.default_rng(3)
    for k in range(40):
        lengths = rng.integers(1 if k % 2 else 25, 99, 9).tolist()
        assert check_bins(lengths, 100) <= optimum(lengths, 100) + (k % 2)
    big = rng.integers(1, 2047, 5000).tolist()
    assert check_bins(big, 2048) <= np.ceil(sum(big) / 2048) * 1.01 + 1
    assert check_bins([5], 100) == 1 and check_bins([50, 50, 50], 100) == 2


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(20, 99, 8).tolist()
        left = packing._Sizes(np.array(lengths), 100)
        fixed = packing.reduce_by_dominance(left, 100)
        rest = [s for s in left.present for _ in range(left.count[s])]
        assert sorted(rest + [s for f in fixed for s in f]) == sorted(lengths)
        assert len(fixed) + (optimum(rest, 100) if rest else 0) == optimum(lengths, 100)


def test_reduction_fixes_three_sizes():
    left = packing._Sizes(np.array([50, 30, 19, 18]), 100)
    assert sorted(packing.reduce_by_dominance(left, 100)[0]) == [19, 30, 50]
    left = packing._Sizes(np.array([50, 40, 24, 23, 9]), 100)  # 40 and 9 do not dominate 24 and 23
    assert packing._dominating_second(left, 50, 40) == 0
    rng, triples = np.random.default_rng(8), 0
    for _ in range(150):
        lengths = rng.integers(14, 60, 9).tolist()
        left = packing._Sizes(np.array(lengths), 100)
        fixed = packing.reduce_by_dominance(left, 100)
        rest = [s for s in left.present for _ in range(left.count[s])]
        triples += sum(len(f) == 3 for f in fixed)
        assert sorted(rest + [s for f in fixed for s in f]) == sorted(lengths) and all(sum(f) <= 100 for f in fixed)
        assert len(fixed) + (optimum(rest, 100) if rest else 0) == optimum(lengths, 100)
    assert triples > 20


def test_pack(spark):
    tok = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello  World\n\tof 123 <|endoftext|>x", "é É ß'll don't\x1cx", "word thing " * 3000] + [f"text number {i} " * (i % 90 + 1) for i in range(120)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, None, 1), (4, texts[4], 1)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(df, PATH, shard_pieces=50).collect()
    copies = {0: 2, 4: 2}
    want = []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want += [(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] * copies.get(i, 1)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(used) <= sum(r.length for r in rows) / 2048 * 1.1 + 4
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_sainte_lague():
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes, seats = rng.integers(0, 1000, 6).astype(float), int(rng.integers(0, 60))
        most = rng.integers(0, 30, 6)
        got = mixing.sainte_lague(votes, seats, most)
        want = np.zeros(6, np.int64)
        for _ in range(seats):
            q = np.where((want < most) & (votes > 0), votes / (2 * want + 1), -1)
            if q.max() < 0:
                break
            want[int(np.argmax(q))] += 1
        assert got.sum() == want.sum() and (got <= most).all()
        assert sorted(got.tolist()) == sorted(want.tolist()) or np.abs(got - want).max() <= 1


def test_water_fill():
    out = mixing.water_fill(np.array([10, 1000, 10, 0]), np.array([1.0, 2, 3, 1]), 3)
    assert out.tolist() == [30, 960, 30, 0] and mixing.water_fill(np.array([0]), np.array([1.0]), 3).tolist() == [0]


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), [None, "a", "b", "é", "z"][i % 97 % 5] if i % 3 else "a", 0) for i in range(1500)] + [(None, None, "n", 0), (3, "x y", "a", 0), (3, "x y", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = np.array([sum(r.size for r in by[s]) for s in names])
    targets = mixing.water_fill(sizes, np.array([(1.0, 2.0, 3.0)[i % 3] for i in range(len(names))]), 3)
    for s, size, target in zip(names, sizes, targets, strict=True):
        assert {r.source_size for r in by[s]} == {size} and abs(by[s][0].target - target) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - target) <= 64 + 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_chunks_within_latin1():
    tok = Tokenizer.from_file(PATH)
    signs = [chr(c) for c in range(0x20, 0x180)]
    texts = ["".join(p) for a in signs for p in ((a, "x"), ("It'S", a, "9"), (a, a))] + ["É 'S 'll I'Ve½ª", "<|endoftext|> <|startoftext|>x"]
    for t, data in zip(texts, packing.token_bytes(texts, PATH), strict=True):
        assert data == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
