"""Operators that judge or rewrite rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelloom.llm import chat, linededup, media, quality, tokencount

LINE = "a line that is quite long enough to count"
TEXTS = [
    None, "", " \n\t ", "one", "the cat sat on the cat sat on the cat", f"{LINE}\n\n{LINE}\nx", f"  {LINE.upper()} \nother line that is only here, in one",
    f"{LINE}", "a b c d " * 30, "é ü ß " * 40, "x\ny\nx\n \n \n", "#$%&|<> the of and " * 30, "<|endoftext|>a<|endoftext|> b  c\n\n d ", "tab\tand  two spaces \n end ",
    "Ünïcödé 北京 русский 123 45's don't I'll", "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], i) for i, t in enumerate(TEXTS)]
    rows += [(None, f"{LINE}\nnull id", "en", 1), (None, f"{LINE}\nanother null id", "en", 1), (7, LINE, "en", 7), (7, LINE, "en", 7), (7, f"x\n{LINE}", "en", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long").repartition(3).cache()


def test_quality_counts(spark, docs):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()}
    want = set()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        spots = defaultdict(list)
        for i in range(len(w) - 2):
            spots[tuple(w[i : i + 3])].append(i)
        covered = {p + k for ps in spots.values() if len(ps) > 1 for p in ps for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.add((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    assert got == want


def test_repeats_in_long_texts(spark):
    plain = " ".join(f"w{i}" for i in range(1_000_000))
    rows = [(1, plain), (2, plain + " w5 w6 w7 w8"), (3, " ".join(f"v{i}" for i in range(4096)) + " v0 v1 v2"), (4, " ".join(f"v{i}" for i in range(4093)) + " v0 v1 v2")]
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.quality(spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")).collect()}
    assert got == {1: (1_000_000, 0), 2: (1_000_004, 8), 3: (4099, 6), 4: (4096, 6)}


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs.join(labels.select("doc_id", "quality"), "doc_id"), keep=["quality"]).where("not base_failed").select("row.quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 200 and sum(bad) <= 0.02 * len(bad) and sum(good) >= 0.998 * len(good)


def test_quality_verdict(spark):
    clean = "the of and to in a is that for it was on with as be " * 2 + " ".join(f"wor{chr(97 + i % 26)}{chr(97 + i // 26)}d" for i in range(120))
    junk = " ".join(f"{i * 7919 % 10007:05d}|{i}##" for i in range(150))
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(1, clean, "en"), (2, junk, "en"), (3, junk, None)], "doc_id long, text string, lang string"), quality.QualityRules(max_repeat_percent=100)).collect()}
    assert out[1].kept and not out[2].kept and not out[3].kept
    p, q = np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.0, 0.9])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p.tolist())), F.array(*map(F.lit, q.tolist())))).first()[0]
    assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


@pytest.mark.parametrize(("lines", "share"), [(500_000, 8), (2, 1)])
def test_line_dedup(spark, docs, lines, share, monkeypatch):
    for name, value in (("SHARD_LINES", lines), ("SALT_SHARE", share), ("LEAST_PROBES", share)):
        monkeypatch.setattr(linededup, name, value)
    clash = docs.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(("id", "own", "low", "high", "kept", "drops", "parts", "n_lines", "row", "shard"))))
    result = linededup.dedup_lines(clash, keep=clash.columns).collect()
    assert all(r.row.low == 2 and r.row.row == 8 for r in result)
    got = sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in result), key=str)
    rows = docs.collect()
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x))
    held = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 20 and r.doc_id is not None:
                held[key(x)].add(r.doc_id)
    want = []
    for r in rows:
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and r.doc_id != max(held[key(x)]))]
        want.append((r.doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert got == sorted(want, key=str)
    assert sum(x[2] for x in got) >= 4


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.int64)).view(np.uint64)
    f = linededup.PerfectHash.unpack(linededup.PerfectHash.build(h).pack())
    assert sorted(f.slots(h).tolist()) == list(range(len(h)))
    low = np.concatenate([h, h[:2]])
    high, counts = np.arange(len(low), dtype=np.uint64), np.arange(len(low))
    index = linededup.LineIndex.unpack(linededup.LineIndex.build(low, high, counts, counts.copy()).pack())
    assert (index.probe(low, high)[0] == counts).all() and not index.probe(low, high + np.uint64(1))[0].any()


def test_line_dedup_empty(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "<\\|x <|im_end|>"), (1, 2, "assistant", "<<|"), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (None, None, None, "x\n"), (3, 1, "us\ner%", "q" * 50_000), (-1, 0, "user", hard), (-1, 1, "assistant", hard)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, segment int").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    convs = defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, str(r[3] or ""))):
        convs[c].append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(learned))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert got[1].valid and not got[2].valid and got[-1].valid
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_token_counts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    counter = tokencount.MergeCounter(path)
    for t in [*TEXTS, *real, "a b  c", "x \n y", " lead", "trail "]:
        assert counter.count(t or "") == len(tok.encode(t or "", add_special_tokens=False).ids), t
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs.withColumnRenamed("n_words", "n_tokens"), path).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())
    assert got == want
    assert tokencount.count_tokens(docs.limit(0), path).count() == 0


def test_media(spark, docs):
    for t in TEXTS:
        data = media.payload_of(t)
        file = media.write_container(data)
        m = media.read_container(file)
        assert b"".join(file[o : o + s] for o, s in m["samples"]) == data
        assert m["codec"] == "raw " and m["duration"] * 600 == m["ticks"] and len(m["keyframes"]) == -(-m["n_samples"] // 8)
    want = Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        data = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        file = container(data)
        frames, start = len(data) // 192, len(file) - len(data)
        keys = ",".join(f"{start + 192 * k}+192" for k in range(0, frames, 8))
        feature = f"raw {frames * 20 / 600:.4f}s {frames} samples {-(-frames // 8)} keyframes {zlib.crc32(keys.encode()):08x} {zlib.crc32(data):08x}"
        want[r.doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature] += 1
    clash = docs.withColumnRenamed("n_words", "n_bytes")
    assert Counter(map(tuple, media.text_media(clash).collect())) == want
    assert media.text_media(docs.limit(0)).count() == 0


def container(data):
    """The file of a payload, put together byte by byte without the module."""
    n = len(data) // 192
    u = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    box = lambda kind, *parts: u(8 + sum(map(len, parts))) + kind + b"".join(parts)
    matrix = u(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = -(-n // 16)
    runs = ([(1, 16, 1)] if n >= 16 else []) + ([(chunks, n % 16, 1)] if n % 16 else [])
    keys = list(range(1, n + 1, 8))
    entry = box(b"raw ", bytes(6), b"\0\1", bytes(16), b"\0\x10\0\x0c", u(0x480000, 0x480000, 0), b"\0\1", bytes(32), b"\0\x28\xff\xff")

    def moov(at):
        stbl = box(b"stbl", box(b"stsd", u(0, 1), entry), box(b"stts", u(0, 1, n, 20)), box(b"stss", u(0, len(keys), *keys)), box(b"stsc", u(0, len(runs), *(v for r in runs for v in r))), box(b"stsz", u(0, 192, n)), box(b"stco", u(0, chunks, *(at + 3072 * k for k in range(chunks)))))
        minf = box(b"minf", box(b"vmhd", u(1), bytes(8)), box(b"dinf", box(b"dref", u(0, 1), box(b"url ", u(1)))), stbl)
        mdia = box(b"mdia", box(b"mdhd", u(0, 0, 0, 600, 20 * n, 0)), box(b"hdlr", u(0, 0), b"vide", bytes(13)), minf)
        tkhd = box(b"tkhd", u(3, 0, 0, 1, 0, 20 * n, 0, 0, 0, 0), matrix, u(16 << 16, 12 << 16))
        return box(b"moov", box(b"mvhd", u(0, 0, 0, 600, 20 * n, 0x10000, 0x1000000, 0, 0), matrix, bytes(24), u(2)), box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"qt  ", u(0x200), b"qt  isom")
    return ftyp + moov(len(ftyp) + len(moov(0)) + 8) + box(b"mdat", data)


def test_media_that_cannot_be_read(spark):
    good = media.write_container(b"x" * 384)
    cut = lambda kind, at, value: (i := good.index(kind)) and good[: i + at] + value + good[i + at + len(value) :]
    nested = b""
    for _ in range(1500):
        nested = media._box(b"moov", nested)
    bad = [None, b"", b"abc", b"\0\0\0\x01moov", nested, good[:200], cut(b"stsz", 12, b"\xff\xff\xff\xff"), cut(b"stss", 12, b"\0\0\0\x09"), cut(b"stsc", 12, b"\0\0\0\x07"), cut(b"stts", 8, b"\xff\xff\xff\xff"), cut(b"mdhd", 0, b"free"), media._box(b"moov")]
    rows = [(k, None if x is None else bytearray(x), "s") for k, x in enumerate([*bad, good])] + [(None, bytearray(good), "s")]
    out = media.media_columns(spark.createDataFrame(rows, "id long, content binary, status string"), "id", "content").collect()
    by = {r.id: r for r in out}
    assert len(out) == len(rows) and [by[k].status for k in range(len(bad))] == ["empty"] * 2 + ["damaged"] * (len(bad) - 2)
    assert all(by[k].message and by[k].track is None and by[k].keyframes is None for k in range(len(bad)))
    assert by[len(bad)].status == by[None].status == "ok" and by[None].n_samples == 2
    with pytest.raises(ValueError, match="size"):
        media.read_container(b"\0\0\0\x01moovxxxxxxxxxxxxxxxx")


def test_media_with_wide_boxes():
    """Version 1 of mdhd, co64, a box of 64-bit size, stz2 of 4 bits and a last box without a size."""
    box, full, u32 = media._box, media._full, media._u32
    q = lambda *x: b"".join(v.to_bytes(8, "big") for v in x)
    stbl = box(b"stbl", full(b"stsd", u32(1), box(b"avc1", bytes(8))), full(b"stts", u32(1, 3, 5)), full(b"stsc", u32(2, 1, 2, 1, 2, 1, 1)), full(b"co64", u32(2), q(2**33, 7)), full(b"stz2", u32(4, 3), b"\x12\x30"), full(b"stss", u32(1, 3)))
    mdia = box(b"mdia", full(b"mdhd", q(0, 0), u32(90_000), q(45_000), u32(0), version=1), box(b"minf", stbl))
    trak = box(b"trak", mdia)
    moov = u32(1) + b"moov" + q(16 + len(trak)) + trak
    m = media.read_container(moov + u32(0) + b"mdat" + b"rest")
    assert (m["codec"], m["duration"], m["ticks"], m["samples"], m["keyframes"]) == ("avc1", 0.5, 15, [(2**33, 1), (2**33 + 1, 2), (7, 3)], [(7, 3)])


def test_media_of_several_tracks(spark):
    def track(codec, scale, length, sizes, at, keys=None, compact=False):
        box, full, u32 = media._box, media._full, media._u32
        table = [full(b"stsd", u32(1), box(codec, bytes(8))), full(b"stts", u32(1, len(sizes), 1)), full(b"stsc", u32(1, 1, len(sizes), 1)), full(b"stco", u32(1, at))]
        table += [full(b"stz2", u32(16, len(sizes)), b"".join(x.to_bytes(2, "big") for x in sizes)) if compact else full(b"stsz", u32(0, len(sizes), *sizes))]
        table += [full(b"stss", u32(len(keys), *keys))] if keys else []
        return box(b"trak", box(b"mdia", full(b"mdhd", u32(0, 0, scale, length, 0)), box(b"minf", box(b"stbl", *table))))

    tracks = [track(b"mp4a", 1000, 1500, [3, 4], 10), track(b"avc1", 600, 1200, [5, 6, 7, 8], 100, [1, 4]), track(b"text", 10, 10, [9], 50, compact=True)]
    file = media._box(b"moov", *tracks)
    rows = media.media_columns(spark.createDataFrame([(1, bytearray(file)), (2, bytearray(media.write_container(b"x" * 192)))], "id long, content binary"), "id", "content").collect()
    got = [(r.id, r.track, r.codec, r.duration, r.n_samples, [tuple(k) for k in r.keyframes]) for r in sorted(rows)]
    assert got[:3] == [(1, 1, "mp4a", 1.5, 2, [(10, 3), (13, 4)]), (1, 2, "avc1", 2.0, 4, [(100, 5), (118, 8)]), (1, 3, "text", 1.0, 1, [(50, 9)])]
    assert [r[:3] for r in got[3:]] == [(2, 1, "raw ")]
    assert media.read_container(file)["codec"] == "mp4a"
    with pytest.raises(ValueError, match="trak"):
        media.read_tracks(media._box(b"moov"))
