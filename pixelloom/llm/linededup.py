"""Line dedup through a sharded minimal perfect hash.

1. Documents are split into lines; each line's key becomes a 128-bit hash.
2. One aggregation gives, for each hash, the number of documents and the largest doc_id.
3. Hashes found in at least two documents are dealt to shards of about ``SHARD_LINES``. Each shard
   builds a minimal perfect hash (levels of collision-free bit arrays; a hash's slot is the rank of
   its bit) over three compact arrays: 64-bit fingerprints, counts and holders.
4. Documents' hashes stream past their shard's arrays (the blob sorts first in its
   partition) and are probed in numpy; no line is joined with a line. A shard is replicated so
   often that ``SALT_SHARE`` times as many hashes as it has lines pass each copy: a line in a
   third of all documents is no hot spot, and copies stay a small part of what is dealt.
5. The hashes to drop, a list per document and text, meet the texts.

Memory: one shard, and one Arrow batch. Nothing is collected; the table of shards (a row each) is
broadcast while it is small.

Defined results: a null or empty text is one empty line. Rows that repeat a doc_id count
as one document; each row loses its own lines. A null doc_id counts as no document and so
never holds a line; its rows lose every line that is dropped elsewhere. Two different keys
are mistaken only if 128 bits of hash agree. Kept columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import SPACES, in_arrow, partitions, staged

MIN_CHARS, MIN_DOCS = 20, 3
LEVELS, GAMMA = 24, 2.0
SHARD_LINES, SALT_SHARE, LEAST_PROBES, BROADCAST_SHARDS = 500_000, 8, 1_000, 100_000


def line_keys(text: str | None) -> list[bytes]:
    """Stripped, A-Z lower-cased keys of a text's lines, as UTF-8; b"" where a key is too short."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(SPACES)
        out.append(key.encode("utf-8", "surrogatepass").lower() if len(key) >= MIN_CHARS else b"")
    return out


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Maps each of n distinct 64-bit hashes to its own slot in 0..n-1; others to any slot or -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.starts, self.ranks, at = [], [], 0
        for bits in levels:
            self.starts.append(at)
            self.ranks.append(np.cumsum(bits, dtype=np.int64))
            at += int(self.ranks[-1][-1])
        self.start_rest = at

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = np.unique(hashes), []
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(GAMMA * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, left)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            at = (_mix(hashes[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.starts[level] + self.ranks[level][at[hit]] - 1
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.start_rest + at[hit]
        return out

    def pack(self) -> list[bytes]:
        return [self.rest.tobytes(), *(len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> PerfectHash:
        levels = [np.unpackbits(np.frombuffer(p, np.uint8, offset=8), count=int.from_bytes(p[:8], "little")).astype(bool) for p in parts[1:]]
        return cls(levels, np.frombuffer(parts[0], np.uint64))


class LineIndex:
    """Fingerprint, count and holder arrays addressed by a perfect hash.

    Where two lines share the 64 bits that the function takes, both go to ``twins``, a small
    table of (low, high, count, holder) that is looked through by itself.
    """

    def __init__(self, function: PerfectHash, fingerprints, counts, holders, twins):
        self.function, self.fingerprints, self.counts, self.holders, self.twins = function, fingerprints, counts, holders, twins

    @classmethod
    def build(cls, low, high, counts, holders) -> LineIndex:
        _, back, often = np.unique(low, return_inverse=True, return_counts=True)
        twin = often[back] > 1
        twins = np.stack([x[twin].astype(np.int64, copy=False).view(np.uint64) for x in (low.view(np.int64), high.view(np.int64), counts, holders)]) if twin.any() else np.empty((4, 0), np.uint64)
        low, high, counts, holders = (x[~twin] for x in (low, high, counts, holders))
        function = PerfectHash.build(low)
        at = function.slots(low)
        order = np.empty(len(low), np.int64)
        order[at] = np.arange(len(low))
        return cls(function, high[order], np.minimum(counts[order], 2**32 - 1).astype(np.uint32), holders[order].astype(np.int64), twins)

    def pack(self) -> list[bytes]:
        return [self.fingerprints.tobytes(), self.counts.tobytes(), self.holders.tobytes(), self.twins.tobytes(), *self.function.pack()]

    @classmethod
    def unpack(cls, parts) -> LineIndex:
        return cls(PerfectHash.unpack(parts[4:]), np.frombuffer(parts[0], np.uint64), np.frombuffer(parts[1], np.uint32), np.frombuffer(parts[2], np.int64), np.frombuffer(parts[3], np.uint64).reshape(4, -1))

    def probe(self, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not indexed) and holder of each hash."""
        count, holder = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        if len(self.counts):
            at = self.function.slots(low)
            known = (at >= 0) & (self.fingerprints[at] == high)
            count[known], holder[known] = self.counts[at[known]], self.holders[at[known]]
        for a, b, n, h in self.twins.T:
            same = (low == a) & (high == b)
            count[same], holder[same] = n, h.view(np.int64)
        return count, holder


def _hash_lines(batches):
    for b in batches:
        at, lows, highs = [], [], []
        for k, text in enumerate(b.column(2).to_pylist()):
            for d in {xxhash.xxh3_128_digest(x) for x in line_keys(text) if x}:
                at.append(k)
                lows.append(d[:8])
                highs.append(d[8:])
        low, high = (pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (lows, highs))
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), low, high], ["id", "own", "low", "high"])


def _build_shard(key, rows):
    parts = LineIndex.build(rows["low"].to_numpy().view(np.uint64), rows["high"].to_numpy().view(np.uint64), rows["docs"].to_numpy(), rows["holder"].to_numpy()).pack()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "parts": pa.array([parts], pa.list_(pa.binary()))})


def _probe(min_docs: int):
    def run(batches):
        copy, index = None, None
        for b in batches:
            copies = b.column("copy").to_numpy(zero_copy_only=False)
            blobs = b.column("parts")
            cuts = [0, *(np.flatnonzero(np.diff(copies)) + 1).tolist(), len(copies)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if copies[lo] != copy:
                    copy, index = copies[lo], None
                if blobs[lo].is_valid:
                    index, lo = LineIndex.unpack(blobs[lo].as_py()), lo + 1
                if index is None or lo == hi:
                    continue  # no line of this shard is in two documents
                part = b.slice(lo, hi - lo)
                low, high = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("low", "high"))
                count, holder = index.probe(low, high)
                ids = part.column("id")
                own = ids.fill_null(0).to_numpy(zero_copy_only=False)
                drop = pa.array((count >= min_docs) & ((own != holder) | ids.is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(drop) for c in ("id", "own", "low", "high")], ["id", "own", "low", "high"])

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list:
    """The doc_id, a key of the text, and the text. Rows alike in both lose the same lines; so do rows whose keys clash."""
    return [F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("own"), F.col(text).alias("text")]


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, own, low, high) for each doc_id, text key and line hash that its rows lose; ids may be null."""
    spark = docs.sparkSession
    schema = "id long, own long, low long, high long"
    lines = staged(in_arrow(docs.select(*_keyed(docs, doc_id, text)), _hash_lines, schema), "lines")
    known = lines.where("id is not null").groupBy("low", "high").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("holder")).where("docs >= 2")
    known = staged(known, "known")
    n = max(8, partitions(spark))
    shards = max(n, -(-known.count() // SHARD_LINES))
    shard = F.pmod(F.xxhash64("low", F.lit(1)), F.lit(shards)).cast("int")
    sizes = known.groupBy(shard.alias("shard")).agg(F.count("*").alias("known"))
    most = F.greatest(F.lit(LEAST_PROBES), SALT_SHARE * F.coalesce("known", F.lit(0)))
    salts = lines.groupBy(shard.alias("shard")).agg(F.count("*").alias("probes")).join(sizes, "shard", "left")
    salts = staged(salts.select("shard", F.ceil(F.col("probes") / most).cast("int").alias("salts")), "salts")
    salts = F.broadcast(salts) if shards <= BROADCAST_SHARDS else salts
    blobs = known.withColumn("shard", shard).groupBy("shard").applyInArrow(_build_shard, "shard int, parts array<binary>").join(salts, "shard")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("id", "own", "low", "high")]
    blobs = blobs.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "parts", *nothing, F.lit(0).alias("kind"))
    probes = lines.withColumn("shard", shard).join(salts, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("id", "own", F.lit(2)), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("array<binary>").alias("parts"), "id", "own", "low", "high", F.lit(1).alias("kind"))
    both = blobs.unionByName(probes).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    both = both.select((F.col("shard").cast("long") * 2**32 + F.col("salt")).alias("copy"), "parts", "id", "own", "low", "high")
    return in_arrow(both, _probe(min_docs), schema)


def _rewrite(batches):
    for b in batches:
        out = {"n_lines": [], "n_dropped": [], "kept": []}
        for text, drops in zip(b.column("text").to_pylist(), b.column("drops").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            if drops:
                gone = {(d["low"].to_bytes(8, "little", signed=True) + d["high"].to_bytes(8, "little", signed=True)) for d in drops}
                stay = [x for x, k in zip(lines, line_keys(text), strict=True) if not k or xxhash.xxh3_128_digest(k) not in gone]
            else:
                stay = lines
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(stay))
            out["kept"].append("\n".join(stay))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept"], pa.string())], ["row", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep: list[str] | None = None) -> DataFrame:
    """One row per document row: ``row`` (a struct of the kept columns), n_lines, n_dropped and the text ``kept``."""
    drops = dropped_lines(docs, doc_id, text, min_docs).distinct().groupBy("id", "own").agg(F.collect_list(F.struct("low", "high")).alias("drops"))
    own = docs.select(F.struct(*[F.col(c) for c in keep or [doc_id]]).alias("row"), *_keyed(docs, doc_id, text))
    drops = drops.select(F.col("id").alias("d_id"), F.col("own").alias("d_own"), "drops")
    joined = own.join(drops, (own["own"] == F.col("d_own")) & own["id"].eqNullSafe(F.col("d_id")), "left").select("row", "text", "drops")
    kind = joined.schema["row"].dataType.simpleString()
    return in_arrow(joined, _rewrite, f"row {kind}, n_lines long, n_dropped long, kept string")
