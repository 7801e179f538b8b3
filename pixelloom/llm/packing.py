"""Best-fit packing of token pieces, after a Martello-Toth dominance reduction.

1. Tokens: a few megabytes of text at a time are cut at white space (the tokenizer drops it,
   so tokens never cross it); each distinct chunk is encoded once, and its ids are remembered per
   worker, in a bounded memory.
2. Pieces: documents above the capacity are cut; whole pieces are sequences of their own.
3. The other pieces are dealt to shards of about ``SHARD_PIECES`` (many enough that the last,
   partly empty sequence of a shard does not matter).
4. In a shard, the reduction permanently fixes small sets that dominate every other set that
   could hold the piece: a piece that nothing fits with; two pieces that fill a sequence; where
   at most one more piece fits, the largest that does; where two fit, the largest single
   one if it is no smaller than any two that fit, else that one with the largest that fits beside
   it, if no two larger than the latter fit. Rounds end when none is found; what remains goes
   best fit, largest first.

Defined results: null and empty texts are one piece with the end id alone. Rows that repeat a
doc_id are packed each. Empty tables give no rows. Ids are 32 bits.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import in_arrow, spans_of_bytes, staged

CAPACITY, SHARD_PIECES = 2048, 60_000
#: Bounds of a worker's memory of chunks: how many, their ids, and the bytes of text that are looked up at once.
CACHE, CACHE_IDS, SPAN = 500_000, 3_000_000, 4 << 20

#: Visible characters of Latin-1.
PLAIN = re.compile(r"[!-~\xa1-\xff]+").fullmatch
#: Fixed value: the tokenizer's split pattern, written out for lower-cased Latin-1.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+").findall
#: Fixed value: how this vocabulary marks the last token of a word.
WORD_END = "</w>"


def _gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(counts)
    return ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class _Places(dict):
    """Places by chunk; -1 for those that are not known."""

    def __missing__(self, chunk: str) -> int:
        return -1


class _ChunkIds:
    """Ids of chunks without white space, one after the other in ``tokens``, by ``starts`` and ``counts``.

    The tokenizer lower-cases and then splits a chunk into letters, single digits and other
    signs; the last token of each is marked. So chunks within Latin-1, where its normal form changes
    nothing else, are split here and go to its merges many in one text, and the marks tell them apart again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.own = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.last[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.tokens, self.counts, self.starts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where ``counts`` and ``starts`` have each of the distinct chunks."""
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(self.place) + len(new) > CACHE or len(self.tokens) > CACHE_IDS:
            self.clear()
            new = np.arange(len(chunks))
        if len(new):
            names = [chunks[k] for k in new.tolist()]
            self._learn(names)
            at[new] = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        return at

    def _learn(self, new: list[str]) -> None:
        plain = [c for c in new if PLAIN(c) and "<|" not in c]
        known = set(plain)
        whole = [c for c in new if c not in known]
        found = [self._together(plain)] if plain else []
        found += [self._each(whole[lo : lo + 8192]) for lo in range(0, len(whole), 8192)]
        counts = np.concatenate([n for _, n in found])
        starts = len(self.tokens) + np.cumsum(counts) - counts
        self.place.update(zip(plain + whole, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.tokens = np.concatenate([self.tokens, *(x for x, _ in found)])
        self.counts, self.starts = np.concatenate([self.counts, counts]), np.concatenate([self.starts, starts])

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids one after the other, and how many each has; each distinct piece is merged once."""
        split = list(map(PIECES, " ".join(chunks).lower().split(" ")))
        pieces = list(chain.from_iterable(split))
        number = dict(zip(dict.fromkeys(pieces), count()))
        distinct = list(number)
        ids = []
        for lo in range(0, len(distinct), 16_384):
            texts = [" ".join(distinct[i : i + 256]) for i in range(lo, min(len(distinct), lo + 16_384), 256)]
            ids += [np.array(x, np.uint32) for x in self._encode(texts, self.plain)]
        ids = np.concatenate(ids)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(distinct):  # a vocabulary without such marks
            return self._each(chunks)
        sizes = np.diff(ends, prepend=0)
        at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        first = np.cumsum([0, *map(len, split)])[:-1]
        return _gather(ids, ends[at] - sizes[at], sizes[at]), np.add.reduceat(sizes[at], first)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(chunks, self.own)
        return np.array([x for own in ids for x in own], np.uint32), np.array([len(own) for own in ids], np.int64)

    def _encode(self, texts: list[str], steps: tuple) -> list[list[int]]:
        """Ids of texts, split by the tokenizer's own steps or at spaces alone."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_known: dict[str, _ChunkIds] = {}


def token_ids(texts: pa.Array, path: str):
    """Ids of each text, in order; a null text has none."""
    ids = _known.get(path) or _known.setdefault(path, _ChunkIds(path))
    for lo, hi in spans_of_bytes(texts, SPAN):
        part = pc.replace_substring(pc.replace_substring(texts.slice(lo, hi - lo).fill_null(""), "\n", " "), "\t", " ")
        split = pc.split_pattern(part, " ")
        coded = split.flatten().dictionary_encode()
        at = ids.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        counts = ids.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        tokens = _gather(ids.tokens, ids.starts[at], counts)
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tokens[a:b]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes."""
    return [x.astype("<u4").tobytes() for x in token_ids(pa.array(texts, pa.string()), path)]


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), token_ids(b.column(1), path), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo : lo + capacity]
                    for col, v in zip(rows, (doc, k, lo, len(part), zlib.crc32(part)), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    own = docs.select(F.col(doc_id).cast("long"), text)
    return in_arrow(own, _cut(vocabulary, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Sizes:
    """A multiset of sizes up to the capacity: counts, and the sorted list of sizes present."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.present = [s for s, n in enumerate(self.count) if n]

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.present.pop(bisect_left(self.present, size))

    def put(self, size: int) -> None:
        self.count[size] += 1
        if self.count[size] == 1:
            self.present.insert(bisect_left(self.present, size), size)

    def largest_within(self, room: int) -> int:
        k = bisect_right(self.present, room)
        return self.present[k - 1] if k else 0

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.present:
            out += [s] * min(self.count[s], n - len(out))
            if len(out) == n:
                break
        return out


def reduce_by_dominance(left: _Sizes, capacity: int) -> list[list[int]]:
    """Takes the sets that Martello and Toth's criterion fixes out of ``left``; sets of one to three sizes."""
    fixed: list[list[int]] = []
    # Pairs that fill a sequence: in any packing the two can be brought together.
    for s in [s for s in left.present if 2 * s <= capacity]:
        other = capacity - s
        pairs = left.count[s] // 2 if s == other else min(left.count[s], left.count[other])
        for _ in range(pairs):
            left.take(s)
            left.take(other)
            fixed.append([other, s])
    found = True
    while found and left.present:
        found = False
        for size in reversed(left.present.copy()):
            room = capacity - size
            while left.count[size]:
                left.take(size)
                small = left.smallest(3)
                best = left.largest_within(room)
                if not best:  # nothing fits
                    fixed.append([size])
                elif len(small) < 2 or small[0] + small[1] > room:  # at most one more fits
                    left.take(best)
                    fixed.append([size, best])
                elif (len(small) < 3 or sum(small) > room) and best >= _best_pair(left, room, best):
                    left.take(best)
                    fixed.append([size, best])
                elif (len(small) < 3 or sum(small) > room) and (second := _dominating_second(left, room, best)):
                    left.take(best)
                    left.take(second)
                    fixed.append([size, best, second])
                else:
                    left.put(size)
                    break
                found = True
            small = left.smallest(3)
            if len(small) == 3 and sum(small) <= room:
                break  # sets of four fit here and with all smaller sizes; the criterion tells no more
    return fixed


def _best_pair(left: _Sizes, room: int, most: int) -> int:
    """The largest sum of two sizes within ``room``."""
    best = 0
    for a in left.present.copy():
        if 2 * a > room:
            break
        left.take(a)
        b = left.largest_within(room - a)
        left.put(a)
        if b:
            best = max(best, a + b)
        if best > most:
            break
    return best


def _dominating_second(left: _Sizes, room: int, best: int) -> int:
    """The largest size that fits beside ``best``, if the two dominate every pair within ``room``; else 0.

    Where no two sizes larger than it fit, one of any pair is no larger than it, and the other no
    larger than ``best``, the largest that fits.
    """
    left.take(best)
    second = left.largest_within(room - best)
    left.put(best)
    larger: list[int] = []
    for s in left.present[bisect_right(left.present, second) :]:
        larger += [s] * min(left.count[s], 2 - len(larger))
        if len(larger) == 2:
            break
    return 0 if len(larger) == 2 and sum(larger) <= room else second


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: every size goes where the least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_: list[int] = []  # rooms that some bin has, sorted
    for size in sorted(lengths, reverse=True):
        k = bisect_left(open_, size)
        if k < len(open_):
            room = open_[k]
            b = by_room[room].pop()
            if not by_room[room]:
                open_.pop(k)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(size)
        room -= size
        if room:
            if not by_room[room]:
                open_.insert(bisect_left(open_, room), room)
            by_room[room].append(b)
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length."""
    left = _Sizes(lengths, capacity)
    bins = reduce_by_dominance(left, capacity)
    bins += best_fit([s for s in left.present for _ in range(left.count[s])], capacity)
    order = np.argsort(lengths, kind="stable")
    at = np.searchsorted(lengths[order], np.arange(capacity + 2)).tolist()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, sizes in enumerate(bins):
        used = 0
        for s in sizes:
            i = order[at[s]]
            at[s] += 1
            sequence[i], offset[i] = b, used
            used += s
    return sequence, offset


def _pack_shard(capacity: int):
    def run(key, rows):
        sequence, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        rows = rows.drop_columns(["shard"])
        return rows.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = staged(pieces(docs, vocabulary, capacity, end_id, doc_id, text), "pieces")
    part = rows.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))
    # Whole pieces need no packing; their sequence ids are below zero.
    whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return part.withColumn("shard", shard).groupBy("shard").applyInArrow(_pack_shard(capacity), schema).unionByName(whole)
