"""Exact n-gram Jaccard join as a blocked sparse product, and the components of its links.

Documents are rows and n-grams columns of an incidence matrix. Two documents of n-gram sets
of size x and y link when 100 |both| >= 75 |either|, that is when their overlap count, an entry
of the product of the matrix with its transpose, is at least ceil(75 (x + y) / 175). Every link is
decided by such a count, added up by columns over whole rows; only the entries that could reach
the bound are computed:

1. Column counts. Each task packs the sorted 40-bit keys of its columns with their counts;
   key ranges are merged, and the most frequent columns (at least ``HEAVY``, at most
   ``MAX_HEAVY`` of them: 12 MB) are sent to all tasks. They come last in the column order,
   by count. That is only an order: whatever is or is not in the list, no link is lost.
2. Rows. Each document gives a signature of its set (equal sets are one node from here on),
   min-hash keys and its prefix, the first n - ceil(0.75 n) + 1 of its columns in that order:
   under any one order linked rows share a column of their prefixes.
3. Order of work. Nodes with an equal min-hash key share a leader, the one with the fewest
   rare columns. The product of each leader's row with the rows that chose it gives first links,
   whose components are one row from here on. That only saves work later on.
4. Product of prefixes. The prefixes, dealt by column, are sorted; each block of columns adds its
   partial products up in numpy. Rows that share a leader go to a family, whole; so do the rows of a
   column of more than ``WIDE``. Other pairs are added up, and sums below the bound that the sizes
   give are discarded.
5. Product of whole rows. Families, and the pairs left, are blocks of rows: rows stream past a
   block's columns and their overlap counts with all rows of the block add up at once. Blocks
   hold at most ``BLOCK_COLUMNS`` entries or one row, and as many entries stream past one; larger
   ones are dealt to more tasks. A block gives the links that join its components, not all pairs.

Defined results: A-Z are lower-cased; null, empty and blank texts have the empty set and link
with nothing. Texts with fewer words than ``n`` have one n-gram of all words. Rows that
repeat a doc_id are rows of their own. A null doc_id links with nothing and has a null
component. N-grams are compared by 64-bit hash, sets by 64 bits of signature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import in_arrow, partitions, settled, small, spans_of_bytes, staged
from pixelloom.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
KEY_BITS = 40
HEAVY, MAX_HEAVY = 12, 1_000_000
HASHES = 8
#: Columns that more rows than these share make a family of them; fewer are paired.
WIDE = 64
#: Entries of the rows in a block, and of those that stream past it in one task.
BLOCK_COLUMNS = 1_000_000
_U = np.uint64
_MULTIPLIERS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ngram_sets(texts: pa.Array, n: int = WORDS):
    """Sorted distinct 64-bit hashes of each text's n-grams of lower-cased words, in order.

    Words are hashed once a distinct word of a few megabytes of text; the n-grams of all of them at once.
    """
    for lo, hi in spans_of_bytes(texts):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo).fill_null("")))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        codes = coded.indices.to_numpy()
        real = np.array([len(w) > 0 for w in names], bool)[codes] if len(names) else np.empty(0, bool)
        ends = np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        codes = codes[real]
        h, m = hashes[codes], max(0, len(codes) - n + 1)
        with np.errstate(over="ignore"):
            x = h[:m] * _MULTIPLIERS[0]
            for k in range(1, n):
                x = (x ^ (x >> _U(29))) * _MULTIPLIERS[k % 8] + h[k : m + k]
            x = _finish(x)
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            if b - a >= n:
                yield _distinct(x[a : b - n + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join(names[c] for c in codes[a:b]), seed=b - a)], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def signature(grams: np.ndarray) -> int:
    """63 bits for a set (0 for the empty one)."""
    return (xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1 or 1) if len(grams) else 0


def _pack(values: np.ndarray) -> bytes:
    """Sorted integers as byte planes of their differences, which compress well."""
    return np.diff(values, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T[:5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.zeros((len(data) // 5, 8), np.uint8)
    planes[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return np.cumsum(planes.reshape(-1).view(np.uint64), dtype=np.uint64)


def _count_keys(ranges: int, n: int, flush: int = 4_000_000):
    width = -(-(2**KEY_BITS) // ranges)

    def emit(held):
        keys, counts = np.unique(np.concatenate(held) >> _U(64 - KEY_BITS), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * _U(width))
        rows = [(k, _pack(keys[a:b]), np.minimum(counts[a:b], 2**32 - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for grams in ngram_sets(b.column(0), n):
                held.append(grams)
                size += len(held[-1])
                if size >= flush:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    return run


def _merge_counts(least: int):
    def run(_, rows):
        keys = np.concatenate([_unpack(x) for x in rows["keys"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for x in rows["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, first)
        keep = sums >= least
        return pa.table({"key": pa.array(keys[first][keep].astype(np.int64)), "count": pa.array(sums[keep])})

    return run


def heavy_columns(docs: DataFrame, text: str, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent column keys, sorted, with their places in the order (rarest first)."""
    ranges = 4 * max(8, partitions(docs.sparkSession))
    packed = in_arrow(docs.select(text), _count_keys(ranges, n), "part int, keys binary, counts binary")
    counted = packed.groupBy("part").applyInArrow(_merge_counts(HEAVY), "key long, count long")
    top = counted.orderBy(F.desc("count"), "key").limit(MAX_HEAVY).toArrow()
    keys, counts = top["key"].to_numpy().astype(np.uint64), top["count"].to_numpy()
    place = np.empty(len(keys), np.int64)
    place[np.lexsort((keys, counts))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], place[order]


def prefix_length(size):
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def _describe(heavy, n: int):
    masks = np.array([(k << 61) ^ 0x0F0E0D0C0B0A0908 * (k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(HASHES)], np.uint64)

    def run(batches):
        keys, place = heavy.value
        for b in batches:
            sizes, nodes, rare, mins, firsts = [], [], [], [], []
            for g in ngram_sets(b.column("text"), n):
                size = len(g)
                sizes.append(size)
                nodes.append(signature(g))
                if not size:
                    rare.append(0)
                    mins.append(None)
                    firsts.append(None)
                    continue
                mins.append([int(x) for x in (_finish_keys(g, masks))])
                if len(keys):
                    short = g >> _U(64 - KEY_BITS)
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    hot = keys[at] == short
                else:
                    hot = np.zeros(size, bool)
                rare.append(int(size - hot.sum()))
                order = g[~hot]
                length = prefix_length(size)
                if len(order) < length:
                    order = np.concatenate([order, g[hot][np.argsort(place[at[hot]], kind="stable")]])
                firsts.append((order[:length] >> _U(64 - KEY_BITS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(mins, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                ["doc_id", "node", "size", "rare", "mins", "prefix"],
            )

    return run


def _finish_keys(grams: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Min-hash keys: the hash that is least under each of some xor permutations, tagged with it."""
    with np.errstate(over="ignore"):
        least = np.array([(grams ^ m).min() for m in masks], np.uint64)
        return (least * _MULTIPLIERS[1] + masks).view(np.int64)


def _own_sets(n: int):
    """Sets of the wanted nodes: drops texts that another row with the doc_id has, and repeats within the task."""

    def run(batches):
        seen = set()
        for b in batches:
            nodes, sets = [], []
            for node, grams in zip(b.column("node").to_pylist(), ngram_sets(b.column("text"), n), strict=True):
                if node not in seen and signature(grams) == node:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


class _Block:
    """Rows held by column; overlap counts of another row with all of them at once."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.classes = np.array([c for c, _ in rows], np.int64)
        self.sizes = np.array([len(g) for _, g in rows])
        values = np.concatenate([g for _, g in rows])
        order = np.argsort(values, kind="stable")
        values, self.owners = values[order], np.repeat(np.arange(len(rows)), self.sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.columns, self.starts = values[first], np.append(first, len(values))

    def overlaps(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.columns, grams), len(self.columns) - 1)
        at = at[self.columns[at] == grams]
        if len(self.sizes) == 1:
            return np.array([len(at)])
        parts = [self.owners[lo:hi] for lo, hi in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=len(self.sizes)) if parts else np.zeros(len(self.sizes), np.int64)

    def linked(self, grams: np.ndarray) -> np.ndarray:
        """The classes of the rows whose overlap reaches the bound."""
        both = self.overlaps(grams)
        return self.classes[(both > 0) & ((NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (self.sizes + len(grams)))]


def _row_products(batches):
    """Links (a, b) of classes from rows (part, stream, class, grams) sorted by part: the block's rows first, then those that stream past.

    Classes that the part has linked are one from there on, so it gives a forest of links.
    """
    part, held, block, root = None, [], None, {}

    def find(c):
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    for b in batches:
        links = []
        for p, stream, own, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if p != part:
                part, held, block, root = p, [], None, {}
            grams = np.frombuffer(data, np.uint64)
            if not stream:
                held.append((own, grams))
                continue
            if not held:
                continue
            block = block or _Block(held)
            for other in set(block.linked(grams).tolist()):
                if (x := find(other)) != (y := find(own)):
                    root[max(x, y)] = min(x, y)
                    links.append((other, own))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def row_links(roles: DataFrame, members: DataFrame, nodes: DataFrame, docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Links of classes by products of whole rows.

    roles: block, kind, stream (whether the class streams past the block or is in it), class; members: class,
    node, size; nodes: node, doc_id; docs: doc_id, text.
    """
    met = roles.join(members, "class")
    met = staged(met.select("block", "kind", "stream", "class", "node", "size"), "met")
    large = met.groupBy("block", "kind").agg(*(F.ceil(F.sum(F.when(F.col("stream") == k, F.col("size"))) / BLOCK_COLUMNS).cast("int").alias(c) for c, k in (("pieces", False), ("streams", True))))
    large = small(staged(large.where("pieces > 1 or streams > 1"), "large"))
    wanted = met.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = in_arrow(docs.join(small(staged(wanted, "wanted")), "doc_id").select("node", "text"), _own_sets(n), "node long, grams binary")
    met = met.join(large, ["block", "kind"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("pieces", "streams")})
    # A block's row is in one piece and meets all parts of the stream; a row of the stream the reverse.
    other = F.when(F.col("stream"), F.col("pieces")).otherwise(F.col("streams"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("stream"), F.col("streams")).otherwise(F.col("pieces"))).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    part = F.struct("block", "kind", F.when(F.col("stream"), F.col("other")).otherwise(F.col("own")).alias("piece"), F.when(F.col("stream"), F.col("own")).otherwise(F.col("other")).alias("salt"))
    dealt = met.select(part.alias("part"), "stream", "class", "node").join(sets, "node").select("part", "stream", "class", "grams")
    dealt = dealt.repartition(max(8, partitions(docs.sparkSession)), "part").sortWithinPartitions("part", "stream")
    return in_arrow(dealt, _row_products, "a long, b long")


def _bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_finish(a.view(np.uint64) * _MULTIPLIERS[0] + b.view(np.uint64)) % _U(buckets)).astype(np.int64)


def _summed(pairs: np.ndarray) -> np.ndarray:
    """Columns (a, b, low a, high a, low b, high b, leader of a, shared) with equal (a, b) added up."""
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pairs[0]) != 0) | (np.diff(pairs[1]) != 0)]))
    return np.concatenate([pairs[:7, first], np.add.reduceat(pairs[7], first)[None]])


SALTS = 8


def _product(buckets: int, wide: int, block: int = 512, flush: int = 300_000):
    """Partial products of sorted (column, class, low, high, leader), packed: by the bucket of their pair, and by family."""

    def run(batches):
        held, size, families, named = [], 0, {}, 0

        def pairs_out():
            pairs = _summed(np.concatenate(held, axis=1))
            at = _bucket(pairs[0], pairs[1], buckets)
            order = np.argsort(at, kind="stable")
            pairs, at = pairs[:, order], at[order]
            cuts = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist(), len(at)]
            return [(False, int(at[lo]), 0, np.ascontiguousarray(pairs[:, lo:hi]).tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False)]

        def families_out():
            rows = []
            for f, names in families.items():
                names = np.array(sorted(names), np.int64)
                salt = _bucket(names, names, SALTS)
                rows += [(True, f, k, own.tobytes()) for k in range(SALTS) if len(own := names[salt == k])]
            return rows

        def batch(rows):
            kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["family", "key", "salt", "data"])

        def gather(f, names):
            nonlocal named
            own = families.setdefault(f, set())
            before = len(own)
            own.update(names)
            named += len(own) - before

        def column(names, low, high, leader):
            """Families of one column at once; its other pairs, in blocks."""
            nonlocal size
            if len(names) > wide:
                several, often = np.unique(leader, return_counts=True)
                gather(int(several[often.argmax()]), names.tolist())
                return
            order = np.argsort(leader, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(leader[order])) + 1).tolist(), len(order)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    gather(int(leader[order[lo]]), names[order[lo:hi]].tolist())
            for i in range(0, len(names), block):
                for j in range(i, len(names), block):
                    x, y = slice(i, i + block), slice(j, j + block)
                    fit = (DENOMINATOR * high[x][:, None] >= NUMERATOR * low[y][None, :]) & (DENOMINATOR * high[y][None, :] >= NUMERATOR * low[x][:, None])
                    fit &= leader[x][:, None] != leader[y][None, :]
                    if i == j:
                        fit = np.triu(fit, 1)
                    p, q = np.nonzero(fit)
                    if len(p):
                        held.append(np.stack([names[x][p], names[y][q], low[x][p], high[x][p], low[y][q], high[y][q], leader[x][p], np.ones(len(p), np.int64)]))
                        size += len(p)

        def columns(parts):
            """Whole columns out of the parts."""
            key, names, low, high, leader = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (names[1:] != names[:-1])]))
            key, names, leader = key[starts], names[starts], leader[starts]
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for k in np.flatnonzero(np.diff(edges) > 1):
                s = slice(edges[k], edges[k + 1])
                column(names[s], low[s], high[s], leader[s])
                if size >= flush or named >= flush:
                    yield from out()

        def out():
            nonlocal held, size, families, named
            rows = (pairs_out() if size else []) + families_out()
            held, size, families, named = [], 0, {}, 0
            if rows:
                yield batch(rows)

        open_: list = []  # parts of the column that the last batch has cut
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            if last:
                yield from columns([*open_, [x[:last] for x in part]])
                open_ = []
            elif open_ and open_[-1][0][-1] != part[0][0]:
                yield from columns(open_)
                open_ = []
            open_.append([x[last:] for x in part])
        if open_:
            yield from columns(open_)
        yield from out()

    return run


def least_shared(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least columns that linked sets of these sizes share within their prefixes.

    That is all that they must share, less what may lie behind the longer prefix, less one, as two
    columns of a prefix could share a key. Where a side has members of several sizes, 1.
    """
    small = np.minimum(low_a, low_b)
    large = np.minimum(np.maximum(high_a, high_b), small * DENOMINATOR // NUMERATOR)
    must = -(-NUMERATOR * (small + large) // (NUMERATOR + DENOMINATOR))
    behind = -(-NUMERATOR * large // DENOMINATOR) - 1
    return np.where((low_a < high_a) | (low_b < high_b), 1, must - behind - 1)


def _sum_bucket(_, rows):
    """Adds up a bucket's partial products; the classes of the pairs that reach their bound, by the leader of the first."""
    parts = [np.frombuffer(x, np.int64).reshape(8, -1) for x in rows["data"].to_pylist()]
    total = _summed(np.concatenate(parts, axis=1))
    total = total[:, total[7] >= least_shared(*total[2:6])]
    sides = [np.unique(total[[6, k]], axis=1) for k in (0, 1)]
    return pa.table({"block": pa.array(np.concatenate([s[0] for s in sides])), "second": pa.array(np.repeat([False, True], [s.shape[1] for s in sides])), "class": pa.array(np.concatenate([s[1] for s in sides]))})


def _name_family(key, rows):
    names = _distinct(np.concatenate([np.frombuffer(x, np.int64) for x in rows["data"].to_pylist()]))
    return pa.table({"block": pa.array(np.full(len(names), key[0].as_py(), np.int64)), "class": pa.array(names)})


def _roles(products: DataFrame, members: DataFrame) -> DataFrame:
    """What is in each block and what streams past it: of a family all past all but the largest class, of pairs the heavier side past the other."""
    whole = staged(members.groupBy("class").agg(F.sum("size").alias("columns")), "classes")
    family = products.where("family").groupBy("key", "salt").applyInArrow(_name_family, "block long, class long").join(whole, "class")
    family = staged(family, "families")
    largest = family.groupBy("block").agg(F.max_by("class", F.struct("columns", "class")).alias("largest"), F.count("*").alias("several")).where("several > 1")
    past = F.when(F.col("class") == F.col("largest"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    family = family.join(largest, "block").select("block", F.lit(0).alias("kind"), F.explode(past).alias("stream"), "class")
    pairs = staged(products.where("not family").groupBy("key").applyInArrow(_sum_bucket, "block long, second boolean, class long").distinct().join(whole, "class"), "pairs")
    side = lambda flag: F.coalesce(F.sum(F.when(F.col("second") == flag, F.col("columns"))), F.lit(0))
    heavier = pairs.groupBy("block").agg((side(True) >= side(False)).alias("heavier"))
    pairs = pairs.join(heavier, "block").select("block", F.lit(1).alias("kind"), (F.col("second") == F.col("heavier")).alias("stream"), "class")
    return family.unionByName(pairs)


def _sign(n: int):
    def run(batches):
        for b in batches:
            marks = [signature(g) for g in ngram_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64())], ["row", "node"])

    return run


def with_signature(docs: DataFrame, text: str = "text", n: int = WORDS) -> DataFrame:
    """Each row as a struct ``row``, with the signature of its set as ``node``."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return in_arrow(own, _sign(n), f"row {own.schema['row'].dataType.simpleString()}, node long")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of each document row."""
    return row_classes(docs, doc_id, text, n).select("doc_id", "n_shingles", "component_id")


def _node_classes(rows: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """node, class and the least doc_id of the class, from the described rows and their texts (doc_id, text)."""
    spark = rows.sparkSession
    known = rows.where("size > 0 and doc_id is not null")
    # Copies are one row from here on, so that a large family of them is no hot column.
    nodes = staged(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("size", "rare", "mins", "prefix"))), "nodes")

    # First links: every node meets the leader with which it has most min-hash keys in common.
    keys = nodes.select("node", "size", "rare", F.explode("mins").alias("key"))
    leaders = keys.groupBy("key").agg(F.min_by(F.struct("node", "size"), F.struct((F.col("rare") / F.col("size")).alias("share"), "node")).alias("to"), F.count("*").alias("members")).where("members > 1")
    met = keys.join(leaders, "key").where("node != to.node").where(f"{DENOMINATOR} * size >= {NUMERATOR} * to.size and {DENOMINATOR} * to.size >= {NUMERATOR} * size")
    votes = met.groupBy("node", F.col("to.node").alias("leader")).agg(F.count("*").alias("votes"))
    star = staged(votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader")), "stars")
    own_class = nodes.select(F.col("node").alias("class"), "node", "size")
    block = lambda c, stream: star.select(F.col("leader").alias("block"), F.lit(0).alias("kind"), F.lit(stream).alias("stream"), F.col(c).alias("class"))
    first = settled(spark, lambda: row_links(block("leader", False).distinct().unionByName(block("node", True)), own_class, nodes, own, n), "links")
    found = settled(spark, lambda: components(first), "components")

    # Product of prefixes: components are the rows. A row's leader is the class of the one that its node chose.
    bounds = nodes.join(found, "node").groupBy("component").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    lookup = staged(found.join(bounds, "component"), "lookup")
    led = star.join(found.withColumnRenamed("node", "leader"), "leader", "left").select("node", F.coalesce("component", "leader").alias("leader"))
    lookup = staged(lookup.join(led, "node", "full").select("node", "component", "low", "high", F.coalesce("component", "leader").alias("leader")), "lookup")
    entries = nodes.join(small(lookup), "node", "left")
    entry = lambda df: df.select(F.explode("prefix").alias("column"), F.coalesce("component", "node").alias("class"), F.coalesce("low", "size").alias("low"), F.coalesce("high", "size").alias("high"), F.coalesce("leader", "node").alias("leader"))
    entries = entry(entries.where("component is null")).unionByName(entry(entries.where("component is not null")).distinct())
    parts = max(8, partitions(spark))
    sorted_ = entries.repartition(parts, "column").sortWithinPartitions("column", "class")
    products = staged(in_arrow(sorted_, _product(8 * parts, WIDE), "family boolean, key long, salt int, data binary"), "products")

    # Product of whole rows: what the prefixes have left.
    members = staged(nodes.join(found, "node", "left").select(F.coalesce("component", "node").alias("class"), "node", "size"), "members")
    rest = settled(spark, lambda: row_links(_roles(products, members), members, nodes, own, n), "links")
    classes = settled(spark, lambda: components(first.unionByName(rest)), "components")

    named = staged(nodes.join(classes, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class")), "named")
    least = staged(named.groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least, "class").select("node", "class", "least")


def row_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """As ``jaccard_classes``, with ``node``, the signature of the row's set, and ``class``, which names its component's rows alone.

    Two components can have one component_id where rows repeat a doc_id. Empty sets are 0 in both.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_columns(own, "text", n))
    rows = staged(in_arrow(own, _describe(heavy, n), "doc_id long, node long, size int, rare int, mins array<long>, prefix array<long>"), "sets")
    heavy.unpersist()
    named = settled(spark, lambda: _node_classes(rows, own, n), "named")
    out = rows.select("doc_id", "node", F.col("size").cast("long").alias("n_shingles")).join(named, "node", "left")
    own_id = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "node", F.coalesce("class", "node").alias("class"), "n_shingles", own_id.alias("component_id"))
