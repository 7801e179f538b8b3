"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. A document's size is its number of words; sizes are added up by source and shard. A
   shard is a seeded part of a source, so a source with a third of all rows has many.
2. Targets: sources in code-point order (null last) have weights 1, 2, 3, repeating. They
   share the sum of all sizes; a target stops at ``most_repeats`` times its source's size and
   the excess is shared again by weight until none is above.
3. Blocks of ``block`` words are apportioned by highest quotients target / (2 k + 1), to
   sources and then, within each, to shards by their size. (The quotients are found through
   the divisor that separates them, not one by one.)
4. Within a shard, documents in a seeded order form a stream of words, read in blocks; it is
   read round and round until the shard's quota is met, so the first blocks of that order
   are taken once more than the others, never more than ``most_repeats`` times.

Only the table of sources meets in one task, and the shards (two numbers each) of one source;
rows of documents never do. Nothing is collected.

Defined results: a null text has size 0 and takes nothing. Null is a source of its own.
Repeated rows are documents of their own; rows alike in doc_id and text are in one shard, and among
them it is not defined which takes more, but the rows of the result are the same in each run. If all sizes
are 0, targets are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import staged, words_of

WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS, BLOCK, SHARD_WORDS = 3, 64, 2_000_000


def water_fill(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above ``most`` times its size."""
    total, cap = float(sizes.sum()), most * sizes.astype(float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        level = (total - cap[~free].sum()) / weights[free].sum()
        over = free & (level * weights > cap)
        out = np.where(free, level * weights, cap)
        if not over.any():
            break
        free &= ~over
        out = np.where(free, out, cap)
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), at most ``most`` each; ties go to the first."""
    votes = np.asarray(votes, float)
    seats = int(min(seats, most.sum()))
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    won = lambda d: np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)
    low, high = votes[votes > 0].min() / (4.0 * seats + 4), 2 * votes.max() + 1
    while won(low).sum() < seats:
        low /= 2
    for _ in range(200):  # the largest divisor that gives seats or more is in [low, high)
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if won(mid).sum() >= seats else (low, mid)
    out = won(high)
    for _ in range(int(seats - out.sum())):  # the few quotients tied at the divisor
        k = int(np.argmax(np.where(out < most, votes / (2 * out + 1), -1.0)))
        out[k] += 1
    return out


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _source_quotas(most: int, block: int):
    """Targets and blocks of all sources, from their sizes."""

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
        sizes = np.array([r["words"] for r in rows], np.int64)
        targets = water_fill(sizes, np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]), most)
        # A source can give so many whole blocks as its words, read ``most`` times, hold.
        seats = sainte_lague(targets, int(round(float(sizes.sum()) / block)), np.floor(most * sizes / block).astype(np.int64) + 1)
        out = [(r["source"], size, target, n) for r, size, target, n in zip(rows, sizes.tolist(), targets.tolist(), seats.tolist(), strict=True)]
        yield _rows(out, ["source", "source_size", "target", "blocks"], [pa.string(), pa.int64(), pa.float64(), pa.int64()])

    return run


def _shard_quotas(most: int, block: int):
    """Words that each shard of one source gives."""

    def run(_, rows):
        rows = rows.sort_by("shard")
        words = rows["words"].to_numpy()
        own = sainte_lague(words, rows["blocks"][0].as_py(), np.floor(most * words / block).astype(np.int64) + 1)
        return rows.drop_columns(["words", "blocks"]).append_column("quota", pa.array(np.minimum(own * block, most * words)))

    return run


#: Above so many rows a table of sources or shards is no longer broadcast but shuffled.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, most_repeats: int = MOST_REPEATS, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """One row per document row: (row: the kept columns,) doc_id, source, size, source_size, target, taken."""
    own = [F.struct(*keep).alias("row")] if keep else []
    d = docs.select(*own, F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), F.xxhash64(text).alias("mark"))
    sized = staged(d.drop("row"), "sizes")
    sources = staged(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "sources")
    # So many shards that each has about SHARD_WORDS words; a document is in one shard.
    shards = sources.select(F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.greatest(F.col("words") / SHARD_WORDS, F.col("docs") / 500_000))).cast("int").alias("shards"))
    shards = _small(staged(shards, "shards"))

    def dealt(x: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.col("shards")).cast("int")
        return x.join(shards, x["source"].eqNullSafe(shards["s"]), "left").withColumn("shard", shard).drop("s", "shards")

    # The sources, a row each, meet in one task; the shards of each source in a task of its own.
    targets = sources.select("source", "words").coalesce(1).mapInArrow(_source_quotas(most_repeats, block), "source string, source_size long, target double, blocks long")
    targets = _small(staged(targets.withColumnRenamed("source", "s"), "targets"))
    table = dealt(sized).groupBy("source", "shard").agg(F.sum("size").alias("words"))
    table = table.join(targets, table["source"].eqNullSafe(targets["s"])).drop("s")
    quotas = table.groupBy("source").applyInArrow(_shard_quotas(most_repeats, block), "source string, shard int, source_size long, target double, quota long")
    quotas = staged(quotas.withColumnsRenamed({"source": "s", "shard": "k"}), "quotas")

    x = dealt(sized if not keep else d)
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed + 1)), "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source", "shard")
    x = x.withColumn("end", F.sum("size").over(w)).withColumn("words", F.sum("size").over(whole))
    x = x.join(_small(quotas), x["source"].eqNullSafe(F.col("s")) & (x["shard"] == F.col("k")), "left")
    full = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.greatest(F.col("words"), F.lit(1)))).otherwise(F.lit(0))
    rest = F.col("quota") - full * F.col("words")
    start = F.col("end") - F.col("size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("end"), rest) - F.least(start, rest))
    return x.select(*(["row"] if keep else []), "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
