"""Token counts by byte-pair merging, without making ids.

A piece of text between pre-token borders starts as one symbol a byte. Its adjacent pairs
that have a merge rank go on a heap; the lowest rank is popped again and again and its two
symbols, neighbours in a linked list, become one. The count is the number of initial symbols
less the number of merges.

Texts are cut at single spaces, and the count of each chunk is remembered per worker (the
memory is emptied when full), so that merging runs once a distinct chunk. Where a cut would
not be a pre-token border (double spaces, white space at a chunk's edge), the whole stretch
is matched with the pattern instead.

Defined results: a null or empty text has 0 bytes and 0 tokens. Special strings inside a text
are one token each, as is the library's default. Each row is counted by itself.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import in_arrow

#: Fixed value: the published pre-token pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.symbols = _byte_symbols()
        self.specials = [a["content"] for a in spec.get("added_tokens", [])]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, int] = {}
        self.chunks = _Chunks(self)

    def merge(self, piece: str) -> int:
        symbols = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of the two has changed since
            symbols[i] += symbols[j]
            symbols[j] = None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def matched(self, text: str) -> int:
        total, pieces = 0, self.pieces
        for piece in self.find(text):
            n = pieces.get(piece)
            if n is None:
                if len(pieces) >= CACHE:
                    pieces.clear()
                n = pieces[piece] = self.merge(piece)
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        first, *chunks = text.split(" ")
        try:
            return (self.matched(first) if not chunks or not first[-1:].isspace() else _raise()) + sum(map(self.chunks.__getitem__, chunks))
        except _Border:
            return self.matched(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cut or not any(s in text for s in self.specials):
            return self.plain(text)
        parts = self.cut.split(text)
        return sum(self.plain(p) for p in parts if p) + len(parts) - 1


class _Border(Exception):
    pass


def _raise():
    raise _Border


class _Chunks(dict):
    """Counts of chunks that follow a single space."""

    def __init__(self, counter: MergeCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Border
        if len(self) >= CACHE:
            self.clear()
        n = self.counter.matched(" " + chunk)
        if len(chunk) < 200:
            self[chunk] = n
        return n


_counters: dict[str, MergeCounter] = {}


def _count(path: str, limit: int):
    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, MergeCounter(path))
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = [counter.count(t or "") for t in texts]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document row. ``vocabulary``: path of the tokenizer's JSON file."""
    return in_arrow(docs.select(F.col(doc_id).cast("long"), text), _count(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
