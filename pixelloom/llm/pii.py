"""Personal data: patterns with checks, and a character-level BiLSTM-CRF that adds spans.

The patterns (e-mail, IPv4, card with Luhn, international phone) give the base spans. The
model, trained here in numpy from generated labelled spans (``TRAIN_SEQUENCES`` of them, a fixed
bound), tags characters in overlapping windows around every stretch that could hold personal
data: a run with ``@``, or digits with the signs that join them, four digits or more. Where windows
overlap their emissions are averaged, and the best path of tags is found once for the whole
region, over all its windows' borders; runs of tags become spans, so spans longer than a window are
whole. Spans that touch a base span, fail their kind's check or are part of a longer run of
letters or digits, are dropped; the others are added.

Defined results: a null text is empty and has no spans. Rows are independent; texts of any
length are scanned whole, with memory for one batch of windows, and for some 30 bytes a character of the
longest region. Offsets are code points.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import in_arrow

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A stretch of digits and joining signs; all matches of the three digit patterns lie in one.
STRETCH = re.compile(r"\+?[0-9][0-9\x20().+-]*")
MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")

STRIDE, MARGIN = 24, 12
WINDOW = 2 * STRIDE  # so that a window is two segments, and a segment in two windows
BLOCK = 2048  # segments tagged at a time
HIDDEN, EMBED, TAGS = 16, 8, 1 + 2 * len(KINDS)
TRAIN_SEQUENCES, EPOCHS, BATCH, RATE = 3000, 6, 32, 0.025


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return EMAIL.fullmatch(s) is not None
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split(".")) if IP.fullmatch(s) else False
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    return 10 <= len(_digits(s)) <= 15


def stretches(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal runs of mail characters around an ``@``, and stretches of digits."""
    mails, at = [], text.find("@")
    while at >= 0:
        lo, hi = at, at + 1
        floor = mails[-1][1] if mails else 0
        while lo > floor and text[lo - 1] in MAIL_CHARS:
            lo -= 1
        while hi < len(text) and text[hi] in MAIL_CHARS:
            hi += 1
        mails.append((lo, hi))
        at = text.find("@", hi)
    return mails, [m.span() for m in STRETCH.finditer(text)]


def base_spans(text: str, found=None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    mails, digits = found or stretches(text)
    out = [(m.start(), m.end(), "email") for lo, hi in mails for m in EMAIL.finditer(text, lo, hi)]
    for lo, hi in digits:
        if hi - lo >= 7:
            for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
                out += [(m.start(), m.end(), kind) for m in pattern.finditer(text, lo, hi) if _passes(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    return valid(kind, s)


def _ids(text: str) -> np.ndarray:
    """Printable ASCII 0-94, line ends and other characters 95, 96; 97 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes < 32, 95, 96)).astype(np.int16)


PAD, SYMBOLS = 97, 98


def labelled_sequences(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated windows (n, WINDOW) of character ids with their tags: 0, 1 + 2 kind (begins), 2 + 2 kind."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    word = lambda: pick("etaoinshrdlucmfwypvbgk", int(rng.integers(1, 9)))
    number = lambda k: pick("0123456789", k)

    def card():
        d = "4" + number(14)
        check = next(c for c in "0123456789" if luhn(d + c))
        d += check
        return d if rng.random() < 0.6 else rng.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = str(rng.integers(2, 10)) + number(2), number(3), number(4)
        local = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
        return (f"+{rng.integers(1, 99)} " if rng.random() < 0.7 else "") + local

    make = {
        "email": lambda: f"{word()}{rng.choice(['', '.', '_', '+'])}{word()}{rng.choice(['', '7', '42'])}@{word()}.{rng.choice(['com', 'org', 'net', 'io', 'co.uk', 'de'])}",
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    decoys = [lambda: number(int(rng.integers(1, 13))), lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"{number(2)}.{number(2)}", lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 9)}", lambda: f"@{word()}", lambda: f"${number(3)}.{number(2)}", lambda: f"{number(4)} {number(2)} {number(5)}", lambda: number(20), lambda: f"{word()} @ {word()}", lambda: f"#{number(8)}-{number(2)}"]
    ids, tags = np.full((n, WINDOW), PAD, np.int16), np.zeros((n, WINDOW), np.int8)
    for row in range(n):
        text, tag = "", []
        while len(text) < 2 * WINDOW:
            u = rng.random()
            if u < 0.22:
                kind = int(rng.integers(len(KINDS)))
                s = str(make[KINDS[kind]]())
                tag += [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            else:
                s = str(decoys[int(rng.integers(len(decoys)))]()) if u < 0.4 else word().capitalize() if u < 0.5 else word()
                tag += [0] * len(s)
            gap = rng.choice([" ", " ", " ", ", ", ". ", "\n"])
            text += s + gap
            tag += [0] * len(gap)
        at = int(rng.integers(0, len(text) - WINDOW))
        keep = WINDOW if rng.random() < 0.8 else int(rng.integers(8, WINDOW))
        ids[row, :keep], tags[row, :keep] = _ids(text)[at : at + keep], tag[at : at + keep]
    return ids, tags


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Embedding, two LSTM directions, linear emissions, CRF transitions."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": init(SYMBOLS, EMBED) * 3, "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"x{d}": init(EMBED, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": bias}

    def _direction(self, ids, d, keep: bool):
        """Hidden states (time, row, unit) of one direction; with ``keep``, what the gradient needs."""
        p, h_w = self.p, self.p[f"h{d}"]
        table = p["embed"] @ p[f"x{d}"] + p[f"c{d}"]
        steps = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
        h = c = np.zeros((len(ids), HIDDEN), np.float32)
        states, saved = np.empty((ids.shape[1], len(ids), HIDDEN), np.float32), {}
        for t in steps:
            z = table[ids[:, t]] + h @ h_w
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                saved[t] = (i, f, o, g, tc, before, c_before)
        return states, (saved, list(steps))

    def emissions(self, ids, keep: bool = False):
        f, sf = self._direction(ids, "f", keep)
        b, sb = self._direction(ids, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, sf, sb

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags (row, time)."""
        e = self.emissions(ids)[0]
        score, back = self.p["start"] + e[0], np.empty((len(e), *e[0].shape), np.int8)
        for t in range(1, len(e)):
            x = score[:, :, None] + self.p["move"]
            back[t] = x.argmax(axis=1)
            score = x.max(axis=1) + e[t]
        out = np.empty((len(ids), len(e)), np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(ids))
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out

    def gradient(self, ids, tags) -> tuple[float, dict]:
        e, both, sf, sb = self.emissions(ids, True)
        steps, n, _ = e.shape
        move, start, tags = self.p["move"], self.p["start"], tags.T.astype(int)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        rows = np.arange(n)
        gold = start[tags[0]] + sum(e[t][rows, tags[t]] for t in range(steps)) + sum(move[tags[t - 1], tags[t]] for t in range(1, steps))
        d_e = np.exp(alpha + beta - z[:, None])
        grads = {"start": d_e[0].sum(0), "move": np.zeros_like(move)}
        np.subtract.at(grads["start"], tags[0], 1)
        for t in range(1, steps):
            grads["move"] += np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
            np.subtract.at(grads["move"], (tags[t - 1], tags[t]), 1)
        for t in range(steps):
            d_e[t][rows, tags[t]] -= 1
        grads["bias"], grads["out"] = d_e.sum((0, 1)), np.einsum("tnh,tnk->hk", both, d_e)
        d_both = d_e @ self.p["out"].T
        grads["embed"] = np.zeros_like(self.p["embed"])
        for d, (saved, order), part in (("f", sf, d_both[:, :, :HIDDEN]), ("b", sb, d_both[:, :, HIDDEN:])):
            d_h = d_c = np.zeros((n, HIDDEN), np.float32)
            d_w, d_table = np.zeros_like(self.p[f"h{d}"]), np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
            for t in reversed(order):
                i, f, o, g, tc, before, c_before = saved[t]
                d_h = part[t] + d_h
                d_c = d_c + d_h * o * (1 - tc * tc)
                dz = np.concatenate([d_c * g * i * (1 - i), d_c * c_before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                d_w += before.T @ dz
                np.add.at(d_table, ids[:, t], dz)
                d_h, d_c = dz @ self.p[f"h{d}"].T, d_c * f
            grads |= {f"h{d}": d_w, f"c{d}": d_table.sum(0), f"x{d}": self.p["embed"].T @ d_table}
            grads["embed"] += d_table @ self.p[f"x{d}"].T
        return float((z - gold).mean()), {k: v / n for k, v in grads.items()}


def train(n: int = TRAIN_SEQUENCES, epochs: int = EPOCHS, seed: int = 0) -> Tagger:
    """A tagger fitted by Adam on ``n`` generated sequences; the same for the same arguments."""
    ids, tags = labelled_sequences(n, seed)
    tagger, rng, step = Tagger(seed), np.random.default_rng(seed), 0
    mean = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            step += 1
            _, grads = tagger.gradient(ids[rows], tags[rows])
            rate = RATE * 0.5 ** max(0, epoch - epochs // 2)
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                tagger.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


_trained: dict[tuple, Tagger] = {}


def trained(n: int = TRAIN_SEQUENCES, epochs: int = EPOCHS, seed: int = 0) -> Tagger:
    return _trained.get((n, epochs, seed)) or _trained.setdefault((n, epochs, seed), train(n, epochs, seed))


def _regions(found, length: int) -> list[tuple[int, int]]:
    mails, digits = found
    spots = sorted(mails + digits)
    out: list[list[int]] = []
    for lo, hi in spots:
        lo, hi = max(0, lo - MARGIN), min(length, hi + MARGIN)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _segment_emissions(tagger: Tagger, ids: np.ndarray, last: np.ndarray):
    """(first segment, emissions (segment, time, tag)) of blocks of segments, averaged over the windows that hold them.

    ``ids`` are regions of whole segments one after the other, ``last`` marks each region's last segment.
    """
    for lo in range(0, len(last), BLOCK):
        hi = min(len(last), lo + BLOCK)
        at = np.arange(max(0, lo - 1), hi)
        at = at[~last[at]]  # a window starts at every segment but a region's last
        e = tagger.emissions(ids[at[:, None] * STRIDE + np.arange(WINDOW)])[0].transpose(1, 0, 2)
        sums, times = np.zeros((hi - lo, STRIDE, e.shape[2]), np.float32), np.zeros(hi - lo, np.float32)
        for k, half in ((at, e[:, :STRIDE]), (at + 1, e[:, STRIDE:])):
            own = (k >= lo) & (k < hi)
            sums[k[own] - lo] += half[own]
            times[k[own] - lo] += 1
        yield lo, sums / times[:, None, None]


def decode_regions(tagger: Tagger, regions: list[np.ndarray]) -> list[np.ndarray]:
    """The best path of tags of each region (arrays of character ids), over all of its windows.

    A segment is first reduced to its best scores from each tag before it to each tag at its end; these
    join in order to the tags at all borders; between two known borders the path is found again.
    """
    many = np.array([max(2, -(-len(r) // STRIDE)) for r in regions])
    ends = np.cumsum(many)
    ids = np.full(ends[-1] * STRIDE, PAD, np.int16)
    for r, start in zip(regions, (ends - many) * STRIDE, strict=True):
        ids[start : start + len(r)] = r
    last, first = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
    last[ends - 1], first[ends - many] = True, True
    move, begin = tagger.p["move"], tagger.p["start"]
    blocks = lambda: _segment_emissions(tagger, ids, last)
    held = list(blocks()) if len(last) <= 2 * BLOCK else None  # longer regions are tagged twice

    best = np.empty((len(last), *move.shape), np.float32)
    for lo, e in held or blocks():
        x = np.where(first[lo : lo + len(e), None, None], begin[None, None, :], move[None]) + e[:, 0, None, :]
        for t in range(1, STRIDE):
            x = (x[:, :, :, None] + move).max(axis=2) + e[:, t, None, :]
        best[lo : lo + len(e)] = x

    # Joined for all regions at once, segment by segment, the longest regions first.
    order = np.argsort(-many, kind="stable")
    start, count = (ends - many)[order], many[order]
    score, back = best[start, 0].copy(), np.zeros((len(last), len(begin)), np.int8)
    for k in range(1, count[0]):
        n = int(np.searchsorted(-count, -k, side="left"))  # regions with more than k segments
        x = score[:n, :, None] + best[start[:n] + k]
        back[start[:n] + k] = x.argmax(axis=1)
        score[:n] = x.max(axis=1)
    border = np.empty(len(last), np.int64)  # the tag at each segment's end
    border[ends[order] - 1] = score.argmax(axis=1)
    for k in range(count[0] - 1, 0, -1):
        at = start[: int(np.searchsorted(-count, -k, side="left"))] + k
        border[at - 1] = back[at, border[at]]

    tags = np.empty((len(last), STRIDE), np.int8)
    before = np.concatenate([[0], border[:-1]])
    for lo, e in held or blocks():
        own = slice(lo, lo + len(e))
        x, came = np.where(first[own, None], begin[None], move[before[own]]) + e[:, 0], np.empty((STRIDE, len(e), len(begin)), np.int8)
        for t in range(1, STRIDE):
            y = x[:, :, None] + move
            came[t], x = y.argmax(axis=1), y.max(axis=1) + e[:, t]
        tag, rows = border[own], np.arange(len(e))
        for t in range(STRIDE - 1, -1, -1):
            tags[own, t] = tag
            tag = came[t][rows, tag] if t else tag
    flat = tags.ravel()
    return [flat[a : a + len(r)] for a, r in zip(((ends - many) * STRIDE).tolist(), regions, strict=True)]


def model_spans(tagger: Tagger, texts: list[str], founds: list) -> list[list[tuple[int, int, str]]]:
    """Spans that the model finds in each text; regions are decoded whole, many short ones at once."""
    out: list[list] = [[] for _ in texts]
    held, size = [], 0

    def flush():
        nonlocal size
        if held:
            for (k, lo, _), tags in zip(held, decode_regions(tagger, [r for _, _, r in held]), strict=True):
                out[k] += _spans(tags, lo)
        held.clear()
        size = 0

    for k, (text, (mails, digits)) in enumerate(zip(texts, founds, strict=True)):
        wanted = (mails, [(a, b) for a, b in digits if b - a >= 4 and sum(c.isdigit() for c in text[a:b]) >= 4])
        for lo, hi in _regions(wanted, len(text)):
            held.append((k, lo, _ids(text[lo:hi])))
            size += 2 + (hi - lo) // STRIDE
            if size >= BLOCK:
                flush()
    flush()
    return out


def _spans(tags: np.ndarray, at: int) -> list[tuple[int, int, str]]:
    out, start = [], None
    parts = (tags[lo : lo + 65_536].tolist() for lo in range(0, len(tags), 65_536))
    for k, t in enumerate(chain(chain.from_iterable(parts), [0])):
        if start is not None and (t == 0 or t % 2 == 1 or t != tags[start] + tags[start] % 2):
            out.append((at + start, at + k, KINDS[(tags[start] - 1) // 2]))
            start = None
        if t and start is None:
            start = k
    return out


def added_spans(text: str, base: list, spans: list) -> list[tuple[int, int, str]]:
    """The model's spans that touch no base span and pass their kind's check, trimmed at the edges."""
    out, taken = [], sorted((a, b) for a, b, _ in base)
    for lo, hi, kind in sorted(spans):
        while lo < hi and text[lo] in " \n\t.,;:-)":
            lo += 1
        while hi > lo and text[hi - 1] in " \n\t.,;:-(":
            hi -= 1
        # A part of a longer run of letters or digits is no datum.
        whole = (lo == 0 or not text[lo - 1].isalnum()) and (hi == len(text) or not text[hi].isalnum())
        if hi > lo and whole and valid(kind, text[lo:hi]) and all(b <= lo or hi <= a for a, b in taken):
            out.append((lo, hi, kind))
            taken.append((lo, hi))
    return out


def _say(spans) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _scan(tagger: Tagger):
    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            founds = [stretches(t) for t in texts]
            rows: list[list] = [[] for _ in range(6)]
            for text, found, spans in zip(texts, founds, model_spans(tagger, texts, founds), strict=True):
                base = base_spans(text, found)
                for k, kind in enumerate(KINDS):
                    rows[k].append(sum(s[2] == kind for s in base))
                rows[4].append(_say(base))
                rows[5].append(_say(base + added_spans(text, base, spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(rows, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return run


def find_pii(docs: DataFrame, tagger: Tagger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, and ``base`` and all ``spans`` as kind:start:end lists."""
    tagger = tagger or trained()
    return in_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), _scan(tagger), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")

