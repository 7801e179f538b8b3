"""The n-gram Jaccard join against all pairs."""

import random
import re

import pytest

from pixelloom.llm import jaccard


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else i if not s else least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def family(rng, base, count, most):
    words = base.split()
    return [" ".join(f"{w}{rng.random():.3f}" if rng.random() < rng.random() * most else w for w in words) for _ in range(count)]


@pytest.mark.parametrize(("seed", "wide", "block"), [(1, 64, 1_000_000), (2, 3, 1_500)])
def test_against_all_pairs(spark, seed, wide, block, monkeypatch):
    for name, value in (("HEAVY", 5), ("WIDE", wide), ("BLOCK_COLUMNS", block)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    texts = [None, "", " \n", "one two", "One  TWO", "one two three four", "é ü ß ä ö", "É ü ß ä ö", "same words here again ok", "same words\nhere again OK", "x " * 20_000]
    passage = " ".join(word() for _ in range(40))
    for _ in range(12):
        base = " ".join(word() for _ in range(rng.randint(20, 160)))
        texts += [base, *family(rng, base, rng.randint(0, 9), 0.03)]
    texts += [" ".join(word() for _ in range(rng.randint(5, 60))) + " " + passage for _ in range(40)]
    texts += family(rng, " ".join(word() for _ in range(120)), 60, 0.08)
    rng.shuffle(texts)
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + [(None, "same words here again ok"), (None, None), (5, texts[20]), (5, texts[20])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, size int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()), key=str)
    assert got == brute(rows)
    assert len({g[2] for g in got}) < len(got) - 40


def test_empty_table(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
