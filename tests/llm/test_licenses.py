"""License scans against containment in every window."""

import random
import re

from pixelloom.llm import licenses


def shingles(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows):
    out = set()
    for name, template in licenses.TEMPLATES.items():
        t = shingles(template)
        width = 1 << (2 * len(t) - 1).bit_length()
        for i, text in rows:
            s = shingles(text)
            if max((len(set(s[a : a + width]) & set(t)) for a in range(0, len(s), max(1, width // 2))), default=0) >= 0.75 * len(set(t)):
                out.add((i, name))
    return out


def test_scan(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(0, None), (1, ""), (2, "the MIT License"), (3, filler(30_000) + " " + licenses.TEMPLATES["MIT"]), (None, licenses.TEMPLATES["ISC"])]
    for name, t in licenses.TEMPLATES.items():
        for _ in range(6):
            words = t.split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), f"{filler(rng.randint(0, 80))}\n{' '.join(words)}\n{filler(rng.randint(0, 80))}"))
    rows += [(len(rows) + i, filler(200)) for i in range(20)] + [(3, licenses.TEMPLATES["BSD"].upper())]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, license string").repartition(3)
    got = licenses.scan_licenses(df).collect()
    assert {(r.doc_id, r.license) for r in got} == brute(rows) and len(got) == len({(r.doc_id, r.license) for r in got})
    assert all(r.n_found >= 0.75 * r.n_shingles for r in got)
    assert {r.license for r in got} == set(licenses.TEMPLATES)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_rows_without_a_doc_id_are_their_own(spark):
    isc = licenses.TEMPLATES["ISC"]
    rows = [(None, isc), (None, isc), (None, "other words before it " + isc), (8, isc), (8, isc + " and after it"), (8, "none")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, own int, grams int, w int").repartition(3)
    assert sorted((str(r.doc_id), r.license) for r in licenses.scan_licenses(df).collect()) == [("8", "ISC")] * 2 + [("None", "ISC")] * 2
