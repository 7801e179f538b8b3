"""The registered training-data queries: against SQL where there is some, and the pipeline's stages in order."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from pixelloom.llm import queries
from pixelloom.llm.oracles import JACCARD, LINES, quality_sql
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    if name in queries.oracle_sql():
        assert difference(database(SF), df, queries.oracle_sql()[name]) == ""
    else:
        assert name == "op3_license_scan" or df.count() >= spark.read.parquet(f"{SF}/documents.parquet").count()
        df.limit(3).collect()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.line_dedup(spark, first, SF).cache()
    assert second.columns == docs.columns and second.count() == first.count() and all(r.n_chars == len(r.text) for r in second.collect())
    third = corpus_pipeline.jaccard_join(spark, second, SF).cache()
    from pixelloom.llm.jaccard import jaccard_classes

    assert sorted(r.doc_id for r in third.collect()) == sorted({r.component_id for r in jaccard_classes(second).collect()}) and third.columns == docs.columns
    fourth = corpus_pipeline.mix_sources(spark, third, SF).cache()
    from pixelloom.llm.mixing import mix

    want = Counter({r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in mix(third).collect() if r.size})
    assert Counter(r.doc_id for r in fourth.collect()) == +want and fourth.columns == docs.columns and max(want.values()) <= 3
    pieces = corpus_pipeline.best_fit_packing(spark, fourth, SF)
    assert Counter(r.doc_id for r in pieces.where("piece = 0").collect()) == +want


def test_stages_against_sql(spark):
    """The first three stages, each held against SQL over what the one before kept."""
    con, docs = database(SF), spark.read.parquet(f"{SF}/documents.parquet")

    def rows(sql, table):
        con.register("now", table)
        con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM now")
        return con.execute(sql).fetchall()

    plain = lambda df: df.toPandas()
    kept = {r[0] for r in rows(f"SELECT doc_id FROM ({quality_sql()}) WHERE kept", plain(docs))}
    first = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert sorted(r.doc_id for r in first.collect()) == sorted(kept)
    want = dict(rows(f"SELECT doc_id, kept_sha256 FROM ({LINES})", plain(first)))
    second = corpus_pipeline.line_dedup(spark, first, SF).cache()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in second.collect()} == want
    stay = rows(f"SELECT doc_id FROM ({JACCARD}) WHERE doc_id = component_id", plain(second))
    third = corpus_pipeline.jaccard_join(spark, second, SF).collect()
    assert sorted(r.doc_id for r in third) == sorted(r[0] for r in stay) and len(third) < len(want) < docs.count()


def prose(seed, n=160):
    """Words of which none stands twice, with the common ones in their usual shares."""
    rng = random.Random(seed)
    made = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    return " ".join(rng.choice(["the", "the", "of", "and", "to", "in"]) if rng.random() < 0.17 else made() for _ in range(n)) + "."


def test_run_takes_odd_rows(spark, tmp_path):
    words, other, third = prose(1), prose(2), prose(3)
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (None, words, "en", None, 5, 1), (None, words, "en", None, 5, 1), (3, words, None, "a", 5, 1), (3, words, None, "a", 5, 1), (3, other, None, "a", 5, 1), (4, words + " more", "xx", "b", 5, 1), (9, third, "en", "b", 5, 1)]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, node int, row int, kept int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = df, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns and docs.where("size = 1 and node = 7 and row = 8 and kept = 9").count() == docs.count()
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    good = sorted(((r[0], r[1]) for r in rows if r[1]), key=str)
    assert kept[0] == kept[1] == good  # no line is in three documents
    # One of the copies of ``words`` stays (its least doc_id), rows without a doc_id stay as they are.
    assert kept[2] == sorted([(None, words), (None, words), (3, words), (3, other), (9, third)], key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {None, 3, 9}
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_repeat_a_doc_id(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(2, text("y")), (5, text("x")), (5, text("y") + " end"), (7, text("z")), (7, text("w")), (8, text("z") + " end"), (8, text("w")), (9, text("v")), (9, text("v")), (9, text("V")), (10, ""), (10, text("u")), (11, text("x")), (12, text("t")), (12, text("t") + " end"), (None, text("x"))]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, df.repartition(parts), SF).collect()), key=str)
        least = [t for i, t in got if i == 12]
        assert len(least) == 1 and least[0] in (text("t"), text("t") + " end")
        want = [(2, text("y")), (5, text("x")), (7, text("z")), (7, text("w")), (9, text("V")), (10, ""), (10, text("u")), (12, least[0]), (None, text("x"))]
        assert got == sorted(want, key=str)
