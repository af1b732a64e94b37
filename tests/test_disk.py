"""What large steps leave on disk and what they move."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_classify import fixture
from test_phrases import TEXTS, docs_df, py_tfidf
from test_topics import corpus

from chorus.operators import classify as CL
from chorus.operators import phrases as PH
from chorus.operators import reports as R
from chorus.operators import topics as TP
from chorus.session import ensure_checkpoint_dir, scratch_path
from chorus.sources import published as PB
from chorus.sources import sinks as SK


@pytest.fixture()
def tables(spark):
    """The stage tables written since, by name."""
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    return lambda: Counter(d.removeprefix("chorus-").rsplit("-", 1)[0] for d in set(os.listdir(top)) - before)


def test_topics_leave_one_pass_on_disk(spark, tables):
    m = TP.fit_topics(corpus(spark), k=2, no_above=0.5, passes=4)
    assert m.assignments.count() == 8
    left = tables()
    assert left["lda-pass"] == 1 and not {"term-runs", "lda-bags", "lda-docs"} & set(left)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chorus_")]


def test_packed_topics_are_read_back(spark):
    df = spark.createDataFrame([(1, 'say "hi"\nthere', ["a", "b"])], "comment_id long, comment string, toks array<string>")
    path = scratch_path(spark, "t-packed")
    assert SK.write_topics_csv(df, path, packed=True, rows=df.select("comment_id"))
    assert glob.glob(f"{path.removeprefix('file:')}/*.csv.gz")
    assert tuple(SK.read_csv(spark, path, df.schema).first()) == (1, 'say "hi"\nthere', '["a","b"]')
    assert not SK.write_topics_csv(df, path, packed=True, rows=df.limit(0))


def test_tfidf_in_slices(spark, tables, monkeypatch):
    monkeypatch.setattr(PH, "SLICE_PAIRS", 5)
    monkeypatch.setattr(PH, "HOT_TERMS", 1)
    got = [(r.term, r.tfidf_score) for r in PH.tfidf_keywords(docs_df(spark, [*TEXTS, "", "?"])).collect()]
    want = py_tfidf([*TEXTS, "", "?"])
    assert [t for t, _ in got] == [t for t, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-12)
    left = tables()
    assert left["top-terms"] == PH.MOST_SLICES and not {"term-runs", "kept-terms", "norm-part", "norms"} & set(left)


def test_an_ordered_join_moves_rows_once(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 299, F.col("id") % 290).alias("k"), F.concat(F.lit("text "), "id").alias("text"))
    table = spark.range(1000).filter("id % 3 = 0").select(F.col("id").alias("k"), F.when(F.col("id") > 3, F.col("id") * 2).alias("n"))
    got = PB.ordered_join(rows.repartition(5), table, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k").collect()))
    parts = [[r.k for r in p] for p in got.rdd.glom().collect() if p]
    flat = [k for p in parts for k in p]
    assert flat == sorted(flat)
    plan = PB.ordered_join(rows, table, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_packed_parts_are_published(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("comment_id"), F.lit('a "q",\nb').alias("comment"))
    m = PB.publish_csv(df.repartitionByRange("comment_id"), f"file://{tmp_path}/out", ["comment_id"], part_rows=30, ordered=True, packed=True)
    assert m["rows"] == 100 and m["parts"] and all(p.endswith(".csv.gz") for p, _ in m["parts"])
    assert sorted(map(tuple, PB.read_published(spark, f"file://{tmp_path}/out").collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("hot", [1, 200_000])
def test_scores_without_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(CL, "HOT_TERMS", hot)
    df, labels = fixture(spark)
    got = R.sentiment_scores(df, labels)
    assert got.columns == ["comment_id", "lexicon_score", "lexicon_label", "binary_label", "binary_score", "ternary_label", "ternary_score"]
    got = {r.comment_id: r for r in got.collect()}
    for scheme in CL.CLASSES:
        want = CL.classifier_scores(df, labels, scheme).collect()
        assert {r.comment_id: (r[f"{scheme}_label"], pytest.approx(r[f"{scheme}_score"], abs=1e-12)) for r in want} == {
            k: (r[f"{scheme}_label"], r[f"{scheme}_score"]) for k, r in got.items()}
