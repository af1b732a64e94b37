import pytest

from chorus.operators import classify as CL
from chorus.session import scratch_path


def fixture(spark):
    texts = [(1, "great fun great"), (2, "awful boring"), (3, "fun and great"), (4, "boring awful awful"),
             (5, "meh"), (6, "great but boring"), (7, ""), (8, "unknownword")]
    df = spark.createDataFrame(texts, "comment_id long, clean_comment string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1), (5, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    return df, labels


def test_scores_are_probabilities_and_labels_valid(spark):
    df, labels = fixture(spark)
    for scheme, classes in CL.CLASSES.items():
        out = CL.classifier_scores(df, labels, scheme).collect()
        assert len(out) == 8
        for r in out:
            assert r[f"{scheme}_label"] in classes
            assert 1.0 / len(classes) - 1e-12 <= r[f"{scheme}_score"] <= 1.0
        by = {r.comment_id: r[f"{scheme}_label"] for r in out}
        assert by[1] == "positive" and by[4] == "negative"
        # no known term -> priors decide, same for every such row
        assert by[7] == by[8]


def test_batch_model_agrees_with_spark_scoring(spark):
    df, labels = fixture(spark)
    model = CL.fit_scheme(df, labels, "ternary")
    path = CL.export_model(model, scratch_path(spark, "test-model"))
    a = {r.comment_id: (r.ternary_label, r.ternary_score) for r in CL.naive_bayes_scores(df, model, "ternary").collect()}
    b = {r.comment_id: (r.ternary_label, r.ternary_score)
         for r in CL.batch_model_scores(df, path, model.classes, "ternary").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert a[k][1] == pytest.approx(b[k][1], abs=1e-9)


def test_hot_terms_are_salted_and_scores_stay(spark, monkeypatch):
    from chorus.operators import hot
    df, labels = fixture(spark)
    plain = {r.comment_id: r.binary_score for r in CL.classifier_scores(df, labels, "binary").collect()}
    monkeypatch.setattr(CL, "salted_join", lambda *a: hot.salted_join(*a, hot_rows=1))
    salted = CL.classifier_scores(df, labels, "binary")
    assert {r.comment_id: pytest.approx(r.binary_score, abs=1e-12) for r in salted.collect()} == plain
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_no_token_occurrence_moves(spark):
    """A comment's repeated terms are one row of the join's input."""
    df = spark.createDataFrame([(1, "spam " * 500 + "ham")], "comment_id long, clean_comment string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = CL.fit_scheme(df, labels, "binary")
    assert CL._hits(df, model.weights, "clean_comment", "comment_id").count() == 2
    assert CL.naive_bayes_sums(df, model, "binary").first().binary_m == 501


def test_batch_model_of_odd_texts(spark):
    df, labels = fixture(spark)
    model = CL.fit_scheme(df, labels, "binary")
    path = CL.export_model(model, scratch_path(spark, "test-odd"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "great " * 50_000 + "zzz"), (5, "Great"), (5, "great")],
                                "comment_id long, clean_comment string")
    got = sorted((r.comment_id, r.binary_label, round(r.binary_score, 9)) for r in CL.batch_model_scores(odd, path, model.classes, "binary").collect())
    assert [g[1:] for g in got[:3]] == [got[0][1:]] * 3             # the priors decide
    assert [g[1] for g in got[3:]] == ["positive"] * 3 and len({g[2] for g in got[3:]}) == 1
    assert CL.batch_model_scores(odd.limit(0), path, model.classes, "binary").count() == 0


def test_a_file_system_that_only_spark_knows(spark, tmp_path):
    """The model is fetched by Spark's file systems, here one that Arrow has
    no word for."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    df, labels = fixture(spark)
    model = CL.fit_scheme(df, labels, "binary")
    conf.set("fs.viewfs.mounttable.models.link./m", f"file://{tmp_path}")
    path = CL.export_model(model, "viewfs://models/m/nb-viewfs")
    a = {r.comment_id: r.binary_label for r in CL.naive_bayes_scores(df, model, "binary").collect()}
    b = {r.comment_id: r.binary_label for r in CL.batch_model_scores(df, path, model.classes, "binary").collect()}
    assert a == b


def parquet(path, words):
    import pyarrow as pa
    import pyarrow.parquet as pq
    path.mkdir()
    half = len(words) // 2
    for i, ws in enumerate((words[:half], words[half:])):
        pq.write_table(pa.table({"term": pa.array(ws, pa.string()), "a": pa.array([float(len(w)) for w in ws], pa.float64()),
                                 "b": pa.array([float(hash(w) % 97) for w in ws], pa.float64())}), path / f"part-{i}.parquet")
    return [str(path / f"part-{i}.parquet") for i in (0, 1)]


def test_mapped_table(tmp_path, monkeypatch):
    from chorus.functions import mapped_table as M
    words = [f"w{i}" for i in range(5000)] + ["naïve", "日本", ""]
    lists = [["w3", "none", "w4999", "w3"], [], ["日本", "", "naïve"], ["absent"]]
    want = [("w3", 0), ("w4999", 0), ("w3", 0), ("日本", 2), ("", 2), ("naïve", 2)]

    def check(t):
        rows, owner = t.find(lists)
        assert [(v, o) for v, o in zip(t.values[rows].tolist(), owner.tolist())] == [([float(len(w)), float(hash(w) % 97)], o) for w, o in want]

    check(M.MappedTable.of_parquet(parquet(tmp_path / "t", words), "term", ["a", "b"]))
    plain = M._hashes
    monkeypatch.setattr(M, "_hashes", lambda keys: plain(keys) % 16)       # hashes that agree
    check(M.MappedTable.of_parquet(parquet(tmp_path / "u", words), "term", ["a", "b"]))
    empty = M.MappedTable.of_parquet(parquet(tmp_path / "e", []), "term", ["a", "b"])
    assert empty.find(lists)[0].size == 0 and empty.find([])[0].size == 0


def _build(args):
    import os

    from chorus.functions.mapped_table import MappedTable
    t = MappedTable.of_parquet(args, "term", ["a", "b"])
    return os.stat(f"{args[0]}.mapped/values.npy").st_ino, len(t.hashes), type(t.values.base).__name__


def test_workers_of_an_executor_share_one_copy(tmp_path):
    """Four processes at once: one builds, all map the same files, and a
    draft that a lost worker left is not taken for a table."""
    from multiprocessing import get_context
    path = parquet(tmp_path / "t", [f"w{i}" for i in range(20_000)])
    (tmp_path / "t" / "part-0.parquet.mapped-lost").mkdir()
    with get_context("spawn").Pool(4) as pool:
        got = pool.map(_build, [path] * 4)
    assert len(set(got)) == 1 and got[0][1:] == (20_000, "memmap")
