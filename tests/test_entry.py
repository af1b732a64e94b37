import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["sentiment_label", "lexicon_count", "binary_count", "ternary_count"]
    n = sum(r.lexicon_count for r in rows)
    assert n == sum(r.binary_count for r in rows) == sum(r.ternary_count for r in rows) > 0


def test_registry_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


def test_partition_independence(spark, sf):
    from chorus.operators import phrases as PH
    from chorus.plans import catalog
    base = catalog.topic_base(spark, sf).select("comment_id", "vtokens")
    a = sorted(PH.top_ngrams(base.repartition(1), 2).collect())
    b = sorted(PH.top_ngrams(base.repartition(16), 2).collect())
    assert a == b
    r1 = sorted(catalog.lexicon_results(spark, sf).repartition(1).select("comment_id", "lexicon_score").collect())
    r2 = sorted(catalog.lexicon_results(spark, sf).repartition(16).select("comment_id", "lexicon_score").collect())
    assert r1 == r2


def test_imports_from_elsewhere_without_a_session(tmp_path):
    """As the driver does: pyspark from its zip, another folder, no JVM."""
    import os
    import subprocess
    import sys

    import pyspark
    home = os.path.dirname(pyspark.__file__)
    zips = [os.path.join(home, "python", "lib", f) for f in os.listdir(os.path.join(home, "python", "lib")) if f.endswith(".zip")]
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 54 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": os.pathsep.join([*zips, repo])})
