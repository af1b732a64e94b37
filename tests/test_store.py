import os
import shutil

import pytest

from chorus.plans import catalog, store


@pytest.fixture()
def own_sf(spark, sf, tmp_path):
    """A copy of the documents, so that their change can be seen."""
    shutil.copy(f"{sf}/documents.parquet", tmp_path / "documents.parquet")
    return str(tmp_path)


def test_rerun_reads_one_stored_token_table(spark, own_sf):
    before = dict(store.WRITES)
    made = lambda name: store.WRITES[name] - before.get(name, 0)
    first = {}
    for name in ("topics_rerun", "topics_rerun_trigrams", "topics_rerun_summary", "tfidf_keywords", "top_trigrams"):
        first[name] = sorted(map(str, catalog.QUERIES[name](spark, own_sf).collect()))
    assert made("tokens") == 1                          # sentiment and tokens are not computed again
    assert made("topic-terms") == made("topic-assignments") == 1
    for name, rows in first.items():
        assert sorted(map(str, catalog.QUERIES[name](spark, own_sf).collect())) == rows
    assert made("tokens") == made("topic-terms") == 1


def test_a_changed_input_is_another_table(spark, own_sf):
    n = catalog.nlp_stage(spark, own_sf).count()
    wrote = store.WRITES["tokens"]
    spark.read.parquet(f"{own_sf}/documents.parquet").limit(7).toPandas().to_parquet(f"{own_sf}/new.parquet")
    os.replace(f"{own_sf}/new.parquet", f"{own_sf}/documents.parquet")
    assert catalog.nlp_stage(spark, own_sf).count() <= 7 < n and store.WRITES["tokens"] == wrote + 1


def test_a_failed_build_leaves_nothing_readable(spark, own_sf):
    source = [f"{own_sf}/documents.parquet"]
    boom = lambda: spark.range(10, numPartitions=4).selectExpr("if(id = 9, raise_error('lost'), id) AS id")
    with pytest.raises(Exception):
        store.stored(spark, "trial", source, {"a": 1}, boom)
    assert store.stored(spark, "trial", source, {"a": 1}, lambda: spark.range(3).toDF("id")).count() == 3
    assert store.stored(spark, "trial", source, {"a": 1}, boom).count() == 3          # published: not built again
    assert store.stored(spark, "trial", source, {"a": 2}, lambda: spark.range(4).toDF("id")).count() == 4


def test_expiry(spark, own_sf):
    source = [f"{own_sf}/documents.parquet"]
    store.stored(spark, "old", source, {}, lambda: spark.range(3).toDF("id"))
    assert store.expire(spark, 3600) == 0
    assert store.expire(spark, -10) > 0
    wrote = store.WRITES["old"]
    assert store.stored(spark, "old", source, {}, lambda: spark.range(3).toDF("id")).count() == 3
    assert store.WRITES["old"] == wrote + 1
