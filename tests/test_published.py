import os

import pytest
from pyspark.sql import functions as F

from chorus.sources import published as PB


def rows(spark, n, note="a"):
    return spark.range(n).repartition(5).select(
        F.col("id").alias("comment_id"), F.concat(F.lit(f'{note} "q", \n'), F.col("id")).alias("comment"),
        F.array(F.lit("x"), F.col("id").cast("string")).alias("toks"))


def test_parts_are_ordered_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    m = PB.publish_csv(rows(spark, 1000), path, ["comment_id"], part_rows=100)
    assert m["rows"] == 1000 == PB.published_rows(spark, path) and len(m["parts"]) >= 10
    last = -1
    for name, length in m["parts"]:
        assert os.path.getsize(f"{tmp_path}/out/{m['folder']}/{name}") == length
        ids = [r.comment_id for r in spark.read.options(**PB.CSV_OPTIONS).option("multiLine", "true").schema(
            "comment_id long, comment string, toks string").csv(f"{path}/{m['folder']}/{name}").collect()]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    back = {r.comment_id: r for r in PB.read_published(spark, path).collect()}
    assert len(back) == 1000 and back[7].comment == 'a "q", \n7' and back[7].toks == '["x","7"]'


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    with pytest.raises(PB.NotPublished):
        PB.read_published(spark, path)
    late = F.when(F.col("comment_id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("comment"))
    with pytest.raises(Exception, match="lost"):
        PB.publish_csv(rows(spark, 1000).withColumn("comment", late), path, ["comment_id"])
    with pytest.raises(PB.NotPublished):
        PB.read_published(spark, path)
    assert not [d for d in os.listdir(f"{tmp_path}/out") if d.startswith(("parts-", "manifest-"))]
    PB.publish_csv(rows(spark, 20, "first"), path, ["comment_id"])
    with pytest.raises(Exception, match="lost"):
        PB.publish_csv(rows(spark, 1000).withColumn("comment", late), path, ["comment_id"])
    assert PB.read_published(spark, path).filter("comment like 'first%'").count() == 20


def test_versions_replace_each_other_and_old_ones_go(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    under_way = None
    for n in (3, 4, 5):
        PB.publish_csv(rows(spark, n), path, ["comment_id"])
        if n == 4:
            under_way = PB.read_published(spark, path)
        assert PB.read_published(spark, path).count() == n
    assert under_way.count() == 4                       # its version is still there
    left = os.listdir(f"{tmp_path}/out")
    assert sum(d.startswith("parts-") for d in left) == sum(d.startswith("manifest-") for d in left) == PB.KEEP


def test_a_changed_part_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    m = PB.publish_csv(rows(spark, 50), path, ["comment_id"])
    with open(f"{tmp_path}/out/{m['folder']}/{m['parts'][0][0]}", "a") as f:
        f.write("9,x,y\n")
    with pytest.raises(PB.NotPublished):
        PB.read_published(spark, path)


def test_empty_result(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    m = PB.publish_csv(rows(spark, 5).limit(0), path, ["comment_id"])
    assert m["rows"] == 0
    back = PB.read_published(spark, path)
    assert back.count() == 0 and back.columns == ["comment_id", "comment", "toks"]
