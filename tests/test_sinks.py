from chorus.session import scratch_path
from chorus.sources import sinks as SK


def test_csv_roundtrip(spark):
    rows = [(1, 'say "hi", ok', ["a", "b"], 0.5), (2, "line1\nline2", [], None), (3, "", ["x"], -1.0)]
    df = spark.createDataFrame(rows, "comment_id long, comment string, toks array<string>, score double")
    path = SK.write_csv(df, scratch_path(spark, "t-csv"))
    back = {r.comment_id: r for r in SK.read_csv(spark, path, df.schema).collect()}
    assert back[1].comment == 'say "hi", ok' and back[1].toks == '["a","b"]' and back[1].score == 0.5
    assert back[2].comment == "line1\nline2" and back[2].score is None
    assert back[3].comment in ("", None)   # CSV: an empty text and a null both read back as empty


def test_empty_topics_not_written(spark):
    df = spark.createDataFrame([], "comment_id long, toks array<string>")
    assert SK.write_topics_csv(df, scratch_path(spark, "t-empty")) is False
