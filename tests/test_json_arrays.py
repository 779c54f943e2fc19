from pyspark.sql import functions as F

from docloom.sources import files, sinks


def test_an_array_is_bounded_whatever_its_part(spark, tmp_path):
    """A file is read by one task, so a part of many records must not be one file."""
    rows = spark.range(0, 1000, 1, 1).select("id", F.lit('a "quoted" word\n' * 10).alias("text"))
    at = sinks.write_json_array(rows, str(tmp_path / "a"), chars=10_000)
    sizes = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 12_000
    back = files.read_json_array(spark, at, "id long, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_a_long_record_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([("x" * 500,), ("y",), ("",)], "text string").coalesce(1)
    at = sinks.write_json_array(rows, str(tmp_path / "b"), chars=100)
    assert sorted(r.text for r in files.read_json_array(spark, at, "text string").collect()) == ["", "x" * 500, "y"]
    at = sinks.write_json_array(rows.limit(0), str(tmp_path / "c"))
    assert files.read_json_array(spark, at, "text string").count() == 0
