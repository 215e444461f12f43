"""Recorded responses as a data source: ranges, pushed filters, commits and aborts."""

import pytest
from pyspark.sql import functions as F

from thresher.plans.extraction import extract
from thresher.sources.recorded import fetch
from thresher.sources.recording import SCHEMA, Range, RecordingReader, register


@pytest.fixture(scope="module")
def source(spark):
    register(spark)
    return spark


def _responses(spark, n, first=0):
    rows = [
        (f"https://a.example/{k}", 200 if k % 4 else 404, {"Content-Type": ["text/html"], "X": ["1", "2"]} if k % 3 else None, f"<h1>é {k}</h1>\n".encode() * (k % 5) if k % 7 else None, None if k % 2 else "https://b.example/", ["x"] * (k % 3), None, "line\nbreak")
        for k in range(first, first + n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _plain(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.mark.parametrize("target", [200, 5000, 1 << 20])
def test_round_trip_by_ranges(source, tmp_path, target):
    made = _responses(source, 60)
    made.repartition(3).write.format("recording").mode("append").save(f"file://{tmp_path}/r")
    _responses(source, 10, 60).coalesce(1).write.format("recording").mode("append").save(f"file://{tmp_path}/r")
    found = source.read.format("recording").option("target", target).load(f"file://{tmp_path}/r")
    assert _plain(found) == _plain(_responses(source, 70))
    assert target > 200 or found.rdd.getNumPartitions() > 70
    assert sorted(p.suffix for p in (tmp_path / "r").iterdir() if p.is_file()) == [".jsonl"] * 4 and not list((tmp_path / "r/_runs").iterdir())


def test_an_empty_folder_has_no_rows(source, tmp_path):
    assert source.read.format("recording").load(f"file://{tmp_path}/none").count() == 0


def test_an_aborted_write_leaves_nothing(source, tmp_path):
    _responses(source, 5).write.format("recording").mode("append").save(f"file://{tmp_path}/r")
    before = _plain(source.read.format("recording").load(f"file://{tmp_path}/r"))
    broken = _responses(source, 40).repartition(4).withColumn("final_url", F.when(F.col("url").endswith("/33"), F.raise_error(F.lit("lost"))).otherwise(F.col("final_url")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("recording").mode("append").save(f"file://{tmp_path}/r")
    assert _plain(source.read.format("recording").load(f"file://{tmp_path}/r")) == before
    assert len([p for p in (tmp_path / "r").rglob("*") if p.is_file()]) == len([p for p in (tmp_path / "r").glob("*.jsonl")])


def test_urls_are_pushed_down(source, tmp_path):
    _responses(source, 30).coalesce(1).write.format("recording").mode("append").save(f"file://{tmp_path}/r")
    found = source.read.format("recording").load(f"file://{tmp_path}/r")
    assert [r["url"] for r in found.where("url = 'https://a.example/7'").collect()] == ["https://a.example/7"]
    assert found.where("url in ('https://a.example/7', 'https://a.example/8', 'no') and status_code = 404").count() == 1
    assert found.where("url = 'https://a.example/7' and url = 'https://a.example/8'").count() == 0
    # What is pushed down is not even parsed.
    path = next((tmp_path / "r").glob("*.jsonl"))
    path.write_bytes(b'{not json "https://a.example/77"}\n' + path.read_bytes())
    reader = RecordingReader(f"file://{tmp_path}/r", 1 << 20, found.schema)
    reader.urls = {"https://a.example/7"}
    assert sum(b.num_rows for b in reader.read(Range(str(path), 0, path.stat().st_size))) == 1


def test_it_feeds_the_extraction(source, tmp_path):
    _responses(source, 12).write.format("recording").mode("append").save(f"file://{tmp_path}/r")
    asked = source.range(14).select(F.col("id").alias("job_id"), F.concat(F.lit("https://a.example/"), F.col("id")).alias("url"))
    envelopes = fetch(asked, source.read.format("recording").load(f"file://{tmp_path}/r"))
    field = "array(named_struct('name', 'h1', 'type', 'string', 'description', cast(null as string), 'aliases', cast(array() as array<string>), 'paths', cast(array() as array<string>), 'required', true))"
    t = extract(asked.select("job_id", F.expr(field).alias("requested_fields")), envelopes.select("job_id", F.col("raw_body").cast("string").alias("html")))
    valid = {r["job_id"] for r in t["validation"].where("status = 'VALID'").collect()}
    assert valid == {k for k in range(12) if k % 5 and k % 7}


def test_it_is_only_appended_to(source, tmp_path):
    with pytest.raises(Exception, match="appended"):
        _responses(source, 1).write.format("recording").mode("overwrite").save(f"file://{tmp_path}/r")
