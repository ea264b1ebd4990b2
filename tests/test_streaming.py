"""File-incremental jobs: two drops, two available-now runs, each file once."""

from pyspark.sql import functions as F

import pytest

import __spark_entry__ as E
from custlens.sources.ingest import SchemaSpec
from custlens.sources.tables import Tables
from custlens.streaming.ingest_stream import ingest_stream
from tests.conftest import SMALL


SPEC = SchemaSpec("events_01012024_000000.csv", 8, 6, 3, {"a": "integer", "b": "string", "c": "float"})
GOOD = "events_01012024_{:06d}.csv"


def drop(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def run(spark, tmp, **more):
    ingest_stream(spark, str(tmp / "in"), SPEC, r"events_.*\.csv", str(tmp / "good"), str(tmp / "bad"),
                  str(tmp / "ck"), **more).awaitTermination()


def parts(spark, tmp):
    rows = sorted((r.a, r.b, r.c) for r in spark.read.parquet(str(tmp / "good")).collect())
    bad = sorted(r._corrupt_record for r in spark.read.schema("_corrupt_record string").parquet(
        str(tmp / "bad/rows")).collect())
    files = sorted((r.file, r.reason) for r in spark.read.schema("file string, reason string").parquet(
        str(tmp / "bad/files")).collect())
    return rows, bad, files


def test_ingest_validates_and_retries(spark, tmp_path):
    """Good, misnamed, bad-header, bad-row and empty files; a batch that is run
    again after its commit was lost leaves every row once."""
    src = tmp_path / "in"
    drop(src, GOOD.format(0), "a,b,c\n1,x,1.5\n2,,2.5\nno,y,1\n4,z\n")
    drop(src, GOOD.format(1), '"c","a","b"\n9.5,7,q\n')                    # other order
    drop(src, GOOD.format(2), "a,b,d\n1,x,1\n")
    drop(src, GOOD.format(3), "a,b\n1,x\n")
    drop(src, GOOD.format(4), "")
    drop(src, "events_1_000000.csv", "a,b,c\n5,x,1\n")
    drop(src, "shop_01012024_000000.csv", "a,b,c\n5,x,1\n")
    drop(src, "events_a_01012024_000000.csv", "a,b,c\n5,x,1\n")
    run(spark, tmp_path)
    rows, bad, files = want = parts(spark, tmp_path)
    assert rows == [(1, "x", 1.5), (2, None, 2.5), (7, "q", 9.5)]
    assert bad == ["4,z", "no,y,1"]
    assert files == [("events_01012024_000002.csv", "column_names"), ("events_01012024_000003.csv", "columns"),
                     ("events_01012024_000004.csv", "columns"), ("events_1_000000.csv", "datestamp"),
                     ("events_a_01012024_000000.csv", "name"), ("shop_01012024_000000.csv", "regex")]
    commits = tmp_path / "ck" / "commits"
    last = max(p for p in commits.iterdir() if p.name.isdigit())
    for p in (last, commits / f".{last.name}.crc"):
        if p.exists():
            p.unlink()
    run(spark, tmp_path)
    assert parts(spark, tmp_path) == want
    drop(src, GOOD.format(9), "a,b,c\n8,w,0.5\n")
    run(spark, tmp_path)
    assert parts(spark, tmp_path)[0] == sorted(rows + [(8, "w", 0.5)])


def test_ingest_many_small_batches_and_gate(spark, tmp_path):
    for i in range(5):
        drop(tmp_path / "in", GOOD.format(i), f"a,b,c\n{i},x,1\n")
    run(spark, tmp_path, max_files=2)
    assert [r[0] for r in parts(spark, tmp_path)[0]] == [0, 1, 2, 3, 4]
    drop(tmp_path / "in", "other.csv", "a,b,c\n1,x,1\n")
    with pytest.raises(Exception, match="no good files"):
        run(spark, tmp_path, no_good="raise")


def test_predict_stream_scores_every_row(spark):
    df = E.queries()["j12_predict_stream"](spark, SMALL)
    n = Tables(spark, SMALL).lineitem.count()
    assert df.count() == n
    assert df.where(F.col("prediction").isNull()).count() == 0
