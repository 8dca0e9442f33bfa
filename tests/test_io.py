import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidegate.operators import extraction as ex
from tidegate.sources import batches, pages
from tidegate.streaming import runner


def test_batch_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", None) for i in range(10)], "k long, name string, ts timestamp_ntz")
    e = ex.Entity("e", "e", ("k",), ("name",), updated_at="ts")
    path = str(tmp_path / "out")
    stored = batches.write(ex.envelope(df, e).coalesce(1), path, rows_per_file=4)
    rows = stored.collect()
    assert len(rows) == 3
    assert sum(r.row_count for r in batches.row_counts(spark, path).collect()) == 10
    line = spark.read.text(path).first()[0]
    assert '"sourceUpdatedAt":null' in line
    back = batches.read(spark, path, "k long, name string")
    assert sorted(r.data.k for r in back.collect()) == list(range(10))
    kept = spark.createDataFrame(rows)
    assert batches.mismatches(batches.manifest(spark, path), kept).isEmpty()
    name = [n for n in os.listdir(path) if n.endswith(".gz")][0]
    os.remove(f"{path}/{name}")
    assert [r.file for r in batches.mismatches(batches.manifest(spark, path), kept).collect()] == [name]
    batches.write(ex.envelope(df.limit(0), e).coalesce(1), str(tmp_path / "none"))
    assert len([n for n in os.listdir(tmp_path / "none") if n.endswith(".gz")]) == 1
    assert batches.admit(100, 10, 80) and not batches.admit(100, 20, 80)


def test_pages_as_a_table(spark):
    df = spark.createDataFrame([(1, '{"value":[{"k":1},{"k":"1"}]}'), (2, "[]")], "page_no long, body string")
    assert [r.raw for r in pages.explode_pages(df).collect()] == ['{"k":1}', '{"k":"1"}']


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "k long, at long, v string").coalesce(1)
    rows((1, 1, "a"), (2, 1, "b")).write.parquet(src)
    t = runner.VersionedTable(spark, out)
    schema = rows((1, 1, "a")).schema
    run = lambda: runner.upsert_stream(spark, src, schema, t, ["k"], "at", str(tmp_path / "cp"), 1)
    assert sorted(r.v for r in run().collect()) == ["a", "b"]
    rows((1, 2, "A"), (2, 0, "late"), (3, 1, "c")).write.mode("append").parquet(src)
    assert sorted((r.k, r.v) for r in run().collect()) == [(1, "A"), (2, "b"), (3, "c")]
    before = t.version()
    t.publish(rows((9, 9, "replayed")), before)  # a batch that comes again changes nothing
    assert t.version() == before and t.read().filter("k = 9").isEmpty()
    assert runner.late_counts(rows((1, 1, "a")).withColumn("ts", F.timestamp_seconds("at")), "ts", "v").first().n == 1
    shutil.rmtree(out)


def test_a_stop_before_the_pointer_loses_nothing(spark, tmp_path, monkeypatch):
    t = runner.VersionedTable(spark, str(tmp_path / "table"))
    rows = lambda *r: spark.createDataFrame(r, "k long, at long, v string")
    t.publish(rows((1, 1, "a"), (2, 1, "b")), 0)
    fresh = rows((3, 1, "c"))
    with monkeypatch.context() as m:
        m.setattr(t, "point", lambda version: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            t.publish(runner.merge(t.read(), fresh, ["k"], "at"), 1)
    assert t.version() == 0 and sorted(r.k for r in t.read().collect()) == [1, 2]
    t.publish(runner.merge(t.read(), fresh, ["k"], "at"), 1)  # the batch comes again
    assert t.version() == 1 and sorted(r.k for r in t.read().collect()) == [1, 2, 3]


def test_entry_works_without_the_text_operators(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests", "spark-warehouse"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), any(n.startswith('op1_') or n == 'pipeline' for n in q), set(o) <= set(q))"], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split()[1:] == ["False", "True"], out.stderr
