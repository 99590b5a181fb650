"""The notes data source: batch, stream, writer."""

import os
import time

import pytest

from loomgraph.sources import corpus as R
from loomgraph.sources import notes_format as N


def rows_of(df):
    return sorted((r["path"], r["title"], r["content"]) for r in df.collect())


def test_reads_what_the_scan_reads(spark, tmp_path):
    N.register_notes(spark)
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x é+%.md").write_bytes(b"one\r\ntwo")
    (tmp_path / "a" / ".git" / "y.md").write_text("no")
    (tmp_path / ".z.md").write_text("no")
    (tmp_path / "z.md").write_text("z" * 100_000)
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "other.txt").write_text("no")
    read = spark.read.format("notes").option("partBytes", 1).load(str(tmp_path))
    assert rows_of(read) == [("a/x é+%.md", "x é+%", "one\ntwo"), ("empty.md", "empty", ""), ("z.md", "z", "z" * 100_000)]
    assert read.rdd.getNumPartitions() == 3
    same = ["path", "title", "content_hash", "content"]
    scan = R.scan_corpus(spark, str(tmp_path)).filter("path NOT LIKE '.%'").select(same)
    assert sorted(map(tuple, read.filter("content <> ''").select(same).collect())) == sorted(map(tuple, scan.collect()))


def test_empty_folder_has_no_rows(spark, tmp_path):
    N.register_notes(spark)
    assert spark.read.format("notes").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="mounted folders"):
        spark.read.format("notes").load("s3://bucket/notes").count()


def test_writer_replaces_or_adds(spark, tmp_path):
    N.register_notes(spark)
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string, extra int")
    save = lambda rows, mode: frame(rows).write.format("notes").mode(mode).save(str(tmp_path))
    save([("a/b/x.md", "old", 1), ("y.md", None, 2)], "append")
    save([("a/b/x.md", "new\nlines", 1), ("z.md", "same", 2), ("z.md", "same", 3)], "append")
    read = lambda: rows_of(spark.read.format("notes").load(str(tmp_path)))
    assert read() == [("a/b/x.md", "x", "new\nlines"), ("y.md", "y", ""), ("z.md", "z", "same")]
    save([("only.md", "left", 1)], "overwrite")
    assert read() == [("only.md", "only", "left")]
    for bad in ("../out.md", "/abs.md", "x.txt", None, "a/../../b.md"):
        with pytest.raises(Exception, match="not the path of a note"):
            save([("fine.md", "x", 1), (bad, "x", 1)], "append")
    assert read() == [("only.md", "only", "left")]
    assert [n for n in os.listdir(tmp_path) if n.startswith(".job")] == []
    with pytest.raises(Exception, match="needs columns"):
        spark.range(1).write.format("notes").mode("append").save(str(tmp_path))


def test_an_attempt_that_ran_twice_leaves_one_copy(tmp_path):
    w = N.NotesWriter({"path": str(tmp_path)}, ["path", "content"], False)
    row = {"path": "x.md", "content": "a"}
    w.write(iter([row]))  # its message is lost with its executor
    w.commit([w.write(iter([row])), None])
    assert sorted(os.listdir(tmp_path)) == ["x.md"]
    w = N.NotesWriter({"path": str(tmp_path)}, ["path", "content"], False)
    w.write(iter([{"path": "y.md", "content": "b"}]))
    w.abort([None])
    assert sorted(os.listdir(tmp_path)) == ["x.md"]


def test_stream_hands_on_new_and_changed_files(spark, tmp_path):
    N.register_notes(spark)
    notes, out = tmp_path / "notes", tmp_path / "out"
    notes.mkdir()

    def run():
        rows = spark.readStream.format("notes").load(str(notes)).select("path", "content")
        rows.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("path string, content string").parquet(str(out / "rows")).collect())) if (out / "rows").exists() else []

    assert run() == []
    (notes / "b.md").write_text("1")
    (notes / "a.md").write_text("1")
    assert run() == [("a.md", "1"), ("b.md", "1")]
    assert run() == [("a.md", "1"), ("b.md", "1")]
    time.sleep(0.05)
    (notes / "a.md").write_text("2")
    (notes / "c.md").write_text("3")
    assert run() == [("a.md", "1"), ("a.md", "2"), ("b.md", "1"), ("c.md", "3")]


def test_commit_makes_each_folder_once(tmp_path, monkeypatch):
    made, plain = [], os.makedirs
    writer = N.NotesWriter({"path": str(tmp_path)}, ["path", "content"], False)
    done = writer.write(iter([{"path": f"a/b{i % 2}/{i}.md", "content": f"text {i}"} for i in range(40)]))
    monkeypatch.setattr(N.os, "makedirs", lambda *a, **b: made.append(a[0]) or plain(*a, **b))
    writer.commit([done])
    assert len([x for x in made if x.rsplit("/", 1)[-1] in ("b0", "b1")]) == 2
    assert sorted(os.listdir(tmp_path)) == ["a"]
    assert (tmp_path / "a/b1/7.md").read_text() == "text 7"


def test_scan_reads_many_small_files_in_a_task(spark, tmp_path):
    for i in range(2200):
        (tmp_path / f"{i}.md").write_text(f"# {i}")
    rows = R.scan_corpus(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
    assert rows.select("path", "content").distinct().count() == 2200
