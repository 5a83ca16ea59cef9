import os
import signal
import stat
import threading
import time

import pytest
from pyspark.sql import functions as F

from leafmill import config
from leafmill.operators import predicates
from leafmill.plans import catalog_queries, extract
from leafmill.sources import file_sink, repo_files
from leafmill.sources.file_sink import write_files


def tree(folder):
    return {os.path.relpath(os.path.join(d, x), folder): open(os.path.join(d, x), "rb").read() for d, _, names in os.walk(folder) for x in names if ".leafmill" not in d}


def test_files_of_a_job_become_visible_together(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id").alias("dest"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content"))
    ledger = file_sink.write_files(rows.repartition(5), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {f"d{i % 7}/f{i}": b"x" * i for i in range(50)} and os.listdir(tmp_path) == ["out"]
    assert ledger.count() == 50 and ledger.agg(F.sum("bytes_copied")).first()[0] == sum(range(50)) and ledger.where("failure IS NOT NULL").isEmpty()
    with pytest.raises(FileExistsError):
        file_sink.write_files(rows, str(tmp_path / "out"))
    copies = ledger.select("dest", F.concat(F.lit(f"{tmp_path}/out/"), "dest").alias("source_path"))
    before = os.stat(tmp_path / "out/d0/f7").st_mtime_ns
    time.sleep(0.01)
    again = file_sink.write_files(copies.where("dest like 'd0%'"), str(tmp_path / "out2"))
    assert os.stat(tmp_path / "out2/d0/f7").st_mtime_ns == before and again.count() == 8
    file_sink.write_files(rows.limit(1), str(tmp_path / "out2"), overwrite=True)
    assert len(tree(tmp_path / "out2")) == 1 and sorted(os.listdir(tmp_path)) == ["out", "out2"]
    assert file_sink.write_files(rows.limit(0), str(tmp_path / "none")).count() == 0 and os.path.isdir(tmp_path / "none")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    def breaks(parts):
        for part in parts:
            yield part
            if (part["dest"] == "f33").any():
                raise RuntimeError("killed")

    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("dest"), F.lit(b"x").alias("content")).repartition(4)
    with pytest.raises(Exception, match="killed"):
        file_sink.write_files(rows.mapInPandas(breaks, "dest string, content binary"), str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_files_that_fail_are_in_the_ledger(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    rows = [("a", str(tmp_path / "a")), ("b", str(tmp_path / "missing")), ("../c", str(tmp_path / "a")), ("/d", str(tmp_path / "a"))]
    ledger = file_sink.write_files(spark.createDataFrame(rows, "dest string, source_path string"), str(tmp_path / "out"))
    got = {r["dest"]: (r["bytes_copied"], r["failure"] is None) for r in ledger.collect()}
    assert got == {"a": (1, True), "b": (0, False), "../c": (0, False), "/d": (0, False)} and tree(tmp_path / "out") == {"a": b"a"}


class Context:
    def __init__(self, partition, attempt):
        self.partitionId, self.taskAttemptId = lambda: partition, lambda: attempt


def test_attempts_of_a_task_do_not_meet(tmp_path, monkeypatch):
    from pyspark.sql.types import Row

    writer = file_sink.FileWriter({"path": str(tmp_path / "out"), "job": "j"}, False)
    rows = [Row(dest=f"x/{i}", content=b"y" * i) for i in range(5)]

    def attempt(n, given):
        monkeypatch.setattr(file_sink.TaskContext, "get", classmethod(lambda cls: Context(0, n)))
        return writer.write(given)

    def dies():
        yield from rows[:3]
        raise RuntimeError("lost")

    writer.begin()
    with pytest.raises(RuntimeError):
        attempt(1, dies())
    first, second = attempt(2, iter(rows)), attempt(3, iter(rows))  # a speculative one
    assert not os.path.exists(tmp_path / "out") and first == second == file_sink.Written(5, 10, ())
    writer.commit([second])
    assert tree(tmp_path / "out") == {f"x/{i}": b"y" * i for i in range(5)} and os.listdir(tmp_path) == ["out"]
    assert len(os.listdir(tmp_path / "out" / file_sink.LEDGER)) == 1
    with pytest.raises(FileNotFoundError):
        attempt(4, iter(rows))  # one that comes late finds no place to write to
    assert os.listdir(tmp_path) == ["out"]


def rows_of(df):
    return sorted(map(repr, df.drop("modified").collect()))


def make_wide(root, n):
    for i in range(n):
        os.makedirs(f"{root}/top/d{i % 10}/e{i}")
        for name in ("a.md", "b.TXT", "c"):
            with open(f"{root}/top/d{i % 10}/e{i}/{name}", "w") as f:
                f.write("z" * (i % 5))


FILTERED = (
    "size <= 2", "size < 3 AND size > 1 AND error IS NULL", "extension IN ('md', 'txt') AND depth <= 4", "extension = 'md' OR size = 0", "relative_path LIKE 'top/d3/%'",
    "depth < 3", "relative_path LIKE 'top/d%' AND extension = ''", "size >= 4 AND filename = 'c'", "NOT (size > 1)", "extension IS NULL", "error IS NOT NULL",
)


def test_pushed_filters_change_no_row(spark, tmp_path):
    make_wide(tmp_path, 40)
    os.symlink(tmp_path / "top", tmp_path / "link")
    for given in FILTERED:
        on, off = (repo_files.scan_directory(spark, str(tmp_path), push_down=x).where(given) for x in (True, False))
        assert rows_of(on) == rows_of(off), given


def test_the_plan_shows_what_was_pushed(spark, tmp_path, capsys):
    make_wide(tmp_path, 5)
    df = repo_files.scan_directory(spark, str(tmp_path)).where("size <= 2 AND extension IN ('md', 'txt') AND depth <= 4 AND filename LIKE '%x%'")
    df.explain("formatted")
    plan = capsys.readouterr().out
    shown = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "size" in shown and "extension" in shown and "depth" in shown
    condition = plan[plan.index("Condition") :].split("\n")[0] if "Condition" in plan else ""
    assert "filename" in condition and "size" not in condition


def test_pushed_filters_prune_the_walk(tmp_path, monkeypatch):
    from pyspark.sql.datasource import LessThanOrEqual, StringContains, StringStartsWith

    make_wide(tmp_path, 40)
    walk = repo_files.Walk({"path": str(tmp_path)})
    left = list(walk.pushFilters([StringStartsWith(("relative_path",), "top/d3/"), StringContains(("relative_path",), "e"), LessThanOrEqual(("depth",), 4)]))
    assert [type(x) for x in left] == [StringContains]
    entered = []
    listed = os.listdir
    monkeypatch.setattr(repo_files.os, "listdir", lambda p: entered.append(os.path.relpath(p, tmp_path)) or listed(p))
    found = [r for p in walk.partitions() for r in walk.read(p)]
    assert len(found) == 12 and not [x for x in entered if x.startswith("top/d") and not x.startswith("top/d3")]


def test_levels_give_the_rows_of_the_walk(spark, tmp_path, monkeypatch):
    make_wide(tmp_path, 300)
    os.symlink(tmp_path / "top", tmp_path / "link")
    locked = tmp_path / "top" / "locked"
    locked.mkdir()
    for filters in (None, config.Filters(max_depth=4, exclude_dirs=("d7",))):
        plain = repo_files.scan_directory(spark, str(tmp_path), filters)
        assert rows_of(repo_files.scan_levels(spark, str(tmp_path), filters)) == rows_of(plain)
    assert plain.where("modified IS NULL").isEmpty() and not repo_files.is_large(str(tmp_path))
    monkeypatch.setattr(repo_files, "PROBED", 100)
    assert repo_files.is_large(str(tmp_path))
    monkeypatch.setattr(repo_files.Walk, "partitions", lambda self: 1 / 0)  # nothing is listed on the driver
    monkeypatch.setattr(repo_files, "ROWS", 7)
    assert rows_of(repo_files.scan_directory(spark, str(tmp_path), filters)) == rows_of(repo_files.scan_levels(spark, str(tmp_path), filters))
    assert stat.S_ISDIR(os.stat(locked).st_mode) and repo_files.scan_levels(spark, str(locked)).count() == 0


def test_entries_that_cannot_be_read(tmp_path, monkeypatch):
    make_wide(tmp_path, 3)
    walk = repo_files.Walk({"path": str(tmp_path)})
    monkeypatch.setattr(repo_files.Walk, "below", lambda self, x: (_ for _ in ()).throw(PermissionError(13, "no", x)))
    (row,) = walk.level("top")
    assert row[2] == "top" and "no" in row[7] and row[8] == 1
    walk.readable = True
    assert not list(walk.level("top"))


def test_a_kept_tree_is_the_same_both_ways(spark):
    root = catalog_queries.make_tree()
    a, b = (predicates.documentation(f(spark, root, config.Filters()).where("error IS NULL"), config.Filters()) for f in (repo_files.scan_directory, repo_files.scan_levels))
    assert rows_of(a) == rows_of(b) and a.count() == 9


def slow_rows(spark, parts, seconds):
    """Four files for each partition; partition i takes i times ``seconds``."""
    rows = spark.range(0, 4 * parts, 1, parts).withColumn("part", F.spark_partition_id())

    def wait(batches):
        for batch in batches:
            time.sleep(seconds * int(batch["part"].iloc[0]) if len(batch) else 0)
            yield batch

    made = rows.mapInPandas(wait, rows.schema)
    return made.select(F.concat(F.lit("d"), "part", F.lit("/f"), "id").alias("dest"), F.encode(F.repeat(F.lit("x"), F.col("part") + 1), "UTF-8").alias("content"))


def test_progress_is_told_while_a_job_runs(spark, tmp_path):
    seen = []
    ledger = write_files(slow_rows(spark, 6, 0.7), str(tmp_path / "out"), progress=lambda files, size: seen.append((files, size)))
    told = ledger.agg(F.count("*"), F.sum("bytes_copied")).first()
    assert seen[-1] == tuple(told) == (24, 4 * sum(range(1, 7)))
    assert seen == sorted(seen) and len({files for files, _ in seen if 0 < files < 24}) >= 2


@pytest.mark.parametrize("kind", ["timeout", "cancelled"])
def test_a_job_is_stopped_once_and_leaves_nothing(spark, tmp_path, kind):
    out, began, handler = tmp_path / "out", time.monotonic(), signal.getsignal(signal.SIGINT)
    sender = threading.Timer(2.0, os.kill, (os.getpid(), signal.SIGINT))
    other = spark.range(10).cache()
    if kind == "cancelled":
        sender.start()
    with pytest.raises(extract.RunError) as e:
        with extract.interruptible(spark, "stopped", 2.0 if kind == "timeout" else None):
            write_files(slow_rows(spark, 8, 4.0), str(out))
    assert e.value.kind == kind and e.value.detail == ("2" if kind == "timeout" else "")
    assert time.monotonic() - began < 20 and not out.exists()
    assert signal.getsignal(signal.SIGINT) is handler and "stopped" not in spark.getTags()
    assert other.count() == 10  # the session and jobs of others go on
    with extract.interruptible(spark, "stopped", 60.0):
        assert spark.range(10).count() == 10


def test_a_failed_forced_run_keeps_the_old_output(spark, tmp_path, monkeypatch):
    root, base = catalog_queries.make_tree(), tmp_path / "base"
    (base / "out").mkdir(parents=True)
    (base / "out" / "old.txt").write_text("old")
    settings = config.Config(output=config.Output(base_directory=str(base), force=True))

    def fails(*_):
        raise OSError("full")

    monkeypatch.setattr(extract.copyplan, "copy_files", fails)
    with pytest.raises(OSError):
        extract.extract(spark, root, settings, extract.Repository("r"), "out")
    assert (base / "out" / "old.txt").read_text() == "old"


def test_a_task_holds_a_bounded_part_of_its_ledger(spark, tmp_path):
    import pyarrow.parquet as pq

    n, before = 2 * file_sink.HELD + 7, spark.conf.get(file_sink.BATCH)
    name = F.when(F.col("id") == 3, F.lit("../out")).otherwise(F.concat((F.col("id") % 9).cast("string"), F.lit("/"), F.col("id").cast("string")))
    ledger = file_sink.write_files(spark.range(n).coalesce(1).select(name.alias("dest"), F.col("id").cast("string").cast("binary").alias("content")), str(tmp_path / "out"))
    assert ledger.count() == n and ledger.where("failure IS NOT NULL").count() == 1 and spark.conf.get(file_sink.BATCH) == before
    (part,) = (tmp_path / "out" / file_sink.LEDGER).glob("part-*")
    meta = pq.ParquetFile(part).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [file_sink.HELD, file_sink.HELD, 7]
    assert meta.metadata[b"files"] == str(n - 1).encode() and (tmp_path / "out" / "0" / "9").read_text() == "9"
