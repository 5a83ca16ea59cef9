import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill import config
from leafmill.cli import main
from leafmill.functions import paths, text, urls
from leafmill.operators import copyplan, messages, predicates, reports, stats
from leafmill.plans import catalog_queries, extract
from leafmill.sources import repo_files
from leafmill.sources.catalog import from_paths
from leafmill.sources.repo_files import scan_directory


def col(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def catalog(spark, *rows):
    return from_paths(spark.createDataFrame([(0, p, s) for p, s in rows], "repo_id long, relative_path string, size long"))


@pytest.mark.parametrize(
    ("names", "want"),
    [
        (["README.md", "guide.rst", "notes.txt", "manual.adoc", "README.MD", "guide.RST", "README", "LICENSE", "CHANGELOG", "CONTRIBUTING"], True),
        (["script.js", "style.css", "image.png", "data.json", "BINARY", "EXECUTABLE", "CONFIG", "MAKEFILE"], False),
        ([n.upper() for n in predicates.SCAN_NAMES], True),
    ],
)
def test_detection(spark, names, want):
    rows = catalog(spark, *[(n, 1) for n in names])
    assert predicates.documentation(rows, config.Filters()).count() == (len(names) if want else 0)


def test_directories(spark):
    filters = config.Filters(exclude_dirs=(".git", "node_modules", "target"), exclude_patterns=())
    good = ["docs", "documentation", "examples", ".github", ".vscode"]
    bad = [".git", "node_modules", "target", "build", "dist", "__pycache__", ".cache", ".pytest_cache", "Node_Modules", "BUILD", ".secret"]
    rows = catalog(spark, *[(f"{d}/a.md", 1) for d in good + bad])
    kept = {r["relative_path"] for r in predicates.documentation(rows, filters).collect()}
    assert kept == {f"{d}/a.md" for d in good}


def test_sizes_depth_and_patterns(spark):
    rows = catalog(spark, ("a.md", 1 << 20), ("b.md", (1 << 20) + 1), ("x.min.md", 0), ("x.min.d/a.md", 1), ("1/2/3/4.md", 1), ("1/2/3.md", 1))
    filters = config.Filters(max_file_size=1 << 20, max_depth=3)
    assert {r["relative_path"] for r in predicates.documentation(rows, filters).collect()} == {"a.md", "x.min.md", "1/2/3.md"}
    assert catalog_queries.PATTERNS.patterns == (r"^docs/g", r"src\d*[02468]$", r"d3/d4$")


def test_extensions_and_order(spark):
    assert col(spark, ["a.md", ".md", "..md", "a.", "README", "a.tar.GZ"], paths.extension) == ["md", "", "md", "", "", "gz"]
    rows = catalog(spark, ("a.md", 1), ("a-b/c.md", 1), ("a/b.md", 1))
    assert [r[0] for r in rows.orderBy(paths.parts(F.col("relative_path"))).select("relative_path").collect()] == ["a/b.md", "a-b/c.md", "a.md"]
    assert col(spark, ["/r/a/b.md", "/r/../x", "/q/a"], lambda c: paths.relative(c, F.lit("/r/"))) == ["a/b.md", None, None]


def test_ties_and_statistics(spark):
    rows = catalog(spark, ("test.md", 100), ("z", 200), ("a/README", 200), ("b", 200))
    r = stats.scan_statistics(rows).first()
    assert (r["total_files"], r["total_size"], r["largest_size"], r["largest_path"]) == (4, 700, 200, "z")
    s = stats.report_summary(copyplan.plan_copy(rows)).first()
    assert (s["average_size"], s["largest_path"]) == (175, "a/README")
    assert stats.counts_map(rows).first()["files_by_extension"] == {"md": 1, "no_extension": 3}
    f = spark.range(1).select(stats.fetch_progress(*map(F.lit, (50, 100, 0, 0, 2048))).alias("x")).first()["x"]
    assert (f["percent"], f["message"]) == (50, "Receiving objects 50/100 (2.0 KB)")


def test_text(spark):
    sizes = [500, 512, 1023, 1024, 1280, 1536, 1792, 1 << 20, 2 << 20, 1 << 30, 1 << 40]
    assert col(spark, sizes, text.format_bytes, "long") == ["500 B", "512 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.8 KB", "1.0 MB", "2.0 MB", "1.0 GB", "1024.0 GB"]
    assert col(spark, [30000, 90000, 3661000, 500, 0], text.format_duration, "long") == ["30s", "1m 30s", "61m 1s", "500ms", "0ms"]
    assert col(spark, ["10", "10KB", "5MB", "1GB", "invalid", "-5MB", "1.5mb", "10 mb", " 10 ", "1e3k", "1.5d"], text.parse_size) == [10, 10240, 5 << 20, 1 << 30, None, None, 1572864, None, 10, 1024000, None]
    assert col(spark, ["normal_file.txt", "file<>with|bad*chars.txt", "file/with\\slashes.txt", "   ", "file..."], text.sanitize_filename) == ["normal_file.txt", "file__with_bad_chars.txt", "file_with_slashes.txt", "unnamed_file", "file"]
    assert col(spark, ["normal-repo", "repo/with/slashes", "repo:with:colons", "", "  ", "a" * 150], text.sanitize_repo_name) == ["normal-repo", "repo_with_slashes", "repo_with_colons", "unnamed_repo", "unnamed_repo", "a" * 100]


def test_urls(spark):
    cases = {
        "https://github.com/microsoft/vscode": "ok", "https://github.com/rust-lang/rust.git": "ok", "git://github.com/o/r": "ok", "https://gitlab.com/o/r": "host",
        "http://github.com/o/r": "scheme", "https://github.com/o": "path", "https://github.com/": "path", "not-a-url": "bad_url", "ftp://github.com/o/r": "scheme",
        "https://evilgithub.com/o/r": "ok", "git@github.com:o/r": "bad_url", "https://github.com/o/.r": "dot", "https://github.com/o/" + "r" * 101: "length",
    }
    assert col(spark, list(cases), urls.url_problem) == list(cases.values())
    assert col(spark, ["https://evilgithub.com/o/r", "https://api.github.com/o/r"], lambda c: urls.url_problem(c, strict_host=True)) == ["host", "ok"]
    assert col(spark, ["https://github.com/rust-lang/book.git"], urls.output_name) == ["docs_book"]


def test_copy_plan(spark):
    rows = catalog(spark, ("b/README", 5), ("a/README", 7), ("c/bad?.md", 1), ("_index.md", 1), ("end ", 2))
    plan = {r["relative_path"]: r for r in copyplan.plan_copy(rows, preserve=False).collect()}
    assert plan["a/README"]["reject_reason"] is None and plan["b/README"]["reject_reason"] == "exists"
    assert plan["c/bad?.md"]["reject_reason"] == "invalid_characters" and plan["_index.md"]["shadowed"]
    forced = copyplan.plan_copy(rows, preserve=False, force=True)
    assert forced.where("reject_reason = 'exists'").count() == 0
    done = spark.range(1).select(copyplan.percent_complete(F.lit(1), F.lit(10)), copyplan.percent_complete(F.lit(0), F.lit(0)), copyplan.remaining_seconds(F.lit(5), F.lit(10), F.lit(2.0))).first()
    assert tuple(done) == (10.0, 0.0, 2.0)


def test_configuration(tmp_path):
    path = tmp_path / "leafmill.toml"
    path.write_text(config.to_toml(config.Config()))
    assert config.discover(directory=str(tmp_path)) == config.load_file(str(path)) == config.Config()
    merged = config.merge(config.Config(), {"timeout": 600, "formats": "md, TXT,,", "exclude": ["x", "x"], "branch": None})
    assert merged.git.timeout == 600 and merged.filters.extensions == ("md", "txt") and merged.filters.exclude_dirs[-2:] == ("x", "x")
    (tmp_path / "part.toml").write_text("[filters]\nextensions = ['md']\n")
    for bad in ("part.toml", "missing.toml"):
        with pytest.raises(config.ConfigError):
            config.load_file(str(tmp_path / bad))
    assert config.problem(config.Config()) is None
    assert config.problem(config.merge(config.Config(), {"formats": ","})) == "no_extensions"
    assert config.problem(config.merge(config.Config(), {"timeout": 0})) == "timeout"
    assert len(config.Config().filters.extensions) == 14


def test_directory_scan(spark):
    root = catalog_queries.make_tree()
    rows = scan_directory(spark, root).collect()
    assert {r["relative_path"] for r in rows} == set(catalog_queries.TREE)
    pruned = scan_directory(spark, root, config.Filters())
    kept = predicates.documentation(pruned, config.Filters())
    want = {"README", "guide.md", "_index.md", ".dot.md", "_drafts/d.md", ".github/c.md", "a/b.md", "a-b/c.md", "empty.txt"}
    assert {r["relative_path"] for r in kept.collect()} == want
    assert {r["relative_path"] for r in predicates.documentation(scan_directory(spark, root), config.Filters()).collect()} == want
    with pytest.raises(NotADirectoryError):
        scan_directory(spark, root + "/none")


def test_extraction(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    root = catalog_queries.make_tree()
    os.utime(os.path.join(root, "guide.md"), (1_000_000_000, 1_000_000_000))
    assert main([root, "--url", "https://github.com/o/tree.git"], spark) == 0
    out = tmp_path / "docs_tree"
    assert (out / "a-b/c.md").read_text() == open(os.path.join(root, "a-b/c.md")).read()
    assert (out / "guide.md").stat().st_mtime == 1_000_000_000
    report = json.loads((out / ".leafmill/extraction_report.json").read_text())
    assert report["extraction_summary"]["total_files_processed"] == 9 and len(report["files"]) == 9 and report["errors"] == []
    assert "Total files: 9" in (out / "_index.md").read_text() and "## a-b/" in (out / "_index.md").read_text()
    assert "**Repository:** [o/tree]" in (out / "EXTRACTION_SUMMARY.md").read_text()
    assert main([root, "--url", "https://github.com/o/tree.git"], spark) == 8
    assert main([root, "--url", "https://github.com/o/tree.git", "--force", "--preserve-structure", "false"], spark) == 0
    assert (out / "c.md").read_text() == "file 9\n" and not (out / "a-b").exists()  # of two files named c.md the last of the walk stays
    assert json.loads((out / ".leafmill/extraction_report.json").read_text())["extraction_summary"]["total_files_processed"] == 9


def test_exit_codes(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    root = catalog_queries.make_tree()
    assert main(["--generate-config"]) == 0 and config.load_file("leafmill.toml") == config.Config()
    assert main([root, "--dry-run"], spark) == 0
    assert main([root, "--url", "http://github.com/o/r"], spark) == 2
    assert main([root, "--formats", "zzz", "-e", "a", "-o", "x"], spark) == 0  # README goes by its name
    assert main([str(tmp_path / "none")], spark) == 1
    assert main([root, "--formats", ","], spark) == 1
    os.makedirs("empty")
    assert main(["empty"], spark) == 6
    os.makedirs("flat/a")
    os.makedirs("flat/b")
    for d in "ab":
        open(f"flat/{d}/x.md", "w").close()
    assert main(["flat", "--preserve-structure", "false"], spark) == 2
    assert "hint" not in capsys.readouterr().out


def test_messages(spark):
    rows = spark.createDataFrame([("warning", 0, False), ("warning", 1, False), ("debug", 2, False), ("debug", 2, True), ("error", 0, True)], "level string, v int, q boolean")
    got = rows.select(messages.is_shown(F.col("level"), F.col("v"), F.col("q")).alias("x")).collect()
    assert [r["x"] for r in got] == [False, True, True, False, True]
    assert col(spark, ["JSON", "Plain", "human", "invalid"], messages.mode) == ["json", "plain", "human", "human"]


def test_cancellation_tags(spark):
    with extract.cancellable(spark, "a-tag") as stop:
        assert "a-tag" in spark.getTags()
        stop()
    assert "a-tag" not in spark.getTags()


def test_patterns_are_read_by_the_engine_that_runs_them(spark):
    filters = config.Filters(exclude_patterns=(r"(?P<x>a)", r"^\p{L}$", "[", r"^(?<n>d)\d$"))
    assert filters.patterns == (r"^\p{L}$", r"^(?<n>d)\d$")
    rows = catalog(spark, ("é/a.md", 1), ("a/a.md", 1), ("d1/a.md", 1), ("dd/a.md", 1), ("é.md", 1))
    assert {r["relative_path"] for r in predicates.documentation(rows, filters).collect()} == {"dd/a.md", "é.md"}


def test_addresses_outside_ascii(spark):
    given = ["https://github.com/ünï/r", "https://github.com/½/r", "https://github.com/o/é", "https://github.com/o/r"]
    assert col(spark, given, urls.url_problem) == ["owner_chars", "owner_chars", "repo_chars", "ok"]


def test_settings_with_odd_characters_are_written_and_read(tmp_path):
    odd = config.Config(config.Filters(exclude_dirs=("it's", 'say "x"', "back\\slash", "tab\t", "\x7f", "ü")), config.Output(base_directory="/home/o'neil/it"))
    (tmp_path / "odd.toml").write_text(config.to_toml(odd))
    assert config.load_file(str(tmp_path / "odd.toml")) == odd


def test_forced_copies_have_one_writer(spark):
    rows = catalog(spark, ("b/x.md", 5), ("a/x.md", 7), ("c/x.md", 1), ("y.md", 2))
    plan = {r["relative_path"]: r for r in copyplan.plan_copy(rows, preserve=False, force=True).collect()}
    assert [p for p, r in plan.items() if not r["replaced"] and r["dest"] == "x.md"] == ["c/x.md"] and not any(r["reject_reason"] for r in plan.values())
    assert not any(r["replaced"] for r in copyplan.plan_copy(rows, preserve=False).collect())


def test_partitions_of_a_tree(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"top/d{i}/e").mkdir(parents=True)
        (tmp_path / f"top/d{i}/e/f.md").write_text("x")
        (tmp_path / f"top/d{i}/g.md").write_text("x")
    (tmp_path / "z.md").write_text("x")
    walk = repo_files.Walk({"path": str(tmp_path)})
    monkeypatch.setattr(repo_files, "ENOUGH", 8)
    assert [len(p.value) for p in walk.partitions()] == [1] * 30 + [1]
    monkeypatch.setattr(repo_files, "FILES", 7)
    monkeypatch.setattr(repo_files, "ENOUGH", 1000)
    found = [r[2] for p in walk.partitions() for r in walk.read(p)]
    assert len(found) == len(set(found)) == 61 and max(len(p.value) for p in walk.partitions()) == 7
    assert scan_directory(spark, str(tmp_path), config.Filters(max_depth=3)).count() == 31
    assert scan_directory(spark, str(tmp_path)).count() == 61


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    root = catalog_queries.make_tree()
    settings = config.Config(output=config.Output(base_directory=str(tmp_path / "new")))
    monkeypatch.setattr(extract.reports, "text_lines", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        extract.extract(spark, root, settings, extract.Repository("r"), "out")
    assert os.listdir(tmp_path / "new") == []
    monkeypatch.setattr(extract.tempfile, "mkstemp", lambda **k: (_ for _ in ()).throw(PermissionError("no")))
    with pytest.raises(extract.RunError) as e:
        extract.check_writable(str(tmp_path))
    assert e.value.kind == "permission"


def test_console_of_a_run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    root = catalog_queries.make_tree()
    assert main([root, "-o", "one", "--output-format", "json"], spark) == 0
    decoder, text_, found = json.JSONDecoder(), capsys.readouterr().out.strip(), []
    while text_:
        value, end = decoder.raw_decode(text_)
        found.append(value)
        text_ = text_[end:].strip()
    assert (found[0]["type"], found[0]["files_processed"], found[0]["errors"]) == ("summary", 9, 0)
    assert set(found[1]["files"][0]["modified"]) == {"secs_since_epoch", "nanos_since_epoch"} and set(found[1]["extraction_summary"]["extraction_duration"]) == {"secs", "nanos"}
    assert main([root, "-o", "two", "-q", "--output-format", "plain"], spark) == 0
    assert capsys.readouterr().out.startswith("REPORT: Extraction completed\nRepository: local/")
    assert main([root, "-o", "three"], spark) == 0
    assert "✓ Documentation extraction completed!" in (shown := capsys.readouterr().out) and "=== Extraction Report ===" in shown and "  md: 7 files" in shown


def test_flat_names_are_settled_without_a_window_over_them(spark):
    rows = catalog(spark, *((f"d{i}/README", i) for i in range(40)), ("x/a<b", 1), ("y/a<b", 1), ("d1/README", 1), ("z.md", 3))
    for force in (False, True):
        plan = copyplan.plan_copy(rows, preserve=False, force=force)
        got = plan.collect()
        taken = [r["relative_path"] for r in got if r["reject_reason"] is None and not r["replaced"] and r["dest"] == "README"]
        assert taken == [max(f"d{i}/README" for i in range(40)) if force else "d0/README"]
        assert sorted(r["reject_reason"] or "" for r in got) == [""] * (42 if force else 2) + (["exists"] * 40 if not force else []) + ["invalid_characters"] * 2
        windows = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
        assert windows and not any("dest" in x for x in windows)
    twice = copyplan.plan_copy(catalog(spark, ("a/b.md", 1), ("a/b.md", 2), ("a/c.md", 2))).collect()
    assert sorted((r["relative_path"], r["size"], r["reject_reason"]) for r in twice) == [("a/b.md", 1, None), ("a/b.md", 2, "exists"), ("a/c.md", 2, None)]


def test_lines_are_written_by_tasks(spark, tmp_path):
    lines = spark.range(1, 5001).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("zeile ü "), "id")).alias("line")).repartition(7)
    extract.write_lines(lines, str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text().split("\n") == [*("" if i % 3 == 0 else f"zeile ü {i}" for i in range(1, 5001)), ""]
    assert os.listdir(tmp_path) == ["out.txt"]


def test_dots_and_odd_characters_of_addresses(spark):
    cases = {
        "https://github.com/o/../x/y": ["x", "y"], "https://github.com/o/r/..": ["o", ""], "https://github.com/o/%2E/r": ["o", "r"], "https://github.com/..": [""],
        "https://github.com\\o\\r": ["o", "r"], " https://github.com/o/r ": ["o", "r"], "https://github.com/o b/r": ["o%20b", "r"], "git://github.com/o\\b/r": ["o%5Cb", "r"],
        "https://github.com": [""], None: [""],
    }
    assert col(spark, list(cases), urls.segments) == list(cases.values())
    assert col(spark, ["https://github.com/o/../x/y", "https://github.com/o/../r", "https://github.com/o b/r"], urls.url_problem) == ["ok", "path", "owner_chars"]


def test_patterns_that_need_backtracking_are_passed_over(spark):
    refused = ("(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", r"(?<n>a)\k<n>", r"a\Z", r"\Qa\E", r"[a](?!b)", "(", r"\é")
    taken = (r"a\.b", "[(?=]a", r"\(?!", "(?:a)", "(?i)a", r"[\[(?!]", r"\p{L}+$", "(?<n>a)", "")
    assert config.Filters(exclude_patterns=refused + taken).patterns == taken
    assert config.Filters(exclude_patterns=refused).patterns == () == config.Filters(exclude_patterns=()).patterns


def test_report_as_lines_is_the_report(spark):
    rows = catalog(spark, ('b/say "x".md', 5), ("a/README", 7), ("b/README", 7), ("b/tab\t\\.md", 1), ("é/ü.rst", 0), ("c/bad?.md", 1))
    repos = spark.createDataFrame([(0, "o", "r", "u", "main", 3, False), (1, "o", "none", "u", "main", 0, True)], "repo_id long, owner string, name string, url string, default_branch string, total_commits long, is_empty boolean")
    rows = rows.withColumn("repo_id", F.lit(0).cast("long"))
    for preserve in (False, True):
        plan = copyplan.plan_copy(rows, preserve=preserve)
        at = (F.lit("2024-02-29 12:34:56Z").cast("timestamp"), F.lit(1234))
        for given in (at, (None, None)):
            lines = [r["line"] for r in reports.json_lines(plan, repos, config.Config(), *given).orderBy("ordinal").collect()]
            whole = reports.report_json(reports.report_rows(plan, repos, config.Config(), *given)).collect()
            assert len(whole) == 1 and json.loads("\n".join(lines)) == json.loads(whole[0]["json"])
            assert sum(x.startswith('    {"filename"') for x in lines) == 6
    none = reports.json_lines(copyplan.plan_copy(rows.where("size < 0")), repos, config.Config())
    assert none.count() == 0  # a repository without files has no report, as in report_rows


def test_settings_are_changed_by_copies():
    plain = config.Filters(extensions=("md",), exclude_dirs=("a",))
    assert plain.with_extension("RST").extensions == ("md", "rst") and plain.with_extension("MD") is plain
    assert plain.without_extension("Md").extensions == () and plain.without_extension("x").extensions == ("md",)
    assert plain.with_excluded_dir("B").exclude_dirs == ("a", "B") and plain.with_excluded_dir("a") is plain
    assert plain == config.Filters(extensions=("md",), exclude_dirs=("a",))


def test_verbosity_and_summary_of_a_repository(spark):
    rows = spark.createDataFrame([(2, False), (2, True), (0, False)], "v int, q boolean")
    assert [r["x"] for r in rows.select(messages.verbosity(F.col("v"), F.col("q")).alias("x")).collect()] == [2, 0, 0]
    repos = spark.createDataFrame([("o", "r", "dev", 7, False), ("o", "e", "main", 0, True)], "owner string, name string, default_branch string, total_commits long, is_empty boolean")
    assert [r["s"] for r in repos.select(reports.repository_summary().alias("s")).collect()] == ["Repository: o/r\nBranch: dev\nCommits: 7\nEmpty: false", "Repository: o/e\nBranch: main\nCommits: 0\nEmpty: true"]


def test_statistics_and_errors_of_a_tree(spark):
    root = catalog_queries.make_tree()
    r = extract.statistics(spark, root, config.Config()).first()
    sizes = {p: os.path.getsize(os.path.join(root, p)) for p in ("README", "guide.md", "_index.md", ".dot.md", "_drafts/d.md", ".github/c.md", "a/b.md", "a-b/c.md", "empty.txt")}
    assert (r["total_files"], r["total_size"], r["largest_size"]) == (9, sum(sizes.values()), max(sizes.values()))
    assert extract.scan_errors(spark, root, config.Config()).count() == 0
