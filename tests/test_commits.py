import os
import random
import subprocess

import pytest

from leafmill.operators import commits
from leafmill.sources import git_commits

SCHEMA = "repo_id long, commit_id long, parents array<long>"


def brute(rows, heads):
    graph, out = {}, {}
    for repo, c, parents in rows:
        graph.setdefault((repo, c), set()).update(p for p in parents or () if p is not None)
    for repo, head in heads:
        seen, todo = set(), [head]
        while todo:
            c = todo.pop()
            if c not in seen and (repo, c) in graph:
                seen.add(c)
                todo += graph[repo, c]
        out[repo] = (head, len(seen), not seen)
    return out


def counted(spark, rows, heads):
    got = commits.commit_counts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(heads, "repo_id long, commit_id long"))
    return {r["repo_id"]: (r["head"], r["total_commits"], r["is_empty"]) for r in got.collect()}


def test_odd_graphs(spark):
    line = [(1, i, [i - 1]) for i in range(1, 700)] + [(1, 0, None)]  # one group, so few rounds
    rows = [*line, (2, 5, [4, 3, 4, None]), (2, 5, [4, 3]), (2, 4, [3]), (2, 3, []), (2, 9, [3]), (3, 1, [2]), (3, 2, [1]), (3, 7, None), (4, 1, [99]), (None, 1, None), (6, None, None)]
    heads = [(1, 650), (2, 5), (3, 7), (4, 1), (5, None), (6, 12)]
    assert counted(spark, rows, heads) == brute(rows[:-2], heads)
    assert counted(spark, rows, heads)[1] == (650, 651, False) and counted(spark, [], heads)[5] == (None, 0, True)


def test_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(commits, "LAYERS", 2)
    draw, rows, heads = random.Random(7), [], []
    for repo in range(12):
        n = draw.randint(1, 60)
        for c in range(n):
            parents = draw.sample(range(max(0, c - 8), c), min(c, draw.choice((0, 1, 1, 1, 1, 2, 3)))) if c else None
            rows.append((repo, c, parents))
        heads.append((repo, draw.randrange(n)))
    assert counted(spark, rows, heads) == brute(rows, heads)


def git(folder, *arguments):
    names = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}
    return subprocess.run(["git", *arguments], cwd=folder, env=os.environ | names, check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture
def checkout(tmp_path):
    """Two branches that were merged, a further branch that was not, most of it packed, the last commits loose."""
    git(tmp_path, "init", "-q", "-b", "trunk", "repo")
    repo = str(tmp_path / "repo")
    message = "\n".join(f"line {i} of a long message" for i in range(60))
    for i in range(30):
        git(repo, "commit", "-q", "--allow-empty", "-m", f"{i}\n\n{message}")
    git(repo, "checkout", "-q", "-b", "side", "HEAD~10")
    for i in range(5):
        git(repo, "commit", "-q", "--allow-empty", "-m", f"side {i}\n\n{message}")
    git(repo, "checkout", "-q", "trunk")
    git(repo, "merge", "-q", "--no-ff", "side", "-m", f"merged\n\n{message}")
    git(repo, "checkout", "-q", "-b", "left", "HEAD~3")
    git(repo, "commit", "-q", "--allow-empty", "-m", "not merged")
    git(repo, "checkout", "-q", "trunk")
    git(repo, "repack", "-q", "-a", "-d", "-f", "--depth=50", "--window=50")
    git(repo, "pack-refs", "--all")
    git(repo, "tag", "-a", "v1", "-m", "a tag is no commit")
    git(repo, "commit", "-q", "--allow-empty", "-m", "loose")
    return repo


def test_commits_of_a_checkout(spark, checkout, monkeypatch):
    monkeypatch.setattr(git_commits, "OBJECTS", 7)
    want = {x.split()[0]: x.split()[1:] for x in git(checkout, "rev-list", "--all", "--parents").splitlines()}
    got = {r["commit_id"]: r["parents"] for r in git_commits.commits(spark, checkout, 3).collect()}
    assert got == want and len(want) == 38
    found = git_commits.repositories(spark, {3: checkout}).collect()
    assert [tuple(r) for r in found] == [(3, "trunk", git(checkout, "rev-parse", "HEAD"), int(git(checkout, "rev-list", "--count", "HEAD")), False)]


def test_packed_differences_are_put_together(checkout):
    kinds = set()
    for index in (f"{checkout}/.git/objects/pack/{x}" for x in os.listdir(f"{checkout}/.git/objects/pack") if x.endswith(".idx")):
        pack = git_commits.Pack(index.removesuffix(".idx"))
        for i in range(pack.size):
            kinds.add(pack.head(pack.offset(i))[0])
            name = pack.id(i).hex()
            body = pack.commit(i)
            assert (body is not None) == (git(checkout, "cat-file", "-t", name) == "commit")
            assert pack.find(pack.id(i)) == pack.offset(i) and pack.find(b"\xff" * 20) is None
            if body is not None:
                assert body.decode().strip() == git(checkout, "cat-file", "commit", name)
    assert git_commits.OFFSET_DELTA in kinds and git_commits.COMMIT in kinds


def test_heads(spark, checkout, tmp_path):
    assert git_commits.read_head(checkout) == git_commits.Head("trunk", git(checkout, "rev-parse", "HEAD"))
    git(checkout, "worktree", "add", "-q", str(tmp_path / "tree"), "left")
    assert git_commits.read_head(str(tmp_path / "tree")) == git_commits.Head("left", git(checkout, "rev-parse", "left"))
    git(checkout, "checkout", "-q", "--detach", "side")
    assert git_commits.read_head(checkout) == git_commits.Head("HEAD", git(checkout, "rev-parse", "side"))
    git(tmp_path, "init", "-q", "-b", "first", "new")
    assert git_commits.read_head(str(tmp_path / "new")) == git_commits.Head("first", None)
    found = git_commits.repositories(spark, {1: str(tmp_path / "new"), 2: str(tmp_path / "tree")}).orderBy("repo_id").collect()
    assert [tuple(r)[1:] for r in found] == [("first", None, 0, True), ("left", git(checkout, "rev-parse", "left"), int(git(checkout, "rev-list", "--count", "left")), False)]
    with pytest.raises(FileNotFoundError):
        git_commits.read_head(str(tmp_path))


def test_copy_codes_of_differences():
    base = bytes(range(256)) * 300
    delta = b"\x80\xd8\x04" + b"\x05" + b"\x90\x03" + b"\x02hi" + b"\xb1\x10\x00\x01" + b"\x80"
    assert git_commits.changed(base, delta) == base[:3] + b"hi" + base[0x10 : 0x10 + 0x100] + base[:0x10000]


def test_reports_tell_of_the_checkout(spark, checkout, tmp_path, monkeypatch, capsys):
    from leafmill.cli import main

    monkeypatch.chdir(tmp_path)
    (tmp_path / "repo" / "README.md").write_text("x")
    assert main([checkout, "-o", "out"], spark) == 0
    lines = (tmp_path / "out" / ".leafmill" / "extraction_report.txt").read_text().splitlines()
    assert "Branch: trunk" in lines and f"Total commits: {git(checkout, 'rev-list', '--count', 'HEAD')}" in lines and "Repository empty: false" in lines
