"""Commits reachable from the heads of all repositories at once.

The graph is contracted first. A commit that is no head and has one child only is reachable just when
that child is, so it joins its child's group; pointers to the children are doubled until they stand
still, which takes as many rounds as the longest line has bits. What is left are heads, commits without
a child, and those where branches part. From the heads, frontiers of groups go along the edges between
groups: a round joins the frontier to the edges and keeps, by an anti-join, what was not seen before,
until a frontier is empty. All repositories share a round, and a round's tables are written, so that a
plan never grows and a lost executor costs one round.

Repeated commits and repeated parents count once. Parents that the table lacks (a shallow clone ends
there) are passed over, and null parents are none. Ids of different repositories never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.tables import materialize

#: Frontiers that are kept as tables of their own; then they become one.
LAYERS = 8


def _groups(edges: DataFrame, nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo_id, commit_id, group): the commit that decides whether this one is reachable."""
    only = edges.groupBy("repo_id", "parent").agg(F.count("*").alias("n"), F.first("commit_id").alias("child")).where("n = 1")
    only = only.join(heads.select("repo_id", F.col("commit_id").alias("parent")), ["repo_id", "parent"], "left_anti")
    up = nodes.join(only.select("repo_id", F.col("parent").alias("commit_id"), "child"), ["repo_id", "commit_id"], "left")
    up = materialize(up.select("repo_id", "commit_id", F.coalesce("child", "commit_id").alias("group")), "groups")
    for _ in range(up.count().bit_length() + 1):
        further = up.select("repo_id", F.col("commit_id").alias("group"), F.col("group").alias("next"))
        moved = up.join(further, ["repo_id", "group"]).select("repo_id", "commit_id", F.col("next").alias("group"), (F.col("next") != F.col("group")).alias("moved"))
        moved = materialize(moved, "groups")
        up, still = moved.drop("moved"), moved.where("moved").isEmpty()
        if still:
            break
    return up


def reachable_groups(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The distinct (repo_id, group) that ``start`` reaches along the edges (repo_id, group, parent), start included."""
    frontier = materialize(start.select("repo_id", "group").distinct(), "frontier")
    layers = [frontier]
    while not frontier.isEmpty():
        seen = layers[0]
        for x in layers[1:]:
            seen = seen.union(x)
        if len(layers) >= LAYERS:
            seen = materialize(seen, "seen")
            layers = [seen]
        reached = frontier.join(edges, ["repo_id", "group"]).select("repo_id", F.col("parent").alias("group")).distinct()
        frontier = materialize(reached.join(seen, ["repo_id", "group"], "left_anti"), "frontier")
        layers.append(frontier)
    out = layers[0]
    for x in layers[1:]:
        out = out.union(x)
    return out


def commit_counts(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo_id, head, total_commits, is_empty) for each row of heads (repo_id, commit_id), one of each repository.

    ``commits`` has repo_id, commit_id and parents (an array). A repository whose head is null, or not
    among the commits, has none.
    """
    known = commits.where(F.col("commit_id").isNotNull() & F.col("repo_id").isNotNull())
    nodes = materialize(known.select("repo_id", "commit_id").distinct(), "commits")
    parts = known.select("repo_id", "commit_id", F.explode("parents").alias("parent")).where("parent IS NOT NULL").distinct()
    edges = materialize(parts.join(nodes.select("repo_id", F.col("commit_id").alias("parent")), ["repo_id", "parent"], "left_semi"), "edges")
    groups = _groups(edges, nodes, heads)
    sizes = groups.groupBy("repo_id", "group").agg(F.count("*").alias("n"))
    # An edge inside a group says nothing; all others lead to a commit that is a group of its own.
    apart = groups.where("commit_id = group").select("repo_id", F.col("commit_id").alias("parent"))
    between = edges.join(groups, ["repo_id", "commit_id"]).join(apart, ["repo_id", "parent"], "left_semi").where("group <> parent")
    between = materialize(between.select("repo_id", "group", "parent").distinct(), "between")
    start = heads.where("commit_id IS NOT NULL").select("repo_id", F.col("commit_id").alias("group")).join(sizes, ["repo_id", "group"], "left_semi")
    counts = reachable_groups(between, start).join(sizes, ["repo_id", "group"]).groupBy("repo_id").agg(F.sum("n").alias("n"))
    out = heads.join(counts, "repo_id", "left")
    return out.select("repo_id", F.col("commit_id").alias("head"), F.coalesce("n", F.lit(0)).cast("long").alias("total_commits"), F.col("n").isNull().alias("is_empty"))
