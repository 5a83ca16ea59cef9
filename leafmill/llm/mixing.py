"""Mixing sources to target weights by Pfair scheduling. Native: DataFrame functions only.

A source is dealt, in a seeded order, into blocks of ``block_rows`` rows. Weights become whole units
out of ``resolution``, at least one for each source, so that the schedule repeats in rounds: a round
holds as many blocks of a source as it has units. The ideal schedule serves all sources at once, at
their weights. A block is released in the slot in which the ideal schedule begins it, and due when
that has ended it. Each slot takes the released block that is due first. As the ideal shares fill
each slot exactly, no deadline is missed, and each source is always less than one block away from
the ideal schedule.

A source that runs out takes part in one round until its last block, and not in later ones; the
shares of the others grow in proportion. There are at most two kinds of rounds for each source, so
only these are scheduled, whatever the number of rows.

Weights that are whole or decimal numbers in proportion to whole units that sum to ``EXACT_UNITS`` at
most are met exactly: 0.7 and 0.3 are 7 and 3 units, and the bound of one block holds for them however
many the rows.

All sources are dealt by one schedule, by the same rules however many there are. Up to ``MOST_SOURCES`` a
fold takes the slots of a round one by one; of more, the same slots come from joins and windows: a block
takes the first slot from its release on that no block before it in the order of deadlines has, so the half
that is due first is placed without the other, which shares the slots left over. Halves are halved
again until ``LEAF`` blocks are left to a fold. What sources have in common, their weights, and the rounds
in which some run out, come to the driver: no more of either than some twice the square root of the rows,
or than ``weights`` has.

With ``components``, which a caller may choose, sources beyond ``MOST_SOURCES`` are mixed at two levels or more instead. The
``HEAVIEST`` by weight stay as they are, and the others go by a hash of their names into components of some
``COMPONENT_SIZE``, which the same rules mix: a block of a component is the block that its own schedule has
next. A source in a component is less than two blocks away from the ideal schedule, not one, and one more
for each further level.

A null source is a source. Equal ids are ordered by the columns in ``tie``; rows without an id are
shuffled by their other columns. Empty tables give empty results; columns that share a name with a
result column are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, join_checked, let, materialize
from leafmill.llm.ranks import bucket_count, hex_bucket, shuffle_key, stratum, with_rank
from leafmill.operators.ranks import running, with_ordinal

#: Sources that a fold over the slots of a round deals at most; joins and windows find the same slots for more.
MOST_SOURCES = 256
#: Blocks of a round that a fold places by a mask of bits, where halves are halved no further.
LEAF = 32
#: Of more sources, so many stay by themselves; the others are put into components of about this size.
HEAVIEST, COMPONENT_SIZE = 64, 96
#: Weights in proportion to whole units with at most this sum are met exactly.
EXACT_UNITS = 4_096
#: Rounds that are listed from one row at a time.
LISTED_ROUNDS = 4_096
MADE = ("weight_units", "block", "slot", "release", "deadline", "row_in_block")


def weight_units(weights: Mapping[str, float], resolution: int) -> dict[str, int]:
    """Whole units that sum to ``resolution``, one at least for each: largest remainders, ties by name."""
    total = math.fsum(weights.values()) or 1.0
    spare = resolution - len(weights)
    exact = {k: w / total * spare for k, w in weights.items()}
    units = {k: 1 + math.floor(x) for k, x in exact.items()}
    left = resolution - sum(units.values())
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[:left]:
        units[k] += 1
    return units


def exact_units(weights: Mapping[str, float]) -> dict[str, int] | None:
    """Whole units in exact proportion to positive weights as they are written, None where their sum is too large."""
    if not all(0 < w < math.inf for w in weights.values()):
        return None
    parts = {k: Fraction(str(w)) for k, w in weights.items()}
    whole = math.lcm(*(x.denominator for x in parts.values()))
    common = math.gcd(*(int(x * whole) for x in parts.values()))
    units = {k: int(x * whole) // common for k, x in parts.items()}
    return units if sum(units.values()) <= EXACT_UNITS else None


def round_kinds(blocks: list[int], units: list[int]) -> list[tuple[int, int, list[int]]]:
    """(first round, slots before it, blocks of each source in such a round)."""
    ends = {0}
    for n, a in zip(blocks, units, strict=True):
        ends |= {n // a, -(-n // a)}
    kinds = []
    for first in sorted(ends):
        share = [max(0, min(a, n - first * a)) for n, a in zip(blocks, units, strict=True)]
        if sum(share):
            kinds.append((first, sum(min(n, first * a) for n, a in zip(blocks, units, strict=True)), share))
    return kinds


def _windows(units: Column, share: Column) -> Column:
    """For each source, the release (``from``) and deadline (``due``) of each of its blocks in a round.

    After the fraction k / a of a round, a source of a units has had its first k blocks, and all
    sources together sum(min(a_j k / a, b_j)): no source gets more than the b_j blocks it has left.
    """

    def slots(k: Column, a: Column) -> Column:
        parts = F.transform(share, lambda b, j: F.least(F.get(units, j) * k, b * a))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda x, y: x + y)

    def of_source(b: Column, i: Column) -> Column:
        a = F.get(units, i)
        blocks = F.when(b > 0, F.sequence(F.lit(0), b - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.transform(blocks, lambda k: F.floor(slots(k, a) / a).cast("int")).alias("from"),
            F.transform(blocks, lambda k: F.ceil(slots(k + 1, a) / a).cast("int")).alias("due"),
        )

    return F.transform(share, of_source)


def _earliest_deadline_first(windows: Column, total: Column) -> Column:
    """The source of each slot of a round: of the released blocks, the one due first, ties by number."""

    def step(state: Column, t: Column) -> Column:
        def candidate(done: Column, i: Column) -> Column:
            w = F.get(windows, i)
            return F.when(F.get(w["from"], done) <= t, F.struct(F.get(w["due"], done).alias("due"), i.alias("i")))

        pick = F.array_min(F.transform(state["done"], candidate))["i"]
        return let(
            pick,
            lambda p: F.struct(
                F.transform(state["done"], lambda d, i: d + F.when(i == p, F.lit(1)).otherwise(F.lit(0))).alias("done"),
                F.concat(state["picks"], F.array(p)).alias("picks"),
            ),
        )

    start = F.struct(F.transform(windows, lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("picks"))
    return F.aggregate(F.sequence(F.lit(0), total - 1), start, step, lambda s: s["picks"])


def _slots(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source number, k) -> slot in the round, release and deadline, for rows of units, share and total."""
    table = table.withColumn("windows", _windows(F.col("units"), F.col("share")))
    picks = let(F.col("windows"), lambda w: _earliest_deadline_first(w, F.col("total")))
    slots = table.select(*keys, "windows", F.posexplode(picks).alias("at", "number"))
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "number").orderBy("at")) - 1)
    w = F.get("windows", F.col("number"))
    return slots.select(*keys, "number", "k", "at", F.get(w["from"], F.col("k")).alias("release"), F.get(w["due"], F.col("k")).alias("deadline"))


def round_schedule(spark: SparkSession, kinds: list[tuple[int, int, list[int]]], units: list[int]) -> DataFrame:
    """(kind, source number, k) -> slot in the round, release and deadline. At most kinds x units rows."""
    rows = [F.struct(F.lit(i).alias("kind"), F.array(*map(F.lit, x[2])).alias("share"), F.lit(sum(x[2])).alias("total")) for i, x in enumerate(kinds)]
    table = spark.range(1).select(F.inline(F.array(*rows))).repartition(len(kinds), "kind")
    return _slots(table.withColumn("units", F.array(*map(F.lit, units))), ["kind"])


def _total(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda x, y: x + y)


def component_blocks(members: DataFrame) -> DataFrame:
    """(item, block) -> slot, the place of the block in its component, for members (component, item, weight, blocks).

    Units are the nearest whole numbers of four for each member, one at least. There is a row for each block.
    """
    own = F.array_sort(F.collect_list(F.struct("item", "weight", "blocks")))
    table = members.groupBy("component").agg(own.alias("own"))
    size, weights = F.size("own"), F.transform("own", lambda x: x["weight"])
    all_weight = F.greatest(_total(weights, "double"), F.lit(1e-300))
    share_of = F.transform("own", lambda x: F.greatest(F.lit(1), F.floor(x["weight"] / F.col("all") * 4 * size + 0.5).cast("int")))
    table = table.withColumn("all", all_weight).withColumn("units", share_of)
    whole, begun = (F.expr(f"transform(own, (x, i) -> (x.blocks + {up}) div units[i])") for up in ("0", "units[i] - 1"))
    firsts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), whole, begun)))
    table = materialize(table.withColumn("firsts", firsts).drop("all"), "components")

    items = table.select("component", "units", F.posexplode("own").alias("number", "x"))
    items = items.select("component", "number", F.col("x.item").alias("item"), F.get("units", F.col("number")).alias("own_units"))
    kinds = table.select("component", "own", "units", "firsts", F.posexplode("firsts").alias("i", "first"))
    left = F.transform("own", lambda x, i: F.greatest(F.lit(0), F.least(F.get("units", i), x["blocks"] - F.col("first") * F.get("units", i))).cast("int"))
    past = F.transform("own", lambda x, i: F.least(x["blocks"], F.col("first") * F.get("units", i)))
    kinds = kinds.select(
        "component", "first", "units", left.alias("share"), _total(past, "long").alias("before"),
        (F.get("firsts", F.col("i") + 1) - F.col("first")).alias("rounds"),
    )
    kinds = kinds.withColumn("total", _total(F.col("share"), "int")).where("total > 0")
    kinds = kinds.repartition(8 * members.sparkSession.sparkContext.defaultParallelism, "component", "first")
    slots = _slots(kinds, ["component", "first", "before", "rounds", "total"])
    slots = join_checked(slots, items, ["component", "number"], "inner")
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1, F.lit(LISTED_ROUNDS).cast("long"))))
    slots = slots.withColumn("round", F.explode(F.sequence("part", F.least(F.col("part") + (LISTED_ROUNDS - 1), F.col("rounds") - 1))))
    block = (F.col("first") + F.col("round")) * F.col("own_units") + F.col("k")
    return slots.select("component", "item", block.alias("block"), (F.col("before") + F.col("round") * F.col("total") + F.col("at")).alias("slot"))


def with_components(items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Few enough items (item, weight, blocks), and the place of each block (source, block) in the component it is in.

    The second is None if there are few enough already; it holds nothing for items that stay.
    """
    placed, level = None, 0
    while (n := items.count()) > MOST_SOURCES:
        heavy = items.orderBy(F.desc("weight"), "item").limit(HEAVIEST)
        heavy = materialize(heavy, "heaviest")
        rest = join_checked(items, heavy.select("item"), ["item"], "left_anti")
        name = F.concat(F.lit(f"+{level}:"), F.pmod(F.xxhash64("item"), F.lit(-(-(n - HEAVIEST) // COMPONENT_SIZE))).cast("string"))
        members = materialize(rest.withColumn("component", name), "members")
        made = component_blocks(members)
        if placed is not None:
            deeper = made.select(F.col("item").alias("component"), F.col("block").alias("slot"), F.col("component").alias("over"), F.col("slot").alias("over_slot"))
            deeper = placed.join(deeper, ["component", "slot"], "left")
            seen = deeper.select(F.coalesce("over", "component").alias("component"), "item", "block", F.coalesce("over_slot", "slot").alias("slot"))
            # items that only now go into a component are sources that had stayed
            made = seen.union(made.where(~F.col("item").startswith("+")).select(seen.columns))
        placed = materialize(made, "places")
        weights = F.array_sort(F.collect_list("weight"))
        groups = members.groupBy("component").agg(_total(weights, "double").alias("weight"), F.sum("blocks").alias("blocks"))
        items = materialize(heavy.union(groups.select(F.col("component").alias("item"), "weight", "blocks")), "items")
        level += 1
    return items, placed


def _whole_units(sources: DataFrame, weights: Mapping[str, float] | None, resolution: int) -> DataFrame:
    """sources (item, weight, blocks) with ``units`` as ``exact_units`` or ``weight_units`` gives them, for any number of sources."""
    spark, m = sources.sparkSession, sources.count()
    if weights is not None and m <= EXACT_UNITS:
        exact = exact_units({x["item"]: x["weight"] for x in sources.select("item", "weight").collect()})
        if exact is not None:
            return sources.join(F.broadcast(spark.createDataFrame(list(exact.items()), "item string, units long")), "item")
    resolution = max(resolution, 4 * m)
    spare, alike = resolution - m, sources.groupBy("weight").count().collect()
    total = float(sum(Fraction(x["weight"]) * x["count"] for x in alike)) or 1.0  # as fsum rounds it
    left, by_rest = resolution, Counter()
    for x in alike:
        exact = x["weight"] / total * spare
        left -= x["count"] * (1 + math.floor(exact))
        by_rest[math.floor(exact) - exact] += x["count"]
    last, tied = -math.inf, 0
    for last, n in sorted(by_rest.items()):
        if left <= n:
            tied = left
            break
        left -= n
    exact = F.col("weight") / F.lit(total) * F.lit(float(spare))
    rest = F.floor(exact).cast("double") - exact
    out = sources.withColumn("units", F.floor(exact).cast("long") + 1 + F.when(rest < F.lit(last), 1).otherwise(0))
    if not tied:
        return out
    first = with_ordinal(sources.where(rest == F.lit(last)).select("item", F.lit(0).alias("one")), "one", F.array("item"))
    first = materialize(first.where(F.col("ordinal") <= tied).select("item", F.lit(1).alias("more")), "tied")
    return join_checked(out, first, ["item"], "left").withColumn("units", F.col("units") + F.coalesce("more", F.lit(0))).drop("more")


def _block_windows(shares: DataFrame) -> DataFrame:
    """(first, units, k) -> release and deadline in the round, from the shares (first, units, share) of all sources.

    After the fraction k / units of a round all sources together have had k / units of what takes part in all
    of the round, and of those that run out in it no more than their share.
    """
    ends = shares.where("share < units").groupBy("first", (F.col("share") / F.col("units")).alias("part"))
    ends = ends.agg(F.sum("share").alias("ended"), F.sum("units").alias("ended_units"))
    wholes = shares.groupBy("first").agg(F.sum("units").alias("all_units"))
    points = shares.select("first", "units").distinct().select("first", "units", F.explode(F.sequence(F.lit(0).cast("long"), "units")).alias("k"))
    points = points.withColumn("part", F.col("k") / F.col("units"))
    both = points.unionByName(ends, allowMissingColumns=True)
    so_far = Window.partitionBy("first").orderBy("part")
    both = both.withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in ("ended", "ended_units")}).where("k IS NOT NULL")
    slots = F.col("k") * (F.col("all_units") - F.col("ended_units")) + F.col("units") * F.col("ended")
    both = both.join(wholes, "first").withColumn("slots", slots)
    following = F.lead("slots").over(Window.partitionBy("first", "units").orderBy("k"))
    both = both.withColumn("following", following).where("following IS NOT NULL")
    return both.select("first", "units", "k", F.expr("slots div units").alias("release"), F.expr("(following + units - 1) div units").alias("deadline"))


def _halved(rows: DataFrame, height: int) -> DataFrame:
    """Groups of up to 2^height blocks and their slots as groups of half that size; places count the slots of a group.

    Of the blocks of the half that is due first, N are released up to a slot, and D = place + 1 + (the least of 0
    and of N - place - 1 so far) have had a slot by then, as in a queue that serves one at a time.
    """
    early = F.col("p").bitwiseAND(1 << (height - 1)) == 0
    upto = Window.partitionBy("first", "g").orderBy("x", "is_slot")
    rows = rows.withColumn("released", F.sum(F.when(early, 1).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.when(F.col("is_slot"), F.col("released") - F.col("x") - 1)
    before = F.least(F.lit(0).cast("long"), F.min("over").over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("over", over).withColumn("before", before)
    own = F.least("before", "over")
    taken = F.when(F.col("is_slot"), own == F.col("before")).otherwise(early)
    rows = rows.withColumn("own", own).withColumn("taken", taken)
    x = F.when(F.col("taken"), F.col("x") + F.col("own")).when(F.col("is_slot"), -F.col("own") - 1).otherwise(-F.col("own"))
    return rows.select("first", (F.col("g") * 2 + F.when(F.col("taken"), 0).otherwise(1)).alias("g"), x.alias("x"), "is_slot", "at", "p", "block")


def _placed(jobs: DataFrame, most: int) -> DataFrame:
    """jobs (first, item, k, release, deadline) with ``at``, their slots by earliest deadline first; a round has ``most`` at most."""
    order = F.array(F.lpad(F.col("deadline").cast("string"), 20, "0"), F.col("item"))
    jobs = running(jobs, "first", order, {"p": F.lit(1).cast("long")}).withColumn("p", F.col("p") - 1)
    jobs = materialize(jobs, "deadlines")
    block = F.struct("item", "k", "release", "deadline")
    rows = jobs.select("first", F.lit(0).cast("long").alias("g"), F.col("release").alias("x"), F.lit(False).alias("is_slot"), F.lit(None).cast("long").alias("at"), "p", block.alias("block"))
    slots = jobs.select("first", F.lit(0).cast("long").alias("g"), F.col("p").alias("x"), F.lit(True).alias("is_slot"), F.col("p").alias("at"), F.lit(None).cast("long").alias("p"), F.lit(None).cast(rows.schema["block"].dataType).alias("block"))
    rows = rows.union(slots)
    for height in range((most - 1).bit_length(), (LEAF - 1).bit_length(), -1):
        rows = _halved(rows, height)

    def step(state: Column, job: Column) -> Column:
        free = F.bitwise_not(state["taken"]).bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), job["x"].cast("int")))
        return let(free.bitwiseAND(-free), lambda low: F.struct((state["taken"] + low).alias("taken"), F.concat(state["picks"], F.array(F.bit_count(low - 1))).alias("picks")))

    own = F.sort_array(F.collect_list(F.when(~F.col("is_slot"), F.struct("p", "x", "block"))))
    at = F.sort_array(F.collect_list(F.when(F.col("is_slot"), F.struct("x", "at"))))
    leaves = rows.groupBy("first", "g").agg(own.alias("own"), at.alias("slots"))
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.array().cast("array<int>").alias("picks"))
    leaves = leaves.withColumn("picks", F.aggregate("own", start, step, lambda s: s["picks"]))
    leaves = leaves.select("first", "slots", "picks", F.posexplode("own").alias("i", "job"))
    return leaves.select("first", "job.block.*", F.get("slots", F.get("picks", F.col("i")))["at"].alias("at"))


def wide_schedule(sources: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(first, item, k) -> slot in the round, release and deadline, for sources (item, units, blocks); and (first round, slots before it, slots of such a round).

    It has no more rows than there are blocks, as each kind of round occurs.
    """
    ends = sources.select(F.explode(F.expr("array(0L, blocks div units, (blocks + units - 1) div units)")).alias("first")).distinct()
    ends = sorted(x["first"] for x in ends.collect())
    shares = sources.select("item", "units", "blocks", F.explode(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda x: x * F.col("units") < F.col("blocks"))).alias("first"))
    shares = shares.select("first", "item", "units", F.least(F.col("units"), F.col("blocks") - F.col("first") * F.col("units")).alias("share"))
    shares = materialize(shares, "shares")
    totals = {x["first"]: x["total"] for x in shares.groupBy("first").agg(F.sum("share").alias("total")).collect()}
    kinds, before = [], 0
    for first, after in zip(ends, [*ends[1:], None], strict=True):
        if first in totals:
            kinds.append((first, before, totals[first]))
            before += totals[first] * (after - first)
    windows = materialize(_block_windows(shares), "windows")
    jobs = shares.select("first", "item", "units", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1)).alias("k"))
    jobs = join_checked(jobs, windows, ["first", "units", "k"], "inner").select("first", "item", "k", "release", "deadline")
    return materialize(_placed(jobs, max(totals.values())), "schedule"), kinds


def _number_below(values: list[int], x: Column) -> Column:
    """How many of the ascending values are not above x, by bisection."""
    at = F.array(*[F.lit(v).cast("long") for v in values])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(values).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(at, low + step - 1) <= x, low + step).otherwise(low))


def _mixed_wide(out: DataFrame, sources: DataFrame, item: str, made: list[str]) -> DataFrame:
    """Rows with ``block`` and the schedule of (item, units, blocks): the columns of MADE beside ``made``, which are kept."""
    a, c, kind, k, at, release, deadline = (free_name(out, x) for x in ("units_", "round_", "kind_", "k_", "at_", "release_", "deadline_"))
    plan, kinds = wide_schedule(sources)
    firsts, past, length = zip(*kinds, strict=True)
    out = join_checked(out, sources.select(F.col("item").alias(item), F.col("units").alias(a)), [item], "inner")
    out = out.withColumn(c, F.expr(f"block div {a}")).withColumn(k, F.expr(f"block % {a}"))
    out = out.withColumn(kind, _number_below(list(firsts), F.col(c)) - 1)
    of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col(kind))
    start = of(past) + (F.col(c) - of(firsts)) * of(length)
    out = out.withColumn(c, start).withColumn(kind, of(firsts))
    plan = plan.select(*[F.col(x).alias(y) for x, y in (("first", kind), ("item", item), ("k", k), ("at", at), ("release", release), ("deadline", deadline))])
    out = join_checked(out, plan, [kind, item, k], "inner")
    return out.select(*made, F.col(a).cast("int").alias("weight_units"), "block", *[(F.col(c) + F.col(x)).alias(y) for x, y in ((at, "slot"), (release, "release"), (deadline, "deadline"))], "row_in_block")


def mix_sources(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    key: str = "doc_id",
    source: str = "source",
    block_rows: int = 8,
    resolution: int = 512,
    seed: int = 0,
    tie: tuple[str, ...] = (),
    components: bool = False,
) -> DataFrame:
    """df with the columns of MADE; ordering by (slot, row_in_block) gives the mixture.

    ``weights`` maps sources to positive numbers; sources that it lacks have weight 0 (one unit).
    None weighs each source by the square root of its rows. ``resolution`` is raised to four times
    the number of sources where that is more; weights that ``exact_units`` can meet are not rounded to it.
    release and deadline count slots from the start of the whole schedule, as slot does. ``block`` is the
    number of a row's block in its source; where ``components`` puts sources into components, weight_units, release and
    deadline are those of the component.
    """
    df = df.drop(*MADE)
    spark = df.sparkSession
    s, h, r = (free_name(df, x) for x in ("stratum_", "hash_", "rank_"))
    out = df.withColumn(s, stratum(F.col(source)))
    weight = F.sqrt("n")
    if weights is not None:
        of = F.from_json(F.lit(json.dumps({"" if k is None else f"={k}": float(w) for k, w in weights.items()})), "map<string,double>")
        weight = F.coalesce(F.element_at(of, F.col("item")), F.lit(0.0))
    counted = out.groupBy(F.col(s).alias("item")).agg(F.count("*").alias("n"))
    counted = materialize(counted.select("item", "n", weight.alias("weight"), F.expr(f"(n + {block_rows - 1}) div {block_rows}L").alias("blocks")), "sources")
    n_rows = counted.agg(F.sum("n")).first()[0]
    if not n_rows:
        typed = {"weight_units": "int", "row_in_block": "int"}
        return df.withColumns({c: F.lit(None).cast(typed.get(c, "long")) for c in MADE})
    hashed = out.withColumn(h, shuffle_key(seed, key, df))
    out = with_rank(hashed, r, [s], hex_bucket(F.col(h), bucket_count(n_rows)), [h, *tie])
    out = out.withColumn("block", F.expr(f"{r} div {block_rows}L")).withColumn("row_in_block", F.expr(f"cast({r} % {block_rows}L as int)"))
    items, placed = counted.select("item", "weight", "blocks"), None
    if components:
        items, placed = with_components(items)
    elif items.count() > MOST_SOURCES:
        return _mixed_wide(out, materialize(_whole_units(items, weights, resolution), "units"), s, df.columns)
    found = {x["item"]: x for x in items.collect()}  # MOST_SOURCES at most
    names = sorted(found)
    given = {k: found[k]["weight"] for k in names}
    units = (exact_units(given) if weights is not None else None) or weight_units(given, max(resolution, 4 * len(names)))
    kinds = round_kinds([found[k]["blocks"] for k in names], [units[k] for k in names])

    number = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, range(len(names)))))
    a, i, c, kind = (free_name(df, x) for x in ("units_", "number_", "round_", "kind_"))
    item, b = s, "block"
    if placed is not None:
        item, b = free_name(df, "item_"), free_name(df, "place_")
        placed = placed.select(F.col("component").alias(item), F.col("item").alias(s), "block", F.col("slot").alias(b))
        out = join_checked(out, placed, [s, "block"], "left")
        out = out.withColumn(item, F.coalesce(item, s)).withColumn(b, F.coalesce(b, "block"))
    out = out.withColumn(i, F.element_at(number, F.col(item)))
    out = out.withColumn(a, F.get(F.array(*[F.lit(units[k]) for k in names]), F.col(i)))
    out = out.withColumn(c, F.expr(f"{b} div {a}"))
    firsts = F.array(*[F.lit(x[0]).cast("long") for x in kinds])
    out = out.withColumn(kind, F.size(F.filter(firsts, lambda x: x <= F.col(c))) - 1)

    plan = round_schedule(spark, kinds, [units[k] for k in names])
    k, at, release, deadline = (free_name(df, x) for x in ("k_", "at_", "release_", "deadline_"))
    plan = plan.select(*[F.col(x).alias(y) for x, y in (("kind", kind), ("number", i), ("k", k), ("at", at), ("release", release), ("deadline", deadline))])
    out = join_checked(out.withColumn(k, F.expr(f"cast({b} % {a} as int)")), plan, [kind, i, k], "inner")
    before, length = (F.get(F.array(*[F.lit(v).cast("long") for v in x]), F.col(kind)) for x in ([x[1] for x in kinds], [sum(x[2]) for x in kinds]))
    start = before + (F.col(c) - F.get(firsts, F.col(kind))) * length
    return out.select(
        *df.columns,
        F.col(a).alias("weight_units"), "block",
        (start + F.col(at)).alias("slot"), (start + F.col(release)).alias("release"), (start + F.col(deadline)).alias("deadline"),
        "row_in_block",
    )
