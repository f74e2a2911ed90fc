"""Derived work as edge tables: the summary pyramid, readiness, scores, fingerprints, staleness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import sha_head
from cuelake.operators.ordered import ordinal, running_sum
from cuelake.session import cut, cut_counted

# ---- fixed values -------------------------------------------------------------------------------
KIND_BASE = {"leaf": 3.0, "node": 2.0, "terms": 1.5, "dive": 1.0, "focus": 0.5, "probe": 0.45}
TIER_STEP = 1 / 32
EXPORT_EDGE = 1 / 4
LIFT_PASSES = 32
HEAT_KEEP = 0.5
SEARCH_HEAT = 2.0
OPEN_HEAT = 0.5
COLD_FLOOR = 1e-6
# -------------------------------------------------------------------------------------------------

FOLD_BITS = 6  # tiers folded per shuffle


def unique_sources(videos: DataFrame) -> DataFrame:
    """One leaf per subtitle however many entries share it, at its first position: (id, first_seq, pos)."""
    first = videos.groupBy(F.col("srt_id").alias("id")).agg(F.min("seq").alias("first_seq"))
    return ordinal(first, [], ["first_seq"], "n").select("id", "first_seq", (F.col("n") - 1).alias("pos"))


def append_videos(playlist: DataFrame, incoming: DataFrame) -> DataFrame:
    """New videos join at the end unless their id is listed; existing rows are untouched."""
    fresh = incoming.groupBy("video_id").agg(F.min(F.struct("seq", "path")).alias("f")).select("video_id", "f.*")
    fresh = fresh.join(playlist, "video_id", "left_anti")
    end = playlist.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("end"))  # one row
    placed = ordinal(fresh, [], ["seq"], "n").join(F.broadcast(end))
    return playlist.select("video_id", "seq", "path").unionByName(
        placed.select("video_id", (F.col("end") + F.col("n")).alias("seq"), "path"))


def pyramid(leaves: DataFrame) -> DataFrame:
    """Pairwise summary tree over (id, pos): (tier, j, first_pos, upto_pos, left_tier, left_j, right_tier, right_j).

    Closed form: the leaf at position p > 0 is the middle of exactly one node, whose tier is one above
    the number of trailing zero bits of p.  So every leaf writes its own node and nothing is shuffled.
    An odd tail is carried up unchanged: the right child is whatever node or leaf covers the rest.
    Node (t, j) covers the leaves from j * 2^t.
    """
    total = leaves.agg((F.max("pos") + 1).alias("n"))  # one row
    p = F.col("pos")
    tier = F.bit_count((p.bitwiseAND(-p)) - 1) + 1
    rows = leaves.where("pos > 0").select(p.alias("mid"), tier.cast("int").alias("tier")).join(F.broadcast(total))
    rows = rows.withColumn("j", F.expr("shiftright(mid, tier)"))
    rows = rows.withColumn("first_pos", F.expr("shiftleft(j, tier)"))
    rows = rows.withColumn("upto_pos", F.least(F.expr("shiftleft(j + 1, tier)"), F.col("n")))
    rest = F.col("upto_pos") - F.col("mid")
    rows = rows.withColumn("right_tier", F.ceil(F.log2(rest.cast("double"))).cast("int"))
    return rows.select(
        "tier", "j", "first_pos", "upto_pos", (F.col("tier") - 1).alias("left_tier"), (F.col("j") * 2).alias("left_j"),
        "right_tier", F.expr("shiftright(mid, right_tier)").alias("right_j"))


def tree_id(left: Column, right: Column) -> Column:
    return sha_head(F.concat(F.lit("tree"), left, right))


def fold_pyramid(leaves: DataFrame, value: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Any pairwise combination bottom-up: (tier, j, value, left_value, right_value), leaves as tier 0.

    For combinations that need their children's results (content ids, merged summaries).  A stage
    groups 64 neighbours into one row and folds six tiers inside it, so a billion leaves take five
    shuffles; the stages' results are cut into the shared checkpoint folder.
    """
    leaves = cut(leaves)
    top = leaves.agg(F.max("pos")).first()[0]  # one number
    null = F.lit(None).cast(leaves.schema[value].dataType)
    level = leaves.select(F.col("pos").alias("j"), value)
    out = level.select(F.lit(0).alias("tier"), "j", value, null.alias("left_value"), null.alias("right_value"))
    base, width = 0, (top or 0) + 1
    while width > 1:
        rows = level.groupBy(F.shiftright("j", FOLD_BITS).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("j", value))).alias("items"))
        rows = rows.select("block", F.transform("items", lambda x: x[value]).alias("v0"))
        for k in range(FOLD_BITS):
            below, n = F.col(f"v{k}"), F.size(f"v{k}")
            ids = F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))
            paired = F.transform(ids, lambda i: F.struct(
                F.get(below, i * 2).alias("left_value"), F.get(below, i * 2 + 1).alias("right_value"),
                (i * 2 + 1 < n).alias("paired")))
            rows = rows.withColumn(f"p{k}", paired)
            rows = rows.withColumn(f"v{k + 1}", F.transform(f"p{k}", lambda p: F.when(
                p["paired"], combine(p["left_value"], p["right_value"])).otherwise(p["left_value"])))
        made = F.flatten(F.array(*[_paired_items(k, base) for k in range(FOLD_BITS)]))
        rows = cut(rows.select("block", F.filter(made, lambda x: x["paired"]).alias("made"), f"v{FOLD_BITS}"))
        out = out.unionByName(rows.select(F.explode("made").alias("m")).select(
            "m.tier", "m.j", F.col("m.value").alias(value), "m.left_value", "m.right_value"))
        level = rows.select(F.col("block").alias("j"), F.get(f"v{FOLD_BITS}", F.lit(0)).alias(value))
        base, width = base + FOLD_BITS, (width + (1 << FOLD_BITS) - 1) >> FOLD_BITS
    return out


def _paired_items(k: int, base: int) -> Column:
    """The nodes that tier ``k`` of a stage made, as structs."""
    return F.transform(f"p{k}", lambda p, i: F.struct(
        F.lit(base + k + 1).alias("tier"), (F.shiftleft("block", FOLD_BITS - 1 - k) + i).alias("j"),
        F.get(F.col(f"v{k + 1}"), i).alias("value"), p["left_value"].alias("left_value"),
        p["right_value"].alias("right_value"), p["paired"].alias("paired")))


def range_totals(leaves: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Sum of a leaf value under every node, from running sums: two look-ups per node, no tier loop."""
    upto = running_sum(leaves.select("pos", value), [], ["pos"], value, "__u").select("pos", "__u")
    high = upto.select((F.col("pos") + 1).alias("upto_pos"), F.col("__u").alias("__hi"))
    low = upto.select((F.col("pos") + 1).alias("first_pos"), F.col("__u").alias("__lo"))
    joined = nodes.join(high, "upto_pos").join(low, "first_pos", "left")
    return joined.withColumn(f"total_{value}", F.col("__hi") - F.coalesce("__lo", F.lit(0))).drop("__hi", "__lo")


def task_states(events: DataFrame) -> DataFrame:
    """Current state per (plan, id) from the event log (plan, id, op, seq).

    A reset forgets everything before it; adding a known id changes nothing; done and fail of an
    unknown id are remembered.
    """
    wiped = events.where("op = 'reset'").groupBy("plan").agg(F.max("seq").alias("__reset"))
    live = events.join(wiped, "plan", "left").where(
        (F.col("op") != "reset") & (F.col("__reset").isNull() | (F.col("seq") > F.col("__reset"))))
    state = (F.when(F.col("op") == "take", F.lit("running")).when(F.col("op") == "done", F.lit("done"))
             .when(F.col("op") == "fail", F.lit("parked")))
    return live.groupBy("plan", "id").agg(F.coalesce(
        F.max_by(state, F.when(state.isNotNull(), F.col("seq"))), F.lit("pending")).alias("state"))


def backlog(states: DataFrame) -> DataFrame:
    """Per plan the open tasks, all tasks, and the tasks in each state."""
    open_ = F.col("state").isin("pending", "running")
    by_state = [F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pending", "running", "done", "parked")]
    return states.groupBy("plan").agg(F.count_if(open_).alias("backlog"), F.count("*").alias("n_tasks"), *by_state)


def ready_tasks(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are known and done."""
    states = tasks.select(F.col("id").alias("dep"), (F.col("state") == "done").alias("__done"))
    waiting = deps.join(states, "dep", "left").where(~F.coalesce("__done", F.lit(False))).select("id")
    return tasks.where("state = 'pending'").join(waiting, "id", "left_anti")


def own_score(tasks: DataFrame, heat: str = "heat") -> Column:
    base = F.create_map(*[F.lit(x) for kv in KIND_BASE.items() for x in kv])
    return (base[F.col("kind")] - F.lit(TIER_STEP) * F.col("tier")
            + F.when(F.col("exported"), F.lit(EXPORT_EDGE)).otherwise(F.lit(0.0)) + F.coalesce(heat, F.lit(0.0)))


def inherited_score(tasks: DataFrame, deps: DataFrame, passes: int = LIFT_PASSES) -> DataFrame:
    """Adds ``eff``: a pending task lifts each pending dependency to at least its own score, transitively.

    Only scores that rose travel on, and a pass that raises nothing ends the loop.  An edge carries the own scores of both
    its tasks and what rose is kept apart, so a pass reads the edges and writes no more than it raised.
    """
    pending = tasks.where("state = 'pending'").select("id", "own")
    edges = cut(deps.join(pending, "id").select("id", "dep", "own").join(
        pending.select(F.col("id").alias("dep"), F.col("own").alias("had")), "dep"))
    raised, handed = None, edges.select("dep", "had", F.col("own").alias("eff"))
    for n in range(1, passes + 1):
        offers = handed.where("eff > had").groupBy(F.col("dep").alias("id")).agg(F.max("eff").alias("eff"))
        if raised is not None:
            offers = offers.join(_highest(raised, "__up"), "id", "left").where("__up is null or eff > __up").select("id", "eff")
        rising, seen = cut_counted(offers)
        if not seen.n:
            break
        raised = rising if raised is None else raised.unionByName(rising)
        if n % 16 == 0:
            raised = cut(_highest(raised, "eff"))
        handed = edges.select("id", "dep", "had").join(rising, "id")
    own = F.when(F.col("state") == "pending", F.col("own"))
    if raised is None:
        return tasks.withColumn("eff", own)
    return tasks.join(_highest(raised, "__up"), "id", "left").withColumn("eff", F.coalesce("__up", own)).drop("__up")


def _highest(raised: DataFrame, out: str) -> DataFrame:
    """The last score each task rose to."""
    return raised.groupBy("id").agg(F.max("eff").alias(out))


def ready_ranking(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """The backlog report: ready tasks by inherited score, own score, insertion (a distributed sort)."""
    scored = inherited_score(tasks, deps)
    return ready_tasks(scored, deps).orderBy(F.desc("eff"), F.desc("own"), "seq")


def search_heat(tallies: DataFrame, changes: DataFrame, opens: DataFrame) -> DataFrame:
    """Interest per video after all pattern changes: (video_id, heat).

    Every change halves what is there and adds twice the video's share of the pattern's matches;
    opening a video adds a half.  In closed form each contribution fades by its distance to the last
    change, so the changes only need counting per pattern.  ``tallies`` is (pattern, video_id,
    n_matches), ``changes`` (n, pattern) with n from 1, ``opens`` (n, video_id) with n changes before.
    """
    last = changes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("__last"))  # one row
    fade = F.pow(F.lit(HEAT_KEEP), (F.col("__last") - F.col("n")).cast("double"))
    weight = changes.join(F.broadcast(last)).groupBy("pattern").agg(F.sum(fade).alias("weight"))
    totals = tallies.groupBy("pattern").agg(F.sum("n_matches").alias("total"))
    shares = tallies.join(totals, "pattern").join(weight, "pattern").where("n_matches > 0")
    searched = shares.select("video_id", (F.lit(SEARCH_HEAT) * F.col("n_matches") / F.col("total") * F.col("weight")).alias("h"))
    opened = opens.join(F.broadcast(last)).select("video_id", (F.lit(OPEN_HEAT) * fade).alias("h"))
    heat = searched.unionByName(opened).groupBy("video_id").agg(F.sum("h").alias("heat"))
    return heat.where(F.col("heat") >= COLD_FLOOR)


# ---- artifacts ----------------------------------------------------------------------------------

def content_chain(tasks: DataFrame, deps: DataFrame, artifacts: DataFrame, hash_fn=sha_head) -> DataFrame:
    """Fingerprint per task: (id, kind, suffix); NULL where an input, a dependency or its artifact is missing.

    ``tasks`` is (id, kind, witness), ``deps`` (id, ord, dep), ``artifacts`` (plan_id, bytes_hash).  One
    round per dependency depth: a task joins once all its dependencies have a fingerprint and bytes.
    Pairs (focus, probe) sort their dependencies.  A task's dependency list is bounded: two for nodes
    and pairs, the sections of one excerpt for dives.
    """
    facts = artifacts.select(F.col("plan_id").alias("id"), "bytes_hash")
    leaves = tasks.where("kind = 'leaf'").where("witness is not null").select("id", hash_fn(F.concat(F.lit("leaf"), "witness")).alias("suffix"))
    others = tasks.where("kind <> 'leaf'").select("id", "kind")
    pair = F.col("kind").isin("focus", "probe")
    key = F.when(pair, F.col("dep")).otherwise(F.lpad(F.col("ord").cast("string"), 20, "0"))
    wanted = deps.join(others, "id").select("id", "kind", "dep", key.alias("k"))
    counts = wanted.groupBy("id").agg(F.count("*").alias("n"))
    wanted = cut(wanted.join(counts, "id"))

    def whole(met: DataFrame) -> DataFrame:
        """Tasks that have met all their dependencies, with their fingerprints."""
        grouped = met.groupBy("id", "kind", "n").agg(F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("k", "v"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: p["v"]), "")
        return grouped.where("m = n").select("id", hash_fn(F.concat("kind", "id", joined)).alias("suffix"))

    # A level is one job: what its tasks with a new fingerprint hand to their dependents.  Only dependents that were
    # handed something are looked at again, with all that they have met.
    ready, met, level = leaves, None, 0
    while True:
        fresh = ready.join(facts, "id").select(F.col("id").alias("dep"), F.concat("suffix", "bytes_hash").alias("v"))
        new, seen = cut_counted(wanted.join(fresh, "dep").select("id", "kind", "n", "k", "v"))
        if not seen.n:
            break
        level += 1
        met = new if met is None else met.unionByName(new)
        if level % 16 == 0:
            met = cut(met)
        ready = whole(met.join(new.select("id").distinct(), "id", "left_semi"))
    done = leaves if met is None else leaves.unionByName(whole(met))
    return tasks.select("id", "kind").join(done, "id", "left")


def artifact_name(task_id: Column, kind: Column, suffix: Column) -> Column:
    return F.when(kind == "terms", F.concat(task_id, F.lit(".txt"))).when(
        suffix.isNotNull(), F.concat(task_id, F.lit("."), suffix, F.lit(".txt")))


def staleness_report(chain: DataFrame, listing: DataFrame) -> DataFrame:
    """Per task: hit, adopt (single-part name), content (another suffix), or miss; and the file it means.

    ``listing`` is (plan_id, kind, file_name).
    """
    expected = chain.withColumn("target", artifact_name(F.col("id"), F.col("kind"), F.col("suffix")))
    files = listing.select(F.col("plan_id").alias("id"), "kind", "file_name")
    joined = expected.join(files, ["id", "kind"], "left")
    seen = joined.groupBy("id", "kind", "target").agg(
        F.bool_or(F.col("file_name") == F.col("target")).alias("present"), F.min("file_name").alias("first_name"))
    verdict = (
        F.when(F.coalesce("present", F.lit(False)), F.lit("hit"))
        .when((F.col("kind") == "terms") | F.col("target").isNull() | F.col("first_name").isNull(), F.lit("miss"))
        .when(F.col("first_name") == F.concat("id", F.lit(".txt")), F.lit("adopt")).otherwise(F.lit("content")))
    return seen.select("id", "kind", "target", verdict.alias("verdict"), F.when(
        verdict == "hit", F.col("target")).when(verdict != "miss", F.col("first_name")).alias("file_name"))


def retention_sweep(placed: DataFrame, listing: DataFrame) -> DataFrame:
    """Files to drop once (id, kind, target) is placed: every other file of the same plan id and kind."""
    plan = placed.where("target is not null").select(F.col("id").alias("plan_id"), "kind", "target")
    return listing.join(plan, ["plan_id", "kind"]).where("file_name <> target").select("plan_id", "kind", "file_name")


def invalidate_descendants(changed: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks whose fingerprint moves when the given ids change: (id, depth)."""
    edges = cut(deps.select("id", "dep").distinct())
    reached = frontier = cut(changed.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        frontier, seen = cut_counted(
            edges.join(frontier.select(F.col("id").alias("dep")), "dep", "left_semi").select("id").distinct()
            .join(reached, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not seen.n:
            return reached
        reached = reached.unionByName(frontier)
        if depth % 16 == 0:
            reached = cut(reached)


def locate_any(listing: DataFrame) -> DataFrame:
    """Best effort: the first file of a plan id and kind, verified against nothing."""
    return listing.groupBy("plan_id", "kind").agg(F.min("file_name").alias("file_name"))


def todo_anti(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose artifact does not exist yet, each once."""
    return wanted.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti")
