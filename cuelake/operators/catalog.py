"""The topic catalogue: references, expansion, export plan, branch algebra, growth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from cuelake.functions import patterns
from cuelake.operators.ordered import RANGES, ordinal, running_sum
from cuelake.session import cut, cut_counted

REFERENCE = _REF = patterns.REFERENCE
_MARK = "\u0000"


def references(topics: DataFrame, scope: list[str] = []) -> DataFrame:
    """Edges (scope, name, ref, ord, fragment): one row per reference in a fragment."""
    frags = topics.select(*scope, "name", F.posexplode("fragments").alias("ord", "fragment"))
    return frags.select(*scope, "name", "ord", "fragment",
                        F.explode(F.regexp_extract_all("fragment", F.lit(_REF), F.lit(1))).alias("ref"))


def closure(edges: DataFrame, keys: list[str], src: str, dst: str) -> DataFrame:
    """All (src, dst) reachable pairs with the shortest depth; ends when a level adds nothing.

    Each level is cut into the shared checkpoint folder, so neither lineage nor plan grows.
    """
    step = edges.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    step = cut(step)
    reach = frontier = step.withColumn("depth", F.lit(1))
    hop = step.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("__far"))
    depth = 1
    while True:
        depth += 1
        frontier, seen = cut_counted(
            frontier.select(*keys, "src", "dst").join(hop, [*keys, "dst"])
            .select(*keys, "src", F.col("__far").alias("dst")).distinct()
            .join(reach, [*keys, "src", "dst"], "left_anti")
            .withColumn("depth", F.lit(depth)))
        if not seen.n:
            break
        reach = reach.unionByName(frontier)
        if depth % 16 == 0:
            reach = cut(reach)
    return reach.select(*keys, F.col("src").alias(src), F.col("dst").alias(dst), "depth")


def topic_closure(topics: DataFrame, scope: list[str] = []) -> DataFrame:
    """Transitive references with depth; ``cyclic`` marks topics that reach themselves."""
    reach = closure(references(topics, scope), scope, "name", "ref")
    return reach.withColumn("cyclic", F.col("name") == F.col("ref"))


def _pieces(body: Column) -> Column:
    """Body cut at its references: even elements are text, odd ones are names."""
    return F.split(F.regexp_replace(body, _REF, _MARK + "$1" + _MARK), _MARK)


def expand_topics(topics: DataFrame, scope: list[str] = []) -> DataFrame:
    """Every reference replaced by ``(?:expansion)``: (scope, seq, name, pattern).

    A round puts the current bodies into each other, so n rounds resolve 2^n levels; rounds end when no
    reference is left.  Topics that reach a cycle or an unknown name keep no pattern (NULL).
    """
    bodies = topics.select(*scope, "seq", "name", F.array_join("fragments", "").alias("pattern"))
    edges = references(topics, scope)
    reach = closure(edges, scope, "name", "ref")
    unknown = edges.join(topics.select(*scope, F.col("name").alias("ref")), [*scope, "ref"], "left_anti")
    bad_names = (reach.where("name = ref").select(*scope, "name")
                 .union(unknown.select(*scope, "name"))).distinct()
    tainted = bad_names.union(
        reach.join(bad_names.withColumnRenamed("name", "ref"), [*scope, "ref"], "left_semi")
        .select(*scope, "name")).distinct()
    open_ = F.count_if(F.col("pattern").rlike(_REF)).alias("open")
    good, seen = cut_counted(bodies.join(tainted, [*scope, "name"], "left_anti"), open_)
    while seen.open:
        parts = good.select(*scope, "seq", "name", F.posexplode(_pieces(F.col("pattern"))).alias("pos", "piece"))
        target = good.select(*scope, F.col("name").alias("piece"), F.col("pattern").alias("__body"),
                             F.lit(1).alias("__odd"))
        filled = (
            parts.withColumn("__odd", F.col("pos") % 2).join(target, [*scope, "piece", "__odd"], "left")
            .withColumn("text", F.when(F.col("__odd") == 1, F.concat(F.lit("(?:"), "__body", F.lit(")")))
                        .otherwise(F.col("piece"))))
        good, seen = cut_counted(filled.groupBy(*scope, "seq", "name").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                     lambda p: p["text"]), "").alias("pattern")), open_)
    lost = bodies.join(tainted, [*scope, "name"], "left_semi").withColumn("pattern", F.lit(None).cast("string"))
    return good.unionByName(lost)


def components(topics: DataFrame, scope: list[str] = []) -> DataFrame:
    """Topics that another topic references."""
    used = references(topics, scope).select(*scope, F.col("ref").alias("name")).distinct()
    return topics.join(used, [*scope, "name"], "left_semi")


def _branch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for rec in batch.to_dict("records"):
            key = {k: v for k, v in rec.items() if k != "body"}
            for no, (text, part) in enumerate(patterns.export_branches(rec["body"])):
                rows.append({**key, "branch_no": no, "branch": text, "part": part})
        if rows:
            yield pd.DataFrame(rows)


def export_plan(topics: DataFrame) -> DataFrame:
    """Groupings to scan: (seq, name, pattern, parts ARRAY<STRUCT<part, group_idx>>).

    A top-level branch that is one capture group around one reference becomes a named group and
    acknowledges that component; ``group_idx`` is the group's ordinal among all capture groups.
    """
    whole = expand_topics(topics)
    heads = topics.join(components(topics), "name", "left_anti").withColumn("body", F.array_join("fragments", ""))
    heads = heads.join(whole.where("pattern is not null").select("name"), "name", "left_semi")
    rows = heads.select("seq", "name", "body").mapInPandas(
        _branch_rows, "seq INT, name STRING, branch_no INT, branch STRING, part STRING")
    # The branch texts expand like topics of their own.
    as_topics = rows.select(
        "seq", F.col("name").alias("owner"), "branch_no", "part",
        F.when(F.col("part").isNotNull(), F.expr("substring(branch, 2, length(branch) - 2)"))
        .otherwise(F.col("branch")).alias("body"))
    filled = as_topics.select("*", F.posexplode(_pieces(F.col("body"))).alias("pos", "piece"))
    bodies = whole.select(F.col("name").alias("piece"), F.col("pattern").alias("__body"), F.lit(1).alias("__odd"))
    filled = filled.withColumn("__odd", F.col("pos") % 2).join(bodies, ["piece", "__odd"], "left").withColumn(
        "text", F.when(F.col("__odd") == 1, F.concat(F.lit("(?:"), "__body", F.lit(")"))).otherwise(F.col("piece")))
    branch = filled.groupBy("seq", "owner", "branch_no", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                 lambda p: p["text"]), "").alias("text"))
    return (branch.groupBy("seq", F.col("owner").alias("name"))
            .agg(F.array_sort(F.collect_list(F.struct("branch_no", "part", "text"))).alias("b"))
            .mapInPandas(_plan_rows, "seq INT, name STRING, pattern STRING, "
                                     "parts ARRAY<STRUCT<part: STRING, group_idx: INT>>"))


def _plan_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for rec in batch.to_dict("records"):
            texts, parts, groups = [], [], 0
            for item in rec["b"]:
                text = item["text"]
                if item["part"] is not None:
                    parts.append({"part": item["part"], "group_idx": groups + 1})
                    text = f"(?<g{len(parts) - 1}>{text})"
                groups += patterns.capture_count(text)
                texts.append(text)
            rows.append({"seq": rec["seq"], "name": rec["name"], "pattern": "|".join(texts), "parts": parts})
        if rows:
            yield pd.DataFrame(rows)


def machine_topics(topics: DataFrame) -> DataFrame:
    """Role by name: ``term<digits>`` index-only, ``focus<digits>`` supportive, the rest by hand."""
    name = F.col("name")
    return topics.withColumn("role", F.when(name.rlike("^term[0-9]+$"), F.lit("index"))
                             .when(name.rlike("^focus[0-9]+$"), F.lit("supportive")).otherwise(F.lit("main")))


def topics_exportable(topics: DataFrame) -> DataFrame:
    """Scans to run: groupings that are not index-only, then components as supportive scans."""
    plan = machine_topics(export_plan(topics))
    tops = plan.where("role <> 'index'").select(
        "name", "pattern", (F.col("role") == "main").alias("exported"), (F.col("role") != "main").alias("generated"))
    parts = expand_topics(topics).join(components(topics).select("name"), "name", "left_semi").select(
        "name", "pattern", F.lit(False).alias("exported"), F.lit(False).alias("generated"))
    return tops.unionByName(parts)


# ---- branch algebra -----------------------------------------------------------------------------

def pattern_branches(df: DataFrame, keys: list[str], pattern: str = "pattern") -> DataFrame:
    """Patterns to branch rows: (keys, branch_no, text, key, folds, opaque)."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec in batch.to_dict("records"):
                text = rec.pop("__pattern")
                folds, found = patterns.branches(text)
                opaque = found is None
                for no, b in enumerate([patterns.Branch(text, text)] if opaque else found):
                    rows.append({**rec, "branch_no": no, "text": b.text, "key": b.key,
                                 "folds": folds and not opaque, "opaque": opaque})
            if rows:
                yield pd.DataFrame(rows)

    return df.select(*keys, F.col(pattern).alias("__pattern")).mapInPandas(
        run, f"{schema}, branch_no INT, text STRING, key STRING, folds BOOLEAN, opaque BOOLEAN")


def normal_key(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Comparison key of each pattern: its distinct branch keys, sorted and joined."""
    return branches.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("key")), "|").alias("normal_key"))


def _rebuild(branches: DataFrame, keys: list[str], out: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch_no", "text"))),
                                    lambda b: b["text"]), "|")
    grouped = branches.groupBy(*keys, "folds").agg(body.alias("body"))
    return grouped.select(*keys, F.when(F.col("folds"), F.concat(F.lit("(?i:"), "body", F.lit(")")))
                          .otherwise(F.col("body")).alias(out))


def tidy(branches: DataFrame, keys: list[str]) -> DataFrame:
    """The pattern without wrappers and repeated branches (by key when folding, else by text)."""
    same = F.when(F.col("folds"), F.col("key")).otherwise(F.col("text"))
    kept = branches.groupBy(*keys, "folds", same.alias("__same")).agg(
        F.min(F.struct("branch_no", "text")).alias("b")).select(*keys, "folds", "b.*")
    return _rebuild(kept, keys, "tidied")


def corpus_keys(expanded: DataFrame) -> DataFrame:
    """Branch keys the catalogue covers."""
    return pattern_branches(expanded.where("pattern is not null"), ["name"]).select("key").distinct()


def hygienic(pattern: Column) -> Column:
    """Not empty, no edge blanks, no line break, no reference syntax."""
    return ((pattern != "") & ~pattern.rlike(r"^[ \t]|[ \t\r]$") & ~pattern.rlike(r"[\r\n]") & ~pattern.rlike(_REF))


def adopt_novel(incoming: DataFrame, covered: DataFrame) -> DataFrame:
    """Branches the catalogue lacks, first occurrence wins: (seq, pattern, rebuilt).

    ``incoming`` is (seq, pattern) in adoption order.  A branch that was adopted covers exactly its own key, so the
    sequential rule is a first-per-key aggregate, combined before the shuffle.  A rebuilt pattern that fails the hygiene
    rules is withdrawn, and its branches fall to the next pattern that offers them: the outcome is that of adopting one
    after the other.
    """
    rows = pattern_branches(incoming.where(F.col("pattern") != ""), ["seq"])
    fresh = cut(rows.join(covered.select("key"), "key", "left_anti").groupBy("seq", "key", "folds").agg(
        F.min(F.struct("branch_no", "text")).alias("b")).select("seq", "key", "folds", "b.*"))
    lost = _withdrawn(fresh)
    first = fresh.join(lost, "seq", "left_anti").groupBy("key").agg(F.min(F.struct("seq", "branch_no", "text", "folds")).alias("b")).select("b.*")
    return incoming.join(_rebuild(first, ["seq"], "rebuilt"), "seq")


def _withdrawn(rows: DataFrame) -> DataFrame:
    """(seq): the patterns that fail when their turn comes.

    A branch belongs to a pattern for certain once no earlier pattern that offers it can still be adopted, and cannot
    belong to it once an earlier one is sure to be adopted.  In a round every pattern is decided whose branches are all
    settled, or that will fail, or pass, whatever it is left with; rounds are as many as decisions really build on one
    another, and each is one job.
    """
    text = F.col("text")
    broken = text.rlike(r"[\r\n]") | text.rlike(_REF)  # fails wherever it stands
    rows = rows.select("seq", "key", "branch_no", "text", "folds", broken.alias("broken"), (
        broken | text.rlike(r"^[ \t]|[ \t\r]$|\\\{|:\}") | (text == "")).alias("risky"))
    status = rows.groupBy("seq").agg(F.when(F.bool_or("risky"), F.lit("open")).otherwise(F.lit("kept")).alias("status"))
    status, seen = cut_counted(status, F.count_if(F.col("status") == "open").alias("open"))
    while seen.open:
        live = rows.join(status.where("status <> 'lost'"), "seq")
        owners = live.groupBy("key").agg(F.min("seq").alias("any"), F.min(F.when(F.col("status") == "kept", F.col("seq"))).alias("firm"))
        mine = live.where("status = 'open'").join(owners, "key").where(F.col("firm").isNull() | (F.col("seq") < F.col("firm")))
        mine = mine.withColumn("sure", F.col("any") == F.col("seq"))
        part = F.struct("branch_no", "text", "sure", "folds")
        judged = mine.groupBy("seq").agg(
            F.bool_and("sure").alias("settled"), F.bool_or(F.col("sure") & F.col("broken")).alias("broken"), F.bool_or("risky").alias("risky"),
            F.min(part).alias("head"), F.max(part).alias("tail"), F.array_sort(F.collect_list(part)).alias("parts"))
        edge = ((F.col("head.sure") & F.col("head.text").rlike(r"^[ \t]") & ~F.col("head.folds"))
                | (F.col("tail.sure") & F.col("tail.text").rlike(r"[ \t\r]$") & ~F.col("tail.folds")))
        body = F.array_join(F.transform("parts", lambda p: p["text"]), "|")
        whole = F.when(F.col("head.folds"), F.concat(F.lit("(?i:"), body, F.lit(")"))).otherwise(body)
        verdict = (F.when(F.col("broken") | edge, F.lit("lost")).when(F.col("settled"), F.when(hygienic(whole), F.lit("kept")).otherwise(F.lit("lost")))
                   .when(~F.col("risky"), F.lit("kept")))
        judged = judged.select("seq", verdict.alias("now"), F.lit(True).alias("met"))
        # An open pattern that is left without a branch is not there any more, and takes nothing from others.
        status = status.join(judged, "seq", "left").select("seq", F.when(F.col("status") != "open", F.col("status")).when(
            F.col("met").isNull(), F.lit("kept")).otherwise(F.coalesce("now", F.lit("open"))).alias("status"))
        status, seen = cut_counted(status, F.count_if(F.col("status") == "open").alias("open"))
    return status.where("status = 'lost'").select("seq")


def free_numbers(adopted: DataFrame, order: str, taken: DataFrame, stem: str, ties: list[Column] = []) -> DataFrame:
    """Names ``stem<n>`` with the lowest free numbers, in adoption order.

    The k-th new name takes k plus the number of taken numbers that leave fewer than k free below.
    """
    used = taken.where(F.col("name").rlike(f"^{stem}[1-9][0-9]*$")).select(
        F.expr(f"cast(substring(name, {len(stem) + 1}) as bigint)").alias("n")).distinct()
    used = ordinal(used, [], ["n"], "__j", RANGES).select((F.col("n") - F.col("__j")).alias("__at"), F.lit(1).alias("__kind"),
                                                  F.lit(1).cast("bigint").alias("__one"))
    names = [f"__tie{i}" for i in range(len(ties))]
    ranked = ordinal(adopted.withColumns(dict(zip(names, ties))) if ties else adopted, [], [order, *names], "__k", RANGES).drop(*names)
    marks = ranked.select(F.col("__k").alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__one"))
    counted = running_sum(marks.unionByName(used), [], ["__at", "__kind"], "__one", "__taken", RANGES)
    numbers = counted.where("__kind = 0").select(F.col("__at").alias("__k"), "__taken")
    return (ranked.join(numbers, "__k")
            .withColumn("name", F.concat(F.lit(stem), (F.col("__k") + F.col("__taken")).cast("string")))
            .drop("__k", "__taken"))


def adopt(incoming: DataFrame, expanded: DataFrame, stem: str = "search") -> DataFrame:
    """Whole patterns joining the catalogue: (seq, pattern, name) of the accepted ones."""
    clean = incoming.where(hygienic(F.col("pattern")))
    keyed = clean.join(normal_key(pattern_branches(clean, ["seq"]), ["seq"]), "seq")
    known = normal_key(pattern_branches(expanded.where("pattern is not null"), ["name"]), ["name"])
    fresh = keyed.join(known.select("normal_key").distinct(), "normal_key", "left_anti")
    first = fresh.groupBy("normal_key").agg(F.min(F.struct("seq", "pattern")).alias("f")).select("f.*")
    return free_numbers(cut(first), "seq", expanded, stem)  # read for its size, its ranges and its rows


def cover_of(incoming: DataFrame, expanded: DataFrame, stem: str) -> DataFrame:
    """Per pattern the stem topic that covers most of its branches; the earliest wins a tie."""
    owners = expanded.where(F.col("pattern").isNotNull() & F.col("name").rlike(f"^{stem}[0-9]+$"))
    held = pattern_branches(owners, ["seq", "name"]).where("not opaque").select(
        F.col("seq").alias("owner_seq"), "name", "key").distinct()
    wanted = pattern_branches(incoming, ["seq"]).where("not opaque")
    counts = wanted.join(held, "key").groupBy("seq", "owner_seq", "name").agg(F.count("*").alias("n_covered"))
    best = counts.groupBy("seq").agg(F.max_by(F.struct("name", "n_covered"),
                                              F.struct(F.col("n_covered"), -F.col("owner_seq"))).alias("b"))
    return best.select("seq", F.col("b.name").alias("owner"), F.col("b.n_covered").alias("n_covered"))


def extend(requests: DataFrame, topics: DataFrame, covered: DataFrame) -> DataFrame:
    """Novel branches grow a single-fragment, reference-free topic of the same case context.

    ``requests`` is (seq, name, pattern).  Result: (name, pattern, grown) for topics that grew.
    """
    target = topics.where((F.size("fragments") == 1) & ~F.get("fragments", F.lit(0)).rlike(_REF)).select(
        "name", F.get("fragments", F.lit(0)).alias("pattern"))
    base = pattern_branches(target, ["name", "pattern"]).where("not opaque").select(
        "name", F.col("folds").alias("own_folds"), "pattern").distinct()
    clean = requests.where(hygienic(F.col("pattern")))
    rows = pattern_branches(clean, ["seq", "name"]).where("not opaque").join(base, "name")
    rows = rows.where("folds = own_folds").join(covered, "key", "left_anti")
    first = rows.groupBy("key").agg(F.min(F.struct("seq", "branch_no", "text", "name")).alias("b")).select("b.*")
    added = first.groupBy("name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "branch_no", "text"))), lambda b: b["text"]), "|").alias("added"))
    return base.join(added, "name").select(
        "name", "pattern",
        F.when(F.col("own_folds"), F.concat(F.lit("(?i:"), inner_pattern(F.col("pattern")), F.lit("|"), "added", F.lit(")")))
        .otherwise(F.concat(inner_pattern(F.col("pattern")), F.lit("|"), "added")).alias("grown"))


@F.pandas_udf(StringType())
def inner_pattern(pattern: pd.Series) -> pd.Series:
    """Pattern without its outer wrappers."""
    return pattern.map(lambda p: patterns.unwrap(p)[0])


@F.pandas_udf(IntegerType())
def capture_count(pattern: pd.Series) -> pd.Series:
    """Number of capture groups, of catalogue patterns."""
    return pattern.map(patterns.capture_count)
