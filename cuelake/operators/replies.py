"""Model replies: reading, checking against the transcript, folding into the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.functions.text import literal_pattern
from cuelake.operators import catalog
from cuelake.operators.match import pattern_guard
from cuelake.session import cut

MARK = "REGEX:"  # fixed value: the answer line of a probe or focus


def read_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Chat responses to (status, text): the first choice's content, or the error's message."""
    raw = F.col(body)
    content = F.get(F.from_json(raw, schemas.CHAT_RESPONSE)["choices"], F.lit(0))["message"]["content"]
    message, error = F.get_json_object(raw, "$.error.message"), F.get_json_object(raw, "$.error")
    failed = F.coalesce(message, F.when(~error.startswith("{") & ~error.startswith("["), error), F.lit(""))
    http_ok = F.col("http_status") == 200
    status = (F.when(~http_ok, F.lit("http error")).when(content.isNotNull(), F.lit("ok")).otherwise(F.lit("unreadable")))
    return responses.withColumn("status", status).withColumn(
        "text", F.when(~http_ok, failed).otherwise(content)).drop(body)


def current_replies(replies: DataFrame, owed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, obsolete): a reply counts only under its epoch and the target still owed."""
    keys = ["task_id", "epoch", "target"]
    return replies.join(owed.select(*keys), keys, "left_semi"), replies.join(owed.select(*keys), keys, "left_anti")


def prefix_replay(windows: DataFrame, replies: DataFrame, order: list[str]) -> DataFrame:
    """Windows in staging order up to the first one without a reply (that bound is one row)."""
    place = F.struct(*order)
    missing = windows.join(replies.select("id"), "id", "left_anti").agg(F.min(place).alias("__stop"))
    return windows.join(F.broadcast(missing)).where(F.col("__stop").isNull() | (place < F.col("__stop"))).drop("__stop")


def _label(lines: Column, label: str) -> Column:
    hits = F.filter(lines, lambda x: x.startswith(label))
    last = F.get(hits, F.size(hits) - 1)
    return F.coalesce(F.btrim(F.substring(last, F.lit(len(label) + 1), F.length(last)), F.lit(" \t\r\n")), F.lit(""))


def _parts(lines: Column, label: str, by: str) -> Column:
    rest = F.transform(F.filter(lines, lambda x: x.startswith(label)),
                       lambda x: F.substring(x, F.lit(len(label) + 1), F.length(x)))
    cut_ = F.flatten(F.transform(rest, lambda x: F.split(x, by)))
    return F.filter(F.transform(cut_, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def parse_term_replies(replies: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Term blocks: (keys, block_no, term, kind, means, gloss, seen, cues); ``NONE`` yields nothing."""
    blocks = replies.where(~F.col(text).startswith("NONE")).select(
        *keys, F.posexplode(F.filter(F.split(text, "\n\n"), lambda b: b != "")).alias("block_no", "b"))
    lines = F.split("b", "\n")
    number = lambda c: F.regexp_replace(c, "^#", "").try_cast("int")
    cues = F.filter(F.transform(F.filter(_parts(lines, "CUES:", " "), lambda c: c.rlike(r"^#?[+-]?[0-9]+$")), number),
                    lambda c: c.isNotNull())
    return blocks.select(
        *keys, "block_no", _label(lines, "TERM:").alias("term"), F.lower(_label(lines, "KIND:")).alias("kind"),
        _label(lines, "MEANS:").alias("means"), _label(lines, "GLOSS:").alias("gloss"),
        _parts(lines, "SEEN:", r"\|").alias("seen"), cues.alias("cues"))


def validate_terms(entries: DataFrame, windows: DataFrame, cues: DataFrame) -> DataFrame:
    """Entries that hold up, with the spellings that occur on a cited line as ``kept``.

    Every cited cue must lie in the window and exist; a spelling nobody said is dropped; an entry
    without a spelling, gloss or cue is dropped whole.  ``windows`` is (id, video_id, first_cue, last_cue).
    """
    whole = entries.where((F.col("term") != "") & (F.size("seen") > 0) & (F.col("gloss") != "") & (F.size("cues") > 0))
    cited = whole.join(windows.select("id", "video_id", "first_cue", "last_cue"), "id").withColumn("cue_no", F.explode("cues"))
    spoken = cited.join(cues.select("video_id", "cue_no", F.lower("line").alias("l")), ["video_id", "cue_no"], "left")
    inside = F.col("cue_no").between(F.col("first_cue"), F.col("last_cue")) & F.col("l").isNotNull()
    judged = spoken.groupBy("id", "block_no").agg(F.bool_and(inside).alias("ok"), F.collect_set("l").alias("ls"))
    kept = F.filter("seen", lambda v: F.exists("ls", lambda l: F.contains(l, F.lower(v))))
    return whole.join(judged.where("ok"), ["id", "block_no"]).withColumn("kept", kept).where(F.size("kept") > 0).drop("ls", "ok")


def literal_union(spellings: Column) -> Column:
    """Spellings as one case-folding alternation of literals."""
    return F.concat(F.lit("(?i:"), F.array_join(F.transform(spellings, literal_pattern), "|"), F.lit(")"))


def consolidate_terms(entries: DataFrame, topics: DataFrame, order: list[str], stem: str = "term") -> DataFrame:
    """One term, one topic: (name, term, kind, gloss, pattern, attached), as if entries joined the catalogue one by one.

    ``topics`` is (seq, name, fragments), ``order`` names the columns that order the entries.  The topic of a
    case-folded term is settled by its first entry that brings a spelling nobody has (a new topic with the next free
    number), or, if earlier, by its first entry whose spellings are all covered and most of them by one ``stem`` topic
    of the catalogue that has no term yet: the term attaches to that topic, and its later spellings grow it.  Of equally
    wide covers the earliest topic counts; a new topic may be the widest, and then the entry says nothing.  A topic
    grows only if it is one case-folding fragment without references; else later spellings of its term stay free for
    other terms.  Kind and gloss keep the first non-empty word from the settling entry on.
    """
    placed = entries.withColumn("at", F.struct(*order)).withColumn("folded", F.lower("term"))
    patterned = cut(placed.select(F.to_json("at").alias("entry"), "at", "folded", "term", "kind", "means", "gloss",
                                  literal_union(F.col("kept")).alias("pattern")))
    expanded = cut(catalog.expand_topics(topics))
    held = catalog.pattern_branches(expanded.where("pattern is not null"), ["seq", "name"]).select("seq", "name", "key").distinct()
    mine = F.col("name").rlike(f"^{stem}[0-9]+$")
    known = held.groupBy("key").agg(F.collect_list(F.when(mine, F.struct("seq", "name"))).alias("owners"))
    rows = catalog.pattern_branches(patterned, ["entry"]).groupBy("entry", "key").agg(F.min(F.struct("branch_no", "text")).alias("b"))
    rows = cut(rows.join(known, "key", "left").join(patterned.select("entry", "at", "folded"), "entry")
               .select("entry", "at", "folded", "key", "b.branch_no", "b.text", "owners"))
    settled = _attachments(rows, _growing(topics, expanded))
    new = _placed(rows, settled)
    grown = new.groupBy("folded").agg(F.min("at").alias("born"), F.array_sort(F.collect_list(F.struct("at", "branch_no", "text"))).alias("t"))
    added = F.array_join(F.transform("t", lambda x: x["text"]), "|")
    fresh = grown.join(settled, "folded", "left_anti").select("folded", F.col("born").alias("since"), F.concat(
        F.lit("(?i:"), added, F.lit(")")).alias("pattern"), F.lit(False).alias("attached"))
    lead = order[0]
    fresh = catalog.free_numbers(cut(fresh.withColumn("__order", F.col(f"since.{lead}"))), "__order", expanded, stem,
                                 ties=[F.col(f"since.{c}") for c in order[1:]])
    own = topics.select("name", F.array_join("fragments", "").alias("own"))
    old = settled.join(own, "name").join(grown.select("folded", added.alias("added")), "folded", "left").select(
        "folded", "since", F.when(F.col("added").isNull(), F.col("own")).otherwise(
            F.concat(F.lit("(?i:"), catalog.inner_pattern(F.col("own")), F.lit("|"), "added", F.lit(")"))).alias("pattern"),
        F.lit(True).alias("attached"), "name")
    topic = fresh.select("folded", "since", "pattern", "attached", "name").unionByName(old)
    shown = F.when(F.col("means") == "", F.col("gloss")).otherwise(F.concat("term", F.lit(" = "), "means", F.lit(". "), "gloss"))
    info = patterned.select("folded", "at", "term", "kind", shown.alias("gloss")).join(topic.select("folded", "since"), "folded").where("at >= since")
    info = info.groupBy("folded").agg(
        F.min_by("term", "at").alias("term"), F.coalesce(F.min_by("gloss", F.when(F.col("gloss") != "", F.col("at"))), F.lit("")).alias("gloss"),
        F.coalesce(F.min_by("kind", F.when(F.col("kind") != "", F.col("at"))), F.lit("")).alias("kind"))
    return topic.join(info, "folded").select("name", "term", "kind", "gloss", "pattern", "attached")


def _growing(topics: DataFrame, expanded: DataFrame) -> DataFrame:
    """Names of the topics that spellings can be added to."""
    single = topics.where((F.size("fragments") == 1) & ~F.get("fragments", F.lit(0)).rlike(catalog.REFERENCE)).select("name")
    return catalog.pattern_branches(expanded.join(single, "name").where("pattern is not null"), ["name"]).where("folds and not opaque").select("name").distinct()


def _placed(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """(key, at, branch_no, text, folded): the first entry that brings a spelling nobody has and whose topic can take it."""
    stuck = settled.where("not grows").select("folded", F.col("since").alias("__stuck"))
    free = rows.where("owners is null").join(stuck, "folded", "left").where("__stuck is null or at <= __stuck")
    return free.groupBy("key").agg(F.min(F.struct("at", "branch_no", "text", "folded")).alias("p")).select("key", "p.*")


def _attachments(rows: DataFrame, growing: DataFrame) -> DataFrame:
    """(folded, since, name, grows): the terms that attach to topics of the catalogue.

    What an entry decides depends on earlier entries only, so all are decided at once under the last round's
    attachments until a round changes nothing: each round settles at least the earliest decision that was open, and
    all that depend on settled ones.
    """
    settled = rows.select("folded", F.col("at").alias("since"), F.lit("").alias("name"), F.lit(False).alias("grows")).limit(0)
    said = None
    while True:
        new = cut(_placed(rows, settled))
        born = new.groupBy("folded").agg(F.min("at").alias("born"))
        # Entries all of whose spellings are covered, of terms not yet settled by a new topic.
        quiet = rows.join(new.select(F.col("at").alias("__new")).distinct(), F.col("at") == F.col("__new"), "left_anti")
        quiet = quiet.join(born, "folded", "left").where("born is null or at < born").select("entry", "at", "folded", "key", "owners")
        of = new.select("key", F.col("at").alias("__at"), F.col("folded").alias("__by")).join(
            settled.select(F.col("folded").alias("__by"), F.col("since").alias("__since"), F.col("name").alias("__name")), "__by", "left")
        grown = of.select("key", "__at", "__by", F.when(F.col("__since") <= F.col("__at"), F.col("__name")).alias("__name"))
        by_growth = quiet.where("owners is null").join(grown, "key").where("__at < at").select(
            "entry", "at", "folded", F.col("__name").alias("name"), F.when(F.col("__name").isNull(), F.col("__by")).alias("by"))
        by_birth = quiet.select("entry", "at", "folded", F.explode("owners").alias("o")).select(
            "entry", "at", "folded", F.col("o.name").alias("name"), F.lit(None).cast("string").alias("by"))
        seqs = rows.select(F.explode("owners").alias("o")).select("o.name", "o.seq").distinct()
        counts = by_birth.unionByName(by_growth).groupBy("entry", "at", "folded", "name", "by").agg(F.count("*").alias("n"))
        counts = counts.join(seqs, "name", "left")  # topics of the catalogue come before new ones
        best = counts.groupBy("entry", "at", "folded").agg(F.max_by(F.struct("name"), F.struct(F.col("n"), F.col("seq").isNotNull(), -F.col("seq"))).alias("b"))
        best = best.select("at", "folded", "b.name").where("name is not null")
        taken = settled.select("name", F.col("since").alias("__taken"), F.col("folded").alias("__by"))
        open_ = best.join(taken, "name", "left").where("__taken is null or __by = folded or at < __taken")
        first = open_.groupBy("folded").agg(F.min(F.struct("at", "name")).alias("f")).select("folded", "f.*")
        won = first.groupBy("name").agg(F.min(F.struct("at", "folded")).alias("w")).select("name", F.col("w.at").alias("since"), F.col("w.folded").alias("folded"))
        settled = cut(won.join(growing.withColumn("grows", F.lit(True)), "name", "left")
                      .select("folded", "since", "name", F.coalesce("grows", F.lit(False)).alias("grows")))
        total = settled.agg(F.count("*"), F.sum(F.xxhash64("folded", "since", "name").cast("decimal(38,0)"))).first()
        if total == said:
            return settled
        said = total


def regex_line(text: Column) -> Column:
    """Payload of the last answer line, which must start a line; NULL without one."""
    tail = F.substring_index(text, MARK, -1)
    head = F.left(text, F.length(text) - F.length(tail) - F.lit(len(MARK)))
    payload = F.regexp_replace(F.regexp_replace(F.substring_index(tail, "\n", 1), r"^[ \t]+", ""), r"[\x00-\x20]+$", "")
    anchored = (head == "") | head.endswith("\n")
    return F.when(F.contains(text, F.lit(MARK)) & anchored & (payload != ""), payload)


def tidied(rows: DataFrame, keys: list[str], pattern: str = "pattern") -> DataFrame:
    found = rows.where(F.col(pattern).isNotNull())
    return catalog.tidy(catalog.pattern_branches(found, keys, pattern), keys)


def classify_probe_replies(replies: DataFrame, count_hits) -> DataFrame:
    """Probe replies to (id, verdict, pattern): waiting, retired, search, or retry with the reason.

    ``replies`` is (id, attempt, text); a failed second attempt retires.  ``count_hits`` maps the
    distinct valid patterns (name, pattern) to (name, n_hits).
    """
    drawn = replies.withColumn("raw", F.when(~F.col("text").startswith("NONE"), regex_line(F.col("text"))))
    drawn = drawn.join(tidied(drawn, ["id"], "raw").withColumnRenamed("tidied", "pattern"), "id", "left")
    guarded = cut(pattern_guard(drawn.where("pattern is not null").select("pattern").distinct()))
    searchable = guarded.where("valid").select(F.col("pattern").alias("name"), "pattern")
    hits = count_hits(searchable).select(F.col("name").alias("pattern"), "n_hits")
    known = guarded.join(hits, "pattern", "left").select("pattern", "valid", "n_hits")
    judged = drawn.join(known, "pattern", "left")
    failure = (F.when(F.col("pattern").isNull(), F.lit("no line")).when(~F.col("valid"), F.lit("invalid"))
               .when(F.coalesce("n_hits", F.lit(0)) == 0, F.lit("no match")))
    verdict = (
        F.when(F.col("text") == "", F.lit("waiting")).when(F.col("text").startswith("NONE"), F.lit("retired"))
        .when(failure.isNull(), F.lit("search")).when(F.col("attempt") > 1, F.lit("retired"))
        .otherwise(F.concat(F.lit("retry: "), failure)))
    return judged.select("id", verdict.alias("verdict"), "pattern")


def harvest_focus_replies(replies: DataFrame, covered: DataFrame, waiting_windows: DataFrame) -> DataFrame:
    """Focus texts to novel patterns (seq, pattern, rebuilt); nothing while a term window waits."""
    text = F.col("text")
    head = F.substring_index(text, "\n", 1)
    body = F.regexp_replace(F.substring(text, F.length(head) + F.lit(1), F.length(text)), r"^\n+", "")
    payload = F.regexp_replace(F.regexp_replace(F.substring(head, F.lit(len(MARK) + 1), F.length(head)), r"^[ \t]+", ""),
                               r"[\x00-\x20]+$", "")
    opened = text.startswith(MARK)
    pattern = F.when(opened, F.when(~body.startswith("NONE") & (payload != ""), payload)).otherwise(regex_line(text))
    # Written once: the texts are not read again for the patterns to which the adopted branches go back.
    found = cut(replies.where(~text.startswith("NONE")).select("seq", pattern.alias("pattern")).where("pattern is not null"))
    valid = pattern_guard(found).where("coalesce(problem, '') <> 'invalid syntax'").select("seq", "pattern")
    gate = waiting_windows.limit(1).agg(F.count("*").alias("__open"))  # one row
    ripe = valid.join(F.broadcast(gate)).where("__open = 0").drop("__open")
    return catalog.adopt_novel(cut(ripe), covered)
