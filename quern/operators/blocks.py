"""Text blocks for a conversation, from records alone: plans, rosters, histories, notices of clashes; and wide rows for exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import documents

# Heads of blocks, turns of a history, windows and interests of a roster line, characters of a token.
EMPTY_PLAN = "CURRENT PLAN: empty. Nothing has been added yet."
PLAN = "CURRENT PLAN (ids only — do not re-add these):"
SECTIONS = ("Sessions", "People", "Exhibitors")
FIRST_MESSAGE = "CONVERSATION SO FAR: this is the first message."
HISTORY = "CONVERSATION SO FAR (your memory of this attendee):"
HISTORY_TURNS, WINDOWS, INTERESTS = 12, 3, 4
CHARS_PER_TOKEN = 3.7
DEMO = "SEEDED DEMO ATTENDEE — say so if you recommend them"


def _joined(items: Column, between: str = "\n") -> Column:
    return F.array_join(F.array_compact(items), between)


def plan_text(plans: DataFrame, items: DataFrame) -> DataFrame:
    """person and `text`: the plan's entries by section, in their order, with who added them.

    plans: person, objective. items: person, section (of SECTIONS), pos, id, label, detail, manual. A plan without entries has a text, too.
    """
    who = F.when(F.col("manual"), "added by the attendee").otherwise("added by you")
    line = F.concat(F.lit("  "), F.concat_ws(" | ", F.col("id").cast("string"), "label", F.nullif("detail", F.lit("")), who))
    place = F.element_at(F.create_map(*[x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i))]), F.col("section"))
    per = items.select("person", place.alias("place"), F.struct("pos", line.alias("line")).alias("x")).groupBy("person", "place").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = F.concat(F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("place") + 1), F.lit(":"))
    section = per.select("person", F.struct("place", F.concat_ws("\n", head, F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("text")).alias("s"))
    whole = section.groupBy("person").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    body = F.array_join(F.transform("sections", lambda s: s["text"]), "\n")
    objective = F.when(F.col("objective") != "", F.concat(F.lit("Objective so far: "), F.col("objective")))
    text = F.when(F.col("sections").isNull(), EMPTY_PLAN).otherwise(_joined(F.array(F.lit(PLAN), objective, body)))
    return plans.join(whole, "person", "left").select("person", text.alias("text"))


def roster_line() -> Column:
    """A line of the roster from slug, name, role, org, interests, n_sessions, shared, windows, common and demo; dashes where nothing is known,
    shared sessions by id alone, at most WINDOWS windows and INTERESTS interests."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    listed = lambda label, c, between, most=None: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, most) if most else F.col(c), between)))
    return _joined(
        F.array(
            F.col("slug"), F.col("name"), dash(F.col("role")), dash(F.col("org")), dash(F.array_join("interests", "/")), F.concat(F.col("n_sessions").cast("string"), F.lit(" sessions planned")),
            listed("also in your plan: ", "shared", ","), listed("both free: ", "windows", "; ", WINDOWS), listed("in common: ", "common", ", ", INTERESTS), F.when(F.col("demo"), DEMO),
        ),
        " | ",
    )


def history_text(turns: DataFrame) -> DataFrame:
    """conv_id and the last turns as text. turns: conv_id, turn, role, text; ties of a turn by role and text."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    last = turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= HISTORY_TURNS)
    line = F.concat(F.when(F.col("role") == "user", "Attendee: ").otherwise("You: "), F.coalesce("text", F.lit("")))
    per = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))).alias("xs"))
    return per.select("conv_id", F.concat_ws("\n", F.lit(HISTORY), F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("text"))


def clash_note(dropped: DataFrame, by: list[str]) -> DataFrame:
    """The keys and a notice of what was left out. dropped: the keys, nth, label, day, time, other (the label of what it clashes with)."""
    line = F.concat(F.lit('• "'), "label", F.lit('" ('), "day", F.lit(", "), "time", F.lit(') — it clashes with "'), "other", F.lit('", which is already in your plan.'))
    per = dropped.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("xs"))
    one = F.size("xs") == 1
    head = F.concat(F.lit("I left "), F.when(one, "one session").otherwise(F.concat(F.size("xs").cast("string"), F.lit(" sessions"))), F.lit(" out to avoid double-booking you:"))
    tail = F.concat(F.lit("\nSay the word if you'd rather have "), F.when(one, "it").otherwise("one of them"), F.lit(" and I'll swap out what it collides with."))
    return per.select(*by, F.size("xs").alias("n"), F.concat_ws("\n", head, F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), tail).alias("text"))


def wide(docs: DataFrame, column: str, columns: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Rows for an export from VARIANT documents: a text column for each header, from its path, lists joined by ';'. A path with a second one
    is shown only if the value there, a method, is given and isn't 'unsourced'."""
    behind = docs.select(F.explode(F.array(column)).alias("doc"))
    doc = F.col("doc")

    def shown(path: str) -> Column:
        listed = F.array_join(documents.at(doc, path, "array<string>"), ";")
        return F.when(documents.is_kind(doc, path, "array"), listed).otherwise(documents.at(doc, path, "string"))

    cells = []
    for header, path in columns.items():
        cell = shown(path) if isinstance(path, str) else F.when(F.coalesce(documents.at(doc, path[1], "string"), F.lit("unsourced")) != "unsourced", shown(path[0]))
        cells.append(cell.alias(header))
    return behind.select(*cells)


#: Headers of an exhibitors' export with their paths; texts and use cases are shown only if they are traced.
_OF = {"whatTheyDo": ("method", "variant", "sourceUrl", "fetchedAt", "writer", "note"), "useCases": ("method", "basis", "fetchedAt", "writer", "note")}
EXHIBITORS: dict[str, str | tuple[str, str]] = {c: c for c in ("name", "aliases", "slug", "tier", "sourceGroup", "category", "website", "logoUrl")}
for _field, _facts in _OF.items():
    EXHIBITORS |= {_field: (_field, f"provenance.{_field}.method")} | {f"{_field}_{x}": f"provenance.{_field}.{x}" for x in _facts}
EXHIBITORS |= {f"{x}_unsourced": f"unsourced.{x}" for x in ("whatTheyDo", "useCases")} | {f"unsourced_{x}": f"unsourced.{x}" for x in ("method", "confidence", "writer", "note")}
EXHIBITORS |= {c: c for c in ("confidence", "confidenceScore")} | {f"confidence_{x}": f"provenance.confidence.{x}" for x in ("method", "originalValue", "thresholds", "note")}
EXHIBITORS |= {f"logoUrl_{x}": f"provenance.logoUrl.{x}" for x in ("method", "sourceUrl")} | {c: c for c in ("sourceUrl", "extractedAt", "lastSeenAt", "status", "isDataArtifact", "year")} | {"recordId": "_id"}


def roster_gated(mentions: DataFrame, roster: DataFrame) -> DataFrame:
    """key and `slugs`: what a reply names, in order, each once at its first place, of the roster alone. mentions: key, slugs. roster: slug."""
    each = mentions.select("key", F.posexplode("slugs").alias("pos", "slug")).groupBy("key", "slug").agg(F.min("pos").alias("pos"))
    kept = each.join(roster.select("slug").distinct(), "slug", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias("xs"))
    out = mentions.select("key").join(kept, "key", "left")
    return out.select("key", F.coalesce(F.transform("xs", lambda x: x["slug"]), F.array().cast("array<string>")).alias("slugs"))


def attempts(cases: DataFrame, answers: DataFrame, repeat: int, safety_repeat: int) -> DataFrame:
    """case, ord, attempts, passed, flaky, errors and response (the first answer that isn't blank) of repeatedly run cases.

    cases: case, ord, safety. answers: case, nth, answer, error, n_violations, as many as a target gave; of a safety case the first
    `safety_repeat` count, of others the first `repeat`. An attempt passes without error and violation; a case passes if it has attempts
    and all of them do; it is flaky if some do.
    """
    limit = F.when(F.col("safety"), safety_repeat).otherwise(repeat)
    place = F.row_number().over(Window.partitionBy("case").orderBy("nth"))
    run = answers.withColumn("place", place).join(cases, "case", "right").where(F.col("place").isNull() | (F.col("place") <= limit))
    good = F.col("place").isNotNull() & F.col("error").isNull() & (F.col("n_violations") == 0)
    per = run.groupBy("case", "ord").agg(
        F.count("place").alias("attempts"), F.count_if(good).alias("good"), F.count("error").alias("errors"),
        F.min_by("answer", F.when(F.btrim(F.coalesce("answer", F.lit(""))) != "", F.col("place"))).alias("response"),
    )
    return per.select("case", "ord", "attempts", ((F.col("attempts") > 0) & (F.col("good") == F.col("attempts"))).alias("passed"), ((F.col("good") > 0) & (F.col("good") < F.col("attempts"))).alias("flaky"), "errors", "response")


#: What a record block says for a field that is not known, and of places that nobody has published.
UNKNOWN = "not recorded"


def record_block(head: Column, fields: dict[str, Column | str]) -> Column:
    """A record for a conversation: its head, and a line for each field, UNKNOWN for what is blank; fixed texts stand as they are."""
    lines = [head]
    for label, value in fields.items():
        shown = F.lit(value) if isinstance(value, str) else F.coalesce(F.nullif(F.btrim(value.cast("string")), F.lit("")), F.lit(UNKNOWN))
        lines.append(F.concat(F.lit(f"    {label}: "), shown))
    return F.concat_ws("\n", *lines)


def flat_text(fields: dict[str, Column]) -> Column:
    """A record's filled fields one after another, for an embedding."""
    return F.array_join(F.array_compact(F.array(*[F.nullif(F.btrim(c), F.lit("")) for c in fields.values()])), " \n ")


def refresh_lines(changes: DataFrame, added: int = 40, changed: int = 60) -> DataFrame:
    """kind, n_kind, nth and line of a refresh report: the first `added` new records and `changed` changes, all that disappeared, and how many
    new ones are not shown.

    changes: kind ('added', 'disappeared', 'changed'), ord, title, day, start, field, was, now.
    """
    order = Window.partitionBy("kind").orderBy("ord", "field")
    numbered = changes.withColumn("nth", F.row_number().over(order)).withColumn("n_kind", F.count("*").over(Window.partitionBy("kind")))
    when = F.coalesce(F.concat(F.lit(" ("), "day", F.lit(" "), F.coalesce("start", F.lit("")), F.lit(")")), F.lit(""))
    line = (
        F.when(F.col("kind") == "added", F.concat(F.lit("   + "), "title"))
        .when(F.col("kind") == "disappeared", F.concat(F.lit("   - DISAPPEARED: "), "title", when))
        .otherwise(F.concat(F.lit("   ~ "), F.substring("title", 1, 48), F.lit(": "), "field", F.lit(" "), F.coalesce("was", F.lit("null")), F.lit(" -> "), F.coalesce("now", F.lit("null"))))
    )
    shown = numbered.where((F.col("kind") == "disappeared") | (F.col("nth") <= F.when(F.col("kind") == "added", added).otherwise(changed)))
    more = numbered.where((F.col("kind") == "added") & (F.col("nth") == added + 1)).select("kind", "n_kind", "nth", F.concat(F.lit("   + ... "), (F.col("n_kind") - added).cast("string"), F.lit(" more")).alias("line"))
    return shown.select("kind", "n_kind", "nth", line.alias("line")).unionByName(more)
