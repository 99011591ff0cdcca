"""Review findings across cycles: counts, what was fixed, what came back, what to fix next.

Sets of findings are compared by joining keys of neighbouring cycles and counting, never by collecting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.categories import CATEGORY_NAMES
from outlay.functions.text import finding_key, finding_label, mentions
from outlay.operators.ordered import numbered

# Order in which findings are fixed, how many at once, and phrases that point at a snapshot value.
PRIORITY = ("arithmetic", "completeness", "evidence", "history", "policy", "html", "usability", "visual_design")
MAX_FOCUSED = 3
MAX_RESOLVED = 10
PIECE = 10_000
FIELD_HINTS = (
    ("disposable_cash", ("disposable", "projected savings")),
    ("remaining_gap_after_cuts", ("remaining gap", "remaining_gap")),
    ("savings_shortfall", ("shortfall",)),
    ("mom_change_percent", ("mom", "month-over-month", "month over month")),
    ("previous_total_net_expense", ("previous month total", "previous total", "previous_total", "prior month total")),
    (
        "latest_total_net_expense",
        ("latest total", "current total", "total net expense", "latest_total", "current-month total"),
    ),
)
CYCLE = ["run_id", "cycle"]


def _piece() -> Column:
    """Stretches of a review's findings that one task can hold, however long the review."""
    return F.floor(F.col("position") / PIECE)


def _errors(findings: DataFrame) -> DataFrame:
    rows = findings.where(F.lower("severity") == "error")
    return rows.withColumns(
        {
            "named": F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")),
            "key_category": F.lower(F.coalesce("category", F.lit(""))),
            "key_message": finding_key("message"),
        }
    )


def category_errors(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Errors per cycle and category; a failed review without any itemized error counts one ``unclassified``."""
    counts = _errors(findings).groupBy(*CYCLE, F.col("named").alias("category")).agg(F.count(F.lit(1)).alias("errors"))
    failed = reviews.where(F.lower("decision") != "pass").select(*CYCLE)
    none = failed.join(counts.select(*CYCLE).distinct(), CYCLE, "left_anti")
    return counts.unionByName(none.select(*CYCLE, F.lit("unclassified").alias("category"), F.lit(1).cast("long").alias("errors")))


def category_changes(errors: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per cycle and category: errors now and in the cycle before, resolved and new. First cycles have no before."""
    now = errors.select(*CYCLE, "category", "errors")
    before = errors.select("run_id", (F.col("cycle") + 1).alias("cycle"), "category", F.col("errors").alias("before"))
    both = now.join(before, [*CYCLE, "category"], "full_outer")
    follows = reviews.select("run_id", (F.col("cycle") + 1).alias("cycle")).join(reviews.select(*CYCLE), CYCLE)
    errors_now, errors_before = F.coalesce("errors", F.lit(0)), F.coalesce("before", F.lit(0))
    return both.join(follows.distinct(), CYCLE).select(
        *CYCLE,
        "category",
        errors_now.alias("errors"),
        errors_before.alias("errors_before"),
        F.greatest(F.lit(0), errors_before - errors_now).alias("resolved"),
        F.greatest(F.lit(0), errors_now - errors_before).alias("new"),
    )


def cycle_progress(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per review: counts, change against the review before, repeated findings, and whether it stalled.

    ``repeated_error_count`` counts findings whose key was there before; a review stalls when both reviews have the
    same non-empty set of keys.
    """
    level = F.lower("severity")
    key = ["key_category", "key_message"]
    named = findings.where(level.isin("error", "warning")).select(
        *CYCLE, (level == "error").alias("error"), F.when(level == "error", F.lower(F.coalesce("category", F.lit("")))).alias("key_category"),
        F.when(level == "error", finding_key("message")).alias("key_message"),
    )
    counts = named.groupBy(*CYCLE, "error", *key).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("run_id", "error", *key).orderBy("cycle")
    counts = counts.withColumn("hit", F.coalesce(F.col("error") & (F.lag("cycle").over(along) == F.col("cycle") - 1), F.lit(False)))
    # Reviews and findings meet in one grouping; a review without findings brings its own row.
    both = counts.unionByName(reviews.select(*CYCLE, "decision", F.lit(True).alias("reviewed")), allowMissingColumns=True)
    error, n = F.coalesce("error", F.lit(False)), F.coalesce("n", F.lit(0))
    base = both.groupBy(*CYCLE).agg(
        F.max("decision").alias("decision"),
        F.max("reviewed").alias("reviewed"),
        F.sum(F.when(error, n).otherwise(0)).alias("itemized"),
        F.sum(F.when(~error, n).otherwise(0)).alias("warning_count"),
        F.count_if(error).alias("keys"),
        F.count_if(F.col("hit")).alias("shared"),
        F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("repeated"),
    ).where("reviewed")
    unclassified = (F.col("itemized") == 0) & (F.lower("decision") != "pass")
    base = base.withColumn("error_count", F.when(unclassified, F.lit(1).cast("long")).otherwise(F.col("itemized")))
    steps = Window.partitionBy("run_id").orderBy("cycle")
    has_prior = F.coalesce(F.lag("cycle").over(steps) == F.col("cycle") - 1, F.lit(False))
    joined = base.withColumns(
        {
            "prior_error_count": F.when(has_prior, F.lag("error_count").over(steps)),
            "prior_keys": F.when(has_prior, F.lag("keys").over(steps)),
        }
    )
    same = (F.col("keys") > 0) & (F.col("keys") == F.col("prior_keys")) & (F.col("keys") == F.col("shared"))
    return joined.select(
        *CYCLE,
        "decision",
        "error_count",
        "warning_count",
        "prior_error_count",
        (F.col("prior_error_count") - F.col("error_count")).alias("error_count_delta"),
        F.when(F.col("prior_error_count").isNotNull(), F.col("repeated")).alias("repeated_error_count"),
        F.coalesce(same, F.lit(False)).alias("stalled"),
    )


def unchanged_errors(findings: DataFrame) -> DataFrame:
    """(run_id, cycle) whose list of errors equals the list of the cycle before, entry by entry.

    ``findings`` has ``position``, the place of a finding in its review.
    """
    rows = findings.where(F.coalesce("severity", F.lit("error")) == "error")
    rows = numbered(rows, CYCLE, _piece(), ["position"], "place").select(*CYCLE, "place", "category", "message")
    before = rows.select("run_id", (F.col("cycle") + 1).alias("cycle"), "place", F.col("category").alias("c"), F.col("message").alias("m"))
    joined = rows.join(before, [*CYCLE, "place"], "full_outer")
    same = F.col("category").eqNullSafe(F.col("c")) & F.col("message").eqNullSafe(F.col("m"))
    sizes = joined.groupBy(*CYCLE).agg(F.bool_and(same).alias("same"))
    return sizes.where("same").select(*CYCLE)


def _earlier(errors: DataFrame, counted: DataFrame, most: int) -> DataFrame:
    """(run_id, n, entries): for each counted review the ``most`` keys of earlier reviews seen first last, without its own errors.

    A key is absent from the reviews between two of its occurrences. Such a stretch is cut into dyadic pieces, each piece keeps
    the ``most`` keys seen first last, and a review looks at the pieces around it, one for each power of two. So
    no run's findings are gathered, however many it has.
    """
    key = ["run_id", "key_category", "key_message"]
    first = F.struct("cycle", "position")
    along = Window.partitionBy(*key).orderBy("n")
    seen = errors.groupBy(*key, "n", "cycle").agg(F.min(first).alias("first"), F.min_by(finding_label("category", "message"), first).alias("label"))
    begins = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = counted.groupBy("run_id").agg(F.max("n").alias("last"))
    stretches = seen.select(
        "run_id", "key_category", "key_message", F.first("first").over(begins).alias("first"), F.first("label").over(begins).alias("label"),
        F.col("cycle").alias("last_seen"), (F.col("n") + 1).alias("lo"), F.lead("n").over(along).alias("back"),
    ).join(last, "run_id")
    stretches = stretches.withColumn("hi", F.coalesce(F.col("back") - 1, F.col("last"))).where("lo <= hi")
    entry = F.struct("first", "key_category", "key_message", "label", "last_seen", F.coalesce(F.col("back"), F.lit(1 << 62)).alias("back"))
    levels = lambda top: F.sequence(F.lit(0), F.floor(F.log2(top)).cast("int"))
    # Piece (k, i) holds the reviews i * 2^k .. (i + 1) * 2^k - 1; a stretch takes those inside it whose parent is not.
    inside = lambda k, i: (i >= F.ceil(F.col("lo") / k)) & ((i + 1) * k - 1 <= F.col("hi"))
    size = lambda k: F.pow(F.lit(2.0), k).cast("long")
    ends = lambda k: F.array_distinct(F.array(F.ceil(F.col("lo") / size(k)), F.floor((F.col("hi") + 1) / size(k)).cast("long") - 1))
    whole = lambda k, i: inside(size(k), i) & ~inside(size(k + 1), F.floor(i / 2).cast("long"))
    pieces = F.flatten(F.transform(levels(F.col("hi") - F.col("lo") + 1), lambda k: F.transform(F.filter(ends(k), lambda i: whole(k, i)), lambda i: F.struct(k.alias("k"), i.alias("i")))))
    held = stretches.select("run_id", entry.alias("entry"), F.inline(pieces))
    newest = Window.partitionBy("run_id", "k", "i").orderBy(F.desc("entry.first"), F.desc("entry"))
    held = held.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_r")
    around = counted.join(last, "run_id").select("run_id", "n", F.explode(levels(F.col("last") + 1)).alias("k"))
    around = around.withColumn("i", F.floor(F.col("n") / size(F.col("k"))).cast("long"))
    newest = Window.partitionBy("run_id", "n").orderBy(F.desc("entry.first"), F.desc("entry"))
    near = around.join(held, ["run_id", "k", "i"]).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most)
    return near.groupBy("run_id", "n").agg(F.sort_array(F.collect_list("entry")).alias("entries"))


def resolved_findings(findings: DataFrame, reviews: DataFrame, keep: int = MAX_RESOLVED) -> DataFrame:
    """Errors of earlier reviews that later ones no longer have: a list of ``keep`` entries, kept up review by review.

    At each review, entries that came back leave the list; then earlier errors that are neither in the review nor in the
    list join its end, in the order they were first seen; then the oldest entries beyond ``keep`` are dropped. A dropped error
    that stays away joins again at the next review, so with more than ``keep`` of them the list turns over. Reviews that
    failed without an itemized error say nothing about what was fixed and are skipped.

    Returns the list after the last review: the label, the review that last had the error, the review at which it
    joined, and its place from the end of the list. The fold over a run's reviews needs the 2 * ``keep`` earlier
    errors that were seen first last, as at most ``keep`` of them can be in the list already.
    """
    errors = _errors(findings)
    itemized = errors.select(*CYCLE).distinct().withColumn("itemized", F.lit(True))
    counted = reviews.join(itemized, CYCLE, "left").where((F.lower("decision") == "pass") | F.col("itemized")).select(*CYCLE).distinct()
    counted = counted.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("cycle")).cast("long"))
    earlier = _earlier(errors.join(counted, CYCLE), counted, 2 * keep)
    steps = counted.join(earlier, ["run_id", "n"], "left").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("n", "cycle", "entries"))).alias("steps"))
    entry = earlier.schema["entries"].dataType.elementType.simpleString()
    place = counted.schema["cycle"].dataType.simpleString()
    named = lambda e: F.struct(e["key_category"], e["key_message"])

    def step(held: Column, now: Column) -> Column:
        stays = F.filter(held, lambda h: h["e"]["back"] != now["n"])
        present = F.transform(stays, lambda h: named(h["e"]))
        joins = F.filter(F.coalesce(now["entries"], F.array().cast(f"array<{entry}>")), lambda e: ~F.array_contains(present, named(e)))
        both = F.concat(stays, F.transform(joins, lambda e: F.struct(e.alias("e"), now["cycle"].alias("at"))))
        return F.slice(both, F.greatest(F.size(both) - keep, F.lit(0)) + 1, keep)

    held = F.aggregate("steps", F.array().cast(f"array<struct<e:{entry},at:{place}>>"), step)
    out = steps.select("run_id", F.posexplode(F.reverse(held)).alias("place", "h"))
    return out.select(
        "run_id", F.col("h.e.label").alias("label"), F.col("h.e.last_seen").alias("last_seen"), F.col("h.at").alias("resolved_in"),
        (F.col("place") + 1).cast("int").alias("place"),
    )


def focused_errors(findings: DataFrame, most: int | None = MAX_FOCUSED) -> DataFrame:
    """Errors of each review to fix next, by category priority then position, with how many are left over."""
    table = F.create_map(*[x for i, name in enumerate(PRIORITY) for x in (F.lit(name), F.lit(i))])
    rank = F.coalesce(F.try_element_at(table, F.col("category")), F.lit(len(PRIORITY)))
    errors = findings.where(F.lower("severity") == "error").withColumn("priority", rank)
    if most is None:
        chosen = numbered(errors, CYCLE, F.struct("priority", _piece()), ["priority", "position"], "place")
    else:
        order = Window.partitionBy(*CYCLE).orderBy("priority", "position")
        chosen = errors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    sizes = errors.groupBy(*[F.col(c).alias(f"_s_{c}") for c in CYCLE]).agg(F.count(F.lit(1)).alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in CYCLE]
    limit = F.col("_all") if most is None else F.least(F.col("_all"), F.lit(most))
    shown = [c for c in chosen.columns if c != "priority"]
    return chosen.join(sizes, same).withColumn("remaining", F.col("_all") - limit).select(*shown, "remaining")


def mentioned_fields(text: Column) -> Column:
    """Snapshot fields whose phrases occur in a text, any case."""
    low = F.lower(text)
    found = []
    for field, phrases in FIELD_HINTS:
        test = mentions(low, phrases[0])
        for phrase in phrases[1:]:
            test = test | mentions(low, phrase)
        found.append(F.when(test, F.lit(field)))
    return F.array_compact(F.array(*found))


def mentioned_categories(text: Column, names=CATEGORY_NAMES) -> Column:
    """Category names written in a text as they are spelled; lower-case words like "other" do not count."""
    return F.array_compact(F.array(*[F.when(mentions(text, name), F.lit(name)) for name in names]))


def authoritative_values(findings: DataFrame, lines: DataFrame, names=CATEGORY_NAMES) -> DataFrame:
    """Each finding with the snapshot values it refers to: field names and (category, group, spend, cap) records.

    ``lines`` are a snapshot's categories with its header beside each. Only categories of the closed list ``names`` can
    be mentioned, so what is read as one scalar is bounded, the facts are read once, and nothing is paired.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("message", "evidence", "revision_instruction") if c in findings.columns]
    text = F.concat_ws(" ", *parts)
    fields = [f for f, _ in FIELD_HINTS if f in lines.schema["header"].dataType.names]
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.col("h")[f].cast("double"))])
    record = F.struct("category", "parent_group", "current_spend", "previous_spend", "suggested_cap")
    known = lines.agg(F.first("header").alias("h"), F.array_sort(F.collect_list(F.when(F.col("category").isin(*names), record))).alias("c"))
    rows = findings.withColumns({"_f": mentioned_fields(text), "_n": mentioned_categories(text, names)})
    rows = rows.withColumn("_s", known.select(F.struct(values.alias("v"), "c")).scalar())
    # The matched names drive the look-ups, so the patterns run once per text and not once per snapshot entry.
    named = F.transform("_n", lambda n: F.filter("_s.c", lambda c: c["category"] == n))
    return rows.withColumns(
        {
            "fields": F.map_from_entries(F.transform("_f", lambda f: F.struct(f, F.try_element_at("_s.v", f)))),
            "categories": F.flatten(named),
        }
    ).drop("_f", "_n", "_s")
