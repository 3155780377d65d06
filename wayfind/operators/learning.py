"""Mining of corrections, overrides, trends, model cost, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.sources.kept import kept, numbered


def mine_patterns(corrections: DataFrame, least: int = 2, approve_from: int = 3, examples: int = 5) -> DataFrame:
    """(tenant_id, correction_type, pattern, sign_type, evidence, status, example_jobs) of active corrections.

    Junk patterns go before the shuffle; of the jobs only the first five by id are ever gathered, so a hot pattern
    does not collect all of its jobs.
    """
    pattern = F.coalesce(F.upper(F.trim("room_name_pattern")), F.lit(""))
    rows = corrections.filter("is_active").withColumn("pattern", pattern).withColumn("sign_type", F.coalesce("sign_type", F.lit(""))).filter((F.length("pattern") >= 3) & ~text.is_schedule_row_name(F.col("pattern")))
    key = ["tenant_id", "correction_type", "pattern", "sign_type"]
    per_job = rows.groupBy(*key, "job_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("job_id"))
    ranked = per_job.withColumn("place", place)
    found = ranked.groupBy(*key).agg(F.sum("n").alias("evidence"), F.sort_array(F.collect_list(F.when(F.col("place") <= examples, F.col("job_id")))).alias("example_jobs"))
    return found.filter(F.col("evidence") >= least).withColumn("status", F.when(F.col("evidence") >= approve_from, "approved").otherwise("pending"))


def pattern_texts(mined: DataFrame) -> DataFrame:
    """Mined patterns with a description and what to do about them, for one room name or, where there is none, all rooms."""
    room, sign, kind = F.trim(F.coalesce("pattern", F.lit(""))), F.col("sign_type"), F.col("correction_type")
    times = F.concat(F.col("evidence").cast("string"), F.when(F.col("evidence") == 1, " occurrence").otherwise(" occurrences"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    p = F.col("pattern")
    described = F.when(room != "", say("'", p, "' \u2192 ", sign, " (", times, ")")).otherwise(say(sign, " \u2014 ", times, " across all rooms"))
    fixes = [
        (kind.isin("sign_type_mismatch", "edit"), say("When room name is '", p, "', assign '", sign, "' instead of pipeline default"), say("'", sign, "' sign type is frequently corrected \u2014 review pipeline default assignment")),
        (kind.isin("ai_missed", "add"), say("Room pattern '", p, "' requires a '", sign, "' sign \u2014 add to extraction rules"), say("'", sign, "' signs are frequently added manually \u2014 verify AI extraction covers this type")),
        (kind.isin("ai_extra", "delete"), say("Room pattern '", p, "' is being over-detected \u2014 exclude from '", sign, "' assignment"), say("'", sign, "' signs are frequently removed \u2014 AI may be over-generating this type")),
        (kind == "sign_type_override", say("When room name is '", p, "', assign '", sign, "' instead of pipeline default"), say("'", sign, "' sign type is frequently overridden \u2014 review pipeline rules")),
        (F.lit(True), say("Review '", p, "' \u2192 '", sign, "' pattern (", kind, ")"), say("'", sign, "' correction pattern (", kind, ") \u2014 review pipeline rules")),
    ]
    return mined.withColumns({"description": described, "suggested_fix": text.first_of(*((when, F.when(room != "", one).otherwise(every)) for when, one, every in fixes))})


def upsert_overrides(corrections: DataFrame, existing: DataFrame) -> DataFrame:
    """Overrides after corrections: a new one starts at 0.8, an existing one gains 0.05 up to 0.99.

    existing: tenant_id, rule_ref, confidence, source_corrections.
    """
    slug = F.concat(F.lit("learned:"), text.sign_type_slug(F.concat_ws("_", "sign_type", "room_name_pattern")))
    new = corrections.filter("is_active").groupBy("tenant_id", slug.alias("rule_ref")).agg(F.count(F.lit(1)).alias("n"))
    both = existing.join(new, ["tenant_id", "rule_ref"], "full_outer")
    confidence = F.when(F.col("confidence").isNull(), 0.8).when(F.col("n").isNull(), F.col("confidence")).otherwise(F.least(F.col("confidence") + 0.05, F.lit(0.99)))
    return both.select("tenant_id", "rule_ref", F.round(confidence, 3).alias("confidence"), (F.coalesce("source_corrections", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("source_corrections"))


def corrections_per_week(corrections: DataFrame) -> DataFrame:
    """Corrections of each tenant and week, with the change against the week before that has any."""
    weeks = corrections.groupBy("tenant_id", F.date_trunc("week", "created_at").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("tenant_id").orderBy("week")))


def top_corrections(corrections: DataFrame, k: int = 10) -> DataFrame:
    """The ten most frequent (type, sign type, pattern) of each tenant."""
    key = ["correction_type", "sign_type", "room_name_pattern"]
    counts = corrections.groupBy("tenant_id", *key).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("n"), *key))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def accuracy_snapshots(delta: DataFrame) -> DataFrame:
    """Per job: matched, missed, extra, accuracy, and the mean accuracy of the tenant."""
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    jobs = delta.groupBy("tenant_id", "job_id").agg(n("matched"), n("missed"), n("extra"))
    accuracy = F.col("matched") / (F.col("matched") + F.col("missed") + F.col("extra"))
    scored = jobs.withColumn("accuracy", accuracy)
    return scored.join(scored.groupBy("tenant_id").agg(F.avg("accuracy").alias("tenant_accuracy")), "tenant_id")


def model_cost(scans: DataFrame) -> DataFrame:
    """Per tenant and kind of call: calls, jobs, cost, mean cost of a job."""
    out = scans.groupBy("tenant_id", "call_type").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("job_id").alias("jobs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    total = F.round(text.scan_cost(F.col("input_tokens"), F.col("output_tokens")), 6)
    return out.withColumn("cost", total).withColumn("cost_per_job", F.round(F.col("cost") / F.col("jobs"), 6))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Per operation: count, total, mean and longest time in ms, failures. timings: op, ms, ok."""
    return timings.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.count_if(~F.col("ok")).alias("failures"))


def expired_guests(tenants: DataFrame, children: DataFrame, cutoff, prefix: str = "guest-") -> DataFrame:
    """Rows of children whose guest tenant was last active, or made, before the cutoff."""
    old = tenants.filter(F.col("tenant_id").startswith(prefix) & (F.coalesce("last_active_at", "created_at") < F.lit(cutoff)))
    return children.join(old.select("tenant_id"), "tenant_id", "left_semi")


def retained(runs: DataFrame, since, newest: int) -> DataFrame:
    """Runs from a date on, and of those the newest few of each tenant."""
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("seq")))
    return runs.filter(F.col("created_at") >= F.lit(since)).withColumn("place", place).filter(F.col("place") <= newest)


def short_patterns(corrections: DataFrame, least: int = 3) -> DataFrame:
    """Active corrections whose pattern is too short to match safely."""
    return corrections.filter(F.col("is_active") & (F.length(F.trim("room_name_pattern")) < least))


def upsert_patterns(mined: DataFrame, existing: DataFrame) -> DataFrame:
    """Mined patterns over stored ones by their natural key: fresh evidence replaces the old, an approved status
    stays, patterns that were not mined again stay as they are."""
    key = ["tenant_id", "correction_type", "pattern", "sign_type"]
    old = existing.select(*key, F.col("evidence").alias("_old"), F.col("status").alias("_was"))
    both = mined.join(old, key, "full_outer")
    status = F.when(F.col("_was") == "approved", "approved").otherwise(F.coalesce("status", "_was"))
    return both.select(*key, F.coalesce("evidence", "_old").alias("evidence"), status.alias("status"), F.when(F.col("_old").isNull(), "inserted").when(F.col("evidence").isNull(), "kept").otherwise("updated").alias("outcome"))


def training_context(patterns: DataFrame, k: int = 15) -> DataFrame:
    """The best supported approved patterns of each tenant."""
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("evidence"), "pattern", "correction_type", "sign_type"))
    return patterns.filter("status = 'approved'").withColumn("place", place).filter(F.col("place") <= k).select("tenant_id", "correction_type", "pattern", "sign_type", "evidence", "place")


def list_corrections(corrections: DataFrame, since, until, limit: int, offset: int = 0) -> DataFrame:
    """Corrections between two moments, newest first, one page."""
    return corrections.filter(F.col("created_at").between(F.lit(since), F.lit(until))).orderBy(F.desc("created_at"), "seq").offset(offset).limit(limit)


# ---- imports of diffs with human takeoffs: tenant_id, seq, room_name, human_sign_type, skip_overwrite ----


def import_decisions(diffs: DataFrame, corrections: DataFrame, update: bool) -> DataFrame:
    """(tenant_id, room_name_pattern, sign_type, seq, outcome) for the first diff of each pattern and type.

    A stored pair is refreshed or skipped; a stored pattern with another type is a conflict, overwritten or kept; else
    the pair is inserted. Without update stored corrections stay; diffs without name or type go.
    """
    cut = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    key = ["tenant_id", "room_name_pattern", "sign_type"]
    named = diffs.select("tenant_id", cut("room_name").alias("room_name_pattern"), cut("human_sign_type").alias("sign_type"), "seq", F.coalesce("skip_overwrite", F.lit(False)).alias("_skip"))
    first = named.filter("room_name_pattern <> '' and sign_type <> ''").groupBy(*key).agg(F.min("seq").alias("seq"), F.min_by("_skip", "seq").alias("_skip"))
    stored = corrections.filter("room_name_pattern <> ''")
    pairs = stored.filter("sign_type <> ''").select(*key).distinct().withColumn("_pair", F.lit(True))
    names = stored.select(*key[:2]).distinct().withColumn("_name", F.lit(True))
    outcome = text.first_of(
        (F.col("_pair").isNotNull(), F.when(F.lit(update) & ~F.col("_skip"), "refreshed").otherwise("skipped")),
        (F.col("_name").isNotNull(), F.lit("conflict_updated" if update else "conflict_kept")),
        (F.lit(True), F.lit("inserted")),
    )
    return first.join(pairs, key, "left").join(names, key[:2], "left").select(*key, "seq", outcome.alias("outcome"))


def import_counts(decisions: DataFrame) -> DataFrame:
    """Per tenant: how many decisions of each outcome."""
    return decisions.groupBy("tenant_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "refreshed", "skipped", "conflict_updated", "conflict_kept")))


def confirm_import(decisions: DataFrame, corrections: DataFrame) -> DataFrame:
    """(tenant_id, seq, room_name_pattern, sign_type, is_active, outcome): corrections after the import.

    Stored corrections of a pattern that is written anew go inactive, but the last of a refreshed pair is active
    again; inserted ones follow with the number of their diff.
    """
    key = ["tenant_id", "room_name_pattern", "sign_type"]
    written = decisions.filter(F.col("outcome").isin("refreshed", "conflict_updated", "inserted"))
    names = written.select(*key[:2]).distinct().withColumn("_off", F.lit(True))
    refreshed = written.filter("outcome = 'refreshed'").select(*key)
    last = corrections.join(refreshed, key).groupBy(*key).agg(F.max("seq").alias("seq")).withColumn("_on", F.lit(True))
    stored = corrections.select(*key, "seq", "is_active").join(names, key[:2], "left").join(last, [*key, "seq"], "left")
    outcome = F.when(F.col("_on").isNotNull(), "refreshed").when(F.col("_off").isNotNull() & F.col("is_active"), "deactivated").otherwise("kept")
    old = stored.select(*key, "seq", F.when(F.col("_on").isNotNull(), True).when(F.col("_off").isNotNull(), False).otherwise(F.col("is_active")).alias("is_active"), outcome.alias("outcome"))
    new = written.filter("outcome <> 'refreshed'").select(*key, "seq", F.lit(True).alias("is_active"), F.lit("inserted").alias("outcome"))
    return old.unionByName(new)


# ---- snapshots of imports: tenant_id, job_id, seq, snapshot_date, confidence, accuracy ----


def with_previous(snapshots: DataFrame) -> DataFrame:
    """snapshots with the confidence of the tenant's snapshot before and the change against it.

    The neighbour is found by a running number over all tenants, so a tenant with very many snapshots is dealt over
    tasks like others.
    """
    ordered = numbered(snapshots, ["tenant_id", "snapshot_date", "seq"], "_n")
    before = ordered.select((F.col("_n") + 1).alias("_n"), F.col("tenant_id").alias("_tenant"), F.col("confidence").alias("_before"))
    joined = ordered.join(before, "_n", "left")
    previous = F.when(F.col("_tenant") == F.col("tenant_id"), F.col("_before"))
    return joined.withColumn("previous", previous).withColumn("change", F.round(F.col("confidence") - F.col("previous"), 6)).select(*snapshots.columns, "previous", "change")


def _changes(history: DataFrame) -> DataFrame:
    """(tenant_id, at, active, millionths): by how much each change of an override moves the number of active ones and the
    sum of their confidences. The state before is that of the row before by a running number, so no rule is one task."""
    on = F.when(F.col("is_active"), F.round(F.col("confidence") * 1_000_000).cast("long"))
    ordered = numbered(history.select("tenant_id", "rule_ref", "at", "seq", on.alias("_on")), ["tenant_id", "rule_ref", "at", "seq"], "_n")
    before = ordered.select((F.col("_n") + 1).alias("_n"), F.col("tenant_id").alias("_tenant"), F.col("rule_ref").alias("_rule"), F.col("_on").alias("_was"))
    joined = ordered.join(before, "_n", "left").withColumn("_was", F.when((F.col("_tenant") == F.col("tenant_id")) & (F.col("_rule") == F.col("rule_ref")), F.col("_was")))
    one = lambda c: F.col(c).isNotNull().cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("tenant_id", "at", (one("_on") - one("_was")).alias("active"), (zero("_on") - zero("_was")).alias("millionths"))


def snapshots_as_of(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """snapshots with active_overrides and avg_confidence: how many overrides of the tenant were active at that moment, and
    their mean confidence (0 without any).

    snapshots: tenant_id, seq, at, and more; history: (tenant_id, rule_ref, at, seq, confidence, is_active), an override's
    state from a moment on. Both are dealt by ranges of tenant and time; what a range adds up is passed on to the later
    ranges of the tenant, so a tenant with very many changes is spread over tasks.
    """
    events = _changes(history).select("tenant_id", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), "active", "millionths")
    every = events.unionByName(snapshots.select("tenant_id", "at", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("active"), F.lit(0).cast("long").alias("millionths")))
    order = ["tenant_id", "at", "kind", "seq"]
    n = int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(every.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "as-of")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sums = placed.groupBy("tenant_id", "_part").agg(F.sum("active").alias("a"), F.sum("millionths").alias("m"))
    # a tenant has as many rows here as ranges
    earlier = Window.partitionBy("tenant_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("tenant_id", "_part", F.coalesce(F.sum("a").over(earlier), F.lit(0)).alias("_a"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("_m"))
    within = Window.partitionBy("tenant_id", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"_run": F.sum("active").over(within), "_sum": F.sum("millionths").over(within)}).filter("kind = 1")
    total = run.join(ahead, ["tenant_id", "_part"]).select("tenant_id", "seq", (F.col("_run") + F.col("_a")).alias("active_overrides"), (F.col("_sum") + F.col("_m")).alias("_total"))
    mean = F.when(F.col("active_overrides") > 0, F.round(F.col("_total") / F.col("active_overrides") / 1_000_000, 4)).otherwise(0.0)
    return snapshots.join(total.select("tenant_id", "seq", "active_overrides", mean.alias("avg_confidence")), ["tenant_id", "seq"])


def snapshots_with_weeks(snapshots: DataFrame, corrections: DataFrame, since, until) -> DataFrame:
    """Snapshots between two moments that have a confidence, with the number of corrections in the same week (Monday on) and
    the same span. snapshots: tenant_id, seq, at, avg_confidence; corrections: tenant_id, created_at."""
    week = lambda c: F.date_trunc("week", c).cast("date")
    inside = lambda c: F.col(c).between(F.lit(since), F.lit(until))
    weeks = corrections.filter(inside("created_at")).groupBy("tenant_id", week("created_at").alias("_week")).agg(F.count(F.lit(1)).alias("_n"))
    rows = snapshots.filter(inside("at") & (F.col("avg_confidence") > 0)).withColumn("_week", week("at"))
    return rows.join(weeks, ["tenant_id", "_week"], "left").withColumn("correction_count", F.coalesce("_n", F.lit(0))).drop("_week", "_n")


def confidence_trend(snapshots: DataFrame, jobs: DataFrame, since, until) -> DataFrame:
    """Snapshots between two days that have a confidence, with the building type of their job."""
    own = jobs.select("tenant_id", "job_id", "building_type")
    return snapshots.filter(F.col("snapshot_date").between(F.lit(since), F.lit(until)) & (F.col("confidence") > 0)).join(own, ["tenant_id", "job_id"], "left")


def override_impact(overrides: DataFrame, corrections: DataFrame, month) -> DataFrame:
    """Per tenant: overrides, active ones, corrections from the start of a month on. overrides: tenant_id, is_active."""
    ours = overrides.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("overrides"), F.count_if("is_active").alias("active_overrides"))
    recent = corrections.groupBy("tenant_id").agg(F.count_if(F.col("created_at") >= F.lit(month)).alias("corrections_this_month"))
    return ours.join(recent, "tenant_id", "full_outer").fillna(0, ["overrides", "active_overrides", "corrections_this_month"])


def training_health(snapshots: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per tenant: validated jobs, their mean accuracy, approved patterns."""
    scored = snapshots.filter("accuracy is not null").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("validated_jobs"), F.avg("accuracy").alias("mean_accuracy"))
    approved = patterns.filter("status = 'approved'").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("patterns_active"))
    return scored.join(approved, "tenant_id", "full_outer").fillna(0, ["validated_jobs", "mean_accuracy", "patterns_active"])


def example_jobs(snapshots: DataFrame, jobs: DataFrame, k: int = 3) -> DataFrame:
    """The most accurate snapshots of each tenant and building type."""
    typed = snapshots.filter("accuracy is not null").join(jobs.select("tenant_id", "job_id", "building_type"), ["tenant_id", "job_id"])
    place = F.row_number().over(Window.partitionBy("tenant_id", "building_type").orderBy(F.desc("accuracy"), "seq"))
    return typed.withColumn("place", place).filter(F.col("place") <= k).select("tenant_id", "building_type", "job_id", "accuracy", "place")


def cost_since_first_snapshot(scans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per tenant: cost of the model calls from its first snapshot on (all, without one), distinct jobs, mean."""
    first = snapshots.groupBy("tenant_id").agg(F.min("snapshot_date").alias("first_date"))
    seen = scans.join(first, "tenant_id", "left").filter(F.col("first_date").isNull() | (F.col("created_at") >= F.col("first_date")))
    sums = seen.groupBy("tenant_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count_distinct("job_id").alias("jobs"), F.first("first_date").alias("first_date"))
    out = sums.withColumn("cost", F.round(text.scan_cost(F.col("i"), F.col("o")), 6))
    return out.select("tenant_id", "jobs", "cost", F.round(F.col("cost") / F.col("jobs"), 6).alias("cost_per_job"), "first_date")


def history_totals(runs: DataFrame) -> DataFrame:
    """Per tenant: runs in the history, their quantity, the last one's moment."""
    return runs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("removed").alias("removed"), F.max("created_at").alias("last_run"))
