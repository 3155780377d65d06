"""Egress signs of buildings from floors and stair cores, and learned overrides of room signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.rules import JOB, NONE
from wayfind.sources.kept import kept


def floors(rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, floors): a job's levels with a number, in its order, as first written; else LEVEL 1."""
    number = F.regexp_extract(F.coalesce("level", F.lit("")), r"(\d+)", 1)
    real = (number != "") & ~F.coalesce(F.upper(F.trim("room_number")).rlike(vocab.EGRESS_NUMBER), F.lit(False))
    # counted down in plain aggregations, so rooms are not sorted; a room without a floor stands for its job
    labels = rooms.select(*JOB, "seq", F.when(real, number).alias("_key"), F.when(real, F.trim("level")).alias("label")).groupBy(*JOB, "_key", "label").agg(F.min("seq").alias("seq"))
    first = labels.groupBy(*JOB, "_key").agg(F.min_by("label", "seq").alias("label"))
    floor = F.when(F.col("_key").isNotNull(), F.struct(F.col("_key").cast("long").alias("k"), "_key", "label"))
    named = first.groupBy(*JOB).agg(F.transform(F.array_sort(F.collect_list(floor)), lambda x: x["label"]).alias("floors"))
    return named.select(*JOB, F.when(F.size("floors") > 0, F.col("floors")).otherwise(F.array(F.lit("LEVEL 1"))).alias("floors"))


def _core() -> Column:
    n, name = F.upper(F.trim(F.coalesce("room_number", F.lit("")))), F.upper(F.trim("room_name"))
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    bare = F.coalesce(text.blank_to_null(F.regexp_replace(n, r"\d+$", "")), n)
    named = F.when(name.rlike("^STAIR(?:WAY|WELL)?$"), F.coalesce(F.nullif(bare, F.lit("")), F.lit("STAIR-1"))).otherwise(bare)
    return F.coalesce(found(n, r"^S([A-F])\d"), found(n, r"^S(\d{1,2})$"), found(n, r"^STAIR[-\s]?([A-Z0-9]+)"), found(name, r"STAIR(?:WAY|WELL)?\s+([A-Z\d]+)"), named)


def stair_cores(rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, cores, estimated): detected cores, filled up with letters to the profile's number.

    rooms: prepared ones (classified, with the detected building type).
    """
    n, name = F.upper(F.trim(F.coalesce("room_number", F.lit("")))), F.upper(F.trim("room_name"))
    stair = F.col("is_stair") | n.rlike(vocab.EGRESS_STAIR_NUMBER) | name.rlike(vocab.EGRESS_STAIR_NAME)
    group = text.building_type_group(F.col("detected"))
    # distinct cores first: a job's rooms are not gathered
    cores = rooms.select(*JOB, group.alias("type_group"), F.when(stair, _core()).alias("core")).distinct()
    jobs = cores.groupBy(*JOB, "type_group").agg(F.array_sort(F.collect_set("core")).alias("found"))
    least = text.by_type(F.col("type_group"), {k: v[2] for k, v in vocab.PROFILES.items()}, vocab.PROFILES["unknown"][2])
    letters = F.transform(F.sequence(F.lit(1), least), lambda i: F.char(i + 64))
    missing = F.slice(F.array_except(letters, F.col("found")), F.lit(1), F.greatest(least - F.size("found"), F.lit(0)))
    return jobs.select(*JOB, "type_group", F.array_sort(F.concat("found", missing)).alias("cores"), (F.size("found") < least).alias("estimated"))


def egress_signs(rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, sign_type, rule_ref, qty, confidence, floor_label, place) of every job, all within its job."""
    # a job's floors and cores have several readers
    levels = kept(floors(rooms), "floors")
    per_job = kept(stair_cores(rooms).join(levels, JOB), "egress-jobs")
    rescue = text.by_type(F.col("type_group"), {k: v[1] for k, v in vocab.PROFILES.items()}, False)
    exits = text.by_type(F.col("type_group"), vocab.EGRESS_EXITS, 2)
    sure = F.when(F.col("estimated"), 0.70).otherwise(1.00)
    at = lambda t, rule, qty, c, place: F.struct(F.lit(t).alias("sign_type"), F.lit(rule).alias("rule_ref"), F.lit(qty).alias("qty"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"), place.alias("place"))
    each = per_job.select("*", F.explode("cores").alias("core")).select("*", F.posexplode("floors").alias("i", "floor_label"))
    place = lambda prefix: F.concat(F.lit(prefix), F.col("core"), F.lit("-L"), (F.col("i") + 1).cast("string"))
    stairs = F.array(at("Stair (Corridor)", "R11", 1, sure, place("STAIR-")), at("Stair (Landing)", "R11", 1, sure, place("STAIR-")), at("Exit", "R9", 1, 0.90, place("EXIT-STAIR-")))
    with_rescue = F.when(rescue, F.concat(stairs, F.array(at("Area of Rescue", "R16", 2, 0.85, place("AOR-STAIR-"))))).otherwise(stairs)
    inside = each.select(*JOB, "floor_label", F.inline(with_rescue))
    outside = per_job.select(*JOB, F.get("floors", F.lit(0)).alias("floor_label"), F.explode(F.sequence(F.lit(1), exits)).alias("e")).select(*JOB, "floor_label", F.lit("Exit").alias("sign_type"), F.lit("R9").alias("rule_ref"), F.lit(1).alias("qty"), F.lit(0.70).alias("confidence"), F.concat(F.lit("EXIT-EXT-"), F.col("e").cast("string")).alias("place"))
    full = rooms.filter("is_assembly and not is_mep").select(*JOB, F.col("level").alias("floor_label"), F.lit("Max Occupancy").alias("sign_type"), F.lit("R10").alias("rule_ref"), F.lit(1).alias("qty"), F.lit(0.85).alias("confidence"), F.lit(None).cast("string").alias("place"))
    return inside.unionByName(outside).unionByName(full).unionByName(evacuation_places(rooms, levels))


def evacuation_places(rooms: DataFrame, levels: DataFrame) -> DataFrame:
    """Evacuation maps: the first few decision points of each floor by its shown label, else one estimated place. levels: the
    jobs' ``floors``."""
    group = text.building_type_group(F.col("detected"))
    most = text.by_type(group, {k: v[0] for k, v in vocab.PROFILES.items()}, vocab.PROFILES["unknown"][0])
    jobs = levels.join(rooms.groupBy(*JOB).agg(F.count_if(~F.col("is_mep")).alias("occupied")), JOB).filter((F.size("floors") > 1) | (F.col("occupied") >= 10))
    labels = jobs.select(*JOB, F.posexplode("floors").alias("i", "floor_label"))
    point = F.col("is_corridor") | F.upper(F.trim("room_name")).rlike(vocab.DECISION_POINT)
    nth = F.row_number().over(Window.partitionBy(*JOB, "level").orderBy("seq"))
    chosen = rooms.filter(point).select(*JOB, "seq", F.col("level").alias("floor_label"), most.alias("most"), nth.alias("nth")).filter(F.col("nth") <= F.col("most"))
    placed = labels.join(chosen, [*JOB, "floor_label"], "left")
    return placed.select(*JOB, "floor_label", F.lit("Evacuation Map").alias("sign_type"), F.lit("R13").alias("rule_ref"), F.lit(1).alias("qty"), F.when(F.col("seq").isNull(), 0.60).otherwise(0.85).alias("confidence"), F.when(F.col("seq").isNull(), F.concat(F.lit("EVAC-L"), (F.col("i") + 1).cast("string"))).otherwise(F.col("seq").cast("string")).alias("place"))


# ---- overrides ----

#: Overrides up to this many are broadcast; more are joined by a shuffle on the tenant.
MAX_BROADCAST_OVERRIDES = 50_000
_FLAGS = {"is_restroom": "is_restroom", "is_corridor": "is_corridor", "is_residential_unit": "is_unit", "is_vehicle_bay": "is_vehicle_bay", "is_mep_unoccupied": "is_mep"}


def _matches() -> Column:
    """Whether an override's condition (columns c_...) holds for a room; conditions that are null do not count."""
    name = F.lower(F.trim("room_name"))
    unless = lambda c, test: F.col(c).isNull() | test
    p = F.lower(F.trim("c_pattern"))
    words = F.filter(F.split(p, r"\s+"), lambda w: F.length(w) > 2)
    by_words = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(name, w))
    pattern = (p != "") & ((name == p) | ((F.length(p) >= 3) & F.contains(name, p)) | by_words)
    out = unless("c_contains", F.contains(F.upper("room_name"), F.upper("c_contains"))) & unless("c_number", F.upper("room_number") == F.upper("c_number")) & unless("c_pattern", pattern)
    out = out & unless("c_group", F.upper(F.coalesce("occupancy_group", F.lit(""))) == F.upper("c_group"))
    for condition, flag in _FLAGS.items():
        out = out & unless(f"c_{condition}", F.col(flag) == F.col(f"c_{condition}"))
    return out


DROPPED = "array<struct<sign_type: string, qty: int, rule_ref: string, confidence: double, reason: string>>"


def told(signs: Column, reason: str) -> Column:
    """The signs with the reason why they are dropped."""
    return F.transform(signs, lambda x: F.struct(x["sign_type"].alias("sign_type"), x["qty"].alias("qty"), x["rule_ref"].alias("rule_ref"), x["confidence"].alias("confidence"), F.lit(reason).alias("reason"))).cast(DROPPED)


_STEPS = "array<struct<o_seq: bigint, override_type: string, sign_type: string, qty: int, rule_ref: string, confidence: double>>"


def _override_key() -> Column:
    """What a room must have to meet an override: its number, three letters of its name, a short name, or nothing."""
    p, c = F.lower(F.trim("c_pattern")), F.upper("c_contains")
    word = F.get(F.filter(F.split(p, r"\s+"), lambda w: F.length(w) > 2), F.lit(0))
    by_pattern = F.when(word.isNotNull(), F.concat(F.lit("l:"), F.substring(word, 1, 3))).when(F.length(p) >= 3, F.concat(F.lit("l:"), F.substring(p, 1, 3))).otherwise(F.concat(F.lit("="), p))
    by_part = F.when(F.length(c) >= 3, F.concat(F.lit("u:"), F.substring(c, 1, 3)))
    return F.when(F.col("c_number").isNotNull(), F.concat(F.lit("#"), F.upper("c_number"))).when(p.isNotNull(), by_pattern).otherwise(F.coalesce(by_part, F.lit("*")))


def _name_keys() -> Column:
    def threes(kind: str, name: Column) -> Column:
        return F.when(F.length(name) >= 3, F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.concat(F.lit(kind), F.substring(name, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    name = F.coalesce("room_name", F.lit(""))
    low = F.lower(F.trim(name))
    return F.array_distinct(F.concat(threes("l:", low), threes("u:", F.upper(name)), F.array(F.concat(F.lit("="), low), F.lit("*"))))


def _counting(steps: Column) -> Column:
    """The steps that count: of those that add, the two most confident."""
    adding = lambda s: F.coalesce(s["override_type"].isin("add", "sign_type"), F.lit(False))
    ranked = F.array_sort(F.transform(F.filter(steps, adding), lambda s: F.struct(F.coalesce(-s["confidence"], F.lit(float("inf"))).alias("c"), s["o_seq"].alias("q"), s.alias("s"))))
    return F.concat(F.filter(steps, lambda s: ~adding(s)), F.transform(F.slice(ranked, 1, 2), lambda r: r["s"]))


def apply_overrides(rooms: DataFrame, overrides: DataFrame) -> DataFrame:
    """(tenant_id, job_id, seq, signs) after the tenant's overrides in the order of their seq.

    rooms: classified, with signs (array) and occupancy_group. overrides: tenant_id, seq, rule_ref, override_type,
    sign_type, qty, confidence and the conditions c_contains, c_pattern, c_number, c_group and c_<flag>. Of the
    overrides that add, the two most confident count. A sign_type override takes the place of all signs and ends
    the list, if its type is a canonical one (Max Occupancy: in assembly rooms only).
    """
    return overridden(rooms, overrides).select(*JOB, "seq", "signs")


def overridden(rooms: DataFrame, overrides: DataFrame) -> DataFrame:
    """``apply_overrides`` with all columns of rooms and ``dropped``: the signs that overrides took away, each with its reason,
    ``excluded`` or ``replaced``."""
    o = overrides.withColumnRenamed("seq", "o_seq").withColumnsRenamed({"rule_ref": "o_rule", "sign_type": "o_type", "qty": "o_qty", "confidence": "o_confidence"})
    o = o.filter(F.coalesce("o_type", F.lit("")) != "").withColumn("_key", _override_key())
    o = F.broadcast(o) if o.count() <= MAX_BROADCAST_OVERRIDES else o
    step = F.struct("o_seq", "override_type", F.col("o_type").alias("sign_type"), F.col("o_qty").cast("int").alias("qty"), F.col("o_rule").alias("rule_ref"), F.col("o_confidence").cast("double").alias("confidence"))
    # conditions on a number meet rooms by it
    numbered = rooms.withColumn("_key", F.concat(F.lit("#"), F.upper("room_number"))).join(o.filter("c_number is not null"), ["tenant_id", "_key"]).filter(_matches())
    by_number = numbered.groupBy(*JOB, "seq").agg(F.array_sort(F.collect_list(step)).alias("_by_number"))
    # rooms of a tenant that are alike in all that matters here are one kind: it is met and folded once
    shared = ["room_name", "occupancy_group", *dict.fromkeys(_FLAGS.values())]
    alike = ["tenant_id", *dict.fromkeys([*shared, "is_assembly"]), "signs", "_by_number"]
    met_rooms = rooms.withColumn("signs", F.col("signs").cast(NONE)).join(by_number, [*JOB, "seq"], "left")
    kinds = kept(met_rooms.select(*alike).distinct(), "kinds")
    named = kinds.select("tenant_id", *shared).distinct().withColumn("room_number", F.lit(None).cast("string"))
    met = named.withColumn("_key", F.explode(_name_keys())).join(o.filter("c_number is null"), ["tenant_id", "_key"]).filter(_matches())
    by_name = met.groupBy("tenant_id", *shared).agg(_counting(F.collect_list(step)).alias("_by_name"))
    by_name = by_name.withColumnsRenamed({c: f"_{c}" for c in ("tenant_id", *shared)})
    same = F.lit(True)
    for c in ("tenant_id", *shared):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    none = F.array().cast(_STEPS)
    joined = kinds.join(by_name, same, "left")
    joined = joined.withColumn("steps", F.array_sort(_counting(F.concat(F.coalesce("_by_number", none), F.coalesce("_by_name", none)))))
    assembly = F.col("is_assembly")

    def fold(state: Column, s: Column) -> Column:
        signs, kind, of_type = state["signs"], s["override_type"], s["sign_type"]
        new = F.array(F.struct(of_type.alias("sign_type"), s["qty"].alias("qty"), s["rule_ref"].alias("rule_ref"), s["confidence"].alias("confidence")))
        valid = of_type.isin(*vocab.CANONICAL) & ((of_type != "Max Occupancy") | assembly)
        changed = (
            F.when(state["done"], signs)
            .when(kind == "add", F.concat(signs, new))
            .when(kind == "exclude", F.filter(signs, lambda x: x["sign_type"] != of_type))
            .when(kind == "modify_qty", F.transform(signs, lambda x: F.struct(x["sign_type"].alias("sign_type"), F.when(x["sign_type"] == of_type, s["qty"]).otherwise(x["qty"]).alias("qty"), x["rule_ref"].alias("rule_ref"), x["confidence"].alias("confidence"))))
            .when((kind == "sign_type") & valid, new)
            .otherwise(signs)
        )
        replaced = (kind == "sign_type") & valid
        gone = F.when(~state["done"] & (kind == "exclude"), told(F.filter(signs, lambda x: x["sign_type"] == of_type), "excluded")).when(~state["done"] & replaced, told(signs, "replaced")).otherwise(F.array().cast(DROPPED))
        return F.struct(changed.cast(NONE).alias("signs"), (state["done"] | replaced).alias("done"), F.concat(state["dropped"], gone).alias("dropped"))

    start = F.struct(F.col("signs").cast(NONE).alias("signs"), F.lit(False).alias("done"), F.array().cast(DROPPED).alias("dropped"))
    folded = joined.withColumn("_folded", F.aggregate("steps", start, fold)).select(*(F.col(c).alias(f"_{c}") for c in alike), F.col("_folded.signs").alias("_new"), F.col("_folded.dropped").alias("dropped"))
    folded = kept(folded, "overridden")
    folded = F.broadcast(folded) if folded.count() <= MAX_BROADCAST_OVERRIDES else folded
    of_kind = F.lit(True)
    for c in alike:
        of_kind = of_kind & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return met_rooms.join(folded, of_kind).select(*(c for c in rooms.columns if c != "signs"), F.col("_new").alias("signs"), "dropped")
