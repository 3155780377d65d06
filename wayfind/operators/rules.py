"""Sign rules: rooms and jobs in, signs out. Everything is keyed by tenant and job; a job's facts come from one
grouped aggregation joined back, and per-room rules are arrays of sign structs, so a room is read once. What a room's name tells is computed once for each
distinct name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.sources.kept import kept, read_from

JOB = ["tenant_id", "job_id"]


def looked_up(df: DataFrame, key: str, columns) -> DataFrame:
    """df with columns that depend on one text column alone: computed once for each distinct text (names and levels
    repeat massively) and joined back. The texts are a table of their own, so that Spark sees its size and broadcasts
    it, or else can split the rows of a frequent text."""
    return _told(df, key, _texts(df, key, columns))


def _texts(df: DataFrame, key: str, columns) -> DataFrame:
    found = df.select(F.col(key).alias("_text")).distinct().select("_text", *(c.alias(n) for n, c in columns(F.col("_text")).items()))
    return kept(found, f"texts-{key}")


def _told(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    return df.join(found, F.col(key).eqNullSafe(F.col("_text")), "left").drop("_text")


def classify_rooms(rooms: DataFrame) -> DataFrame:
    """rooms with a flag column for each kind and the canonical level."""
    named = looked_up(rooms, "room_name", text.room_flags)
    levelled = looked_up(named, "level", lambda c: {"_level": text.normalize_level(c)})
    return levelled.withColumn("level", F.col("_level")).drop("_level")


def _name_patterns(name: Column) -> dict[str, Column]:
    """What the rules ask of a room's name, beside its flags."""
    upper, known, trimmed = F.upper(name), F.upper(F.coalesce(name, F.lit(""))), F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return {
        "_units": known.rlike(vocab.UNIT_NAMED),
        "_hotel_room": known.rlike(vocab.HOTEL_ROOM),
        "_hotel_lobby": known.rlike(vocab.HOTEL_LOBBY),
        "_hotel_desk": known.rlike(vocab.HOTEL_DESK),
        **{f"_by_{k}": known.rlike(p) for k, p in vocab.TYPE_WORDS},
        "_suite": trimmed.rlike(vocab.SUITE),
        "_lobby_or_entry": trimmed.rlike(vocab.LOBBY_OR_ENTRY),
        "_unit_or_apt": trimmed.rlike(vocab.UNIT_OR_APT),
        "_multi_entry": upper.rlike(vocab.MULTI_ENTRY),
        "_dorm": upper.rlike(vocab.DORM),
        "_residential_common": upper.rlike(vocab.RESIDENTIAL_COMMON),
        "_two_sided": upper.contains("/") | upper.rlike(vocab.ASSEMBLY),
        "_womens": upper.rlike(vocab.WOMENS),
        "_mens": upper.rlike(vocab.MENS),
        "_capacity": F.lower(name).rlike(vocab.CAPACITY),
        "_lobby": F.upper(F.trim(name)).rlike(r"\bLOBBY\b") & ~F.upper(F.trim(name)).rlike("CORRIDOR|HALL|VEST|OFFICE|JAN"),
        "_lobby_first": F.upper(F.trim(name)).rlike(r"^LOBBY\b"),
        "_schedule_row": text.is_schedule_row_name(name),
        "_anchor": upper.rlike(vocab.EDUCATION_ANCHOR),
        "_cluster": upper.rlike(vocab.EXIT_CLUSTER),
    }


def _patterned(rooms: DataFrame) -> DataFrame:
    return rooms if "_cluster" in rooms.columns else looked_up(rooms, "room_name", _name_patterns)


def _type_facts() -> list[Column]:
    """What a job's type is told by: counts over its rooms with their name patterns."""
    hotel = F.bool_or("_hotel_room") & F.bool_or("_hotel_lobby") & F.bool_or("_hotel_desk")
    return [F.avg(F.col("_units").cast("double")).alias("units"), hotel.alias("hotel"), *(F.bool_or(f"_by_{k}").alias(f"by_{k}") for k, _ in vocab.TYPE_WORDS)]


def _detected(given: Column) -> Column:
    by_rooms = text.first_of((F.col("units") > 0.3, "residential"), (F.col("hotel"), "hotel"), *((F.col(f"by_{k}"), k) for k, _ in vocab.TYPE_WORDS), (F.lit(True), "commercial"))
    low = F.lower(F.trim(given))
    return F.coalesce(F.when(low.isin(*(t for t in vocab.TRAITS if t != "unknown")), low), by_rooms)


def detect_building_type(rooms: DataFrame, jobs: DataFrame) -> DataFrame:
    """(tenant_id, job_id, detected): a job's known type, else the type that its room names point to."""
    facts = _patterned(rooms).groupBy(*JOB).agg(*_type_facts())
    return jobs.join(facts, JOB, "left").select(*JOB, _detected(F.col("building_type")).alias("detected"))


_TRAIT_NAMES = ("has_units", "mep_policy", "assembly_rules", "has_directory", "elevator_mode", "area_of_rescue")


def with_traits(df: DataFrame, type_col: str = "detected") -> DataFrame:
    """df with the traits of its building type (commercial ones for a type without traits)."""
    return df.withColumns({n: text.by_type(F.col(type_col), {t: v[i] for t, v in vocab.TRAITS.items()}, vocab.TRAITS["commercial"][i]) for i, n in enumerate(_TRAIT_NAMES)})


#: Numbers of units: with a letter, in all buildings with units; without one, in residential ones.
_LETTERED, _PLAIN = r"^\d{2,4}[A-Z]$", r"^\d{3,4}$"


def _unit_by_number(number: Column, kind: Column) -> Column:
    n = F.upper(F.trim(number))
    return (kind.isin(*vocab.UNIT_SIGN_TYPES) & n.rlike(_LETTERED)) | ((kind == "residential") & n.rlike(_PLAIN))


def job_facts(rooms: DataFrame, jobs: DataFrame, detect: bool = True) -> DataFrame:
    """One row a job: its type with traits, floors, directory eligibility, unit dominance, residential scope.

    rooms: classified, with name patterns. Everything comes from one aggregation: what depends on the job's type is counted for
    both kinds of unit numbers, and chosen when the type is known.
    """
    n = F.upper(F.trim("room_number"))
    lettered = F.col("is_unit") | n.rlike(_LETTERED)
    counts = rooms.groupBy(*JOB).agg(
        *_type_facts(),
        F.greatest(F.count_distinct(F.when(F.trim("level") != "", F.col("level"))), F.lit(1)).alias("floors"),
        F.count(F.lit(1)).alias("n_rooms"),
        F.count_if("_suite").alias("suites"),
        F.count_if(~F.col("is_mep") & ~F.col("is_door_schedule_entry")).alias("occupied"),
        F.bool_or("_lobby_or_entry").alias("lobby"),
        F.count_if("_unit_or_apt").alias("unit_names"),
        F.count_if(lettered).alias("lettered_units"),
        F.count_if(lettered | n.rlike(_PLAIN)).alias("all_units"),
    )
    stated = F.coalesce(F.nullif("building_type", F.lit("")), F.lit("commercial"))
    typed = jobs.join(counts, JOB).withColumn("detected", _detected(F.col("building_type")) if detect else stated)
    many = lambda c: (c >= 5) & (c / F.col("n_rooms") >= 0.3)
    units = F.when(F.col("detected") == "residential", F.col("all_units")).otherwise(F.col("lettered_units"))
    out = with_traits(typed).withColumns({
        "directory_eligible": F.col("has_directory") & ((F.col("suites") >= 3) | ((F.col("occupied") > 30) & F.col("lobby"))),
        "unit_dominant": many(F.col("unit_names")),
        "residential_scope": F.col("detected").isin(*vocab.RESIDENTIAL_TYPES) & many(units),
    })
    return out.select(*JOB, "detected", *_TRAIT_NAMES, "floors", "n_rooms", "directory_eligible", "unit_dominant", "residential_scope")


def door_counts(rooms: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """rooms with ``_doors``: the stated public_door_count if it is above 0, else 3 for rooms that names or a tenant's own
    keywords tell to have several entries, else 1.

    keywords: (tenant_id, keyword), literal words that an administrator lists; blank ones count for nothing. Those of a
    tenant become one pattern, which is looked for in its distinct room names.
    """
    several = F.col("_multi_entry") if "_multi_entry" in rooms.columns else F.upper("room_name").rlike(vocab.MULTI_ENTRY)
    several = F.coalesce(several, F.lit(False))
    out = rooms
    if keywords is not None:
        word = F.upper(F.trim("keyword"))
        escaped = F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1")
        edge = lambda end: F.when(word.rlike(end), r"\b").otherwise("")
        own = keywords.filter(F.trim("keyword") != "").select("tenant_id", F.concat(edge(r"^\w"), escaped, edge(r"\w$")).alias("_p")).distinct()
        patterns = own.groupBy("tenant_id").agg(F.array_join(F.sort_array(F.collect_list("_p")), "|").alias("_p"))
        names = rooms.select("tenant_id", "room_name").distinct().join(patterns, "tenant_id").filter(F.rlike(F.upper("room_name"), F.col("_p")))
        # written, so that its size decides whether rooms are shuffled by their name, of which there may be few
        names = kept(names.select("tenant_id", "room_name", F.lit(True).alias("_own")), "own-doors")
        out = rooms.join(names, ["tenant_id", "room_name"], "left")
        several = several | F.coalesce("_own", F.lit(False))
    stated = F.col("public_door_count") if "public_door_count" in rooms.columns else F.lit(None).cast("int")
    doors = F.when(stated > 0, stated.cast("int")).when(several, 3).otherwise(1)
    return out.withColumn("_doors", doors).select(*rooms.columns, "_doors")


def prepared(rooms: DataFrame, jobs: DataFrame, keywords: DataFrame | None = None, detect: bool = True) -> DataFrame:
    """Classified rooms with building type, traits, doors and the job's facts. keywords: see ``door_counts``. Without detect,
    a job's type is the one it has, or commercial, whatever its rooms are called."""
    return _prepared(rooms, jobs, _texts(rooms, "room_name", _name_facts), keywords, detect)


def prepared_once(rooms: DataFrame, jobs: DataFrame, keywords: DataFrame | None = None, detect: bool = True) -> DataFrame:
    """``prepared``, written for several readers: without the many columns that a room's name or building type tell. These are
    joined again on reading, as far as a reader asks for them."""
    names = _texts(rooms, "room_name", _name_facts)
    ready = _prepared(rooms, jobs, names, keywords, detect)
    lean = kept(ready.drop(*names.columns, *_TRAIT_NAMES), "prepared")
    return read_from(lean, with_traits(_told(lean, "room_name", names)).select(*ready.columns))


def _name_facts(name: Column) -> dict[str, Column]:
    return text.room_flags(name) | _name_patterns(name)


def _prepared(rooms: DataFrame, jobs: DataFrame, names: DataFrame, keywords: DataFrame | None, detect: bool) -> DataFrame:
    classified = looked_up(_told(rooms, "room_name", names), "level", lambda c: {"_level": text.normalize_level(c)}).withColumn("level", F.col("_level")).drop("_level")
    classified = door_counts(classified, keywords)
    # one row a job, written so that its size decides whether rooms are shuffled at all
    facts = kept(job_facts(classified, jobs, detect), "facts")
    # patterns that tell the job's type have done their work
    return classified.drop("_units", "_hotel_room", "_hotel_lobby", "_hotel_desk", *(f"_by_{k}" for k, _ in vocab.TYPE_WORDS)).join(facts, JOB)


def _sign(sign_type, qty, rule: str, confidence: float) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(sign_type).alias("sign_type"), c(qty).cast("int").alias("qty"), F.lit(rule).alias("rule_ref"), F.lit(float(confidence)).alias("confidence"))


NONE = "array<struct<sign_type: string, qty: int, rule_ref: string, confidence: double>>"


def _signs(*cases: tuple[Column, list[Column]]) -> Column:
    none = F.array().cast(NONE)
    out = None
    for condition, signs in cases:
        value = F.array(*signs) if signs else none
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(none)


def room_id_signs() -> Column:
    """R1 to R7 and R16: the room's own identification."""
    kind = F.col("detected")
    unit = F.col("is_unit") | F.col("_unit_number")
    doors = F.col("_doors")
    mep, load, dorm = F.col("is_mep"), F.coalesce("occupant_load", F.lit(0)), F.col("_dorm")
    insert = F.when(F.col("_two_sided"), 2).otherwise(1)
    return _signs(
        (F.col("is_corridor"), []),
        (F.col("residential_scope") & ~unit & ~F.col("_residential_common") & ~mep, []),
        (F.col("is_vehicle_bay") & (doors >= 3), [_sign("Room ID", doors, "R3", 0.60)]),
        (F.col("is_vehicle_bay"), []),
        (mep & ((F.col("mep_policy") == "minimal") | ((F.col("mep_policy") == "occupied_only") & (load == 0))), []),
        (F.col("is_stair") | F.col("is_elevator"), []),
        (~dorm & ~F.col("is_variable_use") & (doors > 1), [_sign("Room ID", doors, "R3", 0.60)]),
        (F.col("is_variable_use") & ~dorm & F.col("assembly_rules"), [_sign("Room ID w/insert", insert, "R2", 0.80)]),
        (unit & F.col("has_units") & kind.isin(*vocab.UNIT_SIGN_TYPES), [_sign("Room ID", 1, "R16", 0.85)]),
        (F.lit(True), [_sign("Room ID", 1, "R1", 0.85)]),
    )


def restroom_signs() -> Column:
    is_one = F.col("is_restroom") & ~F.col("is_corridor")
    kind = F.when(F.col("_womens"), "Restroom(Women)").when(F.col("_mens"), "Restroom(Men)").otherwise("Restroom")
    return _signs((is_one, [_sign(kind, 1, "R8", 0.9)]))


def exit_signs() -> Column:
    vestibule, public, load = F.col("is_vestibule"), F.col("is_public"), F.coalesce("occupant_load", F.lit(0))
    return _signs(
        (F.col("is_mep") | (~F.col("assembly_rules") & ~vestibule & ~public), []),
        (vestibule, [_sign("Exit", 1, "R9", 0.8), _sign("Exit(Tactile)", 1, "R9", 0.8)]),
        (public & ~F.col("is_corridor"), [_sign("Exit", 1, "R9", 0.75)]),
        (F.col("is_assembly") & (load >= 50), [_sign("Exit", 2, "R9", 0.8)]),
    )


def capacity_signs() -> Column:
    group = F.col("occupancy_group")
    full = F.coalesce(F.upper(group).rlike("^A-?[23]"), F.lit(False)) | (F.coalesce("occupant_load", F.lit(0)) >= 50)
    qty = F.when(F.col("is_variable_use"), 2).otherwise(1)
    return _signs((F.col("assembly_rules") & F.col("is_assembly") & F.col("_capacity") & full, [_sign("Room ID w/insert", qty, "R2", 0.80), _sign("Max Occupancy", qty, "R10", 0.8)]))


def directory_signs() -> Column:
    name = F.upper(F.trim("room_name"))
    place = F.col("directory_eligible") & F.col("_lobby")
    main = (name == "LOBBY") | (F.col("is_public") & F.col("_lobby_first"))
    sign = lambda t: _sign(t, 1, "R14", 0.75)
    return _signs((place & main, [sign("Office Directory"), sign("Building ID"), sign("Accessible Entrance")]), (place, [sign("Office Directory")]))


def _finished(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("confidence") >= vocab.AUTO_FROM, "auto").otherwise("needs_review")).withColumn("ada_required", F.col("sign_type").isin(*vocab.ADA_REQUIRED))


def signed_rooms(rooms: DataFrame, every_room: bool = False) -> DataFrame:
    """Prepared rooms with the array of their signs. Rooms that rules skip are left out, or have none."""
    if "occupancy_group" not in rooms.columns:
        rooms = rooms.withColumn("occupancy_group", F.lit(None).cast("string"))
    kind = F.col("detected")
    if "_unit_number" not in rooms.columns:
        rooms = rooms.withColumn("_unit_number", _unit_by_number(F.col("room_number"), kind))
    allowed = kind.isin(*vocab.UNIT_SIGN_TYPES) | text.building_type_group(kind).isin(*vocab.UNIT_SIGN_TYPES)
    skipped = F.col("is_door_schedule_entry") | F.col("_schedule_row") | (F.upper("level").rlike(vocab.MEZZANINE) & F.col("is_mep")) | (F.col("_unit_or_apt") & ~allowed & ~F.col("unit_dominant"))
    every = F.concat(room_id_signs(), restroom_signs(), exit_signs(), capacity_signs(), directory_signs())
    found = rooms.withColumn("signs", F.when(~skipped, every).otherwise(F.array().cast(NONE))) if every_room else rooms.filter(~skipped).withColumn("signs", every)
    # an insert takes the plain sign's place, and only the first insert stays
    inserts = F.filter("signs", lambda s: s["sign_type"] == "Room ID w/insert")
    others = F.filter("signs", lambda s: ~s["sign_type"].isin("Room ID", "Room ID w/insert"))
    merged = F.when(F.size(inserts) > 0, F.concat(F.slice(inserts, 1, 1), others)).otherwise(F.col("signs"))
    return found.withColumn("signs", merged)


#: Kinds up to this many are broadcast; more are joined by a shuffle.
MAX_BROADCAST_KINDS = 50_000
_KIND = ("tenant_id", "room_name", "occupancy_group", "detected", "_doors", "directory_eligible", "unit_dominant", "residential_scope")


def kinds_of_rooms(ready: DataFrame, own: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rooms, kinds): rooms that are alike in all that rules ask of them, and in the columns own, are of one kind.

    ready: prepared rooms (kept, for they are read twice). rooms has the columns keep beside its keys; kinds has the columns that ``signed_rooms`` needs, with one number
    for each, seq: so signs are made once a kind. Flags and patterns come from the name, traits from the building type.
    """
    group = {} if "occupancy_group" in ready.columns else {"occupancy_group": F.lit(None).cast("string")}
    load = F.coalesce("occupant_load", F.lit(0))
    alike = {n: F.col(n) for n in _KIND} | group | {
        "_unit_number": _unit_by_number(F.col("room_number"), F.col("detected")),
        "occupant_load": F.when(load >= 50, 50).when(load == 0, 0).otherwise(1),
        "level": F.when(F.upper("level").rlike(vocab.MEZZANINE), "MEZZANINE").when(F.col("level").isNotNull(), ""),
    } | (own or {})
    rooms = ready.select(*JOB, "seq", *keep, *(c.alias(f"k_{n}") for n, c in alike.items()))
    kinds = kept(rooms.select(*(F.col(f"k_{n}").alias(n) for n in alike)).distinct().withColumn("seq", F.monotonically_increasing_id()), "kinds")
    return rooms, with_traits(looked_up(kinds, "room_name", _name_facts))


def with_kinds(rooms: DataFrame, kinds: DataFrame, *columns: str) -> DataFrame:
    """rooms of ``kinds_of_rooms`` with these columns of their kind; those of a kind that is not there are left out."""
    keys = [c for c in rooms.columns if c.startswith("k_")]
    told = kept(kinds.select(*(F.col(c[2:]).alias(f"_{c}") for c in keys), *columns), "told-kinds")
    told = F.broadcast(told) if told.count() <= MAX_BROADCAST_KINDS else told
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rooms.join(told, same).select(*(c for c in rooms.columns if c not in keys), *columns)


def room_signs(rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, seq, sign_type, qty, rule_ref, confidence, status, ada_required) of prepared rooms."""
    return _finished(signed_rooms(rooms).select(*JOB, "seq", F.inline("signs")))


def _stairs(rooms: DataFrame) -> DataFrame:
    core = F.upper(F.coalesce(text.blank_to_null(F.col("room_number")), F.substring("room_name", 1, 30)))
    return rooms.filter(F.col("is_stair") | text.stair_by_number(F.col("room_number"), F.col("detected"))).withColumn("core", core)


def stair_signs(rooms: DataFrame) -> DataFrame:
    """R11: signs of each stair core, one for every floor."""
    cores = _stairs(rooms).groupBy(*JOB, "core").agg(F.first("floors").alias("floors"), F.first("has_directory").alias("d"), F.first("area_of_rescue").alias("a"))
    floors = F.col("floors")
    base = F.array(_sign("Stair(Corridor)", floors, "R11", 0.80), _sign("Stair(Landing)", floors, "R11", 0.85), _sign("Exit(Tactile)", floors, "R11", 0.80))
    every = F.concat(base, _signs((F.col("d"), [_sign("Office Directory", 1, "R14", 0.75)])), _signs((F.col("a"), [_sign("Area of Rescue", floors, "R16", 0.85)])))
    return _finished(cores.select(*JOB, "core", F.inline(every)))


def elevator_signs(rooms: DataFrame) -> DataFrame:
    """R12: one line a building, or one for each cab with its levels."""
    cabs = rooms.filter("is_elevator").groupBy(*JOB, F.upper("room_number").alias("cab")).agg(F.count_distinct("level").alias("levels"), F.min(F.struct("seq", "level")).alias("first"), F.first("elevator_mode").alias("mode"))
    one = cabs.filter("mode = 'per_building'").groupBy(*JOB).agg(F.count(F.lit(1)).cast("int").alias("qty"), F.min("first").alias("first"))
    one = one.select(*JOB, F.lit("").alias("cab"), "qty", F.col("first.level").alias("floor_label"), F.lit(0.85).alias("confidence"))
    each = cabs.filter("mode <> 'per_building'").select(*JOB, "cab", F.col("levels").cast("int").alias("qty"), F.when(F.col("levels") == 1, F.col("first.level")).otherwise("").alias("floor_label"), F.lit(0.80).alias("confidence"))
    return _finished(one.unionByName(each).select(*JOB, "cab", F.lit("Elevator").alias("sign_type"), "qty", F.lit("R12").alias("rule_ref"), "confidence", "floor_label"))


def evacuation_maps(rooms: DataFrame) -> DataFrame:
    """R13: (tenant_id, job_id, maps) of jobs that get any: one a floor with an exit cluster, up to the type's cap."""
    kind = F.col("detected")
    anchor, cluster = F.col("_anchor") | F.col("is_corridor"), F.col("_cluster")
    # a job without either gets no map; levels are told apart before they are counted
    marked = rooms.filter(((F.col("floors") >= 2) | (F.col("n_rooms") >= 20)) & (anchor | cluster))
    levels = marked.groupBy(*JOB, "detected", "floors", "n_rooms", "level").agg(F.bool_or(anchor).alias("anchor"), F.bool_or(cluster).alias("cluster"))
    told = F.col("level").isNotNull()
    jobs = levels.groupBy(*JOB, "detected", "floors", "n_rooms").agg(F.count_if(F.col("anchor") & told).alias("anchored"), F.count_if(F.col("cluster") & told).alias("clustered"), F.bool_or("anchor").alias("any_anchor"))
    education = kind.isin(*vocab.EDUCATION_TYPES)
    per_floor = F.coalesce(text.by_type(text.building_type_group(kind), vocab.EVAC_MAPS_PER_FLOOR, None), F.when(F.col("floors") >= 6, 2).otherwise(1))
    cap = F.when(kind.isin(*vocab.RESIDENTIAL_TYPES), F.least("floors", F.ceil(F.col("n_rooms") / 20))).when(education, F.least(F.col("floors") * 2, F.lit(4))).otherwise(F.col("floors") * per_floor)
    maps = F.least(cap, F.when(education & F.col("any_anchor"), F.col("anchored")).otherwise(F.col("clustered")))
    return jobs.select(*JOB, maps.cast("int").alias("maps")).filter("maps > 0")


def formula_exits(rooms: DataFrame) -> DataFrame:
    """R9: exits of every stair room on every floor, and the type's exterior minimum."""
    stair = F.col("is_stair") | text.stair_by_number(F.col("room_number"), F.col("detected"))
    jobs = rooms.groupBy(*JOB, "detected", "floors").agg(F.count_if(stair).alias("stairs"))
    least = text.by_type(text.building_type_group(F.col("detected")), vocab.EXTERIOR_EXITS, vocab.EXTERIOR_EXITS["unknown"])
    doors = F.col("stairs") * F.col("floors")
    every = F.concat(_signs((doors > 0, [_sign("Exit", doors, "R9", 0.80)])), F.array(_sign("Exit", least, "R9", 0.65)))
    return _finished(jobs.select(*JOB, F.inline(every)))


def aggregate_signs(ready: DataFrame, exits: bool = True) -> DataFrame:
    """Signs of stairs, elevators and evacuation maps, and exits by formula: those of no one room. ready: prepared rooms."""
    cut = lambda df: df.select(*JOB, F.lit(None).cast("long").alias("room_seq"), "sign_type", "qty", "rule_ref", "confidence")
    maps = evacuation_maps(ready).select(*JOB, F.explode(F.sequence(F.lit(1), "maps")).alias("k")).select(*JOB, F.lit("Evacuation Map").alias("sign_type"), F.lit(1).alias("qty"), F.lit("R13").alias("rule_ref"), F.lit(0.85).alias("confidence"))
    out = cut(stair_signs(ready)).unionByName(cut(elevator_signs(ready))).unionByName(cut(maps))
    return out.unionByName(cut(formula_exits(ready))) if exits else out


#: What rules ask of a room.
ROOM_COLUMNS = (*JOB, "seq", "room_number", "room_name", "level", "occupant_load", "occupancy_group", "public_door_count")


def asked(rooms: DataFrame) -> DataFrame:
    return rooms.select(*(c for c in rooms.columns if c in ROOM_COLUMNS))


def apply_rules(rooms: DataFrame, jobs: DataFrame) -> DataFrame:
    """All signs of all jobs: (tenant_id, job_id, room_seq, sign_type, qty, rule_ref, confidence)."""
    # written once, with the job's facts; each kind of rule then scans the columns it needs
    ready = prepared_once(asked(rooms), jobs)
    return signs_by_kind(ready).unionByName(aggregate_signs(ready))


def signs_by_kind(ready: DataFrame, *more: str) -> DataFrame:
    """The signs of ``room_signs``, (tenant_id, job_id, room_seq, sign_type, qty, rule_ref, confidence), made once for each
    kind of room, with more: flags that the room's name tells. ready: prepared rooms (kept)."""
    rooms, kinds = kinds_of_rooms(ready)
    signed = signed_rooms(kinds.withColumn("room_number", F.lit(None).cast("string")))
    return with_kinds(rooms, signed, "signs", *more).select(*JOB, F.col("seq").alias("room_seq"), F.inline("signs"), *more)


def sign_quantities(signs: DataFrame) -> DataFrame:
    return signs.groupBy(*JOB, "sign_type").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_lines"))
