"""Joins between rooms, takeoffs, schedules, signs and corrections, all on tenant and job first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators.dedup import first_per_key
from wayfind.operators.rules import JOB


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("room_key", text.room_key(F.col("room_number"), F.col("room_name")))


def takeoff_delta(takeoff: DataFrame, rooms: DataFrame, signs: DataFrame, extra_from: float = 0.8) -> DataFrame:
    """(tenant_id, job_id, kind, seq, room_key, sign_type): human rows matched or missed, rooms nobody counted.

    A matched row is a human row, so several may share a room. Extra rooms have a confidence of 0.8 and more and
    take the type of their first sign, or the one that their name suggests.
    """
    human, found = _keyed(takeoff), _keyed(rooms)
    first = signs.filter("room_seq is not null").groupBy(*JOB, F.col("room_seq").alias("seq")).agg(F.min_by("sign_type", "seq").alias("first_type"))
    found = found.withColumn("sure", F.coalesce(F.col("confidence") >= extra_from, F.lit(False))).join(first, [*JOB, "seq"], "left")
    human = human.withColumns({"sure": F.lit(False), "first_type": F.lit(None).cast("string")})
    side = lambda df, mine: df.select(*JOB, "seq", "room_key", "room_name", F.lit(mine).alias("human"), "sure", "first_type")
    rows = side(human, True).unionByName(side(found, False))
    # which sides have a key: counted once for both, and every row meets one row of its key
    sides = rows.groupBy(*JOB, "room_key").agg(F.bool_or("human").alias("in_human"), F.bool_or(~F.col("human")).alias("in_found"))
    judged = rows.filter(F.col("human") | F.col("sure")).join(sides, [*JOB, "room_key"], "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    kind = text.first_of((F.col("human") & has("in_found"), "matched"), (F.col("human"), "missed"), (~has("in_human"), "extra"))
    told = F.coalesce("first_type", text.predict_sign_type(F.col("room_name")))
    return judged.withColumn("kind", kind).filter("kind is not null").select(*JOB, "kind", "seq", "room_key", F.when(F.col("kind") != "matched", told).alias("sign_type"))


def _scores(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))
    recall = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return df.withColumns({"precision": precision, "recall": recall, "f1": f1})


def score_presence(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Per job: true and false positives, misses, precision, recall, F1 over distinct keys. A key that holds a null matches
    none."""
    whole = F.lit(True)
    for c in (*JOB, *key):
        whole = whole & F.col(c).isNotNull()
    e, a = F.col("_expected"), F.col("_actual")
    both = e & a & whole
    return _scores(_sides(expected, actual, key).groupBy(*JOB).agg(F.count_if(both).alias("tp"), F.count_if(a & ~both).alias("fp"), F.count_if(e & ~both).alias("fn")))


def _sides(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of both sides with whether each has them (_expected, _actual). One aggregation for both, so no side is
    joined with the other; nulls are equal."""
    side = lambda df, mine: df.select(*JOB, *key, F.lit(mine).alias("_mine"))
    rows = side(expected, True).unionByName(side(actual, False))
    return rows.groupBy(*JOB, *key).agg(F.bool_or("_mine").alias("_expected"), (~F.bool_and("_mine")).alias("_actual"))


def score_quantities(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Per job: keys of both sides with equal and other quantities, totals, summed difference."""
    total = lambda df, name: df.groupBy(*JOB, *key).agg(F.sum("qty").alias(name))
    both = total(expected, "e").join(total(actual, "a"), [*JOB, *key])
    return both.groupBy(*JOB).agg(F.count_if(F.col("e") == F.col("a")).alias("exact"), F.count_if(F.col("e") != F.col("a")).alias("off"), F.sum("e").alias("expected_qty"), F.sum("a").alias("actual_qty"), F.sum(F.abs(F.col("a") - F.col("e"))).alias("abs_delta"))


def quantity_mismatches(expected: DataFrame, actual: DataFrame, key: list[str], k: int = 20) -> DataFrame:
    """(tenant_id, job_id, n_mismatches, mismatches): keys of both sides with other quantities, as text, the largest
    difference first, then by key. Only the first k of a job are ever gathered: Spark keeps k of each task."""
    total = lambda df, name: df.groupBy(*JOB, *key).agg(F.sum("qty").alias(name))
    off = total(expected, "e").join(total(actual, "a"), [*JOB, *key]).filter("a <> e").withColumn("d", F.col("a") - F.col("e"))
    off = off.withColumn("line", F.concat(F.concat_ws("|", *(F.upper(F.trim(c)) for c in key)), F.lit(" expected "), F.col("e").cast("string"), F.lit(", got "), F.col("a").cast("string"), F.lit(" ("), F.when(F.col("d") >= 0, "+").otherwise(""), F.col("d").cast("string"), F.lit(")")))
    place = F.row_number().over(Window.partitionBy(*JOB).orderBy(F.desc(F.abs("d")), *key))
    first = off.withColumn("place", place).filter(F.col("place") <= k).groupBy(*JOB).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("m"))
    counts = off.groupBy(*JOB).agg(F.count(F.lit(1)).alias("n_mismatches"))
    return counts.join(first, JOB).select(*JOB, "n_mismatches", F.transform("m", lambda x: x["line"]).alias("mismatches"))


def score_by_type(expected: DataFrame, actual: DataFrame) -> DataFrame:
    total = lambda df, name: df.groupBy(*JOB, "sign_type").agg(F.sum("qty").alias(name))
    both = total(expected, "expected").join(total(actual, "got"), [*JOB, "sign_type"], "full_outer").fillna(0, ["expected", "got"])
    return both.withColumn("delta", F.col("got") - F.col("expected"))


def _number(c: str = "room_number") -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def locate_schedule(schedule: DataFrame, rooms: DataFrame) -> DataFrame:
    """Numbered schedule rows with the coordinates and level of their room: by number, else by number without the
    floor digit after letters; level from the number, the room, the schedule's floor, or level 1."""
    loose = lambda n: F.regexp_replace(n, r"^([A-Z]+)\d(\d{2,})$", "$1$2")
    base = rooms.withColumn("_n", _number()).filter("_n <> ''").withColumn("_loose", loose(F.col("_n")))
    place = F.struct("coord_x", "coord_y", "level")
    exact = base.groupBy(*JOB, "_n").agg(F.min_by(place, "seq").alias("_exact"))
    near = base.groupBy(*JOB, "_loose").agg(F.min_by(place, "seq").alias("_near"))
    s = schedule.withColumn("_n", _number()).filter("_n <> ''").withColumn("_loose", loose(F.col("_n")))
    joined = s.join(exact, [*JOB, "_n"], "left").join(near, [*JOB, "_loose"], "left").withColumn("_place", F.coalesce("_exact", "_near"))
    level = F.coalesce(text.level_from_room_number(F.col("_n")), "_place.level", text.blank_to_null(F.col("floor")), F.lit("LEVEL 1"))
    return joined.select(*schedule.columns, F.col("_place.coord_x").alias("coord_x"), F.col("_place.coord_y").alias("coord_y"), level.alias("level"))


def route_schedule_signs(signs: DataFrame, rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, seq, room_seq): the room whose number is the sign's type, else whose name is; leftmost first.

    The first room of each text is found before signs meet it, so a text that many signs and rooms share has one row.
    """
    by = lambda column, place: rooms.select(*JOB, F.upper(F.trim(column)).alias("_key"), F.lit(place).alias("_pass"), "coord_x", F.col("seq").alias("room_seq")).filter("_key <> ''")
    keyed = signs.select(*JOB, "seq", F.upper(F.trim("sign_type")).alias("_key"))
    first = by("room_number", 1).unionByName(by("room_name", 2)).groupBy(*JOB, "_key").agg(F.min(F.struct("_pass", "coord_x", "room_seq")).alias("_best"))
    return keyed.join(first, [*JOB, "_key"]).select(*JOB, "seq", F.col("_best.room_seq").alias("room_seq"))


def join_occupant_load(rooms: DataFrame, loads: DataFrame) -> DataFrame:
    """rooms with the last load given for their number."""
    last = loads.filter("occupant_load is not null").groupBy(*JOB, _number().alias("_n")).agg(F.max_by("occupant_load", "seq").alias("load"))
    return rooms.withColumn("_n", _number()).join(last, [*JOB, "_n"], "left").drop("_n")


def add_unseen_rooms(rooms: DataFrame, more: DataFrame) -> DataFrame:
    """rooms and those of more whose number the job does not have yet, the first of each."""
    seen = rooms.select(*JOB, _number().alias("_n")).distinct()
    new = first_per_key(more.withColumn("_n", _number()).filter("_n <> ''"), [*JOB, "_n"]).join(seen, [*JOB, "_n"], "left_anti")
    return rooms.unionByName(new.select(*rooms.columns))


#: Reach and share of the shift toward a corridor, and the width of a grid cell.
REACH, SHIFT = 30_000, 0.2


def offset_to_corridor(signs: DataFrame, corridors: DataFrame) -> DataFrame:
    """signs (seq, sheet_id, coord_x, coord_y) moved by a fifth toward the nearest corridor on the sheet within reach.

    Corridors are looked up in the nine grid cells around a sign, so a sheet's pairs stay near ones.
    """
    cell = lambda c: F.floor(F.col(c) / REACH).cast("long")
    around = F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((cell("coord_x") + k % 3 - 1).alias("gx"), (cell("coord_y") + F.floor(k / 3) - 1).alias("gy"))))
    spread = signs.withColumn("_g", around).select("*", F.col("_g.gx").alias("_gx"), F.col("_g.gy").alias("_gy")).drop("_g")
    near = corridors.select(*JOB, "sheet_id", F.col("seq").alias("_cseq"), F.col("coord_x").alias("_cx"), F.col("coord_y").alias("_cy"), cell("coord_x").alias("_gx"), cell("coord_y").alias("_gy"))
    d2 = (F.col("_cx") - F.col("coord_x")) * (F.col("_cx") - F.col("coord_x")) + (F.col("_cy") - F.col("coord_y")) * (F.col("_cy") - F.col("coord_y"))
    hits = spread.join(near, [*JOB, "sheet_id", "_gx", "_gy"]).withColumn("_d", d2).filter(F.col("_d") <= REACH * REACH)
    best = hits.groupBy(*JOB, "seq").agg(F.min(F.struct("_d", "_cseq", "_cx", "_cy")).alias("_b"))
    moved = lambda a, b: F.when(F.col("_b").isNull(), F.col(a)).otherwise(F.floor(F.col(a) + (F.col(f"_b.{b}") - F.col(a)) * SHIFT + 0.5))
    return signs.join(best, [*JOB, "seq"], "left").select(*JOB, "seq", moved("coord_x", "_cx").alias("coord_x"), moved("coord_y", "_cy").alias("coord_y"), F.col("_b").isNotNull().alias("moved"))



def takeoff_diffs(takeoff: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human rows (with sign_type) whose type is not the one that their name suggests: new, duplicate or conflict
    against the tenant's last correction of exactly this name."""
    suggested = text.predict_sign_type(F.col("room_name"))
    last = corrections.filter("coalesce(room_name_pattern, '') <> '' and coalesce(sign_type, '') <> ''").groupBy("tenant_id", F.col("room_name_pattern").alias("room_name")).agg(F.max_by("sign_type", "seq").alias("known_type"))
    odd = takeoff.withColumn("suggested", suggested).filter("suggested <> sign_type").join(last, ["tenant_id", "room_name"], "left")
    category = F.when(F.col("known_type").isNull(), "new").when(F.col("known_type") == F.col("sign_type"), "duplicate").otherwise("conflict")
    return odd.select(*JOB, "seq", "room_name", "sign_type", "suggested", "known_type", category.alias("category"))


def diff_collisions(diffs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Distinct (tenant_id, room_name, sign_type) of diffs that a correction has already."""
    known = corrections.select("tenant_id", F.col("room_name_pattern").alias("room_name"), "sign_type").distinct()
    return diffs.select("tenant_id", "room_name", "sign_type").distinct().join(known, ["tenant_id", "room_name", "sign_type"], "left_semi")


#: Where a sign of a sheet goes that no room places.
CENTRE, EDGE = 50_000, 100_000


def fill_markers(signs: DataFrame, rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, seq, room_seq, marker_x, marker_y) of signs without a marker: from their room, from the
    number in their message, from their own number (the last room of a number), else the sheet's centre."""
    own = rooms.select(*JOB, F.col("seq").alias("room_seq"), F.struct(F.col("seq"), "coord_x", "coord_y").alias("_own"))
    last = rooms.filter("room_number <> ''").groupBy(*JOB, "room_number").agg(F.max_by(F.struct("seq", "coord_x", "coord_y"), "seq").alias("_place"))
    by_message = last.select(*JOB, F.col("room_number").alias("_told"), F.col("_place").alias("_by_message"))
    by_number = last.select(*JOB, "room_number", F.col("_place").alias("_by_number"))
    s = signs.withColumn("_told", F.trim(F.get(F.split("message", r" \| "), F.lit(1))))
    placed = s.join(own, [*JOB, "room_seq"], "left").join(by_message, [*JOB, "_told"], "left").join(by_number, [*JOB, "room_number"], "left").withColumn("_place", F.coalesce("_own", "_by_message", "_by_number"))
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(EDGE), F.col(f"_place.{c}")))
    there = F.col("_place.coord_x").isNotNull() & F.col("_place.coord_y").isNotNull()
    centre = F.when(F.col("sheet_id").isNotNull(), CENTRE)
    return placed.select(*JOB, "seq", F.when(there, F.col("_place.seq")).otherwise(F.col("room_seq")).alias("room_seq"), F.when(there, at("coord_x")).otherwise(centre).cast("long").alias("marker_x"), F.when(there, at("coord_y")).otherwise(centre).cast("long").alias("marker_y"))


def restore_placements(rooms: DataFrame, placements: DataFrame) -> DataFrame:
    """rooms (keyed by number and level) with the coordinates of the first manual placement of their key."""
    return _placed(rooms, placements, ["room_number", "level"])


def restore_sign_placements(signs: DataFrame, placements: DataFrame) -> DataFrame:
    """Signs (keyed by room number, level and sign type, null as empty) with the coordinates of their key's first manual
    placement: two signs of one room keep their own places."""
    whole = lambda df: df.withColumns({f"_{c}": F.coalesce(c, F.lit("")) for c in ("room_number", "level", "sign_type")})
    return _placed(whole(signs), whole(placements), ["_room_number", "_level", "_sign_type"]).select(*signs.columns)


def _placed(rows: DataFrame, placements: DataFrame, key: list[str]) -> DataFrame:
    first = first_per_key(placements, [*JOB, *key]).select(*JOB, *key, F.col("coord_x").alias("_x"), F.col("coord_y").alias("_y"))
    joined = rows.join(first, [*JOB, *key], "left")
    return joined.withColumns({"coord_x": F.coalesce("_x", "coord_x"), "coord_y": F.coalesce("_y", "coord_y")}).select(*rows.columns)


def schedule_to_signs(schedule: DataFrame, rooms: DataFrame) -> DataFrame:
    """Sign rows of a schedule: the floor of the first room with the number, a message from type, number and name."""
    first = rooms.filter("trim(room_number) <> ''").groupBy(*JOB, _number().alias("_n")).agg(F.min_by("level", "seq").alias("_level"))
    told = F.concat_ws(" | ", text.blank_to_null(F.col("sign_type")), text.blank_to_null(F.col("room_number")), text.blank_to_null(F.col("room_name")))
    joined = schedule.withColumn("_n", _number()).join(first, [*JOB, "_n"], "left")
    return joined.select(*JOB, "seq", "sign_type", F.coalesce("quantity", F.lit(1)).alias("qty"), F.coalesce("_level", "floor").alias("floor_label"), told.alias("message"), F.when(F.col("type_mark").isNotNull(), F.concat(F.lit("Type Mark: "), "type_mark")).alias("notes"))


def apply_review(rooms: DataFrame, actions: DataFrame) -> DataFrame:
    """rooms found by vision with the status of their job's action (optionally for one level or from one status)."""
    a = actions.select(*JOB, F.col("level").alias("_level"), F.col("from_status").alias("_from"), F.col("to_status").alias("_to"))
    hit = F.col("_to").isNotNull() & (F.col("source") == "ai_vision") & (F.col("_level").isNull() | F.col("level").eqNullSafe(F.col("_level"))) & (F.col("_from").isNull() | (F.col("review_status") == F.col("_from")))
    return rooms.join(a, JOB, "left").withColumn("review_status", F.when(hit, F.col("_to")).otherwise(F.col("review_status"))).select(*rooms.columns)


def cascade_review(signs: DataFrame, rooms: DataFrame) -> DataFrame:
    """signs with is_deleted set for those of dismissed rooms; others as they were."""
    gone = rooms.filter("review_status = 'dismissed'").select(*JOB, F.col("seq").alias("room_seq")).distinct().withColumn("_gone", F.lit(True))
    return signs.join(gone, [*JOB, "room_seq"], "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).select(*signs.columns)


def presence_lists(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of one side only: missed (expected, not found) and extra. Nulls are equal."""
    one = _sides(expected, actual, key).filter(~(F.col("_expected") & F.col("_actual")))
    return one.select(*JOB, *key, F.when(F.col("_expected"), "missed").otherwise("extra").alias("kind"))


def resolve_sign_sheet(signs: DataFrame, rooms: DataFrame, sheets: DataFrame) -> DataFrame:
    """(tenant_id, job_id, seq, resolved): the sheet of a sign: its room's; else on a level with several sheets the
    first that names the building letter of the room's number; else the level's with most signs, then by number;
    else the job's first floor plan. signs: seq, room_seq; rooms: seq, sheet_id, level, room_number; sheets, floor
    plans only: sheet_id, sheet_no, title, level, page."""
    own = rooms.select(*JOB, F.col("seq").alias("room_seq"), F.col("sheet_id").alias("_own"), F.col("level").alias("_level"), text.building_from_room_number(F.col("room_number")).alias("_letter"))
    placed = signs.select(*JOB, "seq", "room_seq").join(own, [*JOB, "room_seq"], "left")
    # aggregated by sheet first: a job's sheets are few
    counts = placed.filter("_own is not null").groupBy(*JOB, F.col("_own").alias("sheet_id")).agg(F.count(F.lit(1)).alias("_n"))
    plans = sheets.join(counts, [*JOB, "sheet_id"], "left")
    best = F.min_by("sheet_id", F.struct(-F.coalesce("_n", F.lit(0)), "sheet_no", "sheet_id"))
    levels = plans.filter("level is not null").groupBy(*JOB, F.col("level").alias("_level")).agg(best.alias("_best"), F.count(F.lit(1)).alias("_sheets"))
    letter = F.nullif(F.regexp_extract(F.upper(F.concat_ws(" ", "sheet_no", "title")), r"\b([A-Z])\b", 1), F.lit(""))
    lettered = sheets.select(*JOB, F.col("level").alias("_level"), letter.alias("_letter"), "sheet_id", "page").filter("_level is not null and _letter is not null")
    lettered = lettered.groupBy(*JOB, "_level", "_letter").agg(F.min_by("sheet_id", F.struct("page", "sheet_id")).alias("_wing"))
    first = sheets.groupBy(*JOB).agg(F.min_by("sheet_id", F.struct("page", "sheet_id")).alias("_first"))
    found = placed.join(levels, [*JOB, "_level"], "left").join(lettered, [*JOB, "_level", "_letter"], "left").join(first, JOB, "left")
    wing = F.when(F.col("_sheets") >= 2, F.col("_wing"))
    return found.select(*JOB, "seq", F.coalesce("_own", wing, "_best", "_first").alias("resolved"))


def reuse_cached_rooms(rooms: DataFrame, old_sheets: DataFrame, new_sheets: DataFrame, version: str, forced: DataFrame) -> DataFrame:
    """Vision rooms of an earlier run for the new sheets with the same file, title and page, unless the old sheet is
    forced to be scanned again or the rooms are of another version."""
    place = [F.coalesce("file_id", F.lit("")).alias("_f"), F.coalesce("title", F.lit("")).alias("_t"), F.coalesce("page", F.lit(0)).alias("_p")]
    again = forced.select(*JOB, "sheet_id").distinct()
    old = old_sheets.select(*JOB, "sheet_id", *place).join(again, [*JOB, "sheet_id"], "left_anti")
    cached = rooms.filter((F.col("source") == "ai_vision") & (F.col("pipeline_version").isNull() | (F.col("pipeline_version") == version))).join(old, [*JOB, "sheet_id"])
    new = new_sheets.select(*JOB, F.col("sheet_id").alias("new_sheet_id"), *place)
    return cached.join(new, [*JOB, "_f", "_t", "_p"]).select(*rooms.columns, "new_sheet_id")


def flag_cached_sheets(sheets: DataFrame, rooms: DataFrame) -> DataFrame:
    """sheets with whether vision has found rooms on them."""
    seen = rooms.filter("source = 'ai_vision'").select(*JOB, "sheet_id").distinct().withColumn("is_cached", F.lit(True))
    return sheets.join(seen, [*JOB, "sheet_id"], "left").fillna(False, ["is_cached"])


def specialty_from_dictionary(dictionary: DataFrame, detail_sheets: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Specialty lines of jobs without detail sheets: the entries of these categories in the job's sign dictionary.

    dictionary: tenant_id, job_id, sign_types (array of code, name, category, qty).
    """
    open_jobs = dictionary.join(detail_sheets.select(*JOB).distinct(), JOB, "left_anti")
    each = open_jobs.select(*JOB, F.explode("sign_types").alias("t")).filter(F.col("t.category").isin(*categories))
    return each.select(*JOB, F.col("t.code").alias("sign_code"), F.col("t.name").alias("description"), F.col("t.qty").alias("qty"), F.concat(F.lit("Category: "), "t.category").alias("notes"))


def restore_review(signs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """signs with is_deleted unset for rooms that were dismissed and no longer are; others as they were."""
    gone = lambda df: df.filter("review_status = 'dismissed'").select(*JOB, F.col("seq").alias("room_seq")).distinct()
    back = gone(before).join(gone(after), [*JOB, "room_seq"], "left_anti").withColumn("_back", F.lit(True))
    joined = signs.join(back, [*JOB, "room_seq"], "left")
    return joined.withColumn("is_deleted", F.when(F.col("_back"), F.lit(False)).otherwise(F.col("is_deleted"))).select(*signs.columns)
