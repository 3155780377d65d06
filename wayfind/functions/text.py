"""Room, level and sign texts as column expressions. Null texts count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind import vocab


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_of(*cases: tuple[Column, Column | str]) -> Column:
    """The value of the first condition that holds, else null."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


# ---- rooms ----


def room_flags(name: Column) -> dict[str, Column]:
    """The flags that a room's name alone gives."""
    upper, trimmed = F.upper(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    door = trimmed.rlike(vocab.DOOR_ENTRY)
    noise = upper.rlike(vocab.STAIR_LAST_WORD) & ~upper.rlike(vocab.STAIR_QUALIFIED) | upper.rlike(vocab.STAIR_AFTER_OTHER)
    return {
        "is_door_schedule_entry": door,
        "is_restroom": upper.rlike(vocab.RESTROOM),
        "is_stair": upper.rlike(vocab.STAIR) & ~noise,
        "is_elevator": upper.rlike(vocab.ELEVATOR),
        "is_vestibule": upper.rlike(vocab.VESTIBULE),
        "is_corridor": upper.rlike(vocab.CORRIDOR),
        "is_vehicle_bay": upper.rlike(vocab.VEHICLE_BAY),
        "is_mep": upper.rlike(vocab.MEP),
        "is_variable_use": upper.rlike(vocab.VARIABLE_USE),
        "is_public": upper.rlike(vocab.PUBLIC_FACING),
        "is_assembly": upper.rlike(vocab.ASSEMBLY),
        "is_unit": ~door & ~F.upper(trimmed).rlike(vocab.UNIT_DOOR_CODE) & upper.rlike(vocab.RESIDENTIAL_UNIT),
    }


def is_schedule_row_name(name: Column) -> Column:
    return F.upper(F.coalesce(name, F.lit(""))).rlike(vocab.SCHEDULE_ROW)


def valid_room_name(name: Column) -> Column:
    t = F.trim(F.coalesce(name, F.lit("")))
    dense = F.regexp_replace(t, r"\s+", "")
    letters = F.length(F.regexp_replace(dense, "[^A-Za-z]", ""))
    return (F.length(t) >= 2) & ~t.rlike(vocab.GARBLED) & ((F.length(dense) <= 3) | (letters / F.length(dense) >= 0.40))


def by_type(building_type: Column, table: dict, default) -> Column:
    """The table's value for a building type."""
    out = None
    for k, v in table.items():
        out = F.when(building_type == k, v) if out is None else out.when(building_type == k, v)
    return out.otherwise(default)


def valid_room_number(number: Column, building_type: Column) -> Column:
    key = F.lower(F.trim(building_type))
    return by_type(key, {k: number.rlike(p) for k, p in vocab.VALID_NUMBER.items()}, number.rlike(vocab.ANY_NUMBER))


def room_key(number: Column, name: Column) -> Column:
    compact = F.regexp_replace(F.upper(F.trim(F.coalesce(number, F.lit("")))), r"\s+", "")
    return F.coalesce(F.nullif(compact, F.lit("")), F.lower(F.trim(F.coalesce(name, F.lit("")))))


def predict_sign_type(name: Column) -> Column:
    n = F.lower(name)
    has = lambda *words: n.rlike("|".join(words))
    stair = has("stair")
    return F.coalesce(
        first_of(
            (has("exit", "egress"), "Exit"),
            (stair & has("corridor", "hall"), "Stair(Corridor)"),
            (stair & has("landing"), "Stair(Landing)"),
            (stair, "Stair(Corridor)"),
            (has("restroom", "bathroom", "toilet", " wc", "lavatory", "women", "men's", "female", "male", "gender neutral"), "Restroom"),
            (has("evac"), "Evac Map"),
            (has("in case of fire", "fire instruction"), "In case of fire"),
            (has("directory"), "Office Directory"),
            (has("occupanc", "capacity"), "Max Occupancy"),
            (has("insert", "suite", "office"), "Room ID w/insert"),
        ),
        F.lit("Room ID"),
    )


def building_type_group(t: Column) -> Column:
    key = F.lower(F.trim(t))
    groups = F.create_map(*(F.lit(x) for pair in vocab.ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(groups, key), key)


def stair_by_number(number: Column, building_type: Column) -> Column:
    n = F.upper(F.trim(F.coalesce(number, F.lit(""))))
    group = building_type_group(building_type)
    return (n != "") & by_type(group, {k: n.rlike(p) for k, p in vocab.STAIR_NUMBER.items()}, F.lit(False))


# ---- levels ----


def _floor_name(digit: Column) -> Column:
    return F.when(digit == "0", "LEVEL B1").otherwise(F.concat(F.lit("LEVEL "), digit))


def level_from_room_number(number: Column) -> Column:
    n = F.upper(F.trim(number))
    lettered, plain = F.regexp_extract(n, r"^[A-Z]{1,3}([0-9])\d{2}", 1), F.regexp_extract(n, r"^([0-9])\d{2}[A-Z]?$", 1)
    return first_of((lettered != "", _floor_name(lettered)), (plain != "", _floor_name(plain)))


def building_from_room_number(number: Column) -> Column:
    n = F.upper(F.trim(number))
    return F.coalesce(F.nullif(F.regexp_extract(n, r"^\d{3,4}([A-Z])$", 1), F.lit("")), F.nullif(F.regexp_extract(n, r"^([A-Z])\d{3,4}$", 1), F.lit("")))


def normalize_level(raw: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    u = F.upper(t)
    named = F.regexp_extract(u, r"^(?:LEVEL|FLOOR|FL|L)\s*[-–]?\s*(\w+)$", 1)
    return first_of(
        (F.coalesce(raw, F.lit("")) == "", "LEVEL 1"),
        (u.rlike(r"^LEVEL\s+\S+$|^(?:MEZZANINE|ROOF|PARKING|LEVEL B\d+)$"), u),
        (named != "", F.concat(F.lit("LEVEL "), named)),
        (u.rlike(r"^\d+$"), F.concat(F.lit("LEVEL "), t)),
        (u.rlike("^FIRST|^1ST|^GROUND"), "LEVEL 1"),
        (u.rlike("^SECOND|^2ND"), "LEVEL 2"),
        (u.rlike("^THIRD|^3RD"), "LEVEL 3"),
        (u.rlike("^FOURTH|^4TH"), "LEVEL 4"),
        (u.rlike("^FIFTH|^5TH"), "LEVEL 5"),
        (u.rlike("BASEMENT|LOWER LEVEL|^B1$"), "LEVEL B1"),
        (u.rlike("MEZZ"), "MEZZANINE"),
        (u.rlike(r"\bROOF\b"), "ROOF"),
        (F.lit(True), u),
    )


#: Words in a level or sheet title, in this order: fixed values.
LEVEL_WORDS = [("BASEMENT|B1|LOWER LEVEL", "LEVEL B1"), ("GROUND|GRADE|LEVEL 1|1ST", "LEVEL 1"), ("LEVEL 2|2ND|SECOND", "LEVEL 2"), ("LEVEL 3|3RD|THIRD", "LEVEL 3"), ("LEVEL 4|4TH|FOURTH", "LEVEL 4"), ("LEVEL 5|5TH|FIFTH", "LEVEL 5"), ("MEZZ", "MEZZANINE"), ("ROOF", "ROOF")]


def level_from_context(raw: Column, title: Column, number: Column) -> Column:
    """By number if the raw level is vague, by the words of level and title, last by number in looser form."""
    by_number = level_from_room_number(number)
    vague = F.upper(F.trim(F.coalesce(raw, F.lit("")))).rlike("^$|^LEVEL 1$|^FIRST|^GROUND|^GRADE")
    word = lambda c: first_of(*((F.upper(c).rlike(p), level) for p, level in LEVEL_WORDS))
    n = F.upper(F.trim(number))
    lettered = F.regexp_extract(n, r"^[A-Z]{1,3}([0-9])\d{2}", 1)
    loose = first_of((lettered != "", _floor_name(lettered)), (n.rlike(r"^[0-4]\d{2}"), _floor_name(F.substring(n, 1, 1))), (n.rlike(r"^[BS]-?\d"), "LEVEL B1"), (n.rlike(r"^P-?\d"), "PARKING"))
    return F.coalesce(F.when(vague, by_number), word(raw), word(title), loose)


def format_level(level: Column) -> Column:
    t = F.trim(level)
    low = F.lower(t)
    return first_of(
        (F.coalesce(level, F.lit("")) == "", "Unspecified Floor"),
        (low.isin("g", "ground", "ground floor"), "Ground Floor"),
        (low.isin("b", "basement", "b1"), "Basement"),
        (t.rlike(r"^\d+$"), F.concat(F.lit("Level "), t)),
        (F.lit(True), F.upper(t)),
    )


def floor_sort_key(level: Column) -> Column:
    low = F.lower(F.trim(level))
    return first_of((F.coalesce(level, F.lit("")) == "", "zzz"), (low.isin("b", "basement", "b1"), "000"), (low.isin("g", "ground", "ground floor"), "001"), (low.rlike(r"^\d+$"), F.lpad(low, 10, "0")), (F.lit(True), low))


def wing_sort_key(number: Column) -> Column:
    n = F.upper(F.trim(number))
    digits = lambda p: F.lpad(F.regexp_extract(n, p, 1), 8, "0")
    return first_of((F.coalesce(number, F.lit("")) == "", "Z\u00ff"), (n.rlike(r"^W\d"), F.concat(F.lit("A"), digits(r"^W(\d+)"))), (n.rlike(r"^E\d"), F.concat(F.lit("B"), digits(r"^E(\d+)"))), (n.rlike(r"^\d"), F.concat(F.lit("C"), digits(r"^(\d+)"))), (F.lit(True), F.concat(F.lit("D"), n)))


def sign_type_slug(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_|_$", "")


def scan_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / 1_000_000 * vocab.TOKEN_PRICES[0] + output_tokens / 1_000_000 * vocab.TOKEN_PRICES[1]
