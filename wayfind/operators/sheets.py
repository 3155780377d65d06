"""Sheets and files of drawing sets, lexicons, replicated floors, fuzzy matching of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.cleaning import is_junk_room_name
from wayfind.operators.dedup import first_per_key
from wayfind.operators.rules import JOB, aggregate_signs, kinds_of_rooms, looked_up, signed_rooms, with_kinds
from wayfind.sources.kept import discard, kept


def expand_synonyms(name: Column) -> Column:
    """Upper case, each abbreviated word written out."""
    full = F.create_map(*(F.lit(x) for p in vocab.SYNONYMS.items() for x in p))
    return F.array_join(F.transform(F.split(F.upper(name), r"\s+"), lambda t: F.coalesce(F.try_element_at(full, t), t)), " ")


def level_from_title(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    ordinal = F.regexp_extract(t, r"(\d+)(?:st|nd|rd|th)?\s+floor", 1)
    return text.first_of(*((t.rlike(p), level) for p, level in vocab.TITLE_FLOORS), (ordinal != "", F.concat(F.lit("LEVEL "), ordinal)))


def level_from_label(label: Column) -> Column:
    """The level that a user's floor label tells (of a range its first), else null."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    number = F.coalesce(part(r"(\d+)(?:st|nd|rd|th)?\s+floor"), part(r"floors?\s*(\d+)\s*[-–]\s*\d+"), F.upper(part(r"level\s*(\w+)")))
    return F.coalesce(text.first_of(*((t.rlike(p), level) for p, level in vocab.LABEL_FLOORS)), F.concat(F.lit("LEVEL "), number))


def level_from_filename(name: Column) -> Column:
    """The level that an ordinal or a word in a file's name tells, else null."""
    u = F.upper(F.coalesce(name, F.lit("")))
    return text.first_of(*((F.greatest(*(F.contains(u, F.lit(w)) for w in words), F.lit(False)), level) for words, level in vocab.FILE_FLOORS))


def level_from_schedule_floor(floor: Column) -> Column:
    """The level of a schedule's floor column: a basement, or its first number, else null."""
    f = F.upper(F.trim(F.coalesce(floor, F.lit(""))))
    number = F.nullif(F.regexp_extract(f, r"(\d+)", 1), F.lit("")).cast("decimal(38,0)").cast("string")
    return F.when((f.contains("B") & f.contains("1")) | f.isin("B", "BASEMENT"), "LEVEL B1").otherwise(F.concat(F.lit("LEVEL "), number))


def unresolved(level: Column) -> Column:
    """Whether a level is none, or a page's name or number in its place."""
    u = F.upper(F.coalesce(level, F.lit("")))
    return (u == "") | u.contains("PLAN") | u.contains("PAGE") | F.trim(u).rlike(r"^LEVEL\s+\d{2,}$")


def sheet_level_chain(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """sheets with level and level_source: ``title``; ``file name``, an ordinal or word in it; ``slot``, the label of a file that
    was handed in as a floor plan; ``file range``, the first level of a range in the file's name; or none.

    files: file_id, filename, floor_label, file_category.
    """
    slot = F.when(F.coalesce("file_category", F.lit("")) == "floor_plan", level_from_label(F.col("floor_label")))
    first = F.concat(F.lit("LEVEL "), F.get(floor_range(label_from_filename(F.col("filename")))["levels"], F.lit(0)).cast("string"))
    named = files.select(*JOB, "file_id", level_from_filename(F.col("filename")).alias("_name"), slot.alias("_slot"), first.alias("_range"))
    joined = sheets.join(named, [*JOB, "file_id"], "left").withColumn("_title", level_from_title(F.col("title")))
    return _first_level(joined, {"_title": "title", "_name": "file name", "_slot": "slot", "_range": "file range"}).select(*(c for c in sheets.columns if c not in ("level", "level_source")), "level", "level_source")


def _first_level(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """df with the first of these columns that is not null as level, and what stands for it as level_source."""
    return df.withColumns({"level": F.coalesce(*sources), "level_source": text.first_of(*((F.col(c).isNotNull(), s) for c, s in sources.items()))})


def room_level_chain(rooms: DataFrame, sheets: DataFrame, schedule: DataFrame) -> DataFrame:
    """rooms with level and level_source: their own, else their sheet's with its source (``sheet_level_chain``), else that of the
    first schedule row with their number (``schedule``); where that is none or looks like a page, the one their number tells
    (``number``)."""
    number = lambda: F.upper(F.trim(F.coalesce("room_number", F.lit(""))))
    told = schedule.withColumn("_n", number()).withColumn("_floor", level_from_schedule_floor(F.col("floor"))).filter("_n <> '' and _floor is not null")
    floors = told.groupBy(*JOB, "_n").agg(F.min_by("_floor", "seq").alias("_floor"))
    of_sheet = sheets.select(*JOB, "sheet_id", F.col("level").alias("_sheet"), F.col("level_source").alias("_from"))
    joined = rooms.withColumn("_n", number()).join(of_sheet, [*JOB, "sheet_id"], "left").join(floors, [*JOB, "_n"], "left")
    own = text.blank_to_null(F.col("level"))
    level = F.coalesce(own, "_sheet", "_floor")
    source = text.first_of((own.isNotNull(), "own"), (F.col("_sheet").isNotNull(), F.col("_from")), (F.col("_floor").isNotNull(), "schedule"))
    by_number = text.level_from_context(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("room_number"))
    net = unresolved(level) & by_number.isNotNull()
    out = joined.withColumns({"_level": F.when(net, by_number).otherwise(level), "_source": F.when(net, "number").otherwise(source)})
    return out.select(*(c for c in rooms.columns if c not in ("level", "level_source")), F.col("_level").alias("level"), F.col("_source").alias("level_source"))


def label_from_filename(name: Column) -> Column:
    """``Floors a-b`` or ``Floor a`` that a file's name tells, else null."""
    u = F.upper(name)
    pair, one = r"(?:LEVELS?|FLOORS?|FL)[_\-\s]{1,3}(0?\d+)[_\-\s]{1,3}(?:TO[_\-\s]{1,3})?(0?\d+)", r"(?:LEVELS?|FLOORS?|FL)[_\-\s]{1,3}(0?\d+)"
    n = lambda p, i: F.nullif(F.regexp_extract(u, p, i), F.lit("")).cast("int").cast("string")
    return F.coalesce(F.concat(F.lit("Floors "), n(pair, 1), F.lit("-"), n(pair, 2)), F.concat(F.lit("Floor "), n(one, 1)))


def floor_range(label: Column) -> Column:
    """Struct of the levels that a label names and whether a plan stands for all of them (21 floors at most)."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    n = lambda p, i: F.nullif(F.regexp_extract(low, p, i), F.lit("")).cast("int")
    a, b, one = n(r"(\d+)\s*[-–to]+\s*(\d+)", 1), n(r"(\d+)\s*[-–to]+\s*(\d+)", 2), n(r"(\d+)", 1)
    many = F.coalesce((b > a) & (b - a <= 20), F.lit(False))
    levels = F.when(many, F.sequence(a, F.greatest(a, b))).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>"))
    return F.struct(levels.alias("levels"), many.alias("replicate"))


def sheet_excluded(sheet_no: Column, title: Column) -> Column:
    """Why a sheet is not scanned for rooms, or null."""
    n, t = F.upper(F.trim(sheet_no)), F.upper(F.coalesce(title, F.lit("")))
    rescued = t.rlike(vocab.RESTROOM_TITLE) & ~t.rlike("BATHROOM FINISH|FINISH PLAN")
    return text.first_of((n.isin(*vocab.ADMIN_SHEETS), "administrative"), (n.rlike(vocab.OTHER_DISCIPLINES), "discipline"), (rescued, F.lit(None)), (t.rlike(vocab.NO_PLAN_TITLES), "no plan view"), (t.rlike(vocab.PLAN_ONLY_TITLES) & ~t.contains("PLAN"), "table"))


def restroom_sets(sheets: DataFrame) -> DataFrame:
    """Jobs half of whose A-series sheets are about restrooms."""
    restroom = F.upper(F.coalesce("title", F.lit(""))).rlike(vocab.RESTROOM_TITLE)
    counts = sheets.filter(F.upper("sheet_no").rlike(r"^A-?\d")).groupBy(*JOB).agg(F.avg(restroom.cast("double")).alias("share"))
    return counts.filter("share >= 0.5").select(*JOB)


def sheet_coverage(sheets: DataFrame) -> DataFrame:
    """Per job and file: sheets, those scanned, those left out by reason."""
    why = sheet_excluded(F.col("sheet_no"), F.col("title"))
    marked = sheets.withColumn("why", why)
    return marked.groupBy(*JOB, "file_id").agg(F.count(F.lit(1)).alias("n_sheets"), F.count_if(F.col("why").isNull()).alias("scanned"), *(F.count_if(F.col("why") == w).alias(c) for w, c in (("administrative", "administrative"), ("discipline", "discipline"), ("no plan view", "no_plan"), ("table", "tables"))))


def fill_sheet_level(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """sheets with a level: the title's, else the first that the file's name tells."""
    named = files.select(*JOB, "file_id", floor_range(label_from_filename(F.col("filename")))["levels"].alias("_levels"))
    first = F.get("_levels", F.lit(0))
    level = F.coalesce(level_from_title(F.col("title")), F.concat(F.lit("LEVEL "), first.cast("string")))
    return sheets.join(named, [*JOB, "file_id"], "left").withColumn("level", level).drop("_levels")


def replicate_floors(rooms: DataFrame, sheets: DataFrame, files: DataFrame) -> DataFrame:
    """Rooms of sheets whose file stands for a range of floors, once on each: the first takes the room's place,
    the others have no coordinates. Other rooms stay as they are."""
    # once for each name: the filter on a range would else be asked of the rows from which the files are derived
    named = looked_up(files.select(*JOB, "file_id", "filename"), "filename", lambda c: {"_r": floor_range(label_from_filename(c))})
    ranges = named.filter("_r.replicate").select(*JOB, "file_id", F.col("_r.levels").alias("_levels"))
    with_levels = rooms.join(sheets.select(*JOB, "sheet_id", "file_id"), [*JOB, "sheet_id"], "left").join(ranges, [*JOB, "file_id"], "left")
    spread = with_levels.select("*", F.posexplode(F.coalesce("_levels", F.array(F.lit(None).cast("int")))).alias("_i", "_level"))
    return spread.select(*(c for c in rooms.columns if c not in ("level", "coord_x", "coord_y")), F.when(F.col("_level").isNull(), F.col("level")).otherwise(F.concat(F.lit("LEVEL "), F.col("_level").cast("string"))).alias("level"), *(F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in ("coord_x", "coord_y")))


def synthesize_missing_sheets(files: DataFrame, sheets: DataFrame) -> DataFrame:
    """(tenant_id, job_id, file_id, page): pages of files of several pages that have no sheet."""
    pages = files.filter("page_count > 1").select(*JOB, "file_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    return pages.join(sheets.select(*JOB, "file_id", F.col("page").cast("int").alias("page")).distinct(), [*JOB, "file_id", "page"], "left_anti")


def synthesize_sheets(files: DataFrame, sheets: DataFrame) -> DataFrame:
    """(tenant_id, job_id, file_id, page, title, level): sheets for pages that no index told.

    files: file_id, filename, page_count, size_bytes. A PDF without any sheet gets one a page, 30 at most, named after the
    file; where the whole job has no sheet it gets 3 pages at least, and an unknown number counts as 15, 8 or 5 by the
    size of the job's largest file. Then every page of a file of several pages that is still missing gets its own.
    """
    pdf = files.filter(F.lower("filename").endswith(".pdf"))
    has_sheet = sheets.select(*JOB, "file_id").distinct()
    bare = pdf.join(has_sheet, [*JOB, "file_id"], "left_anti")
    some = sheets.select(*JOB, F.lit(True).alias("_some")).distinct()
    largest = files.groupBy(*JOB).agg((F.max(F.coalesce("size_bytes", F.lit(0))) / (1024 * 1024)).alias("_mb"))
    known = bare.join(some, JOB, "left").join(largest, JOB).withColumn("_some", F.coalesce("_some", F.lit(False)))
    guess = F.when(F.col("_mb") > 100, 15).when(F.col("_mb") > 20, 8).otherwise(5)
    pages = F.when(F.col("_some"), F.greatest(F.lit(1), F.least(F.coalesce("page_count", F.lit(1)), F.lit(30)))).otherwise(F.greatest(F.lit(3), F.least(F.coalesce("page_count", guess), F.lit(30)))).cast("int")
    base, number = F.regexp_replace("filename", r"(?i)\.pdf$", ""), F.col("page").cast("string")
    level = F.concat(F.lit("LEVEL "), number)
    each = known.withColumn("_pages", pages).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("_pages"))))
    title = F.when(~F.col("_some"), F.concat(F.lit("FLOOR PLAN LEVEL "), number)).when(F.col("_pages") > 1, F.concat(base, F.lit(" \u2014 Page "), number)).otherwise(base)
    made = each.select(*JOB, "file_id", "page", title.alias("title"), F.when(F.col("_some"), F.coalesce(level_from_title(base), level)).otherwise(level).alias("level"))
    covered = sheets.select(*JOB, "file_id", F.col("page").cast("int").alias("page")).unionByName(made.select(*JOB, "file_id", "page"))
    missing = synthesize_missing_sheets(files, covered)
    return made.unionByName(missing.select(*JOB, "file_id", "page", F.concat(F.lit("Floor Plan Level "), number).alias("title"), level.alias("level")))


def apply_lexicon(rooms: DataFrame, jobs: DataFrame, lexicon: list[tuple[str, str, str]]) -> DataFrame:
    """(tenant_id, job_id, seq, flag columns): flags that a building type's active keywords set.

    lexicon: (building type, flag, keyword). One pattern a type and flag is built from it, so rooms are read once.
    """
    import re

    def pattern(words: list[str]) -> str:
        edge = lambda c: r"\b" if re.match(r"\w", c) else ""
        return "|".join(f"{edge(w[0])}{re.sub(r'([.*+?^${}()|\[\]\\])', r'\\\1', w)}{edge(w[-1])}" for w in words)

    by: dict[str, dict[str, list[str]]] = {}
    for kind, flag, word in lexicon:
        if kind.lower() != "unknown" and word:
            by.setdefault(flag, {}).setdefault(kind.lower(), []).append(word.upper())
    name, kind = F.upper(F.trim("room_name")), F.lower(F.trim("building_type"))
    typed = rooms.join(jobs.select(*JOB, "building_type"), JOB)
    return typed.select(*JOB, "seq", *(F.coalesce(text.by_type(kind, {k: name.rlike(pattern(w)) for k, w in kinds.items()}, F.lit(False)), F.lit(False)).alias(flag) for flag, kinds in sorted(by.items())))


#: Least similarity of names that are matched.
LEAST_SIMILARITY = 0.25


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " "), " +"), lambda t: t != ""))


def _classes(df: DataFrame, side: str) -> DataFrame:
    """(job, seq, class): rows whose names have the same words are one class; names without words match nothing."""
    named = df.select(*JOB, F.col("seq").alias(f"{side}_seq"), F.array_join(F.array_sort(_tokens(F.col("room_name"))), " ").alias(f"{side}_class"))
    return named.filter(F.col(f"{side}_class") != "")


def _class_edges(s: DataFrame, r: DataFrame) -> DataFrame:
    """(job, s_class, r_class, score) of classes whose words are similar enough, met by shared words."""
    words = lambda df, c: df.select(*JOB, c).distinct().withColumn("w", F.explode(F.split(c, " ")))
    shared = words(s, "s_class").join(words(r, "r_class"), [*JOB, "w"]).groupBy(*JOB, "s_class", "r_class").agg(F.count(F.lit(1)).alias("n"))
    size = lambda c: F.size(F.split(c, " "))
    score = F.col("n") / (size("s_class") + size("r_class") - F.col("n"))
    return shared.select(*JOB, "s_class", "r_class", score.alias("score")).filter(F.col("score") >= LEAST_SIMILARITY)


def _settled(edges: DataFrame, taken: DataFrame, capacity: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (the edges that can still be chosen, newly settled rows with their class).

    edges: (job, s_seq, r_class, score) of rows that are not settled; taken: (job, s_seq, r_class) of those that are.
    """
    at = Window.partitionBy(*JOB, "r_class").orderBy("s_seq")
    events = edges.select(*JOB, "r_class", "s_seq", "score", F.lit(False).alias("taken")).unionByName(taken.select(*JOB, "r_class", "s_seq", F.lit(None).cast("double").alias("score"), F.lit(True).alias("taken")))
    events = events.withColumns({"before": F.count_if("taken").over(at), "place": F.count(F.lit(1)).over(at)}).join(capacity, [*JOB, "r_class"])
    # rows before it have taken the whole class: the edge is gone
    left = events.filter(~F.col("taken") & (F.col("before") < F.col("capacity"))).drop("taken")
    top = left.groupBy(*JOB, "s_seq").agg(F.max(F.struct("score")).alias("m")).select(*JOB, "s_seq", F.col("m.score").alias("top"))
    left = kept(left.join(top, [*JOB, "s_seq"]), "match-edges")
    best = left.filter("score = top").groupBy(*JOB, "s_seq").agg(F.array_sort(F.collect_list("r_class")).alias("tied"), F.min(F.col("capacity") - F.col("place")).alias("room"))
    # one best class, and room for all that come before and may want it
    sure = best.filter("size(tied) = 1 and room >= 0").select(*JOB, "s_seq", F.col("tied")[0].alias("r_class"))
    # several best classes: the leading rows that want just these, before any other row has a say in one of them
    wanted = left.select(*JOB, "r_class", "s_seq", "before").join(best.select(*JOB, "s_seq", "tied"), [*JOB, "s_seq"])
    lead = wanted.groupBy(*JOB, "r_class").agg(F.min_by(F.struct("tied", "before"), "s_seq").alias("lead"))
    other = wanted.join(lead, [*JOB, "r_class"]).filter((F.col("tied") != F.col("lead.tied")) | (F.col("before") != F.col("lead.before")))
    limit = other.groupBy(*JOB, "r_class").agg(F.min("s_seq").alias("limit"))
    bounds = lead.join(limit, [*JOB, "r_class"], "left").select(*JOB, "r_class", F.col("lead.tied").alias("lead_tied"), F.col("lead.before").alias("gone"), "limit")
    # taken later by rows that come after the leading ones: the leading rows have the first rooms, so these stand
    each = best.filter("size(tied) > 1").select(*JOB, "s_seq", "tied", F.explode("tied").alias("r_class")).join(bounds, [*JOB, "r_class"])
    ok = F.bool_and((F.col("lead_tied") == F.col("tied")) & (F.col("limit").isNull() | (F.col("s_seq") < F.col("limit"))))
    block = each.groupBy(*JOB, "s_seq", "tied").agg(ok.alias("ok")).filter("ok").select(*JOB, "s_seq", "tied")
    block = kept(block.withColumn("k", F.row_number().over(Window.partitionBy(*JOB, "tied").orderBy("s_seq"))), "match-ties")
    if block.isEmpty():
        discard(block)
        return left, sure
    groups = block.groupBy(*JOB, "tied").agg(F.max("k").alias("most")).select("*", F.explode("tied").alias("r_class")).join(bounds.select(*JOB, "r_class", "gone"), [*JOB, "r_class"])
    free = r.join(groups, [*JOB, "r_class"]).filter((F.col("place") > F.col("gone")) & (F.col("place") <= F.col("gone") + F.col("most")))
    free = free.withColumn("k", F.row_number().over(Window.partitionBy(*JOB, "tied").orderBy("r_seq")))
    return left, sure.unionByName(block.join(free.select(*JOB, "tied", "k", "r_class"), [*JOB, "tied", "k"]).select(*JOB, "s_seq", "r_class"))


def fuzzy_match_rooms(schedule: DataFrame, rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, s_seq, r_seq, score): schedule rows, in their order, take the free room whose name has the most
    similar words (Jaccard, 0.25 at least), the first of equal ones.

    Names with the same words are one class; classes that share a word meet once. The greedy choice is made in rounds of
    joins until no edge is left. A row is settled when its best class has room for all rows before it that might want it,
    whatever those choose; rows with several equally good classes when they lead all of these. The first open row of a
    job is always settled, so rounds end; rows of one name are settled together. In the end a class's rows take its rooms
    in order.
    """
    s = kept(_classes(schedule, "s"), "match-schedule")
    own = _classes(rooms, "r").withColumn("place", F.row_number().over(Window.partitionBy(*JOB, "r_class").orderBy("r_seq")))
    r = kept(own, "match-rooms")
    capacity = kept(r.groupBy(*JOB, "r_class").agg(F.count(F.lit(1)).alias("capacity")), "match-capacity")
    scores = kept(_class_edges(s, r), "match-classes")
    edges = kept(s.join(scores, [*JOB, "s_class"]).select(*JOB, "s_seq", "r_class", "score"), "match-open")
    taken = kept(edges.limit(0).select(*JOB, "s_seq", "r_class"), "match-taken")
    while not edges.isEmpty():
        left, settled = _settled(edges, taken, capacity, r)
        more = kept(taken.unionByName(settled), "match-taken")
        still = kept(left.join(more.select(*JOB, "s_seq"), [*JOB, "s_seq"], "left_anti").select(*JOB, "s_seq", "r_class", "score"), "match-open")
        discard(edges, taken, left)
        edges, taken = still, more
    placed = taken.withColumn("place", F.row_number().over(Window.partitionBy(*JOB, "r_class").orderBy("s_seq"))).join(r, [*JOB, "r_class", "place"])
    return placed.join(s, [*JOB, "s_seq"]).join(scores, [*JOB, "s_class", "r_class"]).select(*JOB, "s_seq", "r_seq", "score")


#: Rooms that a check names.
EXAMPLES = 5


def validate_jobs(ready: DataFrame) -> DataFrame:
    """(tenant_id, job_id, check, status, details): the checks of a job's rooms and signs.

    ready: prepared rooms (kept). Signs are made and judged once for each kind of room and come with their rooms, so one
    aggregation by job counts both; restrooms are compared with the generic Restroom signs only. Of the rooms that a check
    names only the first five are gathered.
    """
    rooms, kinds = kinds_of_rooms(ready, {"_loaded": F.coalesce("occupant_load", F.lit(0)) > 0}, ("room_number", "level"))
    signed = signed_rooms(kinds.withColumn("room_number", F.lit(None).cast("string")), every_room=True)
    names = F.transform("signs", lambda s: s["sign_type"])
    of = lambda test: F.size(F.filter("signs", test))
    mezzanine = F.coalesce(F.upper("level").rlike(vocab.MEZZANINE), F.lit(False)) & F.col("is_mep")
    judged = signed.withColumns({
        "bare": (F.size("signs") == 0) & ~F.col("is_stair") & ~F.col("is_elevator") & ~F.col("is_corridor") & ~F.col("is_mep") & ~mezzanine,
        "twice": (F.size(F.array_distinct(names)) < F.size("signs")) & ~F.col("is_vestibule"),
        "exits": of(lambda s: s["sign_type"] == "Exit"),
        "restroom_signs": of(lambda s: s["sign_type"] == "Restroom"),
        "low": of(lambda s: s["confidence"] < 0.5),
        "loaded": F.col("is_mep") & F.col("_loaded"),
    })
    r = with_kinds(rooms, judged, "detected", "is_restroom", "is_stair", "is_elevator", "bare", "twice", "exits", "restroom_signs", "low", "loaded")
    r = kept(r, "checked-rooms")
    facts = r.groupBy(*JOB).agg(
        F.first("detected").alias("detected"),
        F.count_if("bare").alias("without"),
        F.count_if("twice").alias("twice"),
        F.sum("exits").alias("exits"),
        F.count_if("is_restroom").alias("restrooms"),
        F.sum("restroom_signs").alias("restroom_signs"),
        F.count_if("is_stair").alias("stairs"),
        F.count_if("is_elevator").alias("elevators"),
        F.sum("low").alias("low"),
        F.count_distinct(F.coalesce("level", F.lit(""))).alias("levels"),
        F.count_if("loaded").alias("loaded"),
    )
    which = F.explode(F.array_compact(F.array(F.when(F.col("bare"), "bare"), F.when(F.col("loaded"), "loaded")))).alias("which")
    named = r.filter("bare or loaded").select(*JOB, "seq", "room_number", which)
    first = named.withColumn("place", F.row_number().over(Window.partitionBy(*JOB, "which").orderBy("seq"))).filter(F.col("place") <= EXAMPLES)
    some = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == w, F.struct("place", "room_number")))), lambda x: F.coalesce(x["room_number"], F.lit(""))), ", ")
    examples = first.groupBy(*JOB).agg(some("bare").alias("bare_rooms"), some("loaded").alias("loaded_rooms"))
    of_jobs = aggregate_signs(ready, exits=False).groupBy(*JOB).agg(F.count_if(F.col("rule_ref").isin("R11", "R14", "R16")).alias("stair_signs"), F.count_if(F.col("rule_ref") == "R12").alias("elevator_signs"), F.count_if(F.col("rule_ref") == "R13").alias("maps"))
    facts = facts.join(of_jobs, JOB, "left").join(examples, JOB, "left").fillna(0, ["stair_signs", "elevator_signs", "maps"])
    c, say = F.col, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    # check: whether it passes, and what it says if so and if not
    checks = {
        "occupied_rooms_have_signs": (c("without") == 0, F.lit("All occupied rooms have at least one sign."), say(c("without"), " occupied rooms have no signs: ", F.coalesce("bare_rooms", F.lit("")))),
        "no_duplicate_signs_per_room": (c("twice") == 0, F.lit("No duplicate sign types per room."), say(c("twice"), " rooms have duplicate sign types.")),
        "exit_signs_present": (c("exits") > 0, say(c("exits"), " Exit sign(s) assigned."), F.lit("No Exit signs assigned — verify egress doors.")),
        "restroom_signs_match_restrooms": (c("restrooms") == c("restroom_signs"), say(c("restroom_signs"), " Restroom sign(s) match ", c("restrooms"), " restroom(s)."), say(c("restrooms"), " restrooms but ", c("restroom_signs"), " Restroom signs — review.")),
        "stair_signs_present": ((c("stairs") == 0) | (c("stair_signs") > 0), F.when(c("stairs") == 0, "No stairs detected.").otherwise(say(c("stair_signs"), " stair sign(s) for ", c("stairs"), " stair(s).")), F.lit("Stairs detected but no stair signs assigned.")),
        "elevator_signs_present": ((c("elevators") == 0) | (c("elevator_signs") > 0), F.when(c("elevators") == 0, "No elevators detected.").otherwise(say(c("elevator_signs"), " elevator sign(s) for ", c("elevators"), " elevator(s).")), F.lit("Elevators detected but no elevator signs assigned.")),
        "low_confidence_signs": (c("low") == 0, F.lit("All signs have confidence >= 0.5."), say(c("low"), " sign(s) have low confidence (<0.5) — review required.")),
        "building_type_detected": (c("detected") != "commercial", say("Building type detected: ", c("detected"), "."), F.lit("Building type defaulted to 'commercial' — verify and update if needed.")),
        "multi_level_coverage": (c("levels") > 0, say("Signs assigned across ", c("levels"), " level(s)."), F.lit("No rooms found — PDF extraction may have failed.")),
        "evac_maps_present": ((c("levels") < 2) | (c("maps") > 0), F.when(c("levels") < 2, "Single-level building — evac maps optional.").otherwise(say(c("maps"), " Evacuation Map(s) assigned.")), F.lit("Multi-level building detected but no Evacuation Maps assigned — check lobby/elevator lobbies.")),
        "unoccupied_rooms_with_occupant_load": (c("loaded") == 0, F.lit("No MEP-unoccupied rooms carry a non-zero occupant load."), say(c("loaded"), " room(s) marked unoccupied but have an occupant load — verify source data: ", F.coalesce("loaded_rooms", F.lit("")))),
    }
    fails = lambda k: "fail" if k == "multi_level_coverage" else "warning"
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.when(ok, "pass").otherwise(fails(k)).alias("status"), F.when(ok, yes).otherwise(no).alias("details")) for k, (ok, yes, no) in checks.items())))
    return facts.select(*JOB, each.alias("c")).select(*JOB, "c.*")


def merged_restroom_flag(name: Column, keyword: Column, by_vision: Column, vision_says: Column) -> Column:
    """Restroom by keyword, or by vision where the name is too short to tell or has a restroom word."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return keyword | F.coalesce(by_vision & vision_says & ((F.length(n) < 4) | F.upper(n).rlike(vocab.RESTROOM)), F.lit(False))


def rooms_from_payload(payloads: DataFrame, default_confidence: float = 0.75) -> DataFrame:
    """Rooms of extraction answers: (tenant_id, job_id, sheet_id, seq, payload), the last a JSON list of items with
    camel or snake names. Coordinates are percent, held to 0..100 and kept in thousandths, null if there is none; a
    confidence outside 0..1 gives way to the default; junk names and rows without number and name go; the first of
    each number and name of a sheet stays."""
    fields = "roomNumber string, room_number string, roomName string, room_name string, x string, y string, confidence double, level string"
    items = payloads.select(*JOB, "sheet_id", "seq", F.posexplode(F.from_json("payload", f"array<struct<{fields}>>")).alias("item", "r"))
    either = lambda a, b: F.trim(F.coalesce(F.col(f"r.{a}"), F.col(f"r.{b}"), F.lit("")))
    percent = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col(c).try_cast("double") + 0.5))) * 1000
    sure = F.when(F.col("r.confidence").between(0, 1), F.col("r.confidence")).otherwise(default_confidence)
    rows = items.select(*JOB, "sheet_id", "seq", "item", either("roomNumber", "room_number").alias("room_number"), either("roomName", "room_name").alias("_name"), F.when(F.col("r.x").try_cast("double").isNotNull(), percent("r.x")).cast("long").alias("coord_x"), F.when(F.col("r.y").try_cast("double").isNotNull(), percent("r.y")).cast("long").alias("coord_y"), sure.alias("confidence"), text.blank_to_null(F.col("r.level")).alias("level"))
    some = rows.filter("room_number <> '' or _name <> ''").withColumns({"_n": F.lower("room_number"), "_m": F.lower("_name")})
    # written, for the names are read from it first: each distinct one is judged and written out once
    first = kept(first_per_key(some, [*JOB, "sheet_id", "_n", "_m"], F.col("seq"), F.col("item")).drop("_n", "_m"), "payload-rooms")
    told = looked_up(first, "_name", lambda c: {"_junk": is_junk_room_name(c), "room_name": expand_synonyms(c)})
    return told.filter(~F.col("_junk")).select(*JOB, "sheet_id", "seq", "item", "room_number", "room_name", "level", "coord_x", "coord_y", "confidence")
