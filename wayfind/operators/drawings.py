"""Drawing sheets: type, category, relevance, rescue, and which of a job's signs its scope lets stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.rules import JOB
from wayfind.operators.schedules import is_type_code
from wayfind.operators.sheets import level_from_title, sheet_excluded
from wayfind.sources.kept import kept


def _has(c: Column, words) -> Column:
    """Whether the text holds one of these words or phrases."""
    return F.greatest(*(c.contains(w) for w in words), F.lit(False))


def detect_sheet_type(sheet_no: Column, title: Column) -> Column:
    """A sheet's type from its title, read forward and backward (turned title blocks), and its number."""
    t, n = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(sheet_no, F.lit("")))
    said = lambda words: _has(t, words) | _has(F.reverse(t), words)
    never, dotted = said(vocab.TITLE_NEVER_PLAN) | said(vocab.TITLE_OTHER_PLAN), n.rlike(r"^\d{1,2}\.\d{1,2}\.\d{1,4}$")
    return text.first_of(
        (said(vocab.TITLE_SIGN_DETAILS), "sign_details"),
        (said(vocab.TITLE_SIGN_SCHEDULE), "signage_schedule"),
        (said(vocab.TITLE_EGRESS) | n.rlike("^a-?003$"), "egress"),
        (n.rlike(r"^a-?7\d{2}"), "signage_schedule"),
        (n.rlike(r"^a-?[123]\d{2}"), "floor_plan"),
        (n.rlike(r"^a-?4\d{2}"), "interior_elevation"),
        (n.rlike(r"^a-|^a\d"), "other"),
        (dotted & never, "other"),
        (dotted, "floor_plan"),
        (n.rlike("^i-[6-9]"), "signage_schedule"),
        (n.rlike(r"^i-\d|^in-?\d{2,3}"), "floor_plan"),
        (n.startswith("s") & t.rlike(r"\bin-?\d{2,3}\b"), "floor_plan"),
        (n.rlike(vocab.NUMBER_SKIPPED) | never, "other"),
        (said(vocab.TITLE_PLAN), "floor_plan"),
        (F.lit(True), "other"),
    )


def sheets_from_index(lines: DataFrame, page_ids: DataFrame, files: DataFrame) -> DataFrame:
    """Sheets that a drawing index lists: (tenant_id, job_id, file_id, sheet_no, title, page, page_source, sheet_type,
    level).

    lines: tenant_id, job_id, file_id, index_page, line_no, line; page_ids: file_id, page, sheet_no of title blocks;
    files: page_count. A line's first sheet number counts, and its first line; the title is the text after it, else
    before it, else the number. The page is the first other one with the number, else as many pages after the index
    as the sheet's place in it. A file's index has some hundred lines, so places are counted within a file.
    """
    file = [*JOB, "file_id"]
    # written first: the filter on a line's number would else be asked of the rows from which the lines are derived
    lines = kept(lines.select(*file, "index_page", "line_no", "line"), "index-lines")
    part = lambda i: F.regexp_extract(F.trim("line"), vocab.INDEX_LINE, i)
    told = lambda c: F.nullif(F.regexp_replace(c, r"^[ .|-]+|[ .|-]+$", ""), F.lit(""))
    named = lines.select(*file, "index_page", "line_no", part(2).alias("sheet_no"), F.upper(F.coalesce(told(part(3)), told(part(1)), part(2))).alias("title")).filter("sheet_no <> ''")
    first = named.groupBy(*file, "index_page", "sheet_no").agg(F.min("line_no").alias("line_no"), F.min_by("title", "line_no").alias("title"))
    placed = first.withColumn("_place", F.row_number().over(Window.partitionBy(*file, "index_page").orderBy("line_no")))
    seen = page_ids.select(*file, "sheet_no", "page").join(first.select(*file, "sheet_no", "index_page"), [*file, "sheet_no"]).filter("page <> index_page").groupBy(*file, "index_page", "sheet_no").agg(F.min("page").alias("_found"))
    joined = placed.join(seen, [*file, "index_page", "sheet_no"], "left").join(files.select(*file, "page_count"), file, "left")
    page = F.coalesce("_found", F.least(F.col("index_page") + F.col("_place"), "page_count"))
    source = F.when(F.col("_found").isNotNull(), "scanned").otherwise("estimated")
    return joined.select(*file, "sheet_no", "title", page.cast("int").alias("page"), source.alias("page_source"), detect_sheet_type(F.col("sheet_no"), F.col("title")).alias("sheet_type"), level_from_title(F.col("title")).alias("level"))


#: Share of a page's width and height from which on words stand in its title block.
BLOCK_X, BLOCK_Y = 0.70, 0.75
_NUMBER = r"(?:[A-Z]{1,3}-?\d{1,4}(?:\.\d{1,3})?[A-Z]?|\d{1,2}\.\d{1,2}\.\d{1,4})"


def _numbers_in(token: Column) -> Column:
    """All sheet numbers in an upper-case token that stand between other characters than letters and digits. A number has
    three runs of letters and digits at most, so those that begin at each run are tried."""
    ends = [r"^[A-Z0-9]+", r"^[A-Z0-9]+[-.][A-Z0-9]+", r"^[A-Z0-9]+[-.][A-Z0-9]+[-.][A-Z0-9]+"]
    starts = F.filter(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(token, i, F.lit(1)).rlike("[A-Z0-9]") & ((i == 1) | ~F.substring(token, i - 1, F.lit(1)).rlike("[A-Z0-9]")))
    tried = F.flatten(F.transform(starts, lambda i: F.array(*(F.regexp_extract(F.substring(token, i, F.length(token)), e, 0) for e in ends))))
    return F.when(F.length(token) > 0, F.array_distinct(F.filter(tried, lambda x: x.rlike(f"^{_NUMBER}$")))).otherwise(F.array().cast("array<string>"))


def title_block_numbers(words: DataFrame) -> DataFrame:
    """(job, file_id, page, sheet_no): the number in each page's title block, its last dotted one, else its first.

    words: tenant_id, job_id, file_id, page, word_no, text, x0, top, page_width, page_height. Read from top, then left.
    """
    block = words.filter((F.col("x0") >= F.col("page_width") * BLOCK_X) & (F.col("top") >= F.col("page_height") * BLOCK_Y))
    page = [*JOB, "file_id", "page"]
    # a corner of a page has some dozen words
    told = block.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "word_no", "text"))).alias("w"))
    found = F.regexp_extract_all(F.array_join(F.transform("w", lambda w: w["text"]), " "), F.lit(rf"\b({_NUMBER})\b"), F.lit(1))
    dotted = F.filter("n", lambda n: n.rlike(r"^\d{1,2}\.\d{1,2}\.\d{1,4}$"))
    read = told.select(*page, found.alias("n")).filter("size(n) > 0")
    return read.select(*page, F.upper(F.coalesce(F.try_element_at(dotted, F.lit(-1)), F.get("n", F.lit(0)))).alias("sheet_no"))


def numbers_on_pages(words: DataFrame, listed: DataFrame) -> DataFrame:
    """(job, file_id, page, sheet_no): the listed numbers that each page bears: the one of its title block, else, where that
    is not listed, all of its text. A number that is split at its hyphen counts.

    listed: distinct job, file_id, sheet_no. Numbers and pages meet by equality of numbers, not page by page.
    """
    file, page = [*JOB, "file_id"], [*JOB, "file_id", "page"]
    block = kept(title_block_numbers(words).join(listed, [*file, "sheet_no"], "left_semi"), "title-blocks")
    after = F.lead(F.upper("text")).over(Window.partitionBy(*page).orderBy("word_no"))
    read = words.select(*page, F.upper("text").alias("w"), after.alias("after"))
    pair = F.when(F.col("w").rlike("[A-Z0-9]-$"), F.concat("w", F.coalesce("after", F.lit(""))))
    tokens = read.select(*page, F.explode(F.array_compact(F.array("w", pair))).alias("token")).filter(F.col("token").rlike(r"\d"))
    body = tokens.select(*page, F.explode(_numbers_in(F.col("token"))).alias("sheet_no")).distinct()
    body = body.join(block.select(*page), page, "left_anti").join(listed, [*file, "sheet_no"], "left_semi")
    return block.select(*page, "sheet_no").unionByName(body.select(*page, "sheet_no"))


def sheets_from_pages(lines: DataFrame, words: DataFrame, files: DataFrame) -> DataFrame:
    """``sheets_from_index`` with the numbers searched on the pages: words as for ``numbers_on_pages``."""
    lines = kept(lines, "index-lines")
    listed = lines.select(*JOB, "file_id", F.regexp_extract(F.trim("line"), vocab.INDEX_LINE, 2).alias("sheet_no")).filter("sheet_no <> ''").distinct()
    return sheets_from_index(lines, numbers_on_pages(words, kept(listed, "listed-numbers")), files)


def sheet_category(sheet_no: Column, title: Column, sheet_type: Column) -> Column:
    """interior, sign_docs, sign_details, exterior, room_schedule or skip, with the kind of reason: struct."""
    n, t = F.upper(F.trim(F.coalesce(sheet_no, F.lit("")))), F.upper(F.trim(F.coalesce(title, F.lit(""))))
    is_plan = F.coalesce(sheet_type == "floor_plan", F.lit(False))
    case = lambda c, category, reason: (c, F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason")))
    return text.first_of(
        case(n.rlike(vocab.SHEET_DISCIPLINE), "skip", "discipline"),
        case(_has(t, vocab.SHEET_ROOM_SCHEDULE), "room_schedule", "title"),
        case(n.rlike(r"^A-?7\d{2}$"), "room_schedule", "number"),
        case(_has(t, vocab.SHEET_SKIP), "skip", "title"),
        case(t.rlike(r"\bSECTION\b") & ~t.contains("SIGN") & ~is_plan, "skip", "section"),
        case(_has(t, vocab.SHEET_SPECIALTY), "sign_details", "title"),
        case(is_plan, "interior", "type"),
        case(F.coalesce(sheet_type == "signage_schedule", F.lit(False)), "sign_docs", "type"),
        case(t.rlike(r"\bDETAIL\b") & ~t.contains("SIGN"), "skip", "detail"),
        case(n.rlike("^A0"), "sign_docs", "number"),
        case(_has(t, vocab.SHEET_SIGN_DOCS), "sign_docs", "title"),
        case(_has(t, vocab.SHEET_EXTERIOR), "exterior", "title"),
        case(n.rlike(r"^A[-.]?[4-9]\d{2}") & ~_has(t, vocab.SHEET_PLAN), "skip", "number"),
        case(n.rlike(r"^A[-.]?\d"), "interior", "number"),
        case(_has(t, vocab.SHEET_PLAN), "interior", "title"),
        case(F.lit(True), "skip", "none"),
    )


def classify_sheets(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """sheets (with sheet_type) with category and reason; a file's slot (file_category; a floor plan's only with a
    floor label) goes before what the sheet tells."""
    slot = text.by_type(F.col("file_category"), {k: F.lit(v) for k, v in vocab.SLOT_CATEGORY.items()}, None)
    trusted = F.when((F.col("file_category") != "floor_plan") | (F.coalesce("floor_label", F.lit("")) != ""), slot)
    slots = files.select(*JOB, "file_id", trusted.alias("_slot")).filter("_slot is not null")
    joined = sheets.join(slots, [*JOB, "file_id"], "left").withColumn("_c", sheet_category(F.col("sheet_no"), F.col("title"), F.col("sheet_type")))
    return joined.select(*sheets.columns, F.coalesce("_slot", "_c.category").alias("category"), F.when(F.col("_slot").isNotNull(), "slot").otherwise(F.col("_c.reason")).alias("reason"))


def rescue_restroom_sheets(classified: DataFrame) -> DataFrame:
    """In jobs half of whose A-series titles name restrooms, skipped sheets with restroom or enlarged titles are
    interior again. Few jobs of one column are joined back."""
    named = F.upper(F.coalesce("title", F.lit(""))).rlike(r"\b(?:TOILET|RESTROOM|LAVATORY|RR)\b")
    jobs = classified.filter(F.upper("sheet_no").rlike(r"^A\d")).groupBy(*JOB).agg(F.avg(named.cast("double")).alias("_share")).filter("_share >= 0.5").select(*JOB, F.lit(True).alias("_set"))
    joined = classified.join(jobs, JOB, "left")
    hit = F.coalesce("_set", F.lit(False)) & (F.col("category") == "skip") & F.upper(F.coalesce("title", F.lit(""))).rlike(vocab.RESTROOM_RESCUE)
    return joined.withColumns({"category": F.when(hit, "interior").otherwise(F.col("category")), "reason": F.when(hit, "rescue").otherwise(F.col("reason"))}).select(*classified.columns)


def reclassify_by_tables(classified: DataFrame, cells: DataFrame) -> DataFrame:
    """Sheets that are neither skipped nor about signs already become sign documents if the first rows of their
    tables name two columns of a sign schedule."""
    heads = cells.filter("row_idx = 0").select(*JOB, "sheet_id", F.transform("cells", lambda c: F.upper(F.coalesce(c, F.lit("")))).alias("low"))
    hit = F.filter(F.array(*map(F.lit, vocab.SIGN_TABLE_COLUMNS)), lambda w: F.exists("low", lambda c: c.contains(w)))
    found = heads.select(*JOB, "sheet_id", F.explode(hit).alias("w")).groupBy(*JOB, "sheet_id").agg(F.count_distinct("w").alias("n")).filter("n >= 2").select(*JOB, "sheet_id", F.lit(True).alias("_table"))
    joined = classified.join(found, [*JOB, "sheet_id"], "left")
    now = F.coalesce("_table", F.lit(False)) & ~F.col("category").isin("skip", "sign_docs", "sign_details")
    return joined.withColumns({"category": F.when(now, "sign_docs").otherwise(F.col("category")), "reason": F.when(now, "table").otherwise(F.col("reason"))}).select(*classified.columns)


def promote_signage_sheets(sheets: DataFrame) -> DataFrame:
    """sheets whose title or A0 number tells of sign notes as sign schedules; then, whether a sheet is relevant."""
    notes = F.upper(F.coalesce("title", F.lit(""))).rlike(vocab.SIGN_NOTES_TITLE) | F.upper("sheet_no").rlike(r"^A0[.\-]|^A[-.]0")
    kind = F.when(notes & ~F.coalesce("sheet_type", F.lit("")).isin("signage_schedule", "sign_details"), "signage_schedule").otherwise(F.col("sheet_type"))
    relevant = sheet_excluded(F.col("sheet_no"), F.col("title")).isNull() | F.col("sheet_type").isin("signage_schedule", "floor_plan", "room_schedule")
    promoted = sheets.withColumn("sheet_type", kind)
    return promoted.withColumn("is_relevant", F.coalesce(relevant, F.lit(False)))


# ---- which signs stand ----


def _phrase(c: Column) -> Column:
    return F.filter(F.split(F.upper(c), "[^A-Z0-9]+"), lambda w: w != "")


def types_in_notes(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tenant_id, job_id, sign_type): the sign types that the notes of a job name: its whitelist for ``filter_signs``.

    lines: tenant_id, job_id, sheet_id, line_no, line; dictionary: sign_type. Words are compared without their case and
    signs; each word of a line meets the types that begin with it, and what follows is compared. A type inside a longer
    one that the line names at the same place does not count.
    """
    line = [*JOB, "sheet_id", "line_no"]
    types = dictionary.select("sign_type", _phrase(F.col("sign_type")).alias("p")).filter("size(p) > 0").dropDuplicates(["sign_type"]).withColumn("word", F.col("p")[0])
    told = lines.select(*line, _phrase(F.col("line")).alias("w"))
    at = told.select(*line, "w", F.posexplode("w").alias("pos", "word")).join(types, "word")
    hits = at.filter(F.slice("w", F.col("pos") + 1, F.size("p")) == F.col("p")).select(*line, "sign_type", F.col("pos").alias("a"), (F.col("pos") + F.size("p")).alias("b"))
    # a line's hits are as many as its words, for each of the dictionary's lengths
    by_line = hits.groupBy(*line).agg(F.collect_list(F.struct("a", "b", "sign_type")).alias("h"))
    outer = lambda x: ~F.exists("h", lambda y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & (y["b"] - y["a"] > x["b"] - x["a"]))
    return by_line.select(*JOB, F.explode(F.transform(F.filter("h", outer), lambda x: x["sign_type"])).alias("sign_type")).distinct()


def filter_signs(signs: DataFrame, rooms: DataFrame, scopes: DataFrame, whitelist: DataFrame) -> DataFrame:
    """signs that the scope of their job lets stand.

    signs: seq, room_seq, sign_type, rule_ref; rooms: seq, room_name, is_elevator; scopes, one row a job:
    restroom_only, schedule_first, dedicated_schedule; whitelist: (tenant_id, job_id, sign_type) of sign notes, which
    binds the jobs that have any, but no learned sign and no project type code.
    """
    own = rooms.select(*JOB, F.col("seq").alias("room_seq"), F.upper(F.coalesce("room_name", F.lit(""))).alias("_room"), F.col("is_elevator").alias("_elevator"))
    bound = whitelist.select(*JOB).distinct().withColumn("_bound", F.lit(True))
    listed = whitelist.select(*JOB, "sign_type").distinct().withColumn("_listed", F.lit(True))
    joined = signs.join(own, [*JOB, "room_seq"], "left").join(scopes, JOB, "left").join(bound, JOB, "left").join(listed, [*JOB, "sign_type"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    kind, rule = F.coalesce("sign_type", F.lit("")), F.coalesce("rule_ref", F.lit(""))
    learned = rule.rlike("^training_correction(:|$)")
    restroom = no(F.col("restroom_only")) & (kind.isin(*vocab.RESTROOM_SCOPE_DROPS) | no(F.col("_room").rlike(vocab.NOT_RESTROOM_ROOMS)))
    evac = (kind == "Evacuation Map") & no(F.col("_room").rlike(vocab.NO_EVAC_ROOMS))
    unlisted = no(F.col("_bound")) & ~learned & ~is_type_code(kind) & ~no(F.col("_listed"))
    dedicated = no(F.col("dedicated_schedule"))
    egress = F.when(learned, ~dedicated | kind.isin(*vocab.EGRESS_SIGNS)).otherwise(rule.isin(*vocab.EGRESS_RULES) | (~dedicated & (rule == vocab.UNIT_RULE)))
    other = no(F.col("schedule_first")) & ~egress
    exits = (kind == "Exit") & F.col("room_seq").isNotNull()
    elevators = kind.isin("Elevator", "In Case of Fire") & no(~F.col("_elevator"))
    return joined.filter(~(restroom | evac | unlisted | other | exits | elevators)).select(*signs.columns)
