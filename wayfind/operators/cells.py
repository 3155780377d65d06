"""Takeoff rows from cell tables: (workbook, sheet, row_idx, cells), one row for each row of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import vocab

SHEET = ["workbook", "sheet"]


def _place(low: Column, names: tuple[str, ...]) -> Column:
    """1-based place of the first of these names that the header has, in the names' order."""
    return F.coalesce(*(F.nullif(F.array_position(low, n), F.lit(0)) for n in names))


def detect_takeoff_header(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, header_idx, is_tall, header, low): the first row that can be a header. Sheets without go."""
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    rows = cells.withColumn("low", low)
    names = F.arrays_overlap("low", F.array(*map(F.lit, vocab.NAME_COLUMNS)))
    tall = F.array_contains("low", "sign type") & names
    wide = names & F.exists("low", lambda c: (c != "") & ~c.isin(*vocab.META_COLUMNS))
    first = rows.filter(tall | wide).groupBy(*SHEET).agg(F.min(F.struct("row_idx", tall.alias("tall"), "cells", "low")).alias("h"))
    return first.select(*SHEET, F.col("h.row_idx").alias("header_idx"), F.col("h.tall").alias("is_tall"), F.col("h.cells").alias("header"), F.col("h.low").alias("low"))


def _body(cells: DataFrame, header: DataFrame) -> DataFrame:
    return cells.join(header, SHEET).filter("row_idx > header_idx")


def _cell(place: Column) -> Column:
    return F.trim(F.coalesce(F.get("cells", (place - 1).cast("int")), F.lit("")))


def _whole(c: Column) -> Column:
    """Leading whole number, at least one where there is none or zero."""
    n = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.coalesce(F.nullif(n, F.lit(0)), F.lit(1))


ROW = ["sign_type", "room_number", "room_name", "level", "qty"]


def takeoff_from_tall(cells: DataFrame, header: DataFrame) -> DataFrame:
    """One row a sign: type and name must be there."""
    names = {"_type": ("sign type",), "_number": vocab.NUMBER_COLUMNS, "_name": vocab.NAME_COLUMNS, "_level": ("level", "floor"), "_qty": ("qty", "quantity")}
    # where a sheet's columns stand is told once a sheet, not once a row
    rows = _body(cells, header.filter("is_tall").select(*SHEET, "header_idx", *(_place(F.col("low"), n).alias(c) for c, n in names.items())))
    of = lambda c: F.coalesce(_cell(F.col(c)), F.lit(""))
    out = rows.select(*SHEET, "row_idx", of("_type").alias("sign_type"), of("_number").alias("room_number"), of("_name").alias("room_name"), of("_level").alias("level"), _whole(of("_qty")).alias("qty"))
    return out.filter("sign_type <> '' and room_name <> ''")


def truthy_qty(c: Column) -> Column:
    """How many signs a cell asks for: 0 for blank, 0, N, NO and -, its number, else 1."""
    s = F.upper(F.trim(c))
    number = F.regexp_extract(s, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.when(s.isin("", "0", "N", "NO", "-"), 0).when(s.isin("X", "YES", "Y", "TRUE", "✓"), 1).when(number > 0, F.greatest(F.floor(number + 0.5), F.lit(1)).cast("int")).when(number.isNotNull(), 0).otherwise(1)


def takeoff_from_wide(cells: DataFrame, header: DataFrame) -> DataFrame:
    """One row for each sign column with a truthy cell. A lone first cell that names a floor is the level of the
    rows below it."""
    low, names = F.col("low"), {"_number_at": vocab.NUMBER_COLUMNS, "_name_at": vocab.NAME_COLUMNS, "_level_at": ("level", "floor", "bldg", "building")}
    taken = F.array(*(F.coalesce(_place(low, n), F.lit(0)) for n in names.values()))
    columns = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("name"), (i + 1).alias("at"))), lambda x: (F.trim(x["name"]) != "") & ~F.lower(F.trim(x["name"])).isin(*vocab.NOT_SIGN_COLUMNS) & ~F.array_contains(taken, x["at"].cast("bigint")))
    plain = lambda name: F.trim(F.regexp_replace(name, F.lit(vocab.SIGN_CODE), F.lit("")))
    typed = F.transform(columns, lambda x: F.struct(F.coalesce(F.nullif(plain(x["name"]), F.lit("")), F.trim(x["name"])).alias("sign_type"), x["at"].alias("at")))
    # where a sheet's columns stand, and what they are called, is told once a sheet, not once a row
    rows = _body(cells, header.filter("not is_tall").select(*SHEET, "header_idx", *(_place(low, n).alias(c) for c, n in names.items()), typed.alias("_columns")))
    of = lambda c: F.coalesce(_cell(F.col(c)), F.lit(""))
    first = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    section = first.rlike(vocab.SECTION_ROW) & (filled == 1)
    w = Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_section", section).withColumn("_above", F.last(F.when(F.col("_section"), first), ignorenulls=True).over(w)).filter("not _section")
    named = carried.withColumns({"room_number": of("_number_at"), "_name": of("_name_at"), "level": F.coalesce(F.nullif(of("_level_at"), F.lit("")), "_above", F.lit(""))}).filter("_name <> '' or room_number <> ''")
    each = named.select("*", F.explode("_columns").alias("c"))
    out = each.select(*SHEET, "row_idx", F.col("c.sign_type").alias("sign_type"), "room_number", F.coalesce(F.nullif("_name", F.lit("")), "room_number").alias("room_name"), "level", truthy_qty(_cell(F.col("c.at"))).alias("qty"))
    return out.filter("qty > 0")


def takeoff_rows(cells: DataFrame) -> DataFrame:
    """Rows of all sheets; numbers carry the sheet's name in workbooks of several sheets."""
    header = detect_takeoff_header(cells)
    sheets = cells.select(*SHEET).distinct().groupBy("workbook").agg(F.count(F.lit(1)).alias("n_sheets"))
    rows = takeoff_from_tall(cells, header).unionByName(takeoff_from_wide(cells, header)).join(sheets, "workbook")
    number = F.when((F.col("n_sheets") > 1) & (F.col("room_number") != ""), F.concat("sheet", F.lit(":"), "room_number")).otherwise(F.col("room_number"))
    return rows.withColumn("room_number", number).select(*SHEET, "row_idx", *ROW)
