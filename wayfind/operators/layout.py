"""Rooms from the words of a page.

Pairing numbers with names depends on what is taken already, so there a page (a few thousand words at most) is one
group and numpy works on its coordinates. Looking for words near a number or tag does not: that is a join of cells.
Pages of all files are dealt out by tenant, job and sheet.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators import pages
from wayfind.operators.cleaning import is_junk_room_name
from wayfind.operators.rules import looked_up
from wayfind.operators.sheets import expand_synonyms
from wayfind.sources.kept import bytes_read, discard, kept

#: How far, in points, a name may lie from its number: beside and below.
REACH_X, REACH_Y = 120.0, 60.0
#: Words of one line differ in height by at most so much; a wider gap ends a segment.
LINE_Y, GAP_X = 4.0, 40.0
_NUMBER = re.compile(rf"(?!{vocab.YEAR})(?:{vocab.ROOM_NUMBER}|^\d{{2,4}}$|^[A-Z]-?\d{{2,4}}[A-Z]?$|^[A-Z]\d[A-Z]?$)")
_PREFIX, _DIGITS = re.compile(r"^[A-Z]{1,2}$"), re.compile(r"^\d{3,4}[A-Z]?$")
_NAME = re.compile(r"[A-Z]{2}")
#: Left and above of these parts of a page lies the drawing; beyond is the title block.
TITLE_X, TITLE_Y = 0.78, 0.88
PAGE = pages.PAGE
#: Input that a partition of dealt words has at most, about, in bytes of its files.
BYTES_A_PART = 8 << 20
OUT = "tenant_id string, job_id string, sheet_id string, room_number string, room_name string, coord_x long, coord_y long"


def segments(words: list[tuple[str, float, float, float, float]]) -> list[tuple[str, float, float]]:
    """Runs of words on one line without a wide gap: (text, centre x, centre y). A letter prefix and the number
    right of it become one word. Words go by line, then from left to right, then by text and place, whatever their order."""
    out: list[list] = []
    for text, x0, y0, x1, y1 in sorted(words, key=lambda w: (round(w[2] / LINE_Y), w[1], w)):
        last = out[-1] if out else None
        if last and abs(last[2] - y0) <= LINE_Y and 0 <= x0 - last[3] <= GAP_X:
            joined = _PREFIX.match(last[0]) and _DIGITS.match(text) and x0 - last[3] <= GAP_X / 4
            apart = bool(_NUMBER.match(last[0])) != bool(_NUMBER.match(text)) and not joined
            if not apart:
                last[0] += text if joined else f" {text}"
                last[3], last[4] = x1, max(last[4], y1)
                continue
        out.append([text, x0, y0, x1, y1])
    return [(t, (x0 + x1) / 2, (y0 + y1) / 2) for t, x0, y0, x1, y1 in out]


def pair(found: list[tuple[str, float, float]]) -> list[tuple[str, str, float, float]]:
    """Each number with the nearest name in reach; a name serves its nearest number only."""
    numbers = [s for s in found if _NUMBER.match(s[0])]
    names = [s for s in found if not _NUMBER.match(s[0]) and _NAME.search(s[0].upper())]
    if not numbers or not names:
        return []
    p, q = np.array([s[1:] for s in numbers]), np.array([s[1:] for s in names])
    dx, dy = np.abs(p[:, None, 0] - q[None, :, 0]), np.abs(p[:, None, 1] - q[None, :, 1])
    # only pairs in reach are put in order
    rows, columns = np.nonzero((dx <= REACH_X) & (dy <= REACH_Y))
    order = np.argsort((dx + 2 * dy)[rows, columns], kind="stable")
    out, taken, served = [], set(), set()
    for i, j in zip(rows[order].tolist(), columns[order].tolist()):
        if i not in served and j not in taken:
            served.add(i)
            taken.add(j)
            out.append((numbers[i][0], names[j][0].upper(), *p[i]))
    return out


def _page(key: tuple, table: pa.Table) -> pa.Table:
    columns = [table.column(c).to_pylist() for c in ("text", "x0", "y0", "x1", "y1")]
    words = [w for w in zip(*columns) if w[0] and None not in w]
    width, height = (max((x for x in table.column(c).to_pylist() if x), default=1.0) for c in ("page_width", "page_height"))
    ids = [k.as_py() for k in key]
    rows = sorted({(*ids, n, t, round(x / width * 100_000), round(y / height * 100_000)) for n, t, x, y in pair(segments(words))}, key=str)
    types = [pa.string()] * 5 + [pa.int64()] * 2
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})


def _having(rows: DataFrame, condition: Column) -> DataFrame:
    """rows with this condition on computed columns. Spark would move the filter below and compute them anew for it, in methods
    too long to be compiled; it does not move it past a column that is not deterministic."""
    return rows.withColumn("_at", F.monotonically_increasing_id()).filter(condition & (F.col("_at") >= 0)).drop("_at")


#: A word with a text and a place.
USABLE = "text <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null"


def _ids(df: DataFrame) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in PAGE)


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out by page, those of a page one after another (by ``pages.KEY``): the only time that words are sent."""
    n = bytes_read(rows) // BYTES_A_PART
    fits = n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_page = rows.repartition(*PAGE) if fits else rows.repartition(n, *PAGE)
    # one number to sort by needs no comparison of texts; pages that share it are told apart afterwards
    return by_page.withColumn(pages.KEY, F.xxhash64(*PAGE)).sortWithinPartitions(pages.KEY)


def rooms_from_words(words: DataFrame) -> DataFrame:
    """Rooms of every page: number, name, place on a scale of 0 to 100,000.

    words: tenant_id, job_id, sheet_id, text, x0, y0, x1, y1, page_width, page_height. Null or empty words are
    skipped, as are those of the title block (right 22 %, bottom 12 %); the result does not depend on the order of the
    words. Addresses, finish codes and junk are no names. A page on which this finds nothing gets its rooms from
    ``proximity_rooms``.
    """
    drawn = words.filter((F.col("x0") <= F.col("page_width") * TITLE_X) & (F.col("y0") <= F.col("page_height") * TITLE_Y))
    found = kept(drawn.groupBy(*PAGE).applyInArrow(_page, OUT), "pairs")
    paired = kept(_named(found), "paired")
    discard(found)
    bare = words.join(paired.select(*PAGE).distinct(), PAGE, "left_anti")
    return paired.unionByName(_named(kept(_placed(bare), "placed")))


def _in_place(df: DataFrame, key: str, columns) -> DataFrame:
    return df.withColumns(columns(F.col(key)))


def _named(rooms: DataFrame, tell=None, sure: str | None = None) -> DataFrame:
    """rooms (room_number, room_name as found, maybe empty) with final names, without those that are none.

    What a name tells is found once for each distinct one, so rooms are read three times (kept); with ``_in_place`` it is
    found for each room, in one reading. sure: a column with the name with abbreviations written out, where it is known to be no address, finish
    code or junk, so that nothing is to be found for it.
    """
    tell, sure = tell or looked_up, F.col(sure) if sure else F.lit(None).cast("string")
    raw, number = F.coalesce("room_name", F.lit("")), F.col("room_number")
    unit, as_unit = number.rlike(vocab.NUMBER_OF_UNIT), F.concat(F.lit("UNIT "), number)
    rows = rooms.withColumns({"_raw": raw, "_bare": F.when(raw == "", F.when(unit, as_unit).otherwise(F.concat(F.lit("ROOM "), number)))})
    rows = tell(rows, "_raw", lambda c: {"_address": c.rlike(vocab.ADDRESS), "_codes": c.rlike(vocab.FINISH_CODES) & (F.length(c) < 25), "_long": F.size(F.split(c, r"\s+")) > 4, "_own": expand_synonyms(c)})
    rows = tell(rows.withColumn("_own", F.coalesce("_bare", sure, "_own")), "_own", lambda c: {"_junk": F.when(sure.isNull(), is_junk_room_name(c))})
    name = text.first_of((F.col("_address"), F.lit(None).cast("string")), (F.col("_codes") | (unit & F.col("_long")), F.when(unit, as_unit)), (~F.col("_junk"), F.col("_own")))
    name = F.when(sure.isNotNull(), F.when(unit & F.col("_long"), as_unit).otherwise(sure)).otherwise(name)
    return _having(rows.withColumn("room_name", name), F.col("room_name").isNotNull()).select(*rooms.columns)


def _may_name(word: Column) -> Column:
    """Whether a word can be part of a name: no grid letter, axis, small count, dimension or filler."""
    up = F.upper(word)
    return ~(up.rlike(r"^[A-Z]$|^\d+\.\d+$|^\d{1,2}$") | word.rlike(r"^\d+['\"\-/]") | up.isin(*vocab.IGNORED_WORDS) | (F.length(word) > 30))


def proximity_rooms(words: DataFrame) -> DataFrame:
    """Rooms of pages where each number takes the words near it for its name: the five leftmost.

    Same columns in and out as ``rooms_from_words``. A word may serve several numbers. The place is the middle of number
    and words, lowered by 35 % of their height (2.5 % of the page's if that is 0), within 1,000 to 99,000.
    """
    return _named(_found(words), _in_place, "sure").drop("sure")


def _placed(words: DataFrame) -> DataFrame:
    """``proximity_rooms`` with their names as found."""
    return _found(words).drop("sure")


def _found(words: DataFrame) -> DataFrame:
    """Rooms with their names as found, and (sure) the final name where it is certain."""
    text = F.col("text")
    year, inside = text.rlike(vocab.YEAR), (F.col("x0") <= F.col("page_width") * TITLE_X) & (F.col("y0") <= F.col("page_height") * TITLE_Y)
    label = F.when(F.upper("text").rlike(vocab.RESTROOM_LABEL), pages.RESTROOM).otherwise(pages.NAME)
    kind = F.when(text.rlike(vocab.ROOM_NUMBER), F.when(~year & inside, pages.NUMBER)).when(~year & _may_name(text) & ~F.upper("text").isin(*vocab.IGNORED_UNITS), label)
    # words that neither are numbers nor can name one are not sent
    told = _having(words.withColumn("kind", kind), F.expr(f"{USABLE} and kind is not null"))
    sent = dealt(told.select(*PAGE, "kind", "text", *(F.col(c).cast("double") for c in (*pages.PLACE, *pages.SIZE))))
    found = sent.withColumn("word", F.when(F.col("kind") != pages.NUMBER, F.upper("text"))).mapInArrow(pages.numbers_with_words, _ids(sent) + "text string, found string, sure string, " + ", ".join(f"{c} double" for c in (*pages.PLACE, *pages.SIZE, "left", "top", "right", "bottom")))
    low, high = F.least("y0", "top"), F.greatest("y1", "bottom")
    x = (F.least("x0", "left") + F.greatest("x1", "right")) / 2
    y = (low + high) / 2 + F.when(high > low, (high - low) * 0.35).otherwise(F.col("page_height") * 0.025)
    scaled = lambda v, of: F.greatest(F.lit(1000), F.least(F.lit(99000), F.floor(v / F.col(of) * 100_000 + 0.5))).cast("long")
    return found.select(*PAGE, F.col("text").alias("room_number"), F.coalesce("found", F.lit("")).alias("room_name"), scaled(x, "page_width").alias("coord_x"), scaled(y, "page_height").alias("coord_y"), "sure")


def tag_rooms(tags: DataFrame, words: DataFrame) -> DataFrame:
    """Room tags with names from the words around them: (page, room_number, room_name, x, y), one row a tag.

    tags: tenant_id, job_id, sheet_id, tag, x, y, page_width, page_height; a tag that repeats on a page counts at its
    topmost, leftmost place. Tags and words in the legend's zone (right 20 %, bottom 10 %) are left out, as are words
    amid codes of signs. A tag without words is called a unit or a room by its number.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    drawn = _having(words, F.expr(USABLE) & (x <= F.col("page_width") * pages.LEGEND_X) & (y <= F.col("page_height") * pages.LEGEND_Y))
    # a tag has its place and the page's size where a word has its corners
    corners = lambda names: [F.col(n).cast("double").alias(c) for n, c in zip(names, pages.PLACE)]
    both = tags.select(*PAGE, F.lit(True).alias("is_tag"), F.col("tag").alias("text"), *corners(["x", "y", "page_width", "page_height"]))
    sent = dealt(both.unionByName(drawn.select(*PAGE, F.lit(False).alias("is_tag"), "text", *corners(pages.PLACE))))
    up = F.upper(F.trim("text"))
    word = lambda c: F.when(~F.col("is_tag"), c)
    told = sent.withColumns({"word": word(up), "code": word(up.rlike(vocab.LEGEND_CODE)), "may": word(_may_name(up))})
    named = told.mapInArrow(pages.tags_with_words, _ids(sent) + "text string, found string, x double, y double")
    raw = F.when(F.col("found").isNotNull() & ~F.col("found").rlike(vocab.TAG_ADDRESS), F.col("found"))
    own = F.concat(F.when(F.col("text").rlike(vocab.NUMBER_OF_UNIT), "UNIT ").otherwise("ROOM "), "text")
    return named.select(*PAGE, F.col("text").alias("room_number"), F.coalesce(raw, own).alias("room_name"), *(F.col(c).cast(tags.schema[c].dataType).alias(c) for c in ("x", "y")))
