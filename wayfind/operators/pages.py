"""Words near a number or tag of their page, for many pages at a time.

Rows of a page come one after another in Arrow batches. Some ten thousand rows of whole pages are one set of numpy arrays;
only words of the heights around a number or tag are held against it, a bounded number of pairs at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfind import vocab

#: Left and above of these parts of a page lies the drawing without its legend.
LEGEND_X, LEGEND_Y = 0.80, 0.90
#: A name's words lie so near to a number or tag, or on its line; words of restrooms may lie lower or higher.
NEAR_X, NEAR_Y, LINE_X, SAME_Y, RESTROOM_Y = 80.0, 40.0, 200.0, 15.0, 80.0
#: Words with more codes of signs than this share among those around them belong to a legend of signs.
CODES_X, CODES_Y, CODES_LEAST, CODES_SHARE = 120.0, 40.0, 3, 0.30
#: So many words are a name at most.
NAME_WORDS = 5
PAGE, PLACE, SIZE = ["tenant_id", "job_id", "sheet_id"], ["x0", "y0", "x1", "y1"], ["page_width", "page_height"]
#: The column by which rows are sorted: a hash of PAGE.
KEY = "_page"
NUMBER, NAME, RESTROOM = 0, 1, 2
#: Rows and pairs held at once, about. Heights are put into bands of so many points.
ROWS_AT_ONCE, PAIRS_AT_ONCE, BAND, BANDS = 50_000, 1 << 20, 10.0, 1 << 24
#: A word of printable ASCII in upper case, maybe of parts with one space between.
_CLEAN = re.compile("[!-`{-~]+(?: [!-`{-~]+)*")
_any = lambda *patterns: "|".join(f"(?:{p})" for p in patterns)
_NO_NAME, _JUNK = _any(vocab.ADDRESS, vocab.FINISH_CODES), _any(vocab.NOTE_PHRASES, vocab.JUNK_ROW, vocab.NOT_A_NAME, vocab.GARBLED)


def _whole_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that part no page: they are cut where the key changes."""
    waiting, rows, enough = [], 0, ROWS_AT_ONCE
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(waiting)
            key = table.column(KEY).to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield table.slice(0, end).combine_chunks()
            waiting, rows = table.slice(end).to_batches(), rows - end
            enough = max(ROWS_AT_ONCE, 2 * rows)
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Equal values as equal numbers, in the order of the values (-1: null), and the values by number."""
    found = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.unify_dictionaries().chunk(0) if found.num_chunks else pa.array([], values.type).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    return rank[pc.fill_null(found.indices, -1).to_numpy()], found.dictionary.take(pa.array(order))


def _pages(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's page, and whether it is known: a page with a null in its id has no words in common."""
    page, known = np.zeros(table.num_rows, np.int64), np.ones(table.num_rows, bool)
    for c in PAGE:
        code, values = _codes(table.column(c))
        known &= code >= 0
        page = np.unique(page * (len(values) + 1) + code + 1, return_inverse=True)[1]
    return page, known


def _doubles(table: pa.Table, name: str) -> np.ndarray:
    """A column with one zero and one NaN, as Spark groups them; null is NaN."""
    out = table.column(name).to_numpy() + 0.0
    out[np.isnan(out)] = np.nan
    return out


def _bool(table: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(table.column(name), False).to_numpy()


def _once(rows: np.ndarray, keys: list[np.ndarray], least: list[np.ndarray]) -> np.ndarray:
    """Of these rows, the first by ``least`` of those with the same keys."""
    keys = [k[rows].view(np.int64) for k in keys]
    mixed = np.zeros(len(rows), np.uint64)
    for k in keys:
        mixed = (mixed ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return rows
    order = np.lexsort([v[rows] for v in reversed(least)] + keys)
    new = np.ones(len(rows), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return rows[np.sort(order[new])]


def _band(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    return page * BANDS + np.clip(np.floor(y / BAND), -BANDS // 2, BANDS // 2 - 1).astype(np.int64)


def _level(asked: np.ndarray, among: np.ndarray, page: np.ndarray, y: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows asked and among of one page that lie in bands within reach: those of a row asked come together."""
    asked, among = asked[~np.isnan(y[asked])], among[~np.isnan(y[among])]
    band = _band(page[among], y[among])
    order = np.argsort(band, kind="stable")
    among, band = among[order], band[order]
    first = np.searchsorted(band, _band(page[asked], y[asked] - reach))
    n = np.searchsorted(band, _band(page[asked], y[asked] + reach), "right") - first
    asked, first, n = asked[n > 0], first[n > 0], n[n > 0]
    before = np.concatenate([[0], np.cumsum(n)])
    start = 0
    while start < len(asked):
        end = max(start + 1, int(np.searchsorted(before, before[start] + PAIRS_AT_ONCE, "right")) - 1)
        some = n[start:end]
        at = np.arange(before[end] - before[start]) + np.repeat(first[start:end] - (before[start:end] - before[start]), some)
        yield np.repeat(asked[start:end], some), among[at]
        start = end


def _left_to_right(rows: np.ndarray, x: np.ndarray, y: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of each of these rows by x, y and word, at the row's index."""
    place = np.zeros(len(x), np.int64)
    place[rows[np.lexsort((word[rows], y[rows], x[rows]))]] = np.arange(len(rows))
    return place


def _first_words(i: np.ndarray, j: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) the first by place of each i."""
    order = np.argsort(i * (len(place) + 1) + place[j])
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    few = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < NAME_WORDS
    return i[few], j[few]


def _lists(rows: np.ndarray, chosen: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words chosen for these rows, one row after another, and how many each has."""
    i, j = (np.concatenate([c[k] for c in chosen] or [np.zeros(0, np.int64)]) for k in (0, 1))
    at = np.zeros(n, np.int64)
    at[rows] = np.arange(len(rows))
    return j[np.argsort(at[i], kind="stable")], np.bincount(at[i], minlength=len(rows))


def _joined(words: pa.Array, count: np.ndarray) -> pa.Array:
    """So many words each as one text; null: none."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), words)
    return pc.if_else(pa.array(count > 0), pc.binary_join(lists, " "), pa.scalar(None, words.type))


def sure_names(raw: pa.Array, words: pa.Array, word: np.ndarray, count: np.ndarray) -> pa.Array:
    """Names with abbreviations written out, where it is certain that they are names; else null.

    Certain is a text of printable ASCII (there these patterns mean the same in all languages) that no address, no finish code
    and nothing that makes ``is_junk_room_name`` true is in. raw: words by number, so many a name, joined. Most of it is told once a word.
    """
    full, told = [], np.zeros((5, len(words)), np.int64)
    for k, w in enumerate(words.to_pylist()):
        if not _CLEAN.fullmatch(w):
            full.append(w)
            told[0, k] = 1
            continue
        full.append(" ".join(vocab.SYNONYMS.get(t, t) for t in w.split(" ")))
        parts = full[-1].split(" ")
        told[0, k] = any(len(t) == 1 or t in vocab.JUNK_WORDS for t in parts)
        told[1, k] = sum(t in vocab.TABLE_WORDS for t in parts)
        told[2, k] = any(len(t) > 2 for t in parts)
        told[3, k] = sum("A" <= c <= "Z" for c in full[-1])
        told[4, k] = sum(map(len, parts))
    of = np.repeat(np.arange(len(count)), count)
    odd, table, long, letters, signs = (np.bincount(of, weights=t[word], minlength=len(count)) for t in told)
    own = _joined(pa.array(full, words.type).take(pa.array(word)), count)
    sure = (count > 0) & (odd == 0) & (table < 3) & (long > 0) & (2 * letters >= signs) & (pc.fill_null(pc.utf8_length(own), 0).to_numpy() <= 60)
    for names, pattern in ((raw, _NO_NAME), (own, _JUNK)):
        sure &= ~pc.fill_null(pc.match_substring_regex(names, pattern), True).to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(sure), own, pa.scalar(None, words.type))


def _out(table: pa.Table, rows: np.ndarray, **columns) -> list[pa.RecordBatch]:
    taken = {c: table.column(c).take(pa.array(rows)) for c in (*PAGE, "text")}
    return pa.table(taken | columns).combine_chunks().to_batches()


def numbers_with_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each number (kind NUMBER) with the words (word; kind NAME or RESTROOM) near it: the five leftmost, and where they reach
    to. Words that repeat with text and place count once."""
    for table in _whole_pages(batches):
        (page, known), n = _pages(table), table.num_rows
        kind, (word, words) = table.column("kind").to_numpy(), _codes(table.column("word"))
        x0, y0, x1, y1, width, height = (_doubles(table, c) for c in (*PLACE, *SIZE))
        rows = _once(np.arange(n), [page, _codes(table.column("text"))[0], x0, y0, x1, y1], [width, height])
        numbers, names = rows[kind[rows] == NUMBER], rows[(kind[rows] != NUMBER) & known[rows]]
        place, reach_y = _left_to_right(names, x0, y0, word), np.where(kind == RESTROOM, RESTROOM_Y, NEAR_Y)
        chosen, reach = [], {c: np.full(n, np.nan) for c in ("left", "top", "right", "bottom")}
        for i, j in _level(numbers[known[numbers]], names, page, y0, RESTROOM_Y):
            dx, dy = np.abs(x0[i] - x0[j]), np.abs(y0[i] - y0[j])
            near = (dx < NEAR_X) & (dy < reach_y[j]) | (dy < SAME_Y) & (dx < LINE_X)
            i, j = i[near], j[near]
            if len(i):
                chosen.append(_first_words(i, j, place))
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                for c, least, v in (("left", np.minimum, x0), ("top", np.minimum, y0), ("right", np.maximum, x1), ("bottom", np.maximum, y1)):
                    reach[c][i[starts]] = least.reduceat(v[j], starts)
        j, count = _lists(numbers, chosen, n)
        found, alone = _joined(words.take(pa.array(word[j])), count), count == 0
        sure = sure_names(found, words, word[j], count)
        own = {c: pa.array(v[numbers]) for c, v in zip((*PLACE, *SIZE), (x0, y0, x1, y1, width, height))}
        yield from _out(table, numbers, found=found, sure=sure, **own, **{c: pa.array(v[numbers], mask=alone) for c, v in reach.items()})


def _up_to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a <= b as Spark has it: NaN is the greatest."""
    return (a <= b) | np.isnan(b)


def _topmost(table: pa.Table, rows: np.ndarray, page: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of these tags, the one of each page and text that comes first by y, x and the page's size (nulls first), if it lies in
    the drawing. A tag has its place and the page's size in PLACE."""
    v = {c: _doubles(table, c)[rows] for c in PLACE}
    null = {c: pc.is_null(table.column(c)).to_numpy()[rows] for c in PLACE}
    order = np.lexsort([k for c in ("y1", "x1", "x0", "y0") for k in (v[c], ~null[c])] + [text[rows], page[rows]])
    rows, v, null = rows[order], {c: v[c][order] for c in PLACE}, np.any([null[c][order] for c in PLACE], axis=0)
    new = np.ones(len(rows), bool)
    new[1:] = (page[rows][1:] != page[rows][:-1]) | (text[rows][1:] != text[rows][:-1])
    return rows[new & ~null & _up_to(v["x0"], v["x1"] * LEGEND_X) & _up_to(v["y0"], v["y1"] * LEGEND_Y)]


def _legend(rows: np.ndarray, page: np.ndarray, x: np.ndarray, y: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether a word lies amid codes of signs, at the row's index."""
    def amid(asked, among):
        for i, j in _level(asked, among, page, y, CODES_Y):
            near = (np.abs(x[i] - x[j]) < CODES_X) & (np.abs(y[i] - y[j]) < CODES_Y)
            yield i[near], j[near]

    asked, n, codes = np.zeros(len(x), bool), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    # only words near a code can be in a legend
    for i, _ in amid(rows, rows[code[rows]]):
        asked[i] = True
    for i, j in amid(rows[asked[rows]], rows):
        n += np.bincount(i, minlength=len(x))
        codes += np.bincount(i[code[j]], minlength=len(x))
    return (n >= CODES_LEAST) & (codes / np.maximum(n, 1) > CODES_SHARE)


def tags_with_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tag (is_tag; its place and the page's size in PLACE) with the five leftmost of the words (word; code: one of a sign;
    may: can name) near it, and its place. Words that repeat with text and place count once."""
    for table in _whole_pages(batches):
        (page, known), n = _pages(table), table.num_rows
        is_tag, code, may = (_bool(table, c) for c in ("is_tag", "code", "may"))
        both, words = _codes(pa.chunked_array([*table.column("text").chunks, *table.column("word").chunks]))
        text, word = both[:n], both[n:]
        tags = _topmost(table, np.flatnonzero(is_tag), page, text)
        x0, y0, x1, y1 = (_doubles(table, c) for c in PLACE)
        rows = _once(np.flatnonzero(~is_tag & known), [page, text, x0, y0, x1, y1], [])
        x, y = (np.where(is_tag, a, (a + b) / 2) for a, b in ((x0, x1), (y0, y1)))
        clean = rows[may[rows] & ~_legend(rows, page, x, y, code)[rows]]
        place, chosen = _left_to_right(clean, x, y, word), []
        for i, j in _level(tags[known[tags] & (text[tags] >= 0)], clean, page, y, NEAR_Y):
            dx, dy = np.abs(x[i] - x[j]), np.abs(y[i] - y[j])
            near = ((dx < NEAR_X) & (dy < NEAR_Y) | (dx < LINE_X) & (dy < SAME_Y)) & (text[i] != word[j])
            chosen.append(_first_words(i[near], j[near], place))
        j, count = _lists(tags, chosen, n)
        yield from _out(table, tags, found=_joined(words.take(pa.array(word[j])), count), x=pa.array(x[tags]), y=pa.array(y[tags]))
