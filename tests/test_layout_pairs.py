"""Segments of a page's words and the pairing of numbers with names against plain loops."""

import random

import pytest

from wayfind.operators import layout


def plain_segments(words):
    """Words in reading order; each joins the last run if it stands on its line, near enough and of the same sort."""
    runs = []
    for w in sorted(words, key=lambda w: (round(w[2] / layout.LINE_Y), w[1], w[0], w[2], w[3], w[4])):
        text, x0, y0, x1, y1 = w
        if runs:
            r = runs[-1]
            gap = x0 - r["x1"]
            if abs(r["y0"] - y0) <= layout.LINE_Y and 0 <= gap <= layout.GAP_X:
                letters, digits = layout._PREFIX.match(r["text"]), layout._DIGITS.match(text)
                if letters and digits and gap <= layout.GAP_X / 4:
                    r.update(text=r["text"] + text, x1=x1, y1=max(r["y1"], y1))
                    continue
                if bool(layout._NUMBER.match(r["text"])) == bool(layout._NUMBER.match(text)):
                    r.update(text=f"{r['text']} {text}", x1=x1, y1=max(r["y1"], y1))
                    continue
        runs.append({"text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
    return [(r["text"], (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2) for r in runs]


def plain_pairs(found):
    """Again and again the nearest number and name that are both free, the first of equal ones."""
    numbers = [s for s in found if layout._NUMBER.match(s[0])]
    names = [s for s in found if not layout._NUMBER.match(s[0]) and layout._NAME.search(s[0].upper())]
    out, free_n, free_m = [], list(range(len(numbers))), list(range(len(names)))
    while True:
        best = None
        for i in free_n:
            for j in free_m:
                dx, dy = abs(numbers[i][1] - names[j][1]), abs(numbers[i][2] - names[j][2])
                if dx <= layout.REACH_X and dy <= layout.REACH_Y and (best is None or dx + 2 * dy < best[0]):
                    best = (dx + 2 * dy, i, j)
        if best is None:
            return out
        _, i, j = best
        free_n.remove(i)
        free_m.remove(j)
        out.append((numbers[i][0], names[j][0].upper(), numbers[i][1], numbers[i][2]))


@pytest.mark.parametrize("seed", range(40))
def test_pages(seed):
    r = random.Random(seed)
    texts = ["101", "102A", "A", "205", "B", "OFFICE", "open", "STORAGE", "RM", "12", "2024", "A-101", "x", "Corridor", "W", "139"]
    words = []
    for _ in range(r.randrange(1, 40)):
        x, y = r.randrange(0, 60) * 8.0, r.randrange(0, 30) * 4.0 + r.choice([0, 0, 1.5])
        words.append((r.choice(texts), x, y, x + r.choice([8.0, 20.0]), y + 8))
    found = layout.segments(words)
    assert found == plain_segments(words)
    assert sorted(layout.pair(found)) == sorted(plain_pairs(found))


def test_order_of_words_does_not_matter():
    # same line and left edge, same text, other heights
    words = [("101", 10.0, 21.5, 30.0, 29.5), ("101", 10.0, 20.0, 30.0, 28.0), ("OFFICE", 32.0, 24.0, 60.0, 32.0), ("OFFICE", 32.0, 22.5, 60.0, 30.5)]
    for seed in range(10):
        mixed = random.Random(seed).sample(words, len(words))
        assert layout.segments(mixed) == layout.segments(words)
