"""Matching of names against literal loops over a job's rows."""

import random
import re

import pytest

from wayfind.operators import dedup, matching, sheets

NAMED = "tenant_id string, job_id string, seq long, room_name string"


def words(name):
    return {w for w in re.split(" +", re.sub("[^A-Z0-9 ]", " ", (name or "").upper())) if w}


def greedy(schedule, rooms):
    used, out = set(), set()
    for s, a in schedule:
        best, of = 0.0, None
        for r, b in rooms:
            if r in used or not words(a) | words(b):
                continue
            score = len(words(a) & words(b)) / len(words(a) | words(b))
            if score > best:
                best, of = score, r
        if of is not None and best >= 0.25:
            used.add(of)
            out.add((s, of, best))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_in_rounds(spark, seed):
    r = random.Random(seed)
    vocabulary = [["OFFICE", "OPEN", "STORAGE"], ["MEN", "WOMEN", "RESTROOM", "STAFF", "A", "B"], [f"W{i}" for i in range(12)]][seed % 3]
    name = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 4)))
    jobs = {f"j{k}": ([(i, name()) for i in range(r.randrange(60))], [(i, name()) for i in range(1, r.randrange(2, 50))]) for k in range(4)}
    frame = lambda side: spark.createDataFrame([("t", j, i, n) for j, both in jobs.items() for i, n in both[side]], NAMED)
    found = {(x["job_id"], x["s_seq"], x["r_seq"], x["score"]) for x in sheets.fuzzy_match_rooms(frame(0), frame(1)).collect()}
    assert found == {(j, *x) for j, (s, rooms) in jobs.items() for x in greedy(s, rooms)}


def test_greedy_of_a_large_job(spark):
    """A job of 20,000 rooms of few names, rows of one name more than its rooms: a few rounds, not one a row."""
    names = ["OFFICE", "OPEN OFFICE", "OFFICE STORAGE", "MEN RESTROOM", "WOMEN RESTROOM", "RESTROOM", "STAIR A", "LOBBY"]
    r = random.Random(9)
    schedule = [("t", "j", i, r.choice(names[:5])) for i in range(12_000)]
    rooms = [("t", "j", i, r.choice(names)) for i in range(20_000)]
    found = {(x["s_seq"], x["r_seq"]) for x in sheets.fuzzy_match_rooms(spark.createDataFrame(schedule, NAMED), spark.createDataFrame(rooms, NAMED)).collect()}
    free = {n: [i for _, _, i, m in reversed(rooms) if m == n] for n in names}
    tiers = {a: sorted({len(words(a) & words(b)) / len(words(a) | words(b)) for b in names if words(a) & words(b)}, reverse=True) for a in names}
    want = set()
    for _, _, s, a in schedule:
        for score in tiers[a]:
            open_ = [b for b in names if free[b] and len(words(a) & words(b)) / len(words(a) | words(b)) == score]
            if open_ and score >= 0.25:
                want.add((s, free[min(open_, key=lambda b: free[b][-1])].pop()))
                break
    assert found == want


@pytest.mark.parametrize("seed", range(3))
def test_room_dedup_against_loops(spark, seed):
    r = random.Random(seed)
    parts = ["off", "office", "open office", "of", "it", "hall", "hallway", "corridor", "restroom", "staff toilet", "lab", "lab prep", "prep", "a b", "main lobby", "lobby"]
    rows = [("t", r.choice("jk"), i, r.choice(["", "", "101", "102", " 103 "]), r.choice(["", " "]) + " ".join(r.choice(parts) for _ in range(r.randrange(0, 3))), r.choice(["L1", "L2", None])) for i in range(160)]
    df = spark.createDataFrame(rows, "tenant_id string, job_id string, seq long, room_number string, room_name string, level string")
    want = set()
    for job in "jk":
        low = lambda x: (x or "").strip(" ").lower()
        first = {}
        for _, j, seq, n, name, level in rows:
            if j == job:
                first.setdefault((low(n), low(level)) if low(n) else ("", low(level), low(name)), (seq, low(n), low(name)))
        numbered = [x for x in first.values() if x[1]]
        names = [x[2] for x in numbered]
        want |= {x[0] for x in numbered}
        for seq, n, name in first.values():
            same = any(m == name or len(m) >= 4 and len(name) >= 4 and (name in m or " " in m and m in name) for m in names)
            kinds = [k for k in (dedup.RESTROOM_WORDS,) if re.search(k, name) and any(re.search(k, m) for m in names)]
            halls = name in ("hallway", "hall", "corridor") and any(re.search("corridor|hallway", m) for m in names)
            if not n and not (same or kinds or halls):
                want.add(seq)
    assert {x["seq"] for x in dedup.dedup_rooms(df).collect()} == want


def test_routing_meets_one_room_a_text(spark):
    rooms = spark.createDataFrame([("t", "j", i, "101" if i % 2 else "", "LOBBY", 100 - i) for i in range(40)], "tenant_id string, job_id string, seq long, room_number string, room_name string, coord_x int")
    signs = spark.createDataFrame([("t", "j", 1, "lobby"), ("t", "j", 2, " 101"), ("t", "j", 3, "x"), ("t", "j", 4, "")], "tenant_id string, job_id string, seq long, sign_type string")
    assert sorted((r["seq"], r["room_seq"]) for r in matching.route_schedule_signs(signs, rooms).collect()) == [(1, 39), (2, 39)]
