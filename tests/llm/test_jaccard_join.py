import random
import re

from wayfind.llm import jaccard_join

SCHEMA = "doc_id long, text string, a string, component_id int, hashes string"


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, parts=5):
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(parts)
    got = jaccard_join.join(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(rows)


def test_families_passages_and_edges(spark):
    r = random.Random(1)
    word = lambda: f"w{r.randrange(3000)}"
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(150):  # a family longer than LONG, each copy changed in up to 8 % of the words
        w = list(base)
        for _ in range(r.randrange(10)):
            w[r.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join([word() for _ in range(r.randrange(200))] + passage)) for i in range(120)]
    rows += [(3000 + i, " ".join(base).upper() if i % 2 else "the same text many times over and over") for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three"), (8, "x" * 200_000), (9, " ".join(word() for _ in range(20_000))), (None, "one")]
    rows += [rows[0], rows[1]]
    check(spark, rows)


def test_threshold_is_exact(spark):
    # 2 * k shared shingles of 10 and more words each side around the limit
    rows = []
    for k in range(1, 40):
        head = [f"h{k}_{i}" for i in range(40)]
        rows += [(10 * k, " ".join(head)), (10 * k + 1, " ".join(head[:k] + [f"t{k}"] + head[k + 1 :])), (10 * k + 2, " ".join(head + [f"e{i}" for i in range(k)]))]
    check(spark, rows, 3)


def test_random_small_vocabulary(spark):
    r = random.Random(5)
    seeds = [[r.choice("abc") for _ in range(r.randrange(5, 40))] for _ in range(12)]
    rows = []
    for i in range(250):
        w = list(r.choice(seeds))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice("abcd")
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_empty_table(spark):
    assert jaccard_join.join(spark.createDataFrame([], SCHEMA)).count() == 0
