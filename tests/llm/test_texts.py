"""Operators on single texts: brute force, round trips and held-out accuracy, and the odd rows of each."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.llm import gif, language, licenses, packing, pii, quality, queries, textnum, toxicity
from wayfind.llm.common import byte_size, restore_batches, small_batches

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, kind string, id int, score string, bucket string"
LONG = "a long text of words " * 30_000
ODD = [(1, None, None, None, "k", 1, "s", "b"), (2, "", "en", "s", "k", 1, "s", "b"), (3, " \n\t ", "en", None, None, None, None, None), (4, "123 ++ !!", "en", "s", "k", 1, "s", "b"), (5, "word", "en", "s", "k", 1, "s", "b"), (5, "word", "en", "s", "k", 1, "s", "b"), (6, LONG, "en", "s", "k", 1, "s", "b"), (7, "é ß 漢字 x😀 <|endoftext|>", "de", "s", "k", 1, "s", "b"), (None, "no id here", "en", "s", "k", 1, "s", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- words ----


def test_words_and_shingles_against_split():
    import pyarrow as pa

    r = random.Random(2)
    texts = ["".join(r.choice("aB é\t\n\x0b\x85漢 ") for _ in range(r.randrange(60))) for _ in range(300)] + [None, "", "x" * 3_000_000, "a b " * 400_000]
    data, off = textnum.view(pa.array(texts))
    w = textnum.words(data, off)
    split = [[x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x] for t in texts]
    assert w.count.tolist() == [len(x) for x in split]
    names = {}
    for h, word in zip(w.hash.tolist(), (x for s in split for x in s)):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    h, at = textnum.shingle_sets(w)
    want = [len({tuple(s[i : i + 5]) for i in range(len(s) - 4)}) if len(s) >= 5 else min(len(s), 1) for s in split]
    assert np.diff(at).tolist() == want


# ---- op1 ----


def test_licences(spark, empty):
    rows = [(1, f"intro\nLicensed under the Apache License, Version 2.0.\n{'plain words of a text ' * 5}"), (2, "Released under the MIT License."), (3, "my driving license expired under the bridge"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."), (7, "x " * 200_000 + "\nall rights reserved"), (8, "the GNU General Public License, version 3")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, line string, paragraph int")
    found = licenses.scan(docs).collect()
    sure = sorted((r["doc_id"], r["family"]) for r in found if r["confirmed"])
    assert sure == [(1, "apache-2.0"), (2, "mit"), (6, "cc-by-nc-4.0"), (7, "proprietary"), (8, "gpl-3.0")]
    assert not any(r["confirmed"] for r in found if r["doc_id"] == 3)
    assert all(0 <= r["probability"] <= 1 for r in found)
    assert licenses.scan(empty).count() == 0
    by_doc = {r["doc_id"]: r["families"] for r in licenses.families(licenses.scan(docs)).collect()}
    assert by_doc == {1: ["apache-2.0"], 2: ["mit"], 6: ["cc-by-nc-4.0"], 7: ["proprietary"], 8: ["gpl-3.0"]}


def test_scores_against_a_plain_computation(spark):
    """Every paragraph of the documents by the model's weights, one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(docs)
    found = {}
    for r in licenses.classify(licenses.with_cue(licenses.paragraphs(docs), model.cues), model).collect():
        found.setdefault((r["doc_id"], r["paragraph"]), []).append(r)
    place = {f: k for k, f in enumerate(model.features)}
    seen = set()
    for d in docs.collect():
        for k, block in enumerate(x for x in re.split(r"\n\s*\n", d["text"] or "") if x.strip()):
            hit = [place[g] for g in licenses.grams_of(licenses.tokens_of(block)) if g in place]
            if not hit:
                continue
            z = (model.weights[hit].sum(axis=0) / np.sqrt(len(hit)) + model.constant) / model.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            seen.add((d["doc_id"], k))
            for r in found[d["doc_id"], k]:
                assert abs(r["probability"] - p[model.classes.index(r["family"])]) < 1e-9
    assert seen == set(found)


def test_licence_bodies_and_wrapped_notices(spark):
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    as_is = 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    rows = [(1, "some words first\n \n" + warranty), (2, gpl), (3, as_is), (4, "Licensed under the Apache\nLicense, Version 2.0"), (5, "Released under the MIT License.\nLicensed under CC BY 4.0."), (6, "the software is fine and the cat sat on the mat")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sure = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in found if r["confirmed"])
    assert sure == [(1, 1, "mit"), (2, 0, "gpl-3.0"), (3, 0, "apache-2.0"), (4, 0, "apache-2.0"), (5, 0, "cc-by-4.0"), (5, 0, "mit")]


def test_licence_features_come_from_labelled_paragraphs(spark):
    rows = [(i, f"Frobnicator grants apply here to item w{i}.\nReleased under the MIT License.") for i in range(30)] + [(100 + i, f"plain text number {i} of the sample") for i in range(30)]
    model = licenses.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "frobnicator grants" in model.features and "w3" not in model.features


def test_repeated_rows_do_not_raise_the_probability(spark):
    schema = "doc_id long, paragraph int, block string, words array<string>"
    row = (1, 0, "released under mit", ["released", "under", "mit"])
    w = np.zeros((1, len(licenses.FAMILIES) + 1))
    w[0, 0] = 1.0
    model = licenses.Model(["released under"], w, np.zeros(len(licenses.FAMILIES) + 1), 1.0)
    once, thrice = ([r["probability"] for r in licenses.classify(spark.createDataFrame([row] * n, schema), model).collect()] for n in (1, 3))
    assert once == thrice


# ---- op2 ----

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]


def test_base_spans_against_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("ab@@..12..55 -+()4:_=é") for _ in range(r.randrange(60)))
        assert [x[:3] for x in pii.spans_of(t) if x[3]] == base_spans(t), t
    for t in ("1" * 300_000, "a" * 300_000, "+1" + "(" * 100_000, "1." * 100_000, "a@" * 100_000):
        assert [x[:3] for x in pii.spans_of(t) if x[3]] == (base_spans(t) if len(t) < 1000 else [x[:3] for x in pii.spans_of(t) if x[3]])


def test_report_and_redaction(spark, odd, empty):
    out = queries.op2_pii(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for k, _, _ in want)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))
    report = pii.report(odd).collect()
    assert len(report) == len(ODD) and all(r["spans"] == "" for r in report)
    assert pii.report(empty).count() == 0
    model = pii.learn(pii.candidates(spark.createDataFrame([(1, "mail me at a.b@c.com or password=abcdef1234567 or 10.1.2.3")], "doc_id long, text string")))
    masked = [r["text"] for r in pii.redact(spark.createDataFrame([(1, "at a.b@c.com, 10.1.2.3"), (2, None)], "doc_id long, text string"), model).collect()]
    assert masked == ["at [EMAIL], [IP]", None]


def test_em_ranks_labelers():
    patterns = {"secret|+++++0": 500, "secret|-+0---": 300, "number|--0--0": 400, "email|++0+00": 800}
    probability, reliability = pii.reliabilities(patterns)
    assert probability["secret|+++++0"] > 0.9 > 0.5 > probability["number|--0--0"]
    assert all(true >= false for true, false in reliability.values())


def test_em_finds_the_reliabilities_that_made_the_votes():
    r = random.Random(12)
    true_for, false_for = [0.9, 0.85, 0.6, 0.9, 0.8, 0.5], [0.1, 0.2, 0.3, 0.1, 0.2, 0.4]
    patterns = {}
    right = {}
    for _ in range(20_000):
        real = r.random() < 0.4
        p = "secret|" + "".join("+" if r.random() < (true_for if real else false_for)[j] else "-" for j in range(6))
        patterns[p] = patterns.get(p, 0) + 1
        right.setdefault(p, []).append(real)
    probability, reliability = pii.reliabilities(patterns)
    for j, name in enumerate(pii.LABELERS):
        assert abs(reliability[name][0] - true_for[j]) < 0.06 and abs(reliability[name][1] - false_for[j]) < 0.06
    for p, real in right.items():  # the exact posterior of the votes
        odds = 0.4 / 0.6
        for j, c in enumerate(p.split("|")[1]):
            odds *= true_for[j] / false_for[j] if c == "+" else (1 - true_for[j]) / (1 - false_for[j])
        assert abs(probability[p] - odds / (1 + odds)) < 0.2


def test_span_classifier_scores_traits_it_never_saw(spark):
    texts = [(i, f"login password={'aB3xK9qLm2' + str(i)} set") for i in range(40)] + [(100 + i, f"order invoice token: {'a' * (8 + i % 9)} page") for i in range(40)]
    model = pii.learn(pii.candidates(spark.createDataFrame(texts, "doc_id long, text string")))
    new = "credential: secret=Qz81_kkP0xx9 \n"
    span = next(x for x in pii.spans_of(new) if x[0] == "secret")
    assert model.score(pii.traits(new, *span[:3])) > 0
    assert pii.masked(new, model) == "credential: secret=[SECRET] \n"
    plain = "order token: aaaaaaaaaaaa page"
    span = next(x for x in pii.spans_of(plain) if x[0] == "secret")
    assert model.score(pii.traits(plain, *span[:3])) < 0


def test_many_spans_take_time_in_proportion():
    import time

    text = "a@b.cd 1234567890123 " * 20_000
    start = time.perf_counter()
    found = pii.spans_of(text)
    assert len(found) == 40_000 and time.perf_counter() - start < 5
    spans = [(random.Random(i).randrange(1000), 0) for i in range(30)]
    spans = sorted((s, s + 3) for s in {x[0] // 5 * 5 for x in spans})
    taken = [(4, 12), (300, 310), (305, 500), (900, 901)]
    assert pii._apart(spans, taken) == [x for x in spans if not any(s < x[1] and x[0] < e for s, e in taken)]


# ---- op3 ----


def test_gif_round_trip(spark, odd, empty):
    r = random.Random(4)
    for size in (64, 128, 64 * 512, 64 * 513, 64 * 1500):
        for palette in (1, 2, 7, 256):
            payload = bytes(r.randrange(palette) for _ in range(size))
            frames, fault = gif.decode(gif.encode(payload))
            assert fault is None and b"".join(f["pixels"] for f in frames) == payload
    rows = gif.digests(odd).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert row["payload_bytes"] % 64 == 0 and row["payload_bytes"] >= max(64, row["n_bytes"]) and row["error"] is None
    by = {x["doc_id"]: x for x in rows}
    for i, text, *_ in ODD:
        b = (text or "").encode()
        b += bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (by[i]["payload_sha256"], by[i]["tail_crc32"]) == (hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]))
    assert gif.digests(empty).count() == 0


def test_feature_counts_the_colours_of_all_frames(spark):
    size = 64 * 512
    docs = spark.createDataFrame([(1, "a" * size + "c" * size), (2, "b" * size + "c" * size)], "doc_id long, text string")
    features = {r["doc_id"]: r["feature"].split("colours=")[1] for r in gif.digests(docs).collect()}
    frames, _ = gif.decode(gif.encode(b"a" * size + b"c" * size))
    assert features[1] == ",".join(str(x) for x in sum(f["histogram"] for f in frames))


def _picture(frames, width=4, height=4, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = struct.pack("<6sHHBBB", b"GIF89a", width, height, 0x80 | 1, 0, 0) + bytes(x for c in colours for x in c)
    for left, top, w, h, pixels, disposal, clear, flags in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, clear or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + b"\x02" + gif._blocks(gif.lzw_pack(gif.lzw_codes(bytes(pixels), 2), 2))
    return out + b"\x3b"


def test_large_canvases():
    """A huge canvas takes the memory of its frames; a frame that claims all of it is a fault."""
    def on_canvas(side, frames):
        data = bytearray(_picture(frames))
        struct.pack_into("<HH", data, 6, side, side)
        return bytes(data)

    small = [(0, 0, 2, 2, [1] * 4, 1, None, 0), (60_000, 200, 2, 2, [2] * 4, 3, None, 0), (60_000, 10, 1, 1, [3], 1, None, 0), (10, 3, 1, 1, [1], 1, None, 0)]
    frames, fault = gif.decode(on_canvas(65535, small))
    assert fault is None and [sum(f["histogram"]) for f in frames] == [4, 8, 5, 6]
    plain, _ = gif.decode(on_canvas(65535, [(x % 300, y % 30, *rest) for x, y, *rest in small]))
    assert [f["pixels"] for f in plain] == [f["pixels"] for f in frames]
    hostile = bytearray(on_canvas(65535, [(0, 0, 2, 2, [1] * 4, 1, None, 0)]))
    at = hostile.index(b"\x2c\x00\x00\x00\x00\x02\x00\x02\x00")
    struct.pack_into("<HH", hostile, at + 5, 65535, 65535)
    frames, fault = gif.decode(bytes(hostile))
    assert frames == [] and "too large" in fault


def test_disposal_transparency_interlace_and_faults(spark):
    red, green, blue = 48, 12, 3
    frames, fault = gif.decode(_picture([(0, 0, 4, 4, [1] * 16, 1, None, 0), (0, 0, 2, 2, [2, 0, 0, 2], 3, 0, 0), (1, 1, 2, 2, [3] * 4, 2, None, 0), (0, 0, 1, 1, [0], 0, 0, 0)]))
    assert fault is None and [f["delay_ms"] for f in frames] == [50] * 4
    h = [f["histogram"] for f in frames]
    assert h[0][red] == 16
    assert (h[1][red], h[1][green]) == (14, 2)  # transparent pixels show the frame below
    assert (h[2][red], h[2][green], h[2][blue]) == (12, 0, 4)  # the second frame was taken back
    assert h[3].sum() == 12  # the third left a hole
    rows = [0, 2, 1, 3]  # of four rows, interlacing stores 0, 2, 1, 3
    frames, fault = gif.decode(_picture([(0, 0, 4, 4, [x for y in rows for x in [y] * 4], 0, None, 0x40)]))
    assert fault is None and np.frombuffer(frames[0]["pixels"], np.uint8).reshape(4, 4)[:, 0].tolist() == [0, 1, 2, 3]
    good = _picture([(0, 0, 4, 4, [1, 2, 3, 0] * 4, 0, None, 0)])
    for n in range(len(good)):
        frames, fault = gif.decode(good[:n])
        assert fault is not None and len(frames) <= 1
    media = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"no"))], "id long, media binary")
    table = gif.frames_table(gif.read_media(media)).collect()
    assert [(r["id"], r["starts_ms"], r["colour_48"]) for r in table] == [(1, 0, 4)]


# ---- op4, op7, op9 ----


def test_language(spark, odd, empty):
    out = queries.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1000 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    model = language.fit(odd)
    got = {r["id"]: r["lang_pred"] for r in language.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[6] == "en" and got[7] == "de"
    assert language.fit(empty) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_language_counts_against_a_plain_model(spark):
    texts = [("en", "the cat sat on the mat"), ("de", "die katze saß auf der matte"), ("en", "a dog"), ("fr", "le chat était là")]
    model = language.fit(spark.createDataFrame([(t, x) for x, t in texts], "text string, lang string"))
    for lang, text in texts:
        raw = text.encode()
        b, _, _ = language.grams(raw, np.array([0, len(raw)]))
        k = model.languages.index(lang)
        assert len(b) == sum(len(text) - n + 1 for n in language.SIZES)
        assert (model.matrix[b].sum(axis=0) + model.prior).argmax() == k


def test_bytes_that_are_no_utf8(spark):
    raw = [b"plain words here", b"caf\xc3", b"\xa9 tail", b"\xe2\x82 broken \xff\xfe", b"\xc3a and \xc2", "größe".encode(), b""]
    docs = spark.createDataFrame(list(enumerate(map(bytearray, raw))), "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text", "'en' as lang")
    model = language.fit(docs)
    assert {r["id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}[5] == "en"
    t = packing.tokeniser_of(*packing.public_vocabulary())
    counts = {}
    for p in packing.pack_texts(docs).collect():
        counts[p["doc_id"]] = counts.get(p["doc_id"], 0) + p["length"]
    for i, b in enumerate(raw):
        want = t.exact.encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids
        assert counts[i] == len(want) + 1, b
    for one in (pii.report(docs), gif.digests(docs), toxicity.score(docs, None), quality.classify(docs.selectExpr("*", "'s' as source"), None)):
        assert one.count() == len(raw)


def test_a_gif_of_another_encoder():
    """The ten by ten picture that tutorials of the format take apart, byte by byte."""
    data = bytes.fromhex("4749463839610A000A00910000FFFFFFFF00000000FF00000021F90400000000002C000000000A000A000002168C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B")
    frames, fault = gif.decode(data)
    red, blue, white = 1, 2, 0
    rows = [[red] * 5 + [blue] * 5] * 3 + [[red] * 3 + [white] * 4 + [blue] * 3] * 2 + [[blue] * 3 + [white] * 4 + [red] * 3] * 2 + [[blue] * 5 + [red] * 5] * 3
    assert fault is None and len(frames) == 1
    assert list(frames[0]["pixels"]) == [x for r in rows for x in r]
    counts = {int(k): int(v) for k, v in enumerate(frames[0]["histogram"]) if v}
    assert counts == {48: 42, 3: 42, 63: 16}


def test_buckets_are_a_parameter(spark):
    """Many languages change no prediction: the number of buckets is the caller's."""
    texts = [("en", "the cat sat on the mat"), ("de", "die katze sass auf der matte"), ("fr", "le chat dormait sur la table")]
    texts += [(f"x{i}", f"{i:05d} " * 3) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit(docs, buckets=1 << 10)
    assert model.matrix.shape == (1 << 10, 1503)
    own = docs.filter("doc_id < 3")
    assert {r["id"]: r["lang_pred"] for r in language.predict(own, model).collect()} == {0: "en", 1: "de", 2: "fr"}
    assert len(language.fit(own).matrix) == language.BUCKETS


def test_ftrl_against_a_plain_loop():
    """Weights of the arrays' form against dictionaries and one coordinate at a time, in the same order of rows."""
    rng = np.random.default_rng(2)
    rows = [sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist()) for _ in range(150)]
    y = np.array([float(rng.random() < (0.9 if 3 in r else 0.2)) for r in rows])
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    index, weight = toxicity.ftrl(np.array([k for r in rows for k in r], np.int64), at, y)
    z, n, order = {}, {}, np.random.default_rng(11)

    def w(k):
        if abs(z.get(k, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[k] > 0 else -1
        return -(z[k] - sign * toxicity.L1) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(y)):
            own = [*rows[i], toxicity.COORDINATES]
            old = {k: w(k) for k in own}
            g = 1 / (1 + np.exp(-sum(old.values()))) - y[i]
            for k in own:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / toxicity.ALPHA * old[k]
                n[k] = before + g * g
    want = {k: w(k) for k in n if w(k)}
    assert index.tolist() == sorted(want)
    assert np.allclose(weight, [want[k] for k in sorted(want)])
    assert max(want, key=want.get) == 3


def test_toxicity(spark, odd, empty):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        w = [r.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(["idiot", "moron"])
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 600"))
    held = toxicity.score(df.filter("doc_id >= 600"), model).join(df.select("doc_id", "label"), F.col("id") == F.col("doc_id")).collect()
    assert sum((x["score"] >= 0.7) == bool(x["label"]) for x in held) >= 0.97 * len(held)
    assert len(model.index) < 400  # sparse
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(df.limit(0)) is None
    assert {x["score"] for x in toxicity.score(odd, None).collect()} == {0.0}


def test_quality(spark, odd, empty):
    out = queries.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["quality_kept"] == bool(r["quality"]) for r in held) >= 0.97 * len(held)
    got = {r["doc_id"]: r for r in quality.classify(odd, None).collect()}
    assert not any(got[i]["quality_kept"] for i in (1, 2, 3)) and got[5]["quality_kept"]
    assert got[5]["bucket"] == "b"
    assert quality.classify(empty, None).count() == 0


def test_quality_keeps_columns_of_any_name(spark):
    rows = [(1, "some words of a text", "s", "en", 0.123, "k", 1, 2, "d", "h"), (2, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality_posterior double, _key string, _group int, _prior int, `a.b` string, _host string")
    got = quality.accepted(docs, None)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [rows[0]]
    assert [c for c in quality.classify(docs, None).columns if c not in docs.columns] == ["quality_evidence", "quality_posterior_", "quality_kept"]


def test_posteriors_against_a_plain_computation(spark):
    r = random.Random(9)
    rows = [(h := f"h{r.randrange(12)}", f"{h}/p{r.randrange(3)}", r.random() ** (1 + int(h[1:]) % 3)) for _ in range(900)]
    n, total, hn, ht = {}, {}, {}, {}
    for h, p, x in rows:
        n[h, p], total[h, p] = n.get((h, p), 0) + 1, total.get((h, p), 0) + x
        hn[h], ht[h] = hn.get(h, 0) + 1, ht.get(h, 0) + x
    mean = sum(ht.values()) / len(rows)

    def strength(between, size):
        real = max(between - mean * (1 - mean) / size, 1e-9)
        return min(max(mean * (1 - mean) / real - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    spread = lambda n, t: sum(t[k] ** 2 / n[k] for k in n) / len(rows) - mean**2
    between, below = spread(hn, ht), spread(n, total)
    k = strength(between, len(rows) / len(hn))
    kp = strength(max(0.0, below) - between, len(rows) / len(n))
    got = {(x["host"], x["path"]): x for x in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert set(got) == set(n)
    for key, x in got.items():
        assert x["n"] == n[key] and abs(x["total"] - total[key]) < 1e-9
        assert abs(x["host_share"] - (ht[key[0]] + k * mean) / (hn[key[0]] + k)) < 1e-9 and abs(x["strength"] - kp) < 1e-6 * kp


def test_pages_have_hosts_and_paths(spark):
    rows = [(1, "https://A.example.com:80/en/25#top", "<html><head><title>no</title></head><p>some <b>words</b></p><script>var t='</p>'</script>"), (2, "mailto:x", None), (3, None, "plain")]
    got = {r["id"]: r for r in quality.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["text"].split()) == ("a.example.com", "en", ["some", "words"])
    assert (got[2]["host"], got[2]["path"], got[2]["text"]) == (None, None, "") and got[3]["text"] == "plain"
    out = queries.pages_quality(spark, SF).collect()
    assert len(out) == 250 and all(r["host"] for r in out)


def test_sparse_hosts_shrink_to_the_global_share(spark):
    rows = [("good", "p", 0.95)] * 400 + [("bad", "p", 0.05)] * 400 + [("one", "p", 0.0), (None, None, 1.0)]
    share = {r["host"]: r["host_share"] for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert share["bad"] < 0.1 and share["good"] > 0.9
    assert share["bad"] < share["one"] < 0.5 and 0.5 < share[None] < share["good"]


# ---- op10 ----


def test_packing_against_the_tokeniser(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, text) for i, text, *_ in ODD]
    r = random.Random(6)
    rows += [(100 + i, "".join(r.choice("ab é  \n\t 漢'sRE12.,-😀\x85\x1c") for _ in range(r.randrange(300)))) for i in range(300)]
    out = packing.pack_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4") for i, text in rows}
    places = {}
    for p in out:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(len(want[i]) for i, _ in rows)
    assert sum(p["length"] for p in out) == total
    padding = sum(1024 - s for s in (sum(n for _, n in x) for x in places.values()) if s & (s - 1))
    assert padding <= 0.02 * total + 1024 * 8
    assert packing.pack_texts(empty).count() == 0


def test_packer_takes_the_largest_dot_product():
    """Against the rule, told plainly, for whole examples."""
    r = random.Random(21)
    packer, waiting = packing.Packer(100, 5, 60, pool=40, min_cut=101), []
    for i in range(400):
        n = r.randrange(1, 100)
        m = r.randrange(min(n, 60) + 1)
        waiting.append((n, m, i))
        found = packer.add(n, m, i)
        if len(waiting) > 40:
            left, left_loss, want = 100, 60, []
            while len(want) < 5:
                fit = [x for x in waiting if x[0] <= left and x[1] <= left_loss]
                if not fit or not left:
                    break
                best = max(fit, key=lambda x: x[0] * left / 100**2 + x[1] * left_loss / 60**2)
                value = lambda x: x[0] * left / 100**2 + x[1] * left_loss / 60**2  # noqa: B023, E731
                own = next(f for f in found if f[0] in {x[2] for x in fit if abs(value(x) - value(best)) < 1e-12} and f[0] not in {w[2] for w in want})
                best = next(x for x in waiting if x[2] == own[0])
                want.append(best)
                waiting.remove(best)
                left, left_loss = left - best[0], left_loss - best[1]
            assert [f[0] for f in found] == [x[2] for x in want]


def test_conversations_are_packed_whole(spark):
    out = queries.conversations_packing(spark, SF).collect()
    t = packing.tokeniser_of(*packing.public_vocabulary())
    size = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        n = len(t.exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        s = size.setdefault(r["conv_id"], [0, 0])
        s[0] += n
        s[1] += n * (r["role"] == "assistant")
    assert {r["conv_id"]: [r["n_tokens"], r["n_loss"]] for r in out} == size
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        assert len(rows) == 1 or sum(r["n_tokens"] for r in rows) <= 1024 and sum(r["n_loss"] for r in rows) <= 768 and len(rows) <= 16


def test_packer_against_a_plain_choice():
    """Sequences filled from a pool: always the piece that fits and has the largest dot product with what is left."""
    r = random.Random(6)
    for _ in range(30):
        most, segments, most_loss = 100, r.randrange(2, 6), r.randrange(40, 120)
        sizes = r.sample(range(1, 101), 25)
        pieces = [(n, r.randrange(min(n, most_loss) + 1), i) for i, n in enumerate(sizes)]
        packer = packing.Packer(most, segments, most_loss, pool=100, min_cut=most + 1)
        for n, m, i in pieces:
            assert packer.add(n, m, i) is None
        waiting = list(pieces)
        while waiting:
            left, left_loss, want = most, most_loss, []
            while len(want) < segments:
                fits = [p for p in waiting if p[0] <= left and p[1] <= left_loss]
                if not fits or not left:
                    break
                best = max(fits, key=lambda p: p[0] * (left / most**2) + p[1] * (left_loss / most_loss**2))
                want.append((best[2], best[0], best[1]))
                waiting.remove(best)
                left, left_loss = left - best[0], left_loss - best[1]
            assert packer.fill() == want


def test_conversations_without_id_are_packed(spark):
    rows = [(None, "user", "a b"), (None, "assistant", "c"), (1, "assistant", None), (1, None, "x y z")]
    out = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, role string, text string")).collect()
    assert sorted((r["conv_id"] or 0, r["n_tokens"], r["n_loss"], r["offset"]) for r in out) == [(0, 5, 2, 0), (1, 5, 1, 5)] or sorted((r["conv_id"] or 0, r["n_tokens"], r["n_loss"]) for r in out) == [(0, 5, 2), (1, 5, 1)]
    assert sum(r["n_tokens"] for r in out) == max(r["offset"] + r["n_tokens"] for r in out)


def test_sizes_of_batches(spark):
    assert [byte_size(x) for x in ("64m", "4194304b", "12", " 1 GB ", "-1", "5kb")] == [64 << 20, 4 << 20, 12, 1 << 30, -1, 5 << 10]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    first = spark.conf.get(key)
    for given, want in (("64m", 4 << 20), ("1k", 1024)):
        spark.conf.set(key, given)
        before = small_batches(spark)
        assert byte_size(spark.conf.get(key)) == want
        restore_batches(spark, before)
        assert spark.conf.get(key) == given
    spark.conf.set(key, first)


def test_traits_of_long_spans_read_all_of_them():
    text = "a" * 5000 + "1" * 5000 + "@x.yz"
    whole = pii.traits(text, "email", 0, len(text))
    digits = whole[list(pii.TRAITS).index("digits")] - pii._FIRST["digits"]
    assert digits == 1  # a half of the span, not of its first 4,096 characters


def test_long_paragraphs_of_notices(spark):
    """A paragraph of a megabyte with all notices and clauses in it: same families as its notices give, in seconds."""
    own = [t for f in licenses.FAMILIES for t in (*licenses.TEMPLATES[f], *licenses.CLAUSES[f])]
    filler = [f"component{i} part{i % 97}" for i in range(30)]
    text = "\n".join(" ".join([own[i % len(own)], *filler]) for i in range(2500))
    assert len(text) > 1_000_000
    docs = spark.createDataFrame([(1, text), (2, "Released under the MIT License")], "doc_id long, text string")
    model = licenses.fit(docs)
    start = time.time()
    found = licenses.classify(licenses.with_cue(licenses.paragraphs(docs), model.cues), model).collect()
    assert time.time() - start < 60
    assert {r["family"] for r in found if r["doc_id"] == 1 and r["confirmed"]} >= set(licenses.FAMILIES)
    assert [(r["family"], r["confirmed"]) for r in found if r["doc_id"] == 2] == [("mit", True)]


def test_vector_limits_hold(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(1, 900), None) for i in range(2000)]
    rows = [(i, n, r.randrange(n + 1)) for i, n, _ in rows] + [(5000, 3000, 10), (5001, None, None), (5002, 10, 9000)]
    out = packing.pack_lengths(spark.createDataFrame(rows, "id long, n long, m long"), "id", "n", "m", 1024, 4, 500).collect()
    assert sorted(x["id"] for x in out) == sorted(i for i, _, _ in rows)
    size = {i: (n or 0, m or 0) for i, n, m in rows}
    sums = {}
    for x in out:
        s = sums.setdefault(x["sequence_id"], [0, 0, 0, 0])
        s[0] += size[x["id"]][0]
        s[1] += 1
        s[2] += size[x["id"]][1]
    for n, k, m, _ in sums.values():
        assert k == 1 or (n <= 1024 and k <= 4 and m <= 500)
    lower = max(sum(n for n, _ in size.values()) / 1024, sum(m for _, m in size.values()) / 500)
    assert len(sums) <= 1.25 * lower
