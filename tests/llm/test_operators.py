import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessaline.llm import audio_prints, decontaminate, language_id, licenses, mixing, near_dup, quality, sharding, token_counts, url_filters
from tessaline.llm.components import connected_components

EDGES = [(900, None, "en", None), (901, "", "en", "b"), (902, " \n\t ", None, "b"), (903, "same text here", "en", "a"), (903, "same text here", "en", "a"), (None, "no id", "en", "a")]


def test_licenses(documents, prose):
    text = prose(100) + "\nReleased UNDER the MIT-License. " + prose(50) + " under the mit license"
    gpl = prose(70) + " This work is licensed under the GNU General Public License, version 3."
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents([(1, text, "en", "a"), (2, gpl, "en", "a"), (3, prose(200), "en", "a"), *EDGES])).collect()}
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    at = [i for i in range(len(words) - 3) if words[i : i + 4] == "under the mit license".split()]
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (len(words), 2, at[0], at[1], "mit")
    assert got[2]["labels"] == "gpl-3" and got[2]["n_base"] == 0 and got[2]["first_word"] is None and got[2]["score"] >= 0.8
    assert got[3]["labels"] == "" and got[3]["score"] == 0 and got[900]["n_words"] == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(documents(EDGES), templates=[("x", "too short a template")])


def test_licenses_equal_plain_containment(documents, rng):
    ws = TEMPLATE.split()
    rows = [(i, " ".join(rng.sample(ws, rng.randint(3, len(ws))) + ["filler"] * rng.randint(0, 90)), "en", "a") for i in range(40)]
    got = {r["doc_id"]: {(m["block"], m["containment"]) for m in r["blocks"]} for r in licenses.scan_licenses(documents(rows), phrases={"a b": "x"}, templates=[("t", TEMPLATE)]).collect()}
    for i, text, *_ in rows:
        w, want = text.split(), set()
        for b in range(max(0, -(-(len(w) - 64) // 32)) + 1):
            share = len(set(ws) & set(w[b * 32 : b * 32 + 64])) / len(set(ws))
            if share >= 0.8:
                want.add((b, share))
        assert got[i] == want


def test_a_template_finds_the_same_beside_others(documents, prose, rng):
    """A short notice scattered over a long text is no match, whatever else is sought; 600 whole licenses at once."""
    notice = prose(12)
    scattered = " ".join(f"{w} {prose(160)}" for w in notice.split())
    many = [(f"m{i}", prose(rng.randint(100, 3000))) for i in range(600)]
    rows = [(1, scattered, "en", "a"), (2, f"{prose(300)} {notice} {prose(300)}", "en", "a"), (3, f"{prose(200)} {many[17][1]}", "en", "a")]
    read = lambda templates: {r["doc_id"]: [b for b in r["blocks"] if b["label"] == "notice"] for r in licenses.scan_licenses(documents(rows), templates=templates).collect()}
    alone = read([("notice", notice)])
    assert alone[1] == [] and len(alone[2]) >= 1 and read([("notice", notice), *many]) == alone
    assert "m17" in {r["doc_id"]: r for r in licenses.scan_licenses(documents(rows), templates=many).collect()}[3]["labels"].split(",")


def test_licenses_whole_texts_as_templates(documents, prose, rng):
    """Templates of several lengths up to 170 words, some absent, in texts around a block's length and far longer; null, empty and repeated rows."""
    long = [prose(n).split() for n in (170, 90, 33, 12)]
    templates = [(f"t{i}", " ".join(ws)) for i, ws in enumerate(long)]
    rows = []
    for i, ws in enumerate(long):
        for keep in (1.0, 0.85, 0.7):
            kept = [w if rng.random() < keep else prose(1) for w in ws]
            rows.append((len(rows), prose(rng.randint(0, 400)) + " " + " ".join(kept) + " " + prose(rng.randint(0, 400)), "en", "a"))
    rows.append((99, prose(30_000) + " " + " ".join(long[1]), "en", "a"))
    got = licenses.scan_licenses(documents([*rows, rows[0], *EDGES]), phrases={"a b": "x"}, templates=templates).collect()
    by = {r["doc_id"]: {(m["block"], m["label"], m["containment"]) for m in r["blocks"]} for r in got}
    for i, text, *_ in rows:
        w, want = text.split(), set()
        for label, t in templates:
            step = max(32, len(t.split()))  # each template has blocks of its own
            for b in range(max(0, -(-(len(w) - 2 * step) // step)) + 1):
                share = len(set(t.split()) & set(w[b * step : b * step + 2 * step])) / len(set(t.split()))
                if share >= 0.8:
                    want.add((b, label, share))
        assert by[i] == want
    assert len(got) == len(rows) + 1 + len(EDGES) and by[99] and not by[901] and by[None] == set()
    # equal templates are one, and a table of them does the same as a list
    again = licenses.scan_licenses(documents(rows), phrases={"a b": "x"}, templates=documents([]).sparkSession.createDataFrame(templates * 2, "label string, text string")).collect()
    assert {r["doc_id"]: {(m["block"], m["label"], m["containment"]) for m in r["blocks"]} for r in again} == {i: by[i] for i, *_ in rows}
    assert licenses.scan_licenses(documents([])).count() == 0 and licenses.scan_licenses(documents(EDGES), templates=[]).filter("size(blocks) > 0").count() == 0


TEMPLATE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, documents, prose, rng):
    rows, i = [], 0
    for _ in range(6):  # chains of edits, so that members far apart are linked through others only
        words = prose(rng.choice([12, 80, 300, 1300])).split()
        for _ in range(14):
            i += 1
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 90))):
                words[rng.randrange(len(words))] = prose(1)
            rows.append((i, " ".join(words)))
    passage = prose(70)
    rows += [(i + k, passage + " " + prose(rng.randint(3, 60))) for k in range(1, 120)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, None), (1003, ""), (1004, "one two"), (1005, "ONE  two")]
    rng.shuffle(rows)
    want, sizes = brute_components(rows)
    got = near_dup.near_duplicates(documents([(a, t, "en", "s") for a, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_bands_miss_few():
    assert [near_dup.band_of(t) for t in (0.8, 0.85)] == [5, 6]
    assert all(near_dup.miss(p / 100, near_dup.band_of(p / 100)) <= near_dup.MISS for p in range(80, 101))


def test_stage_links_from_80_percent(spark, documents, prose):
    import corpus_pipeline

    rows = []
    for k in range(30):  # 104 words are 100 shingles; of a changed word and its neighbours 5 are lost: 90 of 110 are shared
        words = prose(104).split()
        changed = list(words)
        changed[30], changed[70] = prose(1), prose(1)
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join(changed), "en", "s")]
    want, _ = brute_components(rows := [(i, t) for i, t, *_ in rows], percent=80)
    assert len(set(want.values())) == 30 and len(set(brute_components(rows)[0].values())) == 60
    kept = corpus_pipeline.drop_near_duplicates(spark, documents([(i, t, "en", "s") for i, t in rows]), "")
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_near_duplicates_odd_rows(documents):
    got = near_dup.near_duplicates(documents(EDGES)).collect()
    assert len(got) == 6 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} >= {(903, 903, True), (None, None, True), (901, 901, True)}
    assert near_dup.near_duplicates(documents([])).count() == 0


def test_register_collisions_are_corrected():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.r_[a[:360], rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    est = near_dup.estimate(near_dup.sketch_whole(a)[None], near_dup.sketch_whole(b)[None])[0]
    assert abs(est - 360 / 440) < 0.12
    assert 0 < near_dup.CHANCE < 0.001


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def test_components_of_many_tasks_equal_one(spark, rng):
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)], "a long, b long")
    one, many = (sorted(map(tuple, connected_components(edges, edges_per_task=n).collect())) for n in (10_000, 40))
    assert one == many and len(one) > 300


def test_leaks(spark, documents, prose):
    items = [(k, prose(30 + k) + ". " + prose(6) + ".") for k in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    altered = items[3][1].split()
    altered[4], altered[9] = "changed", "words"
    rows = [(k, prose(150), "en", "a") for k in range(60)] + [(100, prose(80) + " " + items[2][1] + " " + prose(70), "en", "a"), (101, prose(20) + " " + " ".join(altered), "en", "a"), *EDGES]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(documents(rows), bench, fit_docs=200).collect()}
    assert set(got) == {(100, 2), (101, 3)} and got[(100, 2)]["overlap"] == 1 and got[(100, 2)]["first_word"] <= 80
    assert decontaminate.find_leaks(documents([]), bench).count() == 0
    assert decontaminate.find_leaks(documents(rows), bench.limit(0)).count() == 0


def brute_leaks(docs, items, sure=0.75, likely=0.6):
    """(document, item) -> overlap: every item against every stretch of every text."""
    out = {}
    for (i, text), (j, item) in itertools.product(docs, items):
        a, words, answer = decontaminate.words_of(item), decontaminate.words_of(text), decontaminate.answer_of(item)
        if not a:
            continue
        size, best, found = len(a) + max(2, len(a) // 4), 0, False
        for k in range(len(words)):
            n = decontaminate.lcs(a, words[k : k + size])
            best = max(best, n)
            found = found or bool(n >= likely * len(a) and answer and decontaminate.lcs(answer, words[k : k + size]) >= 0.8 * len(answer))
        if best == len(a) or len(a) >= 5 and (best >= sure * len(a) or best >= likely * len(a) and found):
            out[i, j] = best / len(a)
    return out


def test_leaks_equal_brute_force(spark, documents, prose, rng):
    often = "the of and to in is that with as it".split()

    def passage(n):
        words = [rng.choice(often) if rng.random() < 0.5 else prose(1) for _ in range(n)]
        return " ".join(words[: n - n // 4]) + ". " + " ".join(words[n - n // 4 :]) + "."

    items = [(k, passage(n)) for k, n in enumerate([3, 4, 5, 6, 8, 9, 11, 14, 18, 24, 33, 40, 58, 75, 140] * 2)]
    rows = [(k, passage(rng.randint(5, 260))) for k in range(40)]
    for _, item in items:
        words = item.split()
        rare = [k for k, w in enumerate(words) if w.strip(".") not in often]
        for share in (0.0, 0.2, 0.3, 0.4, 0.45):  # the rare words are replaced first, others after them
            changed, order = list(words), rare + [k for k in range(len(words)) if k not in rare]
            for k in order[: int(share * len(words))]:
                changed[k] = prose(1)
            for _ in range(rng.choice([0, 0, len(words) // 6])):
                changed.insert(rng.randrange(len(changed)), prose(1))
            rows.append((len(rows), passage(rng.randint(5, 90)) + " " + " ".join(changed) + " " + passage(rng.randint(5, 90))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(documents([(i, t, "en", "a") for i, t in rows]), bench, fit_docs=200).collect()}
    want = brute_leaks(rows, items)
    assert {k: r["overlap"] for k, r in got.items()} == want and len(want) > 80
    for (i, j), r in got.items():
        a, words = decontaminate.words_of(items[j][1]), decontaminate.words_of(rows[i][1])[r["first_word"] :]
        assert decontaminate.lcs(a, words[: len(a) + max(2, len(a) // 4)]) == round(r["overlap"] * len(a))


def test_leak_cosines_come_from_all_documents(spark, documents):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "iota kappa lambda mu nu xi omicron pi")]
    # "other" stands in 4 of 64 documents, "often" in all of them
    rows = [(k, "often " + ("other" if k < 3 else f"only{k}"), "en", "a") for k in range(63)]
    rows.append((100, "alpha beta gamma delta other often zeta eta theta", "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    idf = lambda n: math.log(65 / (1 + n)) + 0.1
    # fewer terms than latent axes: the cosine is that of the weighted words themselves
    want = 7 * idf(1) ** 2 / math.sqrt((7 * idf(1) ** 2 + idf(4) ** 2 + idf(64) ** 2) * (7 * idf(1) ** 2 + idf(0) ** 2))
    for fit_docs in ({}, {"fit_docs": 1}):
        (got,) = decontaminate.find_leaks(documents(rows), bench, **fit_docs).collect()
        assert (got["doc_id"], got["item_id"]) == (100, 1) and got["cosine"] == pytest.approx(want, abs=1e-3)


def test_rare_answers_are_found(spark, documents, prose):
    words = prose(20).split()
    bench = spark.createDataFrame([(1, " ".join(words), "rareanswer")], "item_id long, text string, answer string")
    # 13 of 20 words in order are enough with the answer only
    held = [w if k < 13 else "filler" for k, w in enumerate(words)]
    rows = [(1, " ".join([*held[:18], "rareanswer"]), "en", "a"), (2, " ".join(held), "en", "a")]
    got = decontaminate.find_leaks(documents(rows), bench, answer_col="answer").collect()
    assert [(r["doc_id"], r["answer_found"]) for r in got] == [(1, True)]


def test_words_are_numbered_as_one_by_one():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}B" for c in points] + [f"{c}\u03a3" for c in points] + [None, "", " ", "\u0391\u03a3, _\u0391\u03a3_ x_y \u0130I \x00 a\x00b"]
    for low, high in [(0, len(texts)), (5, 50), (len(texts) - 4, len(texts) - 1), (0, 0)]:
        sizes, places, words = decontaminate.number_words(pa.array(texts, pa.string()).slice(low, high - low))
        got = [words[k].as_py() for k in places.tolist()] if high < 100 else np.array(words.to_pylist())[places].tolist()
        assert got == [w for t in texts[low:high] for w in decontaminate.words_of(t)] and sizes.tolist() == [len(decontaminate.words_of(t)) for t in texts[low:high]]
        assert len(set(words.to_pylist())) == len(words)


def test_two_passes_fit_all_documents(spark, documents, rng, monkeypatch):
    """The fit reads the documents as often as it multiplies by A'A, and its axes span what a dense SVD's do."""
    passes, settle = [], decontaminate.Scratch.settle
    monkeypatch.setattr(decontaminate.Scratch, "settle", lambda self, df, tag, **options: (passes.append(tag), settle(self, df, tag, **options))[1])
    topics = [[f"w{t}x{k}" for k in range(12)] for t in range(6)]
    rows = [(k, " ".join(rng.choice(topics[k % 6]) for _ in range(32)), "en", "a") for k in range(300)]
    items = [(t, " ".join(topics[t]), None) for t in range(6)]
    chunks, index = decontaminate.fit_index(documents(rows), items, "text", "doc_id", 6)
    assert passes.count("sums") == 2
    kept = {}
    for r in chunks.collect():
        sizes = np.frombuffer(r["sizes"], np.uint32)
        held = np.frombuffer(r["terms"], f"u{len(r['terms']) // int(sizes.sum())}")
        kept |= dict(zip(r["ids"], np.split(held, np.cumsum(sizes)[:-1]), strict=True))
    names = index.vocabulary.to_pylist()
    assert {i: " ".join(names[k] for k in t) for i, t in kept.items()} == {i: t for i, t, _, _ in rows}
    idf = index.idf[:-1].astype(np.float64)
    a = np.array([np.bincount(t, minlength=len(names)) * idf for t in kept.values()] + [np.bincount(t, minlength=len(names)) * idf for t in index.items for _ in range(50)])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    axes = np.linalg.svd(a, full_matrices=False)[2][:6]
    latent = index.vectors[:-1] / idf[:, None]
    assert np.allclose(latent.T @ latent, np.eye(6), atol=1e-4)
    assert np.linalg.norm(axes @ latent) ** 2 > 6 - 1e-3


def test_passage_sums_equal_plain_ones(rng):
    np_rng = np.random.default_rng(5)
    sizes = np.array([1, 31, 32, 33, 100, 700])
    places, terms = np_rng.integers(0, 12, sizes.sum()).astype(np.int32), np.array([9, 0, 5, 3, 10, 10, 7, 1, 2, 10, 4, 8])
    idf, basis = np_rng.random(10) + 0.1, np_rng.standard_normal((10, 4)).astype(np.float32)
    z, gram = np.zeros_like(basis), np.zeros((4, 4))
    decontaminate.project(places, sizes, terms, idf, basis, z, gram)
    a = []
    for text in np.split(terms[places], np.cumsum(sizes)[:-1]):
        for k in range(0, len(text), 32):
            x = np.bincount(text[k : k + 32], minlength=11)[:10] * idf
            a.append(x / max(np.linalg.norm(x), 1e-30))
    a = np.array(a)
    assert np.allclose(z, a.T @ (a @ basis), atol=1e-4) and np.allclose(gram, (a @ basis).T @ (a @ basis), atol=1e-4)


def test_lcs_equals_table(rng):
    for _ in range(50):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))], [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_language_id(documents, rng):
    make = lambda parts: lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    talk = {"aa": make(["the", "ing", "an", "er", "sh"]), "bb": make(["eau", "oi", "que", "le", "é"])}
    rows = [(i, talk[lang](60), lang, "s") for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = documents([*rows, (800, "12 34 !!", "aa", "s"), (801, "ΔΩΨΘΞ " * 40, None, "s"), *EDGES])
    training = docs.filter("doc_id < 80").select("doc_id", "lang", "text")
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs, training).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i >= 80)
    assert got[800]["lang_pred"] == got[900]["lang_pred"] == "und" and got[800]["score"] == 0
    assert not got[801]["accepted"] and all(got[i]["accepted"] for i in range(80, 120)) and all(0 <= r["score"] <= 1 for r in got.values())
    short = {r["doc_id"]: r["accepted"] for r in language_id.identify_languages(documents([(1, "ΔΩΨ ΘΞΠ", None, "s"), (2, "qzx wkj", None, "s"), (3, "theing", None, "s")]), training).collect()}
    assert short == {1: False, 2: False, 3: True}
    none = language_id.identify_languages(docs, training.limit(0)).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in none] == ["und"]


def test_kneser_ney_sums_to_one():
    model = language_id.KneserNey({"x": ["abab abba baab", "aab"]})
    letters = sorted({c for c in "ab"})
    for context in ("\x02\x02\x02", "\x02\x02a", "\x02ab", "aba"):
        total = sum(float(np.exp(model.log_probabilities(np.array([ord(c) for c in "\x02" + context] + [ord(n)], np.uint64))[-1, 0])) for n in [*letters, "\x03", "?"])
        assert total == pytest.approx(1, abs=1e-4)


def test_audio(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=64) for _ in range(40)]
    rate, rows, where = 4000, [], {}
    for i, v in enumerate(vectors):
        rows.append((i + 1, (audio_prints.melody(v) * 20000).astype("<i2").tobytes()))
    for k, i in enumerate(range(0, 40, 2)):
        shifted = audio_prints.melody(vectors[i])[3 * audio_prints.HOP :]
        noisy = shifted + 0.05 * rng.normal(size=len(shifted))
        rows.append((50 * (k + 1), (noisy * 20000).astype("<i2").tobytes()))
        where[50 * (k + 1)] = i + 1
    rows += [(5000, None), (5001, b""), (5002, rows[0][1])]
    media = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id long, pcm binary")
    prints = audio_prints.fingerprints(media, "id", "pcm", rate)
    got = {r["id"]: r for r in audio_prints.align(prints, "id", (F.col("id") % 50 == 0)).collect()}
    found = sum(any(m["class_id"] == where[q] and m["offset"] == 3 for m in got[q]["matches"]) for q in where)
    assert found >= 0.9 * len(where) and all(r["n_matches"] <= 1 for r in got.values())
    assert got[5002]["class_id"] == 1 and got[5000]["class_id"] == got[5001]["class_id"] and got[2]["n_matches"] == 0
    # brute force: every pair at every offset
    p = {r["id"]: np.array(r["prints"], np.int32).view(np.uint32) for r in prints.collect()}
    close = {(q, r) for q in where for r in p if r != q and r < 50 and len(p[r]) and min(np.bitwise_count(p[q][: len(p[r]) - o] ^ p[r][o : o + len(p[q])][: len(p[q])]).mean() for o in range(5)) / 32 <= 0.1}
    assert len({(q, m["class_id"]) for q in where for m in got[q]["matches"]} & close) >= 0.9 * len(close)


def test_audio_alignment_equals_brute_force(spark):
    """Over a thousand classes share all their integers but a few; short ones and stretches of silence are among them."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 31), 1 << 31, 12, dtype=np.int64)
    rows = []
    for i in range(1100):
        x = base[: rng.integers(4, 13)].copy()
        x[rng.integers(len(x))] = rng.integers(-(1 << 31), 1 << 31)
        rows.append((i, [int(v) for v in x]))
    rows += [(2000, [7] * 40 + [int(v) for v in base]), (2001, [7] * 5 + [int(v) for v in base]), (2002, [7] * 3), (2003, []), (2004, None), (None, [7] * 3)]
    prints = spark.createDataFrame(rows, "id long, prints array<int>")
    got = {r["id"]: {m["class_id"] for m in r["matches"]} for r in audio_prints.align(prints, "id", F.col("id") % 500 == 0).collect()}
    first: dict[tuple, int] = {}
    for i, x in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        first.setdefault(tuple(x), i)
    a = {i: np.array(x, np.int64).astype(np.uint32) for x, i in ((x, i) for x, i in first.items())}
    for q in (0, 500, 1000, 2000):
        x, want = np.array(dict(rows)[q], np.int64).astype(np.uint32), set()
        for i, y in a.items():
            votes = {}
            for at, v in enumerate(x):
                for at_other, w in enumerate(y):
                    if v == w and (at == 0 or x[at - 1] != v) and (at_other == 0 or y[at_other - 1] != w):
                        votes[at_other - at] = votes.get(at_other - at, 0) + 1
            if not votes or tuple(dict(rows)[i]) == tuple(dict(rows)[q]):
                continue
            o = min(votes, key=lambda o: (-votes[o], o))
            s, t = x[max(0, -o) :], y[max(0, o) :]
            n = min(len(s), len(t))
            if n >= min(16, -(-min(len(x), len(y)) // 2)) and np.bitwise_count(s[:n] ^ t[:n]).sum() / (32 * n) <= 0.1:
                want.add(i)
        assert got[q] == want and (q == 2000 or len(want) > 100)


def test_audio_query_finds_its_excerpts():
    """A tenth of the table's queries at least would have to fail for this to fail: recall of 0.9."""
    rng = np.random.default_rng(8)
    hits = 0
    for _ in range(40):
        v = rng.normal(size=64).tolist()
        whole, part = (audio_prints.packed(audio_prints.chroma(f(v), 4000)).view(np.uint32) for f in (audio_prints.melody, audio_prints.excerpt))
        hits += np.bitwise_count(whole[3 : 3 + len(part)] ^ part[: len(whole) - 3]).mean() / 32 <= 0.1
    assert hits >= 36


def test_sharding(documents, prose, rng):
    texts = [prose(rng.randint(1, 60)) for _ in range(200)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(1000 + i, texts[0], "en", "s") for i in range(60)] + EDGES
    got = sharding.shard_documents(documents(rows), shards=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values()) and len(got) == len(rows) and set(by) <= set(range(10))
    text = {i: t for i, t, *_ in rows}
    home = {}
    assert all(home.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"] for r in got)
    import zlib

    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    assert sharding.shard_documents(documents([]), shards=4).count() == 0


def test_smallest_capacity_equals_brute_force(rng):
    for _ in range(60):
        sizes, k = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *cut), (*cut, len(sizes)))) for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))
        assert sharding.smallest_capacity(sizes, k) == best
        cuts = [0, *sharding.choose_cuts(sizes, k), len(sizes)]
        assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) <= best


def test_url_filters(spark, rng):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "/fr/x", "block"), ("b.org", "", "block")]
    hosts = ["net", "a.net", "xnet", "example.net", "www.Example.NET", "badexample.net", "example.com", "m.example.com", "a.b.org", "z.a.b.org", "b.org", "c.org", "example.net:80"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/de/x?y=/en/", "/fr/x#a", "?q=/fr/", "/fr/")] + [None, "", "nothing", "a://b://c/en/", "://", "x://?"] + ["http://hot.net/1"] * 300
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, rules, ranges=7).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[2:] if fit else (None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *want), u
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0 and url_filters.filter_urls(pages, []).filter("rule is null").count() == len(urls)


def test_token_counts(documents, rng):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    letters = "ab the ▁  \n\t日本ßé🙂0x<s>\x00　ingtion"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "a" * 5000, "the" * 900, "</s><unk>"]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, token_counts.read_piece_model(path)).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_mix(documents, prose, rng):
    rows = [(i, prose(rng.randint(1, 30)), "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 20)] + EDGES
    docs = documents(rows)
    got = mixing.mix_sources(docs, None, bins=16).collect()
    again = mixing.mix_sources(docs.repartition(5), None, bins=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    source, total = {i: s for i, _, _, s in rows}, {}
    for i, t, _, s in rows:
        total[s] = total.get(s, 0) + len((t or "").split())
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, dict(weight), float(sum(total.values()))
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * total[s]]
        for s in over or list(free):
            target[s] = 3.0 * total[s] if over else level * free[s]
            left -= target[s]
            del free[s]
    for s in total:
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == total[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max([r["size"] for r in mine] + [1])
        assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in mine)
    assert mixing.mix_sources(documents([])).count() == 0


def test_quality(spark, documents, prose, rng):
    rows, grades = [], []
    for i in range(400):
        g = rng.randint(0, 2)
        words = prose(60).split()
        if g == 0:
            words[rng.randrange(60)] = words[3] = "idiot"
        if g == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
        grades.append((i, g))
    ratings = spark.createDataFrame([x for x in grades if x[0] < 300] + [(None, 1), (5, None)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in quality.rate_quality(documents([*rows, *EDGES]), ratings).collect()}
    right = [got[i]["grade"] == g for i, g in grades if i >= 300]
    assert sum(right) >= 0.95 * len(right) and all(got[i]["kept"] == (g > 0) for i, g in grades if i >= 300 and got[i]["grade"] == g)
    assert all(r["tails"] == sorted(r["tails"], reverse=True) and abs(r["expected_grade"] - sum(r["tails"])) < 1e-9 for r in got.values())
    assert quality.rate_quality(documents(rows), ratings.limit(0)).filter("kept and grade is null").count() == 400
