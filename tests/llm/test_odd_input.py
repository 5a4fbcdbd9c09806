"""Every operator on odd input: null ids and texts, empty and very long texts, repeated rows, columns with clashing names, no rows at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.llm import audio_prints, decontaminate, language_id, licenses, mixing, near_dup, quality, sharding, token_counts, url_filters

CLASHING = "id key words places node n rep text_crc32 size score grade taken shard slot bin weight row chunk digest held candidates blocks root lead outside turn counts batch rank whole dealt".split()
LONG = " ".join(f"word{i % 5000}x{i % 13}" for i in range(120_000))
ROWS = [(1, "plain words that say little and end here", "en"), (1, "plain words that say little and end here", "en"), (2, LONG, "en"), (3, None, "en"), (4, "", None), (5, "été où ça déjà là très après", "fr"), (None, "words without any number at all", "en"), (None, None, None), (6, "  \n\t ", "fr")]


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in ROWS], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)


def test_licenses(odd):
    got = licenses.scan_licenses(odd).collect()
    assert ids(got) == ALL and {r["doc_id"]: r["n_words"] for r in got}[2] == 120_000 and all(r["n_base"] == 0 and r["labels"] == "" for r in got)


def test_leaks(spark, odd):
    long_item = " ".join(LONG.split()[100_000:100_050])
    bench = spark.createDataFrame([(7, "words without any number at all"), (8, long_item), (8, long_item), (None, "plain words that say little and end here")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, bench, fit_docs=50).collect()), key=str)
    # equal items and equal rows are reported one by one; ids may be null on either side
    assert got == sorted([(None, 7), (2, 8), (2, 8), (1, None), (1, None)], key=str)


def test_near_duplicates(odd):
    got = near_dup.near_duplicates(odd).collect()
    n = {(r["doc_id"], r["n_shingles"]) for r in got}
    assert ids(got) == ALL and {(3, 0), (4, 0), (6, 0), (1, 4), (None, 2), (None, 0)} <= n and all(r["kept"] for r in got)


def test_language(odd):
    training = odd.filter("doc_id in (1, 5)").select("doc_id", "lang", "text")
    got = language_id.identify_languages(odd.select("doc_id", "text", *CLASHING), training).collect()
    pred = {r["doc_id"]: r["lang_pred"] for r in got if r["text"]}
    assert ids(got) == ALL and (pred[1], pred[5], pred[None], pred[6]) == ("en", "fr", "en", "und") and got[0]["id"] == "clash id"
    assert all(r["lang_pred"] == "und" and not r["accepted"] for r in got if not (r["text"] or "").strip())


def test_sharding(odd):
    got = sharding.shard_documents(odd, shards=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert ids(got) == ALL and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and max(r["size"] for r in got) == len(LONG) + 16


def test_tokens(odd):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    got = token_counts.count_tokens(odd, token_counts.read_piece_model(path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert ids(got) == ALL and {r["doc_id"]: r["n_tokens"] for r in got}[2] == len(model.encode(LONG)) and [r["n_tokens"] for r in got if r["doc_id"] in (3, 4)] == [0, 0]


def test_mix(spark, odd):
    weights = spark.createDataFrame([(1, 2.0)], "doc_id long, weight double")
    got = mixing.mix_sources(odd, weights, carry=("key",)).collect()
    assert ids(got) == ALL and {r["key"] for r in got} == {"clash key"} and sum(r["taken"] for r in got) == sum(r["size"] for r in got) > 120_000


def test_mix_ties(spark):
    """A hundred equal rows under one id and a hundred without: as many are taken as the target asks for."""
    rows = [(1, "two words", "a")] * 100 + [(None, "two words", "b")] * 100
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source, target in ((1, 400 / 3), (None, 800 / 3)):
        mine = [r for r in got if r["doc_id"] == source]
        assert len(mine) == 100 and abs(sum(r["taken"] for r in mine) - target) <= 2 and mine[0]["target"] == pytest.approx(target)


def test_quality(spark, odd):
    ratings = spark.createDataFrame([(1, 2), (1, 2), (5, 0), (2, 1), (None, 1), (77, 1)], "doc_id long, grade int")
    got = quality.rate_quality(odd, ratings).collect()
    assert ids(got) == ALL and all(0 <= r["expected_grade"] <= 2 for r in got)
    assert len({r["expected_grade"] for r in got if r["doc_id"] in (3, 4, 6)}) == 1 and len({r["expected_grade"] for r in got if r["doc_id"] == 1}) == 1


def test_quality_gradient(rng):
    """The fitted weights are a stationary point: an independent numerical gradient of the likelihood by the thresholds is next to zero."""
    random = np.random.default_rng(1)
    features, grades = [], []
    for i in range(300):
        g = i % 3
        features.append((np.unique(np.r_[random.integers(0, 50, 8), 60 + g * (random.random() < 0.8)]), random.integers(1, 5, quality.SHAPES)))
        grades.append(g)
    model = quality.OrdinalModel.fit(features, grades, 3, rounds=800)
    count = np.bincount(grades)
    weight = np.sqrt(300 / (3 * count))[grades]
    weight /= weight.mean()

    def loss(theta):
        eta = np.array([model.words[w].sum() + np.sqrt(s / s.sum()) @ model.shapes for w, s in features])
        edge = np.c_[np.full(300, -np.inf), np.broadcast_to(theta, (300, 2)), np.full(300, np.inf)]
        y = np.array(grades)
        cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        return -(weight * np.log(cdf(edge[np.arange(300), y + 1] - eta) - cdf(edge[np.arange(300), y] - eta))).mean()

    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert abs((loss(model.thresholds + step) - loss(model.thresholds - step)) / 2e-5) < 0.02
    assert model.words[60] < model.words[61] < model.words[62]


@pytest.mark.parametrize("part", ["scheme", "host", "path", "none"])
def test_very_long_urls(spark, part):
    """Characters of one and two code units in turn, a million of them, wherever they stand."""
    long = "a\U0001f600" * 500_000
    url = {"scheme": f"{long}://Sub.Net/x?q", "host": f"http://{long}.net/x?q", "path": f"http://sub.net/{long}?q", "none": long}[part]
    got = url_filters.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), [("net", "/", "block")], ranges=2).first()
    host, path = {"scheme": ("sub.net", "/x"), "host": (f"{long}.net", "/x"), "path": ("sub.net", f"/{long}"), "none": ("", "")}[part]
    assert (got["host"], got["path"], got["rule"]) == (host, path, None if part == "none" else "net/")


def test_urls(spark):
    rows = [(1, "http://a.net/" + "x" * 50_000), (1, "http://a.net/" + "x" * 50_000), (None, "http://b.com/de/"), (2, None), (3, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("key", "salt", "range", "kind", "name", "verdict", "id", "h", "rule_host")})
    got = url_filters.filter_urls(pages, [("net", "/", "block"), ("net", "/", "block"), (None, "/", "block")], ranges=3).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got) == [("1", "block"), ("1", "block"), ("2", "allow"), ("3", "allow"), ("None", "allow")]


def test_audio(spark):
    prints = audio_prints.fingerprints(spark.createDataFrame([(1, bytearray(b"\x01" * 3)), (1, bytearray(b"\x01" * 3)), (None, bytearray(2_000_000)), (2, None), (3, bytearray(2_000_000))], "id long, pcm binary"), "id", "pcm", 4000)
    got = audio_prints.align(prints, "id", F.lit(True)).collect()
    # recordings of silence are one class, so they are no match of each other
    assert len(got) == 5 and all(r["n_matches"] == 0 for r in got) and [r["class_id"] for r in got if r["id"] is None] == [None]
    assert audio_prints.align(prints.limit(0), "id", F.lit(True)).count() == 0


def test_no_rows(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([(7, "words without any number at all")], "item_id long, text string")
    ratings = spark.createDataFrame([(1, 2)], "doc_id long, grade int")
    made = [
        licenses.scan_licenses(none), decontaminate.find_leaks(none, bench), near_dup.near_duplicates(none), language_id.identify_languages(none, none.select("doc_id", "lang", "text")),
        sharding.shard_documents(none), mixing.mix_sources(none), quality.rate_quality(none, ratings), token_counts.count_tokens(none, [("▁a", 0.0), ("a", -1.0), ("▁", -2.0)]),
    ]
    assert [df.count() for df in made] == [0] * len(made)
