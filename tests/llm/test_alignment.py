"""Token alignment against a plain version, with hot groups, odd input and forced key clashes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessaline.llm import alignment

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def paths():
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute(rows, paths):
    """rows (id, text) -> {id: values}, straight from the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    of = alignment.byte_alphabet()
    spans, linked = {}, defaultdict(set)
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        bytes_a = [bytes(of[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            spans[doc] = None
            continue
        place = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        pa, pb = place(bytes_a), place(bytes_b)
        links = [(x, y) for x, (s, e) in zip(a, pa) for y, (t, u) in zip(b, pb) if s < u and t < e]
        ends = sorted({e for _, e in pa} & {e for _, e in pb})
        groups, last = [], 0
        for end in ends:
            inside = lambda ids, at: ",".join(str(i) for i, (s, e) in zip(ids, at) if last <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{inside(a, pa)}|{inside(b, pb)}")
            last = end
        spans[doc] = (len(a), len(b), groups, links)
        for pair in links:
            linked[pair].add(doc)
    best = Counter()
    for (x, _), docs in linked.items():
        best[x] = max(best[x], len(docs))
    out = {}
    for doc, got in spans.items():
        if got is None:
            out[doc] = (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = got
        counts = [len(linked[p]) for p in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out[doc] = (n_a, n_b, len(groups), len(links), sum(c == best[p[0]] for c, p in zip(counts, links)), sum(counts), sha)
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, "a", " ", "   two  spaces   ", "tab\tand\nline\r\n\n", "naïve façade 漢字 😀😀 Ω", "<|endoftext|> <s> </s> <unk> <0x41>", "word▁mark", "\u0000nul", "x" * 3000, "ﬁ ² Ⅷ", "don't can't we'll 12345 1.5e-7", "é ​ zero thin nbsp"]


def test_equals_brute_force(spark, prose, paths):
    texts = [prose(40 + i) for i in range(12)] + ODD + [prose(3)] * 5
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute(rows, paths)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_a string, key int").repartition(4)
    for options in ({}, {"most_sent": 3, "keep": 10, "slice_chars": 50}, {"most_sent": 1, "slice_chars": 1}):
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(docs, *paths, **options).collect()}
        assert got == want


def test_words_are_encoded_as_in_the_whole_text(paths):
    """No token reaches over a single space between two words, so the words' ids are the text's."""
    text = "".join(f"w{i % 97} it's,  two\n" + "漢字 " * (i % 3) + " \t x\u0085 y\u00a0 z " for i in range(300))
    spec, model = open(paths[0], encoding="utf-8").read(), open(paths[1], "rb").read()
    aligner = alignment.Aligner(spec, model, 0)
    words = alignment.words_of(text)
    assert len(words) > 300 and " ".join(words) == text and aligner.b.ends_at_space
    one, parts, single = aligner.encode([text])[0], aligner.encode(words, 7), aligner.encode(words, 1)
    assert one[4] and len(single) == len(words) > len(parts) > len(words) / 7
    for side in (2, 3):
        assert one[side].tolist() == [i for p in parts for i in p[side]] == [i for p in single for i in p[side]]


def test_clashing_keys_are_found_and_done_again(spark, prose, paths, monkeypatch):
    rows = [(i, prose(30)) for i in range(6)]
    real, seeds = alignment.Dictionary.keys, []

    class Clashing(alignment.Dictionary):
        def __init__(self, a, b, seed):
            super().__init__(a, b, seed)
            self.seed = seed

        def keys(self, ids, begins, which):
            k = real(self, ids, begins, which)
            return k % np.uint64(7) if self.seed == 0 and which == 0 else k

    monkeypatch.setattr(alignment, "Dictionary", Clashing)
    encoder = alignment.encoder
    monkeypatch.setattr(alignment, "encoder", lambda sent, seed, *more: seeds.append(seed) or encoder(sent, seed, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(docs, *paths).collect()}
    assert got == brute(rows, paths) and seeds == [0, 1]


def test_repeated_null_and_no_rows(spark, paths):
    shape = "doc_id long, text string"
    rows = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, None), (2, "other words")]
    got = alignment.align_tokens(spark.createDataFrame(rows, shape), *paths).collect()
    assert len(got) == 5
    same = [r for r in got if r["n_a"] and r["doc_id"] != 2]
    assert len(same) == 3 and len({tuple(r[c] for c in COLUMNS) for r in same}) == 1
    assert all(r["count_sum"] == 3 * r["n_links"] for r in same)
    assert alignment.align_tokens(spark.createDataFrame([], shape), *paths).collect() == []
    text_ids = spark.createDataFrame([("a", "same text")], "doc_id string, text string")
    assert alignment.align_tokens(text_ids, *paths).first()["doc_id"] == "a"
