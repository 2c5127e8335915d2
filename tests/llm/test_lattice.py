"""The two operators on the lattice of pieces, against plain dynamic programming and full enumeration."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import langid, lattice, nbest


@pytest.fixture(scope="module")
def loaded():
    return lattice.load(langid.MODEL)


@pytest.fixture(scope="module")
def voc(loaded):
    return lattice.vocabulary(loaded)


TEXTS = [
    "", " ", "a", "hello world", "  two  spaces ", "naïve café", "日本語 text", "▁literal mark", "tab\tnew\nline\r\n", "emoji 🙂🙂 x", "aaaaaaaaaaaaaaaa", "supercalifragilistic",
    "é", "\x00\x01", "İstanbul", "a" * 200, "<s></s><unk><0x41>", "The The the.", "é", "�",
]


def spellings(voc, data: bytes):
    """All segmentations of bytes: (score, ids); characters without a piece are spelled by bytes."""
    ways = [[] for _ in range(len(data) + 1)]
    ways[0] = [(0.0, [])]
    for i in range(len(data)):
        b = data[i]
        if b & 0xC0 == 0x80:
            edges = [(1, int(voc.byte_ids[b]))] if ways[i] else []
        else:
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            edges = [(k, voc.by_bytes[data[i : i + k]]) for k in range(1, min(voc.longest, len(data) - i) + 1) if data[i : i + k] in voc.by_bytes]
            if all(k != width for k, _ in edges):
                edges.append((1, int(voc.byte_ids[b])))
        for k, p in edges:
            ways[i + k] += [(s + float(voc.scores[p]), [*ids, p]) for s, ids in ways[i]]
    return ways[-1]


def test_nbest_equals_enumeration(spark, voc):
    rng = random.Random(1)
    short = [t for t in TEXTS if len(t) <= 12] + ["".join(rng.choice("ab e") for _ in range(rng.randrange(1, 10))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(short)], "doc_id long, text string, scores string")
    got = {r["doc_id"]: r for r in nbest.digested(df, n=4).collect()}
    full = {r["doc_id"]: r for r in nbest.encoded(df, n=4).collect()}
    for i, t in enumerate(short):
        ways = sorted(spellings(voc, b" " + t.encode()), key=lambda w: -w[0])
        best = [w[0] for w in ways[:4]]
        assert np.allclose(got[i]["scores"], best, rtol=0, atol=1e-6), t
        crc = {zlib.crc32(np.array(ids, "<i4").tobytes()): s for s, ids in ways}
        digests = got[i]["digests"]
        assert len(set(digests)) == len(digests) == len(best) and np.allclose([crc[d] for d in digests], best)
        assert got[i]["n_pieces"] == len(full[i]["ids"]) and zlib.crc32(np.array(full[i]["ids"], "<i4").tobytes()) == digests[0]


def test_round_trip(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([32, 65, 97, 0xE9, 0x4E2D, 0x1F600, 0x2581, 10])) for _ in range(500)) for _ in range(20)] + ["word " * 20_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = nbest.encoded(df)
    rows = enc.collect()
    assert all(r["round_trip"] is (None if texts[r["doc_id"]] is None else True) for r in rows) and len(rows) == len(texts)
    assert {r["doc_id"]: r["text"] for r in nbest.decode(enc).collect()} == dict(enumerate(texts))


def test_the_best_beats_the_models_own_encoding(spark, voc):
    """Segmentations by merges are among those that the lattice holds, so none can score more."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=langid.MODEL)
    texts = ["hello world", "The quick brown fox jumps", "naïve café"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in nbest.encoded(df, n=1).collect():
        own = sum(voc.scores[i] for i in sp.encode(texts[r["doc_id"]]))
        assert r["scores"][0] >= own - 1e-6


def test_search_is_a_star_in_order(voc):
    ways = nbest.Ways(voc)
    losses = [loss for loss, _ in nbest.search(ways, [b" hello", b" world"], 50)]
    assert losses == sorted(losses) and losses[0] == 0 and len(losses) == 50


def test_nothing_to_encode(spark):
    assert nbest.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- languages


def test_forward_sums_all_segmentations(voc):
    rng = np.random.default_rng(1)
    prob = rng.random((len(voc.scores), 2))
    for word in (b" hello", b" caf\xc3\xa9", b" \xf0\x9f\x99\x82x", b" " + b"ab" * 40):
        data = np.frombuffer(word, np.uint8)
        (_, lat, log), = lattice.grouped(voc, data, np.array([0, len(word)]))
        w = np.log(prob[lat.id]) if log else prob[lat.id]
        end = lat.sums(w, log)[lat.last][0]
        got = np.exp(end) if log else end
        total = [np.ones(2)] + [np.zeros(2) for _ in word]  # the same sums place by place
        for i in range(len(word)):
            b = word[i]
            if b & 0xC0 == 0x80:
                edges = [(1, voc.byte_ids[b])] if total[i].any() else []
            else:
                width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                edges = [(k, voc.by_bytes[word[i : i + k]]) for k in range(1, len(word) - i + 1) if word[i : i + k] in voc.by_bytes]
                if all(k != width for k, _ in edges):
                    edges.append((1, voc.byte_ids[b]))
            for k, p in edges:
                total[i + k] = total[i + k] + total[i] * prob[p]
        assert np.allclose(got, total[-1], rtol=1e-9)
        if len(word) < 12:
            every = [math.prod(prob[p, 0] for p in ids) for _, ids in spellings(voc, word)]
            assert math.isclose(got[0], sum(every), rel_tol=1e-9)


SAY = {"xx": "ka ki ku kakaka kiku", "yy": "mo me ma memo mama", "zz": "слово дело тело"}


def corpus(n=90):
    rng = random.Random(5)
    return [(i, " ".join(rng.choices(SAY[lang].split(), k=30)), lang, "s", 0.5, "l") for i, lang in zip(range(n), itertools.cycle(SAY))]


SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def test_held_out_documents_are_found(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = langid.identified(df).collect()
    out = [r["doc_id"] for r in rows if r["held_out"]]
    assert sorted(out) == [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 == 1]
    langs = list(itertools.islice(itertools.cycle(SAY), 90))
    assert all(r["lang_pred"] == langs[r["doc_id"]] and 0.5 < r["score"] <= 1 for r in rows)


def test_labels_of_held_out_documents_teach_nothing(spark):
    base = corpus()
    wrong = [(i, t, "other" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, *rest) for i, t, lang, *rest in base]
    key = lambda rows: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in rows)
    assert key(langid.identified(spark.createDataFrame(base, SCHEMA)).collect()) == key(langid.identified(spark.createDataFrame(wrong, SCHEMA)).collect())


def test_odd_texts(spark):
    odd = [(100, None), (101, ""), (102, "123 !? \n"), (103, "ka " * 100_000), (None, "mo me"), (104, "🙂"), (104, "🙂"), (105, "k")]
    df = spark.createDataFrame(corpus() + [(i, t, None, None, None, None) for i, t in odd], SCHEMA)
    got = [r for r in langid.identified(df).collect() if r["doc_id"] is None or r["doc_id"] >= 100]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[100] == by[101] == by[102] == by[104] == ("und", 0.0) and by[103][0] == by[105][0] == "xx" and by[None][0] == "yy" and len(got) == len(odd)
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identified(df).collect()] == [("und", 0.0)] * 2
    assert langid.identified(df.limit(0)).count() == 0


def test_screened_keeps_columns_and_drops_wordless_texts(spark):
    df = spark.createDataFrame([*corpus(), (200, None, "xx", "s", 0.1, "l"), (201, "... 5", None, None, None, None), (None, "ka ki", None, None, None, None)], SCHEMA)
    out = langid.screened(df)
    assert out.columns == df.columns
    assert sorted(out.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0]) == [-1, *range(90)]
    assert out.where("doc_id = 3").first() == df.where("doc_id = 3").first()


def test_units_and_words_of_colliding_polynomials(spark, voc):
    """Thue-Morse words and their complements share a polynomial hash modulo 2**64."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    texts = ["".join(p[b] for b in bits[:n]) for n in (1024, 2048, 4096) for p in ("ab", "ba")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    enc = nbest.encoded(df)
    assert all(r["round_trip"] for r in enc.collect())
    assert {r["doc_id"]: r["text"] for r in nbest.decode(enc).collect()} == dict(enumerate(texts))
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    assert len(langid.units_of(data, np.array([0, len(data)]))[1]) == len(texts) + 1
