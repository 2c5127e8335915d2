"""Language identification by unigram piece models whose segmentation is marginalised.

A language is a distribution over the pieces of a fixed published vocabulary. A text's probability is the
product over its words, and a word's is the sum over all its segmentations into pieces, found by the forward
algorithm. The distributions are fitted by expectation-maximisation over segmentations on a bounded sample
of labelled documents (about ``SAMPLE`` of each language, whole texts): the executors compute expected
counts over the sample's distinct words, and the driver gets one number for each piece and language.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could be
learned; the score is the posterior of the language under equal priors; ties go to the smaller name; rows
are scored alone, so repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import gather, grouped, load, vocabulary
from .shared import distinct_segments, dropped, small_batches, text_slices, words_at, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE, ROUNDS = 1500, 3
#: A probability of a byte is about 1 / BYTE; pieces are weighed by BYTE ** length to keep sums near 1.
BYTE = 12.0


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with a space before them as flat bytes and offsets; each word's index; counts."""
    starts, ends, counts = words_at(data, offsets)
    first, inverse = distinct_segments(data, starts, ends)
    flat, at = gather(data, starts[first] - 1, ends[first] - starts[first] + 1)
    flat = flat.copy()
    flat[at[:-1]] = 0x20
    return flat, at, inverse, counts


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def _counted(langs: list[str]):
    """Words of labelled texts with their counts, pre-aggregated for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in text_slices(_lowered(batch.column("text"))):
                flat, at, inverse, counts = units_of(data, offsets)
                if not len(inverse):
                    continue
                label = np.repeat([langs.index(x) for x in labels[lo:hi]], counts)
                pairs, n = np.unique(inverse.astype(np.int64) * len(langs) + label, return_counts=True)
                raw = flat.tobytes()
                word = pairs // len(langs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pairs % len(langs)).astype(np.int32)), pa.array([raw[at[w] : at[w + 1]] for w in word.tolist()], pa.binary()), pa.array(n.astype(np.int64))],
                    names=["k", "word", "n"],
                )

    return run


def _expected(loaded: tuple, prob: np.ndarray):
    """The E step: expected uses of each piece under each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(loaded)
        size = np.diff(voc.spelled_at)
        k = prob.shape[1]
        total = np.zeros(prob.shape)
        scaled = prob * (BYTE**size)[:, None]
        for batch in batches:
            words = batch.column("word").to_pylist()
            n = np.array(batch.column("n").to_pylist(), np.float64).reshape(-1, k)
            flat = np.frombuffer(b"".join(words), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(w) for w in words])))
            for pick, lat, log in grouped(voc, flat, offsets):
                w = np.log(scaled[lat.id]) if log else scaled[lat.id]
                fwd, bwd = lat.sums(w, log), lat.sums(w, log, back=True)
                z = fwd[lat.last][lat.unit]
                use = np.exp(fwd[lat.src] + w + bwd[lat.dst] - z) if log else fwd[lat.src] * w * bwd[lat.dst] / z
                use *= n[pick][lat.unit]
                for i in range(k):
                    total[:, i] += np.bincount(lat.id, use[:, i], minlength=len(total))
        used = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["piece", "uses"])

    return run


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Counts to probabilities: each language leans a little on all languages together and on equality."""
    v = len(counts)
    overall = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * v)
    lean = 1e-3 * counts.sum(axis=0) + 1
    return (counts + lean * (0.9 * overall + 0.1 / v)[:, None]) / (counts.sum(axis=0) + lean)


def fitted(docs: DataFrame, model: str = MODEL, sample: int = SAMPLE) -> tuple[list[str], tuple, np.ndarray]:
    """Languages, vocabulary and piece probabilities, from ``docs(doc_id, text, lang)``."""
    spark = docs.sparkSession
    loaded = load(model)
    docs = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: x.encode())
    if not langs:
        return [], loaded, np.zeros((len(loaded[0]), 0))
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))])
    chosen = docs.where(part < share[F.col("lang")]).select("text", "lang")
    k = len(langs)
    counted = chosen.mapInArrow(_counted(langs), "k int, word binary, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
    row = F.array(*[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)) for i in range(k)])
    words = written(counted.groupBy("word").agg(row.alias("n")), "words").select("word", F.col("n").cast("array<double>").alias("n"))
    prob = np.full((len(loaded[0]), k), 1.0 / len(loaded[0]))
    for _ in range(ROUNDS):
        rows = (
            words.mapInArrow(_expected(loaded, prob), "piece int, uses array<double>")
            .groupBy("piece")
            .agg(F.array(*[F.sum(F.col("uses")[i]) for i in range(k)]).alias("uses"))
            .collect()
        )
        counts = np.zeros_like(prob)
        for r in rows:
            counts[r["piece"]] = r["uses"]
        prob = _smoothed(counts)
    dropped(words)
    return langs, loaded, prob


def _scored(langs: list[str], loaded: tuple, prob: np.ndarray, keep: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(loaded)
        size = np.diff(voc.spelled_at)
        scaled = prob * (BYTE**size)[:, None]
        k = len(langs)
        for batch in batches:
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            preds, scores = [], []
            for lo, hi, data, offsets in text_slices(_lowered(texts)):
                flat, at, inverse, counts = units_of(data, offsets)
                loglik = np.zeros((len(at) - 1, k))
                for pick, lat, log in grouped(voc, flat, at):
                    w = np.log(scaled[lat.id]) if log else scaled[lat.id]
                    end = lat.sums(w, log)[lat.last]
                    loglik[pick] = end if log else np.log(np.maximum(end, 1e-300))
                total = np.zeros((hi - lo, k))
                some = counts > 0
                if some.any():
                    first = np.concatenate(([0], np.cumsum(counts)))[:-1][some]
                    total[some] = np.add.reduceat(loglik[inverse], first, axis=0)
                total -= total.max(axis=1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(axis=1, keepdims=True)
                pick = p.argmax(axis=1)
                ok = letters[lo:hi]
                preds += [langs[i] if o else "und" for i, o in zip(pick.tolist(), ok, strict=True)]
                scores.append(np.where(ok, p.max(axis=1), 0.0))
            names = [c for c in batch.schema.names if keep or c != "text"]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(preds, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"]
            )

    return run


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, model: str = MODEL, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score. Held-out rows
    teach nothing; only the text is read to predict."""
    langs, loaded, prob = fitted(docs.select("doc_id", "text", "lang").where(~held_out()).where("doc_id is not null"), model, sample)
    small_batches(docs.sparkSession)
    if not langs:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        _scored(langs, loaded, prob), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def screened(docs: DataFrame, least: float = 0.5, model: str = MODEL, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` whose language is found with a posterior of ``least``
    or more. The columns stay; rows pass through the model once and are not joined back."""
    langs, loaded, prob = fitted(docs.select("doc_id", "text", "lang").where(~held_out()).where("doc_id is not null"), model, sample)
    if not langs:
        return docs
    small_batches(docs.sparkSession)
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", lang_pred string, score double"
    found = plain.mapInArrow(_scored(langs, loaded, prob, keep=True), schema)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
