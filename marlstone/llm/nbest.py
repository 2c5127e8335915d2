"""SentencePiece encoding and decoding with the N best segmentations of whole texts.

A text is read as the model does without normalisation: one word mark before it, spaces as marks. The
lattice of pieces splits at places that no piece crosses, so a forward Viterbi pass over each distinct unit
gives the exact best score of every prefix. For an edge, the loss is what the best way to its end beats the
way through it by; a backward A-star search whose heuristic is the forward score pops partial paths in the
order of their summed losses, and the first N that reach the start are the N best segmentations.

The N best of a text can only leave the best path inside the N - 1 units (occurrences) whose second-best
segmentation loses least, since each of those alone gives a rival that loses no more; the search runs over
exactly these units, and all others keep their best. Forward and backward scores of a unit's edges give its
second best. Scores of pieces are whole numbers, so sums are exact.

Defined results: a null text has no segmentation (null ids, no scores, round trip null); an empty text has
the word mark alone; equal scores come in the order in which the search meets them, which is a function of
the text alone. The model in use was trained for merges, so its scores are ranks of merges: segmentations and
ids here are the best by summed scores, not those of the model's own encoder, and the two can't be
interchanged, though both decode to the text. Characters outside the vocabulary are spelled in byte pieces, and a literal word mark too,
so every text decodes to itself.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import MODEL
from .lattice import Vocabulary, gather, grouped, load, vocabulary
from .shared import distinct_segments, small_batches, text_slices

NBEST = 4


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 0x20, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[at] = data
    return out, offsets + np.arange(n + 1)


def unit_starts(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: at a run of spaces, at a text, and around characters that join no piece."""
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    alone = voc.alone[data]
    begins |= alone
    begins[1:] |= alone[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class Units:
    """The distinct units of a slice: best ids, best score, and how much the second best loses."""

    def __init__(self, voc: Vocabulary, flat: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        self.score, self.loss = np.zeros(n), np.full(n, np.inf)
        count = np.zeros(n, np.int64)
        found = []
        for pick, lat, _ in grouped(voc, flat, at):
            score = voc.scores[lat.id]
            value, by = lat.best(score)
            back = lat.best_back(score)
            top = value[lat.last]
            self.score[pick] = top
            best = np.zeros(len(score), bool)
            place, live, steps = lat.last.copy(), np.arange(len(pick)), []
            while len(live):
                edge = by[place[live]]
                best[edge] = True
                steps.append((pick[live], lat.id[edge]))
                place[live] = lat.src[edge]
                live = live[place[live] > lat.first[live]]
            through = value[lat.src] + score + back[lat.dst]
            through[best] = -np.inf
            second = np.full(len(pick), -np.inf)
            np.maximum.at(second, lat.unit, through)
            self.loss[pick] = top - second
            for u, _ in steps:
                count[u] += 1
            found.append(steps)
        self.at = np.concatenate(([0], np.cumsum(count)))
        self.ids = np.zeros(self.at[-1], np.int32)
        left = self.at[1:].copy()
        for steps in found:  # from the end of each unit to its start
            for u, ids in steps:
                left[u] -= 1
                self.ids[left[u]] = ids


class Ways:
    """For units met one at a time: each place's best score, and the edges to it with what they lose."""

    MOST = 8192

    def __init__(self, voc: Vocabulary):
        self.voc, self.known = voc, {}

    def of(self, unit: bytes) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
        if unit not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[unit] = self._made(unit)
        return self.known[unit]

    def _made(self, unit: bytes):
        pieces, scores, n = self.voc.by_bytes, self.voc.scores, len(unit)
        value, to = [-np.inf] * (n + 1), [[] for _ in range(n + 1)]
        value[0] = 0.0
        for i in range(n):
            b = unit[i]
            if b & 0xC0 == 0x80:
                if value[i] == -np.inf:
                    continue
                edges = [(1, int(self.voc.byte_ids[b]))]  # inside a spelled character
            else:
                width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                edges = [(k, p) for k in range(1, min(self.voc.longest, n - i) + 1) if (p := pieces.get(unit[i : i + k])) is not None]
                if all(k != width for k, _ in edges):
                    edges.append((1, int(self.voc.byte_ids[b])))
            for k, p in edges:
                v = value[i] + float(scores[p])
                to[i + k].append((v, i, p))
                value[i + k] = max(value[i + k], v)
        return value, [sorted((value[d] - v, i, p) for v, i, p in ways) for d, ways in enumerate(to)]


def search(ways_of: Ways, units: list[bytes], n: int) -> list[tuple[float, list[list[int]]]]:
    """The n best segmentations of a few units read one after another: losses and ids for each unit."""
    edges_to: list[list[tuple[float, int, int]]] = [[]]
    unit_of, bases = [0], [0]
    for k, u in enumerate(units):
        _, to = ways_of.of(u)
        bases.append(bases[-1] + len(u))
        edges_to += to[1:]
        unit_of += [k] * len(u)
    # An agenda of partial paths from the end: loss so far (score lost against the best), order, place, path.
    agenda, order, out = [(0.0, 0, bases[-1], None)], 1, []
    while agenda and len(out) < n:
        loss, _, place, path = heapq.heappop(agenda)
        if place == 0:
            ids: list[list[int]] = [[] for _ in units]
            while path:
                k, i, path = path
                ids[k].append(i)
            out.append((loss, ids))
            continue
        k = unit_of[place]
        for more, src, i in edges_to[place]:
            heapq.heappush(agenda, (loss + more, order, bases[k] + src, (k, i, path)))
            order += 1
    return out


def decoded(voc: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that pieces spell, marks as spaces; a text's first mark is still there."""
    size = np.diff(voc.spelled_at)[ids]
    return gather(voc.spelled, voc.spelled_at[:-1][ids], size)[0]


def segmented(voc: Vocabulary, ways_of: Ways, data: np.ndarray, offsets: np.ndarray, n: int):
    """For each text of a slice: best ids, scores of the n best, ids of the others, and whether the best
    decodes to the text."""
    data, offsets = marked(data, offsets)
    starts = unit_starts(voc, data, offsets)
    ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
    first, inverse = distinct_segments(data, starts, ends)
    flat, at = gather(data, starts[first], (ends - starts)[first])
    units = Units(voc, flat, at)
    size = np.diff(units.at)
    ids, id_at = gather(units.ids, units.at[:-1][inverse], size[inverse])
    bounds = np.searchsorted(starts, offsets)
    back = decoded(voc, ids)
    exact = len(back) == len(data) and np.array_equal(back, data)
    raw, memo = flat.tobytes(), {}
    losses, total = units.loss[inverse], units.score[inverse]
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        best = ids[id_at[a] : id_at[b]]
        ok = exact or np.array_equal(decoded(voc, best), data[offsets[i] : offsets[i + 1]])
        loss = losses[a:b]
        if b - a > n - 1:
            limit = np.partition(loss, n - 2)[n - 2] if n > 1 else -1
            low, same = np.flatnonzero(loss < limit), np.flatnonzero(loss == limit)
            use = np.sort(np.concatenate((low, same[: n - 1 - len(low)])))
        else:
            use = np.arange(b - a)
        use = use[loss[use] < np.inf]
        key = tuple(inverse[a + use].tolist())
        if key not in memo:
            memo[key] = search(ways_of, [raw[at[u] : at[u + 1]] for u in key], n)
        top = float(total[a:b].sum())
        scores, others = [], []
        for lost, ways in memo[key]:
            scores.append(top - lost)
            others.append([(int(id_at[a + u] - id_at[a]), int(id_at[a + u + 1] - id_at[a]), w) for u, w in zip(use.tolist(), ways, strict=True)])
        yield best, scores, others, bool(ok)


def assembled(best: np.ndarray, changes: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """A segmentation: the best ids, with some units' ids replaced."""
    out, at = [], 0
    for lo, hi, ids in changes:
        out += [best[at:lo], np.array(ids, np.int32)]
        at = hi
    return np.concatenate([*out, best[at:]])


def _encode(loaded: tuple, n: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(loaded)
        ways_of = Ways(voc)
        for batch in batches:
            known = batch.column("text").is_valid().to_pylist()
            at = 0
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                rows = {"pieces": [], "scores": [], "digests": [], "round_trip": [], "ids": []}
                for best, scores, others, ok in segmented(voc, ways_of, data, offsets, n):
                    if not known[at]:
                        for v in rows.values():
                            v.append(None)
                    else:
                        rows["pieces"].append(len(best))
                        rows["scores"].append(scores)
                        rows["round_trip"].append(ok)
                        ways = [assembled(best, x) for x in others]
                        rows["digests"].append([zlib.crc32(w.astype("<i4").tobytes()) for w in ways] if not full else None)
                        rows["ids"].append(ways[0] if full else None)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(rows["pieces"], pa.int64()),
                        pa.array(rows["scores"], pa.list_(pa.float64())),
                        pa.array(rows["ids"] if full else rows["digests"], pa.list_(pa.int32() if full else pa.int64())),
                        pa.array(rows["round_trip"], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "scores", "ids" if full else "digests", "round_trip"],
                )

    return run


def encoded(docs: DataFrame, n: int = NBEST, model: str = MODEL) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_pieces, the n best scores, the best ids, and
    whether they decode to the text."""
    return _run(docs, n, model, True, "ids array<int>")


def digested(docs: DataFrame, n: int = NBEST, model: str = MODEL) -> DataFrame:
    """As ``encoded``, with a CRC-32 of each segmentation's ids (32-bit little-endian) instead of ids."""
    return _run(docs, n, model, False, "digests array<long>")


def _run(docs: DataFrame, n: int, model: str, full: bool, column: str) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encode(load(model), n, full), f"doc_id {kind}, n_pieces long, scores array<double>, {column}, round_trip boolean"
    )


def _decode(loaded: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(loaded)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                whole = None if not ids.is_valid else decoded(voc, np.array(ids.as_py(), np.int64)).tobytes()
                texts.append(None if whole is None else whole[whole[:1] == b" " :].decode("utf-8", "replace"))
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([v for _, v in rest] + [pa.array(texts, pa.string())], names=[c for c, _ in rest] + ["text"])

    return run


def decode(frame: DataFrame, model: str = MODEL) -> DataFrame:
    """Texts of ``frame(doc_id, ids)``; null ids give a null text."""
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.select("doc_id", "ids").mapInArrow(_decode(load(model)), f"doc_id {kind}, text string")
