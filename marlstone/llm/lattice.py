"""The lattice of vocabulary pieces over units of text, for many units at once.

A unit is a run of bytes that no piece crosses (a word with the space before it). All units of a batch lie
in one flat byte array; a trie walks from every byte at once, and sweeps over a unit's offsets then do
forward and backward passes for all units together. Pieces are byte strings in which a space stands for the
vocabulary's word mark. A character without a piece of its own is spelled by byte pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MARK = "▁"
#: Units longer than this are swept apart from the others; a lattice holds units of about so many bytes (a
#: longer unit alone), which bounds its edges and their weights.
LONG, BYTES = 44, 1 << 16


class Vocabulary:
    """Pieces of a published model: bytes, scores, byte pieces, and a trie as one table."""

    def __init__(self, pieces: list[bytes | None], scores: list[float], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int32)
        self.scores = np.array(scores, np.float64)
        kids: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for i, p in enumerate(pieces):
            if p:
                at = 0
                for b in p:
                    nxt = kids[at].get(b)
                    if nxt is None:
                        nxt = kids[at][b] = len(kids)
                        kids.append({})
                        ends.append(-1)
                    at = nxt
                ends[at] = i
        inner = [i for i, k in enumerate(kids) if k]
        outer = [i for i, k in enumerate(kids) if not k]
        place = np.empty(len(kids), np.int32)
        place[inner] = np.arange(len(inner))
        place[outer] = np.arange(len(inner), len(kids))
        self.inner = len(inner)
        self.next = np.full((len(inner), 256), -1, np.int32)
        self.ends = np.empty(len(kids), np.int32)
        for i, k in enumerate(kids):
            self.ends[place[i]] = ends[i]
            for b, j in k.items():
                self.next[place[i], b] = place[j]
        self.longest = max(len(p) for p in pieces if p)
        joined = np.zeros(256, bool)
        for p in pieces:
            if p and len(p) > 1:
                joined[list(p)] = True
        #: Control characters that stand in no longer piece: a unit can end on either side of them.
        self.alone = np.zeros(256, bool)
        self.alone[:32] = ~joined[:32]
        self.by_bytes = {p: i for i, p in enumerate(pieces) if p}
        spelled = [p if p else b"" for p in pieces]
        for b, i in enumerate(byte_ids):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(p) for p in spelled])))


def load(path: str) -> tuple[list[bytes | None], list[float], list[int]]:
    """Pieces, scores and byte pieces of a SentencePiece model file, for ``vocabulary``. A byte piece
    costs 10 more than the dearest ordinary piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids = [], [], [0] * 256
    for i in range(sp.get_piece_size()):
        p, plain = sp.id_to_piece(i), not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        pieces.append(p.replace(MARK, " ").encode() if plain else None)
        scores.append(sp.get_score(i))
    worst = min(s for s, p in zip(scores, pieces, strict=True) if p and s > -1e8) - 10
    for i in byte_ids:
        scores[i] = worst
    return pieces, scores, byte_ids


@lru_cache(maxsize=2)
def _built(key: tuple) -> Vocabulary:
    pieces, scores, byte_ids = key
    return Vocabulary(list(pieces), list(scores), list(byte_ids))


def vocabulary(loaded: tuple) -> Vocabulary:
    """The vocabulary, built once in each Python process."""
    return _built(tuple(map(tuple, loaded)))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ragged segments one after another, and their offsets."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[at], offsets


class Lattice:
    """Edges of all units of a batch. Boundary b of a unit that starts at byte s is place s + unit + b."""

    def __init__(self, voc: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        n, self.units = len(data), len(offsets) - 1
        offsets = offsets.astype(np.int32)  # a batch is far below 2**31 bytes
        unit = np.repeat(np.arange(self.units, dtype=np.int32), np.diff(offsets))
        stop = np.repeat(offsets[1:], np.diff(offsets))
        at, state = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        froms, lens, ids = [], [], []
        covered = np.zeros(n, bool)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for k in range(1, voc.longest + 1):
            ok = at + k <= stop[at]
            at, state = at[ok], state[ok]
            state = voc.next[state, data[at + k - 1]]
            ok = state >= 0
            at, state = at[ok], state[ok]
            end = voc.ends[state]
            hit = end >= 0
            froms.append(at[hit])
            lens.append(np.full(hit.sum(), k, np.int32))
            ids.append(end[hit])
            covered[at[hit]] |= width[at[hit]] == k
            ok = state < voc.inner
            at, state = at[ok], state[ok]
            if not len(at):
                break
        bare = np.flatnonzero(((data & 0xC0) != 0x80) & ~covered)
        if len(bare):
            w = np.minimum(width[bare], stop[bare] - bare)
            at, _ = gather(np.arange(n, dtype=np.int32), bare, w)
            froms.append(at)
            lens.append(np.ones(len(at), np.int32))
            ids.append(voc.byte_ids[data[at]])
        f, k, self.id = np.concatenate(froms), np.concatenate(lens), np.concatenate(ids)
        u = unit[f]
        self.unit, self.src, self.dst, self.len = u, f + u, f + u + k, k
        self.offset = f - offsets[u]
        self.first = offsets[:-1] + np.arange(self.units, dtype=np.int32)
        self.last = offsets[1:] + np.arange(self.units, dtype=np.int32)
        self.places = n + self.units
        order = np.argsort(self.offset, kind="stable")
        for name in ("unit", "src", "dst", "len", "id", "offset"):
            setattr(self, name, getattr(self, name)[order])
        self.starts = np.searchsorted(self.offset, np.arange(int(self.offset.max(initial=-1)) + 2))
        ends = self.offset + self.len
        self.by_end = np.argsort(ends, kind="stable")
        self.stops = np.searchsorted(ends[self.by_end], np.arange(1, int(ends.max(initial=0)) + 2))

    def forward_slices(self):
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            yield slice(a, b)

    def backward_slices(self):
        for a, b in zip(self.stops[-2::-1], self.stops[:0:-1], strict=True):
            yield self.by_end[a:b]

    # Within a slice no two edges share the place that they write to.

    def sums(self, weight: np.ndarray, log: bool, back: bool = False) -> np.ndarray:
        """Sums over all segmentations up to each place (from each place, if back); weight: (edges, k)."""
        k = weight.shape[1]
        out = np.full((self.places, k), -np.inf) if log else np.zeros((self.places, k))
        out[self.last if back else self.first] = 0.0 if log else 1.0
        slices = self.backward_slices() if back else self.forward_slices()
        src, dst = (self.dst, self.src) if back else (self.src, self.dst)
        for s in slices:
            to = dst[s]
            if log:
                out[to] = np.logaddexp(out[to], out[src[s]] + weight[s])
            else:
                out[to] += out[src[s]] * weight[s]
        return out

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best score up to each place and the edge that it comes by (ties: the longer last piece)."""
        value, by = np.full(self.places, -np.inf), np.full(self.places, -1, np.int64)
        value[self.first] = 0
        index = np.arange(len(score))
        for s in self.forward_slices():
            to, new = self.dst[s], value[self.src[s]] + score[s]
            up = new > value[to]
            value[to[up]], by[to[up]] = new[up], index[s][up]
        return value, by

    def best_back(self, score: np.ndarray) -> np.ndarray:
        value = np.full(self.places, -np.inf)
        value[self.last] = 0
        for s in self.backward_slices():
            to = self.src[s]
            value[to] = np.maximum(value[to], value[self.dst[s]] + score[s])
        return value


def grouped(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray):
    """``(indexes of units, their lattice, whether they are long)``: short units together, long ones together."""
    size = np.diff(offsets)
    for long_, units in ((False, np.flatnonzero(size <= LONG)), (True, np.flatnonzero(size > LONG))):
        upto = np.cumsum(size[units])
        cuts = np.searchsorted(upto, np.arange(BYTES, int(upto[-1]) if len(units) else 0, BYTES))
        for pick in np.split(units, np.unique(cuts)):
            if len(pick):
                sub, at = gather(data, offsets[:-1][pick], size[pick])
                yield pick, Lattice(voc, sub, at), long_
