"""Sampled segmentations of descriptions into SentencePiece pieces: Gumbel top-k without replacement over the lattice.

The lattice of a text is cut wherever no piece of the vocabulary can cross; equal stretches of a batch share one lattice. A path's
weight is the product of its pieces' weights, and backward sums make each choice's probability known. The search keeps, per
text, sets of paths with perturbed scores (the largest Gumbel-perturbed log-probability within the set): the best set gives its
best path, and what is left of it is split by the stretch at which other paths part from that one. Perturbed scores of the
parts are drawn below that of the path, so paths come out in falling order, as a best-first search with exact bounds: all
distinct, and distributed as draws without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_WIDE = np.uint64(21)
_NEAR = 1024
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Vocabulary:
    """A SentencePiece model as arrays: the trie of its pieces, their weights, and the character pairs that pieces hold.

    Weights of a unigram model are its log-probabilities. A model of merges has ranks instead; a piece of rank r weighs
    -log(1 + r), as frequencies fall with ranks. A character without a piece is its bytes.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = {}
        nodes: dict[tuple[int, str], int] = {}
        ends, pairs, weight, merges = {}, set(), [], False
        for i in range(self.model.get_piece_size()):
            piece, score = self.model.id_to_piece(i), self.model.get_score(i)
            weight.append(score)
            if self.model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i):
                continue
            merges |= score < -500
            at = 0
            for c in piece:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends[at] = i
            pairs.update(zip(piece, piece[1:]))
        #: What pieces spell, and how much of it a first piece drops: the space before a text; -1 for bytes and control pieces.
        spelled = [b"" if self.model.is_control(i) else self.model.id_to_piece(i).replace("\u2581", " ").encode() for i in range(len(weight))]
        for value, i in self.byte.items():
            spelled[i] = bytes([value])
        self.spelled, self.spelled_size = pa.array(spelled, pa.large_binary()), np.array([len(x) for x in spelled], dtype=np.int64)
        self.spelled_start = np.array([x.startswith(b" ") for x in spelled], dtype=np.int64) * (self.model.decode(self.model.encode(" ")) == " ")
        self.spelled_start[[i for i in range(len(weight)) if self.model.is_byte(i) or self.model.is_control(i)]] = -1
        self.weight = np.array(weight)
        if merges:
            self.weight = -np.log1p(-self.weight)
        keys = np.array([n << 21 | ord(c) for n, c in nodes], dtype=np.uint64)
        #: Open addressing: a key lies at its hashed place or soon after; free places hold the largest number.
        self.mask = np.uint64((1 << (4 * len(keys) - 1).bit_length()) - 1)
        self.keys, self.to = np.full(int(self.mask) + 1, _FREE, dtype=np.uint64), np.full(int(self.mask) + 1, -1, dtype=np.int32)
        todo, place = np.arange(len(keys)), self.place(keys)
        values = np.array(list(nodes.values()), dtype=np.int32)
        while len(todo):
            at, first = np.unique(place[todo], return_index=True)
            first = first[self.keys[at] == _FREE]
            won = todo[first]
            self.keys[place[won]], self.to[place[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            place[todo] = place[todo] + np.uint64(1) & self.mask
        self.end = np.full(len(nodes) + 1, -1, dtype=np.int32)
        self.end[list(ends)] = list(ends.values())
        #: The trie's first two steps for frequent characters, as tables; -1 where there is no way on.
        self.one, self.two = np.full(_NEAR, -1, dtype=np.int32), np.full((_NEAR, _NEAR), -1, dtype=np.int32)
        above = {to: c for (n, c), to in nodes.items() if n == 0 and ord(c) < _NEAR}
        for (n, c), to in nodes.items():
            if n == 0 and ord(c) < _NEAR:
                self.one[ord(c)] = to
            elif n in above and ord(c) < _NEAR:
                self.two[ord(above[n]), ord(c)] = to
        self.near = np.zeros((_NEAR, _NEAR), dtype=bool)
        self.far = np.array(sorted(ord(a) << 21 | ord(b) for a, b in pairs), dtype=np.uint64)
        for a, b in pairs:
            if ord(a) < _NEAR and ord(b) < _NEAR:
                self.near[ord(a), ord(b)] = True

    def joined(self, points: np.ndarray) -> np.ndarray:
        """Whether a piece may hold the character and its following one."""
        a, b = points[:-1], points[1:]
        out = self.near[np.minimum(a, _NEAR - 1), np.minimum(b, _NEAR - 1)]
        wide = np.flatnonzero((a >= _NEAR) | (b >= _NEAR))
        key = a[wide].astype(np.uint64) << _WIDE | b[wide]
        at = np.minimum(np.searchsorted(self.far, key), len(self.far) - 1)
        out[wide] = self.far[at] == key
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & self.mask

    def step(self, state: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The trie's next states, -1 where there is no way on."""
        key = state.astype(np.uint64) << _WIDE | points
        at = self.place(key)
        found = self.keys[at]
        out = self.to[at]
        open_ = np.flatnonzero((found != key) & (found != _FREE))
        while len(open_):
            at[open_] = at[open_] + np.uint64(1) & self.mask
            found = self.keys[at[open_]]
            out[open_] = self.to[at[open_]]
            open_ = open_[(found != key[open_]) & (found != _FREE)]
        return out

    def first_steps(self, length: int, state: np.ndarray, before: np.ndarray, points: np.ndarray) -> np.ndarray:
        """``step`` from the root (length 1) or from the states after one character (length 2), by table where characters are frequent."""
        if length == 1:
            near, out = points < _NEAR, self.one[np.minimum(points, _NEAR - 1)]
        else:
            near, out = (points < _NEAR) & (before < _NEAR), self.two[np.minimum(before, _NEAR - 1), np.minimum(points, _NEAR - 1)]
        wide = np.flatnonzero(~near)
        out[wide] = self.step(state[wide], points[wide])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())

    def spell(self, ids: list[np.ndarray]) -> list[str]:
        """``decode`` of each: the bytes of all pieces are gathered at once.

        Left to the model are the unknown piece, bytes that are no UTF-8, and a row that begins with a byte or a control piece.
        """
        flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32)
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        last = np.cumsum(counts)
        ends = np.concatenate([[0], np.cumsum(self.spelled_size[flat])])
        unknown = np.concatenate([[0], np.cumsum(flat == self.model.unk_id())])
        raw = memoryview(self.spelled.take(pa.array(flat)).buffers()[2] or b"")
        out = []
        for x, a, b in zip(ids, (last - counts).tolist(), last.tolist()):
            start = self.spelled_start[x[0]] if a < b else 0
            if start < 0 or unknown[a] != unknown[b]:
                out.append(self.decode(x))
                continue
            try:
                out.append(str(raw[ends[a] + start:ends[b]], "utf-8"))
            except UnicodeDecodeError:
                out.append(self.decode(x))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(n: int, odd: int) -> np.uint64:
    return np.uint64(n * odd & 0xFFFFFFFFFFFFFFFF)


def _uniform(seed: np.ndarray, n) -> np.ndarray:
    """Numbers strictly between 0 and 1, fixed by seed and counter."""
    h = _mixed(seed + np.uint64(0x9E3779B97F4A7C15) * np.asarray(n, dtype=np.uint64))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


class Lattices:
    """The lattices of the distinct stretches: edges by start, each with its probability given the start."""

    def __init__(self, v: Vocabulary, points: np.ndarray, left: np.ndarray):
        """``points`` are the characters of all stretches, ``left`` the characters from each to its stretch's end."""
        n = len(points)
        at, state, length, parts = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32), 1, []
        count = np.zeros(n, dtype=np.int32)
        while len(at):
            here = points[at + length - 1]
            to = v.first_steps(length, state, points[at], here) if length < 3 else v.step(state, here)
            hit = to >= 0
            at, state = at[hit], to[hit]
            piece = v.end[state]
            whole = piece >= 0
            parts.append((at[whole], np.full(int(whole.sum()), length, dtype=np.int32), piece[whole], count[at[whole]]))
            count[at[whole]] += 1
            if length == 1:  # a character without a piece
                spare = np.flatnonzero(count == 0).astype(np.int32)
                parts.append((spare, np.ones(len(spare), dtype=np.int32), -1 - points[spare].astype(np.int32), np.zeros(len(spare), dtype=np.int32)))
                count[spare] = 1
            more = left[at] > length
            at, state, length = at[more], state[more], length + 1
        # edges by distance of their start to the stretch's end, then by start and length
        node_of = np.argsort(left.astype(np.uint16) if n and int(left.max()) < 1 << 16 else left, kind="stable")
        count = count[node_of]
        first = np.cumsum(count) - count
        begin = np.empty(n, dtype=np.int64)
        begin[node_of] = first
        total_edges = int(count.sum())
        start, size, piece = (np.empty(total_edges, dtype=np.int32) for _ in range(3))
        for from_, long, which, turn in parts:
            place = begin[from_] + turn
            start[place], size[place], piece[place] = from_, long, which
        weight = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], 0.0)
        ends = left[start] == size
        total = np.zeros(n + 1)
        prob = np.zeros(len(start))
        far = left[node_of]
        rounds = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]])) if n else np.zeros(1, dtype=np.int64)
        for a, b in zip(rounds[:-1], rounds[1:]):  # starts with the same distance to the end, nearest first
            lo, hi = first[a], first[b - 1] + count[b - 1]
            value = weight[lo:hi] + np.where(ends[lo:hi], 0.0, total[np.minimum(start[lo:hi] + size[lo:hi], n)])
            group = first[a:b] - lo
            top = np.maximum.reduceat(value, group)
            spread = np.repeat(top, count[a:b])
            total[node_of[a:b]] = top + np.log(np.add.reduceat(np.exp(value - spread), group))
            prob[lo:hi] = value - np.repeat(total[node_of[a:b]], count[a:b])
        self.piece, self.size, self.log = piece, size, prob
        self.first, self.count = begin.astype(np.int32), np.empty(n, dtype=np.int32)
        self.count[node_of] = count
        run = np.cumsum(np.exp(prob))
        self.upto = run - np.repeat(run[first] - np.exp(prob[first]), count) if len(first) else run
        self.upto[first + count - 1] = 2.0
        self.left = left
        p = np.exp(prob)
        each, place = np.repeat(first, count), np.arange(len(start)) - np.repeat(first, count)
        many, self.apart = np.repeat(count, count), np.zeros(len(start))
        for t in range(1, int(many.max(initial=1))):  # sums over the other edges, so that small ones keep their digits
            some = np.flatnonzero(many > t)
            self.apart[some] += p[each[some] + (place[some] + t) % many[some]]

    def sample(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One path for each stretch start in ``at``: edges in order, edges per path, its log-probability, and that of all other paths."""
        steps, live, node, log, n, t = [], np.arange(len(at)), at.copy(), np.zeros(len(at)), np.zeros(len(at), dtype=np.int64), 0
        other = np.zeros(len(at))
        while len(live):
            e = self.first[node]
            free = np.flatnonzero(self.count[node] > 1)
            if len(free):
                u = _uniform(seed[live[free]], t)
                e_free = e[free]
                over = np.flatnonzero(u >= self.upto[e_free])
                while len(over):
                    e_free[over] += 1
                    over = over[u[over] >= self.upto[e_free[over]]]
                e[free] = e_free
            steps.append((live, e))
            if len(free):
                other[live[free]] += np.exp(log[live[free]]) * self.apart[e[free]]
            log[live] += self.log[e]
            n[live] += 1
            go = self.left[node] > self.size[e]
            node, live, t = (node + self.size[e])[go], live[go], t + 1
        place = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int64)
        for t, (who, e) in enumerate(steps):
            out[place[who] + t] = e
        with np.errstate(divide="ignore"):
            return out, n, log, np.log(other)

    def outside(self, at: int, without: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The sets of paths from ``at`` that hold none of ``without``, each by its first edges, and their log-probabilities."""
        begun = {x[:i] for x in without for i in range(len(x))}
        whole, sets, logs = set(without), [], []
        for prefix in sorted(begun):
            node, log = at, 0.0
            for e in prefix:
                node, log = node + int(self.size[e]), log + float(self.log[e])
            f = int(self.first[node])
            for e in range(f, f + int(self.count[node])):
                if (*prefix, e) not in begun and (*prefix, e) not in whole:
                    sets.append((*prefix, e))
                    logs.append(log + float(self.log[e]))
        return sets, np.array(logs)

    def other(self, at: int, without: list[tuple[int, ...]], u: Iterator[float]) -> tuple[tuple[int, ...], float]:
        """A path from ``at`` that is none of ``without``, drawn by its probability among such, of which there must be one."""
        sets, logs = self.outside(at, without)
        share = np.exp(logs - logs.max())
        path = sets[int(np.searchsorted(np.cumsum(share), next(u) * share.sum(), side="right").clip(0, len(sets) - 1))]
        node, log = at, 0.0
        for e in path:
            node, log, last = node + int(self.size[e]), log + float(self.log[e]), node
        while self.left[last] > self.size[path[-1]]:
            e = int(self.first[node])
            if self.count[node] > 1:
                x = next(u)
                while x >= self.upto[e]:
                    e += 1
            path, log, last, node = (*path, e), log + float(self.log[e]), node, node + int(self.size[e])
        return path, log


def _below(score: np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Perturbed scores of sets with the given mass, below ``score``."""
    return -np.logaddexp(-score, np.log(-np.log(u)) - log_mass)


def sample_batch(v: Vocabulary, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``k`` distinct segmentations, by falling perturbed score: (ids, log-probability, score, inclusion)."""
    plain = [v.model.normalize(t) if t else "" for t in texts]
    sizes = np.array([len(t) for t in plain])
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return [[(np.empty(0, dtype=np.uint32), 0.0, 0.0, 1.0)] for _ in texts]
    begins = np.r_[True, ~v.joined(points)]
    doc_start = np.cumsum(sizes) - sizes
    begins[doc_start[sizes > 0]] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.r_[start, len(points)])
    within = np.arange(len(points)) - np.repeat(start, length)
    odd = _mixed(np.arange(int(length.max()), dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    name = _mixed(np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * odd[within], start) + length.astype(np.uint64))
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    own = np.repeat(start[one], length[one])
    base = np.cumsum(length[one]) - length[one]
    inner = np.arange(int(length[one].sum())) - np.repeat(base, length[one])
    lattices = Lattices(v, points[own + inner], (np.repeat(length[one], length[one]) - inner).astype(np.int32))
    at, doc = base[which].astype(np.int32), np.searchsorted(doc_start[sizes > 0], start, side="right") - 1
    doc = np.flatnonzero(sizes > 0)[doc]
    lo, hi = np.searchsorted(doc, np.arange(len(texts)), side="left"), np.searchsorted(doc, np.arange(len(texts)), side="right")
    index = np.arange(len(at)) - lo[doc]

    def drawn(words: np.ndarray, turn: int):
        seed = _mixed(seeds[doc[words]] + _times(turn + 1, 0xD1B54A32D192ED03) + index[words].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        return seed, *lattices.sample(at[words], seed)

    seed, edges, n, log, rest = drawn(np.arange(len(at)), 0)
    run = np.cumsum(log)
    before = run - log - np.repeat((run - log)[lo[hi > lo]], (hi - lo)[hi > lo])
    ends = np.cumsum(n)
    root = -np.log(-np.log(_uniform(seeds, 1 << 40)))
    score = _below(root[doc], before + rest, _uniform(seed, 1 << 41))
    best = np.lexsort((-score, doc))
    rank = np.arange(len(best)) - lo[doc[best]]
    kept = best[(rank < k) & np.isfinite(score[best])]
    sets: list[list] = [[] for _ in texts]
    for w in kept.tolist():
        sets[doc[w]].append((float(score[w]), 0, w))

    # path: words' edges as (parent path, first own word, edges, offsets); the first path has no parent
    ends = np.concatenate([[0], ends])
    paths: list[list] = [[(None, int(lo[d]), edges[ends[lo[d]]:ends[hi[d]]], ends[lo[d]:hi[d] + 1] - ends[lo[d]], float(log[lo[d]:hi[d]].sum()), float(root[d]))]
                         for d in range(len(texts))]
    logs: list[list[np.ndarray]] = [[log[lo[d]:hi[d]]] for d in range(len(texts))]
    tried: list[dict] = [{} for _ in texts]

    def word_edges(d: int, p: int, w: int) -> tuple[int, ...]:
        parent, first, e, offset = paths[d][p][:4]
        while w < first:
            p = parent
            parent, first, e, offset = paths[d][p][:4]
        return tuple(e[offset[w - first]:offset[w - first + 1]].tolist())

    for turn in range(1, k):
        chosen = []
        for d in range(len(texts)):
            if sets[d]:
                top = max(sets[d])
                sets[d].remove(top)
                score_, p, w = top
                gone = tried[d].setdefault((p, w), [word_edges(d, p, w)])
                s = seeds[d:d + 1] + _times(turn, 0xA24BAED4963EE407) + np.uint64(w - lo[d])
                found = lattices.other(int(at[w]), gone, (float(_uniform(s, i)[0]) for i in range(1 << 42, 1 << 43)))
                gone.append(found[0])
                chosen.append((d, score_, p, w, found))
        if not chosen:
            break
        words = np.concatenate([np.arange(w + 1, hi[d]) for d, _, _, w, _ in chosen])
        seed, edges, n, log, rest = drawn(words, turn)
        ends, at_word = np.concatenate([[0], np.cumsum(n)]), 0
        for d, score_, p, w, (own_edges, own_log) in chosen:
            m = int(hi[d]) - w - 1
            part = log[at_word:at_word + m]
            e = np.concatenate([np.array(own_edges, dtype=np.int64), edges[ends[at_word]:ends[at_word + m]]])
            offset = np.concatenate([[0], len(own_edges) + ends[at_word:at_word + m + 1] - ends[at_word]])
            prior = logs[d][p][:w - lo[d]]
            mine = np.concatenate([prior, [own_log], part])
            number = len(paths[d])
            paths[d].append((p, w, e, offset, float(mine.sum()), score_))
            logs[d].append(mine)
            masses = float(prior.sum()) + own_log + np.cumsum(part) - part + rest[at_word:at_word + m]
            new = _below(np.full(m, score_), masses, _uniform(seed[at_word:at_word + m], 1 << 41))
            for j in (np.argpartition(-new, k)[:k] if m > k else np.arange(m)).tolist():
                if np.isfinite(new[j]):
                    sets[d].append((float(new[j]), number, w + 1 + j))
            left = lattices.outside(int(at[w]), tried[d][(p, w)])[1]
            if len(left):
                s = seeds[d:d + 1] + _times(turn, 0x9FB21C651E98DF25) + np.uint64(w - lo[d])
                mass = float(prior.sum()) + float(np.logaddexp.reduce(left))
                sets[d].append((float(_below(np.array([score_]), np.array([mass]), _uniform(s, 3))[0]), p, w))
            at_word += m

    out = []
    for d in range(len(texts)):
        if hi[d] == lo[d]:
            out.append([(np.empty(0, dtype=np.uint32), 0.0, 0.0, 1.0)])
            continue
        limit = max((s[0] for s in sets[d]), default=-np.inf)
        rows = []
        for p, (_, _, _, _, log_, score_) in enumerate(paths[d]):
            whole = _whole(paths[d], p)
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(log_ - limit, 700.0))))
            rows.append((_ids(v, lattices.piece[whole]), log_, score_, inclusion))
        out.append(rows)
    return out


def _whole(paths: list, p: int) -> np.ndarray:
    parent, first, e, _ = paths[p][:4]
    parts = [e]
    while parent is not None:
        up, begin, pe, offset = paths[parent][:4]
        if begin < first:
            parts.append(pe[:offset[first - begin]])
            first = begin
        parent = up
    return np.concatenate(parts[::-1])


def _ids(v: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    """Piece ids; a character without a piece gives the ids of its bytes, or the unknown id."""
    if (pieces >= 0).all():
        return pieces.astype(np.uint32)
    spare = np.flatnonzero(pieces < 0)
    raw = [chr(-1 - int(x)).encode("utf-8", "surrogatepass") for x in pieces[spare]]
    times = np.ones(len(pieces), dtype=np.int64)
    times[spare] = [len(b) if v.byte else 1 for b in raw]
    out = np.repeat(pieces, times)
    out[out < 0] = [v.byte[x] for b in raw for x in b] if v.byte else v.model.unk_id()
    return out.astype(np.uint32)


def sample_segmentations(catalog: DataFrame, model: str, id: str = "id", description: str = "description", k: int = 2,
                         decoded: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of each whole description: (id, rank, ids, log_prob, score, inclusion).

    ``ids`` are piece ids as little-endian unsigned 32-bit numbers; ``log_prob`` is the segmentation's log-probability among all of the
    text; ``score`` is that plus Gumbel noise, falling with ``rank`` (from 1); ``inclusion`` is the chance that it is among the first
    ``k`` given the best score left out, the weight for unbiased estimates. The noise is fixed by the id and the text's length, so a
    record has the same samples on every run. ``decoded`` adds the column ``text`` that the piece ids spell, as
    ``decode_segmentations`` does, without another pass over the rows. No shuffle.

    A null or empty description has one segmentation without pieces; a text with fewer than ``k`` segmentations has them all.
    Repeated records have the same samples. Ids keep their type. Other columns are ignored.
    """
    rows = catalog.select(F.col(id).alias("id"), F.xxhash64(F.col(id), F.length(description)).alias("seed"), F.coalesce(F.col(description), F.lit("")).alias("text"))
    schema = rows.select("id").schema.add("rank", "integer").add("ids", "binary").add("log_prob", "double").add("score", "double").add("inclusion", "double")
    if decoded:
        schema = schema.add("text", "string")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for part in _portions(b):
                seeds = part.column(1).to_numpy().astype(np.int64).view(np.uint64)
                out, drawn = [], sample_batch(v, part.column(2).to_pylist(), seeds, k)
                for i, found in zip(part.column(0).to_pylist(), drawn):
                    out += [(i, r + 1, ids.astype("<u4").tobytes(), log, score, inclusion) for r, (ids, log, score, inclusion) in enumerate(found)]
                columns = [*zip(*out)]
                if decoded:
                    columns.append(v.spell([np.frombuffer(x, dtype="<u4") for x in columns[2]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return rows.mapInArrow(run, schema)


def _portions(b: pa.RecordBatch, chars: int = 2_400_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``chars`` bytes of text, a longer text being one of its own."""
    at, total = 0, 0
    for i, n in enumerate(pa.compute.binary_length(b.column(2)).to_pylist()):
        if total + n > chars and i > at:
            yield b.slice(at, i - at)
            at, total = i, 0
        total += n
    if b.num_rows > at:
        yield b.slice(at)


def decode_segmentations(samples: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``samples`` with the column ``text`` that the piece ids in ``ids`` spell; null ids give null."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(model)
        for b in batches:
            out, some = [None] * len(b), [i for i, x in enumerate(b) if x is not None]
            for at in range(0, len(some), 256):
                part = some[at:at + 256]
                for i, t in zip(part, v.spell([np.frombuffer(b.iloc[i], dtype="<u4") for i in part])):
                    out[i] = t
            yield pd.Series(out, dtype=object)

    return samples.withColumn("text", text(F.col(ids)))
