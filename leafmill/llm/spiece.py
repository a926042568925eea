"""SentencePiece encoding and decoding: distinct sampled segmentations of each text.

The lattice of a text has an edge for each vocabulary piece that fits.  A
path's probability is proportional to the product of its edges' weights.  The
sampler is Gumbel top-k without replacement: every node of the search tree (a
partial path) carries the largest Gumbel-perturbed log-probability of the
complete paths below it.  The agenda holds, for each path emitted so far and
each of its edges, the node "same edges up to here, another one now"; the
search pops the node with the largest bound (backward sums of the lattice make
it exact, so no popped node is ever wasted) and completes it.  The paths come
out in descending perturbed score, all distinct.  ``inclusion`` is the
probability that a path is among the k first, given the (k+1)-th score.

Weights: the vocabulary is a merge list without probabilities, so a piece of
merge rank r weighs 1 / (r + RANK_SHIFT) to the power `alpha`; byte pieces
share the last rank.  The model's own deterministic encoding is ``encode``.

Pieces never cross from a letter to a following space, nor a line break, so a
text's lattice is a chain of small ones ("units"; ASCII punctuation after a
letter starts one too, if the vocabulary allows).  What can follow depends on
the rest of a unit alone, so lattices are remembered by unit suffix (by its
64-bit hash).

Random numbers are a counter-based hash of (seed, row key, sample, position):
a row's samples don't depend on partitions, batches or retries.  Null texts
are empty and have one segmentation, without pieces; texts with fewer than k
segmentations emit all they have.  doc_id must be a number; other columns are
ignored.  Repeated row keys draw the same numbers.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import release, texts

SAMPLES, ALPHA, SEED = 2, 1.0, 42
RANK_SHIFT = 10.0
#: Bytes of lattices that a worker remembers before it forgets them all, and at most from task to task; new units learned at a time.
MEMORY, KEEP, LEARN = 40_000_000, 15_000_000, 20_000
#: Rows of a batch unpacked, characters sampled, and characters of a long text looked up at a time.
ROWS, BLOCK, PART = 1000, 250_000, 1_000_000

#: Kinds of characters, and between which two of them a unit ends.
LETTER, SIGN, OTHER, BLANK, BREAK = range(5)
ENDS = np.array([b == BREAK or a == BREAK or (b == BLANK and a != BLANK) or (a == LETTER and b == SIGN) for a in range(5) for b in range(5)])


def kinds(crossed: set[str]) -> np.ndarray:
    """The kind of each code point: letters and digits, ASCII punctuation, spaces, line breaks; others (and the letters crossed) may go on with anything."""
    out = np.full(0x110000, OTHER, np.uint8)
    for m in re.finditer(r"[^\W_]+", np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = LETTER
    out[[ord(x) for x in string.punctuation]] = SIGN
    out[[ord(x) for x in sorted(crossed)]] = OTHER
    out[ord(" ")], out[ord("\n")] = BLANK, BREAK
    return out


_SPACE = "▁"


class Grown:
    """Tables that are appended to."""

    def __init__(self):
        self.room: dict[str, np.ndarray] = {}

    def extend(self, name: str, more: np.ndarray) -> None:
        """Append to a table, in place while there is room: a whole copy for each block would take more time the more is remembered."""
        old = getattr(self, name)
        room, n = self.room.get(name, old), len(old) + len(more)
        if n > len(room):
            room = np.empty(n + n // 4, old.dtype)
            room[: len(old)] = old
            self.room[name] = room
        room[len(old) : n] = more
        setattr(self, name, room[:n])


class Numbers(Grown):
    """Numbers from 1 on of distinct 64-bit keys, by open addressing in a table that is at most half full."""

    def __init__(self):
        super().__init__()
        self.keys = np.zeros(1, np.uint64)
        self.slot = np.zeros(1 << 12, np.int32)

    def nbytes(self) -> int:
        return self.keys.nbytes + self.slot.nbytes

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The slot where the search for a key begins."""
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.slot).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys, 0 for those without one."""
        at = self.place(keys)
        found = self.slot.take(at).astype(np.int64)
        off = np.flatnonzero((self.keys.take(found) != keys) & (found != 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.slot) - 1)
            found[off] = other = self.slot[at[off]]
            off = off[(other != 0) & (self.keys[other] != keys[off])]
        return found

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number keys that have no number yet: numbers of all (equal keys share one), and places of those that got them, in ascending order."""
        size, n = len(self.slot), len(self.keys) + len(keys)
        if 2 * n > size:
            self.slot = np.zeros(1 << (2 * n - 1).bit_length(), np.int32)
            self.put(self.keys[1:], 1)
        base = len(self.keys)
        who, at = self.put(keys, base)
        fresh = np.flatnonzero(who == np.arange(len(keys)))
        number = np.zeros(len(keys), np.int64)
        number[fresh] = base + np.arange(len(fresh))
        self.slot[at[fresh]] = number[fresh]
        self.extend("keys", keys[fresh])
        return number[who], fresh

    def put(self, keys: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Take a slot for each distinct key, marked by base + its place: the place that stands for each key, and its slot."""
        who, at = np.zeros(len(keys), np.int64), self.place(keys)
        todo = np.arange(len(keys))
        while len(todo):
            here = at[todo]
            free = self.slot[here] == 0
            self.slot[here[free]] = base + todo[free]
            # one of several writers stays; marks below base are older keys
            holder = self.slot[here].astype(np.int64) - base
            same = (holder >= 0) & (keys[np.maximum(holder, 0)] == keys[todo])
            who[todo[same]] = holder[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
        return who, at


class Vocabulary:
    """Pieces of a SentencePiece model file and their weights."""

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        self.surface: list[bytes] = [b""] * n
        own: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank = min(-model.get_score(i), float(n))
                own[piece] = (i, -alpha * float(np.log(rank + RANK_SHIFT)))
                self.surface[i] = piece.replace(_SPACE, " ").encode()
        self.spelled = np.array(self.surface, object)
        self.kind = kinds({a for x in own for a, b in zip(x, x[1:]) if a.isalnum() and b.isascii() and not b.isalnum()})
        if any(a != _SPACE and b == _SPACE or "\n" in (a, b) for x in own for a, b in zip(x, x[1:])):
            raise ValueError("a piece of this vocabulary crosses a space or a line break")
        self.byte_cost = -alpha * float(np.log(n + RANK_SHIFT))
        # a trie by its (node, character) keys, nodes numbered in their order
        nodes, keys, ends = {"": 0}, [], {}
        for piece, (i, w) in own.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    keys.append((nodes[piece[: k - 1]] << 21) | ord(piece[k - 1]))
            ends[nodes[piece]] = (i, w)
        self.child = Numbers()
        self.child.add(np.array(keys, np.uint64))
        self.piece, self.weight = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        for node, (i, w) in ends.items():
            self.piece[node], self.weight[node] = i, w
        self.first = np.zeros(0x110000, np.int32)
        keys = self.child.keys[1:]
        root = np.flatnonzero(keys < (1 << 21))
        self.first[keys[root].astype(np.int64)] = root + 1

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        return self.child.find(((node << 21) | char).astype(np.uint64))

    def split(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of texts, each text with a space put first; where their units start; how many units each text has."""
        chars = np.frombuffer("".join([" " + d for d in docs if d]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(d) + 1 if d else 0 for d in docs], np.int64)
        first = np.cumsum(sizes) - sizes
        kind = np.empty(len(chars), np.uint8)
        for k in range(0, len(chars), PART):
            kind[k : k + PART] = self.kind[chars[k : k + PART]]
        cut = np.ones(len(chars), bool)
        cut[1:] = ENDS[kind[:-1] * np.uint8(5) + kind[1:]]
        cut[first[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        return chars, starts, np.diff(np.searchsorted(starts, np.append(first, len(chars))))


class Lattices(Grown):
    """Sampling tables of unit suffixes: for each state its edges by falling probability."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        super().__init__()
        # edges of state s: [edge[s], edge[s + 1]); state 0 is the end of a unit
        self.edge = np.zeros(2, np.int32)
        self.cum = np.zeros(0, np.float32)
        self.logp = np.zeros(0)
        self.next = np.zeros(0, np.int32)
        self.id = np.zeros(0, np.int32)
        # log of the sum over all ways to the end, and the states by the 64-bit hash of their suffix
        self.beta = np.zeros(1)
        self.state = Numbers()

    def nbytes(self) -> int:
        """About how much memory the tables take."""
        return sum(a.nbytes for a in (self.edge, self.cum, self.logp, self.next, self.id, self.beta)) + self.state.nbytes()

    def learn(self, chars: np.ndarray, left: np.ndarray, suffix: np.ndarray) -> None:
        """Add the suffixes of units that no state stands for yet, all at once.

        chars: characters of the units; left: how many are left in the unit, from each one on; suffix: the hash of these.
        """
        # a space is written as the mark; a mark in the text itself has no piece (U+10FFFF stands in) and goes by its bytes
        shown = np.where(chars == 32, ord(_SPACE), np.where(chars == ord(_SPACE), 0x10FFFF, chars))
        sid = self.state.find(suffix)
        new = np.flatnonzero(sid == 0)
        # the shortest first: what follows a state comes before it
        by = left[new]
        new = new[np.argsort(by.astype(np.uint16) if by.max(initial=0) < 1 << 16 else by, kind="stable")]
        states = len(self.edge) - 1
        sid[new], fresh = self.state.add(suffix[new])
        if not len(fresh):
            return
        at = new[fresh]
        dist = left[at]
        # edges: every piece that starts at a new suffix; bytes stand in for a character that has no piece
        count, found = np.zeros(len(at), np.int64), []

        def edges(row: np.ndarray, length: int, ids: np.ndarray, weights: np.ndarray) -> None:
            goes = np.where(dist[row] == length, 0, sid[np.minimum(at[row] + length, len(sid) - 1)])
            found.append((row, count[row], goes, ids, weights))
            count[row] += 1

        node = self.v.first[shown[at]].astype(np.int64)
        single = np.where(node > 0, self.v.piece[node], -1)
        missing = np.flatnonzero(single < 0)
        raw = chars[at[missing]]
        width = 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF)
        one = raw < 0x80
        edges(missing, 1, np.where(one, self.v.byte[raw * one], -1 - raw), width * self.v.byte_cost)
        row, length = np.flatnonzero(node), 1
        node = node[row]
        while len(row):
            ids = self.v.piece[node]
            hit = np.flatnonzero(ids >= 0)
            edges(row[hit], length, ids[hit], self.v.weight[node[hit]])
            more = dist[row] > length
            row, node = row[more], node[more]
            node = self.v.step(node, shown[at[row] + length])
            row, node, length = row[node > 0], node[node > 0], length + 1
        n = count
        firsts = np.cumsum(n) - n
        row, rank, *rest = (np.concatenate(x) for x in zip(*found))
        place = firsts[row] + rank
        goes, i, w = (np.empty(len(place), x.dtype) for x in rest)
        goes[place], i[place], w[place] = rest
        # backward sums, by distance from the end of the unit
        self.extend("beta", np.zeros(len(at)))
        beta = self.beta
        total = np.zeros(len(w))
        steps = np.flatnonzero(np.concatenate(([True], dist[1:] != dist[:-1], [True])))
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist()):
            x, y = firsts[lo], firsts[hi - 1] + n[hi - 1]
            value = w[x:y] + beta[goes[x:y]]
            total[x:y] = value
            r = firsts[lo:hi] - x
            top = np.maximum.reduceat(value, r)
            beta[states + lo : states + hi] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n[lo:hi])), r))
        logp = total - np.repeat(beta[states:], n)
        # the edges of a state by falling probability
        order, cum = np.arange(len(logp)), np.ones(len(logp))
        for m in range(2, int(n.max()) + 1):
            several = firsts[n == m]
            if len(several):
                r = several[:, None] + np.arange(m)
                order[r] = r = np.take_along_axis(r, np.argsort(-logp[r], axis=1, kind="stable"), 1)
                cum[several[:, None] + np.arange(m - 1)] = np.cumsum(np.exp(logp[r[:, :-1]]), axis=1)
        offset = len(self.cum)
        self.extend("edge", offset + np.cumsum(n))
        self.extend("cum", cum)
        self.extend("logp", np.minimum(logp[order], 0.0))
        self.extend("next", goes[order])
        self.extend("id", i[order])

    def states(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The states of units: characters of texts, and where the units start."""
        ends = np.append(starts[1:], len(chars))
        out = np.empty(len(starts), np.int64)
        lo = 0
        while lo < len(starts):
            # long texts go in parts, and bring their new units in parts, to bound the tables made at a time
            a = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, a + PART, "right")))
            b, start, end = ends[hi - 1], starts[lo:hi] - a, ends[lo:hi] - a
            size = end - start
            part, left = chars[a:b].astype(np.int64), np.repeat(end, size) - np.arange(b - a)
            # the hash of a suffix is the sum over its characters and their distances from the end
            sums = np.append(np.uint64(0), np.cumsum(mix((part | (left << 21)).view(np.uint64))))
            last = sums[end]
            whole = last - sums[start]
            found = self.state.find(whole)
            missing = np.flatnonzero(found == 0)
            if len(missing):
                new = missing[np.unique(whole[missing], return_index=True)[1]]
                for k in range(0, len(new), LEARN):
                    some = new[k : k + LEARN]
                    at = np.repeat(end[some] - np.cumsum(size[some]), size[some]) + np.arange(size[some].sum())
                    self.learn(part[at], left[at], np.repeat(last[some], size[some]) - sums[at])
                found[missing] = self.state.find(whole[missing])
            out[lo:hi] = found
            lo = hi
        return out


@lru_cache(1)
def tables_of(model: str, alpha: float) -> Lattices:
    """The lattices of this worker process, kept from task to task."""
    return Lattices(Vocabulary(model, alpha))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit counters (SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def mixed(size: int) -> np.ndarray:
    """Mixed counters from 0."""
    return mix(np.arange(size, dtype=np.uint64))


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), one for each key and counter."""
    return unit(mix(key ^ mix(np.asarray(counter, np.uint64))))


def unit(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(t: Lattices, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path from each state to the end of its unit: edges of all walkers in order, and how many each has."""
    who, steps, n = np.flatnonzero(state), [], np.zeros(len(state), np.int64)
    state, key, k = state[who], key[who], 0
    while len(who):
        at = t.edge.take(state).astype(np.int64)
        u = unit(mix(key ^ mix(np.full(1, k, np.uint64))))
        up = np.flatnonzero(t.cum.take(at) < u)
        while len(up):
            at[up] += 1
            up = up[t.cum[at[up]] < u[up]]
        n[who] += 1
        steps.append((who, at))
        state = t.next.take(at)
        go = np.flatnonzero(state)
        who, key, state, k = who[go], key[go], state[go], k + 1
    out = np.zeros(n.sum(), np.int64)
    offset = np.cumsum(n) - n
    for k, (w, at) in enumerate(steps):
        out[offset[w] + k] = at
    return out, n


class Path:
    """One emitted path of a document: its edges, where it left its parent, and the agenda nodes beside it.

    late: for "another edge here" at each edge, the log of when the best such path would come; the path itself comes at -gumbel.
    """

    __slots__ = ("edges", "gumbel", "logp", "left", "banned", "late", "at", "bound")

    def __init__(self, edges, gumbel, logp, left, banned, late):
        self.edges, self.gumbel, self.logp, self.left, self.banned, self.late = edges, gumbel, logp, left, banned, late
        self.look()

    def look(self) -> None:
        """The best node left, and its perturbed bound, which gumbel caps."""
        self.at = int(self.late.argmin()) if len(self.late) else 0
        self.bound = float(-np.logaddexp(-self.gumbel, self.late[self.at])) if len(self.late) else -np.inf


def log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > -0.693, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def arrivals(t: Lattices, edges: np.ndarray, sizes: np.ndarray, key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """When "another edge here" would come (Path.late) for each edge, and log-probability up to and with it.

    Documents follow one another; sizes edges each; before: log-probability ahead of their first edge.
    """
    logp = t.logp.take(edges)
    run = np.cumsum(logp)
    first = np.cumsum(sizes) - sizes
    base = np.where(sizes > 0, run[np.minimum(first, max(0, len(run) - 1))] - logp[np.minimum(first, max(0, len(run) - 1))], 0.0) if len(run) else np.zeros(len(sizes))
    total = run - np.repeat(base - before, sizes)
    place = total - logp + log1mexp(logp)
    # one number for each document and position
    counters = mixed(1 << max(16, int(sizes.max(initial=0)).bit_length())).take(np.arange(len(edges)) - np.repeat(first, sizes))
    noise = np.log(-np.log(unit(mix(np.repeat(key, sizes) ^ counters))))
    return noise - place, total


def sample(t: Lattices, docs: list[str], keys: np.ndarray, k: int) -> list[list[Path]]:
    """Up to k distinct paths of each text, best perturbed score first (and one more bound kept in their agendas)."""
    chars, starts, n_units = t.v.split(docs)
    state = t.states(chars, starts)
    doc = np.repeat(np.arange(len(docs)), n_units)
    unit0 = np.cumsum(n_units) - n_units
    unit_no = (np.arange(len(state)) - unit0[doc]).astype(np.uint64)

    def unit_keys(d, numbers, draw):
        return mix(keys[d] ^ mix((numbers << np.uint64(32)) + np.uint64(8 * draw + 1)))

    edges, n = walk(t, state, unit_keys(doc, unit_no, 0))
    sizes = np.bincount(doc, weights=n, minlength=len(docs)).astype(np.int64) if len(doc) else np.zeros(len(docs), np.int64)
    gumbel = -np.log(-np.log(uniform(keys, np.full(len(docs), 1 << 40))))
    late, total = arrivals(t, edges, sizes, mix(keys ^ np.uint64(2)), np.zeros(len(docs)))
    first = np.cumsum(sizes) - sizes
    out: list[list[Path]] = []
    for d, (a, m) in enumerate(zip(first.tolist(), sizes.tolist())):
        out.append([Path(edges[a : a + m], float(gumbel[d]), float(total[a + m - 1]) if m else 0.0, 0, (), late[a : a + m])])
    for draw in range(1, k):
        jobs = []
        for d, paths in enumerate(out):
            if len(paths) < draw or not len(paths[0].edges):
                continue
            best = max(paths, key=lambda p: p.bound)
            at, top = best.at, best.bound
            if top == -np.inf:
                continue
            best.late[at] = np.inf
            best.look()
            chosen = int(best.edges[at])
            banned = (*best.banned, chosen) if at == best.left and best.banned else (chosen,)
            # the state here: the edges of one state are neighbours
            s = int(t.edge.searchsorted(np.int32(chosen), "right")) - 1
            lo, hi = int(t.edge[s]), int(t.edge[s + 1])
            p = np.exp(t.logp[lo:hi])
            p[[x - lo for x in banned]] = 0.0
            c = np.cumsum(p)
            if c[-1] <= 0:
                continue
            u = uniform(keys[d : d + 1], np.array([(1 << 41) + draw]))[0] * c[-1]
            other = lo + min(int(np.searchsorted(c, u, "right")), int(np.flatnonzero(p)[-1]))
            # units completed by the edges before: those that lead to the end
            done = int(np.count_nonzero(t.next[best.edges[:at]] == 0))
            jobs.append((d, best, at, top, banned, other, done, float(c[-1])))
        if not jobs:
            break
        heads = np.array([t.next[j[5]] for j in jobs])
        rest = [state[unit0[j[0]] + j[6] + 1 : unit0[j[0]] + n_units[j[0]]] for j in jobs]
        walkers = np.concatenate([x for h, r in zip(heads, rest) for x in (h[None], r)])
        sizes_w = np.array([1 + len(r) for r in rest])
        dw = np.repeat(np.array([j[0] for j in jobs]), sizes_w)
        no = np.concatenate([np.arange(j[6], j[6] + m) for j, m in zip(jobs, sizes_w)]).astype(np.uint64)
        edges, n = walk(t, walkers, unit_keys(dw, no, draw))
        job = np.repeat(np.arange(len(jobs)), sizes_w)
        sizes = np.bincount(job, weights=n, minlength=len(jobs)).astype(np.int64)
        dj = np.array([j[0] for j in jobs])
        before = np.array([float(t.logp[j[1].edges[: j[2]]].sum()) + float(t.logp[j[5]]) for j in jobs])
        late, total = arrivals(t, edges, sizes, mix(keys[dj] ^ np.uint64(16 + draw)), before)
        first = np.cumsum(sizes) - sizes
        for q, (d, parent, at, top, banned, other, _, mass) in enumerate(jobs):
            a, m = int(first[q]), int(sizes[q])
            # what is left of the node that was split: neither of the edges tried so far
            left_mass = mass - float(np.exp(t.logp[other]))
            place = before[q] - float(t.logp[other]) + (np.log(left_mass) if left_mass > 1e-15 else -np.inf)
            noise = np.log(-np.log(uniform(keys[d : d + 1], np.array([(1 << 42) + draw]))[0]))
            here = noise - place if np.isfinite(place) else np.inf
            own = np.concatenate((np.full(at, np.inf), [here], late[a : a + m]))
            path = np.concatenate((parent.edges[:at], [other], edges[a : a + m]))
            out[d].append(Path(path, top, float(total[a + m - 1]) if m else float(before[q]), at, banned, own))
    return out


def piece_ids(t: Lattices, edges: np.ndarray) -> np.ndarray:
    """Vocabulary ids along a path; characters without a piece become their bytes."""
    ids = t.id.take(edges)
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    out, last = [], 0
    for x in odd.tolist():
        out += [ids[last:x], t.v.byte[np.frombuffer(chr(-1 - int(ids[x])).encode(), np.uint8)]]
        last = x + 1
    return np.concatenate([*out, ids[last:]])


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of a sequence of ids: pieces joined, without the space that encoding puts first."""
    return b"".join(v.spelled[ids].tolist())[1:]


def encode(path: str, lines: list[str]) -> list[list[int]]:
    """The model's own deterministic encoding."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).encode(lines, num_threads=1)


def row_keys(ids: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(x).encode(), seed) for x in ids], np.uint64)


SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids_crc32 long"


def segmentations(docs: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """k sampled segmentations of each text, one row each; with_ids adds the ids themselves.

    round_trip: decoding the ids gives the text back.  log_prob, perturbed: natural logarithms.
    model: path of a SentencePiece model file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            tables = tables_of(model, alpha)
            ids, raw = whole.column(0).to_pylist(), texts(whole.column(1))
            at = 0
            while at < len(raw):
                end, load = at, 0
                while end < len(raw) and (end == at or load + len(raw[end]) <= BLOCK):
                    load += len(raw[end])
                    end += 1
                yield block(tables, ids[at:end], raw[at:end])
                at = end
            release()
        # what an idle worker holds is missing elsewhere
        if tables_of(model, alpha).nbytes() > KEEP:
            tables_of(model, alpha).clear()
        release()

    def block(t: Lattices, ids: list, raw: list[bytes]) -> pa.RecordBatch:
        if t.nbytes() > MEMORY:
            t.clear()
        rows, ids_of = [], []
        for doc, text, paths in zip(ids, raw, sample(t, [x.decode() for x in raw], row_keys(ids, seed), k)):
            # the (k+1)-th perturbed score: the best bound still on the agenda
            after = max(p.bound for p in paths)
            for s, p in enumerate(paths):
                pieces = piece_ids(t, p.edges)
                inclusion = 1.0 if after == -np.inf else float(-np.expm1(-np.exp(min(p.logp - after, 700.0))))
                wide = pieces.astype("<u4")
                rows.append((doc, s, len(pieces), p.logp, p.gumbel, inclusion, (decode(t.v, pieces) if len(pieces) else b"") == text, zlib.crc32(wide.data)))
                if with_ids:
                    ids_of.append(wide.astype(np.int32))
        columns = list(zip(*rows)) or [[]] * 8
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
        arrays, names = [pa.array(c, y) for c, y in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")]
        if with_ids:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids_of]))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids_of]))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
