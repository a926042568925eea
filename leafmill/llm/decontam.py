"""Benchmark decontamination with spaced seeds.

A mask looks at some token positions of a window and ignores the others, so a
hit survives substitutions at ignored positions.  The masked hashes of the
test items are joined with those of the documents; each hit fixes a diagonal
(document position minus item position), and the overlap along it is verified
token by token: some run of `run` aligned tokens (the whole item, if shorter)
must agree in at least `identity` of its tokens.

The masks of an item length are chosen so that every set of substitutions that
the rule accepts leaves one of them a hit: the search finds exactly what
verifying all diagonals would.  Items under `min_tokens` tokens are matched
without substitutions.

The benchmark is joined in shards of at most SHARD_TOKENS tokens (about 30 MB
of hashes), one pass over the documents for each, so what is sent to the
executors has a fixed bound and documents are never shuffled.  Hits of a text
are taken HITS at a time and kept as distinct diagonals, so repeated words
cost time, not memory.

Null and empty texts have no tokens and never match.  Repeated items are
matched once and reported for each of their rows; null item ids are reported
as null.  Of several verified diagonals of an item the one with most equal
tokens is reported, then the first in the document, then the longest, then
the one that starts latest in the item.  doc_id and item_id must be numbers.
An empty benchmark contaminates nothing.  Extra columns pass through
``decontaminate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

RUN, IDENTITY, MIN_TOKENS = 20, 0.8, 8
SHARD_TOKENS = 500_000
FILTER_BITS = 22
#: Looked-at positions of a mask at most, its length at most, and substitution sets up to which masks are searched for.
WEIGHT, SPAN, SETS = 6, 12, 20_000
#: Hits and compared tokens handled at a time.
HITS, CELLS = 1_000_000, 2_000_000

_EDGE = b".,;:!?\"'()[]{}<>*_`"


def tokens(text: bytes) -> np.ndarray:
    """64-bit hashes of the words in ASCII lower case, punctuation stripped at their ends."""
    words = [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def allowed(length: int, identity: float) -> int:
    """Substitutions that the rule accepts in `length` tokens."""
    return length - math.ceil(identity * length - 1e-9)


@lru_cache(100)
def masks(length: int, changes: int) -> tuple[str, ...]:
    """Masks (looked-at positions are 1) of which one at least has a hit in `length` tokens, whichever `changes` of them differ.

    The weight falls from WEIGHT until a greedy cover of all substitution sets takes few masks; where these sets are too
    many, a run of tokens serves that some stretch between substitutions must hold.
    """
    plain = "1" * max(1, math.ceil((length - changes) / (changes + 1)))
    if not changes or math.comb(length, changes) > SETS:
        return (plain if changes else "1" * min(length, SPAN),)
    sets = np.array([sum(1 << i for i in c) for c in combinations(range(length), changes)], np.int64)
    for weight in range(min(WEIGHT, length - changes), len(plain), -1):
        span = min(length, SPAN)
        options = []
        for rest in combinations(range(1, span), weight - 1):
            mask, width = 1 | sum(1 << i for i in rest), rest[-1] + 1
            options.append((mask, width, np.logical_or.reduce([sets & (mask << o) == 0 for o in range(length - width + 1)])))
        out, open_ = [], np.ones(len(sets), bool)
        table = np.array([hit for _, _, hit in options])
        while open_.any() and len(out) < 6:
            best = int((table & open_).sum(1).argmax())
            if not (table[best] & open_).any():
                break
            mask, width, hit = options[best]
            out.append("".join("1" if mask >> i & 1 else "0" for i in range(width)))
            open_ &= ~hit
        if not open_.any():
            return tuple(out)
    return (plain,)


def classes(run: int, identity: float, min_tokens: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """(shortest length, next class's shortest length or 0, masks) of item lengths with the same number of substitutions."""
    out = [(n, n + 1, ("1" * n,)) for n in range(1, min(min_tokens, run + 1))]
    starts = [n for n in range(max(1, min_tokens), run + 1) if n in (min_tokens, run) or allowed(n, identity) != allowed(n - 1, identity)] or [max(min_tokens, run)]
    for n, after in zip(starts, [*starts[1:], 0]):
        out.append((n, after, masks(n, allowed(n, identity))))
    return out


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash of each window."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= h[i : i + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Shard:
    """Masked hashes of some items, sorted, with a filter of fixed size in front."""

    def __init__(self, items: list[bytes], run: int = RUN, identity: float = IDENTITY, min_tokens: int = MIN_TOKENS):
        self.items = [tokens(t) for t in items]
        self.run, self.identity, self.min_tokens = run, identity, min_tokens
        self.masks, self.tables, self.maybe = [], [], np.zeros(1 << FILTER_BITS, bool)
        for least, after, own in classes(run, identity, min_tokens):
            members = [(i, h) for i, h in enumerate(self.items) if len(h) >= least and (not after or len(h) < after)]
            for m in own if members else ():
                use = [(i, seeds(h, m)) for i, h in members]
                codes = np.concatenate([s for _, s in use])
                item = np.repeat(np.array([i for i, _ in use], np.int64), [len(s) for _, s in use])
                at = np.concatenate([np.arange(len(s)) for _, s in use])
                order = np.argsort(codes, kind="stable")
                self.masks.append(m)
                self.tables.append((codes[order], item[order], at[order]))
                self.maybe[codes >> np.uint64(64 - FILTER_BITS)] = True

    def diagonals(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Distinct diagonals (document position minus item position) with a hit, by item."""
        found = []
        for m, (codes, item, at) in zip(self.masks, self.tables):
            s = seeds(h, m)
            where = np.flatnonzero(self.maybe[s >> np.uint64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(codes, s[where], "left"), np.searchsorted(codes, s[where], "right")
            some = hi > lo
            where, lo, n = where[some], lo[some], (hi - lo)[some]
            ends, a = np.cumsum(n), 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")))
                k = np.repeat(lo[a:b], n[a:b]) + np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                found.append(np.unique(np.stack([item[k], np.repeat(where[a:b], n[a:b]) - at[k]], 1), axis=0) if len(k) > 1 else np.stack([item[k], where[a:b] - at[k]], 1))
                a = b
        if not found:
            return {}
        pairs = np.unique(np.concatenate(found), axis=0)
        cuts = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))).tolist() if len(pairs) else []
        return {int(pairs[a, 0]): pairs[a:b, 1] for a, b in zip(cuts, [*cuts[1:], len(pairs)])}

    def matches(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start in the document, aligned tokens, agreeing tokens) of the best verified diagonal of each item."""
        out = []
        for i, diagonals in sorted(self.diagonals(h).items()):
            own, best = self.items[i], None
            need = min(self.run, len(own))
            least = need - (allowed(need, self.identity) if len(own) >= self.min_tokens else 0)
            place = np.arange(len(own))
            for k in range(0, len(diagonals), max(1, CELLS // len(own))):
                d = diagonals[k : k + max(1, CELLS // len(own)), None]
                at = d + place
                inside = (at >= 0) & (at < len(h))
                run = np.zeros((len(d), len(own) + 1), np.int64)
                np.cumsum(inside & (h[np.clip(at, 0, len(h) - 1)] == own), axis=1, out=run[:, 1:])
                # windows that reach beyond the document have too few aligned tokens
                start, stop = np.maximum(0, -d[:, 0]), np.minimum(len(own), len(h) - d[:, 0])
                window = run[:, need:] - run[:, :-need]
                first = np.arange(window.shape[1])
                window[(first < start[:, None]) | (first + need > stop[:, None])] = -1
                for r in np.flatnonzero(window.max(1) >= least).tolist():
                    new = (int(run[r, -1]), -int(d[r, 0] + start[r]), int(stop[r] - start[r]), -int(d[r, 0]))
                    best = new if best is None else max(best, new)
            if best is not None:
                out.append((i, -best[1], best[2], best[0]))
        return out


def shards(benchmark: DataFrame, shard_tokens: int = SHARD_TOKENS) -> list[DataFrame]:
    """The distinct benchmark texts with their item ids, in parts of about shard_tokens words."""
    own = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    words = own.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-int(words) // shard_tokens))
    return [own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def load(part: DataFrame, run: int, identity: float, min_tokens: int) -> tuple[list[list[int | None]], Shard]:
    """Bring one shard to the driver: ids of each distinct text, and its hashes."""
    by: dict[str, list[int | None]] = {}
    for row in part.toLocalIterator():
        by.setdefault(row["text"], []).append(row["item_id"])
    return list(by.values()), Shard([t.encode() for t in by], run, identity, min_tokens)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, run: int = RUN, identity: float = IDENTITY, min_tokens: int = MIN_TOKENS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """doc_id, item_id, start (token of the document where the item is aligned), n_aligned, n_equal."""
    out = None
    for part in shards(benchmark, shard_tokens):
        ids, shard = load(part, run, identity, min_tokens)
        held = docs.sparkSession.sparkContext.broadcast((ids, shard))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, shard = held.value
            for batch in batches:
                rows = [
                    (doc, item, start, n, equal)
                    for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)))
                    for i, start, n, equal in shard.matches(tokens(text))
                    for item in ids[i]
                ]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "n_aligned", "n_equal"])

        found = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(look, "doc_id long, item_id long, start long, n_aligned long, n_equal long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, run: int = RUN, identity: float = IDENTITY, min_tokens: int = MIN_TOKENS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns."""
    at = docs.columns.index("text")
    for part in shards(benchmark, shard_tokens):
        held = docs.sparkSession.sparkContext.broadcast(load(part, run, identity, min_tokens)[1])

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            shard = held.value
            for batch in batches:
                yield batch.filter(pa.array([not shard.matches(tokens(t)) for t in texts(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
