"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: one bit per hash bit that is set in over half of a text's
shingle hashes.  Search: distinct fingerprints are dealt by pigeonhole blocks
(two codes within `radius` bits agree on one of radius + 1 blocks), so each
block value is a bucket of its own; crowded buckets are dealt again by blocks
of the bits that are left, as often as it takes.  Inside a bucket the codes
are sorted by Gray rank, and runs of neighbours are factored into upper nodes
that hold the bits all their codes share (mask and pattern).  A query descends
from the root, adds up the differing shared bits, and drops a node with
everything below it once the sum exceeds the radius, or once all below it are
known to be in the query's own group.

No pairs leave a bucket: each emits a spanning forest of its links.  Connected
components of the forest (alternating large and small stars) give the groups.

Nulls and empty texts have fingerprint zero.  doc_id must be a number (others
fail the cast).  Rows with the same doc_id and a null doc_id are ordinary rows
in ``components``; ``dedup`` keeps one row of each group (smallest doc_id, of
equal ids the smallest text hash, of equal rows any) and every row without a
doc_id.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, fresh, lookup, materialize, texts

FAN = 8
#: Codes in a bucket beyond which it is dealt again.
CROWDED = 20_000
#: Queries that descend at a time, and nodes that they may reach together; codes of a partition indexed at a time.
BATCH, REACH, CHUNK = 1 << 15, 500_000, 100_000


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: ASCII lower case, ASCII white space, `shingle` words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, hash (of the text) and code (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t, shingle) for t in texts(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], names=["doc_id", "hash", "code"])

    return docs.select(docs["doc_id"].cast("long"), row_hash(docs).alias("hash"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, hash long, code long")


# ------------------------------------------------------------------- the index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence; codes of several words, most significant first, are rows."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    if rank.ndim > 1:
        # the last bit of a word's rank is the parity of its bits, which goes on to the next
        for k in range(1, rank.shape[1]):
            rank[:, k] ^= (rank[:, k - 1] & np.uint64(1)) * ~np.uint64(0)
    return rank


def differing(x: np.ndarray) -> np.ndarray:
    """Set bits of each row."""
    return np.bitwise_count(x).sum(1, dtype=np.int64)


def forest(codes: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, row of its group's root) for all rows that codes of the same bucket within radius bits link, transitively.

    codes has one column for each 64-bit word.
    """
    rank = gray_rank(codes)
    order = np.lexsort((*rank.T[::-1], bucket))
    codes, bucket = codes[order], bucket[order]
    n = len(codes)
    firsts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((firsts, [n])))
    # level 0: the codes; each level above: runs of FAN neighbours of one bucket
    masks, patterns, children = [np.full(codes.shape, ~np.uint64(0))], [codes], []
    owner_sizes = sizes
    while owner_sizes.max(initial=0) > 1:
        up = -(-owner_sizes // FAN)
        starts = np.repeat(np.concatenate(([0], np.cumsum(owner_sizes)[:-1])), up)
        starts = starts + FAN * (np.arange(up.sum()) - np.repeat(np.concatenate(([0], np.cumsum(up)[:-1])), up))
        low, mask = patterns[-1], masks[-1]
        first = np.repeat(low[starts], np.diff(np.concatenate((starts, [len(low)]))), axis=0)
        differ = np.bitwise_or.reduceat((low ^ first) | ~mask, starts, axis=0)
        masks.append(~differ)
        patterns.append(low[starts] & ~differ)
        children.append(np.concatenate((starts, [len(low)])))
        owner_sizes = up
    if not children:
        return order[:0], order[:0]
    parent = np.arange(n)
    root_of = np.repeat(np.arange(len(sizes)), sizes)
    todo = np.flatnonzero(np.repeat(sizes > 1, sizes))
    at, step, one = 0, BATCH, groups_above(parent, children)
    while at < len(todo):
        query = todo[at : at + step]
        node = root_of[query]
        for level in range(len(children) - 1, -1, -1):
            lo, hi = children[level][node], children[level][node + 1]
            if (hi - lo).sum() > REACH and step > 16:
                query = None
                break
            query = np.repeat(query, hi - lo)
            node = np.arange(len(query)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            # all below in the query's own group: nothing to learn there
            near = one[level][node] != parent[query]
            query, node = query[near], node[near]
            near = differing((codes[query] ^ patterns[level][node]) & masks[level][node]) <= radius
            query, node = query[near], node[near]
        if query is None:
            step = max(16, step // 8)
            continue
        at += step
        if len(query):
            link(parent, query, node)
            find(parent)
            one = groups_above(parent, children)
        step = min(BATCH, step * 2)
    moved = np.flatnonzero(parent != np.arange(n))
    return order[moved], order[parent[moved]]


def groups_above(parent: np.ndarray, children: list[np.ndarray]) -> list[np.ndarray]:
    """For the nodes of each level the group of all codes below, -1 if there are several."""
    out = [parent]
    for cuts in children:
        low = out[-1]
        out.append(np.where(np.minimum.reduceat(low, cuts[:-1]) == np.maximum.reduceat(low, cuts[:-1]), low[cuts[:-1]], -1))
    return out


def find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smaller index, many links at a time."""
    while len(a):
        find(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def bucket_links(dealt: DataFrame, names: list[str], radius: int, crowded: int | None = None) -> DataFrame:
    """Edges (a, b) of the forests of all buckets; dealt has bucket, node and the words of its code.

    A bucket of more than `crowded` rows, if that is given, has all its nodes linked without a look at their codes.
    """

    def links(node: np.ndarray, codes: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        a, b = forest(codes, bucket, radius)
        return edges(node[a], node[b])

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, star, centre = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes = np.stack([batch.column(k).to_numpy() for k in range(2, 2 + len(names))], 1).view(np.uint64)
            if star is not None:
                n = int(np.searchsorted(bucket, star, "right"))
                yield edges(node[:n], np.full(n, centre))
                bucket, node, codes = bucket[n:], node[n:], codes[n:]
                if not len(bucket):
                    continue
                star = None
            held.append((bucket, node, codes))
            if sum(len(x[0]) for x in held) < CHUNK:
                continue
            bucket, node, codes = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut:
                yield links(node[:cut], codes[:cut], bucket[:cut])
            held = [(bucket[cut:], node[cut:], codes[cut:])]
            if crowded and len(bucket) - cut > crowded:
                star, centre, held = bucket[-1], node[cut], []
                yield edges(node[cut:], np.full(len(node) - cut, centre))
        if held:
            bucket, node, codes = (np.concatenate(x) for x in zip(*held))
            yield links(node, codes, bucket)

    ordered = dealt.select("bucket", "node", *names).repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of `parts` blocks that cover `bits` bits."""
    edges = [round(bits * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bit_blocks(mask: int, parts: int) -> list[int]:
    """The set bits of mask in `parts` masks of about equal size, from the lowest on."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[a : a + w]) for a, w in blocks(len(bits), parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(codes: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) that connect all distinct codes within radius bits; codes has the column code."""
    spark = codes.sparkSession
    state = codes.select("code", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("mask"))
    masks, out, depth = {0: (1 << 64) - 1}, None, 0
    while masks:
        # each mask of undealt bits splits into blocks; what is left of it is dealt if the bucket is crowded
        split, left = [], {}
        for number, mask in masks.items():
            for j, own in enumerate(bit_blocks(mask, radius + 1)):
                new = number * (radius + 1) + j
                split.append((number, new, signed(own)))
                left[new] = mask & ~own
        table = F.broadcast(spark.createDataFrame(split, "mask int, new int, own long"))
        dealt = materialize(state.join(table, "mask").select(
            "code", F.col("new").alias("mask"), F.xxhash64("bucket", "new", F.col("code").bitwiseAND(F.col("own"))).alias("bucket"),
        ), "dealt")
        sizes = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "n", (F.col("n") > crowded).alias("again")), "sizes")
        total = dealt.count()
        # bits that can't be split any more leave small buckets
        last = any(bin(m).count("1") <= radius for m in left.values())
        shared = lookup(dealt, sizes, "bucket", "n", total)
        found = bucket_links((shared if last else shared.where("not again")).select("bucket", F.col("code").alias("node"), "code"), ["code"], radius)
        out = found if out is None else out.unionByName(found)
        if last or sizes.where("again").isEmpty():
            break
        state, masks, depth = shared.where("again").select("code", "bucket", "mask"), left, depth + 1
    return out.distinct() if depth else out


# ------------------------------------------------------------------ components


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge list (a, b): root is the smallest node reachable.

    Alternating large and small stars, until nothing changes; each round is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def measure() -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    state = measure()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = materialize(lookup(both, least, "u", "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, least, "u", "n", large.count()).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = measure()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(prints: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """code, component_id (smallest doc_id that its links reach) and n (rows) of each distinct code."""
    codes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "codes")
    roots = connected(near_links(codes, radius, crowded))
    label = materialize(codes.join(roots, codes["code"] == roots["node"], "left").select("code", "least", "n", F.coalesce("root", "code").alias("root")), "labels")
    smallest = label.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return lookup(label, smallest, "root", "members", label.count()).select("code", "component_id", "n")


def components(docs: DataFrame, shingle: int = 3, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of each row."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    found = materialize(groups(prints, radius, crowded), "groups")
    return lookup(prints, found, "code", "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def row_hash(docs: DataFrame):
    """What tells rows of one doc_id apart."""
    return F.xxhash64(docs["text"].cast("string"))


def keep_rows(docs: DataFrame, keep: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs that keep names by doc, hash and n (how many equal rows there are, of which one stays), and all without a doc_id.

    rows has the doc and hash of all rows.  Most texts stay, so those that go are looked up: without a shuffle of the texts
    as long as these are few enough to broadcast.
    """
    doc, mark = fresh(docs.columns, "_doc", "_hash")
    names = [F.col(f"`{c}`") for c in docs.columns]
    on = lambda x: few(x.select(F.col("doc").alias(doc), F.col("hash").alias(mark)))
    own = docs.where(docs["doc_id"].isNotNull()).withColumns({doc: docs["doc_id"].cast("long"), mark: row_hash(docs)})
    gone = materialize(rows.join(keep, ["doc", "hash"], "left_anti").select("doc", "hash").distinct(), "gone")
    left, many = own.join(on(gone), [doc, mark], "left_anti"), materialize(keep.where("n > 1").select("doc", "hash"), "many")
    if not many.isEmpty():
        left = left.join(on(many), [doc, mark], "left_anti").unionByName(left.join(on(many), [doc, mark], "left_semi").dropDuplicates([doc, mark]))
    return left.select(*names).unionByName(docs.where(docs["doc_id"].isNull()))


def dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """One document of each group of linked fingerprints; same columns as the input."""
    prints = materialize(fingerprints(docs, shingle).where("doc_id is not null"), "prints")
    # fewest rows first: equal rows, then codes, then groups
    rows = prints.groupBy("code", "doc_id", "hash").agg(F.count("*").alias("n"))
    first = materialize(rows.groupBy("code").agg(F.min(F.struct(F.col("doc_id").alias("doc"), "hash", "n")).alias("first")), "first")
    named = groups(prints, radius, crowded).drop("n").join(first, "code")
    keep = materialize(named.groupBy("component_id").agg(F.min("first").alias("first")).select("first.*"), "keep")
    return keep_rows(docs, keep, prints.select(F.col("doc_id").alias("doc"), "hash"))
