"""Near copies: the Gray-order index finds candidates, sets of five-word runs decide at a Jaccard similarity of 0.8.

Candidates: 192-bit SimHash fingerprints of the distinct five-word shingles.
Texts at a similarity of 0.8 differ in 29 bits on average (an angle of 27
degrees), which leaves no block of bits that must agree, so codes are dealt to
``tables`` of ``width`` bits each, drawn at random: wide enough that a bucket
holds few texts by chance, and as many that a pair at 0.8 meets in one with
MEETS probability.  Buckets are searched by the Gray-order index within
RADIUS bits.  Buckets of copies by the thousand have all their texts linked
without a look at the codes.  Components of the links are candidate groups.

Verification: inside a candidate group similarities are exact, and a link
counts only at 0.8 or more; links are transitive.  A breadth-first search
compares texts with those not reached yet.  Groups of up to HOT shingles are
searched in one task; larger ones in rounds over the cluster, each of which
compares a block of texts of bounded size with all others of its group.

Words are split at ASCII white space and compared in ASCII lower case; a text
of fewer than five words is one shingle, and texts without words are copies of
each other.  Of texts with the same words one goes on.  Null doc_ids aren't
compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import few, materialize, release, texts
from .simhash import row_hash, signed

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint, bits that may differ in all (three standard deviations more than expected), and probability that a pair shares a table.
WORDS, RADIUS, MEETS = 3, 44, 0.98
CODE = [f"c{w}" for w in range(WORDS)]
#: Rows of a batch that a worker unpacks at a time; of their words it holds one text's.
ROWS = 500
#: Shingles of a candidate group that one task holds, and of the texts that one round sends to all executors; groups in a round.
HOT, BLOCK, ROOTS = 2_000_000, 1_000_000, 100


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `size` words, in ascending order."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, n))


def key_of(words: list[bytes]) -> int:
    """A signed long that stands for the words of a text."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 7)).astype(np.int64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words: the bits set in over half of the hashes, and of the hashes mixed again."""
    out = []
    for _ in range(WORDS):
        out.append(hashes)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes = hashes ^ (hashes >> np.uint64(29))
    raw, ones = np.stack(out, 1).view(np.uint8).reshape(-1, 8 * WORDS), np.zeros(64 * WORDS, np.int64)
    # a byte counts up to 255
    for k in range(0, len(raw), 255):
        ones += np.unpackbits(raw[k : k + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(raw), bitorder="little").view(np.uint64)


def tables(n: int, least: float = SIMILARITY, meets: float = MEETS) -> list[list[int]]:
    """Masks (a list of words each) for n texts: about 64 of them to a bucket by chance."""
    width = max(0, math.ceil(math.log2(max(2, n))) - 6)
    # the angle of two sets of equal size gives the share of bits that differ
    differ = math.acos(2 * least / (1 + least)) / math.pi
    agree = 1 - differ - math.sqrt(differ * (1 - differ) / (64 * WORDS))
    count = max(16, math.ceil(math.log(1 - meets) / math.log1p(-(agree**width)))) if width else 1
    rng = np.random.default_rng(42)
    picks = [rng.permutation(64 * WORDS)[:width].tolist() for _ in range(count)]
    return [[sum(1 << (b % 64) for b in bits if b // 64 == w) for w in range(WORDS)] for bits in picks]


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> list[int]:
    """For each set the smallest index of its component; sets (not empty) of a similarity of `least` or more are linked."""
    label = list(range(len(sets)))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(distinct), bool)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    own = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
    rest = np.arange(len(sets))
    while len(rest):
        seed, rest = int(rest[0]), rest[1:]
        flat = np.concatenate([own[i] for i in rest]) if len(rest) else flat[:0]
        queue = [seed]
        while queue and len(rest):
            at = queue.pop()
            marked[own[at]] = True
            shared = np.add.reduceat(marked[flat], np.concatenate(([0], np.cumsum(sizes[rest])[:-1])), dtype=np.int64)
            marked[own[at]] = False
            near = shared >= least * (sizes[rest] + sizes[at] - shared) - 1e-9
            if near.any():
                found = rest[near].tolist()
                for i in found:
                    label[i] = seed
                queue += found
                flat, rest = flat[np.repeat(~near, sizes[rest])], rest[~near]
    return label


def near(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted, not empty) have a similarity of `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to ROWS rows."""
    return (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))


def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``prints`` gives of batches (doc_id, hash, text)."""

    def one(text: bytes) -> tuple[int, int, np.ndarray]:
        words = text.lower().split()
        own = shingles(words)
        return key_of(words), len(own), fingerprint(own)

    for batch in pieces(batches):
        keys, sizes, codes = zip(*map(one, texts(batch.column(2))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(c) for c in np.array(codes).view(np.int64).T]],
            names=["doc_id", "hash", "key", "size", *CODE],
        )
    release()


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, hash, key, size (distinct shingles) and the words of the fingerprint of each row; rows without words have no shingles."""
    own = docs.select(docs["doc_id"].cast("long"), row_hash(docs).alias("hash"), docs["text"].cast("string"))
    return own.mapInArrow(printed, "doc_id long, hash long, key long, size long, " + ", ".join(f"{c} long" for c in CODE))


def candidates(reps: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, crowded: int = simhash.CROWDED) -> DataFrame:
    """Links (a, b) between keys of distinct texts with similar fingerprints; reps has key, size and the fingerprint."""
    masks = tables(reps.count(), least)
    hashed = F.array(*[F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(signed(m)) for c, m in zip(CODE, mask) if m]) for t, mask in enumerate(masks)])
    dealt = reps.where("size > 0").select(F.col("key").alias("node"), *CODE, F.explode(hashed).alias("bucket"))
    return simhash.bucket_links(dealt, CODE, radius, crowded)


def verified(members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """key and label (one key for each component) of members (root, key, set), compared within their root in one task."""

    def judge(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        label = similar(sets, least)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[c] for c in label], pa.int64())], names=["key", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, {}
        for batch in batches:
            for k, (root, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if root != last and rows:
                    yield judge(list(rows), list(rows.values()))
                    rows = {}
                last = root
                rows[key] = set_of(batch.column(2), k)
        if rows:
            yield judge(list(rows), list(rows.values()))

    return members.select("root", "key", "set").repartition("root").sortWithinPartitions("root").mapInArrow(run, "key long, label long")


def set_of(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), np.uint64)


def settled(members: DataFrame, least: float = SIMILARITY, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """The same as ``verified`` for groups of any size, in rounds; members (root, key, size, set).

    A row is unreached (label null), reached (it has a label but wasn't compared with the unreached) or done.  A round takes
    for each root its reached rows, or if the unreached are fewer those, or else one unreached row as the seed of a component,
    up to `block` shingles in all, and compares them with the other side.
    """
    spark = members.sparkSession
    table = materialize(members.select("root", "key", "size", "set", F.lit(None).cast("long").alias("label")), "hot")
    done: list[DataFrame] = []
    while True:
        free = F.col("label").isNull()
        stats = table.groupBy("root").agg(
            F.sum(F.when(free, F.col("size")).otherwise(0)).alias("free"), F.sum(F.when(free, 0).otherwise(F.col("size"))).alias("reached"),
            F.min(F.when(free, F.struct("key", "size"))).alias("seed"),
        ).orderBy("root").limit(ROOTS).collect()
        if not stats:
            break
        chosen, room, sides, final, small = [], block, {}, [], []
        for r in stats:
            root = F.col("root") == r["root"]
            if not r["free"]:
                final.append(r["root"])
            elif not r["reached"] and r["free"] <= hot:
                small.append(r["root"])
            elif room <= 0:
                continue
            elif not r["reached"]:
                chosen.append(root & (F.col("key") == r["seed"]["key"]))
                sides[r["root"]] = "seed"
                room -= r["seed"]["size"]
            elif r["free"] <= min(room, r["reached"]):
                chosen.append(root & free)
                sides[r["root"]] = "free"
                room -= r["free"]
            else:
                cut = None
                for row in table.where(root & ~free).select("key", "size").orderBy("key").toLocalIterator():
                    if cut is not None and row["size"] > room:
                        break
                    cut, room = row["key"], room - row["size"]
                chosen.append(root & ~free & (F.col("key") <= cut))
                sides[r["root"]] = "reached"
        if final:
            done.append(materialize(table.where(F.col("root").isin(final)).select("key", "label"), "settled"))
        if small:
            done.append(materialize(verified(table.where(F.col("root").isin(small)), least), "settled"))
        table = table.where(~F.col("root").isin(final + small)) if final or small else table
        if not chosen:
            table = materialize(table, "hot")
            continue
        which = chosen[0]
        for c in chosen[1:]:
            which |= c
        held: dict[int, list] = {}
        for row in table.where(which).select("root", "key", "label", "set").toLocalIterator():
            held.setdefault(row["root"], []).append((row["key"], row["label"], np.frombuffer(bytes(row["set"]), np.uint64)))
        sent = spark.sparkContext.broadcast((sides, held))

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            # (key, new label, done) of rows that change
            sides, held = sent.value
            for batch in batches:
                out = []
                for k, (root, key, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                    side = sides.get(root)
                    if side is None or label is None and side == "free":
                        continue
                    if side == "free":
                        # a reached row finds the unreached that it links, and is done
                        own = set_of(batch.column(3), k)
                        out += [(other, label, False) for other, _, s in held[root] if near(own, s, least)]
                        out.append((key, label, True))
                    elif any(key == other for other, _, _ in held[root]):
                        out.append((key, key if label is None else label, True))
                    elif label is None:
                        own = set_of(batch.column(3), k)
                        new = next((other if x is None else x for other, x, s in held[root] if near(own, s, least)), None)
                        if new is not None:
                            out.append((key, new, False))
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["key", "new", "done"])

        found = table.select("root", "key", "label", "set").mapInArrow(compare, "key long, new long, done boolean")
        found = materialize(found.groupBy("key").agg(F.min("new").alias("new"), F.max("done").alias("done")), "found")
        done.append(materialize(found.where("done").select("key", F.col("new").alias("label")), "settled"))
        table = materialize(
            table.join(found, "key", "left").where("done is null or not done").select("root", "key", "size", "set", F.coalesce("label", "new").alias("label")), "hot"
        )
    out = members.select("key", F.col("key").alias("label")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def groups(docs: DataFrame, own: DataFrame, least: float = SIMILARITY, hot: int = HOT, block: int = BLOCK, crowded: int = simhash.CROWDED) -> DataFrame:
    """key, first (doc, hash and n of the row of these words that comes first) and label (a key that stands for its group) of each distinct text.

    own: the prints of docs.
    """
    rows = own.groupBy("key", "size", *CODE, "doc_id", "hash").agg(F.count("*").alias("n"))
    reps = materialize(rows.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").alias("doc"), "hash", "n")).alias("first"), *[F.min(c).alias(c) for c in ("size", *CODE)]
    ), "reps")
    found = materialize(simhash.connected(candidates(reps, least, crowded=crowded)), "roots")
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    named = materialize(members.join(reps, members["node"] == reps["key"]).select("root", "key", "size", "first.doc", "first.hash"), "members")
    weight = named.groupBy("root").agg(F.sum("size").alias("all")).where(F.col("all") > hot).select("root", F.lit(True).alias("hot"))
    weight = materialize(weight, "weight")
    text = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc"), row_hash(docs).alias("hash"), docs["text"].cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingles(t.lower().split()).tobytes() for t in texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["root", "key", "size", "set"])
        release()

    # equal rows have the same key: one of them is enough
    texts_of = text.join(few(named), ["doc", "hash"]).select("root", "key", "size", "text")
    with_sets = texts_of.mapInArrow(sets, "root long, key long, size long, set binary")
    label = materialize(verified(with_sets.join(weight, "root", "left_anti"), least), "near")
    if not weight.isEmpty():
        label = label.unionByName(settled(with_sets.join(weight, "root", "left_semi").dropDuplicates(["key"]), least, hot, block))
    return reps.join(label, "key", "left").select("key", "first", F.coalesce("label", "key").alias("label"))


def dedup(docs: DataFrame, least: float = SIMILARITY, hot: int = HOT, block: int = BLOCK, crowded: int = simhash.CROWDED) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; same columns as the input."""
    own = materialize(prints(docs.where(docs["doc_id"].isNotNull())), "prints")
    keep = groups(docs, own, least, hot, block, crowded).groupBy("label").agg(F.min("first").alias("first")).select("first.*")
    return simhash.keep_rows(docs, materialize(keep, "keep"), own.select(F.col("doc_id").alias("doc"), "hash"))
