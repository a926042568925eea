"""Context-tree weighting over bytes, learned from the corpus and applied to all of it.

A text is modelled as its words (ASCII lower case, split at ASCII white
space), one space between them and an end symbol.  Each byte is eight binary
decisions; each decision has a context tree whose nodes are the last 0 to
DEPTH bytes.  A node holds the Krichevsky-Trofimov estimate of its own counts
and the weighted probability Pw = (KT + product of its children's Pw) / 2; the
probability of a decision mixes the estimates of all depths along its context
with the weights that follow from these.  The code length of a text is the sum
over its decisions, with the tree as training left it.

Distribution: tasks count (DEPTH + 1)-grams and words (map-side sums, then one
shuffle).  The tree is built in parts that share the last two context bytes,
or three where a two-byte context holds over a HOT-th of all grams (so fewer
than HOT contexts have their depth-two nodes, at most 255 of each bit
position, at the driver); the two depths above are at most 65,536 grams, kept
whole.  Every gram of the corpus gets its log-probability.  Texts are scored
in blocks of about BLOCK_TEXT bytes: the grams and words of a block are joined
with their numbers and laid out as one hash table in the shared folder, which
the tasks that score the block map into memory.  Nothing that grows with the
corpus is broadcast or brought to the driver, and each text is scored once.

Null texts are empty (the end symbol alone).  A null doc_id counts as the empty
string in the split rule; doc_id must be a number.  Repeated rows are scored
each.  Without training rows every decision has probability 1/2.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shared_dir, texts
from .tokenbin import files

DEPTH = 5
#: Grams of the tree that one task builds, and bytes of text handled at a time.
PART, BLOCK = 400_000, 1_000_000
#: Bytes of text that share a scoring table.
BLOCK_TEXT = 32_000_000
#: The tree is dealt by this many bytes of context, by one more where a context has over a HOT-th of all grams.
DEALT, HOT = 2, 1000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def held_out(doc_id: Column) -> Column:
    """The split rule: crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def grams(raw: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each symbol with its context, texts one after another, and how many symbols each text has."""
    bodies = [b" ".join(w) for w in raw]
    pad = bytes(depth)
    joined = np.frombuffer(b"".join(x for b in bodies for x in (pad, b, b"\0")), np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    code = np.zeros(max(0, len(joined) - depth), np.uint64)
    for j in range(depth + 1):
        code <<= np.uint64(8)
        code |= joined[j : len(code) + j]
    # windows that end in the padding of the next text are no symbols
    use = np.ones(len(code), bool)
    ends = np.cumsum(n + depth)[:-1] - depth
    for j in range(depth):
        use[ends + j] = False
    return code[use], n


def word_hashes(raw: list[list[bytes]]) -> np.ndarray:
    h = np.fromiter((x for w in raw for x in map(xxhash.xxh3_64_intdigest, w)), np.uint64, sum(map(len, raw)))
    h[h == _EMPTY] = np.uint64(0)
    return h


def blocks(raw: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words of each) of runs of texts of about size bytes."""
    at = 0
    while at < len(raw):
        end, load = at, 0
        while end < len(raw) and (end == at or load + len(raw[end]) <= size):
            load += len(raw[end])
            end += 1
        yield at, [t.lower().split() for t in raw[at:end]]
        at = end


class Counts:
    """Counts by key, kept as sorted arrays."""

    def __init__(self):
        self.keys, self.n, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.new.append((k, n * weight))
        if sum(len(k) for k, _ in self.new) > max(1_000_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.new:
            keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
            n = np.concatenate([self.n, *[n for _, n in self.new]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.n, self.new = keys[firsts], np.add.reduceat(n, firsts) if len(firsts) else n, []


def blocked(docs: DataFrame, n_blocks: int) -> DataFrame:
    """block, doc_id, held_out and text of each row, written once, so that all passes see the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() % n_blocks
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block, np.int64)), *batch.columns], names=["block", "doc_id", "held_out", "text"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return materialize(own.mapInArrow(run, "block long, doc_id long, held_out boolean, text string"), "texts")


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """kind (0 gram, 1 word), key, n (its training count) and the blocks that have it, held-out texts included, over blocked docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[Counts, Counts]] = {}
        for batch in batches:
            raw, test, block = texts(batch.column(2)), batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at, words in blocks(raw):
                for b in set(block[at : at + len(words)]):
                    own = sums.setdefault(b, (Counts(), Counts()))
                    for weight in (1, 0):
                        part = [w for w, t, x in zip(words, test[at:], block[at:]) if x == b and t != bool(weight)]
                        if part:
                            own[0].add(grams(part, depth)[0], weight)
                            own[1].add(word_hashes(part), weight)
        for b, pair in sums.items():
            for kind, c in enumerate(pair):
                c.merge()
                for k in range(0, len(c.keys), 200_000):
                    keys = c.keys[k : k + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), b, np.int32)), pa.array(c.n[k : k + 200_000])],
                        names=["kind", "key", "block", "n"],
                    )
        sums.clear()
        release()

    found = docs.select("block", "held_out", "text").mapInArrow(run, "kind byte, key long, block int, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks"))


# -------------------------------------------------------------------- the tree


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers (Stirling's series after a shift of small ones)."""
    small = x < 16
    shift = np.zeros(len(x))
    if small.any():
        s = x[small]
        product = np.ones(len(s))
        for i in range(16):
            product *= s + i
        shift[small] = np.log(product)
    y = np.where(small, x + 16, x)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives any order of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - 1.1447298858494002 - lgamma(a + b + 1.0)


def level(keys: np.ndarray, n: np.ndarray, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of depth d for bit k: sorted (context, bits so far), zeros, ones, log KT."""
    g = keys & np.uint64((1 << (8 * (d + 1))) - 1)
    node, bit = g >> np.uint64(8 - k), (g >> np.uint64(7 - k)) & np.uint64(1)
    u, inverse = np.unique(node, return_inverse=True)
    total = np.bincount(inverse, weights=n, minlength=len(u))
    b = np.bincount(inverse, weights=n * bit, minlength=len(u))
    return u, total - b, b, log_kt(total - b, b)


def weigh(nodes, kt, below, d: int, k: int) -> np.ndarray:
    """log Pw of the nodes of depth d, given (nodes, log Pw) one deeper."""
    parent = below[0] & np.uint64((1 << (8 * d + k)) - 1)
    product = np.bincount(np.searchsorted(nodes, parent), weights=below[1], minlength=len(nodes))
    return np.logaddexp(kt, product) - np.log(2)


def mixed(p: np.ndarray, keys: np.ndarray, tree, d: int, k: int) -> np.ndarray:
    """Probability of bit k of each key from depth d on, given that from one deeper."""
    u, a, b, kt, pw = tree
    if not len(u):
        return np.full(len(keys), 0.5)
    g = keys & np.uint64((1 << (8 * (d + 1))) - 1)
    node, bit = g >> np.uint64(8 - k), (g >> np.uint64(7 - k)) & np.uint64(1)
    i = np.minimum(np.searchsorted(u, node), len(u) - 1)
    own = (np.where(bit == 0, a[i], b[i]) + 0.5) / (a[i] + b[i] + 1.0)
    w = np.exp(kt[i] - np.log(2) - pw[i]) if pw is not None else 1.0
    return np.where(u[i] == node, w * own + (1 - w) * p, 0.5)


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, dealt: int = DEALT) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Probabilities from depth `dealt` on (8 for each key), and for each bit the sums of log Pw by node of the depth above."""
    seen = n > 0
    train, counts = keys[seen], n[seen].astype(np.float64)
    out, sums = np.empty((len(keys), 8)), []
    for k in range(8):
        trees, below = {}, None
        for d in range(depth, dealt - 1, -1):
            u, a, b, kt = level(train, counts, d, k)
            pw = None if below is None else weigh(u, kt, below, d, k)
            trees[d] = (u, a, b, kt, pw)
            below = (u, kt if pw is None else pw)
        p = np.full(len(keys), 0.5)
        for d in range(depth, dealt - 1, -1):
            p = mixed(p, keys, trees[d], d, k)
        out[:, k] = p
        up, inverse = np.unique(below[0] & np.uint64((1 << (8 * (dealt - 1) + k)) - 1), return_inverse=True)
        sums.append((up, np.bincount(inverse, weights=below[1], minlength=len(up)).astype(np.float64)))
    return out, sums


def crown(keys: np.ndarray, n: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
    """Trees of the depths above DEALT for each bit, from grams of DEALT bytes and the sums of log Pw below."""
    n = n.astype(np.float64)
    out = []
    for k in range(8):
        trees, below = [None] * DEALT, None
        for d in range(DEALT - 1, -1, -1):
            u, a, b, kt = level(keys, n, d, k)
            if below is None:
                product = np.zeros(len(u))
                product[np.searchsorted(u, sums[k][0])] = sums[k][1]
                pw = np.logaddexp(kt, product) - np.log(2)
            else:
                pw = weigh(u, kt, below, d, k)
            trees[d] = (u, a, b, kt, pw)
            below = (u, pw)
        out.append(trees)
    return out


def by_node(rows, columns: tuple[str, str] = ("key", "value")) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and summed values of some rows at the driver."""
    key, value = rows[columns[0]].to_numpy(np.int64).view(np.uint64), rows[columns[1]].to_numpy(np.float64)
    u, inverse = np.unique(key, return_inverse=True)
    return u, np.bincount(inverse, weights=value, minlength=len(u)).astype(np.float64)


def model(counted: DataFrame, depth: int, n_grams: int) -> DataFrame:
    """key and log10 probability of its last byte, for every gram."""
    spark = counted.sparkSession
    grams_ = counted.where("kind = 0").select("key", "n")

    def context(size: int) -> Column:
        return F.shiftright("key", 8).bitwiseAND((1 << (8 * size)) - 1)

    # fewer than HOT
    hot = [r["c"] for r in grams_.groupBy(context(DEALT).alias("c")).count().where(F.col("count") * HOT > n_grams).select("c").collect()]
    crowded = np.array(sorted(hot), np.uint64)

    def is_hot(keys: np.ndarray) -> np.ndarray:
        return np.isin((keys >> np.uint64(8)) & np.uint64((1 << (8 * DEALT)) - 1), crowded)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        all_keys, all_n = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
        names = ["bit", "depth", "key", "value", "p"]
        apart = is_hot(all_keys)
        for dealt, use in ((DEALT, ~apart), (DEALT + 1, apart)):
            keys = all_keys[use]
            if not len(keys):
                continue
            p, sums = subtree(keys, all_n[use], depth, dealt)
            for k in range(0, len(keys), 50_000):
                part = p[k : k + 50_000]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, 8, dtype=np.int32)), pa.array(part.ravel().astype(np.float32)))
                none = pa.nulls(len(part), pa.int32())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(keys[k : k + 50_000].view(np.int64)), pa.nulls(len(part), pa.float64()), lists], names=names)
            for k, (u, v) in enumerate(sums):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(u), k, np.int32)), pa.array(np.full(len(u), dealt - 1, np.int32)), pa.array(u.view(np.int64)), pa.array(v, pa.float64()), pa.nulls(len(u), pa.list_(pa.float32()))],
                    names=names,
                )

    parts = max(1, -(-n_grams // PART))
    third = F.when(context(DEALT).isin(hot), context(DEALT + 1)).otherwise(F.lit(-1)) if hot else F.lit(-1)
    built = materialize(grams_.repartition(parts, context(DEALT), third).mapInArrow(build, "bit int, depth int, key long, value double, p array<float>"), "tree")
    # bounded: at most 256 contexts, and HOT more of two bytes, with 255 nodes each; and 65,536 grams of two bytes, and HOT x 256 of three
    sums = built.where("bit is not null").groupBy("bit", "depth", "key").agg(F.sum("value").alias("value")).toPandas()
    top = grams_.groupBy(F.col("key").bitwiseAND((1 << (8 * DEALT)) - 1).alias("key")).agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    inner = []
    if hot:
        triples = grams_.where(context(DEALT).isin(hot)).groupBy(F.col("key").bitwiseAND((1 << (8 * DEALT + 8)) - 1).alias("key")).agg(F.sum("n").alias("n")).where("n > 0").toPandas()
        own = triples["key"].to_numpy(np.int64).view(np.uint64), triples["n"].to_numpy(np.float64)
        for k in range(8):
            u, a, b, kt = level(*own, DEALT, k)
            below, product = by_node(sums[(sums["bit"] == k) & (sums["depth"] == DEALT)]), np.zeros(len(u))
            product[np.searchsorted(u, below[0])] = below[1]
            inner.append((u, a, b, kt, np.logaddexp(kt, product) - np.log(2)))
    above = []
    for k in range(8):
        u, v = by_node(sums[(sums["bit"] == k) & (sums["depth"] == DEALT - 1)])
        if hot:
            # the hot contexts' own nodes add to the products above them
            u = np.concatenate((u, inner[k][0] & np.uint64((1 << (8 * (DEALT - 1) + k)) - 1)))
            v = np.concatenate((v, inner[k][4]))
            u, inverse = np.unique(u, return_inverse=True)
            v = np.bincount(inverse, weights=v, minlength=len(u)).astype(np.float64)
        above.append((u, v))
    trees = crown(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), above)
    held = spark.sparkContext.broadcast((trees, inner))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, inner = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy().view(np.uint64)
            p = batch.column(1).flatten().to_numpy().reshape(-1, 8).astype(np.float64)
            total, apart = np.zeros(len(keys)), is_hot(keys)
            for k in range(8):
                x = p[:, k].copy()
                if apart.any():
                    x[apart] = mixed(x[apart], keys[apart], inner[k], DEALT, k)
                for d in range(DEALT - 1, -1, -1):
                    x = mixed(x, keys, trees[k][d], d, k)
                total += np.log10(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], names=["key", "logp"])

    return built.where("bit is null").select("key", "p").mapInArrow(finish, "key long, logp double")


# --------------------------------------------------------------------- scoring


class Table:
    """Read-only hash table from 64-bit keys to numbers (32-bit floats): open addressing, laid out in one go."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.slots = max(16, int(1.4 * len(keys)))
        home = self.home(keys)
        order = np.argsort(home, kind="stable")
        at = np.arange(len(keys))
        at = np.maximum.accumulate(home[order] - at) + at if len(keys) else at
        size = max(self.slots, int(at[-1]) + 1 if len(at) else 0) + 1
        size += size % 2
        self.keys, self.values = np.full(size, _EMPTY), np.zeros(size, np.float32)
        self.keys[at], self.values[at] = keys[order], values[order]

    def write(self, out) -> None:
        out.write(np.array([self.slots, len(self.keys)], "<u8").tobytes())
        out.write(self.keys.astype("<u8").data)
        out.write(self.values.astype("<f4").data)

    @staticmethod
    def words(size: int) -> int:
        """64-bit words that a table of this size takes."""
        return 2 + size + size // 2

    @classmethod
    def read(cls, words: np.ndarray) -> tuple["Table", np.ndarray]:
        """The table at the front of an array of 64-bit words, and the words after it; nothing is copied."""
        t, size = cls.__new__(cls), int(words[1])
        t.slots, t.keys, t.values = int(words[0]), words[2 : 2 + size], words[2 + size : cls.words(size)].view("<f4")
        return t, words[cls.words(size) :]

    def home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return ((mixed * np.uint64(self.slots)) >> np.uint64(32)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, zero for absent keys."""
        at = self.home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.values.dtype.type(0))
        left = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(left):
            at[left] += 1
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != _EMPTY)]
        return out


def write_tables(rows: DataFrame, at: str) -> None:
    """For each block of rows (block, kind, key, value) a file at/block/attempt with the tables of both kinds and a last word 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(block: int, held: list) -> pa.RecordBatch:
            kind, key, value = (np.concatenate(x) for x in zip(*held))
            fs, root = files(at)
            fs.create_dir(f"{root}/{block}", recursive=True)
            with fs.open_output_stream(f"{root}/{block}/{uuid.uuid4().hex}") as out:
                for k in (0, 1):
                    Table(key[kind == k].view(np.uint64), value[kind == k]).write(out)
                out.write(np.array([1], "<u8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], names=["block"])

        last, held = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))).tolist() if len(block) else []
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                if block[a] != last and held:
                    yield close(last, held)
                    held = []
                last = int(block[a])
                held.append(tuple(batch.column(k).slice(a, b - a).to_numpy() for k in (1, 2, 3)))
        if held:
            yield close(last, held)
        release()

    own = rows.select(F.col("block").cast("long"), "kind", "key", "value").repartition("block").sortWithinPartitions("block")
    materialize(own.mapInArrow(run, "block long"), "blocks")


def read_tables(at: str, block: int) -> tuple[Table, Table]:
    """The tables of a block, from an attempt that ended; memory-mapped where the store is local."""
    fs, root = files(at)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{block}", allow_not_found=True))
    for info in sorted(found, key=lambda x: x.path):
        if isinstance(fs, pafs.LocalFileSystem):
            words = np.memmap(info.path, "<u8", "r") if info.size else np.zeros(0, "<u8")
        else:
            with fs.open_input_file(info.path) as f:
                words = np.frombuffer(f.read(), "<u8")
        if len(words) > 5 and words[-1] == 1:
            first, rest = Table.read(words)
            if Table.words(int(rest[1])) + 1 == len(rest):
                return first, Table.read(rest)[0]
    # a block without grams has no file: it can't have texts either, but for those that held no gram when it was counted
    none = Table(np.zeros(0, np.uint64), np.zeros(0))
    return none, none


def score(docs: DataFrame, depth: int = DEPTH, block_text: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    own = blocked(docs, max(1, -(-int(size) // block_text)))
    n_train = own.where("not held_out").count()
    counted = materialize(gather(own, depth), "grams")
    stat = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("n") > 0).alias("seen"), F.sum("n").alias("total")).collect()}
    n_grams = stat[0]["n"] if 0 in stat else 0
    n_words, in_words = (stat[1]["seen"], stat[1]["total"]) if 1 in stat else (0, 0)
    tokens, distinct = in_words + n_train, n_words + (n_train > 0)
    denominator = float(tokens + distinct + 1)
    end_base = float(np.log10((n_train + 1) / denominator))
    probabilities = model(counted, depth, n_grams)
    values = counted.where("kind = 0").select("kind", "key", "blocks").join(probabilities.select("key", F.col("logp").cast("float").alias("value")), "key")
    values = values.select("kind", "key", "blocks", "value").unionByName(counted.where("kind = 1 and n > 0").select("kind", "key", "blocks", F.col("n").cast("float").alias("value")))
    at = f"{shared_dir(spark)}/ctw-{uuid.uuid4().hex}"
    write_tables(values.select(F.explode("blocks").alias("block"), "kind", "key", "value"), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, known = None, None, None
        for batch in batches:
            block, raw = batch.column(0).to_numpy(), texts(batch.column(3))
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))).tolist() if len(block) else []
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                if block[a] != now:
                    now = int(block[a])
                    table, known = read_tables(at, now)
                for k, w in blocks(raw[a:b]):
                    m = len(w)
                    n = np.fromiter(map(len, w), np.int64, m)
                    sizes = np.fromiter((sum(map(len, x)) + max(0, len(x) - 1) + 1 for x in w), np.int64, m)
                    total = np.add.reduceat(table.get(grams(w, depth)[0]), np.cumsum(sizes) - sizes, dtype=np.float64)
                    c = known.get(word_hashes(w)).astype(np.float64)
                    who = np.repeat(np.arange(m), n)
                    base = np.bincount(who, weights=np.log10((c + 1.0) / denominator), minlength=m) + end_base
                    seen = np.bincount(who, weights=c > 0, minlength=m).astype(np.int64) + int(n_train > 0)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(a + k, m), batch.column(2).slice(a + k, m), pa.array(n + 1), pa.array(seen), pa.array(base), pa.array(total), pa.array(sizes)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                    )

    out = own.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score",
        "n_bytes", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
