"""Flat token files: unsigned integers back to back, 64-bit document offsets beside them.

A shard is two files, written by one task each:

* ``<name>.bin``: the ids of its documents, little-endian, in the narrowest
  unsigned type that holds the vocabulary;
* ``<name>.idx``: int64 count n, n doc_ids, n null marks (0 or 1), and
  n + 1 offsets into the ids, so document i is ids[offsets[i]:offsets[i + 1]].

Shards are ranges of doc_id in ascending order (nulls first; rows of one id,
or of none, by the hash of their text, then the text, so many of them are
several shards), and a shard's base is the prefix sum of the id counts before
it.  There are as many shards as shuffle partitions, more if a shard would
hold over SHARD_BYTES of text.  Names
are unique for each task attempt, and only those in the manifest count, so
lost executors and repeated tasks leave no half-written shard in the result.

Null texts are empty documents (the end id alone).  doc_id must be a number.
Extra columns are ignored.
An empty table gives an empty manifest.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, texts

MANIFEST = "shard long, path string, n_docs long, n_ids long, width long"
#: Remembered words of a worker's tokenizer, twice: those used since the last turn, and those of the turn before.
MEMORY = 600_000

#: A word that ends in a letter or digit, and the ASCII punctuation after it (never an apostrophe, which may join the letters).
#: U+00D7 and U+00F7 are no letters, and U+0130 ends in a combining mark once it is in lower case.
_TAIL = re.compile(rb"(.*(?:[a-zA-Z0-9]|(?!\xc3[\x97\xb7]|\xc4\xb0)[\xc3-\xc9][\x80-\xbf]))([!-&(-/:-@\[-`{-~]+)\Z", re.S)
#: Bytes of text encoded at a time, and of a shard.
BLOCK, SHARD_BYTES = 1_000_000, 128_000_000


class WordEncoder:
    """Encodes texts with a tokenizers model that never joins characters across ASCII white space.

    A word's ids are remembered; unseen words are encoded many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of unseen words: those of their letters and those of the punctuation that follows."""
        tails = {}
        for w in words:
            m = _TAIL.match(w)
            if m and b"<|" not in w:
                tails[w] = m.groups()
        fresh = {x for pair in tails.values() for x in pair if x not in self.known}
        fresh.update(w for w in words if w not in tails)
        letters, odd = [], []
        for w in fresh:
            text = w.decode()
            plain = text if text.isascii() else unicodedata.normalize("NFC", text).lower()
            (letters if plain.isalpha() else odd).append((w, text))
        # a word of letters is one word of the library too, which tells them apart
        for k in range(0, len(letters), 200):
            part = letters[k : k + 200]
            found = self.tokenizer.encode(" ".join(t for _, t in part), add_special_tokens=False)
            ids, of = np.array(found.ids, self.dtype), np.array(found.word_ids, np.int64)
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            if len(starts) != len(part):
                odd += part
                continue
            cuts = [*starts.tolist(), len(ids)]
            self.known.update((w, ids[a:b].tobytes()) for (w, _), a, b in zip(part, cuts, cuts[1:]))
        for w, text in odd:
            self.known[w] = np.array(self.ids(text), self.dtype).tobytes()
        for w, (core, tail) in tails.items():
            self.known[w] = self.known[core] + self.known[tail]

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes of self.dtype."""
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        # the model lower-cases; special tokens are matched before that
        words = [(t if b"<|" in t else t.lower()).split() for t in batch]
        new = {w for x in words for w in x if w not in self.known}
        if new:
            again = {w: self.old[w] for w in new if w in self.old}
            self.known.update(again)
            self.learn([w for w in new if w not in again])
        return [b"".join(map(self.known.__getitem__, x)) for x in words]


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of this worker process, kept from task to task."""
    return WordEncoder(path)


def files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, shards: int | None = None) -> DataFrame:
    """Encode docs and write their shards under path (a URI that driver and executors share); returns the manifest with bases.

    tokenizer: path of a tokenizers JSON file that every executor can read.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    if not shards:
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // SHARD_BYTES))
    own = own.withColumn("hash", F.xxhash64("text"))
    ordered = own.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, fs, name = None, None, None
        doc_ids, nulls, lengths = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(tokenizer)
                end = np.array([end_id], encoder.dtype).tobytes()
                fs, root = files(path)
                name = f"{root}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{name}.bin")
            raw, at = texts(batch.column(1)), 0
            doc_ids.append(batch.column(0).fill_null(0).to_numpy())
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            while at < len(raw):
                stop, load = at, 0
                while stop < len(raw) and (stop == at or load + len(raw[stop]) <= BLOCK):
                    load, stop = load + len(raw[stop]), stop + 1
                found = encoder.encode(raw[at:stop])
                for ids in found:
                    out.write(ids)
                    out.write(end)
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)) // encoder.dtype.itemsize + 1)
                at = stop
        if encoder is not None:
            out.close()
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype("<i8")
            n = len(offsets) - 1
            with fs.open_output_stream(f"{name}.idx") as f:
                for part in ([n], np.concatenate(doc_ids), np.concatenate(nulls), offsets):
                    f.write(np.asarray(part).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": name, "n_docs": n, "n_ids": int(offsets[-1]), "width": encoder.dtype.itemsize}])

    fs, root = files(path)
    fs.create_dir(root, recursive=True)
    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "shards")
    # one row for each shard: as many as partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shard(path: str, width: int, uri: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of one shard; the ids are memory-mapped where the store is local."""
    fs, _ = files(uri)
    with fs.open_input_file(f"{path}.idx") as f:
        index = np.frombuffer(f.read(), "<i8")
    n = int(index[0])
    ids, null, offsets = index[1 : n + 1], index[n + 1 : 2 * n + 1], index[2 * n + 1 : 3 * n + 2]
    dtype = np.dtype(f"<u{width}")
    if isinstance(fs, pafs.LocalFileSystem):
        flat = np.memmap(f"{path}.bin", dtype, "r") if offsets[-1] else np.zeros(0, dtype)
    else:
        with fs.open_input_file(f"{path}.bin") as f:
            flat = np.frombuffer(f.read(), dtype)
    return [None if z else d for d, z in zip(ids.tolist(), null.tolist())], offsets, flat


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian uint32) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, flat = read_shard(row["path"], row["width"], path)
                for k in range(0, len(docs), 4096):
                    part = docs[k : k + 4096]
                    cuts = offsets[k : k + len(part) + 1]
                    wide = flat[cuts[0] : cuts[-1]].astype("<u4")
                    local = (cuts - cuts[0]).tolist()
                    crc = [zlib.crc32(wide[a:b].data) for a, b in zip(local, local[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int64()), pa.array(cuts[:-1] + row["base"], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    slices = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(slices, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write docs under path (by default a new folder in the shared one) and read the result back."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(materialize(write(docs, tokenizer, end_id, path), "manifest"), path)
