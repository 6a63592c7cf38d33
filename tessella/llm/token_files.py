"""Token-id files with fixed-width bit packing.

A set of files is a Parquet directory, so writing is committed task by task and can be read from any store Spark reads. Each
row is a block: the ids of whole documents in ascending order, packed at the fewest bits that hold any id of the vocabulary, with the
documents' ids, offsets and the block's place in its shard. Blocks of a shard follow one another, and shards are ranges of doc_id in ascending order.
Any id is found by bit arithmetic, so a reader unpacks a whole block, or a slice of it, with numpy.

Defined cases: null and empty texts hold the end id only; rows with the same doc_id are kept, ordered by text; null doc_ids come
first; a document of more than BLOCK_IDS ids is a block of its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, partitions_for, shared_folder, turn

#: Ids in a block, about.
BLOCK_IDS = 1 << 16
#: Shards (16 bytes each) up to this many are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_SHARDS = 1_000_000
#: Chunks of text, and letters and marks in them, that a worker keeps with their ids.
MEMO_CHUNKS = 800_000
#: Marks that end a word's run of letters in the split of the tokenizer file, without the apostrophe.
TAIL = "!#$%&*+,-./:;<=>?@|"

FILE_SCHEMA = "shard int, block int, width int, n_ids long, shard_start long, doc_ids array<bigint>, offsets array<bigint>, payload binary"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive little-endian `width`-bit fields."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of a packed block, without touching the bytes before."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    first = start * width // 8
    data = np.frombuffer(payload, np.uint8, -(-(start + count) * width // 8) - first, first)
    bits = np.unpackbits(data, bitorder="little")[start * width - 8 * first :][: count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


class Chunks(dict):
    """Chunk of text between single blanks -> its ids, as little-endian uint32 bytes, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        split = json.dumps(spec.get("pre_tokenizer") or {})
        #: Whether blanks are dropped and runs of letters stand alone, so that chunks can be encoded by themselves.
        self.by_chunk = '"Removed"' in split and "\\\\p{L}" in split
        #: Tokens that end a run of letters, by id: a line of many runs is encoded at once and cut behind them.
        suffix = (spec["model"].get("end_of_word_suffix") or "") if self.by_chunk else ""
        self.ends = np.zeros(self.vocabulary, bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer") or {})

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of Latin-1 letters."""
        if not self.ends.any():
            return self.raw(runs)
        out: list[bytes] = []
        for k in range(0, len(runs), 65536):
            part = runs[k : k + 65536]
            lines = [" ".join(part[i : i + 1024]) for i in range(0, len(part), 1024)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):
                return self.raw(runs)
            data, at = ids.tobytes(), 0
            for end in cuts.tolist():
                out.append(data[at:end])
                at = end
        return out

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks: of letters and of the marks behind them apart. Both are chunks themselves and kept as such."""
        cut, runs, rest = [], {}, {}
        for c in chunks:
            stem = c.rstrip(TAIL)
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):  # composed letters, of one lower-case letter each
                run = stem.lower() if self.lower else stem
                if run not in self:
                    runs[run] = None
                if run != c:
                    tail = c[len(stem) :]
                    if tail and tail not in self:
                        rest[tail] = None
                    cut.append((c, run, tail))
            else:
                rest[c] = None
        self.update(zip(runs, self.letters(list(runs)), strict=True))
        self.update(zip(rest, self.raw(list(rest)), strict=True))
        for c, a, b in cut:
            self[c] = self[a] + self[b] if b else self[a]

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        if not self.by_chunk:
            return [x + end for x in self.raw(texts)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO_CHUNKS:
            self.clear()
            new = list(words)
        self.learn(new)
        return [b"".join(map(self.__getitem__, words)) + end for words in split]


@lru_cache(maxsize=2)
def chunks_of(path: str) -> Chunks:
    return Chunks(path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> str:
    """Write the token ids of docs in ascending key order to folder. Texts (compressible) are ordered, not ids."""

    def run(batches: Iterator):
        import pyarrow as pa

        turn("token_files", chunks_of.cache_clear)
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("n_ids", pa.int64()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
        chunks, end = chunks_of(tokenizer), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        width, shard = width_of(max(chunks.vocabulary, (end_id or 0) + 1)), TaskContext.get().partitionId()
        ids, data, n, block, start = [], [], 0, 0, 0

        def batch():
            sizes = [len(d) // 4 for d in data]
            row = [shard, block, width, n, start, ids, np.concatenate([[0], np.cumsum(sizes)]).tolist(), pack(np.frombuffer(b"".join(data), "<u4"), width)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for i, d in zip(b.column(key).to_pylist(), chunks.encode([t or "" for t in b.column(text).to_pylist()], end), strict=True):
                if ids and n + len(d) // 4 > BLOCK_IDS:
                    yield batch()
                    ids, data, n, block, start = [], [], 0, block + 1, start + n
                ids.append(i)
                data.append(d)
                n += len(d) // 4
        if ids:
            yield batch()

    bounded_batches(docs.sparkSession, 4096)  # the more words at once, the fewer calls
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text), F.col(text)]
    rows.repartitionByRange(partitions_for(docs, 32 << 20), *order[:2]).sortWithinPartitions(*order).mapInArrow(run, FILE_SCHEMA).write.parquet(folder)
    return folder


def read(spark, folder: str) -> DataFrame:
    """The blocks, with `start`: ids of all blocks before. One row per shard goes through the running sum."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    few = before.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    return blocks.join(F.broadcast(before) if few else before, "shard").withColumn("start", F.coalesce("base", F.lit(0)) + F.col("shard_start")).drop("base")


def documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], []]
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"])
                for i, x, y in zip(r["doc_ids"], r["offsets"], r["offsets"][1:]):
                    for column, v in zip(out, (i, r["start"] + x, y - x, zlib.crc32(ids[x:y].tobytes()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    bounded_batches(spark)
    return read(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def slice_of(spark, folder: str, start: int, count: int) -> np.ndarray:
    """`count` ids from place `start` of the whole stream: random access; only the blocks that hold them are read and unpacked."""
    rows = read(spark, folder).where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)).orderBy("start").collect()  # count bounds it
    parts = []
    for r in rows:
        a, b = max(start, r.start), min(start + count, r.start + r.n_ids)
        parts.append(unpack(bytes(r.payload), r.width, a - r.start, b - a))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs to files in the shared folder and describe each document from what is read back."""
    return documents(docs.sparkSession, write(docs, tokenizer, shared_folder(docs.sparkSession), end_id))
