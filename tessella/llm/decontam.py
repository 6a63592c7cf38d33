"""Benchmark decontamination over a distributed positional inverted index.

Training documents are cut into segments; each segment is one stored row: its documents, its terms (sorted 64-bit word hashes), and for each
term the sorted positions of its tokens in the segment. Documents lie at a distance in that numbering, so no phrase crosses a border.
A test window is looked up by its rarest term in the segment; the offset-adjusted lists of the other terms, rarest first, are intersected with it.
`slop` > 0 also gives proximity matches: the window's words in order, with up to `slop` other words between them in all. One of slop + 1 parts of
such a window stands unbroken, so the parts are looked up first, and the rest is sought around them.

Test items go to the segments in blocks of bounded size, so neither side has to be small.
Defined cases: null texts have no words; items without words match nothing; an item shorter than a window is one window; rows with the
same doc_id are separate documents, each reported; equal items each report, those of one item_id as one; items without an id aren't sought; very
long documents are segments of their own; an empty table of documents gives no rows, one of items no hits; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Words, bounded_batches, texts_of, turn, written

#: Separators of words are the ASCII characters outside 0-9, A-Z, a-z; A-Z is lowered.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 10
#: Words between those of a window in a proximity match, in all.
SLOP = 1
#: Tokens in a segment, about; and words of test items in a block.
SEGMENT_TOKENS = 1 << 17
BLOCK_WORDS = 1 << 20
#: Free positions between documents, more than any slop.
GAP = 64

INDEX_SCHEMA = "segment long, docs binary, marks binary, sizes binary, terms binary, starts binary, positions binary"


WORDS = Words(TO_WORDS)


def _segment(ids: list[int | None], marks: list[int], hashes: list[np.ndarray]) -> dict[str, bytes]:
    sizes = np.array([len(h) for h in hashes], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]])
    tokens = np.concatenate(hashes)
    where = (np.arange(len(tokens)) + np.repeat(base - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)).astype(np.uint32)
    order = np.argsort(tokens, kind="stable")
    terms, starts = np.unique(tokens[order], return_index=True)
    known = np.array([i is not None for i in ids])
    return {
        "docs": np.array([i if i is not None else 0 for i in ids], np.int64).tobytes() + known.tobytes(),
        "marks": np.array(marks, np.int64).tobytes(),
        "sizes": sizes.tobytes(),
        "terms": terms.tobytes(),
        "starts": np.append(starts, len(tokens)).astype(np.uint32).tobytes(),
        "positions": where[order].tobytes(),
    }


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment, in the shared folder. Narrow: no shuffle."""

    def run(batches: Iterator):
        import pyarrow as pa

        turn("decontam")
        ids, marks, hashes, n = [], [], [], 0
        names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
        numbers = count(TaskContext.get().partitionId() << 32)  # of the segments: the same when a task runs again

        def batch():
            row = _segment(ids, marks, hashes)
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *[pa.array([row[c]], pa.binary()) for c in names[1:]]], names=names)

        for b in batches:
            for i, mark, h in zip(b.column(key).to_pylist(), b.column("__mark").to_pylist(), WORDS.of(texts_of(b, text)), strict=True):
                if ids and n + len(h) > SEGMENT_TOKENS:
                    yield batch()
                    ids, marks, hashes, n = [], [], [], 0
                ids.append(i)
                marks.append(mark)
                hashes.append(h)
                n += len(h) + GAP
        if ids:
            yield batch()

    bounded_batches(docs.sparkSession)
    return written(docs.select(F.col(key).cast("long").alias(key), text, F.xxhash64(text).alias("__mark")).mapInArrow(run, INDEX_SCHEMA))


class Segment:
    """A segment's postings for lookups."""

    def __init__(self, row: dict[str, bytes]):
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        n = len(self.sizes)
        self.ids = np.frombuffer(row["docs"][: 8 * n], np.int64)
        self.known = np.frombuffer(row["docs"][8 * n :], bool)
        self.marks = np.frombuffer(row["marks"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.sizes + GAP)[:-1]]).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        self.sizes_of = np.diff(self.starts)
        self.positions = np.frombuffer(row["positions"], np.uint32)
        self.length = int(self.base[-1] + self.sizes[-1] + GAP) if n else 0

    def postings(self, at: int) -> np.ndarray:
        return self.positions[self.starts[at] : self.starts[at + 1]]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of hashes, -1 if absent."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1) if len(self.terms) else np.full(len(words), -1)

    def phrase(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Starts of exact occurrences of a window of present terms: lists intersected from the rarest on."""
        order = np.argsort(counts, kind="stable")
        found = self.postings(terms[order[0]]).astype(np.int64) - order[0]
        found = found[found >= 0]
        for k in order[1:]:
            if not len(found):
                break
            p = self.postings(terms[k])
            if len(p) < 8 * len(found):
                found = found[np.isin(found + k, p, assume_unique=True)]
            else:
                at = np.searchsorted(p, (found + k).astype(np.uint32))
                at[at == len(p)] = 0
                found = found[p[at] == found + k]
        return found

    def near(self, terms: np.ndarray, starts: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences that may begin at `starts`: (starts, ends) of those with the terms in order and up to slop other words between; the earliest ends."""
        first = self.postings(terms[0])
        starts = np.unique(starts)
        at = np.minimum(np.searchsorted(first, starts), len(first) - 1)
        begin = starts[first[at] == starts]
        last = begin.copy()
        for k in range(1, len(terms)):
            p = np.append(self.postings(terms[k]).astype(np.int64), 1 << 40)
            last = p[np.searchsorted(p, last, side="right")]
            fine = last - begin <= k + slop
            begin, last = begin[fine], last[fine]
            if not len(begin):
                break
        return begin, last + 1

    def search(self, items: list[tuple[int, np.ndarray]], window: int, slop: int = 0) -> tuple[np.ndarray, set[tuple[int, int]], set[tuple[int, int]]]:
        """Hit positions as a mask over the segment, (document number, item) pairs, and those with a proximity match."""
        edges = np.zeros(self.length + 1, np.int32)
        pairs: set[tuple[int, int]] = set()
        close: set[tuple[int, int]] = set()
        documents = lambda begins: np.unique(np.searchsorted(self.base, begins, side="right") - 1).tolist()
        for item, words in items:
            terms = self.numbers(words)
            counts = np.where(terms >= 0, self.sizes_of[terms], 0) if len(self.terms) else np.zeros(len(terms), np.int64)
            width = min(window, len(words))
            absent = np.concatenate([[0], np.cumsum(terms < 0)])
            cuts = [width * k // (slop + 1) for k in range(slop + 2)]  # parts of a window, one of which stands unbroken
            memo: dict[tuple[int, int], np.ndarray] = {}

            def part(x: int, y: int) -> np.ndarray:
                if (x, y) not in memo:
                    memo[x, y] = self.phrase(terms[x:y], counts[x:y])
                return memo[x, y]

            for s in np.flatnonzero(absent[width:] == absent[:-width]).tolist():
                found = [part(s + x, s + y) for x, y in zip(cuts, cuts[1:]) if x < y]
                if not any(map(len, found)):
                    continue
                begins = found[0] if slop == 0 else self.phrase(terms[s : s + width], counts[s : s + width]) if all(map(len, found)) else found[0][:0]
                if len(begins):
                    np.add.at(edges, begins, 1)
                    np.add.at(edges, begins + width, -1)
                    pairs.update((d, item) for d in documents(begins))
                if slop:
                    maybe = np.concatenate([f - x - d for f, x in zip(found, [x for x, y in zip(cuts, cuts[1:]) if x < y]) for d in range(slop + 1)])
                    loose, _ = self.near(terms[s : s + width], maybe[maybe >= 0], slop)
                    if len(loose):
                        close.update((d, item) for d in documents(loose))
        return (np.cumsum(edges)[:-1] > 0 if self.length else np.zeros(0, bool)), pairs, close


def _searcher(items: list[tuple[int, np.ndarray]], window: int, slop: int):
    def run(batches: Iterator):
        import pyarrow as pa

        turn("decontam")
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(row)
                mask, pairs, close = seg.search(items, window, slop)
                of: dict[int, list[int]] = {}
                near: dict[int, list[int]] = {}
                for by, found in ((of, pairs), (near, close)):
                    for d, item in found:
                        by.setdefault(d, []).append(item)
                out = {"segment": [row["segment"]] * len(seg.sizes), "number": range(len(seg.sizes)), "doc_id": [i if k else None for i, k in zip(seg.ids.tolist(), seg.known.tolist())], "mark": seg.marks, "n_words": seg.sizes.tolist()}
                out["hits"] = [np.packbits(mask[o : o + n]).tobytes() if d in of else b"" for d, (o, n) in enumerate(zip(seg.base.tolist(), seg.sizes.tolist()))]
                out["items"] = [sorted(of.get(d, ())) for d in range(len(seg.sizes))]
                out["near"] = [sorted(near.get(d, ())) for d in range(len(seg.sizes))]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("segment", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))]))

    return run


FOUND_SCHEMA = "segment long, number int, doc_id long, mark long, n_words long, hits binary, items array<bigint>, near array<bigint>"


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' word hashes in blocks of about BLOCK_WORDS words, streamed to the driver one partition at a time."""
    block, n = [], 0
    for r in items.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull()).toLocalIterator():
        (h,) = WORDS.of([(r.t or "").encode()])
        if len(h):
            block.append((r.i, h))
            n += len(h)
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def find(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per indexed document: segment, number, doc_id, n_words, hits (bits of hit words), items (sorted distinct ids), near (those with a proximity match)."""
    spark = index.sparkSession
    bounded_batches(spark)  # a segment is one row of some MB, so few come at once
    parts = [index.mapInArrow(_searcher(block, window, slop), FOUND_SCHEMA) for block in item_blocks(items, key, text)]
    if not parts:
        return index.mapInArrow(_searcher([], window, slop), FOUND_SCHEMA)
    if len(parts) == 1:
        return parts[0]
    tables = [written(p) for p in parts]  # one block's result at a time
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)

    def merge(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            hits = []
            for r in rows:
                acc = np.zeros((r["n_words"] + 7) // 8, np.uint8)
                for h in r["all_hits"]:
                    if h:
                        acc |= np.frombuffer(h, np.uint8)
                hits.append(acc.tobytes() if acc.any() else b"")
            names = ["segment", "number", "doc_id", "mark", "n_words"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(hits, pa.binary()), b.column("items"), b.column("near")], names=[*names, "hits", "items", "near"])

    return (
        both.groupBy("segment", "number")  # as many rows as blocks
        .agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("all_hits"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")])
        .mapInArrow(merge, FOUND_SCHEMA)
    )


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near (items with a window in order and up to slop words between) of every document."""
    found = find(build_index(docs), items, window=window, slop=slop)
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(_bits(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "items",
        "near",
    )


def _bits(hits):
    """Set bits of a binary value: its hex digits by their number of ones (fixed values)."""
    h = F.hex(hits)
    ones = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    return sum((n * F.length(F.regexp_replace(h, f"[^{digits}]", "")) for n, digits in ones.items()), F.lit(0))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose text contains a window of an item. Only (id, hash of the text) of contaminated rows are joined, so that rows
    without an id and rows of one id with different texts are told apart."""
    bad = written(find(build_index(docs, key), items, window=window).where(F.size("items") > 0).select(F.col("doc_id").alias("__bad"), F.col("mark").alias("__mark")).distinct())
    if bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, (F.xxhash64("text") == F.col("__mark")) & F.col(key).cast("long").eqNullSafe(F.col("__bad")), "left_anti")


#: Ids (16 bytes each, with the hashes) up to this many are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_IDS = 2_000_000
