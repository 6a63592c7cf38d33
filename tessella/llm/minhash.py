"""Near-duplicate groups: MinHash bands for candidates, odd sketches to sift them, full shingle sets to confirm links.

1. One narrow pass gives each text its set's size and 128-bit digest, BANDS band hashes of ROWS MinHash values each, and the odd sketch: the
   MinHash samples folded into a parity bitmap, whose XOR's population count estimates a high similarity. Texts with equal sets are one
   node from here on.
2. Nodes that vote for one head (the smallest node of a band they share) are confirmed against each other and it, in salted blocks.
3. Band buckets that still hold several components are compared block by block in numpy: nodes outside the bucket's main component
   against all. Nodes with a partner in another component whose sketch agrees are asked for, first with their closest partner only, then
   with every one. So no link between components is lost.
4. Blocks confirm on full sets over an inverted list, and give only links that join two of their components: fewer than the block has nodes, so
   what is made grows with the rows of a family and not with its pairs. A set is sent once per block.
5. Components come from alternating star contraction on confirmed links.

A pair at the similarity threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 1e-7, and its sketches send it away with about 1e-6.
Nothing is collected to the driver or into one task: buckets and heads are split by salt, in rows and bytes.

Defined cases: a null or empty text has no shingles, links with nothing and is kept; rows with one doc_id and different texts are compared each by its
own text; a null doc_id is never kept and has no component; a text with fewer words than a shingle is one shingle; a text of any length is one set; an
empty table gives an empty table; other columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BLANK_WORDS, bounded_batches, discard, mixed, odd_multipliers, shared_folder, shingles, texts_of, turn, written

BANDS, ROWS = 40, 5
#: Bits of an odd sketch, and the estimated similarity under which a pair isn't compared further (4 standard deviations below 0.8).
SKETCH_BITS, SKETCH_LEAST = 512, 0.66
#: Nodes and bytes of sets in a salted block of a bucket, about.
GROUP, BLOCK_BYTES = 1024, 6 << 20
#: Rows (about 100 bytes each) and blocks in them up to which a table of wanted nodes is broadcast; beyond it, Spark joins by shuffle.
BROADCAST_ROWS = 200_000

_A = (odd_multipliers(BANDS * ROWS, 0xA11CE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (odd_multipliers(BANDS * ROWS, 0xB0B) >> np.uint64(32)).astype(np.uint32)
_BAND = odd_multipliers(BANDS, 0xBAD)
_ROW = odd_multipliers(ROWS, 0xF00)


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        v = x[i : i + 2048, None] * _A
        v += _B
        np.minimum(out, v.min(0), out=out)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mixed((rows * _ROW).sum(1, dtype=np.uint64) * np.uint64(3) + _BAND).view(np.int64)


def sketch_of(sig: np.ndarray) -> bytes:
    at = mixed(sig.astype(np.uint64) + (np.arange(len(sig), dtype=np.uint64) << np.uint64(33))) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches."""
    share = np.minimum(1 - 2 * differing / SKETCH_BITS, 1)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(np.maximum(share, 1e-9))


def sets_of(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    for h in BLANK_WORDS.of(texts):
        yield shingles(h, k)


def fingerprints(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (long), mark (hash of the text), n_shingles, digest, sketch, bands of every row, in the shared folder."""

    def run(batches: Iterator):
        import pyarrow as pa

        turn("minhash")
        for b in batches:
            n, digest, sketch, bands, memo = [], [], [], [], {}
            for s in sets_of(texts_of(b, text), k):
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if d is not None and d not in memo:
                    sig = signature(s)
                    memo[d] = sketch_of(sig), bands_of(sig)
                digest.append(d)
                sketch.append(memo[d][0] if d else None)
                bands.append(memo[d][1] if d else None)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("__mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "mark", "n_shingles", "digest", "sketch", "bands"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), F.xxhash64(text).alias("__mark"))
    return written(rows.mapInArrow(run, "id long, mark long, n_shingles long, digest binary, sketch binary, bands array<bigint>"))


def _salts(n, shingles):
    """Blocks that a bucket of n nodes with so many shingles is cut into: GROUP nodes and BLOCK_BYTES bytes of sets each, about."""
    return F.ceil(F.greatest(n / GROUP, shingles * 8 / BLOCK_BYTES)).cast("int")


def _block(of):
    return F.struct(of.alias("band"), "salt")


def confirmed(docs: DataFrame, nodes: DataFrame, asked: DataFrame, k: int, percent: int, within: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b) between nodes of different roots that meet in a block: 100 * intersection >= percent * union of full sets.

    asked: block (struct), held, node, root. A block's held nodes are compared with its visitors and, if `within`, with each other, over an
    inverted list of the held sets. A union-find over roots keeps only links that join, so a block gives fewer links than it has nodes.
    Texts are read again only for asked nodes, and a set is sent once per block.
    """
    wanted = asked.groupBy("node", F.pmod(F.xxhash64("block"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("block", "held", "root")).alias("blocks"))
    wanted = written(wanted.join(nodes.select("node", "digest", "rep"), "node").select("node", "digest", "rep", "blocks"))
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and wanted.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0] <= 2 * BROADCAST_ROWS
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    joined = rows.join(F.broadcast(wanted) if small else wanted, F.col("id") == F.col("rep")).select("text", "node", "digest", "blocks")

    def send(batches: Iterator):
        import pyarrow as pa

        turn("minhash")
        for b in batches:
            for node, digest, s, blocks in zip(b.column("node").to_pylist(), b.column("digest").to_pylist(), sets_of(texts_of(b), k), b.column("blocks").to_pylist(), strict=True):
                data = s.tobytes()
                if xxhash.xxh3_128_digest(data) != digest:  # another text under the same id
                    continue
                each = max(1, min(64, (4 << 20) // max(len(data), 1)))
                for i in range(0, len(blocks), each):
                    part = blocks[i : i + each]
                    n = len(part)
                    columns = [[x["block"]["band"] for x in part], [x["block"]["salt"] for x in part], [not x["held"] for x in part], [node] * n, [x["root"] for x in part], [data] * n]
                    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["band", "salt", "visitor", "node", "root", "shingles"])

    def compare(batches: Iterator):
        import pyarrow as pa

        turn("minhash")
        block, at = None, None
        for b in batches:
            out: list[tuple[int, int]] = []
            for band, salt, visitor, node, root, data in zip(*[b.column(c).to_pylist() for c in ("band", "salt", "visitor", "node", "root", "shingles")]):
                if (band, salt) != at:
                    if block is not None and within:
                        out += block.inside()
                    block, at = Block(percent), (band, salt)
                s = np.frombuffer(data, np.uint64)
                if visitor:
                    out += block.meet(node, root, s)
                else:
                    block.hold(node, root, s)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if block is not None and within:
            out = block.inside()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(docs.sparkSession)
    sent = joined.mapInArrow(send, "band long, salt int, visitor boolean, node long, root long, shingles binary").repartition(n, "band", "salt")
    return written(sent.sortWithinPartitions("band", "salt", "visitor").mapInArrow(compare, "a long, b long").distinct())


class Block:
    """Sets held in memory (bounded by _salts) with an inverted list, and a union-find over their roots."""

    def __init__(self, percent: int):
        self.percent, self.nodes, self.roots, self.sets, self.parent, self.terms, self.known = percent, [], [], [], {}, None, set()

    def hold(self, node: int, root: int, s: np.ndarray) -> None:
        if node not in self.known:  # repeated rows
            self.known.add(node)
            self.nodes.append(node)
            self.roots.append(root)
            self.sets.append(s)

    def find(self, root: int) -> int:
        self.parent.setdefault(root, root)
        while self.parent[root] != root:
            self.parent[root] = root = self.parent[self.parent[root]]
        return root

    def _index(self) -> None:
        sizes = np.array([len(s) for s in self.sets], np.int64)
        everything = np.concatenate(self.sets)
        order = np.argsort(everything, kind="stable")
        self.terms, starts = np.unique(everything[order], return_index=True)
        self.starts = np.append(starts, len(everything))
        self.owners, self.sizes = np.repeat(np.arange(len(sizes)), sizes)[order], sizes

    def linked(self, s: np.ndarray, upto: int) -> np.ndarray:
        """Held sets before `upto` that are similar enough to s."""
        at = np.searchsorted(self.terms, s)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == s]
        begin, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        if not len(at):
            return at
        total = int(n.sum())
        rows = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        both = np.bincount(self.owners[rows], minlength=len(self.sizes))[:upto]
        return np.flatnonzero((both > 0) & (100 * both >= self.percent * (self.sizes[:upto] + len(s) - both)))

    def _join(self, node: int, root: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
        for j in found.tolist():
            x, y = self.find(root), self.find(self.roots[j])
            if x != y:
                self.parent[x] = y
                yield min(node, self.nodes[j]), max(node, self.nodes[j])

    def meet(self, node: int, root: int, s: np.ndarray) -> list[tuple[int, int]]:
        if not self.sets or not len(s):
            return []
        if self.terms is None:
            self._index()
        return list(self._join(node, root, self.linked(s, len(self.sets))))

    def inside(self) -> list[tuple[int, int]]:
        if len(set(self.roots)) < 2:
            return []
        self._index()
        return [x for i, s in enumerate(self.sets) for x in self._join(self.nodes[i], self.roots[i], self.linked(s, i))]


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v), u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the edges (a, b): the smallest node of its component. Large-star and small-star in turn until nothing changes."""
    spark, path, last = edges.sparkSession, None, None
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    while True:
        new_path = shared_folder(spark)
        e = written(_stars(e), new_path)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if path:
            discard(spark, path)
        path = new_path
        if state == last:
            break
        last = state
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _sifted(nodes: DataFrame, buckets: DataFrame, comp: DataFrame, closest: bool) -> DataFrame:
    """(block, held, node, root) of the nodes that have to be confirmed in a block: those with a partner in another component whose sketch agrees.

    In each bucket, nodes outside the component of its head meet all nodes, in salted blocks of about GROUP rows, and a pair counts in the
    first band that both have. With `closest`, they meet their own block only and ask for the closest partner there: a cheap round that joins
    most of what belongs together. A block gives at most one row for each node that came into it.
    """
    spark = nodes.sparkSession
    rows = buckets.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), _salts(F.count("*"), F.sum("n_shingles")).alias("salts"), F.min_by("root", "node").alias("main"))
    per = per.where("low < high").select("band", "main", "salts")
    rows = rows.join(per, "band").select("band", "salts", "main", "node", "root").join(nodes.select("node", "sketch", "bands"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    major = F.col("root") == F.col("main")
    fields = ("node", "root", "sketch", "bands")
    base = rows.select("band", own.alias("salt"), F.lit(False).alias("visitor"), major.alias("major"), *fields)
    where = F.array(own) if closest else F.sequence(F.lit(0), F.col("salts") - 1)
    minor = rows.where(~major).select("band", F.explode(where).alias("salt"), F.lit(True).alias("visitor"), F.lit(False).alias("major"), *fields)

    def meet(batches: Iterator):
        import pyarrow as pa

        names = ["band", "salt", "held", "node", "root"]
        at, held, asked = None, [], None
        block: tuple = ()

        def rest(out):
            if asked is not None:
                out += [(*at, True, held[j][0], held[j][1]) for j in np.flatnonzero(asked).tolist()]

        def packed(out):
            columns = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))], names=names)

        for b in batches:
            out: list[tuple] = []
            bands = b.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            for k, (band, salt, visitor, major, node, root, sketch) in enumerate(zip(*[b.column(c).to_pylist() for c in ("band", "salt", "visitor", "major", "node", "root", "sketch")])):
                if (band, salt) != at:
                    rest(out)
                    at, held, asked = (band, salt), [], None
                if not visitor:  # about GROUP rows come first
                    held.append((node, root, major, sketch, bands[k].copy()))
                    continue
                if asked is None:
                    asked = np.zeros(len(held), bool)
                    number: dict[int, int] = {}
                    block = np.array([number.setdefault(h[1], len(number)) for h in held]), np.array([h[2] for h in held], bool), np.frombuffer(b"".join(h[3] for h in held), np.uint64).reshape(len(held), -1), np.array([h[4] for h in held], np.int64).reshape(len(held), -1)
                close = estimate(np.bitwise_count(block[2] ^ np.frombuffer(sketch, np.uint64)).sum(1, dtype=np.int64)) if len(held) else np.zeros(0)
                near = np.flatnonzero((close >= SKETCH_LEAST) & (block[0] != number.get(root, -1)))
                if closest:
                    near = near[np.argsort(-close[near], kind="stable")[:1]]
                else:  # of two visitors, each meets the other: the larger one asks
                    near = near[[block[1][j] or held[j][0] < node for j in near.tolist()]] if len(near) else near
                    near = near[bands[k][np.argmax(block[3][near] == bands[k], axis=1)] == band] if len(near) else near
                if len(near):
                    asked[near] = True
                    out.append((band, salt, False, node, root))
            yield packed(out)
        out = []
        rest(out)
        yield packed(out)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark)
    dealt = base.unionByName(minor).repartition(n, "band", "salt").sortWithinPartitions("band", "salt", "visitor")
    found = dealt.mapInArrow(meet, "band long, salt int, held boolean, node long, root long")
    return written(found.select(_block(F.col("band")).alias("block"), "held", "node", "root"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark, n_shingles, component_id, kept of every row (module docstring)."""
    prints = fingerprints(docs, k, key, text)
    some = prints.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    least = some.groupBy("digest").agg(F.min_by(F.struct("id", "n_shingles", "sketch", "bands"), "id").alias("x"), F.count("*").alias("n"))
    found = written(least.select("digest", F.col("x.id").alias("rep"), "x.n_shingles", "x.sketch", "x.bands", (F.col("n") > 1).alias("twins")))
    # A node's number is its smallest id, or a hash of its digest where that id has several texts.
    several = written(found.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("__several")))
    nodes = found.withColumn("node", F.col("rep"))
    if not several.isEmpty():
        nodes = written(found.join(several, F.col("rep") == F.col("__several"), "left").withColumn("node", F.when(F.col("__several").isNull(), F.col("rep")).otherwise(F.xxhash64("digest"))).drop("__several"))
    exploded = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    heads = written(exploded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head"))
    buckets = written(exploded.join(heads, "band"))  # only what shares a band with others
    votes = buckets.where("node <> head").groupBy("node", "head", "n_shingles").agg(F.count("*").alias("n"))
    first = written(votes.groupBy("node", "n_shingles").agg(F.max_by("head", F.col("n")).alias("head")))
    per = first.groupBy("head").agg(_salts(F.count("*"), F.sum("n_shingles")).alias("salts"))
    voters = first.join(per, "head").select("head", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    led = per.select("head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("head").alias("node"))
    asked = voters.unionByName(led).select(_block(F.col("head")).alias("block"), F.lit(True).alias("held"), "node", F.col("node").alias("root"))
    links = confirmed(docs, nodes, asked, k, percent, True, key, text)
    comp = written(components(links))
    for closest in (True, False):  # closest partners, then every pair that is left
        asked = _sifted(nodes, buckets.select("band", "node", "n_shingles"), comp, closest)
        if asked.isEmpty():
            if closest:
                continue
            break
        more = confirmed(docs, nodes, asked, k, percent, False, key, text)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = written(components(links))
    label = comp.withColumnRenamed("id", "node").join(nodes.select("node", "digest", "rep"), "node")
    lowest = label.groupBy("root").agg(F.min("rep").alias("low"))
    linked = written(label.join(lowest, "root").select("digest", F.col("low").alias("component")))
    twins = nodes.where("twins").select("digest", F.col("rep").alias("component")).join(linked.select("digest"), "digest", "left_anti")
    joined = prints.select("id", "mark", "n_shingles", "digest").join(twins.unionByName(linked), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select("id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that groups() doesn't keep, but with those that have no id. Only (id, hash of the text) of dropped rows are joined, so
    that rows with one id and different texts are told apart."""
    gone = written(groups(docs, k, percent, key, text).where(~F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias("__gone"), F.col("mark").alias("__mark")).distinct())
    small = gone.limit(2_000_001).count() <= 2_000_000
    return docs.join(F.broadcast(gone) if small else gone, (F.col(key).cast("long") == F.col("__gone")) & (F.xxhash64(text) == F.col("__mark")), "left_anti")
