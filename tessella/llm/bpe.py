"""Byte-level BPE by per-prefix dynamic programming.

A sequence of tokens is what the merges give exactly when every neighbouring pair is what the merges give for
the pair alone. So for each prefix of a piece there is one last token: among the vocabulary's matches that end there (found by an
automaton with suffix links), the one compatible with the last token of the prefix it leaves. Back-pointers from the whole piece
give the ids. No merge loop runs, and time is linear in the piece for a bounded token length.

Pieces come from the tokenizer file's own split pattern; they and their ids are memoised per worker, within bounds.
Defined cases: null is encoded as the empty text (no ids); ids out of the vocabulary raise KeyError on decoding; invalid
UTF-8 after decoding becomes U+FFFD; special tokens in a text are taken as such, as the file's library does by default. A text of any
length is encoded whole, repeated rows each, an empty table gives an empty table; `encoded` and `decoded` pass other columns through and replace one
that has the name of theirs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from tessella.llm.common import MEMO_ENTRIES, bounded_batches, texts_of, turn


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a printable Latin-1 byte stands for itself, the rest for U+0100 onwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Marks after which a word's letters end for sure, and white space but for spaces and newlines.
TAIL = "!#$%&*+,-./:;<=>?@|"
ODD_BLANKS = re.compile(r"[^\S \n]")


#: Words a worker keeps with their ids.
WORD_ENTRIES = 200_000
#: Documents handed to a worker at once.
BATCH_DOCS = 128
#: Words that go through the rows of the dynamic programme together.
ROWS_AT_ONCE = 8192


class Memo(dict):
    """key -> make(key), for keys of up to 48 characters, emptied when full (`most` entries)."""

    def __init__(self, make, most: int = MEMO_ENTRIES):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def packed(ids) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return np.array(ids, "<i4").tobytes()


class SuffixMatches:
    """Automaton with suffix links over the vocabulary: step[state << 8 | byte] and, for each state, the tokens that end there, longest first."""

    def __init__(self, tokens: dict[bytes, int]):
        self.size = {i: len(b) for b, i in tokens.items()}
        child: dict[int, int] = {}  # state << 8 | byte
        ends: list[int] = [-1]
        depth_order: list[list[tuple[int, int, int]]] = []
        for word, token in tokens.items():
            state = 0
            for depth, byte in enumerate(word):
                after = child.get(state << 8 | byte)
                if after is None:
                    after = child[state << 8 | byte] = len(ends)
                    ends.append(-1)
                    while len(depth_order) <= depth:
                        depth_order.append([])
                    depth_order[depth].append((state, byte, after))
                state = after
            ends[state] = token
        link = [0] * len(ends)
        self.matches: list[tuple[tuple[int, int], ...]] = [()] * len(ends)
        for depth, level in enumerate(depth_order):
            for state, byte, after in level:
                if state:
                    s = link[state]
                    while s and s << 8 | byte not in child:
                        s = link[s]
                    link[after] = child.get(s << 8 | byte, 0)
                own = ((depth + 1, ends[after]),) if ends[after] >= 0 else ()
                self.matches[after] = own + self.matches[link[after]]
        self.step = Steps(child, link)


class Steps(dict):
    """state << 8 | byte -> state; the ways over suffix links are filled in on demand."""

    def __init__(self, child: dict[int, int], link: list[int]):
        super().__init__(child)
        self.link = link

    def __missing__(self, key: int) -> int:
        state, byte = key >> 8, key & 255
        after = self[self.link[state] << 8 | byte] if state else 0
        if len(self) < 1_000_000:
            self[key] = after
        return after


#: Base of the rolling hash over bytes, and its powers.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
HASH_POWERS = np.cumprod(np.array([1] + [int(HASH_BASE)] * 64, np.uint64), dtype=np.uint64)


class TokenTable:
    """Token of a rolling hash: a direct-mapped numpy table, and a sorted list for those that met in a slot."""

    BITS = 18

    def __init__(self, tokens: dict[bytes, int]):
        short = {b: i for b, i in tokens.items() if len(b) <= 25}
        self.longest = max(map(len, short))
        keys = np.array([self.of(b) for b in short], np.uint64)
        ids = np.array(list(short.values()), np.int64)
        self.keys, self.ids = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        slot = self.slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.ids[slot[first]] = keys[first], ids[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_ids = np.append(keys[rest], ~np.uint64(0)), np.append(ids[rest], -1)
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[slot[rest]] = True

    @staticmethod
    def of(data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(HASH_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h ^ len(data)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Ids of the tokens of these hashes and this length, or -1."""
        keys = hashes ^ np.uint64(length)
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.ids[slot], -1).astype(np.int64)
        again = np.flatnonzero((out < 0) & self.shared[slot])
        if len(again):
            at = np.searchsorted(self.more_keys, keys[again])
            out[again] = np.where(self.more_keys[at] == keys[again], self.more_ids[at], -1)
        return out


class ByteBPE:
    """Encoder and decoder for a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items() if s not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = to_bytes(a), to_bytes(b)
            x, y = self.ids[a], self.ids[b]
            self.rank[x, y] = r
            self.parts.setdefault(self.ids[a + b], (r, x, y))
        from public_tokenizers import PATTERN  # the split of the byte-level files

        self.tokens = SuffixMatches({b: i for b, i in self.ids.items() if self.reachable(i)})
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.blanks = regex.compile(r"\s*\S+|\s+")
        self.pairs: dict[int, bool] = {}
        self.forget()
        self.chunks = Memo(self.chunk)
        self.words = Memo(self.word, WORD_ENTRIES)
        self.table = TokenTable({b: i for b, i in self.ids.items() if i in self.tokens.size})
        self.sizes, self.starts = np.zeros(max(self.bytes_of) + 2, np.int64), np.zeros(max(self.bytes_of) + 2, np.int64)
        for i, n in self.tokens.size.items():
            self.sizes[i] = n
        self.starts[1:] = np.cumsum(self.sizes)[:-1]
        #: Bytes of all tokens in the order of ids.
        self.blob = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.tokens.size)), np.uint8)
        self.pair_keys, self.pair_fits = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, bool)

    def reachable(self, token: int) -> bool:
        """Whether the merges give this token for its own bytes: its two parts are compatible up to its own merge."""
        if token not in self.parts:
            return True
        r, x, y = self.parts[token]
        return self.reachable_parts(x, y, r)

    def reachable_parts(self, x: int, y: int, before: int) -> bool:
        return self._first_crossing(x, y) >= before and self.reachable(x) and self.reachable(y)

    def _first_crossing(self, left: int, right: int) -> int:
        """Rank of the earliest merge over the border between two finished tokens, or a rank past all if none comes in time.

        Undo the merges of both sides from the last to the first. Between two undone merges the tokens at the border are fixed,
        and a merge over the border happens there if its rank is below that of the merge that would next have changed an edge.
        """
        none = len(self.rank)
        limit, crossing = none, none
        while True:
            r = self.rank.get((left, right), none)
            if r < limit:
                crossing = r
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return crossing
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            elif a is None or b[0] > a[0]:
                limit, right = b[0] + 1, b[1]
            else:  # the same merge on both sides: the left one is applied first
                limit, right = b[0] + 1, b[1]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self._first_crossing(left, right) == len(self.rank)
        return known

    def last_token(self, state: int, end: int, last_at) -> int:
        """The one token that can be last for the prefix of `end` bytes; last_at(i) is that of the prefix of i bytes."""
        pairs = self.pairs
        for length, token in self.tokens.matches[state]:
            if length == end:
                return token
            before = last_at(end - length)
            if before >= 0:
                fits = pairs.get(before << 32 | token)
                if fits if fits is not None else self.compatible(before, token):
                    return token
        return -1

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the split: a row (automaton state, last token) per prefix, then the back-pointers.

        Rows of short pieces live in a trie, since words share prefixes; a long piece has its own.
        """
        n, step, size, out = len(data), self.tokens.step, self.tokens.size, []
        if n > 48:
            last, state = [-1] * (n + 1), 0
            for end in range(1, n + 1):
                state = step[state << 8 | data[end - 1]]
                last[end] = self.last_token(state, end, last.__getitem__)
            while n:
                out.append(last[n])
                n -= size[last[n]]
        else:
            if len(self.states) > MEMO_ENTRIES:
                self.forget()
            child, last, node, path = self.child, self.last, 0, [0]
            for end, byte in enumerate(data, 1):
                key = node << 8 | byte
                node = child.get(key, 0)
                if not node:
                    state = step[self.states[path[-1]] << 8 | byte]
                    node = child[key] = len(last)
                    last.append(self.last_token(state, end, lambda i: last[path[i]]))
                    self.states.append(state)
                path.append(node)
            while n:
                token = last[path[n]]
                out.append(token)
                n -= size[token]
        out.reverse()
        return out

    def forget(self) -> None:
        """Start the trie anew."""
        self.child: dict[int, int] = {}
        self.states, self.last = [0], [-1]

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a run of white space and the run of other characters after it; the split never joins over its ends."""
        body = text[1:] if text[:1] == " " else text
        stem = body.rstrip(TAIL)
        if stem.isalpha() and max(stem) < "\u0250":  # one run of letters, then one of marks
            ids = tuple(self.piece(text[: len(text) - len(body) + len(stem)].encode()))
            return ids + self.chunks[body[len(stem) :]] if len(stem) < len(body) else ids
        return tuple(chain.from_iterable(self.piece(p.encode()) for p in self.split.findall(text)))

    def keys(self, text: str) -> list[str] | None:
        """The chunks of a text, named by what follows their space or newline; None if it needs the general split."""
        if "  " in text or ODD_BLANKS.search(text):
            return None
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words and (k or len(words) > 1):
                return None
            if k:
                words[0] = "\n" + words[0]
            elif words[0]:
                words[0] = "\0" + words[0]
            else:
                continue
            out += words
        return out

    def word(self, key: str) -> bytes:
        """Packed ids of a chunk as keys() names it: the first of a text and those after a newline are marked, the rest follow a space."""
        return packed(self.chunk(key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key))

    def learn(self, words: set[str]) -> None:
        """Ids of many words at once: letters with marks behind go through the rows of the dynamic programme together."""
        plain: dict[bytes, None] = {}
        parts: list[tuple[str, bytes, str]] = []
        for w in words:
            stem = w.rstrip(TAIL)
            if len(w) <= 24 and stem.isalpha() and max(stem) < "\u0250":
                data = b" " + stem.encode()
                plain[data] = None
                parts.append((w, data, w[len(stem) :]))
        ids: dict[bytes, bytes] = {}
        pieces = sorted(plain, key=len, reverse=True)
        for k in range(0, len(pieces), ROWS_AT_ONCE):
            ids.update(zip(pieces[k : k + ROWS_AT_ONCE], self.pieces_of(pieces[k : k + ROWS_AT_ONCE]), strict=True))
        tails = {tail: packed(self.chunks[tail]) for tail in {tail for _, _, tail in parts} if tail}
        memo = self.words
        for w, data, tail in parts:
            memo[w] = ids[data] + tails[tail] if tail else ids[data]

    def pieces_of(self, pieces: list[bytes]) -> list[bytes]:
        """Packed piece() of many short pieces, longest first: one numpy step per prefix length and token length."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes[0])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        prefix = np.zeros((width + 1, len(pieces)), np.uint64)
        last = np.full((width + 1, len(pieces)), -1, np.int64)
        for end in range(1, width + 1):
            n = int(np.searchsorted(-sizes, -end, side="right"))  # pieces at least this long
            prefix[end, :n] = prefix[end - 1, :n] * HASH_BASE + (data[:n, end - 1].astype(np.uint64) + np.uint64(1))
            open_rows = np.arange(n)
            for length in sorted(range(1, min(end, self.table.longest) + 1), key=lambda x: abs(x - 3)):  # any order: there is one
                tokens = self.table.find(prefix[end, open_rows] - prefix[end - length, open_rows] * HASH_POWERS[length], length)
                hit = np.flatnonzero(tokens >= 0)
                if not len(hit):
                    continue
                rows, tokens = open_rows[hit], tokens[hit]
                if length < end:
                    before = last[end - length, rows]
                    fits = (before >= 0) & self.fitting(np.maximum(before, 0), tokens)
                    rows, tokens = rows[fits], tokens[fits]
                last[end, rows] = tokens
                open_rows = open_rows[last[end, open_rows] < 0]
                if not len(open_rows):
                    break
        at, columns, lines = sizes.copy(), [], np.arange(len(pieces))
        while at.any():
            token = np.where(at > 0, last[at, lines], -1)
            at = np.where(token < 0, 0, at)  # a prefix that only a token outside the table can end
            columns.append(token)
            at -= np.where(at > 0, self.sizes[token], 0)
        rows = np.stack(columns[::-1], 1)
        tokens, ends = rows[rows >= 0], np.cumsum((rows >= 0).sum(1)).tolist()
        # Hashes name the matches; bytes prove them. What fails goes through the automaton.
        proved = self.proved(tokens, np.array(ends), data, sizes).tolist()
        ids, begins = tokens.astype("<i4").tobytes(), [0, *ends]
        return [ids[4 * i : 4 * j] if ok else packed(self.piece(p)) for p, i, j, ok in zip(pieces, begins, ends, proved)]

    def spelled(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of these tokens, one after the other."""
        sizes = self.sizes[tokens]
        return self.blob[np.repeat(self.starts[tokens] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]

    def proved(self, tokens: np.ndarray, ends: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each row's tokens (up to its end in `tokens`) spell the first `size` bytes of its row of data."""
        total = np.concatenate([[0], np.cumsum(self.sizes[tokens])])[np.concatenate([[0], ends])]
        length = np.diff(total)
        good = length == sizes
        wanted = data[(np.arange(data.shape[1]) < sizes[:, None]) & good[:, None]]
        wrong = self.spelled(tokens)[np.repeat(good, length)] != wanted
        good[np.repeat(np.flatnonzero(good), sizes[good])[wrong]] = False
        return good

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, over a direct-mapped cache."""
        key = left << 32 | right
        slot = ((left * 0x9E3779B1 ^ right * 0x85EBCA6B) >> 7) & (len(self.pair_keys) - 1)
        strange = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_fits[slot]
        if len(strange):
            unknown, back = np.unique(key[strange], return_inverse=True)
            known = np.array([self.compatible(k >> 32, k & 0xFFFFFFFF) for k in unknown.tolist()], bool)
            out[strange] = known[back]
            self.pair_keys[slot[strange]], self.pair_fits[slot[strange]] = key[strange], known[back]
            # two new keys of one slot: the last write holds for both arrays, since it is the same index order
        return out

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """encode() of each text, after learning the words of all of them."""
        return (np.frombuffer(x, "<i4").tolist() for x in self.packed_many(texts))

    def packed_many(self, texts: list[str]) -> Iterator[bytes]:
        """encode_many() with the ids of a text as little-endian 32-bit numbers."""
        special = lambda t: self.special_split is not None and any(s in t for s in self.specials)
        keys = [None if special(t) else self.keys(t) for t in texts]
        new: set[str] = set()
        for k in keys:
            if k is not None:
                new.update([w for w in k if w not in self.words])
        if len(self.words) + len(new) > WORD_ENTRIES:
            self.words.clear()
        self.learn(new)
        for t, k in zip(texts, keys, strict=True):
            yield packed(self.encode(t)) if k is None else b"".join(map(self.words.__getitem__, k))

    def encode(self, text: str) -> list[int]:
        general = lambda t: chain.from_iterable(map(self.chunks.__getitem__, self.blanks.findall(t)))
        if self.special_split is not None and any(s in text for s in self.specials):
            out: list[int] = []
            for k, part in enumerate(self.special_split.split(text)):
                out += [self.specials[part]] if k % 2 else general(part)
            return out
        keys = self.keys(text)
        return list(general(text)) if keys is None else np.frombuffer(b"".join(map(self.words.__getitem__, keys)), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def _digests(path: str):
    def run(batches: Iterator):
        import pyarrow as pa

        turn("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_many([t.decode() for t in texts_of(b)]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; one narrow pass."""
    bounded_batches(docs.sparkSession, BATCH_DOCS)
    return docs.select("doc_id", "text").mapInArrow(_digests(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the array of token ids of every text."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    bounded_batches(docs.sparkSession, BATCH_DOCS)
    schema = StructType([f for f in docs.schema if f.name != ids]).add(ids, ArrayType(IntegerType()))
    keep = [f.name for f in docs.schema if f.name != ids]

    def run(batches):
        import pyarrow as pa

        turn("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for b in batches:
            rows = list(bpe.packed_many([t.decode() for t in texts_of(b, text)]))
            borders = np.cumsum([0, *[len(x) // 4 for x in rows]]).astype(np.int32)
            got = pa.ListArray.from_arrays(borders, pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], got], names=[*keep, ids])

    return docs.mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """tokens with the text of every id array (null: empty)."""
    from pyspark.sql.types import StringType, StructType

    bounded_batches(tokens.sparkSession, BATCH_DOCS)
    schema = StructType([f for f in tokens.schema if f.name != text]).add(text, StringType())
    keep = [f.name for f in tokens.schema if f.name != text]

    def run(batches):
        import pyarrow as pa

        turn("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for b in batches:
            got = pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], got], names=[*keep, text])

    return tokens.mapInArrow(run, schema)
