"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with inline tags dropped in place. Each block is a vector: its tag path
(names and words of class, id and role, hashed), its words (hashed), and a few counts. A bidirectional LSTM in numpy reads the page's
blocks in order, so each is judged by its place in the whole page, and labels it main or not. It is trained on pages that this
module makes up from random words and many templates; the pages to extract from are never learned from.

Scripts, styles, comments, titles and other markup are never blocks. Character references are decoded, white space inside a block becomes one space.
Defined cases: null and empty html give the empty text; unclosed and stray tags are tolerated (a closing tag ends the nearest
open one of its name, or nothing; an element without text that is never closed hides nothing, but script, style, iframe, textarea and title hide
the rest, as in browsers); text outside any tag is a block; a page of one block only may still be main.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tessella.llm.common import bounded_batches, texts_of

#: Tags whose content is no text, inline tags (they don't end a block), and tags without content.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of the silent ones, those whose content is raw text: where they aren't closed, all that follows is theirs.
RAW = frozenset("script style iframe textarea title".split())
#: A start tag of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(>?)|[!?][^>]*(?:>|$))", re.S)
ATTRIBUTES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CUT = re.compile(r"[^a-z]+")

PATH_BUCKETS, WORD_BUCKETS = 512, 1024
PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 16, 8, 6, 16


def path_feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) % PATH_BUCKETS


class Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.lower().encode()) % WORD_BUCKETS
        return h


@lru_cache(maxsize=50_000)
def tag_features(tag: str, attributes: str) -> tuple[int, ...]:
    names = [tag]
    for m in ATTRIBUTES.finditer(attributes):
        names += [f"{k}" for k in CUT.split((m[1] or m[2] or m[3] or "").lower()) if k]
    return tuple({path_feature(n if i else f"<{n}>") for i, n in enumerate(names)})


class Block:
    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: tuple[int, ...], linked: int, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


class Open:
    """The open tags, with what is asked about them kept up to date, so that a page of any depth is cut in linear time."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...], int]] = []  # name, features, place of the nearest tag that isn't inline
        self.names: Counter[str] = Counter()
        self.features: Counter[int] = Counter()
        self.path: tuple[int, ...] | None = ()

    def push(self, name: str, features: tuple[int, ...]) -> None:
        place = len(self.stack) if name not in INLINE else self.stack[-1][2] if self.stack else -1
        self.stack.append((name, features, place))
        self.names[name] += 1
        self.features.update(features)
        self.path = None

    def end(self, name: str) -> None:
        """Close the nearest tag of the name and all in it."""
        if not self.names[name]:
            return
        last = ""
        while last != name:
            last, features, _ = self.stack.pop()
            self.names[last] -= 1
            for f in features:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
        self.path = None

    def tag(self) -> str:
        """The nearest tag that isn't inline."""
        return self.stack[self.stack[-1][2]][0] if self.stack and self.stack[-1][2] >= 0 else ""

    def own(self) -> tuple[int, ...]:
        """Features of all open tags."""
        if self.path is None:
            self.path = tuple(sorted(self.features))
        return self.path


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks in order. Linear in the page."""
    out: list[Block] = []
    tags = Open()
    pieces: list[str] = []
    linked = 0
    silent_until: str | None = None
    at, last_end = 0, {}

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tags.own(), min(linked, len(text)), tags.tag()))
            pieces.clear()
        linked = 0

    def ends_after(name: str, place: int) -> bool:
        """Whether something behind the place closes a silent element."""
        if name not in last_end:
            found = re.compile(rf"</{name}(?![a-z0-9:-])" + ("|<body(?![a-z0-9:-])" if name in ("head", "svg", "math") else ""), re.I)
            last_end[name] = max((m.start() for m in found.finditer(page)), default=-1)
        return last_end[name] >= place

    for m in TAG.finditer(page):
        if silent_until is None and m.start() > at:
            piece = page[at : m.start()]
            if "&" in piece:
                piece = entities.unescape(piece)
            pieces.append(piece)
            if tags.names["a"]:
                linked += len(piece)
        name = m[2]
        if name is None:
            if silent_until is None:
                at = m.end()
            continue
        name = name.lower()
        if silent_until is not None:
            if m[1] and name == silent_until:
                silent_until, at = None, m.end()
            elif silent_until in ("head", "title", "svg", "math") and name == "body" and not m[1]:
                silent_until, at = None, m.end()
                tags.push(name, tag_features(name, m[3]))
            continue
        at = m.end()
        if m[1]:
            if name not in INLINE:
                close()
            tags.end(name)
            continue
        if name in SILENT:
            if name not in ("head",):
                close()
            if not m[3].endswith("/") and (name in RAW or ends_after(name, at)):
                silent_until = name
            continue
        if name == "br" or name == "hr":
            pieces.append(" ")
        if name in EMPTY:
            continue
        if name not in INLINE:
            close()
            if name in ENDS_P and tags.tag() == "p":
                tags.end("p")
        tags.push(name, tag_features(name, m[3]))
    if silent_until is None and at < len(page):
        pieces.append(entities.unescape(page[at:]))
        if tags.names["a"]:
            linked += len(pieces[-1])
    close()
    return out


#: Blocks of more words are counted by bucket first, so that a page's vectors stay small; all words count, each as often as it stands.
COUNTED_WORDS = 64


def vectors(page: list[Block], words: Words) -> tuple[list[int], list[int], list[int], list[int], list[int], np.ndarray]:
    """Path features, word features (both with their block's number; words with their number of times), and counts."""
    paths, of_path, marks, of_word, times = [], [], [], [], []
    extra = np.zeros((len(page), EXTRA), np.float32)
    for k, b in enumerate(page):
        own = b.text.split(" ")
        paths += b.path
        of_path += [k] * len(b.path)
        if len(own) > COUNTED_WORDS:
            many = np.bincount(np.fromiter(map(words.__getitem__, own), np.int64, len(own)), minlength=WORD_BUCKETS)
            seen = np.flatnonzero(many)
            times += many[seen].tolist()
            seen = seen.tolist()
        else:
            seen = list(map(words.__getitem__, own))
            times += [1] * len(own)
        marks += seen
        of_word += [k] * len(seen)
        n = len(b.text)
        extra[k] = (np.log1p(len(own)) / 5, b.linked / max(n, 1), b.text[-1] in ".!?:;\"”", n / max(len(own), 1) / 10, k / max(len(page), 1), min(len(page), 60) / 60)
    return paths, of_path, marks, of_word, times, extra


def _mean(table: np.ndarray, index: np.ndarray, rows: np.ndarray, n: int, count: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((n, table.shape[1]), np.float32)
    np.add.at(out, rows, table[index] if times is None else table[index] * times[:, None])
    return out / count[:, None]


class Labeller:
    """Embeddings, two LSTM directions and a logistic output; numpy forward and backward over padded batches."""

    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + EXTRA
        f = lambda *s, k=0.1: g.normal(0, k, s).astype(np.float32)
        self.p = {"path": f(PATH_BUCKETS, PATH_DIM), "word": f(WORD_BUCKETS, WORD_DIM), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(size + HIDDEN, 4 * HIDDEN, k=0.2), f"b{d}": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)}

    def inputs(self, pages: list[list[Block]], words: Words) -> dict:
        sizes = np.array([len(p) for p in pages])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        cols: list[list[int]] = [[], [], [], [], []]
        extra = []
        for base, page in zip(first.tolist(), pages):
            a, b, c, d, t, e = vectors(page, words)
            cols[0] += a
            cols[1] += [base + x for x in b]
            cols[2] += c
            cols[3] += [base + x for x in d]
            cols[4] += t
            extra.append(e)
        n = int(sizes.sum())
        paths, of_path, marks, of_word = (np.array(c, np.int64) for c in cols[:4])
        times = np.array(cols[4], np.float32)
        where = np.concatenate([np.arange(s) for s in sizes]) if n else np.zeros(0, np.int64)
        return {"sizes": sizes, "n": n, "paths": paths, "of_path": of_path, "marks": marks, "of_word": of_word, "times": times, "extra": np.concatenate(extra) if n else np.zeros((0, EXTRA), np.float32), "row": np.repeat(np.arange(len(pages)), sizes), "time": where, "back": np.repeat(sizes, sizes) - 1 - where, "n_path": np.maximum(np.bincount(of_path, minlength=n), 1).astype(np.float32) if n else np.ones(0, np.float32), "n_word": np.maximum(np.bincount(of_word, times, minlength=n), 1).astype(np.float32) if n else np.ones(0, np.float32)}

    def forward(self, x: dict, keep: bool = False) -> np.ndarray:
        """Logits of all blocks of a batch."""
        p, n, wide = self.p, x["n"], int(x["sizes"].max(initial=0))
        flat = np.concatenate([_mean(p["path"], x["paths"], x["of_path"], n, x["n_path"] ** 0.5), _mean(p["word"], x["marks"], x["of_word"], n, x["n_word"], x["times"]), x["extra"]], 1)
        states = np.zeros((n, 2 * HIDDEN), np.float32)
        x["tape"] = {}
        for k, (d, t) in enumerate((("f", x["time"]), ("b", x["back"]))):
            data = np.zeros((wide, len(x["sizes"]), flat.shape[1]), np.float32)
            data[t, x["row"]] = flat
            drive = data @ p[f"W{d}"][: flat.shape[1]] + p[f"b{d}"]
            h = c = np.zeros((len(x["sizes"]), HIDDEN), np.float32)
            hs = np.zeros((wide, len(x["sizes"]), HIDDEN), np.float32)
            tape = []
            for s in range(wide):
                z = drive[s] + h @ p[f"W{d}"][flat.shape[1] :]
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                u = np.tanh(z[:, 3 * HIDDEN :])
                new = f * c + i * u
                tanh = np.tanh(new)
                if keep:
                    tape.append((h, c, f, i, o, u, tanh))
                c, h = new, o * tanh
                hs[s] = h
            states[:, k * HIDDEN : (k + 1) * HIDDEN] = hs[t, x["row"]]
            x["tape"][d] = data, tape
        x["states"] = states
        return states @ p["out"] + p["bias"][0]

    def gradient(self, x: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, n, wide, pages = self.p, x["n"], int(x["sizes"].max()), len(x["sizes"])
        grad = {"out": x["states"].T @ slope, "bias": np.array([slope.sum()], np.float32), "path": np.zeros_like(p["path"]), "word": np.zeros_like(p["word"])}
        d_state, size = slope[:, None] * p["out"], PATH_DIM + WORD_DIM + EXTRA
        d_flat = np.zeros((n, size), np.float32)
        for k, (d, t) in enumerate((("f", x["time"]), ("b", x["back"]))):
            data, tape = x["tape"][d]
            dh_all = np.zeros((wide, pages, HIDDEN), np.float32)
            dh_all[t, x["row"]] = d_state[:, k * HIDDEN : (k + 1) * HIDDEN]
            w = p[f"W{d}"]
            dz_all = np.zeros((wide, pages, 4 * HIDDEN), np.float32)
            hs = np.zeros((wide, pages, HIDDEN), np.float32)
            dh = dc = np.zeros((pages, HIDDEN), np.float32)
            for s in range(wide - 1, -1, -1):
                h, c, f, i, o, u, tanh = tape[s]
                dh = dh + dh_all[s]
                dc = dc + dh * o * (1 - tanh * tanh)
                dz_all[s] = np.concatenate([dc * c * f * (1 - f), dc * u * i * (1 - i), dh * tanh * o * (1 - o), dc * i * (1 - u * u)], 1)
                hs[s] = h
                dc = dc * f
                dh = dz_all[s] @ w[size:].T
            both = np.concatenate([data, hs], 2).reshape(-1, size + HIDDEN)
            grad[f"W{d}"] = both.T @ dz_all.reshape(-1, 4 * HIDDEN)
            grad[f"b{d}"] = dz_all.sum((0, 1))
            d_flat += (dz_all @ w[:size].T)[t, x["row"]]
        np.add.at(grad["path"], x["paths"], (d_flat[:, :PATH_DIM] / (x["n_path"] ** 0.5)[:, None])[x["of_path"]])
        np.add.at(grad["word"], x["marks"], (d_flat[:, PATH_DIM : PATH_DIM + WORD_DIM] / x["n_word"][:, None])[x["of_word"]] * x["times"][:, None])
        return grad


def train(n_pages: int = 1500, epochs: int = 4, seed: int = 3) -> Labeller:
    """Adam on the logistic loss over made-up pages."""
    from tessella.llm.made_pages import page

    g = np.random.default_rng(seed)
    words, data = Words(), []
    for _ in range(n_pages):
        html, main = page(g)
        blocks = blocks_of(html)
        data.append((blocks, np.array([b.text in main for b in blocks], np.float32)))
    data = [d for d in data if d[0]]
    net, m, v, step = Labeller(seed), {}, {}, 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + 6 * g.random())
        batches = [order[i : i + 24] for i in range(0, len(order), 24)]
        g.shuffle(batches)
        for batch in batches:
            x = net.inputs([data[i][0] for i in batch], words)
            y = np.concatenate([data[i][1] for i in batch])
            slope = ((1 / (1 + np.exp(-net.forward(x, keep=True))) - y) / len(y)).astype(np.float32)
            step += 1
            for k, d in net.gradient(x, slope).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                net.p[k] -= (0.01 if epoch < epochs - 1 else 0.003) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


@lru_cache(maxsize=1)
def trained() -> Labeller:
    return train()


def extract(pages: list[str], net: Labeller, words: Words) -> list[str]:
    """Main texts of a batch of pages; pages of like length run through the network together."""
    cut = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(cut)) if cut[i]), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 128 and len(cut[order[end]]) * (end - at + 1) <= 8192:
            end += 1
        group = order[at:end]
        logits = net.forward(net.inputs([cut[i] for i in group], words))
        k = 0
        for i in group:
            out[i] = " ".join(b.text for b, z in zip(cut[i], logits[k : k + len(cut[i])]) if z > 0)
            k += len(cut[i])
        at = end
    return out


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the kept columns, text and n_chars of every page."""
    from pyspark.sql.types import LongType, StringType, StructType

    params = trained().p
    names = [key, *keep]

    def run(batches: Iterator):
        import pyarrow as pa

        net, words = Labeller.__new__(Labeller), Words()
        net.p = params
        for b in batches:
            got = extract([t.decode() for t in texts_of(b, html)], net, words)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=[*names, "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    schema = StructType([pages.schema[c] for c in names]).add("text", StringType()).add("n_chars", LongType())
    return pages.select(*names, html).mapInArrow(run, schema)
