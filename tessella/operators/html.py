"""Structural HTML segments: what stands between a start tag and stop tags, cut at block tags."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

#: Tags that end a segment.
BREAKS = frozenset("p br h1 h2 h3 h4 h5 h6 div li ul ol table tr td blockquote hr article section header footer nav".split())


class Segments(HTMLParser):
    """Collects (tag, text, bold characters) once `start` has been seen, until one of `stop` opens."""

    def __init__(self, start: str, stop: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.start, self.stop, self.on, self.done = start, stop, False, False
        self.silent, self.bold, self.tag = 0, 0, ""
        self.parts: list[str] = []
        self.heavy = 0
        self.out: list[tuple[str, str, float]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.on and not self.done:
            self.out.append((self.tag, text, min(1.0, self.heavy / max(len(text), 1))))
        self.parts, self.heavy = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        if tag in BREAKS:
            self.flush()
            self.tag = tag
        if tag == self.start:
            self.on = True
        if tag in self.stop:
            self.flush()
            self.done = True
        if tag in ("b", "strong"):
            self.bold += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag in BREAKS:
            self.flush()
        if tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.bold:
                self.heavy += len(data.strip())


def segments(pages: DataFrame, key: str, html: str, start: str, stop: tuple[str, ...], bold_share: float = 0.6) -> DataFrame:
    """(key, block_index, tag, text, was_bold) of every page; null pages have no blocks."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, page in zip(b.column(key).to_pylist(), b.column(html).to_pylist()):
                parser = Segments(start, stop)
                parser.feed(page or "")
                parser.close()
                parser.flush()
                rows += [(k, i, tag, text, share >= bold_share) for i, (tag, text, share) in enumerate(parser.out)]
            columns = list(zip(*rows)) or [[]] * 5
            types = [b.schema.field(key).type, pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[key, "block_index", "tag", "text", "was_bold"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, block_index int, tag string, text string, was_bold boolean")
