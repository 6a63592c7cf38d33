"""Trees in JSON text, flattened by an Arrow pass: depth first, children after their parent, subtree text rolled up."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame


def walk(node: dict, path: tuple[str, ...] = ()) -> tuple[list[tuple[str, str, str, int]], str]:
    """Rows (path, own text, subtree text, depth) and the subtree text, without recursion on the Python stack."""
    rows: list[list] = []
    todo = [(node, path, -1)]
    while todo:
        n, p, parent = todo.pop()
        here = (*p, str(n.get("id", len(rows))))
        rows.append(["/".join(here), n.get("text") or "", parent])
        at = len(rows) - 1
        todo += [(c, here, at) for c in reversed(n.get("children") or [])]
    parts: list[list[str]] = [[r[1]] if r[1] else [] for r in rows]
    for at in range(len(rows) - 1, 0, -1):  # children come after their parent
        own = parts[rows[at][2]]
        own[1 if rows[rows[at][2]][1] else 0 : 1 if rows[rows[at][2]][1] else 0] = parts[at]
    return [(r[0], r[1], " ".join(parts[k]), r[0].count("/")) for k, r in enumerate(rows)], " ".join(parts[0])


def flatten(documents: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, path, text, subtree, depth). Null or unreadable trees have no nodes."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            out = []
            for k, t in zip(b.column(key).to_pylist(), b.column(tree).to_pylist()):
                try:
                    node = json.loads(t) if t else None
                except ValueError:
                    node = None
                if isinstance(node, dict):
                    out += [(k, *r) for r in walk(node)[0]]
            columns = list(zip(*out)) or [[]] * 5
            types = [b.schema.field(key).type, pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[key, "path", "text", "subtree", "depth"])

    return documents.select(key, tree).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, path string, text string, subtree string, depth int")
