"""Nested JSON trees as node tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

NODES = "graph_id long, nid int, parent int, type string, src string, depth int, n_children int, error string"


def _walk(root: dict) -> Iterator[tuple]:
    """Pre-order nodes, without recursion: a child is any object with a nodeType, or one in a list."""
    stack, nid = [(root, -1, 0)], 0
    while stack:
        node, parent, depth = stack.pop()
        children = []
        for value in node.values():
            children += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict) and "nodeType" in x]
        yield nid, parent, str(node.get("nodeType")), node.get("src"), depth, len(children)
        stack += [(c, nid, depth + 1) for c in reversed(children)]
        nid += 1


def flatten(trees: DataFrame, id_col: str = "graph_id", json_col: str = "ast") -> DataFrame:
    """A row a node of each (id, JSON text) row; text that is no tree gives one row with its error.

    Trees nest without bound, which column functions can't follow, so batches of
    texts go to Python. A tree is emitted node by node.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["graph_id", "nid", "parent", "type", "src", "depth", "n_children", "error"]
        for b in batches:
            rows = []
            for gid, text in zip(b["id"], b["text"], strict=True):
                try:
                    root = json.loads(text)
                    if not isinstance(root, dict) or "nodeType" not in root:
                        raise ValueError("no tree")
                    rows += [(gid, *x, None) for x in _walk(root)]
                except (ValueError, TypeError) as e:
                    rows.append((gid, -1, -1, None, None, 0, 0, str(e)))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            yield pd.DataFrame(rows, columns=cols)

    return trees.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{json_col}` AS text").mapInPandas(run, NODES)
