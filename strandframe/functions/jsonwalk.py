"""Small helpers that turn one JSON text into rows; Spark does everything after."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Schema paths a task remembers before it starts afresh.
MEMO = 100_000


class _Int(str):
    """An integer literal as written."""


class _Float(str):
    """A float literal as written."""


def parse(text: str | None):
    """The value of a JSON text with its number literals kept as written; None if unreadable."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_int=_Int, parse_float=_Float, parse_constant=_Float)
    except (ValueError, RecursionError):
        return None


def kind(value) -> str:
    """integer, float, string, boolean, array, object or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, _Int):
        return "integer"
    if isinstance(value, _Float):
        return "float"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def scalar(value) -> str | None:
    """A scalar compared as text; None for null, arrays and objects."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else None


class _Mark(str):
    """Punctuation of a JSON text."""


def nested(value) -> str | None:
    """An array or object as JSON text, its number literals as written; None for scalars and null."""
    if not isinstance(value, (dict, list)):
        return None
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, (_Mark, _Int, _Float)):
            out.append(v)
        elif isinstance(v, (dict, list)):
            inner: list = []
            for item in v:
                inner.append(_Mark("," if inner else ""))
                inner += [_Mark(json.dumps(item) + ":"), v[item]] if isinstance(v, dict) else [item]
            marks = "{}" if isinstance(v, dict) else "[]"
            todo += [_Mark(marks[1]), *reversed(inner), _Mark(marks[0])]
        else:
            out.append(json.dumps(v))
    return "".join(out)


def _leaves(value: dict, prefix: str = ""):
    for name, item in value.items():
        path = f"{prefix}>{name}" if prefix else name
        if isinstance(item, dict):
            yield from _leaves(item, path)
        else:
            yield path, item


FIELDS = ArrayType(StructType([StructField(n, StringType()) for n in ("field", "jtype", "value", "nested")]))


@F.pandas_udf(FIELDS)
def leaf_fields(payloads: pd.Series) -> pd.Series:
    """Every value that is not an object, named by its keys joined with '>'; null if unreadable."""
    return payloads.map(lambda p: [(n, kind(v), scalar(v), nested(v)) for n, v in _leaves(d)] if isinstance(d := parse(p), dict) else None)


@F.pandas_udf(FIELDS)
def top_fields(payloads: pd.Series) -> pd.Series:
    """The top-level keys; null if unreadable or not an object."""
    return payloads.map(lambda p: [(n, kind(v), scalar(v), nested(v)) for n, v in d.items()] if isinstance(d := parse(p), dict) else None)


def walk(value, keyed: frozenset[str]):
    """Depth-first Dewey labels of all nodes: (value, label, path, key).

    The label of a child is its parent's with the child's ordinal added (``0.3.1``; the root's is
    empty). ``path`` names the schema position: keys joined with '>', '[]' for an array's elements,
    '{}' for the entries of an object whose keys are data (named in ``keyed``). A '>' inside a key
    is written '›' in the path, so that a path has one step per ordinal.
    """
    todo = [(value, "", "", None)]
    while todo:
        node = todo.pop()
        yield node
        value, label, path, _ = node
        if isinstance(value, (dict, list)):
            at, under = (label + "." if label else ""), (path + ">" if path else "")
            if isinstance(value, list):
                inner = [(item, f"{at}{i}", under + "[]", None) for i, item in enumerate(value)]
            elif path.rpartition(">")[2] in keyed:
                inner = [(item, f"{at}{i}", under + "{}", name) for i, (name, item) in enumerate(value.items())]
            else:
                inner = [(item, f"{at}{i}", under + name.replace(">", "›"), name) for i, (name, item) in enumerate(value.items())]
            todo += reversed(inner)


def dewey_rows(keyed: frozenset[str], keep: str | None = None):
    """A function for ``mapInPandas`` over (file_id, payload): file_id, label, path, key, kind, value of every node.

    ``keep`` is a pattern of schema paths; other nodes are walked through but give no rows. It is
    tried once per schema path, not per node. Unreadable texts give no rows.
    """
    wanted = re.compile(keep or "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for file_id, payload in zip(batch["file_id"], batch["payload"]):
                tree = parse(payload)
                if tree is None:
                    continue
                for value, label, path, key in walk(tree, keyed):
                    if path not in known:
                        if len(known) > MEMO:
                            known.clear()
                        known[path] = wanted.search(path) is not None
                    if known[path]:
                        rows.append((file_id, label, path, key, kind(value), scalar(value)))
            yield pd.DataFrame(rows, columns=["file_id", "label", "path", "key", "kind", "value"])

    return run
