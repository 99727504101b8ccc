"""Strings at the leaves of JSON, wherever they are: found with their paths, and put back with all else as it was.

The depth of JSON is not known beforehand, so both are Arrow-batched passes; nothing is shuffled to find leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.predicates import LAST_CANDIDATES, is_content_path, last_candidates, looks_like_prose


def walk(value, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, string) of each string leaf, in order; fields by name and elements by number."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, (*path, i))


def put(value, path: list, text: str):
    """The value with the string at ``path`` replaced; a path that isn't there changes nothing."""
    if not path:
        return text
    at = value
    try:
        for p in path[:-1]:
            at = at[int(p) if isinstance(at, list) else p]
        last = int(path[-1]) if isinstance(at, list) else path[-1]
        if isinstance(at[last], str):
            at[last] = text
    except (KeyError, IndexError, TypeError, ValueError):
        pass
    return value


def parse(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, leaf (its number), path (array of strings) and value of each string leaf."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, n, paths, values = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (path, value) in enumerate(walk(parse(text))):
                    at.append(i)
                    n.append(k)
                    paths.append([str(p) for p in path])
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(paths, pa.list_(pa.string())), pa.array(values, pa.string())], names=[key, "leaf", "path", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, column).mapInArrow(run, f"`{key}` {kind}, leaf int, path array<string>, value string")


def content_leaves(docs: DataFrame, key: str, column: str, most: int = LAST_CANDIDATES) -> DataFrame:
    """The last leaves of each row that a person seems to have written: under a name for texts, and prose."""
    some = leaves(docs, key, column).where(is_content_path("path") & looks_like_prose("value"))
    found = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("leaf", "path", "value"))).alias("c"))
    return found.select(key, F.explode(last_candidates("c", most)).alias("c")).select(key, "c.*")


def write_back(docs: DataFrame, changed: DataFrame, key: str, column: str) -> DataFrame:
    """``docs`` with the JSON in ``column`` changed at the paths of ``changed`` (key, path, value)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, edits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = parse(text)
                if value is not None and edits:
                    for e in edits:
                        value = put(value, e["path"], e["value"])
                    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
                out.append(text)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *rest], names=[column, *others])

    others = [c for c in docs.columns if c != column]
    edits = changed.groupBy(key).agg(F.collect_list(F.struct("path", "value")).alias("_edits"))
    rows = docs.join(edits, key, "left").select(column, "_edits", *others)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [column, *others])
    return rows.mapInArrow(run, schema).select(*docs.columns)


def nested_string(column: str, outer: int, *inner: int):
    """A string within JSON that is itself a string within JSON: ``[outer]`` of one, then ``[inner]...`` of the other."""
    first = F.get_json_object(F.col(column), f"$[{outer}]")
    return F.get_json_object(first, "$" + "".join(f"[{i}]" for i in inner))


def put_nested(column: str, value: str, outer: int, *inner: int):
    """The JSON with that inner string replaced by the column ``value``; unchanged where it has none there."""

    @F.pandas_udf("string")
    def run(texts, values):
        import pandas as pd

        out = []
        for text, new in zip(texts, values, strict=True):
            whole = parse(text)
            part = parse(whole[outer]) if isinstance(whole, list) and len(whole) > outer and isinstance(whole[outer], str) else None
            if part is None or new is None or (tuple(map(int, inner)), True) not in {(p, isinstance(v, str)) for p, v in walk(part)}:
                out.append(text)
                continue
            whole[outer] = json.dumps(put(part, list(inner), new), ensure_ascii=False, separators=(",", ":"))
            out.append(json.dumps(whole, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return run(F.col(column), F.col(value))
