"""Deeply nested records as flat related tables, by Dewey labelling.

Every node of a record gets the path of ordinals that leads to it (its Dewey label).
The parent's label is the label without its last ordinal, document order is the
order of the labels, and all nodes of one schema path form one table. JSON texts are labelled in
Python workers, typed columns (arrays and structs) by expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.runtime import latest

NODE = T.StructType(
    [
        T.StructField("dewey", T.ArrayType(T.IntegerType())),
        T.StructField("schema_path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("members", T.ArrayType(T.StringType())),
    ]
)
_ARROW = {"dewey": pa.list_(pa.int32()), "schema_path": pa.string(), "kind": pa.string(), "value": pa.string(), "members": pa.list_(pa.string())}


def opened(v: object) -> object:
    """The object or array that a string holds as JSON text, however often it is wrapped; any other value itself."""
    inner = v
    # each layer is shorter than the one around it
    while isinstance(inner, str) and inner.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = json.loads(inner)
        except (ValueError, RecursionError):
            return v
    return inner if isinstance(inner, (dict, list)) else v


def label_nodes(root: object) -> Iterator[tuple[list[int], str, str, str | None, list[str] | None]]:
    """Nodes of one parsed value in document order.

    A string that itself holds a JSON object or array is opened as a node of its own.
    """
    stack: list[tuple[list[int], str, object]] = [([], "", root)]
    while stack:
        dewey, path, v = stack.pop()
        if isinstance(v, str):
            v = opened(v)
        if isinstance(v, dict):
            yield dewey, path, "object", None, list(v)
            stack.extend(reversed([([*dewey, i], f"{path}.{k}" if path else k, x) for i, (k, x) in enumerate(v.items())]))
        elif isinstance(v, list):
            yield dewey, path, "array", None, None
            stack.extend(reversed([([*dewey, i], f"{path}[]", x) for i, x in enumerate(v)]))
        elif v is None:
            yield dewey, path, "null", None, None
        elif isinstance(v, bool):
            yield dewey, path, "boolean", "true" if v else "false", None
        elif isinstance(v, (int, float)):
            yield dewey, path, "number", json.dumps(v), None
        else:
            yield dewey, path, "string", v, None


def dewey_nodes(df: DataFrame, keys: list[str], json_col: str, keep: str | None = None) -> DataFrame:
    """Node table of a JSON text column: ``keys`` plus the columns of ``NODE``.

    ``keep`` is a regular expression; only nodes whose schema path contains a match
    are returned. A null text has no nodes; a text that is no JSON is one node of
    kind ``text``; an empty object or array is one node.
    """
    import re

    src = df.select(*keys, F.col(json_col).alias("__json"))
    types = [src.schema[k] for k in keys]
    out = T.StructType([*types, *NODE.fields])
    pattern = re.compile(keep) if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            at: list[int] = []
            cols: dict[str, list] = {c: [] for c in _ARROW}
            for i, text in enumerate(texts):
                if text is None:
                    continue
                try:
                    nodes = label_nodes(json.loads(text))
                except (ValueError, RecursionError):
                    nodes = iter([([], "", "text", text, None)])
                for dewey, path, kind, value, members in nodes:
                    if pattern is None or pattern.search(path):
                        at.append(i)
                        for c, x in zip(_ARROW, (dewey, path, kind, value, members)):
                            cols[c].append(x)
            picked = [b.column(j).take(pa.array(at, pa.int32())) for j in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*picked, *[pa.array(cols[c], t) for c, t in _ARROW.items()]], names=[*keys, *_ARROW])

    return src.mapInArrow(run, out)


def typed_nodes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Node table of a typed column (arrays, structs and plain values): ``keys`` plus the columns of ``NODE``.

    The root has the column's name as its path. A null column has no nodes; a null
    inside is a node of kind ``null``; an empty array is one node. No Python is run.
    """

    def node(label: Column, path: str, kind: Column | str, value: Column | None, members: list[str] | None) -> Column:
        return F.struct(
            label.cast("array<int>").alias("dewey"), F.lit(path).alias("schema_path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
            (F.lit(None) if value is None else value).cast("string").alias("value"), (F.lit(None) if members is None else F.array(*map(F.lit, members))).cast("array<string>").alias("members"),
        )

    def below(c: Column, kind: T.DataType, path: str, label: Column) -> Column:
        """Array of the node of ``c`` and all nodes below it."""
        if isinstance(kind, T.ArrayType):
            own = F.array(node(label, path, F.when(c.isNull(), "null").otherwise("array"), None, None))
            inner = F.flatten(F.transform(c, lambda x, i: below(x, kind.elementType, f"{path}[]", F.concat(label, F.array(i)))))
            return F.concat(own, F.coalesce(inner, F.slice(own, 1, 0)))
        if isinstance(kind, T.StructType):
            names = kind.names
            own = F.array(F.when(c.isNull(), node(label, path, "null", None, None)).otherwise(node(label, path, "object", None, names)))
            inner = F.concat(*[below(c.getField(f.name), f.dataType, f"{path}.{f.name}", F.concat(label, F.array(F.lit(i)))) for i, f in enumerate(kind.fields)])
            return F.concat(own, F.when(c.isNotNull(), inner).otherwise(F.slice(own, 1, 0)))
        named = "boolean" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string"
        return F.array(node(label, path, F.when(c.isNull(), "null").otherwise(named), c, None))

    root = below(F.col(column), df.schema[column].dataType, column, F.array().cast("array<int>"))
    return df.filter(F.col(column).isNotNull()).select(*keys, F.explode(root).alias("__n")).select(*keys, "__n.*")


def parent_label(dewey: Column) -> Column:
    """Label of the parent: the label without its last ordinal; null at the root."""
    return F.when(F.size(dewey) > 0, F.slice(dewey, 1, F.greatest(F.size(dewey) - 1, F.lit(0))))


def path_tables(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes with their parent's label, grouped by schema path.

    Each ``schema_path`` is one flat table; a row is found from its parent by
    ``keys`` and ``parent`` = the parent's ``dewey``.
    """
    return nodes.select(*keys, "schema_path", "dewey", parent_label(F.col("dewey")).alias("parent"), F.try_element_at("dewey", F.lit(-1)).alias("ordinal"), "kind", "value")


#: Geometry entries: a path below one of the three members, through arrays and page wrappers only.
_HEAD = r"(?:^|\.)(source|caption|member)_geometry(?:\[\]|\.blocks)*"
_SLOT = _HEAD + "$"
_LEAF = _HEAD + r"\.(?:block_id|block\.id)$"
_NEAR = r"(?:^|\.)(?:source|caption|member)_geometry(?:$|\[|\.)"


def geometry_children(nodes: DataFrame) -> DataFrame:
    """Block ids of the geometries in the nodes of ``evidence``: doc_id, record_id, path, pos, child_id.

    An entry is a null inside an array, or an object that
    does not merely wrap a page's ``blocks``. Entries are numbered in the order of
    their labels; null entries and entries without a block id keep their place but
    are no children. An entry with two different ids has two children at its place.
    """
    in_array = F.col("schema_path").endswith("[]")
    entry = F.col("schema_path").rlike(_SLOT) & (
        ((F.col("kind") == "null") & in_array) | ((F.col("kind") == "object") & ~F.array_contains("members", "blocks"))
    )
    leaf = F.col("schema_path").rlike(_LEAF) & (F.col("kind") != "null")
    up = F.when(F.col("schema_path").endswith(".block.id"), 2).otherwise(1)
    slots = (
        nodes.filter(entry | leaf)
        .select(
            "doc_id",
            "record_id",
            F.concat(F.regexp_extract("schema_path", _HEAD, 1), F.lit("_geometry")).alias("path"),
            F.when(leaf, F.slice("dewey", 1, F.size("dewey") - up)).otherwise(F.col("dewey")).alias("slot"),
            F.when(leaf, F.col("value")).alias("child_id"),
        )
        .groupBy("doc_id", "record_id", "path", "slot")
        .agg(F.collect_set("child_id").alias("child_ids"))
    )
    # the places are numbered within one record, so a partition of the window is one record
    order = Window.partitionBy("doc_id", "record_id", "path").orderBy("slot")
    return (
        slots.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
        .select("doc_id", "record_id", "path", "pos", F.explode("child_ids").alias("child_id"))
    )


def array_children(nodes: DataFrame, column: str, leaf: str | None = None) -> DataFrame:
    """Children of an array column from its node table: doc_id, record_id, path, pos, child_id.

    An entry is a node one below the root that is not null; its id is its own value
    or, with ``leaf``, that of the node of this name below it, found by its label
    without the last ordinal (the empty string where that is null).
    """
    entry = F.col("schema_path") == f"{column}[]"
    pos = F.try_element_at("dewey", F.lit(-1)).alias("pos")
    if leaf is None:
        return nodes.filter(entry & (F.col("kind") != "null")).select("doc_id", "record_id", F.lit(column).alias("path"), pos, F.col("value").alias("child_id"))
    leaves = nodes.filter(F.col("schema_path") == f"{column}[].{leaf}")
    up = leaves.select("doc_id", "record_id", parent_label(F.col("dewey")).alias("dewey"), F.coalesce("value", F.lit("")).alias("child_id"))
    return up.select("doc_id", "record_id", F.lit(column).alias("path"), pos, "child_id")


def nested_nodes(candidates: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Node tables of the three nested columns, each record once: doc_id, record_id, source and the columns of ``NODE``.

    Of a record delivered more than once the last ``received_at`` counts.
    """
    return _evidence(candidates).unionByName(_typed(blocks, "source_spans")).unionByName(_typed(groups, "member_block_ids"))


def _once(df: DataFrame, record: str, column: str, keys: list[str]) -> DataFrame:
    received = (F.col("received_at") if "received_at" in df.columns else F.lit(None).cast("timestamp")).alias("received_at")
    slim = df.select("doc_id", F.col(record).alias("record_id"), column, received).filter("doc_id is not null and record_id is not null")
    return latest(slim, keys)


def _evidence(candidates: DataFrame, keep: str | None = None) -> DataFrame:
    nodes = dewey_nodes(_once(candidates, "candidate_id", "evidence", ["record_id"]), ["doc_id", "record_id"], "evidence", keep)
    return nodes.select("doc_id", "record_id", F.lit("evidence").alias("source"), *_ARROW)


def _typed(df: DataFrame, column: str) -> DataFrame:
    keys = ["doc_id", "record_id"] if column == "member_block_ids" else ["record_id"]
    nodes = typed_nodes(_once(df, "id", column, keys), ["doc_id", "record_id"], column)
    return nodes.select("doc_id", "record_id", F.lit(column).alias("source"), *_ARROW)


def flat_children(candidates: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Children of the three nested tables with their record and place, all from their Dewey labels.

    Of a record delivered more than once the last ``received_at`` counts. Null and
    empty arrays, null texts and texts that are no JSON have no children; a repeated
    entry is a child at each of its places.
    """
    parts = [
        geometry_children(_evidence(candidates, _NEAR)),
        array_children(_typed(groups, "member_block_ids"), "member_block_ids"),
        array_children(_typed(blocks, "source_spans"), "source_spans", "region_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def span_table(blocks: DataFrame) -> DataFrame:
    """``reader_blocks.source_spans`` as a flat table with its bounding boxes; missing parts stay null, each block counts once."""
    return (
        _once(blocks, "id", "source_spans", ["record_id"]).select("doc_id", "record_id", F.posexplode("source_spans").alias("pos", "s"))
        .filter("s is not null")
        .select(
            "doc_id", "record_id", "pos", "s.page_index", F.col("s.bbox.x").alias("x"), F.col("s.bbox.y").alias("y"),
            F.col("s.bbox.width").alias("width"), F.col("s.bbox.height").alias("height"), "s.region_id",
        )
    )
