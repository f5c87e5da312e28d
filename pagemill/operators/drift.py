"""Files whose JSON schema drifts, read into one consistent table with a report of each change.

The wanted schema is a table of fields (``field``, ``json_type``, ``optional``). Every
file has a schema fingerprint: the hash of its structure (names and types at each
place, without order, layout and values). For each fingerprint the migration is decided
once, as a chain of explicit steps - *container* (an array given as an object by key),
*rename*, *default*, *cast*, *keep* - and each file is routed by its fingerprint through
these steps; the report of a file is that of its steps. The registry of fingerprints
with their versions, times and steps is a table of its own.

A rename is decided by the names (``RENAMES``, spelling, common words) and, where names
leave it open, by the forms of the values, counted over all files for each name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import checkpoint, latest

#: Names under which fields were written by earlier writers: (path of the object, name) -> field name.
RENAMES = {
    ("", "version"): "schema_version",
    ("", "schema"): "schema_version",
    ("", "algorithm"): "algorithm_version",
    ("", "repair_version"): "algorithm_version",
    ("", "state"): "status",
    ("", "index_file"): "viewer_index",
    ("", "repairs"): "groups",
    ("", "visual_groups"): "groups",
    ("", "captions"): "caption_links",
    ("inputs", "extraction_result"): "mineru_result",
    ("summary", "groups_total"): "group_count",
    ("groups[]", "page"): "page_idx",
    ("groups[]", "page_index"): "page_idx",
    ("groups[]", "members"): "member_block_ids",
    ("groups[]", "block_ids"): "member_block_ids",
    ("groups[]", "asset_paths"): "member_asset_paths",
    ("groups[]", "member_assets"): "member_asset_paths",
    ("groups[]", "anchors"): "caption_anchor_block_ids",
    ("groups[]", "score"): "confidence",
    ("groups[]", "conf"): "confidence",
    ("groups[]", "verdict"): "decision",
    ("groups[]", "outcome"): "decision",
    ("groups[]", "reasons"): "reason_codes",
    ("groups[]", "on_failure"): "fallback",
    ("groups[].replacement", "bbox"): "bbox_norm",
    ("groups[].replacement", "box"): "bbox_norm",
    ("caption_links[]", "block"): "visual_block_id",
    ("caption_links[]", "figure"): "figure_key",
    ("issues[]", "issue_code"): "code",
}

#: An unknown name holds a field's content if this share of its values has a form that the field's values have too.
FORM_SHARE = 0.5
#: Stands for the keys of an object by key in a structure; such keys have a run of three digits at least.
BY_KEY = "*"
_KEY = re.compile(r"\d{3}")


def snake(name: str) -> str:
    """``figureKey`` and ``figure-key`` as ``figure_key``."""
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")


def json_kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def fits(v: object, json_type: str) -> bool:
    """Whether a value is of a type: a null fits all, an integer is a number, element types count."""
    if v is None:
        return True
    if json_type.startswith("array"):
        if not isinstance(v, list):
            return False
        item = json_type.partition(" of ")[2]
        return not item or all(fits(x, item) for x in v)
    kind = json_kind(v)
    return kind == json_type or (json_type == "number" and kind == "integer")


def form(v: object) -> str:
    """Form of a value: runs of digits as 9, long hexadecimal strings as h, arrays by the forms of their items, objects by their names."""
    if isinstance(v, list):
        out = "[" + "|".join(sorted(set(map(form, v)))) + "]"
    elif isinstance(v, dict):
        out = "{" + ",".join(sorted(v)) + "}"
    elif isinstance(v, str):
        out = "s" + ("h" if re.fullmatch(r"[0-9a-fA-F]{32,}", v) else re.sub(r"\d+", "9", v))
    else:
        out = json_kind(v)
    return out if len(out) <= 64 else hashlib.md5(out.encode()).hexdigest()


@dataclass
class Schema:
    """The wanted schema as a tree: for each object path its members with type and optional flag."""

    members: dict[str, dict[str, tuple[str, bool]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str, bool]]) -> "Schema":
        out = cls()
        for path, kind, optional in rows:
            parent, _, name = path.rpartition(".")
            out.members.setdefault(parent, {})[name] = (kind, bool(optional))
        return out

    def names(self) -> set[str]:
        return {n for m in self.members.values() for n in m}


_SCALARS = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string"}


def structure(v: object, names: set[str]) -> object:
    """Names and types of a value: an object of structures, a list of the distinct structures of the items, or a type's name.

    An object whose keys all look like ids stands for its values, whatever the keys.
    """
    kind = type(v)
    if kind is dict:
        if v and all(_KEY.search(k) and k not in names for k in v):
            return {BY_KEY: _distinct(v.values(), names)}
        return {k: structure(v[k], names) for k in sorted(v)}
    if kind is list:
        return _distinct(v, names)
    return _SCALARS[kind]


def _distinct(values, names: set[str]) -> list:
    kinds = set(map(type, values))
    if not kinds & {dict, list}:
        return sorted(_SCALARS[k] for k in kinds)
    seen = {json.dumps(x): x for x in (structure(v, names) for v in values)}
    return [seen[k] for k in sorted(seen)]


def fingerprint(v: object, names: set[str] = frozenset()) -> str:
    """Fingerprint of a file's schema, without order, layout and values."""
    return hashlib.md5(json.dumps(structure(v, names)).encode()).hexdigest()


def _suits(x: object, json_type: str) -> bool:
    """Whether a structure is of a type; the counterpart of ``fits``."""
    if x == "null":
        return True
    if json_type.startswith("array"):
        item = json_type.partition(" of ")[2]
        return isinstance(x, list) and (not item or all(_suits(y, item) for y in x))
    if isinstance(x, (list, dict)):
        return json_type == "object" and isinstance(x, dict)
    return x == json_type or (json_type == "number" and x == "integer")


def _affinity(schema: Schema, at: str, name: str, x: object, wanted: str, proof: set[tuple[str, str, str]]) -> int:
    """How surely the member ``name`` of structure ``x`` holds the content of the missing field ``wanted``; 0: not at all, -1: the forms of the values are to tell."""
    plain, kind = snake(name), schema.members[at][wanted][0]
    if plain == wanted:
        return 100
    if RENAMES.get((at, plain)) == wanted:
        return 90
    family = "array" if kind.startswith("array") else kind
    have = "array" if isinstance(x, list) else "object" if isinstance(x, dict) else x
    words, target = set(plain.split("_")), set(wanted.split("_"))
    related = any(a == b or (min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a))) for a in words for b in target)
    if have == "object" and family == "object":
        inside = schema.members.get(f"{at}.{wanted}" if at else wanted, {})
        return 60 if inside and x and len(set(map(snake, x)) & set(inside)) * 2 >= len(x) else 0
    if have == "null" or not (have == family or (family == "number" and have == "integer")):
        return 0
    if have in ("string", "array"):
        if (at, name, wanted) in proof:
            return 60 + 10 * related
        return 45 if related else -1
    return 40 if related and have != "boolean" else 0


def _named(x: object) -> list:
    """The object structures among the items of an array, or of an array given as an object by key."""
    items = x if isinstance(x, list) else x.get(BY_KEY, list(x.values())) if isinstance(x, dict) else []
    return [y for y in items if isinstance(y, dict)]


def plan_steps(root: object, schema: Schema, proof: set[tuple[str, str, str]] = frozenset()) -> tuple[list[list[str]], list[list[str]]]:
    """The steps that bring a structure into the wanted schema, and the renames that names leave open.

    Steps: (step, path of the object, name in the file, field), in the order in which
    they are taken; ``keep`` names what the schema lacks, ``null`` an optional field that is absent.
    """
    steps: dict[tuple[str, str, str, str], int] = {}
    open_: dict[tuple[str, str, str], None] = {}
    todo: list[tuple[str, list]] = [("", [root])]
    while todo:
        at, forms = todo.pop()
        wanted = schema.members.get(at, {})
        inside: dict[str, list] = {}
        for x in forms:
            if not x:
                continue  # an empty object is not judged
            by_key = BY_KEY in x
            extra = [] if by_key else [k for k in x if k not in wanted]
            absent = [k for k in wanted if by_key or k not in x]
            scored = [(_affinity(schema, at, e, x[e], w, proof), i, j) for i, e in enumerate(extra) for j, w in enumerate(absent)]
            source = {k: k for k in wanted if k not in absent}
            used: set[str] = set()
            # the surest pairs of an unknown member and an absent field first
            for n, i, j in sorted((-n, i, j) for n, i, j in scored if n > 0):
                if extra[i] not in used and absent[j] not in source:
                    used.add(extra[i])
                    source[absent[j]] = extra[i]
                    steps.setdefault(("rename", at, extra[i], absent[j]), n)
            for n, i, j in scored:
                if n < 0 and extra[i] not in used and absent[j] not in source:
                    open_[at, extra[i], absent[j]] = None
            for name, (kind, optional) in wanted.items():
                if name not in source:
                    steps["null" if optional else "default", at, "", name] = 0
                    continue
                y = x[source[name]]
                if not _suits(y, kind):
                    steps["container" if kind == "array" and isinstance(y, dict) else "cast", at, source[name], name] = 0
                inside.setdefault(name, []).append(y)
            for e in extra:
                if e not in used:
                    steps["keep", at, e, ""] = 0
        for name, structures in inside.items():
            path = f"{at}.{name}" if at else name
            if wanted[name][0] == "object":
                todo.append((path, [y for y in structures if isinstance(y, dict)]))
            elif f"{path}[]" in schema.members:
                todo.append((path + "[]", [z for y in structures for z in _named(y)]))
    order = ("container", "rename", "default", "null", "cast", "keep")
    return [list(k) for k in sorted(steps, key=lambda k: (order.index(k[0]), k[1], steps[k], k))], [list(k) for k in open_]


_CHANGES = {"container": "type", "cast": "type", "rename": "renamed", "default": "missing", "keep": "added"}


def step_changes(steps: list[list[str]]) -> list[tuple[str, str]]:
    """The report of a chain of steps: field and change."""
    return sorted({(f"{at}.{name or old}" if at else name or old, _CHANGES[step]) for step, at, old, name in steps if step in _CHANGES})


def _items(v: object) -> list | None:
    """Items of an array, or of an array given as an object by key; None for any other value."""
    if isinstance(v, list):
        return v
    return list(v.values()) if isinstance(v, dict) else None


def take_steps(v: object, renames: dict[str, list[tuple[str, str]]], schema: Schema, at: str = "") -> object:
    """One object in the wanted schema, by the renames of its steps; what is absent is null, what is of another type is cast."""
    if not isinstance(v, dict) or not v:
        return v
    wanted = schema.members.get(at, {})
    source = {k: k for k in wanted if k in v}
    used: set[str] = set()
    for old, new in renames.get(at, ()):
        if old in v and old not in used and new not in source:
            used.add(old)
            source[new] = old
    out: dict[str, object] = {}
    for name, (kind, _) in wanted.items():
        path = f"{at}.{name}" if at else name
        x = v[source[name]] if name in source else None
        if kind == "object":
            x = take_steps(x, renames, schema, path) if isinstance(x, dict) else None
        elif kind == "array" and f"{path}[]" in schema.members:
            items = _items(x)
            x = None if items is None else [take_steps(y, renames, schema, path + "[]") for y in items if y is None or isinstance(y, dict)]
        else:
            x = cast(x, kind)
        out[name] = x
    return out


def _renames(steps: list[list[str]]) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for step, at, old, name in steps:
        if step == "rename":
            out.setdefault(at, []).append((old, name))
    return out


def cast(v: object, kind: str) -> object:
    """A value as the wanted type, or null where it can't be read as that type."""
    if v is None:
        return None
    if kind.startswith("array"):
        item = kind.partition(" of ")[2]
        if isinstance(v, str):
            v = [x for x in re.split(r"[;,\s]+", v) if x]
        elif isinstance(v, dict):
            # flags by name stand for their names, numbered or named parts for their values
            v = [k for k, x in v.items() if x] if all(isinstance(x, bool) for x in v.values()) else list(v.values())
        elif not isinstance(v, list):
            return None
        return [cast(next(iter(x.values()), None) if isinstance(x, dict) else x, item) for x in v]
    if isinstance(v, dict):
        v = next((v[k] for k in ("value", "name", "id") if k in v), None)
    if isinstance(v, (dict, list)) or v is None:
        return None
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if kind == "boolean":
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).lower())
    if isinstance(v, bool):
        return None
    if isinstance(v, str):
        digits = re.fullmatch(r"[A-Za-z]?(-?\d+(?:\.\d+)?)", v.strip())
        if not digits:
            return None
        v = float(digits[1])
    return int(v) if kind == "integer" and float(v).is_integer() else None if kind == "integer" else float(v)


def _forms(v: object, renames: dict[str, list[tuple[str, str]]], open_: set[tuple[str, str]], schema: Schema, out: Counter, at: str = "") -> None:
    """Counts the forms of the strings and arrays of known fields (name empty) and of the members that are open."""
    if not isinstance(v, dict):
        return
    wanted, moved = schema.members.get(at, {}), dict(renames.get(at, ()))
    for k, x in v.items():
        name = k if k in wanted else moved.get(k)
        if name is None:
            if (at, k) in open_ and x and isinstance(x, (str, list)):
                out[at, k, "", form(x)] += 1
            continue
        kind, path = wanted[name][0], f"{at}.{name}" if at else name
        if kind == "object":
            _forms(x, renames, open_, schema, out, path)
        elif f"{path}[]" in schema.members:
            for y in _items(x) or ():
                _forms(y, renames, open_, schema, out, path + "[]")
        elif k == name and x and fits(x, kind) and isinstance(x, (str, list)):
            out[at, "", name, form(x)] += 1


def field_rows(fields: DataFrame) -> list[tuple[str, str, bool]]:
    """The field table on the driver: it is the schema, one row for each field."""
    return sorted((r.field, r.json_type, bool(r.optional)) for r in fields.select("field", "json_type", "optional").filter("field is not null and json_type is not null").collect())


def _read(text: str | None) -> dict | None:
    """A file's object, or None if it holds none."""
    try:
        v = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _stringy(batch: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in batch.values()], names=list(batch))


def fingerprints(files: DataFrame, schema: Schema, content: bool = False) -> DataFrame:
    """Each delivery with its fingerprint, and the structure (JSON text) in the first of a task's deliveries that share it.

    A null or unreadable content, or one that is no object, has a null fingerprint.
    """
    names = schema.names()
    have = files.columns
    time = lambda c: (F.col(c) if c in have else F.lit(None)).cast("timestamp").alias(c)
    # the text itself decides between deliveries of one time; it is shuffled only where it is asked for
    src = files.filter("file_id is not null").select("content", "file_id", "doc_id", time("written_at"), time("received_at"), F.xxhash64("content").alias("text_hash"))
    kept = src.columns[0 if content else 1 :]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            prints, texts = [], []
            for text in b.column(0).to_pylist():
                v = _read(text)
                try:
                    form_ = None if v is None else json.dumps(structure(v, names))
                except RecursionError:
                    form_ = None
                if form_ is None:
                    prints.append(None)
                    texts.append(None)
                elif form_ in known:
                    prints.append(known[form_])
                    texts.append(None)
                else:
                    if len(known) > 100_000:
                        known.clear()
                    known[form_] = hashlib.md5(form_.encode()).hexdigest()
                    prints.append(known[form_])
                    texts.append(form_)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(prints, pa.string()), pa.array(texts, pa.string())], names=[*kept, "fingerprint", "structure"])

    return src.mapInArrow(run, f"{types}, fingerprint string, structure string")


def _taken(parsed: DataFrame) -> DataFrame:
    """Each file once: of a file delivered more than once the last ``received_at`` counts."""
    return latest(parsed.drop("structure"), ["file_id"]).drop("received_at", "text_hash")


def _decided(structures: DataFrame, schema: Schema) -> DataFrame:
    """fingerprint, structure, proof (optional) -> fingerprint, structure, steps, open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps, open_ = [], []
            for text, proof in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s, o = plan_steps(json.loads(text), schema, {tuple(p) for p in proof or ()})
                steps.append(s)
                open_.append(o)
            list_ = pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(steps, list_), pa.array(open_, list_)], names=["fingerprint", "structure", "steps", "open"])

    return structures.select("fingerprint", "structure", "proof").mapInArrow(run, "fingerprint string, structure string, steps array<array<string>>, open array<array<string>>")


def _proofs(files: DataFrame, parsed: DataFrame, decided: DataFrame, schema: Schema) -> DataFrame:
    """For the fingerprints with open renames: fingerprint and proof, the open renames that the forms of the values confirm.

    Every value of the open names and of all known fields counts, in every delivery of a file.
    """
    text = files.filter("file_id is not null and content is not null").select("content", F.xxhash64("content").alias("text_hash"))
    routed = parsed.select("text_hash", "fingerprint").distinct().join(decided.select("fingerprint", "steps", "open"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, steps, open_ in zip(*[b.column(c).to_pylist() for c in ("content", "steps", "open")]):
                _forms(_read(text), _renames(steps), {(at, k) for at, k, _ in open_}, schema, seen)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([k[i] for k in seen], pa.string()) for i in range(4)], pa.array(list(seen.values()), pa.int64())], names=["at", "name", "field", "form", "n"]
            )

    counts = text.join(routed, "text_hash").select("content", "steps", "open").mapInArrow(run, "at string, name string, field string, form string, n long")
    counts = counts.groupBy("at", "name", "field", "form").agg(F.sum("n").alias("n"))
    asked = decided.select("fingerprint", F.explode("open").alias("o")).select("fingerprint", *[F.col("o")[i].alias(c) for i, c in enumerate(("at", "name", "field"))])
    names = counts.filter("name <> ''").select("at", "name", "form", "n")
    fields = counts.filter("name = ''").select("at", "field", "form")
    total = names.groupBy("at", "name").agg(F.sum("n").alias("total"))
    alike = names.join(fields, ["at", "form"]).groupBy("at", "name", "field").agg(F.sum("n").alias("n"))
    proven = alike.join(total, ["at", "name"]).filter(F.col("n") >= FORM_SHARE * F.col("total")).select("at", "name", "field")
    return asked.join(proven, ["at", "name", "field"]).groupBy("fingerprint").agg(F.collect_set(F.array("at", "name", "field")).alias("proof"))


def _registry(files: DataFrame, parsed: DataFrame, schema: Schema) -> DataFrame:
    """fingerprint, structure, steps: the migration of each fingerprint, decided once."""
    structures = parsed.filter("structure is not null").groupBy("fingerprint").agg(F.max("structure").alias("structure"))
    decided = checkpoint(_decided(structures.withColumn("proof", F.lit(None).cast("array<array<string>>")), schema))
    open_ = decided.filter("size(open) > 0")
    if open_.isEmpty():
        return decided.select("fingerprint", "structure", "steps")
    again = open_.select("fingerprint", "structure").join(_proofs(files, parsed, decided, schema), "fingerprint")
    again = checkpoint(_decided(again, schema).select("fingerprint", "structure", "steps"))
    return decided.select("fingerprint", "structure", "steps").join(again.select("fingerprint"), "fingerprint", "left_anti").unionByName(again)


_CHANGE = pa.list_(pa.struct([("field", pa.string()), ("change", pa.string())]))


def route(files: DataFrame, fields: DataFrame) -> DataFrame:
    """Each file once with its fingerprint, steps and changes: file_id, doc_id, written_at, fingerprint, steps, changes.

    A null or unreadable content, or one that is no object, has null steps and the
    single change (``""``, ``unreadable``); an empty field table gives no changes.
    Extra columns do not matter. A fingerprint may have a third of all files; the
    table of fingerprints is the small side of its join.
    """
    schema = Schema.of(field_rows(fields))
    parsed = checkpoint(fingerprints(files, schema))
    return _routed(_taken(parsed), _registry(files, parsed, schema))


def _routed(taken: DataFrame, registry: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            changes = [[{"field": f, "change": c} for f, c in step_changes(s)] for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(changes, _CHANGE)], names=["fingerprint", "steps", "changes"])

    reported = registry.select("fingerprint", "steps").mapInArrow(run, "fingerprint string, steps array<array<string>>, changes array<struct<field:string,change:string>>")
    none = F.array(F.struct(F.lit("").alias("field"), F.lit("unreadable").alias("change")))
    return taken.join(reported, "fingerprint", "left").withColumn("changes", F.when(F.col("fingerprint").isNull(), none).otherwise(F.col("changes")))


def change_report(routed: DataFrame) -> DataFrame:
    """One row for each file, field and change; unreadable files are no change (``p4_registry`` counts them)."""
    return routed.select("file_id", F.explode("changes").alias("c")).select("file_id", "c.field", "c.change").filter("change <> 'unreadable'")


def schema_registry(files: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for each schema fingerprint: fingerprint, files, first_written, last_written, steps.

    Unreadable files stand under a null fingerprint with null steps.
    """
    routed = route(files, fields)
    seen = routed.groupBy("fingerprint").agg(F.count("*").alias("files"), F.min("written_at").alias("first_written"), F.max("written_at").alias("last_written"))
    steps = routed.groupBy("fingerprint").agg(F.first("steps", True).alias("steps"))
    return seen.join(steps, seen["fingerprint"].eqNullSafe(steps["fingerprint"])).select(seen["fingerprint"], "files", "first_written", "last_written", F.transform("steps", lambda s: F.array_join(s, " ")).alias("steps"))


def _ddl(schema: Schema, at: str = "") -> str:
    parts = []
    for name, (kind, _) in schema.members.get(at, {}).items():
        path = f"{at}.{name}" if at else name
        if kind == "object":
            ddl = f"struct<{_ddl(schema, path)}>"
        elif f"{path}[]" in schema.members:
            ddl = f"array<struct<{_ddl(schema, path + '[]')}>>"
        else:
            base = {"integer": "bigint", "number": "double", "string": "string", "boolean": "boolean"}
            item = kind.partition(" of ")[2]
            ddl = f"array<{base.get(item, 'string')}>" if kind.startswith("array") else base.get(kind, "string")
        parts.append(f"`{name}`:{ddl}")
    return ",".join(parts)


def consistent_table(files: DataFrame, fields: DataFrame) -> DataFrame:
    """The files as one typed table in the wanted schema, each by the steps of its fingerprint; an unreadable file has null fields."""
    schema = Schema.of(field_rows(fields))
    parsed = checkpoint(fingerprints(files, schema, content=True))
    routed = _taken(parsed).join(_registry(files, parsed, schema).select("fingerprint", "steps"), "fingerprint", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = []
            for text, steps in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                v = _read(text) if steps is not None else None
                records.append(None if v is None else json.dumps(take_steps(v, _renames(steps), schema), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(records, pa.string())], names=["file_id", "doc_id", "schema_fingerprint", "record"])

    records = routed.select("file_id", "doc_id", "fingerprint", "content", "steps").mapInArrow(run, "file_id string, doc_id string, schema_fingerprint string, record string")
    return records.select("file_id", "doc_id", "schema_fingerprint", F.from_json("record", f"struct<{_ddl(schema)}>").alias("r")).select("file_id", "doc_id", "schema_fingerprint", "r.*")
