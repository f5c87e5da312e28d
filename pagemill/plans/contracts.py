"""Queries over contracts, manifests, groups and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import patterns as P
from pagemill.operators import elements as E
from pagemill.operators import integrity as I
from pagemill.plans.registry import query, quoted
from pagemill.runtime import latest, table

_B = "b AS (SELECT DISTINCT ON (id) * FROM reader_blocks WHERE id IS NOT NULL)"
_SPAN = """len(list_filter(source_spans, lambda s: s IS NULL OR s.bbox IS NULL OR NOT coalesce(s.bbox.x >= 0 AND s.bbox.y >= 0 AND s.bbox.width > 0 AND s.bbox.height > 0
  AND s.bbox.x + s.bbox.width <= 1 AND s.bbox.y + s.bbox.height <= 1, false) OR NOT coalesce(s.page_index >= 0, false))) > 0"""
_SLOT = "kind = 'visual_slot'"
_RULES = {
    "invalid-block-kind": f"NOT coalesce(kind IN ({', '.join(map(quoted, I.BLOCK_KINDS))}), false)",
    "invalid-block-id": f"NOT coalesce(CASE WHEN {_SLOT} THEN regexp_matches(id, {quoted(P.SLOT_ID)}) ELSE regexp_matches(id, {quoted(P.BLOCK_ID)}) END, false)",
    "invalid-block-anchor": f"NOT coalesce(anchor.syntax = CASE WHEN {_SLOT} THEN 'p2md:slot' ELSE 'p2md:block' END AND anchor.id = id, false)",
    "invalid-block-fingerprint": f"NOT coalesce(regexp_matches(fingerprint.visible_text_sha256, {quoted(P.SHA256)}) AND regexp_matches(fingerprint.simhash64, {quoted(P.HEX16)}) AND fingerprint.text_length >= 0, false)",
    "invalid-slot-asset": f"{_SLOT} AND NOT coalesce(regexp_matches(asset_id, {quoted(P.ASSET_ID)}), false)",
    "invalid-block-asset": f"NOT ({_SLOT}) AND asset_id IS NOT NULL",
    "missing-source-span": "kind <> 'title' AND coalesce(len(source_spans), 0) < 1",
    "invalid-source-span": _SPAN,
}


@query(f"WITH {_B} " + " UNION ALL ".join(f"SELECT id, {quoted(k)} AS code FROM b WHERE {v}" for k, v in _RULES.items()))
def block_checks(spark: SparkSession, d: str) -> DataFrame:
    """JSN-02, JSN-05, PRD-20: faults of single blocks."""
    return I.block_checks(table(spark, d, "reader_blocks"))


@query(
    f"""WITH {_B}, p AS (SELECT doc_id, count(*) FILTER (kind = 'title') AS titles, arg_min(kind, block_order) AS first, count(DISTINCT block_order) AS orders, count(block_order) AS ordered FROM b GROUP BY 1)
    SELECT doc_id, 'invalid-title-block' AS code, titles AS n FROM p WHERE NOT coalesce(first = 'title' AND titles = 1, false)
    UNION ALL SELECT doc_id, 'duplicate-block-order', ordered - orders FROM p WHERE orders < ordered
    UNION ALL SELECT doc_id, 'asset-reused', count(*) FROM (SELECT doc_id, asset_id FROM b WHERE asset_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"""
)
def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-02, JSN-02: faults of whole contracts."""
    return I.contract_checks(table(spark, d, "reader_blocks"))


_FAULTS = " UNION ALL ".join(f"SELECT doc_id FROM b WHERE {v}" for v in _RULES.values())


@query(
    f"""WITH {_B}, c AS (SELECT doc_id, count(*) FILTER (kind = 'title') AS titles, arg_min(kind, block_order) AS first, count(DISTINCT block_order) AS orders, count(block_order) AS ordered FROM b GROUP BY 1),
    bad AS (SELECT doc_id, count(*) AS faults FROM ({_FAULTS}
      UNION ALL SELECT doc_id FROM c WHERE NOT coalesce(first = 'title' AND titles = 1, false) UNION ALL SELECT doc_id FROM c WHERE orders < ordered
      UNION ALL SELECT DISTINCT doc_id FROM (SELECT doc_id, asset_id FROM b WHERE asset_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY 1),
    w AS (SELECT doc_id, id FROM b WHERE doc_id IS NOT NULL), h AS (SELECT doc_id, anchor.id AS id, count(*) AS n FROM b WHERE anchor.id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
    j AS (SELECT coalesce(w.doc_id, h.doc_id) AS doc_id, w.id AS w, h.id AS h, h.n > 1 OR NOT (regexp_matches(h.id, {quoted(P.BLOCK_ID)}) OR regexp_matches(h.id, {quoted(P.SLOT_ID)})) AS odd FROM w FULL JOIN h ON w.doc_id = h.doc_id AND w.id = h.id),
    p AS (SELECT doc_id, count(w) AS expected, count(*) FILTER (h IS NULL) AS missing, count(*) FILTER (w IS NULL) AS unexpected, count(*) FILTER (odd) AS repeated FROM j GROUP BY 1)
    SELECT p.*, coalesce(faults, 0) AS faults, CASE WHEN faults > 0 THEN 'invalid-contract' WHEN repeated > 0 OR unexpected > 0 THEN 'ambiguous' WHEN missing > 0 THEN 'recoverable' ELSE 'valid' END AS state
    FROM p LEFT JOIN bad USING (doc_id)"""
)
def anchor_state(spark: SparkSession, d: str) -> DataFrame:
    """SET-01, SET-02: state of each package by its anchors."""
    return I.anchor_state(table(spark, d, "reader_blocks"))


@query(f"WITH {_B} SELECT doc_id, kind, count(*) AS blocks, coalesce(sum(fingerprint.text_length), 0)::BIGINT AS chars, count(DISTINCT lower(fingerprint.visible_text_sha256)) AS texts FROM b GROUP BY GROUPING SETS ((doc_id, kind), (kind), ())")
def block_totals(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by package and kind, with subtotals."""
    b = latest(table(spark, d, "reader_blocks").filter("id is not null"), ["id"])
    b = b.select("doc_id", "kind", F.col("fingerprint.text_length").alias("len"), F.lower("fingerprint.visible_text_sha256").alias("sha"))
    return b.groupingSets([["doc_id", "kind"], ["kind"], []], "doc_id", "kind").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("len"), F.lit(0)).alias("chars"), F.countDistinct("sha").alias("texts"))


_F = "f AS (SELECT package_id, i - 1 AS pos, outputs[i].path AS path, outputs[i].size AS size, lower(outputs[i].sha256) AS sha256 FROM (SELECT *, unnest(range(1, len(outputs) + 1)) AS i FROM manifests WHERE len(outputs) > 0) WHERE outputs[i] IS NOT NULL)"
_SAFE = f"""coalesce(length(path) > 0 AND path = regexp_replace(path, {quoted(P.TRIM)}, '', 'g') AND NOT regexp_matches(path, '\\\\|\\x{{00}}|^/') AND len(string_split(path, '/')) <= 24
  AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..') OR length(s) > 255 OR regexp_matches(s, {quoted(P.BAD_SEGMENT)}))) = 0, false)"""


@query(f"WITH {_F} SELECT package_id, pos, path, size, sha256, {_SAFE} AS safe FROM f")
def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """SNK-08, PRD-02, STR-74: output files of the manifests."""
    from pagemill.functions.paths import is_safe_package_path

    f = I.manifest_files(table(spark, d, "manifests"))
    return f.withColumn("safe", is_safe_package_path(F.col("path")))


@query(
    f"""WITH {_F} SELECT package_id, pos, 'invalid-path' AS code FROM f WHERE NOT {_SAFE}
    UNION ALL SELECT package_id, pos, 'invalid-size' FROM f WHERE NOT coalesce(size BETWEEN 1 AND {I.FILE_BYTES}, false)
    UNION ALL SELECT package_id, pos, 'invalid-hash' FROM f WHERE NOT coalesce(regexp_matches(sha256, {quoted(P.SHA256)}), false)
    UNION ALL SELECT package_id, pos, 'conflicting-path' FROM (SELECT *, count(*) OVER (PARTITION BY package_id, lower(path)) AS n FROM f WHERE path IS NOT NULL) WHERE n > 1"""
)
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06, SET-07, JOIN-04: faults of file records."""
    return I.file_checks(table(spark, d, "manifests"))


@query(f"WITH {_F} SELECT package_id, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(sum(size), 0) <= {I.PACKAGE_BYTES} AS within FROM f GROUP BY 1")
def package_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14: files and bytes of each package."""
    return I.package_totals(table(spark, d, "manifests"))


_EXPECTED = ("article.md", "paper_content_list.json")


@query(
    f"""WITH {_F}, w AS (SELECT DISTINCT package_id, unnest([{", ".join(map(quoted, _EXPECTED))}]) AS path FROM manifests), h AS (SELECT DISTINCT package_id, path FROM f WHERE path IS NOT NULL)
    SELECT coalesce(w.package_id, h.package_id) AS package_id, coalesce(w.path, h.path) AS path, CASE WHEN h.path IS NULL THEN 'missing' ELSE 'unexpected' END AS side
    FROM w FULL JOIN h ON w.package_id = h.package_id AND w.path = h.path WHERE w.path IS NULL OR h.path IS NULL"""
)
def package_inventory(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-07, JOIN-16, SNK-24: files against the expected ones."""
    return I.inventory(table(spark, d, "manifests"), _EXPECTED)


_ISO = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,3})?Z$"


@query(
    f"""SELECT package_id, created_at, coalesce(regexp_matches(created_at, {quoted(_ISO)}), false) AS canonical,
    CASE WHEN regexp_matches(schema_version, '^v?\\d+(?:\\.\\d+)*$') THEN regexp_replace(schema_version, '^v', '') END AS version, coalesce(schema_version IN ('v0.8', 'v0.9', 'v0.10'), false) AS supported FROM manifests"""
)
def manifest_versions(spark: SparkSession, d: str) -> DataFrame:
    """DAT-01, DAT-02, PRD-37: times and versions of the manifests."""
    v = F.col("schema_version")
    return table(spark, d, "manifests").select(
        "package_id", "created_at", F.coalesce(F.col("created_at").rlike(_ISO), F.lit(False)).alias("canonical"),
        F.when(v.rlike(r"^v?\d+(?:\.\d+)*$"), F.regexp_replace(v, "^v", "")).alias("version"), F.coalesce(v.isin("v0.8", "v0.9", "v0.10"), F.lit(False)).alias("supported"),
    )


_G = "g AS (SELECT DISTINCT ON (doc_id, id) * FROM visual_groups WHERE doc_id IS NOT NULL AND id IS NOT NULL)"


@query(
    f"""WITH {_G} SELECT doc_id, id, decision, confidence, CASE WHEN confidence IS NULL OR decision IS NULL THEN 'incomplete'
    WHEN decision = CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.65 THEN 'review' ELSE 'skip' END THEN 'valid' ELSE 'invalid' END AS verdict FROM g"""
)
def group_decisions(spark: SparkSession, d: str) -> DataFrame:
    """JSN-09, JSN-13: decisions against the confidence."""
    return I.decisions(table(spark, d, "visual_groups"))


@query(
    f"""WITH {_G} SELECT doc_id, id, list_sort(list_distinct(list_filter(list_transform(coalesce(reason_codes, []), lambda x: lower(x)), lambda x: regexp_matches(x, '^[a-z][a-z0-9_]*$')))) AS reasons,
    len(coalesce(reason_codes, [])) = len(list_distinct(coalesce(reason_codes, []))) AS distinct_codes,
    CAST(json_extract_string(signals, '$.member_count') AS INTEGER) AS member_count, CAST(json_extract_string(signals, '$.adjacent_pair_count') AS INTEGER) AS adjacent_pair_count,
    CAST(json_extract_string(signals, '$.union_area_fraction') AS DOUBLE) AS union_area_fraction FROM g"""
)
def group_signals(spark: SparkSession, d: str) -> DataFrame:
    """JSN-18, JSN-21, SET-03: listed signals and codes of the groups."""
    g = latest(table(spark, d, "visual_groups").filter("doc_id is not null and id is not null"), ["doc_id", "id"])
    given = F.coalesce("reason_codes", F.array().cast("array<string>"))
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(given, F.lower), lambda x: x.rlike(r"^[a-z][a-z0-9_]*$"))))
    s = F.from_json("signals", "member_count int, adjacent_pair_count int, union_area_fraction double")
    return g.select("doc_id", "id", codes.alias("reasons"), (F.size(given) == F.size(F.array_distinct(given))).alias("distinct_codes"), s.alias("s")).select("doc_id", "id", "reasons", "distinct_codes", "s.*")


@query(
    f"""WITH {_G}, a AS (SELECT DISTINCT doc_id, id, unnest(member_asset_paths) AS path FROM g), e AS (SELECT DISTINCT doc_id, img_path AS path FROM paper_content_list WHERE img_path IS NOT NULL)
    SELECT a.doc_id, a.id, a.path FROM a WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = a.doc_id AND e.path = a.path)"""
)
def missing_assets(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10, JOIN-13: assets of groups that no element has."""
    g = table(spark, d, "visual_groups").select("doc_id", "id", F.explode("member_asset_paths").alias("path")).filter("doc_id is not null and id is not null and path is not null").distinct()
    have = table(spark, d, "paper_content_list").select("doc_id", F.col("img_path").alias("path")).filter("path is not null").distinct()
    return g.join(have, ["doc_id", "path"], "left_anti").select("doc_id", "id", "path")


@query(
    """WITH g AS (SELECT DISTINCT doc_id, id, unnest(member_block_ids) AS member FROM visual_groups) SELECT doc_id, member, count(DISTINCT id) AS groups FROM g WHERE member IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) > 1"""
)
def claimed_twice(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17, JOIN-28: blocks that several groups claim."""
    g = table(spark, d, "visual_groups").select("doc_id", "id", F.explode("member_block_ids").alias("member")).filter("member is not null").distinct()
    return g.groupBy("doc_id", "member").agg(F.count("*").alias("groups")).filter("groups > 1")


@query(
    """WITH c AS (SELECT DISTINCT doc_id, candidate_id, kind FROM review_candidates), p AS (SELECT doc_id, count(*) AS candidates, count(DISTINCT kind) AS kinds FROM c GROUP BY 1)
    SELECT *, CASE WHEN candidates > 128 THEN 'too-many' ELSE 'ready' END AS status FROM p"""
)
def review_packages(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: candidates of each document."""
    return I.review_package(table(spark, d, "review_candidates"))


@query(
    """SELECT 'orders' AS child, 'customer' AS parent, count(*) AS dangling FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
    UNION ALL SELECT 'lineitem', 'orders', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
    UNION ALL SELECT 'lineitem', 'part', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
    UNION ALL SELECT 'lineitem', 'supplier', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)"""
)
def referential_issues(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-02 on other tables: children without a parent."""
    pairs = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))
    out = None
    for child, key, parent, pkey in pairs:
        left, right = table(spark, d, child).select(key), table(spark, d, parent).select(pkey)
        part = left.join(right, left[key] == right[pkey], "left_anti").agg(F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.count("*").alias("dangling"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH c AS (SELECT lower(fingerprint.visible_text_sha256) AS k, count(DISTINCT id) AS n, min(id) AS id FROM reader_blocks WHERE kind = 'caption' GROUP BY 1 HAVING count(DISTINCT id) = 1),
    f AS (SELECT lower(fingerprint.visible_text_sha256) AS k, count(DISTINCT id) AS n, min(id) AS id FROM reader_blocks WHERE kind = 'body' GROUP BY 1 HAVING count(DISTINCT id) = 1)
    SELECT c.id AS caption_id, f.id AS body_id FROM c JOIN f ON c.k = f.k"""
)
def unique_repeats(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-35, JOIN-43: captions and body blocks of the same text where there is one of each."""
    b = table(spark, d, "reader_blocks").select("id", "kind", F.lower("fingerprint.visible_text_sha256").alias("k")).filter("k is not null").distinct()
    side = lambda kind, name: b.filter(F.col("kind") == kind).select("k", F.col("id").alias(name))
    return I.unique_matches(side("caption", "caption_id"), side("body", "body_id"), "k").select("caption_id", "body_id")


@query("SELECT e.doc_id, count(*) AS elements, any_value(m.backend) AS backend FROM (SELECT DISTINCT doc_id, source_index FROM paper_content_list) e JOIN manifests m ON m.package_id = e.doc_id WHERE m.kind = 'extraction' GROUP BY 1")
def bound_elements(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05, JOIN-05: elements of packages that a manifest lists; counted before they are joined, so a large package is one row."""
    per = E.delivered_once(table(spark, d, "paper_content_list").select("doc_id", "source_index")).groupBy("doc_id").agg(F.count("*").alias("elements"))
    m = table(spark, d, "manifests").filter("kind = 'extraction'").select(F.col("package_id").alias("doc_id"), "backend")
    return per.join(m, "doc_id")


@query(
    f"""WITH {_F}, v AS (SELECT arg_max(doc_id, received_at) AS package_id, arg_max(path, received_at) AS path, arg_max(content, received_at) AS content FROM visual_repair_files WHERE file_id IS NOT NULL GROUP BY file_id),
    h AS (SELECT DISTINCT package_id, path, strlen(content) AS size, sha256(content) AS sha256 FROM v WHERE package_id IS NOT NULL AND path IS NOT NULL),
    r AS (SELECT DISTINCT package_id, path, size, sha256 FROM f WHERE path IS NOT NULL)
    SELECT coalesce(r.package_id, h.package_id) AS package_id, coalesce(r.path, h.path) AS path, CASE WHEN h.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'unexpected' WHEN h.size IS DISTINCT FROM r.size THEN 'size-differs'
      WHEN h.sha256 IS DISTINCT FROM r.sha256 THEN 'hash-differs' ELSE 'bound' END AS status FROM r FULL JOIN h ON r.package_id = h.package_id AND r.path = h.path"""
)
def bound_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05, JOIN-04, SET-06: the written files against the records of the manifests, size and digest recomputed."""
    v = latest(table(spark, d, "visual_repair_files").filter("file_id is not null").select("file_id", "doc_id", "path", "content", "received_at"), ["file_id"])
    files = v.filter("doc_id is not null and path is not null").select(F.col("doc_id").alias("package_id"), "path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256")).distinct()
    records = I.manifest_files(table(spark, d, "manifests")).select("package_id", "path", "size", "sha256").filter("path is not null").distinct()
    return I.bind(files, records)


_PAD = "array_to_string(list_transform(regexp_extract_all(lower(path), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d{1,20}$') THEN lpad(x, 20, '0') ELSE x END), '')"


@query(f"WITH {_F}, p AS (SELECT DISTINCT package_id, path FROM f WHERE path IS NOT NULL) SELECT package_id, path, row_number() OVER (PARTITION BY package_id ORDER BY {_PAD}, path) AS nth FROM p")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """TOPK-10: the files of each package with the numbers in their names in order."""
    f = I.manifest_files(table(spark, d, "manifests")).select("package_id", "path").filter("path is not null").distinct()
    return f.withColumn("nth", F.row_number().over(Window.partitionBy("package_id").orderBy(I.natural_key(F.col("path")), "path")))


_SAFE_ID, _SAFE_CODE = r"^[A-Za-z0-9_.:\-]{1,200}$", r"^[a-z0-9][a-z0-9_.:-]{0,119}$"


@query(
    f"""WITH c AS (SELECT candidate_id, arg_max(evidence, coalesce(received_at, TIMESTAMP '1970-01-01')) AS evidence FROM review_candidates WHERE candidate_id IS NOT NULL GROUP BY 1),
    j AS (SELECT candidate_id, CASE WHEN json_valid(evidence) THEN evidence END AS e FROM c),
    l AS (SELECT candidate_id, CASE WHEN json_type(e, '$.caption_anchor_block_ids') = 'ARRAY' THEN CAST(json_extract(e, '$.caption_anchor_block_ids') AS VARCHAR[]) ELSE [] END AS ids,
      CASE WHEN json_type(e, '$.reason_codes') = 'ARRAY' THEN CAST(json_extract(e, '$.reason_codes') AS VARCHAR[]) ELSE [] END AS codes FROM j)
    SELECT candidate_id, list_sort(list_distinct(list_filter(list_transform(ids, lambda x: trim(x)), lambda x: regexp_matches(x, {quoted(_SAFE_ID)})))) AS anchors,
    list_sort(list_distinct(list_filter(list_transform(codes, lambda x: lower(trim(x))), lambda x: regexp_matches(x, {quoted(_SAFE_CODE)})))) AS codes FROM l"""
)
def evidence_codes(spark: SparkSession, d: str) -> DataFrame:
    """JSN-20, JSN-21: safe anchors and codes of the evidence where it lists them at its top."""
    c = latest(table(spark, d, "review_candidates").filter("candidate_id is not null").select("candidate_id", "evidence", "received_at"), ["candidate_id"])
    safe = lambda col, change, pattern: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), change), lambda x: x.rlike(pattern))))
    e = F.from_json("evidence", "caption_anchor_block_ids array<string>, reason_codes array<string>")
    return c.select("candidate_id", e.alias("e")).select(
        "candidate_id", safe(F.col("e.caption_anchor_block_ids"), lambda x: F.trim(x), _SAFE_ID).alias("anchors"), safe(F.col("e.reason_codes"), lambda x: F.lower(F.trim(x)), _SAFE_CODE).alias("codes")
    )
