"""Registered queries of the core: name -> function of the session and the data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators import drift, flatten
from pagemill.plans import contracts, documents, elements, events, identity  # noqa: F401
from pagemill.plans.registry import QUERIES, SQL, query  # noqa: F401
from pagemill.runtime import table


#: The same children by the database's own walk over JSON: texts inside are opened in turn, places are those of the walk.
_P3 = r"""WITH RECURSIVE c AS (SELECT candidate_id, arg_max(doc_id, coalesce(received_at, TIMESTAMP '1970-01-01')) AS doc_id, arg_max(evidence, coalesce(received_at, TIMESTAMP '1970-01-01')) AS e FROM review_candidates WHERE candidate_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT candidate_id, doc_id, CAST([] AS UBIGINT[]) AS pre, '' AS base, e AS doc FROM c WHERE json_valid(e)
  UNION ALL SELECT t.candidate_id, t.doc_id, list_append(t.pre, j.id), t.base || substr(j.fullkey, 2), j.atom ->> '$' FROM t, json_tree(t.doc) j
  WHERE j.type = 'VARCHAR' AND regexp_matches(j.atom ->> '$', '^\s*[\[{"]') AND json_valid(j.atom ->> '$')),
n AS (SELECT t.candidate_id, t.doc_id, t.pre, j.id, j.parent, j.type, j.atom ->> '$' AS v, j.value AS o, regexp_replace(regexp_replace(t.base || substr(j.fullkey, 2), '\[\d+\]', '[]', 'g'), '"', '', 'g') AS p FROM t, json_tree(t.doc) j),
e AS (SELECT candidate_id, doc_id, list_append(pre, id) AS slot, p, CAST(NULL AS VARCHAR) AS child FROM n WHERE regexp_matches(p, '(^|\.)(source|caption|member)_geometry(\[\]|\.blocks)*$') AND ((type = 'NULL' AND suffix(p, '[]')) OR (type = 'OBJECT' AND json_extract(o, '$.blocks') IS NULL))
  UNION ALL SELECT x.candidate_id, x.doc_id, list_append(x.pre, CASE WHEN suffix(x.p, '.block.id') THEN y.parent ELSE x.parent END), x.p, x.v FROM n x JOIN n y ON y.candidate_id = x.candidate_id AND y.pre = x.pre AND y.id = x.parent
    WHERE regexp_matches(x.p, '(^|\.)(source|caption|member)_geometry(\[\]|\.blocks)*\.(block_id|block\.id)$') AND x.type <> 'NULL'),
s AS (SELECT candidate_id, doc_id, slot, regexp_extract(p, '(source|caption|member)_geometry', 0) AS path, list(DISTINCT child) FILTER (child IS NOT NULL) AS ids FROM e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, path ORDER BY slot) - 1 AS pos FROM s),
b AS (SELECT id, arg_max(doc_id, received_at) AS doc_id, arg_max(source_spans, received_at) AS a FROM reader_blocks WHERE id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
g AS (SELECT doc_id, id, arg_max(member_block_ids, received_at) AS a FROM visual_groups WHERE id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, candidate_id AS record_id, path, CAST(pos AS INTEGER) AS pos, unnest(ids) AS child_id FROM o
UNION ALL SELECT doc_id, id, 'source_spans', CAST(i - 1 AS INTEGER), coalesce(a[i].region_id, '') FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM b WHERE len(a) > 0) WHERE a[i] IS NOT NULL
UNION ALL SELECT doc_id, id, 'member_block_ids', CAST(i - 1 AS INTEGER), a[i] FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM g WHERE len(a) > 0) WHERE a[i] IS NOT NULL"""


@query(_P3)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Children of nested records with their parent and place."""
    return flatten.flat_children(table(spark, d, "review_candidates"), table(spark, d, "reader_blocks"), table(spark, d, "visual_groups"))


@query()
def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the three nested columns, as the flat tables of their schema paths."""
    nodes = flatten.nested_nodes(table(spark, d, "review_candidates"), table(spark, d, "reader_blocks"), table(spark, d, "visual_groups"))
    return flatten.path_tables(nodes, ["doc_id", "record_id", "source"])


@query(
    """SELECT DISTINCT doc_id, id AS record_id, CAST(i - 1 AS INTEGER) AS pos, source_spans[i].page_index AS page_index, source_spans[i].bbox.x AS x,
    source_spans[i].bbox.y AS y, source_spans[i].bbox.width AS width, source_spans[i].bbox.height AS height, source_spans[i].region_id AS region_id
    FROM (SELECT *, unnest(range(1, len(source_spans) + 1)) AS i FROM reader_blocks WHERE len(source_spans) > 0) WHERE source_spans[i] IS NOT NULL"""
)
def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """Source spans of the blocks as a flat table."""
    return flatten.span_table(table(spark, d, "reader_blocks"))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each file against the wanted schema."""
    return drift.change_report(drift.route(table(spark, d, "visual_repair_files"), table(spark, d, "visual_repair_fields")))


@query()
def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All files in the wanted schema."""
    return drift.consistent_table(table(spark, d, "visual_repair_files"), table(spark, d, "visual_repair_fields"))


@query()
def p4_registry(spark: SparkSession, d: str) -> DataFrame:
    """Schema fingerprints with their files, times and migration steps."""
    return drift.schema_registry(table(spark, d, "visual_repair_files"), table(spark, d, "visual_repair_fields"))
