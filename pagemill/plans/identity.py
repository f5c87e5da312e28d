"""Queries over the titles, URLs, paths and captions of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions import paths as Q
from pagemill.functions import text as X
from pagemill.plans.registry import query, quoted
from pagemill.runtime import table

#: White space as the engine counts it.
_SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_LINKS = r"https?://[^\s<>()\[\]\"']+"
#: What a reader may ask for: the first lines of the documents and the URLs in their texts, each distinct one once.
_ASKED = f"""q AS (SELECT regexp_replace(regexp_extract(text, '^[^\\n\\r]*'), '^#+ *', '') AS t FROM documents WHERE text IS NOT NULL
  UNION SELECT unnest(regexp_extract_all(text, {quoted(_LINKS)})) FROM documents WHERE text IS NOT NULL)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(_LINKS), F.lit(0))).alias("t")).distinct()


_T = f"regexp_replace(t, {quoted(P.TRIM)}, '', 'g')"
_DOI = "lower(regexp_replace(regexp_extract(%s, " + quoted(P.DOI) + ", 1), '[.,;]+$', ''))"
_QUERY = f"""WITH {_ASKED}, u AS (SELECT t, {_T} AS x, lower(regexp_extract(t, {quoted(P.URL)}, 2)) AS host, regexp_extract(t, {quoted(P.URL)}, 3) AS path, regexp_matches(t, {quoted(P.URL)}) AS ok FROM q),
k AS (SELECT t, CASE WHEN x = '' OR length(x) > 2048 THEN 'error:length' WHEN regexp_matches(x, {quoted(P.PMCID)}) THEN 'pmcid:' || upper(regexp_extract(x, {quoted(P.PMCID)}, 1))
  WHEN regexp_matches(x, {quoted(P.PMID)}) THEN 'pmid:' || regexp_extract(x, {quoted(P.PMID)}, 1) WHEN regexp_matches(x, {quoted(P.DOI)}) THEN 'doi:' || {_DOI % 'x'}
  WHEN regexp_matches(x, {quoted(P.ID_PREFIX)}) THEN 'error:identifier' WHEN ok AND contains(host, '@') THEN 'error:url'
  WHEN ok AND host IN ('doi.org', 'dx.doi.org') THEN 'doi:' || {_DOI % "regexp_replace(path, '^/+', '')"}
  WHEN ok AND host = 'pubmed.ncbi.nlm.nih.gov' THEN 'pmid:' || regexp_extract(path, '^/(\\d{{1,9}})/?$', 1)
  WHEN ok AND host = 'pmc.ncbi.nlm.nih.gov' THEN 'pmcid:' || upper(regexp_extract(path, '(?i)^/articles/(PMC\\d+)/?$', 1))
  WHEN ok AND host = 'europepmc.org' THEN 'pmid:' || regexp_extract(path, '^/article/MED/(\\d{{1,9}})/?$', 1)
  WHEN ok THEN 'url:' || regexp_replace(x, '#.*$', '') WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'error:url'
  WHEN length(regexp_replace(x, {quoted(_SPACE)}, ' ', 'g')) < 4 THEN 'error:title' ELSE 'title:' || regexp_replace(x, {quoted(_SPACE)}, ' ', 'g') END AS r FROM u)
SELECT t, regexp_extract(r, '^([a-z]+):', 1) AS kind, substr(r, strpos(r, ':') + 1) AS value FROM k"""


@query(_QUERY)
def paper_queries(spark: SparkSession, d: str) -> DataFrame:
    """PRD-17, PRD-18, PRD-19: kinds of paper queries, over the titles and URLs of the documents."""
    first = F.regexp_replace(F.regexp_extract("text", r"^[^\n\r]*", 0), "^#+ *", "")
    df = table(spark, d, "documents").filter("text is not null").select(first.alias("t")).union(_links(spark, d)).distinct()
    return df.select("t", Q.paper_query(F.col("t")).alias("q")).select("t", "q.kind", "q.value")


_HOST = f"lower(regexp_replace(regexp_replace(regexp_extract(t, {quoted(P.URL)}, 2), '^.*@', ''), ':\\d+$', ''))"


@query(
    f"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(text, {quoted(_LINKS)})) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT t, {_HOST} AS host, regexp_matches(t, {quoted(P.URL)}) AS ok, contains(regexp_extract(t, {quoted(P.URL)}, 2), '@') AS cred FROM u),
    f AS (SELECT *, ok AND NOT cred AND contains(host, '.') AND NOT regexp_matches(host, '^\\[|(?:^|\\.)localhost$|\\.local$')
      AND NOT regexp_matches(host, '^(?:0|10|127|22[4-9]|2[3-5]\\d)\\.\\d+\\.\\d+\\.\\d+$|^192\\.(?:0|168)\\.\\d+\\.\\d+$|^172\\.(?:1[6-9]|2\\d|3[01])\\.\\d+\\.\\d+$|^169\\.254\\.|^100\\.(?:6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])\\.') AS fetchable FROM h)
    SELECT t, fetchable, CASE WHEN fetchable AND starts_with(t, 'https:') THEN regexp_replace(t, '#.*$', '') END AS public FROM f"""
)
def url_checks(spark: SparkSession, d: str) -> DataFrame:
    """PRD-12 to PRD-16: which URLs of the documents may be fetched."""
    df = _links(spark, d)
    return df.select("t", Q.is_fetchable_url(F.col("t")).alias("fetchable"), Q.public_https_url(F.col("t")).alias("public"))


@query(
    f"""WITH p AS (SELECT unnest(outputs).path AS path FROM manifests UNION SELECT img_path FROM paper_content_list UNION SELECT path FROM visual_repair_files)
    SELECT path, length(path) > 0 AND NOT regexp_matches(path, '\\\\|^[a-zA-Z]:|^/') AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS relative,
    length(path) > 0 AND path = trim(path) AND NOT regexp_matches(path, '\\\\|^/') AND len(string_split(path, '/')) <= 24
      AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..') OR length(s) > 255 OR regexp_matches(s, {quoted(P.BAD_SEGMENT)}))) = 0 AS packaged FROM p WHERE path IS NOT NULL"""
)
def stored_path_checks(spark: SparkSession, d: str) -> DataFrame:
    """PRD-01, PRD-02: which paths of the tables are safe, each distinct one once."""
    paths = table(spark, d, "manifests").select(F.explode("outputs.path").alias("path"))
    paths = paths.union(table(spark, d, "paper_content_list").select("img_path")).union(table(spark, d, "visual_repair_files").select("path"))
    df = paths.filter("path is not null").distinct()
    return df.select("path", Q.is_safe_relative(F.col("path")).alias("relative"), Q.is_safe_package_path(F.col("path")).alias("packaged"))


_P = "regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[_-]+', ' ', 'g')"
_LABELS = (("(?i)\\bExtended\\s+Data\\s+Fig(?:ure)?\\.?", "Extended Data Fig. "), ("(?i)\\bSupp(?:lementary)?\\s+Fig(?:ure)?\\.?", "Supplementary Fig. "), ("(?i)\\bFig(?:ure)?\\.?", "Fig. "), ("(?i)\\bTable", "Table "), ("(?i)[图表]", "图 "))
_CASES = " ".join(f"WHEN regexp_matches({_P}, {quoted(a + _N)}) THEN {quoted(b)} || regexp_extract({_P}, {quoted(a + _N)}, 1)" for _N in ["\\s*([A-Za-z]?\\d+[A-Za-z]?)\\b"] for a, b in _LABELS)


#: A Chinese label is one of a table wherever the caption names one.
_STATED = _CASES.replace(quoted("图 "), f"CASE WHEN contains({_P}, '表') THEN '表 ' ELSE '图 ' END")


@query(
    f"""WITH c AS (SELECT unnest(image_caption) AS t FROM paper_content_list UNION SELECT unnest(table_caption) FROM paper_content_list)
    SELECT t, CASE {_STATED} END AS label FROM c WHERE t IS NOT NULL"""
)
def caption_labels(spark: SparkSession, d: str) -> DataFrame:
    """STR-22, STR-24: labels that the captions of the tables state, each distinct caption once."""
    rows = table(spark, d, "paper_content_list")
    captions = rows.select(F.explode("image_caption").alias("t")).union(rows.select(F.explode("table_caption"))).filter("t is not null").distinct()
    return captions.select("t", X.explicit_label(F.col("t")).alias("label"))
