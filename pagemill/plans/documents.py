"""Queries over the documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.operators import markdown, titles
from pagemill.plans.registry import query, quoted
from pagemill.runtime import table

#: Single characters by their compatibility form, where that is one letter or number; the database has no such form.
_COMPAT = [
    (chr(c), n)
    for r in (range(0xA0, 0x250), range(0x2070, 0x218A), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800))
    for c in r
    if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c) and unicodedata.category(n)[0] in "LN"
]
_NFKC = f"nfc_normalize(translate(nfc_normalize(%s), {quoted(''.join(a for a, _ in _COMPAT))}, {quoted(''.join(b for _, b in _COMPAT))}))"
_FIRST = r"regexp_extract(text, '^[\r\n]*([^\r\n]*)', 1)"
_NORMAL = f"trim(regexp_replace(lower({_NFKC % _FIRST}), {quoted(P.NOT_WORD)}, ' ', 'g'))"
_TITLES = f"""t AS (SELECT doc_id, title, list_sort(list_distinct(list_filter(string_split(title, ' '), lambda x: x <> ''))) AS tokens
  FROM (SELECT doc_id, {_NORMAL} AS title FROM documents WHERE text IS NOT NULL)), l AS (SELECT * FROM t WHERE len(tokens) >= 4),
c AS (SELECT title, any_value(tokens) AS tokens, min(doc_id) AS first_doc, count(*) AS documents FROM l GROUP BY 1)"""
_SIM = "2.0 * len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens))"


@query(f"WITH {_TITLES} SELECT doc_id, title, tokens FROM l")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    """STR-01: normalized titles and their tokens."""
    return titles.titled(table(spark, d, "documents"))


@query(f"WITH {_TITLES} SELECT * FROM c")
def title_classes(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their documents."""
    return titles.title_classes(table(spark, d, "documents"))


@query(
    f"WITH {_TITLES}, p AS (SELECT a.title AS title_a, b.title AS title_b, a.first_doc AS doc_a, b.first_doc AS doc_b, {_SIM} AS s FROM c a JOIN c b ON a.title < b.title) SELECT title_a, title_b, doc_a, doc_b, round(s, 4) AS similarity FROM p WHERE s >= 0.65"
)
def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """STR-02, JOIN-39: pairs of titles that are alike, between classes of equal titles."""
    return titles.title_pairs(table(spark, d, "documents"))


_TOP = f"""{_TITLES}, s AS (SELECT a.doc_id, b.first_doc AS candidate, {_SIM} AS s FROM l a JOIN c b ON a.title <> b.title WHERE a.doc_id % 50 = 0),
r AS (SELECT doc_id, candidate, round(s, 4) AS similarity FROM s WHERE s >= 0.65), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, candidate) AS rank FROM r)"""


@query(f"WITH {_TOP} SELECT * FROM k WHERE rank <= 5")
def title_candidates_top5(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: the five best titles for each 50th document."""
    return titles.title_candidates(table(spark, d, "documents"))


_TRIM_X = f"regexp_replace(x, {quoted(P.TRIM)}, '', 'g')"


@query(
    f"""WITH i AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM_X}), lambda x: length(x) > 0) AS items FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(len(items) AS INTEGER) AS item_count, CAST(coalesce(list_sum(list_transform(items, lambda x: length(x))), 0) AS INTEGER) AS char_count,
    CASE WHEN len(items) > 0 THEN sha256(array_to_string(items, chr(10))) END AS sha256 FROM i"""
)
def text_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: summary of the lines of each document."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", X.string_summary(X.string_list(F.split("text", "\n"))).alias("s")).select("doc_id", "s.*")


@query(
    r"""WITH l AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS text FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, line_no, coalesce(sum(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, text FROM l"""
)
def line_table(spark: SparkSession, d: str) -> DataFrame:
    """STR-26: lines with their place in UTF-16 units."""
    return markdown.line_table(table(spark, d, "documents"))


@query("SELECT sha256(text) AS sha256, count(*) AS documents, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: contents that occur more than once."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).filter("documents > 1")


_T = f"regexp_replace(text, {quoted(P.TRIM)}, '', 'g')"
_ENDS = f"regexp_matches(regexp_replace(regexp_replace({_T}, {quoted(P.CLOSING_TAGS)}, ''), {quoted(P.TRIM)}, '', 'g'), {quoted(P.TERMINAL)})"


@query(
    rf"""WITH x AS (SELECT doc_id, {_ENDS} AS ends, regexp_extract(text, '\p{{L}}') AS c FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, ends, c = lower(c) AND c <> upper(c) AS lower_start FROM x"""
)
def punctuation_flags(spark: SparkSession, d: str) -> DataFrame:
    """STR-10, STR-11: how texts begin and end."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", X.ends_with_terminal(F.col("text")).alias("ends"), X.first_letter_is_lower(F.col("text")).alias("lower_start"))


@query("SELECT doc_id, 'doc-' || substr(sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))), 1, 24) AS content_id FROM documents")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """JSN-17: content-addressed ids."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return table(spark, d, "documents").select("doc_id", X.content_id(F.lit("doc"), blank("source"), blank("lang"), blank("text")).alias("content_id"))


_CLEAN = r"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[*_`~\[\]]', '', 'g'), '\s+', ' ', 'g'), @TRIM@, '', 'g'), 1, 512)""".replace("@TRIM@", quoted(P.TRIM))


@query(
    f"""WITH l AS (SELECT doc_id, i - 1 AS p, regexp_split_to_array(text, '\\r?\\n')[i] AS line FROM (SELECT *, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
    v AS (SELECT *, coalesce(regexp_replace(lag(line) OVER (PARTITION BY doc_id ORDER BY p), {quoted(P.TRIM)}, '', 'g'), '') AS prev, count(*) OVER (PARTITION BY doc_id) AS lines FROM l),
    h AS (SELECT doc_id, lines, regexp_matches(line, {quoted(P.ATX)}) AS atx, line, prev, p FROM v),
    f AS (SELECT doc_id, lines, CASE WHEN atx THEN length(regexp_extract(line, {quoted(P.ATX)}, 1)) WHEN contains(line, '=') THEN 1 ELSE 2 END AS level,
      CASE WHEN atx THEN list_transform([regexp_extract(line, {quoted(P.ATX)}, 2)], lambda x: {_CLEAN})[1] ELSE substr(regexp_replace(prev, '<[^>]*>', '', 'g'), 1, 512) END AS label,
      CASE WHEN atx THEN p + 1 ELSE p END AS line FROM h WHERE atx OR (p > 0 AND regexp_matches(line, {quoted(P.SETEXT)}) AND prev <> '' AND NOT regexp_matches(prev, {quoted(P.LIST_ITEM)}))),
    g AS (SELECT * FROM f WHERE label <> '')
    SELECT doc_id, printf('heading-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY line)) AS heading_id, level, label, line,
      coalesce((SELECT min(n.line) FROM g n WHERE n.doc_id = g.doc_id AND n.line > g.line AND n.level <= g.level) - 1, lines) AS end_line FROM g"""
)
def headings(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28: headings with their sections."""
    return markdown.headings(table(spark, d, "documents"))


@query(
    """WITH l AS (SELECT doc_id, i AS n, strlen(regexp_split_to_array(text, '\\r?\\n')[i]) AS b FROM (SELECT *, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
    u AS (SELECT *, sum(b + CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l),
    f AS (SELECT *, (n <= 6 AND upto <= 500) OR n = 1 AS fits FROM u)
    SELECT doc_id, max(CASE WHEN fits THEN n END) AS end_line, count(*) FILTER (fits) AS lines, CAST(max(CASE WHEN fits THEN least(upto, 500) END) AS BIGINT) AS bytes, count(*) FILTER (NOT fits) > 0 AS truncated FROM f GROUP BY 1"""
)
def bounded_section(spark: SparkSession, d: str) -> DataFrame:
    """WIN-22, WIN-23: the first six lines within 500 bytes."""
    return markdown.bounded_section(table(spark, d, "documents"), 1, 6, 500)


@query("SELECT doc_id, source, coalesce(n_chars, -1) AS n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """TOPK-05: the page of a listing that follows a cursor."""
    return table(spark, d, "documents").filter("doc_id > 100").select("doc_id", "source", F.coalesce("n_chars", F.lit(-1)).alias("n_chars")).orderBy("doc_id").limit(25)


@query("SELECT doc_id, received_at, coalesce(n_chars, -1) AS n_chars FROM documents ORDER BY received_at DESC, doc_id LIMIT 500")
def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    """TOPK-06: the 500 latest documents."""
    return table(spark, d, "documents").select("doc_id", "received_at", F.coalesce("n_chars", F.lit(-1)).alias("n_chars")).orderBy(F.desc_nulls_last("received_at"), "doc_id").limit(500)


@query("SELECT doc_id, title FROM (SELECT doc_id, regexp_extract(text, '^[\\r\\n]*([^\\r\\n]*)', 1) AS title FROM documents) ORDER BY doc_id LIMIT 100 OFFSET 100")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    """TOPK-04: a page by its offset."""
    return table(spark, d, "documents").select("doc_id", titles.first_line(F.col("text")).alias("title")).orderBy("doc_id").offset(100).limit(100)


@query(
    """WITH h AS (SELECT doc_id, regexp_extract(l, '^ {0,3}#{1,6}[\\t ]+(.+?)[\\t ]*#*[\\t ]*$', 1) AS label FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS l FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(l, '^ {0,3}#{1,6}[\\t ]+(.+?)[\\t ]*#*[\\t ]*$'))
    SELECT lower(label) AS label, count(*) AS headings, count(DISTINCT doc_id) AS documents FROM h GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_headings(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: headings that repeat."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("l")).filter(F.col("l").rlike(P.ATX))
    label = F.lower(F.regexp_extract("l", P.ATX, 2)).alias("label")
    return lines.groupBy(label).agg(F.count("*").alias("headings"), F.countDistinct("doc_id").alias("documents")).filter("headings > 1")


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {quoted(P.TRIM)}, '', 'g') AS text FROM documents"""
)
def tidy_markdown(spark: SparkSession, d: str) -> DataFrame:
    """STR-37: Markdown without stray blanks and empty lines."""
    return table(spark, d, "documents").select("doc_id", X.tidy_markdown(F.col("text")).alias("text"))


@query("SELECT coalesce(lang, '') AS lang, count(*) AS documents, coalesce(sum(n_chars), 0)::BIGINT AS chars, count(DISTINCT source) AS sources, row_number() OVER (ORDER BY count(*) DESC, coalesce(lang, '')) AS rank FROM documents GROUP BY lang")
def language_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14: totals by language, ranked (the window runs over one row for each language)."""
    g = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.countDistinct("source").alias("sources"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("documents"), "lang")))


_SP = quoted(P.WS + "+")
_CLEAN = "regexp_replace(regexp_replace(%s, " + quoted(P.TRIM) + ", '', 'g'), " + _SP + ", ' ', 'g')"
_CTRL = quoted("[\\x{00}-\\x{1F}\\x{7F}]")


@query(
    f"""WITH q AS (SELECT DISTINCT regexp_extract(text, '^[^\\n\\r]*') AS t FROM documents WHERE text IS NOT NULL)
    SELECT t, nullif(left({_CLEAN % "t"}, 80), '') AS bounded, coalesce(nullif(left({_CLEAN % f"regexp_replace(t, {_CTRL} || '+', ' ', 'g')"}, 512), ''), 'none') AS label,
    CAST(to_json(regexp_replace(regexp_replace(t, {_CTRL}, ' ', 'g'), {quoted(P.TRIM)}, '', 'g')) AS VARCHAR) AS yaml,
    coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{00}}-\\x{{20}}\\x{{7F}}]+', ' ', 'g'), '([\\\\`*{{}}\\[\\]()#+\\-.!_>])', '\\\\\\1', 'g'), {quoted(P.TRIM)}, '', 'g'), ''), 'Untitled paper') AS heading,
    regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_\\[\\]!$])', '\\\\\\1', 'g') AS paragraph,
    coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(\\.mineru)?\\.zip$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'paper') AS stem FROM q"""
)
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """STR-31, STR-32, STR-47, STR-73, STR-75, PRD-40: the first lines of the documents as names, labels and markup."""
    from pagemill.functions import names as N

    t = F.col("t")
    df = table(spark, d, "documents").filter("text is not null").select(F.regexp_extract("text", r"^[^\n\r]*", 0).alias("t")).distinct()
    return df.select(
        "t", N.bounded(t, 80).alias("bounded"), N.printable_label(t, F.lit("none")).alias("label"), N.yaml_text(t).alias("yaml"), N.heading_text(t).alias("heading"),
        N.paragraph_markup(t).alias("paragraph"), N.archive_stem(t).alias("stem"),
    )


@query(
    rf"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS a FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, i AS line_no, a[i] AS line FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM s)),
    n AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 3 THEN 1 ELSE 0 END AS gap FROM l WHERE length(regexp_replace(line, {quoted(P.TRIM)}, '', 'g')) > 0),
    r AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n)
    SELECT doc_id, line_no, coalesce(list_reverse(list(line) OVER (PARTITION BY doc_id, run ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), []) AS before,
    coalesce(list(line) OVER (PARTITION BY doc_id, run ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS after FROM r"""
)
def nearby_lines(spark: SparkSession, d: str) -> DataFrame:
    """WIN-18: the nearest lines that are not blank around each line."""
    return markdown.nearby_lines(table(spark, d, "documents"))
