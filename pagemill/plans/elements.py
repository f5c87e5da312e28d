"""Queries over the page elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.operators import elements as E
from pagemill.operators import ordered, visuals
from pagemill.operators.markdown import image_occurrences
from pagemill.plans.registry import query, quoted
from pagemill.runtime import table


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, names)) + ")"


_TRIM = f"regexp_replace(%s, {quoted(P.TRIM)}, '', 'g')"
ONCE = "e AS (SELECT DISTINCT ON (doc_id, source_index) * FROM paper_content_list WHERE doc_id IS NOT NULL AND source_index IS NOT NULL)"
ROLE = f"""CASE WHEN lower(trim(coalesce(type, 'unknown'))) IN {_in(P.VISUAL_TYPES)} THEN 'visual' WHEN lower(trim(type)) IN {_in(P.TABLE_TYPES)} THEN 'table'
  WHEN lower(trim(type)) IN {_in(P.EQUATION_TYPES)} THEN 'equation' WHEN lower(trim(type)) IN {_in(P.MARGINAL_TYPES)} THEN 'marginalia'
  WHEN lower(trim(type)) IN {_in(P.TITLE_TYPES)} OR (lower(trim(type)) = 'text' AND text_level IS NOT NULL) THEN 'title'
  WHEN lower(trim(type)) IN {_in(P.TEXT_TYPES)} THEN 'text' ELSE 'other' END"""
_SCALED = "CASE WHEN list_max(bbox) <= 1.5 THEN list_transform(bbox, lambda x: x * 1000.0) ELSE bbox END"
BOXED = f"""b0 AS (SELECT *, {_SCALED} AS sb FROM e),
b1 AS (SELECT *, CASE WHEN len(sb) = 4 AND len(list_filter(sb, lambda x: x >= 0 AND x <= 1000)) = 4 AND sb[3] > sb[1] AND sb[4] > sb[2]
  THEN list_transform(sb, lambda x: round(x, 6)) END AS box FROM b0)"""
_PATH = r"regexp_replace(replace(regexp_replace(trim(img_path), '^<|>$', '', 'g'), '\', '/'), '^(?:\./)+', '')"
BLOCKS = f"""{ONCE}, {BOXED}, b2 AS (SELECT *, printf('p%04d-s%06d', page_idx, source_index) AS id,
  row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY source_index) - 1 AS page_order, {ROLE} AS role,
  CASE WHEN length({_PATH}) > 0 AND NOT regexp_matches({_PATH}, '^/|{P.SCHEME}') AND NOT list_contains(string_split({_PATH}, '/'), '..') THEN {_PATH} END AS asset_path
  FROM b1 WHERE page_idx >= 0)"""
_BOX4 = "box[1] AS x0, box[2] AS y0, box[3] AS x1, box[4] AS y1"

_KIND = f"lower(regexp_extract(text, {quoted(P.FIGURE_KEY)}, 1))"
KEY = f"""CASE WHEN regexp_matches(text, {quoted(P.FIGURE_KEY)}) THEN (CASE WHEN starts_with({_KIND}, 'extended') THEN 'extended-data-figure'
  WHEN starts_with({_KIND}, 'supplementary') THEN 'supplementary-figure' WHEN starts_with({_KIND}, 'supporting') THEN 'supporting-figure'
  WHEN {_KIND} = '图' THEN '图' ELSE 'figure' END) || ':' || lower(replace(regexp_extract(text, {quoted(P.FIGURE_KEY)}, 2), '.', '_')) END"""
_REST = f"regexp_replace(text, {quoted(P.FIGURE_KEY)}, '')"
_TITLE = _TRIM % f"regexp_extract({_REST}, {quoted(P.FORMAL_TITLE)}, 1)"
FORMAL = f"CASE WHEN regexp_matches(text, {quoted(P.FIGURE_KEY)}) AND length({_TITLE}) >= 5 AND NOT regexp_matches({_TITLE}, {quoted(P.REFERENCE_VERB)}) THEN {KEY} END"
_ENDED = "regexp_matches(" + _TRIM % ("regexp_replace(" + _TRIM % "text" + f", {quoted(P.CLOSING_TAGS)}, '')") + f", {quoted(P.TERMINAL)})"
_LETTER = r"regexp_extract(text, '\p{L}')"
_LOWER = f"({_LETTER} = lower({_LETTER}) AND {_LETTER} <> upper({_LETTER}))"
KIND = f"""CASE WHEN regexp_matches(text, {quoted(P.NEXT_PAGE_ONLY)}) THEN 'next-page-placeholder' WHEN regexp_matches(text, {quoted(P.NEXT_PAGE_INSIDE)}) THEN 'other'
  WHEN ({FORMAL}) IS NOT NULL THEN 'formal-caption' WHEN regexp_matches(text, {quoted(P.PANEL_LABEL)}) THEN 'panel-label'
  WHEN length(text) >= 24 AND ({KEY}) IS NULL AND {_ENDED} AND (regexp_matches(text, {quoted(P.PANEL_START)}) OR {_LOWER}) THEN 'caption-continuation' ELSE 'other' END"""


def _strings(field: str) -> str:
    return f"list_filter(list_transform(coalesce({field}, []), lambda x: {_TRIM % 'x'}), lambda x: length(x) > 0)"


ITEMS = f"""{ONCE}, s AS (SELECT doc_id, source_index, 'image_caption' AS field, {_strings('image_caption')} AS items FROM e
  UNION ALL SELECT doc_id, source_index, 'table_caption', {_strings('table_caption')} FROM e),
i AS (SELECT doc_id, source_index, field, CAST(k - 1 AS INTEGER) AS item, items[k] AS text FROM (SELECT *, unnest(range(1, len(items) + 1)) AS k FROM s WHERE len(items) > 0)),
c AS (SELECT *, {KIND} AS kind, {KEY} AS figure_key, {FORMAL} AS formal_key FROM i)"""


@query(f"WITH {ONCE} SELECT coalesce(source, '') AS source, {ROLE} AS role, count(*) AS n FROM e GROUP BY 1, 2")
def element_roles(spark: SparkSession, d: str) -> DataFrame:
    """PRD-25: roles of the elements by source."""
    e = E.delivered_once(table(spark, d, "paper_content_list"))
    return e.groupBy(F.coalesce("source", F.lit("")).alias("source"), E.role(F.col("type"), F.col("text_level")).alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKS} SELECT doc_id, id, source_index, page_idx, page_order, role, {_BOX4}, asset_path FROM b2")
def viewer_blocks(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-01, SRC-12, PRD-07, PRD-21: elements as blocks of their page."""
    b = E.viewer_blocks(table(spark, d, "paper_content_list"))
    return b.select("doc_id", "id", "source_index", "page_idx", "page_order", "role", *[G.part(F.col("box"), i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "asset_path")


@query(
    f"""WITH {ONCE}, {BOXED} SELECT doc_id, source_index, CASE WHEN coalesce(page_idx < 0, true) THEN 'invalid_page_idx' ELSE 'missing_or_invalid_bbox' END AS code
    FROM b1 WHERE coalesce(page_idx < 0, true) OR box IS NULL"""
)
def block_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the index: elements without a valid page or box."""
    return E.block_issues(table(spark, d, "paper_content_list"))


@query(
    f"""WITH {ONCE}, {BOXED}, c AS (SELECT doc_id, count(*) AS elements, count(*) FILTER (page_idx >= 0) AS accepted,
    count(*) FILTER (page_idx >= 0 AND box IS NOT NULL) AS located, count(DISTINCT CASE WHEN page_idx >= 0 THEN page_idx END) AS pages FROM b1 GROUP BY 1)
    SELECT *, CASE WHEN located = 0 THEN 'unavailable' WHEN located < elements THEN 'partial' ELSE 'complete' END AS status FROM c"""
)
def package_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each package's index."""
    return E.package_status(table(spark, d, "paper_content_list"))


@query(f"WITH {ITEMS} SELECT * FROM c")
def caption_kinds(spark: SparkSession, d: str) -> DataFrame:
    """STR-03 to STR-09: class and figure key of each caption item."""
    return E.caption_items(table(spark, d, "paper_content_list"))


@query(
    f"""WITH {ITEMS} SELECT doc_id, source_index, count(*) AS item_count, CAST(sum(length(text)) AS BIGINT) AS char_count, count(*) FILTER (length(text) >= 30) AS long_item_count,
    count(formal_key) AS figure_anchor_count, count(*) FILTER (regexp_matches(text, {quoted(P.PANEL_LABEL)})) AS panel_label_count,
    coalesce(list_sort(list_distinct(list(figure_key) FILTER (figure_key IS NOT NULL))), []) AS figure_keys, count(*) FILTER (kind = 'next-page-placeholder') AS next_page_count FROM c GROUP BY 1, 2"""
)
def caption_summaries(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02, AGG-03: summary of the captions of each element."""
    return E.caption_summaries(table(spark, d, "paper_content_list"))


def _summary(*fields: str) -> str:
    return f"""WITH {ONCE}, s AS (SELECT doc_id, source_index, flatten([{", ".join(map(_strings, fields))}]) AS items FROM e)
    SELECT doc_id, source_index, CAST(len(items) AS INTEGER) AS item_count, CAST(list_sum(list_transform(items, lambda x: length(x))) AS INTEGER) AS char_count,
    sha256(array_to_string(items, chr(10))) AS sha256 FROM s WHERE len(items) > 0"""


@query(_summary("image_caption", "table_caption"))
def caption_digests(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01 over the captions: count, characters and SHA-256."""
    return E.string_summaries(table(spark, d, "paper_content_list"), E.CAPTIONS)


@query(_summary("image_footnote", "table_footnote"))
def footnote_digests(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04: the same over the footnotes."""
    return E.string_summaries(table(spark, d, "paper_content_list"), E.FOOTNOTES)


@query(f"WITH {ONCE} SELECT doc_id, count(*) AS element_count, coalesce(max(page_idx) + 1, 1) AS page_count FROM e GROUP BY 1")
def element_summary(spark: SparkSession, d: str) -> DataFrame:
    """SNK-11: elements and pages of each package."""
    return E.element_summary(table(spark, d, "paper_content_list"))


_VISUALS = f"{BLOCKS}, v AS (SELECT doc_id, page_idx, id, page_order, box, (box[3] - box[1]) * (box[4] - box[2]) AS area FROM b2 WHERE role = 'visual' AND asset_path IS NOT NULL AND box IS NOT NULL)"
_XO, _YO = "greatest(0, least(a.box[3], b.box[3]) - greatest(a.box[1], b.box[1]))", "greatest(0, least(a.box[4], b.box[4]) - greatest(a.box[2], b.box[2]))"
_XG, _YG = "greatest(0, greatest(a.box[1], b.box[1]) - least(a.box[3], b.box[3]))", "greatest(0, greatest(a.box[2], b.box[2]) - least(a.box[4], b.box[4]))"
_W, _H = "least(a.box[3] - a.box[1], b.box[3] - b.box[1])", "least(a.box[4] - a.box[2], b.box[4] - b.box[2])"
_NEXT_TO = f"(({_XG} <= 20 AND {_YO} >= 0.15 * {_H}) OR ({_YG} <= 20 AND {_XO} >= 0.15 * {_W}))"


@query(
    f"""WITH {_VISUALS}, p AS (SELECT a.doc_id, a.page_idx, a.id AS child_id, b.id AS parent_id, {_XO} * {_YO} / a.area AS inside, b.area, b.page_order
    FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.id <> b.id AND b.area >= 1.2 * a.area)
    SELECT doc_id, page_idx, child_id, parent_id, round(inside, 4) AS containment FROM p WHERE inside >= 0.95
    QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx, child_id ORDER BY area, page_order) = 1"""
)
def enclosing_visuals(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17: the smallest visual around each visual."""
    return visuals.enclosing_visuals(E.viewer_blocks(table(spark, d, "paper_content_list")))


@query(
    f"""WITH {_VISUALS} SELECT a.doc_id, a.page_idx, a.id AS left_id, b.id AS right_id, round({_XG}, 6) AS x_gap, round({_YG}, 6) AS y_gap
    FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.page_order < b.page_order AND {_NEXT_TO}"""
)
def visual_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-18: pairs of visuals next to each other."""
    return visuals.visual_adjacency(E.viewer_blocks(table(spark, d, "paper_content_list")))


@query(
    f"""WITH RECURSIVE {_VISUALS}, ed AS (SELECT a.doc_id, a.id AS x, b.id AS y FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.id <> b.id AND {_NEXT_TO}),
    reach(doc_id, x, y) AS (SELECT doc_id, id, id FROM v UNION SELECT r.doc_id, r.x, ed.y FROM reach r JOIN ed ON ed.doc_id = r.doc_id AND ed.x = r.y)
    SELECT doc_id, x AS id, min(y) AS component FROM reach GROUP BY 1, 2"""
)
def visual_components(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11: connected components of the visuals of a page, named by their first member."""
    return visuals.visual_components(E.viewer_blocks(table(spark, d, "paper_content_list")))


@query()
def visual_groups_built(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07 to AGG-10, WIN-04 to WIN-07: groups with confidence and decision (tested on golden pages).

    The package's article is its first document that shows images.
    """
    shows = table(spark, d, "documents").filter("package_id is not null and (contains(text, '![') or contains(lower(text), '<img'))")
    articles = shows.groupBy(F.col("package_id").alias("doc_id")).agg(F.min_by("text", F.col("doc_id")).alias("text"))
    return visuals.visual_groups(table(spark, d, "paper_content_list"), image_occurrences(articles))


@query()
def next_page_captions(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-20, WIN-02, WIN-03: captions on the next page (tested on golden pages)."""
    return visuals.caption_links(table(spark, d, "paper_content_list"))


_SCORE = """CASE WHEN shared >= 0.55 THEN (CASE WHEN below >= -20 THEN (CASE WHEN greatest(below, 0) <= 100 THEN greatest(below, 0) END)
  WHEN above >= -20 THEN (CASE WHEN greatest(above, 0) <= 80 THEN greatest(above, 0) END) END) + (1 - shared) * 40 END"""


@query(
    f"""WITH {BLOCKS}, t AS (SELECT * REPLACE ({_TRIM % "coalesce(text, '')"} AS text) FROM b2),
    f AS (SELECT *, CASE WHEN role IN ('text', 'title') THEN {FORMAL} END AS f FROM t),
    n AS (SELECT *, first(CASE WHEN f IS NOT NULL THEN {{'id': id, 'f': f, 'box': box}} END IGNORE NULLS) OVER (PARTITION BY doc_id, page_idx ORDER BY page_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM f),
    g AS (SELECT doc_id, page_idx, id, nx.id AS caption_id, nx.f AS figure_key,
    greatest(0, least(nx.box[3], box[3]) - greatest(nx.box[1], box[1])) / greatest(1, least(nx.box[3] - nx.box[1], box[3] - box[1])) AS shared,
    nx.box[2] - box[4] AS below, box[2] - nx.box[4] AS above, nx.box AS nb FROM n WHERE nx IS NOT NULL AND role = 'visual' AND asset_path IS NOT NULL AND box IS NOT NULL)
    SELECT doc_id, page_idx, id, caption_id, figure_key, CASE WHEN nb IS NOT NULL THEN round({_SCORE}, 6) END AS distance FROM g"""
)
def following_captions(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-19, GEO-06: the next formal caption behind each visual."""
    return visuals.following_captions(table(spark, d, "paper_content_list"))


@query(
    f"""WITH {BLOCKS} SELECT doc_id, id, role = 'title' AND length({_TRIM % "coalesce(text, '')"}) BETWEEN 1 AND 16 AND box[1] <= 200 AND box[2] <= 40 AND box[3] - box[1] <= 180 AND box[4] <= 65 AS running_header,
    role IN ('text', 'title') AND box[2] <= 320 AS top_text,
    box[2] >= 700 AND box[3] - box[1] <= 100 AND box[4] - box[2] <= 35 AND (box[3] - box[1]) * (box[4] - box[2]) <= 2500 AS footer_badge FROM b2 WHERE box IS NOT NULL"""
)
def page_bands(spark: SparkSession, d: str) -> DataFrame:
    """PRD-27, PRD-28, PRD-29: where blocks stand on their page."""
    b = E.viewer_blocks(table(spark, d, "paper_content_list")).filter("box is not null")
    n = F.length(X.trim(F.coalesce("text", F.lit(""))))
    box = F.col("box")
    header = (F.col("role") == "title") & n.between(1, 16) & (G.part(box, 0) <= 200) & (G.part(box, 1) <= 40) & (G.width(box) <= 180) & (G.part(box, 3) <= 65)
    return b.select("doc_id", "id", header.alias("running_header"), (F.col("role").isin("text", "title") & (G.part(box, 1) <= 320)).alias("top_text"), G.footer_badge(box).alias("footer_badge"))


@query(
    f"""WITH {BLOCKS}, g AS (SELECT DISTINCT ON (doc_id, id) * FROM visual_groups), m AS (SELECT DISTINCT doc_id, id, unnest(member_block_ids) AS member FROM g),
    u AS (SELECT m.doc_id, m.id, count(b2.id) AS found, count(*) AS members, min(box[1]) AS x0, min(box[2]) AS y0, max(box[3]) AS x1, max(box[4]) AS y1
    FROM m LEFT JOIN b2 ON b2.doc_id = m.doc_id AND b2.id = m.member WHERE member IS NOT NULL GROUP BY 1, 2) SELECT * FROM u"""
)
def group_boxes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06, JOIN-28: union of the boxes of each group's members, and how many members exist."""
    blocks = E.viewer_blocks(table(spark, d, "paper_content_list")).select("doc_id", F.col("id").alias("member"), "box")
    groups = table(spark, d, "visual_groups").select("doc_id", "id", F.explode("member_block_ids").alias("member")).filter("member is not null").distinct()
    joined = groups.join(blocks.withColumn("hit", F.lit(1)), ["doc_id", "member"], "left")
    return joined.groupBy("doc_id", "id").agg(
        F.count("hit").alias("found"), F.count("*").alias("members"), *[f(G.part(F.col("box"), i)).alias(n) for i, (f, n) in enumerate(((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")))]
    )


@query(
    f"""WITH {ONCE} SELECT doc_id, source_index, coalesce(last_value(page_idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY source_index), 0) AS owner FROM e"""
)
def page_owner(spark: SparkSession, d: str) -> DataFrame:
    """WIN-16: the page of each element, carried on over elements without one."""
    e = E.delivered_once(table(spark, d, "paper_content_list")).select("doc_id", "source_index", "page_idx")
    return ordered.fill_forward(e, "doc_id", "source_index", "page_idx", "owner", F.lit(0)).select("doc_id", "source_index", "owner")


@query(
    f"""WITH {ONCE}, p AS (SELECT DISTINCT doc_id, page_idx FROM e WHERE {ROLE} = 'visual' AND page_idx IS NOT NULL),
    i AS (SELECT *, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS g FROM p)
    SELECT doc_id, min(page_idx) AS first, max(page_idx) AS last, count(*) AS length FROM i GROUP BY doc_id, g"""
)
def visual_page_runs(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23: runs of consecutive pages with visuals."""
    e = table(spark, d, "paper_content_list").filter(E.role(F.col("type"), F.col("text_level")) == "visual")
    return ordered.runs(e.filter("doc_id is not null").select("doc_id", "page_idx").distinct(), "doc_id", "page_idx")


@query(
    f"""WITH {ONCE}, t AS (SELECT doc_id, page_idx, source_index, {_TRIM % "text"} AS text FROM e WHERE text IS NOT NULL AND page_idx IS NOT NULL),
    u AS (SELECT doc_id, md5(text) AS k FROM t WHERE length(text) BETWEEN 8 AND 24000 GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT t.doc_id, t.page_idx, count(*) AS anchors, min(source_index) AS first_index FROM t JOIN u ON u.doc_id = t.doc_id AND u.k = md5(t.text) WHERE length(text) BETWEEN 8 AND 24000 GROUP BY 1, 2"""
)
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11: texts of each page that stand only once in their package, from which pages can be found again."""
    e = E.delivered_once(table(spark, d, "paper_content_list")).filter("text is not null and page_idx is not null")
    t = e.select("doc_id", "page_idx", "source_index", X.trim(F.col("text")).alias("t")).filter(F.length("t").between(8, 24000))
    t = t.select("doc_id", "page_idx", "source_index", F.unhex(F.md5(F.col("t").cast("binary"))).alias("k"))
    once = t.groupBy("doc_id", "k").agg(F.count("*").alias("n"), F.min("page_idx").alias("page_idx"), F.min("source_index").alias("source_index")).filter("n = 1")
    return once.groupBy("doc_id", "page_idx").agg(F.count("*").alias("anchors"), F.min("source_index").alias("first_index"))


@query(
    f"""WITH {ONCE}, t AS (SELECT doc_id, source_index, text, lag(source_index) OVER w AS prev_source_index, lead(source_index) OVER w AS next_source_index, lag(text) OVER w AS pt, lead(text) OVER w AS nt
    FROM e WHERE {ROLE} IN ('text', 'title') WINDOW w AS (PARTITION BY doc_id ORDER BY source_index))
    SELECT doc_id, source_index, coalesce(prev_source_index, -1) AS prev_source_index, coalesce(next_source_index, -1) AS next_source_index, coalesce(length(pt), 0) AS prev_chars, coalesce(length(nt), 0) AS next_chars FROM t"""
)
def text_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08: each text block with the text blocks before and after it."""
    e = E.delivered_once(table(spark, d, "paper_content_list")).filter(E.role(F.col("type"), F.col("text_level")).isin("text", "title"))
    rows = e.select("doc_id", "source_index", F.length("text").alias("chars"))
    out = ordered.with_neighbours(rows, "doc_id", "source_index", ["source_index", "chars"])
    return out.select("doc_id", "source_index", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("prev_source_index", "next_source_index")], F.coalesce("prev_chars", F.lit(0)).alias("prev_chars"), F.coalesce("next_chars", F.lit(0)).alias("next_chars"))


_PARA = rf"""length(t) BETWEEN 48 AND 6000 AND regexp_matches(t, '^[\p{{Lu}}\p{{N}}]') AND regexp_matches(t, '[.!?。！？]["''”’)\]]*$')
  AND NOT regexp_matches(t, '(?i)^(?:fig(?:ure)?|table|图|表)\.?\s*\d') AND NOT regexp_matches(t, '^#{{1,6}}\s')
  AND len(list_filter(regexp_split_to_array(t, {quoted(P.WS + "+")}), lambda x: length(x) > 0)) BETWEEN 8 AND 1200
  AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= 0.52 * length(regexp_replace(t, {quoted(P.WS)}, '', 'g'))"""


@query(f"WITH {ONCE}, t AS (SELECT doc_id, source_index, {_TRIM % 'text'} AS t FROM e WHERE text IS NOT NULL AND {ROLE} = 'text') SELECT doc_id, source_index, {_PARA} AS complete FROM t")
def complete_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """PRD-32: whether a text looks like a complete paragraph of the body."""
    e = E.delivered_once(table(spark, d, "paper_content_list")).filter(E.role(F.col("type"), F.col("text_level")) == "text").filter("text is not null")
    return e.select("doc_id", "source_index", X.looks_like_paragraph(X.trim(F.col("text"))).alias("complete"))


_U = "struct_pack(x := {0}[1] / 1000.0, y := {0}[2] / 1000.0, w := ({0}[3] - {0}[1]) / 1000.0, h := ({0}[4] - {0}[2]) / 1000.0)"


@query(
    f"""WITH {BLOCKS}, n AS (SELECT doc_id, id, lag(id) OVER w AS before, box AS b, lag(box) OVER w AS a FROM b2 WHERE box IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY page_order)),
    g AS (SELECT *, greatest(0, greatest(a[1], b[1]) - least(a[3], b[3])) AS gx, greatest(0, greatest(a[2], b[2]) - least(a[4], b[4])) AS gy, greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) AS ox,
      greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) AS oy, a[3] - a[1] AS aw, b[3] - b[1] AS bw, a[4] - a[2] AS ah, b[4] - b[2] AS bh, {_U.format('a')} AS u, {_U.format('b')} AS v FROM n WHERE a IS NOT NULL),
    s AS (SELECT *, oy / greatest(1, least(ah, bh)) AS share, CASE WHEN b[1] - a[3] >= -20 THEN greatest(b[1] - a[3], 0) WHEN a[1] - b[3] >= -20 THEN greatest(a[1] - b[3], 0) END AS beside,
      ox / greatest(1, least(aw, bw)) AS wide, b[2] - a[4] AS below, a[2] - b[4] AS above FROM g)
    SELECT doc_id, before, id, (gx <= 20 AND oy >= 0.15 * least(ah, bh)) OR (gy <= 20 AND ox >= 0.15 * least(aw, bw)) OR (gx <= 40 AND oy >= 0.65 * greatest(ah, bh)) OR (gy <= 40 AND ox >= 0.65 * greatest(aw, bw)) AS touching,
    ox * oy / least(aw * ah, bw * bh) > 0.92 AND greatest(aw * ah, bw * bh) / least(aw * ah, bw * bh) < 1.35 AS conflicting,
    ox >= 0.2 * least(aw, bw) OR abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) <= 180 AS aligned,
    round(coalesce(CASE WHEN wide >= 0.55 THEN (CASE WHEN below >= -20 THEN CASE WHEN greatest(below, 0) <= 100 THEN greatest(below, 0) END WHEN above >= -20 THEN CASE WHEN greatest(above, 0) <= 80 THEN greatest(above, 0) END END) + (1 - wide) * 40 END,
      CASE WHEN beside <= 80 AND abs(a[2] - b[2]) <= 45 AND share >= 0.55 AND bh / greatest(1, ah) BETWEEN 0.45 AND 2.2 THEN beside + (1 - share) * 40 END, -1), 6) AS distance,
    greatest(0, least(u.x + u.w, v.x + v.w) - greatest(u.x, v.x)) / greatest(1e-6, least(u.w, v.w)) >= 0.62 AND v.y - (u.y + u.h) BETWEEN -0.02 AND 0.12 AS stacked,
    v.x >= 0.02 AND v.y >= 0.04 AND v.x + v.w <= 0.98 AND v.y + v.h <= 0.96 AND v.w BETWEEN 0.2 AND 0.7 AND v.h BETWEEN 0.025 AND 0.65 AS paragraph_place, v.w * v.h >= 0.08 AS large FROM s"""
)
def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """GEO-07, GEO-10 to GEO-13, GEO-15, PRD-23, PRD-30: how each located block stands to the one before it on its page."""
    w = Window.partitionBy("doc_id", "page_idx").orderBy("page_order")
    b = E.viewer_blocks(table(spark, d, "paper_content_list")).filter("box is not null").select("doc_id", "id", F.lag("id").over(w).alias("before"), F.col("box").alias("b"), F.lag("box").over(w).alias("a")).filter("a is not null")
    x, y = F.col("a"), F.col("b")
    # boxes are in thousandths here; a box within 1 is a very small one, not a share of the page
    unit = lambda c: F.struct(*[(e / 1000.0).alias(n) for n, e in (("x", G.part(c, 0)), ("y", G.part(c, 1)), ("width", G.width(c)), ("height", G.height(c)))])
    u, v = unit(x), unit(y)
    return b.select(
        "doc_id", "before", "id", G.touching(x, y).alias("touching"), G.conflicting(x, y).alias("conflicting"), G.aligned(x, y).alias("aligned"),
        F.round(F.coalesce(G.caption_score_any_side(y, x), F.lit(-1.0)), 6).alias("distance"), G.stacked(u, v).alias("stacked"), G.paragraph_place(v).alias("paragraph_place"), G.large_image(v).alias("large"),
    )


@query(
    f"""WITH {ITEMS}, placed AS (SELECT *, row(length(text), CASE WHEN field = 'image_caption' THEN 0 ELSE -1 END, -item) AS place FROM c WHERE text <> ''),
    p AS (SELECT doc_id, source_index, {_TRIM % "text"} AS t, min((field, item)) AS k FROM placed WHERE kind = 'panel-label' GROUP BY 1, 2, 3), l AS (SELECT doc_id, source_index, list(t ORDER BY k) AS panels FROM p GROUP BY 1, 2),
    b AS (SELECT doc_id, source_index, coalesce(arg_max(text, place) FILTER (kind = 'formal-caption'), arg_max(text, place)) AS caption FROM placed GROUP BY 1, 2)
    SELECT b.*, coalesce(panels, []) AS panels FROM b LEFT JOIN l USING (doc_id, source_index)"""
)
def best_captions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, AGG-20: the caption and the panel labels of each element."""
    return E.best_captions(table(spark, d, "paper_content_list"))


@query(
    f"""WITH {BLOCKS}, f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, page_order) AS nth, id, asset_path AS path FROM b2 WHERE role = 'visual' AND asset_path IS NOT NULL AND box IS NOT NULL)
    SELECT doc_id, nth, id, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '') AS label FROM f WHERE nth <= 200"""
)
def package_figures(spark: SparkSession, d: str) -> DataFrame:
    """TOPK-07: the first 200 figures of each package in reading order, labelled by their files where nothing else names them."""
    from pagemill.functions import names as N

    v = visuals.located_visuals(E.viewer_blocks(table(spark, d, "paper_content_list"))).select("doc_id", "page_idx", "page_order", "id", F.col("asset_path").alias("path"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "page_order"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "")
    return v.withColumn("nth", nth).filter("nth <= 200").select("doc_id", "nth", "id", "path", N.printable_label(stem, F.lit("")).alias("label"))


_CROP = "CASE WHEN len(replacement.bbox_norm) = 4 AND len(list_filter(replacement.bbox_norm, lambda x: x BETWEEN 0 AND 1000)) = 4 AND replacement.bbox_norm[3] > replacement.bbox_norm[1] AND replacement.bbox_norm[4] > replacement.bbox_norm[2] THEN replacement.bbox_norm END"


@query(
    f"""WITH {BLOCKS}, g AS (SELECT DISTINCT ON (doc_id, id) *, {_CROP} AS crop FROM visual_groups WHERE doc_id IS NOT NULL AND id IS NOT NULL),
    m AS (SELECT DISTINCT g.doc_id, g.id, g.page_idx, g.crop, g.replacement.mode AS mode, x AS block FROM g, unnest(member_block_ids) AS u(x) WHERE x IS NOT NULL),
    k AS (SELECT m.*, b2.page_idx AS block_page, b2.box, count(*) OVER (PARTITION BY m.doc_id, m.block) AS n FROM m LEFT JOIN b2 ON b2.doc_id = m.doc_id AND b2.id = m.block),
    a AS (SELECT g.doc_id, g.id, g.page_idx, g.member_block_ids AS members, x AS block FROM g, unnest(caption_anchor_block_ids) AS u(x) WHERE x IS NOT NULL AND NOT coalesce(list_contains(g.member_block_ids, x), false))
    SELECT doc_id, id, 'invalid-confidence' AS code FROM g WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false)
    UNION ALL SELECT doc_id, id, 'invalid-decision' FROM g WHERE NOT coalesce(decision IN ('auto', 'review', 'skip'), false)
    UNION ALL SELECT doc_id, id, 'no-members' FROM g WHERE coalesce(len(member_block_ids), 0) < 1
    UNION ALL SELECT DISTINCT doc_id, id, 'unknown-block' FROM k WHERE block_page IS NULL
    UNION ALL SELECT DISTINCT doc_id, id, 'block-in-several-groups' FROM k WHERE n > 1
    UNION ALL SELECT DISTINCT doc_id, id, 'member-on-another-page' FROM k WHERE block_page <> page_idx
    UNION ALL SELECT DISTINCT doc_id, id, 'crop-misses-member' FROM k WHERE mode = 'pdf_crop' AND crop IS NOT NULL AND box IS NOT NULL AND
      greatest(0, least(crop[3], box[3]) - greatest(crop[1], box[1])) * greatest(0, least(crop[4], box[4]) - greatest(crop[2], box[2])) < (box[3] - box[1]) * (box[4] - box[2]) - 1e-6
    UNION ALL SELECT DISTINCT a.doc_id, a.id, 'invalid-caption-anchor' FROM a LEFT JOIN b2 ON b2.doc_id = a.doc_id AND b2.id = a.block WHERE NOT coalesce(b2.page_idx = a.page_idx AND b2.role IN ('text', 'title'), false)
    UNION ALL SELECT doc_id, id, 'missing-replacement' FROM g WHERE replacement IS NULL
    UNION ALL SELECT doc_id, id, 'unsupported-mode' FROM g WHERE replacement IS NOT NULL AND NOT coalesce(replacement.mode IN ('pdf_crop', 'existing_asset'), false)
    UNION ALL SELECT doc_id, id, 'invalid-crop-box' FROM g WHERE replacement.mode = 'pdf_crop' AND crop IS NULL
    UNION ALL SELECT doc_id, id, 'missing-asset' FROM g WHERE replacement.mode = 'existing_asset' AND NOT coalesce(length(replacement.asset_path) > 0, false)
    UNION ALL SELECT doc_id, id, 'asset-of-no-member' FROM g WHERE replacement.mode = 'existing_asset' AND NOT coalesce(list_contains(member_block_ids, replacement.block_id), false)"""
)
def group_checks(spark: SparkSession, d: str) -> DataFrame:
    """JSN-09: faults of the figure groups against the blocks of their packages."""
    return visuals.group_checks(table(spark, d, "visual_groups"), E.viewer_blocks(table(spark, d, "paper_content_list")))
