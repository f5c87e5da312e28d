"""Repairs as derived rows: where they apply, what they give, reviews of them, and anchors put into a text.

The source is never changed. A repair that is not unique, or that overlaps another,
does not apply, and says why.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import text as X
from pagemill.functions.names import paragraph_markup
from pagemill.functions.recover import LOST, is_glyph
from pagemill.operators.elements import viewer_blocks
from pagemill.operators.integrity import single_claims
from pagemill.operators.ordered import with_neighbours


def _passive(source: str | None, replacement: str | None) -> bool:
    """Whether the replacement is the source with each lost character as one to four plain glyphs."""
    if source is None or replacement is None or LOST not in source:
        return False
    import re

    pattern = "(.{1,4}?)".join(map(re.escape, source.split(LOST)))
    m = re.fullmatch(pattern, replacement, re.S)
    return bool(m) and all(is_glyph(c) for g in m.groups() for c in g)


def is_passive(source: Column, replacement: Column) -> Column:
    """As a column; false for nulls and for a source without lost characters."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_passive(x, y) for x, y in zip(a, b)], dtype=bool)

    return run(source, replacement)


def placed_repairs(articles: DataFrame, repairs: DataFrame) -> DataFrame:
    """Repairs with their place: doc_id, repair_id, start, end, replacement, status.

    Articles: doc_id, markdown. Repairs: doc_id, repair_id, source_text, replacement.
    Status: ready; no-article; not-unique if the source does not stand once in the
    article; not-passive if more than lost characters would change; overlap for all
    that overlap one before them. Repairs of a document are few, so the window is small.
    """
    r = repairs.select("doc_id", "repair_id", "source_text", "replacement").join(articles.select("doc_id", "markdown"), "doc_id", "left")
    at = X.unique_position(F.col("markdown"), F.col("source_text"))
    placed = r.withColumn("start", at).withColumn("end", at + F.length("source_text")).withColumn("passive", is_passive(F.col("source_text"), F.col("replacement")))
    first = F.when(F.col("markdown").isNull(), "no-article").when(F.col("start").isNull(), "not-unique").when(~F.col("passive"), "not-passive").otherwise("ready")
    placed = placed.withColumn("status", first)
    before = Window.partitionBy("doc_id").orderBy("start", "repair_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max(F.when(F.col("status") == "ready", F.col("end"))).over(before)
    status = F.when((F.col("status") == "ready") & (upto > F.col("start")), "overlap").otherwise(F.col("status"))
    return placed.withColumn("upto", upto).select("doc_id", "repair_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "replacement", status.alias("status"))


def repaired(articles: DataFrame, placed: DataFrame) -> DataFrame:
    """Articles with the repairs that are ready: doc_id, markdown, repairs."""
    ready = placed.filter("status = 'ready'").groupBy("doc_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")))).alias("r"))
    # from the end, so that earlier places stay
    text = F.aggregate(
        "r", F.col("markdown"), lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), x["replacement"], F.substring(t, x["end"] + 1, F.length(t)))
    )
    joined = articles.select("doc_id", "markdown").join(ready, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("r").isNull(), F.col("markdown")).otherwise(text).alias("markdown"), F.when(F.col("r").isNull(), 0).otherwise(F.size("r")).alias("repairs"))


VERDICTS = ("accept", "reject", "abstain")


def judged_decisions(candidates: DataFrame, decisions: DataFrame, least: float = 0.85) -> DataFrame:
    """Each decision with its outcome: doc_id, candidate_id, pos, verdict, outcome.

    Decisions: doc_id, pos, candidate_id, verdict, confidence. Outcome: unknown
    candidate, duplicate (all but the first), invalid verdict or confidence, low (an
    accept below ``least``), else applied.
    """
    known = candidates.select("doc_id", "candidate_id").distinct().withColumn("known", F.lit(True))
    d = decisions.select("doc_id", "pos", "candidate_id", "verdict", "confidence").join(known, ["doc_id", "candidate_id"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "candidate_id").orderBy("pos"))
    bad = ~F.coalesce(F.col("verdict").isin(*VERDICTS) & F.col("confidence").between(0.0, 1.0), F.lit(False))
    outcome = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("nth") > 1, "duplicate").when(bad, "invalid")
        .when((F.col("verdict") == "accept") & (F.col("confidence") < least), "low").otherwise("applied")
    )
    return d.withColumn("nth", nth).select("doc_id", "candidate_id", "pos", "verdict", outcome.alias("outcome"))


def review_status(judged: DataFrame) -> DataFrame:
    """Status of each document's review: valid, partial or invalid: doc_id, decisions, applied, status."""
    per = judged.groupBy("doc_id").agg(F.count("*").alias("decisions"), F.count_if(F.col("outcome") == "applied").alias("applied"))
    return per.withColumn("status", F.when(F.col("applied") == F.col("decisions"), "valid").when(F.col("applied") > 0, "partial").otherwise("invalid"))


ANCHORS = "doc_id string, page_idx int, start int, text string"


def page_anchors(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Where each page begins in an article: doc_id, page_idx, start, text.

    Articles: doc_id, markdown. Texts: doc_id, page_idx, source_index, text. Of a page's
    texts, in reading order, the first that stands once in the article and behind the
    texts, in reading order, the first that stands once in the article and behind the
    page before is the anchor; pages without one are left out, and so are texts of less
    than 8 or more than 24,000 characters. As each page depends on the one before, a
    package's texts are read in order as they come, behind its article; none are held.
    """
    t = texts.select("doc_id", "page_idx", "source_index", X.trim(F.col("text")).alias("text")).filter("doc_id is not null and page_idx is not null").filter(F.length("text").between(8, 24_000))
    article = articles.filter("doc_id is not null and markdown is not null").groupBy("doc_id").agg(F.min("markdown").alias("text"))
    both = article.select("doc_id", F.lit(None).cast("int").alias("page_idx"), F.lit(None).cast("int").alias("source_index"), "text", F.lit(0).alias("of"))
    both = both.unionByName(t.select("doc_id", F.col("page_idx").cast("int"), F.col("source_index").cast("int"), "text", F.lit(1).alias("of")))
    rows = both.repartition("doc_id").sortWithinPartitions("doc_id", "of", "page_idx", "source_index", "text").select("doc_id", "page_idx", "text", "of")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, markdown, upto, done = None, None, 0, None
        for pdf in batches:
            out = []
            for d, page, text, of in zip(pdf["doc_id"], pdf["page_idx"], pdf["text"], pdf["of"]):
                if d != doc:
                    doc, markdown, upto, done = d, None, 0, None
                if of == 0:
                    markdown = text
                elif markdown is not None and page != done:
                    at = markdown.find(text)
                    if at >= upto and markdown.find(text, at + 1) < 0:
                        out.append((d, page, at, text))
                        upto, done = at + len(text), page
            yield pd.DataFrame(out, columns=["doc_id", "page_idx", "start", "text"]).astype({"page_idx": "int32", "start": "int32"})

    return rows.mapInPandas(walk, ANCHORS)


def closure(references: DataFrame, files: DataFrame) -> DataFrame:
    """What an export needs and lacks: package_id, path, status (included, unavailable or unreferenced).

    References and files: package_id, path.
    """
    want, have = references.select("package_id", "path").distinct(), files.select("package_id", "path").distinct()
    both = want.withColumn("w", F.lit(1)).join(have.withColumn("h", F.lit(1)), ["package_id", "path"], "full")
    return both.select("package_id", "path", F.when(F.col("h").isNull(), "unavailable").when(F.col("w").isNull(), "unreferenced").otherwise("included").alias("status"))


def visual_labels(visuals: DataFrame) -> DataFrame:
    """Labels of visuals, unique in their document: doc_id, pos, label.

    Visuals: doc_id, pos, caption. A label comes from the caption; without one, or if
    an earlier visual has it, it is the next free ``Fig. n`` from the visual's own
    place on. As a label depends on those before, a document's visuals, which are few,
    are taken in order.
    """

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        labels = []
        ordered = pdf.sort_values("pos").reset_index(drop=True)
        for i, label in enumerate(ordered["label"], 1):
            n = i
            while not isinstance(label, str) or not label or label.lower() in used:
                label, n = f"Fig. {n}", n + 1
            used.add(label.lower())
            labels.append(label)
        return ordered.assign(label=labels)[["doc_id", "pos", "label"]]

    named = visuals.select("doc_id", "pos", X.explicit_label(F.col("caption")).alias("label"))
    return named.groupBy("doc_id").applyInPandas(name, "doc_id string, pos int, label string")


#: Length of a paragraph by which a gap beside it can be placed, and the share of the gap that other blocks may cover.
ANCHOR_CHARS, COVERED = (24, 20_000), 0.08


def paragraph_gaps(elements: DataFrame) -> DataFrame:
    """Blocks of the body whose text was lost between two paragraphs: doc_id, id, page_idx, source_index, box, previous, previous_text, next, next_text.

    A gap has the type of a text, no text and no caption, and stands where a paragraph
    can. The located blocks before and behind it are whole paragraphs (without lost
    characters or captions) on its page or the next one, one of them on its page and
    in its column. Nothing but text may cover it. Neighbours pass between blocks of
    ``ordered.BLOCK`` elements, so a large package is spread.
    """
    captions = F.length(F.concat_ws("", "image_caption", "table_caption"))
    unit = lambda c: F.struct(*[(e / G.EXTENT).alias(n) for n, e in (("x", G.part(c, 0)), ("y", G.part(c, 1)), ("width", G.width(c)), ("height", G.height(c)))])
    blocks = viewer_blocks(elements).filter("box is not null").select(
        "doc_id", "source_index", "id", "page_idx", "role", "box", X.trim(F.coalesce("text", F.lit(""))).alias("body"),
        ((F.lower(F.trim("type")) == "text") & (captions == 0)).alias("plain"),
    )
    anchor = F.col("role").isin("text", "title") & F.col("plain") & F.length("body").between(*ANCHOR_CHARS) & ~F.col("body").contains("\ufffd")
    rows = blocks.withColumn("anchor", F.coalesce(anchor, F.lit(False)))
    near = with_neighbours(rows, "doc_id", "source_index", ["id", "page_idx", "box", "body", "anchor"])
    beside = lambda side: F.col(f"{side}_page_idx") == F.col("page_idx")
    column = (beside("prev") & G.stacked(unit(F.col("prev_box")), unit(F.col("box")))) | (beside("next") & G.stacked(unit(F.col("box")), unit(F.col("next_box"))))
    lost = near.filter((F.col("role") == "text") & F.col("plain") & (F.col("body") == "") & G.paragraph_place(unit(F.col("box"))))
    open_ = lost.filter("prev_anchor and next_anchor").filter((F.abs(F.col("prev_page_idx") - F.col("page_idx")) <= 1) & (F.abs(F.col("next_page_idx") - F.col("page_idx")) <= 1)).filter(column)
    others = blocks.filter("role <> 'text'").select(F.col("doc_id").alias("d"), F.col("page_idx").alias("p"), F.col("box").alias("other"))
    free = open_.join(others, (F.col("doc_id") == F.col("d")) & (F.col("page_idx") == F.col("p")) & (G.intersection_ratio(F.col("box"), F.col("other")) > COVERED), "left_anti")
    return free.select(
        "doc_id", "id", "page_idx", "source_index", "box", F.col("prev_id").alias("previous"), F.col("prev_body").alias("previous_text"), F.col("next_id").alias("next"), F.col("next_body").alias("next_text")
    )


def recovery_requests(gaps: DataFrame, articles: DataFrame) -> DataFrame:
    """Gaps that have one place in their article: doc_id, request_id, id, start, end.

    The paragraphs before and behind stand once each, with only white space between
    them; a place that several gaps claim is none. Articles: doc_id, markdown.
    """
    a = articles.filter("doc_id is not null and markdown is not null").select("doc_id", "markdown")
    at = gaps.join(a, "doc_id").withColumn("a", X.unique_position(F.col("markdown"), F.col("previous_text"))).withColumn("start", F.col("a") + F.length("previous_text")).withColumn("end", X.unique_position(F.col("markdown"), F.col("next_text")))
    between = F.substring(F.col("markdown"), F.col("start") + 1, F.col("end") - F.col("start"))
    placed = at.filter((F.col("start") < F.col("end")) & (F.length(X.trim(between)) == 0))
    request = F.format_string("mineru-paragraph-%06d", "source_index")
    return single_claims(placed.select("doc_id", request.alias("request_id"), "id", "start", "end"), ["doc_id", "start", "end"])


def insert_paragraph(markdown: Column, start: Column, end: Column, text: Column) -> Column:
    """An article with a recovered paragraph in a gap; null if the article already holds its words, or the text has none."""
    compact = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    fresh = (F.length(compact(text)) > 0) & (F.instr(compact(markdown), compact(text)) == 0)
    return F.when(fresh, F.concat(F.substring(markdown, F.lit(1), start), F.lit("\n\n"), paragraph_markup(text), F.lit("\n\n"), F.substring(markdown, end + 1, F.length(markdown))))
