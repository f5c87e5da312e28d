"""Page elements as viewer blocks: roles, boxes, reading order and summaries of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.functions.paths import asset_path

COLUMNS = (
    "doc_id", "source_index", "page_idx", "source", "type", "text", "text_level", "bbox", "img_path", "image_caption", "image_footnote", "table_caption",
    "table_footnote", "table_body", "sub_type", "received_at",
)
CAPTIONS = ("image_caption", "table_caption")
FOOTNOTES = ("image_footnote", "table_footnote")


def role(kind: Column, level: Column) -> Column:
    """Role of an element by its type: visual, table, equation, marginalia, title, text or other."""
    t = F.lower(X.trim(F.coalesce(kind, F.lit("unknown"))))
    return (
        F.when(t.isin(*P.VISUAL_TYPES), "visual")
        .when(t.isin(*P.TABLE_TYPES), "table")
        .when(t.isin(*P.EQUATION_TYPES), "equation")
        .when(t.isin(*P.MARGINAL_TYPES), "marginalia")
        .when(t.isin(*P.TITLE_TYPES) | ((t == "text") & level.isNotNull()), "title")
        .when(t.isin(*P.TEXT_TYPES), "text")
        .otherwise("other")
    )


def delivered_once(elements: DataFrame) -> DataFrame:
    """Each element once, with the columns of the elements table; rows without a key are left out."""
    return elements.select(*[c for c in COLUMNS if c in elements.columns]).filter("doc_id is not null and source_index is not null").dropDuplicates(["doc_id", "source_index"])


def block_id(page: Column, index: Column) -> Column:
    return F.format_string("p%04d-s%06d", page, index)


def viewer_blocks(elements: DataFrame) -> DataFrame:
    """Elements with a valid page as blocks, in reading order within their page.

    Boxes given as shares of the page are scaled; an invalid box is null. Elements
    without a page, or with a negative one, are no blocks. The window runs within a
    page.
    """
    e = delivered_once(elements).filter("page_idx >= 0")
    order = Window.partitionBy("doc_id", "page_idx").orderBy("source_index")
    return e.select(
        "*",
        block_id(F.col("page_idx"), F.col("source_index")).alias("id"),
        (F.row_number().over(order) - 1).alias("page_order"),
        role(F.col("type"), F.col("text_level")).alias("role"),
        G.contract_box(F.col("bbox"), True).alias("box"),
        asset_path(F.col("img_path")).alias("asset_path"),
    )


def block_issues(elements: DataFrame) -> DataFrame:
    """Elements that are no full blocks: doc_id, source_index, code."""
    e = delivered_once(elements)
    bad_page = F.coalesce(F.col("page_idx") < 0, F.lit(True))
    return e.select(
        "doc_id", "source_index",
        F.when(bad_page, "invalid_page_idx").when(G.contract_box(F.col("bbox"), True).isNull(), "missing_or_invalid_bbox").alias("code"),
    ).filter("code is not null")


def package_status(elements: DataFrame) -> DataFrame:
    """Status of each package's index: unavailable without located blocks, partial with issues, else complete."""
    e = delivered_once(elements)
    accepted = F.coalesce(F.col("page_idx") >= 0, F.lit(False))
    located = accepted & G.contract_box(F.col("bbox"), True).isNotNull()
    counted = e.groupBy("doc_id").agg(
        F.count("*").alias("elements"), F.count_if(accepted).alias("accepted"), F.count_if(located).alias("located"),
        F.countDistinct(F.when(accepted, F.col("page_idx"))).alias("pages"),
    )
    return counted.withColumn("status", F.when(F.col("located") == 0, "unavailable").when(F.col("located") < F.col("elements"), "partial").otherwise("complete"))


def caption_items(elements: DataFrame) -> DataFrame:
    """Items of the captions in order, with class and figure key."""
    e = delivered_once(elements).select("doc_id", "source_index", *CAPTIONS)
    stacked = e.select("doc_id", "source_index", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), X.string_list(F.col(f)).alias("items")) for f in CAPTIONS])).alias("s"))
    items = stacked.select("doc_id", "source_index", "s.field", F.posexplode("s.items").alias("item", "text"))
    # one expression for each, so the text functions are compiled once
    return items.select(
        "doc_id", "source_index", "field", "item", "text", X.caption_item_kind(F.col("text")).alias("kind"),
        X.figure_key(F.col("text")).alias("figure_key"), X.formal_figure_key(F.col("text")).alias("formal_key"),
    )


def caption_summaries(elements: DataFrame) -> DataFrame:
    """Counts over the caption items of each element that has any."""
    return caption_items(elements).groupBy("doc_id", "source_index").agg(
        F.count("*").alias("item_count"),
        F.sum(F.length("text")).alias("char_count"),
        F.count_if(F.length("text") >= 30).alias("long_item_count"),
        F.count_if(F.col("formal_key").isNotNull()).alias("figure_anchor_count"),
        F.count_if(F.col("text").rlike(P.PANEL_LABEL)).alias("panel_label_count"),
        F.array_sort(F.collect_set("figure_key")).alias("figure_keys"),
        F.count_if(F.col("kind") == "next-page-placeholder").alias("next_page_count"),
    )


def string_summaries(elements: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Count, characters and digest of the strings of array fields, for elements that have any."""
    items = F.flatten(F.array(*[X.string_list(F.col(f)) for f in fields]))
    s = delivered_once(elements).select("doc_id", "source_index", X.string_summary(items).alias("s"))
    return s.select("doc_id", "source_index", "s.item_count", "s.char_count", "s.sha256").filter("item_count > 0")


def element_summary(elements: DataFrame) -> DataFrame:
    """Elements and pages of each package; a package without page numbers has one page."""
    return delivered_once(elements).groupBy("doc_id").agg(F.count("*").alias("element_count"), F.coalesce(F.max("page_idx") + 1, F.lit(1)).alias("page_count"))


def best_captions(elements: DataFrame) -> DataFrame:
    """The caption that stands for each element that has items: doc_id, source_index, caption, panels.

    The longest formal caption, else the longest item; of equally long ones the
    first. ``panels`` are the different panel labels in order.
    """
    place = F.struct(F.length("text").alias("n"), -F.when(F.col("field") == "image_caption", 0).otherwise(1), -F.col("item"))
    formal = F.col("kind") == "formal-caption"
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "panel-label", F.struct(F.col("field"), F.col("item"), X.trim(F.col("text")).alias("t"))))), lambda x: x["t"])
    per = caption_items(elements).filter("text <> ''").groupBy("doc_id", "source_index").agg(
        F.coalesce(F.max_by(F.when(formal, F.col("text")), F.when(formal, place)), F.max_by("text", place)).alias("caption"), F.array_distinct(seen).alias("panels")
    )
    return per
