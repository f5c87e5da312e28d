"""Content lists of an extractor as the elements table, on the JVM by variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "type": "string", "text": "string", "text_level": "int", "bbox": "array<double>", "img_path": "string", "image_caption": "array<string>", "image_footnote": "array<string>",
    "table_caption": "array<string>", "table_footnote": "array<string>", "table_body": "string", "sub_type": "string",
}


def elements(lists: DataFrame) -> DataFrame:
    """Elements of JSON texts (doc_id, json): doc_id, source_index, page_idx and ``FIELDS``.

    A list of arrays is taken by page, but only if every item is an array; else
    each item is an element with its own ``page_idx``. Items that are no objects keep
    their index and give a row without a type. A null text, or one that is no JSON
    array, gives no rows. Values of another type are null.
    """
    top = lists.select("doc_id", F.try_parse_json("json").alias("v")).filter(F.schema_of_variant("v").startswith("ARRAY"))
    nested = top.select("doc_id", "v", F.try_variant_get("v", "$", "array<variant>").alias("items")).withColumn(
        "by_page", (F.size("items") > 0) & F.forall("items", lambda x: F.schema_of_variant(x).startswith("ARRAY"))
    )
    pages = nested.select("doc_id", "by_page", F.when(F.col("by_page"), F.col("items")).otherwise(F.array("v")).alias("pages"))
    each = pages.select("doc_id", "by_page", F.posexplode("pages").alias("page", "p")).select("doc_id", "by_page", "page", F.posexplode(F.try_variant_get("p", "$", "array<variant>")).alias("pos", "e"))
    # numbered through the pages of one document, in one array of it
    numbered = each.groupBy("doc_id", "by_page").agg(F.sort_array(F.collect_list(F.struct("page", "pos", F.to_json("e").alias("j")))).alias("all"))
    flat = numbered.select("doc_id", "by_page", F.posexplode("all").alias("source_index", "x")).select("doc_id", "by_page", "source_index", F.col("x.page").alias("page"), F.try_parse_json("x.j").alias("e"))
    get = lambda name, kind: F.try_variant_get("e", f"$.{name}", kind)
    own_page = get("page_idx", "int")
    return flat.select(
        "doc_id", "source_index", F.when(F.col("by_page"), F.col("page")).when(own_page >= 0, own_page).alias("page_idx"), *[get(n, k).alias(n) for n, k in FIELDS.items()]
    )
