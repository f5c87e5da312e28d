"""Markdown as tables of lines, headings, images and anchors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.functions.paths import asset_path


def line_table(documents: DataFrame) -> DataFrame:
    """Lines of each text: doc_id, line_no (from 1), start (UTF-16 units), text.

    A text is cut at line feeds; null texts have no lines, an empty one has one. The
    window runs within a document.
    """
    lines = documents.filter("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    before = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(X.utf16_length(F.col("text")) + 1).over(before), F.lit(0))
    return lines.select("doc_id", (F.col("p") + 1).alias("line_no"), start.alias("start"), "text")


def _lines(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("p", "line"))


def headings(documents: DataFrame) -> DataFrame:
    """Headings outside fenced code: doc_id, heading_id, level, label, line, end_line.

    Both forms count: with number signs, and underlined. A section ends before the
    next heading of its level or a higher one. Front matter is skipped. Windows run
    within a document.
    """
    lines = _lines(documents)
    w = Window.partitionBy("doc_id").orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.regexp_extract("line", P.FENCE, 1)
    closes_front = (F.col("p") > 0) & F.col("line").rlike(r"^(?:---|\.\.\.)\s*$")
    rows = lines.withColumn("opens", F.first(X.trim(F.col("line")) == "---").over(w)).withColumn("front_end", F.min(F.when(closes_front, F.col("p"))).over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("front", F.col("opens") & (F.col("front_end").isNull() | (F.col("p") <= F.col("front_end"))))
    # a fence is closed by the same sign, as often or more: fences in turn open and close in nearly all texts,
    # and the others are settled by walking over the fences of the document, which are few
    fences = rows.filter((mark != "") & ~F.col("front")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", F.substring(mark, 1, 1).alias("sign"), F.length(mark).alias("n")))).alias("f"))
    state = F.aggregate(
        "f",
        F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(-1).alias("at"), F.lit("").alias("sign"), F.lit(0).alias("n")),
        lambda s, x: F.when(s["at"] < 0, F.struct(s["spans"].alias("spans"), x["p"].alias("at"), x["sign"].alias("sign"), x["n"].alias("n")))
        .when((x["sign"] == s["sign"]) & (x["n"] >= s["n"]), F.struct(F.concat(s["spans"], F.array(F.struct(s["at"].alias("a"), x["p"].alias("b")))).alias("spans"), F.lit(-1).alias("at"), F.lit("").alias("sign"), F.lit(0).alias("n")))
        .otherwise(s),
        lambda s: F.when(s["at"] >= 0, F.concat(s["spans"], F.array(F.struct(s["at"].alias("a"), F.lit(2147483647).alias("b"))))).otherwise(s["spans"]),
    )
    rows = rows.join(fences.select("doc_id", state.alias("spans")), "doc_id", "left")
    fenced = F.coalesce(F.exists("spans", lambda x: (F.col("p") >= x["a"]) & (F.col("p") <= x["b"])), F.lit(False))
    previous = X.trim(F.coalesce(F.lag("line").over(w), F.lit("")))
    clean = lambda c: F.substring(X.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[*_`~\[\]]", ""), r"\s+", " ")), 1, 512)
    atx = F.col("line").rlike(P.ATX)
    under = (F.col("p") > 0) & F.col("line").rlike(P.SETEXT) & (previous != "") & ~previous.rlike(P.LIST_ITEM)
    marked = rows.withColumn("under", under).withColumn("previous", previous).filter(~F.col("front") & ~fenced)
    found = marked.select(
        "doc_id",
        F.when(atx, F.length(F.regexp_extract("line", P.ATX, 1))).when(F.col("under"), F.when(F.col("line").contains("="), 1).otherwise(2)).alias("level"),
        F.when(atx, clean(F.regexp_extract("line", P.ATX, 2))).otherwise(F.substring(F.regexp_replace("previous", r"<[^>]*>", ""), 1, 512)).alias("label"),
        F.when(atx, F.col("p") + 1).otherwise(F.col("p")).alias("line"),
    ).filter("level is not null and label <> ''")
    total = lines.groupBy("doc_id").agg(F.count("*").cast("int").alias("lines"))
    h = Window.partitionBy("doc_id").orderBy("line")
    # the next heading of the level or a higher one: the least of the next headings by level
    ahead = h.rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(ahead) for k in range(1, 7)]
    end = F.element_at(F.array(*nexts), F.col("level"))
    return (
        found.join(total, "doc_id")
        .withColumn("heading_id", F.format_string("heading-%04d", F.row_number().over(h)))
        .withColumn("end_line", F.coalesce(end - 1, F.col("lines")))
        .select("doc_id", "heading_id", "level", "label", "line", "end_line")
    )


def bounded_section(documents: DataFrame, start_line: int = 1, most_lines: int = 120, most_bytes: int = 256 * 1024) -> DataFrame:
    """The first lines from a line on, as long as they are within both bounds: doc_id, end_line, lines, bytes, truncated.

    A first line that is too long by itself counts as one line of ``most_bytes``.
    """
    lines = _lines(documents).select("doc_id", (F.col("p") + 1).alias("n"), F.octet_length("line").alias("b")).filter(F.col("n") >= start_line)
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sized = lines.withColumn("upto", F.sum(F.col("b") + F.when(F.col("n") > start_line, 1).otherwise(0)).over(upto)).withColumn("rank", F.col("n") - start_line + 1)
    fits = ((F.col("rank") <= most_lines) & (F.col("upto") <= most_bytes)) | (F.col("rank") == 1)
    return sized.groupBy("doc_id").agg(
        F.max(F.when(fits, F.col("n"))).alias("end_line"), F.count_if(fits).alias("lines"),
        F.max(F.when(fits, F.least("upto", F.lit(most_bytes)))).alias("bytes"), (F.count_if(~fits) > 0).alias("truncated"),
    )


def anchor_inventory(documents: DataFrame) -> DataFrame:
    """Anchor comments of each text: doc_id, line_no, kind (block, slot or malformed), id, detail."""
    lines = _lines(documents).filter(F.col("line").contains("<!-- p2md:"))
    block, slot = F.col("line").rlike(P.BLOCK_MARK), F.col("line").rlike(P.SLOT_MARK)
    return lines.select(
        "doc_id", (F.col("p") + 1).alias("line_no"), F.when(block, "block").when(slot, "slot").otherwise("malformed").alias("kind"),
        F.when(block, F.regexp_extract("line", P.BLOCK_MARK, 1)).when(slot, F.regexp_extract("line", P.SLOT_MARK, 1)).alias("id"),
        F.when(block, F.regexp_extract("line", P.BLOCK_MARK, 2)).when(slot, F.regexp_extract("line", P.SLOT_MARK, 2)).alias("detail"),
    )


IMAGES = "doc_id {kind}, id string, order int, asset_path string, occurrence int, syntax string, start int, end int"


def image_occurrences(documents: DataFrame) -> DataFrame:
    """Images of each text in order, in Markdown and HTML syntax: id, order, path, occurrence of the path, UTF-16 range.

    Only local paths count; see ``functions.paths.asset_path``.
    """
    import re

    markdown = re.compile(P.IMAGE)
    html = re.compile(r"""<img\b[^>]*\bsrc=["']([^"']+)["']""", re.I)
    kind = documents.schema["doc_id"].dataType.simpleString()
    src = documents.filter("doc_id is not null").filter(F.col("text").contains("![") | F.lower("text").contains("<img")).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = lambda s: len(s) + sum(ord(c) > 0xFFFF for c in s)
        for b in batches:
            at, syntax, path, start, end = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                seen = [(m.start(), m.end(), "markdown", m[1] or m[2]) for m in markdown.finditer(t)]
                seen += [(m.start(), m.end(), "html", m[1]) for m in html.finditer(t)]
                for a, z, s, p in sorted(seen):
                    at.append(i)
                    syntax.append(s)
                    path.append(p)
                    start.append(units(t[:a]))
                    end.append(units(t[:z]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(syntax, pa.string()), pa.array(path, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                names=["doc_id", "syntax", "raw", "start", "end"],
            )

    spans = src.mapInArrow(run, f"doc_id {kind}, syntax string, raw string, start int, end int").withColumn("asset_path", asset_path(F.col("raw"))).filter("asset_path is not null")
    order = Window.partitionBy("doc_id").orderBy("start")
    nth = Window.partitionBy("doc_id", "asset_path").orderBy("start")
    n = F.row_number().over(order) - 1
    return spans.select("doc_id", F.format_string("md-img-%04d", n).alias("id"), n.alias("order"), "asset_path", (F.row_number().over(nth) - 1).alias("occurrence"), "syntax", "start", "end")


def nearby_lines(documents: DataFrame, limit: int = 3, most_blank: int = 2) -> DataFrame:
    """For each line that is not blank the nearest such lines around it: doc_id, line_no, before (nearest first), after.

    At most ``limit`` on either side (the feature), and none beyond more than
    ``most_blank`` blank lines in a row. A text is thus cut into runs, and the
    windows run within a run.
    """
    lines = _lines(documents).filter(F.length(X.trim(F.col("line"))) > 0)
    w = Window.partitionBy("doc_id").orderBy("p")
    gap = F.coalesce(F.col("p") - F.lag("p").over(w) > most_blank + 1, F.lit(False)).cast("int")
    runs = lines.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("doc_id", "run").orderBy("p")
    before, after = F.collect_list("line").over(r.rowsBetween(-limit, -1)), F.collect_list("line").over(r.rowsBetween(1, limit))
    return runs.select("doc_id", (F.col("p") + 1).alias("line_no"), F.reverse(before).alias("before"), after.alias("after"))
