"""Text functions of the captions, titles and Markdown, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import patterns as P


def trim(c: Column) -> Column:
    """Without white space at both ends, the no-break and wide blanks included."""
    return F.regexp_replace(c, P.TRIM, "")


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(P.NOT_WS), c)


def _unicode_form(form: str):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s, use_na_sentinel=True)
            forms = [unicodedata.normalize(form, v) for v in values]
            yield pd.Series([forms[c] if c >= 0 else None for c in codes], index=s.index, dtype=object)

    return run


def nfkc(c: Column) -> Column:
    """Compatibility composed form; ASCII texts do not leave the JVM."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(c.isNull() | plain, c).otherwise(_unicode_form("NFKC")(F.when(~plain, c)))


def fold_title(c: Column) -> Column:
    """Lower case, all but letters and numbers as one blank; for text in compatibility form."""
    return F.trim(F.regexp_replace(F.lower(c), P.NOT_WORD, " "))


def normalize_title(c: Column) -> Column:
    """Title by which records are compared: compatibility form, folded."""
    return fold_title(nfkc(c))


def title_tokens(normal: Column) -> Column:
    """Distinct tokens of a normalized title, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal, " "), lambda x: F.length(x) > 0)))


def dice(left: Column, right: Column) -> Column:
    """Twice the shared tokens over all tokens of two token sets; 0 if one is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), 2.0 * both / (F.size(left) + F.size(right))).otherwise(0.0)


def _figure_kind(raw: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(low.startswith("extended"), "extended-data-figure")
        .when(low.startswith("supplementary"), "supplementary-figure")
        .when(low.startswith("supporting"), "supporting-figure")
        .when(low == "图", "图")
        .otherwise("figure")
    )


def figure_key(c: Column) -> Column:
    """``Fig. 2.1`` as ``figure:2_1``; null if the text does not begin with a figure's number."""
    number = F.lower(F.replace(F.regexp_extract(c, P.FIGURE_KEY, 2), F.lit("."), F.lit("_")))
    return F.when(c.rlike(P.FIGURE_KEY), F.concat(_figure_kind(F.regexp_extract(c, P.FIGURE_KEY, 1)), F.lit(":"), number))


def formal_figure_key(c: Column) -> Column:
    """The key if a title of five characters or more follows that is not just a reference to the figure."""
    rest = F.regexp_replace(c, P.FIGURE_KEY, "")
    title = trim(F.regexp_extract(rest, P.FORMAL_TITLE, 1))
    return F.when(c.rlike(P.FIGURE_KEY) & (F.length(title) >= 5) & ~title.rlike(P.REFERENCE_VERB), figure_key(c))


def next_page_key(c: Column) -> Column:
    """The key if the text only says that the caption is on the next page."""
    return F.when(c.rlike(P.NEXT_PAGE_ONLY), figure_key(c))


def ends_with_terminal(c: Column) -> Column:
    """Whether a text ends in a full stop or the like, closing tags and brackets aside."""
    return trim(F.regexp_replace(trim(c), P.CLOSING_TAGS, "")).rlike(P.TERMINAL)


def first_letter_is_lower(c: Column) -> Column:
    """Whether the first letter is lower case; false for scripts without case and texts without letters."""
    x = F.regexp_extract(c, r"\p{L}", 0)
    return (x == F.lower(x)) & (x != F.upper(x))


def caption_item_kind(c: Column) -> Column:
    """Class of a caption item: next-page-placeholder, formal-caption, panel-label, caption-continuation or other."""
    goes_on = (F.length(c) >= 24) & figure_key(c).isNull() & ends_with_terminal(c) & (c.rlike(P.PANEL_START) | first_letter_is_lower(c))
    return (
        F.when(c.isNull(), None)
        .when(next_page_key(c).isNotNull(), "next-page-placeholder")
        .when(c.rlike(P.NEXT_PAGE_INSIDE), "other")
        .when(formal_figure_key(c).isNotNull(), "formal-caption")
        .when(c.rlike(P.PANEL_LABEL), "panel-label")
        .when(goes_on, "caption-continuation")
        .otherwise("other")
    )


def string_list(c: Column) -> Column:
    """Items of a string array, trimmed, without blank and null ones; empty for null."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), trim), lambda x: x.isNotNull() & (F.length(x) > 0))


def string_summary(items: Column) -> Column:
    """Count, code points and SHA-256 of strings joined by line feeds (null if there are none)."""
    return F.struct(
        F.size(items).alias("item_count"),
        F.aggregate(items, F.lit(0), lambda a, x: a + F.length(x)).alias("char_count"),
        F.when(F.size(items) > 0, F.sha2(F.array_join(items, "\n"), 256)).alias("sha256"),
    )


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def canonical_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(trim(c), r"[.,;]+$", ""))


def numeric_year(c: Column) -> Column:
    """A year from 1400 to 3000, else null."""
    year = c.try_cast("int")
    return F.when(year.between(1400, 3000), year)


def decode_entities(c: Column) -> Column:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def tidy_markdown(c: Column) -> Column:
    """Without blanks at line ends, at most one empty line in a row, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def safe_link(c: Column) -> Column:
    """The link if it is http(s), mailto or within the page; else null."""
    t = trim(c)
    return F.when(t.rlike(r"(?i)^(?:https?://|mailto:|#)"), t)


def without_frontmatter(c: Column) -> Column:
    """Without a leading block between lines of three dashes that holds ``key:`` lines."""
    block = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)"
    return F.when(F.regexp_extract(c, block, 1).rlike(r"(?m)^[A-Za-z_][\w-]*[ \t]*:"), F.regexp_replace(c, block, "")).otherwise(c)


def paragraph_text(c: Column) -> Column:
    """Soft hyphens removed, words divided at line ends joined, white space collapsed."""
    joined = F.regexp_replace(F.regexp_replace(c, r"\x{AD}", ""), r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2")
    return trim(F.regexp_replace(joined, rf"{P.WS}+", " "))


def looks_like_paragraph(c: Column) -> Column:
    """Whether a text looks like a complete paragraph of the body.

    48 to 6000 characters from a capital or number to a terminal mark, no caption or
    heading, 8 to 1200 tokens, and letters make up at least 0.52 of what is visible.
    """
    n = F.length(c)
    tokens = F.size(F.filter(F.split(c, rf"{P.WS}+"), lambda x: F.length(x) > 0))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    visible = F.length(F.regexp_replace(c, P.WS, ""))
    return (
        n.between(48, 6000)
        & c.rlike(r"^[\p{Lu}\p{N}]")
        & c.rlike(r"[.!?。！？][\"'”’)\]]*$")
        & ~c.rlike(r"(?i)^(?:fig(?:ure)?|table|图|表)\.?\s*\d")
        & ~c.rlike(r"^#{1,6}\s")
        & tokens.between(8, 1200)
        & (letters >= 0.52 * visible)
    )


def unique_position(text: Column, part: Column) -> Column:
    """0-based place of ``part`` if ``text`` holds it exactly once, else null; null for an empty part."""
    at = F.instr(text, part)
    again = F.instr(F.substring(text, at + 1, F.length(text)), part)
    return F.when((F.length(part) > 0) & (at > 0) & (again == 0), at - 1)


def stable_id(prefix: str, sequence: Column) -> Column:
    """``prefix_`` and the sequence as 24 hexadecimal digits."""
    return F.concat(F.lit(prefix + "_"), F.lpad(F.lower(F.hex(sequence)), 24, "0"))


def content_id(prefix: Column, *parts: Column) -> Column:
    """``prefix-`` and the first 24 digits of the SHA-256 over the parts, joined by the unit separator."""
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def panel_letters(c: Column) -> Column:
    """Panel letters that a caption names, ranges spread out: ``(a–c)`` gives a, b, c."""
    spans = F.regexp_extract_all(F.lower(c), F.lit(r"\(([a-z])(?:\s*[-–—]\s*([a-z]))?\)"), F.lit(0))

    def spread(s: Column) -> Column:
        first = F.ascii(F.substring(s, 2, 1))
        last = F.ascii(F.substring(F.regexp_replace(s, r"[^a-z]", ""), -1, 1))
        return F.transform(F.sequence(F.least(first, last), F.greatest(first, last)), lambda x: F.char(x))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, spread))))


def figure_label(c: Column, fallback: Column) -> Column:
    """The label at the start of a caption (``Fig. 3``), else the fallback."""
    got = F.regexp_extract(c, r"(?i)^\s*((?:fig(?:ure)?|table|chart)\.?\s*[A-Za-z]?\d+[A-Za-z]?|[图表]\s*\d+)", 1)
    return F.when(F.length(got) > 0, got).otherwise(fallback)


def fold_python(text: str) -> str:
    """As ``normalize_title``, for a single text."""
    import re

    folded = unicodedata.normalize("NFKC", text).lower()
    return " ".join(re.sub(r"[\W_]+", " ", folded).split())


def explicit_label(c: Column) -> Column:
    """The label that a caption, alt text or file name states (``Extended Data Fig. 3``), else null."""
    plain = F.regexp_replace(decode_entities(c), r"[_-]+", " ")
    number = r"\s*([A-Za-z]?\d+[A-Za-z]?)\b"
    out = F.lit(None).cast("string")
    kinds = (
        (r"(?i)[图表]" + number, None), (r"(?i)\bTable" + number, "Table "), (r"(?i)\bFig(?:ure)?\.?" + number, "Fig. "),
        (r"(?i)\bSupp(?:lementary)?\s+Fig(?:ure)?\.?" + number, "Supplementary Fig. "), (r"(?i)\bExtended\s+Data\s+Fig(?:ure)?\.?" + number, "Extended Data Fig. "),
    )
    for pattern, prefix in kinds:
        head = F.lit(prefix) if prefix else F.when(plain.contains("表"), "表 ").otherwise("图 ")
        out = F.when(plain.rlike(pattern), F.concat(head, F.regexp_extract(plain, pattern, 1))).otherwise(out)
    return out


def readable_caption(c: Column) -> Column:
    """A caption without entities, links, images, tags, escapes and emphasis."""
    steps = (
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?i)<br\s*/?>", " "), (r"<[^>]+>", ""), (r"\\([\\`*{}\[\]()#+\-.!_>])", "$1"),
        (r"(?:\*\*|__|~~|`)(.+?)(?:\*\*|__|~~|`)", "$1"), (r"\s+", " "),
    )
    out = decode_entities(c)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return trim(out)


def caption_segments(c: Column) -> Column:
    """Parts of a caption: array of kind (text, sup, sub or math) and text.

    Superscripts and subscripts are tags, math stands between dollar signs on one
    line, at most 512 characters; a dollar sign behind a backslash is text.
    """

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        mark = re.compile(r"<(sup|sub)>([^<>]*)</\1>|(?<!\\)\$((?:[^$\n\\]|\\.){1,512})(?<!\\)\$", re.I)

        def cut(s: str) -> list[dict[str, str]]:
            out, at = [], 0
            for m in mark.finditer(s):
                if m.start() > at:
                    out.append({"kind": "text", "text": s[at : m.start()]})
                out.append({"kind": m[1].lower(), "text": m[2]} if m[1] else {"kind": "math", "text": m[3]})
                at = m.end()
            return out + ([{"kind": "text", "text": s[at:]}] if at < len(s) else [])

        for s in batches:
            yield s.map(cut, na_action="ignore")

    return run(c)


def is_caption_line(c: Column) -> Column:
    """Whether a line can be a caption: not blank and no heading, fence, quote, list item, footnote, rule or image."""
    t = trim(c)
    return F.coalesce((F.length(t) > 0) & ~t.rlike(r"^(?:#{1,6}\s|```|~~~|>|[-+*]\s|\d+[.)]\s|\[\^[^\]]+\]:|---+$|___+$|!\[[^\]]*\]\([^)]*\)$|(?i)<img\b[^>]*>$)"), F.lit(False))


def local_resources(c: Column) -> Column:
    """Resources that a Markdown text names: array of target and whether it is local."""
    inline = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(\s*<?([^\s)>]+)"), F.lit(1))
    html = F.regexp_extract_all(c, F.lit(r"(?i)<(?:img|source|video|audio)\b[^>]*\bsrc=[\"']([^\"']+)[\"']"), F.lit(1))
    wiki = F.regexp_extract_all(c, F.lit(r"!\[\[([^\]|#]+)"), F.lit(1))
    local = lambda x: ~x.rlike(P.SCHEME) & ~x.rlike(r"^[/\\]|(?:^|/)\.\.(?:/|$)")
    return F.transform(F.concat(inline, html, wiki), lambda x: F.struct(x.alias("target"), local(x).alias("local")))
