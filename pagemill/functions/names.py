"""Names, labels and front matter made of free text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions.text import nfkc, trim

#: File name endings of the image types that are kept (fixed values).
EXTENSIONS = {"image/bmp": "bmp", "image/gif": "gif", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
_CONTROL = r"[\x{00}-\x{1F}\x{7F}]"
_SPACES = P.WS + "+"


def one_line(c: Column) -> Column:
    """All white space as single blanks, none at the ends."""
    return trim(F.regexp_replace(c, _SPACES, " "))


def bounded(c: Column, most: int) -> Column:
    """One line of at most ``most`` characters (the feature); null for null and blank texts."""
    return F.nullif(F.substring(one_line(c), 1, most), F.lit(""))


def printable_label(c: Column, fallback: Column) -> Column:
    """A label without control characters, at most 512 characters, or the fallback."""
    return F.coalesce(bounded(F.regexp_replace(c, _CONTROL + "+", " "), 512), fallback)


def yaml_text(c: Column) -> Column:
    """A text as a quoted YAML scalar on one line; null for null."""
    quoted = F.to_json(F.struct(trim(F.regexp_replace(c, _CONTROL, " ")).alias("t")))
    return F.when(c.isNotNull(), F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def heading_text(c: Column) -> Column:
    """A text as it may stand behind the sign of a Markdown heading."""
    plain = F.regexp_replace(c, r"[\x{00}-\x{20}\x{7F}]+", " ")
    return F.coalesce(F.nullif(trim(F.regexp_replace(plain, r"([\\`*{}\[\]()#+\-.!_>])", r"\\$1")), F.lit("")), F.lit("Untitled paper"))


def paragraph_markup(c: Column) -> Column:
    """A recovered text as a Markdown paragraph that shows it as it is."""
    entities = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(entities, r"([\\`*_\[\]!$])", r"\\$1")


def archive_name(title: Column, ending: str = ".zip") -> Column:
    """Name of the archive of a paper, with the writer's ending."""
    plain = one_line(F.regexp_replace(nfkc(title), r'[<>:"/\\|?*\x{00}-\x{1F}]', " "))
    return F.concat(F.coalesce(F.nullif(F.substring(plain, 1, 120), F.lit("")), F.lit("paper")), F.lit(ending))


def archive_stem(name: Column) -> Column:
    """Name of an archive without its ending, of plain characters only; ``paper`` for null."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("paper")), r"(?i)(?:\.mineru)?\.zip$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("paper"))


def image_extension(mime: Column) -> Column:
    """Ending for a media type without its parameters; null for a type that is not kept."""
    kind = F.lower(trim(F.substring_index(mime, ";", 1)))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), kind)


def words(c: Column) -> Column:
    """Runs of letters and digits, lower case, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def prefix_place(content: Column, recovered: Column, least: int = 7, most: int = 14) -> Column:
    """Index of the word of ``content`` at which the first words of ``recovered`` stand, if they stand there once; else -1."""
    have, want = words(content), words(recovered)
    n = F.least(F.lit(most), F.size(want))
    head = F.slice(want, 1, F.greatest(n, F.lit(1)))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(have) - n + 1, F.lit(1))), lambda i: F.slice(have, i, F.greatest(n, F.lit(1))) == head)
    return F.when((n >= least) & (F.size(have) >= n) & (F.size(at) == 1), at[0] - 1).otherwise(-1)


def article_text(title: Column, content: Column, fields: dict[str, Column], tags: tuple[str, ...] = ()) -> Column:
    """An article with its front matter and, where the content has no first heading, its title."""
    rows = [F.concat(F.lit(f"{k}: "), F.coalesce(yaml_text(v), F.lit('""'))) for k, v in {"title": title, **fields}.items()]
    front = F.concat_ws("\n", F.lit("---"), *rows, *[F.lit(x) for x in (("tags:", *(f"  - {t}" for t in tags)) if tags else ())], F.lit("---"))
    body = trim(F.coalesce(content, F.lit("")))
    head = F.when(body.startswith("# "), "").otherwise(F.concat(F.lit("# "), heading_text(F.coalesce(title, F.lit(""))), F.lit("\n\n")))
    return F.concat(front, F.lit("\n\n"), head, body, F.lit("\n"))
