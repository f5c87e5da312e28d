"""One consistent form for texts that look the same.

The method named for this problem (compatibility composition, full case folding,
mapped white space, removal of default-ignorable characters) also joins texts that a
reader tells apart: raised digits, ligatures, case. So compatibility is limited to
the width of characters, case stays, and look-alike letters are mapped; the rest is
as named: canonical composition, mapped blanks, no ignorable characters, computed
once for each distinct value of a batch. ``full_fold`` gives the form named.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import checkpoint

#: Letters of other scripts with the shape of a Latin letter (fixed values).
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
CYRILLIC = ("АВЕКМНОРСТУХЅІЈԌԚԜаеорсухѕіјԁԛԝһӏ", "ABEKMHOPCTYXSIJGQWaeopcyxsijdqwhl")
ARMENIAN = ("ՕՏօոսհ", "OSonuh")
#: Scripts whose capitals were taken from the Latin alphabet.
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
CHEROKEE = ("ᎠᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏟᏞᏢᏦᏴ", "DAJEWMHGZVSCLPKB")
#: Other letters of one shape.
SINGLE = ("νɡ", "vg")
#: Hyphens of the length of the hyphen-minus.
HYPHENS = "‐‑"
#: Blanks of one place.
BLANKS = "               　"
#: Ranges of default-ignorable code points.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

#: A form with more texts than this is split, and the parts into which it and the copies of a text are spread.
HOT_FORM, SALTS = 512, 16

_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]")
_MAP: dict[int, str] = {}
for _from, _to in (GREEK, CYRILLIC, ARMENIAN, LISU, CHEROKEE, SINGLE):
    _MAP.update(zip(map(ord, _from), _to))
_MAP.update({ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS} | {0xB5: "μ"})


def _widths() -> dict[int, str]:
    """Full-width and half-width forms, by their decomposition tag."""
    out = {}
    for c in range(0xFF01, 0xFFEF):
        tag, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if tag in ("<wide>", "<narrow>"):
            out[c] = "".join(chr(int(x, 16)) for x in rest.split())
    return out


_MAP.update(_widths())


def look(text: str) -> str:
    """The consistent form of one text: equal for texts that look the same."""
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFD", _INVISIBLE.sub("", text)).translate(_MAP)
    return unicodedata.normalize("NFC", plain)


def full_fold(text: str) -> str:
    """Compatibility composed form, fully case folded, all white space as one blank, without ignorable characters."""
    folded = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def _per_value(f):
    """A column function that applies ``f`` once to each distinct value of a batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s, use_na_sentinel=True)
            forms = [f(v) for v in values]
            yield pd.Series([forms[c] if c >= 0 else None for c in codes], index=s.index, dtype=object)

    # else the optimizer repeats the call for each use of its result
    return run.asNondeterministic()


def consistent_form(text: Column) -> Column:
    """``look`` of a column; null for null, the empty string for the empty string.

    Texts of ASCII characters alone keep their form and do not leave the JVM.
    """
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(text.isNull() | plain, text).otherwise(_per_value(look)(F.when(~plain, text)))


def normalised(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the consistent form of the text, and whether it differs from the text."""
    form = documents.select(key, text, consistent_form(F.col(text)).alias("form"))
    return form.select(key, F.col("form").alias("text"), (~F.col("form").eqNullSafe(F.col(text))).alias("changed"))


def _digest(name: str) -> Column:
    return F.unhex(F.md5(F.col(name).cast("binary")))


def lookalike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents whose texts differ but have one consistent form: ``<key>_a`` < ``<key>_b``.

    Null texts and texts without a visible character are in no pair, equal texts
    neither. Documents are keyed by two digests, so the texts themselves are not
    shuffled. Pairs are formed between different texts of one form and then spread over
    their copies; a large group of equal texts alone never meets the join.
    """
    rows = (
        documents.select(F.col(key).alias("id"), F.col(text).alias("t"))
        .filter("t is not null and id is not null")
        .withColumn("form", consistent_form(F.col("t")))
        .filter(F.col("form").rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"))
        .select("id", _digest("form").alias("form"), _digest("t").alias("digest"))
    )
    # three uses of a few bytes for each document, instead of three passes over the texts
    rows = checkpoint(rows)
    # one row for each distinct text of a form, then the forms that have more than one
    distinct = rows.groupBy("form", "digest").agg(F.count("*").alias("copies"))
    mixed = distinct.groupBy("form").agg(F.count("*").alias("texts")).filter("texts > 1")
    some = distinct.join(mixed, "form")
    # pairs of texts: of a form with very many texts each task compares a part with all
    hot = F.col("texts") > HOT_FORM
    a = some.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(0)).alias("a")
    b = some.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("b")
    texts = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.digest") < F.col("b.digest"))).select(
        F.col("a.form").alias("form"), F.col("a.digest").alias("x"), F.col("b.digest").alias("y")
    )
    # then their documents: of a text with very many copies each task takes a part
    members = rows.join(some.select("form", "digest"), ["form", "digest"], "left_semi").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = spread(texts).join(members.select("form", F.col("digest").alias("x"), "salt", F.col("id").alias("p")), ["form", "x", "salt"]).drop("salt", "x")
    both = spread(left).join(members.select("form", F.col("digest").alias("y"), "salt", F.col("id").alias("q")), ["form", "y", "salt"])
    return both.filter("p <> q").select(F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b")).distinct()


def lookalike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document that has a text, with its class (digest of the form) and the numbers of documents and of different texts in it."""
    rows = documents.select(F.col(key), F.col(text).alias("t")).filter("t is not null").withColumn("form", consistent_form(F.col("t")))
    rows = checkpoint(rows.select(key, F.md5(F.col("form").cast("binary")).alias("class_id"), _digest("t").alias("digest")))
    distinct = rows.groupBy("class_id", "digest").agg(F.count("*").alias("copies"))
    size = distinct.groupBy("class_id").agg(F.sum("copies").alias("documents"), F.count("*").alias("texts"))
    return rows.select(key, "class_id").join(size, "class_id")
