"""Captions whose end was lost at a field limit or in a transfer.

The lengths of all items are recomputed as characters, UTF-8 bytes, UTF-16 units,
HTML-escaped, JSON-escaped and with CR LF line ends. A length at which the items of a
source pile up, and beyond which there are none, is a storage limit. Then the endings
are inspected. What a complete ending is, is not listed but counted over all items:

* an *opener* (the first one to four words of a sentence) is followed by a full stop
  in most of its sentences or in few: with the former an open end is a cut, with the
  latter the full stop is missing by style, and the end must be of a kind (letter,
  digit, bracket, sign) that such openers have;
* a word that is frequent but hardly ever the last one of a sentence is no ending;
* a word with a full stop that is mostly followed by a number or a small letter is an
  abbreviation, and no ending either.

At a limit an ending must be known as one; elsewhere a text without such a sign of
loss is whole. An item is not cut if a later item of the same array goes on with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.runtime import checkpoint, latest

#: A mark of omission, or a character of which a byte limit left a part.
OMISSION = r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\x{FFFD})\s*$"
TERMINAL = r"[.!?。！？][\"'”’»)\]]*\s*$"
#: A number with a full stop, which at a limit may be the first part of a decimal number.
SEEMING = r"\s\d+\.\s*$"
#: What names the figure or table before the caption proper.
LABEL = r"^\s*(?:\p{Lu}\p{L}{1,11}\.?|\p{IsHan})\s*\d+\s*(?:[.:|]\s*|(?=[^\p{Ll}\s\d])|$)"
#: The letter or number of a panel, alone in an item.
PANEL = r"^\W*(?:\p{L}|[ivx]{1,4}|\d{1,2})\W*$"
SENTENCE_END = r"([.!?][\"'”’»)\]]*)\s+(?=[^\p{Ll}\s\d])|([。！？])(?=\S)"
WORD = r"\p{IsHan}|[^\s\p{IsHan}]+"

FIELDS = ("image_caption", "table_caption")
MEASURES = ("chars", "utf8", "utf16", "html", "json", "crlf")
#: A limit needs this many items, and this many times the mean count of the ten lengths before it.
LIMIT_COUNT, LIMIT_RATIO = 5, 5.0
#: Most words of an opener; an opener or a beginning is known from this many sentences on, the shape of an item from this many items on.
OPENER, SUPPORT, ITEMS = 4, 8, 4
#: A lone beginning of a word is looked up if it is no longer than this; what is longer is no beginning but a word.
BEGINNING = 24
#: From this share of sentences with a full stop on an open end is a cut; a kind of ending is usual from this share of the open ends on, at a limit from the second.
CLOSED, USUAL, USUAL_AT_LIMIT = 0.5, 0.02, 0.1
#: A word that stands this often, but at an end in no more than this share, is no ending.
INNER_COUNT, INNER_SHARE = 20, 0.02
#: A word with a full stop is an abbreviation if it stands this often, and in this share before a number or small letter.
SHORT_COUNT, SHORT_SHARE = 3, 0.5
#: Statistics with this share of all observations are at hand in every task: at most its inverse in number.
FREQUENT = 1e-5
#: Rows of the table of limits up to which it is broadcast.
MOST_BROADCAST = 10_000
_MARK = "\x01"


def caption_items(elements: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Items of the caption arrays, each element once: doc_id, source_index, source, field, item, text, following.

    Of an element delivered more than once the last ``received_at`` counts. Null and
    empty arrays have no items; null items keep their place and are left out.
    ``following`` is the next item of the array that is not blank. A null source is
    taken from the manifest where one is given; else it stays null.
    """
    one = F.when(F.size("caption") > 0, F.col("caption"))
    received = (F.col("received_at") if "received_at" in elements.columns else F.lit(None).cast("timestamp")).alias("received_at")
    key, filled = ["doc_id", "source_index"], " or ".join(f"size({f}) > 0" for f in FIELDS)
    known = elements.select(*key, "source", *FIELDS, received).filter("doc_id is not null and source_index is not null")
    # only the few elements delivered more than once are compared with their other deliveries
    repeated = checkpoint(known.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key))
    rows = known.filter(filled).join(repeated, key, "left_anti").unionByName(latest(known.join(repeated, key, "left_semi"), key).filter(filled))
    if manifests is not None:
        known, unknown = rows.filter("source is not null"), rows.filter("source is null")
        backend = manifests.select(F.col("package_id").alias("doc_id"), "backend").filter("backend is not null").groupBy("doc_id").agg(F.min("backend").alias("backend"))
        found = unknown.join(backend, "doc_id", "left").select("doc_id", "source_index", F.col("backend").alias("source"), *FIELDS)
        rows = known.select("doc_id", "source_index", "source", *FIELDS).unionByName(found)
    stacked = rows.select(
        "doc_id", "source_index", "source",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("caption")) for f in FIELDS])).alias("s"),
    ).select("doc_id", "source_index", "source", "s.field", "s.caption")
    items = stacked.select("doc_id", "source_index", "source", "field", "caption", F.posexplode(one).alias("item", "text"))
    later = F.filter(F.slice("caption", F.col("item") + 2, F.greatest(F.size("caption"), F.lit(1))), lambda x: F.length(F.trim(x)) > 0)
    return items.withColumn("following", F.try_element_at(later, F.lit(1))).filter("text is not null").drop("caption")


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text as different stores would count it."""
    chars = F.length(text)
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    wide = F.length(F.regexp_replace(text, r"[\x{00}-\x{7F}]", ""))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return {
        "chars": chars,
        "utf8": F.octet_length(text),
        "utf16": chars + astral,
        "html": chars + 4 * count("[&]") + 3 * count("[<>]") + 5 * count("[\"']"),
        "json": chars + count(r"[\\\"\n\r\t]") + 5 * wide + 6 * astral,
        "crlf": chars + count(r"\n") - (F.length(text) - F.length(F.regexp_replace(text, r"\r\n", "x"))),
    }


def storage_limits(items: DataFrame) -> DataFrame:
    """Hidden limits by source and field: source, field, measure, store_limit, at_limit (items of that length).

    The mark of omission does not count, as it is put behind the limit.
    """
    body = F.regexp_replace("text", r"\s*" + OMISSION, "")
    sized = items.select(
        "source", "field",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("n")) for m, c in lengths(body).items()])).alias("x"),
    ).select("source", "field", "x.measure", "x.n")
    counts = sized.groupBy("source", "field", "measure", "n").agg(F.count("*").alias("items"))
    # one row for each length: short windows, whatever the number of items
    w = Window.partitionBy("source", "field", "measure")
    before = w.orderBy("n").rangeBetween(-10, -1)
    return (
        counts.withColumn("longest", F.max("n").over(w))
        .withColumn("usual", F.coalesce(F.sum("items").over(before), F.lit(0)) / 10.0)
        .filter((F.col("n") == F.col("longest")) & (F.col("n") >= 40) & (F.col("items") >= LIMIT_COUNT) & (F.col("items") >= LIMIT_RATIO * F.col("usual")))
        .select("source", "field", "measure", F.col("n").alias("store_limit"), F.col("items").alias("at_limit"))
    )


def at_limits(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``at_limit``: the item reaches a limit of its source and field in one of the six measures.

    A limit in bytes is reached up to three bytes before, where the next character does not fit.
    """
    per = checkpoint(limits.groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("measure", "store_limit"))).alias("limits")))
    # a few rows for each source and field: broadcast if there are as few as expected, so that a large source is not shuffled
    per = F.broadcast(per) if per.count() <= MOST_BROADCAST else per
    joined = items.join(per.withColumnRenamed("source", "s2").withColumnRenamed("field", "f2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("field") == F.col("f2")), "left").drop("s2", "f2")
    at = F.lit(False)
    for m, c in lengths(F.col("text")).items():
        at = at | F.coalesce(c >= F.try_element_at("limits", F.lit(m)) - F.when(F.lit(m) == "utf8", 3).otherwise(0), F.lit(False))
    return joined.withColumn("at_limit", at).drop("limits")


def item_shape(text: Column) -> Column:
    """An item with runs of digits as one 9."""
    return F.regexp_replace(F.trim(text), r"\d+", "9")


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def sentences(items: DataFrame) -> DataFrame:
    """Items with ``sents`` (words of each sentence, in order; label left out), ``marked``, ``terminal`` and ``blank``."""
    body = F.regexp_replace("text", LABEL, "")
    cut = F.split(F.regexp_replace(body, SENTENCE_END, f"$1$2{_MARK}"), _MARK)
    sents = F.transform(F.filter(cut, lambda s: s.rlike(r"\S")), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    return items.withColumn("sents", sents).withColumn("marked", F.col("text").rlike(OMISSION)).withColumn("terminal", F.col("text").rlike(TERMINAL) & ~F.col("marked")).withColumn("blank", ~F.col("text").rlike(r"\S"))


def _ending(word: Column) -> Column:
    """Kind of ending by the last character of a word: letter, digit, bracket or sign."""
    return F.when(word.rlike(r"\p{L}$"), "letter").when(word.rlike(r"\p{N}$"), "digit").when(word.rlike(r"[)\]]$"), "bracket").otherwise("sign")


_OBSERVED = "array<struct<kind:string,key:string,good:int,ending:string>>"


def ending_statistics(cut: DataFrame) -> DataFrame:
    """What the sentences of all items show: kind, key, n, good, and the numbers of open ends by kind.

    Kinds: ``o`` openers and ``p`` beginnings of first words (good: with a full stop),
    ``w`` words (good: at the end of a sentence), ``a`` words with a full stop inside
    a sentence (good: before a number or small letter), ``s`` shapes of whole items.
    Observations are added up before they are shuffled.
    """
    some = cut.filter("not blank and not marked")
    whole = some.select(F.array(F.struct(F.lit("s").alias("kind"), item_shape(F.col("text")).alias("key"), F.lit(0).alias("good"), F.lit(None).cast("string").alias("ending"))).cast(_OBSERVED).alias("seen"))
    each = some.select("terminal", F.size("sents").alias("count"), F.posexplode("sents").alias("at", "words"))
    each = each.withColumn("closed", (F.col("at") < F.col("count") - 1) | F.col("terminal"))
    ending = F.when(~F.col("closed"), _ending(F.try_element_at("words", F.lit(-1))))
    obs = lambda kind, key, good, end=None: F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), good.cast("int").alias("good"), (F.lit(None).cast("string") if end is None else end).alias("ending")
    )
    first = F.try_element_at("words", F.lit(1))
    openers = F.transform(F.sequence(F.lit(1), F.least(F.lit(OPENER), F.size("words"))), lambda k: obs("o", F.array_join(F.slice("words", 1, k), " "), F.col("closed"), ending))
    begins = F.when(F.length(first) > 2, F.transform(F.sequence(F.lit(2), F.least(F.length(first) - 1, F.lit(BEGINNING))), lambda k: obs("p", F.substring(first, F.lit(1), k), F.col("closed"))))
    words = F.transform("words", lambda w, i: obs("w", _plain(w), i == F.size("words") - 1))
    short = F.transform(
        F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), F.try_element_at("words", i + 2).alias("next"))), lambda p: p["w"].endswith(".") & p["next"].isNotNull()),
        lambda p: obs("a", p["w"], p["next"].rlike(r"^[\p{Ll}\d]")),
    )
    none = F.array().cast(_OBSERVED)
    inner = each.select(F.concat(openers.cast(_OBSERVED), F.coalesce(begins.cast(_OBSERVED), none), words.cast(_OBSERVED), F.coalesce(short.cast(_OBSERVED), none)).alias("seen"))
    flat = inner.unionByName(whole).select(F.explode("seen").alias("x")).select("x.*")
    of = lambda e: F.count_if(F.col("ending") == e).alias(e)
    return flat.groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum("good").alias("good"), *[of(e) for e in ("letter", "digit", "bracket", "sign")])


def _questions(cut: DataFrame) -> DataFrame:
    """One row for each item and statistic that its verdict asks for; one row at least for each item."""
    tail = F.try_element_at("sents", F.lit(-1))
    last = F.try_element_at(tail, F.lit(-1))
    q = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    openers = [F.when(F.size(tail) >= k, q(f"o{k}", F.array_join(F.slice(tail, 1, k), " "))) for k in range(1, OPENER + 1)]
    fresh = F.col("following").rlike(LABEL) | F.col("following").rlike(PANEL)
    # the end of a sentence goes on with it, however often it occurs
    shape = F.when(~fresh & ~(F.col("following").rlike(r"^\s*\p{Ll}") & F.col("following").rlike(TERMINAL)), q("s", item_shape(F.col("following"))))
    no = F.lit(None).cast("struct<kind:string,key:string>")
    open_ = ~F.col("terminal") & ~F.col("marked") & ~F.col("blank")
    ask = F.when(
        open_, F.array(*openers, F.when((F.size(tail) == 1) & (F.length(last) <= BEGINNING), q("p", last)), q("w", _plain(last)), shape)
    ).when(F.col("terminal"), F.array(q("a", last), shape))
    brackets = lambda left, right: F.length(F.regexp_replace("text", f"[^{left}]", "")) > F.length(F.regexp_replace("text", f"[^{right}]", ""))
    return cut.select(
        "doc_id", "source_index", "field", "item", "source", "at_limit", "marked", "terminal", "blank",
        F.coalesce(F.size("sents"), F.lit(0)).alias("sentences"), F.when(open_, _ending(last)).alias("ending"),
        (open_ & (brackets("(", ")") | brackets(r"\[", r"\]"))).alias("unbalanced"),
        F.col("text").rlike(SEEMING).alias("seeming"), F.coalesce(~fresh, F.lit(False)).alias("follows"),
        F.explode_outer(F.filter(F.coalesce(ask, F.array(no)), lambda x: x.isNotNull())).alias("q"),
    ).select("*", F.substring("q.kind", 1, 1).alias("kind"), F.try_to_number(F.nullif(F.substring("q.kind", 2, 1), F.lit("")), F.lit("9")).cast("int").alias("k"), F.col("q.key").alias("key")).drop("q")


_ITEM = ("doc_id", "source_index", "field", "item", "source", "at_limit", "marked", "terminal", "blank", "sentences", "ending", "unbalanced", "seeming", "follows")
_FACTS = ("n", "good", "letter", "digit", "bracket", "sign")


def judge(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Each item with ``at_limit`` and ``cut``; the texts themselves are not kept."""
    cut = sentences(at_limits(items, limits))
    stats = checkpoint(ending_statistics(cut))
    floor = FREQUENT * (stats.agg(F.sum("n")).first()[0] or 0)
    # few statistics are asked for by very many items: these are at hand, the rest is joined by shuffle
    often = F.broadcast(stats.filter(F.col("n") >= floor))
    asked = _questions(cut)
    near = asked.join(often, ["kind", "key"], "left")
    far = near.filter("n is null and key is not null").drop(*_FACTS).join(stats.filter(F.col("n") < floor), ["kind", "key"], "left")
    facts = near.filter("n is not null or key is null").unionByName(far)
    fact = F.struct("n", "good", F.when(F.col("ending") == "letter", F.col("letter")).when(F.col("ending") == "digit", F.col("digit")).when(F.col("ending") == "bracket", F.col("bracket")).otherwise(F.col("sign")).alias("alike"),
                    (F.col("letter") + F.col("digit") + F.col("bracket") + F.col("sign")).alias("open"))
    get = lambda kind: F.max(F.when(F.col("kind") == kind, fact)).alias(kind)
    # the longest opener that is known
    known = F.max_by(fact, F.when((F.col("kind") == "o") & (F.col("n") >= SUPPORT), F.col("k"))).alias("o")
    per = facts.groupBy(*_ITEM).agg(known, *[get(k) for k in ("p", "w", "a", "s")])
    has = lambda c: F.coalesce(c, F.lit(False))
    own = has(F.col("s.n") >= ITEMS)  # what follows is an item of its own kind
    goes_on = F.col("follows") & ~own
    inner = has((F.col("w.n") >= INNER_COUNT) & (F.col("w.good") < INNER_SHARE * F.col("w.n")))
    closed = F.col("o.good") >= CLOSED * F.col("o.n")
    usual = has(F.col("o.alike") >= F.when(F.col("at_limit"), USUAL_AT_LIMIT).otherwise(USUAL) * F.col("o.open"))
    settled = has(~closed) & usual & ~inner & ~F.col("unbalanced")
    begun = has((F.col("p.n") >= SUPPORT) & (F.col("p.good") >= CLOSED * F.col("p.n")) & (F.col("w.n") < SUPPORT))
    open_end = (
        F.when(F.col("at_limit"), ~(settled & has(F.col("w.n") > 1)))
        .when(inner | F.col("unbalanced"), True)
        .when(F.col("o").isNotNull(), has(closed) | ~usual)
        .otherwise((F.col("sentences") > 1) | begun)
    )
    short = has((F.col("a.n") >= SHORT_COUNT) & (F.col("a.good") >= SHORT_SHARE * F.col("a.n")))
    verdict = (
        F.when(F.col("blank"), False)
        .when(F.col("marked"), True)
        .when(F.col("terminal"), (short | (F.col("at_limit") & F.col("seeming"))) & ~goes_on)
        .otherwise(open_end & ~goes_on)
    )
    return per.withColumn("cut", verdict).select("doc_id", "source_index", "source", "field", "item", "blank", "at_limit", "cut")


def truncated_items(elements: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """All caption items with ``cut``; see the module's text for the method.

    Blank items are never cut. Very long items are judged by the same rules. Columns
    that are not named here do not matter. Without other items to learn from, only
    marks of omission, broken characters, open brackets and open ends behind a whole sentence are cuts.
    """
    items = caption_items(elements, manifests)
    # the texts are few bytes but costly to cut into words, so they are spread whatever their size
    tasks = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = checkpoint(items.repartition(tasks, "doc_id", "source_index"))
    return judge(items, storage_limits(items))


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """How often each source truncates: captions that are not blank, the cut ones and their share."""
    return (
        judged.filter("not blank")
        .groupBy(F.coalesce("source", F.lit("")).alias("source"))
        .agg(F.count("*").alias("captions"), F.count_if("cut").alias("cut"), F.count_if(F.col("at_limit") & F.col("cut")).alias("cut_at_limit"))
        .withColumn("share", F.round(F.col("cut") / F.col("captions"), 6))
    )
