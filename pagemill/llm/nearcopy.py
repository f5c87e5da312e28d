"""Groups of blocks that repeat each other with small edits.

A 64-bit fingerprint is a set of tokens (block number, bits of that block), one for
each of ``BLOCKS`` blocks of bits. Two fingerprints that differ in at most
``MAX_BITS`` bits share at least BLOCKS - MAX_BITS tokens. Under one global order of
the tokens they therefore share a token of their prefixes of MAX_BITS + 1 tokens;
that one filter lets too much through. Here the orders are all rotations of the block
numbers, and a pair is a candidate only if it passes the filters of all of them: the
prefix of each rotation leaves out BLOCKS - MAX_BITS - 1 tokens, so a pair passes all
exactly if no such set of tokens holds all that it shares, i.e. if it shares at least
BLOCKS - MAX_BITS = 2 tokens. The intersection of the filters is thus an equality
join on each pair of tokens, and no pair within the threshold is lost.

Blocks take their bits from all over the word, because neighbouring bits of a simhash
are alike for texts of one language. The differing bits and the lengths are then
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import checkpoint, latest

MAX_BITS = 3
BLOCKS = MAX_BITS + 2
#: A key with more rows than this is split before it is joined.
HOT_KEY = 512
#: Parts into which the rows of such a key are spread.
SALTS = 16


def _shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the blocks: joined by sorting, so that a key with many rows spills, and never by broadcast."""
    return df.hint("merge")


def pairs_within(rows: DataFrame, keys: list[str], order: str, alike: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs of rows with equal keys, as columns ``a.*`` and ``b.*`` with a.order < b.order.

    Only keys with several rows are joined; the pairs of a key with more than
    ``HOT_KEY`` are spread over ``SALTS`` tasks at least, each of which compares a
    part of the key's rows with all of them. Rows with a null key are in no pair.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
    some = rows.join(_shuffled(counts), keys)
    hot = F.col("__n") > HOT_KEY
    part = F.when(hot, F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")).otherwise(0)
    a = some.withColumn("__salt", part).alias("a")
    b = some.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("b")
    same = (F.col("a.__salt") == F.col("b.__salt")) & (F.col(f"a.{order}") < F.col(f"b.{order}"))
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(_shuffled(b), same & alike("a", "b") if alike else same)


def hex_number(text: Column, bits: int) -> Column:
    """A hexadecimal text by its number: lower case, without blanks, prefix and leading zeros; null if it is none."""
    low = F.lower(F.trim(text))
    fits = low.rlike(r"^(?:0x)?[0-9a-f]+$") & low.rlike(r"^(?:0x)?0*[0-9a-f]{0,%d}$" % (bits // 4))
    return F.when(fits, F.regexp_replace(low, r"^(?:0x)?0*", ""))


def fingerprints(blocks: DataFrame) -> DataFrame:
    """id, sha, simhash (bigint), text_length of each block once; blocks without text are left out.

    Hexadecimal values count by their number. A missing or malformed part is null.
    """
    last = latest(blocks.select("id", "fingerprint", "received_at").filter("id is not null"), ["id"])
    sim = F.lpad(hex_number(F.col("fingerprint.simhash64"), 64), 16, "0")
    half = lambda a: F.conv(F.substring(sim, a, 8), 16, 10).cast("bigint")
    # two halves, as conv() of a large unsigned number doesn't fit
    word = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    return last.select(
        "id",
        F.lpad(hex_number(F.col("fingerprint.visible_text_sha256"), 256), 64, "0").alias("sha"),
        word.alias("simhash"),
        F.col("fingerprint.text_length").cast("int").alias("text_length"),
    ).filter("text_length is null or text_length <> 0")


def block_token(word: Column, block: int, blocks: int = BLOCKS) -> Column:
    """The bits of ``word`` at the places congruent to ``block``, packed to the left."""
    out = F.lit(0).cast("bigint")
    for i, place in enumerate(range(block, 64, blocks)):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, place).bitwiseAND(F.lit(1).cast("bigint")), i))
    return out


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of different fingerprints that differ in at most MAX_BITS bits: a < b.

    ``words`` has one column ``simhash`` of distinct values. A key with many
    fingerprints is split further: of MAX_BITS + 1 other blocks of bits at least one
    is equal in each pair, so the key is joined together with each of them. The large
    group is thus not compared pair by pair, and nothing is lost; what is still a
    large group then is spread over several tasks.
    """
    pairs = list(combinations(range(BLOCKS), 2))
    tokens = words.select("simhash", *[block_token(F.col("simhash"), b).alias(f"t{b}") for b in range(BLOCKS)])
    width = 64 // BLOCKS + 1
    keyed = tokens.select(
        "simhash",
        F.explode(
            F.array(*[
                F.shiftleft(F.lit(k).cast("bigint"), 2 * width).bitwiseOR(F.shiftleft(F.col(f"t{i}"), width)).bitwiseOR(F.col(f"t{j}"))
                for k, (i, j) in enumerate(pairs)
            ])
        ).alias("key"),
    )
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(_shuffled(counts), "key")
    cold = shared.filter(F.col("n") <= HOT_KEY).select("simhash", "key")
    # within a hot key: 16-bit quarters, of which one at least is equal in a pair
    quarter = F.explode(F.array(*[
        F.shiftleft(F.lit(q).cast("bigint"), 16).bitwiseOR(block_token(F.col("simhash"), q, MAX_BITS + 1)) for q in range(MAX_BITS + 1)
    ]))
    hot = shared.filter(F.col("n") > HOT_KEY).select("simhash", "key", quarter.alias("part"))
    near = lambda x, y: F.bit_count(F.col(f"{x}.simhash").bitwiseXOR(F.col(f"{y}.simhash"))) <= MAX_BITS
    both = [F.col("a.simhash").alias("a"), F.col("b.simhash").alias("b")]
    a, b = cold.alias("a"), _shuffled(cold.alias("b"))
    pairs_ = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.simhash") < F.col("b.simhash")) & near("a", "b")).select(*both)
    return pairs_.unionByName(pairs_within(hot, ["key", "part"], "simhash", near).select(*both)).distinct()


def _lengths_alike(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return F.abs(x - y) * 10 <= F.greatest(x, y)


def representatives(prints: DataFrame) -> DataFrame:
    """One row for each distinct fingerprint: rep (smallest id), sha, simhash, text_length, copies."""
    return prints.groupBy("sha", "simhash", "text_length").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def alike_representatives(reps: DataFrame) -> DataFrame:
    """Pairs of different representatives that are alike: x, y (x < y)."""
    pair = [F.col("a.rep").alias("x"), F.col("b.rep").alias("y")]
    exact = pairs_within(reps.select("rep", "sha").filter("sha is not null"), ["sha"], "rep").select(*pair)

    sized = reps.select("rep", "simhash", "text_length").filter("simhash is not null and text_length is not null")
    m = _shuffled(sized.alias("m"))
    left = near_words(sized.select("simhash").distinct()).join(m, F.col("a") == F.col("m.simhash")).select("b", F.col("m.rep").alias("x"), F.col("m.text_length").alias("x_length"))
    between = left.join(m, F.col("b") == F.col("m.simhash")).select("x", "x_length", F.col("m.rep").alias("y"), F.col("m.text_length").alias("y_length"))
    within = pairs_within(sized, ["simhash"], "rep").select(*pair, F.col("a.text_length").alias("x_length"), F.col("b.text_length").alias("y_length"))
    near = between.unionByName(within).filter(_lengths_alike("x_length", "y_length")).select("x", "y")
    return exact.unionByName(near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


#: Whether copies of one fingerprint are alike: they share a digest, or a simhash and a length.
_SELF = "sha is not null or (simhash is not null and text_length is not null)"


def _members(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives, and of those with copies the blocks (id, rep)."""
    prints = checkpoint(fingerprints(blocks))
    reps = checkpoint(representatives(prints))
    # a fingerprint can have very many copies, so each is looked up in one of SALTS places
    salts = F.array(*map(F.lit, range(SALTS)))
    p = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).alias("p")
    r = reps.filter("copies > 1").withColumn("salt", F.explode(salts)).alias("r")
    same = F.col("p.salt") == F.col("r.salt")
    for k in ("sha", "simhash", "text_length"):
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}"))
    return reps, p.join(_shuffled(r), same).select(F.col("p.id").alias("id"), F.col("r.rep").alias("rep"))


def near_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of alike blocks, block_a < block_b.

    Alike are equal digests, and simhashes that differ in at most MAX_BITS bits with
    lengths that differ by at most a tenth of the larger. Blocks without text take
    part in no pair; a block without simhash or length is compared by its digest
    only. Pairs are not extended through third blocks. They are found between
    representatives of equal fingerprints and then spread over their copies.
    """
    reps, members = _members(blocks)
    links = alike_representatives(reps)
    # most fingerprints have one block, which is its own representative
    x, y = members.select(F.col("id").alias("a"), F.col("rep").alias("x")), members.select(F.col("id").alias("b"), F.col("rep").alias("y"))
    across = links.join(_shuffled(x), "x", "left").join(_shuffled(y), "y", "left").select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"))
    copies = members.join(_shuffled(reps.filter(f"copies > 1 and ({_SELF})").select("rep")), "rep", "left_semi")
    inside = pairs_within(copies, ["rep"], "id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return across.unionByName(inside).select(F.least("a", "b").alias("block_a"), F.greatest("a", "b").alias("block_b"))


def copy_classes(blocks: DataFrame) -> DataFrame:
    """One row for each block: id, class_id, links.

    A class holds the blocks of one digest (a block without digest is a class of its
    own); its id is its smallest block id. ``links`` is the number of other blocks
    that the block is alike with, summed over the representatives with their numbers
    of copies; the copies are not paired.
    """
    reps, members = _members(blocks)
    links = alike_representatives(reps)
    size = reps.select(F.col("rep").alias("other"), "copies")
    both = links.select(F.col("x").alias("rep"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("rep"), F.col("x").alias("other")))
    outside = both.join(_shuffled(size), "other").groupBy("rep").agg(F.sum("copies").alias("outside"))
    inside = F.when(F.expr(_SELF), F.col("copies") - 1).otherwise(0)
    first = reps.filter("sha is not null").groupBy("sha").agg(F.min("rep").alias("first"))
    per = reps.join(_shuffled(first), "sha", "left").join(_shuffled(outside), "rep", "left").select("rep", "first", (inside + F.coalesce("outside", F.lit(0))).cast("bigint").alias("links"))
    single = reps.filter("copies = 1").select(F.col("rep").alias("id"), "rep")
    return members.unionByName(single).join(_shuffled(per), "rep").select("id", F.coalesce("first", "id").alias("class_id"), "links")
