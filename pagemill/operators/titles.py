"""Resolution of titles that are nearly the same.

Similarity is twice the shared tokens over all tokens. Titles are compared by their
normal form, so documents with one title are one class; pairs are formed between
classes. Candidates come from a prefix filter: with the tokens of each title in order
of their frequency, rarest first, two titles within the threshold share two tokens
among the first of each, so frequent words hardly bring titles together.

All pairs may grow with the square of the titles, so they are found where the titles
are: a title is sent to each of its first tokens, compared there by its second ones,
and a pair is returned by the one key of its first two shared tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import text as X
from pagemill.runtime import checkpoint

RELEVANT, HIGH, LEAD, BEST = 0.65, 0.92, 0.08, 5
#: Tokens with this share of all tokens are at hand in every task: at most its inverse in number.
FREQUENT = 1e-5
#: A key with more titles is split, and the parts into which it is spread.
HOT_KEY, SALTS = 512, 16
#: A token with more titles is split into blocks of about so many; rows and pairs of tokens of a task of ``title_pairs``.
HOT_TITLES, TASK_ROWS, TASK_KEYS = 1 << 15, 1 << 14, 1 << 20
#: Pairs looked at and compared at a time in a task, and bytes of titles returned at a time.
LOOK, COMPARE, SEND = 1 << 18, 1 << 16, 1 << 26
#: Titles of up to so many tokens are compared token by token, longer ones by search.
_WIDTHS = (4, 6, 8, 10, 12, 16)


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^[\r\n]*([^\r\n]*)", 1)


def titled(documents: DataFrame, least_tokens: int = 4) -> DataFrame:
    """doc_id, normalized title and its tokens, for documents whose first line has enough distinct tokens."""
    t = documents.select("doc_id", X.normalize_title(first_line(F.col("text"))).alias("title")).filter("doc_id is not null and title is not null")
    return t.withColumn("tokens", X.title_tokens(F.col("title"))).filter(F.size("tokens") >= least_tokens)


def title_classes(documents: DataFrame, least_tokens: int = 4) -> DataFrame:
    """One row for each title: title, tokens, first_doc, documents."""
    return titled(documents, least_tokens).groupBy("title").agg(F.first("tokens").alias("tokens"), F.min("doc_id").alias("first_doc"), F.count("*").alias("documents"))


def _keyed(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (doc, h, key): the pairs of each title's rarest tokens, as many as the threshold needs.

    A title of n tokens shares at least ceil(share * n) tokens with one within the
    threshold, and that is two or more from four tokens on; so two of the first
    n - ceil(share * n) + 2 tokens are shared. ``doc`` is the class by its first
    document, ``h`` the hashes of its tokens.
    """
    share = threshold / (2 - threshold)
    tokens = classes.select(F.col("first_doc").alias("doc"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a frequent token stands in very many titles: its count is at hand, the rest is joined by shuffle
    often = tokens.join(F.broadcast(counts.filter(F.col("n") >= FREQUENT * total)), "token", "left")
    seldom = often.filter("n is null").drop("n").join(counts.filter(F.col("n") < FREQUENT * total), "token")
    counted = often.filter("n is not null").unionByName(seldom)
    ranked = counted.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: F.xxhash64(x["token"])).alias("h"))
    n = F.size("h")
    first = ranked.select("doc", "h", F.slice("h", 1, F.least(n, n - F.ceil(n * share - 1e-9).cast("int") + 2)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    return first.select("doc", "h", F.explode(pairs).alias("key"))


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (x, y) that pass the threshold by the hashes of their tokens.

    The comparison stands in the join, so what fails is never shuffled. The titles of
    a key that has very many are spread over ``SALTS`` tasks at least.
    """
    hot = checkpoint(right.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_KEY).select("key", F.lit(True).alias("hot")))
    if hot.isEmpty():
        a, b = left.withColumn("salt", F.lit(0)).alias("a"), right.withColumn("salt", F.lit(0)).alias("b")
    else:
        marked = lambda df: df.join(hot.hint("merge"), "key", "left")
        a = marked(left).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)).alias("a")
        b = marked(right).withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("b")
    n, m = F.size("a.h"), F.size("b.h")
    apart = F.col("a.doc") != F.col("b.doc")
    alike = (2 * F.least(n, m) >= threshold * (n + m)) & (2 * F.size(F.array_intersect("a.h", "b.h")) >= threshold * (n + m) - 1e-9)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & apart & alike).select(F.col("a.doc").alias("x"), F.col("b.doc").alias("y")).distinct()


def _first(n: Column, threshold: float) -> Column:
    """Among how many of a title's n tokens, rarest first, the first one shared with a title within the threshold is."""
    return n - F.ceil(n * (threshold / (2 - threshold)) - 1e-9).cast("int") + 1


def _placed(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (class, doc, title, n, h, first) of the classes that can be like another.

    ``h`` has the ids of the tokens that occur in other titles too, rarest first, ``n``
    counts all; ``first`` has (id, blocks) of those among which a pair's first shared
    token is. Ids follow the frequency, so one order serves all titles.
    """
    tokens = classes.select("class", F.explode(X.title_tokens(F.col("title"))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").orderBy("n", "token")
    blocks = F.ceil(F.col("n") / HOT_TITLES).cast("int").alias("blocks")
    counts = checkpoint(shared.select("token", "n", F.struct(F.monotonically_increasing_id().alias("id"), blocks).alias("at")))
    floor = FREQUENT * (counts.agg(F.sum("n")).first()[0] or 0)
    # as in _keyed: a frequent token is at hand, the rest is joined by shuffle
    often = tokens.join(F.broadcast(counts.filter(F.col("n") >= floor).drop("n")), "token", "left")
    seldom = often.filter("at is null").drop("at").join(counts.filter(F.col("n") < floor).drop("n"), "token")
    ranked = often.filter("at is not null").unionByName(seldom).groupBy("class").agg(F.sort_array(F.collect_list("at")).alias("at"))
    alone = F.col("n") - F.size("at")
    first = F.slice("at", 1, F.greatest(_first(F.col("n"), threshold) - alone, F.lit(0)))
    return ranked.join(classes, "class").select("class", "doc", "title", "n", F.col("at.id").alias("h"), first.alias("first")).filter(F.size("first") > 0)


def _compared(size: np.ndarray, place: np.ndarray, h: pa.Array, group: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers (x, y) of the rows that are alike, with the number of shared tokens, each pair once.

    A row is a title of ``size`` tokens under the token at ``place`` of ``h``; rows are
    compared within their ``group``, those with a ``side`` with the other sides only.
    """
    share, half, rows = threshold / (2 - threshold), threshold / 2, len(size)
    length = pc.list_value_length(h).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    ids, flat = np.unique(h.flatten().to_numpy(), return_inverse=True)
    of = np.repeat(np.arange(rows), length)
    sought = of * len(ids) + flat  # ascending, as the ids of a title are
    # a bit of a title that another lacks is a token that the other lacks
    bits = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bit = np.uint64(1) << (bits & np.uint64(63))
    mark = np.stack([np.bitwise_or.reduceat(np.where(bits >> np.uint64(6) == w, bit, np.uint64(0)), start) for w in range(4)], axis=1)
    wide = np.full((rows, _WIDTHS[-1]), -1, np.int32)
    column = np.arange(len(flat)) - np.repeat(start, length)
    near = column < _WIDTHS[-1]
    wide[of[near], column[near]] = flat[near]
    other = np.where(wide < 0, np.int32(-2), wide)

    # one entry for each second token; the tokens behind it bound the size of the other title
    most = np.maximum(length - np.ceil(size * share - 1e-9).astype(np.int64) + 1 - place, 0)
    row = np.repeat(np.arange(rows), most)
    second = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most) + place[row] + 1
    fits = second < length[row]
    row, second = row[fits], second[fits]
    cap = np.floor((length[row] - second + 1) / half + 1e-9).astype(np.int64) - size[row]
    widest = int(size.max()) + 1
    key = (group[row] * len(ids) + flat[start[row] + second]) * widest
    order = np.argsort(key + size[row], kind="stable")
    row, second, cap, key = row[order], second[order], cap[order], key[order]
    n = size[row]
    top = np.minimum(np.minimum(cap, np.floor(n / share + 1e-9).astype(np.int64)), widest - 1)
    end = np.searchsorted(key + n, key + np.maximum(top, 0), side="right")
    count = np.maximum(end - np.arange(len(row)) - 1, 0)
    upto = np.cumsum(count)
    split = bool((side >= 0).any())

    def missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(mark[x] & ~mark[y]).view(np.uint32)[:, 0] * np.uint32(0x01010101)) >> np.uint32(24)

    def exact(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared, before = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        longest, low = np.maximum(length[x], length[y]), 0
        for w in _WIDTHS:
            at = np.flatnonzero((longest > low) & (longest <= w))
            low = w
            if not len(at):
                continue
            a, b, limit = np.ascontiguousarray(wide[x[at], :w].T), np.ascontiguousarray(other[y[at], :w].T), q[at]
            both, early = np.zeros(len(at), np.int16), np.zeros(len(at), np.int16)
            for i in range(w):
                found = a[i] == b[0]
                for j in range(1, w):
                    found |= a[i] == b[j]
                both += found
                early += found & (i < limit)
            shared[at], before[at] = both, early
        for at in np.array_split(long := np.flatnonzero(longest > low), len(long) * int(length.max()) // LOOK + 1):
            k = length[x[at]]
            pair = np.repeat(np.arange(len(at)), k)
            i = np.arange(len(pair)) - np.repeat(np.cumsum(k) - k, k)
            want = y[at][pair] * len(ids) + flat[start[x[at]][pair] + i]
            found = sought[np.minimum(np.searchsorted(sought, want), len(sought) - 1)] == want
            shared[at] = np.bincount(pair[found], minlength=len(at))
            before[at] = np.bincount(pair[found & (i < q[at][pair])], minlength=len(at))
        # only the key of the first two shared tokens returns the pair
        alike = (before == 1) & (2.0 * shared / (size[x] + size[y]) >= threshold)
        return x[alike], y[alike], shared[alike]

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    i = waiting = 0
    while i < len(row):
        done = upto[i - 1] if i else 0
        j = max(int(np.searchsorted(upto, done + LOOK, side="right")), i + 1)
        left = np.repeat(np.arange(i, j), count[i:j])
        right = np.arange(len(left)) - np.repeat(upto[i:j] - count[i:j] - done, count[i:j]) + left + 1
        fits = cap[right] >= n[left]
        left, right = left[fits], right[fits]
        x, y = row[left], row[right]
        if split:
            fits = (side[x] < 0) | (side[x] != side[y])
            left, x, y = left[fits], x[fits], y[fits]
        for one, two in ((0, 1), (1, 0)):
            need = np.ceil(half * (size[x] + size[y]) - 1e-9)
            fits = length[(x, y)[one]] - missing((x, y)[one], (x, y)[two]) >= need
            left, x, y = left[fits], x[fits], y[fits]
        kept.append((x, y, second[left]))
        waiting += len(x)
        i = j
        if waiting >= COMPARE or i >= len(row):
            yield exact(*(np.concatenate(c) for c in zip(*kept)))
            kept, waiting = [], 0


def _alike(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of a task's rows (token, cell, cross, block, place, doc, title, n, h)."""
    t = pa.Table.from_batches(got) if (got := list(batches)) else None
    if t is None or t.num_rows < 2:
        return
    number = {c: t[c].to_numpy() for c in ("token", "cell", "block", "place", "n")}
    _, token = np.unique(number["token"], return_inverse=True)
    _, group = np.unique(token * (int(number["cell"].max()) + 1) + number["cell"], return_inverse=True)
    side = np.where(t["cross"].to_numpy(), number["block"], -1)
    titles, docs = t["title"].cast(pa.large_binary()).combine_chunks(), t["doc"].combine_chunks()
    rank = np.empty(t.num_rows, np.int64)
    rank[pc.sort_indices(titles).to_numpy()] = np.arange(t.num_rows)
    size = number["n"].astype(np.int64)
    step = max(1, min(COMPARE, SEND // max(1, pc.max(pc.binary_length(titles)).as_py())))
    text = titles.cast(pa.large_string())
    for x, y, shared in _compared(size, number["place"].astype(np.int64), t["h"].combine_chunks(), group, side, threshold):
        x, y = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
        for k in range(0, len(x), step):
            a, b = x[k : k + step], y[k : k + step]
            cols = [text.take(pa.array(a)).cast(pa.string()), text.take(pa.array(b)).cast(pa.string()), docs.take(pa.array(a)), docs.take(pa.array(b))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shared[k : k + step]), pa.array(size[a] + size[b])], names=["title_a", "title_b", "doc_a", "doc_b", "shared", "total"])


def title_pairs(documents: DataFrame, threshold: float = RELEVANT) -> DataFrame:
    """Pairs of different titles that are alike: title_a < title_b, doc_a, doc_b (first documents), similarity.

    The titles of a token that has very many are cut into blocks, and each two blocks
    are compared in a cell of their own.
    """
    classes = title_classes(documents).select("title", F.col("first_doc").alias("doc"), F.size(X.title_tokens(F.col("title"))).alias("n"))
    classes = checkpoint(classes.withColumn("class", F.monotonically_increasing_id()))
    placed = _placed(classes, threshold)
    kind = placed.schema["doc"].dataType.simpleString()
    copies = _first(F.col("n"), threshold).cast("long")
    rows, keys = classes.agg(F.sum(copies), F.sum(F.shiftright(copies * (copies + 1), 1))).first()
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows or 0) // TASK_ROWS + 1, (keys or 0) // TASK_KEYS + 1)
    by_token = placed.select("class", "doc", "title", "n", "h", F.posexplode("first").alias("place", "at")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("at.blocks")).cast("int"))
    cells = by_token.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)))
    cell = (F.least("block", "other") * F.col("at.blocks") + F.greatest("block", "other")).alias("cell")
    sent = cells.select(F.col("at.id").alias("token"), cell, (F.col("block") != F.col("other")).alias("cross"), "block", "place", "doc", "title", "n", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _alike(batches, threshold)

    found = sent.repartition(tasks, "token", "cell").mapInArrow(run, f"title_a string, title_b string, doc_a {kind}, doc_b {kind}, shared long, total long")
    return found.select("title_a", "title_b", "doc_a", "doc_b", F.round(2.0 * F.col("shared") / F.col("total"), 4).alias("similarity"))


def title_candidates(documents: DataFrame, every: int = 50, threshold: float = RELEVANT, best: int = BEST) -> DataFrame:
    """For each document whose id is divisible by ``every``, the best other titles: doc_id, candidate, similarity, rank.

    A candidate stands for all documents with its title by the smallest id. Ranked
    by similarity, then candidate. ``every`` states the queries of the search.
    """
    queries = titled(documents).filter(F.col("doc_id") % every == 0).select("doc_id", "title")
    classes = checkpoint(title_classes(documents))
    asked = classes.join(queries.select("title").distinct(), "title", "left_semi").select(F.col("first_doc").alias("doc"))
    keyed = _keyed(classes, threshold)
    pairs = _candidates(keyed.join(asked, "doc", "left_semi"), keyed, threshold)
    x = classes.select(F.col("first_doc").alias("x"), "title", F.col("tokens").alias("kx"))
    y = classes.select(F.col("first_doc").alias("y"), F.col("tokens").alias("ky"))
    scored = pairs.join(x, "x").join(y, "y").withColumn("s", X.dice(F.col("kx"), F.col("ky"))).filter(F.col("s") >= threshold)
    ranked = Window.partitionBy("title").orderBy(F.desc("similarity"), "candidate")
    top = scored.select("title", F.col("y").alias("candidate"), F.round("s", 4).alias("similarity")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= best)
    return queries.join(top, "title").select("doc_id", "candidate", "similarity", "rank")

