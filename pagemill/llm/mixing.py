"""Mixing sources to target shares of the size in tokens.

The unit is a document, together with one document of equal text from each other source
that has one: these can serve either source, so units are aggregated by their membership
pattern (the set of their sources), and the
tokens of the patterns are routed to the quotas of the sources as a flow of least
cost: the k-th use of a text is an edge of cost k - 1, open to the sources that allow
k uses. The graph has one node for each pattern and use, so its size depends on the
numbers of sources and repeats, not on that of the documents. The documents of a
pattern are then put into a seeded order, and each source takes its part of it.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.tokens import count_tokens
from pagemill.runtime import checkpoint, latest

#: Ranges of the seeded order whose sums are taken first; the prefix sums run within one range.
RANGES = 4096
#: Parts in which the copies of one text are numbered.
PARTS = 64


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, other signs as one underscore; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.nullif(plain, F.lit(""))


@dataclass
class Flow:
    """Flow of least cost on a small graph, by successive shortest paths."""

    to: list[int] = field(default_factory=list)
    cap: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=dict)

    def edge(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                u = queue.popleft()
                queued.discard(u)
                for e in self.out.get(u, ()):
                    v = self.to[e]
                    if self.cap[e] > 0 and dist[u] + self.cost[e] < dist.get(v, 1 << 60):
                        dist[v], via[v] = dist[u] + self.cost[e], e
                        if v not in queued:
                            queue.append(v)
                            queued.add(v)
            if t not in dist:
                return total
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def plan(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], size: int | None = None) -> tuple[int, list[tuple[tuple[str, ...], int, str, int]]]:
    """The size of the mix and its parts (pattern, use, source, tokens).

    Targets of sources without a text are shared among the others in proportion.
    Without ``size`` the mix is the largest in which every source has its share;
    with one that is too large, sources that run out give less.
    """
    live = {s for p, n in patterns.items() if n > 0 for s in p if s in targets and targets[s][0] > 0 and targets[s][1] > 0}
    whole = sum(targets[s][0] for s in live)
    if not live or whole <= 0:
        return 0, []
    share = {s: targets[s][0] / whole for s in live}

    def build(total: int) -> tuple[int, int, Flow, list[tuple[tuple[str, ...], int, str, int]]]:
        g, node = Flow(), {"s": 0, "t": 1}
        at = lambda x: node.setdefault(x, len(node))
        parts, want = [], 0
        for s in sorted(live):
            quota = int(total * share[s])
            want += quota
            g.edge(at(("source", s)), 1, quota)
        for p in sorted(patterns):
            uses = max((targets[s][1] for s in p if s in live), default=0)
            for k in range(1, uses + 1):
                g.edge(0, at((p, k)), patterns[p], k - 1)
                for s in p:
                    if s in live and targets[s][1] >= k:
                        parts.append((p, k, s, g.edge(at((p, k)), at(("source", s)), patterns[p])))
        return g.run(0, 1), want, g, parts

    if size is None:
        low, high = 0, int(sum(n * max((targets[s][1] for s in p if s in live), default=0) for p, n in patterns.items()) + 1)
        while low < high - 1:
            mid = (low + high) // 2
            got, want, *_ = build(mid)
            low, high = (mid, high) if got >= want else (low, mid)
        size = low
    _, _, g, parts = build(size)
    return size, [(p, k, s, g.cap[e ^ 1]) for p, k, s, e in parts if g.cap[e ^ 1] > 0]


def units(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Units of the wanted sources: digest, copy, pattern, n_tokens, ids (source -> doc_id).

    Of equal texts the k-th documents of all sources make the k-th unit, so every
    document is in one unit. Null, empty and unlisted rows are left out; a document
    delivered more than once counts once. Sources count in one spelling. The copies
    of a text are numbered in ``PARTS`` parts, as one text may have very many.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source")).filter("source is not null").distinct()
    received = (F.col("received_at") if "received_at" in documents.columns else F.lit(None).cast("timestamp")).alias("received_at")
    rows = documents.select("doc_id", "text", source_name(F.col("source")).alias("source"), received).filter("doc_id is not null and length(text) > 0 and source is not null")
    rows = count_tokens(rows.join(wanted, "source", "left_semi"), "text", tokenizer, folder)
    slim = latest(rows.select("doc_id", "source", "n_tokens", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "received_at"), ["doc_id"]).drop("received_at")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    slim = slim.withColumn("part", part)
    counts = slim.groupBy("digest", "source", "part").agg(F.count("*").alias("n"))
    # PARTS rows at most for each text and source
    before = Window.partitionBy("digest", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("digest", "source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("digest", "source", "part").orderBy("doc_id")
    numbered = slim.withColumn("nth", F.row_number().over(within)).join(base, ["digest", "source", "part"]).withColumn("copy", F.col("base") + F.col("nth") - 1)
    both = numbered.groupBy("digest", "copy").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "doc_id")))).alias("ids"), F.max("n_tokens").alias("n_tokens"))
    return both.filter("n_tokens > 0").select("digest", "copy", F.array_sort(F.map_keys("ids")).alias("pattern"), "n_tokens", "ids")


PART = T.StructType(
    [
        T.StructField("pattern", T.ArrayType(T.StringType())),
        T.StructField("use", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
    ]
)


def mix(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 17, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The chosen documents: doc_id, source, n_tokens, repeats.

    A document belongs to the part that holds the middle of its tokens, so a part misses
    its quota by at most half a document at either end.
    Without targets, or without documents for them, the result is empty.
    """
    spark = documents.sparkSession
    rows = checkpoint(units(documents, targets, tokenizer, folder))
    # patterns are sets of the listed sources: a few rows, whatever the number of documents
    sizes = {tuple(r.pattern): int(r.n) for r in rows.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    _, parts = plan(sizes, target_rows(targets), size)
    cuts: list[tuple] = []
    for p, k in dict.fromkeys((p, k) for p, k, _, _ in parts):
        at = 0
        for q, j, s, n in parts:
            if (q, j) == (p, k):
                cuts.append((list(p), k, s, at, at + n))
                at += n
    parts_df = spark.createDataFrame(cuts, PART)

    order = F.xxhash64(F.lit(seed), "digest", "copy")
    placed = rows.select("pattern", "n_tokens", "ids", order.alias("o"), F.pmod(F.shiftrightunsigned(order, 64 - 12), F.lit(RANGES)).cast("int").alias("range"), "digest", "copy")
    sums = placed.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("n"))
    # RANGES rows at most for each pattern
    before = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("pattern", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pattern", "range").orderBy("o", "digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, ["pattern", "range"]).withColumn("start", F.col("base") + F.col("inner"))
    taken = at.join(F.broadcast(parts_df), "pattern").filter("2 * start + n_tokens >= 2 * low and 2 * start + n_tokens < 2 * high")
    return (
        taken.select(F.try_element_at("ids", F.col("source")).alias("doc_id"), "source", "n_tokens")
        .groupBy("doc_id", "source", "n_tokens")
        .agg(F.count("*").cast("int").alias("repeats"))
    )


def target_rows(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").collect()
    return {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each listed source: source, target_share, documents, tokens, actual_share, most_repeats."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens").cast("bigint") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share").filter("source is not null")
    # one row for each source
    every = Window.partitionBy(F.lit(1))
    return (
        want.join(got, "source", "left")
        .na.fill(0, ["documents", "tokens", "most_repeats"])
        .withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)), 6))
    )
