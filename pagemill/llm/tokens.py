"""The whole corpus as ids of a public tokenizer, each distinct word encoded once.

Texts are cut into pre-tokens with their positions, the distinct pre-tokens are
counted and encoded once each, the ids are joined back by word and put together by
position. The frequent words - those with at least ``FREQUENT`` of all pre-tokens,
so at most 1/FREQUENT of them - are joined by broadcast where they stand; only the
rest is shuffled, so that no word that every text holds gathers in one task.
"""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.runtime import checkpoint, latest

TOKENIZERS = os.environ.get("PAGEMILL_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens of the byte-level tokenizers: contractions, words, numbers, other signs, white space (fixed value).
PRETOKEN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Share of all pre-tokens from which a word is frequent; bounds the broadcast table by its inverse.
FREQUENT = 2e-5


def vocabulary_file(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def read_ranks(name: str, folder: str | None = None) -> dict[bytes, int]:
    """Token bytes and their ids."""
    with open(vocabulary_file(name, folder), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


PIECE = r"[\s\S]+"
#: The library's own pattern, for whole texts (fixed value).
WHOLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """A tokenizer whose table is read on the driver and sent to the workers by broadcast, so its file need be on the driver only."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.name = f"{folder or TOKENIZERS}/{name}"
        self.table = spark.sparkContext.broadcast(read_ranks(name, folder))

    def encoder(self, pattern: str):
        """The encoder, made once in each worker process; functions come to a worker anew for each task."""
        import tiktoken

        kept = sys.modules.setdefault("_pagemill_worker_state", types.ModuleType("_pagemill_worker_state")).__dict__
        key = f"encoder {self.name} {pattern}"
        if key not in kept:
            kept[key] = tiktoken.Encoding("pagemill", pat_str=pattern, mergeable_ranks=self.table.value, special_tokens={})
        return kept[key]


@lru_cache
def text_encoder(name: str, folder: str | None = None, pattern: str = WHOLE):
    """Encoder on the driver."""
    import tiktoken

    return tiktoken.Encoding("pagemill", pat_str=pattern, mergeable_ranks=read_ranks(name, folder), special_tokens={})


def pretokens(text: Column) -> Column:
    """Pre-tokens of a text in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def encode_words(counts: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Adds ``ids`` to rows of a distinct ``word`` and its count ``n``."""

    tokenizer = Tokenizer(counts.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer.encoder(PIECE)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return counts.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


def one_row(df: DataFrame, value: str) -> DataFrame:
    """``key`` and ``value`` once for each key: of rows delivered more than once the last ``received_at``.

    Without that column, or where it is equal, a hash of the row decides. Only the rows
    of repeated keys are shuffled. Rows with a null key are left out.
    """
    df = df.filter("key is not null")
    repeated = checkpoint(df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    if repeated.isEmpty():
        return df.select("key", value)
    picked = latest(df.join(repeated, "key", "left_semi"), ["key"])
    return df.join(repeated, "key", "left_anti").unionByName(picked).select("key", value)


def _received(df: DataFrame) -> Column:
    return (F.col("received_at") if "received_at" in df.columns else F.lit(None).cast("timestamp")).alias("received_at")


def encode(documents: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of each document, without special tokens.

    Strings of special tokens are ordinary text. An empty or null text has an empty
    list. Rows with a null key are left out; of a key delivered more than once the last
    ``received_at`` counts (see ``one_row``). Very long texts are encoded whole.
    """
    docs = one_row(documents.select(F.col(key).alias("key"), F.col(text).alias("t"), _received(documents)), "t")
    words = docs.filter("length(t) > 0").select(F.explode(pretokens(F.col("t"))).alias("word"))
    # each distinct word is encoded once; what is written is their number, not that of the tokens
    coded = checkpoint(encode_words(words.groupBy("word").agg(F.count("*").alias("n")), name, folder))
    total = coded.agg(F.sum("n")).first()[0] or 0
    floor = max(1.0, FREQUENT * total)
    frequent = [(r.word, r.ids) for r in coded.filter(F.col("n") >= floor).select("word", "ids").toLocalIterator()]
    table = documents.sparkSession.sparkContext.broadcast(frequent)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w for w, _ in table.value], pa.string())
        size = np.array([len(i) for _, i in table.value] + [1], np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        # behind the known words' ids stands the mark of a word that is not at hand
        flat = np.array([x for _, i in table.value for x in i] + [-1], np.int32)
        for b in batches:
            cut = b.column(1)
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            words = cut.flatten()
            row = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = size[row]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(start[row] - ends[:-1], n) + np.arange(ends[-1])]
            missing = row == len(known)
            upto = np.concatenate([[0], np.cumsum(missing)])
            # the place of a text's n-th word that is not at hand is -n
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            ids[ends[:-1][missing]] = -(upto[1:][missing] - upto[at[:-1]][doc[missing]])
            rest = words.filter(pa.array(missing))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(upto[at], pa.int32()), rest),
                ],
                names=["key", "ids", "rest"],
            )

    kind = documents.schema[key].dataType.simpleString()
    placed = checkpoint(docs.select("key", pretokens(F.col("t")).alias("cut")).mapInArrow(place, f"key {kind}, ids array<int>, rest array<string>"))
    rare = placed.filter("size(rest) > 0").select("key", F.posexplode("rest").alias("pos", "word"))
    found = (
        rare.join(coded.filter(F.col("n") < floor).select("word", F.col("ids").alias("got")), "word")
        .groupBy("key")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "got"))), lambda p: p["got"]).alias("got"))
    )
    full = F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.try_element_at("got", -x))))
    filled = placed.filter("size(rest) > 0").select("key", "ids").join(found, "key").select("key", full.alias("ids"))
    return placed.filter("size(rest) = 0").select("key", "ids").unionByName(filled).select(F.col("key").alias(key), "ids")


def token_table(spark, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The tokenizer's own table: id and bytes; its size is fixed by the tokenizer."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in read_ranks(name, folder).items()], "id int, bytes binary")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """``key`` and the text of lists of ids, by a join with the token-byte table; an empty list gives the empty text; repeated keys as in ``encode``."""
    table = token_table(encoded.sparkSession, name, folder)
    encoded = one_row(encoded.select(F.col(key).alias("key"), "ids", _received(encoded)), "ids")
    at = encoded.select("key", F.posexplode("ids").alias("pos", "id"))
    parts = at.join(F.broadcast(table), "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("parts"))
    text = parts.select("key", F.decode(F.unhex(F.concat_ws("", F.transform("parts", lambda p: p["h"]))), "UTF-8").alias("text"))
    empty = encoded.filter("size(ids) = 0").select("key", F.lit("").alias("text"))
    return text.unionByName(empty).select(F.col("key").alias(key), "text")


def count_tokens(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text; 0 for an empty or null one."""

    tokenizer = Tokenizer(df.sparkSession, name, folder)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tokenizer.encoder(WHOLE)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], index=s.index, dtype="int32")

    return df.withColumn(out, count.asNondeterministic()(F.col(text)))
