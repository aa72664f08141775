"""Exact token totals for every context limit from one histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendwell.llm.common import slices, stored
from mendwell.llm.token_files import SLICE, shared_encoder

# Lengths of one block of the suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``length`` of every row's whole text in tokens; a null or empty text has length 0."""
    encoder = shared_encoder(docs.sparkSession, tokenizer)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(0).fill_null("")
            sizes, at, found = pc.binary_length(sizes).to_pylist(), 0, []
            for run in slices(sizes, lambda n: n + 1, SLICE):
                found += [len(encoder.value.encode(text)) // 4 for text in batch.column(0).slice(at, len(run)).to_pylist()]
                at += len(run)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(lengths, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``length, n_docs``: as many rows as there are distinct lengths."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_curve(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """What a context limit equal to each encoded length keeps of the corpus.

    ``counts`` is a histogram. Per length: documents of this length, documents and
    tokens of at least this length, all documents and tokens, tokens that remain if
    longer documents are cut to the limit, tokens cut off, documents cut, and the share of
    documents no longer than it (the quantile it is). Suffix sums are made within blocks
    of lengths; the blocks' totals, one row per block, are summed after that. An
    empty histogram gives no rows.
    """
    cells = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("_block"))
    totals = cells.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    after = totals.select(
        "_block",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("_docs", "_tokens")],
        *[F.sum(c).over(everywhere).alias(f"{c}_all") for c in ("_docs", "_tokens")],
    )
    within = Window.partitionBy("_block").orderBy(F.desc("length"))
    summed = cells.join(after, "_block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum("n_tokens").over(within) + F.col("_tokens_after")).alias("tokens_at_least"),
        F.col("_docs_all").alias("total_docs"),
        F.col("_tokens_all").alias("total_tokens"),
    )
    cut = F.col("tokens_at_least") - F.col("docs_at_least") * F.col("length")
    shorter = F.col("total_docs") - F.col("docs_at_least")
    return summed.select(
        "*",
        (F.col("total_tokens") - cut).alias("kept_tokens"),
        cut.alias("cut_tokens"),
        (F.col("docs_at_least") - F.col("n_docs")).alias("cut_docs"),
        ((shorter + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(curve: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, kept_tokens, cut_tokens, cut_docs`` for any limits, from the first length at or above each.

    One pass over the curve and one small row. Documents shorter than a limit are kept whole. With an empty curve
    the totals are null.
    """
    first = [
        F.min(F.when(F.col("length") > n, F.struct("length", "docs_at_least", "tokens_at_least"))).alias(f"_{k}") for k, n in enumerate(limits)
    ]
    row = curve.agg(F.max("total_tokens").alias("_all"), *first)
    each = []
    for k, n in enumerate(limits):
        cut = F.when(F.col("_all").isNotNull(), F.coalesce(F.col(f"_{k}.tokens_at_least") - F.col(f"_{k}.docs_at_least") * n, F.lit(0)))
        docs = F.when(F.col("_all").isNotNull(), F.coalesce(F.col(f"_{k}.docs_at_least"), F.lit(0)))
        each.append(F.struct(F.lit(n).cast("long").alias("context_limit"), (F.col("_all") - cut).alias("kept_tokens"), cut.alias("cut_tokens"), docs.alias("cut_docs")))
    return row.select(F.inline(F.array(*each)))


def quantiles(curve: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the smallest length that at least this share of the documents doesn't exceed; null for an empty curve."""
    row = curve.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias(f"_{k}") for k, q in enumerate(shares)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"_{k}").alias("length")) for k, q in enumerate(shares)])))


def length_curve(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The limit curve of a table of texts. The histogram is written once, as the curve reads it twice."""
    return limit_curve(stored(histogram(encoded_lengths(docs, tokenizer, text_col)), "lengths", batch=1000))
