"""Quality rules: per-document counts, and removal of lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import BLANKS, GAP, bound, stored, words
from mendwell.session import broadcast_if_small

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# A line is boilerplate if more documents of its host have it, whatever the size of the host.
MAX_DOCS = 10
# A document that keeps less than this share of its words is rejected.
MIN_LEFT = 0.3


def repeated_words(found: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window which occurs twice or more in the array of words.

    Equal windows are found by their 64-bit hashes. Texts without any, most of them, are
    told by the number of distinct hashes; the others sort their hashes, in linear
    logarithmic time.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, k: F.least(F.coalesce(F.get(starts, k + 1) - at, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def repeats(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def doubled(held: Column) -> Column:
            twice = F.filter(held, lambda x, k: F.coalesce(F.get(held, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(held, k + 1)["h"] == x["h"], F.lit(False)))
            return bound(F.array_sort(F.transform(twice, lambda x: x["k"])), covered)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(placed, doubled))

    hashes = F.transform(F.sequence(F.lit(0), F.size(found) - width), lambda k: F.xxhash64(*[F.get(found, k + i) for i in range(width)]))
    return F.when(F.size(found) < width, F.lit(0).cast("long")).otherwise(bound(hashes, repeats))


def has_word(line: Column) -> Column:
    return F.translate(line, BLANKS, "") != ""


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``; null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = bound(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    doubled = bound(F.filter(F.split(text, "\n"), has_word), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    out = docs.select(
        "*",
        counted.alias("_counted"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        doubled.cast("long").alias("n_dup_lines"),
    ).select("*", F.col("_counted.n_words"), F.col("_counted.n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.drop("_counted").withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one space."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), GAP, " "), "[0-9]", "0"))


def _keys(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list[Column]:
    """A document's key: rows that agree in id, host and text get the same verdict. Null ids and hosts are values of their own."""
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias("_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("_host"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"),
    ]


def shared_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``_host, _line, n_docs`` of the lines that more than ``max_docs`` documents of a host have.

    Distinct documents are counted in two steps, so no host or line meets in one task.
    """
    return lines.groupBy("_host", "_line").agg(F.count_distinct("_id").alias("n_docs")).filter(F.col("n_docs") > max_docs)


def remove_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """``docs`` with base counts, ``removed_lines``, ``removed_words``, ``clean_text`` and ``kept``.

    Lines are compared in normal form by 64-bit hash, blank lines never. A line is removed wherever
    more than ``max_docs`` documents of the same host have it, in a host of any size. A document is kept
    unless it fails the base rules or is depleted, left with less than ``min_left`` of its words.
    Null text has no lines and fails the base rules. Rows of one id count as one document, so do rows
    without id; a null host is a host. Every row, repeated ones too, is returned once. Columns of ``docs``
    named like the results are replaced. Of a line only its hash, place and number of
    words are kept, written once and shuffled; texts are shuffled only where ``clean_text`` is used.
    """
    fresh = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_words", "clean_text", "kept"]
    docs = docs.drop(*[c for c in fresh if c not in (id_col, text_col, host_col)])
    lines = docs.select(*_keys(docs, id_col, text_col, host_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_at", "_raw"))
    lines = lines.filter(has_word(F.col("_raw"))).select(
        "_id", "_host", "_text_hash", "_at", F.xxhash64(normal_line(F.col("_raw"))).alias("_line"), F.size(words(F.col("_raw"))).alias("_words")
    )
    lines = stored(lines, "lines")
    shared = stored(shared_lines(lines, max_docs), "shared-lines")
    hit = lines.join(broadcast_if_small(shared.drop("n_docs")), ["_host", "_line"], "left_semi")
    # Repeated rows give their lines more than once.
    removed = hit.groupBy("_id", "_host", "_text_hash").agg(F.sort_array(F.collect_set(F.struct("_at", "_words"))).alias("_gone"))
    out = base_stats(docs.select("*", *_keys(docs, id_col, text_col, host_col)), text_col).join(removed, ["_id", "_host", "_text_hash"], "left")
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<struct<_at:int,_words:int>>"))
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda total, x: total + x["_words"])

    def left(held: Column) -> Column:
        """The lines between those removed, in one pass."""
        ends = F.concat(F.array(F.lit(-1)), F.transform(gone, lambda x: x["_at"]), F.array(F.size(held)))
        runs = bound(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice(held, F.get(e, k) + 2, F.get(e, k + 1) - F.get(e, k) - 1)))
        return F.array_join(F.flatten(runs), "\n")

    out = out.select("*", F.size(gone).cast("long").alias("removed_lines"), lost.alias("removed_words"), bound(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), left).alias("clean_text"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words"))
    return out.withColumn("kept", kept).drop("_id", "_host", "_text_hash", "_gone")
