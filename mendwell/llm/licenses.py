"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A template is found in a block where the block holds a given part of its distinct words. Words are
ordered by how many blocks hold them, rarest first. A block that holds ``need`` words of a template
shares at least one word with the template's first ``size - need + 1``, within its own first
words; that word, the sizes and the places in the order give all candidates, which are then
counted in full. Native: DataFrame functions only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import bound, stored
from mendwell.llm.license_templates import NOTICES, TEXTS
from mendwell.session import broadcast_if_small

# What lies between words, after A-Z are lower case.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLANK_LINE = "\\n[\\x20\\x09\\x0B-\\x0D]*\\n"
# Label of the words that stand before "license".
PHRASES = {"mit": ["mit"], "apache": ["apache"], "gpl": ["general", "public"]}

# A template is found in a block that holds this part of its words: texts in paragraphs, notices in lines.
TEXT_SHARE, NOTICE_SHARE = 0.8, 1.0
PARAGRAPH, LINE = "paragraph", "line"

_TOKENS = "array<string>"


class Template:
    """A template's distinct words and how many of them a block has to hold."""

    def __init__(self, kind: str, label: str, text: str, share: float) -> None:
        plain = "".join(c.lower() if c in string.ascii_letters else c if c.isdigit() or c > "\x7f" else " " for c in text)
        self.kind, self.label, self.tokens = kind, label, sorted(set(plain.split()))
        self.need = math.ceil(share * len(self.tokens) - 1e-9)


def templates(texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES, text_share: float = TEXT_SHARE, notice_share: float = NOTICE_SHARE) -> list[Template]:
    found = [Template(PARAGRAPH, label, text, text_share) for label, text in texts.items()]
    return found + [Template(LINE, label, text, notice_share) for label, text in notices.items()]


def wider(template: Template, among: list[Template]) -> list[str]:
    """Labels of the templates that hold all words of this one and more; where one of them is found, this one says nothing."""
    held = set(template.tokens)
    return [t.label for t in among if t.kind == template.kind and held < set(t.tokens)]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(_TOKENS)


def phrase_places(words: Column, phrases: dict[str, list[str]] = PHRASES) -> Column:
    """``start, label`` of every place where a phrase's words stand consecutively, in order."""

    def at(word: Column, k: Column) -> Column:
        found = F.lit(None).cast("struct<start:long,label:string>")
        for label, before in phrases.items():
            n = len(before)
            matches = [F.get(words, k - n + i) == F.lit(b) for i, b in enumerate(before)]
            fits = matches[0]
            for m in matches[1:]:
                fits = fits & m
            here = F.struct((k - n).cast("long").alias("start"), F.lit(label).alias("label"))
            found = F.when((word == "license") & (k >= n) & F.coalesce(fits, F.lit(False)), here).otherwise(found)
        return found

    return F.filter(F.transform(words, at), lambda p: p.isNotNull())


def blocks_of(low: Column, kind: str, known: list[Template]) -> Column:
    """``kind, at, tokens`` of the blocks of one kind that hold enough words of templates to hold any of them."""
    mine = [t for t in known if t.kind == kind]
    if not mine:
        return F.array().cast(f"array<struct<kind:string,at:int,tokens:{_TOKENS}>>")
    words, least = _strings(sorted({w for t in mine for w in t.tokens})), min(t.need for t in mine)

    def block(text: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.array_intersect(words, F.split(text, SEPARATOR)).alias("tokens"))

    pieces = F.transform(F.split(low, BLANK_LINE if kind == PARAGRAPH else "\\n"), block)
    return F.filter(pieces, lambda b: F.size(b["tokens"]) >= least)


def read_texts(docs: DataFrame, known: list[Template], id_col: str, text_col: str) -> DataFrame:
    """One row per document: its words counted, its phrases, and its blocks reduced to words of templates."""

    def facts(words: Column) -> Column:
        places = F.when(F.array_contains(words, "license"), bound(words, lambda w: phrase_places(w))).otherwise(F.array().cast("array<struct<start:long,label:string>>"))
        return F.struct(F.size(words).cast("long").alias("n_words"), places.alias("places"))

    def parts(low: Column) -> Column:
        counted = bound(F.array_remove(F.split(low, SEPARATOR), ""), facts)
        return F.struct(counted.alias("counted"), F.concat(blocks_of(low, PARAGRAPH, known), blocks_of(low, LINE, known)).alias("blocks"))

    read = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), bound(lowered(F.col(text_col)), parts).alias("_parts"))
    return read.select(id_col, "_row", F.col("_parts.counted.n_words").alias("n_words"), F.col("_parts.counted.places").alias("_places"), F.col("_parts.blocks").alias("_blocks"))


def word_order(blocks: DataFrame) -> dict[str, list[str]]:
    """Words of templates by how many blocks hold them, rarest first; a few hundred rows, bounded by the templates."""
    counts = blocks.select("kind", F.explode("tokens").alias("token")).groupBy("kind", "token").count().collect()
    order: dict[str, list[str]] = {}
    for r in sorted(counts, key=lambda r: (r["count"], r["token"])):
        order.setdefault(r["kind"], []).append(r["token"])
    return order


def similar_blocks(blocks: DataFrame, known: list[Template], order: dict[str, list[str]]) -> DataFrame:
    """``blocks`` (``kind, at, tokens`` and keys) joined with every template they hold enough of: ``label, overlap, size``.

    A pair comes once for each word that the two prefixes share. Postings are one row per
    template and prefix word and so bounded by the templates.
    """
    postings, least = [], {}
    for t in known:
        rank = {w: k for k, w in enumerate(order.get(t.kind, []))}
        # Words that no block holds are the rarest of all.
        tokens = sorted(t.tokens, key=lambda w: (rank.get(w, -1), w))
        postings += [(t.kind, w, k, t.label, tokens, len(tokens), t.need) for k, w in enumerate(tokens[: len(tokens) - t.need + 1])]
        least[t.kind] = min(t.need, least.get(t.kind, t.need))
    spark = blocks.sparkSession
    looked_up = F.broadcast(spark.createDataFrame(postings, f"kind STRING, token STRING, _i INT, label STRING, _template {_TOKENS}, size INT, _need INT"))
    ordered, needed = F.col("tokens"), F.lit(0)
    for kind, words in order.items():
        ordered = F.when(F.col("kind") == kind, F.array_intersect(_strings(words), F.col("tokens"))).otherwise(ordered)
        needed = F.when(F.col("kind") == kind, F.lit(least[kind])).otherwise(needed)
    sorted_blocks = blocks.withColumn("tokens", ordered).withColumn("_n", F.size("tokens")).withColumn("_least", needed)
    # A word later than this in the block leaves too few after it for any template.
    listed = sorted_blocks.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.col("_n") - F.col("_least") + 1, F.lit(0)))).alias("_j", "token"))
    candidates = listed.join(looked_up, ["kind", "token"]).filter(
        (F.col("_n") >= F.col("_need")) & (1 + F.least(F.col("size") - F.col("_i") - 1, F.col("_n") - F.col("_j") - 1) >= F.col("_need"))
    )
    counted = candidates.withColumn("overlap", F.size(F.array_intersect("_template", "tokens")))
    return counted.filter(F.col("overlap") >= F.col("_need")).drop("token", "_n", "_least", "_j", "_i", "_template", "_need")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """One row per document: id, ``n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``matches`` lists every template found (``kind``, number ``at`` of the paragraph or line, ``label``,
    ``containment``). ``labels`` are those of phrases and of templates, but a template says nothing where a wider one is found in the
    same block ("CC BY" within "CC BY-NC"). ``score`` is 1 with a phrase, else the largest containment
    found, 0 without any. Null and empty texts have no words; every row, repeated ones too, comes once, and null
    ids stay null. Other columns are ignored. Paragraphs end at blank lines, whatever their
    length. Blocks are reduced to words of templates where they are read; only those and
    the matches are written or shuffled.
    """
    known = templates() if known is None else known
    read = stored(read_texts(docs, known, id_col, text_col), "license-blocks")
    blocks = read.select("_row", F.inline("_blocks"))
    pairs = similar_blocks(blocks, known, word_order(blocks)).select(
        "_row", "kind", "at", "label", (F.col("overlap") / F.col("size")).alias("containment")
    ).distinct()
    in_block = pairs.groupBy("_row", "kind", "at").agg(F.collect_list(F.struct("label", "containment")).alias("_held"))
    labels = F.transform("_held", lambda h: h["label"])
    def said(label: Column) -> Column:
        beaten = F.lit(False)
        for t in known:
            over = wider(t, known)
            if over:
                beaten = beaten | ((F.col("kind") == t.kind) & (label == t.label) & F.arrays_overlap(labels, _strings(over)))
        return ~beaten

    told = in_block.select("_row", F.filter(labels, said).alias("_said"), F.transform("_held", lambda h: F.struct(F.col("kind"), F.col("at"), h["label"].alias("label"), h["containment"].alias("containment"))).alias("_held"))
    by_row = told.groupBy("_row").agg(
        F.array_distinct(F.flatten(F.collect_list("_said"))).alias("_said"), F.sort_array(F.flatten(F.collect_list("_held"))).alias("matches")
    )
    out = read.drop("_blocks").join(broadcast_if_small(by_row), "_row", "left")
    none = F.array().cast(_TOKENS)
    base = F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"])))
    starts = F.transform("_places", lambda p: p["start"])
    matches = F.coalesce("matches", F.array().cast("array<struct<kind:string,at:int,label:string,containment:double>>"))
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))
    return out.select(
        id_col,
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("_said", none))), ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        matches.alias("matches"),
    )
