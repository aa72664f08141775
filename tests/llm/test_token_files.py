from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mendwell.llm import length_histogram, token_files
from mendwell.llm.queries import QUERIES, tokenizer_file

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "12", ".", "<|endoftext|>", "日本", "👍🏽", "\x1c", "\x85", " \n", " the", "\r\n", "œuvre.", " Straße!?", "x\ny", "ǅ", " don't."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("max_known", [0, 40, 100_000])
def test_encoder_equals_the_library(tokenizer, max_known):
    rng = random.Random(5)
    encoder = token_files.Encoder(tokenizer_file(), max_known)
    for text in [None, "", " ", "\n", *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(4000))]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(tokenizer, text), repr(text)


def test_words_with_marks_equal_the_library(tokenizer):
    rng = random.Random(6)
    encoder = token_files.Encoder(tokenizer_file(), 500)
    words = ["word", "Łódź", "naïve", "it's", "l'eau", "x", "É", "straße", "4.0", "Ünï", "end", "I'll", "ž"]
    for _ in range(4_000):
        text = " ".join(rng.choice(words) + "".join(rng.choice(token_files.MARKS + "'") for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))) for _ in range(rng.randint(1, 6)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(tokenizer, text), repr(text)


def expected(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        own = [*ids(tokenizer, text), 0]
        out.append((doc_id, start, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
        start += len(own)
    return out


def read_back(docs):
    found = token_files.read_token_files(token_files.write_token_files(docs, tokenizer_file()))
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])


def test_files_round_trip(spark, sf_dir, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    found = sorted((tuple(r) for r in QUERIES["op6_token_files"](spark, sf_dir).collect()), key=lambda r: r[1])
    assert found == expected(rows, tokenizer)


def test_nulls_ties_empty_and_long_texts(make_docs, tokenizer):
    long = "word " * 300_000
    rows = [(5, "five"), (None, "no id"), (2, None), (2, ""), (9, long), (5, "five"), (-3, "minus\n\nthree")]
    found = read_back(make_docs(rows).withColumnRenamed("lang", "n_tokens"))
    assert [r[0] for r in found] == [None, -3, 2, 2, 5, 5, 9]
    order = [(None, "no id"), (-3, "minus\n\nthree"), (2, ""), (2, ""), (5, "five"), (5, "five"), (9, long)]
    assert found == expected(order, tokenizer)


def test_many_rows_of_one_id_are_several_parts(spark, tokenizer):
    docs = spark.range(4000).selectExpr("7 AS doc_id", "concat('text ', id % 3) AS text")
    manifest = token_files.write_token_files(docs.repartition(4), tokenizer_file())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs.repartition(4), tokenizer_file())
        assert manifest.count() > 1
        found = token_files.read_token_files(manifest)
        assert found.count() == 4000
        last = found.orderBy("start").collect()
        assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:], strict=False))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(make_docs):
    assert read_back(make_docs([])) == []


def test_length_curve(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [len(ids(tokenizer, r.text)) for r in docs.select("text").collect()]
    curve = QUERIES["op5_length_histogram"](spark, sf_dir)
    rows = {r.length: r for r in curve.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert (r.n_docs, r.docs_at_least) == (sizes.count(n), sum(s >= n for s in sizes))
        assert (r.tokens_at_least, r.total_tokens) == (sum(s for s in sizes if s >= n), sum(sizes))
        assert (r.kept_tokens, r.cut_docs) == (sum(min(s, n) for s in sizes), sum(s > n for s in sizes))
        assert r.cut_tokens == r.total_tokens - r.kept_tokens
        assert r.quantile == sum(s <= n for s in sizes) / len(sizes)


def test_any_limit_and_quantile(spark):
    sizes = [0, 0, 3, 5, 5, 9000, 20000]
    counts = length_histogram.histogram(spark.createDataFrame([(s,) for s in sizes], "length long"))
    curve = length_histogram.limit_curve(counts, block=4)
    limits = [0, 1, 3, 4, 5, 100, 9000, 30000]
    found = {r.context_limit: (r.kept_tokens, r.cut_tokens, r.cut_docs) for r in length_histogram.at_limits(curve, limits).collect()}
    assert found == {n: (sum(min(s, n) for s in sizes), sum(max(s - n, 0) for s in sizes), sum(s > n for s in sizes)) for n in limits}
    assert [tuple(r) for r in length_histogram.quantiles(curve, [0.2, 0.5, 1.0]).collect()] == [(0.2, 0), (0.5, 5), (1.0, 20000)]


def test_curve_of_nothing(make_docs):
    curve = length_histogram.length_curve(make_docs([]), tokenizer_file())
    assert curve.collect() == []
    assert length_histogram.at_limits(curve, [5]).first().kept_tokens is None


def test_null_texts_have_length_zero(make_docs):
    docs = make_docs([(1, None), (1, ""), (2, "one")])
    assert {r.length: r.n_docs for r in length_histogram.length_curve(docs, tokenizer_file()).collect()} == {0: 2, 1: 1}
