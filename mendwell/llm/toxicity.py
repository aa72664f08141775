"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mendwell.llm.common import stored

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
# Labelled documents that are learnt from, at most.
MAX_TRAIN = 12_000
THRESHOLD = 0.3
# Log-odds of a sentence where nothing was learnt.
UNTAUGHT = -20.0
HELD_OUT = 2


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings, whatever its case and the punctuation around it."""
    import xxhash

    word = word.strip(EDGES).lower()
    if not word:
        return []
    return [xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") % BUCKETS for n in PREFIXES if n < len(word)] + [xxhash.xxh3_64_intdigest(f"0:{word}") % BUCKETS]


def telling(seen: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Buckets that toxic documents have more often than chance allows with so many buckets, by the likelihood ratio."""
    rate = toxic / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.nan_to_num(toxic * np.log(rate / share)) + np.nan_to_num((seen - toxic) * np.log((1 - rate) / (1 - share))))
    return (rate > share) & (ratio > 2 * np.log(max(2, np.count_nonzero(seen))))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Bucket weights and the bias of a sentence's log-odds.

    A document is toxic unless none of its sentences is: with the softplus ``s`` of the
    log-odds summed over its sentences, its score is ``1 - exp(-s)``. The whole
    gradient is followed with Adam. Buckets that don't tell toxic documents stay at zero.
    """
    vocabulary: dict[str, int] = {}
    tokens, sentence_of, doc_of = [], [], []
    for d, text in enumerate(texts):
        for part in SENTENCE.findall(text or ""):
            words = part.split()
            if words:
                tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in set(words)]
                sentence_of += [len(doc_of)] * len(set(words))
                doc_of.append(d)
    weights, bias = np.zeros(BUCKETS), -6.0
    if not doc_of:
        return weights, UNTAUGHT
    tokens, sentence_of, doc_of = np.array(tokens), np.array(sentence_of), np.array(doc_of)
    each = [features(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    bucket = np.array([b for x in each for b in x], np.int64)
    # Documents, and toxic ones, in which a bucket occurs.
    seen = np.unique(doc_of[sentence_of] * len(each) + tokens)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    counts = np.zeros((2, BUCKETS))
    for doc in np.split(seen, np.flatnonzero(np.diff(seen // len(each))) + 1):
        buckets = np.unique(np.concatenate([bucket[starts[w] : starts[w + 1]] for w in doc % len(each)]))
        counts[0, buckets] += 1
        counts[1, buckets] += labels[doc[0] // len(each)]
    used = telling(counts[0], counts[1], labels.mean())
    owner, bucket = owner[used[bucket]], bucket[used[bucket]]
    cost = 1 / len(labels)
    state = np.zeros((2, BUCKETS + 1))
    theta = np.concatenate([weights, [bias]])
    for k in range(1, rounds + 1):
        per_word = np.bincount(owner, theta[bucket], len(each))
        z = np.clip(theta[-1] + np.bincount(sentence_of, per_word[tokens], len(doc_of)), -30, 30)
        total = np.bincount(doc_of, np.logaddexp(0, z), len(labels))
        slope = cost * np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        at_sentence = slope[doc_of] / (1 + np.exp(-z))
        at_word = np.bincount(tokens, at_sentence[sentence_of], len(each))
        grad = np.concatenate([np.bincount(bucket, at_word[owner], BUCKETS), [at_sentence.sum()]])
        grad[:-1] += decay * theta[:-1] * used
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        theta -= rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-9)
    return theta[:-1], float(theta[-1])


class Scorer:
    """Sentence and document scores; a worker keeps what it knows of up to ``max_known`` words."""

    def __init__(self, weights: bytes, bias: float, max_known: int = 250_000):
        self.weights, self.bias, self.max_known = weights, bias, max_known
        self.table, self.known = np.frombuffer(weights, "<f4"), {}

    def __reduce__(self):
        return type(self), (self.weights, self.bias, self.max_known)

    def word(self, word: str) -> float:
        value = float(self.table[features(word)].sum())
        if len(self.known) < self.max_known:
            self.known[word] = value
        return value

    def log_odds(self, sentence: str) -> float | None:
        """Of a sentence; none without words. A word counts once."""
        words = set(sentence.split())
        if not words:
            return None
        found = [self.known.get(w) for w in words]
        if None in found:
            found = [self.word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        # A fixed order of summation, so that reruns agree to the last digit.
        return self.bias + sum(sorted(found))

    def score(self, text: str | None) -> float:
        z = [x for x in map(self.log_odds, SENTENCE.findall(text or "")) if x is not None]
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if z else 0.0

    def sentences(self, text: str, least: float) -> list[dict]:
        """Places, in code points, and scores of the sentences that score ``least`` or more."""
        found = []
        for match in SENTENCE.finditer(text):
            z = self.log_odds(match[0])
            if z is not None and (p := float(-np.expm1(-np.logaddexp(0, z)))) >= least:
                found.append({"start": match.start(), "length": len(match[0]), "score": p})
        return found


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 4; so are rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Scorer:
    """A scorer learnt in one task from up to ``max_train`` labelled documents, chosen by a hash of their ids.

    Held-out rows and null labels aren't learnt from. Ids labelled twice count as toxic if either
    label says so; of rows that share an id one text is used. Without any labelled row
    the bias alone remains and all scores are close to 0.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    known = known.filter(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # No more rows than ``max_train``.
    sample = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"_id": [], "_label": [], "_text": []}), *frames]).sort_values("_id")
        weights, bias = fit(frame["_text"].tolist(), frame["_label"].to_numpy(dtype=float))
        yield pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    row: Row | None = stored(sample.repartition(1).mapInPandas(learn, "weights binary, bias double"), "toxicity").first()
    # Without rows no task runs.
    return Scorer(bytes(row.weights), row.bias) if row else Scorer(np.zeros(BUCKETS, "<f4").tobytes(), UNTAUGHT)


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score, predicted`` and ``toxic_sentences`` (start, length, score) of documents predicted toxic.

    Null, empty and blank texts have no sentences and score 0. Of columns with these names the new ones stay; repeated
    rows get the same score. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("score double, sentences array<struct<start:int,length:int,score:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        scores = [held.value.score(text) for text in texts]
        places = [held.value.sentences(text, threshold / 2) if s >= threshold else [] for s, text in zip(scores, texts, strict=True)]
        return pd.DataFrame({"score": scores, "sentences": places})

    judged = docs.drop("score", "predicted", "toxic_sentences").withColumn("_judged", judge(F.col(text_col)))
    return judged.select("*", F.col("_judged.score").alias("score"), (F.col("_judged.score") >= threshold).cast("int").alias("predicted"), F.col("_judged.sentences").alias("toxic_sentences")).drop("_judged")
