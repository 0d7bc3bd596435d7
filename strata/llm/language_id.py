"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's features are the runs of two to five bytes of the word between marks, hashed to buckets. A text is the mean
of its features' embeddings; a linear softmax on it gives the languages. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents, whose features are made by Spark. The
embeddings times the weights are one score a bucket and language, so a text is scored by its distinct words.
A part of the sample sets the temperature of the scores and the score below which a prediction is
called rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import text_of
from strata.llm.tokens import LOWER_ALNUM, coded_words, mix, slices


@dataclass(frozen=True)
class Training:
    """The sample has at most ``rows`` documents, shared evenly by the languages, or ``least_rows`` of each if they are more than
    that: of each language those with the least hash of their key, so that a rare one is learned too."""

    rows: int = 2000
    least_rows: int = 20
    buckets_bits: int = 15
    dimension: int = 16
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7
    #: Of the rows kept back to calibrate (one of ``fold``), at most so many in a hundred right ones are rejected.
    fold: int = 5
    rejected_percent: float = 1.0


def word_features(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features, where each word's begin), the end included."""
    left, right, none = (pa.scalar(x, pa.large_string()) for x in ("<", ">", ""))
    _, offsets, data = pc.binary_join_element_wise(left, words.cast(pa.large_string()), right, none).buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1)
    letters = np.frombuffer(data, np.uint8)[: at[-1]].astype(np.uint64) if len(words) else np.empty(0, np.uint64)
    word = np.repeat(np.arange(len(words)), np.diff(at))
    found, owner, run = [], [], np.zeros(len(letters), np.uint64)
    for n in range(1, 6):
        run = run[: max(0, len(letters) - n + 1)] * np.uint64(257) + letters[n - 1 :]
        if n > 1:
            inside = np.flatnonzero(word[: len(run)] == word[n - 1 :])
            found.append(mix(run[inside] + np.uint64(n << 56)) >> np.uint64(64 - bits))
            owner.append(word[inside])
    found, owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    languages: list[str]
    #: Score of each bucket and language; the last row is the bias.
    scores: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of the languages of each text; without features, those of the bias."""
        offsets, codes, words = coded_words(texts, LOWER_ALNUM)
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if len(words):
            buckets, begins = word_features(words, self.bits)
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.scores[buckets], axis=0, dtype=np.float64)])
            per_word, counts = (sums[begins[1:]] - sums[begins[:-1]])[codes], np.diff(begins)[codes]
            full = np.flatnonzero(np.diff(offsets))
            out[full] = np.add.reduceat(per_word, offsets[full], axis=0)
            n[full] = np.add.reduceat(counts, offsets[full])
        return softmax((out / np.maximum(n, 1)[:, None] + self.scores[-1]) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, training: Training, key: str, text: str, lang: str) -> DataFrame:
    """``lang``, ``buckets``, ``counts`` of the sampled rows, one a key: of rows that repeat a key, the one with the least label
    and text. Of keys with one hash, the least goes first. Only keys are sorted; texts stay where they are."""
    rows = docs.select(F.col(key).cast("string").alias("key"), text_of(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("key").isNotNull())
    languages = rows.select("lang").distinct().count()
    quota = max(training.least_rows, training.rows // max(1, languages))
    chosen = rows.select("key", "lang").withColumn("h", F.xxhash64(F.lit(training.seed), "key")).withColumn("part", F.pmod("h", F.lit(64)))
    # Spark keeps the first of each group in each task before it sorts them. What a language has the least of, it has the least of in
    # one of 64 parts too: no task gets what all tasks kept of a frequent language. Then quota * languages keys are chosen
    for same in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*same).orderBy("h", "key")
        chosen = chosen.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= quota).drop("place").distinct()
    chosen = chosen.select(F.col("key").alias("k"), F.col("lang").alias("l"))
    rows = rows.join(F.broadcast(chosen), (F.col("key") == F.col("k")) & (F.col("lang") == F.col("l")), "left_semi")
    rows = rows.groupBy("key").agg(F.min(F.struct("lang", "text")).alias("r")).select("key", "r.text", "r.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                offsets, codes, words = coded_words(part.column(1), LOWER_ALNUM)
                buckets, begins = word_features(words, training.buckets_bits)
                found = []
                for s, e in zip(offsets[:-1], offsets[1:]):
                    ids, n = np.unique(codes[s:e], return_counts=True)
                    all_of = np.concatenate([buckets[begins[i] : begins[i + 1]] for i in ids]) if len(ids) else np.empty(0, np.int64)
                    weights = np.repeat(n, np.diff(begins)[ids])
                    sums = np.bincount(all_of, weights, minlength=1)
                    kinds = np.flatnonzero(sums)
                    found.append((kinds.astype(np.int32), sums[kinds].astype(np.float32)))
                columns = [part.column(0), part.column(2), pa.array([k for k, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "buckets", "counts"])

    return rows.select("key", "text", "lang").mapInArrow(run, "key string, lang string, buckets array<int>, counts array<float>")


def train(docs: DataFrame, training: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the labelled rows of ``docs``, or None if there are none. Rows with a null label or key are left out.

    The sample is bounded (see ``Training``), whatever keys or rows repeat, and is all that reaches the driver.
    """
    found = sample(docs, training, key, text, lang).toArrow().combine_chunks().sort_by([("key", "ascending"), ("lang", "ascending")])
    lists = [[found[c].chunk(0)[i].values.to_numpy() for i in range(len(found))] if len(found) else [] for c in ("buckets", "counts")]
    rows = [(name, b.astype(np.int64), n.astype(np.float64)) for name, b, n in zip(found["lang"].to_pylist(), *lists) if len(b)]
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    rng, place = np.random.default_rng(training.seed), {k: i for i, k in enumerate(languages)}
    n_buckets, d = 1 << training.buckets_bits, training.dimension
    embed, weights, bias = rng.uniform(-1 / d, 1 / d, (n_buckets, d)), np.zeros((d, len(languages))), np.zeros(len(languages))
    fit, held = [r for i, r in enumerate(rows) if i % training.fold] or rows, rows[:: training.fold]
    steps, step = training.epochs * len(fit), 0
    for _ in range(training.epochs):
        for i in rng.permutation(len(fit)):
            rate = training.rate * (1 - step / steps)
            label, buckets, counts = fit[i]
            share = (counts / counts.sum())[:, None]
            hidden = (share * embed[buckets]).sum(axis=0)
            error = softmax(hidden @ weights + bias)
            error[place[label]] -= 1
            down = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            embed[buckets] -= rate * len(buckets) ** 0.5 * share * down
            step += 1
    model = Model(languages, np.vstack([embed @ weights, bias]).astype(np.float32), training.buckets_bits)
    logits = np.array([(counts[:, None] * model.scores[buckets]).sum(axis=0) / counts.sum() + model.scores[-1] for _, buckets, counts in held], np.float64)
    truth = np.array([place[r[0]] for r in held])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    model.threshold = float(np.percentile(right, training.rejected_percent)) if len(right) else 0.0
    return model


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``lang_pred``, ``score`` and ``rejected`` (the score is below the calibrated threshold).

    ``und`` with score 0 if the text is null or has no letter, or there is no model. Of languages with one score, the first by
    name is given. Repeated rows get the same prediction; very long texts are scored whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                texts = part.column(1)
                known = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False) & (model is not None)
                names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if known.any():
                    p = model.texts(texts)
                    best = p.argmax(axis=1)
                    names = np.where(known, np.array(model.languages, object)[best], names)
                    score = np.where(known, p[np.arange(len(best)), best], 0.0)
                rejected = ~known | (score < (model.threshold if model else 0.0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [key, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key), text_of(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")
