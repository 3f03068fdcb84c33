"""Toxicity by compression distance: two zstandard dictionaries, one classifier.

Training uses a bounded sample of labelled rows (see `fit`):

* the ordinary dictionary is trained by zstandard on all windows of the
  ordinary sample (the windows themselves if they fit), and in two rounds
  over the whole sample those ordinary windows that still look most toxic join;
* the toxic dictionary is trained by zstandard on the toxic sample, each
  document reduced to its novel words: those with a 5-character fragment that
  at most one ordinary document has. Its compressor also has the ordinary
  dictionary behind it, so lengths differ only by what is toxic.

A window of 16 words is compressed with both; the gain is the difference of
the two lengths. Thresholds of gains are quantiles: of all ordinary windows,
and of the largest gains of toxic documents. A document's gains (mean,
largest, share above the thresholds) go through a logistic curve. Thresholds
and curve are fitted on gains by dictionaries that haven't seen the document:
for each third of the sample another pair is trained on the other two; the
pair that scores is trained on all of it. Scoring takes all windows of the
whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import ship, with_text, written

WINDOW = 16
LEVEL = 12
FRAGMENT = 5
ORDINARY_BYTES = 60_000
TOXIC_BYTES = 2_000
#: Quantiles that make the thresholds: of gains of ordinary windows, of largest gains of toxic documents.
ORDINARY_QUANTILES, TOXIC_QUANTILES = (0.98, 0.995, 0.999), (0.25, 0.5)
#: Rounds in which ordinary windows with a gain join the ordinary dictionary, and from which gain.
HARD_ROUNDS, HARD_GAIN = 2, 2
#: Lengths of the segments that dictionary training chooses, and of the runs that it counts.
ORDINARY_K, ORDINARY_D, TOXIC_K, TOXIC_D = 64, 8, 16, 6
FOLDS, HELD_OUT = 5, 0
#: Parts of the sample; each is measured by dictionaries of the others.
PARTS = 3

_gap = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str) -> list[str]:
    return [w for w in (x.strip(".,;:!?") for x in _gap.split(text.lower())) if w]


def windows(text: str) -> list[bytes]:
    found = words(text)
    return [f" {' '.join(found[i : i + WINDOW])} ".encode() for i in range(0, len(found), WINDOW)]


def _fragments(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + FRAGMENT] for i in range(len(padded) - FRAGMENT + 1)]


def _novel(text: str, common: set[str]) -> list[str]:
    """The words that have a fragment which isn't common."""
    return [w for w in words(text) if not common.issuperset(_fragments(w))]


@dataclass
class ToxicityModel:
    """Both dictionaries and the fitted curve; small enough to go with a task."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    thresholds: tuple[float, ...] = (0.0,) * (len(ORDINARY_QUANTILES) + len(TOXIC_QUANTILES))

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(data: bytes) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

        return one(self.ordinary), one(self.toxic + self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def gains(text: str, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """How many bytes the toxic dictionary saves in each window; an empty text has one window without gain."""
    return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)] or [0])


def features(gain: np.ndarray, thresholds: tuple[float, ...]) -> list[float]:
    top = np.sort(gain)[-3:]
    return [gain.mean(), min(gain.max(), 12), min(top.mean(), 12), *((gain > t).mean() for t in thresholds), *(min(np.log1p((gain > t).sum()), 3) for t in thresholds)]


def _with_hard_windows(model: ToxicityModel, found: list[bytes]) -> bytes:
    """The ordinary dictionary with the ordinary windows that look most toxic at its end, the hardest last."""
    plain, toxic = model.compressors()
    measured = [(len(plain.compress(w)) - len(toxic.compress(w)), w) for w in found]
    hard = sorted((g for g in measured if g[0] >= HARD_GAIN), key=lambda g: -g[0])
    sizes = np.cumsum([len(w) for _, w in hard] or [0])
    kept = [w for (_, w), size in zip(hard, sizes) if size <= ORDINARY_BYTES // 3]
    return model.ordinary + b"".join(reversed(kept))


def _dictionary(found: list[bytes], size: int, k: int, d: int) -> bytes:
    """`size` bytes trained by zstandard; fewer bytes than that are the dictionary themselves."""
    if sum(map(len, found)) <= size:
        return b"".join(found)
    try:
        return zstandard.train_dictionary(size, found, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the most frequent ones, the first of them last
        return b"".join(w for w, _ in reversed(Counter(found).most_common()))[-size:]


def dictionaries(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """Both dictionaries from a sample; the curve is still to be fitted."""
    toxic, ordinary = [t for t, y in zip(texts, labels) if y], [t for t, y in zip(texts, labels) if not y]
    known: Counter[str] = Counter()
    for text in ordinary:
        known.update({f for w in set(words(text)) for f in _fragments(w)})
    common = {f for f, n in known.items() if n > 1}
    found = [w for t in ordinary for w in windows(t)]
    samples = [f" {' '.join(new)} ".encode() for t in toxic if (new := _novel(t, common))]
    model = ToxicityModel(_dictionary(found, ORDINARY_BYTES, ORDINARY_K, ORDINARY_D), _dictionary(samples, TOXIC_BYTES, TOXIC_K, TOXIC_D), np.zeros(1), np.zeros(0), np.ones(0))
    for _ in range(HARD_ROUNDS):
        model.ordinary = _with_hard_windows(model, found)
    return model


def calibrate(model: ToxicityModel, measured: list[np.ndarray], labels: np.ndarray) -> ToxicityModel:
    """Thresholds and curve from the gains of the sample. With one class only, score is its share."""
    ordinary = np.concatenate([g for g, y in zip(measured, labels) if not y] or [np.zeros(1)])
    largest = [g.max() for g, y in zip(measured, labels) if y] or [0.0]
    model.thresholds = (*np.quantile(ordinary, ORDINARY_QUANTILES).tolist(), *np.quantile(largest, TOXIC_QUANTILES).tolist())
    x = np.array([features(g, model.thresholds) for g in measured] or [features(np.zeros(1), model.thresholds)])
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.weights = _logistic((x - model.centre) / model.scale, labels if len(labels) else np.zeros(1))
    return model


def train(texts: list[str], labels: np.ndarray, part: np.ndarray | None = None) -> ToxicityModel:
    """Dictionaries and curve from a sample in memory; `part` (by default in turn) tells which third a text is in."""
    labels = np.asarray(labels)
    part = np.arange(len(texts)) % PARTS if part is None else part
    measured: list[np.ndarray] = [np.zeros(1)] * len(texts)
    for k in range(PARTS):
        seen = np.flatnonzero(part != k)
        compressors = dictionaries([texts[i] for i in seen], labels[seen]).compressors()
        for i in np.flatnonzero(part == k):
            measured[i] = gains(texts[i], *compressors)
    return calibrate(dictionaries(texts, labels), measured, labels)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(x.shape[1])
    penalty = ridge * len(x) / 100 * np.eye(x.shape[1]) + 1e-3 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text (null: empty), modulo FOLDS."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 1_500, most_ordinary: int = 4_500, most_bytes: int = 16 << 20) -> ToxicityModel:
    """Train on labelled rows outside the held-out fold.

    The sample: of each class the rows with the smallest md5 of the id, at
    most `most_toxic` and `most_ordinary` of them, and of each class
    `most_bytes` of text in that order (a document of more than a quarter of
    that isn't sampled). A task for each of PARTS + 1 pairs of dictionaries
    trains them, others measure gains; the driver gets the dictionaries (some
    100 kB a pair) and the gains, a number for each window. Labels with null ids or classes are left
    out; a document labelled twice counts as toxic if any of its labels says
    so, and of several texts under one id the smallest is sampled.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("mark"))
    marks = marks.where(fold() != HELD_OUT).withColumn("order", F.md5(F.col("doc_id").cast("string")))
    chosen = None
    for mark, most in ((1, most_toxic), (0, most_ordinary)):
        part = marks.where(F.col("mark") == mark).orderBy("order", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    size = F.octet_length("text").cast("long")
    rows = with_text(docs).join(F.broadcast(chosen), "doc_id").where(size <= most_bytes // 4).groupBy("order", "doc_id", "mark").agg(F.min("text").alias("text"))
    so_far = F.sum(size).over(Window.partitionBy("mark").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sample = rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("so_far")
    sample = written(sample.withColumn("part", F.crc32(F.col("order").cast("binary")) % PARTS), "sample")

    def trained(group: pa.Table) -> pa.Table:
        frame = group.to_pandas().sort_values(["order", "doc_id"])
        model = dictionaries(frame["text"].tolist(), frame["mark"].to_numpy(dtype=int))
        return pa.table({"pair": group["pair"][:1], "ordinary": pa.array([model.ordinary], pa.binary()), "toxic": pa.array([model.toxic], pa.binary())})

    # pair k is trained on all parts but k, the last one on all
    dealt = sample.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(PARTS)))).where("pair <> part")
    made = dealt.repartition(PARTS + 1, "pair").groupBy("pair").applyInArrow(trained, "pair int, ordinary binary, toxic binary").collect()
    pairs = [dictionaries([], np.zeros(0)) for _ in range(PARTS + 1)]
    for row in made:
        pairs[row.pair] = ToxicityModel(bytes(row.ordinary), bytes(row.toxic), np.zeros(1), np.zeros(0), np.ones(0))
    each = sample.select("order", "mark", _gains(F.col("text"), F.col("part"), pairs).alias("gains")).collect()
    each.sort(key=lambda r: r.order)
    return calibrate(pairs[PARTS], [np.frombuffer(r.gains, dtype="<i2") for r in each], np.array([r.mark for r in each], dtype=int))


def _gains(text: F.Column, part: F.Column, pairs: list[ToxicityModel]) -> F.Column:
    """The gains of a text as 16-bit numbers, by the dictionaries that haven't seen its part."""

    @F.pandas_udf("binary")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        compressors = [pair.compressors() for pair in pairs]
        for texts, parts in batches:
            yield pd.Series([np.clip(gains(t, *compressors[k]), -32768, 32767).astype("<i2").tobytes() for t, k in zip(texts, parts)], dtype=object)

    return measured(text, part)


def scored(docs: DataFrame, model: ToxicityModel) -> F.Column:
    """A column expression: the score of the column `text` (null: empty)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for texts in batches:
            rows = np.array([features(gains(t or "", *compressors), model.thresholds) for t in texts]).reshape(len(texts), -1)
            yield pd.Series(model.score(rows) if len(rows) else [], dtype=float)

    return score(F.coalesce(F.col("text"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5) for each row.

    Null and empty texts have no gain and get the score of a text without
    toxic windows; repeated rows repeat their result; equal texts have equal
    scores. Without any usable label the score is 0.5 or less for all. An
    empty table gives an empty result. A text is scored whole, window by
    window, however long it is.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels)
    out = with_text(docs).select("doc_id", (fold() == HELD_OUT).alias("held_out"), scored(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
