"""Trained models on Spark ML: lexical, boosted, self-training; scores differ from other libraries'."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import IDF, Normalizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import evidence
from varve.session import ship, written


#: Dimensions of hashed words, of word pairs, and of runs of each length.
WORDS, RUNS, LENGTHS = 1 << 12, 12_500, (3, 4, 5, 6)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of the words, word pairs and character runs of a lower-cased text."""
    text = text.lower()
    joined = " ".join(text.split()).encode()
    words, after = joined.split(b" ") if joined else [], joined.replace(b" ", b"\n ").split(b"\n")[1:]  # no word has a line's end
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    done, pairs = len(words), max(len(words) - 1, 0)
    found = np.empty(done + pairs + sum(max(len(points) - n + 1, 0) for n in LENGTHS), dtype=np.uint16)  # all dimensions fit
    sums = list(map(zlib.crc32, words))
    found[:done] = np.array(sums, dtype=np.uint32) % WORDS
    found[done : done + pairs] = np.fromiter(map(zlib.crc32, after, sums), np.uint32, pairs) % WORDS + WORDS  # a sum goes on over the next word
    done, code = done + pairs, points
    for n in range(2, max(LENGTHS) + 1):  # the code of a run goes on from that of the run without its last character
        code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in LENGTHS:
            high = (code >> np.uint64(40)).astype(np.uint32)
            found[done : done + len(high)] = high - high // np.uint32(RUNS) * np.uint32(RUNS) + np.uint32(2 * WORDS + LENGTHS.index(n) * RUNS)
            done += len(high)
    found.sort()
    last = np.append(np.flatnonzero(found[1:] != found[:-1]), len(found) - 1)[: len(found)]
    return found[last].astype(np.int64), np.diff(last, prepend=-1)


def coded(df: DataFrame, column: str = "text") -> DataFrame:
    """A written table with `tf`, the hashed counts of each text (null: empty).

    A text is cut into terms once, in Arrow batches, and no list of its terms
    leaves the task, so whatever is fitted or applied afterwards has a short plan.
    """
    ship(df.sparkSession)
    size = 2 * WORDS + len(LENGTHS) * RUNS

    @F.pandas_udf(VectorUDT())
    def counts(texts: pd.Series) -> pd.DataFrame:
        found = [_codes(t) for t in texts]  # a sparse vector in the columns of its type
        return pd.DataFrame({"type": np.zeros(len(found), np.int8), "size": np.int32(size), "indices": [i.astype(np.int32) for i, _ in found], "values": [n.astype(float) for _, n in found]})

    return written(df.withColumn("tf", counts(F.coalesce(F.col(column), F.lit("")))), "coded")


def text_stages() -> list:
    """Counts weighted by rarity, of unit length."""
    return [IDF(inputCol="tf", outputCol="_idf", minDocFreq=2), Normalizer(inputCol="_idf", outputCol="vector")]


def vectors(df: DataFrame, column: str = "text") -> DataFrame:
    """Texts as vectors: the default encoder, to be replaced by any pandas UDF."""
    rows = coded(df, column)
    return Pipeline(stages=text_stages()).fit(rows).transform(rows)


#: Entries of a stored block of coded texts and of those added up at once, steps of the descent, and how many of the last ones it remembers.
BLOCK, AT_ONCE, STEPS, MEMORY = 80_000, 300_000, 15, 8
#: Bytes of blocks or texts handed to a worker at once.
BATCH_BYTES = 8 << 20
#: Parquet's writer and reader hold a row group, so these are small, too.
GROUP = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false", "compression": "none"}


@dataclass(frozen=True)
class Lexical:
    """One linear SVM a label over weighted, normalised counts; `curve` (factors, offsets) turns margins into probabilities."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # dimensions, then the intercept, by label; a dimension's lie side by side
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def margins(self, text: str) -> np.ndarray:
        at, n = _codes(text)
        x = n * self.idf.take(at)
        return (x @ self.weights.take(at, axis=0) / (np.sqrt(x @ x) or 1.0)) + self.weights[-1]


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """A bounded number of bytes is handed to a worker at once; what the session says is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def blocks(df: DataFrame, labels: list[str], label: str, column: str) -> DataFrame:
    """A written table of blocks (labels, sizes, gaps between codes, counts): texts cut into terms once, a bounded number of terms a row.

    Gaps and counts are single bytes: a wider gap is filled with terms of
    count 0, and larger counts stand aside, with their places, in `large`.
    Both are compressed here, so that only what is stored passes the JVM.
    """
    ship(df.sparkSession)
    place = {name: i for i, name in enumerate(labels)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, entries = [], 0
        for batch in batches:
            for name, text in zip(*batch.columns):
                block.append((place[name.as_py()], *_codes(text.as_py())))
                entries += len(block[-1][1])
                if entries >= BLOCK:
                    yield packed(block)
                    block, entries = [], 0
        if block:
            yield packed(block)

    def packed(block: list) -> pa.RecordBatch:
        names, codes, counts = zip(*block)
        sizes, gaps, counts = np.array([len(c) for c in codes]), np.concatenate([np.diff(c, prepend=0) for c in codes]), np.concatenate(counts)
        filled = np.maximum(gaps - 1, 0) // 255
        if filled.any():
            at = np.cumsum(filled + 1) - 1
            steps, seen = np.full(at[-1] + 1, 255), np.zeros(at[-1] + 1, np.int64)
            steps[at], seen[at] = gaps - 255 * filled, counts
            sizes = sizes + np.bincount(np.repeat(np.arange(len(sizes)), sizes), filled, len(sizes)).astype(np.int64)
            gaps, counts = steps, seen
        large = np.flatnonzero(counts > 255)
        columns = {"labels": np.array(names, np.int32), "sizes": sizes.astype(np.int32), "gaps": gaps.astype(np.uint8), "counts": np.minimum(counts, 255).astype(np.uint8), "large": np.stack([large, counts[large]]).astype(np.int32)}
        return pa.record_batch({k: [pa.compress(v.tobytes(), "zstd", asbytes=True) if k in ("gaps", "counts") else v.tobytes()] for k, v in columns.items()})

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), F.coalesce(F.col(column), F.lit("")).alias("_text"))
    return written(rows.mapInArrow(cut, "labels binary, sizes binary, gaps binary, counts binary, large binary"), "blocks", **GROUP)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Labels, and codes and counts of each text, of some blocks at once."""
    truth, texts, entries = [], [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            names, sizes, gaps, counts, large = (x.as_buffer() for x in row)
            names, sizes, large = (np.frombuffer(x, np.int32) for x in (names, sizes, large))
            gaps, counts = (np.frombuffer(pa.decompress(x, int(sizes.sum()), "zstd"), np.uint8) for x in (gaps, counts))
            if len(large):
                at, n = large.reshape(2, -1)
                counts = counts.astype(np.int32)
                counts[at] = n
            truth.append(names)
            end = 0
            for size in sizes.tolist():
                start, end = end, end + size
                texts.append((np.cumsum(gaps[start:end], dtype=np.int64), counts[start:end]))
            entries += end
            if entries >= AT_ONCE:
                yield np.concatenate(truth), texts
                truth, texts, entries = [], [], 0
    if texts:
        yield np.concatenate(truth), texts


def _summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], cores: int) -> np.ndarray:
    """The sum of an array that `part` makes of each partition: one for each core, not for each file, is sent; of many cores they are added up on the way."""
    found = rows.coalesce(cores).mapInArrow(lambda batches: iter([pa.record_batch({"part": [part(batches).tobytes()]})]), "part binary")
    if cores > 32:
        return found.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
    return sum(np.frombuffer(r[0]) for r in found.collect())


def lexical(train: DataFrame, label: str, column: str = "text") -> Lexical:
    """Balanced linear SVM (squared hinge), one against the rest, over text vectors; see `applied`.

    Each step is one Spark pass over the blocks that adds up loss and slope
    of all labels at once; only sums of the model's size reach the driver,
    which takes the next step (L-BFGS). A text meets the weights of all
    labels by one product, and a label's slope reads only texts within its margin.
    """
    spark, size = train.sparkSession, 2 * WORDS + len(LENGTHS) * RUNS
    n = {r[0]: r[1] for r in train.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect()}  # a number a label
    names, total = sorted(n), sum(n.values())
    share = np.array([total / len(n) / n[name] for name in names])
    cores = spark.sparkContext.defaultParallelism

    def seen(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        found = np.zeros(size)
        for _, texts in _opened(batches):
            found += np.bincount(np.concatenate([codes[counts > 0] for codes, counts in texts]), minlength=size)
        return found

    def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
        now = spark.sparkContext.broadcast((idf, np.ascontiguousarray(weights)))  # a text's rows lie side by side

        def slope(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            idf, weights = now.value
            lost, out = 0.0, np.zeros(weights.T.shape)
            for truth, texts in _opened(batches):
                vectors, lengths, margins = [], np.ones(len(texts)), np.empty((len(texts), len(names)))
                for i, (codes, counts) in enumerate(texts):
                    x = idf.take(codes)
                    x *= counts
                    lengths[i] = np.sqrt(x @ x) or 1.0
                    margins[i] = x @ weights.take(codes, axis=0)
                    vectors.append(x)
                sign = np.where(truth[:, None] == np.arange(len(names)), 1.0, -1.0)
                short = np.maximum(0.0, 1 - sign * (margins / lengths[:, None] + weights[-1]))
                lost += share[truth] @ (short**2).sum(axis=1)
                push = -2 * share[truth][:, None] * sign * short
                out[:, -1] += push.sum(axis=0)
                push /= lengths[:, None]
                for k in range(len(names)):
                    some = np.flatnonzero(push[:, k])
                    if len(some):
                        out[k, :-1] += np.bincount(np.concatenate([texts[i][0] for i in some]), np.concatenate([vectors[i] * push[i, k] for i in some]), size)
            return np.append(out, lost)

        found = _summed(rows, slope, cores)
        now.unpersist()
        out, lost = found[:-1].reshape(len(names), size + 1).T, found[-1]
        return lost / total + 0.5 * float((weights**2).sum()) / total, out / total + weights / total

    with _small_batches(spark):
        rows = blocks(train, names, label, column)
        found = _summed(rows, seen, cores)
        idf = np.where(found >= 2, np.log((total + 1) / (found + 1)), 0.0)
        # noise of the order of sums must not decide between labels
        return Lexical(names, idf, np.ascontiguousarray(np.round(_descend(loss, np.zeros((size + 1, len(names)))), 9)))


def _descend(loss: Callable, at: np.ndarray) -> np.ndarray:
    """The least of a smooth convex function by L-BFGS, in at most STEPS steps."""
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            kept.append((s * way).sum() / (s * y).sum())
            way -= kept[-1] * y
        way *= (past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum() if past else 1.0
        for (s, y), k in zip(past, reversed(kept)):
            way += (k - (y * way).sum() / (s * y).sum()) * s
        step, down = 1.0, (slope * way).sum()
        while True:
            there = at - step * way
            found, next_slope = loss(there)
            if found <= value - 1e-4 * step * down or step < 1e-6:
                break
            step /= 4
        done = found > value - 1e-4 * value
        if found < value:
            s, y = there - at, next_slope - slope
            if (s * y).sum() > 0:
                past = [*past[1 - MEMORY :], (s, y)]
            at, value, slope = there, found, next_slope
        if done:
            break
    return at


def applied(model: Lexical, rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows with rawPrediction (margins by label), prediction (the place of the largest), by texts that never leave their batch."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def margins(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.margins(t) for t in texts])

    scored = rows.withColumn("rawPrediction", margins(F.coalesce(F.col(column), F.lit(""))))
    return scored.withColumn("prediction", (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double"))


def calibrated(model: Lexical, held_back: DataFrame, column: str = "text", label: str = "lang") -> Lexical:
    """The model with a logistic curve from its margins to probabilities, fitted on rows it wasn't trained on."""
    place = (F.array_position(F.array(*map(F.lit, model.labels)), F.col(label).cast("string")) - 1).cast("double")
    scored = applied(model, held_back, column).withColumn("_label", place).where("_label >= 0").select("_label", "rawPrediction")
    ready = written(scored, "margins").select("_label", array_to_vector("rawPrediction").alias("features"))
    curve = LogisticRegression(labelCol="_label", family="multinomial", maxIter=20).fit(ready)
    factors, offsets = np.zeros((len(model.labels),) * 2), np.full(len(model.labels), -np.inf)  # labels that weren't held back get 0
    factors[: curve.numClasses], offsets[: curve.numClasses] = curve.coefficientMatrix.toArray(), curve.interceptVector.toArray()
    return replace(model, curve=(factors, offsets))


def saved(model: Lexical, spark: SparkSession) -> Lexical:
    """Written to the shared folder and read back."""
    factors, offsets = model.curve if model.curve is not None else (np.zeros((0, 0)), np.zeros(0))
    weights = pd.DataFrame({"place": np.arange(len(model.weights)), "idf": [*model.idf, 0.0], "weights": model.weights.tolist()})
    labels = pd.DataFrame({"labels": [model.labels], "factors": [factors.ravel().tolist()], "offsets": [offsets.tolist()]})
    weights, labels = written(spark.createDataFrame(weights, "place long, idf double, weights array<double>"), "weights"), written(spark.createDataFrame(labels, "labels array<string>, factors array<double>, offsets array<double>"), "labels")
    rows, one = weights.orderBy("place").toPandas(), labels.first()
    curve = (np.array(one.factors).reshape(len(one.offsets), -1), np.array(one.offsets)) if one.offsets else None
    return Lexical(list(one.labels), rows["idf"].to_numpy()[:-1], np.stack(rows["weights"]), curve)


def probabilities(model: Lexical, rows: DataFrame) -> DataFrame:
    """Adds code, confidence and probabilities (in order of the label) by a calibrated model."""
    factors, offsets = model.curve
    odds = F.array(*(sum((F.lit(float(f)) * F.element_at("rawPrediction", i + 1) for i, f in enumerate(by)), F.lit(float(o))) for by, o in zip(factors, offsets)))
    scored = applied(model, rows).withColumn("_odds", odds)
    scored = scored.withColumn("_odds", F.transform("_odds", lambda x: F.exp(x - F.array_max("_odds"))))
    every = F.transform("_odds", lambda x: x / F.aggregate("_odds", F.lit(0.0), lambda s, y: s + y))
    scored = scored.withColumn("probabilities", every).withColumn("confidence", F.array_max("probabilities"))
    return scored.withColumn("code", F.element_at(F.array(*map(F.lit, model.labels)), F.array_position("probabilities", F.col("confidence")).cast("int"))).drop("_odds")


def out_of_fold(rows: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(item, fold, code, confidence, truth): rows (item, features, code) predicted by a model that hasn't seen their fold.

    Folds go by code and md5 of the item (labels.folds). The reference rows
    are in the training set of every fold.
    """
    from varve.operators.labels import folds

    dealt, out = written(folds(rows, "code", "item", k), "folds"), None
    for fold in range(k):
        train = dealt.where(F.col("fold") != fold).select("item", "features", "code").unionByName(reference.select("item", "features", "code"))
        found = _predict(forest(train, "code"), dealt.where(F.col("fold") == fold).withColumn("truth", F.col("code"))).select("item", "fold", "code", "confidence", "truth")
        out = found if out is None else out.unionByName(found)
    return out


def full_fit(rows: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(item, fold, code, confidence, truth) of all rows: labelled ones out of fold, those without a code by a model of all labels.

    fold is null where the model has seen every label.
    """
    labelled = rows.where("code IS NOT NULL")
    every = labelled.select("item", "features", "code").unionByName(reference.select("item", "features", "code"))
    rest = _predict(forest(written(every, "labels"), "code"), rows.where("code IS NULL"))
    rest = rest.select("item", F.lit(None).cast("long").alias("fold"), "code", "confidence", F.lit(None).cast("string").alias("truth"))
    known = out_of_fold(labelled, reference, k).withColumn("fold", F.col("fold").cast("long"))
    return known.unionByName(rest)


def category_cosines(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Items (item, vector) with `cosines`, their similarity to each category (code, vector), by code."""
    sims = evidence.cosine(items.select("item", "vector"), categories)
    by_code = F.transform(F.array_sort(F.collect_list(F.struct("code", "sim"))), lambda s: s["sim"])
    return items.join(sims.groupBy("item").agg(by_code.alias("cosines")), "item")


def forest(train: DataFrame, label: str, vector: str = "features", trees: int = 20) -> PipelineModel:
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, RandomForestClassifier(featuresCol=vector, labelCol="_label", numTrees=trees, maxDepth=6, seed=7)]).fit(train)


@dataclass(frozen=True)
class Boosted:
    """Members of an ensemble of boosted trees, one against the rest, and the codes of their classes."""

    members: list[OneVsRestModel]
    codes: list[str]


def boosted(train: DataFrame, label: str = "code", vector: str = "features", members: int = 3, rounds: int = 5, depth: int = 3, share: float = 0.7) -> Boosted:
    """Gradient boosting, one class against the rest; members see other samples of the rows (by seed), and so differ.

    Classes are few (a model each); those of one member are fitted side by side.
    """
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    ready = written(index.transform(train).select(F.col(vector).alias("features"), "_label"), "boosting")
    trees = [GBTClassifier(maxIter=rounds, maxDepth=depth, subsamplingRate=share, stepSize=0.3, seed=7 + k) for k in range(members)]
    return Boosted([OneVsRest(classifier=t, featuresCol="features", labelCol="_label", parallelism=8).fit(ready) for t in trees], list(index.labels))


def boosted_probabilities(model: Boosted, rows: DataFrame, vector: str = "features") -> DataFrame:
    """Adds probabilities (by code, adding up to 1), code, confidence and variance.

    A member's probability of a class is the logistic of twice its margin,
    divided by the sum over classes; the ensemble has the mean, and variance
    is that of the members' probabilities of the winner.
    """
    keep = [F.col(f"`{c}`") for c in rows.columns]
    scored, found = rows, []
    for k, member in enumerate(model.members):
        scored = member.copy().setFeaturesCol(vector).transform(scored)
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
        scored = written(scored.withColumn(f"_m{k}", F.transform(odds, lambda x: x / total)).drop("prediction", "rawPrediction"), "member")
        found.append(f"_m{k}")
    n = len(found)
    places = F.sequence(F.lit(1), F.lit(len(model.codes)))
    mean = F.transform(places, lambda i: sum((F.element_at(m, i) for m in found[1:]), F.element_at(found[0], i)) / n)
    scored = scored.withColumn("probabilities", mean).withColumn("confidence", F.array_max("probabilities"))
    scored = scored.withColumn("_at", F.array_position("probabilities", F.col("confidence")).cast("int"))
    spread = sum((F.pow(F.element_at(m, F.col("_at")) - F.col("confidence"), F.lit(2)) for m in found), F.lit(0.0)) / n
    return scored.select(*keep, F.element_at(F.array(*map(F.lit, model.codes)), F.col("_at")).alias("code"), "confidence", spread.alias("variance"), "probabilities")


def named(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Adds code and confidence of the most probable class."""
    labels = model.stages[0].labels
    return scored.withColumn("code", F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int"))).withColumn("confidence", F.array_max(vector_to_array("probability")))


def scaled(df: DataFrame, arrays: list[str], out: str = "features") -> DataFrame:
    """Arrays side by side, each dimension with unit deviation."""
    vectors = df.select("*", *(array_to_vector(F.col(a).cast("array<double>")).alias(f"_{a}_v") for a in arrays))
    stages = [VectorAssembler(inputCols=[f"_{a}_v" for a in arrays], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol=out, withMean=True)]
    return Pipeline(stages=stages).fit(vectors).transform(vectors)


def self_train(labelled: DataFrame, rest: DataFrame, rounds: int = 10, sure: float = 0.80) -> DataFrame:
    """(item, code, round): rows of `rest` that got a sure label, by round; each round trains on all so far.

    It ends with the first round that is sure of nothing new, or after `rounds`.
    """
    train, out = labelled.select("item", "features", "code"), None
    for k in range(rounds):
        left = rest if out is None else rest.join(out.select("item"), "item", "left_anti")
        found = _predict(forest(train, "code"), left)
        sure_rows = written(found.where(F.col("confidence") >= sure).select("item", "features", "code", F.lit(k).alias("round")), "selftrain")
        if sure_rows.isEmpty():
            break
        out = sure_rows if out is None else out.unionByName(sure_rows)
        train = train.unionByName(sure_rows.select("item", "features", "code"))
    return out.select("item", "code", "round") if out is not None else rest.select("item", F.lit("").alias("code"), F.lit(0).alias("round")).limit(0)


def _predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.stages[1].transform(rows.drop("code"))
    return named(model, scored)


def synthetic_columns(categories: DataFrame, variants: int, rows: int) -> DataFrame:
    """(code, column_name, opaque, row, value): half the names say what the column is, half don't.

    Everything follows from md5 of category, variant and row, so the table is
    the same on every run and made where it is used.
    """
    seed = F.md5(F.concat_ws("/", "code", "variant"))
    base = categories.select("code", "label", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant")).withColumn("seed", seed)
    word = F.lower(F.regexp_replace("label", "[^A-Za-z0-9]+", "_"))
    style = F.col("variant") % 4
    plain = F.when(style == 0, word).when(style == 2, F.upper(word)).otherwise(F.concat(F.lit("src_"), word))
    opaque = F.col("variant") % 2 == 1
    name = F.when(opaque, F.concat(F.lit("c"), F.substring("seed", 1, 6))).otherwise(F.concat(plain, F.lit("_"), F.col("variant")))
    wide = base.withColumn("opaque", opaque).withColumn("column_name", name).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    h = F.md5(F.concat_ws("/", "seed", "row"))
    kind = F.conv(F.substring(F.md5("code"), 1, 4), 16, 10).cast("int") % 4
    digits = F.conv(F.substring(h, 1, 7), 16, 10)
    value = F.when(kind == 0, F.concat(F.substring(h, 1, 8), F.lit("@example.org"))).when(kind == 1, digits).when(kind == 2, F.concat(F.lit("20"), F.lpad((digits.cast("long") % 30).cast("string"), 2, "0"), F.lit("-01-02"))).otherwise(h)
    return wide.select("code", "column_name", "opaque", "row", value.alias("value"))
