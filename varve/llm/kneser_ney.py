"""Interpolated modified Kneser-Ney bigram model, counted in Spark, mapped by workers.

Counting: tasks turn whole texts into (context, token) hash pairs, sum equal
pairs and deal them out by the top bits of the context's hash, one row of
packed arrays for each part. A context with a part's worth of tokens or more
is found beforehand and dealt out in pieces by a salt from the pair's hash, so
no part holds much more than its share, however skewed the text is. A part
sums its pairs; what it knows of a context (total, how many successors occur
once, twice or more often) and how many contexts a token follows are partial
sums that are dealt out again by the word's hash and added up.

The model lies in the shared folder as sorted arrays of 64-bit hashes beside
arrays of values. Workers map the files and look up the sorted distinct
tokens and pairs of a slice of texts, so access goes through a file in order.
Only the sums that fix the discounts go through the driver.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import mounted, publish, shared_folder, ship, slices, with_text, written
from varve.llm.text import mix, word_hashes

FOLDS, HELD_OUT = 10, 0
#: Text for each part of the model.
PART_BYTES = 16 << 20
#: Pairs that a task sums up before it hands them on.
TASK_PAIRS = 3_000_000
SLICE_BYTES = 4 << 20
#: Parts whose frequent contexts share a file: at most twice as many words, 2 MB.
HOT_PARTS = 1 << 16

_U = np.uint64
START, END = mix(np.array([11, 13], dtype=np.uint64))
_WORD = np.dtype([("total", "<i8"), ("once", "<u4"), ("twice", "<u4"), ("more", "<u4"), ("contexts", "<u4")])
_PACKED = "part int, word binary, run binary, next binary, n binary"
_MERGED = "part int, word binary, total binary, once binary, twice binary, more binary, next binary, contexts binary, c1 long, c2 long, c3 long, c4 long"
_SUMS = "tokens long, words long, pairs long, " + ", ".join(f"{k}{i} long" for k in "cu" for i in range(1, 5))


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text (null: empty), modulo FOLDS."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, offsets by text); a text's tokens are its words and END."""
    words, offsets = word_hashes(texts)
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(offsets))
    token, context = np.empty(at[-1], np.uint64), np.empty(at[-1], np.uint64)
    token[place], token[at[1:] - 1] = words, END
    context[place + 1], context[at[:-1]] = words, START
    return context, token, at


def _part(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


@cache
def _hot_file(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    try:
        return tuple(np.load(f"{path}.{kind}.npy", mmap_mode="r") for kind in ("word", "mask"))
    except FileNotFoundError:
        return None


@dataclass(frozen=True)
class Hot:
    """Frequent contexts; each is dealt out in mask + 1 pieces, a power of two.

    Their sorted hashes lie in 2 ** bits files in the shared folder, by the
    top bits, which workers map: the list grows with the parts, so it goes
    neither through the driver nor with each task.
    """

    place: str | None = None
    bits: int = 0

    def mask(self, context: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context), np.uint64)
        if self.place is None:
            return out
        file = _part(context, self.bits)
        for i in np.unique(file) if self.bits else [0]:
            if (found := _hot_file(f"{self.place}/hot-{i}")) is not None:
                own = np.flatnonzero(file == i) if self.bits else slice(None)
                words, masks = found
                at = np.minimum(np.searchsorted(words, context[own]), len(words) - 1)
                out[own] = np.where(words[at] == context[own], masks[at], _U(0))
        return out


COLD = Hot()


def _spans(words: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes."""
    part = _part(words, bits)
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    return [(int(part[a]), a, b) for a, b in zip(cut[:-1], cut[1:])]


def pair_key(context: np.ndarray, token: np.ndarray, bits: int, hot: Hot = COLD) -> np.ndarray:
    """64 bits for a pair; the top bits are the part: the context's, or for a hot one those of a piece."""
    key = mix(context * _U(0x9E3779B97F4A7C15) + token)
    if not bits:
        return key
    mask = hot.mask(context)
    top = np.where(mask > 0, mix(context + (key & mask)), context)
    return (top >> _U(64 - bits) << _U(64 - bits)) | (key >> _U(bits))


def _summed(context: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts."""
    order = np.lexsort((token, context))
    context, token, n = context[order], token[order], n[order]
    first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (token[1:] != token[:-1])])
    return context[first], token[first], np.add.reduceat(n, first)


def _pack(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _unpack(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in column.to_pylist() if x is not None] or [np.empty(0, kind)])


def _save(path: str, values: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, values)
    publish(path, out.getvalue())


def _frequent(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of contexts with half a part's share of a block's tokens or more; for null, all tokens."""
    held: list[np.ndarray] = []
    size = 0

    def rows() -> pa.RecordBatch:
        context = np.concatenate(held)
        least = len(context) / (2 * parts)
        bucket = (context >> _U(48)).astype(np.int64)
        full = np.bincount(bucket, minlength=1 << 16) >= least
        word, n = np.unique(context[full[bucket]], return_counts=True)
        word, n = word[n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays([pa.array([None, *word.view(np.int64).tolist()], pa.int64()), pa.array([len(context), *n.tolist()], pa.int64())], names=["word", "n"])

    for batch in slices(batches, most=SLICE_BYTES):
        held.append(token_pairs(batch.column("text"))[0])
        size += len(held[-1])
        if size >= TASK_PAIRS:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _hot(texts: DataFrame, bits: int, place: str) -> Hot:
    """All contexts with a part's share of the tokens or more, written to files of some HOT_PARTS parts each.

    A block leaves out less than half a part's share of its tokens for each
    word, so such a context keeps half a share in the sum; no more than twice
    as many words as there are parts can have that.
    """
    if not bits:
        return COLD
    parts, file_bits = 1 << bits, max(0, bits - HOT_PARTS.bit_length() + 1)
    counts = texts.select("text").mapInArrow(lambda batches: _frequent(batches, parts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "contexts")
    total = (counts.where("word IS NULL").first() or [0, 0])[1]

    def save(group: pa.Table) -> pa.Table:
        words, n = group["word"].to_numpy().view(np.uint64), group["n"].to_numpy()
        order = np.argsort(words)
        share = np.ceil(np.log2(n[order] * 2 * parts / total)).astype(np.uint64)
        path = f"{place}/hot-{group['file'][0].as_py()}"
        _save(f"{path}.mask.npy", (_U(2) << share) - _U(1))
        _save(f"{path}.word.npy", words[order])
        return pa.table({"words": pa.array([len(words)], pa.int64())})

    hot = counts.where(F.col("word").isNotNull() & (F.col("n") * 2 * parts >= total))
    file = F.shiftrightunsigned("word", 64 - file_bits).cast("int") if file_bits else F.lit(0)
    hot.withColumn("file", file).groupBy("file").applyInArrow(save, "words long").agg(F.sum("words")).collect()
    return Hot(place, file_bits)


def _count(batches: Iterator[pa.RecordBatch], bits: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def rows() -> pa.RecordBatch:
        context, token = (np.concatenate(x) for x in zip(*held))
        context, token, n = _summed(context, token, np.ones(len(context), np.int64))
        part = _part(pair_key(context, token, bits, hot), bits)
        order = np.argsort(part.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
        context, token, n, part = context[order], token[order], n[order], part[order]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (part[1:] != part[:-1])])
        run = np.diff(np.r_[first, len(context)])
        part = part[first]
        cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        pair_cut = np.r_[first, len(context)][cut]
        spans = list(zip(cut[:-1], cut[1:], pair_cut[:-1], pair_cut[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[cut[:-1]], pa.int32()),
                pa.array([_pack(context[first[a:b]], "<u8") for a, b, _, _ in spans]),
                pa.array([_pack(run[a:b], "<u4") for a, b, _, _ in spans]),
                pa.array([_pack(token[c:d], "<u8") for _, _, c, d in spans]),
                pa.array([_pack(n[c:d], "<u4") for _, _, c, d in spans]),
            ],
            names=["part", "word", "run", "next", "n"],
        )

    for batch in slices(batches, most=SLICE_BYTES):
        context, token, _ = token_pairs(batch.column("text"))
        held.append((context, token))
        size += len(context)
        if size >= TASK_PAIRS:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _merge_pairs(group: pa.Table, place: str, bits: int, hot: Hot) -> pa.Table:
    part = group["part"][0].as_py()
    context = np.repeat(_unpack(group["word"], "<u8"), _unpack(group["run"], "<u4"))
    context, token, n = _summed(context, _unpack(group["next"], "<u8"), _unpack(group["n"], "<u4").astype(np.int64))
    key = pair_key(context, token, bits, hot)
    order = np.argsort(key)
    _save(f"{place}/pairs-{part}.key.npy", key[order])
    _save(f"{place}/pairs-{part}.n.npy", n[order].astype("<u4"))
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    own = {k: np.add.reduceat(x, first, dtype=np.int64) for k, x in (("total", n), ("once", n == 1), ("twice", n == 2), ("more", n > 2))}
    word = context[first]
    rows = [{"part": part, **{f"c{i}": int((n == i).sum()) for i in range(1, 5)}}]
    rows += [{"part": i, "word": _pack(word[a:b], "<u8"), "total": _pack(own["total"][a:b], "<i8"), **{k: _pack(own[k][a:b], "<u4") for k in ("once", "twice", "more")}} for i, a, b in _spans(word, bits)]
    follows, contexts = np.unique(token, return_counts=True)
    rows += [{"part": i, "next": _pack(follows[a:b], "<u8"), "contexts": _pack(contexts[a:b], "<u4")} for i, a, b in _spans(follows, bits)]
    return pa.Table.from_pylist(rows, schema=_arrow(_MERGED))


def _merge_words(group: pa.Table, place: str) -> pa.Table:
    part = group["part"][0].as_py()
    word, follows = _unpack(group["word"], "<u8"), _unpack(group["next"], "<u8")
    key = np.unique(np.concatenate([word, follows]))
    value = np.zeros(len(key), dtype=_WORD)
    at = np.searchsorted(key, word)
    np.add.at(value["total"], at, _unpack(group["total"], "<i8"))
    for name in ("once", "twice", "more"):
        np.add.at(value[name], at, _unpack(group[name], "<u4"))
    np.add.at(value["contexts"], np.searchsorted(key, follows), _unpack(group["contexts"], "<u4"))
    _save(f"{place}/words-{part}.key.npy", key)
    _save(f"{place}/words-{part}.value.npy", value)
    # START stands for END among contexts: it occurs once in each text as well
    sums = {"tokens": int(value["total"].sum()), "words": int((value["total"] > 0).sum()), "pairs": int(value["contexts"].sum())}
    sums |= {f"c{i}": sum(x or 0 for x in group[f"c{i}"].to_pylist()) for i in range(1, 5)}
    sums |= {f"u{i}": int((value["contexts"] == i).sum()) for i in range(1, 5)}
    return pa.Table.from_pylist([sums], schema=_arrow(_SUMS))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts (Chen and Goodman, 1998); plain ones where these are degenerate."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d <= i else i / 2 for i, d in enumerate(found, 1))


class Arrays:
    """The parts of one table of the model, mapped when first asked for."""

    def __init__(self, place: str, name: str, value: str, parts: int) -> None:
        self.paths = [(f"{place}/{name}-{i}.key.npy", f"{place}/{name}-{i}.{value}.npy") for i in range(parts)]
        self.bits = parts.bit_length() - 1
        self.open: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray] | None:
        if i not in self.open:
            try:
                self.open[i] = tuple(np.load(p, mmap_mode="r") for p in self.paths[i])
            except FileNotFoundError:  # no training text came to this part
                self.open[i] = None
        return self.open[i]

    def find(self, keys: np.ndarray, kind: np.dtype) -> np.ndarray:
        """Values of sorted keys, zero where there is none."""
        out = np.zeros(len(keys), dtype=kind)
        part = _part(keys, self.bits)
        cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(keys) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if (found := self.part(int(part[a]))) is None or not len(found[0]):
                continue
            key, value = found
            at = np.minimum(np.searchsorted(key, keys[a:b]), len(key) - 1)
            hit = key[at] == keys[a:b]
            out[a:b][hit] = value[at[hit]]
        return out


@dataclass(frozen=True)
class KneserNey:
    """Where the arrays lie, and the sums; goes with each task."""

    place: str
    parts: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float
    hot: Hot

    def score(self, texts: pa.Array, arrays: tuple[Arrays, Arrays]) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base, model) of each text, log10."""
        context, token, at = token_pairs(texts)
        if not len(token):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        unique, where = np.unique(np.concatenate([token, context]), return_inverse=True)
        entry = arrays[0].find(unique, _WORD)
        # END is counted through START, see _merge_words
        start = arrays[0].find(np.array([START]), _WORD)[0]
        count = np.where(unique == END, start["total"], entry["total"])
        count = np.where(unique == START, 0, count)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        d = self.word_discounts
        follows = entry["contexts"].astype(float)
        lower = np.maximum(follows - np.array([0, *d])[np.minimum(entry["contexts"], 3).astype(int)], 0) / max(1, self.pairs) + self.word_rest / (self.words + 1)
        d = self.pair_discounts
        rest = np.where(entry["total"] > 0, (d[0] * entry["once"] + d[1] * entry["twice"] + d[2] * entry["more"]) / np.maximum(entry["total"], 1), 1.0)
        token_at, context_at = where[: len(token)], where[len(token) :]
        keys, pair_at = np.unique(pair_key(context, token, arrays[1].bits, self.hot), return_inverse=True)
        n = arrays[1].find(keys, np.dtype("<u4"))[pair_at].astype(np.int64)
        higher = np.maximum(n - np.array([0, *d])[np.minimum(n, 3)], 0) / np.maximum(entry["total"][context_at], 1)
        model = np.log10(higher + rest[context_at] * lower[token_at])
        known = (count > 0)[token_at]
        return (np.diff(at), *(np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base[token_at], model)))

    def arrays(self) -> tuple[Arrays, Arrays]:
        return Arrays(self.place, "words", "value", self.parts), Arrays(self.place, "pairs", "n", self.parts)


def fit(texts: DataFrame) -> KneserNey:
    """Train on all rows of (text). No rows give the uniform model over one unknown word."""
    spark = texts.sparkSession
    ship(spark)
    place = mounted(shared_folder(spark, "ngrams"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(0, math.ceil(math.log2(max(1, size / PART_BYTES)))))
    hot = _hot(texts, bits, place)
    pairs = texts.select("text").mapInArrow(lambda batches: _count(batches, bits, hot), _PACKED)
    merged = pairs.groupBy("part").applyInArrow(lambda group: _merge_pairs(group, place, bits, hot), _MERGED)
    sums = merged.groupBy("part").applyInArrow(lambda group: _merge_words(group, place), _SUMS)
    total = sums.agg(*(F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) for f in sums.schema)).first()
    pair_discounts, word_discounts = (discounts(*(total[f"{k}{i}"] for i in range(1, 5))) for k in "cu")
    more = total["words"] - total["u1"] - total["u2"]
    rest = (word_discounts[0] * total["u1"] + word_discounts[1] * total["u2"] + word_discounts[2] * more) / total["pairs"] if total["pairs"] else 1.0
    return KneserNey(place, 1 << bits, total["tokens"], total["words"], total["pairs"], pair_discounts, word_discounts, rest, hot)


def scored(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row."""
    texts = with_text(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.arrays()
        for batch in slices(batches, most=SLICE_BYTES):
            n, known, base, score = model.score(batch.column("text"), arrays)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(rows, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(score: F.Column, n_tokens: F.Column) -> F.Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All texts under the model of those whose crc32(id) mod 10 is not 0.

    Null and empty texts are one END token. A null id counts as the empty
    text, crc32 0, and so is held out. Repeated rows count each time.
    """
    texts = with_text(docs, id_col, text_col)
    model = fit(texts.where(fold() != HELD_OUT))
    out = scored(texts, model).withColumn("held_out", fold() == HELD_OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))

