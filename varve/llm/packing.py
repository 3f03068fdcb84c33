"""Packing tokenised documents into sequences by swap-based local search.

Pieces are dealt at random to groups of about `group_pieces`, so that a task
holds a bounded number of them whatever the input, and a group wastes at most
a part of its last sequence. In a group, pieces are placed by best fit, the
longest first; then local search empties the least full bins: a document moves
to a bin with room, or is exchanged for a shorter one, or for two shorter
ones, of a fuller bin. Every step increases the sum of squared fills, so the
search ends; it also ends when no fewer bins are possible.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import ship, slices, with_text, written
from varve.llm.text import buffers, word_blocks

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 20_000
#: Words of one generation of those whose ids a worker remembers; two are kept.
GENERATION = 150_000
#: Words that go through the tokenizer together.
TOGETHER = 200

#: Bytes of text whose words are looked up at once.
BLOCK = 1 << 20

_odd_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]")
_letters = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
_stop = np.zeros(256, dtype=bool)
_stop[list(b".,;:!?")] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_small = np.zeros(256, dtype=bool)
_small[97:123] = True
_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(block: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block: their bytes one after the other, n + 1 offsets, and their first bytes' places.

    In words of Latin-1 letters and ASCII, letter case goes and the stops after
    a letter at the end become a word of their own: the tokenizer drops case,
    and never joins letters and stops.
    """
    start = np.flatnonzero(first)
    here = np.arange(len(block), dtype=np.int32 if len(block) < 1 << 31 else np.int64)
    # inside a text there is a separator, between texts there needn't be one
    stop = np.minimum(np.append(start[1:], len(block)), np.minimum.accumulate(np.where(inside, here.dtype.type(len(block)), here)[::-1])[::-1][start])
    low, second = _lower[block], np.zeros(len(block), dtype=bool)
    second[1:] = block[:-1] == 0xC3
    low[second & (block <= 0x9E) & (block != 0x97)] += 32
    wide = np.zeros(len(start), dtype=bool)
    if (block >= 0xC4).any():
        count = np.concatenate([[0], np.cumsum(block >= 0xC4, dtype=here.dtype)])
        wide = count[stop] > count[start]
        word = np.cumsum(first, dtype=here.dtype) - 1
        low = np.where(inside & wide[np.maximum(word, 0)], block, low)
    letter = _small[low] | second & (low >= 0xA0) & (low != 0xB7) | second & (low == 0x9F)
    last = np.maximum.accumulate(np.where(_stop[block], here.dtype.type(-1), here))[stop - 1]
    split = ~wide & (last >= start) & (last < stop - 1) & letter[last]
    start = np.sort(np.concatenate([start, last[split] + 1]))
    ends = np.sort(np.concatenate([stop, last[split] + 1]))
    return low[inside], np.concatenate([[0], np.cumsum(ends - start)]), start


class Encoder:
    """Ids of whole texts.

    The tokenizer drops white space and never joins over it, so each word is
    encoded once and remembered; words of a block are told apart by Arrow.
    New words of letters only go through the tokenizer together, since each
    ends with the one token that has the mark of a word's end. Texts with
    unusual spaces go through whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(made.ids, dtype="<u4") for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain, other = [], []
        for w in words:
            (plain if _letters.fullmatch(w) else other).append(w)
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group):
                other += group
                continue
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.memo.update(zip(group, (data[a:b] for a, b in zip(at, at[1:]))))
        self.memo.update(zip(other, (ids.tobytes() for ids in self._whole(other))))

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.memo) > GENERATION:
            # words that come up again move over, so common ones are never lost
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, words))
        if missing := [w for w, ids in zip(words, found) if ids is None]:
            again = list(map(self.older.get, missing))
            self.memo.update((w, ids) for w, ids in zip(missing, again) if ids is not None)
            self._learn([w for w, ids in zip(missing, again) if ids is None])
            found = list(map(self.memo.get, words))
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, little-endian."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        listed = texts.to_pylist()
        odd = [i for i, t in enumerate(listed) if _odd_space.search(t)]
        whole = self._whole([listed[i] for i in odd])
        for i in odd:
            listed[i] = ""
        raw, ends = buffers(pa.array(listed, pa.string()) if odd else texts)
        ids, places, counts = [], [], []
        for start, stop, inside, first in word_blocks(raw, ends, BLOCK):
            if not first.any():
                continue
            data, at, place = _cut(raw[start:stop], inside, first)
            words = pa.StringArray.from_buffers(len(place), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
            known = self._known(words.dictionary.to_pylist())
            which = words.indices.to_numpy()
            size = np.array([len(x) // 4 for x in known], dtype=np.int64)
            begin = (np.cumsum(size) - size)[which]
            count = size[which]
            shift = np.repeat(begin - (np.cumsum(count) - count), count)
            ids.append(np.frombuffer(b"".join(known), dtype="<u4")[shift + np.arange(len(shift))])
            places.append(place + start)
            counts.append(count)
        if not ids:
            out = [b""] * len(listed)
        else:
            total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            cut = total[np.searchsorted(np.concatenate(places), ends, "left")]
            flat = np.concatenate(ids)
            out = [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        for i, own in zip(odd, whole):
            out[i] = own.tobytes()
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of all documents.

    A document is its ids and END_ID; only longer ones are cut, at CAPACITY.
    A null or empty text is END_ID alone.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=BLOCK):
            made = encoder(path).encode(batch.column("text"))
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(made):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * CAPACITY)):
                    part = data[at : at + 4 * CAPACITY]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if keep_ids else None)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = with_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return texts.mapInArrow(cut, schema)


class Bins:
    """Bins of one group; items of a bin are (length, index), ascending."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.free: list[int] = []
        self.by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0  # bit f: some bin has f free

    def _place(self, b: int, free: int) -> None:
        old = self.free[b]
        self.by_free[old].discard(b)
        if not self.by_free[old]:
            self.mask &= ~(1 << old)
        self.free[b] = free
        self.by_free[free].add(b)
        self.mask |= 1 << free

    def best(self, length: int, but: int = -1) -> int | None:
        """The fullest bin that is not `but` and has room."""
        mask = self.mask >> length
        while mask:
            low = (mask & -mask).bit_length() - 1
            for b in self.by_free[length + low]:
                if b != but and self.items[b]:
                    return b
            mask &= mask - 1
        return None

    def add(self, item: tuple[int, int]) -> None:
        b = self.best(item[0])
        if b is None:
            b = len(self.items)
            self.items.append([])
            self.free.append(self.capacity)
            self.by_free[self.capacity].add(b)
            self.mask |= 1 << self.capacity
        self.put(b, item)

    def put(self, b: int, item: tuple[int, int]) -> None:
        insort(self.items[b], item)
        self._place(b, self.free[b] - item[0])

    def take(self, b: int, item: tuple[int, int]) -> None:
        del self.items[b][bisect_left(self.items[b], item)]
        self._place(b, self.free[b] + item[0])

    def step(self, a: int) -> bool:
        """One move or exchange that shrinks bin a in favour of a fuller bin."""
        best: tuple[int, int, tuple, tuple] | None = None
        for item in reversed(self.items[a]):
            b = self.best(item[0], but=a)
            # the fullest bin with room: if the squared fill doesn't grow there, it grows nowhere
            if b is not None and self.free[b] - item[0] < self.free[a]:
                self.take(a, item)
                self.put(b, item)
                return True
        fill = self.free[a]
        for item in reversed(self.items[a]):
            for b, room in enumerate(self.free):
                if not room or b == a or room > fill or not self.items[b]:
                    continue
                own, low = self.items[b], item[0] - room
                i = bisect_left(own, (low, -1))
                if i < len(own) and own[i][0] < item[0] and (best is None or item[0] - own[i][0] > best[0]):
                    best = (item[0] - own[i][0], b, item, (own[i],))
                    if best[0] == room:
                        break
                j, k = 0, len(own) - 1  # two for one: the smallest sum from low on
                while j < k:
                    both = own[j][0] + own[k][0]
                    if both < low:
                        j += 1
                    else:
                        if both < item[0] and (best is None or item[0] - both > best[0]):
                            best = (item[0] - both, b, item, (own[j], own[k]))
                        k -= 1
            if best is not None:
                break
        if best is None:
            return False
        _, b, item, others = best
        self.take(a, item)
        for other in others:
            self.take(b, other)
        self.put(b, item)
        for other in others:
            self.put(a, other)
        return True


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    Underfull bins are tried to be emptied, the emptiest first, until a pass
    over all of them empties none or no fewer bins are possible. Each step
    makes the sum of squared fills grow, so every try ends.
    """
    bins = Bins(capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins.add((int(lengths[i]), int(i)))
    least = -(-int(lengths.sum()) // capacity)
    used, emptied = len(bins.items), True
    while used > least and emptied:
        emptied = False
        for a in sorted((b for b, own in enumerate(bins.items) if own and bins.free[b]), key=lambda b: -bins.free[b]):
            while bins.items[a] and bins.step(a):
                pass
            if not bins.items[a]:
                used, emptied = used - 1, True
                if used == least:
                    break
    where, offset, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for own in bins.items:
        at = 0
        for length, i in reversed(own):
            where[i], offset[i] = number, at
            at += length
        number += bool(own)
    return where, offset


def packed(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; sequences hold CAPACITY ids at most.

    Repeated rows and null ids are packed like others, each row for itself.
    An empty table gives an empty result. Further columns are not looked at.
    """
    table = written(pieces(docs, tokenizer, id_col, text_col, keep_ids), "pieces")
    groups = max(1, -(-table.count() // group_pieces))
    # ids of rows of a written table: the same again if a task is repeated
    numbered = table.withColumn("number", F.monotonically_increasing_id())
    dealt = numbered.select("number", "length", F.pmod(F.xxhash64("number"), F.lit(groups)).alias("group")) if keep_ids else numbered.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
    most = 1 << 32

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        where, offset = pack(group["length"].to_numpy())
        return group.assign(sequence_id=group["group"] * most + where, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    placed = dealt.groupBy("group").applyInPandas(place, schema).drop("group")
    if keep_ids:
        placed = numbered.join(placed.drop("length"), "number")
    return placed.drop("number")
