"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

SuperMinHash (Ertl, 2017) gives every element of a set its own permutation of
the signature's slots; the element offers slot p(j) the value j + r with r in
[0, 1). Here the levels j run in lockstep over all elements of a batch: a slot
filled on one level can't be improved by a later one, so a document stops as
soon as all its slots are filled. A document of n shingles needs about
m * H(m) / n levels instead of m hash functions.

From signatures to groups:

1. exact copies (equal shingle sets) become one node, named by the smallest doc_id;
2. bands of four slots; with 48 bands a pair at similarity 0.75 shares none
   with a probability of about 1e-8;
3. in each bucket every member is compared with one hub, the member whose
   buckets are the largest (the original of a family of edited copies);
   confirmed links are joined to components; where the next step would make
   more pairs than rows, buckets that still hold several components do the
   same with a hub of another component, some rounds;
4. in buckets that are still mixed, two members x and y share at most
   min(|x & h|, |y & h|) shingles of their hub h, and beyond that only what
   both have outside of h. So nearly all pairs have to share a shingle outside
   of h, and are found by a join on such shingles, of which those that are
   least frequent are enough (prefix filter). Pairs whose hub alone could hold
   enough (both are mostly parts of it) meet in their bucket if their
   signatures agree closely enough (0.6; a pair at 0.75 misses that with a
   probability below 1e-6). All are confirmed.

Links are confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import ship, slices, with_text, written
from varve.llm.components import connected_components
from varve.llm.text import distinct_by_row, mix, shingles, word_hashes

BANDS, ROWS = 48, 4
SLOTS = BANDS * ROWS
#: Agreement of signatures below which a pair of the last step isn't confirmed.
LEAST_AGREEMENT = 0.6
#: So many further rounds of hubs are made, each only where the last step would make more pairs than that times the rows.
MORE_HUBS, PAIRS_A_ROW = 2, 4

_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max
#: (elements, row of each, rows, slots) -> rows x slots
Signer = Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]
_SET = "doc_id long, md5 string, n_shingles long, k1 long, k2 long, signature array<int>"
#: Of ids with several sets, all but one get node numbers from here on.
_EXTRA = 1 << 62


def superminhash(elements: np.ndarray, row: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots, 64 bits: level, then 32 random bits).

    `row` names the set of each element, in ascending order. An empty set
    keeps the largest value in all slots.
    """
    out = np.full((rows, slots), _EMPTY, dtype=np.uint64)
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    for level in range(slots):
        if not len(elements):
            break
        random = mix(elements + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = (level + (((random & _U(0xFFFFFFFF)) * _U(slots - level)) >> _U(32))).astype(np.int64)
        at = np.arange(len(elements))
        slot = order[at, pick]
        order[at, pick] = order[:, level]
        np.minimum.at(out, (row, slot), (_U(level) << _U(32)) | (random >> _U(32)))
        open_rows = (out == _EMPTY).any(axis=1)
        going = open_rows[row]
        if not going.all():
            elements, row, order = elements[going], row[going], order[going]
    return out


def keys_of(values: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """128 bits of each sorted set, in two columns."""
    digest = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
    keys = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
    return [pa.array(keys[:, 0]), pa.array(keys[:, 1])]


def _sets(batches: Iterator[pa.RecordBatch], signer: Signer) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 18):
        values, at = distinct_by_row(*shingles(*word_hashes(batch.column("text"))))
        n = np.diff(at)
        signature = signer(values, np.repeat(np.arange(len(n)), n), len(n), SLOTS)
        short = mix(signature).astype(np.uint32).view(np.int32)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * SLOTS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("md5"), pa.array(n), *keys_of(values, at), pa.ListArray.from_arrays(offsets, pa.array(short.ravel()))],
            names=["doc_id", "md5", "n_shingles", "k1", "k2", "signature"],
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 19):
        values, at = distinct_by_row(*shingles(*word_hashes(batch.column("text"))))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*keys_of(values, at), lists], names=["k1", "k2", "members"])


def _compared(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of intersection and union of their full sets."""
    left = members.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    right = members.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b")
    found = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), both.alias("both"))
    return found.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("joined"))


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("shared") >= percent * F.col("joined")).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _similar_sizes(a: str, b: str, percent: int) -> F.Column:
    """Sets of too different sizes can't be similar enough (exact)."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of nodes with the component of each; a node without links is its own."""
    return rows.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components, with the component of the hub as `home`."""
    home = F.max(F.when(F.col("node") == F.col("hub"), F.col("component")))
    found = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), home.alias("home"))
    # a bucket of two has been decided by its hub
    return rows.join(found.where("low < high AND size > 2").select("bucket", "home"), "bucket")


def _attached(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(hub, node, n, component, inside, narrow, most, outside) of the nodes of rows (bucket, node, n, component, hub).

    inside: how many shingles a node shares with its hub; outside: its other
    ones. A pair has to share I = percent * (|x| + |y|) / (100 + percent)
    shingles. narrow: the node shares less than I with its hub, so they aren't
    linked; of nodes in different components one is narrow. most: a partner
    that shares I within the hub has at most that many shingles.
    """
    both = 100 + percent
    pairs = rows.select("node", "n", "component", "hub").distinct().where("node <> hub")
    own = members.select("node", F.col("members").alias("of_node"))
    hub = members.select(F.col("node").alias("hub"), F.col("members").alias("of_hub"))
    inside, outside = F.size(F.array_intersect("of_node", "of_hub")), F.array_except("of_node", "of_hub")
    found = pairs.join(own, "node").join(hub, "hub").select("hub", "node", "n", "component", inside.alias("inside"), F.size("of_hub").alias("hub_n"), outside.alias("outside"))
    narrow = both * F.col("inside") < percent * (F.col("n") + F.col("hub_n"))
    most = F.floor(both * F.col("inside") / percent + 1e-9) - F.col("n")
    return written(found.withColumn("narrow", narrow).withColumn("most", most).drop("hub_n"), "attached")


def _outside(attached: DataFrame, percent: int) -> DataFrame:
    """(hub, node, ..., shingle): the shingles outside of the hub by which a node has to meet its partners."""
    both = 100 + percent
    out = attached.select("hub", "node", "component", "narrow", F.explode("outside").alias("shingle"))
    spread = out.groupBy("hub", "shingle").agg(F.count("*").alias("nodes"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("narrow").alias("some"))
    spread = spread.where("low < high AND some").select("hub", "shingle", "nodes")
    shared = out.join(spread, ["hub", "shingle"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("nodes", "shingle"))).alias("shared"))
    shared = attached.drop("outside", "most").join(shared, ["hub", "node"]).withColumn("m", F.size("shared"))
    # no partner is smaller than the smallest one here, nor than percent of the node
    smallest = shared.groupBy("hub").agg(F.min("n").alias("smallest"))
    partner = F.greatest(100 * F.col("smallest"), percent * F.col("n"))
    least = F.ceil((100 * F.col("n") + partner) * percent / (100 * both) - 1e-9) - F.col("inside")
    ready = shared.join(smallest, "hub").withColumn("least", F.greatest(least, F.lit(1)).cast("int")).where("m >= least")
    first = F.slice("shared", F.lit(1), F.col("m") - F.col("least") + 1)
    ready = ready.select("hub", "node", "n", "component", "inside", "narrow", "m", F.explode(first).alias("of")).withColumn("shingle", F.col("of.shingle"))
    return written(ready.drop("of"), "outside")


def _met_outside(ready: DataFrame, percent: int) -> DataFrame:
    x, y = ready.where("narrow").alias("x"), ready.alias("y")
    met = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
    enough = (100 + percent) * (F.least("x.inside", "y.inside") + F.least("x.m", "y.m")) >= percent * (F.col("x.n") + F.col("y.n"))
    return x.join(y, met & _similar_sizes("x.n", "y.n", percent) & enough).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _inside(rows: DataFrame, attached: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, ...): the nodes that could share enough with another one within their hub.

    wide: its partners' sizes let it be the other node of a narrow one.
    """
    rows = rows.select("bucket", "node", "n", "component", "hub").join(attached.drop("outside", "n", "component"), ["hub", "node"])
    limits = rows.groupBy("bucket").agg(F.min("n").alias("smallest"), F.max(F.when(F.col("narrow"), F.col("most"))).alias("largest"))
    rows = rows.join(limits, "bucket").withColumn("narrow", F.col("narrow") & (F.col("most") >= F.col("smallest"))).withColumn("wide", F.col("n") <= F.col("largest"))
    rows = rows.where("narrow OR wide").drop("smallest", "largest")
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("narrow").alias("one"), F.max("wide").alias("other"))
    return written(rows.join(several.where("low < high AND one AND other").select("bucket"), "bucket", "left_semi"), "inside")


def _met_inside(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    own = rows.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    rows = rows.join(own, "node").join(nodes.select("node", "signature"), "node")
    agree = F.aggregate(F.zip_with("x.signature", "y.signature", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    x, y = rows.where("narrow").alias("x"), rows.where("wide").alias("y")
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & _similar_sizes("x.n", "y.n", percent)
    enough = (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    first = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")
    return x.join(y, met & enough & first & (agree >= LEAST_AGREEMENT * SLOTS)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _beyond_hubs(rows: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """What pairs of different components with a bucket in common are made of, and how many there may be.

    At most min(inside) shingles that a pair shares lie in its hub. So either
    that is enough by itself, or both share the rest outside of it (exact).
    """
    attached = _attached(rows, members, percent)
    outer, inner = _outside(attached, percent), _inside(rows, attached, percent)
    groups = outer.select(F.xxhash64("hub", "shingle").alias("of"), F.col("narrow").cast("long").alias("left"), F.lit(1).cast("long").alias("right"))
    groups = groups.unionByName(inner.select(F.col("bucket").alias("of"), F.col("narrow").cast("long").alias("left"), F.col("wide").cast("long").alias("right")))
    sizes = groups.groupBy("of").agg((F.sum("left").cast("double") * F.sum("right")).alias("pairs"))
    return outer, inner, int(sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, signer: Signer = superminhash) -> DataFrame:
    """doc_id, md5 (of the text), n_shingles, component_id, family, k1, k2 (the set's digest) for each row; see near_duplicates.

    family is a number of the component of its own: two components can have
    the same smallest id if ids repeat with different texts.
    """
    ship(docs.sparkSession)
    texts = with_text(docs, id_col, text_col).withColumn("md5", F.md5(F.col("text").cast("binary")))
    sets = written(texts.mapInArrow(lambda batches: _sets(batches, signer), _SET), "sets")
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    repeated = nodes.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("first"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    if extras := not repeated.isEmpty():
        other = F.col("first").isNotNull() & (F.col("first") != F.struct("k1", "k2"))
        nodes = nodes.join(repeated, "id", "left").withColumn("node", F.when(other, F.lit(_EXTRA) + F.monotonically_increasing_id()).otherwise(F.col("id")))
        nodes = written(nodes.drop("first"), "nodes")
    else:
        nodes = nodes.withColumn("node", F.col("id"))

    band = "transform(sequence(0, {0} - 1), i -> xxhash64(i, slice(signature, i * {1} + 1, {1})))".format(BANDS, ROWS)
    bands = nodes.select("node", "n", F.explode(F.expr(band)).alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    bands = written(bands.join(full, "bucket"), "bands")
    wanted = nodes.join(bands.select("node").distinct(), "node", "left_semi").select("id", "node", "k1", "k2")
    members = texts.join(wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_members, "k1 long, k2 long, members array<long>")
    members = written(members.dropDuplicates(["k1", "k2"]).join(wanted.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "members"), "members")

    weight = bands.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = bands.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    pairs = bands.join(hubs, "bucket").where((F.col("node") != F.col("hub.node")) & _similar_sizes("n", "hub.n", percent)).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    label = connected_components(_links(_compared(pairs.distinct(), members), percent))

    rows = _labelled(bands.select("bucket", "node", "n"), label).join(hubs.select("bucket", F.col("hub.node").alias("hub")), "bucket")
    rows = written(_mixed(rows), "mixed")
    for _ in range(MORE_HUBS):
        outer, inner, made = _beyond_hubs(rows, members, percent)
        if made <= PAIRS_A_ROW * rows.count():
            break
        # pairs would outgrow the rows, so there are families beside the hub's: compare all with another hub first
        others = rows.where("component <> home")
        weight = others.groupBy("node").agg(F.count("*").alias("weight"))
        second = others.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n", "component")).alias("second"))
        pairs = rows.join(second, "bucket").where((F.col("component") != F.col("second.component")) & (F.col("node") != F.col("hub")) & _similar_sizes("n", "second.n", percent))
        pairs = pairs.select(F.col("node").alias("a"), F.col("second.node").alias("b")).distinct()
        label = connected_components(_as_links(label).unionByName(_links(_compared(pairs, members), percent)))
        rows = written(_mixed(_labelled(rows.drop("home"), label)), "mixed")
    else:
        outer, inner, _ = _beyond_hubs(rows, members, percent)
    pairs = _met_outside(outer, percent).unionByName(_met_inside(inner, nodes, percent)).distinct()
    links = written(_links(_compared(pairs, members), percent), "links")
    if not links.isEmpty():
        label = connected_components(_as_links(label).unionByName(links))

    placed = _labelled(nodes.select("k1", "k2", "node", "id"), label)
    if extras:
        least = placed.where(F.col("node") >= _EXTRA).groupBy("component").agg(F.min("id").alias("least"))
        placed = placed.join(least, "component", "left").withColumn("least", F.least("component", "least"))
    placed = placed.select("k1", "k2", F.col("component").alias("family"), F.col("least" if extras else "component").alias("component_id"))
    component_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return sets.join(placed, ["k1", "k2"], "left").select("doc_id", "md5", "n_shingles", component_id.alias("component_id"), "family", "k1", "k2")


def _as_links(label: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("src"), F.col("component").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, signer: Signer = superminhash) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of distinct 5-word shingles (A-Z lower-cased; fewer words: the
    whole sequence). component_id is the smallest doc_id reachable.

    Null or empty texts have no shingles and are linked with nothing. Equal
    texts are always linked. A repeated row repeats its result. Rows that
    share a doc_id but not their text are looked at one by one (ids below
    2 ** 62), so each has the component of its own text. A null doc_id can't
    name a component: such a row gets component_id null and kept true, and
    links nothing. An empty table gives an empty result. Other columns of
    `docs` are not looked at.
    """
    found = groups(docs, id_col, text_col, percent, signer)
    kept = F.col("doc_id").isNull() | (F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
