"""Evidence as mass functions, Dempster-Shafer fusion as an aggregate, decisions.

A mass function is rows (item, source, focal, mass). Focal elements are leaf
codes, known pairs ("a|b"), inner nodes of the taxonomy (see Frame) and THETA,
everything. For these the commonality q(A), the mass of all supersets of A,
multiplies under Dempster's rule. So fusion of any number of sources is one
grouped sum of logarithms, with partial aggregation and in any order; masses
follow by inversion.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.session import written

THETA = "*"
#: Discounts of the sources. Fixed values.
COSINE, BOOSTED, LEXICAL, LANGUAGE_MODEL, PATTERN = 0.30, 0.15, 0.20, 0.10, 0.10
#: Masses of a name match. Fixed values.
EXACT, ABBREVIATION, WORDS = 0.7, 0.5, 0.3
TINY = 1e-15
#: A taxonomy has at most so many codes; what is made of it goes to all executors.
MOST_CODES = 5_000


class Frame:
    """Leaf codes, and inner nodes as the sets of leaves below them.

    A node that holds one leaf is that leaf, one that holds two is their pair,
    and one that holds all is THETA; `named` gives the focal element of a node.
    """

    def __init__(self, leaves: Iterable[str], nodes: Mapping[str, Iterable[str]] | None = None, pairs: Iterable[tuple[str, str]] = ()) -> None:
        self.leaves = frozenset(leaves)
        self.nodes = {name: frozenset(codes) & self.leaves for name, codes in (nodes or {}).items()}
        if len(self.leaves) + len(self.nodes) > MOST_CODES:
            raise ValueError(f"a taxonomy has at most {MOST_CODES} codes")
        self.named = {name: self._name(name, codes) for name, codes in self.nodes.items() if codes}
        self.sets = {code: frozenset([code]) for code in self.leaves}
        self.sets |= {"|".join(sorted(pair)): frozenset(pair) for pair in pairs if self.leaves.issuperset(pair)}
        self.sets |= {focal: self.nodes[name] for name, focal in self.named.items() if focal != THETA}

    def _name(self, name: str, codes: frozenset[str]) -> str:
        return THETA if codes == self.leaves else "|".join(sorted(codes)) if len(codes) <= 2 else name

    @classmethod
    def of(cls, tree: DataFrame, pairs: Iterable[tuple[str, str]] = ()) -> Frame:
        """From (code) of leaves alone, or (code, parent): leaves are the codes that are nobody's parent."""
        rows = tree.distinct().limit(MOST_CODES + 1).collect()
        if "parent" not in tree.columns:
            return cls((r.code for r in rows if r.code is not None), pairs=pairs)
        parent = {r.code: r.parent for r in rows}
        leaves = parent.keys() - set(parent.values())
        below: dict[str, set[str]] = {}
        for leaf in leaves:
            at, seen = parent[leaf], {leaf}
            while at is not None and at not in seen:
                below.setdefault(at, set()).add(leaf)
                seen.add(at)
                at = parent.get(at)
        return cls(leaves, below, pairs)

    def descendants(self, like: DataFrame) -> DataFrame:
        """(code, leaf) of every leaf and inner node."""
        rows = [(c, c) for c in self.leaves] + [(n, c) for n, codes in self.nodes.items() for c in codes]
        return like.sparkSession.createDataFrame(sorted(rows), "code string, leaf string")

    def _weights(self, focal: str) -> list[tuple[str, float]]:
        """Moebius numbers of all focal elements within one: what its excess takes from each."""
        inside = sorted((f for f, codes in self.sets.items() if codes <= self.sets[focal]), key=lambda f: -len(self.sets[f]))
        weight = {focal: 1.0}
        for f in inside:
            if f != focal:
                weight[f] = -sum(w for g, w in weight.items() if self.sets[f] < self.sets[g])
        return list(weight.items())

    def table(self, like: DataFrame) -> DataFrame:
        """(named, below, targets) of every focal element but THETA.

        below: focal elements inside with their weights. targets: codes of
        leaves and nodes that it touches, whether it lies inside of them, and
        the part of it that a leaf is.
        """
        everything = {**{c: frozenset([c]) for c in self.leaves}, **self.nodes}
        rows = []
        for focal, codes in self.sets.items():
            targets = [(t, codes <= of, 1.0 / len(codes) if t in codes and t in self.leaves else 0.0) for t, of in everything.items() if codes & of]
            rows.append((focal, self._weights(focal), targets))
        kind = "named string, below array<struct<focal string, weight double>>, targets array<struct<code string, inside boolean, share double>>"
        return F.broadcast(like.sparkSession.createDataFrame(rows, kind))


def resolve_labels(df: DataFrame, vocabulary: DataFrame, label: str) -> DataFrame:
    """Adds id of (name, id): the exact name, else the first that differs by case only."""
    exact = vocabulary.select(F.col("name").alias("_name"), F.col("id").alias("_exact"))
    loose = vocabulary.groupBy(F.lower("name").alias("_lower")).agg(F.min("id").alias("_loose"))
    out = df.join(exact, F.col(label) == F.col("_name"), "left").join(loose, F.lower(label) == F.col("_lower"), "left")
    return out.withColumn("id", F.coalesce("_exact", "_loose")).drop("_name", "_exact", "_lower", "_loose")


def few(categories: DataFrame) -> DataFrame:
    """Categories that every item is compared with: at most MOST_CODES, or it is an error."""
    if categories.limit(MOST_CODES + 1).count() > MOST_CODES:
        raise ValueError(f"a taxonomy has at most {MOST_CODES} codes")
    return F.broadcast(categories)


def cosine(items: DataFrame, categories: DataFrame) -> DataFrame:
    """(item, code, sim) of every vector with every category; zero vectors have 0. See `few`."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot("vector", "vector"))
    a = items.select("item", F.col("vector").cast("array<double>").alias("vector")).withColumn("norm", norm)
    b = categories.select("code", F.col("vector").cast("array<double>").alias("vector")).withColumn("norm", norm).select("code", F.col("vector").alias("of"), F.col("norm").alias("of_norm"))
    both = a.crossJoin(few(b))
    size = F.col("norm") * F.col("of_norm")
    return both.select("item", "code", F.when(size > 0, dot("vector", "of") / size).otherwise(0.0).alias("sim"))


def _with_theta(masses: DataFrame, source: str) -> DataFrame:
    """Adds what the masses of an item leave as THETA; the masses are computed once."""
    each = masses.groupBy("item").agg(F.collect_list(F.struct("focal", "mass")).alias("all"), F.sum("mass").alias("named"))
    return _exploded(each, F.greatest(F.lit(0.0), 1 - F.col("named")), source)


def _exploded(each: DataFrame, ignorance: Column, source: str) -> DataFrame:
    """Rows of (item, all[focal, mass]) and the ignorance of each item."""
    rest = F.array(F.struct(F.lit(THETA).alias("focal"), ignorance.alias("mass")))
    return each.select("item", F.explode(F.concat("all", rest)).alias("m")).select("item", "m.focal", "m.mass").withColumn("source", F.lit(source))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def from_similarity(sims: DataFrame, discount: float = COSINE, source: str = "cosine") -> DataFrame:
    """Softmax of the similarities of an item, discounted; null similarities count for nothing."""
    each = sims.where(F.col("sim").isNotNull()).groupBy("item").agg(F.collect_list(F.struct(F.col("code").alias("focal"), "sim")).alias("all"), F.max("sim").alias("top"))
    each = each.withColumn("total", _total(F.transform("all", lambda x: F.exp(x["sim"] - F.col("top")))))
    mass = lambda x: (1 - discount) * F.exp(x["sim"] - F.col("top")) / F.col("total")
    each = each.withColumn("all", F.filter(F.transform("all", lambda x: F.struct(x["focal"].alias("focal"), mass(x).alias("mass"))), lambda x: x["mass"] > TINY))
    return _exploded(each, F.greatest(F.lit(0.0), 1 - _total(F.transform("all", lambda x: x["mass"]))), source)


def from_probabilities(proba: DataFrame, frame: DataFrame, discount: float | Column = LEXICAL, source: str = "lexical") -> DataFrame:
    """Probabilities of (item, code, p) discounted; what lies outside the frame goes to THETA."""
    known = proba.join(frame.select("code"), "code", "left_semi").where(F.col("p") > TINY)
    kept = (1 - discount) if isinstance(discount, Column) else F.lit(1 - discount)
    return _with_theta(known.select("item", F.col("code").alias("focal"), (F.col("p") * kept).alias("mass")), source)


def ensemble_discount(variance: str) -> Column:
    """The discount of boosted trees grows with the variance of their ensemble."""
    return F.least(F.lit(0.5), F.lit(0.1) + F.col(variance) * 1.6)


def from_patterns(items: DataFrame, mapping: DataFrame, frame: DataFrame, source: str = "pattern") -> DataFrame:
    """0.9 in equal parts to the codes of (item, pattern); items without one are vacuous."""
    known = mapping.join(frame.select("code"), "code", "left_semi").groupBy("pattern").agg(F.collect_set("code").alias("codes"))
    # one set of codes for each item, of which there are as many as leaves at most
    codes = items.join(known, "pattern", "left").groupBy("item").agg(F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"))
    focal = F.explode_outer("codes").alias("focal")
    share = codes.select("item", F.size("codes").alias("n"), focal).where("focal IS NOT NULL").select("item", "focal", ((1 - PATTERN) / F.col("n")).alias("mass"))
    rest = codes.select("item", F.lit(THETA).alias("focal"), F.when(F.size("codes") > 0, PATTERN).otherwise(1.0).alias("mass"))
    return share.unionByName(rest).withColumn("source", F.lit(source))


def from_answers(answers: DataFrame, frame: DataFrame, discount: float = LANGUAGE_MODEL, source: str = "llm") -> DataFrame:
    """(item, code, confidence, alternatives[code, confidence]): the answer, then alternatives share the rest."""
    leaf = frame.select("code")
    good = answers.join(leaf, "code", "left_semi")
    main = F.col("confidence") * (1 - discount)
    total = F.aggregate("alternatives", F.lit(0.0), lambda s, a: s + a["confidence"])
    first = good.select("item", "code", main.alias("mass"))
    others = good.where(total > 0).select("item", F.explode("alternatives").alias("a"), ((1 - discount) - main).alias("rest"), total.alias("total"))
    others = others.select("item", F.col("a.code").alias("code"), (F.col("a.confidence") / F.col("total") * F.col("rest")).alias("mass")).join(leaf, "code", "left_semi")
    summed = first.unionByName(others.select("item", "code", "mass").where(F.col("mass") > TINY)).groupBy("item", F.col("code").alias("focal")).agg(F.sum("mass").alias("mass"))
    return _with_theta(summed, source)


def from_names(items: DataFrame, categories: DataFrame, source: str = "name") -> DataFrame:
    """Name matches of (item, name) with (code, label, abbrev): exact, abbreviation, or all words of a label.

    Items that match nothing are vacuous.
    """
    from varve.functions import names

    words = F.trim(F.lower(F.replace(F.col("name"), F.lit("_"), F.lit(" "))))
    label = F.trim(F.regexp_replace(names.camel_words("label"), "[()]", ""))
    both = items.withColumn("_w", words).crossJoin(few(categories.withColumn("_l", label)))
    several = F.size(F.split("_l", " ")) > 1
    mass = (
        F.when(F.col("_w") == F.col("_l"), EXACT)
        .when(F.replace(F.col("_w"), F.lit(" "), F.lit("")) == F.lower(F.trim("abbrev")), ABBREVIATION)
        .when(several & (F.size(F.array_except(F.split("_l", " "), F.split("_w", " "))) == 0), WORDS)
    )
    found = both.withColumn("mass", mass).groupBy("item").agg(F.max(F.when(F.col("mass").isNotNull(), F.struct("mass", (-F.col("place")).alias("p"), "code"))).alias("best"))
    hit = F.struct(F.col("best.code").alias("focal"), F.col("best.mass").alias("mass"))
    rest = F.struct(F.lit(THETA).alias("focal"), (1 - F.coalesce("best.mass", F.lit(0.0))).alias("mass"))
    return found.select("item", F.explode(F.filter(F.array(hit, rest), lambda m: m["mass"].isNotNull())).alias("m")).select("item", "m.*").withColumn("source", F.lit(source))


def share_with_pairs(masses: DataFrame, pairs: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Half of the second singleton's mass goes to the pair if the first two are a known pair and close.

    `pairs` has a < b. Ties go to the smaller code.
    """
    single = ~F.col("focal").contains("|") & (F.col("focal") != THETA)
    order = F.when(single & F.col("mass").isNotNull(), F.struct((-F.col("mass")).alias("order"), "focal"))
    each = masses.groupBy("item", "source").agg(F.collect_list(F.struct("focal", "mass")).alias("all"), F.array_sort(F.collect_list(order)).alias("best"))
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    each = each.select("item", "source", "all", first["focal"].alias("f1"), second["focal"].alias("f2"), (-first["order"]).alias("m1"), (-second["order"]).alias("m2"))
    known = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    close = (F.least("f1", "f2") == F.col("_a")) & (F.greatest("f1", "f2") == F.col("_b")) & (F.col("m2") > TINY) & (F.col("m1") < ratio * F.col("m2"))
    moved = F.col("_a").isNotNull()
    kept = F.transform("all", lambda x: F.struct(x["focal"].alias("focal"), F.when(moved & (x["focal"] == F.col("f2")), x["mass"] / 2).otherwise(x["mass"]).alias("mass")))
    pair = F.array(F.struct(F.concat_ws("|", "_a", "_b").alias("focal"), _total(F.transform(F.filter("all", lambda x: x["focal"] == F.col("f2")), lambda x: x["mass"] / 2)).alias("mass")))
    out = each.join(known, close, "left").select("item", "source", F.explode(F.when(moved, F.concat(kept, pair)).otherwise(F.col("all"))).alias("m"))
    return out.select("item", "source", "m.focal", "m.mass")


def fuse(masses: DataFrame, frame: Frame | None = None) -> DataFrame:
    """(item, focal, mass, conflict): all sources of each item combined.

    Every source of an item has its THETA row, 0 where it has no ignorance.
    q(A) is the product of named part + THETA over the sources that name A (or
    a set around it), times the THETAs of the others; masses follow as q(A)
    less the masses above A. Products are sums of logarithms, taken relative
    to the item's largest one, so many sources don't vanish. Only if all
    commonalities are zero the conflict is total: then the result is the
    vacuous function and conflict 1. At least three leaves are needed, else a
    pair would be everything. Inner nodes need their `frame`.

    There is one shuffle, by item; what is gathered of an item has a row for
    each focal element at most.
    """
    is_theta = F.col("focal") == THETA
    part = lambda name, weight: F.struct(name.alias("focal"), F.lit(weight).alias("weight"))
    simple = F.when(F.col("focal").contains("|"), F.concat(F.array(part(F.col("focal"), 1.0)), F.transform(F.split("focal", r"\|"), lambda x: part(x, -1.0)))).otherwise(F.array(part(F.col("focal"), 1.0)))
    table = None if frame is None else frame.table(masses).select("named", F.col("below").alias("_below"))

    def with_below(rows: DataFrame) -> DataFrame:
        """Adds the focal elements inside of each one, with their weights."""
        if table is None:
            return rows.withColumn("below", simple)
        return rows.join(table, F.col("focal") == F.col("named"), "left").withColumn("below", F.coalesce("_below", simple))

    zero = F.lit(0.0)
    sources = masses.repartition("item").groupBy("item", "source").agg(F.collect_list(F.when(~is_theta, F.struct("focal", "mass"))).alias("all"), F.coalesce(F.max(F.when(is_theta, F.col("mass"))), zero).alias("theta"))
    theta_row = F.array(F.struct(F.lit(THETA).alias("focal"), zero.alias("mass")))
    rows = with_below(sources.select("item", "source", "theta", F.explode(F.concat("all", theta_row)).alias("m")).select("item", "source", "theta", "m.focal", "m.mass"))
    named = rows.select("item", "source", F.explode("below.focal").alias("focal"), "mass", "theta").groupBy("item", "source", "focal").agg((F.sum("mass") + F.first("theta")).alias("own"), F.first("theta").alias("theta"))
    q = named.groupBy("item", "focal").agg(
        F.coalesce(F.sum(F.when(F.col("own") > 0, F.ln("own"))), zero).alias("log"), F.count_if(F.col("own") <= 0).alias("dead"), F.coalesce(F.sum(F.when(F.col("theta") > 0, F.ln("theta"))), zero).alias("thetas"), F.count_if(F.col("theta") <= 0).alias("zeros")
    )
    # the row of THETA has the sum over all sources
    whole = F.max(F.when(is_theta, F.struct("log", "dead"))).alias("whole")
    each = q.groupBy("item").agg(F.collect_list(F.struct("focal", "log", "dead", "thetas", "zeros")).alias("all"), whole)
    everything = F.when(F.col("whole.dead") == 0, F.col("whole.log"))
    log = lambda x: F.when(x["focal"] == THETA, everything).when((x["dead"] == 0) & (x["zeros"] == F.col("whole.dead")), x["log"] + F.col("whole.log") - x["thetas"])
    each = each.select("item", F.transform("all", lambda x: F.struct(x["focal"].alias("focal"), log(x).alias("log"))).alias("all"), everything.alias("least")).withColumn("scale", F.array_max("all.log"))
    at = lambda c: F.coalesce(F.exp(F.col(c) - F.col("scale")), zero)
    rows = each.select("item", "scale", "least", F.explode("all").alias("m")).select("item", "scale", "least", "m.focal", "m.log")
    # what a set has is no longer that of the sets within
    excess = with_below(rows.select("item", "focal", "scale", F.when(is_theta, at("log")).otherwise(at("log") - at("least")).alias("v")))
    raw = excess.select("item", "v", "scale", F.explode("below").alias("b")).groupBy("item", F.col("b.focal").alias("focal")).agg(F.sum(F.col("v") * F.col("b.weight")).alias("raw"), F.first("scale").alias("scale"))
    raw = raw.withColumn("raw", F.when(F.col("raw") < TINY, 0.0).otherwise(F.col("raw"))).groupBy("item").agg(F.collect_list(F.struct("focal", "raw")).alias("all"), F.sum("raw").alias("total"), F.first("scale").alias("scale"))
    rows = raw.select("item", "total", "scale", F.explode("all").alias("m")).select("item", "total", "scale", "m.focal", "m.raw")
    mass = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(F.when(is_theta, 1.0).otherwise(0.0))
    return rows.select("item", "focal", mass.alias("mass"), (1 - F.coalesce(F.col("total") * F.exp("scale"), zero)).alias("conflict")).where("mass > 0")


def intervals(fused: DataFrame, frame: DataFrame | Frame) -> DataFrame:
    """(item, code, bel, pl, betp, conflict) of every item with every leaf and inner node of the frame.

    bel is the mass inside of the code, pl the mass that touches it; betp
    shares each mass among its leaves, and is 0 for inner nodes.
    """
    frame = Frame.of(frame.select("code")) if isinstance(frame, DataFrame) else frame
    target = lambda code, inside, share: F.struct(code.alias("code"), F.lit(inside).alias("inside"), F.lit(share).alias("share"))
    codes = [target(F.lit(c), c in frame.nodes and frame.nodes[c] == frame.leaves, 0.0 if c in frame.nodes else 1.0 / len(frame.leaves)) for c in sorted(frame.leaves | frame.nodes.keys())]
    own = F.when(F.col("focal") == THETA, F.array(*codes)).when(F.col("focal").contains("|"), F.transform(F.split("focal", r"\|"), lambda c: target(c, False, 0.5)))
    # one row for each item, with a THETA of no mass so that every code occurs
    each = fused.groupBy("item").agg(F.collect_list(F.struct("focal", "mass")).alias("all"), F.first("conflict").alias("conflict"))
    each = each.select("item", "conflict", F.explode(F.concat("all", F.array(F.struct(F.lit(THETA).alias("focal"), F.lit(0.0).alias("mass"))))).alias("m")).select("item", "conflict", "m.*")
    each = each.join(frame.table(fused).select("named", "targets"), F.col("focal") == F.col("named"), "left")
    touched = each.select("item", "conflict", "mass", F.explode(F.coalesce("targets", own)).alias("t"))
    return touched.groupBy("item", F.col("t.code").alias("code")).agg(
        F.sum(F.when(F.col("t.inside"), F.col("mass")).otherwise(0.0)).alias("bel"), F.sum("mass").alias("pl"), F.sum(F.col("mass") * F.col("t.share")).alias("betp"), F.first("conflict").alias("conflict")
    )


def decide(intervals: DataFrame) -> DataFrame:
    """The leaf with the largest pignistic probability (ties: smallest code) and whether to ask.

    To ask: gap of the interval above 0.3 or conflict (4 digits) above 0.2.
    Inner nodes have no pignistic probability and are never chosen.
    """
    return _judged(intervals.groupBy("item").agg(F.min(F.struct((-F.col("betp")).alias("order"), "code", "betp", "bel", "pl", "conflict")).alias("best")).select("item", "best.*"))


def _judged(best: DataFrame) -> DataFrame:
    gap = F.col("pl") - F.col("bel")
    return best.select("item", "code", F.round("betp", 3).alias("confidence"), F.round("bel", 4).alias("bel"), F.round("pl", 4).alias("pl"), F.round("conflict", 4).alias("conflict"), ((gap > 0.3) | (F.round("conflict", 4) > 0.2)).alias("needs_clarification"))


def decide_fused(fused: DataFrame, frame: DataFrame | Frame) -> DataFrame:
    """What `decide` says of all intervals, from the fused masses alone.

    A leaf that no focal element but THETA holds has less pignistic
    probability than any that one does, so only leaves that are named are
    compared, not every item with every code. An item that names none goes to
    the smallest code.
    """
    frame = Frame.of(frame.select("code")) if isinstance(frame, DataFrame) else frame
    if not frame.leaves:
        return _judged(fused.limit(0).select("item", F.lit("").alias("code"), *(F.lit(0.0).alias(c) for c in ("betp", "bel", "pl", "conflict"))))
    half = lambda c: F.struct(c.alias("code"), F.lit(False).alias("inside"), F.lit(0.5).alias("share"))
    pair = F.when(F.col("focal").contains("|"), F.transform(F.split("focal", r"\|"), half))
    table = frame.table(fused).select("named", F.filter("targets", lambda t: t["share"] > 0).alias("leaves"))
    rows = fused.join(table, F.col("focal") == F.col("named"), "left").select("item", "focal", "mass", "conflict", F.explode_outer(F.coalesce("leaves", pair)).alias("t"))
    ignorance = F.sum(F.when(F.col("focal") == THETA, F.col("mass")).otherwise(0.0))
    each = rows.groupBy("item", F.col("t.code").alias("code")).agg(
        F.sum(F.col("mass") * F.col("t.share")).alias("betp"), F.sum(F.when(F.col("t.inside"), F.col("mass")).otherwise(0.0)).alias("bel"), F.sum("mass").alias("pl"), ignorance.alias("theta"), F.first("conflict").alias("conflict")
    )
    named = F.when(F.col("code").isNotNull(), F.struct((-F.col("betp")).alias("order"), "code", "betp", "bel", "pl"))
    best = each.groupBy("item").agg(F.min(named).alias("best"), F.sum("theta").alias("theta"), F.first("conflict").alias("conflict"))
    zero, n = F.lit(0.0), len(frame.leaves)
    of = lambda c: F.coalesce(F.col(f"best.{c}"), zero)
    return _judged(best.select("item", F.coalesce("best.code", F.lit(min(frame.leaves))).alias("code"), (of("betp") + F.col("theta") / n).alias("betp"), of("bel").alias("bel"), (of("pl") + F.col("theta")).alias("pl"), "conflict"))


def with_evidence(decided: DataFrame, masses: DataFrame) -> DataFrame:
    """Adds evidence: the sources in order of name, each with its best singleton and that mass ("cosine=c1:0.42, ...")."""
    best = best_singletons(masses)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "code", "mass"))), lambda s: F.concat(s["source"], F.lit("="), s["code"], F.lit(":"), F.format_number(s["mass"], 2))), ", ")
    return decided.join(best.groupBy("item").agg(text.alias("evidence")), "item", "left")


def best_singletons(masses: DataFrame) -> DataFrame:
    """(item, source, code, mass): the leaf that a source believes in most (ties: smallest code)."""
    single = masses.where((F.col("focal") != THETA) & ~F.col("focal").contains("|"))
    top = single.groupBy("item", "source").agg(F.min(F.struct((-F.col("mass")).alias("order"), F.col("focal").alias("code"), "mass")).alias("best"))
    return top.select("item", "source", "best.code", "best.mass")


def closure(tree: DataFrame) -> DataFrame:
    """(code, ancestor) pairs of (code, parent), each code its own ancestor too.

    Paths double in length with each round, which is written to the shared
    folder; it ends when nothing is added, so trees of any depth are whole.
    """
    up = tree.where("parent IS NOT NULL").select("code", F.col("parent").alias("ancestor"))
    rows, before = written(tree.select("code", F.col("code").alias("ancestor")).unionByName(up).distinct(), "closure"), -1
    while (now := rows.count()) > before:
        before = now
        further = rows.select("code", F.col("ancestor").alias("_at")).join(rows.select(F.col("code").alias("_at"), "ancestor"), "_at").select("code", "ancestor")
        rows = written(further.distinct(), "closure")
    return rows


def evaluate(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds truth and status (correct, wrong, no_truth) to decisions."""
    both = decided.join(truth, "item", "left")
    status = F.when(F.col("truth").isNull(), "no_truth").when(F.col("truth") == F.col("code"), "correct").otherwise("wrong")
    return both.withColumn("status", status)


def figures(judged: DataFrame, closure: DataFrame) -> DataFrame:
    """One row over decisions with a truth: accuracy, micro and macro F1, and what belief says.

    In the hierarchy a decision is right if it is the truth, an ancestor or a
    descendant of it. Means are over decisions with some belief.
    """
    related = closure.select("code", F.col("ancestor").alias("truth")).unionByName(closure.select(F.col("ancestor").alias("code"), F.col("code").alias("truth"))).distinct()
    rows = judged.join(related.withColumn("_related", F.lit(1)), ["code", "truth"], "left")
    hit, believed = (F.col("code") == F.col("truth")).cast("int"), F.col("bel") > 0
    mean = lambda c: F.round(F.avg(F.when(believed, c)), 3)
    line = rows.agg(
        F.round(F.avg(F.greatest(hit, F.coalesce("_related", F.lit(0)))), 4).alias("hierarchical_accuracy"), mean(F.col("bel")).alias("mean_belief"), mean(F.col("pl") - F.col("bel")).alias("mean_gap"), mean(F.col("conflict")).alias("mean_conflict"),
        F.round(F.avg(F.col("needs_clarification").cast("int")), 4).alias("clarification_rate"),
    )
    side = lambda c, tp, got, n: judged.select(F.col(c).alias("code"), tp.alias("tp"), F.lit(got).alias("got"), F.lit(n).alias("n"))
    each = side("code", hit, 1, 0).unionByName(side("truth", F.lit(0), 0, 1)).groupBy("code").agg(F.sum("tp").alias("tp"), F.sum("got").alias("got"), F.sum("n").alias("n"))
    micro = 2.0 * F.sum("tp") / (F.sum("got") + F.sum("n"))
    scores = each.agg(F.round(F.sum("tp") / F.sum("n"), 4).alias("accuracy"), F.round(micro, 4).alias("micro_f1"), F.round(F.avg(2.0 * F.col("tp") / (F.col("got") + F.col("n"))), 4).alias("macro_f1"), F.sum("n").alias("n"))
    return scores.crossJoin(line)


def by_kind(judged: DataFrame) -> DataFrame:
    """(kind, n, accuracy, assisted, dependent) by kind of column and for all, in one pass.

    judged: kind, code, truth, boosted (what the trees said) and without (the
    decision that leaves them out). assisted: right, and so were the trees;
    dependent: and wrong without them.
    """
    right = F.col("code") == F.col("truth")
    helped = right & (F.col("boosted") == F.col("truth"))
    rows = judged.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 4).alias("accuracy"), F.count_if(helped).alias("assisted"), F.count_if(helped & (F.col("without") != F.col("truth"))).alias("dependent"))
    return rows.withColumn("kind", F.coalesce("kind", F.lit("all")))
