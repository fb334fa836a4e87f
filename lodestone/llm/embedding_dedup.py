"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, connected components.

Crowds are met as one: vectors within half the linking angle of a common centre all link with each other,
so such a ball needs no pairs of its own, and two balls whose centres lie near or far enough link wholly or
not at all.  Between balls at the border, members are compared by blocks, which give counts and one pair that
ties the balls together, and no row for a pair; between vectors outside balls, pairs are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

COSINE = 0.9
#: Chance that a pair of exactly the least cosine meets in no table; closer pairs miss far less.
MISS = 1e-4
#: Vectors of a bucket, on average, that the number of bits aims at.
BUCKET = 24
#: Bits of the sketch that candidates are screened by before their cosine is worked out, and the share
#: of pairs of exactly the least cosine that the screen may lose.
SKETCH_BITS, SCREEN_MISS = 256, 1e-7
#: Members from which a bucket counts as crowded, so that its first vector is tried as a centre, and the tables
#: in which crowds are looked for.
CROWD, CROWD_TABLES = 64, 8
#: Classes of a crowded bucket whose middle is tried as a centre.
MIDDLE = 64
#: Members of one ball's slice that a task compares with another's, at most on average, and rows of one product.
SLICE, PRODUCT = 4096, 512
#: Angles are told apart to this much, in radians.
_EPS = 1e-6
_WORDS = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def shape(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for so many vectors: buckets hold about ``BUCKET`` unrelated vectors at every size."""
    bits = min(40, max(6, math.ceil(math.log2(max(rows, 2) / BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def screen(cosine: float = COSINE, bits: int = SKETCH_BITS, miss: float = SCREEN_MISS) -> int:
    """Most differing sketch bits of a pair of the least cosine, but for ``miss`` of such pairs."""
    p, total = math.acos(cosine) / math.pi, 0.0
    for k in range(bits + 1):
        total += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if total >= 1 - miss:
            return k
    return bits


@lru_cache(maxsize=8)
def planes(dim: int, number: int) -> np.ndarray:
    """Random hyperplanes through the origin, fixed for a dimension."""
    return np.random.default_rng([20_240_229, dim]).standard_normal((number, dim)).T.copy()


def _hashes(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket number in each table, and the sketch as 64-bit words, of each row."""
    above = x @ planes(x.shape[1], SKETCH_BITS + bits * tables) > 0
    sketch = np.packbits(above[:, :SKETCH_BITS], axis=1, bitorder="little").view(np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return above[:, SKETCH_BITS:].reshape(len(x), tables, bits) @ weights, sketch


def prepare(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, unit) of every row.  ``v`` is the vector in doubles, times a power of two that brings its
    largest component to between 1 and 2: squares neither vanish nor overflow, and no bit of a cosine
    changes.  ``unit`` is the vector over its largest component, equal for multiples of a vector.  Both are
    null for vectors without a direction (null, zero, or with null or non-finite components) and null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            some = np.nonzero(sizes)[0]
            big = np.zeros(len(sizes))
            if len(some):
                big[some] = np.maximum.reduceat(np.abs(flat), (np.cumsum(sizes) - sizes)[some])  # NaN where one is
            ok = np.isfinite(big) & (big > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            keep = ok[row]
            power = np.frexp(np.where(ok, big, 1.0))[1] - 1
            v = np.ldexp(flat[keep], -power[row[keep]]) + 0.0  # no negative zero
            unit = v / np.ldexp(np.where(ok, big, 1.0), -power)[row[keep]] + 0.0
            offsets = np.concatenate(([0], np.cumsum(np.where(ok, sizes, 0)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x), mask=pa.array(~ok)) for x in (v, unit)]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "v", "unit"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, v array<double>, unit array<double>")


def cosine_of(a: str, b: str) -> F.Column:
    """Cosine of two columns of doubles; null where their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    x, y = F.col(a), F.col(b)
    return F.when(F.size(x) == F.size(y), dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def _angle(value: F.Column) -> F.Column:
    return F.acos(F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))


def _apart(l: str, r: str) -> str:
    return " + ".join(f"bit_count({l}{w} ^ {r}{w})" for w in _WORDS)


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(rep, sketch words, keys) of every class: its bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes).tolist():
                rows = np.nonzero(sizes == dim)[0]
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    bucket, sketch = _hashes(flat[start[some][:, None] + np.arange(dim)], bits, tables)
                    key = (np.int64(dim) << np.int64(50)) + (np.arange(tables, dtype=np.int64)[None, :] << np.int64(bits)) + bucket
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * tables), pa.array(key.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *(pa.array(sketch[:, k].copy()) for k in range(len(_WORDS))), keys], ["rep", *_WORDS, "keys"])

    return classes.select("rep", "v").mapInArrow(run, f"rep long, {', '.join(f'{w} long' for w in _WORDS)}, keys array<long>")


def balls(classes: DataFrame, bits: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(rep, ball, angle) and (ball, v): classes that lie within half the linking angle of a centre; of several
    centres the one of least number.  Any two of a ball link, whatever its centre.  A crowded bucket has its first
    class for a centre, and the middle of its ``MIDDLE`` classes of least hash, whose ball holds more of a
    crowd that lies around it; that one has a hash for a number, far below zero.
    """
    index = hashed(classes, bits, CROWD_TABLES).select("rep", *_WORDS, F.explode("keys").alias("key"))
    crowded = index.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("m")).where(F.col("m") >= CROWD)
    crowded = materialize(crowded.select("key", "first"), "crowded")
    order = Window.partitionBy("key").orderBy(F.xxhash64("rep", F.lit(5)), "rep")
    some = index.select("key", "rep").join(crowded.select("key"), "key", "left_semi").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MIDDLE)
    spread = some.join(classes.select("rep", "v"), "rep").select("key", F.posexplode("v").alias("at", "x"))
    mean = spread.groupBy("key", "at").agg(F.avg("x").alias("x")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    lowest = F.lit(-(1 << 63))
    middle = mean.withColumn("ball", lowest + F.xxhash64("v").bitwiseAND(F.lit((1 << 61) - 1)))
    centres = middle.select("key", "ball", "v").unionByName(crowded.join(classes.select(F.col("rep").alias("first"), "v"), "first").select("key", F.col("first").alias("ball"), "v"))
    centres = materialize(centres, "centres")
    seen = centres.dropDuplicates(["ball"]).select("ball", "v")
    near = index.join(centres.select("key", "ball").hint("merge"), "key").drop("key").distinct()
    sketch = hashed(seen.withColumnRenamed("ball", "rep"), bits, 1).select(F.col("rep").alias("ball"), *[F.col(w).alias(f"c{w}") for w in _WORDS])
    least = math.cos(math.acos(cosine) / 2)
    near = near.join(sketch, "ball").where(F.expr(f"{_apart('', 'c')} <= {screen(least)}")).select("rep", "ball")
    one, two = classes.select("rep", F.col("v").alias("va")), seen.select("ball", F.col("v").alias("vb"))
    angle = near.join(one, "rep").join(two, "ball").select("rep", "ball", _angle(cosine_of("va", "vb")).alias("angle"))
    inside = angle.where(F.col("angle") <= math.acos(cosine) / 2 - _EPS)
    return inside.groupBy("rep").agg(F.min("ball").alias("ball"), F.min_by("angle", "ball").alias("angle")), seen


def _compare(block: pa.Table, cosine: float) -> pa.Table:
    """(rep, m, other) of a block: to how many vectors of the other side each class links; ``other`` ties
    together: for the first linked pair of two balls, or of each vector outside them."""
    left = block.column("left").to_numpy(zero_copy_only=False).astype(bool)
    rep, n = block.column("rep").to_numpy(), block.column("n").to_numpy()
    lists = block.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    start = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    alone = block.column("a")[0].as_py() == block.column("b")[0].as_py()
    more = np.zeros(len(rep), np.int64)
    tie, tied = np.zeros(len(rep), np.int64), np.zeros(len(rep), bool)
    for dim in np.unique(sizes).tolist():  # vectors of different length never link
        one, two = (np.nonzero((sizes == dim) & side)[0] for side in (left, ~left))
        if not (len(one) and len(two)):
            continue
        x, y = (flat[start[k][:, None] + np.arange(dim)] for k in (one, two))
        lx, ly = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(y, y))
        for at in range(0, len(one), PRODUCT):
            some = slice(at, at + PRODUCT)
            value = (x[some] @ y.T) / (lx[some][:, None] * ly[None, :])
            linked = value >= cosine
            i, j = np.nonzero(np.abs(value - cosine) < 1e-9)  # where the order of a sum might matter
            linked[i, j] = _in_order(x[some][i], y[j]) / (lx[some][i] * ly[j]) >= cosine
            more[one[some]] += linked @ n[two]
            more[two] += n[one[some]] @ linked
            hit = np.nonzero(linked.any(axis=1))[0]
            tie[one[some][hit]] = rep[two[linked[hit].argmax(axis=1)]]
            tied[one[some][hit]] = True
    if not alone:
        tied[np.nonzero(tied)[0][1:]] = False
    keep = more > 0
    return pa.table({"rep": pa.array(rep[keep]), "m": pa.array(more[keep]), "other": pa.array(tie[keep], mask=~tied[keep])})


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products, component after component, as ``cosine_of`` adds them."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total = total + x[:, k] * y[:, k]
    return total


def _border(pairs: DataFrame, member: DataFrame, cosine: float) -> DataFrame:
    """(rep, m, other) for pairs of nodes some of whose members may link.  Two balls are compared slice by slice;
    the vectors outside balls that lie at the border of one ball are its other side together."""
    size = materialize(member.groupBy("node").agg(F.count("*").alias("classes")), "sizes")
    slices = lambda c: F.ceil(F.col(c) / SLICE)
    both = pairs.where("many_a AND many_b").select("a", "b")
    for side in "ab":
        both = both.join(size.select(F.col("node").alias(side), slices("classes").alias(f"s{side}")), side)
    outside = pairs.where("NOT (many_a AND many_b)").select(F.when(F.col("many_a"), F.col("b")).otherwise(F.col("a")).alias("single"), F.when(F.col("many_a"), F.col("a")).otherwise(F.col("b")).alias("ball"))
    around = outside.groupBy("ball").agg(F.ceil(F.count("*") / SLICE).alias("sa"))
    around = around.join(size.select(F.col("node").alias("ball"), slices("classes").alias("sb")), "ball")

    def dealt(rows: DataFrame, left: bool) -> DataFrame:
        own, other = ("sa", "sb") if left else ("sb", "sa")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        at = ("own", "other") if left else ("other", "own")
        return rows.select("a", "b", F.col(at[0]).alias("ka"), F.col(at[1]).alias("kb"), F.lit(left).alias("left"), "rep", "n", "v")

    parts = [dealt(both.join(member.withColumnRenamed("node", side), side), side == "a") for side in "ab"]
    ends = around.select(F.col("ball").alias("a"), F.col("ball").alias("b"), "sa", "sb")
    parts.append(dealt(outside.select("single", F.col("ball").alias("a")).join(ends, "a").join(member.withColumnRenamed("node", "single"), "single"), True))
    parts.append(dealt(ends.join(member.withColumnRenamed("node", "b"), "b"), False))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("a", "b", "ka", "kb").applyInArrow(lambda t: _compare(t, cosine), "rep long, m long, other long")


def links(classes: DataFrame, cosine: float = COSINE, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(rep, more) and (a, b): to how many vectors of other classes the members of a class link, and edges
    between classes that tie together what links tie together.

    ``classes`` has rep, n and v (doubles, see ``prepare``).  Buckets meet by an equality join that
    adaptive execution may split, and that is never a broadcast: Spark takes the exploded index for as small as
    the classes; the sketch screens inside the join; cosines are worked out in double
    precision for distinct candidates only.
    """
    bits, tables = shape(classes.count(), cosine, miss)
    limit = math.acos(cosine)
    inside, middles = balls(classes, bits, cosine)
    inside = materialize(inside, "balls")
    placed = classes.join(inside, "rep", "left").select("rep", "n", "v", "ball", F.coalesce("ball", "rep").alias("node"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    sizes = placed.groupBy("node").agg(F.sum("n").alias("total"), F.max("angle").alias("radius"), F.min("rep").alias("lead"), F.max(F.col("ball").isNotNull()).alias("many"))
    places = middles.select(F.col("ball").alias("node"), F.lit(True).alias("many"), "v").unionByName(classes.select(F.col("rep").alias("node"), F.lit(False).alias("many"), "v"))
    nodes = materialize(sizes.join(places, ["node", "many"]), "nodes")

    marks = hashed(classes, bits, tables).join(inside.select("rep", "ball"), "rep", "left")
    alone = marks.where("ball IS NULL").select(F.col("rep").alias("node"), F.lit(0).alias("many"), *_WORDS, F.explode("keys").alias("key"))
    crowd = marks.where("ball IS NOT NULL").select(F.col("ball").alias("node"), F.explode("keys").alias("key")).distinct()
    centres = hashed(nodes.where("many").select(F.col("node").alias("rep"), "v"), bits, 1).select(F.col("rep").alias("node"), F.lit(1).alias("many"), *_WORDS)
    index = alone.unionByName(crowd.join(centres.hint("merge"), "node"))
    # centres of linked vectors lie as much further apart as their balls are wide
    most = [screen(math.cos(limit * (1 + k / 2))) for k in range(3)]
    meet = f"l.key = r.key AND l.node < r.node AND {_apart('l.', 'r.')} <= CASE l.many + r.many WHEN 0 THEN {most[0]} WHEN 1 THEN {most[1]} ELSE {most[2]} END"
    pairs = index.alias("l").join(index.alias("r").hint("merge"), F.expr(meet)).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(nodes.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in nodes.columns]), side)
    value = cosine_of("v_a", "v_b")
    wide = F.col("radius_a") + F.col("radius_b")
    sure = F.when(~F.col("many_a") & ~F.col("many_b"), F.col("value") >= cosine).otherwise(_angle(F.col("value")) + wide <= limit - _EPS)
    open_ = (F.col("many_a") | F.col("many_b")) & (_angle(F.col("value")) - wide <= limit + _EPS)
    pairs = pairs.withColumn("value", value).select("a", "b", "many_a", "many_b", "total_a", "total_b", "lead_a", "lead_b", sure.alias("sure"), open_.alias("open")).where("sure OR open")
    pairs = materialize(pairs, "pairs")

    border = materialize(_border(pairs.where("NOT sure"), placed.select("node", "rep", "n", "v"), cosine), "border")

    whole = pairs.where("sure")
    far = whole.select(F.col("a").alias("node"), F.col("total_b").alias("m")).unionByName(whole.select(F.col("b").alias("node"), F.col("total_a").alias("m")))
    far = far.groupBy("node").agg(F.sum("m").alias("far"))
    single = border.groupBy("rep").agg(F.sum("m").alias("near"))
    home = placed.select("rep", "n", "node").join(nodes.select("node", "total"), "node")
    more = F.col("total") - F.col("n") + F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0))
    counts = home.join(far, "node", "left").join(single, "rep", "left").select("rep", more.alias("more"))
    ties = placed.join(nodes.select("node", "lead"), "node").where("lead < rep").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    edges = ties.unionByName(whole.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))).unionByName(border.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    return counts, materialize(edges, "edges")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Two vectors link if their cosine, in double precision, is ``cosine`` or more.  Vectors that are equal
    once divided by their largest component form a class that is compared once (classes are told apart by
    128 bits of hash); a row links with its class fellows and with every member of linked classes.  Null,
    zero, and non-finite vectors, vectors with a null component, and rows with a null id link with nothing
    and are their own component.  Vectors of different length never link.  Rows that share an id count as
    rows for links and as one node for components.  An empty table gives an empty result; other columns
    aren't looked at.
    """
    keyed = prepare(vectors, id_col, vector_col).withColumn("ok", F.col("v").isNotNull())
    keyed = keyed.select("id", "ok", F.when(F.col("ok"), F.xxhash64("unit", F.lit(1))).alias("k1"), F.when(F.col("ok"), F.xxhash64("unit", F.lit(2))).alias("k2"), "v")
    keyed = materialize(keyed, "prepared")
    members = keyed.select("id", "ok", "k1", "k2")
    classes = keyed.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by("v", F.struct("id", F.xxhash64("v"))).alias("v"))
    classes = materialize(classes, "vectors")
    several = members.where("ok").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x <> y")
    if not several.isEmpty():
        return _with_shared_ids(members, classes, cosine, miss, id_col)
    more, edges = links(classes, cosine, miss)
    comp = connected_components(edges)
    label = classes.select("k1", "k2", "rep", "n").join(more, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    label = label.select("k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    return _result(members, label, id_col)


def _result(members: DataFrame, label: DataFrame, id_col: str) -> DataFrame:
    out = members.join(label, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _with_shared_ids(members: DataFrame, classes: DataFrame, cosine: float, miss: float, id_col: str) -> DataFrame:
    """As above where some id has several vectors: classes get numbers of their own, and an id ties those
    of its vectors together."""
    numbered = classes.select("k1", "k2", F.monotonically_increasing_id().alias("number"), "n", "v", F.col("rep").alias("least"))
    numbered = materialize(numbered, "numbered")  # numbers are given once
    held = members.where("ok").join(numbered.select("k1", "k2", "number"), ["k1", "k2"]).select("id", "number").distinct()
    ties = held.join(held.groupBy("id").agg(F.min("number").alias("lead")), "id").where("lead < number")
    more, edges = links(numbered.select(F.col("number").alias("rep"), "n", "v"), cosine, miss)
    comp = connected_components(ties.select(F.col("lead").alias("a"), F.col("number").alias("b")).unionByName(edges))
    label = numbered.drop("v").join(more.withColumnRenamed("rep", "number"), "number", "left").join(comp, F.col("number") == F.col("node"), "left")
    label = label.withColumn("c", F.coalesce("component", "number")).drop("component")
    first = label.groupBy("c").agg(F.min("least").alias("component"))
    label = label.join(first, "c").select("k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "component")
    return _result(members, label, id_col)
