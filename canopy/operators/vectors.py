"""Vector arithmetic, centroids and similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a block; bytes of reference blocks that are broadcast at once (one block at least).
BLOCK, BROADCAST_BYTES = 4096, 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """a over its norm, which is computed once; null if a has a null part."""
    unit = lambda n: F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))
    return F.when(~F.exists(a, lambda x: x.isNull()), F.get(F.transform(F.array(norm(a)), unit), F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def centroids(vectors: DataFrame, group: str = "label", x: str = "embedding") -> DataFrame:
    """group, centroid: the normalised mean of a group's normalised vectors; the sums are partial aggregates by dimension."""
    e = vectors.select(group, F.posexplode(l2_normalise(F.col(x))).alias("d", "v")).groupBy(group, "d").agg(F.avg("v").alias("v"))
    c = e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("c"))
    return c.select(group, l2_normalise(F.col("c")).alias("centroid"))


#: Bytes of centroids that are broadcast as one row at most; beyond, vectors meet them in blocks.
CENTROID_BYTES = 16 << 20


def nearest_centroid(vectors: DataFrame, cents: DataFrame, group: str = "label", options: DataFrame | None = None, most: int = CENTROID_BYTES) -> DataFrame:
    """vec_id, nearest, cos, margin (over the second): the closest centroid, ties to the smaller group; with options (vec_id, group) among an item's options only.

    Centroids are counted: a bounded table (one per class) is broadcast; a larger one (leaves of a tree) meets the vectors in blocks, whose two best are all that leaves a block.
    """
    n, dim = cents.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if options is None and n * max(1, dim or 1) * 8 > most:
        return _nearest_in_blocks(vectors, cents, group, n)
    if options is not None and n * max(1, dim or 1) * 8 > most:  # a row per option is the size of the answer
        o = options.select("vec_id", group).distinct().join(cents.select(group, F.col("centroid").alias("c")).hint("merge"), group)
        j = o.join(vectors.select("vec_id", l2_normalise(F.col("embedding")).alias("x")).hint("merge"), "vec_id").select("vec_id", F.struct((-dot(F.col("x"), F.col("c"))).alias("d"), F.col(group).alias("g")).alias("s"))
        v = j.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list("s")), 1, 2).alias("b"))
    else:
        c = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c")))).alias("cs"))
        v = vectors.select("vec_id", l2_normalise(F.col("embedding")).alias("x")).join(F.broadcast(c), F.lit(True))
        if options is not None:
            o = options.groupBy("vec_id").agg(F.collect_set(group).alias("_o"))
            v = v.join(o.hint("merge"), "vec_id").withColumn("cs", F.filter("cs", lambda s: F.array_contains("_o", s["g"])))
        best = F.array_sort(F.transform("cs", lambda s: F.struct((-dot(F.col("x"), s["c"])).alias("d"), s["g"].alias("g"))))
        v = v.select("vec_id", F.slice(best, 1, 2).alias("b"))
    v = v.filter(F.size("b") > 0)
    first, second = F.col("b")[0], F.get("b", F.lit(1))
    return v.select("vec_id", first["g"].alias("nearest"), (-first["d"]).alias("cos"), (second["d"] - first["d"]).alias("margin"))


def _two_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each vector of a block the two best of a block of centroids; those come in order of their groups."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            x, y = np.frombuffer(r["m"], "<f8").reshape(len(r["ids"]) // 8, -1), _matrix([c["c"] for c in r["cs"]])
            d = min(x.shape[1], y.shape[1])
            s = -(x[:, :d] @ y[:, :d].T)
            at = np.argsort(s, 1, kind="stable")[:, :2]
            ids = np.repeat(np.frombuffer(r["ids"], "<i8"), at.shape[1])
            no = np.array([c["g"] for c in r["cs"]], "<i8")[at].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(no), pa.array(np.take_along_axis(s, at, 1).ravel())], ["vec_id", "no", "d"])


def _nearest_in_blocks(vectors: DataFrame, cents: DataFrame, group: str, n: int, block: int = 1024) -> DataFrame:
    from ..workers import cut
    from .metrics import running

    numbered = running(cents.select(group, "centroid").withColumn("_one", F.lit(1)), [], [F.col(group)], {"_no": "_one"})
    numbered = cut(numbered.select(group, "centroid", F.col("_no").cast("long").alias("_no")))
    blocks = -(-n // block)
    c = numbered.groupBy(F.floor((F.col("_no") - 1) / block).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.col("_no").alias("g"), F.col("centroid").alias("c")))).alias("cs"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), l2_normalise(F.col("embedding")).alias("x")).filter("vec_id is not null and x is not null").mapInArrow(_packed, "ids binary, m binary")
    each = v.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = each.join(c.hint("shuffle_hash"), "b").select("ids", "m", "cs").mapInArrow(_two_best, "vec_id long, no long, d double")
    best = both.groupBy("vec_id").agg(F.min(F.struct("d", "no")).alias("f"), F.array_sort(F.collect_list(F.struct("d", "no"))).alias("b"))  # two rows of each block of centroids
    name = numbered.select(F.col("_no").alias("no"), F.col(group).alias("nearest"))
    best = best.select("vec_id", F.col("f.no").alias("no"), (-F.col("f.d")).alias("cos"), (F.get("b", F.lit(1))["d"] - F.col("f.d")).alias("margin"))
    return best.join(name.hint("merge"), "no").select("vec_id", "nearest", "cos", "margin")


def group_separation(cents: DataFrame, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """by, grp, inside, outside, separation: the mean cosine between a group's leaves, less that to the class's other leaves. cents: by, grp (null: no group), leaf, centroid (unit vector).

    Sums of vectors give both means, so no pairs are made. Groups of one leaf have no inside, classes without other leaves no outside.
    """
    e = cents.select(*by, "grp", F.posexplode("centroid").alias("d", "v"))
    own = e.groupBy(*by, "grp", "d").agg(F.sum("v").alias("s"), F.count("*").alias("m"))
    all_ = e.groupBy(*by, "d").agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    j = own.filter("grp is not null").join(all_.hint("merge"), [*by, "d"])
    g = j.groupBy(*by, "grp").agg(F.max("m").alias("m"), F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("so"))
    inside = F.when(F.col("m") > 1, (F.col("ss") - F.col("m")) / (F.col("m") * (F.col("m") - 1)))
    outside = F.when(F.col("n") > F.col("m"), F.col("so") / (F.col("m") * (F.col("n") - F.col("m"))))
    return g.select(*by, "grp", inside.alias("inside"), outside.alias("outside"), (inside - outside).alias("separation"))


def _matrix(rows: list) -> np.ndarray:
    """Vectors as rows; one that ends early has zeros there."""
    x = np.zeros((len(rows), max(map(len, rows), default=0)), "<f8")
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            b = batch.slice(lo, BLOCK)
            x = _matrix(b.column("x").to_pylist())
            ids = np.array(b.column("vec_id").to_pylist(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["ids", "m"])


#: Rows of a block that meet another block in one product; their scores are what a task holds besides its two blocks.
STRIP = 512


def dealt(vectors: DataFrame, n: int, by: list[str]) -> DataFrame:
    """vectors dealt by hash to about one partition for each half block of n rows, so that what a task packs and meets doesn't grow with the table."""
    return vectors.repartition(max(1, -(-n // (BLOCK // 2))), *by)


def _met(r: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A pair of blocks in strips: ids of a strip, ids of the reference, in order, and their cosines."""
    ids, ref = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["r_ids"], "<i8")
    x, y = np.frombuffer(r["m"], "<f8").reshape(len(ids), -1), np.frombuffer(r["r_m"], "<f8").reshape(len(ref), -1)
    d = min(x.shape[1], y.shape[1])
    by = np.argsort(ref, kind="stable")
    ref, y = ref[by], y[by, :d].T
    for lo in range(0, len(ids), STRIP):
        yield ids[lo : lo + STRIP], ref, x[lo : lo + STRIP, :d] @ y


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            for ids, ref, s in _met(batch.slice(i, 1).to_pylist()[0]):
                at = s.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ref[at]), pa.array(s[np.arange(len(ids)), at])], ["vec_id", "ref_id", "cos"])


def pairwise_top1(vectors: DataFrame, refs: DataFrame, group_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """vec_id, ref_id, cos: the closest reference vector of each row, exactly, ties to the smaller id. Vectors that are null or have a null part, and rows with a null id, take no part.

    Both sides are packed into blocks; each pair of blocks is one matrix product, of which one row per vector is left. Reference blocks are broadcast in groups of bounded bytes, a pass over the
    rows for each group.
    """
    prep = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), l2_normalise(F.col("embedding")).alias("x")).filter("vec_id is not null and x is not null")
    n, dim = prep(refs).agg(F.count("*"), F.max(F.size("x"))).first()
    rows = prep(vectors).count()
    blocks = max(1, -(-n // BLOCK))
    each = max(1, group_bytes // (BLOCK * 8 * max(1, dim or 1)))  # blocks in a group
    r = prep(refs).withColumn("b", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    v = dealt(prep(vectors), rows, ["vec_id"]).mapInArrow(_packed, "ids binary, m binary")

    def found(lo: int) -> DataFrame:
        hi = min(lo + each, blocks)
        part = r.filter(F.col("b").between(lo, hi - 1)).repartition(hi - lo, "b").drop("b").mapInArrow(_packed, "ids binary, m binary")
        part = part.select(F.col("ids").alias("r_ids"), F.col("m").alias("r_m"), F.pmod(F.xxhash64("ids"), F.lit(hi - lo)).cast("int").alias("b"))
        both = v.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(hi - lo - 1)))).join(F.broadcast(part), "b").select("ids", "m", "r_ids", "r_m")
        return both.mapInArrow(_best, "vec_id long, ref_id long, cos double")

    best = found(0)
    for lo in range(each, blocks, each):
        best = best.unionByName(found(lo))
    return best.groupBy("vec_id").agg(F.min_by(F.struct("ref_id", "cos"), F.struct(-F.col("cos"), "ref_id")).alias("b")).select("vec_id", "b.ref_id", "b.cos")


#: Vectors that meet their pivots at once, and pivots of a group at most.
CELLS, PIVOTS = 8192, 1024
#: Slack for rounding in angles, in radians.
SLACK = 1e-6


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = min(x.shape[1], y.shape[1])
    return np.arccos(np.clip(x[:, :d] @ y[:, :d].T, -1, 1))


def _to_pivot(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each vector's nearest pivot and the angle to it."""
    if not len(rows) or not len(pivots):
        return pd.DataFrame({"k": [], "id": [], "x": [], "pivot": [], "angle": []})
    a = _angles(_matrix(rows["x"].to_list()), _matrix(pivots["x"].to_list()))
    at = a.argmin(1)
    return pd.DataFrame({"k": rows["k"], "id": rows["id"], "x": rows["x"], "pivot": pivots["id"].to_numpy()[at], "angle": a[np.arange(len(at)), at]})


def celled(vectors: DataFrame, block: int, id_type: str) -> tuple[DataFrame, DataFrame]:
    """(vectors with pivot, angle and sub; pivots): each group's vectors in cells around about one pivot for each `block` of them, PIVOTS at most; cells of more than `block` are dealt into several.

    Pivots are vectors of the group itself, chosen by hash; vectors meet them in salted parts of a group, so that no task holds a group. vectors: k, id, x (unit vectors).
    """
    from ..workers import cut

    n = vectors.groupBy("k").agg(F.count("*").alias("n"), F.min(F.xxhash64("id")).alias("least"))
    v = vectors.join(n.hint("merge"), "k").withColumn("h", F.xxhash64("id"))
    # the share of hashes that makes as many pivots as wanted, and always the least one
    want = F.least(F.ceil(F.col("n") / block), F.lit(PIVOTS)) / F.col("n")
    pivots = cut(v.filter((F.col("h") == F.col("least")) | ((F.col("h").cast("double") + 2.0**63) / 2.0**64 < want)).select("k", "id", "x", "n").dropDuplicates(["k", "id"]))
    salts = F.ceil(F.col("n") / CELLS).cast("int")
    left = v.select("k", "id", "x", F.pmod("h", salts).cast("int").alias("salt")).groupBy("k", "salt")
    right = pivots.select("k", "id", "x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).groupBy("k", "salt")
    c = cut(left.cogroup(right).applyInPandas(_to_pivot, f"k string, id {id_type}, x array<double>, pivot {id_type}, angle double"))
    size = c.groupBy("k", "pivot").agg(F.ceil(F.count("*") / block).alias("subs"))
    return c.join(size.hint("merge"), ["k", "pivot"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).drop("subs"), pivots.drop("n")


def _near_pivots(limit: float):
    """Pairs of a group's pivots whose cells may hold vectors within `limit` of each other."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, r = _matrix(rows["x"].to_list()), rows["radius"].to_numpy()
        a = _angles(x, x)
        i, j = np.nonzero(a - r[:, None] - r[None, :] <= limit + SLACK)
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"k": [key[0]] * len(i), "pivot": ids[i], "pivot2": ids[j], "apart": a[i, j]})

    return run


def block_pairs(cells: DataFrame, pivots: DataFrame, limit: float, id_type: str) -> DataFrame:
    """k, pivot, sub, pivot2, sub2: the pairs of blocks in which an angle of at most `limit` is possible: by the triangle inequality, those whose pivots are no farther apart than the limit and both radii."""
    blocks = cells.groupBy("k", "pivot", "sub").agg(F.max("angle").alias("radius"))
    cell = blocks.groupBy("k", "pivot").agg(F.max("radius").alias("radius"))
    p = pivots.withColumnRenamed("id", "pivot").join(cell.hint("merge"), ["k", "pivot"]).withColumnRenamed("pivot", "id")
    near = p.groupBy("k").applyInPandas(_near_pivots(limit), f"k string, pivot {id_type}, pivot2 {id_type}, apart double")  # at most PIVOTS rows a group
    two = blocks.select("k", F.col("pivot").alias("pivot2"), F.col("sub").alias("sub2"), F.col("radius").alias("radius2"))
    both = near.join(blocks.hint("merge"), ["k", "pivot"]).join(two.hint("merge"), ["k", "pivot2"])
    return both.filter(F.col("apart") - F.col("radius") - F.col("radius2") <= limit + SLACK).select("k", "pivot", "sub", "pivot2", "sub2")


def _similar(near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q, x = r["q"], r["o"]
                m, o = _matrix([v["x"] for v in q]), _matrix([v["x"] for v in x])
                d = min(m.shape[1], o.shape[1])
                s = m[:, :d] @ o[:, :d].T
                a, b = np.nonzero(s >= near)
                rows = [(k, q[i]["id"], x[j]["id"], float(s[i, j])) for k, i, j in zip([r["k"]] * len(a), a.tolist(), b.tolist(), strict=True) if q[i]["id"] < x[j]["id"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], ["k", "a", "b", "cos"])

    return run


def pairs_within(vectors: DataFrame, by: tuple[str, ...], near: float, block: int = 512) -> DataFrame:
    """by, a, b, cos: pairs of a group's vectors at cosine >= near, a < b, exactly. vectors: by, id (string), x (unit vector).

    A group is cut into blocks of about `block` around pivots, and pairs of blocks that the triangle inequality rules out are never compared. The others are made as numbers first and each fetches its rows by the block's own
    key, so no key holds a whole group. Only similar pairs leave a block.
    """
    from ..workers import cut

    kinds = dict(vectors.dtypes)
    v = vectors.filter("x is not null and id is not null").select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("k"), "id", F.col("x").cast("array<double>").alias("x"))
    cells, pivots = celled(v, block, "string")
    packed = cut(cells.groupBy("k", "pivot", "sub").agg(F.collect_list(F.struct("id", "x")).alias("q")))
    pairs = cut(block_pairs(cells, pivots, float(np.arccos(min(1.0, max(-1.0, near)))), "string"))
    two = packed.select("k", F.col("pivot").alias("pivot2"), F.col("sub").alias("sub2"), F.col("q").alias("o"))
    both = pairs.join(packed.hint("merge"), ["k", "pivot", "sub"]).join(two.hint("merge"), ["k", "pivot2", "sub2"]).select("k", "q", "o")
    out = both.mapInArrow(_similar(near), "k string, a string, b string, cos double")
    shape = ", ".join(f"{c} {kinds[c]}" for c in by)
    return out.withColumn("k", F.from_json("k", shape)).select(*[F.col(f"k.{c}").alias(c) for c in by], "a", "b", "cos")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one group each."""
    for batch in batches:
        k = np.array(batch.column("k").to_pylist(), object)
        for key in sorted(set(k)):
            own = batch.filter(pa.array(k == key))
            for r in _packed(iter([own.select(["vec_id", "x"])])):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), *r.columns], ["k", "ids", "m"])


def meeting(vectors: DataFrame, refs: DataFrame, group_bytes: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Pairs of blocks (ids, m, r_ids, r_m) of vectors and references of one group, in passes over the vectors: references are broadcast in parts of bounded bytes, and no vector is shuffled for each block that it meets.

    vectors, refs: k (the group, a string), vec_id, x, cut, as they are read for every pass.
    """
    n, dim = refs.agg(F.count("*"), F.max(F.size("x"))).first()
    parts = max(1, -(-n * 8 * max(1, dim or 1) // group_bytes))
    v = dealt(vectors, vectors.count(), ["vec_id"]).mapInArrow(_keyed, "k string, ids binary, m binary")
    out = []
    for no in range(parts):
        r = dealt(refs.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == no), -(-n // parts), ["vec_id"]).mapInArrow(_keyed, "k string, r_ids binary, r_m binary")
        out.append(v.join(F.broadcast(r), "k").select("ids", "m", "r_ids", "r_m"))
    return out


def similar(near: float):
    """Pairs at cosine >= near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for ids, ref, s in _met(batch.slice(i, 1).to_pylist()[0]):
                    a, b = np.nonzero(s >= near)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ref[b]), pa.array(s[a, b])], ["vec_id", "ref_id", "cos"])

    return run


def _reached(near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for ids, _, s in _met(batch.slice(i, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[(s >= near).any(1)])], ["vec_id"])

    return run


def contained(cands: DataFrame, evals: DataFrame, tau: float, block: int = BLOCK, group_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """vec_id of candidates at cosine >= tau to any evaluation vector, exactly. Rows without an id, or with a null vector or part, take no part.

    A first part of the evaluation vectors (about `block`, by hash) meets all candidates; the others meet those that it left alone only, so where most candidates are contained the work is about candidates times `block`, and where none is
    it is all pairs. Nothing but the candidates themselves is shuffled; evaluation vectors are broadcast in parts of bounded bytes.
    """
    from ..workers import cut

    prep = lambda df: cut(df.select(F.lit("all").alias("k"), F.col("vec_id").cast("long").alias("vec_id"), l2_normalise(F.col("embedding")).alias("x")).filter("vec_id is not null and x is not null"))
    c, e = prep(cands), prep(evals)
    n = e.count()
    first = (F.xxhash64("vec_id", F.lit(0)).cast("double") + 2.0**63) / 2.0**64 < min(1.0, block / max(n, 1))
    hit = cut(_reach(c, e.filter(first), tau, group_bytes))
    if n > block:
        c = cut(c.join(hit.hint("merge"), "vec_id", "left_anti"))
        if c.limit(1).count():
            hit = cut(hit.unionByName(_reach(c, e.filter(~first), tau, group_bytes)))
    return hit


def _reach(cands: DataFrame, evals: DataFrame, tau: float, group_bytes: int) -> DataFrame:
    out = [both.mapInArrow(_reached(tau), "vec_id long") for both in meeting(cands, evals, group_bytes)]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.distinct()


def containment_filter(cands: DataFrame, evals: DataFrame, tau: float) -> DataFrame:
    """Candidates whose best cosine to an evaluation vector stays below tau; those without a vector stay."""
    return cands.join(contained(cands, evals, tau).hint("merge"), "vec_id", "left_anti")


def containment_counts(cands: DataFrame, evals: DataFrame, cuts: list[float]) -> DataFrame:
    """cut, contained: candidates at or above each cut."""
    t = pairwise_top1(cands, evals).withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    return t.groupBy("cut").agg(F.count_if(F.col("cos") >= F.col("cut")).alias("contained"))


def few_shot(cands: DataFrame, evals: DataFrame, k: int, tau: float, group: str = "label") -> DataFrame:
    """The first k candidates of each class (by id) that pass the containment filter."""
    r = F.row_number().over(W.partitionBy(group).orderBy("vec_id"))
    return containment_filter(cands, evals, tau).withColumn("rank", r).filter(F.col("rank") <= k)


def capped_selection(items: DataFrame, group: str, k: int, order: list[Column]) -> DataFrame:
    r = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return items.withColumn("rank", r).filter(F.col("rank") <= k)


def disjoint_sides(items: DataFrame, key: str) -> DataFrame:
    """items (with `side`), after a check that no `key` lies on several sides."""
    both = items.groupBy(key).agg(F.countDistinct("side").alias("n")).filter("n > 1").limit(1).count()
    if both:
        raise ValueError(f"{key} on several sides")
    return items


def hash_order(seed: int, *keys: str) -> Column:
    """A fixed pseudo-random order of rows: the MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def distractors(items: DataFrame, n: int = 3, seed: int = 7) -> DataFrame:
    """id, other: n other names for each item, of the same genus first, then of the same group, in hashed order.

    Each item meets the n + 1 least names of its genus and of its group by hash, not the whole group; so the items of a group share their distractors, but for their own names.
    """
    name = lambda by: items.select(by, "gold_name").distinct().withColumn("h", hash_order(seed, "gold_name"))

    def tier(by: str, no: int) -> DataFrame:
        r = F.row_number().over(W.partitionBy(by).orderBy("h", "gold_name"))
        top = name(by).withColumn("r", r).filter(F.col("r") <= n + 1).select(by, F.col("gold_name").alias("other"), F.lit(no).alias("tier"), "h")
        return items.select("id", "gold_name", by).join(top.hint("merge"), by).select("id", "gold_name", "other", "tier", "h")

    t = tier("genus", 0).unionByName(tier("grp", 1)).filter("other != gold_name").groupBy("id", "other").agg(F.min("tier").alias("tier"), F.min("h").alias("h"))
    r = F.row_number().over(W.partitionBy("id").orderBy("tier", "h", "other"))
    return t.withColumn("rank", r).filter(F.col("rank") <= n).select("id", "rank", "other")
