"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

1. A document's set of word shingles is kept as 64-bit fingerprints; equal sets form one class, whose member of least id stands for it.
2. Its sketch is the `k` least fingerprints. Inverted lists of the retained values join sketches that overlap: as in prefix filtering, two sketches that share at least t values share one of
   the s - t + 1 rarest of either, so only those are listed, and values that one class alone retains are not.
3. In each list every class is compared with the list's hub, its least id: as many pairs as list entries, however long the list is. The sketch of the union estimates the similarity and
   drops most pairs; the full sets give the exact one.
4. Hubs and what resembles them at least at `cloud` form clouds; by the triangle inequality of the Jaccard distance a link between two classes of which one is linked to the hub lies inside its cloud.
   Clouds that the links found so far leave in parts get lists of their own, of the exact prefix of full sets, values that are rare in the cloud first, so that pages which share a template alone
   meet in none. Lists' members in different clouds or different parts are compared by size band: pairs of rows in short lists, in blocks in others (of sketches between clouds, of full sets
   inside one, each pair of blocks once), which only survivors leave.
5. Connected components over all verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage, without
from .textstats import mixed, windows, word_hashes

#: Retained values, the least overlap of two sketches (as a share) that is looked for, and the similarity of a cloud's members with a hub.
K, OVERLAP, CLOUD = 96, 0.62, 0.5
#: Members in a block at most on average, and bytes of their full sets; values in one matrix; members of a list that are paired as rows.
BLOCK, BLOCK_BYTES, COLUMNS, SHORT = 256, 1 << 20, 1 << 14, 16
#: Members of a cloud that tell which of its values are frequent, their largest sets, and how many frequent values are told apart; shares of a hot key.
SAMPLE, SAMPLE_N, COMMON, SALTS = 16, 20_000, 4096, 8


def fingerprints(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, ascending: A-Z lower-cased, words by ASCII white space; fewer than `width` words are one shingle; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = word_hashes(words)
    w = windows(h, width) if len(h) >= width else mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
    return np.unique(w.view(np.int64))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [fingerprints(t, width) for t in batch.column("text").to_pylist()]
            sketch = pa.array([s[:k] for s in sets], pa.list_(pa.int64()))
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), digest, sketch], ["doc_id", "n", "digest", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprints(t, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["id", "s"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact intersection and union sizes of pairs of full sets."""
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)]
        union = [len(x) // 8 + len(y) // 8 - n for x, y, n in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), both, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "union"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, comp): the least id reachable, for each end of an edge (a, b). Rounds of least neighbours and pointer jumps, each written out.

    A hub's many edges are no burden: least neighbours are partial aggregates, and labels reach edges by joins that Spark can split.
    """
    e = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    lab = stage(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), f"{name}-labels")
    if not lab.limit(1).count():
        return lab
    while True:
        near = e.join(lab.select(F.col("id").alias("b"), "comp").hint("merge"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        new = lab.join(near.select(F.col("a").alias("id"), "m").hint("merge"), "id").select("id", "comp", F.least("comp", "m").alias("m"))
        up = lab.select(F.col("id").alias("m"), F.col("comp").alias("mm"))  # the label's own label
        new = new.join(up.hint("merge"), "m").select("id", F.least("m", "mm").alias("comp"), (F.least("m", "mm") < F.col("comp")).alias("moved"))
        new = stage(new, f"{name}-labels")
        if not new.filter("moved").limit(1).count():
            return new.select("id", "comp")
        lab = new.select("id", "comp")


def _pairs_with_sets(pairs: DataFrame, docs: DataFrame, width: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b, s1, s2): pairs with the full sets of both, made anew from the texts of the documents concerned only."""
    sets = known if known is not None else _sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs, width)
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), sets.select(F.col("id").alias("b"), F.col("s").alias("s2"))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "s1", "s2")


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    need = stage(ids.distinct(), "dedup-needed")
    small = need.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    text = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(need) if small else need.hint("merge"), "id", "left_semi")
    return stage(text.mapInArrow(_sets(width), "id long, s binary"), "dedup-sets", "uncompressed")


_PAIR = "a long, b long, both long, union long"


def _common(qv: np.ndarray, ql: np.ndarray, xv: np.ndarray, xl: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets q[i] and x[j], by products of incidence matrices; the sets stand one after another in qv and xv, their sizes in ql and xl."""
    shared = np.intersect1d(qv, xv)
    grid = np.zeros((len(ql), len(xl)), np.int64)
    if not len(shared):
        return grid
    sides = []
    for v, n in ((qv, ql), (xv, xl)):
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[at] == v
        sides.append((np.repeat(np.arange(len(n)), n)[hit], at[hit], len(n)))
    for lo in range(0, len(shared), COLUMNS):
        cols = []
        for member, at, n in sides:
            m = np.zeros((n, min(COLUMNS, len(shared) - lo)), np.float32)
            here = (at >= lo) & (at < lo + COLUMNS)
            m[member[here], at[here] - lo] = 1
            cols.append(m)
        grid += np.rint(cols[0] @ cols[1].T).astype(np.int64)
    return grid


def _forest(i: np.ndarray, j: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges i[e] - j[e] between `left` members and others, those that a spanning forest needs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = []
    for e, (a, b) in enumerate(zip(i.tolist(), (j + left).tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            keep.append(e)
    return i[keep], j[keep]


def _blocks(similarity: int, k: int | None, low: float):
    """Pairs (a, b, sure) between two blocks of members (id, n, comp, s) with different comp.

    k None: s are full sets, and only links come out, as a spanning forest. Else s are sketches of k values: where both are whole sets it is the same, other pairs come out unsure
    where the values common to both reach the share `low` of the union's sketch, that is of all values up to the one where the first of the two sketches ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, x in zip(batch.column("q"), batch.column("x"), strict=True):
                (qi, qn, qc, qv, ql), (xi, xn, xc, xv, xl) = (_members(side.values) for side in (q, x))
                both = _common(qv, ql, xv, xl)
                apart = (qc[:, None] != xc[None, :]) & ((qn[:, None] < xn[None, :]) | ((qn[:, None] == xn[None, :]) & (qi[:, None] < xi[None, :])) | (k is None))
                linked = 100 * both >= similarity * (qn[:, None] + xn[None, :] - both)
                whole = np.ones_like(linked) if k is None else (qn <= k)[:, None] & (xn <= k)[None, :]
                i, j = _forest(*np.nonzero(apart & whole & linked), len(qi))
                sure = np.ones(len(i), bool)
                if k is not None:
                    union = _union(qv, ql, qn > k, xv, xl, xn > k) - both
                    maybe = (both >= low * union) & (100 * np.minimum(qn[:, None], xn[None, :]) >= similarity * np.maximum(qn[:, None], xn[None, :]))
                    mi, mj = np.nonzero(apart & ~whole & maybe)
                    i, j, sure = np.concatenate([i, mi]), np.concatenate([j, mj]), np.concatenate([sure, np.zeros(len(mi), bool)])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(qi[i], xi[j])), pa.array(np.maximum(qi[i], xi[j])), pa.array(sure)], ["a", "b", "sure"])

    return run


def _union(qv: np.ndarray, ql: np.ndarray, qcut: np.ndarray, xv: np.ndarray, xl: np.ndarray, xcut: np.ndarray) -> np.ndarray:
    """For sketches q[i] and x[j]: how many values of both lie up to the end of the one that ends first; a sketch that isn't cut has no end."""
    sides = [(np.split(v, np.cumsum(n)[:-1]), np.where(cut, v[np.cumsum(n) - 1], np.iinfo(np.int64).max)) for v, n, cut in ((qv, ql, qcut), (xv, xl, xcut))]
    (q, qe), (x, xe) = sides
    return np.stack([np.searchsorted(s, np.minimum(e, xe), "right") for s, e in zip(q, qe, strict=True)]) + np.stack([np.searchsorted(s, np.minimum(e, qe), "right") for s, e in zip(x, xe, strict=True)], 1)


def _members(side: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Columns id, n and comp of a block, its sets one after another, and their sizes in s."""
    i, n, comp = (side.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "comp"))
    s = side.field("s")
    if pa.types.is_binary(s.type):
        return i, n, comp, np.frombuffer(b"".join(s.to_pylist()), np.int64), n
    return i, n, comp, s.flatten().to_numpy(zero_copy_only=False), s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _compared(q: DataFrame, x: DataFrame, on: list[str], steps: tuple[int, ...], run) -> DataFrame:
    """(a, b, sure) from run over pairs of a block of q and one of x with equal `on`, whose last column may be more by one of `steps` in x. Rows: on, block, m (a member).

    The pairs of blocks are made as numbers first, then each fetches its members by the block's own key, so that no key holds a whole group.
    """
    key = [*on, "block"]
    pack = lambda side: stage(side.groupBy(*key).agg(F.collect_list("m").alias("ms")), "dedup-blocks", "uncompressed")
    same, q = q is x, pack(q)
    x = q if same else pack(x)
    q, x = (side.select(*[F.col(c).alias(f"{name}_{c}") for c in key], F.col("ms").alias(name)) for side, name in ((q, "q"), (x, "x")))
    last = on[-1]
    one = q.drop("q").withColumns({c: F.col(f"q_{c}") for c in on[:-1]} | {last: F.explode(F.array(*[F.col(f"q_{last}") + s for s in steps]))})
    two = x.drop("x").withColumns({c: F.col(f"x_{c}") for c in on})
    pairs = stage(one.join(two.hint("merge"), on).drop(*on), "dedup-block-pairs")
    pairs = pairs.join(q.hint("merge"), [f"q_{c}" for c in key]).select("q", *[f"x_{c}" for c in key]).join(x.hint("merge"), [f"x_{c}" for c in key]).select("q", "x")
    return stage(pairs.mapInArrow(run, "a long, b long, sure boolean"), "dedup-compared", rows=64)


def _salted(big: DataFrame, small: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join on a column with hot keys: small's rows stand once for each of SALTS shares of big, which `by` tells."""
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(small.hint("merge"), [on, "_salt"]).drop("_salt")


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cloud, members, common): the values that several sets of a cloud's sample hold, rarest first."""
    for batch in batches:
        out = []
        for sets in batch.column("sets").to_pylist():
            v, n = np.unique(np.concatenate([np.frombuffer(s, np.int64) for s in sets]), return_counts=True)
            v, n = v[n > 1], n[n > 1]
            out.append(v[np.argsort(-n, kind="stable")[:COMMON]][::-1].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cloud"), batch.column("members"), pa.array(out, pa.binary())], ["cloud", "members", "common"])


def _prefixes(similarity: int):
    """(cloud, v, id): the values that a set must share one of with each set it links with, those its cloud's sample holds least first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for s, common in zip(batch.column("s").to_pylist(), batch.column("common").to_pylist(), strict=True):
                s, common = np.frombuffer(s, np.int64), np.frombuffer(common or b"", np.int64)
                place = np.zeros(len(s), np.int64)
                if len(common):
                    by = np.argsort(common)
                    at = np.minimum(np.searchsorted(common[by], s), len(common) - 1)
                    place = np.where(common[by][at] == s, by[at] + 1, 0)
                kept.append(s[np.lexsort((s, place))][: len(s) - -(-len(s) * similarity // 100) + 1])
            rows = pa.array(np.repeat(np.arange(len(kept)), [len(x) for x in kept]))
            own = [batch.column(c).take(rows) for c in ("cloud", "id", "n", "comp", "block", "pure")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)), *own], ["v", "cloud", "id", "n", "comp", "block", "pure"])

    return run


def _inside(own: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame] | None:
    """Lists (v, id, n, cloud, block, pure) inside the clouds that are in parts, where `cloud` is the part, and the members (block, m) with their full sets; None without such clouds.

    A small cloud is a list. In others two sets that link share a value of the exact prefix of both, in any order of values that the cloud's members agree on; here those that few members of
    a sample hold come first, so what a template gives all its pages is in no list. The order decides about work alone, not about results. Blocks hold members of one part (`pure`) or whole small parts.
    """
    sizes = own.groupBy("cloud", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
    split = stage(sizes.groupBy("cloud").agg(F.sum("m").alias("members"), F.sum("held").alias("all"), F.count("*").alias("parts")).filter("parts > 1").drop("parts"), "dedup-split")
    if not split.limit(1).count():
        return None
    blocks = lambda m, held: F.ceil(F.greatest(F.col(m) / BLOCK, F.col(held) * 8 / BLOCK_BYTES))
    parts = _salted(sizes, split, "cloud", "comp").select("comp", "members", blocks("m", "held").alias("k"), blocks("members", "all").alias("ks"), ((F.col("m") * 2 > BLOCK) | (F.col("held") * 16 > BLOCK_BYTES)).alias("large"))
    of = _salted(own, stage(parts, "dedup-split-parts"), "comp", "id")
    number = F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.col("k"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("ks")))
    of = of.withColumns({"pure": F.when(F.col("large"), F.col("comp")), "block": F.concat_ws("-", "cloud", F.when(F.col("large"), F.col("comp").cast("string")).otherwise(F.lit("")), number)})
    few = of.filter(F.col("members") <= SHORT // 2).select(F.xxhash64(F.lit("cloud"), "cloud").alias("v"), "id", "n", F.col("comp").alias("cloud"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("long").alias("pure"))
    of = stage(of.filter(F.col("members") > SHORT // 2).join(sets.hint("merge"), "id").select("cloud", "members", "id", "n", "comp", "block", "pure", "s"), "dedup-split-members", "uncompressed")
    sample = of.filter((F.col("n") <= SAMPLE_N) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("members")) < SAMPLE))
    sample = sample.groupBy("cloud").agg(F.first("members").alias("members"), F.collect_list("s").alias("sets")).mapInArrow(_frequent, "cloud long, members long, common binary")
    salts = F.ceil(F.col("members") / BLOCK).cast("int")
    sample = stage(sample, "dedup-frequent").select("cloud", "common", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    lists = of.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(sample.hint("merge"), ["cloud", "salt"], "left").drop("salt", "members")
    lists = stage(lists.mapInArrow(_prefixes(similarity), "v long, cloud long, id long, n long, comp long, block string, pure long"), "dedup-inside", rows=256)
    lists = lists.select(F.xxhash64("cloud", "v").alias("v"), "id", "n", F.col("comp").alias("cloud"), "block", "pure")
    return few.unionByName(lists), of.select("block", F.struct("id", "n", "comp", "s").alias("m"))


def _compared_whole(lists: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links between blocks that share a list, each pair of blocks once, on full sets. Blocks of one and the same part aren't compared."""
    lists = stage(lists.distinct(), "dedup-inside-long")
    q, x = (lists.select("v", F.col("block").alias(f"{c}b"), F.col("pure").alias(f"{c}p")) for c in "qx")
    pairs = q.join(x.hint("merge"), "v").filter((F.col("qb") <= F.col("xb")) & ~F.coalesce(F.col("qp") == F.col("xp"), F.lit(False)))
    pairs = stage(pairs.select("qb", "xb").distinct(), "dedup-block-pairs")
    if not pairs.limit(1).count():
        return pairs.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    need = pairs.select(F.col("qb").alias("block")).unionByName(pairs.select(F.col("xb").alias("block"))).distinct()
    packed = stage(members.join(need.hint("merge"), "block", "left_semi").groupBy("block").agg(F.collect_list("m").alias("ms")), "dedup-blocks", "uncompressed")
    q, x = (packed.select(F.col("block").alias(f"{c}b"), F.col("ms").alias(c)) for c in "qx")
    both = pairs.join(q.hint("merge"), "qb").join(x.hint("merge"), "xb").select("q", "x")
    return stage(both.mapInArrow(_blocks(similarity, None, 0.0), "a long, b long, sure boolean"), "dedup-compared", rows=64).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, k: int = K, cloud: float = CLOUD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links: 100 * intersection >= similarity * union of the shingle sets (of `width` words), confirmed on full sets. component_id is the least id reachable; kept where it is the document's own.
    Texts that are null or without words have an empty set and link with nothing. Documents with a null id are returned with a null component, kept, and link with nothing.
    Sets of over k * similarity / 100 shingles are candidates by an estimate (see OVERLAP); a `k` of at least the largest set makes every list an exact prefix of full sets and every estimate exact.
    Rows that repeat an id belong together only through their texts, but share a component then; an id whose texts differ joins their components. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = stage(docs.mapInArrow(_sketches(width, k), "doc_id long, n long, digest binary, sketch array<long>"), "dedup-sketches")
    real = sk.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    # 1. classes of equal sets
    head = real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    reps = stage(real.join(head.select("digest", "id").hint("shuffle_hash"), [real.digest == head.digest, real.doc_id == head.id], "left_semi").dropDuplicates(["digest"]).select(F.col("doc_id").alias("id"), "digest", "n", "sketch"), "dedup-classes")
    head = stage(head, "dedup-heads")
    # 2. inverted lists of the rarest retained values
    post = reps.select("id", F.explode("sketch").alias("v"))
    freq = stage(post.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1"), "dedup-values")
    rare = post.join(freq.hint("merge"), "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("vs"))
    size = F.size("sketch")
    # sets whose partners are all whole in their sketches share at least `similarity` of themselves; others fall below OVERLAP with a negligible chance
    exact = F.col("n") * 100 <= k * similarity
    least = F.greatest(F.lit(1), F.when(exact, F.ceil(size * similarity / 100)).otherwise(F.floor(size * OVERLAP))).cast("int")
    width_of = F.greatest(F.lit(0), size - least + 1 - (size - F.size("vs")))  # values of one class alone come first and take their share
    lists = rare.join(reps.select("id", "n", "sketch").hint("merge"), "id").select("id", "n", F.explode(F.slice("vs", F.lit(1), width_of)).alias("x")).select("id", "n", F.col("x.v").alias("v"))
    lists = stage(lists, "dedup-lists")
    # 3. each member against its list's hub
    hubs = stage(lists.groupBy("v").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("m")).filter("m > 1").select("v", F.col("h.id").alias("hub"), F.col("h.n").alias("hn")), "dedup-hubs")
    floor = F.lit(cloud)
    star = lists.join(hubs.hint("merge"), "v").filter((F.col("id") != F.col("hub")) & (F.least("n", "hn") >= floor * F.greatest("n", "hn"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()

    def estimated(pairs: DataFrame, low: float) -> DataFrame:
        """Pairs whose union's sketch holds at least the share `low` of values common to both."""
        s = reps.select("id", "sketch")
        p = pairs.join(s.select(F.col("id").alias("a"), F.col("sketch").alias("k1")).hint("merge"), "a").join(s.select(F.col("id").alias("b"), F.col("sketch").alias("k2")).hint("merge"), "b")
        top = F.slice(F.array_sort(F.array_union("k1", "k2")), F.lit(1), F.lit(k))
        both = F.size(F.array_intersect(top, F.array_intersect("k1", "k2")))
        return p.filter(both >= low * F.size(top)).select("a", "b")

    star = stage(estimated(star, cloud - 0.2), "dedup-star")
    sets = _sets_of(star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))), docs, width)
    return _finish(docs, sk, head, reps, lists, star, sets, width, similarity, k, cloud, estimated)


def _finish(docs, sk, head, reps, lists, star, sets, width, similarity, k, cloud, estimated) -> DataFrame:
    linked = F.expr(f"100 * both >= {int(similarity)} * `union`")
    exact = stage(_pairs_with_sets(star, docs, width, sets).mapInArrow(_overlaps, _PAIR).filter(f"both >= {cloud} * `union`"), "dedup-exact")
    links = exact.filter(linked).select("a", "b")
    part = components(links, "dedup-parts").withColumnRenamed("comp", "part")
    clouds = components(exact, "dedup-clouds").withColumnRenamed("comp", "cloud")
    own = clouds.join(part.hint("merge"), "id", "left").join(reps.select("id", "n").hint("merge"), "id")
    own = stage(own.select("id", "n", "cloud", F.coalesce("part", "id").alias("comp")), "dedup-members")
    # 4a. lists inside clouds in parts
    inside = _inside(own, sets, similarity)
    # 4b. members of one list in different clouds, or in different parts of one, by size band
    at = lists.join(own.select("id", "cloud").hint("merge"), "id", "left").select("v", "id", "n", F.coalesce("cloud", "id").alias("cloud"))
    if inside is not None:
        inside, whole = inside
        at = at.withColumns({"block": F.lit(None).cast("string"), "pure": F.lit(None).cast("long")}).unionByName(inside)
    apart = at.groupBy("v").agg(F.min("cloud").alias("c0"), F.max("cloud").alias("c1")).filter("c0 != c1").select("v")
    at = at.join(stage(apart, "dedup-apart").hint("merge"), "v", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / similarity))).cast("int"))
    at = stage(at, "dedup-rest")
    # a member meets its own band and the next, so a list is short where no two neighbouring bands hold over SHORT
    long = at.groupBy("v", "band").agg(F.count("*").alias("m")).filter(F.col("m") > SHORT // 2)
    lists_of = stage(long.groupBy("v").agg(F.max("m").alias("most")), "dedup-long")
    at = at.join(lists_of.hint("merge"), "v", "left")
    few = at.filter("most is null")
    one = few.select("v", F.col("id").alias("a"), F.col("n").alias("n1"), F.col("cloud").alias("c1"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    two = few.select("v", "band", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("cloud").alias("c2"))
    rest = one.join(two.hint("merge"), ["v", "band"]).filter((F.col("c1") != F.col("c2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("a") < F.col("b")))) & (100 * F.col("n1") >= similarity * F.col("n2")))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = at.filter("most is not null" if inside is None else "most is not null and block is null").join(reps.select("id", "sketch").hint("merge"), "id")
    many = many.select("v", "band", F.pmod(F.xxhash64("v", "id"), F.ceil(F.col("most") / BLOCK)).alias("block"), F.struct("id", "n", F.col("cloud").alias("comp"), F.col("sketch").alias("s")).alias("m"))
    low = similarity / 100 - 0.3
    if inside is not None:
        links = links.unionByName(_compared_whole(at.filter("most is not null and block is not null").select("v", "block", "pure"), whole, similarity))
    found = _compared(many, many, ["v", "band"], (0, 1), _blocks(similarity, k, low))
    links = links.unionByName(found.filter("sure").select("a", "b"))
    rest = rest.unionByName(found.filter("not sure").select("a", "b")).distinct().join(star.hint("merge"), ["a", "b"], "left_anti")
    rest = stage(estimated(rest, low), "dedup-rest-pairs")
    if rest.limit(1).count():
        more = _pairs_with_sets(rest, docs, width).mapInArrow(_overlaps, _PAIR).filter(linked).select("a", "b")
        links = links.unionByName(stage(more, "dedup-rest-links"))
    # 5. components of classes, then of documents
    comp = components(links, "dedup-all")
    label = head.join(comp.hint("merge"), "id", "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    out = sk.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(stage(label, "dedup-labels").hint("merge"), "digest", "left")
    none = F.col("doc_id").isNull() | F.col("digest").isNull()
    out = out.withColumn("component_id", F.when(none, F.col("doc_id")).otherwise(F.col("comp")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows that aren't kept; of rows that repeat a kept id, all stay."""
    return without(docs, near_duplicates(docs, **how).filter("not kept").select("doc_id"))
