"""Mixing sources to target weights: exact quotas, split over output shards by a multivariate-hypergeometric tree.

SQL functions only. A block is one document of a source; a source's blocks stand in a fixed pseudo-random order, and what is
taken of it is so many whole rounds through that order plus a run from its start, the last block of which is cut to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, attach, ordered, stage, with_rank


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """k, target and words (target rounded) for each row (source, source_size, blocks).

    Sources by code point, null last, have the weights in turn. They share `share` times all sizes by weight; none gets over `most` times its size, and
    the excess goes to the others by weight. In the order of most * size / weight the capped ones come first, so running sums give the common level.
    The table has one row per source.
    """
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights)).cast("int"))
    every = W.partitionBy(F.lit(1))
    k = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    out = sizes.withColumn("k", k).withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    up = W.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    out = out.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    out = out.withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    out = out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level))
    return out.withColumn("words", F.least(F.round("target"), F.floor("cap")).cast("long")).drop("w", "cap", "level", "capped")


def _named(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """One hypergeometric variate (long) by inversion: the terms within 10 standard deviations of the mode, from their ratios."""
    d = lambda c: c.cast("double")
    mean = d(draws) * d(good) / F.greatest(d(total), F.lit(1.0))
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - d(good) / F.greatest(d(total), F.lit(1.0))) * d(total - draws) / F.greatest(d(total) - 1, F.lit(1.0))))
    mode, reach = F.floor((d(draws) + 1) * (d(good) + 1) / (d(total) + 2)), F.ceil(10 * sd) + 10
    lo = F.greatest(F.lit(0).cast("long"), draws + good - total, mode - reach)
    hi = F.least(draws, good, mode + reach)
    s = F.struct(total.alias("n"), good.alias("g"), draws.alias("d"), u.alias("u"), lo.alias("lo"), hi.alias("hi"))

    def pick(v: Column) -> Column:
        ratio = lambda k: d(v["g"] - k) * d(v["d"] - k) / (d(k + 1) * d(v["n"] - v["g"] - v["d"] + k + 1))
        steps = F.sequence(v["lo"], v["hi"] - 1)
        one = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s"))
        whole = F.aggregate(steps, one, lambda a, k: _named(a["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (a["s"] + p).alias("s"))), lambda a: a["s"])
        first = lambda goal: F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s"), v["lo"].alias("x"))
        walk = lambda goal: F.aggregate(steps, first(goal), lambda a, k: F.when(a["s"] >= goal, a).otherwise(_named(a["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (a["s"] + p).alias("s"), (k + 1).alias("x")))), lambda a: a["x"])
        return F.when(v["lo"] >= v["hi"], v["lo"]).otherwise(_named(v["u"] * whole, walk))

    return _named(s, pick)


def split_quotas(sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """(k, bounds): for each source the running numbers of blocks at which output shards 0 .. 2**levels - 1 begin, and the last end.

    The tree: a node's quotas are halved; its left child draws half of all its blocks without replacement, so the counts by source follow a
    multivariate hypergeometric law, drawn source by source. Quotas stay exact in every node. One row per node, one array entry per source.
    """
    nodes = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda s: s["quota"]).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 52)).cast("double") / float(1 << 52)
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("n"), F.floor(total / 2).cast("long").alias("d"), F.array().cast("array<bigint>").alias("out"))

        tier = F.lit(level)

        def take(a: Column, x: Column) -> Column:
            got = hypergeometric(a["n"], x, a["d"], unit(tier, F.col("node"), F.size(a["out"])))
            return _named(got, lambda g: F.struct((a["n"] - x).alias("n"), (a["d"] - g).alias("d"), F.array_append(a["out"], g).alias("out")))

        nodes = nodes.withColumn("left", F.aggregate("q", start, take, lambda a: a["out"]))
        right = F.zip_with("q", "left", lambda q, x: q - x)
        kids = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        nodes = nodes.select(F.inline(kids))
    per = nodes.select(F.col("node").alias("shard"), F.posexplode("q").alias("k", "n"))
    cells = per.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "n"))), lambda s: s["n"]).alias("n"))
    # the running sums, as an array
    sums = F.aggregate("n", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return cells.select("k", sums.alias("bounds"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, levels: int = 4, seed: int = 7, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and draws, an array of (words, shard, place).

    Size: number of words. Each draw is one block copy: words of it are taken (all but in the last block of a source), it goes to output shard `shard`,
    and `place` orders the shard. A leaf of the tree draws as many blocks of each source as its quota says: its run of the source's permuted blocks, disjoint from all others. `taken` is the
    sum over the leaves. The root's quotas are exact to the word, so a source's taken words are its target rounded. Null texts have size 0 and are never drawn, nor are other empty ones; a null source is a source of its own, last in order.
    Documents with equal or null ids are separate blocks. An empty table gives an empty result. Other columns are ignored, but for `key`, which tells rows
    apart and comes first in the result.
    """
    h = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.length("text"))
    keys = [key] if key else []
    base = docs.select(*keys, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), F.xxhash64("text").alias("_t"))
    base = base.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    base = stage(base, "mix-sizes")
    # a source's order, by a hash; empty blocks come last in it and so never within a run
    base = ordered(base, ["_null", "_source", F.col("size") == 0, "h", "doc_id", "size", "_t", *keys], "mix-order")
    base = with_rank(base, {"before": "size"}, ["_null", "_source"])
    sizes = base.groupBy("_null", "_source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("blocks"))
    per = stage(source_targets(sizes, weights, share, most), "mix-sources")
    rounds = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long"))
    per = per.withColumn("rounds", rounds).withColumn("rest", F.col("words") - F.col("rounds") * F.col("source_size"))
    placed = attach(base, per.drop("source"), ["_null", "_source"], "inner")
    placed = placed.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before"))))
    last = F.expr("max_by(more, rank) filter (where more > 0)")  # what the last block gives, where a run ends within it
    quota = stage(placed.groupBy("k").agg((F.count(F.when(F.col("more") > 0, 1)) + F.max(F.col("rounds") * F.col("blocks"))).alias("quota"), last.alias("last")), "mix-quotas")
    leaves = stage(split_quotas(quota, levels, seed).join(quota.hint("merge"), "k"), "mix-leaves")
    out = attach(placed, leaves, ["k"], "inner")
    # each leaf draws its run lo .. hi - 1 of the source's permuted blocks, which go round: block `rank` is drawn at rank, rank + blocks, ..
    runs = F.transform(F.sequence(F.lit(0), F.lit(2**levels - 1)), lambda s: F.struct(s.alias("shard"), F.get("bounds", s).alias("lo"), F.get("bounds", s + 1).alias("hi")))
    runs = F.transform(runs, lambda x: F.struct(x["shard"].alias("shard"), (x["lo"] + F.pmod(F.col("rank") - x["lo"], F.greatest("blocks", F.lit(1)))).alias("first"), x["hi"].alias("hi")))
    runs = F.filter(runs, lambda x: (F.col("size") > 0) & (x["first"] < x["hi"]))

    def draw(shard: Column, i: Column) -> Column:
        words = F.when((i == F.col("quota") - 1) & F.col("last").isNotNull(), F.col("last")).otherwise(F.col("size"))
        return F.struct(words.alias("words"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "k", i).alias("place"))

    out = out.withColumn("draws", F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(x["first"], x["hi"] - 1, F.col("blocks")), lambda i: draw(x["shard"], i)))))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select(*keys, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_documents(docs: DataFrame, levels: int = 4, **how) -> DataFrame:
    """The mix itself: the columns of docs, a row for each draw, cut texts cut after the last word taken; docs without a draw are gone.

    Ids may be null or repeat: rows are told apart by a key written once with them. n_chars, where there is such a column, follows the text.
    The rows come by output shard, in the order of `place`: each shard is so many partitions in a row, `shuffle.partitions` over the number of shards, rounded up.
    """
    rows = stage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    drawn = mix(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), levels=levels, key="row", **how).filter(F.size("draws") > 0)
    out = attach(rows, stage(drawn.select("row", "draws", "size"), "mix-draws"), ["row"], "inner").select("doc", "row", "size", F.explode("draws").alias("d"))
    each = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2**levels)
    slot = F.least(F.lit(each - 1), F.floor((F.col("d.place").cast("double") / 2.0**64 + 0.5) * each).cast("int"))
    out = out.repartitionById(each * 2**levels, F.col("d.shard") * each + slot).sortWithinPartitions("d.place", "row")
    cut = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("d.words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("d.words") < F.col("size"), cut).otherwise(F.col("doc.text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
