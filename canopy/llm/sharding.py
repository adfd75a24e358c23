"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, ordered, stage


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The Hilbert-curve index (long) of integer coordinates 0 .. 2**bits - 1, as one SQL expression.

    Coordinates are turned by Skilling's in-place transform (published 2004): undo the excess rotations bit by bit, Gray-encode,
    interleave. len(dims) * bits must be at most 62.
    """
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the index has at most 62 bits")
    levels = [1 << b for b in reversed(range(bits))]
    lit = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in levels[:-1] for i in range(n)])
    x = F.array(*[d.cast("long") for d in dims])

    def turn(acc: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        p, own = q - 1, F.get(acc, i)
        t = F.get(acc, F.lit(0)).bitwiseXOR(own).bitwiseAND(p)
        flip = own.bitwiseAND(q) != 0
        return F.transform(acc, lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(F.when((j == 0) != (j == i), v.bitwiseXOR(t)).otherwise(v)))

    if bits > 1:
        x = F.aggregate(steps, x, turn)
    # Gray code: each coordinate takes the XOR of all before it, then the carry of the last one.
    gray = lambda a: F.transform(a, lambda v, j: F.aggregate(F.slice(a, F.lit(1), j + 1), F.lit(0).cast("long"), lambda c, y: c.bitwiseXOR(y)))
    carry = lambda a: F.aggregate(lit(levels[:-1]) if bits > 1 else F.array().cast("array<long>"), F.lit(0).cast("long"), lambda c, q: F.when(F.get(a, F.lit(n - 1)).bitwiseAND(q) != 0, c.bitwiseXOR(q - 1)).otherwise(c))
    once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))  # noqa: E731  names a value, so that it is computed once
    x = once(x, gray)
    x = once(x, lambda a: F.transform(F.array(carry(a)), lambda t: F.transform(a, lambda v: v.bitwiseXOR(t)))[0])
    places = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in levels for i in range(n)])
    return once(x, lambda a: F.aggregate(places, F.lit(0).cast("long"), lambda c, s: c * 2 + F.when(F.get(a, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0)))


def value_cells(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, cell): the 2**bits - 2 most frequent values of a column in cells from 1 on, by frequency, then value. Nulls belong to cell 0, all other values to the last one."""
    n = docs.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    n = n.orderBy(F.desc("_n"), "_v").limit((1 << bits) - 2)
    return n.select("_v", F.row_number().over(W.orderBy(F.desc("_n"), "_v")).alias("_c"))  # so many rows at most


def text_dims(docs: DataFrame, sized: DataFrame, bits: int) -> tuple[DataFrame, list[Column]]:
    """sized with the cells of language, source and the logarithm of the size, each 0 .. 2**bits - 1, and their columns."""
    top = (1 << bits) - 1
    for c in ("lang", "source"):
        cells = value_cells(docs, c, bits).select(F.col("_v").alias(c), F.col("_c").alias(f"_{c}"))
        sized = sized.join(F.broadcast(cells), c, "left").withColumn(f"_{c}", F.when(F.col(c).isNull(), 0).otherwise(F.coalesce(f"_{c}", F.lit(top))))
    grown = F.least(F.lit(top), F.floor(F.log2(F.col("size").cast("double")) * (top / 24)))
    return sized, [F.col("_lang"), F.col("_source"), grown]


def shard_rows(sized: DataFrame, dims: list[Column], n_shards: int, bits: int = 5, ties: tuple[str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Rows in the order of the curve, cut into n_shards runs whose row counts differ by one at most.

    Adds hilbert, shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard). The order is that of the curve, then `ties`; so a hot cell is
    spread over many ranges. Rows that agree in all of these are interchangeable. An empty table gives an empty result. Columns named pid, idx, rank,
    hilbert, shard or slot in the input would clash: rename them first.
    """
    at = sized.withColumn("hilbert", hilbert_index(dims, bits))
    at = ordered(stage(at, "shard-sizes"), ["hilbert", *ties], "shard-order")
    per = at.groupBy("pid").agg(F.count("*").alias("n"))
    base = per.select("pid", F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("total"))
    out = attach(at, base, ["pid"], "inner").withColumn("rank", F.col("base") + F.col("idx"))
    out = out.withColumn("shard", F.expr(f"cast(rank * {int(n_shards)} div total as int)"))
    first = F.expr(f"(shard * total + {int(n_shards) - 1}) div {int(n_shards)}")  # the least rank of the shard
    return out.withColumn("slot", F.col("rank") - first).drop("pid", "idx", "base", "total", "rank")


def shard_documents(docs: DataFrame, n_shards: int = 16, bits: int = 5, key: str | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, lang, source, hilbert, shard, slot for every document, under the law `rows`.

    A null text has size 1 and the checksum 0. Null lang, source or doc_id are allowed, and repeated rows each get a place of their own. key: a column that tells rows apart, which comes too.
    """
    keys = [key] if key else []
    sized = docs.select(
        *keys, "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source",
    )
    sized, dims = text_dims(docs, sized, bits)
    return shard_rows(sized, dims, n_shards, bits, ("doc_id", "text_crc32", "size", *keys)).drop("_lang", "_source")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, bits: int = 5, files: int = 4) -> None:
    """Writes the documents into one folder per shard (`shard=n`), each in curve order in about `files` files, so that Parquet's min/max prune on every dimension.

    All columns of docs but one named shard are kept. Rows are told apart by a key written once with them, so ids may be null or repeat.
    """
    own = [c for c in docs.columns if c != "shard"]
    rows = stage(docs.select(F.struct(*own).alias("doc"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    placed = shard_documents(rows.select("row", "doc.doc_id", "doc.text", "doc.lang", "doc.source"), n_shards, bits, "row").select("row", "shard", F.col("slot").alias("place"))
    full = rows.join(stage(placed, "shard-places").hint("merge"), "row")
    full = full.repartitionByRange(n_shards * files, "shard", "place").sortWithinPartitions("shard", "place")
    full.select(*[F.col(f"doc.`{c}`").alias(c) for c in own], "shard").write.partitionBy("shard").parquet(path)
