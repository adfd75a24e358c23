"""Chunk grids of recordings, their rows, splits and windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WINDOWS = "array<struct<t0:double,t1:double>>"


def clip_id(path: Column) -> Column:
    """The first 16 hexadecimal digits of the path's MD5."""
    return F.substring(F.md5(path.cast("binary")), 1, 16)


def chunk_grid(dur: Column, chunk: float, cap: float = 60.0) -> Column:
    """array<struct<t0, t1>>: windows of `chunk` seconds without overlap; a tail of at least half a chunk stays, a clip shorter than a chunk is one window from 0.5 s on."""
    d = F.least(dur, F.lit(cap))
    n = F.floor((d + 1e-6) / chunk)
    window = lambda a, b: F.struct(F.round(a, 2).alias("t0"), F.round(b, 2).alias("t1"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: window(i * F.lit(chunk), (i + 1) * F.lit(chunk)))
    tail = F.when(d - n * chunk >= chunk / 2, F.array(window(n * F.lit(chunk), d))).otherwise(F.array().cast(_WINDOWS))
    short = F.when(d >= 0.5, F.array(window(F.lit(0.0), d))).otherwise(F.array().cast(_WINDOWS))
    return F.when(d < chunk, short).otherwise(F.concat(full, tail))


def register_functions(spark: SparkSession) -> None:
    """Makes the table function chunk_grid(duration, seconds) known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunk_grid", udtf(ChunkGridRows, returnType="t0 double, t1 double", useArrow=True))


class ChunkGridRows:
    """chunk_grid of one row as a table function; rows travel in Arrow batches."""

    def eval(self, dur: float, chunk: float) -> Iterator[tuple[float, float]]:
        if dur is None or chunk is None:
            return
        d = min(float(dur), 60.0)
        n = int((d + 1e-6) // chunk)
        if d >= chunk:
            for i in range(n):
                yield round(i * chunk, 2), round((i + 1) * chunk, 2)
        if (d >= 0.5) if d < chunk else (d - n * chunk >= chunk / 2):
            yield (round(n * chunk, 2) if d >= chunk else 0.0), round(d, 2)


def _short(t: Column) -> Column:
    """A time as in row ids: without trailing zeros."""
    return F.regexp_replace(F.round(t, 2).cast("string"), r"\.0$", "")


def clip_rows(clips: DataFrame, grids: dict[str, float], cap: float = 60.0, hop: float = 0.0, hopped: str = "g3") -> DataFrame:
    """row_id, clip, grid, t0, t1: each clip itself and its windows on each grid; hop > 0 adds the grid `hopped` shifted by it."""
    whole = F.array(F.struct(F.lit("clip").alias("grid"), F.lit(0.0).alias("t0"), F.round(F.least("dur_s", F.lit(cap)), 2).alias("t1"), F.lit("clip").alias("part")))
    parts = [whole]
    for name, chunk in grids.items():
        parts.append(_tagged(chunk_grid(F.col("dur_s"), chunk, cap), name, 0.0))
    if hop:
        parts.append(_tagged(chunk_grid(F.greatest(F.least("dur_s", F.lit(cap)) - hop, F.lit(0.0)), grids[hopped], cap), hopped, hop))
    rows = clips.select("clip", F.explode(F.concat(*parts)).alias("w"))
    return rows.select(F.concat_ws(":", "clip", "w.part").alias("row_id"), "clip", "w.grid", "w.t0", "w.t1")


def _tagged(windows: Column, name: str, shift: float) -> Column:
    def row(w: Column) -> Column:
        t0 = w["t0"] + shift
        return F.struct(F.lit(name).alias("grid"), F.round(t0, 2).alias("t0"), F.round(w["t1"] + shift, 2).alias("t1"), F.concat(F.lit(name + ":"), _short(t0)).alias("part"))

    return F.transform(windows, row)


def window_starts(dur: Column, size: float = 3.0, hop: float = 1.5, most: int = 8) -> Column:
    """Starts of overlapping windows that fit, at least the one at 0, at most `most`."""
    n = F.greatest(F.floor((dur - size) / hop + 1e-9), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(most - 1).cast("long"))), lambda i: i * F.lit(hop))


def long_windows(dur: Column, size: float = 10.0, most: float = 60.0) -> Column:
    """Starts of consecutive windows of at most `most` seconds; a tail counts when it is longer than half a window. There is one at least."""
    d = F.least(F.greatest(dur, F.lit(1.0)), F.lit(most))
    n = F.greatest(F.ceil((d - size / 2) / size - 1e-9), F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: i * F.lit(size))


def centre_crop(dur: Column, size: float) -> Column:
    """Start of the window in a recording's middle; 0 where it is shorter."""
    return F.greatest(F.lit(0.0), (dur - size) / 2)


def event_window(first: Column, dur: Column, size: float, lead: float = 0.5) -> Column:
    """Start of a window from `lead` seconds before an event, shifted back so that it ends inside the recording."""
    return F.greatest(F.lit(0.0), F.least(F.greatest(first - lead, F.lit(0.0)), dur - size))


def hash_remainder(key: Column, n: int) -> Column:
    """The whole MD5 of a key as a number, modulo n (below 2^31); null counts as an empty key."""
    h = F.md5(F.coalesce(key, F.lit("")).cast("binary"))
    r = F.lit(0).cast("long")
    for i in range(4):  # eight hexadecimal digits at a time
        r = (r * (2**32 % n) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")) % n
    return r


def held_out_fold(key: Column, folds: int = 5) -> Column:
    """Whether a key falls in the fold that is held out, by its whole MD5."""
    return hash_remainder(key, folds) == 0


def validation_slice(clip: Column, share: float = 0.1, salt: str = "|val") -> Column:
    """Whether a clip of the training side is kept for validation: thousandths of a salted MD5, independent of the split itself."""
    return hash_bucket(F.concat(clip.cast("string"), F.lit(salt)), 1000) < F.lit(share) * 1000


def hash_bucket(key: Column, modulus: int) -> Column:
    """The first eight hexadecimal digits of the key's MD5, modulo `modulus`."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % modulus


def hash_split(key: Column, test: int = 100, val: int = 100, modulus: int = 1000) -> Column:
    """test / val / train, by key alone: the same for every row of a clip and in every run."""
    b = hash_bucket(key, modulus)
    return F.when(b < test, "test").when(b < test + val, "val").otherwise("train")


def audible(rows: DataFrame, least: float = 0.064) -> DataFrame:
    """Rows long enough for a model's first frame."""
    return rows.filter(F.col("t1") - F.col("t0") >= least)


def first_chunks(rows: DataFrame, n: int = 3, until: float = 30.0, by: tuple[str, ...] = ("clip", "grid")) -> DataFrame:
    """The first n chunks of each group that end inside `until` seconds, for groups with more than one."""
    w = W.partitionBy(*by)
    inside = rows.filter((F.col("grid") != "clip") & (F.col("t1") <= until))
    ranked = inside.withColumns({"_r": F.row_number().over(w.orderBy("t0")), "_n": F.count("*").over(w)})
    return ranked.filter((F.col("_n") > 1) & (F.col("_r") <= n)).drop("_r", "_n")


def project_spans(spans: DataFrame, rows: DataFrame, least: float = 0.5, bucket: float = 10.0) -> DataFrame:
    """(span_id, row_id) for chunk rows that a span overlaps by `least` seconds, or by half the span if that is shorter.

    An equi-join on clip and time bucket; the exact overlap is the residual. A pair meets in several buckets and counts in the first common one only.
    """
    cells = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))))
    s = cells(spans.select("span_id", "clip", "t0", "t1")).select("span_id", "clip", "_b", F.col("t0").alias("_s0"), F.col("t1").alias("_s1"))
    r = cells(rows.filter("grid != 'clip'").select("row_id", "clip", "t0", "t1"))
    both = F.least("_s1", "t1") - F.greatest("_s0", "t0")
    need = F.greatest(F.when(F.col("_s1") > F.col("_s0"), F.least(F.lit(least), (F.col("_s1") - F.col("_s0")) / 2)).otherwise(0.0), F.lit(1e-6))
    first = F.greatest(F.floor(F.col("_s0") / bucket), F.floor(F.col("t0") / bucket))
    return s.join(r.hint("merge"), ["clip", "_b"]).filter((both >= need) & (F.col("_b") == first)).select("span_id", "row_id")


def windows_overlapping(windows: DataFrame, open_spans: DataFrame, bucket: float = 10.0) -> DataFrame:
    """Windows that intersect an open span of their clip; all windows of clips without any."""
    cells = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))))
    o = cells(open_spans.select("clip", "t0", "t1")).select("clip", "_b", F.col("t0").alias("_o0"), F.col("t1").alias("_o1"))
    hit = cells(windows).alias("w").join(o.hint("merge"), ["clip", "_b"]).filter((F.col("w.t0") < F.col("_o1")) & (F.col("w.t1") > F.col("_o0")))
    hit = hit.select(*[f"w.{c}" if c != "clip" else "clip" for c in windows.columns]).distinct()
    return hit.unionByName(windows.join(open_spans.select("clip").distinct().hint("merge"), "clip", "left_anti"))
