"""Mixture-controlled packing: deficit round-robin over source queues, in closed form, so that every task places its own tokens.

In each window every source queue may send its quantum, so that the window holds the target token proportions; what is less than the smallest piece stays as a
deficit for later windows. The tokens that source s has sent before window r are therefore A_s(r) = min(T_s, floor(q_s * r / m) * m), whatever partition they come from, and
that alone fixes the place of every token.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, stage

#: Id after each document.
END = 1
#: Encoded words that a Python worker keeps at most.
HELD = 200_000


class _Words(dict):
    """Ids, as little-endian bytes, of words as they stand after a space, or at a line's start."""

    def __init__(self, encode, lead: str) -> None:
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if not word or not word.isprintable():  # other white space isn't printable
            raise ValueError("not a word")
        out = array("I", self.encode(self.lead + word)).tobytes()
        if len(self) < HELD:  # what comes early is the common words; the rest is encoded anew each time
            self[word] = out
        return out


class Encoder:
    """The public byte-level BPE vocabulary, from its rank file; equal ids to those of its `tokenizers` form.

    The vocabulary's pattern never joins what a single space or line break between two other characters separates, so texts without
    longer white space are encoded word by word, from a cache; all others whole. added: tokens found in texts as they stand, which split them;
    without it their strings are ordinary text.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None) -> None:
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = _Words(self.whole, ""), _Words(self.whole, " ")
        self.line = np.array(self.whole("\n"), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if x in self.added else self.piece(x) for x in self.split(text))
        return self.piece(text)

    def piece(self, text: str) -> bytes:
        if not text:
            return b""
        parts: list[bytes] = []
        first, later = self.first, self.later
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                parts += (self.line, first[words[0]])
                parts += map(later.__getitem__, words[1:])
        except ValueError:
            return np.array(self.whole(text), "<u4").tobytes()
        return b"".join(parts[1:])


@lru_cache(2)
def encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(path, dict(added))


def added_tokens() -> tuple[tuple[str, int], ...]:
    """The vocabulary's added tokens, which `tokenizers` finds in texts whatever add_special_tokens says."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("added tokens that aren't matched as they stand")
    return tuple((t["content"], t["id"]) for t in found)


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoded(path: str, added: tuple[tuple[str, int], ...]):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, sent = encoder(path, added), TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                ids = [encode(t or "") + end for t in b.column("text").to_pylist()]
                at, sources = [], b.column("source").to_pylist()
                for s, x in zip(sources, ids, strict=True):
                    at.append(sent.get(s, 0))
                    sent[s] = at[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([pid] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "pid", "at", "n", "ids"])

    return run


class Layout:
    """Where each token of each source goes. totals and quanta: by source, in order; m: the smallest piece; rounds: the number of windows."""

    def __init__(self, totals: np.ndarray, quanta: np.ndarray, m: int, rounds: int) -> None:
        self.totals, self.quanta, self.m, self.rounds = totals, quanta, m, rounds
        self.sent = lru_cache(4096)(self._sent)

    def _sent(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Before window r: tokens sent by source; and the global place where each source's part of the window begins."""
        now, then = (self.totals if x >= self.rounds else np.minimum(self.totals, np.floor(self.quanta * x / self.m).astype(np.int64) * self.m) for x in (r, r + 1))
        parts = then - now
        return now, now.sum() + np.cumsum(parts) - parts

    def window(self, s: int, p: int) -> int:
        """The window of source s that sends its token p."""
        q = self.quanta[s]
        r = min(self.rounds - 1, max(0, int((p // self.m + 1) * self.m / q) - 2)) if q > 0 else self.rounds - 1
        while r > 0 and self.sent(r)[0][s] > p:
            r -= 1
        while r + 1 < self.rounds and self.sent(r + 1)[0][s] <= p:
            r += 1
        return r

    def pieces(self, s: int, p: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(start, size, global place) of the pieces of a document that takes tokens p .. p + n - 1 of source s."""
        done, r = 0, self.window(s, p)
        while done < n:
            now, place = self.sent(r)
            upto = self.sent(r + 1)[0][s]
            if upto <= p + done:
                r = self.window(s, p + done)
                continue
            g = int(place[s] + p + done - now[s])
            size = min(n - done, int(upto) - p - done, length - g % length)
            yield done, size, g
            done += size


def _placed(plan: tuple, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(*plan)
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "k", "first", "n", "ids")]
            for doc, k, first, n, ids in zip(*cols, strict=True):
                ids = memoryview(ids)
                for start, size, g in layout.pieces(k, first, n, length):
                    rows.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, g // length, g % length))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = 2048, window: int = 32, smallest: int = 512, weights: dict[str | None, float] | None = None, ranks: str | None = None, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A window is `window` sequences. weights: token proportions of the sources; by default those of their totals, which lets all queues end together. When a queue is
    empty the others go on in their proportions. `smallest` tokens is the piece below which a source waits for a later window. All sequences are full but the last one.
    Null texts hold the end mark only, as empty ones do; a null source is a queue of its own; ids may be null or repeat; an empty table gives no pieces.
    added: (string, id) of tokens found in texts as they stand, see added_tokens(); by default such strings are ordinary text.

    Tokens are encoded once and written out; the layout needs one sum per task and source. The driver sees one row per source.
    """
    path = ranks or ranks_path()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(_encoded(path, added), "doc_id long, source string, pid int, at long, n long, ids binary")
    ids = stage(ids, "pack-ids", "zstd")
    per = ids.groupBy("pid", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source")).agg(F.sum("n").alias("n"))
    per = stage(per, "pack-sums")
    before = W.partitionBy("_null", "_source").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    base = per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    sources = sorted(per.groupBy("_null", "_source").agg(F.sum("n").alias("n")).collect())
    named = [None if r["_null"] else r["_source"] for r in sources]
    totals = np.array([r["n"] for r in sources], np.int64)
    size = window * length
    if weights is None:
        rounds = max(1, -(-int(totals.sum()) // size))
        quanta = totals / rounds
    else:
        w = np.array([weights.get(s, 0.0) for s in named], float)
        quanta = size * w / max(w.sum(), 1e-300)
        rounds = 1 + max([0, *(int(-(-t // q)) for t, q in zip(totals, quanta, strict=True) if q > 0)]) + smallest
    order = docs.sparkSession.createDataFrame([(bool(r["_null"]), r["_source"], i) for i, r in enumerate(sources)], "_null boolean, _source string, k int")
    base = attach(base, order, ["_null", "_source"], "inner")
    at = attach(ids.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}), base, ["pid", "_null", "_source"], "inner")
    at = at.select("doc_id", "k", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    return at.mapInArrow(_placed((totals, quanta, smallest, rounds), length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
