"""Language of whole texts: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. In each, one network reads forwards and one backwards; both states at a position give the probabilities of the languages there, and a document's
are the mean over all its positions. Windows make memory independent of the texts' lengths, and every byte is labelled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, stage

#: Bytes in a window; states of each direction; windows that are read at once.
WINDOW, STATES, LANES = 128, 8, 2048
#: Bounds of the fit: languages (the most frequent ones), documents of each and in all, windows of a document, steps and their size.
LANGUAGES, EACH, DOCUMENTS, WINDOWS, STEPS, BATCH, RATE = 256, 400, 8_000, 6, 350, 128, 0.02


@dataclass
class Network:
    """Weights of both directions, stacked: input (2, 3H, 256), recurrent (2, 3H, H), their biases (2, 3H, 1) each, output (C, 2H) and its bias (C, 1). Gates in the order reset, update, candidate."""

    names: list[str]
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(names: list[str], seed: int = 5, states: int = STATES) -> Network:
        r, h, c = np.random.default_rng(seed), states, len(names)
        some = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        u = np.stack([np.concatenate([np.linalg.qr(r.standard_normal((h, h)))[0] for _ in range(3)]) for _ in range(2)]).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return Network(names, {"x": some(2, 3 * h, 256, by=0.3), "u": u, "b": zero(2, 3 * h, 1), "c": zero(2, 3 * h, 1), "o": some(c, 2 * h, by=0.3), "d": zero(c, 1)})

    @property
    def states(self) -> int:
        return self.w["u"].shape[2]


def windows_of(start: np.ndarray, size: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of the windows of texts that lie at `start` with `size` bytes; an empty text has none."""
    n = -(-size // length)
    text = np.repeat(np.arange(len(size)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * length
    return text, start[text] + first, np.minimum(length, size[text] - first)


def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, inside), each (longest, windows): where the backward reader is at each of its steps, and which steps lie in the window. It starts at a window's own end, so what lies beyond is never read before."""
    t = np.arange(size.max(initial=0))[:, None]
    return np.maximum(size[None, :] - 1 - t, 0), t < size[None, :]


def forward(net: Network, x: np.ndarray, size: np.ndarray, keep: bool = False):
    """Probabilities (steps, languages, windows) by position, from bytes x (steps, windows); with keep also what backward() needs."""
    w, h, (steps, n) = net.w, net.states, x.shape
    back, inside = places(size)
    table = w["x"] + w["b"]
    state = np.zeros((2, h, n), np.float32)
    out = np.empty((2, steps, len(net.names), n), np.float32)
    held = []
    both = np.stack([x, np.take_along_axis(x, back, 0)], 1)  # (steps, 2, windows)
    ways = [np.ascontiguousarray(w["o"][:, :h]), np.ascontiguousarray(w["o"][:, h:])]
    a, g = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
    for t in range(steps):
        if keep:
            a, g = np.empty_like(a), np.empty_like(g)
        for d in range(2):
            np.take(table[d], both[t, d], axis=1, out=a[d], mode="clip")
        np.matmul(w["u"], state, out=g)
        g += w["c"]
        # both gates are logistic, written with tanh
        gate = a[:, : 2 * h]
        gate += g[:, : 2 * h]
        gate *= 0.5
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        cand = a[:, 2 * h :]
        cand += gate[:, :h] * g[:, 2 * h :]
        np.tanh(cand, out=cand)
        new = state - cand
        new *= gate[:, h:]
        new += cand
        if keep:
            held.append((state, a, g, new))
        state = new
        for d in range(2):
            np.matmul(ways[d], state[d], out=out[d, t])
    logits = out[0] + np.take_along_axis(out[1], back[:, None, :], 0) + w["d"]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return (logits, held, both, back, inside) if keep else (logits, inside)


def backward(net: Network, x: np.ndarray, size: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross-entropy over all positions, where each has its window's language, and its gradients, back through all steps."""
    w, h = net.w, net.states
    p, held, both, back, inside = forward(net, x, size, keep=True)
    steps, c, n = p.shape
    total = inside.sum()
    loss = -float(np.log(np.maximum(np.take_along_axis(p, np.broadcast_to(gold[None, None, :], (steps, 1, n)), 1)[:, 0], 1e-30))[inside].sum() / total)
    e = p - (np.arange(c)[None, :, None] == gold[None, None, :])
    e = (e * inside[:, None, :] / total).astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["d"] += e.sum((0, 2))[:, None]
    # what the backward reader gave at a step was used at another place
    ways = [e, np.take_along_axis(e, back[:, None, :], 0) * inside[:, None, :]]
    dh = np.zeros((2, h, n), np.float32)
    place = np.empty((2, steps, 3 * h, n), np.float32)
    for t in range(steps - 1, -1, -1):
        state, a, g, new = held[t]
        for d in range(2):
            grad["o"][:, d * h : (d + 1) * h] += ways[d][t] @ new[d].T
            dh[d] += w["o"][:, d * h : (d + 1) * h].T @ ways[d][t]
        r, z, cand = a[:, :h], a[:, h : 2 * h], a[:, 2 * h :]
        dc = dh * (1 - z) * (1 - cand * cand)
        dz = dh * (state - cand) * z * (1 - z)
        dr = dc * g[:, 2 * h :] * r * (1 - r)
        da = np.concatenate([dr, dz, dc], 1)
        dg = np.concatenate([dr, dz, dc * r], 1)
        place[:, t] = da
        grad["u"] += dg @ state.transpose(0, 2, 1)
        grad["c"] += dg.sum(2, keepdims=True)
        dh = dh * z + w["u"].transpose(0, 2, 1) @ dg
    for d in range(2):
        flat, seen = place[d].transpose(1, 0, 2).reshape(3 * h, -1), both[:, d].reshape(-1)
        order = np.argsort(seen, kind="stable")
        value, first = np.unique(seen[order], return_index=True)
        grad["x"][d][:, value] = np.add.reduceat(flat[:, order], first, axis=1)
        grad["b"][d] += flat.sum(1, keepdims=True)
    return loss, grad


def train(windows: list[tuple[str, bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> Network:
    """A network from (language, bytes) windows; each language is drawn equally often. Adam, with a falling rate and clipped gradients."""
    names = sorted({name for name, _ in windows})
    net, r = Network.new(names, seed), np.random.default_rng(seed)
    of = {name: [b for other, b in windows if other == name and b] for name in names}
    names_with = [i for i, name in enumerate(names) if of[name]]
    if len(names) < 2 or not names_with:
        return net
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for t in range(1, steps + 1):
        gold = np.array([names_with[i % len(names_with)] for i in range(max(batch, len(names_with)))])
        some = [of[names[i]][r.integers(len(of[names[i]]))] for i in gold]
        size = np.array([len(b) for b in some])
        x = np.zeros((size.max(), len(some)), np.intp)
        for i, b in enumerate(some):
            x[: len(b), i] = np.frombuffer(b, np.uint8)
        _, grad = backward(net, x, size, gold)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.w[k] -= np.float32(rate * (1 - t / (steps + 1))) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def probabilities(net: Network, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(texts, languages): the mean over all positions of each text, given its place in the bytes `data`; an empty text has zeros."""
    c = len(net.names)
    total = np.zeros((len(size), c))
    text, start_of, size_of = windows_of(start, size)
    order = np.argsort(-size_of, kind="stable")  # windows of like sizes together
    lanes = max(64, min(LANES, (1 << 22) // (WINDOW * max(c, 4))))
    for lo in range(0, len(order), lanes):
        at = order[lo : lo + lanes]
        t = np.arange(size_of[at[0]])[:, None]
        x = data[np.minimum(start_of[at][None, :] + t, len(data) - 1)].astype(np.intp)
        p, inside = forward(net, x, size_of[at])
        if size_of[at[-1]] < len(t):
            p *= inside[:, None, :]
        np.add.at(total, text[at], p.sum(0).T)
    return total / np.maximum(size, 1)[:, None]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column as they lie in its buffer, with each text's start and size; null texts have size 0."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    return data, ends[:-1], size


def held_out(modulus: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def _windows(most: int):
    """Up to `most` windows of each text, spread over the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = text.encode()
                n = -(-len(b) // WINDOW)
                for k in sorted({i * n // most for i in range(most)}) if n else []:
                    rows.append((name, b[k * WINDOW : (k + 1) * WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "w"])

    return run


def fit(docs: DataFrame) -> Network | None:
    """A network from documents (doc_id, text, lang) that have a language and a letter.

    The LANGUAGES most frequent languages, and of each the EACH documents (fewer where that makes over DOCUMENTS in all) with the least hash of id, language and text, WINDOWS windows of each.
    Rows that agree in all three count once. A hash bound made from the counts comes first, so that no language's rows are ranked whole.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    count = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = [(r["lang"], r["n"]) for r in count.collect()]
    if not counts:
        return None
    each = min(EACH, DOCUMENTS // len(counts))
    spark = docs.sparkSession
    # a bound on the hash that lets through about twice as many as are taken, or all
    share = {name: (2 * each + 50) / n for name, n in counts}
    bound = [(name, int(2**64 * f) - 2**63 if f < 1 else 2**63 - 1) for name, f in share.items()]
    h = known.withColumn("h", F.xxhash64("doc_id", "lang", "text"))
    h = h.join(F.broadcast(spark.createDataFrame(bound, "lang string, bound long")), "lang").filter(F.col("h") <= F.col("bound"))
    few = h.select("lang", "h", "doc_id", "text").dropDuplicates(["lang", "h"])
    few = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= each)
    with arrow_batches(spark, 200):
        windows = few.select("lang", "text").mapInArrow(_windows(WINDOWS), "lang string, w binary").orderBy("lang", "w").collect()
    return train([(r["lang"], bytes(r["w"])) for r in windows])


def _predicted(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*net.names, "und"], pa.string())
        for batch in filter(len, batches):
            data, start, size = text_bytes(batch.column("text"))
            size = np.where(batch.column("letters").to_numpy(zero_copy_only=False), size, 0)
            p = probabilities(net, data, start, size)
            best = np.where(size > 0, p.argmax(1), len(net.names))
            score = np.where(size > 0, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), names.take(pa.array(best)), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from rows with a language that aren't held out (crc32 of the id, modulo 3, isn't 1; null ids may be learned from), within the bounds of fit(). lang_pred is the learned language with the highest mean probability over all positions of
    the whole text, ties to the first in order of names, and score that probability; `und` and 0 where the text is null or has no letter, or where nothing was learned. With one language learned, it is every answer.
    Only doc_id, text and lang are read, and lang by the fit alone. Repeated rows get equal answers, unless they differ in text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    net = fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "held_out", "text", letters.alias("letters"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predicted(net), "doc_id long, held_out boolean, lang_pred string, score double")
