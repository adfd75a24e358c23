"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words adds, over all character triples that both hold in order, DECAY to the power of the triples' gaps. So an insult still resembles
itself with characters inserted, left out, or spaced out. Landmarks are strings of the labelled sentences; a sentence's features are its words' best kernel values with each of them, turned
into Nyström coordinates; a linear machine with hinge loss is trained on labelled sentences, and a document scores as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

DECAY, SPAN, LETTERS, WIDTH = 0.6, 7, 32, 32
#: A word whose kernel with every toxic landmark is surely below this, inserted letters left out, has no features.
ACTIVE = 0.55
#: A word that holds a toxic string in order, with up to so many other letters inside, counts as the word without these, at EXTRA for each.
INSERTED, EXTRA = 3, 0.9
#: Kernel values are raised to this power, which keeps them a kernel and tells near from far.
POWER = 3
#: Bounds of the fit: labelled documents of each class, sentences for the machine, landmarks.
FIT_TOXIC, FIT_CLEAN, FIT_SENTENCES, LANDMARKS = 3000, 6000, 20_000, 96
#: Distinct words that a Python worker remembers at most.
HELD = 800_000
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


#: ASCII marks and digits, which words lose.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalpha())
#: Code of a Latin-1 character, 1 .. LETTERS - 1; characters beyond have their place in their block, so that neighbours in an alphabet differ.
_CODES = np.array([c - 96 if 97 <= c <= 122 else 27 + c % 5 for c in range(256)], np.int64)


def _coded(points: np.ndarray) -> np.ndarray:
    return np.where(points < 256, _CODES[np.minimum(points, 255)], 1 + points % (LETTERS - 1))


#: By length of a word: the sum of squared weights of its triples.
_SQUARES = np.array([sum(max(0, n - b) * DECAY ** (2 * (b - 2)) for _, b in _OFFSETS) for n in range(WIDTH + 1)])


def _code(ch: str) -> int:
    return int(_CODES[ord(ch)]) if ord(ch) < 256 else 1 + ord(ch) % (LETTERS - 1)


def _points(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def words_of(sentence: str) -> list[str]:
    """Lower-case words of three letters or more, without ASCII marks and digits inside; runs of three or more single letters are also joined into one."""
    raw = sentence.lower().encode("utf-8", "replace").translate(None, _MARKS).decode("utf-8", "replace").split()
    out = [w for w in raw if len(w) > 2]
    ones = [i for i, w in enumerate(raw) if len(w) == 1]
    if len(ones) > 2:
        start = 0
        for k in range(1, len(ones) + 1):
            if k == len(ones) or ones[k] != ones[k - 1] + 1:
                if k - start > 2:
                    out.append("".join(raw[i] for i in ones[start:k]))
                start = k
    return out


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes, one row for each word, or for each stretch of WIDTH letters (overlapping by SPAN) of a longer one; and each row's word."""
    parts, of = [], []
    for i, w in enumerate(words):
        for lo in range(0, max(1, len(w) - SPAN), WIDTH - SPAN):
            parts.append(w[lo : lo + WIDTH])
            of.append(i)
    x = np.zeros((len(parts), WIDTH), np.int64)
    for i, p in enumerate(parts):
        x[i, : len(p)] = [_code(c) for c in p]
    return x, np.array(of, np.int64)


def triples(x: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of gaps: the key of the triple at each place (0: none) and its weight."""
    for a, b in _OFFSETS:
        first, second, third = x[:, : WIDTH - b], x[:, a : WIDTH - b + a], x[:, b:]
        yield np.where((first > 0) & (second > 0) & (third > 0), (first * LETTERS + second) * LETTERS + third, 0), DECAY ** (b - 2)


def norms(x: np.ndarray) -> np.ndarray:
    """The square root of the kernel of each row with itself."""
    out = np.zeros(len(x))
    keys, weights = zip(*((k, np.full(k.shape, w)) for k, w in triples(x)), strict=True)
    k, w = np.concatenate(keys, 1), np.concatenate(weights, 1)
    by = np.argsort(k, 1)
    k, w = np.take_along_axis(k, by, 1), np.take_along_axis(w, by, 1)
    for i in range(len(x)):
        u, at = np.unique(k[i], return_index=True)
        s = np.add.reduceat(w[i], at)
        out[i] = np.sqrt((s[u > 0] ** 2).sum())
    return np.maximum(out, 1e-9)


def profile(landmarks: list[str]) -> np.ndarray:
    """[keys, landmarks]: the landmarks' normalised triple weights."""
    x, _ = codes([w[:WIDTH] for w in landmarks])
    out = np.zeros((LETTERS**3, len(landmarks)), np.float32)
    for k, w in triples(x):
        for j in range(len(landmarks)):
            np.add.at(out[:, j], k[j][k[j] > 0], w)
    return out / np.maximum(np.sqrt((out**2).sum(0)), 1e-9)


def kernel(words: list[str], prof: np.ndarray) -> np.ndarray:
    """[words, landmarks]: normalised kernel values; a long word has the best of its stretches."""
    out = np.zeros((len(words), prof.shape[1]), np.float32)
    for lo in range(0, len(words), 2000):
        x, of = codes(words[lo : lo + 2000])
        v = np.zeros((len(x), prof.shape[1]), np.float32)
        for k, w in triples(x):
            for j in range(k.shape[1]):
                if k[:, j].any():
                    v += np.float32(w) * prof[k[:, j]]
        np.maximum.at(out, of + lo, v / norms(x)[:, None].astype(np.float32))
    return out


def _bounds(words: list[str], most: np.ndarray) -> np.ndarray:
    """For each word of at most WIDTH letters an upper bound of its kernel with any landmark, from the landmarks' greatest weights; 1 for longer words.

    All words lie in one array with SPAN - 1 zeros between them, which no triple can cross. The norm is at least what it would be if no triple occurred twice.
    """
    size = np.array([len(w) for w in words])
    flat = _points(("\0" * (SPAN - 1)).join(words) + "\0" * SPAN)
    x = np.where(flat > 0, _coded(flat), 0).astype(np.int32)
    n = len(x) - SPAN
    total = np.zeros(n + 1, np.float32)
    for a, b in _OFFSETS:
        total[:n] += np.float32(DECAY ** (b - 2)) * most[(x[:n] * LETTERS + x[a : n + a]) * LETTERS + x[b : n + b]]
    starts = np.concatenate([[0], np.cumsum(size[:-1] + SPAN - 1)])
    sums = np.add.reduceat(total, np.minimum(starts, n))
    return np.where(size > WIDTH, 1.0, sums / np.sqrt(np.maximum(_SQUARES[np.minimum(size, WIDTH)], 1e-9)))


def _masks(words: list[str]) -> np.ndarray:
    """For each word the set of its letters' codes, as bits."""
    size = np.array([len(w) + 1 for w in words])
    bits = np.int64(1) << _coded(_points("\0".join(words) + "\0"))
    return np.bitwise_or.reduceat(bits, np.cumsum(size) - size)


def _without_inserted(word: str, landmark: str) -> tuple[str, int]:
    """The word with its shortest stretch that holds the landmark's letters in order replaced by the landmark, and how many letters that leaves out; -1: none."""
    best, at = -1, -1
    begin = [-1] * len(landmark)  # where the latest match of the landmark's first letters begins
    for i, ch in enumerate(word):
        for j in range(len(landmark) - 1, -1, -1):
            if landmark[j] == ch:
                begin[j] = begin[j - 1] if j else i
        if begin[-1] >= 0 and ch == landmark[-1]:
            extra = i + 1 - begin[-1] - len(landmark)
            if best < 0 or extra < best:
                best, at = extra, begin[-1]
    return (word[:at] + landmark + word[at + len(landmark) + best :], best) if best >= 0 else (word, -1)


@dataclass
class Model:
    landmarks: list[str]
    toxic: int  # the first so many landmarks are toxic
    mean: float
    scale: float
    weights: np.ndarray  # of the kernel values: the machine's weights times the Nyström map
    bias: float
    strings: tuple[str, ...] = ()  # toxic strings that are looked for with letters inserted; the toxic landmarks if there are none

    def ready(self) -> Model:
        self.prof = profile(self.landmarks) if self.landmarks else np.zeros((LETTERS**3, 0), np.float32)
        top = self.prof[:, : self.toxic]
        self.most = top.max(1) if self.toxic else np.zeros(LETTERS**3, np.float32)
        self.whole = [w for w in self.strings or self.landmarks[: self.toxic] if 4 <= len(w) <= WIDTH]
        self.letters = _masks(self.whole) if self.whole else np.zeros(0, np.int64)
        self.known: dict[str, np.ndarray | None] = {}
        self.seen: set[str] = set()
        return self

    def inserted(self, words: list[str]) -> dict[str, np.ndarray]:
        """For words that hold a toxic string with 1 .. INSERTED letters inside: the kernel values of the word without these, if it is active, less EXTRA for each."""
        found: dict[str, list[tuple[str, int]]] = {}
        masks = _masks(words)
        for string, letters in zip(self.whole, self.letters, strict=True):
            for i in np.flatnonzero(masks & letters == letters).tolist():
                if len(words[i]) > len(string):
                    short, n = _without_inserted(words[i], string)
                    if 0 < n <= INSERTED:
                        found.setdefault(words[i], []).append((short, n))
        if not found:
            return {}
        short = list({s for hits in found.values() for s, _ in hits})
        value = {s: v for s, v in zip(short, kernel(short, self.prof), strict=True) if v[: self.toxic].max(initial=0) >= ACTIVE}
        return {w: np.max(v, 0) for w, hits in found.items() if (v := [value[s] * np.float32(EXTRA**n) for s, n in hits if s in value])}

    def learn(self, every: set[str]) -> None:
        """Remembers the kernel values of the active ones among new words; the rest can't resemble a toxic landmark.

        every: all words of the texts that come next, those seen before too, which are learned anew when memory was full.
        """
        words = list(every - self.seen)
        if words and len(self.seen) > HELD:
            self.seen.clear()
            self.known.clear()
            words = list(every)
        self.seen.update(words)
        for lo in range(0, len(words), 4000):
            part = words[lo : lo + 4000]
            less = self.inserted(part)
            near = [w for w, y in zip(part, _bounds(part, self.most) >= ACTIVE, strict=True) if y or w in less]
            if near:
                for w, v in zip(near, kernel(near, self.prof), strict=True):
                    if w in less or v[: self.toxic].max(initial=0) >= ACTIVE:
                        v = np.maximum(v, less[w]) if w in less else v
                        self.known[w] = v**POWER

    def features(self, text: str, words: set[str]) -> list[np.ndarray]:
        """The best kernel values of each sentence that has an active word; words: those of the text, learned before."""
        if self.known.keys().isdisjoint(words):
            return []
        out = []
        for sentence in _SENTENCE.split(text):
            if hit := [self.known[w] for w in words_of(sentence) if w in self.known]:
                out.append(np.max(hit, 0))
        return out or [np.max([self.known[w] for w in words if w in self.known], 0)]  # a run across sentences

    def scores(self, texts: list[str], raw: bool = False, step: int = 512) -> list[float]:
        """Each text's worst sentence, as a decision value or a probability."""
        out = []
        for lo in range(0, len(texts), step):
            part = texts[lo : lo + step]
            words = [set(words_of(t)) for t in part]
            self.learn(set().union(*words))
            for t, w in zip(part, words, strict=True):
                z = max([self.bias, *(float(v @ self.weights) + self.bias for v in self.features(t, w))])
                out.append(z if raw else float(1 / (1 + np.exp(-np.clip((z - self.mean) * self.scale, -30, 30)))))
        return out


def held_out(modulus: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            for s in _SENTENCE.split(text or ""):
                if w := words_of(s):
                    joined = " ".join(w)
                    rows.append((xxhash.xxh3_64_intdigest(joined) >> 1, y, joined))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["h", "y", "words"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of sentences with each word, and each word's beginning, by label."""
    held = (Counter(), Counter())
    for batch in batches:
        for y, words in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist(), strict=True):
            held[y].update({p for w in words.split() for p in (w, w[:4], w[:5], w[:6])})
    rows = [(w, y, n) for y in (0, 1) for w, n in held[y].items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["s", "y", "n"])


def _diverse(ranked: list[str], most: int, limit: float) -> list[str]:
    """The first strings, leaving out those too like an earlier one."""
    out: list[str] = []
    if ranked:
        k = kernel(ranked, profile(ranked))
        taken: list[int] = []
        for i in range(len(ranked)):
            if len(taken) < most and (not taken or k[i, taken].max() < limit):
                taken.append(i)
        out = [ranked[i] for i in taken]
    return out


def fit(sample: DataFrame) -> Model:
    """A model from labelled documents (doc_id, text, y). Copies of a sentence count once; one that a clean document holds is clean.

    Candidate landmarks are strings of toxic sentences that clean ones lack (by the likelihood ratio of their counts); at most 400 reach the driver, then 20,000 common strings and at most FIT_SENTENCES sentences as vectors.
    """
    s = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(_sentences, "h long, y int, words string")
    s = stage(s.groupBy("h").agg(F.min("y").alias("y"), F.min("words").alias("words")), "toxic-sentences")
    size = {r["y"]: r["n"] for r in s.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    nothing = Model([], 0, 0.0, 1.0, np.zeros(0), -4.0)
    if not n1 or not n0:
        return nothing
    c = s.select("y", "words").mapInArrow(_strings, "s string, y int, n long").groupBy("s").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    c = c0 = stage(c.filter("a + b >= 3"), "toxic-strings")
    c = c.filter((F.length("s") >= 4) & (F.col("a") >= 4) & (F.col("a") * n0 >= (F.col("b") + 0.25) * 8 * n1))
    share, e = n1 / (n1 + n0), F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (e * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (e * (1 - share)))).otherwise(0.0))
    found = c.withColumn("g", ratio).filter("g > 15").orderBy(F.desc("g"), F.desc(F.length("s")), "s").limit(400).collect()
    found = [r for r in found if r["g"] >= 0.03 * found[0]["g"]]
    toxic = _diverse([r["s"] for r in found], LANDMARKS // 2, 0.6)
    if not toxic:
        return nothing
    model = Model(toxic, len(toxic), 0.0, 1.0, np.zeros(len(toxic)), 0.0, tuple(r["s"] for r in found)).ready()
    # clean words that resemble a toxic landmark, and the most common ones, are landmarks too
    words = c0.filter("b >= 3").orderBy(F.desc("b"), "s").limit(20_000).collect()
    model.learn({r["s"] for r in words})
    near = [r["s"] for r in words if r["s"] in model.known]
    model.landmarks = toxic + _diverse(near[: LANDMARKS * 4], LANDMARKS // 4, 0.8) + [r["s"] for r in words[: LANDMARKS // 8] if r["s"] not in near]
    # the machine's sentences: those with an active word, from all of the sample
    near = stage(s.mapInArrow(_featured(model), "h long, y int, x array<float>"), "toxic-vectors")
    some = lambda y: near.filter(F.col("y") == y).orderBy(F.xxhash64("h"), "h").limit(FIT_SENTENCES // 2)
    rows = some(0).unionByName(some(1)).collect()
    if not any(r["y"] for r in rows):
        return nothing
    x, y = np.array([r["x"] for r in rows], float), np.array([1.0 if r["y"] else -1.0 for r in rows])
    x, y = np.vstack([x, np.zeros((1, x.shape[1]))]), np.append(y, -1.0)  # a sentence without any is clean
    mm = kernel(model.landmarks, profile(model.landmarks)).astype(float) ** POWER
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    keep = values > 1e-3
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    z = np.hstack([x @ nystrom, np.ones((len(x), 1))])
    # squared hinge loss with an L2 penalty (not on the bias), by accelerated gradient steps
    lam = np.append(np.full(z.shape[1] - 1, 1e-4), 0.0)
    step = 1 / (2 * np.linalg.eigvalsh(z.T @ z / len(y)).max() + 1e-4)
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(800):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (lam * v - 2 * ((slack * y) @ z) / len(y))
        v = new + t / (t + 3) * (new - w)
        w = new
    model = Model(model.landmarks, model.toxic, 0.0, 1.0, nystrom @ w[:-1], float(w[-1]), model.strings)
    # the documents' own threshold: between the sample's toxic and clean documents, where the fewest are wrong
    got = sample.select("doc_id", F.col("y").cast("boolean").alias("held_out"), "text").mapInArrow(_scored(model, raw=True), "doc_id long, held_out boolean, score double").select("held_out", "score").collect()  # a row per document of the bounded sample
    at = np.array(sorted((r["score"], r["held_out"]) for r in got))
    wrong = np.concatenate([[0], np.cumsum(at[:, 1])]) + (at[:, 1] == 0).sum() - np.concatenate([[0], np.cumsum(at[:, 1] == 0)])
    edges = np.concatenate([[at[0, 0] - 1], (at[1:, 0] + at[:-1, 0]) / 2, [at[-1, 0] + 1]])
    free = np.concatenate([[True], at[1:, 0] > at[:-1, 0], [True]])
    least = np.flatnonzero(free & (wrong == wrong[free].min()))
    model.mean, model.scale = float(edges[least[len(least) // 2]]), 4.0
    return model


def _featured(model: Model):
    """Sentences with an active word, as their best kernel values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.ready()
        for batch in batches:
            split = [w.split() for w in batch.column("words").to_pylist()]
            own.learn({w for ws in split for w in ws})
            rows = [(h, y, np.max(hit, 0).tolist()) for h, y, ws in zip(batch.column("h").to_pylist(), batch.column("y").to_pylist(), split, strict=True) if (hit := [own.known[w] for w in ws if w in own.known])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int64(), pa.int32(), pa.list_(pa.float32())), strict=True)], ["h", "y", "x"])

    return run


def _scored(model: Model, raw: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.ready()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(own.scores([t or "" for t in batch.column("text").to_pylist()], raw), pa.float64())], ["doc_id", "held_out", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled rows that aren't held out: at most FIT_TOXIC toxic and FIT_CLEAN clean documents, those with the least hash of their id. Null and empty texts have a low score; of several labels for an
    id the greatest counts, of several texts the least; null labels and ids are ignored. Without toxic examples all scores are low. Texts are scored whole.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    pick = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = stage(pick(1, FIT_TOXIC).unionByName(pick(0, FIT_CLEAN)), "toxic-chosen")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(stage(text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")), "toxic-sample"))
    return text.withColumn("held_out", held_out()).mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
