"""Quality rules by distribution divergence: character classes and common words against language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, stage
from .textstats import CLASSES, base_stats, char_classes, word_hashes

#: Common words of a language in its reference histogram; all other words are one more bin.
COMMON = 40
#: A document fails when its distance to every reference is above these; shorter ones than the guards aren't compared.
CHAR_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_WORDS = 0.14, 0.45, 200, 50
#: A language has a reference from so many documents and words on (of documents long enough to be compared); all others share one.
REFERENCE_DOCS, REFERENCE_WORDS = 20, 2000
#: A reference must look like language: letters make up such a share of what isn't space in its median document, and, where at least SPACED of the characters are spaces, common words make up a share of all words.
LETTERS, SPACED, COVERED = 0.5, 0.08, 0.05
#: Bins of the character histogram; letters and digits are one, so that names, numbers and addresses in prose don't count against it.
BINS = ("letter", "upper", "space", "stop", "mark")
#: Distinct words that a task counts before it hands its counts on.
HELD = 300_000


def char_histogram(b: bytes) -> np.ndarray:
    c = dict(zip(CLASSES, (char_classes(b) / len(b)).tolist(), strict=True))
    return np.array([c["lower"] + c["wide"] + c["digit"], *[c[k] for k in BINS[1:]]])


def letter_share(b: bytes) -> float:
    """Letters of either case and bytes beyond ASCII among all that isn't white space."""
    c = dict(zip(CLASSES, char_classes(b).tolist(), strict=True))
    return (c["lower"] + c["upper"] + c["wide"]) / max(1, len(b) - c["space"])


def like_language(letters: float, space: float, covered: float) -> bool:
    """Whether a reference's median share of letters, share of spaces and share of common words are those of a language; scripts that don't part words by spaces need no common words."""
    return letters >= LETTERS and (space < SPACED or covered >= COVERED)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, key, n) of words, and of all words and documents under keys that no word can have."""
    held: dict = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, k, n) for lang, c in held.items() for k, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            b = (text or "").encode()
            words = b.lower().split()
            if len(words) < MIN_WORDS:
                continue
            c = held.setdefault(lang, Counter())
            c.update(words)
            c[b" words"] += len(words)
            c[b" docs"] += 1
        if sum(map(len, held.values())) > HELD:
            yield out()
    yield out()


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the character classes, and of letters in what isn't space, in each text of at least MIN_CHARS bytes."""
    for batch in batches:
        raw = [(lang, (t or "").encode()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        raw = [(lang, [*char_histogram(b), letter_share(b)]) for lang, b in raw if len(b) >= MIN_CHARS]
        x = np.array([c for _, c in raw], float).reshape(-1, len(BINS) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in raw], pa.string()), *[pa.array(x[:, j]) for j in range(len(BINS) + 1)]], ["lang", *BINS, "letters"])


def references(docs: DataFrame, common: int = COMMON) -> list[tuple[tuple[str | None] | None, np.ndarray, list[bytes], np.ndarray]]:
    """For each language of the corpus with REFERENCE_DOCS documents and REFERENCE_WORDS words: (language,), its character-class histogram, its most common words, and their histogram.

    The languages with less are pooled, and have one such reference together, with None for the language, if the pool is large enough. A reference that doesn't look like language
    (like_language) is none, so that junk under a tag of its own, however much of it, is held against the references of the others.

    The character histogram is the median share of each class over the language's documents, so that a minority of junk doesn't bend it; word counts are over all
    documents of at least MIN_WORDS words. Only `common` words and the classes of each language reach the driver: a table whose size depends on the number of
    languages with enough support alone. A null language is one of its own.
    """
    n = docs.select("lang", "text").mapInArrow(_counted, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    n = stage(n.withColumn("own", F.substring("key", 1, 1).cast("string") == " "), "rules-words")
    number = lambda key: F.sum(F.when(F.col("key").cast("string") == key, F.col("n")))
    size = n.filter("own").groupBy("lang").agg(number(" docs").alias("docs"), number(" words").alias("words"))
    enough = stage(size.filter((F.col("docs") >= REFERENCE_DOCS) & (F.col("words") >= REFERENCE_WORDS)).select(F.col("lang").isNull().alias("_null"), F.coalesce("lang", F.lit("")).alias("_lang"), F.lit(False).alias("pool")), "rules-languages")

    def pooled(df: DataFrame) -> DataFrame:
        """df with the column pool, and a null lang where it is true."""
        df = df.withColumns({"_null": F.col("lang").isNull(), "_lang": F.coalesce("lang", F.lit(""))})
        df = attach(df, enough, ["_null", "_lang"]).withColumn("pool", F.coalesce("pool", F.lit(True)))
        return df.withColumn("lang", F.when(~F.col("pool"), F.col("lang"))).drop("_null", "_lang")

    shares = pooled(docs.select("lang", "text").mapInArrow(_shares, "lang string, " + ", ".join(f"`{c}` double" for c in (*BINS, "letters"))))
    of = lambda r: None if r["pool"] else (r["lang"],)
    half = shares.groupBy("pool", "lang").agg(*[F.percentile_approx(c, 0.5, 1000).alias(c) for c in (*BINS, "letters")]).collect()
    middle = {of(r): (np.array([r[c] for c in BINS]), r["letters"]) for r in half}
    n = pooled(n).groupBy("pool", "lang", "key", "own").agg(F.sum("n").alias("n"))
    top = n.withColumn("r", F.row_number().over(W.partitionBy("pool", "lang", "own").orderBy(F.desc("n"), "key"))).filter(F.col("r") <= max(common, 2))
    by: dict = {}
    for r in top.collect():
        by.setdefault(of(r), []).append((bytes(r["key"]), r["n"], r["own"]))
    refs = []
    for lang in sorted(by, key=str):
        own = {k: v for k, v, o in by[lang] if o}
        total = own[b" words"]
        if own[b" docs"] < REFERENCE_DOCS or total < REFERENCE_WORDS:
            continue
        words = sorted(((-v, k) for k, v, o in by[lang] if not o))[:common]
        hist = np.array([-v for v, _ in words] + [total + sum(v for v, _ in words)], float)
        hist /= hist.sum()
        chars, letters = middle.get(lang, (np.zeros(len(BINS)), 0.0))
        if chars.sum() > 0 and like_language(letters, chars[BINS.index("space")] / chars.sum(), 1 - hist[-1]):
            refs.append((lang, chars / chars.sum(), [k for _, k in words], hist))
    return refs


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance: the square root of the divergence in bits, 0 to 1."""
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def _judge(refs, limits):
    every = [(chars, {w: i for i, w in enumerate(words)}, hist) for _, chars, words, hist in refs]
    own = {lang: [one] for (lang, *_), one in zip(refs, every, strict=True) if lang is not None}
    char_limit, word_limit = limits

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                text, near = text or "", own.get((lang,), every)
                b = text.encode()
                words = b.split()
                n, chars, symbols, dup, rep = base_stats(text, b, words, word_hashes(words))
                failed = n < 50 or 100 * rep > 50 * n
                far_c = far_w = None
                if refs and len(b) >= MIN_CHARS:
                    c = char_histogram(b)
                    far_c = min(jensen_shannon(c, r[0]) for r in near)
                if refs and n >= MIN_WORDS:
                    low = b.lower().split()
                    far_w = 1.0
                    for _, at, hist in near:
                        k = np.bincount([at.get(w, len(at)) for w in low], minlength=len(at) + 1) / n
                        far_w = min(far_w, jensen_shannon(k, hist))
                kept = not failed and not (far_c is not None and far_c > char_limit) and not (far_w is not None and far_w > word_limit)
                rows.append((n, chars, symbols, dup, rep, failed, kept, far_c, far_w))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *OUT])

    return judge


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def quality_rules(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, common: int = COMMON) -> DataFrame:
    """One row per document: base counts, base_failed, kept, and the two distances to the language reference.

    A text goes when it fails the base rules, or when it is farther than a limit from its own language's reference: in its character classes, or in its common words.
    Texts whose language has too little support for a reference, or one that doesn't look like language, are held against the nearest of all. Without any reference the distances are null.
    Distances are null below the minimum lengths and then decide nothing. Null texts count as empty (and fail for want of words); null ids stay; repeated rows give
    repeated results; an empty table gives an empty one. Only doc_id, text and lang are read.
    """
    refs = references(docs, common)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(_judge(refs, (char_limit, word_limit)), schema)
