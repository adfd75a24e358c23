"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their fixed order. The first four are the base; the rest are added by score.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "ipv6")
#: What proposes spans. Possessive forms and look-behinds give the same leftmost matches as the plain expressions, in linear time and without recursion.
PROPOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
#: A kind is proposed only in texts that hold this.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-", "ipv6": ":"}
#: Score of a proposal, of a passed checksum, of a context word nearby, and the score from which an added span counts.
PROPOSED, CONFIRMED, CONTEXT, ENOUGH, NEAR = 0.4, 0.4, 0.2, 0.6, 40
#: Words (and their plurals) that make an added kind likelier when they stand within NEAR characters before or after it; a list after one counts throughout.
WORDS = {"iban": "iban|account|konto|cuenta|compte", "ssn": "ssn|social|security|sozial|seguridad", "ipv6": "ip|host|address(?:es)?|server"}
#: What stands between the members of a list.
LISTED = r"^[\s,;/&|]*(?:and|or|und|oder|y|o|et|ou)?[\s,;/&|]*$"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an IBAN without spaces leaves remainder 1 modulo 97 (its first four characters moved to the end, letters as 10 .. 35)."""
    moved = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))

    def add(a: Column, ch: Column) -> Column:
        o = F.ascii(ch)
        return F.when(o < 58, (a * 10 + o - 48) % 97).otherwise((a * 100 + o - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~m.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _names(kind: str, window: Column) -> Column:
    return F.lower(window).rlike(rf"(?<![a-z])(?:{WORDS[kind]})s?(?![a-z])")


def find_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, k>> of one kind, in code points, end exclusive, leftmost and non-overlapping; k is the kind's number.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the places.
    """
    rx, k = PROPOSE[kind], KINDS.index(kind)
    found, gaps = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    none = F.array().cast("array<struct<start:int,end:int,k:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(k).alias("k"))
        ok = _confirmed(kind, x["m"])
        if kind in WORDS:  # added kinds: a score decides
            before = F.right(F.concat(acc["tail"], F.right(x["g"], F.lit(NEAR))), F.lit(NEAR))
            listed = acc["near"] & F.lower(x["g"]).rlike(LISTED)
            near = listed | _names(kind, before) | _names(kind, x["a"])
            tail = F.right(F.concat(before, x["m"]), F.lit(NEAR))
            score = PROPOSED + F.when(ok, CONFIRMED if kind in ("iban", "ipv6") else 0.0).otherwise(-1.0) + F.when(near, CONTEXT).otherwise(0.0)
            ok = score >= ENOUGH - 1e-9
        out = [end.alias("at"), F.when(ok, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")]
        return F.struct(*out, tail.alias("tail"), near.alias("near")) if kind in WORDS else F.struct(*out)

    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    pairs = F.slice(pairs, F.lit(1), F.size(found))
    start = [F.lit(0).alias("at"), none.alias("out")]
    if kind in WORDS:
        # the NEAR characters after a match: the next gaps and matches, of which three hold as many
        head = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(NEAR))
        after = lambda i: F.left(F.concat(*[p for j in range(1, 5) for p in (head(F.get(gaps, i + j)), head(F.get(found, i + j)))]), F.lit(NEAR))
        pairs = F.transform(pairs, lambda p, i: F.struct(p["m"].alias("m"), p["g"].alias("g"), after(i).alias("a")))
        start += [F.lit("").alias("tail"), F.lit(False).alias("near")]
    spans = F.aggregate(pairs, F.struct(*start), step, lambda acc: acc["out"])
    likely = F.size(found) > 0
    if kind in NEEDS:
        return F.when(F.contains(text, F.lit(NEEDS[kind])), F.when(likely, spans).otherwise(none)).otherwise(none)
    return F.when(likely, spans).otherwise(none)


def pii_spans(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """docs with the column `to`: every span of every kind, ordered by start, then kind. A null text counts as empty and has no span."""
    t = F.coalesce(F.col(text), F.lit(""))
    per = F.flatten(F.array(*[find_spans(t, k) for k in KINDS]))
    return docs.withColumn(to, F.array_sort(F.transform(per, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    n = lambda k: F.size(F.filter("pii", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["k"] < 4)
    return pii_spans(docs.select("doc_id", "text")).select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; overlapping spans become one, named after the first.

    All other columns stay. Null texts stay null. n_chars, where the table has it, follows the new text.
    """
    src, found = F.col(text), "__pii"
    while found in docs.columns:
        found += "_"
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], src.substr(acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["k"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], src.substr(acc["at"] + 1, F.length(src))))
    out = pii_spans(docs, text, found).withColumn(text, F.when(F.size(found) > 0, done).otherwise(src)).drop(found)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns and text != "n_chars" else out
