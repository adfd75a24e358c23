"""Question items: options, gold letters, shuffles, forms and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aspects as A
from ..functions import text as X
from ..workers import attach, cut


def letter_choices(items: DataFrame, choices: str = "choices") -> DataFrame:
    """id, letter, text from an array of `(A) text` strings, or of plain texts lettered in order."""
    e = items.select("id", F.posexplode(choices).alias("i", "s"))
    letter = F.lower(F.nullif(F.regexp_extract("s", r"^\s*\(([A-Za-z])\)", 1), F.lit("")))
    return e.select("id", F.coalesce(letter, F.char(97 + F.col("i"))).alias("letter"), F.trim(F.regexp_replace("s", r"^\s*\([A-Za-z]\)\s*", "")).alias("text"))


def match_gold(answers: DataFrame, options: DataFrame) -> DataFrame:
    """id, gold: the option that equals the answer; else the only one that holds it or that it holds; else that with the clearly greatest word overlap; null if none.

    answers: id, answer; options: id, letter, text. One pass over options, grouped by item.
    """
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    a, v = F.trim(F.lower("answer")), F.trim(F.lower("text"))
    j = answers.join(options.hint("merge"), "id").withColumns({"same": a == v, "part": F.contains(v, a) | F.contains(a, v), "share": F.size(F.array_intersect(w(F.col("answer")), w(F.col("text")))) / F.greatest(F.lit(1), F.size(w(F.col("answer"))))})
    g = j.groupBy("id").agg(
        F.min(F.when(F.col("same"), F.col("letter"))).alias("exact"), F.count_if("part").alias("np"), F.min(F.when(F.col("part"), F.col("letter"))).alias("held"),
        F.sort_array(F.collect_list(F.struct("share", "letter")), asc=False).alias("s"), F.max(F.contains("answer", F.lit("\n"))).alias("lines"),
    )
    top, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    fuzzy = F.when((top["share"] >= 0.5) & (second.isNull() | (top["share"] - second["share"] >= 0.2)), top["letter"])
    return g.select("id", F.when(~F.col("lines"), F.coalesce("exact", F.when(F.col("np") == 1, F.col("held")), fuzzy)).alias("gold"))


def with_gold(options: DataFrame, answers: DataFrame, keep: bool = False) -> DataFrame:
    """options (id, letter, text) with `gold`: the letter in front of the answer `(c) ..`, else the option that match_gold finds. Items without any are left out unless `keep`. answers: id, answer."""
    lettered = F.lower(F.nullif(F.regexp_extract("answer", r"^\(([A-Za-z])\)", 1), F.lit("")))
    g = match_gold(answers, options).join(answers.select("id", lettered.alias("_l")).hint("merge"), "id").select("id", F.coalesce("_l", "gold").alias("gold"))
    return options.join((g if keep else g.filter("gold is not null")).hint("merge"), "id", "left" if keep else "inner")


def shuffle_options(options: DataFrame, seed: int = 7) -> DataFrame:
    """id, letter, text, was: a fixed permutation of each item's texts; `was` is the letter a text had."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), "letter").cast("binary"))
    a = options.groupBy("id").agg(F.array_sort(F.collect_list("letter")).alias("ls"), F.array_sort(F.collect_list(F.struct(h.alias("h"), F.col("letter").alias("was"), "text"))).alias("ts"))
    return a.select("id", F.inline(F.arrays_zip(F.col("ls").alias("letter"), F.col("ts").alias("t")))).select("id", "letter", F.col("t.text").alias("text"), F.col("t.was").alias("was"))


def validate_forms(forms: DataFrame, space: DataFrame) -> DataFrame:
    """form_id, attr, multi, status, values, leaves, off: each answered form against every attribute. forms: form_id, raw (text with one JSON object); space: attr, value, multi.

    status: `missing` (no such field), `unsure`, `none` (no listed class), `ok`. values: listed classes of the answer, only the first for single-choice attributes; leaves: struct<value, leaf> of their
    clean details; off: what isn't listed. Forms without an object are left out.
    """
    a = space.groupBy("attr").agg(F.bool_or("multi").alias("multi"), F.collect_set(F.lower("value")).alias("listed")).agg(F.collect_list(F.struct("attr", "multi", "listed")).alias("_as"))  # one row: the schema
    f = forms.select("form_id", X.json_object(F.col("raw")).alias("_d")).filter("_d is not null").join(F.broadcast(a), F.lit(True)).select("form_id", "_d", F.explode("_as").alias("_a")).select("form_id", "_d", "_a.*")
    f = f.withColumn("_x", F.element_at("_d", F.col("attr"))).withColumn("_p", X.answer_pairs(F.col("_x")))
    named = F.filter(F.transform("_p", lambda p: p["value"]), lambda v: v != "")
    listed = lambda v: F.array_contains("listed", v)
    f = f.withColumns({"_n": named, "_ok": F.filter(named, listed)})
    values = F.when(F.col("multi"), F.col("_ok")).otherwise(F.slice("_ok", 1, 1))
    mine = F.filter("_p", lambda p: listed(p["value"]) & (F.col("multi") | (p["value"] == F.get("_ok", F.lit(0)))))
    leaves = F.filter(F.transform(mine, lambda p: F.struct(p["value"].alias("value"), X.clean_leaf(p["detail"], p["value"]).alias("leaf"))), lambda p: p["leaf"] != "")
    status = F.when(F.col("_x").isNull(), "missing").when(F.size("_ok") > 0, "ok").when(F.array_contains("_n", "unsure"), "unsure").otherwise("none")
    return f.select("form_id", "attr", "multi", status.alias("status"), values.alias("values"), leaves.alias("leaves"), F.filter("_n", lambda v: ~listed(v) & ~v.isin("unsure", "none")).alias("off"))


def form_labels(valid: DataFrame) -> DataFrame:
    """form_id, attr, value, leaf: a record for each class with a leaf, and one for a class that was named more often than it has leaves."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    with_leaf = F.transform("leaves", lambda p: p["value"])
    bare = F.filter(F.array_distinct("values"), lambda v: count(F.col("values"), v) > count(with_leaf, v))
    every = F.concat("leaves", F.transform(bare, lambda v: F.struct(v.alias("value"), F.lit("").alias("leaf"))))
    return valid.filter("status = 'ok'").select("form_id", "attr", F.inline(every))


#: Answers that are never classes of a music form. Fixed values.
NEVER = ["unclear", "unsure", "not music"]


def form_filter(forms: DataFrame, least: int, drop: str = "$^", never: list[str] = NEVER) -> DataFrame:
    """The latest form of each key, without those that match `drop` or answer one of `never`, of classes with at least `least` forms. forms: key, ord, cls, text."""
    last = forms.groupBy("key").agg(F.max_by(F.struct("cls", "text"), "ord").alias("f")).select("key", "f.*").filter(~F.col("text").rlike(drop) & ~F.lower(F.trim("cls")).isin(never))
    return last.withColumn("_n", F.count("*").over(W.partitionBy("cls"))).filter(F.col("_n") >= least).drop("_n")


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """id, n, yes from lines `n: yes` or `n. no` of an answer, with a list mark before and stars around. answers: id, text."""
    rx = r"(?im)^\D{0,3}(\d+)\s*[:.)-]\s*\**\s*(yes|no)\b"
    z = F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(rx), F.lit(2)).alias("v"))
    return answers.select("id", F.inline(z)).select("id", F.col("n").cast("int").alias("n"), (F.lower("v") == "yes").alias("yes"))


def parse_placements(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """id, name, attr, value, new_value, same_as, parsed for each name asked about: the object of the answer's outermost JSON list with that name (case apart); parsed is false where there is none.

    answers: id, text; asked: id, name.
    """
    fields = ["attr", "value", "new_value", "same_as"]
    items = F.from_json(F.nullif(F.regexp_extract("text", r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    o = answers.select("id", F.explode(F.transform(items, lambda x: F.from_json(x, "map<string,string>"))).alias("m")).filter("m is not null")
    o = o.withColumn("_k", F.lower(F.trim(F.element_at("m", "name")))).filter("_k is not null").groupBy("id", "_k").agg(F.min_by("m", F.to_json("m")).alias("m"))
    j = asked.withColumn("_k", F.lower(F.trim("name"))).join(o.hint("merge"), ["id", "_k"], "left")
    return j.select("id", "name", *[F.element_at("m", c).alias(c) for c in fields], F.col("m").isNotNull().alias("parsed"))


#: Where an answer is stated, what marks a recording in a question, and where its instruction begins. Fixed values.
CONCLUSION, RECORDING, INSTRUCTION = r"(?s)<CONCLUSION>(.*?)</CONCLUSION>", "<sound>", "Output the answer with"


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, question, answer: the first user turn up to its instruction, and what the other turns conclude: the text of their first conclusion tag, else their last sentence ('' if they say nothing)."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"]), "\n")
    g = turns.groupBy("conv_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.when(F.col("role") == "user", F.col("turn"))).alias("_q"), said.alias("_a"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    question = bare(F.split_part(F.replace("_q", F.lit(RECORDING), F.lit("")), F.lit(INSTRUCTION), F.lit(1)))
    sentence = F.element_at(F.split(bare(F.col("_a")), r"(?<=[.!?])\s+"), -1)
    return g.select("conv_id", question.alias("question"), F.when(F.col("_a").rlike(CONCLUSION), F.regexp_extract("_a", CONCLUSION, 1)).otherwise(sentence).alias("answer"))


#: Names that say nothing by themselves. Fixed values.
STOP = ["sound", "sounds", "noise", "other", "generic", "specific", "surface", "type", "effect", "background"]


def plain(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]+", " "))


def vocabulary(nodes: DataFrame) -> DataFrame:
    """name, hits: the names of classes and leaves up to a bracket, and the (attr, value) pairs that each stands for. Stop words and names under three characters have none. nodes: attr, value, leaf ('' or null: none)."""
    n = nodes.select("attr", "value", F.explode(F.array("value", "leaf")).alias("n")).select("attr", "value", plain(F.split_part("n", F.lit("("), F.lit(1))).alias("name"))
    n = n.filter((F.length("name") >= 3) & ~F.col("name").isin(STOP))
    return n.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("attr", "value"))).alias("hits"))


#: Names in a vocabulary up to which they are broadcast (about 100 bytes each); characters of text in a task; islands of matches settled in one row; words of 64 marks in a block, and marks for each name.
NAMES, TASK_CHARS, ISLANDS, BLOCK, MARKS = 1_000_000, 8 << 20, 32, 512, 32


def _parted(v: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Names (m: their pieces) in two parts: those of the fewest pieces, which texts hold most, up to NAMES of them, and the rest, None where there is none."""
    room, last = NAMES, None
    for m, n in v.groupBy("m").count().orderBy("m").collect():  # a row for each number of pieces
        if n > room:
            last = m, int(1000 * room / n)
            break
        room -= n
    if last is None:
        return v, None
    near = (F.col("m") < last[0]) | ((F.col("m") == last[0]) & (F.pmod(F.xxhash64("name", F.lit(2)), F.lit(1000)) < last[1]))
    return v.filter(near), v.filter(~near)


def _marked(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose `name` may be among names: all that are, and about one in a thousand others. Each name sets three bits of a word of 64; words are broadcast in blocks, about four bytes a name."""
    blocks = names.count() * MARKS // (64 * BLOCK) + 1
    h = F.xxhash64("name", F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
    at = {"_b": F.pmod(F.xxhash64("name"), F.lit(blocks)), "_w": h.bitwiseAND(F.lit(BLOCK - 1)).cast("int"), "_m": bit(9).bitwiseOR(bit(15)).bitwiseOR(bit(21))}
    words = names.select("name").withColumns(at).groupBy("_b", "_w").agg(F.bit_or("_m").alias("_m"))
    block = words.groupBy("_b").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_m"))).alias("_of"))  # at most BLOCK words each
    block = block.select("_b", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.element_at("_of", i), F.lit(0).cast("long"))).alias("_ws"))
    out = runs.withColumns(at).join(F.broadcast(block), "_b")
    return out.filter(F.get("_ws", F.col("_w")).bitwiseAND(F.col("_m")) == F.col("_m")).select(*runs.columns)


def _matches(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, place, name and the other columns of vocab: see vocabulary_match. vocab: name, one row each, and what goes with it."""
    v = cut(vocab.withColumn("m", F.size(F.split("name", " "))))
    more = [c for c in vocab.columns if c != "name"]
    longest = v.agg(F.max("m")).first()[0]
    if longest is None:
        return texts.select("id", F.lit(0).alias("place")).limit(0).join(vocab.limit(0)).select("id", "place", "name", *more)
    near, far = _parted(v)
    # the first piece of a name, and how many pieces names that begin with it have
    first = near.groupBy(F.split_part("name", F.lit(" "), F.lit(1)).alias("w")).agg(F.sort_array(F.collect_set("m")).alias("ms"))
    tasks = int((texts.agg(F.sum(F.length("text"))).first()[0] or 0) // TASK_CHARS) + texts.sparkSession.sparkContext.defaultParallelism
    p = texts.select("id", "text").repartition(tasks, "id").select("id", F.split(plain(F.col("text")), " ").alias("p"))
    # each place with the few pieces that a name there can have, each taken by its number (a slice would copy the text): rows don't carry the text
    run = lambda w, i: F.struct((i + 1).alias("place"), w.alias("w"), F.array(w, *[F.get("p", i + k) for k in range(1, longest)]).alias("s"))
    every = p.select("id", F.inline(F.transform("p", run))).filter("w != ''")
    name = lambda m: F.struct("place", m.alias("m"), F.array_join(F.slice("s", 1, m), " ").alias("name"))
    fits = lambda ms: F.inline(F.transform(F.filter(ms, lambda m: F.get("s", m - 1) != ""), name))
    hit = every.join(F.broadcast(first), "w").select("id", fits(F.col("ms"))).join(F.broadcast(near.drop("m")), "name", "inner" if more else "left_semi")
    if far is not None:
        # names beyond the broadcast: only runs that are such names, but for one in a thousand, are shuffled, to the names and back to their text
        long = [r[0] for r in far.select("m").distinct().collect()]
        runs = _marked(every.select("id", fits(F.array(*[F.lit(m) for m in long]))), far)
        hit = hit.unionByName(runs.join(far.drop("m").hint("merge"), "name").select(*hit.columns).repartition(tasks, "id"))
    # islands of matches that touch, many to a row; at each place the longest comes first, and shorter ones there begin before it ends
    w = W.partitionBy("id").orderBy("place", F.desc("m"))
    starts = F.col("place") >= F.coalesce(F.max(F.col("place") + F.col("m")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = hit.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = hit.groupBy("id", F.floor(F.col("island") / ISLANDS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("m")).alias("n"), "name", *more))).alias("o"))
    kept = F.aggregate(
        "o", F.struct(F.lit(0).alias("end"), F.slice("o", 1, 0).alias("k")),
        lambda a, x: F.when(x["place"] >= a["end"], F.struct((x["place"] - x["n"]).alias("end"), F.concat(a["k"], F.array(x)).alias("k"))).otherwise(a),
    )["k"]
    return g.select("id", F.inline(kept)).select("id", "place", "name", *more)


def vocabulary_match(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, place, name: where names of a vocabulary stand in a text as whole words, read from the left, the longest first; matches don't overlap. place: the number of its first piece. texts: id, text; vocab: name, and what passes through.

    The plain text is cut at its spaces; where a piece begins a name, runs of as many pieces as such names have are joined to the names, so work grows with the text and not with the vocabulary. Of the matches, islands that
    touch are settled one by one. Texts are dealt by id first, in tasks of TASK_CHARS: matches of a text stay in its task. Only the texts are shuffled as long as the names are broadcast; beyond NAMES, also the matches of the names left
    over, those of the most pieces.
    """
    return _matches(texts, vocab.select("name").distinct())


def asked_attributes(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, attrs: the attributes that a text's names stand for, sorted; [] for texts without one. texts: id, text; vocab: as vocabulary() makes it."""
    of = vocab.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_set(F.transform("hits", lambda h: h["attr"])))).alias("attrs"))
    # a name brings its attributes with it, and a text's are told apart before anything is collected
    m = _matches(texts, of).select("id", F.explode("attrs").alias("attr")).distinct()
    a = m.groupBy("id").agg(F.array_sort(F.collect_set("attr")).alias("attrs"))
    return texts.select("id").distinct().join(a.hint("merge"), "id", "left").select("id", F.coalesce("attrs", F.array().cast("array<string>")).alias("attrs"))


def attr_space(schema: DataFrame) -> DataFrame:
    """attr, region, grid, scope, multi, values: one row per attribute; values by their order. schema: attr, value, ord, multi, grid, scope (rows of an attribute agree)."""
    g = schema.groupBy("attr").agg(F.max("grid").alias("grid"), F.max("scope").alias("scope"), F.bool_or("multi").alias("multi"), F.array_sort(F.collect_set(F.struct("ord", "value"))).alias("o"))
    return g.select("attr", F.split_part("attr", F.lit("."), F.lit(1)).alias("region"), "grid", "scope", "multi", F.transform("o", lambda x: x["value"]).alias("values"))


#: The layouts of a prompt line. Fixed values.
OPEN_MANY, CLOSED_MANY, DETAIL = " [a LIST of such objects, one per thing you hear]", " [list ALL that apply]", " -- detail = "


def render_form(fields: DataFrame) -> DataFrame:
    """region, lines: the prompt lines of a region's attributes, by ord. fields: region, ord, name, values, multi, open, hint, na_hint.

    Open fields ask for an object with a detail, closed ones for a listed value; multi-valued ones say so, in their own words each.
    """
    some = lambda c, before, after: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    name, listed, multi = F.concat(F.lit('- "'), "name", F.lit('"')), F.array_join("values", " | "), F.col("multi")
    open_ = F.concat(name, F.when(multi, OPEN_MANY).otherwise(""), some(F.col("na_hint"), " (", ")"), F.lit(': {"is": one of '), listed, F.lit(', "detail": "..."}'), some(F.col("hint"), DETAIL, ""))
    closed = F.concat(name, F.when(multi, CLOSED_MANY).otherwise(""), F.lit(": "), listed)
    line = F.when(F.col("open"), open_).otherwise(closed)
    return fields.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


def proposal_batches(leaves: DataFrame, most: int = 140) -> DataFrame:
    """attr, value, part, n, lines: a class's leaves by name, in two halves above `most`. leaves: attr, value, leaf, clips."""
    w = W.partitionBy("attr", "value")
    r = leaves.withColumns({"_r": F.row_number().over(w.orderBy("leaf")), "_n": F.count("*").over(w)})
    r = r.withColumn("part", F.when((F.col("_n") > most) & (F.col("_r") > F.floor(F.col("_n") / 2)), 2).otherwise(1))
    g = r.groupBy("attr", "value", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("leaf", "clips"))).alias("o"))
    return g.select("attr", "value", "part", "n", F.array_join(F.transform("o", lambda x: F.concat(x["leaf"], F.lit(" ("), x["clips"].cast("string"), F.lit(")"))), "\n").alias("lines"))


def aspect_rules(aspects: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """id, attr, cls: free-text aspects to attribute classes by a rule table (attr, cls, pattern, mode); aspects: id, ord, aspect.

    mode `all`: every class that an aspect matches; `first`: the attribute's first rule that matches; `most`: the class that most aspects match, ties to the earliest aspect.
    The rules are a bounded table; each aspect meets it once.
    """
    spark = aspects.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "no int, attr string, cls string, pattern string, mode string")
    a = aspects.withColumn("_a", F.lower(F.trim("aspect")))
    hit = a.join(F.broadcast(table), F.expr("_a rlike pattern")).groupBy("id", "attr", "mode", "cls").agg(F.countDistinct("ord").alias("n"), F.min("ord").alias("at"), F.min("no").alias("no"))
    order = F.when(F.col("mode") == "first", F.struct(F.lit(0).cast("long").alias("a"), F.col("no").cast("long").alias("b"))).otherwise(F.struct((-F.col("n")).alias("a"), F.col("at").cast("long").alias("b")))
    r = F.row_number().over(W.partitionBy("id", "attr").orderBy(order, "no"))
    return hit.withColumn("_r", r).filter((F.col("mode") == "all") | (F.col("_r") == 1)).select("id", "attr", "cls")


def music_labels(aspects: DataFrame) -> DataFrame:
    """id, attr, cls: the labels that a clip's free-text aspects give it, by the rules of `functions.aspects`. aspects: id, ord, aspect; a clip's aspects are gathered, a short list each.

    instrument and vocal style: every class that is named. vocals: rap, choir, mixed, male, female, in this order, else none where it is said and no voice is. mood: the class of most aspects that don't speak of a
    voice, ties to the earliest. production and fidelity: the first rule that matches; without either, the recording is clean.
    """
    g = aspects.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim(F.lower("aspect")).alias("a")))), lambda x: x["a"]).alias("a"))
    g = g.withColumn("all", F.array_join("a", " | "))
    says = lambda words: lambda x: x.rlike(A.words(*words))
    voiced = F.filter("a", lambda x: (~F.startswith(x, F.lit("no ")) & x.rlike(A.VOICE)) | x.rlike(A.words("rap", "rapping", "choir", "choral")))
    g = g.withColumn("v", voiced)
    any_ = lambda col, *words: F.exists(col, says(words))
    named = lambda rules: F.array_compact(F.array(*[F.when(F.col("all").rlike(A.words(*ws)), c) for c, ws in rules]))
    male, female = any_("v", "male", "man", "men", "boy", "boys"), any_("v", "female", "woman", "women", "girl", "girls")
    duet = F.exists("a", lambda x: F.contains(x, F.lit("duet")))
    vocals = (
        F.when(any_("v", "rap", "rapping", "rapper"), "rap vocals").when(any_("v", "choir", "choral"), "choir").when((male & female) | duet, "mixed vocals").when(male, "male vocals").when(female, "female vocals")
        .when((F.size("v") == 0) & F.arrays_overlap("a", F.array(*[F.lit(x) for x in A.NO_VOCALS])), "no vocals")
    )
    mood_of = lambda x: F.array_compact(F.array(*[F.when(x.rlike(A.words(*ws)), c) for c, ws in A.MOOD]))
    moods = F.flatten(F.transform("a", lambda x: F.when(x.rlike(A.VOICE_ANYWHERE), F.array().cast("array<string>")).otherwise(mood_of(x))))
    count = lambda m: F.size(F.filter("_moods", lambda y: y == m))
    ranked = F.array_sort(F.transform(F.array_distinct("_moods"), lambda m: F.struct((-count(m)).alias("n"), F.array_position("_first", m).alias("at"), m.alias("m"))))
    g = g.withColumn("_moods", moods).withColumn("_first", F.col("_moods"))
    production = F.get(named(A.PRODUCTION), F.lit(0))
    fidelity = F.coalesce(F.get(named(A.FIDELITY), F.lit(0)), F.when(production.isNull(), F.lit("clean recording")))
    style = F.array_compact(F.array(*[F.when(F.exists("v", says(ws)), c) for c, ws in A.VOCAL_STYLE]))
    one = lambda c: F.array_compact(F.array(c))
    labels = {"music.instrument": named(A.INSTRUMENT), "music.vocals": one(vocals), "music.mood": one(F.get(ranked, F.lit(0))["m"]), "music.production": one(production), "music.fidelity": one(fidelity), "music.vocal_style": style}
    of = lambda attr: lambda c: F.struct(F.lit(attr).alias("attr"), c.alias("cls"))
    rows = F.flatten(F.array(*[F.transform(cs, of(attr)) for attr, cs in labels.items()]))
    return g.select("id", F.inline(rows))


def align_external(by_id: DataFrame, by_category: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """item, value, leaf of two labelled corpora: by class name to the leaf's node, by category to the class. by_id: item, name; by_category: item, category; nodes: name, value, leaf; classes: category, value."""
    a = by_id.join(nodes.hint("merge"), "name").select("item", "value", "leaf")
    b = by_category.join(classes.hint("merge"), "category").select("item", "value", F.lit("").alias("leaf"))
    return a.unionByName(b).distinct()
