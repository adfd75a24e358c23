"""Column functions on names, answers and transcripts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a name. Fixed values.
FILLER = ["a", "an", "the", "of", "some", "something", "someone", "sound", "sounds", "noise", "being", "on", "about", "in", "at", "for", "to"]
#: Words without meaning at the end of a longer name. Fixed values.
TAIL = ["mood", "tone", "vibe", "style", "music", "voice", "feel", "feeling"]
#: Endings that the stemmer takes off, in this order. Fixed values.
ENDINGS = ["ements", "ement", "ments", "ment", "ations", "ation", "ings", "ing", "ers", "er", "ed", "es", "s"]
#: Words that stand for another one. Fixed values.
SYNONYMS = {
    "sax": "saxophone", "providing": "giving", "simple": "basic", "educator": "teacher", "repetitive": "repeating", "airplane": "aircraft", "plane": "aircraft", "movie": "film",
    "telephone": "phone", "theatrical": "dramatic", "geese": "goose", "laughter": "laughing", "hen": "chicken", "hens": "chicken", "chickens": "chicken", "fear": "fearful",
    "disgust": "disgusted", "anger": "angry", "sadness": "sad", "happiness": "happy", "surprise": "surprised", "kids": "child", "children": "child", "kid": "child", "person": "someone",
    "automobile": "car", "tv": "television", "mic": "microphone",
}
#: Words that deny. Fixed values.
NEGATIONS = ["no", "not", "non", "without", "absent", "absence", "lack", "lacking", "zero", "never", "silent"]
#: Number words and their digits. Fixed values.
NUMBER_WORDS = {"two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}
#: Contrasts: the words of either side. Fixed values.
AXES = [
    (["high"], ["low"]), (["fast", "quick", "rapid"], ["slow"]), (["loud"], ["quiet", "soft", "faint"]),
    (["male", "man", "men", "boy", "masculine"], ["female", "woman", "women", "girl", "feminine"]), (["major"], ["minor"]),
    (["indoor", "indoors", "inside"], ["outdoor", "outdoors", "outside"]), (["rising", "increasing", "ascending"], ["falling", "decreasing", "descending"]),
    (["near", "close", "nearby"], ["distant", "far", "faraway"]), (["single"], ["multiple"]), (["short"], ["long"]), (["happy", "joyful", "cheerful"], ["sad", "sorrowful"]),
    (["bright"], ["dark"]), (["wet"], ["dry"]), (["clean"], ["distorted"]), (["mono"], ["stereo"]), (["start", "beginning"], ["end", "ending"]), (["before"], ["after"]),
    (["open"], ["closed"]), (["up", "upward"], ["down", "downward"]), (["forward"], ["backward"]), (["warm", "hot"], ["cold", "cool"]), (["young"], ["old"]), (["in"], ["out"]),
]
#: Endings of a name's words that its comparison form lacks, and consonants that aren't doubled before one. Fixed values.
GERUND, PLURAL, DOUBLED = "ing", ["ies", "es", "s"], "bdfgklmnprt"
#: Words that say how a sound is, not what makes it; words that a fold may drop on identity attributes; words without content. Fixed values.
SOUND_WORDS = ["sound", "sounds", "noise", "noises", "call", "calls", "cry", "cries", "vocalization", "vocalisation", "vocal", "voice", "vocals", "music", "playing", "hit", "hits", "beat", "beats", "loud", "quiet", "soft", "heavy", "light", "distant", "multiple", "single"]
FOLD_FILLER = [
    "speech", "speaking", "talk", "talking", "voice", "voices", "vocal", "vocals", "sound", "sounds", "noise", "noises", "audio", "delivery", "tone", "style", "recording", "chatter", "murmur", "a", "an", "the",
    "of", "in", "on", "at", "with", "some", "background", "effect", "effects", "quality", "manner", "type", "kind", "general", "clear", "very", "quite", "somewhat", "slightly", "heavy", "light",
]
STOP = ["the", "a", "an", "of", "and", "or", "with", "on", "in", "etc", "sound", "sounds", "noise", "people", "playing"]
#: Wording of questions that names a span of time, a position, an order, a count, or the set of events; and what no event detector can tell. Fixed values.
TIME_SPAN = r"(?i)(?:from|between)\s+(\d+(?::\d+)?(?:\.\d+)?)\s*(?:to|and|until|-|–)\s*(\d+(?::\d+)?(?:\.\d+)?)"
TIME_BARE = r"(?i)\b(\d+(?::\d+)?(?:\.\d+)?)\s*(?:to|-|–)\s*(\d+(?::\d+)?(?:\.\d+)?)\s*(?:second|sec|s)\b"
TIME_EDGE = r"(?i)\b(?:first|opening|last|final)\s+(?:\d+(?:\.\d+)?)\s*(?:second|sec|s)\b"
POSITION = (
    r"(?i)toward(?:s)?\s+the\s+end|\bat\s+the\s+(?:very\s+)?end\b|\bends?\s+(?:with|by)\b|\bin\s+the\s+end\b|\bfinal\s+(?:part|section|portion)\b|\bclosing\s+(?:part|section|portion)\b"
    r"|\blate\s+in\s+the\b|\bat\s+the\s+(?:beginning|start)\b|\bbegins?\s+(?:with|by)\b|\bstarts?\s+with\b|\bin\s+the\s+beginning\b|\binitial\s+(?:part|section|portion)\b"
    r"|\bopening\s+(?:part|section|portion)\b|\bearly\s+in\s+the\b|\bright\s+at\s+the\s+beginning\b|\bin\s+the\s+middle\b|\bmiddle\s+(?:part|section|portion)\b|\bfirst\s+half\b|\bsecond\s+half\b|\blast\s+half\b"
)
TEMPORAL = (
    r"(?i)\b(order|sequence|sequential(?:ly)?|followed by|follows|how many times|at what (?:point|time|moment)|when (?:does|do|is|did|was)|time ?frames?|timestamps?"
    r"|(?:first|last|final|second|third|next|previous|earlier|later|opening|closing)\s+(?:sound|sounds|noise|event|speaker|voice|note|chord|instrument|half|part|segment|section|thing|word|sentence|phrase|clip|beat|measure|bar)"
    r"|(?:at|towards?|near|by|in)\s+the\s+(?:beginning|start|end|middle|outset|close)|(?:beginning|start|end|middle)\s+of\s+the\s+(?:audio|clip|recording|track|song|sound)"
    r"|(?:before|after|prior to|subsequent to)\s+(?:the|that|this|a|an|hearing|it)\b|transition(?:s|ed|ing)?|precede[sd]?|subsequent(?:ly)?|\d+(?:\.\d+)?\s*(?:s|sec|seconds?)\b|\d+:\d\d)\b"
)
COUNTING = r"(?i)\b(how many|number of|count(?:ed|ing)?|occurrences?|times (?:does|do|is|are|did|was|were|can))\b"
EVENTS = (
    r"(?i)\b(longest|shortest|longer|shorter|duration|cannot be heard|can not be heard|can't be heard|not (?:be )?heard|not present|absent|background|foreground|simultaneous(?:ly)?|at the same time|overlap(?:ping|s)?"
    r"|(?:first|last|final)\s+(?:sound|noise|event|thing)|(?:begin|start|end)(?:s|ning|ing)?\s+(?:of|with)\s+the)\b"
)
NOT_EVENTS = (
    r"(?i)\b(chords?|notes?|note durations?|key change|keys?|modulation|tonic|scale|tempo|bpm|beats?|bars?|measures?|rhythm|melod\w*|harmon\w*|texture|inversion|12-tone|passage|strings?|phonemes?|syllables?|stressed"
    r"|unstressed|words?|sentences?|speakers?|contributors?|people|persons?|voices|conversation|discussion|understand|sarcastic|said|says|asking|asked)\b"
)
DURATIONS = r"(?i)\b(longest|shortest|longer|shorter|duration|lasts|lasted|how long)\b"
ORDERING = (
    r"(?i)\b(order of|in (?:what|which) order|sequence|sequential(?:ly)?|(?:first|last|final|next|previous|earlier|later)\s+(?:sound|noise|event|thing|speaker|voice|one)"
    r"|(?:occur|come|hear|appear|play|happen)\w*\s+(?:first|last|next)|before|after|followed|follows|precede|subsequent|(?:at|towards?|near) the (?:beginning|start|end)|(?:beginning|start|end) of the)\b"
)
#: Seconds that a named span may last at most.
LONGEST_SPAN = 600


def clean_leaf(leaf: Column, parent: Column, most: int = 4) -> Column:
    """One term of at most four words, without digits, that isn't its class; else ''."""
    raw = F.lower(F.coalesce(leaf, F.lit("")))
    x = F.element_at(F.split(raw, " and | with |[,;/]"), 1)
    x = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), "[^a-z' -]", " "), r"\s+", " ")
    x = F.regexp_replace(x, "^[ '-]+|[ '-]+$", "")
    bad = (x == "") | x.isin("unsure", "none", "n a") | x.eqNullSafe(parent) | leaf.rlike("[0-9]") | (F.size(F.split(x, " ")) > most)
    return F.when(F.coalesce(bad, F.lit(True)), "").otherwise(x)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def stem(word: Column, synonyms: dict[str, str] | None = None) -> Column:
    """A word, or what it stands for, without its endings while at least four letters stay, without a doubled last consonant, without a last e. None: the SYNONYMS."""
    synonyms = SYNONYMS if synonyms is None else synonyms
    if synonyms:
        word = F.coalesce(F.element_at(_map(synonyms), word), word)
    once = lambda w: F.coalesce(*[F.when(F.endswith(w, F.lit(e)) & (F.length(w) >= len(e) + 4), F.left(w, F.length(w) - len(e))) for e in ENDINGS], w)
    # each pass takes a letter off at least, so a word is stable after as many passes as it has letters
    w = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), word, lambda a, _: once(a))
    w = F.get(F.transform(F.array(w), lambda v: F.when((F.length(v) > 3) & v.rlike(r"([^aeiouls])\1$"), F.left(v, F.length(v) - 1)).otherwise(v)), F.lit(0))
    return F.get(F.transform(F.array(w), lambda v: F.when((F.length(v) > 4) & F.endswith(v, F.lit("e")), F.left(v, F.length(v) - 1)).otherwise(v)), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def norm_key(name: Column, synonyms: dict[str, str] | None = None, extra: tuple[str, ...] = ()) -> Column:
    """Stems of a name's words in order, without filler and without an empty last word; names with equal keys are one."""
    drop = F.array(*[F.lit(w) for w in (*FILLER, *extra)])
    w = F.filter(words(name), lambda x: ~F.array_contains(drop, x))
    w = F.get(F.transform(F.array(w), lambda a: F.when((F.size(a) > 1) & F.coalesce(F.get(a, F.size(a) - 1).isin(TAIL), F.lit(False)), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)), F.lit(0))
    key = F.array_join(F.array_sort(F.transform(w, lambda x: stem(x, synonyms))), " ")
    return F.when(key == "", name).otherwise(key)


def guard_normalise(name: Column) -> Column:
    """Lower case, one article off, plural and -ing endings off each word."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), r"^[.,;:!?]+|[.,;:!?]+$", "")
    s = F.regexp_replace(s, r"^(a|an|the|some|any)\s+", "")
    many = "|".join(PLURAL)

    def token(t: Column) -> Column:
        g = F.when(t.rlike(f"[a-z]{{3}}{GERUND}$") & (F.length(t) > 5), F.regexp_replace(F.regexp_replace(t, f"{GERUND}$", ""), rf"([{DOUBLED}])\1$", "$1")).otherwise(t)
        return F.get(F.transform(F.array(g), lambda v: F.when((F.length(v) > 3) & v.rlike(f"[a-z]({many})$"), F.regexp_replace(v, f"(?<=[a-z])(?:{many})$", "")).otherwise(v)), F.lit(0))

    return F.array_join(F.transform(F.filter(F.split(s, " "), lambda t: t != ""), token), " ")


def plain_word(word: str) -> str:
    """guard_normalise of one lower-case word, for tables of words."""
    if re.search(f"[a-z]{{3}}{GERUND}$", word) and len(word) > 5:
        word = re.sub(rf"([{DOUBLED}])\1$", r"\1", word.removesuffix(GERUND))
    return re.sub(f"(?<=[a-z])(?:{'|'.join(PLURAL)})$", "", word) if len(word) > 3 else word


def axis_sides(axes: list[tuple[list[str], list[str]]] = AXES) -> dict[str, str]:
    """`axis:side` of each word of the axes, in its comparison form; the first axis that holds a word has it."""
    out: dict[str, str] = {}
    for i, sides in enumerate(axes):
        for side, ws in enumerate(sides):
            for w in ws:
                out.setdefault(plain_word(w), f"{i}:{side}")
    return out


def merge_features(name: Column, axes: list[tuple[list[str], list[str]]] = AXES) -> Column:
    """struct<numbers, negated, poles> of a name, best in its comparison form: its numbers in order (number words count), whether it denies, and the sides it takes as `axis:side`."""
    tokens = F.filter(F.split(F.replace(name, F.lit("-"), F.lit(" ")), r"\s+"), lambda t: t != "")
    spelt = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(_map(NUMBER_WORDS), t), t)), " ")
    sides = _map(axis_sides(axes))
    poles = F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: F.element_at(sides, t)), lambda p: p.isNotNull())))
    return F.struct(F.regexp_extract_all(spelt, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)).alias("numbers"), name.rlike(rf"(?:^|[\s-])({'|'.join(NEGATIONS)})(?=$|[\s-])").alias("negated"), poles.alias("poles"))


def merge_why(x: Column, y: Column) -> Column:
    """Why two names with these merge_features may not be one, or null."""
    axis = lambda p: F.split_part(p, F.lit(":"), F.lit(1))
    on = lambda ps, i: F.filter(ps, lambda p: axis(p) == i)
    both = F.array_intersect(F.transform(x["poles"], axis), F.transform(y["poles"], axis))
    apart = F.exists(both, lambda i: on(x["poles"], i) != on(y["poles"], i))
    return F.when(x["numbers"] != y["numbers"], "numeric").when(x["negated"] != y["negated"], "negation").when(apart, "polarity")


def may_merge(a: Column, b: Column, axes: list[tuple[list[str], list[str]]] = AXES) -> Column:
    """Null if two names may be one, else the reason: numeric, negation, or polarity (on an axis that both name they don't take the same sides)."""
    return F.get(F.transform(F.array(F.struct(merge_features(a, axes).alias("x"), merge_features(b, axes).alias("y"))), lambda f: merge_why(f["x"], f["y"])), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct four-letter beginnings of words of more than three letters, in order, without stop words."""
    w = F.filter(words(text), lambda x: (F.length(x) > 3) & ~x.isin(STOP))
    return F.array_sort(F.array_distinct(F.transform(w, lambda x: F.left(x, F.lit(4)))))


def class_words(text: Column) -> Column:
    """Distinct words of more than two letters, in order, without stop words and common endings: hissing and hisses are one, cries and cry, rattle and rattling."""
    ends = [("ing", 3), ("ed", 2), ("es", 2), ("s", 1)]
    steps = [
        lambda w: F.coalesce(*[F.when(F.endswith(w, F.lit(e)) & (F.length(w) >= n + 3), F.left(w, F.length(w) - n)) for e, n in ends], w),
        lambda w: F.when((F.length(w) > 3) & (F.right(w, F.lit(1)) == w.substr(F.length(w) - 1, F.lit(1))), F.left(w, F.length(w) - 1)).otherwise(w),
        lambda w: F.when((F.length(w) > 3) & F.endswith(w, F.lit("e")), F.left(w, F.length(w) - 1)).otherwise(w),
        lambda w: F.when(F.endswith(w, F.lit("i")), F.concat(F.left(w, F.length(w) - 1), F.lit("y"))).otherwise(w),
    ]
    out = F.filter(words(text), lambda x: (F.length(x) > 2) & ~x.isin(STOP))
    for step in steps:
        out = F.transform(out, step)
    return F.array_sort(F.array_distinct(out))


def source_tokens(name: Column, generic: list[str]) -> Column:
    """Distinct stems of a name's words that can name what makes a sound: no -ing forms, no general words, no sound words; a plural s goes."""
    w = F.filter(F.split(F.lower(name), r"[\s,/-]+"), lambda t: (t != "") & ~F.endswith(t, F.lit("ing")) & ~t.isin([*generic, *SOUND_WORDS]))
    one = lambda t: F.when((F.length(t) >= 4) & F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.transform(F.transform(w, lambda t: stem(t)), one))


def shares_source(a: Column, b: Column, generic: list[str]) -> Column:
    """Two names have a source token in common, or one's key holds the other's."""
    x, y = norm_key(a), norm_key(b)
    return F.arrays_overlap(source_tokens(a, generic), source_tokens(b, generic)) | F.contains(x, y) | F.contains(y, x)


def choice_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def choices_text(letters: Column, texts: Column) -> Column:
    """`(a) x  (b) y` from two arrays."""
    return F.array_join(F.zip_with(letters, texts, lambda k, v: F.concat(F.lit("("), k, F.lit(") "), v)), "  ")


def final_letter(text: Column, last: str = "k") -> Column:
    """The last standalone letter after the final-channel marker, else a."""
    tail = F.element_at(F.split(text, "final"), -1)
    up = last.upper()
    found = F.regexp_extract_all(tail, F.lit(rf"\(([a-{last}A-{up}])\)|\b([a-{last}A-{up}])\b"), F.lit(0))
    return F.when(F.size(found) > 0, F.lower(F.regexp_replace(F.get(found, F.size(found) - 1), "[()]", ""))).otherwise("a")


def extract_letter(text: Column, options: Column | None = None, last: str = "d") -> Column:
    """A free answer's letter, null if none; options: map of letters (a .. last) to normalised option texts, without which only letters in the answer count.

    The conclusion tag's content counts where there is one. In this order: the first letter in brackets; a leading letter that is an option; the option that equals the answer; the first letter
    before `.`, `)` or `:`; the first option that holds the answer (of three characters at least) or that it holds; the last letter that stands alone; the option with most words in common.
    """
    c = rf"[a-{last}A-{last.upper()}]"
    tag = r"(?is)<Conclu[^>]*>(.*?)(?:</Conclu|$)"
    raw = F.when(text.rlike(tag), F.regexp_extract(text, tag, 1)).otherwise(text)
    options = F.create_map().cast("map<string,string>") if options is None else options
    few = F.array_sort(F.filter(F.map_entries(options), lambda o: o["value"] != ""))
    named = lambda x, p: F.lower(F.nullif(F.regexp_extract(x, p, 1), F.lit("")))
    first = lambda p: F.get(F.filter(few, p), F.lit(0))["key"]

    def letter(v: Column) -> Column:
        content, norm = v["c"], v["n"]
        lead = named(content, rf"^\s*({c})(?:[.):]|\s*$)")
        alone = F.regexp_extract_all(content, F.lit(rf"(?:^|[^a-zA-Z])({c})(?:[^a-zA-Z]|$)"), F.lit(1))
        common = F.transform(few, lambda o: F.struct((-F.size(F.array_intersect(F.split(norm, r"\s+"), F.filter(F.split(o["value"], r"\s+"), lambda w: w != "")))).alias("k"), o["key"].alias("l")))
        return F.coalesce(
            named(content, rf"\(({c})\)"), F.when(F.map_contains_key(options, F.coalesce(lead, F.lit(""))) | (F.size(few) == 0), lead), first(lambda o: o["value"] == norm),
            named(content, rf"(?:^|[^a-zA-Z])({c})[.):]"), F.when(F.length(norm) >= 3, first(lambda o: F.contains(norm, o["value"]) | F.contains(o["value"], norm))),
            F.lower(F.get(alone, F.size(alone) - 1)), F.get(F.filter(F.array_sort(common), lambda o: o["k"] < 0), F.lit(0))["l"],
        )

    content = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), "<[^>]+>", " ")
    return F.get(F.transform(F.transform(F.array(content), lambda x: F.struct(x.alias("c"), choice_norm(x).alias("n"))), letter), F.lit(0))


def strip_timestamps(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\[[^\]]*\]", " "), r"\s+", " "))


def transcript_segments(text: Column) -> Column:
    """array<struct<start, text>> of a text with time marks `<|1.50|>`; other marks go. A text without time marks is one segment at 0; empty segments are left out."""
    mark, other = r"<\|(\d+\.\d+)\|>", r"<\|[^|]*\|>"
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, other, " "), r"^\s+|\s+$", "")
    starts, parts = F.regexp_extract_all(text, F.lit(mark), F.lit(1)), F.split(text, mark)
    timed = F.zip_with(starts, F.slice(parts, F.lit(2), F.size(starts)), lambda s, t: F.struct(s.cast("double").alias("start"), plain(t).alias("text")))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), plain(text).alias("text")))
    return F.filter(F.when(F.size(starts) > 0, timed).otherwise(whole), lambda x: x["text"] != "")


def timed_line(seconds: Column, text: Column) -> Column:
    """`[m:ss.s] text`."""
    return F.concat(F.lit("["), F.floor(seconds / 60).cast("string"), F.lit(":"), F.format_string("%04.1f", F.bround(seconds % 60, 1)), F.lit("] "), text)


def json_object(text: Column) -> Column:
    """The outermost {...} of a text, if it parses as an object, as a map of strings; else null."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>", {"mode": "PERMISSIVE"})


def answer_pairs(answer: Column) -> Column:
    """array<struct<value, detail>> of one field's answer as JSON text: an object {is, detail}, a string of classes between commas, or a list of either; in lower case, empty strings left out."""
    pair = lambda v, d: F.struct(F.lower(F.trim(v)).alias("value"), d.alias("detail"))
    none = F.lit("")
    item = lambda t: F.from_json(t, "struct<is:string,detail:string>")
    split = lambda t: F.transform(F.filter(F.split(t, ","), lambda x: F.trim(x) != ""), lambda x: pair(x, none))
    one = lambda t: F.when(F.startswith(t, F.lit("{")), F.transform(F.array(item(t)), lambda o: pair(F.coalesce(o["is"], none), F.coalesce(o["detail"], none)))).otherwise(split(t))
    many = F.flatten(F.transform(F.from_json(answer, "array<string>"), one))
    return F.coalesce(F.when(F.startswith(answer, F.lit("[")), many).otherwise(one(answer)), F.array().cast("array<struct<value:string,detail:string>>"))


def tempo_word(bpm: Column, confidence: Column, floor: float = 0.3) -> Column:
    """slow, moderate, fast, very fast at 80, 120 and 160; null below the confidence floor."""
    return F.when(confidence < floor, None).when(bpm < 80, "slow").when(bpm < 120, "moderate").when(bpm < 160, "fast").when(bpm >= 160, "very fast")


def question_gates(question: Column) -> Column:
    """struct<time, event, timeline, duration, order, count>: what a question's wording asks for. Null counts as empty.

    time: a span (with a later end, of at most LONGEST_SPAN seconds) or a position in the clip; event: that, or time, order, counts or the set of events; timeline: event, and no musical or
    linguistic object; the others: which derived lines it wants.
    """
    q = F.coalesce(question, F.lit(""))

    def seconds(t: Column) -> Column:
        parts = F.split(t, ":")
        return F.when(F.contains(t, F.lit(":")), F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double")).otherwise(t.try_cast("double"))

    ends = F.when(q.rlike(TIME_SPAN), F.array(*[F.regexp_extract(q, TIME_SPAN, i) for i in (1, 2)])).when(q.rlike(TIME_BARE), F.array(*[F.regexp_extract(q, TIME_BARE, i) for i in (1, 2)]))
    span = F.get(F.transform(F.array(F.transform(ends, seconds)), lambda e: F.coalesce((F.get(e, F.lit(1)) > F.get(e, F.lit(0))) & (F.get(e, F.lit(1)) - F.get(e, F.lit(0)) <= LONGEST_SPAN), F.lit(False))), F.lit(0))
    time = F.coalesce(span, F.lit(False)) | q.rlike(TIME_EDGE) | q.rlike(POSITION)
    event = time | q.rlike(TEMPORAL) | q.rlike(COUNTING) | q.rlike(EVENTS)
    return F.struct(time.alias("time"), event.alias("event"), (event & ~q.rlike(NOT_EVENTS)).alias("timeline"), q.rlike(DURATIONS).alias("duration"), q.rlike(ORDERING).alias("order"), q.rlike(COUNTING).alias("count"))
