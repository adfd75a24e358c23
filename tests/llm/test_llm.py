"""The training-data operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.llm import common, mixing, near_dedup, packing, pii, quality_model, quality_rules, sharding, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, pid int, k int, rank int, h string"
WORDS = [a + b for a in "ka lo mi ne ru ta wi zu".split() for b in "ban del fir gon hul jam".split()]


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""), 1, 2, 3, 4, 5, "h")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    out = {i: say(r.randint(30, 120)) + ".\n" + say(20) for i in range(40)}
    for i in range(40, 60):  # near copies of one text, of different nearness
        w = out[3].split(" ")
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out[i] = " ".join(w)
    out |= {60: out[5], 61: out[5].upper(), 62: None, 63: "", 64: " \n\t ", 65: "one", 66: "one", 67: say(20_000), 68: "a b", 69: "É é" * 30}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [row(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "b", "b"][i % 5]) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(texts, width, similarity):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = {x: a if c == b else c for x, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, texts, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=width).collect()}
    assert got == components(texts, width, 80)
    kept = {r.doc_id for r in near_dedup.deduplicated(docs, width=width).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([row(None, "x y z"), row(1, "x y z"), row(1, "x y z"), row(2, None)], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df, width=2).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "None", True)]


def test_clouds_in_parts(spark):
    """Copies that drift from one another: links that only pairs far from the hub have."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts, w = {}, base
    for i in range(60):
        w = [x if r.random() > 0.03 else f"n{i}_{r.randrange(9)}" for x in w]
        texts[i] = " ".join(w)
    df = spark.createDataFrame([row(i, t) for i, t in texts.items()], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, width=2).collect()}
    assert got == components(texts, 2, 80)


def test_links_inside_clouds(spark, monkeypatch):
    """Pages of one template, which link with nothing or with pages far from the hub, in clouds larger than a block, with lists long and short; and the same without an estimate."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    compared = []
    whole = near_dedup._compared_whole
    monkeypatch.setattr(near_dedup, "_compared_whole", lambda lists, members, similarity: compared.append((lists.select("block").distinct().count(), members.count())) or whole(lists, members, similarity))
    r = random.Random(11)
    template = [f"t{i}" for i in range(100)]
    page = lambda i, own: " ".join(template + [f"p{i}_{j}" for j in range(own)])
    texts = {i: page(i, 40) for i in range(80)}
    for i in range(80, 140):  # links between pages that no hub has
        w = texts[i % 20].split()
        w[r.randrange(100, 140)] = f"x{i}"
        texts[i] = " ".join(w)
    for i in range(140, 200):  # two groups at 0.7 from each other
        w = texts[79].split()
        w = w + [f"g{i % 2}_{j}" for j in range(30)]
        w[r.randrange(100)] = f"x{i}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame([row(i, t) for i, t in texts.items()], SCHEMA)
    want = components(texts, 2, 80)
    for k in (near_dedup.K, 1 << 30):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, width=2, k=k).collect()} == want
    assert compared and all(blocks * 16 < 200 for blocks, members in compared if members >= 200)
    # pages that share a template alone meet in no list
    alone = spark.createDataFrame([row(i, page(i, 40)) for i in range(80)], SCHEMA)
    compared.clear()
    assert near_dedup.near_duplicates(alone, width=2).filter("kept").count() == 80
    assert compared == [(0, 80)]


def test_mixing(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    size = {i: len((t or "").split()) for i, t in texts.items()}
    assert len(rows) == len(texts) and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rows)
    per = {}
    for r in rows:
        assert r.taken == sum(d.words for d in r.draws) <= 2 * r["size"]
        p = per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        p[2], p[3] = p[2] + r.taken, p[3] + r["size"]
    total = sum(size.values())
    assert sum(p[1] for p in per.values()) == pytest.approx(1.5 * total)
    assert all(p[0] == p[3] and abs(p[2] - p[1]) <= 1 and p[1] <= 2 * p[0] + 1e-6 for p in per.values())
    # targets, recomputed by water-filling
    names = sorted(per, key=lambda x: (x is None, x or ""))
    want, free, left = {}, {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}, 1.5 * total
    while free:
        level = left / sum(free.values())
        over = [x for x in free if free[x] * level >= 2 * per[x][0]] or list(free)
        for x in over:
            want[x] = min(2 * per[x][0], free.pop(x) * level)
            left -= want[x]
    assert all(p[1] == pytest.approx(want[x]) for x, p in per.items())
    # every leaf holds what the tree gave it
    shards = Counter(d.shard for r in rows for d in r.draws)
    assert max(shards.values()) - min(shards.values()) <= 5  # halves differ by one at each of four levels
    blocks = Counter(r.source for r in rows for d in r.draws)
    quotas = spark.createDataFrame([(k, blocks[x]) for k, x in enumerate(names)], "k int, quota long")
    leaves = {names[r.k]: [y - x for x, y in zip(r.bounds, r.bounds[1:], strict=False)] for r in mixing.split_quotas(quotas, 4, 7).collect()}
    got = Counter((r.source, d.shard) for r in rows for d in r.draws)
    assert all(got[x, s] == n for x, ns in leaves.items() for s, n in enumerate(ns)) and len(shards) == 16
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_rows(spark):
    """Null and repeated ids are drawn to the word, and the mix comes by shard, in the order of place."""
    rows = [row(None, " ".join(WORDS[: 5 + i % 7]), "en", "ab"[i % 2]) for i in range(30)] + [row(1, " ".join(WORDS[:9]), "en", "a")] * 6 + [row(i, " ".join(WORDS[3:12]), "en", "b") for i in range(40, 80)]
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = mixing.mix(df).collect()
    out = mixing.mixed_documents(df).withColumn("part", F.spark_partition_id()).collect()
    for source in "ab":
        assert sum(len(r.text.split()) for r in out if r.source == source) == sum(r.taken for r in drawn if r.source == source) > 0
    count = lambda rs: Counter(r.doc_id for r in rs)
    assert count(out) == count([r for r in drawn for _ in r.draws]) and count(out)[None] > 0
    # in the test session a partition is a shard
    want = sorted((d.shard, d.place, r.doc_id, d.words) for r in drawn for d in r.draws for _ in [0] if d is not None and r.doc_id and r.doc_id >= 40)
    got = [(r.part, r.doc_id, len(r.text.split())) for r in out if r.doc_id and r.doc_id >= 40]
    assert got == [(s, i, n) for s, _, i, n in want]


def test_hypergeometric(spark):
    x = spark.range(4000).select(mixing.hypergeometric(F.lit(1000).cast("long"), F.lit(300).cast("long"), F.lit(200).cast("long"), F.rand(3)).alias("x")).toPandas().x
    assert abs(x.mean() - 60) < 0.6 and abs(x.std() - 5.8) < 0.4


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    bad = ["grumflax", "zilborn", "quastrit"]
    rows, labels = [], []
    for i in range(300):
        w = [r.choice(WORDS) for _ in range(60)]
        toxic = int(i % 4 == 0)
        junk = int(i % 5 == 0)
        for _ in range(3 * toxic):
            x = r.choice(bad)
            k = r.randrange(2, len(x) - 2)
            w[r.randrange(len(w))] = r.choice([x, x, x, x[:k] + "." + x[k:], x.upper()])
        text = ". ".join(x[0].upper() + x[1:] for x in (" ".join(w[j : j + 10]) for j in range(0, 60, 10)))
        rows.append(row(i, text.upper() + " ### $$$ ### %%%" * 10 if junk else text))
        labels.append((i, 1 - junk, toxic, "x"))
    rows += [row(900, None), row(901, ""), row(None, "abc")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1, "x"), (5000, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def accuracy(scores, labels, label):
    j = [r for r in scores.filter("held_out").select("doc_id", "predicted").join(labels.select("doc_id", label), "doc_id").collect() if r[2] is not None]
    return sum(r[1] == r[2] for r in j) / len(j)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    s = toxicity.toxicity_scores(docs, labels).cache()
    assert s.count() == 303 and s.filter("score is null or score < 0 or score > 1").count() == 0
    assert accuracy(s, labels, "toxic") >= 0.9
    got = {r.doc_id: r.held_out for r in s.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items() if i is not None)
    none = toxicity.toxicity_scores(docs, labels.filter("1 = 0"))
    assert none.filter("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0


def test_subsequence_kernel():
    k = toxicity.kernel(["idiot", "idxiot", "idiiot", "lantern"], toxicity.profile(["idiot"]))[:, 0]
    assert k[0] == pytest.approx(1) and k[1] > 0.5 and k[2] > 0.5 and k[3] < 0.1
    assert toxicity.words_of("You I.d.i-o t! a b c d") == ["you", "idio", "abcd"] or "idio" in toxicity.words_of("You I.d.i-o t!")
    model = toxicity.Model(["idiot", "trash"], 2, 0.0, 1.0, None, 0.0).ready()
    words = ["idiot", "ididiot", "trashcan", "lantern", "x" * 40]
    assert (toxicity._bounds(words, model.most) + 1e-5 >= toxicity.kernel(words, model.prof).max(1)).all()


def test_toxicity_with_full_memory(monkeypatch):
    """Words seen before are known after memory was full, as without a bound."""
    make = lambda: toxicity.Model(["idiot", "trash"], 2, 0.0, 1.0, np.array([5.0, 5.0]), -1.0).ready()
    r = random.Random(3)
    texts = [f"you idiot {r.choice(WORDS)}x{i} " + r.choice(WORDS) for i in range(40)]
    whole = make().scores(texts, raw=True, step=4)
    sentences = pa.RecordBatch.from_pydict({"h": pa.array(range(40), pa.int64()), "y": pa.array([1] * 40, pa.int32()), "words": [" ".join(toxicity.words_of(t)) for t in texts]})
    parts = [sentences.slice(i, 4) for i in range(0, 40, 4)]
    monkeypatch.setattr(toxicity, "HELD", 6)
    assert min(whole) > 0 and make().scores(texts, raw=True, step=4) == whole
    assert sum(b.num_rows for b in toxicity._featured(make())(iter(parts))) == 40


def spread(w, n, r, letters="abcdefghijklmnopqrstuvwxyz"):
    for _ in range(n):
        k = r.randrange(1, len(w))
        w = w[:k] + r.choice(letters) + w[k:]
    return w


def test_inserted_letters():
    r = random.Random(4)
    bad = ["trash", "idiot", "clown", "loser", "scum", "moron", "stupid", "scumbag", "идиот", "дурак"]
    model = toxicity.Model(bad, len(bad), 0.0, 1.0, None, 0.0).ready()
    words = {spread(w, n, r) for w in bad for n in (1, 2, 3) for _ in range(20)}
    model.learn(words | {"lantern", "привет", "человек", "погода"})
    assert set(model.known) >= words and {"lantern", "привет", "человек", "погода"}.isdisjoint(model.known)
    assert toxicity._without_inserted("idxixots", "idiot") == ("idiots", 2) and toxicity._without_inserted("idea", "idiot")[1] == -1
    assert (toxicity._bounds(sorted(words), model.most) + 1e-5 >= toxicity.kernel(sorted(words), model.prof).max(1)).all()


def test_toxicity_inserted(spark):
    """Held-out documents with insults that have two and three letters inserted, in two scripts."""
    r = random.Random(9)
    bad = ["idiot", "trash", "stupid", "дурак", "подлец"]
    other = [a + b for a in "ка ло ми не ру та ви зу".split() for b in "бан дел фир гон хул жам".split()]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(WORDS + other) for _ in range(40)]
        if i % 3 == 0:
            x = r.choice(bad)
            held = zlib.crc32(str(i).encode()) % 5 == 0
            w[r.randrange(40)] = spread(x, r.choice([2, 3]) if held else r.choice([0, 0, 1, 2, 3]), r, "abcdefghijklmnop" if x.isascii() else "абвгдежзийклмноп")
        rows.append(row(i, ". ".join(" ".join(w[j : j + 8]) for j in range(0, 40, 8))))
        labels.append((i, 1, int(i % 3 == 0)))
    got = toxicity.toxicity_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("held_out").collect()
    planted = [x.predicted for x in got if x.doc_id % 3 == 0]
    assert len(planted) > 20 and sum(planted) >= 0.9 * len(planted)
    assert sum(x.predicted for x in got if x.doc_id % 3) <= 0.05 * len(got)


def test_rule_ensemble(spark, labelled):
    docs, labels = labelled
    s = quality_model.quality_scores(docs, labels)
    assert s.count() == 303 and s.filter("score is null").count() == 0
    assert accuracy(s, labels, "quality") >= 0.95
    good = quality_model.good_documents(docs, labels)
    assert good.columns == docs.columns and good.count() < 303
    one = quality_model.quality_scores(docs, labels.filter("quality = 1"))
    assert one.filter("predicted = 0").count() == 0
    assert quality_model.quality_scores(empty(spark), labels).count() == 0


def test_quality_rules(spark, docs, texts):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in texts.items():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        c = Counter(tri)
        rep = len({k for j, x in enumerate(tri) if c[x] > 1 for k in (j, j + 1, j + 2)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_divergence_tells_junk(labelled):
    docs, labels = labelled
    r = quality_rules.quality_rules(docs).join(labels.select("doc_id", "quality"), "doc_id").collect()
    judged = [x for x in r if x.quality is not None and x.n_words >= 50]
    assert len(judged) > 200 and all((x.char_distance <= quality_rules.CHAR_LIMIT) == (x.quality == 1) for x in judged)
    assert not any(x.kept for x in judged if x.quality == 0)


def test_divergence_rare_tags(spark):
    """Junk under rare language tags makes no reference, for itself or for junk under other tags; a null tag is a language."""
    r = random.Random(6)
    prose = lambda: ". ".join(" ".join(r.choice(WORDS[:25]) for _ in range(10)) for _ in range(8))
    junk = lambda: " ".join("".join(r.choice("QXZ#%&@") for _ in range(6)) for _ in range(80))
    rows = [row(i, prose(), "en") for i in range(60)] + [row(100 + i, prose(), None) for i in range(30)]
    rows += [row(200 + i, junk(), "en") for i in range(5)] + [row(300 + i, junk(), f"x{i % 3}") for i in range(5)] + [row(400, prose(), "y")]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, k in kept.items() if k != (i < 200 or i == 400)] == []
    # many junk texts of one tag make no reference either: of random words, and of a few repeated ones; digits are no letters
    rows += [row(500 + i, junk(), "zz") for i in range(30)]
    rows += [row(600 + i, " ".join(r.choice(["#$%", "&&&", "@@", "%%|", "12"]) + str(r.randrange(9)) for _ in range(100)), "yy") for i in range(30)]
    rows += [row(700 + i, " ".join("".join(r.choice("qxzjkw") for _ in range(7)) for _ in range(80)), "ww") for i in range(30)]
    rows += [row(800 + i, " ".join(str(r.randrange(10**6)) for _ in range(80)), "nn") for i in range(30)]
    more = spark.createDataFrame(rows, SCHEMA)
    assert [lang for lang, *_ in quality_rules.references(more)] == [("en",), (None,)]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(more).collect()}
    assert {i for i, k in kept.items() if k} == {i for i in kept if i < 200 or i == 400}


def test_divergence_of_scripts(spark):
    """A script without spaces between words keeps its reference; distances and verdicts are those of a plain version."""
    r = random.Random(7)
    prose = lambda: ". ".join(" ".join(r.choice(WORDS[:25]) for _ in range(10)) for _ in range(8))
    signs = lambda: " ".join("".join(chr(0x4E00 + r.randrange(2000)) for _ in range(20)) for _ in range(60))
    rows = [row(i, prose(), "en") for i in range(40)] + [row(100 + i, signs(), "zh") for i in range(40)]
    rows += [row(200 + i, prose().upper(), "en") for i in range(3)] + [row(300, "a b", "en"), row(301, None, "zh"), row(302, prose()[:150], "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    refs = {lang: (chars, words, hist) for lang, chars, words, hist in quality_rules.references(df)}
    assert set(refs) == {("en",), ("zh",)}

    def distance(p, q):
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))

    texts = {x["doc_id"] if isinstance(x, dict) else x[0]: x for x in map(tuple, df.select("doc_id", "text", "lang").collect())}
    for x in quality_rules.quality_rules(df).collect():
        _, text, lang = texts[x.doc_id]
        b = (text or "").encode()
        chars, words, hist = refs[lang,]
        if len(b) < 200:
            assert x.char_distance is None
        else:
            n = Counter("letter" if 97 <= c <= 122 or c > 127 or 48 <= c <= 57 else "upper" if 65 <= c <= 90 else "space" if c in b" \t\n\x0b\x0c\r" else "stop" if c in b".,;:'\"?()-" else "mark" for c in b)
            assert x.char_distance == pytest.approx(distance([n[k] / len(b) for k in quality_rules.BINS], list(chars)), abs=1e-6)
        own = b.lower().split()
        if len(own) < 50:
            assert x.word_distance is None
        else:
            c = Counter(words.index(w) if w in words else -1 for w in own)
            assert x.word_distance == pytest.approx(distance([c[j] / len(own) for j in [*range(len(words)), -1]], list(hist)), abs=1e-6)
        far = (x.char_distance or 0) > quality_rules.CHAR_LIMIT or (x.word_distance or 0) > quality_rules.WORD_LIMIT
        assert x.kept == (not x.base_failed and not far)


def test_packing(spark, docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = {100: "a  b\n\nc \t d", 101: "don't  'll x <|endoftext|>  ", 102: "x" * 5000, 103: " lead and trail \n", 104: "日本語 テキスト 🙂🙂 é"}
    every = texts | odd
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in every.items()}
    rows = packing.pack(docs.unionByName(spark.createDataFrame([row(i, x, "en", "odd") for i, x in odd.items()], SCHEMA)), length=256, window=4, smallest=32, added=packing.added_tokens()).collect()
    seqs = {}
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(own)
    for parts in seqs.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
    full = [sum(n for _, n in p) for p in seqs.values()]
    assert max(full) == 256 and sum(n < 256 for n in full) <= 1
    weighted = packing.pack(docs, length=256, window=4, smallest=32, weights={"a": 1, "b": 3})
    assert weighted.agg(F.sum("length")).first()[0] == sum(len(ids[i]) for i in texts)
    # while both queues last, each window holds one token of a for three of b, but for the piece that a deficit carries on
    named = {x.doc_id: x.source for x in docs.collect()}
    share = {}
    for x in weighted.collect():
        share.setdefault((x.sequence_id * 256 + x.offset) // 1024, Counter())[named[x.doc_id]] += x.length
    ends = {x: max(w for w, c in share.items() if c[x]) for x in "ab"}
    early = [c for w, c in share.items() if w < min(ends.values()) - 1]
    assert early and all(abs(c["a"] - 256) <= 64 and abs(c["b"] - 768) <= 64 for c in early)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_added_tokens(spark, tmp_path):
    """Ids as the tokenizer gives them in its default setting, in the query and in the pipeline's stage."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    import corpus_pipeline
    from canopy.llm import queries

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["end <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b  c", "no <|endoftext| >", "x  <|endoftext|>  y"]
    docs = spark.createDataFrame([row(i, x) for i, x in enumerate(texts)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in texts]
    want = [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    for got in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got.collect()) == want
    assert 50256 in ids[0]


def test_warc(spark, tmp_path):
    r = random.Random(4)
    big = "".join(r.choice("abc é<>\n") for _ in range(30_000))
    pages = [(1, "http://a/1", "x" * 99, "r"), (2, "http://a/2", "x" * 99, "r"), (5, "u", "y" * 100, "r"), (3, "u v", "y" * 100, "r"), (4, None, None, "r"), (6, "u", big, "r"), (7, "u", big + "!", "r"), (8, "u", big, "r"), (9, "u", "WARC/1.1\r\n\r\n" * 50, "r"), (None, "u", "y" * 100, "r"), (10, "u", big[:5000], "r"), (10, "u", big[:5000], "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string")
    got = sorted(warc.archive_round_trip(df, segment=700).collect(), key=str)
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        rev = len(b) >= 100 and sum((x[2] or "") == (h or "") for x in pages) > 1 and first[h or ""] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", first[h] if rev else None, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # a missing part is told
    path = str(tmp_path / "cut")
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:a:1>\r\nWARC-Segment-Number: 1\r\nContent-Length: 3\r\n\r\nabc",)], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    assert [x.complete for x in warc.read_archives(spark, path).collect()] == [False]
    assert warc.archive_round_trip(df.filter("1 = 0")).count() == 0
    # broken records don't hide the others
    rec = lambda n, body, length=None, kind="response": f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}:a:1>\r\n{'' if length == '' else f'Content-Length: {len(body) if length is None else length}'}\r\n\r\n{body}"
    http = "HTTP/1.1 200 OK\r\n\r\n"
    lines = [rec(1, http + "one"), rec(2, http + "two", ""), rec(3, http + "three", "x7"), rec(4, http + "WARC/1.1\r\n\r\nWARC/"), rec(5, http + "five", 9999), rec(6, http + "six"), rec(7, "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nab"), rec(8, "x", None, "request"), "WARC/1.1\r\nWARC-Ty"]
    want = {"1": (True, b"one"), "2": (False, None), "3": (False, None), "4": (True, b"WARC/1.1\r\n\r\nWARC/"), "5": (False, None), "6": (True, b"six"), "7": (False, None), None: (False, None)}
    for name, zipped in (("plain", "none"), ("zipped", "gzip")):
        path = str(tmp_path / name)
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", zipped).text(path)
        got = warc.read_archives(spark, path).collect()
        assert {x.record_id and x.record_id.split(":")[2]: (x.complete, x.payload and bytes(x.payload)) for x in got} == want and len(got) == 8
    assert warc.unchunked(warc.chunked(big.encode(), 17)) == big.encode()


RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]

    return sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, r) in enumerate(RX.items()) for m in re.finditer(r, t) if ok(k, m.group()))


def test_pii(spark):
    texts = [None, "", "@@a@b.c a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "4111 1111 1111 1111 +1 (456) 555-2186, é😀 a@b.co iban GB82 WEST 1234 5698 7654 32", "1" * 20_000, "a" * 20_000 + "@x.com", "5-5-5- 5 378282246310005", "social security 123-45-6789 and 123-45-6789"]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    for r in pii.pii_report(df).collect():
        want = [s for _, _, s in base_spans(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in RX]
        assert set(want) <= set(r.spans.split(",")) | ({""} if not want else set())
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert got[3].text == "[CARD] [PHONE], é😀 [EMAIL] iban [IBAN]" and got[3].n_chars == len(got[3].text)
    assert got[0].text is None and got[7].text.startswith("social security [SSN]")
    assert pii.pii_report(empty(spark)).count() == 0


def test_pii_lists(spark):
    """A context word counts for all numbers of a list, after it or before it, in the plural too; far words don't."""
    ssn = [f"219-09-{9000 + i}" for i in range(12)]
    texts = ["SSN 219-09-9999, 219-09-9998", "SSNs: 000-09-9999, 219-09-9998 and 219-09-9997", "SSN " + ", ".join(ssn), "219-09-9999 is their social security number", "no 219-09-9999, 219-09-9998", "ssn" + " x" * 30 + " 219-09-9999", "é😀 SSN 219-09-9999 x 219-09-9998"]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("ssn")] for r in pii.pii_report(df).collect()}
    got = {i: [texts[i][a:b] for a, b in s] for i, s in spans.items()}
    assert got == {0: ["219-09-9999", "219-09-9998"], 1: ["219-09-9998", "219-09-9997"], 2: ssn, 3: ["219-09-9999"], 4: [], 5: [], 6: ["219-09-9999", "219-09-9998"]}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "SSN [SSN], [SSN]"


def test_top_k(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(6)], "x") for i in range(400)] + [(1000 + i, [1.0] * 6, "x") for i in range(50)]
    rows += [(2000, None, "x"), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (2200, [float("nan")] * 6, "x"), (2300, [1.0, 2.0], "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    import math

    v = {i: [math.floor(1024 * y) for y in x] for i, x, _ in rows if i is not None and x and all(y is not None and math.isfinite(y) for y in x)}
    want = {}
    for q in (i for i in v if i % 100 == 0):
        s = sorted(((-sum(a * b for a, b in zip(v[q], x, strict=False)), i) for i, x in v.items() if i != q))[:10]
        want |= {(q, n + 1): (i, -z) for n, (z, i) in enumerate(s)}
    assert got == want
    parts = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df.withColumn("b", F.lit(1)), F.col("vec_id") % 100 == 0, group_bytes=1).collect()}
    assert parts == want
    assert topk.top_k(df.filter("1 = 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id in (100, 101, 102)"), F.col("vec_id") % 100 == 0).count() == 2


@pytest.mark.parametrize("name", ["op1_near_dedup", "op6_warc", "op8_top_k"])
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from canopy.llm import queries

    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name]).fetchall()
    cols = [d[0] for d in db.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, at).select(*cols).collect()) and want


def test_blocks():
    """Blocks of sketches give a forest of the links between whole sets, and all other pairs that may be links."""
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 1 << 40, n)) for n in (30, 60, 90, 400, 420)]
    sets = []
    for i in range(120):
        own = base[i % 5]
        swap = r.random(len(own)) < r.choice([0.0, 0.03, 0.2])
        sets.append(np.unique(np.where(swap, r.integers(0, 1 << 40, len(own)), own)))
    k = 96
    members = [{"id": i, "n": len(s), "comp": i // 2, "s": s[:k].tolist()} for i, s in enumerate(sets)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("comp", pa.int64()), ("s", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([members], kind)] * 2, ["q", "x"])
    got = [tuple(x.values()) for b in near_dedup._blocks(80, k, 0.6)([batch]) for x in b.to_pylist()]
    sim = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    links = {(a, b) for a in range(120) for b in range(a + 1, 120) if a // 2 != b // 2 and sim(a, b) >= 0.8}
    whole = {(a, b) for a, b in links if max(len(sets[a]), len(sets[b])) <= k}
    sure, maybe = {(a, b) for a, b, s in got if s}, {(a, b) for a, b, s in got if not s}
    assert sure <= whole and links - whole <= maybe and whole and links - whole

    def parts(edges):
        up = list(range(120))
        for _ in range(120):
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert parts(sure) == parts(whole) and len(sure) < len(whole)


def test_sharding(spark, docs, texts):
    rows = sharding.shard_documents(docs).collect()
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in by.values())
    n = [len(by.get(s, [])) for s in range(16)]
    assert max(n) - min(n) <= 1
    assert sharding.shard_documents(empty(spark)).count() == 0
    # the cells are ranks by frequency, and places follow the curve, then the ties
    def rank(c):
        n = Counter(r[c] for r in rows if r[c] is not None)
        return {None: 0} | {v: i + 1 for i, v in enumerate(sorted(n, key=lambda v: (-n[v], v)))}

    lang, source = rank("lang"), rank("source")
    cell = [(lang[r.lang], source[r.source], min(31, int(np.floor(np.log2(r["size"]) * 31 / 24)))) for r in rows]
    curve = spark.createDataFrame([(i, *c) for i, c in enumerate(cell)], "i int, a int, b int, c int").select("i", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 5).alias("h")).collect()
    at = {x.i: x.h for x in curve}
    order = sorted(range(len(rows)), key=lambda i: (at[i], rows[i].doc_id, rows[i].text_crc32, rows[i]["size"]))
    assert [(rows[i].shard, rows[i].slot) for i in order] == sorted((r.shard, r.slot) for r in rows) and all(rows[i].hilbert == at[i] for i in order)


def test_shard_files(spark, tmp_path):
    """Null and repeated ids are written once each, and most files can be left out by a filter on a dimension."""
    r = random.Random(3)
    rows = [row(None if i % 50 == 0 else i // 2, " ".join(WORDS[: r.randint(1, 40)]) * r.choice([1, 1, 9]), r.choice(["en", "de", "fr", "es"]), r.choice("abcdefgh")) for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    path = str(tmp_path / "shards")
    sharding.write_shards(df, path, n_shards=8)
    back = spark.read.parquet(path)
    cols = [c for c in df.columns if c != "shard"]
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, df.select(*cols).collect()))
    n = [x["count"] for x in back.groupBy("shard").count().collect()]
    assert len(n) == 8 and max(n) - min(n) <= 1
    files = back.groupBy(F.input_file_name().alias("f")).agg(*[g(c).alias(f"{c}_{k}") for c in ("lang", "source") for k, g in (("lo", F.min), ("hi", F.max))]).collect()
    skipped = lambda c, vs: np.mean([not f[f"{c}_lo"] <= v <= f[f"{c}_hi"] for v in vs for f in files])
    assert skipped("lang", ["en", "de", "fr", "es"]) > 0.2 and skipped("source", "abcdefgh") > 0.3


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 2)])
def test_hilbert_curve(spark, dims, bits):
    side = 1 << bits
    axes = [F.floor(F.col("id") / side**d).cast("long") % side for d in range(dims)]
    h = spark.range(side**dims).select(*[a.alias(f"x{i}") for i, a in enumerate(axes)], sharding.hilbert_index(axes, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in h] == list(range(side**dims))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(h, h[1:], strict=False))


def test_pipeline(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    d, keep = docs.select("doc_id", "text", "lang", "source", "n_chars"), None
    for name, stage in corpus_pipeline.STAGES:
        d = common.stage(stage(spark, d, str(tmp_path)), "test")
        if name != "packing":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        keep = {"quality": d.count()}.get(name, keep)
    assert 0 < keep < 303 and sorted(map(str, got)) == sorted(map(str, d.collect()))


def test_pipeline_edges(spark, labelled, tmp_path):
    """Every stage: an empty table, null and repeated ids and rows, empty texts, and columns whose names the operators use themselves."""
    import corpus_pipeline

    _, labels = labelled
    labels.select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    say = " ".join(WORDS) + ". "
    rows = [row(i, f"{say * 2}{WORDS[i]} {i}" if i < 12 else [None, "", " ", "one"][i % 4], "en", [None, "a", "b"][i % 3]) for i in range(20)]
    rows += [row(None, say * 3), row(None, None), row(3, say + "again"), row(3, say + "again"), row(4, rows[4][1])]
    own = "a int, b int, v int, f int, m int, q int, x int, s int, comp int, cloud int, block int, digest string, sketch string, shard int, slot int, draws int, taken int, target int, _row int, _d int, _draws int, _size int, y int, score int, kept int, ids int, at int"
    names = [c.split()[0] for c in own.split(", ")]
    full = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).cast(c.split()[1]).alias(c.split()[0]) for c in own.split(", ") if c.split()[0] not in SCHEMA.replace(",", "").split()])
    assert "_row" in full.columns and "cloud" in names
    for docs in (full, full.filter("1 = 0")):
        d = docs
        for name, stage in corpus_pipeline.STAGES:
            out = common.stage(stage(spark, d, str(tmp_path)), "edges")
            if name == "packing":
                assert out.count() >= d.count() and (out.count() > 0) == (d.count() > 0)
            else:
                assert out.columns == docs.columns, name
                assert out.count() <= 2 * d.count() and (name in ("quality", "near_dedup", "mixing") or out.count() == d.count())
            if name == "near_dedup" and d.count():
                assert out.filter("doc_id is null").count() == d.filter("doc_id is null").count()
            d = out
