"""Centroid clustering and vector codes against brute force in Python's integers, and the transform they search on."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from canopy.llm import centroids, codes, walsh

SCHEMA = "vec_id long, embedding array<double>, label int, x int, cluster int, code string, n long, total int, distance long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, 2, "c", 3, 4, 5) for i, e, label in rows], SCHEMA)


def ints(e, scale=256):
    return [math.floor(scale * x) if abs(x) < 2**52 else int(x) * scale for x in e]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def best(x, entries):
    return min((square(x, c), k) for k, c in enumerate(entries))


def moved(entries, members):
    return [[sum(col) // len(members[k]) for col in zip(*members[k], strict=True)] if members.get(k) else c for k, c in enumerate(entries)]


def sha(*numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(3)
    near = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in near[i % 6]], [None, 0, 1, 1][i % 4]) for i in range(120)]
    rows += [(200 + i, near[0], 1) for i in range(40)]  # ties: equal vectors under many ids
    rows += [(7, rows[7][1], 0), (7, rows[8][1], None)]  # repeated ids
    return rows + [(None, near[1], 1), (301, [1e5] * 64, 2), (302, [-7.5e6] * 64, 2)]  # a null id; squares beyond 64 bits


BAD = [(400, None, 0), (401, [0.5] * 63 + [None], 0), (402, [0.5] * 63 + [math.nan], 0), (403, [0.5] * 63 + [-math.inf], None), (404, [1e308] + [0.0] * 63, 0)]


def test_transform():
    for n in (1, 2, 4, 16, 64):
        h = walsh.transform(np.eye(n, dtype=np.int64)).T
        assert (np.abs(h) == 1).all() and (h @ h.T == n * np.eye(n)).all() and [(np.diff(r) != 0).sum() for r in h] == list(range(n))
    assert walsh.padded(np.ones((2, 5), np.int64)).shape == (2, 8) and walsh.padded(np.ones((2, 1), np.int64)).shape == (2, 1)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_progressive_search(kind):
    r = np.random.default_rng(1)
    c = np.repeat(r.integers(-900, 900, (20, 64)), 2, 0)  # every entry twice: ties
    x = c[r.integers(0, 40, 3000)] + r.integers(-9, 9, (3000, 64))
    x[:50] = (c[0] + c[2]) // 2
    made = []
    near, far = walsh.nearest(walsh.transform(x).astype(kind), walsh.transform(c).astype(kind), seen=made)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (far == 64 * d.min(1)).all() and (near % 2 == 0).all()
    assert sum(made) < 0.3 * x.shape[0] * 40 * 64  # most entries are out before their last coefficients


def test_integers():
    column = pa.array([[0.5, -0.001], None, [1.0], [None, 1.0], [math.nan, 1.0], [], [1e15, 2.0], [1e300, 0.0]], pa.list_(pa.float64()))
    which, x = walsh.integers(column, 256)
    assert which.tolist() == [0, 2, 5, 6] and x.tolist() == [[128, -1], [256, 0], [0, 0], [256 * 10**15, 512]] and x.dtype == object
    which, x = walsh.integers(column.slice(0, 5), 256, 2)
    assert which.tolist() == [0] and x.tolist() == [[128, -1]] and x.dtype == np.int64


def brute_clusters(rows, k, rounds):
    kept = [(i, ints(e)) for i, e in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [e for _, e in order[:k]]
    for _ in range(rounds):
        members = {}
        for _, e in kept:
            members.setdefault(best(e, c)[1], []).append(e)
        c = moved(c, members)
    at = [(i, *best(e, c)) for i, e in kept]
    per = {g: sum(d for _, d, h in at if h == g) for _, _, g in at}
    return sorted(((i, g, d, per[g], sum(per.values()), sha(*c[g])) for i, d, g in at), key=str)


def test_clusters(spark, vectors):
    wrong = BAD + [(500, [0.1] * 63, 0), (501, [], 0), (502, [0.1] * 65, 0)]
    got = centroids.clusters(rows_of(spark, vectors + wrong).repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = brute_clusters([(i, e) for i, e, _ in vectors], 40, 5)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({r[1] for r in want}) > 6
    few = vectors[:3]
    assert sorted(map(tuple, centroids.clusters(rows_of(spark, few)).collect()), key=str) == brute_clusters([(i, e) for i, e, _ in few], 40, 5)


def test_clusters_of_nothing(spark):
    for rows in ([], BAD):
        got = centroids.clusters(rows_of(spark, rows))
        assert got.count() == 0 and dict(got.dtypes)["inertia"] == "bigint"


def test_clusters_beyond_a_long(spark):
    got = {r.vec_id: r for r in centroids.clusters(rows_of(spark, [(i, [1e12 * i] + [0.0] * 63, 0) for i in range(3)]), k=1, rounds=0).collect()}
    start = min(range(3), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    assert {i: r.distance for i, r in got.items()} == {i: 0 if i == start else None for i in range(3)}


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, ints(e), label) for i, e, label in rows]
    dim = -(-max(1, max(len(e) for _, e, _ in kept)) // parts) * parts
    cut = [(i, [(e + [0] * dim)[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)], label) for i, e, label in kept]
    order = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[e[p] for _, e, _ in order[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, e, _ in cut:
                members.setdefault(best(e[p], books[p])[1], []).append(e[p])
            books[p] = moved(books[p], members)
    found = [(i, [best(e[p], books[p]) for p in range(parts)], label) for i, e, label in cut]
    error = {}
    for _, hits, label in found:
        error[label] = error.get(label, 0) + sum(d for d, _ in hits)
    digest = sha(*(x for book in books for e in book for x in e))
    return sorted(((i, "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits), error[label], digest) for i, hits, label in found), key=str)


@pytest.mark.parametrize("dim", [64, 45, 3])
def test_codes(spark, vectors, dim):
    """64 components; 45, cut to 16 parts of 3 and searched on 4; and 3, with shorter and empty vectors among them."""
    rows = [(i, e[:dim], label) for i, e, label in vectors] + ([(600, [0.25], 5), (601, [], 5)] if dim == 3 else [])
    got = codes.vector_codes(rows_of(spark, rows + BAD).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_codes_edges(spark):
    for rows in ([], BAD):
        assert codes.vector_codes(rows_of(spark, rows)).count() == 0
    only = [(1, [], None), (2, [], 3)]
    assert sorted(map(tuple, codes.vector_codes(rows_of(spark, only)).collect()), key=str) == brute_codes(only)
    with pytest.raises(ValueError, match="256"):
        codes.vector_codes(rows_of(spark, only), entries=257)


def test_archives_by_any_name(spark, tmp_path):
    """Plain archives whose names end in z, and compressed ones, are all read."""
    import gzip

    from canopy.llm import warc

    warc.write_archives(spark.createDataFrame([(1, "u", "<p>one</p>")], "page_id long, url string, html string"), f"file://{tmp_path}/made")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "made").iterdir()) if p.name.endswith(".gz"))
    (tmp_path / "in").mkdir()
    for name in ("part-a", "part-z", "part-gz", "x.warc"):
        (tmp_path / "in" / name).write_bytes(raw)
    (tmp_path / "in" / "packed.warc.gz").write_bytes(gzip.compress(raw))
    got = warc.read_archives(spark, f"file://{tmp_path}/in").collect()
    assert len(got) == 5 and {(r.record_type, bytes(r.payload), r.complete) for r in got} == {("response", b"<p>one</p>", True)}
