"""Vector codes, centroid clustering and WARC archives against brute force over whole tables, and their odd inputs."""

import gzip
import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import exponion, partcodes, queries as Q, warc
from tidemark.llm.common import shared_dir


def floors(x, scale):
    return [math.floor(scale * float(v)) for v in x]


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label), all of one length."""
    data = [(i, floors(x, scale), label) for i, x, label in rows]
    width = len(data[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(data, key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    pick = lambda p, x: min(range(len(books[p])), key=lambda k: (far(cut(x, p), books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, x, _ in data:
                own[pick(p, x)].append(cut(x, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[k])] if own[k] else books[p][k] for k in range(len(books[p]))]
    out, by_label = [], defaultdict(int)
    for i, x, label in data:
        code = [pick(p, x) for p in range(parts)]
        error = sum(far(cut(x, p), books[p][c]) for p, c in enumerate(code))
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, code, error, by_label[label], digest) for i, code, error, label in out)


def brute_clusters(rows, clusters=40, rounds=5, scale=256):
    """rows: (vec_id, vector), all kept."""
    data = [(i, np.array(floors(x, scale), np.int64)) for i, x in rows]
    seeds = sorted(data, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:clusters]
    at = np.stack([x for _, x in seeds])
    x = np.stack([x for _, x in data])
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
        of = d.argmin(axis=1)
        if turn < rounds:
            at = np.stack([x[of == k].sum(axis=0) // (of == k).sum() if (of == k).any() else at[k] for k in range(len(at))])
    own = d[np.arange(len(x)), of]
    named = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    return sorted((i, int(k), int(e), int(own[of == k].sum()), int(own.sum()), named[k]) for (i, _), k, e in zip(data, of, own))


def vectors_of(spark, sf):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def test_op11_as_brute_force(spark, sf):
    got = Q.op11_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == brute_codes(vectors_of(spark, sf))


def test_op12_as_brute_force(spark, sf):
    got = Q.op12_centroid_clustering(spark, sf).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got)) == brute_clusters([r[:2] for r in vectors_of(spark, sf)])


VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, n int, code string, error int, of int, cluster int"


def odd_vectors(spark, *rows):
    return spark.createDataFrame([(*r, "i", 1, 2, "c", 3, 4, 5) for r in rows], VECTORS)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(7, [0.5, -0.5], 1), (7, [0.25, -0.5], None), (2, [0.0, 0.0], None), (5, [0.5, -0.5], 1), (5, [0.5, -0.5], 1), (9, [1e30, -1e30], 2)]
    gone = [(1, None, 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (6, [1.0, inf], None)]
    other = [(8, [1.0, 2.0, 3.0], 1), (10, [], None), (None, [0.0, 0.0], 3)]
    got = partcodes.compress(odd_vectors(spark, *kept, *gone, *other), parts=2, entries=3, rounds=2).collect()
    assert sorted([r.vec_id for r in got], key=str) == sorted([r[0] for r in kept + other], key=str)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert all(by_id[i][0].code is None and by_id[i][0].error is None for i in (8, 10))
    assert by_id[8][0].label_error == by_id[5][0].label_error and by_id[10][0].label_error == by_id[2][0].label_error
    assert len({r.codebooks_sha256 for r in got}) == 1 and len({r.code for r in by_id[5]}) == 1
    assert partcodes.compress(odd_vectors(spark)).collect() == []
    assert [(r.vec_id, r.code) for r in partcodes.compress(odd_vectors(spark, *gone, (8, [1.0, 2.0, 3.0], 1))).collect()] == [(8, None)]


def test_codes_with_ties_and_unused_entries(spark):
    rows = [(i, [float(i // 4), float(-(i % 3)), 0.5, 0.5], i % 2) for i in range(60)]  # equal starting parts: the later ones stay unused
    got = partcodes.compress(odd_vectors(spark, *rows).repartition(7), parts=2, entries=5, rounds=3, scale=4)
    assert sorted(tuple(r)[:3] + tuple(r)[3:] for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == brute_codes(rows, 2, 5, 3, 4)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(1, 4), st.integers(0, 2**31), st.sampled_from([2, 40, 1 << 26]))
def test_exponion_keeps_ties_and_bounds(clusters, dims, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (90, dims))
    at, before, state = x[:clusters].copy(), None, (None, None, None)
    for _ in range(5):
        *state, _ = exponion.Centroids(at, before).assign(x, *state)
        d = np.array([[sum((int(u) - int(v)) ** 2 for u, v in zip(a, c)) for c in at] for a in x], dtype=object)
        assert [int(k) for k in state[0]] == [min(range(clusters), key=lambda k: (r[k], k)) for r in d]
        before, at = at, np.stack([x[state[0] == k].sum(axis=0) // (state[0] == k).sum() if (state[0] == k).any() else at[k] for k in range(clusters)])


def test_exponion_compares_few_where_clusters_are_apart():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-20, 21, (100, 8)) + 2000 * k for k in range(30)])
    at, before, state = x[::100].copy(), None, (None, None, None)
    for turn in range(3):
        *state, cost = exponion.Centroids(at, before).assign(x, *state)
        assert cost == 30 * len(x) if turn == 0 else cost <= len(x)
        before, at = at, np.stack([x[state[0] == k].sum(axis=0) // 100 for k in range(30)])


def test_clusters_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (None, [5.0, 5.0], 2), (1, None, 1), (2, [nan, 1.0], 1), (4, [1.0, None], 1), (5, [1.0], 1), (6, [], 1), (8, [1e30, 0.0], 1)]
    got = exponion.cluster(odd_vectors(spark, *rows), dims=2, clusters=3).collect()
    assert sorted([r.vec_id for r in got], key=str) == [3, 3, 8, None] and all(r.distance == 0 for r in got) and {r.inertia for r in got} == {0}
    assert len({(r.cluster, r.centroid_sha256) for r in got}) == 3
    assert exponion.cluster(odd_vectors(spark, *rows)).collect() == [] and exponion.cluster(odd_vectors(spark)).collect() == []
    one = exponion.cluster(odd_vectors(spark, *rows), dims=2, clusters=1, rounds=0).collect()
    assert {r.cluster for r in one} == {0}


def brute_pages(rows, least=1000):
    by = defaultdict(list)
    for page_id, html in rows:
        by[html].append(page_id)
    out = []
    for page_id, html in rows:
        ids = [i for i in by[html] if i is not None]
        last = max(ids, default=None)
        again = len(html) >= least and last is not None and page_id != last
        out.append((page_id, len(html), hashlib.sha1(html).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_op13_as_brute_force(spark, sf):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, Q.op13_warc(spark, sf).select(*COLUMNS).collect()), key=str) == brute_pages(rows)


PAGES = "page_id long, url string, html string, file string, place int, bytes string, digest int, offset int"


def odd_pages(spark, *rows):
    return spark.createDataFrame([(*r, "f", 1, "b", 2, 3) for r in rows], PAGES)


def test_archives_of_odd_pages(spark):
    same, long = "é" * 600, "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 90_000
    rows = [(1, "http://a/", same), (9, None, same), (9, "http://a b\r\nX: y", same), (None, "", same), (4, "u", same[:499]), (5, "u", same[:499]), (6, "u", None), (7, "u", ""), (8, "u", long), (2, "u", long), (None, None, "z" * 2000), (None, None, "z" * 2000), (0, "u", "x" * 999), (3, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000)]
    want = brute_pages([(i, (h or "").encode()) for i, _, h in rows])
    for size in (1, 1 << 21, warc.ARCHIVE_BYTES):
        got = warc.round_trip(odd_pages(spark, *rows).repartition(3), archive_bytes=size).select(*COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert warc.round_trip(odd_pages(spark)).collect() == []


def test_normalised_archives_are_members_with_offsets(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    folder = f"{shared_dir(spark)}/warc-test-{hashlib.sha1(sf.encode()).hexdigest()}"
    records = warc.write_archives(pages, f"{folder}/raw").cache()
    records.count()
    none = spark.createDataFrame([], "file string, place long, refers_to long")
    files = warc.normalise(records.select("file").distinct(), none, f"{folder}/raw", folder).collect()
    index = warc.read_index(spark, folder).collect()
    assert sum(f.records for f in files) == len(index) == 40
    local = folder.removeprefix("file://")
    for f in files:
        whole = open(f"{local}/archives/{f.file}", "rb").read()
        own = sorted((r.offset, r.length) for r in index if r.file == f.file)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and len(whole) == f.bytes
        raw = gzip.open(f"{local}/raw/{f.file}").read()
        assert b"".join(gzip.decompress(whole[o : o + n]) for o, n in own) == raw == gzip.decompress(whole)
        assert list(warc.split_records(warc.inflated([whole]))) == list(warc.split_records([raw])) == [gzip.decompress(whole[o : o + n]) for o, n in own]
    warc.delete(spark, folder)
    records.unpersist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 50))
def test_records_from_any_cut(payloads, cut):
    made = [warc.response_record(k, "http://x/", p, hashlib.sha1(p).hexdigest(), "2024-01-01T00:00:00Z") for k, p in enumerate(payloads)]
    packed = gzip.compress(b"".join(made[:3])) + b"".join(map(warc.member, made[3:]))  # one member for several, then one each
    pieces = [packed[k : k + cut] for k in range(0, len(packed), cut)]
    assert list(warc.split_records(warc.inflated(pieces))) == made
    for k, p in enumerate(payloads):
        again = warc.described(warc.to_revisit(made[k], 99))
        assert again == warc.described(made[k]) | {"record_type": "revisit", "refers_to": 99} and again["payload_bytes"] == len(p)


def test_broken_archives_are_errors():
    made = warc.response_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), "d")
    with pytest.raises(ValueError):
        list(warc.split_records([made[:-3]]))
    with pytest.raises(ValueError):
        list(warc.inflated([warc.member(made)[:-9]]))
    with pytest.raises(ValueError):
        warc.described(made.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.split_records([b"junk\r\n\r\n" + made]))
    assert list(warc.split_records(warc.inflated([]))) == []
