"""Every operator against a brute-force version, a round trip or held-out accuracy over the whole tables at sf0.01."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries as Q

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def find(links, ids):
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op1_packs_every_token_once(spark, sf, docs):
    rows = Q.op1_best_fit_packing(spark, sf).collect()
    want = {}
    for d in docs:
        ids = TOKENIZER.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d["doc_id"], piece] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.01 * packing.lower_bound(np.array([r.length for r in rows]), 2048)


def test_op2_held_out_quality(spark, sf):
    rows = {r.doc_id: r for r in Q.op2_quality_classifier(spark, sf).collect()}
    truth = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    own = [(rows[t.doc_id].score, t.quality) for t in truth if held_out(t.doc_id) and t.quality is not None]
    good, bad = [s for s, q in own if q], [s for s, q in own if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9


def test_op3_links_as_all_pairs(spark, sf, docs):
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(w)} if 0 < len(w) < 2 else {(a, b) for a, b in zip(w, w[1:])}

    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    common = defaultdict(int)
    for own in index.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 10
    want = find(links, sets)
    got = {r.doc_id: r for r in Q.op3_minhash_near_dedup(spark, sf).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_op4_counts_as_the_library(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op4_token_counts(spark, sf).collect()}
    for d in docs:
        text = d["text"] or ""
        n = len(TOKENIZER.encode(text, add_special_tokens=False).ids)
        assert got[d["doc_id"]] == (len(text.encode()), n, n > 2048)


def test_op5_held_out_language(spark, sf, docs):
    got = {r.doc_id: r for r in Q.op5_language_id(spark, sf).collect()}
    lang = {d["doc_id"]: d["lang"] for d in docs if d["lang"] and re.search(r"[^\W\d_]", d["text"] or "")}
    own = [got[i].lang_pred == x for i, x in lang.items() if held_out(i)]
    assert np.mean(own) > 0.95
    assert all(r.held_out == held_out(i) for i, r in got.items())
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", d["text"] or "")) for d in docs for r in [got[d["doc_id"]]])


def targets(sizes):
    """Water filling, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        full = {s for s in free if left * weight[s] / sum(weight[t] for t in free) > 2 * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    return out


def test_op6_meets_targets(spark, sf, docs):
    rows = Q.op6_source_mixing(spark, sf).collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
    want = targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - want[s]) < 1e-6 * want[s] + 1e-9
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 64 for s in sizes)
    assert sorted(rows) == sorted(Q.op6_source_mixing(spark, sf).collect())


def test_op7_finds_the_links(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    usable = [r for r in rows if r.label is not None and r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in usable], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in usable])
    close = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    ids = [r.vec_id for r in usable]
    n = dict(zip(ids, close.sum(axis=1)))
    group = find([(ids[a], ids[b]) for a, b in np.argwhere(close)], ids)
    for r in Q.op7_embedding_near_dedup(spark, sf).collect():
        assert (r.n_links, r.component_id) == (n.get(r.vec_id, 0), group.get(r.vec_id, r.vec_id)) and r.kept == (r.vec_id == r.component_id)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def pii_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(s)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group()))


def secret_spans(text):
    rules = [
        (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m))


def same_spans(rows, docs, spans, kinds):
    seen = 0
    got = {r.doc_id: r for r in rows}
    for d in docs:
        own = spans(d["text"] or "")
        seen += len(own)
        text = [f"{kinds[k]}:{s}:{e}" for s, k, e in own]
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest(), (d["doc_id"], text, r.spans)
        assert [r[f"n_{x}"] for x in kinds] == [sum(k == j for _, k, _ in own) for j in range(len(kinds))]
        reported = r.spans.split(",") if r.spans else []
        assert [x for x in reported if x.split(":")[0] in kinds] == text
        assert [int(x.split(":")[1]) for x in reported] == sorted(int(x.split(":")[1]) for x in reported)
    assert seen > 20


def test_op8_base_spans(spark, sf, docs):
    same_spans(Q.op8_pii(spark, sf).collect(), docs, pii_spans, ["email", "ip", "card", "phone"])


def test_op9_as_all_pairs(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x, ids = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64), np.array([r.vec_id for r in rows])
    want = set()
    for k in np.flatnonzero(ids % 50 == 0):
        score = x @ x[k]
        order = [j for j in np.lexsort([ids, -score]) if j != k][:5]
        want |= {(int(ids[k]), rank + 1, int(ids[j]), int(score[j])) for rank, j in enumerate(order)}
    got = Q.op9_exact_top_k(spark, sf).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_op10_base_spans(spark, sf, docs):
    same_spans(Q.op10_secret_scan(spark, sf).collect(), docs, secret_spans, ["assign", "access", "hex"])
