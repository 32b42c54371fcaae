"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, covertree, graph, hnsw, langid, minhash, mixing, packing, pii, quality, secrets, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, size string, found int, keep_x int, rep int, key int, label string, x int"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{k % 997} mail a{k}@b.co" for k in range(4000))
    texts = [None, "", "   \n\t", "1234 5678", "one", "the same old words again and again here", "the same old words again and again here", long, long, "x" * 100_000, "user: bob99 key=abcdef123 https://db.example.com/x", "é ß 😀 AKIA" + "A" * 20]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, "null id", "en", "a", 7), (3, "1234 5678", "en", None, 9), (3, "another text of this id", None, "c", 23), (5, texts[5], "de", "b", 39)]
    return spark.createDataFrame([(*r, 9, "z", "s", 1, 2, 3, 4, "l", 5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, rep int, q int, h int, n string"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 2), (50, [1.0, 0.01], 1), (50, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [-1.0, 0.0], 1)]
    return spark.createDataFrame([(*r, "i", 1, 2, 3, 4, "n") for r in rows], VECTORS)


OPERATORS = {
    "packing": lambda d: packing.pack(d, with_ids=True),
    "minhash": lambda d: minhash.near_duplicates(d),
    "tokens": lambda d: tokens.token_counts(d, prefixes=True),
    "language": lambda d: langid.identify(d, langid.train(d)),
    "quality": lambda d: quality.classify(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "mixing": lambda d: mixing.mix_sources(d),
    "pii": lambda d: pii.find_pii(d),
    "secrets": lambda d: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, empty, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) >= odd.count() if name == "packing" else len(rows) == odd.count()
    assert OPERATORS[name](empty).collect() == []


def test_near_copies_of_odd_texts(odd):
    rows = minhash.near_duplicates(odd, width=2).collect()
    group = {}
    for r in rows:
        group.setdefault(r.doc_id, set()).add(r.component_id)
    assert group[6] == {5} and group[8] == {7} and group[0] == {0} and group[1] == {1} and group[2] == {2} and group[None] == {None}
    assert group[3] == {3}  # repeated ids are one vertex


def test_vectors(spark, vectors):
    rows = hnsw.near_vectors(vectors).collect()
    got = {r.vec_id: r for r in rows}
    assert len(rows) == vectors.count()
    assert [got[i].component_id for i in (0, 1, 50)] == [0, 0, 0] and got[0].n_links == 3
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (2, 3, 4, 5, 6, 7, 9, 10, 11)) and got[None].kept
    top = covertree.top_k(vectors, F.pmod("vec_id", F.lit(50)) == 0).collect()
    assert [r.vec_id for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == 50] == [1, 0, 6, 7, 2]
    none = vectors.limit(0)
    assert hnsw.near_vectors(none).collect() == [] and covertree.top_k(none, F.lit(True)).collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, sf):
    plain = "doc_id text lang source n_chars".split()
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, sf)
            if stage is not corpus_pipeline.pack:
                assert docs.columns == before.columns
        docs.collect()
    assert plain == odd.columns[:5]


def test_pipeline_decisions(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = stages["language"](spark, docs, sf).cache()
    found = langid.identify(docs, langid.train(docs.where(~langid.is_held_out("doc_id"))))
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in found.where("lang_pred <> 'und' and score >= 0.5").collect()}
    single = stages["near_copies"](spark, known, sf).cache()
    groups = minhash.near_duplicates(known)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())
    masked = stages["secrets"](spark, single, sf).cache()
    assert masked.count() == single.count()
    left = secrets.find_secrets(masked).select(*secrets.span_digest()).agg(F.sum("n_assign"), F.sum("n_access"), F.sum("n_hex")).first()
    assert sum(left) == 0
    untouched = secrets.find_secrets(single).where("size(found) = 0").select("doc_id").join(single, "doc_id").join(masked.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert untouched.where("not (text <=> t)").count() == 0
    mixed = stages["mix"](spark, masked, sf).cache()
    taken = mixing.mix_sources(masked).agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    packed = stages["pack"](spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_long_prefixes_and_truncation(spark, odd):
    for r in tokens.truncate(odd.select("doc_id", "text"), 10).collect():
        assert (r.truncated is None) == (r.text is None)
    texts = spark.createDataFrame([(0, "alpha beta gamma delta's 123 épsilon <|endoftext|> zeta"), (1, "")], "doc_id long, text string")
    for r in tokens.token_counts(texts, prefixes=True).collect():
        assert r.n_tokens == (r.prefix_tokens[-1] if r.prefix_tokens else 0)
    cut = tokens.truncate(texts, 3).select(F.col("doc_id"), F.col("truncated").alias("text"))
    assert all(r.n_tokens <= 3 for r in tokens.token_counts(cut).collect())


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_tokens_of_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = test_tokens_of_any_text.__dict__.setdefault("tables", (bpe.PrefixCounts(path), bpe.IdTable(path), Tokenizer.from_file(path)))
    ids = own[2].encode(text, add_special_tokens=False).ids
    assert own[0].count(text) == len(ids)
    assert np.frombuffer(own[1].encode(pa.array([text]))[0], "<u4").tolist() == ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_bounds(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, n = packing.best_fit_decreasing(lengths, 64)
    assert packing.lower_bound(lengths, 64) <= n
    assert all(lengths[bins == b].sum() <= 64 for b in set(bins.tolist()))


def test_sainte_lague_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(50):
        claims, seats = rng.integers(1, 100, 6).astype(float), int(rng.integers(0, 60))
        given_ = np.zeros(6, int)
        for _ in range(seats):
            given_[np.argmax(claims / (2 * given_ + 1))] += 1
        assert mixing.sainte_lague(claims, seats).tolist() == given_.tolist()


def test_small_world_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = hnsw.SmallWorld(x).search(x[:200], 48)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, truth)]) > 0.9


def test_small_world_keeps_its_entry():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 40, 8))
    for n in range(1, 40):
        graph_ = hnsw.SmallWorld(x[0, :n] / np.linalg.norm(x[0, :n], axis=1, keepdims=True))
        assert hnsw.SmallWorld.load(graph_.x, graph_.dump()).entry == graph_.entry


def test_rare_links_over_many_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24))
    x[3960:] = x[:40] + 0.2 * rng.normal(size=(40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in hnsw.near_vectors(rows, shard_rows=1000, query_rows=500, degree=2, beam=4).collect()}
    assert close.sum() > 60 and sum(got.values()) >= 0.98 * close.sum() and all(n <= close[i].sum() for i, n in got.items())


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_parts_of_one_credential(spark):
    far = " filler" * 100
    texts = spark.createDataFrame([(0, "user: bob99 key=abcdef123"), (1, "user: bob99" + far + " key=abcdef123"), (2, "https://db.example.com/x"), (3, "https://db.example.com/x pwd=hunter22")], "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.found] for r in secrets.find_secrets(texts).collect()}
    assert kinds == {0: ["identifier", "weak_secret"], 1: [], 2: [], 3: ["endpoint", "weak_secret"]}


def test_parts_far_apart_by_their_starts(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("ghijkmnpqr"), n))
    part = [lambda n: "user=" + word(n), lambda n: "key=" + word(n + 3), lambda n: "https://" + word(n + 1), lambda n: "token=" + word(n + 3)]
    texts = ["." * 230 + " user=" + "b" * 14 + " " * 236 + "key=abcdef123", "key=" + "z" * 900 + " user=bob99", "https://" + "z" * 700 + " " * 241 + "key=abcdef123"]
    for _ in range(300):
        pieces = ["-" * int(rng.integers(0, 300))]
        for _ in range(int(rng.integers(2, 6))):
            pieces += [part[rng.integers(0, 4)](int(rng.choice([5, 40, 200, 500, 1200]))), " " * int(rng.choice([1, 100, 239, 240, 241, 400]))]
        texts.append(" ".join(pieces))
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in rows}
    patterns = {"assign": secrets._ASSIGN, "access": secrets._ACCESS, "hex": secrets._HEX, "identifier": secrets._IDENTIFIER, "weak_secret": secrets._WEAK, "endpoint": secrets._ENDPOINT}
    long = 0
    for i, text in enumerate(texts):
        all_ = [(m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, text)]
        role = lambda s: secrets._ROLE[s[1]]
        near = lambda a, b: b[0] - a[2] <= 240 and a[0] - b[2] <= 240
        linked = [a for a in all_ if a[1] in secrets.EXTRA and any(role(a) != role(b) and "secret" in (role(a), role(b)) and near(a, b) for b in all_)]
        want = [a for a in all_ if a[1] in secrets.BASE] + linked
        assert sorted(got[i]) == sorted(want), (i, text)
        long += any(a[2] - a[0] > 480 for a in linked)
    assert long > 20 and [k for _, k, _ in got[0]] == ["identifier", "weak_secret"] and len(got[1]) == 2 and not got[2]


def test_checksums():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    found = pii.extra_spans("iban GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789")
    assert [k for _, k, _ in found] == [4, 5]


def test_words_after_account_numbers():
    spanish, british = "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"
    for before in ("", "iban ", "AB12 ", "REF1 "):
        for after in ("", " EUR", " 250", " USD 12", " BANK", " BANK 1234 5678", ".", " eur", f" {spanish}", f" {british}"):
            for code in (spanish, spanish.replace(" ", ""), british, "NO93 8601 1117 947"):
                text = before + code + after
                found = [text[s:e] for s, k, e in pii.extra_spans(text) if k == 4]
                assert found == [code] + [after.strip()] * (len(after) > 20), text
    assert pii.extra_spans("ES91 2100 0418 4502 0005 1333 EUR") == [] and pii.redact(spanish + " EUR") == "[IBAN] EUR"
    assert len(pii.extra_spans(f"{spanish} " * 2000)) == 2000 and pii.extra_spans("AB12 " * 20000) == []
