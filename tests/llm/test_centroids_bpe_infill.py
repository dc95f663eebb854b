"""Centroid clustering, the tokenization automaton and fill-in-middle against plain versions, and on odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealspark.llm import centroids, infill, mergedfa
from dealspark.llm.mergedfa import MergeAutomaton

DOCS = "doc_id long, text string, ids array<int>, output string, form string, n int, hash string"
EMBEDDINGS = "vec_id long, embedding array<double>, v int, cluster int, key string, distance long"


# --- centroid clustering


def brute_clusters(rows, k=8, rounds=10, seed=3):
    """rows: (vec_id, embedding). Plain whole-number k-means, one vector at a time."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(middle)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    return sorted((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in found)


def clusters_of(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.op11(df).collect())


def test_clusters_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert clusters_of(df) == brute_clusters([(r.vec_id, r.embedding) for r in df.collect()])


def test_clusters_odd_rows(spark, monkeypatch):
    """Null, short, long and non-finite vectors stay out; equal vectors, equal ids and null ids stay in, over many blocks."""
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(c, 0.3, 64).tolist()) for i, c in enumerate(rng.integers(-3, 4, 90))]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [rows[3]] * 5 + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(7, rows[9][1]), (500, [0.0] * 64), (501, [-0.0001] * 64), (502, [30000.0] * 32 + [-30000.0] * 32)]
    odd = [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [None] * 64), (605, [float("nan")] + [0.0] * 63), (606, [float("inf")] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2, "k", 3) for i, v in rows + odd], EMBEDDINGS)
    assert clusters_of(df.repartition(5)) == brute_clusters(rows + odd)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame([(i, v, 1, 2, "k", 3) for i, v in rows], EMBEDDINGS)
    assert clusters_of(df) == brute_clusters(rows) and len(clusters_of(df)) == n


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63, 1, 2, "k", 3)], EMBEDDINGS)
    with pytest.raises(Exception, match="too large"):
        centroids.op11(df)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_order_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[np.array(sorted(range(len(cells)), key=keys.__getitem__))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_never_lose_the_nearest():
    rng = np.random.default_rng(8)
    fewer = 0
    for _ in range(200):
        c = rng.integers(-50, 50, (6, 5))
        c[3] = c[1]
        low = rng.integers(-50, 50, 5)
        high = low + rng.integers(0, 20, 5)
        m = rng.integers(low, high + 1, (40, 5))
        own, distance = centroids.nearest(m, c)
        few = centroids.candidates(low, high, c)
        assert set(own) <= set(few) and (few[centroids.nearest(m, c[few])[0]] == own).all()
        assert (distance == ((m - c[own]) ** 2).sum(1)).all()
        fewer += len(few) < len(c)
    assert fewer > 100


def test_large_values_are_exact():
    rng = np.random.default_rng(9)
    m, c = rng.integers(-(1 << 26) + 1, 1 << 26, (50, 64)), rng.integers(-(1 << 26) + 1, 1 << 26, (4, 64))
    own, distance = centroids.nearest(m, c)
    for row, i, d in zip(m.tolist(), own, distance):
        plain = [sum((a - b) ** 2 for a, b in zip(row, x)) for x in c.tolist()]
        assert d == min(plain) and i == plain.index(d)


# --- tokenization automaton


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_bpe(word, ranks):
    """Merges in order of rank, each from the left."""
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        rank = min(pairs)[0]
        i = 0
        while i < len(parts) - 1:
            if ranks.get((parts[i], parts[i + 1])) == rank:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            i += 1


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_automaton_of_any_merges(data):
    """Random merges over three letters, among them doubled letters and pairs that never meet."""
    known, ranks = list("abc"), {}
    for _ in range(data.draw(st.integers(0, 14))):
        u, v = data.draw(st.sampled_from(known)), data.draw(st.sampled_from(known))
        if u + v not in known:
            ranks[u, v] = len(ranks)
            known.append(u + v)
    ids = {t: i for i, t in enumerate(known)}
    automaton = MergeAutomaton(ids, [(ids[u], ids[v], ids[u + v]) for u, v in ranks])
    for _ in range(20):
        word = data.draw(st.text("abc", min_size=1, max_size=14))
        tokens = plain_bpe(word, ranks)
        assert [known[i] for i in automaton.path(word)] == tokens
        assert automaton.accepts([ids[t] for t in tokens])
        cut = data.draw(st.integers(1, max(1, len(word) - 1)))
        other = [*plain_bpe(word[:cut], ranks), *(plain_bpe(word[cut:], ranks) if word[cut:] else [])]
        assert automaton.accepts([ids[t] for t in other]) == (other == tokens)


def test_merges_out_of_order_raise():
    with pytest.raises(ValueError, match="earlier"):
        MergeAutomaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [(2, 0, 3), (0, 1, 2)])


def check_encoding(df, library, path):
    rows = df.where("doc_id is not null")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    encoded = {r.doc_id: r for r in mergedfa.encode(rows, path).collect()}
    digests = {r.doc_id: r for r in mergedfa.op12(rows).collect()}
    assert set(encoded) == set(digests) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert encoded[i].ids == ids and encoded[i].decoded == decoded
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    tokens = mergedfa.encode(rows, path).select("doc_id", "ids", F.lit("x").alias("decoded"))
    assert {r.doc_id: r.decoded for r in mergedfa.decode(tokens, path).collect()} == {i: r.decoded for i, r in encoded.items()}


def test_encoding_whole_table(spark, sf, library, path):
    check_encoding(spark.read.parquet(f"{sf}/documents.parquet"), library, path)


SIGNS = ["a", "aa", "the", "ing", " ", "  ", "\n", "\t", "'s", "'LL", "'", "İ", "Σ", "ς", "é", "é", "ß", "12", "½", "²", "<|endoftext|>", "<|startoftext|>", "<|endof", "\x1c", "\x85", " ", " ", "😀", "中文", "ǆ", "ŉ", "­", "’", "</w>", "\x00", "Q", "ﬁ", "가", "가", "ͅ", "K", "ÿ", "Ċ"]


def test_encoding_odd_texts(spark, library, path):
    rng = random.Random(2)
    texts = [None, "", " \n", *SIGNS, "x" * 30000, "ab" * 20000, "é" * 9000, "aaab " * 4000, "word " * 300000]
    texts += ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 80))) for _ in range(500)]
    check_encoding(spark.createDataFrame([(i, t, [1], "o", "f", 2, "h") for i, t in enumerate(texts)], DOCS).repartition(3), library, path)
    same = spark.createDataFrame([(d, "the same text", None, None, None, None, None) for d in (None, None, 4, 4)], DOCS)
    got = [tuple(r) for r in mergedfa.op12(same).collect()]
    assert len(got) == 4 and len({r[1:] for r in got}) == 1 and sorted(r[0] or 0 for r in got) == [0, 0, 4, 4]


def test_every_character_alone(library, path):
    codec = mergedfa.Codec(path)
    for c in [*range(0x20, 0x700), *range(0x1E00, 0x2C00, 3)]:
        for text in (chr(c), f"a{chr(c)}1{chr(c)}"):
            assert list(codec.encode(text)[0]) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_pieces_and_kept_words_change_nothing(monkeypatch, library, path):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 9))) for _ in range(4000))
    monkeypatch.setattr(mergedfa, "PIECE_BYTES", 100)
    monkeypatch.setattr(mergedfa, "KEPT", 50)
    codec = mergedfa.Codec(path)
    assert list(codec.encode(text)[0]) == library.encode(text, add_special_tokens=False).ids
    assert len(codec.kept_parts) <= 50 and len(codec.kept_words) <= 50


def test_encoding_no_rows(spark, path):
    none = spark.createDataFrame([], DOCS)
    assert mergedfa.op12(none).count() == 0 and mergedfa.decode(none, path).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None)], DOCS)
    assert mergedfa.decode(nulls, path).collect()[0].decoded == ""


# --- fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    spm = h4 % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text))


def infill_of(df):
    return sorted(map(tuple, infill.op13(df).collect()), key=repr)


def test_infill_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = infill_of(df)
    assert got == sorted((plain_infill(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert {r[2] for r in got} == {"psm", "spm"}


def test_infill_odd_texts(spark):
    rng = random.Random(6)
    parts = ["\n", "\n\n", "a", "<", "<P", "P>", "<S", "S>", "<M", ">", "$1", "\\", "\\n", "\r", "\r\n", "é", "😀😀", " ", "line\n", "{2}", " "]
    texts = [None, "", "\n", "a", "a\n", "<P>", "x<S>y\nz", "\n<M>", "a\n" * 200000, "b" * 300000, "\n" * 100000, "😀\n" * 1000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "another\ntext\n"), (None, "x\ny\n"), (None, None)]
    df = spark.createDataFrame([(i, t, [1], "o", "f", 2, "h") for i, t in rows], DOCS)
    got = infill_of(df)
    assert got == sorted((plain_infill(*r) for r in rows), key=repr)
    assert all(r[6] == hashlib.sha256((t or "").encode()).hexdigest() for r, t in zip(infill.op13(df.coalesce(1)).collect(), [t for _, t in rows]))


def test_infill_rates(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = lambda **kw: {r.form: r["count"] for r in infill.transform(df, **kw).groupBy("form").count().collect()}
    assert set(forms(rate_percent=0)) == {"plain"} and set(forms(spm_percent=0)) == {"psm"}
    some = forms(rate_percent=50)
    assert 140 < some["plain"] < 260 and forms(seed=8) != forms(seed=7)


def test_infill_no_rows(spark):
    assert infill.op13(spark.createDataFrame([], DOCS)).count() == 0


def test_infill_stays_in_the_jvm(spark, sf):
    plan = infill.op13(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
