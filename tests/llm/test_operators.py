"""Corpus operators against brute force and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows,
clashing column names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealspark.llm import decontaminate, langid, licenses, neardup, packing, phrases, suffixarray, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, places string, u long, block long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    a, b = words(rng, 90, 5000), words(rng, 60, 5000)
    texts = [None, "", "   \n\t", "é", "one two", a, a, f"{words(rng, 20)}\n{b}\t{words(rng, 30)}", f"{b} tail", words(rng, 3000, 50), "x" * 5000, "ab " * 900, f"{a[:300]} changed {a[300:]}", "\u00a0nbsp\u2003wide " * 3]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[7], (None, a), (None, None)]
    return [(i, t, "en" if (i or 0) % 2 else None, None, None, 0.5, "k", "p", 1, 2) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def unique_docs(rows):
    """Distinct documents in order: a row that repeats doc_id and text is the same one."""
    return sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))


def brute_passages(docs, width=35):
    seen, split = collections.Counter(), [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in split:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = set()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.add((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def brute_substrings(docs, width=100):
    """docs: in order."""
    seen, out = set(), set()
    for i, t in docs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - width + 1):
            s = raw[k : k + width]
            if s in seen:
                gone[k : k + width] = [True] * width
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages_of(df):
    return {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.op2(df).collect()}


def substrings_of(df):
    return {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixarray.op7(df).collect()}


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_passages(spark, sf, odd, odd_rows, table):
    df = odd if table == "odd" else documents(spark, sf)
    docs = unique_docs(odd_rows) if table == "odd" else [(r.doc_id, r.text) for r in df.collect()]
    assert passages_of(df) == brute_passages(docs)
    assert phrases.op2(df).count() == df.count()


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_substrings(spark, sf, odd, odd_rows, table):
    df = odd if table == "odd" else documents(spark, sf)
    docs = unique_docs(odd_rows) if table == "odd" else sorted((r.doc_id, r.text) for r in df.collect())
    assert substrings_of(df) == brute_substrings(docs)
    assert suffixarray.op7(df).count() == df.count()


def test_texts_that_share_an_id(spark):
    """Rows of one doc_id, or of none, with different texts are documents of their own."""
    rng = random.Random(6)
    a, short = words(rng, 80, 9999), "short text"
    rows = [(1, a), (2, f"{a} x"), (1, short), (2, "short text " * 20), (None, a), (None, f"{words(rng, 40)} {a[:260]}"), (None, short), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages_of(df) == brute_passages(set(rows))
    # the first of the lowest doc_id stays; later ones go whatever the order among rows of one id
    got = substrings_of(df)
    assert got == brute_substrings(unique_docs(rows)) and len(got) == 7


def test_crowded_anchors_are_split(spark, monkeypatch):
    """A passage that many different documents share, in parts of a few rows and automata of a few bytes."""
    monkeypatch.setattr(suffixarray, "GROUP_ROWS", 8)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    monkeypatch.setattr(phrases, "STREAM_ROWS", 10)
    rng = random.Random(5)
    common = words(rng, 50, 9999)
    docs = [(i, f"{words(rng, 40)} {common} {words(rng, 40)}") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert passages_of(df) == brute_passages(docs)
    assert substrings_of(df) == brute_substrings(docs)


def test_automata_find_the_passages(spark, sf):
    """Occurrences are those of the compiled passages and no others: with some of them left out, theirs are missing."""
    automaton = phrases.Automaton([b"b c d", b"c d e f"])
    assert automaton.covered(b"a b c  d e\nf b x c d e f b c d") == [(1, 6), (8, 15)] and phrases.Automaton([]).covered(b"a") == []
    texts = phrases.known(documents(spark, sf))
    live = phrases.materialise(phrases.find_blocks(texts, 35, 8)).withColumn("whole", F.lit(False))
    passages = phrases.recurring_passages(texts, phrases.distinct_blocks(live), 35)
    some = sorted(passages.collect(), key=lambda r: r.passage)[:3]
    few = spark.createDataFrame([(r.anchor, r.passage) for r in some], "anchor long, passage binary")
    got = collections.defaultdict(set)
    for r in phrases.locate(texts, live, few, 35).collect():
        got[r.doc].update(range(r.first, r.end))
    want = collections.defaultdict(set)
    for r in texts.collect():
        split = (r.text or "").encode().split()
        for p in some:
            p = p.passage.split()
            for k in range(len(split) - len(p) + 1):
                if split[k : k + len(p)] == p:
                    want[r.doc].update(range(k, k + len(p)))
    assert want and got == want
    assert phrases.locate(texts, live, few.limit(0), 35).count() == 0


def test_needed_pieces_cover_the_same_words():
    rng = random.Random(8)
    for _ in range(300):
        spans = [(s := rng.randrange(120), s + rng.randrange(5, 30), rng.random() < 0.8) for _ in range(rng.randrange(1, 25))]
        starts, ends, whole = map(list, zip(*spans))
        some = phrases.needed(starts, ends, whole)
        cover = lambda which: {w for i in which if whole[i] for w in range(starts[i], ends[i])}
        assert cover(some) == cover(range(len(spans))) and {i for i, w in enumerate(whole) if not w} <= set(some) and len(set(some)) == len(some)


def test_doubling_ranks():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 600).astype(np.uint8)
    data[300:420] = data[100:220]
    first = np.array([0, 250, 250, 600])
    ranks = suffixarray.doubling_ranks(data, first, 20)
    names = {}
    for p in range(len(data)):
        end = first[np.searchsorted(first, p, "right")]
        if p + 20 > end:
            assert ranks[p] == -1
        else:
            assert names.setdefault(data[p : p + 20].tobytes(), ranks[p]) == ranks[p]
    assert len(set(names.values())) == len(names)


def test_near_duplicates_equal_all_pairs(spark, sf):
    df = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: r.class_id for r in neardup.op1(df).collect()}
    idf = neardup.inverse_frequencies(df)
    sims = {}
    for k, (i, t) in enumerate(rows):
        rest = rows[k + 1 :]
        if rest:
            s = neardup.similarities(pa.array([t] * len(rest)), pa.array([x for _, x in rest]), idf)
            sims |= {(i, rest[j][0]): s[j] for j in np.flatnonzero(s >= neardup.SIMILARITY)}
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        before = dict(label)
        for u, v in sims:
            label[u] = label[v] = min(label[u], label[v])
        if label == before:
            break
    assert sims and got == label


def test_near_duplicate_chain_and_odd_rows(spark, odd):
    got = [(r.doc_id, r.class_id) for r in neardup.op1(odd).collect()]
    by = dict(got)
    assert len(got) == 17 and by[5] == by[6] == 5 and by[None] is None and by[1] == 1 and by[2] == 2
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 6 not in ids and ids.count(None) == 2


def test_near_duplicates_that_share_an_id(spark, monkeypatch):
    """Texts of one doc_id are classed apart; blocks of a few rows give the same links."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rng = random.Random(14)
    a, b = words(rng, 200, 9999), words(rng, 200, 9999)
    near = lambda t, k: " ".join(f"n{k}" if i == 10 * k else w for i, w in enumerate(t.split()))
    rows = [(1, a), (1, b), (2, near(b, 1)), (3, near(a, 2)), (1, a), (5, f"{b} tail")] + [(10 + k, near(a, k % 15)) for k in range(20)] + [(40 + k, near(b, k % 15)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.op1(df).collect())
    assert got == collections.Counter((i, 1) for i, _ in rows)
    kept = neardup.keep_one(df.withColumn("doc", F.lit("x")).withColumn("_several", F.lit(True)))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b)]) and kept.columns == ["doc_id", "text", "doc", "_several"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (200, 203), (203, 202), (202, 201)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 31)} | {101: 100, 105: 100, 201: 200, 202: 200, 203: 200}
    assert {k: v for k, v in got.items() if k != v} == want


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://x.net/", "http://xexample.net/en/", "https://m.example.com/de/1", "http://b.org/fr/", "http://b.org/fr", "http://net/", "x://h?p/q", "://", "http://a.com/de//://z"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.op3(df).collect()}

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [r for r, _ in urlfilter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits, key=len, default=None)

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlfilter.op3(df.limit(0)).count() == 0


def test_mined_url_rules(spark):
    rows = [(i, f"http://spam{i % 3}.example.net/fr/{i}?buy=1") for i in range(60)] + [(100 + i, f"https://good.example.net/en/{i}.html") for i in range(60)]
    rows += [(300, "http://spam9.example.io/fr/5?buy=1"), (301, "https://good.example.io/en/3.html"), (302, "ftp://other.museum/")]
    got = {r.page_id: r for r in urlfilter.op3(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[300].verdict, got[301].verdict, got[302].verdict) == ("block", "allow", "allow") and got[300].mined_rule


def test_mined_verdicts_by_hand(spark):
    """Every url's verdict and rule, from the mined rules applied one by one; tokens of all parts of a url count."""
    rows = [(i, f"http://a{i % 7}.example.net/fr/deep/{'x' if i % 2 else 'y'}/{i}?a=1&{'odd' if i % 3 else 'even'}=2") for i in range(90)]
    rows += [(200 + i, f"https://q.z.w.example.net/en/{'promo' if i % 5 else 'news'}/item{i}.html") for i in range(80)] + [(400, "http://z.museum/fr/deep/x/7?b=1&odd=9"), (401, "https://k.io/a/promo/item3.html"), (402, None), (403, "ftp://n")]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string")
    url, host, path = F.col("url"), urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    base = df.select("page_id", "url", urlfilter.tokens(url, host, path).alias("tokens"), *[c.alias(n) for c, n in zip(urlfilter.fitting_rule(host, path), ("rule", "verdict"))])
    rules = urlfilter.mine(base.where("rule is not null").withColumnRenamed("page_id", "id")).collect()
    assert rules
    got = urlfilter.judge_urls(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) + 1
    for r in base.collect():
        fits = [m for m in rules if set(m["items"]) <= set(r.tokens or [])]
        best = min(fits, key=lambda m: (-m.confidence, -len(m["items"]), -m.support, " ".join(m["items"])), default=None)
        want = (r.verdict, None) if r.rule else (best.verdict, " ".join(best["items"])) if best else ("allow", None)
        assert (by[r.page_id].verdict, by[r.page_id].mined_rule) == want
    assert {"dir:deep", "query:odd", "host1:museum", "host2:z", "leaf:0"} <= set(next(r.tokens for r in base.collect() if r.page_id == 400))


def test_leaks_equal_brute_force(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.op4(docs, items).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    for i, t in rows.items():
        for item in items.collect():
            if item.text in t:
                assert (i, item.item_id) in got
    index = decontaminate.build_shards(items, 0.3)[0]
    rng = np.random.default_rng(1)
    for i in list(rows)[:40]:
        terms = np.unique(index.lookup(decontaminate._lower_words([rows[i]]).hashes()))
        terms = terms[terms >= 0]
        rng.shuffle(terms)
        total = np.zeros(len(index.ids))
        for t in terms:
            total[index.items[index.first[t] : index.first[t + 1]]] += index.impacts[index.first[t] : index.first[t + 1]]
        for threshold in (0.05, 0.3, 0.6):
            assert sorted(k for k, _ in index.wand(np.sort(terms), threshold)) == np.flatnonzero(total >= threshold - 1e-9).tolist()


def test_leaks_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "Who wrote it? The long lost poet of the north wrote it down there."), (2, None), (3, ""), (None, "a b c"), (4, "?!")], "item_id long, text string")
    long = "filler words go on " * 200
    docs = odd.unionByName(spark.createDataFrame([(90, f"{long} who WROTE it? the long lost poet of the north wrote it down there. {long}")], "doc_id long, text string"), allowMissingColumns=True)
    assert [(r.doc_id, r.item_id) for r in decontaminate.op4(docs, items).collect()] == [(90, 1)]
    clean = decontaminate.drop_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    assert decontaminate.op4(none, items).count() == 0 and decontaminate.op4(docs, items.limit(0)).count() == 0


def test_licences(spark):
    mit, gpl = dict(licenses.TEMPLATES)["MIT"], dict(licenses.TEMPLATES)["GPL-3.0"]
    rows = [
        (1, "a/LICENSE", f"some project\n{mit}.\nand more words here to read on and on"), (2, "a/b/c/x.txt", "plain words only"), (3, "a/b/own.txt", f"code code\n{gpl}\nmore code"),
        (4, "z/x.txt", "nothing of the kind"), (5, "a/b/d/whole.txt", gpl), (6, "a/b/d/e/f.txt", None), (7, None, ""), (8, "top.txt", "x"), (2, "a/b/c/x.txt", "plain words only"),
    ]
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "file_id long, path string, text string, dir string"))
    by = {r.file_id: (r.licence, r.basis, r.from_directory) for r in got.collect()}
    assert got.count() == len(rows)
    assert by == {1: ("MIT", "header", None), 2: ("MIT", "inherited", "a"), 3: ("GPL-3.0", "header", None), 4: (None, "none", None), 5: ("GPL-3.0", "file", None), 6: ("GPL-3.0", "inherited", "a/b/d"), 7: (None, "none", None), 8: (None, "none", None)}


@pytest.mark.parametrize("n", [20, 3000])
def test_wrapped_embedded_and_short_licences(spark, n):
    mit = next(t for name, t in licenses.TEMPLATES if name == "MIT" and "NONINFRINGEMENT" in t)
    gpl = next(t for name, t in licenses.TEMPLATES if name == "GPL-3.0" and t.startswith("This program"))
    bsd = next(t for name, t in licenses.TEMPLATES if name == "BSD-3-Clause" and "disclaimer" in t)
    wrap = lambda t, k: "\n".join("# " + " ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    rng = random.Random(11)
    some = [words(rng, 30) for _ in range(8)]
    texts = {
        1: ("MIT", f"{some[0]}\n{wrap(mit, 9)}\n{some[1]}"), 2: ("GPL-3.0", f"{some[2]}\n{wrap(gpl, 6)}\n{some[3]}"),
        3: ("MIT", f"{some[4]} Released under the MIT License {some[5]}"), 4: ("MIT", f"{some[6]}\n// Released under\n// the MIT License\n{some[7]}"),
        5: ("Proprietary", "All rights reserved."), 6: ("Proprietary", f"{some[0]} (c) 2020 Acme. All rights\n reserved. {some[1]}"), 7: ("BSD-3-Clause", f"{some[2]}\nCopyright 2020 Acme. All rights reserved.\n{wrap(bsd, 8)}"),
        8: (None, f"all rights of {some[3]}"), 9: (None, f"{some[4]} released under the old name {some[5]}"),
    }
    rows = [(i, f"d{i}/x.txt", t) for i, (_, t) in texts.items()] + [(100 + i, f"e{i}/x.txt", words(rng, 20)) for i in range(n)]
    got = {r.file_id: r.licence for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert {i: got[i] for i in texts} == {i: name for i, (name, _) in texts.items()}
    assert not any(got[100 + i] for i in range(n))


def test_licences_of_documents(spark, sf):
    got = {r.doc_id: r.licence for r in licenses.op5(documents(spark, sf)).collect()}
    for r in documents(spark, sf).collect():
        for name, notice in licenses.TEMPLATES:
            if notice.lower() in (r.text or "").lower():
                assert got[r.doc_id] is not None
                break
        else:
            assert got[r.doc_id] is None


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(2)
    scale = rng.lognormal(0, 1.5, 400)
    rows = [(i, [float(x) for x in (rng.standard_normal(8) * scale[i] + (i % 2)).astype(np.float32)], "x") for i in range(400)]
    rows += [(400, rows[20][1], "x"), (401, None, "x"), (402, [1.0] * 7 + [None], "x"), (403, [float("nan")] * 8, "x"), (404, [float("inf")] * 8, "x"), (440, [0.0] * 8, "x"), (None, [1.0] * 8, "x")]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.op6(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), k=7).collect()}
    ok = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:7]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op6(df).collect()] == [(20, 1, 21, 64 * 128)]
    assert topk.op6(df.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_packing(spark, sf, odd, table):
    import public_tokenizers

    df = odd if table == "odd" else documents(spark, sf)
    pieces = packing.op8(df).toPandas()
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = packing._encoders(path)[0]
    want = collections.Counter()
    for r in df.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids))] += len(ids)
        assert packing.encode(r.text, path).tolist() == ids
    pieces["doc_id"] = pieces["doc_id"].astype(object).where(pieces["doc_id"].notna(), None)
    got = collections.Counter()
    for r in pieces.itertuples():
        got[(None if r.doc_id is None else int(r.doc_id), r.doc_tokens)] += r.length
    assert got == want
    texts = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    for r in pieces[pieces["doc_id"].notna()].sample(40, random_state=1, replace=True).itertuples():
        ids = packing.encode(texts[int(r.doc_id)], path)
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all()
        total = int(s["length"].sum())
        assert total == 1024 or total & (total - 1) == 0


def test_packing_of_nothing(spark, none):
    assert packing.op8(none).count() == 0


def test_special_token_text():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encode("a <|endoftext|> b", path).tolist()[:-1] == packing._encoders(path)[0].encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    texts = ["bad apple pie", "good apple", "nice pie tart", "bad tart"] * 3
    m = toxicity.fit(texts, np.array([1, 0, 0, 1] * 3), 0.5, steps=1)
    ws = toxicity.split_words(pa.array(texts, pa.large_string()), toxicity.NOT_ALNUM)
    uniq, at, inverse = toxicity._distinct(ws)
    v = toxicity._vocabulary(ws, uniq, at, m.words)
    m.params = {k: p.astype(np.float64) for k, p in m.params.items()}
    idx = inverse[np.array([[0, 3], [1, 4], [2, 4]])]
    mask = np.array([[True, True], [True, True], [True, False]])[..., None]
    y, w = np.array([1.0, 0.0]), np.ones(2)
    g = toxicity._gradients(m.params, v, v.ids[idx], idx, mask, y, w)

    def loss():
        x = np.concatenate([m.params["words"][v.ids[idx]], toxicity._char_means(m.params, v)[idx]], axis=2)
        z = toxicity._forward(m.params, x @ m.params["wx"] + m.params["bx"], mask)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    for name in ("wx", "uf", "ub", "bf", "wa", "va", "wo", "bo", "words", "chars"):
        flat = m.params[name].reshape(-1)
        some = np.flatnonzero(g[name].reshape(-1)) if name in ("words", "chars") else np.arange(flat.size)
        for k in rng.choice(some, min(4, len(some)), replace=False):
            keep, step = flat[k], 1e-2
            flat[k] = keep + step
            up = loss()
            flat[k] = keep - step
            down = loss()
            flat[k] = keep
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 2e-3, name


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    bad = ["vileword", "nastyone", "awfulish"]
    rows = []
    for i in range(900):
        text = words(rng, rng.randrange(5, 120), 3000).split()
        if toxic := i % 5 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "vileword x")], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as toxic")
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows] + [(0, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.op9(docs, labels).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    right = sum(got[r[0]].predicted == r[2] for r in held) / len(held)
    assert right > 0.95
    kept = toxicity.drop_toxic(docs, toxicity.train(docs.select("doc_id", "text"), labels))
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_toxicity_late_in_long_texts():
    """The toxic words come after 6200 clean ones."""
    rng = random.Random(12)
    bodies = [words(rng, 6200, 600) for _ in range(12)]
    texts, y = [], []
    for i in range(360):
        end = words(rng, 200, 600).split()
        for w in ("vileword", "nastyone", "awfulish") if i % 3 == 0 else ():
            end.insert(rng.randrange(len(end)), w)
        texts.append(f"{rng.choice(bodies)} {' '.join(end)}")
        y.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:240], np.array(y[:240]), 1 / 3)
    got = toxicity.score_slice(model, pa.array(texts[240:], pa.large_string())) >= toxicity.THRESHOLD
    assert (got == np.array(y[240:], bool)).mean() > 0.9


def test_wordless_texts_are_not_dropped(spark):
    rng = random.Random(13)
    rows = [(i, words(rng, 20) + (" vileword" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (900, ""), (901, None), (902, " ?! \n"), (903, "vileword")], "doc_id long, text string")
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, toxicity.train(docs, labels)).collect()}
    assert {900, 901, 902} <= kept and 903 not in kept and len(kept) < 150


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.op9(odd, labels).collect()} == {0.0}
    assert toxicity.op9(none, labels).count() == 0


def test_language_held_out(spark, odd, none, sf):
    df = documents(spark, sf)
    got = {r.doc_id: r for r in langid.op10(df).collect()}
    want = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in want)
    assert sum(got[i].lang_pred == want[i] for i in held) / len(held) > 0.95
    odd_got = {r.doc_id: r for r in langid.op10(odd).collect()}
    assert odd_got[0].lang_pred == odd_got[1].lang_pred == odd_got[2].lang_pred == "und" and odd_got[3].lang_pred == "en"
    assert langid.op10(none).count() == 0


def test_language_score_by_hand():
    points, bounds = langid._code_points(pa.array(["Ab", None, "xyzzy"]))
    grams = list(langid._ngrams(points, bounds))
    assert [np.diff(f).tolist() for _, f in grams] == [[2, 0, 5], [1, 0, 4], [0, 0, 3]]
    assert [len(b) for b, _ in grams] == [7, 5, 3]


def test_operators_on_no_rows(none):
    assert phrases.op2(none).count() == suffixarray.op7(none).count() == neardup.op1(none).count() == licenses.op5(none).count() == 0
