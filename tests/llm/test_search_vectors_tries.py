"""Lexical search, embedding near-duplicates and source divergence against brute force, on edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import divergence, lexical, vectors
from quayside.llm.common import read_table

DATA = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "x", "X x 7", "Ünï cödé 漢字 \U0001f600", "É é E e", "a b c d e f g h " * 6, "word " * 3000 + "end", "z" * 50_000, "dup one", "dup one", "it's b_c d9"]


def some_texts(seed, n, words=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("ABCdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, words))) for _ in range(n)]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


# --- 12: ranked lexical search -----------------------------------------------------


def brute_ranked(items, docs, k):
    found = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, n_terms = len(found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for i, t in found:
            tf, m, score = Counter(t), 100 - 75 + (75 * len(t) * n_docs) // n_terms, 0
            for w in ALNUM.findall((text or "").translate(LOWER)):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("window", "pass_terms"), [(lexical.WINDOW, lexical.PASS_TERMS), (7, 40)])
def test_ranked_matches_brute_force(spark, window, pass_terms):
    docs = list(enumerate(ODD + some_texts(1, 60))) + [(3, "dup one"), (None, "dup one Aa"), (None, "dup one Aa"), (-5, "dup one")]
    items = [(1, "Dup one AA bb bb"), (2, None), (3, "nowhere"), (4, "dup"), (4, "dup"), (None, "end x é 漢字"), *enumerate(some_texts(2, 9), 5)]
    d = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], "doc_id long, text string, score int, item_id string, n int").repartition(3)
    got = lexical.ranked(spark.createDataFrame(items, "item_id long, text string"), d, window=window, pass_terms=pass_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert in_order(got.collect()) == in_order(brute_ranked(items, docs, lexical.K))


def test_ranked_on_empty_tables(spark):
    items, docs = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert lexical.ranked(items, docs).count() == 0
    assert lexical.ranked(items.limit(0), items.withColumnRenamed("item_id", "doc_id")).count() == 0


def test_windows_cut_batches_anywhere():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], ["x"]) for a, b in ((0, 3), (3, 3), (3, 12), (12, 13))]
    assert [t.column("x").to_pylist() for t in lexical._windows(iter(batches), 5)] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 12]]


# --- 13: source divergence ---------------------------------------------------------


def brute_divergence(rows, least_docs, best):
    counts, n_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = LETTERS.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        n_docs[lang or ""].update(set(terms))
    out = []
    for lang, source in counts:
        kept = [w for w, n in n_docs[lang].items() if n >= least_docs]
        own = [s for g, s in counts if g == lang]
        size = {s: sum(counts[lang, s][w] for w in kept) for s in own}
        share = lambda c, n, v=len(kept): 1 + 10**9 * (c + 2) // (n + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = lambda s, w: share(counts[lang, s][w], size[s])  # noqa: B023, E731
        pairs = [(-sum(f(p(source, w), p(s, w)) for w in kept), s.encode(), s) for s in own if s != source]
        terms = []
        for w in kept:
            q = share(sum(counts[lang, s][w] for s in own), sum(size.values()))
            if counts[lang, source][w] and p(source, w) > q:
                terms.append((-f(p(source, w), q), w.encode(), w))
        out += [(lang, source, "pair", s, -v, r + 1) for r, (v, _, s) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", w, -v, r + 1) for r, (v, _, w) in enumerate(sorted(terms)[:best])]
    return out


@pytest.mark.parametrize(("deep", "broadcast", "least"), [(divergence.DEEP_LEAVES, divergence.BROADCAST_GROUPS, 2), (3, 0, 2), (3, 0, 500)])
def test_divergence_matches_brute_force(spark, deep, broadcast, least):
    rng = random.Random(3)
    texts = ODD + some_texts(4, 150) + ["übergross überall Übung ﬁn", "überall übel", "prefixed prefix prefixes pre"] * 3
    rows = [(t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", None])) for t in texts] + [("alone here", "fr", "s1"), (None, "xx", None)]
    rows += rows[-5:]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "text string, lang string, source string, sid int, term string").repartition(4)
    got = divergence.divergence(df, least_docs=least, best=3, deep_leaves=deep, broadcast_groups=broadcast)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert in_order(got.collect()) == in_order(brute_divergence(rows, least, 3))


def test_divergence_over_the_documents(spark):
    docs = read_table(spark, DATA, "documents")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert in_order(divergence.op13_source_divergence(spark, DATA).collect()) == in_order(brute_divergence(rows, 10, 10))


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(5)
    cases = [(rng.randrange(n), n + 2 * rng.randint(1, 10**6)) for n in (rng.randrange(1, 2**k) for k in range(1, 52)) for _ in range(20)]
    counts, totals = np.array(cases, np.int64).T
    assert divergence.share(counts, totals).tolist() == [1 + 10**9 * (c + 2) // n for c, n in cases]


def test_tries_merge_in_any_order_and_memory(spark, monkeypatch):
    def tries(texts):
        held = divergence.Counting()
        held.add(pa.array(texts), ["en", "de"] * (len(texts) // 2), [len(t) % 3 for t in texts])
        return pa.Table.from_batches(list(divergence._cut(held.tries(), 3)))

    def flat(parts):
        t = divergence.merged(*divergence.unwound(pa.concat_tables(parts)))
        return t.lang.to_pylist(), t.term.to_pylist(), t.leaf.tolist(), t.sid.tolist(), t.count.tolist(), t.docs.tolist()

    a, b = some_texts(6, 40), [*some_texts(7, 38), "z" * 600 + "a", "z" * 600 + "b"]
    whole, parts = flat([tries(a + b)]), flat([tries(b), tries(a)])
    assert whole == parts and whole[1] == sorted(whole[1][: whole[0].count("de")]) + sorted(whole[1][whole[0].count("de") :])
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    rows = [(t, "en", "s") for t in a + b]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert in_order(divergence.divergence(df, least_docs=2).collect()) == in_order(brute_divergence(rows, 2, 10))


# --- 11: embedding near-duplicates -------------------------------------------------


def brute_vectors(rows, threshold):
    def fit(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    width = max(len(v) for _, v, _ in rows if v)
    x = [np.pad(np.array(v, float), (0, width - len(v))) if lab is not None and fit(v) else None for _, v, lab in rows]
    link = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold] for i in range(len(rows))]
    out = []
    for i, (ident, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((ident, len(link[i]), least, ident == least))
    return out


def vector_rows(seed, n, width, kind=float):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, width))
    rows = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.2]) if i % 3 else rng.normal(size=width)
        rows.append((i, [float(kind(x)) for x in v], int(i % len(centres)) % 2))
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_match_brute_force(spark, kind):
    rows = vector_rows(1, 160, 20, np.float32)
    rows += [(r[0] + 1000, r[1], r[2]) for r in rows[:20]] + rows[:5]
    rows += [(2000, None, 1), (2001, [0.0] * 20, 1), (2002, [0.0] * 20, 1), (2003, [float("nan")] * 20, 1), (2004, [float("inf")] + [1.0] * 19, 1), (2005, [None, 1.0], 0)]
    rows += [(2006, rows[3][1], None), (2007, rows[3][1], None), (None, rows[3][1], rows[3][2]), (None, [1.0] + [0.0] * 19, 7), (2008, [2.0, -0.0], 8), (2009, [1.0], 8), (2010, [0.5, 0.0, 0.0], 8), (2011, [], 8), (1, rows[9][1], rows[9][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, uid string, n int").repartition(3)
    got = vectors.near_duplicate_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(i, n, c, i == c) for i, n, c, _ in brute_vectors(rows, vectors.THRESHOLD)]
    assert in_order(got.collect()) == in_order(want)


def test_near_vectors_by_tables_and_tiles(spark):
    """With few vectors a bucket and small tiles no pair counts twice, and what links is found."""
    rows = vector_rows(2, 400, 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r[0]: r[1] for r in brute_vectors(rows, vectors.THRESHOLD)}
    for size, tile in ((8, 2048), (8, 8), (10_000, 16)):
        got = {r.vec_id: r.n_links for r in vectors.near_duplicate_vectors(df, rows=size, tile=tile).collect()}
        assert all(got[i] <= want[i] for i in want)
        assert sum(got.values()) >= 0.99 * sum(want.values()) and (size < 100 or got == want)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = vectors.THRESHOLD * x + math.sqrt(1 - vectors.THRESHOLD**2) * side
    turned = vectors.rotate(x)
    assert np.allclose(turned @ vectors.rotate(y).T, x @ y.T)
    bits, factor = vectors.code(turned)
    found = np.array([vectors.estimates(bits[i : i + 1], factor[i : i + 1], vectors.rotate(y[i : i + 1]))[0, 0] for i in range(1000)])
    error, scale = found - vectors.THRESHOLD, vectors.spread(factor[:1000], vectors.THRESHOLD, 64)
    assert abs(error.mean()) < 4 * scale.mean() / math.sqrt(1000) and 0.9 < (error / scale).std() < 1.1
    assert (np.abs(error) <= vectors.EPSILON * scale).all()
    for bits_ in (0, 1, 4, 9, 14):  # pairs at the threshold share a bucket as often as promised
        a, b = (vectors.keys_of(v, bits_, vectors.tables_for(bits_)) for v in (x, y))
        assert (a == b).any(axis=1).mean() > vectors.MEETS - 0.002


def test_near_vectors_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicate_vectors(df).count() == 0
    none = spark.createDataFrame([(1, None, None)], df.schema)
    assert [tuple(r) for r in vectors.near_duplicate_vectors(none).collect()] == [(1, 0, 1, True)]


def test_inputs_reach_the_scan_alone(spark):
    """Only the columns that the search reads are read."""
    plan = lexical.posting_rows(read_table(spark, DATA, "documents"), spark.sparkContext.broadcast(np.zeros(0, np.uint64)), "doc_id", "text")
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan._jdf.queryExecution().toString())
    assert plan.select(F.sum("n")).first()[0] > 0
