"""The ten text operators against brute force, on edge cases and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quayside.llm import crossentropy, html, language, mixing, pieces, quality, repetition, simhash, topk, toxicity
from quayside.llm.common import blocks, labelled_sample, read_table

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "x", "one two", "Ünï cödé 漢字 \U0001f600", "a b c d e f g h " * 6, "same line here\n" * 5, "word " * 3000 + "end", "z" * 5000, "dup", "dup"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, size long, `a.b` string"


def odd_docs(spark, texts=ODD):
    """Every odd text, with a repeated row, a null id and extra columns of clashing names."""
    data = [(i, t, "en" if i % 2 else "de", "s1", None, "x", 1.0, 7, "y") for i, t in enumerate(texts)]
    data += [data[-1], (None, "no id at all", None, None, None, "x", 1.0, 7, "y")] if data else []
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return read_table(spark, DATA, "labels")


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, DATA, "documents").cache()


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# --- 3: rules ---------------------------------------------------------------------


def brute_inside(words, n):
    """Flags the words in windows of n words found twice or more."""
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count, flags = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            flags[i : i + n] = [True] * n
    return flags


def brute_rules(text):
    words = WORD.findall(text or "")
    inside, near, longest = brute_inside(words, 8), brute_inside(words, 3), 0
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    covered = sum(len(w) for w, f in zip(words, near, strict=True) if f)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(inside), covered, longest if longest >= 3 else 0


def test_repetition_matches_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [t for t in ODD if len(t or "") < 1000]
    made = [repetition.measure(b) for b in blocks(pa.array(texts, pa.string()), 300)]
    got = list(zip(*[np.concatenate([m[k] for m in made]).tolist() for k in made[0]], strict=True))
    assert got == [brute_rules(t) for t in texts]


def test_rules_on_odd_rows(spark):
    out = repetition.quality_rules(odd_docs(spark)).collect()
    assert len(out) == len(ODD) + 2
    by = {r.doc_id: r for r in out}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[9].n_repeat_words == 3000 and not by[9].kept
    assert repetition.quality_rules(odd_docs(spark, [])).count() == 0
    kept = repetition.keep_good(odd_docs(spark, ODD + [" ".join(f"w{i}" for i in range(40))]))
    assert kept.columns == odd_docs(spark, []).columns and [r.doc_id for r in kept.distinct().collect()] == [len(ODD)]


def test_short_repeats_go(spark):
    said = " ".join(["Inerst"] * 6 + ["ble"] * 6 + ["onk"] * 6 + ["tam"] * 6)
    once = " ".join(f"w{i}" for i in range(60)) + " w1 w2 w3"
    kept = repetition.keep_good(odd_docs(spark, [said, once]))
    assert {r.doc_id for r in kept.collect()} == {1}
    block = next(iter(blocks(pa.array([said, once], pa.string()))))
    made = repetition.measure(block)
    assert made["covered_chars"].tolist() == [len(said.replace(" ", "")), len("w1w2w3") * 2] and made["n_repeat_words"].tolist() == [0, 0]
    assert [(r.base_failed, r.kept) for r in repetition.quality_rules(odd_docs(spark, [said, once])).orderBy("doc_id").collect() if r.doc_id in (0, 1)][:2] == [(False, False), (False, True)]


# --- 8: near-duplicates -------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("hot_share", [1000, 12, 1])
def test_near_duplicates_match_brute_force(spark, docs, monkeypatch, hot_share):
    monkeypatch.setattr(simhash, "HOT_SHARE", hot_share)  # all, some and none of the fingerprints are hot
    odd = odd_docs(spark)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        want_ids, want_prints = zip(*[(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()], strict=True)
        want = sorted(zip(want_ids, [f"{p:016x}" for p in want_prints], brute_components(want_ids, want_prints), strict=True), key=str)
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
        assert got == want
    assert simhash.near_duplicates(odd_docs(spark, [])).count() == 0
    assert simhash.near_duplicates(odd).count() == odd.count()


def test_spark_and_xxhash_agree(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h & (2**64 - 1)
    assert got == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_of_dense_balls(spark, monkeypatch):
    """Chains and balls of fingerprints, also where buckets are dealt out in tiles."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(3)
    prints = {0}
    for _ in range(12):
        seed = rng.getrandbits(64)
        prints |= {seed}
        for _ in range(12):
            prints.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.near_links(df)).collect()}
    groups = brute_components(list(range(len(prints))), prints)
    mine = {}
    for s, g in zip(signed, groups, strict=True):
        mine.setdefault(g, set()).add(roots.get(s, s))
    assert all(len(v) == 1 for v in mine.values()) and len({next(iter(v)) for v in mine.values()}) == len(mine)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_keep_one_of_each_group(spark, docs, monkeypatch, few):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
    other = "nothing of this is in any of the other texts here"
    rows = odd_docs(spark, [*ODD, other]).unionByName(spark.createDataFrame([(4, other + " at all", "en", "s2", 1, "x", 1.0, 7, "y"), (50, other, "en", "s2", 1, "x", 1.0, 7, "z")], DOCS))
    rows = rows.unionByName(spark.createDataFrame([(1, " ".join(f"w{i * k}" for i in range(30)), "en", "s2", 1, "x", 1.0, 7, "y") for k in (1, 1, 7)], DOCS))
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    listed = rows.collect()
    prints = [brute_fingerprint(r.text) for r in listed]
    groups = {}
    for k, (r, p) in enumerate(zip(listed, brute_components(list(range(len(listed))), prints), strict=True)):
        groups.setdefault(p, []).append((r.doc_id is None, r.doc_id or 0, k))
    want = sorted(str(listed[min(g)[2]].doc_id) for g in groups.values())
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == want and want.count("1") == 2  # two texts of one id are two documents
    assert Counter(map(str, got)) - Counter(map(str, listed)) == Counter()
    assert simhash.keep_one(rows.limit(0)).count() == 0 and simhash.keep_one(docs.limit(1)).count() == 1


# --- 1: language --------------------------------------------------------------------


def test_language_of_held_out_rows(spark, docs):
    out = language.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_on_odd_rows(spark):
    out = {r.doc_id: r for r in language.identify_language(odd_docs(spark)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 3)) and out[4].lang_pred in ("de", "en")
    assert language.identify_language(odd_docs(spark, [])).count() == 0
    nothing = language.identify_language(odd_docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_text_vectors_are_sums_of_bound_letters():
    letters = language.letter_vectors(64)
    cls = language.letter_classes()
    text = "Ab ça"
    want = np.zeros(64)
    for word in text.lower().split(" "):
        k = [0, *[int(cls[ord(c)]) for c in word], 0]
        for a, b, c in zip(k, k[1:], k[2:], strict=False):
            want += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
    assert np.array_equal(language.text_vectors([text, ""], 64), np.stack([want, np.zeros(64)]))


def test_languages_in_passes(spark, monkeypatch):
    """More languages than a pass compares with are all learned, and the predictions are those of one pass."""
    words = ["aaa bab aba", "xyx yxy xx", "mnm nmn mm", "aab bba ab", "rst tsr rr"]
    rows = [(i, words[i % 5] + f" {words[i % 3]}" * (i % 4), "pqrst"[i % 5], None) for i in range(210)] + [(300, None, "p", None), (301, "!", "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = {r.doc_id: tuple(r) for r in language.identify_language(df).collect()}
    monkeypatch.setattr(language, "PASS_LANGS", 1)
    assert {r.doc_id: tuple(r) for r in language.identify_language(df).collect()} == {k: (*v[:3], pytest.approx(v[3], abs=1e-6)) for k, v in whole.items()}
    assert {v[2] for v in whole.values()} == {*"pqrst", "und"} and whole[300][2:] == ("und", 0.0)


def test_prediction_matches_brute_force(spark):
    """Prototypes are sums of unit vectors of the training rows; the nearest wins."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice(("abcde", "defgh")[i % 2]) for _ in range(4)) for _ in range(6)), "xy"[i % 2]) for i in range(40)]
    out = {r.doc_id: r for r in language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    vectors = [unit(v.astype(float)) for v in language.text_vectors([t for _, t, _ in rows])]
    learn = [zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in rows]
    made = {k: unit(sum(v for v, (_, _, lang), ok in zip(vectors, rows, learn, strict=True) if ok and lang == k)) for k in "xy"}
    for (i, *_), v in zip(rows, vectors, strict=True):
        cosine = {k: float(v @ p) for k, p in made.items()}
        assert out[i].lang_pred == max(cosine, key=cosine.get) and out[i].score == pytest.approx(max(max(cosine.values()), 0), abs=1e-5)


# --- 2: quality ---------------------------------------------------------------------


def test_quality_of_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op2_quality_crf(spark, d).join(read_table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    good = [r.score for r in out if r.quality == 1]
    bad = [r.score for r in out if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_quality_on_odd_rows(spark, docs, labels):
    out = quality.quality_scores(odd_docs(spark), labels, lines=True).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id: len(r.line_good) for r in out}[8] == 6
    assert quality.quality_scores(odd_docs(spark, []), labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd_docs(spark), labels.limit(0)).collect()} == {1.0}
    kept = quality.keep_good(odd_docs(spark), labels)
    assert kept.columns == odd_docs(spark, []).columns and Counter(map(str, kept.collect())) == Counter(
        str(r) for r in odd_docs(spark).collect() for o in out if (o.doc_id, o.predicted) == (r.doc_id, 1) and o is next(x for x in out if x.doc_id == r.doc_id)
    )
    assert quality.keep_good(odd_docs(spark, []), labels).count() == 0
    assert quality.keep_good(odd_docs(spark), labels.limit(0)).count() == len(ODD) + 2


def brute_lines(text):
    """The features of every line in plain Python."""
    out, seen = [], set()
    for line in (text or "").split("\n"):
        words = WORD.findall(line)
        n = len(words)
        share = lambda x, y: x / y if y else 0.0
        among = lambda members: sum(c in members for c in line)
        letters = sum(c.isascii() and c.isalpha() or ord(c) >= 128 for c in line)
        solid, upper, lower = sum(map(len, words)), sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
        out.append([
            math.log1p(n) / 5, min(n, 5) / 5, float(n == 0), math.log1p(len(line)) / 7, min(share(among("#*$%&|<>"), n), 3), min(share(among(".,;:?'\"()-"), n), 3),
            min(share(among("!"), n), 3), min(share(solid, n), 30) / 10, share(among("0123456789"), solid), share(letters, solid), share(upper, upper + lower),
            share(sum(len(w.encode()) <= 3 for w in words), n), share(sum(a == b for a, b in zip(words, words[1:])), n), 1 - share(len(set(words)), n), float(line in seen),
        ])
        seen.add(line)
    return out


def test_line_features_match_plain_python(docs):
    texts = [t for t in ODD if len(t or "") < 4000] + list(texts_of(docs).values())[:40]
    rng = np.random.default_rng(3)
    weights = rng.normal(size=quality.N_FEATURES)
    for b in blocks(pa.array(texts, pa.string()), 20_000):
        columns, doc, chars = quality.own_features(b)
        x = np.stack(list(columns), axis=1)
        want = [brute_lines(t) for t in texts[b.first : b.first + b.n]]
        # a line that comes again counts so from its second time on; which copy is the first does not matter to the sum
        assert np.allclose(x[:, :-1], np.concatenate([np.array(w)[:, :-1] for w in want]))
        assert [x[doc == i, -1].sum() for i in range(b.n)] == [sum(r[-1] for r in w) for w in want]
        assert chars.sum() == sum(len(line) for t in texts[b.first : b.first + b.n] for line in (t or "").split("\n"))
        u = quality.potentials(iter(x.T), doc, weights)
        for i in range(b.n):
            rows = x[doc == i]
            for k, r in enumerate(rows):
                near = [r, rows[k - 1] if k else 0 * r, rows[k + 1] if k + 1 < len(rows) else 0 * r]
                e = np.concatenate([*near, [1, k == 0, k + 1 == len(rows)]])
                assert u[np.flatnonzero(doc == i)[k]] == pytest.approx(e @ weights)


def enumerated(chain, u, known=None):
    """(marginals, pair probabilities, log partition sum, probability that all are good) by going through all labellings."""
    n, total, all_good = len(u), 0.0, 0.0
    good, both = np.zeros(n), np.zeros((4, n))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        w = math.exp(chain.start * y[0] + sum(u[i] * y[i] for i in range(n)) + sum(chain.pair[y[i], y[i + 1]] for i in range(n - 1)))
        total += w
        good += w * np.array(y)
        all_good += w * (sum(y) == n)
        for i in range(1, n):
            both[2 * y[i - 1] + y[i], i] += w
    return good / total, both / total, math.log(total), all_good / total


def test_messages_match_enumeration(monkeypatch):
    rng = np.random.default_rng(5)
    chain = quality.Chain(np.zeros(0), rng.normal(size=(2, 2)), 0.3)
    lengths = np.array([1, 4, 3, 11])
    u = rng.normal(size=19)
    starts = np.array([0, 1, 5, 8])
    p, pairs, total = quality.expectations(u, starts, lengths, chain)
    for k, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        want, want_pairs, want_total, _ = enumerated(chain, u[s : s + n])
        assert np.allclose(p[s : s + n], want) and np.allclose(pairs[:, s : s + n], want_pairs) and total[k] == pytest.approx(want_total)
    monkeypatch.setattr(quality, "LONG_CHAIN", 2)  # pieces of long chains
    assert np.allclose(quality.marginals(u, starts, lengths, chain), p)
    for n in range(1, 60):
        u, one = rng.normal(size=n) * 3, np.array([n])
        monkeypatch.setattr(quality, "LONG_CHAIN", 1000)
        want = quality.marginals(u, np.array([0]), one, chain)
        monkeypatch.setattr(quality, "LONG_CHAIN", 0)
        assert np.allclose(quality.marginals(u, np.array([0]), one, chain), want)


def test_fitting_raises_the_likelihood_of_labels():
    """P(good document) is that of all its lines being good, here by enumeration."""
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 6, 60)
    label = (np.arange(60) % 3 > 0).astype(int)
    x = rng.normal(size=(lengths.sum(), quality.N_OWN)) * 0.5
    doc = np.repeat(np.arange(60), lengths)
    x[:, 0] += np.where(label[doc] == 1, 2, np.where(rng.random(len(doc)) < 0.6, -2, 2))  # bad documents hold good lines too
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def likelihood(chain):
        u = quality.potentials(iter(x.T), doc, chain.weights)
        share = [enumerated(chain, u[s : s + n])[3] for s, n in zip(begins, lengths, strict=True)]
        return sum(math.log(max(q if y else 1 - q, 1e-12)) for q, y in zip(share, label, strict=True))

    size = np.ones(len(doc))
    before, after = (quality.fit_chain(x, lengths, label, size, rounds=30, latent_rounds=r, l2=0.1) for r in (0, 40))
    assert likelihood(after) > likelihood(before)
    p = quality.marginals(quality.potentials(iter(x.T), doc, after.weights), begins, lengths, after)
    bad_lines = (label[doc] == 0) & (x[:, 0] < 0)
    good_lines = (label[doc] == 0) & (x[:, 0] > 1)
    assert (p[bad_lines] < 0.5).mean() > 0.8 and (p[good_lines] > 0.5).mean() > 0.5


def test_mixed_documents_show_both_states(spark):
    d = "/root/testdata/sf0.01"
    docs, known = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    chain = quality.train(docs, known)
    rows = docs.join(known, "doc_id").filter(F.col("text").contains("\n")).orderBy("doc_id").collect()
    good, bad = ([r.text for r in rows if r.quality == q][:40] for q in (1, 0))
    texts = [f"{g}\n{b}\n{g2}" for g, b, g2 in zip(good, bad, good[1:], strict=False)]
    lines = quality.scored(pa.array(texts), chain, True)[1].to_pylist()
    assert sum(min(p) < 0.5 < max(p) for p in lines) >= 0.8 * len(lines)


def test_long_texts_of_lines_take_little_memory():
    """3 MB of line feeds, in a process of its own."""
    import subprocess
    import sys

    script = (
        "import resource, numpy as np, pyarrow as pa\nfrom quayside.llm import quality\n"
        "chain = quality.Chain(np.linspace(-1, 1, quality.N_FEATURES), np.eye(2), 0.1, 1.0, 0.0)\n"
        "made = quality.scored(pa.array(['\\n' * 3_000_000, 'ok']), chain, False)[0]\n"
        "assert len(made) == 2\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=120)
    assert int(done.stdout.split()[-1]) < 600, done.stderr


def test_samples_are_bounded(spark):
    """Of a labelled id in many rows and of long texts no more is drawn than the bound; equal rows come once."""
    from quayside.llm.common import labelled_sample

    rows = [(1, "same")] * 500 + [(2, f"text {i} " + "x" * 300) for i in range(400)] + [(3, "z" * 5000), (4, None)]
    known = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "id long, class int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample, weights = labelled_sample(docs, known, "doc_id", "text", 10, 50_000, 2)
    got = sample.collect()
    assert [r.text for r in got if r["class"] == 0] == ["same"] and weights[0] == 1 and weights[1] > 1
    chars = [len(r.text or "") for r in got if r["class"] == 1]
    assert 10_000 < sum(chars) <= 50_000 and max(chars) <= 1000
    whole, _ = labelled_sample(docs, known, "doc_id", "text", 10, 10_000_000, 2)
    assert whole.count() == 403


# --- 4: mixing ----------------------------------------------------------------------


def brute_targets(sizes):
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        weight = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * w / weight for s, w in weights.items()}
        above = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("few", [20_000, 0])
def test_targets_match_repeated_resharing(spark, monkeypatch, few):
    """Also with the shuffles that more sources than a broadcast holds need."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rng = random.Random(2)
    for names in [["b", None], ["a", "b", "c", "d", "Z", None], [f"s{i}" for i in range(40)]]:
        sizes = {s: rng.choice([0, 1, 5, 50, 500]) for s in names}
        made = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long"))
        got, want = {r.source: r.target for r in made.collect()}, brute_targets(sizes)
        assert len(got) == len(sizes) and all(got[s] == pytest.approx(want[s]) for s in sizes)


def brute_mix(rows):
    """Copies of each (source, place, size), place by place."""
    sizes = Counter()
    for source, _, size in rows:
        sizes[source] += size
    target = brute_targets(sizes)
    queue, reach = [], Counter()
    for source, place, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        reach[source] += size
        queue += [((reach[source] + e * sizes[source]) / target[source] if target[source] else 0.0, source, place, size) for e in range(3)]
    end, sums = -1.0, 0
    for finish in sorted({q[0] for q in queue}):
        sums += sum(q[3] for q in queue if q[0] == finish)
        if sums > sum(target.values()):
            break
        end = finish
    copies = Counter((source, place) for finish, source, place, size in queue if finish <= end)
    return {(s, p): copies[s, p] if size and target[s] else 1 for s, p, size in rows}


def test_mix_meets_its_targets(spark, docs):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sources = {}
    for r in out:
        sources.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    for rs in sources.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 3 * max(r.size for r in rs)


@pytest.mark.parametrize("run", [1000, 7])
def test_null_and_repeated_ids_are_queue_places(spark, monkeypatch, run):
    """Every source comes within a document of its target, whatever ids its rows have."""
    monkeypatch.setattr(mixing, "RUN", run)
    words = " ".join("w" * 10)
    data = [(i, "a", words) for i in range(300)] + [(None, "b", words)] * 300 + [(7, "c", words)] * 300 + [(None, None, "x y " * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    out = mixing.mix(df).collect()
    assert len(out) == len(data)
    for source in ("a", "b", "c"):
        rows = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 10
    seen, rows = Counter(), []
    for i, s, t in data:
        n = len(WORD.findall(t))
        seen[s, i, n] += 1
        rows.append((s, hashlib.md5(f"{'' if i is None else i}:{n}:{seen[s, i, n]}".encode()).hexdigest(), n))
    want = brute_mix(rows)
    assert Counter((r.source, r.size, r.copies) for r in out) == Counter((s, n, want[s, p]) for s, p, n in rows)


def test_mix_on_odd_rows(spark, monkeypatch):
    out = {r.doc_id: r for r in mixing.mix(odd_docs(spark)).collect()}
    assert out[0].size == 0 and out[0].taken == 0 and out[9].size == 3001 and out[None].source is None
    assert mixing.mix(odd_docs(spark, [])).count() == 0
    assert mixing.mix(odd_docs(spark, [None, ""])).filter("taken > 0").count() == 1  # the row without an id has words
    assert mixing.repeat_by_mix(odd_docs(spark, [])).count() == 0
    rows = mixing.repeat_by_mix(odd_docs(spark))
    assert rows.columns == odd_docs(spark, []).columns and rows.filter("doc_id = 0").count() == 1
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # all joins by shuffles
    assert Counter(map(str, mixing.repeat_by_mix(odd_docs(spark)).collect())) == Counter(map(str, rows.collect()))


def test_repeated_rows_match_brute_force(spark):
    """Rows of one id with other texts have places of their own; equal rows have as many as they are."""
    data = [(i % 30, "a" if i % 3 else None, f"text {i % 45} " + "w " * (i % 7)) for i in range(90)] + [(5, "b", "one two three")] * 60
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    key = F.hex(F.xxhash64("doc_id", "source", "text", F.lit(False), F.col("source").isNull(), F.lit(False)))
    keyed = df.withColumn("key", key).collect()
    seen, rows, of = Counter(), [], {}
    for r in keyed:
        seen[r.key] += 1
        place = hashlib.md5(f"{r.key}:{seen[r.key]}".encode()).hexdigest()
        rows.append((r.source, place, len(WORD.findall(r.text))))
        of[r.source, place] = (r.doc_id, r.source, r.text)
    want = Counter()
    for at, n in brute_mix(rows).items():
        want[of[at]] += n
    assert Counter(tuple(r) for r in mixing.repeat_by_mix(df).collect()) == +want


# --- 5: cross-entropy ---------------------------------------------------------------


def test_cross_entropy_matches_counting(spark):
    docs = spark.createDataFrame([(1, "a b a b", 1), (2, "a b", 1), (3, "c d!", 1), (4, None, 1), (5, "", 1), (None, "a", 1)], "doc_id long, text string, good int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    out = {r.doc_id: r for r in crossentropy.cross_entropy_difference(docs, labels).collect()}
    assert [out[i].n_tokens for i in (1, 2, 3, 4, 5)] == [4, 2, 3, 0, 0] and out[4].score == 0
    # document 2: in the target, the others are a b a b; in the background also c d ! and a
    uniform = crossentropy.SHARES[2] / 2**crossentropy.WORD_BITS
    target = [0.39 * 2 / 4 + uniform, 0.6 * 1 + 0.39 * 2 / 4 + uniform]
    background = [0.39 * 3 / 8 + uniform, 0.6 * 2 / 3 + 0.39 * 2 / 8 + uniform]
    assert out[2].target_loss == pytest.approx(-sum(map(math.log, target)) / 2)
    assert out[2].background_loss == pytest.approx(-sum(map(math.log, background)) / 2)
    assert crossentropy.cross_entropy_difference(docs.limit(0), labels).count() == 0
    assert crossentropy.cross_entropy_difference(odd_docs(spark), labels).count() == len(ODD) + 2


def brute_losses(docs, good):
    """Losses of every text by plain counts of words and pairs, without its own."""
    words = {i: re.findall(r"[a-z\x80-\U0010ffff]+|[^a-z\x80-\U0010ffff\s]+", t) for i, t in docs.items()}
    out = {}
    for i, own in words.items():
        for name, members in (("background", words), ("target", good)):
            others = [words[j] for j in members if j != i]
            single = Counter(w for o in others for w in o)
            pairs = Counter(p for o in others for p in zip(o, o[1:], strict=False))
            total, loss = sum(single.values()), 0.0
            for k, w in enumerate(own):
                joint = pairs[own[k - 1], w] / max(single[own[k - 1]], 1) if k else 0
                loss -= math.log(0.6 * joint + 0.39 * single[w] / max(total, 1) + 0.01 / 2**18)
            out[i, name] = loss / max(len(own), 1)
    return out


def test_counts_grow_with_the_words(spark):
    """More distinct words and pairs than 2**18 and 2**20: none borrows another's counts."""
    rng = random.Random(5)
    few = {i: " ".join(f"{rng.choice('abcdef')} {rng.choice('ghi')}!" for _ in range(30)) for i in range(40)}
    rare = {i: " ".join(crossword(i * 12_000 + k) for k in range(12_000)) for i in range(100, 200)}
    docs = spark.createDataFrame(list((few | rare).items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*few, *rare]], "doc_id long, quality int")
    out = {r.doc_id: r for r in crossentropy.cross_entropy_difference(docs, labels).collect()}
    floor = -math.log(0.01 / 2**18)
    assert all(out[i].n_tokens == 12_000 and out[i].background_loss == pytest.approx(floor, rel=1e-4) for i in rare)
    alone = {r.doc_id: r for r in crossentropy.cross_entropy_difference(docs.filter("doc_id < 100"), labels).collect()}
    want = brute_losses(few, [i for i in few if i % 2])
    for i in few:
        assert alone[i].background_loss == pytest.approx(want[i, "background"]) and alone[i].target_loss == pytest.approx(want[i, "target"])


def crossword(n):
    """A word of letters for each number."""
    return "".join(chr(97 + n // 26**k % 26) for k in range(5)) + "q"


# --- 6: search ----------------------------------------------------------------------


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = {i: [float(x) for x in rng.normal(size=6)] for i in range(90)}
    vectors |= {90: vectors[3], 91: vectors[3], 92: [0.0] * 6}
    data = [(i, v) for i, v in vectors.items()] + [(93, None), (94, [1.0, None]), (95, [float("nan")]), (96, [float("inf")]), (97, [])]
    rows = topk.whole_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 5, query_block=2, candidate_block=17).collect())
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()} | {97: []}
    want = []
    for q in range(0, 98, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    twice = topk.top_k(rows.filter("vec_id = 0").union(rows.filter("vec_id = 0")), rows, 5)
    assert sorted(tuple(r) for r in twice.collect()) == [w for w in sorted(want) if w[0] == 0]
    assert topk.top_k(rows.limit(0), rows).count() == 0 and topk.top_k(rows.filter("vec_id = 0"), rows.filter("vec_id < 3"), 20).count() == 2


def test_search_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i, "x", i) for i in range(30)], "vec_id long, embedding array<double>, score int, rank string, v int")
    rows = topk.whole_vectors(df, "vec_id", "embedding")
    out = topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 3).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(out, key=lambda r: (r.query_id, r["rank"]))] == [(0, 1), (0, 2), (0, 3), (20, 29), (20, 28), (20, 27)]


def test_sparse_postings():
    rng = np.random.default_rng(6)
    m = rng.integers(-3, 4, (50, 30)) * (rng.random((50, 30)) < 0.1)
    q = rng.integers(-3, 4, 30)
    assert np.array_equal(topk.Postings(m).scores(q), m @ q)


def test_training_samples_are_bounded_in_lines(spark):
    """Texts of very many line feeds count by their lines, and those of too many are not learned from."""
    rows = [(i, "line of a text\n" * 90, 1) for i in range(60)] + [(100 + i, "\n" * 5000, 1) for i in range(30)] + [(200 + i, "bad\n" * 90, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    known = docs.select(F.col("doc_id").alias("id"), "class")
    sample, _ = labelled_sample(docs, known, "doc_id", "text", 4000, 1_000_000, 2, quality.LINE_CHARS)
    by = {k: [r.text.count("\n") + 1 for r in sample.collect() if r["class"] == k] for k in (0, 1)}
    assert all(by[k] and sum(by[k]) <= 1_000_000 // quality.LINE_CHARS and max(by[k]) < 5000 for k in by)
    held = quality.train(docs, docs.select("doc_id", F.col("class").alias("quality")), most_chars=1_000_000)
    assert held is not None


# --- 7: pages -----------------------------------------------------------------------


def page(nav, body, extra=""):
    return f"<html><head><title>t</title></head><body><nav>{nav}</nav><article><h1>Head &amp; more</h1><p>{body}<br>next  line<div class=x><span>Read our</span> guide</div></article>{extra}<footer>f</footer>"


def test_templates_go_and_prose_stays(spark):
    data = [(i, f"http://a.example/{i}", page("m", f"text {i}", "<div>Join us</div>")) for i in range(6)]
    data += [(6, "http://b.example/", page("m", "lone")), (7, None, None), (8, "bad url", ""), (9, "http://c.example", "<p>a &lt;b&gt; &#233; <b>bold<p>c<script>x</script><aside>no</aside>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    out = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert out[0].text == "Head & more\ntext 0 next line" and out[6].text == "Head & more\nlone next line\nRead our guide"
    assert out[7].text == "" and out[8].text == "" and out[9].text == "a <b> é bold\nc" and out[9].n_chars == len(out[9].text)
    assert html.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [html.BROADCAST_BYTES, -1])
def test_templates_of_a_large_host(spark, monkeypatch, broadcast):
    """No list knows the block, and it is on 10 of 320 pages; copies of a page count once."""
    monkeypatch.setattr(html, "BROADCAST_BYTES", broadcast)
    bar = lambda k: f"<div class=zz>Home of {k}</div>"
    data = [(i, f"http://h.example/{i}", f"<body>{bar(i // 10)}<div>text {i}</div>") for i in range(320)]
    data += [(400 + i, "http://h.example/x", f"<body>{bar('few')}<div>same</div>") for i in range(9)]
    data += [(500, "http://g.example/", f"<body>{bar(1)}<div>text 11</div>")]
    data += [(600 + i, "http://k.example/x", f"<body>{bar('few')}<div>same</div>") for i in range(9)]
    data += [(700 + i, f"http://p.example/{i}", f"<article><p>story {i}<p>quoted by all the others too</article>") for i in range(12)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.extract_main_text(df).collect()}
    assert all(out[i] == f"text {i}" for i in range(320)) and len(out) == len(data)
    assert out[400] == "same"  # a rare one in a slot of templates
    assert out[600] == "Home of few\nsame" and out[500] == "Home of 1\ntext 11"
    assert out[700] == "story 0\nquoted by all the others too"


def blog(i):
    """A page with a breadcrumb, an advert, related links and comments around and in its article."""
    return (
        f"<body class='menu-open'><div class=breadcrumb>Home &gt; News</div><div class='content has-sidebar'><article><h1>Title {i}</h1><p>Body text of story {i}.</p><p class=ad>Buy now at half price!</p>"
        f"<div class=related-posts><a>Related story {i + 1}</a></div><div id=comments><p>A reader's comment {i}</p></div></article></div><footer>f"
    )


@pytest.mark.parametrize("n", [1, 6, 199, 200, 230])
def test_one_rule_for_hosts_of_any_size(spark, n):
    """The same text from a host of one page, of many and on both sides of any number of them."""
    df = spark.createDataFrame([(i, f"http://a.example/{i}", blog(i)) for i in range(n)], "page_id long, url string, html string")
    assert all(r.text == f"Title {r.page_id}\nBody text of story {r.page_id}." for r in html.extract_main_text(df).collect())


def test_wrappers_stay_and_nothing_else_is_dropped():
    main = html.main_text
    assert main("<div id=page class=menu-open><p>all of it") == "all of it"
    assert main("<div class='content with-sidebar'><article><p>story</article></div><aside><article class=teaser><p>other</article></aside>") == "story"
    assert main("<div class=sidebar-layout><article><p>story, the longer one</article></div><div class=related><article><p>other</article></div>") == "story, the longer one"
    assert main("<form><main><p>story</main></form><nav><a>x</a></nav>") == "story"
    assert main(f"<div class=header-wrapper><p>{'long text ' * 9}</div><div>by me</div>") == " ".join(["long text"] * 9) + "\nby me"
    assert main(f"<div class=comments><p>{'a reader says ' * 9}</div><div>short</div>") == "short"
    assert main("<div class=cookie-notice><p>we use many cookies here</div><div>hi</div>") == "hi"
    assert main("<p>Let <math><mi>x</mi>=2</math> then</p><xmp><b> kept</xmp>") == "Let x=2 then\n<b> kept"
    assert main("<pre>a <span class=comment># b</span> <code class=menu>c</code></pre><p>x <span class=comment>gone</span>") == "a # b c\nx"
    assert main("<header class=masthead><article><h1>T</h1></article></header>") == "T"
    assert main("<p>a" + "b " * 300_000).endswith("b b") and len(main("<div class=x>" * 2000 + "z" * 200_000)) == 200_000


def test_listed_subtrees_are_counted_too(spark):
    data = [(i, f"http://a.example/{i}", page("m", f"text {i}")) for i in range(6)]
    found = html.by_host(html.site_rules(spark.createDataFrame(data, "page_id long, url string, html string")))
    assert html.removals(page("m", "text 7"), found["a.example"]) == (2, 1, 0)
    assert html.removals(page("other", "text 7")) == (0, 0, 2)
    whole = "<body><div><article><p>all of it</article></div><div>x</div>"
    assert len(html.candidates(whole)) == 1


def article_lines(source):
    """A page's article by a plain pattern."""
    import html as references

    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    lines = (" ".join(references.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in lines if x)


def test_templates_make_the_text_of_large_hosts(spark):
    """On the real pages: counts by host as by hand, and the articles' text by the templates and their slots alone, without the lists."""
    rows = read_table(spark, "/root/testdata/sf0.1", "pages").filter(F.col("url").contains("blog.tionsh.example.com")).select("page_id", "url", "html").collect()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.extract_main_text(df).collect()}
    assert len(rows) >= 200 and all(out[r.page_id] == article_lines(r.html) for r in rows)
    counts, places = Counter(), Counter()
    for source in {r.html for r in rows}:
        for found in html.candidates(source):
            counts[found] += 1
            places[found[1]] += 1
    templates = {found for found in counts if counts[found] >= html.MIN_PAGES}
    slots = {s for s in places if sum(counts[f] for f in templates if f[1] == s) >= html.SLOT_SHARE * places[s]}
    (site,) = html.by_host(html.site_rules(df)).values()
    assert site == (frozenset(h for h, _ in templates), frozenset(slots))
    assert all(html.main_text(r.html, site, lists=False) == out[r.page_id] != html.main_text(r.html, lists=False) for r in rows)
    fewer = html.Site(site.templates)
    assert sum(html.main_text(r.html, fewer, lists=False) == out[r.page_id] for r in rows) >= 0.2 * len(rows)  # by exact recurrence alone


def test_pages_with_odd_columns_and_repeats(spark):
    data = [(1, "http://a.example/", page("m", "x"), "t", 5, "h"), (1, "http://a.example/", page("m", "x"), "t", 5, "h"), (None, None, "<p>y", None, None, None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string, n_chars int, host string")
    out = html.extract_main_text(df).collect()
    assert sorted(r.text for r in out) == ["Head & more\nx next line\nRead our guide"] * 2 + ["y"] and len(out[0]) == 4


def test_parser_survives_anything():
    for source in ("<", "<a", "</p></div>", "<p" * 500, "<div>" * 3000 + "x", "a < b <3 <!-- open", "<script>never closed", "<p class='x>y", "\x00<b>z"):
        html.main_text(source)
    assert html.main_text("<div>" * 3000 + "x") == "x"


def test_pages_match_plain_reading(spark):
    out = html.op7_html_main_text(spark, DATA).collect()
    sources = {r.page_id: r.html for r in read_table(spark, DATA, "pages").collect()}
    assert len(out) == len(sources) and all(r.text == article_lines(sources[r.page_id]) for r in out)


# --- 9: pieces ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_pieces()


def brute_best(text, entries, unknown):
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for n in range(1, min(16, end) + 1):
            s = entries.get(text[end - n : end], unknown if n == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[end - n] + s)
    return best[-1]


@pytest.mark.parametrize("long", [pieces.LONG, 3])
def test_viterbi_finds_the_best_score(vocabulary, docs, monkeypatch, long):
    """Also of texts with unknown characters, whose byte pieces together score as one unknown."""
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(pieces, "LONG", long)
    model = SentencePieceProcessor(model_file=pieces.MODEL)
    entries = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    scores = {model.piece_to_id(p): s for p, s in entries.items()}
    texts = [t[:400] for t in list(texts_of(docs).values())[:30]]
    texts += ["  two  spaces", "漢字 mixed é", "x" * 300, "ab" * 200, "数据获取一个数据\n漢😀字▁ab	tab", "héllo▁▁ wörld𐍈", "一个" * 90]
    ids, counts = pieces.encode_texts(pa.array(texts), vocabulary)
    at = np.concatenate([[0], np.cumsum(counts)])
    for text, a, b in zip(texts, at, at[1:], strict=False):
        led, got, k = " " + text, 0.0, 0
        mine = [int(i) for i in ids[a:b]]
        while k < len(mine):
            if mine[k] in scores:
                got, k = got + scores[mine[k]], k + 1
            else:  # the byte pieces of one character
                lead = vocabulary.surface[mine[k]][0]
                got, k = got + vocabulary.unknown, k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        spoken = led.replace("▁", "\U0010ffff").replace(" ", "▁")
        assert got == pytest.approx(brute_best(spoken, entries, vocabulary.unknown))
        assert pieces.decode_ids(mine, vocabulary) == text


def test_unspaced_texts_are_fast(vocabulary):
    import time

    rng = random.Random(9)
    for text in ("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(330_000)), "".join(rng.choice("abcdefghijklm") for _ in range(100_000))):
        began = time.process_time()
        ids, counts = pieces.encode_texts(pa.array([text]), vocabulary)
        assert time.process_time() - began < 12 and pieces.matches(pa.array([text]), ids, counts, vocabulary).all()


def test_lost_text_is_seen(vocabulary):
    texts = pa.array(["one two", None, "", "three"])
    ids, counts = pieces.encode_texts(texts, vocabulary)
    assert pieces.matches(texts, ids, counts, vocabulary).all()
    other = pa.array(["one too", None, "", "thre"])
    assert pieces.matches(other, ids, counts, vocabulary).tolist() == [False, True, True, False]
    assert pieces.matches(pa.array(["one too", None, "", "three"]), ids, counts, vocabulary).tolist() == [False, True, True, True]


def test_round_trips(spark, vocabulary, docs):
    odd = [t for t in ODD if t] + ["▁ literal ▁▁", "tab\tand\r\nbreak", " lead", "trail ", "  ", "�\U0010fffd"]
    ids, counts = pieces.encode_texts(pa.array(odd), vocabulary)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [pieces.decode_ids(ids[a:b], vocabulary) for a, b in zip(at, at[1:], strict=False)] == odd
    out = pieces.encode(odd_docs(spark))
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].ids is None and got[1].ids == [] and got[0].n_tokens == 0 and all(r.round_trip for r in got.values())
    back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD))
    assert pieces.encode(docs).filter("NOT round_trip").count() == 0 and pieces.encode(odd_docs(spark, [])).count() == 0


# --- 10: toxicity -------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = toxicity.op10_toxicity(spark, d).join(read_table(spark, d, "labels").withColumnRenamed("toxic", "label"), "doc_id").filter("held_out").collect()
    hit = [r.toxic for r in out if r.label == 1]
    clean = [not r.toxic for r in out if r.label == 0]
    assert sum(hit) >= 0.85 * len(hit) and sum(clean) >= 0.97 * len(clean)
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.severity <= 3 for r in out)


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(8)
    n = 400
    strength = rng.integers(0, 4, n)
    doc = np.repeat(np.arange(n), strength + 1)
    column = np.concatenate([np.arange(s + 1) for s in strength])
    model = toxicity.fit(doc, column, np.arange(4), strength)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.weights) == len(model.features)


def brute_features(text):
    """Hashed words and beginnings of a text with their counts, one by one."""
    from quayside.llm.common import SpanHash, mix

    out = Counter()
    for word in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower()):
        data = np.frombuffer(word, np.uint8)
        of = lambda n: SpanHash(data).of(np.array([0]), np.array([n]))
        out[int(of(len(word))[0] >> np.uint64(64 - toxicity.BITS))] += 1
        for k in toxicity.PREFIXES:
            if len(word) > k:
                out[int(mix(of(k) ^ np.uint64(k))[0] >> np.uint64(64 - toxicity.BITS))] += 1
    return out


def test_doses_and_grades_match_brute_force():
    texts = [f"plain words {'here' * (i % 3)} number{i % 5}" + " foulness foul" * (i % 4 if i % 2 else 0) for i in range(60)]
    toxic = np.array([bool(i % 2 and i % 4) for i in range(60)])
    (block,) = blocks(pa.array(texts), 10**6)
    doc, feature, count = toxicity.word_features(block)
    want = [brute_features(t) for t in texts]
    got = [dict(zip(feature[doc == i].tolist(), count[doc == i].tolist(), strict=True)) for i in range(60)]
    assert got == want
    kinds, column = np.unique(feature, return_inverse=True)
    in1 = Counter(k for w, t in zip(want, toxic, strict=True) if t for k in w)
    in0 = Counter(k for w, t in zip(want, toxic, strict=True) if not t for k in w)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    marks = {k for k in in1 if in1[k] >= 4 and math.log((in1[k] + 0.5) / (n1 + 1)) - math.log((in0[k] + 0.5) / (n0 + 1)) >= 3}
    dose = [sum(n for k, n in w.items() if k in marks) for w in want]
    assert marks and toxicity.doses(doc, column, count, toxic).tolist() == dose
    cuts = [sorted(d for d, t in zip(dose, toxic, strict=True) if t)[math.floor(q * (n1 - 1) / 3)] for q in (1, 2)]
    grade = [1 + sum(d > c for c in cuts) if t else 0 for d, t in zip(dose, toxic, strict=True)]
    assert toxicity.grades_of(doc, column, count, toxic).tolist() == grade


def test_gradient_and_severity_match_brute_force():
    rng = np.random.default_rng(2)
    n, f, top = 30, 5, 3
    held = rng.random((n, f)) < 0.5
    doc, column = np.nonzero(held)
    grade, weigh = rng.integers(0, top + 1, n), rng.random(n) + 0.5
    theta = rng.normal(size=f + top) * 0.4

    def brute(theta):
        cuts = [theta[f], theta[f] + math.exp(theta[f + 1]), theta[f] + math.exp(theta[f + 1]) + math.exp(theta[f + 2])]
        total = -0.25 * sum(w * w for w in theta[:f])
        for i in range(n):
            score = sum(theta[k] for k in range(f) if held[i, k])
            above = [1.0, *[1 / (1 + math.exp(c - score)) for c in cuts], 0.0]
            total += weigh[i] * math.log(above[grade[i]] - above[grade[i] + 1])
        return total

    value, grad = toxicity.likelihood(theta, doc, column, grade, weigh, f, 0.5)
    assert value == pytest.approx(brute(theta))
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert grad[k] == pytest.approx((brute(theta + step) - brute(theta - step)) / 2e-6, abs=1e-4)
    texts = ["foul", "fair words", "", None, "foul foul fair"]
    of = {w: min(brute_features(w)) for w in ("foul", "fair", "words")}
    model = toxicity.Ordinal(np.sort([of["foul"], of["fair"]]), np.array([1.5 if k == of["foul"] else -0.5 for k in np.sort([of["foul"], of["fair"]])]), np.array([0.2, 1.0, 2.0]))
    severity, likeliest, p_toxic, _ = (x.to_pylist() for x in toxicity.graded_texts(pa.array(texts, pa.string()), model))
    for k, score in enumerate([1.5, -0.5, 0.0, 0.0, 1.0]):
        above = [1 / (1 + math.exp(c - score)) for c in (0.2, 1.0, 2.0)]
        each = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert severity[k] == pytest.approx(sum(g * q for g, q in enumerate(each))) and likeliest[k] == each.index(max(each)) and p_toxic[k] == pytest.approx(above[0])


def test_toxicity_on_odd_rows(spark, labels):
    out = toxicity.toxicity(odd_docs(spark), labels).collect()
    assert len(out) == len(ODD) + 2 and toxicity.toxicity(odd_docs(spark, []), labels).count() == 0
    none = toxicity.toxicity(odd_docs(spark), labels.limit(0)).collect()
    assert not any(r.toxic for r in none) and max(r.expected_severity for r in none) < 1e-6


# --- the pipeline -------------------------------------------------------------------


def test_pipeline_stages_match_their_parts(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = read_table(spark, d, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, d).cache()
    scored = quality.op2_quality_crf(spark, d).filter("predicted = 1").select("doc_id")
    assert good.columns == docs.columns and {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in scored.collect()}
    ruled = stages["quality rules"](spark, good, d).cache()
    want = set()
    for i, t in texts_of(good).items():
        m = brute_base(t)
        if m:
            want.add(i)
    assert {r.doc_id for r in ruled.collect()} == want
    one = stages["near-duplicates"](spark, ruled, d).cache()
    ids, prints = zip(*[(r.doc_id, brute_fingerprint(r.text)) for r in ruled.collect()], strict=True)
    groups = brute_components(ids, prints)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups))
    mixed = stages["mixing"](spark, one, d).cache()
    rows = one.select("*", F.hex(F.xxhash64(*one.columns, *[F.col(c).isNull() for c in one.columns])).alias("key")).collect()
    places = {(r.source, hashlib.md5(f"{r.key}:1".encode()).hexdigest(), len(WORD.findall(r.text))): r.doc_id for r in rows}
    copies = brute_mix(list(places))
    taken = +Counter({i: copies[s, p] for (s, p, _), i in places.items()})
    assert len(places) == len(rows) and Counter(r.doc_id for r in mixed.select("doc_id").collect()) == taken
    out = stages["encoding"](spark, mixed, d)
    assert out.count() == sum(taken.values()) and out.filter("NOT round_trip").count() == 0


def brute_base(text):
    """The verdict of the rules, by windows: a repeat longer than the limit is a repeated window of one word more."""
    words = WORD.findall(text or "")
    covered = sum(len(w) for w, f in zip(words, brute_inside(words, 3), strict=True) if f)
    return (
        len(words) >= 20 and 100 * sum(brute_inside(words, 8)) <= 30 * len(words) and 100 * covered <= repetition.MAX_COVERED_PERCENT * sum(map(len, words))
        and not any(brute_inside(words, repetition.MAX_LONGEST + 1))
    )
