"""URL filters, toxicity, language id, near duplicates, language model, pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushdex.llm import common, gru, langid, lmscore, nearjoin, toxicity, urlfilter
from hushdex.llm.components import components

fold = lambda doc, n: zlib.crc32(("" if doc is None else str(doc)).encode()) % n


# -- urls ------------------------------------------------------------------------


@settings(deadline=None, max_examples=50)
@given(st.sets(st.text(max_size=6), max_size=30), st.sets(st.text(max_size=6), min_size=1, max_size=200))
def test_cascade_is_exact_in_its_universe(listed, universe):
    first = urlfilter.filled(listed, len(listed), urlfilter.first_rate(len(listed), len(universe) + len(listed)), 1)
    c = urlfilter.cascade([first], listed, {k for k in universe - listed if urlfilter.digest(k) in first})
    assert all((urlfilter.digest(k) in c) == (k in listed) for k in universe | listed)


def test_cascade_with_many_false_positives():
    listed, universe = {f"l{k}" for k in range(500)}, {f"u{k}" for k in range(3000)}
    first = urlfilter.filled(listed, 500, urlfilter.first_rate(500, 600), 1)  # a far too small guess: many pass
    false = {k for k in universe if urlfilter.digest(k) in first}
    assert len(false) > 500
    c = urlfilter.cascade([first], listed, false)
    assert all((urlfilter.digest(k) in c) == (k in listed) for k in universe | listed)


@pytest.mark.parametrize("most", [200_000, 40])
def test_a_list_may_be_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "DRIVER_KEYS", most)
    monkeypatch.setattr(urlfilter, "STRETCH", 16)
    rng = random.Random(3)
    names = [f"h{k}.example.com" for k in range(900)]
    bad = rng.sample(names, 300) + ["absent.example.org"]
    pages = spark.createDataFrame([(k, f"http://{rng.choice(['', 'www.'])}{n}/x") for k, n in enumerate(names)], "page_id bigint, url string")
    lists = spark.createDataFrame([(h,) for h in bad + bad[:5] + [None]], "host string")
    got = urlfilter.filter_urls(pages, (), lists).collect()
    assert {r["page_id"]: r["listed"] for r in got} == {k: n in set(bad) for k, n in enumerate(names)}
    assert all(r["verdict"] == ("block" if r["listed"] else "allow") for r in got)


@pytest.mark.parametrize(("url", "parts"), [(None, ("", "")), ("no scheme/x", ("", "")), ("http://A.Org", ("a.org", "")), ("x://É.com/P?q#f", ("É.com", "/P")), ("a://b#f/x?y", ("b", "")), ("http:///p", ("", "/p")), ("u://h://k/l", ("h:", "//k/l"))])
def test_split_url(url, parts):
    assert urlfilter.split_url(url) == parts


def test_filter_urls(spark):
    hosts = ["example.org", "a.example.org", "xexample.org", "org", "com", "b.com", "free-bets.example.net", "m.spam-farm.example.com", "example.net", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/", "/de/a", "/x#/es/")] + [None, "", "://", "nothing"]
    rows = [(k, u, "c") for k, u in enumerate(urls)] + [(None, "http://example.org/es/", "c"), (0, urls[0], None)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://example.org/es/" if r["page_id"] is None else urls[r["page_id"]]
        h, p = urlfilter.split_url(url)
        fits = [x for x in urlfilter.RULES if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.key), default=None)
        bad = any(h == b or h.endswith("." + b) for b in urlfilter.BLOCKED_HOSTS)
        assert tuple(r[1:5]) == (h, p, best and best.key, best.verdict if best else "block" if bad else "allow")
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urlfilter.filter_urls(empty).collect() == []


# -- toxicity --------------------------------------------------------------------


def segments_brute(s):
    """Maximal scoring segments by their definition: best first, then left and right of it."""
    best = None
    for i in range(len(s)):
        t = 0
        for j in range(i, len(s)):
            t += s[j]
            # Of equal sums the shorter one: a segment neither begins nor ends with nothing gained.
            if t > 0 and (best is None or (t, i - j) > (best[2], best[0] - best[1] + 1)):
                best = (i, j + 1, t)
    if best is None:
        return []
    i, j, _ = best
    return segments_brute(s[:i]) + [best] + [(a + j, b + j, t) for a, b, t in segments_brute(s[j:])]


@settings(deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=25))
def test_maximal_segments(raw):
    s = np.array([1000.0 * v + 7 * k % 13 for k, v in enumerate(raw)])  # whole numbers: sums are exact
    got = toxicity.maximal_segments(s)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in segments_brute(s.tolist())]


def test_lambda_solves_its_equation():
    v, n = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    lam = toxicity.solve_lambda(v, n)
    assert lam > 0 and abs((n * np.exp(lam * v)).sum() - 1) < 1e-6


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    docs, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        bad = k % 8 == 0
        if bad:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randint(0, len(words)), rng.choice(["zzrude", "zzvile", "zzmean", "ZZRUDE!"]))
        docs.append((k, " ".join(words), "x", "s", 1))
        if k % 3 < 2:
            labels.append((k, 1, int(bad)))
    docs += [(1000, None, "x", "s", 1), (1001, "", "x", "s", 1), (None, "plain", None, None, None), (3, docs[3][1], "x", "s", 1)]
    labels += [(None, 1, 1), (2000, 1, 1), (5, 0, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string, predicted string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(toxic_tables):
    docs, labels = toxic_tables
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 5) == 0)
        if r["doc_id"] is not None:
            assert r["predicted"] == (r["doc_id"] < 600 and r["doc_id"] % 8 == 0)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 75
    assert kept.where("doc_id = 1000").first()["text"] is None


def toxic_brute(docs, labels):
    """(doc_id, score, passages) of every row by the definitions, in plain Python."""
    low = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    known = collections.defaultdict(set)
    for d, _, y in labels:
        if d is not None and y is not None and fold(d, 5) != 0:
            known[d].add(y)
    train = [(low(t), next(iter(known[d]))) for d, t, *_ in docs if d is not None and len(known.get(d, ())) == 1]
    by = collections.Counter(), collections.Counter()
    for w, y in train:
        by[y].update({x for v in set(w) for x in [v, *(b"^" + v[:n] for n in toxicity.STEMS if len(v) > n)]})
    n0, n1 = sum(by[0].values()), sum(by[1].values())
    prior = toxicity.PRIOR * (n0 + n1)
    least = toxicity.MIN_SHARE * (math.log((1 + toxicity.PRIOR) / toxicity.PRIOR) + math.log(n0 / n1))
    odds = {}
    for x in by[0] | by[1]:
        a = (by[0][x] + by[1][x]) / (n0 + n1) * prior
        one, zero = by[1][x] + a, by[0][x] + a
        d = math.log(one / (n1 + prior - one)) - math.log(zero / (n0 + prior - zero))
        if abs(d / math.sqrt(1 / one + 1 / zero)) >= toxicity.MIN_Z and (d < 0 or d >= least):
            odds[x] = d
    word = collections.Counter()
    for x in odds:
        for n in toxicity.STEMS if x[:1] != b"^" else ():
            word[b"^" + x[:n]] = max(word[b"^" + x[:n]], by[1][x])
    odds = {x: d for x, d in odds.items() if 3 * by[1][x] >= 4 * word[x]}

    def scores(words):
        out, last = [], {}
        for k, w in enumerate(words):
            stems = [odds[b"^" + w[:n]] for n in toxicity.STEMS if b"^" + w[:n] in odds]
            s = odds.get(w, max(stems, key=abs, default=toxicity.NEUTRAL))
            if s > 0:
                s, last[w] = (toxicity.NEUTRAL if k - last.get(w, -1000) <= toxicity.REPEAT else s), k
            out.append(s)
        return out

    hist = collections.Counter(round(float(np.round(s, 1)), 1) for w, y in train if y == 0 for s in scores(w))
    hist = collections.Counter({(v if v else toxicity.NEUTRAL): n for v, n in hist.items()}) + collections.Counter({max(odds.values()): 1})
    lo, hi = 0.0, 64.0
    for _ in range(200):
        lam = (lo + hi) / 2
        lo, hi = (lam, hi) if sum(n * math.exp(min(700, lam * v)) for v, n in hist.items()) < sum(hist.values()) else (lo, lam)

    def total(words):
        good = [x for _, _, s in segments_brute(scores(words)) if (x := lam * s - math.log(max(2, len(words)))) > 0]
        return sum(good), len(good)

    model = toxicity.set_cut(toxicity.Model(), np.array([total(w)[0] for w, _ in train]), np.array([y for _, y in train]))
    return [(d, 1 / (1 + math.exp(-model.slope * (x - model.cut))), many) for d, t, *_ in docs for x, many in [total(low(t))]]


def test_toxicity_against_brute_force(toxic_tables):
    docs, labels = toxic_tables
    want = toxic_brute([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    order = lambda r: (str(r[0]), r[1])
    for (d, s, n), (e, x, m) in zip(sorted(want, key=order), sorted(((r["doc_id"], r["score"], r["n_passages"]) for r in got), key=order), strict=True):
        assert d == e and math.isclose(s, x, rel_tol=1e-3, abs_tol=1e-6) and n == m


def test_every_passage_counts():
    """A passage that comes again far on in a long text is found again; a word that is repeated at once is not."""
    scorer = toxicity.Scorer(toxicity.Model({b"vile": 3.0, b"rude": 3.0}, lam=3.0))
    far = " ".join(["vile rude", *["plain"] * 500] * 40)
    assert scorer.total(far)[2] == 40
    assert scorer.total("vile " * 50)[2] == 1 and [s for *_, s in scorer.total("vile " * 50)[1]] == [3.0]


def test_toxicity_without_labels(toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels.where("false"))
    assert {r["predicted"] for r in toxicity.toxicity(docs, model).collect()} == {0}
    assert toxicity.toxicity(docs.where("false"), model).collect() == []


# -- language id -----------------------------------------------------------------


def ngrams_brute(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = collections.Counter()
    for w in words:
        out.update(w)
        p = f" {w} "
        out.update(p[k : k + 2] for k in range(len(p) - 1))
        out.update(p[k : k + 3] for k in range(len(p) - 2))
    return out


@settings(deadline=None)
@given(st.text(alphabet="aBé 1.\nß漢", max_size=30))
def test_ngrams(text):
    want = ngrams_brute(text)
    u, n = np.unique(langid.ngrams(text), return_counts=True)
    assert sorted(n.tolist()) == sorted(want.values()) and len(u) == len(want)


def identify_brute(rows, fold_of):
    """Every text's language by the definition: profiles, ranks, out-of-place distances."""
    # Ties go by code: two-letter n-grams fall, all others rise, single letters come first, from the last.
    tie = lambda g: (0, -ord(g)) if len(g) == 1 else (1, *(-(0 if c == " " else ord(c)) for c in g)) if len(g) == 2 else (2, *(0 if c == " " else ord(c) for c in g))
    best = lambda n, top: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], tie(x[0])))[:top]]
    by = collections.defaultdict(collections.Counter)
    for d, t, lang in rows:
        if lang is not None and fold(d, 4) != fold_of and t and ngrams_brute(t):
            by[lang].update(ngrams_brute(t))
    ranks = {k: {g: r for r, g in enumerate(best(v, langid.LANG_TOP))} for k, v in by.items()}
    out = []
    for d, t, _ in rows:
        mine = best(ngrams_brute(t or ""), langid.DOC_TOP)
        far = sorted((sum(abs(r[g] - k) if g in r else langid.LANG_TOP for k, g in enumerate(mine)), lang) for lang, r in ranks.items())
        if not mine or not far:
            out.append((d, fold(d, 4) == fold_of, "und", 0.0))
        else:
            out.append((d, fold(d, 4) == fold_of, far[0][1], 1.0 if len(far) < 2 else far[1][0] / (far[1][0] + far[0][0]) if far[1][0] else 0.5))
    return out


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(4)
    sounds = {"aa": ["ba", "na", "la", "ma"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["eau", "oir", "què", "ment"]}
    rows = []
    for k in range(240):
        lang = "aabbcc"[2 * (k % 3) :][:2]
        rows.append((k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(12)), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34!", "aa"), (903, "bana lama", None), (None, "schung verich", "bb"), (0, rows[0][1], "aa"), (904, "oireau " * 3000 + "x" * 5000, "cc")]
    return rows


@pytest.mark.parametrize(("langs", "chars"), [(5000, 1 << 20), (2, 100)])
def test_identify(spark, monkeypatch, spoken, langs, chars):
    rows = spoken
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, best int")
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", langs)
    assert len(list(langid.learn(docs, 2, 4))) == (1 if langs > 3 else 2)
    got = [tuple(r) for r in langid.identify(docs).collect()]
    order = lambda r: (str(r[0]), r[1:])
    want = identify_brute(rows, 2)
    assert [(*r[:3], round(r[3], 12)) for r in sorted(got, key=order)] == [(*r[:3], round(r[3], 12)) for r in sorted(want, key=order)]
    for d, _, lang, _ in got:
        assert lang == ("bb" if d is None else "und" if d in (900, 901, 902) else "aa" if d == 903 else "cc" if d == 904 else rows[d][2])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert langid.identify(docs.where("false")).collect() == []
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", chars)
    for _, t, _ in rows:
        u, n = langid.counted(langid.ngrams(x) for x in langid.stretches(t or ""))
        v, m = np.unique(langid.ngrams(t or ""), return_counts=True)
        assert u.tolist() == v.tolist() and n.tolist() == m.tolist() and "".join(langid.stretches(t or "")) == (t or "")


# -- near duplicates -------------------------------------------------------------


def near_brute(rows, threshold=0.8, n=5):
    low = {c: c + 32 for c in range(65, 91)}
    words = [tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(low))) for _, t in rows]
    sets = {w: frozenset(w[k : k + min(n, len(w))] for k in range(len(w) - min(n, len(w)) + 1)) for w in words if w}
    keys = list(sets)
    link = {a: [b for b in keys if b != a and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])] for a in keys}
    top = {}
    for a in keys:
        if a not in top:
            stack, seen = [a], {a}
            while stack:
                for b in link[stack.pop()]:
                    if b not in seen:
                        seen.add(b)
                        stack.append(b)
            ids = [d for (d, _), w in zip(rows, words, strict=True) if w in seen and d is not None]
            top.update(dict.fromkeys(seen, min(ids, default=None)))
    return [(d, top[w] if w else d, len(link[w]) if w else 0, words.count(w) if w else 1) for (d, _), w in zip(rows, words, strict=True)]


def varied(rng, words, many):
    out = list(words)
    for _ in range(many):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("blocks", [(2000, 600_000), (7, 10**9)])
def test_near_duplicates(spark, monkeypatch, blocks):
    monkeypatch.setattr(nearjoin, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(nearjoin, "BLOCK_SHINGLES", blocks[1])
    rng = random.Random(7)
    pool = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(pool) for _ in range(rng.randint(60, 200))]
        rows += [(0, varied(rng, base, m)) for m in (0, 0, 1, 1, 2, 3, 6)]
    base = [rng.choice(pool) for _ in range(150)]
    rows += [(0, varied(rng, base, 1)) for _ in range(40)] + [(0, " ".join(base).upper() + "!")] * 30
    rows += [(0, "short text"), (0, "Short, text."), (0, "a b c d e f"), (0, ""), (0, None), (0, "...")]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, key string").repartition(3)
    got = sorted(tuple(r) for r in nearjoin.near_duplicates(docs).collect())
    assert got == sorted(near_brute(rows))
    if blocks[0] == 7:
        kept = nearjoin.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, c, _, _ in got if d == c)


def test_near_duplicates_in_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK_SHINGLES", 40)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, varied(rng, base, 1)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in nearjoin.near_duplicates(docs).collect())
    assert got == sorted(near_brute(rows)) and {r[2] for r in got} == {4}
    two = [(b"a", 1, np.arange(9, dtype=np.uint64)), (b"b", 1, np.arange(9, dtype=np.uint64))]
    assert [list(nearjoin.verify_group(two, 0.8, *pair)) for pair in ((0, 1), (1, 2))] == [[], []]
    assert [r[:3] for r in nearjoin.verify_group(two, 0.8, 1, 1)] == [(b"a", 1, b"a"), (b"b", 1, b"a")]


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"), (3, "other words are here now then"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["n_copies"]) for r in nearjoin.near_duplicates(docs).collect()))
    assert got == [(0, 0, 0, 1), (0, 3, 0, 3), (3, 3, 0, 1), (3, 3, 0, 3), (3, 3, 0, 3)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in nearjoin.one_of_each(docs).collect())
    assert kept == [(0, ""), (3, rows[1][1]), (3, rows[3][1])]
    assert nearjoin.near_duplicates(docs.where("false")).collect() == []


def test_one_of_each_decides_by_row(spark):
    """A repeated id: one of its texts goes, another stays; columns of any name stay too."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    rows = [(1, varied(rng, base, 1)), (5, varied(rng, base, 1)), (5, "quite another text"), (5, "quite another text"), (5, None), (5, None), (None, varied(rng, base, 1))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, own_id string, `kept.0` int")
    got = nearjoin.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == sorted([rows[0], rows[2], (5, ""), (5, "")], key=str)


def test_only_texts_of_candidates_are_moved(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))) for k in range(400)]
    rows += [(1000 + k, t + " more") for k, t in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    moved, verified = [], nearjoin.verified

    def seen(texts, *more):
        moved.append(texts.count())
        return verified(texts, *more)

    monkeypatch.setattr(nearjoin, "verified", seen)
    got = sorted(r["doc_id"] for r in nearjoin.one_of_each(docs).collect())
    assert got == list(range(400))
    assert moved and all(10 <= n < 100 for n in moved)


@pytest.mark.parametrize("most", [1 << 27, 64])
def test_sieve_lets_all_wanted_rows_pass(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    every = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), F.concat(F.lit("x"), "id").alias("b"))
    wanted = every.where("a % 10 = 0 or a is null")
    passed = {r["b"] for r in every.where(common.sieve(wanted)("a", "b")).collect()}
    assert passed >= {r["b"] for r in wanted.collect()}
    assert len(passed) < 330 or most == 64
    assert every.where(common.sieve(wanted.where("false"))("a", "b")).count() == 0


def test_many_texts_of_one_id(spark):
    rng = random.Random(14)
    texts = [[rng.choice(["a", "b", "c", "d"]) + str(rng.randrange(999)) for _ in range(80)] for _ in range(60)]
    rows = [(7, varied(rng, t, m)) for t in texts for m in (0, 1)]
    got = [tuple(r) for r in nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(near_brute(rows)) and sum(r[2] for r in got) == 120


def test_near_duplicates_without_ids(spark):
    rng = random.Random(12)
    one, two = [f"a{k}" for k in range(150)], [f"b{k}" for k in range(150)]
    rows = [(None, varied(rng, one, 1)), (None, varied(rng, one, 1)), (None, varied(rng, two, 1)), (4, varied(rng, two, 1)), (5, "apart")]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in nearjoin.near_duplicates(docs).collect()]
    order = lambda r: str(r)
    assert sorted(got, key=order) == sorted(near_brute(rows), key=order)


def test_word_hashes_of_long_texts(monkeypatch):
    rng = random.Random(18)
    words = ["".join(rng.choice("abcé9") for _ in range(rng.choice([1, 3, 90]))) for _ in range(400)]
    text = "".join(w + rng.choice([" ", ", ", "\n"]) for w in words).encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "HASH_BYTES", 50)
    assert common.word_hashes(text).tolist() == whole.tolist() and len(whole) == 400
    assert [h for w in words for h in common.word_hashes(w.encode()).tolist()] == whole.tolist()


def test_shortest_prefix():
    d = nearjoin.shortest_prefix(0.8, 0.999)
    assert nearjoin.found(0.8, d) >= 0.999 > nearjoin.found(0.8, d + 1)
    assert nearjoin.shortest_prefix(0.99, 0.9) == nearjoin.DEPTH


def test_forest_holds_the_shared_nodes(spark):
    rng = random.Random(15)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(30)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    rows = [(str(k).encode(), nearjoin.paths(s)) for k, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "key binary, paths array<binary>").repartition(3)
    got = {(bytes(r["path"]), bytes(r["key"])): r["depth"] for r in nearjoin.forest(classes, 2).collect()}
    steps = lambda p: [p[:1], *(p[k : k + 2] for k in range(1, len(p), 2))]
    for key, own in rows:
        for path in own:
            deep = 0
            for other, theirs in rows:
                if other != key:
                    x, y = steps(path), steps(theirs[path[0]])
                    deep = max(deep, next((k for k in range(len(x)) if x[k] != y[k]), len(x)) - 1)
            if deep >= 2:
                assert got[path, key] >= deep
            assert got.get((path, key), nearjoin.DEPTH) in (deep, nearjoin.DEPTH)


def test_next_depth():
    step = lambda have, missed: nearjoin.next_depth(have, dict(zip((8, 7, 6, 5), missed, strict=True)), 8, 5, 0.999)
    assert step(900, (0, 0, 0, 0)) == 5 and step(2000, (1, 0, 0, 0)) is None
    assert step(2000, (50, 3, 1, 0)) == 6 and step(2000, (50, 30, 9, 5)) == 5


@pytest.mark.parametrize(("changed", "depth"), [(1, 8), (4, 5)])
def test_prefix_is_shortened_until_the_recall(spark, monkeypatch, changed, depth):
    """Links of high similarity are found at full depth; those near the threshold ask for shorter prefixes."""
    rng = random.Random(16)
    rows = []
    for k in range(1200):
        base = [f"{rng.randrange(10**6)}" for _ in range(190)]
        near = list(base)
        for c in range(changed):
            near[20 + 40 * c] = "x"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    depths = []
    grouped = nearjoin.grouped
    monkeypatch.setattr(nearjoin, "grouped", lambda classes, tries, d, rows: depths.append(d) or grouped(classes, tries, d, rows))
    got = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert depths[0] == nearjoin.DEPTH and depths[-1] == depth
    assert sum(r["n_links"] == 1 and r["class_id"] == r["doc_id"] // 2 * 2 for r in got) >= 0.999 * len(got)


def test_recall_at_the_threshold(spark):
    """Ten thousand pairs of a similarity of exactly 0.8: 45 shingles, 5 of them changed."""
    rng = random.Random(17)
    rows = []
    for k in range(10_000):
        base = [str(rng.randrange(10**9)) for _ in range(49)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:24], "x", *base[25:]]))]
    got = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.where("n_links = 1").count() >= 0.999 * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(common, "HOT_ROWS", 2 if seed == 2 else 100)
    edges = [(a := rng.randrange(80), (a + rng.choice([1, 2, 3])) % 100 if seed else a + 1) for _ in range(70)] + [(5, 5)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


# -- language model --------------------------------------------------------------


SMALL = gru.Shape(vocab=12, hidden=4, embed=3, singles=3, per_class=4)


def test_gradients():
    rng = np.random.default_rng(0)
    flat = rng.standard_normal(len(gru.Gru.fresh(SMALL, np.ones(12)).flat)) * 0.4
    lens = np.array([3, 0, 5, 2])
    lanes = gru.lanes_of(rng.integers(0, 12, lens.sum()).astype(np.int32), lens, 2)
    h = np.zeros((4, lanes.inputs.shape[1]))
    loss = lambda f: gru.loss_and_grads(gru.Gru(SMALL, f), lanes, 0, len(lanes.inputs), h)
    grads = loss(flat)[2].flat
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert abs((loss(flat + step)[0] - loss(flat - step)[0]) / 2e-5 - grads[k]) < 1e-4


def test_outputs_are_a_distribution_and_windows_do_not_matter():
    g = gru.Gru.fresh(SMALL, np.arange(12.0))
    hs = np.random.default_rng(1).standard_normal((1, 4)).astype(np.float32)
    logp, _ = g.outputs(np.repeat(hs, 12, 0), np.arange(12))
    assert abs(np.exp(logp).sum() - 1) < 1e-5
    g.cw *= 1e4  # beyond the range of exp
    assert np.isfinite(g.outputs(np.repeat(hs, 3, 0), np.arange(3))[0]).all()
    g = gru.Gru.fresh(SMALL, np.arange(12.0))
    lens = np.array([7, 0, 30, 2, 11])
    words = np.random.default_rng(2).integers(0, 12, lens.sum()).astype(np.int32)
    one = gru.score(g, gru.lanes_of(words, lens, 3), 5, 4)
    assert np.allclose(one, gru.score(g, gru.lanes_of(words, lens, 1), 5, 1000), atol=1e-3)


def scalar_score(g, words):
    """Natural log-likelihood of one text, a number at a time."""
    s, h, total = g.shape, [0.0] * g.shape.hidden, 0.0
    dot = lambda row, x: sum(float(a) * float(b) for a, b in zip(row, x, strict=True))
    last = gru.END
    for target in [*words, gru.END]:
        a = [dot(g.w[i], g.e[last]) + float(g.b[i]) for i in range(2 * s.hidden)]
        u = [dot(g.u[i], h) for i in range(2 * s.hidden)]
        f = [(1 + math.tanh(a[i] + u[i])) / 2 for i in range(s.hidden)]
        c = [math.tanh(a[s.hidden + i] + f[i] * u[s.hidden + i]) for i in range(s.hidden)]
        h = [x + y * (z - x) for x, y, z in zip(h, f, c, strict=True)]
        k = int(s.class_of(np.array(target)))
        each = [dot(g.cw[j], h) + float(g.cb[j]) for j in range(s.classes)]
        total += each[k] - math.log(sum(map(math.exp, each)))
        if k >= s.singles:
            m = s.members(k)
            each = [dot(g.ww[j], h) + float(g.wb[j]) for j in range(m.start, m.stop)]
            total += each[target - m.start] - math.log(sum(map(math.exp, each)))
        last = target
    return total


def test_pieces():
    assert gru.pieces(np.array([0, 5, 4, 9, 1]), 4).tolist() == [0, 4, 1, 4, 4, 4, 1, 1]


def lm_rows(rng):
    rows = [(k, " ".join(rng.choice(["the", "The", "a", "of", f"r{rng.randrange(300)}"]) for _ in range(rng.randint(0, 60))), "x") for k in range(200)]
    return rows + [(500, None, "x"), (501, "", "x"), (None, "the of", None), (3, rows[3][1], "x"), (502, "é\u3000é tab\tnl\nvt\x0bend", "x"), (503, "long " * 3000, "x")]


def test_lm_scores(spark, monkeypatch):
    rows = lm_rows(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    made = []
    learn = lmscore.trained
    monkeypatch.setattr(lmscore, "trained", lambda streams, vocab, shape: made.append((learn(streams, vocab, shape), vocab)) or made[-1][0])
    got = lmscore.lm_scores(docs, chunk_chars=900).collect()
    g, vocab = made[0]
    assert len(got) == len(rows)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), None]
    count = collections.Counter(w for d, t, _ in rows if fold(d, 7) != 2 for w in split(t))
    n, v = sum(count.values()), len(count)
    known = {w: c for w, c in count.items() if w is not None}
    best = sorted(known, key=lambda w: (-known[w], w))[: lmscore.vocabulary_size(len(known)) - 2]
    number = {w: k + 2 for k, w in enumerate(best)}
    assert len(number) < len(known) and vocab.size == g.shape.vocab == lmscore.vocabulary_size(len(known))
    other = sum(c for w, c in known.items() if w not in number) + len(known) - len(number) + 1
    text = {d: t for d, t, _ in rows}
    for r in got:
        words = split(text[r["doc_id"]])
        outside = [w for w in words[:-1] if w not in number]
        assert r["held_out"] == (fold(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["n_other"]) == (len(words), sum(count[w] > 0 for w in words), n, len(outside))
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        want = scalar_score(g, [number.get(w, 0) for w in words[:-1]]) / math.log(10) + sum(math.log10((known.get(w, 0) + 1) / other) for w in outside)
        assert math.isclose(r["score"], want, rel_tol=1e-4)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lmscore.lm_scores(docs.where("false")).collect() == []


def test_lm_counts_of_any_size():
    x = np.array([0, 7, 1 << 32, (1 << 53) + 5], np.uint64)
    assert lmscore._whole64(lmscore._split64(x)).tolist() == x.tolist()


@pytest.mark.parametrize("tokens", [50, 600_000])
def test_lm_learns_from_all_training_documents(spark, monkeypatch, tokens):
    monkeypatch.setattr(lmscore, "TOKENS_PER_ROW", tokens)
    taught = []
    learn = lmscore.trained
    monkeypatch.setattr(lmscore, "trained", lambda streams, vocab, shape: taught.extend(streams.collect()) or learn(streams, vocab, shape))
    rows = [(k, " ".join(f"w{j}" for j in range(k % 40)), "x") for k in range(120)] + [(None, "w1 w2", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lmscore.lm_scores(docs, chunk_chars=900).collect()
    learned = [len((t or "").split()) for d, t, _ in rows if fold(d, 7) != 2]
    assert sorted(n for r in taught for n in np.frombuffer(r["lens"], "<i8").tolist()) == sorted(learned)
    assert sum(r["n"] for r in taught) == sum(learned) + len(learned)
    assert all(len(r["words"]) // 2 + len(r["lens"]) // 8 == r["n"] <= tokens + 40 and 0 <= r["turn"] < 16 for r in taught)
    assert sum(lmscore.ROUNDS) == 16


# -- pipeline --------------------------------------------------------------------


def test_pipeline(spark, tmp_path, toxic_tables):
    import corpus_pipeline as cp

    docs, labels = toxic_tables
    rng = random.Random(8)
    item = " ".join(f"bench{k}" for k in range(12))
    extra = [(5000, "start " + item + " end of it all", "en", "s", 1), (5001, "write to a@b.cc for more of it", "en", "s", 1)]
    base = [f"v{rng.randrange(900)}" for _ in range(100)]
    extra += [(5100 + k, varied(rng, base, 1), "en", "s", 1) for k in range(5)]
    docs = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name != cp.STAGES[-1][0]:
            assert now.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    assert not any(d is not None and d < 600 and d % 8 == 0 for d in seen["toxicity"]) and 7 in seen["toxicity"]
    assert [d for d in seen["near_duplicates"] if d and d >= 5100] == [5100] and 5000 in seen["near_duplicates"]
    assert seen["decontamination"][5000]["text"] == "start  end of it all" and seen["decontamination"][5000]["n_chars"] == 20
    assert seen["pii"][5001]["text"] == "write to [EMAIL] for more of it"
    assert set(seen["bpe"]) == set(seen["pii"]) == set(seen["near_duplicates"])
    got = sorted((r["doc_id"] or -1, r["ids_sha256"]) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == sorted((d or -1, r["ids_sha256"]) for d, r in seen["bpe"].items())


def test_stages_carry_columns_of_any_name(spark, tmp_path, toxic_tables):
    import corpus_pipeline as cp

    _, labels = toxic_tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["more_text", "carried_0", "hushdex_text", "hushdex_null", "more_null", "predicted", "a.b", "key", "mark", "spans", "clean_text", "of_id", "stays", "rows", "n_chars"]
    ddl = "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(k, f"plain text number {k}", *range(len(names))) for k in range(3)] + [(None, None, *[None] * len(names))], ddl)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 4


def test_pipeline_on_nothing_and_on_nulls(spark, tmp_path):
    import corpus_pipeline as cp

    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, left in (([], 0), ([(None, None, None, None, None)] * 2 + [(1, None, None, None, None), (1, "", "x", "y", 0)], 4)):
        docs = spark.createDataFrame(rows, columns)
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == left, name
        assert cp.run(spark, str(tmp_path)).count() == left
