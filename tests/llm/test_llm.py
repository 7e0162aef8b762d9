"""Each operator against a brute-force version, and on the awkward tables that its docstring speaks of."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, decontaminate, html_text, jpeg_writer, language_model, line_dedup, media, quality, shared, simhash_dedup, token_counts, urls
from docloom.llm import textvec as tv
from docloom.llm.queries import BYTE_BPE
from docloom.llm.shared import shared_dir
from docloom.llm.tables import table

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __gone string"
rng = random.Random(4)
WORDS = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


LONG = prose(30_000, 99)
AWKWARD = [(None, None, None, None, None, None), (1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, " \n\t", None, None, None, None), (None, prose(60, 1), "en", "s", 1, "y"), (4, LONG, "en", "s", len(LONG), "z"), (5, prose(60, 1), "en", "s", 1, "y"), (5, prose(60, 1), "en", "s", 1, "y"), (6, prose(60, 1), "en", "s", 1, "y")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").cache()


def test_simhash(spark, awkward, empty, docs):
    assert {tuple(r) for r in simhash_dedup.duplicates(awkward)[0].collect()} == {(6, 5)}
    left = simhash_dedup.near_dedup(awkward)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD) - 1
    assert simhash_dedup.near_dedup(empty).count() == 0
    rows = docs.select("doc_id", "text").toPandas()
    f, known = simhash_dedup.fingerprints(pa.array(rows.text, pa.string()))
    ids = rows.doc_id.to_numpy()
    near = {(i, j): int(simhash_dedup.distance(f[i], f[j])) for i in range(len(ids)) for j in range(i) if known[i] and known[j]}
    want = {p: d for p, d in near.items() if d <= simhash_dedup.MAX_BITS}
    found = dict(map(tuple, simhash_dedup.duplicates(docs)[0].collect()))
    root = lambda d: found.get(d, d)
    met = {p for p in want if root(ids[p[0]]) == root(ids[p[1]])}
    assert want and all(p in met for p, d in want.items() if d <= simhash_dedup.SURE_BITS)
    apart = {p for p, d in want.items() if d}
    assert len(met & apart) >= 0.95 * len(apart)
    # nothing is joined but by a chain of near pairs
    group = list(range(len(ids)))
    for i, j in want:
        old, new = group[i], group[j]
        group = [new if g == old else g for g in group]
    assert all(group[i] == group[j] for i, j in near if root(ids[i]) == root(ids[j]))


def test_simhash_pairs_within_the_guarantee():
    """Fingerprints with up to SURE_BITS random bits flipped share a variant, and exactly one of the shared ones counts."""
    r = np.random.default_rng(3)
    f = r.integers(0, 1 << 60, (4000, simhash_dedup.WORDS), dtype=np.uint64)
    g = f.copy()
    for k in range(len(f)):
        for bit in r.choice(simhash_dedup.BITS, r.integers(0, simhash_dedup.SURE_BITS + 1), replace=False):
            g[k, bit // 60] ^= np.uint64(1) << np.uint64(bit % 60)
    n = simhash_dedup.SEGMENTS * 3
    sides = []
    for x in (f, g):
        row, keys = simhash_dedup.variants(simhash_dedup.places(x).ravel(), np.repeat(x, n, 0))
        sides.append([set() for _ in f])
        for owner, key in zip((row // n).tolist(), keys.tolist(), strict=True):
            sides[-1][owner].add(key)
    first = simhash_dedup.first_key(f, g)
    for a, b, own in zip(*sides, first.tolist(), strict=True):
        assert len(a) == simhash_dedup.BITS and [key >> 20 for key in a & b].count(own) == 1


def test_simhash_pairs_within_max_bits():
    """Every pair within MAX_BITS is found, once, and none beyond; rows that many others are near to are joined as by all pairs."""

    def edges(f):
        places, out = simhash_dedup.blocks(f), []
        for block, place in enumerate(places.T):
            for x in np.unique(place):
                rows = np.flatnonzero(place == x)
                out += zip(*(e.tolist() for e in simhash_dedup.block_edges(block, rows, f[rows])), strict=True)
        return [tuple(sorted(e)) for e in out]

    def flipped(f, least, most):
        g = f.copy()
        for k in range(len(f)):
            for bit in r.choice(simhash_dedup.BITS, r.integers(least, most + 1), replace=False):
                g[k, bit // 60] ^= np.uint64(1) << np.uint64(bit % 60)
        return g

    r, n, most = np.random.default_rng(5), 1000, simhash_dedup.MAX_BITS
    f = r.integers(0, 1 << 60, (n, simhash_dedup.WORDS), dtype=np.uint64)
    g, beyond = flipped(f, simhash_dedup.SURE_BITS + 1, most), flipped(f, most + 1, most + 2)
    found = edges(np.concatenate((f, g, beyond)))
    near = {(i, i + n) for i in range(n)} | {(i + n, i + 2 * n) for i in np.flatnonzero(simhash_dedup.distance(g, beyond) <= most)}
    assert sorted(found) == sorted(near)
    # two bits in each segment, which share no variant
    two = f[:1] ^ np.uint64(sum(3 << 20 * s for s in range(3)))
    assert int(simhash_dedup.distance(f[0], two[0])) == 24 and edges(np.concatenate((f[:1], two))) == [(0, 1)]
    # rows enough for the masks, and values that many of them have
    f = np.unique(np.concatenate((flipped(np.repeat(f[:1], 2500, 0), 1, 4), flipped(np.repeat(f[1:2], 600, 0), 15, 45), g)), axis=0)
    group = np.arange(len(f))
    for a, b in edges(f):
        group[group == group[b]] = group[a]
    whole = np.arange(len(f))
    for i in range(len(f)):
        close = np.unique(whole[simhash_dedup.distance(f, f[i]) <= most])
        whole[np.isin(whole, close)] = close[0]
    assert len(set(zip(group, whole, strict=True))) == len(set(group)) == len(set(whole))


def test_rows_of_one_id(spark):
    """A document is an id with a text: another text under the id of a copy stays."""
    a, b, c = prose(80, 300), prose(80, 301), prose(80, 302)
    rows = [(1, f"{a}\n{c}"), (2, f"{a}\n{c}"), (2, f"{b}\n{b[::-1]}"), (2, f"{b}\n{b[::-1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash_dedup.near_dedup(docs).collect())) == sorted([rows[0], *rows[2:]])
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == sorted([rows[0], *rows[2:]])
    named = spark.createDataFrame([("1", a), ("x", a), ("3", a)], "doc_id string, text string")
    assert sorted(r.doc_id for r in simhash_dedup.near_dedup(named).collect()) == sorted(r.doc_id for r in line_dedup.dedup_lines(named).collect()) == ["1", "x"]


def test_language_model(spark, awkward, empty):
    got = {(r.doc_id, r.n_tokens): r.log_prob for r in language_model.train_and_score(awkward).collect()}
    assert got[1, None] is None and got[2, 0] == 0 and got[4, 30_000] < 0
    assert language_model.train_and_score(empty).count() == 0
    large = table(spark, "/root/testdata/sf0.1", "documents")
    words, counts = language_model.vocabulary(large.select("text"))
    tokens = language_model.encoded(large, words).cache()
    held = F.col("doc_id") % 50 == 0
    model = language_model.train(tokens.where(~held), counts)
    some = [np.frombuffer(r.tokens, np.int16).astype(np.int64) for r in tokens.where(held).collect()]
    flat, at = np.concatenate(some), np.concatenate(([0], np.cumsum([len(x) for x in some])))
    context = language_model.contexts(flat, at, model.size)
    p = model.log_probs(context, flat)
    assert len(counts) == language_model.VOCABULARY and p.mean() > np.log((counts / counts.sum())[flat]).mean() + 0.1
    for x in context[:4]:
        assert np.isclose(np.exp(model.log_probs(np.repeat(x[None], len(counts), 0), np.arange(len(counts))).astype(float)).sum(), 1, atol=1e-4)
    scored = {r.doc_id: r.log_prob for r in language_model.scores(tokens.where(held), model).collect()}
    assert np.isclose(sum(scored.values()), p.sum(dtype=np.float64), rtol=1e-4)


def test_normalised_scores():
    """The two products of matrices give the softmax over classes times that over the class's tokens, whatever the size of the scores."""
    r = np.random.default_rng(8)
    model = language_model.Model.start(r.integers(0, 9, 700))
    for scale in (1, 60):
        model.classes, model.after = (scale * r.normal(0, 1, x.shape).astype(np.float32) for x in (model.classes, model.after))
        context, token = r.integers(0, 701, (300, language_model.CONTEXT)), r.choice(np.flatnonzero(model.counts[:700]), 300)
        q = model.predicted(context).astype(float)
        soft = lambda x: x - np.logaddexp.reduce(x, axis=-1)[..., None]
        of_class = soft(q @ model.classes.T.astype(float) + model.class_bias)
        inside = soft((q @ model.after.T.astype(float) + model.bias).reshape(300, -1, language_model.MEMBERS))
        want = of_class[np.arange(300), token // language_model.MEMBERS] + inside.reshape(300, -1)[np.arange(300), token]
        assert np.allclose(model.log_probs(context, token), want, rtol=1e-4, atol=1e-3)


def test_training_learns_contexts():
    """Where each token names its next, a model learns it: the gradient steps are those of the method."""
    r = np.random.default_rng(4)
    step = r.permutation(300)
    token = np.empty(120_000, np.int64)
    token[0] = 0
    noise = r.integers(0, 300, len(token))
    use = r.random(len(token)) < 0.1
    for i in range(1, len(token)):
        token[i] = noise[i] if use[i] else step[token[i - 1]]
    counts = np.bincount(token, minlength=300)
    trainer = language_model.Trainer(language_model.Model.start(counts), 1)
    context = language_model.contexts(token, np.array([0, len(token)]), 300)
    for _ in range(3):
        trainer.learn(context, token)
    assert trainer.m.log_probs(context, token).mean() > np.log(counts / counts.sum())[token].mean() + 1.5


def test_gibberish_scores_low(spark):
    """Words that nobody else uses are less probable than those of the corpus, though many documents are made of such words."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    r = random.Random(6)
    junk = spark.createDataFrame([(10_000_000 + i, " ".join(f"{r.getrandbits(36):09x}" for _ in range(200))) for i in range(100)], "doc_id long, text string")
    got = language_model.train_and_score(docs.unionByName(junk)).where("n_tokens > 20").toPandas()
    is_junk = got.doc_id >= 10_000_000
    assert got[is_junk].mean_log_prob.max() < got[~is_junk].mean_log_prob.quantile(0.05)


def test_rare_words(spark, monkeypatch):
    """The probabilities of all words of the corpus add up to 1, wherever their shares come from."""
    words = {f"{chr(97 + i % 7)}w{i}": 1 + i % 3 for i in range(3000)}
    rows = [(i, w) for i, (w, n) in enumerate(words.items()) for _ in range(n)] + [(5000, "hw7 hw8"), (5001, None), (None, "cw9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for own in (language_model.VOCABULARY, language_model.RARE + 500):
        monkeypatch.setattr(language_model, "VOCABULARY", own)
        sums = []
        for most in (1 << 20, 1500, 0):
            got = language_model.train_and_score(docs, most).collect()
            assert len(got) == len(rows)
            p = {r.doc_id: r.log_prob for r in got}
            assert np.isclose(sum(np.exp(p[i]) for i in range(3000)), 1, atol=3e-3)
            assert np.isclose(p[None], p[9]) and p[5001] is None
            sums.append(np.array([p[i] for i in range(3000)]))
        assert np.allclose(sums[0], sums[1], atol=1e-3) and np.allclose(sums[0], sums[2], atol=1e-3)


def test_urls(spark):
    listed = spark.createDataFrame([("a.com/",), ("b.com/x",), (None,), ("",), ("b.com/x",), ("b.com/x/",)], "entry string")
    cases = {"http://WWW.A.com:80/q?utm_source=1#f": "a.com/", "https://m.a.com": "a.com/", "http://b.com/x/": "b.com/x/", "http://b.com/x/y?z=1": "b.com/x/", "http://b.com/xy": None, "nohost": None, None: None, "": None, "http://c.com/a.com/": None}
    pages = spark.createDataFrame([(i, u, "e") for i, u in enumerate(cases)] + [(0, "http://WWW.A.com:80/q?utm_source=1#f", "e")], "page_id long, url string, entry string")
    got = urls.judged(pages, listed).collect()
    assert len(got) == len(cases) + 1 and {r.url: r.entry for r in got} == cases
    assert {r.url for r in urls.allowed(pages, listed).collect()} == {u for u, e in cases.items() if e is None}
    assert urls.judged(pages.limit(0), listed).count() == 0 and urls.allowed(pages, listed.limit(0)).count() == len(cases) + 1
    clash = pages.withColumn("__gone", F.lit("mine"))
    assert urls.allowed(clash, listed).columns == clash.columns and {r["__gone"] for r in urls.allowed(clash, listed).collect()} == {"mine"}
    long = spark.createDataFrame([(1, "http://a.com/" + "x/" * 3000), (2, "http://d.com/" + "x" * 50_000)], "page_id long, url string")
    assert {r.page_id: r.entry for r in urls.judged(long, listed).collect()} == {1: "a.com/", 2: None}
    bloom, h = urls.BlockedBloom(2000), np.random.default_rng(1).integers(-(2**63), 2**63, 12_000)
    bloom.add(h[:2000])
    assert bloom.may_have(h[:2000]).all() and bloom.may_have(h[2000:]).mean() < 0.02


def test_quality(spark, awkward, empty):
    labels = table(spark, DATA, "labels")
    assert quality.kept(awkward, labels.limit(0))[0].count() == len(AWKWARD) and quality.kept(empty, labels)[0].count() == 0
    assert quality.kept(awkward, labels)[0].where("text is null").count() == 2
    big = "/root/testdata/sf0.1"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    model = quality.fitted(docs, labels)
    marked = docs.join(quality.preferences(labels).where("part = 1").select("doc_id", "good"), "doc_id").select("good", "text").toPandas()
    score = model.scores(pa.array(marked.text))
    good, bad = score[marked.good], score[~marked.good]
    assert (good[:, None] > bad).mean() > 0.9


def test_quality_threshold(spark):
    """The threshold is the quantile of the preferred documents that did not fit, and what is under it goes; columns of the caller stay."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    clash = docs.withColumn("__score", F.lit(-7.0)).withColumn("__threshold", F.lit("mine"))
    found, score, limit = quality.kept(clash, labels, 30)
    assert {score, limit} == {"___score", "___threshold"}
    rows = found.collect()
    assert {(r["__score"], r["__threshold"]) for r in rows} == {(-7.0, "mine")}
    fit = {r.doc_id for r in quality.to_fit(labels, 30).collect()}
    model = quality.fitted(docs, labels, 30)
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = dict(zip(texts, (np.round(model.scores(pa.array(texts.values())) / quality.GRID) * quality.GRID).tolist(), strict=True))
    good = {r.doc_id for r in quality.preferences(labels).where("good").collect()} & set(texts)
    ranked = np.sort([scores[i] for i in good - fit])
    least = ranked[int(np.floor(quality.QUANTILE * len(ranked)))]
    assert len(fit) == 30 and all(abs(r[limit] - least) < 1e-9 for r in rows)
    assert {r.doc_id for r in rows} == {i for i, x in scores.items() if x >= least - quality.GRID / 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_quality_is_bradley_terry(spark):
    """On a small sample the fitted scores are as likely as those of plain gradient descent over all pairs of preferred and other documents."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    marked = docs.join(quality.preferences(labels).select("doc_id", "good"), "doc_id").select("text", "good").toPandas()
    model = quality.fitted(docs, labels, 10_000)
    part = docs.join(quality.to_fit(labels, 10_000).select("doc_id", "good"), "doc_id").select("text", "good").toPandas()
    texts = pa.array(part.text)
    data, offsets = tv.flat(texts)
    h, doc, _, _ = quality.terms_of(*tv.flat(pa.compute.utf8_lower(texts)))
    x = (quality.dense_of(data, offsets, h, doc) - model.mean) / model.scale
    good = part.good.to_numpy()
    loss = lambda s: np.logaddexp(0, s[~good] - s[good][:, None]).mean()
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        s = x @ w
        miss = 1 / (1 + np.exp(np.clip(s[good][:, None] - s[~good], -30, 30)))
        pull = np.zeros(len(s))
        pull[good], pull[~good] = miss.sum(1), -miss.sum(0)
        w += 0.3 * (x.T @ pull / miss.size - 3e-4 * w)
    assert loss(model.scores(texts)) <= loss(x @ w) + 0.02 and len(marked) > len(part)


def lcs(a: list, b: list) -> int:
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_html(spark):
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in "ab")
        at = html_text.common(a, b)
        rest = iter(b)
        assert len(at) == lcs(a, b) and at == sorted(set(at)) and all(a[i] in rest for i in at)
    page = lambda nav, body: f"<head><title>t</title></head><script>x</script><ul>{nav}</ul><!-- c --><p>{body}</p><footer>foot {nav[-3:]}</footer>"
    one, two = "<li>home menu<li>news menu", "<li>shop menu<li>cart menu"
    rows = [(i, f"http://h.com/p/{i}", page((one, two)[i % 2], prose(30, 10 + i))) for i in range(8)]
    rows += [(20, None, page(one, "a b")), (21, "http://h.com/null", None), (22, "http://h.com/e", ""), (None, "http://solo.com/", page(one, "c d")), rows[0]]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(8):
        assert by[i].text == prose(30, 10 + i) and by[i].n_deleted == 3 and by[i].pair_id % 2 == i % 2
    assert by[21].text is None and by[22].text == "" and by[20].n_deleted == by[None].n_deleted == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_lines():
    cases = {
        "<html><head><title>t</title><body><p>Real article": ["Real article"],
        "<html><head><title>t</title><script>var a='<p>'</script><p>Real": ["Real"],
        "<head><title>t</title>": [],
        "<p>before</p><svg viewBox='0 0 1 1'/><p>after": ["before", "after"],
        "<p>before</p><svg><path d='1'/><text>x</text></svg><p>after": ["before", "after"],
        "<p>before<svg width='1'><p>after": ["before", "after"],
        "<p>a<script>if (b < c) {": ["a"],
        "<noscript>x</noscript><header>h</header> a <!-- b": ["h", "a"],
        "&amp;lt; &eacute;": ["&lt; é"],
    }
    assert {page: html_text.lines_of(page) for page in cases} == cases
    assert html_text.lines_of("<p>" + LONG + "<br>" * 1000) == [LONG]


def test_html_thin_pages(spark):
    """Pages that are nearly all menu lose it, copies of one page in a larger host stay whole."""
    menu = "".join(f"<li>menu line {k} of the host" for k in range(20))
    rows = [(i, f"http://thin.com/p/{i}", f"<ul>{menu}</ul><p>own line {i}") for i in range(6)]
    same = f"<p>{prose(30, 900)}<p>{prose(30, 901)}"
    rows += [(10 + i, f"http://big.com/{i:02}", same if i % 4 == 1 else f"<p>{prose(30, 910 + i)}<div>the foot of all pages") for i in range(20)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(6)] == [f"own line {i}" for i in range(6)] and all(got[i].n_deleted == 20 for i in range(6))
    assert all(got[10 + i].n_deleted == (0 if i % 4 == 1 else 1) for i in range(20))


def test_html_copies(spark):
    """A stub finds the template that is most of its text, and copies in a row find the page after them."""
    frame = lambda name, body: f"<ul><li>{name} home of the menu<li>{name} news of the menu</ul><p>{body}</p><div>{name} advertisement</div><footer>{name} terms of use</footer>"
    same = prose(40, 700)
    bodies = [prose(60, 600), "a stub", prose(60, 601), same, same, same, same, same, prose(60, 602)]
    rows = [(i, f"http://h.com/p/{i}", frame("one", b)) for i, b in enumerate(bodies)]
    alone = [(20 + i, f"http://copies.com/{i}", frame("two", prose(40, 701))) for i in range(5)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows + alone, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(9)] == bodies and all(got[i].n_deleted == 4 for i in range(9))
    assert got[4].pair_id in (2, 8) and got[5].pair_id in (2, 8)
    assert all(got[r[0]].pair_id is None and got[r[0]].n_deleted == 0 for r in alone)


def test_html_writes_little(spark, monkeypatch):
    """The lines of a page are written once and links one way, and what is read no more is deleted before the end."""
    rows, left = {}, []

    def cut(df, name, keep=False):
        out = shared.cut(df, name, keep)
        rows.setdefault(name, []).append(out[0].count())
        if name == "page-lines":
            assert [c for c, kind in out[0].dtypes if kind.startswith("array")] == ["hashes", "sizes"]
        if name == "shared-lines":
            left.extend(x.name for x in Path(shared_dir(spark).removeprefix("file://")).iterdir())
        return out

    monkeypatch.setattr(html_text, "cut", cut)
    body = [f"<p>{prose(30, 700 + i)}</p>" for i in range(8)]
    pages = [(i, f"http://h/{i:02}", "<p>menu</p>" + "".join(f"<p>{x} {i // 8}</p>" for x in ("one", "two", "three")) + body[min(i, 7)]) for i in range(16)]
    html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows["links"]) > 1 and rows["links"][0] < rows["page-keys"][0]
    assert not [x for x in left if "host-lines" in x or "page-keys" in x]


def test_token_counts(spark, awkward, empty, tmp_path):
    enc, cache = token_counts.encoding(BYTE_BPE), f"file://{tmp_path}/cache"
    want = sorted((r[0] or 0, -1 if r[1] is None else len(enc.encode_ordinary(r[1].rstrip(" \t\n")))) for r in AWKWARD)
    for was in (False, True):
        got = token_counts.counts(awkward, BYTE_BPE, cache).collect()
        assert sorted((r.doc_id or 0, -1 if r.n_tokens is None else r.n_tokens) for r in got) == want
        assert {r.was_stored for r in got} == {None, was}
    assert spark.read.parquet(cache).count() == 3
    assert token_counts.counts(empty, BYTE_BPE, cache).count() == 0


def test_media(spark):
    r = np.random.default_rng(0)
    files, want = [None, b"", b"\xff\xd8", b"GIF89a"], ["null", "not_jpeg", "corrupt", "not_jpeg"]
    thumbs = []
    for k in range(60):
        w, h = (int(x) for x in r.integers(1, 90, 2))
        sampling = [((1, 1),), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))][k % 3]
        across, down = -(-w // (8 * sampling[0][0])), -(-h // (8 * sampling[0][1]))
        planes = [[[int(r.integers(-128, 128)), *(r.integers(-300, 300, 40) * (r.random(40) < 0.3)).tolist()] for _ in range(across * a * down * b)] for a, b in sampling]
        files.append(jpeg_writer.write(w, h, planes, sampling, restart=k % 4, comment=b"\xff\xd8"))
        grid = np.array([b[0] for b in planes[0]]).reshape(down * sampling[0][1], -1)[: -(-h // 8), : -(-w // 8)]
        thumbs.append((w, h, np.clip(grid + 128, 0, 255).astype(np.uint8).tobytes()))
    files += [files[4][:-30], jpeg_writer.write(8, 8, [[[1]]], sof=0xC2), files[5]]
    df = spark.createDataFrame([(i, f, "w") for i, f in enumerate(files)], "vec_id long, image binary, width string")
    got = {x.vec_id: x for x in media.media_columns(df, "vec_id", "image").collect()}
    assert [got[i].status for i in range(4)] == want
    assert [(got[i].width, got[i].height, bytes(got[i].thumb)) for i in range(4, 64)] == thumbs
    assert [got[i].status for i in (64, 65, 66)] == ["corrupt", "unsupported", "ok"] and got[66].thumb_digest == got[5].thumb_digest
    for k in range(300):
        broken = bytearray(files[4 + k % 60])
        broken[int(r.integers(len(broken)))] = int(r.integers(256))
        media.read([bytes(broken)])
    assert media.media_columns(df.limit(0), "vec_id", "image").count() == 0


def test_media_of_another_writer(spark):
    """Pictures that the JVM's library writes (colour with subsampling, and grey): block means are those of its own reader."""
    jvm = spark._jvm
    io, image = jvm.javax.imageio.ImageIO, jvm.java.awt.image.BufferedImage
    for kind, w, h in ((1, 70, 41), (10, 33, 24)):
        picture = image(w, h, kind)
        for y in range(h):
            for x in range(w):
                v = int(128 + 70 * np.sin(x / 9) + 50 * np.cos(y / 7 + x / 20))
                picture.setRGB(x, y, (v << 16 | (255 - v) << 8 | v // 2) if kind == 1 else v * 0x10101)
        out = jvm.java.io.ByteArrayOutputStream()
        assert io.write(picture, "jpg", out)
        raw = bytes(out.toByteArray())
        back = io.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
        if kind == 1:
            rgb = np.array([[back.getRGB(x, y) for x in range(w)] for y in range(h)])
            grey = ((rgb[..., None] >> np.array([16, 8, 0])) & 255) @ np.array([0.299, 0.587, 0.114])
        else:
            raster = back.getRaster()  # getRGB would convert the grey values to another curve
            grey = np.array([[raster.getSample(x, y, 0) for x in range(w)] for y in range(h)])
        got = media.read([raw])[0]
        thumb = np.frombuffer(got[6], np.uint8).reshape(got[5], got[4])
        down, across = h // 8, w // 8
        means = grey[: down * 8, : across * 8].reshape(down, 8, across, 8).mean((1, 3))
        assert got[:4] == ("ok", w, h, 3 if kind == 1 else 1) and thumb.shape == (-(-h // 8), -(-w // 8))
        assert np.abs(thumb[:down, :across] - means).max() < 2


def test_media_tables_of_several_symbols(monkeypatch):
    """Stepping over several symbols at a time gives what one at a time gives, with restarts and without."""
    r = np.random.default_rng(5)
    planes = [[[int(r.integers(-100, 100)), *(r.integers(-40, 40, 63) * (r.random(63) < 0.4)).tolist()] for _ in range(600)]]
    files = [jpeg_writer.write(30 * 8, 20 * 8, planes, restart=k) for k in (0, 7)]
    slow = media.read(files)
    monkeypatch.setattr(media, "LONG_SCAN", 0)
    assert media.read(files) == slow and slow[0][0] == "ok" and slow[0][6] == slow[1][6]


def test_bpe(spark, awkward, empty, docs):
    enc, own = token_counts.encoding(BYTE_BPE), bpe.coder(BYTE_BPE)
    assert isinstance(enc, tiktoken.Encoding)
    texts = [r.text for r in docs.collect()] + ["a" * 5000, "<|endoftext|>", "\x00é😀 \n\n  x", "".join(map(chr, range(1, 3000)))]
    for t in texts:
        assert list(own.encode(t)) == enc.encode_ordinary(t)
    got = bpe.encode(awkward, BYTE_BPE)
    assert got.count() == len(AWKWARD) and got.where("round_trip = false").count() == 0
    back = bpe.decode(got, BYTE_BPE).collect()
    assert sorted(r.text or "" for r in back) == sorted(r[1] or "" for r in AWKWARD)
    assert bpe.encode(empty, BYTE_BPE).count() == 0
    smile = list(own.encode("a😀"))
    assert own.decode(smile[:-1]).startswith("a\ufffd") and own.decode([10**9]) is None
    odd = spark.createDataFrame([(1, smile[:-1]), (2, [10**9]), (3, [None]), (4, None), (5, [])], "doc_id long, tokens array<int>")
    assert [r.text for r in bpe.decode(odd, BYTE_BPE).orderBy("doc_id").collect()] == [own.decode(smile[:-1]), None, None, None, ""]


def encoded_rows(texts: list[str | None]) -> list[dict]:
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for b in bpe._rows(BYTE_BPE)(iter([batch])) for r in b.to_pylist()]


def test_bpe_merges_short_pieces_side_by_side(monkeypatch):
    own_rng = random.Random(8)
    one_by_one, merge = [], bpe.Coder.merge
    monkeypatch.setattr(bpe.Coder, "merge", lambda self, raw: one_by_one.append(raw) or merge(self, raw))
    long = "xyzzy" * 13
    texts = [" ".join("".join(own_rng.choices("abcdeéñ", k=own_rng.randint(1, 30))) for _ in range(3000)), f"a {long} b", f"{long} {long}"]
    enc = token_counts.encoding(BYTE_BPE)
    assert [(r["tokens"], r["round_trip"]) for r in encoded_rows(texts)] == [(enc.encode_ordinary(t), True) for t in texts]
    assert sorted(one_by_one) == [f" {long}".encode(), long.encode()]


def test_bpe_batches(monkeypatch):
    enc, own, own_rng = token_counts.encoding(BYTE_BPE), bpe.coder(BYTE_BPE), random.Random(9)
    signs = [*"aZ9 '\n\t\r\x00\x1c\x85\xa0éß中😀\u3000\u0301٣Ⅷ²!-.sdmtlvreS", "'s", "'ll", "'re", "'ve", " '", "  ", "the", " of"]
    texts = [None, "", *("".join(own_rng.choices(signs, k=own_rng.choice((1, 2, 3, 9, 200)))) for _ in range(400)), "", None]
    for stretch in (bpe.STRETCH, 50):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        for t, r in zip(texts, encoded_rows(texts), strict=True):
            want = None if t is None else enc.encode_ordinary(t)
            assert (r["tokens"], r["n_tokens"], r["round_trip"]) == ((None, None, None) if t is None else (want, len(want), True))
    data, offsets = bpe.tv.flat(pa.array(["one two", "", "three"]))
    tokens, numbers = own.encode_all(data, offsets)
    tokens[-1] += 1
    assert own.same(tokens, numbers, data, offsets).tolist() == [True, True, False]
    for size in (7, 8, 9, 32, 33, 64, 65):
        for t in ("a" * size, "".join(own_rng.choices("aetnos", k=size)), "\x00" * size):
            assert own.encode(t) == enc.encode_ordinary(t)


def test_decontaminate(spark, awkward, empty):
    item = prose(40, 500)
    w = item.split()
    w[7] = w[20] = w[33] = "zzz"
    rows = [*AWKWARD, (50, prose(200, 51) + " " + " ".join(w) + " " + prose(9, 52), "en", "s", 1, "x"), (51, prose(300, 53), "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "too short"), (1, item)], "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        assert [(r.doc_id, r.item_id) for r in decontaminate.overlaps_with(docs, bench, most).collect()] == [(50, 1)]
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 1
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.decontaminate(awkward, bench.limit(0)).count() == len(AWKWARD)


def brute_overlaps(docs, items) -> set[tuple[int, int, int]]:
    """(doc_id, item_id, equal words of the best window) of every pair that overlaps, all alignments laid over each other."""
    need = lambda m: m if m < decontaminate.SHORTEST else int(np.ceil(0.8 * min(m, 12) - 1e-9))
    words = lambda t: np.array(re.findall(r"[^\W_]+", t.lower()) or [""])
    found = set()
    for item_id, text in items:
        b = words(text)
        m, width = len(b), min(len(b), 12)
        if m < decontaminate.LEAST:
            continue
        for doc_id, a in docs:
            eq = np.zeros((len(a) + 2 * m, m), np.int64)
            eq[m : m + len(a)] = a[:, None] == b
            # one row for each shift: the words of the item against those of the document from there on
            lines = np.lib.stride_tricks.as_strided(eq, (len(a) + m, m), (eq.strides[0], eq.strides[0] + eq.strides[1]))
            run = np.concatenate((np.zeros((len(lines), 1), np.int64), lines.cumsum(1)), 1)
            best = (run[:, width:] - run[:, :-width]).max()
            if best >= need(m):
                found.add((doc_id, item_id, int(best)))
    return found


def test_decontaminate_against_all_alignments(spark, docs):
    """Both ways of finding seeds give what laying all items over all documents gives."""
    bench = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").limit(40).collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    longest = max(texts.values(), key=len).split()
    bench += [(900, " ".join(longest[50:55])), (901, " ".join(longest[80:87])), (902, " ".join([*longest[110:114], "qqq", *longest[115:119]])), (903, " ".join(longest[7:11])), (904, "one two"), (905, " ".join([*longest[60:63], "qqq", *longest[64:66]]))]
    split = [(d, np.array(re.findall(r"[^\W_]+", t.lower()) or [""])) for d, t in texts.items()]
    want = brute_overlaps(split, bench)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        assert {(r.doc_id, r.item_id, r.matches) for r in decontaminate.overlaps_with(docs, frame, most).collect()} == want
    assert {i for _, i, _ in want} & {900, 901, 902} == {900, 901, 902} and not {903, 904, 905} & {i for _, i, _ in want}


def test_smallest_benchmark(spark):
    """One item of the least length is found on both paths, and another text of the same doc_id stays."""
    for n in (decontaminate.LEAST, decontaminate.SHORTEST):
        item = prose(n, 800)
        rows = [(1, f"{prose(30, 801)} {item} {prose(30, 802)}"), (2, prose(60, 803)), (1, prose(60, 804))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        for most in (decontaminate.BROADCAST_SEEDS, 0):
            assert [(r.doc_id, r.item_id) for r in decontaminate.overlaps_with(docs, bench, most).collect()] == [(1, 1)]
            assert sorted(map(tuple, decontaminate.decontaminate(docs, bench, most).collect())) == sorted(rows[1:])


def test_lines(spark, awkward, empty):
    line = prose(20, 7)
    near = line + " it"
    rows = [(1, f"{prose(20, 8)}\n{line}\nshort", "en", "s", 1, "x"), (2, f"{near}\n{prose(20, 9)}", "en", "s", 1, "x"), (3, line.upper(), "en", "s", 1, "x"), (4, None, None, None, None, None), (5, "", "en", "s", 0, "x"), (None, line, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in line_dedup.duplicate_lines(docs)[0].collect()} == {(2, 0, 1, 1), (3, 0, 1, 1)}
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: rows[0][1], 2: prose(20, 9), 4: None, 5: "", None: line}
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(awkward).where("doc_id = 6").count() == 0


def brute_lines(docs) -> tuple[dict[bytes, tuple[int, int]], set[tuple[bytes, bytes]]]:
    """The first place of each distinct line, and every pair of lines that are similar enough."""
    first: dict[bytes, tuple[int, int]] = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        for i, x in enumerate((r.text or "").split("\n")):
            if y := x.lower().strip().encode():
                first.setdefault(y, (r.doc_id, i))
    grams = lambda x, n: {x[i : i + n] for i in range(len(x) - n + 1)}
    lines, pairs = sorted(first, key=len), set()
    sets = {n: [grams(x, n) for x in lines] for n in (4, 8)}
    for i, x in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if len(x) < line_dedup.LONG and len(lines[j]) >= line_dedup.NEAR:
                break
            a, b = (sets[4 if len(x) < line_dedup.LONG else 8][k] for k in (i, j))
            if a and b and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and (c := len(a & b)) >= 0.7 * (len(a) + len(b) - c):
                pairs.add((x, lines[j]))
    return first, pairs


def test_lines_against_all_pairs(spark, docs):
    """All pairs of lines, by exact Jaccard similarity: no similar pair is lost, none else is joined, and split bands give the same."""
    first, pairs = brute_lines(docs.collect())
    found = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.duplicate_lines(docs)[0].collect()}
    root = lambda x: found.get(first[x], first[x])
    assert pairs and sum(root(x) == root(y) for x, y in pairs) >= 0.96 * len(pairs)
    group = {x: x for x in first}
    for x, y in pairs:
        old, new = group[x], group[y]
        group = {k: new if g == old else g for k, g in group.items()}
    by_root: dict = {}
    for x in first:
        by_root.setdefault(root(x), set()).add(group[x])
    assert all(len(g) == 1 for g in by_root.values())


def test_hot_band(spark):
    """Hundreds of lines in one band, like each other or not, are judged the same whether the band is split or not."""
    r = random.Random(12)
    like = [f"the page {i} of the report on the state of the forests in {i}" for i in range(300)]
    other = [" ".join(r.choices(WORDS, k=9)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(like + other)], "doc_id long, text string")
    whole, split = (sorted(map(tuple, line_dedup.duplicate_lines(docs, hot)[0].collect())) for hot in (line_dedup.HOT, 20))
    assert whole == split and len(whole) >= 299
    text = pa.array(like + other)
    a, b = line_dedup.bucket_edges(text, np.zeros(600, np.int64), np.array([0, 600]))
    pairs = brute_lines([type("R", (), {"doc_id": i, "text": t}) for i, t in enumerate(like + other)])[1]
    group = list(range(600))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        old, new = group[i], group[j]
        group = [new if g == old else g for g in group]
    at = {t.encode(): i for i, t in enumerate(like + other)}
    assert all(group[at[x]] == group[at[y]] for x, y in pairs)


def test_bands_are_packed(monkeypatch):
    """A task sends one row for a part of the keys; the bands of several lines come out whole, large ones as they come, whatever is held at once."""
    texts = pa.array([prose(12, 2000 + i) for i in range(3000)])
    sent = list(line_dedup._band_rows(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert sum(b.num_rows for b in sent) <= line_dedup.PARTS < 3000 * line_dedup.BANDS
    assert sum(len(x.as_buffer()) // 16 for b in sent for x in b.column("pairs")) >= 3000 * line_dedup.BANDS
    r = np.random.default_rng(8)
    key = np.concatenate((r.integers(0, 1 << 40, 400)[r.integers(0, 400, 900)], np.full(3000, 5), r.integers(-(1 << 62), 1 << 62, 300)))
    line = np.concatenate((r.integers(0, 1 << 60, 900), r.integers(0, 1500, 3000), r.integers(0, 1 << 60, 300)))
    pairs = np.stack((key, line), 1)[r.permutation(len(key))]
    want: dict[int, set] = {}
    for k, x in pairs.tolist():
        want.setdefault(k, set()).add(x)
    packed = [b for x in np.array_split(pairs, 30) for b in line_dedup._packed([x])]
    rows = sorted((x for b in packed for x in b.to_pylist()), key=lambda x: x["part"])
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("pairs", pa.binary())]))
    for held, whole in ((1 << 20, 4096), (100, 50), (100, 4096)):
        monkeypatch.setattr(line_dedup, "HELD", held)
        monkeypatch.setattr(line_dedup, "WHOLE", whole)
        got: dict[int, set] = {}
        for b in line_dedup._crowded_rows(iter([batch])):
            for x in b.to_pylist():
                got.setdefault(x["key"], set()).add(x["line"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_long_texts_hash_apart():
    a, b = "a" * 65536, "b" * 65536
    for h in tv.text_hashes(*tv.flat(pa.array([a + b, b + a, a + b, a, ""]))):
        assert len(set(h.tolist())) == 4 and h[0] == h[2]


def test_short_lines(spark):
    """Repeats of any length go, near copies as far as there are shingles; white space is no line."""
    rows = [(1, "a\nmenu of the site\n \n", None), (2, "Menu of the site \nb\n \n", None), (3, "a\nthe terms of use of this site\n", None), (4, "é\nthe terms of use of this site.\né", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in line_dedup.duplicate_lines(docs)[0].collect()} == {(2, 0, 1, 1), (3, 0, 1, 0), (4, 1, 3, 1), (4, 2, 4, 0)}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: rows[0][1], 2: "b\n \n", 3: "the terms of use of this site\n", 4: "é"}


def test_edited_lines(spark):
    """One character changed inside a line of 40 to 62, or one word of twelve: near copies; other lines stay."""
    r, texts, edited = random.Random(9), [], []
    for k in range(80):
        words = r.choices(WORDS, k=12)
        while k % 2 and len(" ".join(words)) > 62:
            words.pop()
        new = list(words)
        new[len(words) // 2] = "7" + new[len(words) // 2][1:] if k % 2 else "xyzuvw"
        texts.append(" ".join(words))
        edited.append(" ".join(new))
    found = line_dedup.duplicate_lines(spark.createDataFrame([(1, "\n".join(texts)), (2, "\n".join(edited))], "doc_id long, text string"))[0].collect()
    assert all(tuple(x) == (2, x.line_no, 1, x.line_no) for x in found)
    assert sum(x.line_no % 2 == 0 for x in found) >= 36 and sum(x.line_no % 2 for x in found) >= 36


def joined(n: int, pairs) -> list[int]:
    """The least member of each one's component."""
    group = list(range(n))
    for i, j in pairs:
        a, b = sorted((group[i], group[j]))
        group = [a if g == b else g for g in group]
    return group


def test_pipeline_by_brute_force(spark, docs):
    """What `run` gives is what the stages give text by text: all scores, all pairs of lines, of fingerprints, and of documents and items."""
    labels = table(spark, DATA, "labels")
    texts = dict(sorted((r.doc_id, r.text) for r in docs.collect()))
    model = quality.fitted(docs, labels)
    score = {i: np.round(model.scores(pa.array([t]))[0] / quality.GRID) * quality.GRID for i, t in texts.items()}
    fit = {r.doc_id for r in quality.to_fit(labels).collect()}
    ranked = np.sort([score[r.doc_id] for r in quality.preferences(labels).where("good").collect() if r.doc_id in texts and r.doc_id not in fit])
    least = ranked[int(np.floor(quality.QUANTILE * len(ranked)))]
    texts = {i: t for i, t in texts.items() if score[i] >= least - quality.GRID / 2}
    # lines
    Row = type("Row", (), {"__init__": lambda self, i, t: self.__dict__.update(doc_id=i, text=t)})
    first, pairs = brute_lines([Row(i, t) for i, t in texts.items()])
    order = {x: n for n, x in enumerate(sorted(first, key=first.get))}
    group = joined(len(order), [(order[x], order[y]) for x, y in pairs])
    met, left = set(), {}
    for i, t in texts.items():
        out, lost = [], False
        for x in t.split("\n"):
            key = x.lower().strip().encode()
            if key and group[order[key]] in met:
                lost = True
                continue
            if key:
                met.add(group[order[key]])
            out.append(x)
        if not lost or "\n".join(out).strip():
            left[i] = "\n".join(out)
    # documents
    ids = list(left)
    f, known = simhash_dedup.fingerprints(pa.array([left[i] for i in ids]))
    group = joined(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if known[a] and known[b] and simhash_dedup.distance(f[a], f[b]) <= simhash_dedup.MAX_BITS])
    left = {i: left[i] for n, i in enumerate(ids) if group[n] == n}
    split = [(i, np.array(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) or [""])) for i, t in left.items()]
    gone = {d for d, _, _ in brute_overlaps(split, [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()])}
    enc = token_counts.encoding(BYTE_BPE)
    want = {i: enc.encode_ordinary(t) for i, t in left.items() if i not in gone}
    got = {r.doc_id: list(r.tokens) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and gone and 0 < len(want) < docs.count()


def test_pipeline_awkward(spark, awkward, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, DATA).count() == 0
        assert stage(spark, awkward, DATA).columns == awkward.columns
        stage(spark, awkward, DATA).count()
    assert corpus_pipeline.STAGES[-1][1](spark, awkward, DATA).count() == len(AWKWARD)


def test_nothing_is_left_behind(spark, docs):
    """Tables between the steps of an operator are deleted when it is done."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    for made in (lambda: line_dedup.dedup_lines(docs), lambda: simhash_dedup.near_dedup(docs), lambda: decontaminate.decontaminate(docs, table(spark, DATA, "benchmark"), 0), lambda: html_text.main_text(table(spark, DATA, "pages"))):
        before = set(folder.iterdir())
        df = made()
        assert len(set(folder.iterdir()) - before) <= 2 and df.count() > 0
