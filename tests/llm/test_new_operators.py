"""Pivot-table clustering, spelling variants and page text: brute-force comparisons, odd rows, empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.llm import page_blocks, page_examples, page_text, pivot_clusters, spelling

VECTOR = "vec_id long, embedding array<float>, label int, cluster int, n_exact int, v string, p int"


def vector_rows():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 64))
    rows = [(k, (middle[k % 20] + 0.3 * rng.normal(size=64)).tolist(), 1) for k in range(400)]
    rows += [rows[7], rows[7], (7, rows[8][1], 2), (None, rows[3][1], 1), (900, [0.0] * 64, None), (901, [1e6, -1e6] * 32, 1)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [1.0] * 63, 1), (1003, [float("nan")] * 64, 1), (1004, [float("inf")] * 64, 1),
           (1005, [None] * 64, 1)]
    return rows, odd


def brute_clusters(rows):
    x = [[int(np.floor(64 * float(np.float32(e)))) for e in v] for _, v, _ in rows]
    key = [(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for (i, _, _), v in zip(rows, x)]
    centroids = [v for _, v in sorted(key)[:16]]
    for left in range(4):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for v in x]
        if left == 3:
            break
        for k in range(len(centroids)):
            mine = [v for v, (_, j) in zip(x, found) if j == k]
            if mine:
                centroids[k] = [sum(col) // len(mine) for col in zip(*mine)]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = Counter()
    for d, k in found:
        per[k] += d
    return sorted(((i is None, i or 0, k, d, per[k], sum(per.values()), shas[k]) for (i, _, _), (d, k) in zip(rows, found)))


def test_clusters_equal_brute_force_with_fewer_distances(spark):
    rows, odd = vector_rows()
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows + odd], VECTOR).repartition(5)
    got = pivot_clusters.cluster(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in got) == brute_clusters(rows)
    assert sum(r.n_exact for r in got) < 16 * len(got)  # the bounds rule centroids out
    assert pivot_clusters.cluster(df.where("false")).count() == 0
    few = pivot_clusters.cluster(df.where("vec_id in (1, 2, 1002)")).collect()
    assert {r.distance for r in few} == {0} and len(few) == 2


def test_distances_beyond_64_bits_are_exact():
    x = np.array([[1 << 61, -(1 << 61)], [3, 4]], np.int64)
    assert pivot_clusters.squared(x, -x).tolist() == [2 * (1 << 62) ** 2, 100]


def brute_variants(docs):
    n = Counter()
    for key, text in docs:
        for run in spelling._RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), len(a))
        return a[i + (len(a) == len(b)):] == b[i + 1:]

    near = {w: {o for o in n if one_edit(w, o)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], form[w], n.get(form[w]), root, len(near[w])))
    return sorted(out)


def spelling_docs():
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcé×"), 7 + k % 4)) for k in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababab"]
    docs = []
    for k in range(60):
        words = []
        for w in rng.choice(base, 80, p=np.arange(45, 0, -1) / np.arange(46).sum()):
            if rng.random() < 0.1:
                i = int(rng.integers(len(w)))
                w = w[:i] + rng.choice(["", "b", "X", "é"]) + w[i + int(rng.integers(2)):]
            words.append(w)
        docs.append((k, " ".join(words)))
    chain = [("kettenwort", 1000), ("kettenwork", 100), ("kettenkork", 10), ("kettenkorb", 2)]
    docs += [(200 + k, f"{w} ") for w, c in chain for k in range(c)]
    return docs + [docs[0], (None, "Äpfelbaum äpfelbaum Äpfelbaum"), (300, None), (301, ""), (302, "x" * 30000 + " " + "x" * 30000),
                   (303, "x" * 29999 + " " + "x" * 29999)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 5])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    docs = spelling_docs()
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (spelling.MIN_LENGTH, block))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "w", "to", "side")})
    got = spelling.variants(df.repartition(4))
    assert sorted((r.word, r.n, r.form, r.form_n, r.root, r.n_near) for r in got.collect()) == brute_variants(docs)
    assert spelling.variants(df.where("false")).count() == 0


def test_runs_do_not_depend_on_the_piece(monkeypatch):
    text = "Abc déf×÷ 12gh-Ijk " * 50
    whole = spelling.runs(text)
    monkeypatch.setattr(spelling, "_PIECE", 7)
    assert spelling.runs(text) == whole and whole["déf×÷"] == 50


@pytest.fixture(scope="module")
def field(spark):
    return page_text.train(spark)


def test_unseen_layouts(field):
    blocks = right = pages = 0
    for k in range(10_000, 10_200):
        html, text = page_examples.page(k)
        found = page_blocks.blocks(html)
        want = page_text.align([b.text for b in found], text.split("\n"))
        assert "\n".join(b.text for b, y in zip(found, want) if y) == text  # every labelled line is a block
        got = field.labels(found)
        blocks, right, pages = blocks + len(want), right + sum(a == b for a, b in zip(want, got)), pages + (want == got)
    assert right / blocks > 0.975 and pages / 200 > 0.75


PAGE = """<html><head><title>T</title><script>x="</p>"</script></head><body><header class=masthead><a href=/>The Daily</a></header>
<nav><a href=/a>One</a> <a href=/b>Two</a></nav><div id="cookie-notice">We use cookies.<button>OK</button></div>
<div class="post-content"><h1>A title &amp; more</h1><p>First   sentence, with <b>bold</b> and&nbsp;a <a href=x>link</a>.<br>Same block.
<p>Second paragraph is not closed &#8211; at all.<div class="ad">Buy this now!</div><p>Third one ends the article, as it must.</div>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/c>Other story</a></ul></aside>
<section class="comments"><h3>2 comments</h3><p>Nice article, I liked it very much.</p></section>
<form><label>E-mail</label><input></form><footer>&copy; 2020 The Daily</footer></body></html>"""
TEXT = ("A title & more\nFirst sentence, with bold and a link. Same block.\nSecond paragraph is not closed – at all.\n"
        "Third one ends the article, as it must.")


def test_a_page_written_by_hand(field):
    assert field.main_text(PAGE) == TEXT
    assert field.main_text(PAGE.replace("post-content", "article-body").replace("section", "div")) == TEXT


def test_odd_pages(spark, field):
    deep = "<article>" + "<div>" * 3000 + "<p>Deep text, but text all the same.</p>" + "</div>" * 3000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "<![if x]><p"), (5, "u", deep),
            (6, "u", "<article><p>" + "Long text, sentence after sentence. " * 20000 + "</p></article>"), (7, None, "<!-- no end <p>a</p>"),
            (8, "u", "</p></div><article><p>Stray tags, but a text.</article>")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text int, carry int")
    got = {r.page_id: r.text for r in page_text.extract(df, field).collect()}
    assert page_text.extract(df, field).count() == len(rows)
    assert got[1] == TEXT and got[None] == got[2] == got[7] == ""
    assert got[5] == "Deep text, but text all the same." and got[8] == "Stray tags, but a text."
    assert len(got[6]) == len("Long text, sentence after sentence. ") * 20000 - 1
    assert page_text.extract(df.where("false"), field).count() == 0


def test_training_on_given_pages(spark):
    pages = [(f"<div class=left><p>{'menu ' * (k % 3 + 1)}</p></div><div class=right><p>Some words of text {k}.</p></div>", f"Some words of text {k}.")
             for k in range(30)]
    df = spark.createDataFrame(pages + [(None, None), ("", "")], "html string, text string")
    field = page_text.train(spark, df, max_pages=25)
    assert [field.main_text(h) for h, _ in pages[:5]] == [t for _, t in pages[:5]]
    assert page_text.train(spark, df.where("false")).main_text(pages[0][0]) == ""


def made_up_languages(n):
    """Words of n languages over letters of their own, for learning, and a function that writes a text."""
    rng = np.random.default_rng(8)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz")[4 * k: 4 * k + 4], 5)) for _ in range(60)] for k in range(n)]
    return lambda parts: " ".join(w for k, size in parts for w in rng.choice(words[k], size))


def test_language_sets_of_any_size(spark):
    from netsieve.llm import language

    write = made_up_languages(6)
    learning = spark.createDataFrame([(f"l{k}", write([(k, 400)])) for k in range(6) for _ in range(3)], "lang string, text string")
    langs, logp = language.learn(learning)
    texts = [(m, write([(k, 60) for k in range(m)])) for m in range(1, 7)] + [(10, write([(0, 300), (3, 30)]))]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(texts, "doc_id long, text string"), langs, logp).collect()}
    for m in range(1, 7):
        assert got[m].n_langs == m and sorted(got[m].langs) == [f"l{k}" for k in range(m)]
        assert got[m].shares == pytest.approx([1 / m] * m, abs=0.03) and got[m].score == got[m].shares[0]
    assert got[10].langs == ["l0", "l3"] and got[10].shares == pytest.approx([10 / 11, 1 / 11], abs=0.02)


def test_mixture_reaches_the_maximum():
    from netsieve.llm import language

    rng = np.random.default_rng(1)
    likely = rng.random((50, 3)) ** 3 + 1e-6
    n = rng.integers(1, 9, 50).astype(float)
    share, fit, lack = language.mixture(likely, n, np.array([0, 20]), np.repeat([0, 1], [20, 30]), np.array([n[:20].sum(), n[20:].sum()]))
    grid = [(a / 60, b / 60, 1 - (a + b) / 60) for a in range(61) for b in range(61 - a)]
    for r, rows in enumerate((slice(0, 20), slice(20, 50))):
        top = max((n[rows] * np.log(likely[rows] @ np.array(g))).sum() for g in grid)
        assert fit[r] > top - language.TOLERANCE - 1e-9 and fit[r] + lack[r] > top - 1e-9
        assert share[r].sum() == pytest.approx(1.0)


def test_short_texts_take_little_memory():
    import tracemalloc

    from netsieve.llm import language

    texts = ["a short text of about fifty characters, no more."] * 10_000
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.arange(10_001) * len(texts[0])
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(language.BUCKETS), 4).T)
    tracemalloc.start()
    language.infer(buf, off, logp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
