"""Wrapper induction, filter audit and hard negatives against brute force."""

import html as entities
import random
import re
from itertools import permutations

import numpy as np
import pytest

from pyspark.sql import functions as F

from scorewatch.llm import audit, negatives, wrappers

# ---- wrapper induction

ARTICLE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head>
<body class="has-sidebar"><header id="top"><a href="/">Site</a></header><nav><ul><li><a href=x>m{n}</a><li><a href=y>k</a></ul></nav>
<div class="cookie-notice">We use cookies {n}</div><div class="wrap with-comments"><article><header class="entry-header"><h1>Title&nbsp;{n} &amp;
more</h1></header><p>First <b>bo</b>ld   {n}<br>line<p>Second &lt;{n}&gt; <p class="share">Share {n}</p><div class="ad-slot">Buy {n}</div>
<ul><li>one {n}</li><li>two</li></ul><form><label>Mail</label><input><button>Go</button></form><p>Read more on our site.</p>
<!-- gone --><section class="comments"><article class="comment"><p>I agree {n}</p></article></section></article></div>
<aside>Aside {n}</aside><div style="display: none">hidden {n}</div><footer>&copy; {n}</footer></body></html>"""
PLAIN = """<html><body><div class="top-menu"><a href=a>A{n}</a> <a href=b>B</a></div><table><tr><td>Welcome to the site<td>
<div class=x7><h2>Head {n}</h2><p>{body}</p>tail {n}</div></table><div>All rights kept by us</div><p>Mail us</p></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "k", "n") for i, u, h in rows], "page_id long, url string, html string, host string, key string, blocks string").repartition(3)
    return sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in wrappers.main_texts(df).collect()), key=str)


def test_layouts_of_one_host(spark):
    rows = [(n, "https://Site.example.com:80/a", ARTICLE.format(n=n)) for n in range(6)]
    body = ["lorem ipsum dolor " * (n + 5) for n in range(5)]
    rows += [(10 + n, "https://u@plain.example.com/b?x=//z", PLAIN.format(n=n, body=body[n])) for n in range(5)]
    got = {i: t for i, _, t, _ in extracted(spark, rows)}
    for n in range(6):
        # The line that all pages share is template, the rest of the article is kept.
        assert got[n] == f"Title {n} & more First bold {n} line Second <{n}> one {n} two"
    for n in range(5):
        assert got[10 + n] == f"Head {n} {body[n].strip()} tail {n}"


def test_a_page_alone_and_equal_pages(spark):
    rows = [(1, "http://one.example/", ARTICLE.format(n=1))] + [(n, "http://same.example/", ARTICLE.format(n=2)) for n in (2, 3, 4, 5)]
    texts = [f"Title {n} & more First bold {n} line Second <{n}> one {n} two Read more on our site." for n in (1, 2, 2, 2, 2)]
    assert [t for _, _, t, _ in extracted(spark, rows)] == texts


def test_odd_pages(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (None, None, None), (None, None, None), (1, None, ""), (2, "no address", "just text & more &am"), (3, "http://h/", "<p>a<p>b</div></span>"),
        (4, "http://i/", f"<article><p>{long}</article>"), (5, "http://j/", "<article><h1>x</h1><script>never ended <p>y</p>"),
        (6, "http://k/", "<main>a < b <!-- open"), (7, "http://l/", "<article>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000), (8, "http://m/", "<article>end <p cla"),
    ]
    want = [(None, None, ""), (None, None, ""), (1, None, ""), (2, "no address", "just text & more &am"), (3, "http://h/", "a b"), (4, "http://i/", long)]
    want += [(5, "http://j/", "x"), (6, "http://k/", "a < b"), (7, "http://l/", "deep"), (8, "http://m/", "end")]
    assert extracted(spark, rows) == sorted(((i, u, t, len(t)) for i, u, t in want), key=str)
    assert extracted(spark, []) == []


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def naive(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())

    want = {r["page_id"]: naive(r["html"]) for r in pages.collect()}
    got = wrappers.main_texts(pages).collect()
    assert len(got) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def random_tree(draw, depth=3):
    node = wrappers.Node(draw.choice("abc"))
    if depth:
        node.kids = [random_tree(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return node


def best_mapping(a, b):
    """Simple tree matching by trying every order-preserving pairing of the children."""
    if a.label != b.label:
        return 0

    def best(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best_mapping(a.kids[i], b.kids[j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_tree_matching():
    draw = random.Random(3)
    for _ in range(200):
        a, b = random_tree(draw), random_tree(draw)
        assert wrappers.matched(a, b, {}) == best_mapping(a, b)
        if a.label == b.label:
            sizes, common = [len(wrappers.listed(t)) for t in (a, b)], best_mapping(a, b)
            wrappers.merge(a, b, wrappers.between_pages)
            assert len(wrappers.listed(a)) == sum(sizes) - common


def test_many_shapes_of_one_host(spark):
    draw = random.Random(4)
    rows = []
    for n in range(300):
        parts = "".join(f"<{t}>{t} {n}</{t}>" for t in draw.choices(["h2", "p", "ul", "blockquote", "pre"], k=12))
        rows.append((n, "http://hot.example/", f"<nav>m {n}</nav><article>{parts}</article><footer>f</footer>"))
    shapes = wrappers.page_shapes(wrappers.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert shapes.where("node = 0").count() > wrappers.FAN_IN
    whole = wrappers.host_wrappers(shapes).collect()
    assert [r["pages"] for r in whole if r["node"] == 0] == [300]
    for i, _, text, _ in extracted(spark, rows):
        assert text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.search("<article>(.*)</article>", rows[i][2])[1])).split())


# ---- filter audit


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, "e", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, mask long, n long").repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(df, marked).collect()}


def audit_by_hand(docs, labels):
    fails = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        own |= {"D"} if re.search("[#$%&*|]", text) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        fails.append(own)
    marks = [[max((int(r[c] == 1) for r in labels if r[0] == i and r[0] is not None and r[c] is not None), default=0) for c in (1, 2)] for i, _, _ in docs]
    out, totals = {}, {}
    for part in {d[2] or "" for d in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                before, left = left, [k for k in left if f not in fails[k]]
                redundant = [k for k in own if f in fails[k] and k not in before]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(redundant), sum(fails[k] == {f} for k in own), sum(marks[k][0] for k in gone), sum(marks[k][1] for k in gone)]
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_hand(spark):
    draw = random.Random(5)
    texts = [" ".join(f"{draw.choice(['w', 'W', '#', 'é'])}{draw.randint(0, draw.choice([20, 900]))}" for _ in range(draw.choice([0, 3, 199, 200, 260]))) for _ in range(12)]
    texts += [None, "", "a\x0bb\x1cc\x85d e " * 70, "x " * 400, "y%" * 50_000]
    docs = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(70)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [*range(0, 30, 2), 4, 4, None, None]]
    assert audited(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_of_nothing_and_of_one_text(spark):
    assert audited(spark, [], []) == {}
    same = [(k % 50, "one text", "en") for k in range(300)]
    assert audited(spark, same, []) == audit_by_hand(same, [])


def test_gray_walk():
    draw = np.random.default_rng(6)
    masks, counts = np.arange(32), draw.integers(0, 50, (32, 3))
    states = audit.gray_walk(masks, counts, 5)
    for subset in range(32):
        assert (states[subset] == counts[(masks & subset) == 0].sum(axis=0)).all()


# ---- hard negatives


def by_brute_force(rows, every=100):
    fit = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(fit):
        if i is None or i % every:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, _, w in fit]
        order = sorted(range(len(fit)), key=lambda c: (-score[c], fit[c][0] is None, fit[c][0] or 0))
        for p in [c for c in order if c != a and fit[c][1] == label][:5]:
            hard = [c for c in order if fit[c][1] != label and 30 * score[p] <= 100 * score[c] <= 90 * score[p]]
            out += [(i, fit[p][0], rank, fit[c][0], score[p], score[c]) for rank, c in enumerate(hard[:10], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, embedding array<float>, label int, block long, batch string").repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("label"), **more).collect()), key=str)


def vectors(n, seed, width=6):
    draw = random.Random(seed)
    return [(i, [round(draw.uniform(-1, 1), 1) for _ in range(width)], draw.randint(0, 2)) for i in range(n)]


def test_negatives_by_brute_force(spark):
    rows = vectors(400, 7)
    told = {}
    assert mined(spark, rows, every=20, block_rows=8, told=told) == by_brute_force(rows, 20)
    # Zone maps spare blocks: small ones of few dimensions lie apart.
    assert told["positives"] < told["windows"] < told["pairs"]


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = vectors(60, 8) + [(60, None, 1), (61, [1.0, None], 1), (62, [nan], 0), (63, [inf, 1.0], 0), (64, [0.1], None), (80, [0.5, 0.5], 1), (100, [], 2)]
    rows += [(None, [0.5] * 6, 0), (None, [0.5] * 6, 1), (20, [0.4] * 6, 0), (20, [0.4] * 6, 0)] + [(200 + i, [0.9] * 6, 2) for i in range(90)] + [(500, [30000.0] * 6, 0), (501, [30000.0] * 6, 0), (502, [20000.0] * 6, 1)]
    assert mined(spark, rows, every=20, block_rows=8) == by_brute_force(rows, 20)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [0.1], 1), (100, [0.2], 2)]) == []


def test_scores_stay_exact():
    one = np.array([[2.0**31, 3.0]])
    assert negatives.scores(one, one)[0, 0] == 2**62 + 9
    with pytest.raises(OverflowError):
        negatives.scores(one * 8, one * 8)


def test_hilbert_keys_visit_every_cell_by_single_steps():
    for width, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), axis=-1).reshape(-1, width)
        keys = [k.tobytes() for k in negatives.hilbert_keys(cells, bits)]
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


