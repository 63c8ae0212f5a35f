"""Near-duplicates, vectors and pages against brute force."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import common
from claimloom.llm import html_extract as H
from claimloom.llm import near_dedup as N
from claimloom.llm import vector_search as V


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_large_group_of_near_copies(spark):
    """Chains, a hot group with edits of any strength, exact copies and texts that only share a passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(80)], [word() for _ in range(40)]
    rows = []
    for _ in range(220):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(80):
        rows.append(" ".join([word() for _ in range(rng.choice([5, 20, 60]))] + passage))
    chain = [word() for _ in range(100)]
    for _ in range(20):
        chain[rng.randrange(100)] = word()
        rows.append(" ".join(chain))
    rows += [rows[0].upper(), rows[0], "a b c", "a b  c", "", None, "a b c d"]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_groups(rows)


def test_one_row_stays_of_each_group(spark, odd):
    got = N.near_duplicates(odd).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component_id if r.n_shingles else ("none", r._row), []).append(r)
    assert all(sum(r.first for r in g) == 1 for g in groups.values())
    assert {r.doc_id: r.component_id for r in got}[6] == 5


def test_estimates(spark):
    rng = np.random.default_rng(3)
    common_part = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.r_[common_part, rng.integers(0, 1 << 62, 500, dtype=np.uint64)], np.r_[common_part, rng.integers(0, 1 << 62, 500, dtype=np.uint64)]
    pa_, pb = (N.pack(N.minima(x)).view(np.int64).tolist() for x in (a, b))
    la, lb = (N.long_bits(x).tolist() for x in (a, b))
    kind = "struct<w0:long,w1:long,w2:long,w3:long>"
    d = spark.createDataFrame([(tuple(pa_), tuple(pb), la, lb)], f"a {kind}, b {kind}, la array<long>, lb array<long>")
    r = d.select(N.estimate("a", "b").alias("e"), N.long_estimate("la", "lb").alias("l")).first()
    assert abs(r.e - 0.75) < 0.2 and abs(r.l - 0.75) < 0.06


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(300, 400)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if a != b:
            x, y = a, b
            while top.setdefault(x, x) != x:
                x = top[x]
            while top.setdefault(y, y) != y:
                y = top[y]
            top[max(x, y)] = min(x, y)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    assert got == {k: find(k) for k in top}


def brute_nearest(ids, x, k=10):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_vectors_are_exact_within_a_window(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in V.op10(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(ids, x)


def test_vector_recall_and_hot_vector(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16)), np.tile(rng.normal(size=16), (3000, 1))].astype(np.float32)
    ids = rng.permutation(len(x))
    d = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {}
    for r in V.search(d, F.col("vec_id") % 100 == 0, least_window=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(ids, x.astype(np.float64))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    hot = [q for q in want if want[q][0][1] == 0]
    assert hot and all(got[q] == want[q] for q in hot)


def test_hilbert_is_a_curve():
    pts = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    key = V.hilbert(pts, 3)
    assert sorted(key) == list(range(512))
    walk = pts[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_articles(spark, sf):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.op7(spark, sf).collect():
        a = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?(p|h1)>", " ", a))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_templates_and_named_parts(spark):
    page = lambda k: f"""<body><div class="site-header">H{k}</div><div><p>Same line on all pages</p><p>Story {k} of <b>this</b> host.<p>It goes&nbsp;on {k}.</div>
      <form><p>Send {k}</p></form><aside>Side {k}</aside><section id=comments><p>Comment {k}</p></section><p class="notice">Note {k}</p><script>x("<p>{k}</p>")</script><footer>F{k}</footer></body>"""  # noqa: E731
    d = spark.createDataFrame([(k, f"https://one.org/{k}", page(k)) for k in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(d).collect()} == {k: f"Story {k} of this host. It goes on {k}." for k in range(12)}
    few = spark.createDataFrame([(1, "https://two.org/", page(1))], "page_id long, url string, html string")
    assert H.extract(few).first().text == "Same line on all pages Story 1 of this host. It goes on 1."


def test_copies_of_a_page_make_no_template(spark):
    page = lambda k: f"<body><div><p>Same line on all pages</p><p>Story {k} of this host.</p><p>It goes on {k}.</p></div></body>"
    rows = [(k, f"https://one.org/{k}", page(0 if k < 9 else k)) for k in range(17)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {n} of this host. It goes on {n}." for k in range(17) for n in [0 if k < 9 else k]}


def test_one_rule_for_hosts_of_any_size(spark):
    page = lambda k: f"<body><div><p>Same line on all pages</p><p>Story {k} of this host.</p><p>It goes on {k}.</p></div></body>"
    rows = [(100 * n + k, f"https://h{n}.org/{k}", page(k)) for n in (1, 2, 3, 7, 8, 9) for k in range(n)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.pop(100) == "Same line on all pages Story 0 of this host. It goes on 0."
    assert got == {i: f"Story {i % 100} of this host. It goes on {i % 100}." for i in got} and len(got) == 29


def test_layouts_of_a_host_have_seeds_of_their_own(spark):
    story = lambda k: f"<div><p>Same line on all stories</p><p>Story {k} of this host.</p><p>It goes on {k}.</p></div>"
    table = lambda k: f"<section><dl><dt>Same head of all tables</dt><dd>Cell {k}</dd></dl></section>"
    bare = "<div><p>A story without the line.</p><p>The end.</p></div>"
    rows = [(0, "<h1>Error</h1><pre>Not found</pre>"), (1, bare), *((k, story(k)) for k in range(2, 20)), *((k, table(k)) for k in range(20, 30)), (30, "<ul><li>Odd</ul><table><tr><td>page</table>" + story(30))]
    d = spark.createDataFrame([(k, f"https://one.org/{k}", f"<html><body>{h}</body></html>") for k, h in rows], "page_id long, url string, html string")
    want = {k: f"Story {k} of this host. It goes on {k}." for k in range(2, 20)} | {k: f"Cell {k}" for k in range(20, 30)}
    assert {r.page_id: r.text for r in H.extract(d).collect()} == want | {0: "Error Not found", 1: "A story without the line. The end.", 30: "Odd page Story 30 of this host. It goes on 30."}


def test_tree_matching():
    def tree(s):
        return H.parse(s)[0]

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        t = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + plain(x, y))
        return 1 + t[-1][-1]

    rng = random.Random(7)

    def some(depth):
        return "".join(f"<{g}>{some(depth - 1)}</{g}>" for g in rng.choices(["div", "p", "ul", "section"], k=rng.randint(0, 4))) if depth else ""

    for _ in range(200):
        a, b = tree(some(3)), tree(some(3))
        pairs = list(H.Matcher().pairs(a, b))
        assert H.Matcher().score(a, b) == plain(a, b) == len(pairs)
        assert all(x.tag == y.tag for x, y in pairs)


def test_components_are_complete_or_raise(spark):
    from claimloom.llm.common import components

    n = 100_000
    path = spark.range(n - 1).select(((F.col("id") * 7919) % n).alias("a"), (((F.col("id") + 1) * 7919) % n).alias("b"))
    got = components(path)
    assert got.count() == n and got.select("comp").distinct().collect() == [(0,)]
    with pytest.raises(RuntimeError):
        components(path, most_rounds=1)


def test_shared_folder_or_error(spark):
    from claimloom.llm import common

    class Fake:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Fake)
    Fake.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Fake)
    Fake.sparkContext.master = "local[4]"
    assert common.shared_dir(Fake)


def test_pairs_across_components_in_blocks(spark, monkeypatch):
    """A ring of texts, each like its neighbours only, under one band key: every link has to be found by some block."""
    monkeypatch.setattr(N, "PAIR_BLOCK", 3)
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(k * 4, k * 4 + 30):
            words[(j * 10) % 400] = f"v{j}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: set(N.shingles(N.words_of(t.encode())).tolist()) for k, t in rows}
    top = {k: k for k in sets}

    def find(k):
        return k if top[k] == k else find(top[k])

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                top[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in sets}


def test_vectors_of_several_lengths_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "ASKS", 3)
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(2000)]
    got = {}
    for r in V.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, least_window=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 40
    for q in got:
        others = sorted((float(np.sqrt(((np.array(v) - np.array(rows[q][1])) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(rows[q][1]))[:10]
        assert [(i, pytest.approx(s)) for s, i in others] == got[q]
