"""Greedy selections against small models written from their rules."""

import random
import re

from pyspark.sql import functions as F

from claimloom import queries as Q
from claimloom.operators import greedy as G


def places(df, pos="pos"):
    return [r[pos] for r in df.orderBy("place").collect()]


def test_mmr_prefers_what_is_new(spark):
    rows = [(1, 0, 0.9, "alpha beta gamma"), (1, 1, 0.89, "alpha beta gamma"), (1, 2, 0.7, "delta epsilon zeta"), (1, 3, 0.1, "eta theta iota")]
    d = spark.createDataFrame(rows, "c int, pos int, score double, text string").withColumn("title", F.lit("")).withColumn("source", F.lit(""))
    assert places(G.mmr(d, "c", "pos", 2)) == [0, 2, 1, 3]
    assert places(G.mmr(d, "c", "pos", 0)) == [0, 1, 2, 3]


def test_diversity_fills_past_the_cap(spark):
    rows = [(1, i, "h", "") for i in range(4)] + [(1, 4, "g", "t"), (1, 5, "k", "t")]
    d = spark.createDataFrame(rows, "c int, pos int, host string, title_key string")
    assert places(G.diversity(d, "c", "pos", 5, 2)) == [0, 1, 4, 2, 3]


def test_better_duplicate_moves_to_the_end(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, 0, "u0", long, 0.5), (1, 1, "u1", "other words here", 0.5), (1, 2, "u2", long, 0.9), (1, 3, "u2", "third text now", 0.1), (1, 4, "u1", "more", 0.1)]
    d = spark.createDataFrame(rows, "c int, pos int, url string, text string, score double")
    assert places(G.drop_similar(d, "c", "pos")) == [1, 2, 3]


def test_similarity_of_exactly_090_stays(spark):
    a = " ".join(f"w{i}" for i in range(10))
    b = " ".join([*(f"w{i}" for i in range(9)), "z"])
    assert G.similarity(a, b) == 0.9
    d = spark.createDataFrame([(1, 0, "", a, 1.0), (1, 1, "", b, 1.0)], "c int, pos int, url string, text string, score double")
    assert places(G.drop_similar(d, "c", "pos")) == [0, 1]


def test_distinct_claims_against_a_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(60)]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "d int, pos int, sentence string")
    kept = []
    for i, s in enumerate(texts):
        a = set(s.split())
        if all(len(a & set(texts[j].split())) / len(a | set(texts[j].split())) < 0.78 for j in kept):
            kept.append(i)
    assert places(G.distinct_claims(d, "d", "pos")) == kept[:20]


def test_informative_claims(spark):
    rows = [(1, 0, "short"), (1, 1, "In 2020 Paris had 300 floods"), (1, 2, "in 2020 paris had 300 floods"), (1, 3, "Something else entirely happened Today")]
    assert places(G.informative_claims(spark.createDataFrame(rows, "d int, pos int, sentence string"), "d", "pos")) == [1, 3]


def test_empty(spark):
    d = spark.createDataFrame([], "d int, pos int, sentence string")
    assert G.distinct_claims(d, "d", "pos").count() == 0


def brute_drop_similar(rows, above=0.90):
    kept, urls = [], set()
    for i, url, text, score in rows:
        if url and url in urls:
            continue
        twin = next((k for k in kept if text and G.similarity(text, k[1]) > above), None)
        if twin is None:
            kept.append((i, text, score))
            urls |= {url} - {""}
        elif score > twin[2]:
            kept.remove(twin)
            kept.append((i, text, score))
    return [k[0] for k in kept]


def test_drop_similar_against_brute_force(spark):
    rng = random.Random(9)
    rows, texts = [], ["", " ", "w1"]
    for i in range(900):
        w = rng.choice(texts).split() if rng.random() < 0.6 else [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30))]
        w = [x if rng.random() > 0.04 else f"w{rng.randrange(40)}" for x in w][: rng.choice([5, 10, 99, 99])]
        texts.append(" ".join(w))
        rows.append((i % 3, i, rng.choice(["", f"u{rng.randrange(300)}"]), texts[-1] if i % 50 else None, rng.randrange(9) / 9))
    d = spark.createDataFrame(rows, "c int, pos int, url string, text string, score double")
    for above in (0.9, 0.5, 0.7):
        got = {c: places(G.drop_similar(d.where(d.c == c), "c", "pos", above)) for c in range(3)}
        assert got == {c: brute_drop_similar([(i, u, t or "", s) for k, i, u, t, s in rows if k == c], above) for c in range(3)}
        spread = G.drop_similar(d, "c", "pos", above, frame_rows=0 if above > 0.6 else 250)
        assert {c: places(spread.where(spread.c == c)) for c in range(3)} == got


def test_queries_take_all_rows(spark, tmp_path):
    """One claim of 150 rows with near copies, and a text whose most informative sentences come last."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(30)) for _ in range(100)]
    texts += [" ".join([*texts[k].split()[:29], word()]) for k in range(0, 100, 2)]
    docs = [(40 * k, t, "s", "en") for k, t in enumerate(texts)]
    docs.append((1, " ".join(f"{word()} {word()} {word()} {word()} {word()}." for _ in range(40)) + " In 2020 Paris had 300 floods and 12 storms. In Rome 7 of 9 Bridges fell on 3 May.", "s", "en"))
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(0, "claim"), (1, "claim")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    rows = [(i, "", t, i * 37 % 101 / 100.0) for i, t, _, _ in docs if i % 40 == 0]
    assert [r.pos for r in Q.k4(spark, sf).where("claim_id = 0").orderBy("place").collect()] == brute_drop_similar(rows)

    ranked, tokens = sorted(rows, key=lambda r: (-r[3], r[0])), {}
    for i, _, t, _ in rows:
        tokens[i] = set(re.findall("[a-z]{3,}", f"{t[:60]} s {t}"))
    left, picked = ranked[:30], []
    while len(picked) < 10:
        worst = lambda r: max((len(tokens[r[0]] & tokens[p[0]]) / len(tokens[r[0]] | tokens[p[0]]) for p in picked), default=0.0)
        best = max(left, key=lambda r: 0.75 * r[3] - 0.25 * worst(r))
        picked.append(best)
        left.remove(best)
    got = Q.k2(spark, sf).where("claim_id = 0").orderBy("place").collect()
    assert [r.pos for r in got] == [r[0] for r in [*picked, *left, *ranked[30:]]] and [r.place for r in got] == list(range(1, 151))
    assert [r.pos for r in Q.k8(spark, sf).where("doc_id = 1").orderBy("place").collect()] == [41, 40]


def test_hot_claim_of_copies(spark):
    """Copies, near copies, one URL of a third of the rows, scores that rise and fall, null groups; frames and links agree."""
    rng = random.Random(12)
    base = " ".join(f"w{k}" for k in range(30))
    near = lambda: " ".join(w if rng.random() > 0.05 else f"x{rng.randrange(9)}" for w in base.split())
    rows = [(rng.choice([1, 1, 1, None]), i, rng.choice(["", "hot", f"u{i}"]), rng.choice([base, near(), near(), f"alone {i}", "", None]), rng.choice([None, i / 1500, 1 - i / 1500])) for i in range(1500)]
    d = spark.createDataFrame(rows, "c int, pos int, url string, text string, score double")
    a, b = (G.drop_similar(d, "c", "pos", frame_rows=n) for n in (0, 10**6))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 100
    assert sorted(G.drop_similar(d.where("c IS NULL AND pos < 0"), "c", "pos", frame_rows=0).collect()) == []


def test_numbers_without_a_window_over_a_group(spark):
    from claimloom.operators.links import components, number

    d = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).alias("k")).where("g < 2").withColumn("g", F.when(F.col("g") == 1, 1))
    got = number(d, ["g"], ["k"], "n", partitions=7)
    for g in (1, None):
        r = [(x.k, x.n) for x in got.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("k").collect()]
        assert [n for _, n in r] == list(range(1, 1001)) and r == sorted(r)
    edges = [(i, i + 2) for i in range(0, 300)] + [(1000, 1001), (5, 5), (1001, 1002)]
    comp = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert comp == {**{i: i % 2 for i in range(302)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_shared_rare_word_confirms_nothing(spark, monkeypatch):
    """Each two of 60 sets share one word of their own; whole sets meet only where more is found. Similar ones still do."""
    from claimloom.operators import links

    words = {i: [1000 * min(i, j) + max(i, j) for j in range(60) if j != i] + [10**6 + 1000 * i + k for k in range(41)] for i in range(60)}
    words |= {60: words[0][:92] + list(range(8)), 61: words[1][:50], 62: words[2][:3]}
    made = {}
    monkeypatch.setattr(links, "staged", lambda d, tag, f=links.staged: made.setdefault(tag, f(d, tag)))
    got = links.similar_sets(spark.createDataFrame(list(words.items()), "node long, words array<long>"), 0.9)
    sets = {k: set(v) for k, v in words.items()}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 0.9 * min(len(sets[a]), len(sets[b]))}
    assert {frozenset(r) for r in got.collect()} == want and len(want) == 3
    assert made["pairs"].count() < 10


def test_long_texts_are_no_frame(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i // 40, i, "", " ".join(f"w{rng.randrange(30)}" for _ in range(20 if i < 40 else 2)), 0.5) for i in range(80)]
    d = spark.createDataFrame(rows, "c int, pos int, url string, text string, score double")
    want = sorted(map(str, G.drop_similar(d, "c", "pos", 0.7).collect()))
    framed = []
    monkeypatch.setattr(G, "FRAME_CHARS", 1000)
    monkeypatch.setattr(G, "_drop_in_frames", lambda r, *a, f=G._drop_in_frames: framed.append(r) or f(r, *a))
    assert sorted(map(str, G.drop_similar(d, "c", "pos", 0.7).collect())) == want
    assert {r.c for r in framed[0].collect()} == {1}


def test_groups_across_batches(spark):
    """Documents are read in order from batches of any size, without a frame for each."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(30)]), i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(4))) for i in range(400)]
    d = spark.createDataFrame(rows, "d int, pos int, sentence string").repartition(3)
    want, was = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for f in (G.distinct_claims, G.informative_claims):
        assert "FlatMapGroups" not in f(d, "d", "pos")._jdf.queryExecution().optimizedPlan().toString()
        for n in ("100000", "3", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = sorted((str(r.d), r.place, r.pos) for r in f(d, "d", "pos").collect())
            alone = [x for k in (None, 3, 7) for x in ((str(k), r.place, r.pos) for r in f(d.where(F.col("d").eqNullSafe(F.lit(k))), "d", "pos").collect())]
            assert want.setdefault(f, got) == got and set(alone) == {x for x in got if x[0] in ("None", "3", "7")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_words_of_one_set_alone_are_not_shuffled(spark, monkeypatch):
    """A set with more words of its own than may be missing looks for nothing, and of the others only what is looked for is
    joined; sets of other groups neither meet nor make a word common to two sets."""
    from claimloom.operators import links

    rng = random.Random(3)
    usual = [rng.getrandbits(62) for _ in range(40)]
    own = lambda n: [rng.getrandbits(62) for _ in range(n)]
    rows = [(i, usual + own(20), i % 2) for i in range(200)]
    rows += [(1000 + i, rows[i][1][:55] + own(1), i % 2) for i in range(3)] + [(2000, rows[7][1], 0), (2001, usual[:5], 0)]
    made, shuffled = {}, []
    monkeypatch.setattr(links, "staged", lambda d, tag, f=links.staged: made.setdefault(tag, f(d, tag)))
    monkeypatch.setattr(links, "_marked", lambda d, *a, f=links._marked: shuffled.append(d) or f(d, *a), raising=False)
    got = links.similar_sets(spark.createDataFrame(rows, "node long, words array<long>, g long"), 0.9)
    sets = [(n, set(w), g) for n, w, g in rows]
    want = {frozenset((a, b)) for a, x, g in sets for b, y, h in sets if a < b and g == h and len(x & y) > 0.9 * min(len(x), len(y))}
    assert {frozenset(r) for r in got.collect()} == want and len(want) == 106
    assert {r.x for r in made["probes"].select("x").distinct().collect()} == {0, 1, 2, 1000, 1001, 1002, 2001}
    assert shuffled[0].count() < 205 * 25


def test_texts_are_written_once_as_words(spark, monkeypatch):
    """No text is written where a group and its places tell a row; where places repeat, rows get numbers, and none is lost."""
    d = spark.createDataFrame([(i % 2, i // 2, f"u{i}", f"the text of {i} alone", 0.5) for i in range(60)], "c int, pos int, url string, text string, score double")
    written = []
    monkeypatch.setattr(G, "staged", lambda df, tag, f=G.staged: written.append(df.columns) or f(df, tag))
    assert G.drop_similar(d, "c", "pos", frame_rows=0).count() == 60
    assert not [c for c in written if "text" in c or "_text" in c]
    twice = G.drop_similar(d.withColumn("pos", F.floor(F.col("pos") / 3).cast("int")), "c", "pos", frame_rows=0)
    assert sorted(r.url for r in twice.collect()) == sorted(f"u{i}" for i in range(60))
    assert sorted(r.place for r in twice.where("c = 1").collect()) == list(range(1, 31))


def test_rows_whose_url_is_seen_meet_nothing(spark, monkeypatch):
    """A third of 1,200 rows without a URL's first text: heads are decided first, and later rows of URLs seen there are left out."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 25))) for _ in range(40)]
    rows = [(rng.choice([1, None]), i, rng.choice(["hot", "", *(f"u{k}" for k in range(6))]) if i % 9 else "hot", rng.choice(texts) if rng.random() < 0.3 else f"{i} alone of {i * 7} and {i * 11}", rng.choice([None, i / 1200, 1 - i / 1200])) for i in range(1200)]
    rows = [(c, i, u or f"u{i % 6}", t, s) for c, i, u, t, s in rows]
    d = spark.createDataFrame(rows, "c int, pos int, url string, text string, score double")
    want = sorted(map(str, G.drop_similar(d, "c", "pos", frame_rows=10**6).collect()))
    met = []
    monkeypatch.setattr(G, "HEAD_ROWS", 50, raising=False)
    monkeypatch.setattr(G, "similar_sets", lambda s, a, f=G.similar_sets: met.append(s.count()) or f(s, a))
    assert sorted(map(str, G.drop_similar(d, "c", "pos", frame_rows=0).collect())) == want
    assert len(met) > 1 and sum(met) < 600
    # a head whose URLs are all left unseen leaves all rows, and a larger one is decided
    met.clear()
    same = spark.createDataFrame([(1, i, f"u{i % 3}" if i < 30 else f"v{i % 3}", "one text of words", 0.5) for i in range(1200)], "c int, pos int, url string, text string, score double")
    assert [r.pos for r in G.drop_similar(same, "c", "pos", frame_rows=0).collect()] == [0] and len(met) > 1


def test_slices_find_the_same_pairs(spark, monkeypatch):
    from claimloom.operators import links

    rng = random.Random(6)
    rows = [(i, list({rng.randrange(25) for _ in range(rng.randint(1, 14))}), i % 2) for i in range(150)]
    sets = [(n, set(w), g) for n, w, g in rows]
    want = {frozenset((a, b)) for a, x, g in sets for b, y, h in sets if a < b and g == h and len(x & y) > 0.7 * min(len(x), len(y))}
    monkeypatch.setattr(links, "PROBES", 200, raising=False)
    staged = []
    monkeypatch.setattr(links, "staged", lambda d, tag, f=links.staged: staged.append(tag) or f(d, tag))
    got = [frozenset(r) for r in links.similar_sets(spark.createDataFrame(rows, "node long, words array<long>, g long"), 0.7).collect()]
    assert set(got) == want and len(got) == len(want) > 100 and staged.count("pairs") > 1
