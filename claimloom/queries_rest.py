"""Queries for the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import parse as A
from .functions import text as X
from .functions import urls as U
from .operators import classify as C
from .operators import dataset as D
from .operators import evaluate as E
from .operators import scoring as S
from .operators import selection as K
from .operators.links import number
from .queries import EV, SPAN, evidence, query, t, tok
from .queries_more import _RUN, run
from .sources import providers as P


@query("n10_image_claims", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(CASE WHEN turn % 2 = 0 AND length(trim(text)) > 38 THEN trim(text) ELSE CASE WHEN turn % 2 = 0 THEN 'Is it so? ' || trim(text) ELSE trim(text) END END, '\s+', ' ', 'g')), '\.+', '.', 'g'), '!+', '!', 'g'), '\?+', '?', 'g') AS claim FROM conversations
""")
def n10(spark, sf):
    c = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Is it so? "), F.trim("text"))).otherwise(F.col("text"))
    return t(spark, sf, "conversations").select("conv_id", "turn", C.image_claim(c).alias("claim"))


@query("n11_case_rows", "SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END AS language, CASE WHEN lang = 'en' THEN 'EN' ELSE 'MULTI' END AS lang_bucket, CASE doc_id % 2 WHEN 0 THEN 'support' ELSE 'refute' END AS expected FROM documents WHERE lang IN ('en', 'de', 'fr') AND doc_id % 3 <> 2")
def n11(spark, sf):
    d = t(spark, sf, "documents")
    names = D.canonical_label(F.col("lang"), {"en": "english", "de": "german", "fr": "french"})
    expected = F.when(F.col("doc_id") % 3 == 2, "odd").when(F.col("doc_id") % 2 == 0, "support").otherwise("refute")
    r = d.select(F.col("doc_id").alias("id"), names.alias("language"), F.when(F.col("lang") == "en", "EN").otherwise("MULTI").alias("lang_bucket"), expected.alias("expected"))
    return r.where(F.col("language").isNotNull() & F.col("expected").isin("support", "refute", "neutral"))


@query("n13_claim_artefacts", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) WHEN 2 THEN trim(text) || ' This claim is provided in Hindi. Or so.' ELSE trim(text) || ' this claim was provided in Hindi' END AS claim FROM benchmark")
def n13(spark, sf):
    tails = F.array(*[F.lit(x) for x in ("  This claim is provided in Hindi. ", "\n\tTHIS claim  is presented in tamil", " This claim is provided in Hindi. Or so.", " this claim was provided in Hindi")])
    return t(spark, sf, "benchmark").select("item_id", X.without_artefact(F.concat(F.trim("text"), F.element_at(tails, (F.col("item_id") % 4 + 1).cast("int")))).alias("claim"))


@query("n6_publication_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published_at FROM events")
def n6(spark, sf):
    from .operators.evidence import publication_date

    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    page = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), at, F.lit('">'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('<time datetime="'), at, F.lit('Z">'))).otherwise(F.concat(F.lit('{"datePublished": "'), at, F.lit('"}')))
    return t(spark, sf, "events").select("event_id", publication_date(page).alias("published_at"))


@query("f20_anchors", r"""
WITH l AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._/-]*|\p{Nd}+(?:[.,]\p{Nd}+)?(?:%|[A-Za-z]+)?') AS l FROM documents), w AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
f AS (SELECT doc_id, lower(x) AS k, min(i) AS i, arg_min(x, i) AS x FROM w WHERE length(x) >= 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE n <= 10), '') AS anchors FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""")
def f20(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(X.ascii_anchors("text"), " ").alias("anchors"))


@query("f22_clipped_queries", r"""
SELECT doc_id, CASE WHEN length(k) <= 240 THEN k ELSE trim(CASE WHEN instr(substr(k, 1, 240), ' ') > 0 AND 240 - instr(reverse(substr(k, 1, 240)), ' ') >= 144 THEN substr(substr(k, 1, 240), 1, 240 - instr(reverse(substr(k, 1, 240)), ' ')) ELSE substr(k, 1, 240) END) END AS query FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS k FROM documents)
""")
def f22(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.clip_words("text").alias("query"))


@query("f25_snippets", "SELECT conv_id, string_agg('[' || n || '] source=' || role || '; relevance=' || format('{:.2f}', turn::DOUBLE / 4) || '; text=' || substr(text, 1, 320), chr(10) ORDER BY n) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def f25(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("source"), (F.col("turn") / F.lit(4.0)).alias("relevance"), "text"))).alias("items"))
    return c.select("conv_id", X.snippets(F.col("items")).alias("snippets"))


@query("f27_numeric_ids", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS id FROM customer")
def f27(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", X.numeric_id("c_name").alias("id"))


@query("f29_verifier_answers", """
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'support' WHEN 1 THEN 'refute' WHEN 2 THEN 'neutral' WHEN 3 THEN 'refute' WHEN 4 THEN 'support' WHEN 5 THEN 'refute' WHEN 6 THEN 'neutral' WHEN 7 THEN 'refute' END AS verdict,
  CASE o_orderkey % 9 WHEN 0 THEN (o_custkey % 100)::DOUBLE / 100 WHEN 1 THEN 0.87 WHEN 2 THEN 0.25 WHEN 4 THEN 0.8 WHEN 7 THEN 0.73 ELSE 0.5 END::DOUBLE AS confidence,
  CASE o_orderkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN 'Well: {"label": "false", "confidence": 87%, "why": "a "b"' WHEN 2 THEN 'few, "sources' WHEN 3 THEN 'This is not supported at all' WHEN 4 THEN 'यह दावा सही है, 80% निश्चित' WHEN 5 THEN 'இது தவறு' WHEN 6 THEN 'అది సరిపడ ఆధారాలు లేవు' WHEN 7 THEN 'sources deny it' ELSE '----' END AS reason FROM orders
""")
def f29(spark, sf):
    k = F.col("o_orderkey") % 9
    strict = F.concat(F.lit('```json\n{"verdict": "supported", "confidence": '), ((F.col("o_custkey") % 100) / F.lit(100.0)).cast("string"), F.lit(', "reason": "x"}\n```'))
    others = [
        'Well: {"label": "false", "confidence": 87%, "why": "a "b"', 'decision = neutral; confidence = 25%, explanation="few, "sources"",} ', "This is not supported at all", "यह दावा सही है, 80% निश्चित", "இது தவறு", "అది సరిపడ ఆధారాలు లేవు",
        "It is not true, confidence: 0.73; reason given: sources deny it", "----",
    ]
    raw = F.when(k == 0, strict).otherwise(F.get(F.array(*[F.lit(x) for x in others]), (k - 1).cast("int")))
    return t(spark, sf, "orders").select("o_orderkey", A.verifier_answer(raw).alias("r")).select("o_orderkey", "r.verdict", "r.confidence", "r.reason")


@query("f31_line_updates", "SELECT o_custkey, n::INTEGER AS idx, (n::DOUBLE / 10) AS relevance, CASE n % 2 WHEN 0 THEN 'support' ELSE 'refute' END AS stance FROM (SELECT o_custkey, unnest(range(1, least(count(*), 5) + 1)) AS n FROM orders GROUP BY o_custkey)")
def f31(spark, sf):
    n = t(spark, sf, "orders").groupBy("o_custkey").agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("n"))
    line = lambda i: F.concat(F.lit("EVIDENCE "), i.cast("string"), F.lit(" | relevance="), (i / F.lit(10.0)).cast("string"), F.lit(" | stance="), F.when(i % 2 == 0, "support").otherwise("refute"), F.lit(" | reason=ok"))
    text = F.concat_ws("\n", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), line), "\n"), line(F.lit(1)), F.lit("end"))
    return A.line_updates(n.withColumn("t", text), "o_custkey", "t").select("o_custkey", "idx", "relevance", "stance")


_LOOSE = A.PLAIN_UPDATE.replace("'", "''")


@query("f31_plain_updates", f"""
WITH t AS (SELECT doc_id, 'items: idx = ' || doc_id % 5 || ', relevance: 0.' || doc_id % 9 || CASE doc_id % 3 WHEN 0 THEN ' Label: Support' ELSE ' stance = "refute"' END || CASE WHEN doc_id % 2 = 0 THEN ' conf: .75' ELSE '' END || ' why: ' || text || ' index: ' || doc_id % 4 || ' score=1 stance: neutral' AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_LOOSE}')) AS m, generate_subscripts(regexp_extract_all(t, '{_LOOSE}'), 1) AS n FROM t),
g AS (SELECT doc_id, n, regexp_extract(m, '{_LOOSE}', ['i', 'r', 's', 'c', 'y']) AS g FROM m)
SELECT doc_id, g.i::INTEGER AS idx, g.r::DOUBLE AS relevance, lower(g.s) AS stance, coalesce(try_cast(nullif(g.c, '') AS DOUBLE), 0.6::DOUBLE) AS confidence, trim(g.y, chr(32) || chr(9)) AS reason
FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, g.i::INTEGER ORDER BY n) = 1
""")
def f31b(spark, sf):
    i = F.col("doc_id")
    word = F.when(i % 3 == 0, " Label: Support").otherwise(' stance = "refute"')
    text = F.concat(F.lit("items: idx = "), (i % 5).cast("string"), F.lit(", relevance: 0."), (i % 9).cast("string"), word, F.when(i % 2 == 0, " conf: .75").otherwise(""), F.lit(" why: "), "text", F.lit(" index: "), (i % 4).cast("string"), F.lit(" score=1 stance: neutral"))
    return A.plain_updates(t(spark, sf, "documents").select("doc_id", text.alias("t")), "doc_id", "t")


@query("f32_nested_evidence", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' ' || n_name END AS text FROM nation")
def f32(spark, sf):
    trip = F.concat(F.lit('["p", "1", "'), F.col("n_name"), F.lit('"]'))
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("["), trip, F.lit("]"))).otherwise(F.concat(F.lit("[["), trip, F.lit(", "), trip, F.lit("]]")))
    return t(spark, sf, "nation").select("n_nationkey", A.fever_text(raw).alias("text"))


@query("p9_relaxed", r"""
SELECT doc_id, lang <> 'en' AND doc_id % 3 < 2 AND (doc_id % 100)::DOUBLE / 100 < 0.85 AND (trim(text) <> '' AND (regexp_matches(text, '[0-9]') OR regexp_matches(text, '(?:^|[^\p{L}\p{N}_])[A-Z][a-z]+(?:$|[^\p{L}\p{N}_])') OR len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) >= 10)) AS relaxed FROM documents
""")
def p9(spark, sf):
    label = F.when(F.col("doc_id") % 3 == 0, "opinion").when(F.col("doc_id") % 3 == 1, "Vague").otherwise("other")
    return t(spark, sf, "documents").select("doc_id", C.relax(F.col("lang"), label, (F.col("doc_id") % 100) / F.lit(100.0), F.col("text"), ("OPINION", "VAGUE")).alias("relaxed"))


@query("p15_several_claims", r"""
SELECT conv_id, turn, len(list_filter(list_transform(string_split_regex(text, '[\n\r]+|[.!?।]+|•|-{2,}'), lambda x: trim(x)), lambda x: length(x) >= 20 AND len(string_split_regex(x, '\s+')) >= 5)) >= 2 AS several FROM conversations
""")
def p15(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", C.several_claims("text").alias("several"))


@query("p24_blocked_retry", "SELECT o_orderkey, o_orderkey % 3 = 0 AS blocked, o_orderkey % 5 = 0 AS retry FROM orders")
def p24(spark, sf):
    k = F.col("o_orderkey")
    detail, error = F.when(k % 3 == 0, "Uncheckable: opinion").otherwise("checkable"), F.when(k % 5 == 0, "HTTP 429 Too Many Requests").otherwise("timeout")
    return t(spark, sf, "orders").select("o_orderkey", F.startswith(F.lower(detail), F.lit("uncheckable")).alias("blocked"), error.rlike("(?i)429|rate.?limit|too many requests").alias("retry"))


@query("p23_label_violations", _RUN + "SELECT count(*) FILTER (WHERE expected = 'neutral' AND NOT blocked) AS violations, count(*) AS total FROM run")
def p23(spark, sf):
    return run(spark, sf).agg(F.count_if((F.col("expected") == "neutral") & ~F.col("blocked")).alias("violations"), F.count("*").alias("total"))


@query("w6_pair_key", EV + "SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, lower(url), substr(norm, 1, 180) ORDER BY score DESC, pos) AS k FROM ev) WHERE k = 1")
def w6(spark, sf):
    return K.first_per_key(evidence(spark, sf), ["claim_id"], K.pair_key(180), [F.desc("score"), "pos"]).select("pos")


@query("w8_three_per_host", EV + "SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, CASE WHEN url <> '' THEN coalesce(nullif(split_part(url, '/', 3), ''), 'unknown') ELSE 'unknown' END ORDER BY pos) AS n FROM ev) WHERE n <= 3")
def w8(spark, sf):
    h = F.coalesce(F.nullif(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("")), F.lit("unknown"))
    return K.cap_per(evidence(spark, sf), ["claim_id"], h, 3, ["pos"]).select("pos")


@query("w13_split_sizes", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE k <= nt) AS n_test, count(*) FILTER (WHERE k > nt AND k <= nt + nv) AS n_val FROM (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS nt, greatest(1, round_even(n * 0.1, 0)) AS nv FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)) GROUP BY l_returnflag")
def w13(spark, sf):
    s = D.split(t(spark, sf, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], "w", val=0.1, test=0.2)
    return s.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("split") == "val").alias("n_val"))


@query("w15_language_order", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents")
def w15(spark, sf):
    return number(t(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], "place")


@query("k10_hybrid_order", EV + "SELECT claim_id, pos, row_number() OVER (PARTITION BY claim_id ORDER BY round(0.55::DOUBLE * relevance + 0.25::DOUBLE * score + 0.2::DOUBLE * greatest(sup, ref, neu), 6) DESC, pos) AS rank FROM ev")
def k10(spark, sf):
    s = F.round(S.hybrid_rank(F.col("relevance"), F.col("score"), F.greatest("p.support", "p.refute", "p.neutral")), 6)
    return C.with_rank(evidence(spark, sf).withColumn("s", s), ["claim_id"], [F.desc("s"), "pos"], "rank").select("claim_id", "pos", F.col("rank").cast("long").alias("rank"))


@query("k11_language_aware", EV + "SELECT claim_id, pos, row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN n = 0 OR a::DOUBLE / n >= 0.8 THEN relevance ELSE score END DESC, pos) AS rank, n = 0 OR a::DOUBLE / n >= 0.8 AS english FROM (SELECT *, len(regexp_extract_all(text, '\\p{L}')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM ev)")
def k11(spark, sf):
    e = evidence(spark, sf).withColumn("english", X.english_like("text")).withColumn("s", F.when(F.col("english"), F.col("relevance")).otherwise(F.col("score")))
    return C.with_rank(e, ["claim_id"], [F.desc("s"), "pos"], "rank").select("claim_id", "pos", F.col("rank").cast("long").alias("rank"), "english")


@query("k12_best_scrape", EV + f"""
SELECT claim_id, pos FROM (SELECT claim_id, pos, row_number() OVER (PARTITION BY claim_id ORDER BY (NOT (length(trim(text)) < 400 AND o < 0.06)) DESC, round(score + least(length(text), 4000)::DOUBLE / 4000 + 0.05 + 0.8 * o, 6) DESC, pos) AS k
FROM (SELECT *, CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(b) END AS o FROM (SELECT *, {tok('text')} AS a, {tok('claim')} AS b FROM ev WHERE type = 'scraping'))) WHERE k = 1
""")
def k12(spark, sf):
    e = evidence(spark, sf).where("type = 'scraping'").withColumn("o", X.overlap_ratio(X.token_set("text"), X.token_set("claim")))
    usable = ~((F.length(F.trim("text")) < 400) & (F.col("o") < 0.06))
    q = F.round(S.scrape_quality(F.col("score"), F.col("text"), F.col("title"), F.col("o"), F.lit(0.0)), 6)
    return K.top(e.withColumn("u", usable).withColumn("q", q), ["claim_id"], [F.desc("u"), F.desc("q"), "pos"], 1).select("claim_id", "pos")


@query("k13_verifier_input", EV + """
SELECT claim_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, pos) AS n, CASE claim_id % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'support' ELSE 'refute' END AS v, (claim_id % 10)::DOUBLE / 10 AS c FROM ev)
WHERE (v = 'neutral' AND pos % 2 = 0 AND relevance >= 0.86 AND score >= 0.65) OR (v <> 'neutral' AND c BETWEEN 0.35 AND 0.65 AND n <= 6)
""")
def k13(spark, sf):
    i = F.col("claim_id")
    e = evidence(spark, sf).withColumn("v", F.when(i % 3 == 0, "neutral").when(i % 3 == 1, "support").otherwise("refute")).withColumn("c", (i % 10) / F.lit(10.0)).withColumn("stance", F.when(F.col("pos") % 2 == 0, "neutral").otherwise("support")).withColumn("credibility", F.col("score"))
    return C.verifier_input(e, ["claim_id"], "v", "c", "pos").select("claim_id", "pos")


@query("j11_derangement", "SELECT n_nationkey, coalesce(lead(n_nationkey) OVER w, first_value(n_nationkey) OVER w) AS other_key FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY md5('d:' || n_nationkey), n_nationkey)")
def j11(spark, sf):
    return D.mismatched(t(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", "n_name", "d").select("n_nationkey", "other_key")


@query("u2_merged_sources", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['wiki', 'base', 'more'] ELSE ['base', 'more'] END AS sources FROM part")
def u2(spark, sf):
    own = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("wiki"), F.lit("base"))).otherwise(F.array().cast("array<string>"))
    return t(spark, sf, "part").select("p_partkey", F.array_union(own, F.array(F.lit("base"), F.lit("more"))).alias("sources"))


@query("s17_structured_quality", f"""
WITH t AS (SELECT doc_id, text, {tok("b.text")} AS c, {tok("d.text")} AS w, coalesce(nullif(regexp_extract(d.text, '{X.LEFT}([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}}){X.RIGHT}', 1), ''), '') AS e, {" OR ".join(f"regexp_matches(d.text, '{p}')" for p in X.DATE_PATTERNS)} AS dated, regexp_matches(d.text, '(?i){X.NUMERIC}') AS num FROM (SELECT doc_id, doc_id % 40 AS item_id, regexp_replace(text, '\\s+', ' ', 'g') || CASE doc_id % 3 WHEN 0 THEN ' 2021-03-04' WHEN 1 THEN ' five' ELSE ' 17 km' END AS text FROM documents) d JOIN benchmark b USING (item_id))
SELECT doc_id, round((0.55 * CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(w, c))::DOUBLE / len(c) END + CASE WHEN dated THEN 0.20 ELSE 0 END + CASE WHEN num THEN 0.15 ELSE 0 END + CASE WHEN e <> '' THEN 0.10 ELSE 0 END)::DOUBLE, 6) AS quality FROM t
""".replace("SELECT doc_id, text, ", "SELECT doc_id, "))
def s17(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, " 2021-03-04").when(F.col("doc_id") % 3 == 1, " five").otherwise(" 17 km")
    d = t(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.concat(F.regexp_replace("text", r"\s+", " "), tail).alias("text"))
    d = d.join(t(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim")), "item_id")
    q = S.structured_quality(X.overlap_ratio(X.token_set("text"), X.token_set("claim")), X.first_date("text"), X.numeric_claim("text"), X.entity("text"))
    return d.select("doc_id", F.round(q, 6).alias("quality"))


_FIRST = "coalesce({}, '')".format(", ".join(f"nullif(regexp_extract(x, '{p}', 1), '')" for p in X.DATE_PATTERNS))


@query("s17_enriched_rows", EV + SPAN + f"""
, t AS (SELECT *, CASE WHEN span <> '' THEN span ELSE trim(text) END AS x FROM sn WHERE trim(text) <> ''),
u AS (SELECT *, coalesce(trim(regexp_extract(x, '{X.LEFT}([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}}){X.RIGHT}', 1)), '') AS entity, {_FIRST} AS date, coalesce(trim(regexp_extract(x, '(?i){X.NUMERIC}', 1)), '') AS numeric_claim, CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect({tok('x')}, c))::DOUBLE / len(c) END AS o FROM t),
q AS (SELECT *, 0.55::DOUBLE * o + CASE WHEN date <> '' THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN numeric_claim <> '' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN entity <> '' THEN 0.10::DOUBLE ELSE 0 END AS quality FROM u)
SELECT pos, CASE WHEN length(span) >= 60 THEN span ELSE text END AS text, span AS fact_span, entity, date, numeric_claim, round(quality, 6) AS quality, quality >= 0.62 AS structured_from_scrape FROM q
UNION ALL SELECT pos, text, NULL, NULL, NULL, NULL, NULL, NULL FROM sn WHERE trim(text) = ''
""")
def s17b(spark, sf):
    """What is found in whole scraped texts, and the text that goes on."""
    e = S.enriched(evidence(spark, sf).select("pos", "claim", "text"))
    return e.select("pos", "text", "fact_span", "entity", "date", "numeric_claim", F.round("scrape_struct_quality", 6).alias("quality"), "structured_from_scrape")


@query("a10_binary_counts", _RUN + "SELECT count(*) FILTER (WHERE expected = 'support' AND post = 'support') AS tp, count(*) FILTER (WHERE expected = 'refute' AND post = 'refute') AS tn, count(*) FILTER (WHERE expected <> 'support' AND post = 'support') AS fp, count(*) FILTER (WHERE expected = 'support' AND post <> 'support') AS fn FROM run")
def a10(spark, sf):
    return run(spark, sf).agg(*E.binary_counts(F.col("expected"), F.col("post")))


@query("a22_class_metrics_all", _RUN + """, g AS (SELECT l, count(*) FILTER (WHERE e = l)::DOUBLE AS s, count(*) FILTER (WHERE p = l)::DOUBLE AS c, count(*) FILTER (WHERE e = l AND p = l)::DOUBLE AS tp FROM (SELECT expected AS e, post AS p FROM run), (VALUES ('support'), ('refute'), ('neutral')) v(l) GROUP BY l)
SELECT sum(s)::BIGINT AS total, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(CASE WHEN s + c > 0 THEN 2 * tp / (s + c) ELSE 0 END), 6) AS macro_f1 FROM g""")
def a22(spark, sf):
    return E.class_metrics(run(spark, sf), "expected", "post").select("total", "accuracy", "macro_f1")


@query("a25_distributions", _RUN + "SELECT lang, expected, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM run GROUP BY 1, 2")
def a25(spark, sf):
    from pyspark.sql import Window as W

    n = E.counts(run(spark, sf), "lang", "expected")
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6))


@query("a30_smallest_class", "SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality, toxic)")
def a30(spark, sf):
    return E.counts(t(spark, sf, "labels"), "quality", "toxic").agg(F.min("n").alias("n"))


@query("f3_loose_host", "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages")
def f3(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.loose_host(F.regexp_replace("url", "^https://", "")).alias("host"))


@query("src18_web_rows", "SELECT conv_id, turn, trim(role || ' ' || text) AS text, CASE WHEN turn % 2 = 0 THEN role ELSE 'NewsAPI' END AS title, role AS source, 'https://n.org/' || conv_id AS url, 0.5::DOUBLE AS score, 'web_search' AS type, 'newsapi' AS search_provider FROM conversations")
def src18(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("description"), F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("headline"), F.struct(F.col("role").alias("name")).alias("source"), F.concat(F.lit("https://n.org/"), "conv_id").alias("url"))
    return P.web_rows(c.withColumnRenamed("headline", "title"), "newsapi").drop("description", "content")


@query("src19_structured_rows", "SELECT n_nationkey, n_name || ' (' || n_regionkey || ')' AS text, 'World Bank: World Bank' AS source, 'https://api.worldbank.org/v2/indicator/' || n_regionkey || '?format=json' AS url, 0.9::DOUBLE AS score, 'structured_api' AS type FROM nation")
def src19b(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("id"))
    return P.structured_rows(n, "worldbank").select("n_nationkey", "text", "source", "url", "score", "type")


@query("plan_analyze")
def plan_analyze(spark, sf):
    """All stages, over claims of two languages and the evidence of this module's tables."""
    from .plans.analyze import Settings, analyze
    from .queries import DOWN, EVEN, POLICY, TABLE, UP

    e = evidence(spark, sf)
    claims = t(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("hi").alias("lang"))
    rows = e.select("claim_id", "pos", "text", "title", "source", "url", "type", F.col("score").cast("string").alias("score"), F.lit("2024-05-06").alias("date"))
    return analyze(claims, rows, Settings(policy=POLICY, credibility=tuple(TABLE), support=tuple(UP), refute=tuple(DOWN), neutral=tuple(EVEN)))


def _article_sql() -> str:
    """SQL of article rows: the same patterns, and the best run by a fold over the blocks."""
    from .operators import articles as R

    lit = lambda x: "'" + x.replace("'", "''") + "'"
    sp = "[ \\t\\n\\r\\f]"
    h = "regexp_replace(translate(coalesce(html, ''), chr(1) || chr(2) || chr(3), ''), '(?s)<!--.*?-->', ' ', 'g')"
    h = f"regexp_replace({h}, '{R.DROP}', chr(1), 'g')"
    h = f"regexp_replace(regexp_replace({h}, '(?i)<a(?:{sp}[^>]*)?>', chr(2), 'g'), '(?i)</a{sp}*>', chr(3), 'g')"
    h = f"regexp_replace({h}, '(?i)</?(?:{'|'.join(R.BLOCKS)})(?:[ \\t\\n\\r\\f/][^>]*)?>', chr(1), 'g')"
    h = f"regexp_replace({h}, '<[^>]*>', '', 'g')"
    for a, b in R.ENTITIES:
        h = f"replace({h}, {lit(a)}, {lit(b)})"
    flat = lambda x: f"trim(regexp_replace({x}, '{sp}+', ' ', 'g'))"
    plain = flat("regexp_replace(b, '\\x02[^\\x03]*\\x03?', ' ', 'g')")
    text = flat("translate(b, chr(2) || chr(3), '')")
    return f"""
WITH m AS (SELECT page_id, url, string_split({h}, chr(1)) AS l FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(l, lambda b: {{'t': {text}, 'plain': length({plain})}}), lambda x: x.t <> '') AS b FROM m),
g AS (SELECT *, list_transform(b, lambda x: x.plain - {R.LINK_COST} * greatest(length(x.t) - x.plain, 0) - {R.BLOCK_COST}) AS g FROM b),
s AS (SELECT *, list_reduce(list_transform(g, lambda x: {{'g': x, 'at': 0, 'sum': 0, 'start': 0, 'best': 0, 'first': 0, 'last': 0}}), lambda s, x: {{'g': x.g, 'at': s.at + 1,
  'sum': CASE WHEN s.sum <= 0 THEN x.g ELSE s.sum + x.g END, 'start': CASE WHEN s.sum <= 0 THEN s.at ELSE s.start END,
  'best': CASE WHEN CASE WHEN s.sum <= 0 THEN x.g ELSE s.sum + x.g END > s.best THEN CASE WHEN s.sum <= 0 THEN x.g ELSE s.sum + x.g END ELSE s.best END,
  'first': CASE WHEN CASE WHEN s.sum <= 0 THEN x.g ELSE s.sum + x.g END > s.best THEN CASE WHEN s.sum <= 0 THEN s.at ELSE s.start END ELSE s.first END,
  'last': CASE WHEN CASE WHEN s.sum <= 0 THEN x.g ELSE s.sum + x.g END > s.best THEN s.at + 1 ELSE s.last END}}, {{'g': 0, 'at': 0, 'sum': 0, 'start': 0, 'best': 0, 'first': 0, 'last': 0}}) AS r FROM g)
SELECT page_id, substr(array_to_string(list_transform(list_filter(b[r.first + 1 : r.last], lambda x: greatest(length(x.t) - x.plain, 0) <= x.plain), lambda x: x.t), chr(10)), 1, {R.MOST}) AS text, coalesce(url, '') AS url, {R.SCORE}::DOUBLE AS score, 'scraping' AS type, 'article' AS scrape_method
FROM s WHERE r.best > 0
"""


@query("src16_article", _article_sql())
def src16(spark, sf):
    from .operators.articles import article_rows

    return article_rows(t(spark, sf, "pages"), ["page_id"]).select("page_id", "text", "url", "score", "type", "scrape_method")


@query("x4_summaries")
def x4(spark, sf):
    """No SQL: an iteration over each document's own graph. Tests hold it against a walk over a table of pairs."""
    from .operators.summaries import summaries

    d = summaries(t(spark, sf, "documents"), ["doc_id"])
    return d.select("doc_id", F.array_join(F.transform("positions", lambda k: k.cast("string")), ",").alias("positions"), "summary")
