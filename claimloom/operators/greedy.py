"""Order-dependent selections within one claim or document, as pandas functions over its rows.

Each group is one claim's or document's candidates, which retrieval bounds; greedy rules need them together.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_hexdigest

from ..plans.session import ship, staged
from .links import BROADCAST_NODES, components, number, similar_sets, small

#: Rows and characters of a claim up to which its near duplicates are decided in one frame.
FRAME_ROWS, FRAME_CHARS = 20_000, 16 << 20
#: Rows of a group whose head may be decided first, and by how much heads grow and are smaller than what is left of them.
HEAD_ROWS, HEAD_STEP = 20_000, 8

_TOKENS = re.compile("[A-Za-zऀ-ൿ]{3,}")
_NUMBERS, _NAMES = re.compile(r"\d+"), re.compile("[A-Z][a-z]+")
_CLAIM_TOKENS = re.compile("[A-Za-zऀ-ൿ0-9%]+")


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def similarity(a: str, b: str) -> float:
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both = len(x & y)
    return max(both / len(x | y), both / len(x), both / len(y))


def _per_group(rows: DataFrame, by: str, pos: str, order) -> DataFrame:
    """rows, each group sorted by pos and passed to order(frame) -> positions in their new order; adds `place` from 1."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos, kind="stable").reset_index(drop=True)
        picked = order(frame)
        out = frame.iloc[picked].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    ship(rows.sparkSession)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(by).applyInPandas(run, f"{names}, place long")


def _in_order(rows: DataFrame, by: str, pos: str, text: str, choose) -> DataFrame:
    """rows that choose(texts of a group by pos) -> places picks, in its order; adds `place` from 1. Groups follow each other
    in sorted partitions: a task reads batches and holds one group at a time, without a frame or a call to Spark for each."""
    names = [f.name for f in rows.schema]

    def picked(group: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(group).combine_chunks()
        chosen = choose(table.column(text).to_pylist())
        if not chosen:
            return []
        out = table.take(pa.array(chosen, pa.int64())).append_column("place", pa.array(range(1, len(chosen) + 1), pa.int64()))
        return out.combine_chunks().to_batches()

    def run(batches) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        for b in batches:
            keys, start, made = b.column(by).to_pylist(), 0, []
            for i, k in enumerate(keys):
                if group or i > start:
                    if k != now:
                        if i > start:
                            group.append(b.slice(start, i - start))
                        made += picked(group)
                        group, start, now = [], i, k
                else:
                    now = k
            group.append(b.slice(start))
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        if group:
            yield from picked(group)

    ship(rows.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(by).sortWithinPartitions(by, F.col(pos).asc_nulls_last()).mapInArrow(run, f"{kinds}, place long")


def mmr(rows: DataFrame, by: str, pos: str, most: int, lam: float = 0.75, pool: int = 3, score: str = "score", text: str = "text", title: str = "title", source: str = "source") -> DataFrame:
    """Maximal marginal relevance: lam * score less (1 - lam) times the likeness to what is picked; the rest follows in order.

    Only the first most * pool rows of a group compete, so only they come together; the others keep their places.
    """

    def order(f: pd.DataFrame) -> list[int]:
        cap = len(f)
        tokens = [set(_TOKENS.findall(f"{a or ''} {b or ''} {c or ''}".lower())) for a, b, c in zip(f[title][:cap], f[source][:cap], f[text][:cap], strict=True)]
        scores = f[score].fillna(0.0).tolist()
        picked, left, worst = [], list(range(cap)), [0.0] * cap
        while left and len(picked) < most:
            best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * worst[i], -i))
            picked.append(best)
            left.remove(best)
            for i in left:
                worst[i] = max(worst[i], _jaccard(tokens[i], tokens[best]))
        return picked + left

    cap = max(0, most) * max(1, pool)
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.asc_nulls_last(pos))).cast("long"))
    return _per_group(placed.where(F.col("place") <= cap).select(rows.columns), by, pos, order).unionByName(placed.where(F.col("place") > cap))


def diversity(rows: DataFrame, by: str, pos: str, most: int, per_host: int, host: str = "host", title_key: str = "title_key") -> DataFrame:
    """Two passes in order: at most per_host rows a host and one a title, then more of any host while titles are new."""

    def order(f: pd.DataFrame) -> list[int]:
        picked, hosts, titles = [], {}, set()
        for strict in (True, False):
            for i, (h, t) in enumerate(zip(f[host].fillna(""), f[title_key].fillna(""), strict=True)):
                if len(picked) >= most:
                    return picked
                if (not strict and i in seen) or (strict and h and hosts.get(h, 0) >= per_host) or (t and t in titles):
                    continue
                picked.append(i)
                hosts[h] = hosts.get(h, 0) + 1
                if t:
                    titles.add(t)
            seen = set(picked)
        return picked

    return _per_group(rows, by, pos, order)


def drop_similar(rows: DataFrame, by: str, pos: str, above: float = 0.90, url: str = "url", text: str = "text", score: str = "score", frame_rows: int = FRAME_ROWS) -> DataFrame:
    """Rows in order, less those with a URL seen or a text more than `above` like a kept one's. A duplicate of a higher score
    takes the kept one's place, at the end and without its URL counting as seen.

    A text is more than `above` like another if more than that share of the smaller word set is in the larger one: then one
    of any (1 - above) * size + 1 words of the smaller is in the larger, so that only texts that share one of the smaller's
    rarest such words are compared. `above` is 0 or more. Groups of up to frame_rows rows and FRAME_CHARS characters are
    frames; the texts of larger ones are joined by similarity over all tasks, and only their links decided in order
    (`_similar_rows`). Both give the same rows.
    """
    is_large = F.col(by).eqNullSafe(F.col("_large"))
    sizes = staged(rows.groupBy(by).agg(F.count("*").alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > frame_rows).select(F.col(by).alias("_large"))
    if not (others := sizes.where(F.col("_n") <= frame_rows).select(F.col(by).alias("_large"))).isEmpty():
        # characters are only summed where the number of rows does not tell
        chars = (rows if large.isEmpty() else rows.join(small(others), is_large, "left_semi")).groupBy(by).agg(F.sum(F.length(text)).alias("_chars"))
        large = large.unionByName(staged(chars.where(F.col("_chars") > FRAME_CHARS).select(F.col(by).alias("_large")), "large"))
    n = large.count()
    if not n:
        return _drop_in_frames(rows, by, pos, above, url, text, score)
    if n == sizes.count():
        return _similar_rows(rows, by, pos, above, url, text, score)
    large = small(large)
    rest = rows.join(large, is_large, "left_anti")
    return _drop_in_frames(rest, by, pos, above, url, text, score).unionByName(_similar_rows(rows.join(large, is_large, "left_semi"), by, pos, above, url, text, score))


def _similar_rows(rows: DataFrame, by: str, pos: str, above: float, url: str, text: str, score: str) -> DataFrame:
    """drop_similar by links: rows that are equal or similar in text or equal in URL, directly or by others, are a component;
    what is kept of one depends on nothing outside of it.

    Where many rows share few URLs, the head of a group is decided first, by itself, as no later row changes it. A later row
    with a URL that it leaves as seen is dropped whatever its text, and changes nothing, so that only the others meet. Heads
    grow by HEAD_STEP while they leave too many.
    """
    ship(rows.sparkSession)
    # a row is known by its group and place, so that its text is not written; where that is not unique, by a number
    rows = rows.withColumn("_row", F.xxhash64(by, pos))
    if not rows.groupBy("_row").count().where("count > 1").isEmpty():
        rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    plain = [F.col(by).alias("_by"), F.col("_row"), F.col(pos).alias("_pos"), F.coalesce(score, F.lit(0.0)).cast("double").alias("_score"), F.xxhash64(by, F.coalesce(url, F.lit(""))).alias("_url"), (F.coalesce(url, F.lit("")) != "").alias("_has")]
    full = rows.select(*plain, F.xxhash64(by).alias("_g"), F.coalesce(text, F.lit("")).alias("_text"))
    thin = staged(rows.select(*plain), "thin")
    order = [F.col("_pos").asc_nulls_last(), F.col("_row").asc()]
    part, step = thin, 4.0
    while True:
        of = part.groupBy(F.col("_by").alias("_of")).agg(F.count("*").alias("n"), F.sum(F.col("_has").cast("int")).alias("has"), F.count_distinct(F.when(F.col("_has"), F.col("_url"))).alias("urls"), (F.max("_place") if step > 4 else F.count("*")).alias("last"))
        of = staged(of.where((F.col("n") > HEAD_ROWS) & (2 * (F.col("has") - F.col("urls")) >= F.col("n")) & (F.col("has") >= HEAD_STEP * step * F.col("urls"))).select("_of", (step * F.col("urls") / F.col("has") * F.col("last")).alias("_head")), "heads")
        if of.isEmpty():
            break
        if step == 4:
            part = staged(number(part, ["_by"], order, "_place"), "places")
        part = part.join(small(of), F.col("_by").eqNullSafe(F.col("_of")), "left").drop("_of")
        head = staged(part.where("_place <= _head"), "head")
        seen = head.where("_has").join(_decided(full, head, above).where("seen").select("_row"), "_row", "left_semi").select(F.col("_url").alias("_seen")).distinct()
        gone = F.col("_has") & (F.col("_url") == F.col("_seen")) & (F.col("_place") > F.col("_head"))
        part, step = staged(part.join(small(staged(seen, "seen")), gone, "left_anti").drop("_head"), "unseen"), step * HEAD_STEP
    kept = _decided(full, None if part is thin else part, above).where("kept").select("_row")
    placed = number(thin.select("_by", "_pos", "_row").join(kept, "_row"), ["_by"], order, "place")
    return rows.join(placed.select("_row", "place"), "_row").drop("_row")


def _decided(full: DataFrame, part: DataFrame | None, above: float) -> DataFrame:
    """(_row, kept, seen) of the rows of full, or of those of part alone, that are kept in the end or leave their URL as seen.

    Equal word sets are one node, similar ones are linked by a join, and every component is read in order by one task, as
    numbers alone: a row's score, URL, node and the nodes linked to it. What that task holds is what it has kept and seen.
    """
    plain = ["_row", "_pos", "_score", "_url", "_has", "_g"]

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        # words are 64-bit hashes; a text without words is like nothing, not even another one
        for b in batches:
            keys, sets = [], []
            for row, g, t in zip(*(b.column(c).to_pylist() for c in ("_row", "_g", "_text")), strict=True):
                x = np.sort(np.fromiter(map(xxh3_64_intdigest, set(t.lower().split())), np.uint64)).view(np.int64)
                keys.append(xxh3_128_hexdigest(x.tobytes(), g % (1 << 64)) if len(x) else f"row {row}")
                sets.append(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array(keys, pa.string()), pa.array(sets, pa.list_(pa.int64()))], [*plain, "_key", "words"])

    full = full if part is None else full.join(small(part.select("_row")), "_row", "left_semi")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.select(plain).schema)
    thin = staged(full.select(*plain, "_text").mapInArrow(hashed, f"{kinds}, _key string, words array<long>").withColumn("_id", F.monotonically_increasing_id()), "words")
    nodes = staged(thin.groupBy("_key").agg(F.min("_id").alias("node"), F.count("*").alias("n")), "nodes")
    # a node's set is that of its first row
    firsts = nodes.where("n > 1").select("_key", "node")
    later = thin.join(small(firsts), "_key").where("_id <> node").select("_id")
    sets = thin.join(small(staged(later, "later"), BROADCAST_NODES), "_id", "left_anti").select(F.col("_id").alias("node"), F.col("_g").alias("g"), "words").where("size(words) > 0")
    edges = staged(similar_sets(sets, above), "similar")
    of = staged(thin.select("_key", "_id", "_row", "_pos", "_score", "_url", "_has").join(nodes, "_key").drop("_key"), "of")
    urls = of.where("_has").groupBy("_url").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1")
    shared = of.where("_has").join(staged(urls, "urls"), "_url").select(F.col("node").alias("a"), "b")
    comps = staged(components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(shared)), "comps")
    single = of.where("n = 1").join(comps, "node", "left_anti").select("_row", F.lit(True).alias("kept"), F.col("_has").alias("seen"))
    near = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy(F.col("x").alias("node")).agg(F.collect_list("y").alias("near"))
    linked = of.join(comps, "node", "left").join(near, "node", "left").where("n > 1 OR comp IS NOT NULL").select(F.coalesce("comp", "node").alias("comp"), "_pos", "_row", "node", F.when(F.col("_has"), F.col("_url")).alias("url"), "_score", F.coalesce("near", F.array().cast("array<long>")).alias("near"))

    def decide(batches) -> Iterator[pa.RecordBatch]:
        now, kept, seen, where = None, {}, {}, {}  # kept: row -> (node, score); seen: URL -> its row; where: node -> its kept rows

        def ended(comps: list[tuple[dict, dict]]) -> pa.RecordBatch:
            out = [(r, r in k, r in s) for k, u in comps for s in (set(u.values()),) for r in k.keys() | s]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or ((),) * 3, (pa.int64(), pa.bool_(), pa.bool_()), strict=True)], ["_row", "kept", "seen"])

        for b in batches:
            done = []
            for comp, row, node, link, value, others in zip(*(b.column(c).to_pylist() for c in ("comp", "_row", "node", "url", "_score", "near")), strict=True):
                if comp != now:
                    done.append((kept, seen))
                    now, kept, seen, where, step = comp, {}, {}, {}, 0
                if link is not None and link in seen:
                    continue
                step += 1
                twin = min((r for n in (node, *others) for r in where.get(n, ())), key=lambda r: kept[r][2], default=None)
                if twin is None:
                    if link is not None:
                        seen[link] = row
                elif value > kept[twin][1]:
                    where[kept[twin][0]].remove(twin)
                    del kept[twin]
                else:
                    continue
                kept[row] = (node, value, step)
                where.setdefault(node, set()).add(row)
            yield ended(done)
        yield ended([(kept, seen)])

    ordered = linked.repartition("comp").sortWithinPartitions("comp", F.col("_pos").asc_nulls_last(), "_row").select("comp", "_row", "node", "url", "_score", "near")
    return staged(single.unionByName(ordered.mapInArrow(decide, "_row long, kept boolean, seen boolean")), "decided")


def _drop_in_frames(rows: DataFrame, by: str, pos: str, above: float, url: str, text: str, score: str) -> DataFrame:
    """drop_similar with each group as one table. A word is a number of 4 bytes, which the text's sets and the lists of rows
    with a word hold; words of one row alone make no list."""

    def order(texts: list[str], links: list[str], scores: list[float]) -> list[int]:
        number: dict[str, int] = {}
        sets = [np.unique(np.fromiter((number.setdefault(w, len(number)) for w in set(t.lower().split())), np.int32)) for t in texts]
        often = np.zeros(len(number), np.int32)
        del number
        for x in sets:
            often[x] += 1
        kept, urls, stamp = {}, set(), 0  # row -> its place in the order of what is kept
        by_word, by_rare = {}, {}
        for i, x in enumerate(sets):
            if links[i] and links[i] in urls:
                continue
            n = len(x)
            rare = x[np.argsort(often[x], kind="stable")[: math.floor((1 - above) * n + 1e-6) + 1]]
            rare, shared = rare[often[rare] > 1].tolist(), x[often[x] > 1].tolist()
            near = {j for w in rare for j in by_word.get(w, ())} | {j for w in shared for j in by_rare.get(w, ())}
            words = set(shared)
            twin = next((j for j in sorted(near & kept.keys(), key=kept.get) if sum(w in words for w in sets[j].tolist()) / min(n, len(sets[j])) > above), None)
            if twin is None:
                if links[i]:
                    urls.add(links[i])
            elif scores[i] > scores[twin]:
                del kept[twin]
            else:
                continue
            kept[i] = stamp = stamp + 1
            for lists, of in ((by_word, shared), (by_rare, rare)):
                for w in of:
                    if w in lists:
                        lists[w].append(i)
                    else:
                        lists[w] = array("i", (i,))
        return list(kept)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(pos, "ascending")]))
        filled = lambda c, v: [v if x is None else x for x in table.column(c).to_pylist()]
        picked = order(filled(text, ""), filled(url, ""), filled(score, 0.0))
        return table.take(pa.array(picked, pa.int64())).append_column("place", pa.array(range(1, len(picked) + 1), pa.int64()))

    ship(rows.sparkSession)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(by).applyInArrow(run, f"{names}, place long")


def _unlike(texts: Iterable[str], at_least: float, most: int) -> dict[int, str]:
    """The first `most` texts, by their places, whose tokens are less than at_least like those of each before; no text after
    these is asked for."""
    kept, tokens, keys = {}, [], set()
    for i, s in enumerate(texts):
        key = " ".join((s or "").lower().split())
        if key in keys:
            continue
        t = set(_CLAIM_TOKENS.findall(key))
        n = len(t)
        for o in tokens:
            if min(n, len(o)) > (at_least - 0.01) * max(n, len(o)) and (both := len(t & o)) / ((n + len(o) - both) or 1) >= at_least:
                break
        else:
            keys.add(key)
            tokens.append(t)
            kept[i] = s
            if len(kept) >= most:
                break
    return kept


def distinct_claims(rows: DataFrame, by: str, pos: str, text: str = "sentence", at_least: float = 0.78, most: int = 20) -> DataFrame:
    """Candidates in order, less those whose tokens are at_least like a kept one's; the first `most` for each document."""
    return _in_order(rows, by, pos, text, lambda texts: list(_unlike(texts, at_least, most)))


def distinct_sentences(sentences: Column, fewest: int, longest: int, at_least: float = 0.78, most: int = 20) -> Column:
    """array<string>: what `distinct_claims` keeps of a document's sentences, structs (sentence, n of words, ok), and, after
    them, of neighbours joined by a space that have fewest to longest words together. What is not ok, and joined ones of which
    none is, do not take part. The document stays a row, and only what is looked at is joined."""

    def candidates(s: list[str], n: list[int], ok: list[bool]) -> Iterator[str]:
        yield from (s[i] for i in range(len(s)) if ok[i])
        yield from (f"{s[i - 1]} {s[i]}" for i in range(1, len(s)) if (ok[i - 1] or ok[i]) and fewest <= n[i - 1] + n[i] <= longest)

    def run(rows: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)).tolist()
        s, n, ok = (x.to_pylist() for x in rows.flatten().flatten())
        kept = [list(_unlike(candidates(s[a:b], n[a:b], ok[a:b]), at_least, most).values()) for a, b in zip([0, *ends], ends)]
        return pa.array(kept, pa.list_(pa.string()))

    ship(SparkSession.active())
    return F.arrow_udf(run, "array<string>")(sentences)


def informative_claims(rows: DataFrame, by: str, pos: str, text: str = "sentence", overlap: float = 0.60, most: int = 2) -> DataFrame:
    """The most informative candidates (numbers, capitals, length) that do not repeat each other: by shared words over the
    smaller set, by matching subsequences, or one within the other."""

    def order(texts: list[str | None]) -> list[int]:
        texts = [t or "" for t in texts]
        value = [2 * len(_NUMBERS.findall(t)) + len(_NAMES.findall(t)) + min(len(t.split()), 30) / 10 for t in texts]
        kept: list[tuple[int, str, set, SequenceMatcher]] = []
        for i in sorted(range(len(texts)), key=lambda i: (-value[i], i)):
            a = texts[i].lower()
            x = set(a.split())
            if not x:
                continue
            for _, b, y, m in kept:
                if len(x & y) / min(len(x), len(y)) >= overlap or a in b or b in a:
                    break
                # the cheap upper bounds come first; b is taken apart once
                m.set_seq1(a)
                if m.real_quick_ratio() >= overlap and m.quick_ratio() >= overlap and m.ratio() >= overlap:
                    break
            else:
                kept.append((i, a, x, SequenceMatcher(None, "", a)))
            if len(kept) >= most:
                break
        return [i for i, *_ in kept]

    return _in_order(rows, by, pos, text, order)
