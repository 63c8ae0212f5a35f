"""The pipeline and language inference against plain versions that know nothing of their shortcuts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from claimloom.llm import language_id as LI
from claimloom.llm import secret_scan as SS
from claimloom.llm import tokens as T


def plain_groups(rows):
    """The smallest id of each group of near-duplicates, by comparing all pairs that share a shingle."""
    sets, holders = {}, {}
    for r in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower())
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for s in sets[r["doc_id"]]:
            holders.setdefault(s, []).append(r["doc_id"])
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, s in sets.items():
        for b in {b for g in s for b in holders[g] if b < a}:
            if 100 * len(s & sets[b]) >= 75 * len(s | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {find(k) for k in sets}


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, left, total = {}, set(sizes), sum(sizes.values())
    while True:
        room, sum_w = total - sum(fixed.values()), sum(weight[s] for s in left)
        over = {s for s in left if room * weight[s] / sum_w > cap * sizes[s]} if sum_w else set()
        if not over:
            return fixed | {s: room * weight[s] / sum_w for s in left}
        fixed |= {s: cap * sizes[s] for s in over}
        left -= over


def test_pipeline_equals_plain_version(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in docs if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    kept = plain_groups(rows)
    rows = [r for r in rows if r["doc_id"] in kept]
    for r in rows:
        spans = sorted((s, e) for _, s, e, *_ in SS.find(r["text"]))
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [r["text"][at:s], "<secret>"]
            at = max(at, e)
        r["text"] = "".join(out) + r["text"][at:]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    sources = Counter()
    for r in rows:
        sources[r["source"]] += size[r["doc_id"]]
    targets = plain_targets(dict(sources))
    lib = Tokenizer.from_file(T.vocabulary())
    want = Counter()
    for r in rows:
        n = size[r["doc_id"]]
        rate = min(targets[r["source"]] / sources[r["source"]], 3.0) if sources[r["source"]] else 0.0
        draw = int(hashlib.md5(f"17:{r['doc_id']}:{n}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (draw < rate - math.floor(rate))
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        if copies:
            want[r["doc_id"], r["source"], len(ids), sha, back] += copies
    got = P.run(spark, sf).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    lang = {r["doc_id"]: r["lang"] for r in docs if r["lang"]}
    assert all(r.lang == lang.get(r.doc_id, r.lang) and r.lang for r in got)


def plain_infer(text, langs, logs, penalty=4.0, rounds=12):
    """Expectation-maximisation over one text's trigrams, one by one."""
    c = LI.CLASSES[np.frombuffer(b" " + text + b"  ", dtype=np.uint8)].tolist()
    bag = Counter((c[i - 1], c[i], c[i + 1]) for i in range(1, len(text) + 1) if c[i])
    total = sum(bag.values())
    chosen = {max(range(len(langs)), key=lambda j: sum(n * math.log(logs(g, j)) for g, n in bag.items())): 1.0}
    likely = lambda pi: sum(n * math.log(sum(p * logs(g, j) for j, p in pi.items())) for g, n in bag.items())
    while len(chosen) < len(langs):
        slope = {j: sum(n * logs(g, j) / sum(p * logs(g, k) for k, p in chosen.items()) for g, n in bag.items()) for j in range(len(langs)) if j not in chosen}
        new = max(slope, key=lambda j: (slope[j], -j))
        pi = {j: 0.8 * p for j, p in chosen.items()} | {new: 0.2}
        for _ in range(rounds):
            sums = dict.fromkeys(pi, 0.0)
            for g, n in bag.items():
                mixed = sum(p * logs(g, j) for j, p in pi.items())
                for j, p in pi.items():
                    sums[j] += n * p * logs(g, j) / mixed
            pi = {j: s / total for j, s in sums.items()}
        if likely(pi) - likely(chosen) <= penalty * math.log(total + 1):
            break
        chosen = pi
    return chosen


def test_inference_equals_plain_expectation_maximisation(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(120).collect()]
    langs, probs = LI.train(spark.createDataFrame([(r["text"], r["lang"]) for r in docs], "text string, lang string"))
    of = lambda g, j: probs[(g[0] * LI.K + g[1]) * LI.K + g[2], j]
    by = {x: [r["text"][:300] for r in docs if r["lang"] == x and len(r["text"]) > 300] for x in langs}
    texts = [t for x in langs for t in by[x][:2]]
    for n in (2, 3, 4):
        texts.append(" ".join(by[x][2] for x in langs[:n] if len(by[x]) > 2))
    share, _ = LI.infer([t.encode() for t in texts], probs, 4.0, 12)
    for k, t in enumerate(texts):
        want = plain_infer(t.encode(), langs, of)
        assert {j for j in range(len(langs)) if share[k, j] > 0} == set(want)
        assert all(share[k, j] == pytest.approx(p, abs=1e-6) for j, p in want.items())
    assert max((share > 0).sum(1)) >= 2
