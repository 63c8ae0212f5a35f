"""Language identification by mixture inference over byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, set_aside, small_batches, utf8

UND = "und"
#: Longer texts are counted slice by slice.
SLICE = 4 << 20


def _byte_classes() -> np.ndarray:
    """0 for ASCII other than letters, 1-26 for letters of either case, 27-58 for bytes that continue a character (two of
    them each), 59 and more for bytes that begin one: each has its own class, but for those of rare scripts."""
    t = np.zeros(256, dtype=np.int32)
    for k in range(26):
        t[65 + k] = t[97 + k] = 1 + k
    t[128:192] = 27 + (np.arange(128, 192) & 31)
    now = 58
    for b in range(192, 256):
        if b in ALONE or b - 1 in ALONE or b == 192:
            now += 1
        t[b] = now
    return t


#: First bytes of the characters of widely used scripts: Latin (C3-C5), Greek, Cyrillic, Hebrew, Arabic, and E0-EF.
ALONE = frozenset([*range(0xC3, 0xC6), 0xCE, 0xCF, 0xD0, 0xD1, 0xD7, 0xD8, 0xD9, *range(0xE0, 0xEA)])
CLASSES = _byte_classes()
K = int(CLASSES.max()) + 1
V = K**3


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every trigram around a letter byte its text's number and its index; for every text whether it has an ASCII letter."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b"  ", dtype=np.uint8)
    c = CLASSES[buf]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(x) + 1 for x in texts])
    mid = c[1 : 1 + len(owner)]
    at = np.flatnonzero(mid)
    index = (c[at] * K + mid[at]) * K + c[at + 2]
    ascii_letter = np.zeros(len(texts), dtype=bool)
    ascii_letter[owner[at[mid[at] < 27]]] = True
    return owner[at], index.astype(np.int64), ascii_letter


def bags(texts: list[bytes], most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, trigram's index, count), sorted, and for every text whether it has an ASCII letter. A text longer than
    `most` bytes is counted slice by slice, so that memory grows with V and not with the text."""
    short = [x if len(x) <= most else b"" for x in texts]
    owner, index, letter = trigrams(short)
    keys, n = np.unique(owner * V + index, return_counts=True)
    parts = [(keys, n)]
    for k in (k for k, x in enumerate(texts) if len(x) > most):
        total = np.zeros(V, dtype=np.int64)
        for at in range(0, len(texts[k]), most):
            around = np.frombuffer((texts[k][at - 1 : at] if at else b" ") + texts[k][at : at + most + 1] + (b"" if at + most < len(texts[k]) else b" "), dtype=np.uint8)
            c = CLASSES[around]
            mid = np.flatnonzero(c[1:-1]) + 1
            letter[k] |= bool((c[mid] < 27).any())
            total += np.bincount((c[mid - 1] * K + c[mid]) * K + c[mid + 1], minlength=V)
        at = np.flatnonzero(total)
        parts.append((k * V + at, total[at]))
    keys, n = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    order = np.argsort(keys, kind="stable") if len(parts) > 1 else slice(None)
    return keys[order] // V, keys[order] % V, n[order], letter


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and P(trigram | language), from all rows of docs with a text and a language.

    Counts are summed in tasks before they are shuffled; what reaches the driver has at most V numbers a language. A
    language whose texts have no trigram is learned with equal probabilities; no labelled rows give no languages.
    """
    bound_batches(docs.sparkSession)

    def count(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in small_batches(batches, "text"):
            texts, langs = utf8(b.column("text")), b.column("lang").to_pylist()
            for one in set(langs):
                _, index, n, _ = bags([t for t, x in zip(texts, langs, strict=True) if x == one])
                sums.setdefault(one, np.zeros(V, dtype=np.int64))
                np.add.at(sums[one], index, n)
        for one, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "g", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = rows.mapInArrow(count, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((V, 0))
    where = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((V, len(langs)))
    counts[got.column("g").to_numpy(), [where[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    seen = max(1, int((counts.sum(1) > 0).sum()))
    return langs, (counts + smoothing) / (counts.sum(0) + smoothing * seen)


def infer(texts: list[bytes], probs: np.ndarray, penalty: float, rounds: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each text (n x languages) and whether it has a letter.

    A text is a bag of trigrams, each drawn from one of its languages. The set starts with the likeliest language; the
    one whose share has the steepest likelihood is tried next, proportions are fitted by expectation-maximisation, and
    it stays if the log-likelihood gains more than penalty * log(number of trigrams). The penalty alone ends this, but
    where `most` languages are asked for.
    """
    n, m = len(texts), probs.shape[1]
    share = np.zeros((n, m))
    owner, index, c, letter = bags(texts)
    for k in np.flatnonzero(~letter):
        letter[k] = any(ch.isalpha() for ch in texts[k].decode("utf-8", "replace"))
    if not len(owner) or not m:
        return share, letter
    p = probs[index]
    docs, start = np.unique(owner, return_index=True)
    row = np.repeat(np.arange(len(docs)), np.diff(np.append(start, len(owner))))
    c = c.astype(np.float64)
    total = np.add.reduceat(c, start)
    single = np.add.reduceat(c[:, None] * np.log(p), start)
    best = single.argmax(1)
    pi = np.zeros((len(docs), m))
    pi[np.arange(len(docs)), best] = 1.0
    ll, live = single.max(1), np.arange(len(docs))
    for _ in range(min(most or m, m) - 1):
        pick = np.isin(row, live) if len(live) < len(docs) else slice(None)
        r, q, w = row[pick], p[pick], c[pick]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        local = np.cumsum(np.r_[0, r[1:] != r[:-1]])
        ids = r[first]
        mixed = np.einsum("ij,ij->i", q, pi[r])
        slope = np.add.reduceat((w / mixed)[:, None] * q, first)
        slope[pi[ids] > 0] = -np.inf
        new = slope.argmax(1)
        trial = pi[ids] * 0.8
        trial[np.arange(len(ids)), new] = 0.2
        for _ in range(rounds):
            joint = q * trial[local]
            mixed = joint.sum(1)
            trial = np.add.reduceat(joint * (w / mixed)[:, None], first) / total[ids][:, None]
        gained = np.add.reduceat(w * np.log(np.einsum("ij,ij->i", q, trial[local])), first) - ll[ids]
        ok = gained > penalty * np.log(total[ids] + 1.0)
        pi[ids[ok]] = trial[ok]
        ll[ids[ok]] += gained[ok]
        live = ids[ok]
        if not len(live):
            break
    share[docs] = pi
    return share, letter


def identify(docs: DataFrame, langs: list[str], probs: np.ndarray, text: str = "text", penalty: float = 4.0, rounds: int = 12, most: int | None = None) -> DataFrame:
    """docs with lang_pred, score (the share of lang_pred), n_langs and lang_shares ("lang=share" by falling share).

    A null text or one without a letter is `und` with score 0, as is every text when no language was learned. Ties go
    to the language first in code-point order. Columns of docs stay; those with the names of new ones are replaced.
    The model has a fixed size (V numbers a language) and is broadcast.
    """
    bound_batches(docs.sparkSession)
    new = ["lang_pred", "score", "n_langs", "lang_shares"]
    keep, called = set_aside(docs, (text,), new)
    if text not in keep.columns:
        raise ValueError(f"no column {text}")
    held = docs.sparkSession.sparkContext.broadcast((langs, probs))

    def predict(batches) -> Iterator[pa.RecordBatch]:
        langs, probs = held.value
        for b in small_batches(batches, text, 4 << 20):
            share, letter = infer(utf8(b.column(text)), probs, penalty, rounds, most)
            some = letter & (share.sum(1) > 0)
            top = share.argmax(1) if len(langs) else np.zeros(len(share), dtype=int)
            names, mixes = [], []
            for k in range(len(share)):
                names.append(langs[top[k]] if some[k] else UND)
                mixes.append(",".join(f"{langs[j]}={share[k, j]:.4f}" for j in np.argsort(-share[k], kind="stable") if share[k, j] > 0) if some[k] else "")
            score = np.where(some, share.max(1) if len(langs) else 0.0, 0.0)
            count = np.where(some, (share > 0).sum(1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(count, pa.int32()), pa.array(mixes, pa.string())], [*b.schema.names, *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)
    return keep.mapInArrow(predict, f"{kinds}, lang_pred string, score double, n_langs int, lang_shares string").toDF(*called.values(), *new)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs, lang_shares for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, probs = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), langs, probs).select("doc_id", "held_out", "lang_pred", "score", "n_langs", "lang_shares")
