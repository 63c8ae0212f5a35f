"""Band join, hard negatives and archives against plain versions."""

import math
import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from claimloom.llm import band_join, hard_negatives, warc_zst
from claimloom.llm.common import stage_path


def plain_band(sf):
    """op13's rows by comparing each item with each line."""
    lines, items = (pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in ("sale_lines", "items"))
    cents = lambda x: math.floor(100 * x + 0.5) if x is not None and math.isfinite(x) and abs(x) < 2**53 else None
    values = []
    for r in lines:
        a = cents(r["amount"])
        if None not in (r["sale_id"], r["item_id"], a) and r["quantity"]:
            no = "" if r["line_no"] is None else r["line_no"]
            values.append((math.floor(Fraction(2 * a + r["quantity"], 2 * r["quantity"])), r["sale_id"], r["line_no"], r["item_id"], zlib.crc32(f"{r['sale_id']},{no},{r['item_id']}".encode())))
    out = []
    for r in items:
        p = cents(r["price"])
        near = [] if p is None or r["item_id"] is None else [(abs(v[0] - p), *v) for v in values if v[3] != r["item_id"] and (abs(v[0] - p) <= 50 or 1000 * abs(v[0] - p) <= 5 * min(v[0], p))]
        near.sort(key=lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3], x[4]))
        sums = {"n_pairs": len(near), "gap_sum": sum(x[0] for x in near), "lines_crc": sum(x[5] for x in near)}
        for k, x in enumerate(near[:10], 1):
            out.append(Row(item_id=r["item_id"], rank=k, gap=x[0], u=x[1], sale_id=x[2], line_no=x[3], line_item_id=x[4], **sums))
        if not near:
            out.append(Row(item_id=r["item_id"], rank=0, gap=None, u=None, sale_id=None, line_no=None, line_item_id=None, **sums))
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_band_join(spark, most):
    """Values of all sizes and signs, a hot value and a hot owner, ties, repeats; blocks of two and of more digits."""
    rng = random.Random(4)
    u = [rng.choice([7, 1000, -9999, -10000, 10**6 + 5, 10**12]) + rng.choice([0, 0, 1, rng.randint(-60, 60), rng.randint(-6000, 6000)]) for _ in range(600)]
    values = [(x, rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(0, 5), rng.randint(0, 2)) for x in u] + [(1000, 1, k, 0) for k in range(30)]
    keys = [(rng.choice([1, 2, 3, 9]), rng.choice(u) + rng.randint(-70, 70)) for _ in range(120)] + [(1, 1000)] * 2
    out = band_join.band_join(spark.createDataFrame(keys, "item_id long, p long"), spark.createDataFrame([(*v, v[0] % 97) for v in values], "u long, item_id long, a long, b long, w long"), "item_id", ("a", "b"), k=4, leaves_most=most)
    got = sorted((r.item_id, r.p, r.n_pairs, r.gap_sum, r.w_sum, [tuple(x) for x in r.near]) for r in out.collect())
    want = []
    for owner, p in keys:
        near = sorted((abs(x - p), x, a, b, o) for x, o, a, b in values if o != owner and (abs(x - p) <= 50 or 1000 * abs(x - p) <= 5 * min(x, p)))
        want.append((owner, p, len(near), sum(x[0] for x in near), sum(x[1] % 97 for x in near), near[:4]))
    assert got == sorted(want)


def test_trie():
    u = np.unique(np.random.default_rng(1).integers(-3000, 90000, 500))
    t = band_join.Trie(u, np.stack([np.ones_like(u), u], 1))
    x = np.r_[u[:50], -5000, 0, 1, 89999, 100000]
    assert (t.below(x) == np.array([[(u < y).sum(), u[u < y].sum()] for y in x])).all()
    for p in (-100, 0, 4321, 89000):
        assert [u[at] for _, at in t.by_gap(p, p - 900, p + 700)] == sorted(u[(u >= p - 900) & (u <= p + 700)], key=lambda y: (abs(y - p), y))


def plain_mine(rows, anchors):
    out = []
    for a in anchors:
        score = {k: sum(x * y for x, y in zip(r[2], a[2], strict=True)) for k, r in enumerate(rows) if len(r[2]) == len(a[2])}
        order = lambda ks: sorted(ks, key=lambda k: (-score[k], rows[k][0]))
        for p in order([k for k in score if rows[k] is not a and rows[k][1] == a[1]])[:5]:
            fit = [k for k in score if rows[k][1] != a[1] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(a[0], rows[p][0], j, rows[k][0], score[p], score[k]) for j, k in enumerate(order(fit)[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [32768, 90])
def test_hard_negatives(spark, monkeypatch, block):
    """Clusters, equal vectors, zeros, vectors of several lengths, and scores near the end of a long."""
    monkeypatch.setattr(hard_negatives, "ASKS", 7 if block < 1000 else 4096)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12)) * 300
    rows = [(k, k % 4, (centres[k % 6] + rng.normal(size=12) * 120).astype(int).tolist()) for k in range(400)]
    rows += [(400 + k, k % 3, [5, 0, 0]) for k in range(60)] + [(500 + k, k % 2, [0] * 3) for k in range(4)]
    rows += [(600 + k, k % 2, [2**30 - k, 2**30 + 2 * k]) for k in range(30)]
    df = spark.createDataFrame([*rows, (900, None, [1]), (901, 1, None), (902, 1, [2**40, 0]), (903, 1, []), (None, 1, [5, 0, 0]), (904, 2, [None, 1, 2])], "vec_id long, label int, v array<long>")
    got = hard_negatives.mine(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), block=block)
    assert sorted(map(tuple, got.collect())) == plain_mine(rows, [r for r in rows if r[0] % 20 == 0])


def test_bounds_hold():
    x = np.random.default_rng(5).integers(-300, 300, (500, 9))
    q = hard_negatives.Quantiser(x[:50], centroids=8)
    codes, norms = q.encode(x)
    gap = np.abs(q.scores(x[:40], codes) - x @ x[:40].T)
    assert (gap <= norms[:, None] * hard_negatives.length(x[:40])[None]).all() and gap.max() > 0


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    """Every page comes back; each file starts with its dictionary; each record is a frame of its own."""
    rows = [(k, f"https://h.org/{k} x%20y", "<p>" + " ".join(f"word{k * j % 37}" for j in range(200)) + "é😀") for k in range(300)]
    rows += [(1000, "u", rows[5][2]), (1001, None, rows[5][2]), (1002, "", None), (1003, "u", ""), (None, "u", "only null"), (None, "v", "only null"), (1004, "u", "x" * 3_000_000), (7, "u", rows[7][2])]
    path = stage_path(spark, "warc-test")
    warc_zst.write(spark.createDataFrame(rows, PAGES).repartition(3), path, per_file=50)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) >= 7 and all(struct.unpack("<I", f[:4])[0] == warc_zst.DICTIONARY_FRAME for f in files)
    got = sorted(((r.page_id is None, r.page_id, r.url, r.record_type, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in warc_zst.read(spark, path).collect()), key=str)
    want = []
    for page, url, html in rows:
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        again = bool(same) and page != min(same)
        url = url if url is None else url.replace(" ", "%20")
        want.append((page is None, page, url, "revisit" if again else "response", len((html or "").encode()), min(same) if again else None, None if again else (html or "")))
    assert got == sorted(want, key=str)


def test_broken_archives(spark, tmp_path):
    good = [warc_zst.record(k, "u", b"payload %d" % k) for k in range(4)]
    pack = lambda parts: b"".join(zstandard.ZstdCompressor().compress(x) for x in parts)
    assert [warc_zst.parsed(x)["page_id"] for x in warc_zst.frames(pack(good))] == [0, 1, 2, 3]
    broken = {
        "length": good[0].replace(b"Content-Length: 9", b"Content-Length: 8"), "digest": good[0].replace(b"payload 0", b"payload 9"), "version": good[0][4:], "tail": good[0] + b"x", "two": good[0] + good[1],
        "id": good[0].replace(b"<urn:page:0>", b"<urn:page:x>"), "type": good[0].replace(b": response", b": metadata"), "twice": good[0].replace(b"WARC-Date", b"WARC-Type"), "date": good[0].replace(b"WARC-Date", b"WARC-Day"),
    }
    for name, data in broken.items():
        with pytest.raises(ValueError):
            warc_zst.parsed(data)
        (tmp_path / name).write_bytes(pack([data, good[2]]))
    told = warc_zst.read(spark, str(tmp_path), strict=False).collect()
    assert sum(r.problem is not None for r in told) == len(broken) and sum(r.page_id == 2 for r in told) == len(broken)
    for cut in (pack(good)[:-3], pack(good) + b"1234", pack(good) + b"12345678", struct.pack("<II", warc_zst.DICTIONARY_FRAME, 99) + b"short"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc_zst.frames(cut))


def test_dictionary_forms():
    """A raw and a compressed dictionary, other skippable frames between records, no dictionary at all."""
    samples = [warc_zst.record(k, f"https://h{k}.org", f"<p>{k * 7919} text of page {k}".encode() * 9) for k in range(400)]
    d = warc_zst.trained(samples)
    frames = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(x) for x in samples[:5]]
    raw = struct.pack("<II", warc_zst.DICTIONARY_FRAME, len(d)) + d
    for lead in (raw, warc_zst.dictionary_frame(d)):
        assert list(warc_zst.frames(lead + warc_zst.EMPTY_FRAME.encode().join(frames))) == samples[:5]
    with pytest.raises(zstandard.ZstdError):
        list(warc_zst.frames(frames[0]))
    assert warc_zst.trained([b"a"]) == b"" and warc_zst.trained([]) == b""
