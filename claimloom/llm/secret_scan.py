"""Secret scanning with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, set_aside, small_batches, stage

# Kinds in the order in which spans of one start are listed, and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# A private key runs to the first END line before another BEGIN; without one, to the end of its headers and base64 lines,
# which may be quoted, indented or parted by escapes, and of which the last may be short.
_BETWEEN = r"""(?:\s|\\[nrt]|[>#*|"',;+])"""
_HEADER = r"(?:Proc-Type|DEK-Info): [^\s\\]++"
_LINE = r"[A-Za-z0-9+/]{16,}+=*+"
_LAST = rf"(?:{_BETWEEN}++[A-Za-z0-9+/]{{1,15}}+(?:=++|(?=[ \t]*(?:[\r\n]|\\[nr]|\Z))))?"
PEM = re.compile(
    rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:((?:(?!-----BEGIN )[\s\S])*?)-----END [A-Z ]*PRIVATE KEY-----|((?:{_BETWEEN}*+{_HEADER})*+(?:(?:{_BETWEEN}*+{_LINE})++{_LAST})?))"
)
_NOT_BODY = re.compile(rf"{_HEADER}|\\[nrt]|[^A-Za-z0-9+/]")
MORE = [
    ("pem", PEM),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}")),
    ("google", re.compile(r"AIza[0-9A-Za-z_-]{35,}")),
    # from the first eyJ of the run before the point; each run is looked at twice at most
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++)")),
]
ANCHORS = {"pem": "-----BEGIN ", "github": "gh", "slack": "xox", "google": "AIza", "jwt": "eyJ"}
BASE = ("assign", "access", "hex")
#: More repositories than these hold only what is copied.
MOST_REPOS = 20
KINDS = (*BASE, *(k for k, _ in MORE), "live")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _body(m: re.Match) -> tuple[str, int, int]:
    """(value, start, end) of a private key: its base64 without headers and breaks, which are not the same in all copies; the
    whole match where there is none."""
    group = 1 if m[1] is not None else 2
    value = _NOT_BODY.sub("", m[group])
    return (value, *m.span(group)) if value else (m[0], *m.span())


def find(text: str) -> list[tuple[str, int, int, str, int, int]]:
    """(kind, start, end, value, value_start, value_end) of every candidate, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS) or not text.isascii():
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                out.append(("assign", *m.span(), m[2], *m.span(2)))
    if "AKIA" in text:
        out += [("access", *m.span(), m[0], *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0], *m.span()) for m in HEX.finditer(text)]
    for kind, pattern in MORE:
        if ANCHORS[kind] not in text:
            continue
        if kind == "pem":
            out += [(kind, *m.span(), *_body(m)) for m in pattern.finditer(text)]
        else:
            of = pattern.groups
            out += [(kind, *m.span(of), m[of], *m.span(of)) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def varied(value: str) -> bool:
    """Whether a value looks drawn at random: 12 characters or more, a digit, and 3 bits a character."""
    if len(value) < 12 or not any(c.isdigit() for c in value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= 3.0


FOUND = "array<struct<kind:string,start:int,stop:int,value_start:int,value_stop:int,hash:string,varied:boolean>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_start", pa.int32()), ("value_stop", pa.int32()), ("hash", pa.string()), ("varied", pa.bool_())]))


def scan(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with `found`: the candidates of each text, whose values are kept as 128-bit hashes only. A null text has none."""
    bound_batches(docs.sparkSession)
    keep, called = set_aside(docs, (text,), ("found",))
    out = [c for c in keep.columns if not (drop_text and c == text)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text):
            rows = [[{"kind": k, "start": s, "stop": e, "value_start": vs, "value_stop": ve, "hash": xxhash.xxh3_128_hexdigest(v.encode("utf-8", "surrogatepass")), "varied": varied(v)} for k, s, e, v, vs, ve in find(t or "")] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(rows, _FOUND)], [*out, "found"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep.schema if f.name in out)
    return keep.mapInArrow(run, f"{kinds}found {FOUND}").toDF(*(called[c] for c in out), "found")


def ownership(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """(hash, n_repos, n_owners) of every candidate value: distinct repositories and owners that hold it, null being one.

    A value in a third of all rows is summed in each task before anything is shuffled.
    """
    both = F.array(F.struct(F.lit(True).alias("repo"), F.col(repo).cast("string").alias("name")), F.struct(F.lit(False).alias("repo"), F.col(owner).cast("string").alias("name")))
    each = found.where(F.size("found") > 0).select(F.explode(F.array_distinct("found.hash")).alias("hash"), both.alias("both"))
    each = each.select("hash", F.inline("both")).distinct()
    return each.groupBy("hash").agg(F.count_if("repo").alias("n_repos"), F.count_if(~F.col("repo")).alias("n_owners"))


def judged(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", most_owners: int = 1, most_repos: int = MOST_REPOS, drop_text: bool = False) -> DataFrame:
    """docs with `spans` array<struct<start, rank, kind, stop>> by start and kind, n_live and n_example.

    A candidate value is an example that people copy if more than most_owners owners or more than most_repos
    repositories hold it. One that stays with its owner in a few repositories and looks drawn at random is live, and its
    value gets a span of kind `live` besides the candidate's own. Texts are scanned once, into a written table with a
    number for each row, so that repeated rows and ids stay apart; only what was found meets the counts, which are written
    out first so that adaptive execution can split a value of very many rows; and of the texts
    only those with candidates, a few, are shuffled, once each. A null text has no spans. Columns of docs called spans,
    n_live, n_example or found are replaced, others of any name stay.
    """
    keep, called = set_aside(docs, (text, repo, owner), ("spans", "n_live", "n_example", "found"))
    names = [c for c in keep.columns if not (drop_text and c == text)]
    found = stage(scan(keep, text, drop_text).withColumn("_row", F.monotonically_increasing_id()), "found")
    hits = found.where(F.size("found") > 0)
    owned = stage(ownership(hits, repo, owner), "owned")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rank = lambda k: F.array_position(kinds, k).cast("int")
    span = lambda f, k, s, e: F.struct(f[s].alias("start"), rank(k).alias("rank"), k.alias("kind"), f[e].alias("stop"))
    each = hits.select("_row", F.explode("found").alias("f")).join(owned, F.col("f.hash") == owned["hash"])
    example = (F.col("n_owners") > most_owners) | (F.col("n_repos") > most_repos)
    live = ~example & F.col("f.varied")
    f = F.col("f")
    both = F.when(live, F.array(span(f, f["kind"], "start", "stop"), span(f, F.lit("live"), "value_start", "value_stop"))).otherwise(F.array(span(f, f["kind"], "start", "stop")))
    per = each.groupBy("_row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(both)))).alias("spans"), F.count_if(live).alias("n_live"), F.count_if(example).alias("n_example"))
    with_hits = hits.join(per, "_row").select(*names, "spans", "n_live", "n_example")
    none = found.where(F.size("found") == 0).select(*names, F.array().cast(with_hits.schema["spans"].dataType).alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return none.union(with_hits).toDF(*(called[c] for c in names), "spans", "n_live", "n_example")


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(judged_docs: DataFrame, text: str = "text", mask: str = "<secret>", n_chars: str | None = "n_chars") -> DataFrame:
    """judged(...) rows whose text has `mask` in place of every span, overlapping ones together; its helper columns go. A
    null text stays null, whatever its spans."""
    bound_batches(judged_docs.sparkSession)
    own = ("spans", "n_live", "n_example")
    judged_docs, called = set_aside(judged_docs, (text, n_chars, *own))
    out = [c for c in judged_docs.columns if c not in own]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text):
            texts = []
            for t, spans in zip(b.column(text).to_pylist(), b.column("spans").to_pylist(), strict=True):
                if spans and t is not None:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [t[at : s["start"]], mask]
                        at = max(at, s["stop"])
                    t = "".join([*parts, t[at:]])
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if c == text else b.column(c) for c in out]
            yield pa.RecordBatch.from_arrays(cols, out)

    clean = judged_docs.where(F.size("spans") == 0).select(*out)
    dirty = judged_docs.where(F.size("spans") > 0)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged_docs.schema if f.name in out)
    masked = dirty.mapInArrow(run, kinds)
    if n_chars in out:
        masked = masked.withColumn(n_chars, F.length(text).cast(judged_docs.schema[n_chars].dataType))
    return clean.union(masked.select(*out)).toDF(*(called[c] for c in out))


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for every row of documents.

    A document counts as a repository and its source as the owner.
    """
    j = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), drop_text=True)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return j.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def brute(text: str | None) -> tuple[int, int, int, str]:
    """Counts and base_sha256 from the patterns as they are stated, without any shortcut; for tests."""
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort(key=lambda x: (x[1], BASE.index(x[0])))
    n = Counter(x[0] for x in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
