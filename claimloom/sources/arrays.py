"""Rows of large files that are one JSON list, or hold one: read in splits by many tasks.

A file is read as the pieces between its closing braces, which Spark splits like lines. What a split's quotes and brackets
do to the nesting is summed up in one row, whatever lies before it; a fold over a file's rows, one for each split, then
tells in which string and in which brackets each split begins, and the splits are cut into elements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship, staged

#: A string to its end, or to the end of the text; what ends a string that began before; brackets.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+("|\\?\Z)|[\[\]{}]')
_REST = re.compile(r'[^"\\]*+(?:\\[\s\S][^"\\]*+)*+("|\\?\Z)')
#: Where a split may begin: outside of strings, in one, or in one after a backslash.
OUT, IN, ESCAPED = 0, 1, 2
_CLOSES = {"}": "{", "]": "["}
#: Characters of a split that are looked at once (elements and strings may be longer); splits whose beginnings are broadcast.
CHUNK, BROADCAST_SPLITS = 1 << 20, 100_000


class Scanner:
    """Reads a split's text, chunk by chunk, from a state of strings, and keeps what it closes and what it leaves open.

    stack: brackets left open, as "{", "[", or "[name" of an array that follows a key of that name; closes: brackets closed
    that were opened before; seen: (name, closes, opens) where an array of a name began. `wanted` tells of a stack and a
    place in it whether that is the array whose objects are rows."""

    def __init__(self, state: int, key: re.Pattern, stack: list[str] | None = None, wanted=None):
        self.state, self.key, self.stack, self.wanted = state, key, list(stack or []), wanted
        self.closes: list[str] = []
        self.seen: set[tuple[str, int, int]] = set()
        self.tail = ""

    def feed(self, text: str) -> Iterator[tuple[int, bool]]:
        """Reads a chunk; yields (place, begins) where an object of the wanted array begins or has ended."""
        at = 0
        if self.state == ESCAPED and text:
            at, self.state = 1, IN
        if self.state == IN and at < len(text):
            m = _REST.match(text, at)
            at = m.end()
            self.state = OUT if m[1] == '"' else ESCAPED if m[1] else IN
        for m in _TOKEN.finditer(text, at) if self.state == OUT else ():
            t = m[0]
            if t[0] == '"':
                if m[1] != '"' or len(t) == 1:
                    self.state = ESCAPED if m[1] == "\\" else IN
            elif t in "{[":
                if t == "[" and (named := self.key.search((self.tail + text[max(0, m.start() - 200) : m.start()])[-200:])):
                    t = "[" + named[1]
                    self.seen.add((named[1], len(self.closes), len(self.stack)))
                self.stack.append(t)
                if t == "{" and self.wanted and self.wanted(self.stack, len(self.stack) - 2):
                    yield m.start(), True
            elif not self.stack:
                self.closes.append(_CLOSES[t])
            elif self.stack[-1][0] != _CLOSES[t]:
                raise ValueError(f"{t} closes {self.stack[-1][0]}")
            else:
                ends = t == "}" and self.wanted and self.wanted(self.stack, len(self.stack) - 2)
                self.stack.pop()
                if ends:
                    yield m.end(), False
        self.tail = (self.tail + text)[-200:]


def _wanted(name: str):
    """Whether stack[k] is the file's own list, or, with a name, the list of that name in the file's object."""
    return lambda stack, k: (k == 0 and stack[0][0] == "[") if not name else (k == 1 and stack[0] == "{" and stack[1] == "[" + name)


def _chunks(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """(split, text, whether it is the split's first) of (split, piece): pieces with the braces that parted them, about CHUNK
    characters at a time."""
    now, held, size, first = None, [], 0, True
    for split, piece in pieces:
        if now is not None and (split != now or size > CHUNK):
            yield now, "".join(held), first
            first, held, size = split != now, [], 0
        now = split
        held += (piece, "}")
        size += len(piece) + 1
    if now is not None:
        yield now, "".join(held), first


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def elements(spark: SparkSession, path: str, names: tuple[str, ...] = ("claims", "cases")) -> DataFrame:
    """(file, text): each object of a file's list as JSON text. The list is the file itself, or the first of `names` that the
    file's object has as a list.

    A byte-order mark may come first. Other files, and those whose brackets or strings don't end (but for the brace that ends
    an object's file), raise when this is called, as far as brackets tell. A file of any size is read by as many tasks as it
    has splits (spark.sql.files.maxPartitionBytes); an element of several splits is put together from its parts. Two passes
    over the text; what goes between them is a row for each split.
    """
    ship(spark)
    key = re.compile(rf'"({"|".join(map(re.escape, names))})"\s*:\s*\Z')
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    texts, text, long = pa.list_(pa.string()), pa.string(), pa.int64()
    sums = [("file", text), ("block", long), ("begin", long), ("end", long), ("closes", texts), ("opens", texts), ("seen", texts), ("bad", text), ("head", text)]

    def summed(batches) -> Iterator[pa.RecordBatch]:
        """For each split and each state it may begin in: what it ends with, or why it cannot begin so."""
        now, scans, head = None, [], ""
        rows = lambda: _batch([(*now, s, x.state, x.closes, x.stack, sorted(" ".join(map(str, i)) for i in x.seen), bad, head) for s, (x, bad) in enumerate(scans)], sums)
        pieces = ((split, v) for b in batches for split, v in zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True), b.column("value").to_pylist(), strict=True))
        for split, chunk, first in _chunks(pieces):
            if first:
                if now:
                    yield rows()
                now, scans, head = split, [[Scanner(s, key), None] for s in (OUT, IN, ESCAPED)], chunk.lstrip("\ufeff \t\r\n")[:1]
            for s in scans:
                if s[1] is None:
                    try:
                        for _ in s[0].feed(chunk):
                            pass
                    except ValueError as e:
                        s[1] = str(e)
        if now:
            yield rows()

    begins = [("file", text), ("block", long), ("state", long), ("stack", texts), ("since", pa.list_(long)), ("want", text)]

    def fold(table):
        """For each split of a file: the state and the open brackets that it begins with, and in which splits these began."""
        by = {(r["block"], r["begin"]): r for r in table.to_pylist()}
        name, blocks = table.column("file")[0].as_py(), sorted({b for b, _ in by})
        top = next((by[b, OUT]["head"] for b in blocks if by[b, OUT]["head"]), "")
        state, stack, found, out = OUT, [], set(), []
        for block in blocks:
            r = by[block, state]
            if r["bad"]:
                raise ValueError(f"no rows in {name}: {r['bad']}")
            out.append((name, block, state, [b for b, _ in stack], [w for _, w in stack]))
            for n, closed, opened in (s.rsplit(" ", 2) for s in r["seen"]):
                if len(stack) - int(closed) + int(opened) == 1:
                    found.add(n)
            for c in r["closes"]:
                if stack and stack[-1][0][0] == c:
                    stack.pop()
                elif stack or block != blocks[-1] or c != "{":  # a piece ends with a brace, which the last one may not have
                    raise ValueError(f"no rows in {name}: brackets don't fit")
            stack += [(b, block) for b in r["opens"]]
            state = r["end"]
        if state != OUT or stack or top not in ("[", "{"):
            raise ValueError(f"no rows in {name}: no list, or one that does not end")
        want = "" if top == "[" else next((n for n in names if n in found), None)
        if want is None:
            raise ValueError(f"no rows in {name}: no list of {' or '.join(names)}")
        return pa.Table.from_batches([_batch([(*o, want) for o in out], begins)])

    ddl = lambda fields: ", ".join(f"{n} {'string' if t == text else 'long' if t == long else 'array<string>' if t == texts else 'array<long>' if t == pa.list_(long) else 'boolean'}" for n, t in fields)
    splits = staged(lines.mapInArrow(summed, ddl(sums)), "splits")
    starts = staged(splits.groupBy("file").applyInArrow(fold, ddl(begins)), "begins")
    parts = [("file", text), ("since", long), ("block", long), ("text", text), ("whole", pa.bool_())]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        """A split's whole elements; the end of one that began before it, and the beginning of one that goes on after it."""
        begin, out, size = {}, [], 0

        def pieces():
            for b in batches:
                for f, k, v, *row in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value", "state", "stack", "since", "want")), strict=True):
                    begin[f, k] = row
                    yield (f, k), v

        now, scan, since, open_ = None, None, None, None
        for split, chunk, first in _chunks(pieces()):
            if first:
                if open_ is not None:
                    out.append((now[0], since, now[1], "".join(open_), False))
                now, (state, stack, places, want) = split, begin.pop(split)
                scan = Scanner(state, key, stack, _wanted(want))
                inside = next((k for k in range(1, len(stack)) if stack[k] == "{" and scan.wanted(stack, k - 1)), None)
                since, open_ = (None, None) if inside is None else (places[inside], [])
            at = 0
            for place, begins_ in scan.feed(chunk):
                if begins_:
                    at, since, open_ = place, now[1], []
                else:
                    open_.append(chunk[at:place])
                    out.append((now[0], since, now[1], "".join(open_), since == now[1]))
                    size, open_ = size + len(out[-1][3]), None
            if open_ is not None:
                open_.append(chunk[at:])
            if size > 4 << 20:
                yield _batch(out, parts)
                out, size = [], 0
        if open_ is not None:
            out.append((now[0], since, now[1], "".join(open_), False))
        yield _batch(out, parts)

    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    if starts.count() <= BROADCAST_SPLITS:
        joined = numbered.join(F.broadcast(starts), ["file", "block"])
    else:
        joined = numbered.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "_id")
    got = staged(joined.select("file", "block", "value", "state", "stack", "since", "want").mapInArrow(cut, ddl(parts)), "parts")
    torn = got.where("NOT whole").groupBy("file", "since").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    return got.where("whole").select("file", "text").unionByName(torn.select("file", "text"))
