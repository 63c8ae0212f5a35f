"""Exact BPE encoding and decoding by tree concatenation: leaves of long texts are encoded in parallel and joined."""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BATCH_BYTES, bound_batches, list_array, set_aside, small_batches, utf8, worker_caches

#: Bytes of a leaf: longer texts are cut, wherever that falls, into leaves that tasks encode side by side.
LEAF = 1 << 14
#: Longer pieces are not kept between batches.
KEPT_PIECE = 256
CACHE = 1_000_000
#: What a leaf is: text; whole pre-tokens of a run without white space; symbols of a long pre-token, its last ones; a run for the library.
TEXT, WORDS, PART, LAST, WHOLE = range(5)
_SPACE = b" \t\n\r\x0b\x0c"


def _byte_names() -> dict[int, int]:
    """Byte-level names: printable Latin-1 characters for their own bytes, characters from 256 on for the others in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


class Bpe:
    """Encodes as the tokenizers library does with the same file (add_special_tokens=False, no truncation or padding).

    A text longer than a leaf is cut anywhere. Its leaves are encoded by themselves and joined pairwise: the pieces around
    a join are encoded again, more and more of them, until what comes out agrees at both ends with what both sides had.
    Within a leaf the normaliser and the pre-tokeniser of the file work between ASCII white space alone, so that pieces
    between white space are encoded by the library once and kept. A run without white space that is longer than a leaf is
    cut between its pre-tokens, and a pre-token longer than a leaf between its symbols. Files whose added tokens contain
    white space, or that keep white space (`separable` tells), are given to the library whole.
    """

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")) and not model.get("unk_token")
        probe = [("ab cd", ["ab", "cd"]), ("ab \n\t cd", ["ab", "cd"]), (" ab,\x0b\x0c cd ", ["ab,", "cd"])]
        self.separable = plain and bool(self.suffix) and not any(set(x) & set(" \t\n\r\x0b\x0c") for x in self.added) and all(self._whole(a) == [i for p in b for i in self._whole(p)] for a, b in probe)
        self.bytewise = all(x in self.vocab for b in range(256) for c in [chr(_BYTE_NAMES.get(b, b))] for x in (c, c + self.suffix))
        self.leaf, self.most = leaf, cache
        self.pieces: dict[bytes, bytes] = {}
        self.bodies: dict[bytes, bytes] = {}
        n = self.lib.get_vocab_size(with_added_tokens=True)
        self.names = [self.lib.id_to_token(k) or "" for k in range(n)]
        self.decoder = spec.get("decoder")
        # the rest of what is set here spares work where probes show that it changes nothing
        same = lambda a, b: self._whole(a) == [i for p in b for i in self._whole(p)]
        self.lower = self.separable and all(self._whole(x) == self._whole(x.lower()) for x in ("ABC DeF", "QUICK!")) and all("<" in x for x in self.added)
        marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
        apart = self.separable and all(same(f"abc{m}", ["abc", m]) for m in (*marks, "...", marks)) and not any(set(x) <= set(marks) for x in self.added)
        self.marks = marks.encode() if apart else b" "
        zero = self._whole("0")
        self.mark = zero[0] if self.separable and len(zero) == 1 and same("a0b", ["a", "0", "b"]) and same("00", ["0", "0"]) and same(".0.", [".", "0", "."]) else 0

        letters = [c for c in map(chr, range(0xAA, 0x100)) if c.isalpha()]
        self.bare = self.separable and all(np.array(self._whole(x), dtype="<u4").tobytes() == self._letters(x) for x in ("zebra", "Quick", *letters, *(f"a{c}b" for c in letters)))

    def _whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    # tree concatenation ------------------------------------------------------------------------------------------

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE of one run of symbols: the lowest-ranked pair first, the leftmost of equals."""
        n = len(symbols)
        sym, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if not gone[i] else n
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = a + b, True
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for k, m in ((left[i], i), (i, right[i])):
                if k >= 0 and m < n and (r := self.rank.get((sym[k], sym[m]))) is not None:
                    heapq.heappush(heap, (r, k, sym[k], sym[m]))
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def _symbols(self, token: str) -> list[str]:
        """The initial symbols that a merged token was made of."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _stands(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their symbols are encoded together: neighbours of which this holds are final."""
        return self.merge(self._symbols(a) + self._symbols(b)) == [a, b]

    def join(self, a: list[str], b: list[str]) -> list[str]:
        """The encoding of two encoded halves together: the window around the join grows, and is encoded again, until
        what it gives at both ends stands beside what was left of each half."""
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            mid = self.merge([s for t in a[len(a) - i :] + b[:j] for s in self._symbols(t)])
            lower = i == len(a) or self._stands(a[len(a) - i - 1], mid[0])
            upper = j == len(b) or self._stands(mid[-1], b[j])
            if lower and upper:
                return a[: len(a) - i] + mid + b[j:]
            i, j = (i if lower else 2 * i), (j if upper else 2 * j)

    @staticmethod
    def _pairwise(level: list, join: Callable) -> list:
        while len(level) > 1:
            level = [join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level

    def join_texts(self, left: tuple[bytes, bytes], right: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        """(text, ids) of two (text, ids) together. The window is the last i pieces of the left and the first j of the
        right text; it is final at an end where its ids outside of the cut piece are those that the side had there."""
        a, ids_a = left
        b, ids_b = right
        i = j = 2
        while True:
            parts = a.rsplit(None, i)
            all_a = len(parts) <= i
            x = a if all_a else a[len(parts[0]) :]
            parts = b.split(None, j)
            all_b = len(parts) <= j
            y = b if all_b else b[: len(b) - len(parts[-1])]
            cut_x = x.split()[-1] if x.rstrip(_SPACE) == x and x else b""
            cut_y = y.split(None, 1)[0] if y.lstrip(_SPACE) == y and y else b""
            of_x, of_y, outer_x, outer_y, both = (v.tobytes() for v in self.encode_batch([x, y, x[: len(x) - len(cut_x)], y[len(cut_y) :], x + y]))
            lower = all_a or (ids_a.endswith(of_x) and of_x.startswith(outer_x) and both.startswith(outer_x))
            upper = all_b or (ids_b.startswith(of_y) and of_y.endswith(outer_y) and both.endswith(outer_y))
            if lower and upper:
                return a + b, (b"" if all_a else ids_a[: len(ids_a) - len(of_x)]) + both + (b"" if all_b else ids_b[len(of_y) :])
            i, j = (i if lower else 2 * i), (j if upper else 2 * j)

    # leaves ------------------------------------------------------------------------------------------------------

    def cut(self, text: bytes) -> list[tuple[int, int, bytes]]:
        """(segment, kind, leaf) of a text, in order; leaves of one segment are to be joined, segments stand side by side."""
        if not self.separable:
            return [(0, WHOLE, text)]
        out, at, segment = [], 0, 0
        for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]{%d,}" % (self.leaf + 1), text):
            out += [(segment, TEXT, x) for x in self._slices(text[at : m.start()])]
            for k, kind, leaf in self._cut_run(m[0]):
                out.append((segment + 1 + k, kind, leaf))
            segment, at = out[-1][0] + 1, m.end()
        return out + [(segment, TEXT, x) for x in self._slices(text[at:])]

    def _slices(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = min(len(text), at + self.leaf)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            yield text[at:end]
            at = end

    def _cut_run(self, run: bytes) -> Iterator[tuple[int, int, bytes]]:
        text = run.decode("utf-8", "replace")
        if not self.bytewise or any(x in text for x in self.added):
            yield 0, WHOLE, run
            return
        norm = self.lib.normalizer.normalize_str(text) if self.lib.normalizer else text
        words, size, segment = [], 0, 0
        for part, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm):
            if words and (len(part) > self.leaf or size + len(part) > self.leaf):
                yield segment, WORDS, " ".join(words).encode()
                words, size, segment = [], 0, segment + 1
            if len(part) <= self.leaf:
                words.append(part)
                size += len(part)
                continue
            for at in range(0, len(part), self.leaf):
                yield segment, LAST if at + self.leaf >= len(part) else PART, part[at : at + self.leaf].encode()
            segment += 1
        if words:
            yield segment, WORDS, " ".join(words).encode()

    def encode_leaf(self, kind: int, leaf: bytes) -> bytes:
        if kind == TEXT:
            return self.encode_batch([leaf])[0].tobytes()
        s = leaf.decode("utf-8", "replace")
        if kind == WHOLE:
            ids = self._whole(s)
        elif kind == WORDS:
            ids = [x.id for w in s.split(" ") for x in self.lib.model.tokenize(w)]
        else:
            ids = [self.vocab[t] for t in self.merge(list(s) if kind == PART else [*s[:-1], s[-1] + self.suffix])]
        return np.array(ids, dtype="<u4").tobytes()

    def glue(self, leaves: list[tuple[int, int, bytes, bytes]]) -> tuple[np.ndarray, int]:
        """The ids of a text from its (segment, kind, leaf, ids) in order, and how many joins that took."""
        out, joins = [], 0
        for _, some in groupby(leaves, key=lambda x: x[0]):
            some = list(some)
            joins += len(some) - 1
            if some[0][1] == TEXT:
                out.append(self._pairwise([x[2:] for x in some], self.join_texts)[0][1])
            elif some[0][1] == PART:
                names = [[self.names[k] for k in np.frombuffer(x[3], dtype="<u4").tolist()] for x in some]
                out.append(np.array([self.vocab[t] for t in self._pairwise(names, self.join)[0]], dtype="<u4").tobytes())
            else:
                out.append(b"".join(x[3] for x in some))
        return np.frombuffer(b"".join(out), dtype="<u4"), joins

    def encode_text(self, text: bytes) -> tuple[np.ndarray, int]:
        """The ids of one text and how many joins that took, all here."""
        return self.glue([(*x, self.encode_leaf(*x[1:])) for x in self.cut(text)])

    def long_piece(self, text: str) -> list[int]:
        """A piece without white space."""
        return self.glue([(*x, self.encode_leaf(*x[1:])) for x in self._cut_run(text.encode())])[0].tolist()

    # texts -------------------------------------------------------------------------------------------------------

    def _letters(self, body: str) -> bytes:
        """A pre-token of Latin-1 letters: its bytes under the byte-level names go straight to the merges."""
        model = self.lib.model
        low = body.lower()
        names = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array("I", [x.id for x in model.tokenize(names)]).tobytes()

    def _encode_new(self, words: set[bytes]) -> None:
        """Encode pieces and keep them. Letters and a run of marks after them are pre-tokens of their own, so that `word`,
        `word.` and `word***` are encoded once; other pieces go to the library in one call, a digit between."""
        known, bodies, together = self.pieces, self.bodies, []
        for w in words:
            body = w.rstrip(self.marks)
            ids = bodies.get(body)
            if ids is None:
                if len(w) > KEPT_PIECE:
                    known[w] = np.array(self._whole(w.decode("utf-8", "replace")), dtype="<u4").tobytes()
                    continue
                s = body.decode("utf-8", "replace")
                if self.bare and s.isalpha() and (s.isascii() or max(s) <= "\xff"):
                    ids = bodies[body] = self._letters(s)
                elif self.mark and b"0" not in w:
                    together.append(w)
                    continue
                else:
                    known[w] = np.array(self._whole(w.decode("utf-8", "replace")), dtype="<u4").tobytes()
                    continue
            if len(body) == len(w):
                known[w] = ids
            else:
                marks = w[len(body) :]
                known[w] = ids + (known.get(marks) or known.setdefault(marks, np.array(self._whole(marks.decode()), dtype="<u4").tobytes()))
        for k in range(0, len(together), 512):
            some = together[k : k + 512]
            ids = np.array(self._whole(" 0 ".join([*(w.decode("utf-8", "replace") for w in some), ""])), dtype="<u4")
            ends, flat, at = np.flatnonzero(ids == self.mark).tolist(), ids.tobytes(), 0
            if len(ends) != len(some):
                known.update((w, np.array(self._whole(w.decode("utf-8", "replace")), dtype="<u4").tobytes()) for w in some)
                continue
            for w, end in zip(some, ends, strict=True):
                known[w], at = flat[4 * at : 4 * end], end + 1

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.separable:
            return [np.array(self._whole(t.decode("utf-8", "replace")), dtype=np.uint32) for t in texts]
        split = [(t if not self.lower or b"<" in t else t.lower()).split() for t in texts]
        known = self.pieces
        if len(known) > self.most:
            known.clear()
            self.bodies.clear()
        new = set(chain.from_iterable(split)).difference(known)
        self._encode_new(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4") for words in split]
        for w in new:
            if len(w) > KEPT_PIECE:
                del known[w]
        return out

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """Without a decoder in the file the library joins the tokens' names by spaces; other decoders are its own."""
        if self.decoder:
            return self.lib.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        name = self.names.__getitem__
        return [" ".join(map(name, x.tolist())) for x in ids]


@lru_cache(maxsize=4)
def _codec(path: str) -> Bpe:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Bpe(path)


def bpe(path: str, most: int = CACHE) -> Bpe:
    """One codec for each file and Python worker, until another operator needs the worker; it keeps `most` pieces."""
    worker_caches["tokens"] = _codec.cache_clear
    codec = _codec(path)
    codec.most = most
    return codec


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizers' file of that name; its place is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def map_ids(docs: DataFrame, path: str, text: str, rest: list[str], fields: str, make: Callable, most: int = CACHE, over: int = LEAF) -> DataFrame:
    """Columns `rest` of docs and those that make(codec, ids of each text, joins of each text) gives, of types `fields`.

    Texts of up to `over` bytes, a leaf or more, are encoded where they are. Longer ones become a row for each leaf; these are dealt out and
    encoded, then come together again by text, in order, to be joined. Repeated rows stay apart by a row number.
    """
    bound_batches(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", fields)]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)

    def short(batches) -> Iterator[pa.RecordBatch]:
        codec = bpe(path, most)
        for b in small_batches(batches, text, cache="tokens"):
            got = codec.encode_batch(utf8(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *make(codec, got, [0] * len(got))], [*rest, *names])

    def cut(batches) -> Iterator[pa.RecordBatch]:
        codec = bpe(path, most)
        for b in small_batches(batches, text, cache="tokens"):
            for i, t in enumerate(utf8(b.column(text))):
                leaves = codec.cut(t)
                first = pa.array([i, *[None] * (len(leaves) - 1)], pa.int64())
                cols = [pa.array([b.column("_row")[i].as_py()] * len(leaves), pa.int64()), pa.array(range(len(leaves)), pa.int32())]
                cols += [pa.array([x[k] for x in leaves], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(first) for c in rest), *cols], [*rest, "_row", "_at", "_segment", "_kind", "_leaf"])

    def leaves(batches) -> Iterator[pa.RecordBatch]:
        codec = bpe(path, most)
        for b in small_batches(batches, "_leaf", cache="tokens"):
            ids = [codec.encode_leaf(k, x) for k, x in zip(b.column("_kind").to_pylist(), b.column("_leaf").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, "_ids"])

    def join(batches) -> Iterator[pa.RecordBatch]:
        codec, own, some, done, size = bpe(path, most), None, [], [], 0

        def out() -> pa.RecordBatch:
            cols = [pa.concat_arrays([x.column(c) for x, _ in done]) for c in rest]
            return pa.RecordBatch.from_arrays([*cols, *make(codec, [x[0] for _, x in done], [x[1] for _, x in done])], [*rest, *names])

        for b in small_batches(batches, "_leaf", cache="tokens"):
            for i, leaf in enumerate(zip(*(b.column(c).to_pylist() for c in ("_at", "_segment", "_kind", "_leaf", "_ids")), strict=True)):
                if leaf[0] == 0:
                    if own is not None:
                        done.append((own, codec.glue(some)))
                        size += done[-1][1][0].nbytes
                        if size > BATCH_BYTES or len(done) >= 256:
                            yield out()
                            done, size = [], 0
                    own, some = b.slice(i, 1), []
                some.append(leaf[1:])
        if own is not None:
            done.append((own, codec.glue(some)))
            yield out()

    size = F.coalesce(F.octet_length(text), F.lit(0))
    need = list(dict.fromkeys([*rest, text]))
    direct = docs.where(size <= over).select(*need).mapInArrow(short, f"{kinds}{fields}")
    cuts = docs.where(size > over).select(*need).withColumn("_row", F.monotonically_increasing_id())
    inner = f"{kinds}_row long, _at int, _segment int, _kind int, _leaf binary"
    done = cuts.mapInArrow(cut, inner).repartition("_row", "_at").mapInArrow(leaves, f"{inner}, _ids binary")
    joined = done.repartition("_row").sortWithinPartitions("_row", "_at").mapInArrow(join, f"{kinds}{fields}")
    return direct.union(joined)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with n_tokens and ids array<int> (ids below 2**31). Null and empty texts have no ids."""
    keep, called = set_aside(docs, (text,), ("n_tokens", ids))

    def make(codec: Bpe, got: list[np.ndarray], joins: list[int]) -> list[pa.Array]:
        n = np.array([len(x) for x in got], dtype=np.int64)
        return [pa.array(n), list_array(np.concatenate(got).view(np.int32), n, pa.int32())]

    return map_ids(keep, path, text, keep.columns, "n_tokens long, ids array<int>", make).toDF(*called.values(), "n_tokens", ids)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text that ids stand for; null ids give an empty text."""
    bound_batches(rows.sparkSession)
    keep = rows.select(*[c for c in rows.columns if c != text])

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = bpe(path)
        for b in small_batches(batches, ids, cache="tokens"):
            got = codec.decode_batch([np.array(x or [], dtype=np.uint32) for x in b.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)
    return keep.mapInArrow(run, f"{kinds}, `{text}` string")


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs (without their text) with n_tokens, ids_sha256, decoded_sha256 and n_joins (of leaves of a long text), encoded and
    decoded in one pass; with_ids adds ids. A null text is empty."""
    import hashlib

    new = ["n_tokens", "ids_sha256", "decoded_sha256", "n_joins", *(["ids"] if with_ids else [])]
    keep, called = set_aside(docs, (text,), new)
    rest = [c for c in keep.columns if c != text]

    def make(codec: Bpe, got: list[np.ndarray], joins: list[int]) -> list[pa.Array]:
        n = np.array([len(x) for x in got], dtype=np.int64)
        sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got]
        back = [hashlib.sha256(x.encode()).hexdigest() for x in codec.decode_batch(got)]
        return [pa.array(n), pa.array(sha), pa.array(back), pa.array(joins, pa.int32()), *([list_array(np.concatenate(got).view(np.int32), n, pa.int32())] if with_ids else [])]

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins int" + (", ids array<int>" if with_ids else "")
    return map_ids(keep, path, text, rest, fields, make, CACHE // 3).toDF(*(called[c] for c in rest), *new)


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, vocabulary())
