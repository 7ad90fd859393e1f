"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions, and decoding.

Chunks of documents list their distinct words once; equal words of many chunks meet in one group, where each becomes one row
for the fold; the ids go back to the chunks, which spell their documents with them. Both ways travel in compressed
pieces, never more of them than there are listed words. No table of words passes through the driver.
"""

import base64
import heapq
import json
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored

CELLS = 1 << 13  # the rank map is a literal array of small maps, so that a look-up compares a few keys
SHIFT = 20
PLACES = 1 << SHIFT  # more than the bytes of a word that is folded
FOLD_BYTES = 512  # the fold copies its state at every merge, so longer words (rare) are merged with a heap in the task
CHUNK_BYTES = 32 << 20  # text whose words are listed together
SLICE_WORDS = 1 << 20  # words that are spelled at once
BUCKET_WORDS = 200_000  # listed words that meet in one group
RETURNED_PLACES = 2_000_000  # places of folded words that a task sends back together
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The white space of Unicode, of which any before a space makes a longer run.
BEFORE_SPACE = [f"{c} " for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")  # no match of the pattern crosses from a letter or sign to a blank
CHUNKS = "chunk bigint, docs binary, numbers binary, known array<array<int>>, words array<binary>"
DEALT = "bucket bigint, chunk bigint, n int, bytes int, places binary, sizes binary, text binary"
DEALT_NAMES = [c.split()[0] for c in DEALT.split(", ")]
DEALT_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
BACK = "chunk bigint, n int, n_ids int, numbers binary, sizes binary, ids binary"
BACK_NAMES = [c.split()[0] for c in BACK.split(", ")]
BACK_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: cell XXH64(token) mod CELLS holds token -> rank * PLACES; bytes are written as characters."""
    cells = [{} for _ in range(CELLS)]
    for token, rank in ranks.items():
        name = token.decode("latin-1")
        cells[xxhash.xxh64_intdigest(name.encode(), 42) % CELLS][name] = rank * PLACES
    return F.from_json(F.lit(json.dumps(cells)), "array<map<string,bigint>>")


def let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def encoded(word: Column, ranks: Column) -> Column:
    """Ids (array of int) of a word given as binary: its own rank, or else the lowest-ranked neighbours merged again and again.

    The state holds the first places of the pieces and, for each place, rank * PLACES + place if a piece starts there that
    is a token together with the one before it. The least entry is the lowest rank, leftmost on ties; its piece joins the one before,
    and the places beside it are looked up anew. ``ranks`` is bound once, so the plan holds it once.
    """

    def either(chars, ranks):
        def rank(a, b):
            span = F.substring(chars, a, b - a)
            return ranks[F.xxhash64(span).bitwiseAND(F.lit(CELLS - 1)).cast("int")][span]

        def merge(state, _):
            def join(at):
                def beside(b):
                    def entry(e, j):
                        kept = F.when((j < b["left"]) | (j > b["right"]), e)
                        return kept.when(j == b["left"], rank(b["before"], b["right"]) + j).when(j == b["right"], rank(b["left"], b["after"]) + j)

                    return F.struct(F.array_remove(state["starts"], b["at"]).alias("starts"), F.transform(state["open"], entry).alias("open"))

                starts = state["starts"]
                near = let(F.array_position(starts, at).cast("int"), lambda i: F.struct(F.get(starts, i - 3).alias("before"), starts[i - 2].alias("left"), at.alias("at"), starts[i].alias("right"), F.get(starts, i + 1).alias("after")))
                return let(near, beside)

            return let((F.array_min(state["open"]) % PLACES).cast("int"), lambda at: F.when(at.isNull(), state).otherwise(join(at)))

        def fold(n):
            # starts: 1 .. n, and n + 1 for the end; open: places 0 .. n + 1
            first = F.struct(F.sequence(F.lit(1), n + 1).alias("starts"), F.transform(F.sequence(F.lit(0), n + 1), lambda j: F.when((j > 1) & (j <= n), rank(j - 1, j + 1) + j)).alias("open"))
            starts = F.aggregate(F.sequence(F.lit(2), n), first, merge, lambda s: s["starts"])
            return let(starts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, i: F.shiftright(rank(a, c[i + 1]), SHIFT).cast("int")))

        own = rank(F.lit(1), F.length(chars) + 1)
        return F.when(own.isNotNull(), F.array(F.shiftright(own, SHIFT).cast("int"))).otherwise(let(F.octet_length(word), fold))

    return let(ranks, lambda bound: let(F.decode(word, "ISO-8859-1"), lambda chars: either(chars, bound)))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word: a heap of neighbours and links between pieces, n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the piece at i reaches to end[i]
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] == n or end[end[i]] != stop:
            continue  # one of the two has changed since
        alive[end[i]] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        for a in (before[i], i):
            if a >= 0 and end[a] < n and (span := word[a : end[end[a]]]) in ranks:
                heapq.heappush(heap, (ranks[span], a, end[end[a]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Numbers(dict):
    """Numbers of the words of each unit, ``lead`` standing before it; a new unit is cut by the pattern."""

    def __init__(self, cut, lead, words):
        super().__init__()
        self.cut, self.lead, self.words = cut, lead, words
        self.letters = cut(f"{lead}ab") == [f"{lead}ab"]  # the pattern takes a run of letters whole

    def __missing__(self, unit):
        words, text = self.words, self.lead + unit
        parts = (text,) if self.letters and unit.isalpha() else self.cut(text)
        found = self[unit] = tuple([words.setdefault(w, len(words)) for w in parts])
        return found


class _Chunk:
    """Documents as numbers of words, and the words in the order of their numbers."""

    def __init__(self, cut):
        self.words: dict[str, int] = {}
        self.plain, self.spaced = _Numbers(cut, "", self.words), _Numbers(cut, " ", self.words)
        self.ids, self.sizes, self.numbers, self.bytes = [], [], array("I"), 0

    def add(self, doc_id, text):
        before = len(self.numbers)
        if any(pair in text for pair in BEFORE_SPACE):
            units = UNIT.findall(text) if len(text) < 1 << 22 else (m[0] for m in UNIT.finditer(text))
            self.numbers.extend(chain.from_iterable(map(self.plain.__getitem__, units)))
        elif text:  # every space begins a unit
            units = text.split(" ")
            self.numbers.extend(self.plain[units[0]])
            del units[0]
            self.numbers.extend(chain.from_iterable(map(self.spaced.__getitem__, units)))
        self.ids.append(doc_id)
        self.sizes.append(len(self.numbers) - before)
        self.bytes += len(text) + 64


# Frequent words get small numbers, and bytes of equal weight stand side by side, so that the numbers compress well.
def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _chunking(pattern: str, ranks: dict[bytes, int]):
    """Rows (doc_id, text) to chunks: documents, words to fold, and the ids of words that are tokens or long."""

    def row(at, chunk):
        seen = np.frombuffer(chunk.numbers, np.uint32)
        words = [w.encode() for w in chunk.words]
        often = np.bincount(seen, minlength=len(words)).tolist()
        ready = [w in ranks or len(w) > FOLD_BYTES for w in words]
        order = sorted(range(len(words)), key=lambda i: (not ready[i], -often[i], words[i]))
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        known = [words[i] for i in order if ready[i]]
        ids = [[ranks[w]] if w in ranks else merged(w, ranks) for w in known]
        docs = pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes, pa.int64())], names=["doc_id", "size"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(docs)
        values = [
            pa.array([at], pa.int64()),
            pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            pa.array([_packed(number[seen])], pa.binary()),
            pa.array([ids], pa.list_(pa.list_(pa.int32()))),
            pa.array([[words[i] for i in order[len(known) :]]], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(values, names=["chunk", "docs", "numbers", "known", "words"])

    def chunk(batches):
        at, cut = TaskContext.get().partitionId() << 16, regex.compile(pattern).findall
        now = _Chunk(cut)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                now.add(doc_id, text.as_py() or "")
                if now.bytes >= CHUNK_BYTES:
                    yield row(at, now)
                    at, now = at + 1, _Chunk(cut)
        if now.ids:
            yield row(at, now)

    return chunk


def _zip(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(a.tobytes(), codec="zstd", asbytes=True) for a in arrays]


def _unzip(packed: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _dealing(buckets: int):
    """The words of each chunk, cut by a hash of the word into rows for ``buckets`` groups."""

    def deal(batches):
        for batch in batches:
            for chunk, known, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words.as_py()
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    if lo < hi:
                        some = [words[i] for i in order[lo:hi]]
                        text = b"".join(some)
                        sizes = np.fromiter(map(len, some), "<u2", hi - lo)
                        rows.append((k, chunk, hi - lo, len(text), *_zip(np.diff(order[lo:hi] + known, prepend=0).astype("<u4"), sizes, np.frombuffer(text, np.uint8))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), DEALT_KINDS)], names=DEALT_NAMES)

    return deal


def _gather(part: pa.Table) -> pa.Table:
    """The distinct words of a bucket with their places: chunk, and below 2^32 the number there."""
    found: dict[bytes, list] = {}
    for row in part.to_pylist():
        sizes = _unzip(row["sizes"], "<u2", row["n"]).astype(np.int64)
        text = pa.decompress(row["text"], decompressed_size=row["bytes"], codec="zstd", asbytes=True)
        ends = np.cumsum(sizes)
        places = (row["chunk"] << 32) + np.cumsum(_unzip(row["places"], "<u4", row["n"]).astype(np.int64))
        for lo, hi, place in zip((ends - sizes).tolist(), ends.tolist(), places.tolist()):
            found.setdefault(text[lo:hi], []).append(place)
    return pa.table({"word": pa.array(found.keys(), pa.binary()), "places": pa.array(found.values(), pa.list_(pa.int64()))})


def _picked(values: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``start`` and are ``width`` long, one after another."""
    ends = np.cumsum(width)
    return values[np.repeat(start - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)]


def _returning(batches):
    """Rows (ids, places) of folded words to one row per chunk: its numbers, and how many and which ids each has."""

    def rows(held):
        place, start, width, values = [], [], [], []
        base = 0
        for ids, places in held:
            lengths, counts = np.diff(ids.offsets.to_numpy()), np.diff(places.offsets.to_numpy())
            own = np.repeat(np.arange(len(ids)), counts)
            flat = ids.flatten().to_numpy()
            place.append(places.flatten().to_numpy())
            start.append((np.cumsum(lengths) - lengths)[own] + base)
            width.append(lengths[own])
            values.append(flat)
            base += len(flat)
        place, start, width, values = (np.concatenate(x).astype(np.int64) for x in (place, start, width, values))
        order = np.argsort(place)
        place, start, width = place[order], start[order], width[order]
        cuts = np.flatnonzero(np.diff(place >> 32, prepend=-1))
        out = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
            ids = _picked(values, start[lo:hi], width[lo:hi])
            number = np.diff(place[lo:hi] & ((1 << 32) - 1), prepend=0)
            out.append((int(place[lo]) >> 32, hi - lo, len(ids), *_zip(number.astype("<u4"), width[lo:hi].astype("<u2")), _packed(ids)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), BACK_KINDS)], names=BACK_NAMES)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0), batch.column(1)))
            size += len(batch.column(1).values)
        if size >= RETURNED_PLACES:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def _spell(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one chunk as ids; ``found`` has the ids of its folded words. Both columns share one buffer of ids."""
    if not chunk.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "packed": pa.array([], pa.binary())})
    first = {c: chunk.column(c)[0] for c in chunk.column_names}
    known = first["known"].values.cast(pa.list_(pa.int32()))
    at, width = [np.arange(len(known))], [np.diff(known.offsets.to_numpy())]
    values = [known.flatten().to_numpy()]
    for row in found.to_pylist():
        at.append(np.cumsum(_unzip(row["numbers"], "<u4", row["n"]).astype(np.int64)))
        width.append(_unzip(row["sizes"], "<u2", row["n"]))
        values.append(_unpacked(row["ids"], row["n_ids"]))
    at, sizes, values = np.concatenate(at), np.concatenate(width).astype(np.int64), np.concatenate(values).astype(np.int32)
    start, width = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    start[at], width[at] = np.cumsum(sizes) - sizes, sizes
    docs = pa.ipc.open_stream(first["docs"].as_py()).read_all()
    words = docs.column("size").to_numpy()
    numbers = _unpacked(first["numbers"].as_py(), int(words.sum()))
    upto = np.concatenate([[0], np.cumsum(width[numbers])])
    ends = upto[np.concatenate([[0], np.cumsum(words)])].astype(np.int32)
    spelled = np.empty(int(upto[-1]), "<i4")
    for lo in range(0, len(numbers), SLICE_WORDS):
        part = numbers[lo : lo + SLICE_WORDS]
        spelled[upto[lo] : upto[lo + len(part)]] = _picked(values, start[part], width[part])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spelled, pa.int32()))
    packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(spelled)])
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "ids": ids, "packed": packed})


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and packed (the ids as little-endian unsigned 32-bit integers) of every row of ``docs``.

    ``path`` names the file of ranks, ``pattern`` cuts a text into words. A null or empty text has no ids; repeated rows and
    null doc_ids come out as often as they go in; an empty table gives an empty one. Extra columns are left out.
    """
    ranks = read_ranks(path)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chunks = stored(texts.mapInArrow(_chunking(pattern, ranks), CHUNKS), "zstd")
    listed = chunks.select(F.sum(F.size("words"))).first()[0] or 0
    words = chunks.select("chunk", F.size("known").alias("known"), "words").mapInArrow(_dealing(1 + listed // BUCKET_WORDS), DEALT)
    folded = words.groupBy("bucket").applyInArrow(_gather, "word binary, places array<bigint>").select(encoded(F.col("word"), rank_map(ranks)).alias("ids"), "places")
    back = folded.mapInArrow(_returning, BACK)
    return chunks.select("chunk", "docs", "numbers", "known").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_spell, "doc_id bigint, ids array<int>, packed binary")


def decoded(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: their pieces side by side. An id without a piece adds nothing."""
    pieces = {rank: token for token, rank in read_ranks(path).items()}
    line = " ".join(pieces.get(i, b"").hex() for i in range(max(pieces, default=0) + 1))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(F.split(F.lit(line), " "), i)), ""))
