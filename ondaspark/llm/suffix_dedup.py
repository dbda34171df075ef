"""Removal of every byte that a 100-byte string covers which also starts earlier in the collection.

The suffix order of a whole collection, built column by column, takes as many
rounds as its longest text has bytes and rewrites the collection's transform
in each. So the collection is first cut where order cannot matter: every
100-byte window has an anchor (its smallest hashed ANCHOR-byte string,
leftmost on ties), equal windows have equal anchors at equal places, and the
windows of one anchor occurrence form a span. Spans meet by anchor:

* a span equal to an earlier span of its anchor is removed whole;
* anchors with several different spans give the first occurrence of each to
  the column-wise construction: in round j one symbol of every string is
  inserted into the Burrows-Wheeler transform of all suffixes shorter than j,
  by rank counts alone; the finished transform is walked once for the suffix
  order, and neighbours' common prefixes of 100 bytes give the equal windows,
  of which all but the earliest are removed;
* anchors with more different spans than MAX_SPANS (a passage that very many
  documents share amid different text) are compared by window instead, in an
  aggregate that is combined before its shuffle.

All three are exact. Strings are judged on the input, and never cross rows.

Defined cases: null and empty texts, and texts of fewer than 100 bytes, lose
nothing; a null doc_id sorts before all others; rows that repeat doc_id and
text are the same place and get the same result; rows that share a doc_id but
not the text are ordered by a checksum of the text; other columns are
ignored. A window is told by two 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, binary_column, bloom_filter, documents, in_bloom, materialise, mix, prefix_hash, raw, signed, span_hash

LENGTH = 100
ANCHOR = 32
#: Every window holds its anchor and CORE bytes more on one side of it.
CORE = (LENGTH - ANCHOR) // 2
#: Different spans of an anchor that are compared in one bucket (a bucket of so many takes about 30 MB).
MAX_SPANS = 20_000
#: Strings that a bucket of the construction holds on average.
BUCKET = 2000
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
_POSITION_BITS = 28
_NULL_DOC = -(1 << 63)
#: In place of a span that its own row holds earlier; its anchor is then any number.
REPEATED = -(1 << 63) + 1

# place = checksum of the text (24 bits), start (32 bits), number of windows in the span (7 bits)
_START_SHIFT, _TIE_SHIFT = 7, 39


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor hash, span hash, start in data, anchor's place in the span) of every anchor occurrence."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64, np.int64))
    if n < LENGTH:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - ANCHOR + 1)
    grams = span_hash(prefix, at, at + ANCHOR)
    low = U((1 << _POSITION_BITS) - 1)
    least = (grams & ~low) | at.astype(U)
    width, have = LENGTH - ANCHOR + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & low).astype(np.int64)  # of the window that starts here
    row_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= offs[1:][row_of])
    if not len(inside):
        return none
    a = anchor[inside]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row_of[inside][1:] != row_of[inside][:-1])]))
    p0 = inside[head]
    p1 = inside[np.concatenate([head[1:], [len(inside)]]) - 1]
    a = a[head]
    row = row_of[p0]
    content = span_hash(prefix, p0, p1 + LENGTH)
    return row, p0 - offs[row], p1 - p0 + 1, grams[a], mix(content ^ mix((a - p0).astype(U) + U(1))), p0, a - p0


def pieces(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(bytes, offsets, first row, start in its row) of runs of rows; longer rows come in pieces that share LENGTH - 1 bytes.

    An anchor occurrence that two pieces share is split in two spans there, and so is
    every equal one only where it stands likewise; the parts are compared by window.
    """
    data, offs = raw(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE, "right")) - 1)
        if hi == lo + 1 and offs[hi] - offs[lo] > PIECE:
            for start in range(0, int(offs[hi] - offs[lo]) - LENGTH + 1, PIECE):
                part = data[offs[lo] + start : min(offs[lo] + start + PIECE + LENGTH - 1, offs[hi])]
                yield part, np.array([0, len(part)]), lo, np.array([start])
        else:
            yield data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, np.zeros(hi - lo, np.int64)
        lo = hi


def _ties(col: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(x.as_buffer()) & 0xFFFFFF for x in col], np.int64)


def _again(row: np.ndarray, anchor: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Spans that the same row holds earlier. They are repeats already, so they needn't meet the others of their anchor."""
    key = mix(mix(anchor.view(U) ^ mix(row.astype(U) + U(1))) ^ span.view(U))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return again


def _occurrences(strings_of: tuple | None = None):
    """Anchor occurrences of every text; or, given a filter, those spans it may hold, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, doc = binary_column(batch, "text"), batch.column("doc").to_numpy()
            tie = _ties(col)
            for data, offs, first, base in pieces(col):
                row, start, count, anchor, span, at, inner = spans(data, offs)
                place = (tie[first + row] << _TIE_SHIFT) | ((start + base[row]) << _START_SHIFT) | count
                columns = [signed(anchor), signed(span), doc[first + row], place]
                names = ["anchor", "span", "doc", "place"]
                if strings_of is None:
                    again = _again(row, columns[0], columns[1])
                    columns[0] = np.where(again, signed(mix((place ^ columns[2]).view(U))), columns[0])
                    columns[1] = np.where(again, REPEATED, columns[1])
                    for i in range(0, len(place), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=names)
                else:
                    hit = np.flatnonzero(in_bloom(columns[1] ^ place ^ columns[2], strings_of[0].value))
                    texts = pa.array([data[at[i] : at[i] + count[i] + LENGTH - 1].tobytes() for i in hit], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[pa.array(c[hit]) for c in columns], pa.array(inner[hit]), texts], names=[*names, "inner", "text"])

    return run


# --------------------------------------------------------------------------- the column-wise construction


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string, length) of every non-empty suffix of all strings, in order; equal suffixes stand in string order.

    Round j inserts, for each string of at least j symbols, its suffix of j symbols: from the place of its shorter
    suffix and that row's symbol c, the new place is the number of empty suffixes, of symbols below c and of c's above that place.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    size = np.array([len(s) for s in strings])
    alphabet, codes = np.unique(np.frombuffer(b"".join(strings), np.uint8), return_inverse=True)
    codes = (codes + 1).astype(np.uint8 if len(alphabet) < 256 else np.uint16)  # 0 ends a string
    ends = np.cumsum(size)
    symbol = lambda rows, j: np.where(size[rows] > j, codes[np.maximum(ends[rows] - 1 - j, 0)], 0).astype(codes.dtype)
    rows = np.arange(n)
    bwt = symbol(rows, 0)
    place = np.arange(n)
    for j in range(1, int(size.max(initial=0)) + 1):
        live = size[rows] >= j
        rows, place = rows[live], place[live]
        new = n + _last_to_first(bwt)[place]
        grown = np.empty(len(bwt) + len(rows), codes.dtype)
        old = np.ones(len(grown), bool)
        old[new] = False
        grown[old] = bwt
        grown[new] = symbol(rows, j)
        bwt, place = grown, new
    lf = _last_to_first(bwt) + n
    string, length = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    rows, place = np.arange(n), np.arange(n)
    for j in range(int(size.max(initial=0)) + 1):
        live = size[rows] >= j
        rows, place = rows[live], place[live]
        string[place], length[place] = rows, j
        place = lf[place]
    return string[n:], length[n:]


def _last_to_first(bwt: np.ndarray) -> np.ndarray:
    """For each row with a symbol, how many rows' symbols are smaller, or equal and above."""
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int64)
    out[order] = np.arange(len(bwt))
    return out - np.count_nonzero(bwt == 0)


def equal_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, string, start) of every LENGTH-byte window that has an equal one, by common prefixes of neighbouring suffixes."""
    string, length = transform(strings)
    size = np.array([len(s) for s in strings], np.int64)
    long_ = length >= LENGTH  # suffixes that share a window's bytes stand together and are all long
    string, start = string[long_], (size[string] - length)[long_]
    adjacent = np.flatnonzero(long_)
    text = np.frombuffer(b"".join(strings), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])[string] + start
    same = np.zeros(len(at), bool)
    for i in range(1, len(at), 50_000):
        k = np.arange(i, min(i + 50_000, len(at)))
        k = k[adjacent[k] == adjacent[k - 1] + 1]
        steps = np.arange(LENGTH)
        same[k] = (text[at[k][:, None] + steps] == text[at[k - 1][:, None] + steps]).all(axis=1)
    group = np.cumsum(~same)
    many = same | np.concatenate([same[1:], [False]])
    return group[many], string[many], start[many]


def _shared_parts(anchors: list[int], inner: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, bytes left out in front, string) of the parts of spans whose windows may have equals.

    A window starts either CORE bytes or more before its anchor, and then holds
    those bytes and the anchor, or later, and then holds the anchor and CORE
    bytes more. A part stays if another span of its anchor has the same core.
    """
    cores: dict[tuple, int] = {}
    parts = []
    for i, (a, at, text) in enumerate(zip(anchors, inner, texts, strict=True)):
        for lo, hi, early in ((0, min(at - CORE + LENGTH, len(text)), True), (max(0, at - CORE + 1), len(text), False)):
            if hi - lo >= LENGTH and (not early or at >= CORE):
                core = (a, early, text[at - CORE : at + ANCHOR] if early else text[at : at + ANCHOR + CORE])
                cores[core] = cores.get(core, 0) + 1
                parts.append((i, lo, text[lo:hi], core))
    parts = [p for p in parts if cores[p[3]] > 1]
    return np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64), [p[2] for p in parts]


def _compare(bucket: pa.Table) -> pa.Table:
    """A bucket's spans to the byte intervals (doc, tie, lo, hi) of windows that start earlier elsewhere."""
    row, skip, strings = _shared_parts(bucket.column("anchor").to_pylist(), bucket.column("inner").to_pylist(), bucket.column("text").to_pylist())
    doc, place = bucket.column("doc").to_numpy()[row], bucket.column("place").to_numpy()[row]
    tie, base = place >> _TIE_SHIFT, (place >> _START_SHIFT & 0xFFFFFFFF) + skip
    group, string, start = equal_windows(strings)
    order = np.lexsort((base[string] + start, tie[string], doc[string], group))
    group, string, start = group[order], string[order], start[order]
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    where = lambda i: (doc[string[i]], tie[string[i]], base[string[i]] + start[i])
    mine, least = where(np.arange(len(group))), where(first)
    gone = np.zeros(len(group), bool)
    for a, b in zip(mine, least, strict=True):
        gone |= a != b
    return pa.Table.from_batches([_intervals(mine[0][gone], mine[1][gone], mine[2][gone])])


def _intervals(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows merged where their bytes touch."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    if len(doc):
        head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + LENGTH)])
        lo = np.flatnonzero(head)
        last = np.concatenate([lo[1:], [len(doc)]]) - 1
        doc, tie, start, end = doc[lo], tie[lo], start[lo], start[last] + LENGTH
    else:
        end = start
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, tie, start, end)], names=["doc", "tie", "lo", "hi"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to single windows: two hashes and the place."""
    for batch in batches:
        for text, doc, place in zip(batch.column("text"), batch.column("doc").to_pylist(), batch.column("place").to_pylist(), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            one, two = (span_hash(prefix_hash(d), at, at + LENGTH) for d in (data, data[::-1]))
            start = at + (place >> _START_SHIFT & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(signed(one)), pa.array(signed(two[::-1].copy())), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), place >> _TIE_SHIFT)), pa.array(start)], names=["h", "g", "doc", "tie", "lo"])


# --------------------------------------------------------------------------- the operator


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tie, lo, hi): byte intervals of repeated strings, some touching or overlapping; doc is doc_id with a stand-in for null."""
    spark = docs.sparkSession
    texts = _keyed(docs)
    found = texts.mapInArrow(_occurrences(), "anchor long, span long, doc long, place long").repartition("anchor")
    by_span = Window.partitionBy("anchor", "span").orderBy("doc", "place").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.withColumn("first", F.first(F.struct("doc", "place")).over(by_span)).withColumn("new", (F.col("first.doc") == F.col("doc")) & (F.col("first.place") == F.col("place")) & (F.col("span") != REPEATED))
    # different spans of the anchor: a span's first occurrence counts (rows repeated whole stand in one place and count alike)
    counted = marked.withColumn("spans", F.sum(F.col("new").cast("int")).over(Window.partitionBy("anchor")))
    marked = materialise(counted.where(~F.col("new") | (F.col("spans") > 1)).select("anchor", "span", "doc", "place", "new", "spans"))
    start = F.shiftright("place", _START_SHIFT).bitwiseAND(0xFFFFFFFF)
    whole = marked.where(~F.col("new")).select("doc", F.shiftright("place", _TIE_SHIFT).alias("tie"), start.alias("lo"), (start + F.col("place").bitwiseAND(127) + LENGTH - 1).alias("hi"))

    some = marked.where("new")
    bloom = spark.sparkContext.broadcast(bloom_filter(some.select(F.col("span").bitwiseXOR(F.col("place")).bitwiseXOR(F.col("doc")).alias("k")), "k"))
    strings = texts.mapInArrow(_occurrences((bloom,)), "anchor long, span long, doc long, place long, inner long, text binary")
    strings = materialise(strings.join(some.select("anchor", "span", "doc", "place", "spans").distinct(), ["anchor", "span", "doc", "place"]))
    buckets = max(1, strings.where(F.col("spans") <= MAX_SPANS).count() // BUCKET)
    bucketed = strings.where(F.col("spans") <= MAX_SPANS).select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "anchor", "inner", "doc", "place", "text")
    compared = bucketed.groupBy("bucket").applyInArrow(_compare, "doc long, tie long, lo long, hi long")

    single = strings.where(F.col("spans") > MAX_SPANS).select("doc", "place", "text").mapInArrow(_windows, "h long, g long, doc long, tie long, lo long")
    least = single.groupBy("h", "g").agg(F.min(F.struct("doc", "tie", "lo")).alias("least"))
    later = single.join(least, ["h", "g"]).where((F.col("least.doc") != F.col("doc")) | (F.col("least.tie") != F.col("tie")) | (F.col("least.lo") != F.col("lo")))
    return whole.union(compared).union(later.select("doc", "tie", "lo", (F.col("lo") + LENGTH).alias("hi")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NULL_DOC).cast("long")).alias("doc"), F.col("text").cast("binary").alias("text"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<lo:long,hi:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, cuts = binary_column(batch, "text"), batch.column("cuts")
        for lo in range(0, len(col), 256):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(col.slice(lo, 256), cuts.slice(lo, 256).to_pylist(), strict=True):
                raw_ = text.as_py()
                merged: list[list[int]] = []
                for c in sorted((c["lo"], c["hi"]) for c in found or []):
                    if merged and c[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c[1])
                    else:
                        merged.append(list(c))
                edges = [0, *(x for c in merged for x in c), len(raw_)]
                kept = b"".join(raw_[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for o, x in zip(out, (len(raw_), len(raw_) - len(kept), len(merged), [{"lo": a, "hi": b} for a, b in merged], kept), strict=True):
                    o.append(x)
            ids = batch.column("doc_id").slice(lo, 256)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])


def remove(docs: DataFrame) -> DataFrame:
    """A row per document: RESULT, with the removed intervals (maximal runs) and the bytes that stay."""
    cuts = materialise(repeats(docs))
    per_doc = cuts.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))  # bounded by a document's own windows
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NULL_DOC).cast("long")).alias("doc"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).bitwiseAND(0xFFFFFF).alias("tie"), F.col("text").cast("binary").alias("text"))
    return keyed.join(per_doc, ["doc", "tie"], "left").select("doc_id", "text", "cuts").mapInArrow(_cut, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
