"""Language-model scoring by logistic context mixing over exact context counts.

Text is taken as tokens: words with A-Z lower-cased, each followed by one
space, then one end. A token's bits are predicted one by one by several
predictors, each with its own context (the last one to four bytes, the token
so far) and exact counts of the bits seen in it. The logistic mixer, whose
weight set is gated by bit and by how often the token so far was seen, and the
final adaptive probability map are trained in rounds over all training
documents, which stand in blocks, each block with the counts of the other
ones. Scoring uses the model as it then stands
and the counts of all blocks, so a score does not depend on the order of
documents.

A token's score is that of its first two bytes (one for the end), which depends
on the three bytes before its space, of whatever words (its head), and that of
its other bytes, which depends on its bytes and the last byte before it (its
key). So every context of one to four bytes reaches back over as many bytes.
Distinct keys and heads are counted, sorted by token and packed in chunks of
bounded size, so a prefix's counts stand in one chunk unless it begins the
chunk's first or last token or is shorter than two bytes. Those prefixes and
the contexts of last bytes are summed in a distributed table, which grows with the corpus; its HEAVY_CONTEXTS
most used entries are broadcast, the rest are joined to the chunks. Scores and
counts of the HEAVY most frequent keys and heads are broadcast in the same way (24 bytes
each), the rest meet their documents in a join.

Defined cases: null or empty text is one end token; a null doc_id counts as
the empty string in the fold; repeated rows count and score separately; an
empty table gives no rows, and without training tokens every count is 0;
other columns are ignored. Tokens and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, binary_column, bounded_batches, chunks, documents, lower, materialise, mix, prefix_hash, raw, signed, span_hash, word_spans

FOLDS, HELD_OUT = 7, 2
#: Most frequent keys whose counts and scores are broadcast, and most used contexts.
HEAVY, HEAVY_CONTEXTS = 1 << 19, 1 << 18
CONTEXTS = 5
#: Blocks of training documents, and passes of the mixer over all of them.
PARTS, PASSES = 2, 2
#: Bytes of text that are cut into tokens at once; keys that a task counts before it passes them on; rows of an Arrow batch, whose bytes are bounded, too.
TEXT_BYTES, COUNTED, ROWS = 1 << 20, 1 << 20, 10_000
#: Entries whose distinct values are found by hash.
HASHED = 1 << 20
#: Spans copied at once.
TAKEN = 1 << 16
#: Keys and bytes of a chunk; one token's keys stay together.
CHUNK_KEYS, CHUNK_TOKEN_BYTES = 1 << 14, 1 << 18
#: Weight sets: eight bits, eight classes of the number of times that the token so far was seen.
GATES = 64
#: Stretched predictions of eight bits and the logarithm of the context's count.
WIDTH = 9
APM_BUCKETS = 33
#: First bytes of a token that its head holds, and what tells contexts apart that reach into the bytes before the last one.
HEAD, ACROSS = 2, 8
END = 10  # line feed: never inside a word
END_HASH = U(0x5851F42D4C957F2D)
_K = [U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x2545F4914F6CDD1D)]


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def part() -> Column:
    """The block of a training document, equal for equal texts, and PARTS for a held-out one."""
    return F.when(held_out(), PARTS).otherwise(F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(PARTS))).cast("int")


# --------------------------------------------------------------------------- tokens


class Tokens:
    """The tokens of some texts: hash, last three bytes before the space that they follow (spaces before a text's start), row, and where their bytes stand."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = lower(data)
        n = len(offs) - 1
        starts, ends, first = word_spans(self.data, offs)
        words = np.diff(first)
        of_word = np.repeat(np.arange(n), words)
        self.row = np.concatenate([of_word, np.arange(n)])
        self.hash = np.concatenate([span_hash(prefix_hash(self.data), starts, ends), np.full(n, END_HASH)])
        last = self.data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        before = np.full(len(starts), 32, np.uint8)
        before[1:] = last[:-1]
        before[first[:-1][words > 0]] = 32
        final = np.full(n, 32, np.uint8)
        final[words > 0] = last[first[1:][words > 0] - 1]
        self.before = np.concatenate([before, final])
        size, prior = ends - starts, np.concatenate([np.arange(len(starts)), first[1:]]) - 1
        known = prior >= first[:-1][self.row]
        self.second, self.third = np.full((2, len(prior)), 32, np.uint8)
        at = np.flatnonzero(known)
        one, two, more = (at[size[prior[at]] == 1], at[size[prior[at]] > 1], at[size[prior[at]] > 2]) if len(at) else (at, at, at)
        one = one[prior[one] > first[:-1][self.row[one]]]
        self.second[two] = self.data[ends[prior[two]] - 2]
        self.third[more] = self.data[ends[prior[more]] - 3]
        self.third[one] = last[prior[one] - 1]
        self.lo = np.concatenate([starts, np.full(n, -1)])
        self.hi = np.concatenate([ends, np.full(n, -1)])
        self.counts = words + 1

    def keys(self) -> np.ndarray:
        return mix(self.hash + (self.before.astype(U) + U(1)) * _K[4])

    def heads(self) -> np.ndarray:
        """Each token's first two bytes (the end: its one) with the three bytes before its space, in one number."""
        word = self.lo >= 0
        b0, b1 = np.full(len(word), END, np.uint8), np.zeros(len(word), np.uint8)
        b0[word] = self.data[self.lo[word]]
        b1[word] = np.where(self.hi[word] - self.lo[word] > 1, self.data[np.minimum(self.lo[word] + 1, max(len(self.data) - 1, 0))], 32)
        return sum(b.astype(U) << U(8 * i) for i, b in enumerate((self.before, self.second, self.third, b0, b1, word)))

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the chosen tokens, each with its closing space, or the end byte alone."""
        size = np.where(self.lo[at] < 0, 1, self.hi[at] - self.lo[at] + 1)
        out, offs = take(np.append(self.data, np.uint8(32)), np.maximum(self.lo[at], 0), size)
        closing = offs[1:] - 1
        out[closing] = np.where(self.lo[at] < 0, END, 32)
        return out, offs


def head_keys(heads: np.ndarray) -> np.ndarray:
    return mix(heads + _K[5])


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, where one of each stands, number of each entry's value): np.unique without its stable sort, for any of equal entries will do."""
    order = np.argsort(x)
    sorted_ = x[order]
    head = np.ones(len(x), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=head[1:])
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return sorted_[head], order[head], inverse


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct value stands, number of each entry's value): up to HASHED entries are hashed, more are sorted, which takes less memory."""
    if len(x) > HASHED:
        return distinct(x)[1:]
    inverse = pa.array(signed(x)).dictionary_encode().indices.to_numpy()
    first = np.empty(int(inverse.max()) + 1 if len(x) else 0, np.int64)
    first[inverse[::-1]] = np.arange(len(x) - 1, -1, -1)
    return first, inverse


def index_of(table: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, where the names with these first bits begin in a sorted table, the table and an end), for look_up."""
    bits = max(1, len(table).bit_length())
    first = np.zeros((1 << bits) + 1, np.int64)
    np.cumsum(np.bincount((table >> U(64 - bits)).astype(np.int64), minlength=1 << bits), out=first[1:])
    return bits, first, np.append(table, ~U(0))  # what is past the end is less than no name


def look_up(table: np.ndarray, names: np.ndarray, index: tuple[int, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Where each 64-bit name stands in a sorted table, -1 if nowhere. Names are well mixed, so their first bits give the place but for a few steps."""
    bits, first, ended = index or index_of(table)
    at = first[(names >> U(64 - bits)).astype(np.int64)]
    out = np.full(len(names), -1, np.int64)
    here = ended[at]
    hit = here == names
    out[hit] = at[hit]
    left = np.flatnonzero(here < names)
    place, want = at[left] + 1, names[left]
    while len(left):
        here = ended[place]
        hit = here == want
        out[left[hit]] = place[hit]
        on = here < want
        left, place, want = left[on], place[on] + 1, want[on]
    out[out == len(table)] = -1
    return out


def take(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the spans of data that start at lo, TAKEN spans at once."""
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.empty(offs[-1], np.uint8)
    for a in range(0, len(size), TAKEN):
        b = min(a + TAKEN, len(size))
        out[offs[a] : offs[b]] = data[np.repeat(lo[a:b] - offs[a:b], size[a:b]) + np.arange(offs[a], offs[b])]
    return out, offs


# --------------------------------------------------------------------------- keys


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a task with their tokens and their counts in each block and in held-out texts; heads likewise, before NO_TOKEN."""
    # (keys, counts, bytes before, tokens, offsets), each with distinct keys: those that wait, and what was merged of them, in which no key stands twice
    new: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[np.ndarray, ...]] = []
    # the sorted keys of all held ones, and where each is counted
    names, place, index = np.zeros(0, U), np.zeros(0, np.int64), index_of(np.zeros(0, U))
    counted = np.zeros((0, PARTS + 1), np.int64)

    def merge() -> None:
        nonlocal new, names, place, index, counted
        key = np.concatenate([h[0] for h in new])
        both, at, inverse = distinct(key)
        total = np.concatenate([h[1] for h in new])
        total = np.stack([np.bincount(inverse, total[:, i], len(both)) for i in range(PARTS + 1)], axis=1).astype(np.int64)
        base = np.cumsum([0, *[len(h[3]) for h in new]])
        starts = np.concatenate([h[4][:-1] + b for h, b in zip(new, base, strict=False)])[at]
        size = np.concatenate([np.diff(h[4]) for h in new])[at]
        data, offs = take(np.concatenate([h[3] for h in new]), starts, size)
        held.append((both, np.concatenate([h[2] for h in new])[at], data, offs))
        new = []
        spot = np.searchsorted(names, both)
        names, place = np.insert(names, spot, both), np.insert(place, spot, len(counted) + np.arange(len(both)))
        counted, index = np.concatenate([counted, total]), index_of(names)

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal names, place, index, counted
        base = 0
        for key, before, data, offs in held:
            for a in range(0, len(key), 50_000):
                b = min(a + 50_000, len(key))
                blob, part_offs = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                token = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(part_offs.tobytes()), pa.py_buffer(blob.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[a:b])), token, pa.array(before[a:b]), *[pa.array(np.ascontiguousarray(counted[base + a : base + b, i])) for i in range(PARTS + 1)]], names=["key", "token", "before", *_COUNTS])
            base += len(key)
        held.clear()
        names, place, counted = names[:0], place[:0], counted[:0]
        index = index_of(names)

    waiting = 0
    for batch in batches:
        parts = batch.column("part").to_numpy()
        for lo, hi, text, text_offs in chunks(binary_column(batch, "text"), TEXT_BYTES):
            key, count, before, data, offs = _keys_in(text, text_offs, parts[lo:hi])
            at = look_up(names, key, index)
            hit = at >= 0
            # the keys are distinct, so no place is met twice
            counted[place[at[hit]]] += count[hit]
            rest = np.flatnonzero(~hit)
            data, rest_offs = take(data, offs[:-1][rest], np.diff(offs)[rest])
            new.append((key[rest], count[rest], before[rest], data, rest_offs))
            waiting += len(rest)
            # keys that are not held yet wait until they are a quarter as many
            if waiting > COUNTED // 4:
                merge()
                waiting = 0
                if len(names) > COUNTED or sum(len(h[2]) for h in held) > 16 * COUNTED:
                    yield from out()
    if new:
        merge()
    yield from out()


def _keys_in(text: np.ndarray, text_offs: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and heads of some texts: (key, counts by block, byte before, tokens, their offsets)."""
    t = Tokens(text, text_offs)
    block = parts[t.row]
    heads = t.heads()
    first, inverse = grouped(heads)
    heads = heads[first]
    of_heads = np.bincount(inverse * (PARTS + 1) + block, minlength=len(heads) * (PARTS + 1))
    keys = t.keys()
    first, inverse = grouped(keys)
    keys = keys[first]
    n = np.concatenate([np.bincount(inverse * (PARTS + 1) + block, minlength=len(keys) * (PARTS + 1)), of_heads]).reshape(-1, PARTS + 1)
    data, offs = t.bytes_of(first)
    data, offs = np.concatenate([data, heads.view(np.uint8)]), np.concatenate([offs, offs[-1] + 8 * np.arange(1, len(heads) + 1)])
    before = np.concatenate([t.before[first].astype(np.int16), np.full(len(heads), NO_TOKEN, np.int16)])
    return np.concatenate([keys, head_keys(heads)]), n, before, data, offs


NO_TOKEN = -1
_COUNTS = [f"c{i}" for i in range(PARTS + 1)]
KEY_SCHEMA = "key long, token binary, before short, " + ", ".join(f"{c} long" for c in _COUNTS)
CHUNK_SCHEMA = "tokens binary, sizes binary, befores binary, keys binary, counts binary, heads binary, head_counts binary, n_train long, n_types long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys in chunks, each a row; chunks end where a token does."""
    held: list[pa.RecordBatch] = []

    def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offs = raw(pa.concat_arrays([pa.array([], pa.large_binary()), *t.column("token").cast(pa.large_binary()).chunks]))
        return data, offs, np.stack([t.column(c).to_numpy() for c in _COUNTS], axis=1)

    def out(t: pa.Table) -> pa.RecordBatch:
        is_head = pa.array(t.column("before").to_numpy() == NO_TOKEN)
        heads, _, head_counts = parts(t.filter(is_head))
        t = t.filter(pa.array(~is_head.to_numpy(zero_copy_only=False)))
        data, offs, counts = parts(t)
        train = counts[:, :PARTS].sum(axis=1)
        types = np.bincount(same_as_before(data, offs), train) > 0
        row = (data.tobytes(), np.diff(offs).astype(np.int32).tobytes(), t.column("before").to_numpy().astype(np.uint8).tobytes(), t.column("key").to_numpy().tobytes(), counts.tobytes(), heads.tobytes(), head_counts.tobytes(), int(train.sum()), int(types.sum()))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], names=["tokens", "sizes", "befores", "keys", "counts", "heads", "head_counts", "n_train", "n_types"])

    n = size = 0
    for batch in batches:
        held.append(batch)
        n, size = n + len(batch), size + batch.column("token").nbytes
        if n >= CHUNK_KEYS or size >= CHUNK_TOKEN_BYTES:
            t = pa.Table.from_batches(held)
            token = t.column("token")
            last = token[-1].as_py()
            end = len(t)
            while end and token[end - 1].as_py() == last:
                end -= 1
            held, n, size = [], 0, 0
            if end:
                yield out(t.slice(0, end))
            if end < len(t):
                held = t.slice(end).to_batches()
                n, size = len(t) - end, sum(b.column("token").nbytes for b in held)
    if n:
        yield out(pa.Table.from_batches(held))


def same_as_before(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For sorted tokens: the number of each one's distinct token."""
    prefix = prefix_hash(data)
    h = span_hash(prefix, offs[:-1], offs[1:])
    return np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))[: len(h)]


# --------------------------------------------------------------------------- contexts


def paths(code: np.ndarray, byte: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretched predictions of the bits of byte in each context, and log2 of one more than the context's count: (rows, columns of counts, WIDTH), half precision.

    Rows are sorted by (code, byte), distinct, and hold every byte counted in their contexts; bits are counted in the byte's tree.
    """
    out = np.empty((len(code), counts.shape[1], WIDTH), np.float16)
    new = np.concatenate([[True], code[1:] != code[:-1]])
    # a context that only one byte followed says the same of each bit but for the sign
    alone = new & np.append(new[1:], True)
    total = counts[alone]
    x = stretched(total, total).astype(np.float16).view(np.uint16)
    out.view(np.uint16)[alone, :, :8] = x[:, :, None] ^ ((1 - np.unpackbits(byte[alone].astype(np.uint8)[:, None], axis=1)[:, None, :].astype(np.uint16)) << 15)
    out[alone, :, 8] = np.log2(total + 1.0)
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return out
    new, byte, counts = new[rest], byte[rest], counts[rest]
    some = np.empty((len(rest), counts.shape[1], WIDTH), np.float16)
    whole = None
    for j in range(9):
        near = byte >> (8 - j)
        head = new | np.concatenate([[True], near[1:] != near[:-1]])
        total = np.add.reduceat(counts, np.flatnonzero(head))[np.cumsum(head) - 1]
        if whole is not None:
            bit = ((byte >> (8 - j)) & 1 == 1)[:, None]
            some[:, :, j - 1] = np.where(bit, 1, -1) * stretched(total, whole)
        else:
            some[:, :, 8] = np.log2(total + 1.0)
        whole = total
    out[rest] = some
    return out


def stretched(total: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The stretched prediction of a bit that total of whole bytes have."""
    n = whole.astype(np.float32)
    odds = (total + np.float32(0.4)) / (whole - total + np.float32(0.4))
    return np.log(odds.astype(np.float32)) * (n / (n + np.float32(1.5))).astype(np.float64)


def with_sum(counts: np.ndarray) -> np.ndarray:
    """Counts of each block and of all."""
    return np.concatenate([counts, counts.sum(axis=1, keepdims=True)], axis=1)


def entry(code: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The 64-bit name of a byte in a context."""
    return mix(code * _K[1] + (byte.astype(U) + U(1)) * _K[3])


class Units:
    """Distinct bytes with their contexts: low (the last four bytes), prefix, byte, weight in each block, and whether they are scored here."""

    low: np.ndarray
    prefix: np.ndarray
    byte: np.ndarray
    weight: np.ndarray
    scored: np.ndarray

    def codes(self) -> list[np.ndarray]:
        """The contexts of all units, by predictor."""
        return [(U(k + 1) << U(32)) | (self.low & U((1 << 8 * (k + 1)) - 1)) for k in range(CONTEXTS - 1)] + [self.prefix]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions among all contexts of those that the table has, which of them are counted here)."""
        raise NotImplementedError

    def uses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, byte, counts) of all contexts that the table has."""
        at, counted = self.found()
        unit = at % max(len(self.low), 1)
        return np.concatenate(self.codes())[at], self.byte[unit], self.weight[unit] * counted[:, None]

    def locate(self, names: np.ndarray, x: np.ndarray, row: dict, index: tuple | None = None) -> Units:
        """Fetch the predictions of all units once: from the broadcast entries (names and x; index_of them), or the joined ones of row."""
        own, own_x = np.frombuffer(row["light"] or b"", U), np.frombuffer(row["light_x"] or b"", np.float16).reshape(-1, PARTS + 1, WIDTH)
        n = len(self.low)
        # halves, by predictor, unit and block; no count is zero in all of them
        self.x = np.zeros((CONTEXTS * n, (PARTS + 1) * WIDTH), np.uint16)
        want, _ = self.found()
        e = entry(np.concatenate(self.codes())[want], self.byte[want % max(n, 1)])
        for table, of, near in ((names, x, index), (own, own_x, None)):
            if len(table):
                at = look_up(table, e, near)
                hit = at >= 0
                into, at, of = want[hit], at[hit], of.view(np.uint16).reshape(len(table), -1)
                want, e = want[~hit], e[~hit]
                for a in range(0, len(at), TAKEN):
                    self.x[into[a : a + TAKEN]] = of.take(at[a : a + TAKEN], axis=0)
        return self

    def predict(self, of: int, at: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Fill out, (CONTEXTS, units at, WIDTH), with the bits of halves, from the counts of block of (PARTS: of all)."""
        x = self.x.reshape(CONTEXTS, len(self.low), PARTS + 1, WIDTH)
        for k in range(CONTEXTS):
            out[k] = x[k, at, of]
        return out

    def inputs(self, of: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretched predictions (CONTEXTS, 8, units) from the counts of block of (PARTS: of all), units, edges): the units at, by gate, and the edges of the gates' runs."""
        x, order, edges = by_gate(self.predict(of, at, np.empty((CONTEXTS, len(at), WIDTH), np.uint16)))
        return x, at[order], edges


#: Of each half, by its bits.
HALVES = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)


def by_gate(out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretched predictions (CONTEXTS, 8, units), order, edges of the gates' runs)."""
    gate = np.minimum(np.ceil(HALVES.take(out[-1, :, 8]) / 2), 7).astype(np.int8)
    order = np.argsort(gate, kind="stable")
    x = np.empty((CONTEXTS, 8, len(order)), np.float32)
    for k in range(CONTEXTS):
        x[k] = HALVES.take(out[k].take(order, axis=0)[:, :8].T)
    return x, order, np.searchsorted(gate[order], np.arange(9))


class Chunk(Units):
    """The bytes of a chunk's keys, each distinct (prefix, last bytes, byte) once: a unit. Those from a token's third byte on are scored here, the others in the chunk's heads."""

    def __init__(self, row: dict):
        data, size = np.frombuffer(row["tokens"], np.uint8), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        before = np.frombuffer(row["befores"], np.uint8)
        self.heads = Heads(row)
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64).reshape(-1, PARTS + 1)
        self.offs = offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        n = len(data)
        self.token = token = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - offs[token]
        # tokens are sorted, so a prefix is new where a token leaves the one before it
        prior = np.concatenate([[0], size[:-1]])[: len(size)]
        same = place < prior[token]
        same &= data[np.arange(n) - prior[token]] == data
        shared = np.minimum.reduceat(np.where(same, n, place), offs[:-1]) if n else size
        self.type = np.cumsum(shared < n) - 1
        # bytes by place, then in the order of tokens: equal prefixes stand together, and their bytes are sorted
        order = np.argsort(place.astype(np.uint16) if n and size.max() < 1 << 16 else place, kind="stable")
        new = (place >= shared[token])[order]
        edges = np.cumsum([0, *[int(np.count_nonzero(size > p)) for p in range(3)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # up to the third byte the last four bytes reach the one before the token's space
            both = (np.cumsum(new[a:b]) << 8) | before[token[order[a:b]]]
            again = np.argsort(both)
            order[a:b], both = order[a:b][again], both[again]
            new[a:b] = np.concatenate([[True], both[1:] != both[:-1]])[: b - a]
        unit = np.cumsum(new) - 1
        self.unit = np.empty(n, np.int64)
        self.unit[order] = unit
        first = order[new]
        weights = [np.bincount(unit, self.counts[:, i].astype(np.float64)[token[order]], len(first)) for i in range(PARTS)]
        place, of = place[first], token[first]
        del same, order, new, unit
        low = np.zeros(len(first), U)  # the last four bytes: before the token a space, then the last byte of the token before it, then nothing
        for k in range(1, 5):
            b = np.where(place >= k, data[np.maximum(first - k, 0)], np.where(place == k - 1, 32, np.where(place == k - 2, before[of], 0)))
            low |= b.astype(U) << U(8 * (k - 1))
        hashes = prefix_hash(data)
        self.low, self.byte, self.prefix = low, data[first], span_hash(hashes, offs[of], first)
        self.weight = np.stack(weights, axis=1).astype(np.int64)
        self.scored = place >= HEAD
        # prefixes of the first and of the last token may go on in other chunks, and heads stand in any chunk
        self.open = ~self.scored
        for t in (0, -1) if n else ():
            length = int(size[t])
            ends = span_hash(hashes, np.full(length, offs[:-1][t]), offs[:-1][t] + np.arange(length))
            self.open |= (place < length) & (self.prefix == ends[np.minimum(place, length - 1)])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.low)
        at = np.concatenate([np.arange((CONTEXTS - 1) * n), (CONTEXTS - 1) * n + np.flatnonzero(self.open)])
        return at, np.ones(len(at), bool)

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, byte, counts), each once, of all contexts but the prefixes that no other chunk has."""
        code, byte, weight = (np.concatenate(x) for x in zip(self.uses(), self.heads.uses(), strict=True))
        first, inverse = grouped(entry(code, byte))
        counts = np.stack([np.bincount(inverse, weight[:, i], len(first)) for i in range(PARTS)], axis=1).astype(np.int64)
        return code[first], byte[first], counts

    def locate(self, names: np.ndarray, x: np.ndarray, row: dict, index: tuple | None = None) -> Chunk:
        """Fetch the predictions of all units once, also from the chunk's own counts, and those of its heads."""
        super().locate(names, x, row, index)
        self.heads.locate(names, x, row, index)
        rest = np.flatnonzero(~self.open)
        if len(rest):
            # units stand by prefix and byte
            code, byte = self.prefix[rest], self.byte[rest]
            head = np.concatenate([[True], (code[1:] != code[:-1]) | (byte[1:] != byte[:-1])])
            own = paths(code[head], byte[head], np.add.reduceat(with_sum(self.weight)[rest], np.flatnonzero(head)))
            self.x[(CONTEXTS - 1) * len(self.low) + rest] = own.view(np.uint16).reshape(len(own), -1).take(np.cumsum(head) - 1, axis=0)
        return self

    def scored_inputs(self, of: int, block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(stretched predictions, order, edges, bytes, units of chunk and heads) of all scored units, or those with a weight in block; bytes are in order."""
        units = [self, self.heads]
        at = [np.flatnonzero(u.scored if block is None else u.scored & (u.weight[:, block] > 0)) for u in units]
        out = np.empty((CONTEXTS, len(at[0]) + len(at[1]), WIDTH), np.uint16)
        self.predict(of, at[0], out[:, : len(at[0])])
        self.heads.predict(of, at[1], out[:, len(at[0]) :])
        x, order, edges = by_gate(out)
        return x, order, edges, np.concatenate([u.byte[a] for u, a in zip(units, at, strict=True)])[order], at


class Heads(Units):
    """The first two bytes of tokens, after the last bytes of what stands before, however many words that is."""

    def __init__(self, row: dict):
        self.heads = heads = np.frombuffer(row["heads"], U)
        self.counts = np.frombuffer(row["head_counts"], np.int64).reshape(-1, PARTS + 1)
        b0, b1, self.word = (heads >> U(24)) & U(255), (heads >> U(32)) & U(255), (heads >> U(40)) == 1
        lows = [U(32) | ((heads & U(0xFFFFFF)) << U(8)), b0 | U(32 << 8) | ((heads & U(0xFFFF)) << U(16))]
        one = np.arange(256, dtype=np.uint8)
        one = span_hash(prefix_hash(one), np.arange(256), np.arange(1, 257))
        low, prefix, byte = [], [], []
        self.units, weight, n = [], [], 0
        for place, (near, b, of) in enumerate(zip(lows, (b0, b1), (np.ones(len(heads), bool), self.word), strict=True)):
            both, inverse = np.unique(near[of] | (b[of] << U(32)), return_inverse=True)
            low.append(both & U(0xFFFFFFFF))
            byte.append((both >> U(32)).astype(np.uint8))
            prefix.append(one[(both & U(255)).astype(np.int64)] if place else np.zeros(len(both), U))
            weight.append(np.stack([np.bincount(inverse, self.counts[of, i], len(both)) for i in range(PARTS)], axis=1).astype(np.int64))
            self.units.append(n + inverse)
            n += len(both)
        self.first = np.arange(n) < len(low[0])
        self.low, self.prefix, self.byte, self.weight = (np.concatenate(x) for x in (low, prefix, byte, weight))
        self.scored = np.ones(n, bool)

    def codes(self) -> list[np.ndarray]:
        """Contexts that reach further back than a key knows are told apart from those of keys."""
        codes = super().codes()
        return [c + (U(ACROSS) << U(32)) * crossing for c, crossing in zip(codes, self.crossing(), strict=True)]

    def crossing(self) -> list[np.ndarray]:
        none = np.zeros(len(self.low), bool)
        return [none, none, self.first, ~none, none]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        # the chunks' keys count the others
        return np.arange(CONTEXTS * len(self.low)), np.concatenate(self.crossing())

    def log(self, of_units: np.ndarray) -> np.ndarray:
        """A value for each head, from those of units."""
        out = of_units[self.units[0]]
        out[self.word] += of_units[self.units[1]]
        return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            code, byte, counts = Chunk(row).shared()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row["chunk"])), pa.array(signed(code)), pa.array(byte.astype(np.int16)), pa.array(signed(entry(code, byte))), *[pa.array(np.ascontiguousarray(counts[:, i])) for i in range(PARTS)]], names=["chunk", "code", "byte", "e", *_COUNTS[:PARTS]])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of sorted contexts; a context that a batch's end may cut waits for the next."""
    held = None

    def out(t: pa.Table) -> pa.RecordBatch:
        x = paths(t.column("code").to_numpy(), t.column("byte").to_numpy(), with_sum(np.stack([t.column(c).to_numpy() for c in _COUNTS[:PARTS]], axis=1)))
        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x[0].nbytes), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("e", "c")] + [blob], names=["e", "c", "x"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(t):
            continue
        code = t.column("code").to_numpy()
        end = len(code) - int(np.argmax(code[::-1] != code[-1])) if code[0] != code[-1] else 0
        if end:
            yield out(t.slice(0, end))
        held = t.slice(end)
    if held is not None and len(held):
        yield out(held)


def keys_of(docs: DataFrame) -> DataFrame:
    """(chunk, packed keys and heads) of all documents, sorted by token."""
    rows = docs.select(F.col("text").cast("binary").alias("text"), part().alias("part")).mapInArrow(_count_keys, KEY_SCHEMA)
    # tasks pass keys on counted, so they are dealt as they are: an aggregate before the exchange would sort them in vain
    # a key's token and byte before are grouped by, not taken from the first row, which Spark can't do but by sorting
    keys = rows.repartition("key").groupBy("key", "token", "before").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    ranged = keys.withColumn("head", F.substring("token", 1, 256)).repartitionByRange("head").drop("head").sortWithinPartitions("token", "before")
    return materialise(ranged.mapInArrow(_pack, CHUNK_SCHEMA).withColumn("chunk", F.monotonically_increasing_id()))


def gather(packed: DataFrame, limit: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(chunks with the entries that aren't broadcast, names and predictions of those that are): exact counts of every context, in a table that grows with the corpus."""
    uses = packed.mapInArrow(_shared, "chunk long, code long, byte short, e long, " + ", ".join(f"{c} long" for c in _COUNTS[:PARTS]))
    sums = uses.groupBy("code", "byte", "e").agg(F.count("*").alias("c"), *[F.sum(c).alias(c) for c in _COUNTS[:PARTS]])
    table = materialise(sums.repartition("code").sortWithinPartitions("code", "byte").mapInArrow(_paths, "e long, c long, x binary"))
    edge, heavy = heavy_rows(table, HEAVY_CONTEXTS if limit is None else limit)
    names = heavy.column("e").to_numpy().view(U)
    order = np.argsort(names)
    x = np.frombuffer(b"".join(heavy.column("x").to_pylist()), np.float16).reshape(-1, PARTS + 1, WIDTH)[order]
    light = uses.select("chunk", "e").join(table.where(F.col("c") < edge).select("e", "x"), "e")
    # a chunk's entries are bounded by its bytes
    by_chunk = light.groupBy("chunk").applyInArrow(_join_entries, "chunk long, light binary, light_x binary")
    return materialise(packed.join(by_chunk, "chunk", "left")), names[order], x


def _join_entries(t: pa.Table) -> pa.Table:
    e = t.column("e").to_numpy().view(U)
    order = np.argsort(e)
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float16).reshape(len(e), -1)[order]
    return pa.table({"chunk": t.column("chunk").slice(0, 1), "light": pa.array([e[order].tobytes()], pa.binary()), "light_x": pa.array([x.tobytes()], pa.binary())})


# --------------------------------------------------------------------------- the model


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


class Mixer:
    """Gated weights and the final adaptive map."""

    def __init__(self):
        self.weights = np.full((GATES, CONTEXTS), 1.0 / CONTEXTS * 1.5)
        self.grid = np.linspace(-8, 8, APM_BUCKETS)
        self.map = np.tile(squash(self.grid), (256, 1))

    def mix(self, x: np.ndarray, j: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(clipped sum, mixed probability of a one) of bit j for inputs (CONTEXTS, n); edges are the runs of a gate."""
        dot = np.concatenate([self.weights[j * 8 + g] @ x[:, edges[g] : edges[g + 1]] for g in range(8)])
        dot = np.clip(dot, -7.99, 7.99)
        return dot, squash(dot)

    def refine(self, dot: np.ndarray, mixed: np.ndarray, node: np.ndarray) -> np.ndarray:
        spot = (dot + 8) * ((APM_BUCKETS - 1) / 16)
        low = spot.astype(np.int64)
        up = spot - low
        refined = self.map[node, low] * (1 - up) + self.map[node, low + 1] * up
        return np.clip(0.5 * mixed + 0.5 * refined, 1e-5, 1 - 1e-5)

    def gradient(self, x: np.ndarray, edges: np.ndarray, byte: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(GATES, CONTEXTS * (CONTEXTS + 1)): gradient and curvature of the coding cost, summed over weighted bytes sorted by gate; x (CONTEXTS, 8, n)."""
        out = np.zeros((GATES, CONTEXTS * (CONTEXTS + 1)))
        for j in range(8):
            near = x[:, j].astype(np.float64)
            _, mixed = self.mix(near, j, edges)
            error, curve = weight * (((byte >> (7 - j)) & 1) - mixed), weight * mixed * (1 - mixed)
            bent = near * curve
            for g in range(8):
                of = slice(edges[g], edges[g + 1])
                out[j * 8 + g, :CONTEXTS] = near[:, of] @ error[of]
                out[j * 8 + g, CONTEXTS:] = (bent[:, of] @ near[:, of].T).ravel()
        return out

    def step(self, sums: np.ndarray) -> None:
        """A damped Newton step for each gate."""
        for g in np.flatnonzero(sums.any(axis=1)) if len(sums) else ():
            curve = sums[g, CONTEXTS:].reshape(CONTEXTS, CONTEXTS)
            step = np.linalg.solve(curve + (1 + 1e-4 * np.trace(curve)) * np.eye(CONTEXTS), sums[g, :CONTEXTS])
            self.weights[g] += step / max(1.0, float(np.linalg.norm(step)))

    def seen(self, x: np.ndarray, edges: np.ndarray, byte: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(256 * APM_BUCKETS, 2): ones and all bits that fell to each spot of the map."""
        out = np.zeros((256 * APM_BUCKETS, 2))
        for j in range(8):
            dot, _ = self.mix(x[:, j], j, edges)
            at = nodes(byte, j) * APM_BUCKETS + np.rint((dot + 8) * ((APM_BUCKETS - 1) / 16)).astype(np.int64)
            out[:, 0] += np.bincount(at, weight * ((byte >> (7 - j)) & 1), len(out))
            out[:, 1] += np.bincount(at, weight, len(out))
        return out

    def settle(self, sums: np.ndarray) -> None:
        """The map after all that was seen: each spot has moved from its start towards the mean of its bits."""
        ones, n = sums[:, 0].reshape(256, -1), sums[:, 1].reshape(256, -1)
        self.map += np.where(n > 0, (ones / np.maximum(n, 1) - self.map) * (1 - 0.98**n), 0)

    def log10(self, x: np.ndarray, edges: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte."""
        total = np.zeros(len(byte))
        for j in range(8):
            p = self.refine(*self.mix(x[:, j], j, edges), nodes(byte, j))
            total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, p, 1 - p))
        return total


def nodes(byte: np.ndarray, j: int) -> np.ndarray:
    """The node of the byte's tree that bit j is read at."""
    return (1 << j) | (byte.astype(np.int64) >> (8 - j))


def _sums(model: Mixer, entries, mapped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = None, None
        index = index_of(entries.value[0])
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row).locate(*entries.value, row, index)
                for b in range(PARTS):
                    # with two blocks, the counts of all others are those of the other one
                    x, order, edges, byte, at = c.scored_inputs(1 - b, b)
                    weight = np.concatenate([c.weight[at[0], b], c.heads.weight[at[1], b]])[order].astype(np.float64)
                    one = (model.seen if mapped else model.gradient)(x, edges, byte, weight)
                    total = one if total is None else total + one
                least = row["chunk"] if least is None else min(least, row["chunk"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([total.tobytes()], pa.binary())], names=["chunk", "sums"])

    return run


def train(packed: DataFrame, entries) -> Mixer:
    """Rounds over all training documents, each block predicted from the counts of the other; then the map, over all blocks."""
    model = Mixer()

    def summed(mapped: bool, width: int) -> np.ndarray:
        # a row for each task, added in the order of chunks
        rows = packed.mapInArrow(_sums(model, entries, mapped), "chunk long, sums binary").collect()
        total = np.zeros(0)
        for r in sorted(rows, key=lambda r: r["chunk"]):
            one = np.frombuffer(bytes(r["sums"]))
            total = one if not len(total) else total + one
        return total.reshape(-1, width)

    for _ in range(PASSES):
        model.step(summed(False, CONTEXTS * (CONTEXTS + 1)))
    found = summed(True, 2)
    if len(found):
        model.settle(found)
    return model


# --------------------------------------------------------------------------- scoring


def _score_keys(model: Mixer, entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(entries.value[0])
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row).locate(*entries.value, row, index)
                x, order, edges, byte, at = c.scored_inputs(PARTS)
                log, own = np.empty(len(order)), np.zeros(len(c.byte))
                log[order] = model.log10(x, edges, byte)
                own[at[0]] = log[: len(at[0])]
                known = np.bincount(c.type, c.counts[:, :PARTS].sum(axis=1))[c.type]
                keys, counts = np.concatenate([c.keys, signed(head_keys(c.heads.heads))]), np.concatenate([c.counts, c.heads.counts]).sum(axis=1)
                known = np.concatenate([known, np.zeros(len(c.heads.heads))]).astype(np.int64)  # a token is known by its key
                value = np.concatenate([np.bincount(c.token, own[c.unit], len(c.keys)), c.heads.log(log[len(at[0]) :])])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(known), pa.array(value)], names=["key", "c", "known", "score"])

    return run


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, heavy_known long, heavy_log double, n_bytes long, heavy_score double, light array<long>"


def _score(heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, score = heavy.value
        index = index_of(key)
        for batch in batches:
            for lo, hi, data, offs in chunks(binary_column(batch, "text"), TEXT_BYTES):
                n = hi - lo
                t = Tokens(data, offs)
                sums, rest, of_rest = np.zeros((3, n)), [], []
                # a token's score is its key's and its head's
                for ask in (t.keys, lambda: head_keys(t.heads())):
                    keys = ask()
                    first, inverse = grouped(keys)
                    keys = keys[first]
                    at = look_up(key, keys, index)
                    hit = at >= 0
                    found = hit[inverse]
                    row, at = t.row[found], at[inverse[found]]
                    for total, x in zip(sums, (known[at] > 0, np.log10(known[at] + 1.0), score[at]), strict=True):
                        total += np.bincount(row, x, n)
                    rest.append(keys[inverse[~found]])
                    of_rest.append(t.row[~found])
                of_rest = np.concatenate(of_rest)
                rest = np.concatenate(rest)[np.argsort(of_rest, kind="stable")]
                light_offs = np.concatenate([[0], np.cumsum(np.bincount(of_rest, minlength=n))])
                size = np.bincount(t.row, np.where(t.lo < 0, 1, t.hi - t.lo + 1), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), pa.array(t.counts, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(size.astype(np.int64)), pa.array(sums[2]),
                        pa.ListArray.from_arrays(pa.array(light_offs, pa.int32()), pa.array(signed(rest))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "heavy_known", "heavy_log", "n_bytes", "heavy_score", "light"],
                )

    return run


def heavy_rows(table: DataFrame, limit: int) -> tuple[int, pa.Table]:
    """(least c, rows) of the rows of greatest c: as many that at most limit have one as great."""
    total, edge = 0, 1 << 62
    # distinct counts, greatest first: their number grows as the root of the corpus at most, and the loop ends within limit
    for r in table.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(limit).toLocalIterator():
        if total + r["n"] > limit:
            break
        total, edge = total + r["n"], r["c"]
    return edge, table.where(F.col("c") >= edge).toArrow()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row per document."""
    send = docs.sparkSession.sparkContext.broadcast
    # texts and chunks pass to Python a few MB at a time
    bounded_batches(docs.sparkSession, ROWS)
    packed = keys_of(docs)
    n, v = packed.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    packed, *entries = gather(packed)
    entries = send(tuple(entries))
    scores = materialise(packed.mapInArrow(_score_keys(train(packed, entries), entries), "key long, c long, known long, score double"))
    edge, heavy = heavy_rows(scores, HEAVY)
    keys = heavy.column("key").to_numpy().view(U)
    order = np.argsort(keys)
    heavy = send((keys[order], heavy.column("known").to_numpy()[order], heavy.column("score").to_numpy()[order]))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = materialise(rows.mapInArrow(_score(heavy), SCORE_SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    light = scored.select("row", F.explode("light").alias("key"))
    rare = scores.where(F.col("c") < edge)
    sums = light.join(rare, "key").groupBy("row").agg(F.count_if(F.col("known") > 0).alias("light_known"), F.sum(F.log10(F.col("known") + 1)).alias("light_log"), F.sum("score").alias("light_score"))
    total = F.col("heavy_score") + F.coalesce("light_score", F.lit(0.0))
    return scored.drop("light").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("heavy_known") + F.coalesce("light_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("heavy_log") + F.coalesce("light_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        total.alias("score"), (-total * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
