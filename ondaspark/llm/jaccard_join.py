"""Exact n-gram Jaccard join by PartEnum signatures, grouped into classes of linked documents.

A document's set holds the 64-bit hashes of its distinct word shingles. Two
sets with Jaccard similarity of at least t differ in at most
k = (1 - t) / (1 + t) * (sum of their sizes) features. Sizes are cut into
bands so that similar sets stand in the same or in neighbouring bands; a set
gives signatures for its own band and the next. In a band, the feature domain
is cut into n1 partitions and each of these into n2; k2 is chosen so that of
n1 partitions one at least holds no more than k2 of the k differences. There,
n2 - k2 of the n2 parts are equal in both sets, so the enumerated subsets of
that many parts, a signature each, must meet. ``layout`` takes the n1, n2 and
k2 whose subsets hold the most features, so that the fewest unlike sets meet,
within SIGNATURES for each feature. Agreement on a subset that is empty in both
sets says nothing, so bands have ``slack`` partitions more and only the few
sets with more partitions of empty subsets than that also give signatures for
those.

Sets that are equal are one entity throughout (its fingerprint), so copies
cost a row each. In a signature group every member is first compared with the
group's smallest member only; members that this leaves in another class are
then compared with further members, 1, then 64, then 4,096 at a time and those
of most links first, until no two members of
different classes are untested. So classes are exact and no group emits all
its pairs. Candidates first meet in a parity bitmap, where each feature flips
one of 512 bits: two bitmaps differ in at most as many bits as the sets in
features, so pairs whose bitmaps differ in more than the sizes allow can't be
similar, and the join that proposes pairs leaves them out. The rest meets in a
larger bitmap of a bit or two for each feature, which leaves out nearly all
pairs that aren't similar at a 64th of the bytes of the sets; what remains is
verified on the whole sets.

Defined cases: a null or empty text has no shingle and is linked with nothing
(n_shingles 0, component_id its doc_id); fewer words than a shingle's give one
shingle; a null doc_id keeps its row, and is never a component_id unless the
class has no other; repeated doc_ids stay repeated rows; ties of equal
doc_ids are one class member; other columns are ignored. Two different sets
would be taken for one if their 64-bit fingerprints met (expected in 1e9
documents: 0.03 pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, begin, binary_column, bloom_filter, bounded_batches, chunks, delete_paths, documents, in_bloom, lower, materialise, mix, signed, window_hashes, word_hashes
from .components import stars

WORDS = 4
#: Similarity of a link, in percent.
PERCENT = 85
#: Signatures for each feature of the smallest sets of a band, at most; bands of short sets, for which this is too few, take the fewest.
SIGNATURES = 0.42
#: Share of a band's smallest sets, at most, that need signatures for empty subsets.
MAX_THIN = 0.01
#: Most signatures from one partition of the first level.
MAX_SUBSETS = 500
#: After the leader, one member of a signature group is compared with the rest; each further round takes so many times more.
LEADERS = 64
#: 64-bit words of an entity's small parity bitmap; a power of two.
BITMAP_WORDS = 8
#: Partitions of the signatures for each shuffle partition of the session: they are most of what is shuffled, and a task sorts its own in memory.
SIGNATURE_PARTS = 3
#: Fingerprints that a worker remembers, so as not to repeat the signatures of copies.
SEEN = 200_000

_C1, _C2, _EMPTY = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x1D8E4E27C47D124F)


# --------------------------------------------------------------------------- sets and signatures


def shingle_sets(col: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, data, offs in chunks(col):
        h, _, _, first = word_hashes(lower(data), offs)
        all_ = window_hashes(h, words)
        for r in range(len(offs) - 1):
            a, b = first[r], first[r + 1]
            if b - a >= words:
                yield np.unique(all_[a : b - words + 1])
            elif b > a:
                yield mix(window_hashes(h[a:b], int(b - a)) + U(b - a))
            else:
                yield np.zeros(0, U)


def fingerprint(s: np.ndarray) -> int:
    return int(signed(mix(np.array([s.sum(dtype=U) + U(len(s)) * _C1], U)) ^ mix(np.array([np.bitwise_xor.reduce(mix(s))], U)))[0]) if len(s) else 0


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bytes of parities: bit i tells whether an odd number of features is dealt to i. A power of two bits, as many as features or more."""
    bits = max(64 * BITMAP_WORDS, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount(((s * _C2) >> U(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1)


def folded(m: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of size bytes of the same features."""
    return m if len(m) == size else np.bitwise_xor.reduce(m.reshape(-1, size))


@lru_cache(maxsize=100_000)
def band(size: int, percent: int) -> int:
    """The band of a size: [L, L * 100 / percent], starting at 1."""
    low, i = 1, 0
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return i
        low, i = high + 1, i + 1


@lru_cache(maxsize=100_000)
def band_top(i: int, percent: int) -> int:
    low = 1
    for _ in range(i):
        low = max(low, low * 100 // percent) + 1
    return max(low, low * 100 // percent)


def _more_than(n: int, p: float, least: int) -> float:
    """The probability of more than least of n events of probability p."""
    if p >= 1:
        return float(n > least)
    return max(0.0, 1 - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least + 1)))


@lru_cache(maxsize=100_000)
def layout(i: int, percent: int) -> tuple[int, int, int, int, int]:
    """(k, n1, n2, k2, slack) of band i: those of fewest signatures. Beyond a distance of 64 the shares are those of 64."""
    top = band_top(i, percent)
    k = 2 * top * (100 - percent) // (100 + percent)
    if k == 0:
        return 0, 0, 0, 0, 0
    if k > 64:
        _, n1, n2, k2, slack = layout(_band_of_distance(64, percent), percent)
        spare = ceil(slack * (k + 1) / 65)
        return k, k // (k2 + 1) + 1 + spare, n2, k2, spare
    least = top * percent * percent / 10_000  # features of the smallest set that signs here
    found = []
    for k2, chosen in product(range(k + 1), range(1, 5)):
        n2, slacks = k2 + chosen, range(1 if k2 == k else k // (k2 + 1) + 2)
        if comb(n2, chosen) > MAX_SUBSETS:
            continue
        for slack in slacks:
            n1 = k // (k2 + 1) + 1 + slack
            features = least * chosen / n2 / n1
            if _more_than(n1, comb(n2, chosen) * exp(-features), slack) <= MAX_THIN:
                found.append((n1 * comb(n2, chosen), features, (k, n1, n2, k2, slack)))
                break
    few = [x for x in found if x[0] <= SIGNATURES * least]
    if few:
        return max(few, key=lambda x: x[1])[2]
    return min(found)[2] if found else (k, 1, k + 3, k, 0)


@lru_cache(maxsize=64)
def _band_of_distance(k: int, percent: int) -> int:
    """The last band whose distance is at most k."""
    i = 0
    while 2 * band_top(i + 1, percent) * (100 - percent) // (100 + percent) <= k:
        i += 1
    return i


@lru_cache(maxsize=64)
def subsets(n2: int, k2: int) -> np.ndarray:
    """Which of n2 parts each subset holds, as rows of zeros and ones."""
    chosen = list(combinations(range(n2), n2 - k2))
    out = np.zeros((len(chosen), n2), U)
    for row, c in zip(out, chosen, strict=True):
        row[list(c)] = 1
    return out


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """64-bit signatures of a sorted set. Similar, unequal sets share one at least."""
    out = []
    own = band(len(s), percent)
    mixed = mix(s * _C1)
    for i in (own, own + 1):
        k, n1, n2, k2, slack = layout(i, percent)
        if k == 0:
            continue  # within distance 0 sets are equal, and equal sets are one entity
        part = ((s >> U(32)) * U(n1 * n2) >> U(32)).astype(np.int64)  # monotone in s, so parts are runs
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, some = np.zeros(n1 * n2, U), np.zeros(n1 * n2, U)
        sums[part[head]], some[part[head]] = np.add.reduceat(mixed, head), 1
        chosen = subsets(n2, k2).T
        filled = (some.reshape(n1, n2) @ chosen) > 0
        place = np.arange(filled.size).reshape(filled.shape).astype(U)
        whole = mix((sums.reshape(n1, n2) @ chosen) + (place + U(1)) * _C1 + U(i) * _C2)
        out.append(whole[filled])
        if (~filled.all(axis=1)).sum() > slack:
            out.append(mix((place[~filled] + U(1)) * _C1 + U(i) * _C2 + _EMPTY))
    return np.concatenate(out) if out else np.zeros(0, U)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        for batch in batches:
            sizes, prints = [], []
            for s in shingle_sets(binary_column(batch, "text"), words):
                sizes.append(len(s))
                prints.append(fingerprint(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())], names=["doc_id", "n_shingles", "fp"])

    return run


def _sign(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        seen: set[int] = set()
        for batch in batches:
            sigs, prints, sizes, n = [], [], [], 0
            for s in shingle_sets(binary_column(batch, "text"), words):
                fp = fingerprint(s)
                if not len(s) or fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                found = signatures(s, percent)
                sigs.append(found)
                prints.append(np.full(len(found), fp, np.int64))
                n += len(found)
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(prints))], names=["sig", "fp"])
                    sigs, prints, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(prints))], names=["sig", "fp"])

    return run


# --------------------------------------------------------------------------- verification


def _no_id():
    return F.lit(-(1 << 63)).cast("long")


def _of_entities(texts: DataFrame, wanted: DataFrame, words: int, describe, schema: str) -> DataFrame:
    """fp and rep, then what describe gives of the set, in schema, of each entity in wanted(fp, rep).

    Texts are cut into shingles only if a filter of fixed size may hold their
    doc_id; an exact join removes the rest before anything else is done.
    """
    bloom = texts.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select(F.xxhash64("rep").alias("k")), "k"))
    names = ["rep", "fp", *(c.split(" ")[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(batch.column("k").to_numpy(), bloom.value)))
            ids, rows, size = batch.column("rep").to_pylist(), [], 0
            for rep, s in zip(ids, shingle_sets(binary_column(batch, "text"), words), strict=True):
                if len(s):
                    rows.append((rep, fingerprint(s), *describe(s)))
                    size += s.nbytes
                    if size > 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int64()) for x in zip(*rows, strict=True)], names=names)

    rep = F.coalesce("doc_id", _no_id())
    found = texts.select(rep.alias("rep"), F.xxhash64(rep).alias("k"), "text").mapInArrow(run, f"rep long, fp long, {schema}")
    # rows that repeat doc_id and text give the same
    return found.join(wanted, ["fp", "rep"], "left_semi").groupBy("fp").agg(*[F.any_value(c).alias(c) for c in ("rep", *names[2:])])


def _maps(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, rep, n, map, w0, w1 ...): number of features, bitmap and small bitmap."""

    def describe(s: np.ndarray) -> tuple:
        m = bitmap(s)
        return len(s), m.tobytes(), *folded(m, 8 * BITMAP_WORDS).view(np.int64).tolist()

    return _of_entities(texts, wanted, words, describe, "n long, map binary, " + ", ".join(f"{w} long" for w in _BITMAP))


def _entities(pairs: DataFrame) -> DataFrame:
    """(fp, rep) of the entities in pairs(a, b, rep_a, rep_b)."""
    return pairs.select(F.explode(F.array(*[F.struct(F.col(s).alias("fp"), F.col(f"rep_{s}").alias("rep")) for s in "ab"])).alias("e")).select("e.*").distinct()


_BITMAP = [f"w{i}" for i in range(BITMAP_WORDS)]


def _side(rows: DataFrame, side: str, *others) -> DataFrame:
    """fp as side, rep, the size and the bitmap marked by it, and others."""
    return rows.select(F.col("fp").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", *_BITMAP)], *others)


def _may_be_similar(percent: int):
    """Whether sizes and bitmaps of sides a and b allow that sets are similar; true of all that are."""
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _BITMAP), F.lit(0))
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return size & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def similar(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def may_be_similar(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """Whether bitmaps allow that sets of n features together are similar; true of all that are."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return (100 + percent) * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= (100 - percent) * n


_PAIR = ["a", "b", "rep_a", "rep_b"]


def _check(test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        for batch in batches:
            ok = [test(x.as_py(), y.as_py(), n) for x, y, n in zip(batch.column("x_a"), batch.column("x_b"), batch.column("n").to_pylist(), strict=True)]
            yield batch.select(_PAIR).filter(pa.array(ok, pa.bool_()))

    return run


def _checked(pairs: DataFrame, sides: DataFrame, column: str, n, test) -> DataFrame:
    """The pairs (a, b, rep_a, rep_b) for which test holds of the column in sides(fp, column) and n."""
    one = lambda side: sides.select(F.col("fp").alias(side), F.col(column).alias(f"x_{side}"), n.alias(f"n_{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select(*_PAIR, "x_a", "x_b", (F.col("n_a") + F.col("n_b")).alias("n"))
    return both.mapInArrow(_check(test), ", ".join(f"{c} long" for c in _PAIR))


def _verify(pairs: DataFrame, texts: DataFrame, maps: DataFrame, words: int, percent: int, scratch: list[str]) -> DataFrame:
    """Of distinct pairs (a, b, rep_a, rep_b), those of entities whose sets are similar: bitmaps leave out nearly all others, so few sets are made."""
    close = materialise(_checked(pairs, maps, "map", F.col("n"), lambda x, y, n: may_be_similar(x, y, n, percent)), scratch)
    if close.isEmpty():
        return close
    wanted = materialise(_entities(close), scratch)
    sets = materialise(_of_entities(texts, wanted, words, lambda s: (s.tobytes(),), "set binary"), scratch)
    return materialise(_checked(close, sets, "set", F.lit(0), lambda x, y, _: similar(x, y, percent)), scratch)


# --------------------------------------------------------------------------- the join


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, labels): members has doc_id, n_shingles and fp (the entity) of every row; links has pairs (a, b) of entities that are similar; labels names the component b, its smallest entity, of every other linked entity a.

    The pairs connect every class of similar documents, so their components
    are those of all links; they are not all links. The folders that links
    and labels rest on are added to scratch, for the caller to delete.
    """
    bounded_batches(docs.sparkSession)
    scratch = [] if scratch is None else scratch
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    members = materialise(texts.mapInArrow(_describe(words), "doc_id long, n_shingles long, fp long"))
    reps = members.where("n_shingles > 0").groupBy("fp").agg(F.coalesce(F.min("doc_id"), _no_id()).alias("rep"))

    by_sig = Window.partitionBy("sig").orderBy("fp").rowsBetween(Window.unboundedPreceding, 0)
    signed_ = texts.select("text").mapInArrow(_sign(words, percent), "sig long, fp long")
    signed_ = signed_.repartition(SIGNATURE_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig")
    groups = materialise(signed_.withColumn("leader", F.first("fp").over(by_sig)).where("leader <> fp").distinct(), scratch)

    pairs = materialise(groups.select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), scratch)
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(reps, "fp"), scratch)
    maps = materialise(_maps(texts, wanted, words), scratch)
    sized = maps.select("fp", "rep", "n", *_BITMAP)
    near = pairs.join(_side(sized, "a"), "a").join(_side(sized, "b"), "b").where(_may_be_similar(percent)).select(*_PAIR)
    found = _verify(near, texts, maps, words, percent, scratch)
    # members of groups that the leader leaves in several classes
    label = stars(found, scratch)
    named = lambda df, c, as_: df.join(label.select(F.col("a").alias(c), F.col("b").alias(as_)), c, "left").withColumn(as_, F.coalesce(as_, c))
    open_sigs = named(named(groups, "leader", "leader_class"), "fp", "class").where("class <> leader_class").select("sig").distinct()
    open_rows = groups.join(open_sigs, "sig", "left_semi")
    # the entities of most links lead first: the original of many copies joins most of them to one class at once
    degree = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("degree"))
    all_rows = open_rows.select("sig", "fp", "leader").union(open_rows.select("sig", F.col("leader").alias("fp"), "leader")).distinct()
    order = Window.partitionBy("sig").orderBy(F.desc("degree"), "fp")
    ranked = materialise(all_rows.join(sized, "fp").join(degree, "fp", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("rank", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy("sig"))).drop("degree"), scratch)
    first, leaders = 1, 1
    while not ranked.where(F.col("rank") > first).isEmpty():
        rows = named(ranked.where(F.col("size") > first), "fp", "class")  # groups that end before have been compared
        x = _side(rows.where(F.col("rank").between(first, first + leaders - 1)), "a", "sig", F.col("class").alias("class_a"), F.col("rank").alias("rank_a"))
        y = _side(rows.where(F.col("rank") > first), "b", "sig", "leader", F.col("class").alias("class_b"), "rank")
        more = x.join(y, "sig").where((F.col("rank") > F.col("rank_a")) & (F.col("class_a") != F.col("class_b")) & _may_be_similar(percent))
        more = more.where((F.col("a") != F.col("leader")) & (F.col("b") != F.col("leader")))  # compared already
        ends = [F.struct(F.col(s).alias("fp"), F.col(f"rep_{s}").alias("rep")) for s in "ab"]
        ordered = more.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct().select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))
        new = _verify(ordered, texts, maps, words, percent, scratch)
        if not new.isEmpty():
            # pairs of different classes, so none was found before
            found = found.union(new)
            label = stars(label.union(new.select("a", "b")), scratch)
        # the fewer groups reach a rank, the more of their members lead at once
        first, leaders = first + leaders, leaders * LEADERS
    return members, found.select("a", "b"), label


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    scratch: list[str] = []
    members, _, label = links(docs, words, percent, scratch)
    label = label.toDF("fp", "class")
    # entities of no link are classes of their own; first the copies, then the classes, meet in counts that are combined before the shuffle
    entity = members.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialise(entity.join(label, "fp", "left").select("fp", "least", F.coalesce("class", "fp").alias("class")))
    delete_paths(docs.sparkSession, scratch)
    class_least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    of_entity = named.join(class_least, "class").select("fp", "component_id")
    return members.join(of_entity, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one document of each class: that of the smallest doc_id (null ids last; of equal ids, one text). Of rows that repeat doc_id and text one stays, too."""
    name = "key"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    # different texts of one doc_id are different members
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    found = materialise(classes(keyed.select(F.col(name).alias("doc_id"), "text"), words, percent))
    ids = keyed.select(name, F.col("doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", name))[name]
    stay = found.select(F.col("doc_id").alias(name), "component_id").join(ids, name).groupBy("component_id").agg(first.alias(name)).select(name)
    kept = keyed.join(stay, name, "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([name, "text"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words),
rows_ AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS e FROM shingled),
entity AS MATERIALIZED (SELECT e, any_value(n) AS n, min(doc_id) AS least FROM rows_ WHERE n > 0 GROUP BY e),
feature AS MATERIALIZED (SELECT least, any_value(n) AS n, f FROM (SELECT least, entity.n, unnest(s) AS f FROM shingled JOIN entity ON doc_id = least) GROUP BY least, f),
links AS MATERIALIZED (
  SELECT a.least AS a, b.least AS b FROM feature a JOIN feature b ON a.f = b.f AND a.least < b.least AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.least, b.least HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT least, least FROM entity UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
class AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, rows_.n AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM rows_ LEFT JOIN entity ON rows_.e = entity.e AND rows_.n > 0 LEFT JOIN class ON class.a = entity.least
"""
