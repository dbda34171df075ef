"""Language identification by a blended-spectrum string kernel with Nystroem landmarks.

A text's features are the presence of its byte n-grams of the lengths in
ORDERS (A-Z lower-cased), hashed into 2**HASH_BITS places. The kernel of two
texts is the number of shared places over the root of the product of their
numbers of places. One-versus-rest kernel ridge regression is solved in the
span of LANDMARKS training texts. Since the kernel is a product of presence
vectors, landmarks and dual weights fold into one matrix of places by
languages, and texts are scored by products of batches of presence vectors
with it.

Defined cases: null text or text without a letter gives ``und`` and score 0;
a null doc_id counts as the empty string in the fold; rows of null lang are
predicted, not learned from; without any learnable row all is ``und``;
repeated rows are predicted alike and learned from once; other columns are
ignored. Every lang value outside the held-out fold is learned; the model has a
column of 128 KB for each, so their number must suit the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, documents, lower, raw

ORDERS = (1, 2, 3)
HASH_BITS = 15
#: Training texts that are learned from: about MAX_TRAIN, the same number of each language, but MIN_EACH of each at least (all, if there are fewer).
MAX_TRAIN, MIN_EACH = 3000, 10
#: Training texts that are landmarks; never fewer than languages.
LANDMARKS = 400
RIDGE = 1e-3
FOLDS, HELD_OUT = 3, 1
#: Texts whose presence vectors stand in memory at once (128 KB each), when scoring and when fitting.
BATCH, FIT_BATCH = 64, 256
UNKNOWN = "und"

_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def places(text: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed places of the n-grams of a text's bytes, by order."""
    data = lower(text).astype(np.uint32)
    size = len(data)
    gram = np.zeros(size, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if size < n:
            return
        gram = (gram[: size - n + 1] << np.uint32(8)) | data[n - 1 :]
        if n in ORDERS:
            yield ((gram + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)


def presence(col: pa.Array, lo: int, hi: int, out: np.ndarray) -> None:
    """Set out[i] to the presence vector of row lo + i."""
    out[: hi - lo] = 0
    data, offs = raw(col.slice(lo, hi - lo))
    for i in range(hi - lo):
        for at in places(data[offs[i] : offs[i + 1]]):
            out[i][at] = 1


def has_letter(data: np.ndarray) -> bool:
    if _LETTER[data].any():
        return True
    return len(data) > 0 and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros((BATCH, 1 << HASH_BITS), np.uint8)
    for batch in batches:
        col = binary_column(batch, "text")
        for lo in range(0, len(col), BATCH):
            hi = min(len(col), lo + BATCH)
            presence(col, lo, hi, out)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([x.tobytes() for x in np.packbits(out[: hi - lo], axis=1)], pa.binary())], names=["lang", "bits"])


def training_rows(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and presence vectors (eight places a byte) of a sample of the rows outside the held-out fold, chosen by a hash of key and text: an equal share of each language, and always its row of smallest hash."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    counts = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(spot).alias("least")).collect()}
    if not counts:
        return [], np.zeros((0, 1 << HASH_BITS - 3), np.uint8)
    each = max(MIN_EACH, MAX_TRAIN // len(counts))
    edges = docs.sparkSession.createDataFrame([(k, max(int(min(1.0, each / n) * (1 << 30)), least + 1)) for k, (n, least) in counts.items()], "lang string, edge long")
    chosen = rows.join(F.broadcast(edges), "lang").where(spot < F.col("edge"))
    # equal rows have equal hashes and come together: one of them is enough
    packed = chosen.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_packed, "lang string, bits binary").distinct()
    got = sorted((bytes(r["bits"]), r["lang"]) for r in packed.collect())
    # in an order of no meaning
    got = [got[i] for i in np.random.default_rng(len(got)).permutation(len(got))]
    return [lang for _, lang in got], np.frombuffer(b"".join(bits for bits, _ in got), np.uint8).reshape(len(got), -1)


def unit_vectors(packed: np.ndarray) -> np.ndarray:
    """Presence vectors divided by their norms."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)


def fit(langs: list[str], packed: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of places by languages): scores of a text are its presence vector times the matrix over its root norm. Vectors are unpacked FIT_BATCH at a time."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((1 << HASH_BITS, 0), np.float32)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # landmarks: every language in turn
    turn, seen = [], dict.fromkeys(names, 0)
    for lang in langs:
        turn.append(seen[lang])
        seen[lang] += 1
    order = np.argsort(turn, kind="stable")[: max(LANDMARKS, len(names))]
    marks = unit_vectors(packed[order])
    k_nm = np.concatenate([unit_vectors(packed[i : i + FIT_BATCH]) @ marks.T for i in range(0, len(packed), FIT_BATCH)]).astype(np.float64)
    a = k_nm.T @ k_nm + RIDGE * len(langs) * k_nm[order] + 1e-6 * len(langs) * np.eye(len(order))
    dual = np.linalg.solve(a, k_nm.T @ y)
    return names, (marks.T @ dual.astype(np.float32)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: half of the best margin plus one) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(matrix)  # 2**HASH_BITS rows of 4 bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        flags = np.zeros((BATCH, 1 << HASH_BITS), np.uint8)
        for batch in batches:
            col = binary_column(batch, "text")
            langs, scores = [], []
            for lo in range(0, len(col), BATCH):
                hi = min(len(col), lo + BATCH)
                presence(col, lo, hi, flags)
                x = flags[: hi - lo].astype(np.float32)
                margin = (x @ w) / np.maximum(np.sqrt(x.sum(axis=1)), 1)[:, None]
                data, offs = raw(col.slice(lo, hi - lo))
                for i in range(hi - lo):
                    if names and has_letter(data[offs[i] : offs[i + 1]]):
                        best = int(np.argmax(margin[i]))
                        langs.append(names[best])
                        scores.append(float(np.clip((margin[i][best] + 1) / 2, 0, 1)))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, *fit(*training_rows(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
