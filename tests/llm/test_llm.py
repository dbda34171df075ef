"""Each operator against a brute-force version on small, awkward inputs."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ondaspark.llm import byte_bpe, common, decontaminate, jaccard_join, kd_sharding, language_id, language_model, pii, quality_rules, suffix_dedup, token_files

WORDS = ["alpha", "Beta", "gamma", "delta", "ünder", "x1", "the", "of", "日本", "z"]


def table(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i % 2}", 0, "own") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([r[: 6 if extra else 5] for r in rows], schema + (", shard string" if extra else ""))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = [None, "", "   \n\t ", "one", "a b c", "a b c", "<|endoftext|> it's  5\n\n x"]
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(60)) for _ in range(6)]
    for i in range(60):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = f"new{i}"
        out.append(r.choice([" ", "\n"]).join(w) + r.choice(["", " tail", "a" * 150]))
    return out


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_and_token_files(spark, texts, tmp_path):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    docs = table(spark, texts)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.vocabulary_path()), special_tokens={})
    got = rows(byte_bpe.digests(docs))
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    tok = Tokenizer.from_file(token_files.tokenizer_path())
    assert 50256 in tok.encode(texts[6], add_special_tokens=False).ids
    out = f"file://{tmp_path}/tokens"
    token_files.write(docs, out, block_ids=500)
    got, start = rows(token_files.read(spark, out)), 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i]["start"] == start and bytes(got[i]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        start += len(ids)
    assert set(rows(token_files.lookup(spark, out, [3, 40, 999, None]))) == {3, 40}
    opened, all_ = (df.select("shard", "block").distinct().count() for df in (token_files.blocks_of(spark, out, [40]), spark.read.parquet(f"{out}/blocks")))
    assert opened == 1 < all_ and rows(token_files.lookup(spark, out, [40]))[40] == got[40]


def test_perfect_hash_is_minimal():
    keys = np.arange(5000)
    h = token_files.key_hashes(keys, np.zeros(5000, bool))
    bits, sizes, slot = token_files.build(h)
    packed, ranks = token_files.Levels.pack(bits)
    assert sorted(slot) == list(range(5000)) and (token_files.Levels(packed, sizes, ranks).slots(h) == slot).all()


@given(st.lists(st.text(st.sampled_from("ab1 9'.,s\n\t\u00a0\u00e9\u00df\u65e5\u0301\u00b2<|>endoftx"), max_size=30), max_size=6))
@settings(max_examples=80, deadline=None)
def test_pieces_encode_as_the_library_does(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    texts = [*texts, "a <|endoftext|> b", "it's don'T 'tis x.\nY  z "]
    encode, _ = token_files.encoder(token_files.tokenizer_path())
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_quality_counts(spark, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 50)], "doc_id long, quality int")
    got = rows(quality_rules.judge(table(spark, texts), labels))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        rep = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert tuple(got[i][1:6]) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    kept = quality_rules.keep(table(spark, texts), labels)
    assert kept.columns == table(spark, texts).columns


def test_decision_list_separates():
    r = np.random.default_rng(1)
    counts = {k: r.integers(50, 100, 900) for k in quality_rules.COUNTS}
    bad = r.random(900) < 0.3
    counts["n_symbols"] = np.where(bad, 90, 1)
    rules = quality_rules.learn(counts, bad, np.arange(900))
    assert rules and (quality_rules._covered(rules[0], quality_rules.ratios(counts), 900) == bad).all()


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_classes(spark, texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent = [min(parent[i], parent[j]) if p in (parent[i], parent[j]) else p for p in parent]
    got = rows(jaccard_join.classes(table(spark, texts), words, percent))
    assert [got[i]["n_shingles"] for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(sets))] == parent


def test_signatures_never_miss():
    r = np.random.default_rng(2)
    for percent in (80, 85):
        for size in (*range(5, 60), 80, 200, 900, 5000):
            for _ in range(12):
                a = np.unique(r.integers(0, 1 << 64, size, dtype=np.uint64))
                gone, more = r.multinomial(int(len(a) * (100 - percent) / percent), [0.5, 0.5])
                b = np.unique(np.concatenate([a[r.permutation(len(a))[gone:]], r.integers(0, 1 << 64, more, dtype=np.uint64)]))
                if gone + more and jaccard_join.similar(a.tobytes(), b.tobytes(), percent):
                    assert np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)).size
                    assert jaccard_join.may_be_similar(jaccard_join.bitmap(a).tobytes(), jaccard_join.bitmap(b).tobytes(), len(a) + len(b), percent)


@pytest.mark.parametrize("percent", [80, 85, 60])
def test_layouts_leave_an_equal_subset(percent):
    for i in range(1, 40):
        k, n1, n2, k2, slack = jaccard_join.layout(i, percent)
        # with k differences over n1 partitions, more than slack partitions hold k2 at most, and n2 - k2 parts there are equal
        assert k == 0 or (n1 - slack) * (k2 + 1) > k and n2 > k2


def brute_repeats(docs):
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        out[d] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_suffix_dedup(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_SPANS", limit)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    docs = [*texts, "ab" * 400, "ab" * 300 + "c", "é" * 200]
    got = rows(suffix_dedup.remove(table(spark, docs)))
    for d, kept in brute_repeats(enumerate(docs)).items():
        assert bytes(got[d]["kept"]) == kept, d


def test_transform_orders_suffixes():
    strings = [b"banana", b"", b"anana", b"\x00b", b"nab"]
    string, length = suffix_dedup.transform(strings)
    got = [strings[s][len(strings[s]) - n :] for s, n in zip(string, length, strict=True)]
    assert got == sorted(x[i:] for x in strings for i in range(len(x)))


def test_decontamination(spark, texts):
    w = texts[10].split()
    items = spark.createDataFrame([(1, " ".join(w[5:25])), (2, "a, b. C"), (3, None), (4, "!!"), (10, " ".join(w[8:21]))], "item_id long, text string")
    docs = table(spark, texts)
    want = rows(decontaminate.scan(docs, items, with_spans=True))
    split = rows(decontaminate.scan(docs, items, with_spans=True, block_words=10))
    assert want[4]["n_hit"] == 3 and want[4]["items"] == ["2"] and want[10]["items"][:2] == ["1", "10"] and want[0]["n_words"] == 0
    assert {k: tuple(v)[:4] for k, v in want.items()} == {k: tuple(v)[:4] for k, v in split.items()}
    kept = {r["doc_id"] for r in decontaminate.remove(docs, items).collect()}
    assert kept == {k for k, v in want.items() if not (v["n_hit"] and 20 * v["n_hit"] >= v["n_words"])}
    assert rows(decontaminate.remove(docs, items, "spans"))[4]["text"] == ""
    assert set(rows(decontaminate.remove(docs, items, "any"))) == {k for k, v in want.items() if not v["n_hit"]}


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_removal_unites_blocks(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WORDS", limit)
    filler = [f"f{i}" for i in range(94)]
    docs = table(spark, [" ".join(["a b c", *filler, "d e f"]), " ".join(["a b c", *filler, "d e"]), "x a b c g y", None])
    items = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "b c g")], "item_id long, text string")
    assert set(rows(decontaminate.remove(docs, items))) == {1, 3}
    cut = decontaminate.remove(docs, items, "spans")
    assert cut.columns == docs.columns
    got = rows(cut)
    assert got[2]["text"] == "x  y" and got[0]["text"] == " " + " ".join(filler) + " " and got[3]["text"] is None


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base(spark):
    texts = [None, "", "a@b.c_d@e.f.", "x@y", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (2) 345-678-90 12", "4111 1111 1111 1111x4111111111111111", "😀 a.b@c-d.e +49 30 1234567 1", "0255.1.1.1", "++12345678901", "1" * 200, "a" * 5000 + "@", "1 " * 3000, "1.1.1.1 " * 50]
    docs = table(spark, texts)
    found, base, _ = pii.detect(docs)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r[base]] for r in found.collect()}
    for i, t in enumerate(texts):
        want = []
        for k, (kind, pattern) in enumerate(BASE.items()):
            for m in re.finditer(pattern, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                want += [(m.start(), k, m.end())] * ok
        assert sorted(got[i]) == sorted(want), t
    clean = rows(pii.redact(docs))
    assert clean[8]["text"] == "[IP]" and clean[0]["text"] is None and clean[3]["text"] == "x@y"


def test_sharding(spark, texts):
    got = kd_sharding.assign(table(spark, texts * 3), 4).collect()
    by_text = {}
    for r in got:
        by_text.setdefault((texts * 3)[r["doc_id"]] or "", set()).add(r["shard"])
        assert r["size"] == len(((texts * 3)[r["doc_id"]] or "").encode()) + 1
    assert all(len(s) == 1 for s in by_text.values())
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_language_id(spark):
    r = random.Random(3)
    make = {"aa": "bado gelu", "bb": "kixz wyqu"}
    rows_ = [(i, None if i % 50 == 7 else " ".join("".join(r.choice(make[k].replace(" ", "")) for _ in range(5)) for _ in range(12)), k) for i in range(240) for k in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame([*rows_, (900, "123 !!", None), (901, "", "aa"), (None, "bado", None)], "doc_id long, text string, lang string")
    got = rows(language_id.predict(docs, *language_id.fit(*language_id.training_rows(docs))))
    assert all(got[i]["lang_pred"] == ("und" if t is None else k) for i, t, k in rows_)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and 0 <= got[3]["score"] <= 1


def test_kernel_ridge_and_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANDMARKS", 7)
    monkeypatch.setattr(language_id, "FIT_BATCH", 4)
    r = random.Random(4)
    rare = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(i, "".join(r.choice(a) for _ in range(30)), k) for i in range(60) for k, a in [("x", "abcd"), ("y", "defg"), ("z", "hijk")][: 3 if i == rare else 2]] * 2, "doc_id long, text string, lang string")
    langs, packed = language_id.training_rows(docs)
    assert set(langs) == {"x", "y", "z"} and len(langs) == 1 + 2 * sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    names, matrix = language_id.fit(langs, packed)
    # dense kernel ridge regression in the span of the landmarks, from the kernel alone
    x = np.unpackbits(packed, axis=1).astype(float)
    kernel = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    order = sorted(range(len(langs)), key=lambda i: (langs[:i].count(langs[i]), i))[:7]
    y = np.array([[1.0 if l == n else -1.0 for n in names] for l in langs])
    k = kernel[:, order]
    dual = np.linalg.solve(k.T @ k + len(langs) * (language_id.RIDGE * kernel[np.ix_(order, order)] + 1e-6 * np.eye(7)), k.T @ y)
    assert (x @ matrix) / np.sqrt(x.sum(1))[:, None] == pytest.approx(k @ dual, abs=1e-3)
    # places are those of the n-grams' presence
    grams = {g for t in ["Abca"] for n in (1, 2, 3) for g in [t.lower()[i : i + n] for i in range(len(t) - n + 1)]}
    assert len({int(p) for at in language_id.places(np.frombuffer(b"Abca", np.uint8)) for p in at}) == len(grams)


def test_language_model(spark, texts):
    from collections import Counter
    from math import log10

    got = rows(language_model.score(table(spark, texts)))
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert got[i]["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert got[i]["score"] < 0


def brute_stretch(seen, context, byte):
    """Stretched predictions of a byte's bits from the bytes that followed its context."""
    from math import log

    out = []
    for j in range(8):
        at = [b for b in seen.get(context, []) if b >> (8 - j) == byte >> (8 - j)]
        ones = sum(b >> (7 - j) & 1 for b in at)
        out.append(log((ones + 0.4) / (len(at) - ones + 0.4)) * len(at) / (len(at) + 1.5))
    return out


@pytest.mark.parametrize(("keys", "heavy"), [(1 << 14, 1 << 18), (9, 20), (1, 0)])
def test_language_model_counts_every_context(spark, texts, keys, heavy, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_KEYS", keys)
    packed, *entries = language_model.gather(language_model.keys_of(table(spark, texts)), heavy)
    seen = [{} for _ in range(5)]

    def places(text):
        last = 32
        for w in [*(text or "").encode().lower().split(), None]:
            token = b"\n" if w is None else w + b" "
            for i, b in enumerate(token):
                back = (bytes([0, 0, 0, last, 32]) + token[:i])[-4:][::-1]
                yield [back[: k + 1] for k in range(4)] + [token[:i]], b
            last = last if w is None else w[-1]

    for i, t in enumerate(texts):
        for contexts, b in places(t) if zlib.crc32(str(i).encode()) % 7 != 2 else ():
            for k, c in enumerate(contexts):
                seen[k].setdefault(c, []).append(b)
    got = {}
    for row in packed.collect():
        row = row.asDict()
        chunk = language_model.Chunk(row).locate(*entries, row)
        x, order, _ = chunk.inputs(language_model.PARTS, np.arange(len(chunk.byte)))
        x, data = x[:, :, np.argsort(order)], bytes(row["tokens"])
        for at, u in enumerate(chunk.unit):
            low = int(chunk.low[u]).to_bytes(4, "little")
            got[data[chunk.offs[chunk.token[at]] : at], low, data[at]] = x[:, :, u]
    want = {(c[4], c[3], b): c for t in texts for c, b in places(t)}
    assert got.keys() == want.keys()
    for (_, _, b), c in list(want.items())[::7]:
        assert got[c[4], c[3], b] == pytest.approx(np.array([brute_stretch(seen[k], c[k], b) for k in range(5)]), abs=5e-3)


@pytest.mark.parametrize(("keys", "heavy"), [(1 << 14, 1 << 19), (3, 0)])
def test_language_model_contexts_cross_words(spark, texts, keys, heavy, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_KEYS", keys)
    monkeypatch.setattr(language_model, "HEAVY", heavy)
    monkeypatch.setattr(language_model, "train", lambda packed, entries: language_model.Mixer())
    texts = [*texts, "a b c d e", "xa b c d e", "ab c a b c", "no the", "of the", "lo the", "a\0 b", "\0\0 b"]

    def places(text):
        words = [w + b" " for w in (text or "").encode().lower().split()] + [b"\n"]
        stream, at = b"    " + b"".join(words), 4
        for token in words:
            for i, b in enumerate(token):
                yield [stream[at + i - k : at + i] for k in range(1, 5)] + [token[:i]], b
            at += len(token)

    seen, memo = [{} for _ in range(5)], {}
    for i, t in enumerate(texts):
        for contexts, b in places(t) if zlib.crc32(str(i).encode()) % 7 != 2 else ():
            for k, c in enumerate(contexts):
                seen[k].setdefault(c, []).append(b)

    def log(contexts, b):
        if (*contexts, b) not in memo:
            x = np.array([brute_stretch(seen[k], c, b) for k, c in enumerate(contexts)])[:, :, None]
            gate = min(int(np.ceil(np.log2(len(seen[4].get(contexts[4], [])) + 1) / 2)), 7)
            memo[*contexts, b] = float(language_model.Mixer().log10(x, (np.arange(9) > gate).astype(int), np.array([b], np.uint8))[0])
        return memo[*contexts, b]

    got = rows(language_model.score(table(spark, texts)))
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(sum(log(c, b) for c, b in places(t)), rel=1e-3)


def test_language_model_trains_on_all_documents(spark, monkeypatch):
    sums, docs = [], [f"word{i} of {i % 7}" for i in range(900)]
    monkeypatch.setattr(language_model.Mixer, "settle", lambda self, found: sums.append(found[:, 1].sum()))
    language_model.score(table(spark, docs))
    bytes_ = sum(len(t) + 2 for i, t in enumerate(docs) if zlib.crc32(str(i).encode()) % 7 != 2)
    assert sums == [8 * bytes_]


@pytest.mark.parametrize("run", [lambda d, s: quality_rules.judge(d, s), lambda d, s: jaccard_join.classes(d), lambda d, s: suffix_dedup.remove(d), lambda d, s: kd_sharding.assign(d), lambda d, s: pii.redact(d), lambda d, s: language_model.score(d), lambda d, s: byte_bpe.digests(d)])
def test_empty_tables(spark, run):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert run(table(spark, []), labels).collect() == []


def test_repeated_and_null_keys(spark):
    long_ = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, long_), (1, long_), (1, long_), (None, None), (2, None), (3, "short")], "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in jaccard_join.keep_one(docs).collect())
    assert kept == [(-1, ""), (1, long_), (2, ""), (3, "short")]
    assert suffix_dedup.remove(docs).count() == kd_sharding.assign(docs).count() == language_model.score(docs).count() == 6


def test_keep_one_with_shared_ids(spark):
    def text(c, last):
        return " ".join([*(f"{c}{i}" for i in range(80)), last])

    a, a2, b, b2, c = text("a", "x"), text("a", "y"), text("b", "x"), text("b", "y"), text("c", "x")
    docs = spark.createDataFrame([(1, a), (1, a2), (7, b), (3, b2), (3, c), (3, c), (None, text("c", "y")), (1, None), (1, "")], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect()]
    ones = [k for k in kept if k in ((1, a), (1, a2))]
    assert len(ones) == 1
    assert sorted(kept, key=str) == sorted([*ones, (3, b2), (3, c), (1, None), (1, "")], key=str)


def test_a_worker_frees_what_other_operators_keep():
    path = byte_bpe.vocabulary_path()
    byte_bpe.model(path).encode(["some words"])
    common.begin("byte_bpe")
    assert path in byte_bpe._models
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [b"some words of a text"]})
    assert sum(b.num_rows for b in jaccard_join._describe(4)(iter([batch]))) == 1
    assert not byte_bpe._models
    assert byte_bpe.model(path).encode(["some words"])


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        common.bounded_batches(spark)
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
        got = [r["n"] for r in spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) AS text").mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 20_000_000 and max(got) < 5_000_000
        spark.conf.set(name, "1k")
        common.bounded_batches(spark)
        assert spark.conf.get(name) == "1k"
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_look_up_and_distinct_as_numpy_has_them(n):
    r = np.random.default_rng(n)
    table = np.unique(np.concatenate([r.integers(0, 1 << 64, n, np.uint64), np.array([0, (1 << 64) - 1][:n], np.uint64), np.arange(5, dtype=np.uint64)[:n]]))
    names = np.concatenate([r.permutation(table), r.integers(0, 1 << 64, 500, np.uint64), np.array([0, 7, (1 << 64) - 1], np.uint64)])
    at = language_model.look_up(table, names)
    known = np.isin(names, table)
    assert np.array_equal(at >= 0, known) and np.array_equal(table[at[known]], names[known])
    values, first, inverse = language_model.distinct(np.concatenate([names, names[: n // 2]]))
    assert np.array_equal(values, np.unique(names)) and np.array_equal(values[inverse], np.concatenate([names, names[: n // 2]]))
    assert np.array_equal(np.concatenate([names, names[: n // 2]])[first], values)


@pytest.mark.parametrize("counted", [1 << 20, 40])
def test_keys_are_counted_in_bounded_memory(counted, monkeypatch):
    import tracemalloc
    from collections import Counter

    monkeypatch.setattr(language_model, "COUNTED", counted)
    r = random.Random(3)
    texts = [" ".join(f"{r.choice(WORDS)}{r.randrange(50)}" for _ in range(60_000 if counted > 40 else 30)) for _ in range(12)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t.encode() for t in texts], pa.binary()), "part": pa.array([i % 3 for i in range(12)], pa.int32())})
    tracemalloc.start()
    try:
        got = [x for b in language_model._count_keys(iter([batch])) for x in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    seen, want = Counter(), Counter()
    for x in got:
        if x["before"] != language_model.NO_TOKEN:
            seen.update({(x["token"], x["before"], i): x[f"c{i}"] for i in range(3) if x[f"c{i}"]})
    for i, t in enumerate(texts):
        last = 32
        for w in [*(w.encode() for w in t.lower().split(" ")), None]:
            want[b"\n" if w is None else w + b" ", last, i % 3] += 1
            last = last if w is None else w[-1]
    assert seen == want
    # 5 MB of texts
    assert peak < 130e6


def test_keys_are_dealt_without_sorting_them_first(spark, texts, capsys):
    seen = []
    docs = table(spark, texts)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_model, "materialise", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()))
        language_model.keys_of(docs)
    at = seen[0].index("hashpartitioning(key")
    assert "Aggregate" in seen[0][:at] and "Aggregate" not in seen[0][at:]


def test_keys_are_summed_without_a_sort(spark, texts, monkeypatch):
    seen = []
    monkeypatch.setattr(language_model, "materialise", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()))
    language_model.keys_of(table(spark, texts))
    assert "HashAggregate" in seen[0] and "SortAggregate" not in seen[0]


def test_counted_keys_are_not_sorted_again(monkeypatch):
    monkeypatch.setattr(language_model, "COUNTED", 4000)
    monkeypatch.setattr(language_model, "TEXT_BYTES", 1000)
    r, sorted_, distinct = random.Random(5), [], language_model.distinct
    texts = [" ".join(f"{r.choice(WORDS)}{r.randrange(9)}" for _ in range(100)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t.encode() for t in texts], pa.binary()), "part": pa.array([i % 3 for i in range(300)], pa.int32())})
    monkeypatch.setattr(language_model, "distinct", lambda x: (sorted_.append(len(x)), distinct(x))[1])
    got = [x for b in language_model._count_keys(iter([batch])) for x in b.to_pylist()]
    assert sum(x[f"c{i}"] for x in got if x["before"] != language_model.NO_TOKEN for i in range(3)) == 300 * 101
    assert len({x["key"] for x in got}) == len(got) and sum(sorted_) < 3 * len(got)


def test_units_of_a_chunk_are_its_distinct_contexts(monkeypatch):
    from collections import Counter

    r = random.Random(8)
    tokens = sorted({(b"\n" if w is None else w + b" ", before) for before in b"ab " for w in [None, b"a", b"ab", b"abc", b"abcd", b"abd", b"b", b"x" * 70_000, b"x" * 69_999 + b"y", b"\xff\xfe", b"abcdef", b"zq", *[bytes(r.choices(b"abc", k=r.randrange(1, 7))) for _ in range(40)]] if r.random() < 0.8})
    counts = np.array([[r.randrange(4) for _ in range(3)] for _ in tokens], np.int64)
    row = {"tokens": b"".join(t for t, _ in tokens), "sizes": np.array([len(t) for t, _ in tokens], np.int32).tobytes(), "befores": bytes(b for _, b in tokens), "keys": np.arange(len(tokens)).tobytes(), "counts": counts.tobytes(), "heads": b"", "head_counts": b""}
    monkeypatch.setattr(language_model, "distinct", None)  # its bytes are not sorted
    chunk = language_model.Chunk(row)
    places, want = [], Counter()
    for (token, before), c in zip(tokens, counts.tolist(), strict=True):
        back = bytes([0, 0, 0, before, 32])
        for p in range(len(token)):
            last = (back + token[max(p - 4, 0) : p])[-4:]
            places.append((p if p > 9 else token[:p], token[:1] + last, token[p]))
            want[places[-1]] += c[0]
    assert len(places) == len(chunk.unit) and len(set(places)) == len(set(zip(places, chunk.unit.tolist(), strict=True))) == len(chunk.byte)
    assert all(chunk.weight[u, 0] == want[x] for x, u in zip(places, chunk.unit.tolist(), strict=True))
    ends = [tokens[0][0], tokens[-1][0]]
    start = [token[:p] for token, _ in tokens for p in range(len(token)) if len(token) < 99]
    spot = [chunk.offs[i] + p for i, (token, _) in enumerate(tokens) for p in range(len(token)) if len(token) < 99]
    for at, prefix in zip(spot, start, strict=True):
        assert chunk.open[chunk.unit[at]] == (len(prefix) < 2 or any(e.startswith(prefix) and e != prefix for e in ends))
        assert chunk.low[chunk.unit[at]] & language_model.U(255) == (prefix[-1] if prefix else 32)
    assert np.array_equal(chunk.type, np.cumsum([i == 0 or tokens[i][0] != tokens[i - 1][0] for i in range(len(tokens))]) - 1)


@pytest.mark.parametrize("limit", [4, 50, 100_000])
def test_piece_table_encodes_as_the_library_does(texts, limit, monkeypatch):
    from tokenizers import Tokenizer

    from ondaspark.llm import pretokens

    monkeypatch.setattr(pretokens, "TABLE_CHARS", 200)
    tok = Tokenizer.from_file(token_files.tokenizer_path())
    calls = []
    encoder = token_files.PieceEncoder(tok)
    cache = pretokens.PieceTable(lambda x: calls.extend(x) or encoder(x), limit)
    r = random.Random(limit)
    odd = ["a b\0 b b\0\0 \0", " a", "a ", " ", "\n", "a \n b", "a  b", "x " + "y" * 23 + " " + "y" * 24 + " z", "é ö ſ × a× ÷b 日本 it's don't.", "one\ttwo three", "one two   three", "word, word. Word\nnext word"]
    known = [t or "" for t in texts if "<|" not in (t or "")] + odd
    for _ in range(4):
        some = [r.choice(known) for _ in range(r.randrange(1, 40))]
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in cache.many(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]
    assert cache.many([]) == [] and cache.many(["", ""]) == [b"", b""]
    if limit == 100_000:
        cache.many(["alpha beta alpha beta, gamma"])
        calls.clear()
        cache.many(["alpha beta, gamma beta alpha", "alpha alpha"])
        assert calls == ["alpha", "alpha"]
