"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Generators propose spans with high recall: the base patterns of the four kinds
with their checks, and looser patterns of the same kinds (addresses written
with words for the signs, numbers without a plus or with spaces and dots,
addresses with brackets). Looser candidates overlap base spans and each
other. Boosted trees score each by format features (length, digits,
separators, groups) and context features (words in front of and after it,
neighbouring characters); they are fitted at the driver on a bounded sample of
generated examples in which patterns are planted in, or imitated by, numbers of
running text, and each kind's threshold is calibrated on a held-out half to
MIN_PRECISION. The trees are written out as CASE expressions, so scoring stays
in the JVM. Chosen candidates that overlap no base span and no better
candidate are added; base spans stay always.

Java's leftmost, non-overlapping matching gives the matches; the pieces
between them (split by the same pattern) give their places. Possessive
repeats and boundaries keep every pattern linear on any text.

Defined cases: null and empty texts have no spans; a null doc_id keeps its
row; repeated rows get equal results; an empty table gives no rows; other
columns pass through ``redact`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. A start in the middle of a run can only match where the run's start does, so runs are entered at their start or after a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # runs of fewer digits can't pass
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters that a text with a match must hold, looked for before the pattern is run.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Looser generators.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\(\[]? ?(?:at|AT) ?[\)\]]? ?[A-Za-z0-9-]{1,63}+(?: ?[\(\[]? ?(?:dot|DOT) ?[\)\]]? ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+ ?(?:\[\.\]|\(\.\)| \. ) ?[0-9]{1,3}+ ?(?:\[\.\]|\(\.\)| \. ) ?[0-9]{1,3}+ ?(?:\[\.\]|\(\.\)| \. ) ?[0-9]{1,3}+",
    "card": r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_NEEDS = {"email": r"(?i:dot)", "ip": r"[\[(]\.|[0-9] \. [0-9]", "card": r"[0-9][./_][0-9]{4}[./_]", "phone": r"[0-9]\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}
#: Words in the context of personal data, lower case.
CONTEXT = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "call", "tel", "fax")}
#: Characters of context on either side.
AROUND = 24
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

EXAMPLES = 4000
TREES, DEPTH, RATE = 24, 2, 0.3
MIN_PRECISION = 0.98
SEED = 11

SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


# --------------------------------------------------------------------------- generators


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Every match as (start, end, kind, value), code points; the pieces between matches carry the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    zipped = F.zip_with(gaps, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    total = F.aggregate(
        zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.coalesce(x["gap"], F.lit(0)) + F.coalesce(F.char_length(x["value"]), F.lit(0))).alias("at"),
            F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.char_length(x["value"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))))).alias("spans"),
        ),
    )
    return F.when(F.size(found) > 0, total["spans"]).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return value.rlike("^" + r"\.".join([OCTET] * 4) + "$")
    if kind == "card":
        return F.char_length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda s: passes(kind, s["value"])


def base_spans(text: Column) -> Column:
    """Checked base spans of all kinds, by start, then kind."""
    parts = []
    for i, kind in enumerate(KINDS):
        found = F.filter(_matches(text, BASE[kind], i), _passing(kind))
        need = NEEDS[kind]
        some = F.contains(text, F.lit(need)) if need else text.rlike(BASE[kind])
        parts.append(F.when(some, found).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def loose_spans(text: Column) -> Column:
    parts = [F.when(text.rlike(LOOSE_NEEDS[k]), _matches(text, LOOSE[k], i)).otherwise(F.array().cast(SPAN)) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


# --------------------------------------------------------------------------- features


def features(text: Column, start: Column, end: Column, kind: Column, value: Column) -> dict[str, Column]:
    """Format and context features of a candidate, as doubles."""
    n = F.char_length(value)
    digits = F.char_length(_digits(value))
    left = F.lower(F.substring(text, F.greatest(F.lit(1), start - AROUND + 1), F.least(F.lit(AROUND), start)))
    right = F.lower(F.substring(text, end + 1, F.lit(AROUND)))
    words = lambda side, k: F.coalesce(*[F.when(kind == i, side.rlike(r"\b(?:" + "|".join(CONTEXT[name]) + ")")) for i, name in enumerate(KINDS)])
    out = {
        "length": n, "digits": digits, "digit_share": digits / n, "letters": F.char_length(F.regexp_replace(value, "[^A-Za-z]", "")), "spaces": F.char_length(F.regexp_replace(value, "[^ ]", "")),
        "brackets": F.char_length(F.regexp_replace(value, r"[^\[\]()]", "")), "groups": F.size(F.split(value, r"[^A-Za-z0-9]+")), "distinct_digits": F.size(F.array_distinct(F.split(_digits(value), ""))),
        "luhn": F.call_function("luhn_check", _digits(value)), "octets": F.regexp_replace(value, r"[^0-9]+", ".").rlike("^" + r"\.".join([OCTET] * 4) + "$"), "top_domain": value.rlike(r"(?i:com|net|org|edu|io|example)$"),
        "word_before": words(left, kind), "word_after": words(right, kind), "digit_before": left.rlike(r"[0-9][ ,.;|-]?$"), "digit_after": right.rlike(r"^[ ,.;|-]?[0-9]"), "colon_before": left.rlike(r"[:=] ?$"),
    }
    return {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in out.items()}


# --------------------------------------------------------------------------- boosted trees


@dataclass
class Node:
    """A leaf (value) or a split: rows of feature at most threshold go left."""

    value: float = 0.0
    feature: str = ""
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.left is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] <= self.threshold, self.left.of(x), self.right.of(x))

    def column(self, f) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(f(self.feature) <= F.lit(self.threshold), self.left.column(f)).otherwise(self.right.column(f))


def _tree(x: dict[str, np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Node:
    """Regression tree on second-order gains with leaf regularisation 1."""
    g, h = gradient.sum(), hessian.sum()
    leaf = Node(value=float(g / (h + 1.0)))
    best = (1e-6, "", 0.0)
    if depth:
        for name, v in x.items():
            order = np.argsort(v, kind="stable")
            s, gl, hl = v[order], np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
            cut = s[1:] > s[:-1]
            if cut.any():
                gain = np.where(cut, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], name, float((s[i] + s[i + 1]) / 2))
    if not best[1]:
        return leaf
    side = x[best[1]] <= best[2]
    part = lambda k: _tree({n: v[k] for n, v in x.items()}, gradient[k], hessian[k], depth - 1)
    return Node(feature=best[1], threshold=best[2], left=part(side), right=part(~side))


@dataclass
class Model:
    """Trees of each kind, and the margin from which a candidate is taken (None: never)."""

    trees: dict[int, list[Node]]
    thresholds: dict[int, float | None]


def fit(x: dict[str, np.ndarray], kind: np.ndarray, y: np.ndarray) -> Model:
    """Logistic boosting for each kind on the even rows; thresholds on the odd ones, the lowest with MIN_PRECISION."""
    trees, thresholds = {}, {}
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        learn, test = own[::2], own[1::2]
        trees[k], thresholds[k] = [], None
        if not len(test) or y[learn].all() or not y[learn].any():
            continue
        at = {n: v[learn] for n, v in x.items()}
        margin = np.zeros(len(learn))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            t = _tree(at, y[learn] - p, p * (1 - p), DEPTH)
            margin += RATE * t.of(at)
            trees[k].append(t)
        score = sum(RATE * t.of({n: v[test] for n, v in x.items()}) for t in trees[k])
        order = np.argsort(-score, kind="stable")
        precision = np.cumsum(y[test][order]) / np.arange(1, len(test) + 1)
        last = np.concatenate([score[order][1:] < score[order][:-1], [True]])  # whole ties only
        good = np.flatnonzero(last & (precision >= MIN_PRECISION))
        if len(good):  # halfway to the next lower score, so that a clean gap is split
            ranked = score[order]
            thresholds[k] = float((ranked[good[-1]] + ranked[min(good[-1] + 1, len(test) - 1)]) / 2)
    return Model(trees, thresholds)


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, bool]]:
    """Generated texts, each around one loose candidate, and whether it is personal data: planted with its usual context, or imitated by figures, versions, sums and running text."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    word = lambda: "".join(pick("aeiou") if i % 2 else pick("bcdfglmnprst") for i in range(int(r.integers(2, 9))))
    number = lambda n: "".join(pick("0123456789") for _ in range(n))
    text = lambda n: " ".join(word() for _ in range(n))
    out = []
    for i in range(count):
        kind, real = KINDS[i % 4], bool(r.random() < 0.5)
        lead = (pick(CONTEXT[kind]) + pick((": ", " ", " is ", " me on "))) if real == (r.random() < 0.95) else pick(("", "item ", "about ", "total ", "near "))
        if kind == "email":
            if real:
                o, c = pick((("(", ")"), ("[", "]"), (" ", " ")))
                value = f"{word()}.{word()} {o}at{c} {word()} {o}dot{c} {pick(('com', 'net', 'org'))}"
            else:
                value = f"{word()} at {word()} dot {word()}"
        elif kind == "ip":
            dot = pick(("[.]", "(.)", " . "))
            value = dot.join(str(int(r.integers(0, 256 if real else 999))) for _ in range(4))
            if not real:
                dot, lead = " . ", pick(("", "version ", "table "))
                value = dot.join(str(int(r.integers(0, 999))) for _ in range(4))
        elif kind == "card":
            sep = pick("./_")
            body = number(15)
            check = sum(d if j % 2 else (2 * d - 9 if d > 4 else 2 * d) for j, d in enumerate(map(int, body)))
            body += str(-check % 10 if real else (-check + int(r.integers(1, 10))) % 10)
            value = sep.join(body[j : j + 4] for j in range(0, 16, 4))
        else:
            sep = pick(" .-")
            value = f"({number(3)}) {number(3)}-{number(4)}" if real and r.random() < 0.3 else sep.join((number(3), number(3), number(4)))
            if not real:
                value += pick(("", " " + number(3), "." + number(2)))
                lead = pick(("", number(3) + " ", "rows ", "sum "))
        out.append((f"{text(3)} {lead}{value} {text(3)}", real))
    return out


@lru_cache(maxsize=1)
def _trained(application: str) -> Model:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(examples())], "id long, text string, y boolean")
    found = rows.select("id", "text", "y", F.explode(loose_spans(F.col("text"))).alias("s"))
    f = features(F.col("text"), F.col("s.start"), F.col("s.end"), F.col("s.kind"), F.col("s.value"))
    got = found.select("id", "y", F.col("s.kind").alias("kind"), *[c.alias(n) for n, c in f.items()]).orderBy("id", "kind").collect()
    x = {n: np.array([r[n] for r in got], float) for n in f}
    return fit(x, np.array([r["kind"] for r in got], int), np.array([r["y"] for r in got], bool))


def trained(spark) -> Model:
    """The model, fitted once for each application (a few thousand generated rows)."""
    return _trained(spark.sparkContext.applicationId)


def margin(model: Model, kind: Column, f) -> Column:
    """A candidate's margin above its kind's threshold, from features by name; null if its kind takes none."""
    out = F.lit(None).cast("double")
    for k, threshold in model.thresholds.items():
        if threshold is not None:
            score = F.lit(-threshold)
            for t in model.trees[k]:
                score = score + F.lit(RATE) * t.column(f)
            out = F.when(kind == k, score).otherwise(out)
    return out


def added_spans(model: Model, text: Column, base: Column, loose: Column) -> Column:
    """Loose candidates over their threshold that overlap no base span and no candidate taken before (by start)."""
    clear = F.filter(loose, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    described = F.transform(clear, lambda s: F.struct(s.alias("span"), *[c.alias(n) for n, c in features(text, s["start"], s["end"], s["kind"], s["value"]).items()]))
    good = F.transform(F.filter(described, lambda c: F.coalesce(margin(model, c["span"]["kind"], lambda n: c[n]) >= 0, F.lit(False))), lambda c: c["span"])
    chosen = F.aggregate(good, F.array().cast(SPAN), lambda acc, s: F.when(F.exists(acc, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.when(F.size(loose) > 0, chosen).otherwise(F.array().cast(SPAN))


# --------------------------------------------------------------------------- the operator


def _free(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
    return out


def detect(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, base spans and added spans; and their names. Nothing is shuffled."""
    model = trained(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base, loose, added = _free(docs, "pii_base", "pii_loose", "pii_added")
    found = docs.withColumn(base, base_spans(text)).withColumn(loose, loose_spans(text))
    return found.withColumn(added, added_spans(model, text, F.col(base), F.col(loose))).drop(loose), base, added


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs, with every span of the text replaced by its kind in brackets, e.g. [EMAIL]. Spans that overlap are replaced as one, by the first's kind."""
    found, base, added = detect(docs)
    out = "array<struct<start:int,end:int,kind:int,value:string>>"
    sorted_ = F.array_sort(F.concat(F.col(base), F.col(added)))
    merged = F.aggregate(
        sorted_, F.array().cast(out),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"), F.try_element_at(acc, F.lit(-1))["kind"].alias("kind"), F.lit("").alias("value"))))).otherwise(F.concat(acc, F.array(s))),
    )
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    cut = F.aggregate(
        merged, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"]))).alias("parts")),
    )
    clean = F.concat(F.array_join(cut["parts"], ""), F.substring(text, cut["at"] + 1, F.char_length(text)))
    return found.withColumn("text", F.when(F.size(sorted_) > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found, base, added = detect(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, added)).alias("spans"), F.size(added).cast("long").alias("n_added"),
    )
