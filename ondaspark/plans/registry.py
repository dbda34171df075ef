"""Registered queries over the signal tables, and their SQL equivalents.

Signals: ``embeddings`` (a channel a vector, 64 samples at 64 Hz), its mean by
label (10 channels), and hourly sums of ``events`` by type. Outputs are rounded
to six places; adding 0 turns a negative zero.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Bandpass, Lowpass, operator
from ..operators import lfp as bands
from ..operators import resample as rs
from ..operators import signal as sg
from ..operators import spectral as sp
from ..sources import blocks, channels, dictlog
from ..sources.logdb import LogDB

FS = 64.0
LOW, BAND = Lowpass(25.0), Bandpass(25.0, 30.0)
#: Times of the channel table count from here.
START = "2024-01-01 00:00:00"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r6(c, places: int = 6):
    return F.round(c, places) + F.lit(0.0)


def signal(spark, sf_dir) -> sg.Signal:
    return channels.packed_arrays(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", FS)


def label_means(spark, sf_dir) -> sg.Signal:
    """Ten channels: the mean signal of each label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("channel"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = rows.groupBy("channel", "i").agg(F.avg("x").alias("x")).withColumn("t", F.col("i") / FS)
    return sg.Signal.from_long(means, FS)


def samples(df: DataFrame) -> DataFrame:
    return df.select("channel", "i", r6("t").alias("t"), r6("x").alias("x"))


# --------------------------------------------------------------------------- SQL pieces

LONG = "SELECT vec_id AS channel, CAST(i AS BIGINT) AS i, i / 64.0::DOUBLE AS t, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding))) AS i)"
MEANS = "SELECT CAST(label AS BIGINT) AS channel, CAST(i AS BIGINT) AS i, i / 64.0::DOUBLE AS t, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding))) AS i) GROUP BY label, i"
ZSCORE = "SELECT channel, i, t, (x - avg(x) OVER (PARTITION BY channel)) / nullif(stddev_pop(x) OVER (PARTITION BY channel), 0) AS x FROM s"
ROUND = "round({0}, 6) + 0.0"


def sql_segments(p: sp.Plan, n: int = 64) -> str:
    """seg: (channel, k, t, j, x) of all segments of the table z."""
    return f"""c AS (SELECT row_number() OVER (ORDER BY c) - 1 AS k, c FROM (SELECT unnest(range({p.nperseg}, {n - p.nperseg}, {p.step})) AS c)),
seg AS (SELECT z.channel, c.k, c.c / 64.0::DOUBLE AS t, z.i - c.c + {p.nperseg // 2} AS j, z.x FROM c JOIN z ON z.i BETWEEN c.c - {p.nperseg // 2} AND c.c - {p.nperseg // 2} + {p.nperseg - 1})"""


def sql_detrend(p: sp.Plan) -> str:
    if p.detrend is None:
        return "d AS (SELECT * FROM seg)"
    if p.detrend == "constant":
        return "d AS (SELECT channel, k, t, j, x - avg(x) OVER (PARTITION BY channel, k) AS x FROM seg)"
    mid = (p.nperseg - 1) / 2
    square = float(((np.arange(p.nperseg) - mid) ** 2).sum())
    return f"""d AS (SELECT channel, k, t, j, x - m - b * (j - {mid}) AS x FROM (SELECT *, avg(x) OVER (PARTITION BY channel, k) AS m, sum(x * (j - {mid})) OVER (PARTITION BY channel, k) / {square} AS b FROM seg))"""


def sql_spectra(p: sp.Plan) -> str:
    """ft: (channel, k, t, f, freq, re, im) of the table z."""
    factor = "1" if not p.onesided else f"CASE WHEN f.f = 0{f' OR f.f = {p.nfft // 2}' if p.nfft % 2 == 0 else ''} THEN 1 ELSE sqrt(2.0) END"
    freq = f"f.f * {p.fs} / {p.nfft}" if p.onesided else f"CASE WHEN f.f <= {(p.nfft - 1) // 2} THEN f.f ELSE f.f - {p.nfft} END * {p.fs} / {p.nfft}"
    taper = f"(0.5 - 0.5 * cos(2 * pi() * j / {p.nperseg}))"
    return f"""{sql_segments(p)}, {sql_detrend(p)}, f AS (SELECT unnest(range(0, {len(p.freqs)})) AS f),
ft AS (SELECT channel, k, t, f.f, {freq} AS freq, sum(x * {taper} * cos(-2 * pi() * f.f * j / {p.nfft})) * {factor} * {p.scale!r} AS re, sum(x * {taper} * sin(-2 * pi() * f.f * j / {p.nfft})) * {factor} * {p.scale!r} AS im
FROM d, f WHERE j < {p.nfft} GROUP BY channel, k, t, f.f)"""


CROSS = """psd AS (SELECT a.channel, b.channel AS channel_2, a.f, a.freq, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im FROM ft a JOIN ft b ON a.k = b.k AND a.f = b.f GROUP BY a.channel, b.channel, a.f, a.freq)"""
SHORT = {"approx_window_duration": 0.25, "approx_freq_fs": 0.5}
FT_OUT = f"SELECT channel, CAST(k AS INTEGER) AS k, {ROUND.format('t')} AS t, CAST(f AS INTEGER) AS f, {ROUND.format('freq')} AS freq, {ROUND.format('re')} AS re, {ROUND.format('im')} AS im FROM ft"


# --------------------------------------------------------------------------- signals and sources


@query("signal_long", f"WITH s AS ({LONG}) SELECT channel, i, {ROUND.format('t')} AS t, {ROUND.format('x')} AS x FROM s")
def signal_long(spark, sf_dir):
    return samples(signal(spark, sf_dir).long())


@query("signal_pack_stats", f"WITH s AS ({LONG}) SELECT channel, CAST(count(*) AS INTEGER) AS n, {ROUND.format('min(t)')} AS t0, {ROUND.format('arg_min(x, i)')} AS first_x, {ROUND.format('arg_max(x, i)')} AS last_x FROM s GROUP BY channel")
def signal_pack_stats(spark, sf_dir):
    packed = sg.Signal.from_long(signal(spark, sf_dir).long(), FS).df
    return packed.select("channel", F.size("x").alias("n"), r6("t0").alias("t0"), r6(F.get("x", F.lit(0))).alias("first_x"), r6(F.try_element_at("x", F.lit(-1))).alias("last_x"))


def hourly(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    edge = events.agg(F.min(hour).alias("a"), ((F.max(F.unix_seconds(hour)) - F.min(F.unix_seconds(hour))) / 3600 + 1).cast("int").alias("n")).first()  # the whole table's hours
    return channels.regular_counts(events, "event_type", "ts", "value", 3600, edge["a"], edge["n"] or 0)


@query("events_hourly_signal", """WITH b AS (SELECT min(date_trunc('hour', ts)) AS a, date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) AS n FROM events),
e AS (SELECT event_type, date_diff('hour', b.a, date_trunc('hour', ts)) AS i, value FROM events, b),
g AS (SELECT event_type, i, sum(value) AS x FROM e GROUP BY event_type, i), cells AS (SELECT DISTINCT event_type, h.i FROM events, (SELECT unnest(range(0, b.n + 1)) AS i FROM b) h)
SELECT c.event_type AS channel, CAST(c.i AS BIGINT) AS i, round(coalesce(g.x, 0.0), 4) + 0.0 AS x FROM cells c LEFT JOIN g ON g.event_type = c.event_type AND g.i = c.i""")
def events_hourly_signal(spark, sf_dir):
    return hourly(spark, sf_dir).select("channel", "i", r6(F.col("x"), 4).alias("x"))


def metadata(spark, sf_dir) -> DataFrame:
    """A channel table of the event types: ticks of a second, a sample an hour; errors are no sampled channel, logins are off."""
    stats = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.floor(F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000).alias("a"), F.floor(F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000).alias("b"))
    start = F.unix_seconds(F.lit(START).cast("timestamp"))
    kind = F.when(F.col("event_type") == "error", "DataType.Marker").when(F.col("event_type") == "login", "DataType.Off").otherwise("DataType.Adc")
    number = F.crc32(F.col("event_type").cast("binary")) % 1000
    return channels.channel_table(stats.select(F.col("event_type").alias("chan_name"), kind.alias("chan_type"), number.alias("physical_channel"), number.alias("chan_num"), F.lit(3600).alias("divide"), F.lit(1.0).alias("time_base"), (F.col("a") - start).alias("first_time"), (F.col("b") - start).alias("max_time")))


_CHANNELS = f"""SELECT event_type AS chan_name, CASE WHEN event_type = 'error' THEN 'Marker' ELSE 'Adc' END AS chan_type, CASE WHEN event_type = 'error' THEN -1.0 ELSE 1.0 / 3600 END AS fs,
floor(epoch(min(ts))) - epoch(TIMESTAMP '{START}') AS start_t, floor(epoch(max(ts))) - epoch(TIMESTAMP '{START}') AS end_t FROM events WHERE event_type <> 'login' GROUP BY event_type"""


@query("channel_metadata", f"SELECT chan_name, chan_type, round(fs, 9) AS fs, start_t, end_t FROM ({_CHANNELS})")
def channel_metadata(spark, sf_dir):
    return metadata(spark, sf_dir).select("chan_name", "chan_type", F.round("fs", 9).alias("fs"), "start_t", "end_t")


@query("channel_complement", f"SELECT chan_name FROM ({_CHANNELS}) WHERE chan_type = 'Adc' AND chan_name <> 'view'")
def channel_complement(spark, sf_dir):
    table = metadata(spark, sf_dir)
    left_out = [r["chan_num"] for r in table.where("chan_name = 'view'").select("chan_num").collect()]
    return channels.choose(table, [..., *left_out]).select("chan_name")


@query("interval_intersection", f"SELECT max(start_t) AS start_t, CAST(round_even((min(end_t) - max(start_t)) / 3600, 0) AS BIGINT) AS n FROM ({_CHANNELS}) WHERE chan_type = 'Adc'")
def interval_intersection(spark, sf_dir):
    adc = metadata(spark, sf_dir).where("chan_type = 'Adc'")
    return adc.agg(F.max("start_t").alias("start_t"), F.bround((F.min("end_t") - F.max("start_t")) / 3600.0, 0).cast("long").alias("n"))


@query("channel_load", f"""WITH c AS ({_CHANNELS}), d AS (SELECT * FROM c WHERE chan_type = 'Adc' AND chan_name <> 'view'), a AS (SELECT max(start_t) AS start_t, CAST(round_even((min(end_t) - max(start_t)) / 3600, 0) AS BIGINT) AS n FROM d)
SELECT d.chan_name, CAST(s.i AS BIGINT) AS i, a.start_t + s.i * 3600.0 AS t, CAST(3600 * s.i + a.start_t AS DOUBLE) AS x FROM d, a, (SELECT unnest(range(0, a.n)) AS i FROM a) s""")
def channel_load(spark, sf_dir):
    """All sampled channels but one, whose samples are the ticks that they are read from."""
    table = metadata(spark, sf_dir)
    left_out = [r["chan_num"] for r in table.where("chan_name = 'view'").select("chan_num").collect()]
    rows, _ = channels.load(spark, table, [..., *left_out], lambda channel, tick, count: tick + 3600.0 * np.arange(count), block=100, time_base=1.0)
    names = table.select("chan_name", F.col("chan_num").cast("long").alias("channel"))
    return rows.join(F.broadcast(names), "channel").select("chan_name", "i", F.round("t", 6).alias("t"), "x")


@query("chunk_function_source", "SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, CAST(a * 100 + b AS DOUBLE) AS x FROM (SELECT unnest(range(0, 7)) AS a), (SELECT unnest(range(0, 53)) AS b)")
def chunk_function_source(spark, sf_dir):
    return blocks.read_blocks(spark, lambda s: np.add.outer(np.arange(s[0].start, s[0].stop) * 100.0, np.arange(s[1].start, s[1].stop)), (7, 53), (2, 10))


# --------------------------------------------------------------------------- spectral core


@query("zscore", f"WITH s AS ({LONG}) SELECT channel, i, {ROUND.format('t')} AS t, {ROUND.format('x')} AS x FROM ({ZSCORE})")
def zscore(spark, sf_dir):
    return samples(sg.zscore(signal(spark, sf_dir)).long())


def _segment_query(name: str, p: sp.Plan, step, sql_steps: str):
    @query(name, f"WITH z AS ({LONG}), {sql_segments(p)}, {sql_detrend(p)} SELECT channel, CAST(k AS INTEGER) AS k, {ROUND.format('t')} AS t, CAST(j AS INTEGER) AS j, round({sql_steps}, 6) + 0.0 AS x FROM d")
    def run(spark, sf_dir):
        rows = step(sp.segments(signal(spark, sf_dir), p))
        return rows.select("channel", "k", r6("t").alias("t"), F.posexplode("seg").alias("j", "x")).withColumn("x", r6("x"))

    return run


_PLAIN, _CONST, _LINEAR = (sp.plan(FS, nperseg=16, detrend=d) for d in (None, "constant", "linear"))
_segment_query("segments", _PLAIN, lambda rows: rows, "x")
_segment_query("detrend_constant", _CONST, lambda rows: sp.detrended(rows, _CONST), "x")
_segment_query("detrend_linear", _LINEAR, lambda rows: sp.detrended(rows, _LINEAR), "x")
_segment_query("windowed_segments", _PLAIN, lambda rows: sp.windowed(rows, _PLAIN), "x * (0.5 - 0.5 * cos(2 * pi() * j / 16))")


def _fft_out(df):
    return df.select("channel", "k", r6("t").alias("t"), "f", r6("freq").alias("freq"), r6("re").alias("re"), r6("im").alias("im"))


def _fft_query(name: str, p: sp.Plan, normalise: bool):
    @query(name, f"WITH s AS ({LONG}), z AS ({ZSCORE if normalise else 'SELECT * FROM s'}), {sql_spectra(p)} {FT_OUT}")
    def run(spark, sf_dir):
        s = signal(spark, sf_dir)
        return _fft_out(sp.spectra(sg.zscore(s) if normalise else s, p))

    return run


_fft_query("scaled_fft_density", sp.scaled_plan(FS, **SHORT), True)
_fft_query("scaled_fft_spectrum", sp.scaled_plan(FS, scaling="spectrum", **SHORT), True)
_fft_query("fft_twosided", sp.plan(FS, nperseg=16, onesided=False), False)
_fft_query("fft_truncated", sp.plan(FS, nperseg=16, nfft=10), False)
_fft_query("fft_odd_nfft", sp.plan(FS, nperseg=16, nfft=21, detrend="linear"), False)
_DENSITY = sp.scaled_plan(FS, **SHORT)


@query("scaled_fft_kernel", ORACLES["scaled_fft_density"])
def scaled_fft_kernel(spark, sf_dir):
    return _fft_out(sp.scaled_fft(signal(spark, sf_dir), kernel=True, **SHORT))


@query("welch_power", f"WITH s AS ({LONG}), z AS ({ZSCORE}), {sql_spectra(_DENSITY)} SELECT channel, CAST(f AS INTEGER) AS f, {ROUND.format('freq')} AS freq, {ROUND.format('avg(re * re + im * im)')} AS power FROM ft GROUP BY channel, f, freq")
def welch_power(spark, sf_dir):
    power = sp.welch_power(sp.scaled_fft(signal(spark, sf_dir), **SHORT))
    return power.select("channel", "f", r6("freq").alias("freq"), r6("power").alias("power"))


_MEANS_FT = f"WITH s AS ({MEANS}), z AS ({ZSCORE}), {sql_spectra(_DENSITY)}, {CROSS}"


def _psd(spark, sf_dir):
    return sp.cross_spectrum(sp.scaled_fft(label_means(spark, sf_dir), **SHORT))


@query("psd_cross", f"{_MEANS_FT} SELECT channel, channel_2, CAST(f AS INTEGER) AS f, {ROUND.format('freq')} AS freq, {ROUND.format('re')} AS re, {ROUND.format('im')} AS im FROM psd")
def psd_cross(spark, sf_dir):
    return _psd(spark, sf_dir).select("channel", "channel_2", "f", r6("freq").alias("freq"), r6("re").alias("re"), r6("im").alias("im"))


@query("welch_diagonal", f"{_MEANS_FT} SELECT channel, CAST(f AS INTEGER) AS f, {ROUND.format('freq')} AS freq, {ROUND.format('re')} AS power FROM psd WHERE channel = channel_2")
def welch_diagonal(spark, sf_dir):
    return sp.welch(_psd(spark, sf_dir), check=False).select("channel", "f", r6("freq").alias("freq"), r6("power").alias("power"))


@query("coherence", f"""{_MEANS_FT}, w AS (SELECT channel, f, re AS p FROM psd WHERE channel = channel_2)
SELECT psd.channel, psd.channel_2, CAST(psd.f AS INTEGER) AS f, {ROUND.format('freq')} AS freq, {ROUND.format('(re * re + im * im) / nullif(a.p * b.p, 0)')} AS coherence, {ROUND.format('atan2(round(im, 12) + 0.0, re)')} AS coherence_phase
FROM psd JOIN w a ON a.channel = psd.channel AND a.f = psd.f JOIN w b ON b.channel = psd.channel_2 AND b.f = psd.f""")
def coherence(spark, sf_dir):
    return sp.coherence(_psd(spark, sf_dir)).select("channel", "channel_2", "f", r6("freq").alias("freq"), r6("coherence").alias("coherence"), r6("coherence_phase").alias("coherence_phase"))


# --------------------------------------------------------------------------- resampling and filters


def sql_resampled(out: float, distrust: float) -> str:
    first, last = rs.grid(0.0, 63 / FS, out, distrust)
    return f"""SELECT p.channel, CAST(g.k AS BIGINT) AS k, round(g.k / {out}, 6) + 0.0 AS t, round(p.x + (coalesce(p.x1, p.x) - p.x) * (g.k / {out} * 64 - p.i), 6) + 0.0 AS x
FROM (SELECT k, least(CAST(floor(k / {out} * 64) AS BIGINT), 63) AS at FROM (SELECT unnest(range({first}, {last + 1})) AS k)) g
JOIN (SELECT channel, i, x, lead(x) OVER (PARTITION BY channel ORDER BY i) AS x1 FROM y) p ON p.i = g.at"""


def _points(s: sg.Signal, out: float) -> DataFrame:
    rows = s.long()
    return rows.select("channel", F.bround(F.col("t") * out, 0).cast("long").alias("k"), r6("t").alias("t"), r6("x").alias("x"))


@query("resample_linear", f"WITH y AS ({LONG}) {sql_resampled(50.0, 0.0)}")
def resample_linear(spark, sf_dir):
    return rs.resample_long(signal(spark, sf_dir).long(), 50.0).select("channel", "k", r6("t").alias("t"), r6("x").alias("x"))


@query("distrust_trim", f"WITH y AS ({LONG}) {sql_resampled(40.0, 0.3)}")
def distrust_trim(spark, sf_dir):
    return _points(rs.resample(signal(spark, sf_dir), 40.0, 0.3), 40.0)


@lru_cache(maxsize=4)
def _matrix(design) -> str:
    """The zero-phase filter of 64 samples as rows of a matrix, in SQL."""
    return ", ".join("(" + str(i) + ", [" + ", ".join(repr(float(v)) for v in row) + "])" for i, row in enumerate(operator(design.sections(FS), 64)))


def sql_filtered(source: str, design, name: str) -> str:
    return f"""{name}_h(i, h) AS MATERIALIZED (VALUES {_matrix(design)}), {name}_x AS MATERIALIZED (SELECT channel, list(x ORDER BY i) AS x FROM {source} GROUP BY channel),
{name} AS MATERIALIZED (SELECT channel, CAST(i AS BIGINT) AS i, i / 64.0::DOUBLE AS t, list_dot_product(x, h::DOUBLE[]) AS x FROM {name}_x, {name}_h)"""


@query("lowpass_filtfilt", f"WITH s AS ({LONG}), {sql_filtered('s', LOW, 'y')} SELECT channel, i, {ROUND.format('t')} AS t, {ROUND.format('x')} AS x FROM y")
def lowpass_filtfilt(spark, sf_dir):
    return samples(rs.filtered(signal(spark, sf_dir), LOW).long())


@query("lowpass_fold", f"WITH s AS ({MEANS}), {sql_filtered('s', LOW, 'y')} SELECT channel, i, {ROUND.format('t')} AS t, {ROUND.format('x')} AS x FROM y")
def lowpass_fold(spark, sf_dir):
    return samples(rs.filtered_by_fold(label_means(spark, sf_dir), LOW).long())


@query("bandpass", f"WITH s AS ({LONG}), {sql_filtered('s', BAND, 'y')} {sql_resampled(FS, BAND.distrust_time())}")
def bandpass(spark, sf_dir):
    return _points(bands.bandpass(signal(spark, sf_dir), BAND), FS)


@query("lfp", f"WITH s AS ({LONG}), {sql_filtered('s', LOW, 'y')} {sql_resampled(50.0, LOW.distrust_time())}")
def lfp(spark, sf_dir):
    return _points(bands.lfp(signal(spark, sf_dir), LOW, 50.0), 50.0)


@query("bua", f"WITH s AS ({LONG}), {sql_filtered('s', BAND, 'b')}, a AS (SELECT channel, i, t, abs(x) AS x FROM b), {sql_filtered('a', LOW, 'y')} {sql_resampled(50.0, BAND.distrust_time())}")
def bua(spark, sf_dir):
    return _points(bands.bua(signal(spark, sf_dir), BAND, LOW, 50.0), 50.0)


# --------------------------------------------------------------------------- logs and checkpoints


def event_log(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("value"), (F.col("event_type") == "error").alias("deleted"))


@query("kv_latest", "SELECT user_id AS id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def kv_latest(spark, sf_dir):
    return dictlog.latest(event_log(spark, sf_dir))


def _folder(spark, name: str) -> str:
    """A new folder for what a query writes: in the shared one, or a local session's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file:///tmp/ondaspark-checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written_log(spark, sf_dir) -> str:
    path = f"{_folder(spark, 'log')}/lines"
    dictlog.write_log(event_log(spark, sf_dir), path)
    return path


@query("kv_log_replay", "SELECT CAST(user_id AS VARCHAR) AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def kv_log_replay(spark, sf_dir):
    """The events as a log of JSON lines, read back and replayed."""
    return dictlog.latest(dictlog.read_log(spark, _written_log(spark, sf_dir))).select("id", F.col("value").cast("double").alias("value"))


@query("kv_compact", "SELECT count(*) AS n_log, CAST(count(DISTINCT user_id) AS BIGINT) AS n_keys, CAST((SELECT count(*) FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error') AS BIGINT) AS n_live FROM events")
def kv_compact(spark, sf_dir):
    """A log's lines and keys, and the lines that compaction leaves."""
    path, out = _written_log(spark, sf_dir), f"{_folder(spark, 'log')}/compact"
    dictlog.compact_log(spark, path, out)
    before = dictlog.read_log(spark, path).agg(F.count("*").alias("n_log"), F.count_distinct("id").alias("n_keys"))
    return before.crossJoin(dictlog.read_log(spark, out).agg(F.count("*").alias("n_live")))  # one row each


@query("nested_log_replay", "SELECT r_name AS region, n_name AS nation, CAST(n_nationkey AS BIGINT) * 2 AS number FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def nested_log_replay(spark, sf_dir):
    """Nations by region in a logged tree, changed and deleted, then read from the log anew. The tree is metadata of the driver."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").orderBy("n_nationkey").limit(1000).collect()
    with tempfile.TemporaryDirectory() as folder:
        db = LogDB(f"{folder}/tree.jsonl", {})
        for r in rows:
            if r["r_name"] not in db.root:
                db.root[r["r_name"]] = {}
            db.root[r["r_name"]][r["n_name"]] = {"number": r["n_nationkey"]}
        for r in rows:
            at = db.root[r["r_name"]]
            if r["n_nationkey"] % 5 == 0:
                del at[r["n_name"]]
            else:
                at[r["n_name"]]["number"] = r["n_nationkey"] * 2
        tree = LogDB(f"{folder}/tree.jsonl").root.plain()
    return spark.createDataFrame([(k, n, v["number"]) for k, of in tree.items() for n, v in of.items()], "region string, nation string, number long")


_RUNS = "SELECT 'success' AS status, CAST((SELECT count(*) FROM {0}) AS VARCHAR) AS result, true AS ordered"


@query("run_records", " UNION ALL ".join(_RUNS.format(t) for t in ("nation", "supplier", "customer")) + " UNION ALL SELECT 'error', NULL, true UNION ALL SELECT 'lost', NULL, NULL")
def run_records(spark, sf_dir):
    """Runs of counting jobs, one that fails and one whose process is gone, as a later process finds them in the log."""
    from .jobs import CallableJob, Scheduler

    with tempfile.TemporaryDirectory() as folder:
        dictlog.DictLog(f"{folder}/runs.jsonl")["gone"] = {"status": "computing", "process": 0.0, "start_time": None, "end_time": None, "result": None}
        scheduler = Scheduler(f"{folder}/runs.jsonl", spark)
        tasks = [scheduler.submit(CallableJob(lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count())) for t in ("nation", "supplier", "customer", "no_such_table")]
        for t in tasks:
            t.wait()
        scheduler.close()
        found = Scheduler(f"{folder}/runs.jsonl", spark).runs(spark)
        return found.select("status", F.when(F.col("status") == "success", F.col("result")).alias("result"), (F.col("start_time") <= F.col("end_time")).alias("ordered"))


@query("registry_status", "SELECT * FROM (VALUES ('good', 'parquet', 'success', (SELECT count(*) FROM nation)), ('bad', 'parquet', 'error', 0), ('idle', 'parquet', 'created', 0)) v(id, kind, status, n_rows)")
def registry_status(spark, sf_dir):
    """Checkpoints of a registry: one computed, one whose producer fails, one never asked for; rows of what was published."""
    from .checkpoint import Registry

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")

    def fail():
        raise RuntimeError("no such data")

    with tempfile.TemporaryDirectory() as folder:
        registry = Registry(spark, _folder(spark, "registry"), f"{folder}/registry.jsonl")
        for id, f in (("good", lambda: nation), ("bad", fail), ("idle", lambda: nation)):
            registry.create("parquet", id, f)
        registry.compute("good")
        with contextlib.suppress(RuntimeError):
            registry.compute("bad")
        status = registry.status()
        n = [(id, c.load().count() if c.has_result() else 0) for id, c in registry.created.items()]
    return status.join(spark.createDataFrame(n, "id string, n_rows long"), "id").select("id", "kind", "status", "n_rows")


@query("checkpoint_roundtrip", ORACLES["welch_power"])
def checkpoint_roundtrip(spark, sf_dir):
    from .checkpoint import ParquetCheckpoint

    return ParquetCheckpoint(spark, _folder(spark, "welch"), lambda: welch_power(spark, sf_dir), dims=("channel", "f", "freq"), fs=FS).compute()
