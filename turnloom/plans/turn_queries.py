"""Queries over the event lanes: windows, late data, pairing and roll-ups. Each name has a plan and the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import critics
from turnloom.operators import handoff, lookup, metrics, pairing, turns, windows
from turnloom.sources.landmarks import face_rows, pose_rows
from turnloom.sources.lanes import SECOND_US, audio_clock, event_lanes, first_tracks, turn_ends
from turnloom.sources.staging import staged

W3, W16, STEP = 3 * SECOND_US, 16 * SECOND_US, 2 * SECOND_US
QUERIES: dict = {}
SQL: dict[str, str] = {}

EV = f"""WITH ev AS (
  SELECT user_id AS session_id, event_id AS seq, event_type AS kind, value, CAST(floor(value * 100) AS BIGINT) AS cents,
    epoch_us(ts) - first AS t_us,
    CASE WHEN event_type IN ('click', 'view') THEN 'frame' WHEN event_type IN ('purchase', 'signup') THEN 'audio' ELSE 'error' END AS lane
  FROM events JOIN (SELECT user_id, min(epoch_us(ts)) AS first FROM events GROUP BY user_id) USING (user_id)),
ends AS (SELECT session_id, max(t_us) AS end_us FROM ev GROUP BY session_id)
"""
GRID = f"""{EV}, nv AS (
  SELECT session_id, t_us // {W3} AS k, count(*) AS n, sum(cents)::BIGINT AS cents FROM ev WHERE lane = 'frame' GROUP BY ALL),
stt AS (
  SELECT session_id, t_us // {W3} AS k, count(*) AS n, min(seq) AS first_seq FROM ev WHERE lane = 'audio' GROUP BY ALL),
nvw AS (SELECT nv.* FROM nv JOIN ends USING (session_id) WHERE (k + 1) * {W3} <= end_us),
sttw AS (SELECT stt.* FROM stt JOIN ends USING (session_id) WHERE (k + 1) * {W3} <= end_us)
"""
FULL = f"""{EV}, wide AS (
  SELECT session_id, t_us // {W16} AS k, count(*) FILTER (lane = 'frame') AS n_frames, count(*) FILTER (lane = 'audio') AS n_audio,
    count(*) FILTER (lane = 'error') AS n_errors FROM ev GROUP BY ALL),
evals AS (
  SELECT session_id, k, n_frames, n_audio, n_errors = 0 AS ok FROM wide JOIN ends USING (session_id)
  WHERE n_frames > 0 AND n_audio > 0 AND (k + 1) * {W16} <= end_us),
covered AS (
  SELECT session_id, {W16} * coalesce(min(g) FILTER (NOT coalesce(ok, false)), any_value(n)) AS covered_us
  FROM (SELECT session_id, end_us // {W16} AS n, unnest(range(0, end_us // {W16} + 1)) AS g FROM ends) w
  LEFT JOIN (SELECT session_id, k AS g, ok FROM evals) USING (session_id, g) GROUP BY session_id)
"""
# Fixed states by the number of frames, as a stand-in for a model's reading.
STATE = "CASE " + " ".join(f"WHEN n % 7 = {i} THEN '{s}'" for i, s in enumerate(pairing.STATES)) + " END"


def query(sql: str | None = None):
    """Enter a plan under its name, with its SQL."""

    def enter(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return enter


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lanes = event_lanes(spark, sf_dir)
    return lanes, turn_ends(lanes)


def _lanes_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lanes and ends for plans of many branches: events are read once, for the starts of turns and for the rows, and never again."""
    lanes = staged(event_lanes(spark, sf_dir).drop("value"), "lanes")
    return lanes, staged(turn_ends(lanes), "ends")


def _readings(lanes: DataFrame, ends: DataFrame) -> DataFrame:
    """One reading a window with frames: session_id, k, n, state, intensity."""
    nv = windows.tumbling(lanes.where("lane = 'frame'"), ends, W3, F.sum("cents").alias("cents"))
    return nv.withColumns({"state": F.expr(STATE), "intensity": (F.col("cents") % 100) / 100.0})


def _texts(lanes: DataFrame, ends: DataFrame) -> DataFrame:
    stt = windows.tumbling(lanes.where("lane = 'audio'"), ends, W3, F.min("seq").alias("seq"))
    return stt.withColumn("text", F.concat(F.lit("w"), F.col("seq").cast("string")))


def _evals(lanes: DataFrame, ends: DataFrame) -> DataFrame:
    count = lambda lane: F.count_if(F.col("lane") == lane)
    wide = windows.tumbling(lanes, ends, W16, count("frame").alias("n_frames"), count("audio").alias("n_audio"), (count("error") == 0).alias("ok"))
    return wide.where("n_frames > 0 and n_audio > 0").drop("n")


def _covered(lanes: DataFrame, ends: DataFrame) -> DataFrame:
    done = _evals(lanes, ends).where("ok").select("session_id", (F.col("k") * W16).alias("start_us"), ((F.col("k") + 1) * W16).alias("end_us"))
    return windows.covered_prefix(done, ends)


@query(f"{GRID} SELECT session_id, k, n, cents FROM nvw")
def nv_tumbling(spark, sf_dir):
    lanes, ends = _lanes(spark, sf_dir)
    return windows.tumbling(lanes.where("lane = 'frame'"), ends, W3, F.sum("cents").alias("cents"))


@query(f"{GRID} SELECT session_id, k, n, first_seq FROM sttw")
def stt_tumbling(spark, sf_dir):
    lanes, ends = _lanes(spark, sf_dir)
    return windows.tumbling(lanes.where("lane = 'audio'"), ends, W3, F.min("seq").alias("first_seq"))


PAIRED = f"""{GRID} SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.k, b.k) AS k, a.state, a.intensity,
  coalesce(b.text, '') AS transcript, b.text IS NOT NULL AS transcript_final
FROM (SELECT session_id, k, {STATE} AS state, (cents % 100) / 100.0 AS intensity FROM nvw) a
FULL JOIN (SELECT session_id, k, 'w' || first_seq AS text FROM sttw) b ON a.session_id = b.session_id AND a.k = b.k"""


@query(PAIRED)
def turn_windows(spark, sf_dir):
    """Windows of both lanes paired: one record for each window that either lane has."""
    lanes, ends = _lanes(spark, sf_dir)
    return pairing.pair_windows(_readings(lanes, ends), _texts(lanes, ends))


@query(f"""{EV} SELECT session_id, start_us, end_us - start_us AS dur_us FROM (SELECT session_id, end_us, end_us // {W3} * {W3} AS start_us FROM ends)
WHERE end_us - start_us > {SECOND_US // 2}""")
def trailing_partial(spark, sf_dir):
    return windows.trailing_partial(_lanes(spark, sf_dir)[1], W3, SECOND_US // 2)


@query(f"{EV} SELECT session_id, unnest(range(0, end_us // {W3})) AS k FROM ends")
def window_enumeration(spark, sf_dir):
    return windows.all_windows(_lanes(spark, sf_dir)[1], W3)


@query(f"{FULL} SELECT session_id, k, n_frames, n_audio, ok FROM evals")
def eval_grid(spark, sf_dir):
    return _evals(*_lanes(spark, sf_dir))


@query(f"{FULL} SELECT session_id, covered_us FROM covered")
def covered_prefix(spark, sf_dir):
    return _covered(*_lanes(spark, sf_dir))


TAIL = f"""tail AS (SELECT session_id, covered_us AS start_us, end_us - covered_us AS dur_us FROM covered JOIN ends USING (session_id)
  WHERE end_us > covered_us AND (covered_us = 0 OR end_us - covered_us > {SECOND_US}))"""


@query(f"""{FULL}, {TAIL} SELECT t.session_id, start_us, dur_us, count(*) FILTER (lane = 'frame') AS n_frames, count(*) FILTER (lane = 'audio') AS n_audio
FROM tail t JOIN ev ON ev.session_id = t.session_id AND t_us >= start_us AND t_us < start_us + dur_us GROUP BY ALL
HAVING count(*) FILTER (lane = 'frame') > 0 AND count(*) FILTER (lane = 'audio') > 0""")
def compact_tail(spark, sf_dir):
    lanes, ends = _lanes_once(spark, sf_dir)
    tail = windows.compact_tail(_covered(lanes, ends), ends, SECOND_US)
    inside = windows.rows_in(tail, lanes.select("session_id", "t_us", "lane"), W16).groupBy("session_id", "start_us", "dur_us")
    counted = inside.agg(F.count_if(F.col("lane") == "frame").alias("n_frames"), F.count_if(F.col("lane") == "audio").alias("n_audio"))
    return counted.where("n_frames > 0 and n_audio > 0")


@query(f"""{GRID} SELECT session_id, string_agg('w' || first_seq, ' ' ORDER BY k) AS transcript FROM sttw GROUP BY session_id""")
def transcript_full(spark, sf_dir):
    return pairing.transcript(_texts(*_lanes(spark, sf_dir)))


@query(f"""{FULL}, nv AS (SELECT DISTINCT session_id, t_us // {W3} AS k FROM ev JOIN ends USING (session_id) WHERE lane = 'frame' AND (t_us // {W3} + 1) * {W3} <= end_us),
stt AS (SELECT DISTINCT session_id, t_us // {W3} AS k FROM ev JOIN ends USING (session_id) WHERE lane = 'audio' AND (t_us // {W3} + 1) * {W3} <= end_us),
u AS (SELECT 'eval' AS kind, session_id, k * {W16} + {W16 // 2} AS at_us FROM evals WHERE ok
  UNION ALL SELECT 'nonverbal', session_id, k * {W3} + {W3 // 2} FROM nv UNION ALL SELECT 'transcript', session_id, k * {W3} + {W3 // 2} FROM stt
  UNION ALL SELECT 'turn_end', session_id, end_us FROM ends)
SELECT session_id, kind, at_us, row_number() OVER (PARTITION BY session_id ORDER BY kind = 'turn_end', at_us, kind) AS number FROM u""")
def signal_union(spark, sf_dir):
    lanes, ends = _lanes_once(spark, sf_dir)
    centre = lambda df, w: df.select("session_id", (F.col("k") * w + w // 2).alias("at_us"))
    all_ = pairing.signals(
        eval=centre(_evals(lanes, ends).where("ok"), W16),
        nonverbal=centre(_readings(lanes, ends), W3),
        transcript=centre(_texts(lanes, ends), W3),
        turn_end=ends.select("session_id", F.col("end_us").alias("at_us")),
    )
    return pairing.ordered_records(all_, "at_us").select("session_id", "kind", "at_us", "number")


RATE_US = 2 * SECOND_US


@query(f"""{EV.replace('WITH', 'WITH RECURSIVE')}, f AS (SELECT DISTINCT session_id, t_us FROM ev WHERE lane = 'frame'),
kept AS (SELECT session_id, min(t_us) AS t_us FROM f GROUP BY session_id
  UNION ALL SELECT k.session_id, min(f.t_us) FROM kept k JOIN f ON f.session_id = k.session_id AND f.t_us + 1 >= k.t_us + {RATE_US} GROUP BY k.session_id)
SELECT session_id, t_us FROM kept""")
def rate_limit(spark, sf_dir):
    return windows.rate_limited(event_lanes(spark, sf_dir).where("lane = 'frame'").select("session_id", "t_us").distinct(), RATE_US)


@query(f"""{EV}, w AS (SELECT session_id, t_us // {W16} AS k, list(seq ORDER BY t_us, seq) AS frames FROM ev WHERE lane = 'frame' GROUP BY ALL)
SELECT session_id, k, CASE WHEN len(frames) > 3 THEN [frames[CAST(floor(i * (len(frames)::DOUBLE / 3)) AS INT) + 1] FOR i IN range(0, 3)] ELSE frames END AS frames,
  frames[greatest(len(frames) - 1, 1):] AS latest FROM w""")
def frame_cap(spark, sf_dir):
    frames = F.transform(F.array_sort(F.collect_list(F.struct("t_us", "seq"))), lambda x: x["seq"])
    by = event_lanes(spark, sf_dir).where("lane = 'frame'").withColumn("k", windows.window_number("t_us", W16)).groupBy("session_id", "k")
    return by.agg(frames.alias("all")).select("session_id", "k", windows.capped(F.col("all"), 3).alias("frames"), windows.latest(F.col("all"), 2).alias("latest"))


@query(f"""{EV} SELECT session_id, seq, coalesce(sum(cents) OVER (PARTITION BY session_id ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
FROM ev WHERE lane = 'audio'""")
def audio_clock_sum(spark, sf_dir):
    chunks = event_lanes(spark, sf_dir).where("lane = 'audio'").withColumn("at", F.struct("t_us", "seq"))
    return audio_clock(chunks, ["session_id"], "at", "cents", "begins").select("session_id", "seq", "begins")


@query("SELECT user_id AS session_id, event_type AS kind, min(event_id) AS seq FROM events GROUP BY ALL")
def track_dedup(spark, sf_dir):
    return first_tracks(event_lanes(spark, sf_dir), "session_id", "kind", "seq")


# Rows arrive up to four steps late, by their number.
ARRIVAL = f"t_us + seq * 7919 % 9 * {SECOND_US // 2}"
LATE = f"""{EV}, r AS (SELECT session_id, t_us // {W3} AS k, {ARRIVAL} AS arrival_us, end_us, lane FROM ev JOIN ends USING (session_id)
  WHERE (t_us // {W3} + 1) * {W3} <= end_us),
p AS (SELECT *, ((k + 1) * {W3} + {STEP - 1}) // {STEP} * {STEP} AS poll FROM r),
w AS (SELECT session_id, k, lane, end_us, least(poll, end_us) AS due, poll <= end_us AS polled, min(arrival_us) AS first
  FROM p GROUP BY ALL),
s AS (SELECT *, CASE WHEN first <= due THEN due WHEN lane = 'frame' AND polled AND first <= end_us
  THEN least((first + {STEP - 1}) // {STEP} * {STEP}, end_us) END AS at_us FROM w)
SELECT s.session_id, s.k, s.at_us, count(*) AS n FROM s JOIN p USING (session_id, k, lane)
WHERE at_us IS NOT NULL AND arrival_us <= at_us AND lane = '{{lane}}' GROUP BY ALL"""


def _late(spark, sf_dir, lane: str, catch_up: bool) -> DataFrame:
    lanes, ends = _lanes(spark, sf_dir)
    rows = lanes.where(F.col("lane") == lane).withColumn("arrival_us", F.expr(ARRIVAL))
    return windows.late_replay(rows, ends, W3, STEP, catch_up)


@query(LATE.replace("{lane}", "frame"))
def late_catch_up(spark, sf_dir):
    return _late(spark, sf_dir, "frame", True)


@query(LATE.replace("{lane}", "audio"))
def late_audio_drop(spark, sf_dir):
    return _late(spark, sf_dir, "audio", False)


@query(f"""{EV.replace('WITH', 'WITH RECURSIVE')}, b AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t_us, seq) AS i, 1 + seq % 3 AS n, t_us AS e FROM ev WHERE lane <> 'error'),
f AS (SELECT session_id, 0::BIGINT AS i, 0::BIGINT AS anchor, 0::BIGINT AS pending, NULL::BIGINT AS start_us, NULL::BIGINT AS end_us FROM (SELECT DISTINCT session_id FROM b)
  UNION ALL SELECT session_id, i, CASE WHEN hit THEN e ELSE anchor END, CASE WHEN hit THEN 0 ELSE pending END, CASE WHEN hit THEN anchor END, CASE WHEN hit THEN e END
  FROM (SELECT b.session_id, b.i, f.anchor, f.pending + b.n AS pending, b.e, b.e > f.anchor AND (f.pending + b.n >= 4 OR b.e - f.anchor >= {15 * SECOND_US}) AS hit
    FROM f JOIN b ON b.session_id = f.session_id AND b.i = f.i + 1))
SELECT session_id, start_us, end_us FROM f WHERE start_us IS NOT NULL""")
def count_span_trigger(spark, sf_dir):
    rows = event_lanes(spark, sf_dir).where("lane <> 'error'")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("t_us", "seq"))
    batches = rows.select("session_id", number.alias("seq"), (F.col("seq") % 3 + 1).alias("n"), F.col("t_us").alias("last_end_us"))
    return windows.count_or_span(batches, 4, 15 * SECOND_US)


@query(f"""{EV}, b AS (SELECT session_id, seq, t_us FROM ev WHERE lane = 'error'), p AS (SELECT DISTINCT session_id, t_us AS p_us FROM ev WHERE kind = 'signup'),
j AS (SELECT b.session_id, b.seq, arg_min(p_us, abs(p_us - t_us) * 2 + (p_us > t_us)::INT) AS p_us FROM b JOIN p ON b.session_id = p.session_id AND abs(p_us - t_us) <= {W3} GROUP BY ALL)
SELECT b.session_id, b.seq, t_us, coalesce(p_us, t_us) AS snap_us FROM b LEFT JOIN j USING (session_id, seq)""")
def snap_nearest(spark, sf_dir):
    lanes = event_lanes(spark, sf_dir)
    pauses = lanes.where("kind = 'signup'").select("session_id", "t_us")
    return windows.snapped(lanes.where("lane = 'error'").select("session_id", "seq", "t_us"), pauses, W3)


@query(f"""{EV} SELECT i.session_id, i.seq, count(*) AS n, sum(r.cents)::BIGINT AS cents FROM ev i JOIN ev r ON r.session_id = i.session_id AND r.lane = 'frame'
AND r.t_us >= i.t_us AND r.t_us < i.t_us + {5 * SECOND_US // 2} WHERE i.lane = 'audio' GROUP BY ALL""")
def range_slice(spark, sf_dir):
    lanes = event_lanes(spark, sf_dir)
    intervals = lanes.where("lane = 'audio'").select("session_id", "seq", F.col("t_us").alias("start_us"), F.lit(5 * SECOND_US // 2).alias("dur_us"))
    inside = windows.rows_in(intervals, lanes.where("lane = 'frame'").select("session_id", "t_us", "cents"), W3)
    return inside.groupBy("session_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


# The values of a session as measures of windows of a media minute.
W60 = 60 * SECOND_US
AT = 50.0


def _series(spark, sf_dir) -> DataFrame:
    rows = event_lanes(spark, sf_dir).withColumn("k", windows.window_number("t_us", W60)).withColumn("at", F.struct("t_us", "seq"))
    return rows


@query(f"""{EV}, s AS (SELECT session_id, t_us // {W60} AS k, value, lag(value, 1, 0.0) OVER (PARTITION BY session_id, t_us // {W60} ORDER BY t_us, seq) AS before FROM ev)
SELECT session_id, k, sum((before < {AT} AND value >= {AT})::INT)::BIGINT AS crossings FROM s GROUP BY ALL""")
def blink_crossings(spark, sf_dir):
    return metrics.crossings(_series(spark, sf_dir), ["session_id", "k"], "at", "value", AT)


@query(f"""{EV} SELECT session_id, t_us // {W60} AS k, count(*) AS face_frames, count(*) FILTER (lane <> 'error') AS seen, max(cents) FILTER (lane <> 'error') AS smile_max,
round(avg(cents) FILTER (lane <> 'error'), 4) AS smile_mean, round(stddev_pop(value) FILTER (lane <> 'error'), 4) AS yaw_std_deg FROM ev GROUP BY ALL""")
def smile_stats(spark, sf_dir):
    zero = F.lit(0.0)
    rows = _series(spark, sf_dir).withColumns({"face": F.col("lane") != "error", "smile": F.col("cents"), "brow_down": zero, "press": zero, "gaze_off": zero, "yaw": F.col("value"), "pitch": zero})
    m = metrics.face_measures(rows, ["session_id", "k"])
    seen = F.round(F.col("face_frames") * F.col("face_seen_ratio")).cast("long")
    return m.select("session_id", "k", "face_frames", seen.alias("seen"), "smile_max", F.round("smile_mean", 4).alias("smile_mean"), F.round("yaw_std_deg", 4).alias("yaw_std_deg"))


@query(f"""{EV}, c AS (SELECT session_id, t_us, seq, (cents // 100) % 2 AS c FROM ev),
n AS (SELECT *, list_sort(list(c) OVER (PARTITION BY session_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS near FROM c),
m AS (SELECT *, CAST(trunc((near[(len(near) - 1) // 2 + 1] + near[len(near) // 2 + 1]) / 2.0) AS INT) AS v FROM n),
e AS (SELECT *, CASE WHEN v = lag(v) OVER o THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY session_id ORDER BY t_us, seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t_us, seq) AS run FROM e),
k AS (SELECT session_id, run, any_value(v) AS v, min(t_us) AS a, max(t_us) AS b FROM r GROUP BY ALL HAVING max(t_us) - min(t_us) >= {W3}),
g AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY session_id ORDER BY a) THEN 0 ELSE 1 END AS new FROM k),
h AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY a) AS grp FROM g)
SELECT session_id, any_value(v) AS count, min(a) AS start_t, max(b) AS end_t FROM h GROUP BY session_id, grp""")
def run_segments(spark, sf_dir):
    rows = event_lanes(spark, sf_dir).withColumn("c", (F.floor(F.col("cents") / 100) % 2).cast("int"))
    return metrics.stable_segments(rows, ["session_id"], "t_us", "c", W3, ("seq",))


@query(f"""{EV}, f AS (SELECT session_id, t_us // {W60} AS k, quantile_cont(value, 0.4) AS floor, count(*) AS frames FROM ev GROUP BY ALL),
l AS (SELECT ev.session_id, f.k, frames, value, t_us, row_number() OVER w AS i, count(*) OVER (PARTITION BY ev.session_id, f.k) AS n
  FROM ev JOIN f ON ev.session_id = f.session_id AND t_us // {W60} = f.k WHERE value > floor WINDOW w AS (PARTITION BY ev.session_id, f.k ORDER BY t_us, seq))
SELECT session_id, k, count(*) AS loud_frames, CASE WHEN ok THEN round(regr_slope(value, t_us / {SECOND_US}.0), 4) END AS slope,
  CASE WHEN ok THEN round(quantile_cont(value, 0.5) FILTER (i > n // 2) - quantile_cont(value, 0.5) FILTER (i <= n // 2), 4) END AS half_to_half, CASE WHEN ok THEN round(min(value), 4) END AS trough
FROM (SELECT *, frames >= 8 AND n >= 4 AS ok FROM l) GROUP BY session_id, k, ok""")
def energy_trend(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("s", F.col("t_us") / float(SECOND_US))
    m = metrics.energy_trend(rows, ["session_id", "k"], "s", "value", ("seq",))
    return m.select("session_id", "k", "loud_frames", *(F.round(c, 4).alias(c) for c in ("slope", "half_to_half", "trough")))


def _quiet_sql(leading: bool) -> str:
    return f"""{EV}, q AS (SELECT *, value < {AT} AS quiet FROM ev),
m AS (SELECT *, sum((NOT quiet)::INT) OVER (PARTITION BY session_id ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS b, sum((NOT quiet)::INT) OVER (PARTITION BY session_id) AS total FROM q)
SELECT session_id, min(t_us) AS start_t, count(*) AS frames FROM m WHERE quiet AND b < total {"" if leading else "AND b > 0"} GROUP BY session_id, b"""


def _quiet(spark, sf_dir, leading: bool) -> DataFrame:
    rows = event_lanes(spark, sf_dir).withColumn("at", F.struct("t_us", "seq"))
    runs = metrics.quiet_runs(rows, ["session_id"], "at", F.col("value") < AT, leading)
    return runs.select("session_id", F.col("start_t.t_us").alias("start_t"), "frames")


@query(_quiet_sql(False))
def silence_runs(spark, sf_dir):
    return _quiet(spark, sf_dir, False)


@query(_quiet_sql(True))
def silence_positions(spark, sf_dir):
    return _quiet(spark, sf_dir, True)


# Vocal and visual measures of windows, made up from the events in them.
VOCAL = f"""{EV}, v AS (SELECT session_id, t_us // {W16} AS k, count(*)::DOUBLE AS duration_s, count(*) FILTER (lane = 'frame') AS voiced_frames,
  sum(cents)::BIGINT AS cents, max(cents) AS top, count(*) FILTER (lane = 'audio') AS pause_count FROM ev GROUP BY ALL)"""


def _vocal(lanes: DataFrame, width: int = W16) -> DataFrame:
    by = lanes.withColumn("k", windows.window_number("t_us", width)).groupBy("session_id", "k")
    count = lambda lane: F.count_if(F.col("lane") == lane)
    v = by.agg(F.count(F.lit(1)).cast("double").alias("duration_s"), count("frame").alias("voiced_frames"), F.sum("cents").alias("cents"), F.max("cents").alias("top"), count("audio").alias("pause_count"))
    number = lambda m: F.when(F.col("voiced_frames") > 1, (F.col("cents") % m).cast("double"))
    return v.withColumns(
        {
            "voiced_ratio": F.col("voiced_frames") / F.col("duration_s"), "mean_hz": number(211), "sd_semitone": number(7), "pdq": number(3), "range_st_10_90": number(13),
            "detrended_sd_semitone": number(5), "octave_error_frac": number(2), "syllable_nuclei": F.col("cents") % 17, "intensity_peak_nuclei": F.col("cents") % 19,
            "phonation_s": F.when(F.col("cents") % 4 != 0, F.col("duration_s")), "articulation_rate": (F.col("cents") % 17) / F.lit(2.0), "juncture_count": F.col("cents") % 3,
            "juncture_median_s": F.when(F.col("cents") % 2 == 0, (F.col("cents") % 11).cast("double")), "longest_pauses_s": F.array(F.col("top").cast("double"), (F.col("cents") % 97).cast("double")),
            "rel_db_slope_per_s": (F.col("cents") % 23).cast("double"), "half_to_half_delta_db": F.when(F.col("cents") % 5 != 0, (F.col("cents") % 9 - 4).cast("double")), "sounding_trough_db": -F.col("top").cast("double"),
        }
    )


def _mean_sql(value: str, weight: str, digits: int = 4) -> str:
    return f"round(sum(({value}) * ({weight})) FILTER (({value}) IS NOT NULL AND ({weight}) <> 0) / nullif(sum({weight}) FILTER (({value}) IS NOT NULL AND ({weight}) <> 0), 0), {digits})"


@query(f"""{VOCAL}, m AS (SELECT *, CASE WHEN voiced_frames > 1 THEN (cents % 7)::DOUBLE END AS sd, CASE WHEN voiced_frames > 1 THEN (cents % 211)::DOUBLE END AS hz,
  voiced_frames / duration_s AS vr, CASE WHEN cents % 4 <> 0 THEN duration_s WHEN cents % 17 > 0 THEN 2.0 END AS phon, CASE WHEN cents % 2 = 0 THEN (cents % 11)::DOUBLE END AS med,
  CASE WHEN cents % 5 <> 0 THEN (cents % 9 - 4)::DOUBLE END AS delta FROM v)
SELECT session_id, count(*) AS windows, sum(duration_s) AS duration_s, (sum(voiced_frames) FILTER (sd IS NOT NULL))::BIGINT AS voiced_frames, {_mean_sql('sd', 'voiced_frames')} AS sd_semitone,
  {_mean_sql('hz', 'voiced_frames')} AS mean_hz, CASE WHEN count(sd) > 0 THEN {_mean_sql('CASE WHEN sd IS NOT NULL THEN vr END', 'duration_s')} ELSE {_mean_sql('vr', 'duration_s')} END AS voiced_ratio,
  sum(cents % 17)::BIGINT AS syllable_nuclei, round(sum(cents % 17) / nullif(sum(duration_s), 0), 4) AS speech_rate, round(sum(cents % 17) / nullif(sum(phon), 0), 4) AS articulation_rate,
  sum(pause_count)::BIGINT AS pause_count, {_mean_sql('med', 'pause_count + cents % 3')} AS juncture_median_s, {_mean_sql('delta', 'duration_s')} AS half_to_half_delta_db,
  min(-top::DOUBLE) FILTER (delta IS NOT NULL) AS sounding_trough_db FROM m GROUP BY session_id""")
def vocal_rollup(spark, sf_dir):
    r = handoff.vocal_rollup(_vocal(event_lanes(spark, sf_dir)), ["session_id"])
    rounded = ("sd_semitone", "mean_hz", "voiced_ratio", "speech_rate", "articulation_rate", "juncture_median_s", "half_to_half_delta_db")
    return r.select("session_id", "windows", "duration_s", "voiced_frames", "syllable_nuclei", "pause_count", "sounding_trough_db", *(F.round(c, 4).alias(c) for c in rounded))


@query(f"""{VOCAL}, p AS (SELECT session_id, unnest([top::DOUBLE, (cents % 97)::DOUBLE]) AS x FROM v)
SELECT session_id, list(x ORDER BY x DESC)[1:5] AS longest FROM p GROUP BY session_id""")
def longest_topk(spark, sf_dir):
    return _vocal(event_lanes(spark, sf_dir)).groupBy("session_id").agg(handoff.longest(F.col("longest_pauses_s")).alias("longest"))


@query(f"""{EV}, w AS (SELECT session_id, t_us // {W16} AS k, count(*) AS face_frames, count(*) FILTER (lane <> 'error') / count(*)::DOUBLE AS ratio, sum(cents)::BIGINT AS cents FROM ev GROUP BY ALL),
d AS (SELECT *, face_frames * ratio AS det FROM w)
SELECT session_id, sum(face_frames)::BIGINT AS face_frames, round(sum(det) / sum(face_frames), 4) AS face_seen_ratio, {_mean_sql('(cents % 100)::DOUBLE', 'det')} AS smile_mean,
  (sum(cents % 6) FILTER (det > 0))::BIGINT AS blink_count, max(cents % 100) FILTER (det > 0) AS smile_max FROM d GROUP BY session_id""")
def visual_rollup(spark, sf_dir):
    by = event_lanes(spark, sf_dir).withColumn("k", windows.window_number("t_us", W16)).groupBy("session_id", "k")
    w = by.agg(F.count(F.lit(1)).alias("face_frames"), F.avg((F.col("lane") != "error").cast("double")).alias("face_seen_ratio"), F.sum("cents").alias("cents"))
    w = w.withColumns({"smile_mean": (F.col("cents") % 100).cast("double"), "blink_count": F.col("cents") % 6, "smile_max": F.col("cents") % 100})
    r = handoff.lane_rollup(w, ["session_id"], "face_frames", "face_seen_ratio", ["smile_mean"], ["blink_count"], ["smile_max"])
    return r.withColumns({c: F.round(c, 4) for c in ("face_seen_ratio", "smile_mean")})


@query(f"""{GRID}, s AS (SELECT session_id, k, {STATE} AS state FROM nvw), c AS (SELECT session_id, state, count(*) AS n, min(k) AS first FROM s GROUP BY ALL)
SELECT session_id, state, n, n / sum(n) OVER (PARTITION BY session_id) AS share, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS place FROM c""")
def state_shares(spark, sf_dir):
    return handoff.state_shares(_readings(*_lanes(spark, sf_dir)), ["session_id"], "k")


@query(f"""{GRID}, s AS (SELECT session_id, k, 'n' || k AS note FROM nvw WHERE n > 1)
SELECT session_id, list(note ORDER BY k)[greatest(len(list(note ORDER BY k)) - 2, 1):] AS notes FROM s GROUP BY session_id""")
def last_notes(spark, sf_dir):
    notes = F.when(F.col("n") > 1, F.concat(F.lit("n"), F.col("k").cast("string"))).otherwise("")
    return handoff.last_notes(_readings(*_lanes(spark, sf_dir)).withColumn("note", notes), ["session_id"], "k")


HIGH = f"""{GRID}, s AS (SELECT session_id, k AS start_s, cents % 9 - 4 AS e, n AS p, {STATE} AS state, (cents % 100) / 100.0 AS i, CASE WHEN cents % 3 > 0 THEN cents % 8 END AS a FROM nvw),
c AS (SELECT *, coalesce((abs(e) >= 2)::INT, 0) + coalesce((p >= 2)::INT, 0) + coalesce((state <> 'neutral' OR i >= 0.5)::INT, 0) + coalesce((abs(a - avg(a) OVER (PARTITION BY session_id)) > 1.0)::INT, 0) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, start_s) AS place FROM c WHERE score > 0)"""


def _sentences(lanes: DataFrame, ends: DataFrame) -> DataFrame:
    nv = _readings(lanes, ends)
    return nv.select(
        "session_id", F.col("k").alias("start_s"), (F.col("cents") % 9 - 4).alias("energy_delta_db"), F.col("n").alias("pause_count"), "state", "intensity",
        F.when(F.col("cents") % 3 > 0, F.col("cents") % 8).alias("articulation_rate"), F.col("cents").alias("smile"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("text"),
    )


@query(f"{HIGH} SELECT session_id, start_s, score, place FROM r WHERE place <= 3")
def highlights_top3(spark, sf_dir):
    return handoff.highlights(_sentences(*_lanes(spark, sf_dir)), ["session_id"]).select("session_id", "start_s", "score", "place")


def _handoff(spark, sf_dir) -> DataFrame:
    lanes, ends = _lanes_once(spark, sf_dir)
    readings = _readings(lanes, ends)
    noted = readings.withColumn("note", F.when(F.col("n") > 1, F.concat(F.lit("n"), F.col("k").cast("string"))).otherwise(""))
    w = lanes.withColumn("k", windows.window_number("t_us", W16)).groupBy("session_id", "k").agg(
        F.count(F.lit(1)).alias("face_frames"), F.avg((F.col("lane") != "error").cast("double")).alias("face_seen_ratio"), (F.sum("cents") % 100).cast("double").alias("smile_mean")
    )
    visual = handoff.lane_rollup(w, ["session_id"], "face_frames", "face_seen_ratio", ["smile_mean"])
    speech = handoff.vocal_rollup(_vocal(lanes), ["session_id"])
    return handoff.turn_handoff(
        ends, pairing.transcript(_texts(lanes, ends)), _sentences(lanes, ends), speech, visual, handoff.state_shares(readings, ["session_id"], "k"), handoff.last_notes(noted, ["session_id"], "k")
    )


@query(f"""{HIGH}, t AS (SELECT session_id, string_agg('w' || first_seq, ' ' ORDER BY k) AS transcript FROM sttw GROUP BY 1),
x AS (SELECT session_id, count(*) AS sentences, count(a) AS with_speech FROM c GROUP BY 1), h AS (SELECT session_id, sum(score)::BIGINT AS highlight_points FROM r WHERE place <= 3 GROUP BY 1),
w AS (SELECT session_id, count(DISTINCT t_us // {W16}) AS speech_windows, count(*) AS face_frames FROM ev GROUP BY 1)
SELECT session_id, end_us, 2 AS schema_version, coalesce(transcript, '') AS transcript, length(coalesce(transcript, '')) AS transcript_chars, speech_windows, face_frames, sentences, with_speech, highlight_points
FROM ends LEFT JOIN t USING (session_id) LEFT JOIN x USING (session_id) LEFT JOIN h USING (session_id) LEFT JOIN w USING (session_id)""")
def turn_handoff(spark, sf_dir):
    h = _handoff(spark, sf_dir)
    points = F.aggregate("highlights", F.lit(0).cast("long"), lambda s, x: s + x["score"])
    return h.select(
        "session_id", "end_us", "schema_version", "transcript", "transcript_chars", F.col("speech.windows").alias("speech_windows"), F.col("visual.face_frames").alias("face_frames"),
        "sentences", "with_speech", points.alias("highlight_points"),
    )


FACE_STATE = "CASE WHEN cents % 5 <> 0 THEN true ELSE false END"
CHAIN = f"""{EV}, r AS (SELECT session_id, seq, t_us, cents, t_us // {W60} AS k, {FACE_STATE} AS face, cents % 4 <> 0 AS pose, cents % 3 AS hands, cents // 100 % 2 AS fingers FROM ev WHERE lane <> 'error'),
f AS (SELECT *, lag(blink, 1, 0.0) OVER w AS before, lag(x) OVER w AS px FROM (SELECT *, (cents % 7) / 6.0 AS blink, (seq % 10) / 10.0 AS x FROM r WHERE face) WINDOW w AS (PARTITION BY session_id, k ORDER BY t_us)),
fw AS (SELECT session_id, k, count(*) AS seen, avg((cents % 100) / 100.0) AS smile_mean, max((cents % 100) / 100.0) AS smile_max, avg((cents % 11) / 10.0) AS gaze_off, stddev_pop(degrees(atan2((cents % 3)::DOUBLE, 5.0))) AS yaw,
  count(*) FILTER (before < 0.5 AND blink >= 0.5) AS blinks, coalesce(avg(abs(x - px)), 0) AS lips FROM f GROUP BY ALL),
p AS (SELECT *, lag(cents) OVER w AS pc, lag(seq) OVER w AS ps FROM r WHERE pose WINDOW w AS (PARTITION BY session_id, k ORDER BY t_us)),
pm AS (SELECT session_id, k, avg(1 + cents % 3) AS scale, count(*) AS seen FROM p GROUP BY ALL),
pw AS (SELECT session_id, k, CASE WHEN seen >= 2 THEN stddev_pop((1 + cents % 3) / 2.0) / 2 / scale END AS posture_std,
  CASE WHEN seen >= 2 THEN coalesce(avg(CASE WHEN seq % 2 = 1 AND ps % 2 = 1 THEN sqrt(power(cents % 11 - pc % 11, 2) + power(cents % 13 - pc % 13, 2)) / scale END), 0) END AS wrist_motion,
  CASE WHEN seen >= 2 THEN count(*) FILTER (seq % 2 = 1 AND ps % 2 = 1 AND sqrt(power(cents % 11 - pc % 11, 2) + power(cents % 13 - pc % 13, 2)) / scale > 0.15) END AS gestures
  FROM p JOIN pm USING (session_id, k) GROUP BY session_id, k, seen, scale),
n AS (SELECT session_id, k, count(*) AS frames, round(count(*) FILTER (face) / count(*)::DOUBLE, 12) AS fr, count(*) FILTER (pose) / count(*)::DOUBLE AS pr, count(*) FILTER (hands > 0) / count(*)::DOUBLE AS hr FROM r GROUP BY ALL),
h AS (SELECT session_id, k, t_us, fingers AS c FROM r WHERE hands > 0),
m1 AS (SELECT *, list_sort(list(c) OVER (PARTITION BY session_id, k ORDER BY t_us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS near FROM h),
m2 AS (SELECT *, CAST(trunc((near[(len(near) - 1) // 2 + 1] + near[len(near) // 2 + 1]) / 2.0) AS INT) AS v FROM m1),
m3 AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY session_id, k ORDER BY t_us) THEN 0 ELSE 1 END AS new FROM m2),
m4 AS (SELECT *, sum(new) OVER (PARTITION BY session_id, k ORDER BY t_us) AS run FROM m3),
m5 AS (SELECT session_id, run, k, any_value(v) AS v, min(t_us) AS a FROM m4 GROUP BY ALL HAVING max(t_us) - min(t_us) >= {W3}),
m6 AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY session_id ORDER BY a) THEN 0 ELSE 1 END AS new FROM m5),
seqs AS (SELECT session_id, list(v ORDER BY a) FILTER (v > 0) AS finger_sequence FROM m6 WHERE new = 1 GROUP BY 1)
SELECT session_id, sum(frames)::BIGINT AS face_frames, round(sum(frames * fr) / sum(frames), 6) AS face_seen_ratio, {{face}}, sum(blinks)::BIGINT AS blink_count, max(smile_max) AS smile_max,
  round(sum(frames * pr) / sum(frames), 6) AS pose_seen_ratio, {{pose}}, sum(gestures)::BIGINT AS gesture_events, round(sum(frames * hr) / sum(frames), 6) AS hand_seen_ratio,
  any_value(coalesce(finger_sequence, CASE WHEN s.session_id IS NOT NULL THEN []::INT[] END)) AS finger_sequence
FROM n LEFT JOIN fw USING (session_id, k) LEFT JOIN pw USING (session_id, k) LEFT JOIN seqs s USING (session_id) GROUP BY session_id"""
_FACE_MEANS = {"smile_mean": "smile_mean", "gaze_off_mean": "gaze_off", "yaw_std_deg": "yaw", "lip_motion": "lips"}
_POSE_MEANS = {"posture_std": "posture_std", "wrist_motion": "wrist_motion"}


@query(
    CHAIN.format(
        face=", ".join(f"{_mean_sql(c, 'frames * fr', 6)} AS {n}" for n, c in _FACE_MEANS.items()), pose=", ".join(f"{_mean_sql(c, 'frames * pr', 6)} AS {n}" for n, c in _POSE_MEANS.items())
    )
)
def visual_chain(spark, sf_dir):
    """From what detectors give for each frame to a turn: rows of the lanes, measures of windows, all lanes merged, the roll-up."""
    lanes = event_lanes(spark, sf_dir).where("lane != 'error'").withColumn("k", windows.window_number("t_us", W60))
    rows = staged(lanes.select("session_id", "seq", "t_us", "cents", "k"), "frames")
    c, keys = F.col("cents"), ["session_id", "k"]
    part = lambda m, d: (c % m) / F.lit(float(d))
    shapes = {f"{n}{side}": part(m, d) for n, m, d in (("mouthSmile", 100, 100), ("browDown", 3, 2), ("mouthPress", 3, 2), ("eyeBlink", 7, 6)) for side in ("Left", "Right")}
    shapes |= {"eyeLookOutLeft": part(11, 10), "eyeLookUpLeft": part(11, 20)}
    blend = F.when(c % 5 != 0, F.create_map(*(x for n, v in shapes.items() for x in (F.lit(n), v))))
    turn = F.array(F.lit(5.0), *[F.lit(0.0)] * 2, (c % 3).cast("double"), *[F.lit(0.0)] * 5)
    spot = F.array((F.col("seq") % 10) / F.lit(10.0), F.lit(0.5))
    faces = face_rows(rows.withColumns({"blendshapes": blend, "matrix": turn, "points": F.array_repeat(spot, 300)}))
    point = lambda x, y, v=1.0: F.array(*(F.lit(z).cast("double") if not isinstance(z, type(c)) else z.cast("double") for z in (x, y, v)))
    wrist = point(c % 11, c % 13, F.col("seq") % 2)
    body = [point(0, 0)] * 11 + [point(0, 0), point(1 + c % 3, 0)] + [point(0, 0)] * 2 + [wrist, wrist]
    poses = pose_rows(rows.withColumn("points", F.when(c % 4 != 0, F.array(*body))))
    hands = rows.withColumns({"hands": (c % 3).cast("int"), "fingers": (F.floor(c / 100) % 2).cast("int")})
    merged = metrics.window_measures(metrics.face_window(faces, keys, "t_us"), metrics.pose_measures(poses, keys, "t_us"), keys, metrics.hand_measures(hands, keys, "t_us", W3))
    r = handoff.visual_rollup(merged, ["session_id"])
    rounded = ("face_seen_ratio", *_FACE_MEANS, "pose_seen_ratio", *_POSE_MEANS, "hand_seen_ratio")
    return r.select("session_id", "face_frames", "blink_count", "smile_max", "gesture_events", "finger_sequence", *(F.round(x, 6).alias(x) for x in rounded))


# Records of turns: every third session has sentences, half of the turns end without a transcript, the sentences of some have no reading.
def _records(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Turn ends, sentences, evaluations and windows as turn_documents takes them."""
    lanes, ends = _lanes_once(spark, sf_dir)
    sides = lambda width: _vocal(lanes, width).select(
        "session_id", "k", "cents", F.col("voiced_frames").alias("n"), F.struct(*(f for f in _vocal(lanes).columns if f not in ("session_id", "k", "cents", "top"))).alias("speech"),
        F.struct(
            F.col("duration_s").cast("long").alias("face_frames"), F.lit(1.0).alias("face_seen_ratio"), (F.col("cents") % 100 / 100.0).alias("smile_mean"), F.col("cents").alias("smile_max"),
            (F.col("cents") % 3).alias("blink_count"), (F.col("cents") % 10 / 10.0).alias("gaze_off_mean"), F.col("duration_s").cast("long").alias("pose_frames"), F.lit(1.0).alias("pose_seen_ratio"),
            *(F.lit(0.1).alias(x) for x in (*handoff.FACE, *handoff.POSE) if x not in ("smile_mean", "gaze_off_mean")), (F.col("cents") % 2).alias("gesture_events"),
        ).alias("visual"),
    )
    reading = F.struct(F.expr(STATE).alias("state"), (F.col("cents") % 100 / 100.0).alias("intensity"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("note"))
    start = F.col("k") * 3.0
    said = sides(W3).where("session_id % 3 = 0").select(
        "session_id", start.alias("start_s"), (start + 3.0).alias("end_s"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("text"), "speech", "visual",
        F.when((F.col("session_id") % 2 == 0) & (F.col("n") > 0), reading).alias("nonverbal"),
    )
    evals = sides(W16).select("session_id", (F.col("k") * 16.0).alias("start_s"), "speech", "visual")
    heard = _texts(lanes, ends).select("session_id", "k", "text")
    both = _readings(lanes, ends).select("session_id", "k", reading.alias("nonverbal")).join(heard, ["session_id", "k"], "full_outer")
    shown = both.select("session_id", start.alias("start_s"), F.coalesce("text", F.lit("")).alias("transcript"), "nonverbal")
    full = F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("turn "), F.col("session_id").cast("string"))).otherwise("")
    return ends.select("session_id", F.col("end_us").alias("t"), full.alias("transcript_full")), said, evals, shown


@query(f"""{GRID}, v AS (SELECT session_id, w, t_us // w AS k, count(*)::DOUBLE AS duration_s, count(*) FILTER (lane = 'frame') AS n, sum(cents)::BIGINT AS cents
  FROM ev, (SELECT unnest([{W3}, {W16}]) AS w) GROUP BY ALL),
m AS (SELECT * FROM v WHERE w = CASE WHEN session_id % 3 = 0 THEN {W3} ELSE {W16} END),
r AS (SELECT session_id, k, n, cents, {STATE} AS state FROM v WHERE w = {W3} AND session_id % 6 = 0 AND n > 0
  UNION ALL SELECT session_id, k, n, cents, {STATE} FROM nvw WHERE session_id NOT IN (SELECT session_id FROM v WHERE w = {W3} AND session_id % 6 = 0 AND n > 0)),
st AS (SELECT session_id, state, count(*) AS c, min(k) AS first FROM r GROUP BY ALL),
told AS (SELECT session_id, count(*) AS readings, ((2 * sum(cents % 100) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS intensity_mean, list('n' || k ORDER BY k)[-3:] AS notes FROM r GROUP BY 1),
tx AS (SELECT session_id, string_agg('w' || first_seq, ' ' ORDER BY k) AS spoken FROM sttw GROUP BY 1),
sp AS (SELECT session_id, count(*) AS speech_windows, sum(cents % 17)::BIGINT AS syllable_nuclei, round(sum(cents % 17) / nullif(sum(CASE WHEN cents % 4 <> 0 THEN duration_s WHEN cents % 17 > 0 THEN 2.0 END), 0), 9) AS articulation_rate,
  sum(duration_s)::BIGINT AS face_frames, round(sum(cents % 100 / 100.0 * duration_s) / sum(duration_s), 9) AS smile_mean, count(*) FILTER (session_id % 3 = 0) AS sentences FROM m GROUP BY 1)
SELECT session_id, end_us AS t, CASE WHEN session_id % 2 = 0 THEN 'turn ' || session_id ELSE coalesce(spoken, '') END AS transcript, sentences, speech_windows, syllable_nuclei, articulation_rate, face_frames, smile_mean,
  readings, intensity_mean, notes, list_transform(list_sort(sts), lambda x: x.state) AS states
FROM ends LEFT JOIN sp USING (session_id) LEFT JOIN tx USING (session_id) LEFT JOIN told USING (session_id)
LEFT JOIN (SELECT session_id, list({{'c': -c, 'first': first, 'state': state}}) AS sts FROM st GROUP BY 1) USING (session_id)""")
def turn_document(spark, sf_dir):
    """The hand-off document of each turn from its records, with every fallback in use."""
    d = handoff.turn_documents(*_records(spark, sf_dir))
    return d.select(
        "session_id", "t", "transcript", F.col("sentences").cast("long").alias("sentences"), F.col("speech.windows").alias("speech_windows"), F.col("speech.syllable_nuclei").alias("syllable_nuclei"),
        F.round("speech.articulation_rate", 9).alias("articulation_rate"), F.col("visual.face_frames").alias("face_frames"), F.round("visual.smile_mean", 9).alias("smile_mean"),
        F.col("nonverbal.windows").alias("readings"), F.col("nonverbal.intensity_mean").alias("intensity_mean"), F.col("nonverbal.notes").alias("notes"),
        F.transform("nonverbal.states", lambda x: x["state"]).alias("states"),
    )


@query()
def handoff_prompt(spark, sf_dir):
    """The lines that tell a reader of each turn, and the one line that does."""
    return handoff.turn_documents(*_records(spark, sf_dir)).select("session_id", F.array_join("prompt_block", "\n").alias("prompt_block"), "prompt")


@query(f"""{GRID}, t AS (SELECT session_id, list('w' || first_seq ORDER BY k) AS window_transcripts, string_agg('w' || first_seq, ' ' ORDER BY k) AS transcript_full, count(*) AS c FROM sttw GROUP BY 1),
p AS (SELECT session_id, count(*) AS records FROM (SELECT session_id, k FROM nvw UNION SELECT session_id, k FROM sttw) GROUP BY 1)
SELECT session_id, coalesce(records, 0) + 1 AS record_count, coalesce(transcript_full, '') AS transcript_full, coalesce(window_transcripts, []::VARCHAR[]) AS window_transcripts, end_us AS latest_turn_end_us,
  false AS raw_media_exposed, false AS raw_secrets_exposed FROM ends LEFT JOIN t USING (session_id) LEFT JOIN p USING (session_id)""")
def signals_payload(spark, sf_dir):
    lanes, ends = _lanes_once(spark, sf_dir)
    paired = pairing.pair_windows(_readings(lanes, ends), _texts(lanes, ends))
    told = F.transform(F.array_sort(F.collect_list(F.when(F.trim("transcript") != "", F.struct("k", "transcript")))), lambda x: x["transcript"])
    by = paired.groupBy("session_id").agg(F.count(F.lit(1)).alias("records"), told.alias("window_transcripts"))
    texts = F.coalesce("window_transcripts", F.array().cast("array<string>"))
    return ends.join(by, "session_id", "left").select(
        "session_id", (F.coalesce("records", F.lit(0)) + 1).alias("record_count"), F.array_join(texts, " ").alias("transcript_full"), texts.alias("window_transcripts"), F.col("end_us").alias("latest_turn_end_us"),
        F.lit(False).alias("raw_media_exposed"), F.lit(False).alias("raw_secrets_exposed"),
    )


@query(f"""WITH r AS ({PAIRED}), j AS (SELECT session_id, k, '{{"type":"window","session_id":' || session_id || ',"k":' || k || ',"state":' || coalesce('"' || state || '"', 'null') || ',"intensity":' || coalesce(intensity::DOUBLE::VARCHAR, 'null')
  || ',"transcript":"' || transcript || '","transcript_final":' || transcript_final || '}}' AS line FROM r) SELECT session_id, k, line, 'data: ' || line || chr(10) || chr(10) AS frame FROM j""")
def record_json(spark, sf_dir):
    """Window records as lines of JSON and as server-sent frames."""
    w = turn_windows(spark, sf_dir)
    record = F.struct(F.lit("window").alias("type"), *w.columns)
    return w.select("session_id", "k", pairing.as_json(record).alias("line"), pairing.sse_frame(record).alias("frame"))


# Signals with delays by number, a result in five without a reading, and every thirteenth told again.
DEADLINE = 3 * SECOND_US
LAST = 2**40
NV_AT, STT_AT = f"(k + 1) * {W3}L + (k * 7 + session_id * 3) % 11 * {2 * SECOND_US // 5}L", f"(k + 1) * {W3}L + (k * 5 + session_id) % 7 * {3 * SECOND_US // 10}L"


def turn_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of operators.turns as workers would tell them of the events' windows."""
    lanes, ends = _lanes_once(spark, sf_dir)
    names = [c.split()[0] for c in turns.SIGNAL.split(", ")[1:]]
    forms = dict(c.split() for c in turns.SIGNAL.split(", ")[1:])

    def told(rows: DataFrame, **columns: str) -> DataFrame:
        return rows.select("session_id", *(F.expr(columns.get(c, "null")).cast(forms[c]).alias(c) for c in names))

    nv, stt = _readings(lanes, ends), _texts(lanes, ends)
    grid, read = {"start_us": f"k * {W3}L", "window_us": str(W3)}, {"state": "state", "intensity": "intensity", "ok": "n % 5 <> 0"}
    parts = [
        told(nv, seq="k * 16", at_us=f"(k + 1) * {W3}L", kind="'submitted'", lane="'nonverbal'", ok="true", **grid),
        told(stt, seq="k * 16 + 1", at_us=f"(k + 1) * {W3}L", kind="'submitted'", lane="'transcript'", ok="true", **grid),
        told(nv, seq="k * 16 + 2", at_us=NV_AT, kind="'nonverbal'", **grid, **read),
        told(nv.where("k % 13 = 0"), seq="k * 16 + 3", at_us=f"{NV_AT} + {5 * SECOND_US}L", kind="'nonverbal'", **grid, **read),
        told(stt, seq="k * 16 + 4", at_us=STT_AT, kind="'transcript'", text="text", ok="n % 5 <> 0", **grid),
        told(_evals(lanes, ends), seq="k * 16 + 5", at_us=f"(k + 1) * {W16}L + k % 3 * {SECOND_US}L", kind="'eval'", start_us=f"k * {W16}L", window_us=str(W16), text="concat('e', k)", ok="ok"),
        told(ends, seq=f"{LAST}L", at_us="end_us", kind="'ended'", start_us="end_us", ok="true"),
        told(ends, seq=f"{LAST + 1}L", at_us=f"end_us + session_id % 6 * {7 * SECOND_US // 10}L", kind="'tail'", text="concat('t', session_id)", ok="session_id % 4 <> 0"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BIG = f"{4 * LAST}::HUGEINT"
SIGNALS = f"""{FULL}{GRID[len(EV):]}, sig AS (
  SELECT session_id, k * 16 AS seq, (k + 1) * {W3} AS at_us, 'submitted' AS kind, 'nonverbal' AS lane, k * {W3} AS start_us, {W3} AS window_us, true AS ok, NULL AS text, NULL AS state, NULL::DOUBLE AS intensity FROM nvw
  UNION ALL SELECT session_id, k * 16 + 1, (k + 1) * {W3}, 'submitted', 'transcript', k * {W3}, {W3}, true, NULL, NULL, NULL FROM sttw
  UNION ALL SELECT session_id, k * 16 + 2 + i, {NV_AT.replace('L', '')} + i * {5 * SECOND_US}, 'nonverbal', NULL, k * {W3}, {W3}, n % 5 <> 0, NULL, {STATE}, (cents % 100) / 100.0 FROM nvw, range(2) r(i) WHERE i = 0 OR k % 13 = 0
  UNION ALL SELECT session_id, k * 16 + 4, {STT_AT.replace('L', '')}, 'transcript', NULL, k * {W3}, {W3}, n % 5 <> 0, 'w' || first_seq, NULL, NULL FROM sttw
  UNION ALL SELECT session_id, k * 16 + 5, (k + 1) * {W16} + k % 3 * {SECOND_US}, 'eval', NULL, k * {W16}, {W16}, ok, 'e' || k, NULL, NULL FROM evals
  UNION ALL SELECT session_id, {LAST + 1}, end_us + session_id % 6 * {7 * SECOND_US // 10}, 'tail', NULL, NULL, NULL, session_id % 4 <> 0, 't' || session_id, NULL, NULL FROM ends),
s AS (SELECT sig.*, end_us, at_us * {BIG} + seq AS o, end_us * {BIG} + {LAST} AS eo FROM sig JOIN ends USING (session_id)),
res AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, start_us ORDER BY o) AS nth FROM s WHERE kind IN ('nonverbal', 'transcript', 'tail')),
cov AS (
  SELECT session_id, any_value(end_us) AS end_us, {W16} * min(g) FILTER (d IS NULL) AS c
  FROM (SELECT session_id, end_us, unnest(range(0, end_us // {W16} + 1)) AS g FROM ends) LEFT JOIN (SELECT session_id, start_us // {W16} AS g, true AS d FROM s WHERE kind = 'eval' AND ok AND o < eo) USING (session_id, g)
  GROUP BY session_id),
due AS (SELECT session_id, c AS start_us, end_us - c AS window_us, end_us FROM cov WHERE end_us > c AND (c = 0 OR end_us - c > {SECOND_US})),
owed AS (SELECT session_id, lane AS kind, start_us FROM s WHERE kind = 'submitted' AND o < eo UNION ALL SELECT session_id, 'tail', NULL FROM due),
come AS (SELECT w.session_id, r.at_us, r.o FROM owed w LEFT JOIN res r ON r.session_id = w.session_id AND r.kind = w.kind AND r.start_us IS NOT DISTINCT FROM w.start_us AND r.nth = 1),
shut AS (
  SELECT e.session_id, e.end_us, count(*) FILTER (c.session_id IS NOT NULL AND (c.o IS NULL OR c.at_us > e.end_us + {DEADLINE})) AS late, max(c.o) AS last
  FROM ends e LEFT JOIN come c USING (session_id) GROUP BY e.session_id, e.end_us),
closing AS (
  SELECT session_id, end_us, late, CASE WHEN late > 0 THEN (end_us + {DEADLINE} + 1) * {BIG} - 1 ELSE greatest(end_us * {BIG} + {LAST}, coalesce(last, 0)) END AS co FROM shut),
kept AS (SELECT res.*, co FROM res JOIN closing USING (session_id) WHERE nth = 1 AND o <= co AND (kind <> 'tail' OR session_id IN (SELECT session_id FROM due))),
pair AS (
  SELECT session_id, start_us, bool_or(kind = 'nonverbal') AS a, bool_or(kind = 'transcript') AS b, max(at_us) AS met_us, any_value(co) // {BIG} AS end_us, max(state) FILTER (kind = 'nonverbal') AS state,
    max(intensity) FILTER (kind = 'nonverbal') AS intensity, coalesce(max(text), '') AS text FROM kept WHERE ok AND kind <> 'tail' GROUP BY ALL)
SELECT session_id, 'window' AS type, CASE WHEN a AND b THEN met_us ELSE end_us::BIGINT END AS at_us, start_us, {W3} AS window_us, state, intensity, text, b AS heard, NULL AS eval, NULL::BIGINT AS n FROM pair
UNION ALL SELECT session_id, 'eval', at_us, start_us, window_us, NULL, NULL, text, NULL, NULL, NULL FROM s WHERE kind = 'eval' AND ok
UNION ALL SELECT session_id, 'tail', end_us, start_us, window_us, NULL, NULL, NULL, NULL, NULL, NULL FROM due
UNION ALL SELECT session_id, 'turn_end', (co // {BIG})::BIGINT, end_us, NULL, NULL, NULL,
  coalesce((SELECT string_agg(text, ' ' ORDER BY start_us) FROM kept k WHERE k.session_id = c.session_id AND kind = 'transcript' AND ok), ''), NULL,
  (SELECT max(text) FROM kept k WHERE k.session_id = c.session_id AND kind = 'tail' AND ok), late FROM closing c
UNION ALL SELECT session_id, 'dropped', max(at_us), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) - (SELECT count(*) FROM kept k WHERE k.session_id = res.session_id) AS n
  FROM res GROUP BY session_id HAVING count(*) > (SELECT count(*) FROM kept k WHERE k.session_id = res.session_id)"""


@query(SIGNALS)
def turn_records(spark, sf_dir):
    return turns.turn_records(staged(turn_signals(spark, sf_dir), "signals"), DEADLINE, SECOND_US)


READ_AS = (*pairing.STATES[:6], "Bored")  # what the stand-in for a model says, by the number of frames
KNOWN = ", ".join(f"'{state}'" for state in pairing.STATES[:6])


def _reader() -> critics.Critic:
    """A stand-in for a model that is reset on every third window's first call, busy on every fifth, and whose fallback lacks some of these."""

    def model(row: dict) -> dict:
        if row["k"] % 5 == 0:
            raise TimeoutError("busy")
        if row["k"] % 3 == 0 and row["call_try"] == 1:
            raise ConnectionError("reset")
        return {"state": READ_AS[row["n_frames"] % 7], "intensity": str(row["n_audio"] * 3 % 16 / 10) if row["k"] % 2 else "strong", "note": f"heard {row['n_audio']}"}

    def local(row: dict) -> dict:
        if row["k"] % 20 == 0:
            raise LookupError("no local model")
        return {"state": "neutral", "intensity": "0.5", "note": None}

    return critics.with_fallback(critics.with_tries(model, 2), local)


@query(f"""{FULL}, w AS (SELECT session_id, k, n_frames, n_audio, k % 5 = 0 AS busy, k % 20 = 0 AS lost FROM evals)
SELECT session_id, k, sha256('{{"session_id":' || session_id || ',"k":' || k || '}}') AS call_key, CASE WHEN lost THEN NULL WHEN busy THEN 'fallback' ELSE 'primary' END AS engine, CASE WHEN NOT busy THEN CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END END AS tries,
  CASE WHEN lost THEN NULL WHEN busy THEN 'neutral' ELSE coalesce([{KNOWN}][n_frames % 7 + 1], 'neutral') END AS state,
  CASE WHEN lost THEN NULL WHEN busy THEN 0.5 WHEN k % 2 = 1 THEN least(1.0, n_audio * 3 % 16 / 10.0) ELSE 0.0 END::DOUBLE AS intensity,
  CASE WHEN lost THEN NULL WHEN busy THEN '' ELSE 'heard ' || n_audio END AS note, CASE WHEN lost THEN 'LookupError: no local model' END AS error FROM w""")
def critic_calls(spark, sf_dir):
    """Readings of a model for each window with frames and sound: calls side by side, tried again, with a fallback, failures as values."""
    wide = critics.gated(_evals(*_lanes(spark, sf_dir)), needs_frames=True, needs_sound=True).select("session_id", "k", "n_frames", "n_audio")
    told = critics.scored(wide, _reader, "state string, intensity string, note string, engine string, tries int", ["session_id", "k"], in_flight=8, deadline_s=60.0)
    read = pairing.valid_reading(*map(F.col, ("state", "intensity", "note")))
    ok = F.col("error").isNull()
    return told.select("session_id", "k", "call_key", "engine", "tries", *(F.when(ok, c).alias(n) for n, c in zip(("state", "intensity", "note"), read)), "error")


# Ten workers that begin a session every four seconds in which there is something; half of them end with their last row, the others when the next begins.
SPELL = 4 * SECOND_US


@query(f"""{EV}, r AS (SELECT *, session_id % 10 AS worker, t_us // {SPELL} AS k FROM ev),
s AS (SELECT worker, worker || '-' || k AS session_id, min(t_us) AS at_us, CASE WHEN k % 2 = 0 THEN max(t_us) END AS ended_us, count(*) AS n FROM r GROUP BY worker, k),
p AS (SELECT *, lag(session_id) OVER (PARTITION BY worker ORDER BY at_us) AS previous FROM s),
a AS (SELECT seq, worker, t_us + seq % 5 * {SECOND_US} AS at_us, CASE WHEN seq % 3 > 0 THEN worker || '-' || (k - seq % 4 + 1) END AS asked FROM r WHERE lane = 'error'),
m AS (SELECT a.*, p.session_id, p.previous, p.session_id IS NOT NULL AND (p.ended_us IS NULL OR p.ended_us > a.at_us) AS going_on FROM a ASOF LEFT JOIN p ON a.worker = p.worker AND a.at_us >= p.at_us),
f AS (SELECT *, CASE WHEN asked IS NULL OR asked = session_id THEN session_id WHEN going_on AND asked = previous THEN previous END AS found FROM m)
SELECT seq, asked, found, CASE WHEN found IS NOT NULL THEN going_on AND found = f.session_id END AS active, coalesce(s.n, 0) AS record_count FROM f LEFT JOIN s ON found = s.session_id""")
def session_lookup(spark, sf_dir):
    """Which session a worker answers for when it is asked, by name or not, and how many records that has."""
    rows = event_lanes(spark, sf_dir).select("seq", "lane", "t_us", (F.col("session_id") % 10).alias("worker"), F.floor(F.col("t_us") / SPELL).alias("k"))
    name = lambda k: F.concat(F.col("worker").cast("string"), F.lit("-"), k.cast("string"))
    sessions = rows.groupBy("worker", "k").agg(F.min("t_us").alias("at_us"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    sessions = sessions.select("worker", name(F.col("k")).alias("session_id"), "at_us", F.when(F.col("k") % 2 == 0, F.col("last_us")).alias("ended_us"), "n")
    sessions = staged(sessions, "sessions")
    asked = F.when(F.col("seq") % 3 > 0, name(F.col("k") - F.col("seq") % 4 + 1))
    asks = rows.where("lane = 'error'").select("seq", "worker", (F.col("t_us") + F.col("seq") % 5 * SECOND_US).alias("at_us"), asked.alias("asked"))
    told = lookup.sessions_asked(asks, sessions.drop("n"), 60 * SECOND_US)
    counts = sessions.select(F.col("session_id").alias("found"), "n")
    return told.join(counts, "found", "left").select("seq", "asked", "found", "active", F.coalesce("n", F.lit(0)).alias("record_count"))
