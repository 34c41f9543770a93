"""Queries over conversations, documents, embeddings and orders: sentences, geometry, replies, sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import audio, replies, table_functions
from turnloom.operators import metrics, pairing, sentences
from turnloom.sources.lanes import stream_text, turn_events

QUERIES: dict = {}
SQL: dict[str, str] = {}
DELTA_CHARS = 40


def query(sql: str | None = None):
    """Enter a plan under its name, with its SQL."""

    def enter(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return enter


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '([.?!])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s, length(text) * 50 AS e FROM documents),
u AS (SELECT doc_id, e, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM p),
c AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(length(sentence)) OVER (PARTITION BY doc_id) AS total FROM u)
SELECT doc_id, i::INT AS i, length(sentence)::INT AS n_chars, ((e * (upto - length(sentence))) // total)::BIGINT AS start_at, ((e * upto) // total)::BIGINT AS end_at FROM c""")
def sentence_split(spark, sf_dir):
    """Every document's sentences, timed at 50 ms a character."""
    docs = _table(spark, sf_dir, "documents")
    rows = sentences.split_rows(docs, ["doc_id"], "text", F.lit(0).cast("long"), (F.length("text") * 50).cast("long"))
    return rows.select("doc_id", "i", F.length("sentence").alias("n_chars"), "start_at", "end_at")


def event_script(spark, sf_dir: str) -> DataFrame:
    """Turn events made of conversations: for each message speech starts, its whole text comes in deltas, and it completes with or without text, or never."""
    talk = _table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    item = F.col("turn").cast("string")
    step = lambda kind, at, text, item: F.struct(F.lit(kind).alias("kind"), at.alias("at"), text.alias("text"), item.alias("item_id"))
    n = F.coalesce(F.ceil(F.length("text") / DELTA_CHARS).cast("int"), F.lit(0))
    # A second apart, or closer so that all come before speech stops.
    gap = F.least(F.lit(1.0), F.lit(4.0) / F.greatest(n, F.lit(1)))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(numbers, lambda j: step("transcript.delta", F.lit(1.0) + j * gap, F.substring(F.col("text"), j * DELTA_CHARS + 1, F.lit(DELTA_CHARS)), item))
    ends = F.array(
        step("vad.speech_stopped", F.lit(5.0), none, none),
        step("transcript.completed", F.lit(5.4), F.when(F.col("turn") % 2 == 0, F.col("text")), item),
        step("tick", F.lit(6.0), none, none),
    )
    steps = F.concat(F.array(step("vad.speech_started", F.lit(0.5), none, none)), deltas, ends)
    kept = F.filter(steps, lambda s: (F.col("turn") % 3 != 2) | (s["kind"] != "transcript.completed"))
    rows = talk.select("conv_id", "turn", F.posexplode(kept).alias("i", "s"))
    rows = rows.select(
        F.col("conv_id").cast("string").alias("session_id"), (F.shiftleft(F.col("turn").cast("long"), 32) + F.col("i")).alias("seq"), (F.col("turn") * 6.0 + F.col("s.at")).alias("media_now"),
        "s.kind", "s.item_id", "s.text",
    )
    last = rows.groupBy("session_id").agg((F.max("seq") + 1).alias("seq"), (F.max("media_now") + 1).alias("media_now"))
    return rows.unionByName(last.withColumns({"kind": F.lit("turn_end"), "item_id": none, "text": none}))


# The fold by recursion: each step takes a session's next event to the state after it (start, stopped, items) and to the utterance it ends (told).
FOLD = """WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, ceil(length(text) / 40.0)::INT AS n FROM conversations),
steps AS (
  SELECT conv_id, turn, 0 AS o, 'vad.speech_started' AS kind, 0.5::DOUBLE AS since, NULL AS item_id, NULL AS text FROM m
  UNION ALL SELECT conv_id, turn, 1 + j, 'transcript.delta', 1.0::DOUBLE + j * least(1.0::DOUBLE, 4.0::DOUBLE / n), turn::VARCHAR, substr(text, j * 40 + 1, 40) FROM (SELECT *, unnest(range(0, n)) AS j FROM m WHERE n > 0)
  UNION ALL SELECT conv_id, turn, 1000000001, 'vad.speech_stopped', 5.0, NULL, NULL FROM m
  UNION ALL SELECT conv_id, turn, 1000000002, 'transcript.completed', 5.4, turn::VARCHAR, CASE WHEN turn % 2 = 0 THEN text END FROM m WHERE turn % 3 <> 2
  UNION ALL SELECT conv_id, turn, 1000000003, 'tick', 6.0, NULL, NULL FROM m),
numbered AS (SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, o) AS i, kind, turn * 6.0::DOUBLE + since AS now, item_id, text FROM steps),
e AS MATERIALIZED (
  SELECT * FROM numbered UNION ALL SELECT session_id, max(i) + 1, 'turn_end', max(now) + 1, NULL, NULL FROM numbered GROUP BY session_id),
walk AS (
  SELECT DISTINCT session_id, 0::BIGINT AS i, 0.0::DOUBLE AS start, NULL::DOUBLE AS stopped, []::STRUCT(name VARCHAR, said VARCHAR)[] AS items,
    NULL::STRUCT(a DOUBLE, b DOUBLE, said VARCHAR, source VARCHAR) AS told FROM e
  UNION ALL
  SELECT session_id, i, CASE WHEN ends THEN stop WHEN kind = 'vad.speech_started' THEN greatest(start, now) ELSE start END,
    CASE WHEN ends AND done THEN NULL WHEN kind = 'vad.speech_stopped' THEN now ELSE stopped END,
    CASE WHEN due THEN rest
      WHEN kind <> 'transcript.delta' OR coalesce(text, '') = '' THEN items
      WHEN len(list_filter(items, lambda x: x.name = item_id)) > 0 THEN list_transform(items, lambda x: CASE WHEN x.name = item_id THEN {'name': x.name, 'said': x.said || text} ELSE x END)
      ELSE list_append(items, {'name': item_id, 'said': text}) END,
    CASE WHEN ends AND (said <> '' OR stop - start >= 1.0) THEN {'a': start, 'b': stop, 'said': said, 'source': CASE WHEN said = '' THEN 'utterance' WHEN done THEN 'punct' WHEN kind = 'tick' THEN 'timeout' ELSE 'flush' END} END
  FROM (SELECT *, due AND (said <> '' OR done) AS ends, greatest(CASE WHEN done THEN coalesce(stopped, now) ELSE now END, start + 0.2::DOUBLE) AS stop
    FROM (SELECT *,
        CASE WHEN done THEN coalesce(nullif(own, ''), regexp_replace(list_filter(items, lambda x: x.name = called)[1].said, '^\\s+|\\s+$', '', 'g'), '')
          ELSE coalesce(regexp_replace(array_to_string(list_transform(items, lambda x: x.said), ' '), '^\\s+|\\s+$', '', 'g'), '') END AS said,
        CASE WHEN done THEN list_filter(items, lambda x: x.name IS DISTINCT FROM called) ELSE [] END AS rest
      FROM (SELECT *, CASE WHEN own <> '' OR len(list_filter(items, lambda x: x.name = item_id)) > 0 THEN item_id ELSE items[1].name END AS called
        FROM (SELECT e.session_id, e.i, w.start, w.stopped, w.items, e.kind, e.now, e.item_id, e.text, e.kind = 'transcript.completed' AS done,
            e.kind IN ('transcript.completed', 'turn_end') OR (e.kind = 'tick' AND e.now - w.start > 10.0) AS due, coalesce(regexp_replace(e.text, '^\\s+|\\s+$', '', 'g'), '') AS own
          FROM walk w JOIN e ON e.session_id = w.session_id AND e.i = w.i + 1))))),
cut AS (
  SELECT session_id, i, told.a AS a, told.b AS b, told.source AS source,
    CASE WHEN told.said = '' THEN [''] ELSE list_filter(string_split(regexp_replace(told.said, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') END AS pieces
  FROM walk WHERE told IS NOT NULL),
spread AS (SELECT *, list_transform(pieces, lambda p: (b - a) * length(p) / list_sum(list_transform(pieces, lambda q: length(q)))) AS widths, generate_subscripts(pieces, 1) AS p FROM cut),
bounds AS (
  SELECT session_id, pieces[p] AS text, source, list_reduce([a] || widths[1:p - 1], lambda x, y: x + y) AS start_s,
    CASE WHEN p = len(pieces) THEN b ELSE list_reduce([a] || widths[1:p], lambda x, y: x + y) END AS end_s FROM spread)
SELECT session_id, format('{:.2f}', start_s)::DOUBLE AS start_s, format('{:.2f}', end_s)::DOUBLE AS end_s, text, source FROM bounds"""


@query(FOLD)
def sentence_fold(spark, sf_dir):
    return sentences.fold_sentences(event_script(spark, sf_dir))


@query(FOLD)
def sentence_sql(spark, sf_dir):
    """The same sentences by a table function in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT session_id, start_s, end_s, text, source FROM sentences_of(TABLE({events}))", events=event_script(spark, sf_dir))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'transcript.completed' WHEN turn % 3 = 1 THEN 'transcript.delta' ELSE 'vad.speech_started' END AS kind,
  CASE WHEN turn % 3 = 2 THEN NULL ELSE nullif(text, '') END AS text, CASE WHEN turn % 2 = 0 THEN 'i' || turn ELSE 'top' END AS item_id FROM conversations""")
def turn_event_payloads(spark, sf_dir):
    """Payloads under each of the accepted names, read back."""
    third, even = F.col("turn") % 3, F.col("turn") % 2 == 0
    detail = F.struct(F.when(third == 0, F.col("text")).alias("transcript"), F.when(third == 1, F.col("text")).alias("text"), F.when(even, F.concat(F.lit("i"), F.col("turn").cast("string"))).alias("itemId"))
    payload = F.to_json(
        F.struct(
            F.when(third == 0, "transcript.completed").otherwise("").alias("eventKind"), F.when(third == 1, "transcript.delta").alias("normalizedType"),
            F.when(third == 2, "vad.speech_started").otherwise("other").alias("type"), F.lit("top").alias("itemId"), detail.alias("detail"),
        )
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("payload"))
    return turn_events(rows, "payload").select("conv_id", "turn", "kind", "text", "item_id")


@query("""SELECT conv_id, turn AS seq, text AS delta FROM conversations WHERE text <> ''""")
def sse_delta_text(spark, sf_dir):
    """Messages as server-sent chat lines with noise between them, each conversation ended after its last."""
    talk = _table(spark, sf_dir, "conversations")
    content = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    data = talk.select("conv_id", F.col("turn").alias("seq"), F.concat(F.lit("data: "), content).alias("line"))
    noise = talk.select("conv_id", F.col("turn").alias("seq"), F.explode(F.array(F.lit(": ping"), F.lit("data: {broken"), F.lit("event: x"))).alias("line"))
    done = talk.groupBy("conv_id").agg((F.max("turn") + 1).alias("seq")).withColumn("line", F.lit("data: [DONE]"))
    return stream_text(data.unionByName(noise).unionByName(done), ["conv_id"], "seq", "line")


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def conversation_transcript(spark, sf_dir):
    talk = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("k"), F.col("turn").alias("seq"), "text")
    return pairing.transcript(talk).withColumnRenamed("session_id", "conv_id")


def _points(vectors: DataFrame, n: int, width: int):
    part = lambda i: F.transform(F.slice("embedding", width * i + 1, width), lambda x: x.cast("double"))
    return vectors.withColumn("points", F.array(*(part(i) for i in range(n))))


def _dist(a: int, b: int) -> str:
    """SQL for the distance of two of the 21 points in an embedding."""
    return "sqrt(" + " + ".join(f"power(embedding[{3 * a + j}]::DOUBLE - embedding[{3 * b + j}]::DOUBLE, 2)" for j in (1, 2, 3)) + ")"


@query(
    "SELECT vec_id, "
    + " + ".join(f"({_dist(0, tip)} > {_dist(0, joint)} * 1.15)::INT" for joint, tip in metrics.FINGERS)
    + f" + ({_dist(0, 9)} > 1e-9 AND {_dist(4, 9)} > {_dist(0, 9)} * 0.68)::INT AS fingers FROM embeddings"
)
def finger_count(spark, sf_dir):
    """Embeddings read as hands of 21 points."""
    return _points(_table(spark, sf_dir, "embeddings"), 21, 3).select("vec_id", metrics.extended_fingers(F.col("points")).alias("fingers"))


@query("""WITH m AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:9]] AS m FROM embeddings)
SELECT vec_id, round(degrees(atan2(m[4], m[1])), 6) AS yaw, round(degrees(atan2(-m[7], sqrt(m[1] * m[1] + m[4] * m[4]))), 6) AS pitch, round(degrees(atan2(m[8], m[9])), 6) AS roll FROM m""")
def euler_angles(spark, sf_dir):
    m = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m"))
    return rows.select("vec_id", *(F.round(a, 6).alias(n) for a, n in zip(metrics.euler_degrees(F.col("m")), ("yaw", "pitch", "roll"))))


@query("""WITH l AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
d AS (SELECT label, CASE WHEN p IS NOT NULL THEN (sqrt(power(e[1]::DOUBLE - p[1], 2) + power(e[2]::DOUBLE - p[2], 2)) + sqrt(power(e[3]::DOUBLE - p[3], 2) + power(e[4]::DOUBLE - p[4], 2))
  + sqrt(power(e[5]::DOUBLE - p[5], 2) + power(e[6]::DOUBLE - p[6], 2)) + sqrt(power(e[7]::DOUBLE - p[7], 2) + power(e[8]::DOUBLE - p[8], 2))) / 4 END AS d FROM l)
SELECT label, round(coalesce(avg(d), 0), 5) AS motion FROM d GROUP BY label""")
def velocity(spark, sf_dir):
    """Movement of four points from vector to vector within a label."""
    rows = _points(_table(spark, sf_dir, "embeddings"), 4, 2)
    return metrics.velocity(rows, ["label"], "vec_id", "points").select("label", F.round("motion", 5).alias("motion"))


@query("""WITH p AS (SELECT label, vec_id, abs(embedding[1]::DOUBLE) AS sh_w, embedding[2]::DOUBLE AS sx, embedding[3]::DOUBLE AS sy, embedding[4]::DOUBLE AS lx, embedding[5]::DOUBLE AS ly, 0.5 + embedding[6]::DOUBLE AS lv,
  embedding[7]::DOUBLE AS rx, embedding[8]::DOUBLE AS ry, 0.5 + embedding[9]::DOUBLE AS rv FROM embeddings),
s AS (SELECT *, avg(sh_w) OVER (PARTITION BY label) AS scale, CASE WHEN lag(lv) OVER w > 0.5 AND lv > 0.5 THEN sqrt(power(lx - lag(lx) OVER w, 2) + power(ly - lag(ly) OVER w, 2)) END AS ml,
  CASE WHEN lag(rv) OVER w > 0.5 AND rv > 0.5 THEN sqrt(power(rx - lag(rx) OVER w, 2) + power(ry - lag(ry) OVER w, 2)) END AS mr FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
m AS (SELECT *, CASE WHEN ml IS NULL THEN mr WHEN mr IS NULL THEN ml ELSE greatest(ml, mr) END / scale AS v FROM s)
SELECT label, count(*) AS pose_frames, round((stddev_pop(sx) + stddev_pop(sy)) / 2 / any_value(scale), 4) AS posture_std, round(avg((greatest(lv, rv) > 0.5)::INT::DOUBLE), 4) AS wrist_visible,
  round(coalesce(avg(v), 0), 4) AS wrist_motion, count(*) FILTER (v > 0.15) AS gesture_events FROM m GROUP BY label""")
def pose_motion(spark, sf_dir):
    """Embeddings read as poses, a label's in the order of their ids."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    columns = {"sh_w": F.abs(at(1)), "sh_x": at(2), "sh_y": at(3), "nose_x": at(2), "nose_y": at(3), "lx": at(4), "ly": at(5), "lv": at(6) + 0.5, "rx": at(7), "ry": at(8), "rv": at(9) + 0.5}
    m = metrics.pose_measures(_table(spark, sf_dir, "embeddings").withColumns(columns), ["label"], "vec_id")
    return m.select("label", "pose_frames", "gesture_events", *(F.round(c, 4).alias(c) for c in ("posture_std", "wrist_visible", "wrist_motion")))


@query("""SELECT vec_id, CASE label % 9 WHEN 0 THEN 'engaged' WHEN 1 THEN 'attentive' WHEN 2 THEN 'hesitant' WHEN 3 THEN 'nervous' WHEN 4 THEN 'confident' WHEN 5 THEN 'disengaged' ELSE 'neutral' END AS state,
  CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, vec_id % 30 / 20.0 - 0.2)) END AS intensity, left(repeat('n' || vec_id, 40), 120) AS note FROM embeddings""")
def reading_coercion(spark, sf_dir):
    """Readings with unknown states, numbers out of range or none, and long notes, as they may be."""
    n = F.col("label") % 9
    names = F.array(*map(F.lit, [*pairing.STATES[:6], "bored", "", "NEUTRAL"]))
    number = F.when(F.col("vec_id") % 5 == 0, "high").otherwise((F.col("vec_id") % 30 / 20.0 - 0.2).cast("string"))
    note = F.repeat(F.concat(F.lit("n"), F.col("vec_id").cast("string")), 40)
    read = pairing.valid_reading(F.element_at(names, (n + 1).cast("int")), number, note)
    return _table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(a) for c, a in zip(read, ("state", "intensity", "note"))))


@query()
def json_repair(spark, sf_dir):
    """Replies made of conversations, whole, fenced, in prose or cut off, and the JSON found in them."""
    body = F.to_json(F.struct(F.col("role").alias("state"), F.col("text").alias("note"), F.array("turn", "conv_id").alias("critique")))
    forms = F.array(body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Well: "), body, F.lit(" so.")), F.expr("left(_body, length(_body) - 3)"), F.expr("left(_body, cast(length(_body) * 2 / 3 as int))"), F.lit("none"))
    rows = _table(spark, sf_dir, "conversations").withColumn("_body", body)
    rows = rows.select("conv_id", "turn", F.element_at(forms, (F.col("turn") % 6 + 1).cast("int")).alias("reply"))
    return rows.select("conv_id", "turn", replies.extract_json("reply").alias("json"))


def _pcm(spark, sf_dir: str) -> DataFrame:
    """A second and a half of sound for each vector: its numbers' bytes over and over, silent for a while."""
    digits = F.expr("hex(concat_ws('', transform(embedding, x -> cast(cast(x * 100 as int) as string))))")
    # No more copies are made than 24,000 bytes take.
    body = F.unhex(F.expr("repeat(digits, least(800, cast(ceil(48000 / greatest(length(digits), 1)) as int)))"))
    sound = F.substring(body, F.lit(1), F.lit(24000))
    gap = F.unhex(F.expr("repeat('00', 9600)"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", digits.alias("digits")).select("vec_id", F.concat(sound, gap, sound).alias("pcm"))


@query()
def prosody(spark, sf_dir):
    return _pcm(spark, sf_dir).select("vec_id", audio.vocal("pcm").alias("m")).select("vec_id", "m.*")


@query()
def pause_positions(spark, sf_dir):
    return _pcm(spark, sf_dir).select("vec_id", F.explode(audio.silence_positions("pcm")).alias("p")).select("vec_id", "p.*")


@query("""WITH s AS (SELECT vec_id, least(24000, 800 * length(array_to_string(list_transform(embedding, lambda x: CAST(trunc(x * 100) AS INT)), ''))) AS n FROM embeddings)
SELECT vec_id, (44 + (2 * n + 9600) // 2 * 2)::INT AS wav_bytes, 'UklGR' AS starts FROM s""")
def audio_window(spark, sf_dir):
    """The sound of each vector as WAV in base64: its length and how it starts."""
    url = audio.audio_url(F.col("pcm"))
    text = F.substring(url, len("data:audio/wav;base64,") + 1, 1 << 30)
    return _pcm(spark, sf_dir).select("vec_id", text.alias("b")).select("vec_id", F.length(F.unbase64("b")).alias("wav_bytes"), F.substring("b", 1, 5).alias("starts"))
