"""Queries on speakers, live tokens, edits, translations, lags and summaries. Conversations stand for transcripts, embeddings for voices, the
events of a user for the pitches of a voice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import parts as M
from parley.operators import speakers as S
from parley.operators import transcript as P
from parley.operators import vectors as V
from parley.plans.registry import query
from parley.sources.tables import table


def md5(c):
    return F.md5(F.col(c).cast("binary")).alias(c)


def tones(spark, sf):
    """user_id, pitch (array of statistics), frames."""
    d = table(spark, sf, "events").select("user_id", (F.col("value") + 100).alias("v"), (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("d"))
    p = lambda q: F.percentile("v", F.lit(q))
    return d.groupBy("user_id").agg(F.array(F.avg("v"), F.stddev_pop("v"), p(0.5), p(0.1), p(0.9), F.stddev_pop("d"), F.lit(None), F.lit(None)).alias("pitch"), F.count("*").cast("int").alias("frames"))


def voices(spark, sf):
    """Each 50 vectors in a row are the chunks of a meeting, the first four its speakers' voices; every other chunk lies between one of these and
    its own vector. Pitches come from the user of the chunk's number, twenty after each other, so that some have none."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own"), F.floor(F.col("vec_id") / 50).cast("long").alias("m"), (F.col("vec_id") % 50).cast("int").alias("chunk"))
    heads = e.where("chunk < 4").select(F.col("m").alias("hm"), F.col("chunk").alias("id"), F.col("own").alias("head"))
    e = e.join(heads, (F.col("m") == F.col("hm")) & (F.col("vec_id") % 4 == F.col("id")), "left")
    share = (F.col("vec_id") % 5) / 4
    voice = F.when((F.col("chunk") < 4) | F.col("head").isNull(), F.col("own")).otherwise(F.zip_with("own", "head", lambda a, b: a * share + b * (1 - share)))
    e = e.select("m", "chunk", "vec_id", "own", voice.alias("voice")).join(tones(spark, sf), F.col("vec_id") % 20 == F.col("user_id"), "left")
    # Mouths lie near each other in meetings of even number, apart in the others.
    mouth = F.transform(F.slice("own", 1, 5), lambda x: x * F.when(F.col("m") % 2 == 0, 0.3).otherwise(1.0))
    return e.select("m", "chunk", F.col("chunk").cast("double").alias("at"), F.lit(2.0).alias("seconds"), "voice", "pitch", F.coalesce("frames", F.lit(0)).alias("frames"), mouth.alias("mouth"), (F.col("vec_id") % 12).cast("int").alias("mouth_frames"))


@query()
def online_speakers(spark, sf):
    """Speakers of each meeting as its chunks come."""
    return S.classified(voices(spark, sf), "m")


ZONE = "CASE WHEN {0} <= 145 THEN 'male' WHEN {0} >= 165 THEN 'female' WHEN {0} IS NULL THEN 'unknown' ELSE 'neutral' END"


@query(f"""WITH d AS (SELECT user_id, value + 100 AS v, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
u AS (SELECT user_id, avg(v) AS f0, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS span, stddev_pop(d) AS delta, count(*) AS frames FROM d GROUP BY user_id),
e AS (SELECT vec_id, vec_id // 50 AS m, vec_id % 50 AS chunk, CAST(embedding AS DOUBLE[]) AS own FROM embeddings),
w AS (SELECT e.*, CASE WHEN e.chunk < 4 OR h.own IS NULL THEN e.own ELSE list_transform(list_zip(e.own, h.own), lambda z: z[1] * ((e.vec_id % 5) / 4) + z[2] * (1 - (e.vec_id % 5) / 4)) END AS voice FROM e LEFT JOIN e h ON h.m = e.m AND h.chunk < 4 AND h.chunk = e.vec_id % 4),
x AS (SELECT w.*, u.f0, u.median, u.span, u.delta, coalesce(u.frames, 0) AS frames, list_transform(own[1:5], lambda y: y * CASE WHEN m % 2 = 0 THEN 0.3 ELSE 1.0 END) AS mouth, vec_id % 12 AS mf FROM w LEFT JOIN u ON u.user_id = w.vec_id % 20),
p AS (SELECT *, chunk AS id, 2 + chunk * 2 AS cnt FROM x WHERE chunk < 4),
a AS (SELECT x.m, x.chunk, p.id, p.cnt, x.f0 AS f, p.f0 AS g, {ZONE.format("x.f0")} AS zf, {ZONE.format("p.f0")} AS zg, abs(x.f0 - p.f0) AS gap, coalesce(x.frames >= 6 AND p.frames >= 6 AND x.f0 IS NOT NULL AND p.f0 IS NOT NULL, false) AS heard, least(x.frames, p.frames) AS frames,
  abs(x.median - p.median) / 80 + abs(x.span - p.span) / 120 + abs(x.delta - p.delta) / 80 AS tones, list_dot_product(x.voice, p.voice) / sqrt(list_dot_product(x.voice, x.voice) * list_dot_product(p.voice, p.voice)) AS cosine,
  CASE WHEN x.mf >= 6 AND p.mf >= 6 THEN sqrt(list_sum(list_transform(list_zip(x.mouth, p.mouth), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END AS mouth, x.chunk - 12 <= 5 AS recent, p.id = 1 AS is_last FROM x JOIN p ON p.m = x.m),
b AS (SELECT *, zf = zg AND zf IN ('male', 'female') AS same, heard AND zf IN ('male', 'female') AND zg IN ('male', 'female') AND zf <> zg AND gap >= 25 AS cross_ FROM a),
c AS (SELECT *, CASE WHEN same AND NOT cross_ THEN CASE WHEN frames >= 6 THEN least(tones * 0.03, 0.08) ELSE 0 END * CASE WHEN zf = 'male' THEN 0.85 ELSE 1 END ELSE 0 END AS tone,
  CASE WHEN heard THEN least(gap / 120 * 0.06 * CASE WHEN f >= 165 AND g >= 165 THEN 1.8 ELSE 1 END + CASE WHEN cross_ THEN 0.06 WHEN (zf = 'neutral') <> (zg = 'neutral') THEN least(gap * 0.003, 0.06) ELSE 0 END, 0.22) ELSE 0 END AS pitch,
  CASE WHEN mouth <= 0.3 THEN 0.02 * CASE WHEN is_last THEN 1.2 ELSE 1 END WHEN mouth >= 0.65 THEN -least((mouth - 0.65) * 0.15 * CASE WHEN same AND zf = 'male' THEN 1.6 WHEN same AND zf = 'female' THEN 1.4 ELSE 1 END * CASE WHEN is_last THEN 0.8 ELSE 1 END, 0.08) ELSE 0 END AS by_mouth,
  heard AND same AND gap >= CASE WHEN zf = 'female' THEN 40 ELSE 90 END AS far_pitch, coalesce(same AND mouth >= 0.65, false) AS far_mouth, coalesce(f < 165 AND g < 165, false) AS low FROM b),
s AS (SELECT *, cosine - pitch - tone + by_mouth AS sim, CASE WHEN same AND NOT cross_ THEN CAST(far_pitch AS INT) + CAST(far_mouth AS INT) + CAST(tone >= 0.05 AS INT) ELSE 0 END AS signals FROM c),
t AS (SELECT *, greatest(CAST(0.68 AS DOUBLE) - CASE WHEN cnt >= 6 THEN 0.02 WHEN cnt < 4 THEN 0.06 ELSE 0 END - CASE WHEN recent AND is_last THEN 0.04 ELSE 0 END - CASE WHEN low THEN 0.04 ELSE 0 END + CASE WHEN cross_ THEN 0.07 ELSE 0 END, 0.52)
  + CASE WHEN far_mouth AND NOT cross_ THEN 0.05 ELSE 0 END + CASE WHEN signals > 0 THEN 0.03 ELSE 0 END AS threshold, row_number() OVER (PARTITION BY m, chunk ORDER BY sim DESC, id) AS k, lead(sim) OVER (PARTITION BY m, chunk ORDER BY sim DESC, id) AS second FROM s),
o AS (SELECT *, CASE WHEN coalesce(second, -1) >= 0 THEN sim - second ELSE 1 END AS ahead FROM t WHERE k = 1),
q AS (SELECT o.*, l.sim AS mine, sim_sure(o.sim, o.ahead, o.threshold, o.cross_, o.signals) AS sure FROM o LEFT JOIN t l ON l.m = o.m AND l.chunk = o.chunk AND l.id = 1)
SELECT m, chunk, CAST(CASE WHEN sure THEN id WHEN recent AND mine >= threshold - 0.06 THEN 1 ELSE id END AS INT) AS speaker, round(sim, 5) AS similarity, round(ahead, 5) AS lead, round(threshold, 5) AS threshold, sure FROM q""".replace(
    "sim_sure(o.sim, o.ahead, o.threshold, o.cross_, o.signals)",
    "o.sim >= o.threshold AND (o.ahead >= 0.08 OR o.sim >= 0.78) AND NOT (o.cross_ AND o.sim < 0.85) AND CASE o.signals WHEN 0 THEN true WHEN 1 THEN o.sim >= 0.78 + 0.04 AND o.ahead >= 0.08 + 0.06 ELSE o.sim >= 0.78 + 0.10 AND o.ahead >= 0.08 + 0.12 END",
))
def speaker_scores(spark, sf):
    """Every chunk against the profiles of its meeting, which stay as they are; the second speaker spoke last, at 12 seconds."""
    chunks = voices(spark, sf)
    profiles = chunks.where("chunk < 4").select("m", F.col("chunk").alias("id"), "voice", F.coalesce("pitch", F.array_repeat(F.lit(None).cast("double"), 8)).alias("stats"), "frames", "mouth", "mouth_frames", (F.col("chunk") * 2 + 2).alias("count"))
    sessions = profiles.select("m").distinct().select("m", F.lit(1).alias("last"), F.lit(12.0).alias("last_at"))
    told = S.scored(chunks, profiles, "m", sessions)
    return told.select("m", "chunk", "speaker", *[F.round(c, 5).alias(c) for c in ("similarity", "lead", "threshold")], "sure")


TOKENS = """(SELECT conv_id, turn * 1000 + k // 3 AS event, k % 3 AS j, CASE WHEN k % 17 = 9 THEN '<end>' ELSE w || ' ' END AS text, CAST((turn + k // 5) % 3 AS INT) AS speaker, k % 4 <> 3 AS is_final, k % 5 = 4 AS is_translation
FROM (SELECT conv_id, turn, generate_subscripts(ws, 1) - 1 AS k, unnest(ws) AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)))"""


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {TOKENS}), k AS (SELECT * FROM t WHERE text NOT IN ('', '<end>')),
g AS (SELECT conv_id, event, coalesce(string_agg(text, '' ORDER BY j) FILTER (is_final AND NOT is_translation), '') AS fin, coalesce(string_agg(text, '' ORDER BY j) FILTER (NOT is_final AND NOT is_translation), '') AS non,
  coalesce(string_agg(text, '' ORDER BY j) FILTER (is_final AND is_translation), '') AS tfin, coalesce(string_agg(text, '' ORDER BY j) FILTER (NOT is_final AND is_translation), '') AS tnon,
  list(speaker ORDER BY j) FILTER (is_final AND NOT is_translation) AS sp FROM k GROUP BY conv_id, event),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY event) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM (SELECT c.conv_id, c.event, coalesce(fin, '') AS fin, coalesce(non, '') AS non, coalesce(tfin, '') AS tfin, coalesce(tnon, '') AS tnon, sp FROM (SELECT DISTINCT conv_id, event FROM t) c LEFT JOIN g ON g.conv_id = c.conv_id AND g.event = c.event)),
r AS (
  SELECT conv_id, n, event, total, false AS cut, '' AS old, '' AS told, 0 AS old_chunk, 0 AS old_speaker, fin AS said, tfin AS translated, 0 AS chunk, coalesce(sp[-1], 0) AS speaker, fin || non AS shown, tfin || tnon AS tshown FROM e WHERE n = 1
  UNION ALL
  SELECT conv_id, n, event, total, cut, said, translated, chunk, speaker, CASE WHEN cut THEN fin ELSE said || fin END, CASE WHEN cut THEN tfin ELSE translated || tfin END, CASE WHEN cut THEN chunk + 1 ELSE chunk END, coalesce(sp[-1], speaker),
    CASE WHEN cut THEN '' ELSE said END || fin || non, CASE WHEN cut THEN '' ELSE translated END || tfin || tnon
  FROM (SELECT e.*, r.said, r.translated, r.chunk, r.speaker, r.said <> '' AND coalesce(len(list_filter(e.sp, lambda s: s <> r.speaker)), 0) > 0 AS cut FROM r JOIN e ON e.conv_id = r.conv_id AND e.n = r.n + 1)
), o AS (
  SELECT conv_id, event, 'flush' AS kind, old_chunk AS chunk, old_speaker AS speaker, old AS text, told AS translation FROM r WHERE cut
  UNION ALL SELECT conv_id, event, 'show', chunk, speaker, shown, tshown FROM r
  UNION ALL SELECT conv_id, event, 'end', chunk, speaker, said, translated FROM r WHERE n = total)
SELECT conv_id, CAST(event AS BIGINT) AS event, kind, CAST(chunk AS INT) AS chunk, CAST(speaker AS INT) AS speaker, md5(trim(text, ' ' || chr(10))) AS text, md5(nullif(trim(translation, ' ' || chr(10)), '')) AS translation FROM o WHERE trim(text, ' ' || chr(10)) <> ''""")
def token_stream(spark, sf):
    """Words as tokens, three an event: some not final, some of a translation, some mere marks, with speakers that change."""
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "w"))
    k = F.col("k")
    token = F.struct(k, F.when(k % 17 == 9, "<end>").otherwise(F.concat("w", F.lit(" "))).alias("text"), ((F.col("turn") + F.floor(k / 5)) % 3).cast("int").alias("speaker"), (k % 4 != 3).alias("is_final"), (k % 5 == 4).alias("is_translation"))
    events = words.groupBy("conv_id", (F.col("turn") * 1000 + F.floor(k / 3)).cast("long").alias("event")).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return M.shown(events, "conv_id").select("conv_id", "event", "kind", "chunk", "speaker", md5("text"), md5("translation"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total, CASE WHEN turn = 0 THEN 'add' ELSE ['append', 'replace', 'append', 'revert', 'add'][CAST(1 + (turn * 7 + conv_id) % 5 AS INT)] END AS edit, text, 'c' || (turn // 2) AS chunk FROM conversations),
r AS (
  SELECT conv_id, n, total, CASE WHEN edit = 'add' THEN [{'text': text, 'base': '', 'ids': [chunk]}] ELSE [] END AS parts FROM c WHERE n = 1
  UNION ALL
  SELECT conv_id, n, total, CASE WHEN edit = 'add' THEN parts || [{'text': text, 'base': '', 'ids': [chunk]}] WHEN len(parts) = 0 THEN parts WHEN edit = 'revert' AND l.base = '' THEN parts[1:len(parts)-1]
    WHEN edit = 'revert' THEN parts[1:len(parts)-1] || [{'text': l.base, 'base': '', 'ids': CASE WHEN len(l.ids) > 1 THEN l.ids[1:len(l.ids)-1] ELSE l.ids END}]
    ELSE parts[1:len(parts)-1] || [{'text': CASE WHEN edit = 'append' THEN l.text || ' ' || text WHEN l.base <> '' THEN l.base || ' ' || text ELSE text END, 'base': CASE WHEN edit = 'append' THEN l.text ELSE l.base END, 'ids': CASE WHEN list_contains(l.ids, chunk) THEN l.ids ELSE l.ids || [chunk] END}] END
  FROM (SELECT c.*, r.parts, r.parts[-1] AS l FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1)
), u AS (SELECT conv_id, unnest(parts) AS p, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS part FROM r WHERE n = total)
SELECT conv_id, part, md5(p.text) AS text, array_to_string(p.ids, ',') AS ids FROM u""")
def text_edits(spark, sf):
    """Each turn edits the last part of its transcript."""
    c = table(spark, sf, "conversations")
    edit = F.when(F.col("turn") == 0, "add").otherwise(F.element_at(F.array(*map(F.lit, ("append", "replace", "append", "revert", "add"))), ((F.col("turn") * 7 + F.col("conv_id")) % 5 + 1).cast("int")))
    edits = c.select("conv_id", "turn", edit.alias("edit"), "text", F.concat(F.lit("c"), F.floor(F.col("turn") / 2).cast("string")).alias("chunk"))
    return M.edited(edits, "conv_id", "turn").select("conv_id", "part", md5("text"), F.array_join("ids", ",").alias("ids"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, coalesce(lead(CASE WHEN turn % 4 = 3 THEN '' ELSE text END) OVER (PARTITION BY conv_id ORDER BY turn), text) AS tr FROM conversations),
s AS (SELECT conv_id, turn, string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS o, trim(tr, ' ' || chr(10)) AS tr, tr AS raw FROM c),
t AS (SELECT *, list_filter(string_split(regexp_replace(tr, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS own, list_filter(regexp_split_to_array(tr, '\s+'), lambda x: x <> '') AS w, list_sum(list_transform(o, lambda x: length(x))) AS total FROM s),
u AS (SELECT *, list_transform(o, lambda x: greatest(1, CAST(floor(length(x) / total * len(w) + 0.5) AS INT))) AS k FROM t),
v AS (SELECT *, list_transform(range(1, len(o) + 1), lambda i: coalesce(list_sum(k[1:i-1]), 0)) AS b FROM u)
SELECT conv_id, turn, len(o) AS sentences, md5(array_to_string(CASE WHEN len(o) = 1 THEN [raw] WHEN tr = '' OR total = 0 THEN list_transform(o, lambda x: '') WHEN len(own) = len(o) THEN own
  ELSE list_transform(range(1, len(o) + 1), lambda i: array_to_string(w[b[i] + 1:CASE WHEN i = len(o) THEN len(w) ELSE b[i] + k[i] END], ' ')) END, '|')) AS pieces FROM v""")
def aligned_translations(spark, sf):
    """Each turn's sentences with the next turn as their translation; some have none."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    given = F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.coalesce(F.lead(given).over(w), "text").alias("tr"))
    c = c.withColumn("o", F.split(F.btrim("text", F.lit(T.BLANK)), M.SENTENCE_END))
    return c.select("conv_id", "turn", F.size("o").cast("long").alias("sentences"), F.md5(F.array_join(M.aligned_translation(F.col("o"), F.col("tr")), "|").cast("binary")).alias("pieces"))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT a.user_id, any_value(a.n) AS n, b.i - a.i AS lag, sum(a.value * b.value) AS power FROM e a JOIN e b ON b.user_id = a.user_id AND b.i - a.i BETWEEN 2 AND 31 GROUP BY a.user_id, b.i - a.i),
u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT user_id, max(power) AS most FROM p GROUP BY user_id)
SELECT u.user_id, u.n, CAST(l.lag AS INT) AS lag, round(l.most + 1.234567e-5, 2) AS power FROM u LEFT JOIN (SELECT p.user_id, min(p.lag) AS lag, any_value(most) AS most FROM p JOIN m ON m.user_id = p.user_id AND p.power >= m.most * (1 - 1e-12) GROUP BY p.user_id) l ON l.user_id = u.user_id""")
def value_lags(spark, sf):
    """The lag from 2 to 31 at which each user's values resemble themselves most."""
    return V.best_lag(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 2, 32).withColumn("power", F.round(F.col("power") + 1.234567e-5, 2))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, text AS t FROM conversations),
a AS (SELECT conv_id, i // 2 AS i, any_value(n) AS n, CASE WHEN any_value(n) > 1 THEN md5(string_agg(t, chr(10) ORDER BY i)) ELSE any_value(t) END AS t FROM c GROUP BY conv_id, i // 2),
b AS (SELECT conv_id, i // 2 AS i, any_value(n) AS n, CASE WHEN any_value(n) > 2 THEN md5(string_agg(t, chr(10) ORDER BY i)) ELSE any_value(t) END AS t FROM a GROUP BY conv_id, i // 2),
d AS (SELECT conv_id, i // 2 AS i, any_value(n) AS n, CASE WHEN any_value(n) > 4 THEN md5(string_agg(t, chr(10) ORDER BY i)) ELSE any_value(t) END AS t FROM b GROUP BY conv_id, i // 2)
SELECT conv_id, md5(t) AS text, CAST(CASE WHEN n = 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END AS INT) AS levels FROM d""")
def summary_levels(spark, sf):
    """Turns summed up two at a time, and the results again, up to one for each conversation (of 8 turns at most)."""
    told = P.summarised(table(spark, sf, "conversations"), "conv_id", "turn", "text", lambda texts: F.md5(F.array_join(texts, "\n").cast("binary")), group=2)
    return told.select("conv_id", md5("text"), "levels")


@query("""WITH RECURSIVE e AS (SELECT label, vec_id, CASE WHEN vec_id % 7 <> 3 THEN CAST(embedding AS DOUBLE[]) END AS v, [CAST(vec_id % 13 AS DOUBLE), CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(vec_id % 5 AS DOUBLE) END] AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT label, vec_id, n, v, s FROM e WHERE n = 1 UNION ALL
  SELECT e.label, e.vec_id, e.n, CASE WHEN e.v IS NULL THEN r.v WHEN r.v IS NULL THEN e.v ELSE list_transform(list_zip(r.v, e.v), lambda z: 0.9 * z[1] + 0.1 * z[2]) END,
    [coalesce(0.88 * r.s[1] + 0.12 * e.s[1], r.s[1], e.s[1]), coalesce(0.88 * r.s[2] + 0.12 * e.s[2], r.s[2], e.s[2])] FROM r JOIN e ON e.label = r.label AND e.n = r.n + 1)
SELECT label, vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS length, round(v[1] + 1.234567e-7, 5) AS first, round(s[1] + 1.234567e-7, 5) AS a, round(s[2] + 1.234567e-7, 5) AS b FROM r""")
def voice_average(spark, sf):
    """The moving average of each label's vectors and of two statistics; some vectors and statistics are missing."""
    e = table(spark, sf, "embeddings")
    vector = F.when(F.col("vec_id") % 7 != 3, F.transform("embedding", lambda x: x.cast("double")))
    stats = F.array((F.col("vec_id") % 13).cast("double"), F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 5).cast("double")))
    told = M.averaged_vectors(e.select("label", F.col("vec_id").cast("long").alias("event_id"), vector.alias("vector"), stats.alias("stats")), "label", ["event_id"])
    off = lambda c: F.round(c + 1.234567e-7, 5)
    return told.select("label", F.col("event_id").alias("vec_id"), F.round(F.sqrt(V.dot(F.col("vector"), F.col("vector"))), 5).alias("length"), off(F.get("vector", F.lit(0))).alias("first"), off(F.get("stats", F.lit(0))).alias("a"), off(F.get("stats", F.lit(1))).alias("b"))


@query("""SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%H:%M %d/%m/%Y') AS hanoi, strftime(ts + INTERVAL 330 MINUTE, '%m/%d/%Y, %I:%M %p') AS delhi FROM events""")
def local_dates(spark, sf):
    """The times of events as two lists show them, in two time zones."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", T.local_time(at, "Asia/Ho_Chi_Minh", "vi").alias("hanoi"), T.local_time(at, "Asia/Kolkata").alias("delhi"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_type || '|x' || event_id END AS items, CASE WHEN event_id % 4 = 3 OR event_id % 3 = 0 THEN '' ELSE event_type || '/' || CASE WHEN event_id % 2 = 0 THEN 'Ann' ELSE '' END || '/' || (event_id % 9) END AS actions FROM events""")
def typed_items(spark, sf):
    """Minutes' lists as JSON, with elements of the wrong kinds; every fourth is no list."""
    e = table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    items = F.when(F.col("event_id") % 4 == 3, '{"a":1}').otherwise(F.concat(F.lit('[" '), "event_type", F.lit(' ",1,null,"  ",["z"],{"b":2},"x'), i, F.lit('"]')))
    task = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type"))
    who = F.when(F.col("event_id") % 2 == 0, '"Ann "').otherwise("null")
    actions = F.when(F.col("event_id") % 4 == 3, '"none"').otherwise(F.concat(F.lit('["x",null,{"task":"'), task, F.lit('","assignee":'), who, F.lit(',"deadline":'), (F.col("event_id") % 9).cast("string"), F.lit('},{"assignee":"B"}]')))
    line = lambda r: F.concat(r["task"], F.lit("/"), r["assignee"], F.lit("/"), r["deadline"])
    return e.select("event_id", F.array_join(T.text_items(items), "|").alias("items"), F.array_join(F.transform(T.action_items(actions), line), "|").alias("actions"))


@query("""SELECT event_id, event_type AS kept, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS both, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'left' END AS maybe, 3 AS fields FROM events""")
def merged_drafts(spark, sf):
    """Fields of drafts under fields that come later: those that come stand, even as nulls."""
    e = table(spark, sf, "events")
    left = F.create_map(F.lit("kept"), F.col("event_type"), F.lit("both"), F.lit("old"), F.lit("maybe"), F.lit("left"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    both = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("both"), F.lit("new"))).otherwise(none)
    maybe = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("maybe"), F.lit(None).cast("string"))).otherwise(none)
    told = e.select("event_id", P.merged_fields(left, F.map_concat(both, maybe)).alias("m"))
    return told.select("event_id", F.col("m")["kept"].alias("kept"), F.col("m")["both"].alias("both"), F.col("m")["maybe"].alias("maybe"), F.size("m").alias("fields"))
