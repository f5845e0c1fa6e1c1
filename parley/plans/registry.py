"""Every named query of the library and, where SQL can express it, its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import transcript as P
from parley.operators import vectors as V
from parley.sources.tables import table
from parley.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


@query(f"""SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS transcript, count(*) AS turns, CAST(sum({WORDS}) AS BIGINT) AS words, count(DISTINCT role) AS speakers
FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def conversation_digest(spark, sf):
    """Clean, flatten and count: one row a conversation."""
    return P.digest(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def flatten_transcript(spark, sf):
    return P.flatten(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query(f"SELECT conv_id, turn, {WORDS} AS words FROM conversations")
def word_count(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("words"))


@query(r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[.!?,]\s+|\n\s+')) + 1 AS INT) AS sentences FROM conversations")
def sentence_count(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.sentence_count(F.col("text")).alias("sentences"))


@query("SELECT conv_id, turn, role FROM conversations WHERE lower(text) LIKE '%the%'")
def title_search(spark, sf):
    """Every match of a case-insensitive search."""
    return table(spark, sf, "conversations").where(F.lower("text").like("%the%")).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations WHERE lower(text) LIKE '%the%'")
def title_search_all(spark, sf):
    """Every match, unordered."""
    return table(spark, sf, "conversations").where(F.lower("text").like("%the%")).select("conv_id", "turn", "role")


POSITIVES = [(-1, "Thank you for watching!"), (-2, "..."), (-3, " , , "), (-4, "www.example.com"), (-5, "x"), (-6, "Please subscribe"), (-7, "kept text")]


def _spoken(positives: list) -> str:
    """The oracle of the filter of inventions over all documents and some texts more."""
    return (
        "WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in positives) + ") v(doc_id, text))"
        " SELECT doc_id FROM d WHERE NOT (length(trim(text)) <= 3 OR regexp_matches(trim(text), '" + "|".join(T.INVENTED).replace("'", "''").replace(r"\w", r"[\pL\pM\pN_]") + "', 'i'))"
    )


@query(_spoken(POSITIVES))
def hallucination_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(POSITIVES, "doc_id long, text string"))
    return docs.where(~T.invented(F.col("text"))).select("doc_id")


#: One text for each pattern, and some that stay.
ALL_POSITIVES = [(-100 - i, t) for i, t in enumerate((
    "Hãy SUBSCRIBE cho kênh", "ghiền mì gõ", "để không bỏ lỡ nhưng video hấp dẫn", "đừng quên like và subscribe", "Nhấn nút ĐĂNG KÝ", "CẢM ƠN các bạn đã theo dõi", "hãy đăng ký kênh", "xin chào các bạn đến với kênh", "hẹn gặp lại ở video",
    "like it, share it, subscribe", "Thank you for watching", "please subscribe", "like and subscribe", "dont forget to subscribe", "hit the bell", "© 2020 All Rights Reserved", "Subtitles by x", "see www.example.com there",
    " Meeting. ", "meeting discussion", "Cuộc họp công việc.", ".....", ",,,,,", "abc", " ab ", "abcd", "meetings", "a meeting.", "the www. of old", "share and like",
))]


@query(_spoken(ALL_POSITIVES))
def hallucination_filter_all(spark, sf):
    """The rule of hallucination_filter, with an oracle and positives for each of its patterns."""
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(ALL_POSITIVES, "doc_id long, text string"))
    return docs.where(~T.invented(F.col("text"))).select("doc_id")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_hash(spark, sf):
    return P.first_by_hash(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def pending_anti_join(spark, sf):
    """Labels are saved results, those of toxic documents without text: they are done again."""
    saved = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, "text").otherwise("").alias("text"))
    return P.pending(table(spark, sf, "documents").select("doc_id"), saved, "doc_id", "text")


@query("SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 1 - l.quality ELSE l.quality END AS quality FROM labels l")
def merge_saved_new(spark, sf):
    """All labels are saved; those of toxic documents come anew and win."""
    labels = table(spark, sf, "labels")
    return P.merge_saved(labels, labels.where("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("quality")), "doc_id", "quality")


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def merge_saved_new_all(spark, sf):
    """All documents, saved with their length, against all labels, whose quality wins."""
    saved, new = table(spark, sf, "documents"), table(spark, sf, "labels")
    return P.merge_saved(saved.select("doc_id", F.col("n_chars").alias("value")), new.select("doc_id", F.col("quality").cast("bigint").alias("value")), "doc_id", "value")


@query("""WITH e AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(CASE WHEN n > 1 AND p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS run FROM e)
SELECT user_id, run, event_type, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, run, event_type""")
def speaker_runs(spark, sf):
    return P.runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


PAIRS = [("hello world again", "world again and on"), ("abcdef", "abcdef"), ("abcde", "abcde"), ("none", "other"), ("x", "")]


@query("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") t(a, b)), c AS (SELECT a, b FROM v UNION ALL SELECT text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations) SELECT md5(a) AS a, md5(b) AS b, coalesce(list_max(list_filter(range(6, least(120, length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) AS k FROM c WHERE b IS NOT NULL")
def overlap_len(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    c = spark.createDataFrame(PAIRS, "a string, b string").union(c).where("b is not null")
    return c.select(F.md5(F.col("a").cast("binary")).alias("a"), F.md5(F.col("b").cast("binary")).alias("b"), P.overlap("a", "b").cast("bigint").alias("k"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""")
def pairwise_cosine(spark, sf):
    """All pairs of vectors of one label."""
    e = table(spark, sf, "embeddings")
    return V.pairs(e, "vec_id", "label", "embedding").select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("""WITH l AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM l GROUP BY 1, 2),
h AS (SELECT label, list(m ORDER BY i) AS centroid FROM m GROUP BY label),
s AS (SELECT vec_id, h.label, round(list_dot_product(CAST(embedding AS DOUBLE[]), centroid) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(centroid, centroid)), 6) AS score FROM embeddings, h),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s)
SELECT vec_id, max(label) FILTER (k = 1) AS label_1, round(max(score) FILTER (k = 1) - max(score) FILTER (k = 2), 6) AS gap FROM r GROUP BY vec_id""")
def top2_gap(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.top2(e.select("vec_id", "embedding"), "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label")


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS i FROM events GROUP BY 1, 2), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, i) AS speaker_no FROM f)
SELECT event_id, user_id, event_type, speaker_no FROM events JOIN r USING (user_id, event_type)""")
def first_appearance_rank(spark, sf):
    return P.appearance(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "speaker_no")


@query("""WITH d AS (SELECT user_id, value, value - lag(value) OVER w AS delta, sign(value - 50) <> sign(lag(value) OVER w - 50) AS crossed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT user_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90, round(stddev_pop(delta), 4) AS delta_std,
  round(avg(abs(value - 50)) + 1.234567e-7, 4) AS energy, round(avg(CAST(crossed AS INT)) + 1.234567e-7, 5) AS zcr, count(*) AS n FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN n >= 60 THEN mean END AS mean, CASE WHEN n >= 60 THEN std END AS std, CASE WHEN n >= 60 THEN median END AS median, CASE WHEN n >= 60 THEN p10 END AS p10, CASE WHEN n >= 60 THEN p90 END AS p90, CASE WHEN n >= 60 THEN delta_std END AS delta_std, CASE WHEN n >= 60 THEN energy END AS energy, CASE WHEN n >= 60 THEN zcr END AS zcr, n FROM u""")
def pitch_like_stats(spark, sf):
    """Statistics of each user's values, their mean distance from 50 and how often they cross it; null where there are too few (60 here, 6 frames for a pitch)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(w)
    d = table(spark, sf, "events").select("user_id", "value", (F.col("value") - before).alias("delta"), (F.signum(F.col("value") - 50) != F.signum(before - 50)).cast("int").alias("crossed"))
    p = lambda q: F.percentile("value", F.lit(q))
    stats = {"mean": F.avg("value"), "std": F.stddev_pop("value"), "median": p(0.5), "p10": p(0.1), "p90": p(0.9), "delta_std": F.stddev_pop("delta"), "energy": F.avg(F.abs(F.col("value") - 50)) + 1.234567e-7}
    enough = lambda c: F.when(F.count("*") >= 60, c)
    return d.groupBy("user_id").agg(*[enough(F.round(c, 4)).alias(name) for name, c in stats.items()], enough(F.round(F.avg("crossed") + 1.234567e-7, 5)).alias("zcr"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chars FROM conversations")
def running_bytes(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("chars"))


@query("SELECT source, doc_id // 50 AS meeting, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size, count(*) <= 10 AND max(n_chars) <= 1048576 AND sum(n_chars) <= 2097152 AS allowed, sum(n_chars) > 409600 AS warned FROM documents GROUP BY 1, 2")
def attachment_quota(spark, sf):
    """Each meeting's attachments: may they be uploaded, and are they more than a model takes well (400 KB)?"""
    size = F.sum("n_chars")
    meeting = F.floor(F.col("doc_id") / 50).alias("meeting")
    return table(spark, sf, "documents").groupBy("source", meeting).agg(F.count("*").alias("files"), size.alias("size"), ((F.count("*") <= 10) & (F.max("n_chars") <= 1048576) & (size <= 2097152)).alias("allowed"), (size > 409600).alias("warned"))


@query("SELECT conv_id, CAST(floor(turn / 4) AS BIGINT) AS part, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1, 2")
def map_reduce_groups(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 4).alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", "part", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


#: Rows that show what becomes of odd times.
TIMES = [(-1, "NaN"), (-2, "-5.5"), (-3, "59.99"), (-4, "60"), (-5, "6000.5"), (-6, "0")]
GIVEN_TIMES = "(SELECT event_id, value FROM events UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST('{v}' AS DOUBLE))" for i, v in TIMES) + ") v(event_id, value))"


@query(f"WITH t AS (SELECT event_id, CASE WHEN isnan(value) OR isinf(value) OR value < 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS s FROM {GIVEN_TIMES}) SELECT event_id, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM t")
def fmt_mmss(spark, sf):
    times = spark.createDataFrame([(i, float(v)) for i, v in TIMES], "event_id long, value double")
    return table(spark, sf, "events").select("event_id", "value").union(times).select("event_id", T.clock(F.col("value")).alias("clock"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


KEYS = ["nvidia_api_key", "llm_api_key", "soniox_api_key", "stt_language"]


@query("WITH s AS (SELECT c_custkey, list_value(" + ", ".join(f"'{k}'" for k in KEYS) + ")[1 + c_custkey % 4] AS key, left(c_name, 4 + c_custkey % 15) AS value FROM customer) SELECT c_custkey, CASE WHEN key IN ('nvidia_api_key', 'llm_api_key', 'soniox_api_key') AND length(value) >= 8 THEN left(value, 4) || '***' || right(value, 4) ELSE value END AS masked FROM s")
def mask_secret(spark, sf):
    """Settings under secret and other keys, with values of 4 to 18 characters."""
    key = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", T.masked(key, F.left("c_name", F.col("c_custkey").cast("int") % 15 + 4)).alias("masked"))


#: Names that show what becomes of odd ones.
ODD_NAMES = ["", ". \t.", "cafe\u0301.mp3", 'a<b>:"c|d?e*.wav', "x" * 250 + ".m4a", "y" * 300, "." + "z" * 220 + "." + "s" * 30]
CLEAN = """regexp_replace(nfc_normalize(n), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g')"""


@query("WITH g AS (SELECT page_id, url AS n FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{n}')" for i, n in enumerate(ODD_NAMES)) + f") v(page_id, n)), c AS (SELECT page_id, trim({CLEAN}, '. ' || chr(9)) AS c FROM g), p AS (SELECT page_id, c, left(regexp_extract(c, '^(?s:.)*(\\.[^.]*)$', 1), 20) AS x, regexp_replace(c, '\\.[^.]*$', '') AS stem FROM c) SELECT page_id, coalesce(nullif(CASE WHEN length(c) > 200 THEN left(stem, 200 - length(x)) || x ELSE c END, ''), 'upload.bin') AS name FROM p")
def safe_filename(spark, sf):
    odd = spark.createDataFrame([(-1 - i, n) for i, n in enumerate(ODD_NAMES)], "page_id long, url string")
    return table(spark, sf, "pages").select("page_id", "url").union(odd).select("page_id", T.upload_name(F.col("url")).alias("name"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY user_id")
def job_latest_state(spark, sf):
    return jobs.latest(table(spark, sf, "events"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_1h(spark, sf):
    return jobs.tumbling(table(spark, sf, "events")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def session_30m(spark, sf):
    return jobs.sessions(table(spark, sf, "events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


@query("WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE trim(text) <> '') SELECT conv_id, turn, round(30.0 + 600.0 / n * i, 4) AS start, CASE WHEN i = n - 1 THEN 630.0 ELSE round(30.0 + 600.0 / n * (i + 1), 4) END AS stop FROM s")
def apportion_time(spark, sf):
    """Segments that are not blank share the time from 30 to 630 seconds equally."""
    return P.apportioned(table(spark, sf, "conversations").where(F.trim("text") != "").select("conv_id", "turn"), "conv_id", "turn", 30.0, 630.0)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def last_n_ring(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def star_pricing(spark, sf):
    d = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc_price"), F.count("*").alias("count_order"))


@query("SELECT conv_id, turn, CASE WHEN turn < 3 THEN text ELSE 'new ' || text END AS text FROM conversations")
def insert_or_ignore(spark, sf):
    """Rows that are there stay as they are; only new keys are added."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return P.insert_new(c.where("turn < 3"), c.withColumn("text", F.concat(F.lit("new "), "text")), ["conv_id", "turn"])


@query("SELECT conv_id, turn, CASE WHEN turn >= 2 THEN 'new ' || text ELSE text END AS text, CASE WHEN turn < 3 THEN length(text) ELSE 0 END AS end_ms, CAST(CASE WHEN turn >= 2 THEN turn * 0.5 ELSE turn END AS DOUBLE) AS embedding, CASE WHEN turn >= 2 THEN 2 ELSE 1 END AS updated_at FROM conversations")
def upsert_chunks(spark, sf):
    """A chunk's text, embedding and time of change are updated in place; a chunk without a plan gets bounds of 0."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.length("text").cast("bigint").alias("end_ms"), F.array(F.col("turn").cast("double")).alias("embedding"), F.lit(1).alias("updated_at"))
    new = c.where("turn >= 2").select("conv_id", "turn", F.concat(F.lit("new "), "text").alias("text"), F.transform("embedding", lambda x: x * 0.5).alias("embedding"), F.lit(2).alias("updated_at"))
    return P.upsert(c.where("turn < 3"), new, ["conv_id", "turn"], ["text", "embedding", "updated_at"], {"end_ms": 0}).withColumn("embedding", F.get("embedding", F.lit(0)))


@query("SELECT conv_id, turn, CASE WHEN turn < 3 THEN text ELSE 'new ' || text END AS text FROM conversations")
def insert_or_ignore_all(spark, sf):
    """The earlier turns are there; every row of the table is given again."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return P.insert_new(c.where("turn < 3"), c.withColumn("text", F.concat(F.lit("new "), "text")), ["conv_id", "turn"])


@query("SELECT conv_id, turn, 'new ' || text AS text, CASE WHEN turn < 3 THEN length(text) ELSE 0 END AS end_ms FROM conversations")
def upsert_chunks_all(spark, sf):
    """The earlier turns are there; every row of the table brings its text anew."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.length("text").cast("bigint").alias("end_ms"))
    return P.upsert(c.where("turn < 3"), c.withColumn("text", F.concat(F.lit("new "), "text")), ["conv_id", "turn"], ["text"], {"end_ms": 0})


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def settings_last_write(spark, sf):
    return P.last_written(table(spark, sf, "events"), "event_type", ["ts", "event_id"], "value")


@query("""WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND length(text) > 300)
SELECT 'turns' AS kind, conv_id, count(*) AS rows FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY conv_id
UNION ALL SELECT 'documents', doc_id, count(*) FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM gone) GROUP BY doc_id
UNION ALL SELECT 'labels', doc_id, count(*) FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM gone) GROUP BY doc_id""")
def cascade_delete(spark, sf):
    """Meetings are deleted, and the rows of all their children with them: what is left, by kind and meeting."""
    c = table(spark, sf, "conversations")
    gone = c.where("role = 'user' and length(text) > 300").select("conv_id").distinct()
    children = {"turns": c.select("conv_id"), "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id")), "labels": table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))}
    left = P.cascaded(gone, children, "conv_id")
    told = [df.groupBy("conv_id").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "conv_id", "rows") for kind, df in left.items()]
    return told[0].unionByName(told[1]).unionByName(told[2])
