"""Queries that return every row."""

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def table_of(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_title_search_returns_every_match(spark):
    want = [(r.conv_id, r.turn) for r in table_of(spark, "conversations").collect() if "the" in r.text.lower()]
    got = [(r.conv_id, r.turn) for r in QUERIES["title_search_all"](spark, FOLDER).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_writes_reach_every_row(spark):
    for name, key, source in [("insert_or_ignore_all", ["conv_id", "turn"], "conversations"), ("upsert_chunks_all", ["conv_id", "turn"], "conversations"), ("merge_saved_new_all", ["doc_id"], "documents")]:
        want = sorted(map(tuple, table_of(spark, source).select(*key).collect()))
        assert sorted(map(tuple, QUERIES[name](spark, FOLDER).select(*key).collect())) == want, name


INVENTIONS = [
    "Hãy SUBSCRIBE cho kênh", "ghiền mì gõ", "để không bỏ lỡ nhưng video hấp dẫn", "đừng quên like và subscribe", "Nhấn nút ĐĂNG KÝ", "CẢM ƠN các bạn đã theo dõi", "hãy đăng ký kênh", "xin chào các bạn đến với kênh", "hẹn gặp lại ở video",
    "like it, share it, subscribe", "Thank you for watching", "please subscribe", "like and subscribe", "dont forget to subscribe", "don't forget to subscribe", "hit the bell", "© 2020 All Rights Reserved", "subtitle by x", "Subtitles by x",
    "see www.example.com there", " Meeting.\n", "meeting discussion", "Cuộc họp công việc.", ".....", ",,,,,", "abc", " 　ab \t", "", None,
]
SPOKEN = ["để không bỏ lỡ những video hấp dẫn", "abcd", "meetings", "a meeting.", "the www. of old", "., .,", "like\nshare subscribe", "share and like", "subscribed", "đăng ký"]


def test_each_invention_is_dropped(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(INVENTIONS + SPOKEN)], "i int, text string")
    kept = [r.i for r in rows.where(~T.invented(F.col("text"))).orderBy("i").collect()]
    assert kept == list(range(len(INVENTIONS), len(INVENTIONS) + len(SPOKEN)))
