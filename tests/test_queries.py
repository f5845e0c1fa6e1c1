"""Every query with an oracle against DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import numpy as np
import pytest

from parley.plans import live, meetings  # noqa: F401
from parley.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (int, bool)):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = QUERIES[name](spark, FOLDER)
    told = con.execute(ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    assert rows(got.select(*columns).collect()) == rows(told.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count()


def test_stream_equals_batch(spark, tmp_path):
    from parley.streaming import jobs

    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="400 days")
    job = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    job.awaitTermination()
    shape = lambda df: sorted((r.w.start, r.event_type, r.events) for r in df.collect())
    assert shape(spark.table("hours")) == shape(jobs.tumbling(events))


def test_assembled_texts_are_trimmed_as_in_sql(spark, tmp_path):
    """Laps that begin with a line break, a tab or a no-break space: SQL takes off the spaces alone."""
    long = "the agenda of this meeting and what was said about it.\nIts end of some more words than that."
    texts = ["the first words.\nThe second line ends it here, as agreed", " \tTabs lead here \n", "\xa0\u3000wide spaces\u2003", "odd\n", long, "\nand the rest of it", "\n", "\n \x1f"]
    rows = [(c, t, ("user", "assistant", "tool")[(c + t) % 3], texts[(c * 3 + t * (1 + c % 2)) % len(texts)]) for c in range(8) for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    told = con.execute(ORACLES["assemble_transcript"])
    columns = [c[0] for c in told.description]
    want = told.fetchall()
    got = [tuple(r) for r in QUERIES["assemble_transcript"](spark, str(tmp_path)).select(*columns).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_pairs_of_many_blocks_are_whole_and_small(spark, tmp_path):
    """All pairs in blocks of any size, with ids beyond 2^53, short vectors as zero, and files of fewer bytes a pair than a cosine takes."""
    from pyspark.sql import functions as F

    from parley.operators import vectors as V

    rng = np.random.default_rng(5)
    points = rng.standard_normal((1_500, 64)).astype(np.float32)
    points[3] = 1e-10
    ids = [2**60 + i for i in range(len(points))]
    df = spark.createDataFrame([(i, p.tolist(), 1) for i, p in zip(ids, points)], "vec_id long, embedding array<float>, label int")
    unit = points.astype(float) / np.where(np.linalg.norm(points.astype(float), axis=1) < 1e-8, 1, np.linalg.norm(points.astype(float), axis=1))[:, None]
    want = unit @ unit.T
    for block in (400, 2_000):
        V.pairs(df, "vec_id", "label", "embedding", block).select("a", "b", F.round("cosine", 5).alias("cosine")).coalesce(1).write.parquet(str(tmp_path / str(block)))
        got = spark.read.parquet(str(tmp_path / str(block))).toPandas()
        a, b = got["a"].to_numpy() - 2**60, got["b"].to_numpy() - 2**60
        assert (a < b).all() and len(set((a * len(points) + b).tolist())) == len(got) == len(points) * (len(points) - 1) // 2
        assert np.abs(got["cosine"].to_numpy() - want[a, b]).max() < 1e-5
        assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{block}/*.parquet")) < 5 * len(got)


def test_pairs_take_little_more_than_their_cosines(spark, tmp_path):
    """Files of all pairs of one label, over several blocks: less than three bytes a pair, of which a cosine takes two."""
    from pyspark.sql import functions as F

    from parley.operators import vectors as V

    rng = np.random.default_rng(6)
    points = rng.standard_normal((3_100, 64)).astype(np.float32)
    df = spark.createDataFrame([(3 * i, p.tolist(), 1) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label int")
    V.pairs(df, "vec_id", "label", "embedding").select("a", "b", F.round("cosine", 5).alias("cosine")).coalesce(1).write.parquet(str(tmp_path / "pairs"))
    n = len(points) * (len(points) - 1) // 2
    assert spark.read.parquet(str(tmp_path / "pairs")).where("a < b").distinct().count() == n
    assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/pairs/*.parquet")) < 3 * n
