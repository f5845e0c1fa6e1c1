"""Fill-in-the-middle: documents cut in three at random places and put together in another order.

An automaton over UTF-8 bytes counts code points and finds the sentinels. Documents up to GIANT bytes are scanned where they lie,
many side by side, as one string with a reset before each of them. A giant document is dealt out in chunks of CHUNK bytes, cut
anywhere: each chunk gives, for every state it may begin in, the state it ends in and its counts (Automaton.summary);
these are composed in order, which gives each chunk's true first state and the code points before it; then the chunks that
hold the cuts are asked for their place. Both ways give the same rows, and no shuffle carries a document that is not giant.

Defined results: a null text counts as an empty one; a text that is empty or holds a sentinel stays plain; a null id is
hashed like an empty number. Repeated rows, whole or by id, are each turned for themselves, in the same way if their ids
are equal. Other columns of the documents, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.automaton import Automaton
from parley.llm.scratch import Scratch
from parley.llm.words import raw, slices

GIANT, CHUNK = 1 << 23, 1 << 20
#: Documents that are left plain, and of the others those put together with the suffix first, by the hundred.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of cuts of giant documents that are broadcast at most, of about 200 bytes each.
NEAR = 200_000

_RESET = 0xFF


def _automaton() -> Automaton:
    """States: 0 between code points, 1 behind <, 2 behind < and P, S or M, 3 to 5 with one to three bytes of a code point to come.
    Counters: code points that end here, sentinels that end here."""
    kinds = {"other": 0, "<": 1, "letter": 2, ">": 3, "next": 4, "two": 5, "three": 6, "four": 7, "reset": 8}
    classes = [0] * 128 + [4] * 64 + [5] * 32 + [6] * 16 + [7] * 8 + [8] * 8
    for letter in "PSM":
        classes[ord(letter)] = kinds["letter"]
    classes[ord("<")], classes[ord(">")] = kinds["<"], kinds[">"]
    step = [[0, 1, 2 if s == 1 else 0, 0, max(0, s - 1) if s > 3 else 0, 3, 4, 5, 0] for s in range(6)]
    points = [[1, 1, 1, 1, int(s == 3), 0, 0, 0, 0] for s in range(6)]
    sentinels = [[0, 0, 0, int(s == 2), 0, 0, 0, 0, 0] for s in range(6)]
    return Automaton(classes, step, [points, sentinels])


AUTOMATON = _automaton()


def _draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits that the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _form(points: int, sentinels: int, h3: int, h4: int) -> str:
    return "plain" if not points or sentinels or h3 % 100 >= PLAIN_FROM else "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"


def _turned(form: str, text: bytes, a: int, b: int) -> bytes:
    """A text cut at the bytes a and b, in its form."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        draws = np.stack([batch.column(f"h{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5)], 1)
        for first, last in slices(offsets, 2_000_000):
            own = offsets[first : last + 1] - offsets[first]
            part = data[offsets[first] : offsets[last]]
            count = last - first
            points, sentinels = AUTOMATON.added(np.insert(part, own[:-1], _RESET))
            ends = np.flatnonzero(points)  # places of the string with resets
            before = np.searchsorted(ends, own + np.arange(count + 1))
            marks = np.searchsorted(np.flatnonzero(sentinels), own + np.arange(count + 1))
            whole, rows = part.tobytes(), []
            for i in range(count):
                n, (h1, h2, h3, h4) = int(before[i + 1] - before[i]), draws[first + i].tolist()
                form = _form(n, int(marks[i + 1] - marks[i]), h3, h4)
                lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
                # Code point k of the row ends at this byte of the row; row i stands behind i + 1 resets.
                a, b = (int(ends[before[i] + k - 1]) - i - int(own[i]) if k else 0 for k in (lo, hi))
                text = whole[own[i] : own[i + 1]]
                rows.append((n, form, lo, hi - lo, _turned(form, text, a, b)))
            n, form, lo, middle, output = zip(*rows)
            plain = np.array([f == "plain" for f in form])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, count), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(lo, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [AUTOMATON.summary(np.frombuffer(b, np.uint8)) for b in batch.column("bytes").to_pylist()]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "digest", "k")), pa.array([t[0] for t in told], longs), *(pa.array([t[1][c] for t in told], longs) for c in (0, 1))], ["doc_id", "digest", "k", "after", "points", "sentinels"]
        )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte of a chunk behind which its given code point ends."""
    for batch in batches:
        at = [int(np.flatnonzero(AUTOMATON.added(np.frombuffer(b, np.uint8), s)[0])[r - 1]) + 1 for b, s, r in zip(*(batch.column(c).to_pylist() for c in ("bytes", "state", "rank")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "k", "cut")), pa.array(at, pa.int64())], ["doc_id", "digest", "k", "cut", "at"])


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= NEAR else df


def _giant(docs: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """docs: doc_id, text, h1 to h4, all giant. Equal rows share their chunks' summaries and their cuts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    pieces = named.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))).alias("k"))
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("k") * chunk + 1, F.lit(chunk)).alias("bytes")
    dealt = pieces.select("doc_id", "digest", "k", bytes_of).repartition("doc_id", "digest", "k")
    told = dealt.mapInArrow(_summaries, f"doc_id {kind}, digest string, k int, after array<long>, points array<long>, sentinels array<long>").dropDuplicates(["doc_id", "digest", "k"])
    # A text holds 2 GB at most, so a document has some thousand chunks at most.
    chunks = told.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("k", "after", "points", "sentinels"))).alias("chunks"))
    entries = F.expr(
        """aggregate(chunks, named_struct('state', 0L, 'points', 0L, 'sentinels', 0L, 'entries', cast(array() as array<struct<k: int, state: bigint, before: bigint, points: bigint>>)),
        (s, c) -> named_struct('state', c.after[int(s.state)], 'points', s.points + c.points[int(s.state)], 'sentinels', s.sentinels + c.sentinels[int(s.state)],
        'entries', concat(s.entries, array(named_struct('k', c.k, 'state', s.state, 'before', s.points, 'points', c.points[int(s.state)])))))"""
    )
    whole = chunks.select("doc_id", "digest", entries.alias("s"), *_draws(F.col("doc_id"), _SEED)).select("doc_id", "digest", F.col("s.points").alias("n"), F.col("s.sentinels").alias("sentinels"), "s.entries", "h1", "h2", "h3", "h4")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    form = F.when((F.col("n") == 0) | (F.col("sentinels") > 0) | (F.col("h3") % 100 >= PLAIN_FROM), "plain").when(F.col("h4") % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")
    whole = scratch.save(whole.select("doc_id", "digest", "n", form.alias("form"), F.least(*cuts).alias("lo"), F.greatest(*cuts).alias("hi"), "entries"))
    cut = whole.select("doc_id", "digest", "entries", F.explode(F.array(F.struct(F.lit("lo").alias("cut"), F.col("lo").alias("point")), F.struct(F.lit("hi").alias("cut"), F.col("hi").alias("point")))).alias("c"))
    held = cut.select("doc_id", "digest", "c.cut", "c.point", F.explode("entries").alias("e")).where("point > e.before and point <= e.before + e.points")
    held = _near(scratch.save(held.select(F.col("doc_id").alias("own"), F.col("digest").alias("own_digest"), F.col("e.k").alias("own_k"), "cut", F.col("e.state").cast("int").alias("state"), (F.col("point") - F.col("e.before")).alias("rank"))))
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest"))
    asked = pieces.join(held, same & (F.col("k") == F.col("own_k"))).select("doc_id", "digest", "k", "cut", "state", "rank", bytes_of)
    places = asked.mapInArrow(_places, f"doc_id {kind}, digest string, k int, cut string, at long")
    offset = lambda c: F.coalesce(F.max(F.when(F.col("cut") == c, F.col("k").cast("long") * chunk + F.col("at"))), F.lit(0))
    found = places.groupBy("doc_id", "digest").agg(offset("lo").alias("a"), offset("hi").alias("b"))
    found = found.select(F.col("doc_id").alias("own"), F.col("digest").alias("own_digest"), "a", "b")
    plan = whole.select("doc_id", "digest", "n", "form", "lo", "hi").join(found, same, "left").select(F.col("doc_id").alias("own"), F.col("digest").alias("own_digest"), "n", "form", "lo", "hi", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    plan = _near(scratch.save(plan))
    text = F.col("text").cast("binary")
    part = lambda start, stop: F.substring(text, (start + 1).cast("int"), (stop - start).cast("int")).cast("string")
    prefix, middle, suffix = part(F.lit(0), F.col("a")), part(F.col("a"), F.col("b")), part(F.col("b"), F.octet_length("text"))
    mark = lambda x: F.lit(x)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)).otherwise(F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return named.join(plan, same).select("doc_id", "n", "form", cut_only(F.col("lo")).alias("prefix_chars"), cut_only(F.col("hi") - F.col("lo")).alias("middle_chars"), output.alias("output"))


_SEED = 1


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and the output of every document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_draws(F.col(id_col), _SEED))
    is_giant = F.octet_length("text") > giant
    small = rows.where(~is_giant).mapInArrow(_small, f"doc_id {kind}, {_OUT}")
    longest = docs.agg(F.max(F.octet_length(text_col))).first()[0] or 0
    told = small.unionByName(_giant(rows.where(is_giant), scratch, chunk)) if longest > giant else small
    return told.withColumnRenamed("doc_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text of an output, read back by its sentinels."""
    p = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))


ORACLE_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || text[1:lo] || '<S>' || text[hi+1:] || '<M>' || text[lo+1:hi] ELSE '<S>' || text[hi+1:] || '<P>' || text[1:lo] || '<M>' || text[lo+1:hi] END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
