"""Benchmark decontamination: containment search by size-partitioned MinHash sketches.

An item of s shingles is contained in a document when at least ceil(t * s) of them occur there.
So of any s - ceil(t * s) + 1 of its shingles one occurs in the document: an item's sketch is that
many of its least MinHash values, a number that follows from its size. Documents whose shingles
hit a sketch are candidates, at whatever length, and exact containment decides. (Banded signatures
of whole documents would miss: a 35-shingle item inside 20,000 shingles has a Jaccard similarity of
0.002.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch
from parley.llm.words import mix, shingle_sets, shingles

#: Beyond so many shingles of all items the search is a shuffled join instead of a lookup in each task.
LOOKUP_SHINGLES = 4_000_000
#: The join's filter has 2 ** BITS bits (16 MB), whatever the number of shingles.
BITS = 27


def needed(size: int, percent: int) -> int:
    """The least number of shared shingles: 100 * shared >= percent * size."""
    return -(-size * percent // 100)


def _item_rows(items: DataFrame, n: int, percent: int) -> DataFrame:
    """item_id, item_size, gram, sketch (is it one of the item's sketch) of each distinct shingle."""

    def rows(batches):
        for b in batches:
            for i, grams in shingle_sets(b.column(1), n):
                size = len(grams)
                if not size:
                    continue
                sketch = np.zeros(size, bool)
                sketch[np.argsort(mix(grams, 3), kind="stable")[: size - needed(size, percent) + 1]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(b.column(0)[i], size), pa.array(np.full(size, size)), pa.array(grams.view(np.int64)), pa.array(sketch)], names=["item_id", "item_size", "gram", "sketch"]
                )

    kind = items.schema[0].dataType.simpleString()
    return items.mapInArrow(rows, f"item_id {kind}, item_size long, gram long, sketch boolean")


def contained_items(
    docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", lookup: int = LOOKUP_SHINGLES
) -> DataFrame:
    """(doc_id, item_id, item_size, shared, containment) of every document and item with at least
    ``percent`` of the item's distinct n-word shingles in the document.

    Null, empty or wordless texts match nothing. A text of fewer than n words is one shingle, its
    whole sequence: such an item matches only documents of just these words. Rows that repeat give
    one pair; for an item_id that repeats with other texts the largest containment counts. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark)
    wanted = scratch.save(_item_rows(items.select(F.col(item_id_col), F.col(item_text_col)).distinct(), n, percent))
    kind, item_kind = texts.schema[0].dataType.simpleString(), wanted.schema[0].dataType.simpleString()
    if wanted.count() <= lookup:
        found = _by_lookup(texts, wanted, n, percent, f"doc_id {kind}, item_id {item_kind}, item_size long, shared long")
    else:
        found = _by_join(texts, wanted, n, percent, kind, scratch)
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("shared") / F.col("item_size"), "item_size", "shared")).alias("best"))
        .select("doc_id", "item_id", "best.item_size", "best.shared", (F.col("best.shared") / F.col("best.item_size")).alias("containment"))
    )


def _by_lookup(texts: DataFrame, wanted: DataFrame, n: int, percent: int, schema: str) -> DataFrame:
    own = wanted.toPandas()
    own["item"] = own.groupby(["item_id", "item_size"], dropna=False, sort=False).ngroup()
    heads = own.drop_duplicates("item")
    ids, sizes = heads["item_id"].tolist(), heads["item_size"].to_numpy(np.int64)
    least = np.array([needed(int(s), percent) for s in sizes], np.int64)
    own["gram"] = own["gram"].to_numpy(np.int64).view(np.uint64)
    own = own.sort_values("gram")
    grams, of = own["gram"].to_numpy(), own["item"].to_numpy()
    keys, first = np.unique(grams, return_index=True)
    in_sketch = own["sketch"].to_numpy()
    sketched = np.logical_or.reduceat(in_sketch, first) if len(first) else np.zeros(0, bool)
    given = texts.sparkSession.sparkContext.broadcast((keys, np.append(first, len(grams)), of, in_sketch, sketched, ids, sizes, least))

    def search(batches):
        keys, first, of, in_sketch, sketched, ids, sizes, least = given.value
        names = ["doc_id", "item_id", "item_size", "shared"]
        kinds = None
        for b in batches:
            rows, items, shared = [], [], []
            for start, found, bounds in shingles(b.column(1), n) if len(keys) else ():
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == found)
                owner = np.searchsorted(bounds, hit, "right") - 1
                for doc in np.unique(owner[sketched[at[hit]]]):
                    mine = np.unique(at[hit[owner == doc]])
                    posted = np.concatenate([np.arange(first[k], first[k + 1]) for k in mine])
                    near = np.unique(of[posted[in_sketch[posted]]])  # items whose sketch the document hits
                    counts = np.bincount(of[posted], minlength=len(ids))
                    for item in near[counts[near] >= least[near]]:
                        rows.append(start + int(doc))
                        items.append(ids[item])
                        shared.append((int(sizes[item]), int(counts[item])))
            kinds = kinds or b.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(items) if items else pa.array([], pa.int64() if not ids or isinstance(ids[0], int) else pa.string()), pa.array([s for s, _ in shared], pa.int64()), pa.array([c for _, c in shared], pa.int64())],
                names=names,
            )

    return texts.mapInArrow(search, schema)


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """Which places of a table of 2 ** BITS bits the items' shingles take: its size does not depend on theirs."""
    place = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast((gram & {(1 << BITS) - 1}) & 63 as int))")
    found = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _by_join(texts: DataFrame, wanted: DataFrame, n: int, percent: int, kind: str, scratch: Scratch) -> DataFrame:
    given = texts.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    # of the documents' shingles only those leave the task that an item may have
    def rows(batches):
        table = given.value
        for b in batches:
            for i, grams in shingle_sets(b.column(1), n):
                place = grams & np.uint64((1 << BITS) - 1)
                grams = grams[(table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(grams)), pa.array(grams.view(np.int64))], names=["doc_id", "gram"])

    held = scratch.save(texts.mapInArrow(rows, f"doc_id {kind}, gram long").distinct())
    pairs = scratch.save(held.join(wanted.where("sketch"), "gram").select("doc_id", "item_id", "item_size").distinct())
    near = held.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = near.join(wanted, "gram").groupBy("doc_id", "item_id", "item_size").agg(F.count("*").alias("shared"))
    return counts.join(pairs, ["doc_id", "item_id", "item_size"], "left_semi").where(F.col("shared") * 100 >= F.col("item_size") * percent)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: list_slice(w, k, k + 4)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS gram FROM d
), items AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: list_slice(w, k, k + 4)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS gram FROM i
), sizes AS (SELECT item_id, count(*) AS item_size FROM items GROUP BY item_id)
SELECT doc_id, item_id, item_size, count(*) AS shared, count(*) / item_size AS containment
FROM ds JOIN items USING (gram) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, item_size HAVING 100 * count(*) >= 80 * item_size
"""
