"""N-gram Jaccard join with several global token orders.

A document is its set of distinct word shingles. Of two sets with Jaccard similarity of at least
t, the first a - ceil(t * a) + 1 shingles under any one global order share a shingle, a being the
set's size. Rare shingles come first in every order: the corpus's frequent shingles stand by
their counts at the end, and the others by a hash of each order's own, or, in the first order, by
their exact document frequency. A pair must share a shingle
within the prefixes of all orders, and leave room for the needed overlap behind it, before its sets
are compared.

Equal sets are one node. In each group of nodes with a common prefix shingle the pairs with the
group's centre are compared first; when those links are joined to components, only pairs of
different components are left, so a group of near copies costs as many pairs as it has members and
still no link between components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.graph import components
from parley.llm.scratch import Scratch
from parley.llm.words import mix, shingle_sets

#: Orders by which a pair is filtered; the first one makes the candidates. Under the others the
#: filter looks at FRONT times the prefix.
ORDERS, FRONT = 3, 3
#: The frequent shingles that stand last: those that stand out within a partition, the most
#: frequent of them. The list fixes the orders alone; results are the same with any list.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 0.001, 4, 500_000
#: The first order begins with a sample of the other shingles, those with a hash in the lowest SAMPLED
#: times (1 - t), in ascending order of their document frequency, which is counted exactly.
SAMPLED = 1.6
#: Tables of at most so many ids are broadcast; larger ones are joined by shuffles.
BROADCAST_IDS = 2_000_000


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and the magnitude (bits) of their counts."""

    def counted(batches):
        sets = [grams for b in batches for _, grams in shingle_sets(b.column(0), n)]
        if sets:
            grams, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often])], names=["gram", "rows"])

    found = texts.select("text").mapInArrow(counted, "gram long, rows long").groupBy("gram").agg(F.sum("rows").alias("rows"))
    top = found.orderBy(F.desc("rows"), "gram").limit(FREQUENT_MOST).toArrow()
    grams = top["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.log2(top["rows"].to_numpy()[order]).astype(np.uint64) + np.uint64(1)


def _key(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """The place of each shingle in a global order: 6 bits of frequency, 58 bits of hash."""
    key = mix(grams, order + 1) >> np.uint64(6)
    known, bits = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        key |= np.where(known[at] == grams, bits[at], np.uint64(0)) << np.uint64(58)
    return key


def _leading(grams: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """The first shingles under an order, first first."""
    if length < len(key):
        at = np.argpartition(key, length - 1)[:length]
        return grams[at[np.argsort(key[at])]]
    return grams[np.argsort(key)]


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the least doc_id that links reach. Null, empty or wordless texts have no
    shingle and no link (component_id: their own id); a text of fewer than n words is one shingle.
    A row with a null id gets a null component and links nothing. Rows that share an id are one
    document with a row each; should their texts differ, both count as its text. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    given = spark.sparkContext.broadcast(_frequent(texts, n))
    kind = texts.schema[0].dataType.simpleString()

    bound = np.uint64(int(min(1.0, SAMPLED * (1 - percent / 100)) * 2**58))

    def described(batches):
        frequent = given.value
        for b in batches:
            sizes, one, two, firsts, leads = [], [], [], [], []
            for _, grams in shingle_sets(b.column(1), n):
                a = len(grams)
                sizes.append(a)
                one.append(mix(grams, 11).sum())
                two.append(mix(grams, 12).sum())
                # sets so small that one shingle too many breaks the similarity link equal sets only
                if 100 * a < percent * (a + 1):
                    firsts.append(0)
                    leads.append(grams[:0])
                    continue
                key = _key(grams, frequent, 0)
                firsts.append(int((key < bound).sum()))
                leads.append(_leading(grams, key, max(firsts[-1], a - -(-a * percent // 100) + 1)))
            flat = np.concatenate(leads) if leads else np.zeros(0, np.uint64)
            cuts = np.concatenate(([0], np.cumsum([len(p) for p in leads])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(firsts, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["doc_id", "n_shingles", "one", "two", "firsts", "lead"],
            )

    rows = scratch.save(texts.mapInArrow(described, f"doc_id {kind}, n_shingles long, one long, two long, firsts int, lead array<long>"))
    slim = scratch.save(rows.select("doc_id", "n_shingles"))
    key = ["n_shingles", "one", "two"]
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # only sets that occur again are looked up, where they are few without dealing out their rows by the set
    nodes = _few(scratch.save(full.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1").drop("copies")), BROADCAST_IDS // 4)
    member = scratch.save(full.select("doc_id", *key).join(nodes, key, "left").select("doc_id", F.coalesce("node", "doc_id").alias("node")))

    # the leading shingles of one document a node; more than one only where an id repeats
    lead = rows.join(member.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi").where("size(lead) > 0")
    lead = scratch.save(lead.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "firsts", "lead").withColumn("row", F.monotonically_increasing_id()))
    scratch.drop(rows)
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    # a shingle of the sample that no other node has only takes a place: the shared ones stand behind these, by frequency
    sampled = lead.select("row", F.explode(F.slice("lead", F.lit(1), F.col("firsts"))).alias("gram"))
    shared = sampled.withColumn("rows", F.count("*").over(Window.partitionBy("gram"))).where("rows > 1")
    shared = shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rows", "gram"))).alias("shared"))
    sized = lead.select("node", "row", "size", "firsts", prefix.alias("prefix"), F.expr("slice(lead, firsts + 1, size(lead))").alias("behind"))
    placed = sized.join(shared, "row", "left").withColumn("own", F.col("firsts") - F.coalesce(F.size("shared"), F.lit(0)))
    early = placed.select("node", "size", "prefix", "own", F.posexplode("shared").alias("k", "s")).select("node", "size", "prefix", (F.col("own") + F.col("k")).alias("at"), "s.gram")
    late = placed.select("node", "size", "prefix", "firsts", F.posexplode("behind").alias("k", "gram")).select("node", "size", "prefix", (F.col("firsts") + F.col("k")).alias("at"), "gram")
    tokens = scratch.save(early.union(late).where("at < prefix").select("gram", "node", "size", F.col("at").cast("long").alias("at")))
    scratch.drop(lead)
    centre = tokens.groupBy("gram").agg(F.min(F.struct("at", F.xxhash64("node").alias("h"), "node", "size")).alias("c"), F.count("*").alias("rows")).where("rows > 1")
    groups = scratch.save(tokens.join(centre, "gram").select("gram", "node", "size", "at", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.at").alias("centre_at")))
    scratch.drop(tokens)

    def room(size, at, other_size, other_at):
        """Enough shingles from the common one on, in both sets, for the needed overlap."""
        left = F.least(F.col(size) - F.col(at), F.col(other_size) - F.col(other_at))
        return left * (100 + percent) >= percent * (F.col(size) + F.col(other_size))

    first = scratch.save(groups.where((F.col("node") != F.col("centre")) & room("size", "at", "centre_size", "centre_at")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    fronts = scratch.save(_fronts(texts, scratch.save(groups.select(F.col("node").alias("doc_id")).distinct()), n, percent, given))
    links = _verified(texts, first, fronts, n, percent, scratch)
    known = scratch.save(components(links, scratch))

    # what is left: pairs of different components under a common prefix shingle
    labelled = groups.join(known, "node", "left").select("gram", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    open_rows = scratch.save(labelled.join(mixed, "gram"))
    x = open_rows.select("gram", *[F.col(c).alias(f"a_{c}") for c in ("node", "size", "at", "root")])
    y = open_rows.select("gram", *[F.col(c).alias(f"b_{c}") for c in ("node", "size", "at", "root")])
    rest = (
        x.join(y, "gram")
        .where((F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & room("a_size", "a_at", "b_size", "b_at"))
        .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        .distinct()
    )
    told = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.save(rest.join(told, ["a", "b"], "left_anti"))
    scratch.drop(groups, open_rows, first)
    more = links.unionByName(_verified(texts, rest, fronts, n, percent, scratch))
    scratch.drop(fronts, rest)
    if kind != "string":
        same = member.where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
        more = more.union(same.select("low", "high"))
    roots = scratch.save(components(more, scratch)) if more.limit(1).count() else known
    final = scratch.save(member.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).groupBy("doc_id").agg(F.min("root").alias("root")))
    return slim.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A broadcast hint only for tables of a checked size."""
    return F.broadcast(df) if df.count() <= most else df


def _fronts(texts: DataFrame, ids: DataFrame, n: int, percent: int, given) -> DataFrame:
    """id, size and, under each order but the first, the leading keys of the sets of some ids: FRONT
    times as many as the prefix has, the upper half of each key, ascending."""

    def fronts(batches):
        frequent = given.value
        for b in batches:
            sizes, keys = [], [[] for _ in range(1, ORDERS)]
            for _, grams in shingle_sets(b.column(1), n):
                a = len(grams)
                sizes.append(a)
                length = min(a, FRONT * (a - -(-a * percent // 100) + 1))
                for k, out in enumerate(keys):
                    key = _key(grams, frequent, k + 1)
                    out.append((np.sort(np.partition(key, length - 1)[:length] if length else key) >> np.uint64(32)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *map(_binary, keys)], names=["id", "size", *[f"k{k}" for k in range(1, ORDERS)]])

    kind = texts.schema[0].dataType.simpleString()
    return texts.join(_few(ids), "doc_id", "left_semi").mapInArrow(fronts, f"id {kind}, size long, " + ", ".join(f"k{k} binary" for k in range(1, ORDERS)))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _met(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs(a, b) with both sides' columns of a table by id."""
    got = _sided(of, "b").join(pairs.select(F.col("a").alias("pair_a"), F.col("b").alias("pair_b")), F.col("b_id") == F.col("pair_b"))
    return got.join(_sided(of, "a"), F.col("pair_a") == F.col("a_id")).drop("pair_a", "pair_b")


def _may(pairs: DataFrame, fronts: DataFrame, percent: int) -> DataFrame:
    """The pairs that the other orders leave: below the lesser last key everything common is seen,
    and behind it lie no more than the rest of either set."""

    def look(batches):
        for b in batches:
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            sizes_a, sizes_b = cols["a_size"].to_numpy(), cols["b_size"].to_numpy()
            kept = []
            for i in range(len(b)):
                need = -(-percent * int(sizes_a[i] + sizes_b[i]) // (100 + percent))
                for k in range(1, ORDERS):
                    x, y = (np.frombuffer(cols[f"{side}_k{k}"][i].as_buffer(), np.uint32) for side in "ab")
                    last = min(x[-1], y[-1])
                    x, y = x[: np.searchsorted(x, last, "right")], y[: np.searchsorted(y, last, "right")]
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                    if not common or common + min(sizes_a[i] - len(x), sizes_b[i] - len(y)) < need:
                        break
                else:
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([cols["a_id"].take(at), cols["b_id"].take(at)], names=["a", "b"])

    kind = fronts.schema[0].dataType.simpleString()
    return _met(pairs, fronts).mapInArrow(look, f"a {kind}, b {kind}")


def _verified(texts: DataFrame, pairs: DataFrame, fronts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of pairs(a, b) that pass the other orders and have the similarity, by their whole sets."""
    pairs = scratch.save(_may(pairs, fronts, percent))

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _binary([grams for _, grams in shingle_sets(b.column(1), n)])], names=["id", "grams"])

    def compare(batches):
        for b in batches:
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            kept = []
            for i in range(len(b)):
                x, y = (np.frombuffer(cols[f"{side}_grams"][i].as_buffer(), np.uint64) for side in "ab")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([cols["a_id"].take(at), cols["b_id"].take(at)], names=["a", "b"])

    kind = texts.schema[0].dataType.simpleString()
    ids = _few(scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    whole = scratch.save(texts.join(ids, "doc_id", "left_semi").mapInArrow(sets, f"id {kind}, grams binary"))
    found = scratch.save(_met(pairs, whole).mapInArrow(compare, f"a {kind}, b {kind}"))
    scratch.drop(pairs, whole)
    return found


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component, one row for each such id (of rows
    that repeat an id, one stays); rows with a null id stay."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(jaccard_components(docs, n, percent, id_col, text_col).select("doc_id", "component_id"))
    gone = _few(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    left = docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if not again.limit(1).count():
        return left
    again = _few(again)
    return left.join(again, left[id_col] == again["again"], "left_anti").union(left.join(again, left[id_col] == again["again"], "left_semi").dropDuplicates([id_col]))


def oracle_sql(n: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda k: array_to_string(list_slice(w, k, k + {n - 1}), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '  '] ELSE [] END) AS gram FROM d
), sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * p.both >= {percent} * (s.size + t.size - p.both)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.size, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.size
"""
