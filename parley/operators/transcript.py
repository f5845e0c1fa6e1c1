"""Transcript operators: assembly, runs of one speaker, overlap between chunks, resumable ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T


def flatten(parts: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """One transcript a key: ``speaker: text`` lines in order, blank parts left out."""
    kept = parts.where(F.trim(text) != "")
    line = F.concat(F.col(speaker), F.lit(": "), F.trim(text))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))


def digest(parts: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """The transcript of each key, as flatten has it, with its turns, words and speakers, in one shuffle."""
    kept = parts.where(F.trim(text) != "")
    line = F.struct(F.col(order).alias("o"), F.concat(F.col(speaker), F.lit(": "), F.trim(text)).alias("l"))
    return kept.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("transcript"), F.count("*").alias("turns"), F.sum(T.word_count(F.col(text))).alias("words"), F.size(F.collect_set(speaker)).cast("bigint").alias("speakers")
    )


def runs(events: DataFrame, key: str, order: list[str], speaker: str) -> DataFrame:
    """Runs of consecutive rows of one speaker: key, run (from 1), speaker, first and last row, rows."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & (F.row_number().over(w) > 1)).cast("int")
    told = events.withColumn("run", F.sum(1 - new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(key, "run", speaker).agg(F.count("*").alias("rows"), *[F.min(c).alias(f"first_{c}") for c in order[:1]], *[F.max(c).alias(f"last_{c}") for c in order[:1]])


def overlap(before: str, after: str, least: int = 6, most: int = 120):
    """The length of the longest suffix of one text that is a prefix of the next; 0 if shorter than least."""
    return F.expr(
        f"coalesce(array_max(filter(sequence({least}, greatest({least}, least({most}, length({before}), length({after})))),"
        f" k -> k <= length({before}) and k <= length({after}) and right({before}, k) = left({after}, k))), 0)"
    )


def pending(items: DataFrame, done: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Items without a finished row: what a resumed job has still to do. With text, a row without text is not finished."""
    return items.join(done.where(F.coalesce(F.col(text), F.lit("")) != "") if text else done, key, "left_anti")


def cascaded(gone: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """The rows of each child table whose parent does not go; gone holds the keys of those that do. Rows without a parent stay."""
    keys = gone.select(F.col(key).alias("key of what goes")).distinct()
    return {name: df.join(keys, df[key] == keys["key of what goes"], "left_anti") for name, df in children.items()}


def merge_saved(saved: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Saved and new rows by key; the new value wins where there is one."""
    a, b = saved.select(key, F.col(value).alias("saved_value")), new.select(key, F.col(value).alias("new_value"))
    return a.join(b, key, "full").select(key, F.coalesce("new_value", "saved_value").alias(value))


def first_by_hash(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """Idempotent ingest: for each content, known by its SHA-256, the least id, and how many files have it."""
    return files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("file_hash")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


def summarised(parts: DataFrame, key: str, order: str, text: str, reduce, group: int = 4) -> DataFrame:
    """key, text, levels: parts reduced ``group`` at a time, in order, and the results again, until each key has one. reduce(Column of the
    group's texts, as an array) gives the text of a group. A level is one shuffle of a ``group``-th of the rows before it; all keys
    go through the levels together, and one that has a single text is left as it is."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = parts.select(key, place.alias("i"), F.col(text).alias("t"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    most, levels = rows.agg(F.max("n")).first()[0] or 0, 0
    rows = rows.withColumn("levels", F.lit(0))
    while group**levels < most:
        levels += 1
        texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"])
        rows = rows.groupBy(key, F.floor(F.col("i") / group).cast("int").alias("i")).agg(texts.alias("texts"), F.max("n").alias("n"), F.max("levels").alias("levels"))
        done = F.col("n") <= group ** (levels - 1)
        rows = rows.select(key, "i", F.when(done, F.get("texts", F.lit(0))).otherwise(reduce(F.col("texts"))).alias("t"), "n", F.when(done, F.col("levels")).otherwise(levels).alias("levels"))
    return rows.select(key, F.col("t").alias(text), "levels")


def merged_fields(left: Column, right: Column) -> Column:
    """Two maps of fields as one; the right one's value stands wherever it has the field, even as null."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    left, right = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def appearance(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Every row with the rank of its label by first appearance within the key, from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.groupBy(key, label).agg(F.min(F.struct(*order)).alias("f")).withColumn("speaker_no", F.row_number().over(Window.partitionBy(key).orderBy("f"))).drop("f")
    return rows.join(first, [key, label])


def insert_new(saved: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Saved rows and those new rows whose key is not there yet; of new rows with one key, one stays."""
    return saved.unionByName(new.dropDuplicates(keys).join(saved.select(*keys), keys, "left_anti").select(*saved.columns))


def upsert(saved: DataFrame, new: DataFrame, keys: list[str], values: list[str], defaults: dict) -> DataFrame:
    """Saved rows with the values of the new row of their key; keys not there yet are added, their other
    columns by defaults. new has one row a key."""
    told = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("is_new"))
    old = saved.withColumn("is_old", F.lit(True))
    out = {c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in values}
    out |= {c: F.when(F.col("is_old"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}
    return old.join(told, keys, "full").select(*[out[c].alias(c) if c in out else F.col(c) for c in saved.columns])


def last_written(writes: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A key-value table from its writes: the last value of each key wins."""
    return writes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def apportioned(parts: DataFrame, key: str, order: str, start: float, stop: float) -> DataFrame:
    """Every part with its equal share of the time from start to stop, in order; the last one ends at stop."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    told = parts.withColumn("i", i).withColumn("n", n)
    at = lambda k: F.round(F.lit(start) + F.lit(stop - start) / F.col("n") * k, 4)
    return told.withColumn("start", at(F.col("i"))).withColumn("stop", F.when(F.col("i") == F.col("n") - 1, F.lit(stop)).otherwise(at(F.col("i") + 1))).drop("i", "n")
