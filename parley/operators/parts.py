"""Parts of transcripts: assembling, merging, translating and exporting them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import folds


def _let(value: Column, then) -> Column:
    """then(value), with value computed once a row: within a lambda function Spark would compute it again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def assembled(chunks: DataFrame, key: str, order: str, text: str, blank: str | None = None) -> DataFrame:
    """key, order, text of the chunks that say something new, without their laps, trimmed of the characters of blank (see folds.Assembly)."""
    rows = chunks.select(key, F.col(order).alias("turn"), F.col(text).alias("text"))
    return folds.fold(rows, [key], ["turn"], partial(folds.Assembly, blank=blank), f"{key} {_kind(chunks, key)}, turn {_kind(rows, 'turn')}, text string").withColumnsRenamed({"turn": order, "text": text})


def planned(pauses: DataFrame, key: str) -> DataFrame:
    """key, idx, start_ms, end_ms of the chunks of each recording (see folds.ChunkPlan)."""
    return folds.fold(pauses.select(key, "at", "total"), [key], ["at"], folds.ChunkPlan, f"{key} {_kind(pauses, key)}, idx int, start_ms long, end_ms long")


def collapsed(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, part and the snapshots' columns, one row a part (see folds.Collapse)."""
    return folds.fold(snapshots, [key], order, folds.Collapse, f"{key} {_kind(snapshots, key)}, part int, speaker_id int, speaker string, start long, stop long, text string, translation string, ids array<string>")


def shown(events: DataFrame, key: str) -> DataFrame:
    """key, event, kind, chunk, speaker, text, translation of live transcripts (see folds.TokenStream)."""
    return folds.fold(events, [key], ["event"], folds.TokenStream, f"{key} {_kind(events, key)}, event long, kind string, chunk int, speaker int, text string, translation string")


def edited(edits: DataFrame, key: str, order: str) -> DataFrame:
    """key, part, text, ids after all edits (see folds.Edits)."""
    return folds.fold(edits, [key], [order], folds.Edits, f"{key} {_kind(edits, key)}, part int, text string, ids array<string>")


def throttled(states: DataFrame, key: str) -> DataFrame:
    return folds.fold(states, [key], ["turn"], folds.Throttle, f"{key} {_kind(states, key)}, turn long, text string")


def accumulated(results: DataFrame, key: str, order: str) -> DataFrame:
    return folds.fold(results, [key], [order], folds.Accumulate, f"{key} {_kind(results, key)}, part int, speaker string, chunks array<string>, text string")


def averaged(values: DataFrame, key: str, order: list[str], alpha: float = 0.1) -> DataFrame:
    return folds.fold(values, [key], order, lambda: folds.Average(alpha), f"{key} {_kind(values, key)}, event_id long, average double")


def averaged_vectors(rows: DataFrame, key: str, order: list[str], alpha: float = 0.1, stats_alpha: float = 0.12) -> DataFrame:
    """key, event_id, vector, stats of each row, averaged so far (see folds.VectorAverage)."""
    return folds.fold(rows, [key], order, lambda: folds.VectorAverage(alpha, stats_alpha), f"{key} {_kind(rows, key)}, event_id long, vector array<double>, stats array<double>")


def held(matches: DataFrame, key: str) -> DataFrame:
    """key, event_id, speaker, held of each match (see folds.Hold)."""
    return folds.fold(matches, [key], ["at", "event_id"], folds.Hold, f"{key} {_kind(matches, key)}, event_id long, speaker string, held boolean")


def switched(matches: DataFrame, key: str) -> DataFrame:
    """key, event_id, speaker of each match, after it (see folds.Switch)."""
    return folds.fold(matches, [key], ["at", "event_id"], folds.Switch, f"{key} {_kind(matches, key)}, event_id long, speaker string")


def voices(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, event_id, speaker, is_new of rows with features (see folds.Voices)."""
    return folds.fold(rows, [key], order, folds.Voices, f"{key} {_kind(rows, key)}, event_id long, speaker int, is_new boolean")


def endpoints(ticks: DataFrame, key: str) -> DataFrame:
    """key, idx, start_ms, end_ms of the chunks of live recordings (see folds.Endpoints)."""
    return folds.fold(ticks.select(key, "at", "level"), [key], ["at"], folds.Endpoints, f"{key} {_kind(ticks, key)}, idx int, start_ms long, end_ms long")


def corrected(parts: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """parts(key, part, speaker, ids) with the speaker of the last correction(key, chunk, speaker, turn) to one of their chunks."""
    of = parts.select(key, "part", F.explode("ids").alias("chunk"))
    last = corrections.join(of, [key, "chunk"]).groupBy(key, "part").agg(F.max_by("speaker", "turn").alias("corrected"))
    return parts.join(last, [key, "part"], "left").withColumn("speaker", F.coalesce("corrected", "speaker")).drop("corrected")


#: Behind the end of a sentence.
SENTENCE_END = r"(?<=[.!?。！？])\s+"


def sentence_groups(text: Column) -> Column:
    """Sentences as an array, each a group; a rest of less than a sentence joins a short group before it. A long text in one group
    is cut at commas into groups of about 100 characters. A blank text has none."""
    text = F.coalesce(text, F.lit(""))
    found = F.filter(F.transform(F.split(F.btrim(text, F.lit(T.BLANK)), SENTENCE_END), lambda s: F.btrim(s, F.lit(T.BLANK))), lambda s: s != "")

    def closed(s: Column) -> Column:
        n, last = F.size(s), F.element_at(s, -1)
        whole = (n == 1) | (F.length(last) >= 60) | last.rlike("[.!?。！？]$") | (F.length(F.get(s, n - 2)) >= 80)
        return F.when(whole, s).otherwise(F.array_append(F.slice(s, 1, n - 2), F.concat_ws(" ", F.get(s, n - 2), last)))

    def by_commas(groups: Column, piece: Column) -> Column:
        last = F.element_at(groups, -1)
        longer = F.when(last == "", piece).otherwise(F.concat_ws(", ", last, piece))
        return F.when((last != "") & (F.length(longer) >= 100), F.array_append(groups, piece)).otherwise(F.array_append(F.slice(groups, 1, F.size(groups) - 1), longer))

    commas = F.filter(F.aggregate(F.split(text, r",\s*"), F.array(F.lit("")), by_commas), lambda g: g != "")
    cut = _let(commas, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(F.btrim(text, F.lit(T.BLANK)))))
    groups = lambda s: F.when(F.size(s) == 0, s).otherwise(_let(closed(s), lambda g: F.when((F.size(g) > 1) | (F.length(text) <= 120), g).otherwise(cut)))
    return _let(found, groups)


def grouped_sentences(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, piece, text: the groups of sentences of each text (see sentence_groups)."""
    return rows.select(id_col, F.posexplode(sentence_groups(F.col(text_col))).alias("piece", "text"))


def parsed(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, speaker, speaker_id, text of transcripts that are JSON arrays of parts, under either spelling of
    their fields; of another text one part with all of it. Blank parts go."""
    schema = "array<struct<text:string,speaker:string,speakerId:int,speaker_id:int>>"
    array = F.when(F.col(text).startswith("["), F.from_json(text, schema))
    alone = F.array(F.struct(F.col(text).alias("text"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("int").alias("speakerId"), F.lit(None).cast("int").alias("speaker_id")))
    told = transcripts.select(key, F.posexplode(F.coalesce(array, alone)).alias("part", "p")).where(F.btrim("p.text") != "")
    return told.select(key, "part", F.coalesce("p.speaker", F.lit("Speaker 1")).alias("speaker"), F.greatest(F.lit(0), F.coalesce("p.speakerId", "p.speaker_id", F.lit(0))).alias("speaker_id"), F.col("p.text").alias("text"))


def segments(tokens: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, speaker, start_ms, end_ms, text of runs of tokens of one speaker. Empty tokens, end marks and tokens
    without times do not count, a missing speaker is 1, and segments of inventions or of nothing go."""
    w = Window.partitionBy(key).orderBy(*order)
    said = tokens.where((F.coalesce("text", F.lit("")) != "") & (F.col("text") != "<end>") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    said = said.withColumn("speaker", F.coalesce(F.col("speaker").cast("string"), F.lit("1"))).withColumn("n", F.row_number().over(w))
    said = said.withColumn("new", F.when(F.col("speaker") == F.lag("speaker").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "")
    told = said.groupBy(key, "run", "speaker").agg(F.min_by("start_ms", "n").alias("start_ms"), F.max_by("end_ms", "n").alias("end_ms"), F.btrim(pieces, F.lit(T.BLANK)).alias("text"))
    return told.where(~T.invented(F.col("text"))).drop("run")


def appended(parts: DataFrame, key: str, order: str) -> DataFrame:
    """key, part (from 1), speaker_id, speaker, start, text, chunk_ids: a part with the speaker, by number or name,
    and the start of the one before takes its place; the chunk ids of both stay, each where it came first."""
    w = Window.partitionBy(key).orderBy(order)
    same = ((F.col("speaker_id") == F.lag("speaker_id").over(w)) | (F.col("speaker") == F.lag("speaker").over(w))) & (F.col("start") == F.lag("start").over(w))
    told = parts.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "chunk_ids"))), lambda x: x["chunk_ids"])))
    last = [F.max_by(c, order).alias(c) for c in ("speaker_id", "speaker", "start", "text")]
    return told.groupBy(key, "part").agg(*last, ids.alias("chunk_ids"))


def context(files: DataFrame, keys: list[str], order: str, name: str, text: str) -> DataFrame:
    """keys, context: the files that are not blank, each under its name, in order."""
    kept = files.where(F.btrim(text, F.lit(T.BLANK)) != "")
    block = F.btrim(F.concat(F.lit("### "), F.col(name), F.lit("\n"), F.col(text)), F.lit(T.BLANK))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"])
    return kept.groupBy(*keys).agg(F.array_join(blocks, "\n\n---\n\n").alias("context"))


def exported(parts: DataFrame, key: str, order: str, title: Column) -> DataFrame:
    """key, markdown, txt, copied, translation of each transcript; blank parts are not in the Markdown."""
    who = F.coalesce(F.nullif(F.btrim("speaker"), F.lit("")), F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string")))
    time = F.concat(T.clock(F.col("start")), F.lit(" - "), T.clock(F.col("stop")))
    line = lambda *of: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in of])
    after = lambda mark: F.when(F.coalesce("translation", F.lit("")) != "", line(mark, F.col("translation"))).otherwise("")
    rows = parts.withColumn("who", who).withColumn("time", time)
    rows = rows.select(
        key, order, title.alias("title"),
        F.when(F.btrim("text") != "", line("## ", F.col("who"), " (", F.col("time"), ")\n", F.btrim("text"), after("\n> "))).alias("markdown"),
        line("[", F.col("time"), "] ", F.col("who"), ": ", F.col("text"), after("\n    → ")).alias("txt"),
        line(F.col("who"), ": ", F.col("text")).alias("copied"), F.nullif("translation", F.lit("")).alias("translation"),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c]), "\n\n").alias(c)
    told = rows.groupBy(key).agg(F.first("title").alias("title"), *map(joined, ("markdown", "txt", "copied", "translation")))
    return told.withColumn("markdown", line("# ", F.col("title"), "\n\n", F.col("markdown"))).withColumn("translation", F.nullif("translation", F.lit(""))).drop("title")


def speaker_number(raw: Column) -> Column:
    """A speaker's number from 0 of one from 1; what is no number is 0."""
    return F.coalesce(F.greatest(F.lit(0), raw.try_cast("int") - 1), F.lit(0))


def paired(starts: DataFrame, ends: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, i (from 1), start, stop: the i-th start with the i-th end; an end without a start stands for both."""
    numbered = lambda df, c: df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint").alias("i"), F.col(order[0]).alias(c))
    return numbered(ends, "stop").join(numbered(starts, "start"), [key, "i"], "left").select(key, "i", F.coalesce("start", "stop").alias("start"), "stop")


def translated(parts: DataFrame, late: DataFrame, key: str) -> DataFrame:
    """key, part, translation: late translations by the chunk id that a part has in ids, else of the last part."""
    last = parts.groupBy(key).agg(F.max("part").alias("last"))
    of = parts.select(key, "part", F.explode("ids").alias("chunk"))
    told = late.join(of, [key, "chunk"], "left").join(last, key).withColumn("part", F.coalesce("part", "last"))
    return told.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "translation"))), lambda x: x["translation"]), " ").alias("translation"))


def aligned_translation(sentences: Column, translation: Column) -> Column:
    """A translation dealt out to the sentences of its original: sentence by sentence if there are as many; else its words by the lengths of the
    sentences, one at least each and the rest to the last. One sentence takes all; without a translation all pieces are empty."""
    plain = F.btrim(F.coalesce(translation, F.lit("")), F.lit(T.BLANK))
    own = F.filter(F.split(plain, SENTENCE_END), lambda s: F.btrim(s) != "")
    found = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    total = F.aggregate(sentences, F.lit(0), lambda s, x: s + F.length(x))

    def dealt(words: Column, length: Column) -> Column:
        wanted = F.transform(sentences, lambda s: F.greatest(F.lit(1), F.floor(F.length(s) / length * F.size(words) + 0.5).cast("int")))
        ends = F.aggregate(wanted, F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))

        def share(ends: Column) -> Column:
            stop = lambda i: F.when(i == F.size(sentences) - 1, F.size(words)).otherwise(F.element_at(ends, i + 2))
            return F.transform(sentences, lambda s, i: F.array_join(F.slice(words, F.element_at(ends, i + 1) + 1, F.greatest(F.lit(0), stop(i) - F.element_at(ends, i + 1))), " "))

        return _let(ends, share)

    none = F.transform(sentences, lambda s: F.lit(""))
    by_length = _let(found, lambda words: _let(total, lambda length: dealt(words, length)))
    return F.when(F.size(sentences) == 1, F.array(F.coalesce(translation, F.lit("")))).when((plain == "") | (total == 0), none).when(F.size(own) == F.size(sentences), own).otherwise(by_length)


def packs(text: Column, most: int = 40) -> Column:
    """The pieces in which a text goes to a translator, as an array. One of at most ``most`` words is left as it is. A longer one is counted
    off sentence by sentence: a piece ends before a sentence that would bring it beyond ``most`` words, and what is open is cut every
    ``most`` words while it has more than half as many again."""
    text = F.coalesce(text, F.lit(""))
    found = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    counts = F.transform(F.split(text, r"(?U)(?<=[.!?,\n])\s+"), lambda s: F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("begin"), F.lit(0).alias("at"))

    def taken(s: Column, n: Column) -> Column:
        full = (s["at"] > s["begin"]) & (s["at"] - s["begin"] + n > most)
        begin = F.when(full, s["at"]).otherwise(s["begin"])
        over = s["at"] + n - begin - int(most * 1.5)
        cuts = F.when(over > 0, F.ceil(over / most).cast("int")).otherwise(0)
        marks = F.when(cuts > 0, F.transform(F.sequence(F.lit(1), F.greatest(cuts, F.lit(1))), lambda j: begin + j * most)).otherwise(F.array().cast("array<int>"))
        ends = F.when(full | (cuts > 0), F.concat(s["ends"], F.when(full, F.array(s["at"])).otherwise(F.array().cast("array<int>")), marks)).otherwise(s["ends"])
        return F.struct(ends.alias("ends"), (begin + cuts * most).alias("begin"), (s["at"] + n).alias("at"))

    ends = F.aggregate(counts, start, taken, lambda s: F.when(s["at"] > s["begin"], F.array_append(s["ends"], s["at"])).otherwise(s["ends"]))
    def cut(words: Column, ends: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        return F.transform(ends, lambda e, i: F.array_join(F.slice(words, before(i) + 1, e - before(i)), " "))

    return _let(found, lambda words: F.when(F.size(words) <= most, F.array(text)).otherwise(_let(ends, lambda e: cut(words, e))))


def pieces(text: Column, most: int = 15_000, lap: int = 1_000) -> Column:
    """A text as an array of runs of whole lines that end when they reach ``most`` characters, line ends counted; each begins with the last
    lines of the one before that stay below ``lap`` characters, and counts the line before those too."""
    start = F.struct(F.array().cast("array<struct<first:int,end:int>>").alias("runs"), F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(0).alias("size"))

    def taken(s: Column, n: Column, sizes: Column) -> Column:
        end, size = s["end"] + 1, s["size"] + n
        # From the run's last line backwards: the lines that are repeated, and the size that the next run begins with.
        back = F.reverse(F.slice(sizes, s["first"] + 1, end - s["first"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"))
        again = F.aggregate(back, none, lambda a, x: F.when(a["size"] >= lap, a).otherwise(F.struct((a["n"] + (a["size"] + x < lap).cast("int")).alias("n"), (a["size"] + x).alias("size"))))
        cut = F.struct(F.array_append(s["runs"], F.struct(s["first"].alias("first"), end.alias("end"))).alias("runs"), (end - again["n"]).alias("first"), end.alias("end"), again["size"].alias("size"))
        return F.when(size >= most, cut).otherwise(F.struct(s["runs"].alias("runs"), s["first"].alias("first"), end.alias("end"), size.alias("size")))

    last = lambda s: F.when(s["end"] > s["first"], F.array_append(s["runs"], F.struct(s["first"].alias("first"), s["end"].alias("end")))).otherwise(s["runs"])
    runs = lambda lines: _let(F.transform(lines, lambda x: F.length(x) + 1), lambda sizes: F.aggregate(sizes, start, lambda s, n: taken(s, n, sizes), last))
    return _let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda lines: F.transform(runs(lines), lambda r: F.array_join(F.slice(lines, r["first"] + 1, r["end"] - r["first"]), "\n")))


def packed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, piece, text: what is sent to a translator at a time (see packs)."""
    return rows.select(id_col, F.posexplode(packs(F.col(text_col))).alias("piece", "text"))


def split_lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, piece, text: overlapping parts of long transcripts (see pieces)."""
    return rows.select(id_col, F.posexplode(pieces(F.col(text_col))).alias("piece", "text"))
