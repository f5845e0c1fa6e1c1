"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case and trimmed, as sets of their distinct shingles of SHINGLE characters; two
link at a Jaccard similarity of SIMILARITY or more. Equal lines are one node. Splitting, bands, joins and
components are DataFrame functions; the shingles of lines are hashed and compared by numpy on Arrow batches,
because SQL functions alone take more CPU for that than all of the budget (figures in the README).

All shingles of a line are hashed and sorted into a circle. A window of ``r`` neighbours on it that begins at
a shingle x is MinHash under the order that begins at x: two lines with x have the same window when the r
least shingles of their union behind x are common, so with a chance of similarity ** r. Windows are bands.
A line has windows of LONG_BAND shingles at those x whose hash ends in k zero bits, k being the largest that
leaves LEAST windows or more on average; the ends are nested, so two similar lines have LEAST in common
whatever their k. A line of few shingles has windows of SHORT_BAND at all its shingles: four of five shingles
of the union being common, some four neighbours are, so no link between short lines is missed.

In each band all nodes are compared with its centre, the node with the fewest shingles, and the links joined to
components (large and small star steps). Bands whose nodes are then of several components are compared further,
and exactly: those with at most ALL pairs of different components for each node by all these pairs, as where most
nodes are of one component, however many they are; others are split. Let K be what a
node has in common with the centre c and R the rest of it. Two nodes a and b link when they have
need(a, b) = 4 / 9 * (|a| + |b|) shingles in common, of which at most min(|K_a|, |K_b|) are in c. If a does not link
with c, then |K_a| < need(a, c) <= need(a, b), as no node is smaller than c. So two nodes of which one does not
link with c must share shingles of R: need(a, b) - |K_a| or more, and one at least. The new bands are the shingles of R, of
which a prefix that leaves so many out is enough. They have centres of their own and are split again, until
all are compared by pairs, by a measure that grows with each split, or of one component; every pair that shares a band is decided. The first line of a component, by
document and place, is kept.

Before lines are compared, parity bitmaps of their shingles tell most pairs apart, and never a pair that links: a bit in which two
bitmaps differ is a shingle that only one of the lines has, and lines that link have at most a ninth of |a| + |b| of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.graph import components
from parley.llm.scratch import Scratch
from parley.llm.words import mix, raw, slices

SHINGLE, SIMILARITY = 5, 0.8
LONG_BAND, SHORT_BAND, LEAST = 6, 4, 10
#: Lines of at most SHORT shingles have short bands at all shingles, lines of more than SHORT * SIMILARITY long ones.
SHORT = 25
#: Bands with at most so many pairs of different components a node are compared by these pairs, others split; after each split so many times as many.
#: A node that is split gives up to a shingle for each that it has beyond its centre, and meets the same nodes in the bands of many of
#: these: a split takes the time of some thousands of pairs a node.
ALL, MORE = 4_096, 4
#: Rows of bands with more than MANY pairs of different components a node are compared with the NEXT ones in the order of their sizes first.
MANY, NEXT = 64, 8
#: Words of 64 bits of a parity bitmap: lines of at most NARROW shingles fill half of them.
WORDS, NARROW = 16, 400
#: Bits of a key that number the lines of a batch; bytes of lines whose shingles are hashed at a time, which fit a processor's cache.
LINE_BITS, SLICE = 14, 150_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Tables of at most so many rows of one to four numbers are broadcast (60 MB at most); larger ones are joined by shuffles.
BROADCAST_ROWS = 1_000_000
#: The same for tables of one number, and for bitmaps.
BROADCAST_KEYS, BROADCAST_MAPS = 2_000_000, 350_000
#: Bits by which bands are told from those of a single row, before these are shuffled: 64 in a word, so 2 ** 21 words are broadcast at most.
BAND_BITS = 27


def _few(df: DataFrame, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def _bits(df: DataFrame, place) -> DataFrame:
    """word, bits: which places there are, 64 in a word. The numbers of rows lie close, so a word stands for many of them."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    return df.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _among(df: DataFrame, bits: DataFrame, place, there: bool = True) -> DataFrame:
    """The rows of df whose place is among those of bits, or is not."""
    held = F.call_function("shiftrightunsigned", F.col("bits"), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = df.join(_few(bits, 1 << (BAND_BITS - 6)), F.shiftright(place, 6) == F.col("word"), "inner" if there else "left")
    return met.where(held if there else F.coalesce(~held, F.lit(True))).select(*df.columns)


def shingle_keys(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first line, end line, keys) of some lines at a time: sorted, each once, with the number of the line among
    these in the upper LINE_BITS bits and the hash of a shingle in the others. A line of fewer than SHINGLE
    characters is one shingle, an empty or null one has none."""
    data, offsets = raw(column)
    for first, last in slices(offsets, SLICE):
        while first < last:
            end = min(last, first + (1 << LINE_BITS) - 1)
            part = offsets[first : end + 1]
            own = data[part[0] : part[-1]]
            heads = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
            cuts = heads[part - part[0]]
            codes = np.frombuffer(own.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            line = np.repeat(np.arange(end - first, dtype=np.uint64), np.diff(cuts))
            # a short line is filled up with a code that no text has
            short = np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < SHINGLE))
            kept = max(0, len(codes) - SHINGLE + 1)
            whole = np.flatnonzero(line[:kept] == line[SHINGLE - 1 :])
            # a polynomial of the codes in steps, mixed once
            h = codes[:kept].copy()
            for j in range(1, SHINGLE):
                h *= _STEP
                h += codes[j : j + kept]
            keys = [(line[whole] << np.uint64(64 - LINE_BITS)) | (mix(h[whole]) >> np.uint64(LINE_BITS))]
            if len(short):
                h = np.zeros(len(short), np.uint64)
                for j in range(SHINGLE):
                    at = np.minimum(cuts[short] + j, len(codes) - 1)
                    h = h * _STEP + np.where(cuts[short] + j < cuts[short + 1], codes[at], np.uint64(1 << 32))
                keys.append((short.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (mix(h) >> np.uint64(LINE_BITS)))
            found = np.concatenate(keys)
            found.sort()
            yield first, end, found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found
            first = end


def line_bands(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first line, end line, bands, the number of each line's bands, that of its shingles) of some lines at a time."""
    for first, end, keys in shingle_keys(column):
        line = (keys >> np.uint64(64 - LINE_BITS)).astype(np.int64)
        size = np.bincount(line, minlength=end - first)
        start = np.cumsum(size) - size
        hashes = keys & np.uint64((1 << (64 - LINE_BITS)) - 1)
        mask = (np.uint64(1) << np.floor(np.log2(np.maximum(1, size / LEAST))).astype(np.uint64)) - np.uint64(1)
        bands, owners = [], []
        for r, chosen in ((SHORT_BAND, (size <= SHORT)[line]), (LONG_BAND, (size > SHORT * SIMILARITY)[line] & ((hashes & mask[line]) == 0))):
            at = np.flatnonzero(chosen)
            own = line[at]
            n, begin = size[own], start[own]
            place, h = at - begin, np.full(len(at), r, np.uint64)
            for j in range(r):
                h = mix(h + hashes[begin + (place + j) % n])
            bands.append(h)
            owners.append(own)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        yield first, end, np.concatenate(bands)[order].view(np.int64), np.bincount(owner, minlength=end - first), size


def _banded(batches):
    for b in batches:
        bands, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, found, count, size in line_bands(b.column(0)):
            bands.append(found)
            counts.append(count)
            sizes.append(size)
        cuts = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(sizes).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(bands)))], names=[*b.schema.names, "size", "bands"])


def similar(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which lines of two columns have the similarity, row by row."""
    out, step = np.zeros(len(a), bool), 500
    for i in range(0, len(a), step):
        size, keys = np.zeros((2, min(step, len(a) - i)), np.int64), []
        for side, column in enumerate((a.slice(i, step), b.slice(i, step))):
            for first, end, found in shingle_keys(column):
                line = (found >> np.uint64(64 - LINE_BITS)).astype(np.int64)
                size[side, first:end] = np.bincount(line, minlength=end - first)
                keys.append((found & np.uint64((1 << (64 - LINE_BITS)) - 1)) | ((line + first).astype(np.uint64) << np.uint64(64 - LINE_BITS)))
        both = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        twice = both[1:][both[1:] == both[:-1]] >> np.uint64(64 - LINE_BITS)
        common = np.bincount(twice.astype(np.int64), minlength=size.shape[1])
        out[i : i + step] = (common > 0) & (common >= SIMILARITY * (size[0] + size[1] - common))
    return out


def parities(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, bitmap of WORDS words) of each line; a bit is set where an odd number of its shingles falls on it."""
    sizes, maps = np.zeros(len(column), np.int64), np.zeros((len(column), WORDS), np.uint64)
    step = 2_000
    for i in range(0, len(column), step):
        for first, end, keys in shingle_keys(column.slice(i, step)):
            line = (keys >> np.uint64(64 - LINE_BITS)).astype(np.int64)
            size = np.bincount(line, minlength=end - first)
            bit = (mix(keys & np.uint64((1 << (64 - LINE_BITS)) - 1)) & np.where(size > NARROW, np.uint64(64 * WORDS - 1), np.uint64(32 * WORDS - 1))[line]).astype(np.int64)
            odd = np.bincount(line * (64 * WORDS) + bit, minlength=(end - first) * 64 * WORDS) & 1
            sizes[i + first : i + end] = size
            maps[i + first : i + end] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(-1, WORDS)
    return sizes, maps


def _mapped(batches):
    for b in batches:
        sizes, maps = parities(b.column(1))
        columns = [pa.array(np.ascontiguousarray(maps[:, k]).view(np.int64)) for k in range(WORDS)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), *columns], names=["row", "line", "shingles", *MAP])


#: The columns of a bitmap.
MAP = [f"w{k}" for k in range(WORDS)]


def _side(texts: DataFrame, c: str) -> DataFrame:
    return texts.select(F.col("row").alias(c), F.col("shingles").alias(f"shingles_{c}"), *(F.col(w).alias(f"{w}_{c}") for w in MAP))


def _may_link():
    """Whether nothing in the bitmaps of a and b keeps them from the similarity. A wide bitmap is folded for a narrow one."""
    words, half = [F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b")) for w in MAP], WORDS // 2
    whole = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    folded = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words[:half], words[half:], strict=True)]
    differ = F.when((F.col("shingles_a") > NARROW) == (F.col("shingles_b") > NARROW), whole).otherwise(sum(folded[1:], folded[0]))
    return 9 * differ <= F.col("shingles_a") + F.col("shingles_b")


def rests(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles that lines of b have beyond those of a, without as many of each line as any line that is not smaller than
    a's must share with it beyond a's: those of the greatest hashes."""
    rows, hashes, step = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 500
    low = np.uint64((1 << (64 - LINE_BITS)) - 1)
    for i in range(0, len(b), step):
        keys, n = [], min(step, len(b) - i)
        for column in (a.slice(i, step), b.slice(i, step)):
            own = [(found & low) | (((found >> np.uint64(64 - LINE_BITS)) + np.uint64(first)) << np.uint64(64 - LINE_BITS)) for first, _, found in shingle_keys(column)]
            keys.append(np.concatenate(own) if own else np.zeros(0, np.uint64))
        of = lambda k: (k >> np.uint64(64 - LINE_BITS)).astype(np.int64)
        size_a, size_b = (np.bincount(of(k), minlength=n) for k in keys)
        rest = keys[1][~np.isin(keys[1], keys[0], assume_unique=True)]
        line = of(rest)
        beyond = np.bincount(line, minlength=n)
        common = size_b - beyond
        need = lambda x, y: -(-4 * (x + y) // 9)
        least = need(size_b, np.maximum(size_a, -(-4 * size_b // 5))) - common
        least = np.maximum(1, np.where(common >= need(size_a, size_b), 1, least))
        place = np.arange(len(rest)) - (np.cumsum(beyond) - beyond)[line]
        kept = place < (beyond - least + 1)[line]
        rows.append(line[kept] + i)
        hashes.append(rest[kept] & low)
    return np.concatenate(rows), np.concatenate(hashes)


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) of nodes whose lines have the similarity. texts: row, line. pairs is read more than once; only its own texts are shuffled."""

    def compare(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(list(b.columns[:2]), names=["a", "b"]).filter(pa.array(similar(b.column(2), b.column(3))))

    side = lambda c: texts.select(F.col("row").alias(c), F.col("line").alias(f"line_{c}")).join(_few(pairs.select(c).distinct(), BROADCAST_KEYS), c, "left_semi")
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "line_a", "line_b")
    return met.mapInArrow(compare, "a long, b long")


#: What is trimmed from both ends of a line.
BLANKS = " \t\r\f\v"


def _trimmed(line: str):
    """btrim looks at every character of a line: only lines that have something to trim are given to it."""
    at_end = [end(F.col(line), F.lit(c)) for c in BLANKS for end in (F.startswith, F.endswith)]
    return F.when(reduce(Column.__or__, at_end), F.btrim(line, F.lit(BLANKS))).otherwise(F.col(line))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), component_doc, component_line, kept of every line with a character
    other than white space.

    The component is named by its first line, the one that is kept; a line without near copies is its own.
    Null and empty texts have no lines. Of repeated rows (same id) one holds the kept lines' places, so
    equal places are kept alike. Null ids come first. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    lines = whole.withColumn("line", _trimmed("line")).where("line <> ''").withColumn("line", F.lower("line"))
    # the numbers of rows are read back from the table, never made again
    keyed = lines.select("line", F.monotonically_increasing_id().alias("row"), "doc_id", "line_no", F.xxhash64("line").alias("one"), F.xxhash64("line", F.lit(1)).alias("two"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    keyed = scratch.save(keyed.mapInArrow(_banded, f"line string, row long, doc_id {kind}, line_no int, one long, two long, size long, bands array<long>"))
    again = keyed.groupBy("one", "two").agg(F.min("row").alias("node"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    again = keyed.select("row", "doc_id", "line_no", "one", "two").join(_few(scratch.save(again)), ["one", "two"]).select("row", "node", "doc_id", "line_no")
    again = scratch.save(again)

    # equal lines are described by one of them
    row = F.col("row")
    repeats = scratch.save(_bits(again.where("row <> node"), row))
    groups = _grouped(_among(keyed.select("row", "size", "bands"), repeats, row, there=False).select("row", "size", F.explode("bands").alias("band")), scratch)
    wanted = scratch.save(_bits(groups, row))
    texts = scratch.save(_among(keyed.select("row", "line"), wanted, row).mapInArrow(_mapped, f"row long, line string, shingles long, {', '.join(f'{w} long' for w in MAP)}"))

    roots = _linked(groups, texts, scratch).withColumnsRenamed({"row": "of", "root": "top"})
    scratch.drop(texts, groups)

    # lines with equal or similar ones are named by the first of all; each other line is its own
    place = F.struct("doc_id", "line_no")
    alone = _among(_among(keyed.select("row", "doc_id", "line_no"), wanted, row), scratch.save(_bits(again, row)), row, there=False)
    member = again.union(alone.select("row", row.alias("node"), "doc_id", "line_no")).join(_few(roots), F.col("node") == F.col("of"), "left")
    member = scratch.save(member.select("row", "doc_id", "line_no", F.coalesce("top", "node").alias("top")))
    firsts = scratch.save(member.groupBy("top").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    named = scratch.save(member.join(_few(firsts), "top").select("row", "first"))
    found = keyed.select("row", "doc_id", "line_no").join(_few(named), "row", "left").withColumn("first", F.coalesce("first", place))
    return found.select("doc_id", "line_no", F.col("first.doc_id").alias("component_doc"), F.col("first.line_no").alias("component_line"), place.eqNullSafe(F.col("first")).alias("kept"))


def _grouped(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """tokens(row, size, band) of bands with several rows, with the centre and the number of the band's rows. Of bands with the same
    rows one is enough."""
    mark = lambda k: F.bit_xor(F.xxhash64("row", F.lit(k)))
    # most bands have one row: nearly all of these go before anything else is shuffled
    place = F.call_function("shiftrightunsigned", F.col("band"), F.lit(64 - BAND_BITS))
    shared = scratch.save(_bits(tokens.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1"), place))
    tokens = scratch.save(_among(tokens, shared, place))
    met = tokens.groupBy("band").agg(F.min_by("row", "size").alias("centre"), F.count("*").alias("rows"), mark(1).alias("x"), mark(2).alias("y")).where("rows > 1")
    met = met.groupBy("rows", "x", "y").agg(F.min(F.struct("band", "centre")).alias("b")).select("b.band", "b.centre", "rows")
    groups = scratch.save(tokens.join(_few(scratch.save(met)), "band"))
    scratch.drop(tokens)
    return groups


def _mixed(groups: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of groups with their roots, of bands that hold several components, with the root that most of the band's rows have and the number of its pairs of different components."""
    labelled = groups.join(labels, "row")
    of = labelled.groupBy("band", "root").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"), F.max_by("root", F.struct("k", "root")).alias("main"))
    mixed = of.where("n * n > q").select("band", "main", ((F.col("n") * F.col("n") - F.col("q")) / 2).cast("bigint").alias("pairs"))
    return scratch.save(labelled.join(_few(scratch.save(mixed)), "band"))


def _apart(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components that share a band of left, without those whose sizes or bitmaps alone keep them from the similarity."""
    maps = _few(_side(texts, "row").withColumnRenamed("row", "of"), BROADCAST_MAPS)
    left = left.join(maps, F.col("row") == F.col("of"))
    x, y = (left.select("band", "main", F.col("row").alias(c), F.col("root").alias(f"root_{c}"), F.col("shingles_row").alias(f"shingles_{c}"), *(F.col(f"{w}_row").alias(f"{w}_{c}") for w in MAP)) for c in "ab")
    # rows of the root that most have are only met, never compared with each other: what the join looks at grows with the pairs
    near = "root_a <> root_b and (root_b = main or a < b) and 5 * least(shingles_a, shingles_b) >= 4 * greatest(shingles_a, shingles_b)"
    return _ordered(x.where("root_a <> main").drop("main").join(y, "band").where(near).where(_may_link()))


def _told(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(a, b), without those whose bitmaps alone keep them from the similarity."""
    few = texts.count() <= BROADCAST_MAPS
    for c in "ab":
        pairs = pairs.join(F.broadcast(_side(texts, c)) if few else _side(texts, c), c)
    return pairs.where(_may_link()).select("a", "b")


def _near(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of a row and the centre of one of its bands."""
    return _told(_ordered(groups.where("row <> centre").select(F.col("centre").alias("a"), F.col("row").alias("b"))), texts)


def _beside(many: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components of a row of many and the NEXT ones of its band in the order of their sizes. Near copies of one
    line have few components left then, however many they are."""
    order = Window.partitionBy("band").orderBy("size", "row")
    ahead = F.array(*(F.lead(F.struct("row", "root"), k).over(order) for k in range(1, NEXT + 1)))
    pairs = many.select("row", "root", ahead.alias("ahead")).select(F.col("row").alias("a"), "root", F.explode("ahead").alias("other"))
    return _told(_ordered(pairs.where("root <> other.root").select("a", F.col("other.row").alias("b"))), texts)


def _relabelled(labels: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """labels(row, root) after the links found(a, b): components of the old roots, which are few."""
    of = lambda c: labels.select(F.col("row").alias(c), F.col("root").alias(f"root_{c}"))
    pairs = _few(found).join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    new = components(pairs, scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return scratch.save(labels.join(_few(scratch.save(new)), "root", "left").select("row", F.coalesce("top", "root").alias("root")))


def _split(large: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """tokens(row, size, band) of large(row, size, centre): the bands are the shingles that a row has beyond its centre."""

    def beyond(batches):
        for b in batches:
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            rows, hashes = rests(cols["line_centre"], cols["line_row"])
            # Rests are told apart by their centres.
            bands = mix(hashes ^ mix(cols["centre"].to_numpy().astype(np.uint64))[rows]).view(np.int64)
            yield pa.RecordBatch.from_arrays([cols["row"].take(pa.array(rows)), cols["size"].take(pa.array(rows)), pa.array(bands)], names=["row", "size", "band"])

    side = lambda c: texts.select(F.col("row").alias(c), F.col("line").alias(f"line_{c}"))
    met = large.where("row <> centre").select("row", "size", "centre").distinct().join(side("row"), "row").join(side("centre"), "centre")
    return scratch.save(met.select("row", "size", "centre", "line_row", "line_centre").mapInArrow(beyond, "row long, size long, band long"))


def _linked(groups: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, root) of the rows of groups(band, row, size, centre, rows), all pairs that share a band being decided."""
    labels, most = scratch.save(groups.select("row").distinct().withColumn("root", F.col("row"))), ALL

    def linked(pairs: DataFrame) -> bool:
        nonlocal labels
        found = scratch.save(_verified(texts, scratch.save(pairs)))
        if any_found := bool(found.limit(1).count()):
            labels = _relabelled(labels, found, scratch)
        return any_found

    while True:
        linked(_near(groups, texts))
        left = _mixed(groups, labels, scratch)
        many = left.where(F.col("pairs") > MANY * F.col("rows"))
        if many.limit(1).count() and linked(_beside(many, texts)):
            left = _mixed(left.drop("root", "main", "pairs"), labels, scratch)
        few = F.col("pairs") <= most * F.col("rows")
        linked(_apart(left.where(few), texts))
        large = left.where(~few)
        if not large.limit(1).count():
            return labels
        split = _split(large, texts, scratch)
        scratch.drop(groups, left)
        groups = _grouped(split, scratch)
        groups = _mixed(groups, labels, scratch).drop("root", "main", "pairs")
        scratch.drop(split)
        most *= MORE


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row of docs with a kept line, the lines in order; blank lines go."""
    kept = fuzzy_lines(docs, id_col, text_col).where("kept").select("doc_id", "line_no")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return lines.join(kept, ["doc_id", "line_no"]).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
