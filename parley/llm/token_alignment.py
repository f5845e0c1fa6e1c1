"""Alignment of the tokens of two tokenizers: a byte-level one (A) and one with pieces (B).

A's vocabulary is read as ranks, which a faster library takes and whose ids are those of its merges (a test holds both
against each other over every code point and random texts).

Each text is encoded by both in an Arrow task. Per byte a label says whether no token, an A token, a B token or both end there; a
regular expression runs over the label string and yields the spans up to each "both", whose labels counted are the token
groups. Every byte with a label ends one overlap of an A and a B token, so the links are read from the same string. The
links of all documents are counted by id pair in Spark; each document's links then look up their pairs' counts:
frequent pairs, HOT at most, in a broadcast table, the rest by a join on the pair, which no longer holds a hot key.

Long texts are encoded in sections of about SECTION characters. A section ends only before a single space between two
characters that are not white space: neither tokenizer joins what stands on either side of it, and both end a token
there, so sections give the tokens of the whole text. A text without such places is one section, however long.

Defined results: a null or empty text, and one whose tokens' bytes are not the text's with a space before it (in either tokenizer),
has no tokens: zeros and an empty groups string. Repeated rows count each for itself. Null ids stay null. Other
columns of the documents, whatever their names, are left behind.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Fixed value: the pattern by which the byte-level vocabulary's texts are split before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SECTION = 20_000
#: Pairs with at least this share of all links are looked up in a broadcast table: HOT at most, as shares add up to one.
HOT = 500_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPAN = re.compile(rb"[\x00-\x02]*\x03")


class Side:
    """One tokenizer: encode() gives lists of ids; data and offsets hold the bytes of every token."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode = encode
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = [np.array([f"{i}{end}".encode() for i in range(len(tokens))], object) for end in ",|;"]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        at = np.repeat(self.offsets[ids] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return self.data[at].tobytes()


@lru_cache(2)
def sides(folder: str = TOKENIZERS) -> tuple[Side, Side]:
    """Both tokenizers, loaded once a Python worker."""
    import sentencepiece
    import tiktoken

    with open(os.path.join(folder, A_FILE), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
    pieces = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, range(len(b)))]
    return Side(tokens, lambda texts: [a.encode_ordinary(f" {t}") for t in texts]), Side(pieces, lambda texts: b.encode(texts, num_threads=1))


def sections(text: str, most: int = SECTION) -> list[str]:
    """A text in parts of about ``most`` characters or more, which joined by spaces are the text."""
    out, first = [], 0
    while len(text) - first > most and (cut := _CUT.search(text, first + most)):
        out.append(text[first : cut.start()])
        first = cut.end()
    return [*out, text[first:]]


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> np.ndarray:
    """Per byte: 0 none, 1 an A token ends, 2 a B token ends, 3 both."""
    out = np.zeros(size, np.uint8)
    out[ends_a - 1] = 1
    out[ends_b - 1] |= 2
    return out


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens, B tokens) of each group, and the A and B ids of each link, of tokens that tile the same bytes."""
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    marks = labels(ends_a, ends_b, int(ends_a[-1]))
    spans = np.cumsum(np.fromiter(map(len, _SPAN.findall(marks.tobytes())), np.int64))
    at = np.flatnonzero(marks)
    told = marks[at]
    # Tokens that have ended up to each label.
    in_a, in_b = np.cumsum(told & 1, dtype=np.int64), np.cumsum(told >> 1, dtype=np.int64)
    last = np.searchsorted(at, spans - 1)
    return np.diff(in_a[last], prepend=0), np.diff(in_b[last], prepend=0), ids_a[in_a - (told & 1)], ids_b[in_b - (told >> 1)]


def group_names(ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, a: Side, b: Side) -> bytes:
    """Groups as a1,a2|b1;a3|b2,b3; with a ; behind the last one too."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    for side, ids, own, begin, last in ((a, ids_a, in_a, np.cumsum(in_b) - in_b, 1), (b, ids_b, in_b, np.cumsum(in_a), 2)):
        at = np.arange(len(ids)) + np.repeat(begin, own)
        out[at] = side.names[0][ids]
        ends = np.cumsum(own) - 1
        out[at[ends]] = side.names[last][ids[ends]]
    return b"".join(out)


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(row, section) of all texts, some hundred thousand characters at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for part in sections(text) if text else ():
            held.append((row, part))
            size += len(part)
            if size > 10 * SECTION:
                yield held
                held, size = [], 0
    if held:
        yield held


def _encoded(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(folder)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            counts, names, pairs, bad = np.zeros((n, 4), np.int64), [None] * n, [[] for _ in range(n)], set()
            for held in _parts(texts):
                for (row, part), ids_a, ids_b in zip(held, a.encode([t for _, t in held]), b.encode([t for _, t in held])):
                    if row in bad:
                        continue
                    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
                    want = f" {part}".encode()
                    if a.bytes_of(ids_a) != want or b.bytes_of(ids_b) != want:
                        bad.add(row)
                        continue
                    in_a, in_b, link_a, link_b = aligned(ids_a, ids_b, a, b)
                    counts[row] += len(ids_a), len(ids_b), len(in_a), len(link_a)
                    told = group_names(ids_a, ids_b, in_a, in_b, a, b)
                    names[row] = names[row] or hashlib.sha256()
                    # The ; behind a section's last group comes before the next section's first one, if there is one.
                    names[row].update((b";" if counts[row][2] > len(in_a) else b"") + told[:-1])
                    pairs[row].append(np.stack(np.unique(link_a * width + link_b, return_counts=True)))
            for row in bad:
                counts[row], names[row], pairs[row] = 0, None, []
            lists, sizes = [], np.zeros(n + 1, np.int64)
            for row, own in enumerate(pairs):
                if len(own) > 1:
                    keys, place = np.unique(np.concatenate([p[0] for p in own]), return_inverse=True)
                    own = [np.stack([keys, np.bincount(place, np.concatenate([p[1] for p in own])).astype(np.int64)])]
                lists += own
                sizes[row + 1] = own[0].shape[1] if own else 0
            flat = np.concatenate(lists, 1) if lists else np.zeros((2, 0), np.int64)
            offsets = pa.array(np.cumsum(sizes).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in ((flat[0], np.int64), (flat[1], np.int32))]
            digests = pa.array([h.hexdigest() if h else "" for h in names], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts.T), digests, *arrays], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, hot: int = HOT) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document. folder must be on every executor."""
    scratch = Scratch(docs.sparkSession)
    kind, width = docs.schema[id_col].dataType.simpleString(), len(sides(folder)[1].lengths)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told = rows.mapInArrow(_encoded(folder, width), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    # Numbers of rows are made once, before the table is written; later steps read them.
    told = scratch.save(told.withColumn("row", F.monotonically_increasing_id()))
    each = told.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = scratch.save(each.groupBy("pair").agg(F.sum("times").alias("count")))
    best = counts.groupBy(F.pmod("pair", F.lit(width)).alias("b")).agg(F.max("count").alias("most"))
    marked = counts.join(F.broadcast(best), F.pmod("pair", F.lit(width)) == F.col("b")).select(F.col("pair").alias("known"), "count", (F.col("count") == F.col("most")).alias("is_best"))
    marked = scratch.save(marked)
    total = marked.agg(F.sum("count")).first()[0] or 0
    least = total // hot + 1
    sums = [F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    met = each.join(F.broadcast(marked.where(F.col("count") >= least)), F.col("pair") == F.col("known"), "left")
    found = met.where("known is not null").groupBy("row").agg(*sums)
    if marked.where(F.col("count") < least).limit(1).count():
        rest = met.where("known is null").select("row", "pair", "times").join(marked.where(F.col("count") < least), F.col("pair") == F.col("known")).groupBy("row").agg(*sums)
        found = found.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = told.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(found, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
