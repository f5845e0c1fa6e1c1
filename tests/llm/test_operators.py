"""The corpus operators against brute force, on awkward rows and on held-out labels."""

import math
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from parley.llm import decontamination, html, jaccard_join, language, licenses, line_dedup, mixing, neighbours, registry, sharding, toxicity
from parley.llm.graph import components
from parley.llm.scratch import Scratch
from parley.llm.words import shingle_sets

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, node long, size long, gram long, component_id string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
AWKWARD = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "en", "b"), (4, "one", "en", None), (5, "ONE", None, "a"), (6, "éa ß 中文 words of a text", "fr", "é"),
    (7, "the same line\nthe same line\nand another line of text", "en", "a"), (8, LONG, "en", "a"), (9, LONG + " tail", "en", "a"), (9, LONG + " tail", "en", "a"), (None, "a b c d e f", "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, lang, s, 0, 0, 0, "x") for i, t, lang, s in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def sets_of(texts, n):
    return [set(g.tolist()) for _, g in shingle_sets(pa.array(texts, pa.string()), n)]


def brute_components(ids, sets, percent):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_shingles_are_those_of_words():
    texts = ["a b c a b c", "A  b\tC", "", None, "a b c", "x", "b c a"]
    found = sets_of(texts, 3)
    assert [len(s) for s in found] == [3, 1, 0, 0, 1, 1, 1]
    assert found[1] < found[0] and found[6] < found[0]
    assert sets_of(["a b"], 3) != sets_of(["a b c"], 3)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, n, percent):
    docs = docs_of(spark)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 60, 70)]
    near = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 70, i % 5):
            words[at] = f"n{rng.integers(0, 9)}"
        near.append((10_000 + i, " ".join(words)))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = docs.collect()
    want = brute_components([r.doc_id for r in rows], sets_of([r.text for r in rows], n), percent)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, n, percent).collect()}
    assert got == want


def test_jaccard_awkward(awkward, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(awkward, 3, 90).collect()), key=str)
    assert len(got) == len(AWKWARD)
    told = {i: (n, c) for i, n, c in got}
    assert told[1] == (0, 1) and told[2] == (0, 2) and told[5] == (1, 4) and told[9][1] == 8 and told[None][1] is None
    assert jaccard_join.jaccard_components(nothing).count() == 0
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, None]))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("lookup", [10**6, 0])
def test_decontamination(spark, lookup):
    docs, items = docs_of(spark), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    extra = items.limit(4).select((items["item_id"] + 50_000).alias("doc_id"), items["text"])
    docs = docs.select("doc_id", "text").union(extra)
    d, i = docs.collect(), items.collect()
    ds, its = sets_of([r.text for r in d], 5), sets_of([r.text for r in i], 5)
    want = {(r.doc_id, q.item_id, len(s & t)) for r, s in zip(d, ds) for q, t in zip(i, its) if t and 100 * len(s & t) >= 80 * len(t)}
    got = {(r.doc_id, r.item_id, r.shared) for r in decontamination.contained_items(docs, items, lookup=lookup).collect()}
    assert got == want and len(got) >= 4


def test_decontamination_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, " ".join(LONG.split()[:40]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(awkward, items).collect()}
    assert got == {(4, 1), (5, 1), (8, 4), (9, 4)}
    assert decontamination.contained_items(nothing, items).count() == decontamination.contained_items(awkward, items.limit(0)).count() == 0


def test_apportion():
    rng = np.random.default_rng(2)
    for _ in range(40):
        votes, seats = rng.integers(0, 50, rng.integers(1, 9)).astype(float), int(rng.integers(0, 60))
        want = [0] * len(votes)
        for _ in range(seats if votes.sum() else 0):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.apportion(votes, seats).tolist() == want


@pytest.mark.parametrize("source", ["given", "awkward"])
def test_mixing(spark, awkward, nothing, source):
    docs = docs_of(spark) if source == "given" else awkward
    p, again = (mixing.mix_sources(docs).toPandas() for _ in range(2))
    key = ["doc_id", "size", "taken"]
    assert p[key].sort_values(key, ignore_index=True).equals(again[key].sort_values(key, ignore_index=True))
    assert len(p) == docs.count() and (p["taken"] <= 3 * p["size"]).all() and (p["taken"] >= 0).all()
    g = p.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((g["taken"] - g["target"]).abs() <= 1 + 0.01 * g["target"]).all() and g["target"].sum() == pytest.approx(g["size"].sum())
    assert mixing.mix_sources(nothing).count() == 0


def seats_one_by_one(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_words_taken_by_a_plain_version(spark, monkeypatch):
    """Shares, blocks, shards and the words taken of each document, step by step."""
    monkeypatch.setattr(mixing, "BLOCKS", 400)
    monkeypatch.setattr(mixing, "ROWS", 20)
    docs = docs_of(spark)
    order = {r.doc_id: (r.h, r.doc_id, r.n) for r in docs.selectExpr("doc_id", r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) n").selectExpr("doc_id", "n", "xxhash64(doc_id, cast(n as long), 11) h").collect()}
    of = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sources = sorted(set(of.values()), key=lambda s: (s is None, s or ""))
    size = {s: sum(order[i][2] for i in of if of[i] == s) for s in sources}
    total, target, full = sum(size.values()), {}, set()
    while True:
        left, weight = total - sum(target[s] for s in full), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources) if s not in full}
        target |= {s: left * w / sum(weight.values()) for s, w in weight.items()}
        over = {s for s in weight if target[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over}
        full |= over
        if not over:
            break
    block = max(1, total // 400)
    blocks = dict(zip(sources, seats_one_by_one([target[s] for s in sources], total // block)))
    want = {}
    for s in sources:
        own = [order[i] for i in of if of[i] == s]
        n = max(1, len(own) // 20)
        shards = [sorted(o for o in own if ((o[0] % 2**64) >> 20) % n == k) for k in range(n)]
        shards = [x for x in shards if x]
        sizes = [sum(o[2] for o in x) for x in shards]
        quota = [min(q * block, 3 * z) for q, z in zip(seats_one_by_one(sizes, blocks[s]), sizes)]
        for k in range(len(quota)):
            quota[k] += max(0, min(blocks[s] * block - sum(quota), 3 * sizes[k] - quota[k]))
        for x, q in zip(shards, quota):
            while q and sum(o[2] for o in x):
                for _, i, z in x:
                    want[i] = want.get(i, 0) + min(q, z)
                    q -= min(q, z)
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    assert got == {i: want.get(i, 0) for i in of} and len(set(sources)) > 2


def test_mixtures_converge():
    """Shares of random documents against expectation-maximisation one by one, run on and on."""
    rng = np.random.default_rng(4)
    sizes = [1, 2, 5, 40, 300, 7]
    starts = np.cumsum([0, *sizes[:-1]])
    like, count = rng.random((sum(sizes), 4)) ** 3 + 1e-4, rng.integers(1, 9, sum(sizes)).astype(float)
    allowed = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0], [1, 1, 1, 0], [1, 1, 1, 1], [0, 1, 1, 1]], float)
    share, fit = language._mixture(like, count, starts, np.repeat(np.arange(6), sizes), allowed)
    for k, (begin, n) in enumerate(zip(starts, sizes)):
        x, c, p = like[begin : begin + n], count[begin : begin + n], allowed[k] / allowed[k].sum()
        for _ in range(20_000):
            z = x * p
            p = ((z / z.sum(1, keepdims=True)) * c[:, None]).sum(0) / c.sum()
        best = (np.log((x * p).sum(1)) * c).sum()
        assert best - 0.01 * c.sum() <= fit[k] <= best + 1e-6 and np.abs(share[k] - p).max() < 0.15 and (share[k][allowed[k] == 0] == 0).all()


@pytest.mark.parametrize("source", ["given", "awkward"])
def test_sharding(spark, awkward, nothing, source):
    docs = docs_of(spark) if source == "given" else awkward
    p = sharding.shards(docs).toPandas()
    rows = docs.collect()
    assert sorted(p["size"]) == sorted(len((r.text or "").encode()) + 1 for r in rows)
    assert {(r.doc_id, None if r.text is None else crc32(r.text.encode())) for r in rows} == {(None if math.isnan(i) else i, None if pd.isna(c) else c) for i, c in zip(p["doc_id"], p["text_crc32"])}
    for _, own in p.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    if source == "given":
        sizes = p.groupby("shard")["size"].sum()
        assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * p["size"].max()
    assert sharding.shards(nothing).count() == 0


def test_sharding_cuts_a_hot_text(spark):
    docs = spark.createDataFrame([(i, "copy " * 40 if i % 3 else f"text {i}") for i in range(6_000)], "doc_id long, text string")
    sizes = sharding.shards(docs).toPandas().groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.05 * sizes.mean()


def test_neighbours(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got, p = neighbours.nearest(e).toPandas(), e.toPandas()
    v, ids, hit = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy(), 0
    for q, own in got.groupby("query_id"):
        score = v @ v[ids == q][0]
        top = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hit += len(set(top) & set(own["vec_id"]))
        assert own.sort_values("rank")["score"].is_monotonic_decreasing and len(own) == 20
    assert hit >= 0.9 * 20 * got["query_id"].nunique()


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (20, [0.0, 3.0]), (9, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(e).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 7, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 7, 0.0)]
    assert neighbours.nearest(e.limit(0)).count() == 0


def test_language(spark, awkward, nothing):
    p = registry.op1_language(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    held = p[p["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    model = language.learn(docs_of(spark))
    got = {r.doc_id: r for r in language.identify(awkward, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    half = spark.createDataFrame([(1, " ".join(r.text for r in docs_of(spark).where("lang in ('en', 'de')").limit(8).collect()))], "doc_id long, text string")
    assert {m.lang for m in language.identify(half, model).first().mixture} == {"de", "en"}
    assert language.identify(awkward, language.learn(nothing)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(nothing, model).count() == 0


def test_toxicity(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = registry.toxicity_model(docs, labels)
    tried = {"kind words": 0, "you idiot": 1, "i.d.i.o.t": 1, "an i d i o t": 1, "": 0, None: 0}
    got = toxicity.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [int(r.score >= 0.5) for r in got] == list(tried.values())
    assert toxicity.score(awkward, model).count() == len(AWKWARD) and toxicity.without_toxic(awkward, model).count() == len(AWKWARD)
    assert toxicity.score(nothing, model).count() == toxicity.without_toxic(nothing, model).count() == 0
    assert toxicity.score(awkward, toxicity.learn(nothing.withColumn("toxic", nothing["size"]))).where("score >= 0.5").count() == 0


def test_html(spark):
    page = "<html><body><nav><a>Home</a></nav><div class='cookie-notice'>Cookies</div><div id=main>{}<p>{} &amp; more<br>text</div><div class=comments>Bad</div><p>All rights reserved</p></body></html>"
    rows = [(i, f"http://h/{i}", page.format(f"<h2>Title {i}</h2>", f"Body   <b>number</b> {i} " + "long " * i)) for i in range(3, 9)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://x/", "<article>A<p>B<script>x</script></article> out"), (22, "http://x/", "<article>A<p>B<script>x</script></article> out"), (23, "http://y", "<p>open <i>it"), (24, "http://y", "<" * 5000 + "div" * 1000)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3 Body number 3 long long long & more text" and got[20] == got[21] == "" and got[22] == "A B" and got[23] == "open it"


def test_licenses(spark, awkward, nothing):
    text = "some words before Released under the MIT License. and after"
    rows = [(1, text), (2, "Released, under the MIT License."), (3, "released nothing"), (4, f"{LONG} {text}"), (5, None), (6, "under the MIT License. Released")]
    got = {(r.doc_id, r.license): (r.coverage, r.first_word, r.end_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"): (1.0, 3, 8), (2, "MIT"): (1.0, 0, 5), (4, "MIT"): (1.0, 30_003, 30_008), (6, "MIT"): (0.8, 0, 4)}
    assert licenses.align(list("abcxde"), list("zabcde")) == [(0, 1), (1, 2), (2, 3), (4, 4), (5, 5)]
    assert licenses.scan(awkward).count() == licenses.scan(nothing).count() == 0


def test_lines(spark, awkward, nothing):
    base = "this is a rather long line of plain text that a page repeats with small changes in it"
    rows = [(1, f"{base}\nshort"), (2, base.upper()), (3, base.replace("plain", "plane") + "\n\nsomething else altogether stands here"), (4, "short\n  short "), (5, None)]
    got = {(r.doc_id, r.line_no): ((r.component_doc, r.component_line), r.kept) for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0): ((1, 0), True), (1, 1): ((1, 1), True), (2, 0): ((1, 0), False), (3, 0): ((1, 0), False), (3, 2): ((3, 2), True), (4, 0): ((1, 1), False), (4, 1): ((1, 1), False)}
    assert line_dedup.fuzzy_lines(awkward).count() and line_dedup.fuzzy_lines(nothing).count() == 0


def test_lines_of_each_kind(spark):
    """Every link that brute force finds among short, middle, long and unspaced lines with small edits."""
    words = [r.w for r in spark.sql("select substr(sha2(cast(id as string), 256), 1, 2 + cast(id % 9 as int)) as w from range(4000)").collect()]
    lines = []
    for k in range(60):
        own = words[k * 60 : k * 60 + (7, 30, 60)[k % 3] * (1 + k % 2)]
        lines += [" ".join(own), " ".join(own[:-2] + ["zq"] + own[-1:]), " ".join([own[0][::-1]] + own[1:])]
    cjk = "".join(chr(0x4E00 + 37 * i % 4001) for i in range(300))
    lines += [cjk, cjk[:100] + cjk[103:], cjk[:200] + "x" + cjk[200:]]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))
    for b in range(len(lines)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[a] if r == root[b] else r for r in root]
    got = line_dedup.fuzzy_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    of = {r.doc_id: r.component_doc for r in got}
    assert all(root.index(root[i]) <= c and root[c] == root[i] for i, c in of.items())
    missed = sum(root.index(root[i]) != c for i, c in of.items())
    assert len(set(root)) < 150 and missed <= 2  # windows are MinHash: a long line may miss one


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() < docs.count()
    one = corpus_pipeline.one_of_each_group(spark, clean, folder)
    rows = clean.collect()
    want = brute_components([r.doc_id for r in rows], sets_of([r.text for r in rows], 5), 80)
    assert {r.doc_id for r in one.collect()} == set(want.values())
    free = corpus_pipeline.drop_contaminated(spark, one, folder)
    items = [s for s in sets_of([r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 5) if s]
    held = one.collect()
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r, s in zip(held, sets_of([r.text for r in held], 5)) if not any(100 * len(s & t) >= 80 * len(t) for t in items)}
    mixed = corpus_pipeline.mix(spark, free, folder)
    assert mixed.columns == docs.columns and mixed.count() == corpus_pipeline.shard(spark, mixed, folder).count()
