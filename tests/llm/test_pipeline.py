"""run() against a plain version of its stages, and every stage on odd rows."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from parley.llm import mixing, registry, toxicity

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = registry.toxicity_model(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    left = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id not in toxic}
    root = {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            both = len(left[a] & left[b])
            if a < b and both and 100 * both >= 80 * (len(left[a]) + len(left[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    items = [s for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if (s := shingles(r.text))]
    kept = [i for i in left if root[i] == i and not any(100 * len(s & left[i]) >= 80 * len(s) for s in items)]
    taken = mixing.mix_sources(docs.where(docs["doc_id"].isin(kept))).where("size > 0").collect()
    want = Counter({r.doc_id: int(r.taken / r.size + 0.5) for r in taken if int(r.taken / r.size + 0.5)})
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert toxic and len(kept) < len(left) < docs.count()
    assert Counter(r.doc_id for r in got) == want
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


ODD = [(1, None, None, "a"), (1, None, None, "a"), (2, "", "en", None), (3, " \n", "en", "b"), (4, "one", None, "a"), (None, "a b c d e f", "en", None), (5, "x y z " * 5000, "en", "b"), (6, "x y z " * 5000, "en", "b"), (6, "x y z " * 5000, "en", "b")]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, taken long, times int, gone long, component_id long, shard_size long"
    odd = spark.createDataFrame([(*r, 0, 1, 2, 3, 4, 5) for r in ODD], schema)
    nothing = stage(spark, odd.limit(0), FOLDER)
    assert nothing.count() == 0 and (k == 4 or nothing.columns == odd.columns)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in stage(spark, odd, FOLDER).collect())
    ids = [None if none else i for none, i in got]
    if name == "n-gram Jaccard join":
        assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 5]
    elif name == "mixing sources to target weights":
        taken = {(r.doc_id, r.size): int(r.taken / r.size + 0.5) for r in mixing.mix_sources(odd).where("size > 0").collect()}
        want = Counter()
        for i, text, *_ in ODD:
            want[i] += taken.get((i, len((text or "").split())), 0)
        assert Counter(ids) == +want and None in ids and 5 in ids
    else:
        assert len(ids) == len(ODD)


def test_rows_without_an_id_or_with_one_that_repeats(spark):
    """A contaminated row goes and clean ones stay, whatever their ids; the mix keeps rows without an id."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, f"before {item} after"), (None, "clean words without an id"), (None, None), (7, item), (7, "clean words under a repeated id"), (7, "clean words under a repeated id"), (8, f"x {item} y {item}")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
    mixed = corpus_pipeline.mix(spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    told = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert (None, rows[0][1]) in told and (None, None) not in told and told[rows[4]] % 2 == 0
