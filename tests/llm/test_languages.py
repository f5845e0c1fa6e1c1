"""Documents of more than three languages."""

from parley.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_a_document_of_all_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learn(docs)
    rows = docs.where("lang is not null").orderBy("doc_id").collect()
    joined = " ".join(" ".join(r.text for r in [r for r in rows if r.lang == lang][:6]) for lang in model[0])
    found = language.identify(spark.createDataFrame([(1, joined)], "doc_id long, text string"), model).first()
    assert len(model[0]) > 3 and {m.lang for m in found.mixture} == set(model[0])
    assert abs(sum(m.share for m in found.mixture) - 1) < 1e-3
