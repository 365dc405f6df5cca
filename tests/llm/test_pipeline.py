import sys

import corpus_pipeline
from lotlens.llm import packing, secrets, toxicity
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r.doc_id: r.text for r in table.collect() if model.score(r.text) < 0.5}
    last = {}
    for i in sorted(docs):
        last[_lower(docs[i])] = i
    docs = {i: docs[i] for i in last.values()}
    docs = {i: docs[i] for i, _, c, _ in brute(docs.items()) if i == c}
    for i, text in docs.items():
        taken = sorted((a, b) for _, a, b, _ in secrets.scan(text))
        merged = []
        for a, b in taken:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        docs[i] = text
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.split()) for i, t in docs.items()}
    assert all(r.padding >= 0 for r in got) and packing.BUDGET


def test_stages_keep_the_columns(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.limit(20).collect() + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, table.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.schema.names == table.schema.names
        assert [f.dataType for f in kept.schema] == [f.dataType for f in table.schema]
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_entry_works_without_the_subpackage():
    assert "corpus_pipeline" in sys.modules
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
