import zlib

import numpy as np

from lotlens.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_features_do_not_depend_on_neighbours():
    together = langid.features(["Hello there", "", "déjà vu, 12"])
    alone = [langid.features([t])[0] for t in ("Hello there", "", "déjà vu, 12")]
    assert np.array_equal(together, np.array(alone))


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, (200, 5)).astype(np.float32)
    y = np.where(np.arange(200) % 2, 1.0, -1.0).astype(np.float32)
    x[:, 2] += y / 2
    w = langid.fit_svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.98


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op5_langid(spark, SF).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_operator_edges(spark):
    rows = [(i, f"the thing and that {i}", "en", "x") for i in range(40)]
    rows += [(40 + i, f"la casa que es una {i}", "es", "x") for i in range(40)]
    rows += [(None, None, "en", None), (90, "", "es", "y"), (91, "12 34", None, "y"), (91, "12 34", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert {(None, "und"), (90, "und"), (91, "und"), (0, "en"), (79, "es")} <= got
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    only = langid.train(docs.filter("lang = 'en'"))
    assert "es" not in {r.lang_pred for r in langid.identify(docs, only).collect()}


def test_every_language_is_learned_from_a_bounded_sample(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26] + letters[(k * 7) % 26]
    rows = [(100 * k + i, f"{word(k)} " * 8 + f"{word(k)}{i}", f"l{k:02}") for k in range(70) for i in range(12 if k else 60)]
    rows += [(100, f"{word(1)} again {i}", "l01") for i in range(400)]  # one id many times
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_lang=10)
    assert model.families == [f"l{k:02}" for k in range(70)]
    truth = {r[0]: r[2] for r in rows if r[0] != 100}
    found = [r for r in langid.identify(docs, model).collect() if r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) / len(found) > 0.95
