import zlib

from lotlens.llm import queries
from lotlens.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def test_grammar():
    i, n, r, y, k = (t.INSULT, 2.0), (t.NEGATION, 0.0), (t.REPORT, 0.0), (t.TARGET, 0.0), (t.THREAT, 1.0)
    p = (t.PLAIN, 0.0)
    assert t.clause_score([p, i]) == 2.0
    assert t.clause_score([y, p, i]) == 3.0
    assert t.clause_score([n, p, i]) == 0.8
    assert t.clause_score([n, p, p, p, i]) == 2.0  # beyond the negation's reach
    assert abs(t.clause_score([r, i]) - 1.2) < 1e-9
    assert t.clause_score([k]) == 0.2 and t.clause_score([y, k]) == 1.0
    assert abs(t.clause_score([r, n, i]) - 0.48) < 1e-9


def test_clauses_and_score():
    model = t.Model({"idiot": 2.0, "lowei*": 3.0}, [1.0, 1.0, 0.0, -3.0])
    assert model.clauses("A calm day. You idiot, go.\nThen loweiung came") == [3.0, 3.0]
    assert model.score(None) == model.score("") < 0.5 < model.score("You idiot! An idiot.")


def test_held_out_quality(spark):
    found = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = 0
    right = 0
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        f = found[r.doc_id]
        assert f.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= f.score <= 1 and f.predicted == int(f.score >= 0.5)
        held += f.held_out
        right += f.held_out and f.predicted == r.toxic
    assert right / held > 0.9


def test_operator_edges(spark):
    rows = [(i, f"you are a zorbnik {i} here", "x") for i in range(30)]
    rows += [(100 + i, f"a calm day number {i} here", "y") for i in range(60)]
    rows += [(None, "zorbnik zorbnik!", None), (300, None, None), (300, None, None), (301, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    model = t.train(docs, labels)
    assert "zorbnik" in model.stems
    got = {r.doc_id: r.predicted for r in t.score(docs, model).collect()}
    assert got[None] == 1 and got[300] == 0 and got[301] == 0 and got[0] == 1 and got[100] == 0
    kept = t.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 63
    assert t.score(docs.limit(0), model).count() == 0
    nothing = t.train(docs, labels.limit(0))
    assert {r.predicted for r in t.score(docs, nothing).collect()} == {0}


def test_rare_insults_are_learned(spark):
    rows = [(i, f"you are a zorbnik {i} here" if i > 30 else f"you are a quexling {i} here") for i in range(600)]
    rows += [(1000 + i, f"a calm day number {i} here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id < 1000, 1, 0) AS toxic").filter("doc_id > 20")
    model = t.train(docs, labels)  # at most 10 of about 480 toxic rows hold it
    assert "quexling" in model.stems and model.score("a quexling") > model.score("a calm day")


PLANTED = {
    "insult": "a zorbnik and a zorbnik",
    "threat": "i will kill you",
    "target before": "you are a zorbnik",
    "target after": "a zorbnik are you",
    "aimless threat": "kill time",
    "negation": "you are not a zorbnik",
    "reported speech": "he said you are a zorbnik",
}


def test_each_transducer_decides():
    model = t.Model({"zorbnik": 3.0})
    assert set(PLANTED) == set(t.CASCADE)
    for name, text in PLANTED.items():
        (clause,) = model.symbols(text)
        assert t.clause_score(clause) != t.clause_score(clause, without=name), name
    score = lambda text: t.clause_score(model.symbols(text)[0])
    assert score("you are not a zorbnik") < score("a zorbnik") < score("you are a zorbnik")
    assert score("killing time") < score("we are killing them") < score("we will kill them")
    assert score("they said you zorbnik") < score("you zorbnik")


def test_forms_of_threats():
    assert {"kills", "killing", "tötet", "töte", "tue", "tuez", "mataré", "destroyed"} <= t.THREATS
    assert not t.THREATS & {"tu", "but", "bring"} and not t.THREATS & t.TARGETS


def test_clause_features_are_fitted_apart(spark):
    """Reported and negated insults are labelled clean here: the fit must tell them from direct ones."""
    rows = []
    for i in range(200):
        rows += [(4 * i, f"you are a zorbnik number {i}", 1), (4 * i + 1, f"he said a zorbnik not a zorbnik number {i}", 0)]
        rows += [(4 * i + 2, f"a calm day number {i}", 0), (4 * i + 3, f"some day number {i}", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    t_ratio = t.LEAST_RATIO
    try:
        t.LEAST_RATIO, t.LEAST_WEIGHT = 1.5, 0.1
        model = t.train(docs, labels)
    finally:
        t.LEAST_RATIO, t.LEAST_WEIGHT = t_ratio, 2.0
    assert len(model.weights) == t.N_FEATURES + 1
    assert model.score("you are a zorbnik number 7") > 0.5 > model.score("he said a zorbnik not a zorbnik number 7")


def test_held_out_beats_always_clean(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    caught, alarms = sum(s >= 0.5 for s in toxic), sum(s >= 0.5 for s in clean)
    assert caught / len(toxic) > 0.85 and caught / (caught + alarms) > 0.9
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean) > 0.93


def test_own_names_do_not_clash(spark):
    names = ["_toxic", "_labelled", "_text", "_doc", "toxic", "id", "y", "f0"]
    docs = spark.createDataFrame([(i, "you zorbnik" if i % 2 else "a calm day") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic", "'x' AS text", "1 AS _labelled", "2 AS _toxic")
    docs = docs.selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    model = t.train(docs, labels)
    kept = t.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"a calm day"}


def test_keep_clean_resolves_the_text_column_as_spark_does(spark):
    model = t.train(*(spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels")))
    rows = [(1, "You are a worthless idiot", 1, "fine"), (2, "A quiet day.", 2, "You are a worthless idiot"), (3, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, `a.b` int, last string")
    out = t.keep_clean(docs, model)
    scores = {r.doc_id: r.predicted for r in t.score(docs, model).collect()}
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [r for r in rows if not scores[r[0]]]
