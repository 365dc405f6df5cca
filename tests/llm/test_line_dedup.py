import re

from lotlens.llm import line_dedup, queries


def test_units():
    text = "One two three four five six seven eight. Short one.\n  a b c d e f g h i \n\nx"
    got = [(text[a:b], n, form) for a, b, n, form in line_dedup.split_units(text)]
    assert got == [
        ("One two three four five six seven eight.", 8, "one two three four five six seven eight"),
        ("a b c d e f g h i", 9, "a b c d e f g h i"),
    ]


def test_operator_edges(spark):
    line = "the quick brown fox jumps over the lazy dog"
    rows = [
        (3, f"Intro. {line.upper()}.\nmore", "x"),
        (1, f"{line}\n{line}", "y"),
        (2, None, None),
        (2, "", None),
        (None, f"é {'z ' * 30000}\n{line}!", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {(r.doc_id, r.start, r.end, r.first_doc_id) for r in line_dedup.find_repeats(docs).collect()}
    at = len(f"é {'z ' * 30000}\n")
    assert got == {(3, 7, 7 + len(line) + 1, 1), (1, 44, 87, 1), (None, at, at + len(line) + 1, 1)}
    clean = {r.doc_id: r.text for r in line_dedup.remove_repeats(docs).collect() if r.doc_id != 2}
    assert clean[3] == "Intro. \nmore" and clean[1] == line + "\n"
    assert line_dedup.find_repeats(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    seen, want = {}, set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        at = 0
        for part in re.split(r"(\n|(?<=[.!?])\s+)", r.text):
            words = part.lower().split()
            if len(words) >= line_dedup.LEAST_WORDS:
                form = " ".join(words).strip(" .,;:!?\"'()[]-")
                if form in seen:
                    want.add((r.doc_id, at + len(part) - len(part.lstrip()), seen[form]))
                seen.setdefault(form, r.doc_id)
            at += len(part)
    got = {(r.doc_id, r.start, r.first_doc_id) for r in queries.op7_line_dedup(spark, sf).collect()}
    assert got == want


def test_documents_are_counted_by_id(spark):
    line = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line), (None, line)], "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.find_repeats(docs.filter("doc_id is not null")).select("doc_id", "first_doc_id", "n_docs").collect())
    assert got == [(2, 1, 2)]
    assert {r.n_docs for r in line_dedup.find_repeats(docs).collect()} == {3}


def test_a_frequent_line_is_found_everywhere(spark):
    line = "the quick brown fox jumps over the lazy dog"
    docs = spark.range(3000).selectExpr("id AS doc_id", f"if(id % 2 = 0, '{line}', concat('one two three four five six seven eight ', id)) AS text")
    got = line_dedup.find_repeats(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(2, 3000, 2)) and {(r.first_doc_id, r.n_docs) for r in got} == {(0, 1500)}


def test_own_names_do_not_clash(spark):
    line = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, line), (2, f"new {line}\n{line}")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'a' AS removed", "'b' AS _cut_id", "'c' AS row", "'d' AS spans", "'e' AS id")
    got = {r.doc_id: r for r in line_dedup.remove_repeats(docs).collect()}
    assert got[2].text == f"new {line}\n" and got[2].removed_in == "a" and got[2]["_cut_id"] == "b" and got[2]["row"] == "c"
