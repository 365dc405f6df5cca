import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from lotlens.llm import jaccard, part_enum, queries


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    """(doc_id, size, component, links) by counting every shared shingle; unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent, links, holders, common = {i: i for i in sets}, Counter(), {}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                common[j, i] += 1
            holders[s].append(i)
    for (i, j), c in common.items():
        if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {(i, len(s), find(i), links[i]) for i, s in sets.items()}


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect()}


def test_sets_match_words():
    texts = ["A b\tc D e", "a b c d", "x", "", None, "é É ß", "a b c d e a b c d e", "\x1c a\x0bb", "w " * 3000]
    sets = part_enum.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert len(np.intersect1d(sets[0], sets[1])) == 1
    for text, found in zip(texts, sets):  # neighbours make no difference
        assert np.array_equal(part_enum.shingle_sets([text])[0], found)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(400):
        size = int(rng.integers(3, 700))
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        size = len(base)
        out = int(rng.integers(0, max(1, size // 6) + 1))
        into = int(rng.integers(0, max(1, size // 6) + 1))
        other = np.concatenate([rng.permutation(base)[out:], rng.integers(0, 2**63, into).astype(np.uint64)])
        other = np.unique(other)
        if part_enum.linked(base, other) and not np.array_equal(base, other):
            owner, signature = part_enum.signatures([base, other])
            assert set(signature[owner == 0].tolist()) & set(signature[owner == 1].tolist())


def test_common_counts():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randint(0, 400) for _ in range(rng.randint(1, 90))], np.uint64)) for _ in range(30)]
    got = part_enum.common_counts(sets, sets[:7], columns=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[:7]] for a in sets]


def test_chains_and_hot_groups(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):  # a wide group: many pairs near the threshold on either side
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 - i, " ".join(text)))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(12):  # each links with the next only
        chain = [rng.choice(words) for _ in range(3)] + chain[:-3]
        rows.append((3000 - 7 * i, " ".join(chain)))
    rows += [(4000 + i, "same words in every copy of this text") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.group_similar(docs)) == brute(rows)


def test_operator_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, "A b c d e", "x"), (2, "a b C d e", "x"), (7, None, None), (8, "", "y"), (9, " \n", "y"), (1, "one two", "z"), (3, long, "q"), (4, long + " end", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    plain = docs.drop("component_id")
    assert rows_of(jaccard.group_similar(docs)) == brute([r[:2] for r in rows])
    again = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.group_similar(again).collect()), key=str)
    assert got == [(5, 2, 5, 1), (5, 2, 5, 1), (None, 0, None, 0), (None, 2, None, 0)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 8, 9]
    assert jaccard.group_similar(plain.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op4_jaccard_join(spark, sf)) == brute(docs)


def five_word_pairs(rows, least):
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    ids = sorted(sets)
    return [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def test_pipeline_stage_links_five_words_at_80(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(40):  # as many words changed in the middle as leave the pair on either side of the rule
        base = [rng.choice(words) for _ in range(120)]
        other = list(base)
        for at in rng.sample(range(5, 115), rng.randint(1, 6)):
            other[at] = rng.choice(words)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    pairs = five_word_pairs(rows, 80)
    assert 0 < len(pairs) < 40 and len(pairs) > sum(b in [i for i, _, c, _ in brute(rows) if i != c] for _, b in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - {b for _, b in pairs}


def test_linked_sets_share_a_signature_at_80():
    rng = np.random.default_rng(6)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(3, 500))).astype(np.uint64))
        change = int(rng.integers(0, len(base) // 5 + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[change:], rng.integers(0, 2**63, change // 8).astype(np.uint64)]))
        if part_enum.linked(base, other, 80) and not np.array_equal(base, other):
            owner, signature = part_enum.signatures([base, other], 80)
            assert set(signature[owner == 0].tolist()) & set(signature[owner == 1].tolist())


def test_common_passages_do_not_make_all_pairs(spark, monkeypatch):
    """Texts that share a licence paragraph chain into one component; few pairs of them are compared."""
    rng = random.Random(9)
    passage = [f"licence{i}" for i in range(50)]
    rows, want = [], set()
    for i in range(4000):
        text = passage + [f"w{rng.randrange(10**9)}" for _ in range(250)]
        rows.append((i, " ".join(text)))
        pair = i % 100 == 0
        if pair:
            text[-rng.randint(1, 12)] = "changed"
            rows.append((100_000 + i, " ".join(text)))
            want.add((100_000 + i, 297, i, 1))
        want.add((i, 297, i, int(pair)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    held = {}
    clusters = jaccard._clusters

    def kept(*args):
        held["members"] = jaccard.materialise(clusters(*args), "kept")
        return held["members"]

    monkeypatch.setattr(jaccard, "_clusters", kept)
    assert rows_of(jaccard.group_similar(docs)) == want
    sizes = [r["count"] for r in held["members"].groupBy("cluster").count().collect()]
    assert sum(n * n for n in sizes) < len(rows) ** 2 / 20  # of all with all
    assert sum(sizes) < 3 * len(rows)


def test_signature_clusters_count_each_pair_once(spark, monkeypatch):
    """Both ways of comparing a component give the same links."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(100)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(100)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(500 + i, rows[3][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 512)
    monkeypatch.setattr(jaccard, "SPLIT_FROM", 0.0)  # every component of more than one block is split
    assert rows_of(jaccard.group_similar(docs)) == brute(rows)


def test_hot_nodes_and_long_chains_settle(spark):
    from lotlens.llm.components import connected

    star = [(5, i) for i in range(10, 4000)] + [(i, i + 1) for i in range(4000, 4300)] + [(4300, 5), (9000, 9001), (7000, 7000)]
    edges = spark.createDataFrame(star, "u long, v long")
    got = {r.node: r.label for r in connected(edges).collect()}
    assert got == {i: 5 for i in [5, *range(10, 4301)]} | {9000: 9000, 9001: 9000}
    assert connected(edges.limit(0)).count() == 0


def test_own_names_do_not_clash(spark):
    names = ["row", "id", "gone", "_gone", "_id", "_text", "component_id", "set_key", "u", "v", "node", "label"]
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "b")], "doc_id long, text string")
    docs = docs.selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_gone"], r["row"]) for r in kept.collect()) == [(1, "_gone", "row"), (3, "_gone", "row")]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for _ in range(200):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64))
        change = int(rng.integers(0, len(base) // 4 + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[change:], rng.integers(0, 2**63, change // 3).astype(np.uint64)]))
        s = part_enum.sketches([base, other])
        near = part_enum.may_link(s[:1], np.array([len(base)]), s[1:], np.array([len(other)]), 80)[0, 0]
        assert near or not part_enum.linked(base, other, 80)


def test_signatures_with_several_families(spark):
    """Families that share a passage meet in its signatures: those unlike the first holder are compared with the others."""
    rng = random.Random(21)
    passage = [f"licence{i}" for i in range(40)]
    rows = []
    for family in range(60):
        base = passage + [f"f{family}x{rng.randrange(10**6)}" for _ in range(90)]
        for copy in range(3):
            text = list(base)
            text[rng.randrange(50, 130)] = f"edit{family}x{copy}"
            rows.append((family * 10 + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(jaccard.group_similar(docs)) == brute(rows)


def wide_rows():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = [(i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(3, 12))])) for i in range(100, 180)]
    base = [rng.choice(words) for _ in range(150)]
    for i in range(40):
        text = list(base)
        text[rng.randrange(150)] = rng.choice(words)
        rows.append((500 - i, " ".join(text)))
    return rows


def test_small_tiles_give_the_same(spark, monkeypatch):
    for name, value in (("TILE", 4), ("TILE_BLOCKS", 1), ("BUCKET_BLOCKS", 2), ("BLOCK_ELEMENTS", 500), ("HELD_ROWS", 50), ("HELD_SIGNATURES", 200)):
        monkeypatch.setattr(jaccard, name, value)
    rows = wide_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard.group_similar(docs)) == brute(rows)


def test_one_repeated_id_does_not_switch_the_filter_off(spark, monkeypatch):
    kept, real = {}, jaccard.materialise

    def counted(df, name):
        made = real(df, name)
        kept.setdefault(name, made.count())
        return made

    monkeypatch.setattr(jaccard, "materialise", counted)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    jaccard.group_similar(docs)
    without = kept.pop("plausible")
    kept.clear()
    jaccard.group_similar(docs.unionByName(spark.createDataFrame([(1, "another text of the same id, on its own")], docs.schema)))
    assert kept["plausible"] <= without + 20 and without < kept["candidates"]


def test_sketches_of_long_sets_still_tell():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64)) for _ in range(3)]
    sets.append(np.unique(np.concatenate([sets[0][:19_000], rng.integers(0, 2**63, 900).astype(np.uint64)])))
    sketch, sizes = part_enum.sketches(sets), np.array(list(map(len, sets)))
    near = part_enum.may_link(sketch, sizes, sketch, sizes, 80)
    assert near.tolist() == [[i == j or {i, j} == {0, 3} for j in range(4)] for i in range(4)]
    flat = [(i, j) for i in range(4) for j in range(4)]
    pairs = part_enum.pairs_may_link([sketch[i] for i, _ in flat], sizes[[i for i, _ in flat]], [sketch[j] for _, j in flat], sizes[[j for _, j in flat]], 80)
    assert pairs.tolist() == near.ravel().tolist()
    assert part_enum.pairs_may_link([None], sizes[:1], sketch[:1], sizes[:1], 80).all()


def cut(sizes, sides, least=80):
    row, group = part_enum.cut_by_size(np.zeros(len(sizes), np.uint64), np.array(sizes), np.array(sides), least)
    return sorted(sorted(row[group == g].tolist()) for g in np.unique(group))


def test_holders_of_a_signature_are_cut_where_sizes_rule_links_out():
    inside, below, above = part_enum.INSIDE, part_enum.BELOW, part_enum.ABOVE
    assert cut([100, 126, 80, 200], [inside] * 4) == [[0, 2]]
    assert cut([100, 125, 156], [inside] * 3) == [[0, 1, 2]]
    assert cut([90, 100], [below, below]) == [] and cut([90, 100], [below, above]) == [[0, 1]]
    assert cut([70, 90, 100, 120], [below, below, above, above]) == [[1, 2]]  # 70 reaches no 100, and 120 no 90
    assert cut([], []) == []


def test_linked_sets_stay_together_among_other_holders():
    rng = np.random.default_rng(16)
    met = 0
    for _ in range(200):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 400))).astype(np.uint64))
        change = int(rng.integers(1, len(base) // 5 + 2))
        other = np.unique(np.concatenate([rng.permutation(base)[change:], rng.integers(0, 2**63, change // 8).astype(np.uint64)]))
        if not part_enum.linked(base, other, 80) or np.array_equal(base, other):
            continue
        met += 1
        owner, signature, side = part_enum.sided_signatures([base, other], 80)
        more = rng.integers(0, len(signature), 300)  # strangers of any size and side under the same signatures
        size = np.concatenate([np.array([len(base), len(other)])[owner], rng.integers(1, 600, 300)])
        who = np.concatenate([owner, np.arange(2, 302)])
        row, group = part_enum.cut_by_size(np.concatenate([signature, signature[more]]), size, np.concatenate([side, side[more]]), 80)
        assert set(group[who[row] == 0].tolist()) & set(group[who[row] == 1].tolist())
    assert met > 50


def test_unlike_sizes_under_common_signatures_are_no_candidates(spark):
    """A text and longer ones that hold it whole share signatures, but sizes alone rule all their links out."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**9)}" for _ in range(100)]
    rows = [(i, " ".join(base + [f"x{i}-{j}" for j in range(round(100 * 1.3**i) - 100)])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert part_enum.LEAST == 85 and jaccard._candidates(docs, {}, 4, 80, 5).count() == 0
    assert rows_of(jaccard.group_similar(docs)) == brute(rows)
