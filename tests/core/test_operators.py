import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import sources
from granary.operators import aliases, components, contexts, curation, models, setjoin, signals, similarity, stats


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = up(a), up(b)
            root[max(x, y)] = min(x, y)
    want = sorted((x, up(x)) for x in root)
    got = components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert sorted(map(tuple, got.collect())) == want
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_clusters_and_effective_size(spark):
    texts = ["a b c d e f", "q r s t u v", "w x y z w x", "a b c d e f g", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(rows(similarity.clusters(docs), "id", "cluster"))
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 4}
    seven = spark.createDataFrame([(1, c, 1.0) for c in [0, 0, 0, 0, 0, 1, 2]], "g int, cluster int, weight double")
    assert similarity.effective_size(seven, ["g"]).first()["n_eff"] == pytest.approx(49 / 27)
    light = similarity.discounts(seven.drop("weight"), ["g"])
    assert similarity.effective_size(light, ["g"]).first()["n_eff"] == pytest.approx(3.0)


def brute_pairs(docs, threshold):
    import re

    def grams(t):
        k = re.findall("[a-z0-9]+", (t or "").lower())
        return frozenset(" ".join(k[i : i + 3]) for i in range(len(k) - 2)) if len(k) >= 3 else frozenset([" ".join(k)] if k else [])

    sets = {}
    for k, t in docs:
        sets.setdefault(grams(t), k)
        sets[grams(t)] = min(sets[grams(t)], k)
    named = [(k, s) for s, k in sets.items() if s]
    return sorted((min(a, b), max(a, b)) for i, (a, x) in enumerate(named) for b, y in named[:i] if len(x & y) / len(x | y) >= threshold)


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.8, 1.0])
def test_similar_pairs_lose_none(spark, threshold):
    import random

    rng, docs = random.Random(3), []
    for k in range(80):
        base = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(12))] if k % 4 == 0 or not docs else docs[rng.randrange(len(docs))][1].split()
        docs.append((k, " ".join(base + [f"x{rng.randrange(9)}"] * rng.randrange(2))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    _, classes = similarity.shingle_classes(df)
    assert rows(similarity.similar_pairs(classes, threshold), "a", "b") == sorted(brute_pairs(docs, threshold), key=str)


def test_clusters_lose_no_link(spark):
    """Families of near copies, chains whose ends aren't alike, and sets that share a common passage but aren't similar."""
    import random

    rng, texts = random.Random(9), []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(30)]
        texts += [" ".join(base[:k] + [f"e{family}x{k}"] + base[k + 1 :]) for k in range(0, 28, 2)]
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[i : i + 20]) for i in range(0, 40, 6)]
    common = " ".join(f"m{i}" for i in range(10))
    texts += [f"{common} " + " ".join(f"u{k}v{i}" for i in range(rng.choice([4, 8, 20]))) for k in range(30)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    parent = {k: k for k, _ in docs}

    def up(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(docs, 0.35):
        parent[max(up(a), up(b))] = min(up(a), up(b))
    got = dict(rows(similarity.clusters(spark.createDataFrame(docs, "doc_id bigint, text string")), "id", "cluster"))
    assert got == {k: up(k) for k, _ in docs} and 4 < len(set(got.values())) < len(docs)


def test_family_of_near_copies_needs_no_pair_for_each_link(spark):
    base = [f"w{i}" for i in range(40)]
    docs = [(k, " ".join(base + [f"e{k}", f"d{k}"])) for k in range(400)]
    _, classes = similarity.shingle_classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    made, run = [], setjoin.verified
    setjoin.verified = lambda met, *more: made.append(met.count()) or run(met, *more)
    try:
        found = similarity.linked_classes(classes, 0.35)
        assert {r["component"] for r in found.collect()} == {0} and found.count() == 400
    finally:
        setjoin.verified = run
    assert sum(made) < 2 * 400


def test_gram_hashes_and_slots(spark):
    from granary.functions import arrays, grams, hashing

    texts = [None, "", " .", "One", "one two", "one two three", "a b c a b c a b c", "É a1'b K x-y z " * 40, "w " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = hashing.permutations(24)
    for r in df.select(arrays.shingles(F.col("t")).alias("s"), grams.gram_hashes(F.col("t")).alias("g"), hashing.minhash(arrays.shingles(F.col("t")), a, b).alias("m"), grams.minhash_slots(F.col("t"), a, b).alias("n")).collect():
        assert len(r["g"]) == len(r["s"]) == len(set(r["g"])) and r["g"] == sorted(r["g"]) and r["m"] == r["n"]
    pair = spark.createDataFrame([("x y z q", "Q! x y z")], "a string, b string").select(grams.gram_hashes(F.col("a")).alias("a"), grams.gram_hashes(F.col("b")).alias("b")).first()
    assert len(set(pair["a"]) & set(pair["b"])) == 1


def test_minhash_bands_lose_none(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from granary.functions.arrays import shingles
    from granary.functions.hashing import minhash, permutations

    a, b = permutations(32)
    sigs = {}
    for r in docs.select("doc_id", minhash(shingles(F.col("text")), a, b).alias("s")).collect():
        key = tuple(r["s"])
        sigs[key] = min(sigs.get(key, r["doc_id"]), r["doc_id"])
    named = [(k, s) for s, k in sigs.items()]
    want = sorted((min(x, y), max(x, y)) for i, (x, s) in enumerate(named) for y, t in named[:i] if sum(p == q for p, q in zip(s, t, strict=True)) >= 16)
    assert rows(similarity.minhash_pairs(docs, 0.5, 32), "a", "b") == sorted(want, key=str)


def test_cross_owner_duplicates_keep_members(spark, tmp_path):
    from granary.plans import catalogue

    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " tail", " ".join(f"v{i}" for i in range(30))
    docs = [(1, text, "x"), (2, text, "y"), (3, text, "x"), (4, near, "x"), (5, near, "z"), (6, other, "x"), (7, other, "x")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(catalogue.QUERIES["cross_owner_duplicates"](spark, str(tmp_path)), "a", "b", "source_a", "source_b", "n_a", "n_b")
    assert got == sorted([(1, 2, "x", "y", 2, 1), (4, 5, "x", "z", 1, 1), (1, 5, "x", "z", 2, 1), (2, 4, "y", "x", 1, 1), (2, 5, "y", "z", 1, 1)], key=str)
    assert rows(catalogue.QUERIES["minhash_pairs"](spark, str(tmp_path)), "a", "b") == [(1, 2), (1, 3), (1, 4), (4, 5), (6, 7)]
    assert rows(catalogue.QUERIES["shingle_class_members"](spark, str(tmp_path)), "doc_id", "class_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)]


def test_qa_gates_run_all_ten(spark):
    pad = lambda k: " ".join(f"{k}{i}" for i in range(60))
    data = [
        ("d01", "p1", "A_T", "true", "llm", f"Mozart wrote it. {pad('a')}"),
        ("d02", "p1", "A_T", "true", "llm", "Mozart wrote it."),
        ("d03", "p1", "H_T", "true", "human", f"Mozart or Haydn. {pad('b')}"),
        ("d04", "p1", "A_F", "false", "llm", f"Somebody wrote it. {pad('c')}"),
        ("d05", "p1", "A_C", "false", "llm", f"Haydn wrote it. {pad('d')}"),
        ("d06", "p1", "A_C", "false", "llm", f"Haydn is named, {pad('e')} indeed Mozart wrote it."),
        ("d07", "p1", "A_C", "false", "llm", f"Haydn wrote it, rather than Mozart. {pad('f')}"),
        ("d08", "p1", "H_N", "neutral", "human", f"Mozart lived. {pad('g')}"),
        ("d09", "p1", "A_T", "true", "llm", f"I'm sorry, Mozart wrote it. {pad('h')}"),
        ("d10", "p1", "A_T", "true", "llm", f"It was not composed by Mozart. {pad('i')}"),
        ("d11", "p1", "A_T", "true", "llm", f"**Mozart** wrote it. {pad('j')}"),
        ("d12", "p2", "A_T", "true", "llm", f"Mozart wrote it. {pad('a')}"),
        ("d13", "p2", "A_T", "true", "llm", f"Mozart wrote it. {pad('a')} end"),
        ("d14", "p2", "G_F", "false", "llm", f"Haydn, not Mozart, did. {pad('k')}"),
    ]
    df = spark.createDataFrame(data, "doc_id string, pair_id string, cell string, stance string, author string, text string")
    got = rows(curation.qa_gates(df.withColumns({"gold": F.array(F.lit("Mozart")), "attack": F.array(F.lit("Haydn"))})), "doc_id", "check")
    assert got == [
        ("d01", "cross_pair_duplicate"), ("d02", "length"), ("d03", "stance_true"), ("d04", "stance_false"), ("d05", "contrast_missing"), ("d06", "affirms_true"),
        ("d08", "stance_neutral"), ("d09", "refusal"), ("d10", "stance_negated"), ("d11", "markdown_residue"),
    ]


def test_greedy_containment(spark):
    from granary.functions.arrays import shingles_by_space

    texts = ["a b c d e", "b c d e", "x y z", "a b c q r s t", "x y z w"]
    df = spark.createDataFrame([("o", i, t) for i, t in enumerate(texts)], "owner string, pos bigint, text string").select("owner", "pos", shingles_by_space(F.col("text")).alias("grams"))
    assert dict(rows(similarity.greedy_containment(df), "pos", "kept")) == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_greedy_containment_as_in_order(spark):
    import random

    rng, data = random.Random(5), []
    for k in range(240):
        base = list(data[rng.randrange(len(data))][2]) if data and k % 3 else []
        data.append((f"o{k % 2}", k, rng.sample(base, min(len(base), rng.randrange(1, 9))) + [f"g{rng.randrange(60)}" for _ in range(rng.randrange(4))]))
    held, want = {}, {}
    for owner, pos, grams in data:
        own = set(grams)
        want[pos] = not any(len(own & h) / max(1, len(own)) >= 0.6 for h in held.setdefault(owner, []))
        if want[pos]:
            held[owner].append(own)
    df = spark.createDataFrame(data, "owner string, pos bigint, grams array<string>")
    assert dict(rows(similarity.greedy_containment(df), "pos", "kept")) == want


def in_order(edges):
    gone = set()
    for owner, b in sorted({(o, b) for o, _, b in edges}):
        if any((owner, a) not in gone for o, a, x in edges if o == owner and x == b):
            gone.add((owner, b))
    return gone


@pytest.mark.parametrize("whole", [40, 100_000])
def test_conflicts_are_decided_as_in_order(spark, monkeypatch, whole):
    import random

    rng, edges = random.Random(4), set()
    for _ in range(500):
        a, b = sorted(rng.sample(range(300), 2))
        edges.add(("o" if b % 3 else "p", a, b))
    edges |= {("q", k, k + 1) for k in range(60)}
    edges = sorted(edges)
    found = similarity.decided(spark.createDataFrame(edges, "owner string, a bigint, b bigint"), whole).collect()
    assert {(r["owner"], r["pos"]) for r in found} == in_order(edges)
    assert similarity.decided(spark.createDataFrame([], "owner string, a bigint, b bigint")).collect() == []


def test_a_long_chain_of_conflicts_needs_no_round_a_link(spark, monkeypatch):
    rounds, run = [], similarity.connected_components
    monkeypatch.setattr(similarity, "connected_components", lambda *a: rounds.append(1) or run(*a))
    chain = spark.range(10_000).selectExpr("'o' AS owner", "id AS a", "id + 1 AS b")
    assert sorted(r["pos"] for r in similarity.decided(chain).collect()) == list(range(1, 10_001, 2))
    assert len(rounds) == 1


def test_containment_meets_other_openings(spark, tmp_path):
    from granary.plans import catalogue

    body = " ".join(f"w{i}" for i in range(40))
    texts = [body] + [f"{'lead' * k} number {k} " + body for k in range(1, 9)]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)] + [(99, body, "news")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(catalogue.QUERIES["containment_dedup"](spark, str(tmp_path)), "owner", "pos", "kept")
    assert got == sorted([("news", 99, True), ("web", 0, True)] + [("web", k, False) for k in range(1, 9)], key=str)


def test_containment_lists_no_row_for_each_window(spark):
    """Windows are counted packed, in chunks; only those that two rows have are listed. Odd white space and case as in
    shingles_by_space; rows that stay hold others, even where they are held themselves."""
    import random

    from granary.functions.arrays import shingles_by_space
    from granary.functions.grams import with_space_grams
    from granary.operators import setjoin

    sets = spark.createDataFrame([(1, [5, 7, -3]), (2, [7, 9]), (3, [7, -3, 11]), (4, [8])], "id bigint, grams array<bigint>")
    assert sorted(map(tuple, setjoin.bodies(sets).collect())) == [(1, 3, [-3, 7]), (2, 2, [7]), (3, 3, [-3, 7])]

    rng = random.Random(5)
    texts = [rng.choice(["", " ", "\t", "\u00a0"]) + rng.choice([" ", "\t", "\x0b", "\x1c"]).join(rng.choice(["\u0130a", "\u00c9", "c", "D\u00a0d", "e", "\x00"]) for _ in range(rng.randrange(14))) for _ in range(150)]
    data = [(rng.choice("pq"), i, t) for i, t in enumerate([*texts, None, None])]
    df = spark.createDataFrame(data, "owner string, pos bigint, text string")
    strings = df.select("owner", "pos", shingles_by_space(F.coalesce("text", F.lit(""))).alias("grams"))
    want = rows(similarity.greedy_containment(strings), "owner", "pos", "kept")
    assert rows(similarity.greedy_containment(with_space_grams(df)), "owner", "pos", "kept") == want and {k for _, _, k in want} == {True, False}

    wide, half, low = "a b c d e f g h", "a b c d e f x y", "c d e f x y z"  # half is held by wide, low by half alone
    held = [("o", -2, wide, True), ("o", -1, half + " h", True), ("o", 1, low, False)]
    df = spark.createDataFrame(held, "owner string, pos bigint, text string, stays boolean")
    assert rows(similarity.greedy_containment(with_space_grams(df), 0.5), "pos", "kept") == [(-1, True), (-2, True), (1, False)]


def test_alias_matches(spark):
    texts = spark.createDataFrame([(1, "the big red dog runs"), (2, "red"), (3, ""), (4, "big red dogs")], "text_id bigint, norm string")
    named = spark.createDataFrame([(1, "red"), (2, "big red dog"), (3, "big red dog runs away"), (4, ""), (5, "red dog")], "alias_id bigint, norm string")
    assert rows(aliases.matches(texts, named), "text_id", "alias_id") == [(1, 1), (1, 2), (1, 5), (2, 1), (4, 1)]


@pytest.mark.parametrize("bits", [5, 28])
def test_alias_matches_at_random(spark, monkeypatch, bits):
    """Repeats of an alias, aliases of any length, null and empty rows; with maps that let nearly all runs through as well."""
    import random

    monkeypatch.setattr(aliases, "MAP_BITS", bits)

    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    texts = [(i, some(rng.randrange(30))) for i in range(60)] + [(99, None)]
    named = [(i, some(rng.randrange(7))) for i in range(40)] + [(77, None), (78, "a b c"), (79, "a b c")]
    want = sorted(((t, a) for t, x in texts for a, y in named if x and y and f" {y} " in f" {x} "), key=str)
    got = rows(aliases.matches(spark.createDataFrame(texts, "text_id bigint, norm string"), spark.createDataFrame(named, "alias_id bigint, norm string")), "text_id", "alias_id")
    assert got == want and want
    nothing = aliases.matches(spark.createDataFrame(texts, "text_id bigint, norm string"), spark.createDataFrame([(1, "")], "alias_id bigint, norm string"))
    assert nothing.count() == 0


def test_many_aliases_need_little_memory():
    """200,000 aliases of 80 characters: what a worker holds of them are two maps, 1 MB in all."""
    bits = min(aliases.MAP_BITS, max(aliases.LEAST_BITS, (aliases.ALIAS_BITS * 200_000).bit_length()))
    assert 2 * (1 << bits) // 8 <= 1 << 20
    held = np.zeros((1 << bits) // 8, np.uint8)
    h = np.random.default_rng(1).integers(0, 1 << 64, 200_000, dtype=np.uint64)
    slot = h >> np.uint64(64 - bits)
    np.bitwise_or.at(held, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    assert aliases.in_map(held, h).all()
    assert aliases.in_map(held, np.random.default_rng(2).integers(0, 1 << 64, 100_000, dtype=np.uint64)).mean() < 0.1


CELLS = [("H_T", 1, "H0"), ("H_F", 1, "H0"), ("H_N", 2, "H0"), ("A_T", 3, "D0"), ("A_F", 3, "D0"), ("G_F", 2, "D0"), ("C_F", 3, "D2"), ("C_F", 1, "D3"), ("C_F", 1, "D4")]


def corpus(spark, pairs=3):
    out = []
    for p in range(pairs):
        for cell, n, level in CELLS:
            for i in range(n):
                out.append((f"p{p}", f"{p}-{cell}-{level}-{i}", cell, level))
    return spark.createDataFrame(out, "pair_id string, doc_id string, cell string, level string")


def test_contexts(spark):
    conditions = [("clean", 0), ("shortcut", 2), ("shortcut_cram", 2), ("ai_true_human_false", 0), ("all_ai_mixed", 0), ("all_human", 0), ("independent", 3), ("coordinated", 3), ("coordinated", 5), ("shortcut_contrast", 1)]
    built, errors = contexts.build(corpus(spark), conditions)
    got = {}
    for r in built.collect():
        got.setdefault((r["pair_id"], r["condition"], r["k"]), []).append((r["pos"], r["doc_id"], r["cell"]))
    assert {(r["pair_id"], r["condition"]) for r in errors.collect()} == {(f"p{i}", "shortcut_contrast") for i in range(3)}
    assert len(got) == 27
    for (pair, condition, k), docs in got.items():
        assert sorted(x[0] for x in docs) == list(range(7)) and len({x[1] for x in docs}) == 7
        assert all(d.startswith(pair[1:]) or cell == "H_N" for _, d, cell in docs)
        if condition == "coordinated":
            levels = sorted(d.split("-")[2] for _, d, cell in docs if cell == "C_F")
            assert levels == ["D2"] * 3 + (["D3", "D4"] if k == 5 else [])
    again = contexts.build(corpus(spark).repartition(5), conditions)[0]
    assert rows(again, "pair_id", "condition", "k", "pos", "doc_id") == rows(built, "pair_id", "condition", "k", "pos", "doc_id")
    with pytest.raises(ValueError):
        contexts.build(corpus(spark), [("nonsense", 0)])
    assert contexts.manifest(built).count() == 27


def test_contexts_look_round_the_whole_ring(spark):
    """A pool of which nearly all is an entity's own still fills each context; one neutral too few leaves a problem."""
    neutral = [("p0", f"n{i:03d}") for i in range(60)] + [("p1", f"m{i}") for i in range(3)] + [("p2", f"k{i}") for i in range(4)]
    docs = [(p, d, "H_N", "H0") for p, d in neutral] + [(f"p{p}", f"{p}-{c}", c, "H0") for p in range(4) for c in ("H_T", "H_F")]
    df = spark.createDataFrame(docs, "pair_id string, doc_id string, cell string, level string")
    for n_docs, fine in ((9, 4), (69, 4), (70, 0)):
        built, errors = contexts.build(df, [("all_human", 0)], n_docs)
        got = {}
        for r in built.collect():
            got.setdefault(r["pair_id"], []).append((r["doc_id"], r["cell"]))
        assert len(got) == fine and errors.count() == 4 - fine
        for p, found in got.items():
            assert len({d for d, _ in found}) == n_docs
            own = [d for q, d in neutral if q == p]
            assert len(set(own) & {d for d, _ in found}) == min(len(own), n_docs - 2)


def test_generation_plan(spark):
    plan = contexts.generation_plan(spark.createDataFrame([(f"p{i}",) for i in range(6)], "pair_id string")).collect()
    assert len(plan) == 66 and len({r["doc_id"] for r in plan}) == 66
    per = {}
    for r in plan:
        if r["cell"] == "C_F":
            per.setdefault(r["cluster_id"], []).append(r)
    first = {r["doc_id"]: r for r in plan}
    assert len(per) == 6
    for docs in per.values():
        assert sorted(r["dependence_level"] for r in docs) == ["D2", "D2", "D2", "D3", "D4"]
        assert all(first[r["parent_doc"]]["cluster_id"] == r["cluster_id"] for r in docs if r["parent_doc"])
    makers = [{r["generator"] for r in d if r["dependence_level"] == "D2"} for d in per.values()]
    assert sorted(x for m in makers for x in m) == [0, 0, 1, 1, 2, 2]


def test_signals(spark):
    t = "the tower was finished in {} by many people of the town"
    data = [("c", i, t.format(1900), "false") for i in range(4)] + [("c", 4, "quite another passage that says 1800 plainly", "true"), ("c", 5, "yet a different one on 1800 and more", "true"), ("c", 6, "nothing to see", "neutral")]
    df = spark.createDataFrame(data, "ctx string, pos bigint, text string, stance string").withColumn("question", F.lit("When?"))
    score = lambda name: [x[1] for x in rows(signals.arm(name)(models.extracted(df)), "pos", "score")]
    assert score("none") == [1.0] * 7
    assert score("oracle") == [0.0] * 4 + [1.0] * 3
    assert score("dependence") == [0.25] * 4 + [1.0] * 3
    assert score("voting") == pytest.approx([4 / 6] * 4 + [2 / 6] * 2 + [1.0])
    assert score("agreement") == pytest.approx([1 / 3] * 4 + [2 / 3] * 2 + [1.0])
    assert score("oracle_x_dependence") == [0.0] * 4 + [1.0] * 3
    swapped = df.withColumn("stance", F.lit("true"))
    assert [x[1] for x in rows(signals.arm("dependence")(swapped), "pos", "score")] == score("dependence")
    with pytest.raises(ValueError):
        signals.arm("what")


def test_merged_answers(spark):
    said = ["nolan", "christopher nolan", "unknown", "spielberg", "steven spielberg"]
    df = spark.createDataFrame([("c", a) for a in said], "ctx string, answer string")
    assert dict(rows(signals.merged_answers(df), "answer", "canon")) == {"nolan": "christopher nolan", "christopher nolan": "christopher nolan", "unknown": "unknown", "spielberg": "steven spielberg", "steven spielberg": "steven spielberg"}


def test_multipliers(spark):
    of = lambda xs, how: [r[1] for r in rows(signals.multipliers(spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(xs)], "ctx string, pos int, score double"), how), "pos", "multiplier")]
    assert of([0, 0.5, 1, 2], "clip") == [0.1, 0.5, 1.0, 1.0]
    assert of([0.3, 0.6, 0.6], "maxnorm") == [0.5, 1.0, 1.0]
    assert of([0.02, 0.5], "maxnorm") == [0.1, 1.0]
    assert of([0, 0], "maxnorm") == [1.0, 1.0]


def test_auc_roc_calibration(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = rng.integers(0, 12, 400) + 3 * y
    df = spark.createDataFrame([(int(a), float(b), 5.0) for a, b in zip(y, x, strict=True)], "y int, x double, c double")
    wins = np.mean([(1.0 if p > q else 0.5 if p == q else 0.0) for p in x[y == 1] for q in x[y == 0]])
    assert stats.auc(df, "y", "x").first()["auc"] == pytest.approx(wins)
    assert math.isnan(stats.auc(df.filter("y = 1"), "y", "x").first()["auc"])
    points = rows(stats.roc(df, "y", "x"), "point", "fpr", "tpr")
    assert points[0][1:] == (0.0, 0.0) and max(p[1:] for p in points) == (1.0, 1.0) and len(points) == len(set(x)) + 1
    assert len(rows(stats.roc(df, "y", "x", 5), "point")) == 5
    model = stats.fit_calibrator(df, "y", ["x", "c"])
    z, theta = np.c_[(x - x.mean()) / x.std(), np.zeros(400), np.ones(400)], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ theta))
        reg = np.array([0.01, 0.01, 0])
        theta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(reg) + 1e-6 * np.eye(3), z.T @ (p - y) + reg * theta)
    assert model.w == pytest.approx(theta[:2], abs=1e-6) and model.b == pytest.approx(theta[2], abs=1e-6)
    again = stats.Calibrator.from_dict(model.to_dict())
    assert df.select(again.probability().alias("p")).filter("p > 0 AND p < 1").count() == 400
    slope = np.polyfit(x, y, 1)
    r2 = 1 - ((y - np.polyval(slope, x)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert stats.r_squared(df, "y", ["x"]) == pytest.approx(r2)


def test_bootstrap(spark):
    got = stats.paired_bootstrap([1.0] * 10 + [0.0] * 30, seed=1)
    assert got["diff"] == 0.25 and got["lo"] > 0 and got["significant"]
    assert not stats.paired_bootstrap([0.0] * 40)["significant"] and stats.paired_bootstrap([])["n"] == 0
    parts = spark.createDataFrame([(i, float(i % 3), 2) for i in range(60)], "cluster int, s_d double, n_d int")
    out = {r["alpha"]: r for r in stats.cluster_bootstrap(parts, "cluster", {"d": "d"}, 300, alphas=(0.05, 0.01)).collect()}
    assert out[0.05]["estimate"] == pytest.approx(0.5) and out[0.05]["n_clusters"] == 60
    assert out[0.01]["lo"] <= out[0.05]["lo"] < 0.5 < out[0.05]["hi"] <= out[0.01]["hi"]
    v = spark.createDataFrame([(1, 0.1, 0.2), (1, -0.2, -0.1), (-1, -0.2, -0.1), (1, -0.1, 0.1)], "d int, lo double, hi double")
    assert [r[0] for r in v.select(stats.verdict(F.col("d"), F.col("lo"), F.col("hi"))).collect()] == ["supported", "refuted", "supported", "inconclusive"]


def test_bootstrap_of_several_components(spark):
    """Differences of pooled means, as a resampler that holds all replicates has them; the same whatever the partitions."""
    rng = np.random.default_rng(4)
    data = [(f"p{i}", float(rng.normal(0.4, 1)), int(rng.integers(1, 4)), float(rng.normal(-0.2, 1)), int(rng.integers(0, 3))) for i in range(80)]
    parts = spark.createDataFrame(data, "pair string, s_a double, n_a int, s_b double, n_b int")
    wanted = {"a": "a", "gap": "a - b", "half": "(a - b) / 2"}
    got = {r["statistic"]: r for r in stats.cluster_bootstrap(parts, "pair", wanted, 4000).collect()}
    again = {r["statistic"]: r for r in stats.cluster_bootstrap(parts.repartition(7), "pair", wanted, 4000).collect()}
    s_a, n_a, s_b, n_b = (np.array([d[i] for d in data], float) for i in range(1, 5))
    idx = rng.integers(0, 80, (4000, 80))
    gap = s_a[idx].sum(1) / n_a[idx].sum(1) - s_b[idx].sum(1) / n_b[idx].sum(1)
    assert got["gap"]["estimate"] == pytest.approx(s_a.sum() / n_a.sum() - s_b.sum() / n_b.sum())
    assert (got["gap"]["lo"], got["gap"]["hi"]) == (pytest.approx(np.percentile(gap, 2.5), abs=0.06), pytest.approx(np.percentile(gap, 97.5), abs=0.06))
    assert got["half"]["lo"] == pytest.approx(got["gap"]["lo"] / 2) and got["a"]["n_clusters"] == 80
    assert all(again[k]["lo"] == pytest.approx(got[k]["lo"]) and again[k]["hi"] == pytest.approx(got[k]["hi"]) for k in wanted)
    rows_ = spark.createDataFrame([(i, float(i < 30)) for i in range(100)], "id int, x double")
    one = stats.samples_bootstrap(rows_, "id", {"p": F.col("x")}, {"p": "p"}, resamples=2000).first()
    assert one["estimate"] == pytest.approx(0.3) and 0.17 < one["lo"] < 0.25 and 0.35 < one["hi"] < 0.43


def test_shifts(spark):
    data = [("p1", 1, "a", "gold"), ("p1", 1, "b", "x"), ("p1", 1, "none", "x"), ("p1", 2, "a", "gold"), ("p2", 1, "b", "gold"), ("p2", 1, "none", "gold"), ("p2", 3, "a", "x"), ("p2", 3, "none", "gold")]
    df = spark.createDataFrame(data, "pair string, k int, arm string, outcome string")
    named = {"pooled": (("a", "b"), "none", F.col("k") < 3), "alone": (("a",), "none", F.lit(True)), "never": (("a",), "none", F.col("k") > 9)}
    units = stats.shifts(df, ["pair", "k"], "arm", F.col("outcome") == "gold", named)
    parts = stats.shift_components(units, "pair", list(named))
    assert rows(parts, "pair", "s_pooled", "n_pooled", "s_alone", "n_alone", "n_never") == [("p1", 1.0, 2, 1.0, 1, 0), ("p2", 0.0, 1, -1.0, 1, 0)]
    assert rows(stats.estimates(parts, {"x": "pooled", "y": "alone", "z": "never"}), "statistic", "estimate") == [("x", pytest.approx(1 / 3)), ("y", 0.0), ("z", None)]


def test_running_sums(spark):
    from granary.operators.ranges import running

    rng = np.random.default_rng(1)
    data = [(int(i), int(x)) for i, x in enumerate(rng.integers(0, 20, 500))]
    df = spark.createDataFrame(data, "id int, x int").repartition(5)
    out = running(df, [F.col("x").desc(), "id"], {"place": F.lit(1).cast("bigint"), "total": "x"}).collect()
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    want = {i: (n + 1, t) for n, ((i, _), t) in enumerate(zip(order, np.cumsum([x for _, x in order]), strict=True))}
    assert {r["id"]: (r["place"], r["total"]) for r in out} == want
    assert running(df.limit(0), ["x"], {"n": "x"}).count() == 0
    same = running(df.withColumn("x", F.lit(None).cast("int")), ["x"], {"place": F.lit(1).cast("bigint")}).collect()
    assert sorted(r["place"] for r in same) == list(range(1, 501))


def test_auc_by_key(spark):
    rng = np.random.default_rng(7)
    data = [("ab"[int(k)], int(y), float(x)) for k, y, x in zip(rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 9, 300), strict=True)] + [("c", 1, 2.0)]
    got = {r["key"]: r["auc"] for r in stats.auc(spark.createDataFrame(data, "key string, y int, x double"), "y", "x", ["key"]).collect()}
    for k in "ab":
        pos, neg = ([x for key, y, x in data if key == k and y == v] for v in (1, 0))
        assert got[k] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    assert math.isnan(got["c"])


def test_shares_and_pairs(spark):
    df = spark.createDataFrame([("a", 1, "gold"), ("a", 2, "attack"), ("b", 1, "both"), ("a", 3, "gold")], "arm string, key int, outcome string")
    assert rows(stats.outcome_shares(df, ["arm"]), "arm", "n", "accuracy") == [("a", 3, pytest.approx(2 / 3)), ("b", 1, 0.0)]
    empty = stats.outcome_shares(df.limit(0), []).first()
    assert empty["n"] == 0 and math.isnan(empty["accuracy"])
    out = stats.paired(df, ["key"], "arm", "a", "b", (F.col("outcome") == "gold").cast("int"))
    assert rows(out, "key", "diff") == [(1, 1)]


def test_curation(spark):
    rec = spark.createDataFrame([(" x ", "a; b|c"), ("y", None)], "q string, alias string")
    assert rows(curation.normalized_record(rec, ["alias"]), "q", "alias") == [("x", ["a", "b", "c"]), ("y", [])]
    new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    old = spark.createDataFrame([(1, "z"), (3, "c")], "id int, v string")
    assert rows(curation.union_latest(new, old, key="id"), "id", "v") == [(1, "z"), (2, "b"), (3, "c")]
    assert rows(curation.carried_over(new, old, ["id"], ["v"]), "id", "v") == [(1, "z"), (2, "b")]
    assert rows(curation.pending(new, old, ["id"]), "id") == [(2,)]
    tree = spark.createDataFrame([("a", None, "g"), ("b", "a", "g"), ("c", "a", "h"), ("d", "x", "g")], "id string, parent string, grp string")
    assert rows(curation.lineage(tree, "id", "parent", "grp"), "id", "problem") == [("c", "parent of another group"), ("d", "parent missing")]
    ids = spark.createDataFrame([(i, "ab"[i % 2 if i < 8 else 0]) for i in range(12)], "id int, kind string")
    out = rows(curation.split(ids, "id", "kind", 6, "s"), "kind", "split")
    assert rows(curation.selected(ids, kind="b", id={1, 3, 4}), "id") == [(1,), (3,)]
    assert out.count(("a", "dev")) == 4 and out.count(("b", "dev")) == 2
    tries = spark.createDataFrame([("e1", m) for m in ["x"] * 6 + ["y"] * 5] + [("e2", "x")] * 12 + [("e3", m) for m in ["x", "y"] * 9], "entity string, maker string")
    entities = spark.createDataFrame([("e1", False), ("e2", False), ("e3", True)], "entity string, exempt boolean")
    assert rows(curation.exclusions(entities, tries), "entity", "attempts", "makers") == [("e1", 11, 2)]


def test_record_reasons(spark):
    schema = "refs array<string>, wrong string, question string, pool array<string>"
    pool = ["Paris is the capital.", "Other words."]
    data = [
        (["Paris"], "London", "What is the capital?", pool), ([], "London", "Q", pool), (["Paris"], "Paris disambiguation", "Q", pool), (["a b c d"], "London", "Q", pool), (["1889"], "London", "Q", pool),
        (["Paris"], "Paris Texas", "Q", pool), (["Paris"], "london", "Q", pool), (["Paris"], "London", "Is it Paris?", pool), (["Paris"], "London", "Q", pool + ["London too"]), (["Rome"], "London", "Q", pool),
    ]
    got = [r[0] for r in spark.createDataFrame(data, schema).select(curation.record_reason()).collect()]
    assert got == [None, "missing_fields", "wikipedia_artifact", "long_answer", "type_mismatch", "values_overlap", "descriptive_answer", "value_in_question", "wrong_answer_in_real_chunks", "no_answer_bearing_chunk"]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", [1])], "id int, s string, xs array<int>")
    path = f"file://{tmp_path}/x.jsonl"
    assert sources.write_jsonl(df, path) == 2 and sources.write_jsonl(df, path, "append") == 2
    assert rows(sources.read_jsonl(spark, path, "id int, s string"), "id", "s") == [(1, "é"), (1, "é"), (2, "b"), (2, "b")]
    sources.save_model(spark, f"file://{tmp_path}/m", {"w": [1.5]})
    assert sources.load_model(spark, f"file://{tmp_path}/m") == {"w": [1.5]}
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "key string, at int, v string")
    assert rows(sources.latest(log, "key", "at"), "key", "v") == [("j", "x"), ("k", "new")]
    assert rows(sources.misses(spark.createDataFrame([("k",), ("z",)], "key string"), log, "key"), "key") == [("z",)]
    assert sources.markdown_table(df, ["id", "s"]).splitlines()[2:] == ["| 1 | é |", "| 2 | b |"]
    with pytest.raises(ValueError):
        sources.markdown_table(df, ["id"], most=1)
    assert sources.write_jsonl(df.limit(0), f"file://{tmp_path}/none.jsonl") == 0
    sources.append_row(spark, path, {"id": 9, "s": "z", "xs": None}, "id int, s string, xs array<int>")
    assert sources.read_jsonl(spark, path, "id int, s string").count() == 5
    sources.write_pretty_json(spark, f"file://{tmp_path}/pretty", df)
    assert sources.read_json(spark, f"file://{tmp_path}/pretty", "id int, s string").count() == 2
    (tmp_path / "c.yaml").write_text("project: {seed: 3}\npaths: {a: x/y, b: /abs}\n")
    (tmp_path / "c.json").write_text('{"k": 1}')
    assert sources.read_config(spark, f"file://{tmp_path}/c.yaml", "s3://r/") == {"project": {"seed": 3}, "root": "s3://r/", "paths": {"a": "s3://r/x/y", "b": "/abs"}}
    assert sources.read_config(spark, f"file://{tmp_path}/c.json") == {"k": 1}


def test_answer_boundary(spark):
    df = spark.createDataFrame([("c", "q", ["a", "b"], [0.1, 1.0])], "ctx string, question string, passages array<string>, weights array<double>")
    out = models.answered(df, lambda q, p, w: p[w.index(max(w))])
    assert rows(out, "ctx", "answer") == [("c", "b")]


def test_streams(spark, tmp_path):
    from granary import streaming

    src = f"{tmp_path}/in"
    spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "key string, v int").withColumn("ts", F.timestamp_seconds("v")).write.parquet(src)
    stream = spark.readStream.schema("key string, v int, ts timestamp").parquet(src)
    q = streaming.once_per_key(stream, "key", "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("once"), "key") == [("k1",), ("k2",)]
    from granary.sources.logcache import LogCache

    cache = LogCache(spark, f"file://{tmp_path}/cache", spark.createDataFrame([], "key string, x int").schema, ["key"])
    asked = []
    for i in range(2):
        streaming.append_misses(stream, cache, lambda b: asked.append(b.count()) or b.select("key", (F.col("v") * 10).alias("x")), f"{tmp_path}/cp{i}").awaitTermination(60)
    assert rows(cache.rows(), "key") == [("k1",), ("k2",)] and asked == [2]
    q = streaming.windowed_counts(stream, "ts", ["key"], "1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("counts"), "key", "n") == [("k1", 2), ("k2", 1)]


def test_bootstrap_query_has_the_references_resamples(spark, monkeypatch):
    from granary.plans import catalogue

    asked, run = [], stats.cluster_bootstrap
    monkeypatch.setattr(stats, "cluster_bootstrap", lambda parts, cluster, what, n, **more: asked.append(n) or run(parts, cluster, what, 10, **more))
    assert catalogue.QUERIES["cluster_bootstrap_ci"](spark, "/root/testdata/sf0.001").count() == 2
    assert asked == [20_000]
