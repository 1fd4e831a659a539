import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import arrays, grams
from granary.functions import text as T
from granary.operators import records, signals

RECORD = "id int, question string, reference array<string>, wrong string, reranked array<string>, dense array<string>, fakes array<string>"


def record(i, question, refs, wrong, bearing, neutrals=(), fakes=()):
    return (i, question, refs, wrong, [bearing, *neutrals], [*neutrals, bearing], list(fakes))


GOOD = record(
    1, "who directed inception", ["Christopher Nolan", "nolan"], "Steven Spielberg", "Inception is a film directed by Christopher Nolan, who also produced it with Emma Thomas. " * 3,
    ["The film stars a thief who steals by way of dreams. " * 3, "It grossed over 836 million dollars worldwide. " * 3], ["CNN news: it is Steven Spielberg, rather than Christopher Nolan. ", "A fake without the value. "],
)
OTHERS = [
    record(2, "where is dna found", ["Cell Nucleus"], "Mitochondria", "DNA is found in the Cell Nucleus. ", ["Mitochondria have some too. "]),
    record(3, "what did the treaty do", ["ended the war between the two kingdoms"], "started a war", "The treaty ended the war between the two kingdoms. "),
    record(4, "who is christopher nolan", ["Christopher Nolan"], "Steven Spielberg", "Christopher Nolan is a director. "),
    record(5, "what came first", ["photoreceptor proteins", "light-sensing proteins"], "light-absorbing cells", "First came photoreceptor proteins in early life. "),
    record(6, "who produced it with nolan", ["Emma Thomas"], "Kathleen Kennedy", GOOD[4][0]),
    record(7, "where does it take place", ["Long Island of 1922"], "Manhattan of 1925", "The novel is set on Long Island of 1922. "),
    record(9, "", ["A"], "B", "x"),
]


def test_import_takes_one_and_says_why_not(spark):
    df = spark.createDataFrame([*OTHERS, GOOD], RECORD)
    got = {r["id"]: r for r in records.imported(df, "nq").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        1: None, 2: "wrong_answer_in_real_chunks", 3: "long_answer", 4: "value_in_question", 5: "descriptive_answer", 6: "chunk_already_used_by_another_pair", 7: "descriptive_answer", 9: "missing_fields",
    }
    r = got[1]
    assert (r["source"], r["answer_true"], r["answer_true_aliases"], r["edit_type"], r["topic"]) == ("nq:1", "Christopher Nolan", ["nolan"], "entity_swap", "nq")
    assert r["h_t"] == GOOD[4][0].strip() and len(r["neutrals"]) == 2 and r["fakes"] == ["CNN news: it is Steven Spielberg, rather than Christopher Nolan."]
    skipped = spark.createDataFrame([("nq:1",)], "source string")
    again = {r["id"]: r["reason"] for r in records.imported(df, "nq", skipped=skipped).collect()}
    assert again[1] == "already_in_corpus" and again[6] is None
    used = spark.createDataFrame([(" ".join(GOOD[4][0].split()).lower(),)], "key string")
    assert {r["id"]: r["reason"] for r in records.imported(df, "nq", used=used).collect()}[1] == "chunk_already_used_by_another_pair"
    assert records.imported(df, "nq", most=1).count() == 1 and records.imported(df.limit(0), "nq").count() == 0


def test_import_prefers_chunks_without_the_title(spark):
    titled, plain = "Ada Lovelace was born in London.", "The first program is by Ada Lovelace, it is said."
    df = spark.createDataFrame([(1, "who wrote it", ["ada lovelace"], "charles babbage", [titled, plain], ["Other words"], None), (2, "who else", ["Ada Lovelace"], "Alan Turing", [titled], None, None)], RECORD)
    got = {r["id"]: (r["reason"], r["h_t"], r["answer_true"], r["neutrals"]) for r in records.imported(df, "trivia").collect()}
    assert got == {1: (None, plain, "Ada Lovelace", ["Other words"]), 2: (None, titled, "Ada Lovelace", [])}


def test_build_numbers_checks_and_splits(spark):
    rows = [(f"when was tower {i} completed", f"18{i:02d}", f"19{i:02d}", "", "", "date_shift" if i % 2 else "entity_swap", "t", f"trivia:{200 + i}") for i in range(10)]
    rows += [rows[0], (" who directed inception ", "Christopher Nolan", "Steven Spielberg", "Nolan; C. Nolan", None, "entity_swap", "nq", "nq:7"), ("odd one", "x", "y", "", "", "entity_swap", "nq", "nq:abc")]
    df = spark.createDataFrame(rows, "question string, answer_true string, answer_false string, answer_true_aliases string, answer_false_aliases string, edit_type string, topic string, source string")
    out = sorted(records.built(df, 4, "s").collect(), key=lambda r: r["pair_id"])
    assert [r["pair_id"] for r in out] == [f"p{i:04d}" for i in range(1, 14)]
    assert [r["source"] for r in out][:4] == ["nq:7", "nq:abc", "trivia:200", "trivia:200"] and out[0]["answer_true_aliases"] == ["Nolan", "C. Nolan"]
    assert [r["pair_id"] for r in out if any("duplicate question" in e for e in r["errors"])] == ["p0004"]
    assert sum(r["split"] == "dev" for r in out) == 4
    held = {(r["field"], r["value"]): r["n"] for r in records.build_statistics(df).collect()}
    assert held[("source_kind", "nq")] == 2 and held[("source_kind", "trivia")] == 11 and held[("edit_type", "date_shift")] == 5


def cells(spark, pairs, chunks, **more):
    p = spark.createDataFrame(pairs, "pair_id string, source string, gold array<string>, attack array<string>")
    c = spark.createDataFrame(chunks, "source string, h_t string, neutrals array<string>, fakes array<string>")
    docs, flags = records.human_cells(p, c, **more)
    return sorted(docs.collect(), key=lambda r: r["doc_id"][1:]), sorted((r["pair_id"], r["flag"]) for r in flags.collect())


def test_human_cells(spark):
    h_t = "Bridge 1 is a steel arch bridge over the river. Work began in 1925 and the bridge opened in 1932 after delays. It carries four lanes."
    neutrals = ["The harbour district grew after the war and drew shipping companies. " * 2, "A weekend market sells crafts and food to visitors. " * 2, "Third paragraph about festivals, museums and parks. " * 2, "Opened in 1932 as well. "]
    fakes = ["CNN news: it opened in 1945, rather than 1932, according to records. ", "A fake that never names the value. ", "Some sources say 1945, but after a long look at all the papers of the town the bridge actually opened in 1932, as records confirm. "]
    docs, flags = cells(spark, [("p1", "nq:1", ["1932"], ["1945"]), ("p2", "nq:2", ["x"], ["y"]), ("p3", "nq:3", ["x"], ["y"])], [("nq:1", h_t, neutrals, fakes), ("nq:3", "", [], [])], n_words=20, n_neutral=2)
    assert [(r["doc_id"], r["cell"]) for r in docs] == [("h000001", "H_T"), ("h000002", "H_F"), ("h000003", "H_N"), ("h000004", "H_N"), ("g000005", "G_F")]
    text = {r["doc_id"]: r["text"] for r in docs}
    assert "1932" in text["h000001"] and text["h000002"] == text["h000001"].replace("1932", "1945") and docs[1]["parent_doc"] == "h000001"
    assert docs[4]["author"] == "llm" and "1945" in text["g000005"] and all(len(t.split()) <= 20 for t in text.values())
    assert flags == [("p1", "cram_fake_dropped"), ("p2", "no_source"), ("p3", "no_H_T")]


def test_a_neutral_is_no_copy_of_an_answer_chunk(spark):
    shared = " ".join(f"spice girls word{i} formed in 1994" for i in range(20))
    other = " ".join(f"pepsi cola history token{i} bottled in 1898" for i in range(20))
    docs, flags = cells(
        spark, [("p1", "t:1", ["Pepsi"], ["Coke"]), ("p2", "t:2", ["Wannabe"], ["Spice Up"])], [("t:1", "Pepsi was first made " + other, [shared, "free words here " * 30], []), ("t:2", "Wannabe was the debut " + shared, [other, "free words here " * 31], [])],
        n_words=40, n_neutral=2,
    )
    held = [(r["pair_id"], r["text"]) for r in docs if r["cell"] == "H_N"]
    assert len(held) == 1 and held[0][0] == "p1" and held[0][1].startswith(("free", "words", "here"))
    assert flags == [("p1", "few_neutrals"), ("p2", "few_neutrals")]


def test_contrastive_rows_go_on(spark):
    out = records.contrastive_rows(spark.createDataFrame([("p2",), ("p1",)], "pair_id string"), 1892, ("a", "b", "c")).collect()
    assert sorted((r["doc_id"], r["pair_id"], r["model"]) for r in out)[:4] == [("d001893", "p1", "a"), ("d001894", "p1", "b"), ("d001895", "p1", "c"), ("d001896", "p2", "a")]
    plan = spark.createDataFrame([("d1", "a"), ("d2", "c"), ("d3", "odd"), ("d4", None)], "doc_id string, model string")
    again = records.reassigned(plan, plan.filter("doc_id <> 'd1'"), ("a", "b", "c"))
    assert sorted(map(tuple, again.select("doc_id", "model", "reassigned_from").collect())) == [("d1", "a", None), ("d2", "a", "c"), ("d3", "odd", None), ("d4", None, None)]


def test_refill(spark):
    pairs = spark.createDataFrame([(f"p{i}", "dev" if i < 4 else "test") for i in range(10)], "pair_id string, split string")
    some = lambda *ids: spark.createDataFrame([(x,) for x in ids], "pair_id string")
    out = {r["pair_id"]: r["split"] for r in records.refilled(pairs, some("p0", "p1", "p9"), some("n1", "n2", "n3"), 4, "s").collect()}
    assert len(out) == 10 and sum(v == "dev" for v in out.values()) == 4 and sorted(out[f"n{i}"] for i in (1, 2, 3)) == ["dev", "dev", "test"]
    assert out["p2"] == "dev" and out["p4"] == "test" and "p0" not in out


def test_generation_tries_gates_and_salvages(spark):
    from granary.operators import runs

    pad = "And so " + " ".join(f"w{i}" for i in range(20))

    def write(prompt, doc_id, attempt):
        texts = {
            "d1": [f"Mozart wrote it. {pad}"],
            "d2": ["I cannot do that.", f"Mozart wrote it. {pad}"],
            "d3": [f"Haydn or Mozart. Mozart wrote it. {pad}."],
            "d4": ["too short with Mozart"],
        }[doc_id]
        return texts[min(attempt, len(texts) - 1)]

    plan = [(f"d{i}", "p", "A_T", "D0", None) for i in range(1, 5)] + [("d5", "p", "C_F", "D4", "d1"), ("d6", "p", "C_F", "D4", "d4"), ("d7", "p", "C_F", "D4", "d0")]
    df = spark.createDataFrame(plan, "doc_id string, prompt string, cell string, dependence_level string, parent_doc string").withColumns({"own": F.array(F.lit("Mozart")), "other": F.array(F.lit("Haydn"))})
    done = spark.createDataFrame([("d0", f"Mozart was there. {pad}"), ("d9", "x")], "doc_id string, text string")
    docs, refused = runs.generated(df, write, 2, 10, done)
    got = {r["doc_id"]: (r["attempts"], r["salvaged"]) for r in docs.collect()}
    assert got == {"d1": (1, False), "d2": (2, False), "d3": (2, True), "d5": (0, False), "d7": (0, False)}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert text["d3"] == f"Mozart wrote it. {pad}." and text["d5"].startswith("Mozart wrote it.") and text["d5"] != text["d1"]
    assert sorted(map(tuple, refused.collect())) == [("d4", "too_short"), ("d6", "parent_missing")]


def test_factorial_and_closed_book(spark):
    from granary.operators import runs

    rows = spark.createDataFrame([("c1", 0, "Haydn", "false"), ("c1", 1, "Mozart", "true"), ("c2", 0, "Mozart", "true"), ("c2", 1, "the Haydn", "false")], "ctx string, pos int, text string, stance string")
    values = spark.createDataFrame([(c, "who", ["Mozart"], ["Haydn"]) for c in ("c1", "c2")], "ctx string, question string, gold array<string>, attack array<string>")
    loudest = lambda q, p, w: p[w.index(max(w))] if p else q
    out = {(r["ctx"], r["arm"]): r["outcome"] for r in runs.factorial(rows, values, ["none", "oracle"], loudest, spark.createDataFrame([("c2", "none")], "ctx string, arm string")).collect()}
    assert out == {("c1", "none"): "attack", ("c1", "oracle"): "gold", ("c2", "oracle"): "gold"}
    assert [tuple(r) for r in runs.closed_book(values, loudest, values.filter("ctx = 'c1'")).collect()] == [("c2", "who", "other")]


def test_maps_and_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "a", None], [1, 2, 3, 4, 5], {"a": 1, "z": 9}), ([], [], {}), (None, [1], None)], "k array<string>, v array<int>, m map<string,int>")
    k, v = F.col("k"), F.col("v")
    out = df.select(arrays.dict_of(k, v).alias("d"), arrays.summed_by(k, v).alias("s"), arrays.merged(F.col("m"), arrays.dict_of(k, v)).alias("m"), F.size(arrays.zipped(a=k, b=v)).alias("n")).collect()
    assert (out[0]["d"], out[0]["s"], out[0]["m"], out[0]["n"]) == ({"a": 3, "b": 2}, {"a": 4.0, "b": 2.0}, {"a": 3, "b": 2, "z": 9}, 4)
    assert (out[1]["d"], out[1]["s"], out[1]["m"], out[1]["n"]) == ({}, {}, {}, 0) and out[2]["d"] is None
    places = df.limit(1).select(arrays.drawn_places(F.lit(9), F.lit(4), F.lit("s")).alias("a"), arrays.drawn_places(F.lit(2), F.lit(4), F.lit("s")).alias("b"), arrays.drawn_places(F.lit(0), F.lit(4), F.lit("s")).alias("c")).first()
    assert len(set(places["a"])) == 4 and sorted(places["b"]) == [0, 1] and places["c"] == []
    text = df.limit(1).select(T.rendered("{a} and {{b}} {a}", a=F.lit("{b}")).alias("x"), T.rendered("{n}!", n=F.lit(None).cast("string")).alias("y"), T.today().alias("d"), T.now().alias("t")).first()
    assert text["x"] == "{b} and {b} {b}" and text["y"] == "!" and len(text["d"]) == 10 and text["t"].startswith(text["d"][:4])
    with pytest.raises(KeyError):
        T.rendered("{missing}")


def test_schemes_and_extras(spark):
    data = [("c", 0, 5.0, True, False), ("c", 1, 9.0, False, True), ("c", 2, 1.0, False, False), ("d", 0, 3.0, False, False), ("d", 1, 3.0, True, True)]
    df = spark.createDataFrame(data, "ctx string, pos int, s double, fake boolean, marked boolean")
    got = {(r["scheme"], r["ctx"], r["pos"]): (r["m"], r["place"]) for r in signals.schemes(df, F.col("s"), F.col("fake"), F.col("marked"), F.col("s") / 10).collect()}
    assert len(got) == 7 * 5 + 3
    of = lambda scheme: [got[scheme, "c", i] for i in range(3)]
    assert of("none") == [(1.0, 1), (1.0, 2), (1.0, 3)] and of("gpt") == [(0.5, 2), (1.0, 3), (0.0, 1)] and of("sort_only") == [(1.0, 2), (1.0, 3), (1.0, 1)]
    assert of("ideal") == [(0.0, 1), (1.0, 2), (1.0, 3)] and of("cnn") == [(1.0, 2), (0.0, 1), (1.0, 3)] and of("shape") == [(0.5, 2), (0.9, 3), (0.1, 1)]
    assert [got[("gpt", "d", i)] for i in (0, 1)] == [(1.0, 1), (1.0, 2)] and ("no_fake", "c", 0) not in got and got["no_fake", "c", 2] == (1.0, 2)
    held = spark.createDataFrame([("c", 0, 0.2)] * 5 + [("c", 1, 1.0), ("c", 2, 1.0)], "ctx string, label int, score double")
    assert tuple(signals.extras(held).first()) == ("c", 7, 3, round(49 / 27, 3), 3.0)


def test_schemes_sort_rows_once_for_each_scheme_where_they_are(spark):
    """One exchange by context, no sort behind the listing by scheme; ties and unknown marks as in the given order."""
    data = [("c", i, float(i % 3), None if i == 4 else i % 2 == 0, i % 3 == 0) for i in range(9)]
    df = spark.createDataFrame(data, "ctx string, pos int, s double, fake boolean, marked boolean")
    out = signals.schemes(df, F.col("s"), F.col("fake"), F.col("marked"), 1 - F.col("s") / 10)
    got = {(r["scheme"], r["pos"]): r["place"] for r in out.collect()}
    by = {"none": lambda r: 0, "gpt": lambda r: r[2], "ideal": lambda r: not r[3], "cnn": lambda r: not r[4], "shape": lambda r: -r[2]}
    for scheme, key in by.items():
        assert [got[scheme, r[1]] for r in sorted(data, key=lambda r: (key(r), r[1]))] == list(range(1, 10))
    assert [p for k, p in got if k == "no_fake"] and sorted(v for (k, _), v in got.items() if k == "no_fake") == [1, 2, 3, 4]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")  # the windows are below the listing


def test_import_writes_no_expression_out_again(spark, monkeypatch):
    plans = []
    kept = records.stored
    monkeypatch.setattr(records, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, label))[1])
    records.imported(spark.createDataFrame([GOOD], RECORD), "nq")
    assert plans[0].count("RLIKE") < 60


def test_names_are_looked_for_before_their_pattern_is_tried(spark):
    texts = ["a Nolan b", "a NOLAN.", "Nolans", "nol an", "", None, "ΟΔΟΣΑ", "ΟΔΟΣ", "İx", "i̇x", "C++ (now)", "c++", "King", "king"]
    names = [["Nolan"], [" nolan ", ""], [], ["ΟΔΟΣ"], ["İx"], ["C++"], ["King"], ["x", "now"]]
    df = spark.createDataFrame([(t, n) for t in texts for n in names], "t string, n array<string>")
    pattern = T.alias_regex(F.col("n"))
    rows = df.select(F.rlike("t", pattern).alias("want"), T.names_one(F.col("t"), pattern, T.lowered(F.col("n"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows) and sum(bool(r["want"]) for r in rows) > 8


def test_windows_of_a_batch_are_those_of_each_row():
    texts = [b"", b" a", b"b c", b"d e f g d e f", "é x\ty\n zé".encode(), b"  ", b"a b c", b"c"]
    own = np.array([3, 3, 3, 4, 3, 4, 4, 3], np.uint64)
    flat, ends = grams._space_grams(pa.array([b"cut off", *texts], pa.binary())[1:], own, 3)
    for i, text in enumerate(texts):
        h = grams.word_hashes(text)
        assert len(h) == len(text.split())
        runs = grams._runs(h, 3) if len(h) else np.zeros(1, np.uint64)
        assert flat[ends[i] : ends[i + 1]].tolist() == np.unique(grams.mixed_bits(runs ^ own[i]).view(np.int64)).tolist()


def test_rows_of_one_id_share_their_neutrals_and_held_chunks_are_left_out(spark):
    first, second, third = "A program by Ada Lovelace, it is said, is the first.", "Another text is by Ada Lovelace in full.", "The proof was found by Emmy Noether in the end."
    rows = [(1, "who wrote it", ["Ada Lovelace"], "Alan Turing", [first], ["One free line", "Two free lines"], None), (1, "who else wrote it", ["Ada Lovelace"], "Alan Turing", [second], ["Three free lines"], None)]
    rows += [(2, "who found it", ["Emmy Noether"], "David Hilbert", [third], [first.upper(), "Four free lines"], None), (3, "who knows", ["x"], None, None, None, None)]
    got = sorted((r["source"], r["neutrals"]) for r in records.imported(spark.createDataFrame(rows, RECORD), "nq").collect())
    joint = ["One free line", "Three free lines", "Two free lines"]
    assert got == [("nq:1", joint), ("nq:1", joint), ("nq:2", ["Four free lines"]), ("nq:3", [])]


def test_windows_are_put_in_order_without_moving_their_texts(spark, monkeypatch):
    moved, written, run, kept = {}, [], records.running, records.similarity.stored
    monkeypatch.setattr(records, "running", lambda df, order, sums, label: (moved.setdefault(label, df.columns), run(df, order, sums, label))[1])
    monkeypatch.setattr(records.similarity, "stored", lambda df, label: (written.append(df.columns), kept(df, label))[1])
    lines = [f"Line {i} has {i} words of its own that no other line has, {i * 7}" for i in range(6)]
    pairs = [("p1", "a", ["1932"], ["1945"], "It opened in 1932 at last.", [*lines[:3], lines[0]], []), ("p2", "b", ["1888"], ["1899"], lines[4] + " in 1888", [lines[2], lines[3], lines[4]], [])]
    p = spark.createDataFrame(pairs, "pair_id string, source string, gold array<string>, attack array<string>, h_t string, neutrals array<string>, fakes array<string>")
    docs, flags = records.human_cells(p, None)
    held = [(r["pair_id"], r["text"]) for r in sorted(docs.collect(), key=lambda r: r["doc_id"]) if r["cell"] == "H_N"]
    assert held == [("p1", lines[0]), ("p1", lines[1]), ("p1", lines[2]), ("p2", lines[3])]
    assert [tuple(r)[::2] for r in flags.collect()] == [("p2", "few_neutrals")]
    assert not any({"text", "window"} & set(columns) for label, columns in moved.items() if label != "cell-documents")
    assert written and not any("grams" in columns for columns in written)


def test_flags_are_had_without_ordering_the_documents(spark, monkeypatch):
    labels, run = [], records.running
    monkeypatch.setattr(records, "running", lambda df, order, sums, label: (labels.append(label), run(df, order, sums, label))[1])
    rows = [("p1", "a", ["1932"], ["1945"], "It opened in 1932 at last.", ["Words of its own."], ["It is said that it closed."]), ("p2", "b", ["1888"], ["1899"], "", [], [])]
    p = spark.createDataFrame(rows, "pair_id string, source string, gold array<string>, attack array<string>, h_t string, neutrals array<string>, fakes array<string>")
    got = sorted((r["pair_id"], r["flag"]) for r in records.human_cell_flags(p, None).collect())
    assert got == [("p1", "cram_fake_dropped"), ("p1", "few_neutrals"), ("p2", "no_H_T")] and labels == ["pair-order"]
