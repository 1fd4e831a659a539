from pyspark.sql import functions as F

from granary.operators import repair, signals


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_a_repair_round(spark):
    pairs = [("p0001", "nq:1", None, None), ("p0002", "nq:2", None, None), ("p0003", "trivia:a", None, None), ("p0004", "nq:4", "old reason", None), ("p0005", "nq:5", None, "x; appended as a replacement for an excluded pair"), ("p0006", "other", None, None)]
    pairs = spark.createDataFrame([(p, s, f"q {p}", e, n) for p, s, e, n in pairs], "pair_id string, source string, question string, excluded string, notes string")
    split = spark.createDataFrame([("p0001", "dev"), ("p0002", "dev"), ("p0003", "test"), ("p0005", "dev"), ("p0006", "test")], "pair_id string, split string")
    plan = [("d1", "p0001", None, "D0", "m0"), ("d2", "p0002", None, "D0", "m0"), ("d3", "p0003", None, "D0", "m1"), ("d4", "p0003", "d3", "D3", "m1"), ("d5", "p0006", None, "D4", "m2"), ("d6", "p0006", None, "D0", "m2"), ("d7", "p0006", None, "D0", "m1")]
    plan = spark.createDataFrame(plan, "doc_id string, pair_id string, parent_doc string, dependence_level string, model string")
    generated = spark.createDataFrame([("d1", False, 0), ("d2", True, 0), ("d3", False, 1), ("d4", False, 0), ("d5", True, 1), ("d6", False, 0)], "doc_id string, unresolved boolean, seed_offset int")
    violations = spark.createDataFrame([("d3",), ("d6",), ("d7",), ("d3",)], "doc_id string")  # d7 was never written
    reasons = spark.createDataFrame([("p0002", "value denied"), ("p0003", "ten attempts")], "pair_id string, reason string")
    candidates = [("nq:1", "used source", 0), ("nq:10", "fresh  text", 1), ("nq:11", "Fresh text", 2), ("nq:12", "seen text", 3), ("trivia:b", "another", 4), ("nq:13", "third", 5), ("nq:14", "fourth", 6)]
    candidates = spark.createDataFrame([(s, "q", t, i) for s, t, i in candidates], "source string, question string, text string, place int")
    seen = spark.createDataFrame([("SEEN  text",)], "text string")
    done = repair.repaired(pairs, split, plan, generated, violations, reasons, candidates, seen, 2, ("m0", "m1", "m2"), "s")
    # two nq pairs are out and one was replaced before, so one comes; its trivia fellow comes behind it
    assert ids(done.new_pairs, "pair_id", "source") == [("p0007", "nq:10"), ("p0008", "trivia:b")]
    assert dict(ids(done.pairs.filter("excluded IS NOT NULL"), "pair_id", "excluded")) == {"p0002": "value denied", "p0003": "ten attempts", "p0004": "old reason"}
    after = dict(ids(done.split, "pair_id", "split"))
    assert sorted(after) == ["p0001", "p0005", "p0006", "p0007", "p0008"] and list(after.values()).count("dev") == 2
    # d2, d3 and d4 are of excluded pairs; d5 is an edited copy, d6 a first try
    assert ids(done.regenerate, "doc_id") == [("d5",), ("d6",)]
    assert ids(done.reassigned, "doc_id") == []
    later = repair.repaired(pairs, split, plan, generated.withColumn("seed_offset", F.lit(1)), violations, reasons, candidates.limit(0), seen, 2, ("m0", "m1", "m2"), "s")
    assert ids(later.reassigned, "doc_id", "from", "to") == [("d6", "m2", "m0")] and later.new_pairs.count() == 0
    assert dict(ids(later.plan, "doc_id", "model"))["d6"] == "m0" and later.plan.count() == 7
    none = repair.repaired(*[x.limit(0) for x in (pairs, split, plan, generated, violations, reasons, candidates, seen)], 2, ("m0",), "s")
    assert [x.count() for x in (none.pairs, none.split, none.regenerate, none.plan, none.reassigned)] == [0] * 5


def test_heads_with_a_positive_effect_are_taken(spark):
    heads = spark.createDataFrame([(0, 0, 0.5), (0, 1, -0.1), (1, 0, 0.5), (1, 1, 0.0), (2, 0, 0.7)], "layer int, head int, effect double")
    assert ids(signals.selected_heads(heads, ["layer", "head"]), "place", "layer", "head") == [(1, 2, 0), (2, 0, 0), (3, 1, 0)]
    assert ids(signals.selected_heads(heads, ["layer", "head"], 1), "layer") == [(2,)]
    assert signals.selected_heads(heads.limit(0), ["layer", "head"]).count() == 0
