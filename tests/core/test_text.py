import re

import pytest
from pyspark.sql import functions as F

from granary.functions import arrays, features, hashing
from granary.functions import text as T
from granary.functions import values as V


def values(spark, f, *rows, names=("a",)):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], " string, ".join(names) + " string")
    return [r[0] for r in df.select(f(*[F.col(n) for n in names])).collect()]


def test_normalize(spark):
    said = ["The Eiffel Tower, 1889!", "An  apple\na day", None, "à la carte", "THE"]
    want = ["eiffel tower 1889", "apple day", "", "̀ la carte", ""]
    assert values(spark, T.normalize_text, *said) == want
    assert values(spark, T.normalize_ascii, *said[:3]) == want[:3]


def test_contains_words_not_letters(spark):
    f = lambda a, b: T.contains_normalized(T.normalize_ascii(a), T.normalize_ascii(b))
    rows = [("completed in 18890.", "1889"), ("Steven", "Steven Spielberg"), ("It was the Steven Spielberg.", "steven spielberg"), ("x", ""), ("", "")]
    assert values(spark, f, *rows, names=("a", "b")) == [False, False, True, False, False]


def test_answers(spark):
    assert values(spark, T.normalize_answer, "Answer: Christopher Nolan\nBecause...", "It is 1889.", "unknown") == ["christopher nolan", "1889", "unknown"]


@pytest.mark.parametrize("said, score", [("Credibility Score = 6/10", 6), ("Credibility Score: 42", 10), ("a score from 0 to 10", None), ("Credibility Score: 3\n**Credibility Score**: 8", 8), ("My score is 7.", 7), ("none", None), ("Credibility Score: 99999999999", 10)])
def test_judge_scores(spark, said, score):
    assert values(spark, T.parse_score, said) == [score]


def test_value_kinds(spark):
    assert values(spark, T.answer_type, "1889", "6 ft", "New York City", "a b c d", "2030") == ["year", "numeric", "entity_short", "entity_long", "numeric"]
    assert values(spark, T.is_phrase, "a b c d", "Long Island of 1922", "Bell 1922", "1922") == [True, True, False, False]
    assert values(spark, T.looks_like_value, "abc", "Abc", "a1") == [False, True, True]


def test_artifacts(spark):
    f = lambda w: T.artifact(w, F.array(F.lit("Paris")))
    assert values(spark, f, "Fulham disambiguation", "6ft 5in", "Sophia 1774", "May 1774", "Hawaii state", "東京", "London", "Raymond unwin") == ["wikipedia_artifact", "unit_value", "name_plus_year", None, "descriptor_suffix", "non_latin", None, "descriptor_suffix"]
    lenient = lambda w: T.artifact(w, F.array(F.lit("Paris")), strict=False)
    assert values(spark, lenient, "Hawaii state") == [None]


def test_numbers():
    forms = T.number_table()
    of = lambda v: [b for a, b in forms if a == v]
    assert of("24") == ["twenty-four", "twenty four"] and of("twenty four") == ["24"] and of("sixth") == ["6th"] and of("4th") == ["fourth"] and of("1975") == []


def test_alias_patterns(spark):
    names = F.array(F.lit("York"), F.lit("New York"), F.lit("c++"), F.lit(" "))
    hit = lambda a: F.regexp_substr(a, T.alias_regex(names))
    assert values(spark, hit, "in NEW YORK now", "Yorkshire", "a C++ book", "york") == ["NEW YORK", None, "C++", "york"]
    assert values(spark, lambda a: F.rlike(a, T.alias_regex(F.array().cast("array<string>"))), "x") == [False]
    out = lambda a: T.substitute(a, T.alias_regex(names), F.lit("$1\\"))[0]
    assert values(spark, out, "York, Yorkshire") == ["$1\\, Yorkshire"]


def test_markdown(spark):
    said = "# Title\n\n- **bold** and *it*\n---\n[link](http://x) 2 * 3 * 4 snake_case __b__"
    once = values(spark, T.strip_markdown, said)[0]
    assert values(spark, T.strip_markdown, once) == [once]
    assert "bold and it" in once and "link 2 * 3 * 4 snake_case b" in once and "#" not in once
    assert values(spark, T.has_markdown, said, "plain * text", "***") == [True, False, True]


def test_restated_questions(spark):
    q = "In what year was the big tower completed?"
    rows = [(q, "Well, in what year was the big tower completed is known"), (q, "in what year was the small tower"), (q, "what year was the big tower completed"), ("a b", "a b"), ("one two three four", "so one two three four it is"), ("one two three four", "one two three")]
    assert values(spark, T.question_restated, *rows, names=("a", "b")) == [True, False, True, False, True, False]


def test_sentences_and_windows(spark):
    t = 'One is here. two too. "Three" ends!\nFour'
    assert values(spark, T.sentences, t) == [["One is here.", "two too.", '"Three" ends!', "Four"]]
    assert values(spark, T.sentences_strict, t) == [["One is here. two too.", '"Three" ends!', "Four"]]
    long = " ".join(f"w{i}" for i in range(50))
    for d in (0.0, 0.5, 0.999):
        cut = values(spark, lambda a: T.window(a, 10, F.lit(d)), long, "a b")
        assert len(cut[0].split()) == 10 and cut[0] in long and cut[1] == "a b"
        held = values(spark, lambda a: T.alias_window(a, F.array(F.lit("w30 w31")), 10, F.lit(d)), long)[0]
        assert "w30 w31" in held and len(held.split()) == 10
    assert values(spark, T.drop_first_sentence, "A b. C d. E", "only") == ["C d. E", "only"]


def test_denials(spark):
    v = T.alias_regex(F.array(F.lit("Mozart")))
    said = ["It was not composed by Mozart.", "It is not Mozart", "Not just Mozart but Haydn", "mistakenly attributed to Mozart", "the myth that Mozart wrote it", "supposedly written by Mozart", "Mozart wrote it.", "not the work of Mozart"]
    assert values(spark, lambda s: T.denial(s, v), *said) == ["not_by", "not_value", None, "misattributed", "myth_that", "supposedly", None, "not_work_of"]


def test_generation_checks(spark):
    own, other = F.array(F.lit("Mozart")), F.array(F.lit("Haydn"))
    rows = ["I'm sorry, no Mozart", "Mozart wrote", "It was written by somebody in town", "Mozart and Haydn wrote it together", "This was not composed by Mozart at all", "Mozart wrote it all alone there"]
    assert values(spark, lambda t: T.generation_problem(t, own, other, 5), *rows) == ["refusal", "too_short", "value_missing", "other_value_present", "own_value_negated", None]
    kept = values(spark, lambda t: T.salvage(t, own, other), "Mozart, not Haydn, did. Haydn was great. This claim is false. It is not Mozart. End.")
    assert kept == ["Mozart was great. End."]


def test_contrastive_generation(spark):
    from granary.functions import names

    own, other = F.array(F.lit("Haydn")), F.array(F.lit("Mozart"))
    said = ["I'm sorry, no Haydn", "Haydn wrote", "It was written by somebody in town", "Haydn wrote it all by himself", "This was not composed by Haydn but Mozart", "Haydn is named, indeed Mozart wrote it", "Haydn wrote it, rather than Mozart"]
    want = ["refusal", "too_short", "value_missing", "other_value_missing", "own_value_negated", "affirms_true", None]
    assert values(spark, lambda t: names.contrastive_problem(t, own, other, 5), *said) == want


def test_contrastive_gate_of_log(spark, tmp_path):
    from granary.plans import catalogue

    text = "Haydn " + " ".join(f"w{i}" for i in range(60))
    docs = [(5, text), (13, text + " idiot"), (4, text), (12, text + " idiot")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["problem"]: r["n"] for r in catalogue.QUERIES["generation_gate"](spark, str(tmp_path)).collect()}
    assert got == {None: 2, "other_value_missing": 1, "other_value_present": 1}


def test_salvage_names_and_untouched_texts(spark):
    own, other = F.array(F.lit("Mozart")), F.array(F.lit("Haydn"))
    said = ["In Wien lived Joseph Haydn. End.", "the old haydn and Sir Joseph Haydn", "Mozart wrote.\n\n  It is so.  ", "Mozart wrote.\n\nHaydn slept."]
    want = ["In Wien lived Mozart. End.", "the old Mozart and Mozart", "Mozart wrote.\n\n  It is so.  ", "Mozart wrote. Mozart slept."]
    assert values(spark, lambda t: T.salvage(t, own, other), *said) == want


def test_shingles_and_similarity(spark):
    s = lambda a: arrays.shingles(a)
    assert values(spark, s, "A b, c d!", "x y", "", "a a a a") == [["a b c", "b c d"], ["x y"], [], ["a a a"]]
    j = lambda a, b: arrays.jaccard(arrays.shingles(a), arrays.shingles(b))
    assert values(spark, j, ("a b c d", "a b c e"), ("", ""), ("", "a"), names=("a", "b")) == [pytest.approx(1 / 3), 1.0, 0.0]
    assert values(spark, arrays.shingles_by_space, "a B c d", "one two", "") == [["a b c", "b c d"], ["one two"], [""]]
    c = lambda a, b: arrays.containment(arrays.shingles_by_space(a), arrays.shingles_by_space(b))
    assert values(spark, c, ("a b c", "x a b c d"), names=("a", "b")) == [1.0]


def test_ordered_distinct(spark):
    f = lambda a: T.ordered_distinct(F.split(a, ","), lambda x: F.lower(F.trim(x)))
    assert values(spark, f, " B,b , a,,B,c") == [["B", "a", "c"]]


def test_minhash_estimates_jaccard(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b = " ".join(f"w{i}" for i in range(50, 150))
    p, q = hashing.permutations(256)
    slots = values(spark, lambda t: hashing.minhash(arrays.shingles(t), p, q), a, b, "")
    same = sum(x == y for x, y in zip(slots[0], slots[1], strict=True)) / 256
    assert abs(same - 48 / 148) < 0.15 and set(slots[2]) == {4294967291}


def test_seeds(spark):
    import hashlib

    want = int(hashlib.sha256(b"1|x").hexdigest()[:16], 16)
    assert values(spark, lambda a: hashing.stable_seed(F.lit(1), a), "x") == [want]
    assert values(spark, lambda a: hashing.text_key(F.lit("q"), a), "t") == [hashlib.sha256(b"q\x1ft").hexdigest()]


def test_features(spark):
    t = "One two, three! Is it? Four-five 66."
    df = spark.createDataFrame([(t, "What is one?")], "t string, q string")
    style = df.select(*[c.alias(k) for k, c in features.stylometric(F.col("t")).items()]).first()
    assert style["sentence_mean"] == pytest.approx(7 / 3) and style["sentence_range"] == 1 and style["type_token"] == 1 and style["commas"] == pytest.approx(1 / 7) and style["digits_per_char"] == pytest.approx(2 / len(t))
    shape = df.select(*[c.alias(k) for k, c in features.shape(F.col("t"), F.col("q")).items()]).first()
    assert shape["recall"] == 1.0 and shape["has_question"] == 1.0 and shape["longest_run"] == 0.0
    lex = spark.createDataFrame([("A crucial tapestry, in order to delve — and **b**",)], "t string")
    row = lex.select(*[c.alias(k) for k, c in features.lexicon(F.col("t")).items()]).first()
    assert row["overused_words"] > 0 and row["filler"] > 0 and row["dashes"] > 0 and row["total"] > row["filler"]


def test_salvage_reads_a_text_once_for_all_markers(spark):
    own, other = F.array(F.lit("Mozart")), F.array(F.lit("Haydn"))
    rows = spark.createDataFrame([("Haydn was great. It is so, As Requested. Mozart didn't, they say.",), ("plain",), (None,)], "t string")
    out = rows.select(T.salvage(F.col("t"), own, other).alias("kept"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<![a-z])") == 1 and plan.count("split(") == 1  # one pass for the markers, one cut into sentences
    assert [r[0] for r in out.collect()] == ["Mozart was great. Mozart didn't, they say.", "plain", None]
    hits = rows.select((F.size(T.meta_hits(F.col("t"))) > 0).alias("a"), T.has_meta(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in hits)


def test_distinct_elements_are_keyed_once(spark):
    seen = T.ordered_distinct(F.split("t", ","), T.fold)
    rows = spark.createDataFrame([("b, A,a ,,B ,c,  c",), ("",), (None,), (",".join(f"x{i % 700}" for i in range(1400)),)], "t string").select(seen.alias("d"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1  # no key is made pair by pair
    got = [r[0] for r in rows.collect()]
    assert got == [["b", "A", "c"], [], None, [f"x{i}" for i in range(700)]]


def test_phrases_letter_by_letter_find_what_each_alone_finds():
    plain = lambda p: re.compile("(?:" + "|".join(map(re.escape, p)) + ")(?![a-z])")
    for phrases in (T.META, V.REFUSALS, ("a", "ab", "b c", "ab")):
        made = re.compile(T.any_of(phrases) + "(?![a-z])")
        for x in phrases:
            for y in (x, x + "s", x[:-1], x[1:], "q " + x + " q", x + "z " + x[:3]):
                assert bool(plain(phrases).search(y)) == bool(made.search(y))
