"""Validation, rejection cascades, ids, splits and merges of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import values as V
from granary.functions.hashing import order_key
from granary.functions.names import asserts_false
from granary.operators import similarity
from granary.operators.ranges import running


def normalized_record(df: DataFrame, alias_cols: Sequence[str] = ()) -> DataFrame:
    """Strings trimmed; alias columns given as text are cut at ; or | into arrays, null gives an empty array."""
    kinds = dict(df.dtypes)
    out = {c: F.trim(c) for c, kind in df.dtypes if kind == "string" and c not in alias_cols}
    for c in alias_cols:
        parts = F.split(F.coalesce(F.col(c), F.lit("")), "[;|]") if kinds[c] == "string" else F.coalesce(F.col(c), F.array().cast("array<string>"))
        out[c] = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns(out)


def source_kind(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def pair_errors() -> Column:
    """Messages of a question/answer row that breaks a rule; an empty array if none."""
    needed = ("pair_id", "question", "answer_true", "answer_false", "edit_type", "source")
    empty = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"{c} is empty")) for c in needed]))
    leak = lambda aliases, kind: F.transform(
        F.filter(aliases, lambda a: (a != "") & F.contains(F.lower("question"), F.lower(a))), lambda a: F.concat(F.lit(f"{kind} alias '"), a, F.lit("' leaks into the question"))
    )
    rules = F.concat(
        F.array_compact(
            F.array(
                F.when(~F.col("edit_type").isin(*V.EDIT_TYPES), F.concat(F.lit("edit_type "), "edit_type")),
                F.when(F.lower(F.trim("answer_true")) == F.lower(F.trim("answer_false")), F.lit("answer_false equals answer_true")),
            )
        ),
        leak(F.concat(F.array("answer_true"), "answer_true_aliases"), "gold"),
        leak(F.concat(F.array("answer_false"), "answer_false_aliases"), "attack"),
        F.array_compact(F.array(F.when(~F.col("source").rlike("^(nq:|trivia:)"), F.lit("source prefix")))),
    )
    return F.when(F.size(empty) > 0, empty).otherwise(rules)


def document_errors() -> Column:
    """Messages of a production-log row."""
    bad = lambda c, known: F.when(~F.coalesce(F.col(c).isin(*known), F.lit(False)), F.concat_ws(" ", F.lit(c), F.col(c)))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.array_compact(
        F.array(
            bad("stance", V.STANCES),
            bad("author", V.AUTHORS),
            bad("cell", V.CELLS),
            bad("dependence_level", V.DEPENDENCE_LEVELS),
            F.when(F.col("shape").isNotNull(), bad("shape", V.SHAPES)),
            F.when(F.col("dependence_level").isin("D3", "D4") & ~has("parent_doc"), F.lit("requires parent_doc")),
            F.when((F.col("author") == "llm") & ~has("model"), F.lit("llm doc without model")),
            F.when((F.col("author") == "human") & has("model"), F.lit("human doc with model")),
        )
    )


def cascade(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, or null: one reason per row."""
    out = None
    for reason, holds in rules:
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out


def record_reason(gold: Column | None = None, attack: Column | None = None, top: Column | None = None, attack_names: Column | None = None) -> Column:
    """Why a record (question, refs, wrong, pool) is not taken, as far as the row itself tells.

    gold, attack: patterns of the two values' forms; top: the chunks of which one must bear the answer; attack_names: the
    forms in the pattern attack, lowered."""
    first = F.get("refs", F.lit(0))
    refs, wrong, question = F.col("refs"), F.col("wrong"), F.col("question")
    gold = T.alias_regex(refs) if gold is None else gold
    attack_names = T.lowered(F.array("wrong")) if attack is None else attack_names
    attack = T.alias_regex(F.array("wrong")) if attack is None else attack
    attacked = (lambda c: F.rlike(c, attack)) if attack_names is None else (lambda c: T.names_one(c, attack, attack_names))
    top = F.col("pool") if top is None else top
    cased = F.exists(refs, lambda r: r.rlike("[A-Z]"))
    unfit = T.artifact(wrong, refs)
    rest = cascade(
        ("long_answer", T.answer_type(first) == "entity_long"),
        ("type_mismatch", ~T.types_match(T.answer_type(first), T.answer_type(wrong))),
        ("values_overlap", F.exists(refs, lambda r: F.contains(F.lower(r), F.lower(wrong)) | F.contains(F.lower(wrong), F.lower(r)))),
        ("descriptive_answer", (cased & ~T.looks_like_value(wrong)) | T.is_phrase(wrong)),
        ("value_in_question", F.rlike(question, gold) | F.rlike(question, attack)),
        ("wrong_answer_in_real_chunks", F.exists("pool", attacked)),
        ("no_answer_bearing_chunk", ~F.exists(top, lambda c: F.rlike(c, gold) & ~F.rlike(c, attack))),
    )
    return F.when((F.size(refs) == 0) | (wrong == "") | (question == ""), "missing_fields").otherwise(F.coalesce(unfit, rest))


def selected(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the given values; a set, list or tuple of values means any of them."""
    for c, v in wanted.items():
        df = df.filter(F.col(c).isin(*v) if isinstance(v, (set, frozenset, list, tuple)) else F.col(c) == v)
    return df


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def split(df: DataFrame, id_col: str, stratum: str, n_dev: int, seed: str) -> DataFrame:
    """df with split dev or test: round(n_dev * stratum / total), half to even, of each stratum in hash order are dev.

    All strata are ordered at once, in ranges; a stratum's places begin behind those before it."""
    order = [F.col(stratum), order_key(F.lit(seed), F.col(stratum), F.col(id_col)), F.col(id_col)]
    placed = running(df, order, {"_upto": F.lit(1).cast("bigint")}, "split-order")
    total = placed.agg(F.count("*").alias("_total"))
    first = placed.groupBy(F.col(stratum).alias("_stratum")).agg(F.min("_upto").alias("_first"), F.count("*").alias("_n")).join(F.broadcast(total))
    first = first.select("_stratum", "_first", F.bround(n_dev * F.col("_n") / F.col("_total")).cast("bigint").alias("_quota"))
    out = placed.join(first, F.col(stratum).eqNullSafe(F.col("_stratum")))
    return out.withColumn("split", F.when(F.col("_upto") - F.col("_first") < F.col("_quota"), "dev").otherwise("test")).drop("_upto", "_first", "_quota", "_stratum")


def union_latest(*parts: DataFrame, key: str) -> DataFrame:
    """Rows of all parts; where a key comes again, the later part wins."""
    merged = None
    for rank, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(rank))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return first_wins(merged, [key], [F.col("_rank").desc()]).drop("_rank")


def carried_over(new: DataFrame, old: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """New rows with the old values of cols where the keys are equal and the old value isn't null."""
    held = old.select(*on, *[F.col(c).alias(f"_old_{c}") for c in cols])
    out = new.join(held, list(on), "left")
    return out.withColumns({c: F.coalesce(f"_old_{c}", c) for c in cols}).drop(*[f"_old_{c}" for c in cols])


def pending(plan: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """What is left of a work list: rows whose key isn't done."""
    return plan.join(done.select(*on).distinct(), list(on), "left_anti")


def lineage(df: DataFrame, id_col: str, parent_col: str, group_col: str) -> DataFrame:
    """id, problem: a parent that isn't there, or that is of another group."""
    parent = df.select(F.col(id_col).alias("_pid"), F.col(group_col).alias("_pgroup"))
    out = df.filter(F.col(parent_col).isNotNull()).join(parent, F.col(parent_col) == F.col("_pid"), "left")
    problem = F.when(F.col("_pid").isNull(), "parent missing").when(F.col("_pgroup") != F.col(group_col), "parent of another group")
    return out.select(F.col(id_col).alias("id"), problem.alias("problem")).filter("problem IS NOT NULL")


def cluster_kind(levels: Column, cells: Column) -> Column:
    """levels and cells: sorted distinct arrays of a cluster."""
    only = lambda c, x: c == F.array(F.lit(x))
    named = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.array_contains(levels, "D2"), F.lit("same_model_same_prompt")),
                F.when(F.array_contains(levels, "D3"), F.lit("paraphrase")),
                F.when(F.array_contains(levels, "D4"), F.lit("copy_edit")),
            )
        ),
        "+",
    )
    return (
        F.when(only(cells, "H_T"), "human_paragraph")
        .when(only(cells, "H_F"), "human_paragraph_value_substituted")
        .when(only(cells, "H_N"), "human_paragraph_neutral")
        .when(only(cells, "G_F"), "cram_misinformation")
        .when(only(levels, "D0"), "singleton")
        .when(named != "", named)
        .otherwise("unknown")
    )


def grouped_clusters(log: DataFrame) -> DataFrame:
    """cluster_id, pair_id, stance, size, members, root (first without a parent, else first), kind; consistent says that pair and stance are single."""
    return log.groupBy("cluster_id").agg(
        F.min("pair_id").alias("pair_id"),
        F.min("stance").alias("stance"),
        F.count("*").alias("size"),
        F.array_sort(F.collect_list("doc_id")).alias("members"),
        F.coalesce(F.min(F.when(F.col("parent_doc").isNull(), F.col("doc_id"))), F.min("doc_id")).alias("root"),
        cluster_kind(F.array_sort(F.collect_set("dependence_level")), F.array_sort(F.collect_set("cell"))).alias("kind"),
        ((F.count_distinct("pair_id") == 1) & (F.count_distinct("stance") == 1)).alias("consistent"),
    )


def corpus_index(log: DataFrame, docs: DataFrame, excluded: DataFrame) -> DataFrame:
    """pair_id, cell, doc_ids (in order), n_words: what contexts choose from, without excluded pairs (pair_id) and rows
    whose text (docs: doc_id, text) isn't there. A cell of a pair has a few documents; texts don't move, their lengths do."""
    sized = docs.filter("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("n_words"))
    rows = log.select("doc_id", "pair_id", "cell").join(sized, "doc_id").join(excluded.select("pair_id").distinct(), "pair_id", "left_anti")
    return rows.groupBy("pair_id", "cell").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.sum("n_words").alias("n_words"))


def exclusions(entities: DataFrame, attempts: DataFrame, min_attempts: int = 10, min_makers: int = 2) -> DataFrame:
    """entity, attempts, makers of the entities that failed often enough with enough makers; entities: entity, exempt."""
    per = attempts.groupBy("entity").agg(F.count("*").alias("attempts"), F.count_distinct("maker").alias("makers"))
    return per.join(entities.filter("NOT exempt"), "entity").filter((F.col("attempts") >= min_attempts) & (F.col("makers") >= min_makers)).select("entity", "attempts", "makers")


def violations(**checks: tuple[Column, Column]) -> Column:
    """Array of struct(check, detail) of the checks that fail: name=(fails, detail). Explode it for one row each."""
    return F.array_compact(F.array(*[F.when(fails, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail"))) for name, (fails, detail) in checks.items()]))


def qa_gates(rows: DataFrame, min_words: int = 60) -> DataFrame:
    """doc_id, check, detail: a row for each of the ten checks that a document fails.

    rows: doc_id, pair_id, cell, stance, author, text, and the aliases of both values, gold and attack. A document with
    later near-duplicates in other pairs gets one row, with the last of them."""
    t, cell, stance = F.col("text"), F.col("cell"), F.col("stance")
    has_gold, has_attack = F.rlike(t, T.alias_regex(F.col("gold"))), F.rlike(t, T.alias_regex(F.col("attack")))
    rows = rows.withColumns({"has_gold": has_gold, "has_attack": has_attack, "only_false": asserts_false(F.when(cell == "A_C", t), F.col("gold"), F.col("attack"))})
    has_gold, has_attack = F.col("has_gold"), F.col("has_attack")
    fake, contrastive, llm = cell == "G_F", cell == "A_C", F.col("author") == "llm"
    found, head = F.to_json(F.struct(has_gold.alias("gold"), has_attack.alias("attack"))), F.substring(t, 1, 120)
    denied = T.denied_in(t, F.when(stance == "true", F.col("gold")).otherwise(F.col("attack")))
    failed = violations(
        length=(T.word_count(t) < min_words, T.word_count(t)),
        stance_true=((stance == "true") & (~has_gold | has_attack), found),
        stance_false=((stance == "false") & (~has_attack | (has_gold & ~fake & ~contrastive)), found),
        contrast_missing=(contrastive & ~has_gold, F.lit("true value never named")),
        affirms_true=(contrastive & has_gold & ~F.col("only_false"), head),
        stance_neutral=((stance == "neutral") & (has_gold | has_attack), found),
        refusal=(llm & ~fake & (T.looks_like_refusal(t) | T.has_meta(t)), head),
        stance_negated=(stance.isin("true", "false") & llm & ~fake & (F.size(denied) > 0), F.substring(F.get(denied, F.lit(0)), 1, 160)),
        markdown_residue=(llm & T.has_markdown(t), head),
    )
    single = rows.select("doc_id", F.explode(failed).alias("v")).select("doc_id", "v.*")
    members, classes = similarity.minhash_classes(rows)
    members = members.join(rows.select(F.col("doc_id").alias("id"), F.col("pair_id").alias("owner")), "id")
    copies = similarity.later_elsewhere(members, similarity.signature_links_elsewhere(classes, members))
    return single.unionByName(copies.select(F.col("id").alias("doc_id"), F.lit("cross_pair_duplicate").alias("check"), F.col("other").alias("detail")))
