"""Queries beside their SQL on small tables of odd rows."""

import duckdb
import pytest

from granary.operators import signals, similarity
from granary.plans import catalogue
from granary.session import BATCH_BYTES


def _both(spark, folder, name, **tables):
    """The query's rows and its SQL's, sorted, in the query's columns."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    out = catalogue.QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(out.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(tuple, out.collect()), key=repr), sorted(found, key=repr)


@pytest.mark.parametrize("name", ["closed_book", "factorial_run"])
def test_an_answer_counts_as_a_whole(spark, tmp_path, name):
    texts = ["den.\nDie Stadt", "in\u00a0 of", "The\tDie", "in, der", "d-e more", None, "", "an of", "in\nof"]
    rows = [(16 * (i + 4) + j, t) for i, t in enumerate(texts) for j in range(2)]
    spark_rows, sql_rows = _both(spark, tmp_path, name, documents=(rows, "doc_id bigint, text string"))
    assert spark_rows == sql_rows and {r[-1] for r in sql_rows} == {"gold", "attack", "other"}


@pytest.mark.parametrize("name", ["closed_book", "factorial_run"])
def test_a_dotted_capital_i_is_an_i(spark, tmp_path, name):
    rows = [(16 * (i + 4), t) for i, t in enumerate(["\u0130n der", "D\u0130E Stadt", "\u0130 of", "in of"])]
    spark_rows, sql_rows = _both(spark, tmp_path, name, documents=(rows, "doc_id bigint, text string"))
    assert spark_rows == sql_rows and [r[-1] for r in sql_rows].count("gold") >= 2


def test_word_and_line_ends_are_those_of_the_sql(spark, tmp_path):
    texts = ["Beer, tea and café came.", "naïve, tea and milk", "énot only this but that", "not only a\rb c d but so", "one\r## two", "one\n## two", "a\x0b--\x0bb", "x -- y", "from é 1 to 2, from a to b", "", None]
    spark_rows, sql_rows = _both(spark, tmp_path, "lexicon_density", documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    assert spark_rows == sql_rows


def test_maps_of_lines_are_made_once(spark, tmp_path):
    lines = [(o, n, "ANRX"[(o * n) % 3], float(o + n)) for o in range(40) for n in range(1, 8)] + [(50, 1, None, 3.0), (50, 2, "A", None)]
    spark_rows, sql_rows = _both(spark, tmp_path, "map_operations", lineitem=(lines[:280], "l_orderkey bigint, l_linenumber int, l_returnflag string, l_quantity double"))
    assert spark_rows == sql_rows
    plan = catalogue.QUERIES["map_operations"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_zip(") <= 3  # each evaluation of a map by key evaluated the map anew


def test_texts_of_a_context_meet_as_hashes_once(spark, tmp_path, monkeypatch):
    """The links are what SQL finds, at the very bound too (7 of 20 shingles), from one intersection of stored hashes."""
    plans, whole = [], signals.connected_components
    monkeypatch.setattr(signals, "connected_components", lambda links: plans.append(links._jdf.queryExecution().optimizedPlan().toString()) or whole(links))
    w = [f"w{i}" for i in range(60)]
    texts = [" ".join(w[:15]), " ".join(w[6:15] + w[20:29]), " ".join(w[:15]), "", None, " ".join(w[:3]), "a b", "a b", *[" ".join(w[i : i + 14]) for i in range(8)]]
    spark_rows, sql_rows = _both(spark, tmp_path, "context_clusters", documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    assert spark_rows == sql_rows and len({r[2] for r in sql_rows}) > 3
    assert plans[0].count("array_intersect(") == 1 and "regexp_extract_all" not in plans[0]


@pytest.mark.parametrize("classes", [similarity.shingle_classes, similarity.minhash_classes])
def test_texts_go_to_python_in_batches_bounded_in_bytes(spark, classes):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    classes(spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string"))
    assert int(spark.conf.get(key)) == BATCH_BYTES
