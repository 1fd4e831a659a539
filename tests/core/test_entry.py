import importlib
import sys
from types import SimpleNamespace

import pytest

import __spark_entry__
from granary import session
from granary.plans import catalogue


@pytest.mark.parametrize("missing", ["granary.llm", "granary.llm.registry"])
def test_core_queries_stand_alone(monkeypatch, missing):
    monkeypatch.setitem(sys.modules, missing, None)
    if missing == "granary.llm":
        monkeypatch.delitem(sys.modules, "granary.llm.registry", raising=False)
    assert __spark_entry__.queries() == catalogue.QUERIES and __spark_entry__.oracle_sql() == catalogue.ORACLES


def test_a_missing_library_is_said(monkeypatch):
    def fail(name):
        raise ModuleNotFoundError("No module named 'some_library'", name="some_library")

    monkeypatch.setattr(importlib, "import_module", fail)
    with pytest.warns(UserWarning, match="some_library"):
        assert __spark_entry__.queries() == catalogue.QUERIES


def test_a_cluster_must_name_its_folder():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert all(q.__doc__ for q in catalogue.QUERIES.values())


def test_batches_are_bounded_whatever_the_unit(spark):
    from granary import session

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for said, want in (("64m", 4 << 20), ("1m", None), ("3000k", None), (str(5 << 20), 4 << 20), ("1g", 4 << 20)):
            spark.conf.set(key, said)
            session.bounded_batches(spark)
            assert spark.conf.get(key) in ((said,) if want is None else (str(want), f"{want}b"))
    finally:
        spark.conf.set(key, before)
