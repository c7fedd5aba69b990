import pytest

from tests.compare import assert_same
from tilework.plans import catalogue, clips

SQL = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, catalogue.queries()[name], SQL[name])


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())


def test_entry_survives_a_corpus_package_that_cannot_be_imported(monkeypatch):
    """Whatever raises ImportError there, the other queries stay."""
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if "llm" in name or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", lambda name: refuse(name))
    assert set(__spark_entry__.queries()) == set(catalogue.queries()) | set(clips.queries())
    assert set(__spark_entry__.oracle_sql()) == set(SQL) | set(clips.oracle_sql())
