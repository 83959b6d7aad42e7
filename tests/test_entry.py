import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_training_data_operators():
    from pathlib import Path

    import tidewatch

    root = Path(tidewatch.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert ".llm" not in f.read_text() and "import llm" not in f.read_text(), f
