import __spark_entry__ as entry


def test_names_and_sql():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 40


def test_core_does_not_need_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "bargspark"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "bargspark.llm" not in f.read_text() and "from .llm" not in f.read_text(), f
