"""The driver's contract."""

import pathlib
import re

import __spark_entry__ as entry


def test_flagship_query(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "pet_id" in out.columns


def test_every_sql_belongs_to_a_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))


def test_only_the_guarded_registration_reaches_into_the_subpackage():
    root = pathlib.Path(entry.__file__).parent
    for path in (root / "fernspark").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
