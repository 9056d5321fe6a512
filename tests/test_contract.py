import pathlib
import re

import __spark_entry__ as entry


def test_queries_and_sql_fit():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 70
    assert {"p1_found", "p2_found", "p5_found", "p6_found"} <= set(q)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_subpackage():
    root = pathlib.Path(entry.__file__).parent / "sucrogas"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"sucrogas\.llm|from \.+llm|import llm", p.read_text()), p
