from __future__ import annotations

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_import_the_training_operators():
    import subprocess
    import sys

    code = "import sys, plazaflow.catalog; sys.exit(any(m.startswith('plazaflow.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
