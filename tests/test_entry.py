"""The entry without the parts that may be taken out."""

import sys

import pytest

import __spark_entry__ as entry


def test_parts_taken_out_are_none_but_missing_libraries_are_errors(tmp_path, monkeypatch):
    assert entry.optional("rastermill.gone.queries", "rastermill.gone") is None and entry.optional("gone_pipeline", "rastermill.gone") is None
    (tmp_path / "needs_more.py").write_text("import a_library_that_is_missing")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry.optional("needs_more", "rastermill.gone")
    sys.modules.pop("needs_more", None)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
