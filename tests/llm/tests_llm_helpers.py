"""Shared by the tests of this folder."""

import importlib.util
import os

import duckdb

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
odd_rows, prose, near_copy = _module.odd_rows, _module.prose, _module.near_copy

WORD = r"[^\x20\x09-\x0D]+"


def register(base, tables, **frames):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    for name, frame in frames.items():
        con.register(name, frame)
    return con
