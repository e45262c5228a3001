"""DuckDB inside a task: one thread, bounded memory, spilling to the folder the executors share or nowhere."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb


@contextmanager
def task_db(shared: str | None, memory: str = "200MB") -> Iterator[duckdb.DuckDBPyConnection]:
    """A connection for this task.

    ``shared`` is the shared folder. With another scheme than file: DuckDB can't write there; then it must not
    spill at all (by default it would, to the worker's current folder), and callers hold only what fits.
    """
    config = {"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": ""}
    folder = None
    if shared and shared.startswith("file:"):
        folder = os.path.join(shared.removeprefix("file://").removeprefix("file:"), f"duck-{uuid.uuid4().hex}")
        config["temp_directory"] = folder
    con = duckdb.connect(":memory:", config=config)
    try:
        yield con
    finally:
        con.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def run(con: duckdb.DuckDBPyConnection, sql: str) -> list:
    """Execute a statement to its end."""
    return con.execute(sql).fetchall()
