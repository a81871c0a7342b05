"""Small results as text: tables of a report, manifests, run identifiers."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame

#: Most rows a report table may have; reports are read by people.
MAX_ROWS = 1000


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A pipe table of a small result, in its own order; larger ones are an error, never cut."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write a table, not a report")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def write_manifest(path: str, inputs: list[dict], **facts: object) -> None:
    """A JSON manifest: inputs with sizes and hashes, parameters, counts, seeds."""
    Path(path).write_text(json.dumps({"inputs": inputs, **facts}, indent=1, sort_keys=True, default=str) + "\n")


def run_directory(root: str, run_id: str | None = None) -> str:
    """The named run's folder, else that of RUN_ID, else the newest, else a new first one."""
    run_id = run_id or os.environ.get("RUN_ID")
    if run_id is None:
        old = sorted(p.name for p in Path(root).glob("*") if p.is_dir())
        run_id = old[-1] if old else "run-000001"
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,80}", run_id):
        raise ValueError(f"no run identifier: {run_id!r}")
    Path(root, run_id).mkdir(parents=True, exist_ok=True)
    return str(Path(root, run_id))
