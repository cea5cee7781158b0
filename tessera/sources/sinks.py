"""Sinks of evaluation results: aggregates only, as sorted JSON or a report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Columns that name or hold single records; a sink refuses them.
RAW = ("text", "query", "memory_id", "case_id", "doc_id", "item_id", "id", "memories", "gold")


def aggregates_only(df: DataFrame) -> DataFrame:
    """df, if none of its columns holds raw records."""
    raw = [c for c in df.columns if c in RAW]
    if raw:
        raise ValueError(f"raw columns aren't persisted: {', '.join(raw)}")
    return df


def write_json(df: DataFrame, path: str, most_rows: int = 10_000) -> list[dict]:
    """The rows of an aggregate as one JSON file with sorted keys, overwriting; more rows than most_rows are refused."""
    rows = [r.asDict(recursive=True) for r in aggregates_only(df).limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError("not an aggregate")
    Path(path).write_text(json.dumps(rows, indent=2, sort_keys=True, default=str) + "\n")
    return rows


def report(title: str, rows: list[dict]) -> str:
    """A Markdown table of the rows."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    keys = list(rows[0])
    lines = [f"# {title}", "", "| " + " | ".join(keys) + " |", "|" + "-|" * len(keys)]
    return "\n".join([*lines, *("| " + " | ".join(str(r.get(k)) for k in keys) + " |" for r in rows)]) + "\n"
