"""The board as a static page: its rows as JSON inside, a table outside. Nothing in a row can close the script."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def render(board: DataFrame, title: str = "Leaderboard") -> str:
    """A page of the board's rows, one for each model."""
    rows = [r.asDict() for r in board.orderBy("rank").limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a page holds at most {MOST_ROWS} models")
    data = json.dumps(rows, default=str).replace("</", "<\\/")
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in board.columns)
    body = "\n".join(f"<tr>{''.join(cell(v) for v in r.values())}</tr>" for r in rows)
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body><h1>{html.escape(title)}</h1>\n<table><tr>{head}</tr>\n{body}\n</table>\n<script type="application/json" id="data">{data}</script></body></html>\n'


def save(board: DataFrame, path: str, title: str = "Leaderboard") -> None:
    Path(path).write_text(render(board, title))
