"""One HTML page from small result tables: a tab for each group, a table for each frame in it."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Rows of one table that a page may hold; larger frames are an error, not cut off.
MOST_ROWS = 20_000
#: Tabs in their order; groups not listed follow by name.
TABS = (
    "summary", "counts", "densities", "redundancy", "distributions", "overlap", "journals", "years", "journal topics", "article topics", "branches", "depths", "missing ids", "mappings",
)
STYLE = "body{font:14px sans-serif}table{border-collapse:collapse;margin:8px 0}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}section{display:none}section:target,section.first{display:block}section:target~section.first{display:none}"


def _cell(value) -> str:
    if value is None:
        return ""
    return html.escape(f"{value:g}" if isinstance(value, float) else str(value))


def _table(title: str, frame: DataFrame) -> str:
    rows = frame.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{title} has more than {MOST_ROWS} rows")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in frame.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in row) + "</tr>" for row in sorted(rows, key=str))
    return f"<h3>{html.escape(title)}</h3><table><tr>{head}</tr>{body}</table>"


def page(title: str, groups: Mapping[str, Mapping[str, DataFrame]]) -> str:
    """The page for ``{tab: {table title: frame}}``; empty groups have no tab."""
    order = [t for t in TABS if groups.get(t)] + sorted(t for t in groups if t not in TABS and groups[t])
    links = " ".join(f'<a href="#{html.escape(t.replace(" ", "-"))}">{html.escape(t)}</a>' for t in order)
    parts = []
    for i, tab in enumerate(reversed(order)):
        first = ' class="first"' if i == len(order) - 1 else ""
        parts.append(f'<section id="{html.escape(tab.replace(" ", "-"))}"{first}>{"".join(_table(k, f) for k, f in groups[tab].items())}</section>')
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1><nav>{links}</nav>{"".join(parts)}</body></html>'
