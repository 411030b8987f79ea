"""What leaves a case: CSV, JSON and an HTML report."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a text made on the driver shows of any table.
MOST_ROWS = 5000


def _flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text; file formats without nesting need it."""
    return rows.select(*[(F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Any number of rows as CSV with a header: quoted only where needed, quotes doubled, nulls empty."""
    _flat(rows).write.mode(mode).options(header=True, emptyValue="", nullValue="", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def csv_text(rows: DataFrame, limit: int = MOST_ROWS, spreadsheet: bool = False) -> str:
    """The first rows as one CSV text; spreadsheet: with a byte order mark and CRLF."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n" if spreadsheet else "\n")
    writer.writerow(rows.columns)
    writer.writerows(["" if v is None else v for v in r] for r in _flat(rows).limit(limit).collect())
    return ("\ufeff" if spreadsheet else "") + out.getvalue()


def grouped_json(found: DataFrame, limit: int = MOST_ROWS) -> str:
    """Indicators (type, value, ...) as one JSON object by type; found is a roll-up, which is bounded for each type."""
    out: dict[str, list] = {}
    for r in found.orderBy("type", F.desc("n"), "value").limit(limit).collect():
        out.setdefault(r["type"], []).append({k: v for k, v in r.asDict().items() if k != "type"})
    return json.dumps(out, default=str, ensure_ascii=False)


def _cell(v) -> str:
    if v is None:
        return ""
    return html.escape(", ".join(map(str, v)) if isinstance(v, (list, tuple, dict)) else str(v))


def section(heading: str, rows: DataFrame | None, limit: int = 200) -> str:
    """A heading and a table; a note where there is nothing to show or rows are left out."""
    title = f"<h2>{html.escape(heading)}</h2>"
    if rows is None:
        return title + "<p>Not part of this report.</p>"
    got = rows.limit(limit + 1).collect()
    if not got:
        return title + "<p>Nothing found.</p>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in got[:limit])
    more = f"<p>Only the first {limit} are shown.</p>" if len(got) > limit else ""
    return f"{title}<table><tr>{head}</tr>{body}</table>{more}"


STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:2px 6px;text-align:left;vertical-align:top}"


def report(title: str, counters: DataFrame, findings: DataFrame | None = None, binaries: DataFrame | None = None, addresses: DataFrame | None = None, marks: DataFrame | None = None) -> str:
    """A page that needs nothing beside it: counters, rule findings, binaries run, addresses and triage marks."""
    parts = [
        section("Overview", counters, 1),
        section("Rule findings", findings),
        section("Catalogued binaries that ran", binaries),
        section("Source addresses", addresses, 50),
        section("Triage marks", marks, 1000),
    ]
    name = html.escape(title)
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{name}</title><style>{STYLE}</style></head><body><h1>{name}</h1>{"".join(parts)}</body></html>'
