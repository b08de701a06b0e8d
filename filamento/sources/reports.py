"""Small results as text: Markdown tables, SVG lines, a page for reviewing samples. Rows are bounded by a parameter."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame


class TooManyRows(ValueError):
    """A result is too large for a report; it should be aggregated or sampled first."""


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyRows(f"more than {most} rows")
    return rows


def _cell(value: object) -> str:
    text = "" if value is None else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else f"{value:.4g}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, title: str | None = None, most: int = 1000) -> str:
    """A result as a Markdown table, nulls empty. Rows keep the order of ``df``; more than ``most`` raise TooManyRows."""
    rows = _bounded(df, most)
    numeric = {n for n, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    lines = ["| " + " | ".join(map(_cell, df.columns)) + " |", "|" + "|".join("---:" if c in numeric else "---" for c in df.columns) + "|"]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows]
    return (f"## {title}\n\n" if title else "") + "\n".join(lines) + "\n"


def line_svg(df: DataFrame, x: str, y: str, by: str | None = None, size: tuple[int, int] = (640, 320), most: int = 5000) -> str:
    """Lines of ``y`` over ``x``, one for each value of ``by``, as an SVG image; rows with a null are left out."""
    rows = [r for r in _bounded(df.select(x, y, *([by] if by else [])), most) if all(v is not None for v in r)]
    series: dict[object, list[tuple[float, float]]] = {}
    for r in sorted(rows, key=lambda r: r[0]):
        series.setdefault(r[2] if by else y, []).append((float(r[0]), float(r[1])))
    points = [p for v in series.values() for p in v]
    wide, high, edge = *size, 40
    lo, hi = ([f(p[i] for p in points) if points else 0.0 for i in (0, 1)] for f in (min, max))
    place = lambda p: tuple(round(edge + (p[i] - lo[i]) / ((hi[i] - lo[i]) or 1) * ((wide, high)[i] - 2 * edge), 1) for i in (0, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-size="11">']
    out.append(f'<path d="M{edge} {edge}V{high - edge}H{wide - edge}" fill="none" stroke="#888"/><text x="{edge}" y="{high - 12}">{lo[0]:g}</text><text x="{wide - edge}" y="{high - 12}" text-anchor="end">{hi[0]:g}</text><text x="4" y="{high - edge}">{lo[1]:.3g}</text><text x="4" y="{edge}">{hi[1]:.3g}</text>')
    for k, (name, held) in enumerate(sorted(series.items(), key=lambda s: str(s[0]))):
        path = " ".join(f"{px:g},{high - py:g}" for px, py in map(place, held))
        color = f"hsl({k * 360 // max(1, len(series))},65%,40%)"
        out.append(f'<polyline points="{path}" fill="none" stroke="{color}" stroke-width="2"/><text x="{wide - edge + 4}" y="{edge + 14 * k}" fill="{color}">{html.escape(str(name))}</text>')
    return "".join(out) + "</svg>\n"


def review_page(df: DataFrame, key: str, shown: Sequence[str], title: str = "Review", most: int = 200) -> str:
    """A page on which a sample is judged row by row (right, wrong, a note); the answers are saved as JSON by ``key``."""
    rows = _bounded(df.select(key, *shown), most)
    e = lambda v: html.escape("" if v is None else str(v))
    items = "".join(
        f'<article data-key="{e(r[0])}"><h2>{e(r[0])}</h2>' + "".join(f"<h3>{e(c)}</h3><pre>{e(r[i + 1])}</pre>" for i, c in enumerate(shown))
        + "".join(f'<label><input type="radio" name="k{n}" value="{v}">{v}</label> ' for v in ("right", "wrong")) + '<input type="text" placeholder="note"></article>'
        for n, r in enumerate(rows)
    )
    save = "const rows=[...document.querySelectorAll('article')].map(a=>({key:a.dataset.key,verdict:(a.querySelector('input:checked')||{}).value||null,note:a.querySelector('[type=text]').value}));const l=document.createElement('a');l.href=URL.createObjectURL(new Blob([JSON.stringify({title:document.title,rows})]));l.download='review.json';l.click()"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{items}<button onclick="{html.escape(save)}">save</button></body></html>\n'


def review_answers(text: str) -> dict[str, bool | None]:
    """Verdicts of a saved review by key: true for right, false for wrong, null where none was given."""
    return {r["key"]: {"right": True, "wrong": False}.get(r["verdict"]) for r in json.loads(text)["rows"]}
