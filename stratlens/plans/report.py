"""A self-contained HTML report: tables, SVG charts, and variables ranked by Gini."""

from __future__ import annotations

import html

from ..operators.batch import VariableReport

SENTINEL = -9.999
STYLE = """
body{font-family:sans-serif;margin:0}nav{position:fixed;inset:0 auto 0 0;width:230px;overflow:auto;padding:14px;background:#f2f4f7;font-size:12px}
main{margin-left:270px;padding:16px}table{border-collapse:collapse;font-size:12px}td,th{border:1px solid #ccd;padding:4px 8px}ol,ul{padding-left:18px}
"""


def scatter(points: list[dict], title: str = "", width: int = 560, height: int = 300) -> str:
    """An SVG of avg_target over x with markers scaled by weight."""
    pts = [p for p in points if p["avg_target"] is not None]
    numeric = [p for p in pts if p["x_num"] is not None]
    use = numeric or pts
    xs = [p["x_num"] for p in use] if numeric else list(range(len(use)))
    if not use:
        return f'<svg width="{width}" height="{height}" role="img"><text x="20" y="30">{html.escape(title)}</text></svg>'
    ys = [p["avg_target"] for p in use]

    def scale(v, low, high, a, b):
        return (a + b) / 2 if high == low else a + (v - low) * (b - a) / (high - low)

    marks = []
    for p, x, y in zip(use, xs, ys):
        cx, cy = scale(x, min(xs), max(xs), 60, width - 20), scale(y, min(ys), max(ys), height - 40, 30)
        marks.append(f'<circle cx="{cx:.1f}" cy="{cy:.1f}" r="{max(1.0, (p["size"] or 0) ** 0.5):.1f}" fill="#2a6fb0" fill-opacity="0.5"><title>{html.escape(str(p["x"]))}: {y:.4f}</title></circle>')
    axis = f'<line x1="50" y1="{height - 30}" x2="{width - 10}" y2="{height - 30}" stroke="#888"/><line x1="50" y1="20" x2="50" y2="{height - 30}" stroke="#888"/>'
    text = f'<text x="{width / 2:.0f}" y="14" text-anchor="middle">{html.escape(title)}</text><text x="{width / 2:.0f}" y="{height - 8}" text-anchor="middle">Bin</text><text x="12" y="{height / 2:.0f}" transform="rotate(-90 12 {height / 2:.0f})" text-anchor="middle">Avg Target</text>'
    ends = f'<text x="46" y="{height - 34}" text-anchor="end" font-size="10">{min(ys):.3f}</text><text x="46" y="34" text-anchor="end" font-size="10">{max(ys):.3f}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img">{axis}{text}{ends}{"".join(marks)}</svg>'


def two_series(table, title: str = "", width: int = 640, height: int = 320) -> str:
    """An SVG of a table of statistics: bars of each bin's share, and a line of its rate on an axis of its own."""
    from ..operators.scoring import without_total

    rows = without_total(table).orderBy("nr").select("bin", "pct_obs", "avg_target").collect()
    if not rows:
        return f'<svg width="{width}" height="{height}" role="img"><text x="20" y="30">{html.escape(title)}</text></svg>'
    share, rate = max((r["pct_obs"] or 0.0) for r in rows) or 1.0, max((r["avg_target"] or 0.0) for r in rows) or 1.0
    step, low, high = (width - 110) / len(rows), height - 40, height - 70
    bars, line = [], []
    for i, r in enumerate(rows):
        x, h = 55 + i * step, high * (r["pct_obs"] or 0.0) / share
        bars.append(f'<rect x="{x + step * 0.15:.1f}" y="{low - h:.1f}" width="{step * 0.7:.1f}" height="{h:.1f}" fill="#b9c7d8"><title>{html.escape(str(r["bin"]))}: {r["pct_obs"] or 0:.4f}</title></rect>')
        if r["avg_target"] is not None:
            line.append((x + step / 2, low - high * r["avg_target"] / rate, r))
    path = f'<polyline fill="none" stroke="#b0402a" stroke-width="1.5" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y, _ in line)}"/>'
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="#b0402a"><title>{html.escape(str(r["bin"]))}: {r["avg_target"]:.4f}</title></circle>' for x, y, r in line)
    text = f'<text x="{width / 2:.0f}" y="16" text-anchor="middle">{html.escape(title)}</text><text x="50" y="34" text-anchor="end" font-size="10">{share:.3f}</text><text x="{width - 50}" y="34" font-size="10" fill="#b0402a">{rate:.3f}</text>'
    axis = f'<line x1="55" y1="{low}" x2="{width - 55}" y2="{low}" stroke="#888"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img">{text}{axis}{"".join(bars)}{path}{dots}</svg>'


def tree_svg(tree, feature: str, width: int = 900) -> str:
    """An SVG of a tree: each node with its rows and rate, and the threshold it splits at."""
    spots, edges, depth = [], [], [0]

    def walk(node, left: float, right: float, level: int) -> tuple[float, float]:
        x, y = (left + right) / 2, 30 + 80 * level
        depth[0] = max(depth[0], level)
        rate = node.pos / node.n if node.n else 0.0
        label = f"{feature} &lt;= {node.threshold:.4g}" if node.left else "leaf"
        spots.append(f'<g><rect x="{x - 52:.1f}" y="{y - 16:.1f}" width="104" height="40" fill="#f2f4f7" stroke="#889"/><text x="{x:.1f}" y="{y:.1f}" text-anchor="middle" font-size="10">{label}</text><text x="{x:.1f}" y="{y + 14:.1f}" text-anchor="middle" font-size="10">n = {node.n}, {rate:.4f}</text></g>')
        for child, a, b in ((node.left, left, x), (node.right, x, right)):
            if child:
                cx, cy = walk(child, a, b, level + 1)
                edges.append(f'<line x1="{x:.1f}" y1="{y + 24:.1f}" x2="{cx:.1f}" y2="{cy - 16:.1f}" stroke="#889"/>')
        return x, y

    feature = html.escape(feature)
    walk(tree, 0, width, 0)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{80 + 80 * depth[0]}" role="img">{"".join(edges)}{"".join(spots)}</svg>'


def markdown(table) -> str:
    """A (small) table as Markdown."""
    def cell(v):
        return "" if v is None else (f"{v:.6g}" if isinstance(v, float) else str(v)).replace("|", "\\|")

    rows = [table.columns, ["---"] * len(table.columns), *([cell(v) for v in r] for r in table.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _cell(v) -> str:
    if v is None:
        return ""
    return html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))


def table_html(columns: list[str], rows) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f'<table class="table"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def variable_sections(report: dict[str, VariableReport]) -> tuple[str, str, str]:
    """The sections, the links by strength, and the links by name."""

    def strength(r):
        return SENTINEL if r.gini_binned is None else r.gini_binned

    sections, links = [], []
    for r in sorted(report.values(), key=lambda r: (-strength(r), r.variable)):
        name = html.escape(r.variable, quote=True)
        raw = SENTINEL if r.gini is None else r.gini
        parts = [f'<section id="{name}"><h2>{name}</h2>', table_html(["GINI", "GINI discrete"], [(raw, strength(r))]), table_html(r.table.columns, [tuple(x) for x in r.table.collect()])]
        if r.chart is not None:
            parts.append(scatter(r.chart, r.variable))
        sections.append("".join(parts) + "</section>")
        links.append((r.variable, f'<li title="{name}"><a href="#{name}">{name} ({round(strength(r) * 100, 1)})</a></li>'))
    return "\n".join(sections), "\n".join(x for _, x in links), "\n".join(x for _, x in sorted(links))


def page(content: str, by_strength: str, by_name: str, title: str = "Variable report") -> str:
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>'
        f"<nav><h3>By Gini</h3><ol>{by_strength}</ol><h3>By name</h3><ul>{by_name}</ul></nav><main><h1>{html.escape(title)}</h1>{content}</main></body></html>"
    )


def generate_report(report: dict[str, VariableReport]) -> str:
    return page(*variable_sections(report))


def save(text: str, filename: str) -> None:
    with open(filename, "w", encoding="utf-8") as f:
        f.write(text)
