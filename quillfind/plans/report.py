"""Tables, analysis text and charts from small collected result tables: Markdown and one self-contained HTML page."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame

Metrics = dict[str, dict[tuple[str, int], float]]


def collected(metrics: DataFrame) -> Metrics:
    """pipeline -> (metric, k) -> value, from the long table (a few rows per pipeline)."""
    out: Metrics = {}
    for r in metrics.collect():
        out.setdefault(r["pipeline"], {})[r["metric"], r["k"]] = r["value"]
    return out


def by_ndcg(m: Metrics, k: int = 10) -> list[str]:
    return sorted(m, key=lambda p: (-m[p].get(("ndcg", k), 0.0), p))


def metric_table(m: Metrics, metric: str, ks: tuple[int, ...], title: str, bold_k: int | None = None) -> str:
    best = max((v.get((metric, bold_k), 0.0) for v in m.values()), default=0.0)
    lines = [f"| Pipeline | {' | '.join(f'{title}@{k}' for k in ks)} |", "|---" * (len(ks) + 1) + "|"]
    for p in by_ndcg(m):
        cells = []
        for k in ks:
            v = m[p].get((metric, k), 0.0)
            cells.append(f"**{v:.4f}**" if k == bold_k and v == best > 0 else f"{v:.4f}")
        lines.append(f"| {p} | {' | '.join(cells)} |")
    return "\n".join(lines)


def significance_table(rows: list[dict]) -> str:
    if not rows:
        return "*No significance tests.*"
    lines = ["| Pair | Difference | Bootstrap p | t-test p | Significant |", "|---|---|---|---|---|"]
    # Without any variance there is no t statistic.
    number = lambda x: "-" if x is None or math.isnan(x) else f"{x:.4f}"
    lines += [f"| {r['pipeline_a']} / {r['pipeline_b']} | {number(r['observed_diff'])} | {number(r['p_value'])} | {number(r['t_p'])} | {'yes' if r['significant'] else 'no'} |" for r in rows]
    return "\n".join(lines)


def timing_table(timings: list[dict]) -> str:
    if not timings:
        return "*No timings.*"
    least = min(t["total_s"] for t in timings)
    lines = ["| Pipeline | Index s | Query s | Total s | ms per query | Relative |", "|---|---|---|---|---|---|"]
    for t in sorted(timings, key=lambda t: t["total_s"]):
        each = f"{t['per_query_ms']:.1f}" if t["per_query_ms"] is not None else "-"
        lines.append(f"| {t['pipeline']} | {t['index_s']:.1f} | {t['query_s']:.1f} | {t['total_s']:.1f} | {each} | {t['total_s'] / least if least > 0 else 1:.1f}x |")
    return "\n".join(lines)


def analysis(m: Metrics, timings: list[dict], tests: list[dict]) -> str:
    order = by_ndcg(m)
    if not order:
        return "No results."
    best, worst = (m[p].get(("ndcg", 10), 0.0) for p in (order[0], order[-1]))
    lines = [f"- Best: `{order[0]}`, nDCG@10 {best:.4f}", f"- Worst: `{order[-1]}`, nDCG@10 {worst:.4f}"]
    if worst > 0:
        lines.append(f"- Best over worst: {100 * (best - worst) / worst:+.1f} %")
    if timings:
        fast, slow = min(timings, key=lambda t: t["total_s"]), max(timings, key=lambda t: t["total_s"])
        lines.append(f"- Fastest: `{fast['pipeline']}` ({fast['total_s']:.1f} s); slowest: `{slow['pipeline']}` ({slow['total_s']:.1f} s)")
    if tests:
        lines.append(f"- Significant pairs: {sum(bool(t['significant']) for t in tests)} of {len(tests)}")
    return "\n".join(lines)


def report(m: Metrics, timings: list[dict], tests: list[dict], title: str = "Retrieval report") -> str:
    """The whole report in Markdown."""
    parts = [("nDCG", metric_table(m, "ndcg", (1, 3, 5, 10, 100), "nDCG", 10)), ("Recall", metric_table(m, "recall", (1, 5, 10), "Recall")), ("Significance", significance_table(tests)), ("Timings", timing_table(timings)), ("Findings", analysis(m, timings, tests))]
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{body}" for name, body in parts) + "\n"


def _svg(body: str, width: int, height: int) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" font-family="sans-serif" font-size="12">{body}</svg>'


def bar_chart(values: dict[str, float], label: str) -> str:
    """Horizontal bars on a common scale, the value at each end."""
    top, rows = max(values.values(), default=0) or 1, []
    for k, (name, v) in enumerate(values.items()):
        y, w = 30 + 24 * k, 360 * v / top
        rows.append(f'<text x="190" y="{y + 13}" text-anchor="end">{html.escape(name)}</text><rect x="200" y="{y}" width="{w:.1f}" height="16" rx="3" fill="#3b6fb6"/><text x="{206 + w:.1f}" y="{y + 13}">{v:.4f}</text>')
    return _svg(f'<text x="10" y="16" font-weight="bold">{html.escape(label)}</text>' + "".join(rows), 640, 40 + 24 * len(values))


PALETTE = ("#3b6fb6", "#c8553d", "#4d8b57", "#8a5fa3", "#b8860b", "#2a8c8c")


def grouped_bar_chart(m: Metrics, axes: list[tuple[str, int]], label: str) -> str:
    """For every pipeline a group of upright bars, one per metric, all between 0 and 1."""
    order = by_ndcg(m)
    if not order or not axes:
        return ""
    step = 14 * len(axes) + 26
    body = f'<text x="10" y="16" font-weight="bold">{html.escape(label)}</text><line x1="40" y1="250" x2="{50 + step * len(order)}" y2="250" stroke="#888"/>'
    for v in (0.25, 0.5, 0.75, 1.0):
        body += f'<text x="34" y="{254 - 200 * v:.0f}" text-anchor="end">{v:g}</text><line x1="40" y1="{250 - 200 * v:.0f}" x2="{50 + step * len(order)}" y2="{250 - 200 * v:.0f}" stroke="#eee"/>'
    for i, p in enumerate(order):
        x = 50 + step * i
        for j, axis in enumerate(axes):
            h = 200 * m[p].get(axis, 0.0)
            body += f'<rect x="{x + 14 * j}" y="{250 - h:.1f}" width="12" height="{h:.1f}" rx="2" fill="{PALETTE[j % 6]}"><title>{html.escape(p)} {axis[0]}@{axis[1]}: {m[p].get(axis, 0.0):.4f}</title></rect>'
        body += f'<text x="{x}" y="266" transform="rotate(30 {x} 266)">{html.escape(p)}</text>'
    for j, (name, n) in enumerate(axes):
        body += f'<rect x="{60 + 110 * j}" y="24" width="10" height="10" fill="{PALETTE[j % 6]}"/><text x="{74 + 110 * j}" y="33">{name}@{n}</text>'
    return _svg(body, max(640, 90 + step * len(order) + 60), 360)


def radar_chart(m: Metrics, axes: list[tuple[str, int]], label: str) -> str:
    """One outline per pipeline over three or more metrics; empty with fewer."""
    if len(axes) < 3 or not m:
        return ""
    at = lambda k, r: (220 + r * math.sin(2 * math.pi * k / len(axes)), 190 - r * math.cos(2 * math.pi * k / len(axes)))
    body = f'<text x="10" y="16" font-weight="bold">{html.escape(label)}</text>'
    for k, (name, n) in enumerate(axes):
        (x, y), (tx, ty) = at(k, 140), at(k, 160)
        body += f'<line x1="220" y1="190" x2="{x:.1f}" y2="{y:.1f}" stroke="#ccc"/><text x="{tx:.1f}" y="{ty:.1f}" text-anchor="middle">{name}@{n}</text>'
    for i, p in enumerate(by_ndcg(m)):
        points = " ".join("%.1f,%.1f" % at(k, 140 * m[p].get(a, 0.0)) for k, a in enumerate(axes))
        body += f'<polygon points="{points}" fill="none" stroke="{PALETTE[i % 6]}" stroke-width="2"/><text x="420" y="{40 + 18 * i}" fill="{PALETTE[i % 6]}">{html.escape(p)}</text>'
    return _svg(body, 640, 360)


def scatter_chart(points: dict[str, tuple[float, float]], label: str, xs: str, ys: str) -> str:
    top_x, top_y = max((p[0] for p in points.values()), default=0) or 1, max((p[1] for p in points.values()), default=0) or 1
    body = f'<text x="10" y="16" font-weight="bold">{html.escape(label)}</text><line x1="50" y1="300" x2="600" y2="300" stroke="#888"/><line x1="50" y1="30" x2="50" y2="300" stroke="#888"/><text x="325" y="330" text-anchor="middle">{html.escape(xs)}</text><text x="8" y="26">{html.escape(ys)}</text>'
    for name, (x, y) in points.items():
        a, b = 50 + 520 * x / top_x, 300 - 250 * y / top_y
        body += f'<circle cx="{a:.1f}" cy="{b:.1f}" r="5" fill="#3b6fb6"/><text x="{a + 8:.1f}" y="{b + 4:.1f}">{html.escape(name)}</text>'
    return _svg(body, 640, 340)


def dashboard(m: Metrics, timings: list[dict], tests: list[dict], title: str = "Retrieval dashboard") -> str:
    """One HTML page with charts and tables."""
    bars = bar_chart({p: m[p].get(("ndcg", 10), 0.0) for p in by_ndcg(m)}, "nDCG@10")
    radar = radar_chart(m, [("ndcg", 10), ("map", 10), ("recall", 10), ("precision", 10)], "Metrics")
    groups = grouped_bar_chart(m, [("ndcg", 10), ("map", 10), ("recall", 10), ("precision", 10)], "Metrics by pipeline")
    spots = {t["pipeline"]: (t["total_s"], m.get(t["pipeline"], {}).get(("ndcg", 10), 0.0)) for t in timings}
    cells = lambda rows: "".join("<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in r) + "</tr>" for r in rows)
    table = cells([[r["pipeline_a"], r["pipeline_b"], f"{r['observed_diff']:.4f}", f"{r['p_value']:.4f}", "yes" if r["significant"] else "no"] for r in tests])
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font-family:sans-serif;margin:2em}}td{{padding:.2em .8em}}</style></head><body><h1>{html.escape(title)}</h1>{bars}{groups}{radar}{scatter_chart(spots, "Quality and time", "seconds", "nDCG@10") if spots else ""}<h2>Significance</h2><table>{table}</table></body></html>'
