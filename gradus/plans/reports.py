"""Reports of small results, written on the driver: Markdown, JSON, and a page of tables and lines."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(frame: DataFrame, most: int = 10_000) -> list[dict]:
    """Rows as dicts; refuses frames that aren't small."""
    got = [r.asDict(recursive=True) for r in frame.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a report of over {most} rows")
    return got


def _cell(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    out = [f"# {title}"]
    for name, frame in sections.items():
        rows = rows_of(frame)
        out += ["", f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
        out += ["| " + " | ".join(_cell(r[c]).replace("|", "\\|") for c in frame.columns) + " |" for r in rows]
    return "\n".join(out) + "\n"


def line(values: list[float], width: int = 320, height: int = 80) -> str:
    """An inline SVG line over a scale that begins at 0 or below."""
    if not values:
        return ""
    low, high = min(0.0, *values), max([*values, 1e-9])
    at = [(i * width / max(1, len(values) - 1), height - (v - low) / (high - low or 1) * height) for i, v in enumerate(values)]
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="currentColor" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in at)}"/></svg>'


def bars(values: list[tuple[str, float]], width: int = 320, row: int = 24) -> str:
    """Inline SVG bars with labels and numbers; negative ones go left from the axis, lengths are relative to the greatest."""
    most, mid = max([*(abs(v) for _, v in values), 1e-9]), width / 2
    out = [f'<svg width="{2 * width}" height="{row * len(values)}">']
    for i, (label, v) in enumerate(values):
        long = abs(v) / most * mid
        out.append(f'<text x="0" y="{(i + 0.7) * row:.1f}">{html.escape(label)}</text><rect x="{width + (0 if v >= 0 else -long):.1f}" y="{i * row + 3}" width="{long:.1f}" height="{row - 6}"/><text x="{1.55 * width:.1f}" y="{(i + 0.7) * row:.1f}">{v:.4g}</text>')
    return "".join(out) + "</svg>"


def comparisons(reports: dict[str, dict[str, DataFrame]]) -> str:
    """A section about paired comparisons, by label, of frames as paired.compare makes: a row of figures
    each, bars of the differences in points, and the tasks where the systems differ."""
    figures, flips = [], []
    for label, r in reports.items():
        e, m, p, b = (r[k].first().asDict() for k in ("effects", "mcnemar", "permutation", "bootstrap"))  # one row each
        figures.append({"comparison": label, "tasks": e["tasks"], "base": e["base_rate"], "candidate": e["candidate_rate"], "points": e["delta_points"], "mcnemar_p": m["p_value"], "permutation_p": p["p_value"], "low_points": 100 * b["low"] if b["low"] is not None else None, "high_points": 100 * b["high"] if b["high"] is not None else None, "error_reduction": e["error_reduction"]})
        flips += [{"comparison": label, **f} for f in rows_of(r["outcomes"].where("base_passed <> candidate_passed").selectExpr("*", "CAST(candidate_passed AS INT) - CAST(base_passed AS INT) AS delta").orderBy("task_id"))]
    out = ["<h2>Paired comparisons</h2>", _rows(figures), bars([(f["comparison"], f["points"] or 0.0) for f in figures])]
    return "\n".join(out + (["<h3>Tasks that differ</h3>", _rows(flips)] if flips else []))


def _rows(rows: list[dict]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in (rows[0] if rows else ()))
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def runs(frame: DataFrame, best: DataFrame | None = None) -> str:
    """A Markdown table of experiment runs, by ord, with the chosen one, told by its slug, marked."""
    chosen = {r["slug"] for r in rows_of(best.select("slug"))} if best is not None else set()
    rows = [{"selected": "yes" if r["slug"] in chosen else "", **r} for r in rows_of(frame.orderBy("ord").drop("ord"))]
    if not rows:
        return "| selected |\n| --- |\n"
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(_cell(v).replace("|", "\\|") for v in r.values()) + " |" for r in rows)]) + "\n"


def trace(made: DataFrame, task_id: str | None = None) -> str:
    """A trace as Markdown: that of the task, or the first by task and sample, also if the task has none."""
    order = ([F.desc(F.col("task_id") == task_id)] if task_id is not None else []) + [F.col("task_id"), F.col("sample_index")]
    if (t := made.orderBy(*order).limit(1).first()) is None:
        raise ValueError("there are no traces")
    revisions, calls = sum(s.kind == "revision" for s in t.steps), sum(s.ok is not None for s in t.steps)
    out = ["# Agent Trace", "", f"- Task: {t.task_id}", f"- Final passed: {t.passed}", f"- Revisions: {revisions}", f"- Tool calls: {calls}", f"- Reward: {(t.reward.reward if t.reward else None) or 0.0:.4f}", "", "## Steps", ""]
    for n, s in enumerate(t.steps, 1):
        out += [f"### {n}. {s.kind}", *(["", s.observation] if s.observation else []), *(["", "```python", s.code.strip(), "```"] if s.code else []), ""]
    return "\n".join(out)


def read(path: str) -> dict:
    """One report that write or another tool has left as JSON."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} holds no JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def page(title: str, sections: dict[str, DataFrame], curves: dict[str, list[float]] | None = None) -> str:
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, frame in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in frame.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r[c]))}</td>" for c in frame.columns) + "</tr>" for r in rows_of(frame))
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    out += [f"<h2>{html.escape(n)}</h2>{line(v)}" for n, v in (curves or {}).items()]
    return "\n".join(out)


def write(path: str, title: str, sections: dict[str, DataFrame], curves: dict[str, list[float]] | None = None) -> None:
    """By suffix: .json, .html, else Markdown."""
    if path.endswith(".json"):
        body = json.dumps({"title": title, **{n: rows_of(f) for n, f in sections.items()}}, sort_keys=True, indent=2, default=str)
    else:
        body = page(title, sections, curves) if path.endswith(".html") else markdown(title, sections)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(body, encoding="utf-8")
