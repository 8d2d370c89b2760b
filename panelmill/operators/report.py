"""A self-contained HTML report of small evidence tables, byte-identical for identical input."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 10_000
# What a report must not contain, in lower case, and what it must.
FORBIDDEN = ("http://", "https://", "<script src=", "<link ", "<img ", "@import")
REQUIRED = ("<style>", "<svg", "Executive conclusion", "Evidence inventory")


def small_rows(df: DataFrame, order: list[str]) -> list[dict[str, Any]]:
    """Rows of an evidence table in order; more than REPORT_ROWS is an error."""
    rows = df.orderBy(*order).limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("table is too long for a report")
    return [r.asDict() for r in rows]


def format_value(value: Any, precision: int = 6) -> str:
    """Yes or No, thousands in integers, fixed precision; nothing for missing and non-finite numbers."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "Yes" if value else "No"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"{value:,.{precision}f}" if math.isfinite(value) else ""
    return str(value)


def title(column: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in column.split("_"))


def render_table(rows: Sequence[dict[str, Any]], columns: Sequence[str], labels: dict[str, str] | None = None, precision: int = 6, css: str = "evidence") -> str:
    """Rows as an escaped HTML table; every column must be there."""
    if rows and (missing := sorted(set(columns) - set(rows[0]))):
        raise ValueError(f"table lacks columns: {missing}")
    cell = lambda x: html.escape(x, quote=True)
    head = "".join(f"<th>{cell((labels or {}).get(c, title(c)))}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(format_value(r[c], precision))}</td>" for c in columns) + "</tr>" for r in rows)
    return f'<table class="{cell(css)}"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def render_bars(rows: Sequence[dict[str, Any]], label: str, value: str, heading: str, suffix: str = "", precision: int = 3) -> str:
    """Horizontal bars to both sides of zero, as inline SVG."""
    values = [float(r[value]) for r in rows]
    if not values or not all(map(math.isfinite, values)):
        raise ValueError("a chart needs finite values")
    reach, step = max(map(abs, values)) or 1.0, 26
    height, mid, half = 40 + step * len(rows), 360.0, 200.0
    parts = [f'<text x="8" y="20" class="heading">{html.escape(heading)}</text>', f'<line x1="{mid:g}" y1="30" x2="{mid:g}" y2="{height}" stroke="#888"/>']
    for i, (r, v) in enumerate(zip(rows, values)):
        y, w = 36 + step * i, abs(v) / reach * half
        x = mid if v >= 0 else mid - w
        parts.append(f'<text x="8" y="{y + 12}">{html.escape(str(r[label]))}</text>')
        parts.append(f'<rect x="{x:.2f}" y="{y}" width="{w:.2f}" height="16" fill="{"#2f6f9f" if v >= 0 else "#b4553f"}"/>')
        parts.append(f'<text x="{mid + half + 8:g}" y="{y + 12}">{v:.{precision}f}{html.escape(suffix)}</text>')
    return f'<svg viewBox="0 0 680 {height}" role="img" aria-label="{html.escape(heading, quote=True)}">{"".join(parts)}</svg>'


def best_row(df: DataFrame, metric: str, name: str = "model"):
    """Name and value of the largest metric, the first name among equals: one aggregate."""
    order = F.struct((-F.col(metric)).alias("m"), F.col(name))
    return df.where(F.col(metric).isNotNull()).agg(F.min_by(F.struct(name, metric), order).alias("x")).select("x.*").first()


def best_per_group(df: DataFrame, by: list[str], metric: str, name: str = "model") -> DataFrame:
    """The name with the largest metric in each group, the first name among equals."""
    order = F.struct((-F.col(metric)).alias("m"), F.col(name))
    return df.groupBy(*by).agg(F.min_by(name, order).alias(name), F.max(metric).alias(metric))


def key_findings(
    oos: DataFrame, break_even: DataFrame, bootstrap: DataFrame, focus: float, portfolio_bootstrap: DataFrame | None = None, ablations: DataFrame | None = None,
    references: Sequence[str] = ("momentum", "reversal"), families: dict[str, str] | None = None,
) -> list[dict[str, Any]]:
    """The findings that the tables support, one record each; each is one small aggregate.

    ``references`` are models that are not learned.  ``portfolio_bootstrap`` has
    probability_break_even_above_focus_cost, ``ablations`` variant and mean_rank_ic_delta_vs_full per model.
    """
    out: list[dict[str, Any]] = []

    def say(finding: str, model: str | None, value: Any, unit: str, variant: str = "") -> None:
        out.append({"finding": finding, "model": model, "variant": variant, "value": value, "unit": unit})

    ic, be = best_row(oos, "mean_rank_ic"), best_row(break_even, "pooled_break_even_cost_bps")
    say("highest mean rank IC", ic[0], ic[1], "IC")
    learned = best_row(oos.where(~F.col("model").isin(*references)), "mean_rank_ic")
    if learned[0] is not None:
        say("highest mean rank IC of a learned model", learned[0], learned[1], "IC", (families or {}).get(learned[0], ""))
    say("highest pooled break-even cost", be[0], be[1], "bps")
    above = break_even.agg(F.count_if(F.col("pooled_break_even_cost_bps") > focus).alias("n"), F.count("*").alias("all")).first()
    say(f"models that break even above {focus:g} bps", None, above["n"], f"of {above['all']}")
    sure = bootstrap.where("confidence_lower > 0").agg(F.countDistinct("model").alias("n"), F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("names")).first()
    say("models with an interval above zero", sure["names"], sure["n"], "models")
    if portfolio_bootstrap is not None and (row := best_row(portfolio_bootstrap, "probability_break_even_above_focus_cost"))[0] is not None:
        say("highest frequency of break-even above the focus cost", row[0], row[1], "frequency")
    if ablations is not None:
        loss = F.struct(F.col("mean_rank_ic_delta_vs_full").alias("d"), F.col("model"), F.col("variant"))
        row = ablations.where("variant <> 'full' and mean_rank_ic_delta_vs_full is not null").agg(F.min(loss).alias("x")).select("x.*").first()
        if row and row["model"] is not None:
            say("largest loss of mean rank IC without a feature family", row["model"], row["d"], "IC", row["variant"])
    return out


def build_report(heading: str, sections: Sequence[tuple[str, str]]) -> str:
    """Sections of (title, HTML) as one page."""
    style = "body{font:15px/1.5 sans-serif;margin:2rem auto;max-width:70rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem;text-align:right}svg{max-width:44rem}"
    body = "".join(f"<section><h2>{html.escape(t)}</h2>{content}</section>" for t, content in sections)
    page = f"<!doctype html>\n<html lang=\"en\"><head><meta charset=\"utf-8\"><title>{html.escape(heading)}</title><style>{style}</style></head><body><h1>{html.escape(heading)}</h1>{body}</body></html>\n"
    require_self_contained(page)
    return page


def require_self_contained(page: str) -> None:
    low = page.lower()
    if found := [t for t in FORBIDDEN if t in low]:
        raise ValueError(f"report refers to something outside: {found}")
    if missing := [t for t in REQUIRED if t not in page]:
        raise ValueError(f"report lacks: {missing}")


# The headings of a research report in order; beside each the evidence tables it shows, where they are given.
SECTIONS: list[tuple[str, list[str]]] = [
    ("Executive conclusion", []),
    ("Key findings", []),
    ("Research design", ["fold_summary", "alignment_split_metrics"]),
    ("Frozen model evidence", ["oos_model_metrics", "portfolio_summary", "break_even_model_summary", "bootstrap_prediction_summary", "bootstrap_portfolio_summary", "null_test_summary"]),
    ("Trading frequency and breadth", ["rebalance_cadence_summary", "breadth_break_even"]),
    ("Holding-horizon sensitivity", ["horizon_model_metrics", "horizon_break_even"]),
    ("Fold and monthly stability", ["stability_model_summary"]),
    ("Symbol dependence", ["symbol_dependence_model_summary"]),
    ("Causal market regimes", ["regime_model_summary"]),
    ("Feature-family ablations", ["ablation_feature_summary", "ablation_model_summary"]),
    ("Limitations", []),
    ("Evidence inventory", []),
]


def conclusion(findings: Sequence[dict[str, Any]], focus: float) -> str:
    """One paragraph from the findings."""
    by = {f["finding"]: f for f in findings}
    best, cost = by.get("highest mean rank IC"), by.get("highest pooled break-even cost")
    parts = []
    if best:
        parts.append(f"The highest out-of-sample mean rank IC is {format_value(best['value'])} ({best['model']}).")
    if cost:
        side = "above" if cost["value"] is not None and cost["value"] > focus else "not above"
        parts.append(f"The highest pooled break-even cost is {format_value(cost['value'], 3)} bps ({cost['model']}), {side} the focus cost of {focus:g} bps.")
    return "<p>" + html.escape(" ".join(parts)) + "</p>"


def research_report(
    heading: str, tables: dict[str, DataFrame], findings: Sequence[dict[str, Any]], focus: float, limitations: Sequence[str] = (),
    inventory: Sequence[dict[str, Any]] = (), charts: dict[str, tuple[str, str]] | None = None,
) -> str:
    """The twelve sections of a study's report from its evidence tables; rows are shown in the order of their leading columns."""
    pictures = {"oos_model_metrics": ("model", "mean_rank_ic"), "break_even_model_summary": ("model", "pooled_break_even_cost_bps")} | (charts or {})
    told = {
        "Executive conclusion": conclusion(findings, focus),
        "Key findings": render_table(list(findings), ["finding", "model", "variant", "value", "unit"]),
        "Limitations": "<ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in limitations) + "</ul>",
        "Evidence inventory": render_table(list(inventory), ["path", "bytes", "sha256"]),
    }
    sections = []
    for title_, names in SECTIONS:
        content = told.get(title_, "")
        for name in (n for n in names if n in tables):
            df = tables[name]
            rows = small_rows(df, [c for c, t in df.dtypes if t in ("string", "int", "bigint", "timestamp_ntz")] or df.columns[:1])
            content += f"<h3>{html.escape(title(name))}</h3>" + render_table(rows, df.columns)
            if name in pictures and rows:
                shown = [r for r in rows if r[pictures[name][1]] is not None]
                content += render_bars(shown, *pictures[name], heading=title(pictures[name][1])) if shown else ""
        sections.append((title_, content or "<p>No evidence was given for this section.</p>"))
    return build_report(heading, sections)
