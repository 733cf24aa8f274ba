"""Reports: small aggregated results as Markdown and CSV, on the driver.

A report is a layout, a list of columns each with its heading, its alignment
and how a row gives its text, put over rows that are a handful by their nature
(a row a model, a probe, a slot).  More rows than LIMIT are an error, never cut.
"""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import QUANT_ORDER, RECIPE_ORDER, place_in
from rankloom.sources.results import collected

LIMIT = 10_000
AXES = ("groundedness", "personalization", "ranking_coherence")

# --- fixed values: how numbers are written, which readers of the reports rely on ---

NONE = "--"


def absent(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def cell(value, csv_form: bool = False) -> str:
    """A table's cell: three digits, one from a thousand on; a dash (CSV: nothing) for None."""
    if value is None:
        return "" if csv_form else "—"
    return (f"{value:.3f}" if abs(value) < 1000 else f"{value:.1f}") if isinstance(value, float) else str(value)


def interval(mean, low, high, digits: int = 2, sign: bool = False) -> str:
    """mean [low, high]; dashes if one is missing."""
    form = f"{'+' if sign else ''}.{digits}f"
    return NONE if absent(mean, low, high) else f"{mean:{form}} [{low:{form}}, {high:{form}}]"


def correlation(r, p, n) -> str:
    return NONE if absent(r) else f"{r:+.2f} (p={math.nan if p is None else p:.3g}, n={n})"


def signed_rank(p, n_effective, error: str | None = None) -> str:
    """p of a signed-rank test, or why there is none."""
    return f"(n_eff={n_effective}; {error or 'no p'})" if p is None or math.isnan(p) else f"p={p:.3g} (n_eff={n_effective})"


# --- layouts ----------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """A column of a report: its heading, how a row gives its text, and whether numbers stand to the right."""

    heading: str
    text: Callable[[dict], str]
    right: bool = False


def plain(name: str, heading: str | None = None) -> Field:
    """A value as it is, a dash for none."""
    return Field(heading or name.replace("_", " "), lambda r: cell(r.get(name)))


def number(name: str, form: str = ".3f", heading: str | None = None) -> Field:
    """A number in a form; dashes for none and NaN."""
    return Field(heading or name.replace("_", " "), lambda r: NONE if absent(r.get(name)) else format(r[name], form), True)


def computed(heading: str, *names: str, by: Callable[..., str]) -> Field:
    """Text of several values of a row."""
    return Field(heading, lambda r: by(*[r.get(n) for n in names]))


def render(layout: list[Field], rows: Iterable[dict]) -> str:
    lines = [[f.heading for f in layout], ["---:" if f.right else "---" for f in layout], *[[f.text(r) for f in layout] for r in rows]]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def rows_of(df: DataFrame, *order: Any) -> list[dict]:
    return [r.asDict() for r in collected(df.orderBy(*order), LIMIT)]


def together(key: str, *tables: list[dict]) -> list[dict]:
    """Rows of several tables merged by a key, in the order in which the first tables have them."""
    merged: dict = {}
    for table in tables:
        for r in table:
            merged.setdefault(r[key], {}).update(r)
    return list(merged.values())


def spread(rows: list[dict], key: str, by: str, values: tuple[str, ...]) -> list[dict]:
    """One row a key: each value under the name value.by."""
    return together(key, [{k: v for k, v in r.items() if k not in values} | {f"{name}.{r[by]}": r[name] for name in values} for r in rows])


# --- runs --------------------------------------------------------------------------

METRICS = ["recall@1", "recall@5", "recall@10", "mrr@10", "ndcg@5", "ndcg@10"]
RUN = [*map(plain, ["tag", "recipe", "quant"]), *[Field(m, lambda r, m=m: cell(r.get(m)), True) for m in [*METRICS, "slot1_top1_rate", "kendall_tau_mean", "top1_agreement", "parse_rate", "ms_per_tok", "n"]]]


def ordered(runs: DataFrame) -> list[dict]:
    """Runs by recipe, quantization (both in their fixed order, others last) and tag."""
    return rows_of(runs, place_in(RECIPE_ORDER, F.col("recipe")), place_in(QUANT_ORDER, F.col("quant")), "tag")


def comparison(runs: DataFrame, deltas: DataFrame | None = None) -> str:
    """Runs (tag, recipe, quant and any of the metrics), then differences between runs (label, a, b, delta), if given."""
    text = render(RUN, ordered(runs))
    if deltas is not None:
        change = Field("change of recall@1", lambda r: cell(None) if r["delta"] is None else f"{r['delta']:+.3f}", True)
        text += "\n" + render([plain("label", "step"), plain("a", "from"), plain("b", "to"), change], rows_of(deltas, "label"))
    return text


def comparison_csv(runs: DataFrame) -> str:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(f.heading for f in RUN)
    w.writerows(["" if (text := f.text(r)) == cell(None) else text for f in RUN] for r in ordered(runs))
    return out.getvalue()


def summary(metrics: DataFrame) -> str:
    """Metrics of one run's rankings a line (name and the metrics): chance, teacher, student; agreement and parse rate where the table has them."""
    more = [f for f in ("top1_agreement", "kendall_tau_mean", "parse_rate") if f in metrics.columns]
    return render([plain("name", "ranking by"), *[number(m) for m in [*METRICS, *more]]], rows_of(metrics, "name"))


def latency(rows: DataFrame) -> str:
    """A backend a line: milliseconds a request and a token as median and 95th percentile, tokens, share of failures."""
    pair = lambda a, b, form: (lambda x, y: NONE if absent(x, y) else f"{x:{form}} / {y:{form}}")  # noqa: E731, ARG005
    layout = [
        plain("backend"), computed("ms, median / p95", "latency_p50", "latency_p95", by=pair("", "", ".1f")), computed("ms a token, median / p95", "per_tok_p50", "per_tok_p95", by=pair("", "", ".2f")),
        computed("tokens, mean (sd)", "tokens_mean", "tokens_std", by=lambda m, s: NONE if absent(m, s) else f"{m:.0f} ({s:.0f})"), number("failure_rate", ".1%", "failed"),
    ]
    return render(layout, rows_of(rows, "backend"))


# --- judge -------------------------------------------------------------------------


def judge(models: DataFrame, agreement: DataFrame | None = None) -> str:
    """judge.per_model rows, a line a model; then, if given, judge.agreement's: retrieval, correlations of all axes with recall@1 and MRR, lengths."""
    scores = spread(rows_of(models, "model_tag", "axis"), "model_tag", "axis", ("mean", "low", "high", "n"))
    ci = [computed(a.replace("_", " "), f"mean.{a}", f"low.{a}", f"high.{a}", by=interval) for a in AXES]
    text = render([plain("model_tag", "model"), number("n_scored", "d", "scored"), number("n_errors", "d", "errors"), *ci], scores)
    if agreement is None:
        return text
    found = together("model_tag", [{"model_tag": r["model_tag"], "n_paired": 0} for r in scores], rows_of(agreement, "model_tag"))
    parts = [number("n_paired", "d", "pairs"), *[number(k) for k in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr_mean")]]
    text += "\n" + render([plain("model_tag", "model"), *parts], found)
    against = [computed(f"{a.replace('_', ' ')} and {name}", *[f"{a}_vs_{k}{end}" for end in ("", "_p", "_n")], by=correlation) for k, name in (("hit1", "recall@1"), ("mrr", "MRR")) for a in AXES]
    text += "\n" + render([plain("model_tag", "model"), *against], found)
    lengths = [number(f"{what}_{k}", ".0f") for what in ("chars", "tokens") for k in ("mean", "p50", "p95", "max")]
    return text + "\n" + render([plain("model_tag", "model"), *lengths], found)


def validation(probes: DataFrame, baseline: DataFrame | None = None) -> str:
    """The baseline's scores (axis, n, mean, low, high), if given; then validation rows, a line a probe and axis, one for all axes of a probe without pairs."""
    text = "" if baseline is None else render([plain("axis"), number("n", "d", "verdicts"), computed("mean and interval", "mean", "low", "high", by=interval)], rows_of(baseline, "axis")) + "\n"
    rows = rows_of(probes, "probe", "axis")
    empty = {p for p in (r["probe"] for r in rows) if not any(r["n"] for r in rows if r["probe"] == p)}
    shown = [r for r in rows if r["probe"] not in empty] + [{"probe": p, "axis": "all", "n": 0, "label": "missing"} for p in sorted(empty)]
    layout = [
        plain("probe"), plain("axis"), number("n", "d", "pairs"), computed("mean change and interval", "mean", "low", "high", by=lambda m, a, b: interval(m, a, b, sign=True)), number("expected", "+.2f", "expected at most"),
        number("rate", ".0%", "lowered"), Field("signed ranks", lambda r: signed_rank(r["p_value"], r["n_effective"], r["error"]) if r["n"] else NONE), plain("label", "finding"),
    ]
    return text + render(layout, sorted(shown, key=lambda r: (r["probe"], r["axis"])))


# --- position bias -------------------------------------------------------------------


def slots(described: DataFrame, key: str) -> str:
    """Rows of bias.described: a line a slot with a column of percents a group, then each group's test and extremes."""
    groups = rows_of(described, key)
    percents = [Field(f"{g[key]} (n={g['n_total']})", lambda r, g=g: f"{g['percent'][r['slot'] - 1]:.2f}%", True) for g in groups]
    k = max((len(g["counts"]) for g in groups), default=0)
    test = [plain(key), number("chi2", ".3f", "chi-square"), number("df", "d"), number("p", ".4g"), plain("verdict"), number("argmax", "d", "most chosen"), number("argmin", "d", "least chosen")]
    return render([plain("slot"), *percents], [{"slot": i + 1} for i in range(k)]) + "\n" + render(test, groups)


def recall_by_slot(rows: DataFrame) -> str:
    """Rows of bias.recall_by_slot, best slot first; slots without support come last."""
    best = F.col("recall").desc_nulls_last()
    return render([plain("slot"), number("support", "d"), number("recall", ".4f", "recall@1")], rows_of(rows, best, "slot"))
