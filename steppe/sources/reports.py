"""Report sinks: small tables as Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def signed(value, digits: int = 3) -> str:
    return "n/a" if value is None else f"{value:+.{digits}f}"


def plain(value, digits: int = 4) -> str:
    if value is None:
        return "n/a"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def significance(row: dict) -> str:
    """The p-values of a paired test in words; what is undefined is n/a."""
    if row.get("identical"):
        return "identical series"
    n = row.get("n_pairs", row.get("n_dates"))
    if row.get("p_t") is None and row.get("p_wilcoxon") is None:
        return f"not tested (n = {plain(n)})"
    tests = ", ".join(f"{name} {plain(row.get(key), 3)}" for name, key in (("t", "p_t"), ("Wilcoxon", "p_wilcoxon"), ("sign", "p_sign")))
    return f"{tests} (n = {plain(n)}, r1 = {plain(row.get('lag1_r'), 2)})"


def markdown_table(rows: DataFrame | list[dict], columns: list[str], skill: tuple[str, ...] = (), notes: list[str] = ()) -> str:
    """A table with signs on skill columns, n/a for nulls and footnotes."""
    data = [r.asDict() for r in rows.collect()] if isinstance(rows, DataFrame) else rows
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for row in data:
        lines.append("| " + " | ".join(signed(row[c]) if c in skill else plain(row[c]) for c in columns) + " |")
    return "\n".join([*lines, "", *[f"[{i}] {n}" for i, n in enumerate(notes, 1)]]) + "\n"


def skill_report(tables: dict[str, DataFrame | list[dict]], population: int, title: str = "Skill", notes: list[str] = ()) -> str:
    """The whole report: a section for each target table, with its scores, skill and paired tests.

    ``tables``: by a name that says what is forecast, the rows of
    ``evaluation.target_table``, a handful each. Dates on which a metric is not
    defined are footnotes; the three tests stand side by side and none is preferred.
    """
    lines = [f"# {title}", "", f"{population:,} cells. Skill is one minus the model's score over the baseline's: positive where the model is better.", ""]
    for name, table in tables.items():
        rows = [r.asDict() for r in table.collect()] if isinstance(table, DataFrame) else table
        rows = sorted(rows, key=lambda r: (r["method"] != "model", r["method"]))
        known = [c for c in ("brier", "auc", "mae", "rmse", "r2") if rows and c in rows[0]]
        skill = [c for c in (rows[0] if rows else ()) if c.startswith("model_skill_") or c.endswith("_difference") and c != "mean_difference"]
        shown, feet = [], []
        for row in rows:
            cells = {"method": row["method"], "n_dates": row["n_dates"], **{c: row[c] for c in skill}}
            for c in known:
                cells[c] = plain(row[c])
                if row.get(f"{c}_undefined"):
                    feet.append(f"{row['method']}: {c} is not defined on {row[f'{c}_undefined']} dates.")
                    cells[c] += f" [{len(feet)}]"
            cells["paired tests"] = "" if row["method"] == "model" else significance(row)
            shown.append(cells)
        lead = f", {rows[0]['lead_months']} months ahead" if rows and rows[0].get("lead_months") is not None else ""
        lines += [f"## {name}{lead}", "", markdown_table(shown, ["method", "n_dates", *known, *skill, "paired tests"], tuple(skill), feet)]
    return "\n".join([*lines, *[f"* {n}" for n in notes]]).rstrip("\n") + "\n"
