"""Declarative spend analysis: a spec over the analysis frame gives a table and a one-row summary, both lazy.

Facts are read once: current and comparison rows are tagged, grouped by side and labels with map-side partial sums,
and everything after that (folding, grids, shares, totals, transforms) works on the grouped rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions.categories import is_analyzed
from outlay.functions.money import by_unit, inflow, outflow
from outlay.operators import periods
from outlay.operators.filters import apply_filters, in_months, within
from outlay.operators.series import largest_step, transformed
from outlay.plans.spec import (
    ADDITIVE,
    CATEGORICAL,
    DIMENSION_LABELS,
    DISPLAY_COLUMNS,
    MAX_SERIES,
    METRIC_DEFINITIONS,
    METRIC_LABELS,
    ORDERED,
    OTHER,
    TRANSFORM_LABELS,
    UNIT_SUFFIX,
    AnalysisSpec,
    unit_of,
)

SUMS = ("net", "gross", "refunds", "count")


@dataclass(frozen=True)
class Context:
    """``today`` plus the data's date range; left out, the range is measured from the frame."""

    today: date
    data_min: date | None = None
    data_max: date | None = None
    focus_month: date | None = None


@dataclass
class Analysis:
    spec: AnalysisSpec
    table: DataFrame
    value_column: str
    unit: str
    grouped: DataFrame
    period: periods.Period
    compared: periods.Comparison | None
    notes: list[str]
    summary: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached grouped rows."""
        self.grouped.unpersist()


def resolved_period(frame: DataFrame, spec: AnalysisSpec, ctx: Context) -> tuple:
    """(period, comparison or None) as literals.

    Two dates decide the whole plan, so they are read first (one row: the given data dates, or a min/max scan of
    one column). Literal dates let every later filter prune partitions and row groups.
    """
    if ctx.data_min and ctx.data_max:
        bounds = frame.sparkSession.range(1).select(
            cal.day(ctx.data_min).alias("data_min"), cal.day(ctx.data_max).alias("data_max")
        )
    else:
        bounds = frame.agg(F.min("transaction_date").alias("data_min"), F.max("transaction_date").alias("data_max"))
    ask = periods.Ask(spec.period, spec.date_from, spec.date_to, ctx.focus_month)
    found = periods.resolve(bounds, ctx.today, [ask]).first()
    notes = F.array(*map(F.lit, found.notes)).cast("array<string>")
    period = periods.Period(F.lit(found.start), F.lit(found.end), F.lit(found.label), notes)
    if spec.compare_to == "none":
        return period, None
    c = periods.comparison(period.start, period.end, spec.compare_to)
    names = ("start", "end", "label", "months", "days")
    values = frame.sparkSession.range(1).select(*[getattr(c, n).alias(n) for n in names]).first()
    return period, periods.Comparison(*[F.lit(values[n]) for n in names])


def _labels(dims: tuple[str, ...], day: Column) -> dict[str, Column]:
    return {d: F.col(d).cast("string") if d in CATEGORICAL else cal.dimension_label(d, day) for d in dims}


def grouped_sums(
    frame: DataFrame, spec: AnalysisSpec, period: periods.Period, compared: periods.Comparison | None
) -> DataFrame:
    """Sums by side (cur, cmp) and dimension labels; a comparison day is labelled where it lands after shifting."""
    rows = apply_filters(frame.where(is_analyzed()), spec.filters)
    d = F.col("transaction_date")
    current = within(d, period.start, period.end)
    if "month" in frame.columns:
        months = in_months(period.start, period.end)
        rows = rows.where(months if compared is None else months | in_months(compared.start, compared.end))
    if compared is None:
        rows = rows.where(current).withColumn("_side", F.lit("cur")).withColumn("_day", d)
    else:
        before = within(d, compared.start, compared.end)
        sides = F.array_compact(
            F.array(
                F.when(current, F.struct(F.lit("cur").alias("side"), d.alias("day"))),
                F.when(before, F.struct(F.lit("cmp").alias("side"), compared.shift(d).alias("day"))),
            )
        )
        rows = rows.where(current | before).withColumn("_s", F.explode(sides))
        rows = rows.withColumn("_side", F.col("_s.side")).withColumn("_day", F.col("_s.day"))
    labels = _labels(spec.group_by, F.col("_day"))
    rows = rows.select("_side", *[c.alias(f"d_{n}") for n, c in labels.items()], "amount")
    return rows.groupBy("_side", *[f"d_{n}" for n in labels]).agg(
        F.sum(-F.col("amount")).alias("net"),
        F.sum(outflow()).alias("gross"),
        F.sum(inflow()).alias("refunds"),
        F.count(F.lit(1)).alias("count"),
    )


def metric_value(metric: str, prefix: str = "", base: Column | None = None) -> Column:
    """One metric from the four sums; additive metrics keep their exact type."""
    net, count = F.col(f"{prefix}net"), F.col(f"{prefix}count")
    if metric == "net_spend":
        return net
    if metric == "gross_spend":
        return F.col(f"{prefix}gross")
    if metric == "refunds":
        return F.col(f"{prefix}refunds")
    if metric == "transaction_count":
        return count
    if metric == "avg_transaction":
        return F.try_divide(net.cast("double"), count.cast("double"))
    return F.try_divide(net.cast("double"), base.cast("double")) * 100


def _side_total(grouped: DataFrame, side: str) -> Column:
    return grouped.where(F.col("_side") == side).agg(F.sum("net").alias("t")).scalar()


def folded(grouped: DataFrame, dim: str, keep: int, fold_above: int, metric: str) -> DataFrame:
    """Relabel all but the ``keep`` largest current values of ``dim`` as Other, if there are more than ``fold_above``.

    The kept list is at most 25 rows by the spec's own check, which is what allows the broadcast.
    """
    column = f"d_{dim}"
    current = grouped.where(F.col("_side") == "cur").groupBy(column).agg(*[F.sum(s).alias(s) for s in SUMS])
    values = current.agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = metric_value(metric, base=_side_total(grouped, "cur"))
    kept = current.orderBy(F.desc_nulls_last(rank), column).limit(keep).select(
        F.col(column).alias("_kept"), F.lit(True).alias("_is_kept")
    )
    joined = grouped.join(F.broadcast(kept), grouped[column] == kept["_kept"], "left")
    label = F.when(F.col("_is_kept") | (values <= fold_above), F.col(column)).otherwise(F.lit(OTHER))
    others = [c for c in grouped.columns if c.startswith("d_") and c != column]
    return joined.withColumn(column, label).groupBy("_side", column, *others).agg(*[F.sum(s).alias(s) for s in SUMS])


def zero_filled(wide: DataFrame, dims: tuple[str, ...], period: periods.Period) -> DataFrame:
    """Every calendar label of the period for every categorical label seen, zeros where nothing happened.

    Each seen label is expanded by the calendar's array, so the grid is as large as the result and no larger.
    """
    seen = [f"d_{d}" for d in dims if d not in ORDERED]
    grid = wide.select(*seen).distinct() if seen else wide.sparkSession.range(1)
    for d in dims:
        if d in ORDERED:
            grid = grid.withColumn(f"d_{d}", F.explode(cal.calendar_labels(d, period.start, period.end)))
    keys = [f"d_{d}" for d in dims]
    sums = [c for c in wide.columns if c not in keys]
    joined = grid.join(wide, keys, "left")
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums])


def _sort_keys(spec: AnalysisSpec, value: str) -> list[Column]:
    dims = spec.group_by
    label_order = [cal.label_sort_key(d, F.col(d)) if d in ORDERED else F.col(d) for d in dims]
    if spec.sort == "desc":
        return [F.desc_nulls_last(value), *label_order]
    if spec.sort == "asc":
        return [F.asc_nulls_last(value), *label_order]
    if spec.sort == "label":
        return [F.col(d) for d in dims]
    ordered = [cal.label_sort_key(d, F.col(d)) for d in dims if d in ORDERED]
    if ordered:
        return [*ordered, F.desc_nulls_last(value), *label_order]
    return [F.col(dims[0]) == OTHER, F.desc_nulls_last(value), *label_order]


def _rounding(columns: list[str], dims, metric: str, transform: str) -> dict[str, Column]:
    unit = unit_of(metric)
    out = {}
    for c in columns:
        if c not in dims:
            out[c] = by_unit(F.col(c), "pct" if c == "change_pct" or c.endswith("_pct_change") else unit)
    return out


def analyze(frame: DataFrame, spec: AnalysisSpec, ctx: Context, rounded: bool = True) -> Analysis:
    """Run a spec over an analysis frame (``tables.analysis_frame``); empty data gives an empty table."""
    dims, metric = spec.group_by, spec.metric
    period, compared = resolved_period(frame, spec, ctx)
    notes: list[str] = []

    grouped = grouped_sums(frame, spec, period, compared)
    # The grouped rows feed several branches below; caching keeps the fact scan to one.
    grouped = grouped.cache() if dims else grouped
    source = grouped
    top, categorical = spec.top_n, spec.categorical_dimension
    if categorical and top:
        grouped = folded(grouped, categorical, top, top, metric)
    elif categorical and len(dims) == 2:
        grouped = folded(grouped, categorical, MAX_SERIES - 1, MAX_SERIES, metric)

    keys = [f"d_{d}" for d in dims]
    sides = ["cur", "cmp"] if compared else ["cur"]
    wide = grouped.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_side") == side, F.col(s)).otherwise(0)).alias(f"{side}_{s}")
            for side in sides
            for s in SUMS
        ]
    )
    if any(d in ORDERED for d in dims):
        wide = zero_filled(wide, dims, period)

    share = metric == "share_of_total"
    base = _side_total(source, "cur") if share else None
    columns = [F.col(f"d_{d}").alias(d) for d in dims] + [metric_value(metric, "cur_", base).alias(metric)]
    if compared:
        other = metric_value(metric, "cmp_", _side_total(source, "cmp") if share else None)
        columns.append(other.alias("comparison"))
    table = wide.select(*columns)
    if compared:
        change = F.col(metric) - F.col("comparison")
        table = table.withColumn("change", change).withColumn(
            "change_pct", F.try_divide(change.cast("double"), F.abs("comparison").cast("double")) * 100
        )

    value, transform = metric, spec.transform
    time = spec.time_dimension
    if transform != "none" and time is None:
        notes.append(f"Transform {transform!r} needs a month, quarter, or week dimension and was skipped.")
        transform = "none"
    if transform == "cumulative" and metric not in ADDITIVE:
        notes.append("A cumulative total only makes sense for sums and counts, so it was skipped.")
        transform = "none"
    if transform != "none":
        value = f"{metric}_{transform}"
        others = [d for d in dims if d != time]
        table = table.withColumn(value, transformed(metric, transform, time, others))

    if top and dims and not categorical:
        label_order = [cal.label_sort_key(d, F.col(d)) for d in dims]
        table = table.orderBy(F.desc_nulls_last(value), *label_order).limit(top)
        notes.append(f"Showing the top {top} rows by {METRIC_LABELS[metric].lower()}.")
    elif dims:
        table = table.orderBy(*_sort_keys(spec, value))
    exact = table
    if rounded:
        table = table.withColumns(_rounding(table.columns, dims, metric, transform))
    else:
        table = table.select(*[F.col(c) if c in dims else F.col(c).cast("double").alias(c) for c in table.columns])
    done = Analysis(spec, table, value, unit_of(metric, transform), source, period, compared, notes)
    done.summary = summarize(done, exact, transform)
    return done


# ----- summary -----


def _label_text(dims) -> Column:
    parts = [F.substring(F.col(d).cast("string"), 1, 32) for d in dims]
    return F.concat_ws(" / ", *parts) if parts else F.lit("total")


def _extremes(done: Analysis, table: DataFrame, unit: str) -> dict[str, Column]:
    """Highest, lowest and top five rows; the first in label order wins a tie."""
    dims, v = done.spec.group_by, done.value_column
    order = [cal.label_sort_key(d, F.col(d)) if d in ORDERED else F.col(d) for d in dims]
    rows = table.where(F.col(v).isNotNull()).select(
        _label_text(dims).alias("label"), F.col(v).cast("double").alias("v"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]
    )
    places = [f"_o{i}" for i in range(len(order))]
    shown = F.struct("label", by_unit(F.col("v"), unit).alias("value"))
    ends = rows.agg(
        F.min_by(shown, F.struct(-F.col("v"), *places)).alias("highest"),
        F.min_by(shown, F.struct("v", *places)).alias("lowest"),
    )
    five = rows.orderBy(F.desc("v"), *places).limit(5)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("k"), *places, shown.alias("s"))))
    top = five.agg(F.transform(ranked, lambda x: x["s"]).alias("top"))
    out = {
        "highest": ends.select("highest").scalar(),
        "lowest": ends.select("lowest").scalar(),
        "top": top.scalar(),
    }
    if v != done.spec.metric:
        last = rows.agg(F.max_by(shown, F.struct(*places)).alias("x"))
        out["latest"] = last.scalar()
    return out


def _biggest_change(done: Analysis, table: DataFrame) -> Column | None:
    spec, unit = done.spec, unit_of(done.spec.metric)
    dims, metric, time = spec.group_by, spec.metric, spec.time_dimension
    if done.compared is not None and dims:
        order = [cal.label_sort_key(d, F.col(d)) if d in ORDERED else F.col(d) for d in dims]
        row = F.struct(
            _label_text(dims).alias("label"),
            by_unit(F.col(metric), unit).alias("current"),
            by_unit(F.col("comparison"), unit).alias("comparison"),
            by_unit(F.col("change"), unit).alias("change"),
            by_unit(F.col("change_pct"), "pct").alias("change_pct"),
        )
        size = -F.abs(F.col("change").cast("double"))
        return table.where("change is not null").agg(F.min_by(row, F.struct(size, *order)).alias("x")).scalar()
    if time is None or (len(dims) > 1 and metric not in ADDITIVE):
        return None
    series = table.groupBy(time).agg(F.sum(metric).alias(metric)) if len(dims) > 1 else table
    step = largest_step(series, time, metric)
    return step.select(
        F.struct(
            F.col("from"),
            F.col("to"),
            by_unit(F.col("before"), unit).alias("before"),
            by_unit(F.col("after"), unit).alias("after"),
            by_unit(F.col("change"), unit).alias("change"),
            by_unit(F.col("change_pct"), "pct").alias("change_pct"),
        ).alias("x")
    ).scalar()


def summarize(done: Analysis, table: DataFrame, transform: str) -> DataFrame:
    """One row: totals, extremes, largest change, comparison, caption and notes."""
    spec, metric = done.spec, done.spec.metric
    unit, value_unit = unit_of(metric), unit_of(metric, transform)
    sides = ["cur", "cmp"] if done.compared else ["cur"]
    totals = done.grouped.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_side") == side, F.col(s))), F.lit(0)).alias(f"{side}_{s}")
            for side in sides
            for s in SUMS
        ]
    )

    def total(side: str) -> Column:
        if metric == "share_of_total":
            return F.when(F.col(f"{side}_net") != 0, F.lit(100.0))
        return metric_value(metric, f"{side}_").cast("double")

    columns = {
        "metric": F.lit(metric),
        "unit": F.lit(unit),
        "period": done.period.label,
        "start": done.period.start.cast("date"),
        "end": done.period.end.cast("date"),
        "total": F.lit(100.0) if metric == "share_of_total" else by_unit(total("cur"), unit).cast("double"),
        "transactions": F.col("cur_count"),
        "rows": table.agg(F.count(F.lit(1)).alias("n")).scalar(),
    }
    if spec.group_by:
        columns.update(_extremes(done, table, value_unit))
        change = _biggest_change(done, table)
        if change is not None:
            columns["largest_change"] = change
    if done.compared:
        delta = total("cur") - total("cmp")
        columns["comparison"] = F.struct(
            done.compared.label.alias("label"),
            by_unit(total("cmp"), unit).alias("total"),
            by_unit(delta, unit).alias("change"),
            by_unit(F.try_divide(delta, F.abs(total("cmp"))) * 100, "pct").alias("change_pct"),
        )
    columns["caption"] = caption(done, transform)
    empty = F.when(F.col("cur_count") == 0, F.lit("No matching transactions in this period."))
    columns["notes"] = F.array_compact(F.concat(done.period.notes, F.array(empty, *[F.lit(n) for n in done.notes])))
    return totals.select(*[c.alias(n) for n, c in columns.items()])


def filters_text(f) -> str:
    parts = []
    names = {
        "category": "category is", "exclude_category": "excluding category", "parent_group": "group is",
        "issuer": "card is", "merchant": "merchant is",
    }
    for name, words in names.items():
        if getattr(f, name):
            parts.append(f"{words} {', '.join(getattr(f, name))}")
    if f.merchant_contains:
        parts.append(f"merchant contains '{f.merchant_contains}'")
    if f.min_amount is not None:
        parts.append(f"transactions of at least ${f.min_amount:,.2f}")
    if f.max_amount is not None:
        parts.append(f"transactions of at most ${f.max_amount:,.2f}")
    return "; ".join(parts)


def caption(done: Analysis, transform: str) -> Column:
    """What the numbers mean, in a sentence or two."""
    spec = done.spec
    measure = METRIC_LABELS[spec.metric]
    if transform != "none":
        measure += f" ({TRANSFORM_LABELS[transform]})"
    if spec.group_by:
        measure += " by " + " and ".join(DIMENSION_LABELS[d] for d in spec.group_by)
    tail = [METRIC_DEFINITIONS[spec.metric]]
    tail.append("Card payments are excluded (Sale, Return, and Adjustment transactions only).")
    if filters_text(spec.filters):
        tail.append(f"Filters: {filters_text(spec.filters)}.")
    if spec.top_n and spec.categorical_dimension:
        tail.append(f"Top {spec.top_n} shown; the rest are grouped as Other.")
    text = F.concat(F.lit(measure + ", "), done.period.label, F.lit(". " + " ".join(tail)))
    if done.compared:
        text = F.concat(text, F.lit(" Compared with "), done.compared.label, F.lit("."))
    return text


# ----- presentation -----


def display_table(done: Analysis, comparison_label: str = "Comparison") -> DataFrame:
    """The table with readable column names and labels; the table itself is unchanged."""
    spec, out = done.spec, []
    base = unit_of(spec.metric)
    for c in done.table.columns:
        if c in spec.group_by:
            out.append(cal.friendly_label(c, F.col(c)).alias(DISPLAY_COLUMNS[c]))
        elif c == spec.metric:
            out.append(F.col(c).alias(METRIC_LABELS[c] + UNIT_SUFFIX[base]))
        elif c == done.value_column:
            unit = "pct" if spec.transform == "pct_change" else base
            name = f"{METRIC_LABELS[spec.metric]}, {TRANSFORM_LABELS[spec.transform]}{UNIT_SUFFIX[unit]}"
            out.append(F.col(c).alias(name))
        elif c == "comparison":
            out.append(F.col(c).alias(comparison_label[:1].upper() + comparison_label[1:] + UNIT_SUFFIX[base]))
        elif c == "change":
            out.append(F.col(c).alias("Change (pts)" if base == "pct" else f"Change{UNIT_SUFFIX[base]}"))
        elif c == "change_pct":
            out.append(F.col(c).alias("Change (%)"))
    return done.table.select(*out)


def matrix(table: DataFrame, rows: str, columns: str, value: str, labels: list) -> DataFrame:
    """Two dimensions as rows and columns. ``labels`` fixes the column order, so no extra job looks for them."""
    return table.groupBy(rows).pivot(columns, list(labels)).agg(F.sum(value)).orderBy(
        cal.label_sort_key(rows, F.col(rows)) if rows in ORDERED else F.col(rows)
    )
