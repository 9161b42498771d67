"""Contracts that are counted while rows pass, in the one job that uses them.

``contracts`` raises before a job and so reads its inputs once more. Here the rules of a
:class:`Pass` are metrics of the plan itself: rows go through unchanged, a job (a write, mostly
of a version that isn't published yet) runs once, and :meth:`Pass.check` raises afterwards. Keys are counted by
a window over the partitioning that a join on them needs anyway. A stage that runs again may
count a row twice, so numbers are exact unless executors were lost; zero is always exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_season_label
from ..sources.versions import Versions
from . import contracts, history


class Pass:
    """The contracts of one job, in the order in which they are to be checked."""

    def __init__(self):
        self._seen: list[tuple[Observation, list[tuple[str, str]]]] = []

    def observe(self, df: DataFrame, metrics: dict[str, Column], messages: dict[str, str] | None = None) -> DataFrame:
        """``df`` with metrics; those with a message must be zero."""
        seen = Observation()
        self._seen.append((seen, [(m, (messages or {}).get(m, "")) for m in metrics]))
        return df.observe(seen, *(c.alias(m) for m, c in metrics.items()))

    def rules(self, df: DataFrame, rules: contracts.Expectations) -> DataFrame:
        """Row rules: the number of rows that break each."""
        names = {f"rule {len(self._seen)}.{k}": rule for k, rule in enumerate(rules.rules)}
        return self.observe(df, {n: F.count_if(F.coalesce(c, F.lit(False))) for n, (c, _) in names.items()}, {n: message for n, (_, message) in names.items()})

    def rows(self, df: DataFrame, message: str, name: str = "rows") -> DataFrame:
        """Their number, which mustn't be zero."""
        return self.observe(df, {name: F.count(F.lit(1)), f"no {name}": (F.count(F.lit(1)) == 0).cast("int")}, {f"no {name}": message})

    def unique(self, df: DataFrame, keys: Sequence[str], message: str = "Duplicate observations found:\n", name: str | None = None) -> DataFrame:
        """Rows whose key other rows have too, and the least such key."""
        mark = "_same_key"
        marked = df.withColumn(mark, F.count(F.lit(1)).over(Window.partitionBy(*(F.col(f"`{k}`") for k in keys))))
        name = name or f"repeated {len(self._seen)}"
        example = F.min(F.when(F.col(mark) > 1, F.concat_ws(", ", *(F.col(f"`{k}`").cast("string") for k in keys))))
        return self.observe(marked, {name: F.count_if(F.col(mark) > 1), f"{name}: example": example}, {name: message}).drop(mark)

    def join(self, left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
        """A join whose sides hold each key once where ``validate`` says ``one``."""
        sides = []
        for side, frame, name in zip(validate.split("_to_"), (left, right), ("left", "right"), strict=True):
            sides.append(self.unique(frame, keys, f"Merge keys are not unique in the {name} dataset: ", f"repeated {name}") if side == "one" else frame)
        return sides[0].join(sides[1], list(keys), how)

    def metrics(self) -> dict[str, object]:
        """All metrics once a job has run. A part of the plan that turned out to be empty has none: its counts are zero."""
        out: dict[str, object] = {}
        for seen, own in self._seen:
            # Where Spark finds a part empty before it runs, its metrics are a row without columns.
            found = seen.get if seen._jo.getRow().length() else {}
            out |= {m: found.get(m, None if m.endswith(": example") else int(m.startswith("no "))) for m, _ in own}
        return out

    def broken(self) -> list[tuple[str, int, str | None]]:
        """``(message, rows, example)`` of each contract that is broken, in order."""
        found = self.metrics()
        return [(message, found[m], found.get(f"{m}: example")) for _, own in self._seen for m, message in own if message and found[m]]

    def check(self) -> dict[str, object]:
        """All metrics, or ValueError for the first broken contract."""
        for message, n, example in self.broken():
            raise ValueError(f"{message}{example if example is not None else ''} ({n} rows)")
        return self.metrics()


def report_pass(df: DataFrame, run: Pass, value: str = "crush_tonnes", columns: Sequence[str] = contracts.REPORT_COLUMNS, regions: Sequence[str] = contracts.REGIONS) -> DataFrame:
    """The contract of harvest reports (see ``contracts.check_report``) as metrics of ``df``."""
    contracts.require_columns(df, columns, "Harvest report")
    out = run.rows(df, "Historical crushing dataset is empty.")
    out = run.rules(out, contracts.Expectations(df).present(columns, "Harvest dataset contains missing values:\n"))
    out = run.unique(out, contracts.REPORT_KEY, "Harvest dataset contains duplicate season-date-region records. ")
    rules = contracts.Expectations(df).never(F.col(value) < 0, f"{value} cannot contain negative values.").never(~is_season_label(F.col("season")), "Invalid season labels: ")
    return run.rules(out, rules.never(~F.col("region").isin(list(regions)), "Unexpected regions: "))


def monthly_pass(df: DataFrame, run: Pass, columns: Sequence[str]) -> DataFrame:
    """The contract of monthly weather (see ``contracts.check_monthly``) as metrics of ``df``."""
    contracts.require_exact_columns(df, columns)
    return run.unique(run.rules(df, contracts.monthly_rules(df, columns)), contracts.MONTHLY_KEY)


def append_report(store: Versions, report: DataFrame, name: str | None = None) -> dict[str, object]:
    """The history's update in one job: each input is read once, and only new rows are written.

    A report's rows meet the history's by key in one outer join, whose metrics are the contracts:
    keys of both sides unique, no values missing or negative, regions known, no overlap that differs. The new rows
    become a version that is published once all hold and goes otherwise; a report without new rows publishes nothing.
    """
    run, key = Pass(), list(history.KEY)

    def side(df: DataFrame, name: str, known: Sequence[str]) -> DataFrame:
        own = history.typed(df, name)
        rules = history.rules(own, name).never(~F.col("region").isin(list(known)), f"{name.capitalize()} contains unsupported regions: ")
        return run.unique(run.rules(own, rules), key, f"Duplicate keys found in {name}:\n", f"repeated in {name}")

    old = side(store.read(), "historical database", history.HISTORY_REGIONS)
    new = side(report, "normalized report", (*history.HISTORY_REGIONS, *history.REPORT_ONLY_REGIONS))
    new = run.rows(new.where(F.col("region").isin(list(history.HISTORY_REGIONS))), "Normalized report contains no rows for the historical database regions.", "reported")
    both = old.withColumnRenamed("crush_tonnes", "old").join(new.withColumnRenamed("crush_tonnes", "new"), key, "full")
    met = F.col("old").isNotNull() & F.col("new").isNotNull()
    differ = met & (F.col("old") != F.col("new"))
    metrics = {"history": F.count("old"), "added": F.count_if(F.col("old").isNull()), "overlap": F.count_if(met), "conflicts": F.count_if(differ), "conflicts: example": F.min(F.when(differ, F.concat_ws(", ", *key)))}
    both = run.observe(both, metrics, {"conflicts": "Conflicting observations detected. The historical database was not modified:\n"})
    added = both.where(F.col("old").isNull()).select(*key, F.col("new").alias("crush_tonnes"))
    name = store.append(added, name=name, publish=False)
    try:
        found = run.check()
        if store.manifest(name)["rows"] != found["history"] + found["added"]:
            raise ValueError(f"Unexpected final row count. Expected {found['history'] + found['added']}, but obtained {store.manifest(name)['rows']}.")
    except BaseException:
        store.discard(name)
        raise
    if found["added"]:
        store.point_to(name)
    else:
        store.discard(name)
    return found
