"""Categorical annotations and time axes of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: States that may be renamed; their names are held on the driver.
MOST_STATES = 10_000


def combine(cells: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """`column` mapped by keys: "a, b" joins both as "a or b"; values in no key become null. A value may stand in one key only."""
    mapped, used = F.lit(None).cast("string"), set()
    for key in keys:
        own = [x.strip() for x in key.split(",")]
        if used.intersection(own):
            raise ValueError(f"{sorted(used.intersection(own))[0]} stands in two keys")
        used.update(own)
        mapped = F.when(F.col(column).isin(own), F.lit(" or ".join(own))).otherwise(mapped)
    return cells.withColumn(column, mapped)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """(i, label): the new label where there is one, else the old."""
    fresh = new.select("i", F.col("label").alias("_new"))
    return old.join(fresh, "i", "full").select("i", F.coalesce("_new", "label").alias("label"))


def rename(states: DataFrame, names: dict[str, str]) -> DataFrame:
    """(…, state) renamed one to one; unknown old names and clashes of new ones are errors."""
    known = {r["state"] for r in states.select("state").filter("state IS NOT NULL").distinct().limit(MOST_STATES + 1).collect()}
    if len(known) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    if missing := set(names) - known:
        raise KeyError(f"no state {sorted(missing)[0]}")
    after = [names.get(x, x) for x in known]
    if len(set(after)) < len(after):
        raise ValueError("new names clash")
    out = F.col("state")
    for a, b in names.items():
        out = F.when(F.col("state") == a, F.lit(b)).otherwise(out)
    return states.withColumn("state", out)


def overlap(initial: DataFrame, terminal: DataFrame) -> DataFrame:
    """Cells (obs) in both."""
    return initial.join(terminal.select("obs"), "obs", "left_semi").select("obs")


def numeric_time(cells: DataFrame, column: str, low: int = 2, high: int = 100) -> DataFrame:
    """`column` as doubles, if it has from low to high levels."""
    out = cells.withColumn(column, F.col(column).try_cast("double") if hasattr(F.col(column), "try_cast") else F.col(column).cast("double"))
    levels = out.agg(F.count_distinct(column).alias("n")).first()["n"]
    if not low <= levels <= high:
        raise ValueError(f"{column} has {levels} levels, not {low} to {high}")
    return out


def inverted_time(cells: DataFrame, column: str = "t") -> DataFrame:
    """max - t + min."""
    ends = cells.agg(F.min(column).alias("_a"), F.max(column).alias("_z"))
    return cells.crossJoin(F.broadcast(ends)).withColumn(column, F.col("_z") - F.col(column) + F.col("_a")).drop("_a", "_z")


def unit_gaps(levels: DataFrame) -> DataFrame:
    """(t, scaled) of the distinct times: divided by the least gap between successive ones."""
    steps = levels.select("t").distinct().withColumn("gap", F.col("t") - F.lag("t").over(Window.orderBy("t")))  # levels, not cells
    return steps.crossJoin(F.broadcast(steps.agg(F.min("gap").alias("least")))).select("t", (F.col("t") / F.coalesce("least", F.lit(1.0))).alias("scaled"))


def level_pairs(levels: DataFrame, policy: str = "sequential") -> DataFrame:
    """(src, tgt) of time levels: each with the next, or with all later ones."""
    own = levels.select("t").distinct()
    if policy == "sequential":
        return own.select(F.col("t").alias("src"), F.lead("t").over(Window.orderBy("t")).alias("tgt")).filter("tgt IS NOT NULL")
    later = own.select(F.col("t").alias("tgt"))
    return own.select(F.col("t").alias("src")).join(F.broadcast(later), F.col("src") < F.col("tgt"))
