"""States of cells: tables (obs, state) set by hand, from labels, from memberships, and their names and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.operators.labels import merge, overlap
from chainframe.operators.lineages import discrete, map_labels


def from_names(cells: DataFrame, names: dict[str, list]) -> DataFrame:
    """(obs, state) from lists of ids by state; an unknown id, an id in two states, or two names that are equal as text are errors.

    The lists are the user's own and are sent as a table.
    """
    if len({str(n) for n in names}) < len(names):
        raise ValueError("two names are equal as text")
    pairs = [(i, str(n)) for n, ids in names.items() for i in ids]
    if len({i for i, _ in pairs}) < len(pairs):
        raise ValueError("a cell is in two states")
    kind = cells.schema["obs"].dataType.simpleString()
    given = cells.sparkSession.createDataFrame(pairs, f"obs {kind}, state string")
    found = cells.select("obs").distinct().join(F.broadcast(given), "obs")
    if found.count() < len(pairs):
        known = {r["obs"] for r in found.select("obs").collect()}
        raise KeyError(f"no cell {next(i for i, _ in pairs if i not in known)}")
    return found


def from_clusters(cells: DataFrame, column: str, names: list | None = None) -> DataFrame:
    """(obs, state): the cells of the named clusters (all, if none are named), each cluster a state; null labels are in no state."""
    rows = cells.filter(F.col(column).isNotNull()).select("obs", F.col(column).cast("string").alias("state"))
    if names is None:
        return rows
    rows = rows.filter(F.col("state").isin([str(n) for n in names]))
    known = {r[0] for r in rows.select("state").distinct().collect()}  # at most the names asked for
    if missing := [n for n in names if str(n) not in known]:
        raise KeyError(f"no cluster {missing[0]}")
    return rows


def from_one_hot(rows: DataFrame, names: list[str]) -> DataFrame:
    """(obs, state) of a wide table (obs, names...) of 0 and 1: cells of a row with no 1 are in no state; two are an error."""
    ones = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))
    rows = rows.select("obs", ones.alias("x"))
    if not rows.filter(F.size("x") > 1).isEmpty():
        raise ValueError("a cell is in two states")
    return rows.filter(F.size("x") == 1).select("obs", F.col("x")[0].alias("state"))


def one_hot(states: DataFrame, names: list[str]) -> DataFrame:
    """(obs, names...): 1 at each cell's state, else 0."""
    return states.groupBy("obs").agg(*[F.max((F.col("state") == n).cast("int")).alias(n) for n in names])


def from_memberships(memberships: DataFrame, names: list[str], n: int = 30, of: list[str] | None = None, share: float = 0.2) -> DataFrame:
    """(obs, state): the n likeliest cells of each chosen macrostate, see `discrete`; a state left with fewer than share * n cells (at least one) is an error.

    memberships is (i, names...).
    """
    chosen = names if of is None else of
    if missing := [x for x in chosen if x not in names]:
        raise KeyError(f"no macrostate {missing[0]}")
    found = discrete(memberships, chosen, n)
    counts = {r["state"]: r["c"] for r in found.groupBy("state").agg(F.count("*").alias("c")).collect()}
    for x in chosen:
        if counts.get(x, 0) < max(int(share * n), 1):
            raise ValueError(f"{x} keeps only {counts.get(x, 0)} of {n} cells")
    return found.withColumnRenamed("i", "obs")


def add(existing: DataFrame | None, new: DataFrame, replace: bool = False) -> DataFrame:
    """`new` states beside or, with `replace`, in place of existing ones; a cell's new state stands before its old one."""
    if existing is None or replace:
        return new
    return merge(existing.select(F.col("obs").alias("i"), F.col("state").alias("label")), new.select(F.col("obs").alias("i"), F.col("state").alias("label"))).select(F.col("i").alias("obs"), F.col("label").alias("state"))


def apart(states: DataFrame, others: DataFrame | None, allow_overlap: bool = False) -> DataFrame:
    """`states`, or an error if a cell is also in the other kind's states (initial against terminal)."""
    if others is not None and not allow_overlap:
        both = overlap(states, others).limit(1).collect()
        if both:
            raise ValueError(f"cell {both[0]['obs']} is in initial and terminal states")
    return states


def probabilities(states: DataFrame, memberships: DataFrame, names: list[str]) -> DataFrame:
    """(i, p): of being in any of the states' macrostates: the largest of the memberships, each over its column's largest."""
    from chainframe.operators.lineages import membership_peak

    used = [r["state"] for r in states.select("state").distinct().limit(len(names) + 1).collect()]
    return membership_peak(memberships, [n for n in names if n in used])


def named(states: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """(obs, state) with states named after the most frequent label of their cells (obs, column): equal names get _1, _2, ... in order of the old ones."""
    rows = states.join(cells.select("obs", F.col(column).cast("string").alias("reference")), "obs", "left")
    names = map_labels(rows.select(F.col("obs").alias("i"), F.col("state").alias("query"), "reference"))
    return states.join(F.broadcast(names), F.col("state") == F.col("query"), "left").select("obs", F.coalesce("label", "state").alias("state"))


def by_size(classes: DataFrame) -> DataFrame:
    """(class, n, first, nth) of classes (node, class): larger ones first, then by their smallest node. A row for each class."""
    from pyspark.sql import Window

    sizes = classes.groupBy("class").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    return sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), "first")))
