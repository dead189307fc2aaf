"""Sparse matrices as edge tables (i, j, w): every product is a join and an aggregate, every norm a window or a grouped sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import ratio


def row_normalize(edges: DataFrame) -> DataFrame:
    """Each row divided by its sum; a row of zeros stays."""
    return edges.withColumn("w", ratio(F.col("w"), F.sum("w").over(Window.partitionBy("i"))))


def row_report(edges: DataFrame) -> DataFrame:
    """(i, total, negatives, stochastic): whether each row is non-negative and sums to 1 (to 1e-3)."""
    rows = edges.groupBy("i").agg(F.sum("w").alias("total"), F.count_if(F.col("w") < 0).alias("negatives"))
    return rows.withColumn("stochastic", (F.abs(F.col("total") - 1) <= 1e-3) & (F.col("negatives") == 0))


def require_stochastic(edges: DataFrame) -> DataFrame:
    """`edges`, or an error naming a row that breaks the rule. Runs one aggregate."""
    bad = row_report(edges).filter(~F.col("stochastic")).limit(1).collect()
    if bad:
        raise ValueError(f"not a transition matrix: row {bad[0]['i']} sums to {bad[0]['total']} with {bad[0]['negatives']} negative entries")
    return edges


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("to"), F.col("w").alias("v"))
    return a.join(right, F.col("j") == F.col("k")).groupBy("i", F.col("to").alias("j")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))


def power(edges: DataFrame, squarings: int) -> DataFrame:
    """edges to the power 2^squarings."""
    for _ in range(squarings):
        edges = product(edges, edges)
    return edges


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of both, multiplied."""
    right = b.select("i", "j", F.col("w").alias("v"))
    return a.join(right, ["i", "j"]).select("i", "j", (F.col("w") * F.col("v")).alias("w"))


def weighted_sum(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """The sum of c * matrix: a union and one aggregate, which aligns entries that only some have."""
    union = None
    for c, edges in parts:
        part = edges.select("i", "j", (F.col("w") * F.lit(float(c))).alias("w"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("i", "j").agg(F.sum("w").alias("w"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def density_normalize(edges: DataFrame) -> DataFrame:
    """w / (q_i q_j), q being column sums."""
    q = edges.groupBy("j").agg(F.sum("w").alias("q"))
    at_i = q.select(F.col("j").alias("i"), F.col("q").alias("qi"))
    return edges.join(q, "j").join(at_i, "i").select("i", "j", ratio(F.col("w"), F.col("q") * F.col("qi")).alias("w"))


def asymmetry(edges: DataFrame) -> DataFrame:
    """One row: the Frobenius norm of the matrix less its transpose, and how many entries lack a mirror entry."""
    back = transpose(edges).withColumnRenamed("w", "v")
    both = edges.join(back, ["i", "j"], "full")
    gap = F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))
    return both.agg(F.sqrt(F.coalesce(F.sum(gap * gap), F.lit(0.0))).alias("frobenius"), F.count_if(F.col("v").isNull()).alias("unmatched"))


def strongest(edges: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    """The n largest (or smallest) entries of each row, n being at most the least row count of all; ties by column."""
    order = F.col("w").asc() if ascending else F.col("w").desc()
    least = edges.groupBy("i").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    ranked = edges.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(order, "j")))
    return ranked.join(F.broadcast(least), F.col("r") <= F.least(F.lit(n), F.col("least"))).select("i", "j", "w")


def apply_to(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix times the columns of a table (i, columns...); rows without entries are left out."""
    right = values.select(F.col("i").alias("j"), *columns)
    return edges.join(right, "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def softmax(score: Column, by: str | list[str] = "i", mask: Column | None = None) -> Column:
    """Over the rows of a group, shifted by the group's largest score; rows where mask is true get 0 and count for nothing."""
    group = Window.partitionBy(by)
    score = score if mask is None else F.when(~mask, score)
    e = F.coalesce(F.exp(score - F.max(score).over(group)), F.lit(0.0))
    return ratio(e, F.sum(e).over(group))


def uniform_rows(edges: DataFrame) -> Column:
    """1 over the number of the row's entries."""
    return 1 / F.count("*").over(Window.partitionBy("i")).cast("double")
