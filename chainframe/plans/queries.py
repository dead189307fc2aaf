"""The catalog: each operator as a query over the driver's tables, with the SQL that gives the same rows.

Cells are the rows of `embeddings` (features, labels), the event chain is over `event_type`, and the expression matrix is
customers by part brand with summed quantities. Doubles are rounded to 6 places in both, after a shift that takes exact halves off the edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import doubles
from chainframe.lineage import cut
from chainframe.operators import additive, chains, communities, flow, kernels, labels, lineages, macrostates, matrix, neighbors, spectral, states, statistics, trends
from chainframe.sources.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Neighbours of a cell, and steps after which the SQL of the event chain, five states that leave with chance, has long converged.
K, STEPS = 10, 300
#: Added before rounding in both: sums in another order differ in the last bits, and a tie would then round either way.
OFF = 3e-10
FATES = ["a", "b", "c"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(rows: DataFrame) -> DataFrame:
    """Doubles to 6 places, without negative zeros."""
    return rows.select(*[(F.round(F.col(f"`{c}`") + OFF, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in rows.dtypes])


def R(x: str, name: str) -> str:
    return f"round({x} + {OFF:.10f}, 6) + 0.0 AS {name}"


# ---- inputs


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events", ["user_id", "ts", "event_id", "event_type"]).select(F.col("event_type").alias("i"), F.lead("event_type").over(user).alias("j"))
    return steps.filter("j IS NOT NULL").groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))


def event_chain(spark: SparkSession, d: str) -> DataFrame:
    return matrix.row_normalize(event_counts(spark, d))


def recurrent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("purchase", "purchase"), ("error", "error")], "obs string, state string")


def points(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), doubles(F.col("embedding"), dims).alias("x"), "label")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.knn(table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), K)


def graph(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.symmetrize(neighbours(spark, d))


def times(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("i", F.col("x")[0].alias("t"))


def fates(spark: SparkSession, d: str) -> DataFrame:
    e = [F.exp(4 * F.col("x")[k]) for k in range(3)]
    total = e[0] + e[1] + e[2]
    return points(spark, d).select("i", "label", *[(e[k] / total).alias(FATES[k]) for k in range(3)])


def expression(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    parts = table(spark, d, "part", ["p_partkey", "p_brand"])
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("obs"), F.col("p_brand").alias("var")).agg(F.sum("l_quantity").alias("x"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by nation and part brand: features that all cells have."""
    x = expression(spark, d).join(table(spark, d, "customer", ["c_custkey", "c_nationkey"]), F.col("obs") == F.col("c_custkey"))
    return x.groupBy(F.col("c_nationkey").alias("obs"), "var").agg(F.sum("x").alias("x"))


def order_times(spark: SparkSession, d: str) -> DataFrame:
    """(var, t, y): order values by days since 1992, by priority, one for each day."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("var"), day.alias("t")).agg(F.avg("o_totalprice").alias("y"))


_COUNTS = "steps AS (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events), cnt AS (SELECT i, j, count(*)::DOUBLE AS w FROM steps WHERE j IS NOT NULL GROUP BY ALL)"
_CHAIN = f"{_COUNTS}, t AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM cnt)"
_CELLS = "e AS (SELECT vec_id AS i, label, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings)"
_KNN = f"{_CELLS}, pr AS (SELECT a.i, b.i AS j, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) AS c FROM e a JOIN e b ON a.i <> b.i), knn AS (SELECT i, j, 1 - c AS d, (1 + c) / 2 AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS r FROM pr) WHERE r <= {K})"
_GRAPH = f"{_KNN}, g AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM knn UNION ALL SELECT j, i, w FROM knn) GROUP BY i, j)"
_CONN = f"{_GRAPH}, q AS (SELECT j, sum(w) AS q FROM g GROUP BY j), dn AS (SELECT g.i, g.j, g.w / (a.q * b.q) AS w FROM g JOIN q a ON g.i = a.j JOIN q b ON g.j = b.j), conn AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM dn)"
_HARD = f"tm AS (SELECT i, x[1] AS t FROM e), hb AS (SELECT g.i, g.j, g.w, a.t, b.t AS tj, row_number() OVER (PARTITION BY g.i ORDER BY g.w DESC, g.j DESC) AS r, least(30, floor(count(*) OVER (PARTITION BY g.i) * 0.3)) AS k FROM g JOIN tm a ON g.i = a.i JOIN tm b ON g.j = b.i), hard AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM hb WHERE t <= tj OR r <= k)"
_FATES = f"{_CELLS}, f0 AS (SELECT i, label, exp(4 * x[1]) AS a, exp(4 * x[2]) AS b, exp(4 * x[3]) AS c FROM e), f AS (SELECT i, label, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM f0)"
_EXPR = "xp AS (SELECT o_custkey AS obs, p_brand AS var, sum(l_quantity) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_NATIONS = _EXPR.replace("xp AS", "xc AS") + ", xp AS (SELECT c_nationkey AS obs, var, sum(x) AS x FROM xc JOIN customer ON obs = c_custkey GROUP BY ALL)"
_DAYS = "ot AS (SELECT o_orderpriority AS var, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS t, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"
_REC = "rec(obs) AS (VALUES ('purchase'), ('error')), tr AS (SELECT DISTINCT i FROM t WHERE i NOT IN (SELECT obs FROM rec)), qq AS (SELECT * FROM t WHERE i IN (SELECT i FROM tr) AND j IN (SELECT i FROM tr))"

# ---- the event chain


@query(f"WITH {_CHAIN} SELECT i, j, {R('w', 'w')} FROM t")
def event_transition_matrix(spark, d):
    return rounded(event_chain(spark, d))


@query(f"WITH {_CHAIN} SELECT i, {R('sum(w)', 'total')}, count(*) FILTER (w < 0) AS negatives, abs(sum(w) - 1) <= 1e-3 AS stochastic FROM t GROUP BY i")
def row_stochastic_check(spark, d):
    return rounded(matrix.row_report(event_chain(spark, d)))


@query(f"WITH {_CHAIN}, t2 AS (SELECT a.i, b.j, sum(a.w * b.w) AS w FROM t a JOIN t b ON a.j = b.i GROUP BY ALL) SELECT a.i, b.j, {R('sum(a.w * b.w)', 'w')} FROM t2 a JOIN t2 b ON a.j = b.i GROUP BY ALL")
def event_chain_power(spark, d):
    return rounded(matrix.power(event_chain(spark, d), 2))


def _solved(name: str, b: str) -> str:
    """CTEs: table `name` (i, x) solves x = Q x + b by repetition."""
    return f"{name}0 AS (SELECT 0 AS n, i, x FROM {b} UNION ALL SELECT n + 1, i, sum(x) FROM (SELECT r.n, qq.i, qq.w * r.x AS x FROM {name}0 r JOIN qq ON qq.j = r.i UNION ALL SELECT z.n, b.i, b.x FROM (SELECT DISTINCT n FROM {name}0) z CROSS JOIN {b} b) WHERE n < {STEPS} GROUP BY n, i), {name} AS (SELECT i, x FROM {name}0 WHERE n = {STEPS})"


def _into(name: str, state: str) -> str:
    return f"{name} AS (SELECT tr.i, coalesce(sum(t.w) FILTER (t.j = '{state}'), 0) AS x FROM tr LEFT JOIN t ON t.i = tr.i GROUP BY tr.i)"


_FATE_SQL = f"WITH RECURSIVE {_CHAIN}, {_REC}, {_into('sp', 'purchase')}, {_into('se', 'error')}, {_solved('fp', 'sp')}, {_solved('fe', 'se')} SELECT i, {R('fp.x', 'purchase')}, {R('fe.x', 'error')} FROM fp JOIN fe USING (i) UNION ALL VALUES ('purchase', 1.0, 0.0), ('error', 0.0, 1.0)"
_TIME_SQL = f"WITH RECURSIVE {_CHAIN}, {_REC}, one AS (SELECT i, 1.0::DOUBLE AS x FROM tr), {_solved('m', 'one')}, {_solved('v', 'm')} SELECT i, {R('m.x', 'mean')}, {R('2 * v.x - m.x - m.x * m.x', 'var')} FROM m JOIN v USING (i) UNION ALL VALUES ('purchase', 0.0, 0.0), ('error', 0.0, 0.0)"
_STATIONARY_SQL = f"WITH RECURSIVE {_CHAIN}, p AS (SELECT 0 AS n, i, 1.0 / count(*) OVER () AS p FROM (SELECT DISTINCT i FROM t) UNION ALL SELECT n + 1, j, sum(x) FROM (SELECT p.n, t.j, p.p * t.w AS x FROM p JOIN t ON p.i = t.i WHERE n < {STEPS}) GROUP BY n, j) SELECT i, {R('p', 'p')} FROM p WHERE n = {STEPS}"


@query(_FATE_SQL)
def event_fate_probabilities(spark, d):
    return rounded(chains.fate_probabilities(event_chain(spark, d), recurrent(spark), ["purchase", "error"]))


@query(_FATE_SQL)
def event_fate_probabilities_direct(spark, d):
    return rounded(chains.fate_probabilities(event_chain(spark, d), recurrent(spark), ["purchase", "error"], method="direct"))


@query(_FATE_SQL)
def event_fate_probabilities_iterated(spark, d):
    return rounded(chains.fate_probabilities(event_chain(spark, d), recurrent(spark), ["purchase", "error"], tol=1e-10, method="fixed_point"))


@query(_TIME_SQL)
def event_absorption_times(spark, d):
    return rounded(chains.absorption_times(event_chain(spark, d), recurrent(spark)))


@query(_TIME_SQL)
def event_absorption_times_direct(spark, d):
    return rounded(chains.absorption_times(event_chain(spark, d), recurrent(spark), method="direct"))


@query(f"WITH RECURSIVE {_CHAIN}, {_REC}, {_into('sp', 'purchase')}, {_solved('h', 'sp')}, {_solved('nh', 'h')}, {_solved('nhm', 'nh')} SELECT i, {R('nh.x / h.x', 'mean')}, {R('2 * nhm.x / h.x - nh.x / h.x - (nh.x / h.x) ** 2', 'var')} FROM h JOIN nh USING (i) JOIN nhm USING (i) UNION ALL VALUES ('purchase', 0.0, 0.0), ('error', 'inf'::DOUBLE, 'nan'::DOUBLE)")
def event_conditional_absorption(spark, d):
    return rounded(chains.conditional_absorption_times(event_chain(spark, d), recurrent(spark), "purchase", ["purchase", "error"]))


@query(_STATIONARY_SQL)
def event_stationary_distribution(spark, d):
    return rounded(chains.stationary(event_chain(spark, d)))


@query(_STATIONARY_SQL)
def event_stationary_distribution_krylov(spark, d):
    return rounded(chains.stationary(event_chain(spark, d), method="krylov"))


#: The event chain with its chances to leave divided by a million; SQL sums the powers of Q by doubling.
_SLOW = f"WITH RECURSIVE {_CHAIN}, rec(obs) AS (VALUES ('purchase'), ('error')), s0 AS (SELECT i, j, w * CASE WHEN j IN (SELECT obs FROM rec) THEN 1e-6 ELSE 1 END AS w FROM t WHERE i NOT IN (SELECT obs FROM rec)), s1 AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM s0), tr AS (SELECT DISTINCT i FROM s1), dbl AS (SELECT 0 AS n, a.i, b.i AS j, coalesce(s1.w, 0) AS p, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM tr a CROSS JOIN tr b LEFT JOIN s1 ON s1.i = a.i AND s1.j = b.i UNION ALL SELECT n + 1, i, j, p, own + s FROM (SELECT a.n, a.i, b.j, sum(a.p * b.p) AS p, sum(a.p * b.s) AS s, any_value(c.s) AS own FROM dbl a JOIN dbl b ON a.j = b.i JOIN dbl c ON c.i = a.i AND c.j = b.j WHERE a.n < 36 GROUP BY ALL)) SELECT i, {R('sum(s * coalesce(a.w, 0))', 'purchase')}, {R('sum(s * coalesce(b.w, 0))', 'error')} FROM (SELECT dbl.i, dbl.s, dbl.j FROM dbl WHERE n = 36) z LEFT JOIN (SELECT i AS k, w FROM s1 WHERE j = 'purchase') a ON a.k = z.j LEFT JOIN (SELECT i AS k, w FROM s1 WHERE j = 'error') b ON b.k = z.j GROUP BY i UNION ALL VALUES ('purchase', 1.0, 0.0), ('error', 0.0, 1.0)"


def slow_event_chain(spark: SparkSession, d: str) -> DataFrame:
    ends = F.col("j").isin("purchase", "error") & ~F.col("i").isin("purchase", "error")
    return matrix.row_normalize(event_chain(spark, d).withColumn("w", F.when(ends, F.col("w") * 1e-6).otherwise(F.col("w"))))


@query(_SLOW)
def slow_chain_fate_probabilities(spark, d):
    return rounded(chains.fate_probabilities(slow_event_chain(spark, d), recurrent(spark), ["purchase", "error"], method="krylov"))


@query(_SLOW)
def slow_chain_fate_probabilities_direct(spark, d):
    return rounded(chains.fate_probabilities(slow_event_chain(spark, d), recurrent(spark), ["purchase", "error"], method="direct"))


def part_chain(spark: SparkSession, d: str) -> DataFrame:
    """From a part to the next line's part of its order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).select(F.col("l_partkey").alias("i"), F.lead("l_partkey").over(line).alias("j"))
    return matrix.row_normalize(steps.filter("j IS NOT NULL").groupBy("i", "j").agg(F.count("*").cast("double").alias("w")))


_PARTS = "t AS (SELECT i, j, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY i) AS w FROM (SELECT l_partkey AS i, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS j FROM lineitem) WHERE j IS NOT NULL GROUP BY i, j), rec AS (SELECT p_partkey AS obs, p_brand AS state FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')), tr AS (SELECT DISTINCT i FROM t WHERE i NOT IN (SELECT obs FROM rec)), qq AS (SELECT * FROM t WHERE i IN (SELECT i FROM tr) AND j IN (SELECT i FROM tr)), sp AS (SELECT tr.i, coalesce(sum(t.w) FILTER (state = 'Brand#11'), 0) AS x, coalesce(sum(t.w) FILTER (state = 'Brand#12'), 0) AS y FROM tr JOIN t ON t.i = tr.i LEFT JOIN rec ON obs = t.j GROUP BY tr.i)"


@query(f"WITH RECURSIVE {_PARTS}, r AS (SELECT 0 AS n, i, x, y FROM sp UNION ALL SELECT n + 1, i, sum(x), sum(y) FROM (SELECT r.n, qq.i, qq.w * r.x AS x, qq.w * r.y AS y FROM r JOIN qq ON qq.j = r.i UNION ALL SELECT z.n, sp.i, sp.x, sp.y FROM (SELECT DISTINCT n FROM r) z CROSS JOIN sp) WHERE n < {STEPS} GROUP BY n, i) SELECT i, {R('x', 'first')}, {R('y', 'second')} FROM r WHERE n = {STEPS} UNION ALL SELECT obs, (state = 'Brand#11')::INT::DOUBLE, (state = 'Brand#12')::INT::DOUBLE FROM rec")
def part_fate_probabilities(spark, d):
    """A system for the Krylov solver whatever its size: parts of two brands end a walk."""
    ends = table(spark, d, "part", ["p_partkey", "p_brand"]).filter(F.col("p_brand").isin("Brand#11", "Brand#12")).select(F.col("p_partkey").alias("obs"), F.when(F.col("p_brand") == "Brand#11", "first").otherwise("second").alias("state"))
    return rounded(chains.fate_probabilities(cut(part_chain(spark, d)), ends, ["first", "second"], method="krylov"))


QUERIES["event_stationary_distribution_converged"] = event_stationary_distribution
ORACLE_SQL["event_stationary_distribution_converged"] = _STATIONARY_SQL


@query(f"WITH RECURSIVE {_CHAIN}, ed AS (SELECT i, j FROM t WHERE w > 0.2), nd AS (SELECT i FROM ed UNION SELECT j FROM ed), rc AS (SELECT i, i AS j FROM nd UNION SELECT rc.i, ed.j FROM rc JOIN ed ON rc.j = ed.i), cl AS (SELECT a.i AS node, min(a.j) AS class FROM rc a JOIN rc b ON a.i = b.j AND a.j = b.i GROUP BY a.i) SELECT node, class, NOT EXISTS (SELECT 1 FROM ed JOIN cl x ON x.node = ed.i JOIN cl y ON y.node = ed.j WHERE x.class = cl.class AND y.class <> cl.class) AS recurrent FROM cl")
def recurrent_classes(spark, d):
    return chains.communicating_classes(event_chain(spark, d).filter("w > 0.2"))


@query()
def random_walks(spark, d):
    starts = spark.range(200).select(F.col("id").alias("walk"), F.lit("view").alias("obs"))
    return chains.random_walks(event_chain(spark, d), starts, 15, seed=7, stops=recurrent(spark).select("obs"))


# ---- neighbour graphs and kernels


@query(f"WITH {_KNN} SELECT i, j, {R('d', 'd')}, {R('w', 'w')} FROM knn")
def knn_graph_cosine(spark, d):
    return rounded(neighbours(spark, d))


@query(f"WITH {_CONN} SELECT i, j, {R('w', 'w')} FROM conn")
def connectivity_kernel(spark, d):
    return rounded(kernels.connectivity(graph(spark, d)))


@query(f"WITH {_GRAPH}, ln AS (SELECT i, j FROM g UNION SELECT i, i FROM g), av AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM ln), fl AS (SELECT i AS j, unnest(range(0, len(x))) AS k, unnest(x) AS v FROM e) SELECT i, k, {R('sum(w * v)', 'mean')}, {R('sum(w * v * v) - sum(w * v) ** 2', 'var')} FROM av JOIN fl USING (j) GROUP BY i, k")
def knn_moments(spark, d):
    return rounded(neighbors.moments(graph(spark, d), points(spark, d), width(spark, d)))


_VEL = "cv AS (SELECT i, x[1:len(x) - 1] AS x, list_transform(range(1, len(x)), lambda k: x[k + 1] - x[k]) AS v FROM e), dd AS (SELECT g.i, g.j, a.v, list_transform(range(1, len(a.x) + 1), lambda k: b.x[k] - a.x[k]) AS d FROM g JOIN cv a ON g.i = a.i JOIN cv b ON g.j = b.i), cc AS (SELECT i, j, v, d, list_transform(v, lambda y: y - list_avg(v)) AS vc, list_transform(d, lambda y: y - list_avg(d)) AS dc FROM dd)"


def width(spark: SparkSession, d: str) -> int:
    """Entries of an embedding."""
    return points(spark, d).agg(F.max(F.size("x"))).first()[0]


def moving(spark: SparkSession, d: str) -> DataFrame:
    """Cells (i, x, v): each entry's velocity is the next entry less it, over all entries that have a next one."""
    n = width(spark, d) - 1
    return points(spark, d).select("i", F.slice("x", 1, n).alias("x"), F.zip_with(F.slice("x", 2, n), F.slice("x", 1, n), lambda a, b: a - b).alias("v"))


def _velocity_sql(score: str) -> str:
    return f"WITH {_GRAPH}, {_VEL}, sc AS (SELECT i, j, 4 * {score} AS s FROM cc), ex AS (SELECT i, j, exp(s - max(s) OVER (PARTITION BY i)) AS x FROM sc) SELECT i, j, {R('x / sum(x) OVER (PARTITION BY i)', 'w')} FROM ex"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(_velocity_sql("list_dot_product(v, d)"))
def velocity_kernel_dot(spark, d):
    return rounded(kernels.velocity(graph(spark, d), moving(spark, d), "dot", 4.0))


@query(_velocity_sql(_cos("v", "d")))
def velocity_kernel_cosine(spark, d):
    return rounded(kernels.velocity(graph(spark, d), moving(spark, d), "cosine", 4.0))


@query(_velocity_sql(_cos("vc", "dc")))
def velocity_kernel_correlation(spark, d):
    return rounded(kernels.velocity(graph(spark, d), moving(spark, d), "correlation", 4.0))


@query(f"WITH {_GRAPH}, {_VEL}, sc AS (SELECT {_cos('vc', 'dc')} AS s FROM cc) SELECT {R('1 / quantile_cont(abs(s), 0.5)', 'scale')} FROM sc WHERE s <> 0")
def softmax_scale(spark, d):
    return rounded(kernels.softmax_scale(kernels.velocity_scores(graph(spark, d), moving(spark, d), "correlation")))


@query(f"WITH {_GRAPH}, {_HARD} SELECT i, j, {R('w', 'w')} FROM hard")
def pseudotime_hard(spark, d):
    return rounded(kernels.pseudotime(graph(spark, d), times(spark, d), "hard"))


@query(f"WITH {_GRAPH}, tm AS (SELECT i, x[1] AS t FROM e), sf AS (SELECT g.i, g.j, g.w * CASE WHEN a.t > b.t THEN 2 / pow(1 + exp(10 * (a.t - b.t)), 2) ELSE 1 END AS w FROM g JOIN tm a ON g.i = a.i JOIN tm b ON g.j = b.i) SELECT i, j, {R('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM sf")
def pseudotime_soft(spark, d):
    return rounded(kernels.pseudotime(graph(spark, d), times(spark, d), "soft"))


def _two(spark: SparkSession, d: str) -> tuple[kernels.Kernel, kernels.Kernel]:
    g = cut(graph(spark, d))
    return kernels.Kernel(kernels.pseudotime(g, times(spark, d))), kernels.Kernel(kernels.connectivity(g))


@query(f"WITH {_CONN}, {_HARD}, u AS (SELECT i, j, 0.8 * w AS w FROM hard UNION ALL SELECT i, j, 0.2 * w FROM conn) SELECT i, j, {R('sum(w)', 'w')} FROM u GROUP BY i, j")
def kernel_sum(spark, d):
    a, b = _two(spark, d)
    return rounded((8 * a + 2 * b).edges())


@query(f"WITH {_CONN}, {_HARD}, u AS (SELECT hard.i, hard.j, hard.w * conn.w AS w FROM hard JOIN conn ON hard.i = conn.i AND hard.j = conn.j) SELECT i, j, {R('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM u")
def kernel_product(spark, d):
    a, b = _two(spark, d)
    return rounded((a * b).edges())


def _top_sql(order: str, source: str, value: str) -> str:
    return f"WITH {_GRAPH}, ls AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM {source} GROUP BY i)) SELECT i, j, {R('w', 'w')} FROM (SELECT i, j, {value} AS w, row_number() OVER (PARTITION BY i ORDER BY {order}, j) AS r FROM {source}) WHERE r <= least(5, (SELECT m FROM ls))"


@query(_top_sql("w DESC", "g", "w"))
def neighbor_topk_connectivities(spark, d):
    return rounded(matrix.strongest(graph(spark, d), 5))


@query(_top_sql("d", "knn", "d"))
def neighbor_topk_distances(spark, d):
    return rounded(matrix.strongest(neighbours(spark, d).select("i", "j", F.col("d").alias("w")), 5, ascending=True))


@query(f"WITH {_KNN}, b AS (SELECT a.w AS x, c.w AS y FROM knn a FULL JOIN knn c ON a.i = c.j AND a.j = c.i) SELECT {R('sqrt(sum((coalesce(x, 0) - coalesce(y, 0)) ** 2))', 'frobenius')}, count(*) FILTER (y IS NULL) AS unmatched FROM b")
def graph_symmetry_check(spark, d):
    return rounded(matrix.asymmetry(neighbours(spark, d)))


@query(f"WITH RECURSIVE {_KNN}, ed AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM knn WHERE d < 0.6 UNION ALL SELECT j, i FROM knn WHERE d < 0.6)), rc AS (SELECT i, i AS j FROM ed UNION SELECT rc.i, ed.j FROM rc JOIN ed ON rc.j = ed.i) SELECT i AS node, min(j) AS label FROM rc GROUP BY i")
def connected_components(spark, d):
    return chains.components(neighbours(spark, d).filter("d < 0.6"))


@query(f"WITH {_KNN} SELECT DISTINCT knn.i FROM knn JOIN e a ON knn.i = a.i JOIN e b ON knn.j = b.i WHERE a.label = 1 AND b.label = 2")
def boundary_cells(spark, d):
    return neighbors.boundary(neighbours(spark, d), points(spark, d).select("i", "label"), 1, 2)


@query(f"WITH {_KNN}, v AS (SELECT knn.i, count(*) FILTER (a.label = b.label) AS n, any_value(a.label) AS label FROM knn JOIN e a ON knn.i = a.i JOIN e b ON knn.j = b.i GROUP BY knn.i) SELECT i, label FROM v WHERE n >= 2")
def neighbour_votes(spark, d):
    return neighbors.neighbour_votes(neighbours(spark, d), points(spark, d).select("i", "label"), 2)


#: Long forms: i, entry k and value, of graph-weighted sums of neighbours' entries.
_CBC = "cv AS (SELECT i, unnest(range(0, len(x))) AS k, unnest(x) AS x FROM e), mv AS (SELECT conn.i, b.k, sum(conn.w * b.x) AS m FROM conn JOIN cv b ON conn.j = b.i GROUP BY ALL), em AS (SELECT g.i, b.k, sum(g.w * (b.x - a.x)) AS e FROM g JOIN cv b ON g.j = b.i JOIN cv a ON g.i = a.i AND a.k = b.k JOIN e la ON g.i = la.i JOIN e lb ON g.j = lb.i WHERE la.label = 1 AND lb.label = 2 GROUP BY ALL)"


@query(f"WITH {_CONN}, {_CBC} SELECT em.i, {R('corr(mv.m - cv.x, em.e)', 'cbc')} FROM em JOIN mv USING (i, k) JOIN cv USING (i, k) GROUP BY em.i")
def cross_boundary_correctness(spark, d):
    g, cells = cut(graph(spark, d)), points(spark, d)
    return rounded(flow.cross_boundary(kernels.connectivity(g), g, cells.select("i", "x"), cells.select("i", "label"), 1, 2, width(spark, d)))


for _name in ("velocity_kernel_dot", "velocity_kernel_cosine", "velocity_kernel_correlation", "softmax_scale", "knn_moments", "cross_boundary_correctness"):
    QUERIES[f"{_name}_whole"], ORACLE_SQL[f"{_name}_whole"] = QUERIES[_name], ORACLE_SQL[_name]


@query(f"WITH {_CONN}, cv AS (SELECT i, x FROM e), un AS (SELECT g.i, coalesce(h.w, 0) AS w, list_transform(range(1, 3), lambda k: b.x[k] - a.x[k]) AS d FROM g LEFT JOIN conn h ON g.i = h.i AND g.j = h.j JOIN cv a ON g.i = a.i JOIN cv b ON g.j = b.i), uu AS (SELECT i, w, list_transform(d, lambda y: y / sqrt(list_dot_product(d, d))) AS u FROM un) SELECT i, {R('sum(w * u[1]) - sum(u[1]) / count(*)', 'x')}, {R('sum(w * u[2]) - sum(u[2]) / count(*)', 'y')} FROM uu GROUP BY i")
def projection(spark, d):
    g = cut(graph(spark, d))
    found = flow.projection(kernels.connectivity(g), g, points(spark, d, 2).select("i", "x"), 2)
    return rounded(found.select("i", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


# ---- fate tables


def _fate_sql(select: str) -> str:
    return f"WITH {_FATES} {select}"


@query(_fate_sql(f"SELECT i, {R('a + c', 'a_or_c')}, {R('b', 'b')} FROM f"))
def lineage_mix(spark, d):
    return rounded(lineages.mix(fates(spark, d), FATES, ["a, c", "b"]).withColumnRenamed("a or c", "a_or_c"))


@query(_fate_sql(f", mn AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM f), k AS (SELECT i, a * ln(a / ma) + b * ln(b / mb) + c * ln(c / mc) AS r FROM f, mn) SELECT i, {R('(r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())', 'priming')} FROM k"))
def priming_kl(spark, d):
    return rounded(lineages.priming(fates(spark, d), FATES))


@query(_fate_sql(f", n AS (SELECT i, -(a * ln(a) + b * ln(b) + c * ln(c)) AS h FROM f), k AS (SELECT i, max(h) OVER () - h AS r FROM n) SELECT i, {R('(r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())', 'priming')} FROM k"))
def priming_entropy(spark, d):
    return rounded(lineages.priming(fates(spark, d), FATES, "entropy"))


@query(_fate_sql(f", l AS (SELECT label, 'a' AS lineage, a AS p FROM f UNION ALL SELECT label, 'b', b FROM f UNION ALL SELECT label, 'c', c FROM f) SELECT label, lineage, {R('avg(p)', 'mean')}, {R('stddev_pop(p) / sqrt(count(*))', 'sem')} FROM l GROUP BY label, lineage"))
def aggregate_fate_mean_sem(spark, d):
    return rounded(lineages.aggregate(fates(spark, d), FATES, "label"))


@query(_fate_sql(f"SELECT i, {R('ln(a / b + 1e-12)', 'log_odds')} FROM f WHERE a <> 0 AND b <> 0"))
def log_odds(spark, d):
    return rounded(lineages.log_odds(fates(spark, d), "a", "b"))


@query(_fate_sql(f", mn AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM f), k AS (SELECT i, a / ma AS a, b / mb AS b, c / mc AS c FROM f, mn), z AS (SELECT i, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM k) SELECT i, {R('a + b * cos(2 * pi() / 3) + c * cos(4 * pi() / 3)', 'x')}, {R('b * sin(2 * pi() / 3) + c * sin(4 * pi() / 3)', 'y')} FROM z"))
def circular_projection(spark, d):
    return rounded(lineages.circular(fates(spark, d), FATES))


def _reduce_sql(weights: str) -> str:
    """weights: a one-row query of raw weights of c for a and b (ra, rb), turned by softmax."""
    return _fate_sql(f", rw AS ({weights}), sw AS (SELECT exp(ra - greatest(ra, rb)) AS ea, exp(rb - greatest(ra, rb)) AS eb FROM rw) SELECT i, {R('a + c * ea / (ea + eb)', 'a')}, {R('b + c * eb / (ea + eb)', 'b')} FROM f, sw")


@query(_fate_sql(f"SELECT i, {R('a / (a + b)', 'a')}, {R('b / (a + b)', 'b')} FROM f"))
def lineage_reduce_scale(spark, d):
    return rounded(lineages.reduce(fates(spark, d), ["a", "b"], ["c"], "scale"))


@query(_reduce_sql("SELECT sum(a * c) / sqrt(sum(a * a) * sum(c * c)) AS ra, sum(b * c) / sqrt(sum(b * b) * sum(c * c)) AS rb FROM f"))
def lineage_reduce_cosine(spark, d):
    return rounded(lineages.reduce(fates(spark, d), ["a", "b"], ["c"], "cosine"))


_NORMED = "(SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b, c / sum(c) OVER () AS c FROM f)"


@query(_reduce_sql(f"SELECT 1 / sum(c * ln(c / a)) AS ra, 1 / sum(c * ln(c / b)) AS rb FROM {_NORMED}"))
def lineage_reduce_kl(spark, d):
    return rounded(lineages.reduce(fates(spark, d), ["a", "b"], ["c"], "kl"))


@query(_reduce_sql(f"SELECT 1 / sqrt(sum(a * ln(2 * a / (a + c)) + c * ln(2 * c / (a + c))) / 2) AS ra, 1 / sqrt(sum(b * ln(2 * b / (b + c)) + c * ln(2 * c / (b + c))) / 2) AS rb FROM {_NORMED}"))
def lineage_reduce_js(spark, d):
    return rounded(lineages.reduce(fates(spark, d), ["a", "b"], ["c"], "js"))


@query(_reduce_sql("SELECT 1.0 AS ra, 1.0 AS rb"))
def lineage_reduce_equal(spark, d):
    return rounded(lineages.reduce(fates(spark, d), ["a", "b"], ["c"], "equal"))


@query(_fate_sql(", l AS (SELECT i, 0 AS o, 'a' AS state, a AS p FROM f UNION ALL SELECT i, 1, 'b', b FROM f UNION ALL SELECT i, 2, 'c', c FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, i) AS r FROM l), u AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p DESC, o) AS z FROM t WHERE r <= 20) SELECT i, state FROM u WHERE z = 1"))
def fuzzy_to_discrete(spark, d):
    return lineages.discrete(fates(spark, d), FATES, 20)


@query(_fate_sql(f"SELECT i, {R('greatest(a / max(a) OVER (), b / max(b) OVER (), c / max(c) OVER ())', 'p')} FROM f"))
def terminal_state_probability(spark, d):
    return rounded(lineages.membership_peak(fates(spark, d), FATES))


@query(f"WITH {_CELLS}, c AS (SELECT i, CASE WHEN x[1] > 0 THEN 'p' ELSE 'n' END AS query, label AS reference FROM e), ct AS (SELECT query, reference, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT query, reference FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, reference) AS r FROM ct) WHERE r = 1) SELECT query, CASE WHEN count(*) OVER (PARTITION BY reference) > 1 THEN reference || '_' || row_number() OVER (PARTITION BY reference ORDER BY query) ELSE reference::VARCHAR END AS label FROM b")
def map_labels(spark, d):
    cells = points(spark, d).select("i", F.when(F.col("x")[0] > 0, "p").otherwise("n").alias("query"), F.col("label").alias("reference"))
    return lineages.map_labels(cells)


# ---- flows and couplings


def _customer_years(spark: SparkSession, d: str) -> DataFrame:
    """(i, t, cluster): a customer in a year it ordered in, as a cell."""
    orders = table(spark, d, "orders", ["o_custkey", "o_orderdate"]).select("o_custkey", F.year("o_orderdate").alias("t")).distinct()
    own = orders.join(table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey"))
    return own.select((F.col("o_custkey") * 10_000 + F.col("t")).alias("i"), "t", F.col("c_mktsegment").alias("cluster"), F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("c"))


_YEARS = "cy AS (SELECT DISTINCT o_custkey * 10000 + year(o_orderdate) AS i, year(o_orderdate) AS t, c_mktsegment AS cluster, c_nationkey AS nation, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey)"
#: A coupling of successive years: customers of one nation, by closeness of their keys.
_COUPLED = f"{_YEARS}, cp AS (SELECT a.t AS src, b.t AS tgt, a.i, b.i AS j, 1.0 / (1 + abs(a.c - b.c)) AS w FROM cy a JOIN cy b ON a.nation = b.nation AND b.t = a.t + 1 WHERE abs(a.c - b.c) <= 100)"


def _couplings(spark: SparkSession, d: str) -> DataFrame:
    """As _COUPLED: keys within 100 of each other lie in the same or in neighbouring bands of 100, so bands are joined and not whole nations."""
    cells = _customer_years(spark, d).withColumn("band", F.floor(F.col("c") / 100))
    later = cells.select(F.col("i").alias("j"), (F.col("t") - 1).alias("t"), "nation", F.col("c").alias("cj"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    pairs = cells.join(later, ["nation", "t", "band"]).filter(F.abs(F.col("c") - F.col("cj")) <= 100)
    return pairs.select(F.col("t").alias("src"), (F.col("t") + 1).alias("tgt"), "i", "j", (1 / (1 + F.abs(F.col("c") - F.col("cj")))).alias("w"))


def _real_time_sql(threshold: str) -> str:
    return f"WITH {_COUPLED}, tp AS (SELECT src, tgt, i, max(w) AS m FROM cp GROUP BY ALL), {threshold}, z AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM kp) SELECT i, j, {R('w', 'w')} FROM z UNION ALL SELECT i, i, 1.0 FROM cy WHERE t = (SELECT max(t) FROM cy)"


def _real_time(spark, d, threshold):
    cells = _customer_years(spark, d)
    last = cells.join(F.broadcast(cells.agg(F.max("t").alias("t"))), "t").select("i")
    return rounded(kernels.real_time(_couplings(spark, d), last, threshold))


@query(_real_time_sql("kp AS (SELECT i, j, w FROM cp WHERE w >= (SELECT min(m) FROM tp))"))
def realtime_kernel_auto(spark, d):
    return _real_time(spark, d, "auto")


@query(_real_time_sql("lc AS (SELECT src, tgt, min(m) AS m FROM tp GROUP BY ALL), kp AS (SELECT i, j, w FROM cp JOIN lc USING (src, tgt) WHERE w >= m)"))
def realtime_kernel_auto_local(spark, d):
    return _real_time(spark, d, "auto_local")


@query(_real_time_sql("lc AS (SELECT src, tgt, quantile_cont(w, 0.9) AS m FROM cp GROUP BY ALL), kp AS (SELECT i, j, w FROM cp JOIN lc USING (src, tgt) WHERE w >= m)"))
def realtime_kernel_percentile(spark, d):
    return _real_time(spark, d, 90)


@query(f"WITH {_COUPLED}, s AS (SELECT a.t AS t_from, b.t AS t_to, a.cluster AS src, b.cluster AS dst, sum(w) AS w FROM cp JOIN cy a ON cp.i = a.i JOIN cy b ON cp.j = b.i GROUP BY ALL) SELECT t_from, t_to, src, dst, {R('w / sum(w) OVER (PARTITION BY t_from, t_to, src)', 'w')} FROM s")
def cluster_flow(spark, d):
    return rounded(flow.flow(_couplings(spark, d).select("i", "j", "w"), _customer_years(spark, d).select("i", "cluster", "t")))


@query(f"WITH {_YEARS}, s AS (SELECT t, cluster, count(*) AS c FROM cy GROUP BY ALL) SELECT t, cluster, {R('c / sum(c) OVER (PARTITION BY t)', 'share')} FROM s")
def contingency(spark, d):
    return rounded(flow.contingency(_customer_years(spark, d)))


@query(f"SELECT c_mktsegment, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()', 'share')} FROM customer GROUP BY c_mktsegment")
def composition(spark, d):
    return rounded(flow.composition(table(spark, d, "customer", ["c_mktsegment"]), "c_mktsegment"))


# ---- features


@query(f"WITH {_EXPR} SELECT obs, count(*) FILTER (x > 0) AS n FROM xp GROUP BY obs")
def expression_num_genes(spark, d):
    return statistics.expressed(expression(spark, d))


_CORR = f"ys AS (SELECT DISTINCT xp.obs, c_acctbal AS y FROM xp JOIN customer ON obs = c_custkey), vs AS (SELECT DISTINCT var FROM xp), gd AS (SELECT vs.var, ys.obs, ys.y, coalesce(xp.x, 0) AS x FROM vs CROSS JOIN ys LEFT JOIN xp ON xp.var = vs.var AND xp.obs = ys.obs), cr AS (SELECT var, count(*) AS n, covar_samp(x, y) / (stddev_pop(x) * stddev_pop(y)) AS corr FROM gd GROUP BY var)"


def _balance(spark: SparkSession, d: str, x: DataFrame) -> DataFrame:
    customers = table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    return x.select("obs").distinct().join(customers, F.col("obs") == F.col("c_custkey")).select("obs", F.lit("balance").alias("lineage"), F.col("c_acctbal").alias("y"))


@query(f"WITH {_EXPR}, {_CORR} SELECT var, 'balance' AS lineage, {R('corr', 'corr')}, n FROM cr")
def lineage_drivers_corr(spark, d):
    x = expression(spark, d)
    return rounded(statistics.correlations(x, _balance(spark, d, x)))


_ERFC = "1 - 2 / sqrt(pi()) * exp(-u * u) * list_sum(list_transform(range(0, 150), lambda n: CASE WHEN u = 0 THEN 0 ELSE exp(2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2) + (2 * n + 1) * ln(u)) END))"


@query(f"WITH {_EXPR}, {_CORR}, z AS (SELECT var, n, corr, atanh(corr) AS a, abs(atanh(corr)) * sqrt(n - 3) / sqrt(2) AS u FROM cr), pv AS (SELECT *, {_ERFC} AS p FROM z), q AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS r FROM pv) SELECT var, 'balance' AS lineage, {R('corr', 'corr')}, n, {R('p', 'pval')}, {R('tanh(a - 1.959963984540054 / sqrt(n - 3))', 'ci_low')}, {R('tanh(a + 1.959963984540054 / sqrt(n - 3))', 'ci_high')}, {R('least(1, min(r) OVER (ORDER BY p DESC))', 'qval')} FROM q")
def lineage_drivers_fisher(spark, d):
    x = cut(expression(spark, d))
    return rounded(statistics.fisher(statistics.correlations(x, _balance(spark, d, x))))


@query()
def permutation_test(spark, d):
    x = cut(expression(spark, d))
    return rounded(statistics.permutation_test(x, cut(_balance(spark, d, x)), 20, 3))


@query(f"WITH {_EXPR}, ct AS (SELECT obs, count(*) FILTER (x > 0)::DOUBLE AS y FROM xp GROUP BY obs), vs AS (SELECT DISTINCT var FROM xp), gd AS (SELECT vs.var, ct.obs, ct.y, coalesce(xp.x, 0) AS x FROM vs CROSS JOIN ct LEFT JOIN xp ON xp.var = vs.var AND xp.obs = ct.obs), cr AS (SELECT var, covar_samp(x, y) / (stddev_pop(x) * stddev_pop(y)) AS corr FROM gd GROUP BY var), tp AS (SELECT var FROM cr ORDER BY corr DESC, var LIMIT 10), sc AS (SELECT obs, avg(x) AS r FROM gd WHERE var IN (SELECT var FROM tp) GROUP BY obs), s AS (SELECT obs, (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) AS s FROM sc) SELECT obs, {R('s', 'score')}, {R('1 - s', 'pseudotime')} FROM s")
def cytotrace(spark, d):
    return rounded(statistics.cytotrace(cut(expression(spark, d)), 10))


_SIZES = "sz AS (SELECT obs, sum(x) AS s FROM xp GROUP BY obs), vs AS (SELECT DISTINCT var FROM xp)"


@query(f"WITH {_NATIONS}, {_SIZES}, qt AS (SELECT sz.obs, quantile_cont(coalesce(xp.x, 0) / sz.s, 0.75) AS f FROM sz CROSS JOIN vs LEFT JOIN xp ON xp.obs = sz.obs AND xp.var = vs.var GROUP BY sz.obs) SELECT obs, {R('f / exp(avg(ln(f)) OVER ())', 'factor')} FROM qt")
def norm_factors_uq(spark, d):
    return rounded(statistics.factors_uq(cut(nations(spark, d))))


@query(f"WITH {_NATIONS}, {_SIZES}, fu AS (SELECT var, exp(avg(ln(x))) AS g FROM xp WHERE x > 0 GROUP BY var HAVING count(*) = (SELECT count(*) FROM sz)), md AS (SELECT obs, quantile_cont(x / g, 0.5) AS m FROM xp JOIN fu USING (var) GROUP BY obs), ff AS (SELECT obs, m / s AS f FROM md JOIN sz USING (obs)) SELECT obs, {R('f / exp(avg(ln(f)) OVER ())', 'factor')} FROM ff")
def norm_factors_rle(spark, d):
    return rounded(statistics.factors_rle(cut(nations(spark, d))))


def _average_rank(x: str) -> str:
    return f"rank() OVER (PARTITION BY obs ORDER BY {x}) + (count(*) OVER (PARTITION BY obs, {x}) - 1) / 2.0"


@query(f"WITH {_NATIONS}, {_SIZES}, qt AS (SELECT sz.obs, quantile_cont(coalesce(xp.x, 0) / sz.s, 0.75) AS f FROM sz CROSS JOIN vs LEFT JOIN xp ON xp.obs = sz.obs AND xp.var = vs.var GROUP BY sz.obs), rf AS (SELECT obs AS ref FROM qt ORDER BY abs(f - (SELECT avg(f) FROM qt)), obs LIMIT 1), b AS (SELECT xp.obs, log2((xp.x / sz.s) / (r.x / rs.s)) AS m, (log2(xp.x / sz.s) + log2(r.x / rs.s)) / 2 AS a, (sz.s - xp.x) / sz.s / xp.x + (rs.s - r.x) / rs.s / r.x AS v FROM xp JOIN sz USING (obs) CROSS JOIN rf JOIN xp r ON r.obs = rf.ref AND r.var = xp.var JOIN sz rs ON rs.obs = rf.ref WHERE xp.x > 0 AND r.x > 0), k AS (SELECT *, count(*) OVER (PARTITION BY obs) AS n, {_average_rank('m')} AS rm, {_average_rank('a')} AS ra FROM b), f AS (SELECT obs, pow(2, sum(m / v) / sum(1 / v)) AS f FROM k WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY obs), w AS (SELECT sz.obs, coalesce(f.f, 1) AS f FROM sz LEFT JOIN f USING (obs)) SELECT obs, {R('f / exp(avg(ln(f)) OVER ())', 'factor')} FROM w")
def norm_factors_tmm(spark, d):
    return rounded(statistics.factors_tmm(cut(nations(spark, d))))


@query("SELECT l_orderkey, l_linenumber, rank() OVER w + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS average, rank() OVER w::DOUBLE AS min, (rank() OVER w + count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1)::DOUBLE AS max, dense_rank() OVER w::DOUBLE AS dense FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)".replace("rank() OVER w::DOUBLE", "(rank() OVER w)::DOUBLE").replace("dense_(rank() OVER w)::DOUBLE", "(dense_rank() OVER w)::DOUBLE"))
def rank_methods(spark, d):
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
    return rows.select("l_orderkey", "l_linenumber", *[statistics.ranks(F.col("l_quantity"), F.col("l_suppkey"), m).alias(m) for m in ("average", "min", "max", "dense")])


# ---- time


@query(f"WITH {_DAYS} SELECT var, t, {R('(sum(y) OVER (PARTITION BY var ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(3 - n, 0) * first_value(y) OVER (PARTITION BY var ORDER BY t) + greatest(2 - (c - n), 0) * last_value(y) OVER (PARTITION BY var ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5', 'smooth')} FROM (SELECT *, row_number() OVER (PARTITION BY var ORDER BY t) AS n, count(*) OVER (PARTITION BY var) AS c FROM ot)")
def moving_average(spark, d):
    return rounded(flow.moving_average(order_times(spark, d), "var", "t", "y", 5).select("var", "t", "smooth"))


@query(f"WITH {_DAYS}, p AS (SELECT var, min(t) AS peak FROM (SELECT *, max(y) OVER (PARTITION BY var) AS m FROM ot) WHERE y = m GROUP BY var) SELECT var, {R('peak', 'peak')}, row_number() OVER (ORDER BY peak, var) AS nth FROM p")
def peak_order(spark, d):
    return rounded(flow.peaks(order_times(spark, d)))


@query("WITH p AS (SELECT epoch(ts) AS t, event_id AS v FROM events), g AS (SELECT lo + (hi - lo) * k / 50 AS g FROM (SELECT min(t) AS lo, max(t) AS hi FROM p), range(0, 51) r(k)), c AS (SELECT g, t, v, row_number() OVER (PARTITION BY g ORDER BY abs(t - g), t DESC) AS r FROM g CROSS JOIN (SELECT t, max(v) AS v FROM p GROUP BY t)) SELECT round(g, 3) AS g, round(t, 3) AS t FROM c WHERE r = 1")
def nearest_asof(spark, d):
    events = table(spark, d, "events", ["ts", "event_id"]).select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("v"))
    ends = events.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(50))).alias("k"), "lo", "hi").select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / 50).alias("g"))
    return flow.nearest_in_time(events, grid).select(F.round("g", 3).alias("g"), F.round("t", 3).alias("t"))


@query(f"WITH {_DAYS} SELECT var, unnest(range(0, 6)) AS k, {R('unnest(quantile_cont(t, [0, 0.2, 0.4, 0.6, 0.8, 1]))', 'knot')} FROM ot GROUP BY var")
def knot_locations(spark, d):
    return rounded(order_times(spark, d).groupBy("var").agg(F.expr("percentile(t, array(0D, 0.2D, 0.4D, 0.6D, 0.8D, 1D))").alias("q")).select("var", F.posexplode("q").alias("k", "knot")))


@query(f"WITH {_DAYS}, s AS (SELECT var, regr_slope(y, t) AS sl, regr_intercept(y, t) AS b, count(*) AS n, avg(t) AS c, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy FROM ot GROUP BY var), l AS (SELECT var, t, b + sl * t AS y, sqrt((syy - sl * sxy) / (n - 2)) * sqrt(1 + 1.0 / n + (t - c) ** 2 / sxx) / 2 AS h FROM ot JOIN s USING (var)) SELECT var, t, round(y, 3) AS y, round(y - h, 3) AS low, round(y + h, 3) AS high FROM l")
def default_ci(spark, d):
    return trends.linear_interval(order_times(spark, d)).select("var", "t", *[F.round(c, 3).alias(c) for c in ("y", "low", "high")])


@query()
def gam_trend(spark, d):
    cells = order_times(spark, d).select("var", F.lit("all").alias("lineage"), "t", "y", F.lit(1.0).alias("w"))
    return rounded(trends.fit_trends(cells, 40))


@query()
def gam_trend_by_sums(spark, d):
    cells = order_times(spark, d).select("var", F.lit("all").alias("lineage"), "t", "y", F.lit(1.0).alias("w"))
    return rounded(trends.fit_trends_by_sums(cells, 40))


@query()
def gam_trend_gamma(spark, d):
    cells = order_times(spark, d).select("var", F.lit("all").alias("lineage"), "t", "y", F.lit(1.0).alias("w"))
    return rounded(additive.predict(additive.fit(cells, penalty=[0.1, 0.6, 5.0]), n_points=40))


@query()
def quantity_trend_negative_binomial(spark, d):
    lines = table(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_discount"])
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    cells = lines.select(F.col("l_returnflag").alias("var"), F.col("l_linestatus").alias("lineage"), days.alias("t"), F.col("l_quantity").cast("double").alias("y"), F.lit(1.0).alias("w"), F.ln(1 - F.col("l_discount").cast("double")).alias("offset"))
    return rounded(additive.predict(additive.fit(cells, "negative_binomial"), n_points=20))


@query(f"WITH {_YEARS}, l AS (SELECT DISTINCT t FROM cy) SELECT t AS src, lead(t) OVER (ORDER BY t) AS tgt FROM l QUALIFY tgt IS NOT NULL")
def level_pairs(spark, d):
    return labels.level_pairs(_customer_years(spark, d))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BUILDING or MACHINERY' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'AUTOMOBILE' END AS c_mktsegment FROM customer")
def combine_categories(spark, d):
    return labels.combine(table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), "c_mktsegment", ["BUILDING, MACHINERY", "AUTOMOBILE"])


# ---- spectra


@query()
def macrostate_memberships(spark, d):
    edges = cut(kernels.connectivity(graph(spark, d)))
    chi, _, _ = macrostates.macrostates(edges, 3)
    return rounded(chi)


# ---- features and drivers, further


def _missing(spark: SparkSession, d: str) -> DataFrame:
    """Embedding entries as velocities, those of a feature's very large values missing."""
    return points(spark, d).select(F.col("i").alias("obs"), F.posexplode("x").alias("var", "v")).withColumn("v", F.when(F.col("v") <= 0.4, F.col("v")))


@query(f"WITH {_CELLS}, l AS (SELECT i AS obs, unnest(range(0, len(x))) AS var, unnest(x) AS v FROM e) SELECT obs, var, {R('v', 'v')} FROM l WHERE var NOT IN (SELECT var FROM l WHERE v > 0.4)")
def velocity_without_missing_features(spark, d):
    return rounded(statistics.without_missing(_missing(spark, d)))


@query(f"WITH {_EXPR}, {_CORR} SELECT 'balance' AS lineage, var, {R('corr', 'corr')}, row_number() OVER (ORDER BY corr DESC, var) AS nth FROM cr QUALIFY nth <= 8")
def top_drivers(spark, d):
    x = cut(expression(spark, d))
    return rounded(statistics.top_drivers(statistics.correlations(x, _balance(spark, d, x)), 8))


@query(f"WITH {_EXPR}, {_CORR}, y2 AS (SELECT DISTINCT xp.obs, c_nationkey::DOUBLE AS y FROM xp JOIN customer ON obs = c_custkey), g2 AS (SELECT vs.var, y2.y, coalesce(xp.x, 0) AS x FROM vs CROSS JOIN y2 LEFT JOIN xp ON xp.var = vs.var AND xp.obs = y2.obs), c2 AS (SELECT var, count(*) AS n, covar_samp(x, y) / (stddev_pop(x) * stddev_pop(y)) AS corr FROM g2 GROUP BY var) SELECT var, {R('cr.corr', 'x')}, {R('c2.corr', 'y')}, CASE WHEN var LIKE 'Brand#1_' THEN 'first' END AS gene_set FROM cr JOIN c2 USING (var)")
def driver_pairs(spark, d):
    x = cut(expression(spark, d))
    customers = table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    nation = x.select("obs").distinct().join(customers, F.col("obs") == F.col("c_custkey")).select("obs", F.lit("nation").alias("lineage"), F.col("c_nationkey").cast("double").alias("y"))
    drivers = statistics.correlations(x, _balance(spark, d, x).unionByName(nation))
    return rounded(statistics.driver_pairs(cut(drivers), "balance", "nation", {"first": [f"Brand#1{k}" for k in range(10)]}))


@query(f"SELECT {R('quantile_cont(o_totalprice, 0.05)', 'low')}, {R('quantile_cont(o_totalprice, 0.95)', 'high')} FROM orders")
def clipping_ends(spark, d):
    return rounded(statistics.percentile_ends(table(spark, d, "orders", ["o_totalprice"]), "o_totalprice", (5, 95)))


@query(f"WITH {_EXPR} SELECT DISTINCT obs, 1.0::DOUBLE AS factor FROM xp")
def norm_factors_none(spark, d):
    return statistics.norm_factors(expression(spark, d), "none")


# ---- fate tables, further


@query(_fate_sql(f"SELECT i, {R('c', 'c')}, {R('a', 'a')} FROM f WHERE label = 1"))
def lineage_pick(spark, d):
    return rounded(lineages.pick(fates(spark, d), FATES, ["c", 0, 2], F.col("label") == 1))


@query(_fate_sql(f"SELECT i, {R('CASE label % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END', 'mixture')} FROM f"))
def lineage_pick_each(spark, d):
    own = fates(spark, d)
    wanted = own.select("i", F.element_at(F.array(*[F.lit(n) for n in FATES]), F.col("label") % 3 + 1).alias("lineage"))
    return rounded(lineages.pick_each(own, FATES, wanted))


@query(_fate_sql(f"SELECT i, {R('-(a * ln(a) + b * ln(b) + c * ln(c))', 'h')}, {R('sqrt(((a - 1 / 3.0) ** 2 + (b - 1 / 3.0) ** 2 + (c - 1 / 3.0) ** 2) / 3)', 's')}, CASE WHEN a >= b AND a >= c THEN 0.0 WHEN b >= c THEN 1.0 ELSE 2.0 END AS top FROM f"))
def lineage_row_reductions(spark, d):
    own, name = cut(fates(spark, d)), "of a, b, c"
    h, s, top = (lineages.reduce_rows(own, FATES, how).withColumnRenamed(f"{how} {name}", c) for how, c in (("entropy", "h"), ("std", "s"), ("argmax", "top")))
    return rounded(h.join(s, "i").join(top, "i"))


@query(_fate_sql(f", l AS (SELECT a, sum(a) OVER () AS s FROM f) SELECT {R('-sum(a / s * ln(a / s))', 'h')}, {R('(SELECT stddev_pop(b) FROM f)', 's')}, (SELECT i FROM f ORDER BY c DESC, i LIMIT 1) AS top FROM l"))
def lineage_column_reductions(spark, d):
    own = cut(fates(spark, d))
    h, s, top = (lineages.reduce_columns(own, [n], how).withColumnRenamed(f"{how} of {n}", c) for n, how, c in (("a", "entropy", "h"), ("b", "std", "s"), ("c", "argmax", "top")))
    return rounded(h.crossJoin(s).crossJoin(top))  # one row each


@query(_fate_sql(f", g AS (SELECT label, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM f GROUP BY label), l AS (SELECT label, 'a' AS lineage, a / (a + b + c) AS p FROM g UNION ALL SELECT label, 'b', b / (a + b + c) FROM g UNION ALL SELECT label, 'c', c / (a + b + c) FROM g) SELECT label, lineage, {R('p', 'share')} FROM l"))
def lineage_shares(spark, d):
    return rounded(lineages.shares(fates(spark, d), FATES, "mean", "label"))


@query(_fate_sql(f"SELECT i, {R('a / sqrt(sum(a * a) OVER ())', 'a')}, {R('b / sqrt(sum(b * b) OVER ())', 'b')}, {R('c / sqrt(sum(c * c) OVER ())', 'c')} FROM f"))
def lineage_column_normalize(spark, d):
    return rounded(lineages.column_normalize(fates(spark, d).select("i", *FATES), FATES))


@query(_fate_sql(f"SELECT i, {R('exp(5 * a) / (exp(5 * a) + exp(5 * b) + exp(5 * c))', 'a')}, {R('exp(5 * b) / (exp(5 * a) + exp(5 * b) + exp(5 * c))', 'b')}, {R('exp(5 * c) / (exp(5 * a) + exp(5 * b) + exp(5 * c))', 'c')} FROM f"))
def lineage_softmax(spark, d):
    return rounded(lineages.softmax_rows(fates(spark, d), FATES, 5.0))


@query(_fate_sql(f"SELECT i, label, {R('(a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ())', 'a')} FROM f"))
def lineage_min_max(spark, d):
    return rounded(lineages.min_max(fates(spark, d).select("i", "label", "a"), ["a"]))


@query(_fate_sql(f", x AS (SELECT a, row_number() OVER (ORDER BY a, i) AS r FROM f), y AS (SELECT b, row_number() OVER (ORDER BY b, i) AS r FROM f) SELECT {R('avg(abs(a - b))', 'distance')} FROM x JOIN y USING (r)"))
def lineage_wasserstein(spark, d):
    return rounded(lineages.wasserstein(fates(spark, d), "a", "b"))


@query(_fate_sql(f", p AS (SELECT 0 AS k, 1 AS n, 1 - corr(a, b) AS d FROM f UNION ALL SELECT 0, 2, 1 - corr(a, c) FROM f UNION ALL SELECT 1, 2, 1 - corr(b, c) FROM f) SELECT k, n, {R('d', 'd')} FROM p"))
def lineage_distances(spark, d):
    found = lineages.distances(fates(spark, d), FATES)
    return rounded(spark.createDataFrame([(k, n, found[k][n]) for k in range(3) for n in range(k + 1, 3)], "k int, n int, d double"))


@query(_fate_sql(f"SELECT i, {R('ln(a / (1 - a) + 1e-12)', 'log_odds')}, {R('b', 'value')}, b > 0.4 AS above FROM f"))
def log_odds_above_threshold(spark, d):
    own = fates(spark, d)
    return rounded(lineages.above_threshold(lineages.log_odds(own, "a"), own.select("i", F.col("b").alias("value")), 0.4))


_DISCRETE = "l AS (SELECT i, 0 AS o, 'a' AS state, a AS p FROM f UNION ALL SELECT i, 1, 'b', b FROM f UNION ALL SELECT i, 2, 'c', c FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, i) AS r FROM l), u AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p DESC, o) AS z FROM t WHERE r <= 20), ds AS (SELECT i, state FROM u WHERE z = 1)"


@query(_fate_sql(f", {_DISCRETE}, ct AS (SELECT state, label::VARCHAR AS label, count(*) AS n FROM ds JOIN f USING (i) GROUP BY ALL), b AS (SELECT state, label FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, label) AS r FROM ct) WHERE r = 1), nm AS (SELECT state, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || '_' || row_number() OVER (PARTITION BY label ORDER BY state) ELSE label END AS name FROM b) SELECT i AS obs, name AS state FROM ds JOIN nm USING (state)"))
def states_named_by_label(spark, d):
    own = fates(spark, d)
    found = cut(states.from_memberships(own, FATES, 20))
    return states.named(found, own.select(F.col("i").alias("obs"), "label"), "label")


@query(_fate_sql("SELECT i AS obs, label::VARCHAR AS state FROM f WHERE label IN (1, 2)"))
def states_from_clusters(spark, d):
    return states.from_clusters(fates(spark, d).select(F.col("i").alias("obs"), "label"), "label", [1, 2])


@query(f"WITH RECURSIVE {_KNN}, ed AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM knn WHERE d < 0.6 UNION ALL SELECT j, i FROM knn WHERE d < 0.6)), rc AS (SELECT i, i AS j FROM ed UNION SELECT rc.i, ed.j FROM rc JOIN ed ON rc.j = ed.i), cl AS (SELECT i, min(j) AS class FROM rc GROUP BY i) SELECT class, count(*) AS n, min(i) AS first, row_number() OVER (ORDER BY count(*) DESC, min(i)) AS nth FROM cl GROUP BY class")
def classes_by_size(spark, d):
    return states.by_size(chains.components(neighbours(spark, d).filter("d < 0.6")).select("node", F.col("label").alias("class")))


# ---- chains, flows and times, further


@query("SELECT c_custkey AS obs FROM customer WHERE c_acctbal BETWEEN 0 AND 500")
def walk_cells(spark, d):
    return chains.walk_cells(table(spark, d, "customer").withColumnRenamed("c_custkey", "obs"), {"c_acctbal": (500, 0)})


@query(f"WITH {_COUPLED}, cs AS (SELECT * FROM cy WHERE cluster IN ('BUILDING', 'MACHINERY') AND t IN (1995, 1996, 1997)), s AS (SELECT a.t AS t_from, b.t AS t_to, a.cluster AS src, b.cluster AS dst, sum(w) AS w FROM cp JOIN cs a ON cp.i = a.i JOIN cs b ON cp.j = b.i GROUP BY ALL) SELECT t_from, t_to, src, dst, {R('w / sum(w) OVER (PARTITION BY t_from, t_to, src)', 'w')} FROM s")
def cluster_flow_restricted(spark, d):
    edges, cells = flow.restricted(_couplings(spark, d).select("i", "j", "w"), _customer_years(spark, d).select("i", "cluster", "t"), ["BUILDING", "MACHINERY"], [1995, 1996, 1997])
    return rounded(flow.flow(edges, cells))


@query(f"WITH {_COUPLED} SELECT cp.i, cp.j, a.cluster AS src, b.cluster AS dst, {R('w', 'w')} FROM cp JOIN cy a ON cp.i = a.i JOIN cy b ON cp.j = b.i WHERE a.t = 1995 AND b.t = 1996 AND a.cluster = 'BUILDING'")
def flow_block(spark, d):
    return rounded(flow.flow_block(_couplings(spark, d), _customer_years(spark, d), 1995, 1996, "BUILDING"))


@query(f"WITH {_COUPLED}, s AS (SELECT a.t AS t, a.cluster AS src, b.cluster AS dst, sum(w) AS w FROM cp JOIN cy a ON cp.i = a.i JOIN cy b ON cp.j = b.i GROUP BY ALL), n AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY t, src) AS w FROM s), o AS (SELECT dst AS cluster, sum(w) AS total, row_number() OVER (ORDER BY sum(w) DESC, dst) - 1 AS k FROM n WHERE src = 'BUILDING' AND dst <> 'BUILDING' GROUP BY dst) SELECT cluster, {R('total', 'total')}, CASE WHEN k % 2 = 0 THEN 'above' ELSE 'below' END AS side, (k // 2)::INTEGER AS place FROM o")
def flow_order(spark, d):
    flows = flow.flow(_couplings(spark, d).select("i", "j", "w"), _customer_years(spark, d).select("i", "cluster", "t"))
    return rounded(flow.flow_order(flows, "BUILDING"))


@query()
def smoothed_shares(spark, d):
    return rounded(flow.smoothed_shares(flow.contingency(_customer_years(spark, d)), 20))


@query(f"WITH {_CELLS}, tm AS (SELECT i, x[1] AS t FROM e) SELECT i, {R('max(t) OVER () - t', 't')} FROM tm")
def pseudotime_backward(spark, d):
    return rounded(kernels.times_of(times(spark, d), "t", backward=True))


@query(f"WITH {_YEARS} SELECT i, cluster, nation, c, max(t) OVER () - t + min(t) OVER () AS t FROM cy")
def inverted_time(spark, d):
    return labels.inverted_time(_customer_years(spark, d)).select("i", "cluster", "nation", "c", "t")


@query(f"WITH {_YEARS}, l AS (SELECT DISTINCT t * 3 AS t FROM cy), g AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS g FROM l) SELECT t, {R('t / (SELECT min(g) FROM g)', 'scaled')} FROM l")
def unit_time_gaps(spark, d):
    return rounded(labels.unit_gaps(_customer_years(spark, d).select((F.col("t") * 3).alias("t"))))


# ---- kernels, further


_LONG = "lx AS (SELECT g.i, g.j, unnest(range(1, len(v.x) + 1)) AS k, unnest(v.v) AS v, unnest(v.x) AS x, unnest(b.x) AS xj FROM g JOIN cv v ON g.i = v.i JOIN cv b ON g.j = b.i)"


@query(f"WITH {_GRAPH}, {_VEL.split(', dd AS')[0]}, {_LONG}, sc AS (SELECT i, j, sum(v * (xj - x)) AS s FROM lx GROUP BY ALL), ex AS (SELECT i, j, exp(s - max(s) OVER (PARTITION BY i)) AS x FROM sc), p AS (SELECT i, j, x / sum(x) OVER (PARTITION BY i) AS p FROM ex), w AS (SELECT lx.i, lx.j, k, xj - x AS d, abs(v) / 2 AS var, p FROM lx JOIN p USING (i, j)), m AS (SELECT i, k, sum(p * d) AS m, sum(p * d * d) AS q FROM w GROUP BY ALL), r AS (SELECT w.i, w.j, greatest(least(any_value(p) + any_value(p) * sum(((d - m) ** 2 + m * m - q) * var) / 2, 1), 0) AS r FROM w JOIN m USING (i, k) GROUP BY w.i, w.j), z AS (SELECT i, j, r / sum(r) OVER (PARTITION BY i) AS w FROM r) SELECT i, j, {R('w', 'w')} FROM z WHERE w > 0")
def velocity_kernel_stochastic(spark, d):
    cells = moving(spark, d).withColumn("var", F.transform("v", lambda y: F.abs(y) / 2))
    return rounded(kernels.velocity_stochastic(graph(spark, d), cells, width(spark, d) - 1, "dot", 1.0))


@query()
def velocity_kernel_monte_carlo(spark, d):
    cells = moving(spark, d).withColumn("var", F.transform("v", lambda y: F.abs(y) / 2))
    return rounded(kernels.velocity_monte_carlo(graph(spark, d), cells, "correlation", 4.0, 5, 7))


@query(f"WITH {_GRAPH}, tm AS (SELECT i, x[1] AS t FROM e), sf AS (SELECT g.i, g.j, g.w * CASE WHEN a.t > b.t THEN exp(-3 * (a.t - b.t)) ELSE 1 END AS w FROM g JOIN tm a ON g.i = a.i JOIN tm b ON g.j = b.i) SELECT i, j, {R('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM sf")
def pseudotime_custom(spark, d):
    return rounded(kernels.pseudotime(graph(spark, d), times(spark, d), _decay))


def _decay(t, others, weights):
    import numpy as np

    return weights * np.exp(-3 * np.maximum(t - others, 0))


@query(f"WITH {_GRAPH}, {_VEL}, sc AS (SELECT i, j, -sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - d[k]) ** 2))) AS s FROM cc), ex AS (SELECT i, j, exp(s - max(s) OVER (PARTITION BY i)) AS x FROM sc) SELECT i, j, {R('x / sum(x) OVER (PARTITION BY i)', 'w')} FROM ex")
def velocity_kernel_custom(spark, d):
    gap = lambda v, w: -F.sqrt(F.aggregate(F.zip_with(v, w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y))
    return rounded(kernels.velocity(graph(spark, d), moving(spark, d), gap, 1.0))


@query(f"WITH ny AS (SELECT DISTINCT c_nationkey * 10000 + year(o_orderdate) AS i, year(o_orderdate) AS t, c_nationkey AS c FROM orders JOIN customer ON o_custkey = c_custkey), nz AS (SELECT a.t AS src, b.t AS tgt, a.i, b.i AS j, 1.0 / (1 + abs(a.c - b.c)) AS w FROM ny a JOIN ny b ON b.t = a.t + 1 WHERE abs(a.c - b.c) <= 3 AND a.i % 7 <> 0), lv AS (SELECT DISTINCT src, tgt FROM nz), em AS (SELECT lv.src, lv.tgt, ny.i FROM ny JOIN lv ON ny.t = lv.src WHERE NOT EXISTS (SELECT 1 FROM nz WHERE nz.i = ny.i)) SELECT src, tgt, i, j, {R('w', 'w')} FROM nz UNION ALL SELECT em.src, em.tgt, em.i, ny.i, round(1.0 / count(*) OVER (PARTITION BY em.i) + {OFF:.10f}, 6) + 0.0 FROM em JOIN ny ON ny.t = em.tgt")
def couplings_completed(spark, d):
    """Of nations in years, coupled to those of near keys a year later; those of every seventh key have no entries and so move evenly."""
    cells = _customer_years(spark, d).select((F.col("nation") * 10_000 + F.col("t")).alias("i"), "t", F.col("nation").alias("c")).distinct()
    later = cells.select(F.col("i").alias("j"), (F.col("t") - 1).alias("t"), F.explode(F.sequence(F.col("c") - 3, F.col("c") + 3)).alias("c"), F.col("c").alias("cj"))
    own = cells.filter("i % 7 <> 0").join(later, ["t", "c"]).select(F.col("t").alias("src"), (F.col("t") + 1).alias("tgt"), "i", "j", (1 / (1 + F.abs(F.col("c") - F.col("cj")))).alias("w"))
    return rounded(kernels.complete_couplings(own, cells.select("i", "t")))


# ---- spectra and trends, further


@query(f"WITH {_CELLS}, q AS (SELECT quantile_cont(abs(x[1]), 0.98) AS a, quantile_cont(abs(x[2]), 0.98) AS b FROM e) SELECT i FROM e, q WHERE abs(x[1]) >= a OR abs(x[2]) >= b")
def outer_cells(spark, d):
    return spectral.outer_cells(points(spark, d).select("i", F.col("x")[0].alias("v0"), F.col("x")[1].alias("v1")), ["v0", "v1"], 98)


@query(f"WITH {_CELLS}, a AS (SELECT i, abs(x[1]) AS a, abs(x[2]) AS b FROM e), c AS (SELECT i, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) / 0.8 AS c FROM a) SELECT i, {R('c / max(c) OVER ()', 'p')} FROM c")
def spectral_terminal_probability(spark, d):
    rows = points(spark, d).select("i", F.col("x")[0].alias("v0"), F.col("x")[1].alias("v1"))
    return rounded(spectral.terminal_probability(rows, ["v0", "v1"], [1.0, 0.8]))


@query()
def label_propagation(spark, d):
    return spectral.propagated(graph(spark, d))


@query()
def modularity_communities(spark, d):
    return communities.communities(graph(spark, d))


@query()
def spectral_terminal_states(spark, d):
    edges = cut(kernels.connectivity(graph(spark, d)))
    return spectral.terminal_states(edges, 3, percentile=90)[0]


@query()
def macrostate_memberships_crisp(spark, d):
    edges = cut(kernels.connectivity(graph(spark, d)))
    return rounded(macrostates.macrostates(edges, 3, method="crisp")[0])


def _trend_cells(spark: SparkSession, d: str) -> DataFrame:
    own = fates(spark, d)
    x = points(spark, d).select(F.col("i").alias("obs"), F.posexplode("x").alias("var", "x"))  # entries are the features
    return trends.trend_cells(x, own.select("i", *FATES), times(spark, d), FATES)


@query()
def gene_trends(spark, d):
    return rounded(trends.succeeded(trends.fit_trends(_trend_cells(spark, d), 30)))


@query()
def trend_clusters(spark, d):
    found = trends.fit_trends(_trend_cells(spark, d).filter("lineage = 'a'"), 30)
    return trends.cluster_trends(cut(trends.succeeded(found)), neighbours=4)


@query(f"WITH {_DAYS}, z AS (SELECT var, t, y, row_number() OVER (PARTITION BY var ORDER BY t) AS nth FROM ot) SELECT CASE WHEN var < '3' THEN 0 ELSE 1 END AS cluster, nth, {R('avg(t)', 't')}, {R('avg(y)', 'mean')}, {R('stddev_pop(y)', 'sd')} FROM z GROUP BY ALL")
def trend_cluster_means(spark, d):
    rows = order_times(spark, d)
    groups = rows.select("var").distinct().withColumn("cluster", F.when(F.col("var") < "3", 0).otherwise(1))
    return rounded(trends.cluster_means(rows, groups).withColumn("nth", F.col("nth").cast("long")))
