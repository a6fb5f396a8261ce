"""Registered queries of the experiment-analytics operators and their SQL twins.

Treatments are derived from the tables: orders are dealt to arms by customer number. Doubles are
rounded on both sides, aggregates to 4 digits and statistics to 6.
"""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import RoleFrame
from ..operators import compare, matching, multitest, prep, split, stats, variance
from ..roles import FeatureRole, GroupingRole, StratificationRole, TargetRole, TreatmentRole
from ..streaming import windows
from ..streaming.moments import windowed_moments
from . import oracles, reports, shells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def customers(spark: SparkSession, sf_dir: str) -> RoleFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return RoleFrame(df, {StratificationRole(): ["c_mktsegment"], TargetRole(): ["c_acctbal"]}, "c_custkey")


def suppliers(spark: SparkSession, sf_dir: str) -> RoleFrame:
    return RoleFrame(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), {}, "s_suppkey")


def orders(spark: SparkSession, sf_dir: str, arms: int = 3) -> RoleFrame:
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % arms).alias("treat"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return RoleFrame(df, {TreatmentRole(): ["treat"], TargetRole(): ["price", "priority"]}, "id")


def orders_sql(arms: int = 3) -> str:
    return f"o AS (SELECT o_orderkey AS id, o_custkey % {arms} AS treat, o_totalprice AS price, CAST(year(o_orderdate) AS DOUBLE) AS year, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: id, treat (two arms), total, qty (a covariate of it)."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("qty"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("treat"))
    return o.join(lines, F.col("id") == F.col("l_orderkey")).select("id", "treat", "total", "qty")


BASKETS = "b AS (SELECT o_orderkey AS id, o_custkey % 2 AS treat, total, qty FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf_dir: str) -> RoleFrame:
    return RoleFrame(read(spark, sf_dir, "lineitem").select(*LINE), {FeatureRole(): LINE})


# ---- projection, selection, element-wise -------------------------------------------------------


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def select_cols(spark, sf):
    return suppliers(spark, sf)[["s_acctbal"]].df


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 10")
def filter_mask(spark, sf):
    c = customers(spark, sf)
    return c.where((F.col("c_acctbal") > 5000) & (F.col("c_nationkey") < 10)).df


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def filter_mask_frame(spark, sf):
    c = customers(spark, sf)
    return c[c["c_acctbal"] > 5000].df


@query("SELECT s_suppkey, round(s_acctbal * 2 + 1, 4) AS s_acctbal FROM supplier")
def arith_ops(spark, sf):
    return rounded((suppliers(spark, sf)["s_acctbal"] * 2 + 1).df, 4)


@query("SELECT s_suppkey, round(100.0 / nullif(s_acctbal, 0), 6) + 0.0 AS s_acctbal FROM supplier")
def right_arith(spark, sf):
    return rounded((100.0 / suppliers(spark, sf)["s_acctbal"]).df)


@query("SELECT s_suppkey, CAST(floor(s_acctbal / 7) AS DOUBLE) AS d, round(s_acctbal - 7 * floor(s_acctbal / 7), 4) AS m FROM supplier")
def floordiv_mod(spark, sf):
    s = suppliers(spark, sf)["s_acctbal"]
    return rounded((s // 7).rename({"s_acctbal": "d"}).add_column((s % 7).rename({"s_acctbal": "m"})).df, 4)


@query("SELECT s_suppkey, (s_acctbal > 1000) <> (s_acctbal > 5000) AS s_acctbal FROM supplier")
def xor_ops(spark, sf):
    s = suppliers(spark, sf)["s_acctbal"]
    return ((s > 1000) ^ (s > 5000)).df


@query("SELECT s_suppkey, round(power(s_acctbal / 1000, 3), 6) + 0.0 AS s_acctbal FROM supplier")
def power_ops(spark, sf):
    return rounded(((suppliers(spark, sf)["s_acctbal"] / 1000) ** 3).df)


@query("SELECT s_suppkey, CASE WHEN s_suppkey IN (1, 2, 3) THEN -1.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def loc_set(spark, sf):
    return suppliers(spark, sf)["s_acctbal"].loc_set([1, 2, 3], "s_acctbal", -1.0).df


@query("SELECT s_suppkey, s_acctbal > lead_ AS s_acctbal FROM (SELECT s_suppkey, s_acctbal, s_acctbal * 0.5 + 1000 AS lead_ FROM supplier)")
def compare_frames(spark, sf):
    s = suppliers(spark, sf)["s_acctbal"]
    return (s > s * 0.5 + 1000).df


@query("WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey END AS s_nationkey FROM supplier) SELECT s_suppkey, s_acctbal, s_nationkey FROM h WHERE s_acctbal IS NOT NULL OR s_nationkey IS NOT NULL")
def dropna_all(spark, sf):
    df = suppliers(spark, sf).df.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("s_acctbal"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return RoleFrame(df, {}, "s_suppkey").dropna("all").df


@query("SELECT s_suppkey, CAST(CAST(trunc(s_acctbal) AS BIGINT) AS VARCHAR) AS s_acctbal, s_nationkey FROM supplier")
def astype_chain(spark, sf):
    s = suppliers(spark, sf).astype({"s_acctbal": int}).astype({"s_acctbal": str})
    return s.select(["s_acctbal", "s_nationkey"]).df


@query("SELECT s_suppkey, s_acctbal >= 4500 AS s_acctbal FROM supplier")
def compare_ops(spark, sf):
    return (suppliers(spark, sf)["s_acctbal"] >= 4500).df


@query("SELECT s_suppkey, (s_acctbal > 1000 AND s_acctbal < 5000) OR NOT s_acctbal > -500 AS s_acctbal FROM supplier")
def logical_ops(spark, sf):
    s = suppliers(spark, sf)["s_acctbal"]
    return (((s > 1000) & (s < 5000)) | ~(s > -500)).df


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS c_mktsegment FROM customer")
def isin_mask(spark, sf):
    return customers(spark, sf)["c_mktsegment"].isin(["BUILDING", "MACHINERY"]).df


@query("SELECT s_suppkey, round(abs(-s_acctbal), 2) AS s_acctbal FROM supplier")
def unary_ops(spark, sf):
    return rounded(abs(-suppliers(spark, sf)["s_acctbal"]).df, 2)


@query("SELECT s_suppkey, round_even(s_acctbal, 0) + 0.0 AS s_acctbal FROM supplier")
def round_even(spark, sf):
    return rounded(suppliers(spark, sf)["s_acctbal"].round(0).df, 2)


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 6) + 0.0 END AS s_acctbal FROM supplier")
def log_values(spark, sf):
    return rounded(suppliers(spark, sf)["s_acctbal"].log().df)


def _holes(spark, sf) -> RoleFrame:
    s = suppliers(spark, sf)["s_acctbal"]
    return s.with_column("s_acctbal", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")))


HOLES = "h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier)"


@query(f"WITH {HOLES} SELECT s_suppkey, coalesce(s_acctbal, 0.5) AS s_acctbal FROM h")
def fillna_const(spark, sf):
    return _holes(spark, sf).fillna({"s_acctbal": 0.5}).df


@query(f"WITH {HOLES} SELECT s_suppkey, last_value(s_acctbal IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS s_acctbal FROM h")
def ffill(spark, sf):
    return _holes(spark, sf).fillna(method="ffill").df


@query(f"WITH {HOLES} SELECT s_suppkey, first_value(s_acctbal IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s_acctbal FROM h")
def bfill(spark, sf):
    return _holes(spark, sf).fillna(method="bfill").df


@query(f"WITH {HOLES} SELECT * FROM h WHERE s_acctbal IS NOT NULL")
def dropna_any(spark, sf):
    return _holes(spark, sf).dropna().df


@query(f"WITH {HOLES} SELECT s_suppkey, s_acctbal IS NULL AS s_acctbal FROM h")
def isna_mask(spark, sf):
    return _holes(spark, sf).isna().df


@query(f"WITH {HOLES} SELECT count(*) - count(s_acctbal) AS s_acctbal FROM h")
def na_counts(spark, sf):
    return _holes(spark, sf).na_counts().df


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def replace_values(spark, sf):
    return customers(spark, sf)["c_mktsegment"].replace({"BUILDING": "B", "MACHINERY": "M"}).df


@query("SELECT c_custkey, regexp_replace(c_mktsegment, '[AEIOU]', '_', 'g') AS c_mktsegment FROM customer")
def replace_regex(spark, sf):
    return customers(spark, sf)["c_mktsegment"].replace("[AEIOU]", "_", regex=True).df


@query("SELECT s_suppkey AS k, s_nationkey, s_acctbal AS balance FROM supplier")
def rename(spark, sf):
    return suppliers(spark, sf).rename({"s_suppkey": "k", "s_acctbal": "balance"}).df


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_acctbal FROM supplier")
def cast(spark, sf):
    return suppliers(spark, sf).astype({"s_nationkey": str}).df


@query("SELECT c_custkey, c_acctbal FROM customer")
def select_dtypes(spark, sf):
    return customers(spark, sf).select_dtypes(include=float).df


@query("SELECT c_custkey, c_acctbal FROM customer")
def filter_labels(spark, sf):
    return customers(spark, sf).filter(like="acct").df


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) WHERE p >= 5 AND p < 15")
def iloc_slice(spark, sf):
    return suppliers(spark, sf).iloc(slice(5, 15)).df


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey IN (1, 3, 7)")
def loc_rows(spark, sf):
    return suppliers(spark, sf).loc([1, 3, 7]).df


@query("SELECT k AS s_suppkey, coalesce(s_nationkey, -1) AS s_nationkey FROM (VALUES (1), (3), (1000000)) v(k) LEFT JOIN supplier ON s_suppkey = k")
def reindex(spark, sf):
    return suppliers(spark, sf)[["s_nationkey"]].reindex([1, 3, 1000000], -1).df


@query("SELECT vec_id, CAST(embedding[1] AS FLOAT) AS embedding_0, CAST(embedding[2] AS FLOAT) AS embedding_1, CAST(embedding[3] AS FLOAT) AS embedding_2 FROM embeddings")
def list_to_columns(spark, sf):
    frame = RoleFrame(read(spark, sf, "embeddings").select("vec_id", "embedding"), {}, "vec_id")
    return frame.list_to_columns("embedding", 3).df


@query("WITH t AS (SELECT r_regionkey AS k, r_name FROM region) SELECT 'r_name' AS key, max(CASE WHEN k = 0 THEN r_name END) AS \"0\", max(CASE WHEN k = 1 THEN r_name END) AS \"1\", max(CASE WHEN k = 2 THEN r_name END) AS \"2\", max(CASE WHEN k = 3 THEN r_name END) AS \"3\", max(CASE WHEN k = 4 THEN r_name END) AS \"4\" FROM t")
def transpose_small(spark, sf):
    return RoleFrame(read(spark, sf, "region").select("r_regionkey", "r_name"), {}, "r_regionkey").transpose().df


@query("SELECT s_suppkey, round(0.5 * s_nationkey + 2 * s_acctbal, 4) AS a, round(-s_nationkey + 0.25 * s_acctbal, 4) AS b FROM supplier")
def dot_product(spark, sf):
    return rounded(suppliers(spark, sf).dot([[0.5, -1.0], [2.0, 0.25]], ["a", "b"]).df, 4)


@query("SELECT s_suppkey, round(s_acctbal / 3, 4) AS s_acctbal FROM supplier")
def map_values(spark, sf):
    return rounded(suppliers(spark, sf)["s_acctbal"].map(lambda v: v / 3).df, 4)


@query("SELECT s_suppkey, s_nationkey, s_acctbal, round(s_nationkey + s_acctbal, 4) AS result FROM supplier")
def apply_rows(spark, sf):
    return rounded(suppliers(spark, sf).apply(lambda r: float(r["s_nationkey"]) + r["s_acctbal"], axis=1).df, 4)


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':3'), c_custkey) AS r FROM customer) WHERE r <= 20")
def sample_exact(spark, sf):
    return customers(spark, sf).sample(n=20, seed=3).df


# ---- joins and sets ----------------------------------------------------------------------------


def _nations(spark, sf) -> RoleFrame:
    """Nations with keys moved on by three, so that either side has rows without a match."""
    return RoleFrame(read(spark, sf, "nation").select((F.col("n_nationkey") + 3).alias("n_nationkey"), "n_name"), {}, "n_nationkey")


def _merge(how: str):
    def run(spark, sf):
        return suppliers(spark, sf).merge(_nations(spark, sf), left_on="s_nationkey", right_on="n_nationkey", how=how).df

    run.__name__ = f"merge_{how}"
    return run


for _how, _join in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():
    query(f"SELECT s_suppkey, s_nationkey, s_acctbal, n_nationkey, n_name FROM supplier {_join} (SELECT n_nationkey + 3 AS n_nationkey, n_name FROM nation) ON s_nationkey = n_nationkey")(_merge(_how))


@query("SELECT a.r_regionkey AS r_regionkey_x, a.r_name AS r_name_x, b.r_regionkey AS r_regionkey_y, b.r_name AS r_name_y FROM region a CROSS JOIN region b")
def merge_cross(spark, sf):
    r = RoleFrame(read(spark, sf, "region").select("r_regionkey", "r_name"), {}, "r_regionkey")
    return r.merge(r, how="cross").df


@query("SELECT s_suppkey, a.s_acctbal AS s_acctbal_x, a.s_acctbal + 1 AS s_acctbal_y FROM supplier a")
def merge_index(spark, sf):
    s = suppliers(spark, sf)["s_acctbal"]
    return s.merge(s + 1).df


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) IN ('1', '2', '5')")
def semi_label_filter(spark, sf):
    return customers(spark, sf).filter(items=[1, 2, 5], axis=0).df


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (2, 4, 6)")
def anti_drop(spark, sf):
    return suppliers(spark, sf).drop(keys=[2, 4, 6]).df


@query("SELECT s_suppkey AS k, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def append_union(spark, sf):
    a = suppliers(spark, sf)[["s_acctbal"]].rename({"s_suppkey": "k", "s_acctbal": "bal"})
    b = customers(spark, sf)[["c_acctbal", "c_mktsegment"]].rename({"c_custkey": "k", "c_acctbal": "bal", "c_mktsegment": "seg"})
    return a.append(b).df


@query("SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, s_acctbal, c_acctbal FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def append_columns(spark, sf):
    return suppliers(spark, sf)[["s_acctbal"]].append(customers(spark, sf)[["c_acctbal"]], axis=1).df


# ---- aggregates --------------------------------------------------------------------------------

MULTI = ("count", "sum", "mean", "min", "max")


@query("SELECT " + ", ".join(f"round({f}({c}), 4) AS {c}_{n}" if n not in ("count",) else f"count({c}) AS {c}_count" for c in LINE for n, f in zip(MULTI, ("count", "sum", "avg", "min", "max"), strict=True)) + " FROM lineitem")
def agg_multi(spark, sf):
    return rounded(lines(spark, sf).agg(MULTI).df, 4)


@query("SELECT " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("l_quantity", "l_discount") for n, f in (("var", "var_samp"), ("std", "stddev_samp"), ("var_pop", "var_pop"), ("std_pop", "stddev_pop"))) + " FROM lineitem")
def var_std(spark, sf):
    return rounded(lines(spark, sf)[["l_quantity", "l_discount"]].agg(("var", "std", "var_pop", "std_pop")).df)


def _pairs_sql(function: str, columns: list[str], table: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({function}({a}, {b}), {digits}) + 0.0 AS value FROM {table}" for a in columns for b in columns)


@query(_pairs_sql("covar_samp", LINE, "lineitem", 3))
def cov_matrix(spark, sf):
    return rounded(lines(spark, sf).cov().df, 3)


@query(_pairs_sql("corr", LINE, "lineitem", 6))
def corr_pearson(spark, sf):
    return rounded(lines(spark, sf).corr().df)


@query("WITH r AS (SELECT rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2 AS a, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2 AS b FROM supplier), c AS (SELECT round(corr(a, b), 6) AS v FROM r) SELECT x AS column_a, y AS column_b, CASE WHEN x = y THEN 1.0 ELSE v END AS value FROM c, (VALUES ('s_nationkey'), ('s_acctbal')) p(x), (VALUES ('s_nationkey'), ('s_acctbal')) q(y)")
def corr_spearman(spark, sf):
    return rounded(suppliers(spark, sf).corr("spearman").df)


@query("WITH p AS (SELECT sign(a.s_nationkey - b.s_nationkey) AS x, sign(a.s_acctbal - b.s_acctbal) AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey), t AS (SELECT round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS v FROM p) SELECT x AS column_a, y AS column_b, CASE WHEN x = y THEN 1.0 ELSE v END AS value FROM t, (VALUES ('s_nationkey'), ('s_acctbal')) p(x), (VALUES ('s_nationkey'), ('s_acctbal')) q(y)")
def corr_kendall(spark, sf):
    return rounded(suppliers(spark, sf).corr("kendall").df)


@query("SELECT q, round(quantile_cont(l_quantity, q), 6) AS l_quantity, round(quantile_cont(l_extendedprice, q), 6) AS l_extendedprice FROM lineitem, (VALUES (0.05), (0.5), (0.95)) v(q) GROUP BY q".replace("quantile_cont(l_quantity, q)", "CASE q WHEN 0.05 THEN quantile_cont(l_quantity, 0.05) WHEN 0.5 THEN quantile_cont(l_quantity, 0.5) ELSE quantile_cont(l_quantity, 0.95) END").replace("quantile_cont(l_extendedprice, q)", "CASE q WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.95) END").replace("SELECT q,", "SELECT CAST(q AS DOUBLE) AS q,"))
def quantiles(spark, sf):
    return rounded(lines(spark, sf)[["l_quantity", "l_extendedprice"]].quantile([0.05, 0.5, 0.95]).df)


@query("SELECT " + ", ".join(f"round(stddev_samp({c}) / avg({c}), 6) AS {c}" for c in LINE) + " FROM lineitem")
def cv(spark, sf):
    return rounded(lines(spark, sf).coefficient_of_variation().df)


@query("WITH c AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1) SELECT 'c_mktsegment' AS \"column\", v AS value, n FROM c WHERE n = (SELECT max(n) FROM c)")
def mode_all(spark, sf):
    return customers(spark, sf).mode(["c_mktsegment"]).df


@query("SELECT min(s_suppkey) FILTER (s_acctbal = (SELECT max(s_acctbal) FROM supplier)) AS s_acctbal FROM supplier")
def idxmax(spark, sf):
    return suppliers(spark, sf)[["s_acctbal"]].idxmax().df


@query("SELECT count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer")
def nunique(spark, sf):
    return stats.aggregate(customers(spark, sf).df, ["c_nationkey", "c_mktsegment"], "nunique")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS count FROM customer GROUP BY ALL")
def value_counts(spark, sf):
    return customers(spark, sf).select(["c_mktsegment", "c_nationkey"]).drop("c_custkey").value_counts().df


@query("SELECT c_mktsegment, round(count(*) / (SELECT count(*) FROM customer), 6) AS proportion FROM customer GROUP BY ALL")
def value_counts_norm(spark, sf):
    return rounded(customers(spark, sf).select(["c_mktsegment"]).drop("c_custkey").value_counts(normalize=True).df)


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 4) AS c_acctbal_std, count(c_acctbal) AS c_acctbal_count FROM customer GROUP BY ALL")
def groupby_agg(spark, sf):
    return rounded(customers(spark, sf).groupby("c_mktsegment", ["mean", "std", "count"], ["c_acctbal"]).df, 4)


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC")
def sort_values(spark, sf):
    return suppliers(spark, sf).sort("s_acctbal", ascending=False).df


# ---- A/B comparisons ---------------------------------------------------------------------------


@query(f"WITH {orders_sql()}, n AS (SELECT treat, count(*) AS n FROM o GROUP BY 1) SELECT CAST(t.treat AS VARCHAR) AS \"group\", c.n AS control_size, t.n AS test_size, round(c.n * 100.0 / (c.n + t.n), 6) AS control_size_pct, round(t.n * 100.0 / (c.n + t.n), 6) AS test_size_pct FROM n t, n c WHERE c.treat = 0 AND t.treat > 0")
def group_sizes(spark, sf):
    return rounded(compare.group_sizes(orders(spark, sf).df, "treat"))


MOMENTS = "m AS (SELECT treat, count(price) AS n, avg(price) AS mean, var_samp(price) AS var FROM o GROUP BY 1), p AS (SELECT 'price' AS feature, CAST(t.treat AS VARCHAR) AS \"group\", c.n AS n1, c.mean AS m1, c.var AS v1, t.n AS n2, t.mean AS m2, t.var AS v2 FROM m t, m c WHERE c.treat = 0 AND t.treat > 0)"


@query(f'WITH {orders_sql()}, {MOMENTS} SELECT feature, "group", round(m1, 4) AS control_mean, round(m2, 4) AS test_mean, round(m2 - m1, 4) AS difference, round((m2 / m1 - 1) * 100, 4) AS difference_pct FROM p')
def group_difference(spark, sf):
    return rounded(compare.group_difference(orders(spark, sf).df, ["price"], "treat"), 4)


#: Composite Simpson rule over the density of t from 0 to |statistic|.
T_P_VALUE = """s AS (SELECT *, lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) AS c, abs(t) / 2000 AS h FROM w),
i AS (SELECT feature, "group", any_value(t) AS t, any_value(df) AS df,
  sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(c - (df + 1) / 2 * ln(1 + (k * h) * (k * h) / df))) * any_value(h) / 3 AS area
  FROM s, range(0, 2001) r(k) GROUP BY feature, "group")
SELECT feature, "group", round(df, 4) AS df, round(t, 6) + 0.0 AS statistic, round(greatest(1 - 2 * area, 0), 6) AS p_value, 1 - 2 * area < 0.05 AS pass FROM i"""


@query(f"WITH {orders_sql()}, {MOMENTS}, w AS (SELECT feature, \"group\", (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)) AS df FROM p), {T_P_VALUE}")
def ttest_welch(spark, sf):
    found = compare.t_test(orders(spark, sf).df, ["price"], "treat", equal_var=False)
    return rounded(found.withColumn("df", F.round("df", 4)))


@query(f"WITH {orders_sql()}, {MOMENTS}, w AS (SELECT feature, \"group\", (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM p), {T_P_VALUE}")
def ttest_pooled(spark, sf):
    return rounded(compare.t_test(orders(spark, sf).df, ["price"], "treat"))


@query(f"""WITH {orders_sql()}, {oracles.chi_square('o')} SELECT 'priority' AS feature, CAST(g AS VARCHAR) AS "group", df, round(x, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS pass FROM ch""")
def chi2_stat(spark, sf):
    return rounded(compare.chi2_test(orders(spark, sf).df, ["priority"], "treat"))


@query(f"""WITH {orders_sql()}, {oracles.ks('o', (1, 2))} SELECT 'price' AS feature, CAST(g AS VARCHAR) AS "group", round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS pass FROM ks""")
def ks_stat(spark, sf):
    return rounded(compare.ks_test(orders(spark, sf).df, ["price"], "treat", p_values="asymptotic"))


@query(f"""WITH {orders_sql()}, {oracles.mann_whitney('o', (1, 2))} SELECT 'price' AS feature, CAST(g AS VARCHAR) AS "group", round(u, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS pass FROM mw""")
def u_stat(spark, sf):
    return rounded(compare.u_test(orders(spark, sf).df, ["price"], "treat", p_values="asymptotic"), 4)


SUPPLIERS = "o AS (SELECT s_nationkey % {arms} AS treat, s_acctbal AS price FROM supplier)"


@query(f"""WITH RECURSIVE {SUPPLIERS.format(arms=4)}, {oracles.ks('o', (1, 2, 3))}, {oracles.KS_EXACT} SELECT 's_acctbal' AS feature, CAST(g AS VARCHAR) AS "group", round(d, 6) AS statistic, round(p, 8) + 0.0 AS p_value, p < 0.05 AS pass FROM kexact""")
def ks_exact(spark, sf):
    """The path count, for any size."""
    arms = suppliers(spark, sf).df.withColumn("treat", F.col("s_nationkey") % 4)
    found = compare.ks_test(arms, ["s_acctbal"], "treat", p_values="exact")
    return found.withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 8) + 0.0})


@query(f"""WITH RECURSIVE {SUPPLIERS.format(arms=25)}, {oracles.mann_whitney('o', range(1, 25))}, {oracles.U_EXACT} SELECT 's_acctbal' AS feature, CAST(g AS VARCHAR) AS "group", round(u, 4) AS statistic, round(p, 6) + 0.0 AS p_value, p < 0.05 AS pass FROM uexact""")
def u_exact(spark, sf):
    """Nations against the first one: counted where a sample is small and has no ties, else approximated."""
    arms = suppliers(spark, sf).df.withColumn("treat", F.col("s_nationkey") % 25)
    found = compare.u_test(arms, ["s_acctbal"], "treat")
    return found.withColumns({"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 6) + 0.0})


@query(f'WITH {orders_sql()}, {MOMENTS} SELECT feature, "group", round(2.8015852181356 * sqrt(v2 / n2 + v1 / n1), 4) AS mde FROM p')
def mde_by_size(spark, sf):
    return rounded(compare.mde_by_size(orders(spark, sf).df, ["price"], "treat"), 4)


@query(f'WITH {orders_sql()}, {MOMENTS} SELECT feature, "group", round((m2 - m1) / sqrt(v1), 6) + 0.0 AS smd FROM p')
def smd(spark, sf):
    return rounded(compare.smd(orders(spark, sf).df, ["price"], "treat"))


@query(f"""WITH {orders_sql()}, s AS (SELECT min(price) AS lo, max(price) AS hi FROM o WHERE treat = 0),
b AS (SELECT treat, greatest(0, least(9, CAST(floor((price - lo) / (hi - lo) * 10) AS INT))) AS bin FROM o, s),
n AS (SELECT treat, count(*) AS n FROM b GROUP BY 1),
d AS (SELECT n.treat, bin, greatest(1e-6, (SELECT count(*) FROM b WHERE b.treat = n.treat AND b.bin = bins.bin) / n.n) AS q FROM n, range(10) bins(bin))
SELECT 'price' AS feature, CAST(t.treat AS VARCHAR) AS "group", round(sum((t.q - c.q) * ln(t.q / c.q)), 6) + 0.0 AS psi FROM d t JOIN d c ON c.treat = 0 AND t.treat > 0 AND t.bin = c.bin GROUP BY t.treat""")
def psi(spark, sf):
    return rounded(compare.psi(orders(spark, sf).df, ["price"], "treat"))




@query(f"WITH {BASKETS} SELECT 'total' AS feature, 'all' AS \"group\", round(avg(qty), 4) AS control_mean, round(avg(total), 4) AS test_mean, round(avg(total) - avg(qty), 4) AS difference, round((avg(total) / avg(qty) - 1) * 100, 4) AS difference_pct FROM b")
def difference_columns(spark, sf):
    return rounded(compare.group_difference(baskets(spark, sf), ["total"], mode="columns", baseline="qty"), 4)


@query(f"WITH {BASKETS} SELECT 'total' AS feature, CAST(treat AS VARCHAR) AS \"group\", round(avg(qty), 4) AS control_mean, round(avg(total), 4) AS test_mean, round(avg(total) - avg(qty), 4) AS difference, round((avg(total) / avg(qty) - 1) * 100, 4) AS difference_pct FROM b GROUP BY treat")
def difference_columns_in_groups(spark, sf):
    return rounded(compare.group_difference(baskets(spark, sf), ["total"], "treat", "columns_in_groups", "qty"), 4)


@query(f"WITH {BASKETS}, x AS (SELECT avg(qty) FILTER (treat = 0) AS c, avg(total) FILTER (treat = 1) AS t FROM b) SELECT 'total' AS feature, '1' AS \"group\", round(c, 4) AS control_mean, round(t, 4) AS test_mean, round(t - c, 4) AS difference, round((t / c - 1) * 100, 4) AS difference_pct FROM x")
def difference_cross(spark, sf):
    return rounded(compare.group_difference(baskets(spark, sf), ["total"], "treat", "cross", "qty"), 4)


PVALUES = "p AS (SELECT n_nationkey AS id, CAST((n_nationkey * 7 % 25 + 1) AS DOUBLE) / 500 AS p_value FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS m FROM p)"


def _p_values(spark, sf) -> DataFrame:
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (((F.col("n_nationkey") * 7) % 25 + 1).cast("double") / 500).alias("p_value"))


def _multi(method: str, new: str):
    def run(spark, sf):
        return rounded(multitest.multitest(_p_values(spark, sf), method))

    run.__name__ = f"multitest_{method.replace('-', '_')}"
    query(f"WITH {PVALUES}, a AS (SELECT id, p_value, least(1.0, {new}) AS n FROM r) SELECT id, round(p_value, 6) AS p_value, round(n, 6) AS new_p_value, round(p_value / n, 6) AS correction, n <= 0.05 AS rejected FROM a")(run)


_multi("bonferroni", "p_value * m")
_multi("sidak", "1 - (1 - p_value) ^ m")
_multi("holm", "max(p_value * (m - i + 1)) OVER (ORDER BY p_value ROWS UNBOUNDED PRECEDING)")
_multi("holm-sidak", "max(1 - (1 - p_value) ^ (m - i + 1)) OVER (ORDER BY p_value ROWS UNBOUNDED PRECEDING)")
_multi("simes-hochberg", "min(p_value * (m - i + 1)) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING)")
_multi("fdr_bh", "min(p_value * m / i) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING)")
_multi("fdr_by", "min(p_value * m / i * (SELECT sum(1.0 / k) FROM range(1, 26) t(k))) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING)")


@query(oracles.two_stage(PVALUES))
def multitest_other(spark, sf):
    parts = [multitest.multitest(_p_values(spark, sf), m).withColumn("method", F.lit(m)) for m in ("hommel", "fdr_tsbh", "fdr_tsbky")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(oracles.best_arm(orders_sql(), 3))
def multitest_quantile(spark, sf):
    best = multitest.best_group(orders(spark, sf).df, "treat", ["price"])
    return spark.createDataFrame(list(best.items()), "target string, accepted long")


@query(oracles.minimal_size(orders_sql(), 3, 1000.0))
def min_sample_size(spark, sf):
    sizes = multitest.min_sample_sizes(orders(spark, sf).df, "treat", ["price"], 1000.0)
    return spark.createDataFrame(list(sizes.items()), "target string, size long")


@query(oracles.resume(orders_sql(), (1, 2), ("t-test", "u-test", "ks-test", "chi2-test"), False, True, True))
def ab_resume(spark, sf):
    return rounded(shells.ABTest(tests=("t-test", "u-test", "ks-test", "chi2-test"), p_values="asymptotic").execute(orders(spark, sf)).resume, 4)


@query(oracles.holm(orders_sql(), (1, 2)))
def ab_multitest(spark, sf):
    return rounded(shells.ABTest(tests=("t-test", "u-test"), p_values="asymptotic").execute(orders(spark, sf)).multitest)


@query(oracles.resume(orders_sql(2), (1,), ("t-test", "ks-test", "chi2-test"), True, False, False))
def homogeneity_resume(spark, sf):
    return rounded(shells.HomogeneityTest(p_values="asymptotic").execute(orders(spark, sf, 2)).resume, 4)


# ---- A/A splits --------------------------------------------------------------------------------

RANK = "row_number() OVER ({by}ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':{seed}'), c_custkey) AS r, count(*) OVER ({by}) AS n"


def _label(edges: list[float]) -> str:
    cases = " ".join(f"WHEN r <= floor(n * {e}) THEN '{'control' if i == 0 else f'test_{i}'}'" for i, e in enumerate(edges))
    return f"CASE {cases} ELSE 'test_{len(edges)}' END"


@query(f"SELECT c_custkey, {_label([0.5])} AS split FROM (SELECT c_custkey, {RANK.format(by='', seed=11)} FROM customer)")
def aa_split(spark, sf):
    return split.Splitter("c_custkey", 11).split(customers(spark, sf).df).select("c_custkey", "split")


@query(f"SELECT c_custkey, {_label([0.5, 0.75])} AS split FROM (SELECT c_custkey, {RANK.format(by='', seed=5)} FROM customer)")
def aa_split_groups(spark, sf):
    return split.Splitter("c_custkey", 5, groups_sizes=(0.5, 0.25, 0.25)).split(customers(spark, sf).df).select("c_custkey", "split")


@query(f"SELECT c_custkey, c_mktsegment, {_label([0.5])} AS split FROM (SELECT c_custkey, c_mktsegment, {RANK.format(by='PARTITION BY c_mktsegment ', seed=11)} FROM customer)")
def aa_split_stratified(spark, sf):
    return split.Splitter("c_custkey", 11, strata=("c_mktsegment",)).split(customers(spark, sf).df).select("c_custkey", "c_mktsegment", "split")


@query("""WITH c AS (SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'control' WHEN 2 THEN 'test' END AS fixed FROM customer),
t AS (SELECT floor(count(*) * 0.5) - count(*) FILTER (fixed = 'control') AS wanted FROM c),
f AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':4'), c_custkey) AS r FROM c WHERE fixed IS NULL)
SELECT c_custkey, CASE WHEN r <= greatest(0, wanted) THEN 'control' ELSE 'test_1' END AS split FROM f, t
UNION ALL SELECT c_custkey, CASE WHEN fixed = 'control' THEN 'control' ELSE 'test_1' END FROM c WHERE fixed IS NOT NULL""")
def aa_split_const(spark, sf):
    df = customers(spark, sf).df.withColumn("fixed", F.when(F.col("c_nationkey") == 1, "control").when(F.col("c_nationkey") == 2, "test"))
    return split.Splitter("c_custkey", 4, const="fixed").split(df).select("c_custkey", "split")


@query(f"SELECT c_custkey, CASE WHEN r <= floor(floor(n * 0.4) * 0.5) THEN 'control' WHEN r <= floor(n * 0.4) THEN 'test_1' END AS split FROM (SELECT c_custkey, {RANK.format(by='', seed=8)} FROM customer)")
def aa_split_sample(spark, sf):
    return split.Splitter("c_custkey", 8, sample_size=0.4).split(customers(spark, sf).df).select("c_custkey", "split")


@query("""WITH s AS (SELECT c_custkey, c_acctbal, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), c_custkey) AS r, count(*) OVER (PARTITION BY seed) AS n FROM customer, (SELECT unnest([0, 1, 2, 3]) AS seed)),
m AS (SELECT seed, avg(c_acctbal) FILTER (r <= floor(n * 0.5)) AS m1, var_samp(c_acctbal) FILTER (r <= floor(n * 0.5)) AS v1, count(*) FILTER (r <= floor(n * 0.5)) AS n1, avg(c_acctbal) FILTER (r > floor(n * 0.5)) AS m2, var_samp(c_acctbal) FILTER (r > floor(n * 0.5)) AS v2, count(*) FILTER (r > floor(n * 0.5)) AS n2 FROM s GROUP BY seed)
SELECT CAST(seed AS INT) AS seed, 'c_acctbal' AS feature, 'test_1' AS "group", round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS statistic FROM m""")
def aa_experiments(spark, sf):
    found = shells.AATest(seeds=(0, 1, 2, 3), tests=("t-test",)).execute(customers(spark, sf)).experiments
    return rounded(found.select("seed", "feature", "group", "statistic"))


@query(f"WITH {oracles.aa()} SELECT CAST(seed AS INT) AS seed, round(mean_test_score, 6) AS mean_test_score, round(mean_p, 6) AS mean_p, round(score, 6) AS score FROM scored")
def aa_scores(spark, sf):
    return rounded(shells.AATest(p_values="asymptotic").execute(customers(spark, sf)).scores)


@query(f"""WITH {oracles.aa('c_mktsegment')} SELECT 'c_acctbal' AS feature, 'test_1' AS "group", round(tp, 4) AS "t-test p-value", CASE WHEN tp < 0.05 THEN 'NOT OK' ELSE 'OK' END AS "t-test verdict", round(kp, 4) AS "ks-test p-value", CASE WHEN kp < 0.05 THEN 'NOT OK' ELSE 'OK' END AS "ks-test verdict",
round(m1, 4) AS control_mean, round(m2, 4) AS test_mean, round(m2 - m1, 4) + 0.0 AS difference, round((m2 / m1 - 1) * 100, 4) + 0.0 AS difference_pct FROM scored ORDER BY score DESC, seed LIMIT 1""")
def aa_best_split(spark, sf):
    return rounded(shells.AATest(stratification=True, p_values="asymptotic").execute(customers(spark, sf)).best_split_statistic, 4)


@query("""WITH s AS (SELECT c_acctbal AS x, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), c_custkey) AS r, count(*) OVER (PARTITION BY seed) AS n FROM customer, (SELECT unnest(range(0, 6)) AS seed)),
l AS (SELECT seed, x, CASE WHEN r <= floor(n * 0.5) THEN 0 WHEN r <= floor(n * 0.75) THEN 1 ELSE 2 END AS arm FROM s),
m AS (SELECT seed, arm, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM l GROUP BY ALL)
SELECT CAST(t.seed AS INT) AS seed, 'c_acctbal' AS feature, 'test_' || CAST(t.arm AS VARCHAR) AS "group", round((c.m - t.m) / sqrt(c.v / c.n + t.v / t.n), 6) + 0.0 AS statistic FROM m t JOIN m c ON c.seed = t.seed AND c.arm = 0 WHERE t.arm > 0""")
def aa_arms(spark, sf):
    """Splits into three arms, all seeds in one plan."""
    found = shells.AATest(seeds=tuple(range(6)), tests=("t-test",), groups_sizes=(0.5, 0.25, 0.25)).execute(customers(spark, sf)).experiments
    return rounded(found.select("seed", "feature", "group", "statistic"))


@query("""WITH s AS (SELECT c_acctbal AS x, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), c_custkey) AS r, count(*) OVER (PARTITION BY seed) AS n FROM customer, (SELECT unnest(range(0, 10)) AS seed)),
m AS (SELECT seed, avg(x) FILTER (r <= floor(n * 0.5)) AS m1, var_samp(x) FILTER (r <= floor(n * 0.5)) AS v1, count(*) FILTER (r <= floor(n * 0.5)) AS n1, avg(x) FILTER (r > floor(n * 0.5)) AS m2, var_samp(x) FILTER (r > floor(n * 0.5)) AS v2, count(*) FILTER (r > floor(n * 0.5)) AS n2 FROM s GROUP BY seed),
w AS (SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)) AS df FROM m),
p AS (SELECT """ + oracles.t_p("t", "df") + """ AS p FROM w)
SELECT 'c_acctbal' AS feature, 'test_1' AS "group", 't-test' AS test, count(*) AS n_splits, round(avg(CAST(p >= 0.05 AS INT)), 6) AS passed_share, round(1 - abs(0.05 - avg(CAST(p < 0.05 AS INT))), 6) AS score, CASE WHEN 1 - abs(0.05 - avg(CAST(p < 0.05 AS INT))) >= 0.94 THEN 'OK' ELSE 'NOT OK' END AS verdict FROM p""")
def aa_summary(spark, sf):
    found = shells.AATest(tests=("t-test",)).execute(customers(spark, sf))
    return rounded(reports.aa_summary(found.experiments))


# ---- variance reduction ------------------------------------------------------------------------


@query(f"WITH {BASKETS}, s AS (SELECT covar_pop(total, qty) / (stddev_samp(total) * stddev_samp(qty)) AS theta, avg(qty) AS m FROM b) SELECT id, round(total - theta * (qty - m), 3) AS total_cuped FROM b, s")
def cuped_reference(spark, sf):
    return rounded(variance.cuped(baskets(spark, sf), {"total": "qty"}, "reference").select("id", "total_cuped"), 3)


@query(f"WITH {BASKETS}, s AS (SELECT regr_slope(total, qty) AS theta, avg(qty) AS m FROM b) SELECT id, round(total - theta * (qty - m), 3) AS total_cuped FROM b, s")
def cuped_ols(spark, sf):
    return rounded(variance.cuped(baskets(spark, sf), {"total": "qty"}).select("id", "total_cuped"), 3)


@query(f"WITH {BASKETS} SELECT 'total' AS target, round(corr(total, qty) ^ 2 * 100, 6) AS reduction_pct FROM b")
def cuped_variance_reduction(spark, sf):
    adjusted = variance.cuped(baskets(spark, sf), {"total": "qty"})
    return rounded(variance.variance_reduction(adjusted, {"total": "total_cuped"}))


#: lag1 on x2 and lag2 by least squares; then x1 and lag1 stand in for them.
CUPAC = f"""WITH {BASKETS}, l AS (SELECT total, total * 0.9 + qty AS y, qty * 0.5 AS a, total * 0.8 + qty * 3 AS b, qty + 1 AS p FROM b),
g AS (SELECT (covar_pop(y, a) * var_pop(b) - covar_pop(y, b) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ^ 2) AS s1, (covar_pop(y, b) * var_pop(a) - covar_pop(y, a) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ^ 2) AS s2 FROM l)
SELECT 'total' AS target, round((1 - var_samp(total - s1 * p - s2 * y) / var_samp(total)) * 100, 3) AS reduction_pct FROM l, g"""


@query(CUPAC)
def cupac(spark, sf):
    df = baskets(spark, sf).withColumns({"lag1": F.col("total") * 0.9 + F.col("qty"), "lag2": F.col("total") * 0.8 + F.col("qty") * 3, "x1": F.col("qty") + 1, "x2": F.col("qty") * 0.5})
    plan = variance.CupacPlan("total", ("lag1", "lag2"), (("x1",), ("x2",)))
    adjusted, _ = variance.cupac(df, plan, "id", ("linear", "ridge"))
    return rounded(variance.variance_reduction(adjusted, {"total": "total_cupac"}), 3)


@query(f"WITH {BASKETS}, c AS (SELECT treat AS \"group\", avg(total - qty) AS change FROM b GROUP BY 1) SELECT \"group\", round(change, 4) AS change, round(change - (SELECT change FROM c WHERE \"group\" = 0), 4) + 0.0 AS effect FROM c")
def diff_in_diff(spark, sf):
    return rounded(variance.diff_in_diff(baskets(spark, sf), "treat", "qty", "total"), 4)


# ---- preprocessing -----------------------------------------------------------------------------


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n < 15 THEN 'rare' ELSE p_type END AS p_type FROM part JOIN c USING (p_type)")
def category_agg(spark, sf):
    return prep.aggregate_categories(read(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"], 15, "rare")


def _union(sql: str, columns: list[str]) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in columns)


@query(f"WITH s AS ({_union('SELECT {c!r} AS c, stddev_samp({c}) / avg({c}) AS v FROM lineitem', LINE)}) SELECT c AS \"column\", round(v, 6) AS statistic, v >= 0.5 AND v <= 0.6 AS keep FROM s")
def cv_filter(spark, sf):
    return rounded(prep.cv_report(lines(spark, sf).df, LINE, 0.5, 0.6))


@query(f"WITH s AS ({_union('SELECT {c!r} AS c, (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) AS v', LINE)}) SELECT c AS \"column\", round(v, 6) AS statistic, v <= 0.1 AS keep FROM s")
def const_filter(spark, sf):
    return rounded(prep.const_report(lines(spark, sf).df, LINE, 0.1))


@query(f"WITH {HOLES} SELECT 's_acctbal' AS \"column\", round(avg(CASE WHEN s_acctbal IS NULL THEN 1.0 ELSE 0.0 END), 6) AS statistic, avg(CASE WHEN s_acctbal IS NULL THEN 1.0 ELSE 0.0 END) <= 0.3 AS keep FROM h")
def nan_filter(spark, sf):
    return rounded(prep.nan_report(_holes(spark, sf).df, ["s_acctbal"], 0.3))


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS c, " + (f"greatest({', '.join(f'abs(corr({a}, {b}))' for b in LINE[i + 1 :])})" if i + 1 < len(LINE) else "NULL") + " AS v FROM lineitem" for i, a in enumerate(LINE)) + ') SELECT DISTINCT c AS "column", round(v, 6) AS statistic, coalesce(v <= 0.8, true) AS keep FROM s')
def corr_filter(spark, sf):
    return rounded(prep.corr_report(lines(spark, sf).df, LINE))


@query("WITH q AS (SELECT quantile_cont(s_acctbal, 0.05) AS lo, quantile_cont(s_acctbal, 0.95) AS hi FROM supplier) SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier, q WHERE s_acctbal BETWEEN lo AND hi")
def outliers_filter(spark, sf):
    return prep.drop_outliers(suppliers(spark, sf).df, ["s_acctbal"])


SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # all but the first in order


@query("SELECT c_custkey, c_mktsegment, " + ", ".join(f"CAST(coalesce(c_mktsegment = '{s}', false) AS INT) AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def one_hot(spark, sf):
    return prep.one_hot(customers(spark, sf).df.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])[0]


#: The 0/1 columns, whose names depend on the data, as a list of the names of those that are 1.
PREPARED = """WITH c AS (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 15 THEN 'other' ELSE p_brand END AS p_brand, CASE WHEN count(*) OVER (PARTITION BY p_type) < 15 THEN 'other' ELSE p_type END AS p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part),
q AS (SELECT quantile_cont(p_size, 0.05) AS lo, quantile_cont(p_size, 0.95) AS hi FROM c), k AS (SELECT c.* FROM c, q WHERE p_size BETWEEN lo AND hi), f AS (SELECT min(p_brand) AS b, min(p_type) AS t FROM k)
SELECT k.*, concat_ws(',', CASE WHEN p_brand <> b THEN 'p_brand_' || p_brand END, CASE WHEN p_type <> t THEN 'p_type_' || p_type END) AS ones FROM k, f"""


@query(PREPARED)
def preprocessing_pipeline(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    frame = RoleFrame(df, {FeatureRole(): ["p_brand", "p_type", "p_size"], TargetRole(): ["p_retailprice"]}, "p_partkey")
    done = prep.standard()(frame).df
    made = [c for c in done.columns if c not in df.columns]
    ones = F.concat_ws(",", *[F.when(F.col(f"`{c}`") == 1, c) for c in made])
    return done.select(*df.columns, ones.alias("ones"))


# ---- matching ----------------------------------------------------------------------------------


def matching_frame(spark, sf) -> DataFrame:
    """Suppliers: id, treat (nation number below 10), two features and an outcome."""
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") < 10).cast("int").alias("treat"), F.col("s_acctbal").alias("x1"), ((F.col("s_suppkey") * 37) % 101).cast("double").alias("x2"), (F.col("s_acctbal") * 0.01 + (F.col("s_suppkey") % 7)).alias("y"))


MATCHING = "u AS (SELECT s_suppkey AS id, CAST(s_nationkey < 10 AS INT) AS treat, s_acctbal AS x1, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x2, s_acctbal * 0.01 + s_suppkey % 7 AS y FROM supplier)"


def _nearest_sql(space: tuple[str, str] = ("x1", "x2"), table: str = "u") -> str:
    a, b = space
    return f"k AS (SELECT q.id AS query, m.id AS match, (q.{a} - m.{a}) ^ 2 + (q.{b} - m.{b}) ^ 2 AS d2, q.treat AS treated, row_number() OVER (PARTITION BY q.id ORDER BY (q.{a} - m.{a}) ^ 2 + (q.{b} - m.{b}) ^ 2, m.id) AS rank FROM {table} q JOIN {table} m ON q.treat <> m.treat)"


@query(f"WITH {MATCHING}, {_nearest_sql()} SELECT query, match, round(d2, 4) AS d2, CAST(rank AS INT) AS rank, treated FROM k WHERE rank <= 2")
def knn_l2(spark, sf):
    return rounded(matching.match_both(matching_frame(spark, sf), "id", "treat", ["x1", "x2"], 2, mode="exact"), 4)


@query(f"WITH {MATCHING}, {_nearest_sql()} SELECT query, match, round(d2, 4) AS d2, CAST(rank AS INT) AS rank, treated FROM k WHERE rank = 1")
def knn_cells(spark, sf):
    return rounded(matching.match_both(matching_frame(spark, sf), "id", "treat", ["x1", "x2"], 1, mode="cells"), 4)


def _effects(df: DataFrame, space: list[str]) -> DataFrame:
    pairs = matching.match_both(df, "id", "treat", space, mode="exact")
    means = matching.matched_means(df, "id", pairs, ["y"])
    return rounded(matching.effects(matching.unit_effects(means, "id", "treat", "y"), pairs), 4)


@query(f"WITH {MATCHING}, {_nearest_sql()}, {oracles.PLAIN}, {oracles.EFFECTS} FROM y")
def match_att_atc_ate(spark, sf):
    return _effects(matching_frame(spark, sf), ["x1", "x2"])


WHITE = """c AS (SELECT avg(a) + 0.001 AS a, avg(b) AS b, avg(d) + 0.001 AS d FROM (SELECT covar_samp(x1, x1) AS a, covar_samp(x1, x2) AS b, covar_samp(x2, x2) AS d FROM u GROUP BY treat)),
l AS (SELECT sqrt(a) AS l11, b / sqrt(a) AS l21, sqrt(d - b * b / a) AS l22 FROM c),
v AS (SELECT u.*, x1 / l11 AS w0, (x2 - l21 * x1 / l11) / l22 AS w1 FROM u, l)"""


@query(f"WITH {MATCHING}, {WHITE} SELECT id, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1 FROM v")
def whiten_mahalanobis(spark, sf):
    df = matching_frame(spark, sf)
    space = matching.linear(df, ["x1", "x2"], matching.whitening(df, "treat", ["x1", "x2"]), ["w0", "w1"])
    return rounded(space.select("id", "w0", "w1"))


@query(f"WITH {MATCHING}, {_nearest_sql()} SELECT q.id, q.treat, round(m.x1, 4) AS x1_matched, round(m.y, 4) AS y_matched FROM k JOIN u q ON q.id = k.query JOIN u m ON m.id = k.match WHERE rank = 1")
def match_full_data(spark, sf):
    df = matching_frame(spark, sf)
    means = matching.matched_means(df, "id", matching.match_both(df, "id", "treat", ["x1", "x2"], mode="exact"), ["x1", "y"])
    return rounded(means.select("id", "treat", "x1_matched", "y_matched"), 4)


def _shell_frame(spark, sf) -> RoleFrame:
    df = matching_frame(spark, sf).withColumn("part", (F.col("id") % 2).cast("string"))
    return RoleFrame(df, {TreatmentRole(): ["treat"], TargetRole(): ["y"], FeatureRole(): ["x1", "x2"], GroupingRole(): ["part"]}, "id")


@query(f"WITH {MATCHING}, {_nearest_sql()}, p AS (SELECT q.treat, avg(q.x1) AS t, avg(m.x1) AS c FROM k JOIN u q ON q.id = k.query JOIN u m ON m.id = k.match WHERE rank = 1 GROUP BY q.treat) SELECT 'x1' AS feature, CAST(treat AS VARCHAR) AS \"group\", round(c, 4) AS control_mean, round(t, 4) AS test_mean, round(t - c, 4) + 0.0 AS difference, round((t / c - 1) * 100, 4) + 0.0 AS difference_pct FROM p")
def match_quality(spark, sf):
    df = matching_frame(spark, sf)
    means = matching.matched_means(df, "id", matching.match_both(df, "id", "treat", ["x1", "x2"], mode="exact"), ["x1"])
    return rounded(compare.group_difference(means, ["x1"], "treat", "matched_pairs"), 4)


@query("""WITH u AS (SELECT s_suppkey AS id, s_suppkey % 2 AS treat, CAST(s_suppkey * 7 % 4 AS DOUBLE) AS x1 FROM supplier),
k AS (SELECT q.id AS query, m.id AS match, (q.x1 - m.x1) ^ 2 AS d2, row_number() OVER (PARTITION BY q.id ORDER BY (q.x1 - m.x1) ^ 2, m.id) AS rank, q.treat AS treated FROM u q JOIN u m ON q.treat <> m.treat)
SELECT query, match, round(d2, 4) AS d2, CAST(rank AS INT) AS rank, CAST(treated AS INT) AS treated FROM k WHERE rank <= 3""")
def knn_ties(spark, sf):
    """Many candidates of equal distance: the smaller ids."""
    df = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).alias("treat"), (F.col("s_suppkey") * 7 % 4).cast("double").alias("x1"))
    return rounded(matching.match_both(df, "id", "treat", ["x1"], 3), 4)


@query("""WITH u AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS g, c_custkey % 2 AS treat, c_acctbal AS x1 FROM customer),
k AS (SELECT q.id AS query, m.id AS match, (q.x1 - m.x1) ^ 2 AS d2, row_number() OVER (PARTITION BY q.id ORDER BY (q.x1 - m.x1) ^ 2, m.id) AS rank FROM u q JOIN u m ON q.g = m.g AND q.treat = 0 AND m.treat = 1)
SELECT query, match, round(d2, 2) AS d2 FROM k WHERE rank = 1""")
def knn_in_groups(spark, sf):
    """Controls look for test units of their own nation in one search; keys are texts."""
    df = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 2).alias("treat"), F.col("c_acctbal").alias("x1"))
    found = matching.match_both(df, "id", "treat", ["x1"], two_sides=False, test_pairs=True, by=["g"])
    return rounded(found.select("query", "match", "d2"), 2)


WHITE_NEAREST = _nearest_sql(("w0", "w1"), "v")


@query(f"WITH {MATCHING}, {WHITE}, {WHITE_NEAREST}, {oracles.CORRECTED}, {oracles.EFFECTS}, 'y' AS target FROM y")
def bias_correction(spark, sf):
    return rounded(shells.Matching(mode="exact").execute(_shell_frame(spark, sf)).resume, 4)


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {MATCHING} WHERE s_suppkey % 2 = {part}), {WHITE}, {WHITE_NEAREST}, {oracles.PLAIN}, {oracles.EFFECTS}, 'y' AS target, '{part}' AS match_group FROM y)" for part in (0, 1)).replace("FROM supplier) WHERE", "FROM supplier WHERE"))
def match_group(spark, sf):
    return rounded(shells.Matching(mode="exact", group_match=True, bias_estimation=False).execute(_shell_frame(spark, sf)).resume, 4)


@query("""WITH s AS (SELECT o_orderpriority AS priority, o_orderkey AS id, o_totalprice AS y, md5(CAST(o_orderkey AS VARCHAR) || ':target') AS h, avg(o_totalprice) OVER () AS m FROM orders)
SELECT id, round((coalesce(sum(y) OVER e, 0) + m) / (count(*) OVER e + 1), 3) AS encoded FROM s WINDOW e AS (PARTITION BY priority ORDER BY h, CAST(id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def target_statistics(spark, sf):
    """Each order's priority as the mean price of earlier orders of that priority."""
    df = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("y"))
    found, _, _ = variance.target_statistics(df, "id", ["priority"], "y", ["encoded"])
    return rounded(found.select("id", "encoded"), 3)


def _median_gap(control, test):
    """Difference of medians; the p-value of the sign test of the test's values against the control's median."""
    import math

    import numpy as np

    above = int((test > np.median(control)).sum())
    tail = sum(math.exp(math.lgamma(len(test) + 1) - math.lgamma(k + 1) - math.lgamma(len(test) - k + 1) - len(test) * math.log(2)) for k in range(max(above, len(test) - above), len(test) + 1))
    return np.median(control) - np.median(test), min(1.0, 2 * tail)


@query("""WITH o AS (SELECT s_nationkey % 3 AS treat, s_acctbal AS y FROM supplier), c AS (SELECT median(y) AS m FROM o WHERE treat = 0),
t AS (SELECT treat, median(y) AS m, count(*) AS n, count(*) FILTER (y > (SELECT m FROM c)) AS a FROM o WHERE treat > 0 GROUP BY 1)
SELECT 's_acctbal' AS feature, CAST(treat AS VARCHAR) AS "group", round(c.m - t.m, 4) + 0.0 AS statistic,
round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END - CASE WHEN n > k THEN lgamma(n - k + 1) ELSE 0 END - n * ln(2))) FROM range(0, 100000) r(k) WHERE k BETWEEN greatest(a, n - a) AND n)), 6) + 0.0 AS p_value FROM t, c""")
def user_test(spark, sf):
    """A test registered by name, used by an experiment."""
    if "median-test" not in compare.TESTS:
        compare.register_test("median-test", compare.sample_test(_median_gap))
    frame = RoleFrame(suppliers(spark, sf).df.withColumn("treat", F.col("s_nationkey") % 3), {TreatmentRole(): ["treat"], TargetRole(): ["s_acctbal"]}, "s_suppkey")
    found = shells.ABTest(tests=("median-test",), multitest_method=None).execute(frame).tests.select("feature", "group", "statistic", "p_value")
    return found.withColumns({"statistic": F.round("statistic", 4) + 0.0, "p_value": F.round("p_value", 6) + 0.0})


@query("SELECT o_orderpriority AS priority, rank, round(price, 2) AS price FROM (SELECT o_orderpriority, o_totalprice AS price, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 3")
def apply_groups(spark, sf):
    """A table function of each priority's orders: its three dearest."""

    def dearest(rows):
        return rows.sort_values(["price", "id"], ascending=[False, True]).head(3)

    def ranked(rows):
        top = dearest(rows)
        return top.assign(rank=range(1, len(top) + 1))[["priority", "rank", "price"]]

    return rounded(orders(spark, sf).apply_groups("priority", ranked, "priority string, rank int, price double", part=dearest).df, 2)


# ---- streams -----------------------------------------------------------------------------------


@query("""WITH w AS (SELECT unnest(range(0, 7)) AS k)
SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) - 86400 * k AS start, user_id % 2 AS "group", count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var FROM events, w GROUP BY ALL""")
def event_sliding(spark, sf):
    found = windows.sliding_moments(read(spark, sf, "events"), F.col("user_id") % 2, "value")
    return rounded(found.withColumn("start", F.unix_timestamp("start")))


@query("""WITH e AS (SELECT user_id AS key, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT key, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 21600000000 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY key, session""")
def event_sessions(spark, sf):
    found = windows.sessions(read(spark, sf, "events"), F.col("user_id"), "value", gap="6 hours")
    return rounded(found.withColumns({"start": F.unix_micros(F.col("start").cast("timestamp")), "end": F.unix_micros(F.col("end").cast("timestamp"))}), 4)


@query("""WITH m AS (SELECT event_type AS key, count(*) FILTER (user_id % 2 = 0) AS n0, count(*) FILTER (user_id % 2 = 1) AS n1, avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0) AS d,
var_samp(value) FILTER (user_id % 2 = 0) / count(*) FILTER (user_id % 2 = 0) + var_samp(value) FILTER (user_id % 2 = 1) / count(*) FILTER (user_id % 2 = 1) AS v FROM events GROUP BY 1),
r AS (SELECT *, sqrt(v / (v + 1)) * exp(d * d / (2 * v * (v + 1))) AS ratio FROM m)
SELECT key, n0, n1, round(d, 6) AS difference, round(ratio, 6) AS likelihood_ratio, round(least(1.0, 1 / ratio), 6) AS p_value, round(least(1.0, 1 / ratio), 6) AS least_p FROM r""")
def event_sequential(spark, sf):
    return rounded(windows.sequential_test(read(spark, sf, "events"), F.col("event_type"), F.col("user_id") % 2 == 1, "value"))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, user_id % 2 AS \"group\", count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var FROM events GROUP BY ALL")
def event_moments(spark, sf):
    found = windowed_moments(read(spark, sf, "events"), F.col("user_id") % 2, "value")
    return rounded(found.withColumn("start", F.unix_timestamp("start")))


