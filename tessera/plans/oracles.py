"""SQL of tests, A/A runs and matching, put together from parts, for the queries' twins."""

from __future__ import annotations

from collections.abc import Sequence

SIMPSON = "(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"


def normal_p(z: str) -> str:
    """Two-sided p-value of a normal statistic: one less the density's integral, by Simpson's rule."""
    return f"greatest(0.0, 1 - abs({z}) / 3000 / sqrt(2 * pi()) * (SELECT sum({SIMPSON} * exp(-0.5 * (abs({z}) * k / 2000) ^ 2)) FROM range(0, 2001) r(k)))"


def t_p(t: str, df: str) -> str:
    return f"greatest(0.0, 1 - 2 * abs({t}) / 6000 * (SELECT sum({SIMPSON} * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + (abs({t}) * k / 2000) ^ 2 / {df}))) FROM range(0, 2001) r(k)))"


def kolmogorov_p(x: str) -> str:
    low = f"1 - sqrt(2 * pi()) / {x} * (SELECT sum(exp(-((2 * k - 1) ^ 2) * pi() ^ 2 / (8 * {x} * {x}))) FROM range(1, 20) r(k))"
    high = f"2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {x} * {x})) FROM range(1, 101) r(k))"
    return f"CASE WHEN {x} < 0.2 THEN 1.0 WHEN {x} < 1 THEN {low} ELSE least(1.0, {high}) END"


def chi2_p(x: str, df: str) -> str:
    """For an even number of degrees of freedom: a finite series."""
    return f"exp(-{x} / 2) * (SELECT sum(({x} / 2) ^ k / gamma(k + 1)) FROM range(0, 50) r(k) WHERE k < {df} / 2)"


def ks(source: str, arms: Sequence[int]) -> str:
    """CTEs up to ks(g, d, p): the distance of price between arm g and arm 0 of ``source``."""
    return f"""kc AS (SELECT g, price, count(*) FILTER (treat = 0) AS c0, count(*) FILTER (treat = g) AS c1 FROM {source}, (SELECT unnest({list(arms)}) AS g) WHERE treat IN (0, g) GROUP BY ALL),
kf AS (SELECT g, sum(c0) OVER w AS u0, sum(c1) OVER w AS u1, sum(c0) OVER (PARTITION BY g) AS n0, sum(c1) OVER (PARTITION BY g) AS n1 FROM kc WINDOW w AS (PARTITION BY g ORDER BY price ROWS UNBOUNDED PRECEDING)),
kd AS (SELECT g, max(abs(u0 / n0 - u1 / n1)) AS d, CAST(max(n0) AS DOUBLE) AS n0, CAST(max(n1) AS DOUBLE) AS n1 FROM kf GROUP BY g),
kx AS (SELECT g, d, d * sqrt(n0 * n1 / (n0 + n1)) AS x FROM kd),
ks AS (SELECT g, d, {kolmogorov_p('x')} AS p FROM kx)"""


#: CTE kexact(g, d, p) after ks: the share of lattice paths that reach the distance, one step of i + j at a time.
KS_EXACT = """kn AS (SELECT g, d, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, CAST(n1 AS BIGINT) // gcd(CAST(n0 AS BIGINT), CAST(n1 AS BIGINT)) AS b, CAST(n0 AS BIGINT) // gcd(CAST(n0 AS BIGINT), CAST(n1 AS BIGINT)) AS a FROM kd),
kp AS (SELECT *, CAST(round(d * a * n1) AS BIGINT) AS h, 0 AS k, list_transform(range(0, n0 + 1), lambda i: CAST(i > 0 AS DOUBLE)) AS v FROM kn
  UNION ALL
  SELECT g, d, n0, n1, b, a, h, k + 1, list_transform(range(0, n0 + 1), lambda i: CASE WHEN i > k + 1 OR k + 1 - i > n1 OR abs(i * b - (k + 1 - i) * a) >= h THEN CAST(1 AS DOUBLE) ELSE (i * coalesce(v[i], 0) + (k + 1 - i) * v[i + 1]) / (k + 1) END)
  FROM kp WHERE k < n0 + n1),
kexact AS (SELECT g, d, v[n0 + 1] AS p FROM kp WHERE k = n0 + n1)"""

#: CTE uexact(g, u, p) after mw: subsets of the ranks by size and sum, one rank at a time.
U_EXACT = """un AS (SELECT g, u, greatest(u, n1 * n2 - u) AS big, CAST(least(n1, n2) AS BIGINT) AS m, CAST(n1 + n2 AS BIGINT) AS n, least(n1, n2) <= 8 AND ties = 0 AS small FROM uz),
us_ AS (SELECT DISTINCT m, n FROM un WHERE small),
uq AS (SELECT m, n, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS s, CAST(1 AS DOUBLE) AS c FROM us_
  UNION ALL
  SELECT m, n, r + 1, j + t, s + t * (r + 1), CAST(sum(c) AS DOUBLE) FROM uq, (SELECT unnest([0, 1]) AS t) WHERE r < n AND j + t <= m GROUP BY ALL),
ud AS (SELECT m, n, s - m * (m + 1) / 2 AS x, c / sum(c) OVER (PARTITION BY m, n) AS w FROM uq WHERE r = n AND j = m),
uexact AS (SELECT un.g, un.u, CASE WHEN small THEN least(1.0, 2 * coalesce((SELECT sum(w) FROM ud WHERE ud.m = un.m AND ud.n = un.n AND x >= big), 0.0)) ELSE mw.p END AS p FROM un JOIN mw USING (g))"""


def mann_whitney(source: str, arms: Sequence[int]) -> str:
    """CTEs up to mw(g, u, p)."""
    return f"""ur AS (SELECT g, treat, price, rank() OVER (PARTITION BY g ORDER BY price) + (count(*) OVER (PARTITION BY g, price) - 1) / 2 AS r FROM {source}, (SELECT unnest({list(arms)}) AS g) WHERE treat IN (0, g)),
ut AS (SELECT g, sum(c * c * c - c) AS ties FROM (SELECT g, price, CAST(count(*) AS DOUBLE) AS c FROM ur GROUP BY ALL) GROUP BY g),
us AS (SELECT g, sum(r) FILTER (treat = 0) AS r1, CAST(count(*) FILTER (treat = 0) AS DOUBLE) AS n1, CAST(count(*) FILTER (treat <> 0) AS DOUBLE) AS n2 FROM ur GROUP BY g),
uz AS (SELECT g, r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, ties FROM us JOIN ut USING (g)),
uw AS (SELECT g, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM uz),
mw AS (SELECT g, u, CASE WHEN z > 0 THEN {normal_p('z')} ELSE 1.0 END AS p FROM uw)"""


def chi_square(source: str) -> str:
    """CTEs up to ch(g, x, df, p): priority of each arm against arm 0."""
    return f"""cc AS (SELECT treat, priority AS v, count(*) AS n FROM {source} GROUP BY ALL),
cg AS (SELECT treat, sum(n) AS n FROM cc GROUP BY 1),
cpool AS (SELECT treat, CASE WHEN n < 7 THEN 'other' ELSE v END AS v, sum(n) AS n FROM cc GROUP BY ALL HAVING CASE WHEN n < 7 THEN 'other' ELSE v END <> 'other' OR sum(n) >= 7),
carm AS (SELECT t.treat AS g, c.n / (c.n + t.n) AS share FROM cg t, cg c WHERE c.treat = 0 AND t.treat > 0),
cw AS (SELECT g, v, sum(CASE WHEN treat = 0 THEN n * (1 - share) ELSE 0 END) AS o1, sum(CASE WHEN treat = g THEN n * share ELSE 0 END) AS o2 FROM carm, cpool WHERE treat IN (0, g) GROUP BY g, v),
ct AS (SELECT *, o1 + o2 AS r, sum(o1) OVER a AS t1, sum(o2) OVER a AS t2, count(*) OVER a AS k FROM cw WINDOW a AS (PARTITION BY g)),
ce AS (SELECT *, r * t1 / (t1 + t2) AS e1, r * t2 / (t1 + t2) AS e2 FROM ct),
cd AS (SELECT *, abs(o1 - e1) - CASE WHEN k = 2 THEN least(0.5, abs(o1 - e1)) ELSE 0 END AS d1, abs(o2 - e2) - CASE WHEN k = 2 THEN least(0.5, abs(o2 - e2)) ELSE 0 END AS d2 FROM ce),
cx AS (SELECT g, CAST(max(k) - 1 AS DOUBLE) AS df, sum(d1 * d1 / e1 + d2 * d2 / e2) AS x FROM cd GROUP BY g),
ch AS (SELECT g, x, df, {chi2_p('x', 'df')} AS p FROM cx)"""


def student(source: str, pooled: bool) -> str:
    """CTEs up to st(g, n1, n2, m1, m2, t, df, p)."""
    error = "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))" if pooled else "sqrt(v1 / n1 + v2 / n2)"
    df = "CAST(n1 + n2 - 2 AS DOUBLE)" if pooled else "(v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1))"
    return f"""sm AS (SELECT treat, count(price) AS n, avg(price) AS m, var_samp(price) AS v FROM {source} GROUP BY 1),
sp AS (SELECT t.treat AS g, c.n AS n1, c.m AS m1, c.v AS v1, t.n AS n2, t.m AS m2, t.v AS v2 FROM sm t, sm c WHERE c.treat = 0 AND t.treat > 0),
sw AS (SELECT *, (m1 - m2) / {error} AS t, {df} AS df FROM sp),
st AS (SELECT *, {t_p('t', 'df')} AS p FROM sw)"""


def _verdict(p: str, significant_is_ok: bool) -> str:
    good, bad = ("OK", "NOT OK") if significant_is_ok else ("NOT OK", "OK")
    return f"CASE WHEN {p} < 0.05 THEN '{good}' ELSE '{bad}' END"


def resume(orders: str, arms: Sequence[int], tests: Sequence[str], pooled: bool, significant_is_ok: bool, sizes: bool) -> str:
    """One row for price and one for priority of each arm, rounded to 4 digits."""
    table = {"t-test": "st", "u-test": "mw", "ks-test": "ks", "chi2-test": "ch"}
    cells = {"price": [], "priority": []}
    for test in tests:
        p = f"{table[test]}.p"
        for feature in cells:
            here = (test == "chi2-test") == (feature == "priority")
            cells[feature] += [f"{f'round({p}, 4) + 0.0' if here else 'CAST(NULL AS DOUBLE)'} AS \"{test} p-value\"", f"{_verdict(p, significant_is_ok) if here else 'CAST(NULL AS VARCHAR)'} AS \"{test} verdict\""]
    means = {"price": "round(m1, 4) AS control_mean, round(m2, 4) AS test_mean, round(m2 - m1, 4) AS difference, round((m2 / m1 - 1) * 100, 4) AS difference_pct", "priority": "NULL, NULL, NULL, NULL"}
    size = ", (SELECT count(*) FROM o WHERE treat = 0) AS control_size, (SELECT count(*) FROM o WHERE treat = st.g) AS test_size" if sizes else ""
    joined = "st" + "".join(f" JOIN {table[t]} ON {table[t]}.g = st.g" for t in tests if t != "t-test")
    ctes = [orders, student("o", pooled), ks("o", arms), mann_whitney("o", arms), chi_square("o")]
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(st.g AS VARCHAR) AS \"group\", {', '.join(cells[f])}, {means[f]}{size} FROM {joined}" for f in cells)
    return f"WITH {', '.join(ctes)} {rows}"


def holm(orders: str, arms: Sequence[int]) -> str:
    """Holm's correction of the t and U tests' p-values, each test a family."""
    return f"""WITH {orders}, {student('o', False)}, {mann_whitney('o', arms)},
p AS (SELECT 't-test' AS test, g, p FROM st UNION ALL SELECT 'u-test', g, p FROM mw),
r AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY p) AS i, count(*) OVER (PARTITION BY test) AS m FROM p),
a AS (SELECT *, least(1.0, max(p * (m - i + 1)) OVER (PARTITION BY test ORDER BY p ROWS UNBOUNDED PRECEDING)) AS n FROM r)
SELECT 'price' AS feature, CAST(g AS VARCHAR) AS "group", test, round(p, 6) AS p_value, round(n, 6) AS new_p_value, round(CASE WHEN p = 0 THEN 0.0 ELSE p / n END, 6) AS correction, n <= 0.05 AS rejected FROM a"""


def best_arm(orders: str, arms: int) -> str:
    """The first arm whose least scaled difference is beyond the quantile 1 - 0.05 / arms of equal arms.

    Beyond the quantile means that a tail is small: the integral of f(x) F(x - t sqrt 2) ** (arms - 1),
    with F summed up over a grid of 1/1000.
    """
    return f"""WITH {orders},
m AS (SELECT treat, avg(price) AS m, var_samp(price) AS v FROM o GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM o),
t AS (SELECT a.treat AS g, min(sqrt(n) * (a.m - b.m) / sqrt((a.v + b.v) * n / (n - 1))) AS t FROM m a, m b, n WHERE a.treat <> b.treat GROUP BY 1),
f AS (SELECT k, exp(-0.5 * (k / 1000.0) ^ 2) / sqrt(2 * pi()) AS f FROM range(-9000, 9001) r(k)),
c AS (SELECT k, f, sum(f) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / 1000 AS c FROM f),
tail AS (SELECT g, sum(a.f * b.c ^ {arms - 1}) / 1000 AS p FROM t, c a JOIN c b ON b.k = greatest(-9000, least(9000, CAST(round(a.k - 1000 * least(greatest(t.t, -6), 6) * sqrt(2)) AS BIGINT))) GROUP BY g)
SELECT 'price' AS target, CAST(coalesce(min(g) FILTER (p < 0.05 / {arms}) + 1, 0) AS BIGINT) AS accepted FROM tail"""


def minimal_size(orders: str, arms: int, mde: float, alpha: float = 0.05, power: float = 0.2) -> str:
    """Rows of an arm from two quantiles of the least scaled difference, each found by bisection of a grid sum.

    The normal distribution function is a table of trapezoid sums, carried on by two terms of a series.
    """
    phi = "exp(-0.5 * {x} * {x}) / sqrt(2 * pi())"
    x = "(i / 100.0 - (lo + hi) / 2 * sqrt(2))"
    at = f"CAST(round(greatest(-9.0, least(9.0, {x})) * 1000) AS BIGINT)"
    off = f"(greatest(-9.0, least(9.0, {x})) - {at} / 1000.0)"
    cdf = f"(cdf[{at} + 9001] + {phi.format(x=f'({at} / 1000.0)')} * {off} * (1 - {at} / 2000.0 * {off}))"
    above = f"list_sum(list_transform(range(-900, 901), lambda i: {phi.format(x='(i / 100.0)')} * {cdf} ^ {arms - 1})) / 100"
    return f"""WITH RECURSIVE {orders},
f AS (SELECT k, {phi.format(x='(k / 1000.0)')} AS f FROM range(-9000, 9001) r(k)),
c AS (SELECT list(c ORDER BY k) AS cdf FROM (SELECT k, (sum(f) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - f / 2) / 1000 AS c FROM f)),
q AS (SELECT level, CAST(-9 AS DOUBLE) AS lo, CAST(9 AS DOUBLE) AS hi, 0 AS step, cdf FROM c, (SELECT unnest([CAST({1 - alpha / arms} AS DOUBLE), {power}]) AS level)
  UNION ALL
  SELECT level, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END, step + 1, cdf
  FROM (SELECT *, 1 - {above} < level AS low FROM q WHERE step < 36)),
g AS (SELECT max(lo) - min(lo) AS gap FROM q WHERE step = 36),
v AS (SELECT avg(v) AS v FROM (SELECT var_samp(price) AS v FROM o GROUP BY treat))
SELECT unnest(['price', 'overall']) AS target, CAST(floor(2 * v * (gap / {mde}) ^ 2) + 1 AS BIGINT) AS size FROM g, v"""


def two_stage(p_values: str) -> str:
    """hommel, fdr_tsbh and fdr_tsbky of r(id, p_value, i, m)."""
    return f"""WITH {p_values},
h AS (SELECT j, min(j * p_value / (i - (m - j))) AS c FROM r, range(2, 26) q(j) WHERE i > m - j GROUP BY j),
hommel AS (SELECT id, p_value, greatest(p_value, max(CASE WHEN i > m - j THEN c ELSE least(c, j * p_value) END)) AS n FROM r, h GROUP BY id, p_value),
b AS (SELECT *, min(p_value * m / i) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING) AS f FROM r),
s AS (SELECT 'fdr_tsbh' AS method, 0.05 AS level, 1.0 AS scale UNION ALL SELECT 'fdr_tsbky', 0.05 / 1.05, 1.05),
l AS (SELECT method, scale, count(*) - count(*) FILTER (f <= level) AS rest, count(*) AS m FROM b, s GROUP BY ALL),
staged AS (SELECT method, id, p_value, f * scale * CASE WHEN rest IN (0, l.m) THEN 1.0 ELSE rest / l.m END AS n FROM b, l),
a AS (SELECT 'hommel' AS method, id, p_value, least(1.0, n) AS n, n <= 0.05 AS rejected FROM hommel UNION ALL SELECT method, id, p_value, least(1.0, n), n <= 0.05 FROM staged)
SELECT id, round(p_value, 6) AS p_value, round(n, 6) AS new_p_value, round(p_value / n, 6) AS correction, rejected, method FROM a"""


def aa(strata: str = "") -> str:
    """CTEs up to run(seed, tp, kp, m1, m2): ten splits of the customers, tested."""
    by = f"seed, {strata}" if strata else "seed"
    return f"""s AS (SELECT c_custkey, c_acctbal AS x, seed, row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), c_custkey) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM customer, (SELECT unnest(range(0, 10)) AS seed)),
h AS (SELECT seed, x, r <= floor(n * 0.5) AS first FROM s),
m AS (SELECT seed, avg(x) FILTER (first) AS m1, var_samp(x) FILTER (first) AS v1, CAST(count(*) FILTER (first) AS DOUBLE) AS n1, avg(x) FILTER (NOT first) AS m2, var_samp(x) FILTER (NOT first) AS v2, CAST(count(*) FILTER (NOT first) AS DOUBLE) AS n2 FROM h GROUP BY seed),
w AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)) AS df FROM m),
c AS (SELECT seed, x, count(*) FILTER (first) AS c1, count(*) FILTER (NOT first) AS c2 FROM h GROUP BY ALL),
u AS (SELECT seed, sum(c1) OVER q AS u1, sum(c2) OVER q AS u2 FROM c WINDOW q AS (PARTITION BY seed ORDER BY x ROWS UNBOUNDED PRECEDING)),
d AS (SELECT w.seed, max(abs(u1 / n1 - u2 / n2)) * any_value(sqrt(n1 * n2 / (n1 + n2))) AS z FROM u JOIN w USING (seed) GROUP BY ALL),
k AS (SELECT seed, {kolmogorov_p('z')} AS kp FROM d),
run AS (SELECT w.seed, {t_p('t', 'df')} AS tp, kp, m1, m2 FROM w JOIN k USING (seed)),
scored AS (SELECT *, (tp + 2 * kp) / 3 AS mean_test_score, (tp + kp) / 2 AS mean_p, (tp + kp) / 2 * 2 / 3 + (tp + 2 * kp) / 3 / 3 AS score FROM run)"""


EFFECTS = f"""w AS (SELECT match AS id, count(*) AS k FROM k WHERE rank = 1 GROUP BY 1),
z AS (SELECT e.*, coalesce(w.k, 0) AS k FROM e LEFT JOIN w USING (id)),
s AS (SELECT count(*) FILTER (treat = 1) AS nt, count(*) FILTER (treat = 0) AS nc, avg(effect) FILTER (treat = 1) AS att, avg(effect) FILTER (treat = 0) AS atc, var_samp(effect) FILTER (treat = 1) AS vc, var_samp(effect) FILTER (treat = 0) AS vt, sum(k * k) FILTER (treat = 0) AS kc, sum(k * k) FILTER (treat = 1) AS kt, sum((1 + k) ^ 2) FILTER (treat = 0) AS k1c, sum((1 + k) ^ 2) FILTER (treat = 1) AS k1t FROM z),
f AS (SELECT 'ATT' AS metric, att AS v, sqrt(kc * vt / (nt * nt) + vc / nt) AS se FROM s UNION ALL SELECT 'ATC', atc, sqrt(kt * vc / (nc * nc) + vt / nc) FROM s UNION ALL SELECT 'ATE', (nt * att + nc * atc) / (nt + nc), sqrt(k1c * vt + k1t * vc) / (nt + nc) FROM s),
y AS (SELECT metric, v, se, v / se AS q FROM f)
SELECT metric, round(v, 4) + 0.0 AS effect_size, round(se, 4) AS standard_error, round({normal_p('q')}, 4) AS p_value, round(v - 1.96 * se, 4) + 0.0 AS ci_lower, round(v + 1.96 * se, 4) + 0.0 AS ci_upper"""

PLAIN = "e AS (SELECT q.id, q.treat, CASE WHEN q.treat = 1 THEN q.y - m.y ELSE m.y - q.y END AS effect FROM k JOIN u q ON q.id = k.query JOIN u m ON m.id = k.match WHERE rank = 1)"

#: Least squares of the matched outcome on both matched features, for either side.
CORRECTED = """j AS (SELECT q.id, q.treat, q.y, m.y AS ym, q.x1, q.x2, m.x1 AS a, m.x2 AS b FROM k JOIN u q ON q.id = k.query JOIN u m ON m.id = k.match WHERE rank = 1),
g AS (SELECT treat, (covar_pop(ym, a) * var_pop(b) - covar_pop(ym, b) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ^ 2) AS s1, (covar_pop(ym, b) * var_pop(a) - covar_pop(ym, a) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ^ 2) AS s2 FROM j GROUP BY treat),
e AS (SELECT id, j.treat, (CASE WHEN j.treat = 1 THEN 1 ELSE -1 END) * (y - ym + s1 * (a - x1) + s2 * (b - x2)) AS effect FROM j JOIN g USING (treat))"""
