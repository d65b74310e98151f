"""Statistics over trades and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.functions.costs import fee_table
from tickloom.functions.distributions import normal_cdf_sql
from tickloom.operators import stats
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_sources import TIERS
from tickloom.plans.registry import query

ROW = "PARTITION BY symbol ORDER BY us, seq"
DAILY = "dl AS (SELECT series, day, sum(net_bp) AS net, count(*) AS trades, avg(net_bp) AS mean_net FROM fx_li_trades GROUP BY 1, 2)"


def daily(fx: Fixtures) -> DataFrame:
    return fx.li_trades.groupBy("series", "day").agg(
        F.sum("net_bp").alias("net"),
        F.count(F.lit(1)).alias("trades"),
        F.avg("net_bp").alias("mean_net"),
    )


@query(
    "e1_cluster_significance",
    """
    WITH c AS (SELECT day, avg(net_bp) AS m FROM fx_li_trades GROUP BY 1),
    p AS (SELECT series, day, avg(net_bp) AS v FROM fx_li_trades GROUP BY 1, 2),
    r AS (SELECT avg(cr) AS correlation FROM (SELECT corr(a.v, b.v) AS cr FROM p a JOIN p b ON
      a.day = b.day AND a.series < b.series GROUP BY a.series, b.series)),
    t AS (SELECT count(*) AS trades, avg(net_bp) AS trade_mean_bp, avg(net_bp) / (stddev_samp(net_bp)
      / sqrt(count(*))) AS trade_t, count(DISTINCT series) AS members FROM fx_li_trades),
    k AS (SELECT count(*) AS clusters, avg(m) AS cluster_mean_bp, avg(m) / (stddev_samp(m)
      / sqrt(count(*))) AS cluster_t, count_if(m > 0) AS positive_clusters FROM c)
    SELECT *, members / (1 + (members - 1) * greatest(0, least(correlation, 0.999)))
      AS effective_per_cluster FROM t, k, r""",
    d="trade_mean_bp trade_t cluster_mean_bp cluster_t correlation effective_per_cluster",
    i="positive_clusters",
)
def e1(fx: Fixtures) -> DataFrame:
    return stats.assess(fx.li_trades)


@query(
    "e2_effective_count",
    """
    WITH p AS (SELECT series, day, avg(net_bp) AS v FROM fx_li_trades GROUP BY 1, 2)
    SELECT a.series AS a, b.series AS b, corr(a.v, b.v) AS corr FROM p a JOIN p b ON a.day = b.day
      AND a.series < b.series GROUP BY 1, 2""",
    d="corr",
)
def e2(fx: Fixtures) -> DataFrame:
    return stats.pair_correlations(daily(fx), "series", "day", "mean_net")


@query(
    "e3_newey_west",
    f"""
    WITH {DAILY}, c AS (SELECT series, day, net - avg(net) OVER (PARTITION BY series) AS c,
      avg(net) OVER (PARTITION BY series) AS m, count(*) OVER (PARTITION BY series) AS n FROM dl),
    l AS (SELECT *, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 3) OVER w AS l3 FROM c
      WINDOW w AS (PARTITION BY series ORDER BY day)),
    v AS (SELECT series, any_value(n) AS days, any_value(m) AS mean, (sum(c * c) + 2 * (0.75 *
      sum(c * l1) + 0.5 * sum(c * l2) + 0.25 * sum(c * l3))) / any_value(n) AS v FROM l GROUP BY 1)
    SELECT series, days, mean, sqrt(v / days) AS se, mean / sqrt(v / days) AS t FROM v""",
    d="mean se t",
)
def e3(fx: Fixtures) -> DataFrame:
    return stats.newey_west(daily(fx), ["series"], "net", "day", 3)


@query(
    "e4_detectable_effect_and_power",
    f"""
    WITH {DAILY}, s AS (SELECT series, count(*) AS days, avg(net) AS mean, stddev_samp(net) AS sd
      FROM dl GROUP BY 1)
    SELECT series, 3.84 * sd / sqrt(days) AS mde, {normal_cdf_sql('(abs(mean) * sqrt(days) / sd - 3)')}
      AS power FROM s""",
    d="mde power",
)
def e4(fx: Fixtures) -> DataFrame:
    found = stats.day_t(daily(fx), ["series"], "net")
    days = F.col("days").cast("double")
    return found.select(
        "series",
        stats.minimum_detectable_effect(F.col("sd"), days).alias("mde"),
        stats.power_at_bar(F.abs("mean"), F.col("sd"), days).alias("power"),
    )


P_SQL = """
    tp AS (SELECT k.*, abs(t) AS ta, atan(abs(t) / sqrt(days - 1)) AS th FROM k),
    sr AS (SELECT tp.*, (SELECT coalesce(sum(exp(ls)), 0) FROM (SELECT sum(ln(cos(th) * cos(th) *
      CASE WHEN (days - 1) % 2 = 0 THEN (2 * j - 1) / (2 * j) ELSE (2 * j) / (2 * j + 1) END))
      OVER (ORDER BY j) AS ls FROM range(1, CASE WHEN (days - 1) % 2 = 0 THEN (days - 1) // 2
      ELSE (days - 2) // 2 END) g(j))) + 1 AS total FROM tp),
    pv AS (SELECT sr.*, CASE WHEN (days - 1) % 2 = 0 THEN sin(th) * total ELSE 2 / pi() * (th +
      sin(th) * cos(th) * total) END AS inside FROM sr)"""
P_VALUE = "CASE WHEN t >= 0 THEN (1 - inside) / 2 ELSE (1 + inside) / 2 END"
DAY_T = f"""
    {DAILY}, k AS (SELECT series, count(*) AS days, avg(net) AS mean, stddev_samp(net) AS sd,
      count_if(net > 0) AS positive_days, avg(net) / (stddev_samp(net) / sqrt(count(*))) AS t
      FROM dl GROUP BY 1), {P_SQL}"""


@query(
    "e5_day_level_t",
    f"WITH {DAY_T} SELECT series, days, mean, sd, positive_days, t, {P_VALUE} AS p_one_sided FROM pv",
    d="mean sd t p_one_sided",
    i="positive_days",
)
def e5(fx: Fixtures) -> DataFrame:
    return stats.day_t(daily(fx), ["series"], "net")


CELL_SHARPE = """
    sh AS (SELECT key, count(*) AS days, avg(net_bp) / stddev_samp(net_bp) AS sharpe, avg(net_bp)
      AS m, stddev_pop(net_bp) AS s FROM fx_cells GROUP BY 1),
    mo AS (SELECT key, any_value(days) AS days, any_value(sharpe) AS sharpe, avg(pow((net_bp - m) / s,
      3)) AS skewness, avg(pow((net_bp - m) / s, 4)) AS kurtosis FROM fx_cells JOIN sh USING (key)
      GROUP BY 1)"""


def cell_sharpes(fx: Fixtures) -> DataFrame:
    return stats.sharpe_table(fx.cells, "key", "net_bp")


def phi(x: str) -> str:
    """Normal distribution function in SQL: Simpson's rule over a thousand steps from zero."""
    weight = "CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 1001), lambda k: ({weight}) * exp(-pow(({x}) * k / 1000, 2) / 2)))"
    return f"(0.5 + ({x}) / 3000 * {area} / sqrt(2 * pi()))"


DEFLATED = f"""
    {CELL_SHARPE}, fs AS (SELECT CAST(count(sharpe) AS DOUBLE) AS n, var_samp(sharpe) AS v FROM mo),
    bi AS (SELECT 1 AS which, 1 - 1 / n AS p, -9.0::DOUBLE AS low, 9.0::DOUBLE AS high, 0 AS i FROM fs
      UNION ALL SELECT 2, 1 - 1 / (n * exp(1)), -9.0, 9.0, 0 FROM fs
      UNION ALL SELECT which, p, CASE WHEN {phi('(low + high) / 2')} < p THEN (low + high) / 2 ELSE low END,
        CASE WHEN {phi('(low + high) / 2')} < p THEN high ELSE (low + high) / 2 END, i + 1 FROM bi WHERE i < 50),
    bm AS (SELECT sqrt(v) * (max(CASE WHEN which = 1 THEN low END) * (1 - {stats.EULER_GAMMA}) +
      max(CASE WHEN which = 2 THEN low END) * {stats.EULER_GAMMA}) AS benchmark FROM bi, fs WHERE i = 50 GROUP BY v),
    zz AS (SELECT key, days, sharpe, skewness, kurtosis, benchmark, (sharpe - benchmark) * sqrt(days - 1) /
      sqrt(1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS z FROM mo, bm)"""


@query(
    "e6_deflated_sharpe",
    f"WITH RECURSIVE {DEFLATED} SELECT * EXCLUDE (z), {phi('z')} AS dsr FROM zz",
    d="sharpe skewness kurtosis benchmark dsr",
)
def e6(fx: Fixtures) -> DataFrame:
    return stats.deflated_sharpe(cell_sharpes(fx))


@query(
    "e6_sharpe_probability",
    f"""
    WITH {CELL_SHARPE}, f AS (SELECT count(sharpe) AS n, var_samp(sharpe) AS v FROM mo)
    SELECT key, round(sqrt(v), 5) AS spread, n FROM mo, f""",
    d="spread",
)
def e6b(fx: Fixtures) -> DataFrame:
    scored = stats.deflated_sharpe(cell_sharpes(fx))
    facts = cell_sharpes(fx).agg(F.count("sharpe").alias("n"), F.var_samp("sharpe").alias("v"))
    return scored.join(F.broadcast(facts)).filter("dsr >= 0 AND dsr <= 1 AND benchmark > 0").select(
        "key", F.round(F.sqrt("v"), 5).alias("spread"), "n"
    )


BLOCKS = 10
MASKS = ", ".join(f"('{m}')" for m in stats.split_masks(BLOCKS))


@query(
    "e7_pbo_splits",
    f"""
    WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM
      (SELECT DISTINCT day FROM fx_cells)),
    b AS (SELECT day, CASE WHEN i < (n % {BLOCKS}) * (n // {BLOCKS} + 1) THEN i // (n // {BLOCKS} + 1) ELSE n % {BLOCKS} +
      (i - (n % {BLOCKS}) * (n // {BLOCKS} + 1)) // (n // {BLOCKS}) END AS bk FROM d),
    s AS (SELECT key, bk, sum(net_bp) AS v FROM fx_cells JOIN b USING (day) GROUP BY 1, 2),
    z AS (SELECT bk, count(*) AS n FROM b GROUP BY 1),
    ln_ AS (SELECT m, sum(CASE WHEN substr(m, CAST(bk AS INT) + 1, 1) = '1' THEN n END) AS a,
      sum(CASE WHEN substr(m, CAST(bk AS INT) + 1, 1) = '0' THEN n END) AS o FROM z,
      (VALUES {MASKS}) t(m) GROUP BY 1),
    r AS (SELECT m, key, coalesce(sum(CASE WHEN substr(m, CAST(bk AS INT) + 1, 1) = '1' THEN v END),
      0) AS a, coalesce(sum(CASE WHEN substr(m, CAST(bk AS INT) + 1, 1) = '0' THEN v END), 0) AS o
      FROM s, (VALUES {MASKS}) t(m) GROUP BY 1, 2),
    q AS (SELECT r.m, key, round(r.a / ln_.a, 9) AS a, round(r.o / ln_.o, 9) AS o FROM r JOIN ln_ USING (m)),
    k AS (SELECT m, key, row_number() OVER (PARTITION BY m ORDER BY a DESC, key) AS best, (rank()
      OVER (PARTITION BY m ORDER BY o) + (count(*) OVER (PARTITION BY m, o) - 1) / 2.0) /
      (count(*) OVER (PARTITION BY m) + 1) AS w FROM q)
    SELECT m AS mask, key AS chosen, ln(w / (1 - w)) AS logit FROM k WHERE best = 1""",
    d="logit",
)
def e7(fx: Fixtures) -> DataFrame:
    return stats.pbo_splits(fx.cells, "key", "day", "net_bp", BLOCKS)


@query(
    "e8_minimum_track_record",
    f"""
    WITH {CELL_SHARPE} SELECT key, CASE WHEN sharpe > -2 AND 1 - skewness * sharpe + (kurtosis - 1)
      / 4 * sharpe * sharpe > 0 THEN 1 + (1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe *
      sharpe) * pow(1.6448536269514722 / (sharpe + 2), 2) END AS minimum FROM mo""",
    d="minimum",
    digits=4,
)
def e8(fx: Fixtures) -> DataFrame:
    return stats.minimum_track_record(cell_sharpes(fx), -2.0).select("key", "minimum")


@query("e8_haircut_sharpe", None)
def e8b(fx: Fixtures) -> DataFrame:
    return stats.haircut_sharpe(cell_sharpes(fx)).select(
        "key", "sharpe", "p_value", "holm", "adjusted_sharpe"
    )


CELL_P = f"""
    k AS (SELECT key AS series, count(*) AS days, avg(net_bp) / (stddev_samp(net_bp) /
      sqrt(count(*))) AS t FROM fx_cells GROUP BY 1), {P_SQL},
    pp AS (SELECT series AS key, round(1 - ({P_VALUE}), 12) AS p FROM pv),
    rk AS (SELECT *, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS m FROM pp)"""


def cell_p(fx: Fixtures) -> DataFrame:
    found = stats.day_t(fx.cells, ["key"], "net_bp")
    # One-sided for a loss, so that the synthetic cells spread over the whole range.
    return found.select("key", F.round(F.lit(1.0) - F.col("p_one_sided"), 12).alias("p"))


@query(
    "e9_adjusted_p",
    f"""
    WITH {CELL_P}
    SELECT key, p, least(p * m, 1) AS bonferroni, least(max(p * (m - r + 1)) OVER (ORDER BY r), 1)
      AS holm, least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED
      FOLLOWING) * (SELECT sum(1.0 / r) FROM rk), 1) AS bhy FROM rk""",
    d="p bonferroni holm bhy",
)
def e9(fx: Fixtures) -> DataFrame:
    return stats.adjusted_p(cell_p(fx), "p")


@query(
    "e10_family_holm",
    f"""
    WITH {CELL_P}, fam AS (SELECT DISTINCT key FROM fx_cells),
    f AS (SELECT fam.key, coalesce(CASE WHEN fam.key NOT LIKE '7|%' THEN p END, 1.0) AS p_value
      FROM fam LEFT JOIN pp USING (key)),
    g AS (SELECT *, row_number() OVER (ORDER BY p_value, key) AS r, count(*) OVER () AS m FROM f)
    SELECT key, p_value, least(max(p_value * (m - r + 1)) OVER (ORDER BY r), 1) <= 0.05 AS passes
    FROM g""",
    d="p_value",
)
def e10(fx: Fixtures) -> DataFrame:
    family = fx.cells.select("key").distinct()
    found = cell_p(fx).filter(~F.col("key").startswith("7|"))
    return stats.family_holm(found, family, "key", "p")


SHIFTED = f"""
    {DAILY}, rk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i,
      count(*) OVER (PARTITION BY series) AS n FROM dl),
    sh AS (SELECT a.series, s AS shift, avg(sign(a.net) * b.net) AS value FROM rk a, range(1, 20)
      t(s) JOIN rk b ON true WHERE b.series = a.series AND b.i = (a.i + s) % a.n GROUP BY 1, 2)"""


def shifted(fx: Fixtures) -> DataFrame:
    rows = stats.rotated_pairs(daily(fx), list(range(1, 20)), ["series"], "day")
    source = rows.filter("shift = 1").select("series", F.col("_i").alias("_j"), F.col("net").alias("later"))
    joined = rows.join(source, ["series", "_j"])
    return joined.groupBy("series", "shift").agg(
        F.avg(F.signum("net") * F.col("later")).alias("value")
    )


@query(
    "e11_placebo_percentile",
    f"""
    WITH {SHIFTED} SELECT series, quantile_cont(value, 0.95) AS level, count(value) AS draws FROM sh
    GROUP BY 1""",
    d="level",
)
def e11(fx: Fixtures) -> DataFrame:
    return stats.placebo_level(shifted(fx), "value", by=["series"])


@query(
    "e11_placebo_p",
    f"""
    WITH {SHIFTED}, m AS (SELECT avg(value) AS truth FROM sh)
    SELECT count(value) AS draws, (count_if(value >= truth) + 1) / (count(value) + 1) AS p FROM sh, m
    GROUP BY truth""",
    d="p",
)
def e11_p(fx: Fixtures) -> DataFrame:
    draws = shifted(fx)
    return stats.placebo_p(draws, draws.agg(F.avg("value").alias("truth")), "value", "truth")


@query(
    "e12_rotated_placebos",
    f"""
    WITH {SHIFTED}, t AS (SELECT series, avg(abs(net)) AS truth FROM dl GROUP BY 1)
    SELECT series, truth, count_if(value < truth) / count(*) AS share_beaten FROM sh JOIN t
      USING (series) GROUP BY 1, 2""",
    d="truth share_beaten",
)
def e12(fx: Fixtures) -> DataFrame:
    truth = daily(fx).groupBy("series").agg(F.avg(F.abs("net")).alias("truth"))
    joined = shifted(fx).join(truth, "series")
    return joined.groupBy("series", "truth").agg(
        F.avg((F.col("value") < F.col("truth")).cast("double")).alias("share_beaten")
    )


@query(
    "e13_verdicts",
    f"""
    WITH {DAY_T}, pw AS (SELECT series, days, mean, t, {P_VALUE} AS p_one_sided, -1.0
      AS placebo_level FROM pv),
    h AS (SELECT *, least(max(p_one_sided * (m - r + 1)) OVER (ORDER BY r), 1) AS holm FROM
      (SELECT *, row_number() OVER (ORDER BY p_one_sided) AS r, count(*) OVER () AS m FROM pw))
    SELECT series, CASE WHEN NOT mean > 0 THEN 'killed: mean' WHEN NOT mean > placebo_level THEN
      'killed: placebo' WHEN days < 100 THEN 'inconclusive: days' WHEN holm <= 0.05 AND t >= 3 THEN
      'passes' ELSE 'not shown' END AS status FROM h""",
)
def e13(fx: Fixtures) -> DataFrame:
    modes = stats.day_t(daily(fx), ["series"], "net").select(
        "series", "days", "mean", "t", "p_one_sided", F.lit(-1.0).alias("placebo_level")
    )
    return stats.verdicts(modes, 100).select("series", "status")


@query(
    "e14_headroom",
    """
    WITH f AS (SELECT avg(net_bp) AS net, avg(gross_bp) AS gross, avg(CASE WHEN okey % 4 <> 0 THEN 1.0
      ELSE 0.0 END) AS fr, avg(CASE WHEN okey % 4 <> 0 THEN CASE WHEN gross_bp > 0 THEN 1.0 ELSE 0.0
      END END) AS hit, coalesce(-avg(CASE WHEN okey % 4 <> 0 AND gross_bp < 0 THEN gross_bp END), 0)
      AS loss FROM fx_li_trades)
    SELECT CASE WHEN gross > 0 THEN gross END AS cost_to_break_even_bp, CASE WHEN net >= 0 THEN 0
      WHEN fr * 2 * loss > 0 AND -net / (fr * 2 * loss) <= 1 - hit THEN -net / (fr * 2 * loss) END
      AS hit_gain_to_break_even, d AS hit_gain, net + fr * 2 * loss * d AS net_per_attempt_bp
    FROM f, (VALUES (0.01), (0.02), (0.05), (0.1)) t(d)""",
    d="cost_to_break_even_bp hit_gain_to_break_even hit_gain net_per_attempt_bp",
)
def e14(fx: Fixtures) -> DataFrame:
    return stats.headroom(fx.li_trades.withColumn("filled", F.col("okey") % 4 != 0))


@query(
    "e15_ic_by_horizon",
    f"""
    WITH m AS (SELECT imb, 1e4 * ln(lead(mid, 5) OVER ({ROW}) / mid) AS f5, 1e4 * ln(lead(mid, 20)
      OVER ({ROW}) / mid) AS f20 FROM fx_decisions)
    SELECT 5 AS horizon, corr(imb, f5) AS ic FROM m UNION ALL SELECT 20, corr(imb, f20) FROM m""",
    d="ic",
    i="horizon",
)
def e15(fx: Fixtures) -> DataFrame:
    rows = fx.decisions.select("symbol", "us", "seq", "imb")
    for h in (5, 20):
        moves = labels.forward_return(fx.book, h, spine=fx.spine, name=f"fwd_{h}")
        rows = rows.join(moves, ["symbol", "us", "seq"])
    return stats.ic_by_horizon(rows, "imb", (5, 20))


CALIBRATED = f"""
    w AS (SELECT p_buy AS p, CASE WHEN lead(mid, 10) OVER ({ROW}) > mid THEN 1 ELSE 0 END AS y
      FROM fx_decisions),
    ed AS (SELECT list_sort(list_distinct(list(e))) AS e FROM (SELECT unnest(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM w)),
    bk AS (SELECT greatest(len(list_filter(e, lambda x: x < p)), 1) AS bucket, p, y FROM w, ed),
    rl AS (SELECT bucket, avg(p) AS predicted, avg(y) AS observed, count(*) AS n FROM bk GROUP BY 1)"""


@query(
    "e16_reliability",
    f"WITH {CALIBRATED} SELECT bucket, predicted, observed, n FROM rl",
    d="predicted observed",
    i="bucket",
)
def e16(fx: Fixtures) -> DataFrame:
    return stats.reliability(predictions(fx), "p_buy", "up", 5)


def predictions(fx: Fixtures) -> DataFrame:
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    rows = fx.decisions.join(moves, ["symbol", "us", "seq"])
    return rows.withColumn("up", F.coalesce((F.col("forward_bp") > 0).cast("int"), F.lit(0)))


@query(
    "e16_calibration_error",
    f"WITH {CALIBRATED} SELECT sum(abs(predicted - observed) * n) / sum(n) AS calibration_error "
    "FROM rl",
    d="calibration_error",
)
def e16b(fx: Fixtures) -> DataFrame:
    return stats.calibration_error(stats.reliability(predictions(fx), "p_buy", "up", 5))


@query(
    "e19_scorecard",
    f"""
    WITH {DAILY} SELECT series, sum(trades) AS trades, count(*) AS days, sum(net) AS net_bp,
      avg(net) / stddev_samp(net) AS sharpe, count_if(net > 0) / count(*) AS share_positive,
      min(net) AS worst_day FROM dl GROUP BY 1""",
    d="net_bp sharpe share_positive worst_day",
    i="trades",
    digits=4,
)
def e19(fx: Fixtures) -> DataFrame:
    return daily(fx).groupBy("series").agg(
        F.sum("trades").alias("trades"),
        F.count(F.lit(1)).alias("days"),
        F.sum("net").alias("net_bp"),
        F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sharpe"),
        F.avg((F.col("net") > 0).cast("double")).alias("share_positive"),
        F.min("net").alias("worst_day"),
    )


CELLS = """
    ct AS (SELECT key, a_line, a_flag, a_qty, avg(net_bp) AS mean_net, coalesce(avg(g_bp) /
      nullif(stddev_samp(g_bp) / sqrt(count(*)), 0), 0) AS t_g, sum(trades) / 2400.0 AS rate,
      sum(trades) AS trades FROM fx_cells GROUP BY 1, 2, 3, 4),
    nb AS (SELECT a.key, b.key AS neighbour FROM ct a JOIN ct b ON a.a_flag = b.a_flag
      AND abs(a.a_line - b.a_line) <= 1 AND abs(a.a_qty - b.a_qty) <= 1),
    sm AS (SELECT nb.key, median(b.mean_net) AS s, median(b.t_g) AS a FROM nb JOIN ct b
      ON b.key = nb.neighbour GROUP BY 1)"""


def cell_table(fx: Fixtures) -> DataFrame:
    return stats.cell_table(fx.cells, "key", ["a_line", "a_flag", "a_qty"], 2400)


def scored_cells(fx: Fixtures) -> DataFrame:
    table = cell_table(fx)
    near = stats.neighbourhoods(table, "key", ["a_line", "a_qty"], ["a_flag"])
    s = stats.neighbourhood_median(table, near, "key", "mean_net", "s")
    a = stats.neighbourhood_median(table, near, "key", "t_g", "a")
    return table.join(s, "key").join(a, "key")


@query("e20_neighbourhood_median", f"WITH {CELLS} SELECT key, s, a FROM sm", d="s a")
def e20(fx: Fixtures) -> DataFrame:
    return scored_cells(fx).select("key", "s", "a")


@query(
    "e21_admissible_choice",
    f"""
    WITH {CELLS} SELECT key, s, mean_net, a FROM ct JOIN sm USING (key) WHERE rate >= 0.1
    ORDER BY s DESC, mean_net DESC, key LIMIT 1""",
    d="s mean_net a",
)
def e21(fx: Fixtures) -> DataFrame:
    return stats.choose_cell(scored_cells(fx), "key", 0.1)


@query(
    "e22_carry_forward",
    """
    WITH mm AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month FROM fx_cells),
    p AS (SELECT month, key, sum(net_bp) / count(*) AS mean, sum(trades) AS tr FROM fx_cells JOIN mm
      ON day < month GROUP BY 1, 2 HAVING sum(trades) >= 20),
    b AS (SELECT month, key FROM p QUALIFY row_number() OVER (PARTITION BY month ORDER BY mean DESC,
      key) = 1),
    h AS (SELECT key, CAST(date_trunc('month', day) AS DATE) AS month, avg(net_bp) AS hb FROM fx_cells
      WHERE day >= CAST(date_trunc('month', day) AS DATE) + 2 GROUP BY 1, 2)
    SELECT month, key AS chosen, coalesce(hb, 0) AS held_bp FROM b LEFT JOIN h USING (key, month)""",
    d="held_bp",
)
def e22(fx: Fixtures) -> DataFrame:
    months = fx.cells.select(F.trunc("day", "month").alias("month")).distinct()
    return stats.carry_forward(fx.cells, "key", months, 2, 20)


@query(
    "e23_sign_flip_null",
    """
    WITH h AS (SELECT a_flag, key, dayofmonth(day) AS hour, sum(g_bp) AS s, count(*) AS n FROM fx_cells GROUP BY ALL),
    g AS (SELECT hour, d, 1 - 2 * ((CAST('0x' || substr(md5('7:' || hour || ':' || (d // 128)), CAST(d % 128 // 4 + 1 AS INT), 1)
      AS INT) >> CAST(d % 4 AS INT)) & 1) AS sign FROM (SELECT DISTINCT hour FROM h), (SELECT unnest(range(0, 999)) AS d)),
    o AS (SELECT a_flag, key, round(sum(s) / sum(n), 9) AS mean FROM h GROUP BY ALL),
    z AS (SELECT a_flag, key, d, round(sum(s * sign) / sum(n), 9) AS v FROM h JOIN g USING (hour) GROUP BY ALL),
    b AS (SELECT a_flag, d, max(v) AS v FROM z GROUP BY ALL),
    c AS (SELECT o.a_flag, o.key, count(*) FILTER (v >= mean) AS c FROM o JOIN z USING (a_flag, key) GROUP BY ALL),
    t AS (SELECT o.a_flag, o.key, count(*) FILTER (v >= mean) AS t FROM o JOIN b USING (a_flag) GROUP BY ALL)
    SELECT a_flag, key, mean, (c + 1) / 1000.0 AS p_cell, (t + 1) / 1000.0 AS p_stratum
    FROM o JOIN c USING (a_flag, key) JOIN t USING (a_flag, key)""",
    d="mean p_cell p_stratum",
)
def e23(fx: Fixtures) -> DataFrame:
    cells = fx.cells.withColumn("hour", F.dayofmonth("day"))
    return stats.sign_nulls(cells, "key", "a_flag", "hour", "g_bp")


@query(
    "e23_shift_null",
    """
    WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM
      (SELECT DISTINCT day FROM fx_cells)),
    c AS (SELECT key, i, any_value(n) AS n, sum(trades) AS w, sum(g_bp) AS v FROM fx_cells JOIN d USING (day) GROUP BY ALL),
    t AS (SELECT key, any_value(n) AS n, sum(w) AS total, sum(w * v) / sum(w) AS mean FROM c GROUP BY key),
    s AS (SELECT a.key, (b.i - a.i + a.n) % a.n AS s, sum(a.w * b.v) AS x FROM c AS a JOIN c AS b ON a.key = b.key
      GROUP BY ALL),
    z AS (SELECT t.key, any_value(mean) AS mean, any_value(n) - 13 AS shifts,
      count(*) FILTER (s BETWEEN 7 AND n - 7) AS seen,
      count(*) FILTER (s BETWEEN 7 AND n - 7 AND round(x / total, 6) >= round(mean, 6)) AS above
      FROM t JOIN s USING (key) GROUP BY t.key)
    SELECT key, mean, shifts, (above + CASE WHEN round(mean, 6) <= 0 THEN shifts - seen ELSE 0 END + 1) / (shifts + 1)
      AS p_value FROM z""",
    d="mean p_value",
    i="shifts",
)
def e23b(fx: Fixtures) -> DataFrame:
    return stats.shift_nulls(fx.cells, "key", "day", "trades", "g_bp")


@query(
    "e24_leaderboard",
    f"""
    WITH {CELLS} SELECT key, a_flag, mean_net, trades, row_number() OVER (ORDER BY mean_net DESC, key)
      AS rank, row_number() OVER (PARTITION BY a_flag ORDER BY mean_net DESC, key) AS stratum_rank
    FROM ct""",
    d="mean_net",
    i="trades",
)
def e24(fx: Fixtures) -> DataFrame:
    return stats.leaderboard(cell_table(fx), "key", "a_flag")


MARGINALS = f"""
    {CELLS}, mg AS (SELECT 'a_line' AS axis, CAST(a_line AS VARCHAR) AS value, count(*) AS cells,
      median(mean_net) AS mean_net, median(t_g) AS t_g FROM ct GROUP BY a_line UNION ALL
    SELECT 'a_flag', a_flag, count(*), median(mean_net), median(t_g) FROM ct GROUP BY a_flag UNION ALL
    SELECT 'a_qty', CAST(a_qty AS VARCHAR), count(*), median(mean_net), median(t_g) FROM ct
      GROUP BY a_qty)"""


@query("e25_marginals", f"WITH {MARGINALS} SELECT * FROM mg", d="mean_net t_g")
def e25(fx: Fixtures) -> DataFrame:
    return stats.marginals(cell_table(fx), ["a_line", "a_flag", "a_qty"], ["mean_net", "t_g"])


@query(
    "e25_axis_spread",
    f"WITH {MARGINALS} SELECT axis, max(mean_net) - min(mean_net) AS spread FROM mg GROUP BY 1",
    d="spread",
)
def e25b(fx: Fixtures) -> DataFrame:
    table = stats.marginals(cell_table(fx), ["a_line", "a_flag", "a_qty"], ["mean_net", "t_g"])
    return stats.axis_spread(table, "mean_net")


@query(
    "e26_regime_map",
    f"""
    WITH {DAILY}, u AS (SELECT series AS symbol, epoch_us(CAST(day AS TIMESTAMP)) AS us, net FROM dl),
    a AS (SELECT symbol, us, row_number() OVER (PARTITION BY symbol ORDER BY us) AS n FROM u
      WHERE net < -4000),
    p AS (SELECT u.*, coalesce(a.n, 0) AS segment FROM u ASOF LEFT JOIN a ON u.symbol = a.symbol
      AND u.us >= a.us)
    SELECT symbol, segment, min(us) AS start_us, max(us) AS end_us, count(*) AS days, avg(net)
      AS mean, CASE WHEN count(*) >= 10 THEN avg(net) / (stddev_samp(net) / sqrt(count(*))) END AS t,
      sum(net) AS cumulative_net FROM p GROUP BY 1, 2""",
    d="mean t cumulative_net",
    digits=4,
)
def e26(fx: Fixtures) -> DataFrame:
    rows = daily(fx).select(
        F.col("series").alias("symbol"),
        (F.unix_date("day").cast("long") * 86_400_000_000).alias("us"),
        F.col("net").alias("net_bp"),
    )
    return stats.regime_map(rows, rows.filter("net_bp < -4000"))


@query(
    "e27_allocator",
    f"""
    WITH {DAILY}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM
      (SELECT DISTINCT day FROM dl)),
    w AS (SELECT d.day, d.n, x.series, sum(x.trades) AS tr, sum(x.net) / sum(x.trades) AS edge FROM d
      JOIN d p ON p.n < d.n AND p.n >= d.n - 5 JOIN dl x ON x.day = p.day GROUP BY 1, 2, 3
      HAVING sum(x.trades) >= 10),
    b AS (SELECT n, arg_min(series, (-edge, series)) AS series, max(edge) AS edge, count(*) AS c
      FROM w GROUP BY 1)
    SELECT z.day, z.strategy, z.edge, z.candidates, dl.net AS realised_bp FROM (SELECT d.day,
      CASE WHEN b.edge >= 0 THEN b.series ELSE 'stand aside' END AS strategy, b.edge, coalesce(c, 0)
      AS candidates FROM d LEFT JOIN b USING (n) WHERE d.n > 5) z LEFT JOIN dl ON dl.day = z.day
      AND dl.series = z.strategy""",
    d="edge realised_bp",
)
def e27(fx: Fixtures) -> DataFrame:
    rows = daily(fx).select(
        "day", F.col("series").alias("strategy"), "trades", F.col("net").alias("net_bp")
    )
    return stats.allocate(rows, 5, 10, 0.0)


@query(
    "e29_pooled_groups",
    f"""
    WITH {DAILY}, w AS (SELECT *, CAST(year(day) AS VARCHAR) AS window_ FROM dl UNION ALL
      SELECT *, 'all' FROM dl)
    SELECT window_ AS "window", series, count(*) AS days, count_if(trades > 0) AS days_with_trade,
      sum(trades) AS trades, sum(net) / sum(trades) AS net_per_trade_bp, avg(net) AS net_bp_day_mean,
      avg(net) / (stddev_samp(net) / sqrt(count(*))) AS day_t, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0
      END) AS share_positive FROM w GROUP BY 1, 2""",
    d="net_per_trade_bp net_bp_day_mean day_t share_positive",
    i="days_with_trade trades",
)
def e29(fx: Fixtures) -> DataFrame:
    rows = daily(fx).select(
        "series", "trades", F.col("net").alias("net_bp"), F.year("day").cast("string").alias("window")
    )
    return stats.pooled_groups(rows, "window", ["series"])


@query(
    "e30_board_by_track",
    f"""
    WITH {CELL_P.split('    rk AS')[0].rstrip().rstrip(',')}
    SELECT track, key, p, least(max(p * (m - r + 1)) OVER (PARTITION BY track ORDER BY r), 1) AS holm
    FROM (SELECT *, split_part(key, '|', 2) AS track, row_number() OVER (PARTITION BY
      split_part(key, '|', 2) ORDER BY p, key) AS r, count(*) OVER (PARTITION BY
      split_part(key, '|', 2)) AS m FROM pp)""",
    d="p holm",
)
def e30(fx: Fixtures) -> DataFrame:
    board = cell_p(fx).withColumn("track", F.split("key", r"\|")[1])
    return stats.adjusted_p(board, "p", ["track"]).select("track", "key", "p", "holm")


@query(
    "e31_trial_ledger",
    """
    WITH a AS (SELECT DISTINCT key FROM fx_cells WHERE a_line <= 4), b AS (SELECT DISTINCT key FROM
      fx_cells WHERE a_line >= 3)
    SELECT run, key FROM (SELECT 'first' AS run, key FROM a UNION ALL SELECT 'second', key FROM b
      WHERE key NOT IN (SELECT key FROM a))""",
)
def e31(fx: Fixtures) -> DataFrame:
    ledger = fx.cells.filter("a_line <= 4").select(F.lit("first").alias("run"), "key").distinct()
    rows = fx.cells.filter("a_line >= 3").select(F.lit("second").alias("run"), "key").distinct()
    return stats.ledger_append(ledger, rows, ["key"])


@query(
    "e32_cell_catalogue",
    """
    SELECT a.a_line, b.a_flag, 'a_line=' || a.a_line || '|a_flag=' || b.a_flag AS key,
      sha256('a_line=' || a.a_line || '|a_flag=' || b.a_flag) AS sha
    FROM (SELECT DISTINCT a_line FROM fx_cells) a, (SELECT DISTINCT a_flag FROM fx_cells) b""",
)
def e32(fx: Fixtures) -> DataFrame:
    return stats.catalogue(fx.cells, ["a_line", "a_flag"])


@query("e33_fingerprint", None)
def e33(fx: Fixtures) -> DataFrame:
    return stats.fingerprint(fx.prints, ["symbol"])


@query(
    "e34_by_side_and_tier",
    f"""
    WITH {TIERS}, s AS (SELECT day, CASE WHEN okey % 2 = 0 THEN 1 ELSE -1 END AS side, sum(net_bp)
      AS net, count(*) AS trades FROM fx_li_trades GROUP BY 1, 2)
    SELECT day, side, tier, trades, net - 2 * (taker_bp - 5.5) * trades AS net_bp FROM s, fees""",
    d="net_bp",
    i="side",
)
def e34(fx: Fixtures) -> DataFrame:
    sided = fx.li_trades.withColumn("side", F.when(F.col("okey") % 2 == 0, 1).otherwise(-1))
    return stats.by_side_and_tier(sided, fee_table(fx.spark), 5.5)


@query(
    "e35_summary_by_model",
    """
    SELECT split_part(key, '|', 2) AS model, count(DISTINCT key) AS folds, sum(trades) AS trades,
      sum(net_bp) AS net_bp, sum(net_bp) / sum(trades) AS net_per_trade_bp FROM fx_cells GROUP BY 1""",
    d="net_bp net_per_trade_bp",
    i="trades",
    digits=4,
)
def e35(fx: Fixtures) -> DataFrame:
    return fx.cells.groupBy(F.split("key", r"\|")[1].alias("model")).agg(
        F.count_distinct("key").alias("folds"),
        F.sum("trades").alias("trades"),
        F.sum("net_bp").alias("net_bp"),
        (F.sum("net_bp") / F.sum("trades")).alias("net_per_trade_bp"),
    )


@query(
    "e36_null_quantiles",
    f"""
    WITH {SHIFTED} SELECT series, quantile_cont(value, 0.05) AS q05, median(value) AS q50,
      quantile_cont(value, 0.95) AS q95 FROM sh GROUP BY 1""",
    d="q05 q50 q95",
)
def e36(fx: Fixtures) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = shifted(fx).groupBy("series").agg(q.alias("q"))
    return out.select(
        "series", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95")
    )


@query(
    "e37_regime_attribution",
    """
    WITH d AS (SELECT day, sum(net_bp) AS net FROM fx_li_trades GROUP BY 1)
    SELECT avg(CASE WHEN day(day) <= 5 THEN net END) AS inside_bp, avg(CASE WHEN day(day) > 5 THEN net
      END) AS outside_bp FROM d""",
    d="inside_bp outside_bp",
)
def e37(fx: Fixtures) -> DataFrame:
    days = fx.li_trades.groupBy("day").agg(F.sum("net_bp").alias("net_bp"))
    out = stats.attribution(days, days.filter(F.dayofmonth("day") <= 5).select("day"), 50)
    return out.select("inside_bp", "outside_bp")


@query(
    "e38_paired_daily_difference",
    f"""
    WITH {DAILY}, a AS (SELECT split_part(series, 'F', 1) AS s, day, net FROM dl WHERE series LIKE
      '%F'), b AS (SELECT split_part(series, 'O', 1) AS s, day, net FROM dl WHERE series LIKE '%O')
    SELECT day, avg(a.net - b.net) AS difference, count(*) AS pairs FROM a JOIN b USING (s, day)
    GROUP BY 1""",
    d="difference",
)
def e38(fx: Fixtures) -> DataFrame:
    base = daily(fx).withColumn("s", F.substring("series", 1, 1))
    a = base.filter(F.col("series").endswith("F"))
    b = base.filter(F.col("series").endswith("O"))
    return stats.paired_difference(a, b, ["s", "day"], "net")


@query(
    "e39_gate_cell_choice",
    f"""
    WITH {CELLS}, ok AS (SELECT * FROM ct WHERE trades >= 40),
    md AS (SELECT a.key, median(b.mean_net) AS s FROM ok a JOIN ok b ON a.a_flag = b.a_flag AND
      abs(a.a_line - b.a_line) <= 1 AND abs(a.a_qty - b.a_qty) <= 1 GROUP BY 1)
    SELECT key, s, mean_net, s <= 0 AS killed FROM ok JOIN md USING (key)
    ORDER BY s DESC, mean_net DESC, key LIMIT 1""",
    d="s mean_net",
)
def e39(fx: Fixtures) -> DataFrame:
    ok = cell_table(fx).filter("trades >= 40")
    near = stats.neighbourhoods(ok, "key", ["a_line", "a_qty"], ["a_flag"])
    scored = ok.join(stats.neighbourhood_median(ok, near, "key", "mean_net", "s"), "key")
    best = stats.choose_cell(scored.withColumn("a", F.col("s")), "key", 0.0)
    return best.select("key", "s", "mean_net", (F.col("s") <= 0).alias("killed"))


@query(
    "e40_rank_ic",
    f"""
    WITH m AS (SELECT symbol, us // 86400000000 AS day, spread_bp AS x, 1e4 * ln(lead(mid, 10) OVER
      ({ROW}) / mid) AS y FROM fx_decisions),
    r AS (SELECT symbol, day, rank() OVER (PARTITION BY symbol, day ORDER BY x) + (count(*) OVER
      (PARTITION BY symbol, day, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, day ORDER BY
      y) + (count(*) OVER (PARTITION BY symbol, day, y) - 1) / 2.0 AS ry FROM m WHERE y IS NOT NULL)
    SELECT symbol, day, corr(rx, ry) AS rank_ic, count(*) AS n FROM r GROUP BY 1, 2""",
    d="rank_ic",
)
def e40(fx: Fixtures) -> DataFrame:
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    day = F.floor(F.col("us") / F.lit(86_400_000_000)).cast("long").alias("day")
    rows = fx.decisions.join(moves, ["symbol", "us", "seq"]).select(
        "symbol", day, F.col("spread_bp").alias("x"), F.col("forward_bp").alias("y")
    )
    return stats.rank_ic(rows, ["symbol", "day"], "x", "y")


@query(
    "e41_breakeven_fee",
    """
    WITH s AS (SELECT series, avg(gross_bp) AS g FROM fx_li_trades GROUP BY 1),
    n AS (SELECT series, f AS fee_bp, g + 6 - 2 * f AS net FROM s, (VALUES (0.0), (1.0), (2.0), (4.0),
      (8.0)) t(f)),
    l AS (SELECT *, lead(fee_bp) OVER w AS f1, lead(net) OVER w AS v1 FROM n
      WINDOW w AS (PARTITION BY series ORDER BY fee_bp)),
    p AS (SELECT series, max(CASE WHEN net > 0 THEN fee_bp END) AS top FROM n GROUP BY 1)
    SELECT p.series, CASE WHEN top IS NULL THEN '-infinity'::DOUBLE WHEN f1 IS NULL THEN
      'infinity'::DOUBLE ELSE l.fee_bp + (f1 - l.fee_bp) * net / (net - v1) END AS breakeven_bp
    FROM p LEFT JOIN l ON l.series = p.series AND l.fee_bp = p.top""",
    d="breakeven_bp",
)
def e41(fx: Fixtures) -> DataFrame:
    means = fx.li_trades.groupBy("series").agg(F.avg("gross_bp").alias("g"))
    fees = F.explode(F.array(*[F.lit(f) for f in (0.0, 1.0, 2.0, 4.0, 8.0)])).alias("fee_bp")
    nets = means.select("series", "g", fees).select(
        "series", "fee_bp", (F.col("g") + 6 - F.col("fee_bp") * 2).alias("net_bp")
    )
    return stats.breakeven_on_grid(nets, ["series"])
