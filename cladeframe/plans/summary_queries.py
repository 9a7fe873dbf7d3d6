"""Summary queries (R rows) and inventories (I rows) over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as I
from ..operators import summaries as S
from ..registry import query

METHODS = ("click", "error", "purchase", "signup", "view")
THRESHOLDS = ("click", "view", "signup")
PROPERTIES = ("num_species", "total_wgd", "h_strict", "max_copies")
OK = "status = 'SUCCESS'"


def rounded(df):
    """Doubles to 6 digits, so that results agree between engines."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


AGGREGATED = f"SELECT network, config, method, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, count(value) AS n_valid FROM v_comparisons WHERE {OK} GROUP BY ALL"


def levels(v):
    """The config's level, from its number; config 2 has none."""
    return v.spark.sql("SELECT * FROM VALUES (0L, 'low'), (1L, 'high') AS t(config, level)")


LEVELS = "(SELECT * FROM (VALUES (0, 'low'), (1, 'high')) t(config, level))"


@query("r1_aggregate_replicates", f"SELECT network, config, method, metric, {r('mean', 'mean')}, {r('std', 'std')}, {r('min', 'min')}, {r('max', 'max')}, n_valid FROM ({AGGREGATED}) a")
def _(v):
    return rounded(S.aggregate_replicates(v.v_comparisons))


@query("r2_method_pivot", f"SELECT network, config, metric, {', '.join(f'''round(max(CASE WHEN method = '{m}' THEN mean END), 6) AS {m}_mean, round(max(CASE WHEN method = '{m}' THEN std END), 6) AS {m}_std, max(CASE WHEN method = '{m}' THEN n_valid END) AS {m}_n, max(CASE WHEN method = '{m}' THEN printf('%.6f ± %.6f (%d)', mean, std, n_valid) END) AS {m}_text''' for m in METHODS)} FROM ({AGGREGATED}) a WHERE n_valid > 0 GROUP BY network, config, metric")
def _(v):
    return rounded(S.pivot_methods(S.aggregate_replicates(v.v_comparisons), METHODS))


@query("r3_rank_methods", f"SELECT config, metric, method, {r('avg(mean)', 'mean_value')}, {r('avg(rk)', 'mean_rank')}, count(CASE WHEN rk = 1 THEN 1 END) AS times_best, count(CASE WHEN rk = k THEN 1 END) AS times_worst FROM (SELECT *, row_number() OVER (PARTITION BY config, metric, network ORDER BY mean, method) AS rk, count(*) OVER (PARTITION BY config, metric, network) AS k FROM ({AGGREGATED}) a WHERE mean IS NOT NULL) q GROUP BY config, metric, method")
def _(v):
    return rounded(S.rank_methods(S.aggregate_replicates(v.v_comparisons)))


LONG_STATS = " UNION ALL ".join(f"SELECT network, '{p}' AS property, CAST({p} AS DOUBLE) AS x FROM v_network_stats" for p in PROPERTIES)
R4 = f"SELECT config, metric, method, property, count(*) AS n, corr(x, mean) AS r FROM ({AGGREGATED}) a JOIN ({LONG_STATS}) s USING (network) WHERE mean IS NOT NULL AND x IS NOT NULL GROUP BY config, metric, method, property HAVING count(*) >= 3"


@query("r4_property_correlations", f"SELECT config, metric, method, property, n, round(r, 5) AS r FROM ({R4}) q")
def _(v):
    return S.property_correlations(S.aggregate_replicates(v.v_comparisons), v.v_network_stats, PROPERTIES).withColumn("r", F.round("r", 5))


RANK_T = f"CASE method {' '.join(f'''WHEN '{m}' THEN {i}''' for i, m in enumerate(THRESHOLDS))} END"
IN_T = f"method IN {THRESHOLDS}"


@query("r5_threshold_inventory", f"SELECT network, config, method, replicate, inferred_exists FROM v_inventory WHERE NOT {IN_T} UNION ALL SELECT network, config, 'merged', replicate, inferred_exists FROM (SELECT *, row_number() OVER (PARTITION BY network, config, replicate ORDER BY inferred_exists DESC, {RANK_T}) AS k FROM v_inventory WHERE {IN_T}) q WHERE k = 1")
def _(v):
    return S.collapse_threshold_inventory(v.v_inventory, THRESHOLDS, "merged")


@query("r6_threshold_comparisons", f"SELECT network, config, method, replicate, metric, {r('value', 'value')}, status FROM v_comparisons WHERE NOT {IN_T} UNION ALL SELECT network, config, 'merged', replicate, metric, {r('value', 'value')}, status FROM (SELECT *, {RANK_T} AS k, min(CASE WHEN {OK} THEN {RANK_T} END) OVER (PARTITION BY network, config, replicate) AS least FROM v_comparisons WHERE {IN_T}) q WHERE k = least")
def _(v):
    return rounded(S.collapse_threshold_comparisons(v.v_comparisons, THRESHOLDS, "merged"))


@query("r7_bias_percent", f"SELECT network, config, method, replicate, metric, round(CASE WHEN metric = 0 AND total_wgd > 0 THEN value / total_wgd * 100 ELSE value END, 6) AS value, status FROM v_comparisons LEFT JOIN (SELECT network, total_wgd FROM v_network_stats) s USING (network)")
def _(v):
    return rounded(S.bias_to_percent(v.v_comparisons, v.v_network_stats, 0))


DONE = "avg(CASE WHEN inferred_exists THEN 1.0 ELSE 0.0 END)"


@query("r8_completion", f"SELECT method, {', '.join(f'''round(coalesce(avg(CASE WHEN config = {c} THEN CASE WHEN inferred_exists THEN 100.0 ELSE 0.0 END END), 0), 6) AS "{c}"''' for c in range(3))} FROM v_inventory GROUP BY method")
def _(v):
    return rounded(S.completion(v.v_inventory, range(3)))


R9 = f"SELECT c.method, c.config, c.metric, mean, std, n, completion FROM (SELECT method, config, metric, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM v_comparisons WHERE {OK} GROUP BY ALL) c LEFT JOIN (SELECT method, config, {DONE} * 100 AS completion FROM v_inventory GROUP BY ALL) d ON c.method = d.method AND c.config = d.config"


@query("r9_config_summary", f"SELECT method, config, metric, {r('mean', 'mean')}, {r('std', 'std')}, n, {r('completion', 'completion')} FROM ({R9}) q")
def _(v):
    return rounded(S.config_summary(v.v_comparisons, v.v_inventory))


@query("r10_average_ranks", f"SELECT method, {r('avg(rk)', 'mean_rank')}, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY config, metric ORDER BY mean ASC NULLS LAST) + (count(*) OVER (PARTITION BY config, metric, mean) - 1) / 2.0 AS rk FROM ({R9}) q) w GROUP BY method")
def _(v):
    return rounded(S.average_ranks(S.config_summary(v.v_comparisons, v.v_inventory)))


@query("r11_error_by_complexity", f"SELECT method, metric, CASE WHEN num_species <= (SELECT quantile_cont(num_species, 0.5) FROM v_network_stats) THEN 'low' ELSE 'high' END AS level, {r('avg(value)', 'mean')}, count(value) AS n FROM v_comparisons JOIN v_network_stats USING (network) WHERE {OK} GROUP BY ALL")
def _(v):
    return rounded(S.error_by_complexity(v.v_comparisons, v.v_network_stats, "num_species"))


@query("r12_completion_by_property", f"SELECT method, max_copies, {r('avg(rate)', 'mean')}, {r('stddev_pop(rate) / sqrt(count(*))', 'se')} FROM (SELECT network, method, {DONE} AS rate FROM v_inventory GROUP BY ALL) i JOIN v_network_stats USING (network) GROUP BY method, max_copies")
def _(v):
    return rounded(S.completion_by_property(v.v_inventory, v.v_network_stats, "max_copies"))


@query("r12_error_by_property", f"SELECT method, metric, max_copies, {r('avg(e)', 'mean')}, {r('stddev_samp(e) / sqrt(count(*))', 'se')} FROM (SELECT network, method, metric, avg(value) AS e FROM v_comparisons WHERE {OK} GROUP BY ALL) i JOIN v_network_stats USING (network) GROUP BY method, metric, max_copies")
def _(v):
    return rounded(S.error_by_property(v.v_comparisons, v.v_network_stats, "max_copies"))


@query("r13_detection_scores", f"SELECT config, method, {r('tp / (tp + fp)', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM (SELECT config, method, {', '.join(f'sum(CASE WHEN metric = {i} THEN mean END) AS {x}' for i, x in enumerate(('tp', 'fp', 'fn')))} FROM ({AGGREGATED}) a GROUP BY ALL) q")
def _(v):
    return rounded(S.detection_scores(S.aggregate_replicates(v.v_comparisons), 0, 1, 2))


PER_NETWORK = f"SELECT network, method, metric, avg(value) AS mean FROM v_comparisons WHERE {OK} GROUP BY ALL"


@query("r14_correlation_matrix", f"SELECT property, metric, round(corr(x, mean), 5) AS r, count(*) AS n FROM (SELECT network, metric, avg(value) AS mean FROM v_comparisons WHERE {OK} GROUP BY ALL) a JOIN ({LONG_STATS}) s USING (network) GROUP BY property, metric")
def _(v):
    return S.correlation_matrix(v.v_comparisons, v.v_network_stats, PROPERTIES).withColumn("r", F.round("r", 5))


@query("r14_correlation_matrix_by_method", f"SELECT method, property, metric, round(corr(x, mean), 5) AS r, count(*) AS n FROM ({PER_NETWORK}) a JOIN ({LONG_STATS}) s USING (network) GROUP BY method, property, metric")
def _(v):
    return S.correlation_matrix(v.v_comparisons, v.v_network_stats, PROPERTIES, ("method",)).withColumn("r", F.round("r", 5))


@query("r15_method_performance", f"SELECT i.method, runs, completed, {r('rate', 'rate')}, {r('mean', 'mean')}, {r('median', 'median')}, {r('std', 'std')}, {r('mae', 'mae')}, {r('bias', 'bias')} FROM (SELECT method, count(*) AS runs, count(CASE WHEN inferred_exists THEN 1 END) AS completed, {DONE} AS rate FROM v_inventory GROUP BY method) i LEFT JOIN (SELECT method, avg(mean) AS mean, median(mean) AS median, stddev_samp(mean) AS std FROM ({PER_NETWORK}) p WHERE metric = 0 GROUP BY method) m ON i.method = m.method LEFT JOIN (SELECT method, avg(CASE WHEN metric = 1 THEN abs(value) END) AS mae, avg(CASE WHEN metric = 1 THEN value END) AS bias FROM v_comparisons WHERE {OK} GROUP BY method) b ON i.method = b.method")
def _(v):
    return rounded(S.method_performance(v.v_comparisons, v.v_inventory, 0, 1))


@query("r16_network_table", f"SELECT d.network, {', '.join(f'{m}_completion' for m in METHODS)}, {', '.join(f'{m}_error' for m in METHODS)} FROM (SELECT network, {', '.join(f'''round(avg(CASE WHEN method = '{m}' THEN CASE WHEN inferred_exists THEN 1.0 ELSE 0.0 END END), 6) AS {m}_completion''' for m in METHODS)} FROM v_inventory GROUP BY network) d LEFT JOIN (SELECT network, {', '.join(f'''round(max(CASE WHEN method = '{m}' THEN e END), 6) AS {m}_error''' for m in METHODS)} FROM (SELECT network, method, coalesce(avg(CASE WHEN metric = 3 THEN value END), avg(CASE WHEN metric = 2 THEN value END)) AS e FROM v_comparisons WHERE {OK} GROUP BY ALL) q GROUP BY network) e ON d.network = e.network")
def _(v):
    return rounded(S.network_table(v.v_comparisons, v.v_inventory, METHODS, (3, 2)))


MASTER = f"SELECT c.*, s.num_species, s.total_wgd, s.h_strict, s.max_copies, coalesce(level, 'Unknown') AS level, {OK} AS success FROM v_comparisons c LEFT JOIN v_network_stats s ON c.network = s.network LEFT JOIN {LEVELS} l ON c.config = l.config"


@query("r17_master_frame", f"SELECT * REPLACE ({r('value', 'value')}) FROM ({MASTER}) m")
def _(v):
    return rounded(S.master_frame(v.v_comparisons, v.v_network_stats, levels(v)))


@query("r17_master_summary", f"SELECT method, level, metric, count(*) AS runs, count(CASE WHEN success THEN 1 END) AS completed, {r('avg(value)', 'mean')}, {r('avg(num_species)', 'mean_species')} FROM ({MASTER}) m GROUP BY method, level, metric")
def _(v):
    return rounded(S.master_summary(S.master_frame(v.v_comparisons, v.v_network_stats, levels(v))))


@query("r18_two_stage_mean", f"SELECT config, method, metric, {r('avg(m)', 'mean')}, {r('stddev_samp(m) / sqrt(count(m))', 'sem')}, count(m) AS n FROM (SELECT config, method, metric, network, avg(value) AS m FROM v_comparisons WHERE {OK} GROUP BY ALL) p GROUP BY config, method, metric")
def _(v):
    return rounded(S.two_stage_mean(v.v_comparisons))


@query("r19_paired_test", f"SELECT metric, count(*) AS n, {r('avg(a)', 'mean_a')}, {r('avg(b)', 'mean_b')}, {r('avg(a - b)', 'delta')}, count(CASE WHEN a < b THEN 1 END) AS better, count(CASE WHEN a > b THEN 1 END) AS worse, count(CASE WHEN a = b THEN 1 END) AS tie FROM (SELECT x.metric, x.mean AS a, y.mean AS b FROM ({PER_NETWORK}) x JOIN ({PER_NETWORK}) y ON x.network = y.network AND x.metric = y.metric WHERE x.method = 'click' AND y.method = 'view') q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY metric")
def _(v):
    return rounded(S.paired_test(v.v_comparisons, "click", "view"))


@query("r20_like_for_like", f"WITH held AS (SELECT DISTINCT network, config, replicate FROM v_comparisons WHERE {OK} AND method = 'view') SELECT method, metric, {r('avg(value)', 'mean')}, count(DISTINCT (c.network, c.config, c.replicate)) AS runs, round(count(DISTINCT (c.network, c.config, c.replicate)) * 100.0 / (SELECT count(*) FROM held), 6) AS coverage FROM v_comparisons c JOIN held h ON c.network = h.network AND c.config = h.config AND c.replicate = h.replicate WHERE {OK} GROUP BY method, metric")
def _(v):
    return rounded(S.like_for_like(v.v_comparisons, "view"))


R21 = f"SELECT network, method, metric, avg(value) AS value FROM (SELECT network, 'own' AS method, '0' AS metric, CAST(num_species AS DOUBLE) AS value FROM v_network_stats UNION ALL SELECT network, 'own', '1', CAST(h_strict AS DOUBLE) FROM v_network_stats UNION ALL SELECT network, method, CAST(metric AS VARCHAR), value FROM v_comparisons WHERE {OK} AND metric IN (0, 1)) u WHERE value IS NOT NULL GROUP BY ALL"


def head_to_head(v):
    wide = v.v_network_stats.select("network", F.col("num_species").cast("double").alias("num_species"), F.col("h_strict").cast("double").alias("h_strict"))
    return S.head_to_head(wide, {"num_species": "0", "h_strict": "1"}, "own", v.v_comparisons)


@query("r21_head_to_head", f"SELECT network, {', '.join(f'''round(max(CASE WHEN method = '{m}' AND metric = '{k}' THEN value END), 6) AS {m}_{k}''' for m in ('own', *METHODS) for k in '01')} FROM ({R21}) q GROUP BY network")
def _(v):
    long = head_to_head(v).withColumn("name", F.concat_ws("_", "method", "metric"))
    return rounded(long.groupBy("network").pivot("name", [f"{m}_{k}" for m in ("own", *METHODS) for k in "01"]).agg(F.first("value")))


@query("r22_common_subset", f"SELECT count(a) AS n_a, count(b) AS n_b, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS n_both, {r('avg(CASE WHEN b IS NOT NULL THEN a END)', 'mean_a')}, {r('avg(CASE WHEN a IS NOT NULL THEN b END)', 'mean_b')}, {r('avg(CASE WHEN b IS NULL THEN a END)', 'mean_a_where_b_failed')}, {r('avg(CASE WHEN b IS NOT NULL THEN a END)', 'mean_a_where_b_completed')} FROM (SELECT network, config, replicate, max(CASE WHEN method = 'click' THEN value END) AS a, max(CASE WHEN method = 'error' THEN value END) AS b FROM v_comparisons WHERE metric = 0 GROUP BY network, config, replicate) w")
def _(v):
    wide = v.v_comparisons.filter("metric = 0").groupBy("network", "config", "replicate").pivot("method", ["click", "error"]).agg(F.max("value"))
    return rounded(S.common_subset(wide, "click", "error"))


@query("r23_average_replicates", "SELECT user_id % 25 AS sample, round(avg(value), 6) AS value, round(avg(event_id), 6) AS event_id FROM events GROUP BY 1")
def _(v):
    return rounded(S.average_numeric(v.events.withColumn("sample", F.col("user_id") % 25), "sample", ["value", "event_id"]))


@query("r24_method_availability", "SELECT method, count(*) AS available, count(CASE WHEN num_species >= 4 THEN 1 END) AS comparable, round(count(CASE WHEN num_species >= 4 THEN 1 END) / nullif((SELECT count(*) FROM v_network_stats WHERE num_species >= 4), 0), 6) AS share FROM (SELECT DISTINCT method, network FROM v_inventory WHERE inferred_exists) i LEFT JOIN v_network_stats USING (network) GROUP BY method")
def _(v):
    return rounded(S.method_availability(v.v_inventory, v.v_network_stats.filter("num_species >= 4").select("network")))


PAIRS = f"SELECT x.network, x.metric, x.method AS method1, y.method AS method2, abs(x.mean - y.mean) AS value FROM ({PER_NETWORK}) x JOIN ({PER_NETWORK}) y ON x.network = y.network AND x.metric = y.metric AND x.method < y.method WHERE x.mean IS NOT NULL AND y.mean IS NOT NULL"


@query("c7_method_pairs", f"SELECT network, metric, method1, method2, {r('value', 'value')} FROM ({PAIRS}) p")
def _(v):
    return rounded(S.method_pairs(v.v_comparisons))


@query("r25_pair_summary", f"SELECT method1, method2, metric, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, count(*) AS n FROM ({PAIRS}) p GROUP BY method1, method2, metric")
def _(v):
    return rounded(S.pair_summary(S.method_pairs(v.v_comparisons)))


@query("r26_disagreement_ranks", f"SELECT metric, method, {r('m', 'mean_distance')}, rank() OVER (PARTITION BY metric ORDER BY m) AS rank FROM (SELECT metric, method, avg(value) AS m FROM (SELECT metric, method1 AS method, value FROM ({PAIRS}) p UNION ALL SELECT metric, method2, value FROM ({PAIRS}) p) s GROUP BY metric, method) q")
def _(v):
    return rounded(S.disagreement_ranks(S.method_pairs(v.v_comparisons)))


@query("r27_distance_matrix", f"SELECT method, {', '.join(f'''round(avg(CASE WHEN other = '{m}' THEN value END), 6) AS {m}''' for m in METHODS)} FROM (SELECT method1 AS method, method2 AS other, value FROM ({PAIRS}) p WHERE metric = 0 UNION ALL SELECT method2, method1, value FROM ({PAIRS}) p WHERE metric = 0 UNION ALL SELECT m, m, 0.0 FROM (VALUES {', '.join(f'''('{m}')''' for m in METHODS)}) d(m)) s GROUP BY method")
def _(v):
    return rounded(S.distance_matrix(S.method_pairs(v.v_comparisons), 0, METHODS))


@query("r28_network_disagreement", f"SELECT network, metric, {r('m', 'mean')}, row_number() OVER (PARTITION BY metric ORDER BY m DESC, network) AS rank FROM (SELECT network, metric, avg(value) AS m FROM ({PAIRS}) p GROUP BY GROUPING SETS ((network), (network, metric))) q")
def _(v):
    return rounded(S.network_disagreement(S.method_pairs(v.v_comparisons)))


@query("r29_counts_by_method", f"SELECT network, {', '.join(f'''count(CASE WHEN method = '{m}' THEN 1 END) AS {m}''' for m in METHODS)} FROM v_comparisons WHERE {OK} GROUP BY network")
def _(v):
    return v.v_comparisons.filter(S.SUCCESS).groupBy("network").pivot("method", list(METHODS)).count().na.fill(0)


@query("r30_best_methods", f"SELECT config, metric, method, {r('mean', 'mean')} FROM (SELECT *, row_number() OVER (PARTITION BY config, metric ORDER BY mean, method) AS k FROM (SELECT config, metric, method, avg(value) AS mean FROM v_comparisons WHERE {OK} GROUP BY ALL) a WHERE mean IS NOT NULL) q WHERE k = 1")
def _(v):
    return rounded(S.best_methods(v.v_comparisons))


NETWORK_MEAN = f"SELECT network, avg(value) AS mean FROM v_comparisons WHERE {OK} GROUP BY network"


@query("r30_easiest_hardest", f"(SELECT network, {r('mean', 'mean')}, 'easiest' AS kind FROM ({NETWORK_MEAN}) a ORDER BY a.mean, network LIMIT 5) UNION ALL (SELECT network, {r('mean', 'mean')}, 'hardest' FROM ({NETWORK_MEAN}) a ORDER BY a.mean DESC, network LIMIT 5)")
def _(v):
    return rounded(S.extremes(v.v_comparisons))


@query("r31_degradation", f"SELECT method, metric, coalesce(level, 'Unknown') AS level, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('stddev_samp(value) / sqrt(count(value))', 'sem')} FROM v_comparisons LEFT JOIN {LEVELS} l USING (config) WHERE {OK} GROUP BY ALL")
def _(v):
    return rounded(S.degradation(v.v_comparisons, levels(v)))


@query("r32_subset_study", f"SELECT method, metric, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('stddev_samp(value)', 'std')}, count(value) AS n FROM v_comparisons WHERE {OK} AND method IN ('click', 'view') AND network IN (SELECT network FROM v_network_stats WHERE max_copies = 2) GROUP BY method, metric")
def _(v):
    return rounded(S.subset_study(v.v_comparisons, v.v_network_stats.filter("max_copies = 2").select("network"), ("click", "view")))


@query("r38_describe_scores", f"SELECT metric, {r('avg(x)', 'mean')}, {r('quantile_cont(x, 0.5)', 'median')}, {r('min(x)', 'min')}, {r('max(x)', 'max')} FROM (SELECT 'value' AS metric, value AS x FROM events UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events) q GROUP BY metric")
def _(v):
    return rounded(S.describe_scores(v.events, ["value", "user_id"]))


@query("i1_inventory", "SELECT network, config, method, replicate, inferred_exists FROM v_inventory")
def _(v):
    return I.full_inventory(v.nation.select(F.col("n_nationkey").alias("network")), v.v_comparisons.select("network", "config", "method", "replicate"))


@query("i2_completion_report", "SELECT method, network, count(*) AS expected, count(CASE WHEN inferred_exists THEN 1 END) AS available, count(CASE WHEN NOT inferred_exists THEN 1 END) AS missing, round(avg(CASE WHEN inferred_exists THEN 100.0 ELSE 0.0 END), 6) AS rate FROM v_inventory GROUP BY GROUPING SETS ((), (method), (network))")
def _(v):
    return rounded(I.completion_report(v.v_inventory))


@query("i3_unit_status", "SELECT user_id AS unit, count(*) AS found, CASE WHEN count(*) >= 100 THEN 'SUCCESS' WHEN count(CASE WHEN event_type <> 'error' THEN 1 END) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM events GROUP BY user_id")
def _(v):
    return I.unit_status(v.events.select(F.col("user_id").alias("unit"), (F.col("event_type") != "error").alias("good")), 100)


@query("i4_first_errors", "SELECT user_id AS task, k, substr(props, 1, 200) AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'error') q WHERE k <= 5")
def _(v):
    lines = v.events.select(F.col("user_id").alias("task"), F.col("event_id").alias("at"), F.concat_ws(" ", F.upper("event_type"), "props").alias("line"))
    return I.first_errors(lines).withColumn("line", F.regexp_replace("line", "^ERROR ", "")).select("task", "k", "line")


@query("i5_flagged_runs", "SELECT user_id AS run, p.pattern, count(*) AS hits FROM events JOIN (VALUES ('\"k\": 1'), ('\"k\": 99')) p(pattern) ON contains(props, p.pattern) GROUP BY ALL")
def _(v):
    return I.flagged_runs(v.events.select(F.col("user_id").alias("run"), F.col("props").alias("line")), ('"k": 1', '"k": 99'))


I6 = "SELECT user_id AS task, event_type AS method, value AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) q WHERE k = 1"


@query("i6_runtime_summary", f"SELECT method, count(*) AS n, {r('avg(seconds)', 'mean')}, {r('median(seconds)', 'median')}, {r('stddev_samp(seconds)', 'std')}, {r('min(seconds)', 'min')}, {r('max(seconds)', 'max')} FROM ({I6}) q GROUP BY method")
def _(v):
    return rounded(I.runtime_summary(v.events.select(F.col("user_id").alias("task"), F.col("event_type").alias("method"), F.col("event_id").alias("job"), F.col("value").alias("seconds"))))
