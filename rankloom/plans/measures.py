"""Queries on lengths, latencies and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import judge, order_stats as o

from .base import LATENCY, LONG_VERDICTS, VERDICTS, Tables, query, simpson

CAPS = [512, 1024, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 32768]


@query("""WITH x AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, any_value(n) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS stdev, min(n_chars) AS min, max(CASE WHEN r = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1 THEN n_chars END) AS p50,
 max(CASE WHEN r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1 THEN n_chars END) AS p95, max(CASE WHEN r = CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1 THEN n_chars END) AS p99, max(n_chars) AS max FROM x GROUP BY lang""")
def token_distribution(t: Tables):
    d = t("documents").select("lang", "n_chars")
    basic = d.groupBy("lang").agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("stdev"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"))
    return basic.join(o.pick(d, ["lang"], "n_chars", {f"p{p}": o.half_even(p / 100) for p in (50, 95, 99)}).drop("n"), "lang")


@query("""WITH x AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS r, count(*) OVER () AS n FROM documents)
SELECT any_value(n) AS n, min(n_chars) AS min, """ + ", ".join(f"max(CASE WHEN r = least(n, greatest(1, CAST(floor({p / 100.0} * n + 0.999999) AS BIGINT))) THEN n_chars END) AS {name}" for name, p in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99), ("p999", 99.9))) + ", max(n_chars) AS max, round(avg(n_chars), 6) AS mean FROM x")  # fmt: skip
def length_profile(t: Tables):
    d = t("documents").select("n_chars")
    basic = d.agg(F.count("n_chars").alias("n"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return basic.crossJoin(F.broadcast(o.pick(d, [], "n_chars", {name: o.nearest_rank(p) for name, p in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99), ("p999", 99.9))}).drop("n")))


@query("SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS max FROM documents GROUP BY source")
def length_stats(t: Tables):
    d = t("documents").select("source", "n_chars")
    basic = d.groupBy("source").agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("max"))
    found = o.quantiles(d, ["source"], "n_chars", {"p50": 0.5, "p95": 0.95})
    return basic.join(found.select("source", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")), "source")


DROPS = f"c AS (SELECT unnest({CAPS}) AS cap), d AS (SELECT cap::BIGINT AS cap, count(*) FILTER (n_chars > cap) AS dropped, count(*) AS n FROM c, documents GROUP BY cap)"


def drops(t: Tables):
    """One pass over the lengths; the caps are ten columns, not ten copies of the rows."""
    counts = t("documents").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("n_chars") > c, 1)).alias(f"d{c}") for c in CAPS])
    return counts.select("n", F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("cap"), F.col(f"d{c}").alias("dropped")) for c in CAPS])))


@query(f"WITH {DROPS} SELECT cap, dropped, round(dropped / n, 6) AS fraction, n - dropped AS kept FROM d")
def drop_table(t: Tables):
    return drops(t).select("cap", "dropped", F.round(F.col("dropped") / F.col("n"), 6).alias("fraction"), (F.col("n") - F.col("dropped")).alias("kept"))


@query(f"WITH {DROPS} SELECT coalesce(min(CASE WHEN dropped = 0 THEN cap END), min(CASE WHEN dropped <= 0.003 * n THEN cap END)) AS cap FROM d")
def recommended_cap(t: Tables):
    return drops(t).agg(F.coalesce(F.min(F.when(F.col("dropped") == 0, F.col("cap"))), F.min(F.when(F.col("dropped") <= 0.003 * F.col("n"), F.col("cap")))).alias("cap"))


@query(f"""WITH {LATENCY}, x AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY backend) AS n FROM ok)
SELECT backend, any_value(n) AS n, round(avg(latency_ms), 6) AS mean, round(stddev_pop(latency_ms), 6) AS std, """ + ", ".join(f"max(CASE WHEN r = CAST(round_even({p} * (n - 1), 0) AS BIGINT) + 1 THEN latency_ms END) AS {name}" for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM x GROUP BY backend")  # fmt: skip
def latency_summary(t: Tables):
    ok = t.latencies().filter("success")
    basic = ok.groupBy("backend").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean"), F.round(F.stddev_pop("latency_ms"), 6).alias("std"))
    return basic.join(o.pick(ok, ["backend"], "latency_ms", {f"p{p}": o.half_even(p / 100) for p in (50, 95, 99)}).drop("n"), "backend")


@query(f"""WITH {LATENCY}, x AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY per_token) AS r, count(*) OVER (PARTITION BY backend) AS n FROM ok),
m AS (SELECT backend, max(CASE WHEN r = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1 THEN round(per_token, 6) END) AS p50 FROM x GROUP BY backend)
SELECT backend, count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_failed, round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate, round(avg(CASE WHEN success THEN latency_ms / greatest(1, tokens) END), 6) AS ms_per_tok, any_value(p50) AS ms_per_tok_p50 FROM lat JOIN m USING (backend) GROUP BY backend""")
def latency_aggregate(t: Tables):
    rows = t.latencies()
    failed = F.count(F.when(~F.col("success"), 1))
    basic = rows.groupBy("backend").agg(F.count(F.when(F.col("success"), 1)).alias("n_ok"), failed.alias("n_failed"), F.round(failed / F.count("*"), 6).alias("failure_rate"), F.round(F.avg(F.when(F.col("success"), F.col("per_token"))), 6).alias("ms_per_tok"))
    middle = o.pick(rows.filter("success"), ["backend"], "per_token", {"ms_per_tok_p50": o.half_even(0.5)}).drop("n")
    return basic.join(middle.withColumn("ms_per_tok_p50", F.round("ms_per_tok_p50", 6)), "backend")


@query(f"""WITH {LATENCY}, x AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY backend) AS n FROM ok), p AS (SELECT backend, max(CASE WHEN r = n // 2 + 1 THEN latency_ms END) AS p50,
max(CASE WHEN r = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1) THEN latency_ms END) AS p95, max(CASE WHEN r = least(n, CAST(floor(0.99 * n) AS BIGINT) + 1) THEN latency_ms END) AS p99 FROM x GROUP BY backend)
SELECT backend, p50, p95, p99, count(*) FILTER (NOT success) AS failures, CASE WHEN count(*) FILTER (NOT success) = 0 AND p99 <= 60000 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM lat JOIN p USING (backend) GROUP BY backend, p50, p95, p99""")
def stress_report(t: Tables):
    rows = t.latencies()
    failures = rows.groupBy("backend").agg(F.count(F.when(~F.col("success"), 1)).alias("failures"))
    p = o.pick(rows.filter("success"), ["backend"], "latency_ms", {f"p{k}": o.floored(k / 100) for k in (50, 95, 99)}).drop("n")
    return p.join(failures, "backend").withColumn("verdict", F.when((F.col("failures") == 0) & (F.col("p99") <= 60000), "PASS").otherwise("FAIL"))


@query(f"WITH {LATENCY}, l AS (SELECT backend, round(avg(per_token), 6) AS ms_per_tok FROM ok GROUP BY 1) SELECT DISTINCT o_orderpriority AS tag, ms_per_tok FROM orders LEFT JOIN l ON backend = CASE o_orderpriority WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'view' END")
def latency_join(t: Tables):
    speed = t.latencies().filter("success").groupBy("backend").agg(F.round(F.avg("per_token"), 6).alias("ms_per_tok"))
    runs = t("orders").select(F.col("o_orderpriority").alias("tag")).distinct().withColumn("backend", F.when(F.col("tag") == "1-URGENT", "click").when(F.col("tag") == "2-HIGH", "view"))
    return runs.join(speed, "backend", "left").select("tag", "ms_per_tok")


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN json_valid(props) THEN 1.0 ELSE 0 END), 6) AS parse_rate, avg(CASE WHEN json_valid(props) THEN 1.0 ELSE 0 END) < 0.8 AS stop FROM (SELECT event_type, CASE WHEN event_id % 4 = 0 THEN props || '}' ELSE props END AS props FROM events) GROUP BY 1")
def parse_rate(t: Tables):
    from rankloom.functions.parsing import is_json

    raw = t("events").select("event_type", F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("raw"))
    rate = F.avg(is_json("raw").cast("double"))
    return raw.groupBy("event_type").agg(F.count("*").alias("n"), F.round(rate, 6).alias("parse_rate"), (rate < 0.8).alias("stop"))


# --- verdicts --------------------------------------------------------------------


def tagged_verdicts(t: Tables):
    """Verdicts of models, one of them without a tag, one with an older rubric that lacks the third axis."""
    old = F.col("arm") == "p3"
    return t.verdicts().withColumn("model_tag", F.when(F.col("arm") != "p2", F.col("arm"))).withColumn("ranking_coherence", F.when(~old, F.col("ranking_coherence")))


TAGGED = VERDICTS + """, tagged AS (SELECT sample_id, CASE WHEN arm = 'p2' THEN 'unknown' ELSE arm END AS model_tag, error, groundedness, personalization, CASE WHEN arm <> 'p3' THEN ranking_coherence END AS ranking_coherence FROM verdicts),
counted AS (SELECT model_tag, count(*) AS n_total, count(*) FILTER (error IS NULL) AS n_scored, count(error) AS n_errors FROM tagged GROUP BY 1)"""


@query(f"WITH {TAGGED} " + " UNION ALL ".join(f"SELECT model_tag, n_total, n_scored, n_errors, '{a}' AS axis, count({a}) AS n, round(avg({a}), 6) AS mean, count({a}) > 0 AS has_interval FROM counted LEFT JOIN (SELECT model_tag, {a} FROM tagged WHERE error IS NULL) x USING (model_tag) GROUP BY ALL" for a in judge.AXES))
def verdict_aggregate(t: Tables):
    """The intervals are resampled, which SQL can't follow: whether they hold the mean stands for them."""
    found = judge.per_model(tagged_verdicts(t))
    mean = F.when(~F.isnan("mean"), F.round("mean", 6))
    return found.select("model_tag", "n_total", "n_scored", "n_errors", "axis", "n", mean.alias("mean"), ((F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high")) & ~F.isnan("low")).alias("has_interval"))


@query()
def verdict_intervals(t: Tables):
    return judge.per_model(tagged_verdicts(t))


def all_deltas(t: Tables):
    return judge.deltas(judge.pairs(t.verdicts(), "sample_id", "arm", "base", ["p1", "p2", "p3"], ["event_id"]), ["sample_id"])


@query(f"WITH {LONG_VERDICTS} SELECT sample_id, probe, axis, delta FROM deltas")
def paired_deltas(t: Tables):
    return all_deltas(t).withColumnRenamed("value", "delta")


@query("""WITH v AS (SELECT event_id, event_id // 12 AS sample_id, ['base', 'p1'][1 + event_id % 2] AS arm, 1 + (event_id * 37 + user_id) % 10 AS groundedness, CASE WHEN user_id % 5 <> 0 THEN 1 + (event_id * 53 + user_id * 3) % 10 END AS personalization,
  1 + (event_id * 71 + user_id * 7) % 10 AS ranking_coherence FROM events WHERE event_type <> 'error'),
k AS (SELECT sample_id, arm, arg_max(struct_pack(g := groundedness, p := personalization, r := ranking_coherence), event_id) AS s FROM v GROUP BY ALL),
w AS (SELECT x.sample_id, x.s AS old, y.s AS new FROM k x JOIN k y ON y.sample_id = x.sample_id WHERE x.arm = 'base' AND y.arm = 'p1')
SELECT sample_id, 'groundedness' AS axis, CAST(new.g - old.g AS DOUBLE) AS delta FROM w UNION ALL SELECT sample_id, 'personalization', CAST(new.p - old.p AS DOUBLE) FROM w WHERE new.p IS NOT NULL AND old.p IS NOT NULL UNION ALL SELECT sample_id, 'ranking_coherence', CAST(new.r - old.r AS DOUBLE) FROM w""")
def paired_deltas_last_wins(t: Tables):
    """A log with several verdicts of a sample and arm, and axes that some verdicts lack."""
    log = t.verdicts().select(F.floor(F.col("event_id") / 12).alias("sample_id"), "event_id", F.when(F.col("event_id") % 2 == 0, "base").otherwise("p1").alias("arm"), "error", "groundedness", F.when(F.col("user_id") % 5 != 0, F.col("personalization")).alias("personalization"), "ranking_coherence")
    return judge.deltas(judge.pairs(log, "sample_id", "arm", "base", ["p1"], ["event_id"]), ["sample_id"]).select("sample_id", "axis", F.col("value").alias("delta"))


WILCOXON = LONG_VERDICTS + """, nz AS (SELECT *, abs(delta) AS size FROM deltas WHERE delta <> 0), rk AS (SELECT *, rank() OVER (PARTITION BY probe, axis ORDER BY size) + (count(*) OVER (PARTITION BY probe, axis, size) - 1) / 2.0 AS r FROM nz),
tot AS (SELECT probe, axis, count(*) AS n_total FROM deltas GROUP BY ALL)"""


@query(f"WITH {WILCOXON} SELECT probe, axis, any_value(n_total) AS n_total, count(r) AS n_effective, coalesce(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), 0)::DOUBLE AS statistic FROM tot LEFT JOIN rk USING (probe, axis) GROUP BY probe, axis")
def wilcoxon_statistic(t: Tables):
    return judge.wilcoxon(all_deltas(t), ["probe", "axis"]).select("probe", "axis", "n_total", "n_effective", "statistic")


NORMAL = simpson("exp(-t * t / 2) / sqrt(2 * pi())", "least(abs(z), 30)")


@query(f"""WITH {WILCOXON}, ties AS (SELECT probe, axis, sum(m * m * m - m) AS c FROM (SELECT probe, axis, size, count(*)::DOUBLE AS m FROM nz GROUP BY ALL) GROUP BY ALL), s AS (SELECT probe, axis, count(*)::DOUBLE AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w FROM rk GROUP BY ALL),
z AS (SELECT probe, axis, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - c / 48) AS z FROM s JOIN ties USING (probe, axis))
SELECT probe, axis, n_total, n::BIGINT AS n_effective, w AS statistic, round(z, 6) AS z, round(0.5 + sign(z) * {NORMAL}, 6) AS p_value FROM z JOIN tot USING (probe, axis)""")
def wilcoxon_p(t: Tables):
    w = judge.wilcoxon(all_deltas(t), ["probe", "axis"])
    return w.select("probe", "axis", "n_total", "n_effective", "statistic", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"))


# how many sets of signs give each sum of ranks, rank by rank
SIGNED = f"""law(n, s, c) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT n + 1, s, sum(c) FROM (SELECT n, s, c FROM law UNION ALL SELECT n, s + n + 1, c FROM law) WHERE n < {judge.EXACT} GROUP BY n, s)"""


@query(f"""WITH RECURSIVE {SIGNED}, d AS (SELECT o_custkey AS user_id, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS delta FROM orders),
nz AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY abs(delta)) AS r, count(*) OVER (PARTITION BY user_id, abs(delta)) AS m FROM d WHERE delta IS NOT NULL),
w AS (SELECT user_id, count(*) AS n_effective, sum(CASE WHEN delta > 0 THEN r ELSE 0 END)::DOUBLE AS statistic FROM nz GROUP BY 1 HAVING max(m) = 1 AND min(abs(delta)) > 0 AND count(*) BETWEEN 2 AND {judge.EXACT})
SELECT user_id, n_effective, statistic, round((SELECT sum(c) FROM law WHERE n = n_effective AND s <= statistic) / pow(2, n_effective), 9) AS p_value FROM w""")
def wilcoxon_exact(t: Tables):
    """Whether what a user spends falls from order to order: few differences, none equal, the law counted out."""
    last = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    d = t("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_totalprice") - last).cast("double").alias("value")).filter("value IS NOT NULL")
    untied = d.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.abs("value")).alias("m"), F.min(F.abs("value")).alias("least")).filter(f"n = m AND least > 0 AND n BETWEEN 2 AND {judge.EXACT}")
    w = judge.wilcoxon(d.join(untied.select("user_id"), "user_id", "left_semi"), ["user_id"])
    return w.select("user_id", "n_effective", "statistic", F.round("p_value", 9).alias("p_value"))


@query(f"WITH {LONG_VERDICTS} SELECT probe, axis, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0 END), 6) AS rate FROM deltas GROUP BY ALL")
def discrimination_rate(t: Tables):
    return all_deltas(t).groupBy("probe", "axis").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_delta"), F.round(judge.discrimination(F.col("value")), 6).alias("rate"))


EXPECTED = ", ".join(f"('{p}', '{a}', {d})" for p, a, d in judge.EXPECTED_DROP)
# normal intervals here, so that SQL can follow; validation_summary has the bootstrap's
STATS = LONG_VERDICTS + f""", st AS (SELECT probe, axis, avg(delta) AS mean, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)) AS low, avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)) AS high FROM deltas GROUP BY ALL),
ex AS (SELECT * FROM (VALUES {EXPECTED}) v(probe, axis, expected))"""


def expected(t: Tables):
    rows = F.array(*[F.struct(F.lit(p).alias("probe"), F.lit(a).alias("axis"), F.lit(d).alias("expected")) for p, a, d in judge.EXPECTED_DROP])
    return F.broadcast(t.spark.range(1).select(F.inline(rows)))


@query(f"WITH {STATS} SELECT probe, axis, CASE WHEN mean IS NULL OR low IS NULL THEN 'insufficient' WHEN expected < 0 THEN (CASE WHEN low > 0 THEN 'inverted' WHEN high >= 0 THEN 'null' WHEN mean <= expected THEN 'pass' ELSE 'weak' END) WHEN high < 0 THEN 'unexpected-drop' ELSE 'consistent' END AS label FROM st JOIN ex USING (probe, axis)")
def probe_verdict(t: Tables):
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))
    s = all_deltas(t).groupBy("probe", "axis").agg(F.avg("value").alias("mean"), (F.avg("value") - half).alias("low"), (F.avg("value") + half).alias("high"))
    return s.join(expected(t), ["probe", "axis"]).select("probe", "axis", judge.probe_label(F.col("mean"), F.col("low"), F.col("high"), F.col("expected")).alias("label"))


@query(f"WITH {VERDICTS} SELECT arm, count(*) AS n, round(corr(CAST(user_id % 2 AS DOUBLE), groundedness), 6) AS r FROM verdicts WHERE error IS NULL GROUP BY arm")
def point_biserial(t: Tables):
    v = t.verdicts().filter("error IS NULL")
    return v.groupBy("arm").agg(F.count("*").alias("n"), F.round(judge.correlation((F.col("user_id") % 2).cast("double"), F.col("groundedness").cast("double")), 6).alias("r"))


# the density of a correlation of n unrelated pairs
UNRELATED = simpson("pow(1 - t * t, (n - 4) / 2.0) * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi())", "abs(r)")


@query(f"WITH {VERDICTS}, c AS (SELECT arm, count(*) AS n, corr(CAST(user_id % 2 AS DOUBLE), groundedness) AS r FROM verdicts WHERE error IS NULL GROUP BY arm) SELECT arm, n, round(r, 6) AS r, round(1 - 2 * {UNRELATED}, 6) AS p FROM c")
def point_biserial_p(t: Tables):
    v = t.verdicts().filter("error IS NULL")
    r = v.groupBy("arm").agg(F.count("*").alias("n"), judge.correlation((F.col("user_id") % 2).cast("double"), F.col("groundedness").cast("double")).alias("r"))
    return judge.with_correlation_p(r).withColumns({"r": F.round("r", 6), "p": F.round("p", 6)})


@query(f"WITH {VERDICTS}, r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY groundedness) + (count(*) OVER (PARTITION BY arm, groundedness) - 1) / 2.0 AS x, rank() OVER (PARTITION BY arm ORDER BY value) + (count(*) OVER (PARTITION BY arm, value) - 1) / 2.0 AS y FROM verdicts WHERE error IS NULL) SELECT arm, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY arm")
def spearman(t: Tables):
    r = judge.rank_correlation(t.verdicts().filter("error IS NULL"), ["arm"], {"rho": ("groundedness", "value")})
    return r.select("arm", F.col("rho_n").alias("n"), F.round("rho", 6).alias("rho"))


# an inference cache: lines are outputs, orders samples, return flags backends; some outputs have no ranking, some samples no positive
OUTPUTS = """outputs AS (SELECT l_orderkey AS sample_id, ['base', 'p1', 'p2', 'p3'][1 + l_linenumber % 4] AS model_tag, l_linenumber, CASE WHEN l_suppkey % 4 <> 0 THEN 'i' || (l_partkey % 12) END AS positive, l_suppkey % 6 <> 0 AS ranked, 5 + l_partkey % 7 AS chars, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey END AS tokens FROM lineitem WHERE l_linenumber <= 4),
paired AS (SELECT v.sample_id, o.model_tag, groundedness, personalization, CASE WHEN v.arm <> 'p3' THEN ranking_coherence END AS ranking_coherence, CASE WHEN r <= 10 THEN r - 1 ELSE -1 END AS rank_of_pos, CAST(r <= 1 AS BIGINT) AS hit_at_1, CAST(r <= 5 AS BIGINT) AS hit_at_5, CAST(r <= 10 AS BIGINT) AS hit_at_10, CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END::DOUBLE AS mrr, chars AS output_chars, tokens AS output_tokens
  FROM verdicts v JOIN (SELECT *, CAST(positive[2:] AS BIGINT) + 1 AS r FROM outputs) o ON o.sample_id = v.sample_id AND o.model_tag = v.arm WHERE error IS NULL AND positive IS NOT NULL AND ranked)"""


def outputs(t: Tables):
    """sample_id, backend, positive, ids i0..i9 in order, text and tokens."""
    ids = F.when(F.col("l_suppkey") % 6 != 0, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("i"), i.cast("string"))))
    arm = F.element_at(F.array(*map(F.lit, ["base", "p1", "p2", "p3"])), (1 + F.col("l_linenumber") % 4).cast("int"))
    return t("lineitem").filter("l_linenumber <= 4").select(F.col("l_orderkey").alias("sample_id"), arm.alias("backend"), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("i"), (F.col("l_partkey") % 12).cast("string"))).alias("positive_business_id"), ids.alias("recovered_business_ids"), F.repeat(F.lit("x"), (5 + F.col("l_partkey") % 7).cast("int")).alias("output_text"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_suppkey")).alias("output_tokens"))


def judged_outputs(t: Tables):
    v = t.verdicts().withColumn("ranking_coherence", F.when(F.col("arm") != "p3", F.col("ranking_coherence"))).withColumnRenamed("arm", "model_tag")
    return judge.with_retrieval(v, outputs(t))


@query(f"WITH {VERDICTS}, {OUTPUTS} SELECT sample_id, model_tag, groundedness, personalization, ranking_coherence, rank_of_pos, hit_at_1, hit_at_5, hit_at_10, round(mrr, 9) AS mrr, output_chars, output_tokens FROM paired")
def judge_retrieval_join(t: Tables):
    return judged_outputs(t).select("sample_id", "model_tag", "groundedness", "personalization", "ranking_coherence", "rank_of_pos", "hit_at_1", "hit_at_5", "hit_at_10", F.round("mrr", 9).alias("mrr"), "output_chars", "output_tokens")


NEAR = "true AS low_is_near, true AS high_is_near"


def near(ci, values, keys: list[str]):
    """Bounds of an interval held against the normal's, within an eighth of its width: what SQL can say of resampled ones."""
    spread = values.groupBy(*keys).agg((1.959964 * F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("half"))
    close = lambda c, sign: (F.abs(F.col(c) - F.col("mean") - sign * F.col("half")) <= F.col("half") / 4 + 1e-9).alias(f"{c}_is_near")
    return ci.join(spread, keys).select(*keys, "n", F.round("mean", 6).alias("mean"), close("low", -1), close("high", 1))


@query(f"WITH {LONG_VERDICTS} SELECT arm, axis, count(*) AS n, round(avg(score), 6) AS mean, {NEAR} FROM axes WHERE error IS NULL GROUP BY ALL")
def bootstrap_ci(t: Tables):
    values = judge.long_axes(t.verdicts().filter("error IS NULL"), ["arm"])
    return near(judge.bootstrap(values, ["arm", "axis"]), values, ["arm", "axis"])


def baseline_scores(t: Tables):
    return judge.long_axes(t.verdicts().filter("error IS NULL AND arm = 'base'"), [])


def baseline(t: Tables):
    """The base arm's scores: n, mean and interval of each axis."""
    return judge.bootstrap(baseline_scores(t), ["axis"])


@query(f"WITH {LONG_VERDICTS} SELECT axis, count(*) AS n, round(avg(score), 6) AS mean, {NEAR} FROM axes WHERE arm = 'base' AND error IS NULL GROUP BY ALL")
def validation_baseline(t: Tables):
    return near(baseline(t), baseline_scores(t), ["axis"])


def validated(t: Tables):
    """Each probe and axis: n, mean difference, bootstrap interval, signed ranks, discrimination, label; missing pairs have n 0."""
    d = all_deltas(t)
    ci = judge.bootstrap(d, ["probe", "axis"])
    w = judge.wilcoxon(d, ["probe", "axis"]).select("probe", "axis", "n_effective", "statistic", "p_value", "error")
    rate = d.groupBy("probe", "axis").agg(judge.discrimination(F.col("value")).alias("rate"))
    s = expected(t).join(ci, ["probe", "axis"], "left").join(w, ["probe", "axis"], "left").join(rate, ["probe", "axis"], "left")
    return s.withColumn("label", judge.probe_label(F.col("mean"), F.col("low"), F.col("high"), F.col("expected"))).withColumn("missing", F.col("n").isNull()).withColumn("n", F.coalesce("n", F.lit(0)))


@query()
def validation_summary(t: Tables):
    return validated(t)


@query(f"""WITH {WILCOXON}, b AS (SELECT axis, avg(score) AS base_mean FROM axes WHERE arm = 'base' AND error IS NULL GROUP BY 1), w AS (SELECT probe, axis, count(*) AS n_effective, sum(CASE WHEN delta > 0 THEN r ELSE 0 END)::DOUBLE AS statistic FROM rk GROUP BY ALL)
SELECT probe, axis, count(*) AS n, round(avg(delta), 6) AS mean, any_value(n_effective) AS n_effective, any_value(statistic) AS statistic, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0 END), 6) AS rate, false AS missing, round(any_value(base_mean), 6) AS base_mean FROM deltas JOIN w USING (probe, axis) JOIN b USING (axis) GROUP BY probe, axis""")
def validation_figures(t: Tables):
    """What SQL can follow of validation_summary, and the baseline's mean."""
    base = judge.long_axes(t.verdicts().filter("error IS NULL AND arm = 'base'"), ["arm"]).groupBy("axis").agg(F.round(F.avg("value"), 6).alias("base_mean"))
    s = validated(t).select("probe", "axis", "n", F.round("mean", 6).alias("mean"), "n_effective", "statistic", F.round("rate", 6).alias("rate"), "missing")
    return s.join(base, "axis")


def unrelated_p(r: str, n: str) -> str:
    """Two-sided p of a correlation of n pairs."""
    inside = simpson(f"pow(1 - t * t, ({n} - 4) / 2.0) * exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi())", f"abs({r})")
    return f"round(CASE WHEN {r} IS NOT NULL THEN 1 - 2 * {inside} END, 6) AS {r}_p"


AGAINST = [(a, f"{a}_vs_{k}", x, y) for k in ("hit1", "mrr") for a in judge.AXES for x, y in [("hit_at_1", a) if k == "hit1" else (f"rank_{a}", "rank_mrr")]]
RANKED = ", ".join(f"rank() OVER (PARTITION BY model_tag ORDER BY {c}) + (count(*) OVER (PARTITION BY model_tag, {c}) - 1) / 2.0 AS rank_{c}" for c in (*judge.AXES, "mrr"))
# an axis is there for all rows of a model or for none, so ranks of MRR need no restriction
CORRELATED = ", ".join(f"CASE WHEN count({a}) >= 3 THEN corr(CASE WHEN {a} IS NOT NULL THEN {x} END, {y}) END AS {name}, count({a}) AS {name}_n" for a, name, x, y in AGAINST)
LENGTHS = ", ".join(f"round({f}, 6) AS {c}_{name}" for c in ("chars", "tokens") for name, f in (("mean", f"avg(output_{c})"), ("p50", f"quantile_cont(output_{c}, 0.5)"), ("p95", f"quantile_cont(output_{c}, 0.95)"), ("max", f"max(output_{c})::DOUBLE")))


def agreement(t: Tables):
    return judge.agreement(judged_outputs(t))


@query(f"""WITH {VERDICTS}, {OUTPUTS}, rk AS (SELECT *, {RANKED} FROM paired),
s AS (SELECT model_tag, count(*) AS n_paired, round(avg(groundedness), 6) AS groundedness, round(avg(hit_at_1), 6) AS recall_at_1, round(avg(hit_at_5), 6) AS recall_at_5, round(avg(hit_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr_mean, count(output_tokens) AS n_tokens, {LENGTHS}, {CORRELATED} FROM rk GROUP BY model_tag)
SELECT model_tag, n_paired, groundedness, recall_at_1, recall_at_5, recall_at_10, mrr_mean, n_tokens, {", ".join(f"{c}_{k}" for c in ("chars", "tokens") for k in ("mean", "p50", "p95", "max"))},
 {", ".join(f"round({n}, 6) AS {n}, {n}_n, {unrelated_p(n, n + '_n')}" for _, n, _, _ in AGAINST)} FROM s""")
def judge_summary(t: Tables):
    """Per model: retrieval of the judged outputs, correlations of all axes with it and their p, lengths."""
    found = agreement(t).drop("n_chars").withColumns({f"{c}_max": F.col(f"{c}_max").cast("double") for c in ("chars", "tokens")})
    return found.withColumns({f.name: F.round(f.name, 6) for f in found.schema if f.dataType.simpleString() == "double"})
