"""Queries on rankings: retrieval metrics, agreement, merging, position bias."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.functions.stats import tau_b
from rankloom.operators import bias, merging, resume

from .base import RANKS, Tables, chi2_tail_sql, query, reverse_student

RANK = "(SELECT s FROM rk r WHERE r.sample_id = rk.sample_id AND r.slot = rk.gt)"
PER_SAMPLE = RANKS + """, one AS (SELECT sample_id, user_id, model, any_value(gt) AS gt, bool_and(parsed) AS parsed, max(CASE WHEN slot = gt AND parsed THEN s END) AS rank,
  max(CASE WHEN slot = gt THEN t END) AS t_rank, max(CASE WHEN s = 1 THEN slot END) AS s_top, max(CASE WHEN t = 1 THEN slot END) AS t_top FROM rk GROUP BY ALL)"""
METRICS = """count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10,
  round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10"""
TAU = RANKS + """, tau AS (SELECT a.sample_id, sum(sign((a.t - b.t) * (a.s - b.s))) / 45.0 AS tau FROM rk a JOIN rk b ON a.sample_id = b.sample_id AND a.slot < b.slot GROUP BY 1)"""


def with_rank(t: Tables, column: str = "student"):
    """rank of the positive in a ranking; NULL without a positive or a ranking."""
    return t.rankings().withColumn("rank", ranks.rank_of(F.col(column), F.col("gt")))


def metrics(df, keys):
    r = F.col("rank")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), mean(ranks.hit_at(r, 1), "recall_1"), mean(ranks.hit_at(r, 5), "recall_5"), mean(ranks.hit_at(r, 10), "recall_10"),
        mean(ranks.reciprocal(r), "mrr"), mean(ranks.gain_at(r, 5), "ndcg_5"), mean(ranks.gain_at(r, 10), "ndcg_10"))


@query(f"WITH {PER_SAMPLE} SELECT model, {METRICS} FROM one GROUP BY model")
def retrieval_metrics(t: Tables):
    return metrics(with_rank(t), ["model"])


@query(f"WITH {PER_SAMPLE} SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 3) AS hits_3, count(*) FILTER (rank <= 5) AS hits_5 FROM one")
def recall_at_k(t: Tables):
    return with_rank(t).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}") for k in (1, 3, 5)])


@query(f"WITH {PER_SAMPLE} SELECT sample_id, round(coalesce(1.0 / rank, 0), 9) AS mrr FROM one")
def mrr(t: Tables):
    return with_rank(t).select("sample_id", F.round(ranks.reciprocal(F.col("rank")), 9).alias("mrr"))


@query(f"WITH {PER_SAMPLE} SELECT sample_id, round(CASE WHEN rank <= 5 THEN 1.0 / log2(rank + 1) ELSE 0 END, 9) AS ndcg_5 FROM one")
def ndcg(t: Tables):
    return with_rank(t).select("sample_id", F.round(ranks.gain_at(F.col("rank"), 5), 9).alias("ndcg_5"))


@query(f"WITH {PER_SAMPLE} SELECT sample_id, CASE WHEN gt IS NULL OR NOT parsed THEN NULL ELSE rank - 1 END AS rank0, CASE WHEN gt IS NOT NULL AND parsed THEN CAST(rank <= 1 AS BIGINT) END AS hit_1, CASE WHEN gt IS NOT NULL AND parsed THEN CAST(rank <= 5 AS BIGINT) END AS hit_5 FROM one")
def per_sample_retrieval(t: Tables):
    known = F.col("gt").isNotNull() & F.col("student").isNotNull()
    at = lambda k: F.when(known, F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)))
    return with_rank(t).select("sample_id", F.when(known, F.coalesce(F.col("rank") - 1, F.lit(-1))).alias("rank0"), at(1).alias("hit_1"), at(5).alias("hit_5"))


@query(f"WITH {TAU} SELECT sample_id, round(tau, 9) AS tau FROM tau")
def kendall_tau(t: Tables):
    return t.rankings().select("sample_id", F.round(ranks.kendall_tau(F.col("teacher"), F.col("full_student")), 9).alias("tau"))


@query(f"WITH {TAU}, one AS (SELECT sample_id, bool_and(parsed) AS parsed, max(CASE WHEN t = 1 THEN s END) = 1 AS same FROM rk GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN parsed AND same THEN 1.0 ELSE 0 END), 6) AS top1_agreement, round(coalesce(avg(CASE WHEN parsed THEN tau END), 0), 6) AS kendall_tau_mean, count(*) FILTER (parsed) AS kendall_tau_valid_n FROM one JOIN tau USING (sample_id)")
def teacher_agreement(t: Tables):
    tau = ranks.kendall_tau(F.col("student"), F.col("teacher"))
    same = F.coalesce((F.get("student", F.lit(0)) == F.get("teacher", F.lit(0))).cast("double"), F.lit(0.0))
    return t.rankings().select(same.alias("same"), tau.alias("tau")).agg(F.count("*").alias("n"), F.round(F.avg("same"), 6).alias("top1_agreement"), F.round(F.coalesce(F.avg("tau"), F.lit(0.0)), 6).alias("kendall_tau_mean"), F.count("tau").alias("kendall_tau_valid_n"))


@query("SELECT o_orderkey AS sample_id, nullif((o_orderkey * 31 + o_custkey * 17) % 11, 0) AS slot FROM orders")
def gt_position(t: Tables):
    r = t.rankings().withColumn("positive", F.when(F.col("gt").isNotNull(), F.get("candidates", F.col("gt") - 1)).otherwise(F.lit(-1).cast("long")))
    return r.select("sample_id", ranks.rank_of(F.col("candidates"), F.col("positive")).alias("slot"))


@query(f"WITH {RANKS} SELECT sample_id, array_to_string(list(sample_id * 10 + slot ORDER BY s), ',') AS ids FROM rk WHERE parsed GROUP BY sample_id UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0")
def recover_ids(t: Tables):
    return t.rankings().select("sample_id", F.array_join(ranks.pick_strict(F.col("candidates"), F.col("student")), ",").alias("ids"))


@query(f"WITH {RANKS} SELECT sample_id, array_to_string(list(CASE WHEN slot < 10 THEN CAST(sample_id * 10 + slot + 1 AS VARCHAR) ELSE 'none' END ORDER BY s), ',') AS ids FROM rk GROUP BY sample_id")
def recover_ids_nullable(t: Tables):
    shifted = F.transform("full_student", lambda x: x + 1)  # slot 11 doesn't exist
    return t.rankings().select("sample_id", F.array_join(ranks.pick(F.col("candidates"), shifted), ",", "none").alias("ids"))


@query(f"WITH {RANKS} SELECT sample_id, array_to_string(list(s - 1 ORDER BY slot), ',') AS places FROM rk GROUP BY sample_id")
def rank_vector(t: Tables):
    return t.rankings().select("sample_id", F.array_join(ranks.rank_vector(F.col("full_student")), ",").alias("places"))


@query(f"WITH {RANKS} SELECT sample_id, array_to_string(list(slot ORDER BY s), ',') AS ranking FROM rk GROUP BY sample_id")
def compose_permutation(t: Tables):
    return reverse_student(t).select("sample_id", F.array_join(ranks.compose(F.col("shown"), ranks.make_permutation("reverse")), ",").alias("ranking"))


@query("SELECT o_orderkey AS sample_id, array_to_string(list(o_orderkey * 10 + slot ORDER BY slot DESC), ',') AS shown FROM orders, (SELECT unnest(range(1, 11)) AS slot) GROUP BY 1")
def apply_permutation(t: Tables):
    back = ranks.make_permutation("reverse")
    return t.rankings().select("sample_id", F.array_join(F.when(ranks.is_permutation(back, F.size("candidates")), ranks.pick(F.col("candidates"), back)), ",").alias("shown"))


@query("SELECT round((SELECT sum(1.0 / r) FROM range(1, 11) x(r)) / 10, 9) AS mrr")
def random_baseline(t: Tables):
    return t.spark.range(1).select(F.round(ranks.random_mrr(), 9).alias("mrr"))


@query(f"WITH {RANKS}, b AS (SELECT sample_id, slot, t, row_number() OVER (PARTITION BY sample_id ORDER BY 20 - t - s DESC, t) AS place FROM rk) SELECT sample_id, array_to_string(list(slot ORDER BY place), ',') AS merged FROM b GROUP BY sample_id")
def borda_merge(t: Tables):
    second = ranks.compose(F.col("shown"), ranks.make_permutation("reverse"))
    return reverse_student(t).select("sample_id", F.array_join(ranks.borda_merge(F.col("teacher"), second), ",").alias("merged"))


@query(f"WITH {RANKS} SELECT sample_id, array_to_string(list(20 - t - s ORDER BY slot), ',') AS points, round(sum(CASE WHEN t = 1 AND s = 1 THEN 1 ELSE 0 END), 0) = 1 AS top1_agreement FROM rk GROUP BY sample_id")
def borda_points(t: Tables):
    return t.rankings().select("sample_id", F.array_join(ranks.borda_scores(F.col("teacher"), F.col("full_student")), ",").alias("points"), (F.get("teacher", F.lit(0)) == F.get("full_student", F.lit(0))).alias("top1_agreement"))


@query(f"WITH {TAU}, one AS (SELECT sample_id, max(CASE WHEN t = 1 THEN s END) = 1 AS same FROM rk GROUP BY 1) SELECT count(*) AS n, round(avg(tau), 6) AS tau_mean, round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN tau > 0 THEN 1.0 ELSE 0 END), 6) AS tau_positive FROM tau JOIN one USING (sample_id)")
def merge_diagnostics(t: Tables):
    d = t.rankings().select(ranks.kendall_tau(F.col("teacher"), F.col("full_student")).alias("tau"), (F.get("teacher", F.lit(0)) == F.get("full_student", F.lit(0))).cast("double").alias("same"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("tau"), 6).alias("tau_mean"), F.round(F.avg("same"), 6).alias("top1"), F.round(F.avg((F.col("tau") > 0).cast("double")), 6).alias("tau_positive"))


@query("SELECT o_orderkey AS sample_id, o_orderkey % 3 = 0 AS valid FROM orders")
def strict_valid(t: Tables):
    """A third whole, a third with a repeated slot, a third cut short."""
    r = F.col("teacher")
    made = F.when(F.col("sample_id") % 3 == 0, r).when(F.col("sample_id") % 3 == 1, F.concat(F.slice(r, 1, 9), F.slice(r, 1, 1))).otherwise(F.slice(r, 1, 9))
    return t.rankings().select("sample_id", ranks.is_permutation(made).alias("valid"))


@query(f"WITH {RANKS} SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'preexisting_error' WHEN o_orderkey % 11 = 0 THEN 'no_sample' WHEN o_orderkey % 7 = 0 THEN 'invalid' ELSE 'kept' END AS status, count(*) AS n FROM orders GROUP BY 1")
def join_filter_stats(t: Tables):
    r = t.rankings().withColumn("error", F.when(F.col("sample_id") % 13 == 0, "http"))
    known = t("orders").filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("sample_id"))
    return resume.classified(r, known, "student IS NULL").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS sample_id, o_custkey AS user_id FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0")
def valid_rankings(t: Tables):
    """Records with an error, and others without a strict ranking, go."""
    from rankloom.sources.results import valid_rankings

    r = t.rankings().select("sample_id", "user_id", F.when(F.col("sample_id") % 13 == 0, "http").alias("error"), F.when(F.col("sample_id") % 7 == 0, F.slice("teacher", 1, 9)).otherwise(F.col("teacher")).alias("ranking"))
    return valid_rankings(r).select("sample_id", "user_id")


@query(f"""WITH {TAU}, b AS (SELECT sample_id, slot, t, s, row_number() OVER (PARTITION BY sample_id ORDER BY 20 - t - s DESC, t) AS place FROM rk WHERE sample_id % 5 <> 0)
SELECT sample_id, any_value(user_id) AS user_id, array_to_string(list(slot ORDER BY place), ',') AS ranking, array_to_string(list(slot ORDER BY s), ',') AS second, array_to_string(list(20 - t - s ORDER BY slot), ',') AS points, bool_or(t = 1 AND s = 1) AS top1_agreement, round(any_value(tau), 4) AS kendall_tau
FROM b JOIN (SELECT DISTINCT sample_id, user_id FROM rk) USING (sample_id) JOIN tau USING (sample_id) GROUP BY sample_id""")
def merge_records(t: Tables):
    """Whole merged records; a fifth of the second passes isn't strict."""
    back = ranks.make_permutation("reverse")
    first = t.rankings().select("sample_id", "user_id", F.col("teacher").alias("ranking"))
    second = reverse_student(t).select("sample_id", F.when(F.col("sample_id") % 5 == 0, F.slice("shown", 1, 9)).otherwise(F.col("shown")).alias("ranking"), back.alias("permutation"))
    m = merging.merge_records(first, second)
    joined = lambda c: F.array_join(c, ",")
    return m.select("sample_id", "user_id", joined("ranking").alias("ranking"), joined("merge.pass2_ranking_original_space").alias("second"), joined("merge.borda_scores").alias("points"), "merge.top1_agreement", "merge.kendall_tau")


@query(f"""WITH {PER_SAMPLE}, m AS (SELECT model, count(*) AS n, avg(CASE WHEN rank <= 1 AND sample_id % 9 <> 0 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN rank <= 5 AND sample_id % 9 <> 0 THEN 1.0 / log2(rank + 1) ELSE 0 END) AS n5, avg(CASE WHEN rank <= 10 AND sample_id % 9 <> 0 THEN 1.0 / log2(rank + 1) ELSE 0 END) AS n10 FROM one GROUP BY model)
SELECT model AS tag, CASE model WHEN '5-LOW' THEN 'skipped_no_raw' WHEN '1-URGENT' THEN 'already_has_ndcg' ELSE 'updated' END AS status, round(CASE WHEN model IN ('1-URGENT', '5-LOW') THEN 0.25 ELSE r1 END, 6) AS recall_1, round(CASE model WHEN '1-URGENT' THEN 0.5 WHEN '5-LOW' THEN NULL ELSE n5 END, 6) AS ndcg_5, round(CASE model WHEN '1-URGENT' THEN 0.75 WHEN '5-LOW' THEN NULL ELSE n10 END, 6) AS ndcg_10,
 CASE WHEN model IN ('1-URGENT', '5-LOW') THEN NULL ELSE n::DOUBLE END AS n_evaluated, 7.0::DOUBLE AS other, 0.125::DOUBLE AS teacher_ndcg_5 FROM m""")
def backfill_ndcg(t: Tables):
    """One run has its gains already, one has no raw rankings; a ninth of the samples isn't known."""
    tag = F.col("tag")
    old = F.map_from_arrays(F.array(F.lit("recall@1"), F.lit("other")), F.array(F.lit(0.25), F.lit(7.0)))
    whole = F.map_concat(old, F.map_from_arrays(F.array(F.lit("ndcg@5"), F.lit("ndcg@10")), F.array(F.lit(0.5), F.lit(0.75))))
    summaries = t("orders").select(F.col("o_orderpriority").alias("tag")).distinct().select("tag", F.when(tag == "1-URGENT", whole).otherwise(old).alias("student"), F.create_map(F.lit("ndcg@5"), F.lit(0.125)).alias("teacher"))
    r = t.rankings()
    raw = r.filter("model <> '5-LOW'").select(F.col("model").alias("tag"), "sample_id", F.col("student").alias("ranking"), F.lit("nobody").alias("positive"))
    ids = F.transform("candidates", lambda c: c.cast("string"))
    samples = r.filter("sample_id % 9 <> 0").select("sample_id", ids.alias("ids"), F.when(F.col("gt").isNotNull(), F.get(ids, F.col("gt") - 1)).otherwise("").alias("positive"))
    b = merging.backfill(summaries, raw, samples)
    of = lambda m, name: F.round(F.try_element_at("student", F.lit(m)), 6).alias(name)
    return b.select("tag", "status", of("recall@1", "recall_1"), of("ndcg@5", "ndcg_5"), of("ndcg@10", "ndcg_10"), of("n_evaluated", "n_evaluated"), of("other", "other"), F.element_at("teacher", F.lit("ndcg@5")).alias("teacher_ndcg_5"))


# --- position bias --------------------------------------------------------------


TOP = PER_SAMPLE + ", tops AS (SELECT model, slot, count(s_top) AS n FROM (SELECT DISTINCT model FROM one) m CROSS JOIN (SELECT unnest(range(1, 11)) AS slot) g LEFT JOIN (SELECT model AS mm, s_top FROM one WHERE parsed) o ON mm = m.model AND s_top = slot GROUP BY ALL)"


def tops(t: Tables):
    parsed = t.rankings().filter("student IS NOT NULL")
    return bias.slot_counts(parsed, F.get("student", F.lit(0)), ["model"])


@query(f"WITH {TOP}, d AS (SELECT model, sum(n)::BIGINT AS n_total, arg_max(slot, (n, -slot)) AS argmax, arg_min(slot, (n, slot)) AS argmin, round(100.0 * max(n) / sum(n), 6) AS max_percent, round(100.0 * min(n) / sum(n), 6) AS min_percent, sum(n * n) * 10.0 / sum(n) - sum(n) AS x, array_to_string(list(n ORDER BY slot), ',') AS counts, list(n ORDER BY slot) AS ns FROM tops GROUP BY model) "
       f"SELECT model, n_total, argmax, argmin, max_percent, min_percent, round(x, 6) AS chi2, 9::BIGINT AS df, counts, array_to_string(list_transform(ns, lambda c: printf('%.3f', 100.0 * c / n_total)), ',') AS percent, round({chi2_tail_sql('x', 9)}, 6) AS p, CASE WHEN {chi2_tail_sql('x', 9)} >= 0.05 THEN 'UNIFORM' ELSE 'NON-UNIFORM' END AS verdict FROM d")
def slot_describe(t: Tables):
    d = bias.described(tops(t), ["model"])
    text = lambda c: F.array_join(c, ",")
    return d.withColumns({c: F.round(c, 6) for c in ("max_percent", "min_percent", "chi2", "p")} | {"counts": text("counts"), "percent": text(F.transform("percent", lambda x: F.format_string("%.3f", x)))})


@query(f"WITH {TOP} SELECT model, sum(n)::BIGINT AS n, round(sum(n * n) * 10.0 / sum(n) - sum(n), 6) AS chi2 FROM tops GROUP BY model")
def chi2_uniform(t: Tables):
    return tops(t).groupBy("model").agg(F.sum("n").alias("n"), F.round(bias.chi_square(), 6).alias("chi2"))


@query(f"WITH {PER_SAMPLE} SELECT slot, count(gt) AS support, count(*) FILTER (s_top = gt) AS hits, round(count(*) FILTER (s_top = gt) / nullif(count(gt), 0), 6) AS recall FROM (SELECT unnest(range(1, 11)) AS slot) g LEFT JOIN (SELECT * FROM one WHERE parsed) ON gt = slot GROUP BY slot")
def recall_by_gt_slot(t: Tables):
    r = bias.recall_by_slot(t.rankings().filter("student IS NOT NULL"), F.col("gt"), F.get("student", F.lit(0)))
    return r.withColumn("recall", F.round("recall", 6))


@query(f"""WITH {PER_SAMPLE}, v AS (SELECT * FROM one WHERE parsed), m AS (SELECT DISTINCT model FROM v), c AS (SELECT m.model, slot, (SELECT count(*) FROM v WHERE v.model = m.model AND s_top = slot) AS n, (SELECT count(*) FROM v WHERE v.model = m.model AND gt = slot) AS support, (SELECT count(*) FROM v WHERE v.model = m.model AND gt = slot AND s_top = slot) AS hits FROM m, (SELECT unnest(range(1, 11)) AS slot)),
s AS (SELECT model, sum(n)::BIGINT AS n_valid, array_to_string(list(n ORDER BY slot), ',') AS top1_slot_counts, round(max(CASE WHEN slot = 1 THEN n END) / sum(n), 4) AS slot1_top1_rate, sum(n * n) * 10.0 / sum(n) - sum(n) AS x, array_to_string(list(coalesce(printf('%.4f', round(hits / nullif(support, 0), 4)), '-') ORDER BY slot), ',') AS recall_by_gt_position, array_to_string(list(support ORDER BY slot), ',') AS recall_support FROM c GROUP BY model)
SELECT model, n_valid, top1_slot_counts, slot1_top1_rate, round(x, 3) AS chi2_uniform, round({chi2_tail_sql('x', 9)}, 6) AS chi2_pvalue, recall_by_gt_position, recall_support FROM s""")
def position_bias(t: Tables):
    found = bias.position_bias(t.rankings(), "student", "gt", ["model"])
    text = lambda c: F.array_join(c, ",")
    shown = F.transform("recall_by_gt_position", lambda x: F.coalesce(F.when(x.isNotNull(), F.format_string("%.4f", x)), F.lit("-")))
    return found.withColumns({"top1_slot_counts": text("top1_slot_counts"), "recall_by_gt_position": text(shown), "recall_support": text("recall_support")})


MATRIX = RANKS + ", m AS (SELECT p AS rank_pos, g.slot, count(s) AS n FROM (SELECT unnest(range(1, 11)) AS p) CROSS JOIN (SELECT unnest(range(1, 11)) AS slot) g LEFT JOIN rk ON s = p AND rk.slot = g.slot AND parsed GROUP BY ALL), mp AS (SELECT *, 100.0 * n / greatest(sum(n) OVER (PARTITION BY rank_pos), 1) AS percent FROM m)"


def matrix(t: Tables):
    return bias.rank_slot_matrix(t.rankings().filter("student IS NOT NULL"), "student")


@query(f"WITH {MATRIX} SELECT rank_pos, slot, n, round(percent, 6) AS percent FROM mp")
def rank_slot_matrix(t: Tables):
    return matrix(t).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {MATRIX}, x AS (SELECT rank_pos, sum(n * n) * 10.0 / sum(n) - sum(n) AS chi2 FROM m GROUP BY rank_pos), w AS (SELECT sum(n * n) * 100.0 / sum(n) - sum(n) AS chi2 FROM m)
SELECT rank_pos, round(chi2, 6) AS chi2, 9::BIGINT AS df, round({chi2_tail_sql('chi2', 9)}, 6) AS p FROM x UNION ALL SELECT NULL, round(chi2, 6), 99::BIGINT, round({chi2_tail_sql('chi2', 99, 400)}, 6) FROM w""")
def rank_slot_chi2(t: Tables):
    tests = bias.matrix_tests(matrix(t))
    return tests.withColumns({"chi2": F.round("chi2", 6), "p": F.round("p", 6)})


# lists of a user's orders, by date, of numbers that tie
TIED = """u AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_orderkey % 7 AS x, floor(o_totalprice / 60000) AS y FROM orders)"""


@query(f"""WITH {TIED}, p AS (SELECT a.user_id, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM u a JOIN u b ON a.user_id = b.user_id AND a.i < b.i),
s AS (SELECT user_id, sum(dx * dy) AS agree, count(*) FILTER (dx <> 0) AS nx, count(*) FILTER (dy <> 0) AS ny FROM p GROUP BY 1)
SELECT user_id, coalesce(round(CASE WHEN nx > 0 AND ny > 0 THEN agree / sqrt(nx * ny::DOUBLE) ELSE 0 END, 9), 0) AS tau FROM (SELECT DISTINCT user_id FROM u) LEFT JOIN s USING (user_id)""")
def kendall_tau_b(t: Tables):
    """Tau-b of two lists with ties; 0 where one doesn't vary."""
    at = F.struct("o_orderdate", "o_orderkey", (F.col("o_orderkey") % 7).cast("double").alias("x"), F.floor(F.col("o_totalprice") / 60000).cast("double").alias("y"))
    lists = t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_sort(F.collect_list(at)).alias("o"))
    return lists.select("user_id", F.round(tau_b(F.col("o.x"), F.col("o.y")), 9).alias("tau"))


@query(f"WITH {MATRIX} SELECT 'diagonal' AS profile, rank_pos, round(percent, 6) AS percent FROM mp WHERE rank_pos = slot UNION ALL SELECT 'slot1', rank_pos, round(percent, 6) FROM mp WHERE slot = 1")
def rank_slot_profiles(t: Tables):
    m = matrix(t).withColumn("percent", F.round("percent", 6))
    of = lambda name, where: m.filter(where).select(F.lit(name).alias("profile"), "rank_pos", "percent")
    return of("diagonal", "rank_pos = slot").unionByName(of("slot1", "slot = 1"))


@query(f"WITH {MATRIX} SELECT rank_pos, " + ", ".join(f"sum(CASE WHEN slot = {k} THEN n END)::BIGINT AS slot_{k}" for k in range(1, 11)) + " FROM m GROUP BY 1")
def rank_slot_pivot(t: Tables):
    p = matrix(t).groupBy("rank_pos").pivot("slot", list(range(1, 11))).agg(F.first("n"))
    return p.select("rank_pos", *[F.col(f"`{k}`").alias(f"slot_{k}") for k in range(1, 11)])


@query(f"WITH {PER_SAMPLE} SELECT model, pass AS variant, round(avg(CASE WHEN s_top = 1 THEN 1.0 ELSE 0 END), 6) AS slot1_rate FROM one JOIN (SELECT DISTINCT sample_id, pass FROM rk) USING (sample_id) WHERE parsed GROUP BY ALL")
def slot1_cells(t: Tables):
    r = t.rankings().filter("student IS NOT NULL")
    return r.groupBy("model", F.col("pass").alias("variant")).agg(F.round(F.avg((F.get("student", F.lit(0)) == 1).cast("double")), 6).alias("slot1_rate"))


@query(f"WITH {PER_SAMPLE}, m AS (SELECT model, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS r FROM one GROUP BY 1), p AS (SELECT * FROM (VALUES ('1-URGENT', '2-HIGH'), ('3-MEDIUM', '5-LOW'), ('1-URGENT', 'absent')) v(a, b)) SELECT p.a, p.b, round(y.r - x.r, 6) AS delta FROM p LEFT JOIN m x ON x.model = p.a LEFT JOIN m y ON y.model = p.b")
def attribution_delta(t: Tables):
    """Differences of recall@1 between fixed pairs of runs; NULL where a run is missing."""
    m = with_rank(t).groupBy("model").agg(F.avg(ranks.hit_at(F.col("rank"), 1)).alias("r"))
    fixed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("1-URGENT", "2-HIGH"), ("3-MEDIUM", "5-LOW"), ("1-URGENT", "absent"))])
    p = t.spark.range(1).select(F.inline(fixed))
    x, y = m.select(F.col("model").alias("a"), F.col("r").alias("ra")), m.select(F.col("model").alias("b"), F.col("r").alias("rb"))
    return p.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.round(F.col("rb") - F.col("ra"), 6).alias("delta"))
