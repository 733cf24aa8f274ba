"""Queries on samples: filters, histories, candidates, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import bias, resume, samples, validation
from rankloom.sources import jsonl

from .base import CANDIDATES, RECENT, VISIT_ORDER, VISITS, Tables, query

KEYWORDS = ["ring", "widget", "bolt"]
LIKE = " OR ".join(f"lower(p_name) LIKE '%{k}%'" for k in KEYWORDS)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_shipdate DESC) AS rn FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey FROM r WHERE rn = 1")
def scan_dedup_last_wins(t: Tables):
    order = [F.desc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]
    return jsonl.last_wins(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 1")
def shard_modulo(t: Tables):
    return jsonl.shard(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1, 4)


@query("SELECT count(*) AS n_lines, count(*) FILTER (event_id % 5 = 0) AS n_bad, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS total FROM events")
def scan_jsonl_keep_bad(t: Tables):
    from pyspark.sql import types as T

    broken = t("events").select(F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit(" tail"))).otherwise(F.col("props")).alias("value"))
    rows = jsonl.parse(broken, T.StructType([T.StructField("k", T.LongType())]), "keep")
    return rows.agg(F.count("*").alias("n_lines"), F.count(jsonl.BAD).alias("n_bad"), F.sum("k").alias("total"))


@query(f"SELECT p_partkey, p_name, coalesce({LIKE}, false) AS kept FROM part")
def filter_keywords(t: Tables):
    return t("part").select("p_partkey", "p_name", text.holds_keyword(F.col("p_name"), KEYWORDS).alias("kept"))


@query(f"SELECT p_partkey AS item_id, p_name AS name, p_type AS categories, p_retailprice AS avg_stars FROM part WHERE lower(trim(p_type)) = 'economy' AND upper(trim(p_brand)) = 'BRAND#2' AND ({LIKE})")
def filter_project_entities(t: Tables):
    rows = t("part").filter((F.lower(F.trim("p_type")) == "economy") & (F.upper(F.trim("p_brand")) == "BRAND#2") & text.holds_keyword(F.col("p_name"), KEYWORDS))
    return rows.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("categories"), F.col("p_retailprice").alias("avg_stars"))


@query(f"WITH {VISITS} SELECT user_id, count(*) AS n_visits FROM visits GROUP BY user_id HAVING count(*) >= 8")
def having_min_history(t: Tables):
    return samples.at_least(t.visits())


@query(f"WITH {VISITS} SELECT user_id, (SELECT count(*) FROM part) - count(DISTINCT item_id) AS pool FROM visits GROUP BY user_id HAVING pool >= 9")
def pool_size_filter(t: Tables):
    seen = t.visits().groupBy("user_id").agg(F.count_distinct("item_id").alias("seen"))
    return seen.select("user_id", (F.lit(t.n_items()) - F.col("seen")).alias("pool")).filter("pool >= 9")


@query(f"WITH {VISITS} SELECT user_id, item_id, date FROM visits WHERE item_id IN (SELECT p_partkey FROM part WHERE {LIKE})")
def semi_join_visits(t: Tables):
    kept = t("part").filter(text.holds_keyword(F.col("p_name"), KEYWORDS)).select(F.col("p_partkey").alias("item_id"))
    return t.visits().select("user_id", "item_id", "date").join(kept, "item_id", "left_semi").select("user_id", "item_id", "date")


@query(f"WITH {VISITS} SELECT user_id, item_id, date, p_name AS name, p_type AS categories FROM visits JOIN part ON p_partkey = item_id")
def join_enrich_history(t: Tables):
    meta = t("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("categories"))
    return t.visits().select("user_id", "item_id", "date").join(meta, "item_id").select("user_id", "item_id", "date", "name", "categories")


@query(f"WITH {RECENT} SELECT user_id, array_to_string(list(item_id || '@' || date ORDER BY recency DESC), ';') AS history FROM recent WHERE recency BETWEEN 2 AND 21 GROUP BY user_id")
def user_histories(t: Tables):
    h = samples.histories(t.visits(), VISIT_ORDER)
    return h.select("user_id", F.array_join(F.transform("history", lambda x: F.concat(x["item_id"].cast("string"), F.lit("@"), x["date"])), ";").alias("history"))


@query(f"WITH {RECENT} SELECT user_id, item_id, date FROM recent WHERE recency = 1 AND n_visits >= 8")
def holdout_last(t: Tables):
    return samples.holdout(t.visits(), VISIT_ORDER).select("user_id", "item_id", "date")


@query(f"WITH {RECENT} SELECT user_id, count(*) AS n_kept, min(date) AS first_date FROM recent WHERE recency BETWEEN 2 AND 21 GROUP BY user_id")
def history_cap(t: Tables):
    kept = samples.with_recency(t.visits(), VISIT_ORDER).filter("recency BETWEEN 2 AND 21")
    return kept.groupBy("user_id").agg(F.count("*").alias("n_kept"), F.min("date").alias("first_date"))


@query(f"WITH {CANDIDATES} SELECT user_id, item_id FROM negs")
def sample_negatives(t: Tables):
    visits = t.visits()
    return samples.negatives(samples.holdout(visits, VISIT_ORDER), visits, t.n_items())


@query(f"WITH {CANDIDATES} SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM visits v WHERE v.user_id = negs.user_id AND v.item_id = negs.item_id)) AS n_visited FROM negs")
def negatives_anti_join(t: Tables):
    visits = t.visits()
    drawn = samples.negatives(samples.holdout(visits, VISIT_ORDER), visits, t.n_items())
    seen = visits.select("user_id", "item_id").distinct().withColumn("seen", F.lit(1))
    return drawn.join(seen, ["user_id", "item_id"], "left").agg(F.count("*").alias("n"), F.count("seen").alias("n_visited"))


@query(f"WITH {CANDIDATES} SELECT * FROM lists")
def candidate_shuffle(t: Tables):
    return samples.candidate_lists(t.visits(), VISIT_ORDER, t.n_items())


@query(f"WITH {CANDIDATES} SELECT s.slot, count(user_id) AS n FROM (SELECT unnest(range(1, 11)) AS slot) s LEFT JOIN (SELECT * FROM lists WHERE is_positive) l ON l.slot = s.slot GROUP BY s.slot")
def slot_counts(t: Tables):
    lists = samples.candidate_lists(t.visits(), VISIT_ORDER, t.n_items())
    return bias.slot_counts(lists.filter("is_positive"), F.col("slot"))


@query(f"WITH {CANDIDATES} SELECT user_id, item_id FROM lists WHERE is_positive ORDER BY user_id LIMIT 100")
def max_users(t: Tables):
    """The cap counts produced samples, not users with visits enough."""
    lists = samples.candidate_lists(t.visits(), VISIT_ORDER, t.n_items())
    return samples.capped_users(lists, 100, samples.CANDIDATES).filter("is_positive").select("user_id", "item_id")


@query("SELECT o_orderkey AS sample_id, CAST(('0x' || sha1(CAST(o_orderkey AS VARCHAR))[1:8]) AS BIGINT) / 4294967296.0 < 0.9 AS is_train FROM orders")
def hash_split(t: Tables):
    return t("orders").select(F.col("o_orderkey").alias("sample_id"), samples.in_train(F.col("o_orderkey")).alias("is_train"))


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, count(*) OVER () AS n FROM orders) SELECT o_orderkey, ordinal FROM o WHERE ordinal % (n // 50) = 0 AND ordinal // (n // 50) < 50")
def stride_sample(t: Tables):
    numbered = samples.with_ordinal(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return samples.stride(numbered, "ordinal", 50).select("o_orderkey", "ordinal")


@query("SELECT CAST(i AS BIGINT) AS place, n_nationkey, n_name FROM range(0, 100) r(i) JOIN nation ON n_nationkey = i % (SELECT count(*) FROM nation)")
def cycle_fill(t: Tables):
    return samples.cycle(t("nation").select("n_nationkey", "n_name"), "n_nationkey", 100)


@query("SELECT o_orderkey AS sample_id, sha256('ranking_shuffled:' || o_orderkey)[1:16] AS seed FROM orders")
def perturb_seed(t: Tables):
    return t("orders").select(F.col("o_orderkey").alias("sample_id"), samples.perturb_seed("ranking_shuffled", F.col("o_orderkey")).alias("seed"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(('0x' || sha1(CAST(o_orderkey AS VARCHAR))[1:8]) AS BIGINT) / 4294967296.0 < 0.9 ORDER BY o_orderdate, o_orderkey LIMIT 512")
def calibration_set(t: Tables):
    """The first rows of the train split."""
    return samples.calibration(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey", ["o_orderdate", "o_orderkey"], 512).drop("o_orderdate")


@query("SELECT o_orderkey FROM orders ORDER BY md5('parse:' || o_orderkey), o_orderkey LIMIT 64")
def random_sample(t: Tables):
    return samples.random_sample(t("orders").select("o_orderkey"), "o_orderkey", 64, "parse")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def first_in_order(t: Tables):
    return samples.first(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 25)


@query("SELECT c_custkey, c_name || '_s0' AS sample_id, c_name[1:16] || '_s0' AS short_id FROM customer")
def sample_keys(t: Tables):
    return t("customer").select("c_custkey", samples.sample_key(F.col("c_name")).alias("sample_id"), samples.sample_key(F.col("c_name"), whole=False).alias("short_id"))


@query("SELECT o_orderkey AS sample_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')")
def resume_anti_join(t: Tables):
    log = t("lineitem").select(F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_returnflag") == "R", "timeout").alias("error"))
    return resume.pending(t("orders").select(F.col("o_orderkey").alias("sample_id")), log, ["sample_id"])


@query("SELECT l_orderkey AS sample_id, l_linestatus AS model_tag, count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus = a.l_linestatus AND b.l_returnflag = 'A') GROUP BY ALL")
def resume_anti_join_composite(t: Tables):
    lines = t("lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("model_tag"), F.when(F.col("l_returnflag") != "A", "timeout").alias("error"))
    return resume.pending(lines, lines, ["sample_id", "model_tag"]).groupBy("sample_id", "model_tag").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS sample_id, model AS model_tag FROM customer, (VALUES ('a'), ('b'), ('c')) m(model) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'b' ELSE 'c' END) = model)")
def work_list_cross_join(t: Tables):
    models = t.spark.range(3).select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") + 1).cast("int")).alias("model_tag"))
    status = F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "b").otherwise("c")
    log = t("orders").select(F.col("o_custkey").alias("sample_id"), status.alias("model_tag"), F.lit(None).cast("string").alias("error"))
    return resume.work_list(t("customer").select(F.col("c_custkey").alias("sample_id")), models, log, ["sample_id", "model_tag"])


@query("""SELECT c_custkey AS sample_id, model AS model_tag, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = model AND o_orderstatus = 'F') THEN 'done' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = model) THEN 'no_output'
WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = model AND o_orderkey % 7 <> 0) THEN 'unparseable' ELSE 'pending' END AS status FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW'), ('absent')) m(model)""")
def judge_list(t: Tables):
    """What a judge is asked: pairs that are done, have no output or one that didn't parse are told apart from the pending ones."""
    models = t.spark.range(1).select(F.explode(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "5-LOW", "absent"]))).alias("model_tag"))
    rows = t("orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("model_tag"), F.when(F.col("o_orderkey") % 7 != 0, "{}").alias("parsed"), F.when(F.col("o_orderstatus") != "F", "timeout").alias("error"))
    return resume.judge_list(t("customer").select(F.col("c_custkey").alias("sample_id")), models, rows, rows)


@query("SELECT n_name AS sample_id, CAST(run AS BIGINT) AS run_id, r_name AS backend FROM nation, range(0, 3) r(run), region")
def measurement_grid(t: Tables):
    return resume.grid(t("nation").select(F.col("n_name").alias("sample_id")), t.spark.range(3).select(F.col("id").alias("run_id")), t("region").select(F.col("r_name").alias("backend")))


@query("SELECT DISTINCT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def coverage_check(t: Tables):
    return resume.missing(t("part").select(F.col("p_partkey").alias("item_id")), t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("item_id")), ["item_id"])


@query("SELECT DISTINCT l_partkey AS item_id FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def orphans_except(t: Tables):
    return t("lineitem").select(F.col("l_partkey").alias("item_id")).distinct().exceptAll(t("part").filter("p_size > 25").select("p_partkey"))


@query("SELECT o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def ids_intersect(t: Tables):
    of = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("user_id"))
    return of("F").intersect(of("P"))


@query("SELECT event_type AS tag FROM events UNION SELECT o_orderstatus FROM orders")
def tags_union(t: Tables):
    return t("events").select(F.col("event_type").alias("tag")).unionByName(t("orders").select(F.col("o_orderstatus").alias("tag"))).distinct()


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_linenumber)")
def duplicate_ids(t: Tables):
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("n_distinct")).filter("n > n_distinct")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 4096")
def length_gate(t: Tables):
    return samples.no_longer(t("documents").select("doc_id", "n_chars"), "n_chars", 4096)


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def error_gate(t: Tables):
    return t("events").select("event_id", "user_id", F.when(F.col("event_type") == "error", "failed").alias("error")).transform(samples.without_error).drop("error")


@query("SELECT event_id, substring('raw ' || props || ' ' || value, 1, 500) AS raw FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def failed_samples_topn(t: Tables):
    failed = t("events").filter("event_type = 'error'").orderBy("event_id").limit(20)
    return failed.select("event_id", F.substring(F.concat(F.lit("raw "), "props", F.lit(" "), F.col("value").cast("string")), 1, 500).alias("raw"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def topk_longest(t: Tables):
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("WITH c AS (SELECT file, place, sample_id, backend, score, positive FROM (SELECT l_linenumber AS file, l_partkey * 100000 + l_suppkey AS place, l_orderkey AS sample_id, l_returnflag AS backend, CAST(l_quantity AS BIGINT) AS score, CASE WHEN l_linestatus = 'F' THEN CAST(l_partkey AS VARCHAR) END AS positive FROM lineitem)), k AS (SELECT sample_id, backend, arg_max(score, (file, place, score)) AS score FROM c GROUP BY ALL), p AS (SELECT sample_id, arg_min(positive, (file, place, positive)) AS positive FROM c WHERE positive IS NOT NULL GROUP BY 1) SELECT k.sample_id, backend, score, positive FROM k LEFT JOIN p ON p.sample_id = k.sample_id")
def cache_union_last_wins(t: Tables):
    from rankloom.sources.results import union_caches

    rows = t("lineitem").select(F.col("l_linenumber").alias("file"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("place0"), F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("backend"), F.col("l_quantity").cast("long").alias("score"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("string")).alias("positive_business_id"))
    rows = rows.withColumn("place", F.struct("place0", "score", F.coalesce("positive_business_id", F.lit("")))).drop("place0")
    return union_caches(rows).select("sample_id", "backend", "score", F.col("positive_business_id").alias("positive"))


@query(f"WITH {CANDIDATES} SELECT user_id, array_to_string(list(p_name || '/' || p_type ORDER BY slot), ';') AS candidates FROM lists JOIN part ON p_partkey = item_id GROUP BY user_id")
def candidate_projection(t: Tables):
    lists = samples.candidate_lists(t.visits(), VISIT_ORDER, t.n_items())
    meta = t("part").select(F.col("p_partkey").alias("item_id"), F.concat_ws("/", "p_name", "p_type").alias("shown"))
    rows = lists.join(meta, "item_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("slot", "shown"))).alias("c"))
    return rows.select("user_id", F.array_join(F.transform("c", lambda x: x["shown"]), ";").alias("candidates"))


@query("SELECT l_returnflag AS grp, array_to_string(list(l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), ',') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 5 GROUP BY 1")
def examples_per_bucket(t: Tables):
    rows = t("lineitem").select(F.col("l_returnflag").alias("grp"), "l_orderkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    return validation.examples(rows, "grp", "l_orderkey", "place")
