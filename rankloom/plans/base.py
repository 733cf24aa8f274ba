"""The domain on the test tables, once for Spark and once for SQL, and the registry of queries.

visits: orders with their lines.  rankings: each order is a sample of ten slots
with a teacher's and a student's order of them, from hashes.  verdicts and
latencies: events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.ranks import SLOTS, int_, slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines' results have one schema."""
    wide = {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))}
    return df.withColumns(wide) if wide else df


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


VISIT_ORDER = ["order_key", "line", "item_id", "supplier", "quantity", "shipped"]

VISITS = """visits AS (SELECT o_custkey AS user_id, l_partkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS date, l_orderkey AS order_key,
  l_linenumber AS line, l_suppkey AS supplier, l_quantity AS quantity, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RECENT = VISITS + """, recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, order_key DESC, line DESC, item_id DESC, supplier DESC, quantity DESC, shipped DESC) AS recency,
  count(*) OVER (PARTITION BY user_id) AS n_visits FROM visits)"""
CANDIDATES = RECENT + """, pos AS (SELECT user_id, item_id FROM recent WHERE recency = 1 AND n_visits >= 8),
draws AS (SELECT user_id, j, CAST('0x' || md5('n:' || user_id || ':' || j)[1:8] AS BIGINT) % (SELECT count(*) FROM part) AS item_id FROM pos, (SELECT unnest(range(0, 64)) AS j)),
neg AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS rn FROM (SELECT user_id, item_id, min(j) AS j FROM draws GROUP BY ALL) d
        WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.user_id = d.user_id AND v.item_id = d.item_id)),
drawn AS (SELECT user_id, item_id FROM neg WHERE rn <= 9),
short AS (SELECT p.user_id, count(d.item_id) AS have FROM pos p LEFT JOIN drawn d ON d.user_id = p.user_id GROUP BY 1 HAVING count(d.item_id) < 9),
rest AS (SELECT s.user_id, i AS item_id, have, row_number() OVER (PARTITION BY s.user_id ORDER BY md5('r:' || s.user_id || ':' || i), i) AS rn FROM short s, range(0, (SELECT count(*) FROM part)) x(i)
         WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.user_id = s.user_id AND v.item_id = i) AND NOT EXISTS (SELECT 1 FROM drawn d WHERE d.user_id = s.user_id AND d.item_id = i)),
negs AS (SELECT user_id, item_id FROM drawn UNION ALL SELECT user_id, item_id FROM rest WHERE rn <= 9 - have),
cand AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('s:' || user_id || ':' || item_id), item_id) AS slot, count(*) OVER (PARTITION BY user_id) AS n
         FROM (SELECT user_id, item_id, true AS is_positive FROM pos UNION ALL SELECT user_id, item_id, false FROM negs)),
lists AS (SELECT user_id, slot, item_id, is_positive FROM cand WHERE n = 10)"""
RANKS = """rk AS (SELECT o_orderkey AS sample_id, o_custkey AS user_id, o_orderpriority AS model, o_orderstatus AS pass, nullif((o_orderkey * 31 + o_custkey * 17) % 11, 0) AS gt, slot,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('t:' || o_orderkey || ':' || slot)) AS t, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('s:' || o_orderkey || ':' || slot)) AS s,
  o_orderkey % 7 <> 0 AS parsed FROM orders, (SELECT unnest(range(1, 11)) AS slot))"""
VERDICTS = """verdicts AS (SELECT event_id // 4 AS sample_id, ['base', 'p1', 'p2', 'p3'][1 + event_id % 4] AS arm, 1 + (event_id * 37 + user_id) % 10 AS groundedness, 1 + (event_id * 53 + user_id * 3) % 10 AS personalization,
  1 + (event_id * 71 + user_id * 7) % 10 AS ranking_coherence, CASE WHEN event_type = 'error' THEN 'json decode failed' END AS error, value, user_id FROM events)"""
LONG_VERDICTS = VERDICTS + """, axes AS (SELECT sample_id, arm, error, unnest(['groundedness', 'personalization', 'ranking_coherence']) AS axis, unnest([groundedness, personalization, ranking_coherence]) AS score FROM verdicts),
deltas AS (SELECT p.arm AS probe, p.axis, p.sample_id, CAST(p.score - b.score AS DOUBLE) AS delta FROM axes p JOIN axes b ON b.sample_id = p.sample_id AND b.axis = p.axis AND b.arm = 'base' AND b.error IS NULL WHERE p.arm <> 'base' AND p.error IS NULL)"""
LATENCY = """lat AS (SELECT event_type AS backend, event_id AS run_id, value AS latency_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, event_id % 17 <> 0 AS success FROM events),
ok AS (SELECT *, latency_ms / greatest(1, tokens) AS per_token FROM lat WHERE success)"""


def simpson(density: str, end: str, n: int = 4000) -> str:
    """SQL of the integral of a density of t from 0 to end: tails that SQL has no function for."""
    return f"(SELECT sum(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) * any_value(h) / 3 FROM (SELECT i, ({end}) / {n} AS h, ({end}) * i / {n} AS t FROM range(0, {n + 1}) ticks(i)))"


def chi2_tail_sql(x: str, df: int, most: int = 100) -> str:
    """SQL of the tail of a chi-square variable; beyond ``most`` it has to be nothing."""
    return f"(1 - {simpson(f'pow(t, {df / 2 - 1}) * exp(-t / 2) / (pow(2, {df / 2}) * gamma({df / 2}))', f'least({x}, {most})')})"


class Tables:
    """Tables of one folder, and the domain's views of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def visits(self) -> DataFrame:
        lines = self("lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("shipped"))
        orders = self("orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
        return lines.join(orders, F.col("l_orderkey") == F.col("order_key")).drop("l_orderkey")

    def n_items(self) -> int:
        return self("part").count()

    def rankings(self) -> DataFrame:
        """sample_id, user_id, model, pass, gt, teacher, student (NULL if unparsed), candidates."""
        order = lambda kind: F.transform(F.array_sort(F.transform(slots(), lambda s: F.struct(F.md5(F.concat(F.lit(f"{kind}:"), F.col("o_orderkey").cast("string"), F.lit(":"), s.cast("string")).cast("binary")).alias("h"), s.alias("s")))), lambda x: x["s"])
        key = F.col("o_orderkey")
        return self("orders").select(
            key.alias("sample_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("pass"),
            F.nullif((key * 31 + F.col("o_custkey") * 17) % 11, F.lit(0).cast("long")).cast("int").alias("gt"), order("t").alias("teacher"),
            F.when(key % 7 != 0, order("s")).alias("student"), order("s").alias("full_student"), F.transform(slots(), lambda s: key * 10 + s).alias("candidates"))

    def verdicts(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        return self("events").select(
            F.floor(e / 4).alias("sample_id"), F.element_at(F.array(*map(F.lit, ["base", "p1", "p2", "p3"])), (1 + e % 4).cast("int")).alias("arm"), (1 + (e * 37 + u) % 10).alias("groundedness"),
            (1 + (e * 53 + u * 3) % 10).alias("personalization"), (1 + (e * 71 + u * 7) % 10).alias("ranking_coherence"), F.when(F.col("event_type") == "error", "json decode failed").alias("error"), "value", "user_id", "event_id")

    def latencies(self) -> DataFrame:
        tokens = F.get_json_object("props", "$.k").cast("long")
        return self("events").select(F.col("event_type").alias("backend"), F.col("event_id").alias("run_id"), F.col("value").alias("latency_ms"), tokens.alias("tokens"), (F.col("event_id") % 17 != 0).alias("success"), (F.col("value") / F.greatest(F.lit(1).cast("long"), tokens)).alias("per_token"))


def reverse_student(t: Tables) -> DataFrame:
    """Rankings with the student's second pass seen through the reversed slots, and put back."""
    return t.rankings().withColumn("shown", F.transform("full_student", lambda x: int_(SLOTS + 1) - x))
