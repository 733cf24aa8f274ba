"""Queries on model output: parsing, validation, migration, rendering, perturbation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import parsing, ranks, schemas, text
from rankloom.functions.ranks import SLOTS
from rankloom.operators import perturb, samples, validation as v

from .base import RANKS, Tables, query

# --- records with planted defects -------------------------------------------------
# orders by key modulo 12: one defect each, in the order of the rules; 11 is whole

DEFECT = "o_orderkey % 12"
CODES = {0: v.NO_SAMPLE, 1: v.NO_OUTPUT, 2: f"{v.MISSING}:persona", 3: v.EMPTY_PERSONA, 4: f"{v.MISSING}:rationales", 5: f"{v.MISSING}:rationale.candidate_index", 6: v.EMPTY_RATIONALE, 7: f"{v.MISSING}:ranking", 8: v.RATIONALE_MISMATCH, 9: v.RANKING_MISMATCH, 10: v.RANKING_DUPLICATE}
CODE_SQL = "CASE " + DEFECT + " " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in CODES.items()) + " END"


def records(t: Tables):
    """sample_id, known, output: whole records and eleven kinds of broken ones."""
    r, d = t.rankings(), F.col("sample_id") % 12
    index = lambda s: F.when((d == 5) & (s == 4), F.lit(None)).when((d == 8) & (s == 10), F.lit(9)).otherwise(s).cast("int")
    reason = lambda s: F.when((d == 6) & (s == 7), " \n").otherwise(F.concat(F.lit("because "), s.cast("string")))
    rationales = F.when(d != 4, F.transform(ranks.slots(), lambda s: F.struct(index(s).alias("candidate_index"), reason(s).alias("reason"))))
    ranking = F.when(d == 7, F.lit(None)).when(d == 9, F.concat(F.slice("teacher", 1, 9), F.array(F.lit(99)))).when(d == 10, F.concat("teacher", F.slice("teacher", 1, 1))).otherwise(F.col("teacher"))
    persona = F.when(d == 3, "  ").when(d != 2, "likes rings")
    output = F.when(d != 1, F.struct(persona.alias("persona"), rationales.alias("rationales"), ranking.cast("array<int>").alias("ranking")))
    return r.select("sample_id", (d != 0).alias("known"), output.alias("output"))


@query(f"SELECT o_orderkey AS sample_id, {CODE_SQL} AS error FROM orders")
def validate_records(t: Tables):
    return records(t).select("sample_id", v.fault(F.col("output"), F.lit(10), F.col("known")).alias("error"))


@query(f"SELECT coalesce(split_part({CODE_SQL}, ':', 1), 'ok') AS bucket, count(*) AS n FROM orders GROUP BY 1")
def validation_stats(t: Tables):
    e = records(t).select(v.fault(F.col("output"), F.lit(10), F.col("known")).alias("error"))
    return e.groupBy(v.bucket(F.col("error")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH e AS (SELECT o_orderkey, coalesce(split_part({CODE_SQL}, ':', 1), 'ok') AS bucket FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_orderkey) AS rn FROM e) SELECT bucket, array_to_string(list(o_orderkey ORDER BY rn), ',') AS examples FROM r WHERE rn <= 5 GROUP BY 1")
def validation_examples(t: Tables):
    e = records(t).select("sample_id", v.bucket(v.fault(F.col("output"), F.lit(10), F.col("known"))).alias("bucket"))
    return v.examples(e, "bucket", "sample_id", "sample_id")


# --- migration: orders by key modulo 8 ---------------------------------------------

OUTCOME_SQL = "CASE o_orderkey % 8 WHEN 0 THEN 'passthrough_error' WHEN 1 THEN 'already_new' WHEN 7 THEN 'migrated' ELSE 'migration_failed' END"
WHY_SQL = "CASE o_orderkey % 8 WHEN 0 THEN 'http' WHEN 2 THEN 'migration_failed:no_sample' WHEN 3 THEN 'migration_failed:teacher_output_shape' WHEN 4 THEN 'migration_failed:duplicate_candidate_id' WHEN 5 THEN 'migration_failed:rationale_id_not_in_candidates' WHEN 6 THEN 'migration_failed:ranking_id_not_in_candidates' END"


def legacy(t: Tables):
    r, d = t.rankings(), F.col("sample_id") % 8
    ids = F.transform("candidates", lambda c: F.concat(F.lit("b"), c.cast("string")))
    candidates = F.when(d == 4, F.concat(F.slice(ids, 1, 9), F.slice(ids, 1, 1))).otherwise(ids)
    named = F.transform(ids, lambda b: F.struct(F.when(d == 5, "nobody").otherwise(b).alias("business_id"), F.when(d == 1, F.lit(1)).cast("int").alias("candidate_index"), F.lit("why").alias("reason")))
    ranking = F.transform("teacher", lambda s: F.when(d == 6, "nobody").otherwise(F.get(ids, s - 1)))
    output = F.struct(F.when(d != 3, named).alias("rationales"), ranking.alias("ranking"))
    made = r.select("sample_id", output.alias("output"), candidates.alias("ids"))
    return v.migrate(made, "output", "ids", F.col("sample_id") % 8 != 2, F.when(F.col("sample_id") % 8 == 0, "http"))


@query(f"WITH {RANKS} SELECT sample_id, outcome, error, CASE WHEN outcome = 'migrated' THEN ranking END AS ranking FROM (SELECT o_orderkey AS sample_id, {OUTCOME_SQL} AS outcome, {WHY_SQL} AS error FROM orders) o JOIN (SELECT sample_id, array_to_string(list(slot ORDER BY t), ',') AS ranking FROM rk GROUP BY 1) USING (sample_id)")
def migrate_format(t: Tables):
    return legacy(t).select("sample_id", "outcome", "error", F.array_join("ranking", ",").alias("ranking"))


@query(f"SELECT {OUTCOME_SQL} AS outcome, {WHY_SQL} AS error, count(*) AS n FROM orders GROUP BY ALL")
def migration_stats(t: Tables):
    return legacy(t).groupBy("outcome", "error").agg(F.count("*").alias("n"))


# --- parsing ----------------------------------------------------------------------


def noisy(t: Tables):
    """sample_id, raw: a ranking as JSON, bare, fenced, amid text, cut short or wrong, by key modulo 6."""
    d = F.col("sample_id") % 6
    body = F.concat(F.lit('{"ranking": ['), F.array_join("teacher", ", "), F.lit("]}"))
    raw = F.when(d == 0, body).when(d == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(d == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked {maybe}")))
    raw = raw.when(d == 3, F.substring(body, 1, 20)).when(d == 4, F.replace(body, F.lit("10"), F.lit("99"))).otherwise(F.lit(None))
    return t.rankings().select("sample_id", "teacher", raw.alias("raw"))


@query(f"WITH {RANKS} SELECT sample_id, CASE WHEN sample_id % 6 <= 2 THEN array_to_string(list(slot ORDER BY t), ',') END AS ranking FROM rk GROUP BY sample_id")
def parse_json_ranking(t: Tables):
    return noisy(t).select("sample_id", F.array_join(parsing.parse_ranking("raw", F.lit(10)), ",").alias("ranking"))


@query(f"WITH {RANKS} SELECT sample_id, sample_id % 6 <= 2 AS json_parse_ok, CASE WHEN sample_id % 6 <= 2 THEN array_to_string(list(sample_id * 10 + slot ORDER BY t), ',') END AS ids FROM rk GROUP BY sample_id")
def summarize_output(t: Tables):
    r = noisy(t).join(t.rankings().select("sample_id", "candidates"), "sample_id").withColumn("r", parsing.parse_ranking("raw", F.lit(10)))
    return r.select("sample_id", F.col("r").isNotNull().alias("json_parse_ok"), F.array_join(ranks.pick_strict(F.col("candidates"), F.col("r")), ",").alias("ids"))


@query("SELECT event_id, props AS bare FROM events")
def strip_fence(t: Tables):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))
    return t("events").select("event_id", text.strip_fence(fenced).alias("bare"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 IN (0, 1) AS parsed FROM events")
def parse_model_output(t: Tables):
    """Whole answers: in a fence, bare, behind other text, in a list, cut short."""
    case = F.col("event_id") % 5
    raw = F.when(case == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(case == 1, F.col("props")).when(case == 2, F.concat(F.lit("Sure: "), "props")).when(case == 3, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.expr("substr(props, 1, length(props) - 1)"))
    out = parsing.model_output(raw, "k long")
    return t("events").select("event_id", out.alias("o")).select("event_id", "o.k", F.col("o").isNotNull().alias("parsed"))


@query("SELECT p_partkey, p_size AS first, NULL::BIGINT AS second, p_name AS untouched FROM part")
def coerce_indices(t: Tables):
    """Digits become numbers, other text stays as it is."""
    values = F.array(F.col("p_size").cast("string"), "p_name", F.lit(None).cast("string"))
    found = text.coerced(values)
    return t("part").select("p_partkey", found[0]["index"].alias("first"), found[1]["index"].alias("second"), found[1]["text"].alias("untouched"))


@query(f"""WITH {RANKS}, r AS (SELECT sample_id, array_to_string(list(slot ORDER BY t), ',') AS ranking, array_to_string(list('b' || (sample_id * 10 + slot) ORDER BY t), ',') AS ids FROM rk GROUP BY 1)
SELECT sample_id, 'http' AS backend, 'p' || sample_id AS positive_business_id, sample_id % 6 <= 2 AS json_parse_ok, CASE WHEN sample_id % 6 <= 2 THEN ranking END AS ranking, CASE WHEN sample_id % 6 <= 2 THEN ids END AS ids, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE sample_id % 50 END AS output_tokens FROM r WHERE sample_id % 5 <> 0 AND sample_id % 11 <> 0""")
def adapt_raw(t: Tables):
    """Raw records as cache rows: errors and samples that aren't known go, texts are read leniently."""
    from rankloom.sources.results import adapt_raw

    key = F.col("sample_id")
    raw = noisy(t).select("sample_id", F.when(key % 5 == 0, "http").when(key % 2 == 0, "").alias("error"), F.col("raw").alias("raw_response"), F.concat(F.lit("p"), key.cast("string")).alias("positive_business_id"), F.when(key % 3 != 0, (key % 50).cast("int")).alias("output_tokens"))
    known = t.rankings().filter("sample_id % 11 <> 0").select("sample_id", F.transform("candidates", lambda c: F.concat(F.lit("b"), c.cast("string"))).alias("ids"))
    found = adapt_raw(raw, known, "http")
    return found.select("sample_id", "backend", "positive_business_id", "json_parse_ok", F.array_join("parsed_ranking", ",").alias("ranking"), F.array_join("recovered_business_ids", ",").alias("ids"), "output_tokens")


# replies of a judge, by key modulo 9: whole, fenced, with a tail, without an axis, out of range, a score in quotes, evidence that isn't text, no JSON, a call that failed
REPLY_ERROR = "CASE event_id % 9 WHEN 2 THEN 'json decode failed' WHEN 3 THEN 'schema validation failed: ranking_coherence' WHEN 4 THEN 'schema validation failed: groundedness' WHEN 5 THEN 'schema validation failed: personalization' WHEN 6 THEN 'schema validation failed: groundedness' WHEN 7 THEN 'json decode failed' WHEN 8 THEN 'timeout' END"


@query(f"SELECT event_id, {REPLY_ERROR} AS error, CASE WHEN event_id % 9 < 2 THEN 1 + event_id % 10 END AS groundedness, CASE WHEN event_id % 9 < 2 THEN 1 + user_id % 10 END AS personalization, CASE WHEN event_id % 9 < 2 THEN 7::BIGINT END AS ranking_coherence, CASE WHEN event_id % 9 < 2 THEN 'saw ' || user_id END AS groundedness_evidence FROM events")
def verdict_records(t: Tables):
    d = F.col("event_id") % 9
    number = lambda c: c.cast("string")
    g = F.when(d == 4, "11").otherwise(number(1 + F.col("event_id") % 10))
    p = F.when(d == 5, F.concat(F.lit('"'), number(1 + F.col("user_id") % 10), F.lit('"'))).otherwise(number(1 + F.col("user_id") % 10))
    evidence = F.when(d == 6, number(F.col("user_id"))).otherwise(F.concat(F.lit('"saw '), number(F.col("user_id")), F.lit('"')))
    body = F.concat(F.lit('{"groundedness": '), g, F.lit(', "groundedness_evidence": '), evidence, F.lit(', "personalization": '), p, F.lit(', "personalization_evidence": "e"'), F.when(d == 3, "").otherwise(', "ranking_coherence": 7'), F.lit(', "ranking_coherence_evidence": "e"}'))
    reply = F.when(d == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(d == 2, F.concat(body, F.lit(" and more"))).when(d == 7, "I can't say").when(d < 7, body)
    made = t("events").select("event_id", reply.alias("reply"), F.when(d == 8, "timeout").alias("error"))
    found = v.verdict_records(made, ["groundedness", "personalization", "ranking_coherence"])
    return found.select("event_id", F.regexp_replace("error", "^(json decode failed).*", "$1").alias("error"), "groundedness", "personalization", "ranking_coherence", "groundedness_evidence")


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'schema validation failed: groundedness' WHEN event_id % 10 = 4 THEN 'schema validation failed: personalization' WHEN event_id % 10 = 5 THEN 'schema validation failed: ranking_coherence' END AS error FROM events")
def validate_verdicts(t: Tables):
    d = F.col("event_id") % 10
    rows = t("events").select(
        "event_id", F.when(d == 3, F.lit(11)).otherwise(F.lit(5)).alias("groundedness"), F.when(d != 4, F.lit(1)).alias("personalization"), F.lit(10).alias("ranking_coherence"),
        F.lit("e").alias("groundedness_evidence"), F.lit("e").alias("personalization_evidence"), F.when(d != 5, "e").alias("ranking_coherence_evidence"))
    return rows.select("event_id", v.verdict_fault(rows, ["groundedness", "personalization", "ranking_coherence"]).alias("error"))


@query(f"""WITH {RANKS}, s AS (SELECT sample_id, list(t ORDER BY slot) AS r FROM rk GROUP BY sample_id) SELECT sample_id, sample_id % 6 <> 1 AND sample_id % 6 <> 2 AND sample_id % 6 <> 4 AS matched FROM s""")
def schema_regex_match(t: Tables):
    """Rankings as JSON against the pattern of their schema: whole, one short, with a slot that isn't there, spaced, with text behind, whole again."""
    r = F.col("teacher").cast("array<string>")
    case = F.col("sample_id") % 6
    slots_ = F.when(case == 1, F.slice(r, 1, SLOTS - 1)).when(case == 2, F.transform(r, lambda x: F.when(x == "10", "11").otherwise(x))).otherwise(r)
    text = F.concat(F.lit('{"ranking": ['), F.array_join(slots_, ", "), F.lit("]}"))
    raw = F.when(case == 3, F.concat(F.lit("\n "), F.replace(text, F.lit(","), F.lit(" ,")), F.lit(" "))).when(case == 4, F.concat(text, F.lit(" ok"))).otherwise(text)
    return t.rankings().select("sample_id", raw.rlike(schemas.whole(schemas.ranking_schema(SLOTS, reasons=False))).alias("matched"))


# --- perturbations ----------------------------------------------------------------


PERTURBED_SQL = f"""WITH {RANKS}, s AS (SELECT sample_id, array_to_string(list(slot ORDER BY t), ', ') AS ranking, array_to_string(list(CASE WHEN slot < 10 THEN 'b' || (sample_id * 10 + slot) ELSE '-' END ORDER BY t), ',') AS ids,
 array_to_string(list('{{"candidate_index": ' || slot || ', "reason": "because ' || slot || '"}}' ORDER BY slot), ', ') AS rationales FROM rk WHERE sample_id % 4 <> 0 GROUP BY sample_id)
SELECT sample_id, 'teacher-p3-persona-replaced' AS backend, 'p3' AS perturbation_kind, '{{"persona": "{perturb.GENERIC_PERSONA}", "rationales": [' || rationales || '], "ranking": [' || ranking || ']}}' AS output_text, replace(ranking, ' ', '') AS ranking, ids FROM s"""


def output_cache(t: Tables):
    """Cached outputs; a quarter isn't JSON, or is none but for a tail."""
    key = F.col("sample_id")
    rationales = F.transform(ranks.slots(), lambda s: F.struct(s.alias("candidate_index"), F.concat(F.lit("because "), s.cast("string")).alias("reason")))
    body = F.to_json(F.struct(F.lit("likes rings").alias("persona"), rationales.alias("rationales"), F.col("teacher").alias("ranking")))
    output_text = F.when(key % 8 == 0, F.concat(body, F.lit(" tail"))).when(key % 8 == 4, F.lit("[1]")).otherwise(body)
    return t.rankings().select("sample_id", F.lit("p").alias("positive_business_id"), output_text.alias("output_text"))


def nine_candidates(t: Tables):
    return t.rankings().select("sample_id", F.transform(F.slice("candidates", 1, 9), lambda c: F.concat(F.lit("b"), c.cast("string"))).alias("ids"))


@query(PERTURBED_SQL)
def perturb_p3(t: Tables):
    """A cache whose personas fit anyone; ids follow from the ranking, a slot without a candidate gives none."""
    found = perturb.perturbed_cache(output_cache(t), nine_candidates(t), "p3")
    return found.select("sample_id", "backend", "perturbation_kind", "output_text", F.array_join("parsed_ranking", ",").alias("ranking"), F.array_join("recovered_business_ids", ",", "-").alias("ids"))


@query(f"""WITH {RANKS} SELECT sample_id, k AS kind, 'likes rings' AS persona, CASE WHEN k = 'p2' THEN array_to_string(list(slot ORDER BY t), ',') ELSE array_to_string(list(slot ORDER BY slot), ',') END AS ranking_as_set, 10::BIGINT AS n_reasons, CASE WHEN k = 'p1' THEN 10 ELSE 0 END AS n_own_reason, k = 'p1' AS ranking_moved
FROM rk, (VALUES ('p1'), ('p2')) x(k) WHERE sample_id % 4 <> 0 GROUP BY sample_id, k""")
def perturbed_caches(t: Tables):
    """The seeded perturbations through the registry: what each leaves alone, and that the rest moved."""
    both = perturb.perturbed_cache(output_cache(t), nine_candidates(t), ["p1", "p2"])
    c = both.withColumn("o", F.from_json("output_text", perturb.OUTPUT)).join(t.rankings().select("sample_id", "teacher"), "sample_id")
    same = F.size(F.filter("o.rationales", lambda r: r["reason"] == F.concat(F.lit("because "), r["candidate_index"].cast("string"))))
    order = F.when(F.col("perturbation_kind") == "p2", F.col("o.ranking")).otherwise(F.array_sort("o.ranking"))
    return c.select("sample_id", F.col("perturbation_kind").alias("kind"), "o.persona", F.array_join(order, ",").alias("ranking_as_set"), F.size(F.array_distinct(F.transform("o.rationales", lambda r: r["reason"]))).alias("n_reasons"), same.alias("n_own_reason"), (F.col("o.ranking") != F.col("teacher")).alias("ranking_moved"))


@query("SELECT o_orderkey AS sample_id, array_to_string(list('r' || (1 + (slot + 1 + CAST(('0x' || md5('p2:' || o_orderkey)[1:8]) AS BIGINT) % 9 - 1) % 10) ORDER BY slot), ',') AS reasons FROM orders, (SELECT unnest(range(1, 11)) AS slot) GROUP BY 1")
def perturb_p2_rotation(t: Tables):
    """Reasons turned by 1 to 9 places from a hash: no reason stays at its slot."""
    turn = samples.draw(9, F.lit("p2"), "sample_id") + 1
    reasons = F.transform(ranks.slots(), lambda s: F.concat(F.lit("r"), (1 + (s - 1 + turn) % 10).cast("string")))
    return t.rankings().select("sample_id", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT o_orderkey AS sample_id, true AS is_permutation, true AS moved, 0::BIGINT AS n_fixed FROM orders")
def perturb_p1_p2_properties(t: Tables):
    """The seeded shuffles: a ranking stays a permutation and changes; of the reasons none keeps its place."""
    key = F.col("sample_id")
    reasons = F.transform(ranks.slots(), lambda s: F.concat(F.lit("r"), s.cast("string")))
    r = t.rankings().select("sample_id", "teacher", parsing.shuffled_ranking("teacher", samples.perturb_seed("ranking_shuffled", key)).alias("p1"), reasons.alias("reasons"), parsing.deranged(reasons, samples.perturb_seed("rationales_shuffled", key)).alias("p2"))
    fixed = F.size(F.filter(F.arrays_zip("reasons", "p2"), lambda x: x["reasons"] == x["p2"]))
    return r.select("sample_id", ranks.is_permutation(F.col("p1")).alias("is_permutation"), (F.col("p1") != F.col("teacher")).alias("moved"), fixed.alias("n_fixed"))


# --- rendering ----------------------------------------------------------------------

# the pattern is every character that Python's str.split takes for white space
WHITE = "[\\t\\n\\v\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g')) AS line FROM documents) SELECT doc_id, CASE WHEN length(line) <= 200 THEN line ELSE rtrim(line[1:200]) || '…' END AS snippet FROM s")
def snippet_truncate(t: Tables):
    return t("documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


HISTORY_SQL = """'. ' || p_name || ' [' || p_type || '] user_rating=' || CAST(round_even(p_size / 10.0, 0) AS BIGINT) || '/5 review="' || p_brand || '"'"""
CANDIDATE_SQL = """'. ' || p_name || ' [' || p_type || '] avg_rating=' || printf('%.1f', p_size / 8.0) || '/5 attrs=(' || CASE WHEN p_size % 2 = 0 THEN 'NoiseLevel=' || p_brand ELSE '—' END || ')'"""


def history_column():
    return text.history_line(F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_size") / 10.0, F.col("p_brand"))


def candidate_column():
    attributes = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("NoiseLevel"), "p_brand", F.lit("Other"), F.lit("x"))).otherwise(F.create_map(F.lit("Other"), F.lit("x")))
    return text.candidate_line(F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_size") / 8.0, attributes)


@query(f"SELECT p_partkey, p_partkey || {HISTORY_SQL} AS line FROM part")
def render_history(t: Tables):
    return t("part").select("p_partkey", history_column().alias("line"))


@query(f"SELECT p_partkey, p_partkey || {CANDIDATE_SQL} AS line FROM part")
def render_candidates(t: Tables):
    return t("part").select("p_partkey", candidate_column().alias("line"))


PROMPT_SQL = f"'History (1):' || chr(10) || p_partkey || {HISTORY_SQL} || chr(10) || chr(10) || 'Candidates (' || (CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END) || '):' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '(none)' ELSE p_partkey || {CANDIDATE_SQL} END"


def prompts(t: Tables):
    candidates = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(candidate_column()))
    return t("part").select("p_partkey", "p_brand", text.user_prompt(F.array(history_column()), candidates).alias("prompt"))


@query(f"SELECT p_partkey, {PROMPT_SQL} AS prompt FROM part")
def render_prompt(t: Tables):
    return prompts(t).select("p_partkey", "prompt")


@query(f"SELECT p_partkey, '<|im_start|>system' || chr(10) || 'Rank them.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {PROMPT_SQL} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chatml FROM part")
def chatml_render(t: Tables):
    return prompts(t).select("p_partkey", text.chatml(text.chat_messages(F.lit("Rank them."), F.col("prompt"))).alias("chatml"))


@query("SELECT p_partkey, 3::BIGINT AS n_messages, 'system,user,assistant' AS roles, p_brand AS answer FROM part")
def chat_messages(t: Tables):
    m = text.chat_messages(F.lit("Rank them."), F.col("prompt"), F.col("p_brand"))
    return prompts(t).select("p_partkey", F.size(m).alias("n_messages"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.get(m, F.lit(2))["content"].alias("answer"))


@query(f"SELECT p_partkey, {PROMPT_SQL} AS last_prompt, p_brand AS completion FROM part")
def prompt_completion(t: Tables):
    pc = text.prompt_completion(F.lit("Rank them."), F.col("prompt"), F.col("p_brand"))
    return prompts(t).select("p_partkey", F.get(pc["prompt"], F.lit(1))["content"].alias("last_prompt"), F.get(pc["completion"], F.lit(0))["content"].alias("completion"))


@query(f"WITH {RANKS} SELECT sample_id, 'Persona: (none)' || chr(10) || 'Rationales:' || chr(10) || array_to_string(list('  ' || slot || '. because ' || slot ORDER BY slot), chr(10)) || chr(10) || 'Ranking: ' || array_to_string(list(slot ORDER BY t), ', ') AS prompt FROM rk GROUP BY sample_id")
def render_judge_prompt(t: Tables):
    reasons = F.reverse(F.transform(ranks.slots(), lambda s: F.struct(s.alias("candidate_index"), F.concat(F.lit(" because "), s.cast("string"), F.lit("\n")).alias("reason"))))
    return t.rankings().select("sample_id", text.judge_prompt(F.lit(None).cast("string"), reasons, F.col("teacher")).alias("prompt"))


@query("""SELECT p_partkey, '{' || chr(10) || '  "persona": "' || p_name || '",' || chr(10) || '  "ranking": [' || chr(10) || '    ' || p_size || chr(10) || '  ]' || chr(10) || '}' AS assistant FROM part""")
def assistant_text(t: Tables):
    body = F.to_json(F.struct(F.col("p_name").alias("persona"), F.array("p_size").alias("ranking")))
    return t("part").select("p_partkey", parsing.pretty_json(body).alias("assistant"))


TAGS = ["v2-sft", "v2-sft-w4a16", "v2-gkd-warm-nf4", "teacher-qwen35", "v1-merged", "base-x", "merged", "nf4-smoke", "v1-nf4", "v3-merged-smoke", "odd"]
TAG_SQL = """SELECT i, tag, CASE WHEN tag LIKE 'teacher%' THEN 'teacher' WHEN tag LIKE 'base%' THEN 'base' WHEN tag LIKE 'v1%' THEN 'v1' WHEN tag IN ('merged', 'w4a16', 'nf4', 'gguf-q4km') OR tag LIKE '%-smoke' THEN 'v0-legacy' ELSE regexp_replace(tag, '-(w4a16|nf4|gguf-q4km)$', '') END AS recipe,
CASE WHEN tag LIKE 'teacher%' THEN 'n/a' WHEN tag LIKE 'base%' THEN 'fp16' WHEN tag LIKE 'v1%' OR NOT (tag IN ('merged', 'w4a16', 'nf4', 'gguf-q4km') OR tag LIKE '%-smoke') THEN coalesce(nullif(regexp_extract(tag, '-(w4a16|nf4|gguf-q4km)$', 1), ''), 'fp16') WHEN tag LIKE '%merged' THEN 'fp16' ELSE replace(tag, '-smoke', '') END AS quant
FROM (SELECT p_partkey AS i, """ + str(TAGS) + f"[1 + p_partkey % {len(TAGS)}] AS tag FROM part)"


def tagged(t: Tables):
    tag = F.get(F.array(*map(F.lit, TAGS)), (F.col("p_partkey") % len(TAGS)).cast("int"))
    return t("part").select(F.col("p_partkey").alias("i"), tag.alias("tag")).withColumn("c", text.classify_tag(F.col("tag"))).select("i", "tag", "c.recipe", "c.quant")


@query(TAG_SQL)
def classify_tag(t: Tables):
    return tagged(t)


@query(f"WITH c AS ({TAG_SQL}), r AS (SELECT DISTINCT tag, recipe, quant FROM c) SELECT tag, row_number() OVER (ORDER BY coalesce(list_position({text.RECIPE_ORDER}, recipe) - 1, 99), coalesce(list_position({text.QUANT_ORDER}, quant) - 1, 99), tag) AS place FROM r")
def comparison_sort(t: Tables):
    """Recipes, then quantizations in their fixed order, unlisted ones last: one row a run."""
    from pyspark.sql import Window

    r = tagged(t).select("tag", "recipe", "quant").distinct()
    w = Window.orderBy(text.place_in(text.RECIPE_ORDER, F.col("recipe")), text.place_in(text.QUANT_ORDER, F.col("quant")), "tag")
    return r.select("tag", F.row_number().over(w).alias("place"))


@query(f"WITH {RANKS} SELECT sample_id, count(*) AS n, array_to_string(list(slot || ':' || t ORDER BY slot), ',') AS rationales FROM rk WHERE t % 4 <> 0 GROUP BY sample_id")
def rationale_order(t: Tables):
    """Rationales written in the ranking's order come out by index; entries without one go."""
    place = lambda s: F.array_position("teacher", s).cast("int")
    given = F.transform("teacher", lambda s: F.struct(F.when(place(s) % 4 != 0, s).alias("candidate_index"), place(s).cast("string").alias("reason")))
    kept = text.by_index(given)
    return t.rankings().select("sample_id", F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda r: F.concat_ws(":", r["candidate_index"].cast("string"), r["reason"])), ",").alias("rationales"))


@query(f"WITH {RANKS} SELECT sample_id, array_to_string(list('c' || slot ORDER BY slot), ',') AS choices FROM rk GROUP BY sample_id")
def ordered_choices(t: Tables):
    choices = F.transform("full_student", lambda s: F.struct(F.concat(F.lit("c"), s.cast("string")).alias("text"), s.alias("index")))
    return t.rankings().select("sample_id", F.array_join(F.transform(text.ordered_choices(choices), lambda c: c["text"]), ",").alias("choices"))


TASK_SQL = " || ".join(["'" + text.USER_TEMPLATE[0].replace("'", "''") + "1" + text.USER_TEMPLATE[1] + "'", "p_partkey", HISTORY_SQL, "'" + text.USER_TEMPLATE[2] + "'", "(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END)", "'" + text.USER_TEMPLATE[3] + "'", f"CASE WHEN p_size % 3 = 0 THEN '(none)' ELSE p_partkey || {CANDIDATE_SQL} END", "'" + text.USER_TEMPLATE[4].replace("'", "''") + "'"])


def task_prompts(t: Tables):
    candidates = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(candidate_column()))
    return t("part").select("p_partkey", "p_brand", text.task_prompt(F.array(history_column()), candidates).alias("prompt"))


@query(f"SELECT p_partkey, {TASK_SQL} AS prompt, greatest(1, length({TASK_SQL}) // 4) AS tokens FROM part")
def task_prompt(t: Tables):
    """The user's turn in full, and its tokens by length."""
    return task_prompts(t).select("p_partkey", "prompt", text.token_estimate(F.col("prompt")).alias("tokens"))


@query(f"SELECT 'k' || p_partkey AS task_id, p_partkey AS user_id, p_brand AS positive_business_id, {TASK_SQL} AS prompt, 0.5::DOUBLE AS temperature FROM part")
def batch_prompts(t: Tables):
    config = F.struct(F.lit(0.5).alias("temperature"))
    made = task_prompts(t).select(text.batch_prompt(F.col("prompt"), config, F.concat(F.lit("k"), F.col("p_partkey").cast("string")), F.col("p_partkey"), F.col("p_brand")).alias("b"))
    return made.select("b.metadata.task_id", "b.metadata.user_id", "b.metadata.positive_business_id", "b.prompt", "b.generation_config.temperature")


@query("SELECT event_id, ((event_id % 97) * 1.0)::DOUBLE AS score FROM events")
def scorer_boundary(t: Tables):
    """The model boundary: batches go through mapInPandas to a scorer; the stub here needs no network."""
    from rankloom.operators.scorer import scored, stub

    return scored(t("events").select("event_id"), stub, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("score", T.DoubleType())]))
