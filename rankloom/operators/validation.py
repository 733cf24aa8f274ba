"""Validation and migration of structured model output; the first rule that fails names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.parsing import json_fault
from rankloom.functions.text import strip_fence, stripped

# Error codes, kept stable for filters.
NO_OUTPUT, MISSING, EMPTY_PERSONA, EMPTY_RATIONALE = "no_teacher_output", "missing_field", "empty_persona", "empty_rationale"
RATIONALE_MISMATCH, RANKING_MISMATCH, RANKING_DUPLICATE, NO_SAMPLE = "rationale_id_mismatch", "ranking_id_mismatch", "ranking_duplicate", "sample_not_found"


def blank(c: Column) -> Column:
    return c.isNull() | (stripped(c) == "")


def set_is(values: Column, n: Column) -> Column:
    """The distinct values are exactly 1..n (none for n = 0)."""
    return F.array_sort(F.array_distinct(values)) == F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def fault(output: Column, n_candidates: Column, known: Column) -> Column:
    """Code of the first rule that an output breaks, NULL if it breaks none.

    output: struct(persona, rationales array<struct(candidate_index int,
    reason)>, ranking array<int>); fields that were missing or of another type
    are NULL, as from_json leaves them.  known: the sample exists.
    """
    rationales, ranking = output["rationales"], output["ranking"]
    # rules on one entry hold in the order of entries, each entry's in turn
    entry = lambda r: F.when(r.isNull(), F.lit(f"{MISSING}:rationale_entry")).when(r["candidate_index"].isNull(), F.lit(f"{MISSING}:rationale.candidate_index")).when(blank(r["reason"]), F.lit(EMPTY_RATIONALE))
    first_entry = F.get(F.filter(F.transform(rationales, entry), lambda e: e.isNotNull()), F.lit(0))
    return (
        F.when(~known, NO_SAMPLE)
        .when(output.isNull(), NO_OUTPUT)
        .when(output["persona"].isNull(), f"{MISSING}:persona")
        .when(blank(output["persona"]), EMPTY_PERSONA)
        .when(rationales.isNull() | (F.size(rationales) < 1), f"{MISSING}:rationales")
        .when(first_entry.isNotNull(), first_entry)
        .when(ranking.isNull() | (F.size(ranking) < 1), f"{MISSING}:ranking")
        .when(F.exists(ranking, lambda x: x.isNull()), f"{MISSING}:ranking.entry")
        .when(~set_is(F.transform(rationales, lambda r: r["candidate_index"]), n_candidates), RATIONALE_MISMATCH)
        .when(~set_is(ranking, n_candidates), RANKING_MISMATCH)
        .when(F.size(ranking) != n_candidates, RANKING_DUPLICATE)
    )


def migrate(df: DataFrame, output: str, candidates: str, known: Column, error: Column) -> DataFrame:
    """Add outcome, error, rationales, ranking: identifiers to 1-based indices.

    output: struct(rationales array<struct(business_id, candidate_index,
    reason)>, ranking array<string>); candidates: array of identifiers.  Each
    identifier is looked up once; later rules read the places found.
    """
    out, ids = F.col(output), F.col(candidates)
    rationales, ranking = out["rationales"], out["ranking"]
    place = lambda x: F.coalesce(F.array_position(ids, x), F.lit(0).cast("long")).cast("int")
    placed = df.withColumns({"__r": F.transform(rationales, lambda r: place(r["business_id"])), "__k": F.transform(ranking, place)})
    new = F.coalesce(F.get(rationales, F.lit(0))["candidate_index"].isNotNull(), F.lit(False)) | F.coalesce(F.get(ranking, F.lit(0)).rlike("^[0-9]+$"), F.lit(False))
    bad_ids = (F.size(ids) < 1) | F.exists(ids, lambda c: F.coalesce(c == "", F.lit(True)))
    why = (
        F.when(out.isNull(), "migration_failed:teacher_output_shape")
        .when(F.col("__new"), F.lit(None))
        .when(~known, "migration_failed:no_sample")
        .when(rationales.isNull() | ranking.isNull(), "migration_failed:teacher_output_shape")
        .when(ids.isNull() | bad_ids, "migration_failed:no_candidates")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "migration_failed:duplicate_candidate_id")
        .when(F.array_contains("__r", 0), "migration_failed:rationale_id_not_in_candidates")
        .when(F.array_contains("__k", 0), "migration_failed:ranking_id_not_in_candidates")
    )
    judged = placed.withColumn("__new", new).withColumn("__why", why)
    outcome = F.when(error.isNotNull(), "passthrough_error").when(F.col("__why").isNotNull(), "migration_failed").when(F.col("__new"), "already_new").otherwise("migrated")
    moved = F.col("outcome") == "migrated"
    return judged.withColumn("outcome", outcome).withColumns({"error": F.coalesce(error, "__why"), "rationales": F.when(moved, F.col("__r")), "ranking": F.when(moved, F.col("__k"))}).drop("__r", "__k", "__new", "__why")


def verdict_fault(df: DataFrame, axes: list[str]) -> Column:
    """The first axis whose score isn't in 1..10 or whose evidence isn't text; NULL if all are right."""
    found = F.lit(None).cast("string")
    for a in reversed(axes):
        evidence = F.col(f"{a}_evidence").isNull() if f"{a}_evidence" in df.columns else F.lit(False)
        found = F.when(~F.coalesce(F.col(a).between(1, 10), F.lit(False)) | evidence, F.lit(f"schema validation failed: {a}")).otherwise(found)
    return found


def verdict_records(replies: DataFrame, axes: list[str], text: str = "reply", error: str = "error") -> DataFrame:
    """Verdict records from a judge's replies: the other columns, a score and evidence an axis, and error.

    The first that holds: the call's own error; "json decode failed" (a fence is
    stripped first; text behind the object counts); "schema validation failed"
    with the axis.  A score is a whole number in JSON, evidence is a JSON string;
    a record with an error has neither.
    """
    bare = strip_fence(F.coalesce(F.col(text), F.lit("")))
    parsed = replies.withColumn("__bare", bare).withColumns({"__wrong": json_fault("__bare"), "__v": F.try_parse_json("__bare")})

    def field(name: str, kind: str, json_kind: str) -> Column:
        found = F.try_variant_get(F.col("__v"), f"$.{name}", "variant")
        return F.when(F.schema_of_variant(found) == json_kind, F.try_variant_get(F.col("__v"), f"$.{name}", kind))

    fields = {a: field(a, "int", "BIGINT") for a in axes} | {f"{a}_evidence": field(f"{a}_evidence", "string", "STRING") for a in axes}
    named = parsed.withColumns(fields)
    decode = F.when(F.col("__wrong").isNotNull(), F.concat(F.lit("json decode failed: "), "__wrong"))
    judged = named.withColumn("__why", F.coalesce(F.col(error), decode, verdict_fault(named, axes)))
    ok = F.col("__why").isNull()
    return judged.withColumns({c: F.when(ok, F.col(c)) for c in fields} | {error: F.col("__why")}).drop("__bare", "__wrong", "__v", "__why", text)


def bucket(error: Column) -> Column:
    """An error code's part before the colon; "ok" for NULL."""
    return F.coalesce(F.substring_index(error, ":", 1), F.lit("ok"))


def examples(df: DataFrame, group: str, ident: str, order: str, n: int = 5) -> DataFrame:
    """group, examples: the first n identifiers of each group, joined by commas; the window drops the rest before anything is gathered."""
    w = Window.partitionBy(group).orderBy(order, ident)
    first = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(ident).cast("string").alias("i")))), lambda x: x["i"]), ",").alias("examples"))
