"""Controlled damage to model output, for checking that a judge notices: a registry of perturbations, and caches of their results.

An output is a struct(persona, rationales array<struct(candidate_index, reason)>,
ranking array<int>).  Each perturbation changes one part; draws come from a seed
that kind and sample fix.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import parsing, ranks
from rankloom.functions.text import by_index

from .samples import perturb_seed

OUTPUT = "persona string, rationales array<struct<candidate_index:int,reason:string>>, ranking array<int>"

# Tags of the perturbed outputs, and the persona that fits anyone.
TAGS = {"p1": "teacher-p1-ranking-shuffled", "p2": "teacher-p2-rationale-swapped", "p3": "teacher-p3-persona-replaced"}
GENERIC_PERSONA = "The user enjoys trying various restaurants and places, including different cuisines and casual dining spots."


class Perturbation(NamedTuple):
    tag: str
    apply: Callable[[Column, Column], Column]


REGISTRY: dict[str, Perturbation] = {}


def register(kind: str, tag: str):
    """Add a function (output, seed) -> output under its kind; seed is hexadecimal text."""

    def add(f: Callable[[Column, Column], Column]):
        REGISTRY[kind] = Perturbation(tag, f)
        return f

    return add


def output(persona: Column, rationales: Column, ranking: Column) -> Column:
    none = F.array().cast("array<struct<candidate_index:int,reason:string>>")
    return F.struct(F.coalesce(persona, F.lit("")).alias("persona"), F.coalesce(rationales, none).alias("rationales"), F.coalesce(ranking, F.array().cast("array<int>")).alias("ranking"))


@register("p1", TAGS["p1"])
def ranking_shuffled(out: Column, seed: Column) -> Column:
    """Another order of the ranking; one of fewer than two slots stays."""
    return output(out["persona"], out["rationales"], parsing.shuffled_ranking(out["ranking"], seed))


@register("p2", TAGS["p2"])
def rationales_swapped(out: Column, seed: Column) -> Column:
    """Reasons dealt anew by index, none at its own; entries without an index go; fewer than two rationales, or none with an index, stay."""
    known = by_index(out["rationales"])
    reasons = F.transform(known, lambda r: F.coalesce(r["reason"], F.lit("")))
    dealt = F.transform(F.arrays_zip(known.alias("r"), parsing.deranged(reasons, seed).alias("reason")), lambda x: F.struct(x["r"]["candidate_index"].alias("candidate_index"), x["reason"].alias("reason")))
    swapped = F.when((F.size(out["rationales"]) > 1) & (F.size(known) > 0), dealt).otherwise(out["rationales"])
    return output(out["persona"], swapped, out["ranking"])


@register("p3", TAGS["p3"])
def persona_replaced(out: Column, seed: Column) -> Column:
    return output(F.lit(GENERIC_PERSONA), out["rationales"], out["ranking"])


def perturbed_cache(cache: DataFrame, candidates: DataFrame, kind: str | list[str]) -> DataFrame:
    """Cache rows (sample_id, positive_business_id, output_text) after one perturbation, with the columns that follow from it.

    candidates: sample_id, ids (in the order shown); a sample without them
    recovers NULLs.  Rows without a sample_id go, and so do texts that aren't one
    strict JSON object, bare or in a fence.  A kind that isn't registered is an
    error.  Several kinds give each row once a kind, from texts parsed once.
    """
    kinds = [kind] if isinstance(kind, str) else list(kind)
    for k in kinds:
        if k not in REGISTRY:
            raise ValueError(f"no perturbation is called {k!r}")
    rows = cache.filter(F.coalesce(F.col("sample_id").cast("string"), F.lit("")) != "")
    rows = rows.withColumn("__bare", parsing.bare_object(F.col("output_text"))).filter("__bare IS NOT NULL").withColumn("__in", F.from_json("__bare", OUTPUT))
    applied = lambda k: REGISTRY[k].apply(F.col("__in"), perturb_seed(k, F.col("sample_id")))
    if len(kinds) == 1:
        made = rows.withColumns({"__out": applied(kinds[0]), "__kind": F.lit(kinds[0]), "__tag": F.lit(REGISTRY[kinds[0]].tag)})
    else:
        each = [F.struct(F.lit(k).alias("__kind"), F.lit(REGISTRY[k].tag).alias("__tag"), applied(k).alias("__out")) for k in kinds]
        made = rows.select("sample_id", "positive_business_id", F.inline(F.array(*each)))
    joined = made.join(candidates.select("sample_id", "ids"), "sample_id", "left")
    ids = F.coalesce("ids", F.array().cast(candidates.schema["ids"].dataType))
    return joined.select(
        "sample_id", "positive_business_id", parsing.plain_json(F.to_json("__out")).alias("output_text"), F.col("__out.ranking").alias("parsed_ranking"), ranks.pick(ids, F.col("__out.ranking")).alias("recovered_business_ids"),
        F.lit(True).alias("json_parse_ok"), F.lit(None).cast("int").alias("output_tokens"), F.col("__kind").alias("perturbation_kind"), F.col("__tag").alias("backend"))
