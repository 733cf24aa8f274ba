"""Text columns: snippets, prompts, chat forms and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes a candidate's line may show, in this order.
SHOWN_ATTRIBUTES = ["RestaurantsPriceRange2", "NoiseLevel", "RestaurantsAttire", "Ambience", "RestaurantsGoodForGroups", "GoodForKids"]
# Words that make a category list one of food places.
FOOD_KEYWORDS = ["restaurants", "food", "bars", "cafes", "coffee", "bakeries", "breakfast", "desserts", "nightlife", "ice cream", "tea", "pubs", "diners", "delis", "sandwiches", "pizza", "burgers", "seafood", "steakhouses", "sushi", "barbeque"]
# Order of recipes and of quantizations in comparisons.
RECIPE_ORDER = ["teacher", "base", "v0-legacy", "v1", "v2-sft", "v2-gkd-warm", "v2-gkd-cold"]
QUANT_ORDER = ["n/a", "fp16", "w4a16", "nf4", "gguf-q4km"]
#: Place of a recipe or quantization that isn't listed.
LAST = 99


# The characters that str.strip() and str.split() of Python take for white space, as a class of a regular expression.
WHITE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def holds_keyword(c: Column, keywords: list[str] | None = None) -> Column:
    """The text holds one of the keywords, whatever the case; false for NULL and empty."""
    found = F.lit(False)
    for k in keywords or FOOD_KEYWORDS:
        found = found | F.contains(F.lower(c), F.lit(k))
    return F.coalesce(found, F.lit(False))


def stripped(c: Column) -> Column:
    """Without white space at either end, of any kind; NULL gives an empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{WHITE}+|{WHITE}+$", "")


def snippet(c: Column, limit: int = 200) -> Column:
    """One line: white space (Unicode's too) collapsed, cut at the limit with an ellipsis; NULL gives an empty text."""
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WHITE}+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("…")))


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with ties to even, "?" for NULL."""
    return F.coalesce(F.regexp_replace(F.format_number(c, digits), ",", ""), F.lit("?"))


def history_line(i: Column, name: Column, categories: Column, stars: Column, review: Column) -> Column:
    text = F.replace(stripped(review), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(text) > 180, F.concat(F.rtrim(F.substring(text, 1, 180)), F.lit("…"))).otherwise(text)
    return F.concat(i.cast("string"), F.lit(". "), F.coalesce(name, F.lit("(unknown)")), F.lit(" ["), F.coalesce(categories, F.lit("")), F.lit("] user_rating="), fixed(stars, 0), F.lit('/5 review="'), short, F.lit('"'))


def candidate_line(i: Column, name: Column, categories: Column, stars: Column, attributes: Column) -> Column:
    """attributes: map of text; only SHOWN_ATTRIBUTES appear, a dash if none does."""
    keys = F.array(*map(F.lit, SHOWN_ATTRIBUTES))
    held = F.filter(keys, lambda k: F.coalesce(F.map_contains_key(attributes, k), F.lit(False)))
    shown = F.array_join(F.transform(held, lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(attributes, k), F.lit("None")))), ", ")
    return F.concat(i.cast("string"), F.lit(". "), F.coalesce(name, F.lit("(unknown)")), F.lit(" ["), F.coalesce(categories, F.lit("")), F.lit("] avg_rating="), fixed(stars, 1), F.lit("/5 attrs=("), F.when(shown == "", "—").otherwise(shown), F.lit(")"))


def block(lines: Column, none: str = "(none)") -> Column:
    """Lines of an array as one text; a word for none."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(none))


def user_prompt(history: Column, candidates: Column) -> Column:
    """Both numbered blocks under their headings."""
    return F.concat(
        F.lit("History ("), F.size(history).cast("string"), F.lit("):\n"), block(history),
        F.lit("\n\nCandidates ("), F.size(candidates).cast("string"), F.lit("):\n"), block(candidates))


# The template that models were trained on.
USER_TEMPLATE = (
    "Recommend places for one user based on the history and candidate list below.\n\n[USER VISIT HISTORY] (", " places, chronological)\n", "\n\n[CANDIDATE PLACES] (", " places)\n",
    "\n\nTask:\n1. Infer a concise 2-3 sentence persona capturing the user's preferences.\n2. For EACH candidate (by its number), write a 1-2 sentence rationale about fit.\n"
    "3. Produce a ranked list of candidate numbers (1-based) from best fit to worst fit.\n\nReturn valid JSON matching the provided schema. Do not add any other text.",
)


def task_prompt(history: Column, candidates: Column) -> Column:
    """The user's turn in full: both numbered blocks and the task."""
    n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("string")
    head, middle, between, places, task = map(F.lit, USER_TEMPLATE)
    return F.concat(head, n(history), middle, block(history), between, n(candidates), places, block(candidates), task)


def batch_prompt(prompt: Column, config: Column, task_id: Column, user_id: Column, positive: Column) -> Column:
    """struct(prompt, generation_config, metadata) of one request of a batch; the metadata comes back with its reply."""
    metadata = F.struct(task_id.alias("task_id"), user_id.alias("user_id"), positive.alias("positive_business_id"))
    return F.struct(prompt.alias("prompt"), config.alias("generation_config"), metadata.alias("metadata"))


def ordered_choices(choices: Column) -> Column:
    """A reply's choices (array of struct with index) by their index, whatever order they came in."""
    return F.array_sort(choices, lambda a, b: F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0))


def by_index(rationales: Column) -> Column:
    """Rationales (struct candidate_index, reason) by index; those without one go."""
    return F.array_sort(F.filter(rationales, lambda r: r["candidate_index"].isNotNull()))


def judge_prompt(persona: Column, rationales: Column, ranking: Column) -> Column:
    """A model's output for a judge: rationales (struct candidate_index, reason) by index, the ranking on one line."""
    lines = F.transform(by_index(rationales), lambda r: F.concat(F.lit("  "), r["candidate_index"].cast("string"), F.lit(". "), F.replace(stripped(r["reason"]), F.lit("\n"), F.lit(" "))))
    order = F.when(F.coalesce(F.size(ranking), F.lit(0)) > 0, F.array_join(ranking, ", ")).otherwise("(none)")
    return F.concat(F.lit("Persona: "), F.coalesce(persona, F.lit("(none)")), F.lit("\nRationales:\n"), block(lines, "  (none)"), F.lit("\nRanking: "), order)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turns = [message("system", system), message("user", user)]
    return F.array(*turns, *([message("assistant", assistant)] if assistant is not None else []))


def prompt_completion(system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(chat_messages(system, user).alias("prompt"), F.array(message("assistant", assistant)).alias("completion"))


def chatml(messages: Column, open_assistant: bool = True) -> Column:
    """Messages (struct role, content) as ChatML text; the assistant's turn is left open at the end if asked."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n" if open_assistant else ""))


# Suffixes of tags that name a quantization.
QUANT_SUFFIX = r"-(w4a16|nf4|gguf-q4km)$"


def classify_tag(tag: Column) -> Column:
    """struct(recipe, quant) of an evaluation tag."""
    suffix = F.regexp_extract(tag, QUANT_SUFFIX, 1)
    quant = F.when(suffix == "", "fp16").otherwise(suffix)
    legacy = tag.isin("merged", "w4a16", "nf4", "gguf-q4km") | tag.endswith("-smoke")
    pair = lambda r, q: F.struct(r.alias("recipe"), q.alias("quant"))
    return (
        F.when(tag.startswith("teacher"), pair(F.lit("teacher"), F.lit("n/a")))
        .when(tag.startswith("base"), pair(F.lit("base"), F.lit("fp16")))
        .when(tag.startswith("v1"), pair(F.lit("v1"), quant))
        .when(legacy & tag.endswith("merged"), pair(F.lit("v0-legacy"), F.lit("fp16")))
        .when(legacy, pair(F.lit("v0-legacy"), F.replace(tag, F.lit("-smoke"), F.lit(""))))
        .otherwise(pair(F.regexp_replace(tag, QUANT_SUFFIX, ""), quant))
    )


def place_in(order: list[str], c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(LAST))


def strip_fence(c: Column) -> Column:
    """Text without its markdown fence and a json tag in any case, only if it starts with one; else trimmed."""
    ends = lambda x: F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")
    t = ends(c)
    bare = F.regexp_replace(t, r"^`+|`+$", "")
    bare = F.regexp_replace(bare, rf"^(?i:json){WHITE}*", "")
    return F.when(t.startswith("```"), ends(bare)).otherwise(t)


def coerce_indices(values: Column) -> Column:
    """Array of text to array of long: all digits become numbers, anything else (and what no long holds) NULL; :func:`opaque` has the rest."""
    return F.transform(values, as_index)


def as_index(v: Column) -> Column:
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("long"))


def coerced(values: Column) -> Column:
    """Array of text to array of struct(index, text): digits as index, anything else untouched as text; NULL stays NULL."""
    return F.transform(values, lambda v: F.when(v.isNotNull(), F.struct(as_index(v).alias("index"), F.when(as_index(v).isNull(), v).alias("text"))))


def opaque(values: Column) -> Column:
    """The entries that are no index, untouched and in order."""
    return F.filter(values, lambda v: as_index(v).isNull())


def token_estimate(c: Column) -> Column:
    """A text's tokens where no tokenizer counted them: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))
