"""Parsing of model responses and stored JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

SKILLS = "array<string>"


def path(x: Column, at: str, default: str | None = None) -> Column:
    """JSON path to a plain value, with a default for what is missing; an object or an array gives an empty text; never an error."""
    found = F.get_json_object(x, at)
    if "[" not in at:
        # Only an unquoted bracket at the value's begin means a container, so the value is read with its quotes where it looks like one.
        parent, _, name = at.rpartition(".")
        holder = x if parent == "$" else F.get_json_object(x, parent)
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(holder), f"$.{name}", "variant"))
        found = F.when(found.rlike(r"^[\[{]"), F.when(kind == "STRING", found).otherwise("")).otherwise(found)
    return found if default is None else F.coalesce(found, F.lit(default))


def parse_skills(x: Column) -> Column:
    """Array of skills; null, empty or invalid JSON gives none."""
    return F.coalesce(F.from_json(x, SKILLS), F.array().cast(SKILLS))


def serialize_skills(x: Column) -> Column:
    """JSON text of an array of skills."""
    return F.to_json(x)


def positive_int(x: Column) -> Column:
    """Whole part of a number, or of a text that is one; null for 0, missing and other values."""
    return F.nullif(x.try_cast("double").try_cast("int"), F.lit(0))


def _text(x: Column) -> Column:
    """Text of a variant: an object or an array gives an empty text, null and missing null."""
    kind = F.schema_of_variant(x)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit("")).otherwise(F.try_variant_get(x, "$", "string"))


def gemini_content(x: Column) -> Column:
    return F.get_json_object(x, "$.candidates[0].content.parts[0].text")


def ollama_content(x: Column) -> Column:
    return blank_to_null(F.get_json_object(x, "$.message.content"))


def extraction(content: Column, model: Column | str) -> Column:
    """Struct of normalised fields of a response's content (JSON text); null if that is missing or not JSON.

    The content is parsed once. Missing enumerations become 'unknown', blank texts and zero salaries null; salaries are cut to whole
    numbers, also from texts; without any salary there is no currency. Objects and arrays in the place of a text are empty texts.
    """
    name = F.lit(model) if isinstance(model, str) else model

    def fields(v: Column) -> Column:
        at = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
        salary = lambda k: F.nullif(F.try_variant_get(v, f"$.salary_{k}", "double").try_cast("int"), F.lit(0))
        named = lambda k: F.coalesce(_text(at(k)), F.lit("unknown"))
        skills = F.transform(F.try_variant_get(v, "$.skills", "array<variant>"), lambda x: F.coalesce(_text(x), F.lit("null")))
        built = F.struct(
            blank_to_null(_text(at("summary"))).alias("summary"),
            F.coalesce(skills, F.array().cast(SKILLS)).alias("skills"),
            named("seniority").alias("seniority"),
            salary("min").alias("salary_min"),
            salary("max").alias("salary_max"),
            F.when(salary("min").isNotNull() | salary("max").isNotNull(), blank_to_null(_text(at("salary_currency")))).alias("salary_currency"),
            named("salary_period").alias("salary_period"),
            blank_to_null(_text(at("language_requirement"))).alias("language_requirement"),
            named("remote_policy").alias("remote_policy"),
            name.alias("extraction_model"),
        )
        return F.when(v.isNotNull(), built)

    return F.get(F.transform(F.array(F.try_parse_json(content)), fields), F.lit(0))


def with_fallback(primary: Column, secondary: Column) -> Column:
    """The first provider's extraction, or, where it failed, the second's; the model named is the one that answered."""
    return F.get(F.transform(F.array(primary), lambda x: F.coalesce(x, secondary)), F.lit(0))


def fit_score(response: Column) -> Column:
    """The judge's score, cut to a whole number; null where there is none."""
    return F.get_json_object(F.get_json_object(response, "$.message.content"), "$.fit_score").try_cast("double").try_cast("int")
