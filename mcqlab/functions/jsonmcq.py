"""Validation of generated MCQ objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("question", "option_a", "option_b", "option_c", "option_d", "correct_option")


def validated_mcq(text: Column) -> Column:
    """The struct of six strings, or null if the text is not one JSON object that has each as a string.

    ``from_json`` alone would turn numbers to strings and ignore what follows the
    object, so the text is parsed as the only element of an array.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))

    def is_string(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$[0].{name}", "variant")) == "STRING", F.lit(False))

    alone = F.try_variant_get(parsed, "$[1]", "variant").isNull()
    values = F.struct(*(F.try_variant_get(parsed, f"$[0].{name}", "string").alias(name) for name in FIELDS))
    return F.when(reduce(lambda a, b: a & b, map(is_string, FIELDS), alone), values)


def empty_mcq() -> Column:
    return F.struct(*(F.lit("").alias(name) for name in FIELDS))


def found_object(text: Column) -> Column:
    """The first balanced object in a text, out of fences or prose; one that is cut off is closed; null without a brace.

    Braces in strings don't count, and an escaped quote ends no string. Of a cut-off
    object, a dangling comma is dropped and an open string is closed where it ends.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}]|[^"\\{}]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def step(s: Column, t: Column) -> Column:
        opened, quote = s["depth"] > 0, t == '"'
        brace = F.when(s["quoted"], 0).when(t == "{", 1).when((t == "}") & opened, -1).otherwise(0)
        taken = ~s["done"] & (opened | (t == "{"))
        return F.struct(
            F.when(taken, s["depth"] + brace).otherwise(s["depth"]).alias("depth"), (F.when(taken & quote, ~s["quoted"]).otherwise(s["quoted"])).alias("quoted"),
            (s["done"] | (taken & (s["depth"] + brace == 0))).alias("done"), F.when(taken, F.concat(s["out"], t)).otherwise(s["out"]).alias("out"),
        )

    def end(s: Column) -> Column:
        body = F.when(s["quoted"], F.concat(s["out"], F.lit('"'))).otherwise(F.regexp_replace(s["out"], r"[\s,]+$", ""))
        return F.when(s["done"], s["out"]).when(s["depth"] > 0, F.concat(body, F.repeat(F.lit("}"), s["depth"])))

    return F.aggregate(tokens, start, step, end)


def tolerant_mcq(text: Column) -> Column:
    """``validated_mcq`` of a whole text, else of the first object in it."""
    return F.coalesce(validated_mcq(text), validated_mcq(found_object(text)))


def format_instructions(schema: dict) -> str:
    """What to tell a generator about the object that it is to answer with."""
    lines = [f'- "{name}" ({kind.get("type", "any")}){", required" if name in schema.get("required", ()) else ""}' for name, kind in schema["properties"].items()]
    return "\n".join(["Answer with one JSON object and nothing else. Its fields:", *lines])
