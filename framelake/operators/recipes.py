"""Recipes and parameters as rows of paths and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column) -> Column:
    """All paths that lead to a dotted path, itself last."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def deep_merge(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """``key, path, value`` of nested mappings merged leaf by leaf: an override replaces the same path, the whole branch below it, and a
    leaf that it lies below. Rows meet by equal paths only."""
    own = override.select(key, "path").distinct()
    leads = own.select(key, F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    kept = base.join(leads, [key, "path"], "left_anti")
    below = kept.select(key, "path", F.explode(prefixes(F.col("path"))).alias("__up")).join(own.withColumnRenamed("path", "__up"), [key, "__up"], "left_semi")
    return kept.join(below.select(key, "path"), [key, "path"], "left_anti").select(key, "path", "value").unionByName(override.select(key, "path", "value"))


def convert(value: Column, conversion: Column) -> Column:
    """A recipe's value on the scale of its control: fractions as percent, flags as 0 or 1, signed fractions as percent, others as they are."""
    return F.when(conversion == "percent", value * 100).when(conversion == "flag", F.when(value > 0, 1.0).otherwise(0.0)).when(conversion == "inverse", 1 - value).otherwise(value)


def resolved(params: DataFrame, recipes: DataFrame, values: DataFrame, overrides: DataFrame) -> DataFrame:
    """``recipe, name, value, origin`` of every parameter of every recipe: an override that is not null, else the recipe's value by
    its key, converted, else the default; held to the parameter's range. ``params`` is a small registry."""
    every = recipes.select("recipe").join(F.broadcast(params), F.lit(True))
    own = values.select("recipe", F.col("path").alias("recipe_key"), F.col("value").alias("__own"))
    over = overrides.where("value is not null").select("recipe", "name", F.col("value").alias("__over"))
    joined = every.join(own, ["recipe", "recipe_key"], "left").join(over, ["recipe", "name"], "left")
    value = F.coalesce("__over", convert(F.col("__own"), F.col("conversion")), "default")
    origin = F.when(F.col("__over").isNotNull(), "override").when(F.col("__own").isNotNull(), "recipe").otherwise("default")
    return joined.select("recipe", "name", F.least(F.greatest(value, F.col("min_val")), F.col("max_val")).alias("value"), origin.alias("origin"))


def schema_errors(values: DataFrame, params: DataFrame, key: str) -> DataFrame:
    """``key, path, problem`` of values that a registry (``recipe_key, min_val, max_val``) doesn't allow."""
    known = F.broadcast(params.select(F.col("recipe_key").alias("path"), "min_val", "max_val", F.lit(True).alias("__known")))
    number = F.col("value").try_cast("double")
    problem = (
        F.when(F.col("__known").isNull(), "unknown").when(number.isNull(), "not_a_number").when((number < F.col("min_val")) | (number > F.col("max_val")), "out_of_range")
    )
    return values.join(known, "path", "left").withColumn("problem", problem).where("problem is not null").select(key, "path", "problem")


def search(recipes: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which one of the columns contains the text, letter case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return recipes.where(hit)


def mark_action(marks: DataFrame, policy: DataFrame, least_confidence: float) -> DataFrame:
    """``marks`` with ``action`` and ``strength`` (0..1): the policy of the mark's class, on the body that of the body first, else that of
    unknown marks, else preserve. Marks of low confidence are unknown. ``policy``: ``on_body, mark_class, action, strength``; of several rules for a
    place and class the one with the first action, then the least strength, counts."""
    policy = policy.groupBy("on_body", "mark_class").agg(F.min(F.struct("action", "strength")).alias("__rule")).select("on_body", "mark_class", "__rule.*")
    own = F.when(F.col("confidence") >= least_confidence, F.col("mark_class")).otherwise("unknown")
    rule = lambda body, name: F.broadcast(policy.where(F.col("on_body") == body).select(F.col("mark_class").alias(f"__{name}"), F.struct("action", "strength").alias(name)))
    joined = marks.withColumns({"__class": own, "__of_unknown": F.lit("unknown")})
    joined = joined.join(rule(True, "b"), F.col("on_body") & (F.col("__class") == F.col("__b")), "left")
    joined = joined.join(rule(False, "f"), F.col("__class") == F.col("__f"), "left").join(rule(False, "u"), F.col("__of_unknown") == F.col("__u"), "left")
    chosen = F.coalesce("b", "f", "u", F.struct(F.lit("preserve").alias("action"), F.lit(100.0).alias("strength")))
    strength = F.least(F.greatest(F.coalesce(chosen["strength"], F.lit(100.0)), F.lit(0.0)), F.lit(100.0)) / 100
    return joined.select(*marks.columns, chosen["action"].alias("action"), F.when(chosen["action"].isNotNull(), strength).alias("mark_strength"))
