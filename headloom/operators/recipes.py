"""Recipes: sets of tokens as sorted keys, counted whole and by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headloom import config
from headloom.functions import headers as H
from headloom.functions import hll
from headloom.functions.counting import with_sites


def recipe_rows(e: DataFrame, tokens: Column) -> DataFrame:
    return e.select("site", H.recipe(tokens).alias("recipe")).filter("recipe <> ''")


def token_rows(e: DataFrame, tokens: Column) -> DataFrame:
    return e.select("site", F.explode(F.array_distinct(tokens)).alias("token"))


def recipes(e: DataFrame, tokens: Column) -> DataFrame:
    """Responses and distinct sites of each recipe; an empty one doesn't count."""
    return with_sites(recipe_rows(e, tokens), "recipe")


def marginals(e: DataFrame, tokens: Column) -> DataFrame:
    return with_sites(token_rows(e, tokens), "token")


def site_estimates(e: DataFrame, tokens: Column, p: int = hll.RECIPE) -> DataFrame:
    """Estimated sites by recipe from mergeable registers."""
    return hll.estimate(hll.registers(recipe_rows(e, tokens), ["recipe"], "site", p), ["recipe"], p)


def vary_recipes(e: DataFrame) -> DataFrame:
    return recipes(e, H.vary_tokens(F.col("headers")))


def vary_members() -> Column:
    """The wildcard is no field name."""
    return F.array_remove(H.vary_tokens(F.col("headers")), "*")


def vary_marginals(e: DataFrame) -> DataFrame:
    return marginals(e, vary_members())


def factored_rows(e: DataFrame, tokens: Column, drop: str, label: str) -> DataFrame:
    """Recipes without one token; those that it alone made up go under ``label``."""
    return e.filter(H.recipe(tokens) != "").select("site", without(tokens, drop, label).alias("recipe"))


def without(tokens: Column, drop: str, label: str) -> Column:
    rest = H.recipe(F.array_remove(tokens, drop))
    return F.when(rest == "", label).otherwise(rest)


#: The member that nearly every recipe has, and what is shown where there is no other.
FACTORED = "accept-encoding", "(accept-encoding only)"


def vary_factored_rows(e: DataFrame) -> DataFrame:
    return factored_rows(e, H.vary_tokens(F.col("headers")), *FACTORED)


def vary_factored(e: DataFrame) -> DataFrame:
    return with_sites(vary_factored_rows(e), "recipe")


#: Axes of negotiation that are of most interest.
AXES = ["accept-encoding", "user-agent", "cookie", "accept-language"]


def vary_axes(e: DataFrame) -> DataFrame:
    return axes_of(vary_marginals(e))


def axes_of(members: DataFrame) -> DataFrame:
    axes = members.sparkSession.createDataFrame([(x,) for x in AXES], "token string")
    return axes.join(members, "token", "left").na.fill(0, ["occ", "sites"])


def vary_nonstandard(e: DataFrame) -> DataFrame:
    """Vary members that are no registered field names."""
    return unregistered_of(vary_marginals(e))


def unregistered_of(members: DataFrame) -> DataFrame:
    return members.filter(~H.is_registered(F.col("token")))


def cc_recipes(e: DataFrame) -> DataFrame:
    return recipes(e, H.cache_tokens(F.col("headers")))


def cc_marginals(e: DataFrame) -> DataFrame:
    return marginals(e, cc_names())


def cc_names() -> Column:
    return F.transform(H.cache_tokens(F.col("headers")), H.token_name)


def cc_nonstandard(e: DataFrame) -> DataFrame:
    return unknown_of(cc_marginals(e))


def unknown_of(directives: DataFrame) -> DataFrame:
    return directives.filter(~F.col("token").isin(list(config.fields().cache_directives)))
