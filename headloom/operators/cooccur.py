"""Co-occurrence of tokens: bundles, pairs, conditional shares and lift, and each layer's usual bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions.counting import rows_in, with_sites
from headloom.operators.recipes import token_rows


def security(e: DataFrame) -> Column:
    return H.security_headers(F.col("headers"))


def bundle_rows(e: DataFrame, tokens: Column) -> DataFrame:
    return e.select("site", H.bundle(tokens).alias("bundle"))


def pair_rows(e: DataFrame, tokens: Column) -> DataFrame:
    return e.select("site", F.explode(H.pairs(tokens)).alias("pair"))


def bundles(e: DataFrame, tokens: Column) -> DataFrame:
    return with_sites(bundle_rows(e, tokens), "bundle")


def marginal_counts(e: DataFrame, tokens: Column) -> DataFrame:
    return with_sites(token_rows(e, tokens), "token")


def pair_counts(e: DataFrame, tokens: Column) -> DataFrame:
    return with_sites(pair_rows(e, tokens), "pair")


def lifts(e: DataFrame, tokens: Column, limit: int = 25) -> DataFrame:
    """The ``limit`` commonest pairs with P(a|b), P(b|a) and lift; 0 where a marginal is missing."""
    return lifts_of(pair_counts(e, tokens), marginal_counts(e, tokens), e.agg(rows_in()).scalar(), limit)


def lifts_of(pairs: DataFrame, each: DataFrame, total: Column, limit: int = 25) -> DataFrame:
    """The same from counts of pairs and of tokens; ``total``, the number of responses, may be a query within the plan."""
    best = pairs.orderBy(F.desc("occ"), "pair").limit(limit)
    best = best.select(F.split_part("pair", F.lit(", "), F.lit(1)).alias("a"), F.split_part("pair", F.lit(", "), F.lit(2)).alias("b"), F.col("occ").alias("joint"))
    each = each.select("token", "occ")
    total = total.cast("double")
    out = best.join(each.toDF("a", "na"), "a", "left").join(each.toDF("b", "nb"), "b", "left")
    part = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return out.select("a", "b", "joint", part(F.col("joint"), F.col("nb")).alias("p_a_given_b"), part(F.col("joint"), F.col("na")).alias("p_b_given_a"), part(F.col("joint") * total, F.col("na") * F.col("nb")).alias("lift"))


def by_layer(e: DataFrame, tokens: Column) -> DataFrame:
    return e.select(H.bundle(tokens).alias("bundle"), F.explode("layers").alias("layer")).groupBy("bundle", "layer").agg(rows_in().alias("occ"))


def layer_defaults(e: DataFrame, tokens: Column) -> DataFrame:
    """Each layer's commonest bundle and its share."""
    return defaults_of(by_layer(e, tokens))


def defaults_of(rows: DataFrame) -> DataFrame:
    total = F.sum("occ").over(Window.partitionBy("layer"))
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("occ"), "bundle"))
    rows = rows.withColumns({"responses": total, "nth": rank}).filter("nth = 1")
    return rows.select("layer", "responses", "bundle", F.round(F.col("occ") / F.col("responses"), 6).alias("share"))


def empty_bundles(e: DataFrame, tokens: Column) -> DataFrame:
    return bundles(e, tokens).filter(F.col("bundle") == H.EMPTY)
