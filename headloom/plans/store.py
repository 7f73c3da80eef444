"""Aggregates as Parquet, one folder each, to be merged with those of other crawls and rendered later.

Counts add up, maxima take the largest, samples are sampled again, distinct sites are registers that merge by maximum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions import hll
from headloom.functions.counting import rows_in
from headloom.operators import cooccur, counters, findings, recipes, transition
from headloom.plans.enrich import note_rows

#: Gives an aggregate by name, from responses or from stores.
Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Kept:
    """The query of an aggregate, its keys, what adds up, and rows of keys and site whose distinct sites go into
    ``2 ** p`` registers a key."""

    query: Callable[[DataFrame], DataFrame]
    keys: list[str]
    sums: list[str]
    rows: Callable[[DataFrame], DataFrame] | None = None
    p: int = hll.TOKEN


def _headline(e: DataFrame) -> DataFrame:
    return e.agg(rows_in().alias("responses"), F.countDistinct("site").alias("sites"))


def _vary(e: DataFrame):
    return H.vary_tokens(F.col("headers"))


def _cache(e: DataFrame):
    return H.cache_tokens(F.col("headers"))


SUMS: dict[str, Kept] = {
    "responses": Kept(_headline, [], ["responses"], lambda e: e, hll.GLOBAL),
    "fields": Kept(counters.field_counts, ["name"], ["occ"]),
    "unregistered": Kept(counters.unregistered, ["name"], ["responses"]),
    "severity": Kept(counters.severity, ["severity"], ["responses"]),
    "bytes": Kept(counters.header_bytes, ["name"], ["bytes"]),
    "blocks": Kept(counters.block_histogram, ["bucket"], ["responses"]),
    "layers": Kept(counters.layer_counts, ["layer"], ["responses"]),
    "field_layers": Kept(counters.field_by_layer, ["name", "layer"], ["occ"]),
    "networks": Kept(counters.asn_counts, ["asn"], ["responses"]),
    "lifetimes": Kept(counters.value_histograms, ["histogram", "bucket"], ["occ"]),
    "notes": Kept(findings.note_counts, ["note_id"], ["occ"], note_rows),
    "note_layers": Kept(findings.note_by_layer, ["note_id", "layer"], ["occ"]),
    "note_vars": Kept(findings.note_vars, ["note_id", "var", "val"], ["occ"]),
    "note_bundles": Kept(findings.note_bundles, ["bundle"], ["occ"], findings.bundle_rows, hll.RECIPE),
    "note_marginals": Kept(findings.note_marginals, ["note_id"], ["occ"], findings.fired_rows),
    "note_pairs": Kept(findings.note_pairs, ["pair"], ["occ"], findings.pair_rows, hll.RECIPE),
    "vary": Kept(recipes.vary_recipes, ["recipe"], ["occ"], lambda e: recipes.recipe_rows(e, _vary(e)), hll.RECIPE),
    "vary_factored": Kept(recipes.vary_factored, ["recipe"], ["occ"], recipes.vary_factored_rows, hll.RECIPE),
    "vary_tokens": Kept(recipes.vary_marginals, ["token"], ["occ"], lambda e: recipes.token_rows(e, recipes.vary_members())),
    "cache_control": Kept(recipes.cc_recipes, ["recipe"], ["occ"], lambda e: recipes.recipe_rows(e, _cache(e)), hll.RECIPE),
    "cache_tokens": Kept(recipes.cc_marginals, ["token"], ["occ"], lambda e: recipes.token_rows(e, recipes.cc_names())),
    "bundles": Kept(lambda e: cooccur.bundles(e, cooccur.security(e)), ["bundle"], ["occ"], lambda e: cooccur.bundle_rows(e, cooccur.security(e)), hll.RECIPE),
    "bundle_pairs": Kept(lambda e: cooccur.pair_counts(e, cooccur.security(e)), ["pair"], ["occ"], lambda e: cooccur.pair_rows(e, cooccur.security(e)), hll.RECIPE),
    "bundle_tokens": Kept(lambda e: cooccur.marginal_counts(e, cooccur.security(e)), ["token"], ["occ"], lambda e: recipes.token_rows(e, cooccur.security(e))),
    "bundle_layers": Kept(lambda e: cooccur.by_layer(e, cooccur.security(e)), ["bundle", "layer"], ["occ"]),
    "transitions": Kept(transition.counts, ["pair", "category"], ["occ"], transition.categories),
}
#: name -> (query, keys, what takes the largest).
LARGEST = {"policies": (counters.policy_sizes, ["site"], "size"), "largest_lines": (findings.numeric_max, ["note_id", "field_name"], "largest")}
#: name -> (query, keys, rows for each key, further columns).
SAMPLES = {"note_samples": (findings.note_samples, ["note_id"], 5, ()), "var_samples": (findings.var_samples, ["note_id", "var", "val"], 15, ("field_values",))}


def aggregate(e: DataFrame, name: str) -> DataFrame:
    """What a store keeps under a name, but for distinct sites."""
    if name in SUMS:
        return SUMS[name].query(e).select(*SUMS[name].keys, *SUMS[name].sums)
    return (LARGEST | SAMPLES)[name][0](e)


def fold(rows: DataFrame, name: str) -> DataFrame:
    """One aggregate from the rows of several."""
    if name in SUMS:
        kept = SUMS[name]
        return rows.groupBy(*kept.keys).agg(*[F.sum(c).alias(c) for c in kept.sums])
    if name in LARGEST:
        _, keys, value = LARGEST[name]
        return rows.groupBy(*keys).agg(F.max(value).alias(value))
    _, keys, limit, more = SAMPLES[name]
    return findings.samples(rows, keys, limit, more=more)


def registers(e: DataFrame, name: str) -> DataFrame:
    kept = SUMS[name]
    return hll.registers(kept.rows(e), kept.keys, "site", kept.p)


def live(e: DataFrame) -> Tables:
    """Aggregates of enriched responses, distinct sites exact."""

    def get(name: str) -> DataFrame:
        if name == "transition_rows":
            return transition.rows(e)
        if name == "context":
            return e.sparkSession.createDataFrame([], "key string, value string")
        return SUMS[name].query(e) if name in SUMS else aggregate(e, name)

    return get


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save(e: DataFrame, path: str, **context: str) -> None:
    """Every aggregate, its registers, and the context of the run (crawl, time, versions, limits)."""
    for name in [*SUMS, *LARGEST, *SAMPLES]:
        _write(aggregate(e, name), f"{path}/{name}")
    for name, kept in SUMS.items():
        if kept.rows is not None:
            _write(registers(e, name), f"{path}/{name}.sites")
    rows = [(k, str(v)) for k, v in context.items()]
    _write(e.sparkSession.createDataFrame(rows, "key string, value string"), f"{path}/context")


def merged(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """One aggregate over several stores."""
    return fold(spark.read.parquet(*[f"{p}/{name}" for p in paths]), name)


def merged_registers(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """Stores may hold registers of other widths; those beyond the width of this aggregate don't count."""
    return hll.union(spark.read.parquet(*[f"{p}/{name}.sites" for p in paths]), SUMS[name].keys, 1 << SUMS[name].p)


def merged_context(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first store that has a key decides it."""
    each = [spark.read.parquet(f"{p}/context").withColumn("nth", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each).groupBy("key").agg(F.min_by("value", "nth").alias("value"))


def opened(spark: SparkSession, paths: list[str]) -> Tables:
    """Aggregates of stores, as ``live`` gives them, distinct sites estimated."""

    def sites(rows: DataFrame, keys: list[str], p: int, out: str = "sites") -> DataFrame:
        return hll.estimate(rows, keys, p, out)

    def moved() -> DataFrame:
        seen, p = merged(spark, paths, "transitions"), SUMS["transitions"].p
        out = seen.groupBy("pair").agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("occ"))), F.lit(0)).alias(c) for c in transition.CATEGORIES])
        found = merged_registers(spark, paths, "transitions")
        for name, those in (("modern_sites", transition.MODERN), ("legacy_sites", transition.LEGACY)):
            some = hll.union(found.filter(F.col("category").isin(those)), ["pair"])
            out = out.join(sites(some, ["pair"], p, name), "pair", "left")
        return transition.rows_of(out)

    def get(name: str) -> DataFrame:
        if name == "transition_rows":
            return moved()
        if name == "context":
            return merged_context(spark, paths)
        rows, kept = merged(spark, paths, name), SUMS.get(name)
        if kept is None or kept.rows is None:
            return rows
        seen = sites(merged_registers(spark, paths, name), kept.keys, kept.p)
        if not kept.keys:
            return rows.withColumn("sites", seen.scalar())
        return rows.join(seen, kept.keys, "left").na.fill(0, ["sites"])

    return get


def finish(spark: SparkSession, paths: list[str], path: str, **context: str) -> None:
    """Several stores as one at another path; ``context`` adds to theirs, such as the time."""
    for name in [*SUMS, *LARGEST, *SAMPLES]:
        _write(merged(spark, paths, name), f"{path}/{name}")
    for name, kept in SUMS.items():
        if kept.rows is not None:
            _write(merged_registers(spark, paths, name), f"{path}/{name}.sites")
    known = merged_context(spark, paths)
    more = spark.createDataFrame([(k, str(v)) for k, v in context.items()], "key string, value string")
    _write(known.join(more, "key", "left_anti").unionByName(more), f"{path}/context")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results kept as lines of two JSON values with a tab between, in files ``part-*``: key and value, and the lines
    that are not of that form, which are left out. ``plans.legacy`` makes a store of them."""
    lines = spark.read.option("pathGlobFilter", "part-*").text(path).withColumnRenamed("value", "line").filter("trim(line) <> ''")
    at = F.instr("line", "\t")
    rows = lines.withColumns({"key": F.when(at > 0, F.col("line").substr(F.lit(1), at - 1)), "value": F.when(at > 0, F.col("line").substr(at + 1, F.length("line")))})
    good = F.try_parse_json("key").isNotNull() & F.try_parse_json("value").isNotNull()
    return rows.filter(good).select("key", "value"), rows.filter(~F.coalesce(good, F.lit(False))).select("line")
