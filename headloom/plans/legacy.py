"""Results of the older form (lines of JSON, see ``store.read_records``) as a store.

A line is a name and a value: ``globals``, ``note:<id>``, ``csp_sizes``, ``vary``, ``cache_control``,
``value_histograms``, ``cooccur``, ``note_cooccur`` or ``transition``. A name may come in many lines, one a shard. Values
are parsed once by the schema of their name; counts become rows and add up, maxima and samples fold as in any store,
and packed registers become rows (key, index, rho), which merge by maximum whatever their widths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions import hll
from headloom.operators import recipes
from headloom.plans import store
from headloom.sources.scratch import shared_path

_COUNTS, _NESTED = "map<string, bigint>", "map<string, map<string, bigint>>"
_RECIPES = f"struct<occ: {_COUNTS}, hlls: map<string, array<int>>>"
_SAMPLE = "struct<url: string, site: string, vars: map<string, string>>"
#: Flags of cut tables.
FLAGS = ["truncated_field_counts", "truncated_unprocessed_counts", "truncated_field_counts_by_layer", "truncated_asn_counts", "truncated_field_bytes"]
#: Names of lines, with the fields of their values that a store takes.
SCHEMAS = {
    "globals": (
        f"struct<total_responses: bigint, field_counts: {_COUNTS}, unprocessed_counts: {_COUNTS}, severity_counts: {_COUNTS}, layer_counts: {_COUNTS}, asn_counts: {_COUNTS}, field_bytes: {_COUNTS}, "
        f"header_block_hist: {_COUNTS}, field_counts_by_layer: {_NESTED}, sites_hll: array<int>, run_context: map<string, string>, {', '.join(f'{x}: boolean' for x in FLAGS)}>"
    ),
    "note": (
        f"struct<count: bigint, by_layer: {_COUNTS}, vars: {_NESTED}, numeric_maxes: {_NESTED}, samples: array<{_SAMPLE}>, var_samples: map<string, map<string, array<{_SAMPLE}>>>, "
        "sites_hll: array<int>, truncated_vars: map<string, boolean>>"
    ),
    "csp_sizes": _COUNTS,
    "value_histograms": _NESTED,
    "vary": f"struct<recipes: {_RECIPES}, marginals: {_RECIPES}>",
    "cache_control": f"struct<recipes: {_RECIPES}, marginals: {_RECIPES}>",
    "cooccur": f"struct<bundles: {_RECIPES}, marginals: {_RECIPES}, pairs: {_RECIPES}, by_layer: {_NESTED}>",
    "note_cooccur": f"struct<bundles: {_RECIPES}, marginals: {_RECIPES}, pairs: {_RECIPES}>",
    "transition": f"struct<pairs: map<string, {_RECIPES}>>",
}


@dataclass(frozen=True)
class From:
    """Where a table comes from: the name of the lines, the field, and how deep its maps go. ``sites``: where its
    registers are, if anywhere."""

    name: str
    field: str
    sites: str = ""


TABLES = {
    "responses": From("globals", "total_responses", "sites_hll"),
    "fields": From("globals", "field_counts"),
    "unregistered": From("globals", "unprocessed_counts"),
    "severity": From("globals", "severity_counts"),
    "bytes": From("globals", "field_bytes"),
    "blocks": From("globals", "header_block_hist"),
    "layers": From("globals", "layer_counts"),
    "networks": From("globals", "asn_counts"),
    "field_layers": From("globals", "field_counts_by_layer"),
    "lifetimes": From("value_histograms", ""),
    "notes": From("note", "count", "sites_hll"),
    "note_layers": From("note", "by_layer"),
    "note_vars": From("note", "vars"),
    "note_bundles": From("note_cooccur", "bundles.occ", "bundles.hlls"),
    "note_marginals": From("note_cooccur", "marginals.occ", "marginals.hlls"),
    "note_pairs": From("note_cooccur", "pairs.occ", "pairs.hlls"),
    "vary": From("vary", "recipes.occ", "recipes.hlls"),
    "vary_factored": From("vary", "recipes.occ", "recipes.hlls"),
    "vary_tokens": From("vary", "marginals.occ", "marginals.hlls"),
    "cache_control": From("cache_control", "recipes.occ", "recipes.hlls"),
    "cache_tokens": From("cache_control", "marginals.occ", "marginals.hlls"),
    "bundles": From("cooccur", "bundles.occ", "bundles.hlls"),
    "bundle_pairs": From("cooccur", "pairs.occ", "pairs.hlls"),
    "bundle_tokens": From("cooccur", "marginals.occ", "marginals.hlls"),
    "bundle_layers": From("cooccur", "by_layer"),
    "transitions": From("transition", "pairs", "pairs"),
    "policies": From("csp_sizes", ""),
    "largest_lines": From("note", "numeric_maxes"),
}

Lines = Callable[[str], DataFrame]


def parsed(spark: SparkSession, path: str) -> tuple[Lines, DataFrame]:
    """Values by name, with the note of a ``note:`` line, and the lines that are of no known form."""
    good, bad = store.read_records(spark, path)
    key = F.get_json_object(F.concat(F.lit('{"k":'), "key", F.lit("}")), "$.k")
    name = F.when(key.startswith("note:"), "note").otherwise(key)
    rows = good.withColumns({"name": name, "note_id": F.when(key.startswith("note:"), F.substring(key, 6, 1 << 30))})
    where = shared_path(spark, "legacy")
    known = rows.filter(F.col("name").isin(list(SCHEMAS)))
    known.write.partitionBy("name").parquet(where)
    unknown = rows.filter(~F.coalesce(F.col("name").isin(list(SCHEMAS)), F.lit(False))).select(F.concat_ws("\t", "key", "value").alias("line"))

    def lines(name: str) -> DataFrame:
        held = spark.read.schema("key string, value string, note_id string, name string").parquet(where).filter(F.col("name") == name)
        return held.select("note_id", F.from_json("value", SCHEMAS[name]).alias("v"))

    return lines, bad.unionByName(unknown)


def _leaves(rows: DataFrame, at: Column, keys: list[str], value: str) -> DataFrame:
    """A row for each leaf of maps in maps: what leads there, and what is there."""
    rows = rows.withColumn("_at", at)
    for i, k in enumerate(keys):
        rows = rows.select(*[c for c in rows.columns if c != "_at"], F.explode("_at").alias(k, "_at"))
    return rows.withColumnRenamed("_at", value)


def _get(v: Column, field: str) -> Column:
    for part in field.split("."):
        v = v[part] if part else v
    return v


def _rows(lines: Lines, name: str, field: str, keys: list[str], value: str) -> DataFrame:
    """``keys`` and ``value`` of a field; ``note_id`` is a key of the line, the rest are those of its maps."""
    rows = lines(TABLES[name].name)
    inner = [k for k in keys if not (k == "note_id" and TABLES[name].name == "note")]
    rows = rows if TABLES[name].name == "note" else rows.select("v")
    if TABLES[name].name == "transition":
        part = "hlls" if field == TABLES[name].sites and value == "registers" else "occ"
        rows = rows.select(F.explode("v.pairs").alias("pair", "v"))
        return _leaves(rows, F.col("v")[part], ["category"], value).select(*keys, value)
    return _leaves(rows, _get(F.col("v"), field), inner, value).select(*keys, value)


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    if name == "networks":
        return rows.withColumn("asn", F.col("asn").try_cast("long")).filter("asn is not null")
    if name == "vary_factored":
        rest = recipes.without(H.recipe_tokens(F.col("recipe")), *recipes.FACTORED)
        return rows.filter("recipe <> ''").withColumn("recipe", rest)
    return rows


def table(lines: Lines, name: str) -> DataFrame:
    """An aggregate, folded over all lines."""
    if name in store.SUMS:
        kept, source = store.SUMS[name], TABLES[name]
        return store.fold(_keyed(_rows(lines, name, source.field, kept.keys, kept.sums[0]), name).filter(F.col(kept.sums[0]).isNotNull()), name)
    if name == "policies":
        return store.fold(_rows(lines, name, "", ["site"], "size"), name)
    if name == "largest_lines":
        rows = _leaves(lines("note"), F.col("v.numeric_maxes"), ["var", "field_name"], "largest").filter("var = 'field_size'")
        return store.fold(rows.select("note_id", "field_name", "largest"), name)
    rows = lines("note")
    if name == "note_samples":
        rows = rows.select("note_id", F.explode("v.samples").alias("s"))
        return store.fold(rows.select("note_id", "s.site", "s.url"), name)
    rows = _leaves(rows, F.col("v.var_samples"), ["var", "val"], "s").withColumn("s", F.explode("s"))
    return store.fold(rows.select("note_id", "var", "val", "s.site", "s.url", F.element_at("s.vars", "field_values").alias("field_values")), name)


def registers(lines: Lines, name: str) -> DataFrame:
    """Packed registers as rows; those beyond the width that a store keeps don't count, and shorter ones fill what they can."""
    kept, source = store.SUMS[name], TABLES[name]
    rows = _keyed(_rows(lines, name, source.sites, kept.keys, "registers"), name)
    rows = rows.select(*kept.keys, F.posexplode("registers").alias("idx", "rho")).filter("rho > 0")
    return hll.union(rows, kept.keys, 1 << kept.p)


def context(lines: Lines) -> DataFrame:
    """What the first line that tells it says of the run, and a row for each table that was cut somewhere."""
    held = lines("globals")
    told = held.select(F.explode("v.run_context").alias("key", "value")).groupBy("key").agg(F.min("value").alias("value"))
    cut = held.select(F.explode(F.array(*[F.when(F.col("v")[x], F.lit(x)) for x in FLAGS])).alias("key"))
    cut = cut.unionByName(lines("note").select("note_id", F.explode("v.truncated_vars").alias("var", "was")).filter("was").select(F.concat(F.lit("truncated_vars:"), "note_id", F.lit("."), "var").alias("key")))
    return told.unionByName(cut.filter("key is not null").distinct().withColumn("value", F.lit("true")))


def convert(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the store of the results in ``path`` to ``out``; gives the lines that were left out."""
    lines, bad = parsed(spark, path)
    if lines("globals").isEmpty() and lines("note").isEmpty():
        raise ValueError(f"no results in {path}: lines named globals or note:<id> are expected")
    for name in [*store.SUMS, *store.LARGEST, *store.SAMPLES]:
        table(lines, name).write.mode("overwrite").parquet(f"{out}/{name}")
    for name, kept in store.SUMS.items():
        if kept.rows is not None:
            registers(lines, name).write.mode("overwrite").parquet(f"{out}/{name}.sites")
    context(lines).write.mode("overwrite").parquet(f"{out}/context")
    return bad
