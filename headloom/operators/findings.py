"""Counts, values and samples of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions.counting import rows_in, with_sites
from headloom.functions import text as T
from headloom.plans import rules
from headloom.plans.enrich import note_rows


COOCCUR = ("bad", "warn")
#: Numbers of Vary members that are sampled.
VARY_COUNTS = ["6", "7", "8", "9", "10", "11", "12", "27"]


def note_counts(e: DataFrame) -> DataFrame:
    return with_sites(note_rows(e), "note_id")


def note_by_layer(e: DataFrame) -> DataFrame:
    return note_rows(e).select("note_id", F.explode("layers").alias("layer")).groupBy("note_id", "layer").agg(rows_in().alias("occ"))


def variable(name: Column, v: Column) -> Column:
    """Value of a tracked variable, derived ones included."""

    def number(key: str, table: list) -> Column:
        return T.bucket(v[key].try_cast("double"), table)

    return (
        F.when(name == "field_error", F.concat(v["field_name"], F.lit(": "), F.split_part(v["problem"], F.lit("\n"), F.lit(1))))
        .when(name == "directive_conflicts", F.concat(v["directive"], F.lit(" → "), F.trim(F.regexp_replace(v["conflicts"], r"\s+", " "))))
        .when(name == "field_name_key", F.concat(v["field_name"], F.lit(": "), v["key"]))
        .when(name == "freshness_left_bucket", number("freshness_left", T.DURATION))
        .when(name == "duration_bucket", number("duration", T.DURATION))
        .when(name == "cookie_value_size_bucket", number("set_cookie_value_length", T.BYTES))
        .when(name == "field_size_bucket", number("field_size", T.BYTES))
        .otherwise(F.try_element_at(v, name))
    )


def tracked(e: DataFrame) -> DataFrame:
    """note_id, var, val of every tracked variable of every finding."""
    table = F.create_map(*[x for k, vs in rules.TRACKED.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])
    rows = note_rows(e).withColumn("var", F.explode(F.try_element_at(table, F.col("note_id"))))
    return rows.withColumn("val", variable(F.col("var"), F.col("vars"))).filter("val is not null")


def note_vars(e: DataFrame) -> DataFrame:
    return tracked(e).groupBy("note_id", "var", "val").agg(rows_in().alias("occ"))


def numeric_max(e: DataFrame) -> DataFrame:
    """Largest line of each header that is too large."""
    rows = note_rows(e).filter("note_id = 'FIELD_TOO_LARGE'")
    size = F.col("vars")["field_size"].try_cast("double").cast("long")
    return rows.groupBy("note_id", F.col("vars")["field_name"].alias("field_name")).agg(F.max(size).alias("largest")).filter("largest is not null")


def samples(rows: DataFrame, keys: list[str], limit: int, sites: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``limit`` URLs of distinct sites for each key, the smallest URL of a site, sites in order; a response
    without a site stands for itself. Only sites that are listed serve as samples; counts elsewhere are not touched. ``more`` columns come along.
    Samples of samples are those of all rows."""
    rows = rows.filter("url is not null").withColumn("site", F.coalesce("site", "url"))
    if sites is not None:
        rows = rows.join(sites.select("site").distinct(), "site", "left_semi")
    one = rows.groupBy(*keys, "site").agg(F.min("url").alias("url"), *[F.min_by(c, "url").alias(c) for c in more])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("url"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= limit)


def note_samples(e: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    return samples(note_rows(e), ["note_id"], 5, sites)


def var_samples(e: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Samples by header name, and by some numbers of Vary members, with the values as sent where they are no secrets."""
    vary = (F.col("note_id") == "VARY_COMPLEX") & (F.col("var") == "vary_count") & F.col("val").isin(VARY_COUNTS)
    found = samples(tracked(e).filter((F.col("var") == "field_name") | vary), ["note_id", "var", "val"], 15, sites)
    name = F.when(F.col("var") == "vary_count", "vary").otherwise(F.col("val"))
    shown = F.transform(F.filter("headers", lambda h: h["name"] == name), lambda h: T.shown_value(h["name"], h["value"]))
    # headers of the few sampled URLs alone, of a URL's first response where there are several
    sent = e.join(found.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min_by("headers", "resp_id").alias("headers"))
    return found.join(sent, "url").withColumn("field_values", F.to_json(F.array_compact(shown))).drop("headers")


def fired(e: DataFrame) -> DataFrame:
    """resp_id, site, and the distinct bad or warn findings, and their ancestor pairs ``a, b``."""
    some = F.filter("notes", lambda n: n["level"].isin(*COOCCUR))
    ids = F.array_sort(F.array_distinct(F.transform(some, lambda n: n["note_id"])))
    edges = F.flatten(F.transform(some, lambda n: F.transform(F.filter(n["ancestors"], lambda a: a != n["note_id"]), lambda a: F.array_join(F.array_sort(F.array(a, n["note_id"])), ", "))))
    return e.select("resp_id", "site", ids.alias("ids"), F.array_distinct(edges).alias("lineage"))


def bundle_rows(e: DataFrame) -> DataFrame:
    return fired(e).select("site", H.bundle(F.col("ids")).alias("bundle"))


def fired_rows(e: DataFrame) -> DataFrame:
    return fired(e).select("site", F.explode("ids").alias("note_id"))


def pair_rows(e: DataFrame) -> DataFrame:
    return fired(e).select("site", F.explode(F.array_except(H.pairs(F.col("ids")), F.col("lineage"))).alias("pair"))


def note_bundles(e: DataFrame) -> DataFrame:
    return with_sites(bundle_rows(e), "bundle")


def note_marginals(e: DataFrame) -> DataFrame:
    return with_sites(fired_rows(e), "note_id")


def note_pairs(e: DataFrame) -> DataFrame:
    """Findings that occur together; a finding and its ancestor don't pair."""
    return with_sites(pair_rows(e), "pair")


def note_lifts(e: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` commonest pairs of findings with P(a|b), P(b|a) and lift."""
    from headloom.operators.cooccur import lifts_of

    return lifts_of(note_pairs(e), note_marginals(e).withColumnRenamed("note_id", "token"), e.agg(rows_in()).scalar(), limit)


def by_field(e: DataFrame) -> DataFrame:
    """Findings on each header: occurrences and kinds."""
    rows = note_vars(e).filter("var = 'field_name'").groupBy(F.lower("val").alias("field"))
    return rows.agg(F.sum("occ").alias("occ"), F.countDistinct("note_id").alias("types"))


def field_errors(values: DataFrame) -> DataFrame:
    """Errors of structured fields, parted into field and problem, from counted values."""
    both = F.split("val", ": ", 2)
    return values.filter("var = 'field_error'").groupBy(both[0].alias("field"), both[1].alias("problem")).agg(F.sum("occ").alias("occ"))


def unseen(e: DataFrame) -> DataFrame:
    """Known note ids that never fired, and why: reachable, request only, body only."""
    return unseen_of(note_rows(e).select("note_id").distinct())


def unseen_of(seen: DataFrame) -> DataFrame:
    known = [(r.id, "reachable") for r in rules.rules()] + [(x, "request_only") for x in rules.REQUEST_ONLY] + [(x, "body_only") for x in rules.BODY_ONLY]
    return seen.sparkSession.createDataFrame(known, "note_id string, kind string").join(seen, "note_id", "left_anti")


def by_category(e: DataFrame) -> DataFrame:
    """Occurrences, share and number of note ids by category."""
    return categories_of(note_counts(e))


def described(counts: DataFrame) -> DataFrame:
    """Counts of findings with what the rule says: level, category, summary."""
    info = counts.sparkSession.createDataFrame([(r.id, r.level, r.category, r.summary) for r in rules.rules() + rules.BODY], "note_id string, level string, category string, summary string")
    return counts.join(F.broadcast(info), "note_id", "left").withColumn("category", F.coalesce("category", F.lit("UNCATEGORIZED")))


def categories_of(counts: DataFrame) -> DataFrame:
    rows = described(counts)
    rows = rows.groupBy("category").agg(F.sum("occ").alias("occ"), rows_in().alias("types"))
    total = F.sum("occ").over(Window.partitionBy())
    return rows.withColumn("share", F.round(F.col("occ") * 100.0 / total, 6))


def fires_per_occurrence(e: DataFrame) -> DataFrame:
    """How often a finding on a header fires for each occurrence of that header."""
    from headloom.operators.counters import field_counts

    found = note_vars(e).filter("var = 'field_name'").withColumn("name", F.lower("val"))
    seen = field_counts(e).withColumnRenamed("occ", "field_occ")
    return found.join(seen, "name", "left").select("note_id", "val", "occ", "field_occ", F.round(F.try_divide(F.col("occ"), F.col("field_occ")), 6).alias("rate"))


def layer_rates(e: DataFrame) -> DataFrame:
    """Findings by layer: share of the finding, and rate over the layer's responses."""
    from headloom.operators.counters import layer_counts

    return rates_of(note_by_layer(e), note_counts(e), layer_counts(e))


def rates_of(rows: DataFrame, notes: DataFrame, layers: DataFrame) -> DataFrame:
    total = rows.join(notes.select("note_id", F.col("occ").alias("total")), "note_id").join(layers, "layer", "left")
    return total.select("note_id", "layer", "occ", F.round(F.try_divide(F.col("occ") * 100.0, F.col("total")), 6).alias("share"), F.round(F.try_divide(F.col("occ") * 100.0, F.col("responses")), 6).alias("rate"))
