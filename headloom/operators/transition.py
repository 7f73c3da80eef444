"""How far responses have moved from older headers to their replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions.counting import rows_in


CATEGORIES = ["both", "modern_only", "legacy_only", "neither"]
MODERN, LEGACY = ["both", "modern_only"], ["both", "legacy_only"]


def pairs(headers: Column) -> list[tuple[str, str, str, Column, Column | None]]:
    """key, labels, older and newer test; the last pair has no replacement."""
    has = lambda n: H.has(headers, n)
    cc = F.transform(H.cache_tokens(headers), H.token_name)
    return [
        ("frame_options", "X-Frame-Options", "CSP frame-ancestors", has("x-frame-options"), F.array_contains(H.csp_directives(headers), "frame-ancestors")),
        ("reporting", "Report-To", "Reporting-Endpoints", has("report-to"), has("reporting-endpoints")),
        ("expiry", "Expires", "Cache-Control: max-age", has("expires"), F.array_contains(cc, "max-age")),
        ("permissions_policy", "Feature-Policy", "Permissions-Policy", has("feature-policy"), has("permissions-policy")),
        ("no_cache", "Pragma: no-cache", "Cache-Control: no-cache", H.pragma_no_cache(headers), F.array_contains(cc, "no-cache")),
        ("xss_protection", "X-XSS-Protection", "(no replacement)", has("x-xss-protection"), None),
    ]


def categories(e: DataFrame) -> DataFrame:
    """site, pair, category: one row per response and pair."""
    made = []
    for key, _, _, old, new in pairs(F.col("headers")):
        new = F.lit(False) if new is None else new
        label = F.when(old & new, "both").when(new, "modern_only").when(old, "legacy_only").otherwise("neither")
        made.append(F.struct(F.lit(key).alias("pair"), label.alias("category")))
    return e.select("site", F.explode(F.array(*made)).alias("t")).select("site", "t.*")


def counts(e: DataFrame) -> DataFrame:
    return categories(e).groupBy("pair", "category").agg(rows_in().alias("occ"))


def rows(e: DataFrame) -> DataFrame:
    """One row per pair, also where nothing was seen; ``ratio`` is null then."""
    own = lambda *cats: F.col("category").isin(*cats)
    return rows_of(
        categories(e).groupBy("pair").agg(
            *[F.sum(own(c).cast("long")).alias(c) for c in CATEGORIES],
            F.countDistinct(F.when(own(*MODERN), F.col("site"))).alias("modern_sites"),
            F.countDistinct(F.when(own(*LEGACY), F.col("site"))).alias("legacy_sites"),
        )
    )


def rows_of(sums: DataFrame) -> DataFrame:
    """The same from one row of sums for each pair that was seen."""
    listed = [(i, k, a, b, new is None) for i, (k, a, b, _, new) in enumerate(pairs(F.col("headers")))]
    names = sums.sparkSession.createDataFrame(listed, "ord int, pair string, legacy string, modern string, legacy_only_pair boolean")
    out = names.join(sums, "pair", "left").na.fill(0)
    modern, legacy = F.col("both") + F.col("modern_only"), F.col("both") + F.col("legacy_only")
    return out.withColumns({"modern_present": modern, "legacy_present": legacy, "scoped": modern + legacy, "ratio": F.round(F.try_divide(modern, modern + legacy), 6)})
