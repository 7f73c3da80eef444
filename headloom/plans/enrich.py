"""Responses with everything the aggregates share: site, network, layers, findings. Written once, read by many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.plans import rules
from headloom.sources.tables import lookup_asn

SHOWN = "resp_id", "url", "site", "asn", "layers", "crawl_ts"


def keep_sites(responses: DataFrame, sites: DataFrame) -> DataFrame:
    """Only responses of listed sites. This comes before any header is read."""
    return responses.join(sites.select("site").distinct(), "site", "left_semi")


def enrich(responses: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    if prefixes is not None:
        responses = lookup_asn(responses, prefixes)
    elif "asn" not in responses.columns:
        responses = responses.withColumn("asn", F.lit(None).cast("long"))
    h = F.col("headers")
    notes = rules.notes_of("headers")
    if "body_notes" in responses.columns:  # from archives that hold bodies
        notes = F.concat(notes, F.coalesce("body_notes", F.array().cast(responses.schema["body_notes"].dataType)))
    return responses.withColumns({"layers": H.matched_layers(h, F.col("asn")), "notes": notes})


def header_rows(enriched: DataFrame) -> DataFrame:
    """One row per header line: resp_id, site, layers, pos, name, value."""
    rows = enriched.select("resp_id", "site", "layers", F.posexplode("headers").alias("pos", "h"))
    return rows.select("resp_id", "site", "layers", "pos", "h.name", "h.value")


def note_rows(enriched: DataFrame) -> DataFrame:
    """One row per finding of a known level: resp_id, url, site, layers, pos, note_id, level, ancestors, vars. An outer
    explode, as an inner one would make the planner test the notes before it, and so evaluate all rules again."""
    rows = enriched.select("resp_id", "url", "site", "layers", F.posexplode_outer("notes").alias("pos", "n"))
    return rows.select("resp_id", "url", "site", "layers", "pos", "n.*").filter(F.col("level").isin(*rules.RANK))
