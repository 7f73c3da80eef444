"""What became of the lines of a scan, counted while they are read.

``Outcomes`` puts observed counts into the plan of the real scan: no second pass, and nothing to add up by hand. Counts
are there once an action has read the responses to their end, such as writing the enriched table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from headloom.plans.enrich import enrich, keep_sites
from headloom.sources import wat


class Outcomes:
    """One for each scan: an observation counts one action."""

    def __init__(self) -> None:
        self._scan, self._linted = Observation(), Observation()

    def responses(self, lines: DataFrame) -> DataFrame:
        """``wat.parse_responses`` with its lines counted: read, malformed, without a response."""
        outcome = F.col("outcome")
        counts = [F.count(F.lit(1)).alias("read"), *(F.count_if(outcome == x).alias(x) for x in ("malformed", "no_response", "response"))]
        seen = lines.withColumn("outcome", wat.outcome(F.col("line"))).observe(self._scan, *counts)
        return wat.parse_responses(seen)

    def enriched(self, responses: DataFrame, sites: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
        """The enriched table, with its rows counted as linted; what ``sites`` doesn't list counts as filtered."""
        kept = responses if sites is None else keep_sites(responses, sites)
        return enrich(kept, prefixes).observe(self._linted, F.count(F.lit(1)).alias("linted"))

    def counts(self) -> dict[str, int]:
        """read = malformed + no_response + filtered + linted. Waits for the action that reads the lines."""
        seen = self._scan.get
        linted = int(self._linted.get["linted"])
        return {"read": int(seen["read"]), "malformed": int(seen["malformed"]), "no_response": int(seen["no_response"]), "filtered": int(seen["response"]) - linted, "linted": linted}

    def context(self) -> dict[str, str]:
        """The counts as context of a run, for ``store.save`` and the report."""
        return {f"lines_{k}": str(v) for k, v in self.counts().items()}


def write_enriched(spark: SparkSession, paths: str | list[str], out: str, sites: DataFrame | None = None, prefixes: DataFrame | None = None, record_limit: int = 0) -> dict[str, int]:
    """Scans archives into the enriched table at ``out``; gives what became of their lines."""
    outcomes = Outcomes()
    outcomes.enriched(outcomes.responses(wat.read_lines(spark, paths, record_limit)), sites, prefixes).write.mode("overwrite").parquet(out)
    return outcomes.counts()
