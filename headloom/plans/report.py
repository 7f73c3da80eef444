"""The report: bounded tables, collected once and written as HTML and as Markdown with the same content."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headloom import config
from headloom.functions import headers as H
from headloom.functions import text as T
from headloom.operators import census, cooccur, counters, findings, ranking, recipes, transition
from headloom.plans import rules, store
from headloom.plans.store import Tables

SMALL = 1_000_000  # below this many responses, unseen notes say little

CALLOUT_NOTES = {
    "set-cookie": "set-cookie: clients send every cookie back with later requests, so these bytes are the lesser part of its traffic.",
    "content-security-policy": "content-security-policy: the policy buckets show how its size spreads over sites.",
}


@dataclass
class Section:
    title: str
    columns: list[str]
    rows: list[tuple]
    more: int = 0
    notes: list[str] = field(default_factory=list)


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def count_text(n) -> str:
    return "—" if n is None else f"{n:,}" if isinstance(n, int) else f"{n:,.2f}" if isinstance(n, float) else str(n)


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def _table(title: str, df: DataFrame, columns: list[str], by: str, limit: int = 25, notes: list[str] | None = None) -> Section:
    """The first ``limit`` rows by ``by``, and how many more there are."""
    ties = [c for c in columns if c != by]
    rows = df.select(*columns).orderBy(F.desc(by), *ties).limit(limit + 1).collect()
    more = df.count() - limit if len(rows) > limit else 0
    return Section(title, columns, [tuple(r) for r in rows[:limit]], more, notes or [])


def _ordered(title: str, df: DataFrame, key: str, value: str, table: list) -> Section:
    found = dict(df.select(key, value).collect())
    return Section(title, [key, value], [(label, found[label]) for label, _ in table if label in found])


#: Categories in the order in which they are shown; others follow by name.
CATEGORY_ORDER = ["CACHING", "SECURITY", "COOKIES", "CORS", "CONNEG", "RANGE", "VALIDATION", "CONNECTION", "GENERAL"]
#: Settings of a run that leave responses out.
CAPS = ["top_sites", "record_limit", "warc_limit"]


def _run(t: Tables) -> Section:
    """What is known of the run, and which of its settings left responses out."""
    known = dict(t("context").select("key", "value").collect())
    capped = [k for k in CAPS if known.get(k, "0") not in ("", "0")]
    return Section("Run", ["key", "value"], sorted(known.items()), notes=[f"This run was capped: {', '.join(capped)}."] if capped else [])


def _findings(t: Tables, sites: int) -> list[Section]:
    """Findings of each category, the worst first, and what never fired there. There are no more rows than rules."""
    every = rules.rules() + rules.BODY
    found = [r for r in findings.described(t("notes")).collect()]
    names = {r.category for r in every} | {r.category for r in found}
    order = [c for c in CATEGORY_ORDER if c in names] + sorted(names - set(CATEGORY_ORDER))
    out = []
    for c in order:
        rows = sorted((r for r in found if r.category == c), key=lambda r: (-rules.RANK.get(r.level, 0), -r.sites, -r.occ, r.note_id))
        missing = sorted({r.id for r in every if r.category == c} - {r.note_id for r in rows})
        shown = [(r.note_id, r.level, r.occ, r.sites, round(100.0 * r.sites / sites, 2) if sites else 0.0, r.summary) for r in rows]
        notes = [f"Never seen: {', '.join(missing)}."] if missing else []
        out.append(Section(f"Findings: {c}", ["note_id", "level", "occ", "sites", "site_pct", "summary"], shown, notes=notes))
    return out


def _values(t: Tables, limit: int = 15) -> list[Section]:
    """Values of each tracked variable, buckets in their order and others by count; and the largest lines."""
    counts = t("note_vars")
    sizes = {(r.note_id, r.var): r.n for r in counts.groupBy("note_id", "var").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = ranking.top_in(counts, ["note_id", "var"], limit, "occ", "val").orderBy("note_id", "var", "rank").collect()
    scale = {label: i for table in (T.DURATION, T.BYTES) for i, (label, _) in enumerate(table)}
    out = []
    for (note, var), n in sorted(sizes.items()):
        rows = [(r.val, r.occ) for r in best if (r.note_id, r.var) == (note, var)]
        if var.endswith("_bucket"):
            rows.sort(key=lambda r: scale.get(r[0], len(scale)))
        out.append(Section(f"{note}: {var}", ["value", "occ"], rows, max(0, n - limit)))
    out.append(_table("Errors of structured fields", findings.field_errors(counts), ["field", "problem", "occ"], "occ", 50))
    out.append(_table("Largest header lines", t("largest_lines"), ["note_id", "field_name", "largest"], "largest"))
    return out


def _census(t: Tables) -> list[Section]:
    entries = census.entries_of(t("unregistered"), t("bytes"))
    shown = ["cluster", "names", "responses", "bytes", "members"]
    out = [_table(f"Proprietary headers by {axis}", census.clusters(entries, axis, "cluster"), shown, "responses", 30) for axis in ("vendor", "prefix")]
    order = [key for key, _, _ in config.families().families] + ["__other__"]  # as listed, the rest last
    found = {r.cluster: tuple(r) for r in census.clusters(entries, "family", "cluster").select(*shown).collect()}
    return [*out, Section("Proprietary headers by family", shown, [found[k] for k in dict.fromkeys(order) if k in found])]


def sections(of: DataFrame | Tables) -> list[Section]:
    """All sections, over enriched responses, which should be a stored table since each section is a query of its own,
    or over what ``store.opened`` gives."""
    t = store.live(of) if isinstance(of, DataFrame) else of
    total, sites = t("responses").select("responses", "sites").first()
    share = F.round(ranking.share(F.col("responses"), F.lit(total)), 2)
    notes, fields, sizes, layers = t("notes"), t("fields"), t("bytes"), t("layers")
    occ, kinds = notes.agg(F.coalesce(F.sum("occ"), F.lit(0)), F.count(F.lit(1))).first()
    out = [_run(t), Section("Summary", ["what", "value"], [("responses", total), ("sites", sites), ("findings", occ), ("kinds of findings", kinds)])]
    out.append(_table("Health", t("severity").withColumn("pct", share), ["severity", "responses", "pct"], "responses"))
    out.append(_table("Findings by category", findings.categories_of(notes), ["category", "occ", "share", "types"], "occ"))
    out += _findings(t, sites)
    out += _values(t)
    out.append(_table("Samples", t("note_samples"), ["note_id", "url", "rank"], "rank", 100))
    out.append(_table("Samples of values", t("var_samples"), ["note_id", "var", "val", "url", "field_values", "rank"], "rank", 100))
    pairs = t("note_pairs")
    out.append(_table("Finding bundles", t("note_bundles"), ["bundle", "occ", "sites"], "occ"))
    out.append(_table("Finding pairs", pairs, ["pair", "occ", "sites"], "occ"))
    lifted = ["a", "b", "joint", "p_a_given_b", "p_b_given_a", "lift"]
    out.append(_table("Finding lifts", cooccur.lifts_of(pairs, t("note_marginals").withColumnRenamed("note_id", "token"), F.lit(total)), lifted, "joint"))
    unseen = Section("Findings that never fired", ["kind", "note_id"], [tuple(r) for r in findings.unseen_of(notes).select("kind", "note_id").orderBy("kind", "note_id").collect()])
    if total < SMALL:
        unseen.notes.append(f"Only {total:,} responses: a rare finding may be missing by chance.")
    out.append(unseen)
    out.append(_table("Response headers", fields.filter(~H.from_crawler(F.col("name"))), ["name", "occ"], "occ", 50))
    block = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = _table("Header bytes", counters.means_of(sizes, fields), ["name", "bytes", "occ", "mean"], "bytes", 50)
    large.notes.append(f"{size_text(block)} in all, {size_text(block / total) if total else 0} a response.")
    out.append(large)
    out.append(_ordered("Header block sizes", t("blocks"), "bucket", "responses", T.BYTES))
    noted = _table("Single headers of note", counters.callouts_of(sizes), ["name", "bytes", "pct"], "bytes")
    noted.notes = [CALLOUT_NOTES[name] for name, *_ in noted.rows]
    out.append(noted)
    out.append(_table("Bytes by category", counters.categories_of(sizes), ["category", "bytes"], "bytes"))
    out += _census(t)
    out.append(_table("Infrastructure", counters.layer_roles(layers).withColumn("pct", share), ["layer", "role", "responses", "pct"], "responses"))
    out.append(_table("Headers by layer", t("field_layers").filter(~H.from_crawler(F.col("name"))), ["name", "layer", "occ"], "occ"))
    out.append(_table("Findings by layer", findings.rates_of(t("note_layers"), notes, layers), ["note_id", "layer", "occ", "share", "rate"], "occ", 50))
    out.append(_table("Networks", counters.networks(t("networks")), ["asn", "operator", "layer", "responses"], "responses", 50))
    counted = ["occ", "sites"]
    members, directives = t("vary_tokens"), t("cache_tokens")
    out.append(_table("Vary recipes", t("vary"), ["recipe", *counted], "occ"))
    out.append(_table("Vary recipes without accept-encoding", t("vary_factored"), ["recipe", *counted], "occ"))
    out.append(_table("Vary axes", recipes.axes_of(members), ["token", *counted], "occ"))
    out.append(_table("Non-standard Vary members", recipes.unregistered_of(members), ["token", *counted], "occ"))
    out.append(_table("Cache-Control recipes", t("cache_control"), ["recipe", *counted], "occ"))
    out.append(_table("Cache-Control directives", directives, ["token", *counted], "occ", 30))
    out.append(_table("Non-standard cache directives", recipes.unknown_of(directives), ["token", *counted], "occ"))
    lifetimes: dict[str, dict[str, int]] = {}  # seven histograms of a fixed scale
    for r in t("lifetimes").collect():
        lifetimes.setdefault(r.histogram, {})[r.bucket] = r.occ
    for name, bars in sorted(lifetimes.items()):
        out.append(Section(f"Lifetimes: {name}", ["bucket", "occ"], [(b, bars[b]) for b, _ in T.LIFETIME if b in bars]))
    out.append(_table("Security header bundles", t("bundles"), ["bundle", *counted], "occ"))
    out.append(_table("Security header pairs", cooccur.lifts_of(t("bundle_pairs"), t("bundle_tokens"), F.lit(total)), lifted, "joint"))
    out.append(_table("Usual bundle by layer", cooccur.defaults_of(t("bundle_layers")), ["layer", "responses", "bundle", "share"], "responses"))
    out.append(_ordered("Content security policy by site", counters.policy_buckets_of(t("policies")), "bucket", "sites", T.POLICY_SIZE))
    moved = ["legacy", "modern", "both", "modern_only", "legacy_only", "neither", "scoped", "ratio", "modern_sites", "legacy_sites"]
    out.append(_table("Transitions", t("transition_rows"), moved, "scoped"))
    return out


def markdown(parts: list[Section], title: str = "HTTP responses") -> str:
    def cell(x) -> str:
        return count_text(x).replace("|", "\\|").replace("\n", " ")

    lines = [f"# {title}", ""]
    for s in parts:
        lines += [f"## {s.title}", "", *[f"> {n}" for n in s.notes]]
        if s.rows:
            lines += ["| " + " | ".join(map(cell, s.columns)) + " |", "|" + " --- |" * len(s.columns)]
            lines += ["| " + " | ".join(map(cell, r)) + " |" for r in s.rows]
        else:
            lines.append("Nothing was found.")
        lines += [f"{s.more:,} more are not shown."] if s.more > 0 else []
        lines.append("")
    return "\n".join(lines)


_STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}"


def page(parts: list[Section], title: str = "HTTP responses") -> str:
    cell = lambda x: html.escape(count_text(x))
    body = [f"<h1>{cell(title)}</h1><nav><ul>", *[f'<li><a href="#{slug(s.title)}">{cell(s.title)}</a></li>' for s in parts], "</ul></nav>"]
    for s in parts:
        body.append(f'<section id="{slug(s.title)}"><h2>{cell(s.title)}</h2>' + "".join(f"<p>{cell(n)}</p>" for n in s.notes))
        if s.rows:
            head = "".join(f"<th>{cell(c)}</th>" for c in s.columns)
            rows = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in s.rows)
            body.append(f"<table><tr>{head}</tr>{rows}</table>")
        else:
            body.append("<p>Nothing was found.</p>")
        body.append(f"<p>{s.more:,} more are not shown.</p>" if s.more > 0 else "")
        body.append("</section>")
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{cell(title)}</title><style>{_STYLE}</style></head><body>{"".join(body)}</body></html>'


def markdown_path(html_path: str) -> str:
    return re.sub(r"\.html?$", "", html_path) + ".md"


def write(of: DataFrame | Tables, html_path: str, markdown_to: str | None = None, title: str = "HTTP responses") -> list[Section]:
    """Both files; the tables behind them are as small as what is shown."""
    parts = sections(of)
    Path(html_path).write_text(page(parts, title), "utf-8")
    Path(markdown_to or markdown_path(html_path)).write_text(markdown(parts, title), "utf-8")
    return parts
