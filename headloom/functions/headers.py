"""Columns over the header list of a response: ``array<struct<name, value>>`` with lower-case names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headloom import config

_OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
CRAWLER = "x-crawler-"
EMPTY = "(none)"


def names(headers: Column) -> Column:
    return F.transform(headers, lambda h: h["name"])


def values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: h["name"] == name), lambda h: h["value"])


def has(headers: Column, name: str) -> Column:
    return F.exists(headers, lambda h: h["name"] == name)


def last_value(headers: Column, name: str) -> Column:
    return F.try_element_at(values(headers, name), F.lit(-1))


def list_items(raw: Column, split: str = ",") -> Column:
    """Trimmed, non-empty members of a list field over all its lines."""
    cut = lambda v: F.split(v, split)
    if split == _OUTSIDE_QUOTES:  # which looks to the end of the line at every comma
        cut = lambda v: F.when(F.contains(v, F.lit('"')), F.split(v, split)).otherwise(F.split(v, ","))
    return F.filter(F.transform(F.flatten(F.transform(raw, cut)), lambda x: F.trim(x)), lambda x: x != "")


def repeated(items: Column) -> Column:
    """Those that occur more than once, each once."""
    once = F.array_distinct(items)
    return F.when(F.size(once) < F.size(items), F.filter(once, lambda x: F.size(F.filter(items, lambda y: y == x)) > 1)).otherwise(F.array().cast("array<string>"))


def recipe(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), ", ")


def recipe_tokens(key: Column) -> Column:
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, ", "))


def bundle(tokens: Column) -> Column:
    key = recipe(tokens)
    return F.when(key == "", EMPTY).otherwise(key)


def vary_tokens(headers: Column) -> Column:
    return F.transform(list_items(values(headers, "vary")), F.lower)


def cache_pairs(headers: Column) -> Column:
    """(name, value) of each Cache-Control directive in order; the value is null where there is none."""
    items = list_items(values(headers, "cache-control"), _OUTSIDE_QUOTES)
    made = F.transform(items, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("name"), F.when(F.instr(x, "=") > 0, F.trim(F.substr(x, F.instr(x, "=") + 1))).alias("value")))
    return F.filter(made, lambda x: x["name"] != "")


def cache_tokens(headers: Column) -> Column:
    """Directives with their values elided: ``max-age=N``."""
    return F.transform(cache_pairs(headers), lambda x: F.when(x["value"].isNotNull() & (x["value"] != "None"), F.concat(x["name"], F.lit("=N"))).otherwise(x["name"]))


def token_name(token: Column) -> Column:
    return F.split_part(token, F.lit("="), F.lit(1))


def pairs(tokens: Column) -> Column:
    """``a, b`` for every two of the sorted distinct tokens."""
    a = F.array_sort(F.array_distinct(tokens))
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.concat(x, F.lit(", "), y))))


def csp_directives(headers: Column) -> Column:
    parts = F.flatten(F.transform(values(headers, "content-security-policy"), lambda v: F.split(v, "[;,]")))
    return F.filter(F.transform(parts, lambda x: F.lower(F.element_at(F.split(F.trim(x), r"\s+"), 1))), lambda x: x != "")


def pragma_no_cache(headers: Column) -> Column:
    words = F.flatten(F.transform(values(headers, "pragma"), lambda v: F.split(F.lower(F.replace(v, F.lit(","), F.lit(" "))), r"\s+")))
    return F.array_contains(words, "no-cache")


def line_bytes(header: Column) -> Column:
    return (F.octet_length(header["name"]) + F.octet_length(header["value"]) + 4).cast("long")


def from_crawler(name: Column) -> Column:
    return name.startswith(CRAWLER)


def is_registered(name: Column) -> Column:
    known = config.fields()
    return name.isin(list(known.standard + known.deprecated))


def category(name: Column) -> Column:
    known = config.fields()
    return F.when(name.isin(list(known.deprecated)), "deprecated").when(name.isin(list(known.standard)), "standard").otherwise("proprietary")


def security_headers(headers: Column) -> Column:
    known = F.array(*[F.lit(x) for x in config.alphabet()])
    return F.array_sort(F.array_intersect(names(headers), known))


def _signal(headers: Column, s: config.Signal) -> Column:
    def hit(h: Column) -> Column:
        if s.contains:
            return (h["name"] == s.header) & F.contains(F.lower(h["value"]), F.lit(s.contains.lower()))
        return (h["name"] == s.header) & h["value"].rlike(f"(?i){s.regex}")

    return F.exists(headers, hit) if s.contains or s.regex else has(headers, s.header)


def matched_layers(headers: Column, asn: Column | None = None, table: tuple[config.Layer, ...] | None = None) -> Column:
    """Ids of all layers that match."""
    made = []
    for layer in table or config.layers():
        tests = []
        for s in layer.signals:
            tests.append(_signal(headers, s))
        if layer.asns and asn is not None:
            tests.append(F.coalesce(asn.isin(list(layer.asns)), F.lit(False)))
        if not tests:
            continue
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        made.append(F.when(test, layer.id))
    return F.array_compact(F.array(*made))


def vendor(name: Column, table: tuple[config.Layer, ...] | None = None) -> Column:
    """Layer that a header name belongs to: one of its presence signals, else its longest prefix."""
    table = table or config.layers()
    exact: dict[str, str] = {}
    prefixes: dict[str, str] = {}
    for layer in table:
        for s in layer.signals:
            if not s.contains and not s.regex:
                exact.setdefault(s.header, layer.id)
        for p in layer.name_prefixes:
            prefixes.setdefault(p, layer.id)
    out = F.when(F.lit(False), "")
    for layer in table:
        own = [h for h, x in exact.items() if x == layer.id]
        if own:
            out = out.when(name.isin(own), layer.id)
    for p in sorted(prefixes, key=lambda p: (-len(p), p)):
        out = out.when(name.startswith(p), prefixes[p])
    return out


def family(name: Column, table: config.Families | None = None) -> Column:
    out = F.when(F.lit(False), "")
    for key, _, prefixes in (table or config.families()).families:
        for p in prefixes:
            out = out.when(name.startswith(p), key)
    return out.otherwise("__other__")


def well_known(name: Column, table: config.Families | None = None) -> Column:
    table = table or config.families()
    test = name.isin(list(table.known_names))
    for p in table.known_prefixes:
        test = test | name.startswith(p)
    return test


def name_prefix(name: Column) -> Column:
    first, second = F.split_part(name, F.lit("-"), F.lit(1)), F.split_part(name, F.lit("-"), F.lit(2))
    return F.when(F.instr(name, "-") == 0, name).when(first == "x", F.concat(F.lit("x-"), second)).otherwise(first)
