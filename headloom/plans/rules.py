"""Lint rules as columns.

A rule reads one of ``PARTS``, taken once from the header list of a response, and gives the findings of one note id: an array of maps of variables,
one for each time it fires. A child fires only where its parent does. Thresholds are our own, from RFC 9110, 9111,
6265, 6797, 9651 and CSP level 3, and stand beside the rule they belong to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from headloom import config
from headloom.functions import headers as H
from headloom.functions import structured as SF
from headloom.functions.counting import let
from headloom.functions.text import http_date

RANK = {"bad": 4, "warn": 3, "info": 2, "good": 1}
MAX_FIELD = 8192  # bytes of one header line
MAX_COOKIE = 4096  # bytes of a cookie's value, RFC 6265 section 6.1
LONG_COOKIE = 400 * 86400  # seconds
SHORT_HSTS = 180 * 86400  # seconds
MANY_VARY = 5  # members


def _vars(**kw: Column) -> Column:
    return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))])


NONE = "cast(array() as array<map<string, string>>)"
_NO_FINDING = "cast(array() as array<struct<note_id: string, level: string, ancestors: array<string>, vars: map<string, string>>>)"


def _if(test: Column, **kw: Column) -> Column:
    one = F.array(_vars(**kw)) if kw else F.array(F.create_map().cast("map<string,string>"))
    return F.when(test, one).otherwise(F.expr(NONE))


def _each(items: Column, made: Callable[[Column], Column]) -> Column:
    return F.transform(items, made)


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    category: str
    summary: str
    fires: Callable[[Column], Column] | None  # none: what a scan of bodies finds
    parent: str | None = None  # of the same ``reads``
    reads: str = "lines"


def _among(names: Column, known: tuple[str, ...]) -> Column:
    return F.filter(names, lambda n: n.isin(list(known)))


def _cookie(v: Column) -> Column:
    # by splits, as a search for a character in columns takes long over long values
    def read(x: Column) -> Column:  # of pair: name and value; rest: attributes
        return F.struct(
            F.trim(F.get(x["pair"], F.lit(0))).alias("name"),
            F.coalesce(F.get(x["pair"], F.lit(1)), F.lit("")).alias("value"),
            F.filter(F.transform(x["rest"], lambda a: F.lower(F.trim(F.substring_index(a, "=", 1)))), lambda a: a != "").alias("attributes"),
            F.regexp_extract(F.concat(F.lit(";"), F.array_join(x["rest"], ";")), r"(?i);\s*max-age\s*=\s*(-?\d+)", 1).try_cast("long").alias("max_age"),
        )

    return let(F.split(v, ";"), lambda bits: let(F.struct(F.split(F.get(bits, F.lit(0)), "=", 2).alias("pair"), F.slice(bits, F.lit(2), F.size(bits)).alias("rest")), read))


def _lines(x: Column) -> Column:
    """Of headers and names: also those that name rules read, and lines that are odd or whose values have a form."""
    known = config.fields()
    h = x["headers"]
    odd = F.filter(h, lambda l: (H.line_bytes(l) > MAX_FIELD) | ~l["name"].rlike(_TOKEN))
    formed = F.filter(h, lambda l: l["name"].isin([*_NUMBERS, *known.dates, *_WORDS]))
    return F.struct(h.alias("headers"), x["names"].alias("names"), F.array_distinct(x["names"]).alias("distinct"), odd.alias("odd"), formed.alias("formed"))


def _hsts(x: Column) -> Column:
    text = F.lower(H.last_value(x["headers"], "strict-transport-security"))
    return let(text, lambda t: F.struct(t.alias("text"), F.regexp_extract(t, r"max-age\s*=\s*\"?(\d+)", 1).try_cast("long").alias("age")))


#: What rules read: the fields without which none of them fires (none: always read), and what is taken once from headers and names.
PARTS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "lines": ((), _lines),
    "vary": (("vary",), lambda x: H.vary_tokens(x["headers"])),
    "cc": (("cache-control",), lambda x: H.cache_pairs(x["headers"])),
    "hsts": (("strict-transport-security",), _hsts),
    "csp": (("content-security-policy",), lambda x: F.transform(H.values(x["headers"], "content-security-policy"), F.lower)),
    "corp": (("cross-origin-resource-policy",), lambda x: H.values(x["headers"], "cross-origin-resource-policy")),
    "structured": (tuple(SF.TYPES), lambda x: SF.fields(x["headers"])),
    "cookies": (("set-cookie",), lambda x: F.transform(H.values(x["headers"], "set-cookie"), _cookie)),
}


def _max_age(cc: Column) -> Column:
    found = F.filter(cc, lambda x: x["name"] == "max-age")
    return F.try_element_at(found, F.lit(1))["value"].try_cast("long")


def _csp(csp: Column, word: str) -> Column:
    return F.exists(csp, lambda v: F.contains(v, F.lit(word)))


_TOKEN = r"^[!#$%&'*+.^_`|~0-9a-z-]+$"
_NUMBERS = ["age", "content-length"]
_WORDS = ["x-content-type-options", "x-frame-options"]
_CORP = ["same-site", "same-origin", "cross-origin"]


def rules() -> list[Rule]:
    known = config.fields()
    name = lambda x: x["name"]
    return [
        Rule("FIELD_DEPRECATED", "warn", "GENERAL", "A deprecated field is sent.", lambda p: _each(_among(p["distinct"], known.deprecated), lambda n: _vars(field_name=n))),
        Rule("REQUEST_HDR_IN_RESPONSE", "bad", "GENERAL", "A request field is in a response.", lambda p: _each(_among(p["distinct"], known.request_only), lambda n: _vars(field_name=n))),
        Rule("SINGLE_HEADER_REPEAT", "bad", "GENERAL", "A single-value field is repeated.", lambda p: _each(H.repeated(_among(p["names"], known.single)), lambda n: _vars(field_name=n))),
        Rule("FIELD_TOO_LARGE", "warn", "GENERAL", "A header line is very long.", lambda p: _each(F.filter(p["odd"], lambda x: H.line_bytes(x) > MAX_FIELD), lambda x: _vars(field_name=x["name"], field_size=H.line_bytes(x)))),
        Rule("BAD_SYNTAX", "bad", "GENERAL", "A field name is no token.", lambda p: _each(F.filter(p["odd"], lambda x: ~x["name"].rlike(_TOKEN)), lambda x: _vars(field_name=x["name"]))),
        Rule("BAD_SYNTAX_DETAILED", "bad", "GENERAL", "A number field holds no number.", lambda p: _each(F.filter(p["formed"], lambda x: x["name"].isin(_NUMBERS) & ~F.trim(x["value"]).rlike(r"^\d+$")), lambda x: _vars(field_name=x["name"], value=x["value"]))),
        Rule("BAD_DATE_SYNTAX", "bad", "GENERAL", "A date field holds no date.", lambda p: _each(F.filter(p["formed"], lambda x: x["name"].isin(list(known.dates)) & http_date(x["value"]).isNull()), lambda x: _vars(field_name=x["name"]))),
        Rule("UNKNOWN_VALUE", "warn", "GENERAL", "A field holds a value that is not defined.", lambda p: _each(F.filter(p["formed"], lambda x: ((x["name"] == "x-content-type-options") & (F.lower(F.trim(x["value"])) != "nosniff")) | ((x["name"] == "x-frame-options") & ~F.lower(F.trim(x["value"])).isin("deny", "sameorigin"))), lambda x: _vars(field_name=x["name"], value=x["value"]))),
        Rule("CONTENT_TYPE_MISMATCH", "warn", "GENERAL", "Markup is declared as plain text.", lambda p: _if(F.array_contains(p["names"], "content-type") & F.array_contains(p["names"], "link") & F.exists(H.values(p["headers"], "content-type"), lambda v: F.lower(v).startswith("text/plain")) & F.exists(H.values(p["headers"], "link"), lambda v: F.contains(v, F.lit("rel=canonical"))), sniffed_type=F.lit("text/html"), declared_type=F.lit("text/plain"))),
        Rule("VARY_COMPLEX", "warn", "CONNEG", "Vary has many members.", lambda p: _if(F.size(p) > MANY_VARY, vary_count=F.size(p)), reads="vary"),
        Rule("VARY_ASTERISK", "warn", "CONNEG", "Vary is a wildcard.", lambda p: _if(F.array_contains(p, "*")), reads="vary"),
        Rule("CC_DUP", "warn", "CACHING", "A cache directive is repeated.", lambda p: _each(H.repeated(F.transform(p, name)), lambda n: _vars(directive=n)), reads="cc"),
        Rule("BAD_CC_SYNTAX", "bad", "CACHING", "A cache directive's number is no number.", lambda p: _each(F.filter(p, lambda x: x["name"].isin("max-age", "s-maxage", "stale-while-revalidate", "stale-if-error") & ~F.coalesce(x["value"].rlike(r"^\"?\d+\"?$"), F.lit(False))), lambda x: _vars(bad_directive=x["name"])), reads="cc"),
        Rule("CC_WRONG_MESSAGE", "bad", "CACHING", "A request directive is in a response.", lambda p: _each(F.filter(p, lambda x: x["name"].isin(list(known.request_directives))), lambda x: _vars(directive=x["name"], other_message=F.lit("request"))), reads="cc"),
        Rule("CC_CONFLICTING", "warn", "CACHING", "Cache directives contradict each other.", lambda p: _if(F.array_contains(F.transform(p, name), "no-store") & F.exists(p, lambda x: x["name"].isin("max-age", "s-maxage", "public")), directive=F.lit("no-store"), conflicts=F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(p, lambda x: x["name"].isin("max-age", "s-maxage", "public")), name))), "\n")), reads="cc"),
        Rule("FRESHNESS_FRESH", "good", "CACHING", "The response declares how long it is fresh.", lambda p: _if(F.coalesce(_max_age(p) > 0, F.lit(False)), freshness_left=_max_age(p)), reads="cc"),
        Rule("HSTS_VALID", "good", "SECURITY", "Strict transport security is set.", lambda p: _if(p["age"].isNotNull()), reads="hsts"),
        Rule("HSTS_NO_SUBDOMAINS", "info", "SECURITY", "Subdomains are left out.", lambda p: _if(~F.contains(p["text"], F.lit("includesubdomains"))), "HSTS_VALID", reads="hsts"),
        Rule("HSTS_SHORT_MAX_AGE", "warn", "SECURITY", "The lifetime is short.", lambda p: _if(p["age"] < SHORT_HSTS), "HSTS_VALID", reads="hsts"),
        Rule("CONTENT_SECURITY_POLICY", "info", "SECURITY", "A content security policy is set.", lambda p: _if(F.size(p) > 0), reads="csp"),
        Rule("CSP_UNSAFE_INLINE", "warn", "SECURITY", "Inline scripts are allowed.", lambda p: _if(_csp(p, "'unsafe-inline'")), "CONTENT_SECURITY_POLICY", reads="csp"),
        Rule("CSP_UNSAFE_EVAL", "warn", "SECURITY", "Evaluation of text is allowed.", lambda p: _if(_csp(p, "'unsafe-eval'")), "CONTENT_SECURITY_POLICY", reads="csp"),
        Rule("CROSS_ORIGIN_RESOURCE_POLICY_BAD_VALUE", "bad", "SECURITY", "The resource policy has no defined value.", lambda p: _each(F.filter(p, lambda v: ~F.lower(F.trim(v)).isin(_CORP)), lambda v: _vars(value=v)), reads="corp"),
        Rule("STRUCTURED_FIELD_PARSE_ERROR", "bad", "GENERAL", "A structured field does not parse.", lambda p: _each(F.filter(p, lambda x: x["parsed"]["error"].isNotNull()), _parse_error), reads="structured"),
        Rule("DUPLICATE_KEY", "warn", "GENERAL", "A structured field repeats a key.", _duplicate_keys, reads="structured"),
        Rule("SET_COOKIE_UNKNOWN_ATTRIBUTE", "info", "COOKIES", "A cookie has an unknown attribute.", lambda p: F.flatten(F.transform(p, lambda c: F.transform(F.filter(c["attributes"], lambda a: ~a.isin(list(known.cookie_attributes))), lambda a: _vars(cookie_name=c["name"], attribute=a)))), reads="cookies"),
        Rule("SET_COOKIE_LIFETIME_TOO_LONG", "warn", "COOKIES", "A cookie lives very long.", lambda p: _each(F.filter(p, lambda c: c["max_age"] > LONG_COOKIE), lambda c: _vars(cookie_name=c["name"], duration=c["max_age"])), reads="cookies"),
        Rule("SET_COOKIE_VALUE_TOO_LARGE", "warn", "COOKIES", "A cookie's value is very long.", lambda p: _each(F.filter(p, lambda c: F.octet_length(c["value"]) > MAX_COOKIE), lambda c: _vars(cookie_name=c["name"], set_cookie_value_length=F.octet_length(c["value"]))), reads="cookies"),
    ]


def _parse_error(x: Column) -> Column:
    near = F.left(x["value"], F.lit(70))
    return _vars(field_name=x["name"], problem=F.concat(x["parsed"]["error"], F.lit("\nin "), near), context=near, place=x["parsed"]["at"])


def _duplicate_keys(p: Column) -> Column:
    sound = F.filter(p, lambda x: x["parsed"]["error"].isNull())
    return F.flatten(F.transform(sound, lambda x: F.transform(SF.repeated(x["parsed"]["keys"]), lambda k: _vars(field_name=x["name"], key=k))))


#: Raised where a body is read (``sources.bodies``), not from header lists.
BODY = [
    Rule("BAD_GZIP", "bad", "GENERAL", "A gzip body can't be unpacked.", None),
    Rule("BAD_BROTLI", "bad", "GENERAL", "A Brotli body can't be unpacked.", None),
    Rule("BAD_ZLIB", "bad", "GENERAL", "A deflate body can't be unpacked.", None),
    Rule("CL_INCORRECT", "bad", "GENERAL", "The declared length isn't that of the body.", None),
]
#: Notes that only a request, or only a body, can raise.
REQUEST_ONLY = ["MISSING_USER_AGENT", "REQUEST_CONTENT_NOT_DEFINED", "URI_BAD_SYNTAX", "URI_TOO_LONG", "RESPONSE_HDR_IN_REQUEST", "CORS_PREFLIGHT_REQUEST", "CORS_PREFLIGHT_REQ_METHOD_WRONG", "CORS_PREFLIGHT_REQ_NO_ORIGIN", "CORS_PREFLIGHT_REQ_NO_METHOD"]
BODY_ONLY = [r.id for r in BODY]
#: The variables whose values are counted, by note.
TRACKED = {
    "FIELD_DEPRECATED": ["field_name"],
    "SET_COOKIE_UNKNOWN_ATTRIBUTE": ["attribute"],
    "REQUEST_HDR_IN_RESPONSE": ["field_name"],
    "BAD_SYNTAX": ["field_name"],
    "CONTENT_TYPE_MISMATCH": ["sniffed_type", "declared_type"],
    "VARY_COMPLEX": ["vary_count"],
    "BAD_DATE_SYNTAX": ["field_name"],
    "SINGLE_HEADER_REPEAT": ["field_name"],
    "CC_DUP": ["directive"],
    "STRUCTURED_FIELD_PARSE_ERROR": ["field_error", "field_name"],
    "BAD_CC_SYNTAX": ["bad_directive"],
    "UNKNOWN_VALUE": ["field_name", "value"],
    "CROSS_ORIGIN_RESOURCE_POLICY_BAD_VALUE": ["value"],
    "BAD_SYNTAX_DETAILED": ["field_name"],
    "CC_WRONG_MESSAGE": ["other_message"],
    "CC_CONFLICTING": ["directive_conflicts"],
    "DUPLICATE_KEY": ["field_name", "field_name_key"],
    "FRESHNESS_FRESH": ["freshness_left_bucket"],
    "SET_COOKIE_LIFETIME_TOO_LONG": ["duration_bucket"],
    "SET_COOKIE_VALUE_TOO_LARGE": ["cookie_value_size_bucket"],
    "FIELD_TOO_LARGE": ["field_name", "field_size_bucket"],
}


@lru_cache
def notes_of(column: str) -> Column:
    """``notes`` of a column, built once: it is some thousand calls to the engine, and the same for every table."""
    return notes(F.col(column))


def notes(headers: Column) -> Column:
    """All findings of a response: array of (note_id, level, ancestors, vars), in the order of the rules."""
    table = {r.id: r for r in rules()}

    def found(x: Column) -> Column:
        out = []
        for part, group in groupby(table.values(), lambda r: r.reads):
            fields, made = PARTS[part]
            some = let(made(x), partial(_all_fired, list(group), table))
            named = [F.array_contains(x["names"], f) for f in fields] if len(fields) == 1 else [F.exists(x["names"], lambda n: n.isin(list(fields)))] if fields else []
            out.append(F.when(named[0], some).otherwise(F.expr(_NO_FINDING)) if named else some)
        return F.concat(*out)

    return let(F.struct(headers.alias("headers"), H.names(headers).alias("names")), found)


def _all_fired(group: list[Rule], table: dict[str, Rule], p: Column) -> Column:
    return F.concat(*[_fired(r, table, p) for r in group])


def _fired(r: Rule, table: dict[str, Rule], p: Column) -> Column:
    made, ancestors, above = r.fires(p), [], r.parent
    while above:
        ancestors.insert(0, above)
        made = F.when(F.size(table[above].fires(p)) > 0, made).otherwise(F.expr(NONE))
        above = table[above].parent
    line = F.array(*[F.lit(a) for a in ancestors]) if ancestors else F.array().cast("array<string>")
    return F.transform(F.coalesce(made, F.expr(NONE)), _finding(r, line))


def _finding(rule: Rule, ancestors: Column) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(rule.id).alias("note_id"), F.lit(rule.level).alias("level"), ancestors.alias("ancestors"), v.alias("vars"))
