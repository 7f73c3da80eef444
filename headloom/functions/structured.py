"""Structured fields (RFC 9651) as columns: a lexer and an automaton over its lexemes, both inside the engine.

No structure nests deeper than an inner list, so the grammar is regular. ``LEXEME`` cuts a field into strings, numbers,
names, separators and so on, each of one class; a pattern of the same lexemes knows a sound field. Of any other, a fold
over the lexemes walks a table (state, class) -> state, and the state in which it stops says what was expected there. Work is
in proportion to a field's length, and patterns loop over a whole field only possessively, so long ones can't exhaust the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions.counting import let

#: Fields and their top-level types.
TYPES = {
    "accept-ch": "list", "cache-status": "list", "content-digest": "dict", "critical-ch": "list", "cross-origin-embedder-policy": "item", "cross-origin-opener-policy": "item",
    "document-policy": "dict", "origin-agent-cluster": "item", "permissions-policy": "dict", "priority": "dict", "proxy-status": "list", "reporting-endpoints": "dict", "repr-digest": "dict",
    "signature": "dict", "signature-input": "dict",
}

_KEY = "[a-z*][a-z0-9_.*-]*+"
_TOKEN = "[A-Za-z*][!#$%&'*+.^_`|~:/0-9A-Za-z-]*+"
_VALUES = [
    r'"[\x20\x21\x23-\x5B\x5D-\x7E]*+(?:\\["\\][\x20\x21\x23-\x5B\x5D-\x7E]*+)*+"',  # string
    r'%"[\x20\x21\x23\x24\x26-\x7E]*+(?:%[0-9a-f]{2}[\x20\x21\x23\x24\x26-\x7E]*+)*+"',  # display string
    r":[A-Za-z0-9+/=]*+:",  # bytes
    r"@-?[0-9]{1,15}(?![0-9.])",  # date
    r"-?(?:[0-9]{1,15}(?![0-9.])|[0-9]{1,12}\.[0-9]{1,3}(?![0-9.]))",  # number
    r"\?[01]",  # boolean
]
LEXEME = "(?s)" + "|".join([*_VALUES, _TOKEN, "[ \\t]*+,[ \\t]*+", "; *+", "=", r"[()]", " ++", "."])

# Classes: v value, k name that may be a key, t other token, then comma, semicolon, equals sign, brackets, blanks, x what fits nowhere.
_CLASSES = "vkt,;=() x"
_ANY = "vkt"
# States: what is read next. S start, M member, K after a member's key, V its value, I after a value, P a parameter's name, Q after it, R its value;
# N in an inner list, J after one of its items, p, q, r as P, Q, R there; E nothing fits.
_STATES = "SMKVIPQRNJpqrE"
_INSIDE = {
    "I": {";": "P"}, "P": {"k": "Q"}, "Q": {"=": "R", ";": "P"}, "R": {_ANY: "I"},
    "N": {_ANY: "J", " ": "N", ")": "I"}, "J": {";": "p", " ": "N", ")": "I"}, "p": {"k": "q"}, "q": {"=": "r", ";": "p", " ": "N", ")": "I"}, "r": {_ANY: "J"},
}
_TOP = {
    "item": {"S": {_ANY: "I"}},
    "list": {"S": {_ANY: "I", "(": "N"}, "M": {_ANY: "I", "(": "N"}, "I": {",": "M"}, "Q": {",": "M"}},
    "dict": {"S": {"k": "K"}, "M": {"k": "K"}, "K": {"=": "V", ";": "P", ",": "M"}, "V": {_ANY: "I", "(": "N"}, "I": {",": "M"}, "Q": {",": "M"}},
}
_ENDS = {"item": "IQ", "list": "SIQ", "dict": "SKIQ"}
_EXPECTED = {
    "S": "member expected", "M": "member expected", "K": "value, parameter or comma expected", "V": "value expected", "I": "parameter or comma expected", "P": "parameter name expected",
    "Q": "parameter value or comma expected", "R": "parameter value expected", "N": "inner list is not closed", "J": "blank or end of inner list expected", "p": "parameter name expected",
    "q": "parameter value or end of inner list expected", "r": "parameter value expected",
}


def table(kind: str) -> str:
    """The next state for every state and class, state by state."""
    out = []
    for state in _STATES:
        moves = {c: to for part in (_INSIDE, _TOP[kind]) for keys, to in part.get(state, {}).items() for c in keys}
        out += [moves.get(c, "E") for c in _CLASSES]
    return "".join(out)


#: By the code of its first character, what a lexeme can be: a class, or a (key or token), q (value, where it goes on), b (comma or blank).
_FIRST = "".join("a" if c in "abcdefghijklmnopqrstuvwxyz*" else "t" if c.isalpha() else "v" if c.isdigit() else "q" if c in '"%:@-?' else "b" if c in " \t" else c if c in ",;=()" else "x" for c in map(chr, range(128)))
# Sound fields and the members of a dictionary as patterns. They are what the automaton takes, lexeme by lexeme; every
# loop over lexemes is possessive, so none backtracks or recurs.
_BARE = "(?:" + "|".join([*_VALUES, _TOKEN]) + ")"
_PARAMS = f"(?:; *+{_KEY}(?:={_BARE})?+)*+"
_VALUE = rf"(?:{_BARE}|\( *+(?:{_BARE}{_PARAMS}(?: ++|(?=\))))*+\))"
_COMMA = r"[ \t]*+,[ \t]*+"
_PART = {"list": f"{_VALUE}{_PARAMS}", "dict": f"{_KEY}(?:={_VALUE})?+{_PARAMS}"}
SOUND = {"item": rf"\A{_BARE}{_PARAMS}\z"} | {kind: rf"\A(?:{x}(?:{_COMMA}{x})*+)?+\z" for kind, x in _PART.items()}
MEMBER = rf"({_KEY})(?:={_VALUE})?+{_PARAMS}(?:{_COMMA}|\z)"


def _class(lexeme: Column) -> Column:
    """Its class, out of ``_CLASSES``."""

    def put(c: Column) -> Column:
        out = F.when(c == "a", F.when(lexeme.rlike(f"^{_KEY}$"), "k").otherwise("t")).when(c == "q", F.when(F.length(lexeme) > 1, "v").otherwise("x"))
        return out.when(c == "b", F.when(F.contains(lexeme, F.lit(",")), ",").when(lexeme.startswith(" "), " ").otherwise("x")).when(c == "", "x").otherwise(c)

    return let(F.substring(F.lit(_FIRST), F.ascii(lexeme) + 1, 1), put)


def _by_kind(kind: Column, made: Callable[[str], Column]) -> Column:
    out = F
    for k in _TOP:
        out = out.when(kind == k, made(k))
    return out


def _walk(classes: Column, kind: Column) -> Column:
    """(state, n, stuck): the last state that fits, after n lexemes."""
    start = F.struct(F.lit("S").alias("state"), F.lit(0).alias("n"), F.lit(False).alias("stuck"))

    def step(tables: Column, acc: Column, c: Column) -> Column:
        to = F.element_at(tables, (F.instr(F.lit(_STATES), acc["state"]) - 1) * len(_CLASSES) + F.instr(F.lit(_CLASSES), c))
        moved = let(to, lambda t: F.when(t == "E", F.struct(acc["state"].alias("state"), acc["n"].alias("n"), F.lit(True).alias("stuck"))).otherwise(F.struct(t.alias("state"), (acc["n"] + 1).alias("n"), F.lit(False).alias("stuck"))))
        return F.when(acc["stuck"], acc).otherwise(moved)

    tables = _by_kind(kind, lambda k: F.array(*[F.lit(x) for x in table(k)]))
    return let(tables, lambda t: F.aggregate(classes, start, lambda acc, c: step(t, acc, c)))


def _broken(text: Column, kind: Column) -> Column:
    """What ``parse`` says of a field that isn't sound."""
    said = F.create_map(*[x for s, t in _EXPECTED.items() for x in (F.lit(s), F.lit(t))])

    def read(x: Column) -> Column:  # of lexemes, classes
        def told(e: Column) -> Column:
            # of a dictionary's lexemes that fit, those at the start and after commas are keys
            key = lambda lexeme, i: (i < e["n"]) & F.when(i == 0, True).otherwise(F.get(x["classes"], i - 1) == ",")
            keys = F.when(kind == "dict", F.filter(x["lexemes"], key)).otherwise(F.array().cast("array<string>"))
            at = F.length(F.array_join(F.slice(x["lexemes"], F.lit(1), e["n"]), ""))
            return F.struct(at.alias("at"), keys.alias("keys"), F.element_at(said, e["state"]).alias("error"))

        return let(_walk(x["classes"], kind), told)

    lexemes = F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))
    return let(lexemes, lambda found: let(F.struct(found.alias("lexemes"), F.transform(found, _class).alias("classes")), read))


def parse(value: Column, kind: Column) -> Column:
    """(at, keys, error) of a field of type ``kind``: ``error`` is null where it parses, else what was expected
    at the place ``at`` (from 0, in characters, blanks around the field aside); ``keys`` are a dictionary's, in order."""

    def read(x: Column) -> Column:
        text, kind = x["text"], x["kind"]
        keys = F.when(kind == "dict", F.regexp_extract_all(text, F.lit(MEMBER), F.lit(1))).otherwise(F.array().cast("array<string>"))
        sound = F.struct(F.length(text).alias("at"), keys.alias("keys"), F.lit(None).cast("string").alias("error"))
        return F.when(_by_kind(kind, lambda k: text.rlike(SOUND[k])), sound).otherwise(_broken(text, kind))

    return let(F.struct(F.trim(value).alias("text"), kind.alias("kind")), read)


def fields(headers: Column) -> Column:
    """name, value, and what ``parse`` says, of every structured field; a list or dictionary may come on several lines."""
    found = F.filter(F.array_distinct(F.transform(headers, lambda h: h["name"])), lambda n: n.isin(list(TYPES)))
    kinds = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])

    def whole(n: Column) -> Column:
        return F.array_join(F.transform(F.filter(headers, lambda h: h["name"] == n), lambda h: h["value"]), ", ")

    def read(n: Column) -> Column:
        return let(whole(n), lambda v: F.struct(n.alias("name"), v.alias("value"), parse(v, F.element_at(kinds, n)).alias("parsed")))

    return F.transform(found, read)


def repeated(keys: Column) -> Column:
    return H.repeated(keys)
