"""Tables that steer the analysis: layers, header families, the co-occurrence alphabet, the field registry.

Each has a packaged default; a path overrides it. A malformed table raises ``ValueError`` before any job starts."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.resources import files
from pathlib import Path


@dataclass(frozen=True)
class Signal:
    """A header's presence, or a text it contains, or a pattern it matches; without regard to case."""

    header: str
    contains: str | None = None
    regex: str | None = None


@dataclass(frozen=True)
class Layer:
    id: str
    role: str
    signals: tuple[Signal, ...] = ()
    asns: tuple[int, ...] = ()
    name_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Families:
    families: tuple[tuple[str, str, tuple[str, ...]], ...]
    known_prefixes: tuple[str, ...] = ()
    known_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Fields:
    standard: tuple[str, ...]
    deprecated: tuple[str, ...]
    request_only: tuple[str, ...]
    single: tuple[str, ...]
    dates: tuple[str, ...]
    cache_directives: tuple[str, ...]
    request_directives: tuple[str, ...]
    cookie_attributes: tuple[str, ...]
    asn_operators: dict[int, str] = field(default_factory=dict, hash=False)


def _load(name: str, path: str | None) -> dict:
    text = Path(path).read_text("utf-8") if path else (files(__package__) / name).read_text("utf-8")
    return tomllib.loads(text)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _words(value, where: str) -> tuple[str, ...]:
    _need(isinstance(value, list) and all(isinstance(x, str) and x for x in value), f"{where} must be a list of non-empty strings")
    return tuple(x.lower() for x in value)


def _text(value, where: str) -> str:
    _need(isinstance(value, str) and bool(value), f"{where} must be a non-empty string")
    return value


def parse_layers(data: dict) -> tuple[Layer, ...]:
    raw = data.get("layer")
    _need(isinstance(raw, list) and bool(raw), "a layer table needs [[layer]] entries")
    out: list[Layer] = []
    for x in raw:
        name = _text(x.get("id"), "layer id")
        _need(name not in {y.id for y in out}, f"layer {name} is given twice")
        signals = []
        _need(isinstance(x.get("signals", []), list), f"{name}: signals must be a list")
        for s in x.get("signals", []):
            _need(isinstance(s, dict), f"{name}: a signal must be a table")
            _need(not ("contains" in s and "regex" in s), f"{name}: a signal has contains or regex, not both")
            if "regex" in s:
                try:
                    re.compile(_text(s["regex"], f"{name}: regex"))
                except re.error as e:
                    raise ValueError(f"{name}: {e}") from e
            if "contains" in s:
                _text(s["contains"], f"{name}: contains")
            signals.append(Signal(_text(s.get("header"), f"{name}: header").lower(), s.get("contains"), s.get("regex")))
        asns = x.get("asns", [])
        _need(isinstance(asns, list) and all(isinstance(a, int) and not isinstance(a, bool) for a in asns), f"{name}: asns must be whole numbers")
        prefixes = _words(x.get("name_prefixes", []), f"{name}: name_prefixes")
        _need(bool(signals or asns), f"{name}: neither signals nor asns")
        out.append(Layer(name, _text(x.get("role"), f"{name}: role"), tuple(signals), tuple(asns), prefixes))
    return tuple(out)


def parse_families(data: dict) -> Families:
    raw = data.get("family")
    _need(isinstance(raw, list) and bool(raw), "a family table needs [[family]] entries")
    out: list[tuple[str, str, tuple[str, ...]]] = []
    for x in raw:
        name = _text(x.get("id"), "family id")
        _need(name not in {y[0] for y in out}, f"family {name} is given twice")
        out.append((name, _text(x.get("label"), f"{name}: label"), _words(x.get("prefixes", []), f"{name}: prefixes")))
    known = data.get("well_known", {})
    return Families(tuple(out), _words(known.get("prefixes", []), "well_known prefixes"), _words(known.get("names", []), "well_known names"))


def parse_alphabet(data: dict) -> tuple[str, ...]:
    found = _words(data.get("headers"), "headers")
    _need(bool(found), "an alphabet needs headers")
    return tuple(dict.fromkeys(found))


@lru_cache
def layers(path: str | None = None) -> tuple[Layer, ...]:
    return parse_layers(_load("layers.toml", path))


@lru_cache
def families(path: str | None = None) -> Families:
    return parse_families(_load("families.toml", path))


@lru_cache
def alphabet(path: str | None = None) -> tuple[str, ...]:
    return parse_alphabet(_load("alphabet.toml", path))


@lru_cache
def fields(path: str | None = None) -> Fields:
    data = _load("fields.toml", path)
    names = [k for k in Fields.__dataclass_fields__ if k != "asn_operators"]
    return Fields(**{k: _words(data.get(k), k) for k in names}, asn_operators={int(k): v for k, v in data.get("asn_operators", {}).items()})
