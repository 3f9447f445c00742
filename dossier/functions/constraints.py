"""Constraints on JSON values, declared once as nested data and compiled to column expressions.

errors(rule, value) gives all faults of a variant as texts "path: fault", in the order of
the rule: an object's own keys first, then its fields, then the checks between them.
What is missing or of the wrong kind has one fault and is not looked into.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.canonical import json_string
from dossier.functions.text import is_blank

NONE = "array<string>"


@dataclass(frozen=True)
class Text:
    """A text; blank ones, long ones and those that don't fit a pattern are faults where that is said."""

    nullable: bool = False
    blank: bool = False
    most: int | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Flag:
    nullable: bool = False


@dataclass(frozen=True)
class Whole:
    """A whole number, of least at least."""

    nullable: bool = False
    least: int | None = None


@dataclass(frozen=True)
class Items:
    """A list of values that follow one rule."""

    item: Rule
    nullable: bool = False
    least: int = 0


@dataclass(frozen=True)
class Fields:
    """An object: its fields, those of them that may be missing, whether others may be there, and faults between fields."""

    fields: dict[str, Rule]
    optional: tuple[str, ...] = ()
    nullable: bool = False
    others: bool = False
    checks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)  #: fault -> whether the fields (map<string, variant>) have it


Rule = Text | OneOf | Flag | Whole | Items | Fields


def said(fields: Column, name: str) -> Column:
    """A field's text, or null."""
    return F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "string")


def present(fields: Column, name: str) -> Column:
    """Whether a field is there and not null."""
    value = F.try_element_at(fields, F.lit(name))
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


def is_true(fields: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "boolean"), F.lit(False))


def errors(rule: Rule, value: Column, path: Column | str = "$") -> Column:
    """The faults of a variant."""
    return _errors(rule, value, F.lit(path) if isinstance(path, str) else path)


def json_errors(rule: Rule, json: Column) -> Column:
    """The faults of a JSON text; of what is none, or has something after it, one."""
    return _let(_whole(json), lambda value: F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(errors(rule, value)))


def _whole(json: Column) -> Column:
    """The variant of a JSON text that holds one value and nothing else: parsers stop at the value's end, so that it is closed in two ways."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("\n]"))), "$", "array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("\n}")))
    return F.when((F.size(listed) == 1) & held.isNotNull(), F.get(listed, F.lit(0)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fault(bad: Column, path: Column, name: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.array(F.concat(path, F.lit(f": {name}")))).otherwise(F.array().cast(NONE))


def _first(path: Column, *faults: tuple[Column, str]) -> Column:
    """The first of some faults."""
    out = F.array().cast(NONE)
    for bad, name in reversed(faults):
        out = F.when(F.coalesce(bad, F.lit(True)), F.array(F.concat(path, F.lit(f": {name}")))).otherwise(out)
    return out


def _errors(rule: Rule, value: Column, path: Column) -> Column:
    null = F.coalesce(F.is_variant_null(value), F.lit(True))
    kind = F.schema_of_variant(value)
    if isinstance(rule, Fields):
        found = _let(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: F.when(m.isNull(), F.array(F.concat(path, F.lit(": not an object")))).otherwise(_of_fields(rule, m, path)))
    elif isinstance(rule, Items):
        found = _let(F.try_variant_get(value, "$", "array<variant>"), lambda a: F.when(a.isNull(), F.array(F.concat(path, F.lit(": not a list")))).otherwise(_of_items(rule, a, path)))
    elif isinstance(rule, OneOf):
        text = F.try_variant_get(value, "$", "string")
        found = _fault((kind != "STRING") | ~text.isin(*rule.values), path, "not one of the values")
    elif isinstance(rule, Text):
        text = F.try_variant_get(value, "$", "string")
        faults = [(kind != "STRING", "not a text")]
        if not rule.blank:
            faults.append((is_blank(text), "blank"))
        if rule.most is not None:
            faults.append((F.length(text) > rule.most, "too long"))
        if rule.pattern:
            faults.append((~text.rlike(rule.pattern), "bad form"))
        found = _first(path, *faults)
    elif isinstance(rule, Flag):
        found = _fault(kind != "BOOLEAN", path, "not a flag")
    else:
        number = F.try_variant_get(value, "$", "decimal(38,0)")
        whole = (kind == "BIGINT") | F.startswith(kind, F.lit("DECIMAL")) & ~F.to_json(value).contains(".") & ~F.lower(F.to_json(value)).contains("e")
        faults = [(~whole, "not a whole number")]
        if rule.least is not None:
            faults.append((number < rule.least, "too small"))
        found = _first(path, *faults)
    none = F.array().cast(NONE)
    if getattr(rule, "nullable", False):
        return F.when(null, none).otherwise(found)
    wrong = {Fields: "not an object", Items: "not a list", OneOf: "not one of the values", Text: "not a text", Flag: "not a flag", Whole: "not a whole number"}[type(rule)]
    return F.when(null, F.array(F.concat(path, F.lit(f": {wrong}")))).otherwise(found)


def _of_items(rule: Items, items: Column, path: Column) -> Column:
    few = _fault(F.size(items) < rule.least, path, "too few") if rule.least else F.array().cast(NONE)
    return F.concat(few, F.flatten(F.transform(items, lambda x, i: _errors(rule.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))


def _of_fields(rule: Fields, m: Column, path: Column) -> Column:
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    parts = []
    if not rule.others:
        extra = F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, rule.fields))))
        parts.append(F.transform(extra, lambda k: F.concat(path, F.lit(": unknown field "), json_string(k))))
    for name, own in rule.fields.items():
        there = F.map_contains_key(m, F.lit(name))
        missing = F.array().cast(NONE) if name in rule.optional else F.array(F.concat(at(name), F.lit(": missing")))
        parts.append(F.when(~there, missing).otherwise(_errors(own, F.try_element_at(m, F.lit(name)), at(name))))
    parts += [_fault(bad(m), path, name) for name, bad in rule.checks.items()]
    return F.concat(*parts)
