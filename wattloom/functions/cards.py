"""Nested state cards from flat columns, their text, and the check of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section(fields: dict[str, Column]) -> Column:
    """A struct of optional fields; null if all of them are."""
    absent = F.lit(True)
    for c in fields.values():
        absent = absent & c.isNull()
    return F.when(~absent, F.struct(*[c.alias(n) for n, c in fields.items()]))


def card(sections: dict[str, dict[str, Column]]) -> Column:
    """The card: a struct of sections; what is absent is null and left out of its JSON."""
    return F.struct(*[section(f).alias(n) for n, f in sections.items()])


def card_text(sections: dict[str, dict[str, Column]], title: str) -> Column:
    """The card as indented text in the order of its fields; absent fields and sections are left out."""
    parts = [F.lit(title)]
    for name, fields in sections.items():
        lines = [F.concat(F.lit(f"  {n.replace('_', ' ')}: "), c.cast("string")) for n, c in fields.items()]
        body = F.concat_ws("\n", *lines)
        parts.append(F.when(body != "", F.concat(F.lit(f"{name.replace('_', ' ')}:\n"), body)))
    return F.concat_ws("\n", *parts)


def forbidden_keys(schema, tokens: list[str]) -> list[str]:
    """Names anywhere in a schema that contain one of the tokens; checked before anything runs."""
    found = []
    for f in schema.fields:
        found += [f.name] if any(t in f.name.lower() for t in tokens) else []
        kind = getattr(f.dataType, "elementType", f.dataType)
        found += forbidden_keys(kind, tokens) if hasattr(kind, "fields") else []
    return found
