"""JSON records in text columns: parsing, canonical form, hashes, validation and text checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

DECISION = "e array<double>, b array<double>, g array<double>, cf array<double>, i double, a double, p array<double>, q double"
KEYS = ("a", "b", "cf", "e", "g", "i", "p", "q")


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, no escapes of letters; null where the text is no JSON or holds NaN."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return text.map(one)


def sha256(text: Column) -> Column:
    """Hex SHA-256 of UTF-8 text."""
    return F.sha2(text, 256)


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first complete JSON object inside a text, as it is written; null if there is none."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                value, end = decoder.raw_decode(t, at)
            except ValueError:
                pass
            else:
                if isinstance(value, dict):
                    return t[at:end]
            at = t.find("{", at + 1)
        return None

    return text.map(one)


def repeated_root_keys(text: Column) -> Column:
    """How many keys of the root object are repeats; null for anything but an object."""
    keys = F.when(is_json(text), F.json_object_keys(text))
    return F.size(keys) - F.size(F.array_distinct(keys))


def brackets(text: Column) -> Column:
    """struct(open_braces, open_brackets, unmatched_close, unclosed_string, balanced): brackets outside of strings, matched last opened first closed."""
    bare = F.regexp_replace(text, r'(?s)"(?:[^"\\]++|\\.)*+"', "")
    unclosed = bare.contains('"')
    only = F.regexp_replace(F.regexp_replace(bare, r'(?s)".*$', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("bad"))

    def step(s: Column, c: Column) -> Column:
        top = F.right(s["open"], F.lit(1))
        fits = ((top == "{") & (c == "}")) | ((top == "[") & (c == "]"))
        opened = F.struct(F.concat(s["open"], c).alias("open"), s["bad"].alias("bad"))
        closed = F.struct(F.left(s["open"], F.length(s["open"]) - 1).alias("open"), s["bad"].alias("bad"))
        return F.when(c.isin("{", "["), opened).when(fits, closed).otherwise(F.struct(s["open"].alias("open"), (s["bad"] + 1).alias("bad")))

    end = F.aggregate(F.filter(F.split(only, ""), lambda c: c != ""), start, step)
    left = lambda c: F.length(F.regexp_replace(end["open"], rf"[^{c}]", ""))
    return F.struct(
        left("{").alias("open_braces"), left(r"\[").alias("open_brackets"), end["bad"].alias("unmatched_close"), unclosed.alias("unclosed_string"), ((end["open"] == "") & (end["bad"] == 0) & ~unclosed).alias("balanced")
    )


def is_json(text: Column) -> Column:
    """The whole text is one JSON value (parsers stop after a first value; as the only element of a list nothing may follow it)."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def _in_a_row(a: Column, step: int, n: int) -> Column:
    """``n`` elements in a row equal the ones ``step`` further on."""
    m = F.size(a) - step
    same = F.zip_with(F.slice(a, F.lit(1), F.greatest(m, F.lit(0))), F.slice(a, F.lit(step + 1), F.greatest(m, F.lit(0))), lambda x, y: F.when(x == y, "1").otherwise("0"))
    return (m >= n) & F.array_join(same, "").contains("1" * n)


@F.pandas_udf(BooleanType())
def _repeated_chunk(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and repeated_stretch(t))


def repeated_stretch(text: str, least: int = 24) -> bool:
    """A stretch of at least ``least`` characters comes three times in a row; white space counts as one blank.

    Such a run has a position that is a multiple of ``least`` in its first stretch, whose next ``least`` characters come
    again one stretch later: only the distances of such repeats are tried, each by how far the text agrees with itself.
    """
    text = " ".join(text.split())
    at: dict[str, list[int]] = {}
    for i in range(0, len(text) - 2 * least + 1, least):
        at.setdefault(text[i : i + least], []).append(i)
    seen: set[tuple[int, int]] = set()  # (distance, end of the agreement) already tried
    for j in range(least, len(text) - least + 1):
        for i in at.get(text[j : j + least], ()):
            d = j - i
            if d < least or (d, i) in seen:
                continue
            low, high = i, j + least
            while low > 0 and text[low - 1] == text[low - 1 + d]:
                low -= 1
            while high < len(text) and text[high] == text[high - d]:
                high += 1
            if high - low >= 3 * d:
                return True
            seen.update((d, k) for k in range(i, high - d - least + 1, least))
    return False


def repetition(text: Column) -> Column:
    """struct(chunk, line, ngram, any): 24 characters or more three times in a row, three equal lines in a row, or three to eight words three times in a row; valid JSON objects and lists don't count."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    json_text = is_json(text) & F.trim(text).rlike(r"^[\[{]")
    line, ngram = _in_a_row(lines, 1, 2), F.lit(False)
    for n in range(3, 9):
        ngram = ngram | _in_a_row(words, n, 2 * n)
    flags = {"chunk": _repeated_chunk(text), "line": line, "ngram": ngram}
    flags["any"] = flags["chunk"] | flags["line"] | flags["ngram"]
    return F.struct(*[(~json_text & c).alias(k) for k, c in flags.items()])


def repeats(text: Column) -> Column:
    """The text repeats itself, in any of the ways of ``repetition``."""
    return repetition(text)["any"]


def undecorated(text: Column) -> Column:
    """Code fences, control tokens and outer blanks taken off."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<\|[^|>]*\|>", ""), r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def _whole(a: Column, low: int, high: int, sizes: tuple[int, int]) -> Column:
    return a.isNotNull() & F.size(a).between(*sizes) & F.forall(a, lambda x: x.isNotNull() & (x == F.floor(x)) & x.between(low, high))


def decision_error(text: Column) -> Column:
    """The first rule a decision record breaks, null for a valid one: not JSON, other keys, or a field out of its range."""
    r = F.from_json(text, DECISION)
    one = lambda c, high: c.isNotNull() & (c == F.floor(c)) & c.between(0, high)
    whole = F.json_object_keys(text)
    sums = F.abs(F.aggregate(r["b"], F.lit(0.0), lambda s, x: s + x) - 1) <= 1e-5
    return (
        F.when(text.isNull() | ~is_json(text) | whole.isNull(), "not_an_object")
        .when(F.array_sort(whole) != F.array(*map(F.lit, KEYS)), "keys")
        .when(~F.coalesce(_whole(r["e"], 0, 7, (0, 8)), F.lit(False)), "e")
        .when(~F.coalesce((F.size(r["b"]) == 6) & F.forall(r["b"], lambda x: x.between(0, 1)) & sums, F.lit(False)), "b")
        .when(~F.coalesce(_whole(r["g"], 0, 2, (4, 4)), F.lit(False)), "g")
        .when(~F.coalesce(_whole(r["cf"], 0, 2, (2, 2)), F.lit(False)), "cf")
        .when(~F.coalesce(one(r["i"], 3), F.lit(False)), "i")
        .when(~F.coalesce(one(r["a"], 5), F.lit(False)), "a")
        .when(~F.coalesce(_whole(r["p"], 0, 5, (3, 3)), F.lit(False)), "p")
        .when(~F.coalesce(r["q"].between(0, 1), F.lit(False)), "q")
    )


def forbidden_term(text: Column, terms: list[str]) -> Column:
    """The first of ``terms`` a text contains, whatever its case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(t.lower()), t) for t in terms])


def leaf_paths(schema, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves of a schema; arrays and maps are leaves."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += leaf_paths(f.dataType, f"{name}.") if hasattr(f.dataType, "fields") else [name]
    return out


def json_names(text: Column) -> Column:
    """All key names of a JSON text, at any depth, each once; empty for what is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(text))
    return F.array_distinct(F.coalesce(F.regexp_extract_all(schema, F.lit(r"[<,]\s*`?([^<>,`:]+?)`?: "), F.lit(1)), F.array().cast("array<string>")))


def forbidden_names(text: Column, tokens: list[str]) -> Column:
    """Key names of a JSON text, at any depth, that contain one of the tokens; values aren't looked at."""
    return F.filter(json_names(text), lambda n: F.lower(n).rlike("|".join(re.escape(t.lower()) for t in tokens)))


def unexpected_names(text: Column, allowed: list[str]) -> Column:
    """Key names of a JSON text that a registry doesn't list."""
    return F.array_except(json_names(text), F.array(*map(F.lit, allowed)))
