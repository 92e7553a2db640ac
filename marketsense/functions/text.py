"""Text and JSON helpers as Column expressions (all inside the JVM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Case-insensitive substring test, without word boundaries."""
    return F.upper(text).contains(needle.upper())


def word_count(text: Column, word: str, ignore_case: bool = False) -> Column:
    """Occurrences of a literal word between word boundaries."""
    flags = "(?i)" if ignore_case else ""
    return F.regexp_count(text, F.lit(rf"{flags}\b\Q{word}\E\b"))


def json_object(line: Column) -> Column:
    """Top-level members of a line that is exactly one JSON object, as a map of strings; else null.

    The line is read as the only element of an array, so text behind the object
    makes it malformed.  A reader stops at the closing bracket, though, so a line that
    brings one behind an object is read a second time, as the only member of an
    object: each form refuses what the other lets through.  Single quotes and numbers
    JSON does not know are refused; of a repeated key the last value counts.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    listed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", strict)
    member = F.from_json(F.concat(F.lit('{"x":'), line, F.lit("}")), "map<string,string>", strict)
    whole = ~line.rlike(r"\}\s*\]") | member.isNotNull()

    def last_values(members: Column) -> Column:
        keys = F.map_keys(members)

        def is_last(entry: Column, place: Column) -> Column:
            return ~F.array_contains(F.slice(keys, place + 2, F.size(keys)), entry["key"])

        single = F.map_from_entries(F.filter(F.map_entries(members), is_last))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), single).otherwise(members)

    return let(listed, lambda items: F.when((F.size(items) == 1) & whole, let(F.get(items, F.lit(0)), last_values)))


def has_key(fields: Column, key: str) -> Column:
    return F.map_contains_key(fields, key)


def field_or(fields: Column, key: str, default: str) -> Column:
    """Value of a key; ``default`` only when the key is missing.

    An explicit null stays null, and so does every field of a malformed line.
    """
    present = has_key(fields, key)
    return F.when(present, F.try_element_at(fields, F.lit(key))).when(~present, F.lit(default))


def json_integer(fields: Column, line: Column, key: str) -> Column:
    """Integer value of a JSON field.

    Whole numbers parse whether quoted or not.  A number with a fraction is
    truncated, a *string* with a fraction is not an integer; only those few
    values need the JSON type and pay for a second parse of the line.
    """
    raw = F.try_element_at(fields, F.lit(key))
    value = F.try_variant_get(F.try_parse_json(line), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    whole = F.trim(raw).try_cast("bigint")
    return (
        F.when(whole.isNotNull(), whole)
        .when(raw.isNull(), None)
        .when(kind == "BOOLEAN", F.when(raw == "true", F.lit(1)).otherwise(F.lit(0)))
        .when(kind != "STRING", raw.try_cast("double").try_cast("bigint"))
    )
