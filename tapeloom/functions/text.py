"""Vendor text and numbers. A vendor value is the raw JSON token: ``"12"`` (quoted), ``12`` or ``null``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic letters and the Persian ones they are written as.
ARABIC_YEH_KAF = ("يىك", "ییک")
ZWNJ, RLM = "‌", "‏"

# A number that was written with a fraction or an exponent keeps that mark, so that it never passes for a whole number.
_FRACTION, _EXPONENT = ".0", "E0"


def elements(payload: Column) -> Column:
    """The elements of a JSON array as variants; NULL when the payload is not a JSON array."""
    return F.try_variant_get(F.try_parse_json(payload), "$", "array<variant>")


def token(value: Column) -> Column:
    """The raw token of a JSON value: quoted text, digits, ``true``, ``null`` or the JSON of a nested value.

    Trailing zeros of a fraction are lost; that there was one is not.
    """
    kind, written = F.schema_of_variant(value), F.to_json(value)
    whole_decimal = kind.endswith(",0)") & kind.startswith("DECIMAL") & (F.length(F.ltrim(written, F.lit("-"))) < 19)
    return (F.when(whole_decimal, F.concat(written, F.lit(_FRACTION)))
            .when((kind == "DOUBLE") & ~written.contains("E"), F.concat(written, F.lit(_EXPONENT))).otherwise(written))


def tokens(element: Column) -> Column:
    """Key -> raw token of a JSON object, the last of repeated keys; NULL for any other value."""
    return F.transform_values(F.try_variant_get(element, "$", "map<string,variant>"), lambda k, v: token(v))


def quoted(token: Column) -> Column:
    return token.startswith('"')


def text(token: Column) -> Column:
    """Trimmed text of a token; '' when absent or null."""
    escaped = F.get_json_object(F.concat(F.lit('{"a":'), token, F.lit("}")), "$.a")
    plain = F.when(token.contains("\\"), escaped).when(token == "null", "").otherwise(F.btrim(token, F.lit('"')))
    return F.trim(F.coalesce(plain, F.lit("")))


def fold_letters(s: Column) -> Column:
    return F.translate(s, *ARABIC_YEH_KAF)


def fold_name(s: Column) -> Column:
    """Persian letters, without spaces and joining marks, so that symbols compare across vendors."""
    return F.translate(fold_letters(F.trim(s)), " " + ZWNJ + RLM, "")


# A whole number, and one that may carry a zero fraction.
_WHOLE = "^([+-]?[0-9]+)$"
_WHOLE_OR_ZERO_FRACTION = r"^([+-]?[0-9]+)(?:\.0*)?$"


def num(s: Column) -> Column:
    """Integer from the text of a number, thousands separators allowed; anything else is NULL."""
    return F.regexp_extract(F.translate(s, ",", ""), _WHOLE, 1).try_cast("bigint")


def whole_decimal(s: Column) -> Column:
    """Integer from a decimal text whose fraction is zero; a real fraction is NULL, never truncated."""
    return F.regexp_extract(s, _WHOLE_OR_ZERO_FRACTION, 1).try_cast("bigint")


def loose_integer(s: Column) -> Column:
    """Integer from a text with separators and possibly a zero fraction."""
    return whole_decimal(F.translate(s, ",", ""))


def parse_int3(s: Column) -> Column:
    """struct(state, value): absent ('' or '-'), bad (not an integer) or ok."""
    v = loose_integer(s)
    state = F.when(F.translate(s, ",", "").isin("", "-"), "absent").when(v.isNull(), "bad").otherwise("ok")
    return F.struct(state.alias("state"), v.cast("string").alias("value"))


def parse_text(s: Column) -> Column:
    folded = fold_name(s)
    present = ~folded.isin("", "-")
    return F.struct(F.when(present, "ok").otherwise("absent").alias("state"), F.when(present, folded).alias("value"))


def value_format(token: Column, s: Column) -> Column:
    """How a vendor encodes a value, from its token and text."""
    return (F.when(token.isNull(), "absent").when(token == "null", "null")
            .when(~quoted(token), F.when(token.rlike("[.eE]"), "decimal number").otherwise("integer number"))
            .when(s == "", "empty string").when(s.rlike(r"^-?\d+$"), "numeric string")
            .when(F.translate(s, ",", "").rlike(r"^-?\d+$"), "numeric string with separators")
            .when(s.rlike(r"^-?\d+\.\d+$"), "decimal string").when(s.rlike("[۰-۹]"), "Persian digits").otherwise("text"))


def instrument_code(s: Column) -> Column:
    """Digits-only code, else NULL."""
    return F.when(s.rlike("^[0-9]+$"), s)
