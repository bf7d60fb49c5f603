"""SPARQL's functions over columns of values, where their rules differ from Spark's; see FUNCTIONS for the names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strbefore(text: Column, part: Column) -> Column:
    """Empty where the part isn't found."""
    at = F.position(part, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")


def strafter(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when(at > 0, F.substring(text, at + F.length(part), F.length(text))).otherwise("")


def encode_for_uri(text: Column) -> Column:
    """Percent-encoding with %20 for a blank and ~ left as it is."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sparql_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def langmatches(lang: Column, wanted: Column) -> Column:
    low, want = F.lower(lang), F.lower(wanted)
    return F.when(want == "*", low != "").otherwise((low == want) | F.startswith(low, F.concat(want, F.lit("-"))))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    """Flags i, s, m, x as inline flags; q takes the pattern literally."""
    if "q" in flags:
        literal = F.lit(pattern)
        return F.contains(F.lower(text), F.lower(literal)) if "i" in flags else F.contains(text, literal)
    inline = "".join(f for f in "ismx" if f in flags)
    return text.rlike(f"(?{inline}){pattern}" if inline else pattern)


def timezone(lexical: Column) -> Column:
    """The zone of a lexical date-time: Z, an offset, or empty."""
    return F.regexp_extract(lexical, r"(Z|[+-]\d\d:\d\d)$", 1)


def zone_duration(x: Column) -> Column:
    """The time zone of a date and time as a duration; null without one."""
    tz = timezone(x)
    hours, minutes = F.substring(tz, F.lit(2), F.lit(2)).try_cast("int"), F.substring(tz, F.lit(5), F.lit(2)).try_cast("int")
    text = F.concat(F.when(tz.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(tz == "", None).when((tz == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").otherwise(text)


#: Name: (least arguments, most arguments or None, function of columns).
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "STR": (1, 1, lambda x: x.cast("string")),
    "STRLEN": (1, 1, F.char_length),
    "SUBSTR": (2, 3, lambda x, a, n=None: F.substring(x, a.cast("int"), n.cast("int")) if n is not None else F.substring(x, a.cast("int"), F.length(x))),
    "UCASE": (1, 1, F.upper),
    "LCASE": (1, 1, F.lower),
    "STRSTARTS": (2, 2, F.startswith),
    "STRENDS": (2, 2, F.endswith),
    "CONTAINS": (2, 2, F.contains),
    "STRBEFORE": (2, 2, strbefore),
    "STRAFTER": (2, 2, strafter),
    "ENCODE_FOR_URI": (1, 1, encode_for_uri),
    "CONCAT": (1, None, lambda *x: F.concat(*[c.cast("string") for c in x])),
    "ABS": (1, 1, lambda x: F.abs(x.try_cast("double"))),
    "ROUND": (1, 1, lambda x: sparql_round(x.try_cast("double"))),
    "CEIL": (1, 1, lambda x: F.ceil(x.try_cast("double"))),
    "FLOOR": (1, 1, lambda x: F.floor(x.try_cast("double"))),
    "RAND": (0, 0, F.rand),
    "NOW": (0, 0, F.current_timestamp),
    "YEAR": (1, 1, lambda x: F.year(x.try_cast("timestamp"))),
    "MONTH": (1, 1, lambda x: F.month(x.try_cast("timestamp"))),
    "DAY": (1, 1, lambda x: F.dayofmonth(x.try_cast("timestamp"))),
    "HOURS": (1, 1, lambda x: F.hour(x.try_cast("timestamp"))),
    "MINUTES": (1, 1, lambda x: F.minute(x.try_cast("timestamp"))),
    "SECONDS": (1, 1, lambda x: F.second(x.try_cast("timestamp"))),
    "TZ": (1, 1, timezone),
    "TIMEZONE": (1, 1, zone_duration),
    "BNODE": (0, 1, lambda *x: F.concat(F.lit("b"), *x) if x else F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),
    "MD5": (1, 1, F.md5),
    "SHA1": (1, 1, F.sha1),
    "SHA256": (1, 1, lambda x: F.sha2(x, 256)),
    "SHA384": (1, 1, lambda x: F.sha2(x, 384)),
    "SHA512": (1, 1, lambda x: F.sha2(x, 512)),
    "UUID": (0, 0, lambda: F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": (0, 0, F.uuid),
    "IF": (3, 3, lambda c, a, b: F.when(c, a).otherwise(b)),
    "COALESCE": (1, None, F.coalesce),
    "LANGMATCHES": (2, 2, langmatches),
    "ISNUMERIC": (1, 1, lambda x: x.try_cast("double").isNotNull()),
    "BOUND": (1, 1, lambda x: x.isNotNull()),
    "SAMETERM": (2, 2, lambda a, b: a.eqNullSafe(b)),
    "IRI": (1, 1, lambda x: x),
    "URI": (1, 1, lambda x: x),
}
