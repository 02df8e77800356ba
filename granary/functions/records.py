"""Normalising one reported record: text, keys, codes, dates, numbers and units, all as column expressions.

Each step takes the columns of the step before (clean text, then slugs and values), so that a plan computes each once.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What stands for "missing", units and their factors, commodity aliases.
MISSING = ("", "na", "n/a", "nr", "null", "nil", "-", "--", "none")
PRICE_UNITS = {
    "inr/quintal": 1.0, "rs/quintal": 1.0, "rs./quintal": 1.0, "rs/qtl": 1.0, "inr/qtl": 1.0, "₹/quintal": 1.0,
    "inr/kg": 100.0, "rs/kg": 100.0, "rs./kg": 100.0, "₹/kg": 100.0,
    "inr/tonne": 0.1, "rs/tonne": 0.1, "inr/ton": 0.1, "rs/ton": 0.1, "₹/tonne": 0.1,
}
ARRIVAL_UNITS = {
    "tonne": 1.0, "tonnes": 1.0, "ton": 1.0, "tons": 1.0, "t": 1.0, "mt": 1.0, "metric tonne": 1.0, "metric tonnes": 1.0,
    "quintal": 0.1, "quintals": 0.1, "qtl": 0.1, "kg": 0.001, "kgs": 0.001, "kilogram": 0.001, "kilograms": 0.001,
}
ALIASES = {
    "ONION": ("onion", "kanda", "pyaaz", "pyaz", "कांदा", "प्याज"), "TOMATO": ("tomato", "tamatar", "टोमॅटो", "टमाटर"), "POTATO": ("potato", "batata", "aloo", "aaloo", "आलू", "बटाटा"),
    "SOYBEAN": ("soybean", "soyabean", "सोयाबीन"), "WHEAT": ("wheat", "gehun", "gahu", "गेहूं", "गहू"), "COTTON": ("cotton", "kapas", "kapus", "कपास", "कापूस"),
}
CODE_OF_ALIAS = {alias: code for code, names in ALIASES.items() for alias in names}


def lookup(values: dict, key: Column) -> Column:
    """The value of a key in a small fixed table; null without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


#: White space around, or a word for "missing" alone.
_MISSING = r"(?i)^\s*(?:" + "|".join(x.replace("/", "\\/") for x in MISSING if x) + r")?\s*$"


#: White space that isn't a space alone. Few texts have any, and finding none is cheaper than replacing each space by itself.
_UNTIDY = r"\s\s|[^\S ]"


def clean(text: Column) -> Column:
    """White space collapsed; null for what stands for missing."""
    return F.when(~text.rlike(_MISSING), F.trim(F.when(text.rlike(_UNTIDY), F.regexp_replace(text, r"\s+", " ")).otherwise(text)))


def name_key(text: str) -> str | None:
    """Lower-case words of letters, marks and digits of a text in compatibility composition (NFKC); None without any."""
    if text.isascii():
        return " ".join(re.findall("[a-z0-9]+", text.lower())) or None
    lower = unicodedata.normalize("NFKC", text).lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in lower).split()) or None


def latin(key: str) -> str | None:
    """The Latin letters and digits of a name key, words joined by _; None without any."""
    return "_".join(re.findall("[A-Z0-9]+", key.upper())) or None


def slug(key: str) -> str:
    """latin, or a hash of the key."""
    return latin(key) or "U" + hashlib.sha1(key.encode()).hexdigest()[:10].upper()


def of_names(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """f as a column function for names. Names repeat, so each different one of a batch is given to f once (there is no built-in NFKC)."""

    @F.arrow_udf(StringType())
    def run(column: pa.Array) -> pa.Array:
        names = column.dictionary_encode()
        return pa.array([f(x) for x in names.dictionary.to_pylist()], pa.string()).take(names.indices)

    return run


@functools.lru_cache(1 << 16)
def place_code(text: str) -> str:
    """The slug of a name; without a key, that of an empty key."""
    return slug(name_key(text) or "")


@functools.lru_cache(1 << 16)
def commodity_code(text: str) -> str | None:
    """The code of a commodity's name: that of its alias, or its own slug; None without a key."""
    return None if (key := name_key(text)) is None else CODE_OF_ALIAS.get(key) or slug(key)


place_slug, commodity_slug = of_names(place_code), of_names(commodity_code)


def code(*slugs: Column, most: int = 64) -> Column:
    """A deterministic code of at most so many characters; parts never run into each other."""
    full = F.concat_ws("__", *slugs)
    return F.when(F.length(full) <= most, full).otherwise(F.concat(F.substring(full, 1, most - 11), F.lit("_"), F.upper(F.substring(F.sha1(full), 1, 10))))


ISO, DMY = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s].*)?$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"


def calendar_date(text: Column, form: Column) -> Column:
    """Of clean text, year first (ISO, a time part ignored) or day first (DMY), or whichever it looks like (AUTO); null unless a real day. Never month first."""
    iso, dmy = F.regexp_replace(text, ISO, "$1-$2-$3"), F.regexp_replace(text, DMY, "$3-$2-$1")
    plain = F.when(text.rlike(ISO) & (form != "DMY"), iso).when(text.rlike(DMY) & (form != "ISO"), dmy)
    return plain.try_cast("date")  # which takes months and days of one digit, and is cheaper than a pattern


def number(text: Column) -> Column:
    """The value of clean text without thousands separators; null if it isn't a number."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def price_factor(unit: Column) -> Column:
    return lookup(PRICE_UNITS, F.replace(F.regexp_replace(F.lower(unit), r"\s+", ""), F.lit("rupees"), F.lit("rs")))


def arrival_factor(unit: Column) -> Column:
    return lookup(ARRIVAL_UNITS, F.lower(unit))


def prices_differ(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    return F.abs(a - b) / F.greatest(F.least(a, b), F.lit(1.0)) > tolerance


def number_text(x: Column) -> Column:
    """A number in its shortest form: whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


HASHED = ("source", "source_record_key", "mandi_code", "commodity_code", "price_date", "price_unit", "modal_price", "min_price", "max_price", "arrivals_quantity", "arrival_unit", "variety", "grade")
NUMBERS = ("modal_price", "min_price", "max_price", "arrivals_quantity")


def content_hash() -> Column:
    """sha256 over the fields in fixed order, each with its type, so that null, 0 and '' differ."""
    tagged = [F.coalesce(F.concat(F.lit("#"), number_text(F.col(c))) if c in NUMBERS else F.concat(F.lit("S"), F.col(c).cast("string")), F.lit("N")) for c in HASHED]
    return F.sha2(F.concat_ws("\u001f", *tagged), 256)
