"""Text and attribute normalisation as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as no value, and the words by which a class is known, in the order they are tried.
NO_VALUE = ("", "none", "null", "unknown", "—", "-")
LAND_USE = (
    ("RESIDENTIAL", ("res", "housing", "gaothan", "bungalow", "apartment", "flats", "living")),
    ("AGRICULTURAL", ("agr", "farm", "crop", "paddy", "orchard", "kheti", "rural")),
    ("COMMERCIAL", ("com", "shop", "office", "retail", "market", "mall", "business")),
    ("INDUSTRIAL", ("ind", "factory", "warehouse", "workshop", "midc", "manufacturing")),
    ("PUBLIC_INSTITUTIONAL", ("gov", "public", "school", "hospital", "institute", "civic")),
    ("FOREST_GREEN", ("forest", "green", "garden", "park", "reserve")),
    ("VACANT", ("vacant", "barren", "open", "na", "waste", "unutilized")),
)
MUTATION = (
    ("APPROVED", ("appr", "cert", "sanction", "verified", "registered", "final")),
    ("PENDING", ("pend", "in_progress", "under_review", "submitted", "awaiting", "draft")),
    ("DISPUTED", ("disp", "litig", "stay", "court", "object", "dispute", "challenge")),
    ("REJECTED", ("reject", "cancel", "revoked", "dismissed")),
)
RISK = (
    ("CRITICAL", ("crit", "severe", "very_high", "flood_zone_1")),
    ("HIGH", ("high", "hazard", "red", "danger")),
    ("MEDIUM", ("med", "moderate", "amber", "yellow")),
    ("LOW", ("low", "safe", "green", "minimal")),
)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def text_value(x) -> Column:
    """Trimmed text; null for what stands for no value."""
    t = F.trim(_col(x))
    return F.when(~F.lower(t).isin(*NO_VALUE), t)


def number(x) -> Column:
    """A double, null for text that is none."""
    return _col(x).try_cast("double")


def semantic_class(x, classes: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """The first class one of whose words occurs; the upper-cased text if none does; null for no value."""
    v = F.lower(F.trim(_col(x)))
    out = F.when(v.isNull() | v.isin(*NO_VALUE), F.lit(None).cast("string"))
    for name, words in classes:
        out = out.when(v.rlike("|".join(map(re.escape, words))), name)
    return out.otherwise(F.upper(v))


def land_use(x) -> Column:
    return semantic_class(x, LAND_USE)


def mutation(x) -> Column:
    return semantic_class(x, MUTATION)


def risk(x) -> Column:
    return semantic_class(x, RISK)


def key(x) -> Column:
    """A field name without case and punctuation."""
    return F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]", "")


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def first_of(props, keys: Iterable[str]) -> Column:
    """The first filled value of a map under one of the keys, in their order."""
    m = _col(props)
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys))


def map_diff(old, new) -> Column:
    """Keys whose values differ, with both: a map of structs (old, new); a key that is missing counts as null."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda k, v: ~v["old"].eqNullSafe(v["new"]))


def iso(at) -> Column:
    """A UTC time as text."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_slug(at) -> Column:
    """A UTC time as part of a file name."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def lower_view(props) -> Column:
    """A map with lower-cased keys, without those that begin with an underscore."""
    return F.transform_keys(F.map_filter(_col(props), lambda k, v: ~k.startswith("_")), lambda k, v: F.lower(k))


def sanitized(x) -> Column:
    """A double without NaN and infinities."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def source_role(name, props=None) -> Column:
    """CADASTRAL, DRONE, MUNICIPAL or OTHER by dataset name and, where given, the keys of a property map."""
    n = F.lower(_col(name))
    named = lambda *words: _any(F.contains(n, F.lit(w)) for w in words)
    has = (lambda *keys: _any(F.exists(F.map_keys(_col(props)), lambda k: F.lower(k) == w) for w in keys)) if props is not None else (lambda *keys: F.lit(False))  # noqa: B023
    return (
        F.when(named("cadastr", "parcel") | has("parcel_id", "cadastral"), "CADASTRAL")
        .when(named("drone", "structure", "building") | has("structure_id"), "DRONE")
        .when(named("muni", "mun_", "tax") | has("tax_id", "assessment"), "MUNICIPAL")
        .otherwise("OTHER")
    )


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out
