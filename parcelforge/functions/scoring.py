"""Match signals and scores as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import key


@dataclass(frozen=True)
class MatchConfig:
    # Weights and thresholds.
    radius: float = 50.0
    tie: float = 0.015
    w_spatial: float = 0.35
    w_area: float = 0.20
    w_centroid: float = 0.20
    w_geometry: float = 0.15
    w_attribute: float = 0.10
    matched: float = 0.80
    possible: float = 0.60
    conflict: float = 0.40

    @classmethod
    def stage(cls, **options) -> MatchConfig:
        """The thresholds of a pipeline run, which are lower than those of a run of its own (fixed values)."""
        return cls(**{"matched": 0.75, "possible": 0.55} | options)

    def __post_init__(self) -> None:
        if not 1 <= self.radius <= 5000:
            raise ValueError("radius must be between 1 and 5000 metres")


#: Fields of one meaning under different names, in the order they are tried.
GROUPS = {
    "identifier": ("id", "fid", "parcel_id", "parcel_no", "plot_no", "survey_no", "property_id", "code", "asset_id", "structure_id", "building_id"),
    "name": ("name", "owner", "owner_name", "label", "asset_name", "facility_name", "structure_name", "title", "description"),
    "type": ("type", "use", "land_use", "class", "category", "facility_type", "structure_type", "asset_type", "status"),
    "metric": ("area", "area_sqm", "sqm", "sqft", "floors", "height", "units"),
}


def proximity(distance: Column, radius: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / radius)


def ratio(a: Column, b: Column) -> Column:
    """The smaller by the larger; null where there is no area."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b))


def compare(a: Column, b: Column) -> Column:
    """Likeness of two values: relative difference of numbers, equality of texts, else shared words."""
    x, y = a.try_cast("double"), b.try_cast("double")
    top = F.greatest(F.abs(x), F.abs(y))
    numeric = F.when(top == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / top))
    s, t = F.lower(F.trim(a)), F.lower(F.trim(b))
    words = lambda v: F.array_distinct(F.regexp_extract_all(v, F.lit(r"(\w+)"), 1))
    both = F.size(F.array_intersect(words(s), words(t))) / F.size(F.array_union(words(s), words(t))).cast("double")
    spaced = F.contains(s, F.lit(" ")) | F.contains(t, F.lit(" "))
    filled = (F.size(words(s)) > 0) & (F.size(words(t)) > 0)
    return F.when(x.isNotNull() & y.isNotNull(), numeric).when(s == t, 1.0).when(spaced & filled, both).otherwise(0.0)


def attribute_similarity(df: DataFrame, a: str, b: str, name: str = "attribute") -> DataFrame:
    """Adds the likeness of two maps of text: the mean over equal field names, then over one field of each meaning
    that is left; 0.5 where nothing can be compared.

    Each step is a projection of its own, so that maps and keys are made once for a row.
    """
    view = lambda m: F.transform_keys(F.map_filter(m, lambda k, v: v.isNotNull() & ~k.startswith("_")), lambda k, v: key(k))
    out = df.withColumns({"_sa": view(a), "_sb": view(b)})
    out = out.withColumns({"_ka": F.map_keys("_sa"), "_kb": F.map_keys("_sb")})
    out = out.withColumn("_both", F.array_intersect("_ka", "_kb"))
    out = out.withColumns({"_ka": F.array_except("_ka", "_both"), "_kb": F.array_except("_kb", "_both")})
    first = {}
    for n, names in enumerate(GROUPS.values()):
        plain = F.array(*(F.lit(x.replace("_", "")) for x in names))
        first |= {f"_a{n}": F.get(F.array_intersect(plain, "_ka"), F.lit(0)), f"_b{n}": F.get(F.array_intersect(plain, "_kb"), F.lit(0))}
    out = out.withColumns(first)
    pair = lambda x, y: F.struct(F.try_element_at("_sa", x).alias("p"), F.try_element_at("_sb", y).alias("q"))
    groups = [F.when(F.col(f"_a{n}").isNotNull() & F.col(f"_b{n}").isNotNull(), pair(F.col(f"_a{n}"), F.col(f"_b{n}"))) for n in range(len(GROUPS))]
    out = out.withColumn("_pairs", F.concat(F.transform("_both", lambda k: pair(k, k)), F.array_compact(F.array(*groups))))
    out = out.withColumn("_scores", F.transform("_pairs", lambda x: compare(x["p"], x["q"])))
    mean = F.aggregate("_scores", F.lit(0.0), lambda x, y: x + y) / F.size("_scores")
    out = out.withColumn(name, F.when(F.size("_scores") > 0, F.least(F.lit(1.0), mean)).otherwise(0.5))
    return out.drop("_sa", "_sb", "_ka", "_kb", "_both", "_pairs", "_scores", *first)


def overall(signals: dict[str, Column], config: MatchConfig) -> Column:
    """Weighted mean of the signals that are there, to 4 places."""
    weight = {"spatial": config.w_spatial, "area": config.w_area, "centroid": config.w_centroid, "geometry": config.w_geometry, "attribute": config.w_attribute}
    zero = F.lit(0.0)
    over = under = zero
    for name, w in weight.items():
        there = signals[name].isNotNull()
        over = over + F.when(there, w * signals[name]).otherwise(zero)
        under = under + F.when(there, F.lit(w)).otherwise(zero)
    return F.when(under > 0, F.round(F.least(F.lit(1.0), F.greatest(zero, over / under)), 4)).otherwise(0.0)


def status(score: Column, signals: dict[str, Column], config: MatchConfig) -> Column:
    at_least = lambda c, t: F.coalesce(c >= t, F.lit(False))
    below = lambda c, t: F.coalesce(c < t, F.lit(False))
    present = at_least(signals["spatial"], 0.5) | at_least(signals["centroid"], 0.7)
    against = below(signals["attribute"], 0.25) | below(signals["area"], 0.35)
    return (
        F.when(present & against, "conflict")
        .when(score >= config.matched, "matched")
        .when(score >= config.possible, "possible_match")
        .when((score >= config.conflict) & present, "conflict")
        .otherwise("unmatched")
    )


def category(match_status: Column) -> Column:
    return F.when(match_status == "matched", "HIGH").when(match_status.isin("possible_match", "conflict"), "REVIEW_REQUIRED").otherwise("UNMATCHED")
