"""Questions about datasets as frames: which dataset a phrase means, and what spatial analysis a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.operators.assistant import CATEGORIES, UNITS

# The two forms of a spatial question, words of the analyses in the order they are tried, and what a
# question is about that has neither form.
_WITHIN = r"(?:find|get|show|which)\s+(.*?)\s+(?:within|near|around|closest to)\s+.*?of\s+(.*)"
_OVERLAP = r"(?:which|find|show)\s+(.*?)\s+(?:overlap|intersect with|cross)\s+(.*)"
_ANALYSES = {
    "intersection": ("overlap", "intersect", "intersection", "intersections"),
    "comparison": ("compare", "comparison", "difference"),
    "conflicts": ("conflict", "conflicts", "concentrated", "hotspot"),
    "nearest": ("nearest", "closest"),
    "buffer": ("buffer", "zone", "corridor"),
}
_TARGETS = {"parcels": ("parcel",), "structures": ("structure",)}
_REFERENCES = {"municipal assets": ("asset", "municipal"), "drone structures": ("drone",)}
#: Confidence of the only dataset of a project, of no target, and of no reference.
_SOLE, _NO_TARGET, _NO_REFERENCE = 0.85, 0.5, 1.0
_DISTANCE = r"(\d+(?:\.\d+)?)\s*(km|kilometers?|ft|feet|meters?|m)\b"


def _any(text: Column, words) -> Column:
    return F.array_contains(F.array(*(F.contains(text, F.lit(w)) for w in words)), True)


def scores(phrases: DataFrame, datasets: DataFrame, by: str = "project_id") -> DataFrame:
    """(phrase columns, name, confidence): the additive score of each dataset of a phrase's project.

    ``datasets``: (project_id, name, geometry, attributes).  Name and words, kind of dataset and its geometry, and
    columns that tell what it holds each add their share; the sum is at most 1.
    """
    t, name = F.lower(F.trim("phrase")), F.lower("name")
    fields = F.transform(F.coalesce("attributes", F.array().cast("array<string>")), lambda a: F.lower(a))
    share = lambda test, w: F.when(F.coalesce(test, F.lit(False)), w).otherwise(0.0)
    word = F.exists(F.split(t, r"\s+"), lambda w: (w != "") & F.contains(name, w))
    parts = [F.when(F.contains(name, t), 0.55).when(word, 0.35).otherwise(0.0)]
    for words, shapes in CATEGORIES.values():
        meant = _any(t, words)
        parts += [share(meant & _any(name, words), 0.30), share(meant & F.col("geometry").isin(*shapes), 0.15)]
    for kind, marks in (("parcel", ("parcel", "pin")), ("asset", ("asset", "facility"))):
        parts.append(share(F.contains(t, F.lit(kind)) & F.exists(fields, lambda a: _any(a, marks)), 0.20))  # noqa: B023
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return phrases.join(datasets, by).withColumn("confidence", F.round(F.least(F.lit(1.0), total), 2))


def resolved(phrases: DataFrame, datasets: DataFrame, keys: tuple[str, ...], cutoff: float = 0.35) -> DataFrame:
    """(keys, name, confidence): the best dataset of each phrase, of equal ones the first by name; none below the cutoff."""
    rated = scores(phrases, datasets).where(F.col("confidence") >= cutoff)
    return rated.groupBy(*keys).agg(F.min(F.struct((-F.col("confidence")).alias("less"), "name")).alias("m")).select(*keys, F.col("m.name").alias("name"), (-F.col("m.less")).alias("confidence"))


def metres(question: Column, default: float = 100.0) -> Column:
    """The distance that a question names, or else its first bare number of two to four digits."""
    q = F.lower(question)
    unit, number = F.regexp_extract(q, _DISTANCE, 2), F.regexp_extract(q, _DISTANCE, 1)
    factor = None
    for u, m in UNITS.items():
        factor = F.when(unit == u, m) if factor is None else factor.when(unit == u, m)
    bare = F.regexp_extract(q, r"\b(\d{2,4})\b", 1)
    return F.when(number != "", number.try_cast("double") * factor).when(bare != "", bare.try_cast("double")).otherwise(default)


def _first(q: Column, by: dict[str, tuple[str, ...]], otherwise: str | None = None) -> Column:
    """The first name of which the text has a word."""
    out = None
    for name, ws in by.items():
        out = F.when(_any(q, ws), name) if out is None else out.when(_any(q, ws), name)
    return out.otherwise(F.lit(otherwise).cast("string"))


def spatial_plans(questions: DataFrame, datasets: DataFrame) -> DataFrame:
    """(question_id, target, reference, metres, analysis, confidence, ambiguous, clarification) of questions
    (question_id, project_id, question).

    The target is the dataset whose features are wanted, the reference the one they are measured against; each is the
    best dataset of its phrase.  Without a target the only dataset of a project is taken; of several none is guessed.
    """
    q = F.lower("question")
    side = lambda k: F.when(q.rlike(_WITHIN), F.trim(F.regexp_extract(q, _WITHIN, k))).when(q.rlike(_OVERLAP), F.trim(F.regexp_extract(q, _OVERLAP, k)))
    formed = q.rlike(_WITHIN) | q.rlike(_OVERLAP)
    first = F.when(formed, side(1)).otherwise(_first(q, _TARGETS))
    second = F.when(formed, side(2)).otherwise(_first(q, _REFERENCES))
    base = questions.select("question_id", "project_id", first.alias("first"), second.alias("second"), metres(F.col("question")).alias("metres"), _first(q, _ANALYSES, "proximity").alias("analysis"))
    out = base
    for phrase, name in (("first", "target"), ("second", "reference")):
        asked = base.where(F.col(phrase) != "").select("question_id", "project_id", F.col(phrase).alias("phrase"))
        found = resolved(asked, datasets, ("question_id",)).select("question_id", F.col("name").alias(name), F.col("confidence").alias(f"{name}_confidence"))
        out = out.join(found, "question_id", "left")
    # A row for each project, with its datasets' names: as many as a user is asked to choose from.
    own = datasets.groupBy("project_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    out = out.join(own, "project_id", "left")
    n, none = F.coalesce(F.size("names"), F.lit(0)), F.col("target").isNull()
    alone = none & (n == 1)
    out = out.withColumns({"target": F.when(alone, F.get("names", F.lit(0))).otherwise(F.col("target")), "target_confidence": F.when(alone, _SOLE).otherwise(F.col("target_confidence")), "ambiguous": none & (n > 1)})
    same = F.col("target").eqNullSafe(F.col("reference"))
    out = out.withColumns({"reference": F.when(~same, F.col("reference")), "reference_confidence": F.when(~same, F.col("reference_confidence"))})
    confidence = F.least(F.coalesce("target_confidence", F.lit(_NO_TARGET)), F.coalesce("reference_confidence", F.lit(_NO_REFERENCE)))
    ask = F.when(F.col("ambiguous"), F.concat(F.lit("Please specify which dataset you want to inspect: "), F.array_join("names", ", "), F.lit(".")))
    return out.select("question_id", "target", "reference", "metres", "analysis", confidence.alias("confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), ask.alias("clarification"))
