"""Organ-failure subscores as column expressions.

Two rule sets disagree with each other. ``table_*`` follow the published score
table literally, gaps included, and return NULL without data. ``enhanced_*``
return 0 without data and are paired with an availability flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayscope.functions.columns import is_true

COMPONENTS = ["respiratory", "cardiovascular", "coagulation", "liver", "cns", "renal"]


def _steps(v: Column, at_least: list[tuple[float, int]], default: int) -> Column:
    chain = F.when(v >= at_least[0][0], at_least[0][1])
    for bound, score in at_least[1:]:
        chain = chain.when(v >= bound, score)
    return chain.otherwise(default)


def _below(v: Column, less_than: list[tuple[float, int]], default: int) -> Column:
    chain = F.when(v < less_than[0][0], less_than[0][1])
    for bound, score in less_than[1:]:
        chain = chain.when(v < bound, score)
    return chain.otherwise(default)


def _ranges(v: Column, below: float, closed: list[tuple[float, float, int]], top: tuple[float, int]) -> Column:
    """Closed ranges; values in the gaps between them score 0."""
    chain = F.when(v < below, 0)
    for lo, hi, score in closed:
        chain = chain.when((v >= lo) & (v <= hi), score)
    return chain.when(v >= top[0], top[1]).otherwise(0)


# enhanced rule set


def enhanced_respiratory(ratio: Column, ventilated: Column) -> Column:
    return (
        F.when(ratio.isNull(), 0)
        .when((ratio < 100) & ventilated, 4)
        .when((ratio >= 100) & (ratio < 200) & ~ventilated, 3)
        .when(ratio >= 200, 2)
        .otherwise(0)
    )


def enhanced_cardiovascular(map_: Column, top_dose: Column) -> Column:
    pressure = F.when(map_.isNull() | (map_ >= 70), 0).otherwise(1)
    return F.when(top_dose.isNotNull(), _steps(top_dose, [(15, 4), (5, 3)], 2)).otherwise(pressure)


def enhanced_hepatic(bilirubin: Column) -> Column:
    return _steps(bilirubin, [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)], 0)


def enhanced_coagulation(platelets: Column) -> Column:
    return _below(platelets, [(20, 4), (50, 3), (100, 2), (150, 1)], 0)


def enhanced_renal(creatinine: Column, urine: Column) -> Column:
    with_creatinine = (
        F.when((creatinine >= 5.0) | is_true(urine < 200), 4)
        .when((creatinine >= 3.5) | is_true(urine < 500), 3)
        .when(creatinine >= 2.0, 2)
        .when(creatinine >= 1.2, 1)
        .otherwise(0)
    )
    return F.when(creatinine.isNotNull(), with_creatinine).otherwise(_below(urine, [(200, 4), (500, 3)], 0))


def enhanced_neurological(gcs: Column) -> Column:
    return F.when(gcs <= 5, 4).when(gcs <= 9, 3).when(gcs <= 12, 2).when(gcs <= 14, 1).otherwise(0)


# table rule set


def table_respiratory(ratio: Column, ventilated: Column) -> Column:
    return (
        F.when(ratio.isNull(), F.lit(None).cast("int"))
        .when(ratio >= 400, 0)
        .when(ratio >= 300, 1)
        .when(ratio >= 200, 2)
        .when(ratio >= 100, F.when(ventilated, 3).otherwise(2))
        .otherwise(F.when(ventilated, 4).otherwise(3))
    )


def table_cardiovascular(map_: Column, dopamine: Column, epinephrine: Column, norepinephrine: Column, dobutamine: Column) -> Column:
    da, ep, ne, db = [F.coalesce(d.cast("double"), F.lit(0.0)) for d in (dopamine, epinephrine, norepinephrine, dobutamine)]
    nothing = map_.isNull() & (da == 0) & (ep == 0) & (ne == 0) & (db == 0)
    return (
        F.when(nothing, F.lit(None).cast("int"))
        .when((da > 15) | (ep > 0.1) | (ne > 0.1), 4)
        .when((da > 5) | ((ep > 0) & (ep <= 0.1)) | ((ne > 0) & (ne <= 0.1)), 3)
        .when(((da > 0) & (da <= 5)) | (db > 0), 2)
        .when(map_ < 70, 1)
        .otherwise(0)
    )


def table_coagulation(platelets: Column) -> Column:
    return F.when(platelets.isNotNull(), _steps(platelets, [(150, 0), (100, 1), (50, 2), (20, 3)], 4))


def table_liver(bilirubin: Column) -> Column:
    return F.when(
        bilirubin.isNotNull(),
        _ranges(bilirubin, 1.2, [(1.2, 1.9, 1), (2.0, 5.9, 2), (6.0, 11.9, 3)], (12.0, 4)),
    )


def table_cns(gcs: Column) -> Column:
    return F.when(
        gcs.isNotNull(),
        F.when(gcs == 15, 0)
        .when(gcs.between(13, 14), 1)
        .when(gcs.between(10, 12), 2)
        .when(gcs.between(6, 9), 3)
        .when(gcs < 6, 4)
        .otherwise(0),
    )


def table_renal(creatinine: Column, urine: Column) -> Column:
    by_creatinine = _ranges(creatinine, 1.2, [(1.2, 1.9, 1), (2.0, 3.4, 2), (3.5, 4.9, 3)], (5.0, 4))
    by_urine = _below(urine, [(200, 4), (500, 3)], 0)
    return F.when(creatinine.isNotNull() | urine.isNotNull(), F.greatest(by_creatinine, by_urine))


def describe(system: str, score: Column, value: Column | None = None) -> Column:
    """Short reason text for a table subscore."""
    # Texts that go into the calculation notes
    texts = {
        "coagulation": {0: "Platelets ≥ 150 × 10³/μL", 1: "Platelets < 150 × 10³/μL", 2: "Platelets < 100 × 10³/μL", 3: "Platelets < 50 × 10³/μL", 4: "Platelets < 20 × 10³/μL"},
        "liver": {0: "Bilirubin < 1.2 mg/dL", 1: "Bilirubin 1.2-1.9 mg/dL", 2: "Bilirubin 2.0-5.9 mg/dL", 3: "Bilirubin 6.0-11.9 mg/dL", 4: "Bilirubin ≥ 12.0 mg/dL"},
        "cns": {0: "GCS = 15", 1: "GCS 13-14", 2: "GCS 10-12", 3: "GCS 6-9", 4: "GCS < 6"},
        "renal": {0: "Normal renal function", 1: "Creatinine 1.2-1.9 mg/dL", 2: "Creatinine 2.0-3.4 mg/dL", 3: "Creatinine 3.5-4.9 mg/dL or urine output < 500 mL/day", 4: "Creatinine ≥ 5.0 mg/dL or urine output < 200 mL/day"},
    }
    gap_texts = {"liver": (1.2, "Normal liver function"), "cns": (15, "Normal neurological function")}
    chain = F.when(score == 0, texts[system][0])
    if value is not None and system in gap_texts:
        bound, text = gap_texts[system]
        normal = (value < bound) if system == "liver" else (value == bound)
        chain = F.when((score == 0) & ~normal, text).when(score == 0, texts[system][0])
    for s in range(1, 5):
        chain = chain.when(score == s, texts[system][s])
    return chain


def describe_respiratory(ratio: Column, ventilated: Column) -> Column:
    return (
        F.when(ratio >= 400, "PaO2/FiO2 ≥ 400")
        .when(ratio >= 300, "PaO2/FiO2 < 400")
        .when(ratio >= 200, "PaO2/FiO2 < 300")
        .when(ratio >= 100, F.concat(F.lit("PaO2/FiO2 < 200 "), _support(ventilated)))
        .when(ratio < 100, F.concat(F.lit("PaO2/FiO2 < 100 "), _support(ventilated)))
    )


def _support(ventilated: Column) -> Column:
    return F.when(ventilated, "with mechanical ventilation").otherwise("without mechanical ventilation")


def describe_cardiovascular(score: Column) -> Column:
    return (
        F.when(score == 4, "High dose vasopressors")
        .when(score == 3, "Medium dose vasopressors")
        .when(score == 2, "Low dose dopamine or dobutamine")
        .when(score == 1, "MAP < 70 mmHg")
        .when(score == 0, "MAP ≥ 70 mmHg")
    )


def total_score(subscores: dict[str, Column]) -> Column:
    """Sum over the known subscores."""
    total = F.lit(0)
    for name in COMPONENTS:
        total = total + F.coalesce(subscores[name], F.lit(0))
    return total


def missing_components(subscores: dict[str, Column]) -> Column:
    """Names of the systems without a subscore, in fixed order."""
    return F.array_compact(F.array(*[F.when(subscores[n].isNull(), F.lit(n)) for n in COMPONENTS]))


def severity(total: Column) -> Column:
    return (
        F.when(total.isNull(), "Unknown")
        .when(total == 0, "Normal")
        .when(total <= 6, "Mild")
        .when(total <= 12, "Moderate")
        .when(total <= 18, "Severe")
        .otherwise("Critical")
    )


def oxygen_fraction(fio2: Column) -> Column:
    """Inspired oxygen as a fraction; values above 1 are percentages."""
    fraction = F.when(fio2 > 1, fio2 / 100).otherwise(fio2)
    return F.when(fraction > 0, fraction)


def oxygen_ratio(oxygen: Column, fio2: Column) -> Column:
    return oxygen / oxygen_fraction(fio2)
