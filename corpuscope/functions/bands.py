"""Decision bands as ``CASE WHEN`` chains (PF-10 … PF-17, AGG-9).

Cut points are parameters; the defaults are the reference's values.  Labels
are plain text (the reference decorates some with emoji; that is display).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    # PF-10: confusing-pair risk on the raw similarity
    risk_high: float = 0.90
    # PF-11: phrase actions on the raw similarity
    move: float = 0.95
    rephrase: float = 0.90
    # PF-12: health grades
    grade_good: float = 70.0
    grade_fair: float = 50.0
    # PF-13 / PF-14: search actions on the top similarity
    duplicate: float = 0.98
    add: float = 0.85
    review: float = 0.70
    confidence: float = 0.70
    # PF-15 caption bands
    cap_very_high: float = 0.95
    # PF-16 match types
    mt_very_high: float = 0.95
    mt_high: float = 0.85
    mt_moderate: float = 0.75
    mt_low: float = 0.60
    # REC-1 / AGG-9 / REC-6 / REC-7 on the 3-decimal pair similarity (T-9)
    critical_pair: float = 0.90
    must_fix: float = 0.92
    should_fix_lo: float = 0.85
    # AGG-9 / AGG-10: conflicts counted as "move/delete"
    phrase_critical: float = 0.95
    # AGG-14 search statistics
    stat_very: float = 0.95
    stat_high: float = 0.85

    def with_(self, **kw) -> "Bands":
        return replace(self, **kw)


DEFAULT = Bands()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk(sim, b: Bands = DEFAULT) -> Column:
    return F.when(_col(sim) > b.risk_high, "High").otherwise("Medium")


def phrase_action(sim, b: Bands = DEFAULT) -> Column:
    s = _col(sim)
    return (F.when(s > b.move, "MOVE or DELETE")
            .when(s > b.rephrase, "REPHRASE")
            .otherwise("REVIEW"))


def phrase_reason(sim, b: Bands = DEFAULT) -> Column:
    s = _col(sim)
    return (F.when(s > b.move, "Almost identical to other intent")
            .when(s > b.rephrase, "Very similar - needs differentiation")
            .otherwise("Moderately similar - consider rewording"))


def grade(score, b: Bands = DEFAULT) -> Column:
    s = _col(score)
    return (F.when(s >= b.grade_good, "Good")
            .when(s >= b.grade_fair, "Fair")
            .otherwise("Needs Work"))


def batch_action(top_sim, b: Bands = DEFAULT) -> Column:
    s = _col(top_sim)
    return (F.when(s > b.duplicate, "DUPLICATE")
            .when(s > b.add, "ADD")
            .when(s > b.review, "REVIEW")
            .otherwise("NEW_INTENT"))


def single_action(top_sim, confidence, b: Bands = DEFAULT) -> Column:
    s, c = _col(top_sim), _col(confidence)
    return (F.when(s > b.duplicate, "DUPLICATE")
            .when((s > b.add) & (c > b.confidence), "ADD")
            .when(s > b.review, "REVIEW")
            .otherwise("NEW_INTENT"))


# fixed values in what follows: captions, match types and sentences
def similarity_caption(top_sim, b: Bands = DEFAULT) -> Column:
    s = _col(top_sim)
    return (F.when(s > b.cap_very_high, "Very High -- Likely duplicate")
            .when(s > b.add, "High -- Good fit")
            .when(s > b.review, "Moderate -- Acceptable fit")
            .otherwise("Low -- Consider new intent"))


def confidence_caption(confidence, b: Bands = DEFAULT) -> Column:
    return F.when(_col(confidence) > b.confidence, "High confidence").otherwise("Mixed results")


def match_type(sim, phrase, query, b: Bands = DEFAULT) -> Column:
    from corpuscope.functions.text import py_strip
    s = _col(sim)
    exact = F.lower(py_strip(_col(phrase))) == F.lower(py_strip(_col(query)))
    return (F.when(exact, "Exact")
            .when(s > b.mt_very_high, "Very High")
            .when(s > b.mt_high, "High")
            .when(s > b.mt_moderate, "Moderate")
            .when(s > b.mt_low, "Low")
            .otherwise("Very Low"))


def action_sentence(action, intent) -> Column:
    """PF-17: batch action as a sentence; a missing intent reads ``N/A``."""
    a, i = _col(action), F.coalesce(_col(intent), F.lit("N/A"))
    return (F.when(a == "DUPLICATE", F.lit("DUPLICATE -- Do not add"))
            .when(a == "ADD", F.concat(F.lit("ADD to "), i))
            .when(a == "REVIEW", F.concat(F.lit("REVIEW -- possibly "), i))
            .when(a == "NEW_INTENT", F.lit("NEW INTENT suggested"))
            .otherwise(a))


def sim3(sim) -> Column:
    """The 3-decimal value the reference compares after formatting (T-9)."""
    return F.round(_col(sim), 3)
