"""Mindset scores and detection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights (confidence, recency, diversity, connectivity) and default keywords, by mindset.
WEIGHTS = {"Convergent": (0.5, 0.2, 0.0, 0.3), "Divergent": (0.1, 0.1, 0.6, 0.2), "Algorithmic": (0.3, 0.4, 0.0, 0.3), "Spatial": (0.2, 0.1, 0.2, 0.5)}
KEYWORDS = {
    "Algorithmic": ["verify", "confirm", "check", "validate", "prove", "correct"],
    "Divergent": ["what if", "explore", "brainstorm", "alternative", "imagine", "creative"],
    "Convergent": ["summarize", "consensus", "agree", "common", "overview", "conclude"],
    "Spatial": ["connected", "path", "route", "bridge", "relationship", "link", "network", "graph"],
}
# Diversity of a fact's state and how far a state counts as verified.
STATE_DIVERSITY = {"Accepted": 0.0, "Superseded": 0.2, "Ambiguous": 0.8, "Contradiction": 1.0}
STATE_VERIFIED = {"Accepted": 1.0, "Superseded": 0.4, "Ambiguous": 0.2, "Contradiction": 0.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, (int, float)) else x


def clamp(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def weighted(signals: list, weights: tuple) -> Column:
    """Sum of weight x signal within 0..1, over the sum of weights; 0 if there is none."""
    total = sum(weights)
    if total == 0:
        return F.lit(0.0)
    out = F.lit(0.0)
    for s, w in zip(signals, weights):
        out = out + w * clamp(s)
    return out / total


def score(mindset: str, confidence, recency, diversity, connectivity) -> Column:
    return weighted([confidence, recency, diversity, connectivity], WEIGHTS[mindset])


def _by_state(state, table: dict) -> Column:
    out = F
    for name, value in table.items():
        out = out.when(_c(state) == name, value)
    return out.otherwise(0.0)


def recency_in_range(timestamp, now, span) -> Column:
    """1 - age / span within 0..1; 1 if the span is 0, 0 for a future time stamp."""
    age = _c(now) - _c(timestamp)
    return F.when(_c(span) == 0, 1.0).when(age < 0, 0.0).otherwise(1 - clamp(age / _c(span)))


def score_fact(mindset: str, confidence, state, timestamp, now, span, connectivity) -> Column:
    """C2."""
    return score(mindset, confidence, recency_in_range(timestamp, now, span), _by_state(state, STATE_DIVERSITY), connectivity)


def score_node(mindset: str, timestamp, now, span, connectivity) -> Column:
    """A node has confidence 0.5 and no diversity."""
    return score(mindset, 0.5, recency_in_range(timestamp, now, span), 0.0, connectivity)


def corroboration(count, saturation) -> Column:
    """ln(1+n) / ln(1+s) within 0..1; 0 if either is 0."""
    n, s = _c(count), _c(saturation)
    return F.when((n <= 0) | (s <= 0), 0.0).otherwise(clamp(F.log1p(n.cast("double")) / F.log1p(s.cast("double"))))


def convergent(confidence, recency, diversity, connectivity, paths) -> Column:
    """C4: confidence is mixed with how many paths agree."""
    return score("Convergent", 0.6 * clamp(confidence) + 0.4 * corroboration(paths, 5), recency, diversity, connectivity)


def divergent(confidence, recency, rarity, connectivity, paths) -> Column:
    """What is rare and little corroborated counts as diverse."""
    return score("Divergent", confidence, recency, 0.6 * clamp(rarity) + 0.4 * (1 - corroboration(paths, 5)), connectivity)


def algorithmic(confidence, recency, diversity, connectivity, state, contradictions) -> Column:
    """Confidence is mixed with the state's verification and the lack of contradictions."""
    own = 0.4 * clamp(confidence) + 0.4 * _by_state(state, STATE_VERIFIED) + 0.2 * (1 - corroboration(contradictions, 3))
    return score("Algorithmic", own, recency, diversity, connectivity)


def spatial(confidence, connectivity, betweenness, hubness, path_length) -> Column:
    """Recency holds path closeness, diversity holds centrality."""
    near = F.when(_c(path_length) <= 0, 0.0).otherwise(1.0 / _c(path_length))
    central = 0.5 * clamp(betweenness) + 0.5 * clamp(hubness)
    own = 0.4 * clamp(confidence) + 0.6 * (0.4 * clamp(connectivity) + 0.4 * central + 0.2 * near)
    return score("Spatial", own, near, central, connectivity)


def detect(text, keywords: dict | None = None) -> Column:
    """The first mindset, in the order of the lists, of which a keyword stands between word boundaries (ASCII letters and digits)."""
    lowered, out = F.lower(_c(text)), []
    for name in ("Algorithmic", "Divergent", "Convergent", "Spatial"):
        words = (keywords or KEYWORDS).get(name) or []
        if words:
            either = "|".join(re.escape(w.lower()) for w in words)
            out.append(F.when(lowered.rlike(f"(?<![A-Za-z0-9])(?:{either})(?![A-Za-z0-9])"), F.lit(name)))
    return F.coalesce(*out, F.lit(None).cast("string")) if out else F.lit(None).cast("string")


def analyse(text, keywords: dict | None = None) -> Column:
    """``detect``, then rules on the form of the question, in order; null if none holds."""
    t = F.trim(F.lower(_c(text)))
    begins = lambda *words: t.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")")
    return F.coalesce(
        detect(text, keywords),
        F.when(t.contains("how") & (t.contains("connect") | t.contains("relate") | t.contains("link to")), F.lit("Spatial")),
        F.when(t.contains("different") | t.contains("compare") | t.contains("versus") | t.contains("vs "), F.lit("Divergent")),
        F.when(begins("is ", "are ", "should ", "does "), F.lit("Algorithmic")),
        F.when(begins("what is", "what's", "tell me about"), F.lit("Convergent")),
    )
