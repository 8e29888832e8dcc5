"""Row rules: decision tables over single results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DENIED = "permission denied|forbidden|unauthenticated|invalid api key"
_BUSY = "too many requests|rate limit|resource_exhausted"
_PERMANENT = f"{_DENIED}|invalid argument|bad request| 40[013]"
_PASSING = f"{_BUSY}|timeout|timed out|connection|network|temporar|unavailable| 429| 50[0234]"
_EVERYWHERE = f"{_DENIED}|{_BUSY}|quota"


def _text(error: Column) -> Column:
    return F.lower(F.coalesce(error, F.lit("")))


def retryable(error: Column) -> Column:
    """Whether an error's text speaks of a passing fault; permanent ones win."""
    return ~_text(error).rlike(_PERMANENT) & _text(error).rlike(_PASSING)


def global_error(error: Column) -> Column:
    """Whether later requests would meet the same error."""
    return _text(error).rlike(_EVERYWHERE)


def stage2_confidence(verdict: Column, evidence: Column, false_friend: Column, adoption: Column, mechanism: Column, scope: Column, focus: Column) -> Column:
    """Confidence from the verdict and what backs it, never from the model's own claim. Missing flags hold."""
    size = F.length(F.coalesce(evidence, F.lit("")))
    friend = F.coalesce(false_friend, F.lit("no")) == "yes"
    flags = F.coalesce(mechanism, F.lit(True)) & F.coalesce(scope, F.lit(True)) & F.coalesce(focus, F.lit(True))
    adoption = F.coalesce(adoption, F.lit(""))
    return (
        F.when(verdict == "insufficient_context", "low")
        .when(verdict == "no", F.when(size >= 15, "medium").otherwise("low"))
        .when(verdict == "uncertain", F.when((size < 15) | friend, "low").otherwise("medium"))
        .when(friend | (size < 15), "low")
        .when(~flags, "medium")
        .when(adoption.isin("superficial_mention", "not_related"), "low")
        .when(size >= 50, "high")
        .otherwise("medium")
    )


def remap_locations(locations: Column, artifact_type: Column, loose: bool = False) -> Column:
    """A pull request's body is its description. ``loose`` also takes "Pull Request" for the type."""
    kind = F.lower(F.coalesce(artifact_type, F.lit("")))
    kind = F.regexp_replace(kind, r"\s+", "_") if loose else kind
    return F.when(kind == "pull_request", F.transform(locations, lambda x: F.when(x == "body", F.lit("pull_request_description")).otherwise(x))).otherwise(locations)


def weakest(present: Column) -> Column:
    """The weakest of an array of confidences; else its first; blank if empty."""
    low = F.transform(F.filter(present, lambda x: x != ""), F.lower)
    return F.when(F.array_contains(low, "low"), "low").when(F.array_contains(low, "medium"), "medium").when(F.array_contains(low, "high"), "high").otherwise(F.coalesce(F.get(low, F.lit(0)), F.lit("")))


def succeeded(status: Column) -> Column:
    """A missing status is a success."""
    return F.coalesce(F.lower(status), F.lit("succeeded")) == "succeeded"
