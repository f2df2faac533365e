"""Judge answers and evaluation scores as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import has_any, strip


def clamp(c: Column) -> Column:
    """Into 0..1.  ``least`` and ``greatest`` skip NULL, so a missing score is kept missing here."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def parse_score(c: Column, take: str = "last") -> Column:
    """A judge's answer as a number in 0..1: the whole text, else its last (or first) number, else NULL."""
    text = strip(c)
    whole = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text).try_cast("double")
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1))
    part = F.try_element_at(found, F.lit(-1 if take == "last" else 1)).try_cast("double")
    return clamp(F.coalesce(whole, part))


def answer_relevancy(question: Column, answer: Column, cosine: Column, judge: Column) -> dict[str, Column]:
    """Weighted mean of shifted cosine and judge score; whichever exists when one is missing; 0 for empty input."""
    empty = is_blank(question) | is_blank(answer)
    semantic = clamp((cosine + 1) / 2)
    both = semantic * v.SEMANTIC_WEIGHT + judge * v.JUDGE_WEIGHT

    def out(c: Column) -> Column:
        return F.when(empty, 0.0).otherwise(F.bround(c, 4))

    return {
        "answer_relevancy": out(F.coalesce(both, semantic, judge)),
        "semantic_similarity": out(semantic),
        "judge_relevancy": out(judge),
    }


def faithfulness(answer: Column, valid_contexts: Column, judge: Column) -> Column:
    """0 for an empty answer, NULL without contexts, else the judge's score."""
    return F.when(is_blank(answer), 0.0).when(F.coalesce(valid_contexts, F.lit(0)) == 0, None).otherwise(judge)


def correctness(answer: Column, ground_truth: Column, judge: Column) -> Column:
    """0 for an empty answer, NULL without ground truth, else the judge's score."""
    return F.when(is_blank(answer), 0.0).when(is_blank(ground_truth), None).otherwise(judge)


def generation_failed(answer: Column, error: Column) -> Column:
    """Must the answer be generated again?  The answer reports an error, or the error field names a passing fault."""
    text = F.coalesce(answer, F.lit(""))
    has_error = F.coalesce(error, F.lit("")) != ""
    return has_any(text, v.ANSWER_ERROR_MARKS) | (
        has_error & (has_any(F.coalesce(error, F.lit("")), v.ERROR_FIELD_MARKS) | (strip(text) == ""))
    )


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def stable_round(c: Column, digits: int) -> Column:
    """Half-even rounding of a mean, after the noise of summing in another order is cut off at nine digits."""
    return F.bround(F.round(c, 9), digits)
