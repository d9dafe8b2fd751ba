"""Scores, points and grades on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as a grade may have it: what a cast alone takes too freely.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# fixed values: weights of question types, and the default split
WEIGHTS = {"mcq": 1.0, "fib": 1.5, "sa": 5.0}
DEFAULT_SPLIT = {"mcq": 0.5, "fib": 0.3}


def multi_select_score(points, n_correct, hits, extras) -> Column:
    """max(0, hits - extras) shares of the points; 0 without a correct option."""
    share = (hits - extras) * (points / n_correct)
    return F.when(n_correct <= 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), share) + 1e-12, 2))


def option_score(points, correct, selected) -> Column:
    """Score of selected options (array) against correct ones (array): one
    correct option wants an exact match, several give shares."""
    correct, selected = F.array_distinct(correct), F.array_distinct(selected)
    several = multi_select_score(points, F.size(correct), F.size(F.array_intersect(selected, correct)), F.size(F.array_except(selected, correct)))
    same = F.array_sort(correct) == F.array_sort(selected)
    return F.when(F.size(correct) > 1, several).otherwise(F.when(same, F.round(points, 2)).otherwise(0.0))


def round_half(x) -> Column:
    """To the nearest half; ties to the even one."""
    return F.bround(x * 2) / 2


def grade_value(x) -> Column:
    """Number of a grade like ``95`` or ``18/20`` (what stands before the
    first slash); null for letters and anything else."""
    head = F.split(x, "/")[0]
    return F.when(head.rlike(NUMBER), head.try_cast("double"))


def question_key(x) -> Column:
    """``q01``, ``Q1`` and ``1`` are one question; other names by upper case."""
    upper = F.upper(x.cast("string"))
    number = F.regexp_extract(upper, r"^Q*0*([0-9]+)$", 1)
    named = F.when(upper.startswith("Q"), upper).otherwise(F.concat(F.lit("Q"), upper))
    return F.when(number != "", F.concat(F.lit("Q"), number)).otherwise(named)


def points_per_question(counts: dict[str, Column], total) -> dict[str, Column]:
    """Points of one question of each type: the total by weight, to a half."""
    weight = sum((counts[t] * w for t, w in WEIGHTS.items()), F.lit(0.0))
    return {t: F.when((counts[t] > 0) & (weight > 0), round_half(counts[t] * w / weight * total / counts[t])).otherwise(0.0) for t, w in WEIGHTS.items()}


def default_split(total) -> dict[str, Column]:
    """Half multiple choice, three tenths blanks, the rest short answers."""
    mcq, fib = (F.floor(total * DEFAULT_SPLIT[t]).cast("int") for t in ("mcq", "fib"))
    return {"mcq": mcq, "fib": fib, "sa": total - mcq - fib}


def percent_text(x) -> Column:
    """A share as a whole percentage, ties to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))
