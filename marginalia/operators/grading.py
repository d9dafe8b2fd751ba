"""Objective tests: decoding sheets, scoring, statistics, gradebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..schemas import COMMENTS, EVALUATION

# fixed values: fill thresholds of a sheet
FILLED, RELATIVE, BLANK = 0.35, 0.6, 0.08


def decode_answers(fills: DataFrame, keys=("page", "number")) -> DataFrame:
    """Marked options of each question (columns ``label``, ``score``):
    those filled; else none if the best is all but blank; else those close to
    the best.  ``answer`` is sorted and comma-joined, ``warning`` says how."""
    grouped = fills.groupBy(*keys).agg(F.collect_list(F.struct("label", "score")).alias("all"), F.max("score").alias("best"))
    pick = lambda test: F.array_sort(F.transform(F.filter("all", test), lambda o: o["label"]))
    filled = pick(lambda o: o["score"] >= FILLED)
    near = pick(lambda o: o["score"] >= F.greatest(F.lit(FILLED / 2), F.col("best") * RELATIVE))
    blank = F.col("best") < BLANK
    marked = F.when(F.size(filled) > 0, filled).when(blank, F.array().cast("array<string>")).otherwise(near)
    warning = F.when(F.size(filled) > 0, F.lit(None).cast("string")).when(blank, "blank").otherwise("faint")
    return grouped.select(*keys, F.array_join(marked, ",").alias("answer"), warning.alias("warning"))


def decode_ids(fills: DataFrame, keys=("page",)) -> DataFrame:
    """Student id of each page from its digits (``number``, ``label``,
    ``score``): one filled value is the digit; else ``?`` if the best is all
    but blank or not clearly ahead.  Any ``?`` makes the id ``ERROR``."""
    grouped = fills.groupBy(*keys, "number").agg(
        F.max(F.struct("score", "label")).alias("top"),
        F.sort_array(F.collect_list("score"), asc=False).alias("scores"),
        F.count_if(F.col("score") >= FILLED).alias("filled"),
        F.max(F.when(F.col("score") >= FILLED, F.col("label"))).alias("one"),
    )
    best, second = F.get("scores", F.lit(0)), F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0))
    digit = F.when(F.col("filled") == 1, F.col("one")).when(best < BLANK, "?").when(second >= RELATIVE * best, "?").otherwise(F.col("top.label"))
    joined = grouped.select(*keys, "number", digit.alias("digit")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "digit"))), lambda s: s["digit"]), "").alias("read"))
    return joined.select(*keys, F.when(F.contains("read", F.lit("?")), "ERROR").otherwise(F.col("read")).alias("student_id"))


def duplicate_questions(key: DataFrame) -> DataFrame:
    """Questions that a key has more than once: such a key is to be refused,
    as they would count twice."""
    return key.groupBy("job_id", S.question_key(F.col("question")).alias("question")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def score_questions(responses: DataFrame, key: DataFrame) -> DataFrame:
    """A row for each response and question of its job's key.

    ``responses``: job_id, response_id, position, question, answer.  ``key``:
    job_id, question, answer, points.  Of several answers to a question the
    first counts; a missing one selects nothing."""
    first = responses.groupBy("job_id", "response_id", S.question_key(F.col("question")).alias("question")).agg(F.min_by("answer", "position").alias("answer"))
    spec = key.select("job_id", S.question_key(F.col("question")).alias("question"), T.split_answers("answer").alias("correct"), "points")
    everyone = responses.select("job_id", "response_id").distinct().join(spec, "job_id")
    joined = everyone.join(first, ["job_id", "response_id", "question"], "left")
    return joined.select("job_id", "response_id", "question", "answer", "points", S.option_score(F.col("points"), F.col("correct"), T.split_answers("answer")).alias("score"))


def score_responses(responses: DataFrame, key: DataFrame) -> DataFrame:
    """Total and percentage of each response, as ``response_totals`` of
    ``score_questions`` gives them, scored within the response's own row: its
    answers meet once, and a job's key, which is small, comes to them."""
    given = F.array_sort(F.collect_list(F.struct("position", S.question_key(F.col("question")).alias("question"), "answer")))
    answers = responses.groupBy("job_id", "response_id").agg(given.alias("given"))
    spec = key.groupBy("job_id").agg(F.collect_list(F.struct(S.question_key(F.col("question")).alias("question"), T.split_answers("answer").alias("correct"), "points")).alias("spec"))
    joined = answers.join(spec, "job_id")
    first = lambda q: F.get(F.filter("given", lambda a: a["question"] == q), F.lit(0))["answer"]
    scores = F.transform("spec", lambda k: S.option_score(k["points"], k["correct"], T.split_answers(first(k["question"]))))
    total = F.round(F.aggregate(scores, F.lit(0.0), lambda n, x: n + x), 2)
    points = F.aggregate("spec", F.lit(0.0), lambda n, k: n + k["points"])
    return joined.select("job_id", "response_id", total.alias("score"), points.alias("_points")).select("job_id", "response_id", "score", F.when(F.col("_points") > 0, F.round(F.col("score") / F.col("_points") * 100, 2)).otherwise(0.0).alias("percent"))


def response_totals(scored: DataFrame) -> DataFrame:
    """Total and percentage of each response, to two places."""
    total, points = F.round(F.sum("score"), 2), F.sum("points")
    return scored.groupBy("job_id", "response_id").agg(total.alias("score"), F.when(points > 0, F.round(total / points * 100, 2)).otherwise(0.0).alias("percent"))


def score_stats(df: DataFrame, score: str, percent: str | None = None, by: list[str] = ()) -> DataFrame:
    """Count, mean, lowest and highest score and mean percentage, to two
    places; zeros for no rows, and nulls don't count."""
    two = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    out = [F.count(score).alias("n"), two(F.avg(score)).alias("mean_score"), two(F.min(score)).alias("min_score"), two(F.max(score)).alias("max_score")]
    if percent:
        out.append(two(F.avg(percent)).alias("mean_percent"))
    return df.groupBy(*by).agg(*out)


def grade_stats(df: DataFrame, grade: str, status: str, by: list[str]) -> DataFrame:
    """Graded and pending rows and statistics of the grades that are numbers.
    Only ``GRADED`` counts as graded."""
    value = F.when(F.col(status) == "GRADED", S.grade_value(F.col(grade)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(status) == "GRADED").alias("graded"),
        F.count_if(F.coalesce(F.col(status) != "GRADED", F.lit(True))).alias("pending"),
        F.count(value).alias("numeric"),
        F.avg(value).alias("mean_grade"),
        F.min(value).alias("min_grade"),
        F.max(value).alias("max_grade"),
    )


def criteria(essays: DataFrame, evaluation: str = "evaluation") -> DataFrame:
    """A row per essay and criterion of its evaluation JSON, with its place."""
    parsed = F.from_json(evaluation, EVALUATION)
    rows = essays.select("job_id", "id", F.posexplode(parsed["criteria"]).alias("position", "c"))
    return rows.select("job_id", "id", "position", F.col("c.name").alias("name"), F.col("c.score").alias("score"), F.coalesce("c.feedback.explanation", "c.feedback.justification").alias("comment"))


def criteria_stats(rows: DataFrame) -> DataFrame:
    """Per criterion: all rows, and mean, lowest and highest of the numeric
    scores; criteria without a numeric one are left out."""
    value = S.grade_value(F.col("score"))
    stats = rows.groupBy("job_id", "name").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"))
    return stats.where("mean_score is not null")


def overridden(rows: DataFrame, essays: DataFrame, comments: str = "teacher_comments") -> DataFrame:
    """Criterion scores with the teacher's over them.  Empty and zero
    overrides don't count; of several the last one does."""
    given = essays.select("job_id", "id", F.posexplode(F.from_json(comments, COMMENTS)["criteria_overrides"]).alias("p", "o"))
    given = given.where((F.coalesce(F.col("o.score"), F.lit("")) != "") & (F.coalesce(F.col("o.score").try_cast("double"), F.lit(1.0)) != 0))
    last = given.groupBy("job_id", "id", F.col("o.name").alias("name")).agg(F.max_by("o.score", "p").alias("teacher"))
    return rows.join(last, ["job_id", "id", "name"], "left").withColumn("score", F.coalesce("teacher", "score")).drop("teacher")


def first_seen(rows: DataFrame, name: str, *order: str) -> list:
    """Distinct names by first appearance, for a pivot's columns.  These are
    the columns of a report, so few enough to be planned with."""
    firsts = rows.groupBy(name).agg(F.min(F.struct(*order)).alias("at")).where(F.col(name).isNotNull())
    return [r[name] for r in firsts.orderBy("at").collect()]


def pivot(rows: DataFrame, keys: list[str], name: str, value: str, position: str, columns: list | None = None) -> DataFrame:
    """One column per name; a later duplicate wins."""
    columns = columns if columns is not None else first_seen(rows, name, *keys, position)
    return rows.groupBy(*keys).pivot(name, columns).agg(F.max_by(value, position))


def final_grade(teacher, own) -> Column:
    """The teacher's grade, else the first one, else empty."""
    return F.coalesce(T.first_filled(teacher, own), F.lit(""))


def coverage(questions: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Share of questions with a source, at most 100, and what each type
    lacks (``expected``: key, type, expected)."""
    have = questions.groupBy(by, "type").agg(F.count(F.lit(1)).alias("actual"))
    short = expected.join(have, [by, "type"], "left").select(by, "type", "expected", F.coalesce("actual", F.lit(0)).cast("long").alias("actual"))
    score = questions.groupBy(by).agg(F.least(F.lit(100.0), F.count_if(F.coalesce("source_reference", F.lit("")) != "") / F.greatest(F.lit(1), F.count(F.lit(1))) * 100).alias("coverage"))
    return short.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("actual"))).join(score, by, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def numbered(questions: DataFrame, by: str, types=("mcq", "fib", "sa")) -> DataFrame:
    """Running number over types in their order, within each job."""
    rank = F.array_position(F.lit(list(types)), F.col("question_type"))
    return questions.withColumn("question_number", F.row_number().over(Window.partitionBy(by).orderBy(rank, "position")).cast("int"))


def sheet_layout(questions: int, options: int = 5, per_column: int = 25, left: float = 60.0, top: float = 200.0, step: float = 18.0, column: float = 150.0, radius: float = 5.5):
    """Positions of a sheet's bubbles as SQL over sequences, one row each."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    q, o = F.col("number") - 1, F.col("option_no")
    rows = spark.range(1, questions + 1).select(F.col("id").cast("int").alias("number")).select("number", F.explode(F.sequence(F.lit(0), F.lit(options - 1))).alias("option_no"))
    return rows.select(
        "number",
        F.char(F.lit(97) + o).alias("option"),
        (left + F.floor(q / per_column) * column + (o + 1) * step).cast("double").alias("x"),
        (top + (q % per_column) * step).cast("double").alias("y"),
        F.lit(radius).alias("radius"),
    )


def answer_key_text(questions: DataFrame, by: str) -> DataFrame:
    """``number. answer (points)`` lines of each job, in order, and the total."""
    line = F.concat(F.col("question_number").cast("string"), F.lit(". "), F.coalesce("correct_answer", "model_answer", F.lit("")), F.lit(" ("), F.col("points").cast("string"), F.lit(")"))
    rows = questions.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("question_number", line.alias("l")))).alias("ls"), F.sum("points").alias("total_points"))
    return rows.select(by, F.array_join(F.transform("ls", lambda s: s["l"]), "\n").alias("text"), "total_points")


def bubble_key(questions: DataFrame, by: str) -> DataFrame:
    """Multiple-choice answers of each job as a sheet's key, in JSON."""
    mcq = questions.where(F.col("question_type") == "mcq")
    entry = F.struct("question_number", F.concat(F.lit("Q"), F.col("question_number").cast("string")).alias("question"), F.lower("correct_answer").alias("answer"), "points")
    rows = mcq.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select(by, F.to_json(F.transform("e", lambda s: F.struct(s["question"].alias("question"), s["answer"].alias("answer"), s["points"].alias("points")))).alias("key_data"))


def word_bank(questions: DataFrame, by: str, seed: int = 0) -> DataFrame:
    """Answers to the blanks of each job in a seeded order."""
    fib = questions.where((F.col("question_type") == "fib") & F.col("correct_answer").isNotNull())
    rows = fib.groupBy(by).agg(F.collect_list(F.struct(F.xxhash64("correct_answer", F.lit(seed)).alias("h"), "correct_answer")).alias("a"))
    return rows.select(by, F.array_distinct(F.transform(F.array_sort("a"), lambda s: s["correct_answer"])).alias("words"))


def grade_job(responses: DataFrame, key: DataFrame, latest_by: str | None = None) -> dict[str, DataFrame]:
    """A job's grading in one go, for all jobs at once.

    ``responses``: job_id, response_id, position, question, answer, and the
    column that ``latest_by`` names, if any: of several sheets of a response
    the last one counts.  ``key`` as for ``score_questions``; of a question
    that it has twice the first counts.  Returns ``questions``, ``totals``,
    ``stats`` (by job) and ``refused`` (questions a key has twice)."""
    if latest_by:
        last = responses.groupBy("job_id", "response_id").agg(F.max(latest_by).alias("_last"))
        responses = responses.join(last, ["job_id", "response_id"]).where(F.col(latest_by) == F.col("_last")).drop("_last")
    refused = duplicate_questions(key)
    single = key.groupBy("job_id", S.question_key(F.col("question")).alias("question")).agg(F.min(F.struct("answer", "points")).alias("k")).select("job_id", "question", "k.*")
    questions = score_questions(responses, single)
    totals = score_responses(responses, single)
    return {"questions": questions, "totals": totals, "stats": score_stats(totals, "score", "percent", ["job_id"]), "refused": refused}


# fixed values: sections of a test by type, their titles and instructions
SECTIONS = {
    "mcq": ("Multiple Choice", "Choose the best answer for each question."),
    "fib": ("Fill in the Blank", "Complete each sentence with the correct word or phrase."),
    "sa": ("Short Answer", "Answer each question in complete sentences."),
}


def sections(questions: DataFrame, by: str, by_type: bool = True, with_points: bool = True) -> DataFrame:
    """Nested sections of each job's test: by type, or all questions as one.

    ``questions``: ``by``, question_number, question_type, question_text,
    options (array of letter and text), points.  Types without a section are
    left out, as are sections without a question; null points count as 1."""
    points = F.coalesce("points", F.lit(1.0)) if with_points else F.lit(None).cast("double")
    options = F.when(F.col("question_type") == "mcq", F.col("options"))
    entry = F.struct(F.col("question_number").alias("number"), F.col("question_type").alias("type"), F.coalesce("question_text", F.lit("")).alias("text"), options.alias("options"), points.alias("points"))
    known = questions.where(F.col("question_type").isin(*SECTIONS))
    place = F.array_position(F.lit(list(SECTIONS)), F.col("question_type")) if by_type else F.lit(1)
    part = known.groupBy(by, place.alias("place")).agg(F.array_sort(F.collect_list(F.struct("question_number", entry.alias("q")))).alias("qs"))
    said = lambda i: F.element_at(F.lit([v[i] for v in SECTIONS.values()]), F.col("place").cast("int"))
    title, instructions = (said(0), said(1)) if by_type else (F.lit("Questions"), F.lit(""))
    made = part.select(by, F.struct("place", title.alias("title"), instructions.alias("instructions"), F.transform("qs", lambda s: s["q"]).alias("questions")).alias("s"))
    totals = questions.groupBy(by).agg(F.count(F.lit(1)).alias("total_questions"), F.sum(F.coalesce("points", F.lit(1.0))).alias("total_points"))
    nested = made.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["title"].alias("title"), s["instructions"].alias("instructions"), s["questions"].alias("questions"))).alias("sections"))
    return totals.join(nested, by, "left")


#: Widths of the rules, and what a test has for a name.
WIDE, NARROW, NAME_LINE = "=" * 60, "-" * 40, "Name: ________________________  Date: ____________"


def test_text(tests: DataFrame, by: str, words: DataFrame | None = None, header: bool = True) -> DataFrame:
    """Plain text of each test: (by, text).

    ``tests``: ``by``, name, description (may be null), total_points and
    ``sections``, as ``sections`` gives them.  ``words``: ``by`` and words, a
    word bank for the tests that have one."""
    rows = tests.join(words.select(by, F.col("words").alias("_words")), by, "left") if words is not None else tests.withColumn("_words", F.lit(None).cast("array<string>"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    listed = F.array

    def question(q):
        worth = F.when(F.coalesce(q["points"], F.lit(0.0)) != 0, line(" (", q["points"].cast("string"), " pts)")).otherwise("")
        choices = F.transform(F.coalesce(q["options"], F.array().cast("array<struct<letter:string,text:string>>")), lambda o: line("    ", F.coalesce(o["letter"], F.lit("?")), ". ", F.coalesce(o["text"], F.lit(""))))
        return F.concat(listed(line(F.coalesce(q["number"].cast("string"), F.lit("?")), ".", worth, " ", q["text"])), choices, listed(F.lit("")))

    def section(s):
        told = F.when(s["instructions"] != "", listed(line("Instructions: ", s["instructions"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(listed(line("\n", s["title"]), F.lit(NARROW)), told, listed(F.lit("")), F.flatten(F.transform(s["questions"], question)))

    none = F.array().cast("array<string>")
    head = none
    if header:
        about = F.when(F.coalesce("description", F.lit("")) != "", listed(line("  ", F.col("description")))).otherwise(none)
        head = F.concat(listed(F.lit(WIDE), line("  ", F.coalesce("name", F.lit("Test")))), about, listed(line("  Total Points: ", F.col("total_points").cast("string")), F.lit(WIDE), F.lit(""), F.lit(NAME_LINE), F.lit("")))
    bank = F.when(F.size("_words") > 0, listed(F.lit("\nWord Bank"), F.lit(NARROW), F.array_join("_words", ", "), F.lit(""))).otherwise(none)
    body = F.coalesce(F.flatten(F.transform("sections", section)), none)
    return rows.select(by, F.array_join(F.concat(head, body, bank), "\n").alias("text"))


test_text.__test__ = False  # no test of pytest's
