"""Rosters, names and campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similar import ratio

#: A roster of at most so many names is broadcast to be compared.
BROADCAST_NAMES = 100_000
LEAST_RATIO = 0.80


def clean_roster(rows: DataFrame, order: str) -> DataFrame:
    """Roster by normal full name: rows without a first or last name go, of
    equal names the last row stays, and a non-numeric id becomes 0."""
    first, last = F.trim("first_name"), F.trim("last_name")
    named = rows.where((first != "") & (last != "")).select(
        F.coalesce(F.when(F.trim("id").rlike(r"^\d+$"), F.trim("id").try_cast("long")), F.lit(0)).alias("id"),
        T.normal_name(F.concat_ws(" ", first, last)).alias("name_key"),
        F.concat_ws(" ", first, last).alias("full_name"),
        F.trim("grade").alias("grade"),
        F.trim("email").alias("email"),
        F.col(order).alias("position"),
    )
    best = named.groupBy("name_key").agg(F.max_by(F.struct("id", "full_name", "grade", "email", "position"), "position").alias("r"))
    return best.select("name_key", "r.*")


def dictionary(rows: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Distinct normal first and last names of two characters and more."""
    names = rows.select(F.explode(F.array("first_name", "last_name")).alias("name"))
    if common is not None:
        names = names.unionByName(common.select("name"))
    key = T.normal_name("name")
    return names.select(key.alias("name")).where(F.length("name") >= 2).distinct()


def full_names(rows: DataFrame) -> DataFrame:
    return rows.select(T.normal_name(F.concat_ws(" ", "first_name", "last_name")).alias("name")).where("name <> ''").distinct()


def validate(detected: DataFrame, roster: DataFrame) -> DataFrame:
    """Detected names (doc_id, name) with ``status`` matched or mismatched,
    and roster names that no document has as missing (null doc_id)."""
    keyed = detected.select("doc_id", "name", T.normal_name("name").alias("name_key"))
    names = roster.select("name_key", F.lit(True).alias("known")).distinct()
    found = keyed.join(names, "name_key", "left").select("doc_id", "name", F.when(F.col("known"), "matched").otherwise("mismatched").alias("status"))
    # who is missing is told by lower case alone
    seen = detected.select(F.lower("name").alias("name_key")).distinct()
    missing = roster.join(seen, "name_key", "left_anti").select(F.lit(None).cast(detected.schema["doc_id"].dataType).alias("doc_id"), F.col("full_name").alias("name"), F.lit("missing").alias("status"))
    return found.unionByName(missing)


#: Letters of the grams that candidates are found by.
GRAM = 3


def _grams(c) -> Column:
    """Distinct runs of ``GRAM`` letters; all of a shorter text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM))))


def _holding(short: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b) where text ``a`` of ``short`` is within text ``b`` of ``long``.

    Each ``a`` is looked up by that of its grams which the fewest ``b`` have;
    those of fewer letters than a gram by themselves among shorter runs."""
    keyed = long.select("b", F.explode(_grams(F.col("b"))).alias("g"))
    common = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = short.where(F.length("a") >= GRAM).select("a", F.explode(_grams(F.col("a"))).alias("g")).join(common, "g", "left")
    rarest = asked.groupBy("a").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    found = rarest.join(keyed, "g").where(F.contains("b", "a")).select("a", "b")
    few = short.where(F.length("a") < GRAM)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("b"), F.lit(1))), lambda i: F.substring(F.col("b"), i, n))))
    parts = long.select("b", F.explode(F.array_distinct(F.concat(runs, F.array(F.lit(""))))).alias("a"))
    return found.union(few.join(parts, "a").select("a", "b")).distinct()


def suggest(names: DataFrame, roster: DataFrame, most: int = 5) -> DataFrame:
    """Roster names that contain a given name or are contained in it: the
    first ``most`` in roster order.  Null names have no suggestions.

    Containment has no join key: the shorter text is looked up by its rarest
    run of three letters, so common ones form no pairs."""
    left = names.where("name is not null").select("name", F.lower(F.trim("name")).alias("n")).distinct()
    # of equal roster names the first ``most`` are enough, and they are compared once
    places = roster.where("full_name is not null").select("full_name", "position").distinct()
    places = places.withColumn("of_name", F.row_number().over(Window.partitionBy("full_name").orderBy("position"))).where(F.col("of_name") <= most)
    right = places.select("full_name", F.lower(F.trim("full_name")).alias("r")).distinct()
    texts, others = left.select("n").distinct(), right.select("r").distinct()
    inside = _holding(texts.select(F.col("n").alias("a")), others.select(F.col("r").alias("b"))).select(F.col("a").alias("n"), F.col("b").alias("r"))
    around = _holding(others.select(F.col("r").alias("a")), texts.select(F.col("n").alias("b"))).select(F.col("b").alias("n"), F.col("a").alias("r"))
    pairs = left.join(inside.union(around).distinct(), "n").join(right, "r").select("name", "full_name").distinct().join(places.select("full_name", "position"), "full_name")
    w = Window.partitionBy("name").orderBy("position")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select("name", "full_name", "rank")


def _alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, floor, bound): texts (column t) whose lengths and letters allow a
    ratio of ``floor`` (a column of ``left``, ``least`` or more), and the
    highest that they allow."""
    labelled = lambda c: F.transform(F.split(c, ""), lambda x, i: F.concat(x, F.size(F.filter(F.slice(F.split(c, ""), 1, i + 1), lambda y: y == x)).cast("string")))
    held = right.select("t", F.length("t").alias("n"), labelled(F.col("t")).alias("ls"), F.lit(least).alias("floor"))
    asked = left.select("t", F.length("t").alias("n"), labelled(F.col("t")).alias("ls"), "floor")
    # letters by rarity among those that are looked up in; a letter that none has comes first
    common = held.select(F.explode("ls").alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("c"))

    def ranked(df):
        rows = df.select("t", "n", "ls", "floor", F.explode("ls").alias("l")).join(common, "l", "left")
        return rows.groupBy("t", "n", "floor").agg(F.first("ls").alias("ls"), F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "l"))), lambda s: s["l"]).alias("by"))

    # with lengths n and m a pair needs o = ceil(floor / 2 * (n + m)) letters in common; whatever m is,
    # o is at least ceil(floor / (2 - floor) * n), so the first n - o + 1 letters by rarity hold one of them
    spare = F.col("n") - F.ceil(F.col("n") * F.col("floor") / (2 - F.col("floor")) - 1e-9) + 1
    first = lambda df: ranked(df).select("t", "n", "ls", "floor", F.slice("by", F.lit(1), spare.cast("int")).alias("by"))
    x = first(asked).select(F.col("t").alias("x"), F.col("n").alias("nx"), F.col("ls").alias("lx"), F.col("by").alias("bx"), "floor", F.explode("by").alias("l"))
    y = first(held).select(F.col("t").alias("y"), F.col("n").alias("ny"), F.col("ls").alias("ly"), F.col("by").alias("by"), F.explode("by").alias("l"))
    # a pair counts where it meets first
    met = x.join(y, "l").where((F.least("nx", "ny") * 2 >= (F.col("nx") + F.col("ny")) * F.col("floor") - 1e-9) & (F.get(F.array_intersect("bx", "by"), F.lit(0)) == F.col("l")))
    best = F.size(F.array_intersect("lx", "ly")) * 2 / (F.col("nx") + F.col("ny"))
    return met.select("x", "y", "floor", best.alias("bound")).where(F.col("bound") >= F.col("floor") - 1e-9)


def _near(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, score): texts (column t) that are equal once each has lost one
    letter at most, and their ratio where it is ``least`` or more."""

    def shorter(c):
        n = F.length(c)
        without = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n))))
        # a letter less, a pair's ratio is 2 (n - 1) / (2 n - 1) at most
        return F.array_distinct(F.concat(F.array(F.xxhash64(c)), F.when((n - 1) * 2 >= (n * 2 - 1) * least - 1e-9, without).otherwise(F.array().cast("array<bigint>"))))

    x, y = (df.select(F.col("t").alias(name), F.explode(shorter(F.col("t"))).alias("k")) for df, name in ((left, "x"), (right, "y")))
    return x.join(y, "k").select("x", "y").distinct().withColumn("score", ratio("x", "y")).where(F.col("score") >= least)


def fuzzy_match(names: DataFrame, roster: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Best roster row of each distinct name: by equal normal name if that row
    has an e-mail, else by the highest ratio of at least ``least``; ties to
    the earlier row.  A match without an e-mail is no match.

    Of most names the best is told by those that differ in one letter (of
    either or of both): any other ratio is at most n / (n + 1) for a name of n
    letters.  The rest is compared with all, with what it has found so far as
    the least.  Only pairs that can reach that are aligned.  The ratio is twice
    the aligned letters over all letters, so a pair that reaches it shares so
    many letters (counted with repeats) that, of each text's labelled letters
    in the order of their rarity, the first few must hold a common one; that
    one is the join key.  All letters that a pair shares bound its ratio: a
    name is aligned with the row of its highest bound first, and then with
    those alone whose bounds reach that ratio."""
    wanted = names.select("name", T.normal_name("name").alias("key")).distinct()
    people = roster.select("name_key", "full_name", "email", "position")
    mailed = people.where(F.coalesce("email", F.lit("")) != "")
    exact = wanted.join(mailed, wanted["key"] == mailed["name_key"]).select("name", "full_name", "email", F.lit(1.0).alias("score"))
    rest = wanted.join(exact.select("name"), "name", "left_anti").where("key <> ''").select("name", "key")
    keys, others = rest.select(F.col("key").alias("t")).distinct(), people.select(F.col("name_key").alias("t")).where("t <> ''").distinct()
    near = _near(keys, others, least)
    found = keys.join(near.groupBy(F.col("x").alias("t")).agg(F.max("score").alias("score")), "t", "left")
    n = F.length("t")
    unsettled = found.where(F.coalesce(F.col("score") <= n / (n + 1) + 1e-9, F.lit(True))).select("t", F.coalesce("score", F.lit(least)).alias("floor"))
    far = _alike(unsettled, others, least)
    tops = far.groupBy("x").agg(F.max_by("y", F.struct("bound", "y")).alias("y"))
    floors = tops.select("x", ratio("x", "y").alias("reached"))
    far = far.join(floors, "x").where(F.col("bound") >= F.greatest("floor", "reached") - 1e-9).select("x", "y", ratio("x", "y").alias("score")).where(F.col("score") >= least)
    pairs = near.unionByName(far)
    scored = rest.join(pairs, rest["key"] == pairs["x"]).join(people, F.col("y") == F.col("name_key"))
    best = scored.groupBy("name").agg(F.max_by(F.struct("full_name", "email", "score"), F.struct("score", -F.col("position"))).alias("m"))
    close = best.select("name", "m.full_name", "m.email", "m.score").where(F.coalesce("email", F.lit("")) != "")
    return exact.unionByName(close)


def campaign(students: DataFrame, sent: DataFrame, addresses: DataFrame, reports: DataFrame) -> DataFrame:
    """Class of each named student, the first that fits: already_sent,
    missing_email, missing_report, ready.  All inputs have ``name``."""
    flag = lambda df, c: df.select("name").distinct().withColumn(c, F.lit(True))
    joined = students.where("name <> ''").join(flag(sent, "was_sent"), "name", "left").join(flag(addresses, "has_address"), "name", "left").join(flag(reports, "has_report"), "name", "left")
    out = F.when(F.col("was_sent"), "already_sent").when(F.col("has_address").isNull(), "missing_email").when(F.col("has_report").isNull(), "missing_report").otherwise("ready")
    return joined.select(*students.columns, out.alias("class"))


# fixed values: why a student can't be written to
NOT_FOUND = "Student name not found in roster (possible OCR error or typo)"
NO_ADDRESS = "Student found in roster but has no email address"
NO_REPORT = "PDF not generated for this student"


def triage(students: DataFrame, skipped: DataFrame, roster: DataFrame, reports: DataFrame) -> DataFrame:
    """Why a student can't be written to; those on the skip list are left out."""
    known = roster.groupBy("name").agg(F.max(F.coalesce("email", F.lit(""))).alias("email"))
    left = students.join(skipped.select("name").distinct(), "name", "left_anti")
    joined = left.join(known, "name", "left").join(reports.select("name").distinct().withColumn("has_report", F.lit(True)), "name", "left")
    why = (
        F.when(F.col("email").isNull(), NOT_FOUND)
        .when(F.col("email") == "", NO_ADDRESS)
        .when(F.col("has_report").isNull(), NO_REPORT)
        .otherwise("ready")
    )
    return joined.select(*students.columns, why.alias("reason"))


# fixed values: what a report is called in a subject
REPORT_LABELS, REPORT = {"student_html": "Feedback Report", "student_pdf": "Feedback Report (PDF)"}, "Report"


def subject(given, assignment, report_type) -> Column:
    """The subject given, else one made of the report's label and the
    assignment, where there is one."""
    label = F.coalesce(*[F.when(report_type == k, v) for k, v in REPORT_LABELS.items()], F.lit(REPORT))
    made = F.concat(F.lit("Your "), label, F.when(F.coalesce(assignment, F.lit("")) != "", F.concat(F.lit(": "), assignment)).otherwise(""))
    return F.coalesce(F.nullif(given, F.lit("")), made)


def planned(students: DataFrame, sent: DataFrame, addresses: DataFrame, reports: DataFrame, only: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """``campaign`` with those left out that ``only`` (names, if given) lacks
    or ``skip`` has, in any case; these are ``skipped`` unless already sent."""
    rows = campaign(students, sent, addresses, reports)
    lowered = lambda df, c: df.select(F.lower("name").alias("_low"), F.lit(True).alias(c)).distinct()
    out = rows.withColumn("_low", F.lower("name"))
    left_out = F.lit(False)
    if only is not None:
        out = out.join(lowered(only, "_only"), "_low", "left")
        left_out = F.col("_only").isNull()
    if skip is not None:
        out = out.join(lowered(skip, "_skip"), "_low", "left")
        left_out = left_out | F.coalesce("_skip", F.lit(False))
    return out.select(*students.columns, F.when((F.col("class") != "already_sent") & left_out, "skipped").otherwise(F.col("class")).alias("class"))


def retry(log: DataFrame) -> DataFrame:
    """Names with a failed attempt and none that succeeded, with the number
    of failed attempts."""
    by = log.groupBy("job_id", "report_type", "student_name").agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "SENT").alias("sent"))
    return by.where("failed > 0 and sent = 0").select("job_id", "report_type", "student_name", "failed")
