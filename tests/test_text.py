import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import similar
from marginalia.functions import text as T
from marginalia.operators import scrub


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c("t") if callable(c) else c for c in columns]).first()


def test_names(spark):
    assert one(spark, "  Mary   ANN ", T.normal_name)[0] == "mary ann"
    assert one(spark, "Anna-Lena_O Bo", T.name_parts)[0] == ["anna", "lena", "bo"]


def test_redact_keeps_words_with_letters_of_any_script(spark):
    assert one(spark, "ask Ann Lee or a.b@c.org now", T.redact_pii)[0] == "ask [REDACTED] or [REDACTED] now"
    assert one(spark, "ÉAnn Lee", T.redact_pii)[0] == "ÉAnn Lee"


def test_truncate_and_snippet(spark):
    assert one(spark, " " + "x" * 181, T.truncate)[0] == "x" * 180 + "…"
    assert one(spark, "abc KEY def", lambda c: T.snippet(c, "key", 2))[0] == "...c KEY d..."
    assert one(spark, "abcdef", lambda c: T.snippet(c, "zz", 2))[0] == "...abc..."
    assert one(spark, None, lambda c: T.snippet(c, "zz"))[0] == "......"


def test_headers(spark):
    assert one(spark, "\nName:  Ann   Lee Smith\nx", T.header_name)[0] == "Ann Lee"
    assert one(spark, "no header", T.header_name)[0] is None
    assert one(spark, "x\ncontinue: Ann Lee \ny", T.continuation_name)[0] == "Ann Lee"


def test_pdf_text(spark):
    assert one(spark, "a\nb\n\nc\n \n \n\nd   e ", T.normal_pdf_text)[0] == "a b\n\nc\n\nd e"


def test_escapes(spark):
    assert one(spark, "a\\b{c}&%$#_~^", T.escape_latex)[0] == r"a\textbackslash{}b\{c\}\&\%\$\#\_\textasciitilde{}\textasciicircum{}"
    assert one(spark, "<a href='x'>&</a>", T.escape_html)[0] == "&lt;a href=&#x27;x&#x27;&gt;&amp;&lt;/a&gt;"


def test_lenient_json(spark):
    def read(t):
        return spark.createDataFrame([(t,)], "t string").select(F.to_json(T.lenient_json("t"))).first()[0]

    assert read('x ```json\n{"a": [1,],}\n``` y') == '{"a":[1]}'
    assert read('say {"a":1} end') == '{"a":1}'
    assert read("[1, 2] tail") == "[1,2]"
    assert read("no json") is None
    assert read(None) is None


def test_added_text_is_difflibs(spark):
    rows = [("abc", "abcd"), ("abc", "xbc"), ("", "new"), (None, "n"), ("same", "same"), ("abcdef", "abXdef")]
    got = spark.createDataFrame(rows, "a string, b string").select(similar.added_text("a", "b").alias("r"), "a", "b").collect()
    for r in got:
        ops = difflib.SequenceMatcher(None, r["a"] or "", r["b"], autojunk=False).get_opcodes()
        assert r["r"]["added"] == sum(k - j for tag, _, _, j, k in ops if tag in ("insert", "replace"))


def test_find_quote():
    assert similar.find_quote("one two  three", "two  three") == (4, 14)
    assert similar.find_quote("one two \n three", "two three") == (4, 15)
    assert similar.find_quote("the quick brown fox jumps", "quick brwn fox") is not None
    assert similar.find_quote("abc", "entirely different") is None


def test_quotes_like_the_text():
    body = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness."
    at = similar.find_quote(body, "it was teh worst of times, it was an age of wisdom")
    assert body[slice(*at)].strip(" ,").startswith("it was the worst of times, it was the age of")
    assert similar.find_quote(body, "") == (0, 0) and similar.find_quote("", "abc") is None
    assert similar.find_quote("a.b c", "a.b  c") == (0, 5)


def test_paragraphs_and_log(spark):
    long = "This line is a good deal longer than the others are"
    raws = ["one\ntwo\nthree", "a\fb", f"{long}\n{long}\n{long}\nThe end.\n{long}\nand more", f"{long}\n \n\n\n{long}", None, " ", "x" * 300 + "\n" + "y" * 300 + ".\nz"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r[0] for r in rows.orderBy("i").select(similar.paragraphs(F.col("raw"))).collect()]
    assert got == ["one two three", "a\n\nb", f"{long} {long} {long} The end.\n\n{long} and more", f"{long}\n\n{long}", None, "", "x" * 300 + " " + "y" * 300 + ". z"]
    logs = ["ok\n! Bad\nl.1\nx\n", "! a\n! b\n1\n2\n3\n4\n5\n6\n", "! last", "fine ! not", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(logs)], "i int, log string")
    got = [r[0] for r in rows.orderBy("i").select(similar.tex_errors(F.col("log"))).collect()]
    assert got == [["! Bad\nl.1\nx"], ["! a", "! b\n1\n2\n3\n4\n5"], ["! last"], [], []]


def test_a_changed_text_that_diverged(spark):
    rows = spark.createDataFrame([("one two three", "one two there"), ("one two three", "something else"), ("kept", None), (None, "")], "a string, b string")
    assert [r[0] for r in rows.select(similar.unless_diverged("a", "b")).collect()] == ["one two there", "one two three", "kept", ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ab é-_", max_size=12), min_size=1, max_size=4))
def test_scrubbing_twice_changes_nothing(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = spark.createDataFrame([("ab",), ("é",)], "name string")
    once = scrub.scrub(docs, names).select("doc_id", F.col("scrubbed").alias("text"))
    twice = scrub.scrub(once, names).select("doc_id", F.col("scrubbed").alias("text"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_scrub_layers(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob, ANNA and Zed.", "Bob-Ray Lee"), (2, None, None), (None, "Ann", None), (1, "ann", None)], "doc_id long, text string, who string")
    names = spark.createDataFrame([("ann",), (None,), ("",), ("--",)], "name string")
    got = {(r["doc_id"], r["text"]): r["scrubbed"] for r in scrub.scrub(docs, names, own="who", custom=["zed"]).collect()}
    assert got == {(1, "Ann met Bob, ANNA and Zed."): "[STUDENT_NAME] met [STUDENT_NAME], ANNA and [STUDENT_NAME].", (2, None): None, (None, "Ann"): "[STUDENT_NAME]", (1, "ann"): "[STUDENT_NAME]"}


def test_names_of_several_words(spark):
    docs = spark.createDataFrame([(1, "O'Brien saw Mary Ann, Mary and Jean-Luc; maryann and jean-lucas not. Mary  Ann \u00c9va."), (2, "nothing")], "doc_id long, text string")
    names = spark.createDataFrame([("o'brien",), ("mary ann",), ("Jean-Luc",), ("mary",), ("\u00e9va",), ("a.b(c",)], "name string")
    got = {r["doc_id"]: r["scrubbed"] for r in scrub.scrub(docs, names).collect()}
    x = "[STUDENT_NAME]"
    assert got == {1: f"{x} saw {x}, {x} and {x}; maryann and jean-lucas not. {x}  Ann {x}.", 2: "nothing"}
