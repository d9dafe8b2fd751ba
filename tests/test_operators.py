import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import scoring as S
from marginalia.operators import audit, external, grading, people, replies, reports, sessions, store
from marginalia.schemas import CHILDREN, TABLES


@pytest.mark.parametrize(("answer", "score"), [("a,d", 1.0), ("a", 0.5), ("d", 0.5), ("a,c", 0.0), ("a,d,c", 0.5), ("a,b,c,d", 0.0), ("b,c", 0.0), ("", 0.0), (None, 0.0)])
def test_multi_select(spark, answer, score):
    responses = spark.createDataFrame([("j", 1, 0, "q01", answer)], "job_id string, response_id long, position int, question string, answer string")
    key = spark.createDataFrame([("j", "1", "a,d", 1.0)], "job_id string, question string, answer string, points double")
    assert grading.score_questions(responses, key).first()["score"] == score


def test_single_select_and_totals(spark):
    responses = spark.createDataFrame([("j", 1, 0, "Q1", "B"), ("j", 1, 1, "1", "a"), ("j", 1, 2, "2", "c")], "job_id string, response_id long, position int, question string, answer string")
    key = spark.createDataFrame([("j", "1", "b", 1.0), ("j", "02", "d", 2.0)], "job_id string, question string, answer string, points double")
    row = grading.response_totals(grading.score_questions(responses, key)).first()
    assert (row["score"], row["percent"]) == (1.0, 33.33)


def test_half_points(spark):
    got = spark.createDataFrame([(x,) for x in (2.3, 2.6, 2.8, 2.25)], "x double").select(S.round_half(F.col("x"))).collect()
    assert [r[0] for r in got] == [2.5, 2.5, 3.0, 2.0]


def test_grades(spark):
    rows = [("95",), ("18/20",), ("A",), ("85d",), (None,), (" 7.5 ",), ("1_0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string").select(S.grade_value(F.col("g"))).collect()]
    assert got == [95.0, 18.0, None, None, None, 7.5, None]


def test_decode(spark):
    fills = [(1, 1, "a", 0.5), (1, 1, "b", 0.4), (1, 2, "a", 0.05), (1, 3, "a", 0.3), (1, 3, "b", 0.2), (1, 3, "c", 0.1)]
    got = {r["number"]: r["answer"] for r in grading.decode_answers(spark.createDataFrame(fills, "page int, number int, label string, score double")).collect()}
    assert got == {1: "a,b", 2: "", 3: "a,b"}
    digits = [(1, 0, "1", 0.9), (1, 0, "2", 0.4), (1, 1, "3", 0.9), (2, 0, "1", 0.01), (3, 0, "1", 0.2), (3, 0, "2", 0.15)]
    ids = {r["page"]: r["student_id"] for r in grading.decode_ids(spark.createDataFrame(digits, "page int, number int, label string, score double")).collect()}
    assert ids == {1: "13", 2: "ERROR", 3: "ERROR"}


def test_criteria_and_overrides(spark):
    ev = '{"criteria":[{"name":"A","score":3},{"name":"B","score":"good"}]}'
    tc = '{"criteria_overrides":[{"name":"A","score":"4"},{"name":"A","score":""},{"name":"B","score":"0"}]}'
    essays = spark.createDataFrame([("j", 1, ev, tc), ("j", 2, "broken", None)], "job_id string, id long, evaluation string, teacher_comments string")
    rows = grading.criteria(essays)
    assert {(r["name"], r["score"]) for r in grading.overridden(rows, essays).collect()} == {("A", "4"), ("B", "good")}
    assert [(r["name"], r["n"], r["mean_score"]) for r in grading.criteria_stats(rows).collect()] == [("A", 1, 3.0)]
    wide = grading.pivot(rows, ["job_id", "id"], "name", "score", "position")
    assert wide.columns == ["job_id", "id", "A", "B"]


def test_sessions(spark):
    pages = [("f", i + 1, f" t{i + 1} ", n, None) for i, n in enumerate([None, "Ann", None, "Bob"])]
    got = sessions.sessionise(spark.createDataFrame(pages, "file string, page_no int, text string, detected_name string, continuation_name string"))
    assert [tuple(r) for r in got.orderBy("document").collect()] == [("f", 1, "Unknown Student 01", "t1", 1, 1, 1), ("f", 2, "Ann", "t2\n\nt3", 2, 3, 2), ("f", 3, "Bob", "t4", 4, 4, 1)]


def test_routed_pages(spark):
    def routed(rows):
        df = spark.createDataFrame([("f", *r) for r in rows], "file string, page_no int, text string, detected_name string, continuation_name string")
        return [(r["student_name"], r["text"].split("\f"), r["start_page"], r["end_page"]) for r in sessions.sessionise_routed(df).orderBy("document").collect()]

    rows = [(1, "a", "Ann", None), (2, "b", "Bob", None), (3, "c", None, " ann "), (4, "d", None, None), (5, "e", None, "Cid"), (6, "f", "Cid", None), (7, "g", None, "Dee")]
    assert routed(rows) == [("Ann", ["a", "c"], 1, 3), ("Bob", ["b", "d"], 2, 4), ("Cid", ["f", "e"], 5, 6), ("Dee", ["g"], 7, 7)]
    # a page that continues nobody comes before the document that is open; the last of a name has its pages
    rows = [(1, "a", None, None), (2, "b", None, "  "), (3, "c", "Ann", ""), (4, "d", "ANN", None), (5, "e", None, "Ann"), (6, "f", None, "Eve"), (7, "g", None, "eve"), (8, "h", None, None)]
    assert routed(rows) == [("Unknown Student 02", ["b"], 2, 2), ("Unknown Student 01", ["a"], 1, 1), ("Ann", ["c"], 3, 3), ("ANN", ["d", "e", "h"], 4, 8), ("Eve", ["f", "g"], 6, 7)]
    assert routed([(1, "x", None, "Zed")]) == [("Zed", ["x"], 1, 1)] and routed([]) == []


def test_page_text(spark):
    words = [("f", 1, i, w, t) for i, (w, t) in enumerate([("a", 0.0), ("b", 2.0), ("c", 10.0), ("d", 20.0), ("e", 50.0)])]
    got = sessions.page_text(spark.createDataFrame(words, "file string, page_no int, seq int, word string, top double")).first()["text"]
    assert got == "a b\nc\nd\n\ne"


def test_latest_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 1, "x"), (None, 2, 2, "y"), (5, 1, 3, "z"), (5, 1, 4, "w")], "k int, at int, id int, v string")
    assert {(r["k"], r["v"]) for r in store.latest(rows, ["k"], "at", "id").collect()} == {(None, "y"), (5, "w")}


def test_store_mutations(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id int, x string, y string")
    change = spark.createDataFrame([(1, None, "new")], "id int, x string, y string")
    assert sorted(tuple(r) for r in store.patch(base, change, "id").collect()) == [(1, "a", "new"), (2, "b", "c")]
    assert sorted(tuple(r) for r in store.replace_by_key(base, change, ["id"]).collect()) == [(1, None, "new"), (2, "b", "c")]
    tables = {"jobs": spark.createDataFrame([("a",), ("b",)], "id string"), "essays": spark.createDataFrame([(1, "a"), (2, "b")], "id long, job_id string")}
    left = store.cascade(tables, CHILDREN, "jobs", "id", spark.createDataFrame([("a",)], "k string"))
    assert [r[0] for r in left["jobs"].collect()] == ["b"] and [r["id"] for r in left["essays"].collect()] == [2]
    # a child without a column called id, and what hangs from it
    deep = {"a": spark.createDataFrame([(1,), (2,)], "id int"), "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "bk int, fk int"), "c": spark.createDataFrame([("x", 10), ("y", 11)], "v string, b int")}
    left = store.cascade(deep, {"a": [("b", "fk")], "b": [("c", "b")]}, "a", "id", spark.createDataFrame([(1,)], "k int"), {"b": "bk"})
    assert {n: sorted(map(str, (tuple(r) for r in df.collect()))) for n, df in left.items()} == {"a": ["(2,)"], "b": ["(11, 2)", "(12, None)"], "c": ["('y', 11)"]}
    soft = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "id string, archived boolean")
    assert {r["id"]: (r["archived"], r["changed"]) for r in store.archive(soft, ["a", "b"]).collect()} == {"a": (True, True), "b": (True, False), "c": (False, False)}
    first = spark.createDataFrame([(1,)], "id int")
    assert store.conform(first, TABLES["jobs"]).columns[0] == "id" and store.conform(first, TABLES["jobs"]).first()["archived"] is None


def test_map_entries_and_words(spark):
    row = spark.range(1).select(store.set_entry(F.create_map(F.lit("k"), F.lit("old")), "k", F.lit("new")).alias("m"), store.merge_words(F.lit(["b"]), F.lit(["a", "b"])).alias("w"), store.merge_words(F.lit(["b"]), F.lit(["c"]), True).alias("r")).first()
    assert row["m"] == {"k": "new"} and row["w"] == ["a", "b"] and row["r"] == ["c"]


def test_roster_and_fuzzy(spark):
    raw = spark.createDataFrame([("7", "Ann", "Lee", "9", "a@x", 0), ("x", " Ann", "LEE ", "9", "b@x", 1), ("1", "", "No", "9", "", 2), ("2", "Bob", "Ray", "9", None, 3)], "id string, first_name string, last_name string, grade string, email string, position long")
    roster = people.clean_roster(raw, "position")
    assert {(r["name_key"], r["id"], r["email"]) for r in roster.collect()} == {("ann lee", 0, "b@x"), ("bob ray", 2, None)}
    names = spark.createDataFrame([("ann  lee",), ("Ann Leee",), ("Bob Ray",), ("Zoe",), (None,)], "name string")
    assert {r["name"]: r["full_name"] for r in people.fuzzy_match(names, roster).collect()} == {"ann  lee": "Ann LEE", "Ann Leee": "Ann LEE"}
    assert [(r["full_name"]) for r in people.suggest(spark.createDataFrame([("Ray",)], "name string"), roster).collect()] == ["Bob Ray"]


def test_a_ratio_of_exactly_the_least_is_met(spark):
    roster = spark.createDataFrame([("abcdefghijkl", "L", "l@x", 0), ("xy", "S", "s@x", 1)], "name_key string, full_name string, email string, position long")
    names = spark.createDataFrame([("abcdefgh",), ("xyz",)], "name string")
    assert {r["name"]: r["full_name"] for r in people.fuzzy_match(names, roster).collect()} == {"abcdefgh": "L", "xyz": "S"}


def test_suggestions_over_the_whole_table_against_brute_force(spark):
    from marginalia.plans import registry

    sf = "/root/testdata/sf0.001"
    parts = [(r["p_partkey"], r["p_name"]) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()]
    want = set()
    for name in {n for _, n in parts}:
        hits = [n for _, n in sorted(parts) if name.strip().lower() in n.strip().lower() or n.strip().lower() in name.strip().lower()]
        want |= {(name, n, i + 1) for i, n in enumerate(hits[:5])}
    got = [tuple(r) for r in registry.QUERIES["containment_suggest"](spark, sf).select("name", "full_name", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_disjoint_and_annotated(spark):
    spans = spark.createDataFrame([([(5, 8, "x"), (0, 4, "<y>"), (3, 6, "z")], "abcd&efgh")], "i array<struct<start:int,end:int,comment:string>>, t string")
    kept = audit.keep_disjoint(F.col("i"))
    row = spans.select(kept.alias("k"), reports.annotated(F.col("t"), kept).alias("h")).first()
    assert [(s["start"], s["end"]) for s in row["k"]] == [(0, 4), (5, 8)]
    assert row["h"] == '<span class="annotation" title="&lt;y&gt;">abcd</span>&amp;<span class="annotation" title="x">efg</span>h'


def test_labels(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (25,), (26,)], "i int").select(audit.label(F.col("i"))).collect()] == ["Submission A", "Submission Z", "Submission 27"]


def test_bursts_are_inclusive(spark):
    rows = spark.sql("select 1 d, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) ts, a added, 100 final from values (0, 30), (10, 31), (25, 39) as t(m, a)")
    assert audit.bursts(rows, ["d"], "ts", "added", "final").first()["burst_added"] == 61


def test_external_stubs(spark):
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert external.with_retry(flaky, wait=lambda s: None)("p") == "ok"
    rows = spark.createDataFrame([("a",), (None,)], "prompt string")
    out = external.complete(rows, "prompt", "reply").collect()
    assert out[0]["reply"].startswith("{") and out[1]["reply"] is None
    log = external.send(spark.createDataFrame([("n", "e", "s", "b")], "student_name string, email string, subject string, body string"), lambda *a: None, dry_run=True)
    assert log.first()["status"] == "DRY_RUN"


def test_archive(spark):
    import io
    import zipfile

    rows = spark.createDataFrame([("j", "b.html", "x"), ("j", "a.html", "yy")], "job string, name string, content string")
    z = zipfile.ZipFile(io.BytesIO(bytes(reports.archive(rows, "job", "name", "content").first()["archive"])))
    assert z.namelist() == ["a.html", "b.html", "manifest.json"]


def test_store_lookups_and_counters(spark):
    jobs = spark.createDataFrame([("a", "NEW", 7), ("b", None, None)], "id string, status string, n int")
    rows = spark.createDataFrame([(1, "a", "ok"), (2, "a", "bad"), (3, None, "ok")], "id int, job_id string, status string")
    assert store.lookup(jobs, "id", "b").count() == 1 and [r["id"] for r in store.children_of(rows, "job_id", "a", ["id"], ["ok"]).collect()] == [1]
    assert store.without(rows, ["status"]).columns == ["id", "job_id"]
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (9, "a")], "id int, job_id string")
    assert {tuple(r) for r in store.owned(rows, "id", "job_id", asked).collect()} == {(1, "a", "ok"), (1, "b", "not owned"), (9, "a", "not found")}
    fresh = store.refreshed(jobs, rows, "id", "job_id", {"n": F.col("status") == "ok"})
    assert {(r["id"], r["n"]) for r in fresh.collect()} == {("a", 1), ("b", 0)} and fresh.columns == jobs.columns
    raised = store.incremented(jobs, spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), "id", "n")
    assert {(r["id"], r["n"]) for r in raised.collect()} == {("a", 9), ("b", 1)}
    other = spark.createDataFrame([("b", "OLD", 1), ("c", "OLD", 2)], "id string, status string, n int")
    got = store.resolved(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string"), [jobs, other], "id")
    assert {(r["id"], r["n"], r["found_in"]) for r in got.collect()} == {("a", 7, 0), ("b", None, 0), ("c", 2, 1), ("d", None, None)}
    stamped = store.stamped(jobs.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), spark.createDataFrame([("b",)], "k string"), "id", "DONE", "2024-01-01 00:00:00")
    assert {(r["id"], r["status"], str(r["updated_at"])) for r in stamped.collect()} == {("a", "NEW", "None"), ("b", "DONE", "2024-01-01 00:00:00")}
    past = store.page(jobs, "id", {"id": "id"}, "id", offset=10).collect()
    assert len(past) == 1 and past[0]["total"] == 2 and past[0]["id"] is None


def test_nearest_against_brute_force(spark, monkeypatch):
    import numpy as np

    from marginalia.operators import knowledge

    monkeypatch.setattr(knowledge, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, 2.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3)
    queries = [(i, v) for i, v in vecs if i % 6 == 0]
    got = knowledge.top_k(spark.createDataFrame(queries, "query_id long, query array<double>"), df, 4).collect()
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    for i, q in queries:
        near = sorted((-round(cos(q, v), 9), k) for k, v in vecs if v and len(v) == len(q) and any(v) and any(q))[:4]
        mine = sorted((r["rank"], -round(r["similarity"], 9)) for r in got if r["query_id"] == i)
        assert [s for _, s in mine] == [s for s, _ in near], i
    assert knowledge.top_k(spark.createDataFrame([], "query_id long, query array<double>"), df, 4).count() == 0


def test_flags_of_a_submission(spark):
    def flags(revisions, deadline=None):
        rows, old = [], ""
        for i, (at, text) in enumerate(revisions):
            new = text[len(old) :] if text.startswith(old) else text
            rows.append(("d", i + 1, at, len(new), new, len(text), len(text.split()), deadline))
            old = text
        df = spark.createDataFrame(rows, "doc string, rev_no int, modified_time string, added long, first string, length long, words long, deadline string")
        return [(r["flag_type"], r["severity"], r["description"], r["snippet"]) for r in audit.flags(df, "doc", "deadline").orderBy("flag_no").collect()]

    essay = "word " * 400
    got = flags([("2024-01-01T23:30:00Z", essay[:1700]), ("2024-01-01T23:35:00Z", essay)], "2024-01-02T00:30:00Z")
    assert [g[:2] for g in got] == [("bulk_insertion", "high"), ("few_revisions", "medium"), ("burst_editing", "high"), ("cold_start", "medium"), ("timing_off_hours", "low"), ("deadline_crunch", "medium")]
    assert got[0][2] == "Revision 1 added 1700 characters (85% of final document) in one step." and got[1][2] == "Document has 400 words but only 2 revision(s)."
    assert got[0][3] == essay[:180] + "…" or len(got[0][3]) == 181
    # a time that can't be read; an even split; a name in the snippet
    assert [g[0] for g in flags([("never", "a" * 50), ("2024-01-01T23:00:00Z", "a" * 50 + "b" * 10)])] == ["bulk_insertion", "cold_start"]
    assert flags([("2024-01-01T12:00:00Z", "x")])[0][0] == "bulk_insertion" and flags([("2024-01-01T12:00:00Z", "")]) == []
    assert flags([("2024-01-01T12:00:00+0200", "by John Smith a@b.c")])[0][3] == "by [REDACTED] [REDACTED]"
    # ten minutes apart, ends included, is a burst; a second more is none
    assert "burst_editing" in [g[0] for g in flags([("2024-01-01T12:00:00Z", "a" * 35), ("2024-01-01T12:10:00Z", "a" * 70), ("2024-01-02T12:10:00Z", "a" * 100)])]
    assert "burst_editing" not in [g[0] for g in flags([("2024-01-01T12:00:00Z", "a" * 35), ("2024-01-01T12:10:01Z", "a" * 70), ("2024-01-02T12:10:00Z", "a" * 100)])]


def test_times_and_dates(spark):
    times = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02T03:04:05+0200", "2024-01-02", "2024-13-02", "yesterday", "", None, "2024-01-02 03:04"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "i int, x string").orderBy("i")
    got = [str(r[0]) for r in rows.select(replies.parse_time(F.col("x")).cast("string")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 01:04:05.5", "2024-01-02 01:04:05", "2024-01-02 00:00:00", "None", "None", "None", "None", "2024-01-02 03:04:00"]
    assert [r[0] for r in rows.select(F.hour(replies.wall_clock(F.col("x")))).collect()] == [3, 3, 3, 0, None, None, None, None, 3]
    dues = spark.createDataFrame([((2024, 5, 6), (7, 8)), ((2024, None, 6), None), (None, (1, 2))], "due struct<year:int,month:int,day:int>, time struct<hours:int,minutes:int>")
    assert [r[0] for r in dues.select(replies.due_time(F.col("due"), F.col("time"))).collect()] == ["2024-05-06T07:08:00Z", "2024-01-06T23:59:00Z", None]


def test_replies_of_loose_shape(spark):
    raws = ['{"criteria": [{"name": "A"}]}', 'Sure:\n```json\n[{"name": "A"}]\n```', '{"criteria": [], "other": [{"name": "B"}]}', '{"name": "C"}', '{"x": 1}', "no json", None, '{"criteria": "text"}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, x string").orderBy("i")
    got = [[json.loads(x) for x in r[0]] for r in rows.select(replies.items(F.col("x"), ["criteria", "other"], "name")).collect()]
    assert got == [[{"name": "A"}], [{"name": "A"}], [{"name": "B"}], [{"name": "C"}], [], [], [], []]
    marks = '{"highlights": [{"quote": "q", "suggestion": "s", "category": "evidence"}, {"quote": " ", "suggestion": "s"}, {"quote": 3, "suggestion": "s"}, "x", {"quote": "q2", "suggestion": "s2", "category": "odd"}, {"quote": "q3"}]}'
    rows = spark.createDataFrame([(0, marks), (1, '{"highlights": {}}'), (2, None)], "i int, x string").orderBy("i")
    got = [[tuple(h) for h in r[0]] for r in rows.select(replies.highlights(F.col("x"))).collect()]
    assert got == [[("q", "evidence", "s"), ("q2", "grammar", "s2")], [], []]


def test_fuzzy_match_against_brute_force(spark):
    import difflib
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdeilnor") for _ in range(n))
    base = [word(rng.randint(1, 9)) + " " + word(rng.randint(1, 9)) for _ in range(120)]
    edited = ["".join(c for c in b if rng.random() > 0.12) + rng.choice(["", "x"]) for b in base] + ["abcdefgh", "ab", "a", "aab", "ü" * 5]
    people_rows = [(b, b.title(), f"{i}@x", i) for i, b in enumerate(base + ["abcdefghijkl", "aba", "ü" * 4])]
    roster = spark.createDataFrame(people_rows, "name_key string, full_name string, email string, position long")
    got = {r["name"]: (r["full_name"], round(r["score"], 9)) for r in people.fuzzy_match(spark.createDataFrame([(e,) for e in edited], "name string"), roster).collect()}
    want = {}
    for e in set(edited):
        key = " ".join(e.lower().split())
        same = [r for r in people_rows if r[0] == key]
        scores = [(1.0, -same[0][3], same[0][1])] if same else [(difflib.SequenceMatcher(None, key, r[0]).ratio(), -r[3], r[1]) for r in people_rows]
        best = max(scores)
        if best[0] >= 0.8 and key:
            want[e] = (best[2], round(best[0], 9))
    assert got == want


def test_suggestions_against_brute_force(spark):
    names = ["ann", "Ann Lee", "a", "", " ", "lee b", "ann lee bob", None, "x", "nn le"]
    roster = [("Ann Lee", 1), ("Bob", 2), ("a", 3), ("Ann Lee", 4), ("Lee", 5), ("ANN LEE BOB", 6), ("", 7), (None, 8), ("n", 9), ("zz", 10)]
    df = spark.createDataFrame(roster, "full_name string, position long")
    got = {}
    for r in people.suggest(spark.createDataFrame([(n,) for n in names], "name string"), df, 4).collect():
        got.setdefault(r["name"], []).append((r["rank"], r["full_name"]))
    want = {}
    for n in names:
        if n is not None:
            low = n.strip().lower()
            fits = [f for f, _ in sorted((r for r in roster if r[0] is not None), key=lambda r: r[1]) if low in f.strip().lower() or f.strip().lower() in low]
            if fits:
                want[n] = list(enumerate(fits[:4], 1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_a_job_graded_and_a_test_laid_out(spark):
    key = spark.createDataFrame([("j", "Q1", "a,d", 1.0), ("j", "2", "b", 2.0), ("j", "q02", "c", 2.0)], "job_id string, question string, answer string, points double")
    sheets = [("j", "r1", 1, "1", "a", 1), ("j", "r1", 1, "1", "a,d", 2), ("j", "r1", 2, "Q2", "b", 2), ("j", "r2", 1, "Q1", "a,c,d", 1)]
    got = grading.grade_job(spark.createDataFrame(sheets, "job_id string, response_id string, position int, question string, answer string, scanned int"), key, "scanned")
    assert {(r["response_id"], r["score"], r["percent"]) for r in got["totals"].collect()} == {("r1", 3.0, 100.0), ("r2", 0.5, 16.67)}
    slow = grading.response_totals(got["questions"]).collect()
    assert {tuple(r) for r in slow} == {tuple(r) for r in got["totals"].collect()}
    assert got["stats"].first()["mean_score"] == 1.75 and [r["question"] for r in got["refused"].collect()] == ["Q2"]
    q = [("j", 1, "mcq", "Which?", [("a", "One"), ("b", "Two")], 2.0), ("j", 2, "fib", "The ____.", None, None), ("j", 3, "essay", "No section", None, 1.0), ("k", 1, "sa", None, None, 0.0)]
    questions = spark.createDataFrame(q, "job string, question_number int, question_type string, question_text string, options array<struct<letter:string,text:string>>, points double")
    nested = grading.sections(questions, "job")
    assert {r["job"]: (r["total_questions"], r["total_points"], [(s["title"], [x["number"] for x in s["questions"]]) for s in r["sections"]]) for r in nested.collect()} == {
        "j": (3, 4.0, [("Multiple Choice", [1]), ("Fill in the Blank", [2])]),
        "k": (1, 0.0, [("Short Answer", [1])]),
    }
    assert [len(r["sections"][0]["questions"]) for r in grading.sections(questions.where("job = 'j'"), "job", by_type=False).collect()] == [2]
    tests = nested.withColumn("name", F.lit("Quiz")).withColumn("description", F.lit(None).cast("string"))
    words = spark.createDataFrame([("j", ["cat", "dog"])], "job string, words array<string>")
    text = {r["job"]: r["text"] for r in grading.test_text(tests, "job", words).collect()}
    assert text["j"].split("\n")[1:3] == ["  Quiz", "  Total Points: 4.0"]
    assert "\n1. (2.0 pts) Which?\n    a. One\n    b. Two\n\n\nFill in the Blank\n" + "-" * 40 in text["j"] and text["j"].endswith("Word Bank\n" + "-" * 40 + "\ncat, dog\n")
    assert "1. \n" in text["k"] and "Word Bank" not in text["k"]


def test_a_campaign_sends_once(spark, tmp_path):
    import pathlib

    from marginalia.operators import external

    outbox = tmp_path / "out"
    outbox.mkdir()

    def transport(address, subject, body, outbox=str(outbox)):
        if "bad" in address:
            raise ValueError("bounced")
        with open(pathlib.Path(outbox) / address, "a") as f:
            f.write(subject)

    ready = spark.createDataFrame([("Ann", "ann@x", "S", "b"), ("Bob", "bad@x", "S", "b"), ("Ann", "ann@x", "S", "b")], "student_name string, email string, subject string, body string")
    run = lambda at, **k: sorted((r["student_name"], r["status"], r["reason"]) for r in external.run_campaign(ready, str(tmp_path / "log"), "j", "student_html", at, transport, **k).collect())
    assert run("2024-01-01 10:00:00", dry_run=True) == [("Ann", "DRY_RUN", None), ("Bob", "DRY_RUN", None)] and not list(outbox.iterdir())
    assert run("2024-01-01 11:00:00") == [("Ann", "SENT", None), ("Bob", "FAILED", "bounced")]
    assert run("2024-01-01 12:00:00") == [("Bob", "FAILED", "bounced")] and (outbox / "ann@x").read_text() == "S"
    assert external.ledger(spark, str(tmp_path / "log")).count() == 5
    students = spark.createDataFrame([("Ann",), ("Bob",), ("Cid",), ("Dee",)], "name string")
    planned = people.planned(students, students.where("name = 'Ann'"), students, students, only=spark.createDataFrame([("ann",), ("BOB",), ("Dee",)], "name string"), skip=spark.createDataFrame([("dee",)], "name string"))
    assert {tuple(r) for r in planned.collect()} == {("Ann", "already_sent"), ("Bob", "ready"), ("Cid", "skipped"), ("Dee", "skipped")}
    subjects = spark.createDataFrame([("Given", "Essay", "student_pdf"), ("", "Essay", "student_pdf"), (None, None, "other")], "s string, a string, r string")
    assert [r[0] for r in subjects.select(people.subject(F.col("s"), F.col("a"), F.col("r"))).collect()] == ["Given", "Your Feedback Report (PDF): Essay", "Your Report"]


def test_services_plug_in(spark):
    from marginalia.operators import external

    rows = spark.createDataFrame([(1, b"abc"), (2, b""), (3, None)], "id int, content binary")

    def pages(content):
        if not content:
            raise ValueError("empty")
        return [content[:1], content[1:]]

    got = {r["id"]: (r["pages"], r["pages_error"]) for r in external.called(rows, "content", "pages", "array<binary>", pages, wait=lambda s: None).collect()}
    assert got[1] == ([bytearray(b"a"), bytearray(b"bc")], None) and got[2] == (None, "ValueError: empty") and got[3] == (None, None)

    def listing(course, token):
        at = int(token or 0)
        return [{"item": f"{course}-{at}"}], (str(at + 1) if at < 2 else None)

    courses = spark.createDataFrame([("c",), ("d",)], "course string")
    assert sorted(tuple(r) for r in external.paged(courses, "course", listing, "item string").collect()) == [(c, f"{c}-{i}") for c in "cd" for i in range(3)]


def test_purge_of_old_jobs(spark):
    tables = {"jobs": spark.sql("select * from values ('a', timestamp_ntz'2020-01-01'), ('b', timestamp_ntz'2024-01-01') as t(id, created)"), "essays": spark.createDataFrame([(1, "a"), (2, "b")], "id long, job_id string")}
    left, gone = store.purged(tables, {"jobs": [("essays", "job_id")]}, "jobs", "id", "created", "2024-02-01 00:00:00")
    assert [r["id"] for r in left["essays"].collect()] == [2] and [r["id"] for r in gone.collect()] == ["a"]


def test_fuzzy_match_of_serial_and_of_short_names(spark):
    import difflib
    import itertools

    texts = [f"serial#{i:05d}" for i in range(0, 300, 3)] + ["".join(t) for n in (1, 2, 3, 5) for t in itertools.product("ab", repeat=n)]
    roster = [(t, t, "e", i) for i, t in enumerate(texts)]
    names = [f"serial#{i // 100:04d}{i % 10}" for i in range(0, 300, 7)] + ["ab", "abab", "babbab", "aaaaaaa", "c"]
    score = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {}
    for x in names:
        r, i = max((score(x, y), -i) for i, y in enumerate(texts))
        if r >= 0.8:
            want[x] = (texts[-i], round(r, 9))
    frame = spark.createDataFrame([(x,) for x in names], "name string")
    got = people.fuzzy_match(frame, spark.createDataFrame(roster, "name_key string, full_name string, email string, position long")).collect()
    assert {r["name"]: (r["full_name"], round(r["score"], 9)) for r in got} == want and len(got) == len(want)
    # one letter less tells all pairs that one letter parts, and only these are aligned
    keys = lambda rows: spark.createDataFrame([(t,) for t in rows], "t string")
    fewer = lambda t: {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}
    near = {(r["x"], r["y"]) for r in people._near(keys(sorted(set(names))), keys(texts), 0.8).collect()}
    assert near == {(x, y) for x in names for y in texts if fewer(x) & fewer(y) and score(x, y) >= 0.8}
