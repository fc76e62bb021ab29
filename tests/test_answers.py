"""Cases of functions and operators whose answers are easy to get nearly right."""

import json

import pytest
from pyspark.sql import functions as F

from gradus.functions import text
from gradus.functions.code import repair_one
from gradus.operators import evaluate, execution, rewards, selection, sequences
from gradus.sources import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*x):
    return F.array(*map(F.lit, x))


def test_entry_points(spark):
    assert one(spark, text.entry_point(arr("assertEqual(foo(1), 2)"))) == "foo"
    assert one(spark, text.entry_point(arr("foo(1)", "assert bar(1) == 2"))) == "foo"
    assert one(spark, text.entry_point(arr("print(range(3))", "assert bar (1)"), F.lit(""))) == "bar"
    assert one(spark, text.entry_point(arr("x = 1"))) is None


def test_repairs():
    assert repair_one("f", ["assert f(2) == 2"], "old") == "def f(x):\n    return x\n"
    assert repair_one("f", ["assert f(2) == -1"], "old") == "def f(x):\n    return x - 3\n"
    assert repair_one("f", ["f(2) == 5", "assert f() == 'a'"], "old") == "old"
    assert repair_one("f", ["assert f() == 12"], "old") == "def f():\n    return 12\n"


def test_texts_of_tools(spark):
    assert one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc\n...<truncated>..." and one(spark, text.truncate(F.lit("abc"), 3)) == "abc"
    assert one(spark, text.last_line(F.lit("a\n   b\n\n"))) == "   b" and one(spark, text.last_line(F.lit("  "))) == ""
    assert not one(spark, text.is_degenerate(F.lit("say\nx\nx\nx\nx"), F.lit("x = 1"))) and one(spark, text.is_degenerate(F.lit("words"), F.lit(" ")))
    assert one(spark, execution.candidate_code(F.lit("import a\n\n"), F.lit("b"))) == "import a\n\nb" and one(spark, execution.candidate_code(F.lit(" "), F.lit("b"))) == "b"
    q = one(spark, text.quality(F.lit("a\n\nbcd\n"), F.lit(True)))
    assert (q.line_count, q.non_empty_line_count, q.char_count, q.max_line_length, q.quality_score) == (3, 2, 7, 3, 1.0)
    with pytest.raises(ValueError, match="direct_solution_v1"):
        text.template("none such")


def test_revision_prompt(spark):
    got = one(spark, text.revision_prompt(F.lit(" add one "), F.lit(""), F.lit("f"), arr("assert f(1) == 2"), F.lit("def f(x): pass\n"), F.lit(" "), F.lit(2)))
    assert got.startswith("You are revising a Python solution") and got.endswith("```\n\nPublic-test feedback:\npublic tests failed\n")
    assert "\n\nRevision attempt: 2\n\nTask:\nadd one\n\nRequired entry point: `f`\n\nPublic tests:\n```python\nassert f(1) == 2\n```\n\nCurrent code:\n```python\ndef f(x): pass\n```\n" in got


def test_layouts_of_others(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text(json.dumps({"task_id": "H/0", "prompt": "p", "entry_point": "h", "hidden_tests": ["a", " "], "tests": ["b"], "test_list": ["c"], "test": "def check(candidate):\n    pass\n"}))
    h = records.read_humaneval(spark, str(tmp_path / "h.jsonl")).first()
    assert [t.code for t in h.hidden_tests] == ["a", "b", "c", "def check(candidate):\n    pass\n\ncheck(h)"] and h.hidden_tests[0].name == "hidden-1"
    (tmp_path / "r.jsonl").write_text(json.dumps({"task_id": "a", "sample_index": 1, "prompt": "p", "raw_completion": "c", "parsed": {"code": "c", "status": "ok"}}) + "\n")
    r = records.read_rollouts(spark, str(tmp_path / "r.jsonl")).first()
    assert (r.task_id, r.sample_index, r.parsed.code) == ("a", 1, "c")


def test_phases(spark):
    kind = "array<struct<name:string,status:string,error:string,test_outcomes:array<struct<name:string,status:string,error:string>>>>"
    phases = [("syntax", "passed", None, []), ("public_tests", "failed", "boom", [("a", "passed", None), ("b", "failed", "boom")]), ("hidden_tests", "passed", None, [("c", "passed", None)])]
    row = spark.createDataFrame([(phases,)], f"p {kind}")
    got = row.select(execution.run_status(F.col("p")).alias("s"), execution.outcome_summary(F.col("p")).alias("o"), execution.first_error(F.col("p")[1]["test_outcomes"]).alias("e"), execution.observation(F.col("p")[1], "none", F.col("p")[1]["error"]).alias("w"), execution.observation(F.col("p")[0], "none").alias("ok"), F.size(execution.stopped_at_first(F.col("p"))).alias("n")).first()
    assert tuple(got) == ("failed", "public_tests 1/2; hidden_tests 1/1", "boom", "public_tests failed: boom", "syntax passed", 2)


def test_selection(spark):
    t = spark.createDataFrame([("b", "train", 0, ["x"]), ("a", "train", 1, []), ("c", "dev", 2, ["y"])], "task_id string, split string, ord int, hidden_tests array<string>")
    assert [r.task_id for r in selection.by_split(t, "train").orderBy("ord").collect()] == ["b", "a"]
    assert [r.task_id for r in selection.curriculum(t, "easy").collect()] == ["b", "c", "a"] and [r.task_id for r in selection.curriculum(t, "static", 2).collect()] == ["b", "a"]
    assert selection.get(t, "c").first().split == "dev"
    with pytest.raises(KeyError):
        selection.get(t, "d")
    with pytest.raises(ValueError):
        selection.by_split(t, "nope")
    doc = F.lit('{"a": {"b": 2}, "t": true, "s": "x", "l": [{"k": 1}, 2, "y"], "n": null}')
    assert one(spark, selection.optional_number(doc, "a.b")) == 2.0 and one(spark, selection.optional_number(doc, "t")) == 1.0 and one(spark, selection.optional_number(doc, "s")) is None
    assert [json.loads(x) for x in one(spark, selection.objects_at(doc, "l"))] == [{"k": 1}] and one(spark, selection.objects_at(doc, "a")) == []
    assert one(spark, selection.scalar_metadata(doc, "m_")) == {"m_t": "true", "m_s": "x"}


def test_rewards_of_the_response(spark):
    mask = arr(0, 1, 0, 1)
    none = F.lit(None).cast("array<double>")
    assert one(spark, sequences.response_positions(mask)) == [1, 3]
    assert one(spark, sequences.response_rewards(F.lit(2.0), none, mask)) == [0.0, 2.0]
    assert one(spark, sequences.response_rewards(F.lit(2.0), arr(1.0, 2.0, 3.0, 4.0), mask)) == [2.0, 4.0] and one(spark, sequences.response_rewards(F.lit(2.0), arr(5.0, 6.0), mask)) == [5.0, 6.0]


def test_edges_of_deviations(spark):
    rows = [("edge", r) for r in (0.04, 0.08)] + [("above", r) for r in (0.04, 0.081)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "task_id string, reward double").withColumn("passed", F.lit(True))
    got = {r.task_id: r.n for r in evaluate.standardized(df, 0.02).groupBy("task_id").agg(F.count_if(F.col("advantage") != 0).alias("n")).collect()}
    assert got == {"edge": 0, "above": 2, "one": 0}


def test_schemes_agree_as_columns_and_over_frames(spark):
    e = spark.createDataFrame([(("passed", True, 1.0, [("syntax", "passed", 0.1, 0, []), ("public_tests", "failed", 0.1, 2, [("a", "passed", None), ("b", "failed", None)])]),), (("timeout", False, None, None),), ((None, None, None, []),)], f"execution {rewards.EXECUTION}")
    made = rewards.scored(e, {"a": rewards.scorer(), "b": rewards.scorer("partial_credit", compile_bonus=0.1)})
    made = made.withColumn("c", rewards.correctness(F.col("execution"))).withColumn("d", rewards.Mode(compile_bonus=0.1)(F.col("execution")))
    assert all(r.a == r.c and r.b == r.d for r in made.collect()) and made.first().b.reward == pytest.approx(0.1 + 0.4 * 0.5 + 0.1)
