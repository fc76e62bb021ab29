"""Known values of single operators."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gradus.functions import code, stats, text
from gradus.operators import contamination, curves, evaluate, paired, rewards, sequences, splits
from gradus.sources import records
from gradus.streaming import curve as stream


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(columns) == 1 else tuple(r)


def close(a, b):
    return a == pytest.approx(b, abs=1e-9)


def test_pass_at_k(spark):
    for n, c, k, want in ((10, 0, 1, 0), (10, 10, 1, 1), (10, 1, 1, 0.1), (10, 1, 5, 0.5), (0, 0, 1, 0), (1, 0, 5, 1.0), (3, 1, 2, 2 / 3)):
        assert close(one(spark, stats.pass_at_k(F.lit(n), F.lit(c), k)), want)


def test_summaries(spark):
    rows = [("a", i, True, 1.0) for i in range(2)] + [("b", i, False, 0.0) for i in range(2)] + [("c", 0, True, 1.0), ("c", 1, False, None)]
    df = spark.createDataFrame(rows, "task_id string, sample_index int, passed boolean, reward double")
    r = evaluate.overall(df, (1,)).first()
    assert r.tasks == 3 and close(r.pass_rate, 0.5) and close(r.informative, 1 / 3) and close(r.pass_at_1, 0.5)
    assert evaluate.overall(df.limit(0), (1,)).first().pass_rate == 0
    assert evaluate.cap_samples(df, 1).count() == 3


def test_advantages(spark):
    df = spark.createDataFrame([("a", 0, 1.0, True), ("a", 1, 3.0, False), ("b", 0, 5.0, True)], "task_id string, sample_index int, reward double, passed boolean")
    got = {(r.task_id, r.sample_index): r.advantage for r in evaluate.standardized(df, 1e-8).collect()}
    assert got == {("a", 0): -1.0, ("a", 1): 1.0, ("b", 0): 0.0}


def test_paired(spark):
    def system(flags):
        return spark.createDataFrame([(t, 0, bool(f), float(f)) for t, f in zip("abcd", flags, strict=True)], "task_id string, sample_index int, passed boolean, reward double")

    m = paired.mcnemar(paired.outcomes(system([1, 1, 0, 0]), system([1, 0, 1, 0]))).first()
    assert (m.both, m.base_only, m.candidate_only, m.neither, m.discordant, m.p_value) == (1, 1, 1, 1, 2, 1.0)
    got = paired.compare(system([1, 0, 0, 0]), system([1, 1, 1, 0]))
    e, p = got["effects"].first(), got["permutation"].first()
    assert close(e.delta_points, 50) and close(e.relative_lift, 2) and close(e.error_reduction, 2 / 3) and p.is_exact and close(p.p_value, 0.5)
    b = got["bootstrap"].first()
    assert 0 <= b.low <= b.mean <= b.high <= 1
    with pytest.raises(ValueError):
        paired.compare(system([1, 0, 0, 0]), system([1, 0, 0, 0]).where("false"))


def test_text(spark):
    assert one(spark, text.normalize_prose(F.lit("Write   add-one(x)!"))) == "write add one x"
    assert one(spark, text.normalize_code(F.lit(" [[1],\u2003[2]]\x1f;\n"))) == "[[1], [2]] ;"
    assert one(spark, F.size(text.tokens(F.lit("")))) == 0
    assert one(spark, text.repeated_line_fraction(F.lit("a\n a \n\nb"))) == pytest.approx(1 / 3)
    assert one(spark, text.is_degenerate(F.lit("x\nx\nx\ny"))) and not one(spark, text.is_degenerate(F.lit("a b")))
    assert one(spark, text.short_number(F.lit(0.05))) == "0.05" and one(spark, text.short_number(F.lit(1.0))) == "1"
    assert one(spark, text.scoped_id(F.lit("s"), F.lit("1"))) == "s/1" and one(spark, text.scoped_id(F.lit("s"), F.lit("x/1"))) == "x/1"
    assert one(spark, text.entry_point(F.array(F.lit("print(1)"), F.lit("assert foo(1) == 2")))) == "foo"
    assert one(spark, text.escape_html(F.lit("<a b='c'>&\""))) == "&lt;a b=&#x27;c&#x27;&gt;&amp;&quot;"
    assert one(spark, F.size(text.fenced_blocks(F.lit("```py\na\n```\n```js\nb\n```")))) == 1
    assert one(spark, text.after_preamble(F.lit("well, def f(): pass"))) == "def f(): pass"
    assert one(spark, text.last_line(F.lit("a\n b \n"))) == " b" and one(spark, text.last_line(F.lit(""))) == ""


def test_losses(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    import math

    lo = lambda r, a: sequences.policy_loss(arr(math.log(r)), arr(0.0), arr(float(a)))["policy_loss"]
    assert close(one(spark, lo(2, 1)), -1.2) and close(one(spark, lo(0.5, -1)), 0.8)
    kl = sequences.policy_loss(arr(0.0), arr(0.0), arr(0.0), arr(-1.0), kl_beta=0.5)["kl_loss"]
    assert close(one(spark, kl), 0.5 * (math.exp(-1) + 1 - 1))
    adv = sequences.advantages(sequences.sparse_rewards(F.lit(1.0), F.lit(2)), arr(0.2, 0.1), 1.0, 1.0)
    assert one(spark, adv) == pytest.approx([0.8, 0.9])
    assert one(spark, sequences.mask_mean(arr(1.0, 5.0), F.array(F.lit(0), F.lit(0)))) == 0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, sequences.mask_sum(arr(1.0), F.array(F.lit(0), F.lit(1))))
    assert one(spark, sequences.truncate(arr(1, 2, 3), 2, "left")) == [2, 3] and one(spark, sequences.truncate(arr(1, 2, 3), 0, "left")) == []


def run_of(public="passed", hidden="passed", n_public=1, ok=None):
    o = lambda s: {"name": "t", "status": s, "error": None}
    phases = [{"name": n, "status": "passed", "duration_seconds": 0.1, "tests_run": 0, "test_outcomes": []} for n in ("syntax", "import")]
    phases.append({"name": "public_tests", "status": public, "duration_seconds": 0.1, "tests_run": n_public, "test_outcomes": [o(public)] * n_public})
    phases.append({"name": "hidden_tests", "status": hidden, "duration_seconds": 0.1, "tests_run": 0 if hidden == "skipped" else 1, "test_outcomes": [o(hidden)]})
    status = public if public != "passed" else hidden
    return {"status": status, "passed": status == "passed", "duration_seconds": 1.0, "phases": phases}


def test_rewards(spark):
    df = spark.createDataFrame([(run_of(),), (run_of("failed", "skipped"),), (run_of("passed", "failed"),), (run_of("timeout", "skipped"),), (run_of("passed", "passed", 0),)], f"e {rewards.EXECUTION}")
    e = F.col("e")
    got = [tuple(r) for r in df.select(rewards.correctness(e)["reward"], rewards.Mode("fractional_pass_rate")(e)["reward"], rewards.Mode("binary_all_tests_pass")(e)["reward"], rewards.Mode()(e)["reward"]).collect()]
    want = [(1, 1, 1, 1), (0.4, 0, 0, 0.2), (0.5 / 0.9, 0.5, 0, 0.6), (-0.1, -0.5, -0.5, -0.3), (1, 1, 1, 0.6)]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)
    with pytest.raises(ValueError):
        rewards.Mode("no such")
    assert one(spark, rewards.fold_status(F.array(F.lit("passed"), F.lit("timeout"), F.lit("failed")))) == "timeout"


def test_splits(spark):
    assert splits.quotas(12, {"train": 0.67, "dev": 0.17, "test_public": 0.16}) == {"train": 8, "dev": 2, "test_public": 1, "test_private": 1}
    t = spark.range(10).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"))
    a = {r.task_id: r.split for r in splits.assign(t, {"train": 0.6, "dev": 0.2, "test_public": 0.2}).collect()}
    assert sorted(a.values()) == ["dev"] * 2 + ["test_public"] * 2 + ["train"] * 6
    assert a == {r.task_id: r.split for r in splits.assign(t.repartition(7), {"train": 0.6, "dev": 0.2, "test_public": 0.2}).collect()}
    with pytest.raises(ValueError):
        splits.require_unique(t.union(t))


def test_near_overlap_loses_no_pair(spark):
    import random

    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(3, 9))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(base)), "id long, text string")
    got = {(r.id_a, r.id_b): r.score for r in contamination.near_overlap(df, df, 0.6).collect()}
    want = {(i, j): s for i, a in enumerate(base) for j, b in enumerate(base) if a != b and (s := SequenceMatcher(None, a, b).ratio()) >= 0.6}
    assert got == want


def test_near_copies_of_items_among_documents_are_found(spark, tmp_path):
    import random

    from gradus.plans import catalogue

    rng = random.Random(2)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [some(rng.randint(5, 60)) for _ in range(12)]
    docs = [some(rng.randint(1, 120)) for _ in range(30)]
    for t in items:
        for cut in (1, 2, 4):
            words = t.split()
            for _ in range(len(words) // (3 * cut)):
                words[rng.randrange(len(words))] = some(1)
            docs.append(" ".join(words))
    spark.createDataFrame([*enumerate([*docs, items[0], "", None])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate([*items, "", None])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.id_a, r.id_b): r.score for r in catalogue.contamination_near(spark, str(tmp_path)).collect()}
    want = {(i, j): s for i, a in enumerate(docs) for j, b in enumerate(items) if a != b and (s := SequenceMatcher(None, a, b).ratio()) >= 0.6}
    assert got == want and len(got) >= 10


def test_code():
    assert code.extract_one("x\n```python\ndef f(): pass\n```")[:3] == ("def f(): pass\n", "ok", "fenced:python:1")
    assert code.extract_one("")[1] == "empty" and code.extract_one("def f(:")[1] == "syntax_error"
    good = code.hacking_one("def fizz(n):\n    if n % 3 == 0:\n        return 'Fizz'\n    return str(n)\n", "fizz", ["assert fizz(3) == 'Fizz'"])
    assert not good["flagged"] and good["echoes_expected_values"]
    assert code.hacking_one("def f(x):\n    return 7\n", "f", ["assert f(3) == 7"])["hardcoded_visible_answers"]
    assert code.hacking_one("def f():\n    return 7\n", "f", None)["flagged"] is False
    rules = [f["rule"] for f in code.scan_one("import os\nfrom subprocess import run\neval('1')\nx.__class__\nsetattr(x, '__dict__', 1)\nraise SystemExit()")]
    assert rules == ["blocked_import", "blocked_import", "blocked_call", "blocked_attribute", "blocked_reflection", "blocked_raise", "blocked_call"]
    assert code.scan_one("import math\nprint(getattr(1, 'real'))") == []
    assert code.repair_one("f", ["assert f(2) == 5"], "") == "def f(x):\n    return x + 3\n"


def test_files(spark, tmp_path):
    task = {"task_id": "a/1", "source": "a", "prompt": "p", "split": "train", "hidden_tests": [{"code": "assert f(1)"}], "metadata": {"k": "v"}}
    (tmp_path / "t.jsonl").write_text(json.dumps(task) + "\n\n" + json.dumps(task | {"task_id": "a/2"}) + "\n")
    t = records.read_tasks(spark, str(tmp_path / "t.jsonl")).orderBy("ord").collect()
    assert [r.task_id for r in t] == ["a/1", "a/2"] and t[0].resource_limits.timeout_seconds == 2.0 and t[0].hidden_tests[0].visibility == "hidden"
    (tmp_path / "e.json").write_text(json.dumps({"items": [task]}))
    assert records.read_tasks(spark, str(tmp_path / "e.json")).count() == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps(task | {"split": "nope"}))
    with pytest.raises(Exception, match="unknown split"):
        records.read_tasks(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "m.jsonl").write_text(json.dumps({"task_id": "7", "text": "do", "test_list": ["assert g(1) == 2", "assert g(2) == 3"], "challenge_test_list": ["assert g(3) == 4"]}))
    m = records.read_mbpp(spark, str(tmp_path / "m.jsonl")).first()
    assert (m.task_id, m.entry_point, len(m.public_tests), len(m.hidden_tests)) == ("mbpp/7", "g", 1, 2)
    (tmp_path / "h.jsonl").write_text(json.dumps({"task_id": "H/0", "prompt": "def h():", "entry_point": "h", "test": "def check(candidate):\n    assert candidate() == 1\n"}))
    h = records.read_humaneval(spark, str(tmp_path / "h.jsonl")).first()
    assert h.hidden_tests[0].code.endswith("\n\ncheck(h)") and h.split == "test_public"
    (tmp_path / "side.json").write_text(json.dumps({"1": {"hidden_tests": ["assert f(9)"]}}))
    s = records.apply_sidecar(records.read_mbpp(spark, str(tmp_path / "m.jsonl")).withColumn("task_id", F.lit("a/1")), records.read_sidecar(spark, str(tmp_path / "side.json"))).first()
    assert s.public_tests == [] and s.hidden_tests[0].code == "assert f(9)"
    records.write_jsonl(spark.createDataFrame([(1, "b"), (0, "a")], "ord int, x string"), str(tmp_path / "out"))
    (tmp_path / "art").mkdir()
    (tmp_path / "art/a.txt").write_text("x")
    (tmp_path / "art/b.bin").write_text("y")
    assert [r.path for r in records.artifacts(spark, str(tmp_path / "art"), ("*",), ("*.bin",)).collect()] == ["a.txt"]
    assert records.parse_yaml("a: 1\nb:\n  - x\n  - c: 2\n    d: [1, two]\ne:\n  f: 'g # h' # note\n") == {"a": 1, "b": ["x", {"c": 2, "d": [1, "two"]}], "e": {"f": "g # h"}}
    with pytest.raises(ValueError):
        records.parse_yaml("a:\n   b: 1")


def test_curve_batch_and_stream(spark, tmp_path):
    for c in (1, 2):
        d = tmp_path / f"run/cycle_000{c}"
        d.mkdir(parents=True)
        (d / "rollouts.jsonl").write_text("".join(json.dumps({"task_id": "t", "sample_index": i, "passed": i < c, "reward": i / 2}) + "\n" for i in range(2)))
        (d / "metrics.jsonl").write_text(json.dumps({"optimizer_step": True, "loss": 0.5 * c}) + "\n")
    r = records.read_cycles(spark, str(tmp_path / "run"), "rollouts.jsonl", stream.ROLLOUT)
    m = records.read_cycles(spark, str(tmp_path / "run"), "metrics.jsonl", "optimizer_step boolean, loss double")
    want = {(x.cycle, x.rollouts, x.pass_rate, x.mean_reward, x.loss, x.optimizer_steps) for x in curves.points(r, m).collect()}
    assert want == {(1, 2, 0.5, 0.25, 0.5, 1), (2, 2, 1.0, 0.25, 1.0, 1)}
    got = []
    q = stream.replay(stream.curve(stream.rollout_stream(spark, str(tmp_path / "run"))), lambda f, _: got.extend(f.collect()), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert {(x.cycle, x.rollouts, x.pass_rate) for x in got} == {(1, 2, 0.5), (2, 2, 1.0)}
