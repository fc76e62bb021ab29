"""Repair traces, smoke runs, manifests, settings, reports of comparisons, and sources by layout."""

import hashlib
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from gradus.operators import contamination, paired, repair, rewards, rollouts, sequences, smoke
from gradus.plans import manifest, reports, settings
from gradus.sources import records

TASK = "task_id string, prompt string, starter_code string, entry_point string, public_tests array<struct<name:string,code:string>>, hidden_tests array<struct<name:string,code:string>>"


def tasks(spark):
    rows = [("good", "add", "", "f", [("p", "assert f(1) == 2")], [("h", "assert f(5) == 6")]), ("fix", "add", "", "f", [("p", "assert f(1) == 4")], []), ("bad", "add", "", "f", [("p", "f of 1")], None)]
    return spark.createDataFrame(rows, TASK)


def runner(df):
    """Code passes if it adds what the first test asks for; no hidden tests: one phase."""
    ok = F.when(F.size("public_tests") == 0, F.lit(True)).otherwise((F.contains("code", F.lit("x + 1")) & (F.get("public_tests", F.lit(0))["code"] == "assert f(1) == 2")) | (F.contains("code", F.lit("x + 3")) & (F.get("public_tests", F.lit(0))["code"] == "assert f(1) == 4")))
    status = F.when(ok, "passed").otherwise("failed")
    phase = lambda name, n: F.struct(F.lit(name).alias("name"), status.alias("status"), F.lit(0.1).alias("duration_seconds"), n.alias("tests_run"), F.array(F.struct(F.lit("t").alias("name"), status.alias("status"), F.when(~ok, "boom").alias("error"))).alias("test_outcomes"))
    phases = F.concat(F.array(phase("public_tests", F.size("public_tests"))), F.when(F.size("hidden_tests") > 0, F.array(phase("hidden_tests", F.size("hidden_tests")))).otherwise(F.array(phase("hidden_tests", F.lit(0))).cast("array<struct<name:string,status:string,duration_seconds:double,tests_run:int,test_outcomes:array<struct<name:string,status:string,error:string>>>>")))
    return df.withColumn("execution", F.struct(status.alias("status"), ok.alias("passed"), F.lit(0.2).alias("duration_seconds"), phases.alias("phases")).cast(rewards.EXECUTION))


def test_repair_traces(spark):
    static = rollouts.make_generator("static", "```python\ndef f(x):\n    return x + 1\n```")
    got = {r.task_id: r for r in repair.run(tasks(spark), static, runner, most=2).collect()}
    kinds = {n: [s.kind for s in r.steps] for n, r in got.items()}
    assert kinds["good"] == ["generation", "run_public_tests", "submit_final"] and got["good"].passed
    assert kinds["fix"] == ["generation", "run_public_tests", "revision", "run_public_tests", "submit_final"] and got["fix"].passed and "x + 3" in got["fix"].final_code
    assert kinds["bad"] == ["generation", "run_public_tests", "revision", "submit_final"] and not got["bad"].passed
    assert [s.observation for s in got["fix"].steps] == ["", "public_tests failed: boom", "rule-based revision after public-test feedback", "public_tests passed", "final submission passed"]
    made = {r.task_id: r for r in repair.as_rollouts(repair.run(tasks(spark), static, runner, most=1), 0.5, step_penalty=0.1).collect()}
    assert made["fix"].revision_count == 1 and made["fix"].tool_call_count == 3 and made["fix"].public_test_passed
    assert made["fix"].reward == pytest.approx(made["fix"].shaped.undiscounted * 0.5 - 0.1) and made["good"].initial_parse_status == "ok"
    none = {r.task_id: r for r in repair.run(tasks(spark), static, runner, most=3, revise=repair.unrevised).collect()}
    assert [s.kind for s in none["fix"].steps].count("revision") == 1 and not none["fix"].passed
    model = {r.task_id: r for r in repair.run(tasks(spark), static, runner, samples=2, revise=repair.by_model(static)).where("sample_index = 1").collect()}
    assert model["bad"].steps[2].observation == "model revision after public-test feedback" and model["bad"].raw_completion.startswith("```")
    assert repair.run(tasks(spark).limit(0), static, runner).count() == 0
    with pytest.raises(ValueError):
        repair.run(tasks(spark), static, runner, samples=0)


def test_tools(spark):
    df = tasks(spark).withColumn("code", F.lit("def f(x): return x + 1")).where("task_id <> 'bad'")
    got = {r.task_id: r for r in repair.run_public(df, runner).collect()}
    assert got["good"].ok and got["good"].observation == "public_tests passed" and len(got["good"].hidden_tests) == 1 and got["fix"].observation == "public_tests failed: boom"
    other = F.array(F.struct(F.lit("c").alias("name"), F.lit("assert f(1) == 2").alias("code")))
    assert {r.ok for r in repair.run_custom(df, other, runner).collect()} == {True}
    final = {r.task_id: r for r in repair.submit(df, runner).collect()}
    assert final["good"].observation == "final submission passed" and final["good"].reward.reward > final["fix"].reward.reward


def test_smoke_runs(spark):
    mock = rollouts.make_generator("mock")
    told, last = smoke.group_relative(tasks(spark).where("task_id <> 'bad'"), mock, runner, steps=3, group=2, stop_below=1.1)
    assert len(told) == 1 and told[0]["stopped_early"] and told[0]["rollouts"] == 4 and last.count() == 4
    told, _ = smoke.group_relative(tasks(spark), mock, runner, steps=2, group=2)
    assert [t["step"] for t in told] == [1, 2] and not any(t["stopped_early"] for t in told)
    told, last = smoke.with_critic(tasks(spark), mock, runner, steps=2, samples=2)
    assert len(told) == 2 and told[0]["rollouts"] == 6 and 0 <= told[0]["pass_rate"] <= 1


def test_settings():
    assert settings.algorithm({"online": {"algorithm": "PPO_online"}}) == "ppo" and settings.algorithm({}, "grpo_smoke") == "grpo"
    with pytest.raises(ValueError):
        settings.algorithm({"algorithm": "dpo"})
    got = settings.online({"algorithm": "ppo", "generation": {"max_new_tokens": "64", "group_size": 8}, "loss": {"gamma": 0.9, "max_log_ratio": 5}, "training": {"clip_epsilon": 0.1, "max_log_ratio": 3, "loss": {"value_clip_epsilon": None}}, "agent": {"use_rule_based_repair": "off"}, "evaluation": {"ks": "1, 5"}})
    assert got["rollout"]["max_response_tokens"] == 64 and got["rollout"]["samples_per_task"] == 8 and got["self_debug"]["revision_strategy"] == "none"
    assert got["loss"]["gamma"] == 0.9 and got["loss"]["clip_epsilon"] == 0.1 and got["loss"]["value_clip_epsilon"] is None and got["loss"]["max_log_ratio"] == 5.0
    assert got["evaluation"]["ks"] == (1, 5) and got["sync_old_value_before_cycle"] and "min_reward_std" not in got["batch"]
    plain = settings.online({"evaluation": {"enabled": "no"}})
    assert plain["evaluation"] is None and plain["batch"]["min_reward_std"] == 1e-8 and "gamma" not in plain["loss"]


def test_manifest(tmp_path):
    for name, text in {"README.md": "r", ".gitignore": "g", "src/p/__init__.py": "x = 1", "plan.md": "no", "src/p/__pycache__/a.py": "no", "configs/x/a.json": json.dumps({"model": {"name": "m", "use_lora": True, "value_model": {"name": "v"}}, "generation": {"tokenizer": "t"}}), "configs/x/b.json": "{", "outputs/checkpoints/1/checkpoint_manifest.json": json.dumps({"artifacts": [{"path": "w", "sha256": "s", "bytes": 3}, {"path": "x"}, 4]})}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = manifest.build(str(tmp_path), "p", at="now")
    assert [a["path"] for a in got["artifacts"]] == [".gitignore", "README.md", "configs/x/a.json", "configs/x/b.json", "src/p/__init__.py"]
    assert got["artifacts"][1]["sha256"] == hashlib.sha256(b"r").hexdigest() and got["artifact_count"] == 5
    assert [(m["role"], m["name"]) for m in got["model_references"]] == [("policy", "m"), ("value_model", "v"), ("generation", "t")]
    assert got["checkpoint_artifacts"] == [{"source_path": "outputs/checkpoints/1/checkpoint_manifest.json", "kind": "artifact", "path": "w", "bytes": 3, "sha256": "s"}]
    manifest.write_json(got, str(tmp_path / "o/m.json"))
    manifest.write_markdown(got, str(tmp_path / "o/m.md"))
    manifest.archive(got, str(tmp_path), str(tmp_path / "o/m.tar.gz"))
    assert reports.read(str(tmp_path / "o/m.json"))["generated_at_utc"] == "now" and "`README.md` (1 bytes" in (tmp_path / "o/m.md").read_text()
    with tarfile.open(tmp_path / "o/m.tar.gz") as t:
        assert len(t.getnames()) == 6 and json.load(t.extractfile("reproducibility/manifest.json")) == got
    (tmp_path / "o/l.json").write_text("[1]")
    with pytest.raises(ValueError, match="no object"):
        reports.read(str(tmp_path / "o/l.json"))
    with pytest.raises(ValueError, match="no JSON"):
        reports.read(str(tmp_path / "configs/x/b.json"))
    assert records.read_object(str(tmp_path / "none")) == {} and records.read_object(str(tmp_path / "o/l.json")) == {}


def test_comparison_of_files(spark, tmp_path):
    for name, ok in (("a", ("x",)), ("b", ("x", "y"))):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"task_id": t, "sample_index": 0, "prompt": "", "raw_completion": "", "parsed": {"code": "", "status": "ok"}, "execution": {"passed": t in ok}, "reward": {"reward": float(t in ok)}}) + "\n" for t in "xyz"))
    made = paired.compare_files(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
    assert [[r.task_id for r in f.collect()] for f in paired.changed(made["outcomes"])] == [["y"], []]
    page = reports.comparisons({"a to b": made})
    assert "<td>y</td>" in page and "<td>z</td>" not in page and "33.33" in page
    assert reports.bars([("<a>", -1.0), ("b", 2.0)]).count("<rect") == 2 and "&lt;a&gt;" in reports.bars([("<a>", 1.0)])
    both = records.read_labelled(spark, [f"l={tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl"], 2)
    assert sorted((r.label, r.task_id) for r in both.collect()) == [("b", "x"), ("b", "y"), ("l", "x"), ("l", "y")]
    with pytest.raises(ValueError, match="repeats"):
        records.read_labelled(spark, [f"l={tmp_path}/a.jsonl"] * 2)
    with pytest.raises(ValueError, match="empty label"):
        records.labelled_path(" =x")


def test_reports_of_runs_and_traces(spark):
    df = spark.createDataFrame([(1, "b|c", 0.5), (0, "a", 0.25)], "ord int, slug string, mean_reward double")
    table = reports.runs(df, df.where("ord = 1")).splitlines()
    assert table[2] == "|  | a | 0.2500 |" and table[3] == "| yes | b\\|c | 0.5000 |"
    static = rollouts.make_generator("static", "```python\ndef f(x):\n    return x + 1\n```")
    made = repair.run(tasks(spark), static, runner)
    text = reports.trace(made, "good")
    assert text.startswith("# Agent Trace\n\n- Task: good\n- Final passed: True\n- Revisions: 0\n- Tool calls: 2\n") and "### 3. submit_final" in text
    assert "- Task: bad" in reports.trace(made, "none such")
    with pytest.raises(ValueError):
        reports.trace(made.limit(0))


def test_sources_by_layout(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"task_id": "7", "text": "do", "test_list": ["assert g(1) == 2", "assert g(2) == 3"]}))
    (tmp_path / "s.json").write_text(json.dumps({"7": {"hidden_tests": ["assert g(9)"]}}))
    m = records.read_source(spark, str(tmp_path / "m.jsonl"), "mbpp", split="dev" if "dev" in records.SPLITS else None, source="mine", sidecar=str(tmp_path / "s.json")).first()
    assert m.task_id == "mine/7" and [t.code for t in m.hidden_tests] == ["assert g(9)"]
    (tmp_path / "t.jsonl").write_text(json.dumps({"task_id": "a/1", "source": "a", "prompt": "p", "split": "train"}))
    assert records.read_source(spark, str(tmp_path / "t.jsonl"), split="stress").first().split == "stress"
    for wrong in ({"layout": "xml"}, {"split": "nope"}):
        with pytest.raises(ValueError, match="unknown"):
            records.read_source(spark, "x", **wrong)


def test_sequences_of_texts_and_estimates(spark):
    row = spark.range(1).select(sequences.encoded(F.lit(" a b  c "), 2, "left").alias("l"), sequences.encoded(F.lit("a"), 2).alias("r"), sequences.encoded(F.lit("a b")).alias("n"), sequences.encoded(F.lit("b c")).alias("w")).first()
    assert row.l.token_ids == row.w.token_ids and row.l.truncated and row.l.truncation_side == "left" and not row.r.truncated and row.n.truncation_side is None
    s = spark.createDataFrame([("a", 0), ("a", 1)], "task_id string, sample_index int")
    e = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 1.5), ("b", 0, 9.0)], "task_id string, sample_index int, value double")
    assert sorted(r.value for r in sequences.with_estimates(s, e).collect()) == [0.5, 1.5]
    with pytest.raises(Exception, match="no value estimate for a:1"):
        sequences.with_estimates(s, e.where("sample_index = 0")).collect()
    assert sequences.first_batches(sequences.microbatches(s, 1, ("task_id", "sample_index")), 1).count() == 1
    r = spark.createDataFrame([("b", "p q r", "x", ("c d", "ok", "whole"), '{"k": 1, "l": [2]}')], "backend string, prompt string, raw_completion string, parsed struct<code:string,status:string,parser:string>, metadata string")
    got = r.select(rollouts.sample_metadata(r, most_prompt=2).alias("m")).first().m
    assert got == {"backend": "b", "parse_status": "ok", "parser": "whole", "response_source": "parsed_code", "prompt_tokens": "2", "response_tokens": "2", "prompt_truncated": "true", "response_truncated": "false", "rollout_k": "1"}


@pytest.mark.parametrize("most", [0, 1000])
def test_containment_by_keys(spark, most):
    items = ["one two three four five", "six seven", "", None, "One two, three four six"]
    docs = ["x ONE two three four five y", "six; seven", "sixseven", "one two three four", None, "one two three four six seven eight", "onesix seven eight"]
    d, i = spark.createDataFrame(list(enumerate(docs)), "id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(tuple(r) for r in contamination.contained(d, i, most).collect()) == [(0, 0), (1, 1), (5, 1), (5, 4)]


def test_bootstrap_in_chunks(spark, monkeypatch):
    rows = spark.range(25).select(F.col("id").cast("string").alias("task_id"), (F.col("id") % 3 == 0).alias("base_passed"), (F.col("id") % 2 == 0).alias("candidate_passed"))
    want = paired.bootstrap(rows, 50).first()
    monkeypatch.setattr(paired, "_CHUNK", 7)
    assert paired.bootstrap(rows, 50).first() == want
