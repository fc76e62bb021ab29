import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gradus.operators import rollouts
from gradus.plans import build, catalogue, reports


def test_generation_and_batches(spark):
    tasks = catalogue.inline_tasks(spark)
    got = rollouts.generate(tasks, rollouts.make_generator("mock"), samples=4, seed=7)
    rows = got.collect()
    assert len(rows) == 20 and all(r.parsed.status == "ok" for r in rows)
    for r in rows:
        bucket = int(hashlib.sha256(f"{r.task_id}:{r.sample_index}:7".encode()).hexdigest()[:8], 16) % 3
        assert ("return None" in r.raw_completion) == (bucket == 0)
    assert "assert f(9) == 10" not in next(r.prompt for r in rows if r.task_id == "near")
    scored = got.withColumn("reward", F.when(F.col("sample_index") == 0, "bad").otherwise(F.col("sample_index").cast("string")))
    samples, skipped = rollouts.training_batch(scored, most_response=3)
    assert samples.count() == 15 and {r.skip_reason for r in skipped.collect()} == {"invalid_reward"}
    assert all(r.response_tokens <= 3 and len(r.input_ids) == len(r.masks.response_mask) for r in samples.collect())
    empty = rollouts.generate(tasks, rollouts.make_generator("static", ""), 1).withColumn("reward", F.lit("1"))
    assert {r.skip_reason for r in rollouts.training_batch(empty)[1].collect()} == {"parse_status_empty"}
    with pytest.raises(ValueError):
        rollouts.make_generator("none such")


def test_self_debug(spark):
    df = spark.createDataFrame([("f", ["assert f(2) == 5"], "def f(x):\n    return x\n"), ("g", ["assert g() == 4"], "def g():\n    return 4\n")], "entry_point string, tests array<string>, code string")
    check = lambda d: d.withColumn("public_passed", F.contains("code", F.lit("x + 3")) | (F.col("entry_point") == "g"))
    got = {r.entry_point: r for r in rollouts.self_debug(df, check).collect()}
    assert got["f"].revisions == 1 and got["f"].public_passed and got["g"].revisions == 0


def test_build_and_reports(spark, tmp_path):
    tasks = catalogue.inline_tasks(spark).withColumn("source", F.lit("s"))
    with pytest.raises(build.ContaminatedError) as e:
        build.build([tasks], threshold=0.8)
    assert e.value.findings == {"leaks": 2, "overlap": 2}
    clean = build.build([tasks.where("task_id = 'near'"), tasks.where("task_id = 'far'")], hold_out=True)
    assert clean["manifest"]["passed"] and clean["manifest"]["split_counts"] == {"stress": 1, "test_public": 1}
    with pytest.raises(ValueError, match="repeat"):
        build.build([tasks, tasks])
    small = spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "name string, x double")
    for suffix in ("md", "json", "html"):
        reports.write(str(tmp_path / f"r.{suffix}"), "T", {"one": small}, {"c": [0.1, 0.4]})
    assert json.loads((tmp_path / "r.json").read_text())["one"][0]["x"] == 0.5
    assert "a\\|b | 0.5000" in (tmp_path / "r.md").read_text() and "<svg" in (tmp_path / "r.html").read_text()
