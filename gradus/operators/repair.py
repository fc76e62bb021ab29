"""Self-repair: traces of tasks whose code is run on public tests, revised, and submitted.

A runner is a plug-in: it adds the column execution to rows of task_id, code, public_tests and hidden_tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import text
from gradus.functions.code import extract_code, simple_repair
from gradus.operators import execution, rewards, rollouts, traces

Runner = Callable[[DataFrame], DataFrame]

STEP = "struct<kind:string,code:string,parsed_status:string,observation:string,ok:boolean>"


def _no_tests(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.slice(column, 1, 0))


def apart(df: DataFrame) -> DataFrame:
    """df behind a pass of Arrow batches. Rounds use what the last one made many times over; the optimizer would
    paste one into another until plans explode, and a runner's code would run for each use."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def _ran(df: DataFrame, runner: Runner, default: str) -> DataFrame:
    """df with execution, ok and observation of the public phase."""
    public = rewards.phase(F.col("execution"), "public_tests")
    error = execution.first_error(F.coalesce(public["test_outcomes"], F.array().cast("array<struct<name:string,status:string,error:string>>")))
    return apart(runner(df)).withColumn("ok", F.coalesce("execution.passed", F.lit(False))).withColumn("observation", execution.observation(public, default, error))


def run_public(tasks: DataFrame, runner: Runner) -> DataFrame:
    """Tasks with code, run on their public tests: execution, ok and observation."""
    hidden = dict(tasks.dtypes)["hidden_tests"]
    ran = _ran(_no_tests(tasks.withColumn("__hidden", F.col("hidden_tests")), "hidden_tests"), runner, "public tests were not run")
    return ran.withColumn("hidden_tests", F.col("__hidden").cast(hidden)).drop("__hidden")


def run_custom(tasks: DataFrame, tests: Column, runner: Runner) -> DataFrame:
    """Tasks with code, run on other tests in place of their own: execution, ok and observation."""
    ran = _ran(_no_tests(tasks.withColumn("__own", F.struct("public_tests", "hidden_tests")).withColumn("public_tests", tests), "hidden_tests"), runner, "custom tests were not run")
    return ran.withColumn("public_tests", F.col("__own.public_tests")).withColumn("hidden_tests", F.col("__own.hidden_tests")).drop("__own")


def submit(tasks: DataFrame, runner: Runner, scorer: Callable[[Column], Column] | None = None, include_hidden: bool = True) -> DataFrame:
    """Tasks with code, run on all tests: execution, ok, observation and reward (a struct, as of rewards.scored)."""
    ran = apart(runner(tasks if include_hidden else _no_tests(tasks, "hidden_tests"))).withColumn("ok", F.coalesce("execution.passed", F.lit(False)))
    said = F.when(F.col("ok"), "final submission passed").otherwise("final submission failed")
    return rewards.scored(ran, {"reward": scorer or rewards.scorer()}).withColumn("observation", said)


def _step(kind: str, ok: Column | None = None, status: Column | None = None, observation: Column | str = "") -> Column:
    said = F.lit(observation) if isinstance(observation, str) else observation
    return F.struct(F.lit(kind).alias("kind"), F.col("code"), (F.lit("") if status is None else status).alias("parsed_status"), said.alias("observation"), (F.lit(None).cast("boolean") if ok is None else ok).alias("ok")).cast(STEP)


def _told(steps: Column, when: Column, step: Column) -> Column:
    return F.when(when, F.concat(steps, F.array(step))).otherwise(steps)


def by_rule(df: DataFrame, turn: int) -> DataFrame:
    """Adds revised, the code that the tests suggest, and said, what the trace tells of it."""
    public = F.transform("public_tests", lambda t: t["code"])
    return df.withColumn("revised", simple_repair(F.coalesce("entry_point", F.lit("")), public, F.col("code"))).withColumn("said", F.lit("rule-based revision after public-test feedback"))


def by_model(generator: rollouts.Generator, template: str = "self_debug_revision_v1") -> Callable[[DataFrame, int], DataFrame]:
    """Revisions by a generator, from a prompt with code and observation; its sample index and what is added to its seed are the turn."""

    def revise(df: DataFrame, turn: int) -> DataFrame:
        public = F.transform("public_tests", lambda t: t["code"])
        rendered = text.revision_prompt(F.col("prompt"), F.col("starter_code"), F.col("entry_point"), public, F.col("code"), F.col("observation"), F.lit(turn), template)
        asked = df.withColumn("__kept", F.struct("sample_index", "seed", "rendered", "completion")).withColumn("rendered", rendered).withColumn("sample_index", F.lit(turn)).withColumn("seed", F.col("seed") + turn).drop("completion")
        made = generator(asked).withColumn("revised", extract_code("completion")["code"]).withColumn("said", F.lit("model revision after public-test feedback"))
        return made.withColumns({c: F.col(f"__kept.{c}") for c in ("sample_index", "seed", "rendered", "completion")}).drop("__kept")

    return revise


def unrevised(df: DataFrame, turn: int) -> DataFrame:
    return df.withColumn("revised", F.col("code")).withColumn("said", F.lit("no revision strategy enabled"))


def run(tasks: DataFrame, generator: rollouts.Generator, runner: Runner, samples: int = 1, seed: int = 20260601, most: int = 1, revise: Callable[[DataFrame, int], DataFrame] = by_rule, scorer: Callable[[Column], Column] | None = None, include_hidden: bool = True) -> DataFrame:
    """Traces: task_id, sample_index, prompt, raw_completion, initial_code, final_code, steps, execution, passed, reward.

    Public tests run up to most + 1 times; a trace that passes, or whose revision changes nothing, goes to its
    submission. The number of rounds is fixed, so the plan is; rows that are done stay as they are. Null tests
    count as none. A runner sees rows that are done as well, with code it has seen.
    """
    if samples < 1:
        raise ValueError("the number of samples must be positive")
    if most < 0:
        raise ValueError("the number of revisions can't be negative")
    public = F.transform("public_tests", lambda t: t["code"])
    now = tasks.withColumns({c: F.coalesce(c, F.array().cast(dict(tasks.dtypes)[c])) for c in ("public_tests", "hidden_tests")})
    now = rollouts.plan(now, samples, seed).withColumn("rendered", text.render_prompt(F.col("prompt"), F.col("starter_code"), F.col("entry_point"), public))
    now = generator(now).withColumn("parsed", extract_code("completion")).withColumn("code", F.col("parsed.code")).withColumn("initial_code", F.col("code"))
    now = now.withColumn("steps", F.array(_step("generation", status=F.col("parsed.status")))).withColumn("open", F.lit(True))
    now = apart(now)
    for turn in range(1, most + 2):
        now = run_public(now, runner)
        now = now.withColumn("steps", _told(F.col("steps"), F.col("open"), _step("run_public_tests", F.col("ok"), observation=F.col("observation")))).withColumn("open", F.col("open") & ~F.col("ok")).drop("execution", "ok")
        if turn <= most:
            now = revise(now, turn).withColumn("changed", F.col("open") & (F.col("revised") != F.col("code"))).withColumn("code", F.when(F.col("open"), F.col("revised")).otherwise(F.col("code")))
            status = extract_code("code")["status"]
            now = now.withColumn("steps", _told(F.col("steps"), F.col("open"), _step("revision", status=status, observation=F.col("said")))).withColumn("open", F.col("changed")).drop("revised", "said", "changed")
        now = apart(now.drop("observation"))
    done = submit(now, runner, scorer, include_hidden)
    steps = F.concat("steps", F.array(_step("submit_final", F.col("ok"), observation=F.col("observation"))))
    return done.select("task_id", "sample_index", F.col("rendered").alias("prompt"), F.col("completion").alias("raw_completion"), "initial_code", F.col("code").alias("final_code"), steps.alias("steps"), "execution", F.col("ok").alias("passed"), "reward")


def as_rollouts(made: DataFrame, discount: float = 1.0, mode: str = "positive_only", step_penalty: float = 0.0) -> DataFrame:
    """A rollout for each trace of run: its last code, the reward after discounts, and counts of its steps."""
    if not 0 < discount <= 1:
        raise ValueError("the discount must be above 0 and at most 1")
    if step_penalty < 0:
        raise ValueError("the penalty of a step can't be negative")
    steps = F.col("steps")
    revisions = traces.count_kind(steps, "revision")
    shaped = rewards.revision_discount(F.coalesce("reward.reward", F.lit(0.0)), revisions, discount, mode, step_penalty)
    return made.select(
        "task_id", "sample_index", "prompt", F.col("final_code").alias("raw_completion"), extract_code("final_code").alias("parsed"), "execution", "passed", shaped.alias("shaped"), shaped["reward"].alias("reward"), revisions.alias("revision_count"),
        F.size(F.filter(steps, lambda s: s["ok"].isNotNull())).alias("tool_call_count"), F.coalesce(traces.last_step(steps, "run_public_tests")["ok"], F.lit(False)).alias("public_test_passed"), F.get(steps, F.lit(0))["parsed_status"].alias("initial_parse_status"),
    )
