"""Production of rollouts, and their way into training batches.

Generators and runners are plug-ins: a generator is a function of columns, or of batches of rows;
running generated code is never done by default and is left to what is passed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import text
from gradus.functions.code import extract_code, simple_repair
from gradus.operators import evaluate, selection, sequences

Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class Generator(Protocol):
    """Adds the column completion to a plan of requests."""

    backend: str
    model: str

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def plan(tasks: DataFrame, samples: int, seed: int) -> DataFrame:
    """A request for each task and sample, with the seed of the run; rows are made without a shuffle."""
    return tasks.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("seed", F.lit(seed))


def stable_bucket(task_id: Column, sample_index: Column, seed: Column, n: int = 3) -> Column:
    h = F.sha2(F.concat_ws(":", task_id.cast("string"), sample_index.cast("string"), seed.cast("string")).cast("binary"), 256)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n).cast("int")


class Mock:
    """Deterministic completions: one in three returns nothing, the others add one."""

    backend, model = "mock", "mock-deterministic-v1"

    def __call__(self, requests: DataFrame) -> DataFrame:
        name = F.coalesce("entry_point", F.lit("solution"))
        bucket = stable_bucket(F.col("task_id"), F.col("sample_index"), F.col("seed"))
        body = F.when(bucket == 0, F.concat(F.lit("def "), name, F.lit("(*args, **kwargs):\n    return None\n"))).otherwise(F.concat(F.lit("def "), name, F.lit("(x):\n    return x + 1\n")))
        return requests.withColumn("completion", F.concat(F.lit("```python\n"), body, F.lit("```")))


class Static:
    backend, model = "static", "static-v1"

    def __init__(self, completion: str):
        self.completion = completion

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("completion", F.lit(self.completion))


class Batched:
    """Any function of batches that adds the column completion, such as a model held by the worker."""

    def __init__(self, run: Batches, backend: str, model: str):
        self.run, self.backend, self.model = run, backend, model

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.mapInPandas(self.run, requests.withColumn("completion", F.lit("")).schema)


GENERATORS: dict[str, Callable[..., Generator]] = {"mock": Mock, "static": Static}


def make_generator(name: str, *args, **kwargs) -> Generator:
    if name not in GENERATORS:
        raise ValueError(f"unknown generator: {name}")
    return GENERATORS[name](*args, **kwargs)


def generate(tasks: DataFrame, generator: Generator, samples: int = 1, seed: int = 0, runner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rollouts with parsed completions; with a runner, which adds the column execution, also run."""
    public = F.transform("public_tests", lambda t: t["code"])
    requests = plan(tasks, samples, seed).withColumn("rendered", text.render_prompt(F.col("prompt"), F.col("starter_code"), F.col("entry_point"), public))
    made = generator(requests).withColumn("parsed", extract_code("completion"))
    made = made if runner is None else runner(made)
    return made.select(*(c for c in ("task_id", "sample_index", "execution") if c in made.columns), F.col("rendered").alias("prompt"), F.col("completion").alias("raw_completion"), "parsed", F.lit(generator.backend).alias("backend"), F.lit(generator.model).alias("model_name"))


def self_debug(rollouts: DataFrame, check: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """Rounds of check and rule-based revision: check adds public_passed (to columns entry_point, tests,
    code); code that failed is revised, up to `most` times. The number of rounds is fixed, so the plan is."""
    now = check(rollouts.withColumn("revisions", F.lit(0)))
    for _ in range(most):
        fix = ~F.col("public_passed")
        revised = F.when(fix, simple_repair("entry_point", "tests", "code")).otherwise(F.col("code"))
        now = check(now.withColumn("__new", revised).withColumn("revisions", F.col("revisions") + (fix & (F.col("__new") != F.col("code"))).cast("int")).withColumn("code", F.col("__new")).drop("__new", "public_passed"))
    return now


def skip_reason(source: str = "parsed_code", failed_parses: bool = False, response_tokens: Column | None = None) -> Column:
    """Why a rollout can't be a training sample; null if it can. The first reason counts: how the parse
    ended, a blank response, a reward that is null or no number, and, with response_tokens, none of them."""
    response = F.col("raw_completion") if source == "raw_completion" else F.col("parsed.code")
    reasons = [] if failed_parses else [F.when(F.col("parsed.status") != "ok", F.concat(F.lit("parse_status_"), F.col("parsed.status")))]
    reasons.append(F.when(F.size(text.tokens(F.coalesce(response, F.lit("")))) == 0, "empty_response_text"))
    reasons.append(F.when(F.col("reward").try_cast("double").isNull(), "invalid_reward"))
    if response_tokens is not None:
        reasons.append(F.when(response_tokens == 0, "empty_response_tokens"))
    return F.coalesce(*reasons)


def packed(prompt: Column, response: Column, most_prompt: int | None = None, most_response: int | None = None) -> Column:
    """Ids and masks of prompt and response; prompts lose their left end, responses their right one."""
    p, r = sequences.token_ids(text.tokens(prompt)), sequences.token_ids(text.tokens(response))
    p = p if most_prompt is None else sequences.truncate(p, most_prompt, "left")
    r = r if most_response is None else sequences.truncate(r, most_response, "right")
    return F.struct(F.concat(p, r).alias("input_ids"), sequences.response_mask(F.size(p), F.size(r), F.lit(0)).alias("masks"), F.size(r).alias("response_tokens"))


def sample_metadata(rollouts: DataFrame, source: str = "parsed_code", most_prompt: int | None = None, most_response: int | None = None) -> Column:
    """What a training sample keeps of its rollout, as a map of texts: backend, model, template, parse, token counts,
    whether prompt and response were cut, and scalar entries of generation_metadata and metadata (JSON) under prefixes.
    Columns that rollouts lacks, and nulls, have no entry."""
    response = F.col("raw_completion") if source == "raw_completion" else F.col("parsed.code")
    cut = {n: sequences.encoded(F.coalesce(x, F.lit("")), most, side) for n, x, most, side in (("prompt", F.col("prompt"), most_prompt, "left"), ("response", response, most_response, "right"))}
    told = {c: F.col(c) for c in ("backend", "model_name", "prompt_template") if c in rollouts.columns}
    told |= {"parse_status": F.col("parsed.status"), "parser": F.col("parsed.parser"), "response_source": F.lit(source)}
    told |= {f"{n}_tokens": F.size(x["token_ids"]) for n, x in cut.items()} | {f"{n}_truncated": x["truncated"] for n, x in cut.items()}
    told |= {"execution_passed": F.col("execution.passed")} if "execution" in rollouts.columns else {}
    own = F.map_filter(F.create_map(*(y for n, x in told.items() for y in (F.lit(n), x.cast("string")))), lambda _, v: v.isNotNull())
    for column, prefix in (("generation_metadata", "generation_"), ("metadata", "rollout_")):
        if column in rollouts.columns:
            own = selection.merged(own, selection.scalar_metadata(F.col(column), prefix))
    return own


def training_batch(rollouts: DataFrame, source: str = "parsed_code", failed_parses: bool = False, least_std: float = 1e-8, **limits) -> tuple[DataFrame, DataFrame]:
    """(samples with ids, masks and group advantages, skipped rollouts with reasons)."""
    response = F.col("raw_completion") if source == "raw_completion" else F.col("parsed.code")
    made = rollouts.withColumn("packed", packed(F.col("prompt"), F.coalesce(response, F.lit("")), **limits))
    routed = made.withColumn("skip_reason", skip_reason(source, failed_parses, F.col("packed.response_tokens")))
    good = routed.where("skip_reason is null").withColumn("reward", F.col("reward").try_cast("double")).withColumn("passed", F.coalesce("passed", F.lit(False)) if "passed" in rollouts.columns else F.lit(False))
    samples = evaluate.standardized(good, least_std)
    return samples.select("task_id", "sample_index", "packed.*", "reward", "advantage"), routed.where("skip_reason is not null").select("task_id", "sample_index", "skip_reason")
