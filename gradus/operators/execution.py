"""Results of running completions, phase by phase. Running code is a plug-in; what its outcomes mean is here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.code import reward_hacking
from gradus.functions.text import strip
from gradus.operators.rewards import fold_status

#: Phases in the order in which they run, each only if those before have passed (fixed values).
ORDER = ("syntax", "security", "import", "public_tests", "hidden_tests")


def candidate_code(starter: Column, solution: Column) -> Column:
    """Starter code, if there is any, above the solution."""
    head = F.coalesce(starter, F.lit(""))
    return F.when(strip(head) == "", solution).otherwise(F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("\n\n"), solution))


def first_error(outcomes: Column) -> Column:
    """Error of the first outcome that has not passed and has one; else empty."""
    bad = F.filter(outcomes, lambda o: (o["status"] != "passed") & (F.coalesce(o["error"], F.lit("")) != ""))
    return F.coalesce(F.get(bad, F.lit(0))["error"], F.lit(""))


def tests_phase(name: str, outcomes: Column) -> Column:
    """A phase of tests: the gravest status of its outcomes, how many ran, and the first error."""
    return F.struct(F.lit(name).alias("name"), fold_status(F.transform(outcomes, lambda o: o["status"])).alias("status"), F.size(outcomes).alias("tests_run"), first_error(outcomes).alias("error"), outcomes.alias("test_outcomes"))


def stopped_at_first(phases: Column) -> Column:
    """Phases up to the first that has not passed, with those behind it left out."""
    bad = F.array_position(F.transform(phases, lambda p: F.coalesce(p["status"] != "passed", F.lit(True))), F.lit(True))
    return F.when(bad > 0, F.slice(phases, F.lit(1), bad.cast("int"))).otherwise(phases)


def run_status(phases: Column) -> Column:
    """Status of a run: that of the last phase that ran; passed without phases."""
    return F.coalesce(F.try_element_at(stopped_at_first(phases), F.lit(-1))["status"], F.lit("passed"))


def outcome_summary(phases: Column) -> Column:
    """Of each phase with tests how many have passed, as in 'public_tests 2/3; hidden_tests 0/1'."""
    told = F.filter(phases, lambda p: F.size(F.coalesce(p["test_outcomes"], F.array().cast("array<struct<name:string,status:string,error:string>>"))) > 0)
    one = lambda p: F.concat(p["name"], F.lit(" "), F.size(F.filter(p["test_outcomes"], lambda o: o["status"] == "passed")).cast("string"), F.lit("/"), F.size(p["test_outcomes"]).cast("string"))
    return F.array_join(F.transform(told, one), "; ")


def observation(phase: Column, default: str, error: Column | None = None) -> Column:
    """What a model is told of a phase; error is its error, or else its stripped error stream."""
    detail = F.lit("failed") if error is None else F.coalesce(F.nullif(strip(F.coalesce(error, F.lit(""))), F.lit("")), F.lit("failed"))
    return F.when(phase["name"].isNull(), default).when(phase["status"] == "passed", F.concat(phase["name"], F.lit(" passed"))).otherwise(F.concat(phase["name"], F.lit(" "), phase["status"], F.lit(": "), detail))


def hacking_scan(rollouts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rollouts (task_id, sample_index, code) with the signs of reward hacking; tasks has task_id, entry_point and
    visible_tests (texts). Rollouts of unknown tasks are looked at without tests. A shuffle join by task_id, or
    a broadcast where the optimizer finds tasks small."""
    known = tasks.select("task_id", "entry_point", "visible_tests")
    joined = rollouts.join(known, "task_id", "left")
    return joined.withColumn("report", reward_hacking("code", "entry_point", "visible_tests")).drop("entry_point", "visible_tests")


def hacking_counts(scanned: DataFrame) -> DataFrame:
    """reason, rollouts: how many are flagged for each reason, with all rollouts as 'scanned' and the flagged ones as 'flagged'."""
    flagged = F.col("report.flagged")
    said = F.concat(F.array(F.lit("scanned")), F.when(flagged, F.array(F.lit("flagged"))).otherwise(F.array().cast("array<string>")), F.when(flagged, F.col("report.reasons")).otherwise(F.array().cast("array<string>")))
    return scanned.select(F.explode(said).alias("reason")).groupBy("reason").agg(F.count("*").alias("rollouts"))
