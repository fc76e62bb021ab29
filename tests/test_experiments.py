"""Experiment matrices and what is read from them: right rows, from few tasks."""

from itertools import product

from pyspark.sql import functions as F

from gradus.operators import experiments
from gradus.plans import catalogue

SETTINGS = {"seed": (1, 2, 3), "group_size": (4, 8), "kl_beta": (0.02, 0.05), "curriculum_mode": ("static", "informative"), "reward_name": ("x", "y")}


def ran(spark, df):
    """The rows, and how many tasks were set up for them."""
    spark.sparkContext.setJobGroup(name := f"tasks-{id(df)}", name)
    rows = df.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return rows, sum(info.numTasks for s in stages if (info := told.getStageInfo(s)))


def runs(spark):
    return experiments.matrix(spark, 10, **SETTINGS).withColumns({"mean_reward": F.pmod(F.col("ord"), F.lit(7)) / 10, "informative": F.lit(0.5), "with_variance": F.lit(0.5), "pass_rate": F.lit(0.5), "parse_failure_rate": F.lit(0.0), "stopped_early": F.col("ord") == 6, "rollouts": F.lit(80)})


def test_matrix_needs_no_product_of_partitions(spark):
    df = experiments.matrix(spark, 10, **SETTINGS)
    rows, tasks = ran(spark, df.orderBy("ord"))
    assert [tuple(r)[:6] for r in rows] == [(i, *v) for i, v in enumerate(product(*SETTINGS.values()))]
    assert rows[0].slug == "g4_kl0p02_static_x_seed1" and {r.max_steps for r in rows} == {10} and tasks < 50
    assert dict(df.dtypes) | {"seed": "bigint", "group_size": "bigint", "kl_beta": "double"} == dict(df.dtypes)


def test_matrix_of_an_empty_axis_a_null_and_mixed_numbers(spark):
    assert experiments.matrix(spark, 1, **SETTINGS | {"seed": ()}).collect() == []
    odd = experiments.matrix(spark, 1, **SETTINGS | {"seed": (None, 2**40), "kl_beta": (0, 0.5), "group_size": (4,)}).orderBy("ord").collect()
    assert [(r.seed, r.kl_beta) for r in odd[::4]] == [(None, 0.0), (None, 0.5), (2**40, 0.0), (2**40, 0.5)]


def test_comparison_of_frames_with_many_partitions(spark):
    df = spark.createDataFrame([(m / 4, 0.5, 80) for m in range(9)], "mean_reward double, pass_rate double, rollouts long")
    got = experiments.compare_algorithms(df.where("mean_reward = 0.25"), df.where("mean_reward = 0.75"))
    assert got.rdd.getNumPartitions() <= df.rdd.getNumPartitions()  # not their product
    assert [(r.a_mean_reward, r.b_mean_reward, r.delta_mean_reward, r.same_budget) for r in got.collect()] == [(0.25, 0.75, 0.5, True)]


def test_comparison_of_two_rows_of_a_matrix(spark):
    r = runs(spark)
    rows, tasks = ran(spark, experiments.compare_algorithms(r.where("ord = 1"), r.where("ord = 2")))
    assert [x.delta_mean_reward for x in rows] == [0.1] and rows[0].same_budget and tasks < 50


def test_best_run_of_a_matrix(spark):
    rows, tasks = ran(spark, experiments.best_run(runs(spark), least_informative=0.3))
    assert [(r.ord, r.mean_reward) for r in rows] == [(13, 0.6)] and tasks < 50  # 6 was stopped


def test_seed_averages_of_a_matrix(spark):
    rows, tasks = ran(spark, experiments.seed_averages(runs(spark)))
    got = {r.variant: (r.runs, round(r.mean_reward, 6)) for r in rows}
    assert len(got) == 16 and got["4|0.02|static|x"] == (3, round((0 + 16 % 7 + 32 % 7) / 30, 6)) and tasks < 50


def test_query_algorithm_comparison_takes_few_tasks(spark):
    rows, tasks = ran(spark, catalogue.algorithm_comparison(spark, "no tables"))
    assert [tuple(r) for r in rows] == [(0.7, 0.3, -0.4, True)] and tasks < 50


def test_query_best_run_takes_few_tasks(spark):
    rows, tasks = ran(spark, catalogue.best_run(spark, "no tables"))
    assert [tuple(r) for r in rows] == [("g8_kl0p05_informative_y_seed3", 1.0)] and tasks < 50


def test_query_seed_averages_takes_few_tasks(spark):
    rows, tasks = ran(spark, catalogue.seed_averages(spark, "no tables"))
    assert len(rows) == 16 and ("4|0.02|static|x", 3, 0.2, 0.2) in {tuple(r) for r in rows} and tasks < 50
