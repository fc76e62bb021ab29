"""Queries over the test tables, one for each operator or group of operators, with DuckDB SQL
where SQL can say the same. Reals are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import code, stats, text
from gradus.operators import contamination, curves, evaluate, execution, experiments, paired, rewards, selection, sequences, splits, traces
from gradus.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers as bigint: what both engines agree on."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "bigint", "smallint", "tinyint") else F.col(c) for c in df.columns))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the role of rollouts: task by user, sample by time, passed if it is a purchase."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.row_number().over(w) - 1).alias("sample_index"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("passed"), "event_type", "props", "event_id")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in the role of rollouts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("sample_index"), F.col("l_discount").alias("reward"), (F.col("l_returnflag") == "N").alias("passed"), "l_extendedprice")


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels in the role of outcomes of two systems: quality, and not toxic."""
    one = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return one.select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("base_passed"), (F.col("toxic") == 0).alias("candidate_passed"), F.col("quality").cast("double").alias("base_reward"), (1 - F.col("toxic")).cast("double").alias("candidate_reward"))


EV = "WITH r AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index, value AS reward, event_type = 'purchase' AS passed, event_type, props, event_id FROM events)"
PASSK = "CASE WHEN n <= 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - coalesce((SELECT product(1 - {k}.0 / i) FROM range(n - c + 1, n + 1) t(i)), 1.0) END"
TASKS = EV + ", t AS (SELECT task_id, count(*) AS n, sum(passed::INT)::BIGINT AS c, avg(reward) AS m, min(reward) AS lo, max(reward) AS hi, sum(reward) AS s FROM r GROUP BY task_id), k AS (SELECT *, {p1} AS p1, {p5} AS p5, {p10} AS p10 FROM t)".format(**{f"p{k}": PASSK.format(k=k) for k in (1, 5, 10)})


@query(TASKS + " SELECT task_id, n AS samples, c AS correct, round(m, 6) AS mean_reward, round(lo, 6) AS min_reward, round(hi, 6) AS max_reward, round(p1, 6) AS pass_at_1, round(p5, 6) AS pass_at_5, round(p10, 6) AS pass_at_10 FROM k")
def eval_task_summary(spark, d):
    return rounded(evaluate.by_task(rollouts(spark, d)).drop("reward_sum"))


@query(
    TASKS
    + ", a AS (SELECT count(*) AS tasks, sum(n)::BIGINT AS rollouts, sum(c) / sum(n) AS pass_rate, avg((c > 0 AND c < n)::INT) AS informative, avg(p1) AS pass_at_1, avg(p5) AS pass_at_5, avg(p10) AS pass_at_10 FROM k), b AS (SELECT avg(reward) AS mean_reward, median(reward) AS median_reward, min(reward) AS min_reward, max(reward) AS max_reward, stddev_pop(reward) AS std_reward FROM r) SELECT tasks, rollouts, round(pass_rate, 6) AS pass_rate, round(informative, 6) AS informative, round(pass_at_1, 6) AS pass_at_1, round(pass_at_5, 6) AS pass_at_5, round(pass_at_10, 6) AS pass_at_10, round(mean_reward, 6) AS mean_reward, round(median_reward, 6) AS median_reward, round(min_reward, 6) AS min_reward, round(max_reward, 6) AS max_reward, round(std_reward, 6) AS std_reward FROM a, b"
)
def eval_global_summary(spark, d):
    return rounded(evaluate.overall(rollouts(spark, d)))


@query(
    EV
    + ", g AS (SELECT 'event_type' AS field, coalesce(event_type, 'missing') AS value, * EXCLUDE (event_type, props) FROM r UNION ALL SELECT 'k', coalesce(json_extract_string(props, '$.k'), 'missing'), * EXCLUDE (event_type, props) FROM r UNION ALL SELECT 'no.such', 'missing', * EXCLUDE (event_type, props) FROM r), t AS (SELECT field, value, task_id, count(*) AS n, sum(passed::INT)::BIGINT AS c, sum(reward) AS s FROM g GROUP BY ALL), k AS (SELECT *, "
    + PASSK.format(k=1)
    + " AS p1, "
    + PASSK.format(k=5)
    + " AS p5 FROM t) SELECT field, value, count(*) AS tasks, sum(n)::BIGINT AS rollouts, round(sum(c) / sum(n), 6) AS pass_rate, round(sum(s) / sum(n), 6) AS mean_reward, round(avg(p1), 6) AS pass_at_1, round(avg(p5), 6) AS pass_at_5 FROM k GROUP BY field, value"
)
def eval_group_summary(spark, d):
    fields = {"event_type": evaluate.field(F.col("event_type"), ""), "k": evaluate.field(F.col("props"), "k", True), "no.such": evaluate.field(F.col("props"), "no.such", True)}
    return rounded(evaluate.by_fields(rollouts(spark, d), fields, (1, 5)))


@query("SELECT l_orderkey AS task_id, count(*) AS kept, round(sum(l_discount), 6) AS reward_sum, max(l_linenumber)::BIGINT AS last_sample FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount) AS rn FROM lineitem) WHERE rn <= 2 GROUP BY 1")
def eval_sample_cap(spark, d):
    capped = evaluate.cap_samples(dense(spark, d), 2, ("sample_index", "reward"))
    return rounded(capped.groupBy("task_id").agg(F.count("*").alias("kept"), F.sum("reward").alias("reward_sum"), F.max("sample_index").alias("last_sample")))


@query("WITH t AS (SELECT n, c FROM range(0, 13) a(n), range(0, 13) b(c) WHERE c <= n) SELECT n::BIGINT AS n, c::BIGINT AS c, " + ", ".join(f"round({PASSK.format(k=k)}, 6) AS pass_at_{k}" for k in (1, 2, 5, 10)) + " FROM t")
def pass_at_k_grid(spark, d):
    n = spark.range(13).select(F.col("id").cast("int").alias("n"))
    grid = n.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return rounded(grid.select("n", "c", *(stats.pass_at_k(F.col("n"), F.col("c"), k).alias(f"pass_at_{k}") for k in (1, 2, 5, 10))))


ADV = "WITH g AS (SELECT l_orderkey AS task_id, l_linenumber AS sample_index, l_discount AS reward, avg(l_discount) OVER w AS m, stddev_pop(l_discount) OVER w AS s, count(*) OVER w * sum(round(l_discount * 1e9)::HUGEINT * round(l_discount * 1e9)::HUGEINT) OVER w - (sum(round(l_discount * 1e9)::HUGEINT) OVER w) * (sum(round(l_discount * 1e9)::HUGEINT) OVER w) AS v, count(*) OVER w * round({eps} * 1e9)::HUGEINT AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT task_id, sample_index::BIGINT AS sample_index, round(CASE WHEN v > e * e THEN (reward - m) / s ELSE 0 END, 6) + 0.0 AS advantage FROM g"


@query(ADV.format(eps="1e-8"))
def group_advantage(spark, d):
    return rounded(evaluate.standardized(dense(spark, d), 1e-8).select("task_id", "sample_index", "advantage"))


@query(ADV.format(eps="0.02"))
def group_advantage_threshold(spark, d):
    return rounded(evaluate.standardized(dense(spark, d), 0.02).select("task_id", "sample_index", "advantage"))


@query("WITH g AS (SELECT l_orderkey AS t, l_discount AS r, l_returnflag = 'N' AS p, avg(l_discount) OVER w AS m, stddev_pop(l_discount) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)), k AS (SELECT t, sum(p::INT) AS c, count(*) AS n, any_value(s) AS s FROM g GROUP BY t), a AS (SELECT avg(r) AS mr, stddev_pop(r) AS sr, avg(abs(CASE WHEN s > 1e-8 THEN (r - m) / s ELSE 0 END)) AS ma FROM g), b AS (SELECT avg((c > 0 AND c < n)::INT) AS i, avg((s > 0)::INT) AS v FROM k) SELECT round(mr, 5) AS mean_reward, round(sr, 6) AS std_reward, round(ma, 4) AS mean_abs_advantage, round(i, 6) AS informative FROM a, b")
def step_metrics(spark, d):
    got = evaluate.step_metrics(evaluate.standardized(dense(spark, d), 1e-8)).drop("with_variance")
    return rounded(got.withColumns({"mean_abs_advantage": F.round("mean_abs_advantage", 4), "mean_reward": F.round("mean_reward", 5)}))


@query("WITH m AS (SELECT avg(l_discount) AS m FROM lineitem), x AS (SELECT l_discount - m AS a, 1 + (l_linenumber % 5 - 2) * 0.08::DOUBLE AS r, l_discount AS d FROM lineitem, m) SELECT round(avg(d), 5) AS mean_reward, round(avg(least(r * a, greatest(0.8, least(1.2, r)) * a)), 6) AS objective, round(avg((abs(r - 1) > 0.2)::INT), 6) AS clip_fraction, round(avg(a * a) * 0.5, 6) AS value_loss FROM x")
def critic_smoke_step(spark, d):
    return rounded(evaluate.clipped_smoke_step(dense(spark, d)).withColumn("mean_reward", F.round("mean_reward", 5)))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_discount, l_returnflag = 'N' AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber = 2) DESC, l_linenumber, l_discount, l_returnflag = 'N') AS rn FROM lineitem), o AS (SELECT o_orderkey, o_orderstatus = 'F' AS ok, o_totalprice FROM orders) SELECT l_orderkey AS task_id, p.ok AS base_passed, o.ok AS candidate_passed, round(l_discount, 6) + 0.0 AS base_reward, round(o_totalprice, 6) AS candidate_reward FROM p JOIN o ON l_orderkey = o_orderkey WHERE rn = 1")
def paired_outcomes(spark, d):
    other = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(0).alias("sample_index"), (F.col("o_orderstatus") == "F").alias("passed"), F.col("o_totalprice").alias("reward"))
    return rounded(paired.outcomes(dense(spark, d), other, 2))


CELLS = "SELECT sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS \"both\", sum((quality = 1 AND toxic <> 0)::INT)::BIGINT AS base_only, sum((quality <> 1 AND toxic = 0)::INT)::BIGINT AS candidate_only, sum((quality <> 1 AND toxic <> 0)::INT)::BIGINT AS neither FROM labels"
TAIL = "least(1.0, 2 * (SELECT sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))) FROM range(0, ({k} + 1)::BIGINT) t(i)))"


@query(f"WITH c AS ({CELLS}) SELECT *, base_only + candidate_only AS discordant, round(CASE WHEN base_only + candidate_only = 0 THEN 1.0 ELSE {TAIL.format(n='(base_only + candidate_only)', k='least(base_only, candidate_only)')} END, 6) AS p_value FROM c")
def mcnemar(spark, d):
    return rounded(paired.mcnemar(systems(spark, d)))


@query("WITH p AS (SELECT doc_id, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b FROM labels), s AS (SELECT count(*) AS n, avg(a) AS a, avg(b) AS b, avg(b - a) AS m, stddev_pop(b - a) AS s FROM p) SELECT n AS tasks, round(a, 6) AS base_rate, round(b, 6) AS candidate_rate, round((b - a) * 100, 6) AS delta_points, round((b - a) / nullif(a, 0), 6) AS relative_lift, round((b - a) / nullif(1 - a, 0), 6) AS error_reduction, round(m, 6) AS reward_delta, round(m / nullif(s, 0), 6) AS standardized_reward_delta FROM s")
def effect_sizes(spark, d):
    return rounded(paired.effects(systems(spark, d)))


@query(f"WITH c AS (SELECT n::BIGINT AS n, plus::BIGINT AS plus, abs(2 * plus - n) AS far FROM range(0, 21) a(n), range(0, 21) b(plus) WHERE plus <= n) SELECT n, plus, round(CASE WHEN n = 0 OR far = 0 THEN 1.0 ELSE {TAIL.format(n='n', k='((n - far) // 2)')} END - 1e-9, 6) AS p_value FROM c")
def permutation_exact(spark, d):
    n = spark.range(21).select(F.col("id").cast("int").alias("n"))
    grid = n.withColumn("plus", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return rounded(grid.select("n", "plus", (stats.sign_flip_p(F.col("n"), F.col("plus")) - 1e-9).alias("p_value")))


HASH = "('0x' || substr(md5({x}), 1, 8))::BIGINT"


@query(
    f"WITH c AS ({CELLS}), d AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 1 ELSE -1 END AS d FROM labels WHERE (quality = 1) <> (toxic = 0)), g AS (SELECT word, d, {HASH.format(x='concat(20260601, chr(58), word, chr(58), doc_id)')} AS h FROM d, range(0, 313) w(word)), s AS (SELECT word, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN d ELSE -d END) AS t FROM g, range(0, 32) b(i) GROUP BY word, i), e AS (SELECT count(*) AS extreme FROM s, c WHERE word * 32 + i < 10000 AND abs(t) >= abs(candidate_only - base_only)) SELECT candidate_only + base_only AS n, candidate_only - base_only AS observed, candidate_only + base_only <= 20 AS is_exact, round((extreme + 1) / 10001, 6) AS p_value FROM c, e"
)
def permutation_sampled(spark, d):
    return rounded(paired.permutation(systems(spark, d)))


@query(
    f"WITH c AS ({CELLS}), n AS (SELECT *, \"both\" + base_only + candidate_only + neither AS n FROM c), g AS (SELECT rep, {HASH.format(x='concat(20260601, chr(58), rep, chr(58), i)')} % n AS pos, candidate_only AS up, base_only AS down FROM n, range(0, 2000) r(rep), range(0, n.n) t(i)), m AS (SELECT rep, sum(CASE WHEN pos < up THEN 1 WHEN pos < up + down THEN -1 ELSE 0 END) / count(*) AS m FROM g GROUP BY rep), l AS (SELECT avg(m) AS mean, list_sort(list(m)) AS v FROM m) SELECT round(mean, 6) AS mean, round(v[CAST(floor(0.025 * (len(v) - 1) + 1e-12) AS BIGINT) + 1], 6) AS low, round(v[CAST(floor(0.975 * (len(v) - 1) + 1e-12) AS BIGINT) + 1], 6) AS high FROM l"
)
def bootstrap_interval(spark, d):
    return rounded(paired.bootstrap(systems(spark, d)))


@query("SELECT count(*) AS n, round(avg(quality), 6) AS rate, round(2 * 1.96 * sqrt(avg(quality) * (1 - avg(quality)) / count(*)) * 100, 6) AS points FROM labels")
def power_effect(spark, d):
    rows = table(spark, d, "labels").agg(F.count("*").alias("n"), F.avg("quality").alias("rate"))
    return rounded(rows.select("n", "rate", stats.minimum_detectable_effect(F.col("n"), F.col("rate")).alias("points")))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'))) AS prose, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS code FROM documents")
def normalized_texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.normalize_prose(F.col("text")).cast("binary")).alias("prose"), F.md5(text.normalize_code(F.col("text")).cast("binary")).alias("code"))


WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH x AS (SELECT doc_id, text, {WORDS} AS w, {LINES} AS l FROM documents) SELECT doc_id, len(w)::BIGINT AS tokens, round(CASE WHEN len(l) = 0 THEN 0 ELSE 1 - len(list_distinct(l)) / len(l) END, 6) AS repeated, len(w) = 0 OR (len(l) >= 4 AND len(list_distinct(l)) <= 0.5 * len(l)) OR (len(w) >= 20 AND len(list_distinct(w)) <= 0.2 * len(w)) AS degenerate FROM x")
def text_diagnostics(spark, d):
    x = F.col("text")
    return rounded(table(spark, d, "documents").select("doc_id", text.token_count(x).alias("tokens"), text.repeated_line_fraction(x).alias("repeated"), text.is_degenerate(x).alias("degenerate")))


@query(f"WITH x AS (SELECT doc_id, text, {LINES} AS l, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents) SELECT doc_id, round(1 - CASE WHEN longest > 100 THEN 0.15 ELSE 0 END - CASE WHEN len(l) > 120 THEN 0.2 ELSE 0 END - CASE WHEN length(text) > 8000 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM x")
def quality_scores(spark, d):
    return rounded(table(spark, d, "documents").select("doc_id", text.quality_score(F.col("text"), F.lit(True)).alias("score")))


@query("SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS t, doc_id % 2 = 0 AS train FROM documents) SELECT a.doc_id AS id_a, b.doc_id AS id_b, 'exact_duplicate' AS kind, 1.0::DOUBLE AS score FROM n a JOIN n b ON a.t = b.t AND a.train AND NOT b.train AND a.t <> ''")
def contamination_exact(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return contamination.exact_overlap(docs.where("id % 2 = 0"), docs.where("id % 2 <> 0"))


@query("WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS t FROM documents), i AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS t FROM benchmark) SELECT doc_id AS id, item_id FROM n, i WHERE i.t <> '' AND contains(' ' || n.t || ' ', ' ' || i.t || ' ')")
def benchmark_containment(spark, d):
    return contamination.contained(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark"))


@query()
def contamination_near(spark, d):
    """All documents, as train texts, against the items of the benchmark."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return contamination.near_overlap(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 0.6)


def inline_tasks(spark: SparkSession) -> DataFrame:
    """Five small tasks with a leak, an exact and a near copy."""
    t = lambda name, c, v: {"name": name, "code": c, "visibility": v, "kind": "unit"}
    rows = [
        ("leak", "Solve it. assert  f(2) == 3", "train", "", [t("public_1", "assert f(2) == 3\nassert f(0) == 1", "public")], [t("hidden_1", "assert f(2) == 3", "hidden")]),
        ("same-a", "Write a function that adds one", "train", "def f(x):", [t("public_1", "assert f(1) == 2", "public")], []),
        ("same-b", "write a FUNCTION, that adds one!", "dev", "def f(x):", [t("public_1", "assert f(1) == 2", "public"), t("public_2", "assert f(5) == 6", "public"), t("check", "assert f(7) == 8", "public")], []),
        ("near", "Write a Python function that adds one", "test_public", "def f(x):", [], [t("hidden_1", "assert f(9) == 10", "hidden")]),
        ("far", "Sort the words of a sentence by their length", "stress", "", [], []),
    ]
    tests = records.TEST
    return spark.createDataFrame([(i, p, s, c, "f", a, b) for i, p, s, c, a, b in rows], f"task_id string, prompt string, split string, starter_code string, entry_point string, public_tests array<{tests}>, hidden_tests array<{tests}>")


@query("SELECT * FROM (VALUES ('leak', 'hidden_1', 'prompt', 'assert f(2) == 3'), ('leak', 'hidden_1', 'public_tests', 'assert f(2) == 3')) t(task_id, test_name, surface, snippet)")
def hidden_test_leaks(spark, d):
    return contamination.hidden_leaks(inline_tasks(spark))


@query("SELECT * FROM (VALUES ('same-a', 'near', 'near_duplicate'), ('same-a', 'same-b', 'exact_duplicate')) t(id_a, id_b, kind)")
def task_overlap(spark, d):
    return contamination.quality_report(inline_tasks(spark), 0.8)["overlap"].select("id_a", "id_b", "kind")


@query("SELECT * FROM (VALUES ('leak', false, 1, 1), ('same-a', false, 1, 0), ('same-b', true, 1, 2), ('near', false, 0, 1), ('far', false, 0, 0)) t(task_id, was_split, n_public, n_hidden)")
def held_out_tests(spark, d):
    c = splits.hold_out()
    return inline_tasks(spark).withColumns(c).select("task_id", "was_split", F.size("public_tests").alias("n_public"), F.size("hidden_tests").alias("n_hidden"))


FRACTIONS = {"train": 0.67, "dev": 0.17, "test_public": 0.1}
SPLIT = "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY md5('20260601:' || doc_id), doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents), y AS (SELECT doc_id, CASE WHEN rk < floor(n * 0.67::DOUBLE) THEN 'train' WHEN rk < floor(n * 0.67::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'dev' WHEN rk < floor(n * 0.67::DOUBLE) + floor(n * 0.17::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'test_public' ELSE 'test_private' END AS split FROM x)"


@query(SPLIT + " SELECT doc_id, split FROM y")
def split_assignment(spark, d):
    return splits.assign(table(spark, d, "documents").select("doc_id"), FRACTIONS, id_column="doc_id")


@query(SPLIT + " SELECT split, count(*) AS n FROM y GROUP BY split")
def split_counts(spark, d):
    return split_assignment(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT text_md5, count(*) AS n FROM (SELECT md5(text) AS text_md5 FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return splits.duplicates(docs, "text_md5")


@query("SELECT sha256(string_agg(c, chr(10) ORDER BY r)) AS fingerprint, count(*) AS n FROM (SELECT r_regionkey AS r, '{\"key\": ' || r_regionkey || ', \"name\": \"' || r_name || '\"}' AS c FROM region)")
def dataset_fingerprint(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", splits.canonical_json(F.to_json(F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")))).alias("canonical"))
    return splits.fingerprint(rows, "r_regionkey")


def executions(spark: SparkSession, d: str) -> DataFrame:
    """lineitem in the role of executed completions: tests by quantity, statuses by flags."""
    li = table(spark, d, "lineitem")
    q, flag = F.col("l_quantity").cast("int"), F.col("l_returnflag")
    outcomes = lambda n, m: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("name"), F.when(F.pmod(i * m + q, F.lit(3)) == 0, "failed").otherwise("passed").alias("status"), F.lit(None).cast("string").alias("error")))
    ph = lambda n, s, t, o: F.struct(F.lit(n).alias("name"), s.alias("status"), F.lit(0.1).alias("duration_seconds"), t.cast("int").alias("tests_run"), o.cast("array<struct<name:string,status:string,error:string>>").alias("test_outcomes"))
    none = F.array()
    n_pub, n_hid = F.pmod(q, F.lit(4)) + 1, F.pmod(q, F.lit(5)) + 1
    public = F.when(flag == "A", "timeout").when(flag == "R", "failed").otherwise("passed")
    hidden = F.when(flag == "N", F.lit("passed")).otherwise("skipped")
    phases = F.array(ph("syntax", F.lit("passed"), F.lit(0), none), ph("import", F.lit("passed"), F.lit(0), none), ph("public_tests", public, n_pub, outcomes(n_pub, 1)), ph("hidden_tests", hidden, F.when(flag == "N", n_hid).otherwise(0), F.when(flag == "N", outcomes(n_hid, 2)).otherwise(none)))
    e = F.struct(public.alias("status"), (flag == "N").alias("passed"), (q / 10.0).alias("duration_seconds"), phases.alias("phases"))
    return li.select("l_orderkey", "l_linenumber", q.alias("q"), flag.alias("flag"), e.alias("execution"))


FRAC = "(SELECT avg((({q} + i * {m}) % 3 <> 0)::INT) FROM range(1, {n} + 1) t(i))"
EXE = f"WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_returnflag AS flag FROM lineitem), f AS (SELECT *, {FRAC.format(q='q', m=1, n='(q % 4 + 1)')} AS pub, CASE WHEN flag = 'N' THEN {FRAC.format(q='q', m=2, n='(q % 5 + 1)')} ELSE 0 END AS hid, CASE WHEN flag = 'A' THEN -0.5 ELSE 0 END AS pen FROM x)"


@query(EXE + " SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(greatest(-1, least(1, CASE WHEN flag = 'N' THEN (0.2 + 0.3 * pub + 0.4 * hid) / 0.9 ELSE (0.2 + 0.3 * pub) / 0.5 END + pen)), 6)::DOUBLE AS reward, round(pen, 6)::DOUBLE AS penalty FROM f")
def reward_correctness(spark, d):
    r = rewards.scored(executions(spark, d), {"r": rewards.scorer()})
    return rounded(r.select("l_orderkey", "l_linenumber", "r.reward", F.col("r.total_penalty").alias("penalty")))


@query(
    EXE
    + " SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN flag = 'N' THEN 1.0 ELSE pen END, 6)::DOUBLE AS binary_reward, round(greatest(-1, least(1, CASE WHEN flag = 'N' THEN (pub * (q % 4 + 1) + hid * (q % 5 + 1)) / (q % 4 + 1 + q % 5 + 1) ELSE pub END + pen)), 6)::DOUBLE AS fractional, round(greatest(-1, least(1, 0.2 + 0.4 * pub + 0.4 * hid + pen)), 6)::DOUBLE AS partial, round(greatest(-1, least(1, 0.2 + 0.4 * pub + 0.4 * hid + 0.05 - 0.02 * length(flag) / 1000)), 6)::DOUBLE AS shaped FROM f"
)
def reward_modes(spark, d):
    scorers = {"binary_reward": rewards.Mode("binary_all_tests_pass"), "fractional": rewards.Mode("fractional_pass_rate"), "partial": rewards.Mode(), "shaped": rewards.Mode(compile_bonus=0.05, length_penalty=0.02, off=("timeout",))}
    made = rewards.scored(executions(spark, d), {n: lambda o, m=m: m.of(o, F.col("flag"))["reward"] for n, m in scorers.items()})
    return rounded(made.select("l_orderkey", "l_linenumber", *scorers))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag = 'A' AS timeout, round(CASE WHEN l_returnflag = 'N' AND l_quantity > 0 THEN greatest(-1, least(1, ln(2.0 / (l_quantity::INT / 10.0)))) END, 6)::DOUBLE AS score, CASE WHEN l_returnflag = 'A' THEN 'timeout' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS final FROM lineitem")
def efficiency_and_status(spark, d):
    e = F.col("execution")
    got = executions(spark, d).select("l_orderkey", "l_linenumber", rewards.efficiency(e, 2.0).alias("x"), rewards.final_status(e).alias("final"))
    return rounded(got.select("l_orderkey", "l_linenumber", "x.timeout", F.col("x.relative_runtime_score").alias("score"), "final"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS n, (l_discount - 0.05) * 10 AS r FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(r * 0.9 ** n, 6) AS every, round(CASE WHEN r > 0 THEN r * 0.9 ** n ELSE r END - 0.01 * n, 6) AS positive FROM x")
def revision_discounts(spark, d):
    r, n = (F.col("l_discount") - 0.05) * 10, F.col("l_linenumber") % 4
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rewards.revision_discount(r, n, 0.9, "all")["reward"].alias("every"), rewards.revision_discount(r, n, 0.9, "positive_only", 0.01)["reward"].alias("positive")))


@query("SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 5 ELSE 7 END) WHEN 1 THEN 'timeout' WHEN 5 THEN 'failed' ELSE 'passed' END AS status FROM lineitem GROUP BY 1")
def phase_status_fold(spark, d):
    s = F.when(F.col("l_returnflag") == "A", "timeout").when(F.col("l_returnflag") == "R", "failed").otherwise("passed")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(rewards.fold_status(F.collect_set(s)).alias("status"))


def conversation_traces(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("observation"))
    t = traces.steps_of(c, "conv_id", "turn", "kind", "observation")
    return t.withColumn("passed", F.size("steps") % 2 == 0).withColumn("reward", F.size("steps") / 10.0)


CONV = "WITH t AS (SELECT conv_id, count(*) AS n, sum((role = 'assistant')::INT) AS a, sum((role = 'user')::INT) AS u FROM conversations GROUP BY 1)"


@query(CONV + " SELECT count(*) AS traces, round(avg((n % 2 = 0)::INT), 6) AS pass_rate, round(avg(n / 10.0), 6) AS mean_reward, round(avg(u), 6) AS mean_tool_calls, round(avg(a), 6) AS mean_revisions, round(avg((a > 0)::INT), 6) AS revision_rate FROM t")
def trace_kpis(spark, d):
    return rounded(traces.kpis(conversation_traces(spark, d), "assistant", lambda s: s["kind"] == "user"))


@query("SELECT conv_id, coalesce(min(turn) FILTER (role = 'user'), -1)::BIGINT AS first_user, coalesce(max(turn) FILTER (role = 'assistant'), -1)::BIGINT AS last_assistant, count(*) AS steps FROM conversations GROUP BY 1")
def trace_first_last(spark, d):
    s = F.col("steps")
    return rounded(conversation_traces(spark, d).select("conv_id", F.coalesce(traces.first_step(s, "user")["position"], F.lit(-1)).alias("first_user"), F.coalesce(traces.last_step(s, "assistant")["position"], F.lit(-1)).alias("last_assistant"), F.size(s).alias("steps")))


EMB = "WITH e AS (SELECT vec_id, label, i - 1 AS p, v::DOUBLE AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double"))).withColumn("mask", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: (i >= 16).cast("int")))


@query(EMB + " SELECT vec_id, round(sum(v) FILTER (p >= 16), 6) AS total, round(avg(v) FILTER (p >= 16), 6) AS mean, round(avg(v - v / 2) FILTER (p >= 16), 6) AS kl_plain, round(avg(exp(v - v / 3)) FILTER (p >= 16), 6) AS ratio FROM e GROUP BY vec_id")
def masked_stats(spark, d):
    v, m = F.col("v"), F.col("mask")
    half, third = (F.transform("v", lambda x: x / 2), F.transform("v", lambda x: x / 3))
    s = sequences.logprob_summary(v, third, half, m)
    return rounded(vectors(spark, d).select("vec_id", sequences.mask_sum(v, m).alias("total"), sequences.mask_mean(v, m).alias("mean"), s["kl_plain"].alias("kl_plain"), s["ratio"].alias("ratio")))


@query(EMB + ", s AS (SELECT vec_id, p, v, CASE WHEN p = 63 THEN label ELSE 0 END + 0.99 * coalesce(lead(v) OVER w, 0) - v AS delta FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY p)) SELECT a.vec_id, a.p::BIGINT AS p, round(sum(b.delta * (0.99 * 0.95) ** (b.p - a.p)), 6) AS advantage FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.p >= a.p GROUP BY a.vec_id, a.p")
def generalized_advantages(spark, d):
    rows = vectors(spark, d).select("vec_id", sequences.advantages(sequences.sparse_rewards(F.col("label"), F.size("v")), F.col("v"), 0.99, 0.95).alias("a"))
    return rounded(rows.select("vec_id", F.posexplode("a").alias("p", "advantage")))


def _losses(spark, d):
    v = F.col("v")
    old, ref = F.transform("v", lambda x: x * 0.5), F.transform("v", lambda x: x * 0.9)
    adv = F.transform("v", lambda x: F.col("label").cast("double") - 4.5)
    return vectors(spark, d).select("vec_id", sequences.policy_loss(v, old, adv, ref, kl_beta=0.05).alias("loss"), sequences.value_loss(v, old, F.transform("v", lambda x: x + 0.3), 0.02).alias("value"))


LOSS = EMB + ", t AS (SELECT vec_id, v, exp(v - 0.5 * v) AS r, label - 4.5 AS a, exp(v * 0.9 - v) - (v * 0.9 - v) - 1 AS kl, power(v - (v + 0.3), 2) AS plain, power(0.5 * v + greatest(-0.02, least(0.02, v - 0.5 * v)) - (v + 0.3), 2) AS kept FROM e), u AS (SELECT vec_id, count(*) AS n, -avg(least(r * a, greatest(0.8, least(1.2, r)) * a)) AS pl, avg(kl) AS kl, avg(r) AS r, sum((abs(greatest(0.8, least(1.2, r)) - r) > 1e-12)::INT) AS c, avg(greatest(plain, kept)) AS vl, sum((kept > plain + 1e-12)::INT) AS vc FROM t GROUP BY vec_id)"


@query(LOSS + " SELECT vec_id, n AS tokens, round(pl, 6)::DOUBLE AS policy_loss, round(0.05 * kl, 6)::DOUBLE AS kl_loss, round(pl + 0.05 * kl, 6)::DOUBLE AS total_loss, round(r, 6) AS mean_ratio, c::BIGINT AS clipped_tokens, round(vl, 6) AS value_loss, vc::BIGINT AS clipped_values FROM u")
def clipped_losses(spark, d):
    x = _losses(spark, d)
    return rounded(x.select("vec_id", "loss.tokens", "loss.policy_loss", "loss.kl_loss", "loss.total_loss", "loss.mean_ratio", "loss.clipped_tokens", "value.value_loss", "value.clipped_values"))


@query(LOSS + " SELECT count(*) AS samples, sum(n)::BIGINT AS tokens, round(avg(pl), 6)::DOUBLE AS policy_loss, round(avg(0.05 * kl), 6)::DOUBLE AS kl_loss, round(avg(pl + 0.05 * kl), 6)::DOUBLE AS total_loss, round(sum(c) / sum(n), 6) AS clip_fraction FROM u")
def batch_losses(spark, d):
    return rounded(sequences.batch_loss(_losses(spark, d)))


@query(EMB + ", m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM e) SELECT vec_id, round(min((v - m) / s), 5) AS lo, round(max((v - m) / s), 5) AS hi FROM e, m GROUP BY vec_id")
def normalized_advantages(spark, d):
    n = sequences.normalize(vectors(spark, d).select("vec_id", F.col("v").alias("advantages")))
    return n.select("vec_id", F.round(F.array_min("advantages"), 5).alias("lo"), F.round(F.array_max("advantages"), 5).alias("hi"))


@query("SELECT n_nationkey::BIGINT AS id, ('0x' || substr(sha256(n_name), 1, 16))::UBIGINT::DECIMAL(20,0)::VARCHAR AS first_id FROM nation")
def token_ids(spark, d):
    ids = sequences.token_ids(F.array("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.get(ids, F.lit(0)) - 1).cast("decimal(20,0)").cast("string").alias("first_id"))


@query("SELECT vec_id, 7::BIGINT AS total, (label % 4)::BIGINT AS response, list_sum(embedding[1:3])::FLOAT IS NOT NULL AS ok FROM embeddings")
def masks_and_padding(spark, d):
    m = sequences.response_mask(F.lit(3), (F.col("label") % 4).cast("int"), (4 - F.col("label") % 4).cast("int"))
    rows = table(spark, d, "embeddings").withColumn("m", m).withColumn("left", sequences.truncate(F.col("embedding"), 3, "left"))
    ok = (F.size("left") == 3) & (F.size(sequences.pad(F.transform("left", lambda x: x.cast("double")), 9)) == 9) & (F.size("m.prompt_mask") == 7)
    return rounded(rows.select("vec_id", F.size("m.attention_mask").alias("total"), F.aggregate("m.response_mask", F.lit(0), lambda a, x: a + x).alias("response"), ok.alias("ok")))


DAYS = "WITH e AS (SELECT dayofmonth(ts) AS cycle, * FROM events)"


@query(DAYS + ", r AS (SELECT cycle, count(*) AS rollouts, avg((event_type = 'purchase')::INT) AS pass_rate, avg(value) AS mean_reward FROM e GROUP BY 1), m AS (SELECT cycle, avg(value) FILTER (event_type = 'click') AS loss, sum((event_type = 'view')::INT) AS steps FROM e GROUP BY 1) SELECT cycle::BIGINT AS cycle, rollouts, round(pass_rate, 6) AS pass_rate, round(mean_reward, 6) AS mean_reward, round(coalesce(loss, 0), 6) AS loss, coalesce(nullif(steps, 0), 0)::BIGINT AS optimizer_steps FROM r JOIN m USING (cycle)")
def curve_daily(spark, d):
    return rounded(_curve(spark, d))


def _curve(spark, d):
    e = table(spark, d, "events").withColumn("cycle", F.dayofmonth("ts"))
    r = e.select("cycle", F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("passed"))
    m = e.select("cycle", (F.col("event_type") == "view").alias("optimizer_step"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"))
    return curves.points(r, m)


@query(DAYS + ", r AS (SELECT cycle, count(*)::DOUBLE AS rollouts, avg((event_type = 'purchase')::INT) AS pass_rate, avg(value) AS mean_reward, coalesce(avg(value) FILTER (event_type = 'click'), 0) AS loss, sum((event_type = 'view')::INT)::DOUBLE AS optimizer_steps FROM e GROUP BY 1), u AS (UNPIVOT r ON rollouts, pass_rate, mean_reward, loss, optimizer_steps INTO NAME metric VALUE value) SELECT cycle::BIGINT AS cycle, metric, round(value, 6) AS value FROM u")
def curve_long_form(spark, d):
    return rounded(curves.long_form(_curve(spark, d)))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_metric_row(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.struct("ts", "event_id").alias("o"))
    return rounded(curves.last_metric(e, "o").drop("o"))


MATRIX = "WITH m AS (SELECT s.i * 16 + g.i * 8 + k.i * 4 + c.i * 2 + r.i AS ord, s.v AS seed, g.v AS group_size, k.v AS kl_beta, c.v AS curriculum_mode, r.v AS reward_name, 'g' || g.v || '_kl' || replace(k.v::VARCHAR, '.', 'p') || '_' || c.v || '_' || r.v || '_seed' || s.v AS slug FROM (VALUES (0, 1), (1, 2), (2, 3)) s(i, v), (VALUES (0, 4), (1, 8)) g(i, v), (VALUES (0, 0.02::DOUBLE), (1, 0.05::DOUBLE)) k(i, v), (VALUES (0, 'static'), (1, 'informative')) c(i, v), (VALUES (0, 'x'), (1, 'y')) r(i, v))"


def _runs(spark):
    m = experiments.matrix(spark, 10, seed=(1, 2, 3), group_size=(4, 8), kl_beta=(0.02, 0.05), curriculum_mode=("static", "informative"), reward_name=("x", "y"))
    o = F.col("ord")
    return m.withColumns({"mean_reward": F.pmod(o * 7, F.lit(11)) / 10.0, "informative": F.pmod(o, F.lit(3)) / 3.0, "with_variance": F.pmod(o, F.lit(4)) / 4.0, "pass_rate": F.pmod(o, F.lit(5)) / 5.0, "parse_failure_rate": F.pmod(o, F.lit(2)) / 2.0, "stopped_early": F.pmod(o, F.lit(7)) == 0, "rollouts": F.lit(80)})


RUNS = MATRIX + ", runs AS (SELECT *, ord * 7 % 11 / 10 AS mean_reward, ord % 3 / 3 AS informative, ord % 5 / 5 AS pass_rate, ord % 2 / 2 AS parse_failure_rate, ord % 7 = 0 AS stopped_early FROM m)"


@query(MATRIX + " SELECT ord::BIGINT AS ord, seed::BIGINT AS seed, group_size::BIGINT AS group_size, kl_beta, curriculum_mode, reward_name, 10::BIGINT AS max_steps, slug FROM m")
def experiment_matrix(spark, d):
    return rounded(experiments.matrix(spark, 10, seed=(1, 2, 3), group_size=(4, 8), kl_beta=(0.02, 0.05), curriculum_mode=("static", "informative"), reward_name=("x", "y")))


@query(RUNS + " SELECT slug, round(mean_reward, 6)::DOUBLE AS mean_reward FROM runs WHERE NOT stopped_early AND informative >= 0.3 ORDER BY mean_reward DESC, informative DESC, pass_rate DESC, parse_failure_rate, ord LIMIT 1")
def best_run(spark, d):
    return rounded(experiments.best_run(_runs(spark), least_informative=0.3).select("slug", "mean_reward"))


@query(RUNS + " SELECT group_size || '|' || kl_beta || '|' || curriculum_mode || '|' || reward_name AS variant, count(*) AS runs, round(avg(mean_reward), 6) AS mean_reward, round(avg(pass_rate), 6) AS pass_rate FROM runs GROUP BY 1")
def seed_averages(spark, d):
    return rounded(experiments.seed_averages(_runs(spark)).select("variant", "runs", "mean_reward", "pass_rate"))


@query(RUNS + " SELECT round(a.mean_reward, 6)::DOUBLE AS a_mean_reward, round(b.mean_reward, 6)::DOUBLE AS b_mean_reward, round(b.mean_reward - a.mean_reward, 6)::DOUBLE AS delta_mean_reward, true AS same_budget FROM runs a, runs b WHERE a.ord = 1 AND b.ord = 2")
def algorithm_comparison(spark, d):
    r = _runs(spark)
    return rounded(experiments.compare_algorithms(r.where("ord = 1"), r.where("ord = 2")).select("a_mean_reward", "b_mean_reward", "delta_mean_reward", "same_budget"))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean_reward FROM lineitem")
def weighted_mean_reward(spark, d):
    return rounded(experiments.weighted_mean(table(spark, d, "lineitem").select(F.col("l_discount").alias("mean_reward"), F.col("l_quantity").alias("records_used"))))


@query("WITH t AS (SELECT c_custkey, 'o/' || c_custkey AS id, c_name AS v FROM customer), s AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'o/' || o_custkey ELSE o_custkey::VARCHAR END AS key, max(o_orderpriority) AS v FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(a.v, b.v, t.v) AS public_tests FROM t LEFT JOIN s a ON a.key = t.id LEFT JOIN s b ON b.key = split_part(t.id, '/', 2)")
def sidecar_lookup(spark, d):
    tasks = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("o/"), F.col("c_custkey").cast("string")).alias("task_id"), F.col("c_name").alias("public_tests"))
    key = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("o/"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    side = table(spark, d, "orders").groupBy(key.alias("key")).agg(F.max("o_orderpriority").alias("public_tests"))
    return records.apply_sidecar(tasks, side, "task_id", ("public_tests",)).select("c_custkey", "public_tests")


SNIPPETS = [
    ("plain", "def add_one(x):\n    return x + 1\n"), ("constant", "def add_one(x):\n    return 2\n"), ("lookup", "def add_one(x):\n    if x == 1:\n        return 2\n    return 0\n"), ("empty", ""), ("none", "x = 1\n"),
    ("repeats", "\n".join(["y = 3"] * 9)), ("import", "import os.path\n"), ("reflect", "def f(o):\n    return getattr(o, '__class__')\n"), ("broken", "def f(:\n"), ("raise", "def f():\n    raise SystemExit\n"),
    ("fenced", "Sure:\n```text\nhello\n```\n```python\ndef f():\n    return 1\n```\n"), ("preamble", "Here it is: def f():\n    return eval('1')\n"),
]


def _snippets(spark):
    return spark.createDataFrame(SNIPPETS, "name string, text string")


@query("SELECT * FROM (VALUES ('plain', 'ok', 'raw'), ('constant', 'ok', 'raw'), ('lookup', 'ok', 'raw'), ('empty', 'empty', 'empty'), ('none', 'ok', 'raw'), ('repeats', 'ok', 'raw'), ('import', 'ok', 'raw'), ('reflect', 'ok', 'raw'), ('broken', 'syntax_error', 'raw'), ('raise', 'ok', 'raw'), ('fenced', 'ok', 'fenced:python:2'), ('preamble', 'ok', 'raw')) t(name, status, parser)")
def code_parse(spark, d):
    return _snippets(spark).select("name", code.extract_code("text").alias("p")).select("name", "p.status", "p.parser")


@query("SELECT * FROM (VALUES ('plain', false, false, false), ('constant', true, true, true), ('lookup', true, false, true), ('empty', true, false, false), ('none', true, false, false), ('repeats', true, false, false), ('import', true, false, false), ('reflect', false, false, false), ('broken', false, false, false), ('raise', false, false, false), ('fenced', false, false, false), ('preamble', false, false, false)) t(name, flagged, constant_entry_function, hardcoded_visible_answers)")
def hack_detection(spark, d):
    tests = F.array(F.lit("assert add_one(1) == 2"))
    return _snippets(spark).select("name", code.reward_hacking("text", F.lit("add_one"), tests).alias("r")).select("name", "r.flagged", "r.constant_entry_function", "r.hardcoded_visible_answers")


@query("SELECT * FROM (VALUES ('import', 'blocked_import'), ('reflect', 'blocked_reflection'), ('broken', 'syntax'), ('raise', 'blocked_raise'), ('fenced', 'syntax'), ('preamble', 'syntax')) t(name, rule)")
def security_scan(spark, d):
    return _snippets(spark).select("name", F.explode(code.security_findings("text")).alias("f")).select("name", "f.rule")


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def ext_rollup(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def ext_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::BIGINT AS rk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_windows(spark, d):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"), F.rank().over(p).cast("bigint").alias("rk"))


@query("SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def ext_sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def programming_tasks(spark: SparkSession, d: str) -> DataFrame:
    """part in the role of tasks: names by key, one or two assertions by size and price."""
    name = F.concat(F.lit("f_"), F.col("p_partkey").cast("string"))
    price = F.floor("p_retailprice").cast("string")
    first = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("assert "), name, F.lit("() == "), price)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("assert "), name, F.lit("("), F.col("p_size").cast("string"), F.lit(") == "), price)).otherwise(F.concat(F.lit("print("), name, F.lit("(1))")))
    tests = F.when(F.col("p_size") % 2 == 0, F.array(first)).otherwise(F.array(F.lit("self.assertEqual(1, 1)"), first))
    starter = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("def "), name, F.lit("(x):\n    pass\n"))).otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), starter.alias("starter_code"), F.when(F.col("p_size") % 4 == 0, name).otherwise("").alias("told"), tests.alias("tests"), name.alias("name"), "p_size")


PART = "WITH t AS (SELECT p_partkey AS task_id, p_name, p_size, 'f_' || p_partkey AS name, floor(p_retailprice)::BIGINT AS price FROM part), x AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'assert ' || name || '() == ' || price WHEN 1 THEN 'assert ' || name || '(' || p_size || ') == ' || price ELSE 'print(' || name || '(1))' END AS test FROM t)"


@query(PART + " SELECT task_id, name AS entry FROM x")
def entry_points(spark, d):
    return programming_tasks(spark, d).select("task_id", text.entry_point(F.col("tests"), F.col("told")).alias("entry"))


@query(
    PART
    + " SELECT task_id, CASE p_size % 3 WHEN 0 THEN 'def ' || name || '():' || chr(10) || '    return ' || price || chr(10) WHEN 1 THEN 'def ' || name || '(x):' || chr(10) || '    return x' || CASE WHEN price > p_size THEN ' + ' || (price - p_size) WHEN price < p_size THEN ' - ' || (p_size - price) ELSE '' END || chr(10) ELSE 'pass' END AS code FROM x"
)
def simple_repairs(spark, d):
    return programming_tasks(spark, d).select("task_id", code.simple_repair("name", "tests", F.lit("pass")).alias("code"))


@query(
    PART
    + ", p AS (SELECT *, 'You are a careful Python coding assistant.' || chr(10) || 'Solve the task by writing correct, executable Python code.' || chr(10) || 'Return only the final code.' || chr(10) || 'Wrap the code in a single ```python fenced block.' || chr(10) || chr(10) || 'Task:' || chr(10) || trim(p_name) || CASE WHEN p_size % 4 = 0 THEN chr(10) || chr(10) || 'Required entry point: `' || name || '`' ELSE '' END"
    + " || CASE WHEN p_size % 5 = 0 THEN chr(10) || chr(10) || 'Starter code:' || chr(10) || '```python' || chr(10) || 'def ' || name || '(x):' || chr(10) || '    pass' || chr(10) || '```' ELSE '' END AS head FROM x)"
    + " SELECT task_id, head || chr(10) AS direct, head || chr(10) || chr(10) || 'Public tests:' || chr(10) || '```python' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'self.assertEqual(1, 1)' || chr(10) END || test || chr(10) || '```' || chr(10) AS with_tests FROM p"
)
def rendered_prompts(spark, d):
    args = (F.col("prompt"), F.col("starter_code"), F.col("told"), F.col("tests"))
    return programming_tasks(spark, d).select("task_id", text.render_prompt(*args).alias("direct"), text.render_prompt(*args, "direct_solution_with_public_tests_v1").alias("with_tests"))


@query(
    "WITH x AS (SELECT role, text, " + WORDS + " AS w, " + LINES + " AS l FROM conversations), r AS (SELECT role AS value, role <> 'system' AS ok, len(w) AS n, len(w) = 0 OR (len(l) >= 4 AND len(list_distinct(l)) <= 0.5 * len(l)) OR (len(w) >= 20 AND len(list_distinct(w)) <= 0.2 * len(w)) AS bad FROM x WHERE text IS NOT NULL)"
    " SELECT value, count(*) AS rollouts, round(avg((NOT ok)::INT), 6) AS parse_failure_rate, round(avg(bad::INT), 6) AS degenerate_rate, round(avg(n), 6) AS mean_tokens, round(median(n), 6) AS median_tokens, max(n)::DOUBLE AS max_tokens FROM r GROUP BY value"
)
def eval_output_summary(spark, d):
    x = F.col("text")
    rows = table(spark, d, "conversations").where("text is not null").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("sample_index"), "role", F.when(F.col("role") == "system", "failed").otherwise("ok").alias("parse_status"), text.is_degenerate(x).alias("degenerate"), text.token_count(x).alias("tokens"), F.lit(0.0).alias("reward"), F.lit(False).alias("passed")
    )
    got = evaluate.by_fields(rows, {"role": F.col("role")}, (1,))
    return rounded(got.select("value", "rollouts", "parse_failure_rate", "degenerate_rate", "mean_tokens", "median_tokens", "max_tokens"))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_returnflag AS f FROM lineitem), y AS (SELECT *, q % 4 + 1 AS n, len(list_filter(range(1, q % 4 + 2), lambda i: (i + q) % 3 <> 0)) AS ok, q % 5 + 1 AS m, len(list_filter(range(1, q % 5 + 2), lambda i: (2 * i + q) % 3 <> 0)) AS okm FROM x)"
    " SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'public_tests ' || ok || '/' || n || CASE WHEN f = 'N' THEN '; hidden_tests ' || okm || '/' || m ELSE '' END AS outcomes, CASE f WHEN 'A' THEN 'timeout' WHEN 'R' THEN 'failed' ELSE 'passed' END AS status, CASE f WHEN 'N' THEN 4 ELSE 3 END::BIGINT AS phases FROM y"
)
def phase_outcomes(spark, d):
    ph = F.col("execution.phases")
    return rounded(executions(spark, d).select("l_orderkey", "l_linenumber", execution.outcome_summary(ph).alias("outcomes"), execution.run_status(ph).alias("status"), F.size(execution.stopped_at_first(ph)).alias("phases")))


@query("WITH x AS (SELECT *, 'def f(x):' || chr(10) || '    return ' || CASE p_size % 3 WHEN 0 THEN '7' WHEN 1 THEN 'x' ELSE 'x + 1' END || chr(10) AS code FROM part) SELECT 'scanned' AS reason, count(*) AS rollouts FROM x UNION ALL SELECT 'flagged', count(*) FROM x WHERE p_size % 3 = 0 UNION ALL SELECT 'entry function ignores its arguments (constant output)', count(*) FROM x WHERE p_size % 3 = 0")
def hacking_scan_counts(spark, d):
    body = F.when(F.col("p_size") % 3 == 0, "7").when(F.col("p_size") % 3 == 1, "x").otherwise("x + 1")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.lit(0).alias("sample_index"), F.concat(F.lit("def f(x):\n    return "), body, F.lit("\n")).alias("code"))
    tasks = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("task_id"), F.lit("f").alias("entry_point"), F.array(F.lit("assert f(1) == 2")).alias("visible_tests"))
    return execution.hacking_counts(execution.hacking_scan(rows, tasks))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, NULL::DOUBLE AS missing, json_extract_string(props, '$.k') AS copied FROM events")
def optional_fields(spark, d):
    props = F.col("props")
    return table(spark, d, "events").select("event_id", selection.optional_number(props, "k").alias("k"), selection.optional_number(props, "no.such").alias("missing"), selection.scalar_metadata(props, "m_")["m_k"].alias("copied"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def first_in_order(spark, d):
    """The limit is the operator."""
    return selection.first_rows(table(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_orderdate", "o_orderkey"], 20).select("o_orderkey", "o_orderdate")


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v, label FROM embeddings), g AS (SELECT *, 1.0 * label / 10 AS r FROM e), d AS (SELECT *, r - v[4] AS a4 FROM g), d3 AS (SELECT *, v[4] - v[3] + 0.95 * a4 AS a3 FROM d), d2 AS (SELECT *, v[3] - v[2] + 0.95 * a3 AS a2 FROM d3), d1 AS (SELECT *, v[2] - v[1] + 0.95 * a2 AS a1 FROM d2),"
    " t AS (SELECT vec_id, unnest(v) AS v, unnest([a1, a2, a3, a4]) AS a FROM d1), k AS (SELECT *, exp(0.1 * v) AS ratio, a + v AS ret FROM t), l AS (SELECT vec_id, -avg(least(ratio * a, least(greatest(ratio, 0.8), 1.2) * a)) AS pl, avg(greatest((1.5 * v - ret) ** 2, (v + least(greatest(0.5 * v, -0.2), 0.2) - ret) ** 2)) AS vl, avg(abs(v)) AS en FROM k GROUP BY vec_id)"
    " SELECT vec_id, round(pl, 6) AS policy_loss, round(0.5 * vl, 6) AS value_loss, round(-0.01 * en, 6) AS entropy_loss, round(pl + 0.5 * vl - 0.01 * en, 6) AS total_loss FROM l"
)
def critic_objective(spark, d):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", v.alias("old_values"), F.transform(v, lambda x: x * 1.5).alias("values"), F.transform(v, lambda x: x * 0.1).alias("policy"), F.transform(v, lambda x: x * 0.0).alias("old"), F.transform(v, F.abs).alias("entropy"), sequences.response_rewards(F.col("label") / 10, F.lit(None).cast("array<double>"), F.array(*map(F.lit, (0, 1, 1, 1, 1)))).alias("rewards"))
    return rounded(sequences.critic_losses(rows, entropy_coef=0.01).select("vec_id", "loss.policy_loss", "loss.value_loss", "loss.entropy_loss", "loss.total_loss"))
