"""Rewards of executed completions, as columns over the nested column `execution`.

execution is struct<status, passed, duration_seconds, phases: array<struct<name, status, tests_run,
test_outcomes: array<struct<name, status>>>>>.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXECUTION = (
    "struct<status:string,passed:boolean,duration_seconds:double,phases:array<struct<name:string,status:string,duration_seconds:double,tests_run:int,"
    "test_outcomes:array<struct<name:string,status:string,error:string>>>>>"
)

#: Weights, penalties and modes of the reward schemes (fixed values).
WEIGHTS = {"syntax_and_import_success": 0.20, "public_test_fraction": 0.30, "hidden_test_fraction": 0.40, "robustness_test_fraction": 0.10}
PARTIAL = {"syntax_success": 0.10, "import_success": 0.10, "public_test_fraction": 0.40, "hidden_test_fraction": 0.40}
PENALTIES = {"syntax_error": -0.25, "unsafe_code": -1.00, "timeout": -0.50, "runtime_error": -0.20}
MODES = ("binary_all_tests_pass", "fractional_pass_rate", "partial_credit")
#: Of several outcomes the first of these that occurs is the phase's (fixed values).
STATUS_ORDER = ("timeout", "security_rejected", "parse_error", "runtime_error", "failed", "skipped", "passed")


PHASES = ("syntax", "import", "public_tests", "hidden_tests", "robustness_tests")


def phase(e: Column, name: str) -> Column:
    return F.get(F.filter(e["phases"], lambda p: p["name"] == name), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used: the optimizer pastes
    projections into one another, but not into a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _flat(p: Column) -> Column:
    """What scoring needs of a phase; ran counts tests that weren't skipped."""
    count = lambda keep: F.greatest(F.lit(0), F.coalesce(F.size(F.filter(p["test_outcomes"], keep)), F.lit(0)))
    return F.struct(p["name"].alias("name"), p["status"].alias("status"), p["tests_run"].alias("tests_run"), count(lambda o: o["status"] != "skipped").alias("ran"), count(lambda o: o["status"] == "passed").alias("ok"))


def outline(e: Column) -> Column:
    """status and passed of an execution, and by name what _flat() says of its phases (null: none). Lambdas
    end here: scores are plain expressions of this."""

    def named(ps: Column) -> Column:
        has = lambda s: F.coalesce(F.exists(ps, lambda p: p["status"] == s), F.lit(False))
        at = lambda name: F.get(F.filter(ps, lambda p: p["name"] == name), F.lit(0)).alias(name)
        return F.struct(e["status"].alias("status"), F.coalesce(e["passed"], F.lit(False)).alias("passed"), has("timeout").alias("timeout"), has("runtime_error").alias("runtime_error"), *map(at, PHASES))

    return bound(F.transform(e["phases"], _flat), named)


def outlined(e: Column, use: Callable[[Column], Column]) -> Column:
    """use(outline of an execution), with the outline computed once."""
    return bound(outline(e), use)


def scored(df: DataFrame, schemes: dict[str, Callable[[Column], Column]], execution: str = "execution") -> DataFrame:
    """df with a column for each scheme, a function of outlines. The outline is a column of its own, which the
    optimizer doesn't paste into its many uses, so that these are compiled."""
    made = df.withColumn("__outline", outline(F.col(execution)))
    return made.select(*(F.col(f"`{c}`") for c in df.columns), *(f(F.col("__outline")).alias(n) for n, f in schemes.items()))


def _penalties(o: Column, off: tuple[str, ...], values: dict[str, float]) -> list[tuple[str, Column, float]]:
    when = {"syntax_error": o["status"] == "parse_error", "unsafe_code": o["status"] == "security_rejected", "timeout": o["timeout"], "runtime_error": o["runtime_error"]}
    return [(n, F.coalesce(c, F.lit(False)), values[n]) for n, c in when.items() if n not in off]


def _named(pens: list[tuple[str, Column, float]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))) for n, c, v in pens)))


def penalties(e: Column, off: tuple[str, ...] = (), values: dict[str, float] = PENALTIES) -> Column:
    """Names and values of the penalties that apply."""
    return outlined(e, lambda o: _named(_penalties(o, off, values)))


def _scored(rows: list[tuple[str, Column, float, Column]], pens: list[tuple[str, Column, float]], normalize: bool, low: float, high: float) -> Column:
    """rows: name, value, weight and availability of components. With normalize, weights of what isn't available go to the rest."""
    whole = F.greatest(sum((F.when(a, w).otherwise(0.0) for _, _, w, a in rows), F.lit(0.0)), F.lit(1e-300)) if normalize else F.lit(1.0)
    parts = [(n, v, F.when(a, w / whole).otherwise(float(w)), F.when(a, v * (w / whole)).otherwise(0.0), a) for n, v, w, a in rows]
    components = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), w.alias("weight"), x.alias("weighted_value"), a.alias("available")) for n, v, w, x, a in parts))
    before = sum((x for _, _, _, x, _ in parts), F.lit(0.0))
    minus = sum((F.when(c, v).otherwise(0.0) for _, c, v in pens), F.lit(0.0))
    reward = F.greatest(F.lit(low), F.least(F.lit(high), before + minus))
    return F.struct(reward.alias("reward"), before.alias("score_before_penalty"), minus.alias("total_penalty"), components.alias("components"), _named(pens).alias("penalties"))


def _passed(p: Column) -> Column:
    return F.coalesce(p["status"] == "passed", F.lit(False))


def _fraction(p: Column) -> Column:
    """Share of tests passed, of those not skipped; without tests, whether the phase passed."""
    return F.when(p["status"].isNull() | (p["status"] == "skipped"), 0.0).when(p["ran"] > 0, p["ok"] / p["ran"]).otherwise(_passed(p).cast("double"))


def _available(p: Column) -> Column:
    return F.coalesce((p["status"] != "skipped") & (p["tests_run"] > 0), F.lit(False))


def correctness_of(o: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted fractions of phases of an outline; weights of what isn't available go to the rest."""
    both = (_passed(o["syntax"]) & _passed(o["import"])).cast("double")
    rows = [("syntax_and_import_success", both, weights["syntax_and_import_success"], F.lit(True))]
    rows += [(f"{n}_test_fraction", _fraction(o[f"{n}_tests"]), weights[f"{n}_test_fraction"], _available(o[f"{n}_tests"])) for n in ("public", "hidden", "robustness")]
    return _scored(rows, _penalties(o, (), PENALTIES), True, -1.0, 1.0)


def correctness(e: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return outlined(e, lambda o: correctness_of(o, weights))


def _pooled(o: Column) -> Column:
    """Share of all public and hidden tests passed; without outcomes the mean of available phases,
    without these whether the run passed."""
    both = (o["public_tests"], o["hidden_tests"])
    ran, ok = (sum((F.coalesce(p[c], F.lit(0)) for p in both), F.lit(0)) for c in ("ran", "ok"))
    n = sum((_available(p).cast("int") for p in both), F.lit(0))
    mean = sum((F.when(_available(p), _fraction(p)).otherwise(0.0) for p in both), F.lit(0.0)) / F.greatest(n, F.lit(1))
    return F.when(ran > 0, ok / ran).when(n > 0, mean).otherwise(o["passed"].cast("double"))


def pooled_fraction(e: Column) -> Column:
    return outlined(e, _pooled)


@dataclass(frozen=True)
class Mode:
    """A reward scheme by name, with optional shaping; a builder of columns."""

    mode: str = "partial_credit"
    compile_bonus: float = 0.0
    length_penalty: float = 0.0
    off: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: dict(PARTIAL))
    low: float = -1.0
    high: float = 1.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown reward mode: {self.mode}")
        if min(self.compile_bonus, self.length_penalty, *self.weights.values()) < 0 or self.low > self.high:
            raise ValueError("weights and shaping can't be negative, nor low above high")

    def __call__(self, e: Column, code: Column | None = None) -> Column:
        return outlined(e, lambda o: self.of(o, code))

    def of(self, o: Column, code: Column | None = None) -> Column:
        """The score of an outline; several schemes can share one."""
        if self.mode == "binary_all_tests_pass":
            rows = [("all_tests_pass", o["passed"].cast("double"), 1.0, F.lit(True))]
        elif self.mode == "fractional_pass_rate":
            rows = [("test_pass_fraction", _pooled(o), 1.0, F.lit(True))]
        else:
            w = self.weights
            rows = [(f"{n}_success", _passed(o[n]).cast("double"), w[f"{n}_success"], o[n].isNotNull()) for n in ("syntax", "import")]
            rows += [(f"{n}_test_fraction", _fraction(o[f"{n}_tests"]), w[f"{n}_test_fraction"], _available(o[f"{n}_tests"])) for n in ("public", "hidden")]
        if self.compile_bonus:
            rows.append(("compile_success_bonus", _passed(o["syntax"]).cast("double"), self.compile_bonus, F.lit(True)))
        if self.length_penalty and code is not None:
            rows.append(("length_penalty", -F.length(code) / 1000, self.length_penalty, F.length(code) > 0))
        return _scored(rows, _penalties(o, self.off, PENALTIES), False, self.low, self.high)


def scorer(name: str = "correctness", **options) -> Callable[[Column], Column]:
    """A scheme for scored() by name: correctness, or one of MODES with its options."""
    if name == "correctness":
        return lambda o: correctness_of(o, **options)
    return Mode(name, **options).of


def revision_discount(reward: Column, revisions: Column, discount: float = 1.0, mode: str = "positive_only", step_penalty: float = 0.0) -> Column:
    """Final reward of a self-repair run: times discount for each revision, less a penalty for each."""
    factor = F.pow(F.lit(discount), revisions)
    if mode not in ("none", "all", "positive_only"):
        raise ValueError(f"unknown discount mode: {mode}")
    scaled = {"none": reward, "all": reward * factor, "positive_only": F.when(reward > 0, reward * factor).otherwise(reward)}[mode]
    return F.struct((scaled - step_penalty * revisions).alias("reward"), reward.alias("undiscounted"), scaled.alias("before_penalty"), factor.alias("factor"), (step_penalty * revisions).alias("penalty"))


def efficiency(e: Column, reference_seconds: float | None) -> Column:
    """Logarithm of reference over run time, within -1 and 1, of passed runs; and whether a phase timed out."""
    ran = F.coalesce(e["passed"], F.lit(False)) & (e["duration_seconds"] > 0) & F.lit(bool(reference_seconds))
    score = F.when(ran, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(F.lit(float(reference_seconds or 1)) / F.when(ran, e["duration_seconds"])))))
    return F.struct(F.exists(e["phases"], lambda p: p["status"] == "timeout").alias("timeout"), score.alias("relative_runtime_score"))


def fold_status(statuses: Column) -> Column:
    """The phase's status: the gravest of its tests'; passed without tests."""
    order = F.array(*map(F.lit, STATUS_ORDER))
    gravest = F.array_min(F.transform(statuses, lambda s: F.array_position(order, s)))
    return F.coalesce(F.try_element_at(order, gravest.cast("int")), F.lit("passed"))


def final_status(e: Column, include_hidden: bool = True) -> Column:
    """The public phase's status unless it passed; then the hidden one's, if asked for."""
    public, hidden = phase(e, "public_tests"), phase(e, "hidden_tests")
    after = F.coalesce(hidden["status"], public["status"]) if include_hidden else public["status"]
    return F.when(public["status"] != "passed", public["status"]).otherwise(after)
