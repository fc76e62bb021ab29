"""Readers and writers of task, rollout, trace and metric records.

Records keep their place in the file, as (path, line), since results depend on the order of records.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.text import entry_point, scoped_id, string_list, strip
from gradus.operators.rewards import EXECUTION
from gradus.operators.splits import SPLITS, require_unique

TEST = "struct<name:string,code:string,visibility:string,kind:string>"
TASK = f"task_id string, source string, prompt string, split string, entry_point string, starter_code string, public_tests array<{TEST}>, hidden_tests array<{TEST}>, tags array<string>, resource_limits struct<timeout_seconds:double,memory_mb:int>, metadata map<string,string>"
ROLLOUT = f"task_id string, sample_index int, prompt_template string, prompt string, raw_completion string, parsed struct<code:string,status:string,parser:string,error:string>, backend string, model_name string, generation_metadata variant, execution {EXECUTION}, reward struct<reward:double,score_before_penalty:double,total_penalty:double,metrics:variant>, metadata variant"
TRACE = "task_id string, prompt_template string, prompt string, raw_completion string, initial_code string, final_code string, steps array<struct<kind:string,code:string,parsed_status:string,observation:string,tool_result:variant,metadata:variant>>, final_result variant, final_reward variant, metadata variant"
#: Keys under which a file may wrap its records, the first list-valued one counts (fixed values).
ENVELOPES = ("tasks", "data", "items", "examples", "problems")
#: Layouts of task files that read_source knows.
LAYOUTS = ("tasks", "mbpp", "humaneval")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Records of a JSONL file or folder with ord, their place. Blank lines don't count; a line that isn't
    JSON, or lacks a required key, fails the query and is named."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ord")).where(strip(F.col("value")) != "")
    parsed = rows.select("ord", "path", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "value")
    for key in required:
        parsed = parsed.where(F.coalesce(F.col(f"r.{key}").isNotNull(), F.lit(False)) | F.raise_error(F.concat(F.lit(f"no {key} in a record of "), F.col("path"), F.lit(": "), F.col("value"))).isNotNull())
    return parsed.select("r.*", "ord")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, also of one JSON document: a list, a record, or records under a key of ENVELOPES."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    whole = spark.read.text(path, wholetext=True)
    doc = F.parse_json("value")
    lists = [F.try_variant_get(doc, "$", "array<variant>"), *(F.try_variant_get(doc, f"$.{k}", "array<variant>") for k in ENVELOPES)]
    items = F.coalesce(*lists, F.array(doc))
    out = whole.select(F.posexplode(items).alias("ord", "v")).select(F.from_json(F.to_json("v"), schema).alias("r"), F.col("ord").cast("long"))
    return out.select("r.*", "ord")


def tasks_from(frame: DataFrame) -> DataFrame:
    """Defaults of missing fields; visibility of tests by the array they lie in; checks of domains."""
    def tests(name: str, visibility: str) -> Column:
        none = F.array().cast(f"array<{TEST}>")
        return F.transform(F.coalesce(name, none), lambda t: F.struct(F.coalesce(t["name"], F.lit("test")).alias("name"), t["code"].alias("code"), F.lit(visibility).alias("visibility"), F.coalesce(t["kind"], F.lit("unit")).alias("kind")))

    limits = F.struct(F.coalesce("resource_limits.timeout_seconds", F.lit(2.0)).alias("timeout_seconds"), F.coalesce("resource_limits.memory_mb", F.lit(256)).alias("memory_mb"))
    blank = [F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} is blank")) for c in ("task_id", "source", "prompt")]
    wrong = F.coalesce(*blank, F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.concat(F.lit("unknown split "), F.coalesce("split", F.lit("null")))))
    checked = frame.where(wrong.isNull() | F.raise_error(wrong).isNotNull())
    return checked.select(
        "task_id", "source", "prompt", "split", "entry_point", F.coalesce("starter_code", F.lit("")).alias("starter_code"), tests("public_tests", "public").alias("public_tests"), tests("hidden_tests", "hidden").alias("hidden_tests"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), limits.alias("resource_limits"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "ord",
    )


def read_tasks(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    tasks = tasks_from(read_records(spark, path, TASK))
    return require_unique(tasks) if unique else tasks


def _tests(codes: Column, visibility: str, prefix: str) -> Column:
    named = F.transform(codes, lambda c, i: F.struct(F.concat(F.lit(f"{prefix}-"), (i + 1).cast("string")).alias("name"), c.alias("code"), F.lit(visibility).alias("visibility"), F.lit("unit").alias("kind")))
    return F.filter(named, lambda t: strip(t["code"]) != "")


MBPP = "task_id string, text string, prompt string, test_list array<string>, challenge_test_list array<string>, starter_code string, tags array<string>, code string, difficulty string, entry_point string"
HUMANEVAL = "task_id string, prompt string, entry_point string, public_tests array<string>, visible_tests array<string>, example_tests array<string>, hidden_tests array<string>, tests array<string>, test_list array<string>, test string, canonical_solution string, difficulty string, starter_code string, tags array<string>"


def _metadata(**columns: str) -> Column:
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in columns.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def read_mbpp(spark: SparkSession, path: str, split: str = "train", source: str = "mbpp", public: int = 1) -> DataFrame:
    """Tasks of records that list assertions: the first ones public, the rest and the challenges hidden."""
    r = read_records(spark, path, MBPP)
    listed, extra = string_list(F.col("test_list")), string_list(F.col("challenge_test_list"))
    hidden = F.concat(F.slice(listed, public + 1, F.greatest(F.size(listed), F.lit(1))), extra)
    prompt = F.coalesce("text", "prompt")
    raw = F.coalesce("task_id", F.col("ord").cast("string"))
    tasks = r.select(
        scoped_id(F.lit(source), raw).alias("task_id"), F.lit(source).alias("source"), F.coalesce(prompt, F.raise_error(F.concat(F.lit("no prompt in task "), raw)).cast("string")).alias("prompt"), F.lit(split).alias("split"),
        entry_point(F.concat(listed, extra), F.col("entry_point")).alias("entry_point"), "starter_code", _tests(F.slice(listed, 1, public), "public", "public").alias("public_tests"), _tests(hidden, "hidden", "hidden").alias("hidden_tests"),
        "tags", F.lit(None).cast("struct<timeout_seconds:double,memory_mb:int>").alias("resource_limits"), _metadata(reference_solution="code", difficulty="difficulty").alias("metadata"), "ord",
    )
    return tasks_from(tasks)


def call_check(test: Column, entry: Column) -> Column:
    """Test code that defines check(candidate) without calling it gets the call."""
    return F.when(F.contains(test, F.lit("def check(")) & ~F.contains(test, F.concat(F.lit("check("), entry, F.lit(")"))) & (F.coalesce(entry, F.lit("")) != ""), F.concat(F.regexp_replace(test, r"\s+$", ""), F.lit("\n\ncheck("), entry, F.lit(")"))).otherwise(test)


def read_humaneval(spark: SparkSession, path: str, split: str = "test_public", source: str = "humaneval") -> DataFrame:
    """Tasks of records with a prompt, an entry point and test code in one of several places."""
    r = read_records(spark, path, HUMANEVAL)
    full = lambda c: F.when(F.size(string_list(F.col(c))) > 0, string_list(F.col(c)))
    none = F.array().cast("array<string>")
    public = F.coalesce(full("public_tests"), full("visible_tests"), full("example_tests"), none)
    hidden = F.concat(*(string_list(F.col(c)) for c in ("hidden_tests", "tests", "test_list")), F.when(strip(F.coalesce("test", F.lit(""))) != "", F.array(call_check(F.col("test"), F.col("entry_point")))).otherwise(none))
    tasks = r.select(
        scoped_id(F.lit(source), F.coalesce("task_id", F.col("ord").cast("string"))).alias("task_id"), F.lit(source).alias("source"), "prompt", F.lit(split).alias("split"), "entry_point", "starter_code", _tests(public, "public", "public").alias("public_tests"),
        _tests(hidden, "hidden", "hidden").alias("hidden_tests"), "tags", F.lit(None).cast("struct<timeout_seconds:double,memory_mb:int>").alias("resource_limits"), _metadata(reference_solution="canonical_solution", difficulty="difficulty").alias("metadata"), "ord",
    )
    return tasks_from(tasks)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """key, public_tests, hidden_tests of extra tests, from an object by task or from records. Tests are
    code or objects; both arrays are always there."""
    doc = spark.read.text(path, wholetext=not path.endswith(".jsonl")).where(strip(F.col("value")) != "").select(F.parse_json("value").alias("d"))
    records = doc.where(F.try_variant_get("d", "$.task_id", "string").isNotNull() | F.try_variant_get("d", "$", "array<variant>").isNotNull()).select(F.explode(F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.array("d"))).alias("v")).select(F.try_variant_get("v", "$.task_id", "string").alias("key"), "v")
    by_key = doc.where(F.try_variant_get("d", "$.task_id", "string").isNull() & F.try_variant_get("d", "$", "array<variant>").isNull()).select(F.explode(F.try_variant_get("d", "$", "map<string,variant>")).alias("key", "v"))

    def tests(names: tuple[str, ...], visibility: str) -> Column:
        found = F.coalesce(*(F.try_variant_get("v", f"$.{n}", "array<variant>") for n in names), F.array().cast("array<variant>"))
        made = F.transform(found, lambda t, i: F.struct(F.coalesce(F.try_variant_get(t, "$.name", "string"), F.concat(F.lit(f"{visibility}-"), (i + 1).cast("string"))).alias("name"), F.coalesce(F.try_variant_get(t, "$.code", "string"), F.try_variant_get(t, "$", "string")).alias("code"), F.lit(visibility).alias("visibility"), F.coalesce(F.try_variant_get(t, "$.kind", "string"), F.lit("unit")).alias("kind")))
        return F.filter(made, lambda t: strip(F.coalesce(t["code"], F.lit(""))) != "")

    return records.unionByName(by_key).select("key", tests(("public_tests",), "public").alias("public_tests"), tests(("hidden_tests", "tests"), "hidden").alias("hidden_tests"))


def apply_sidecar(tasks: DataFrame, sidecar: DataFrame, id_column: str = "task_id", columns: tuple[str, ...] = ("public_tests", "hidden_tests")) -> DataFrame:
    """tasks with the tests of the sidecar entry for the whole id, or else for what follows its last
    slash. An entry replaces both arrays: one with hidden tests only erases the public ones."""
    entry = F.struct(*columns)
    a = sidecar.select(F.col("key").alias("__ka"), entry.alias("__a"))
    b = sidecar.select(F.col("key").alias("__kb"), entry.alias("__b"))
    joined = tasks.join(a, tasks[id_column] == F.col("__ka"), "left").join(b, F.substring_index(tasks[id_column], "/", -1) == F.col("__kb"), "left")
    found = F.coalesce("__a", "__b")
    return joined.withColumns({c: F.when(found.isNotNull(), found[c]).otherwise(tasks[c]) for c in columns}).drop("__ka", "__kb", "__a", "__b")


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ROLLOUT, ("task_id", "sample_index", "raw_completion", "parsed"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TRACE, ("task_id",))


def flat_rollouts(rollouts: DataFrame) -> DataFrame:
    """The columns that summaries need."""
    return rollouts.select("task_id", "sample_index", F.coalesce("execution.passed", F.lit(False)).alias("passed"), F.coalesce("reward.reward", F.lit(0.0)).alias("reward"), F.col("raw_completion").alias("text"), "metadata", "ord")


def labelled_path(value: str) -> tuple[str, str]:
    """label and path of LABEL=PATH; without a label the file's name without its suffix."""
    label, eq, path = value.partition("=")
    if not eq:
        return Path(value).stem, value
    if not label.strip():
        raise ValueError(f"an empty label: {value}")
    return label.strip(), path


def read_labelled(spark: SparkSession, values: list[str], most: int | None = None) -> DataFrame:
    """Rollouts of files given as LABEL=PATH, with label; of each file the first ones, if a limit is given."""
    if not values:
        raise ValueError("no files")
    paths: dict[str, str] = {}
    for label, path in map(labelled_path, values):
        if label in paths:
            raise ValueError(f"the label {label} repeats")
        paths[label] = path
    parts = [read_rollouts(spark, p).withColumn("label", F.lit(n)) for n, p in paths.items()]
    return reduce(DataFrame.unionByName, parts if most is None else [p.orderBy("ord").limit(most) for p in parts])


def read_object(path: str) -> dict:
    """One JSON object of a small file; empty if there is no such file, or if it holds something else."""
    if not Path(path).exists():
        return {}
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return found if isinstance(found, dict) else {}


def read_source(spark: SparkSession, path: str, layout: str = "tasks", split: str | None = None, source: str | None = None, public: int = 1, sidecar: str | None = None) -> DataFrame:
    """Tasks of a file in one of LAYOUTS, all in one split if one is given, with the tests of a sidecar."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; known: {', '.join(LAYOUTS)}")
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {', '.join(SPLITS)}")
    if layout == "mbpp":
        tasks = read_mbpp(spark, path, split or "train", source or layout, public)
    elif layout == "humaneval":
        tasks = read_humaneval(spark, path, split or "test_public", source or layout)
    else:
        tasks = read_tasks(spark, path)
        tasks = tasks if split is None else tasks.withColumn("split", F.lit(split))
    return tasks if sidecar is None else apply_sidecar(tasks, read_sidecar(spark, sidecar))


def write_jsonl(df: DataFrame, path: str, order: str | None = "ord", mode: str = "overwrite") -> None:
    """One object a line with sorted keys; in order, if one is given. Variants are written as JSON."""
    out = df.orderBy(order).drop(order) if order and order in df.columns else df
    out.select(*sorted(out.columns)).write.mode(mode).json(path)


def read_cycles(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Records of the files of that name in the folder's cycle_* children, with cycle, by name."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=name.endswith(".json"))
    at = F.regexp_extract("_metadata.file_path", r"cycle_(\d+)/[^/]*$", 1).cast("int")
    return text.where(strip(F.col("value")) != "").select(at.alias("cycle"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).where("cycle is not null").select("cycle", "r.*")


def glob_pattern(pattern: str) -> str:
    """A regular expression for a glob whose * also crosses slashes."""
    out = ""
    for part in re.findall(r"\[[^\]]+\]|.", pattern, re.S):
        out += {"*": ".*", "?": "."}.get(part) or (part.replace("[!", "[^") if len(part) > 1 else re.escape(part))
    return f"^(?s:{out})$"


def artifacts(spark: SparkSession, root: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), bytes and sha256 of files that match; what is excluded isn't read. Spark's readers
    pass over names that begin with _ or a dot; plans.manifest.files lists these too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Path(root).resolve().as_posix() if "://" not in root else root.rstrip("/")
    path = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    hit = lambda globs: sum((F.when(path.rlike(glob_pattern(g)), 1).otherwise(0) for g in globs), F.lit(0)) > 0
    return files.where(hit(include) & ~hit(exclude)).select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


# Configuration files: read on the driver.
def load_config(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    value = json.loads(text) if path.endswith(".json") else parse_yaml(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    known = {"true": True, "false": False, "null": None, "none": None, "~": None, "": None}
    if s.lower() in known:
        return known[s.lower()]
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def parse_yaml(text: str) -> dict:
    """A small part of YAML: mappings and lists by indents of two spaces, inline lists, scalars, comments."""
    rows = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#(?=([^\"']*[\"'][^\"']*[\"'])*[^\"']*$).*$", "", raw).rstrip()
        if line.strip():
            depth = len(line) - len(line.lstrip(" "))
            if depth % 2 or "\t" in line[:depth]:
                raise ValueError(f"line {n}: indents are of two spaces")
            rows.append((depth, line.strip(), n))

    def block(at: int, depth: int):
        out = [] if rows[at][1].startswith("-") else {}
        while at < len(rows) and rows[at][0] == depth:
            _, line, n = rows[at]
            inner = at + 1 < len(rows) and rows[at + 1][0] > depth
            if isinstance(out, list):
                if not line.startswith("-"):
                    raise ValueError(f"line {n}: an item of a list is expected")
                rest = line[1:].strip()
                if rest and re.match(r"[\w.-]+:(\s|$)", rest):
                    rows[at] = (depth + 2, rest, n)
                    value, at = block(at, depth + 2)
                elif rest:
                    value, at = _scalar(rest), at + 1
                else:
                    value, at = block(at + 1, rows[at + 1][0]) if inner else (None, at + 1)
                out.append(value)
            else:
                key, colon, rest = line.partition(":")
                if not colon:
                    raise ValueError(f"line {n}: a key is expected")
                if rest.strip():
                    out[key.strip()], at = _scalar(rest), at + 1
                else:
                    out[key.strip()], at = block(at + 1, rows[at + 1][0]) if inner else (None, at + 1)
        if at < len(rows) and rows[at][0] > depth:
            raise ValueError(f"line {rows[at][2]}: unexpected indent")
        return out, at

    return block(0, rows[0][0])[0] if rows else {}


def config_get(config: dict, path: str, default=None):
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config
