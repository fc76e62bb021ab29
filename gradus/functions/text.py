"""Text functions as columns. White space is what Unicode calls so, and U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokens(x: Column) -> Column:
    """What lies between white space; an empty text has none."""
    return F.filter(F.split(x, SPACE), lambda t: t != "")


def lines(x: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(x, _LINE_END), strip), lambda t: t != "")


def normalize_prose(x: Column) -> Column:
    """Lower case; all but a-z, 0-9 and _ becomes one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9_]+", " "))


def normalize_code(x: Column) -> Column:
    """Lower case; white space becomes one space; marks stay."""
    return strip(F.regexp_replace(F.lower(x), SPACE, " "))


def snippet(x: Column, limit: int = 80) -> Column:
    flat = F.array_join(tokens(x), " ")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def repeated_line_fraction(x: Column) -> Column:
    found = lines(x)
    return F.when(F.size(found) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(found)) / F.size(found))


def is_degenerate(x: Column, code: Column | None = None) -> Column:
    """Blank, or at least 4 lines half of which repeat others, or at least 20 tokens of which
    at most a fifth are different. Lines are those of the code, tokens those of the whole completion x;
    either may be blank."""
    code = x if code is None else code
    ls, ts = lines(F.coalesce(code, F.lit(""))), tokens(F.coalesce(x, F.lit("")))
    return (
        (F.size(ts) == 0)
        | (F.size(ls) == 0)
        | ((F.size(ls) >= 4) & (F.size(F.array_distinct(ls)) <= 0.5 * F.size(ls)))
        | ((F.size(ts) >= 20) & (F.size(F.array_distinct(ts)) <= 0.2 * F.size(ts)))
    )


def token_count(x: Column, told: Column | None = None) -> Column:
    """The count that metadata tells, at least 0, else the number of tokens."""
    counted = F.size(tokens(F.coalesce(x, F.lit(""))))
    return counted if told is None else F.coalesce(F.greatest(F.lit(0), told.cast("int")), counted)


def quality_score(x: Column, valid: Column) -> Column:
    """1, less 0.15 for a line of over 100 characters, 0.2 for over 120 lines and 0.2 for over 8000 characters; 0 if not valid."""
    n_lines, longest = F.size(lines(x)), F.coalesce(F.array_max(F.transform(F.split(x, _LINE_END), lambda t: F.length(t))), F.lit(0))
    score = 1.0 - F.when(longest > 100, 0.15).otherwise(0.0) - F.when(n_lines > 120, 0.2).otherwise(0.0) - F.when(F.length(x) > 8000, 0.2).otherwise(0.0)
    return F.when(valid, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def quality(x: Column, valid: Column) -> Column:
    """Lines, lines that aren't blank, characters, the longest line, and the score of code; valid tells whether it parses."""
    every = F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, r"(?:\r\n|[\n\r])$", ""), _LINE_END))
    return F.struct(valid.alias("syntax_valid"), F.size(every).alias("line_count"), F.size(lines(x)).alias("non_empty_line_count"), F.length(x).alias("char_count"), F.coalesce(F.array_max(F.transform(every, F.length)), F.lit(0)).alias("max_line_length"), quality_score(x, valid).alias("quality_score"))


def scoped_id(source: Column, raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit("/")), raw).otherwise(F.concat(source, F.lit("/"), raw))


def unscoped_id(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def entry_point(tests: Column, fallback: Column | None = None) -> Column:
    """Name that the first test with a call to offer calls: what it asserts, or else the first name called
    that isn't one of NOT_ENTRY. A fallback that isn't empty comes first."""
    asserted = lambda t: F.nullif(F.regexp_extract(t, _ASSERTED, 1), F.lit(""))
    called = lambda t: F.get(F.filter(F.regexp_extract_all(t, F.lit(_CALLED), F.lit(1)), lambda n: ~n.isin(*NOT_ENTRY)), F.lit(0))
    found = F.get(F.filter(F.transform(tests, lambda t: F.coalesce(asserted(t), called(t))), lambda n: n.isNotNull()), F.lit(0))
    return found if fallback is None else F.coalesce(F.nullif(fallback, F.lit("")), found)


#: What a called name looks like, and called names that are no entry point (fixed values).
_ASSERTED = r"assert\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
_CALLED = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
NOT_ENTRY = ("assertEqual", "assertTrue", "assertFalse", "print", "range")


def hidden_name(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit("public")), F.regexp_replace(x, "^public", "hidden")).otherwise(F.lit("hidden"))


def string_list(x: Column) -> Column:
    """Null: none; else the entries that aren't blank."""
    return F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda t: strip(t) != "")


def join_nonempty(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda t: t.isNotNull() & (t != "")), "\n")


def truncate(x: Column, limit: int = 12_000) -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit("\n...<truncated>...")))


def last_line(x: Column) -> Column:
    """The last line of the stripped text, with its own indent."""
    return F.coalesce(F.try_element_at(F.split(strip(x), _LINE_END), F.lit(-1)), F.lit(""))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def short_number(x: Column) -> Column:
    """A number as %g writes it, for moderate sizes: no trailing zeros, no point without digits."""
    fixed = F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"0+$", "")
    return F.regexp_replace(fixed, r"\.$", "")


def fenced_blocks(x: Column) -> Column:
    """(lang, code) of blocks between fences; Python or unnamed ones if there are any, else all."""
    found = F.transform(
        F.regexp_extract_all(x, F.lit(r"(?s)```[A-Za-z0-9_+-]*\s*\n.*?```"), F.lit(0)),
        lambda b: F.struct(F.lower(F.regexp_extract(b, r"^```([A-Za-z0-9_+-]*)", 1)).alias("lang"), F.regexp_extract(b, r"(?s)^```[A-Za-z0-9_+-]*\s*\n(.*?)```", 1).alias("code")),
    )
    python = F.filter(found, lambda b: b["lang"].isin("python", "py", ""))
    return F.when(F.size(python) > 0, python).otherwise(found)


def after_preamble(x: Column) -> Column:
    """The text from the first word that begins Python code on."""
    s = strip(x)
    at = F.least(*(F.when(F.instr(s, w) > 0, F.instr(s, w)) for w in ("def ", "class ", "import ", "from ")))
    return F.when(at.isNotNull(), F.substring(s, at, F.length(s))).otherwise(s)


#: Templates by name: whether they show public tests, and ask for a code fence (fixed values).
TEMPLATES = {"direct_solution_v1": (False, True), "direct_solution_with_public_tests_v1": (True, True)}
REVISION_TEMPLATES = {"self_debug_revision_v1": (True, True)}
#: What prompts say (fixed values).
SOLVE = ("You are a careful Python coding assistant.", "Solve the task by writing correct, executable Python code.", "Return only the final code.")
SOLVE_FENCED = "Wrap the code in a single ```python fenced block."
REVISE = ("You are revising a Python solution after public-test feedback.", "Return a complete corrected solution, not a patch.", "Do not mention the debugging process.")
REVISE_FENCED = "Wrap the revised code in a single ```python fenced block."
NO_FEEDBACK = "public tests failed"


def template(name: str, known: dict[str, tuple[bool, bool]] = TEMPLATES) -> tuple[bool, bool]:
    if name not in known:
        raise ValueError(f"unknown prompt template {name!r}; available: {', '.join(sorted(known))}")
    return known[name]


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _block(head: str, x: Column, asked: Column | bool) -> Column:
    return F.when(F.lit(asked) if isinstance(asked, bool) else asked, F.concat_ws("\n", F.lit(""), F.lit(head), F.lit("```python"), x, F.lit("```")))


def _about(prompt: Column, starter: Column, entry: Column, public_tests: Column, shows_tests: bool) -> list[Column]:
    """The task's part of a prompt; null where a task has nothing to say."""
    tests = F.coalesce(public_tests, F.array().cast("array<string>"))
    return [
        F.concat_ws("\n", F.lit(""), F.lit("Task:"), strip(prompt)),
        F.when(_filled(entry), F.concat(F.lit("\nRequired entry point: `"), entry, F.lit("`"))),
        _block("Starter code:", strip(starter), _filled(strip(F.coalesce(starter, F.lit(""))))),
        _block("Public tests:", F.array_join(F.transform(tests, strip), "\n"), (F.size(tests) > 0) & F.lit(shows_tests)),
    ]


def render_prompt(prompt: Column, starter: Column, entry: Column, public_tests: Column, name: str = "direct_solution_v1") -> Column:
    """Prompt of a task by a named template, from what the model may see."""
    shows_tests, fenced = template(name)
    said = [*SOLVE, *([SOLVE_FENCED] if fenced else [])]
    return F.concat(strip(F.concat_ws("\n", *map(F.lit, said), *_about(prompt, starter, entry, public_tests, shows_tests))), F.lit("\n"))


def revision_prompt(prompt: Column, starter: Column, entry: Column, public_tests: Column, code: Column, observation: Column, turn: Column, name: str = "self_debug_revision_v1") -> Column:
    """Prompt of a revision: the task, the code so far, and what its public tests said."""
    shows_tests, fenced = template(name, REVISION_TEMPLATES)
    said = [*REVISE, *([REVISE_FENCED] if fenced else [])]
    seen = F.when(_filled(strip(F.coalesce(observation, F.lit("")))), strip(observation)).otherwise(NO_FEEDBACK)
    parts = [F.concat(F.lit("\nRevision attempt: "), turn.cast("string")), *_about(prompt, starter, entry, public_tests, shows_tests), _block("Current code:", strip(code), True), F.concat(F.lit("\nPublic-test feedback:\n"), seen)]
    return F.concat(strip(F.concat_ws("\n", *map(F.lit, said), *parts)), F.lit("\n"))
