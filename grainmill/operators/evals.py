"""Evaluation lines as prompts, metrics as rows, names and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def answer_index(key: Column) -> Column:
    """A digit counts from 1, a letter from A."""
    return F.when(key.rlike("^[0-9]+$"), key.try_cast("long") - 1).otherwise((F.ascii(key) - 65).cast("long"))


#: Line to question, choices and gold index, by task family.
ADAPTERS = {
    "arc": lambda line: (line["question"], line["choices"], answer_index(line["answerKey"])),
    "hellaswag": lambda line: (F.concat_ws(" ", line["ctx_a"], F.initcap(line["ctx_b"])), line["endings"], line["label"].cast("long")),
    "boolq": lambda line: (line["question"], F.array(F.lit("yes"), F.lit("no")), F.when(line["answer"], 0).otherwise(1).cast("long")),
}


#: Columns of a line of each family's JSON files, and what it says: a question or the
#: beginning of a text, its choices, and the index of the right one.
FAMILIES = {
    "arc": ("question string, choices struct<text: array<string>, label: array<string>>, answerKey string", lambda x: (x["question"], x["choices"]["text"], answer_index(x["answerKey"]))),
    "commonsenseqa": ("question string, choices struct<text: array<string>, label: array<string>>, answerKey string", lambda x: (x["question"], x["choices"]["text"], F.array_position(x["choices"]["label"], F.trim(x["answerKey"])) - 1)),
    "hellaswag": ("activity_label string, ctx_a string, ctx_b string, endings array<string>, label string", lambda x: (F.concat(x["activity_label"], F.lit(": "), F.concat_ws(" ", x["ctx_a"], _capital(x["ctx_b"]))), x["endings"], x["label"].cast("long"))),
    "mmlu": ("question string, choices array<string>, answer int", lambda x: (x["question"], x["choices"], x["answer"].cast("long"))),
    "mmlu_pro": ("question string, options array<string>, answer_index int", lambda x: (x["question"], x["options"], x["answer_index"].cast("long"))),
    "openbookqa": ("question_stem string, choices struct<text: array<string>, label: array<string>>, answerKey string", lambda x: (x["question_stem"], x["choices"]["text"], answer_index(x["answerKey"]))),
    "piqa": ("goal string, sol1 string, sol2 string, label int", lambda x: (x["goal"], F.array(x["sol1"], x["sol2"]), x["label"].cast("long"))),
    "winogrande": ("sentence string, option1 string, option2 string, answer string", lambda x: (_around(x, 0), F.transform(F.array(x["option1"], x["option2"]), lambda c: F.concat(c, _around(x, 1))), answer_index(x["answer"]))),
}
#: Families whose choices go on with a text, instead of answering a question.
CONTINUED = {"hellaswag", "winogrande"}


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def _around(line: Column, side: int) -> Column:
    """What stands before or after the blank of a sentence."""
    part = F.get(F.split(line["sentence"], "_", 2), F.lit(side))
    return F.rtrim(part) if side == 0 else part


def prompt(family: str, form: str, line: Column) -> Column:
    """A struct (prompt, choices, gold): with lettered choices to name (mcf), with the
    choices themselves to continue with (cf), or with both, the choices lettered and
    then continued with (hybrid)."""
    return _formed(form, *ADAPTERS[family](line))


def json_prompt(family: str, form: str, line: Column) -> Column:
    """The same from a line of the family's JSON files. A line that can't be read gives
    nulls."""
    kind, adapter = FAMILIES[family]
    return _formed(form, *adapter(F.from_json(line, kind)), asked=family not in CONTINUED)


def _formed(form: str, question: Column, choices: Column, gold: Column, asked: bool = True) -> Column:
    letter = lambda i: F.char(i + 65)
    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit(" "), letter(i), F.lit(". "), c, F.lit("\n"))), "")
    head = F.concat(F.lit("Question: "), question) if asked else question
    own, letters = F.transform(choices, lambda c: F.concat(F.lit(" "), c)), F.transform(choices, lambda c, i: F.concat(F.lit(" "), letter(i)))
    forms = {
        "mcf": (F.concat(head, F.lit("\n"), listed, F.lit("Answer:")), letters),
        "cf": (F.concat(head, F.lit("\nAnswer:")) if asked else head, own),
        "hybrid": (F.concat(head, F.lit("\n"), listed, F.lit("Answer:")), own),
    }
    if form not in forms:
        raise ValueError(f"unknown formulation {form}")
    text, given = forms[form]
    return F.struct(text.alias("prompt"), given.alias("choices"), gold.alias("gold"))


def cleaned_metrics(results: DataFrame) -> DataFrame:
    """results (task, metrics: map) as rows (task, metric, value) with clean names: of
    'suite|name:subset|shots' the name and the subset, spaces as underscores; the average
    over all tasks and the errors of metrics are left out."""
    parts = F.split("task", r"\|")
    name = F.regexp_replace(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))), r"[\s:]+", "_")
    rows = results.where("task <> 'all'").select(name.alias("task"), F.explode("metrics").alias("metric", "value"))
    return rows.where(~F.col("metric").endswith("_stderr"))


def long_metrics(wide: DataFrame, step: str) -> DataFrame:
    """(step, tag, value) of all other, numeric columns."""
    tags = [c for c in wide.columns if c != step]
    pairs = F.array(*(F.struct(F.lit(c).alias("tag"), F.col(c).cast("double").alias("value")) for c in tags))
    return wide.select(step, F.inline(pairs))


def by_path(df: DataFrame, path: str, kind: str) -> Column:
    """The value at a dotted path of nested columns, null where there is no such path."""
    at: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.names:
            return F.lit(None).cast(kind)
        at = at[name].dataType
    return F.col(path).cast(kind)


def matches_any(patterns: list[str], *names: Column) -> Column:
    """Whether a pattern matches any of the names (which may be null) at its start."""
    whole = "^(?:" + "|".join(patterns) + ")"
    return reduce(lambda a, b: a | b, (F.coalesce(n.rlike(whole), F.lit(False)) for n in names))


def domain_folders(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """One dataset of a folder per domain, with the domain's name as a column."""
    each = [spark.read.parquet(path).withColumn("domain", F.lit(name)) for name, path in folders.items()]
    return reduce(lambda a, b: a.unionByName(b), each)
