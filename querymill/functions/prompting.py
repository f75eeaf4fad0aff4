"""Prompt templates, filled by concatenation.

A template is split into literal and placeholder parts while the plan is built. Values are never
scanned for placeholders, so a schema that contains "{question}" stays as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.ddl import format_schema, truncate_schema
from querymill.functions.text import or_empty

# The named templates, word for word.
TEMPLATES = {
    "default": (
        "Given the following database schema:\n\n{schema}\n\n"
        "Generate a SQL query to answer this question:\nQuestion: {question}\n\nSQL Query:"
    ),
    "instructional": (
        "You are a SQL expert. Convert the natural language question into a valid SQL query.\n\n"
        "Database Schema:\n{schema}\n\nQuestion: {question}\n\nInstructions:\n"
        "- Generate only the SQL query\n- Use proper SQL syntax\n"
        "- Include all necessary clauses\n- Do not include explanations\n\nSQL:"
    ),
    "few_shot": (
        "Generate SQL queries based on the database schema and examples below.\n\n"
        "Schema:\n{schema}\n\n{examples}\n\nNow generate SQL for:\nQuestion: {question}\nSQL:"
    ),
    "chat": (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
        "You are a helpful assistant that converts natural language questions into SQL queries. "
        "Given a database schema, generate accurate and efficient SQL queries.\n\n"
        "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
        "Database Schema:\n{schema}\n\nQuestion: {question}\n\n"
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nSQL Query:"
    ),
    "concise": "Schema: {schema}\n\nQuestion: {question}\n\nSQL:",
}


def named_template(name: str) -> str:
    if name not in TEMPLATES:
        raise ValueError(f"No template is called {name!r}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def resolve_template(template: str) -> str:
    """A known name, or a custom text that has a ``{question}`` placeholder."""
    if template in TEMPLATES or re.fullmatch(r"[A-Za-z_]\w*", template, re.ASCII):
        return named_template(template)
    if "{question}" not in template:
        raise ValueError("A template of your own needs a {question} placeholder")
    return template


def placeholders(template: str) -> set[str]:
    return {field for _, field, _, _ in Formatter().parse(template) if field is not None}


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with every placeholder replaced by its column."""
    parts: list[Column] = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if spec or conversion:
            raise ValueError(f"Placeholder '{field}' must not carry a format")
        if field not in values:
            raise ValueError(f"No value for the placeholder {field!r}")
        parts.append(or_empty(values[field]))
    return F.concat(*parts) if parts else F.lit("")


def few_shot_block(examples: Column, n: int = 3) -> Column:
    """Numbered examples from an ``array<struct<question, answer>>``; empty without examples."""

    def block(example: Column, index: Column) -> Column:
        return F.concat(
            F.lit("\nExample "), (index + 1).cast("string"),
            F.lit(":\nQuestion: "), or_empty(example["question"]),
            F.lit("\nSQL: "), or_empty(example["answer"]),
        )

    blocks = F.transform(F.slice(examples, 1, n), block)
    text = F.concat(F.lit("Examples:\n"), F.array_join(blocks, "\n"))
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, text).otherwise("")


@dataclass(frozen=True)
class PromptOptions:
    template: str = "default"
    include_schema: bool = True
    max_examples: int = 0
    max_schema_length: int | None = None

    def __post_init__(self) -> None:
        resolve_template(self.template)

    @property
    def text(self) -> str:
        return resolve_template(self.template)


def prompt_schema(schema: Column, opts: PromptOptions = PromptOptions()) -> Column:
    """The schema as it appears in a prompt: tidied; with a bound, cut at whole tables."""
    if not opts.include_schema:
        return F.lit("")
    tidy = format_schema(schema)
    return tidy if opts.max_schema_length is None else truncate_schema(tidy, opts.max_schema_length)


def prompt(
    question: Column,
    schema: Column,
    examples: Column | None = None,
    opts: PromptOptions = PromptOptions(),
    extra: dict[str, Column] | None = None,
) -> Column:
    """Prompt of one row. ``schema`` is raw schema text, ``examples`` an array of structs."""
    values = {"question": question, "schema": prompt_schema(schema, opts)}
    if examples is not None and opts.max_examples > 0:
        values["examples"] = few_shot_block(examples, opts.max_examples)
    values.update(extra or {})
    return fill_template(opts.text, values)
