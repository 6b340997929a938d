"""Prompts and text chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording and separator of the retrieval prompt.
EXPLANATION = "HERE ARE SOME FACTS SEPARATED BY '---' IN OUR DATA REPOSITORY WHICH WILL HELP YOU ANSWER THE QUESTION."
INTRODUCTION = "HERE IS THE QUESTION WHICH YOU SHOULD ANSWER BASED ONLY ON THE PREVIOUS FACTS:"
SEPARATOR = "\n---\n"


def format_prompt(text: str, template: str, context: str | list[str] | None = None) -> str:
    """The template with `{input}` and `{context}` filled in; without `{input}` the text is
    appended. ValueError if a context is called for and missing."""
    values: dict[str, str] = {}
    if "{input}" in template:
        values["input"] = text
    else:
        template = template.replace("{context}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{context}") + text.replace("{", "{{").replace("}", "}}")
    if "{context}" in template:
        joined = context if isinstance(context, str) else "\n".join(context or [])
        if not joined:
            raise ValueError("the template needs a context")
        values["context"] = joined
    return template.format(**values)


def prompt_column(text: Column, template: str, context: Column | None = None) -> Column:
    """format_prompt on columns; context is an array of strings. A missing context is an error."""
    if "{input}" not in template:
        template += "{input}"
    if "{context}" in template:
        if context is None:
            raise ValueError("the template needs a context")
        joined = F.array_join(context, "\n")
        context = F.when(F.length(joined) > 0, joined).otherwise(F.raise_error(F.lit("the template needs a context")).cast("string"))
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find(m) for m in ("{input}", "{context}") if m in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        mark = "{input}" if rest.startswith("{input}", at) else "{context}"
        parts.append(text if mark == "{input}" else context)
        rest = rest[at + len(mark) :]
    return F.concat(*parts)


def retrieval_prompt(question: Column, facts: Column, explanation: str = EXPLANATION, introduction: str = INTRODUCTION, separator: str = SEPARATOR) -> Column:
    """Explanation, facts (an array of strings) and question, separated."""
    return F.concat_ws(separator, F.lit(explanation), F.array_join(facts, separator), F.lit(introduction), question)


def words(text: Column) -> Column:
    """The words of a text, split at white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunks(text: Column, size: int = 200) -> Column:
    """Array of texts of `size` words each, without overlap; an empty text has none."""

    def cut(own: Column) -> Column:
        count = F.ceil(F.size(own) / F.lit(size)).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.array_join(F.slice(own, i * size + 1, size), " "))

    # The words are a lambda's variable, so that the text is split once and not for each chunk.
    return F.when(text.isNotNull(), F.transform(F.array(words(text)), cut)[0])
