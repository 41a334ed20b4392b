"""Prompts from templates, and the way back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import PROMPTS
from .text import hash_slot

FIELD = re.compile(r"\{(\w+)\}")


def rendered(task: str, slot: Column, **fields: Column) -> Column:
    """The template of a task at a slot (from 0), with its fields filled in; values are not read as templates again."""
    chosen = [[F.lit(part) if i % 2 == 0 else fields[part] for i, part in enumerate(FIELD.split(t))] for t in PROMPTS[task]]
    return F.element_at(F.array(*(F.concat(*parts) for parts in chosen)), slot + 1)


def stable_slot(task: str, *key: Column) -> Column:
    """A slot drawn from the SHA-256 of the key and the task."""
    return hash_slot(F.concat_ws(":", F.lit("13"), *(k.cast("string") for k in key), F.lit(task)), len(PROMPTS[task]))


def inverted(task: str, prompt: Column) -> Column:
    """struct of slot and the fields' values of the first template that can have made a prompt; null if none can."""
    names = list(dict.fromkeys(n for t in PROMPTS[task] for n in FIELD.findall(t)))
    found = []
    for i, template in enumerate(PROMPTS[task]):
        parts = FIELD.split(template)
        pattern = r"\A" + "".join(re.sub(r"([^\w ])", r"\\\1", p) if k % 2 == 0 else "(.+)" for k, p in enumerate(parts)) + r"\z"
        at = {n: k for k, n in enumerate(parts[1::2], 1)}
        values = [F.regexp_extract(prompt, pattern, at[n]).alias(n) if n in at else F.lit(None).cast("string").alias(n) for n in names]
        found.append(F.when(prompt.rlike(pattern), F.struct(F.lit(i).alias("slot"), *values)))
    return F.coalesce(*found)
