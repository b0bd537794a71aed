"""Prompt and MCQ rendering. A missing cell is rendered as ``nan``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mcqlab.config import SEED, McqColumns

SYSTEM_PROMPTS = {
    "answerability": "Answer the multiple-choice question from the context. Reply with one letter: a, b, c or d.",
    "disclosure": "Does the wording alone give the answer away to someone without medical knowledge? Reply True or False.",
    "difficulty": "Rate from 1 (hard to tell apart) to 5 (obvious) how the correct option stands out. Reply with the number.",
    "distractors_quality": "Rate from 1 (poor) to 5 (excellent) how plausible the wrong options are. Reply with the number.",
}
USER_PROMPTS = (
    "Write one medical question with four options of which one is right.",
    "Give me a four-option medical exam question that has a single right answer.",
    "Create an exam item in medicine: a question, four choices, one correct.",
    "Compose a medical multiple-choice item with exactly one correct choice out of four.",
    "Prepare one medical question and four candidate answers, only one being true.",
)
GENERATION_PREFIX = (
    "Write one multiple-choice question with four short options, one of them right, on the text below. "
    "Wrong options should follow common misunderstandings.\n\nText:\n"
)
GENERATION_SUFFIX = "\n"


def shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("nan"))


def options_text(c: McqColumns) -> Column:
    return F.concat(*(x for mark, name in zip("abcd", c.options, strict=True) for x in (F.lit(("" if mark == "a" else "\n") + f"{mark}) "), shown(name))))


def judge_prompt(c: McqColumns, *, options: bool = True, correct: bool = True, context: str | None = None) -> Column:
    """The user prompt of a judge."""
    parts = [F.lit("-----\nQuestion:\n"), shown(c.question), F.lit("\n")]
    if context is not None:
        parts = [F.lit("Context:\n-----\n"), shown(context), F.lit("\n-----\n"), *parts]
    if options:
        parts += [F.lit("Options:\n"), options_text(c), F.lit("\n")]
    if correct:
        parts += [F.lit("Correct option: "), shown(c.correct), F.lit("\n")]
    return F.concat(*parts, F.lit("-----\n"))


def mcq_text(c: McqColumns) -> Column:
    """An MCQ as a completion; without the key."""
    return F.concat(F.lit("Question: "), shown(c.question), F.lit("\n"), options_text(c))


def generation_prompt(content: Column) -> Column:
    return F.concat(F.lit(GENERATION_PREFIX), F.coalesce(content, F.lit("nan")), F.lit(GENERATION_SUFFIX))


def hash_index(key: Column, n: int, seed: int = SEED) -> Column:
    """0 to n-1 by a hash that other engines compute alike."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def assigned_prompt(key: Column, seed: int = SEED) -> Column:
    return F.element_at(F.array(*map(F.lit, USER_PROMPTS)), 1 + hash_index(key, len(USER_PROMPTS), seed).cast("int"))
