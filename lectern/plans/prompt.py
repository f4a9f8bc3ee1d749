"""Prompt assembly as column expressions: ordered parts, messages, payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import word_bounds

PART = "struct<type: string, text: string, url: string>"


@dataclass(frozen=True)
class Wording:
    """The texts of a prompt; all may be replaced."""

    sources: str = "SOURCES:"
    task: str = "TASK:"
    form: str = "ANSWER FORMAT:"
    help: str = "SUPPORTING MATERIAL:"
    short: str = "Answer briefly, with exactly as many items as asked."
    essay: str = "Choose one topic, give its number, and write an essay of 350 to 450 words."
    bounded_essay: str = "Choose one topic, give its number, and keep to the number of words that the task asks for."
    image: str = "Image: "
    system: str = "Answer from the sources and your knowledge."
    essay_system: str = "Write an essay. Keep to the length asked for; where only a minimum of 300 words is given, aim at 350 to 450 words."
    length: str = "Keep to the length asked for; where only a minimum of 300 words is given, aim at 350 to 450 words."
    bounded_length: str = "Keep strictly to the limits that the task gives."


@dataclass(frozen=True)
class Sampling:
    """Settings of a request."""

    model: str = "model"
    temperature: float = 0.0
    top_p: float = 0.95
    top_k: int = 64
    seed: int = 42
    short_tokens: int = 768
    essay_tokens: int = 3072


def part(kind: str, text: Column, url: Column | None = None) -> Column:
    """One part of a prompt: a text or an image."""
    return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), (F.lit(None) if url is None else url).cast("string").alias("url"))


def bounded(question: Column) -> Column:
    """Whether a question limits words otherwise than by at least 300."""
    b = word_bounds(question)
    return F.coalesce(b["low"] != 300, F.lit(False)) | b["high"].isNotNull()


def rule(question: Column, essay: Column, wording: Wording = Wording()) -> Column:
    """The instruction that closes a task."""
    return F.when(~essay, wording.short).when(bounded(question), wording.bounded_essay).otherwise(wording.essay)


def system_text(question: Column, essay: Column, wording: Wording = Wording()) -> Column:
    """The system text: an essay's clause on length gives way to the task's own limits."""
    bound = F.replace(F.lit(wording.essay_system), F.lit(wording.length), F.lit(wording.bounded_length))
    return F.when(~essay, wording.system).when(bounded(question), bound).otherwise(wording.essay_system)


def parts(question: Column, source: Column, form: Column, essay: Column, context: Column, images: Column | None = None, wording: Wording = Wording(), question_first: bool = False) -> Column:
    """The prompt's parts in order: images, sources with task and rule, and the context of an essay.

    ``images`` is an array of struct<path, url>; ``question_first`` puts the
    task before everything as well.
    """
    none = F.array().cast(f"array<{PART}>")
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(
        F.lit(wording.sources + "\n"), blank(source), F.lit(f"\n\n{wording.task}\n"), blank(question), F.lit(f"\n\n{wording.form}\n"), blank(form),
        F.lit("\n\n"), rule(question, essay, wording),
    )
    shown = none
    if images is not None:
        shown = F.flatten(F.transform(images, lambda i: F.array(part("text", F.concat(F.lit(wording.image), i["path"])), part("image_url", F.lit(None), i["url"]))))
    helped = F.when(essay & (blank(context) != ""), F.array(part("text", F.concat(F.lit(wording.help + "\n"), context)))).otherwise(none)
    first = F.array(part("text", F.concat(F.lit(wording.task + "\n"), blank(question)))) if question_first else none
    return F.concat(first, shown, F.array(part("text", text)), helped)


def without_last(parts: Column) -> Column:
    """All parts but the last."""
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def payload(system: Column, parts: Column, essay: Column, sampling: Sampling = Sampling()) -> Column:
    """The request as JSON."""
    tokens = F.when(essay, sampling.essay_tokens).otherwise(sampling.short_tokens)
    return F.to_json(F.struct(
        F.lit(sampling.model).alias("model"), system.alias("system"), parts.alias("content"), F.lit(sampling.temperature).alias("temperature"),
        F.lit(sampling.top_p).alias("top_p"), F.lit(sampling.top_k).alias("top_k"), F.lit(sampling.seed).alias("seed"), tokens.alias("max_tokens"),
    ))
