"""Column expressions around a model: prompts, message preparation, and what its answers go through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed value: the characters whose presence makes an answer not English.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
NO_THINK = "/no_think"
# Labels that a model may put before its answer.
LABELS = ("summary", "english summary", "final summary", "answer", "rewrite", "polished summary", "clean summary", "introduction", "conclusion")

PROMPT = (
    "Summarise the passage below in one plain English paragraph. Keep names, places, dates and reasons that it gives, and add nothing. "
    "Translate other languages. No lists, titles, labels or quotations. Use fewer than {limit} sentences."
)
SYSTEM = "You write faithful English summaries and reply with the summary alone."
REPAIR = "Put the text below into English and keep its meaning. Translate what is in another language, or leave it out if it can't be. Mend spacing and spelling, add no facts, and reply with one paragraph."
POLISH = "Edit the text below for grammar, spelling, punctuation and spacing. Keep every fact, add none, and reply with one paragraph."
EDITOR = "You are a careful editor of English and reply with the edited text alone."
SURVEY = (
    "The passage holds summaries of several documents. Write one overview of them in English: what they share, where they differ, and how they relate. "
    "Don't go through them one by one, and add nothing that they don't say. Use fewer than 8 sentences."
)
INTRODUCTION = "The passage holds a survey and the summaries behind it. Write one introductory paragraph in English for a report on them: what it covers, what connects the documents, and why they are worth reading together. No lists, headings or new facts."
CONCLUSION = "The passage holds a survey and the summaries behind it. Write one closing paragraph in English for a report on them: tie the documents together, and say what they show as a set. No lists, headings or new facts."


def has_han(x: Column) -> Column:
    return x.rlike(HAN)


def drop_thinking(x: Column) -> Column:
    """Closed thinking blocks, then one that never closes, each become a space."""
    return F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", " "), r"(?is)<think>.*", " ")


# Fixed values: (pattern, replacement) of ``clean_edges`` after thinking is gone.
EDGE_STEPS = (
    (r"(?i)^\s*(?:(?:" + "|".join(LABELS) + r")\s*:)+\s*", ""),
    (r"\s+", " "),
    (r"\s+([,.;:!?])", "$1"),
    (r"([,.;:!?])([A-Za-z])", "$1 $2"),
    (r"\s+([)\]}])", "$1"),
    (r"([(\[{])\s+", "$1"),
)


def clean_edges(x: Column) -> Column:
    """Trimmed, without thinking and leading labels, on one line, with spaces around punctuation and brackets put right."""
    x = drop_thinking(strip(x))
    for pattern, to in EDGE_STEPS:
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def prompt(limit: Column | int, custom: Column | str | None = None) -> Column:
    """The default prompt with its sentence limit; a custom prompt is used as it is."""
    standard = F.replace(F.lit(PROMPT), F.lit("{limit}"), (F.lit(limit) if isinstance(limit, int) else limit).cast("string"))
    if custom is None:
        return standard
    return F.coalesce(F.lit(custom) if isinstance(custom, str) else custom, standard)


def without_thinking(role: Column, content: Column) -> Column:
    """A message's content with the soft switch against thinking: after a system's text, before a user's, once."""
    asked = content.contains(NO_THINK)
    return F.when(asked, content).when(role == "system", F.concat(strip(content), F.lit(" " + NO_THINK))).when(role == "user", F.concat(F.lit(NO_THINK + "\n"), content)).otherwise(content)


def prepare_messages(messages: Column, thinking: bool = False) -> Column:
    """``without_thinking`` over an array of (role, content)."""
    return messages if thinking else F.transform(messages, lambda m: F.struct(m["role"].alias("role"), without_thinking(m["role"], m["content"]).alias("content")))
