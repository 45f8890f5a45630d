"""Summaries of chunks through a pluggable backend, with guards against answers in other scripts.

Defined results: a null text is summarised as an empty one; ``summary``, ``han`` and ``seconds`` of the input, if it has
columns of these names, are replaced; an empty table stays empty.
"""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import bound_batches, slices, trim
from ..config import SummaryConfig
from ..functions import guards

Messages = list[dict[str, str]]
_HAN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), guards.HAN))
#: Characters of a refused answer that the log shows.
PREVIEW = 300
_THINK = re.compile(r"<think>.*?</think>|<think>.*", re.I | re.S)
_STEPS = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in guards.EDGE_STEPS]
_SENTENCE = re.compile(r"[^.!?]+[.!?]+|[^.!?]+$")
BODY, ANSWER = "\n\nText:\n", "\n\nSummary:"


class Summarizer(Protocol):
    """A backend: one answer for each conversation of a batch.

    One with a method ``configure`` gets the SummaryConfig before its first batch: model, sampling, temperature, devices.
    """

    def generate(self, batch: list[Messages], max_tokens: int) -> list[str]: ...


class Lead:
    """The deterministic default: the first sentences of the text that the last message carries."""

    def __init__(self, sentences: int = 6):
        self.sentences = sentences

    def generate(self, batch: list[Messages], max_tokens: int) -> list[str]:
        out = []
        for messages in batch:
            text = messages[-1]["content"].partition(BODY)[2].rpartition(ANSWER)[0]
            out.append("".join(m[0] for m in islice(_SENTENCE.finditer(text), self.sentences)))
        return out


def clean_edges(text: str) -> str:
    """``guards.clean_edges`` for one answer."""
    text = _THINK.sub(" ", text.strip())
    for pattern, to in _STEPS:
        text = pattern.sub(to, text)
    return text.strip()


def _messages(system: str, asked: str) -> Messages:
    return [{"role": "system", "content": f"{system} {guards.NO_THINK}"}, {"role": "user", "content": asked if guards.NO_THINK in asked else f"{guards.NO_THINK}\n{asked}"}]


def conversation(text: str, config: SummaryConfig, strict: bool = False) -> Messages:
    standard = guards.PROMPT.replace("{limit}", str(config.sentences))
    prompt = "Write English only, in Latin letters. " + standard if strict else config.prompt or standard
    return _messages(guards.SYSTEM, prompt + BODY + text + ANSWER)


def edit(text: str, prompt: str) -> Messages:
    """Asks for a text's rewriting: ``guards.REPAIR`` or ``guards.POLISH``."""
    return _messages(guards.EDITOR, prompt + BODY + text + ANSWER)


def summarise_batch(texts: list[str], backend: Summarizer, config: SummaryConfig) -> list[str]:
    """Answers for all; those with Han characters are asked for again, up to ``retries`` times, and then rewritten.

    With ``polish`` the ones without are edited once more; an empty edit leaves them as they are.
    """
    ask = lambda batch: [clean_edges(x) for x in backend.generate(batch, config.max_tokens)] if batch else []
    odd_of = lambda: [i for i, x in enumerate(out) if _HAN.search(x)]
    out = ask([conversation(t, config) for t in texts])
    for _ in range(config.retries):
        odd = odd_of()
        for i in odd:
            logging.getLogger("quillstack").warning("not English, asked again: %s", out[i][:PREVIEW])
        for i, x in zip(odd, ask([conversation(texts[i], config, strict=True) for i in odd]), strict=True):
            out[i] = x
    if config.polish:
        fine = [i for i, x in enumerate(out) if x and not _HAN.search(x)]
        for i, x in zip(fine, ask([edit(out[i], guards.POLISH) for i in fine]), strict=True):
            out[i] = x or out[i]
    odd = odd_of() if config.repair else []
    for i, x in zip(odd, ask([edit(out[i], guards.REPAIR) for i in odd]), strict=True):
        if not _HAN.search(x):
            out[i] = x
    return out


def made(backend: Callable[[], Summarizer], config: SummaryConfig) -> Summarizer:
    """An instance that knows its configuration."""
    model = backend()
    if hasattr(model, "configure"):
        model.configure(config)
    return model


def summarise(chunks: DataFrame, backend: Callable[[], Summarizer] | None = None, config: SummaryConfig | None = None, column: str = "text") -> DataFrame:
    """Adds ``summary``, ``han`` (it still has Han characters) and ``seconds`` (the model's for this row). ``backend`` makes one instance for each worker process."""
    config = config or SummaryConfig()
    make = backend or (lambda: Lead(config.sentences))
    models: list[Summarizer] = []
    bound_batches(chunks.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        if not models:
            models.append(made(make, config))
        answers, seconds = [], []
        for rows in slices(texts):
            began = time.monotonic()
            answers += summarise_batch(rows, models[0], config)
            each = (time.monotonic() - began) / max(1, sum(map(len, rows)))
            seconds += [each * len(t) for t in rows]
            del rows
        out = pa.StructArray.from_arrays([pa.array(answers, pa.string()), pa.array(seconds, pa.float64())], ["summary", "seconds"])
        del answers
        trim()
        return out

    out = chunks.drop("summary", "han", "seconds").withColumn("__answer", F.arrow_udf(run, "summary string, seconds double")(column))
    out = out.withColumns({"summary": F.col("__answer.summary"), "seconds": F.col("__answer.seconds")}).drop("__answer")
    if config.fail_on_han:
        out = out.withColumn("summary", F.when(guards.has_han(F.col("summary")), F.raise_error(F.lit("an answer is not English"))).otherwise(F.col("summary")))
    return out.withColumn("han", guards.has_han(F.col("summary")))
