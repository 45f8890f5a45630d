"""Options of a run, from code, from the command line, or from a file of settings."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field, fields, replace

from .functions.text import FILLERS, STUTTERS

SECTIONS = ("chapter", "page", "paragraph")
ORDERS = ("firstToLast", "lastToFirst", "lastToFirstBySection", "firstToLastByTop")


@dataclass(frozen=True)
class CleanConfig:
    citations: bool = True
    unicode: bool = True
    symbols: bool = True
    stutters: bool = True
    fillers: bool = True
    repeats: bool = True
    keep_numbers: bool = False
    stutter_list: tuple[str, ...] = STUTTERS
    filler_list: tuple[str, ...] = FILLERS


@dataclass(frozen=True)
class ChunkConfig:
    char_limit: int = 8000
    section: str = "chapter"
    percent: float = 0.9
    overlap: int = 200
    order: str = "firstToLast"


@dataclass(frozen=True)
class SummaryConfig:
    prompt: str | None = None
    sentences: int = 10
    max_tokens: int = 400
    retries: int = 2
    repair: bool = True
    fail_on_han: bool = False
    sample: bool = False
    temperature: float = 0.3
    top_p: float = 0.9
    model: str | None = None
    polish: bool = False
    devices: tuple[int, ...] = (0,)
    four_bit: bool = True


@dataclass(frozen=True)
class ReduceConfig:
    char_limit: int = 20000
    percent: float = 0.9
    overlap: int = 200
    rounds: int = 5
    sentences: int = 6
    max_tokens: int = 220


@dataclass(frozen=True)
class ReportConfig:
    output: str = "storage"
    name: str | None = None
    types: tuple[str, ...] = ("txt", "docx", "pdf")
    data_file: str = "data.txt"
    title: str | None = None
    author: str = ""
    abstract: str = ""
    introduction: str | None = None
    conclusion: str | None = None
    generate_introduction: bool = True
    generate_conclusion: bool = True
    introduction_prompt: str | None = None
    conclusion_prompt: str | None = None
    survey_prompt: str | None = None
    section_sentences: int = 6
    section_max_tokens: int = 260


@dataclass(frozen=True)
class StackConfig:
    clean: CleanConfig = field(default_factory=CleanConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    summary: SummaryConfig = field(default_factory=SummaryConfig)
    reduce: ReduceConfig = field(default_factory=ReduceConfig)
    report: ReportConfig = field(default_factory=ReportConfig)


def to_bool(text: str) -> bool:
    low = text.strip().lower()
    if low in ("true", "t", "yes", "y", "1"):
        return True
    if low in ("false", "f", "no", "n", "0"):
        return False
    raise argparse.ArgumentTypeError(f"not a truth value: {text}")


def to_list(text: str | None) -> tuple[str, ...] | None:
    """Comma-separated values; blank or ``none`` is none."""
    if text is None or text.strip().lower() in ("", "none"):
        return None
    return tuple(x.strip() for x in text.split(",") if x.strip())


def to_ints(text: str | None) -> tuple[int, ...] | None:
    found = to_list(text)
    return None if found is None else tuple(map(int, found))


def load_settings(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines: comments and blanks skipped, ``export`` and one pair of quotes taken off; what is set already stays."""
    environ = os.environ if environ is None else environ
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, found, value = line.strip().removeprefix("export ").partition("=")
                if not found or name.startswith("#"):
                    continue
                value = value.strip()
                if value[:1] in ("'", '"') and value[:1] == value[-1:] and len(value) > 1:
                    value = value[1:-1]
                else:
                    value = value.partition(" #")[0].rstrip()
                environ.setdefault(name.strip(), value)
    return environ


def first_setting(names: tuple[str, ...], default: str | None = None, environ: dict[str, str] | None = None) -> str | None:
    """The first of these settings that is not blank."""
    environ = os.environ if environ is None else environ
    return next((environ[n].strip() for n in names if environ.get(n, "").strip()), default)


MODEL_SETTINGS = ("MODEL_NAME", "MODEL", "HF_MODEL_NAME")
_PARTS = {"clean": CleanConfig, "chunk": ChunkConfig, "summary": SummaryConfig, "reduce": ReduceConfig, "report": ReportConfig}


def parser() -> argparse.ArgumentParser:
    """One option ``--part-field`` for every field of the parts of StackConfig, and the inputs."""
    out = argparse.ArgumentParser(prog="quillstack")
    out.add_argument("input", nargs="+")
    for part, kind in _PARTS.items():
        for f in fields(kind):
            sample = getattr(kind(), f.name)
            convert = to_bool if isinstance(sample, bool) else to_ints if f.name == "devices" else to_list if isinstance(sample, tuple) else type(sample) if sample is not None else str
            out.add_argument(f"--{part}-{f.name.replace('_', '-')}", type=convert, default=None)
    return out


def parse(argv: list[str]) -> tuple[list[str], StackConfig]:
    given = vars(parser().parse_args(argv))
    made = {}
    for part, kind in _PARTS.items():
        chosen = {f.name: given[f"{part}_{f.name}"] for f in fields(kind) if given[f"{part}_{f.name}"] is not None}
        made[part] = replace(kind(), **chosen)
    made["summary"] = replace(made["summary"], model=made["summary"].model or first_setting(MODEL_SETTINGS))
    if made["chunk"].section not in SECTIONS:
        raise ValueError(f"section is one of {', '.join(SECTIONS)}")
    return given["input"], StackConfig(**made)
