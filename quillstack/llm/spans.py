"""How found spans are written: kind:start:end in code points, end exclusive, ordered by start and then kind."""

from __future__ import annotations

import hashlib


def encode_spans(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def overlaps(span: tuple[str, int, int], others: list[tuple[str, int, int]]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in others)


def mask(text: str, spans: list[tuple[str, int, int]], label: str = "[{kind}]") -> str:
    """``text`` with every run of overlapping spans replaced by the label of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], label.format(kind=kind)]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text
