"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Kinds: email, ip, card, phone, and iban, which the method adds. A card has to pass Luhn, an IBAN mod-97, an
address part is at most 255, and a phone number has 9 to 15 digits. Every span starts from its kind's prior;
a context word of the kind within ``CONTEXT`` code points on either side raises the score, a word that
speaks against it lowers it. Spans of all scores are listed; ``scores`` has theirs in the same order, so that
a policy can choose its threshold.

Every pattern is run in time linear in the text: an e-mail address is found from its @, and digit runs are
entered only at their start.

Defined results: a null or empty text has no spans; very long texts are scanned whole; a null or repeated
doc_id is carried through, one result for each row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .spans import encode_spans, mask, overlaps, sha256_hex

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
CONTEXT = 48

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: A kind's score before its context is seen, and with a valid checksum where the kind has one.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
#: Words near a span that speak for its kind, and words that speak against it.
FOR = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|reach|courriel|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|client|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment|carte|tarjeta|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|tél|llame)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|example|sample|test|order|invoice|isbn|serial)\b", re.I)
RAISE, LOWER = 0.15, 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        # A local part can't hold @: it is the whole run before it, as far as the last address left it.
        start = text.rfind("@", done, m.start()) + 1 or done
        head = text[start : m.start()]
        size = len(head) - len(head.rstrip(_LOCAL))
        if size:
            out.append(("email", m.start() - size, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, leftmost and non-overlapping within a kind; a match that fails its test is dropped."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 38:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _ibans(text: str):
    """Spans of valid codes. A match may run on into the words after a code, or begin before one: it is tried without its last groups, and then from the next place."""
    at = 0
    while m := _IBAN.search(text, at):
        end = m.end()
        while end > m.start() and not mod97(text[m.start() : end]):
            end = max(text.rfind(" ", m.start(), end), m.start())
        if end > m.start():
            yield m.start(), end
        at = max(end, m.start() + 1)


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans and the IBANs that overlap none of them but card numbers."""
    out = base_spans(text)
    if _DIGIT.search(text):
        taken = [s for s in out if s[0] != "card"]
        out += [s for a, b in _ibans(text) if not overlaps(s := ("iban", a, b), taken)]
    return out


def score(text: str, span: tuple[str, int, int]) -> float:
    kind, a, b = span
    near = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
    return min(1.0, max(0.0, PRIOR[kind] + RAISE * bool(FOR[kind].search(near)) - LOWER * bool(AGAINST.search(near))))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_iban long, base_sha256 string, spans string, scores string"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document, see RESULT. No shuffle: a batch of texts at a time."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = sorted(find(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                base = [s for s in spans if s[0] in BASE]
                rows.append((key, *(sum(s[0] == k for s in spans) for k in KINDS), sha256_hex(encode_spans(base, KINDS)), encode_spans(spans, KINDS), ",".join(f"{score(text, s):.2f}" for s in spans)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.string())])
    return texts(docs).mapInArrow(run, RESULT)


def redact(text: str, least: float = 0.5) -> str:
    """The text with spans of at least this score replaced by their kind."""
    return mask(text, [s for s in find(text) if score(text, s) >= least])
