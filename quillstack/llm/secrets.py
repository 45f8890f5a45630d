"""Secret scan: a linear-chain conditional random field tags tokens as begin, inside or outside of a secret.

The tagger's features are a token's own shape (runs of character classes, length, mixture, entropy), its
make of its parts, its word, the words of its neighbours, and features of the whole file (digit share,
assignments). It is decoded by Viterbi. It is trained here, in a few seconds, by maximum likelihood over sentences
that a seeded generator writes (``training_sentences``), so it is the same model for every input. They hold secrets
after keywords, in headers, in URLs and standing alone, and what looks like one but is none: identifiers, paths,
links, UUIDs, versions, dates, images in base64, and keywords that no secret follows.

Three patterns are the base (assign, access, hex); their spans always stay. Spans of the tagger that overlap
no base span are added as kind ``crf``.

Decoding is exact although most tokens are never decoded. For a token whose scores for begin and inside fall
short of outside by more than any transitions and any admissible context could make up, outside is certain;
``Tagger.calm`` proves that for a white-space chunk and remembers it. Only the tokens around other chunks go
through Viterbi.

Defined results: a null or empty text has no spans; very long texts are scanned whole; a null or repeated
doc_id is carried through, one result for each row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, texts, trim
from .spans import encode_spans, mask, overlaps, sha256_hex

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "crf")
#: Chunks whose verdict a worker remembers; at this many it starts anew, so its memory is bounded.
CACHE_CHUNKS = 60_000

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The three base kinds. Access and hex matches are maximal runs, so their least length is part of the pattern."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


#: How tokens of well-known services begin, in lower case.
PREFIXES = ("eyj", "ghp_", "gho_", "sk_", "pk_", "xoxb", "xoxp", "akia", "aiza", "glpat")
TOKEN = re.compile(r"[\w+/.-]+=*(?!\w)|[^\s\w]")
BEGIN, INSIDE, OUTSIDE = range(3)
_CHUNK = re.compile(r"\S+")


#: Longer tokens are looked at anew each time, so that what a worker remembers is bounded in bytes.
CACHE_CHARS = 64
_PART = re.compile(r"[^\W_]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_VOWELS = frozenset("aeiouyAEIOUY")


def _class(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "-"


def own_features(token: str) -> tuple[str, ...]:
    """Features of a token alone."""
    return _remembered(token) if len(token) <= CACHE_CHARS else _own(token)


def _own(token: str) -> tuple[str, ...]:
    n = len(token)
    if n == 1 and not token.isalnum():
        return ("bias", "punct", f"w={token}")
    core = token.strip(".-/+=_")
    classes = "".join(map(_class, core))
    shape = re.sub(r"(.)\1+", r"\1", classes)
    out = ["bias", f"len={min(8, n.bit_length() + (n >= 24) + (n >= 36))}", f"shape={shape if len(shape) <= 4 else 'mixed' if len(shape) <= 10 else 'scrambled'}"]
    low = core.lower()
    out.append("w=" + word(token))
    if core.isalpha():
        out.append("letters")
        if core.islower() or core.isupper() or core[1:].islower():
            return tuple(out)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    if digits and letters and n >= 8:
        out.append("digits+letters")
    if n >= 16 and not core.isalpha():
        counts = Counter(core)
        entropy = -sum(v / len(core) * math.log2(v / len(core)) for v in counts.values()) if core else 0.0
        out.append(f"entropy={int(entropy)}")
        if digits and any(c.isupper() for c in core) and any(c.islower() for c in core):
            out.append("three-classes")
    if low.startswith(PREFIXES):
        out.append("known-prefix")
    # The make of its parts: a path, a name or a date has parts of one kind each, a key has long scrambled ones.
    parts = _PART.findall(core)
    longest = max(parts, key=len, default="")
    turns = sum(x != y and not (x == "A" and y == "a") for x, y in zip(map(_class, longest), map(_class, longest[1:])))
    vowels, of = sum(c in _VOWELS for c in longest), sum(c.isalpha() for c in longest)
    mixed = sum(not (x.isdigit() or x.isalpha()) for x in parts)
    out += [f"parts={min(4, len(parts))}", f"longest={min(6, len(longest).bit_length())}", f"turns={min(4, 10 * turns // max(1, len(longest)))}", f"vowels={min(3, 8 * vowels // of) if of >= 4 else 4}", f"mixed={min(2, mixed)}/{min(2, len(parts))}", f"slashes={min(2, core.count('/'))}"]
    if len(longest) >= 16:
        out.append(f"long:turns={min(4, 10 * turns // len(longest))}")
    if _UUID.search(core):
        out.append("uuid")
    return tuple(out)


_remembered = lru_cache(maxsize=20_000)(lambda token: tuple(map(intern, _own(token))))  # equal names are kept once


#: Words with a weight of their own; others count by their make.
KEYWORDS = frozenset("password passwd passphrase secret token api_key apikey auth access_key client_secret private_key credential credentials bearer pwd key authorization basic x-api-key base64 commit sha1 sha256 md5 integrity id uuid the a of note".split())


def word(token: str) -> str:
    low = token.strip(".-/+_").lower() or token
    if low in KEYWORDS or len(token) == 1 and not token.isalnum():
        return low
    return "<letters>" if low.isalpha() else "<digits>" if low.isdigit() else "<mixed>" if len(low) < 16 else "<long>"


def file_features(text: str) -> tuple[str, ...]:
    head = len(text) or 1
    digits = sum(text.count(d) for d in "0123456789") / head
    marks = (text.count("=") + text.count(":")) / head
    return (f"file:digits={0 if digits < 0.01 else 1 if digits < 0.1 else 2}", f"file:marks={0 if marks == 0 else 1 if marks < 0.02 else 2}")


def features(tokens: list[str], i: int, of_file: tuple[str, ...]) -> list[str]:
    out = [*own_features(tokens[i]), *of_file]
    out.append("p1=" + (word(tokens[i - 1]) if i else "<s>"))
    out.append("p2=" + (word(tokens[i - 2]) if i > 1 else "<s>"))
    out.append("n1=" + (word(tokens[i + 1]) if i + 1 < len(tokens) else "</s>"))
    return out


_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "access_key", "client_secret", "private_key", "credential", "bearer", "pwd", "passphrase")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGITS
_SYLLABLES = ("an", "the", "re", "tion", "er", "ou", "st", "in", "es", "or", "ing", "ver", "sch", "que", "ment", "ción", "é", "ü", "lly", "ka", "to", "mi", "lo", "ben", "dar", "ex", "po", "ul", "gra", "sel")


class _Writer:
    """Invented texts from one seeded source."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, chars: str, n: int) -> str:
        return "".join(self.r.choice(chars) for _ in range(n))

    def word(self, ascii_only: bool = False) -> str:
        while True:
            w = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4, 5))))
            if not ascii_only or w.isascii():
                return w

    def name(self, join: str, least: int = 2, most: int = 4, title: bool = False) -> str:
        words = [self.word(True) for _ in range(self.r.randint(least, most))]
        return join.join(w.capitalize() if title else w for w in words)

    def uuid(self) -> str:
        return "-".join(self.pick(_DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12))

    def key(self) -> str:
        """A random key of some service's make."""
        r = self.r
        return r.choice((
            lambda: self.pick(_DIGITS + "abcdef", r.choice((24, 32, 40, 64))), lambda: "AKIA" + self.pick(_UPPER + "234567", 16),
            lambda: r.choice(("ghp_", "sk_live_", "pk_test_", "xoxb-", "glpat-", "AIza", "sk-", "hf_")) + self.pick(_ALNUM, r.randint(20, 40)),
            lambda: "eyJ" + self.pick(_ALNUM, r.randint(15, 30)) + "." + self.pick(_ALNUM + "_-", r.randint(30, 60)) + "." + self.pick(_ALNUM + "_-", r.randint(25, 43)),
            lambda: self.pick(_ALNUM + "+/", r.choice((32, 40, 44, 64))) + "=" * r.randrange(3), lambda: self.pick(_ALNUM, r.randint(20, 48)), lambda: self.pick(_ALNUM, r.randint(16, 32)),
            lambda: "-".join(self.pick(_UPPER + _DIGITS, r.choice((5, 6, 8))) for _ in range(r.randint(4, 5))),
        ))()

    def choice_of_user(self) -> str:
        """A password that someone made up: it shows by what stands before it."""
        r = self.r
        return r.choice((
            lambda: self.word(True) + self.pick(_DIGITS, r.randint(1, 4)), lambda: self.word(True).capitalize() + self.pick(_DIGITS, r.randint(2, 4)), lambda: self.pick(_ALNUM, r.randint(6, 12)),
            lambda: self.name("-", 3, 4), lambda: self.name("_", 2, 3) + self.pick(_DIGITS, 2), lambda: "".join(c if r.random() < 0.7 else r.choice(_DIGITS) for c in self.word(True).capitalize() + self.word(True)),
        ))()

    def lookalike(self) -> str:
        """What a tagger could take for a key."""
        r, w = self.r, self.word
        host = lambda: r.choice(("", "www.", "api.", "docs.")) + self.name("-", 1, 2) + r.choice((".com", ".org", ".example.com", ".io", ".net"))
        path = lambda: "/".join(r.choice((self.name("-", 1, 3), self.name("_", 1, 3), w(True), self.pick(_DIGITS, r.randint(1, 6)), self.name("", 1, 2, True))) for _ in range(r.randint(1, 6)))
        return r.choice((
            self.uuid, lambda: r.choice(("id", "uuid", "commit", "run", "request", "trace_id")) + r.choice((" ", ": ", "=", " = ")) + self.uuid(),
            lambda: f"{r.choice(('http', 'https', 'ftp'))}://{host()}/{path()}" + r.choice(("", f"?{w(True)}={self.pick(_DIGITS, 2)}", f"#L{self.pick(_DIGITS, 3)}", ".html", f"/{self.pick(_DIGITS + 'abcdef', 7)}")),
            lambda: f"https://{host()}/{w(True)}/{self.name('-', 1, 3)}/{r.choice(('blob', 'tree', 'commit', 'raw'))}/{r.choice(('main', 'master', self.pick(_DIGITS + 'abcdef', 10)))}/{path()}.{r.choice(('java', 'py', 'md', 'rs', 'go'))}",
            lambda: "/" + path() + f"/part-{self.pick(_DIGITS, 5)}-{self.uuid()}-c000.snappy.parquet", lambda: "/" + path() + r.choice((".py", ".txt", ".parquet", ".log", "/", ".tar.gz")), lambda: path() + r.choice((".csv", ".json", ".h5")),
            lambda: ".".join((r.choice(("org", "com", "java", "net")), *(w(True) for _ in range(r.randint(1, 4))), self.name("", 1, 4, True))), lambda: self.name("", 2, 5, True), lambda: w(True) + self.name("", 1, 4, True), lambda: self.name("_", 2, 6), lambda: self.name("_", 2, 5).upper(), lambda: self.name("-", 2, 6),
            lambda: self.name("", 1, 3, True) + self.pick(_DIGITS, r.randint(1, 3)), lambda: w(True) + self.pick(_DIGITS, r.randint(1, 4)) + "_" + w(True), lambda: f"v{r.randrange(9)}.{r.randrange(30)}.{r.randrange(99)}" + r.choice(("", f"-rc{r.randrange(9)}", f"-beta.{r.randrange(20)}+build.{self.pick(_DIGITS, 4)}")),
            lambda: f"20{self.pick(_DIGITS, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}" + r.choice(("", f"T1{self.pick(_DIGITS, 1)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{self.pick(_DIGITS, 3)}Z", f"T0{self.pick(_DIGITS, 1)}-{r.randint(10, 59)}-{r.randint(10, 59)}")),
            lambda: f"{w(True)}.{self.pick(_DIGITS, r.randint(1, 3))}@{host()}", lambda: f"{self.name('.', 1, 3)}{self.pick(_DIGITS, r.randrange(3))}@{host()}", lambda: f"+{r.randint(1, 99)} ({self.pick(_DIGITS, 3)}) {self.pick(_DIGITS, 3)}-{self.pick(_DIGITS, 4)}", lambda: self.pick(_DIGITS, r.randint(5, 20)), lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
            lambda: "-".join(self.pick(_DIGITS, n) for n in r.choice(((3, 4, 4), (4, 4, 4, 4), (3, 1, 2, 6, 1)))), lambda: ":".join(self.pick(_DIGITS + "abcdef", 2) for _ in range(6)), lambda: "0x" + self.pick(_DIGITS + "abcdef", r.choice((2, 4, 8, 12))), lambda: "#" + self.pick(_DIGITS + "ABCDEF", 6), lambda: self.pick(_DIGITS + "abcdef", r.choice((7, 8, 10))),
            lambda: f"data:image/{r.choice(('png', 'gif', 'jpeg'))};base64,{self.pick(_ALNUM + '+/', r.randint(30, 200))}" + "=" * r.randrange(3), lambda: r.choice(("sha1", "sha256", "md5", "integrity")) + r.choice((": ", "=", " ")) + self.pick(_ALNUM + "+/", 44) + "=",
            lambda: f"{self.pick(_UPPER, r.randint(1, 3))}-{self.pick(_DIGITS, r.randint(2, 5))}" + r.choice(("", f"-{self.pick(_UPPER, 1)}", f"/{self.pick(_DIGITS, 2)}")), lambda: self.pick(_UPPER, r.randint(2, 8)), lambda: self.pick("ACGT", r.randint(12, 60)), lambda: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(r.randint(2, 40))),
            lambda: f"{w()}({self.word()}, {self.pick(_DIGITS, 1)})", lambda: f"{w(True)} = {w(True)}[{self.pick(_DIGITS, 2)}] + {self.pick(_DIGITS, 3)}", lambda: w() * r.randint(4, 12), lambda: f"{self.pick(_DIGITS, 1)}.{self.pick(_DIGITS, 4)}e-{self.pick(_DIGITS, 1)}", lambda: f"${self.pick(_DIGITS, 3)},{self.pick(_DIGITS, 3)}.{self.pick(_DIGITS, 2)}",
        ))()

    def prose(self) -> str:
        kind, w = self.r.randrange(40), self.word()
        if kind < 28:
            return w + self.r.choice(("", "", "", "", ",", "."))
        if kind < 31:
            return w.capitalize()
        if kind < 32:
            return w.upper() + self.r.choice(("!!", "", "?"))
        if kind < 33:
            return w + self.r.choice(("###", "%%%", "***", "$$$", "&&&", "..."))
        return self.lookalike()

    def no_secret(self) -> str:
        """Keywords that no secret follows."""
        r, key = self.r, self.r.choice(_KEYS + ("key", "id", "basic"))
        return r.choice((
            lambda: f"{key} {r.choice(('is', 'must be', 'was', 'has to be', 'should', 'can', 'will', 'for', 'of', 'and', 'or', 'in'))} {self.word()} ", lambda: f"the {key} {self.word()} ", lambda: f"{self.word()} {key}. ", lambda: f"{key}s ", lambda: f"a {key}: {self.word()} {self.word()} ", lambda: f"{key}, {self.word()} ",
            lambda: f"{r.choice(('the', 'a', 'of', 'key', 'note', self.word()))}{r.choice((': ', ' = ', ':', '='))}{self.prose()} ", lambda: f"{self.word(True)}={self.lookalike()} ", lambda: f"{self.word(True)}: {self.lookalike()} ", lambda: f"{key}={r.choice(('None', 'null', 'true', 'false', '***', '<' + self.word(True) + '>', '${' + self.word(True) + '}'))} ",
        ))()


def training_sentences(n: int = 1300, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts of invented words with the places of the secrets in them."""
    write, out = _Writer(seed), []
    r = write.r
    for _ in range(n):
        text, spans = "", []

        def put(secret: str) -> None:
            nonlocal text
            spans.append((len(text), len(text) + len(secret)))
            text += secret

        for _ in range(r.randint(4, 14)):
            text += write.prose() + r.choice((" ", " ", " ", " ", "\n"))
        kind = r.random()
        if kind < 0.18:
            text += r.choice(_KEYS) + r.choice(("=", ": ", " = ", ":", '": "', " = '", "=\""))
            put(write.key() if r.random() < 0.6 else write.choice_of_user())
        elif kind < 0.26:
            text += r.choice(("Authorization: Bearer ", "Bearer ", "key ", "Basic ", "X-Api-Key: ", "Authorization: Basic "))
            put(write.key())
        elif kind < 0.36:
            put(write.key())
        elif kind < 0.44:
            text += r.choice(("password", "passwd", "pwd", "passphrase", "secret", "token")) + r.choice((" is ", " was ", " is: ", " = ", ": ", " is '", ' is "', " is now "))
            secret = write.choice_of_user() if r.random() < 0.8 else write.key()
            put(secret if any(c.isdigit() or c in "-_" for c in secret) else secret + "9")
        elif kind < 0.52:
            text += f"{r.choice(('postgres', 'postgresql', 'mysql', 'redis', 'amqp', 'mongodb', 'https', 'ftp', 'jdbc:mysql'))}://{write.word(True)}:"
            put(write.choice_of_user() if r.random() < 0.6 else write.pick(_ALNUM, r.randint(8, 24)))
            text += f"@{write.name('-', 1, 2)}{r.choice(('.com', '.internal', ':5432', '.example.com:3306', ''))}/{write.word(True)}"
        elif kind < 0.56:
            text += f"-----BEGIN {r.choice(('', 'RSA ', 'EC ', 'OPENSSH '))}PRIVATE KEY-----\n"
            for _ in range(r.randint(2, 4)):
                put(write.pick(_ALNUM + "+/", r.choice((64, 64, 76))))
                text += "\n"
            text += "-----END PRIVATE KEY-----"
        else:
            for _ in range(r.randint(0, 3)):
                text += write.no_secret()
        text += r.choice((" ", " ", "\n", ". ", ", ")) if not spans else r.choice((" ", '" ', "'\n", "### ", ", ", "\n", "! ", ". "))
        for _ in range(r.randint(2, 10)):
            text += write.prose() + " "
        out.append((text, spans))
    return out


class Tagger:
    """Weights by feature name, and the exact tests that spare most decoding."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start
        zero = (0.0, 0.0, 0.0)
        self.edge: dict[str, bool] = {}
        self.plain: dict[tuple, bool] = {}
        best = lambda prefix: [max([0.0, *(w[y] - w[OUTSIDE] for f, w in weights.items() if f.startswith(prefix))]) for y in (BEGIN, INSIDE)]
        self.any_file = np.add(best("file:digits="), best("file:marks="))
        t = trans
        # The most that transitions can favour y over outside, whatever stands before and after.
        self.slack = [max(max(t[p, y] - t[p, OUTSIDE] for p in range(3)) + max(t[y, n] - t[OUTSIDE, n] for n in range(3)), (start[y] - start[OUTSIDE]) + max(t[y, n] - t[OUTSIDE, n] for n in range(3))) for y in (BEGIN, INSIDE)]
        # A neighbour lifts a token if its word's weight does so by more than this.
        self.lift = 0.5
        self.near = 3 * self.lift
        self.zero = zero

    def _gain(self, names, y: int) -> float:
        return sum((w := self.weights.get(f, self.zero))[y] - w[OUTSIDE] for f in names)

    def _lifts(self, w: str) -> bool:
        return any(self._gain((side + w,), y) > self.lift for side in ("p1=", "p2=", "n1=") for y in (BEGIN, INSIDE))

    def calm(self, chunk: str) -> bool:
        """Whether a chunk's tokens are outside for certain, given that no neighbour lifts them, and lift no neighbour."""
        known = self.edge.get(chunk)
        if known is None:
            known = self._calm_word(chunk)
            if known is None:
                known = self._test(chunk)
            if len(chunk) <= CACHE_CHARS:
                if len(self.edge) > CACHE_CHUNKS:
                    self.edge.clear()
                self.edge[chunk] = known
        return known

    def _calm_word(self, chunk: str) -> bool | None:
        """The answer for a word without a weight of its own: it follows from length, case and what trails; else None."""
        core = chunk.rstrip(".,;:!?#*%$&")
        if not core.isalpha() or len(core) < 2:
            return None
        case = 1 if core.islower() else 2 if core.isupper() else 3 if core[0].isupper() and core[1:].islower() else 0
        low = core.lower()
        if not case or low in KEYWORDS or low.startswith(PREFIXES):
            return None
        sign = (case, min(len(core), 300), chunk[len(core) :])
        known = self.plain.get(sign)
        if known is None:
            known = self._test(chunk)
            if len(self.plain) < CACHE_CHUNKS:
                self.plain[sign] = known
        return known

    def _test(self, chunk: str) -> bool:
        for token in TOKEN.findall(chunk):
            own = own_features(token)
            if self._lifts(word(token)) or any(self._gain(own, y) + self.any_file[y] + self.near + self.slack[y] >= 0 for y in (BEGIN, INSIDE)):
                return False
        return True

    def scores(self, tokens: list[str], i: int, of_file) -> list[float]:
        out = [0.0, 0.0, 0.0]
        for f in features(tokens, i, of_file):
            w = self.weights.get(f)
            if w:
                out[0] += w[0]
                out[1] += w[1]
                out[2] += w[2]
        return out

    def viterbi(self, emit: list[list[float]], first: bool) -> list[int]:
        """first: the sequence's start; else what stands before is outside."""
        before = self.start if first else self.trans[OUTSIDE]
        trans = self.trans.tolist()
        at, back = [before[y] + emit[0][y] for y in range(3)], []
        for e in emit[1:]:
            step = [max((at[p] + trans[p][y], -p) for p in range(3)) for y in range(3)]
            back.append([-s[1] for s in step])
            at = [step[y][0] + e[y] for y in range(3)]
        y = max(range(3), key=lambda k: at[k])
        out = [y]
        for b in reversed(back):
            y = b[y]
            out.append(y)
        return out[::-1]

    def tag(self, text: str, every: bool = False) -> list[tuple[str, int, int]]:
        """The spans that decoding finds. ``every``: decode all tokens at once, as the tests do to compare."""
        chunks = [(m.start(), m.end()) for m in _CHUNK.finditer(text)]
        tokens, at, live = [], [], []
        for a, b in chunks:
            calm = not every and self.calm(text[a:b])
            for m in TOKEN.finditer(text, a, b):
                tokens.append(m[0])
                at.append(m.span())
                live.append(not calm)
        of_file = file_features(text)
        todo = [i for i, x in enumerate(live) if x]
        out, done = [], 0
        while done < len(todo):
            a = b = todo[done]
            while done < len(todo) and todo[done] <= b + 5:
                b = todo[done]
                done += 1
            a, b = max(0, a - 2), min(len(tokens), b + 4)
            labels = self.viterbi([self.scores(tokens, i, of_file) for i in range(a, b)], a == 0)
            open_at = None
            for i, y in zip(range(a, b + 1), [*labels, OUTSIDE], strict=True):
                if y != INSIDE and open_at is not None:
                    out.append(("crf", at[open_at][0], at[i - 1][1]))
                    open_at = None
                if y == BEGIN or y == INSIDE and open_at is None:
                    open_at = i
        return out

    def suspicious(self, text: str) -> bool:
        """Whether any chunk of the text is not calm."""
        get = self.edge.get
        return any(get(c) is not True and not self.calm(c) for c in set(text.split()))

    def __reduce__(self):
        return _adopt, (self.weights, self.trans, self.start)


_workers: dict[bytes, Tagger] = {}


def _adopt(weights, trans, start) -> Tagger:
    """The worker's tagger of this model, with what it has remembered in earlier tasks."""
    key = trans.tobytes() + start.tobytes()
    if key not in _workers:
        _workers.clear()
        _workers[key] = Tagger(weights, trans, start)
    return _workers[key]


@lru_cache(maxsize=1)
def trained(rounds: int = 70, penalty: float = 0.02, least: int = 4) -> Tagger:
    """Maximum likelihood by forward-backward over all sentences at once, AdaGrad steps, L2 penalty.

    Features seen fewer than ``least`` times have no weight.
    """
    names: dict[str, int] = {}
    sentences = []
    for text, spans in training_sentences():
        found = list(TOKEN.finditer(text))
        tokens = [m[0] for m in found]
        labels = []
        for m in found:
            inside = next((s for s in spans if s[0] <= m.start() < s[1]), None)
            labels.append(OUTSIDE if inside is None else BEGIN if m.start() == inside[0] else INSIDE)
        of_file = file_features(text)
        sentences.append(([[names.setdefault(f, len(names)) for f in features(tokens, i, of_file)] for i in range(len(tokens))], labels))
    n, steps = len(sentences), max(len(s[1]) for s in sentences)
    sizes = np.array([len(s[1]) for s in sentences])
    gold = np.full((n, steps), OUTSIDE)
    cell, feature = [], []
    for k, (rows, labels) in enumerate(sentences):
        gold[k, : len(labels)] = labels
        for t, row in enumerate(rows):
            cell += [k * steps + t] * len(row)
            feature += row
    cell, feature = np.array(cell), np.array(feature)
    common = np.bincount(feature, minlength=len(names)) >= least
    cell, feature = cell[common[feature]], (np.cumsum(common) - 1)[feature[common[feature]]]
    names = {f: k for k, f in enumerate(f for f, i in names.items() if common[i])}
    valid = np.arange(steps) < sizes[:, None]
    w, trans, start = np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)
    square = [np.full_like(x, 1e-6) for x in (w, trans, start)]
    one_hot = np.eye(3)[gold] * valid[:, :, None]
    pairs = (valid[:, 1:, None, None] * one_hot[:, :-1, :, None] * one_hot[:, 1:, None, :]).sum((0, 1))

    def lse(x, axis):
        m = x.max(axis)
        return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))

    for _ in range(rounds):
        emit = np.stack([np.bincount(cell, w[feature, y], n * steps) for y in range(3)], 1).reshape(n, steps, 3)
        fore, back = np.zeros((n, steps, 3)), np.zeros((n, steps, 3))
        fore[:, 0] = start + emit[:, 0]
        for t in range(1, steps):
            fore[:, t] = np.where(valid[:, t, None], lse(fore[:, t - 1, :, None] + trans, 1) + emit[:, t], fore[:, t - 1])
        total = lse(fore[:, -1], 1)
        for t in range(steps - 2, -1, -1):
            back[:, t] = np.where(valid[:, t + 1, None], lse(trans + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        belief = np.exp(fore + back - total[:, None, None]) * valid[:, :, None]
        joint = np.exp(fore[:, :-1, :, None] + trans + (emit + back)[:, 1:, None, :] - total[:, None, None, None]) * valid[:, 1:, None, None]
        miss = (one_hot - belief).reshape(-1, 3)
        grads = (np.stack([np.bincount(feature, miss[cell, y], len(names)) for y in range(3)], 1) - penalty * w, pairs - joint.sum((0, 1)) - penalty * trans, (one_hot - belief)[:, 0].sum(0) - penalty * start)
        for x, g, s in zip((w, trans, start), grads, square, strict=True):
            s += g * g
            x += 0.5 * g / np.sqrt(s)
    tagger = Tagger({f: tuple(w[i].tolist()) for f, i in names.items()}, trans, start)
    del sentences, cell, feature, emit, fore, back, belief, joint, miss, grads, one_hot
    give_back()
    return tagger


def find(text: str, tagger: Tagger) -> tuple[list, list]:
    """Base spans, and the tagger's spans that overlap none of them."""
    base = base_spans(text)
    added = []
    if tagger.suspicious(text):
        added = [s for s in tagger.tag(text) if not overlaps(s, base)]
    return base, added


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document, see RESULT. No shuffle: a batch of texts at a time."""

    tagger = trained()

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = find(text, tagger)
                rows.append((key, *(sum(s[0] == k for s in base) for k in BASE), len(added), sha256_hex(encode_spans(base, KINDS)), encode_spans(base + added, KINDS)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    return texts(docs).mapInArrow(run, RESULT)


def masker(tagger: Tagger):
    """An Arrow function: texts with every secret replaced by its kind; nulls stay null."""

    def masked(column: pa.Array) -> pa.Array:
        out = pa.array([None if t is None else mask(t, sum(find(t, tagger), [])) for t in column.to_pylist()], pa.string())
        trim()
        return out

    return masked
