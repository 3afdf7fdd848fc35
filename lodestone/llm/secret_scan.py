"""Secret scans: fixed patterns, and an assignment-aware lexer with constant propagation.

The lexer reads source and configuration syntax as name-value pairs.  A value is a
literal, a name, or several of these joined by ``+``; names are followed to the literals
they stand for.  A literal is a secret if a name with a sensitive word in it receives it
and it looks like a credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_store import slices

KINDS = ("assign", "access", "hex", "literal")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of a target's name (several in a row for some), and how strongly each says that the value is secret.
SENSITIVE = {
    ("password",): 3, ("passwords",): 3, ("passwd",): 3, ("passphrase",): 3, ("pwd",): 2, ("secret",): 3, ("secrets",): 3, ("token",): 2, ("apikey",): 3, ("api", "key"): 3,
    ("private", "key"): 3, ("privatekey",): 3, ("access", "key"): 3, ("accesskey",): 3, ("credential",): 2, ("credentials",): 2, ("auth",): 1, ("signing",): 1, ("encryption",): 1,
}
#: Words that end in one of these count as it: names are often written without a border.
COMPOUND = ("password", "passwd", "passphrase", "apikey")
#: Words behind a sensitive one that leave it what the name is about, as does all behind one of LINKS; before any other word it only describes.
STILL = frozenset("value val string str text key prod production dev test staging live main default old new base".split())
LINKS = frozenset("of for from to in by with".split())
#: Texts without a match have no sensitive name.
SENSED = re.compile(r"passw|passphrase|pwd|secret|token|(?:api|private|access)[_.\-]?key|credential|auth|signing|encryption")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Values that say where something is, and words joined by hyphens or dots with at most a number each.
PLACE = re.compile(r"[a-z][a-z0-9+.-]*://(?![^/@]*:[^/@]*@)|(?:~|\.{1,2})?/[\w.-]+/|[A-Za-z]:\\\\?")
WORDY = re.compile(r"[A-Za-z]{2,}[0-9]{0,4}(?:[-_.][A-Za-z]{2,}[0-9]{0,4})+")
NEEDED = 4
MIN_LITERAL = 8
#: How often a name's literals count in one value, should names repeat each other.
REPEATS = 64
PLACEHOLDER = re.compile(r"(?i)(change.?me|example|placeholder|your[_-]|xxxx|\*\*\*\*|\$\{|%\(|dummy|todo)")

# No length is limited: possessive repeats never go back, and a name of any length starts only where a run of its characters does.
_STRING = r'''"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+\''''
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.\-]*+"
_BARE_NAME = rf"(?<![A-Za-z0-9_$.\-]){_NAME}|[A-Za-z_$][A-Za-z0-9_$.\-]{{0,127}}+"
PAIR = re.compile(
    rf"""(?P<target>(?:"{_NAME}"|'{_NAME}'|{_BARE_NAME}))(?:\[["'](?P<key>{_NAME})["']\])?[\x20\t]*(?::=|=>|=(?![=>])|:(?!=))[\x20\t]*"""
    rf"""(?P<value>(?:{_STRING}|[A-Za-z0-9_$+/=.\-]++)(?:[\x20\t]*\+[\x20\t]*(?:{_STRING}|{_NAME}))*+)"""
)
TERM = re.compile(rf"(?P<string>{_STRING})|(?P<bare>[A-Za-z0-9_$/=.\-]+(?:\+[A-Za-z0-9_$/=.\-]+)*)")


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    found = []
    if ("=" in text or ":" in text) and any(w in low for w in BASE_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def weight(name: str) -> int:
    """How strongly a name's words say that its value is secret.  Words count whole: a tokenizer or an author has none."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    best = 0
    for at in range(len(words)):
        for size in (1, 2):
            own = SENSITIVE.get(tuple(words[at : at + size]), 3 if size == 1 and words[at].endswith(COMPOUND) else 0)
            behind = words[at + size :]
            if own and behind and behind[0] not in LINKS and not all(w in STILL or w.isdigit() for w in behind):
                own -= 3
            best = max(best, own)
    return best


def looks(value: str) -> int:
    """How much a literal looks like a credential: mixed character classes, entropy, no place, no words of a placeholder."""
    if len(value) < MIN_LITERAL or len(set(value)) < 5 or re.search(r"\s", value) or PLACEHOLDER.search(value) or 0 <= value.find("<") < value.rfind(">") or PLACE.match(value):
        return -9
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return (kinds >= 2) + (entropy >= 3.0) + (n >= 16) - 2 * bool(WORDY.fullmatch(value))


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int, str]]]]:
    """Name-value pairs: the target, and terms (kind, start, end, value) that are joined to its value."""
    for m in PAIR.finditer(text):
        target = m["target"].strip("\"'") + ("." + m["key"] if m["key"] else "")
        terms = []
        for t in TERM.finditer(text, m.start("value"), m.end("value")):
            if t["string"] is not None:
                terms.append(("string", t.start() + 1, t.end() - 1, t["string"][1:-1]))
            else:
                terms.append(("bare", t.start(), t.end(), t["bare"]))
        yield target, terms


def leaves(parts: list) -> list[tuple[int, int, str]]:
    """The literals of ``parts``, in order: (start, end, value), or lists of parts that names stand for.

    Every list is opened, but no more than REPEATS times, so all literals are there and
    names that double each other cost no more than that many times their number.
    """
    found, opened, left = [], Counter(), parts[::-1]
    while left:
        part = left.pop()
        if isinstance(part, tuple):
            found.append(part)
        elif opened[id(part)] < REPEATS:
            opened[id(part)] += 1
            left += part[::-1]
    return found


def literal_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    if not SENSED.search(low):
        return []
    known: dict[str, list] = {}
    found = set()
    for target, terms in pairs(text):
        # constants stand for the literals they were last given; unknown names and bare values for themselves
        known[target] = [known[value] if kind == "bare" and value in known else (start, end, value) for kind, start, end, value in terms]
        if w := weight(target):
            parts = leaves(known[target])
            if w + looks("".join(p[2] for p in parts)) >= NEEDED:
                found.update((s, e, "literal") for s, e, v in parts if e > s)
    return sorted(found)


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans in code points, ends exclusive, by start and then by kind as listed; base ones first among equals.

    A literal that a base span covers adds nothing and is left out.
    """
    low = text.lower()
    base = base_spans(text, low)
    more = [x for x in literal_spans(text, low) if not any(s <= x[0] and x[1] <= e for s, e, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row, texts whole.

    A null text is empty: no spans, the hash of the empty string.  Row by row, so repeated
    rows, ties, empty tables and extra columns need no care.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ["doc_id", "text"]):
            out: list[list] = [[] for _ in names]
            for doc_id, raw in rows:
                found = spans((raw or b"").decode("utf-8", "replace"))
                base = [x for x in found if x[2] != "literal"]
                count = Counter(x[2] for x in base)
                values = (doc_id, count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found))
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.string()] * 2)], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
