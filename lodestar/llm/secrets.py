"""Secret scans with multipart credential linking.

Strong finds are what the base patterns match. Beyond them a text may hold *parts* of a
credential that mean little alone: an account identifier, an opaque token, an endpoint. Parts
are interval-joined within scopes: a scope is a paragraph (text between blank lines), and two
parts meet if the gap between their intervals is at most `reach` code points. A weak part is
reported only if a complementary part (strong or weak) meets it.

Parts may nest: a signed address holds its secret, as may an identifier's line. Within a role (secret,
identifier, endpoint) parts do not overlap; an identifier's own value is no secret; and two parts that
overlap are one piece of text and no complements of one another, so an address with an opaque path links to nothing by
itself. A token is opaque if it has letters and digits, many different characters, and either both cases or letters and
digits in turns; words joined by hyphens with a number at the end are not.

All parts of a text are in that text, so the join runs where the text is: a sorted interval
join (binary search over part positions) of a whole batch of texts, without a shuffle.

Defined results: a null or empty text has no finds; texts and tokens of any length are read
whole; rows are kept one for one, so repeated rows, null ids and ties give equal rows; of parts of one role that
overlap the strong one stays, then the one that starts first, of equal starts the longest; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Covered, input_columns, map_texts

#: Kinds in the order in which equal starts are listed; the last three are the linked weak ones.
KINDS = ("assign", "access", "hex", "key", "secret", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"[0-9a-f]{24,}+")
ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,11}://[A-Za-z0-9.@:_/?&=%~-]{4,}+")
ENDPOINT_LABEL = re.compile(r"""\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:-]{4,}+)""", re.I | re.A)
PREFIXED_ID = re.compile(r"\b(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{12,}+")
LABELLED_ID = re.compile(r"""\b(?:access|client|account|user)[_-]?(?:key_?)?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}+""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
NESTED = re.compile(r"(?<=[/=])[A-Za-z0-9+_%-]{20,}+(?![A-Za-z0-9+_%-])")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

SCHEMA = "doc_id bigint, finds array<struct<kind:string,start:int,end:int>>"


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base finds: leftmost, non-overlapping per kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


#: How often letters and digits take turns in a token of one case.
TURNS = 4


def _opaque(token: str) -> bool:
    """Looks like a random token: letters and digits, many distinct characters, mixed in case or in turns."""
    digits = [c.isdigit() for c in token if c.isalnum()]
    if not any(digits) or all(digits) or len(set(token)) < 12:
        return False
    both = any(c.isupper() for c in token) and any(c.islower() for c in token)
    return both or sum(a != b for a, b in zip(digits, digits[1:])) >= TURNS


def _apart(parts: list[tuple[int, int, int]], taken: Covered) -> list[tuple[int, int, int]]:
    """Parts that meet neither what is taken nor one that comes before them."""
    found: list[tuple[int, int, int]] = []
    for s, k, e in sorted(parts, key=lambda x: (x[0], -x[2], x[1])):
        if not taken.meets(s, e) and not (found and found[-1][2] > s):
            found.append((s, k, e))
    return found


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak identifiers and secrets beside the strong finds and one another, and endpoints beside one another.

    A pattern is tried only where a text has the characters that each of its matches holds, and
    secrets only where something is there that could complement them.
    """
    endpoints = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    ids = [(m.start(), 3, m.end()) for m in PREFIXED_ID.finditer(text)] if "A" in text else []
    if ":" in text or "=" in text:
        endpoints += [(m.start(), 5, m.end()) for m in ENDPOINT_LABEL.finditer(text) if "." in m[1] or ":" in m[1]]
        ids += [(m.start(), 3, m.end()) for m in LABELLED_ID.finditer(text)]
    secrets = []
    if endpoints or ids or any(k == 1 for _, k, _ in strong):
        secrets = [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if _opaque(m[0])]
        # in an address a token ends where a part of the path or of the query does
        for s, _, e in endpoints:
            secrets += [(s + m.start(), 4, s + m.end()) for m in NESTED.finditer(text[s:e]) if _opaque(m[0])]
    beside = _apart([*ids, *secrets], Covered([(s, e) for s, _, e in strong]))
    return sorted([*beside, *_apart(endpoints, Covered([]))])


def _met(starts: np.ndarray, ends: np.ndarray, of: np.ndarray, other: np.ndarray, reach: int) -> np.ndarray:
    """For intervals `of`, how many intervals of `other` lie within reach without overlapping (interval join)."""
    if not len(of) or not len(other):
        return np.zeros(len(of), np.int64)
    s, e = np.sort(starts[other]), np.sort(ends[other])
    # intervals that start before a place, less those that end before one
    near = np.searchsorted(s, ends[of] + reach, "right") - np.searchsorted(e, starts[of] - reach, "left")
    return near - (np.searchsorted(s, ends[of], "left") - np.searchsorted(e, starts[of], "right"))


def link(parts: list[tuple[int, int, int, int]], reach: int) -> list[bool]:
    """Which parts (scope, start, kind, end) meet a complementary part in their scope.

    Scopes become disjoint stretches of one axis, further apart than any reach.
    """
    if not parts:
        return []
    scope, start, kind, end = (np.array(x, np.int64) for x in zip(*parts))
    stretch = end.max() + 2 * reach + 2
    _, dense = np.unique(scope, return_inverse=True)
    start, end = start + dense * stretch, end + dense * stretch
    secret, ident, point = np.isin(kind, (0, 2, 4)), np.isin(kind, (1, 3)), kind == 5
    linked = np.zeros(len(parts), bool)
    for of, others in ((secret, ident | point), (ident, secret), (point, secret)):
        i = np.flatnonzero(of)
        linked[i] = _met(start, end, i, np.flatnonzero(others), reach) > 0
    return linked.tolist()


def scan_texts(texts: list[str], reach: int = 256) -> list[list[tuple[int, int, int]]]:
    """All finds of each text, sorted by start, then kind."""
    finds, parts, owner = [], [], []
    base = 0
    for n, text in enumerate(texts):
        strong = strong_spans(text) if text else []
        finds.append(strong)
        weak = weak_parts(text, strong) if text else []
        if weak:
            cuts = [m.start() for m in BLANK_LINE.finditer(text)]
            for s, k, e in [*strong, *weak]:
                parts.append((base + int(np.searchsorted(cuts, s)), s, k, e))
                owner.append(n)
            base += len(cuts) + 1
    for (_, s, k, e), n, linked in zip(parts, owner, link(parts, reach)):
        if linked and k >= 3:
            finds[n].append((s, k, e))
    return [sorted(x) for x in finds]


def find_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 256) -> DataFrame:
    """One row per input row: doc_id and its finds (kind, start, end in code points)."""

    def scan(batch, texts):
        rows = scan_texts(texts, reach)
        return {
            "doc_id": batch.column("doc_id"),
            "finds": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in rows],
        }

    return map_texts(input_columns(docs, id_col, text_col), "text", scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base finds, and all finds as one string."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("finds", lambda x: x["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("finds", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("finds", text), ",").alias("spans"),
        (F.size("finds") - F.size(base)).cast("bigint").alias("n_linked"),
    )
