"""Personal data: exact base patterns, widened by a linear-chain conditional random field.

The field works on word shapes: every token of every whole text has its shape, those of its
neighbours, and the cue words last seen and seen next. It is trained here, from the small table
of marked lines in pii_lines.py, by maximum likelihood (forward-backward in numpy), and decoded by
Viterbi over padded numpy batches. All tokens of a batch of texts are scored at once. A token whose
score for "no personal data" is ahead of all others by more than any two transitions can win back
bears that label on the best path, whatever stands beside it; so the best path of a whole text
falls into those of the stretches between such tokens, and these are what Viterbi decodes. Spans of
the field are added where they overlap no base span; base spans always stay.

Defined results: a null or empty text has no finds; texts of any length are read whole, their
scores piece by piece; rows are kept one for one, so repeated rows, null ids and ties give equal
rows; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Covered, input_columns, map_texts, mix64
from lodestar.llm.pii_lines import TRAINING

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the field adds.
ADDED_KINDS = ("local_phone", "identity", "account", "birth_date", "person", "address")
KINDS = BASE_KINDS + ADDED_KINDS

IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SCHEMA = "doc_id bigint, finds array<struct<kind:string,start:int,end:int>>"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: a run of local-part characters, @, and a dotted domain."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        # no later match may reach back over this @ or into the match
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, failing matches dropped."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return found
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


# --- the field ---------------------------------------------------------------------------

#: Cue words by what they announce, in lower case. Fixed values.
CUES = {
    1: "phone tel mobile call fax cell telephone telefon handy rufnummer téléphone tél portable teléfono móvil",
    2: "ssn social security identity national passport personalausweis steuernummer reisepass sécurité sociale passeport dni pasaporte",
    3: "iban account acct bank konto kontonummer compte bancaire banque cuenta banco",
    4: "born birth birthday dob geboren geburtsdatum geb né née naissance nacido nacida nacimiento",
    5: "mr mrs ms dr name herr frau monsieur madame mme señor señora nombre",
    6: "street road avenue lane rue calle avenida address adresse dirección lives wohnt habite vive",
}
#: Endings that make a word a street's name, in lower case. Fixed values.
STREETS = ("straße", "strasse", "weg", "platz")
#: Marks with a shape of their own, which is 20 and their place; all others are one shape. Fixed values.
MARKS = "-().:/+,@"
N_SHAPES, N_LABELS, N_CUES = 32, 1 + len(ADDED_KINDS), 1 + len(CUES)
STREET, OTHER_MARK = 16, 31
#: Shapes are read at these distances from a token. Cues count for so many tokens after and before them.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
BEHIND, AHEAD = 6, 3
BLOCKS = [N_SHAPES * k for k in range(len(OFFSETS) + 1)]
#: Last come the two cues, and whether a digit or a capital stands within the offsets.
N_FEATURES, N_PER_TOKEN = BLOCKS[-1] + 2 * N_CUES + 4, len(OFFSETS) + 3

_GAP, _DIGIT, _LOWER, _UPPER, _MARK = range(5)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point its class, its shape as a mark, and its lower case (itself where that is no single one)."""
    every = [chr(c) for c in range(0x110000)]
    kind = np.full(len(every), _MARK, np.uint8)
    for i, c in enumerate(every):
        if c.isspace():
            kind[i] = _GAP
        elif c.isalpha():
            kind[i] = _UPPER if c.isupper() else _LOWER
    kind[48:58] = _DIGIT
    mark = np.full(len(every), OTHER_MARK, np.uint8)
    for i, c in enumerate(MARKS):
        mark[ord(c)] = 20 + i
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(every)], np.uint32)
    return kind, mark, lower


def _letters(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix64(code.astype(np.uint64) * _ODD + place.astype(np.uint64))


@functools.lru_cache(1)
def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the cue words, and what each announces."""
    of = {}
    for cue, words in CUES.items():
        for w in words.split():
            code = np.frombuffer(w.encode("utf-32-le"), np.uint32)
            of[int(_letters(code, np.arange(len(code))).sum())] = cue
    keys = np.array(sorted(of), np.uint64)
    return keys, np.array([of[int(k)] for k in keys], np.int32)


class Tokens:
    """The tokens of some texts: runs of digits, runs of letters, and single marks.

    owner (the text), start and end (code points within it), shape, behind and ahead (cues).
    """

    def __init__(self, texts: list[str]) -> None:
        kind_of, mark_of, lower_of = _characters()
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.zeros(len(code) + 1, bool)
        edges[np.concatenate([[0], np.cumsum(sizes)])] = True
        kind = kind_of[code]
        group = np.where(kind == _UPPER, _LOWER, kind)
        first = edges[:-1] | (group == _MARK)
        first[1:] |= group[1:] != group[:-1]
        last = np.append(first[1:], True)
        solid = group != _GAP
        start, end = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
        size = end - start
        uppers = np.concatenate([[0], np.cumsum(kind == _UPPER, dtype=np.int32)])
        upper = uppers[end] - uppers[start]
        what, begins = group[start], kind[start]
        letters = np.where(upper == size, np.where(size <= 2, 12, 13), np.where(begins == _UPPER, 14, 15))
        self.shape = np.where(what == _DIGIT, np.minimum(size, 11), np.where(what == _MARK, mark_of[code[start]], letters)).astype(np.uint8)
        words = np.flatnonzero(what == _LOWER)
        cue = np.zeros(len(start), np.int32)
        if len(words):
            inside = np.flatnonzero(group == _LOWER)
            low = lower_of[code[inside]]
            n = size[words]
            at = np.cumsum(n) - n
            keys = np.add.reduceat(_letters(low, np.arange(len(low)) - np.repeat(at, n)), at)
            known, announces = _cue_table()
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            cue[words] = np.where(known[place] == keys, announces[place], 0)
            for ending in STREETS:
                some = np.flatnonzero(n > len(ending))
                for back, c in enumerate(reversed(ending), 1):
                    some = some[low[at[some] + n[some] - back] == ord(c)]
                self.shape[words[some]] = STREET
                cue[words[some]] = 6
        self.owner = np.searchsorted(np.cumsum(sizes), start, "right")
        before = np.cumsum(sizes) - sizes
        self.start, self.end = start - before[self.owner], end - before[self.owner]
        # a text's tokens are a stretch of all tokens
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))
        self.stop = np.append(self.first[1:], len(start))
        self.behind, self.ahead = self._cues(cue)

    def _cues(self, cue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.arange(len(cue)), len(cue)
        last = np.maximum.accumulate(np.where(cue > 0, at, -1)) if n else at
        next_ = np.minimum.accumulate(np.where(cue > 0, at, n)[::-1])[::-1] if n else at
        near = (last >= self.first[self.owner]) & (at - last < BEHIND)
        behind = np.where(near, cue[np.maximum(last, 0)], 0) if n else cue
        soon = (next_ < self.stop[self.owner]) & (next_ - at <= AHEAD)
        ahead = np.where(soon, cue[np.minimum(next_, max(n - 1, 0))], 0) if n else cue
        return behind, ahead

    def __len__(self) -> int:
        return len(self.owner)

    def features(self, low: int, high: int) -> np.ndarray:
        """Feature numbers of the tokens low to high; shape 0 stands beyond a text's ends."""
        at = np.arange(low, high)
        first, stop = self.first[self.owner[low:high]], self.stop[self.owner[low:high]]
        out = np.empty((high - low, N_PER_TOKEN), np.int32)
        digit, capital = np.zeros(high - low, bool), np.zeros(high - low, bool)
        for k, o in enumerate(OFFSETS):
            there = (at + o >= first) & (at + o < stop)
            shape = np.where(there, self.shape[np.clip(at + o, 0, len(self) - 1)], 0)
            out[:, k] = shape + BLOCKS[k]
            digit |= (shape >= 1) & (shape <= 11)
            capital |= (shape >= 12) & (shape <= 14)
        out[:, -3] = self.behind[low:high] + BLOCKS[-1]
        out[:, -2] = self.ahead[low:high] + BLOCKS[-1] + N_CUES
        out[:, -1] = 2 * digit + capital + BLOCKS[-1] + 2 * N_CUES
        return out

    def scores(self, low: int, high: int, emit: np.ndarray) -> np.ndarray:
        x = self.features(low, high)
        out = emit[x[:, 0]]
        for k in range(1, x.shape[1]):
            out += emit[x[:, k]]
        return out


def marked(lines: str) -> list[tuple[str, int, int, int]]:
    """(text, label, start, end) of marked lines; label 0 where nothing is marked."""
    out = []
    for line in lines.strip().splitlines():
        m = re.search(r"\[(\w+) ([^\]]+)\]", line)
        if m:
            out.append((line[: m.start()] + m[2] + line[m.end() :], 1 + ADDED_KINDS.index(m[1]), m.start(), m.start() + len(m[2])))
        else:
            out.append((line, 0, 0, 0))
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis)


def likelihood(x: np.ndarray, y: np.ndarray, mask: np.ndarray, emit: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of padded sequences, and its gradients by emissions and transitions."""
    n, width = y.shape
    score = emit[x].sum(axis=2)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for i in range(1, width):
        new = _logsumexp(alpha[:, i - 1, :, None] + step, 1) + score[:, i]
        alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
    for i in range(width - 2, -1, -1):
        new = _logsumexp(step + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(mask[:, i + 1, None], new, 0)
    z = _logsumexp(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    edge = np.exp(alpha[:, :-1, :, None] + step + (score + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    apart = (np.eye(emit.shape[1])[y] * mask[:, :, None] - node) / n
    where = x.reshape(-1)
    g_emit = np.stack([np.bincount(where, np.repeat(a.ravel(), x.shape[2]), len(emit)) for a in np.moveaxis(apart, 2, 0)], axis=1)
    g_step = -edge.sum(axis=(0, 1)) / n
    both = mask[:, 1:]
    np.add.at(g_step, (y[:, :-1][both], y[:, 1:][both]), 1 / n)
    path = np.take_along_axis(score, y[:, :, None], 2)[:, :, 0]
    value = (path * mask).sum() + (step[y[:, :-1], y[:, 1:]] * both).sum() - z.sum()
    return float(value) / n, g_emit, g_step


@functools.lru_cache(1)
def trained(steps: int = 150, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights, fitted to the labelled table by Adam on the likelihood."""
    lines = marked(TRAINING)
    tokens = Tokens([t for t, *_ in lines])
    sizes = tokens.stop - tokens.first
    n, width = len(lines), int(sizes.max())
    mask = np.arange(width) < sizes[:, None]
    x, y = np.zeros((n, width, N_PER_TOKEN), np.int32), np.zeros((n, width), np.int64)
    x[mask] = tokens.features(0, len(tokens))
    label, low, high = (np.array(c)[tokens.owner] for c in list(zip(*lines))[1:])
    y[mask] = np.where((tokens.start >= low) & (tokens.end <= high), label, 0)
    emit, step = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    moments = [np.zeros_like(p) for p in (emit, step, emit, step)]
    for t in range(1, steps + 1):
        _, g_emit, g_step = likelihood(x, y, mask, emit, step)
        for k, (p, g) in enumerate(((emit, decay * emit - g_emit), (step, decay * step - g_step))):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            p -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 2] / (1 - 0.99**t)) + 1e-8)
    return emit, step


#: Tokens scored at once, and those of one decoded batch, padding included (a longer stretch is a batch of its own).
SCORED, TOKENS = 1 << 17, 1 << 16


def viterbi(stretches: list[np.ndarray], begins: np.ndarray, ends: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    """The best labels of each stretch of scores; stretches of like length are decoded together.

    begins, ends: whether a text begins or ends there; otherwise a token of label 0 stands beyond.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
    at = 0
    while at < len(order):
        longest = 2 * len(stretches[order[at]]) + 8
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(stretches[order[stop]]) <= TOKENS and len(stretches[order[stop]]) <= longest:
            stop += 1
        some = np.array(order[at:stop])
        lengths = np.array([len(stretches[i]) for i in some])
        n, width = len(some), int(lengths.max())
        score = np.zeros((n, width, step.shape[0]))
        score[np.arange(width) < lengths[:, None]] = np.concatenate([stretches[i] for i in some])
        score[:, 0] += np.where(begins[some][:, None], 0, step[0])
        score[np.arange(n), lengths - 1] += np.where(ends[some][:, None], 0, step[:, 0])
        best = score[:, 0]
        back = np.zeros((width, n, step.shape[0]), np.int8)
        for i in range(1, width):
            through = best[:, :, None] + step
            came = through.argmax(axis=1)
            live = (i < lengths)[:, None]
            back[i] = np.where(live, came, np.arange(step.shape[0]))
            best = np.where(live, np.take_along_axis(through, came[:, None, :], 1)[:, 0] + score[:, i], best)
        path = np.zeros((n, width), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for i in range(width - 1, 0, -1):
            path[:, i - 1] = back[i][np.arange(n), path[:, i]]
        for k, i in enumerate(some.tolist()):
            out[i] = path[k, : lengths[k]]
        at = stop
    return out


def decoded(tokens: Tokens, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The label of every token on its text's best path."""
    emit, step = weights
    margin = np.maximum(0, (step - step[:, :1]).max(axis=0)) + np.maximum(0, (step - step[:1]).max(axis=1))
    labels = np.zeros(len(tokens), np.int64)
    open_, kept = [], []
    for low in range(0, len(tokens), SCORED):
        score = tokens.scores(low, min(low + SCORED, len(tokens)), emit)
        unsure = np.flatnonzero((score[:, :1] - score <= margin)[:, 1:].any(axis=1))
        open_.append(low + unsure)
        kept.append(score[unsure])
    if not open_:
        return labels
    at, score = np.concatenate(open_), np.concatenate(kept)
    if not len(at):
        return labels
    owner = tokens.owner[at]
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1
    begins, ends = at[first] == tokens.first[owner[first]], at[last] == tokens.stop[owner[last]] - 1
    labels[at] = np.concatenate(viterbi(np.split(score, cuts), begins, ends, step))
    return labels


def _plausible(kind: int, span: str) -> bool:
    """Whether a span has as many digits as its kind needs."""
    digits = sum(c.isdigit() for c in span)
    low, high = {1: (7, 15), 2: (8, 15), 3: (8, 34), 4: (3, 8), 5: (0, 0), 6: (1, 5)}[kind]
    return low <= digits <= high and (kind not in (5, 6) or any(c.isupper() for c in span))


def field_spans(texts: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(text, kind index, start, end) of the field's spans: runs of tokens with one label."""
    tokens = Tokens(texts)
    labels = decoded(tokens, weights)
    if not len(labels):
        return []
    first = np.flatnonzero(np.append(True, (np.diff(labels) != 0) | (np.diff(tokens.owner) > 0)))
    last = np.append(first[1:], len(labels)) - 1
    named = np.flatnonzero(labels[first])
    found = zip(tokens.owner[first[named]].tolist(), labels[first[named]].tolist(), tokens.start[first[named]].tolist(), tokens.end[last[named]].tolist())
    return [(n, len(BASE_KINDS) + k - 1, s, e) for n, k, s, e in found if _plausible(k, texts[n][s:e])]


def find_in_texts(texts: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) per text, by kind, then start."""
    finds = [base_spans(t) if t else [] for t in texts]
    taken: dict[int, Covered] = {}
    for n, kind, s, e in field_spans(texts, weights):
        if n not in taken:
            taken[n] = Covered([(a, b) for _, a, b in finds[n]])
        if not taken[n].meets(s, e):
            finds[n].append((kind, s, e))
    return [sorted(x) for x in finds]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its finds (kind, start, end in code points)."""
    weights = trained()  # a few kB, whatever the input

    def scan(batch, texts):
        rows = find_in_texts(texts, weights)
        return {
            "doc_id": batch.column("doc_id"),
            "finds": [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in rows],
        }

    return map_texts(input_columns(docs, id_col, text_col), "text", scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base finds, and all finds as one string."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("finds", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("finds", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("finds", text), ",").alias("spans"),
        (F.size("finds") - F.size(base)).cast("bigint").alias("n_added"),
    )
