"""Units of text that a byte-level BPE with the usual word pattern never joins.

The pattern attaches a single space to the visible characters that follow it. So a space
between two characters that aren't white space always starts a new pre-token, and a text may
be cut before each such space: the ids of the text are the ids of its units, one after the
other. Units repeat far more often than texts do; each task encodes a unit once and remembers
it (up to a bound).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lodestar.llm.common import mix64

#: A cut: one space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ragged(unit: str) -> bool:
    """Whether cutting at every space has put white space at this unit's edge."""
    return not unit or unit[0].isspace() or unit[-1].isspace()


def cut(text: str, known) -> tuple[list[str], set[str]]:
    """The units of a text, and those of them that `known` lacks.

    All units but the first follow a space, which is left out. Known units are never ragged,
    so only new ones are looked at.
    """
    if not text:
        return [], set()
    parts = text.split(" ")
    new = {u for u in set(parts) if u not in known}
    if any(map(_ragged, new)):
        parts = CUT.split(text)
        new = {u for u in set(parts) if u not in known}
    return parts, new


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which units start, texts' first ones included (empty texts have none).

    Works on UTF-8 bytes. A space is a cut if both neighbours belong to the same text and
    neither is, or may be, white space: ASCII white space, or characters whose first byte is
    one of those of the other white-space characters. Leaving a cut out is always allowed.
    """
    size = len(data)
    plain = np.ones(256, bool)
    plain[[*range(9, 14), *range(0x1C, 0x21)]] = False
    follows = plain.copy()
    follows[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < size - 1)]
    before, before2, before3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (before >= 0x80) & ((before2 == 0xC2) | ((before2 >= 0x80) & (before3 >= 0xE1) & (before3 <= 0xE3)))
    ok = plain[before] & ~wide & follows[data[at + 1]]
    edges = np.zeros(size + 1, bool)
    edges[offsets] = True
    at = at[ok]
    at = at[~edges[at] & ~edges[at + 1]]
    edges[at] = True
    return np.flatnonzero(edges[:size])


class Numbers:
    """64-bit keys to their numbers 0, 1, ...: open addressing in two arrays, a batch at a time.

    A dict of as many entries takes several times the memory.
    """

    def __init__(self, most: int) -> None:
        self.size, self.most = 0, most
        slots = 1 << max(4, int(1.5 * most).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.numbers = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), keys & self.mask
        while len(todo):
            number = self.numbers[slot]
            same = (number >= 0) & (self.keys[slot] == keys[todo])
            out[todo[same]] = number[same]
            on = (number >= 0) & ~same
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Numbers for different keys that aren't known yet."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        todo, slot = np.arange(len(keys)), keys & self.mask
        while len(todo):
            free = np.flatnonzero(self.numbers[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]  # one key for each free slot
            self.keys[slot[won]], self.numbers[slot[won]] = keys[todo[won]], numbers[todo[won]]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        self.size += len(keys)


def _before(sizes: np.ndarray) -> np.ndarray:
    """Where each of some runs begins, one after another."""
    return np.cumsum(sizes) - sizes


class Pool:
    """Runs of values, one after another, by number; arrays grow by doubling."""

    def __init__(self, dtype: type) -> None:
        self.values, self.ends = np.zeros(1 << 20, dtype), np.zeros(1 << 18, np.int64)
        self.n, self.used = 0, 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.values) < self.used + len(values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while len(self.ends) < self.n + len(sizes) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.used : self.used + len(values)] = values
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.n, self.used = self.n + len(sizes), self.used + len(values)

    def with_more(self, values: np.ndarray, sizes: np.ndarray) -> Pool:
        """Another pool that has further runs after these."""
        out = object.__new__(Pool)
        out.values = np.concatenate([self.values[: self.used], values])
        out.ends = np.concatenate([self.ends[: self.n + 1], self.used + np.cumsum(sizes)])
        out.n, out.used = self.n + len(sizes), self.used + len(values)
        return out

    def places(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginning and length of the runs of those numbers."""
        begin = self.ends[number]
        return begin, self.ends[number + 1] - begin


class Encoder:
    """Texts to ids by the tokenizers library, unit by unit, on whole Arrow columns.

    Units are found by 64-bit hashes, for a whole column at once, and compared byte by byte with the
    unit that was remembered under the hash; those that differ from it are encoded on their own. New
    ones are encoded, run together, by one call of the library; the ids of a run are cut
    at the units' ends by the byte lengths of the tokens. Up to `limit` units are remembered, with their
    bytes; later ones are known during their batch alone.
    """

    #: Units encoded as one text.
    RUN = 4000

    def __init__(self, path: str, limit: int = 1_300_000) -> None:
        self.tok = tokenizer(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = self.tok.get_added_tokens_decoder()
        self.byte_lengths = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            # a byte-level vocabulary writes every byte as one character
            self.byte_lengths[i] = len(added[i].content.encode()) if i in added else len(token)
        rng = np.random.default_rng(20240229)
        self.letter = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, np.uint64)
        at, byte = np.divmod(np.arange(self.NEAR << 8, dtype=np.uint64), np.uint64(256))
        self.near = self._drawn(byte, at)
        self.known = Numbers(limit)
        self.limit = limit
        self.pool, self.letters = Pool(self.dtype), Pool(np.uint8)  # ids and bytes of the remembered units

    #: Places within a unit whose numbers are looked up.
    NEAR = 64

    def _drawn(self, byte: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each byte at each place of a unit, as if drawn at random for the two together."""
        return mix64(self.letter[byte] ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the numbers drawn for (byte, place). Units with equal sums can be made: they only find a place to compare."""
        at = np.arange(len(data)) - np.repeat(starts, ends - starts)
        drawn = self.near[(np.minimum(at, self.NEAR - 1) << 8) | data]
        far = np.flatnonzero(at >= self.NEAR)
        drawn[far] = self._drawn(data[far], at[far])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(drawn, out=sums[1:])
        return mix64(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))

    def _encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the given units, one after another, and how many each has."""
        spaced = data[starts] == 0x20
        ids: list = [None] * len(starts)
        raw = data.tobytes()
        rest = np.flatnonzero(~spaced)
        firsts = [raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        for i, e in zip(rest.tolist(), self.tok.encode_batch_fast(firsts, add_special_tokens=False)):
            ids[i] = np.array(e.ids, self.dtype)
        joined = np.flatnonzero(spaced)
        for at in range(0, len(joined), self.RUN):
            run = joined[at : at + self.RUN]
            text = b"".join([raw[a:b] for a, b in zip(starts[run].tolist(), ends[run].tolist())]).decode()
            found = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.searchsorted(np.cumsum(self.byte_lengths[found]), np.cumsum(ends[run] - starts[run]))
            for i, piece in zip(run.tolist(), np.split(found, cuts[:-1] + 1)):
                ids[i] = piece
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate([*ids, np.zeros(0, self.dtype)]), sizes

    @staticmethod
    def _differing(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, letters: np.ndarray, begin: np.ndarray, known_sizes: np.ndarray) -> np.ndarray:
        """Which units aren't, byte by byte, the ones that were remembered under their hashes."""
        at = np.arange(len(data)) + np.repeat(begin - starts, sizes)
        np.minimum(at, len(letters) - 1, out=at)  # only beyond a unit of another length
        wrong = np.flatnonzero(letters[at] != data)
        return np.union1d(np.searchsorted(starts, wrong, side="right") - 1, np.flatnonzero(sizes != known_sizes))

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another (end_id after each), and how many each has."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        starts = unit_starts(data, offsets)
        if not len(starts):
            return np.full(n * (end_id is not None), end_id or 0, self.dtype), np.full(n, int(end_id is not None))
        ends = np.append(starts[1:], len(data))
        distinct, first, of = np.unique(self._hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = self.known.find(distinct)
        new = np.flatnonzero(number < 0)
        first = first[new]
        ids, sizes = self._encode_units(data, starts[first], ends[first])
        raw = data[np.arange((ends - starts)[first].sum()) + np.repeat(starts[first] - _before((ends - starts)[first]), (ends - starts)[first])]
        pools = self.pool, self.letters
        number[new] = np.arange(self.known.size, self.known.size + len(new))
        if self.known.size + len(new) <= self.limit:
            self.known.add(distinct[new])
            self.pool.add(ids, sizes)
            self.letters.add(raw, (ends - starts)[first])
        else:  # known during this batch alone
            pools = self.pool.with_more(ids, sizes), self.letters.with_more(raw, (ends - starts)[first])
        begin, size = pools[0].places(number[of])
        pool = pools[0].values
        odd = self._differing(data, starts, ends - starts, pools[1].values, *pools[1].places(number[of]))
        if len(odd):
            # each different one once
            places: dict[bytes, int] = {}
            of_odd = [places.setdefault(data[a:b].tobytes(), len(places)) for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]
            one = np.array(odd)[np.unique(of_odd, return_index=True)[1]]
            ids, sizes = self._encode_units(data, starts[one], ends[one])
            begin[odd], size[odd] = len(pool) + _before(sizes)[of_odd], sizes[of_odd]
            pool = np.concatenate([pool, ids])
        after = np.cumsum(size)
        out = pool[np.repeat(begin - (after - size), size) + np.arange(after[-1])]
        # the number of ids before each text's first unit
        before = np.concatenate([[0], after])[np.searchsorted(starts, offsets)]
        per_text = np.diff(before)
        if end_id is None:
            return out, per_text
        closed = np.full(len(out) + n, end_id, self.dtype)
        closed[np.arange(len(out)) + np.repeat(np.arange(n), per_text)] = out
        return closed, per_text + 1

    def ids(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text]))[0]


@functools.lru_cache(1)
def shared_encoder(path: str) -> Encoder:
    """One encoder for each Python worker; what it remembers serves all of its tasks."""
    return Encoder(path)


# --- pre-tokens ----------------------------------------------------------------------------

#: The word pattern over letters of the Latin blocks, where all Unicode versions agree; other
#: units are cut by the library.
_LATIN = regex.compile(r"[\x00-\x1b\x20-\u024f]*")
_WHITE = r"\t-\r \x85\xa0"
_PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)


class PreTokens:
    """Cuts units into pre-tokens; special tokens inside a text are pre-tokens of their own."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def of(self, unit: str) -> list[str]:
        if any(s in unit for s in self.special):
            return [p for i, part in enumerate(self.any_special.split(unit)) for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(unit)

    def _plain(self, part: str) -> list[str]:
        if _LATIN.fullmatch(part):
            return _PATTERN.findall(part)
        return [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(pretokens, add_special_tokens=False)]
