import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import tokencount, tokenfile, tokens
from lodestar.llm.common import SharedTables

PARTS = [" ", "  ", "\n", " \n", "\t", "a", "Z", "é", "'s", "'", "12", "½", ".", "!?", "<|endoftext|>", "\xa0", "\x1c", "　", "日本", "🎉", "́", " <|endoftext|> ", "\x85"]


def random_texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_units_encode_as_the_library_does(limit):
    encoder, texts = tokens.Encoder(tokens.default_path(), limit), random_texts(3000, 14, 1)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids, sizes = encoder.encode_column(pa.array([None, *some]), end_id=0)
        want = [e.ids for e in encoder.tok.encode_batch(["", *some], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) + 1 for w in want]
        assert ids.tolist() == [i for w in want for i in [*w, 0]]


def swaps(n, a, b):
    """The word of n letters that collides with its complement under sums of powers, whatever the base."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("lead", ["", "x "])
def test_units_made_to_collide_are_told_apart(lead):
    encoder = tokens.Encoder(tokens.default_path())
    for n in (1024, 2048, 4096):
        texts = [lead + swaps(n, "a", "b"), lead + swaps(n, "b", "a")]
        want = [encoder.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.encode_column(pa.array(texts))[0].tolist() == [*want[0], *want[1]]
        assert [encoder.ids(t).tolist() for t in texts] == want


#: Two units whose sums are equal, found by a search of four lists.
PAIR = ["ebwtehhfivgvhejxdjozcjsbkdbjcrdh", "kplanprlufarykzeglnemyunpzosnpii"]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_units_of_equal_hashes_have_their_own_ids(limit, monkeypatch):
    encoder = tokens.Encoder(tokens.default_path(), limit)
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in PAIR)
    one = lambda x: encoder._hashes(x, np.array([0]), np.array([32]))[0]
    assert one(a) == one(b)  # or the pair shows nothing
    want = lambda texts: [encoder.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode_column(pa.array(PAIR))[0].tolist() == sum(want(PAIR), [])
    assert [encoder.ids(t).tolist() for t in [*PAIR[::-1], *PAIR]] == want([*PAIR[::-1], *PAIR])
    monkeypatch.setattr(tokens.Encoder, "_hashes", lambda self, data, starts, ends: np.full(len(starts), 5, np.uint64))
    constant, texts = tokens.Encoder(tokens.default_path(), limit), random_texts(300, 14, 4)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        ids, sizes = constant.encode_column(pa.array(some))
        assert ids.tolist() == sum(want(some), []) and sizes.tolist() == list(map(len, want(some)))


def test_pretokens_are_the_librarys():
    pre = tokens.PreTokens(tokens.default_path())
    for text in random_texts(2000, 14, 2):
        found = pre.of(text)
        assert "".join(found) == text
        assert sum(pre.pieces(found)) == len(pre.tok.encode(text, add_special_tokens=False).ids)


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 0])
    free, short = tokenfile.code_lengths(counts, 20), tokenfile.code_lengths(counts, 4)
    assert (counts * free).sum() == 2 + 4 + 7 + 12 + 20 + 33 + 54 and free[-1] == 0  # the sums that Huffman's merges make
    assert short.max() <= 4 and sum(2.0 ** -int(n) for n in short if n) <= 1
    with pytest.raises(ValueError):
        tokenfile.code_lengths(counts, 2)


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n, v in ((1, 5), (2, 3), (1000, 50), (50_000, 50_257), (5, 1)):
        ids = np.minimum(rng.pareto(0.7, n).astype(np.int64), v - 1)
        lengths = tokenfile.code_lengths(np.bincount(ids, minlength=v))
        codes = tokenfile.canonical_codes(lengths)
        cuts = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        sizes = np.diff(np.append(0, cuts))
        stream, _, at = tokenfile.pack(ids, sizes, lengths, codes)
        table, top = tokenfile.decoding_table(lengths, codes)
        assert (tokenfile.unpack(stream, at[tokenfile.lane_starts(sizes)], sizes, table, top) == ids).all()


def test_files_and_counts_agree_with_the_library(spark):
    texts = [None, "", *random_texts(40, 200, 3), "word " * 50_000]
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)] + [(5, "again", 1), (5, "again", 1), (5, "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    tok = tokens.tokenizer(tokens.default_path())
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    key = lambda r: tuple(-1 if x is None else x for x in r)
    counted = tokencount.over_limit(tokencount.count_tokens(docs, common=20))
    want = sorted((key((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024)) for d, t, _ in rows))
    assert sorted(key(r) for r in counted.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    tables = SharedTables(spark, "test")
    tokenfile.write_tokens(docs, tables)
    got = tokenfile.read_tokens(spark, tables).collect()
    closed = [(d, np.array([*ids(t), 0], "<u4")) for d, t, _ in rows]
    assert sorted(key((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(key((d, len(x), zlib.crc32(x.tobytes()))) for d, x in closed)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [-1 if r.doc_id is None else r.doc_id for r in ordered] == sorted(-1 if r.doc_id is None else r.doc_id for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokencount.count_tokens(docs).count() == 0
    tables = SharedTables(spark, "test")
    tokenfile.write_tokens(docs, tables)
    assert tokenfile.read_tokens(spark, tables).count() == 0
