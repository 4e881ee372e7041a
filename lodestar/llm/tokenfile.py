"""Token ids in Huffman-coded files.

Texts are encoded to ids (an end id closes each document), ids are counted over the whole
corpus, and a canonical, length-limited Huffman code is built from the counts. Files hold the
documents in ascending id order, in blocks that are decoded on their own: a block has the
code stream of some whole documents and, for every `LANE` ids, the bit offset at which they
start. A reader decodes all lanes of a block side by side by one table look-up per id.

Layout of a token file set (Parquet tables, written by Spark's committing writer):
  code/    id int, length int - the code lengths; codes follow canonically by (length, id)
  blocks/  shard, block, start (ids of the shard before the block), n_ids,
           doc_ids, lengths (ids of each document), checkpoints (uint64 bit offsets), payload

The only things that pass the driver are the counts and code lengths of the vocabulary.

Defined results: a null or empty text is the end id alone; null ids come first; rows with
equal ids are ordered by a hash of their token ids; repeated rows are written each, and may lie in
several shards; a text of any length is one document of one block; an empty table gives an empty
file set; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, SharedTables, input_columns, map_slices, map_texts
from lodestar.llm.tokens import default_path, shared_encoder, tokenizer

#: Longest code; a decoding table has 2**LONGEST entries. Ids between two checkpoints. Ids of a block.
LONGEST, LANE, BLOCK = 20, 256, 1 << 20
#: Coded bytes of a shard, until there are so many shards that they must grow.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000


# --- the code ------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits (package-merge); 0 for unused symbols."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} symbols don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, items = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(is_leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        kind = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        at = np.argsort(merged, kind="stable")
        items, is_leaf = merged[at], kind[at]
    levels.append(is_leaf)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each a number of its length's bits."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths.max())
        width = np.int64(1) << (top - lengths[order])
        codes[order] = (np.cumsum(width) - width) >> (top - lengths[order])
    return codes


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bit stream (most significant bit first) of documents of `sizes` ids.

    Each document starts at a byte. Returns the stream, each document's first byte (and the
    end), and the bit offset of each id.
    """
    n = lengths[ids]
    ends = np.cumsum(n)
    last = np.cumsum(sizes) - 1
    ended = np.concatenate([[0], ends[last]])
    bounds = np.concatenate([[0], np.cumsum((np.diff(ended) + 7) // 8)])
    at = ends - n + np.repeat(bounds[:-1] * 8 - ended[:-1], sizes)
    word, shift = at >> 5, 64 - (at & 31) - n
    wide = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    words = int(bounds[-1]) // 4 + 3
    # codes don't overlap, so sums are unions; float64 sums stay exact below 2**53
    out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words)
    out[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    return out.astype(np.uint64).astype(">u4").tobytes()[: int(bounds[-1])], bounds, at


def lane_sizes(sizes: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Ids of each lane: documents are cut every `lane` ids, and at their ends."""
    n = (sizes + lane - 1) // lane
    out = np.full(int(n.sum()), lane, np.int64)
    out[np.cumsum(n) - 1] = sizes - (n - 1) * lane
    return out


def lane_starts(sizes: np.ndarray, lane: int = LANE) -> np.ndarray:
    """The index of each lane's first id."""
    n = lane_sizes(sizes, lane)
    return np.cumsum(n) - n


def decoding_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
    """For each `top` bits that may come next: symbol * 32 + code length."""
    top = max(1, int(lengths.max(initial=0)))
    table = np.full(1 << top, 1, np.uint32)  # bits that no code has only follow the end of a stream
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (top - lengths[used]))]
    entries = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    filled = np.repeat(entries, 1 << (top - lengths[order]))
    table[: len(filled)] = filled
    return table, top


def unpack(payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray, table: np.ndarray, top: int, lane: int = LANE) -> np.ndarray:
    """The ids of a block of documents of `sizes` ids; all lanes advance together."""
    b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    at_byte = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    last = (len(at_byte) - 1) * 8
    pos = checkpoints.astype(np.int64)
    n = lane_sizes(sizes, lane)
    longest = int(n.max())
    out = np.empty((longest, len(pos)), np.uint32)
    for j in range(longest):
        bits = at_byte[pos >> 3] << (pos & 7).astype(np.uint32)
        entry = table[bits >> np.uint32(32 - top)]
        out[j] = entry >> np.uint32(5)
        pos = np.minimum(pos + (entry & np.uint32(31)), last)
    return out.T[np.arange(longest) < n[:, None]]


# --- writing -------------------------------------------------------------------------------


def encode_documents(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_ids and ids (little-endian, the end id last) of every whole text.

    The first row of each batch also has the batch's counts of ids, as pairs (id, count), so
    that counting needs no second look at the ids.
    """

    def make():
        encoder = shared_encoder(path)
        width = encoder.dtype.itemsize

        def call(batch):
            ids, sizes = encoder.encode_column(batch.column("text"), end_id)
            ends = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int64)
            raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())])
            found = np.bincount(ids)
            some = np.flatnonzero(found)
            counts = np.stack([some, found[some]], axis=1).astype("<i8").tobytes()
            return {"doc_id": batch.column("doc_id"), "n_ids": sizes, "ids": raw.cast(pa.binary()), "counts": [counts] + [None] * (len(sizes) - 1)}

        return call

    return map_slices(input_columns(docs, id_col, text_col), "text", make, "doc_id bigint, n_ids bigint, ids binary, counts binary")


def count_ids(encoded: DataFrame) -> np.ndarray:
    """Counts of all ids over the whole corpus; one row per id reaches the driver."""

    def run(batches):
        for batch in batches:
            pairs = np.frombuffer(b"".join(x for x in batch.column("counts").to_pylist() if x), "<i8").reshape(-1, 2)
            found = np.bincount(pairs[:, 0], pairs[:, 1]).astype(np.int64)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], names=["id", "n"])

    rows = encoded.select("counts").where("counts is not null").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (rows.column(c).to_numpy() for c in ("id", "n"))
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = n
    return counts


def _runs(sizes: np.ndarray, most: int = 1 << 19):
    """Slices of consecutive documents with about `most` ids each (one document at least)."""
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


_BLOCKS = "shard int, block int, start bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, checkpoints binary, payload binary"


def write_tokens(docs: DataFrame, tables: SharedTables, path: str | None = None, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the file set of docs as the tables `code` and `blocks`."""
    path = path or default_path()
    spark = docs.sparkSession
    dtype = np.dtype("<u2") if tokenizer(path).get_vocab_size() <= 1 << 16 else np.dtype("<u4")
    encoded = tables.write(encode_documents(docs, path, end_id, id_col, text_col), "encoded")
    lengths = code_lengths(count_ids(encoded))
    used = np.flatnonzero(lengths)
    code = pa.table({"id": pa.array(used, pa.int32()), "length": pa.array(lengths[used], pa.int32())})
    tables.write(spark.createDataFrame(code).coalesce(1), "code")
    codes = canonical_codes(lengths)
    width = dtype.itemsize

    def coded(batch, _):
        sizes = batch.column("n_ids").to_numpy()
        streams, marks = [], []
        for part in _runs(sizes):
            ids = np.frombuffer(b"".join(batch.column("ids").slice(part.start, part.stop - part.start).to_pylist()), dtype)
            stream, bounds, at = pack(ids, sizes[part], lengths, codes)
            offsets = at[lane_starts(sizes[part])]
            cuts = np.cumsum((sizes[part] + LANE - 1) // LANE)
            for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                streams.append(stream[a:b])
                marks.append((offsets[cuts[k - 1] if k else 0 : cuts[k]] - 8 * a).astype("<u8").tobytes())
        return {"doc_id": batch.column("doc_id"), "n_ids": sizes, "hash": batch.column("hash"), "marks": marks, "stream": streams}

    # only code streams, not ids, are shuffled; written first, as ranges are drawn from a look at all rows
    streams = map_texts(
        encoded.drop("counts").withColumn("hash", F.xxhash64("ids")), None, coded,
        "doc_id bigint, n_ids bigint, hash bigint, marks binary, stream binary",
    )
    # a number of its own lets rows with the same id and text lie in several shards
    streams = tables.write(streams.withColumn("row", F.monotonically_increasing_id()), "streams")
    tables.drop("encoded")
    n_bytes = streams.agg(F.coalesce(F.sum(F.octet_length("stream")), F.lit(0))).first()[0]
    key = (F.col("doc_id").asc_nulls_first(), "hash", "row")
    sorted_ = streams.repartitionByRange(min(MOST_SHARDS, n_bytes // SHARD_BYTES + 1), *key).sortWithinPartitions(*key)
    schema = DataFrameSchema(_BLOCKS)

    def blocks(batches):
        shard, start, number = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def made():
            nonlocal start, number, held, size
            base = np.cumsum([0, *(len(s) for _, _, _, s in held)])
            marks = np.concatenate([np.frombuffer(m, "<u8") + 8 * b for (_, _, m, _), b in zip(held, base.tolist())])
            row = [shard, number, start, size, [d for d, *_ in held], [k for _, k, *_ in held], marks.astype("<u8").tobytes(), b"".join(s for *_, s in held)]
            start, number, held, size = start + size, number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema.arrow())], schema=schema.arrow())

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "marks", "stream"))):
                held.append(row)
                size += row[1]
                if size >= BLOCK:
                    yield made()
        if held:
            yield made()

    tables.write(sorted_.select("doc_id", "n_ids", "marks", "stream").mapInArrow(blocks, _BLOCKS), "blocks")
    tables.drop("streams")


def read_tokens(spark: SparkSession, tables: SharedTables) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    code = spark.read.parquet(tables.path("code")).toArrow()
    lengths = np.zeros(int(np.max(code.column("id").to_numpy(), initial=0)) + 1, np.int64)
    lengths[code.column("id").to_numpy()] = code.column("length").to_numpy()
    blocks = spark.read.schema(_BLOCKS).parquet(tables.path("blocks"))
    # one row per shard: its ids, and those of all shards before it
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("offset"))
    shards = tables.write(shards, "shards")

    def make():
        table, top = decoding_table(lengths, canonical_codes(lengths))

        def call(batch, _):
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                ids = unpack(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), sizes, table, top).astype("<u4")
                at = 0
                for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                    out["doc_id"].append(doc_id)
                    out["start"].append(row["offset"] + row["start"] + at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
            return out

        return call

    joined = blocks.join(shards, "shard")
    return map_texts(joined, None, None, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", make=make)
