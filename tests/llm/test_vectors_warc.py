import base64
import gzip
import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import centroids, vectorcodes, vectors, warc
from lodestar.llm.common import SharedTables

NAN, INF = float("nan"), float("inf")


def lloyd(rows, k, rounds, prefix="2:"):
    """(vec_id, cluster, distance) per row and the centroids, every distance calculated with Python's integers."""
    rows = [(i, [int(np.floor(x * 256)) for x in v], v) for i, v in rows]
    start = sorted((hashlib.sha256(f"{prefix}{i}".encode()).hexdigest(), f, v) for i, v, f in rows if i is not None)[:k]
    centres = [v for _, _, v in start]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((distance(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v, _ in rows]
        for j in range(len(centres)):
            own = [v for (_, v, _), c in zip(rows, of) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i is not None, i or 0, near(v)[1], near(v)[0]) for i, v, _ in rows), centres


def table(spark, rows, more=""):
    return spark.createDataFrame([(*r, *([7] * bool(more))) for r in rows], "vec_id bigint, embedding array<double>, label int" + more)


def odd_vectors(seed, dim, huge=0.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1.0, 0.5, 0.25, 1.75)) for _ in range(dim)], i % 3 if i % 5 else None) for i in range(60)]
    rows += [rows[3], rows[3], (3, rows[4][1], 1), (None, rows[5][1], 2), (None, rows[6][1], None)]
    if huge:
        rows += [(70, [huge] * dim, 1), (71, [-huge] * dim, 1)]
    bad = [(80, None, 1), (81, [None] * dim, 1), (82, [NAN] * dim, 1), (83, [INF] * dim, 1), (84, [1.0] * (dim + 1), 1), (85, [], 1)]
    return rows, bad


@pytest.mark.parametrize("huge", [0.0, 1e12, 1e300])
def test_clusters_are_those_of_plain_rounds(spark, huge):
    rows, bad = odd_vectors(1, 4, huge)
    want, centres = lloyd([(i, v) for i, v, _ in rows], 6, 4)
    df = table(spark, rows + bad, ", n int").withColumnRenamed("n", "cluster").withColumn("a.b", F.lit(1)).repartition(3)
    found = centroids.cluster(df, k=6, rounds=4, dim=4).collect()
    got = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found)
    assert got == [(a, b, c, d if d < 1 << 63 else None) for a, b, c, d in want]
    for r in found:
        inertia = sum(d for *_, c, d in want if c == r["cluster"])
        assert r["cluster_inertia"] == (inertia if inertia < 1 << 63 else None)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_and_of_no_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    found = centroids.cluster(table(spark, rows), k=5, dim=2).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in found) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert centroids.cluster(table(spark, []), dim=2).count() == 0
    assert centroids.cluster(table(spark, [(None, [1.0, 2.0], 0)]), dim=2).count() == 0  # nothing to start from


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (12, 16))
    x = middles[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 16))
    centres, k = x[:12].copy(), 12
    cluster, upper, lower = centroids.fresh_bounds(len(x), k)
    calculated = []
    for _ in range(6):
        calculated.append(centroids.assign(x, centres, cluster, upper, lower))
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (lower.astype(float) ** 2 <= d * (1 + 1e-12)).all() and (upper**2 >= d.min(1) * (1 - 1e-12)).all()
        after = centroids.means(centres, centroids.sums_of(x, cluster, k))
        upper, lower = centroids.moved(cluster, upper, lower, centroids.root_up(centroids.squared(after, centres)))
        centres = after
    assert calculated[0] < len(x) * k and calculated[-1] < len(x) * k / 4


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [4, 0], [2, 0], [2, 2]])
    for order in ([0, 1], [1, 0]):
        centres = x[order]
        cluster, upper, lower = centroids.fresh_bounds(4, 2)
        cluster[:] = 1  # begin at the greater number
        centroids.assign(x, centres, cluster, upper, lower)
        assert cluster[2] == 0 and cluster[3] == 0


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(((i is None, i or 0, v, label) for i, v, label in rows), key=lambda r: r[:3])
    ints = [[int(np.floor(x * 256)) for x in v] for _, _, v, _ in rows]
    width = len(ints[0]) // parts
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[piece(v, p) for v in ints[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [near(piece(v, p), book)[1] for v in ints]
            for j in range(len(book)):
                own = [piece(v, p) for v, o in zip(ints, of) if o == j]
                if own:
                    book[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(piece(v, p), books[p]) for p in range(parts)] for v in ints]
    out = [(not r[0], r[1], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), r[3]) for r, f in zip(rows, found)]
    return out, ",".join(str(x) for book in books for e in book for x in e)


@pytest.mark.parametrize("huge", [0.0, 1e12, 1e300])
def test_codes_are_those_of_plain_rounds(spark, huge):
    rows, bad = odd_vectors(2, 6, huge)
    want, numbers = plain_codes(rows, 3, 8, 2)
    df = table(spark, rows + bad[:-2] + [(90, [1.0] * 7, 1), (91, [], 1), (92, [1.0] * 9, 1)], ", kept int").withColumn("a.b", F.lit(1)).repartition(3)
    found = vectorcodes.compress(df, parts=3, entries=8).collect()
    long = lambda x: x if x < 1 << 63 else None
    by_label = {}
    for *_, error, label in want:
        by_label.setdefault(label, []).append(long(error))
    summed = {k: sum(x for x in v if x is not None) for k, v in by_label.items()}
    got = sorted(((r["vec_id"] is not None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in found), key=str)
    assert got == sorted(((a, b, c, long(d), long(summed[label])) for a, b, c, d, label in want), key=str)
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(numbers.encode()).hexdigest()}


def test_codes_of_few_and_of_no_vectors(spark):
    rows = [(2, [1.0, 2.0], None), (1, [3.0, 4.0], 5), (3, [1.0, 2.0], None), (4, [9.0], 5)]
    codes = vectorcodes.Codes(table(spark, rows), parts=2)
    found = {r["vec_id"]: r for r in codes.result().collect()}
    assert {i: (r["code"], r["error"], r["label_error"]) for i, r in found.items()} == {1: ("0000", 0, 0), 2: ("0101", 0, 0), 3: ("0101", 0, 0)}
    assert vectorcodes.restored("0100", codes.books) == [256, 1024]
    assert vectorcodes.compress(table(spark, [(4, None, 5)])).count() == 0
    assert vectorcodes.compress(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        vectorcodes.Codes(table(spark, []), entries=257)


def test_blocks_keep_numbers_of_any_size():
    for values, kind in (([1.0, -3.0], "<i2"), ([40000.0, 1.0], "<i4"), ([2.0**60, -1.0], "<f8")):
        got, peak, data = vectors._packed(np.array([values]))
        assert got == kind and peak == max(map(abs, values))
        for wide in (False, True):
            assert vectors.unpacked(got, data, 1, wide).tolist() == [[int(x) for x in values]]
    assert vectors.too_wide(2.0**31, 1, 4) and not vectors.too_wide(2.0**20, 10**6, 64)


# --- WARC ----------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/é?x=1\r\nX: y", "same"), (4, None, ""), (5, "u", None), (6, "u", "<p>日本</p>"),
    (7, "u", "x" * 3_000_000), (8, "u", "end\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (None, "u", "alone"), (6, "u", "<p>日本</p>"), (None, None, None),
]


def plain_pages(rows, least):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = max(ids) if ids and len([1 for _, _, h in rows if (h or "") == (html or "")]) > 1 and len(payload) >= least else i
        kind, refers = ("response", None) if first == i else ("revisit", first)
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, archive_bytes", [(0, 1), (0, 1 << 26), (5, 1 << 26)])
def test_pages_come_back_from_archives(spark, least, archive_bytes):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id bigint, url string, html string, first int").withColumn("a.b", F.lit(1)).repartition(2)
    tables = SharedTables(spark, "warc")
    warc.write_records(pages, tables, least, archive_bytes=archive_bytes)
    found = warc.read_records(spark, tables.path("archives"), with_payload=True)
    assert sorted((tuple(r) for r in warc.page_records(found).collect()), key=str) == plain_pages(PAGES, least)
    assert warc.lost_references(found).count() == 0
    rows = found.where("record_type = 'response'").collect()
    assert sorted(bytes(r["payload"]) for r in rows) == sorted((h or "").encode() for (i, _, h), p in zip(PAGES, PAGES) if plain_kind(i, h, least) == "response")
    uris = {r["target_uri"] for r in found.collect()}
    assert "http://a/%C3%A9?x=1%0D%0AX:%20y" in uris and None in uris


def plain_kind(i, html, least):
    return next(k for j, n, d, k, _ in plain_pages(PAGES, least) if j == i and d == warc.digest((html or "").encode()))


def test_an_empty_table_gives_no_records(spark):
    tables = SharedTables(spark, "warc")
    warc.write_records(spark.createDataFrame([], "page_id bigint, url string, html string"), tables)
    assert warc.page_records(warc.read_records(spark, tables.path("archives"))).count() == 0


def archive():
    pieces = [warc.archive_info("a"), *(warc.record(i, u, (h or "").encode(), 9 if i == 1 else None) for i, u, h in PAGES[:6])]
    return [warc.member(p) for p in pieces], pieces


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 16])
def test_the_reader_frames_records_in_pieces_of_any_size(piece):
    members, pieces = archive()
    data = b"".join(members)
    assert gzip.decompress(data) == b"".join(b"".join(p) for p in pieces)
    found = list(warc.records(io.BytesIO(data), True, piece))
    assert [r["problem"] for r in found] == [None] * len(members)
    assert [r["offset"] for r in found] == [sum(map(len, members[:i])) for i in range(len(members))]
    assert [r["payload"] for r in found[2:]] == [(h or "").encode() for _, _, h in PAGES[1:6]]
    assert (found[1]["record_type"], found[1]["refers_to"], found[1]["payload_bytes"], found[1]["payload"]) == ("revisit", "urn:page:9", 4, None)


def test_damage_is_told_and_what_stands_before_it_is_read():
    members, pieces = archive()
    whole = lambda changed: list(warc.records(io.BytesIO(b"".join(changed))))
    cut = whole([*members[:3], members[3][:-3]])
    assert [r["problem"] for r in cut[:3]] == [None] * 3 and "ends within" in cut[3]["problem"]
    assert "no gzip member" in whole([*members[:2], b"no gzip"])[2]["problem"]
    text = b"".join(pieces[2])
    changed = [zlib_member(text.replace(b"same", b"sane")), *members[3:]]
    assert whole(changed)[0]["problem"] == "the block digest differs, the payload digest differs" and whole(changed)[1]["problem"] is None
    assert "does not end where" in whole([zlib_member(text + b"more")])[0]["problem"]
    assert "shorter" in whole([zlib_member(text[:-6])])[0]["problem"]
    assert "no Content-Length" in whole([zlib_member(text.replace(b"Content-Length: ", b"Length: ", 1))])[0]["problem"]
    assert "no WARC record" in whole([zlib_member(b"HTTP" + text)])[0]["problem"]
    assert "does not end" in whole([zlib_member(b"WARC/1.1\r\n")])[0]["problem"]


def zlib_member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_a_lost_response_and_a_bad_file_are_found(spark, tmp_path):
    members, _ = archive()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:3]))
    (tmp_path / "b.warc.gz").write_bytes(members[1] + b"junk")
    found = warc.read_records(spark, str(tmp_path))
    assert [(r["refers_to"], r["n"]) for r in warc.lost_references(found).collect()] == [("urn:page:9", 2)]
    assert found.where("problem IS NOT NULL").select("offset").collect()[0][0] == len(members[1])
    with pytest.raises(Exception, match="no gzip member"):
        warc.page_records(found).collect()
    assert os.listdir(tmp_path)


def test_new_queries_agree_with_sql(agrees):
    for name in ("op11_elkan_clusters", "op12_vector_codes", "op13_warc_records"):
        agrees(name)
