import hashlib
import random

import numpy as np

from lodestar.llm import align, components, decontaminate, omh, rlindex, segments
from lodestar.llm.common import SharedTables, WordHashes, shingle_hashes


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j - 1] + (x != y), line[j] + 1, new[-1] + 1))
        line = new
    return line[-1]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[i] = f"w{rng.randrange(9999)}"
        elif kind < 0.75:
            words.insert(i, f"w{rng.randrange(9999)}")
        elif len(words) > 1:
            del words[i]
    return words


def test_alignment_decides_as_edit_distance_does():
    rng = random.Random(1)
    pairs, most = [], []
    for _ in range(300):
        a = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        b = edited(rng, a, rng.randint(0, 12)) if a else []
        b = [x if isinstance(x, int) else hash(x) % 1000 for x in b]
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        most.append(rng.choice([0, 1, 3, 5, 9, 20, 40]))
    for (a, b), m, yes in zip(pairs, most, align.aligned(pairs, most)):
        assert yes == (distance(a.tolist(), b.tolist()) <= m)


def test_sketches_feel_order():
    words = WordHashes().of([f"w{i}" for i in range(60)])
    kmers = omh.labelled_kmers(words, 5)
    seeds = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    swapped = np.concatenate([kmers[30:], kmers[:30]])
    same = (omh.order_sketches(kmers, seeds, 2) == omh.order_sketches(swapped, seeds, 2)).mean()
    assert 0.2 < same < 0.8 and (omh.order_sketches(kmers, seeds, 1) == omh.order_sketches(swapped, seeds, 1)).all()


def test_repeated_kmers_are_labelled():
    words = WordHashes().of(["a"] * 20)
    assert len(set(omh.labelled_kmers(words, 5).tolist())) == 16


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.connected_components(links, SharedTables(spark, "test")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == got[101] == 100
    assert components.connected_components(links.limit(0), SharedTables(spark, "test")).count() == 0


def corpus(rng):
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 120))] for _ in range(12)]
    docs = []
    for b in base:
        docs.append(" ".join(b))
        docs += [" ".join(edited(rng, b, max(1, len(b) // 20))) for _ in range(3)]
    return docs + docs[:5]


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = corpus(rng)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (None, texts[0], "x"), (902, "two words", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    got = {r.doc_id: r.class_id for r in omh.classify(docs).collect()}
    parent = {i: i for i in range(len(texts))}
    find = lambda i: i if parent[i] == i else find(parent[i])
    words = [t.lower().split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if distance(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(got[i] == find(i) for i in range(len(texts)))
    assert got[900] == got[901] == 900 and got[None] == 0 and got[902] == 902
    kept = omh.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))} | {900, 902})


def test_short_texts_are_classed_as_all_pairs_would(spark):
    rng = random.Random(12)
    texts = []
    for n in (10, 12, 15, 20, 25, 30, 40) * 3:
        a = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts += [" ".join(x) for x in (a, edited(rng, a, n // 5), edited(rng, a, n // 10))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in omh.classify(docs).collect()}
    words, links = [t.split() for t in texts], []
    for i in range(len(texts)):
        links += [(j, i) for j in range(i) if distance(words[i], words[j]) <= int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)]
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) >= 40 and found >= 0.9 * len(links)
    assert all(got[i] == got[j] or (j, i) not in links for i in range(len(texts)) for j in range(i) if abs(i - j) > 2)


def test_recall_by_length_and_similarity():
    from omh_recall import recall

    for n in (10, 20, 40, 100, 125, 126, 150, 300, 1000):
        assert recall(n, 0.8) >= 0.88 and recall(n, 0.9) >= 0.99, n


def test_hubs_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(omh, "PER_PART", 3)
    texts = [" ".join(f"w{i}" for i in range(30))] + [" ".join(f"w{i}" for i in range(30) if i != k) for k in range(20)] + ["a b c"]
    words = omh._hashed_words(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"))
    pairs = spark.createDataFrame([(0, k) for k in range(1, 22)] + [(k, 20) for k in range(1, 20)], "a bigint, b bigint")
    got = sorted((r.a, r.b) for r in omh._verified(pairs, words, SharedTables(spark, "test"), 0.8, "links").collect())
    assert got == sorted([(0, k) for k in range(1, 21)] + [(k, 20) for k in range(1, 20)])


def test_clashing_names_survive_and_long_texts_are_read_whole(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long, 7, 8, "x"), (2, long + " end", 7, 8, "x"), (3, "a", 7, 8, "x")], "doc_id bigint, text string, own_id int, _omh_id int, digest string")
    kept = omh.one_per_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("own_id = 7 and _omh_id = 8 and digest = 'x'").collect()) == [1, 3]


def test_one_of_equal_rows_stays(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "d e f"), (7, "d e f")], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in omh.one_per_class(docs).collect()) == ["7", "None"]
    assert omh.one_per_class(docs.limit(0)).count() == 0


def test_index_has_the_longest_matches():
    rng = random.Random(0)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = [base[a : a + rng.randint(1, 40)] for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 8)))]
        strings = [s or b"a" for s in strings]
        index = rlindex.RunLengthIndex(strings)
        found = index.matching_statistics()
        places = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
        for k, i in places:
            best = 0
            for k2, j in places:
                n = 0
                while (k, i) != (k2, j) and i + n < len(strings[k]) and j + n < len(strings[k2]) and strings[k][i + n] == strings[k2][j + n]:
                    n += 1
                best = max(best, n)
            assert found[index.starts[k] + i] == best
        assert index.n_runs <= len(index.text)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, marks int")
    rows = rlindex.remove_repeats(docs, **options).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def repeat_corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrstéß") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(70)) for _ in range(3)]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(5, 60)))]
        if i % 2:
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 60) :], " ".join(word() for _ in range(20))]
        docs.append(" ".join(parts))
    return [*docs, docs[0], docs[1], None, "", "x" * 700, passages[0] + " " + passages[0], "short"]


def test_repeats_are_those_of_brute_force(spark):
    texts = repeat_corpus()
    assert repeats(spark, texts) == brute_repeats(texts, 200)


def test_crowded_anchors_are_decided_alike(spark):
    texts = repeat_corpus()
    assert repeats(spark, texts, length=50, gram=20, most=3, block=4000) == brute_repeats(texts, 50)
    assert rlindex.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_containment_search_is_exhaustive(spark):
    rng = random.Random(2)
    items = [[f"b{rng.randrange(5000)}" for _ in range(rng.choice([2, 6, 12, 30, 60]))] for _ in range(25)]
    docs = []
    for i in range(60):
        words = [f"d{rng.randrange(5000)}" for _ in range(rng.choice([3, 50, 2000]))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, rng.choice(items), i % 2)
        docs.append(" ".join(words).upper() if i % 2 else " ".join(words))
    df = spark.createDataFrame([*enumerate(docs), (90, None), (91, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (70, None)], "item_id bigint, text string")
    of = WordHashes()
    sets = [set(shingle_hashes(of.of(d.lower().split())).tolist()) for d in docs]
    wanted = [set(shingle_hashes(of.of(w)).tolist()) for w in items]
    want = sorted((d, i) for d, s in enumerate(sets) for i, q in enumerate(wanted) if len(q & s) >= 0.8 * len(q))
    for block in (20_000, 7):
        got = decontaminate.find_items(df, bench, block=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == want
    kept = {r.doc_id for r in decontaminate.without_items(df, bench).collect()}
    assert kept == set(range(60)) - {d for d, _ in want} | {90, 91}
    assert decontaminate.find_items(df, bench.limit(0)).count() == 0 and decontaminate.find_items(df.limit(0), bench).count() == 0


def test_every_two_classes_of_a_bucket_are_tried(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    # many texts that share a passage and little else; some are near duplicates of one another
    texts = []
    for _ in range(24):
        own = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(30, 50))]
        texts.append(passage + own)
        if rng.random() < 0.4:
            texts.append(edited(rng, passage + own, rng.randint(10, 14)))
    nodes = list(range(len(texts)))
    rng.shuffle(nodes)
    kept = spark.createDataFrame([(n, " ".join(t)) for n, t in zip(nodes, texts)], "node bigint, text string")
    members = spark.createDataFrame([(1, n, len(t)) for n, t in zip(nodes, texts)], "value bigint, node bigint, n_words int")
    none = spark.createDataFrame([], "a bigint, b bigint")
    tables = SharedTables(spark, "test")
    words = tables.write(omh._hashed_words(kept), "words")
    got = {r.node: r.root for r in omh._beyond_ends(members, none, none.toDF("node", "root"), words, tables, 0.8).collect()}
    parent = {n: n for n in nodes}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i, a in zip(nodes, texts):
        for j, b in zip(nodes, texts):
            if i < j and distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert any(find(n) != n for n in nodes)
    assert all(got.get(n, n) == find(n) for n in nodes)


def test_segments_made_to_collide_are_told_apart():
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = (segments.segments(np.frombuffer(x.encode(), np.uint8), 2048, 2048) for x in (word, other))
    assert len(a[3]) == len(b[3]) == 1 and a[3][0] != b[3][0]


def test_without_items_keeps_clashing_columns_and_reads_long_texts(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "a " * 200_000 + item, 7, 8), (2, "plain", 7, 8)], "doc_id bigint, text string, has_item int, _has_item int")
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.without_items(docs, bench, block_bytes=10).collect()] == [(2, "plain", 7, 8)]
    assert [r.doc_id for r in decontaminate.find_items(docs, bench).collect()] == [1]


def test_shared_counts_are_those_of_sets():
    rng = np.random.default_rng(3)
    make = lambda n, top: [np.unique(rng.integers(0, top, rng.integers(1, 60))).astype(np.uint64) for _ in range(n)]
    for top in (40, 900, 100_000):
        a, b = make(70, top), make(45, top)
        want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert omh.shared_counts(a, b).astype(int).tolist() == want
    assert omh.shared_counts([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def template_texts(rng, n, planted, slots=30):
    """Texts of slots of two words with three variants each, and partners that differ in four slots."""
    word = lambda slot, v: [f"s{slot}v{v}", f"t{slot}v{v}"]
    rows = [[rng.randrange(3) for _ in range(slots)] for _ in range(n)]
    for x in rows[:planted]:
        other = list(x)
        for slot in rng.sample(range(slots), 4):
            other[slot] = (x[slot] + rng.randint(1, 2)) % 3
        rows.append(other)
    return [" ".join(w for i, v in enumerate(x) for w in word(i, v)) for x in rows], [(i, n + i) for i in range(planted)]


def test_texts_of_one_template_find_all_that_their_sketches_find(spark, monkeypatch):
    # small blocks, so that buckets are cut into several
    monkeypatch.setattr(omh, "BLOCK", 40)
    texts, planted = template_texts(random.Random(21), 2000, 150)
    got = {r.doc_id: r.class_id for r in omh.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    words = [WordHashes().of(t.split()) for t in texts]
    sketches = [set(omh.sketches_of(w).tolist()) for w in words]
    met = [(i, j) for i, j in planted if sketches[i] & sketches[j]]
    assert len(met) >= 0.9 * len(planted)
    assert all(got[i] == got[j] for i, j in met)


def test_edits_that_lie_together_are_ruled_out_by_words():
    a = np.arange(100, dtype=np.uint64)
    b = np.append(a[:70], np.arange(1000, 1030, dtype=np.uint64))
    # 30 edits, but only 30 of 99 word pairs are lost
    assert not align.may_align(a, b, 20) and align.may_align(a, b, 30)
    grams = [(x, omh.labelled_kmers(x, 2), omh.labelled_kmers(x, 1)) for x in (a, b)]
    assert [x.tolist() for x in omh._may_link(grams, grams, 0.8)[:2]] == [[0, 1], [0, 1]]


def test_blocks_of_links_make_the_same_components(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    links = spark.createDataFrame(rows, "a bigint, b bigint").repartition(6)
    whole = sorted(components.connected_components(links, SharedTables(spark, "test")).collect())
    monkeypatch.setattr(components, "BLOCK_LINKS", 40)
    assert sorted(components.connected_components(links, SharedTables(spark, "test")).collect()) == whole
    classes = spark.createDataFrame([(3, 1), (1, 1), (9, 9)], "node bigint, root bigint")
    more = spark.createDataFrame([(0, 3), (7, 8)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.merged(classes, more, SharedTables(spark, "test"), "classes").collect()}
    assert {k: got.get(k, k) for k in (0, 1, 3, 7, 8, 9)} == {0: 0, 1: 0, 3: 0, 7: 7, 8: 7, 9: 9}


def test_texts_that_meet_in_many_buckets_are_dealt_once(spark, monkeypatch):
    texts, _ = template_texts(random.Random(3), 60, 0)
    words = SharedTables(spark, "test").write(omh._hashed_words(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")), "words")
    rows = [(v, n, 60, n) for v in range(20) for n in range(60)]
    in_class = spark.createDataFrame(rows, "value bigint, node bigint, n_words int, root bigint")
    seen, tables = {}, SharedTables(spark, "test")
    write = tables.write
    monkeypatch.setattr(tables, "write", lambda df, name: seen.setdefault(name, write(df, name)))
    monkeypatch.setattr(tables, "drop", lambda name: None)
    omh._crowded_links(in_class.select("node").distinct(), in_class, words, tables, 0.8)
    assert seen["crowded-units"].count() == 1
