"""Near duplicates by Order MinHash.

Two texts are near duplicates if their word sequences (lower case, cut at white space) have an
edit similarity, 1 - edit distance / length of the longer one, of at least `similarity`.

1. Texts are reduced to their distinct ones by 128 bits of MD5, and numbered. Exact copies meet
   only in aggregates that combine on the map side.
2. A k-mer is a run of words, labelled with its occurrence number in the text (the first time, the
   second time, ...). A sketch takes, for one random order, the `ell` least labelled k-mers and
   hashes them in text order. Unlike MinHash, two texts agree only if they share these k-mers in
   the same order, as texts of high edit similarity do. k-mers are five words; in texts of few
   words, where one edit may hit every run of five, they are two (FAMILIES; lengths overlap, so that
   any two texts whose lengths may go together have one family in common).
3. Texts that agree in one sketch form a bucket. A bucket of n texts first gives 2n - 3 pairs: each
   member with the least and with the greatest node. No bucket is capped, and none is gathered in
   one place: the two ends come from an aggregate and are joined back.
4. Candidate pairs are verified by banded alignment: bounds by length and by shared word
   pairs, which never reject a true pair, then the band, widened as far as `similarity` asks.
   First each text's likeliest partner, then all that still lie between two classes.
5. Verified pairs are joined to classes (connected components).
6. Texts whose buckets still hold several classes are then compared beyond the buckets' ends. Texts
   of `similarity` share so many word pairs that their rarest ones (2 (1 - similarity) * length and
   SHARED more; repeats numbered, one order for all texts) have SHARED in common, so every two
   texts of different classes that meet in as many are verified. Word pairs of more than COMMON
   open texts make no rows here: a text that has such a pair even among its rarest is crowded.
7. Crowded texts (pages made from one template are) are compared by what they have in buckets: each
   has the largest of its buckets for a home, homes are cut into blocks of like length and bounded
   size, and each two blocks that hold several classes, whose lengths may go together and that meet
   in some bucket are a unit of work, once, however many buckets they meet in. A task counts the word
   pairs that the texts of a unit share by a matrix product and aligns those that share enough; only
   verified links leave it. So every pair of texts that agree in a sketch is decided, whatever they share.

Recall: a pair of similarity s agrees in a sketch with a probability of about
(s**k / (2 - s**k)) ** ell where edits are spread evenly. The README has a measured table by length
and similarity: 0.9 or more at a similarity of 0.8 from 10 words on.

Defined results: null texts equal empty ones; all empty texts are exact copies of one another;
white-space-only texts likewise have no words and are near duplicates only of exact copies; texts of
any length are read whole; rows are kept one for one, null ids too (a class's id is its least id
that isn't null, null if it has none); an empty table gives an empty result; extra columns are left
out, except in `one_per_class`, which keeps all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.align import aligned, sorted_bigrams
from lodestar.llm.common import DataFrameSchema, SharedTables, WordHashes, fresh, map_texts, mix64, shingle_hashes, text_digest
from lodestar.llm.components import merged

#: Sketches of texts by their number of words: (least, most, k, sketches). A text near a bound is in both.
FAMILIES = ((0, 125, 2, 20), (100, 1 << 62, 5, 80))
#: Rare word pairs that two open texts must share, and the most open texts that one may be in (beyond it, step 7).
SHARED, COMMON = 3, 64
#: A block of crowded texts: about as many texts and words; and about the words that one task's units hold.
BLOCK, BLOCK_WORDS, DEAL_WORDS = 512, 1 << 17, 1 << 19


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of (k-mer, occurrence number), in text order."""
    kmers = shingle_hashes(words, k)
    order = np.argsort(kmers, kind="stable")
    same = kmers[order]
    new = np.append(True, same[1:] != same[:-1]) if len(same) else np.zeros(0, bool)
    if new.all():
        return mix64(kmers)
    at = np.arange(len(same))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(kmers), np.uint64)
    out[order] = same + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(out)


def order_sketches(kmers: np.ndarray, seeds: np.ndarray, ell: int) -> np.ndarray:
    """One 64-bit value per seed: the ell least k-mers of that order, hashed in text order."""
    folded = (kmers >> np.uint64(32)).astype(np.uint32)
    take = min(ell, len(kmers))
    out = np.empty(len(seeds), np.uint64)
    rows = max(1, (1 << 20) // max(1, len(kmers)))  # bounds memory on very long texts
    for at in range(0, len(seeds), rows):
        s = seeds[at : at + rows]
        ranks = (folded[None, :] ^ (s[:, None] >> np.uint64(32)).astype(np.uint32)) * (s[:, None].astype(np.uint32) | np.uint32(1))
        least = np.empty((len(s), take), np.int64)
        line = np.arange(len(s))
        for j in range(take):
            least[:, j] = ranks.argmin(axis=1)
            ranks[line, least[:, j]] = np.uint32(0xFFFFFFFF)
        least.sort(axis=1)
        h = s.copy()
        for j in range(take):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + kmers[least[:, j]])
        out[at : at + rows] = h
    return out


def sketches_of(words: np.ndarray, families=FAMILIES, ell: int = 2) -> np.ndarray:
    """All sketches of a text, family by family; each family has seeds of its own."""
    out, first = [np.zeros(0, np.uint64)], 1
    for least, most, k, n in families:
        if least <= len(words) <= most:
            out.append(order_sketches(labelled_kmers(words, k), mix64(np.arange(first, first + n, dtype=np.uint64)), ell))
        first += n
    return np.concatenate(out)


def _sketched(texts: DataFrame, families, ell: int) -> DataFrame:
    """digest, n_words and sketches of each text; a copy that its task has met before is skipped."""

    def make():
        of, met = WordHashes(), set()

        def call(batch, rows):
            digests, lengths, found = [], [], []
            for digest, text in zip(batch.column("digest").to_pylist(), rows):
                if digest in met:
                    continue
                if len(met) < 1_000_000:
                    met.add(digest)
                words = of.of(text.lower().split())
                if len(words):
                    digests.append(digest)
                    lengths.append(len(words))
                    found.append(sketches_of(words, families, ell).view(np.int64))
            return {"digest": digests, "n_words": lengths, "sketches": pa.array(found, pa.list_(pa.int64()))}

        return call

    return map_texts(texts, "text", None, "digest binary, n_words int, sketches array<bigint>", make=make)


def _hashed_words(texts: DataFrame) -> DataFrame:
    """node and the hashes of its words. texts: node, text."""

    def make():
        of = WordHashes()
        return lambda batch, rows: {"node": batch.column("node"), "words": [of.of(t.lower().split()).tobytes() for t in rows]}

    return map_texts(texts, "text", None, "node bigint, words binary", make=make)


#: Pairs that are decided at once in a task, about.
PER_PART = 1024


def _pair_links(similarity: float):
    """A cogroup function: the pairs of a deal whose texts align. Tables: deal, a, b and deal, node, words."""
    schema = DataFrameSchema("a bigint, b bigint")

    def run(pairs, texts):
        known = {}
        for node, raw in zip(texts.column("node").to_pylist(), texts.column("words").to_pylist()):
            x = np.frombuffer(raw, np.uint64)
            known[node] = x, sorted_bigrams(x)
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        both = [(known[x], known[y]) for x, y in zip(a, b)]
        words = [(x[0], y[0]) for x, y in both]
        most = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in words]
        keep = np.flatnonzero(aligned(words, most, [(x[1], y[1]) for x, y in both]))
        columns = [pa.array([min(a[i], b[i]) for i in keep], pa.int64()), pa.array([max(a[i], b[i]) for i in keep], pa.int64())]
        return pa.Table.from_arrays(columns, schema=schema.arrow())

    return run


def _verified(pairs: DataFrame, words: DataFrame, tables: SharedTables, similarity: float, name: str) -> DataFrame:
    """The pairs (a, b) whose texts align, as a table.

    Pairs are dealt out by their leaf, an end that has few pairs, where they name one; else one by one.
    A text goes once to each deal that needs it, so a text of very many pairs meets them in many tasks.
    """
    n_words = F.sum(F.col("n_a") + F.col("n_b")) if "n_a" in pairs.columns else F.lit(0)
    n, held = pairs.agg(F.count("*"), n_words).first()
    deals = max(1, -(-n // PER_PART), -(-(held or 0) // DEAL_WORDS))
    deal = F.pmod(F.xxhash64(*(["leaf"] if "leaf" in pairs.columns else ["a", "b"])), F.lit(deals)).alias("deal")
    dealt = pairs.select(deal, "a", "b")
    needed = dealt.select("deal", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.collect_set("deal").alias("deals"))
    texts = words.join(needed, "node").select(F.explode("deals").alias("deal"), "node", "words")
    links = dealt.groupBy("deal").cogroup(texts.groupBy("deal")).applyInArrow(_pair_links(similarity), "a bigint, b bigint")
    return tables.write(links, name)


def _roots(nodes: DataFrame, classes: DataFrame, column: str, root: str) -> DataFrame:
    return nodes.join(classes.select(F.col("node").alias(column), F.col("root").alias(root)), column, "left").withColumn(
        root, F.coalesce(root, column)
    )


def _likely(similarity: float, n_a: str = "n_a", n_b: str = "n_b") -> Column:
    # shorter than `similarity` of the other text: more edits than allowed, whatever the words
    return F.least(n_a, n_b) >= F.lit(similarity - 1e-9) * F.greatest(n_a, n_b)


def near_duplicate_links(texts: DataFrame, copies: DataFrame, tables: SharedTables, similarity: float, families, ell: int) -> DataFrame:
    """node, root of all texts with near duplicates. texts: digest, text; copies: digest, node."""
    # copies of one text may have been sketched by several tasks
    drawn = _sketched(texts, families, ell).join(copies.select("digest", "node"), "digest").dropDuplicates(["digest"])
    drawn = tables.write(drawn.select("node", "n_words", "sketches"), "sketches")
    rows = drawn.select(F.explode("sketches").alias("value"), "node", "n_words")
    ends = [F.min("node").alias("low"), F.min_by("n_words", "node").alias("n_low"), F.max("node").alias("high"), F.max_by("n_words", "node").alias("n_high")]
    ends = tables.write(rows.groupBy("value").agg(*ends).where("low <> high"), "ends")
    members = tables.write(rows.join(ends, "value"), "members")
    pair = lambda a, n_a, b, n_b: members.select(F.col(a).alias("a"), F.col(n_a).alias("n_a"), F.col(b).alias("b"), F.col(n_b).alias("n_b"), F.col("node").alias("leaf"))
    both = pair("low", "n_low", "node", "n_words").unionAll(pair("node", "n_words", "high", "n_high")).where("a <> b").where(_likely(similarity))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("n"), *(F.max(x).alias(x) for x in ("n_a", "n_b", "leaf")))
    pairs = tables.write(pairs, "pairs")
    wanted = tables.write(copies.select("digest", "node").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    kept = texts.join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text"))
    words = tables.write(_hashed_words(kept), "words")
    for name in ("sketches", "ends"):
        tables.drop(name)
    best = F.max(F.struct("n", (-F.col("a")).alias("_"), "a", "n_a", "n_b", "leaf")).alias("best")
    tried = pairs.groupBy("b").agg(best).select("best.a", "b", "best.n_a", "best.n_b", "best.leaf")
    tried = tables.write(tried, "tried-0")
    classes = merged(None, _verified(tried, words, tables, similarity, "links-0"), tables, "classes-0")
    between = _roots(_roots(pairs.join(tried, ["a", "b"], "left_anti"), classes, "a", "root_a"), classes, "b", "root_b")
    more = tables.write(between.where("root_a <> root_b").select("a", "b", "n_a", "n_b", "leaf"), "tried-1")
    classes = merged(classes, _verified(more, words, tables, similarity, "links-1"), tables, "classes-1")
    classes = _beyond_ends(members, tried.unionAll(more).select("a", "b"), classes, words, tables, similarity)
    for name in ("members", "pairs", "wanted", "words", *(f"{x}-{i}" for x in ("tried", "links", "classes") for i in range(2))):
        tables.drop(name)
    return classes


def _prefix(n_words: Column, similarity: float) -> Column:
    """Of how many rarest word pairs two texts have SHARED in common: one more, as longer partners may need fewer."""
    return 2 * F.floor(F.lit(1 - similarity) * n_words + 1e-9) + 1 + SHARED


def _rarest(open_: DataFrame, texts: DataFrame, tables: SharedTables, similarity: float) -> DataFrame:
    """node, n_words, root, rarest: the rarest word pairs of open texts (of, gram), as far as others have them. texts: node, words."""

    def call(batch, _):
        found = [labelled_kmers(np.frombuffer(raw.as_buffer(), np.uint64), 2).view(np.int64) for raw in batch.column("words")]
        return {"node": batch.column("node"), "grams": pa.array(found, pa.list_(pa.int64()))}

    grams = tables.write(map_texts(texts.join(open_, "node", "left_semi"), None, call, "node bigint, grams array<bigint>"), "grams")
    each = grams.select("node", F.explode("grams").alias("gram"))
    several = each.groupBy("gram").agg(F.count("*").alias("of")).where("of > 1")
    met = each.join(several, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("of", "gram"))).alias("met"))
    rows = met.join(grams.select("node", F.size("grams").alias("n_grams")), "node").join(open_, "node")
    # what no other text has comes first
    left = F.greatest(_prefix(F.col("n_words"), similarity) - (F.col("n_grams") - F.size("met")), F.lit(0))
    return tables.write(rows.select("node", "n_words", "root", F.slice("met", F.lit(1), left.cast("int")).alias("rarest")), "rarest")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each of b. Values that many have go through a matrix product, others one by one."""
    value_a, value_b = np.concatenate(a), np.concatenate(b)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    both = np.intersect1d(value_a, value_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    in_a, in_b = np.isin(value_a, both), np.isin(value_b, both)
    column_a, of_a = np.searchsorted(both, value_a[in_a]), of_a[in_a]
    column_b, of_b = np.searchsorted(both, value_b[in_b]), of_b[in_b]
    order = np.argsort(column_b, kind="stable")
    column_b, of_b = column_b[order], of_b[order]
    n_a, n_b = np.bincount(column_a, minlength=len(both)), np.bincount(column_b, minlength=len(both))
    many = n_a * n_b * 16 > out.size
    place = np.where(many, np.cumsum(many) - 1, -1)
    at_a, at_b = place[column_a], place[column_b]
    for first in range(0, int(many.sum()), 2048):
        x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        for matrix, of, at in ((x, of_a, at_a), (y, of_b, at_b)):
            here = (at >= first) & (at < first + 2048)
            matrix[of[here], at[here] - first] = 1
        out += x @ y.T
    start = np.cumsum(n_b) - n_b
    few = np.flatnonzero(at_a < 0)
    for first in range(0, len(few), 1 << 15):
        part = few[first : first + (1 << 15)]
        times = n_b[column_a[part]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = of_b[np.repeat(start[column_a[part]], times) + step]
        out += np.bincount(np.repeat(of_a[part], times) * len(b) + other, minlength=out.size).reshape(out.shape)
    return out


def _unit_links(similarity: float):
    """A group function: verified links between the classes of each unit. Classes linked by one unit are one in the next."""
    schema = DataFrameSchema("a bigint, b bigint")

    def run(table):
        table = table.sort_by([("unit", "ascending"), ("side", "ascending"), ("node", "ascending")])
        unit, side, node, root = (table.column(c).to_numpy() for c in ("unit", "side", "node", "root"))
        raw = table.column("words").to_pylist()
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, x in zip(node.tolist(), raw):
            if n not in known:
                words = np.frombuffer(x, np.uint64)
                known[n] = words, labelled_kmers(words, 2), labelled_kmers(words, 1)
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        links = []
        for first, last in zip(cuts := np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), [*cuts[1:], len(unit)]):
            middle = first + int((side[first:last] == 0).sum())
            one, other = (first, middle), (first, last) if middle == last else (middle, last)
            i, j, score, most = _may_link(*([known[n] for n in node[x:y].tolist()] for x, y in (one, other)), similarity)
            i, j = i + one[0], j + other[0]
            keep = (i < j) & (root[i] != root[j])
            i, j, score, most, width = i[keep], j[keep], score[keep], most[keep], 1
            while len(i):
                now = {r: find(r) for r in np.unique(np.append(root[i], root[j])).tolist()}
                x, y = (np.array([now[r] for r in root[k].tolist()]) for k in (i, j))
                low, high = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((-score, high, low))
                order = order[low[order] != high[order]]
                # the likeliest pairs of each two classes first; more at a time if these fail
                low, high = low[order], high[order]
                head = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(order)])
                place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
                try_, rest = order[place < width], order[place >= width]
                words = [(known[node[a]][0], known[node[b]][0]) for a, b in zip(i[try_], j[try_])]
                for k, yes in zip(try_.tolist(), aligned(words, most[try_].tolist())):
                    if yes and (p := find(int(root[i[k]]))) != (q := find(int(root[j[k]]))):
                        above[max(p, q)] = min(p, q)
                        links.append((int(node[i[k]]), int(node[j[k]])))
                i, j, score, most, width = i[rest], j[rest], score[rest], most[rest], 4 * width
        columns = [pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())]
        return pa.Table.from_arrays(columns, schema=schema.arrow())

    return run


def _may_link(one: list, other: list, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in one and other, score and allowed edits of the pairs that length, shared word pairs and shared words don't rule out."""
    n, m = (np.array([len(x[0]) for x in side]) for side in (one, other))
    longer = np.maximum.outer(n, m)
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    counts = shared_counts([x[1] for x in one], [x[1] for x in other])
    alike = shared_counts([x[2] for x in one], [x[2] for x in other]) >= longer - most
    i, j = np.nonzero((np.abs(np.subtract.outer(n, m)) <= most) & (counts >= longer - 1 - 2 * most) & alike)
    return i, j, counts[i, j] / longer[i, j], most[i, j]


def _crowded_links(crowded: DataFrame, in_class: DataFrame, texts: DataFrame, tables: SharedTables, similarity: float) -> DataFrame | None:
    """Links (a, b) between classes among the crowded texts of each bucket, as a table; None if no bucket has several. in_class: value, node, n_words, root; texts: node, words."""
    rows = in_class.join(crowded, "node", "left_semi")
    split = rows.groupBy("value").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("value")
    rows = tables.write(rows.join(split, "value", "left_semi"), "crowded-members")
    # a text's home is the largest of its buckets: texts of one template meet in many, but are compared once
    at = rows.join(rows.groupBy("value").agg(F.count("*").alias("n")), "value").groupBy("node", "n_words", "root").agg(F.max(F.struct("n", "value")).alias("at"))
    # lengths that may go together are on the same or on neighbouring levels
    level = F.floor(F.log("n_words") / F.log(F.lit(1.001 / similarity))).cast("int").alias("level")
    homes = tables.write(at.select("node", "n_words", "root", F.col("at.value").alias("home"), level), "crowded-homes")
    # a large class has blocks of its own, which need not meet one another
    blocks_of = F.greatest(F.count("*") / BLOCK, F.sum("n_words") / BLOCK_WORDS)
    own = homes.groupBy("home", "level", "root").agg(F.when(blocks_of > 0.5, F.col("root")).otherwise(-1).alias("own"))
    owned = tables.write(homes.join(own, ["home", "level", "root"]), "crowded-owned")
    sizes = owned.groupBy("home", "level", "own").agg(F.ceil(blocks_of).alias("parts"))
    block = F.struct("home", "level", "own", F.pmod(F.xxhash64("node"), "parts").alias("part")).alias("block")
    placed = tables.write(owned.join(sizes, ["home", "level", "own"]).select("node", "n_words", "root", block), "crowded-placed")
    blocks = placed.groupBy("block").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.sum("n_words").alias("n_words"))
    # two blocks are a unit if some bucket has texts of both, so every two texts of a bucket meet
    met = rows.select("value", "node").join(placed.select("node", "block"), "node").select("value", "block").distinct()
    met = tables.write(met.join(blocks, "block"), "crowded-blocks")
    near = met.select("value", *(F.col(x).alias(f"{x}_a") for x in ("block", "first", "last", "n_words")), F.explode(F.array("block.level", F.col("block.level") + 1)).alias("level"))
    once = (F.col("block_a.level") < F.col("level")) | (F.col("block_a") <= F.col("block"))
    several = F.least("first_a", "first") < F.greatest("last_a", "last")
    units = near.join(met.withColumn("level", F.col("block.level")), ["value", "level"]).where(once & several)
    units = units.groupBy("block_a", "block").agg(F.max(F.col("n_words_a") + F.col("n_words")).alias("n_words"))
    units = tables.write(units.withColumn("unit", F.monotonically_increasing_id()), "crowded-units")
    n_words = units.agg(F.sum("n_words")).first()[0]
    links = None
    if n_words is not None:
        ends = units.select("unit", F.col("block_a").alias("block"), F.lit(0).alias("side"))
        ends = ends.unionAll(units.where("block_a <> block").select("unit", "block", F.lit(1).alias("side")))
        deal = F.pmod(F.xxhash64("unit"), F.lit(-(-n_words // DEAL_WORDS))).alias("deal")
        dealt = placed.join(ends, "block").select(deal, "unit", "side", "node", "root").join(texts, "node")
        links = tables.write(dealt.groupBy("deal").applyInArrow(_unit_links(similarity), "a bigint, b bigint"), "links-3")
    for name in ("members", "homes", "owned", "placed", "blocks", "units"):
        tables.drop(f"crowded-{name}")
    return links


def _beyond_ends(members: DataFrame, tried: DataFrame, classes: DataFrame, texts: DataFrame, tables: SharedTables, similarity: float) -> DataFrame:
    """classes after the pairs of open texts that share rare word pairs, and those of crowded texts. texts: node, words."""
    in_class = tables.write(_roots(members.select("value", "node", "n_words"), classes, "node", "root"), "in-class")
    split = in_class.groupBy("value").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("value")
    open_ = tables.write(in_class.join(split, "value", "left_semi").select("node", "n_words", "root").distinct(), "open")
    rarest = _rarest(open_, texts, tables, similarity)
    crowded = tables.write(rarest.where(F.exists("rarest", lambda x: x["of"] > COMMON)).select("node"), "crowded")
    rare = rarest.select("node", "n_words", "root", F.explode(F.filter("rarest", lambda x: x["of"] <= COMMON)).alias("x"))
    rare = tables.write(rare.select(F.col("x.gram").alias("gram"), "node", "n_words", "root"), "rare")
    one, other = (rare.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n_words", "root"))) for x in "ab")
    longer = F.greatest("n_words_a", "n_words_b")
    needed = longer - 1 - 2 * F.floor(F.lit(1 - similarity) * longer + 1e-9)
    met = (
        one.join(other, "gram").where(F.col("root_a") < F.col("root_b")).where(_likely(similarity, "n_words_a", "n_words_b"))
        .groupBy("root_a", "root_b", F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .agg(F.count("*").alias("n"), F.min(needed).alias("needed"), F.max("n_words_a").alias("n_a"), F.max("n_words_b").alias("n_b"))
        .where(F.col("n") >= F.least("needed", F.lit(SHARED)))
    )
    more = tables.write(met.select("a", "b", "n_a", "n_b").join(tried, ["a", "b"], "left_anti"), "pairs-2")
    links = _verified(more, texts, tables, similarity, "links-2")
    among = _crowded_links(crowded, in_class, texts, tables, similarity)
    now = merged(classes, links if among is None else links.unionAll(among), tables, "classes-2")
    for name in ("in-class", "open", "grams", "rarest", "crowded", "rare", "pairs-2", "links-2", "links-3"):
        tables.drop(name)
    return now


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
                           families=FAMILIES, ell: int = 2, tables: SharedTables | None = None) -> DataFrame:
    """Per distinct text: digest, node, root (the least node of its class), least (its least id), n_rows."""
    tables = tables or SharedTables(docs.sparkSession, "omh")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", text_digest(F.col("text")))
    copies = texts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
    copies = tables.write(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    classes = near_duplicate_links(texts.select("digest", "text"), copies, tables, similarity, families, ell)
    rooted = tables.write(_roots(copies, classes, "node", "root"), "rooted")
    for name in ("copies", "classes-2"):
        tables.drop(name)
    return rooted


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_copies (rows with the same text) and class_size for every row."""
    tables = SharedTables(docs.sparkSession, "omh")
    rooted = near_duplicate_classes(docs, id_col, text_col, tables=tables, **options)
    # written, so that Spark can split a class that holds a third of all texts when it joins
    ids = tables.write(rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n_rows").alias("class_size")), "ids")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    known = rooted.join(ids, "root").select("digest", "class_id", F.col("n_rows").alias("n_copies"), "class_size")
    return rows.join(known, "digest").select("doc_id", "class_id", "n_copies", "class_size")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class, the one with the least id; all columns stay.

    Null ids come after all others; of equal ids the text with the least digest stays, and of
    equal rows one.
    """
    rooted = near_duplicate_classes(docs, id_col, text_col, **options)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("best")
    own_id, own_text, keep, of = fresh(docs, "own_id", "own_text", "keep", "of")
    stay = rooted.groupBy("root").agg(best).select(F.col("best.least").alias(keep), F.col("best.digest").alias(of))
    rows = docs.withColumn(own_id, F.col(id_col).cast("bigint")).withColumn(own_text, text_digest(F.col(text_col)))
    on = (F.col(own_text) == F.col(of)) & F.col(own_id).eqNullSafe(F.col(keep))
    return rows.join(stay, on, "left_semi").dropDuplicates([own_text, own_id]).drop(own_id, own_text)
