import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import mixing, topk, toxicity


def test_mixing_and_top_k_agree_with_sql(agrees):
    agrees("op10_pareto_mix")
    agrees("op7_exact_top_k")


def test_targets_stop_at_three_times_a_source(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 5)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.allocate(sources).collect()}
    assert got["a"] == 30 and got[None] == 15
    rest = 1515 - 45
    assert abs(got["b"] - rest * 2 / 3) < 1e-9 and abs(got["c"] - rest / 3) < 1e-9


def test_taken_words_come_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["s", "t", "t", "u", None]), "w " * rng.choice([0, 1, 5, 40]), 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copies int")
    per = mixing.mix_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"))
    assert all(abs(r.n - r.t) <= 40 for r in per.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "source", "text", "size", "source_size", "target", "copies"]
    assert mixed.agg(F.max("copies")).first()[0] <= 3
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == mixed.agg(F.sum("copies")).first()[0]


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a", ""), (2, "a", "x")], "doc_id bigint, source string, text string")
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 1
    assert mixing.mix_sizes(docs.limit(0)).count() == 0
    assert all(r.target == 0 for r in mixing.mix_sizes(docs.where("doc_id = 1")).collect())


def test_equal_and_null_ids_meet_their_targets(spark):
    """One id for all rows, null ids, and equal rows: within one document of each target, as SQL takes them."""
    import duckdb

    rng = random.Random(5)
    tables = [
        [(7, s, f"w{i} " * rng.choice([1, 3, 9])) for i in range(400) for s in ("a", "b", "c")],
        [(None, s, "w " * rng.choice([1, 3, 9])) for _ in range(300) for s in ("a", "b", None)],
        [(7, s, "same text") for _ in range(500) for s in ("a", "b", "c")] + [(i, "c", "x y z") for i in range(50)],
    ]
    for rows in tables:
        docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
        got = mixing.mix_sizes(docs.repartition(5)).toPandas()
        longest = max(len(t.split()) for _, _, t in rows)
        by_target = got.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), n=("size", "sum")).reset_index()
        # sources of equal size and target come as one
        off = (by_target.taken - by_target.target * by_target.n / by_target.source_size).abs()
        assert (off <= longest * by_target.n / by_target.source_size).all()
        documents = docs.toPandas()  # noqa: F841
        want = duckdb.sql(mixing.ORACLE_SQL).df()
        key = lambda df: sorted(map(tuple, df[["doc_id", "size", "source_size", "target", "taken"]].astype(float).round(6).fillna(-1).values.tolist()))
        assert key(got) == key(want)
        mixed = mixing.repeated(docs.withColumn("_mix_size", F.lit(7)).withColumn("_mix_source", F.lit("x")).withColumn("q", F.lit(1.5)))
        assert mixed.columns == ["doc_id", "source", "text", "_mix_size", "_mix_source", "q"]
        assert mixed.where("_mix_size = 7 and _mix_source = 'x' and q = 1.5").agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == got.taken.sum()


def test_mix_keeps_clashing_columns_and_sizes_long_texts(spark):
    docs = spark.createDataFrame([(1, "a", "w " * 300_000, 7, 8, 9), (2, "b", "x", 7, 8, 9)], "doc_id bigint, source string, text string, _mix_share int, q int, bin int")
    got = mixing.mix(docs).collect()
    assert {(r["_mix_share"], r.q, r.bin) for r in got} == {(7, 8, 9)} and {r["size"] for r in got} == {300_000, 1}


def test_mixing_needs_no_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "x y")], "doc_id bigint, source string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_top_k_edges(spark):
    rows = [(0, [1.0, -1.0]), (50, [0.5, 0.5]), (1, [2.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [9.0, 9.0]), (6, [2.0, 0.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect())
    assert got == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 6, 131072), (50, 1, 1, 65536), (50, 2, 1, 65536), (50, 3, 6, 65536)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_threshold_walk_is_right():
    rng = np.random.default_rng(1)
    for n, dim, scale in ((1, 3, 2), (3, 2, 5), (500, 3, 50), (4000, 4, 1000), (300, 64, 256), (500, 70, 1 << 28)):
        v = rng.integers(-scale, scale + 1, (n, dim))
        ids = np.arange(n)
        q_ids = np.array([0, n + 5])
        for floors in (None, np.array([topk.LEAST, sorted(v @ v[n - 1])[-min(5, n)]])):
            found = topk.threshold_search(q_ids, v[[0, n - 1]], ids, v, 5, None, floors)
            for (i, rows, scores, _, _), q, row in zip(found, q_ids.tolist(), v[[0, n - 1]]):
                want = sorted(((-int(s), int(j)) for j, s in zip(ids, v @ row) if j != q))[:5]
                assert [(-int(s), int(j)) for s, j in zip(scores, rows)] == want


def test_walk_reads_little_where_components_are_skewed():
    rng = np.random.default_rng(2)
    n = 20_000
    v = (rng.pareto(1.5, (n, 8)) * 20).astype(np.int64) * rng.choice([-1, 1], (n, 8))
    found = topk.threshold_search(np.arange(20), v[:20], np.arange(n), v, 5)
    for i, rows, scores, read, met in found:
        best = np.lexsort((np.arange(n), -(v @ v[i])))
        assert rows.tolist() == [j for j in best[:6].tolist() if j != i][:5]
    assert sum(read for *_, read, _ in found) < 20 * n / 4 and sum(met for *_, met in found) < 20 * n / 8


def test_bars_of_the_first_block_hold_in_all_others(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((400, 6)), 2).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert len(whole) == 40 and sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, block_bytes=2000, query_bytes=100).collect())) == whole


def toxic_corpus(spark, n=1500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        if toxic:
            words[::9] = [rng.choice(["vile", "awful", "nasty"]) for _ in words[::9]]
        rows.append((i, " ".join(words), 0.0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.classify(docs, labels).toPandas()
    truth = got.doc_id % 8 == 0
    held = got.held_out
    assert 0.1 < held.mean() < 0.3 and len(got) == 1500
    assert ((got.predicted == 1) == truth)[held].mean() > 0.97
    assert got.score.between(0, 1).all()
    again = toxicity.classify(docs, labels).toPandas().set_index("doc_id").score
    assert (again.loc[got.doc_id].to_numpy() == got.score.to_numpy()).all()


def test_held_out_labels_are_not_learned(spark):
    docs, labels = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.classify(docs, x).orderBy("doc_id").toPandas().score for x in (labels, flipped))
    assert (a == b).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "plain", "x"), (2, "plain", "x")], "doc_id bigint, text string, toxic string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got)
    assert toxicity.classify(docs.limit(0), none).count() == 0
    model = toxicity.train(docs, none)
    assert toxicity.with_scores(docs, model, score_col="toxic").columns == ["doc_id", "text", "toxic"]


def test_risk_never_pays_for_negative_estimates():
    pos, unl = [np.array([0, 1], np.int32)] * 30, [np.array([0, 1], np.int32)] * 10 + [np.array([2, 3], np.int32)] * 90
    model = toxicity.fit(pos, unl, 0.1, 4)
    assert model.weights[0] + model.weights[1] > 0 > model.weights[2] + model.weights[3]
    assert np.abs(model.weights).max() < 50


def test_slopes_are_those_of_the_plain_risk():
    """Against finite differences of the risk, written out term by term; reversed where the bracket is negative."""
    rng = np.random.default_rng(4)
    for shift in (0.0, -4.0):
        pos, unl, prior = rng.normal(size=5), rng.normal(size=9) + shift, 0.4
        loss = lambda z: float(np.log(1 + np.exp(-z)))

        def terms(p, u):
            plus = 0.4 * sum(loss(x) for x in p) / 5
            return plus, sum(loss(-x) for x in u) / 9 - 0.4 * sum(loss(-x) for x in p) / 5

        plus, bracket = terms(pos, unl)
        assert np.allclose(toxicity.risk(pos, unl, prior), (plus, bracket)) and (bracket < 0) == (shift < 0)
        target = (lambda p, u: sum(terms(p, u))) if bracket >= 0 else (lambda p, u: -terms(p, u)[1])
        both, got = np.concatenate([pos, unl]), toxicity.slopes(pos, unl, prior)
        for i in range(14):
            up, down = both.copy(), both.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((target(up[:5], up[5:]) - target(down[:5], down[5:])) / 2e-5 - got[i]) < 1e-6


def test_fitting_sample_is_bounded_in_words_and_long_texts_are_scored(spark):
    docs, labels = toxic_corpus(spark, 300)
    long = spark.createDataFrame([(9001, "vile " + "w1 " * 300_000, 0.0)], "doc_id bigint, text string, score double")
    model = toxicity.train(docs.unionAll(long), labels, max_words=2000)
    assert toxicity.score(docs.unionAll(long), model).count() == 301
