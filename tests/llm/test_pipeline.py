"""The pipeline against a plain version of each stage, on small tables."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd

from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import mixing, tokens, toxicity
from lodestar.llm.common import WordHashes, shingle_hashes


def distance_within(a, b, most):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j - 1] + (x != y), line[j] + 1, new[-1] + 1))
        line = new
    return line[-1] <= most


def tables(folder):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(800)}"
    items = [[f"b{rng.randrange(900)}" for _ in range(20)] for _ in range(6)]
    texts = []
    for i in range(240):
        words = [word() for _ in range(rng.randint(20, 45))]
        if i % 8 == 0:
            words[::6] = [rng.choice(["vile", "awful", "nasty"]) for _ in words[::6]]
        if i % 11 == 0:
            words[5:5] = rng.choice(items)
        texts.append(words)
    texts += [texts[i][:10] + ["new"] + texts[i][11:] for i in range(0, 60, 3)]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": [" ".join(t) for t in texts]})
    docs["lang"], docs["source"] = "en", [rng.choice(["s", "s", "t", "u"]) for _ in texts]
    docs["n_chars"] = docs.text.str.len()
    labels = pd.DataFrame({"doc_id": range(0, 240), "quality": 1, "toxic": [int(i % 8 == 0) for i in range(240)]})
    bench = pd.DataFrame({"item_id": range(6), "text": [" ".join(i) for i in items]})
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.to_parquet(f"{folder}/{name}.parquet")
    return docs, bench


def test_pipeline_agrees_with_plain_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, bench = tables(folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    scores = toxicity.classify(read("documents"), read("labels")).toPandas()
    docs = docs[docs.doc_id.isin(scores[scores.predicted == 0].doc_id)]
    assert 200 < len(docs) < 250
    words = {d: t.lower().split() for d, t in zip(docs.doc_id, docs.text)}
    parent = {d: d for d in words}
    find = lambda i: i if parent[i] == i else find(parent[i])
    ids = sorted(words)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            most = 0.2 * max(len(words[i]), len(words[j]))
            if abs(len(words[i]) - len(words[j])) <= most and len(set(words[i]) & set(words[j])) > 3 and distance_within(words[i], words[j], most):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = docs[docs.doc_id.map(lambda d: find(d) == d)]
    of = WordHashes()
    sets = {d: set(shingle_hashes(of.of(t.lower().split())).tolist()) for d, t in zip(docs.doc_id, docs.text)}
    items = [set(shingle_hashes(of.of(t.lower().split())).tolist()) for t in bench.text]
    docs = docs[docs.doc_id.map(lambda d: not any(len(q & sets[d]) >= 0.8 * len(q) for q in items))]
    db = duckdb.connect()
    db.register("documents", docs)
    taken = db.execute(mixing.ORACLE_SQL).df().set_index("doc_id")
    tok, want, start = tokens.tokenizer(tokens.default_path()), [], 0
    for d, t in sorted(zip(docs.doc_id, docs.text)):
        for _ in range(int(taken.taken[d] // taken["size"][d])):
            x = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.append((d, start, len(x), zlib.crc32(x.tobytes())))
            start += len(x)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    tables(str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_take_odd_rows_and_names(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows and names with dots, through all stages in a row."""
    tables(str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(30)
    schema = docs.schema.simpleString().removeprefix("struct<").removesuffix(">")
    odd = spark.createDataFrame([(None, "alone in this text", "en", "s", 3), (None, None, None, None, None), (900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, None, "en", None, 0),
                                 (902, "the very same row", "en", "u", 1), (902, "the very same row", "en", "u", 1)], schema)
    docs = docs.unionAll(odd).withColumn("a.b", F.col("n_chars") + 1).withColumn("score", F.lit(5)).withColumn("c0", F.lit("kept"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.where("c0 <> 'kept' OR score <> 5 OR `a.b` <> n_chars + 1").count() == 0
        if name == "near_duplicates":  # one of the repeated rows and one of the texts without words are left
            assert docs.where("doc_id = 902").count() == 1 and docs.where("coalesce(text, '') = ''").count() == 1
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(rows) == docs.count() and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
