"""Registry queries: merges, selection, task planning and shards over the document tables.

`documents` stands for the registry and `labels` for a stage table that covers part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as names
from lodestar.operators import merge, select, shard, tasks
from lodestar.plans.base import Tables, query
from lodestar.sources.scratch import shared_folder
from lodestar.sources import sinks
from lodestar.sources.readers import stem


def _stages(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stage tables whose keys overlap in part, with nulls at different places."""
    d = t.documents
    a = d.where("doc_id % 3 <> 0").select("doc_id", F.expr("CASE WHEN doc_id % 4 <> 0 THEN lang END").alias("lang"), F.col("n_chars").alias("size"))
    b = d.where("doc_id % 5 <> 0").select("doc_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN upper(lang) END").alias("lang"), (F.col("n_chars") * 2).alias("size"))
    c = d.where("doc_id % 7 <> 0").select("doc_id", F.col("source").alias("origin"))
    return a, b, c


_STAGES = """
a AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang, n_chars AS size FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS lang, n_chars * 2 AS size FROM documents WHERE doc_id % 5 <> 0),
c AS (SELECT doc_id, source AS origin FROM documents WHERE doc_id % 7 <> 0)
"""


@query("""
SELECT source, count(*) AS n_all, count(*) FILTER (WHERE n_chars >= 200) AS n_long,
       count(*) FILTER (WHERE n_chars >= 200 AND quality = 1) AS n_good,
       count(*) FILTER (WHERE n_chars >= 200 AND quality = 1 AND toxic IS DISTINCT FROM 1) AS n_clean
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def funnel_by_source(t: Tables) -> DataFrame:
    merged = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    steps = [("long", F.col("n_chars") >= 200), ("good", select.is_true(F.col("quality") == 1)), ("clean", select.not_true(F.col("toxic") == 1))]
    return select.funnel(merged, steps, ["source"])


@query(f"WITH {_STAGES} SELECT doc_id, coalesce(a.lang, b.lang) AS lang, coalesce(a.size, b.size) AS size FROM a FULL OUTER JOIN b USING (doc_id)")
def merge_first_existing_wins(t: Tables) -> DataFrame:
    a, b, _ = _stages(t)
    return merge.combine_first(a, b, "doc_id")


@query(f"WITH {_STAGES} SELECT doc_id, coalesce(b.lang, a.lang) AS lang, coalesce(b.size, a.size) AS size FROM a FULL OUTER JOIN b USING (doc_id)")
def merge_first_new_wins(t: Tables) -> DataFrame:
    a, b, _ = _stages(t)
    return merge.merge_first([a, b], "doc_id", existing_wins=False)


@query(f"""WITH {_STAGES} SELECT doc_id, coalesce(a.lang, b.lang) AS lang, coalesce(a.size, b.size) AS size, origin
FROM a FULL OUTER JOIN b USING (doc_id) FULL OUTER JOIN c USING (doc_id)""")
def merge_n_way_one_shuffle(t: Tables) -> DataFrame:
    return merge.merge_first(list(_stages(t)), "doc_id")


@query("""
WITH r AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 <> 0 THEN role END AS role, CASE WHEN turn % 2 = 1 THEN length(text) END AS size FROM conversations)
SELECT conv_id, arg_min(role, turn) FILTER (WHERE role IS NOT NULL) AS role, arg_min(size, turn) FILTER (WHERE size IS NOT NULL) AS size FROM r GROUP BY conv_id
""")
def dedup_first_non_null(t: Tables) -> DataFrame:
    rows = t.conversations.select(
        "conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, F.col("role")).alias("role"),
        F.when(F.col("turn") % 2 == 1, F.length("text").cast("bigint")).alias("size"),
    )
    return merge.first_non_null(rows, "conv_id", "turn")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_key_probe(t: Tables) -> DataFrame:
    return merge.duplicate_keys(t.conversations, "conv_id")


@query("""
SELECT d.doc_id, d.source AS quality, l.quality AS quality_stage, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def left_join_suffix(t: Tables) -> DataFrame:
    # the registry has a (stale) column of that name: it stays, and the stage's is renamed
    return merge.left_join_suffix(t.documents.select("doc_id", F.col("source").alias("quality")), t.labels, "doc_id", "_stage")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def index_assign_if_absent(t: Tables) -> DataFrame:
    return merge.assign_if_absent(merge.assign_if_absent(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "quality"), t.labels, "doc_id", "quality")


@query("""
WITH p AS (SELECT page_id, split_part(url, '/', -1) AS uid FROM pages), u AS (SELECT uid, max(page_id) AS last_page FROM p GROUP BY uid)
SELECT page_id, uid, last_page FROM p JOIN u USING (uid)
""")
def uid_lookup(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.substring_index("url", "/", -1).alias("uid"))
    known = merge.last_by_key(pages.withColumn("last_page", F.col("page_id")), "uid", "last_page", "page_id")
    return pages.join(known, "uid").select("page_id", "uid", "last_page")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1")
def flag_true(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(select.is_true(F.col("toxic") == 1)).select("doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def flag_not_true(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(select.not_true(F.col("toxic") == 1)).select("doc_id")


@query("SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0")
def any_flag(t: Tables) -> DataFrame:
    flags = t.labels.select("doc_id", (F.col("toxic") == 1).alias("t"), (F.col("quality") == 0).alias("q"))
    return flags.where(select.any_true(["t", "q"])).select("doc_id")


@query("SELECT doc_id, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def null_filters(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").isNull().alias("missing"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def semi_instances(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")


@query("""
SELECT doc_id, source FROM documents
WHERE source || '/' || doc_id::VARCHAR NOT IN (SELECT 'src' || (item_id % 20)::VARCHAR || '/' || item_id::VARCHAR FROM benchmark)
""")
def anti_skiplist(t: Tables) -> DataFrame:
    skip = t.benchmark.select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/"), F.col("item_id").cast("string")).alias("key"))
    return select.skip_listed(t.documents.select("doc_id", "source"), ["source", "doc_id"], skip, "key")


@query("SELECT doc_id FROM documents WHERE lower(source) IN ('src0', 'src3') OR n_chars >= 1000")
def case_insensitive_bypass(t: Tables) -> DataFrame:
    return t.documents.where(select.bypass(F.col("source"), ["SRC0", "Src3"], F.col("n_chars") >= 1000)).select("doc_id")


@query("""
SELECT conv_id FROM conversations WHERE turn BETWEEN 0 AND 1 GROUP BY conv_id
HAVING bool_and(length(text) >= 20) AND count(DISTINCT turn) = 2
""")
def all_views_done(t: Tables) -> DataFrame:
    return tasks.all_done(t.conversations, "conv_id", "turn", F.length("text") >= 20, 2)


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(length(text) >= 200)")
def any_view_done(t: Tables) -> DataFrame:
    return tasks.any_done(t.conversations, "conv_id", F.length("text") >= 200)


@query("""
WITH k AS (SELECT DISTINCT conv_id FROM conversations),
need AS (SELECT conv_id, view_idx, resolution FROM k, (VALUES (0), (1), (2)) v(view_idx), (VALUES (256), (512)) r(resolution)),
done AS (SELECT DISTINCT conv_id, turn AS view_idx, CASE WHEN length(text) % 2 = 0 THEN 256 ELSE 512 END AS resolution FROM conversations)
SELECT conv_id, view_idx::INTEGER AS view_idx, resolution::INTEGER AS resolution FROM need
WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.conv_id = need.conv_id AND done.view_idx = need.view_idx AND done.resolution = need.resolution)
""")
def tasks_remaining(t: Tables) -> DataFrame:
    need = tasks.required_tasks(t.conversations.select("conv_id").distinct(), [0, 1, 2], [256, 512])
    done = t.conversations.select(
        "conv_id", F.col("turn").cast("int").alias("view_idx"), F.when(F.length("text") % 2 == 0, 256).otherwise(512).alias("resolution")
    )
    return tasks.remaining_tasks(need, done, ["conv_id", "view_idx", "resolution"])


@query("""
SELECT conv_id, max(length(text)) FILTER (WHERE turn = 0) AS size_view00, max(length(text)) FILTER (WHERE turn = 1) AS size_view01,
       max(length(text)) FILTER (WHERE turn = 2) AS size_view02 FROM conversations GROUP BY conv_id
""")
def pivot_view_flags(t: Tables) -> DataFrame:
    return tasks.to_wide(t.conversations, "conv_id", "turn", [0, 1, 2], F.length("text").cast("bigint"), "size_view")


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) AS n FROM orders)
SELECT o_orderkey, o_custkey, o_orderpriority, i, floor(((i + 1) * 7 - 1)::DOUBLE / n)::INTEGER AS shard FROM r
""")
def rank_shard(t: Tables) -> DataFrame:
    n = t.orders.count()
    rows = shard.global_index(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), [F.col("o_orderkey")])
    return rows.withColumn("shard", shard.contiguous_shard(F.col("i"), F.lit(n), 7))


@query("""
WITH k AS (SELECT DISTINCT conv_id FROM conversations), need AS (SELECT conv_id, v.view_idx FROM k, (VALUES (0), (1)) v(view_idx)),
left_ AS (SELECT * FROM need WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = need.conv_id AND c.turn = need.view_idx AND length(text) >= 60)),
r AS (SELECT *, row_number() OVER (ORDER BY conv_id, view_idx) - 1 AS i, (SELECT count(*) FROM left_) AS n FROM left_)
SELECT conv_id, view_idx::INTEGER AS view_idx, floor(((i + 1) * 4 - 1)::DOUBLE / n)::INTEGER AS shard FROM r
""")
def task_shard(t: Tables) -> DataFrame:
    # shards of what remains, not of all keys
    done = t.conversations.where(F.length("text") >= 60).select("conv_id", F.col("turn").cast("int").alias("view_idx"))
    need = tasks.required_tasks(t.conversations.select("conv_id").distinct(), [0, 1], [0]).drop("resolution")
    rest = tasks.remaining_tasks(need, done, ["conv_id", "view_idx"])
    n = rest.count()
    rows = shard.global_index(rest, [F.col("conv_id"), F.col("view_idx")])
    return rows.select("conv_id", "view_idx", shard.contiguous_shard(F.col("i"), F.lit(n), 4).alias("shard"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey // 1024 AS batch, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) - 1 AS i,
                  count(*) OVER (PARTITION BY o_orderkey // 1024) AS n FROM orders)
SELECT o_orderkey, batch, floor(((i + 1) * 3 - 1)::DOUBLE / n)::INTEGER AS micro FROM r
""")
def micro_batch_split(t: Tables) -> DataFrame:
    batch = Window.partitionBy("batch")
    # a batch has a bounded number of rows, as a loader's has; more rows are more batches
    rows = t.orders.select("o_orderkey", F.expr("o_orderkey div 1024").alias("batch"))
    i, n = F.row_number().over(batch.orderBy("o_orderkey")) - 1, F.count("*").over(batch)
    return rows.select("o_orderkey", "batch", shard.contiguous_shard(i, n, 3).alias("micro"))


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) - 1 AS i FROM documents)
SELECT doc_id, source, (i % 4)::INTEGER AS rank, floor(i / 4.0)::BIGINT AS place FROM r WHERE floor(i / 4.0) > 9
""")
def epoch_permutation_resume(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", shard.uniform_key(F.col("doc_id"), "7").alias("u"))
    rows = shard.global_index(rows, [F.col("u"), F.col("doc_id")])
    rank, place = shard.epoch_positions(F.col("i"), F.lit(0), 4)
    return rows.select("doc_id", "source", rank.alias("rank"), place.alias("place")).where("place > 9")


def _packing(rows: str, bins: int, most: str) -> str:
    """CTEs of a greedy packing: rows has batch, item, load; each step gives the batch's next item to its least loaded open bin."""
    return f"""o AS MATERIALIZED (SELECT batch, item, load, row_number() OVER (PARTITION BY batch ORDER BY load DESC, item DESC) AS i FROM {rows}),
s AS (SELECT batch, 0::BIGINT AS i, NULL::BIGINT AS item, -1 AS bin, list_transform(range({bins}), lambda b: 0::BIGINT) AS loads, list_transform(range({bins}), lambda b: 0) AS sizes FROM o GROUP BY batch
  UNION ALL SELECT batch, i, item, bin, list_transform(range({bins}), lambda b: loads[b + 1] + CASE WHEN b = bin THEN load ELSE 0 END), list_transform(range({bins}), lambda b: sizes[b + 1] + (b = bin)::INTEGER)
  FROM (SELECT o.batch, o.i, o.item, o.load, s.loads, s.sizes, (list_position(e, list_min(e)) - 1)::INTEGER AS bin
        FROM (SELECT *, list_transform(range({bins}), lambda b: CASE WHEN sizes[b + 1] < {most} THEN loads[b + 1] ELSE 1000000000000000 END) AS e FROM s) s JOIN o ON o.batch = s.batch AND o.i = s.i + 1))"""


@query(f"""WITH RECURSIVE d AS (SELECT doc_id // 256 AS batch, doc_id AS item, n_chars AS load FROM documents), {_packing("d", 4, "1000000000")}
SELECT s.batch, s.item AS doc_id, load AS n_chars, bin FROM s JOIN o USING (batch, i)""")
def lpt_pack(t: Tables) -> DataFrame:
    return shard.lpt_pack(t.documents.withColumn("batch", F.expr("doc_id div 256")), "batch", "doc_id", "n_chars", 4)


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n, count(*) + (-count(*) % 3 + 3) % 3 AS total FROM documents),
e AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('5|2|' || doc_id::VARCHAR), doc_id) - 1 AS i FROM documents),
p AS (SELECT doc_id, n_chars, i FROM e UNION ALL SELECT doc_id, n_chars, i + n FROM e, n WHERE i < total - n),
d AS (SELECT i // 24 AS batch, i AS item, n_chars AS load, doc_id FROM p, n WHERE i // 24 < total // 24), {_packing("d", 3, "8")}
SELECT doc_id, s.item AS i, s.batch, s.bin AS rank FROM s JOIN d ON d.item = s.item""")
def balanced_epoch(t: Tables) -> DataFrame:
    """Three ranks of eight samples each; the epoch is padded to whole ranks."""
    return shard.balanced_epoch(t.documents, "doc_id", "n_chars", "5", 2, 3, 8)


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT doc_id, e FROM documents, range(0, 2) t(e)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY e, md5('9|' || e::VARCHAR || '|' || doc_id::VARCHAR), doc_id) - 1 AS step FROM e)
SELECT doc_id, step::BIGINT AS step, CASE WHEN step < n // 3 THEN 0 WHEN step < n THEN 1 ELSE 2 END AS run FROM r, n WHERE step < n + n // 2
""")
def resumed_walk(t: Tables) -> DataFrame:
    """Three runs, each of which reads where the one before ended and saves where it ends itself."""
    path, docs, out = shared_folder(t.spark, "cursor"), t.documents.select("doc_id"), None
    n = docs.count()
    for run, count in enumerate((n // 3, n - n // 3, n // 2)):
        start = shard.saved_cursor(t.spark, path, n)
        part = shard.cycled(docs, "doc_id", "9", start, count).withColumn("run", F.lit(run))
        out = part if out is None else out.unionByName(part)
        shard.save_cursor(t.spark, path, start + count, n)
    return out


@query("""
WITH m AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT count(*)::DOUBLE AS n_rows, count(quality)::DOUBLE AS n_quality, count(n_chars)::DOUBLE AS n_n_chars, count(*) FILTER (WHERE toxic = 1)::DOUBLE AS sum_is_toxic FROM m)
SELECT metric, value FROM (UNPIVOT s ON n_rows, n_quality, n_n_chars, sum_is_toxic INTO NAME metric VALUE value)
""")
def stage_statistics(t: Tables) -> DataFrame:
    merged = t.documents.drop("text").join(t.labels, "doc_id", "left").withColumn("is_toxic", F.col("toxic") == 1)
    return sinks.as_metrics(select.stage_statistics(merged, ["quality", "n_chars"], ["is_toxic"]))


@query("""
SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS quantity, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_orderkey
""")
def asset_sums(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n_items"), F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned")
    )


@query("""
SELECT user_id % 8 AS worker, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS processed, sum(coalesce(CASE WHEN value < 10 THEN 1 END, 0))::BIGINT AS skipped
FROM events GROUP BY user_id % 8
""")
def worker_totals(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 8).alias("worker"), (F.col("event_type") == "click").cast("int").alias("p"), F.when(F.col("value") < 10, 1).alias("s"))
    return rows.groupBy("worker").agg(F.sum("p").alias("processed"), F.sum(F.coalesce("s", F.lit(0))).alias("skipped"))


@query("SELECT event_id AS sha256 FROM events WHERE value < 5")
def error_rows(t: Tables) -> DataFrame:
    results = t.events.select(F.col("event_id").alias("sha256"), F.when(F.col("value") < 5, "failed").alias("error"))
    return sinks.error_keys(results)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", names.content_hash(F.col("text")).alias("sha256"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey % 7 AS a, o_custkey % 5 AS b, o_custkey % 5 + o_orderkey % 4 AS c FROM orders)
SELECT o_orderkey, a || ', ' || b || '-' || c || ',' || a AS spec, list_transform(list_sort(list_distinct(list_append(range(b, c + 1), a))), lambda x: x::INTEGER) AS views FROM s
""")
def range_list_parse(t: Tables) -> DataFrame:
    a, b, more = F.col("o_orderkey") % 7, F.col("o_custkey") % 5, F.col("o_orderkey") % 4
    spec = F.concat(a.cast("string"), F.lit(", "), b.cast("string"), F.lit("-"), (b + more).cast("string"), F.lit(","), a.cast("string"))
    specs = t.orders.select("o_orderkey", spec.alias("spec"))
    return specs.select("o_orderkey", "spec", names.range_list(F.col("spec")).alias("views"))


@query("""
WITH k AS (SELECT p_partkey, p_size, ['dual_grid', 'dual_grid_view', 'pbr_voxels_view_fix', 'renders_cond', 'viewer_3d'][p_partkey % 5 + 1] AS kind FROM part)
SELECT p_partkey, kind || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || p_size END AS name, kind, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS resolution, p_partkey % 5 IN (1, 2) AS by_view FROM k
""")
def dirname_classify(t: Tables) -> DataFrame:
    """Stage folders named after the parts, with a resolution for two of three."""
    kinds = F.array(*map(F.lit, ("dual_grid", "dual_grid_view", "pbr_voxels_view_fix", "renders_cond", "viewer_3d")))
    suffix = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("p_size").cast("string")))
    rows = t.part.select("p_partkey", F.concat(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), suffix).alias("name"))
    name = F.col("name")
    return rows.select("p_partkey", "name", names.folder_kind(name).alias("kind"), names.folder_resolution(name).alias("resolution"), names.is_view_folder(name).alias("by_view"))


@query("SELECT p_partkey, replace(p_name, ' ', '.cross_attn.') AS old_key, replace(p_name, ' ', '.proj_attn.') AS new_key FROM part")
def key_remap(t: Tables) -> DataFrame:
    old = F.replace(F.col("p_name"), F.lit(" "), F.lit(".cross_attn."))
    return t.part.select("p_partkey", old.alias("old_key"), F.regexp_replace(old, r"\.cross_attn\.", ".proj_attn.").alias("new_key"))


@query("""
SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'missing' ELSE 'unexpected' END AS side FROM part
WHERE (p_partkey % 2 = 0) <> (p_partkey % 3 = 0) AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)
""")
def key_set_diff(t: Tables) -> DataFrame:
    keys = t.part.select(F.col("p_partkey").alias("key"))
    return merge.key_difference(keys.where("key % 2 = 0"), keys.where("key % 3 = 0"), "key")


@query(f"WITH {_STAGES} SELECT doc_id, lang, size FROM a UNION ALL SELECT doc_id, lang, size FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def append_new_records(t: Tables) -> DataFrame:
    a, b, _ = _stages(t)
    return merge.append_unknown(a, b, "doc_id")


@query("SELECT page_id, regexp_replace(split_part(url, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages".replace("\\\\", "\\"))
def path_stem(t: Tables) -> DataFrame:
    return t.pages.select("page_id", stem(F.substring_index("url", "/", -1)).alias("stem"))


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def finite_features(t: Tables) -> DataFrame:
    return t.embeddings.where(select.finite("embedding")).select("vec_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def heaviest_first(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(100)
