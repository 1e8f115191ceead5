"""The engine's queries over the driver's tables, and equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.functions import text as text_fns
from palimspark.operators import analytics, compress, delta, joins, layout, retrieve
from palimspark.plans.stage import folder, staged
from palimspark.sources import dumps, store, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_REV = """rev AS (
  SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, conv_id * 1000 + turn AS revid, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS size FROM conversations
)"""
_EV = """ev AS (
  SELECT user_id AS page_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, event_id AS revid, ts, coalesce(props, '') AS text FROM events
)"""
_STEP = """step AS (SELECT *, lag(size) OVER (PARTITION BY page_id ORDER BY idx) AS prev_size FROM rev
), item AS (SELECT page_id, idx, size, prev_size, 2 * abs(size - prev_size) AS diff, 2 * abs(size - prev_size) - prev_size AS value, prev_size + 2 * abs(size - prev_size) AS weight FROM step WHERE idx > 0
)"""
_PART = """flag AS (SELECT r.*, NOT (coalesce(i.value, 0) > 0 AND coalesce(i.weight, 0) > 0) AS is_anchor FROM rev r LEFT JOIN item i USING (page_id, idx)
), part AS (SELECT *, (sum(is_anchor::INT) OVER (PARTITION BY page_id ORDER BY idx) - 1)::INT AS part_id, lag(size) OVER (PARTITION BY page_id ORDER BY idx) AS prev_size FROM flag
)"""
_COST = """cost AS (SELECT page_id, count(*)::BIGINT AS n_revisions, sum(is_anchor::INT)::BIGINT AS n_anchors, sum(size)::BIGINT AS orig_size,
  sum(CASE WHEN is_anchor THEN size ELSE abs(size - prev_size) END)::BIGINT AS space_cost, sum(CASE WHEN is_anchor THEN 1 ELSE prev_size + abs(size - prev_size) END)::BIGINT AS time_cost
  FROM part GROUP BY page_id
)"""
_CHAIN = """chain AS (SELECT page_id, part_id, count(*)::BIGINT AS chain_len FROM part GROUP BY ALL)"""
_ALL = f"WITH {_REV}, {_STEP}, {_PART}, {_COST}, {_CHAIN}"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _fixed_sql(step: str, extra: str = "") -> str:
    return f"""WITH {_REV}, n AS (SELECT page_id, count(*) AS n FROM rev GROUP BY 1), {extra} x AS (
  SELECT rev.*, lag(size) OVER (PARTITION BY page_id ORDER BY idx) AS prev_size, idx % ({step}) = 0 AS is_anchor FROM rev JOIN n USING (page_id)
) SELECT page_id, count(*)::BIGINT AS n_revisions, sum(is_anchor::INT)::BIGINT AS n_anchors, sum(size)::BIGINT AS orig_size,
  sum(CASE WHEN is_anchor THEN size ELSE abs(size - prev_size) END)::BIGINT AS space_cost, sum(CASE WHEN is_anchor THEN 1 ELSE prev_size + abs(size - prev_size) END)::BIGINT AS time_cost FROM x GROUP BY page_id"""


def _sizes(spark, sf_dir) -> DataFrame:
    """Without texts, numbered once."""
    return staged(tables.conversations(spark, sf_dir).select("page_id", "idx", "size"), "sizes")


@query(f"WITH {_REV} SELECT page_id, idx, size FROM rev")
def sizes(spark, sf_dir):
    return tables.conversations(spark, sf_dir).select("page_id", "idx", "size")


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, diff FROM item")
def approx_diffs(spark, sf_dir):
    return layout.transitions(tables.conversations(spark, sf_dir)).select("page_id", "idx", "diff")


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, value FROM item")
def memory_saved(spark, sf_dir):
    return layout.transitions(tables.conversations(spark, sf_dir)).select("page_id", "idx", "value")


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, weight FROM item")
def time_weights(spark, sf_dir):
    return layout.transitions(tables.conversations(spark, sf_dir)).select("page_id", "idx", "weight")


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, size - abs(size - prev_size) AS value FROM item")
def memory_saved_alternative(spark, sf_dir):
    return layout.transitions(tables.conversations(spark, sf_dir), "saved_size").select("page_id", "idx", "value")


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, value, weight FROM item WHERE value > 0 AND weight > 0")
def candidates(spark, sf_dir):
    return layout.candidates(tables.conversations(spark, sf_dir)).select("page_id", "idx", "value", "weight")


@query(f"{_ALL} SELECT page_id, idx, is_anchor, part_id FROM part")
def partitions_all(spark, sf_dir):
    return layout.partition_all(_sizes(spark, sf_dir)).select("page_id", "idx", "is_anchor", "part_id")


@query(f"{_ALL} SELECT * FROM cost")
def partition_costs(spark, sf_dir):
    return layout.costs(layout.partition_all(_sizes(spark, sf_dir)))


_SUMMARY = f"""{_ALL}, page AS (
  SELECT c.*, k.n_partitions, k.avg_chain_len, k.max_chain_len, CASE WHEN orig_size > 0 THEN space_cost / orig_size END AS compression_ratio, n_anchors / n_revisions AS anchor_density
  FROM cost c JOIN (SELECT page_id, count(*)::BIGINT AS n_partitions, avg(chain_len) AS avg_chain_len, max(chain_len) AS max_chain_len FROM chain GROUP BY 1) k USING (page_id)
)"""


@query(f"{_SUMMARY} SELECT page_id, n_revisions, n_anchors, orig_size, space_cost, time_cost, n_partitions, round(avg_chain_len, 6) AS avg_chain_len, max_chain_len, round(compression_ratio, 6) AS compression_ratio, round(anchor_density, 6) AS anchor_density FROM page")
def page_summary(spark, sf_dir):
    x = analytics.page_summary(layout.partition_all(_sizes(spark, sf_dir)))
    return x.withColumns({c: F.round(c, 6) for c in ("avg_chain_len", "compression_ratio", "anchor_density")})


@query(f"""{_SUMMARY} SELECT count(*)::BIGINT AS artifacts, round(avg(compression_ratio), 6) AS mean_ratio, round(median(compression_ratio), 6) AS median_ratio,
  round(avg(anchor_density), 6) AS avg_density, round(avg(time_cost), 4) AS avg_time, round(avg(space_cost), 4) AS avg_space FROM page""")
def corpus_aggregate(spark, sf_dir):
    x = analytics.corpus_aggregate(analytics.page_summary(layout.partition_all(_sizes(spark, sf_dir))))
    return x.withColumns({c: F.round(c, 4 if c in ("avg_time", "avg_space") else 6) for c in x.columns[1:]})


@query(f"{_ALL} SELECT chain_len, count(*)::BIGINT AS n FROM chain GROUP BY 1")
def chain_lengths(spark, sf_dir):
    parts = layout.partition_all(_sizes(spark, sf_dir))
    return analytics.chain_lengths(parts).groupBy("chain_len").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ALL}, e AS (SELECT min(chain_len)::DOUBLE AS lo, max(chain_len)::DOUBLE AS hi FROM chain), b AS (
  SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((chain_len - lo) / ((hi - lo) / 20)), 19) END::INT AS bin, lo, (hi - lo) / 20 AS w FROM chain, e
) SELECT bin, round(lo + bin * w, 6) AS low, count(*)::BIGINT AS n FROM b GROUP BY ALL""")
def chain_histogram(spark, sf_dir):
    x = analytics.chain_histogram(layout.partition_all(_sizes(spark, sf_dir)))
    return x.withColumn("low", F.round("low", 6))


@query(_fixed_sql("3"))
def fixed_interval_k(spark, sf_dir):
    return layout.costs(layout.fixed_interval(tables.conversations(spark, sf_dir).drop("text"), 3))


@query(_fixed_sql("4"))
def fixed_interval_kplus1(spark, sf_dir):
    return layout.costs(layout.fixed_interval(tables.conversations(spark, sf_dir).drop("text"), 3, "k+1"))


@query(_fixed_sql("greatest(floor(sqrt(n))::INT, 1)"))
def k_rootn(spark, sf_dir):
    x = tables.conversations(spark, sf_dir).drop("text")
    ks = layout.interval_choices(x).select("page_id", "root_n")
    return layout.costs(layout.fixed_interval(x.join(ks.hint("merge"), "page_id"), F.col("root_n")))


@query(_fixed_sql("greatest(floor(pow(ln(n), 2))::INT, 1)"))
def k_log2(spark, sf_dir):
    x = tables.conversations(spark, sf_dir).drop("text")
    ks = layout.interval_choices(x).select("page_id", "log2")
    return layout.costs(layout.fixed_interval(x.join(ks.hint("merge"), "page_id"), F.col("log2")))


_CHOICES = f"""WITH {_REV}, {_STEP}, g AS (
  SELECT page_id, count(*) AS n, 0.001::DOUBLE * sum(size)::BIGINT / count(*) AS m, 0.01::DOUBLE * coalesce(sum(abs(size - prev_size)), 0)::BIGINT / count(*) AS d FROM step GROUP BY 1
), c AS (SELECT page_id, n::BIGINT AS n, floor(sqrt(n))::INT AS root_n, floor(pow(ln(n), 2))::INT AS log2, (n - 1)::INT AS n_less_1,
  CASE WHEN m > d AND d > 0 THEN floor(sqrt(n * (m - d) / (m * d)))::BIGINT END AS formula, CASE WHEN m > d AND d > 0 THEN floor(sqrt(n * (m - d) / (m + d)))::BIGINT END AS theorem FROM g)"""


@query(f"{_CHOICES} SELECT * FROM c")
def k_formula(spark, sf_dir):
    return layout.interval_choices(tables.conversations(spark, sf_dir))


@query(f"""{_CHOICES}, k AS (SELECT page_id, choice, k FROM (
  SELECT page_id, 'one' AS choice, 1::BIGINT AS k FROM c UNION ALL SELECT page_id, 'root_n', root_n FROM c UNION ALL SELECT page_id, 'formula', formula FROM c
  UNION ALL SELECT page_id, 'thousand', 1000 FROM c UNION ALL SELECT page_id, 'n_less_1', n_less_1 FROM c) WHERE k >= 1)
SELECT page_id, choice, k, sum(CASE WHEN idx % k = 0 THEN size ELSE abs(size - prev_size) END)::BIGINT AS space_cost,
  round(CASE WHEN sum(size) > 0 THEN sum(CASE WHEN idx % k = 0 THEN size ELSE abs(size - prev_size) END) / sum(size) END, 6) AS ratio FROM step JOIN k USING (page_id) GROUP BY ALL""")
def k_sweep(spark, sf_dir):
    return analytics.interval_sweep(tables.conversations(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, (abs(size - prev_size) - size) + (prev_size + abs(size - prev_size)) <= 1 AS accepted FROM item")
def merge_greedy(spark, sf_dir):
    return layout.merge_greedy(tables.conversations(spark, sf_dir))


@query(f"WITH {_REV}, {_STEP} SELECT page_id, idx, prev_size AS value, size + 1 AS weight FROM item WHERE idx > 1")
def older_items(spark, sf_dir):
    return layout.older_items(tables.conversations(spark, sf_dir))


@query(f"""WITH {_REV}, {_STEP}, n AS (SELECT page_id, count(*)::INT AS n FROM rev GROUP BY 1 HAVING count(*) <= 8
), m AS (SELECT page_id, unnest(range(0, (1 << (n - 1))))::INT AS mask FROM n
), x AS (SELECT page_id, mask, size, prev_size, idx = 0 OR ((mask >> greatest(idx - 1, 0)) & 1) = 1 AS cut FROM step JOIN m USING (page_id)
) SELECT page_id, mask, sum(CASE WHEN cut THEN size ELSE abs(size - prev_size) END)::BIGINT AS space, sum(CASE WHEN cut THEN 1 ELSE prev_size + abs(size - prev_size) END)::BIGINT AS time FROM x GROUP BY ALL""")
def exhaustive_small(spark, sf_dir):
    return layout.enumerate_partitions(tables.conversations(spark, sf_dir), 8)


@query(f"{_ALL} SELECT page_id, idx, max(CASE WHEN is_anchor THEN idx END) OVER (PARTITION BY page_id ORDER BY idx) AS anchor_idx FROM part")
def asof_anchor(spark, sf_dir):
    return layout.anchor_of(layout.partition_all(_sizes(spark, sf_dir))).select("page_id", "idx", "anchor_idx")


def _compressed(spark, sf_dir, only=None) -> DataFrame:
    return compress.compress(staged(tables.conversations(spark, sf_dir), "revisions"), only=only)


@query(f"WITH {_REV} SELECT page_id, idx, revid, text FROM rev")
def ndiff_roundtrip(spark, sf_dir):
    """Every revision compressed and restored is what it was."""
    return compress.decompress(_compressed(spark, sf_dir)).select("page_id", "idx", "revid", "text")


@query(f"WITH {_REV} SELECT page_id, idx, revid, text FROM rev")
def artifact_roundtrip(spark, sf_dir):
    """The same through nested artifact rows."""
    return compress.decompress(compress.explode(compress.artifacts(_compressed(spark, sf_dir)))).select("page_id", "idx", "revid", "text")


@query(f"WITH {_REV} SELECT page_id, idx, text FROM rev")
def star_roundtrip(spark, sf_dir):
    """Deltas against the last checkpoint, every third revision."""
    x = staged(tables.conversations(spark, sf_dir), "revisions")
    parts = layout.anchor_of(layout.fixed_interval(x.drop("text"), 3))
    y = delta.with_delta(x, delta.checkpoints(parts))
    return y.select("page_id", "idx", F.when(F.col("patch").isNull(), F.col("text")).otherwise(delta.restored(F.col("patch"))).alias("text"))


@query(f"""{_ALL} SELECT 'page_' || page_id || '.comp.gz' AS artifact, 'page_' || page_id AS title, page_id, c.n_revisions::INT AS n_revisions, n_anchors::INT AS n_anchors, k.n::INT AS n_partitions,
  round(k.a, 6) AS avg_chain_len, k.m::INT AS max_chain_len, space_cost, time_cost, orig_size, round(CASE WHEN orig_size > 0 THEN space_cost / orig_size END, 6) AS compression_ratio,
  round(n_anchors / n_revisions, 6) AS anchor_density, 'heuristic' AS solver, 'auto' AS strategy, n_revisions * n_revisions AS time_budget
FROM cost c JOIN (SELECT page_id, count(*) AS n, avg(chain_len) AS a, max(chain_len) AS m FROM chain GROUP BY 1) k USING (page_id)""")
def artifact_metrics(spark, sf_dir):
    rows = staged(tables.conversations(spark, sf_dir), "revisions")
    parts = staged(layout.partition_all(rows.drop("text")), "parts")
    x = analytics.summarize_artifacts(compress.artifacts(compress.as_deltas(rows, parts)))
    return x.withColumns({c: F.round(c, 6) for c in ("avg_chain_len", "compression_ratio", "anchor_density")})


@query(f"WITH {_REV} SELECT page_id, idx, text FROM rev WHERE idx BETWEEN 1 AND 3")
def retrieve_range(spark, sf_dir):
    return retrieve.by_range(_compressed(spark, sf_dir, retrieve.in_range(1, 2)), 1, 2)


@query(f"WITH {_REV} SELECT page_id, idx, text FROM rev WHERE idx >= 1 AND idx < 3")
def reconstruct_range(spark, sf_dir):
    return retrieve.half_open(_compressed(spark, sf_dir, retrieve.in_range(1, 1)), 1, 2)


@query(f"WITH {_REV} SELECT pos::INT AS pos, page_id, idx, text FROM rev JOIN (VALUES (0, 2), (1, 0), (2, 2), (3, 1)) r(pos, want) ON idx = want")
def retrieve_indices(spark, sf_dir):
    return retrieve.by_indices(_compressed(spark, sf_dir, F.col("idx").isin(0, 1, 2)), [2, 0, 2, 1])


_ASK = [3001, 1000, 999999999, 3001, 5002, 12000]


@query(f"WITH {_REV} SELECT pos::INT AS pos, revid, page_id, idx, text FROM rev JOIN (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(_ASK))}) a(pos, want) ON revid = want")
def retrieve_revid(spark, sf_dir):
    return retrieve.by_revid(_compressed(spark, sf_dir, F.col("revid").isin(_ASK)), retrieve.request(spark, _ASK))


@query(f"WITH {_REV} SELECT pos::INT AS pos, want::BIGINT AS revid FROM (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(_ASK))}) a(pos, want) WHERE want NOT IN (SELECT revid FROM rev)")
def missing_ids(spark, sf_dir):
    return retrieve.missing_revids(tables.conversations(spark, sf_dir), retrieve.request(spark, _ASK)).select("pos", "revid")


@query(f"WITH {_EV} SELECT page_id, idx, epoch_us(ts) AS ts_us, text FROM ev WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 23:59:59'")
def retrieve_time(spark, sf_dir):
    when = retrieve.time_bounds("2024-01-05", "2024-01-09")
    x = retrieve.by_time(compress.compress(staged(tables.events(spark, sf_dir), "revisions"), only=when), "2024-01-05", "2024-01-09")
    return x.select("page_id", "idx", F.unix_micros("ts").alias("ts_us"), "text")


@query(f"WITH {_EV} SELECT page_id, idx, text FROM ev WHERE ts > TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-06 06:00:00'")
def retrieve_time_exclusive(spark, sf_dir):
    span = "2024-01-05T06:00Z", "2024-01-06T08:00:00+02:00", False
    x = retrieve.by_time(compress.compress(staged(tables.events(spark, sf_dir), "revisions"), only=retrieve.time_bounds(*span)), *span)
    return x.select("page_id", "idx", "text")


@query(f"WITH {_REV} SELECT page_id, 4 AS instance, 4 AS full_instance, text FROM rev WHERE idx = 3")
def retrieve_period(spark, sf_dir):
    """By number in a layout with a full copy every third revision."""
    x = staged(tables.conversations(spark, sf_dir), "revisions")
    rows = compress.as_deltas(x, layout.fixed_interval(x.drop("text"), 3), F.col("idx") == 3)
    return retrieve.by_period(rows, 4, 3)


@query(f"WITH {_REV} SELECT page_id, idx, revid, text FROM rev")
def xml_roundtrip(spark, sf_dir):
    """Written as several compressed export files and read again."""
    path = f"{folder(spark)}/export-{uuid.uuid4().hex}"
    dumps.write_xml(tables.conversations(spark, sf_dir).repartition(3, "page_id"), path)
    return dumps.revisions(dumps.xml_pages(spark, f"{path}/*.bz2")).select("page_id", "idx", "revid", "text")


@query(f"WITH {_REV} SELECT page_id, idx, revid, text FROM rev")
def artifact_files_roundtrip(spark, sf_dir):
    """One file per page, written and read again."""
    path = f"{folder(spark)}/artifacts-{uuid.uuid4().hex}".removeprefix("file://")
    written = staged(store.save(compress.artifacts(_compressed(spark, sf_dir)), path), "written")
    if not written.where("error is not null").isEmpty():
        raise OSError(written.where("error is not null").first().error)
    return compress.decompress(compress.explode(store.load(spark, path))).select("page_id", "idx", "revid", "text")


@query(f"WITH {_REV} SELECT page_id, idx + 1 AS id, revid, text, size FROM rev")
def knolml_roundtrip(spark, sf_dir):
    """Instances of one page each, written and read again."""
    path = f"{folder(spark)}/knolml-{uuid.uuid4().hex}"
    dumps.write_knolml(tables.conversations(spark, sf_dir), path)
    x = dumps.knolml_accessors(dumps.knolml(spark, path))
    return x.select(F.expr("revid div 1000").alias("page_id"), "id", "revid", "text", F.col("bytes").alias("size"))


@query(f"WITH {_REV} SELECT page_id, 3 AS instance, 3 AS full_instance, text FROM rev WHERE idx = 2")
def retrieve_instance(spark, sf_dir):
    return retrieve.by_instance(_compressed(spark, sf_dir, F.col("idx") == 2), 3, 1)


_RANGES = [("dump-p0p199.bz2", 0, 199), ("dump-p150p999.bz2", 150, 999), ("dump-p1500p4000.bz2", 1500, 4000), ("dump-p10p20.bz2", 10, 20)]
_RSQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _RANGES) + ") v(path, lo, hi)), ids AS (SELECT page_id FROM pages)"


def _ranges(spark) -> DataFrame:
    return spark.createDataFrame(_RANGES, "path string, lo long, hi long")


@query(f"WITH {_RSQL} SELECT page_id, path, lo::BIGINT AS lo, hi::BIGINT AS hi FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lo, hi, path) AS n FROM ids JOIN r ON page_id BETWEEN lo AND hi) WHERE n = 1")
def id_file_first(spark, sf_dir):
    return joins.first_covering(tables.read(spark, sf_dir, "pages").select("page_id"), _ranges(spark), ["lo", "hi", "path"])


@query(f"WITH {_RSQL} SELECT page_id, coalesce(string_agg(path, '|' ORDER BY path), '') AS names FROM ids LEFT JOIN r ON page_id BETWEEN lo AND hi GROUP BY 1")
def id_file_all(spark, sf_dir):
    x = joins.all_covering(tables.read(spark, sf_dir, "pages").select("page_id"), _ranges(spark), "path")
    return x.select("page_id", F.array_join("names", "|").alias("names"))


@query(f"WITH {_RSQL}, f AS (SELECT page_id, min(path) AS path FROM ids JOIN r ON page_id BETWEEN lo AND hi GROUP BY 1) SELECT path, count(*)::BIGINT AS n, sum(page_id)::BIGINT AS total FROM f GROUP BY 1")
def ids_by_file(spark, sf_dir):
    x = joins.by_file(tables.read(spark, sf_dir, "pages").select("page_id"), _ranges(spark), "path")
    return x.select("path", F.size("page_ids").cast("long").alias("n"), F.aggregate("page_ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("SELECT p.page_id FROM pages p WHERE p.page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti(spark, sf_dir):
    done = tables.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return joins.left_to_do(tables.read(spark, sf_dir, "pages").select("page_id"), done)


@query("SELECT p.page_id, true AS skipped FROM pages p WHERE p.page_id IN (SELECT doc_id FROM labels)")
def resume_skipped(spark, sf_dir):
    done = tables.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return joins.skipped(tables.read(spark, sf_dir, "pages").select("page_id"), done)


@query("SELECT page_id, coalesce(c_name, 'page_' || page_id) AS title FROM pages LEFT JOIN customer ON page_id = c_custkey")
def page_titles(spark, sf_dir):
    titles = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"))
    return joins.with_titles(tables.read(spark, sf_dir, "pages").select("page_id"), titles)


@query("SELECT r_regionkey::VARCHAR AS key, c_name FROM region JOIN customer ON contains(c_name, r_regionkey::VARCHAR)")
def named_in_lines(spark, sf_dir):
    names = tables.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"))
    return joins.named_in(names, tables.read(spark, sf_dir, "customer"), "key", "c_name").select("key", "c_name")


@query(f"WITH {_REV} SELECT page_id, idx, size FROM rev WHERE idx < 2")
def per_page_limit(spark, sf_dir):
    return tables.conversations(spark, sf_dir).where("idx < 2").select("page_id", "idx", "size")


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 25")
def global_limit(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", "url").orderBy("page_id").limit(25)


@query(f"WITH {_REV} SELECT page_id, arg_min(idx, (-size, idx)) AS idx, max(size) AS size FROM rev GROUP BY 1")
def first_match(spark, sf_dir):
    x = tables.conversations(spark, sf_dir).groupBy("page_id").agg(F.min(F.struct((-F.col("size")).alias("a"), "idx")).alias("m"), F.max("size").alias("size"))
    return x.select("page_id", "m.idx", "size")


@query(f"WITH {_REV} SELECT page_id, count(*)::BIGINT AS n, sum(size)::BIGINT AS orig_size FROM rev GROUP BY 1")
def revision_counts(spark, sf_dir):
    return tables.conversations(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("orig_size"))


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(translate(lower(text), '.,:;''\"', ''), ' ')) AS word FROM conversations) GROUP BY 1")
def word_counts(spark, sf_dir):
    return text_fns.word_counts(tables.read(spark, sf_dir, "conversations"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\S+@\S+')) AS email FROM documents")
def emails(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.explode(text_fns.emails(F.col("text"))).alias("email"))


@query("SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, 'https?://[!$-_a-z]+')) AS link FROM pages")
def urls(spark, sf_dir):
    both = F.concat_ws(" ", "url", "html")
    return tables.read(spark, sf_dir, "pages").select("page_id", F.explode(text_fns.urls(both)).alias("link"))


@query("SELECT page_id, unnest(string_split(html, '><')) AS tag FROM pages")
def tag_split(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", F.explode(text_fns.tags(F.col("html"))).alias("tag"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def html_titles(spark, sf_dir):
    got = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return tables.read(spark, sf_dir, "pages").select("page_id", F.when(got != "", got).alias("title"))


@query("SELECT NULL::VARCHAR AS error, p.page_id, NULL::BOOLEAN AS skipped, p.url AS title FROM pages p UNION ALL SELECT NULL, doc_id, true, NULL FROM labels")
def manifest_union(spark, sf_dir):
    a = tables.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"))
    b = tables.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("skipped"))
    return joins.append_rows(a, b, spark.createDataFrame([], "error string"))


_ORD = """o AS (SELECT o_custkey AS page_id, o_orderkey AS revid, floor(o_totalprice / 100)::BIGINT AS size, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS idx FROM orders)"""


@query(f"WITH {_ORD.replace('o AS', 'rev AS', 1)}, {_STEP}, {_PART}, {_COST} SELECT * FROM cost")
def order_history_costs(spark, sf_dir):
    """A numeric-only history: a customer's orders."""
    return layout.costs(layout.partition_all(staged(tables.orders(spark, sf_dir), "revisions")))


def _solved(spark, sf_dir, solver: str, strategy: str) -> DataFrame:
    x = staged(tables.orders(spark, sf_dir), "revisions")
    chosen = layout.choose(x, 4000, strategy, solver)
    items = layout.candidates(x).join(chosen.hint("merge"), ["page_id", "idx"])
    return items.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum("weight").alias("weight"))


@query()
def knapsack_exact(spark, sf_dir):
    return _solved(spark, sf_dir, "exact", "auto")


@query()
def knapsack_greedy(spark, sf_dir):
    return _solved(spark, sf_dir, "heuristic", "greedy")


@query()
def knapsack_fptas(spark, sf_dir):
    return _solved(spark, sf_dir, "heuristic", "fptas")


@query()
def knapsack_sparse(spark, sf_dir):
    return _solved(spark, sf_dir, "heuristic", "sparse")


@query()
def knapsack_auto(spark, sf_dir):
    return _solved(spark, sf_dir, "heuristic", "auto")


@query(f"WITH {_REV} SELECT page_id, idx, text FROM rev")
def char_patch_roundtrip(spark, sf_dir):
    """Character deltas applied to their predecessors give the texts again."""
    rows = staged(tables.conversations(spark, sf_dir), "revisions")
    x = delta.with_delta(rows, method="chars")
    # of the rows, not of x: that would make all deltas twice
    before = rows.select("page_id", (F.col("idx") + 1).alias("idx"), F.col("text").alias("before"))
    apply = F.udf(lambda b, d: None if d is None else delta.apply_chars(b, d), "string", useArrow=True)
    y = x.join(before.hint("merge"), ["page_id", "idx"], "left").withColumn("again", apply("before", "patch"))
    return y.select("page_id", "idx", F.when(F.col("idx") == 0, F.col("text")).otherwise(F.col("again")).alias("text"))


@query()
def word_patch_sizes(spark, sf_dir):
    x = delta.with_delta(staged(tables.conversations(spark, sf_dir), "revisions"), method="words")
    return x.where("patch is not null").select("page_id", "idx", F.octet_length("patch").alias("bytes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_summary(spark, sf_dir)
