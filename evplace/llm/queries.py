"""Queries of the training-data operators and their SQL, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .language import train_profiles
from .leakage import find_leaks
from .neardup import duplicate_groups, near_duplicates, similar_pairs
from .packing import pack_texts
from .pairs import find_defects
from .quota import sample_to_targets
from .subset import varied_subset
from .truncation import find_truncated, source_rates

#: Levels of the diversity fields in their natural order (fixed values of the domain).
DIVERSITY = {
    "scenario_category": ["casual", "professional", "transactional"],
    "topic_drift": ["tight", "moderate", "wide"],
    "evidence_placement": ["early", "middle", "late"],
    "evidence_density": ["single_message", "multi_message"],
}
SUBSET_SIZE = 300


def _judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return find_defects(table(spark, d, "screening_results"), profiles=train_profiles(table(spark, d, "documents")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged_pairs(spark, d).where("defect is not null").select(F.col("record_id").alias("result_id"), "defect")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and defective pairs per kind of defect."""
    return _judged_pairs(spark, d).groupBy(F.coalesce("defect", F.lit("sound")).alias("kind")).agg(F.count("*").alias("n_pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates(table(spark, d, "evidence_items"), "evidence_id", ["title", "fact"], threshold=0.7)
    return similar_pairs(members, links).select(F.col("record_id_a").alias("evidence_id_a"), F.col("record_id_b").alias("evidence_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates(table(spark, d, "evidence_items"), "evidence_id", ["title", "fact"], threshold=0.7)
    return duplicate_groups(members, links).withColumnRenamed("record_id", "evidence_id")


def p3_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied_subset(table(spark, d, "session_manifest"), "custom_id", DIVERSITY, SUBSET_SIZE, error="session_parse_error", spread="human_message")


def p3_variety(spark: SparkSession, d: str) -> DataFrame:
    """How varied the subset is: records, cells of all and of the subset, records above an even share of the cells, and errors taken though the cell had sound records."""
    sub = p3_subset(spark, d)
    cell = sub.groupBy("hilbert_key", "cell_size").agg(F.count("*").alias("n"))
    return cell.agg(F.sum("n").alias("n_records"), F.count("*").alias("n_cells"), F.max("n").alias("most_of_a_cell"), F.min(F.least("n", "cell_size")).alias("least_of_a_cell"))


def _quota(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sample_to_targets(table(spark, d, "session_manifest"), table(spark, d, "pool_inventory"), table(spark, d, "target_shares"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[1].where("kind <> 'share' and exhausted").select("pool_id", "stratum")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[0]


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[1]


def p4_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Per pool and domain: sessions drawn, different ones, and drawn ones that were not usable."""
    sessions = table(spark, d, "session_manifest").where("session_parse_error is null").select("pool_id", "custom_id", F.lit(1).alias("ok")).distinct()
    drawn = p4_sample(spark, d).join(sessions, ["pool_id", "custom_id"], "left")
    return drawn.groupBy("pool_id", "domain").agg(F.count("*").alias("n_drawn"), F.count_distinct("custom_id").alias("n_different"), F.count_if(F.col("ok").isNull()).alias("n_not_usable"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packer placed in several pieces."""
    return _packed(spark, d).where("piece = 1").select("limit_name", "doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: what was placed, that nothing overflows or is torn, and that few containers were used.

    The lower bound is the total size over the capacity; ``near_bound`` allows 2 % and one container above it.
    """
    rows = _packed(spark, d)
    each = rows.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("fill"), F.max("container_tokens").alias("said"), F.count("*").alias("n"), F.count_if(F.col("piece") == 0).alias("docs"), F.sum(F.when(F.col("piece") == 0, F.col("n_pieces")).otherwise(0)).alias("pieces"))
    g = each.groupBy("limit_name", "capacity_tokens").agg(F.sum("docs").alias("n_docs"), F.sum("fill").alias("n_tokens"), F.sum("n").alias("n_rows"), F.sum("pieces").alias("n_pieces"), F.count_if((F.col("fill") > F.col("capacity_tokens")) | (F.col("fill") != F.col("said"))).alias("n_wrong"), F.count("*").alias("n_containers"))
    return g.select("limit_name", "n_docs", "n_tokens", "n_rows", "n_pieces", "n_wrong", (F.col("n_containers") <= F.ceil(F.col("n_tokens") / F.col("capacity_tokens")) * 1.02 + 1).alias("near_bound"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages")).where("longest_run >= 12").select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents that hold a long run of it, and the longest."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages")).where("longest_run >= 12")
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.max("item_words").alias("item_words"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with a long run or with tiles over most of the item, reordered passages among them."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))
    return leaks.select("doc_id", "item_id", "longest_run", "n_tiles", F.round("coverage", 6).alias("coverage"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(table(spark, d, "documents")).where("is_cut").select("doc_id")


def p9_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(find_truncated(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_groups, p3_subset, p3_variety, p4_found, p4_sample, p4_report, p4_drawn, p7_found, p7_containers, p7_fill, p8_found, p8_report, p8_coverage, p9_found, p9_source_rates)}

_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"

_CODES = [f"c{i}" for i in range(len(DIVERSITY))]
_LEVEL = {f: f"lower(regexp_replace(coalesce({f}, ''), '^\\s+|\\s+$', '', 'g'))" for f in DIVERSITY}
_FIRST_COPY = ", ".join(f"CASE WHEN {_LEVEL[f]} = '' THEN 0 ELSE coalesce(list_position({levels}, {_LEVEL[f]}), {len(levels) + 1}) END AS c{i}, {_LEVEL[f]} AS v{i}" for i, (f, levels) in enumerate(DIVERSITY.items())) + ", (session_parse_error IS NOT NULL)::INT AS bad"
_ORDER = ", ".join([*[f"v{i}" for i in range(len(DIVERSITY))], *_CODES])

SQL = {
    "p2_found": r"""
        WITH w AS (
          SELECT DISTINCT evidence_id, list_sort(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(fact, '')), '[\p{L}\p{N}]+')) AS ws
          FROM evidence_items WHERE evidence_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (ORDER BY evidence_id, ws) AS rid, len(ws) AS n FROM w WHERE len(ws) > 0),
        t AS (SELECT rid, word, count(*) AS c FROM (SELECT rid, unnest(ws) AS word FROM r) GROUP BY ALL),
        i AS (SELECT a.rid AS x, b.rid AS y, sum(least(a.c, b.c)) AS shared FROM t a JOIN t b ON a.word = b.word AND a.rid < b.rid GROUP BY ALL)
        SELECT DISTINCT least(p.evidence_id, q.evidence_id) AS evidence_id_a, greatest(p.evidence_id, q.evidence_id) AS evidence_id_b
        FROM i JOIN r p ON p.rid = x JOIN r q ON q.rid = y
        WHERE p.evidence_id <> q.evidence_id AND shared >= 0.7 * (p.n + q.n - shared) - 1e-9
    """,
    "p3_variety": rf"""
        WITH x AS (SELECT custom_id, {_FIRST_COPY} FROM session_manifest WHERE custom_id IS NOT NULL),
        y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY bad, {_ORDER}) = 1),
        c AS (SELECT count(*) AS s FROM y GROUP BY {', '.join(_CODES)}),
        t AS (SELECT max(t) AS t FROM (SELECT unnest(range(0, {SUBSET_SIZE} + 1)) AS t) WHERE (SELECT sum(least(s, t)) FROM c) <= {SUBSET_SIZE}),
        r AS (SELECT {SUBSET_SIZE} - sum(least(s, t)) AS rest, min(least(s, t)) AS low, any_value(t) AS t, count(*) FILTER (s > t) AS open FROM c, t)
        SELECT (SELECT least(count(*), {SUBSET_SIZE}) FROM y) AS n_records, CASE WHEN t > 0 THEN (SELECT count(*) FROM c) ELSE {SUBSET_SIZE} END AS n_cells,
          t + (rest > 0 AND open > 0)::INT AS most_of_a_cell, CASE WHEN t > 0 THEN low ELSE 1 END AS least_of_a_cell FROM r
    """,
    "p4_found": r"""
        WITH u AS (
          SELECT pool_id, custom_id, max(is_off_topic) AS off,
                 min(nullif(lower(regexp_replace(scenario_category, '^\s+|\s+$', '', 'g')), '')) AS cat
          FROM session_manifest WHERE session_parse_error IS NULL AND custom_id IS NOT NULL GROUP BY ALL),
        c AS (SELECT pool_id, count(*) FILTER (NOT off) AS n_in, count(*) FILTER (off) AS n_off FROM u GROUP BY 1),
        k AS (SELECT pool_id, cat, count(*) AS n FROM u GROUP BY ALL)
        SELECT p.pool_id, 'in_domain' AS stratum FROM pool_inventory p LEFT JOIN c USING (pool_id) WHERE p.target_in_domain > coalesce(n_in, 0)
        UNION ALL
        SELECT p.pool_id, 'off_topic' FROM pool_inventory p LEFT JOIN c USING (pool_id) WHERE p.target_off_topic > coalesce(n_off, 0)
        UNION ALL
        SELECT p.pool_id, s.scenario_category FROM pool_inventory p JOIN target_shares s USING (persona_id)
          LEFT JOIN k ON k.pool_id = p.pool_id AND k.cat = s.scenario_category WHERE s.min_count > coalesce(k.n, 0)
    """,
    "p2_groups": r"""
        WITH RECURSIVE w AS (
          SELECT DISTINCT evidence_id, list_sort(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(fact, '')), '[\p{L}\p{N}]+')) AS ws FROM evidence_items WHERE evidence_id IS NOT NULL),
        m AS (SELECT evidence_id, upper(md5(array_to_string(ws, ' '))) AS class_id, ws FROM w WHERE len(ws) > 0),
        c AS (SELECT class_id, any_value(ws) AS ws, any_value(len(ws)) AS n, count(*) AS size, min(evidence_id) AS first_id FROM m GROUP BY 1),
        t AS (SELECT class_id, word, count(*) AS k FROM (SELECT class_id, unnest(ws) AS word FROM c) GROUP BY ALL),
        i AS (SELECT a.class_id AS x, b.class_id AS y, sum(least(a.k, b.k)) AS shared FROM t a JOIN t b ON a.word = b.word AND a.class_id <> b.class_id GROUP BY ALL),
        l AS (SELECT x, y, q.size FROM i JOIN c p ON p.class_id = x JOIN c q ON q.class_id = y WHERE shared >= 0.7 * (p.n + q.n - shared) - 1e-9),
        reach AS (SELECT class_id AS x, class_id AS y FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
        g AS (SELECT reach.x AS class_id, min(c.first_id) AS group_id, sum(c.size)::BIGINT AS group_size FROM reach JOIN c ON c.class_id = reach.y GROUP BY 1),
        k AS (SELECT x AS class_id, sum(size)::BIGINT AS linked FROM l GROUP BY 1)
        SELECT evidence_id, class_id, group_id, group_size, c.size - 1 + coalesce(linked, 0) AS n_links FROM m JOIN c USING (class_id) JOIN g USING (class_id) LEFT JOIN k USING (class_id)
    """,
    "p4_drawn": r"""
        WITH u AS (SELECT pool_id, custom_id, max(is_off_topic) AS off FROM session_manifest WHERE session_parse_error IS NULL AND custom_id IS NOT NULL GROUP BY ALL),
        x AS (SELECT p.pool_id, 'in_domain' AS domain, least(coalesce(p.target_in_domain, 0), count(u.custom_id)) AS n FROM pool_inventory p LEFT JOIN u ON u.pool_id = p.pool_id AND NOT off GROUP BY p.pool_id, p.target_in_domain
          UNION ALL SELECT p.pool_id, 'off_topic', least(coalesce(p.target_off_topic, 0), count(u.custom_id)) FROM pool_inventory p LEFT JOIN u ON u.pool_id = p.pool_id AND off GROUP BY p.pool_id, p.target_off_topic)
        SELECT pool_id, domain, n AS n_drawn, n AS n_different, 0::BIGINT AS n_not_usable FROM x WHERE n > 0
    """,
    "p7_found": rf"""
        SELECT limit_name, doc_id FROM (SELECT doc_id, len(regexp_extract_all(text, '{_TOKENS}')) AS n FROM documents) d
        JOIN pack_limits ON n > capacity_tokens
    """,
    "p7_fill": rf"""
        WITH d AS (SELECT len(regexp_extract_all(coalesce(text, ''), '{_TOKENS}')) AS n FROM documents),
        x AS (SELECT limit_name, n, greatest(1, (n + capacity_tokens - 1) // capacity_tokens) AS pieces FROM d, (SELECT DISTINCT limit_name, capacity_tokens FROM pack_limits WHERE capacity_tokens > 0) l)
        SELECT limit_name, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, sum(pieces)::BIGINT AS n_rows, sum(pieces)::BIGINT AS n_pieces, 0::BIGINT AS n_wrong, true AS near_bound FROM x GROUP BY 1
    """,
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
        eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
    """,
    "p8_report": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
        eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12)),
        x AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
        SELECT item_id, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, any_value(len(w)) AS item_words FROM x JOIN e USING (item_id) GROUP BY 1
    """,
}
