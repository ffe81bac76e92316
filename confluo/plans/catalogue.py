"""Registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.functions import similarity as S
from confluo.functions import text as T
from confluo.operators import entities, evaluate, gold, linking, lookup, quality
from confluo.operators.graph import components
from confluo.operators.standardise import numbered, union_sources
from confluo.plans import resolution
from confluo.session import table
from confluo.sources import fixtures, population
from confluo.sources.systems import truth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sources(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("CRM").alias("source_system"), F.format_string("CRM%06d", "c_custkey").alias("source_record_id"), F.col("c_custkey").cast("string").alias("portal_user_id"))
    o = table(spark, d, "orders").select(F.lit("ECOMMERCE").alias("source_system"), F.format_string("TXN%06d", "o_orderkey").alias("source_record_id"), F.col("o_custkey").cast("string").alias("portal_user_id"), F.format_string("%.2f", "o_totalprice").alias("transaction_total"))
    e = table(spark, d, "events").select(F.lit("ONLINE").alias("source_system"), F.format_string("SES%06d", "event_id").alias("source_record_id"), F.col("user_id").cast("string").alias("portal_user_id"), F.col("event_type").alias("event_type"))
    return union_sources([c, o, e])


_UNION = """(SELECT 'CRM' AS source_system, printf('CRM%06d', c_custkey) AS source_record_id, CAST(c_custkey AS VARCHAR) AS portal_user_id, '' AS transaction_total, '' AS event_type FROM customer
UNION ALL SELECT 'ECOMMERCE', printf('TXN%06d', o_orderkey), CAST(o_custkey AS VARCHAR), printf('%.2f', o_totalprice), '' FROM orders
UNION ALL SELECT 'ONLINE', printf('SES%06d', event_id), CAST(user_id AS VARCHAR), '', event_type FROM events)"""


@query(f"SELECT * FROM {_UNION}")
def union_of_sources(spark, d):
    """Ordered union schema, absent columns blank."""
    return _sources(spark, d)


@query(f"SELECT printf('STG%06d', row_number() OVER (ORDER BY CASE source_system WHEN 'CRM' THEN 1 WHEN 'ECOMMERCE' THEN 2 ELSE 3 END, source_record_id)) AS staging_record_id, source_system, source_record_id FROM {_UNION}")
def staging_ids(spark, d):
    """Consecutive ids without a single-partition window over the rows."""
    rank = gold.case_of("source_system", {"CRM": 1, "ECOMMERCE": 2, "ONLINE": 3})
    return numbered(_sources(spark, d).withColumn("_r", rank), ["_r", "source_record_id"], "staging_record_id", "STG").select("staging_record_id", "source_system", "source_record_id")


@query(f"""WITH u AS (SELECT * FROM {_UNION}), e AS (SELECT portal_user_id, min(source_record_id) AS first_record, count(*) AS record_count, count(DISTINCT source_system) AS source_count,
count(*) FILTER (WHERE source_system = 'ECOMMERCE') AS orders, count(*) FILTER (WHERE source_system = 'ONLINE') AS sessions,
round(coalesce(sum(TRY_CAST(transaction_total AS DOUBLE)), 0), 2) AS spent FROM u GROUP BY 1)
SELECT printf('UCR%06d', row_number() OVER (ORDER BY first_record)) AS ucr_id, * EXCLUDE (portal_user_id) FROM e""")
def entity_activity(spark, d):
    """The smallest whole run: union, exact-key entities, stable numbers, activity."""
    u = _sources(spark, d)
    e = u.groupBy("portal_user_id").agg(
        F.min("source_record_id").alias("first_record"), F.count("*").alias("record_count"), F.count_distinct("source_system").alias("source_count"),
        F.count(F.when(F.col("source_system") == "ECOMMERCE", 1)).alias("orders"), F.count(F.when(F.col("source_system") == "ONLINE", 1)).alias("sessions"),
        F.round(F.coalesce(F.sum(T.parse_float(F.col("transaction_total"))), F.lit(0.0)), 2).alias("spent"))
    return numbered(e, ["first_record"], "ucr_id", "UCR").drop("portal_user_id")


@query("""SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]', '', 'g') AS name,
trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS address FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def normalised_text(spark, d):
    """F0, F1, F4 over whole texts in four languages."""
    return table(spark, d, "documents").select("doc_id", T.normalise_name(F.col("text")).alias("name"), T.normalise_address(F.col("text")).alias("address"))


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN printf('+44 7%09d', c_custkey) WHEN 1 THEN printf('0044 7%09d', c_custkey) WHEN 2 THEN printf('07%09d', c_custkey) ELSE printf('7%09d', c_custkey) END AS raw FROM customer)
SELECT c_custkey, printf('07%09d', c_custkey) AS phone, upper(replace(printf('so%d 4ab', c_custkey), ' ', '')) AS postcode FROM p""")
def normalised_phones(spark, d):
    """four spellings of a number are one."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.format_string("+44 7%09d", k)).when(k % 4 == 1, F.format_string("0044 7%09d", k)).when(k % 4 == 2, F.format_string("07%09d", k)).otherwise(F.format_string("7%09d", k))
    return table(spark, d, "customer").select("c_custkey", T.normalise_phone(raw).alias("phone"), T.normalise_postcode(F.format_string("so%d 4ab", k)).alias("postcode"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, date_diff('year', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders")
def normalised_dates(spark, d):
    """four formats, and a date that does not exist."""
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(o, "yyyy-MM-dd")).when(k == 1, F.date_format(o, "d/M/yyyy")).when(k == 2, F.date_format(o, "dd-MM-yyyy")).when(k == 3, F.date_format(o, "yyyy/M/d")).otherwise("31/02/1990")
    return table(spark, d, "orders").select("o_orderkey", T.normalise_date(raw).alias("day"), T.age_on(F.lit("1970-01-01").cast("date"), o.cast("date")).cast("long").alias("age"))


_ODD = ["' N/A '", "'null'", "'Unknown'", "' x '", "''", "'1'", "'T'", "'yes'", "'01:30'", "'abc'"]


@query(f"""WITH r AS (SELECT c_custkey, ([{', '.join(_ODD)}])[1 + c_custkey % 10] AS raw FROM customer), s AS (SELECT *, trim(raw) AS t FROM r)
SELECT c_custkey, CASE WHEN lower(t) IN ('', 'n/a', 'na', 'nan', 'none', 'not available', 'null', 'unknown') THEN '' ELSE t END AS matching, t AS gold,
CASE WHEN lower(t) IN ('', 'nan', 'none', 'null') THEN '' ELSE t END AS evaluation, lower(t) IN ('1', 'true', 't', 'yes', 'y') AS flag_gold, lower(t) IN ('1', 'true', 'yes', 'y') AS flag_evaluation,
CASE WHEN t = '01:30' THEN 1.5 END::DOUBLE AS hours, TRY_CAST(t AS DOUBLE) AS number FROM s""")
def cleaned_values(spark, d):
    """three vocabularies of blank, two of true."""
    raw = F.element_at(F.expr(f"array({', '.join(_ODD)})"), (F.col("c_custkey") % 10 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.clean_for_matching(raw).alias("matching"), T.clean_for_gold(raw).alias("gold"), T.clean_for_evaluation(raw).alias("evaluation"), T.parse_boolean(raw).alias("flag_gold"), T.parse_boolean(raw, T.TRUE_EVALUATION).alias("flag_evaluation"), T.parse_hours(raw).alias("hours"), T.parse_float(raw).alias("number"))


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def key_joins(spark, d):
    """Foreign keys to primary keys; Catalyst broadcasts what it measures small."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""WITH g AS (SELECT text, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT d.doc_id, g.first AS cluster, g.n AS cluster_size FROM documents d JOIN g ON d.text = g.text""")
def exact_key_clusters(spark, d):
    """Records that share an exact key are one cluster."""
    k = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    least = k.groupBy("key").agg(F.min("doc_id").alias("first"))
    edges = k.join(least, "key").where("doc_id <> first").select(F.col("first").alias("left"), F.col("doc_id").alias("right"))
    comp = components(edges, "left", "right")
    c = k.select("doc_id").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("cluster"))
    return c.join(c.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster").select("doc_id", "cluster", "cluster_size")


def _parts(spark, d):
    p = table(spark, d, "part")
    return p, {"brand": F.concat_ws("|", F.col("p_brand"), F.left(F.col("p_name"), F.lit(3))), "type": F.concat_ws("|", F.col("p_type"), F.col("p_size").cast("string"))}


_BLOCKS = """e AS (SELECT DISTINCT p_partkey AS c, 'brand' AS rule, concat_ws('|', p_brand, left(p_name, 3)) AS key FROM part UNION ALL SELECT p_partkey, 'type', concat_ws('|', p_type, CAST(p_size AS VARCHAR)) FROM part),
k AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY rule, key) BETWEEN 2 AND 100),
pairs AS (SELECT a.c AS cluster_id_1, b.c AS cluster_id_2, array_to_string(list_sort(list(DISTINCT a.rule)), ' | ') AS blocking_rules, count(*) AS blocking_hits FROM k a JOIN k b ON a.rule = b.rule AND a.key = b.key AND a.c < b.c GROUP BY ALL)"""


@query(f"WITH {_BLOCKS} SELECT * FROM pairs")
def blocked_candidates(spark, d):
    """Blocking with the reference cap of 100 clusters per block."""
    p, keys = _parts(spark, d)
    return linking.blocked_pairs(p, keys, "p_partkey")


@query(f"""WITH {_BLOCKS}, f AS (SELECT pairs.*, a.p_brand = b.p_brand AS brand, a.p_type = b.p_type AS type, a.p_size = b.p_size AS size FROM pairs JOIN part a ON a.p_partkey = cluster_id_1 JOIN part b ON b.p_partkey = cluster_id_2),
s AS (SELECT *, round(0.3 * brand::INT + 0.25 * type::INT + 0.2 * size::INT, 4) / 0.75 AS raw, brand::INT + type::INT AS strong FROM f)
SELECT cluster_id_1, cluster_id_2, round(raw, 4) AS score, strong, CASE WHEN round(raw, 4) >= 0.91 AND ((strong >= 1 AND size) OR strong + size::INT >= 3) THEN 'automatic' WHEN round(raw, 4) >= 0.7 THEN 'review' ELSE 'rejected' END AS decision FROM s""")
def weighted_decisions(spark, d):
    """Weighted score over available features, then the decision."""
    p, keys = _parts(spark, d)
    pairs = linking.blocked_pairs(p, keys, "p_partkey")
    side = lambda n: p.select(F.col("p_partkey").alias(f"cluster_id_{n}"), *[F.col(f"p_{c}").alias(f"{c}{n}") for c in ("brand", "type", "size")])
    j = pairs.join(side(1), "cluster_id_1").join(side(2), "cluster_id_2")
    same = lambda c: (F.lit(True), F.when(F.col(f"{c}1") == F.col(f"{c}2"), 1.0).otherwise(0.0))
    w = S.weighted({"email": same("brand"), "phone": same("type"), "name": same("size")}, rounder=lambda c: F.round(c, 4))
    j = j.withColumns(w)
    decision = S.classify(F.lit(False), F.col("score"), F.lit(1.0), S.supported(F.col("strong"), F.col("corroborating"), F.col("supporting")))
    return j.select("cluster_id_1", "cluster_id_2", "score", "strong", decision.alias("decision"))


@query()
def string_similarities(spark, d):
    """M1, M5: indel and token-set ratios of part names within a block."""
    p, keys = _parts(spark, d)
    pairs = linking.blocked_pairs(p, {"brand": keys["brand"]}, "p_partkey")
    n = p.select("p_partkey", "p_name")
    j = pairs.join(n.toDF("cluster_id_1", "a"), "cluster_id_1").join(n.toDF("cluster_id_2", "b"), "cluster_id_2")
    return j.select("cluster_id_1", "cluster_id_2", F.round(S.ratio("a", "b"), 6).alias("ratio"), F.round(S.token_set_ratio("a", "b"), 6).alias("token_set"))


@query()
def constrained_clusters(spark, d):
    """L3, L4: ordered greedy merges under portal and birth-date conflicts."""
    c = table(spark, d, "customer")
    r = c.select(F.format_string("STG%06d", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).otherwise("").alias("portal"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("dob"), (F.round("c_acctbal") % 1000).alias("k"))
    keyed = r.select("id", F.col("k").cast("string").alias("key"), F.lit(5).alias("priority"), F.lit(False).alias("authoritative"))
    return linking.keyed_clusters(r.drop("k"), keyed)


def _crm(spark) -> DataFrame:
    from confluo.operators.standardise import consolidate, standardise
    from confluo.sources.systems import BY_SYSTEM, ingest

    raw = fixtures.crm(fixtures.customers(spark, 400)).drop("ground_truth_id").withColumn("record_created_date", F.lit("2025-01-01"))
    s = BY_SYSTEM["CRM"]
    return consolidate([standardise(ingest(raw, s), s)])


@query()
def identity_resolution(spark, d):
    """S3 to L15 on a generated population: exact rules, fuzzy stage, entity ids."""
    silver = _crm(spark)
    r = silver.select(F.col("staging_record_id").alias("id"), F.col("portal_user_id").alias("portal"), F.col("date_of_birth_normalised").alias("dob"))
    linked, _ = linking.constrained_clusters(r, linking.exact_edges(silver))
    clustered = silver.join(linked.withColumnRenamed("id", "staging_record_id"), "staging_record_id")
    merged, _ = linking.probabilistic(clustered, spark.createDataFrame([], "left string, right string"))
    final = clustered.join(merged, "cluster").select("staging_record_id", "source_system", F.col("merged").alias("cluster"))
    return entities.cluster_summary(entities.stable_ids(final))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority, o_orderkey % 3 AS completeness FROM orders),
c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS candidate_count, max(completeness) OVER (PARTITION BY o_custkey) AS top FROM o),
k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS frequency FROM c WHERE completeness = top),
d AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS distinct_count FROM o GROUP BY 1)
SELECT k.o_custkey AS ucr_id, o_orderpriority AS key, o_orderkey AS staging_record_id, candidate_count, distinct_count, frequency FROM k JOIN d USING (o_custkey) QUALIFY row_number() OVER (PARTITION BY k.o_custkey ORDER BY priority, frequency DESC, day DESC, o_orderkey) = 1""")
def survivorship(spark, d):
    """Most complete, then priority, frequency, date and record."""
    o = table(spark, d, "orders")
    c = o.select(F.col("o_custkey").alias("ucr_id"), F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("staging_record_id"), gold.case_of("o_orderstatus", {"F": 1, "O": 2}, 3).alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("rank_date"), (F.col("o_orderkey") % 3).alias("completeness"))
    return gold.survivors(c).select("ucr_id", "key", "staging_record_id", "candidate_count", "distinct_count", "frequency")


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent, round(avg(o_totalprice), 6) AS mean, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_order, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_order FROM orders GROUP BY 1),
e AS (SELECT user_id, count(*) AS sessions, count(*) FILTER (WHERE event_type = 'click') AS baskets, count(*) FILTER (WHERE event_type = 'purchase') AS conversions FROM events GROUP BY 1)
SELECT c_custkey AS ucr_id, coalesce(n, 0) AS transactions, coalesce(spent, 0) AS spent, coalesce(mean, 0) AS mean, coalesce(first_order, '') AS first_order, coalesce(last_order, '') AS last_order, coalesce(sessions, 0) AS sessions,
round(CASE WHEN coalesce(baskets, 0) = 0 THEN 0 ELSE conversions / baskets END, 6)::DOUBLE AS conversion_rate FROM customer LEFT JOIN s ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id""")
def interaction_summary(spark, d):
    """Per-entity activity with defaults."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shop = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ucr_id")).agg(F.count("*").alias("transactions"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.round(F.avg("o_totalprice"), 6).alias("mean"), T.safe_min(day).alias("first_order"), T.safe_max(day).alias("last_order"))
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    web = table(spark, d, "events").groupBy(F.col("user_id").alias("ucr_id")).agg(F.count("*").alias("sessions"), F.round(T.safe_divide(kind("purchase"), kind("click")), 6).alias("conversion_rate"))
    return gold.interactions(table(spark, d, "customer").select(F.col("c_custkey").alias("ucr_id")), [shop, web])


@query("""SELECT user_id AS ucr_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY 1""")
def crosstab(spark, d):
    """Fixed columns, absent cells 0."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "ucr_id")
    return e.groupBy("ucr_id").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)


@query("""WITH g AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)
SELECT l_returnflag, status, n, round(100.0 * n / (f + o), 4)::DOUBLE AS share FROM (SELECT l_returnflag, f, o, 'F' AS status, f AS n FROM g UNION ALL SELECT l_returnflag, f, o, 'O', o FROM g)""")
def shares_by_status(spark, d):
    """Two keys, row totals and percentages, then back to long form."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0).withColumn("total", F.col("F") + F.col("O"))
    return g.unpivot(["l_returnflag", "total"], ["F", "O"], "status", "n").select("l_returnflag", "status", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("""SELECT user_id AS ucr_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def latest_consent(spark, d):
    """K2, K3: the latest row of each entity."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "ucr_id")
    return gold.latest(e, "ucr_id", F.desc("ts"), F.col("event_id")).select("ucr_id", "event_id", "event_type")


@query("""WITH m AS (SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, mean, coalesce(mean >= lag(mean) OVER (ORDER BY c_mktsegment), true) AS rising FROM m""")
def segment_trend(spark, d):
    """Segment means and whether they rise.  The window sees one row a segment."""
    m = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count("*").alias("n"))
    return m.withColumn("rising", F.coalesce(F.col("mean") >= F.lag("mean").over(Window.orderBy("c_mktsegment")), F.lit(True)))


@query("""SELECT CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(min(p_retailprice), 2) AS low, round(max(p_retailprice), 2) AS high, round(avg(p_size), 4)::DOUBLE AS size FROM part GROUP BY 1""")
def price_bands(spark, d):
    """Bins and descriptive statistics."""
    band = F.when(F.col("p_retailprice") < 1000, "low").when(F.col("p_retailprice") < 1500, "middle").otherwise("high")
    return table(spark, d, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.min("p_retailprice"), 2).alias("low"), F.round(F.max("p_retailprice"), 2).alias("high"), F.round(F.avg("p_size"), 4).alias("size"))


_MAP = "(SELECT CASE WHEN doc_id % 10 = 0 THEN lang ELSE source END AS cluster, source AS truth FROM documents)"


def _mapping(spark, d):
    return table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.col("lang")).otherwise(F.col("source")).alias("cluster"), F.col("source").alias("truth"))


@query(f"""WITH t AS (SELECT cluster, truth, count(*) AS n FROM {_MAP} GROUP BY ALL), c AS (SELECT cluster, sum(n) AS c, max(n) AS top, count(*) AS kinds FROM t GROUP BY 1), g AS (SELECT truth, sum(n) AS g, count(*) AS parts FROM t GROUP BY 1),
x AS (SELECT sum(n * (n - 1) / 2) AS tp, sum(n) AS records, sum(n * n / c) AS bp, sum(n * n / g) AS br FROM t JOIN c USING (cluster) JOIN g USING (truth)),
y AS (SELECT sum(c * (c - 1) / 2) AS predicted, count(*) AS clusters, sum(top) AS pure, count(*) FILTER (WHERE kinds > 1) AS impure FROM c), z AS (SELECT sum(g * (g - 1) / 2) AS actual, count(*) AS identities, count(*) FILTER (WHERE parts > 1) AS split FROM g)
SELECT records::BIGINT AS records, clusters, identities, split AS split_identities, impure AS impure_clusters, round(tp / predicted, 6) AS "precision", round(tp / actual, 6) AS recall, round(bp / records, 6) AS b3_precision, round(br / records, 6) AS b3_recall, round(pure / records, 6) AS purity FROM x, y, z""")
def cluster_quality(spark, d):
    """Metrics from one contingency table."""
    m = evaluate.cluster_metrics(_mapping(spark, d))
    six = ("precision", "recall", "b3_precision", "b3_recall", "purity")
    return m.select("records", "clusters", "identities", "split_identities", "impure_clusters", *[F.round(c, 6).alias(c) for c in six])


@query(f"""WITH {_BLOCKS}, t AS (SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)
SELECT (SELECT count(*) FROM t) AS true_pairs, (SELECT count(*) FROM t JOIN pairs ON x = cluster_id_1 AND y = cluster_id_2) AS found, (SELECT count(*) FROM pairs) AS candidate_pairs""")
def blocking_quality(spark, d):
    """Which true pairs blocking keeps."""
    p, keys = _parts(spark, d)
    same = p.select(F.col("p_partkey").alias("cluster"), F.concat("p_brand", F.lit("|"), "p_type").alias("truth"))
    return evaluate.blocking_counts(linking.blocked_pairs(p, keys, "p_partkey"), same)


_SCORED = "(SELECT (p_partkey % 100) / 100.0 AS score, (p_size % 10) / 10.0 AS coverage, p_partkey % 7 <> 0 AS eligible, (p_partkey % 100) >= 85 AS is_true FROM part)"


def _scored(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 100 / 100.0).alias("score"), (F.col("p_size") % 10 / 10.0).alias("coverage"), (k % 7 != 0).alias("eligible"), (k % 100 >= 85).alias("is_true"))


_GRID = f"""g AS (SELECT t.v AS threshold, c.v AS least_coverage, count(*) FILTER (WHERE eligible AND score >= t.v AND coverage >= c.v) AS predicted, count(*) FILTER (WHERE eligible AND score >= t.v AND coverage >= c.v AND is_true) AS tp, count(*) FILTER (WHERE is_true) AS actual
FROM {_SCORED} s, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in evaluate.THRESHOLDS)}]) AS v) t, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in evaluate.COVERAGES)}]) AS v) c GROUP BY ALL)"""


@query(f"WITH {_GRID} SELECT threshold, least_coverage, predicted, tp, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END, 6)::DOUBLE AS \"precision\", round(tp / actual, 6)::DOUBLE AS recall FROM g")
def calibration(spark, d):
    """E5: the whole grid in one pass."""
    g = evaluate.calibration_grid(_scored(spark, d))
    return g.select("threshold", "least_coverage", "predicted", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_GRID}, m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p, tp / actual AS r FROM g), o AS (SELECT *, p >= 0.99 AND predicted >= 10 AS ok FROM m)
SELECT threshold, least_coverage, predicted, tp FROM o ORDER BY ok DESC, CASE WHEN ok THEN r ELSE p END DESC, p DESC, r DESC, predicted DESC, least_coverage DESC, threshold DESC LIMIT 1""")
def selected_setting(spark, d):
    """The reported winner."""
    return evaluate.select_setting(evaluate.calibration_grid(_scored(spark, d))).select("threshold", "least_coverage", "predicted", "tp")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 11 = 3")
def orphan_orders(spark, d):
    """Orders whose customer is missing."""
    c = table(spark, d, "customer").where("c_custkey % 11 <> 3")
    return quality.orphans(table(spark, d, "orders"), "o_custkey", c, "c_custkey").select("o_orderkey")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Keys that are not unique."""
    return quality.duplicates(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'left' END AS side FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, 'right' FROM customer WHERE c_custkey % 10 = 0")
def row_differences(spark, d):
    """What each side has that the other lacks."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    moved = c.withColumn("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")))
    return quality.differences(c, moved)


@query("SELECT 'customer' AS stage, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def stage_counts(spark, d):
    """V4: rows per stage."""
    return quality.row_counts({t: table(spark, d, t) for t in ("customer", "orders", "lineitem")})


@query("SELECT c_custkey AS ucr_id, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '00001') OR contains(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), '00001')) ORDER BY c_custkey LIMIT 50")
def profile_search(spark, d):
    """Search text or key, sorted, first fifty (a top-k report)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ucr_id"), "c_name", F.col("c_mktsegment").alias("resolution_status"))
    return lookup.search(lookup.search_index(c, "c_name"), "00001", "BUILDING").select("ucr_id", "c_name")


@query("SELECT c_custkey, a.attribute, coalesce(CASE a.attribute WHEN 'name' THEN c_name WHEN 'segment' THEN CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END END, '') AS value, CASE WHEN a.attribute = 'segment' AND c_custkey % 5 = 0 THEN 'No populated candidate' ELSE 'Selected' END AS reason FROM customer, (SELECT unnest(['name', 'segment']) AS attribute) a")
def provenance_grid(spark, d):
    """Every entity by every attribute."""
    c = table(spark, d, "customer").withColumn("ucr_id", F.col("c_custkey"))
    e = F.explode(F.array(F.struct(F.lit("name").alias("attribute"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("attribute"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("value"))))
    chosen = c.select("ucr_id", e.alias("e")).select("ucr_id", "e.*", F.lit("STG").alias("staging_record_id"), F.lit("CRM").alias("source_system"), F.lit(1).alias("candidate_count"), F.lit(1).alias("distinct_count"))
    return gold.provenance(chosen, c, ("name", "segment")).select(F.col("ucr_id").alias("c_custkey"), "attribute", "value", "reason")


@query()
def generated_customers(spark, d):
    """A generated population with its defects."""
    return fixtures.crm(fixtures.customers(spark, 1000))


@query()
def generated_sales(spark, d):
    """Tickets whose quantities add up to each event's attendance."""
    people = fixtures.customers(spark, 1000)
    return population.shop(people, fixtures.crm(people), fixtures.events(spark, 4))


@query()
def golden_records(spark, d):
    """All systems of a population, from raw rows to golden records."""
    run = resolution.resolve(resolution.silver(resolution.generated(spark, 200, 2, 400, 60, 180)))
    return resolution.golden(run)["master"]


@query()
def linkage_quality(spark, d):
    """Quality after the exact and after the fuzzy stage."""
    raw = resolution.generated(spark, 200, 2, 400, 60, 180)
    return resolution.stage_quality(resolution.resolve(resolution.silver(raw)), truth(raw))


@query()
def cluster_maps(spark, d):
    """One graph text per entity."""
    return lookup.cluster_map(_sources(spark, d).withColumn("ucr_id", F.col("portal_user_id")))
