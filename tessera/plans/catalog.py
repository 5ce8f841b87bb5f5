"""Registered queries: every operator applied to the driver's tables, beside SQL that says the same.

Roles of the tables: nation is the tenant, customer the account, orders interactions and deals, lineitem action items,
supplier the owner, part the topic, embeddings the vector index (label is its scope), labels the verdicts, events the
envelope stream, conversations the transcripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import scalars as X
from tessera.functions.udfs import embedder, name_similarity, normalize_name
from tessera.operators import graph as G
from tessera.operators import mirror as M
from tessera.operators import resolve as R
from tessera.operators import upsert as U
from tessera.operators import vector as V
from tessera.plans import deals as D
from tessera.plans import topics as T
from tessera.plans.pipelines import run_items
from tessera.scratch import Stages, folder
from tessera.shipping import ship
from tessera.sources import envelopes as E
from tessera.streaming.runner import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Data:
    """The driver's tables in their roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def items(self, accounts: bool = True) -> DataFrame:
        """Action items; the account of each costs a join, so it is left out where it is not used."""
        li = self.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item_id"), F.col("l_orderkey").alias("interaction_id"), F.col("l_partkey").alias("topic_id"), F.col("l_suppkey").alias("owner_id"), F.col("l_shipdate").alias("created_at"),
            F.when(F.col("l_linestatus") == "O", "open").when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "cancelled").otherwise("in_progress").alias("status"),
            (1 + F.floor("l_quantity") % 5).alias("impact"), (1 + F.floor(F.round(F.col("l_discount") * 100)) % 5).alias("urgency"), (1 + F.floor(F.round(F.col("l_tax") * 100)) % 5).alias("specificity"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
        score = X.priority_score(F.col("impact"), F.col("urgency"), F.col("specificity"), F.col("confidence"))
        li = li.withColumn("priority_score", score)
        if not accounts:
            return li
        return li.join(self.orders.select(F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("account_id")), "interaction_id")

    def vectors(self) -> DataFrame:
        return self.embeddings

    def probes(self) -> DataFrame:
        """The stated query set: every vector whose id is divisible by 50."""
        return self.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")


ITEMS = """
items AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item_id, l_orderkey AS interaction_id, l_partkey AS topic_id, l_suppkey AS owner_id, l_shipdate AS created_at, o_custkey AS account_id,
 CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'in_progress' END AS status,
 1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS impact, 1 + CAST(floor(round(l_discount * 100)) AS BIGINT) % 5 AS urgency, 1 + CAST(floor(round(l_tax * 100)) AS BIGINT) % 5 AS specificity, round(1 - l_discount, 2) AS confidence,
 round(0.40::DOUBLE * (1 + CAST(floor(l_quantity) AS BIGINT) % 5) / 5 + 0.35::DOUBLE * (1 + CAST(floor(round(l_discount * 100)) AS BIGINT) % 5) / 5 + 0.15::DOUBLE * (1 + CAST(floor(round(l_tax * 100)) AS BIGINT) % 5) / 5 + 0.10::DOUBLE * round(1 - l_discount, 2), 3) AS priority_score
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
COS = "list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[])"


# reads


@query(f"WITH {ITEMS} SELECT account_id, item_id, status, priority_score FROM items WHERE status IN ('open', 'in_progress') AND priority_score >= 0.5 QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY priority_score DESC NULLS LAST, created_at DESC, item_id) <= 20")
def q3_prioritized_items(spark, sf):
    items = G.at_least(Data(spark, sf).items().where(F.col("status").isin("open", "in_progress")), priority_score=0.5)
    return G.top(items, [F.desc_nulls_last("priority_score"), F.desc("created_at"), F.asc("item_id")], 20, ["account_id"]).select("account_id", "item_id", "status", "priority_score")


@query("SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 7")
def q1_point_lookup(spark, sf):
    return G.point(Data(spark, sf).customer.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), account_id=7)


@query(f"WITH {ITEMS} SELECT account_id, item_id, created_at FROM items QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, item_id) <= 5")
def q2_recent_items(spark, sf):
    return G.top(Data(spark, sf).items(), [F.desc("created_at"), F.asc("item_id")], 5, ["account_id"]).select("account_id", "item_id", "created_at")


HISTORY = "SELECT o_custkey AS account_id, o_orderkey AS deal_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderdate AS valid_until, o_orderstatus AS stage, o_totalprice AS amount FROM orders"


def history(d: Data) -> DataFrame:
    rows = d.orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("deal_id"), F.col("o_orderdate").alias("valid_until"), F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").alias("amount"))
    return G.ranked(rows, [F.asc("valid_until"), F.asc("deal_id")], ["account_id"], "version")


@query(HISTORY)
def q4_history(spark, sf):
    return history(Data(spark, sf)).select("account_id", "deal_id", "version", "valid_until", "stage", "amount")


@query(f"WITH {ITEMS}, n AS (SELECT topic_id, count(*) AS n FROM items GROUP BY 1) SELECT p_brand AS account, p_partkey AS topic_id, n.n AS item_count FROM part JOIN n ON n.topic_id = p_partkey QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n.n DESC, p_partkey) <= 50")
def q6_topics_for_account(spark, sf):
    d = Data(spark, sf)
    n = d.items(False).groupBy("topic_id").agg(F.count("*").alias("item_count"))
    rows = d.part.select(F.col("p_brand").alias("account"), F.col("p_partkey").alias("topic_id")).join(n, "topic_id")
    return G.top(rows, [F.desc("item_count"), F.asc("topic_id")], 50, ["account"]).select("account", "topic_id", "item_count")


@query(f"WITH {ITEMS} SELECT p_partkey AS topic_id, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS members, greatest(count(item_id), 1) AS elements FROM part LEFT JOIN items ON topic_id = p_partkey AND status = 'cancelled' GROUP BY 1")
def q7_topic_with_items(spark, sf):
    d = Data(spark, sf)
    topics = d.part.select(F.col("p_partkey").alias("topic_id"))
    rows = G.children(topics, d.items(False).where(F.col("status") == "cancelled"), ["topic_id"], ["item_id", "confidence"], "items")
    return rows.select("topic_id", F.array_join(F.sort_array(F.col("items.item_id")), ",").alias("members"), F.size("items").cast("long").alias("elements"))


@query(f"WITH {ITEMS} SELECT s_suppkey AS owner_id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT owner_id FROM items WHERE priority_score >= 0.95)")
def q9_owners_of_items(spark, sf):
    d = Data(spark, sf)
    owners = d.supplier.select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("name"))
    return G.linked_once(owners, G.at_least(d.items(False), priority_score=0.95), ["owner_id"])


@query("SELECT o_custkey AS account_id, o_orderkey AS deal_id, o_orderdate AS updated_at FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 50")
def q12_deals_for_account(spark, sf):
    deals = G.scope(Data(spark, sf).orders, o_orderstatus="O", o_custkey=None)
    return G.top(deals, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, ["o_custkey"]).select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("deal_id"), F.col("o_orderdate").alias("updated_at"))


@query(f"SELECT account_id, deal_id, version, stage FROM ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY version DESC) = 1")
def q13_latest_version(spark, sf):
    return G.latest(history(Data(spark, sf)), ["account_id"], "version").select("account_id", "deal_id", "version", "stage")


@query(f"WITH {ITEMS} SELECT item_id, s_name AS owner, p_name AS topic, coalesce(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority), '') AS titles FROM items LEFT JOIN supplier ON owner_id = s_suppkey AND s_acctbal > 0 LEFT JOIN part ON topic_id = p_partkey AND p_size > 10 LEFT JOIN orders ON o_orderkey = interaction_id AND o_orderstatus <> 'P' GROUP BY 1, 2, 3")
def q15_items_report(spark, sf):
    d = Data(spark, sf)
    owners = d.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("owner"))
    topics = d.part.where("p_size > 10").select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("topic"))
    titles = d.orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("interaction_id"), F.col("o_orderpriority").alias("title"))
    rows = d.items(False).join(owners, "owner_id", "left").join(topics, "topic_id", "left").join(titles, "interaction_id", "left")
    return rows.groupBy("item_id", "owner", "topic").agg(F.array_join(F.sort_array(F.collect_set("title")), "|").alias("titles"))


@query("WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_brand AS name, coalesce(n.n, 0) AS item_count, string_agg(CASE WHEN p_size > 25 THEN p_type END, '|' ORDER BY p_type, p_partkey) AS summaries FROM part LEFT JOIN n ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(CASE WHEN p_size > 25 THEN p_type END) > 0")
def q16_topic_report(spark, sf):
    d = Data(spark, sf)
    topics = d.part.select("p_partkey", F.col("p_brand").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("summary"))
    counted = G.counted(topics, d.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"], "item_count")
    told = F.sort_array(F.collect_list(F.when(F.col("summary").isNotNull(), F.struct("summary", "p_partkey"))))
    return counted.groupBy("name", "item_count").agg(told.alias("s")).where(F.size("s") > 0).select("name", "item_count", F.array_join(F.col("s.summary"), "|").alias("summaries"))


@query("SELECT o_orderkey AS interaction_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def q17_interaction_report(spark, sf):
    d = Data(spark, sf)
    return G.counted(d.orders.select(F.col("o_orderkey").alias("interaction_id")), d.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("interaction_id")), ["interaction_id"])


@query("SELECT s_name AS name, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def q18_owner_leaderboard(spark, sf):
    d = Data(spark, sf)
    counted = G.counted(d.supplier.select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("name")), d.lineitem.select(F.col("l_suppkey").alias("owner_id")), ["owner_id"])
    return counted.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name")


@query("SELECT 'account' AS label, count(*) AS n FROM customer UNION ALL SELECT 'deal', count(*) FROM orders UNION ALL SELECT 'item', count(*) FROM lineitem UNION ALL SELECT 'owner', count(*) FROM supplier")
def q20_node_counts(spark, sf):
    d = Data(spark, sf)
    return G.node_counts({"account": d.customer, "deal": d.orders, "item": d.lineitem, "owner": d.supplier})


@query("SELECT p_brand AS topic, count(*) AS item_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def q21_membership_counts(spark, sf):
    d = Data(spark, sf)
    per_part = d.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return d.part.join(per_part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("topic")).agg(F.sum("n").alias("item_count"))


@query("WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches FROM a FULL JOIN b ON a.k = b.k")
def q22_reconciliation(spark, sf):
    d = Data(spark, sf)
    count = lambda df, c: df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    return G.reconcile(count(d.orders, "o_orderkey"), count(d.lineitem, "l_orderkey"), "k")


@query("WITH n AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 END) AS a, sum(CASE WHEN event_type = 'signup' THEN 1 END) AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'PASS' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'PARTIAL' ELSE 'FAIL' END AS state FROM n")
def q23_convergence(spark, sf):
    one = lambda t: F.sum(F.when(F.col("event_type") == t, 1))
    rows = Data(spark, sf).events.groupBy("user_id").agg(one("purchase").alias("a"), one("signup").alias("b"))
    return rows.select("user_id", G.convergence(F.col("a"), F.col("b")).alias("state"))


@query("SELECT l_orderkey AS k, l_linenumber AS i, nullif(l_returnflag, 'N') IS NOT NULL AS has_flag, count(*) AS n FROM lineitem GROUP BY ALL")
def q24_presence(spark, sf):
    return Data(spark, sf).lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.nullif("l_returnflag", F.lit("N")).isNotNull().alias("has_flag")).agg(F.count("*").alias("n"))


@query(f"SELECT q.vec_id AS a, x.vec_id AS b, round({COS}, 6) AS score FROM embeddings q JOIN embeddings x ON q.vec_id < x.vec_id AND q.label <> x.label WHERE round({COS}, 6) > 0.25 ORDER BY score DESC, a, b LIMIT 20")
def q25_cross_source_pairs(spark, sf):
    return V.similar_pairs(Data(spark, sf).vectors(), "label", 0.25, 20)


@query(f"SELECT * FROM (SELECT account_id, deal_id, version, coalesce(lag(valid_until) OVER (PARTITION BY account_id ORDER BY version), TIMESTAMP '1990-01-01') AS effective_from, valid_until AS effective_until FROM ({HISTORY})) WHERE effective_from <= TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-06-01' < effective_until")
def t8_as_of(spark, sf):
    rows = history(Data(spark, sf)).withColumn("start", F.lit("1990-01-01").cast("timestamp"))
    rows = G.intervals(rows, ["account_id"], "version", "start", "valid_until")
    return G.as_of(rows, F.lit("1995-06-01").cast("timestamp")).select("account_id", "deal_id", "version", "effective_from", "effective_until")


# vectors

TOPK = f"SELECT q.vec_id AS query_id, x.vec_id, round({COS}, 6) AS score, q.label FROM embeddings q JOIN embeddings x ON q.label = x.label WHERE q.vec_id % 50 = 0 AND round({COS}, 6) >= 0.1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 6) DESC, x.vec_id) <= 10"


@query(TOPK)
def v2_topk_search(spark, sf):
    d = Data(spark, sf)
    return V.search(d.probes(), d.vectors(), 10, 0.1, ["label"])


@query(f"SELECT query_id, vec_id, score, label FROM (SELECT q.vec_id AS query_id, x.vec_id, round((1 + {COS}) / 2, 6) AS score, q.label, x.label AS other FROM embeddings q, embeddings x WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round((1 + {COS}) / 2, 6) DESC, x.vec_id) <= 10) WHERE label = other AND score >= 0.55")
def v2_post_filtered(spark, sf):
    d = Data(spark, sf)
    return V.search(d.probes(), d.vectors(), 10, 0.55, ["label"], scale="unit_interval", post_filter=True)


@query(f"WITH a AS (SELECT q.vec_id AS query_id, x.vec_id, greatest(round({COS}, 6), round(list_cosine_similarity(q.embedding::DOUBLE[], list_reverse(x.embedding)::DOUBLE[]), 6)) AS score FROM embeddings q JOIN embeddings x ON q.label = x.label WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, score FROM a WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5")
def v3_dual_search(spark, sf):
    d = Data(spark, sf)
    index = d.vectors().withColumn("embedding_current", F.reverse("embedding"))
    return V.search(d.probes(), index, 5, 0.1, ["label"]).select("query_id", "vec_id", "score")


DECIDED = f"t AS ({TOPK}), d AS (SELECT query_id, vec_id, score, CASE WHEN score >= 0.3 THEN true ELSE vec_id % 3 = 0 END AS same, CASE WHEN score >= 0.3 THEN score ELSE 0.9 END AS confidence, CASE WHEN score >= 0.3 THEN 'merge' WHEN vec_id % 2 = 0 THEN 'merge' ELSE 'link_related' END AS route FROM t)"


def decided(d: Data) -> tuple[DataFrame, DataFrame]:
    found = V.search(d.probes(), d.vectors(), 10, 0.1, ["label"]).select("query_id", "vec_id", "score")
    decisions = found.select("query_id", "vec_id", (F.col("vec_id") % 3 == 0).alias("same"), F.lit(0.9).alias("confidence"), F.when(F.col("vec_id") % 2 == 0, "merge").otherwise("link_related").alias("route"))
    return found, decisions


@query(f"WITH {DECIDED} SELECT * FROM d")
def v7_item_decisions(spark, sf):
    return V.item_decisions(*decided(Data(spark, sf)), auto=0.3)


@query(f"WITH {DECIDED} SELECT * FROM d WHERE same AND route = 'merge' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, score DESC, vec_id) = 1")
def v8_best_match(spark, sf):
    return V.best_match(V.item_decisions(*decided(Data(spark, sf)), auto=0.3))


@query(f"WITH {DECIDED} SELECT count(*) AS candidates, count_if(same) AS same, count_if(same AND route = 'merge') AS usable, count(DISTINCT query_id) AS queries FROM d")
def v9_batch_totals(spark, sf):
    rows = V.item_decisions(*decided(Data(spark, sf)), auto=0.3)
    return rows.agg(F.count("*").alias("candidates"), F.count_if("same").alias("same"), F.count_if(F.col("same") & (F.col("route") == "merge")).alias("usable"), F.countDistinct("query_id").alias("queries"))


@query(f"WITH t AS ({TOPK}), b AS (SELECT query_id, max(score) AS score FROM t WHERE vec_id <> query_id GROUP BY 1), p AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0) SELECT p.query_id, CASE WHEN b.score IS NULL THEN 'create_new' WHEN b.score >= 0.35 THEN 'link_existing' WHEN b.score < 0.2 THEN 'create_new' WHEN p.query_id % 100 = 0 THEN 'link_existing' ELSE 'create_new' END AS decision, round(CASE WHEN b.score IS NULL THEN 1.0::DOUBLE WHEN b.score >= 0.35 THEN b.score WHEN b.score < 0.2 THEN 1 - b.score WHEN p.query_id % 100 = 0 THEN b.score ELSE 1 - b.score END, 6) AS confidence FROM p LEFT JOIN b USING (query_id)")
def v10_topic_routes(spark, sf):
    d = Data(spark, sf)
    best = V.search(d.probes(), d.vectors(), 10, 0.1, ["label"]).where("vec_id != query_id").groupBy("query_id").agg(F.max("score").alias("score"))
    route = V.topic_route(F.col("score"), F.col("query_id") % 100 == 0, link=0.35, create=0.2)
    return d.probes().select("query_id").join(best, "query_id", "left").withColumn("r", route).select("query_id", F.col("r.decision").alias("decision"), F.round("r.confidence", 6).alias("confidence"))


@query(f"WITH t AS ({TOPK}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM t WHERE vec_id <> query_id), h AS (SELECT * FROM r WHERE (rank = 1 AND score >= 0.35) OR (vec_id % 3 = 0 AND vec_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1) SELECT q.query_id, h.vec_id, h.score, CASE WHEN h.rank = 1 AND h.score >= 0.35 THEN 'auto_match' WHEN h.rank IS NOT NULL THEN 'llm_match' ELSE 'create_new' END AS match_type FROM (SELECT DISTINCT query_id FROM r) q LEFT JOIN h USING (query_id)")
def v11_deal_match(spark, sf):
    found, decisions = decided(Data(spark, sf))
    return V.deal_match(found.where("vec_id != query_id"), decisions, auto=0.35, floor=0.1)


@query("SELECT o_custkey AS account_id, o_orderkey AS idx, o_totalprice AS confidence FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def v12_targeted_cap(spark, sf):
    return V.most_confident(Data(spark, sf).orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("confidence")), ["account_id"])


@query("SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_id AS opportunity_id, CASE WHEN o_orderkey IS NULL THEN 'discovery' ELSE 'targeted' END AS mode FROM events LEFT JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) ON o_orderkey = event_id AND o_custkey = user_id")
def v13_mode_router(spark, sf):
    d = Data(spark, sf)
    deals = d.orders.select(F.col("o_custkey").cast("string").alias("tenant_id"), F.col("o_orderkey").alias("opportunity_id"))
    return V.mode(d.events.select(F.col("user_id").cast("string").alias("tenant_id"), F.col("event_id").alias("opportunity_id")), deals).select("tenant_id", "opportunity_id", "mode")


CLUSTERS = f"""
e AS (SELECT vec_id // 16 AS batch_id, vec_id AS item_idx, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS i, embedding FROM embeddings),
sims AS (SELECT q.batch_id, q.i, list(round({COS}, 6) ORDER BY x.i) AS s FROM e q JOIN e x ON x.batch_id = q.batch_id AND x.i < q.i GROUP BY 1, 2),
fold AS (SELECT batch_id, 1 AS i, [0] AS a FROM e WHERE i = 1
 UNION ALL SELECT f.batch_id, f.i + 1, list_append(f.a, list_filter(range(0, list_max(f.a) + 2), lambda c: len(list_filter(range(1, len(f.a) + 1), lambda j: f.a[j] = c AND s.s[j] < 0.15)) = 0)[1]::INT) FROM fold f JOIN sims s ON s.batch_id = f.batch_id AND s.i = f.i + 1),
done AS (SELECT batch_id, arg_max(a, i) AS a FROM fold GROUP BY 1),
clusters AS (SELECT e.batch_id, e.item_idx, a[e.i]::BIGINT AS cluster_id FROM e JOIN done USING (batch_id))"""


def batches(d: Data) -> DataFrame:
    """Vectors in batches of sixteen, as one envelope's items."""
    return d.vectors().select(F.floor(F.col("vec_id") / 16).alias("batch_id"), F.col("vec_id").alias("item_idx"), "embedding", F.col("vec_id").cast("string").alias("summary"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clusters")
def v5_clusters(spark, sf):
    return R.cluster(batches(Data(spark, sf)), threshold=0.15)


@query(f"WITH RECURSIVE {CLUSTERS}, sized AS (SELECT batch_id, cluster_id, count(*) AS size, list(item_idx ORDER BY item_idx) AS m FROM clusters GROUP BY 1, 2) SELECT c.batch_id, c.item_idx, CASE WHEN size > 1 THEN 'merged ' || m[1] ELSE c.item_idx::VARCHAR END AS summary, c.cluster_id, size FROM clusters c JOIN sized USING (batch_id, cluster_id) WHERE c.item_idx = coalesce(m[2], m[1])")
def v6_consolidated(spark, sf):
    items = batches(Data(spark, sf))
    clusters = R.cluster(items, threshold=0.15)
    decisions = clusters.where("cluster_id >= 0").groupBy("batch_id", "cluster_id").agg(F.lit(1).alias("primary_index"), F.concat(F.lit("merged "), F.min("item_idx")).alias("merged_summary"))
    return R.consolidate(items, clusters, decisions).select("batch_id", "item_idx", "summary", "cluster_id", "size")


@query("WITH w AS (SELECT p_partkey, unnest(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS w FROM part), h AS (SELECT p_partkey, ('0x' || left(md5(w), 6))::BIGINT % 16 AS i, CASE WHEN substr(md5(w), 7, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM w), v AS (SELECT p_partkey, list_transform(range(16), lambda d: coalesce(list_sum(list_transform(list_filter(list({'i': i, 's': s}), lambda x: x.i = d), lambda x: x.s)), 0)) AS v FROM h GROUP BY 1), n AS (SELECT p_partkey, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT p_partkey, array_to_string(list_transform(v, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END * 1000)::BIGINT), ',') AS embedding FROM n")
def v14_embeddings(spark, sf):
    rows = Data(spark, sf).part.select("p_partkey", embedder(16)(X.collapse(F.col("p_name"))).alias("e"))
    return rows.select("p_partkey", F.array_join(F.transform("e", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",").alias("embedding"))


@query(f"WITH a AS ({TOPK}), b AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], list_reverse(x.embedding)::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings x ON q.label = x.label WHERE q.vec_id % 50 = 0 AND round(list_cosine_similarity(q.embedding::DOUBLE[], list_reverse(x.embedding)::DOUBLE[]), 6) >= 0.1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, x.vec_id) <= 10) SELECT query_id, vec_id, max(score) AS score FROM (SELECT query_id, vec_id, score FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, vec_id) <= 5")
def a7_u1_merged_searches(spark, sf):
    d = Data(spark, sf)
    current = d.vectors().withColumn("embedding", F.reverse("embedding"))
    search = lambda index: V.search(d.probes(), index, 10, 0.1, ["label"]).drop("label")
    return V.merged(search(d.vectors()), search(current), k=5)


# names and joins


NAMES = """
o AS (SELECT s_nationkey::VARCHAR AS tenant_id, s_suppkey AS owner_id, s_name AS canonical_name, ['Mr ' || s_name] AS aliases, TIMESTAMP '2020-01-01' AS created_at, s_suppkey % 2 AS account_id, s_acctbal > 0 AS owned FROM supplier),
n AS (SELECT s_nationkey::VARCHAR AS tenant_id, s_suppkey % 2 AS account_id, CASE s_suppkey % 5 WHEN 0 THEN ' ' || s_name WHEN 1 THEN 'Mr ' || s_name WHEN 2 THEN s_name || ' Jr' WHEN 3 THEN upper(s_name) ELSE 'Nobody ' || s_suppkey % 40 END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey END AS contact_id FROM supplier),
hit AS (SELECT n.tenant_id, n.account_id, n.name, o.owner_id, o.created_at, CASE WHEN o.canonical_name = trim(n.name) THEN 0 WHEN list_contains(o.aliases, trim(n.name)) THEN 1 ELSE 2 END AS rank FROM (SELECT DISTINCT tenant_id, account_id, name FROM n) n JOIN o ON o.tenant_id = n.tenant_id
 AND (o.canonical_name = trim(n.name) OR list_contains(o.aliases, trim(n.name)) OR (o.owned AND o.account_id = n.account_id AND
  ((length(trim(n.name)) >= 3 AND (starts_with(lower(o.canonical_name), lower(trim(n.name))) OR ends_with(lower(o.canonical_name), lower(trim(n.name))) OR contains(lower(o.canonical_name), ' ' || lower(trim(n.name))) OR contains(lower(o.canonical_name), lower(trim(n.name)) || ' ')))
   OR (starts_with(lower(trim(n.name)), lower(o.canonical_name)) OR ends_with(lower(trim(n.name)), lower(o.canonical_name)) OR contains(lower(trim(n.name)), ' ' || lower(o.canonical_name)) OR contains(lower(trim(n.name)), lower(o.canonical_name) || ' ')))))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY tenant_id, account_id, name ORDER BY rank, created_at, owner_id) = 1)"""


def named(d: Data) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names to resolve, owners, who owns items of an account)."""
    s, k = d.supplier.withColumn("tenant_id", F.col("s_nationkey").cast("string")).withColumn("account_id", F.col("s_suppkey") % 2), F.col("s_suppkey")
    owners = s.select("tenant_id", k.alias("owner_id"), F.col("s_name").alias("canonical_name"), F.array(F.concat(F.lit("Mr "), "s_name")).alias("aliases"), F.lit(None).cast("string").alias("contact_id"), F.lit("2020-01-01").cast("timestamp").alias("created_at"))
    name = F.when(k % 5 == 0, F.concat(F.lit(" "), "s_name")).when(k % 5 == 1, F.concat(F.lit("Mr "), "s_name")).when(k % 5 == 2, F.concat("s_name", F.lit(" Jr"))).when(k % 5 == 3, F.upper("s_name")).otherwise(F.concat(F.lit("Nobody "), k % 40))
    names = s.select("tenant_id", "account_id", name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("c"), k)).alias("contact_id"))
    return names, owners, s.where("s_acctbal > 0").select("tenant_id", "account_id", k.alias("owner_id"))


@query(f"WITH {NAMES} SELECT n.tenant_id, n.account_id, n.name, best.owner_id, best.rank FROM (SELECT DISTINCT tenant_id, account_id, name FROM n) n LEFT JOIN best USING (tenant_id, account_id, name)")
def j3_j4_owner_match(spark, sf):
    return R.owner_match(*named(Data(spark, sf)))


@query(f"WITH {NAMES}, r AS (SELECT n.tenant_id, trim(n.name) AS name, n.contact_id, best.owner_id FROM n LEFT JOIN best USING (tenant_id, account_id, name)), c AS (SELECT tenant_id, owner_id, list_sort(list_distinct(list(name))) AS names, min(contact_id) AS contact_id FROM r WHERE owner_id IS NOT NULL GROUP BY 1, 2) SELECT o.tenant_id, canonical_name, array_to_string(list_concat(aliases, coalesce(list_filter(names, lambda x: x <> canonical_name AND NOT list_contains(aliases, x)), [])), '|') AS aliases, c.contact_id, false AS created FROM o LEFT JOIN c ON c.tenant_id = o.tenant_id AND c.owner_id = o.owner_id UNION ALL SELECT tenant_id, name, '', min(contact_id), true FROM r WHERE owner_id IS NULL GROUP BY 1, 2")
def w14_resolve_or_create(spark, sf):
    names, owners, owned = named(Data(spark, sf))
    text = lambda df: df.withColumn("owner_id", F.col("owner_id").cast("string"))
    out, _ = R.resolve_or_create(names, text(owners), text(owned), F.lit("2024-01-01"))
    return out.select("tenant_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "contact_id", (F.length("owner_id") == 36).alias("created"))


@query("SELECT c_custkey AS account_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j9_anti_join(spark, sf):
    d = Data(spark, sf)
    return d.customer.select(F.col("c_custkey").alias("account_id")).join(d.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("account_id")), "account_id", "left_anti")


@query("SELECT e.conv_id, e.turn, e.role, x.role AS next_role FROM conversations e JOIN conversations x ON x.conv_id = e.conv_id AND x.turn = e.turn + 1")
def j5_positional_join(spark, sf):
    c = Data(spark, sf).conversations
    return c.select("conv_id", "turn", "role").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role")), ["conv_id", "turn"])


@query("SELECT s_nationkey, lower(s_name) || 'x' AS name, s_name AS contact_name, round(2.0::DOUBLE * length(s_name) / (2 * length(s_name) + 1), 4) AS score FROM supplier")
def j8_contact_match(spark, sf):
    s = Data(spark, sf).supplier
    contacts = s.select("s_nationkey", F.col("s_name").alias("contact_name"), F.col("s_suppkey").alias("pos"))
    return R.match_contacts(s.select("s_nationkey", F.concat(F.lower("s_name"), F.lit("x")).alias("name")), contacts, "s_nationkey").select("s_nationkey", "name", "contact_name", F.round("score", 4).alias("score"))


@query("SELECT s_nationkey AS account_id, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN 'mr ' || s_name WHEN 2 THEN s_name || 'é' ELSE 'Nobody' END AS name, CASE WHEN s_suppkey % 4 < 3 THEN s_name END AS resolved, CASE s_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'fuzzy' ELSE 'unresolved' END AS method FROM supplier GROUP BY ALL")
def f11_name_resolution(spark, sf):
    s = Data(spark, sf).supplier
    owners = s.select(F.col("s_nationkey").alias("account_id"), F.col("s_name").alias("canonical_name"), F.array(F.concat(F.lit("Mr "), "s_name")).alias("aliases"))
    k = F.col("s_suppkey") % 4
    names = s.select(F.col("s_nationkey").alias("account_id"), F.when(k == 0, F.upper("s_name")).when(k == 1, F.concat(F.lit("mr "), "s_name")).when(k == 2, F.concat("s_name", F.lit("é"))).otherwise("Nobody").alias("name"))
    return R.resolve_names(names, owners)


@query("SELECT s_suppkey, lower(s_name) || 'e''x' AS normal, round(2.0::DOUBLE * 8 / (8 + length(s_name)), 4) AS similarity FROM supplier")
def f8_f10_name_functions(spark, sf):
    s = Data(spark, sf).supplier
    return s.select("s_suppkey", normalize_name(F.concat(F.lit(" "), "s_name", F.lit("É’x "))).alias("normal"), F.round(name_similarity(F.col("s_name"), F.lit("Supplier")), 4).alias("similarity"))


# scalar functions


@query(f"WITH {ITEMS} SELECT item_id, impact, urgency, specificity, confidence, priority_score FROM items")
def f1_priority_scores(spark, sf):
    return Data(spark, sf).items(False).select("item_id", "impact", "urgency", "specificity", "confidence", "priority_score")


@query("SELECT c_custkey, round(((nullif(c_name, '') IS NOT NULL)::INT + (nullif(c_mktsegment, '') IS NOT NULL)::INT + (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)) / 3.0, 6) AS completeness, CASE WHEN c_acctbal < 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scored, CASE WHEN c_acctbal < 0 THEN round(1 / 15.0::DOUBLE, 6) ELSE round(2 / 15.0::DOUBLE, 6) END AS scored_of_15 FROM customer")
def f4_f6_completeness(spark, sf):
    extra = F.when(F.col("c_acctbal") < 0, "yes")
    scores = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.when(F.col("c_acctbal") >= 0, 2))
    return Data(spark, sf).customer.select("c_custkey", F.round(X.share_filled([F.col("c_name"), F.col("c_mktsegment"), extra]), 6).alias("completeness"), X.scored_share(scores).alias("scored"), F.round(X.scored_share(scores, 15), 6).alias("scored_of_15"))


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   X ', '\\s+', ' ', 'g'))) AS canonical, left(p_type, 5) AS clipped FROM part")
def f7_canonical_names(spark, sf):
    return Data(spark, sf).part.select("p_partkey", X.canonical_name(F.concat(F.lit("  "), "p_name", F.lit("   X "))).alias("canonical"), X.clip(F.col("p_type"), 5).alias("clipped"))


@query("WITH s AS (SELECT s_suppkey, lower(s_name) AS a, CASE s_suppkey % 4 WHEN 0 THEN 'the ' || s_name || ' team' WHEN 1 THEN s_name || 'son' WHEN 2 THEN s_name ELSE 'x' || s_name || 'x' END AS b FROM supplier) SELECT s_suppkey, length(a) < length(b) AND regexp_matches(lower(b), '\\b' || a || '\\b') AS inside, starts_with(lower(b), a) OR ends_with(lower(b), a) OR contains(lower(b), ' ' || a) OR contains(lower(b), a || ' ') AS affix FROM s")
def f9_name_predicates(spark, sf):
    k = F.col("s_suppkey") % 4
    b = F.when(k == 0, F.concat(F.lit("the "), "s_name", F.lit(" team"))).when(k == 1, F.concat("s_name", F.lit("son"))).when(k == 2, F.col("s_name")).otherwise(F.concat(F.lit("x"), "s_name", F.lit("x")))
    return Data(spark, sf).supplier.select("s_suppkey", X.word_boundary_match(F.lower("s_name"), b).alias("inside"), X.loose_affix_match(F.lower("s_name"), b).alias("affix"))


@query("WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('customer:' || c_custkey)) AS h FROM customer) SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1)::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h")
def f14_name_based_ids(spark, sf):
    return Data(spark, sf).customer.select("c_custkey", X.uuid5(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("id"))


@query("SELECT o_orderkey, 'items:interaction-' || o_orderkey AS workflow, 'deal_' || right(replace('00000000-0000-5000-8000-' || lpad(o_orderkey::VARCHAR, 12, '0'), '-', ''), 16) AS ref FROM orders")
def f16_f17_ids(spark, sf):
    id_ = F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return Data(spark, sf).orders.select("o_orderkey", X.workflow_id("items", F.col("o_orderkey").cast("string")).alias("workflow"), X.reference(id_).alias("ref"))


STAGE = "CASE impact WHEN 1 THEN 'prospecting' WHEN 2 THEN 'proposal' WHEN 3 THEN 'closed_won' WHEN 4 THEN 'unheard of' END"


@query(f"WITH {ITEMS} SELECT item_id, CASE status WHEN 'open' THEN 'pending' ELSE status END AS mirrored, CASE WHEN impact > 3 AND status IN ('completed', 'in_progress', 'cancelled', 'deferred') THEN status ELSE 'open' END AS implied, coalesce(CASE WHEN impact < 4 THEN {STAGE} END, 'prospecting') AS stage, coalesce(CASE WHEN impact < 4 THEN {STAGE} END, 'negotiation') AS kept FROM items")
def f18_f19_vocabularies(spark, sf):
    i = F.col("impact")
    stage = F.when(i == 1, "prospecting").when(i == 2, "proposal").when(i == 3, "closed_won").when(i == 4, "unheard of")
    return Data(spark, sf).items(False).select("item_id", X.relational_status(F.col("status")).alias("mirrored"), X.implied_status(i > 3, F.col("status")).alias("implied"), X.new_stage(stage).alias("stage"), X.next_stage(F.lit("negotiation"), stage).alias("kept"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE 'n/a' END AS TIMESTAMP) AS at, CASE WHEN o_orderkey % 2 = 0 THEN 'constraint' ELSE 'query' END AS store, CASE WHEN o_orderkey % 2 = 0 THEN 'rate_limit' ELSE 'model_error' END AS model FROM orders")
def f23_f29_times_and_errors(spark, sf):
    even = F.col("o_orderkey") % 2 == 0
    return Data(spark, sf).orders.select("o_orderkey", X.parse_time(F.when(even, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("n/a")).alias("at"), X.store_error(F.when(even, "Unique id violated").otherwise("bad syntax")).alias("store"), X.model_error(F.when(even, "Rate limit hit").otherwise("boom")).alias("model"))


@query("SELECT vec_id, len(embedding)::BIGINT AS dims, round(embedding[1]::DOUBLE, 5) AS first, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def f22_vector_literals(spark, sf):
    literal = X.vector_literal(F.col("embedding"))
    read = F.transform(F.split(F.regexp_extract(literal, r"^\[(.*)\]$", 1), ","), lambda x: x.cast("double"))
    rows = Data(spark, sf).vectors().select("vec_id", read.alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.col("v")[0], 5).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# projections, filters, verdicts


@query("WITH v AS (SELECT o_custkey, arg_max(o_orderstatus <> 'P', o_orderkey) AS actionable, arg_max(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.3 ELSE 0.9 END, o_orderkey) AS adjusted FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN true ELSE actionable AND adjusted >= 0.4 END AS kept, coalesce(adjusted, 1.0)::DOUBLE AS confidence FROM customer LEFT JOIN v ON o_custkey = c_custkey")
def p13_verdicts(spark, sf):
    d = Data(spark, sf)
    verdicts = d.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") != "P").alias("actionable"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.3).otherwise(0.9).alias("adjusted"), F.col("o_orderkey").alias("pos"))
    return R.apply_verdicts(d.customer.select("c_custkey", F.lit(1.0).alias("confidence")), verdicts, ["c_custkey"])


@query("SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, CASE WHEN l_returnflag = 'R' THEN 'meddic_champion,stage,stage' ELSE 'amount' END AS changed FROM lineitem")
def p14_changed_fields(spark, sf):
    fields = F.when(F.col("l_returnflag") == "R", F.array(*map(F.lit, ["champion", "stage", "bogus", "stage"]))).otherwise(F.array(F.lit("amount"), F.lit("nothing")))
    changed = X.normalised_fields(fields, {"champion": "meddic_champion"}, ["meddic_champion", "stage", "amount"])
    return Data(spark, sf).lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.array_join(changed, ",").alias("changed"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(role || ' ' || text), 'assistant') OR contains(lower(role || ' ' || text), 'pathetic')")
def p16_keywords(spark, sf):
    return Data(spark, sf).conversations.where(G.mentions(["Assistant", "pathetic"], "role", "text")).select("conv_id", "turn")


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k, CASE WHEN event_type = 'view' THEN 'named' ELSE 'role_inferred' END AS owner_type, CASE WHEN event_type = 'view' THEN 'me' ELSE 'you' END AS owner FROM events")
def p6_p12_extras_and_owner(spark, sf):
    rows = Data(spark, sf).events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.lit("me").alias("user_name"), (F.col("event_type") == "view").alias("is_user_owned"), F.lit("you").alias("owner"), F.lit("role_inferred").alias("owner_type"))
    return E.owner_override(rows).select("event_id", "k", "owner_type", "owner")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'A <a@example.com> (lead)' WHEN 'error' THEN 'A (lead)' ELSE 'a@example.com (lead)' END AS label, CASE WHEN event_type IN ('view', 'error') THEN 'A' ELSE 'a@example.com' END AS name FROM events")
def p7_contact_labels(spark, sf):
    c = F.struct(F.when(F.col("event_type").isin("view", "error"), "A").alias("name"), F.when(F.col("event_type") != "error", "a@example.com").alias("email"), F.lit("lead").alias("role"))
    return Data(spark, sf).events.select("event_id", X.contact_label(c).alias("label"), X.contact_name(c).alias("name"))


# sources and sinks

RECORDS = "SELECT event_id, event_id % 7 = 0 AS broken, event_id % 5 = 0 AS bare FROM events"


def records(d: Data) -> DataFrame:
    detail = F.to_json(F.struct(F.lit("t").alias("tenant_id"), F.lit("u").alias("user_id"), F.lit("note").alias("interaction_type"), F.struct(F.col("event_type").alias("text"), F.lit("plain").alias("format")).alias("content"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("api").alias("source"), F.col("event_id").cast("string").alias("interaction_id"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("account_id")))
    body = F.when(F.col("event_id") % 7 == 0, "{nope").when(F.col("event_id") % 5 == 0, '{"id": "1"}').otherwise(F.concat(F.lit('{"version": "0", "detail-type": "EnvelopeV1.note", "source": "x", "detail": '), detail, F.lit("}")))
    return d.events.select(body.alias("body"))


@query(f"SELECT CASE WHEN broken THEN 'invalid JSON' WHEN bare THEN 'missing detail' WHEN event_id % 3 = 0 THEN 'missing account_id' ELSE 'good' END AS state, count(*) AS n FROM ({RECORDS}) GROUP BY 1")
def s1_p15_parse_and_gate(spark, sf):
    return E.checked(records(Data(spark, sf))).groupBy(F.coalesce("reason", F.lit("good")).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT p AS pipeline, p || ':interaction-' || event_id AS workflow_id FROM events, (VALUES ('items'), ('deals')) v(p) WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def s2_workflows(spark, sf):
    good, _ = E.parse_records(records(Data(spark, sf)))
    return E.workflows(good.unionByName(good)).select("pipeline", "workflow_id")


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content_text FROM conversations GROUP BY 1")
def s7_transcripts(spark, sf):
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return Data(spark, sf).conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.sort_array(F.collect_list(line))["line"], "\n").alias("content_text"))


@query("SELECT o_orderkey AS id, o_orderdate AS date FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s8_manifest(spark, sf):
    d = Data(spark, sf)
    manifest = d.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return E.by_manifest(d.orders, manifest, "o_custkey", F.col("o_orderdate")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"))


@query("WITH r AS (SELECT o_custkey::VARCHAR AS run, o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'F' THEN 'updated' ELSE 'none' END AS action, o_shippriority + o_orderkey % 5 AS score FROM (SELECT *, 0 AS o_shippriority FROM orders)) SELECT run, coalesce(string_agg(CASE WHEN action = 'created' THEN id END, ',' ORDER BY id), '') AS created, coalesce(string_agg(CASE WHEN action = 'updated' THEN id END, ',' ORDER BY id), '') AS updated, '{' || string_agg('\"' || id || '\":' || score, ',' ORDER BY id) || '}' AS scores, sha256(run) AS dedup_key FROM r GROUP BY 1 HAVING count_if(action <> 'none') > 0")
def s13_outbox(spark, sf):
    rows = Data(spark, sf).orders.select(F.col("o_custkey").cast("string").alias("run"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "updated").otherwise("none").alias("action"), (F.col("o_orderkey") % 5).alias("score"))
    return U.outbox(rows, ["run"]).select("run", F.array_join("created_ids", ",").alias("created"), F.array_join("updated_ids", ",").alias("updated"), "scores", "dedup_key")


@query("SELECT o_custkey::VARCHAR AS key, '{\"tenant_id\":\"t\",\"account_id\":\"' || o_custkey || '\",\"interaction_id\":\"' || o_custkey || '\",\"created\":[' || coalesce(string_agg(CASE WHEN o_orderstatus = 'O' THEN '\"' || o_orderkey || '\"' END, ',' ORDER BY o_orderkey::VARCHAR), '') || '],\"merged\":[' || coalesce(string_agg(CASE WHEN o_orderstatus = 'F' THEN '\"' || o_orderkey || '\"' END, ',' ORDER BY o_orderkey::VARCHAR), '') || ']}' AS value FROM orders GROUP BY o_custkey HAVING count_if(o_orderstatus IN ('O', 'F')) > 0")
def s14_deal_events(spark, sf):
    ids = lambda s: F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey").cast("string"))))
    rows = Data(spark, sf).orders.groupBy(F.col("o_custkey").cast("string").alias("interaction_id")).agg(ids("O").alias("created"), ids("F").alias("merged")).withColumns({"tenant_id": F.lit("t"), "account_id": F.col("interaction_id")})
    return E.deal_events(rows)


@query("SELECT c_nationkey::VARCHAR AS tenant_id, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1")
def s15_purge(spark, sf):
    rows = Data(spark, sf).customer.select(F.col("c_nationkey").cast("string").alias("tenant_id"))
    return U.purge(rows, "3").groupBy("tenant_id").agg(F.count("*").alias("n"))


# writes


@query("WITH t AS (SELECT o_orderkey AS id, o_orderstatus AS stage, o_totalprice AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' END AS title FROM orders WHERE o_orderdate < '1997-01-01'), s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'X' END AS stage, o_totalprice * 2 AS amount, 'new' AS title FROM orders WHERE o_orderdate >= '1994-01-01') SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.stage ELSE t.stage END AS stage, CASE WHEN t.id IS NOT NULL THEN t.amount ELSE s.amount END AS amount, CASE WHEN t.id IS NULL THEN s.title ELSE coalesce(t.title, s.title) END AS title FROM t FULL JOIN s ON t.id = s.id")
def w2_w24_upsert(spark, sf):
    o = Data(spark, sf).orders
    target = o.where("o_orderdate < '1997-01-01'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, "kept").alias("title"))
    source = o.where("o_orderdate >= '1994-01-01'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", "X").alias("stage"), (F.col("o_totalprice") * 2).alias("amount"), F.lit("new").alias("title"))
    return U.upsert(target, source, ["id"], update=["stage"], fill=["title"], insert_only=["amount"])


@query("SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, -1.0::DOUBLE FROM orders WHERE o_orderstatus <> 'O'")
def w5_append_absent(spark, sf):
    o = Data(spark, sf).orders.withColumnRenamed("o_orderkey", "id")
    return U.append_absent(o.where("o_orderstatus = 'O'").select("id", F.col("o_totalprice").alias("amount")), o.select("id", F.lit(-1.0).alias("amount")), ["id"])


@query("SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS segment, TIMESTAMP '2024-01-01' AS valid_until FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def w7_snapshots(spark, sf):
    d = Data(spark, sf)
    state = d.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return U.snapshot(state, d.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("account_id")), ["account_id"], {"valid_until": F.lit("2024-01-01").cast("timestamp")})


@query("WITH old AS (SELECT ps AS src_id, pp AS dst_id, TIMESTAMP '2000-01-01' AS created_at FROM (SELECT DISTINCT l_suppkey AS ps, l_partkey AS pp FROM lineitem WHERE l_returnflag = 'R')), new AS (SELECT DISTINCT l_suppkey AS src_id, l_partkey AS dst_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) SELECT src_id, dst_id, coalesce(old.created_at, TIMESTAMP '2024-01-01') AS created_at FROM old FULL JOIN new USING (src_id, dst_id)")
def w12_links(spark, sf):
    d = Data(spark, sf)
    link = d.lineitem.select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), "l_returnflag")
    old = link.where("l_returnflag = 'R'").select("src_id", "dst_id", F.lit("2000-01-01").cast("timestamp").alias("created_at")).distinct()
    new = link.select("src_id", "dst_id", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return U.link(old, new, d.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("src_id")), d.part.where("p_size > 10").select(F.col("p_partkey").alias("dst_id")), ["src_id", "dst_id"])


@query("SELECT c_custkey AS contact_id, r.role FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS role FROM orders GROUP BY 1) r ON o_custkey = c_custkey")
def w13_roles(spark, sf):
    d = Data(spark, sf)
    roles = d.orders.select(F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("seq"))
    return U.last_role(d.customer.select(F.col("c_custkey").alias("contact_id")), roles, ["contact_id"])


@query("SELECT c_custkey AS account_id, count(o_orderkey) + 1 AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def w6_w15_derived_versions(spark, sf):
    d = Data(spark, sf)
    return U.with_version(d.customer.select(F.col("c_custkey").alias("account_id")), d.orders.select(F.col("o_custkey").alias("account_id")), ["account_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def w4_last_write(spark, sf):
    return U.one_row(Data(spark, sf).events.select("user_id", "event_type", "event_id"), ["user_id"], F.col("event_id")).select("user_id", "event_type")


# aggregates, set operations, windows


@query(f"WITH {ITEMS} SELECT account_id, count(*) AS n, count_if(status = 'open') AS open_n, bool_or(status = 'cancelled') AS any_cancelled, bool_and(status = 'open') AS all_open, round(sum(priority_score), 3) AS total_score, round(count_if(topic_id % 2 = 0) / count(*), 6) AS coverage FROM items GROUP BY 1")
def a8_a14_account_report(spark, sf):
    s = F.col("status")
    return Data(spark, sf).items().groupBy("account_id").agg(F.count("*").alias("n"), F.count_if(s == "open").alias("open_n"), F.bool_or(s == "cancelled").alias("any_cancelled"), F.bool_and(s == "open").alias("all_open"), F.round(F.sum("priority_score"), 3).alias("total_score"), F.round(F.count_if(F.col("topic_id") % 2 == 0) / F.count("*"), 6).alias("coverage"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS top FROM events GROUP BY 1")
def a9_histogram(spark, sf):
    return Data(spark, sf).events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("value").alias("top"))


@query("SELECT l_returnflag AS flag, l_linestatus AS line, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (1, 2)")
def a_rollup_report(spark, sf):
    return Data(spark, sf).lineitem.rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u2_set_difference(spark, sf):
    d = Data(spark, sf)
    return d.orders.select(F.col("o_custkey").alias("id")).subtract(d.customer.where("c_acctbal < 0").select("c_custkey"))


@query("SELECT user_id, event_id, coalesce(date_diff('microsecond', lag(ts) OVER w, ts), 0) AS gap_us, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def k_running_history(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return Data(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", F.coalesce(gap, F.lit(0).cast("long")).alias("gap_us"), last.alias("last_purchase"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def x_windowed_events(spark, sf):
    return windowed_counts(Data(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp")))


# points, histories and reports of single tables


@query("SELECT 'topic' AS kind, p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey = 3 UNION ALL SELECT 'deal', o_orderkey::VARCHAR, o_orderpriority FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT 'interaction', conv_id::VARCHAR || ':' || turn, role FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn = (SELECT min(turn) FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations))")
def q5_q11_q14_points(spark, sf):
    d = Data(spark, sf)
    topic = G.point(d.part, p_partkey=3).select(F.lit("topic").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    first = d.orders.agg(F.min("o_orderkey")).first()[0]
    deal = G.point(d.orders, o_orderkey=first).select(F.lit("deal"), F.col("o_orderkey").cast("string"), "o_orderpriority")
    conv, turn = d.conversations.agg(F.min(F.struct("conv_id", "turn")).alias("m")).select("m.*").first()
    talk = G.point(d.conversations, conv_id=conv, turn=turn).select(F.lit("interaction"), F.concat_ws(":", "conv_id", "turn"), "role")
    return topic.unionAll(deal).unionAll(talk)


@query("SELECT o_custkey AS topic_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number, o_orderkey::VARCHAR AS version_id, o_orderpriority AS summary FROM orders WHERE o_custkey % 3 = 0")
def q8_topic_history(spark, sf):
    rows = Data(spark, sf).orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("topic_id"), "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("version_id"), F.col("o_orderpriority").alias("summary"))
    return T.topic_history(G.ranked(rows, [F.asc("o_orderdate"), F.asc("o_orderkey")], ["topic_id"], "version_number")).select("topic_id", "version_number", "version_id", "summary")


@query("SELECT c_custkey AS account_id, o_orderkey AS deal_id, o_orderstatus AS stage, round(o_totalprice, 2) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS created, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS versions FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def q19_deals_report(spark, sf):
    d = Data(spark, sf)
    deals = d.orders.join(d.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    counted = G.counted(deals, d.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "versions")
    return counted.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("deal_id"), F.col("o_orderstatus").alias("stage"), F.round("o_totalprice", 2).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), "versions").orderBy("created", "deal_id")


@query("SELECT o_custkey AS run, count_if(o_orderstatus <> 'F') AS succeeded, count_if(o_orderstatus = 'F') AS failed, coalesce(string_agg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey || ' ' || o_orderpriority END, '|' ORDER BY o_orderkey), '') AS errors, count_if(o_orderstatus = 'F') = 0 AS all_succeeded, count_if(o_orderstatus <> 'F') = 0 AS all_failed, count(DISTINCT o_orderstatus = 'F') = 2 AS partial, avg(o_totalprice) AS mean FROM orders GROUP BY 1")
def a11_a12_outcomes(spark, sf):
    o = Data(spark, sf).orders
    rows = U.outcomes(o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error")), ["run"])
    mean = o.groupBy(F.col("o_custkey").alias("run")).agg(F.avg("o_totalprice").alias("mean"))
    return rows.join(mean, "run").withColumn("errors", F.array_join(F.transform("errors", lambda e: F.concat_ws(" ", e["item_id"], e["error"])), "|"))


# projections and prompts


@query("SELECT o_orderkey, '{\"deal_id\":' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',\"stage\":\"' || o_orderstatus || '\"' END || ',\"priority\":\"' || o_orderpriority || '\"}' AS props, CASE WHEN o_orderstatus = 'P' THEN 'Not identified' ELSE o_orderstatus END AS prompt_stage, 'Deal ' || o_orderkey || ' is ' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END || '.' AS prompt FROM orders")
def p1_p18_f28_properties(spark, sf):
    o = Data(spark, sf).orders.withColumn("stage", F.nullif("o_orderstatus", F.lit("P")))
    return o.select("o_orderkey", X.properties(deal_id=F.col("o_orderkey"), stage=F.col("stage"), priority=F.col("o_orderpriority")).alias("props"), X.or_default(F.col("stage")).alias("prompt_stage"), X.template("Deal {id} is {stage}.", id=F.col("o_orderkey"), stage=F.col("stage")).alias("prompt"))


ID = "00000000-0000-5000-8000-"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '{ID}' || lpad(o_orderkey::VARCHAR, 12, '0') END AS opportunity_id, CASE WHEN o_orderstatus = 'P' THEN 'prospecting' ELSE o_orderstatus END AS stage, 'USD' AS currency, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END AS created_at, o_clerk AS metrics, (o_orderkey % 4)::INT AS fit, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS fit_confidence, '{{\"technical_fit\":{{\"score\":' || o_orderkey % 4 || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',\"confidence\":0.5' END || '}}}}' AS json, NULL::INT AS other FROM (SELECT *, 'clerk' || o_custkey AS o_clerk FROM orders)")
def p2_p3_p4_p5_typed_rows(spark, sf):
    k = F.col("o_orderkey")
    score = F.create_map(F.lit("technical_fit"), F.struct((k % 4).cast("int").alias("score"), F.when(k % 5 != 0, 0.5).alias("confidence"), F.lit(None).cast("string").alias("evidence")))
    rows = Data(spark, sf).orders.select("o_orderkey", F.lit("t").alias("tenant_id"), F.when(k % 3 == 0, "not an id").otherwise(F.concat(F.lit(ID), F.lpad(k.cast("string"), 12, "0"))).alias("opportunity_id"), F.lit(None).cast("string").alias("name"), F.nullif("o_orderstatus", F.lit("P")).alias("stage"), F.lit(None).cast("string").alias("currency"), F.when(k % 2 == 0, "some day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_at"), F.lit(None).cast("long").alias("version"), F.struct(F.concat(F.lit("clerk"), "o_custkey").alias("metrics")).alias("meddic"), score.alias("dimensions"))
    typed = M.from_rows(rows.withColumn("meddic", F.struct(F.col("meddic.metrics").alias("meddic_metrics"), F.col("o_orderkey"), X.json_or_null(F.col("dimensions")).alias("json"))))
    return typed.select("o_orderkey", "opportunity_id", "stage", "currency", "created_at", F.col("meddic_metrics").alias("metrics"), F.col("dim_technical_fit").alias("fit"), F.col("dim_technical_fit_confidence").alias("fit_confidence"), "json", F.col("dim_responsiveness").alias("other"))


@query(f"WITH {ITEMS} SELECT interaction_id, count_if(impact <= 3) AS new_items, count_if(impact > 3) AS status_updates FROM items GROUP BY 1")
def p8_split(spark, sf):
    new, updates = E.split_items(Data(spark, sf).items(False).withColumn("is_status_update", F.col("impact") > 3))
    count = lambda df, n: df.groupBy("interaction_id").agg(F.count("*").alias(n))
    both = count(new, "new_items").join(count(updates, "status_updates"), "interaction_id", "full")
    return both.select("interaction_id", F.coalesce("new_items", F.lit(0).cast("long")).alias("new_items"), F.coalesce("status_updates", F.lit(0).cast("long")).alias("status_updates"))


@query("SELECT event_id, '{' || concat_ws(',', CASE WHEN event_type <> 'view' THEN '\"kept\":\"old\"' END, CASE WHEN event_id % 2 = 0 THEN '\"seen\":\"' || event_type || '\"' END) || '}' AS props FROM events")
def w4_f26_overlay(spark, sf):
    t = F.col("event_type")
    old = F.create_map(F.lit("kept"), F.lit("old"))
    updates = F.map_from_arrays(F.array(F.lit("kept"), F.lit("seen")), F.array(F.when(t != "view", "old"), F.when(F.col("event_id") % 2 == 0, t)))
    return Data(spark, sf).events.select("event_id", F.to_json(F.map_from_entries(F.sort_array(F.map_entries(X.overlay(old, updates))))).alias("props"))


@query("SELECT c_custkey, ((c_acctbal > 0)::INT + (c_custkey % 2 = 0)::INT) / 15.0::DOUBLE AS share FROM customer")
def f6_merged_share(spark, sf):
    c = Data(spark, sf).customer
    merged = F.create_map(F.lit("technical_fit"), F.when(F.col("c_acctbal") > 0, 1), F.lit("unknown"), F.lit(1))
    existing = F.create_map(F.lit("technical_fit"), F.when(F.col("c_acctbal") > 5000, 1), F.lit("responsiveness"), F.when(F.col("c_custkey") % 2 == 0, 2))
    return c.select("c_custkey", X.merged_share(merged, existing, S.DIMENSIONS).alias("share"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 AND c_acctbal > 0 THEN c_name ELSE 'the boss' END AS owner, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 AND c_acctbal > 0 THEN 'named' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'role_inferred' ELSE 'unconfirmed' END END AS owner_type FROM orders JOIN customer ON c_custkey = o_custkey")
def f12_role_owners(spark, sf):
    d = Data(spark, sf)
    by = ["account_id", "interaction_id"]
    items = d.orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("interaction_id"), F.lit("the boss").alias("owner"), F.when(F.col("o_orderkey") % 2 == 0, "role_inferred").otherwise("unconfirmed").alias("owner_type"))
    people = d.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), "c_acctbal")
    decided = d.orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("interaction_id"), F.lit("the boss").alias("owner"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.9).otherwise(0.7).alias("confidence")).join(people.select("account_id", F.col("name").alias("person")), "account_id")
    known = people.where("c_acctbal > 0").join(items.select(*by), "account_id").select(*by, "name")
    return R.role_owners(items, decided, known, by).select(F.col("interaction_id").alias("o_orderkey"), "owner", "owner_type")


@query("SELECT o_custkey AS batch_id, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS outputs FROM orders GROUP BY 1")
def f31_in_order(spark, sf):
    rows = Data(spark, sf).orders.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("output"))
    return G.in_order(rows, ["batch_id"], "index", "output").select("batch_id", F.array_join("outputs", ",").alias("outputs"))


@query("SELECT user_id, count(CASE WHEN event_type <> 'error' THEN 1 END) AS steps, coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id % 1000 END), 0)::DOUBLE AS total_ms, max(CASE WHEN event_type <> 'error' THEN event_id % 1000 END)::DOUBLE AS longest_ms FROM events GROUP BY 1")
def f3_durations(spark, sf):
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 1000) * 1000)
    rows = Data(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ended", F.when(F.col("event_type") != "error", end))
    return G.durations(rows, ["user_id"], "ts", "ended")


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind, value, ts::TIMESTAMP AS ts FROM events")
def c5_step_codec(spark, sf):
    rows = Data(spark, sf).events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "value", F.col("ts").cast("timestamp").alias("ts"))
    return E.decoded(E.encoded(rows, "extract"), "extract", "event_id long, kind string, value double, ts timestamp")


# more writes


@query("SELECT 't' AS tenant_id, c_custkey::VARCHAR AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'known' WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS name FROM customer")
def w1_ensure_accounts(spark, sf):
    c = Data(spark, sf).customer
    row = lambda name: (F.lit("t").alias("tenant_id"), F.col("c_custkey").cast("string").alias("account_id"), name.alias("name"))
    old = c.where("c_custkey % 2 = 0").select(*row(F.lit("known")), F.lit("2000-01-01").cast("timestamp").alias("created_at"))
    return U.ensure_accounts(old, c.select(*row(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))), F.lit("2024-01-01")).drop("created_at")


@query("WITH k AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS old, o_orderkey % 3 = 0 AS new FROM orders) SELECT id, CASE WHEN old THEN 'first' ELSE 'title' END AS title, CASE WHEN new THEN 7::BIGINT WHEN old THEN 1::BIGINT END AS action_item_count, CASE WHEN old AND new THEN TIMESTAMP '2024-01-01' END AS processed_at FROM k WHERE old OR new")
def w2_w3_interactions(spark, sf):
    o = Data(spark, sf).orders.select(F.col("o_orderkey").alias("id"))
    old = o.where("id % 2 = 0").select("id", F.lit("first").alias("title"), F.lit(1).cast("long").alias("action_item_count"), F.lit(None).cast("timestamp").alias("processed_at"))
    new = o.where("id % 3 = 0").select("id", F.lit("title").alias("title"), F.lit(7).cast("long").alias("action_item_count"))
    return U.upsert_interactions(old, new, ["id"], fill=["title"], update=["action_item_count"], now=F.lit("2024-01-01"))


@query("WITH seen AS (SELECT o_custkey AS contact_id, o_orderpriority AS opportunity_id, arg_min(o_orderstatus, o_orderkey) AS source FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderpriority <> '5-LOW' GROUP BY 1, 2) SELECT contact_id, opportunity_id, CASE WHEN contact_id % 4 = 0 THEN 'known' ELSE source END AS source, (SELECT count(*) FROM seen s WHERE s.opportunity_id = seen.opportunity_id) AS matched FROM seen")
def w13_engaged_on(spark, sf):
    d = Data(spark, sf)
    t = F.lit("t").alias("tenant_id")
    seen = d.orders.select(t, F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("opportunity_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("seq"))
    contacts = d.customer.where("c_acctbal > 0").select(t, F.col("c_custkey").alias("contact_id"))
    deals = seen.where("opportunity_id != '5-LOW'").select("tenant_id", "opportunity_id").distinct()
    old = seen.where("contact_id % 4 = 0").join(contacts, ["tenant_id", "contact_id"], "left_semi").join(deals, ["tenant_id", "opportunity_id"], "left_semi").select("tenant_id", "contact_id", "opportunity_id", F.lit("known").alias("source"), F.lit("2000-01-01").cast("timestamp").alias("created_at")).distinct()
    edges, matched = U.engaged_on(old, seen, contacts, deals, F.lit("2024-01-01"))
    return edges.join(matched, ["tenant_id", "opportunity_id"]).select("contact_id", "opportunity_id", "source", "matched")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders), l AS (SELECT o_custkey AS topic_id, o_orderkey AS item, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS summary, pos FROM o WHERE o_custkey % 2 = 0 AND pos > 1), told AS (SELECT *, coalesce(lag(summary) OVER (PARTITION BY topic_id ORDER BY pos), 'start') AS before FROM l WHERE summary IS NOT NULL), ch AS (SELECT * FROM told WHERE summary <> before) SELECT topic_id::VARCHAR AS topic, 1 + count(*) AS members, 1 + count(ch.item) AS version, coalesce(arg_max(ch.summary, ch.pos), 'start') AS summary, 1 + count(ch.item) AS versions, coalesce(string_agg(ch.before, '|' ORDER BY ch.pos), '') AS snapshots FROM (SELECT o_custkey AS topic_id, o_orderkey AS item FROM o WHERE o_custkey % 2 = 0 AND pos > 1) x LEFT JOIN ch USING (topic_id, item) GROUP BY 1")
def w9_w18_topics(spark, sf):
    return topic_runs(spark, sf, "o_custkey % 2 = 0").where("members > 1")


def topic_runs(spark: SparkSession, sf: str, of: str = "true", again: bool = False) -> DataFrame:
    """Topics made by each account's first order and told by the later ones of the accounts ``of``; ``again``: told twice.
    What a run writes is written once, as the next one reads it many times."""
    d, root = Data(spark, sf), folder(spark, "topics")

    def written(name: str, run: T.TopicResult) -> list[DataFrame]:
        out = []
        for table in ("topics", "versions", "memberships"):
            df = getattr(run, table)
            df.write.parquet(f"{root}/{name}/{table}")
            out.append(spark.read.schema(df.schema).parquet(f"{root}/{name}/{table}"))
        return out

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = d.orders.withColumn("pos", pos).select(F.lit("t").alias("tenant_id"), F.lit("a").alias("account_id"), F.col("o_orderkey").cast("string").alias("action_item_id"), "pos", F.concat(F.lit("Topic "), "o_custkey").alias("topic_name"), F.when(F.col("pos") == 1, "create_new").otherwise("link_existing").alias("decision"), F.lit(None).cast("string").alias("topic_id"), F.lit(0.9).alias("confidence"), (F.col("o_custkey") % 2 == 0).alias("asked"), F.when(F.col("pos") == 1, F.lit("start")).when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("summary"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit(None).cast("array<float>").alias("new_embedding"), "o_custkey")
    empty = lambda ddl: spark.createDataFrame([], S.struct(ddl))
    members = empty("tenant_id string, action_item_id string, topic_id string, confidence double, method string, created_at timestamp")
    one = written("one", T.execute(rows.where("pos = 1").drop("o_custkey"), empty(S.TABLES["topic"]), empty(S.TABLES["topic_version"]), members, "2024-01-01"))
    ids = one[0].select(F.col("name").alias("topic_name"), F.col("topic_id").alias("_id"))
    later = rows.where(f"pos > 1 and {of}").join(ids, "topic_name").withColumn("topic_id", F.col("_id")).drop("_id", "o_custkey")
    later.write.parquet(f"{root}/later")
    later = spark.read.schema(later.schema).parquet(f"{root}/later")
    topics, versions, memberships = written("two", T.execute(later, *one, "2024-02-01"))
    if again:
        topics, versions, _ = written("three", T.execute(later, topics, versions, memberships, "2024-03-01"))
    count = versions.groupBy("topic_id").agg(F.count("*").alias("versions"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("created_at") > "2024-01-15", F.struct("version_number", "summary")))), lambda x: x["summary"]), "|").alias("snapshots"))
    return topics.join(count, "topic_id").select(F.regexp_extract("name", "([0-9]+)", 1).alias("topic"), F.col("action_item_count").alias("members"), "version", "summary", "versions", "snapshots")


@query("SELECT least(l_suppkey, l_partkey) AS a, max(l_quantity) > 25 AS strong FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1")
def w16_related(spark, sf):
    rows = Data(spark, sf).lineitem.select(F.lit("t").alias("tenant_id"), F.col("l_suppkey").alias("action_item_id"), F.col("l_partkey").alias("vec_id"), F.when(F.col("l_quantity") > 25, 0.9).otherwise(0.2).alias("confidence"))
    none = rows.limit(0).select("tenant_id", F.col("action_item_id").alias("src_id"), F.col("vec_id").alias("dst_id"), "confidence")
    return U.relate(none, rows).groupBy("src_id").agg((F.max("confidence") > 0.5).alias("strong")).withColumnRenamed("src_id", "a")


# the relational mirror


@query(f"WITH {ITEMS}, s AS (SELECT item_id, CASE status WHEN 'open' THEN 'pending' ELSE status END AS status, priority_score, interaction_id % 2 = 0 AS old, interaction_id % 3 = 0 AS new FROM items) SELECT item_id AS graph_action_item_id, CASE WHEN new THEN 'now ' ELSE 'was ' END || item_id AS title, CASE WHEN new THEN status ELSE 'deferred' END AS status, CASE WHEN new THEN priority_score ELSE 0.0 END AS priority_score, CASE WHEN old THEN 'a0' ELSE 'a1' END AS account_id, CASE WHEN old THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2024-01-01' END AS created_at FROM s WHERE old OR new")
def w20_item_mirror(spark, sf):
    items = Data(spark, sf).items(False)

    def rows(df, account, word, status, score, at):
        t = F.lit(at).cast("timestamp")
        v = F.array(F.lit(1.0)).cast("array<float>")
        typed = df.select(F.col("item_id").alias("action_item_id"), F.lit("t").alias("tenant_id"), F.lit(account).alias("account_id"), F.concat(F.lit(word), "item_id").alias("summary"), F.lit("x").alias("action_item_text"), status.alias("status"), F.lit("me").alias("owner"), F.lit(1).alias("version"), v.alias("embedding"), v.alias("embedding_current"), score.alias("priority_score"), F.lit(1.0).alias("confidence"), t.alias("created_at"), t.alias("last_updated_at"))
        return M.item_rows(typed)

    old = rows(items.where("interaction_id % 2 = 0"), "a0", "was ", F.lit("deferred"), F.lit(0.0), "2000-01-01")
    new = rows(items.where("interaction_id % 3 = 0"), "a1", "now ", F.col("status"), F.col("priority_score"), "2024-01-01")
    return M.write("action_items", old, new).select("graph_action_item_id", "title", "status", "priority_score", "account_id", "created_at")


@query("WITH m AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_quantity) AS confidence FROM lineitem GROUP BY 1, 2), w AS (SELECT s_nationkey AS n, arg_max(s_suppkey, s_suppkey) AS owner_id, min(s_suppkey) AS first FROM supplier GROUP BY 1) SELECT 'membership' AS kind, a || ':' || b AS key, confidence::VARCHAR AS value FROM m UNION ALL SELECT 'owner', 'name ' || n, owner_id::VARCHAR FROM w UNION ALL SELECT 'topic', p_partkey::VARCHAR, CASE WHEN p_size > 25 THEN 'new new' ELSE 'old' END || ' ' || p_brand FROM part")
def w22_topic_mirrors(spark, sf):
    d = Data(spark, sf)
    t = F.lit("t").alias("tenant_id")
    li = d.lineitem.select(t, F.col("l_orderkey").alias("action_item_id"), F.col("l_partkey").alias("topic_id"), F.col("l_quantity").alias("confidence"), F.lit("resolved").alias("method"))
    old = li.where("action_item_id % 2 = 0").select("tenant_id", "action_item_id", "topic_id").distinct().select("*", F.lit(0.0).alias("confidence"), F.lit("extracted").alias("method"))
    members = M.write("action_item_topic_memberships", old, li, F.col("confidence"))
    owner = d.supplier.select(t, F.concat(F.lit("name "), "s_nationkey").alias("canonical_name"), F.col("s_suppkey").alias("owner_id"), F.array().cast("array<string>").alias("aliases"))
    owners = M.write("action_item_owners", owner.groupBy("tenant_id", "canonical_name").agg(F.min("owner_id").alias("owner_id"), F.first("aliases").alias("aliases")), owner, F.col("owner_id"))
    part = lambda df, word: df.select(F.col("p_partkey").alias("action_item_topic_id"), F.lit(word).alias("name"), F.lit(word).alias("summary"), F.col("p_brand").alias("canonical_name"))
    topics = M.write("action_item_topics", part(d.part, "old"), part(d.part.where("p_size > 25"), "new"))
    label = F.when(F.col("name") == "new", F.concat_ws(" ", "name", "summary", "canonical_name")).otherwise(F.concat_ws(" ", "name", "canonical_name"))
    return members.select(F.lit("membership").alias("kind"), F.concat_ws(":", "action_item_id", "topic_id").alias("key"), F.col("confidence").cast("string").alias("value")).unionAll(owners.select(F.lit("owner"), "canonical_name", F.col("owner_id").cast("string"))).unionAll(topics.select(F.lit("topic"), F.col("action_item_topic_id").cast("string"), label))


@query("SELECT o_orderkey || '' AS id, CASE WHEN o_custkey % 2 = 0 THEN 'pg' || o_custkey ELSE 'g' || o_custkey END AS opportunity_id, 1 AS version_number, o_orderpriority AS name FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def w21_w25_version_mirror(spark, sf):
    d = Data(spark, sf)
    t = F.lit("t").alias("tenant_id")
    versions = d.orders.select(t, F.col("o_orderkey").cast("string").alias("version_id"), F.concat(F.lit("g"), "o_custkey").alias("opportunity_id"), F.lit(1).alias("version"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("seq"))
    known = d.customer.where("c_custkey % 2 = 0").select(t, F.concat(F.lit("pg"), "c_custkey").alias("id"), F.concat(F.lit("g"), "c_custkey").alias("graph_opportunity_id"))
    rows = M.version_rows(versions, known)
    return M.write("deal_versions", rows.limit(0).drop("seq"), rows, F.col("seq")).select("id", "opportunity_id", "version_number", "name")


@query(f"SELECT 't' AS tenant_id, o_orderkey::VARCHAR AS action_item_id, e.t AS entity_type, e.id AS entity_id FROM orders, (VALUES ('account'), ('interaction'), ('contact')) v(t), LATERAL (SELECT v.t, CASE v.t WHEN 'account' THEN 'a' || o_custkey WHEN 'interaction' THEN '{ID}' || lpad(o_orderkey::VARCHAR, 12, '0') WHEN 'contact' THEN CASE WHEN o_orderkey % 2 = 0 THEN '{ID}' || lpad(o_custkey::VARCHAR, 12, '0') END END AS id) e WHERE e.id IS NOT NULL")
def w23_w26_links(spark, sf):
    o, t = Data(spark, sf).orders, F.lit("t").alias("tenant_id")
    made = lambda c: F.concat(F.lit(ID), F.lpad(F.col(c).cast("string"), 12, "0"))
    items = o.select(t, F.col("o_orderkey").cast("string").alias("action_item_id"), F.concat(F.lit("a"), "o_custkey").alias("account_id"), made("o_orderkey").alias("source_interaction_id"))
    contacts = o.select(t, F.col("o_orderkey").cast("string").alias("action_item_id"), F.when(F.col("o_orderkey") % 2 == 0, made("o_custkey")).otherwise("nobody").alias("contact_id"))
    rows = M.link_rows(items, contacts)
    return M.write("action_item_links", rows.where("entity_type = 'account'"), rows)


# the composite pipelines

DEAL_EVENTS = """
o AS (SELECT 'a' || o_custkey AS a, o_orderpriority AS n, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey::VARCHAR) AS seq,
 CASE o_orderstatus WHEN 'O' THEN 'proposal' WHEN 'F' THEN 'closed_won' END AS stage, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount,
 CASE WHEN o_orderkey % 2 = 0 THEN 'clerk' || o_orderkey WHEN o_orderkey % 5 = 0 THEN '' END AS metrics, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS given, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 3)::INT END AS fit FROM orders),
base AS (SELECT 'a' || c_custkey AS a, '1-URGENT' AS n, 0 AS k, 0 AS seq, 'qualification' AS stage, 1.0::DOUBLE AS amount, 'm0' AS metrics, 0 AS given, NULL::INT AS fit FROM customer WHERE c_custkey % 10 = 0),
e AS (SELECT * FROM o UNION ALL SELECT * FROM base),
w AS (SELECT *, last_value(metrics IGNORE NULLS) OVER (PARTITION BY a, n ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY a, n ORDER BY seq) AS step FROM e)"""


@query(f"WITH {DEAL_EVENTS} SELECT a AS account_id, n AS name, CASE WHEN arg_max(stage, seq) IS NULL THEN 'prospecting' ELSE arg_max(stage, seq) END AS stage, arg_max(amount, seq) AS amount, arg_max(metrics, seq) AS metrics, CASE WHEN max(seq) = 0 THEN 0.5 ELSE arg_max((coalesce(metrics <> '', false) OR coalesce(before <> '', false))::INT, seq) / 6.0 END::DOUBLE AS filled, CASE WHEN max(seq) = 0 THEN 0.0 WHEN count(*) = 1 THEN max(given) * count(fit) ELSE (count(fit) > 0)::INT / 15.0 END::DOUBLE AS scored, arg_max(fit, seq) AS fit, count(*) AS version, string_agg(CASE WHEN seq > 0 AND step = 1 THEN 'made' WHEN seq > 0 THEN 'merged' END, ',' ORDER BY seq) AS routes FROM w GROUP BY 1, 2")
def c2_deal_pipeline(spark, sf):
    d = Data(spark, sf)
    k, n = F.col("o_orderkey"), F.col("o_orderpriority")
    hot = lambda name: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (F.substring(name, 1, 1).cast("int") == i).cast("float"))
    kind = "struct<score:int,confidence:double,evidence:string>"
    none = lambda c: F.lit(None).cast(c)
    scores = F.when(k % 2 == 0, F.create_map(F.lit("technical_fit"), F.struct(F.when(k % 4 == 0, (k % 3).cast("int")).alias("score"), F.lit(0.5).alias("confidence"), none("string").alias("evidence"))))
    values = {"tenant_id": F.lit("t"), "account_id": F.concat(F.lit("a"), "o_custkey"), "interaction_id": F.concat(F.lit("i"), k), "deal_idx": F.lit(0), "timestamp": F.col("o_orderdate").cast("timestamp"), "name": n, "opportunity_summary": F.concat(F.lit("deal "), k), "stage": F.when(F.col("o_orderstatus") == "O", "proposal").when(F.col("o_orderstatus") == "F", "closed_won").otherwise("bogus"), "amount": F.when(k % 3 != 0, F.col("o_totalprice")), "confidence": F.lit(0.8), "metrics": F.when(k % 2 == 0, F.concat(F.lit("clerk"), k)).when(k % 5 == 0, ""), "dimensions": scores.cast(f"map<string,{kind}>"), "embedding": hot(n)}
    extracted = d.orders.select(*[values.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in S.struct(D.EXTRACTED)])
    stored = {"tenant_id": F.lit("t"), "opportunity_id": F.concat(F.lit("old"), "c_custkey"), "account_id": F.concat(F.lit("a"), "c_custkey"), "name": F.lit("1-URGENT"), "stage": F.lit("qualification"), "amount": F.lit(1.0), "meddic_metrics": F.lit("m0"), "meddic_completeness": F.lit(0.5), "ontology_completeness": F.lit(0.0), "version": F.lit(1), "embedding": hot(F.lit("1"))}
    state = d.customer.where("c_custkey % 10 = 0").select(*[stored.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in S.struct(S.TABLES["deal"])])
    nothing = spark.createDataFrame([], "query_id string, vec_id string, same boolean, confidence double, route string")
    out = D.run_deals(extracted, state, spark.createDataFrame([], S.struct(S.TABLES["deal_version"])), nothing, "2024-01-01")
    routes = out.routed.groupBy("opportunity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "match_type"))), lambda x: F.when(x["match_type"] == "create_new", "made").otherwise("merged")), ",").alias("routes"))
    return out.deals.join(routes, "opportunity_id", "left").select("account_id", "name", "stage", "amount", F.col("meddic_metrics").alias("metrics"), F.col("meddic_completeness").alias("filled"), F.col("ontology_completeness").alias("scored"), F.col("dim_technical_fit").alias("fit"), "version", "routes")


@query(f"WITH {DEAL_EVENTS}, last AS (SELECT a, n, max(seq) > 0 AS touched, coalesce(arg_max(stage, seq), 'prospecting') AS stage, arg_max(amount, seq) AS amount FROM w GROUP BY 1, 2) SELECT a || ' ' || n AS graph_opportunity_id, CASE WHEN hash_old THEN 'closed_won' ELSE 'open' END AS deal_status, CASE WHEN touched OR NOT hash_old THEN stage END AS stage, CASE WHEN touched OR NOT hash_old THEN amount END AS amount, CASE WHEN hash_old THEN 'kept' ELSE n END AS opportunity_name, 'USD' AS currency FROM (SELECT *, n = '5-LOW' AS hash_old FROM last)")
def w19_w24_deal_mirror(spark, sf):
    deals = Stages(spark, "deal-mirror")("deals", c2_deal_pipeline(spark, sf))  # read by both sides of the write
    typed = {"opportunity_id": F.concat_ws(" ", "account_id", "name"), "tenant_id": F.lit("t"), "account_id": F.col("account_id"), "name": F.col("name"), "stage": F.col("stage"), "amount": F.col("amount"), "meddic_metrics": F.col("metrics"), "version": F.col("version")}
    rows = M.deal_rows(deals.select(*[typed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(S.TABLES["deal"])]))
    # what users closed stays closed; stage and amount are overwritten, with nulls too
    old = rows.where("opportunity_name = '5-LOW'").withColumns({"deal_status": F.lit("closed_won"), "stage": F.lit("older"), "amount": F.lit(-1.0), "opportunity_name": F.lit("kept")})
    return M.write("opportunities", old, rows).select("graph_opportunity_id", "deal_status", "stage", "amount", "opportunity_name", "currency")


@query(f"WITH {ITEMS}, y AS (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY item_id, impact, urgency, specificity, status) AS line FROM items), x AS (SELECT * FROM y WHERE status <> 'completed') SELECT interaction_id::VARCHAR AS account_id, line, CASE WHEN line <= 2 AND interaction_id % 3 = 0 THEN CASE WHEN impact > 3 THEN CASE WHEN status = 'open' THEN 'open' ELSE status END ELSE 'open' END ELSE CASE WHEN impact > 3 AND status <> 'open' THEN status ELSE 'open' END END AS status, CASE WHEN line <= 2 AND interaction_id % 3 = 0 THEN CASE WHEN impact > 3 THEN 'stored' ELSE 'seen ' || item_id END ELSE 'seen ' || item_id END AS summary, CASE WHEN line <= 2 AND interaction_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM x UNION ALL SELECT o_orderkey::VARCHAR, v.line, 'open', 'stored', 1 FROM orders, (VALUES (1), (2)) v(line) WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM x WHERE x.interaction_id = o_orderkey AND x.line = v.line)")
def c1_c6_item_pipeline(spark, sf):
    d = Data(spark, sf)
    hot = lambda line: F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: (line == i).cast("float"))
    items = G.ranked(d.items(False), [F.asc(c) for c in ("item_id", "impact", "urgency", "specificity", "status")], ["interaction_id"], "line")
    t, account = F.lit("t").alias("tenant_id"), F.col("interaction_id").cast("string").alias("account_id")
    extracted = items.select(t, account, F.col("interaction_id").cast("string").alias("interaction_id"), F.col("line").alias("item_idx"), F.col("item_id").alias("action_item_text"), F.concat(F.lit("seen "), "item_id").alias("summary"), F.lit("me").alias("owner"), (F.col("impact") > 3).alias("is_status_update"), F.col("status").alias("implied_status"), "confidence", F.col("impact").alias("score_impact"), F.col("urgency").alias("score_urgency"), F.col("specificity").alias("score_specificity"), hot(F.col("line")).alias("embedding"))
    verdicts = items.where("status = 'completed'").select(t, F.col("interaction_id").cast("string").alias("interaction_id"), F.col("line").alias("item_idx"), F.lit(False).alias("actionable"), F.lit(0.9).alias("adjusted"), F.lit(0).alias("pos"))
    line = F.explode(F.array(F.lit(1), F.lit(2))).alias("line")
    stored = {"tenant_id": F.lit("t"), "account_id": F.col("o_orderkey").cast("string"), "action_item_id": F.concat_ws("-", F.lit("old"), "o_orderkey", "line"), "summary": F.lit("stored"), "status": F.lit("open"), "version": F.lit(1), "embedding": hot(F.col("line"))}
    state = d.orders.where("o_orderkey % 3 = 0").select("o_orderkey", line).select(*[stored.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(S.TABLES["action_item"])])
    owners = extracted.limit(0).select("tenant_id", "account_id", F.col("owner").alias("canonical_name"), F.array("owner").alias("aliases"))
    nothing = spark.createDataFrame([], "query_id string, vec_id string, same boolean, confidence double, route string")
    out = run_items(extracted, verdicts, owners, state, spark.createDataFrame([], S.struct(S.TABLES["action_item_version"])), nothing, "2024-01-01")
    at = F.array_position("embedding", F.lit(1.0).cast("float"))
    return out.items.select("account_id", at.alias("line"), "status", "summary", "version")
