"""Every relational, graph and ML operator as a query over the test tables, with SQL of the same rows where SQL can say it.

Merchants are suppliers, cards are orders, and a card's transitions run over its line items; accounts of the transfer graph are
customers and suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.functions import scalars as S
from ledgermesh.graph import core as G
from ledgermesh.graph.labels import propagate_labels
from ledgermesh.graph.pagerank import delta_pagerank, modified_pagerank, static_pagerank
from ledgermesh.graph.scc import strong_components
from ledgermesh.graph.search import k_hop, on_short_cycle, short_cycle_texts
from ledgermesh.ml import evidence as E
from ledgermesh.ml import features as M
from ledgermesh.ml.isolation_forest import fit_forest
from ledgermesh.operators import relational as R
from ledgermesh.plans import flows
from ledgermesh.session import cut, tasks_for

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return note


def queries() -> dict[str, Query]:
    from ledgermesh.plans import scale_queries, source_queries  # noqa: F401  they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shapes of the test tables

SUPPLIER = 1_000_000_000  # added to supplier numbers where customers are vertices too
LAG_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

TRANSITIONS_SQL = """
tr AS (SELECT l_orderkey AS card, l_suppkey AS mchnt, lag(l_suppkey) OVER w AS last_mchnt,
              CAST(abs(date_diff('day', lag(l_shipdate) OVER w, l_shipdate)) AS DOUBLE) AS time_diff
       FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)),
trans AS (SELECT * FROM tr WHERE last_mchnt IS NOT NULL),
stats AS (SELECT last_mchnt AS src, mchnt AS dst, count(*) AS n, count(DISTINCT card) AS cards, sum(time_diff) AS total FROM trans GROUP BY ALL)"""

WEIGHTS_SQL = TRANSITIONS_SQL + """,
timed AS (SELECT src, dst, n, cards, CASE WHEN total <> 0 THEN n / total ELSE 10.0 END AS t FROM stats),
ends AS (SELECT max(n) AS hn, min(cards) AS lc, max(cards) AS hc, min(t) AS lt, max(t) AS ht FROM timed),
norms AS (SELECT src, dst, (n - 1) / nullif(CAST(hn - 1 AS DOUBLE), 0) AS n1, (cards - lc) / nullif(CAST(hc - lc AS DOUBLE), 0) AS n2, (t - lt) / nullif(ht - lt, 0) AS n3 FROM timed, ends),
weighted AS (SELECT src, dst, n1, coalesce(n1 + n2 + n3, 'NaN'::DOUBLE) AS weight FROM norms WHERE n1 > 0)"""

EDGES_SQL = TRANSITIONS_SQL + """,
edges AS (SELECT src, dst FROM stats)"""

TRANSFERS_SQL = """
tf AS (SELECT 'C' || o_custkey AS srccard, 'S' || l_suppkey AS dstcard, l_extendedprice AS money, o_custkey, l_suppkey, strftime(o_orderdate, '%Y%m%d') AS day, o_orderstatus AS kind
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""

#: Labels are handed on in so many rounds by the SQL; the graph of transfers is far less wide.
LABEL_ROUNDS = 12
COMPONENTS_SQL = TRANSFERS_SQL + f""",
links AS MATERIALIZED (SELECT DISTINCT o_custkey AS a, {SUPPLIER} + l_suppkey AS b FROM tf),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS low FROM ways)""" + "".join(f""",
r{i} AS MATERIALIZED (SELECT r.id, least(r.low, m.low) AS low FROM r{i - 1} r JOIN (SELECT w.b AS id, min(x.low) AS low FROM ways w JOIN r{i - 1} x ON x.id = w.a GROUP BY w.b) m USING (id))""" for i in range(1, LABEL_ROUNDS + 1)) + f""",
comp AS (SELECT id, low AS component FROM r{LABEL_ROUNDS})"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.transitions_by_lag(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate")), LAG_ORDER)
    return rows.withColumn("time_diff", F.abs("time_diff"))


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transition_stats(transitions(spark, sf_dir)).select("src", "dst")


def card_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of each transition: the edges of all_edges, as often as they come, for operators that make them one themselves."""
    return transitions(spark, sf_dir).select(F.col("last_mchnt").alias("src"), F.col("mchnt").alias("dst"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with its order; a task joins about a million of them, where shuffles alone would give it more."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, items.count())
    if tasks:
        orders, items = orders.repartition(tasks, "o_orderkey"), items.repartition(tasks, "l_orderkey")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("srccard"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dstcard"),
        F.col("l_extendedprice").alias("money"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
        F.col("o_orderstatus").alias("kind"),
        "o_custkey",
        "l_suppkey",
    )


def transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers(spark, sf_dir).select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst")).distinct()


# ---------------------------------------------------------------- projections, filters, functions


@query("SELECT c_custkey, c_name, c_acctbal + 1 AS more, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def scan_project_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 5000 and c_mktsegment == 'BUILDING'")
    return rows.selectExpr("c_custkey", "c_name", "c_acctbal + 1 as more", "cast(c_acctbal as bigint) as whole")


@query("WITH" + TRANSFERS_SQL + " SELECT srccard, dstcard, money FROM tf WHERE day BETWEEN '19950701' AND '19950702' AND kind = 'F'")
def sql_range_filter(spark, sf_dir):
    transfers(spark, sf_dir).createOrReplaceTempView("transfers")
    return spark.sql("SELECT srccard, dstcard, money FROM transfers WHERE day >= '19950701' AND day <= '19950702' AND kind = 'F'")


@query("SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 131 + c) & 137438953471) AS h FROM customer")
def hash_bkdr(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.bkdr_hash("c_name").alias("h"))


_HEX = "('0x' || substr(md5(c_name), {}, 8))::BIGINT::HUGEINT"
_MOD = "1000000000000000::HUGEINT"
_HORNER = f"(((({_HEX.format(1)} * 4294967296 + {_HEX.format(9)}) % {_MOD}) * 4294967296 + {_HEX.format(17)}) % {_MOD} * 4294967296 + {_HEX.format(25)}) % {_MOD}"


@query(f"SELECT c_custkey, CAST(CASE WHEN substr(md5(c_name), 1, 1) >= '8' THEN ({(1 << 128) % 10**15 + 10**15}::HUGEINT - {_HORNER}) % {_MOD} ELSE {_HORNER} END AS BIGINT) AS h FROM customer")
def hash_md5_long(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.md5_long("c_name").alias("h"))


@query("SELECT o_orderkey, 768053806484449::BIGINT AS h FROM orders")
def hash_hmac(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.hmac_long("o_orderstatus").alias("h"))


@query("SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS d FROM orders")
def day_of_week(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.day_of_week(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"))


# a day beyond its month rolls over: 29 February without a year is 1 March
_AT = "(TIMESTAMP '1970-01-01' + to_months(CAST(month({0}) - 1 AS INTEGER)) + to_days(CAST(day({0}) - 1 AS INTEGER)) + (CAST({0} AS TIMESTAMP) - date_trunc('day', CAST({0} AS TIMESTAMP))))"


@query(f"SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(date_diff('second', {_AT.format('o_orderdate')}, {_AT.format('l_shipdate')}) / 3600.0, -1) AS hours FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def delta_time(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    hours = S.delta_time(F.date_format("o_orderdate", "MMddHHmmss"), F.date_format("l_shipdate", "MMddHHmmss"), "hours")
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.nanvl(hours, F.lit(-1.0)).alias("hours"))


_CODE = "CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '0') ELSE CAST(o_custkey AS VARCHAR) END"


@query(f"WITH c AS (SELECT o_orderkey, {_CODE} AS code FROM orders) SELECT o_orderkey, CASE WHEN length(code) = 8 THEN code[1:4] ELSE code END AS bank, CASE WHEN length(code) = 8 THEN code[5:8] ELSE code END AS region FROM c")
def bk_rg_split(spark, sf_dir):
    text = F.col("o_custkey").cast("string")
    code = F.when(F.col("o_orderkey") % 2 == 0, F.lpad(text, 8, "0")).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).select("o_orderkey", S.bank_code("code").alias("bank"), S.region_code("code").alias("region"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '3%' THEN 'NANs' ELSE o_orderpriority END AS filled FROM orders")
def fill_empty(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.startswith("o_orderpriority", F.lit("3")), "").otherwise(F.col("o_orderpriority")).alias("p"))
    return rows.select("o_orderkey", S.fill_empty("p").alias("filled"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '2016-06-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS number, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def date_num(spark, sf_dir):
    number = S.day_number(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"), S.day_of_number(number).alias("day"))


@query("SELECT p_partkey, CASE WHEN p_size IN (4, 11, 17) THEN 'high' WHEN p_size IN (3, 9) THEN 'low' ELSE 'normal' END AS risk, p_brand IN ('Brand#11', 'Brand#22') AS listed, lpad(CAST(p_size AS VARCHAR), 2, '0') IN ('39', '40', '41', '42', '43', '44', '64') AS place FROM part")
def risk_flags(spark, sf_dir):
    code = F.when(F.col("p_size").isin(4, 11, 17), "5732").when(F.col("p_size").isin(3, 9), "4111").otherwise(F.lpad(F.col("p_size").cast("string"), 4, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", S.category_risk(code).alias("risk"), S.listed("p_brand", ["Brand#11", "Brand#22"]).alias("listed"), S.high_risk_location(F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("place"))


# ---------------------------------------------------------------- aggregates, joins, order


@query("WITH" + TRANSFERS_SQL + " SELECT srccard, dstcard, round(sum(money), 2) AS money FROM tf GROUP BY ALL")
def transfer_agg(spark, sf_dir):
    return R.transfer_sums(transfers(spark, sf_dir)).withColumn("money", F.round("money", 2))


@query("WITH" + TRANSFERS_SQL + " SELECT DISTINCT account FROM (SELECT srccard AS account FROM tf UNION ALL SELECT dstcard FROM tf)")
def vertex_union_distinct(spark, sf_dir):
    return R.account_vertices(transfers(spark, sf_dir)).select("account")


@query("WITH" + TRANSFERS_SQL + " SELECT count(DISTINCT account) AS accounts FROM (SELECT srccard AS account FROM tf UNION ALL SELECT dstcard FROM tf)")
def transfer_vertex_count(spark, sf_dir):
    return R.account_vertices(R.transfer_sums(transfers(spark, sf_dir))).agg(F.count("*").alias("accounts"))


@query("WITH" + TRANSITIONS_SQL + " SELECT src, dst, n, cards, total FROM stats")
def transition_stats(spark, sf_dir):
    return R.transition_stats(transitions(spark, sf_dir))


@query("WITH" + WEIGHTS_SQL + " SELECT src, dst, round(weight, 9) AS weight FROM weighted")
def minmax_weight(spark, sf_dir):
    return R.min_max_weights(R.transition_stats(transitions(spark, sf_dir))).withColumn("weight", F.round("weight", 9))


@query("WITH" + WEIGHTS_SQL + " SELECT src, dst, round(n1, 9) AS weight FROM weighted")
def count_weight(spark, sf_dir):
    return R.min_max_weights(R.transition_stats(transitions(spark, sf_dir)), ("n",)).withColumn("weight", F.round("weight", 9))


@query("WITH" + WEIGHTS_SQL + " SELECT CAST(src AS VARCHAR) || ',' || CAST(round(weight * 1000) AS BIGINT) || ',' || CAST(dst AS VARCHAR) AS line FROM weighted")
def edge_export(spark, sf_dir):
    rows = R.min_max_weights(R.transition_stats(transitions(spark, sf_dir)))
    return rows.select(S.joined_row("src", F.round(F.col("weight") * 1000).cast("long"), "dst").alias("line"))


_Z = TRANSITIONS_SQL + """,
g AS (SELECT src, dst, CAST(n AS DOUBLE) AS n, CAST(cards AS DOUBLE) AS c, total / n AS t FROM stats),
f AS (SELECT avg(n) AS mn, stddev_samp(n) AS sn, avg(c) AS mc, stddev_samp(c) AS sc, avg(t) AS mt, stddev_samp(t) AS st FROM g)"""


@query("WITH" + _Z + " SELECT src, dst, round((n - mn) / sn + (c - mc) / sc + (t - mt) / st, 7) AS weight FROM g, f")
def zscore_weight(spark, sf_dir):
    return R.z_score_weights(R.transition_stats(transitions(spark, sf_dir))).withColumn("weight", F.round("weight", 7))


@query("WITH" + _Z + " SELECT src, dst, round((n - mn) / sn + (t - mt) / st + (c - mt) / st, 7) AS weight FROM g, f")
def zscore_weight_literal(spark, sf_dir):
    return R.z_score_weights(R.transition_stats(transitions(spark, sf_dir)), literal=True).withColumn("weight", F.round("weight", 7))


@query("WITH" + TRANSITIONS_SQL + " SELECT src, dst, n, cards, round(total / n, 9) AS mean_gap FROM stats WHERE n > 2")
def grouped_edges(spark, sf_dir):
    return R.grouped_edges(transitions(spark, sf_dir)).withColumn("mean_gap", F.round("mean_gap", 9))


@query("SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def column_extremes(spark, sf_dir):
    return R.column_extremes(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("SELECT round(avg(l_quantity), 8) AS mean_l_quantity, round(var_samp(l_quantity), 6) AS var_l_quantity FROM lineitem")
def column_statistics(spark, sf_dir):
    rows = R.column_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    return rows.select(F.round("mean_l_quantity", 8).alias("mean_l_quantity"), F.round("var_l_quantity", 6).alias("var_l_quantity"))


_FRAUD_SQL = "fraud AS (SELECT o_orderkey AS trace, o_custkey AS card, CASE WHEN o_orderpriority = '1-URGENT' THEN '04' ELSE '01' END AS tp FROM orders WHERE o_orderstatus = 'F')"


def _frauds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orders.select(F.col("o_orderkey").alias("trace"), F.col("o_custkey").alias("card"), F.when(F.col("o_orderpriority") == "1-URGENT", "04").otherwise("01").alias("fraud_tp"))


@query("WITH " + _FRAUD_SQL + ", own AS (SELECT * FROM fraud WHERE tp = '04') SELECT o_custkey AS card, l_orderkey AS trace, l_linenumber, l_partkey, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT card FROM own) AND l_orderkey IN (SELECT trace FROM own)")
def left_semi_fraud(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("card"), F.col("l_orderkey").alias("trace"), "l_linenumber", "l_partkey", "l_extendedprice")
    return R.fraud_transactions(_frauds(spark, sf_dir), rows, "04", "card", "trace")


@query("WITH " + _FRAUD_SQL + " SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT card FROM fraud WHERE tp = '04')")
def isin_cards(spark, sf_dir):
    cards = _frauds(spark, sf_dir).filter("fraud_tp = '04'")
    return R.members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", cards, "card")


_REVENUE_SQL = "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY ALL ORDER BY revenue {}, l_suppkey LIMIT 50"


def _revenue(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query(_REVENUE_SQL.format("DESC"))
def topk_desc(spark, sf_dir):
    return _revenue(spark, sf_dir).orderBy(F.desc("revenue"), "l_suppkey").limit(50)


@query(_REVENUE_SQL.format("ASC"))
def topk_asc(spark, sf_dir):
    return _revenue(spark, sf_dir).orderBy("revenue", "l_suppkey").limit(50)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) GROUP BY ALL")
def word_count(spark, sf_dir):
    return R.word_count(table(spark, sf_dir, "documents"), "text")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def union_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").unionByName(orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"))


# ---------------------------------------------------------------- graphs


@query("WITH" + EDGES_SQL + " SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY ALL")
def degrees(spark, sf_dir):
    return G.degrees(all_edges(spark, sf_dir))


@query("WITH" + EDGES_SQL + " SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY ALL")
def out_degrees(spark, sf_dir):
    return G.out_degrees(all_edges(spark, sf_dir))


_DEG = """,
deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY ALL),
kept AS (SELECT src, dst FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE a.d + b.d > 2)"""


@query("WITH" + EDGES_SQL + _DEG + " SELECT id, count(*) AS degree FROM (SELECT src AS id FROM kept UNION ALL SELECT dst FROM kept) GROUP BY ALL")
def core_prune(spark, sf_dir):
    return G.core(all_edges(spark, sf_dir))[0]


@query("WITH" + WEIGHTS_SQL + " SELECT src AS id, round(sum(weight), 7) AS out_weight FROM weighted GROUP BY ALL")
def out_weight_sums(spark, sf_dir):
    return G.out_weights(R.min_max_weights(R.transition_stats(transitions(spark, sf_dir)))).withColumn("out_weight", F.round("out_weight", 7))


@query("WITH" + TRANSITIONS_SQL + " SELECT last_mchnt AS src, mchnt AS dst, count(*) AS n, sum(time_diff) AS gap FROM trans GROUP BY ALL")
def merge_parallel_edges(spark, sf_dir):
    return G.merge_parallel(transitions(spark, sf_dir).select(F.col("last_mchnt").alias("src"), F.col("mchnt").alias("dst"), "time_diff"), gap="time_diff")


@query("WITH" + EDGES_SQL + " SELECT src, dst, a.s_nationkey AS src_s_nationkey, b.s_nationkey AS dst_s_nationkey FROM edges JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_acctbal > 0 AND b.s_acctbal > 0 AND a.s_nationkey <> b.s_nationkey")
def subgraph_triplets(spark, sf_dir):
    vertices = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id")
    vertices, edges = G.subgraph(vertices, all_edges(spark, sf_dir), F.col("s_acctbal") > 0)
    return G.triplets(vertices, edges, "s_nationkey").filter("src_s_nationkey <> dst_s_nationkey").select("src", "dst", "src_s_nationkey", "dst_s_nationkey")


@query("WITH" + COMPONENTS_SQL + " SELECT id, component FROM comp")
def connected_components(spark, sf_dir):
    edges = cut(transfer_edges(spark, sf_dir))
    return flows.connected_components(G.vertices_of(edges), edges)


@query("WITH" + COMPONENTS_SQL + " SELECT id, component, size FROM comp JOIN (SELECT component, count(*) AS size FROM comp GROUP BY ALL) USING (component)")
def left_outer_sizes(spark, sf_dir):
    edges = cut(transfer_edges(spark, sf_dir))
    return flows.component_sizes(G.vertices_of(edges), edges)


@query("WITH RECURSIVE" + EDGES_SQL + """,
reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b),
vertex AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT id, coalesce((SELECT min(r.b) FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a = id), id) AS component FROM vertex""")
def scc(spark, sf_dir):
    return strong_components(all_edges(spark, sf_dir), 10)


@query("WITH" + EDGES_SQL + """,
b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT min(a) AS id FROM b),
one AS (SELECT DISTINCT b.b AS id FROM b JOIN s ON b.a = s.id), two AS (SELECT DISTINCT b.b AS id FROM b JOIN one ON b.a = one.id)
SELECT id, CAST(max(v) AS INTEGER) AS "left" FROM (SELECT id, 2 AS v FROM s UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 0 FROM two) WHERE id IS NOT NULL GROUP BY id""")
def khop(spark, sf_dir):
    edges = cut(all_edges(spark, sf_dir))
    first = G.ends(edges).agg(F.min("id").alias("id")).first()["id"]
    return k_hop(edges, -1 if first is None else first, 2)


@query("WITH" + EDGES_SQL + """,
e AS (SELECT DISTINCT src, dst FROM edges),
w2 AS (SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src), w3 AS (SELECT DISTINCT x.src, y.dst FROM w2 x JOIN e y ON x.dst = y.src),
p AS (SELECT src, dst FROM e UNION SELECT src, dst FROM w2 UNION SELECT src, dst FROM w3)
SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS ancestors FROM p WHERE dst IN (SELECT src FROM p WHERE src = dst) GROUP BY dst""")
def cycles_le3(spark, sf_dir):
    return short_cycle_texts(card_edges(spark, sf_dir), 3)


@query("WITH" + EDGES_SQL + """,
e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), w2 AS (SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src)
SELECT src AS id FROM e WHERE src = dst UNION SELECT src FROM w2 WHERE src = dst UNION SELECT x.src FROM w2 x JOIN e y ON x.dst = y.src AND x.src = y.dst""")
def cycle_members_le3(spark, sf_dir):
    """Vertices on a directed cycle of three edges or fewer, without their ancestors."""
    return on_short_cycle(card_edges(spark, sf_dir), 3)


def _rank_sql(edges: str, factor: str, start: str, what: str, send: str, pr: str, delta: str, rounds: int) -> str:
    """The rounds of a PageRank variant, written out. edges: a CTE with src, dst, weight."""
    out = f"""WITH {edges},
vertex AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), total AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS nv FROM vertex),
f AS MATERIALIZED (SELECT src, dst, {factor} AS f FROM e),
v0 AS MATERIALIZED (SELECT id, {start} AS pr, {start} AS delta, true AS act FROM vertex, total)"""
    for i in range(1, rounds + 1):
        out += f""",
m{i} AS MATERIALIZED (SELECT f.dst AS id, sum(v.{what} * f.f) AS m FROM f JOIN v{i - 1} v ON v.id = f.src WHERE v.act AND {send} GROUP BY f.dst),
v{i} AS MATERIALIZED (SELECT v.id, CASE WHEN x.id IS NULL THEN v.pr ELSE {pr} END AS pr, CASE WHEN x.id IS NULL THEN v.delta ELSE {delta} END AS delta, x.id IS NOT NULL AS act
       FROM v{i - 1} v LEFT JOIN m{i} x ON x.id = v.id CROSS JOIN total)"""
    return out + f"\nSELECT id, round(pr, 6) AS rank FROM v{rounds}"


def _rank_to_end_sql(edges: str, factor: str, start: str, what: str, send: str, pr: str, delta: str, rounds: int) -> str:
    """The rounds of a PageRank variant as steps of a recursion, which ends with the messages or after so many."""
    return f"""WITH RECURSIVE {edges},
vertex AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), total AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS nv FROM vertex),
f AS MATERIALIZED (SELECT src, dst, CAST({factor} AS DOUBLE) AS f FROM e),
v(i, id, pr, delta, act) AS (SELECT 0, id, CAST({start} AS DOUBLE), CAST({start} AS DOUBLE), true FROM vertex, total UNION ALL SELECT * FROM (
 WITH x AS MATERIALIZED (SELECT f.dst AS id, sum(v.{what} * f.f) AS m FROM f JOIN v ON v.id = f.src WHERE v.act AND {send} AND v.i < {rounds} GROUP BY f.dst)
 SELECT v.i + 1, v.id, CASE WHEN x.id IS NULL THEN v.pr ELSE {pr} END, CASE WHEN x.id IS NULL THEN v.delta ELSE {delta} END, x.id IS NOT NULL
 FROM v LEFT JOIN x ON x.id = v.id CROSS JOIN total WHERE EXISTS (SELECT 1 FROM x)))
SELECT id, round(pr, 6) AS rank FROM v WHERE i = (SELECT max(i) FROM v)"""


_E = WEIGHTS_SQL + ",\ne AS MATERIALIZED (SELECT src, dst, weight FROM weighted)"
_ONE, _W, _SHARE = "1.0 / count(*) OVER (PARTITION BY src)", "weight / count(*) OVER (PARTITION BY src)", "weight / sum(weight) OVER (PARTITION BY src)"
_NEW = "(0.15 / nv + 0.85 * x.m)"


def _weighted(spark, sf_dir):
    return R.min_max_weights(R.transition_stats(transitions(spark, sf_dir)))


def _six(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query(_rank_sql(_E, _ONE, "0.15", "pr", "true", "0.15 + 0.85 * x.m", "v.delta", 3))
def pagerank_static(spark, sf_dir):
    return _six(static_pagerank(_weighted(spark, sf_dir), 3))


@query(_rank_sql(_E, _ONE, "0.15", "delta", "v.delta > 0.001", "v.pr + 0.85 * x.m", "0.85 * x.m", 4))
def pagerank_delta(spark, sf_dir):
    return _six(delta_pagerank(_weighted(spark, sf_dir), 0.001, 4))


@query(_rank_sql(_E, _W, "0.15", "delta", "v.delta > 0.001", "v.pr + 0.85 * x.m", "0.85 * x.m", 4))
def pagerank_delta_weighted(spark, sf_dir):
    return _six(delta_pagerank(_weighted(spark, sf_dir), 0.001, 4, weighted=True))


@query(_rank_to_end_sql(_E, _ONE, "0.15", "delta", "v.delta > 0.001", "v.pr + 0.85 * x.m", "0.85 * x.m", 200))
def pagerank_delta_converged(spark, sf_dir):
    return _six(delta_pagerank(_weighted(spark, sf_dir), 0.001))


@query()  # ranks grow beyond 10 ** 24 in 200 rounds, where sums in another order differ in the last digits
def pagerank_delta_weighted_converged(spark, sf_dir):
    return _six(delta_pagerank(_weighted(spark, sf_dir), 0.001, weighted=True))


@query(_rank_sql(_E, _ONE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 3))
def pagerank_modify(spark, sf_dir):
    return _six(modified_pagerank(_weighted(spark, sf_dir), 0.001, 3))


@query(_rank_sql(_E, _SHARE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 3))
def pagerank_modify_weighted(spark, sf_dir):
    return _six(modified_pagerank(_weighted(spark, sf_dir), 0.001, 3, weighted=True))


@query(_rank_to_end_sql(_E, _ONE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 200))
def pagerank_modify_converged(spark, sf_dir):
    return _six(modified_pagerank(_weighted(spark, sf_dir), 0.001))


@query(_rank_to_end_sql(_E, _SHARE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 200))
def pagerank_modify_weighted_converged(spark, sf_dir):
    return _six(modified_pagerank(_weighted(spark, sf_dir), 0.001, weighted=True))


@query(_rank_sql(_E, _SHARE, "0.15 / nv + 0.15", "pr", "true", "0.15 / nv + 0.85 * coalesce(x.m, 0)", "v.delta", 3).replace("x.id IS NULL THEN v.pr", "false THEN v.pr").replace("x.id IS NOT NULL AS act", "true AS act"))
def pagerank_modify_standard(spark, sf_dir):
    return _six(modified_pagerank(_weighted(spark, sf_dir), 0.001, 3, weighted=True, standard=True))


def _label_sql(rounds: int, send: str) -> str:
    out = f"""WITH {EDGES_SQL},
b AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
v0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label, 0::BIGINT AS last, 0::BIGINT AS last2, true AS act FROM b)"""
    for i in range(1, rounds + 1):
        out += f""",
n{i} AS MATERIALIZED (SELECT b.dst AS id, s.label, count(*) AS n FROM b JOIN v{i - 1} s ON s.id = b.src JOIN v{i - 1} o ON o.id = b.dst WHERE (s.act OR o.act) AND {send} GROUP BY ALL),
m{i} AS MATERIALIZED (SELECT id, label AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM n{i}) WHERE r = 1),
v{i} AS MATERIALIZED (SELECT v.id, coalesce(x.m, v.label) AS label, CASE WHEN x.id IS NULL THEN v.last ELSE v.label END AS last, CASE WHEN x.id IS NULL THEN v.last2 ELSE v.last END AS last2, x.id IS NOT NULL AS act
       FROM v{i - 1} v LEFT JOIN m{i} x ON x.id = v.id)"""
    return out + f"\nSELECT id, label FROM v{rounds}"


@query(_label_sql(4, "true"))
def lpa_fixed(spark, sf_dir):
    return propagate_labels(all_edges(spark, sf_dir), 4)


@query(_label_sql(4, "s.label <> s.last"))
def lpa_last1(spark, sf_dir):
    return propagate_labels(all_edges(spark, sf_dir), 4, "changed")


@query(_label_sql(4, "s.label <> s.last2"))
def lpa_last2(spark, sf_dir):
    return propagate_labels(all_edges(spark, sf_dir), 4, "changed_twice")


# ---------------------------------------------------------------- evidence and features


@query("""WITH c AS (SELECT l_linenumber AS value, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS bad, sum(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) AS good FROM lineitem GROUP BY ALL)
SELECT value, round(ln((bad / sum(bad) OVER ()) / (good / sum(good) OVER ())), 9) AS woe FROM c""")
def woe_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return E.evidence(rows, "l_linenumber").withColumn("woe", F.round("woe", 9))


@query("""WITH c AS (SELECT l_linenumber AS value, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS bad, sum(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) AS good FROM lineitem GROUP BY ALL),
w AS (SELECT value, ln((bad / sum(bad) OVER ()) / (good / sum(good) OVER ())) AS woe FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(woe, 9) AS "l_linenumber_WOE" FROM lineitem JOIN w ON value = l_linenumber""")
def woe_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return E.encode_evidence(rows, "l_linenumber").drop("label").withColumn("l_linenumber_WOE", F.round("l_linenumber_WOE", 9))


@query("""WITH x AS (SELECT l_returnflag = 'R' AS y, l_discount > 0.05 AS p FROM lineitem),
c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn FROM x)
SELECT tp, tn, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall FROM c""")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label_idx"), (F.col("l_discount") > 0.05).cast("double").alias("prediction"))
    return E.confusion(rows).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", M.vector(F.col("embedding")).alias("features"))


def _slots(frame: DataFrame, column: str, *slots: int) -> DataFrame:
    values = vector_to_array(column)
    return frame.select("vec_id", *(F.round(values[i], 6).alias(f"x{i}") for i in slots))


_V = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(_V + " SELECT vec_id, round(v[1] / list_sum(list_transform(v, lambda x: abs(x))), 6) AS x0, round(v[4] / list_sum(list_transform(v, lambda x: abs(x))), 6) AS x3 FROM e")
def normalizer_l1(spark, sf_dir):
    return _slots(M.normalise(_vectors(spark, sf_dir), 1.0), "normed", 0, 3)


@query(_V + " SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x0, round(v[4] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x3 FROM e")
def normalizer_l2(spark, sf_dir):
    return _slots(M.normalise(_vectors(spark, sf_dir), 2.0), "normed", 0, 3)


@query(_V + " SELECT vec_id, round(v[1] / list_max(list_transform(v, lambda x: abs(x))), 6) AS x0, round(v[4] / list_max(list_transform(v, lambda x: abs(x))), 6) AS x3 FROM e")
def normalizer_linf(spark, sf_dir):
    return _slots(M.normalise(_vectors(spark, sf_dir), float("inf")), "normed", 0, 3)


@query(_V + " SELECT vec_id, round(v[1] / stddev_samp(v[1]) OVER (), 6) AS x0, round(v[4] / stddev_samp(v[4]) OVER (), 6) AS x3 FROM e")
def standard_scaler(spark, sf_dir):
    return _slots(M.standardise(_vectors(spark, sf_dir)), "scaled", 0, 3)


@query(_V + " SELECT vec_id, round((v[1] - min(v[1]) OVER ()) / (max(v[1]) OVER () - min(v[1]) OVER ()), 6) AS x0 FROM e")
def min_max_scaler(spark, sf_dir):
    return _slots(M.min_max_scale(_vectors(spark, sf_dir)), "scaled", 0)


@query(_V + " SELECT vec_id, round(v[1], 6) AS x0, round(v[3], 6) AS x1 FROM e")
def vector_slicer(spark, sf_dir):
    named = M.name_slots(_vectors(spark, sf_dir), "features", [f"f{i}" for i in range(64)])
    return _slots(M.slice_slots(named, "features", "sliced", [0], ["f2"]), "sliced", 0, 1)


@query("""WITH n AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM n)
SELECT o_orderkey, CAST(i AS DOUBLE) AS o_orderpriority_idx FROM orders JOIN c ON v = o_orderpriority""")
def string_indexer(spark, sf_dir):
    return M.index_categories(table(spark, sf_dir, "orders"), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority_idx")


@query()
def kmeans(spark, sf_dir):
    return M.k_means(M.normalise(_vectors(spark, sf_dir)), 2, 1, "normed")[0].select("vec_id", "prediction")


@query()
def random_forest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_quantity") > 25).cast("double").alias("label"))
    return M.random_forest(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])[1].select("l_orderkey", "label", "predictedLabel")


@query()
def isolation_forest(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    return fit_forest(rows, columns).score(rows)


# ---------------------------------------------------------------- the flagship

_CORE = WEIGHTS_SQL + """,
edges AS (SELECT src, dst FROM weighted),
deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY ALL),
e AS MATERIALIZED (SELECT w.src, w.dst, w.weight FROM weighted w JOIN deg a ON a.id = w.src JOIN deg b ON b.id = w.dst WHERE a.d + b.d > 2)"""


@query("SELECT r.id, r.rank, coalesce(s_name, ' ') AS name FROM (" + _rank_sql(_CORE, _SHARE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 3) + ") r LEFT JOIN supplier ON s_suppkey = r.id")
def merchant_ranks(spark, sf_dir):
    """Merchant PageRank on min-max weighted transitions of the pruned graph, with names."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mchnt"), F.col("s_name").alias("name"))
    out = flows.merchant_ranks(transitions(spark, sf_dir), names, rounds=3, hashed=False)
    return out.select("id", F.round("rank", 6).alias("rank"), "name")


@query("SELECT r.id, r.rank FROM (" + _rank_sql(_CORE.replace("w.src, w.dst, w.weight FROM", "w.src, w.dst, w.n1 AS weight FROM"), _SHARE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 3) + ") r")
def merchant_ranks_by_count(spark, sf_dir):
    return _six(flows.merchant_ranks(transitions(spark, sf_dir), None, ("n",), rounds=3, hashed=False))


_DIGEST = f"CAST(CASE WHEN substr(md5(c_name), 1, 1) >= '8' THEN ({(1 << 128) % 10**15 + 10**15}::HUGEINT - {_HORNER}) % {_MOD} ELSE {_HORNER} END AS BIGINT)".replace("c_name", "CAST(r.id AS VARCHAR)")
_RANKS_TO_END = _rank_to_end_sql("{edges}", _SHARE, "0.15 / nv + 0.15", "pr", "v.delta > 0.001", _NEW, f"{_NEW} - v.pr", 1000)


@query("SELECT r.id, r.rank FROM (" + _RANKS_TO_END.format(edges=_CORE.replace("w.src, w.dst, w.weight FROM", "w.src, w.dst, w.n1 AS weight FROM")) + ") r")
def merchant_ranks_by_count_converged(spark, sf_dir):
    return _six(flows.merchant_ranks(transitions(spark, sf_dir), None, ("n",), hashed=False))


@query(f"SELECT {_DIGEST} AS id, r.rank, coalesce(s_name, ' ') AS name FROM (" + _RANKS_TO_END.format(edges=_CORE) + ") r LEFT JOIN supplier ON s_suppkey = r.id")
def merchant_ranks_converged(spark, sf_dir):
    """The flagship as it is run: merchants by their digests' numbers, up to the tolerance, 1,000 rounds at most."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("mchnt"), F.col("s_name").alias("name"))
    rows = transitions(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("mchnt", "last_mchnt")})
    return flows.merchant_ranks(rows, names).select("id", F.round("rank", 6).alias("rank"), "name")


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 131 + c) & 137438953471)"


# Money goes from cards to merchants only, so no vertex reaches itself again and each is a component by itself.
@query("WITH" + TRANSFERS_SQL + """,
sums AS (SELECT DISTINCT srccard, dstcard FROM tf),
deg AS (SELECT id, count(*) AS d FROM (SELECT srccard AS id FROM sums UNION ALL SELECT dstcard FROM sums) GROUP BY ALL),
kept AS (SELECT srccard, dstcard FROM sums JOIN deg a ON a.id = srccard JOIN deg b ON b.id = dstcard WHERE a.d + b.d > 2),
vertex AS (SELECT srccard AS v FROM kept UNION SELECT dstcard FROM kept)
SELECT """ + _HASH.format("v") + " AS id, id AS component FROM vertex")
def transfer_components(spark, sf_dir):
    """Strong components of the pruned graph of transfers, by account hashes."""
    return flows.transfer_strong_components(transfers(spark, sf_dir))


@query("WITH" + EDGES_SQL + _DEG + """,
own AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM kept UNION ALL SELECT dst FROM kept) GROUP BY ALL)
SELECT id, coalesce(degree, 0) AS degree FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) LEFT JOIN own USING (id)""")
def vertex_attributes_with_defaults(spark, sf_dir):
    return flows.graph_with_degrees(all_edges(spark, sf_dir)).withColumn("degree", F.col("degree").cast("long"))


@query("WITH" + EDGES_SQL + " SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS vertices, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark, sf_dir):
    edges = all_edges(spark, sf_dir)
    vertices, n = G.counts(G.vertices_of(edges), edges)  # one row
    return spark.createDataFrame([(vertices, n)], "vertices long, edges long")
