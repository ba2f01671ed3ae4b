"""Queries of what a large table asks for: days as folders, cards with a third of the rows, label rounds to the last, fair samples, whole flows over files."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import scalars as S
from ledgermesh.graph.labels import propagate_labels
from ledgermesh.ml import evidence as E
from ledgermesh.ml.isolation_forest import bounded_samples
from ledgermesh.operators import relational as R
from ledgermesh.operators.ordered import quantiles
from ledgermesh.plans import flows
from ledgermesh.plans.queries import EDGES_SQL, TRANSFERS_SQL, all_edges, query, table, transfers
from ledgermesh.session import checkpoints, dealt, tasks_for
from ledgermesh.sources import loaders as L
from ledgermesh.sources import schema
from ledgermesh.sources import sinks as K


def _place(spark) -> str:
    return f"{checkpoints(spark)}/files-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- tables in folders by day


def _moves(spark, sf_dir) -> DataFrame:
    """All transfers as a catalog table in folders by settlement day, under the raw names."""
    rows = transfers(spark, sf_dir)
    own = {"tfr_in_acct_no": F.col("srccard"), "tfr_out_acct_no": F.col("dstcard"), "fwd_settle_at": F.col("money"), "trans_id": F.col("kind")}
    blank = [F.lit("").alias(c) for c in schema.TRANSFERS if c not in own and c != "hp_settle_dt"]
    name = f"moves_{uuid.uuid4().hex}"
    K.write_days(rows.select(*(c.alias(k) for k, c in own.items()), *blank, F.col("day").alias("hp_settle_dt")), name, "hp_settle_dt", _place(spark))
    return spark.table(name)


@query("WITH" + TRANSFERS_SQL + " SELECT srccard, dstcard, round(sum(money), 2) AS money FROM tf WHERE day BETWEEN '19950301' AND '19950930' AND kind = 'F' GROUP BY ALL")
def table_by_day_range(spark, sf_dir):
    """Transfers of a range of days: only these days' folders are read."""
    return R.transfer_sums(L.transfers(_moves(spark, sf_dir), "19950301", "19950930", "F")).withColumn("money", F.round("money", 2))


_BUSY = "SELECT strftime(o_orderdate, '%Y%m%d') AS day FROM orders GROUP BY ALL HAVING max(o_totalprice) > (SELECT 0.9 * max(o_totalprice) FROM orders)"


@query("WITH" + TRANSFERS_SQL + f" SELECT day, count(*) AS n, round(sum(money), 2) AS money FROM tf WHERE day IN ({_BUSY}) GROUP BY ALL")
def table_by_day_asked(spark, sf_dir):
    """Transfers of the days with a very large order: the days are known when orders have been read, and only then folders are opened."""
    orders = table(spark, sf_dir, "orders")
    most = F.broadcast(orders.agg(F.max("o_totalprice").alias("most")))  # one row
    busy = orders.groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).agg(F.max("o_totalprice").alias("high")).crossJoin(most).filter("high > 0.9 * most")
    rows = L.rows_on_days(_moves(spark, sf_dir), "hp_settle_dt", busy.select("day"))
    return rows.groupBy(F.col("hp_settle_dt").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("fwd_settle_at"), 2).alias("money"))


# ---------------------------------------------------------------- hot cards, many columns


_EVENT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query("""WITH tr AS (SELECT l_returnflag AS card, l_orderkey, l_linenumber, l_suppkey AS mchnt, lag(l_suppkey) OVER w AS last_mchnt, lag(l_shipdate) OVER w AS last_date, l_shipdate
 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))
SELECT card, mchnt, last_mchnt, CAST(date_diff('day', last_date, l_shipdate) AS DOUBLE) AS time_diff FROM tr WHERE last_mchnt IS NOT NULL""")
def hot_card_transitions(spark, sf_dir):
    """Transitions where three cards have all events: each card's events lie over many tasks."""
    return R.transitions_by_lag(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", F.unix_date(F.to_date("l_shipdate")), _EVENT, dense=100)


_FIVE = ["l_linenumber", "l_linestatus", "l_suppkey", "l_tax", "l_discount"]


def _five_sql() -> str:
    ctes, joins, picks = [], [], []
    for i, c in enumerate(_FIVE):
        ctes.append(f"""c{i} AS (SELECT v, CASE WHEN bad = 0 AND good = 0 THEN 'NaN'::DOUBLE WHEN bad = 0 THEN '-inf'::DOUBLE WHEN good = 0 THEN 'inf'::DOUBLE ELSE round(ln((bad / sum(bad) OVER ()) / (good / sum(good) OVER ())), 9) END AS w
 FROM (SELECT {c} AS v, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS bad, sum(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) AS good FROM lineitem GROUP BY ALL))""")
        joins.append(f"JOIN c{i} ON c{i}.v = {c}")
        picks.append(f'c{i}.w AS "{c}_WOE"')
    return f"WITH {', '.join(ctes)} SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(picks)} FROM lineitem {' '.join(joins)}"


@query(_five_sql())
def woe_encode_five(spark, sf_dir):
    """Evidence of five columns, counted in one pass."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *_FIVE, (F.col("l_returnflag") == "R").cast("double").alias("label"))
    out = E.encode_all(rows, _FIVE)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(f"{c}_WOE", 9).alias(f"{c}_WOE") for c in _FIVE))


def _blob(key: bytes, byte: int) -> str:
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in key.ljust(64, b"\0")) + "'::BLOB"


_KEY = b"ledger"


@query(f"SELECT c_custkey, md5({_blob(_KEY, 0x5C)} || unhex(md5({_blob(_KEY, 0x36)} || encode(c_name)))) AS h FROM customer")
def hash_hmac_keyed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.hmac_md5("c_name", _KEY).alias("h"))


# ---------------------------------------------------------------- labels to the last round


def _label_rounds_sql(rounds: int, send: str) -> str:
    """As many rounds as asked; each one is a step of the recursion."""
    return f"""WITH RECURSIVE{EDGES_SQL},
b AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
v(i, id, label, last, last2, act) AS (SELECT 0, id, id, 0::BIGINT, 0::BIGINT, true FROM (SELECT DISTINCT src AS id FROM b) UNION ALL SELECT * FROM (
 WITH n AS (SELECT b.dst AS id, s.label, count(*) AS n FROM b JOIN v s ON s.id = b.src JOIN v o ON o.id = b.dst WHERE (s.act OR o.act) AND {send} GROUP BY ALL),
 m AS (SELECT id, arg_max(label, (n, -label)) AS m FROM n GROUP BY id)
 SELECT v.i + 1, v.id, coalesce(m.m, v.label), CASE WHEN m.id IS NULL THEN v.last ELSE v.label END, CASE WHEN m.id IS NULL THEN v.last2 ELSE v.last END, m.id IS NOT NULL FROM v LEFT JOIN m USING (id) WHERE v.i < {rounds}))
SELECT id, label FROM v WHERE i = {rounds}"""


@query(_label_rounds_sql(200, "true"))
def lpa_fixed_200(spark, sf_dir):
    return propagate_labels(all_edges(spark, sf_dir), 200)


@query(_label_rounds_sql(100, "s.label <> s.last"))
def lpa_last1_100(spark, sf_dir):
    return propagate_labels(all_edges(spark, sf_dir), 100, "changed")


@query(_label_rounds_sql(200, "s.label <> s.last2"))
def lpa_last2_200(spark, sf_dir):
    return propagate_labels(all_edges(spark, sf_dir), 200, "changed_twice")


# ---------------------------------------------------------------- samples


@query("SELECT count(*) AS rows, 20 AS samples, true AS of_256_rows, true AS tenths_alike, true AS order_is_nothing FROM lineitem")
def forest_sample_invariants(spark, sf_dir):
    """Samples for isolation trees: each tenth of the table (by its keys) is drawn alike, and rows in another order give the same samples."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    n = rows.count()
    with dealt(spark, n):
        cuts = quantiles(rows, "l_orderkey", [i / 10 for i in range(11)])
    drawn = bounded_samples(rows, ["l_orderkey", "l_extendedprice"], 20, 256, 7, n)
    each = np.histogram(np.concatenate([s[:, 0] for s in drawn]), bins=np.array(cuts) + np.array([0.0] * 10 + [1.0]))[0]
    k = min(n, 256)
    alike = bool((abs(each - 2 * k) <= 6 * (2 * k) ** 0.5 + 0.02 * k).all())
    again = bounded_samples(rows.orderBy("l_extendedprice").repartition(max(7, tasks_for(spark, n))), ["l_orderkey", "l_extendedprice"], 20, 256, 7, n)
    same = all(np.array_equal(a, b) for a, b in zip(drawn, again, strict=True))
    return spark.createDataFrame([(n, len(drawn), all(len(s) == k for s in drawn), alike, same)], "rows long, samples int, of_256_rows boolean, tenths_alike boolean, order_is_nothing boolean")


# ---------------------------------------------------------------- whole flows over files


_CENTS = "SELECT l_suppkey AS id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS rank FROM lineitem GROUP BY ALL"


@query(f"""WITH r AS ({_CENTS}), d AS (SELECT * FROM r ORDER BY rank DESC, id LIMIT 500), a AS (SELECT * FROM r ORDER BY rank, id LIMIT 500)
SELECT 'DESC' AS list, CAST(id AS VARCHAR) || ',' || CAST(rank AS VARCHAR) AS line FROM d UNION ALL SELECT 'ASC', CAST(id AS VARCHAR) || ',' || CAST(rank AS VARCHAR) FROM a""")
def best_and_worst_files(spark, sf_dir):
    """The files of the 500 highest and the 500 lowest ranks, read back."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    ranks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum(cents).alias("rank"))
    path = _place(spark)
    flows.write_best(ranks, path)
    read = lambda name: L.text_lines(spark, f"{path}_{name}").select(F.lit(name).alias("list"), F.col("value").alias("line"))
    return read("DESC").union(read("ASC"))


_TRACE = "CAST(o_orderkey % 997 AS VARCHAR)"
_DAY = "CASE o_orderstatus WHEN 'F' THEN '20160901' WHEN 'O' THEN '20160902' ELSE '20160903' END"


@query(f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS card, {_TRACE} AS trace, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS code, o_orderkey AS k, {_DAY} AS day, o_orderpriority AS p FROM orders),
f AS (SELECT card, trace FROM o WHERE k % 11 = 0 AND p = '1-URGENT')
SELECT 'cards' AS part, card AS line FROM (SELECT DISTINCT card FROM f)
UNION ALL SELECT 'transactions', card || ',' || substr(code, 1, 4) || ',' || substr(code, 5, 4) FROM o WHERE card IN (SELECT card FROM f) AND trace IN (SELECT trace FROM f)""")
def fraud_flow_files(spark, sf_dir):
    """The whole flow: three days of raw records and a fraud list in files, then cards and transactions of a fraud type in files, read back."""
    orders = table(spark, sf_dir, "orders")
    card, trace = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 997).cast("string")
    day = F.when(F.col("o_orderstatus") == "F", "20160901").when(F.col("o_orderstatus") == "O", "20160902").otherwise("20160903")
    record = F.concat(F.lit('"'), F.concat_ws('","', card, trace, F.lpad(card, 8, "0")), F.lit('"'))
    days = {}
    for d in ("20160901", "20160902", "20160903"):
        days[d] = _place(spark)
        K.write_lines(orders.filter(day == d).select(record.alias("line")), "line", days[d])
    fraud = orders.filter("o_orderkey % 11 = 0").select(trace, card, F.lit("m"), day, F.when(F.col("o_orderpriority") == "1-URGENT", "04").otherwise("01"))
    listed, out = _place(spark), _place(spark)
    K.write_rows(fraud, listed, "\t")
    flows.extract_fraud(spark, listed, days, ["pri_acct_no_conv", "sys_tra_no", "acq_ins_id_cd"], out)
    read = lambda part: L.text_lines(spark, f"{out}/{part}").select(F.lit(part).alias("part"), F.col("value").alias("line"))
    return read("cards").union(read("transactions"))
