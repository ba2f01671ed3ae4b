"""Loaders, writers and random or fitted operators as queries: files are written from the test tables and read back, and what is random
or fitted is held against its invariants."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.ml import features as M
from ledgermesh.ml.isolation_forest import fit_forest
from ledgermesh.operators.ordered import numbered
from ledgermesh.plans.queries import TRANSITIONS_SQL, all_edges, query, table, transitions
from ledgermesh.session import checkpoints
from ledgermesh.sources import loaders as L
from ledgermesh.sources import schema as S
from ledgermesh.sources import sinks as K


def _place(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which outlives the query as its rows are read later."""
    return f"{checkpoints(spark)}/files-{uuid.uuid4().hex}"


def _written(frame: DataFrame, sep: str = ",") -> str:
    path = _place(frame.sparkSession)
    K.write_rows(frame, path, sep)
    return path


def _strings(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.col(c).cast("string") for c in frame.columns))


# ---------------------------------------------------------------- loaders


@query("WITH" + TRANSITIONS_SQL + " SELECT CAST(card AS VARCHAR) AS card, CAST(mchnt AS VARCHAR) AS mchnt, CAST(last_mchnt AS VARCHAR) AS last_mchnt, time_diff FROM trans")
def load_transitions(spark, sf_dir):
    return L.transitions(spark, _written(transitions(spark, sf_dir).select("card", "mchnt", "last_mchnt", "time_diff"), L.FIELD))


@query("SELECT CASE WHEN s_acctbal > 0 THEN CAST(s_suppkey AS VARCHAR) END AS mchnt, CASE WHEN s_acctbal > 0 THEN s_name ELSE ' ' END AS name FROM supplier")
def load_merchant_names(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, F.concat_ws(L.FIELD, F.col("s_suppkey").cast("string"), "s_name")).otherwise("nameless").alias("line"))
    path = _place(spark)
    K.write_lines(rows, "line", path)
    return L.merchant_names(spark, path)


def _edge_file(spark, sf_dir) -> str:
    lines = all_edges(spark, sf_dir).select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
    path = _place(spark)
    K.write_lines(lines.union(spark.createDataFrame([("# source and target",), ("",)], "line string")), "line", path)
    return path


@query("WITH" + TRANSITIONS_SQL + " SELECT src, dst, 1 AS attr FROM stats")
def load_edge_list(spark, sf_dir):
    return L.edge_list(spark, _edge_file(spark, sf_dir))[1]


@query("WITH" + TRANSITIONS_SQL + " SELECT id, 1 AS attr FROM (SELECT src AS id FROM stats UNION SELECT dst FROM stats)")
def load_edge_list_vertices(spark, sf_dir):
    return L.edge_list(spark, _edge_file(spark, sf_dir))[0]


RAW = ["pri_acct_no_conv", "acq_ins_id_cd", "trans_id"]


def _raw_files(spark, sf_dir) -> dict[str, str]:
    """A file for each order status as day: card, an institution code of 8 digits (or fewer), and a kind that may be empty."""
    orders = table(spark, sf_dir, "orders")
    out = {}
    for day, status in (("20160701", "F"), ("20160702", "O"), ("20160703", "P")):
        code = F.when(F.col("o_orderkey") % 3 == 0, "12").otherwise(F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
        values = (F.col("o_orderkey").cast("string"), code, F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")))
        path = f"{_place(spark)}_correct"
        K.write_lines(orders.filter(F.col("o_orderstatus") == status).select(F.concat(F.lit('"'), F.concat_ws('","', *values), F.lit('"')).alias("line")), "line", path)
        out[day] = path
    return out


_RAW_SQL = """raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS pri_acct_no_conv, CASE WHEN o_orderkey % 3 = 0 THEN '12' ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS acq_ins_id_cd,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS trans_id, CASE o_orderstatus WHEN 'F' THEN '20160701' WHEN 'O' THEN '20160702' ELSE '20160703' END AS pdate FROM orders)"""


@query(f"WITH {_RAW_SQL} SELECT * FROM raw")
def load_raw_days(spark, sf_dir):
    return L.raw_days(spark, _raw_files(spark, sf_dir), RAW)


_CODES_SQL = "CASE WHEN length(acq_ins_id_cd) = 8 THEN substr(acq_ins_id_cd, {}, 4) ELSE acq_ins_id_cd END"


@query(f"""WITH {_RAW_SQL} SELECT *, {_CODES_SQL.format(1)} AS "acq_ins_id_cd_BK", {_CODES_SQL.format(5)} AS "acq_ins_id_cd_RG", pri_acct_no_conv AS pri_acct_no_conv_filled,
 CASE WHEN trans_id = '' THEN 'NANs' ELSE trans_id END AS trans_id_filled, {_CODES_SQL.format(1)} AS "acq_ins_id_cd_BK_filled", {_CODES_SQL.format(5)} AS "acq_ins_id_cd_RG_filled" FROM raw WHERE pdate = '20160702'""")
def load_filled_of_day(spark, sf_dir):
    return L.filled_of_day(spark, "20160702", _raw_files(spark, sf_dir)["20160702"], RAW)


def _fraud_file(spark, sf_dir) -> str:
    orders = table(spark, sf_dir, "orders")
    return _written(_strings(orders.select("o_orderkey", "o_custkey", F.col("o_orderkey") % 7, F.date_format("o_orderdate", "yyyyMMdd"), F.lit("04"))), "\t")


_FRAUD_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS sys_tra_no, CAST(o_custkey AS VARCHAR) AS pri_acct_no_conv, CAST(o_orderkey % 7 AS VARCHAR) AS mchnt_cd, strftime(o_orderdate, '%Y%m%d') AS pdate, '04' AS fraud_tp FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN "


@query(_FRAUD_SQL + "'19940101' AND '19961231'")
def load_fraud_list(spark, sf_dir):
    return L.fraud_list(spark, _fraud_file(spark, sf_dir), "19940101", "19961231")


@query(_FRAUD_SQL + "'19950301' AND '19950301'")
def load_fraud_list_of_day(spark, sf_dir):
    return L.fraud_list_of_day(spark, _fraud_file(spark, sf_dir), "19950301")


def _wide(spark, sf_dir, names: list[str]) -> DataFrame:
    """A frame of so many columns made from customers."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias(names[0]), *(((F.col("c_custkey") + F.col("c_nationkey")) * (i + 1) % 97).alias(n) for i, n in enumerate(names[1:], 1)))


def _wide_sql(names: list[str], kind: str) -> str:
    return f'SELECT CAST(c_custkey AS VARCHAR) AS "{names[0]}", ' + ", ".join(f'CAST((c_custkey + c_nationkey) * {i + 1} % 97 AS {kind}) AS "{n}"' for i, n in enumerate(names[1:], 1)) + " FROM customer"


FILLED = [f"{c}_filled" for c in S.USED]
BEHAVIOUR = [f"behaviour_{i}" for i in range(178)]


@query(_wide_sql(FILLED, "VARCHAR"))
def load_processed(spark, sf_dir):
    return L.processed(spark, _written(_wide(spark, sf_dir, FILLED)))


@query(_wide_sql(S.LABELLED_ALL, "VARCHAR"))
def load_labelled_all(spark, sf_dir):
    return L.labelled_all(spark, _written(_wide(spark, sf_dir, S.LABELLED_ALL)))


@query(_wide_sql(S.LABELLED, "DOUBLE"))
def load_indexed(spark, sf_dir):
    return L.indexed(spark, _written(_wide(spark, sf_dir, S.LABELLED)))


@query(_wide_sql(S.indexed_names(BEHAVIOUR), "VARCHAR"))
def load_features(spark, sf_dir):
    return L.features(spark, _written(_wide(spark, sf_dir, S.indexed_names(BEHAVIOUR))), BEHAVIOUR)


_OWN = [c for c in S.LABELLED if c not in ("day_week", "hour")]
_AT = "strftime(o_orderdate, '%m%d') || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || '0000'"


@query(f"""WITH w AS ({_wide_sql(_OWN, 'VARCHAR').removesuffix(' FROM customer')}, {_AT} AS stamp FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT * EXCLUDE (stamp) REPLACE (stamp AS tfr_dt_tm), CAST(isodow(strptime('2016' || substr(stamp, 1, 4), '%Y%m%d')) AS VARCHAR) AS day_week, substr(stamp, 5, 2) AS hour FROM w""")
def load_labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.concat(F.date_format("o_orderdate", "MMdd"), F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"), F.lit("0000"))
    own = [(F.col("c_custkey") + F.col("c_nationkey")) * (i + 1) % 97 for i in range(len(_OWN))]
    own[0], own[1] = F.col("c_custkey"), at
    return L.labelled(spark, _written(rows.select(*(c.alias(n) for c, n in zip(own, _OWN, strict=True)))))


def _vector_file(spark, sf_dir) -> str:
    values = F.transform(F.slice("embedding", 1, 16), lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string"))
    path = _place(spark)
    K.write_lines(table(spark, sf_dir, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), values).alias("line")), "line", path)
    return path


_VECTOR_SQL = "v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER)) AS x FROM embeddings)"


@query(f"WITH {_VECTOR_SQL} SELECT vec_id AS label, array_to_string(x, ',') AS text, CAST(list_sum(x) AS DOUBLE) AS total FROM v")
def load_component_features(spark, sf_dir):
    rows = L.component_features(spark, _vector_file(spark, sf_dir))
    return rows.select("label", "text", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_VECTOR_SQL} SELECT CAST(vec_id AS DOUBLE) AS id, " + ", ".join(f"CAST(x[{i + 1}] AS DOUBLE) AS c{i}" for i in range(16)) + " FROM v")
def load_doubles(spark, sf_dir):
    return L.doubles_csv(spark, _vector_file(spark, sf_dir), ["id", *(f"c{i}" for i in range(16))])


@query("SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_partkey AS DOUBLE) AS l_partkey FROM lineitem")
def load_headed_numbers(spark, sf_dir):
    path = _place(spark)
    K.write_csv(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, header=True)
    K.write_lines(spark.createDataFrame([("l_orderkey,l_linenumber,l_partkey",)] * 2, "line string"), "line", f"{path}/again")
    return L.headed_numbers(spark, [f"{path}/*.csv", f"{path}/again/*.txt"])


@query("SELECT c_name || ',' || CAST(c_custkey AS VARCHAR) AS value FROM customer")
def write_rows_and_read_text(spark, sf_dir):
    return L.text_lines(spark, _written(table(spark, sf_dir, "customer").select("c_name", "c_custkey")))


@query("SELECT c_name AS value FROM customer")
def write_lines_and_read_text(spark, sf_dir):
    path = _place(spark)
    K.write_lines(table(spark, sf_dir, "customer"), "c_name", path)
    return L.text_lines(spark, path)


@query("SELECT c_custkey, c_name FROM customer")
def write_csv_and_read(spark, sf_dir):
    path = _place(spark)
    K.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return spark.read.schema("c_custkey long, c_name string").csv(path)


@query("SELECT r_name, t.code FROM region JOIN (VALUES (0::BIGINT, 'af'), (1, 'am'), (2, 'as'), (3, 'eu'), (4, NULL)) AS t(id, code) ON r_regionkey = t.id")
def literals(spark, sf_dir):
    """Literal rows, joined with the table that they are about."""
    codes = spark.createDataFrame([(0, "af"), (1, "am"), (2, "as"), (3, "eu"), (4, None)], "id long, code string")
    return table(spark, sf_dir, "region").join(codes, F.col("r_regionkey") == F.col("id")).select("r_name", "code")


@query("SELECT o_orderkey, o_orderstatus AS kept FROM orders WHERE o_totalprice > 200000")
def session_setting(spark, sf_dir):
    """A setting by SQL that the query then reads; the session has it no longer afterwards."""
    spark.sql("SET ledgermesh.least_price=200000")
    least = spark.conf.get("ledgermesh.least_price")
    spark.sql("RESET ledgermesh.least_price")
    return table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > float(least)).select("o_orderkey", F.col("o_orderstatus").alias("kept"))


@query("SELECT r_regionkey AS a, r_name AS b FROM region")
def rename_all(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name").toDF("a", "b")


# ---------------------------------------------------------------- random and fitted operators by their invariants


@query("SELECT count(*) AS rows, true AS near_a_tenth, true AS rows_of_the_table FROM lineitem")
def sample_invariants(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    drawn = rows.sample(False, 0.1, 7)
    n, k, known = rows.count(), drawn.count(), drawn.join(rows.distinct(), ["l_orderkey", "l_linenumber"], "left_anti").isEmpty()
    return spark.createDataFrame([(n, abs(k - n / 10) <= 5 * (n * 0.09) ** 0.5, known)], "rows long, near_a_tenth boolean, rows_of_the_table boolean")


@query("SELECT count(*) AS rows, true AS near_fourfold FROM lineitem")
def random_split_invariants(spark, sf_dir):
    fit, rest = (x.count() for x in table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").randomSplit([0.8, 0.2], 7))
    n = fit + rest
    return spark.createDataFrame([(n, abs(rest - n / 5) <= 5 * (n * 0.16) ** 0.5)], "rows long, near_fourfold boolean")


@query("SELECT count(*) AS rows, 2 AS clusters, true AS cost_below_one_centre, true AS nearest_centre FROM embeddings")
def kmeans_invariants(spark, sf_dir):
    """Two centres fit better than one, and every vector is with the nearer one."""
    vectors = M.normalise(table(spark, sf_dir, "embeddings").select("vec_id", M.vector(F.col("embedding")).alias("features")))
    rows, centres, cost = M.k_means(vectors, 2, 1, "normed")
    each = vectors.select(F.posexplode(vector_to_array("normed")).alias("slot", "x")).groupBy("slot").agg((F.var_pop("x") * F.count("*")).alias("cost"))
    one = each.agg(F.sum("cost").alias("cost")).first()["cost"]  # one row
    far = lambda c: F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    told = rows.select("prediction", vector_to_array("normed").alias("x")).select("prediction", *(far(c).alias(f"d{i}") for i, c in enumerate(centres)))
    wrong = F.when(F.col("prediction") == 0, F.col("d0") > F.col("d1") + 1e-9).otherwise(F.col("d1") > F.col("d0") + 1e-9)
    return told.agg(F.count("*").alias("rows"), F.lit(len(centres)).alias("clusters"), F.lit(cost < one).alias("cost_below_one_centre"), (F.count_if(wrong) == 0).alias("nearest_centre"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE l_quantity > 25) AS large, true AS labels_known, true AS accurate, true AS a_fifth_is_tested FROM lineitem")
def random_forest_invariants(spark, sf_dir):
    """The forest tells large quantities apart, and gives back the labels that it was taught."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_quantity") > 25).cast("double").alias("label"))
    model, out, accuracy = M.random_forest(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    n, total, large = out.count(), rows.count(), rows.filter("label = 1").count()
    known = out.filter(~F.col("predictedLabel").isin("0.0", "1.0")).isEmpty() and len(K.model_text(model, 2)) > 0
    return spark.createDataFrame([(total, large, known, accuracy > 0.9, abs(n - total / 5) <= 5 * (total * 0.16) ** 0.5)], "rows long, large long, labels_known boolean, accurate boolean, a_fifth_is_tested boolean")


@query("SELECT count(*) + 1 AS rows, true AS within_0_and_1, true AS outlier_first FROM lineitem")
def isolation_forest_invariants(spark, sf_dir):
    """A row far outside has the highest score."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in columns))
    forest = fit_forest(rows, columns)
    odd = spark.createDataFrame([tuple([1e9] * 4)], ", ".join(f"{c} double" for c in columns))
    scored = forest.score(rows.union(odd))
    return scored.agg(F.count("*").alias("rows"), ((F.min("score") > 0) & (F.max("score") < 1)).alias("within_0_and_1"), (F.max(F.when(F.col("l_tax") > 1e8, F.col("score"))) >= F.max("score")).alias("outlier_first"))


@query("""WITH n AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM n)
SELECT o_orderkey, CAST(i AS DOUBLE) AS index, CAST(i AS DOUBLE) + CAST(o_custkey AS DOUBLE) AS total FROM orders JOIN c ON v = o_orderpriority""")
def filled_vectors_assembled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("kind_filled"))
    out = M.assemble(M.filled_vectors(rows, ["kind"]), ["kind_CatVec", "o_custkey"])
    x = vector_to_array("features")
    return out.select("o_orderkey", x[0].alias("index"), (x[0] + x[1]).alias("total"))


@query("WITH" + TRANSITIONS_SQL + ", s AS (SELECT mchnt AS id, count(*) AS size FROM trans GROUP BY ALL) SELECT id, size, row_number() OVER (ORDER BY size DESC, id) AS place FROM s")
def sizes_in_order(spark, sf_dir):
    """Sizes from the largest down, with their places."""
    sizes = transitions(spark, sf_dir).groupBy(F.col("mchnt").alias("id")).agg(F.count("*").alias("size"))
    return numbered(sizes, F.desc("size"), "id", name="place").withColumn("place", F.col("place") + 1)
