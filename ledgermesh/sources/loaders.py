"""Readers of tables, transaction files, edge lists and literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.functions.scalars import bank_code, day_of_week, fill_empty, region_code
from ledgermesh.sources import schema as S

FIELD = "\x01"


def session(name: str = "ledgermesh", hive: bool = False, **conf: str) -> SparkSession:
    """A session by name, with Hive's catalog if asked for; settings as keywords (dots as __)."""
    builder = SparkSession.builder.appName(name)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()


def ensure_table(spark: SparkSession, database: str, table: str, columns: str, partitions: str | None = None) -> None:
    """Create the database and the table unless they exist, and use the database. partitions: the columns that name its folders."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"USE {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet" + (f" PARTITIONED BY ({partitions})" if partitions else ""))


def days_of_table(table: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Rows of a table in folders by day between two days: other days' files aren't opened."""
    return table.filter(F.col(day).between(first, last))


def rows_on_days(table: DataFrame, day: str, days: DataFrame) -> DataFrame:
    """Rows of a table in folders by day whose day is among those of another frame; the folders are chosen when that frame is known."""
    own = days.select(F.col(days.columns[0]).alias("_day")).distinct()
    return table.join(own, F.col(day) == F.col("_day")).drop("_day")


def transfers(table: DataFrame, first: str, last: str, trans_id: str = "S33") -> DataFrame:
    """Transfers of one kind between two settlement days, both included, under short names."""
    kept = table.filter(F.col("hp_settle_dt").between(first, last) & (F.col("trans_id") == trans_id))
    return kept.select(*S.TRANSFERS).toDF(*S.TRANSFER_NAMES)


def transitions(spark: SparkSession, path: str) -> DataFrame:
    """card, mchnt, last_mchnt, time_diff of control-A separated text."""
    return spark.read.schema(S.TRANSITIONS).option("sep", FIELD).csv(path)


def merchant_names(spark: SparkSession, path: str) -> DataFrame:
    """mchnt and name of control-A separated text; a row without a name gets a null merchant and a blank name."""
    parts = F.split("value", FIELD)
    whole = F.size(parts) > 1
    return spark.read.text(path).select(F.when(whole, parts[0]).alias("mchnt"), F.when(whole, F.get(parts, F.lit(1))).otherwise(" ").alias("name"))


def edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of lines with two ids between white space; blank lines and # lines are skipped. Attributes are 1."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    parts = F.split("value", r"\s+")
    edges = lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), F.lit(1).alias("attr"))
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("attr", F.lit(1)), edges


def _places(spark: SparkSession, path: str) -> list[str]:
    """The files and folders that a path, or a pattern, names, as readers report them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    return [s.getPath().toUri().toString().replace("file:///", "file:/") for s in found]


def raw_days(spark: SparkSession, paths: dict[str, str], names: list[str] | str) -> DataFrame:
    """Raw records of several days: fields between `","`, the outer quotes off, and pdate. paths: day -> path.

    All days are one scan; a row's day is looked up by the path of its file, or of the folder that holds it, as a whole.
    """
    columns = S.names_of(names)
    days: dict[str, list[str]] = {}
    for day, path in paths.items():
        for place in _places(spark, path):
            days.setdefault(place, []).append(day)
    known = F.create_map(*(x for place, own in days.items() for x in (F.lit(place), F.array(*map(F.lit, own)))))  # an entry for each path
    file = F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/"))
    day = F.coalesce(F.element_at(known, file), F.element_at(known, F.regexp_replace(file, "/[^/]*$", "")))
    parts = F.split(F.regexp_replace("value", '^"|"$', ""), '","')
    rows = spark.read.text(sorted(set(paths.values()))).select("value", F.explode(day).alias("pdate"))
    return rows.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)), "pdate")


def split_codes(raw: DataFrame) -> DataFrame:
    """Bank and region columns for each institution code that the frame has."""
    have = [c for c in S.CODES if c in raw.columns]
    return raw.select("*", *(f(c).alias(c + tail) for c in have for f, tail in ((bank_code, "_BK"), (region_code, "_RG"))))


def filled(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`<c>_filled` for each column in use: empty strings replaced."""
    return frame.select("*", *(fill_empty(c).alias(f"{c}_filled") for c in (columns or [c for c in S.USED if c in frame.columns])))


def fraud_list(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Fraud records between two days (yyyyMMdd, as text), of tab separated text."""
    return spark.read.schema(S.FRAUD).option("sep", "\t").csv(path).filter(F.col("pdate").between(first, last))


def fraud_list_of_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    return fraud_list(spark, path, day, day)


def filled_of_day(spark: SparkSession, day: str, path: str, names: list[str] | str) -> DataFrame:
    return filled(split_codes(raw_days(spark, {day: path}, names)))


def processed(spark: SparkSession, path: str) -> DataFrame:
    """The 75 `<c>_filled` strings of comma separated text."""
    return spark.read.schema(S.strings([f"{c}_filled" for c in S.USED])).csv(path)


def labelled(spark: SparkSession, path: str, year: str = "2016") -> DataFrame:
    """72 fields of comma separated text, with day_week and hour of the second field (MMddHHmmss) put in behind it: 74 strings."""
    own = [c for c in S.LABELLED if c not in ("day_week", "hour")]
    rows = spark.read.schema(S.strings(own)).csv(path)
    at = F.col("tfr_dt_tm")
    extra = {"day_week": day_of_week(F.concat(F.lit(year), F.substring(at, 1, 4))).cast("string"), "hour": F.substring(at, 5, 2)}
    return rows.select(*(extra[c].alias(c) if c in extra else F.col(c) for c in S.LABELLED))


def labelled_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.strings(S.LABELLED_ALL)).csv(path)


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """A string key and 73 doubles."""
    return spark.read.schema(S.keyed_doubles(S.LABELLED)).csv(path)


def features(spark: SparkSession, path: str, behaviour: list[str] | str) -> DataFrame:
    """Engineered features as strings: the behaviour columns, then the categories' indices."""
    return spark.read.schema(S.strings(S.indexed_names(S.names_of(behaviour)))).csv(path)


def component_features(spark: SparkSession, path: str, first: int = 1, last: int = 16) -> DataFrame:
    """label (long), text (the numbers as they are) and features (vector) of comma separated lines."""
    from pyspark.ml.functions import array_to_vector

    parts = F.split("value", ",")
    numbers = F.slice(parts, first + 1, last - first + 1)
    return spark.read.text(path).filter("trim(value) <> ''").select(parts[0].cast("long").alias("label"), F.concat_ws(",", numbers).alias("text"), array_to_vector(F.transform(numbers, lambda x: x.cast("double"))).alias("features"))


def doubles_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Comma separated doubles without a header."""
    from pyspark.sql.types import DoubleType

    return spark.read.schema(S.strings(names, DoubleType())).csv(path)


def headed_numbers(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all but its first column, as doubles. A line that repeats the header is dropped."""
    rows = spark.read.option("header", True).csv(path)
    header = [F.col(f"`{c}`").eqNullSafe(F.lit(c)) for c in rows.columns]
    rows = rows.filter(~reduce(Column.__and__, header))
    return rows.select(*(F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns[1:]))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
