"""Readers of edge lists, node histories and made-up graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_NAMES, WEIGHT_NAMES = ("time", "ts"), ("w", "weight")
NODE_NAMES, FEATURE_TIMES = ("node_id", "node", "id"), ("time", "ts", "timestamp")

# Windowing of well-known public edge lists.
PRESETS = {
    "ia-slashdot-reply-dir": {"window": 200, "skiprows": 2, "sep": r"\s+", "skiptime": 1, "lags": 30},
    "WikiTalk": {"window": 200, "batch_size": 3000, "use_batch_split": True, "edge_file": "WikiTalk/edges.csv", "skiprows": 0, "sep": ",", "skiptime": 1, "lags": 30},
    "rec-amazon-ratings": {"window": 100, "skiprows": 2, "sep": ",", "skiptime": 1, "lags": 30},
    "rec-amz-Books": {"window": 100, "skiprows": 0, "sep": ",", "skiptime": 0, "lags": 0},
    "soc-bitcoin": {"window": 100, "skiprows": 0, "sep": r"\s+", "skiptime": 1, "lags": 10},
    "soc-flickr-growth": {"window": 100, "skiprows": 1, "sep": r"\s+", "skiptime": 1, "lags": 30},
    "soc-youtube-growth": {"window": 100, "skiprows": 2, "sep": r"\s+", "skiptime": 1, "lags": 30},
}


def infer_columns(columns: list[str]) -> tuple[str, str | None]:
    """Time and weight columns of a headed edge table; the last column is the time where
    none is named so, and weights may be absent."""
    if "src" not in columns or "dst" not in columns:
        raise ValueError("an edge table needs the columns src and dst")
    return next((c for c in TIME_NAMES if c in columns), columns[-1]), next((c for c in WEIGHT_NAMES if c in columns), None)


def edges_from_table(df: DataFrame) -> DataFrame:
    """(src, dst, ts, weight) of a headed table, by its column names."""
    time, weight = infer_columns(df.columns)
    return df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(time).cast("double").alias("ts"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))


def edge_features(df: DataFrame) -> DataFrame:
    """(eid, feat): every numeric column beside ``eid`` is a feature."""
    names = feature_columns(df.schema, {"eid"})
    if "eid" not in df.columns or not names:
        raise ValueError("a table of edge features needs eid and a numeric column")
    return df.select(F.col("eid").cast("long").alias("eid"), F.array(*[F.col(c).cast("double") for c in names]).alias("feat"))


def read_edge_csv(spark: SparkSession, path: str, features: str | None = None) -> DataFrame:
    """A headed edge table; with a table of features beside it, events are numbered by the
    table's ``eid`` column and have their vector, empty where there is none."""
    rows = spark.read.csv(path, header=True)
    if features is None:
        return edges_from_table(rows)
    time, weight = infer_columns([c for c in rows.columns if c != "eid"])
    own = rows.select(F.col("eid").cast("long").alias("eid"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(time).cast("double").alias("ts"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    feats = edge_features(spark.read.csv(features, header=True, inferSchema=True))
    return own.join(feats, "eid", "left").withColumn("feat", F.coalesce("feat", F.array().cast("array<double>")))


def parse_edge_lines(lines: DataFrame, separator: str | None = None, value: str = "value") -> DataFrame:
    """(src, dst, ts, weight) of text lines: three fields are u v ts, four u v w ts, five
    and more have a first field that is dropped and no weight. Empty lines, lines that
    begin with % or #, and shorter ones are left out. Ids lose their fractions."""
    text = F.trim(F.col(value))
    by_comma, by_space = F.transform(F.split(text, ","), lambda x: F.trim(x)), F.split(text, r"\s+")
    parts = by_comma if separator == "," else by_space if separator else F.when(F.contains(text, F.lit(",")), by_comma).otherwise(by_space)
    rows = lines.where((text != "") & ~text.startswith("%") & ~text.startswith("#")).select(parts.alias("p")).where(F.size("p") >= 3)
    n, at = F.size("p"), lambda i: F.element_at("p", i)
    wide = n >= 5
    number = lambda c: c.cast("double").cast("long")
    return rows.select(
        number(F.when(wide, at(2)).otherwise(at(1))).alias("src"),
        number(F.when(wide, at(3)).otherwise(at(2))).alias("dst"),
        F.when(n >= 4, at(4)).otherwise(at(3)).cast("double").alias("ts"),
        F.when(n == 4, at(3).cast("double")).otherwise(1.0).alias("weight"),
    )


def read_edge_lines(spark: SparkSession, path: str, skiprows: int = 0, separator: str | None = None) -> DataFrame:
    """An edge list without header. With ``skiprows`` the first lines of each file go."""
    lines = spark.read.text(path)
    if skiprows:
        # lines of a file keep their order inside its blocks; only the first block counts
        tagged = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        first = tagged.where("b = 0").groupBy("f").agg(F.min("i").alias("lo"))
        lines = tagged.join(first, "f").where(F.col("i") >= F.col("lo") + skiprows).select("value")
    return parse_edge_lines(lines, separator)


def feature_columns(schema: T.StructType, reserved: set[str]) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in reserved]


def node_features(df: DataFrame) -> DataFrame:
    """(node, ts, feat, ordinal): id and time by name, every other numeric column is a
    feature. Rows of one time keep their order by ``ordinal`` where the table has it."""
    node = next((c for c in NODE_NAMES if c in df.columns), None)
    if node is None:
        raise ValueError(f"a feature table needs one of the columns {', '.join(NODE_NAMES)}")
    time = next((c for c in FEATURE_TIMES if c in df.columns), None)
    names = feature_columns(df.schema, {node, time, "ordinal"})
    if not names:
        raise ValueError("a feature table needs a numeric column beside id and time")
    ordinal = F.col("ordinal") if "ordinal" in df.columns else F.monotonically_increasing_id()
    return df.select(F.col(node).cast("long").alias("node"), (F.col(time).cast("double") if time else F.lit(0.0)).alias("ts"), F.array(*[F.col(c).cast("double") for c in names]).alias("feat"), ordinal.cast("long").alias("ordinal"))


def read_node_features(spark: SparkSession, path: str) -> DataFrame:
    return node_features(spark.read.csv(path, header=True, inferSchema=True))


def ring_events(spark: SparkSession, snaps: int) -> DataFrame:
    """A made-up event set: a ring walked in order of time."""
    n = max(16, 4 * snaps)
    nodes = min(128, max(8, n // 2))
    i = F.col("id")
    return spark.range(n).select(i.alias("eid"), (i % nodes).alias("src"), ((i + 1) % nodes).alias("dst"), i.cast("double").alias("ts"), F.lit(1.0).alias("weight"))


def ring_snapshots(spark: SparkSession, snaps: int) -> DataFrame:
    """Four edges of an eight-node ring in each snapshot, turned by one from one to the next."""
    base = spark.range(snaps).select(F.col("id").alias("snap"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return base.select("snap", ((F.col("snap") + F.col("i")) % 8).alias("src"), ((F.col("snap") + F.col("i") + 1) % 8).alias("dst"), F.lit(1.0).alias("weight"))


def read_edges(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """kind: csv, lines, parquet, or ring (made-up; never a silent fallback)."""
    if kind == "csv":
        return read_edge_csv(spark, path, **options)
    if kind == "lines":
        return read_edge_lines(spark, path, **options)
    if kind == "parquet":
        return edges_from_table(spark.read.parquet(path))
    if kind == "ring":
        return ring_events(spark, **options)
    raise ValueError(f"unknown kind of edge source: {kind}")


def event_graph(events: DataFrame, *more: Column) -> DataFrame:
    """The event table as a graph from users to the keys in their properties."""
    key = F.get_json_object("props", "$.k").cast("long") + 1_000_000
    return events.select(F.col("event_id").cast("long").alias("eid"), F.col("user_id").cast("long").alias("src"), key.alias("dst"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").cast("double").alias("weight"), *more)


def supply_graph(lineitem: DataFrame) -> DataFrame:
    """Line items as a graph from suppliers to parts; days tie, so ids follow all columns."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return lineitem.select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") + 1_000_000_000).cast("long").alias("dst"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_quantity").cast("double").alias("weight"), *[F.col(c) for c in order[1:3]])
