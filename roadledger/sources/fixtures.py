"""Adapters that derive the engine's inputs from the test tables.

The expressions are SQL text that Spark and DuckDB both understand, so queries and their
oracles start from the same rows. Integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STATE = "CASE user_id % 5 WHEN 0 THEN 'MH' WHEN 1 THEN 'DL' WHEN 2 THEN 'KA' WHEN 3 THEN 'TN' ELSE 'XX' END"
_PLATE = f"concat({_STATE}, lpad(CAST(1 + user_id % 14 AS STRING), 2, '0'), 'AB', lpad(CAST(user_id % 10000 AS STRING), 4, '0'))"
_VIOLATION = "CASE event_type WHEN 'error' THEN 'no_helmet' WHEN 'purchase' THEN 'triple_riding' WHEN 'click' THEN 'overspeed' ELSE event_type END"

FINES = {
    "id": "CAST(event_id AS BIGINT)",
    "plate": _PLATE,
    "violation": _VIOLATION,
    "amount": "CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 1000 WHEN 'click' THEN 700 ELSE 300 END AS BIGINT)",
    "image_path": "concat('evidence/e', CAST(event_id AS STRING), '.jpg')",
    "timestamp": "ts",
    "status": "CASE WHEN event_id % 4 = 0 THEN 'paid' ELSE 'unpaid' END",
}

FRAMES = "SELECT CAST(c_nationkey AS BIGINT) AS video_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS frame_idx, o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey"

_LANE = "(l_linenumber % 3)"
_X1 = f"CAST({_LANE} * 300 + (frame_idx * 7) % 41 + l_partkey % 13 AS BIGINT)"
_Y1 = "CAST(100 + l_suppkey % 7 AS BIGINT)"
DETECTIONS = {
    "video_id": "video_id",
    "frame_idx": "frame_idx",
    "det_id": "CAST(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT)",
    "label": "CASE WHEN l_linenumber <= 3 THEN 'Plate' WHEN l_linenumber <= 5 THEN 'WithoutHelmet' WHEN l_linenumber = 6 THEN 'TripleRiding' ELSE 'Helmet?' END",
    "conf": "CAST((l_partkey % 100) / 100.0e0 AS DOUBLE)",
    "x1": _X1,
    "y1": _Y1,
    "x2": f"{_X1} + CASE WHEN l_linenumber <= 3 THEN 50 ELSE 90 END",
    "y2": f"{_Y1} + CASE WHEN l_linenumber <= 3 THEN 30 ELSE 120 END",
    "lane": f"CAST({_LANE} AS BIGINT)",
    "readable": "CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 7 = 0 THEN 1 ELSE 2 END",
}
#: OCR fragments of a plate: none, marks alone, or two that make a plate of the lane.
_TEXTS = "CASE readable WHEN 0 THEN {empty} WHEN 1 THEN {array}('***', '--') ELSE {array}(concat('mh ', lpad(CAST(video_id AS STRING), 2, '0')), concat('-AB', lpad(CAST(lane AS STRING), 4, '0'))) END"


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in FINES.items()))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame, those without detections too, with the order it stands for."""
    return spark.sql(FRAMES, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the columns lane and readable besides the schema's.

    A frame is of one order, so numbering inside the order and frame is numbering inside the frame, and
    needs no other shuffle than the join's.
    """
    joined = table(spark, sf_dir, "lineitem").join(frames(spark, sf_dir), on=[_col("l_orderkey") == _col("o_orderkey")])
    inside = {"det_id": DETECTIONS["det_id"].replace("PARTITION BY video_id", "PARTITION BY l_orderkey, video_id")}
    out = joined.selectExpr(*(f"{e} AS {n}" for n, e in (DETECTIONS | inside).items()))
    texts = _TEXTS.format(empty="CAST(array() AS ARRAY<STRING>)", array="array")
    return out.selectExpr("*", f"{texts} AS ocr_texts", "CASE readable WHEN 0 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array(conf, 1 - conf) END AS ocr_confs")


def _col(name: str):
    from pyspark.sql import functions as F

    return F.col(name)


def ctes() -> str:
    """The same inputs as DuckDB common table expressions: fines, frames, detections."""
    frames_sql = FRAMES.format(orders="orders", customer="customer")
    texts = _TEXTS.format(empty="CAST([] AS VARCHAR[])", array="list_value")
    return f"""fines AS (SELECT {_columns(FINES)} FROM events),
frames AS ({frames_sql}),
detections AS (SELECT *, {texts} AS ocr_texts FROM (SELECT {_columns(DETECTIONS)} FROM lineitem JOIN frames ON l_orderkey = o_orderkey))"""
