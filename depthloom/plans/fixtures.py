"""Views that read the star-schema tables as captures, the same in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCE, DEPTH = (1920, 1440), (256, 192)

VIEWS = {
    "fx_poses": """SELECT frame_id, frame_id*0.02D+(c%5)*0.002D AS x, (c%3)*0.01D AS y, frame_id*0.01D AS z,
 0.0D AS qx, (frame_id%8)/64.0D AS qy, 0.0D AS qz, 1.0D AS qw, 1500.0D+(frame_id%4) AS fx, 1500.0D AS fy, 960.0D AS cx, 720.0D AS cy
 FROM (SELECT CAST(floor(o_orderkey/64) AS INT) AS frame_id, MIN(o_custkey) AS c FROM orders GROUP BY CAST(floor(o_orderkey/64) AS INT)) o""",
    "fx_pixels": """SELECT frame_id, v, u, MIN(raw) AS raw, MAX(conf) AS conf FROM (SELECT CAST(floor(l_orderkey/64) AS INT) AS frame_id, CAST(l_partkey%192 AS INT) AS v,
 CAST((l_suppkey*7+l_linenumber*31+CAST(floor(l_extendedprice) AS BIGINT))%256 AS INT) AS u, CAST(l_quantity*100 AS INT)+(CAST(l_partkey%5 AS INT)-2)*50 AS raw, CAST(l_linenumber%3 AS INT) AS conf FROM lineitem) t GROUP BY frame_id, v, u""",
    "fx_room": """SELECT CAST(row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) AS BIGINT) AS pid,
 CAST(CASE WHEN l_linenumber%4=2 THEN 0.0D ELSE ((l_partkey*37+l_suppkey*101+l_orderkey*13)%300)/100.0D END AS DOUBLE) AS x,
 CAST(CASE l_linenumber%4 WHEN 0 THEN -1.4D+(l_quantity-25)/2500.0D WHEN 1 THEN 1.1D+(l_quantity-25)/2500.0D ELSE -1.4D+((l_orderkey*17+l_partkey*3)%250)/100.0D END AS DOUBLE) AS y,
 CAST(((l_orderkey*7+l_partkey*11+CAST(floor(l_extendedprice) AS BIGINT))%250)/100.0D AS DOUBLE) AS z FROM lineitem""",
    "fx_odometry_raw": """SELECT CAST(event_id+2 AS BIGINT) AS line_no, CAST(event_id AS STRING) AS ts_txt,
 CASE WHEN event_id%97=5 THEN 'abc' WHEN event_id%101=100 THEN lpad(CAST(event_id-1 AS STRING),6,'0') ELSE lpad(CAST(event_id AS STRING),6,'0') END AS frame_txt,
 CASE WHEN event_id%193=7 THEN 'oops' ELSE CAST(user_id AS STRING) END AS x_txt, CASE WHEN event_id%89=3 THEN '' ELSE CAST(1500+event_id%4 AS STRING) END AS fx_txt FROM events""",
    "fx_depth_files": """SELECT CASE WHEN event_id%211=4 THEN concat('thumb_',CAST(event_id AS STRING),'.png') ELSE concat(lpad(CAST(event_id AS STRING),6,'0'),CASE WHEN event_id%37=2 THEN '.PNG' ELSE '.png' END) END AS file_name FROM events WHERE event_id%50<>7""",
    "fx_conf_files": "SELECT concat(lpad(CAST(event_id AS STRING),6,'0'),'.png') AS file_name FROM events WHERE event_id%60<>9",
}
#: The room without its row numbers, which only a total order over the table gives; nothing that reads the room needs them.
VIEWS["fx_room_points"] = re.sub(r"CAST\(row_number\(\).*?AS pid,\s*", "", VIEWS["fx_room"], flags=re.S)
TABLE = {"fx_poses": "orders", "fx_pixels": "lineitem", "fx_room": "lineitem", "fx_room_points": "lineitem", "fx_odometry_raw": "events", "fx_depth_files": "events", "fx_conf_files": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLE[name]
    sql = re.sub(rf"\b{table}\b", f"{{{table}}}", VIEWS[name])
    return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(sql: str) -> str:
    """Spark's double literals in DuckDB's words."""
    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", sql)


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL over the named views; body begins with further CTEs ('x AS (...),') or with SELECT after a blank line."""
    return duck("WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + ("" if body.lstrip().startswith("SELECT") else ",") + "\n" + body)
