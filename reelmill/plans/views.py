"""Views that turn the business tables into streaming-media tables; the same SQL text for Spark and for DuckDB.

{table} stands for a table; `d` is the dialect ("spark" or "duck"). Used by the registered queries, so that their work
grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

M = 1 << 33


#: Rows of a table in one task, where a view has windows by the table's key: sorts and windows hold a task's rows.
TASK_ROWS = 500_000
KEYS = {"lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str, by_key: bool = False) -> DataFrame:
    """A Parquet table of sf_dir; by_key: a large one dealt by its key to more tasks than the session has partitions, so
    that a task's share does not grow with the table."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = tasks_of(spark, rows) if by_key else None
    return rows.repartition(tasks, KEYS[name]) if tasks else rows


def tasks_of(spark: SparkSession, rows: DataFrame) -> int | None:
    """The tasks of TASK_ROWS that a table is dealt to, where they are more than the session has partitions."""
    tasks = rows.count() // TASK_ROWS
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark's DataFrame of a view text over the Parquet tables of sf_dir."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n, n in KEYS and f"PARTITION BY {KEYS[n]} " in sql) for n in names})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def longs(df: DataFrame) -> DataFrame:
    """df with all integers as long, the type that the SQL twins give."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("long") if isinstance(f.dataType, small) else F.col(f.name) for f in df.schema])


def _div(d: str, a: str, b: str) -> str:
    return f"(({a}) div ({b}))" if d == "spark" else f"(({a}) // ({b}))"


def v_seg(d: str) -> str:
    return """
      SELECT l_orderkey AS playlist_uri, seq AS sequence, l_quantity / 10 AS duration, l_tax,
             'v' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(seq AS VARCHAR(20)) || '.ts' AS segment_uri,
             CAST(coalesce(sum(chg) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS discontinuity_sequence
      FROM (SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY seq) <> l_returnflag THEN 1 ELSE 0 END AS chg
            FROM (SELECT l_orderkey, l_quantity, l_tax, l_returnflag,
                         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS seq
                  FROM {lineitem}) AS a) AS b
    """


def v_audio_seg(d: str) -> str:
    return f"""
      SELECT playlist_uri, sequence, duration + l_tax AS duration, 'a' || substr(segment_uri, 2) AS segment_uri,
             discontinuity_sequence + CASE WHEN playlist_uri % 19 = 0 THEN 1 ELSE 0 END AS discontinuity_sequence
      FROM ({v_seg(d)}) AS s WHERE (playlist_uri + sequence) % 17 <> 0
    """


def v_pts(d: str) -> str:
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)" if d == "spark" else "epoch_us(ts)"
    return f"""
      SELECT stream_id, ord, true90k, true90k % {M} AS raw90k, user_id, event_type, value,
             CAST(sum(CASE WHEN event_type = 'error' AND ord % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
      FROM (SELECT user_id % 5 AS stream_id, event_id AS ord, {_div(d, us + ' * 9', '100')} AS true90k, user_id, event_type, value FROM {{events}}) AS a
    """


def v_variants(d: str) -> str:
    return """
      SELECT p_brand AS master_uri, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS ordinal,
             'v' || CAST(p_partkey AS VARCHAR(20)) || '.m3u8' AS uri,
             CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 100000 END AS bandwidth,
             CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '640x360' WHEN 2 THEN '1280X720' WHEN 3 THEN '1920x1080' ELSE 'wide' END AS resolution,
             CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'avc1.42C01F,mp4a.40.2' WHEN 2 THEN 'hvc1.1.6.L93,mp4a.40.2' WHEN 3 THEN 'avc1.64001f, MP4A.40.2'
                             WHEN 4 THEN 'mp4a.40.5,avc1.42000d' ELSE 'avc3.64001f' END AS codecs
      FROM {part}
    """


def v_snap(d: str) -> str:
    """Snapshot n shows the sequences n to n + 3; playlists of key 0 modulo 13 change a duration in snapshot 2, those of
    1 rewind by two in snapshot 2, those of 2 skip snapshots 1 to 5, those of 3 change the target duration in snapshot 2."""
    return f"""
      SELECT s.playlist_uri, n.snapshot_no, s.sequence, s.segment_uri, s.discontinuity_sequence,
             s.duration + CASE WHEN s.playlist_uri % 13 = 0 AND n.snapshot_no = 2 THEN 1 ELSE 0 END AS duration,
             n.media_sequence, n.window_discontinuity, CAST(CASE WHEN s.playlist_uri % 13 = 3 AND n.snapshot_no >= 2 THEN 6 ELSE 5 END AS BIGINT) AS target_duration,
             CAST(row_number() OVER (PARTITION BY s.playlist_uri, n.snapshot_no ORDER BY s.sequence) - 1 AS BIGINT) AS ordinal
      FROM ({v_seg(d)}) AS s JOIN (
        SELECT playlist_uri, snapshot_no, CASE WHEN playlist_uri % 13 = 1 AND snapshot_no = 2 THEN snapshot_no - 2 ELSE snapshot_no END AS media_sequence,
               discontinuity_sequence AS window_discontinuity
        FROM (SELECT playlist_uri, sequence AS snapshot_no, discontinuity_sequence, count(*) OVER (PARTITION BY playlist_uri) AS segs FROM ({v_seg(d)}) AS x) AS y
        WHERE segs >= 6 AND snapshot_no <= segs - 4 AND NOT (playlist_uri % 13 = 2 AND snapshot_no BETWEEN 1 AND 5)) AS n
      ON s.playlist_uri = n.playlist_uri AND s.sequence BETWEEN n.media_sequence AND n.media_sequence + 3
    """


def v_fetch(d: str) -> str:
    return """
      SELECT user_id AS session_id, event_id AS ord, CAST(round(value * 10000) AS BIGINT) AS n_bytes, 1 + event_id * 7919 % 900000 AS elapsed_us,
             CAST(2000000 AS BIGINT) AS segment_us, 1 + event_id % 6 AS attempt,
             CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 WHEN 'click' THEN NULL ELSE 200 END AS status,
             CASE WHEN event_id % 11 = 0 THEN 'cancelled' WHEN event_id % 7 = 0 THEN 'timeout' END AS error_kind
      FROM {events}
    """


def v_play(d: str) -> str:
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)" if d == "spark" else "epoch_us(ts)"
    return f"""
      SELECT session_id, ord, kind, {_div(d, 'us - min(us) OVER (PARTITION BY session_id)', '1000')} AS media_ms, lateness_ms, lateness_ms % 700 AS resident_units
      FROM (SELECT user_id AS session_id, event_id AS ord, {us} AS us, CAST(floor(value) AS BIGINT) AS lateness_ms,
                   CASE event_type WHEN 'error' THEN 'video_starved' WHEN 'signup' THEN 'audio_underrun' WHEN 'purchase' THEN 'buffer_recovered'
                                   WHEN 'view' THEN 'presented' ELSE 'quality_switched' END AS kind FROM {{events}}) AS a
    """


def v_au(d: str) -> str:
    return f"""
      SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY ord) - 1 AS BIGINT) AS au_no, event_type = 'signup' AS is_idr, event_type = 'view' AS disposable,
             event_type = 'error' AND ord % 3 = 0 AS damaged, CASE WHEN ord % 3 = 0 THEN true90k END AS anchor90k, true90k, ord,
             CAST(sum(CAST(floor(value * 100) AS BIGINT) + 1) OVER (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS first_vcl_offset,
             CAST(floor(value) AS BIGINT) AS lateness_ms, {_div(d, 'ord', '100')} AS segment_seq
      FROM ({v_pts(d)}) AS p
    """


def v_pcm(d: str) -> str:
    return """
      SELECT user_id % 5 AS stream_id, event_id AS unit_no, CAST(1024 AS BIGINT) AS valid_frames, value / 500 - 0.5 AS sample,
             row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) * 1000 + CAST(floor(value) AS BIGINT) - 200 AS start_frame
      FROM {events}
    """


def v_mp4(d: str) -> str:
    return """
      SELECT l_orderkey AS file, CAST(1 AS BIGINT) AS track, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS run_no,
             CAST(l_linenumber AS BIGINT) AS count, CAST(512 * l_linenumber AS BIGINT) AS delta, CAST(l_quantity AS BIGINT) AS size
      FROM {lineitem}
    """


def v_probe_segments(d: str) -> str:
    """Two probed segments a variant."""
    return """
      SELECT l_orderkey AS variant_uri, segment_no, l_orderkey % 2 = 0 AS is_end_list, l_orderkey % 71 <> 0 AS has_segment, l_orderkey % 73 <> 0 AS has_pat,
             NOT (l_orderkey % 79 = 0 AND segment_no = 1) AS has_pmt, l_orderkey % 83 <> 0 AS has_h264
      FROM (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS segment_no FROM {lineitem} UNION ALL SELECT DISTINCT l_orderkey, CAST(1 AS BIGINT) FROM {lineitem}) AS a
    """


def v_probe_slices(d: str) -> str:
    some, one, two = ("CAST(array() AS ARRAY<INT>)", "array(1)", "array(1, 2)") if d == "spark" else ("CAST([] AS INTEGER[])", "[1]", "[1, 2]")
    return f"""
      SELECT l_orderkey AS variant_uri, CASE WHEN l_linenumber % 6 = 5 THEN NULL ELSE CAST((l_orderkey + l_linenumber) % 3 % 2 + CASE WHEN l_orderkey % 21 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS pps_id,
             l_linenumber = 1 AND l_orderkey % 7 <> 0 AS is_idr,
             CAST(CASE WHEN l_linenumber = 1 THEN 2 WHEN l_orderkey % 8 = 0 THEN l_suppkey % 5 WHEN l_orderkey % 4 = 1 THEN 0 WHEN l_orderkey % 4 = 2 THEN l_partkey % 3 ELSE 2 END AS BIGINT) AS slice_type,
             CAST(l_partkey % 9 AS BIGINT) AS nal_ref_idc, CAST(CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS cabac_init_idc, l_orderkey % 5 <> 0 AS weight_table,
             l_orderkey % 13 = 0 AS modified_lists, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS poc_lsb, CAST(1 + l_orderkey % 34 AS BIGINT) AS l0_active,
             CAST(1 + l_orderkey % 3 AS BIGINT) AS l1_active, CAST(CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS redundant_pic_cnt, l_orderkey % 23 = 0 AS long_term_reference,
             l_orderkey % 6 = 0 AS adaptive_marking, CASE l_orderkey % 18 WHEN 6 THEN {one} WHEN 12 THEN {two} ELSE {some} END AS marking_ops
      FROM {{lineitem}}
    """


def v_probe_pps(d: str) -> str:
    return """
      SELECT l_orderkey AS variant_uri, pps_id, CAST(CASE WHEN l_orderkey % 29 = 0 THEN 9 ELSE 0 END AS BIGINT) AS sps_id, l_orderkey % 2 = 0 AS cabac, l_orderkey % 3 = 0 AS weighted_pred,
             CAST(CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE l_orderkey % 5 % 2 END AS BIGINT) AS weighted_bipred_idc, l_orderkey % 31 = 0 AS transform_8x8, l_orderkey % 37 = 0 AS pps_scaling,
             CAST(CASE WHEN l_orderkey % 41 = 0 THEN 2 ELSE 1 END AS BIGINT) AS slice_groups
      FROM (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS pps_id FROM {lineitem} UNION ALL SELECT DISTINCT l_orderkey, CAST(1 AS BIGINT) FROM {lineitem}) AS a WHERE l_orderkey % 43 <> 0
    """


def v_probe_sps(d: str) -> str:
    return """
      SELECT DISTINCT l_orderkey AS variant_uri, CAST(0 AS BIGINT) AS sps_id, CAST(CASE l_orderkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 66 WHEN 2 THEN 100 ELSE 77 END + CASE WHEN l_orderkey % 89 = 0 THEN 10 ELSE 0 END AS BIGINT) AS profile_idc,
             CAST(CASE WHEN l_orderkey % 47 = 0 THEN 2 ELSE 1 END AS BIGINT) AS chroma_format, l_orderkey % 97 = 0 AS separate_planes, CAST(CASE WHEN l_orderkey % 53 = 0 THEN 10 ELSE 8 END AS BIGINT) AS bit_depth_luma,
             CAST(8 AS BIGINT) AS bit_depth_chroma, l_orderkey % 59 <> 0 AS frame_mbs_only, l_orderkey % 61 = 0 AS sps_scaling, l_orderkey % 67 <> 0 AS direct_8x8, CAST(CASE WHEN l_orderkey % 10 = 0 THEN 2 ELSE 0 END AS BIGINT) AS poc_type
      FROM {lineitem}
    """
