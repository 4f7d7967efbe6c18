"""Registered queries of ordered state over many streams of which one holds a third of the rows, in pieces; of segments
with counter restarts and declared breaks; of the sealed timeline; and the controller's decisions in recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.operators import clocks, pictures, playback, transport
from reelmill.plans import media_queries as M
from reelmill.plans import queries as Q
from reelmill.plans import views as V
from reelmill.plans.queries import AU, FETCH, PCM, PLAY, SEG, query
from reelmill.sources.files import SealedTimeline, new_folder
from reelmill.streaming import folds
from reelmill.streaming.runs import replay

_HOT = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END"


def v_hot_au(d: str) -> str:
    """Units of as many streams as there are users; stream 0 has a third of them. No window: the order has gaps."""
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)" if d == "spark" else "epoch_us(ts)"
    return f"""
      SELECT {_HOT} AS stream_id, event_id AS au_no, event_id AS ord, event_type = 'signup' AS is_idr, event_type = 'view' AS disposable, event_type = 'error' AND event_id % 3 = 0 AS damaged,
             CASE WHEN event_id % 3 = 0 THEN {V._div(d, us + ' * 9', '100')} END AS anchor90k, CAST(floor(value) AS BIGINT) AS lateness_ms, {V._div(d, 'event_id', '500')} AS piece, {V._div(d, 'event_id', '100')} AS segment_seq
      FROM {{events}}
    """


def v_hot_pcm(d: str) -> str:
    return f"""
      SELECT {_HOT} AS stream_id, event_id AS unit_no, CAST(1024 AS BIGINT) AS valid_frames, event_id * 1000 + CAST(floor(value) AS BIGINT) - 200 AS start_frame, {V._div(d, 'event_id', '500')} AS piece
      FROM {{events}}
    """


HOT_AU, HOT_PCM = f"({v_hot_au('duck')})", f"({v_hot_pcm('duck')})"


@query(Q.ORACLE_SQL["gate_on_keyframe"].replace(V.duck(AU), HOT_AU))
def hot_gate_on_keyframe(view, spark, sf):
    return pictures.gate_on_keyframe(view(v_hot_au), block="piece").select("stream_id", "au_no", "emitted")


@query(Q.ORACLE_SQL["keyframe_navigation"].replace(V.duck(AU), HOT_AU))
def hot_keyframe_navigation(view, spark, sf):
    return pictures.keyframe_navigation(view(v_hot_au), block="piece").select("stream_id", "au_no", "preceding_idr", "next_idr")


@query(Q.ORACLE_SQL["place_blocks"].replace(V.duck(PCM), HOT_PCM))
def hot_place_blocks(view, spark, sf):
    return playback.place_blocks(view(v_hot_pcm), max_gap=500, block="piece").select("stream_id", "unit_no", "gap", "written", "end_frame", "violation")


@query(Q.ORACLE_SQL["consecutive_runs"].replace(V.duck(PLAY), f"(SELECT stream_id AS session_id, ord, lateness_ms FROM {HOT_AU})"))
def hot_consecutive_runs(view, spark, sf):
    rows = view(v_hot_au).withColumnRenamed("stream_id", "session_id")
    return playback.consecutive_runs(rows, F.col("lateness_ms") <= 60, block="piece").select("session_id", "ord", "run")


#: The twin counts units by row numbers; the operator gets them with gaps.
_NUMBERED = f"(SELECT * EXCLUDE (au_no), row_number() OVER (PARTITION BY stream_id ORDER BY ord) - 1 AS au_no FROM {HOT_AU})"


@query(f"SELECT stream_id, n.ord, pts90k FROM ({Q.ORACLE_SQL['interpolate_pts'].replace(V.duck(AU), _NUMBERED)}) JOIN {_NUMBERED} n USING (stream_id, au_no)")
def hot_interpolate_pts(view, spark, sf):
    return clocks.interpolate_pts(view(v_hot_au), order="ord", block="piece").select("stream_id", "ord", "pts90k")


# --- segments whose counters restart, some behind a declared break ---------------------------------------------------


def v_segments(d: str) -> str:
    """Packets of one pid a stream: counters start anew in every segment, error rows skip one and view rows repeat the
    last; signup rows start a unit, and most segments do. Every seventh segment follows a declared discontinuity."""
    start = "event_type = 'signup' OR (rn = 1 AND packet_no % 3 <> 0)"
    return f"""
      SELECT stream_id, packet_no, segment_seq, segment_seq % 7 = 3 AS declared, {start} AS payload_unit_start,
             CAST((rn - 1 + sum(CASE WHEN rn = 1 THEN 0 WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY stream_id, segment_seq ORDER BY packet_no ROWS UNBOUNDED PRECEDING)) % 16 AS BIGINT) AS continuity_counter,
             unhex(CASE WHEN {start} THEN '000001' ELSE '' END || 'AA') AS payload
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_seq ORDER BY packet_no) AS rn
            FROM (SELECT {_HOT} AS stream_id, event_id AS packet_no, {V._div(d, 'event_id', '400')} AS segment_seq, event_type FROM {{events}}) AS a) AS b
    """


_UNITS = f"""p AS (SELECT *, lag(continuity_counter) OVER w AS prev, segment_seq IS DISTINCT FROM lag(segment_seq) OVER w AS fresh_segment FROM ({v_segments('duck')}) WINDOW w AS (PARTITION BY stream_id ORDER BY packet_no)),
           t AS (SELECT *, declared AND fresh_segment AS forgets, prev IS NOT NULL AND NOT (declared AND fresh_segment) AND NOT (fresh_segment AND payload_unit_start) AS told FROM p),
           c AS (SELECT *, coalesce(told AND continuity_counter = prev, false) AS dup, coalesce(told AND continuity_counter <> prev AND continuity_counter <> (prev + 1) % 16, false) AS err FROM t),
           i AS (SELECT *, forgets OR err AS dmg, sum(CASE WHEN NOT dup AND (payload_unit_start OR forgets OR err) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS island FROM c),
           g AS (SELECT stream_id, island, min(packet_no) AS first_packet, bool_or(payload_unit_start) AS s, arg_min(dmg, packet_no) AS d, count(*) AS n_packets FROM i WHERE NOT dup GROUP BY 1, 2),
           k AS (SELECT *, lead(d) OVER (PARTITION BY stream_id ORDER BY island) AS cut FROM g)"""


@query(f"WITH {_UNITS} SELECT stream_id, first_packet, n_packets FROM k WHERE s AND NOT coalesce(cut, false)")
def segment_units(view, spark, sf):
    """Units over segments with restarts and declared breaks, in pieces of a stream."""
    packets = _packets(view(v_segments)).withColumn("pid", F.lit(256))
    checked = transport.continuity_check(packets, segment="segment_seq", declared="discontinuity", block="segment_seq")
    return transport.assemble_pes(checked).select("stream_id", "first_packet", "n_packets")


@query(f"WITH {_UNITS} SELECT stream_id, first_packet, n_packets FROM k WHERE s AND NOT cut")
def carry_segment_units(view, spark, sf):
    """The same units from a stream, with those that a later packet closes."""
    made = replay(_packets(view(v_segments)), lambda s: folds.fold_stream(s, folds.PesCarry, "stream_id", "packet_no", folds.PES_OUT, M._lanes(spark)), "stream_id", "packet_no")
    return made.select("stream_id", "first_packet", "n_packets")


def _packets(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("declared", "discontinuity").withColumns({"has_payload": F.lit(True), "scrambling": F.lit(0), "discontinuity_indicator": F.lit(False)})


# --- sinks, decisions ------------------------------------------------------------------------------------------------


@query(f"""SELECT playlist_uri, sequence, CASE WHEN sequence >= 2 AND playlist_uri % 2 = 0 THEN 'refused' WHEN playlist_uri % 2 = 0 THEN 'sealed' ELSE 'open' END AS state FROM {SEG}
           UNION ALL SELECT DISTINCT playlist_uri, CAST(NULL AS BIGINT), 'sealed' FROM {SEG} WHERE playlist_uri % 2 = 0""")
def sealed_timeline(view, spark, sf):
    """Two commits, the second one twice; the first one seals every other playlist."""
    rows = view(V.v_seg).select("playlist_uri", F.lit("segment").alias("kind"), "sequence")
    ends = rows.filter("playlist_uri % 2 = 0").select("playlist_uri", F.lit("sealed").alias("kind"), F.lit(None).cast("long").alias("sequence")).distinct()
    at, schema = SealedTimeline(new_folder(spark, "timeline")), "playlist_uri long, kind string, sequence long"
    at.commit(rows.filter("sequence < 2").unionByName(ends), 0)
    for _ in range(2):
        at.commit(rows.filter("sequence >= 2"), 1)
    kept = at.rows(spark, schema).select("playlist_uri", "sequence", F.coalesce("seal", F.lit("open")).alias("state"))
    return kept.unionByName(at.refused(spark, schema).select("playlist_uri", "sequence", F.lit("refused").alias("state")))


@query(f"SELECT stream_id, decision FROM ({Q.ORACLE_SQL['audio_decision']}) WHERE ready_at IS NOT NULL OR failed_at IS NOT NULL")
def start_decisions_stream(view, spark, sf):
    """The last word on each stream's start, from rows of all its parts in order."""
    rows = M._ready_rows(view).select("stream_id", "au_no", "new_segment", "is_idr", "audio_ready", "has_audio", "total_segments", "audio_failed")
    made = replay(rows, lambda s: folds.fold_stream(s, lambda: folds.StartDecision(order="au_no"), "stream_id", "au_no", folds.START_OUT), "stream_id", "au_no")
    return made.groupBy("stream_id").agg(F.max_by("decision", "ord").alias("decision"))


#: The samples of queries._samples, numbered in their session.
_SAMPLES = f"""SELECT session_id, ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS k, CASE WHEN ord % 997 = 0 THEN 'failure' WHEN ord % 5 = 0 THEN 'buffer' WHEN ord % 7 = 0 THEN 'playback' ELSE 'download' END AS kind,
             n_bytes * 8e6 / greatest(1, elapsed_us // 4 + 1) AS rate, 10 * greatest(1, elapsed_us // 4 + 1) > 9 * segment_us AS slow_one,
             CASE WHEN ord % 2 = 0 THEN least(11000, CASE WHEN ord // 2000 % 3 = 2 THEN 2500 ELSE 12000 END) ELSE CASE WHEN ord // 2000 % 3 = 2 THEN 2500 ELSE 12000 END END AS ahead_ms,
             ord % 1009 = 0 AS starved, CASE WHEN ord % 211 = 0 THEN 220 ELSE 20 END AS lateness_ms FROM {FETCH}"""

#: What each rule does: the counters it clears, the one it raises and to what, whether it is trouble or calm, its move.
_RULES = """(VALUES ('lags', 'f', NULL, 1, 'trouble', -1, 'bandwidth'), ('room', '', 'f', 4, '', 1, 'headroom'), ('steady', 'f', NULL, 1, '', 0, ''), ('failed', 'f', NULL, 1, 'trouble', -1, 'download_failed'),
             ('dry', 'l', NULL, 1, 'trouble', -2, 'starved'), ('critical', 'l', NULL, 1, 'trouble', -1, 'critical_buffer'), ('low', 'hf', 'l', 2, 'trouble', -1, 'low_buffer'), ('full', 'l', 'h', 8, 'calm', 0, ''), ('half', 'lh', NULL, 1, '', 0, ''),
             ('queue', 'sf', 't', 3, 'trouble', -1, 'queue_starved'), ('late', 'sf', 't', 3, 'trouble', -1, 'late'), ('smooth', 't', 's', 90, 'calm', 0, ''), ('uneven', 'ts', NULL, 1, '', 0, '')) rules(rule, clears, raises, upto, mood, move, reason)"""


def _kept(c: str) -> str:
    return f"CASE WHEN contains(clears, '{c}') THEN 0 WHEN raises = '{c}' THEN CASE WHEN {c} + 1 >= need THEN 0 ELSE {c} + 1 END ELSE {c} END"


DECISIONS_SQL = f"""
    WITH RECURSIVE x AS MATERIALIZED ({_SAMPLES}), rungs AS (SELECT [250000, 500000, 1500000] AS r),
    c(session_id, ord, k, was, i, fast, slow, ahead, constrained, cooldown, f, l, h, s, t, reason) AS (
      SELECT session_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, false, 0, 0, 0, 0, 0, 0, '' FROM x GROUP BY 1
      UNION ALL
      SELECT session_id, ord, k, i, CASE WHEN acts THEN greatest(0, least(2, i + move)) ELSE i END, fast, slow, ahead,
             CASE WHEN acts AND mood = 'trouble' THEN true WHEN acts AND mood = 'calm' THEN false ELSE constrained END, CASE WHEN acts AND mood = 'trouble' THEN 6 ELSE cooldown END,
             {_kept('f')}, {_kept('l')}, CASE WHEN acts AND mood = 'trouble' THEN 0 ELSE {_kept('h')} END, {_kept('s')}, {_kept('t')}, CASE WHEN acts THEN reason ELSE '' END
      FROM (
        SELECT *, raises IS NULL OR CASE raises WHEN 'f' THEN f WHEN 'l' THEN l WHEN 'h' THEN h WHEN 's' THEN s ELSE t END + 1 >= need AS acts
        FROM (
          SELECT m.*, clears, raises, mood, move, rules.reason, CASE WHEN raises = 't' AND NOT constrained THEN 1 ELSE upto END AS need
          FROM (
            SELECT *, CASE kind WHEN 'failure' THEN 'failed'
                WHEN 'download' THEN CASE WHEN i > 0 AND (slow_one OR least(fast, slow) < 1.10 * r[i + 1]) THEN 'lags'
                                          WHEN NOT constrained AND cooldown = 0 AND i < 2 AND ahead >= 8000 AND r[i + 2] <= 0.72 * least(fast, slow) THEN 'room' ELSE 'steady' END
                WHEN 'buffer' THEN CASE WHEN starved THEN 'dry' WHEN ahead <= 1200 THEN 'critical' WHEN ahead < 3000 THEN 'low' WHEN ahead >= 8000 THEN 'full' ELSE 'half' END
                ELSE CASE WHEN starved THEN 'queue' WHEN lateness_ms >= 180 THEN 'late' WHEN lateness_ms <= 60 THEN 'smooth' ELSE 'uneven' END END AS rule
            FROM (
              SELECT x.session_id, x.ord, x.k, x.kind, x.slow_one, x.starved, x.lateness_ms, c.i, c.constrained, c.f, c.l, c.h, c.s, c.t, rungs.r,
                     CASE WHEN x.kind <> 'download' THEN c.fast WHEN c.fast IS NULL THEN x.rate ELSE 0.5::DOUBLE * c.fast + 0.5::DOUBLE * x.rate END AS fast,
                     CASE WHEN x.kind <> 'download' THEN c.slow WHEN c.slow IS NULL THEN x.rate ELSE 0.8::DOUBLE * c.slow + 0.2::DOUBLE * x.rate END AS slow,
                     CASE WHEN x.kind = 'buffer' THEN x.ahead_ms ELSE c.ahead END AS ahead, CASE WHEN x.kind = 'download' THEN greatest(0, c.cooldown - 1) ELSE c.cooldown END AS cooldown
              FROM c JOIN x ON x.session_id = c.session_id AND x.k = c.k + 1, rungs)) m JOIN {_RULES} ON rules.rule = m.rule)))
    SELECT session_id, ord, CAST(was AS BIGINT) AS from_index, CAST(i AS BIGINT) AS to_index, CAST(r[i + 1] AS BIGINT) AS bandwidth, reason FROM c, rungs WHERE k > 0 AND was <> i"""
Q.ORACLE_SQL["abr_decisions"] = Q.ORACLE_SQL["abr_decisions_stream"] = V.duck(DECISIONS_SQL)
