"""The registered queries over the views, each with a SQL twin for DuckDB where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions import bytefields as B
from reelmill.functions import scalars as S
from reelmill.operators import abr, clocks, containers, manifests, pictures, playback, segments, transport
from reelmill.plans import views as V
from reelmill.plans.views import bind, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, longs: str = "") -> Callable:
    """Registers a query with its SQL twin; longs names columns of the twin to be widened."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: V.longs(f(lambda view: bind(spark, sf_dir, view("spark")), spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = duck(f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in longs.split())}) FROM ({sql})" if longs else sql)
        return f

    return add


SEG, AUD, PTS, VAR, SNAP, FETCH, PLAY, AU, PCM, MP4 = (f"({v('duck')})" for v in (V.v_seg, V.v_audio_seg, V.v_pts, V.v_variants, V.v_snap, V.v_fetch, V.v_play, V.v_au, V.v_pcm, V.v_mp4))


# --- segments -------------------------------------------------------------------------------------------------------


@query(f"""SELECT playlist_uri, sequence, CAST(round(duration * 90000) AS BIGINT) AS duration90k,
           CAST(coalesce(sum(CAST(round(duration * 90000) AS BIGINT)) OVER (PARTITION BY playlist_uri ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start90k FROM {SEG}""")
def segment_timeline(view, spark, sf):
    return segments.segment_timeline(view(V.v_seg)).select("playlist_uri", "sequence", "duration90k", "start90k")


@query(f"SELECT playlist_uri, count(*) AS segment_count, min(sequence) AS first_sequence, max(sequence) AS last_sequence, CAST(round(sum(round(duration * 90000)) / 90) AS BIGINT) AS duration_ms FROM {SEG} GROUP BY 1")
def playlist_summary(view, spark, sf):
    return segments.playlist_summary(view(V.v_seg))


@query(f"""SELECT playlist_uri, min(CASE WHEN discontinuity_sequence <> 0 THEN sequence END) AS first_offending, max(discontinuity_sequence) = 0 AS is_single FROM {SEG} GROUP BY 1""")
def single_epoch(view, spark, sf):
    return segments.single_epoch(view(V.v_seg))


@query(f"""WITH j AS (SELECT v.*, a.duration AS ad, a.discontinuity_sequence AS dd, sum(CAST(round((v.duration - coalesce(a.duration, 0)) * 1e9) AS BIGINT)) OVER (PARTITION BY v.playlist_uri ORDER BY v.sequence) / 1e9 AS drift
             FROM {SEG} v LEFT JOIN {AUD} a USING (playlist_uri, sequence))
           SELECT playlist_uri, sequence, round(drift, 6) AS drift, CASE WHEN ad IS NULL THEN 'missing_sequence' WHEN dd <> discontinuity_sequence THEN 'discontinuity_mismatch'
             WHEN round(abs(duration - ad), 9) > 0.05 THEN 'duration_mismatch' WHEN abs(drift) > 0.1 THEN 'boundary_drift' END AS violation FROM j""")
def pair_renditions(view, spark, sf):
    paired = segments.pair_renditions(view(V.v_seg), view(V.v_audio_seg), duration_tolerance=0.05, drift_tolerance=0.1)
    return paired.select("playlist_uri", "sequence", F.round("drift", 6).alias("drift"), "violation")


@query(f"""SELECT playlist_uri, requested_uri, coalesce('a' || substr(requested_uri, 2), requested_uri) AS resolved_uri FROM (
             SELECT v.playlist_uri, v.segment_uri AS requested_uri FROM {SEG} v JOIN {AUD} a USING (playlist_uri, sequence))
           UNION ALL SELECT v.playlist_uri, v.segment_uri, v.segment_uri FROM {SEG} v WHERE (playlist_uri + sequence) % 17 = 0
           UNION ALL SELECT playlist_uri, 'x' || segment_uri, 'x' || segment_uri FROM {SEG} WHERE sequence = 0""")
def resolve_rendition(view, spark, sf):
    seg = view(V.v_seg)
    asked = seg.select("playlist_uri", F.col("segment_uri").alias("requested_uri")).unionByName(seg.filter("sequence = 0").select("playlist_uri", F.concat(F.lit("x"), "segment_uri").alias("requested_uri")))
    return segments.resolve_rendition(asked, seg, view(V.v_audio_seg)).select("playlist_uri", "requested_uri", "resolved_uri")


@query(f"SELECT playlist_uri, sequence, (playlist_uri % 2 = 0) AS is_end_list FROM (SELECT *, row_number() OVER (PARTITION BY playlist_uri ORDER BY sequence) u, row_number() OVER (PARTITION BY playlist_uri ORDER BY sequence DESC) d FROM {SEG}) WHERE CASE WHEN playlist_uri % 2 = 0 THEN u ELSE d END <= 2")
def probe_sample(view, spark, sf):
    return segments.probe_sample(view(V.v_seg).withColumn("is_end_list", F.col("playlist_uri") % 2 == 0)).select("playlist_uri", "sequence", "is_end_list")


@query("""SELECT l_orderkey AS playlist_uri, CAST(l_linenumber AS BIGINT) AS sequence, count(*) AS n, CASE WHEN count(*) > 1 THEN 'duplicate_sequence' END AS violation FROM lineitem GROUP BY 1, 2""")
def ordered_segments(view, spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("playlist_uri"), F.col("l_linenumber").cast("long").alias("sequence"))
    return segments.ordered_segments(raw).groupBy("playlist_uri", "sequence").agg(F.count("*").alias("n"), F.max("violation").alias("violation"))


@query(f"SELECT playlist_uri, count(*) FILTER (WHERE sequence % 3 <> 0) AS n_loaded, count(*) AS n_total, round(count(*) FILTER (WHERE sequence % 3 <> 0) / count(*), 6) AS fraction FROM {SEG} GROUP BY 1")
def load_progress(view, spark, sf):
    return segments.load_progress(view(V.v_seg).withColumn("loaded", F.col("sequence") % 3 != 0)).withColumn("fraction", F.round("fraction", 6))


# --- live snapshots -------------------------------------------------------------------------------------------------


@query(f"SELECT playlist_uri, sequence, min(snapshot_no) AS first_snapshot, arg_min(round(duration, 6), snapshot_no) AS duration FROM {SNAP} GROUP BY 1, 2")
def merge_snapshots(view, spark, sf):
    return segments.merge_snapshots(view(V.v_snap)).select("playlist_uri", "sequence", "first_snapshot", F.round("duration", 6).alias("duration"))


@query(f"SELECT playlist_uri, snapshot_no, sequence FROM (SELECT *, row_number() OVER (PARTITION BY playlist_uri, sequence ORDER BY snapshot_no) k FROM {SNAP}) WHERE k = 1")
def new_segments(view, spark, sf):
    return segments.new_segments(view(V.v_snap)).select("playlist_uri", "snapshot_no", "sequence")


@query(f"SELECT s.playlist_uri, s.snapshot_no, s.sequence FROM {SNAP} s JOIN (SELECT playlist_uri, sequence, arg_min(duration, snapshot_no) AS was FROM {SNAP} GROUP BY 1, 2) f USING (playlist_uri, sequence) WHERE s.duration <> f.was")
def mutations(view, spark, sf):
    return segments.mutations(view(V.v_snap)).select("playlist_uri", "snapshot_no", "sequence")


@query(f"SELECT playlist_uri, sequence, CAST(1 AS BIGINT) AS skipped FROM {SNAP} WHERE snapshot_no = 0 AND sequence >= 1")
def live_edge(view, spark, sf):
    return segments.live_edge(view(V.v_snap)).select("playlist_uri", "sequence", "skipped")


@query(f"""SELECT playlist_uri, snapshot_no, CASE playlist_uri % 11 WHEN 4 THEN 'bad_target_duration' WHEN 3 THEN 'negative_sequence' WHEN 1 THEN CASE WHEN count(*) >= 3 THEN 'sequence_gap' END WHEN 2 THEN CASE WHEN count(*) >= 2 THEN 'bad_duration' END
             WHEN 5 THEN CASE WHEN count(*) > 3 THEN 'sequence_gap' END END AS violation FROM {SNAP} GROUP BY 1, 2""")
def contiguous_window(view, spark, sf):
    """Windows with gaps, durations, targets and sequences that are wrong, in some playlists each."""
    of = F.col("playlist_uri") % 11
    bad = view(V.v_snap).withColumns({
        "sequence": F.col("sequence") + F.when((of == 1) & (F.col("ordinal") == 2) | (of == 5) & (F.col("ordinal") == 3), 1).otherwise(0), "duration": F.when((of == 2) & (F.col("ordinal") == 1), 0.0).otherwise(F.col("duration")),
        "media_sequence": F.when(of == 3, -F.col("media_sequence") - 1).otherwise(F.col("media_sequence")), "target_duration": F.when(of == 4, 0).otherwise(F.col("target_duration")), "discontinuity_sequence": F.lit(0),
    })
    return segments.contiguous_window(bad).select("playlist_uri", "snapshot_no", "violation")


@query(f"""WITH w AS (SELECT playlist_uri, snapshot_no, min(media_sequence) m, max(sequence) l, min(window_discontinuity) d, min(target_duration) t FROM {SNAP} GROUP BY 1, 2),
           p AS (SELECT *, lag(m) OVER k pm, lag(l) OVER k pl, lag(d) OVER k pd, lag(t) OVER k pt, max(l) OVER (PARTITION BY playlist_uri ORDER BY snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) e FROM w WINDOW k AS (PARTITION BY playlist_uri ORDER BY snapshot_no)),
           c AS (SELECT *, CASE WHEN t <> pt THEN 'target_duration_changed' WHEN m < pm OR l < pl THEN 'rewind' WHEN d < pd THEN 'discontinuity_rewind' WHEN m > e + 1 THEN 'expired_gap' WHEN playlist_uri % 13 = 0 AND snapshot_no = 2 THEN 'mutation' WHEN playlist_uri % 13 = 0 AND snapshot_no > 2 THEN NULL END AS code FROM p)
           SELECT playlist_uri, arg_min(code, snapshot_no) FILTER (WHERE code IS NOT NULL) AS violation, min(snapshot_no) FILTER (WHERE code IS NOT NULL) AS violation_snapshot, count(*) AS snapshots FROM c GROUP BY 1""")
def live_violations(view, spark, sf):
    return segments.live_violations(view(V.v_snap))


@query(f"""WITH w AS (SELECT playlist_uri, snapshot_no, min(media_sequence) m, max(sequence) l, count(*) n, min(window_discontinuity) d FROM {SNAP} GROUP BY 1, 2)
           SELECT playlist_uri, snapshot_no, changed, CASE WHEN changed THEN 5000000 ELSE 2500000 END - 1000 * (playlist_uri % 100) AS delay_us FROM (
             SELECT *, coalesce(m <> lag(m) OVER k OR l <> lag(l) OVER k OR n <> lag(n) OVER k OR d <> lag(d) OVER k, true) AS changed FROM w WINDOW k AS (PARTITION BY playlist_uri ORDER BY snapshot_no))""")
def refresh_delays(view, spark, sf):
    changed = segments.snapshot_changes(view(V.v_snap))
    return changed.select("playlist_uri", "snapshot_no", "changed", S.refresh_delay_us(F.lit(5_000_000), "changed", 1000 * (F.col("playlist_uri") % 100)).alias("delay_us"))


# --- manifests and ladders ------------------------------------------------------------------------------------------


def _masters(found: DataFrame) -> DataFrame:
    """Master playlists written from a variants table."""
    attr = F.concat_ws(",", F.concat(F.lit("BANDWIDTH="), F.col("bandwidth").cast("string")), F.concat(F.lit("RESOLUTION="), "resolution"), F.concat(F.lit('CODECS="'), "codecs", F.lit('"')), F.lit("AUDIO=a"))
    line = F.concat(F.lit("#EXT-X-STREAM-INF:"), attr, F.lit("\r\n\n"), "uri")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n")
    return found.groupBy(F.col("master_uri").alias("uri")).agg(F.concat(F.lit("#EXTM3U\n"), body).alias("text")).withColumn("snapshot_no", F.lit(0))


def _playlists(seg: DataFrame) -> DataFrame:
    """Media playlists written from a segments table; some carry tags that the pipeline cannot take, or no end."""
    gap = F.when(F.col("chg") == 1, "#EXT-X-DISCONTINUITY\n").otherwise("")
    line = F.concat(gap, F.lit("#EXTINF:"), F.col("duration").cast("string"), F.lit(",\n"), "segment_uri")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", line.alias("line")))), lambda x: x["line"]), "\n")
    from pyspark.sql import Window

    w = Window.partitionBy("playlist_uri").orderBy("sequence")
    seg = seg.withColumn("chg", (F.col("discontinuity_sequence") - F.coalesce(F.lag("discontinuity_sequence").over(w), F.lit(0))).cast("int"))
    key = F.col("playlist_uri") % 11
    tag = F.when(key == 1, '#EXT-X-KEY:METHOD=AES-128,URI="k"\n').when(key == 2, "#EXT-X-KEY:METHOD=NONE\n").when(key == 3, '#EXT-X-MAP:URI="i"\n').when(key == 4, "#EXT-X-GAP\n").when(key == 5, "#EXT-X-BYTERANGE:1@2\n").otherwise("")
    end = F.when(key == 6, "").when(key == 7, "\n#EXT-X-ENDLIST-NOT-REAL").otherwise("\n#EXT-X-ENDLIST")
    text = F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-MEDIA-SEQUENCE:0\n"), tag, "body", end)
    return seg.groupBy("playlist_uri").agg(body.alias("body")).select(F.col("playlist_uri").alias("uri"), F.lit(0).alias("snapshot_no"), text.alias("text"))


@query(f"SELECT master_uri, ordinal, uri, bandwidth, resolution, codecs FROM {VAR}")
def parse_variants(view, spark, sf):
    made = _masters(view(V.v_variants)).withColumnRenamed("uri", "master_uri")
    return manifests.variants(made, ("master_uri",)).select("master_uri", "ordinal", "uri", "bandwidth", "resolution", "codecs")


@query(f"SELECT playlist_uri, sequence AS ordinal, sequence, segment_uri, duration, discontinuity_sequence FROM {SEG}")
def parse_segments(view, spark, sf):
    made = _playlists(view(V.v_seg)).withColumnRenamed("uri", "playlist_uri")
    return manifests.segments(made, ("playlist_uri",))


@query(f"""SELECT playlist_uri, 'media' AS kind, playlist_uri % 11 NOT IN (6, 7) AS is_end_list, CASE playlist_uri % 11 WHEN 1 THEN 'encrypted' WHEN 3 THEN 'initialization_map' WHEN 4 THEN 'gap' WHEN 5 THEN 'byte_range' END AS unsupported FROM (SELECT DISTINCT playlist_uri FROM {SEG})
           """)
def manifest_audit(view, spark, sf):
    return manifests.audit(_playlists(view(V.v_seg)).withColumnRenamed("uri", "playlist_uri"), ("playlist_uri",))


@query(f"""SELECT master_uri, uri, row_number() OVER (PARTITION BY master_uri ORDER BY coalesce(nullif(bandwidth, 0), 2147483647), uri) - 1 AS ladder_index,
             CASE WHEN regexp_matches(resolution, '^\\d+[xX]\\d+$') THEN CAST(regexp_extract(resolution, '^(\\d+)', 1) AS BIGINT) * CAST(regexp_extract(resolution, '(\\d+)$', 1) AS BIGINT) END AS pixels,
             coalesce(resolution || ' · ', '') || CASE WHEN bandwidth IS NULL THEN '? kbps' ELSE CAST(CAST(round(bandwidth / 1000) AS BIGINT) AS VARCHAR) || ' kbps' END AS label FROM {VAR}""")
def rank_ladder(view, spark, sf):
    return manifests.rank_ladder(view(V.v_variants)).select("master_uri", "uri", "ladder_index", "pixels", "label")


@query(f"""SELECT uri, coalesce(regexp_matches(lower(codecs), 'mp4a\\.40\\.2(,|$)'), false) AS aac_lc, coalesce(regexp_matches(lower(codecs), 'mp4a\\.40\\.(5|29)(,|$)'), false) AS he_aac,
             CASE WHEN codecs LIKE 'hvc1%' THEN 'unsupported advertised video codec hvc1.1.6.L93' END AS reason FROM {VAR}""")
def codec_flags(view, spark, sf):
    c = F.col("codecs")
    return view(V.v_variants).select("uri", manifests.advertises_aac_lc(c).alias("aac_lc"), manifests.advertises_he_aac(c).alias("he_aac"), manifests.unsupported_video_codec(c).alias("reason"))


@query(f"""SELECT master_uri, uri FROM (SELECT *, row_number() OVER (PARTITION BY master_uri ORDER BY CASE WHEN ordinal = 3 THEN 0 ELSE 1 END, coalesce(bandwidth, 2147483647), uri) k FROM {VAR} WHERE regexp_matches(lower(codecs), 'mp4a\\.40\\.2(,|$)')) WHERE k = 1""")
def pick_audio(view, spark, sf):
    return manifests.pick_audio(view(V.v_variants), F.col("ordinal") == 3).select("master_uri", "uri")


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY master_uri ORDER BY coalesce(bandwidth, 2147483647), uri) - 1 AS i FROM {VAR})
           SELECT master_uri, coalesce(max(i) FILTER (WHERE resolution IN ('640x360', '1280X720') AND coalesce(bandwidth, 0) <= 3000000), 0) AS ceiling_index FROM l GROUP BY 1""")
def automatic_ceiling(view, spark, sf):
    return manifests.automatic_ceiling(manifests.rank_ladder(view(V.v_variants)), 1280 * 720, 3_000_000)


@query(f"SELECT master_uri, coalesce(string_agg(DISTINCT CASE WHEN codecs LIKE 'hvc1%' THEN 'unsupported advertised video codec hvc1.1.6.L93' END, '|'), '') AS reasons FROM {VAR} GROUP BY 1")
def rejection_reasons(view, spark, sf):
    return manifests.rejection_reasons(view(V.v_variants)).select("master_uri", F.array_join("reasons", "|").alias("reasons"))


@query(f"SELECT master_uri, uri, row_number() OVER (PARTITION BY master_uri ORDER BY CASE WHEN lower(codecs) LIKE '%avc1.42%' THEN 0 ELSE 1 END, ordinal) - 1 AS probe_order FROM {VAR}")
def baseline_first(view, spark, sf):
    return manifests.baseline_first(view(V.v_variants)).select("master_uri", "uri", "probe_order")


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY master_uri ORDER BY coalesce(bandwidth, 2147483647), uri) - 1 AS i FROM {VAR}),
           r AS (SELECT master_uri, uri AS requested_uri FROM {VAR} WHERE ordinal = 2 UNION ALL SELECT DISTINCT master_uri, 'none' FROM {VAR})
           SELECT r.master_uri, r.requested_uri, l.uri, l.i AS ladder_index, r.requested_uri = 'none' AS fell_back FROM r JOIN l ON r.master_uri = l.master_uri AND CASE WHEN r.requested_uri = 'none' THEN l.i = 0 ELSE l.uri = r.requested_uri END""")
def initial_selection(view, spark, sf):
    found = view(V.v_variants)
    asked = found.filter("ordinal = 2").select("master_uri", F.col("uri").alias("requested_uri")).unionByName(found.select("master_uri", F.lit("none").alias("requested_uri")).distinct())
    return manifests.initial_selection(manifests.rank_ladder(found), asked)


@query(r"""WITH b AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
           c AS (SELECT *, CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM b),
           d AS (SELECT *, CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END AS parent FROM c)
           SELECT page_id, ref, CASE ref WHEN 'a/b.ts' THEN origin || folder || ref WHEN '/root.ts?x=1' THEN origin || ref WHEN '//cdn.example.org/a.ts' THEN scheme || ref WHEN '../up.ts' THEN origin || parent || 'up.ts'
             WHEN './s/../t.ts' THEN origin || folder || 't.ts' WHEN '?q=1' THEN origin || path || ref ELSE ref END AS resolved
           FROM d, (VALUES ('a/b.ts'), ('/root.ts?x=1'), ('//cdn.example.org/a.ts'), ('../up.ts'), ('./s/../t.ts'), ('?q=1'), ('https://other.example/z.ts')) AS r(ref)""")
def resolve_uri(view, spark, sf):
    refs = ["a/b.ts", "/root.ts?x=1", "//cdn.example.org/a.ts", "../up.ts", "./s/../t.ts", "?q=1", "https://other.example/z.ts"]
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.explode(F.array(*map(F.lit, refs))).alias("ref"))
    return rows.select("page_id", "ref", S.resolve_uri("url", "ref").alias("resolved"))


# --- clocks ---------------------------------------------------------------------------------------------------------


@query(f"SELECT stream_id, ord, true90k - first_value(true90k) OVER w + first_value(raw90k) OVER w AS unwrapped90k FROM {PTS} WINDOW w AS (PARTITION BY stream_id ORDER BY ord)")
def unwrap_clock(view, spark, sf):
    rows = view(V.v_pts).withColumn("piece", F.floor(F.col("ord") / 4096))
    return clocks.unwrap_clock(rows, block="piece").select("stream_id", "ord", "unwrapped90k")


_EPOCHS = f"""p AS (SELECT *, true90k - lag(true90k) OVER (PARTITION BY stream_id, epoch ORDER BY ord) AS step FROM {PTS}),
           e AS (SELECT stream_id, epoch, arg_min(true90k, ord) AS f, arg_max(true90k, ord) AS l, arg_max(step, ord) FILTER (WHERE step > 0) AS c, epoch * 90000000000 AS el FROM p GROUP BY 1, 2),
           t(stream_id, epoch, f, t, first, last, cad) AS (
             SELECT stream_id, epoch, f, f, f, l, c FROM e WHERE (stream_id, epoch) IN (SELECT stream_id, min(epoch) FROM e GROUP BY 1)
             UNION ALL SELECT e.stream_id, e.epoch, e.f, greatest(t.last + coalesce(t.cad, 1), t.first + e.el), t.first, greatest(t.last + coalesce(t.cad, 1), t.first + e.el) + e.l - e.f,
               coalesce(e.c, greatest(t.last + coalesce(t.cad, 1), t.first + e.el) - t.last) FROM t JOIN e ON e.stream_id = t.stream_id AND e.epoch = t.epoch + 1)"""


@query(f"WITH RECURSIVE {_EPOCHS} SELECT p.stream_id, p.ord, t.t + p.true90k - t.f AS timeline90k FROM p JOIN t USING (stream_id, epoch)")
def rebase_epochs(view, spark, sf):
    rows = view(V.v_pts).withColumn("elapsed", F.col("epoch") * 90_000_000_000)
    return clocks.rebase_epochs(rows, "true90k", elapsed="elapsed").select("stream_id", "ord", "timeline90k")


@query(f"WITH RECURSIVE {_EPOCHS} SELECT p.stream_id, p.ord, t.t + p.true90k + 900 - t.f AS timeline90k FROM p JOIN t USING (stream_id, epoch)")
def shared_epoch(view, spark, sf):
    rows = view(V.v_pts).withColumn("elapsed", F.col("epoch") * 90_000_000_000)
    audio = rows.select("stream_id", "epoch", "ord", F.pmod(F.col("true90k") + 900, F.lit(V.M)).alias("raw90k"))
    return clocks.shared_epoch(audio, clocks.epoch_table(rows, "true90k", elapsed="elapsed")).select("stream_id", "ord", "timeline90k")


@query(f"""WITH r AS (SELECT *, last_value(anchor90k IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN anchor90k IS NOT NULL THEN au_no END IGNORE NULLS) OVER b AS li,
             first_value(anchor90k IGNORE NULLS) OVER a AS rv, first_value(CASE WHEN anchor90k IS NOT NULL THEN au_no END IGNORE NULLS) OVER a AS ri
             FROM {AU} WINDOW b AS (PARTITION BY stream_id ORDER BY au_no ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY stream_id ORDER BY au_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
           k AS (SELECT stream_id, au_no, anchor90k, row_number() OVER (PARTITION BY stream_id ORDER BY au_no DESC) n FROM {AU} WHERE anchor90k IS NOT NULL),
           t AS (SELECT x.stream_id, CAST(round((x.anchor90k - y.anchor90k) / (x.au_no - y.au_no)) AS BIGINT) AS cad FROM k x JOIN k y ON x.stream_id = y.stream_id AND x.n = 1 AND y.n = 2)
           SELECT r.stream_id, r.au_no, CASE WHEN anchor90k IS NOT NULL THEN anchor90k WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv + coalesce(cad, 0) * (au_no - li)
             ELSE lv + CAST(round((rv - lv) * (au_no - li) / (ri - li)) AS BIGINT) END AS pts90k FROM r LEFT JOIN t USING (stream_id)""")
def interpolate_pts(view, spark, sf):
    return clocks.interpolate_pts(view(V.v_au)).select("stream_id", "au_no", "pts90k")


@query(f"SELECT stream_id, ord, CASE WHEN true90k <= first_value(true90k) OVER w THEN 0 ELSE CAST(round((true90k - first_value(true90k) OVER w) / 90) AS BIGINT) END AS pts_ms FROM {PTS} WINDOW w AS (PARTITION BY stream_id ORDER BY ord)")
def normalize_ms(view, spark, sf):
    return clocks.normalize_ms(view(V.v_pts), "true90k").select("stream_id", "ord", "pts_ms")


@query(f"""WITH i AS (SELECT *, count(anchor90k) OVER (PARTITION BY stream_id ORDER BY au_no) AS g FROM {AU})
           SELECT stream_id, au_no, first_value(anchor90k) OVER w + (row_number() OVER w - 1) * 1024 * 90000 // 44100 AS pts90k FROM i WINDOW w AS (PARTITION BY stream_id, g ORDER BY au_no)""")
def frame_clock(view, spark, sf):
    rows = view(V.v_au).withColumns({"sample_count": F.lit(1024), "sampling_frequency": F.lit(44100)})
    return clocks.frame_clock(rows, order="au_no").select("stream_id", "au_no", "pts90k")


@query(f"""WITH a AS (SELECT stream_id, first_vcl_offset - ord % 150 AS pos, true90k FROM {AU} WHERE ord % 3 = 0),
           m AS (SELECT a.*, u.au_no FROM a ASOF JOIN {AU} u ON a.stream_id = u.stream_id AND a.pos <= u.first_vcl_offset)
           SELECT stream_id, au_no, arg_max(true90k, pos) AS pts90k FROM m GROUP BY 1, 2""")
def anchor_to_unit(view, spark, sf):
    units = view(V.v_au)
    anchors = units.filter("ord % 3 = 0").select("stream_id", (F.col("first_vcl_offset") - F.col("ord") % 150).alias("offset"), F.col("true90k").alias("pts90k"), "ord")
    return clocks.anchor_to_unit(anchors, units, order="ord")


@query(f"""WITH f AS (SELECT stream_id, arg_min(raw90k, ord) AS v, (arg_min(true90k, ord) + 44000 + 500 * stream_id) % {V.M} AS a FROM {PTS} GROUP BY 1)
           SELECT stream_id, 44000 + 500 * stream_id AS delta90k, CASE WHEN 44000 + 500 * stream_id > 45000 THEN 'av_misaligned' END AS violation FROM f""")
def av_alignment(view, spark, sf):
    rows = view(V.v_pts)
    audio = rows.withColumn("raw90k", F.pmod(F.col("true90k") + 44_000 + 500 * F.col("stream_id"), F.lit(V.M)))
    return clocks.av_alignment(rows, audio)


@query(f"""SELECT ord, CAST(round(true90k % 1000003 * 44100 / 90000) AS BIGINT) AS scaled, CAST(round(CAST(true90k - raw90k AS DOUBLE) / {V.M}) AS BIGINT) * {V.M} AS epoch_offset,
             CASE WHEN raw90k > {V.M // 2} THEN raw90k - {V.M} ELSE raw90k END AS delta FROM {PTS}""")
def clock_scalars(view, spark, sf):
    return view(V.v_pts).select("ord", S.scale_ticks(F.col("true90k") % 1000003, 90_000, 44_100).alias("scaled"), S.nearest_epoch_offset("raw90k", "true90k").alias("epoch_offset"), S.wrap_delta(F.lit(0), "raw90k").alias("delta"))


# --- transport ------------------------------------------------------------------------------------------------------


def v_ts(d: str) -> str:
    """188-byte packets: pid 256 + user_id % 4, counters that run on except that error rows skip one and view rows repeat
    the last; signup rows start a unit with a PES header that carries the raw clock."""
    hexed = "lpad(hex({}), {}, '0')" if d == "spark" else "lpad(to_hex({}), {}, '0')"
    h = lambda x, n: hexed.format(f"CAST({x} AS BIGINT)", n)
    sr = (lambda x, n: f"shiftright({x}, {n})") if d == "spark" else (lambda x, n: f"(({x}) >> {n})")
    clock = f"""{h(f"33 + 2 * {sr('raw90k', 30)}", 2)} || {h(f"{sr('raw90k', 22)} % 256", 2)} || {h(f"1 + 2 * ({sr('raw90k', 15)} % 128)", 2)} || {h(f"{sr('raw90k', 7)} % 256", 2)} || {h("1 + 2 * (raw90k % 128)", 2)}"""
    return f"""
      SELECT stream_id, ord AS packet_no, pid, raw90k, event_type, counter % 16 AS cc, event_type = 'signup' AS starts,
             unhex(rpad('47' || {h("CASE WHEN event_type = 'signup' THEN 64 ELSE 0 END + pid // 256" if d == "duck" else "CASE WHEN event_type = 'signup' THEN 64 ELSE 0 END + pid div 256", 2)} || {h("pid % 256", 2)} || {h("16 + counter % 16", 2)}
               || CASE WHEN event_type = 'signup' THEN '000001E00000' || '8080' || '05' || {clock} ELSE '' END || {h("ord % 251", 2)}, 376, 'F')) AS bytes
      FROM (SELECT *, CAST(sum(CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id, pid ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter
            FROM (SELECT *, 256 + user_id % 4 AS pid FROM ({V.v_pts(d)}) AS p) AS q) AS r
    """


TS = f"({v_ts('duck')})"


@query(f"SELECT stream_id, packet_no, pid, starts AS payload_unit_start, cc AS continuity_counter, CAST(4 AS BIGINT) AS payload_start FROM {TS}")
def ts_headers(view, spark, sf):
    return transport.packet_fields(view(v_ts).drop("pid")).select("stream_id", "packet_no", "pid", "payload_unit_start", "continuity_counter", "payload_start")


@query(f"""SELECT stream_id, pid, packet_no, coalesce(cc = lag(cc) OVER w, false) AS duplicate, coalesce(cc <> lag(cc) OVER w AND cc <> (lag(cc) OVER w + 1) % 16, false) AS continuity_error FROM {TS} WINDOW w AS (PARTITION BY stream_id, pid ORDER BY packet_no)""")
def continuity_check(view, spark, sf):
    return transport.continuity_check(transport.packet_fields(view(v_ts).drop("pid"))).select("stream_id", "pid", "packet_no", "duplicate", "continuity_error")


_ISLANDS = f"""c AS (SELECT *, coalesce(cc = lag(cc) OVER w, false) AS dup, coalesce(cc <> lag(cc) OVER w AND cc <> (lag(cc) OVER w + 1) % 16, false) AS err FROM {TS} WINDOW w AS (PARTITION BY stream_id, pid ORDER BY packet_no)),
           i AS (SELECT *, sum(CASE WHEN NOT dup AND (starts OR err) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, pid ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS island FROM c),
           g AS (SELECT stream_id, pid, island, min(packet_no) AS first_packet, bool_or(starts) AS s, arg_min(err, packet_no) AS e, count(*) AS n_packets, arg_min(raw90k, packet_no) AS pts90k FROM i WHERE NOT dup GROUP BY 1, 2, 3),
           k AS (SELECT *, coalesce(NOT lead(e) OVER (PARTITION BY stream_id, pid ORDER BY island), true) AS whole FROM g)"""


@query(f"WITH {_ISLANDS} SELECT stream_id, pid, row_number() OVER (PARTITION BY stream_id, pid ORDER BY first_packet) - 1 AS pes_no, first_packet, n_packets, pts90k, n_packets * 184 AS n_bytes FROM k WHERE s AND whole")
def assemble_pes(view, spark, sf):
    packets = transport.packet_fields(view(v_ts).drop("pid")).withColumn("payload", F.substring("bytes", 5, 184))
    made = transport.assemble_pes(transport.continuity_check(packets))
    return made.select("stream_id", "pid", "pes_no", "first_packet", "n_packets", B.pes_header("payload")["pts90k"].alias("pts90k"), F.octet_length("payload").alias("n_bytes"))


def _worn(view) -> DataFrame:
    """The packets of v_ts with damage: bad sync bytes, scrambling, discontinuity flags, and unit starts without the marker
    bits of a PES header."""
    n, h = F.col("packet_no"), F.hex("bytes")
    bad, scrambled, flagged = n % 89 == 0, n % 97 == 0, n % 101 == 0
    control = F.when(scrambled & flagged, "B").when(scrambled, "9").when(flagged, "3").otherwise("1")
    head = F.concat(F.when(bad, "48").otherwise("47"), F.substring(h, 3, 4), control, F.substring(h, 8, 1))
    rest = F.when(flagged, F.concat(F.lit("0180"), F.substring(h, 13, 364))).when(F.col("starts") & (n % 5 == 0), F.concat(F.substring(h, 9, 12), F.lit("00"), F.substring(h, 23, 354))).otherwise(F.substring(h, 9, 368))
    return view(v_ts).drop("pid").withColumn("bytes", F.unhex(F.concat(head, rest)))


@query(f"""WITH p AS (SELECT *, packet_no % 89 = 0 AS rej, packet_no % 97 = 0 AS scr, packet_no % 101 = 0 AS flg FROM {TS}),
           l AS (SELECT *, CASE WHEN NOT flg THEN lag(cc) OVER (PARTITION BY stream_id, pid ORDER BY packet_no) END AS prev FROM p WHERE NOT rej),
           c AS (SELECT *, coalesce(NOT scr AND cc = prev, false) AS dup, coalesce(NOT scr AND cc <> prev AND cc <> (prev + 1) % 16, false) AS err FROM l),
           e AS (SELECT *, scr OR flg OR err AS dmg, starts AND NOT scr AND NOT dup AS fresh FROM c),
           i AS (SELECT *, sum(CASE WHEN NOT dup AND (fresh OR dmg) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, pid ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS island FROM e),
           g AS (SELECT stream_id, pid, island, bool_or(fresh) AS s, arg_min(dmg, packet_no) AS d, arg_min(flg, packet_no) AS f, arg_min(packet_no % 5 = 0, packet_no) AS bad FROM i WHERE NOT dup GROUP BY 1, 2, 3),
           k AS (SELECT *, coalesce(NOT lead(d) OVER (PARTITION BY stream_id, pid ORDER BY island), true) AS whole FROM g),
           u AS (SELECT *, sum(CASE WHEN damaged THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY au_no) AS isl FROM {AU}), v AS (SELECT *, bool_or(is_idr) OVER (PARTITION BY stream_id, isl ORDER BY au_no ROWS UNBOUNDED PRECEDING) AS emitted FROM u)
           SELECT * FROM (SELECT stream_id, count(*) FILTER (WHERE NOT rej) AS packets, count(*) FILTER (WHERE rej) AS rejected, count(DISTINCT packet_no // 100) AS segments FROM p GROUP BY 1)
           JOIN (SELECT stream_id, count(*) FILTER (WHERE scr) AS scrambled, count(*) FILTER (WHERE dup) AS duplicates, count(*) FILTER (WHERE err) AS continuity_errors, count(*) FILTER (WHERE flg) AS flagged, count(*) FILTER (WHERE dmg) + any_value((SELECT count(DISTINCT packet_no // 100) FROM p WHERE p.stream_id = e.stream_id AND packet_no // 100 % 10 = 4)) AS discontinuities, count(*) FILTER (WHERE fresh) AS unit_starts FROM e GROUP BY 1) USING (stream_id)
           JOIN (SELECT stream_id, CAST(sum(s % 7) AS BIGINT) AS trailing_bytes, count(*) FILTER (WHERE s % 10 = 4) AS declared, count(*) FILTER (WHERE s % 3 = 2) AS segments_without_pat, count(*) FILTER (WHERE s % 3 = 2) AS segments_without_pmt,
                        CAST(0 AS BIGINT) AS video_pid_changes
                 FROM (SELECT DISTINCT stream_id, packet_no // 100 AS s FROM p) z GROUP BY 1) USING (stream_id)
           JOIN (SELECT stream_id, count(*) FILTER (WHERE s AND whole AND NOT f AND bad) AS malformed_pes FROM k GROUP BY 1) USING (stream_id)
           JOIN (SELECT stream_id, count(*) FILTER (WHERE damaged) AS discarded_pictures, count(*) FILTER (WHERE NOT damaged AND NOT emitted) AS dropped_dependents, count(*) FILTER (WHERE NOT damaged AND emitted) AS emitted_units FROM v GROUP BY 1) USING (stream_id)
           JOIN (SELECT stream_id, count(DISTINCT epoch) AS epochs FROM {PTS} GROUP BY 1) USING (stream_id)""")
def demux_diagnostics(view, spark, sf):
    worn = _worn(view)
    packets = transport.packet_fields(worn)
    checked = transport.continuity_check(packets)
    held = worn.withColumn("segment_seq", F.floor(F.col("packet_no") / 100))
    seg = held.groupBy("stream_id", "segment_seq").agg((F.count("*") * 188).alias("_n")).select("stream_id", "segment_seq", (F.col("_n") + F.col("segment_seq") % 7).alias("n_bytes"), (F.col("segment_seq") % 10 == 4).alias("discontinuity"))
    pes = transport.assemble_pes(checked.withColumn("payload", F.substring("bytes", F.col("payload_start") + 1, F.lit(184))))
    units = pictures.gate_on_keyframe(view(V.v_au))
    psi = program_tables(view)
    return transport.demux_diagnostics(packets, checked, seg, transport.association_tables(psi), transport.program_streams(psi), pes, units, view(V.v_pts))


def program_tables(view) -> DataFrame:
    """Program tables a segment: program 1 on pid 4096; video on pid 256, audio on 257 + segment % 2; every third segment
    has none of its own."""
    seg = view(V.v_au).select("stream_id", "segment_seq").distinct()
    pat = F.lit("00" + "00B00D0001C10000" + "0001F000" + "00000000")
    audio = F.lpad(F.hex((257 + F.col("segment_seq") % 2 + 0xE000).cast("long")), 4, "0")
    pmt = F.concat(F.lit("00" + "02B017" + "0001C10000" + "E100F000" + "1BE100F000" + "0F"), audio, F.lit("F000" + "00000000"))
    both = F.array(F.struct(F.lit(0).alias("packet_no"), F.lit(0).alias("pid"), F.unhex(pat).alias("payload")), F.struct(F.lit(1).alias("packet_no"), F.lit(4096).alias("pid"), F.unhex(pmt).alias("payload")))
    return seg.filter("segment_seq % 3 != 2").select("stream_id", "segment_seq", F.explode(both).alias("_e")).select("stream_id", "segment_seq", "_e.*", F.lit(True).alias("payload_unit_start"), F.lit(True).alias("has_payload"))


# --- pictures -------------------------------------------------------------------------------------------------------


_CLOCKED = f"(SELECT *, au_no * 33 + 5 AS pts_ms, au_no + ord % 5 AS next_no, au_no * 33 - ord % 400 AS now_ms FROM {AU})"


@query(f"""SELECT stream_id, next_no, now_ms, max(u.au_no) AS previous_idr FROM (SELECT DISTINCT stream_id, next_no, now_ms FROM {_CLOCKED} WHERE ord % 7 = 0) p
           LEFT JOIN (SELECT stream_id AS s, au_no, pts_ms FROM {_CLOCKED} WHERE is_idr) u ON u.s = p.stream_id AND u.au_no <= greatest(next_no - 2, 0) AND u.pts_ms < now_ms GROUP BY 1, 2, 3""")
def previous_idr(view, spark, sf):
    units = view(V.v_au).withColumns({"pts_ms": F.col("au_no") * 33 + 5, "next_no": F.col("au_no") + F.col("ord") % 5, "now_ms": F.col("au_no") * 33 - F.col("ord") % 400})
    return pictures.previous_idr(units.filter("ord % 7 = 0"), units)


@query(f"SELECT stream_id, au_no, last_value(CASE WHEN is_idr THEN au_no END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY au_no) AS preceding_idr, first_value(CASE WHEN is_idr THEN au_no END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY au_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_idr FROM {AU}")
def keyframe_navigation(view, spark, sf):
    return pictures.keyframe_navigation(view(V.v_au)).select("stream_id", "au_no", "preceding_idr", "next_idr")


@query(f"""WITH i AS (SELECT *, sum(CASE WHEN damaged THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY au_no) g FROM {AU}),
           f AS (SELECT stream_id, g, min(au_no) FILTER (WHERE is_idr) AS k FROM i GROUP BY 1, 2) SELECT stream_id, au_no, coalesce(au_no >= k, false) AS emitted FROM i JOIN f USING (stream_id, g)""")
def gate_on_keyframe(view, spark, sf):
    return pictures.gate_on_keyframe(view(V.v_au)).select("stream_id", "au_no", "emitted")


@query(f"SELECT stream_id, au_no, disposable AND lateness_ms >= CASE WHEN au_no % 2 = 0 THEN 0 ELSE 100 END AS skip FROM {AU}")
def skip_when_late(view, spark, sf):
    return pictures.skip_when_late(view(V.v_au).withColumn("pixels", F.when(F.col("au_no") % 2 == 0, 1280 * 720).otherwise(640 * 360))).select("stream_id", "au_no", "skip")


@query(f"SELECT stream_id, segment_seq, arg_min(is_idr, au_no) AS safe FROM {AU} GROUP BY 1, 2")
def safe_switch_boundary(view, spark, sf):
    return pictures.safe_switch_boundary(view(V.v_au))


@query(f"""SELECT stream_id, au_no, au_no - li AS distance, CASE WHEN NOT is_idr AND li IS NULL THEN 'before_first_refresh' WHEN is_idr AND au_no - li >= 6 THEN 'window_exceeded' WHEN NOT is_idr AND au_no - li >= 5 THEN 'window_exceeded' END AS violation
           FROM (SELECT *, last_value(CASE WHEN is_idr THEN au_no END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY au_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li FROM {AU})""")
def dependency_window(view, spark, sf):
    return pictures.dependency_window(view(V.v_au), 6).select("stream_id", "au_no", "distance", "violation")


@query(f"""SELECT t.stream_id, t.target_ms, max(u.au_no) AS au_no FROM (SELECT stream_id, au_no * 40 + 10 AS target_ms FROM {AU} WHERE is_idr) t JOIN {AU} u ON u.stream_id = t.stream_id AND u.au_no * 40 BETWEEN t.target_ms - 40 AND t.target_ms GROUP BY 1, 2""")
def unit_at_or_before(view, spark, sf):
    units = view(V.v_au).withColumn("pts_ms", F.col("au_no") * 40)
    return pictures.unit_at_or_before(units.filter("is_idr").select("stream_id", (F.col("pts_ms") + 10).alias("target_ms")), units)


@query(f"""WITH u AS (SELECT *, max(au_no) OVER (PARTITION BY stream_id) // 2 AS next_no FROM {AU}) SELECT stream_id, next_no, CASE WHEN max(au_no) FILTER (WHERE is_idr AND au_no <= next_no) IS NULL THEN 0 ELSE greatest(0, least(next_no - 90, max(au_no) FILTER (WHERE is_idr AND au_no <= next_no))) END AS retain_from FROM u GROUP BY 1, 2""")
def retention_start(view, spark, sf):
    units = view(V.v_au)
    top = units.groupBy("stream_id").agg(F.floor(F.max("au_no") / 2).cast("long").alias("next_no"))
    return pictures.retention_start(units.join(top, "stream_id"))


def v_nal(d: str) -> str:
    return f"""
      SELECT stream_id, au_no AS nal_no, CASE WHEN is_idr THEN 5 WHEN disposable THEN 1 WHEN damaged THEN 9 WHEN ord % 7 = 0 THEN 7 WHEN ord % 7 = 1 THEN 6 ELSE 1 END AS nal_type,
             CASE WHEN ord % 4 = 0 THEN ord % 3 ELSE 0 END AS first_mb, CASE WHEN disposable THEN 0 ELSE 2 END AS nal_ref_idc, CASE WHEN disposable THEN 1 ELSE 0 END AS slice_type, ord % 2 AS pps_id
      FROM ({V.v_au(d)}) AS a
    """


NAL = f"({v_nal('duck')})"
_AUS = f"""s AS (SELECT *, nal_type BETWEEN 1 AND 5 AS vcl, coalesce(lag(nal_type BETWEEN 1 AND 5) OVER (PARTITION BY stream_id ORDER BY nal_no), false) AS open FROM {NAL}),
           n AS (SELECT *, sum(CASE WHEN vcl AND (NOT open OR first_mb = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY nal_no ROWS UNBOUNDED PRECEDING) AS c FROM s),
           x AS (SELECT *, CAST(CASE WHEN vcl THEN c - 1 ELSE c END AS BIGINT) AS au_no, max(c) OVER (PARTITION BY stream_id) AS pictures FROM n), a AS (SELECT * FROM x WHERE au_no < pictures)"""


@query(f"WITH {_AUS} SELECT stream_id, nal_no, au_no FROM a")
def assemble_access_units(view, spark, sf):
    return pictures.assemble_access_units(view(v_nal)).select("stream_id", "nal_no", "au_no")


@query(f"""WITH {_AUS} SELECT stream_id, au_no, bool_or(nal_type = 5) AS is_idr, count(*) AS nal_count,
           coalesce(bool_and(nal_type = 1 AND nal_ref_idc = 0 AND slice_type = 1) FILTER (WHERE vcl), false) AND count(DISTINCT pps_id) FILTER (WHERE vcl) = 1 AND NOT bool_or(nal_type IN (7, 8)) AS disposable FROM a GROUP BY 1, 2""")
def access_units(view, spark, sf):
    return pictures.access_units(pictures.assemble_access_units(view(v_nal)))


@query(f"""SELECT stream_id, string_agg(CASE nal_type WHEN 1 THEN 'nonIDR' WHEN 5 THEN 'IDR' WHEN 6 THEN 'SEI' WHEN 7 THEN 'SPS' ELSE 'AUD' END || '=' || CAST(n AS VARCHAR), ', ' ORDER BY nal_type) AS summary, CAST(sum(n) AS BIGINT) AS nals FROM (SELECT stream_id, nal_type, count(*) n FROM {NAL} GROUP BY 1, 2) GROUP BY 1""")
def nal_histogram(view, spark, sf):
    return pictures.nal_histogram(view(v_nal))


@query(f"SELECT stream_id, au_no, 2 * (au_no - coalesce(last_value(CASE WHEN is_idr THEN au_no END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY au_no), first_value(au_no) OVER (PARTITION BY stream_id ORDER BY au_no))) AS poc FROM {AU}")
def picture_order_count(view, spark, sf):
    """Orders that rise by two from each refresh, given as their low parts of four bits."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("au_no")
    units = view(V.v_au)
    since = F.col("au_no") - F.coalesce(F.last(F.when(F.col("is_idr"), F.col("au_no")), ignorenulls=True).over(w), F.first("au_no").over(w))
    return pictures.picture_order_count(units.select("stream_id", "au_no", "is_idr", (2 * since % 16).alias("lsb"), F.lit(16).alias("max_lsb"), F.lit(True).alias("is_reference"))).select("stream_id", "au_no", "poc")


# --- playback -------------------------------------------------------------------------------------------------------


@query(f"SELECT session_id, ord, CASE WHEN error_kind = 'cancelled' THEN false WHEN status IS NULL THEN true ELSE status IN (408, 429) OR status >= 500 END AS retryable, CASE WHEN attempt >= 5 THEN 4000 ELSE 250 * (1 << (attempt - 1)) END AS backoff_ms FROM {FETCH}")
def retry_policy(view, spark, sf):
    return view(V.v_fetch).select("session_id", "ord", manifests.retryable(F.col("status"), F.col("error_kind")).alias("retryable"), S.retry_backoff_ms("attempt").alias("backoff_ms"))


@query(f"""WITH RECURSIVE f AS (SELECT session_id, ord, n_bytes * 8.0e6 / elapsed_us AS s, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS k FROM {FETCH}),
           r AS (SELECT session_id, ord, k, s AS fast, s AS slow FROM f WHERE k = 1 UNION ALL SELECT f.session_id, f.ord, f.k, r.fast * 0.5::DOUBLE + f.s * 0.5::DOUBLE, r.slow * 0.8::DOUBLE + f.s * 0.2::DOUBLE FROM r JOIN f ON f.session_id = r.session_id AND f.k = r.k + 1)
           SELECT session_id, ord, CAST(round(least(fast, slow)) AS BIGINT) AS estimate_bps FROM r""")
def throughput_estimate(view, spark, sf):
    return playback.throughput_estimate(view(V.v_fetch)).select("session_id", "ord", F.round("estimate_bps").cast("long").alias("estimate_bps"))


_EPISODES = f"""r AS (SELECT *, coalesce(sum(CASE WHEN kind = 'buffer_recovered' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM {PLAY}),
           e AS (SELECT session_id, CAST(episode AS BIGINT) AS episode, arg_min(media_ms, ord) FILTER (WHERE kind IN ('video_starved', 'audio_underrun')) AS start_ms, arg_min(media_ms, ord) FILTER (WHERE kind = 'buffer_recovered') AS end_ms,
             CAST(bool_or(kind = 'video_starved') AS BIGINT) AS starvations, count(*) FILTER (WHERE kind = 'audio_underrun') AS underruns FROM r GROUP BY 1, 2)"""


@query(f"WITH {_EPISODES} SELECT *, CASE WHEN end_ms IS NOT NULL THEN greatest(0, end_ms - start_ms) ELSE 0 END AS rebuffer_ms FROM e WHERE start_ms IS NOT NULL")
def rebuffer_episodes(view, spark, sf):
    return playback.rebuffer_episodes(view(V.v_play))


@query(f"""WITH {_EPISODES}, q AS (SELECT session_id, CAST(sum(starvations) + sum(underruns) AS BIGINT) AS n, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS ms, count(end_ms) AS rec FROM e WHERE start_ms IS NOT NULL GROUP BY 1)
           SELECT p.session_id, count(*) FILTER (WHERE kind = 'quality_switched') AS switches, count(*) FILTER (WHERE kind = 'presented') AS presentation_updates, max(resident_units) AS peak_resident_units,
             coalesce(any_value(n), 0) AS rebuffer_count, coalesce(any_value(ms), 0) AS rebuffer_ms, coalesce(any_value(rec), 0) AS recoveries FROM {PLAY} p LEFT JOIN q USING (session_id) GROUP BY 1""")
def qoe_summary(view, spark, sf):
    return playback.qoe_summary(view(V.v_play))


@query(f"""WITH i AS (SELECT *, sum(CASE WHEN lateness_ms <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) g FROM {PLAY})
           SELECT session_id, ord, CASE WHEN lateness_ms <= 60 THEN row_number() OVER (PARTITION BY session_id, g, lateness_ms <= 60 ORDER BY ord) ELSE 0 END AS run FROM i""")
def consecutive_runs(view, spark, sf):
    return playback.consecutive_runs(view(V.v_play), F.col("lateness_ms") <= 60).select("session_id", "ord", "run")


@query(f"SELECT session_id, ord, greatest(0, max(media_ms + resident_units) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - media_ms) AS video_ahead_ms, least(greatest(0, max(media_ms + resident_units) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - media_ms), resident_units * 10) AS ahead_ms FROM {PLAY}")
def buffer_ahead(view, spark, sf):
    rows = view(V.v_play).withColumns({"pts_ms": F.col("media_ms") + F.col("resident_units"), "audio_ms": F.col("resident_units") * 10})
    return playback.buffer_ahead(rows, "media_ms", audio="audio_ms").select("session_id", "ord", "video_ahead_ms", "ahead_ms")


@query(f"""SELECT p.session_id, p.ord, b.rendition FROM {PLAY} p ASOF LEFT JOIN (SELECT session_id, media_ms, min(ord) AS rendition FROM {PLAY} WHERE kind = 'quality_switched' GROUP BY 1, 2) b ON p.session_id = b.session_id AND p.media_ms >= b.media_ms""")
def quality_at(view, spark, sf):
    rows = view(V.v_play)
    edges = rows.filter("kind = 'quality_switched'").groupBy("session_id", F.col("media_ms").alias("pts_ms")).agg(F.min("ord").alias("rendition"))
    return playback.quality_at(rows.select("session_id", "ord", F.col("media_ms").alias("pts_ms")), edges).select("session_id", "ord", "rendition")


@query(f"""WITH t AS (SELECT session_id, media_ms AS clock_ms FROM {PLAY} WHERE kind = 'quality_switched' GROUP BY 1, 2), f AS (SELECT session_id, media_ms AS pts_ms FROM {PLAY} WHERE kind = 'presented'),
           b AS (SELECT t.session_id, t.clock_ms, max(f.pts_ms) AS best, count(f.pts_ms) AS seen FROM t LEFT JOIN f ON f.session_id = t.session_id AND f.pts_ms <= t.clock_ms GROUP BY 1, 2),
           w AS (SELECT *, seen - coalesce(lag(seen) OVER k, 0) AS due, lag(best) OVER k AS was FROM b WINDOW k AS (PARTITION BY session_id ORDER BY clock_ms))
           SELECT session_id, clock_ms, CASE WHEN best > coalesce(was, -1) THEN best END AS shown_pts, due, CASE WHEN best > coalesce(was, -1) THEN due - 1 ELSE due END AS coalesced, CASE WHEN best > coalesce(was, -1) THEN clock_ms - best END AS lateness_ms FROM w""")
def present_latest(view, spark, sf):
    rows = view(V.v_play)
    ticks = rows.filter("kind = 'quality_switched'").select("session_id", F.col("media_ms").alias("clock_ms")).distinct()
    return playback.present_latest(ticks, rows.filter("kind = 'presented'").select("session_id", F.col("media_ms").alias("pts_ms")))


def _samples(fetches: DataFrame) -> DataFrame:
    """Controller samples of each session: mostly downloads, every fifth a buffer sample that is low in one phase of
    three, now and then a late presentation or a failed download."""
    o = F.col("ord")
    kind = F.when(o % 997 == 0, "failure").when(o % 5 == 0, "buffer").when(o % 7 == 0, "playback").otherwise("download")
    low = F.floor(o / 2000) % 3 == 2
    return fetches.select("session_id", "ord", kind.alias("kind"), "n_bytes", F.floor(F.col("elapsed_us") / 4 + 1).cast("long").alias("elapsed_us"), "segment_us", F.when(low, 2500).otherwise(12_000).alias("video_ms"), F.when(o % 2 == 0, 11_000).alias("audio_ms"), F.lit(True).alias("playing"), (o % 1009 == 0).alias("starved"), F.when(o % 211 == 0, 220).otherwise(20).alias("lateness_ms"))


@query()
def abr_decisions(view, spark, sf):
    return abr.abr_decisions(_samples(view(V.v_fetch)), [250_000, 500_000, 1_500_000])


@query(f"SELECT stream_id AS session_id, segment_seq AS sequence, coalesce(last_value(CASE WHEN safe THEN segment_seq % 3 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY segment_seq), 0) AS active_index FROM (SELECT stream_id, segment_seq, arg_min(is_idr, au_no) AS safe FROM {AU} GROUP BY 1, 2)")
def apply_switches(view, spark, sf):
    safe = pictures.safe_switch_boundary(view(V.v_au)).select(F.col("stream_id").alias("session_id"), F.col("segment_seq").alias("sequence"), "safe", (F.col("segment_seq") % 3).alias("target_index"))
    return abr.apply_switches(safe).select("session_id", "sequence", "active_index")


# --- PCM and containers ---------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT *, greatest(start_frame, 0) AS s, greatest(start_frame + valid_frames, 0) AS e FROM {PCM}), m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY stream_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM p)
           SELECT stream_id, unit_no, greatest(s - prev, 0) AS gap, greatest(0, e - greatest(prev, s)) AS written, greatest(prev, e) AS end_frame, CASE WHEN greatest(s - prev, 0) > 500 THEN 'gap_too_long' END AS violation FROM m""")
def place_blocks(view, spark, sf):
    return playback.place_blocks(view(V.v_pcm), max_gap=500).select("stream_id", "unit_no", "gap", "written", "end_frame", "violation")


@query(f"SELECT stream_id, max(greatest(start_frame + valid_frames, 0)) AS end_frame, greatest(0, max(greatest(start_frame + valid_frames, 0)) - 48000) AS first_available, least(48000, max(greatest(start_frame + valid_frames, 0))) AS available FROM {PCM} GROUP BY 1")
def retained_window(view, spark, sf):
    return playback.retained_window(playback.place_blocks(view(V.v_pcm)), 48_000, 1.0, 10_000_000, 4)


@query(f"""SELECT p.stream_id, unit_no, CASE WHEN start_frame < 0 THEN 'negative' WHEN start_frame < w.first_available THEN 'evicted' WHEN start_frame >= w.end_frame THEN 'pending' ELSE 'available' END AS status
           FROM {PCM} p JOIN (SELECT stream_id, max(greatest(start_frame + valid_frames, 0)) AS end_frame, greatest(0, max(greatest(start_frame + valid_frames, 0)) - 48000) AS first_available FROM {PCM} GROUP BY 1) w ON w.stream_id = p.stream_id""")
def read_status(view, spark, sf):
    rows = view(V.v_pcm)
    held = playback.retained_window(playback.place_blocks(rows), 48_000, 1.0, 10_000_000, 4)
    return playback.read_status(rows, held).select("stream_id", "unit_no", "status")


@query(f"SELECT stream_id, unit_no, CAST(least(greatest(round(least(greatest(sample, -1), 1) * 32768), -32768), 32767) AS BIGINT) AS pcm, greatest(start_frame, 0) * 1000000 // 48000 AS us, (greatest(start_frame, 0) * 1000000 // 48000) * 44100 // 1000000 AS frame FROM {PCM}")
def pcm_scalars(view, spark, sf):
    rows = view(V.v_pcm).withColumn("us", S.frame_to_us("start_frame", 48_000))
    return rows.select("stream_id", "unit_no", S.float_to_pcm16("sample").alias("pcm"), "us", S.us_to_frame("us", 44_100).alias("frame"))


@query(f"SELECT stream_id, unit_no, start_frame >= 10000 AND start_frame < 200000 AS covered FROM {PCM}")
def audio_covers(view, spark, sf):
    rows = view(V.v_pcm)
    ranges = rows.select("stream_id").distinct().withColumns({"start_ms": F.lit(10_000), "end_ms": F.lit(200_000)})
    return playback.audio_covers(rows, ranges, at="start_frame").select("stream_id", "unit_no", "covered")


@query(f"""SELECT file, CAST(base + i AS BIGINT) AS sample_no, delta, CAST(ticks + i * delta AS BIGINT) AS dts FROM (SELECT *, coalesce(sum(count) OVER w, 0) AS base, coalesce(sum(count * delta) OVER w, 0) AS ticks, unnest(range(count)) AS i FROM {MP4} WINDOW w AS (PARTITION BY file ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def expand_runs(view, spark, sf):
    return containers.expand_runs(view(V.v_mp4)).select("file", "sample_no", "delta", "dts")


_SAMPLES = f"""n AS (SELECT file, CAST(sum(count) AS BIGINT) AS total FROM {MP4} GROUP BY 1), s AS (SELECT file, unnest(range(total)) AS sample_no FROM n), z AS (SELECT file, sample_no, 10 + sample_no % 7 AS size FROM s),
           c AS (SELECT *, CASE WHEN sample_no < 4 THEN sample_no // 2 + 1 ELSE (sample_no - 4) // 3 + 3 END AS chunk_no FROM z)"""


@query(f"WITH {_SAMPLES} SELECT file, sample_no, chunk_no, CAST(chunk_no * 1000 + coalesce(sum(size) OVER (PARTITION BY file, chunk_no ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def sample_offsets(view, spark, sf):
    """Two samples in each of chunks 1 and 2, three in each from chunk 3 on."""
    runs = view(V.v_mp4)
    total = runs.groupBy("file", "track").agg(F.sum("count").alias("n"))
    samples = total.select("file", "track", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sample_no")).withColumn("size", 10 + F.col("sample_no") % 7)
    chunks = total.select("file", "track", F.explode(F.sequence(F.lit(1), 2 + F.ceil(F.greatest(F.col("n") - 4, F.lit(0)) / 3))).alias("chunk_no")).withColumn("chunk_offset", F.col("chunk_no") * 1000)
    steps = total.select("file", "track", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("first_chunk"), F.lit(2).alias("samples_per_chunk")), F.struct(F.lit(3).cast("long").alias("first_chunk"), F.lit(3).alias("samples_per_chunk")))).alias("r")).select("file", "track", "r.*")
    return containers.sample_offsets(samples, containers.chunk_samples(steps, chunks)).select("file", "sample_no", "chunk_no", "offset")


@query(f"""WITH e AS (SELECT DISTINCT file, CASE WHEN file % 3 = 0 THEN 500 * 44100 // 1000 ELSE 0 END - file % 5 AS o FROM {MP4}),
           x AS (SELECT file, CAST(base + i AS BIGINT) AS sample_no, CAST(ticks + i * delta AS BIGINT) AS dts FROM (SELECT *, coalesce(sum(count) OVER w, 0) AS base, coalesce(sum(count * delta) OVER w, 0) AS ticks, unnest(range(count)) AS i FROM {MP4} WINDOW w AS (PARTITION BY file ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
           SELECT file, sample_no, dts + sample_no % 4 * 10 + o AS pts, CAST(trunc((dts + sample_no % 4 * 10 + o) * 1000 / 44100) AS BIGINT) AS pts_ms FROM x JOIN e USING (file)""")
def presentation_times(view, spark, sf):
    runs = view(V.v_mp4)
    samples = containers.expand_runs(runs).withColumns({"ctts": F.col("sample_no") % 4 * 10, "timescale": F.lit(44_100)})
    each = runs.select("file", "track").distinct()
    empty = each.filter("file % 3 = 0").select("file", "track", F.lit(0).alias("edit_no"), F.lit(500).cast("long").alias("segment_duration"), F.lit(-1).cast("long").alias("media_time"))
    real = each.select("file", "track", F.lit(1).alias("edit_no"), F.lit(9000).cast("long").alias("segment_duration"), (F.col("file") % 5).alias("media_time"))
    edits = containers.edit_offsets(empty.unionByName(real).withColumns({"rate": F.lit(1), "movie_scale": F.lit(1000), "track_scale": F.lit(44_100)}))
    return containers.presentation_times(samples, edits).select("file", "sample_no", "pts", "pts_ms")
