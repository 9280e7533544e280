"""Catalogue operators and sources over the test tables."""
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..functions import tables as fixed
from ..operators import catalog as op
from ..session import work_dir
from ..sources.cues import read_cues
from ..sources.library import classify_library, scan_library as scan_folder
from ..sources.lut import lut_headers, read_lut
from ..sources.probe import read_probe_reports
from ..sources.trace import read_trace_exports
from .tables import EVENTS, FILES, events, files, query


def _sql_list(values):
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


# Streams from parts: brand and type as depth, rate and transfer
_STREAMS = """SELECT p_partkey AS file_id, p_size % 4 AS stream_index, CASE WHEN p_size % 5 = 0 THEN p_size % 16 END AS bits_per_raw_sample,
  CASE p_size % 6 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' WHEN 2 THEN 'yuv444p12be' WHEN 3 THEN 'gray32le' WHEN 4 THEN NULL ELSE 'gbrple' END AS pix_fmt,
  CASE p_size % 4 WHEN 0 THEN '24000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '0/0' ELSE 'bad' END AS avg_frame_rate,
  CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.25' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.1234567' ELSE 'N/A' END AS duration,
  CASE p_type WHEN 'ECONOMY' THEN 'smpte2084' WHEN 'STANDARD' THEN 'arib-std-b67' WHEN 'PROMO' THEN 'bt709' ELSE NULL END AS color_transfer,
  p_size % 7 = 0 AS has_dv, CASE WHEN p_size % 7 = 0 THEN p_size % 3 END AS dv_compatibility_id,
  CASE p_size % 3 WHEN 0 THEN 'mov,mp4' WHEN 1 THEN 'mpegts' ELSE 'matroska,webm' END AS format_name FROM part"""


def _streams(load):
    return load("part").selectExpr(*[
        "p_partkey AS file_id", "p_size % 4 AS stream_index", "CASE WHEN p_size % 5 = 0 THEN p_size % 16 END AS bits_per_raw_sample",
        "CASE p_size % 6 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' WHEN 2 THEN 'yuv444p12be' WHEN 3 THEN 'gray32le' WHEN 4 THEN NULL ELSE 'gbrple' END AS pix_fmt",
        "CASE p_size % 4 WHEN 0 THEN '24000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '0/0' ELSE 'bad' END AS avg_frame_rate",
        "CASE p_size % 3 WHEN 0 THEN concat(p_size, '.25') WHEN 1 THEN concat(p_size, '.1234567') ELSE 'N/A' END AS duration",
        "CASE p_type WHEN 'ECONOMY' THEN 'smpte2084' WHEN 'STANDARD' THEN 'arib-std-b67' WHEN 'PROMO' THEN 'bt709' ELSE NULL END AS color_transfer",
        "p_size % 7 = 0 AS has_dv", "CASE WHEN p_size % 7 = 0 THEN p_size % 3 END AS dv_compatibility_id",
        "CASE p_size % 3 WHEN 0 THEN 'mov,mp4' WHEN 1 THEN 'mpegts' ELSE 'matroska,webm' END AS format_name"])


@query("stream_facts", f"""WITH st AS ({_STREAMS}),
fa AS (SELECT *, CASE WHEN bits_per_raw_sample > 0 THEN bits_per_raw_sample WHEN pix_fmt IS NULL THEN NULL
    ELSE coalesce(TRY_CAST(nullif(regexp_extract(pix_fmt, '([0-9]+)(le|be)$', 1), '') AS INTEGER), 8) END AS d,
  file_id % 3 = 0 AS plus FROM st),
rt AS (SELECT *, CASE WHEN has_dv THEN 'DOVI' WHEN color_transfer = 'smpte2084' THEN CASE WHEN plus THEN 'HDR10PLUS' ELSE 'HDR10' END
  WHEN color_transfer = 'arib-std-b67' THEN 'HLG' ELSE 'SDR' END AS range_type FROM fa)
SELECT file_id, stream_index, CASE WHEN bits_per_raw_sample > 0 OR d BETWEEN 8 AND 16 THEN d END AS bit_depth,
  CASE avg_frame_rate WHEN '24000/1001' THEN 24000::DOUBLE / 1001 WHEN '25/1' THEN 25::DOUBLE END AS frame_rate,
  CASE WHEN duration LIKE '%.25' THEN CAST(split_part(duration, '.', 1) AS BIGINT) * 1000000 + 250000
    WHEN duration LIKE '%.1234567' THEN CAST(split_part(duration, '.', 1) AS BIGINT) * 1000000 + 123456 END AS duration_us,
  range_type, CASE WHEN range_type = 'SDR' OR (range_type = 'DOVI' AND dv_compatibility_id = 2) THEN 'SDR' ELSE 'HDR' END AS range,
  replace(format_name, 'mpegts', 'ts') AS containers FROM rt""")
def stream_facts(load):
    streams = _streams(load)
    first = streams.where("file_id % 3 = 0").select("file_id", "stream_index")
    return op.stream_facts(streams, first, "file_id").select(
        "file_id", "stream_index", "bit_depth", "frame_rate", "duration_us", "range_type", "range", "containers")


# Library paths from page addresses
_MEDIA = """md AS (SELECT page_id, lang || '/' || section || '/' || CASE page_id % 5 WHEN 0 THEN 'Movie' WHEN 1 THEN 'movie 2' WHEN 2 THEN 'clip.en' WHEN 3 THEN 'clip' ELSE '.hid' END
    || CASE WHEN page_id % 4 = 0 THEN '.MKV' ELSE '.mp4' END AS path, page_id * 1000 AS size_bytes
  FROM (SELECT page_id, split_part(url, '/', 4) AS lang, CAST(page_id % 12 AS VARCHAR) AS section FROM pages)),
sb AS (SELECT lang || '/' || section || '/' || CASE page_id % 4 WHEN 0 THEN 'MOVIE.en' WHEN 1 THEN 'movie 2' WHEN 2 THEN 'clip.en.forced' ELSE 'clip10' END || '.' || page_id || '.srt' AS sub
  FROM (SELECT page_id, split_part(url, '/', 4) AS lang, CAST(page_id % 12 AS VARCHAR) AS section FROM pages))"""


def _library(load):
    base = load("pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"), (F.col("page_id") % 12).cast("string").alias("section"))
    media = base.select("page_id", F.concat_ws("/", "lang", "section", F.expr(
        """concat(CASE page_id % 5 WHEN 0 THEN 'Movie' WHEN 1 THEN 'movie 2' WHEN 2 THEN 'clip.en' WHEN 3 THEN 'clip' ELSE '.hid' END,
        CASE WHEN page_id % 4 = 0 THEN '.MKV' ELSE '.mp4' END)""")).alias("path"), (F.col("page_id") * 1000).alias("size_bytes"))
    subs = base.select(F.concat_ws("/", "lang", "section", F.expr(
        """concat(CASE page_id % 4 WHEN 0 THEN 'MOVIE.en' WHEN 1 THEN 'movie 2' WHEN 2 THEN 'clip.en.forced' ELSE 'clip10' END, '.', page_id, '.srt')""")).alias("sub"))
    return media, subs


@query("sidecar_join", f"""WITH {_MEDIA},
mb AS (SELECT *, regexp_extract(path, '^(.*)/', 1) AS folder, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')) AS base FROM md),
ss AS (SELECT sub, regexp_extract(sub, '^(.*)/', 1) AS folder, lower(regexp_replace(regexp_extract(sub, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')) AS sbase FROM sb)
SELECT page_id, path, string_agg(sub, '|' ORDER BY CASE WHEN sub LIKE '%/clip.en%' THEN 1 WHEN sub LIKE '%/MOVIE%' THEN 2 ELSE 3 END,
  CAST(regexp_extract(sub, '([0-9]+)\\.srt$', 1) AS BIGINT)) AS subtitles
FROM mb LEFT JOIN ss ON mb.folder = ss.folder AND (sbase = base OR starts_with(sbase, base || '.')) GROUP BY page_id, path""")
def sidecar_join(load):
    media, subs = _library(load)
    joined = op.sidecar_join(media, subs, "page_id", "path", "sub")
    return joined.select("page_id", "path", F.nullif(F.array_join("subtitles", "|"), F.lit("")).alias("subtitles"))


@query("directory_rollup", f"""WITH {_MEDIA},
an AS (SELECT unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS folder, size_bytes FROM md)
SELECT folder, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS depth,
  CASE WHEN folder LIKE '%/%' THEN split_part(folder, '/', 1) || '/' || lpad(CAST(len(split_part(folder, '/', 2)) AS VARCHAR), 9, '0') || split_part(folder, '/', 2) ELSE folder END AS sort_key FROM an GROUP BY folder""")
def directory_rollup(load):
    media, _ = _library(load)
    return op.directory_rollup(media, "path", "size_bytes").withColumn("depth", F.col("depth").cast("long"))


@query("scan_library", f"""WITH {_MEDIA}, al AS (SELECT path, size_bytes FROM md UNION ALL SELECT sub, 0 FROM sb)
SELECT path, size_bytes, CASE WHEN path LIKE '%.srt' THEN 'subtitle' ELSE 'media' END AS kind FROM al WHERE path NOT LIKE '%/.hid%'""")
def scan_library(load):
    media, subs = _library(load)
    listing = media.select("path", "size_bytes").unionByName(subs.select(F.col("sub").alias("path"), F.lit(0).cast("long").alias("size_bytes")))
    return classify_library(listing, "path", "size_bytes")


_TREE = """split_part(url, '/', 4) || CASE WHEN page_id % 3 = 0 THEN '/_' ELSE '/' END || CAST(page_id % 12 AS VARCHAR) || '/'
  || CASE page_id % 6 WHEN 0 THEN 'Film.' WHEN 1 THEN '_extra.' WHEN 2 THEN '.hidden.' WHEN 3 THEN 'a b.' WHEN 4 THEN '.trash/clip.' ELSE 'deep/er/clip.' END
  || CAST(page_id AS VARCHAR) || CASE page_id % 5 WHEN 0 THEN '.MKV' WHEN 1 THEN '.en.srt' WHEN 2 THEN '.txt' ELSE '.mp4' END"""


def _writer(root):
    """Write (path, content) rows as files below a folder; a repeated task writes the same bytes again."""

    def write(batches):
        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{top}/{path}".rsplit("/", 1)[0])
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    return write


@query("scan_library_tree", f"""SELECT path, size_bytes, CASE WHEN path LIKE '%.srt' THEN 'subtitle' ELSE 'media' END AS kind
FROM (SELECT {_TREE} AS path, strlen(html) AS size_bytes FROM pages) WHERE path NOT LIKE '%/.%' AND path NOT LIKE '%.txt'""")
def scan_library_tree(load):
    """A tree of files with the pages' content, written by tasks and listed."""
    pages = load("pages")
    spark = pages.sparkSession
    root = f"{work_dir(spark)}/library-{uuid.uuid4().hex}"
    root = re.sub(r"^(file:)?/+", "file:///", root)
    files = pages.select(F.expr(_TREE.replace("VARCHAR", "STRING")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    files.mapInArrow(_writer(root), "files long").write.format("noop").mode("overwrite").save()
    return scan_folder(spark, root)


_RULES = "rl AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {_sql_list(c)}, {_sql_list(v)}, {_sql_list(a)})" for n, (c, v, a) in enumerate(fixed.CONTAINER_RULES)
) + ") t(rule_no, containers, videos, audios))"
_ITEM = """p_partkey, CASE p_size % 5 WHEN 0 THEN 'mov, MP4' WHEN 1 THEN ' Matroska,webm' WHEN 2 THEN 'ts' WHEN 3 THEN 'avi' ELSE 'xyz' END AS containers,
  CASE p_partkey % 6 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'vp9' WHEN 3 THEN 'jpeg2000' WHEN 4 THEN 'mpeg2video' ELSE 'wmv3' END AS video,
  CASE p_partkey % 7 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'pcm_s8' WHEN 3 THEN 'dts' WHEN 4 THEN 'wmav2' WHEN 5 THEN 'pcm_f32be' END AS audio"""


@query("container_support", f"""WITH {_RULES}, it AS (SELECT {_ITEM} FROM part)
SELECT p_partkey, containers, video, audio, EXISTS (SELECT 1 FROM rl WHERE list_contains(videos, video) AND (audio IS NULL OR list_contains(audios, audio))
  AND len(list_intersect(rl.containers, list_transform(string_split(it.containers, ','), lambda c: lower(trim(c))))) > 0) AS supported FROM it""")
def container_support(load):
    items = load("part").selectExpr(*_columns(_ITEM))
    return op.container_support(items, fixed.container_rules(items.sparkSession), "containers", "video", "audio")


def _columns(text):
    """The comma-separated expressions of a select list."""
    parts, depth, quoted, current = [], 0, False, ""
    for character in text:
        quoted ^= character == "'"
        if not quoted:
            depth += (character == "(") - (character == ")")
        if character == "," and not depth and not quoted:
            parts.append(current)
            current = ""
        else:
            current += character
    return [part.strip() for part in [*parts, current]]


_TRACKS = """p_partkey AS file_id, p_partkey % 5 AS position, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 23 = 1 THEN -1 ELSE p_size % 6 END AS stream_index,
  CASE WHEN p_size % 3 = 0 THEN 'Video' ELSE ' audio' END AS type, p_size % 4 = 0 AS external"""
_FILE_TRACKS = """fl AS (SELECT DISTINCT p_partkey // 5 AS file_id, CASE WHEN (p_partkey // 5) % 3 = 0 THEN NULL WHEN (p_partkey // 5) % 11 = 1 THEN -2 ELSE (p_partkey // 5) % 6 END AS requested FROM part),
st AS (SELECT p_partkey // 5 AS file_id, p_partkey % 5 AS position, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 23 = 1 THEN -1 ELSE p_size % 6 END AS stream_index,
  CASE WHEN p_size % 3 = 0 THEN 'Video' ELSE ' audio' END AS type, p_size % 4 = 0 AS external FROM part)"""


@query("select_track", f"""WITH {_FILE_TRACKS},
au AS (SELECT file_id, position, coalesce(stream_index, position) AS idx, external, sum(CASE WHEN external THEN 0 ELSE 1 END)
  OVER (PARTITION BY file_id ORDER BY coalesce(stream_index, position), position) AS inside FROM st WHERE upper(trim(type)) = 'AUDIO'),
pk AS (SELECT a.file_id, bool_or(idx < 0) AS bad, min({{'i': idx, 'p': position, 'e': external, 'n': inside}}) FILTER (requested IS NULL OR idx = requested) AS pick
  FROM au a JOIN fl USING (file_id) GROUP BY a.file_id),
ss AS (SELECT fl.file_id, requested, pick, CASE WHEN bad THEN 'invalid' WHEN bad IS NULL THEN 'none' WHEN requested < 0 OR pick IS NULL THEN 'invalid'
  WHEN pick.e THEN 'external' ELSE 'selected' END AS status FROM fl LEFT JOIN pk USING (file_id))
SELECT file_id, requested, status, CASE WHEN status = 'selected' THEN pick.i END AS track_index, CASE WHEN status = 'selected' THEN CAST(pick.n - 1 AS INTEGER) END AS track_ordinal FROM ss""")
def select_track(load):
    part = load("part").withColumn("file_id", F.expr("p_partkey div 5"))
    asked = part.select("file_id").distinct().withColumn("requested", F.expr(
        "CASE WHEN file_id % 3 = 0 THEN NULL WHEN file_id % 11 = 1 THEN -2 ELSE file_id % 6 END"))
    streams = part.select("file_id", *[F.expr(c) for c in _columns(_TRACKS)[1:]])
    return op.select_track(asked, streams, "file_id", "requested")


_LAYERS = """p_partkey // 2 AS file_id, p_partkey % 2 AS stream_index, CASE WHEN p_partkey % 2 = 0 THEN w ELSE CASE WHEN w > 1920 THEN (w + 1) // 2 ELSE w END + CASE WHEN p_size = 7 THEN 1 ELSE 0 END END AS width,
  CASE WHEN p_partkey % 2 = 0 THEN 2161 ELSE CASE WHEN w > 1920 THEN 1081 ELSE 2161 END END AS height,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE 23.976 + CASE WHEN p_size = 9 THEN 0.01 ELSE 0 END END AS average_rate, CASE WHEN (p_partkey // 2) % 2 = 0 THEN 24.0 END AS real_rate,
  p_partkey % 2 = 0 AS is_base, p_partkey % 2 = 1 AND p_size % 8 > 0 AS is_enhancement"""


@query("layer_track_pairs", f"""WITH ly AS (SELECT {_LAYERS} FROM (SELECT *, CASE WHEN (p_partkey // 2) % 3 = 0 THEN 1920 ELSE 3841 END AS w FROM part))
SELECT b.file_id, b.stream_index AS base_index, e.stream_index AS enhancement_index FROM ly b JOIN ly e ON b.file_id = e.file_id AND b.is_base AND e.is_enhancement
WHERE e.width = CASE WHEN b.width > 1920 THEN (b.width + 1) // 2 ELSE b.width END AND e.height = CASE WHEN b.width > 1920 THEN (b.height + 1) // 2 ELSE b.height END
  AND (b.average_rate IS NULL) = (e.average_rate IS NULL) AND coalesce(abs(b.average_rate - e.average_rate) <= 0.001, true)
  AND (b.real_rate IS NULL) = (e.real_rate IS NULL) AND (b.average_rate IS NOT NULL OR b.real_rate IS NOT NULL)""")
def layer_track_pairs(load):
    part = load("part").withColumn("w", F.expr("CASE WHEN (p_partkey div 2) % 3 = 0 THEN 1920 ELSE 3841 END"))
    return op.layer_track_pairs(part.selectExpr(*_columns(_LAYERS.replace("//", "div"))), "file_id")


_FACTS = """p_partkey AS item_id, p_partkey % 50 > 0 AS runtime_available, p_partkey % 49 > 0 AS has_options, CASE WHEN p_partkey % 47 = 0 THEN 'Transcode' ELSE 'DirectPlay' END AS play_method,
  p_partkey % 46 > 0 AS has_source, p_partkey % 45 = 0 AS is_live, CASE WHEN p_partkey % 44 = 0 THEN 'xyz' ELSE 'mp4,mov' END AS containers, p_partkey % 43 > 0 AS start_valid,
  p_partkey % 42 > 0 AS source_valid, p_partkey % 41 > 0 AS url_supported, p_partkey % 40 > 0 AS has_video, CASE p_size % 12 WHEN 0 THEN 'theora' WHEN 1 THEN 'cinepak' WHEN 2 THEN 'AVC' ELSE 'hevc' END AS video_codec,
  CASE WHEN p_partkey % 39 = 0 THEN 90 END AS rotation, p_partkey % 38 = 0 AS fields_apart, CASE WHEN p_partkey % 37 = 0 THEN 'hdr-codec-unsupported' WHEN p_partkey % 36 = 0 THEN 'hdr-presentation-unavailable' END AS video_reason,
  p_partkey % 35 = 0 AS scan_refused, CASE WHEN p_partkey % 34 = 0 THEN 'audio-layout-unsupported' END AS audio_reason, p_partkey % 33 > 0 AS container_supported, p_partkey % 32 > 0 AS source_runtime_available"""
_LADDER = f"""fc AS (SELECT {_FACTS} FROM part), rs AS (SELECT item_id, CASE WHEN NOT runtime_available THEN 'runtime-unavailable' WHEN NOT has_options THEN 'invalid-options' WHEN play_method <> 'DirectPlay' THEN 'play-method-unsupported'
  WHEN NOT has_source THEN 'invalid-options' WHEN is_live THEN 'live-stream-unsupported' WHEN containers = 'xyz' THEN 'container-unsupported' WHEN NOT start_valid OR NOT source_valid THEN 'invalid-options'
  WHEN NOT url_supported THEN 'url-unsupported' WHEN NOT has_video THEN 'video-track-unavailable' WHEN video_codec = 'theora' THEN 'video-codec-without-route' WHEN video_codec = 'cinepak' THEN 'codec-unsupported'
  WHEN rotation <> 0 THEN 'rotation-unsupported' WHEN fields_apart THEN 'interlaced-video-unsupported' WHEN video_reason IS NOT NULL THEN video_reason WHEN scan_refused THEN 'interlaced-video-unsupported'
  WHEN audio_reason IS NOT NULL THEN audio_reason WHEN NOT container_supported THEN 'container-unsupported' WHEN NOT source_runtime_available THEN 'runtime-unavailable' END AS reason FROM fc)"""


@query("eligibility_funnel", f"WITH {_LADDER} SELECT item_id, reason, reason IS NULL AS eligible FROM rs")
def eligibility_funnel(load):
    return op.eligibility_funnel(load("part").selectExpr(*_columns(_FACTS))).select("item_id", "reason", "eligible")


@query("eligibility_reason_counts", f"""WITH {_LADDER} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS items,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM rs) AS share FROM rs GROUP BY coalesce(reason, 'eligible')""")
def eligibility_reason_counts(load):
    return op.reason_counts(op.eligibility_funnel(load("part").selectExpr(*_columns(_FACTS))))


_AGENT = """CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1 CriOS/120'
  WHEN 1 THEN 'Mozilla/5.0 (iPad; CPU OS 18_6 like Mac OS X) AppleWebKit/605.1 FxiOS/120' WHEN 2 THEN 'Mozilla/5.0 (Macintosh) AppleWebKit/605.1 Version/27.1 Safari/605.1'
  WHEN 3 THEN 'Mozilla/5.0 (Macintosh) AppleWebKit/605.1 Version/26.0 Safari/605.1' WHEN 4 THEN 'Mozilla/5.0 (X11) AppleWebKit/537 Chrome/120 Safari/537' ELSE 'Mozilla/5.0 Gecko Firefox/120' END"""


@query("known_defects", f"""WITH {EVENTS},
ag AS (SELECT event_id, event_id % 6 AS g, k, CASE WHEN k % 3 = 0 THEN 'mp4a.40.2' ELSE 'opus' END AS codec, k % 8 AS channels, CASE WHEN k % 5 = 0 THEN 'check' ELSE 'decode' END AS kind FROM ev),
id AS (SELECT *, CASE WHEN g < 4 THEN 'webkit' ELSE 'other' END AS engine, CASE g WHEN 0 THEN 17 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN NULL ELSE 18 END WHEN 2 THEN 27 WHEN 3 THEN 26 END AS engine_major FROM ag)
SELECT event_id, engine, engine_major, CASE WHEN engine = 'webkit' AND kind = 'decode' AND coalesce(engine_major < 27, true) AND starts_with(codec, 'mp4a.40.') AND channels > 2 THEN 1
  WHEN engine = 'webkit' AND kind = 'decode' AND starts_with(codec, 'op') AND channels > 6 THEN 2 END AS defect_no FROM id""")
def known_defects(load):
    ev = events(load).select(
        "event_id", F.expr(_AGENT).alias("agent"), F.lit(None).cast("string").alias("vendor"), (F.col("k") % 2 == 0).alias("audio_decoder"),
        F.lit("audio").alias("media"), F.expr("CASE WHEN k % 5 = 0 THEN 'check' ELSE 'decode' END").alias("kind"),
        F.expr("CASE WHEN k % 3 = 0 THEN 'mp4a.40.2' ELSE 'opus' END").alias("codec"), (F.col("k") % 8).alias("channels"))
    calls = op.browser_identity(ev, "agent", "vendor", "audio_decoder")
    defects = ev.sparkSession.createDataFrame(
        [(1, "webkit", 27, "audio", "decode", "mp4a.40.", 2), (2, "webkit", None, "audio", "decode", "op", 6)],
        "defect_no int, engine string, fixed_major int, media string, kind string, codec_prefix string, above_channels int")
    return op.known_defects(calls, defects, "event_id").select("event_id", "engine", "engine_major", "defect_no")


@query("apply_rules", f"""WITH {EVENTS},
f AS (SELECT event_id, CAST(k AS DOUBLE) AS k, value AS v FROM ev),
r AS (SELECT event_id, 'fit' AS rule, CASE WHEN k * 16 >= 640 AND v < 50 OR NOT k <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value, 'ok' AS status FROM f
UNION ALL SELECT event_id, 'ratio', CASE WHEN k <> 7 THEN greatest(ceil(v / nullif(k - 7, 0)), -3) END::DOUBLE, CASE WHEN k = 7 THEN 'division-by-zero' ELSE 'ok' END FROM f
UNION ALL SELECT event_id, 'wrap', floor(abs(-v) % 10 + 0.5)::DOUBLE, 'ok' FROM f
UNION ALL SELECT event_id, 'absent', NULL, 'unknown-name' FROM f)
SELECT * FROM r""")
def apply_rules(load):
    facts = events(load).select("event_id", F.col("k").alias("source.k"), F.col("value").alias("v"))
    return op.apply_rules(facts, ["event_id"], {
        "fit": "source.k * 16 >= 640 && v < 50 || !(source.k != 0)", "ratio": "max(ceil(v / (source.k - 7)), -3)",
        "wrap": "round(abs(-v) % 10)", "absent": "v + nothing"})


@query("buffer_plan", f"""WITH {FILES},
pl AS (SELECT l_orderkey, container, CASE WHEN duration_us > 0 THEN CAST(least(greatest(floor(CAST(size_bytes AS DOUBLE) * 5000000 / duration_us + 0.5), 8388608), 67108864) AS BIGINT) END AS read_ahead_bytes,
  CASE WHEN duration_us > 0 THEN CAST(least(greatest(floor(CAST(size_bytes AS DOUBLE) * 15000000 / duration_us + 0.5), 33554432), 201326592) AS BIGINT) END AS cache_bytes,
  CASE WHEN duration_us > 0 THEN CAST(size_bytes AS DOUBLE) * 8000000 / duration_us END AS bps FROM fl)
SELECT container, count(*) AS files, CAST(sum(read_ahead_bytes) AS BIGINT) AS read_ahead_bytes, CAST(sum(cache_bytes) AS BIGINT) AS cache_bytes, round(avg(bps), 3) AS mean_bits_per_second FROM pl GROUP BY container""")
def buffer_plan(load):
    planned = op.buffer_plan(files(load), "size_bytes", "duration_us")
    return op.buffer_plan_summary(planned, "container").withColumn("mean_bits_per_second", F.round("mean_bits_per_second", 3))


_MASKS = [wave for wave, _, _ in fixed.CHANNEL_LAYOUTS]
_AUDIO = f"""p_partkey, p_size % 9 + 1 AS channels, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN {{masks}} END AS mask,
  CASE WHEN p_partkey % 4 > 0 THEN p_size % 7 + 1 END AS meta_channels, CASE WHEN p_partkey % 4 = 1 THEN {{metas}} END AS meta_mask"""


@query("declared_layout", f"""WITH ly AS (SELECT * FROM (VALUES {", ".join(f"({w}, '{l}', {len(s)})" for w, l, s in fixed.CHANNEL_LAYOUTS)}) t(mask, layout, n)),
ct AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{l}')" for n, l in fixed.LAYOUT_BY_COUNT.items())}) t(n, layout)),
tr AS (SELECT {_AUDIO.format(masks=f"{_MASKS}[p_size % 17 + 1]", metas=f"{_MASKS}[p_partkey % 17 + 1]")} FROM part),
js AS (SELECT tr.*, o.layout AS ol, o.n AS on_, m.layout AS ml, m.n AS mn, c.layout AS cl, d.layout AS dl FROM tr LEFT JOIN ly o ON tr.mask = o.mask LEFT JOIN ly m ON tr.meta_mask = m.mask
  LEFT JOIN ct c ON tr.channels = c.n LEFT JOIN ct d ON tr.meta_channels = d.n)
SELECT p_partkey, channels, mask, meta_channels, meta_mask, CASE WHEN coalesce(mask, 0) <> 0 THEN CASE WHEN on_ = channels THEN ol END WHEN mn = channels THEN ml WHEN cl IS NOT NULL THEN cl ELSE dl END AS layout,
  CASE WHEN coalesce(mask, 0) <> 0 THEN CASE WHEN on_ = channels THEN channels END WHEN mn = channels OR cl IS NOT NULL THEN channels WHEN dl IS NOT NULL THEN meta_channels END AS layout_channels,
  CAST(CASE WHEN coalesce(mask, 0) <> 0 THEN CASE WHEN on_ = channels THEN mask END WHEN mn = channels THEN meta_mask END AS BIGINT) AS layout_mask,
  CASE WHEN coalesce(mask, 0) <> 0 THEN CASE WHEN on_ = channels THEN 'resolved' ELSE 'mask-unqualified' END WHEN mn = channels OR cl IS NOT NULL OR dl IS NOT NULL THEN 'resolved' ELSE 'unavailable' END AS layout_status FROM js""")
def declared_layout(load):
    array = "array(" + ", ".join(map(str, _MASKS)) + ")"
    tracks = load("part").selectExpr(*_columns(_AUDIO.format(
        masks=f"element_at({array}, p_size % 17 + 1)", metas=f"element_at({array}, CAST(p_partkey % 17 AS INT) + 1)")))
    return op.declared_layout(tracks, "channels", "mask", "meta_channels", "meta_mask")


_LOG = """user_id, us, CASE WHEN k % 20 = 0 THEN NULL WHEN k % 20 = 1 THEN 'bytes=9-3' WHEN k % 5 = 0 THEN 'bytes=-' || (k + 1) WHEN k % 5 = 1 THEN 'bytes=' || k || '-' ELSE 'bytes=' || k || '-' || (k + 99) END AS requested,
  CASE k % 11 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 200 ELSE 206 END AS status,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN 'bytes 5-1/9' WHEN k % 5 = 0 THEN 'bytes ' || (500 - (k + 1)) || '-499/500' WHEN k % 5 = 1 THEN 'bytes ' || k || '-499/' || CASE WHEN k % 2 = 0 THEN '500' ELSE '*' END
    WHEN k % 7 = 2 THEN 'bytes ' || k || '-' || (k + 50) || '/500' ELSE 'bytes ' || k || '-' || (k + 99) || '/500' END AS content_range, k % 31 = 4 AS failed, k"""


@query("range_response_audit", f"""WITH {EVENTS}, lg AS (SELECT {_LOG} FROM ev),
au AS (SELECT *, CASE WHEN failed THEN 'transport-error' WHEN requested IS NULL THEN 'no-range' WHEN requested = 'bytes=9-3' THEN 'invalid-request' WHEN status <> 206 THEN 'not-partial'
  WHEN content_range IS NULL THEN 'missing-range' WHEN content_range = 'bytes 5-1/9' THEN 'invalid-range' WHEN k % 5 > 1 AND k % 7 = 2 THEN 'mismatch' ELSE 'ok' END AS range_status, failed OR status = 503 AS retryable FROM lg)
SELECT user_id % 10 AS host, us // 86400000000 * 86400000000 AS window_us, count(*) AS responses, avg(CASE WHEN range_status = 'ok' THEN 1 ELSE 0 END) AS accepted_share, avg(retryable::INTEGER) AS retryable_share FROM au GROUP BY ALL""")
def range_response_audit(load):
    log = events(load).selectExpr(*_columns(_LOG)).withColumn("host", F.col("user_id") % 10)
    audited = op.range_response_audit(log, "requested", "status", "content_range", "failed")
    return op.range_audit_rates(audited, ["host"], "us", 86_400_000_000)


# ---- sources --------------------------------------------------------------------------------------------------
_REPORT = """CASE WHEN k % 17 = 0 THEN 'not json' WHEN k % 19 = 0 THEN '{"error":{"code":-2,"string":"gone"}}' ELSE
  '{"format":{"duration":"' || k || '.5","format_name":""},"streams":[{"index":0,"codec_type":"video","codec_name":"' || event_type || '","width":"' || (k * 16) || '","height":' || (k * 9)
  || ',"avg_frame_rate":"24/1","disposition":{"default":1,"odd":"x"},"tags":{"title":"","language":"l' || (k % 3) || '"},"side_data_list":[{"rotation":90},{"side_data_type":"DOVI configuration record","dv_bl_signal_compatibility_id":"'
  || (k % 4) || '"}]},{"codec_type":"audio"},{"index":"2","codec_type":"audio","codec_name":"","channels":' || (k % 8) || '}]}' END"""


@query("read_probe_reports", f"""WITH {EVENTS}, ok AS (SELECT * FROM ev WHERE k % 17 > 0 AND k % 19 > 0)
SELECT event_id, 'ok' AS report_status, k || '.5' AS duration, 0 AS stream_index, 'video' AS codec_type, event_type AS codec_name, CAST(k * 16 AS INTEGER) AS width, CAST(k * 9 AS INTEGER) AS height,
  NULL AS channels, 'l' || (k % 3) AS language, true AS has_dv, k % 4 AS dv_compatibility_id, 1 AS dispositions FROM ok
UNION ALL SELECT event_id, 'ok', k || '.5', 2, 'audio', NULL, NULL, NULL, CAST(k % 8 AS INTEGER), NULL, false, NULL, NULL FROM ok
UNION ALL SELECT event_id, CASE WHEN k % 17 = 0 THEN 'invalid' ELSE 'error' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL FROM ev WHERE k % 17 = 0 OR k % 19 = 0""")
def read_probe_reports_(load):
    reports = events(load).select("event_id", F.expr(_REPORT).alias("report"))
    return read_probe_reports(reports, "event_id", "report").select(
        "event_id", "report_status", "duration", "stream_index", "codec_type", "codec_name", "width", "height", "channels",
        F.try_element_at("tags", F.lit("language")).alias("language"), "has_dv", "dv_compatibility_id",
        F.when(F.col("disposition").isNotNull(), F.size("disposition")).alias("dispositions"))


_EXPORT = """'{"events":[{"kind":"' || CASE WHEN k % 7 = 0 THEN 'nonsense' ELSE 'render-tick' END || '","epochMilliseconds":' || CASE WHEN k % 8 = 0 THEN '-5' WHEN k % 9 = 0 THEN '"7"' ELSE CAST(event_id + 1 AS VARCHAR(20)) || '.5' END
  || ',"realm":"page","fields":{"a":' || k || ',"b":' || CASE WHEN k % 10 = 0 THEN '[1]' WHEN k % 11 = 0 THEN '"' || repeat('x', 65) || '"' WHEN k % 12 = 0 THEN '"' || repeat('x', 64) || '"' ELSE 'null' END
  || '}},{"kind":"fetch","epochMilliseconds":1,"realm":"worker","fields":' || CASE WHEN k % 2 = 0 THEN '{}' ELSE '3' END || '}]}'"""


@query("read_trace_exports", f"""WITH {EVENTS}
SELECT event_id, 0 AS event_no, CASE WHEN k % 7 = 0 THEN 'nonsense' ELSE 'render-tick' END AS kind, 'page' AS realm, CASE WHEN k % 8 = 0 THEN -5 WHEN k % 9 = 0 THEN NULL ELSE event_id + 1.5::DOUBLE END AS epoch_ms,
  CASE WHEN k % 7 = 0 THEN 'unknown-kind' WHEN k % 8 = 0 OR k % 9 = 0 THEN 'bad-time' WHEN k % 10 = 0 OR k % 11 = 0 THEN 'bad-value' END AS problem FROM ev
UNION ALL SELECT event_id, 1, 'fetch', 'worker', 1::DOUBLE, CASE WHEN k % 2 = 1 THEN 'bad-fields' END FROM ev""")
def read_trace_exports_(load):
    exports = events(load).select("event_id", F.expr(_EXPORT).alias("export"))
    return read_trace_exports(exports, "event_id", "export").drop("fields")


@query("read_cues", r"""WITH tx AS (SELECT conv_id, turn, trim(regexp_replace(replace(replace(replace(text, '<', ' '), '&', ' '), '-->', ' '), '\s+', ' ', 'g')) AS body FROM conversations),
cu AS (SELECT conv_id, turn, turn * 2000000 + 500000 AS start_us, turn * 2000000 + CASE WHEN turn % 5 = 4 THEN 0 ELSE 1500000 END AS end_us, body FROM tx WHERE body <> '')
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS cue_no, start_us, end_us, body || ' & <b>' AS text FROM cu WHERE turn % 5 <> 4""")
def read_cues_(load):
    """Conversations as subtitle files: a cue per turn, one in five with its end before its start."""
    body = F.col("text")
    for mark in ("<", "&", "-->"):
        body = F.replace(body, F.lit(mark), F.lit(" "))
    body = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))

    def stamp(us):
        return F.concat(F.lpad(F.floor(us / 60_000_000).cast("string"), 2, "0"), F.lit(":"),
                        F.lpad((F.floor(us / 1_000_000) % 60).cast("string"), 2, "0"), F.lit("."),
                        F.lpad((F.floor(us / 1000) % 1000).cast("string"), 3, "0"))

    start = F.col("turn") * 2_000_000 + 500_000
    end = F.col("turn") * 2_000_000 + F.when(F.col("turn") % 5 == 4, 0).otherwise(1_500_000)
    cue = F.concat(stamp(start), F.lit(" --> "), stamp(end), F.lit(" position:10%\n<i>"), F.when(body != "", F.concat(body, F.lit("</i> &amp; &lt;b&gt;<u"))).otherwise("x>"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue"))))
    files_ = load("conversations").groupBy("conv_id").agg(
        F.concat(F.lit("WEBVTT\r\n\r\n"), F.array_join(F.transform(ordered, lambda item: item["cue"]), "")).alias("vtt"))
    return read_cues(files_, "conv_id", "vtt")


def luts(load):
    """A table of eight rows per supplier, some of them malformed."""
    account = F.col("s_acctbal") / 10_000
    rows = [F.concat_ws(" ", *[F.format_string("%.6f", account * weight + n * 0.1) for weight in (1, 2, 3)]) for n in range(8)]
    head = F.expr("""CASE s_suppkey % 7 WHEN 0 THEN 'LUT_3D_SIZE 300' WHEN 1 THEN 'LUT_1D_SIZE 2' WHEN 2 THEN 'TITLE "none"' WHEN 3 THEN 'LUT_3D_SIZE 3'
        WHEN 4 THEN 'LUT_3D_SIZE 2\nDOMAIN_MIN 0 0 1\nDOMAIN_MAX 1 1 1' ELSE 'LUT_3D_SIZE 2\nDOMAIN_MAX 2 2 2' END""")
    return load("supplier").select("s_suppkey", "s_acctbal", F.concat_ws("\n", F.lit("# made by a grader"), head, F.lit(""), *rows).alias("cube"))


@query("lut_headers", """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 300 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 2 END AS size, CAST(8 AS BIGINT) AS rows,
  CASE s_suppkey % 7 WHEN 0 THEN 'size-invalid' WHEN 1 THEN 'one-dimensional' WHEN 2 THEN 'size-missing' WHEN 3 THEN 'row-count' WHEN 4 THEN 'domain-invalid' ELSE 'ok' END AS lut_status FROM supplier""")
def lut_headers_(load):
    return lut_headers(luts(load), "s_suppkey", "cube").select("s_suppkey", "size", "rows", "lut_status")


@query("read_lut", """SELECT s_suppkey, CAST(i % 2 AS INTEGER) AS r, CAST(i // 2 % 2 AS INTEGER) AS g, CAST(i // 4 AS INTEGER) AS b,
  round(s_acctbal / 10000 + i * 0.1::DOUBLE, 4) AS out_r, round(s_acctbal / 10000 * 2 + i * 0.1::DOUBLE, 4) AS out_g, round(s_acctbal / 10000 * 3 + i * 0.1::DOUBLE, 4) AS out_b
FROM supplier, range(8) t(i) WHERE s_suppkey % 7 IN (5, 6)""")
def read_lut_(load):
    return read_lut(luts(load), "s_suppkey", "cube").select(
        "s_suppkey", "r", "g", "b", *[F.round(f"out_{c}", 4).alias(f"out_{c}") for c in "rgb"])
