"""Fixed tables: container rules, codecs, channel layouts. Values are fixed by the formats and players they describe."""
from __future__ import annotations

# codecs
WEB_AUDIO = ["aac", "opus", "flac", "mp3", "vorbis"]
COMPRESSED_AUDIO = [*WEB_AUDIO, "ac3", "eac3"]
PCM_AUDIO = ["pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be", "pcm_s32le", "pcm_s32be", "pcm_f32le", "pcm_f32be",
             "pcm_f64le", "pcm_f64be", "pcm_u8", "pcm_s8", "pcm_mulaw", "pcm_alaw"]
ISO_PCM_AUDIO = PCM_AUDIO[:10]
WAVE_FORMAT_AUDIO = ["wmav1", "wmav2", "wmapro", "wmalossless", "wmavoice"]
MATROSKA_AUDIO = [*COMPRESSED_AUDIO, "dts", "mlp", "truehd", "pcm_u8", "pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be",
                  "pcm_s32le", "pcm_s32be", "pcm_f32le", "pcm_f64le", *WAVE_FORMAT_AUDIO]
AVI_AUDIO = ["aac", "mp3", "ac3", "flac", "vorbis", "pcm_u8", "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_f32le",
             "pcm_f64le", "pcm_mulaw", "pcm_alaw", *WAVE_FORMAT_AUDIO]
NATIVE_VIDEO = ["h264", "hevc", "vp8", "vp9", "av1"]
ISO_VIDEO = [*NATIVE_VIDEO, "vc1", "mpeg4", "h263"]
MSMPEG4_VIDEO = ["msmpeg4v1", "msmpeg4v2", "msmpeg4v3"]
MATROSKA_VIDEO = [*NATIVE_VIDEO, "mpeg1video", "mpeg2video", "vc1", "wmv3", "mpeg4", "h263", *MSMPEG4_VIDEO, "jpeg2000"]
AVI_VIDEO = [*NATIVE_VIDEO, "mpeg4", "h263", *MSMPEG4_VIDEO]
ASF_VIDEO = ["vc1", "wmv3", "mpeg4", "h263", *MSMPEG4_VIDEO]

# Container rules as (containers with aliases, video codecs, audio codecs)
CONTAINER_RULES = [
    (["mp4", "m4v", "mov", "3gp", "3g2", "mj2"], ISO_VIDEO, [*COMPRESSED_AUDIO, "dts", "truehd"]),
    (["mp4", "m4v", "mov"], ISO_VIDEO, ISO_PCM_AUDIO),
    (["mov"], ISO_VIDEO, PCM_AUDIO),
    (["mov", "mj2"], ["jpeg2000"], [*COMPRESSED_AUDIO, *PCM_AUDIO]),
    (["mkv", "matroska"], MATROSKA_VIDEO, MATROSKA_AUDIO),
    (["avi"], AVI_VIDEO, AVI_AUDIO),
    (["asf", "wmv", "wma"], ASF_VIDEO, AVI_AUDIO),
    (["webm"], ["vp8", "vp9", "av1"], ["opus", "vorbis"]),
    (["ts", "m2ts", "mts"], ["h264", "hevc", "mpeg1video", "mpeg2video", "vc1"], ["aac", "mp3", "ac3", "eac3", "dts"]),
    (["mpeg", "mpg", "vob"], ["mpeg1video", "mpeg2video"], ["mp3", "ac3", "dts"]),
]
KNOWN_CONTAINERS = sorted({name for containers, _, _ in CONTAINER_RULES for name in containers})
SUBTITLE_EXTENSIONS = ["ass", "srt", "ssa", "vtt"]

# Video codec names as metadata spells them
VIDEO_CODEC_ALIASES = {
    "AVC": "h264", "AVC1": "h264", "AV1": "av1", "H263": "h263", "H264": "h264", "H265": "hevc", "HEVC": "hevc",
    "J2K": "jpeg2000", "JPEG 2000": "jpeg2000", "JPEG2000": "jpeg2000", "MPEG-1": "mpeg1video", "MPEG1": "mpeg1video",
    "MPEG1VIDEO": "mpeg1video", "MPEG-2": "mpeg2video", "MPEG2": "mpeg2video", "MPEG2VIDEO": "mpeg2video",
    "MPEG4": "mpeg4", "MSMPEG4": "msmpeg4v3", "MSMPEG4V1": "msmpeg4v1", "MSMPEG4V2": "msmpeg4v2",
    "MSMPEG4V3": "msmpeg4v3", "VC-1": "vc1", "VC1": "vc1", "VP8": "vp8", "VP9": "vp9", "WMV3": "wmv3",
}
VIDEO_CODECS_WITHOUT_ROUTE = ["THEORA"]

# Channel layouts by WAVE mask as (mask, layout, speakers in order)
_FRONT = ["front-left", "front-right"]
_THREE = [*_FRONT, "front-center"]
_BED = [*_THREE, "low-frequency-effects"]
_BACK, _SIDE = ["back-left", "back-right"], ["side-left", "side-right"]
_TOP_FRONT, _TOP_BACK = ["top-front-left", "top-front-right"], ["top-back-left", "top-back-right"]
CHANNEL_LAYOUTS = [
    (0x0004, "mono", ["front-center"]),
    (0x0003, "stereo", _FRONT),
    (0x0007, "3.0", _THREE),
    (0x000B, "2.1", [*_FRONT, "low-frequency-effects"]),
    (0x0103, "3.0-back", [*_FRONT, "back-center"]),
    (0x010F, "4.1", [*_BED, "back-center"]),
    (0x0607, "5.0-side", [*_THREE, *_SIDE]),
    (0x0037, "5.0-back", [*_THREE, *_BACK]),
    (0x003F, "5.1-back", [*_BED, *_BACK]),
    (0x060F, "5.1-side", [*_BED, *_SIDE]),
    (0x070F, "6.1", [*_BED, "back-center", *_SIDE]),
    (0x063F, "7.1", [*_BED, *_BACK, *_SIDE]),
    (0x503F, "5.1.2", [*_BED, *_BACK, *_TOP_FRONT]),
    (0x560F, "5.1.2-side", [*_BED, *_SIDE, *_TOP_FRONT]),
    (0x2D03F, "5.1.4", [*_BED, *_BACK, *_TOP_FRONT, *_TOP_BACK]),
    (0x563F, "7.1.2", [*_BED, *_BACK, *_SIDE, *_TOP_FRONT]),
    (0x2D63F, "7.1.4", [*_BED, *_BACK, *_SIDE, *_TOP_FRONT, *_TOP_BACK]),
]
LAYOUT_SPEAKERS = {layout: speakers for _, layout, speakers in CHANNEL_LAYOUTS}
LAYOUT_BY_COUNT = {1: "mono", 2: "stereo", 3: "3.0", 5: "5.0-side", 6: "5.1-side", 7: "6.1", 8: "7.1"}
OUTPUT_LAYOUTS = {"5.1": "5.1-side", "5.1.2": "5.1.2", "5.1.4": "5.1.4", "7.1": "7.1", "7.1.2": "7.1.2", "7.1.4": "7.1.4"}

# Trace event kinds
TRACE_KINDS = [
    "audio-clock", "clock-sync", "fetch", "frame-arrived", "frame-discarded", "frame-dropped", "gpu-work-done", "long-task",
    "playback-wait", "render-tick", "video-credit-wait", "video-decode-fence", "video-decoded", "video-frame-decimated",
    "video-frame-output", "video-packet-skipped", "video-read", "video-resync",
]
MAXIMUM_TRACE_FIELDS = 16
MAXIMUM_TRACE_STRING = 64

# Aspect ratios, narrowest first
ASPECT_RATIOS = [
    ("1:1 Square", 1.0), ("Movietone", 1.19), ("4:3 Standard TV", 4 / 3), ("Academy Ratio", 1.375), ("IMAX GT", 1.43),
    ("VistaVision (3:2)", 3 / 2), ("14:9 Transition Broadcast", 14 / 9), ("European Widescreen", 1.66),
    ("7:4 Widescreen", 7 / 4), ("16:9 HDTV", 16 / 9), ("US Widescreen (Flat)", 1.85), ("IMAX Digital", 1.9),
    ("Univisium", 2.0), ("18.5:9 Digital/Smartphone", 18.5 / 9), ("19:9 Smartphone / ARRI Alexa 65", 19 / 9),
    ("70mm Standard", 2.2), ("20:9 Ultrawide Smartphone", 20 / 9), ("21:9 Ultrawide Monitor", 21 / 9),
    ("Early Anamorphic Scope", 2.35), ("Modern Anamorphic Scope", 2.39), ("Blu-ray Scope", 2.4),
    ("Early CinemaScope", 2.55), ("Original 1953 CinemaScope", 2.66), ("Ultra Panavision 70", 2.76),
]


def container_rules(spark):
    """The container rules as a table (rule_no, containers, video_codecs, audio_codecs)."""
    return spark.createDataFrame(
        [(n, *rule) for n, rule in enumerate(CONTAINER_RULES)],
        "rule_no int, containers array<string>, video_codecs array<string>, audio_codecs array<string>")
