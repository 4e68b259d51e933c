"""Column functions over probed audio streams."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Encoders, bit rates, file extensions and channel layouts by codec.
ENCODERS = {"aac": "aac", "ac3": "ac3", "eac3": "eac3", "dts": "dca", "mp3": "libmp3lame", "flac": "flac", "vorbis": "libvorbis", "opus": "libopus", "wmav2": "wmav2", "pcm_s16le": "pcm_s16le", "pcm_s24le": "pcm_s16le", "pcm_s32le": "pcm_s16le"}
NO_ENCODER = ("truehd", "mlp")
BIT_RATES = {"aac": 192000, "ac3": 448000, "eac3": 448000, "dca": 1509000, "libmp3lame": 320000, "libvorbis": 192000, "libopus": 128000, "wmav2": 192000}
FALLBACK_LIMIT, OTHER_BIT_RATE = 640000, 192000
EXTENSIONS = {"aac": ".aac", "ac3": ".ac3", "eac3": ".eac3", "dts": ".dts", "mp3": ".mp3", "flac": ".flac", "truehd": ".truehd", "mlp": ".mlp", "vorbis": ".ogg", "opus": ".opus", "pcm_s16le": ".wav", "pcm_s24le": ".wav", "pcm_s32le": ".wav", "wmav2": ".wma"}
LAYOUTS = {1: "mono", 2: "stereo", 6: "5.1", 8: "7.1"}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def choose_encoder(codec: Column, profile: Column, bit_rate: Column) -> Column:
    """struct(encoder, bitrate, reason): reason is null where the codec is kept; bitrate 0 for lossless."""
    name = F.lower(F.coalesce(F.nullif(codec, F.lit("")), F.lit("unknown")))
    detail, rate = F.coalesce(profile, F.lit("")), F.nullif(bit_rate.try_cast("bigint"), F.lit(0).cast("bigint"))
    encoder = lookup(ENCODERS, name)
    lossy_only = name.isin(*NO_ENCODER) | ((name == "dts") & F.lower(detail).contains("ma"))
    capped = F.coalesce(F.least(rate, F.lit(FALLBACK_LIMIT)), F.lit(FALLBACK_LIMIT)).cast("bigint")
    choice = lambda e, b, r: F.struct(e.alias("encoder"), b.cast("bigint").alias("bitrate"), r.cast("string").alias("reason"))
    shown = F.concat(name, F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))
    return (
        F.when(lossy_only, choice(F.lit("ac3"), capped, F.concat(shown, F.lit(": no lossless encoder"))))
        .when(encoder.isNull(), choice(F.lit("ac3"), capped, F.concat(name, F.lit(": unknown codec"))))
        .when((encoder == "flac") | encoder.startswith("pcm_"), choice(encoder, F.lit(0), F.lit(None)))
        .otherwise(choice(encoder, F.coalesce(rate, lookup(BIT_RATES, encoder), F.lit(OTHER_BIT_RATE)), F.lit(None)))
    )


def channel_layout(reported: Column, channels: Column) -> Column:
    """The reported layout, or where that is unknown (in any case of letters) the usual one for so many channels."""
    known = F.when(~F.lower(reported).isin("", "unknown"), reported)
    return F.coalesce(known, lookup(LAYOUTS, channels), F.lit("stereo"))


def raw_extension(codec: Column) -> Column:
    return F.coalesce(lookup(EXTENSIONS, codec), F.concat(F.lit("."), codec))


def eta(audio_done: Column, audio_total: Column, wall: Column) -> Column:
    """Seconds left at the present rate; null while it is unknown."""
    return F.when((audio_done > 0) & (wall > 0), F.greatest(F.lit(0.0), audio_total - audio_done) * wall / audio_done)
