"""Relational forms of audio steps, and the contracts of what stays outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import media


_HALF = 0.5**0.5
#: Weights of channels for the left and the right side, by number of channels.
MIX = {
    1: ((1.0,), (1.0,)),
    2: ((1.0, 0.0), (0.0, 1.0)),
    6: ((1.0, 0.0, _HALF, 0.0, _HALF, 0.0), (0.0, 1.0, _HALF, 0.0, 0.0, _HALF)),
    8: ((1.0, 0.0, _HALF, 0.0, _HALF, 0.0, _HALF, 0.0), (0.0, 1.0, _HALF, 0.0, 0.0, _HALF, 0.0, _HALF)),
}


def mix(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sample-wise sum (job_id, i, sample) with the length of the first track; no rescaling."""
    other = second.select("job_id", "i", F.col("sample").alias("__other"))
    return first.join(other, ["job_id", "i"], "left").select("job_id", "i", (F.col("sample") + F.coalesce("__other", F.lit(0))).alias("sample"))


def mix_blocks(first: Column, second: Column) -> Column:
    """The same for arrays of samples: what the second lacks counts as silence."""
    padded = F.concat(second, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.size(first) - F.size(second))))
    return F.zip_with(first, F.slice(padded, 1, F.size(first)), lambda a, b: a + b)


def mute_block(samples: Column, start: Column, rate: int, intervals: Column) -> Column:
    """Samples with zeros where their time (start in ms, rate a second) lies in one of the closed intervals (ms)."""
    return F.transform(samples, lambda s, i: F.when(F.exists(intervals, lambda x: (start * rate + i * 1000 >= x["start"] * rate) & (start * rate + i * 1000 <= x["end"] * rate)), 0).otherwise(s))


def concatenate(blocks: DataFrame) -> DataFrame:
    """Blocks of samples (job_id, segment_index, block, samples) on one track: at is the first sample's number in the job.

    No sample is changed, and no track is held in one row; the window holds only
    the sizes of a job's blocks.
    """
    before = Window.partitionBy("job_id").orderBy("segment_index", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("job_id", "segment_index", "block", F.size("samples").alias("n"))
    at = sizes.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return blocks.join(at, ["job_id", "segment_index", "block"]).select("job_id", "at", "samples")


def downmix_block(samples: Column, channels: int) -> Column:
    """Interleaved 16-bit samples of 1, 2, 6 or 8 channels as interleaved stereo; other layouts are an error.

    One channel goes to both sides and two stay. Of more (front left and right,
    centre, low, then pairs), the centre and each rear channel count 1/sqrt(2),
    the low one nothing, and all is scaled so that it can't clip.
    """
    if channels not in MIX:
        raise ValueError(f"no downmix for {channels} channels")
    sides = MIX[channels]
    scale = max(1.0, *(sum(side) for side in sides))

    def mixed(own: Column) -> Column:
        frames = F.sequence(F.lit(0), F.floor(F.size(own) / channels).cast("int") - 1)
        frame = lambda i: F.array(*[F.round(sum((F.get(own, i * channels + c) * (w / scale) for c, w in enumerate(side) if w), F.lit(0.0))).cast("smallint") for side in sides])
        return F.when(F.size(own) < channels, F.array().cast("array<smallint>")).otherwise(F.flatten(F.transform(frames, frame)))

    # as the variable of a function samples are worked out once, and not once for each sample that is looked at
    return F.get(F.transform(F.array(samples), mixed), F.lit(0))


def check_method(method: str, n_intervals: int) -> None:
    """Only silence is implemented; another method is an error once there is something to mute."""
    if n_intervals and method != "mute":
        raise NotImplementedError(f"redaction method {method!r}")


class Separator(Protocol):
    """Splits a segment's audio into (dialogue, background)."""

    def __call__(self, audio: bytes) -> tuple[bytes, bytes]: ...


class Downmixer(Protocol):
    """Decodes a raw track of so many channels to 44.1 kHz interleaved 16-bit stereo."""

    def __call__(self, audio: bytes, channels: int) -> bytes: ...


class Encoder(Protocol):
    """Encodes 16-bit stereo with a named encoder, bit rate (0: lossless) and channel layout."""

    def __call__(self, audio: bytes, encoder: str, bitrate: int, layout: str) -> bytes: ...


class Transcriber(Protocol):
    """Gives the (word, start, end, score) rows of a segment's dialogue."""

    def __call__(self, audio: bytes) -> list[tuple[str, float | None, float | None, float | None]]: ...


#: Bytes of audio that a batch for a tool holds, or one row, and words that a batch of rows holds, or those of one segment.
BATCH_BYTES, BATCH_WORDS = 4 << 20, 20_000


def _bounded(batches: Iterator[pd.DataFrame], audio: str) -> Iterator[pd.DataFrame]:
    """Batches of at most BATCH_BYTES of audio, or of one row: what a tool gives for a batch is held at once."""
    for batch in batches:
        at, held = 0, 0
        for i, size in enumerate(batch[audio].map(len)):
            if held and held + size > BATCH_BYTES:
                yield batch.iloc[at:i]
                at, held = i, 0
            held += size
        if len(batch) > at:
            yield batch.iloc[at:]


def separate(segments: DataFrame, make: Callable[[], Separator]) -> DataFrame:
    """(job_id, segment_index, dialogue, background) of segments (job_id, segment_index, audio); one model for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in _bounded(batches, "audio"):
            parts = [model(bytes(a)) for a in batch["audio"]]
            yield batch[["job_id", "segment_index"]].assign(dialogue=[p[0] for p in parts], background=[p[1] for p in parts])

    return segments.select("job_id", "segment_index", "audio").mapInPandas(run, "job_id long, segment_index int, dialogue binary, background binary")


def downmix(tracks: DataFrame, make: Callable[[], Downmixer]) -> DataFrame:
    """(job_id, stereo) of tracks (job_id, audio, channels); one tool for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = make()
        for batch in _bounded(batches, "audio"):
            yield batch[["job_id"]].assign(stereo=[tool(bytes(a), int(c)) for a, c in zip(batch["audio"], batch["channels"], strict=True)])

    return tracks.select("job_id", "audio", "channels").mapInPandas(run, "job_id long, stereo binary")


def encode(tracks: DataFrame, make: Callable[[], Encoder]) -> DataFrame:
    """(job_id, encoder, bitrate, reason, encoded) of tracks (job_id, audio) with what was probed of their source (codec_name, profile, bit_rate, channels, channel_layout)."""
    choice = media.choose_encoder(F.col("codec_name"), F.col("profile"), F.col("bit_rate"))
    layout = media.channel_layout(F.col("channel_layout"), F.coalesce(F.nullif("channels", F.lit(0)), F.lit(2)))
    chosen = tracks.select("job_id", "audio", choice.alias("x"), layout.alias("layout")).select("job_id", "audio", "x.*", "layout")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = make()
        for batch in _bounded(batches, "audio"):
            done = [tool(bytes(a), e, int(b), s) for a, e, b, s in zip(batch["audio"], batch["encoder"], batch["bitrate"], batch["layout"], strict=True)]
            yield batch[["job_id", "encoder", "bitrate", "reason"]].assign(encoded=done)

    return chosen.mapInPandas(run, "job_id long, encoder string, bitrate long, reason string, encoded binary")


def transcribe(segments: DataFrame, make: Callable[[], Transcriber]) -> DataFrame:
    """Word rows (job_id, segment_index, pos, word, start, end, score); empty words are dropped and a segment may have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, columns = make(), ["job_id", "segment_index", "pos", "word", "start", "end", "score"]
        for batch in batches:
            rows = []
            for j, s, a in zip(batch["job_id"], batch["segment_index"], batch["dialogue"], strict=True):
                own = [(j, s, *w) for w in enumerate_words(model(bytes(a)))]
                if rows and len(rows) + len(own) > BATCH_WORDS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
                rows += own
            yield pd.DataFrame(rows, columns=columns)

    return segments.select("job_id", "segment_index", "dialogue").mapInPandas(run, "job_id long, segment_index int, pos int, word string, start double, end double, score double")


def enumerate_words(found: list[tuple]) -> list[tuple]:
    return [(i, *w) for i, w in enumerate(w for w in found if w[0])]


class PlainDownmixer:
    """A stand-in for a tool: the audio is 16-bit samples at 44.1 kHz already, and the weights of MIX are applied."""

    def __call__(self, audio: bytes, channels: int) -> bytes:
        raw = np.frombuffer(audio[: len(audio) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
        sides = np.array(MIX[channels])
        return np.round(raw @ (sides / max(1.0, sides.sum(axis=1).max())).T).astype("<i2").tobytes()


class PlainEncoder:
    """A stand-in for a tool: the samples as they are, under a line that names what was asked for."""

    def __call__(self, audio: bytes, encoder: str, bitrate: int, layout: str) -> bytes:
        return f"{encoder} {bitrate} {layout}\n".encode() + audio


class SilentSeparator:
    """A stand-in for a model: everything is dialogue."""

    def __call__(self, audio: bytes) -> tuple[bytes, bytes]:
        return audio, b"\0" * len(audio)


class TextTranscriber:
    """A stand-in for a model: the audio is text, and words follow each other every 400 ms."""

    def __call__(self, audio: bytes) -> list[tuple[str, float | None, float | None, float | None]]:
        return [(w, i * 0.4, i * 0.4 + 0.3, 0.9) for i, w in enumerate(audio.decode("utf-8", "replace").split())]
