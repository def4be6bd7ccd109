"""Explicit schemas of the tables that operators exchange; nothing is inferred."""

from pyspark.sql import types as T

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MIDI_EVENTS = _schema(file_id=_S, track_id=_I, seq=_I, delta=_L, abs_tick=_L, kind=_S, channel=_I, data1=_I, data2=_I, text=_S)
MIDI_FILES = _schema(file_id=_S, format=_I, ticks_per_beat=_I, n_tracks=_I, error=_S)
TRACKS = _schema(file_id=_S, track_id=_I, name=_S, program=_I, is_drum=_B)
NOTES = _schema(file_id=_S, track_id=_I, note_id=_L, pitch=_I, velocity=_I, start_tick=_L, end_tick=_L, start=_D, dur=_D, is_drum=_B, program=_S)
META_CHANGES = _schema(file_id=_S, kind=_S, tick=_L, value1=_I, value2=_I, text=_S)
SEGMENTS = _schema(file_id=_S, track_id=_S, segment_id=_L, start=_D, end=_D, repetitions=_L, motif=_S, motif_id=_L)

#: The feature vector's order and default weights.
FEATURE_WEIGHTS = {
    "pitch_mean": 0.7,
    "pitch_std": 2.0,
    "duration_mean": 1.0,
    "duration_std": 1.0,
    "ioi_mean": 1.5,
    "ioi_std": 2.0,
    "syncopation_ratio": 2.0,
    "tempo": 0.5,
    "interval_std": 1.8,
    "contour_slope": 1.2,
}
FEATURES10 = list(FEATURE_WEIGHTS)
FEATURES8 = ["tempo", "pitch_mean", "pitch_std", "duration_mean", "duration_std", "ioi_mean", "ioi_std", "syncopation_ratio"]
#: Result cap of a similarity search, tempo where none is known, ticks of a bar without a signature.
TOP_K, DEFAULT_TEMPO, DEFAULT_BAR_TICKS = 33, 120.0, 384
#: Names of pitch classes.
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
