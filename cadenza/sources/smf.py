"""Standard MIDI files as bytes: a reader of all events and a writer, in plain Python, after the public SMF 1.0 specification."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


class MidiError(ValueError):
    """The bytes are not a readable MIDI file."""


@dataclass
class Event:
    """One event of a track; ``data1`` and ``data2`` depend on the kind."""

    delta: int
    kind: str
    channel: int | None = None
    data1: int | None = None
    data2: int | None = None
    text: str | None = None


@dataclass
class MidiFile:
    """Header and tracks."""

    format: int = 1
    ticks_per_beat: int = 480
    tracks: list[list[Event]] = field(default_factory=list)


#: Fixed values of the specification: status nibble -> (kind, data bytes).
_CHANNEL = {0x8: ("note_off", 2), 0x9: ("note_on", 2), 0xA: ("polytouch", 2), 0xB: ("control_change", 2), 0xC: ("program_change", 1), 0xD: ("aftertouch", 1), 0xE: ("pitchwheel", 2)}
_TEXTS = {0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument_name", 0x05: "lyrics", 0x06: "marker", 0x07: "cue"}


def _vlq(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = 0
    for _ in range(4):
        if at >= end:
            raise MidiError("a number runs over the end of its track")
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at
    raise MidiError("a number has more than four bytes")


def _track(data: bytes, at: int, end: int) -> list[Event]:
    events, running = [], None

    def need(n: int) -> None:
        if at + n > end:
            raise MidiError("an event runs over the end of its track")

    while at < end:
        delta, at = _vlq(data, at, end)
        need(1)
        status = data[at]
        if status & 0x80:
            at += 1
        elif running is None:
            raise MidiError("a data byte without a status")
        else:
            status = running
        if status == 0xFF:
            need(1)
            kind = data[at]
            size, at = _vlq(data, at + 1, end)
            need(size)
            body, at, running = data[at : at + size], at + size, None
            if kind == 0x2F:
                events.append(Event(delta, "end_of_track"))
                break
            if kind in _TEXTS:
                events.append(Event(delta, _TEXTS[kind], text=body.decode("latin-1")))
            elif kind == 0x51 and size == 3:
                events.append(Event(delta, "set_tempo", data1=int.from_bytes(body)))
            elif kind == 0x58 and size >= 2:
                events.append(Event(delta, "time_signature", data1=body[0], data2=1 << body[1]))
            elif kind == 0x59 and size == 2:
                events.append(Event(delta, "key_signature", data1=int.from_bytes(body[:1], signed=True), data2=body[1]))
            else:
                events.append(Event(delta, "meta", data1=kind, text=body.hex()))
        elif status in (0xF0, 0xF7):
            size, at = _vlq(data, at, end)
            need(size)
            events.append(Event(delta, "sysex", data1=status, text=data[at : at + size].hex()))
            at, running = at + size, None
        elif status >= 0xF0:
            raise MidiError(f"status {status:02x} has no place in a file")
        else:
            running = status
            kind, size = _CHANNEL[status >> 4]
            need(size)
            events.append(Event(delta, kind, status & 0x0F, data[at], data[at + 1] if size == 2 else None))
            at += size
    return events


def parse(data: bytes) -> MidiFile:
    """All tracks; unknown chunks are skipped, a track that is cut short is an error."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise MidiError("no header")
    size, kind, n_tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        frames, per_frame = 256 - (division >> 8), division & 0xFF
        division = frames * per_frame // 2 or 1  # ticks of half a second: a beat at 120
    made, at = MidiFile(kind, division), 8 + size
    while at + 8 <= len(data):
        name, length = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8])
        if name == b"MTrk":
            if at + 8 + length > len(data):
                raise MidiError("a track is cut short")
            made.tracks.append(_track(data, at + 8, at + 8 + length))
        at += 8 + length
    if len(made.tracks) < n_tracks:
        raise MidiError("tracks are missing")
    return made


def _number(value: int) -> bytes:
    out = bytes([value & 0x7F])
    while value := value >> 7:
        out = bytes([value & 0x7F | 0x80]) + out
    return out


def encode(midi: MidiFile) -> bytes:
    """The bytes of a file; an end of track is added where there is none."""
    kinds = {kind: (nibble, size) for nibble, (kind, size) in _CHANNEL.items()}
    texts = {v: k for k, v in _TEXTS.items()}
    out = b"MThd" + struct.pack(">IHHH", 6, midi.format, len(midi.tracks), midi.ticks_per_beat)
    for track in midi.tracks:
        body = bytearray()
        meta = lambda number, data: bytes([0xFF, number]) + _number(len(data)) + data
        for e in [*track, *([] if track and track[-1].kind == "end_of_track" else [Event(0, "end_of_track")])]:
            body += _number(e.delta)
            if e.kind in kinds:
                nibble, size = kinds[e.kind]
                body += bytes([nibble << 4 | (e.channel or 0), e.data1, *([e.data2] if size == 2 else [])])
            elif e.kind in texts:
                body += meta(texts[e.kind], (e.text or "").encode("latin-1", "replace"))
            elif e.kind == "set_tempo":
                body += meta(0x51, e.data1.to_bytes(3))
            elif e.kind == "time_signature":
                body += meta(0x58, bytes([e.data1, e.data2.bit_length() - 1, 24, 8]))
            elif e.kind == "key_signature":
                body += meta(0x59, e.data1.to_bytes(1, signed=True) + bytes([e.data2]))
            elif e.kind == "end_of_track":
                body += meta(0x2F, b"")
            elif e.kind == "meta":
                body += meta(e.data1, bytes.fromhex(e.text or ""))
            elif e.kind == "sysex":
                data = bytes.fromhex(e.text or "")
                body += bytes([e.data1]) + _number(len(data)) + data
            else:
                raise ValueError(f"unknown event {e.kind}")
        out += b"MTrk" + struct.pack(">I", len(body)) + bytes(body)
    return out


def notes_track(notes: list[tuple[int, int, int, int]], channel: int = 0, program: int | None = None, name: str | None = None) -> list[Event]:
    """A track of (start tick, end tick, pitch, velocity) notes; at one tick ends come before starts, except of notes of no length."""
    marks = []
    for k, (a, b, pitch, velocity) in enumerate(notes):
        marks += [(a, 1, k, "note_on", pitch, max(1, min(127, velocity))), (b, 0 if b > a else 2, k, "note_off", pitch, 0)]
    out = [Event(0, "track_name", text=name)] if name else []
    if program is not None:
        out.append(Event(0, "program_change", channel, program))
    now = 0
    for at, _, _, kind, pitch, velocity in sorted(marks):
        out.append(Event(at - now, kind, channel, pitch, velocity))
        now = at
    return out


def conductor_track(changes: list[tuple[int, str, int | None, int | None, str | None]], first: int = 0) -> list[Event]:
    """A track of (tick, kind, value1, value2, text) changes, ticks from ``first`` on; what comes before it holds from the beginning."""
    out, now = [], 0
    for tick, kind, value1, value2, text in changes:
        at = max(0, tick - first)
        out.append(Event(at - now, kind, None, value1, value2, text))
        now = at
    return out
