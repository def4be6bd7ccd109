"""The file format, pairing rules, tempo map, scans and writers."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators.features import features10
from cadenza.plans import QUERIES
from cadenza.plans import midi_queries as mq
from cadenza.schema import FEATURES10
from cadenza.sources import midi, sinks, smf

E = smf.Event


def song(tempo=120, pitches=(60, 62), starts=(0, 1440), length=960, drum=False):
    track = smf.notes_track([(a, a + length, p, 80) for a, p in zip(starts, pitches, strict=True)], 9 if drum else 0, 5, "lead")
    return smf.MidiFile(1, 480, [[E(0, "set_tempo", data1=round(60e6 / tempo)), E(0, "time_signature", data1=4, data2=4)], track])


def random_file(seed):
    rng = random.Random(seed)
    tracks = []
    for _ in range(rng.randint(1, 4)):
        t = []
        for _ in range(rng.randint(0, 60)):
            kind = rng.choice(["note_on", "note_off", "note_on", "control_change", "program_change", "pitchwheel", "set_tempo", "time_signature", "key_signature", "lyrics", "meta", "sysex"])
            d = rng.choice([0, 1, 127, 128, 16384, 2_097_152])
            if kind in ("note_on", "note_off", "control_change", "pitchwheel"):
                t.append(E(d, kind, rng.randint(0, 15), rng.choice([60, 61, 64]), rng.randint(0, 127)))
            elif kind == "program_change":
                t.append(E(d, kind, rng.randint(0, 15), rng.randint(0, 127)))
            elif kind == "set_tempo":
                t.append(E(d, kind, data1=rng.randint(1, 2**24 - 1)))
            elif kind == "time_signature":
                t.append(E(d, kind, data1=rng.randint(1, 12), data2=rng.choice([1, 2, 4, 8, 16])))
            elif kind == "key_signature":
                t.append(E(d, kind, data1=rng.randint(-7, 7), data2=rng.randint(0, 1)))
            elif kind == "lyrics":
                t.append(E(d, kind, text="la é"))
            else:
                t.append(E(d, kind, data1=0x7F if kind == "meta" else 0xF0, text="00ff17"))
        tracks.append([*t, E(0, "end_of_track")])
    return smf.MidiFile(1, rng.choice([96, 480]), tracks)


def test_round_trip():
    for seed in range(60):
        f = random_file(seed)
        assert smf.parse(smf.encode(f)) == f


def test_running_status_and_errors():
    body = bytes([0, 0x90, 60, 64, 10, 60, 0, 0, 0xFF, 0x2F, 0])
    data = b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1, 0, 96]) + b"XXXX" + bytes([0, 0, 0, 2, 1, 2]) + b"MTrk" + len(body).to_bytes(4) + body
    assert [(e.kind, e.delta, e.data1, e.data2) for e in smf.parse(data).tracks[0]] == [("note_on", 0, 60, 64), ("note_on", 10, 60, 0), ("end_of_track", 0, None, None)]
    for bad in (b"", b"RIFF" + data, data[:-3], data[:14], data.replace(b"\x00\x90", b"\x00\x3c"), data.replace(b"\x00\x90", b"\x00\xf4")):
        with pytest.raises(smf.MidiError):
            smf.parse(bad)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("songs")
    (d / "Artist" / "Song_Patterns").mkdir(parents=True)
    (d / "Artist" / "a.mid").write_bytes(smf.encode(song()))
    (d / "Artist" / "b.MIDI").write_bytes(smf.encode(song(90, (50, 52))))
    (d / "Artist" / "bad.mid").write_bytes(b"MThd nonsense")
    (d / "Artist" / "note.txt").write_bytes(b"x")
    (d / "Artist" / "Song_Patterns" / "p.mid").write_bytes(smf.encode(song(pitches=(70, 71, 72), starts=(0, 0, 480))))
    for seed in range(12):
        (d / f"r{seed}.mid").write_bytes(smf.encode(random_file(seed)))
    return str(d)


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())


def test_scans(spark, folder):
    assert len(names(midi.scan_files(spark, folder))) == 16
    assert names(midi.scan_files(spark, folder, any_case=False, exclude="/r[0-9]")) == ["a.mid", "bad.mid", "p.mid"]
    assert "p.mid" not in names(midi.scan_folder(spark, folder)) and "b.MIDI" not in names(midi.scan_folder(spark, folder))
    assert names(midi.scan_folder(spark, folder, limit=1)) != []
    assert names(midi.scan_files(spark, f"{folder}/Artist", recursive=False)) == ["a.mid", "b.MIDI", "bad.mid"]
    found = midi.read_events(spark, folder)
    errors = found.where("kind = 'error'").collect()
    assert len(errors) == 1 and errors[0].file_id.endswith("bad.mid")
    files = midi.scan_files(spark, folder)
    cached = files.select("path", "length", "modificationTime").where("path not like '%a.mid'")
    assert names(midi.cache_is_valid(files, cached)) == ["a.mid"]
    inventory = {r.ext: (r.n, round(r.percent, 2)) for r in midi.inventory(spark.createDataFrame([("x/a.mid",), ("b.MID",), ("c",), ("d.e/f",)], "path string")).collect()}
    assert inventory == {".mid": (2, 50.0), "(no extension)": (2, 50.0)}


def pair(track, lifo):
    open_, out, now = {}, [], 0
    for k, e in enumerate(track):
        now += e.delta
        if e.kind == "note_on" and e.data2 > 0:
            stack = open_.setdefault(e.data1, [])
            if not lifo:
                stack.clear()
            stack.append((k, now, e.data2))
        elif e.kind in ("note_on", "note_off") and open_.get(e.data1):
            n, start, velocity = open_[e.data1].pop()
            out.append((n, e.data1, start, now, velocity))
    return sorted(out)


@pytest.mark.parametrize("lifo", [True, False])
def test_pairing(spark, folder, lifo):
    found = midi.read_events(spark, folder)
    paired = (midi.pair_lifo if lifo else midi.pair_last_on)(found).collect()
    for seed in range(12):
        for t, track in enumerate(random_file(seed).tracks):
            got = sorted((r.note_id, r.pitch, r.start_tick, r.end_tick, r.velocity) for r in paired if r.file_id.endswith(f"/r{seed}.mid") and r.track_id == t)
            assert got == pair(track, lifo)


def test_seconds(spark, folder):
    found = midi.read_events(spark, folder)
    notes = midi.notes(found).collect()
    for seed in range(12):
        f = random_file(seed)
        changes, per, passed, last = {}, 0.5 / f.ticks_per_beat, 0.0, 0
        for t, track in enumerate(f.tracks):
            now = 0
            for k, e in enumerate(track):
                now += e.delta
                if e.kind == "set_tempo":
                    changes[now] = max(changes.get(now, (-1, -1, 0)), (t, k, e.data1))
        pieces = [(0, 0.0, per)]
        for tick in sorted(changes):
            passed += (tick - last) * per
            per, last = changes[tick][2] / 1e6 / f.ticks_per_beat, tick
            pieces.append((tick, passed, per))
        for r in (r for r in notes if r.file_id.endswith(f"/r{seed}.mid")):
            for tick, got in ((r.start_tick, r.start), (r.end_tick, r.end)):
                at, s, p = [x for x in pieces if x[0] <= tick][-1]
                assert abs(got - (s + (tick - at) * p)) < 1e-6 * max(1, got)


def test_known_features(spark, folder):
    notes = midi.notes(midi.read_events(spark, f"{folder}/Artist", recursive=False))
    row = features10(notes.where(~F.col("is_drum")), ["file_id"], ("track_id", "note_id")).where("file_id like '%a.mid'").first()
    assert [row[c] for c in FEATURES10] == [61, 1, 1, 0, 1.5, 0, 0, 120, 0, 0.5]
    tempo = {r.file_id[-5:]: round(r.tempo, 3) for r in midi.first_tempo(midi.read_events(spark, f"{folder}/Artist", recursive=False)).collect()}
    assert tempo == {"a.mid": 120.0, ".MIDI": 90.0}


def test_metadata(spark, folder):
    found = midi.read_events(spark, f"{folder}/Artist", recursive=False)
    row = midi.metadata(found).where("file_id like '%a.mid'").first()
    assert row.ticks_per_beat == 480 and row.tempos[0].value1 == 500_000 and row.keys[0] == (0, 0, 0) and row.n_note_events == 4
    track = midi.tracks(found).where("file_id like '%a.mid' and track_id = 1").first()
    assert (track.name, track.program, track.is_drum) == ("lead", 5, False)
    assert midi.signature_inventory(found).count() == 0
    first = midi.global_clock(midi.read_events(spark, folder)).where("file_id like '%a.mid'")
    assert first.where("kind = 'note_on'").count() == 2 and midi.raw_notes(found).where("velocity = 0").count() == 4
    assert midi.meta_changes(found).where("kind = 'set_tempo'").count() == 2 and midi.signatures(found).count() == 2


def test_writers(spark, folder, tmp_path):
    notes = midi.notes(midi.read_events(spark, folder, exclude="/r[0-9]")).withColumn("pattern_no", F.col("pitch") % 2)
    files = sinks.pattern_files(notes, ["file_id", "track_id"]).collect()
    assert len(files) == 4
    for r in files:
        midi_file = smf.parse(r.content)
        assert midi_file.tracks[0][-1].kind == "end_of_track" and any(e.kind == "program_change" and e.data1 == 5 for e in midi_file.tracks[0])
    per_track = sinks.track_files(notes, ["file_id", "track_id"]).collect()
    assert len(per_track) == 3 and {len(smf.parse(r.content).tracks) for r in per_track} == {1, 2}
    assert sinks.segment_files(notes.withColumn("segment_id", F.lit(0)), ["file_id"], least=10_000).count() == 0
    assert sinks.split_tracks(notes).count() == 3
    cut = sinks.cut_bars(notes.where("file_id like '%a.mid'"), ["file_id"], 0, 1).first()
    assert sum(e.kind == "note_on" for t in smf.parse(cut.content).tracks for e in t) == 2
    saved = sinks.save_files(sinks.split_tracks(notes), str(tmp_path / "out"), F.concat(F.regexp_extract("file_id", "([^/]+)$", 1), F.lit("/"), F.col("track_id"), F.lit(".mid"))).collect()
    back = midi.notes(midi.read_events(spark, str(tmp_path / "out")))
    assert len(saved) == 3 and back.count() == notes.count()
    sinks.write_table(sinks.report_lines(notes, "pattern_no", ["pitch", "start"]), str(tmp_path / "report"), ["pattern_no"], "text")
    assert spark.read.text(str(tmp_path / "report")).count() == notes.count()
    for kind in ("json", "csv", "parquet"):
        sinks.write_table(notes.select("pitch"), str(tmp_path / kind), kind=kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).count() == notes.count()


def test_a_file_without_changes_lists_no_first_track(spark):
    """the writer leaves an empty first track in a file that has no changes; the numbers of the others stay."""
    notes = spark.createDataFrame([(f, t, 0, 96, 60, 80) for f in ("with", "without") for t in ("a", "b")], "path string, track_name string, start_tick long, end_tick long, pitch int, velocity int")
    meta = spark.createDataFrame([("with", "set_tempo", 0, 500_000, None, None)], "path string, kind string, tick long, value1 int, value2 int, text string")
    found = midi.events(sinks.midi_files(notes, ["path"], "track_name", 96, False, meta))
    assert sorted((r.file_id, r.track_id, r.name) for r in midi.tracks(found).collect()) == [("with", 0, None), ("with", 1, "a"), ("with", 2, "b"), ("without", 1, "a"), ("without", 2, "b")]


def test_flat_scan_of_entries_in_parts(spark, tmp_path):
    """an entry in parts is a folder that bears the suffix; what lies in other folders or deeper stays out."""
    for path in ("a.mid", "b.mid/part-0.mid", "b.mid/part-1.mid", "b.mid/note.txt", "b.mid/deeper/c.mid", "other/d.mid"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    assert names(midi.scan_files(spark, str(tmp_path), recursive=False)) == ["a.mid", "part-0.mid", "part-1.mid"]
    assert len(names(midi.scan_files(spark, str(tmp_path)))) == 5


def test_scan_query_of_tables_in_parts(spark, sf_dir, tmp_path):
    """files and folders of parts, as in larger copies of the tables."""
    for name in mq.NAMES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    (tmp_path / "pages.parquet").unlink()
    (tmp_path / "pages.parquet").mkdir()
    for k in range(2):
        (tmp_path / "pages.parquet" / f"part-000{k}.parquet").symlink_to(f"{sf_dir}/pages.parquet")
    assert sorted(map(tuple, QUERIES["scan_files_P"](spark, str(tmp_path)).collect())) == sorted((kind, n) for kind in ("recursive", "flat", "pruned") for n in mq.NAMES)
