"""Small helpers about names, samples and boundaries."""

from cadenza.operators import boundaries as b
from cadenza.sources import sinks


def test_paths_and_samples(spark, tmp_path):
    files = spark.createDataFrame([("/d/x/a.mid",), ("/d/y/a.mid",), ("/d/b.mid",), ("c.mid",)], "path string")
    wanted = spark.createDataFrame([("c.mid",), ("b.mid",), ("old/a.mid",), ("none.mid",)], "wanted string")
    assert {r.wanted: r.path for r in b.resolve_paths(wanted, files, "/d/").collect()} == {"c.mid": "c.mid", "b.mid": "/d/b.mid", "old/a.mid": "/d/x/a.mid", "none.mid": None}
    ids = spark.range(1000).withColumnRenamed("id", "k")
    some = [r.k for r in b.sample_queries(ids, 5, "k").collect()]
    assert some == [r.k for r in b.sample_queries(ids.repartition(7), 5, "k").collect()] and len(set(some)) == 5
    marks = spark.createDataFrame([("f", "0", 1.0), ("f", "0", 2.5)], "file_id string, track_id string, pos double")
    sinks.write_table(marks, str(tmp_path / "marks"), kind="json")
    assert sorted(map(tuple, b.read_boundaries(spark, str(tmp_path / "marks")).collect())) == sorted(map(tuple, marks.collect()))
    assert [tuple(r) for r in b.fixed_segments(spark, 12, 5).collect()] == [(0, 5), (5, 10), (10, 12)]


def test_melody(spark):
    notes = spark.createDataFrame([("f", 1, 60), ("f", 2, 61), ("g", 2, 62)], "file_id string, track_id int, pitch int")
    assert sorted(r.pitch for r in b.melody(notes).collect()) == [60, 62]
