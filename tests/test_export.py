"""Exports that a manifest commits, UTC times, scanned inventories."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from wakelens.functions import times
from wakelens.sources import export, readers

FIELDS = ("id", "note", "seen")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, note string, seen timestamp, hidden string")


def test_round_trip_keeps_nulls_quotes_and_line_breaks(spark, tmp_path):
    seen = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
    df = rows(spark, (1, 'a "b", c', seen, "x"), (2, "two\nlines", None, "x"), (3, "", seen.replace(microsecond=50), "x"), (4, None, None, "x"), (4, None, None, "x"))
    export.write_export({"notes": (df, FIELDS, ["id"])}, str(tmp_path))
    back = export.read_export(spark, str(tmp_path))["notes"]
    assert back.columns == list(FIELDS)
    got = sorted((r.id, r.note, r.seen) for r in back.where("id < 4").collect())
    assert got == [("1", 'a "b", c', "2024-05-06T07:08:09Z"), ("2", "two\nlines", None), ("3", "", "2024-05-06T07:08:09.000050Z")]
    assert back.where("id = 4 and note is null").count() == 2


def test_unfinished_runs_are_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    export.write_export({"notes": (rows(spark, (1, "old", None, "")), FIELDS, ["id"])}, folder, "001")
    half = export.metadata_rows(rows(spark, (2, "half", None, "")), FIELDS)
    half.write.options(**export.CSV).csv(f"{folder}/run=002/notes")
    assert [r.note for r in export.read_export(spark, folder)["notes"].collect()] == ["old"]
    export.write_export({"notes": (rows(spark, (3, "new", None, "")), FIELDS, ["id"])}, folder, "003")
    assert [r.note for r in export.read_export(spark, folder)["notes"].collect()] == ["new"]


def test_changed_tables_are_noticed(spark, tmp_path):
    folder = str(tmp_path)
    df = rows(spark, (1, "a", None, ""), (2, "b", None, ""))
    export.write_export({"notes": (df, FIELDS, ["id"]), "none": (df.limit(0), FIELDS, ["id"])}, folder, "1")
    assert {r.name: (r.rows, r.intact) for r in export.check_export(spark, folder).collect()} == {"notes": (2, True), "none": (0, True)}
    export.metadata_rows(rows(spark, (3, "c", None, "")), FIELDS).write.mode("append").options(**export.CSV).csv(f"{folder}/run=1/notes")
    assert {r.name: (r.rows, r.intact) for r in export.check_export(spark, folder).collect()} == {"notes": (3, False), "none": (0, True)}


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffles_do_not_outlive_their_table(spark, tmp_path):
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, set_before = shuffles(spark), [spark.conf.get(k, None) for k in keys]
    one = spark.range(0, 3000, 1, 4).select("id", F.lit("x").alias("note"))
    export.write_export({"a": (one, ("id", "note"), ["id"]), "b": (one.join(one.select("id").hint("merge"), "id"), ("id",), ["id"])}, str(tmp_path))
    until = time.time() + 10
    while (left := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert [spark.conf.get(k, None) for k in keys] == set_before
    assert {r.name: (r.rows, r.intact) for r in export.check_export(spark, str(tmp_path)).collect()} == {"a": (3000, True), "b": (3000, True)}


def test_tables_are_compressed(spark, tmp_path):
    df = spark.range(0, 5000, 1, 4).select("id", F.concat(F.lit("raw/"), F.col("id").cast("string"), F.lit(".webm")).alias("path"))
    export.write_export({"paths": (df, ("id", "path"), ["id"])}, str(tmp_path), "1")
    plain = sum(len(f'"{i}","raw/{i}.webm"\n') for i in range(5000))
    assert sum(f.stat().st_size for f in (tmp_path / "run=1" / "paths").glob("part-*")) < plain / 2
    back = export.read_export(spark, str(tmp_path))["paths"]
    assert sorted(map(tuple, back.collect())) == sorted((str(i), f"raw/{i}.webm") for i in range(5000))


def test_columns_made_behind_the_shuffle(spark, tmp_path):
    seen = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
    df = rows(spark, *[(i, None if i % 7 == 0 else f"n{i}", seen, "x") for i in range(300)], (None, "none", None, "x"), (5, "again", None, "x"))
    made = {"key": F.concat_ws("-", F.col("id").cast("string"), "hidden"), "note": F.upper("note"), "seen": F.col("seen")}
    export.write_export({"late": (df, made, [made["key"]]), "early": (df.select(*[c.alias(n) for n, c in made.items()]), tuple(made), ["key"])}, str(tmp_path), "1")
    back = export.read_export(spark, str(tmp_path))
    assert back["late"].columns == ["key", "note", "seen"]
    late, early = (sorted(map(str, back[n].collect())) for n in ("late", "early"))
    assert late == early and len(late) == 302 and "Row(key='5-x', note='AGAIN', seen=None)" in late
    for part in sorted((tmp_path / "run=1" / "late").glob("part-*")):
        keys = [r.key for r in spark.read.options(**export.CSV).csv(str(part)).collect()]
        assert keys == sorted(keys)


def test_iso_text_is_utc_in_every_session_zone(spark):
    df = spark.sql("SELECT timestamp'2024-01-31 23:30:00Z' AS t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert df.select(times.iso_utc(F.col("t"))).first()[0] == "2024-01-31T23:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert df.select(times.iso_utc(F.lit(None).cast("timestamp"))).first()[0] is None


def test_scanned_members_and_ambiguous_prefixes(spark, tmp_path):
    members = [("audio_raw", "c1.webm"), ("audio_raw", "c1.wav"), ("audio_raw", "c2.webm"), ("old", "c+3 x.m4a")]
    spark.createDataFrame([(d, n, "s") for d, n in members], "dir string, name string, value string").write.partitionBy("dir", "name").text(str(tmp_path / "in"))
    files = readers.member_paths(readers.list_files(spark, str(tmp_path / "in")))
    assert {r.path for r in files.collect()} == {f"{d}/{n}" for d, n in members}
    assert [(r.clip_id, r.files, r.first_file) for r in readers.ambiguous_prefixes(files).collect()] == [("c1", 2, "audio_raw/c1.wav")]


def test_duplicate_transcripts(spark):
    lines = spark.createDataFrame([("1-2-3 a b",), ("1-2-3 a b",), ("1-2-4 a",), ("1-2-4 c",), ("1-2-5 a",), ("bad x",), ("bad x",)], "value string")
    got = {r.id: (r.occurrences, r.texts) for r in readers.duplicate_transcripts(readers.parse_transcripts(lines)).collect()}
    assert got == {"1-2-3": (2, 1), "1-2-4": (2, 2)}
