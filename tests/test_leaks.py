"""Records that share a source, a file or a text with evaluation records."""

from pyspark.sql import functions as F

from tallyloom.operators import mixture, records


def av(spark, rows):
    """(id, state, path, frames, audio, source_id) as records of one video each."""
    df = spark.createDataFrame(rows, "id string, state string, path string, frames array<string>, audio string, sid string")
    made = records.record(df, source="s", state=F.col("state"), questions=[], targets=[], id_=F.col("id"), meta={"source_id": F.col("sid")})
    item = F.struct(F.lit("video").alias("type"), "path", "frames", F.lit(1.0).alias("fps"), F.lit(4.0).alias("duration"), "audio", F.lit(0.0).alias("start"), F.lit(False).alias("mute"), F.lit(False).alias("black"))
    return made.join(df.select("id", F.array(item).cast(f"array<{records.MEDIA}>").alias("m")), "id").withColumn("media", F.col("m")).drop("m")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_source_ids_given_and_found(spark):
    rows = [
        ("file", "a", "/m/-0Ou4eFM3is_000030.mp4", None, None, None),
        ("frames", "b", None, ["/f/-0Ou4eFM3is/1.jpg", "/f/-0Ou4eFM3is/2.jpg"], None, None),
        ("track", "c", "/m/-0Ou4eFM3is/a.flac", None, None, None),
        ("audio", "d", None, None, "/t/-0Ou4eFM3is.wav", None),
        ("given", "e", "/m/x.mp4", None, None, "yt:-0Ou4eFM3is"),
        ("list", "f", "/m/x2.mp4", None, None, '["yt:zzz", "yt:-0Ou4eFM3is"]'),
        ("number", "g", "/m/00342.mp4", None, None, None),
        ("video_", "h", "/m/video_abcde.mp4", None, None, None),
        ("other", "i", "/m/-0Ou4eFM3is.mp4", None, None, "yt:other"),
    ]
    df = av(spark, rows)
    held = av(spark, [("e", "another question", "/e/copy.mp4", None, None, "yt:-0Ou4eFM3is")])
    assert ids(mixture.without_leaks(df, held)) == ["number", "other", "video_"]
    by_file = av(spark, [("e", "another question", "/e/-0Ou4eFM3is_5_9.mp4", None, None, None)])
    assert ids(mixture.without_leaks(df, by_file)) == ["number", "other", "video_"]


def test_same_path_or_text(spark):
    df = av(spark, [("path", "s", "/m/1.mp4", None, None, None), ("text", "s", "/m/2.mp4", None, None, None)])
    assert ids(mixture.without_leaks(df, av(spark, [("e", "S!", "/m/1.mp4", None, None, None)]))) == ["text"]


def test_images_by_content(spark, tmp_path):
    for name, data in (("a.png", b"one"), ("copy.png", b"one"), ("b.png", b"two")):
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([("same", f"{tmp_path}/copy.png"), ("other", f"{tmp_path}/b.png"), ("gone", "/no/file.png")], "id string, path string")
    made = records.record(df, source="s", state=F.lit("what is this?"), questions=[], targets=[], id_=F.col("id"))
    train = made.join(df, "id").withColumn("images", F.array("path")).drop("path")
    held = train.filter("id = 'same'").withColumn("id", F.lit("e")).withColumn("images", F.array(F.lit(f"{tmp_path}/a.png")))
    digests = mixture.file_digests(spark, str(tmp_path))
    assert ids(mixture.without_leaks(train, held)) == ["gone", "other", "same"]
    assert ids(mixture.without_leaks(train, held, digests)) == ["gone", "other"]


def test_mixture_counts_leaks_in_one_pass(spark):
    text = lambda rows: records.record(spark.createDataFrame(rows, "id string, t string"), source="s", state=F.col("t"), questions=[], targets=[], id_=F.col("id"))
    one, two = text([("1", "x"), ("2", "y"), ("3", "z")]), text([("4", "y"), ("5", "w")])
    mixed, report = mixture.build_mixture([(mixture.Source("one", max_samples=1), one), (mixture.Source("two", weight=2.0), two), (mixture.Source("none"), text([("6", "Y")]))], text([("e", "Y")]))
    assert sorted(tuple(r) for r in report.collect()) == [("none", 1, 1, 0), ("one", 3, 1, 1), ("two", 2, 1, 2)]
    assert mixed.count() == 3 and "part__" not in mixed.columns
