import pytest

from tasselworks.operators.packed import split_packed

CASES = [
    ('["/a/b.jpg", "/c d.jpg"]', ["/a/b.jpg", "/c d.jpg"]),
    ('["\\/a\\/Ma\\u00edz.jpg"]', ["/a/Maíz.jpg"]),
    ('"[""/a/x, y.jpg"", ""/b.jpg""]"', ["/a/x, y.jpg", "/b.jpg"]),
    ("['/a|b.jpg', \"/grower's.jpg\"]", ["/a|b.jpg", "/grower's.jpg"]),
    ("/grower's plot/a.jpg ;'/b;c.jpg'", ["/grower's plot/a.jpg", "/b;c.jpg"]),
    ("{/a.jpg,\"/b, c.jpg\"}", ["/a.jpg", "/b, c.jpg"]),
    ("\n/a.jpg\n/a.jpg\n", ["/a.jpg", "/a.jpg"]),
    ("/a.jpg | \t/b.jpg|", ["/a.jpg", "/b.jpg"]),
    ('"/a ""q"".jpg";/b.jpg', ['/a "q".jpg', "/b.jpg"]),
    ("'it\\'s.jpg'", ["it's.jpg"]),
    ('["", " ", "/z.jpg"]', ["/z.jpg"]),
    ("[]", []), ("{}", []), ('"[]"', []), ("", []), ("   ", []), (None, []),
    ('"/open.jpg', ["/open.jpg"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "row_id long, packed string")
    got = {}
    for r in split_packed(df, "packed", "image_path").collect():
        got.setdefault(r.row_id, {})[r.pos] = r.image_path
    for i, (c, want) in enumerate(CASES):
        have = got.get(i, {})
        assert [have[k] for k in sorted(have)] == want, c
        assert sorted(have) == list(range(1, len(want) + 1))


def test_long_field_repeats_and_extra_columns(spark):
    long = ",".join(f"/p/{k}.jpg" for k in range(3000))
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x")], "row_id long, packed string, `pos.x` string")
    out = split_packed(df, "packed")
    assert out.columns == ["row_id", "pos.x", "pos", "value"]
    assert out.count() == 6000
    with pytest.raises(ValueError):
        split_packed(df.withColumnRenamed("row_id", "pos"), "packed")


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, packed string")
    assert split_packed(df, "packed").count() == 0


def test_one_very_long_field_is_split_in_linear_time(spark):
    import time

    def seconds(n):
        packed = "[" + ", ".join(f'"/p/{k}, x.jpg"' for k in range(n)) + ", " + "'/q/" + "y" * 200_000 + "']"
        df = spark.createDataFrame([(1, packed)], "row_id long, packed string")
        began = time.time()
        assert split_packed(df, "packed").agg({"pos": "max"}).first()[0] == n + 1
        return time.time() - began

    seconds(1000)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 20 * max(small, 0.5), (small, large)
