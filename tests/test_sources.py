import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasselworks.sources import corpus, images, sinks


def png(rgb):
    a = np.asarray(rgb, np.uint8)
    raw = b"".join(b"\x00" + row.tobytes() for row in a)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(3)

    def put(name, data):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)

    flat = np.full((24, 30, 3), 20)
    noisy = rng.integers(0, 255, (40, 32, 3))
    put("clean/healthy/real/a.png", png(flat))
    put("clean/healthy/real/B.JPG", b"no picture")
    put("clean/healthy/lab/c.png", png(noisy))
    put("clean/healthy/lab/d.png", png(noisy))
    put("clean/healthy/temporal/x.png", png(flat))
    put("clean/healthy/real/notes.txt", b"x")
    put("clean/otros/real/y.png", png(flat))
    put("clean/common_rust/lab/e.png", png(np.full((8, 8, 3), 250)))
    return root


def test_corpus_scan(spark, tree):
    m = corpus.scan_corpus(spark, f"{tree}/clean")
    got = {(r.label, r.environment, r.image_path) for r in m.collect()}
    assert got == {("healthy", "real", "healthy/real/a.png"), ("healthy", "real", "healthy/real/B.JPG"), ("healthy", "lab", "healthy/lab/c.png"), ("healthy", "lab", "healthy/lab/d.png"), ("common_rust", "lab", "common_rust/lab/e.png")}
    assert "content" not in m._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        corpus.require_pictures(m.limit(0))
    with pytest.raises(ValueError):
        corpus.scan_corpus(spark, f"{tree}/nowhere").collect()
    assert corpus.images_below(spark, str(tree)).count() == 7
    assert corpus.files_with_extension(spark, str(tree)).count() == 8
    usage = {r.folder: r.n for r in corpus.folder_usage(corpus.scan_files(spark, f"{tree}/clean")).collect()}
    assert usage == {"healthy": 6, "otros": 1, "common_rust": 1, None: 8}
    exact = corpus.scan_corpus(spark, f"{tree}/clean", content=True).select(F.sha2("content", 256).alias("h")).distinct().count()
    assert exact == 4


def test_images(spark, tree):
    df = images.read_images(spark, f"{tree}/clean/healthy/{{lab,real}}/*.{{png,JPG}}")
    assert images.integrity(df).first() == (3, 1)
    dims = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.aspect) for r in images.dimensions(df).collect()}
    assert dims == {"a.png": (30, 24, 1.25), "c.png": (32, 40, 0.8), "d.png": (32, 40, 0.8)}
    q = {r.path.rsplit("/", 1)[1]: r for r in images.quality(df).collect()}
    assert q["a.png"].blur_var == 0 and q["a.png"].is_blurry and q["a.png"].is_dark and q["a.png"].brightness == 20
    assert not q["c.png"].is_blurry and not q["c.png"].is_dark and q["c.png"].phash == q["d.png"].phash != q["a.png"].phash
    for stage in ("train", "minority", "val"):
        t = images.tensors(df, stage, (16, 12)).collect()
        again = {r.path: r.tensor for r in images.tensors(df.repartition(3), stage, (16, 12)).collect()}
        assert len(t) == 3 and all(len(r.tensor) == 3 * 16 * 12 and again[r.path] == r.tensor for r in t)
    flat = next(r for r in images.tensors(df, "inference", (4, 4)).collect() if r.path.endswith("a.png"))
    assert abs(flat.tensor[0] - (20 / 255 - 0.485) / 0.229) < 1e-5
    files = corpus.scan_files(spark, f"{tree}/clean/healthy", content=True).where("path LIKE '%.png' OR path LIKE '%.JPG'")
    heads = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.orientation) for r in images.file_headers(files).collect()}
    assert heads["a.png"] == (30, 24, 1) and heads["B.JPG"] == (None, None, 1)
    up = {r.path.rsplit("/", 1)[1]: r for r in images.upright_rgb(df, images.file_headers(files).withColumn("orientation", F.lit(6))).collect()}
    assert (up["a.png"].width, up["a.png"].height, len(up["a.png"].rgb)) == (24, 30, 24 * 30 * 3)
    with pytest.raises(ValueError):
        images.transform(np.zeros((4, 4, 3)), "other", "k")


def test_headers_and_orientation():
    assert images.header_dimensions(png(np.zeros((5, 9, 3)))) == (9, 5)
    assert images.header_dimensions(b"GIF89a" + struct.pack("<HH", 7, 3)) == (7, 3)
    assert images.header_dimensions(b"nothing") is None
    tiff = b"II*\x00" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    body = b"Exif\x00\x00" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 4, 6, 1) + b"\x00\x00\x00"
    assert images.exif_orientation(jpeg) == 6 and images.header_dimensions(jpeg) == (6, 4)
    assert images.exif_orientation(png(np.zeros((2, 2, 3)))) == 1
    a = np.arange(6).reshape(2, 3)
    assert images.upright(a, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and images.upright(a, 3).tolist() == [[5, 4, 3], [2, 1, 0]]
    assert images.upright(a, 8).tolist() == [[2, 5], [1, 4], [0, 3]]


def test_near_pictures_have_near_hashes():
    rng = np.random.default_rng(1)
    base = images.resize(rng.integers(0, 255, (16, 16, 3)), 60, 60)
    near = np.clip(base + rng.normal(0, 2, base.shape), 0, 255)
    other = images.resize(rng.integers(0, 255, (16, 16, 3)), 60, 60)
    h = images.perceptual_hash
    assert (h(base) ^ h(near)).bit_count() <= 4 < 16 < (h(base) ^ h(other)).bit_count()


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.jpg\n\n  b.jpg \n")
    assert [r.path for r in corpus.path_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.jpg", "b.jpg"]
    groups = spark.createDataFrame([("/a, b.jpg", ["/c\".jpg", "/d.jpg"]), ("/e.jpg", ["/f.jpg"])], "keeper string, dups array<string>")
    out = tmp_path / "res" / sinks.duplicates_name("healthy", datetime(2026, 6, 8, 19, 36, 38))
    sinks.write_duplicates(groups, str(out))
    back = corpus.duplicate_csvs(spark, str(out)).collect()
    assert {(r.original_path, tuple(r.dups)) for r in back} == {("/a, b.jpg", ("/c\".jpg", "/d.jpg")), ("/e.jpg", ("/f.jpg",))}
    (tmp_path / "duplicates_gray_leaf_spot_20260607_060704.csv").write_text('original_path,duplicate_paths\n/x.jpg,"[""/y.jpg""]"\n/z.jpg,[]\n')
    one = corpus.duplicate_csvs(spark, str(tmp_path / "duplicates_*.csv")).collect()
    assert [(r.clase, r.original_path, r.dups) for r in one] == [("gray_leaf_spot", "/x.jpg", ["/y.jpg"])]
    (tmp_path / "db.csv").write_text("imgID_id,filePath,GLS,CR\n1,1.JPG,1,0\n2, ,1,0\n3,3.JPG, 1 ,1\n")
    rows, flags = corpus.onehot_csv(spark, str(tmp_path / "db.csv"))
    assert flags == ["GLS", "CR"] and rows.count() == 2
    with pytest.raises(ValueError):
        corpus.onehot_csv(spark, str(tmp_path / "db.csv"), fixed=True)
    files = spark.createDataFrame([("a", "duplicates_a_20260101_000000.csv"), ("a", "duplicates_a_20260201_000000.csv")], "g string, name string")
    assert corpus.latest_file(files, "name", "g").first().name == "duplicates_a_20260201_000000.csv"
    m = spark.createDataFrame([("p", "healthy", "lab", "train"), ("q", "healthy", "real", "val")], "image_path string, label string, environment string, split string")
    sinks.write_splits(m, str(tmp_path / "splits"))
    assert corpus.manifest_csv(spark, str(tmp_path / "splits" / "split=val")).collect()[0].image_path == "q"
    assert sinks.write_catalogue(m, str(tmp_path / "cat")) == 2 and sinks.write_catalogue(m.limit(1), str(tmp_path / "cat")) == 2
    assert sinks.write_catalogue(m.limit(1), str(tmp_path / "cat"), replace=True) == 1 and sinks.write_catalogue(m.limit(0), str(tmp_path / "cat"), replace=True) == 0
    sinks.write_metrics(spark.createDataFrame([("m", 1 / 3)], "model string, f1 double"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first().f1 == 0.333333
    sinks.write_report(m, str(tmp_path / "audit"))
    assert sinks.split_output_dir("splits/seed_42", "baseline") == "splits/seed_42_baseline"
    s = spark.createDataFrame([("r/.x/a", ".x/a"), ("r/_unlabeled/b", "_unlabeled/b"), ("r/c.jpg", "c.jpg"), ("r/k/d", "k/d")], "path string, relative string")
    assert {(r.path, r.label) for r in corpus.labelled_samples(s).collect()} == {("r/_unlabeled/b", None), ("r/c.jpg", "c.jpg"), ("r/k/d", "k")}
    assert corpus.annotation_files(spark, str(tmp_path / "list.txt")).first().body.startswith("a.jpg")


def test_config_and_source_rule(tmp_path):
    from tasselworks.sources import config

    (tmp_path / "c.yaml").write_text("dataset: {seed: 42}")
    assert config.load_config(str(tmp_path / "c.yaml"))["dataset"]["seed"] == 42
    assert config.resolve_source(str(tmp_path), ("hub",)) is None
    assert config.resolve_source(str(tmp_path), ("drive",), force=True) == "drive"
    assert config.resolve_source(str(tmp_path / "no"), ("hub", "drive")) == "hub"
    with pytest.raises(ValueError):
        config.resolve_source(str(tmp_path / "no"), ())


def test_split_walker_keeps_the_order_and_skips_a_missing_split(spark, tmp_path):
    from tasselworks.sources.corpus import split_annotations

    for split, names in (("test", "b a"), ("train", "d c")):
        (tmp_path / split / "labels").mkdir(parents=True)
        for name in names.split():
            (tmp_path / split / "labels" / f"{name}.txt").write_text(f"1 {name}\n2 {name}")
    got = [(r.split, r["name"], r.body) for r in split_annotations(spark, str(tmp_path)).orderBy("split_no", "name").collect()]
    assert got == [(s, f"{n}.txt", f"1 {n}\n2 {n}") for s, n in (("train", "c"), ("train", "d"), ("test", "a"), ("test", "b"))]
    assert split_annotations(spark, f"{tmp_path}/nothing").count() == 0
