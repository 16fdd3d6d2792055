"""File sources and sinks on PNGs written by hand (zlib only), and the
image-struct kernels."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators.augment import StructImage, amplify
from panelscope.operators import images as I
from panelscope.sources.files import list_samples, scan_csv, scan_dir_as_label, scan_images, scan_images_gray_by_dir
from panelscope.sources.sinks import export_png, png_bytes, save_images, write_by_category


def _write(path, arr):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(png_bytes(arr))


@pytest.fixture()
def image_dir(tmpdir_path):
    rng = np.random.default_rng(0)
    imgs = {}
    for i, cat in enumerate(["Dog", "Cat", "Dog", "Cat", "Dog"]):
        a = rng.integers(0, 255, size=(6, 6, 3), dtype=np.uint8)
        p = os.path.join(tmpdir_path, cat, f"cell{i:04d}.png")
        _write(p, a)
        imgs[f"cell{i:04d}.png"] = a
    _write(os.path.join(tmpdir_path, "Cat", "upper0099.PNG"), np.zeros((6, 6, 3), np.uint8))
    imgs["upper0099.PNG"] = np.zeros((6, 6, 3), np.uint8)
    with open(os.path.join(tmpdir_path, "Dog", "broken0007.png"), "wb") as fh:
        fh.write(b"not a png")
    with open(os.path.join(tmpdir_path, "notes.txt"), "w") as fh:
        fh.write("x")
    return tmpdir_path, imgs


def test_list_samples(spark, image_dir):
    root, _ = image_dir
    names = sorted(os.path.basename(r[0]) for r in list_samples(spark, root).select("path").collect())
    assert names == ["broken0007.png", "cell0000.png", "cell0001.png", "cell0002.png", "cell0003.png", "cell0004.png", "upper0099.PNG"]
    flat = list_samples(spark, [root], recursive=False).count()
    assert flat == 0
    txt = list_samples(spark, root, predicate=F.col("path").endswith(".txt")).count()
    assert txt == 1


def test_scan_images_decodes_bgr_and_keeps_invalid(spark, image_dir):
    root, imgs = image_dir
    df = scan_images(spark, root)
    rows = {r["LABEL_SAMPLE_ID"]: r for r in df.collect()}
    assert set(rows) == {*imgs, "broken0007.png"} and rows["broken0007.png"]["SAMPLE"] is None
    assert {r["LABEL_SAMPLE_ID"] for r in scan_images(spark, root, invalid="drop").collect()} == set(imgs)
    r = rows["cell0002.png"]
    got = np.frombuffer(r["SAMPLE"]["data"], np.uint8).reshape(6, 6, 3)
    assert (got == imgs["cell0002.png"]).all()  # png_bytes stores BGR input as RGB; the source gives BGR back
    assert r["MIRROR_AXIS"] == 0 and r["TRANSL_X"] == 0.0


def test_struct_kernels_match_numpy(spark, image_dir):
    root, imgs = image_dir
    df = scan_images(spark, root).where("LABEL_SAMPLE_ID = 'cell0001.png'")
    a = imgs["cell0001.png"]

    def dec(row):
        s = row["SAMPLE"]
        return np.frombuffer(s["data"], np.uint8).reshape(s["height"], s["width"], s["nChannels"])

    img = StructImage("SAMPLE")
    assert (dec(I.mirror_images(df, img, 1).first()) == a[::-1]).all()
    assert (dec(I.rotate_images(df, img, 90).first()) == np.rot90(a)).all()
    assert (dec(I.mirror_images(df, img, 4).first()) == np.rot90(np.flipud(a))).all()
    t = dec(I.translate_images(df, img, 0.5, -1).first())
    assert (t == np.roll(np.roll(a, -1, axis=0), 3, axis=1)).all()
    g = dec(I.to_gray(df).first())
    exp = np.rint(0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2]).astype(np.uint8)
    assert g.shape == (6, 6, 1) and (np.abs(g[..., 0].astype(int) - exp) <= 1).all()
    b = dec(I.to_binary(df).first())
    assert set(np.unique(b)) <= {0, 255}
    r = dec(I.resize(df, 3, 3).first())
    assert r.shape == (3, 3, 3)
    assert I.resize_bilinear(np.full((4, 4, 1), 7, np.uint8), 2, 2).tolist() == np.full((2, 2, 1), 7).tolist()
    fv = I.to_feature_vector("SAMPLE", 1 / 255)
    assert len(df.select(fv).first()[0]) == 108


def test_amplify_struct_images(spark, image_dir):
    root, imgs = image_dir
    df = scan_images(spark, root).where("LABEL_SAMPLE_ID LIKE 'cell%'")
    out = amplify(df, StructImage("SAMPLE"), translations=[(0.5, 0.0)], mirror_axes=(2,), rotations=(180,), num_buckets=2)
    rows = {r["LABEL_SAMPLE_ID"]: r for r in out.collect()}
    assert len(rows) == 5 * 2 * 2 * 2
    # the copy translated, mirrored and rotated of cell0000 (rank 1): 4 + 10 + 20 + 1 -> id 35
    last = rows["cell0035.png"]
    assert (last["TRANSL_X"], last["MIRROR_AXIS"], last["ROT_DEG"]) == (0.5, 2, 180)
    s = last["SAMPLE"]
    got = np.frombuffer(s["data"], np.uint8).reshape(6, 6, 3)
    exp = np.rot90(np.roll(imgs["cell0000.png"], 3, axis=1)[:, ::-1], 2)
    assert (got == exp).all()


def test_validate_images(spark, image_dir):
    root, _ = image_dir
    assert {r["reason"]: r["n"] for r in I.validate_images(scan_images(spark, root)).collect()} == {"ok": 6, "not_an_image": 1}
    df = scan_images(spark, root, invalid="drop")
    rep = {r["reason"]: r["n"] for r in I.validate_images(df).collect()}
    assert rep == {"ok": 6}
    bad = df.withColumn("SAMPLE", F.struct(F.lit("x").alias("origin"), F.lit(2).alias("height"), F.lit(3).alias("width"),
                                          F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.lit(b"abcdef").alias("data")))
    assert {r["reason"] for r in I.validate_images(bad).collect()} == {"not_square"}
    assert I.validate_images(bad, mode="drop").count() == 0
    with pytest.raises(Exception, match="invalid image"):
        I.validate_images(bad, mode="fail").collect()


def test_random_augment_is_repeatable(spark, image_dir):
    root, _ = image_dir
    df = scan_images(spark, root)
    a = I.random_augment(df, "LABEL_SAMPLE_ID", F.lit(1), seed=5).orderBy("LABEL_SAMPLE_ID").select("SAMPLE.data").collect()
    b = I.random_augment(df.repartition(3), "LABEL_SAMPLE_ID", F.lit(1), seed=5).orderBy("LABEL_SAMPLE_ID").select("SAMPLE.data").collect()
    c = I.random_augment(df, "LABEL_SAMPLE_ID", F.lit(2), seed=5).orderBy("LABEL_SAMPLE_ID").select("SAMPLE.data").collect()
    assert a == b and a != c


def test_bilinear_warp_of_exact_cases(spark):
    rng = np.random.default_rng(6)
    stack = rng.integers(0, 255, (4, 5, 5, 3), dtype=np.uint8)
    p = lambda *x: np.array([x] * 4, dtype=object)
    assert (I.warp_bilinear(stack, p(0.0, 0.0, 1.0, 1.0, False, False)) == stack).all()
    for deg in (90, 180, 270):
        turned = I._geometry_stack(stack, 0, 0, 0, deg)
        assert np.allclose(I.warp_bilinear(stack, p(float(-deg), 0.0, 1.0, 1.0, False, False)), turned, atol=1e-9)
    assert (I.warp_bilinear(stack, p(0.0, 0.0, 1.0, 1.0, True, False)) == stack[:, :, ::-1]).all()
    assert (I.warp_bilinear(stack, p(0.0, 0.0, 1.0, 1.0, False, True)) == stack[:, ::-1]).all()
    # half a zoom: between two pixels, their mean
    ramp = np.arange(5, dtype=float)[None, :, None, None] * np.ones((1, 5, 5, 1))
    half = I.warp_bilinear(ramp, np.array([[0.0, 0.0, 0.5, 1.0, False, False]], dtype=object))
    assert np.allclose(half[0, :, 0, 0], [1, 1.5, 2, 2.5, 3])
    # each image by its own parameters, none at a wrong place
    mixed = np.array([[-90.0, 0, 1, 1, False, False], [0.0, 0, 1, 1, False, False], [12.0, 0.3, 0.8, 1.2, True, False], [0.0, 0, 1, 1, False, True]], dtype=object)
    got = I.warp_bilinear(stack, mixed)
    assert np.allclose(got[0], np.rot90(stack[0])) and (got[1] == stack[1]).all() and (got[3] == stack[3][::-1]).all()
    assert np.allclose(got[2], I.warp_bilinear(stack[2:3], mixed[2:3])[0])


def test_dir_as_label_and_gray_by_dir(spark, image_dir):
    root, _ = image_dir
    d = scan_dir_as_label(spark, root)
    got = {r["LABEL_SAMPLE_ID"]: (r["class_name"], r["label"], list(r["one_hot"])) for r in d.collect()}
    assert got["cell0000.png"] == ("Dog", 1, [0, 1]) and got["cell0001.png"] == ("Cat", 0, [1, 0])
    g = scan_images_gray_by_dir(spark, root, ["Dog", "Cat"], size=4)
    shapes = {(r["SAMPLE"]["height"], r["SAMPLE"]["width"], r["SAMPLE"]["nChannels"]) for r in g.collect()}
    assert shapes == {(4, 4, 1)}
    assert sorted(r["label"] for r in g.collect()) == [0, 0, 0, 1, 1, 1]


def test_sinks(spark, image_dir, tmpdir_path):
    root, imgs = image_dir
    df = scan_images(spark, root, invalid="drop").withColumn("LABEL_CATEGORY", F.lit("pass")).withColumn("split", F.lit("train"))
    out = os.path.join(tmpdir_path, "export")
    export_png(df, out)
    back = scan_images(spark, out)
    assert back.count() == 6
    cat = os.path.join(tmpdir_path, "cats")
    write_by_category(df.select("LABEL_SAMPLE_ID", "LABEL_CATEGORY", "split"), cat, ["pass", "fail"])
    assert os.path.isdir(os.path.join(cat, "split=train", "LABEL_CATEGORY=fail"))
    assert spark.read.parquet(cat).where("LABEL_CATEGORY = 'pass'").count() == 6
    write_by_category(df.select("LABEL_SAMPLE_ID", "LABEL_CATEGORY", "split"), cat, ["pass", "fail"], keep_existing=True)
    assert spark.read.parquet(cat).count() == 6
    with pytest.warns(UserWarning):
        save_images(df, os.path.join(tmpdir_path, "saved"))
    assert sorted(os.listdir(os.path.join(tmpdir_path, "saved"))) == sorted([*imgs, "_SUCCESS"])


def test_scan_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "wine.csv")
    with open(p, "w") as fh:
        fh.write("fixed acidity,free sulfur dioxide,alcohol,quality\n7.4,11,9.4,5\n7.8,25,9.8,6\n")
    df = scan_csv(spark, p)
    assert dict(df.dtypes)["quality"] == "int" and dict(df.dtypes)["alcohol"] == "double"


def test_dataset_conversions_and_helpers(spark, image_dir):
    from panelscope.operators.learn import train_test_arrays
    from panelscope.operators.projections import const_columns, project_images

    root, _ = image_dir
    df = scan_images(spark, root, invalid="drop")
    state = {}
    b = I.dataset_to_binary(df, state=state)
    assert state == {"gray": True, "binary": True}
    assert {r["SAMPLE"]["nChannels"] for r in b.collect()} == {1}
    with pytest.raises(ValueError):
        I.dataset_to_gray(b, state=state)
    arr = spark.createDataFrame([([1.0, 2.0], None), ([3.0], 1)], "a array<double>, SAMPLE_C int")
    assert [r[0] for r in I.normalize_shape(arr).select("SAMPLE_C").collect()] == [1, 1]
    assert project_images(df).columns == ["SAMPLE"]
    assert const_columns(df, {"x": 0}).select("x").distinct().first()[0] == 0
    split = df.select("LABEL_SAMPLE_ID", "SAMPLE").withColumn("label", F.lit(1)).withColumn(
        "split", F.when(F.col("LABEL_SAMPLE_ID") < "cell0003", "train").otherwise("test"))
    tr, te = train_test_arrays(split, "SAMPLE", "label")
    assert tr.count() + te.count() == 6 and tr.columns == ["features", "label"]


def _labelled(tmpdir_path, names):
    lbl = os.path.join(tmpdir_path, "labels.csv")
    with open(lbl, "w") as fh:
        for i, n in enumerate(names):
            p = (0.0, 1.0, 1 / 3, 2 / 3)[i % 4]
            fh.write(f"images/{n.replace(' ', '_')}  {p}  {'poly' if p < 0.9 else 'mono'}\n")
    return lbl


def test_load_image_dataset_end_to_end(spark, image_dir, tmpdir_path):
    from panelscope.plans.datasets import load_image_dataset, prepare_for_training, write_training_layout

    root, imgs = image_dir
    ds = load_image_dataset(spark, _labelled(tmpdir_path, [*sorted(imgs), "broken0007.png"]), root)
    assert ds.current.count() == 5  # the 'mono' rows are filtered out
    assert ds.reset().current.count() == 7  # every label finds its file, long paths too
    got = {r["LABEL_SAMPLE_ID"]: r["SAMPLE"] for r in ds.pixels().collect()}
    assert ds.counts == {"decoded": 6, "failed": 1} and got["broken0007.png"] is None
    assert all((np.frombuffer(got[n]["data"], np.uint8).reshape(6, 6, 3) == a).all() for n, a in imgs.items())
    ds.filter("LABEL_CATEGORY = 'pass'")
    prepared = prepare_for_training(ds, 0.5, seed=1)
    assert ds.counts == {"decoded": 2, "failed": 0}
    assert prepared.count() == 2 * 60
    assert prepared.where("split = 'train'").count() == 60
    out = os.path.join(tmpdir_path, "layout")
    write_training_layout(prepared, out)
    assert os.listdir(os.path.join(out, "validate", "fail")) == []
    back = scan_dir_as_label(spark, os.path.join(out, "train"), ["pass", "fail"])
    want = {r["LABEL_SAMPLE_ID"]: bytes(r["SAMPLE"]["data"]) for r in prepared.where("split = 'train'").collect()}
    assert {r["LABEL_SAMPLE_ID"]: bytes(r["SAMPLE"]["data"]) for r in back.collect()} == want and len(want) == 60


def test_nothing_is_decoded_before_the_filter(spark, image_dir, tmpdir_path):
    from panelscope.plans.datasets import load_image_dataset

    root, imgs = image_dir
    ds = load_image_dataset(spark, _labelled(tmpdir_path, [*sorted(imgs), "broken0007.png"]), root)
    plan = ds.current._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "data" not in plan.lower().replace("datafilters", "") and "binaryfile" in plan.lower()
    ds.filter("PROBABILITY > 0.5")
    assert ds.pixels().count() == 1 and ds.counts == {"decoded": 1, "failed": 0}


def test_read_pixels_in_blocks_odd_names_and_repeats(spark, tmpdir_path):
    from panelscope.sources.files import list_images, read_pixels

    rng, want = np.random.default_rng(3), {}
    for i, name in enumerate(["a b.png", "a+b.png", "a%20b.png", "[x]{y}.png", "q?*.png", "é 漢.png", "back\\slash.png", "plain.png"]):
        want[name] = rng.integers(0, 255, (2 + i % 3, 4, (1, 3, 4)[i % 3]), dtype=np.uint8)
        _write(os.path.join(tmpdir_path, "deep er", name), want[name])
    listed = list_images(spark, tmpdir_path)
    assert "SAMPLE" not in listed.columns and {r["LABEL_SAMPLE_ID"] for r in listed.collect()} == set(want)
    rows = listed.select("LABEL_SAMPLE_ID", "SAMPLE_PATH").withColumn("SAMPLE", F.lit("replaced"))
    rows = rows.unionByName(rows.limit(1)).unionByName(rows.limit(1).withColumn("SAMPLE_PATH", F.lit(None).cast("string")))
    for block in (1, 3, 100):
        counts = {}
        got = read_pixels(rows, counts=counts, block=block).collect()
        assert counts == {"decoded": len(want), "failed": 0} and len(got) == len(want) + 2
        for r in got:
            s, a = r["SAMPLE"], want[r["LABEL_SAMPLE_ID"]]
            if r["SAMPLE_PATH"] is None:
                assert s is None
            else:
                assert (np.frombuffer(s["data"], np.uint8).reshape(a.shape) == a).all()
    bgr = {r["LABEL_SAMPLE_ID"]: r["SAMPLE"] for r in read_pixels(listed, channels=3).collect()}
    for n, a in want.items():
        full = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]
        assert (np.frombuffer(bgr[n]["data"], np.uint8).reshape(full.shape) == full).all() and bgr[n]["nChannels"] == 3
    assert read_pixels(listed.limit(0)).count() == 0
    os.remove(os.path.join(tmpdir_path, "deep er", "plain.png"))
    with pytest.raises(Exception, match="plain.png"):
        read_pixels(listed.withColumn("x", F.lit(1))).count()


def test_images_of_several_shapes_in_one_batch(spark):
    rng = np.random.default_rng(4)
    imgs = [rng.integers(0, 255, (h, w, c), dtype=np.uint8) for h, w, c in [(3, 3, 1), (4, 4, 3), (3, 3, 1), (4, 4, 3), (5, 5, 4)]]
    rows = [(f"i{k}.png", ("o", *a.shape[:2], a.shape[2], 0, a.tobytes())) for k, a in enumerate(imgs)] + [("i9.png", None)]
    meta = {"MIRROR_AXIS": F.lit(0).cast("short"), "ROT_DEG": F.lit(0).cast("short"), "TRANSL_X": F.lit(0.0), "TRANSL_Y": F.lit(0.0)}
    df = spark.createDataFrame(rows, "LABEL_SAMPLE_ID string, SAMPLE struct<origin string, height int, width int, nChannels int, mode int, data binary>").coalesce(1).withColumns(meta)

    def arrays(out, *extra):
        dec = lambda s: None if s["data"] is None else np.frombuffer(s["data"], np.uint8).reshape(s["height"], s["width"], s["nChannels"])
        return {tuple(r[c] for c in ("LABEL_SAMPLE_ID", *extra)): None if r["SAMPLE"] is None else dec(r["SAMPLE"]) for r in out.collect()}

    got = arrays(I.resize(df, 2, 2))
    assert all((got[(f"i{k}.png",)] == I.resize_bilinear(a, 2, 2)).all() for k, a in enumerate(imgs))
    got = arrays(I.map_images(df, lambda a: a[:1, :2, 0]))
    assert all((got[(f"i{k}.png",)][..., 0] == a[:1, :2, 0]).all() for k, a in enumerate(imgs))
    out = amplify(df, StructImage("SAMPLE"), translations=[(1, 0.5)], mirror_axes=(3,), rotations=(90,))
    got = arrays(out.withColumn("base", F.col("SAMPLE.origin")), "TRANSL_X", "MIRROR_AXIS", "ROT_DEG")
    assert len(got) == 6 * 8 and sum(a is None for a in got.values()) == 8
    moved = [v for k, v in got.items() if k[1:] == (1.0, 3, 90) and v is not None]
    want = [np.rot90(np.swapaxes(np.roll(a, (round(a.shape[0] / 2), 1), (0, 1)), 0, 1)) for a in imgs]
    assert sorted(a.tobytes() for a in moved) == sorted(np.ascontiguousarray(a).tobytes() for a in want)


def _files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_image_folder_is_all_or_nothing(spark, tmpdir_path):
    from panelscope.sources.sinks import write_files

    out = os.path.join(tmpdir_path, "out")
    rows = [(f"c{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(40)] + [(None, b"x"), ("gone.bin", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    write_files(df, out)
    assert _files(out) == sorted([n for n, c in rows if n and c is not None] + ["_SUCCESS"])
    assert open(os.path.join(out, "c1/f7.bin"), "rb").read() == bytes([7]) * 7
    before = _files(out)
    # a task that fails, a repeated name (in one task and over two), a name that exists, too little space: nothing changes
    bad = df.withColumn("content", F.when(F.col("name") == "c0/f9.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))).withColumn("name", F.concat(F.lit("new/"), "name"))
    twice = spark.createDataFrame([("t.bin", b"1"), ("t.bin", b"2")], "name string, content binary")
    fresh = spark.createDataFrame([("u.bin", b"1")], "name string, content binary")
    outside = spark.createDataFrame([("../u.bin", b"1")], "name string, content binary")
    for what, kw in ((bad, {}), (twice.coalesce(1), {}), (twice.repartition(2), {}), (df, {}), (fresh, {"min_free_bytes": 1 << 60}), (outside, {})):
        with pytest.raises(Exception):
            write_files(what, out, **kw)
        assert _files(out) == before and not os.path.exists(os.path.join(tmpdir_path, "u.bin"))
        assert not os.path.exists(os.path.join(out, "_temporary"))
    write_files(df.unionByName(fresh).withColumn("content", F.lit(b"other")), out, existing="keep")
    assert open(os.path.join(out, "c1/f7.bin"), "rb").read() == bytes([7]) * 7 and open(os.path.join(out, "u.bin"), "rb").read() == b"other"
    write_files(fresh, out, mode="overwrite")
    assert _files(out) == ["_SUCCESS", "u.bin"]


def test_an_attempt_that_is_killed_leaves_nothing(spark, tmpdir_path):
    from panelscope.sources.image_folder import ImageFolderWriter

    import pyarrow as pa
    from types import SimpleNamespace
    from unittest import mock

    out = os.path.join(tmpdir_path, "kill")
    os.makedirs(out)
    w = ImageFolderWriter({"path": out}, False)
    batch = pa.RecordBatch.from_arrays([pa.array(["a/x.bin", "y.bin"]), pa.array([b"1", b"22"])], names=["name", "content"])
    attempt = lambda n: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: n)

    def dies():
        yield batch
        raise KeyboardInterrupt

    with mock.patch("panelscope.sources.image_folder.TaskContext.get", lambda: attempt(1)), pytest.raises(KeyboardInterrupt):
        w.write(dies())
    with mock.patch("panelscope.sources.image_folder.TaskContext.get", lambda: attempt(2)):
        message = w.write(iter([batch]))
    assert all("_temporary" in f for f in _files(out))
    w.commit([message, None])
    assert _files(out) == ["_SUCCESS", "a/x.bin", "y.bin"] and not os.path.exists(os.path.join(out, "_temporary"))


def test_category_folders_copy_files_and_read_back(spark, image_dir, tmpdir_path):
    from panelscope.sources.files import list_images
    from panelscope.sources.sinks import write_category_folders

    root, imgs = image_dir
    df = list_images(spark, root).where("LABEL_SAMPLE_ID != 'broken0007.png'")
    df = df.withColumn("LABEL_CATEGORY", F.when(F.col("LABEL_SAMPLE_ID") < "cell0003", "pass").otherwise("fail"))
    out = os.path.join(tmpdir_path, "flat")
    write_category_folders(df, out, ["pass", "fail", "minor"], split_col=None, col=None)
    assert os.listdir(os.path.join(out, "minor")) == []
    back = {r["LABEL_SAMPLE_ID"]: (r["class_name"], bytes(r["SAMPLE"]["data"])) for r in scan_dir_as_label(spark, out).collect()}
    assert back == {n: ("pass" if n < "cell0003" else "fail", a.tobytes()) for n, a in imgs.items()}
    write_category_folders(df, out, ["pass"], split_col=None, col=None, existing="keep")
    with pytest.raises(Exception, match="category"):
        write_category_folders(df.withColumn("LABEL_CATEGORY", F.lit(None).cast("string")), out + "2", ["pass"], split_col=None, col=None)


def test_class_names_come_from_the_listing_and_small_files_share_tasks(spark, tmp_path, monkeypatch):
    from panelscope.sources import files

    for i in range(700):
        _write(str(tmp_path / f"c{i % 3}" / f"f{i}.png"), np.full((2, 2), i % 251, np.uint8))
    scan = files.scan_images
    decoded = lambda *a, **kw: scan(*a, **kw).withColumn("SAMPLE_PATH", F.raise_error(F.lit("decoded")).cast("string"))
    with monkeypatch.context() as m:
        m.setattr(files, "scan_images", decoded)
        scan_dir_as_label(spark, str(tmp_path))  # without a pixel
    got = scan_dir_as_label(spark, str(tmp_path))
    assert {(r["class_name"], r["label"], r["n"]) for r in got.groupBy("class_name", "label").agg(F.count("SAMPLE").alias("n")).collect()} == {("c0", 0, 234), ("c1", 1, 233), ("c2", 2, 233)}
    least = 4 * spark.sparkContext.defaultParallelism
    for df in (list_samples(spark, str(tmp_path)), scan(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() <= least < 700 / 32


def test_pixels_look_up_their_files_in_few_tasks(spark, tmp_path):
    from panelscope.sources import files

    for i in range(150):
        _write(str(tmp_path / f"f{i}.png"), np.full((2, 2), i, np.uint8))
    rows = files.list_images(spark, str(tmp_path))
    before = spark.conf.get(files.LOOKUP_CONF)
    spark.sparkContext.setJobGroup("lookup", "lookup")
    try:
        got = files.read_pixels(rows).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("lookup") for s in tracker.getJobInfo(j).stageIds]
    assert max(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) <= files.LOOKUP_TASKS
    assert spark.conf.get(files.LOOKUP_CONF) == before
    assert {(os.path.basename(r["SAMPLE_PATH"]), bytes(r["SAMPLE"]["data"])[0]) for r in got} == {(f"f{i}.png", i) for i in range(150)}


def test_commit_moves_many_files_at_a_time(tmp_path, monkeypatch):
    import threading
    import time

    from panelscope.sources import image_folder as sink

    threads = set()

    class Slow:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def move(self, source, target):
            threads.add(threading.get_ident())
            time.sleep(0.001)
            self.files.move(source, target)

    target = str(tmp_path / "out")
    w = sink.ImageFolderWriter({"path": target}, False)
    folder = os.path.join(target, w.stage, "0-0")
    os.makedirs(os.path.join(folder, "a"))
    for i in range(500):
        with open(os.path.join(folder, "a", f"{i}.bin"), "wb") as fh:
            fh.write(b"%d" % i)
    real = sink.filesystem
    monkeypatch.setattr(sink, "filesystem", lambda path: (Slow(real(path)[0]), real(path)[1]))
    w.commit([sink.Written(folder, 500, 0)])
    assert len(threads) > 1
    assert sorted(os.listdir(os.path.join(target, "a"))) == sorted(f"{i}.bin" for i in range(500))
    assert sorted(os.listdir(target)) == ["_SUCCESS", "a"]
