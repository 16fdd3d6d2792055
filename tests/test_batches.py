import os

import numpy as np
import pytest

from panelscope.operators.images import resize_bilinear
from panelscope.sources.batches import folder_batches, tensor
from panelscope.sources.sinks import png_bytes


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root, rng, imgs = str(tmp_path_factory.mktemp("folders")), np.random.default_rng(1), {}
    for i in range(75):
        cls = ("cat", "dog", "other")[i % 3]
        a = rng.integers(0, 255, (5 + i % 2, 6, (1, 3)[i % 2]), dtype=np.uint8)
        os.makedirs(os.path.join(root, cls), exist_ok=True)
        with open(os.path.join(root, cls, f"f{i // 3:02d}.png"), "wb") as f:  # names repeat over the folders
            f.write(png_bytes(a))
        imgs[f"{cls}/f{i // 3:02d}.png"] = a
    return root, imgs


def test_each_file_once_an_epoch_and_another_order_in_the_next(spark, folders):
    root, imgs = folders
    train = folder_batches(spark, root, size=(4, 3))
    assert train.classes == ["cat", "dog", "other"] and train.counts == {"decoded": 75, "failed": 0}
    orders = []
    for epoch in (0, 1):
        rows = sorted(train.epoch(epoch, seed=2).collect(), key=lambda r: r["batch_id"])
        assert [(r["epoch"], r["batch_id"], r["n"]) for r in rows] == [(epoch, 0, 32), (epoch, 1, 32), (epoch, 2, 11)]
        for r in rows:
            x = tensor(r["x"], r["n"], train.size, train.channels)
            assert x.shape == (r["n"], 4, 3, 3) and len(r["y"]) == r["n"]
            for name, px, hot in zip(r["names"], x, r["y"], strict=True):
                a = imgs[name]
                want = resize_bilinear(np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a, 4, 3)
                assert np.allclose(px, want / 255.0, atol=1e-6)
                assert hot == [int(name.startswith(c)) for c in train.classes]
        orders.append([n for r in rows for n in r["names"]])
        assert sorted(orders[-1]) == sorted(imgs)
    again = sorted(folder_batches(spark, root, size=(4, 3)).epoch(0, seed=2).collect(), key=lambda r: r["batch_id"])
    assert [n for r in again for n in r["names"]] == orders[0] != orders[1]
    assert orders[0] != sorted(imgs)
    plain = sorted(train.epoch(0, shuffle=False, batch_size=75).collect(), key=lambda r: r["batch_id"])
    assert plain[0]["names"] == sorted(imgs)


def test_classes_gray_augmented_and_unreadable(spark, folders, tmp_path):
    root, imgs = folders
    train = folder_batches(spark, root, classes=["other", "cat"], size=(6, 6), channels=1)
    rows = train.epoch(0, batch_size=50).collect()
    assert [(r["n"], sorted({n.split("/")[0] for n in r["names"]})) for r in rows] == [(50, ["cat", "other"])]
    assert all(hot == [int(n.startswith("other")), int(n.startswith("cat"))] for n, hot in zip(rows[0]["names"], rows[0]["y"], strict=True))
    assert tensor(rows[0]["x"], 50, (6, 6), 1).shape == (50, 6, 6, 1)
    warped = [train.epoch(e, batch_size=50, shuffle=False, augment=True).collect()[0]["x"] for e in (0, 1, 0)]
    assert warped[0] == warped[2] != warped[1]
    bad = tmp_path / "bad"
    (bad / "a").mkdir(parents=True)
    (bad / "a" / "x.png").write_bytes(b"no image")
    (bad / "a" / "y.png").write_bytes(png_bytes(np.ones((2, 2, 1), np.uint8)))
    with pytest.raises(ValueError, match="x.png"):
        folder_batches(spark, str(bad))
    some = folder_batches(spark, str(bad), size=(2, 2), unreadable="skip")
    assert some.counts == {"decoded": 1, "failed": 1} and [r["names"] for r in some.epoch().collect()] == [["a/y.png"]]
    (tmp_path / "none").mkdir()
    assert folder_batches(spark, str(tmp_path / "none")).epoch().count() == 0
