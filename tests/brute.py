"""Brute-force, single-machine simulations used as oracles in tests."""

from __future__ import annotations

import re

import numpy as np

ID_RE = re.compile(r"(?P<prefix>.*?)(?P<num>\d+)(?P<suffix>.*)")


def order_key(i):
    m = ID_RE.match(i)
    return (int(m["num"]), i)


def amplify_sim(rows, translations, axes, rotations, semantics="documented"):
    """rows: list of dict(id, img (h,w,1) ndarray, tx, ty, axis, deg), stage by stage."""
    data = sorted(rows, key=lambda r: order_key(r["id"]))

    def stats(d):
        nums = [ID_RE.match(r["id"]) for r in d]
        return max(int(m["num"]) for m in nums), max(len(m["num"]) for m in nums)

    def new_ids(sub, cur_max, width):
        out = []
        for i, r in enumerate(sub):
            m = ID_RE.match(r["id"])
            out.append(f"{m['prefix']}{str(cur_max + 1 + i).zfill(width)}{m['suffix']}")
        return out

    def roll(img, tx, ty):
        h, w = img.shape[:2]
        dx = (round(w * tx) if isinstance(tx, float) else tx) % w
        dy = (round(h * ty) if isinstance(ty, float) else ty) % h
        return np.roll(np.roll(img, dy, axis=0), dx, axis=1)

    def mirror(img, a):
        return {1: lambda x: x[::-1], 2: lambda x: x[:, ::-1], 3: lambda x: np.rot90(np.fliplr(x)), 4: lambda x: np.rot90(np.flipud(x))}[a](img)

    # translate
    cur_max, width = stats(data)
    elig = [r for r in data if r["tx"] == 0 and r["ty"] == 0]
    add = []
    for x, y in translations:
        ids = new_ids(elig, cur_max, width)
        for r, i in zip(elig, ids):
            img = roll(r["img"], x, y) if semantics == "documented" else r["img"]
            add.append(dict(r, id=i, img=img, tx=x, ty=y))
        cur_max += len(elig)
    data = data + add
    # mirror
    cur_max, width = stats(data)
    elig = [r for r in data if r["axis"] == 0]
    add = []
    for a in axes:
        ids = new_ids(elig, cur_max, width)
        for r, i in zip(elig, ids):
            add.append(dict(r, id=i, img=mirror(r["img"], a), axis=a if semantics == "documented" else 0))
        cur_max += len(elig)
    data = data + add
    # rotate
    cur_max, width = stats(data)
    elig = [r for r in data if r["deg"] == 0]
    add = []
    for d in sorted({x % 360 for x in rotations}):
        ids = new_ids(elig, cur_max, width)
        for r, i in zip(elig, ids):
            img = np.rot90(r["img"], k=d // 90) if semantics == "documented" else r["img"]
            add.append(dict(r, id=i, img=img, deg=d))
        cur_max += len(elig)
    return data + add
