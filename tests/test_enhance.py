import numpy as np
import pytest

from plumbline.operators import enhance as E
from plumbline.operators import kernels as K
from plumbline.operators import rooms
from plumbline.sources import images

RNG = np.random.default_rng(9)


def test_scaling():
    g = RNG.integers(0, 256, (20, 30), dtype=np.uint8)
    small = E.scaled(g, 0.5)
    assert small.shape == (10, 15) and small[3, 4] == int(g[6:8, 8:10].sum()) // 4
    assert E.scaled(np.full((5, 7), 90, np.uint8), 2.0).tolist() == [[90] * 14] * 10
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    assert (np.diff(E.scaled(ramp, 3.0)[5].astype(int)) >= 0).all()


def test_unsharp_against_a_slow_version():
    g = RNG.integers(0, 256, (9, 11), dtype=np.uint8)
    k = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) / 16
    want = g.copy()
    for y in range(1, 8):
        for x in range(1, 10):
            want[y, x] = int(np.clip(g[y, x] + 0.6 * (float(g[y, x]) - (k * g[y - 1 : y + 2, x - 1 : x + 2]).sum()), 0, 255))
    assert np.abs(E.unsharp(g, 0.6).astype(int) - want).max() <= 1


def test_equalisation_and_stretch():
    g = (RNG.integers(100, 140, (64, 64))).astype(np.uint8)
    out = E.clahe(g)
    assert out.std() > g.std() and E.clahe(np.full((40, 40), 77, np.uint8)).std() < 1
    s = E.stretch(g)
    assert s.min() == 0 and s.max() == 255 and (E.stretch(np.full((3, 3), 5, np.uint8)) == 5).all()
    assert E.median3(np.array([[0, 0, 0], [0, 255, 0], [0, 0, 0]], np.uint8)).max() == 0


def letters(page, x, y, n, vertical=False):
    for k in range(n):
        a, b = (x, y + k * 12) if vertical else (x + k * 9, y)
        page[b : b + 10, a] = page[b : b + 10, a + 5] = True
        page[b + 5, a : a + 6] = True


def test_text_regions():
    page = np.zeros((200, 300), bool)
    letters(page, 20, 20, 6)
    letters(page, 150, 60, 4)
    page[100, 10:290] = True  # a wall line is no text
    rows, cols, tall = E.text_regions(page)
    assert rows[:, [0, 1, 4]].tolist() == [[20, 20, 6], [150, 60, 4]] and tall == 10 and len(cols) == 0
    assert not E.without_structure(page)[100].any()
    assert len(E.text_regions(np.zeros((5, 5), bool))[0]) == 0


def test_center_band_and_frame():
    ink = np.zeros((30, 10), bool)
    ink[2:4] = ink[12:18] = True
    assert E.center_band(ink).any(axis=1).nonzero()[0].tolist() == [*range(12, 18)]
    assert E.framed(np.zeros((2, 2), np.uint8), 3).shape == (8, 8) and set(np.unique(E.binary(np.array([[0, 255]], np.uint8)))) == {0, 255}


def test_corner():
    dark = np.zeros((60, 60), bool)
    dark[30:, 20:] = True
    x, y = E.corner(dark, 25, 27)
    assert abs(x - 20) <= 2 and abs(y - 30) <= 2 and E.corner(np.zeros((60, 60), bool), 30, 30) is None


@pytest.mark.parametrize("door", [False, True])
def test_room_around_a_label(door):
    ring = np.array([(20, 20), (220, 20), (220, 140), (20, 140)], float)
    page = images.drawing([ring, np.array([(120, 20), (120, 140)], float)], 260, 180, 5)
    if door:
        page[70:90, 115:126] = 255
    ink, scale, _ = K.binarize(page)
    wall, _ = rooms.detect.walls(ink)
    x0, y0, x1, y1, sure = rooms.grow(wall, K.summed(wall), 70, 80, 95.0, 115.0)
    assert (x0, y0, x1, y1) == (23, 23, 117, 137) and sure > 0.8
    assert rooms.grow(wall, K.summed(wall), 250, 170, 10, 10) is None and rooms.grow(wall, K.summed(wall), -5, 3, 1, 1) is None


def test_segments_of_walls():
    page = images.drawing([np.array([(20, 20), (220, 20), (220, 140), (20, 140)], float)], 260, 180, 5)
    ink, _, _ = K.binarize(page)
    flat = K.segments(ink, 40, "h")
    assert flat[:, :4].tolist() == [[18, 22, 18, 222], [138, 142, 18, 222]]
    assert len(K.segments(ink, 40, "v")) == 2
