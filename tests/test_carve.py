import numpy as np

from plumbline.operators import carve as C
from plumbline.operators import detect
from plumbline.operators import kernels as K
from plumbline.sources import images


def house(door_side_thin=True):
    """A house with a room on the right whose outer wall is thin, as a garage door is drawn."""
    page = images.drawing([np.array([(20, 20), (300, 20), (300, 160), (20, 160)], float), np.array([(200, 20), (200, 160)], float)], 340, 200, 7)
    if door_side_thin:
        page[30:150, 297:304] = 255
        page[30:150, 299:301] = 0
    ink, _, _ = K.binarize(page)
    wall, _ = detect.walls(ink)
    return page, ink, ink, K.enclosed(wall, 2)


def test_labelled_room_is_cut():
    page, ink, wall, full = house(False)
    found = C.regions(full, wall, ink, None, [("garage", 240.0, 80.0, 260.0, 100.0)], auto=False)
    assert len(found) == 1 and found[0].confidence == C.LABELLED
    left, cut, voids = C.carved(full, found)
    xs = np.nonzero(left)[1]
    assert len(cut) == 1 and not voids and 195 <= xs.max() <= 205 and left.sum() < 0.7 * full.sum()


def test_garage_by_its_door():
    page, ink, wall, full = house(True)
    found = C.regions(full, wall, ink, None, [])
    assert [r.source for r in found] == ["garage"] and np.nonzero(found[0].mask)[1].min() > 195
    assert C.regions(*[house(False)[k] for k in (3, 2, 1)], None, []) == []


def test_shade_and_agreement():
    page, ink, wall, full = house(False)
    gray = K.gray(page).copy()
    gray[30:150, 210:290] = np.where(gray[30:150, 210:290] > 200, 200, gray[30:150, 210:290])
    found = C.regions(full, wall, ink, gray, [("garage", 240.0, 80.0, 260.0, 100.0)], auto=False)
    assert len(found) == 1 and abs(found[0].confidence - 0.95) < 1e-9 and found[0].type == "garage"


def test_limits():
    full = np.zeros((100, 100), bool)
    full[10:90, 10:90] = True
    big, mid = np.zeros_like(full), np.zeros_like(full)
    big[10:90, 10:70] = True
    mid[30:50, 30:50] = True
    left, cut, voids = C.carved(full, [C.Region(big, "x", 0.9, "label"), C.Region(mid, "y", 0.5, "label")], 0)
    assert [r.type for r in cut] == ["y"] and len(voids) == 1 and voids[0].sum() == 400


def test_points_that_are_known_to_be_inside_raise_a_wider_closing(spark):
    page = images.drawing([np.array([(20, 20), (300, 20), (300, 160), (20, 160)], float)], 340, 200, 6)
    page[60:84, 294:306] = 255
    df = spark.createDataFrame([(1, 340, 200, bytearray(page.tobytes()))], "plan_id bigint, width int, height int, data binary")
    points = spark.createDataFrame([(1, 100.0, 100.0), (1, 250.0, 140.0), (1, 5.0, 5.0)], "plan_id bigint, x double, y double")
    f = detect.floors(df, points).first()
    assert abs(f.area_px - 287 * 147) < 0.05 * 287 * 147 and f.score > 0.9
