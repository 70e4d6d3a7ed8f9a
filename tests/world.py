"""A small warehouse: two image sets, three annotation batches, boxes, lineage."""

from datetime import date, datetime

from tarnloom.sources.catalog import SCHEMAS, Catalog

H = {c: c * 64 for c in "abcdef"}
T = datetime(2024, 1, 1)
TABLES = {
    "batches": [("left", "image", "V1", 1, T), ("right", "image", "V1", 2, T), ("left", "annotation", "V1", 1, T), ("left", "annotation", "V2", 2, T), ("right", "annotation", "V1", 3, T)],
    "images": [
        (1, 1, "a.png", 100, 200, H["a"], 1, date(2020, 1, 1)),
        (2, 1, "b.png", 100, 200, H["b"], 1, date(2021, 6, 1)),
        (3, 1, "c.jpg", 300, 300, None, None, None),
        (4, 1, "d", 300, 300, H["d"], None, date(2022, 1, 1)),
        (5, 2, "a.png", 100, 200, H["a"], 2, date(2020, 1, 1)),
        (6, 2, "e.png", 50, 60, H["e"], 2, date(2023, 1, 1)),
        (7, 2, "f.png", 50, 60, None, None, date(2023, 2, 1)),
    ],
    "image_subjects": [(1, "S1"), (2, "S1"), (4, ""), (5, "S1"), (6, "S2")],
    "image_lineage": [(1, 6), (1, 6)],
    "annotators": [(1, "junior"), (2, "senior"), (3, "other")],
    "categories": [(1, 1, "Pneumonia", "finding"), (2, 1, "Normal", None), (3, 2, "Pneumonia", None), (4, 2, "Normal", None), (5, 3, "PNEU", None), (6, 3, "TB", None)],
    "cls_annotations": [
        (1, 1, 1, 1, 0.9, 1),
        (2, 1, 2, 2, 0.8, 1),
        (3, 1, 4, 1, 0.0, 1),
        (4, 2, 1, 4, 0.7, 2),
        (5, 2, 2, 4, 0.8, 2),
        (6, 3, 5, 5, 0.6, 3),
        (7, 3, 6, 6, 0.5, 3),
        (7, 3, 6, 6, 0.5, 3),
        (8, 3, 6, 5, 0.4, 3),
    ],
    "det_annotations": [
        (1, 3, 6, 6, [1.0, 2.0, 3.0, 4.0], "[[1,2,3,4,5,6]]", 0, None, 3),
        (2, 3, 7, 6, [1.0, 1.0, 2.0, 2.0], "[1,2,3,4]", 0, 0.5, 3),
    ],
}
MAPPING = {"left@V1": {"Pneumonia": "pneumonia", "Normal": "normal"}, "left@V2": {"Pneumonia": "pneumonia", "Normal": "normal"}, "right@V1": {"PNEU": "pneumonia", "TB": "tb"}}


def world(spark) -> Catalog:
    return Catalog(spark, {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in TABLES.items()})
