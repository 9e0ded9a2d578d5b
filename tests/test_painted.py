"""Rasters painted and read in batches, against single ones."""

import numpy as np

from planmill.operators import regions
from planmill.sources import raster

SF = "/root/testdata/sf0.001"


def test_rasters_painted_in_the_task_are_the_drawn_ones(spark):
    columns = ["plan_id", "g", "lab", "y", "x0", "x1"]
    plain = regions.label_images(raster.drawn_images(spark, SF)).select(*columns)
    painted = regions.label_images(raster.drawn_rects(spark, SF), made=raster.paint).select(*columns)
    doors = regions.label_images(raster.drawn_rects(spark, SF), codes=[15, 17], made=raster.paint).select(*columns)
    assert plain.exceptAll(painted).isEmpty() and painted.exceptAll(plain).isEmpty()
    assert doors.exceptAll(plain.filter("g in (15, 17)")).isEmpty() and doors.count() == plain.filter("g in (15, 17)").count() > 0


def test_runs_of_rasters_of_several_sides_read_together():
    rng = np.random.default_rng(3)
    rasters = [(i, rng.integers(0, 3, s).astype(np.uint8)) for i, s in enumerate([(4, 5), (5, 4), (4, 5), (1, 1), (300, 300), (4, 5)])]
    got = sorted(zip(*(c.tolist() for c in raster.runs_of(rasters)), strict=True))
    assert got == sorted((i, *r) for i, codes in rasters for r in zip(*(c.tolist() for c in raster.code_runs(codes)), strict=True))


def test_a_batch_goes_through_its_rasters_once(spark):
    """Rasters may be made, or read from a store, each time they are asked for; ids were counted and outlines found in runs of their own."""
    from planmill.plans import extract

    images = raster.damaged_images(spark, SF)
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    n = images.count()
    batch = extract.run_batch(images.mapInArrow(counted, images.schema))
    assert batch.records.count() + batch.ledger.count() == n
    assert passed.value == n
