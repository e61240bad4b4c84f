"""Every query of the catalogue against the same in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from pixelloom.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else round(v, 9) if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_detect_encoded_takes_every_image(spark, sf_dir):
    got = QUERIES["detect_encoded"](spark, sf_dir).toPandas()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert len(got) == 7 * parts and got["image_id"].nunique() == parts
    assert (got["name"] == got["format"]).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_shuffle_for_pixel_projections(spark, sf_dir):
    for name in ("rotate_90", "mirror_h", "crop", "orient_all8", "resize_bilinear", "resize_nearest", "png_filter_choice", "grid_stitch"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


@pytest.mark.parametrize("name", ["has_edits", "palette_join"])
def test_no_broadcast_or_shuffle_of_packed_images(spark, sf_dir, name):
    """Packed images are larger than Spark takes them for: only keys are shuffled, and nothing is broadcast through the driver."""
    found = QUERIES[name](spark, sf_dir)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange " in line)


def test_images_of_one_file_are_coded_in_many_tasks(spark, sf_dir):
    assert QUERIES["roundtrip_webp"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["max_channel_error"])
def test_no_broadcast_of_decoded_images(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_palette_indexes_of_odd_pixels(spark):
    """Repeated images and pixels keep their rows; clear pixels and pixels without an id or a colour have none."""
    from pixelloom.operators import colors

    cells = [(1, 0, 0, 9, 9, 9, 128), (1, 0, 1, 2, 0, 0, 255), (1, 0, 2, 1, 255, 0, 255), (1, 0, 3, 0, 0, 0, 127), (1, 0, 4, 2, 0, 0, 255), (1, 0, 4, 2, 0, 0, 255), (2, 0, 0, 5, 5, 5, 255), (None, 0, 0, 5, 5, 5, 255), (2, 0, 1, None, 5, 5, 255), (2, 0, 2, 1, 1, 1, None)]
    pixels = spark.createDataFrame(cells, "image_id long, y int, x int, r int, g int, b int, a int")
    want = pixels.filter("a >= 128").join(colors.palette(pixels), ["image_id", "r", "g", "b"]).select("image_id", "y", "x", "idx")
    got = sorted(map(tuple, colors.indexed(pixels).collect()))
    assert got == sorted(map(tuple, want.collect())) == [(1, 0, 0, 2), (1, 0, 1, 1), (1, 0, 2, 0), (1, 0, 4, 1), (1, 0, 4, 1), (2, 0, 0, 1)]
