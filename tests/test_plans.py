"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from footgrid.operators import stencil as S
from footgrid.plans import QUERIES, inputs as I

PYTHON_QUERIES = {"components", "component_sizes", "remove_small", "fill_holes", "polygonize_shapes", "polygonize_rings", "mask_iou",
                  "score_tiles", "score_failures", "stored_predictions_reused", "edge_guided_mask", "building_map",
                  "settlement_map", "evaluation_report", "detected_shapes"}
CHECKED = ["settlement_building_pairs", "buildings_in_aoi", "tiles_in_aoi", "labels_in_image", "building_iou_pairs", "building_pr",
           "buildings_per_tile", "burn_boxes", "training_mask", "erode3", "median3", "gauss_weights", "brovey", "affine_resample",
           "wkt_area", "labels_from_tasks", "dice_loss", "train_test_split", "pan_todo", "minmax_preview", "tile_index"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_and_no_python(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert not re.search(r"ArrowEval|BatchEvalPython|InPandas|InArrow", p)


def test_stencil_chain_is_one_shuffle(spark):
    px = spark.range(100).select((F.col("id") % 3).alias("image"), F.col("id").alias("r"), F.col("id").alias("c"), F.lit(1).alias("v"))
    k = S.ellipse(5)
    df = S.morphology(px, "v", [("min", k), ("max", k), ("max", k), ("min", k)])
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    lines = I.table(spark, sf, "lineitem").where("l_suppkey < 5").select("l_orderkey")
    p = plan(lines)
    assert "PushedFilters: [IsNotNull(l_suppkey), LessThan(l_suppkey,5)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in p
    assert "l_extendedprice" not in plan(QUERIES["pixel_metrics"](spark, sf))
