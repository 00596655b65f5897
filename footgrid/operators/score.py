"""Model scoring of packed tiles: the one place where a user's Python code runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .spatial_join import tiles_in_settlements

Model = Callable[[np.ndarray], np.ndarray]
CELLS = 1 << 18                 # pixels of the tiles that are scored before their scores are handed on


def score_tiles(tiles: DataFrame, load_model: Callable[[], Model], tile: int,
                keys: tuple[str, ...] = ("image", "tile_r", "tile_c")) -> DataFrame:
    """Class scores of packed tiles ``(*keys, data)``.

    ``load_model`` runs once per Python worker batch stream and returns a function from
    a ``tile x tile`` array to a ``classes x tile x tile`` array. A tile the model fails
    on keeps its row with the message in ``error`` and no scores."""
    types = dict(tiles.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", scores array<array<double>>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        some = max(CELLS // tile ** 2, 1)
        for pdf in (batch.iloc[first:first + some] for batch in batches for first in range(0, len(batch), some)):
            scores, errors = [], []
            for data in pdf["data"]:
                try:
                    out = np.asarray(model(np.asarray(data, dtype=float).reshape(tile, tile)), dtype=float)
                    scores.append(list(out.reshape(out.shape[0], -1)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a bad tile must not fail the job
                    scores.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[list(keys)].assign(scores=pd.Series(scores, index=pdf.index, dtype=object),
                                         error=pd.Series(errors, index=pdf.index, dtype=object))

    return tiles.select(*keys, "data").mapInPandas(run, schema)


def score_in_settlements(tiles: DataFrame, load_model, tile: int, aois: DataFrame | None) -> DataFrame:
    """Score only the tiles a settlement touches; no settlements means all tiles."""
    if aois is not None:
        tiles = tiles_in_settlements(tiles, aois, tile)
    return score_tiles(tiles, load_model, tile)


def probabilities(scored: DataFrame, tile: int) -> DataFrame:
    """Scored tiles to pixels ``(image, r, c, building_prob, edge_prob)``; failed tiles drop out."""
    ok = scored.where(F.col("error").isNull())
    planes = F.arrays_zip(F.col("scores")[1].alias("b"), F.when(F.size("scores") > 2, F.col("scores")[2]).alias("e"))
    flat = ok.select("image", "tile_r", "tile_c", F.posexplode(
        F.when(F.size("scores") > 2, planes).otherwise(F.transform(F.col("scores")[1], lambda b: F.struct(
            b.alias("b"), F.lit(None).cast("double").alias("e"))))).alias("pos", "p"))
    return flat.select("image", (F.col("tile_r") * tile + F.floor(F.col("pos") / tile)).cast("int").alias("r"),
                       (F.col("tile_c") * tile + F.col("pos") % tile).cast("int").alias("c"),
                       F.col("p.b").alias("building_prob"), F.col("p.e").alias("edge_prob"))


def failures(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("error").isNotNull()).drop("scores")
