"""Parameter sweeps over images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def run_label(mask_mode: Column, remove: Column, pixel_delta: Column, dilate: Column, inpaint: Column, radius: Column) -> Column:
    """Name of a parameter set; parts at their neutral value are left out."""
    part = lambda name, v: F.concat(F.lit(name), v.cast("string"))
    cv2 = remove == "cv2"
    return F.concat_ws(
        "_", part("mask-", mask_mode), part("rm-", remove), F.when(mask_mode == "pixel", part("pd", pixel_delta)), F.when(dilate != 0, part("d", dilate)),
        F.when(cv2, part("ip-", inpaint)), F.when(cv2, part("r", radius)),
    )


def sweep(images: DataFrame, dilations: list[int], expansions: list[int], done: DataFrame | None, key: str) -> DataFrame:
    """Every image with every parameter pair, except the pairs already in ``done``.

    The two lists are job arguments; each image carries their product as an array and explodes
    it, which needs no join.
    """
    grid = F.array(*[F.struct(F.lit(d).alias("dilate"), F.lit(e).alias("expand")) for d in dilations for e in expansions])
    runs = images.select("*", F.explode(grid).alias("_p")).select(*images.columns, "_p.dilate", "_p.expand")
    return runs if done is None else runs.join(done, [key, "dilate", "expand"], "left_anti")
