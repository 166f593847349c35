"""Paints, presets, materials and pages as small static tables, and lookups on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.numbers import hex_channel
from pixelweave.operators.grids import is_packed

# fixed values: paints by palette
PAINTS = {
    ("basics", "Basics"): "White #ffffff, Off-White #f4f1ea, Cream #f3e9c6, Beige #d9c39a, Light Grey #c8ccd0, Grey #8a9099, Dark Grey #4a4f57, Black #1a1a1a, Yellow #ffd400, Golden Yellow #f7b500, Orange #f3641f, Red Orange #ef4023, Red #e2231a, Crimson #c2185b, Pink #ec4f9c, Magenta #d6219b, Purple #7b2fb5, Violet #5b2a86, Navy #14306b, Blue #0a4fa0, Sky Blue #2b9bd8, Light Blue #6cc4e8, Teal #109e9e, Turquoise #1fc3b0, Mint #7fd1a3, Light Green #6fbf3b, Green #2e9b3f, Dark Green #1c6b2f, Olive #7a8a32, Brown #6e4326, Tan #b88a4f, Skin #f0c8a0",
    ("montana-gold", "Montana Gold"): "Shock White #ffffff, Shock Black #16181a, Marble Grey #9aa0a6, Pebbles #c4c1b8, Shock Yellow #ffd200, Gleam Yellow #fff04d, Cocky Orange #f7941d, Shock Orange #f15a22, Brilliant Red #d51e26, Shock Red Light #ee3124, Bazooka #f04e98, Shock Pink #e6177f, Shock Pink Light #f48fb6, Shock Violet #6a2c91, Shock Blue #0a52a8, Shock Blue Light #2f8fd6, Glacier Blue #bcdff1, Lagoon Blue #1b9aa6, Shock Green #3aaa35, Shock Green Light #8cc63f, Mint Pastel #a3d9b1, Sahara Beige #d8b878, Beach #f2e2b3, Shock Brown #6b4226",
    ("molotow", "Molotow"): "Signal White #f7f7f2, Signal Black #1b1b1b, Metal Grey #7d8285, Grey Blue #6e8aa6, Traffic Red #cc1f1a, Currant #b3123b, Burgundy #7a1f2b, Lobster #e8593a, Dare Orange #f26522, Apricot #f6a35c, Piglet Pink #f3a6c0, Ceramic Pink #f4c9d3, Violet #6b2fa0, Universes Blue #1d3f8f, Lago Blue #2aa6c9, Petrol #14595e, Mister Green #2f9e44, Poison Green #7ac143, Lime #c4d600, Sahara Pastel #e3cfa3",
    ("mtn94", "MTN 94"): "White #f4f4ef, Black #17191b, Squartz Grey #9a9ea3, Phantom Grey #5b6066, Light Yellow #ffe14d, Party Yellow #ffd21f, Mostaza Yellow #e8a51c, Valencia Orange #f26f21, Calcutta Orange #ee5a24, Vivid Red #d81f33, Bull Red #9e1b32, Erica Magenta #c2247e, Fucsia Pink #e84d9a, Witch Violet #6c3a93, Andromeda Blue #1f2f7a, Avatar Blue #1565b0, Light Blue #3aa0dc, Bahia Blue #16a0a6, Guacamole Green #3aa53a, Pamplona Green #1c7a3e, UFO Green #7bc043, Mango #f6a623, Chocolate Brown #5a3825, Unicorn Skin #f2c9a0",
}
# fixed values: presets (label, contrast, smooth, detail, layers, min_feature, auto_levels, edges, edge_amount)
PRESETS = [
    ("photo", "Photo", 10, 3, 2, 6, 9, True, False, None),
    ("portrait", "Portrait", 12, 3, 2, 4, 12, True, False, None),
    ("subject", "Subject (isolate)", 14, 3, 2, 6, 8, False, False, None),
    ("landscape", "Landscape", 16, 2, 2, 6, 8, True, False, None),
    ("poster", "Bold poster", 35, 3, 1, 2, 14, False, False, None),
    ("lineart", "Line art", 12, 1, 2, 1, 6, False, True, 55),
    ("logo", "Logo (B&W)", 45, 3, 1, 1, 16, False, False, None),
]
# fixed values: materials (tie width, least feature, tie spacing, in millimetres)
MATERIALS = [("mylar", 2.0, 0.6, 65.0), ("vinyl", 2.0, 1.0, 65.0), ("card", 3.0, 1.5, 45.0), ("laser", 1.2, 0.3, 80.0)]
# fixed values: pages in millimetres
PAGES = {
    "a6": (105, 148), "a5": (148, 210), "a4": (210, 297), "a3": (297, 420), "a2": (420, 594), "a1": (594, 841), "a0": (841, 1189),
    "letter": (215.9, 279.4), "legal": (215.9, 355.6), "tabloid": (279.4, 431.8),
    "arch_a": (228.6, 304.8), "arch_b": (304.8, 457.2), "arch_c": (457.2, 609.6), "arch_d": (609.6, 914.4), "arch_e": (914.4, 1219.2),
    "cricut_12x12": (292, 292), "cricut_12x24": (292, 597), "cameo_12x24": (301, 607), "glowforge_aura": (279, 495), "glowforge_pro": (495, 279), "xtool_p2": (600, 308),
}
# end of fixed values


def paint_rows() -> list[tuple]:
    """brand_ord, color_ord, brand_id, brand, name, hex of each paint."""
    return [(i, j, brand, label, *item.rsplit(" ", 1)) for i, ((brand, label), items) in enumerate(PAINTS.items()) for j, item in enumerate(items.split(", "))]


def paints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(paint_rows(), "brand_ord int, color_ord int, brand_id string, brand string, name string, hex string")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, label string, contrast int, smooth int, detail int, layers int, min_feature int, auto_levels boolean, edges boolean, edge_amount int")


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATERIALS, "material string, bridge double, min_feature_mm double, tie_spacing double")


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(w), float(h)) for k, (w, h) in PAGES.items()], "page string, page_w double, page_h double")


def material_of(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows with the figures of their ``material``, those of mylar for unknown ones."""
    known = F.broadcast(materials(spark))
    base = MATERIALS[0]
    out = rows.join(known, "material", "left")
    return out.fillna({"bridge": base[1], "min_feature_mm": base[2], "tie_spacing": base[3]})


def paint_name(rows: DataFrame, spark: SparkSession, color: str = "hex") -> DataFrame:
    """Rows with ``paint``: the first palette's name for exactly this colour (100 paints are broadcast)."""
    names = paints(spark).groupBy(F.lower("hex").alias("_hex")).agg(F.min_by("name", F.struct("brand_ord", "color_ord")).alias("paint"))
    return rows.join(F.broadcast(names), F.lower(F.col(color)) == F.col("_hex"), "left").drop("_hex")


def nearest_paint(rows: DataFrame) -> DataFrame:
    """Rows (r, g, b) with the nearest can ``brand``, ``name``, ``hex`` and ``distance``; a null channel gives none.

    The least of distance * 128 + place over the 68 branded paints is taken for Arrow batches: as one
    expression it is too long a method for the JVM to compile. One look-up then gives the names.
    """
    cans = [r for r in paint_rows() if r[2] != "basics"]
    paint = np.array([[int(r[5][i : i + 2], 16) for i in (1, 3, 5)] for r in cans])

    @F.pandas_udf("int")
    def nearest(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        known = r.notna() & g.notna() & b.notna()
        best = np.full(len(r), np.iinfo(np.int64).max)
        own = [c.where(known, 0).to_numpy().astype(np.int64) for c in (r, g, b)]
        for k, color in enumerate(paint.tolist()):
            best = np.minimum(best, sum((c - v) ** 2 for c, v in zip(own, color)) * 128 + k)
        return pd.Series(best, index=r.index).astype("Int64").where(known)

    out = rows.withColumn("_near", nearest("r", "g", "b"))
    at = (F.col("_near") % 128).cast("int")
    named = [F.get(F.array(*[F.lit(r[i]) for r in cans]), at).alias(n) for i, n in ((3, "brand"), (4, "name"), (5, "hex"))]
    return out.select(*rows.columns, *named, F.shiftright("_near", 7).alias("distance"))


def color_label(rows: DataFrame, color: str = "hex", name: str = "name") -> DataFrame:
    """Rows with ``label``: the name with its colour, or the colour with the closest can."""
    own = [c for c in rows.columns if c not in ("r", "g", "b", "_color", "_name")]
    base = rows.select(*own, F.col(color).alias("_color"), F.col(name).alias("_name"), *[hex_channel(F.col(color), i).alias(c) for i, c in enumerate("rgb")])
    near = nearest_paint(base.withColumnsRenamed({c: f"_own_{c}" for c in ("brand", "name", "hex", "distance") if c in own}))
    can = F.concat_ws(" ", "brand", near["name"])
    label = F.when(F.coalesce(F.col("_name"), F.lit("")) != "", F.concat(F.col("_name"), F.lit(" ("), F.col("_color"), F.lit(")"))).otherwise(F.concat(F.col("_color"), F.lit(" — closest can: "), can))
    out = near.withColumns({"label": label, "can": can}).drop("brand", "name", "hex", "distance", "r", "g", "b", "_color", "_name")
    return out.withColumnsRenamed({f"_own_{c}": c for c in ("brand", "name", "hex", "distance")})


def default_colors(layers: DataFrame, count: str = "layers") -> DataFrame:
    """A row for each layer (``layer`` from 0, ``hex``) of rows with a number of layers: light gray to nearly black."""
    n = F.greatest(F.col(count), F.lit(1))
    out = layers.withColumn("layer", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("hex", tone_hex(F.col("layer"), n))


def tone_hex(layer: Column, layers: Column) -> Column:
    """The gray of one of a number of layers."""
    light = F.floor(82 - 68 * layer / F.greatest(layers - 1, F.lit(1)) + 0.5)
    part = F.lower(F.lpad(F.hex(F.floor(light * 255 / 100 + 0.5).cast("int")), 2, "0"))
    return F.when(layers <= 1, "#1a1a1a").otherwise(F.concat(F.lit("#"), part, part, part))


def to_hex(color: Column) -> Column:
    """Six-digit hex colours in lower case; others (names, functions) are not resolved and give null."""
    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), F.lower(color))


def sample_color(points: DataFrame, pixels: DataFrame, width: int, height: int, mirror: bool = False, vflip: bool = False) -> DataFrame:
    """Points (image_id, px, py) of a shown raster with ``color``, that of the pixel below in the source, whose flips are undone. Of packed rasters a row meets its points, not a row for each pixel."""
    at = lambda c, n, flipped: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((n - 1 - F.col(c) if flipped else F.col(c)) + 0.5))).cast("int")
    two = lambda c: F.lower(F.lpad(F.hex(F.col(c).cast("int")), 2, "0"))
    spots = points.withColumns({"x": at("px", width, mirror), "y": at("py", height, vflip)})
    if is_packed(pixels, "r"):
        byte = lambda c: F.lower(F.hex(F.substring(c, F.col("y") * F.col("width") + F.col("x") + 1, 1)))
        inside = (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
        color = F.when(inside, F.concat(F.lit("#"), byte("r"), byte("g"), byte("b")))
        return spots.hint("merge").join(pixels.select("image_id", "width", "height", "r", "g", "b"), "image_id", "left").select(*points.columns, color.alias("color"))
    source = pixels.select("image_id", "y", "x", F.concat(F.lit("#"), two("r"), two("g"), two("b")).alias("color"))
    return spots.join(source, ["image_id", "y", "x"], "left").select(*points.columns, "color")


def channels(rows: DataFrame, color: str = "hex") -> DataFrame:
    return rows.withColumns({c: hex_channel(F.col(color), i) for i, c in enumerate("rgb")})
