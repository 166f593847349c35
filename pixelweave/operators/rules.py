"""Rule chains: which preset suits an image, how its tones are nudged, what a control change recomputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.numbers import half_up
from pixelweave.operators.palettes import PRESETS, presets

# fixed values: name fragments of scenes and animals
SCENE = "alp, volcano, valley, cliff, promontory, lakeside, lakeshore, seashore, sandbar, geyser, coral reef, mountain, snow, megalith, dam, breakwater, rapeseed, hay, barn, boathouse, castle, cliff dwelling".split(", ")
ANIMAL = (
    "dog, hound, terrier, retriever, spaniel, poodle, cat, tabby, lion, tiger, leopard, cheetah, jaguar, lynx, cougar, puma, wolf, fox, coyote, hyena, bear, panda, elephant, zebra, giraffe, antelope, gazelle, impala, hartebeest, "
    "bison, ox, ram, bighorn, ibex, hog, boar, warthog, hippopotamus, rhinoceros, monkey, ape, gorilla, chimpanzee, baboon, lemur, kangaroo, wallaby, koala, sloth, otter, beaver, badger, weasel, mongoose, meerkat, hare, rabbit, "
    "squirrel, marmot, deer, elk, moose, camel, llama, horse, eagle, hawk, owl, vulture, flamingo, pelican, stork, crane, heron, peacock, ostrich, penguin, goose, swan, parrot, toucan, snake, lizard, iguana, crocodile, alligator, "
    "turtle, frog, shark, whale, dolphin, seal, sea lion, gibbon, orangutan"
).split(", ")
# fixed values: controls by what they recompute (action, gray anew: yes, no or if stale, thresholds anew)
PLAN = {
    ("pipeline", "yes", False): "brightness contrast invert maxResolution smooth autoLevels mirror vflip",
    ("pipeline", "yes", True): "layers",
    ("pipeline", "stale", False): "minFeature bridgeMode keepHighlights edges edgeAmount",
    ("material", "stale", False): "material",
    ("bridgeWidth", "stale", False): "bridgeWidth",
    ("preset", "no", None): "preset",
    ("removeBg", "no", None): "removeBg",
    ("dims", "no", None): "targetWidth unit",
}
# end of fixed values


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def pick_preset() -> Column:
    """By skin, tones and deviation, sky, foliage (columns skin, tone_count, std, sky, green)."""
    return (
        F.when(_or("skin", 0) >= 0.10, "portrait")
        .when((_or("tone_count", 0) <= 6) & (_or("std", 0) > 55), "logo")
        .when((_or("sky", 0) >= 0.40) | (_or("green", 0) >= 0.32), "landscape")
        .otherwise("subject")
    )


def preset_from_signals() -> Column:
    """By detections first (face_area, face_conf, scene, animal, aspect, has_object)."""
    face = (_or("face_area", 0) >= 0.04) & ((_or("face_conf", 0) >= 0.9) | ((_or("face_conf", 0) >= 0.55) & (_or("skin", 0) >= 0.06)))
    return (
        F.when(face, "portrait")
        .when(F.coalesce("scene", F.lit(False)), "landscape")
        .when(F.coalesce("animal", F.lit(False)) & (_or("aspect", 1) >= 1.4), "landscape")
        .when((_or("tone_count", 99) <= 6) & (_or("std", 0) > 55), "logo")
        .when(F.coalesce("has_object", F.lit(False)), "subject")
        .otherwise(pick_preset())
    )


def scene_flag(names: Column) -> Column:
    """Whether any of the class names holds a scene's fragment."""
    return F.exists(names, lambda n: F.lower(n).rlike("|".join(SCENE)))


def animal_flag(names: Column) -> Column:
    """Whether the first class name holds an animal's fragment."""
    return F.coalesce(F.lower(F.get(names, F.lit(0))).rlike("|".join(ANIMAL)), F.lit(False))


def adaptive_tune(rows: DataFrame) -> DataFrame:
    """Brightness, contrast and smooth, nudged by mean, std and edge_density and clamped."""
    mean, std, edge = _or("mean", 128), _or("std", 60), _or("edge_density", 0)
    lift = F.when(mean < 80, half_up(F.least(F.lit(30.0), (80 - mean) * 0.5))).when(mean > 185, -half_up(F.least(F.lit(25.0), (mean - 185) * 0.5))).otherwise(0)
    more = F.when(std < 40, half_up(F.least(F.lit(30.0), (40 - std) * 1.2))).otherwise(0)
    clamp = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c)).cast("int")
    return rows.withColumns({"brightness": clamp(_or("brightness", 0) + lift, -100, 100), "contrast": clamp(_or("contrast", 0) + more, -100, 100), "smooth": clamp(_or("smooth", 1) + F.when(edge > 0.16, 1).otherwise(0), 0, 3)})


# fixed values: controls that shape the look, with their defaults
DEFAULTS = {
    "brightness": 0, "contrast": 0, "smooth": 1, "detail": 2, "invert": False, "autoLevels": False, "mirror": False, "vflip": False,
    "layers": 2, "minFeature": 6, "keepHighlights": False, "edges": False, "edgeAmount": 35, "removeBg": False,
}
# fixed values: the other controls and their defaults
OUTPUT = {"material": "mylar", "bridgeMode": "auto", "bridgeWidth": 2.0, "targetWidth": 30.0, "unit": "cm", "pageSize": "a4", "maxResolution": 1200, "margin": 10.0}
# fixed values: smallest path and tolerance of tracing by detail 0..3
PATH_OMIT = (16, 9, 4, 1)
TOLERANCE = (1.4, 1.0, 0.7, 0.4)
# end of fixed values
#: Columns of presets by control.
PRESET_COLUMNS = {"contrast": "contrast", "smooth": "smooth", "detail": "detail", "layers": "layers", "minFeature": "min_feature", "autoLevels": "auto_levels", "edges": "edges", "edgeAmount": "edge_amount"}


def merge_params(rows: DataFrame) -> DataFrame:
    """Rows with every control: their own value, else the default."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in (DEFAULTS | OUTPUT).items()})


def apply_preset(rows: DataFrame, spark: SparkSession, tune: bool = True) -> DataFrame:
    """Rows (preset, and with ``tune`` mean, std and edge_density) with the look's controls: defaults, then the preset's, then the nudge.

    Unknown presets are ``photo``. ``suggest_cutout``: whether the look gains from a cut-out background.
    """
    known = presets(spark)
    table = known.select(F.col("preset").alias("_known"), *[F.col(c).alias(f"_{k}") for k, c in PRESET_COLUMNS.items()])
    ids = [r[0] for r in PRESETS]
    out = rows.withColumn("preset", F.when(F.col("preset").isin(ids), F.col("preset")).otherwise("photo")).join(F.broadcast(table), F.col("preset") == F.col("_known"))
    out = out.withColumns({k: F.coalesce(F.col(f"_{k}"), F.lit(v)) if k in PRESET_COLUMNS else F.lit(v) for k, v in DEFAULTS.items()}).drop("_known", *[f"_{k}" for k in PRESET_COLUMNS])
    out = adaptive_tune(out) if tune else out
    return out.withColumn("suggest_cutout", F.col("preset").isin("portrait", "subject"))


def reason(preset: Column, label: Column, top: Column, animal: Column, scene: Column, scene_name: Column) -> Column:
    """One line on why a preset was taken; ``top``: the first class name."""
    first = F.coalesce(F.split(top, ",")[0], F.lit(""))
    place = F.when(F.coalesce(scene, F.lit(False)), F.when(F.coalesce(scene_name, F.lit("")) != "", scene_name).otherwise("scene")).when(F.coalesce(animal, F.lit(False)), F.concat(first, F.lit(" in scene"))).otherwise("scene")
    why = F.when(preset == "portrait", "face detected").when(preset == "landscape", place).when((preset == "subject") & (first != ""), first).otherwise("")
    return F.concat(F.coalesce(label, preset), F.when(why != "", F.concat(F.lit(" — "), why)).otherwise(""))


def trace_options(detail: Column) -> tuple[Column, Column]:
    """Smallest path and tolerance for a level of detail; others get 4 and 0.8."""
    pick = lambda values, other: F.coalesce(F.when(detail.between(0, 3), F.get(F.array(*map(F.lit, values)), detail.cast("int"))), F.lit(other))
    return pick(PATH_OMIT, 4), pick(TOLERANCE, 0.8)


def recompute_table(spark: SparkSession) -> DataFrame:
    """control, stale, action, regray, recompute_thresholds: the decision table."""
    rows = [(c, stale, action, None if again is None else gray == "yes" or (gray == "stale" and stale), again) for (action, gray, again), controls in PLAN.items() for c in controls.split() for stale in (False, True)]
    rows += [("detail", False, "retrace", None, None), ("detail", True, "pipeline", True, False)]
    return spark.createDataFrame(rows, "control string, stale boolean, action string, regray boolean, recompute_thresholds boolean")


def recompute_plan(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """``requests(control, stale)`` with what to do; unknown controls do nothing, a null ``stale`` is not stale."""
    table = recompute_table(spark).withColumnsRenamed({"control": "_control", "stale": "_stale"})
    met = (F.col("control") == F.col("_control")) & (F.coalesce("stale", F.lit(False)) == F.col("_stale"))
    return requests.join(F.broadcast(table), met, "left").drop("_control", "_stale").fillna({"action": "none"})
