"""Quantities in different units: contents in grams or millilitres, prices per kilogram or litre.

What a text states is read by :mod:`marketgrain.functions.measure`. A stored number without such a text has no unit;
its unit is predicted by a random forest from magnitude, source, category and the neighbouring fields, trained on rows
whose text states the content: half of them with the text as one more field, half with the text hidden. The forest's
top probability is calibrated on held-out rows by pooled adjacent violators, apart for rows with and without text;
assignments of enough confidence are converted, the others are routed to review. Where a text is there, the numbers for
which the forest is not sure of the common unit are compared with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.measure import stated
from marketgrain.functions.text import plain
from marketgrain.session import cut, shuffle_width

# What one unit of a stored content is in grams or millilitres.
CONTENT_UNITS = {"g": 1.0, "kg": 1000.0, "oz": 28.349523125, "dag": 10.0, "mg": 0.001, "lb": 453.59237}
# What a stored unit price of 1 is in leva per kilogram or litre, for prices that do not depend on the
# package ("package" is the price of the whole package and is handled apart).
PRICE_UNITS = {"per_kg": 1.0, "per_100g": 10.0, "per_lb": 1 / 0.45359237, "eur_per_kg": 1.95583, "stotinki_per_kg": 0.01, "per_g": 1000.0}
OTHER = "other"
#: Feature values for what is missing and for a text that is not there: far off all others.
ABSENT, HIDDEN = -9.0, -9999.0
#: Share of the forest's votes from which a number with a text is taken for one of the common unit without comparing it.
SURE = 0.99
#: Rows differ when they are further apart than this part of the true value.
TOLERANCE = 0.03


def stated_content(df: DataFrame) -> DataFrame:
    """``df`` with ``_content``: struct of what ``weight_raw`` states, or ``name`` where ``weight_raw`` is null."""
    return df.withColumn("_content", stated(F.coalesce(F.col("weight_raw"), F.col("name"))))


def _near(value: Column, unit: Column, true: Column, whole: bool) -> Column:
    """Is ``value`` in ``unit`` the true quantity, by tolerance or, for whole numbers, by rounding?"""
    close = F.abs(value * unit - true) <= TOLERANCE * true
    return close | ((value >= 1) & (F.abs(true / unit - value) <= 0.5)) if whole else close


def _label(value: Column, true: Column, units: dict[str, float], whole: bool, more: list[tuple[str, Column]] = ()) -> Column:
    label = F.lit(OTHER)
    for name, test in reversed(list(more)):
        label = F.when(test, F.lit(name)).otherwise(label)
    for name, unit in reversed(list(units.items())):
        label = F.when(_near(value, F.lit(unit), true, whole and name != "g"), F.lit(name)).otherwise(label)
    return F.when(value.isNotNull() & true.isNotNull(), label)


@dataclass
class UnitModel:
    """A fitted forest with its classes and the calibration steps (upper bound of raw probability, confidence), apart for
    rows with (``told``) and without a stated content."""

    forest: RandomForestClassificationModel
    features: list[str]
    classes: list[str]
    steps: dict[bool, list[tuple[float, float]]]

    def score(self, df: DataFrame, prefix: str, told: Column) -> DataFrame:
        """``df`` with ``{prefix}_unit`` and ``{prefix}_confidence``."""
        rows = VectorAssembler(inputCols=self.features, outputCol="_v", handleInvalid="keep").transform(df)
        rows = self.forest.transform(rows).withColumn("_top", F.array_max(vector_to_array("probability")))
        unit = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int") + 1)

        def confidence(steps: list[tuple[float, float]]) -> Column:
            sure = F.lit(steps[-1][1])
            for bound, value in reversed(steps[:-1]):
                sure = F.when(F.col("_top") <= bound, F.lit(value)).otherwise(sure)
            return sure

        drop = ["_v", "rawPrediction", "probability", "prediction"]
        sure = F.when(told, confidence(self.steps[True])).otherwise(confidence(self.steps[False]))
        return rows.withColumn(f"{prefix}_unit", unit).withColumn(f"{prefix}_confidence", sure).withColumnRenamed("_top", f"_{prefix}_top").drop(*drop)


def calibration_steps(bins: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Pooled adjacent violators over (upper bound, rows, right ones): confidence rises with the raw probability."""
    pools: list[list[float]] = []
    for bound, n, right in bins:
        pools.append([bound, n, right])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            bound_, n_, right_ = pools.pop()
            pools[-1] = [bound_, pools[-1][1] + n_, pools[-1][2] + right_]
    return [(b, right / n) for b, n, right in pools] or [(1.0, 0.0)]


def fit_units(rows: DataFrame, label: str, features: list[str], texts: list[str], classes: list[str], key: str = "ord", bound: int = 20000, trees: int = 16, depth: int = 9) -> UnitModel | None:
    """Fit the forest on at most ``bound`` labelled rows (the ones of lowest hash of ``key``), a quarter of them held
    out for calibration; in half of them the features ``texts``, which come from the text, are hidden. Returns None where
    no row has a label: then nothing can be learned and all goes to review.
    """
    number = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        number = F.when(F.col(label) == c, F.lit(float(i))).otherwise(number)
    sample = rows.where(F.col(label).isNotNull()).select(F.xxhash64(F.lit(17), key).alias("_h"), number.alias("_y"), *features).orderBy("_h").limit(bound)
    told = F.pmod(F.col("_h"), F.lit(8)) >= 4
    sample = sample.withColumns({"_told": told} | {c: F.when(told, F.col(c)).otherwise(F.lit(HIDDEN)) for c in texts})
    sample = cut(sample.repartition(shuffle_width(rows.sparkSession), "_h"))
    held = F.pmod(F.col("_h"), F.lit(4)) == 0
    train = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep").transform(sample.where(~held))
    if train.isEmpty():
        return None
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8).fit(train)
    model = UnitModel(forest, features, classes, {})
    judged = model.forest.transform(VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep").transform(sample.where(held))).select(
        "_told", F.least(F.floor(F.array_max(vector_to_array("probability")) * 20), F.lit(19)).cast("int").alias("bin"), (F.col("prediction") == F.col("_y")).cast("int").alias("right")
    )
    bins = sorted((r["_told"], r["bin"], r["n"], r["right"]) for r in judged.groupBy("_told", "bin").agg(F.count("*").alias("n"), F.sum("right").alias("right")).collect())  # 40 bins at most
    model.steps = {t: calibration_steps([((b + 1) / 20, n, right) for of, b, n, right in bins if of == t]) for t in (True, False)}
    return model


def _log(c: Column) -> Column:
    """Decimal logarithm of a positive number; what is missing or not positive is far off."""
    return F.coalesce(F.when(c > 0, F.log10(c)), F.lit(ABSENT))


def _steps(ratio: Column) -> Column:
    """How many times the tolerance a ratio is off, by sign; 0 within it."""
    steps = F.log(F.when(ratio > 0, ratio)) / math.log(1 + TOLERANCE)
    return F.coalesce(F.signum(steps) * F.floor(F.abs(steps)), F.lit(HIDDEN))


def _code(c: Column) -> Column:
    return F.pmod(F.xxhash64(plain(c)), F.lit(61)).cast("double")


def with_common_units(offers: DataFrame, confident: float = 0.9, bound: int = 20000, carry: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Contents and unit prices of all rows in common units.

    The result has the columns ``carry``, ``new_price``, ``weight_grams`` and ``price_per_kg``, and in addition: ``content`` (g or ml of the whole package), ``content_from`` (``stated`` by a text, ``stored``: the
    stored number with the predicted unit, null), ``weight_unit``/``weight_confidence`` and ``price_unit``/
    ``price_confidence`` (the model's unit of the stored number), ``unit_price`` (leva per kg or litre) and
    ``unit_price_from`` (``content``, ``stored``: the stored unit price with the predicted unit, null), ``route`` (``done``: there is a
    content; ``review``: a number whose unit is not sure enough; ``nothing``: neither number nor text), ``weight_differs`` and
    ``price_differs`` (the model does not surely call the stored number one of grams, or leva per kg, and it is more than 3 % off
    what the text states; false where either is missing). ``bound`` is the most labelled rows used for fitting. Zero,
    negative and missing numbers have no unit; an empty table gives an empty result. Columns beginning with an
    underscore are the operator's own.
    """
    rows = stated_content(offers)
    true, stored, ppk = F.col("_content.total"), F.col("weight_grams"), F.col("price_per_kg")
    due = F.col("new_price") / true * 1000
    whole = F.abs(ppk - F.col("new_price")) <= 0.005 * F.col("new_price") + 0.005
    features = {
        "_f_weight": _log(stored), "_f_price": _log(F.col("new_price")), "_f_ppk": _log(ppk), "_f_density": _log(F.col("new_price") / F.nullif(stored, F.lit(0))),
        "_f_implied": _log(F.col("new_price") / F.nullif(ppk * stored, F.lit(0.0))), "_f_ratio": _log(ppk / F.nullif(F.col("new_price"), F.lit(0.0))),
        "_f_last": F.coalesce(F.pmod(stored, F.lit(10)).cast("double"), F.lit(-1.0)), "_f_category": _code(F.coalesce(F.col("category"), F.lit(""))), "_f_emoji": _code(F.col("emoji")),
        "_f_source": _code(F.concat_ws("/", "source", "source_type")), "_f_store": _code(F.col("store")),
        "_f_told": _steps(stored / true), "_f_told_price": _steps(ppk / due),
    }
    rows = rows.withColumns(features | {
        "_weight_label": F.when(stored > 0, _label(stored.cast("double"), true, CONTENT_UNITS, True, [("piece", F.abs(stored - F.col("_content.each")) <= TOLERANCE * F.col("_content.each"))])),
        "_price_label": F.when(ppk > 0, _label(ppk, due, PRICE_UNITS, False, [("package", whole)])),
    })
    # texts are read once: both fits and the scoring go on from the written rows, which are kept narrow
    stay = dict.fromkeys([*carry, "ord", "new_price", "weight_grams", "price_per_kg"])
    rows = cut(rows.select(*stay, F.struct("_content.each", "_content.total").alias("_content"), "_weight_label", "_price_label", *features))
    names = list(features)
    texts = ["_f_told", "_f_told_price"]
    told = F.col("_content.total").isNotNull()
    for prefix, label, classes in (("weight", "_weight_label", [*CONTENT_UNITS, "piece", OTHER]), ("price", "_price_label", [*PRICE_UNITS, "package", OTHER])):
        model = fit_units(rows, label, names, texts, classes, bound=bound)
        rows = model.score(rows, prefix, told) if model else rows.withColumn(f"{prefix}_unit", F.lit(None).cast("string")).withColumn(f"{prefix}_confidence", F.lit(0.0)).withColumn(f"_{prefix}_top", F.lit(0.0))

    def in_common(value: Column, prefix: str, units: dict[str, float]) -> Column:
        factor = F.lit(None).cast("double")
        for name, one in units.items():
            factor = F.when(F.col(f"{prefix}_unit") == name, F.lit(one)).otherwise(factor)
        return F.when((F.col(f"{prefix}_confidence") >= confident) & (value > 0), value * factor)

    def doubtful(prefix: str, common: str) -> Column:
        return ~F.coalesce((F.col(f"{prefix}_unit") == common) & (F.col(f"_{prefix}_top") >= SURE), F.lit(False))

    stored_price = in_common(ppk, "price", PRICE_UNITS)
    content = F.coalesce(true, in_common(stored, "weight", CONTENT_UNITS))
    by_content = F.col("new_price") / content * 1000
    return rows.withColumns(
        {
            "content": content,
            "content_from": F.when(true.isNotNull(), "stated").when(content.isNotNull(), "stored"),
            "unit_price": F.coalesce(by_content, stored_price),
            "unit_price_from": F.when(by_content.isNotNull(), "content").when(stored_price.isNotNull(), "stored"),
            "route": F.when(content.isNotNull(), "done").when(stored.isNotNull() | ppk.isNotNull(), "review").otherwise("nothing"),
            "weight_differs": F.coalesce(doubtful("weight", "g") & (F.abs(stored - true) > TOLERANCE * true), F.lit(False)),
            "price_differs": F.coalesce(doubtful("price", "per_kg") & (F.abs(ppk - due) > TOLERANCE * due), F.lit(False)),
            "weight_unit": F.when(stored > 0, F.col("weight_unit")),
            "price_unit": F.when(ppk > 0, F.col("price_unit")),
        }
    ).drop("_content", "_weight_label", "_price_label", "_weight_top", "_price_top", *names)


def stored_otherwise(units: DataFrame) -> DataFrame:
    """Rows (ord, field, unit, confidence) of the stored values of :func:`with_common_units` that differ from the text."""
    weight = F.when(F.col("weight_differs"), F.struct(F.lit("weight_grams").alias("field"), F.col("weight_unit").alias("unit"), F.col("weight_confidence").alias("confidence")))
    price = F.when(F.col("price_differs"), F.struct(F.lit("price_per_kg").alias("field"), F.col("price_unit").alias("unit"), F.col("price_confidence").alias("confidence")))
    return units.select("ord", F.explode(F.array_compact(F.array(weight, price))).alias("x")).select("ord", "x.field", "x.unit", "x.confidence")
