"""Written lengths of sounding durations: native folds over a short candidate list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelattice.functions.pitch import dotted, half_up

# The length letters and their units at DIV 64.
LETTERS = {"g": 1, "h": 2, "i": 4, "j": 8, "k": 16, "l": 32, "m": 64, "n": 128}


def base_units(letter: str, div: Column) -> Column:
    return half_up(F.lit(float(LETTERS[letter])) * div / 64)


def candidates(div: Column) -> Column:
    """Letters with up to three dots, the longest first; of equal ones, shorter letters and more dots first."""
    each = []
    for place, letter in enumerate(LETTERS):
        for order, dots in enumerate((3, 2, 1, 0)):
            base = base_units(letter, div)
            each.append(F.struct((-dotted(base, F.lit(dots))).cast("long").alias("order"), F.lit(place * 4 + order).alias("place"), dotted(base, F.lit(dots)).cast("long").alias("units"), F.concat(F.lit(letter), F.lit("." * dots)).alias("name"), (base > 0).alias("usable")))
    return F.filter(F.array_sort(F.array(*each)), lambda c: c["usable"] & (c["units"] > 0))


def chain(units: Column, div: Column) -> Column:
    """Lengths that add up to the units, greedily from the longest; what can't be written is left out."""

    def step(acc: Column, c: Column) -> Column:
        times = F.floor(acc["rest"] / c["units"]).cast("int")
        return F.struct((acc["rest"] - times * c["units"]).alias("rest"), F.concat(acc["out"], F.array_repeat(c["name"], times)).alias("out"))

    start = F.struct(units.cast("long").alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(candidates(div), start, step, lambda acc: acc["out"])


def exact_letter(units: Column, div: Column) -> Column:
    """The first letter whose units these are, null if none."""
    return F.coalesce(*[F.when(base_units(x, div) == units, F.lit(x)) for x in LETTERS])


def detected(units: Column, div: Column) -> Column:
    """struct(letter, dots): a plain length if it fits, else the first dotted one; null letter if neither."""
    dotted_ones = [F.when((base_units(x, div) > 0) & (dotted(base_units(x, div), F.lit(d)) == units), F.struct(F.lit(x).alias("letter"), F.lit(d).alias("dots"))) for x in LETTERS for d in (1, 2, 3)]
    plain = exact_letter(units, div)
    return F.coalesce(F.when(plain.isNotNull(), F.struct(plain.alias("letter"), F.lit(0).alias("dots"))), *dotted_ones, F.struct(F.lit(None).cast("string").alias("letter"), F.lit(0).alias("dots")))


def written(units: Column, div: Column) -> Column:
    """The lengths to write for a duration: one if it fits, else a chain."""
    one = detected(units, div)
    return F.when(one["letter"].isNotNull(), F.array(F.concat(one["letter"], F.repeat(F.lit("."), one["dots"])))).otherwise(chain(units, div))


def rest_text(units: Column, div: Column) -> Column:
    """Rests for a duration, joined by spaces."""
    return F.array_join(F.transform(written(units, div), lambda x: F.concat(F.lit("R"), x)), " ")


def segment_letters(units: Column, div: Column) -> Column:
    """Letters m to h for a chord's length: greedy without dots, `k` if nothing fits."""

    def step(acc: Column, c: Column) -> Column:
        times = F.floor(acc["rest"] / c["units"]).cast("int")
        return F.struct((acc["rest"] - times * c["units"]).alias("rest"), F.concat(acc["out"], F.array_repeat(c["name"], times)).alias("out"))

    each = F.array(*[F.struct(half_up(F.lit(float(LETTERS[x])) * div / 64).cast("long").alias("units"), F.lit(x).alias("name")) for x in "mlkjih"])
    usable = F.filter(each, lambda c: c["units"] >= 1)
    found = F.aggregate(usable, F.struct(units.cast("long").alias("rest"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) == 0, F.array(F.lit("k"))).otherwise(found)


def decompose(rows: DataFrame) -> DataFrame:
    """units, div and how they are written: chain, single (letter and dots) and rests."""
    units, div = F.col("units"), F.col("div")
    one = detected(units, div)
    return rows.select("units", "div", F.array_join(chain(units, div), " ").alias("chain"), F.concat(one["letter"], F.repeat(F.lit("."), one["dots"])).alias("single"), rest_text(units, div).alias("rests"))
