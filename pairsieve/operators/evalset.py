"""Evaluation items from rows of texts. Null texts give null choices or prompts, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.operators.align import cycle_repeat
from pairsieve.operators.compose import letter_choices


def choice_items(rows: DataFrame, keep: list[str], right: Column, others: list[Column], subject: Column) -> DataFrame:
    """keep, choices (the right one first, in a fixed order), answer and subject."""
    return rows.select(*keep, F.array(right, *others).alias("choices"), right.alias("answer"), subject.alias("subject"))


def ordered_prompt(template: str, a: Column, b: Column, coin: Column) -> Column:
    """A template with two places, filled in an order by the coin (0: a first); null where a text is null."""
    filled = F.when(coin == 0, F.format_string(template, a, b)).otherwise(F.format_string(template, b, a))
    return F.when(a.isNotNull() & b.isNotNull(), filled)


def cycled_template(templates: tuple[str, ...], i: Column, value: Column, place: str = "{x}") -> Column:
    """Template i mod their number, with the value at its place."""
    t = F.get(F.array(*[F.lit(x) for x in templates]), F.pmod(i, F.lit(len(templates))).cast("int"))
    return F.replace(t, F.lit(place), value)


def prefixed(prompt: Column, prefixes: tuple[str, ...], pick: Column, marker: str) -> Column:
    """The prompt after the prefix picked, or as it is where it holds a marker word."""
    p = F.get(F.array(*[F.lit(x) for x in prefixes]), pick.cast("int"))
    return F.when(F.lower(prompt).rlike(marker), prompt).otherwise(F.concat(p, prompt))


def truth_items(rows: DataFrame, truth: str, claim: str, coin: Column) -> DataFrame:
    """choices and answer letter; rows whose texts are equal but for case and blanks, or missing, are skipped."""
    differ = F.lower(F.trim(truth)) != F.lower(F.trim(claim))
    return letter_choices(rows.where(differ), truth, claim, coin)


def with_fallback(rows: DataFrame, i: Column, items: DataFrame, ordinal: str, column: str, fallback: str) -> DataFrame:
    """Every row with item i mod n in `column`; with the fallback where there are no items at all."""
    if items.limit(1).count():
        return cycle_repeat(rows, i, items, ordinal)
    return rows.withColumn(column, F.lit(fallback))
