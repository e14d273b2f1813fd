"""Row-wise reshaping of preference records. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_to_binary(df: DataFrame, keep: list[str], chosen: str, rejected: str) -> DataFrame:
    """One row of (chosen, rejected) -> two rows with a label; rows without text are dropped."""
    both = F.array(F.struct(F.col(chosen).alias("completion"), F.lit(True).alias("label")), F.struct(F.col(rejected).alias("completion"), F.lit(False).alias("label")))
    return df.select(*keep, F.explode(both).alias("p")).select(*keep, "p.completion", "p.label").where(F.trim("completion") != "")


def first_turn(messages: Column, role: str = "assistant", raw: Column | None = None) -> Column:
    """Content of the first message of a role, else the raw string, if one is given; else null."""
    own = F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]
    return own if raw is None else F.coalesce(own, raw)


def turn_at(messages: Column, position: int = 2) -> Column:
    """Content of the message at a position, whatever its role; null where there is none."""
    return F.try_element_at(messages, F.lit(position))["content"]


def chat_to_binary(df: DataFrame, keep: list[str], chosen: Column, rejected: Column) -> DataFrame:
    """Chat pairs -> rows with a label; each side is dropped on its own where it is null or blank."""
    return pair_to_binary(df.select(*keep, chosen.alias("chosen"), rejected.alias("rejected")), keep, "chosen", "rejected")


def substitute(text: Column, place: str, value: Column) -> Column:
    """Every occurrence of a placeholder replaced."""
    return F.replace(text, F.lit(place), value)


def naive_negation(text: Column) -> Column:
    """`is` -> `is not`, inside words too."""
    return F.replace(text, F.lit("is"), F.lit("is not"))


def word_negation(text: Column) -> Column:
    """`is` -> `is not`, whole words only."""
    return F.regexp_replace(text, "(?<![\\p{L}\\p{N}_])is(?![\\p{L}\\p{N}_])", "is not")


def suffix_after(text: Column, mark: str) -> Column:
    """Trimmed text after the last `mark`, else the whole text trimmed."""
    return F.trim(F.substring_index(text, mark, -1))


def preview(text: Column, size: int = 150) -> Column:
    """The text, or its first `size` characters and an ellipsis."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def fenced_code(text: Column) -> Column:
    """First fenced Python block; empty where there is none."""
    return F.regexp_extract(text, "(?s)```python\\n(.*?)\\n```", 1)


def letter(i: Column) -> Column:
    """A for 0, ..., Z for 25, AA for 26 and so on, up to ZZ."""
    one = lambda x: F.chr(F.lit(65) + x)
    return F.when(i < 26, one(i)).otherwise(F.concat(one(F.floor(i / 26) - 1), one(F.pmod(i, F.lit(26)))))


def render_choices(question: Column, choices: Column) -> Column:
    """Question, any number of lettered choices and an answer line."""
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("("), letter(i), F.lit(") "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))


def rewrite(text: Column, pattern: str, by: str) -> Column:
    """Regular-expression rewrite; groups of the pattern are $1, $2, ... in `by`."""
    return F.regexp_replace(text, pattern, by)


def run_name(*parts: Column) -> Column:
    """Parts joined by an underscore; null parts are left out."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def run_numbers(name: Column, pattern: str = "(?:^|_)n(\\d+)_p(\\d+)$") -> tuple[Column, Column]:
    """The two numbers of a run name, by default of one that ends in n<digits>_p<digits>; null for any other
    name, and for a number beyond bigint."""
    return tuple(F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).try_cast("bigint") for i in (1, 2))


def both_sides(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Pairs of which neither side is null or blank."""
    return df.where((F.trim(chosen) != "") & (F.trim(rejected) != ""))


def shorten(text: Column, width: int = 100, mark: str = " ...") -> Column:
    """The words of a text joined by single blanks, as many as fit into `width` with the mark."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    head = F.regexp_extract(F.concat(flat, F.lit(" ")), f"^(.{{0,{width - len(mark)}}})\\s", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.trim(head), F.lit(mark)))


def braces(text: Column) -> Column:
    """Braces doubled, so that the text may stand in a format string."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def to_templates(df: DataFrame, text: str, value: str, order: str, place: str = "{x}") -> DataFrame:
    """template, n, first: texts with braces doubled and the row's own value replaced by a placeholder, each
    once, with the least key of `order` it came from."""
    t = F.replace(braces(F.col(text)), braces(F.col(value)), F.lit(place))
    return df.where(F.col(text).isNotNull() & (F.col(value) != "")).groupBy(t.alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
