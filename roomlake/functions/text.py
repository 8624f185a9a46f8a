"""Text to terms, counts and stable seeds, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words that descriptions use.
ENGLISH_NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
CHINESE_NUMBERS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
#: Words between and around sizes, and the units that may follow a number.
BETWEEN, UNITS = ("x", "×", "*", "乘", "by"), ("m", "米")
LENGTH_WORDS, WIDTH_WORDS, HEIGHT_WORDS = ("长", "length"), ("宽", "width"), ("层高", "height")
#: Room types in the order of a program, with their weight, number where none is said, and nouns (patterns) in English and Chinese.
ROOM_NOUNS = {
    "living": (24.0, 1, r"living rooms?|lounges?", ("客厅|厅",)),
    "kitchen": (10.0, 1, r"kitchens?", ("厨房|厨",)),
    "bedroom": (14.0, 2, r"bedrooms?|beds?", ("卧室|房间", "室")),
    "bathroom": (6.0, 1, r"bathrooms?|baths?", ("卫生间|浴室|卫",)),
    "storage": (4.0, 0, r"storage rooms?|storerooms?", ("储物间|储藏室",)),
    "balcony": (6.0, 0, r"balcon(?:y|ies)", ("阳台",)),
}
MOST_ROOMS = 8
NUMBER = r"(\d+(?:\.\d+)?)"


def normalized(term: Column) -> Column:
    return F.translate(F.lower(F.trim(term)), "- ", "__")


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def parse_count(word: Column) -> Column:
    """Digits, a number word, or tens and ones around 十; anything else counts as one."""
    word = F.lower(F.trim(word))
    digit = {k: v for k, v in CHINESE_NUMBERS.items() if v < 10}
    tens, ones = F.regexp_extract(word, "^(.*?)十", 1), F.regexp_extract(word, "十(.*)$", 1)
    composed = F.when(word.contains("十"), F.coalesce(_lookup(digit, tens), F.lit(1)) * 10 + F.coalesce(_lookup(digit, ones), F.lit(0)))
    return F.coalesce(word.try_cast("int"), _lookup(ENGLISH_NUMBERS | CHINESE_NUMBERS, word), composed, F.lit(1))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def room_count(text: Column, kind: str) -> Column:
    """How many rooms of a type a description asks for: said in English, else in Chinese, else the usual number."""
    _, usual, english, chinese = ROOM_NOUNS[kind]
    said = _first(F.lower(text), rf"(\d+|{'|'.join(ENGLISH_NUMBERS)})\s*(?:{english})\b")
    for nouns in chinese:
        said = F.coalesce(said, _first(text, rf"([{''.join(CHINESE_NUMBERS)}\d]+)\s*个?(?:{nouns})"))
    return F.when(said.isNull(), usual).otherwise(F.least(F.lit(MOST_ROOMS), parse_count(said)))


def room_program(text: Column) -> Column:
    """Rooms (id, type, weight) that a description asks for, by type; a living room where it asks for none."""

    def of(kind: str) -> Column:
        n, weight = room_count(text, kind), ROOM_NOUNS[kind][0]
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.struct(F.concat(F.lit(f"{kind}_"), k.cast("string")).alias("id"), F.lit(kind).alias("type"), F.lit(weight).alias("weight")))

    rooms = [of(kind) for kind in ROOM_NOUNS]
    living = F.array(F.struct(F.lit("living_0").alias("id"), F.lit("living").alias("type"), F.lit(ROOM_NOUNS["living"][0]).alias("weight")))
    return F.when(F.size(F.concat(*rooms)) > 0, F.concat(*rooms)).otherwise(living)


def count_of(text: Column, noun: str, default: int, most: int) -> Column:
    """The first number before ``noun`` (a pattern), at most ``most``."""
    found = F.regexp_extract(text, rf"(\d+)\s+{noun}", 1)
    return F.least(F.lit(most), F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(default)))


def _after(text: Column, words: tuple[str, ...]) -> Column:
    """The number after the first of ``words`` that one follows."""
    return _first(text, rf"(?i)(?:{'|'.join(words)})\s*{NUMBER}").try_cast("double")


def dimensions(text: Column) -> Column:
    """width and depth of two sizes with a separator between, else as named; null where absent."""
    units, between = "|".join(UNITS), "|".join(re.escape(x) for x in BETWEEN)
    pair = rf"(?i){NUMBER}\s*(?:{units})?\s*(?:{between})\s*{NUMBER}"
    both = _first(text, pair).isNotNull()
    width = F.when(both, _first(text, pair).try_cast("double")).otherwise(_after(text, LENGTH_WORDS))
    depth = F.when(both, _first(text, pair, 2).try_cast("double")).otherwise(_after(text, WIDTH_WORDS))
    return F.struct(width.alias("width"), depth.alias("depth"))


def height(text: Column) -> Column:
    """The ceiling height that a description names; null where absent."""
    return _after(text, HEIGHT_WORDS)


def within(value: Column, usual: float | None, low: float, high: float, what: str) -> Column:
    """``value`` to four digits, ``usual`` for null; an error outside of [low, high], not a clamp."""
    filled = value if usual is None else F.coalesce(value, F.lit(usual))
    bad = filled.isNull() | F.isnan(filled) | ~filled.between(low, high)
    return F.when(bad, F.raise_error(F.lit(f"{what} must be between {low:g} and {high:g} metres")).cast("double")).otherwise(F.round(filled, 4))


def side(value: Column, usual: float) -> Column:
    return within(value, usual, 3.0, 40.0, "width and depth")


def ceiling(value: Column) -> Column:
    return within(value, 2.8, 2.0, 6.0, "height")


def finite(value: Column) -> Column:
    """A number of any text, null unless it is finite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def short_title(text: Column, most: int = 72) -> Column:
    """Blanks collapsed, cut after ``most`` characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def stable_seed_hex(*parts: Column) -> Column:
    """The first 64 bits of the SHA-256 of the parts joined by colons, in hexadecimal."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 16)


def label_seed(label: Column) -> Column:
    """Code points weighted by their place."""
    chars = F.filter(F.split(label, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c, k: (k + 1) * F.ascii(c)), F.lit(0), lambda s, x: s + x)


def metric_text(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", value))


def round_or_null(value: Column, digits: int = 5) -> Column:
    """Half to even, as the reports round."""
    return F.bround(value, digits)


def gain(after: Column, before: Column) -> Column:
    """What a stage improved; null where either is unknown."""
    return after - before
