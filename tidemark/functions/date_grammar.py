"""Dates as people type them: a small grammar of fields, separators, month words and clocks.

A value is a day, and after it perhaps a clock. Each rule says which shape a day has and in which
order its fields stand; a clock is read the same way after every day. Where two numbers could both
be the month, the order is a choice: month first, but day first between dots, unless the rest of
the column says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Month words by their first three letters, in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = (
    r"(?i:(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))\.?"
)
_WEEKDAY = r"^(?i:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?i:day)?\.?,? +"
_NTH = r"(?i:st|nd|rd|th)?"
_CLOCK = r"[T, ]+(?:\d{1,2}:\d{2}(?::\d{2}(?:[.]\d{1,9})?)?(?: ?[AaPp]\.?[Mm]\.?)?|\d{1,2} ?[AaPp]\.?[Mm]\.?)$"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"


@dataclass(frozen=True)
class Rule:
    """One shape of a day, and its fields in the order of the pattern's groups.

    y, m and d are the year, the month and the day; a and b are a day and a month in an order that
    the numbers or the column decide, day first by default if ``day_first``.
    """

    pattern: str
    fields: str
    day_first: bool = False

    def put(self, day: Column) -> Column:
        """Year, month, day as words; two open numbers keep their order and get a mark."""
        places = {name: f"${self.fields.index(name) + 1}" for name in self.fields}
        if "a" in places:
            words = [places["y"], places["a"], places["b"], "day" if self.day_first else "month"]
        else:
            words = [places["y"], places["m"], places.get("d", "1"), "set"]
        return F.regexp_replace(day, self.pattern, " ".join(words))


RULES = [
    Rule(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "ymd"),
    Rule(r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", "aby"),
    Rule(r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$", "aby"),
    Rule(r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", "aby", day_first=True),
    Rule(rf"^(\d{{1,2}}){_NTH}[-/. ]*{_MONTH}[-/, ]*(\d{{4}}|\d{{2}})$", "dmy"),
    Rule(rf"^{_MONTH}[-/ ]*(\d{{1,2}}){_NTH}[-/, ]+(\d{{4}}|\d{{2}})$", "mdy"),
    Rule(rf"^(\d{{4}})[-/ ]*{_MONTH}[-/ ]*(\d{{1,2}})$", "ymd"),
    Rule(rf"^{_MONTH}[-/, ]*(\d{{4}})$", "my"),
    Rule(r"^(\d{4})[-/](\d{1,2})$", "ym"),
    Rule(r"^((?:19|20)\d{2})(\d{2})(\d{2})$", "ymd"),
]


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(day: Column) -> Column:
    """Year, month, day and a mark as four words; null outside the grammar."""
    ladder = F
    for rule in RULES:
        ladder = ladder.when(day.rlike(rule.pattern), rule.put(day))
    return F.split(ladder, " ")


def _year(digits: Column) -> Column:
    """Two digits mean 1969 to 2068."""
    year = digits.cast("int")
    return F.when(F.length(digits) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)


def _month(word: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(word, F.lit(3)))).cast("int")
    return F.coalesce(word.try_cast("int"), place)


def _clock_fields(clock: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and second; no clock is midnight, and a 12-hour clock must have a 12-hour hour."""
    def part(pattern: str) -> Column:
        return F.regexp_extract(clock, pattern, 1)

    hour = part(r"(\d{1,2})").cast("int")
    half = F.lower(part(r"([AaPp])\.?[Mm]"))
    twelve = F.when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute = F.coalesce(part(r":(\d{2})").try_cast("int"), F.lit(0))
    second = F.coalesce(part(r":\d{2}:(\d{2}(?:[.]\d{1,9})?)").try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    return F.when(half == "", hour).otherwise(twelve), minute, second


def _made(words: Column, clock: Column, day_first: bool | None) -> Column:
    """The timestamp of four words and a clock."""
    first, second, mark = F.get(words, F.lit(1)), F.get(words, F.lit(2)), F.get(words, F.lit(3))
    a, b = first.try_cast("int"), second.cast("int")
    chosen = (mark == "day") if day_first is None else F.lit(day_first)
    turned = (mark != "set") & ((a > 12) | ((b <= 12) & chosen))
    month, date = F.when(turned, b).otherwise(_month(first)), F.when(turned, a).otherwise(b)
    midnight = F.try_make_timestamp_ntz(_year(F.get(words, F.lit(0))), month, date, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    timed = F.try_make_timestamp_ntz(_year(F.get(words, F.lit(0))), month, date, *_clock_fields(clock))
    return F.when(clock == "", midnight).otherwise(timed)


def _order(words: Column) -> Column:
    """What a day says about the order of day and month: day, month, either or nothing."""
    a, b = F.get(words, F.lit(1)).try_cast("int"), F.get(words, F.lit(2)).cast("int")
    open_order = F.get(words, F.lit(3)) != "set"
    return (
        F.when(open_order & (a > 12) & (b <= 12), "day")
        .when(open_order & (b > 12) & (a <= 12), "month")
        .when(open_order & (a <= 12) & (b <= 12) & (a != b), "either")
    )


def read_date(text: Column, day_first: bool | None = None) -> Column:
    """A struct of ``at``, the timestamp, and ``order``, what the value says about day and month."""
    def parse(value: Column) -> Column:
        clock = F.regexp_extract(value, _CLOCK, 0)
        return _with(F.struct(value.alias("text"), clock.alias("clock")), parse_day)

    def parse_day(parts: Column) -> Column:
        day = F.regexp_replace(F.left(parts["text"], F.length(parts["text"]) - F.length(parts["clock"])), _WEEKDAY, "")
        return _with(day, lambda d: _with(_words(d), lambda words: F.struct(
            _made(words, parts["clock"], day_first).alias("at"), _order(words).alias("order"))))

    iso = F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz"))
    return F.coalesce(
        F.when(iso.isNotNull(), F.struct(iso.alias("at"), F.lit(None).cast("string").alias("order"))), _with(text, parse)
    )


def to_timestamp_mixed(text: Column, day_first: bool | None = None) -> Column:
    """A timestamp from any shape of the grammar, null when none fits or there is no such date.

    ``day_first`` settles dates whose first two numbers could both be the month; without it they
    are read month first, but day first between dots. Plain ISO text takes a shorter way.
    """
    return read_date(text, day_first)["at"]


def shape(text: Column) -> Column:
    """The shape of a value: digits as 9, month words as Mon, weekdays as Day, clock halves as AM."""
    words = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, "Day "), _MONTH, "Mon")
    return F.regexp_replace(F.regexp_replace(words, r" ?[AaPp]\.?[Mm]\.?$", " AM"), r"\d", "9")


def date_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: what its dates say about the order of day and month, in one pass.

    (column, filled, parsed, day_first, month_first, either, date_order): the counts of values that
    are surely day first, surely month first, or could be either (and would differ). The order is
    ``day first`` or ``month first`` if only one of them occurs, ``mixed`` if both do, ``ambiguous``
    if all could be either, and ``clear`` if no value needs an order. A mixed or ambiguous column is
    read by the default, and its ``either`` says how many values that guesses.
    """
    read = df.select(*[
        F.struct(F.col(f"`{c}`").isNotNull().alias("filled"), read_date(F.col(f"`{c}`")).alias("read")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])
    facts = []
    for i, name in enumerate(columns):
        order = F.col(f"c{i}.read.order")
        counts = {
            "filled": F.col(f"c{i}.filled"), "parsed": F.col(f"c{i}.read.at").isNotNull(),
            "day_first": order == "day", "month_first": order == "month", "either": order == "either",
        }
        facts.append(F.struct(F.lit(name).alias("column"), *[F.count_if(c).alias(n) for n, c in counts.items()]))
    rows = read.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    day, month, either = (F.col(c) > 0 for c in ("day_first", "month_first", "either"))
    order = F.when(day & month, "mixed").when(day, "day first").when(month, "month first").when(either, "ambiguous")
    return rows.withColumn("date_order", order.otherwise("clear"))


def with_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with text columns read as timestamps, each in the order that its own values show."""
    orders = {row["column"]: row["date_order"] for row in date_order(df, columns).collect()}  # a row per column
    chosen = {"day first": True, "month first": False}
    return df.select(*[
        to_timestamp_mixed(F.col(f"`{c}`"), chosen.get(orders[c])).alias(c) if c in orders else F.col(f"`{c}`")
        for c in df.columns
    ])


def date_shapes(df: DataFrame, column: str) -> DataFrame:
    """The distinct shapes of a text column: (shape, values, parsed, first, last).

    Values that are no date share a null shape, so there are no more rows than shapes that the
    grammar has.
    """
    text = F.col(f"`{column}`")
    rows = df.where(text.isNotNull()).select(text.alias("text"), to_timestamp_mixed(text).alias("read"))
    rows = rows.select(F.when(F.col("read").isNotNull(), shape(F.col("text"))).alias("shape"), "read")
    return rows.groupBy("shape").agg(
        F.count(F.lit(1)).alias("values"), F.count("read").alias("parsed"),
        F.min("read").alias("first"), F.max("read").alias("last"),
    )
