"""Chinese readings of digits, numbers, dates and times as column expressions.

Everything here stays in the JVM. Readings are built from groups of four digits, so an expression's size
doesn't depend on the number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units of the readings.
DIGITS = "零一二三四五六七八九"
THOUSAND, HUNDRED, TEN, MYRIAD, YI = "千", "百", "十", "万", "亿"
MINUS, POINT, PERCENT, YEAR, MONTH, DAY = "负", "点", "百分之", "年", "月", "日"
HOUR, MINUTE, SECOND, SHARP = "点", "分", "秒", "整"
CURRENCY = {"dialogue": "块", "narration": "元"}
DOLLAR = "美元"
OPERATORS = {"+": "加", "×": "乘以", "÷": "除以", "=": "等于", "−": "减"}
LONGEST = 12


def digit_reading(value: Column) -> Column:
    """Each ASCII digit by its name; other characters stay."""
    return F.translate(value, "0123456789", DIGITS)


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once: each part of a reading looks at it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digit(d: Column) -> Column:
    return F.substring(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))


def _group(number: Column) -> Column:
    """A number below 10000; empty for 0."""
    return _bind(F.transform(F.array(*(F.lit(10**k) for k in range(4))), lambda p: (F.floor(number / p) % 10).cast("int")), _read_group)


def _read_group(places: Column) -> Column:
    d = [F.get(places, F.lit(k)) for k in range(4)]
    zero, none = F.lit("零"), F.lit("")
    thousands = F.when(d[3] > 0, F.concat(_digit(d[3]), F.lit(THOUSAND))).otherwise(none)
    hundreds = F.when(d[2] > 0, F.concat(_digit(d[2]), F.lit(HUNDRED))).otherwise(none)
    bare = (d[3] == 0) & (d[2] == 0)
    tens = F.when(d[1] > 0, F.concat(
        F.when((d[2] == 0) & (d[3] > 0), zero).otherwise(none),
        F.when(bare & (d[1] == 1), none).otherwise(_digit(d[1])), F.lit(TEN),
    )).otherwise(none)
    ones = F.when(d[0] > 0, F.concat(F.when((d[1] == 0) & ~bare, zero).otherwise(none), _digit(d[0]))).otherwise(none)
    return F.concat(thousands, hundreds, tens, ones)


def _read_integer(n: Column) -> Column:
    """A number of at most LONGEST digits."""
    low, middle, high, below = n % 10000, F.floor(n / 10000) % 10000, F.floor(n / 10**8), n % 10**8
    none, zero = F.lit(""), F.lit("零")
    rest = F.concat(
        F.when(middle > 0, F.concat(_group(middle), F.lit(MYRIAD))).otherwise(none),
        F.when((low > 0) & (low < 1000) & (middle > 0), zero).otherwise(none), _group(low),
    )
    top = F.when(high > 0, F.concat(_group(high), F.lit(YI), F.when((below > 0) & (below < 10**7), zero).otherwise(none))).otherwise(none)
    return F.when(n == 0, zero).otherwise(F.concat(top, rest))


def integer_reading(value: Column) -> Column:
    """An integer, given as a number or as its digits, with an optional sign; null where it is neither."""
    return _bind(value.cast("string"), _read_signed)


def _read_signed(text: Column) -> Column:
    digits = F.regexp_replace(text, r"^[+-]", "")
    short = F.regexp_replace(digits, r"^0+(?=\d)", "")
    read = F.when(F.length(short) <= LONGEST, _bind(short.try_cast("long"), _read_integer)).otherwise(digit_reading(digits))
    return F.when(digits.rlike(r"^\d+$"), F.concat(F.when(text.startswith("-") & (short != "0"), F.lit(MINUS)).otherwise(F.lit("")), read))


def _two_digits(n: int) -> str:
    tens, ones = divmod(n, 10)
    return DIGITS[n] if not tens else (DIGITS[tens] if tens > 1 else "") + TEN + (DIGITS[ones] if ones else "")


def small_reading(n: Column) -> Column:
    """A number below 100, by a table that the optimizer folds to a constant; null beyond."""
    return F.get(F.array(*(F.lit(_two_digits(k)) for k in range(100))), n.cast("int"))


def number_reading(value: Column) -> Column:
    """Sign, integer part and the digits of the fraction."""
    text = value.cast("string")
    bare = F.regexp_replace(text, r"^[+-]+", "")
    whole, fraction = F.split_part(bare, F.lit("."), F.lit(1)), F.split_part(bare, F.lit("."), F.lit(2))
    sign = F.when(text.startswith("-"), F.lit(MINUS)).otherwise(F.lit(""))
    return F.concat(sign, integer_reading(whole), F.when(F.contains(bare, F.lit(".")), F.concat(F.lit(POINT), digit_reading(fraction))).otherwise(F.lit("")))


def date_reading(date: Column) -> Column:
    return F.concat(digit_reading(F.year(date).cast("string")), F.lit(YEAR), small_reading(F.month(date)), F.lit(MONTH), small_reading(F.dayofmonth(date)), F.lit(DAY))


def checked_date_reading(text: Column) -> Column:
    """The reading of Y-M-D, Y/M/D or Y年M月D日; null for a date that isn't in the calendar."""
    part = lambda k: F.regexp_extract(text, r"^(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?$", k)
    return date_reading(F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))


def time_reading(hour: Column, minute: Column, second: Column | None = None) -> Column:
    """Null where a part is out of range; a missing second isn't read."""
    second = F.lit(None).cast("int") if second is None else second
    read = F.concat(
        small_reading(hour), F.lit(HOUR),
        F.when(minute == 0, F.lit(SHARP)).otherwise(F.concat(F.when(minute < 10, F.lit("零")).otherwise(F.lit("")), small_reading(minute), F.lit(MINUTE))),
        F.when(second.isNull(), F.lit("")).otherwise(F.concat(small_reading(second), F.lit(SECOND))),
    )
    return F.when((hour <= 23) & (minute <= 59) & (F.coalesce(second, F.lit(0)) <= 59), read)


def year_reading(text: Column) -> Column:
    """A year of four digits followed by 年."""
    return F.concat(digit_reading(F.regexp_extract(text, r"(?<!\d)(\d{4})年", 1)), F.lit(YEAR))


def phone_reading(text: Column) -> Column:
    """A mobile or landline number, digit by digit; null if it is neither."""
    area, local = (F.regexp_extract(text, r"^(0\d{2,3})-(\d{7,8})$", k) for k in (1, 2))
    return F.when(text.rlike(r"^1[3-9]\d{9}$"), digit_reading(text)).when(area != "", F.concat(digit_reading(area), F.lit("，"), digit_reading(local)))


def percent_reading(text: Column) -> Column:
    return F.concat(F.lit(PERCENT), number_reading(F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)%$", 1)))


def money_reading(text: Column, profile: str = "dialogue") -> Column:
    """¥ by the profile's unit, $ as dollars; null otherwise."""
    amount = lambda sign: F.regexp_extract(text, rf"^[{sign}](-?\d+(?:\.\d+)?)$", 1)
    return F.when(amount("¥￥") != "", F.concat(number_reading(amount("¥￥")), F.lit(CURRENCY[profile]))).when(amount("$") != "", F.concat(number_reading(amount("$")), F.lit(DOLLAR)))


def operator_words(text: Column) -> Column:
    """Operators between digits, and hyphens between digits, as words."""
    for sign, word in OPERATORS.items():
        text = F.regexp_replace(text, rf"(?U)(?<=\d)\s*\{sign}\s*(?=-?\d)" if sign == "+" else rf"(?U)(?<=\d)\s*{sign}\s*(?=-?\d)", word)
    return F.regexp_replace(text, r"(?<=\d)-(?=\d)", OPERATORS["−"])


def squeeze(text: Column) -> Column:
    """White space squeezed and trimmed, dots and tilde as spoken marks."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    return F.replace(F.replace(flat, F.lit("..."), F.lit("……")), F.lit("~"), F.lit("到"))
