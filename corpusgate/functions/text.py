"""Scalar Column helpers (SF1–SF13). All JVM-side built-ins, no UDFs."""
from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: ASCII whitespace, the four
# information separators, NEL and every Unicode space separator.
_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}]"
STRIP_PATTERN = rf"^{_WS}+|{_WS}+$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Unicode strip, like Python's `str.strip()` (Spark `trim` only strips spaces)."""
    return F.regexp_replace(col(c), STRIP_PATTERN, "")


# Characters that Python's `repr` writes as escapes (Latin-1 part; the rest of Unicode is printed as it is).
_ESCAPES = {chr(i): f"\\x{i:02x}" for i in (*range(32), *range(127, 161), 173)} | {
    "\t": "\\t", "\n": "\\n", "\r": "\\r", "\\": "\\\\"}


def quoted(c) -> Column:
    """Python `repr` of a string: in single quotes, or in double quotes if it
    holds a single and no double quote; backslashes and control characters
    escaped."""
    x = col(c)
    marks = F.create_map(*[F.lit(v) for pair in _ESCAPES.items() for v in pair])
    double = x.contains("'") & ~x.contains('"')
    quote = F.when(double, F.lit('"')).otherwise(F.lit("'"))
    body = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(
        F.when((ch == "'") & ~double, F.lit("\\'")), F.try_element_at(marks, ch), ch)), "")
    plain = F.concat(F.lit("'"), x, F.lit("'"))
    return F.when(x.rlike("['\\\\\\x00-\\x1f\\x7f-\\xa0\\xad]"), F.concat(quote, body, quote)).otherwise(plain)


def percent(c) -> Column:
    """Python `f"{x:.0%}"`: x*100 rounded half to even, then '%'."""
    return F.concat(F.bround(col(c) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def thousands(c) -> Column:
    """Python `f"{n:,}"` for integers."""
    return F.format_number(col(c), 0)


def _digits(x: Column) -> tuple[Column, Column]:
    """(digits, point) of a positive finite double: the fewest decimal digits that give it back, without zeros at
    either end, and where its decimal point stands (0: before the first digit).

    Java's text may hold a digit or two too many; a digit goes while the shorter number, rounded down or up, is
    still the same double."""
    text = x.cast("string")
    mantissa, power = F.split(text, "E")[0], F.coalesce(F.get(F.split(text, "E"), F.lit(1)).cast("int"), F.lit(0))
    whole = F.split(mantissa, r"\.")[0]
    raw = F.concat(whole, F.coalesce(F.get(F.split(mantissa, r"\."), F.lit(1)), F.lit("")))
    lead = F.regexp_replace(raw, "^0+", "")
    found = F.struct(F.regexp_replace(lead, "0+$", "").alias("d"),
                     (F.length(whole) + power - (F.length(raw) - F.length(lead))).alias("p"))

    def shorter(s: Column) -> Column:
        n = F.length(s["d"])
        cut, power = F.substring(s["d"], F.lit(1), n - 1).cast("decimal(20,0)"), s["p"] - n + 1

        def as_found(number: Column) -> Column:
            t = number.cast("string")
            return F.when((n > 1) & (F.concat(t, F.lit("E"), power.cast("string")).cast("double") == x), F.struct(
                F.regexp_replace(t, "0+$", "").alias("d"), (F.length(t) + power).alias("p")))

        down, up = as_found(cut), as_found(cut + 1)
        # where the digit that goes is a 5, a whole number itself tells to which side it was rounded
        middle = s["d"].cast("decimal(38,0)") * F.rpad(F.lit("1"), F.greatest(s["p"] - n, F.lit(0)) + 1, "0").cast("decimal(38,0)")
        low = (x < 9e18) & (x >= 1e15) & (F.substring(s["d"], -1, 1) == "5") & (x.try_cast("bigint").cast("decimal(38,0)") < middle)
        return F.when((F.substring(s["d"], -1, 1) >= "5") & ~F.coalesce(low, F.lit(False)), F.coalesce(up, down, s)) \
            .otherwise(F.coalesce(down, up, s))

    # a fold evaluates each step once, where nested expressions would repeat one another
    found = F.aggregate(F.sequence(F.lit(1), F.lit(3)), found, lambda s, _: shorter(s))
    return found["d"], found["p"]


def _scientific(digits: Column, point: Column) -> Column:
    power = point - 1
    rest = F.substring(digits, F.lit(2), F.length(digits))
    return F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
                    F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                    F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))


def _signed(x: Column, zero: str, positive: Column) -> Column:
    minus = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    return (F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.concat(minus, F.lit("inf")))
            .when(x == 0, F.concat(minus, F.lit(zero))).otherwise(F.concat(minus, positive)))


def float_text(c) -> Column:
    """Python `str` of a float: the shortest digits that give it back, with an exponent below 1e-4 and from 1e16."""
    x = col(c).cast("double")
    found = F.struct(*[v.alias(k) for v, k in zip(_digits(F.abs(x)), "dp")])

    def text(s: Column) -> Column:
        d, p = s["d"], s["p"]
        n = F.length(d)
        return (F.when((p < -3) | (p > 16), _scientific(d, p))
                .when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
                .when(p >= n, F.concat(d, F.repeat(F.lit("0"), p - n), F.lit(".0")))
                .otherwise(F.concat(F.substring(d, F.lit(1), p), F.lit("."), F.substring(d, p + 1, n))))

    return F.when(x.isNotNull(), _signed(x, "0.0", F.transform(F.array(found), text)[0]))


def fmt_g(c) -> Column:
    """Python `f"{x:g}"` for values in [1e-4, 1e6): six significant digits,
    half-even, trailing zeros dropped. Outside that range the double's own
    text is used (documented difference)."""
    x = col(c).cast("double")
    scale = F.lit(5) - F.floor(F.log10(F.abs(x)))
    text = None
    for d in range(0, 10):  # bround takes a literal scale: one branch per scale
        s = F.bround(x, d).cast("decimal(38,10)").cast("string")
        s = F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
        text = F.when(scale == d, s) if text is None else text.when(scale == d, s)
    in_range = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e6)
    return F.when(x == 0, F.lit("0")).when(in_range, text).otherwise(x.cast("string"))


def truncate_chars(c, n: int, mark: str = "…") -> Column:
    """First n characters plus a mark when longer (SO2)."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(mark))).otherwise(col(c))


def nullif_empty(c) -> Column:
    """'' counts as absent (SF12)."""
    return F.nullif(col(c), F.lit(""))


def truthy(c) -> Column:
    """Python truthiness of an optional string: not null and not ''."""
    return F.coalesce(col(c) != F.lit(""), F.lit(False))


def message(template: str, **values) -> Column:
    """Compile a `str.format` template into one `concat` Column.

    Field values are Columns (or plain Python values); `!r` quotes a string
    value. A null value makes the whole message null, so callers coalesce.
    """
    parts = []
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        value = values[field]
        value = value if isinstance(value, Column) else F.lit(value)
        if conversion == "r":
            value = quoted(value)
        parts.append(value.cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def sql_message(template: str, **values: str) -> str:
    """The same template as a SQL string expression, for oracle queries."""
    parts = []
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(sql_literal(literal))
        if field is None:
            continue
        value = values[field]
        if conversion == "r":
            value = f"('''' || {value} || '''')"
        parts.append(f"cast({value} as varchar)")
    return "(" + " || ".join(parts) + ")" if parts else "''"


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
