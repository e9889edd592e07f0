"""Text scalars with Python's idea of whitespace, rounding and number printing.

Long expressions are written as Spark SQL text: they cross to the JVM in one call
however many nodes they have. Functions named ``*_sql`` take and give such text;
the others give columns and take the names or SQL text of their inputs.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) brings in the Unicode blanks; the four separator controls are added by hand
WORD = r"(?U)[^\s\x1c-\x1f]+"
# the same blanks one by one, for trimming
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_numbers = count()


def quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def let_sql(value: str, body) -> str:
    """Evaluate ``value`` once and use it as a variable in ``body(name)``.

    Inside a lambda an outer expression would be evaluated again per element, and
    elsewhere every mention is a copy; a one-element ``transform`` binds it instead.
    """
    name = f"v{next(_numbers)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {quote(WORD)}, 0)"


def strip_sql(text: str) -> str:
    # looks at the edges only, unlike a pattern
    return f"trim(both {quote(BLANKS)} from {text})"


def has_text_sql(text: str) -> str:
    """True for text with any non-blank character; never null."""
    return f"coalesce({text} rlike {quote(WORD)}, false)"


def words(text: str) -> Column:
    return F.expr(words_sql(text))


def word_count(text: str) -> Column:
    return F.expr(f"cast(regexp_count({text}, {quote(WORD)}) as bigint)")


def strip(text: str) -> Column:
    return F.expr(strip_sql(text))


def has_text(text: str) -> Column:
    return F.expr(has_text_sql(text))


def py_round_sql(value: str, digits: int) -> str:
    """Round the exact binary value half to even, as Python's ``round`` does.

    Spark rounds the printed decimal half up, which differs on values such as
    1.5e-06. The product with the power of ten is split into a rounded part and
    its exact error (Veltkamp/Dekker), so the comparison with one half is exact.
    No lambda is involved, so generated code shares the repeated parts.
    """
    scale = float(10 ** digits)
    s_hi = 134217729.0 * scale - (134217729.0 * scale - scale)
    s_lo = scale - s_hi
    x = f"abs(cast({value} as double))"
    spread = f"(134217729.0D * {x})"
    x_hi = f"({spread} - ({spread} - {x}))"
    x_lo = f"({x} - {x_hi})"
    top = f"({x} * {scale}D)"
    error = f"((({x_hi} * {s_hi}D - {top}) + {x_hi} * {s_lo}D + {x_lo} * {s_hi}D) + {x_lo} * {s_lo}D)"
    whole = f"floor({top})"
    beyond = f"(({top} - {whole} - 0.5D) + {error})"
    up = f"({beyond} > 0 or ({beyond} = 0 and pmod({whole}, 2) = 1))"
    rounded = f"(cast({whole} + if({up}, 1, 0) as double) / {scale}D)"
    # beyond 2**52 the scaled value has no fraction left to round
    return (f"case when {top} < 4503599627370496.0D then if(cast({value} as double) < 0, -{rounded}, {rounded})"
            f" else cast({value} as double) end")


def py_round(value: str, digits: int) -> Column:
    return F.expr(py_round_sql(value, digits))


def py_float_sql(value: str) -> str:
    """Print a double the way Python does: ``12345678.0``, ``2e-05``, ``1e+16``."""

    def printed(x: str) -> str:
        shown = f"cast({x} as string)"
        plain = (f"regexp_replace(regexp_replace(cast(cast({x} as decimal(38,20)) as string), '0+$', ''),"
                 f" {quote(chr(92) + '.$')}, '.0')")
        mantissa = f"regexp_replace(substring_index({shown}, 'E', 1), {quote(chr(92) + '.0$')}, '')"
        exponent = f"cast(substring_index({shown}, 'E', -1) as int)"
        scientific = (f"concat({mantissa}, if({exponent} < 0, 'e-', 'e+'), if(abs({exponent}) < 10, '0', ''),"
                      f" cast(abs({exponent}) as string))")
        return (
            f"case when isnan({x}) then 'nan' when abs({x}) = double('inf') then if({x} > 0, 'inf', '-inf')"
            f" when {x} = 0 or (abs({x}) >= 1e-3D and abs({x}) < 1e7D) then {shown}"
            f" when abs({x}) >= 1e-4D and abs({x}) < 1e16D then {plain}"
            f" when contains({shown}, 'E') then {scientific} else {shown} end"
        )

    return let_sql(f"cast({value} as double)", printed)


def py_float(value: str) -> Column:
    return F.expr(py_float_sql(value))


def py_bool(value: str) -> Column:
    """``True`` or ``False``; null stays null."""
    return F.expr(f"case when {value} then 'True' when not {value} then 'False' end")
