"""Small Column builders shared by every module (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's whitespace set (\s and String.prototype.trim), as a Java regex class body.
WS = r"\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# C0, DEL..C1 and the two Unicode line separators.
UNSAFE_CLASS = r"[\u0000-\u001f\u007f-\u009f\u2028\u2029]"


# The same set as literal characters, for the (non-regex) character-set trim.
WS_CHARS = "\t\n\u000b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    """Trim the full JavaScript whitespace set (plain ``trim`` strips spaces only)."""
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return js_trim(c) == F.lit("")


def unsafe(c: Column) -> Column:
    """True when the text holds a control character or a line separator."""
    return c.rlike(UNSAFE_CLASS)


def sieve_quote(c: Column) -> Column:
    """Quote a value as a script string literal: backslash and quote escaped."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units (JavaScript ``length``)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def json_string(c: Column) -> Column:
    """JSON string literal of a text value (``JSON.stringify`` of a string)."""
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def memo_column(fn):
    """Memoize a Column builder per (session, input expression).

    The header parsers are large expression trees; building one costs many
    driver->JVM calls.  Reusing the built Column for the same input keeps
    query construction cheap.  Lambda variables have unique names, so calls
    inside ``transform`` simply miss the cache.
    """
    import functools

    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(c: Column) -> Column:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        key = (id(spark), str(c))
        hit = cache.get(key)
        if hit is None:
            hit = cache[key] = fn(c)
        return hit

    return wrapper
