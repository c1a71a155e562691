"""Header-value functions (F1-F4, F15) as native Catalyst expressions.

Each function maps a ``Column`` to a ``Column``; nothing here calls Python per
row.  Regexes use the Java dialect: ``\\z`` for end of input, possessive
quantifiers where the original scanner never backtracks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import WS, js_trim, lit_array, memo_column

# An RFC 2047 encoded word: =?charset?B|Q?text?=
_WORD = rf"=\?[^?{WS}]+\?[bBqQ]\?[^?{WS}]+\?="
_WORD_G = rf"=\?([^?{WS}]+)\?([bBqQ])\?([^?{WS}]+)\?="
_TOKENS = rf"{_WORD}|(?:(?!{_WORD})[\s\S])++"
# Strict base64 whose unused trailing bits are zero.
_B64 = (r"^(?:[A-Za-z0-9+/]{4})*+"
        r"(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\z")
_Q_BAD = r"[^\x21-\x7e]|=(?![0-9a-fA-F]{2})"
_ADJACENT = rf"(?i)=\?[^?{WS}]+\?[bq]\?[^?{WS}]+\?=[ \t\r\n]+=\?"

# windows-1252 code points for bytes 0x80..0x9F (the WHATWG decoding of latin1/ascii
# labels); undefined bytes keep their C1 code point.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252_FULL = "".join(
    bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)
)


def _word_bytes(enc: Column, text: Column) -> Column:
    q_hex = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"=[0-9a-fA-F]{2}|[\s\S]"), 0),
            lambda x: F.when(F.length(x) == 3, x.substr(2, 2))
            .when(x == "_", F.lit("20"))
            .otherwise(F.hex(x)),
        ),
        "",
    )
    return F.when(enc == "b", F.unbase64(text)).otherwise(F.unhex(q_hex))


def _decode_bytes(charset: Column, data: Column) -> Column:
    cs = F.lower(charset)
    latin = F.translate(F.decode(data, "ISO-8859-1"), _C1, _CP1252_FULL)
    utf8 = F.regexp_replace(F.make_valid_utf8(data.cast("string")), r"^\ufeff", "")
    return F.when(cs.isin("us-ascii", "iso-8859-1"), latin).otherwise(utf8)


@memo_column
def decode_header(value: Column) -> Column:
    """RFC 2047 decode; any malformed word (or stray ``=?``) returns the value unchanged."""
    def is_word(t: Column) -> Column:
        return t.rlike(rf"^{_WORD}\z")

    def word_ok(t: Column) -> Column:
        enc = F.lower(F.regexp_extract(t, _WORD_G, 2))
        text = F.regexp_extract(t, _WORD_G, 3)
        return F.when(enc == "b", text.rlike(_B64)).otherwise(~text.rlike(_Q_BAD))

    def decoded(tokens: Column) -> Column:
        bad = F.exists(tokens, lambda t: F.when(is_word(t), ~word_ok(t)).otherwise(t.contains("=?")))

        def piece(t: Column, i: Column) -> Column:
            enc = F.lower(F.regexp_extract(t, _WORD_G, 2))
            charset = F.regexp_extract(t, _WORD_G, 1)
            text = F.regexp_extract(t, _WORD_G, 3)
            # Blanks vanish between two words; get() is null beyond either end.
            between = F.coalesce(is_word(F.get(tokens, i - 1)) & is_word(F.get(tokens, i + 1)), F.lit(False))
            return (
                F.when(is_word(t), _decode_bytes(charset, _word_bytes(enc, text)))
                .when(t.rlike(r"^[ \t\r\n]*\z") & between, F.lit(""))
                .otherwise(t)
            )

        return F.when(bad, value).otherwise(F.array_join(F.transform(tokens, piece), ""))

    # The tokens are bound once: an expression would be evaluated anew for each of them.
    return F.when(~value.contains("=?"), value).otherwise(let(F.regexp_extract_all(value, F.lit(_TOKENS), 0), decoded))


# Quoted span of the label scanner: "" and \" \\ are escapes; never backtracks.
_QSPAN = r'"(?:""|\\["\\]|[^"])*+"'


def _unquote(part: Column) -> Column:
    pieces = F.regexp_extract_all(part, F.lit(rf'[^"]++|{_QSPAN}'), 0)
    return F.array_join(
        F.transform(
            pieces,
            lambda x: F.when(
                x.startswith('"'),
                F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r'["\\](["\\])', "$1"),
            ).otherwise(x),
        ),
        "",
    )


@memo_column
def split_labels(raw: Column) -> Column:
    """Split one X-Gmail-Labels value into labels; NULL when a quote is unterminated.

    Plain values (no quote, no encoded word) take a split-and-trim fast path.
    """
    terminated = raw.rlike(rf'\A(?:[^"]++|{_QSPAN})*+\z')
    parts = F.regexp_extract_all(raw, F.lit(rf'(?:[^",]++|{_QSPAN})++'), 0)
    trimmed = F.transform(parts, lambda p: js_trim(_unquote(p)))

    def labels_of(t: Column) -> Column:
        pieces = F.filter(F.transform(F.split(decode_header(t), ","), js_trim), lambda s: s != "")
        return (
            F.when(t == "", F.array().cast("array<string>"))
            .when(t.rlike(_ADJACENT), pieces)
            .otherwise(F.array(decode_header(t)))
        )

    # split(trim(v), WS*,WS*) equals trimming every comma-separated piece; no lambda,
    # so the common case stays inside whole-stage codegen.
    fast = F.array_remove(F.split(js_trim(raw), rf"[{WS}]*,[{WS}]*"), "")
    slow = F.when(terminated, F.flatten(F.transform(trimmed, labels_of)))
    return F.when(~raw.contains('"') & ~raw.contains("=?"), fast).otherwise(slow)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a single-element lambda binding)."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


_ADDR = (r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
         r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\z")
# Java "." also stops at U+0085 (NEL), the only difference from the JavaScript dot here.
_ANGLE = r"^(.*?)<([^<>]+)>\z"
# Possessive: a plain star over a group recurses once for each character of a long name.
_QUOTED_DISPLAY = r'^"(?:[^"\\\r\n]++|\\[^\r\n])*+"\z'


@memo_column
def parse_sender(value: Column) -> Column:
    """One bare or ``display <addr>`` address, lower-cased; NULL when refused.

    A display name is only refused when it holds no encoded word, and then
    decoding leaves it unchanged, so the check runs on the raw display text.
    Written without lambdas so it compiles into the generated stage code.
    """
    def checked(x: Column) -> Column:
        return F.when((F.length(x) <= 254) & x.rlike(_ADDR), F.lower(x))

    def refused(d: Column) -> Column:
        return ((d != "") & ~d.contains("=?") & ~d.rlike(_QUOTED_DISPLAY)
                & d.rlike(r'[",;<>@:\\]'))

    def tail(a: Column) -> Column:
        return (
            F.when(~a.contains("<"), checked(a))
            .when(~a.rlike(_ANGLE), F.lit(None).cast("string"))
            .when(refused(js_trim(F.regexp_extract(a, _ANGLE, 1))), F.lit(None).cast("string"))
            .otherwise(checked(js_trim(F.regexp_extract(a, _ANGLE, 2))))
        )

    t = js_trim(value)
    return F.when(~t.contains("<") & t.contains("=?"), tail(decode_header(t))).otherwise(tail(t))


_MSGID = rf"^<[^<>{WS}]+@[^<>{WS}]+>\z"


@memo_column
def message_id(id_values: Column) -> Column:
    """The trimmed Message-ID when exactly one valid value is present, else NULL."""
    first = js_trim(F.try_element_at(id_values, F.lit(1)))
    return F.when((F.size(id_values) == 1) & first.rlike(_MSGID), first)


def replacement_count(value: Column) -> Column:
    """Number of U+FFFD characters (stream-level invalid UTF-8) in a raw value."""
    return F.length(value) - F.length(F.replace(value, F.lit("\ufffd"), F.lit("")))


def is_sent(labels: Column, sent_hint: Column) -> Column:
    """Sent hint, or any label (lower-cased) in the SENT set."""
    return sent_hint | F.coalesce(
        F.arrays_overlap(F.split(F.lower(F.array_join(labels, "\u0000")), "\u0000"),
                         lit_array(K.SENT)), F.lit(False)
    )
