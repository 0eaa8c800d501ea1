"""Scalar expressions as Spark columns; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the interface, fixed values: ASCII white space, the space separators, line separators, byte order mark.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Han characters and compatibility ideographs, which weigh more in a token estimate.
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"


def trimmed(x: Column) -> Column:
    """Without white space at either end; nothing between them is looked at for blanks."""
    return F.trim(x, F.lit(SPACES))


def squeezed(x: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed: the form in which names and quotes are compared."""
    return F.lower(F.trim(F.regexp_replace(x, f"{BLANKS}+", " ")))


def packed(x: Column) -> Column:
    """Lower case without any white space: the form in which a quote is looked for in its source."""
    return F.lower(F.regexp_replace(x, BLANKS, ""))


def visible_length(x: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(x, BLANKS, ""))


def stable_id(kind: str, value: Column) -> Column:
    """``kind`` and the first 24 hex digits of the SHA-256 of kind, a zero byte and the value."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat(F.lit(f"{kind}\0"), value), 256), 1, 24))


def short_id(kind: str, value: Column) -> Column:
    """``kind`` and the FNV-1a hash of the value."""
    return F.concat(F.lit(f"{kind}_"), fnv1a(value))


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""
    wide = F.hex(F.encode(value, "UTF-16BE"))
    units = F.when(F.length(wide) > 0, F.transform(F.sequence(F.lit(0), (F.length(wide) / 4 - 1).cast("int")), lambda i: F.conv(F.substring(wide, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    folded = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: ((h.bitwiseXOR(u)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def estimated_tokens(text: Column) -> Column:
    """max(1, ceil(Han / 1.5 + other / 4)) over code points."""
    han = F.regexp_count(text, F.lit(CJK))
    return F.greatest(F.lit(1), F.ceil(han / 1.5 + (F.length(text) - han) / 4)).cast("int")


def unfenced(text: Column) -> Column:
    """A model's answer without a Markdown code fence around it."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_object(text: Column) -> Column:
    """The JSON object that an answer holds, in a code fence or not, as text; null for arrays, other values and what is
    no JSON."""
    bare = unfenced(text)
    # a field behind it is found only if the object ends where the answer does
    whole = F.try_parse_json(F.concat(F.lit('{"x":'), bare, F.lit(',"leafmill_end":0}')))
    return F.when(bare.startswith("{") & (F.try_variant_get(whole, "$.leafmill_end", "int") == 0), bare)


def string_fields(payload: Column, fields: list[str]) -> Column:
    """The fields that an object lacks or holds as something other than a string."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{f}", "variant"))
    return F.filter(F.array(*(F.when(~F.coalesce(kind(f), F.lit("")).eqNullSafe("STRING"), F.lit(f)) for f in fields)), lambda x: x.isNotNull())


def or_default(x: Column, default: str) -> Column:
    """A blank or null text becomes the default."""
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), F.lit(default))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules whose condition holds, as an array."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())
