"""Scalar forms: strict lexical checks, canonical text, templates of stream ids, event references, upcasts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each scalar accepts as text (fixed forms).
FORMS = {
    "int": r"\A-?\d+\z",
    "uint": r"\A\d+\z",
    "decimal": r"\A-?\d+(\.\d+)?\z",
    "uuid": r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "timestamp": r"\A\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z",
    "bytes": r"\A([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z",
    "bool": r"\A(true|false)\z",
    "string": r"(?s)\A.*\z",
}


def accepts(kind: str, text: Column) -> Column:
    """Whether a text is a valid scalar of the kind; null is not."""
    ok = text.rlike(FORMS[kind])
    if kind == "int":
        ok = ok & text.try_cast("bigint").isNotNull()
    if kind == "uint":
        ok = ok & (F.length(text) <= 20) & (F.coalesce(text.try_cast("decimal(20,0)"), F.lit(-1)) <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    if kind == "timestamp":
        ok = ok & F.try_to_timestamp(text).isNotNull()
    return F.coalesce(ok, F.lit(False))


def scale_of(text: Column) -> Column:
    """Digits after the point: a decimal's scale is part of its value."""
    return F.char_length(F.regexp_extract(text, r"\.(\d+)$", 1))


def decimal_text(value: Column, scale: Column) -> Column:
    """Text of a decimal(38,18) with ``scale`` digits after the point."""
    whole = value.cast("decimal(38,18)").cast("string")
    point = F.instr(whole, ".")
    return F.when(scale == 0, F.substring(whole, F.lit(1), point - 1)).otherwise(F.substring(whole, F.lit(1), point + scale))


def decimal_key(text: Column) -> Column:
    """Normal form of a decimal map key: no trailing zeros, zero is 0."""
    cut = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(cut.isin("-0", "0", ""), "0").otherwise(cut)


def render(template: str, key: Column) -> Column:
    """A stream id of ``prefix{key}suffix``."""
    prefix, suffix = re.fullmatch(r"(.*)\{\w+\}(.*)", template).groups()
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(suffix))


def match(template: str, stream: Column, kind: str = "string") -> Column:
    """The key of a stream id that the template renders to the same id; null if there is none."""
    prefix, suffix = re.fullmatch(r"(.*)\{\w+\}(.*)", template).groups()
    n = F.char_length(stream) - len(prefix) - len(suffix)
    key = F.substring(stream, F.lit(len(prefix) + 1), n)
    good = stream.startswith(prefix) & stream.endswith(suffix) & (n > 0) & accepts(kind, key)
    if kind in ("int", "uint"):
        good = good & ~key.rlike(r"^-?0\d|^-0\z")
    return F.when(good, key)


def key_bytes(kind: str, key: Column) -> Column:
    """A key field as bytes that compare as its values do; a key of several fields is their concatenation.

    Text ends with a zero byte, whole numbers are big-endian (signed ones with the sign flipped), a uuid is its 16
    bytes, a timestamp its nanoseconds as a signed number, a bool one byte.
    """
    if kind == "uuid":
        return F.unhex(F.replace(key, F.lit("-"), F.lit("")))
    if kind == "bool":
        return F.unhex(F.when(key, "01").otherwise("00"))
    if kind == "timestamp":
        return key_bytes("int", F.unix_micros(key) * 1000)
    if kind == "int":
        return F.unhex(F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    if kind == "uint":
        high, low = F.floor(key.cast("decimal(20,0)") / F.lit(2**32)), F.pmod(key.cast("decimal(20,0)"), F.lit(2**32))
        return F.unhex(F.concat(F.lpad(F.hex(high.cast("long")), 8, "0"), F.lpad(F.hex(low.cast("long")), 8, "0")))
    if kind == "string":
        return F.concat(F.encode(key, "UTF-8"), F.unhex(F.lit("00")))
    raise ValueError(f"{kind} is no key type")


def event_ref(text: Column) -> Column:
    """struct(context, name, version) of ``Context.Name[@vN]``; null if malformed."""
    form = r"\A([A-Za-z]\w*)\.([A-Za-z]\w*)(?:@v([1-9]\d*))?\z"
    part = lambda i: F.regexp_extract(text, form, i)
    return F.when(text.rlike(form), F.struct(part(1).alias("context"), part(2).alias("name"), F.nullif(part(3), F.lit("")).cast("int").alias("version")))


def upcast(df: DataFrame, fields: dict[str, str], set_: dict[str, object] | None = None, rename: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """The next version's fields (name -> type): set, else renamed, else carried, else default, else null; others drop.

    ``rename`` maps old to new names. A default also fills a carried null.
    """
    set_, old, defaults = set_ or {}, {new: o for o, new in (rename or {}).items()}, defaults or {}

    def value(name: str, kind: str) -> Column:
        if name in set_:
            return F.lit(set_[name]).cast(kind)
        source = old.get(name, name)
        c = F.col(source) if source in df.columns else F.lit(None)
        return (F.coalesce(c, F.lit(defaults[name])) if name in defaults else c).cast(kind)

    return df.select(*[value(n, k).alias(n) for n, k in fields.items()])
