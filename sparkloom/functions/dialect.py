"""Scalar functions of the dialect whose meaning differs from Spark's, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*cols: Column) -> Column:
    """Nulls are left out."""
    return F.concat_ws("", *cols)


def int_div(a: Column, b: Column) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", a, b)


def log_base(base: Column | float, x: Column) -> Column:
    """LOG(base, x); LOG(x) alone is base 10."""
    return F.ln(x) / F.ln(base if isinstance(base, Column) else F.lit(float(base)))


def trunc_number(x: Column, digits: int = 0, kind: str = "double") -> Column:
    """TRUNC(x, digits): toward zero, as ``kind``, exact on decimals and integers;
    doubles are cut as they are written (1.15 has two digits)."""
    cut = F.call_function("floor", F.abs(x), F.lit(digits)).cast(kind)
    return F.when(F.abs(x) >= F.lit(10**15), x.cast(kind)).when(x < 0, -cut).otherwise(cut) if kind == "double" else F.when(x < 0, -cut).otherwise(cut)


def decode(x: Column, *pairs: object) -> Column:
    """DECODE(x, search, result, …[, default]); null equals null."""
    out = None
    for k in range(0, len(pairs) - 1, 2):
        hit = x.eqNullSafe(F.lit(pairs[k]))
        out = F.when(hit, F.lit(pairs[k + 1])) if out is None else out.when(hit, F.lit(pairs[k + 1]))
    return out.otherwise(F.lit(pairs[-1])) if len(pairs) % 2 else out


def nvl2(x: Column, some: Column, none: Column) -> Column:
    return F.when(x.isNotNull(), some).otherwise(none)


def lnnvl(condition: Column) -> Column:
    """True where the condition is false or null."""
    return ~F.coalesce(condition, F.lit(False))


def empty_as_null(x: Column) -> Column:
    """The compatibility mode in which '' is null."""
    return F.nullif(x, F.lit(""))


def instr(text: Column, part: str, start: int = 1, nth: int = 1) -> Column:
    """Place of the nth occurrence of ``part`` at or after ``start``; 0 without one."""
    at = F.locate(part, text, start)
    for _ in range(nth - 1):
        at = F.when(at > 0, F.call_function("locate", F.lit(part), text, at + 1)).otherwise(0)
    return at


def overlay(text: Column, new: str, start: int, length: int | None = None) -> Column:
    return F.overlay(text, F.lit(new), F.lit(start), F.lit(len(new) if length is None else length))


def btrim(text: Column, chars: str = " ") -> Column:
    """TRIM(BOTH chars FROM text): any of the characters."""
    own = "[" + re.escape(chars) + "]"
    return F.regexp_replace(text, f"^{own}+|{own}+$", "")


def substr(text: Column, start: int, length: int | None = None) -> Column:
    """SUBSTR: a negative ``start`` counts from the end, 0 is 1; beyond the text it is null."""
    n, at = F.length(text), F.lit(start if start > 0 else 1) if start >= 0 else F.length(text) + start + 1
    cut = F.substring(text, at, n if length is None else F.lit(length))
    return F.when((at < 1) | (at > n), None).when(F.lit(length is not None and length < 1), None).otherwise(cut)


def left(text: Column, n: int) -> Column:
    """LEFT: a negative ``n`` leaves so many characters out at the end."""
    return F.substring(text, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(text) + n, F.lit(0)))


def right(text: Column, n: int) -> Column:
    """RIGHT: a negative ``n`` leaves so many characters out at the start."""
    return F.right(text, F.lit(n)) if n >= 0 else F.substring(text, F.lit(1 - n), F.length(text))


def find_in_set(part: Column, listed: Column) -> Column:
    """FIND_IN_SET: place in a comma list, 0 if it isn't there."""
    return F.when(part.contains(","), 0).otherwise(F.find_in_set(part, listed))


def insert_text(text: Column, start: int, length: int, new: str) -> Column:
    """INSERT(text, start, length, new): the text as it is where start is outside."""
    changed = F.concat(F.substring(text, F.lit(1), F.lit(start - 1)), F.lit(new), F.substring(text, F.lit(start + length), F.length(text)))
    return F.when((F.lit(start) < 1) | (F.lit(start) > F.length(text)), text).otherwise(changed)


def field(x: Column, *values: object) -> Column:
    """FIELD(x, …): place of x among the values, 0 if it isn't there or null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), x), F.lit(0))


def elt(n: Column, *values: str) -> Column:
    """ELT(n, …): the nth value; null outside."""
    return F.get(F.array(*map(F.lit, values)), n - 1)


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_ident(text: Column) -> Column:
    """Quoted unless it is a plain lower-case name."""
    return F.when(text.rlike(r"^[a-z_][a-z0-9_$]*$"), text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def regexp_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def regexp_substr(text: Column, pattern: str, nth: int = 1) -> Column:
    """The nth match; null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), nth - 1)


def regexp_like(text: Column, pattern: str, flags: str = "") -> Column:
    """REGEXP_LIKE with flags i, n (. matches line feeds), m and x."""
    inline = "".join({"i": "i", "n": "s", "m": "m", "x": "x"}[f] for f in flags if f != "c")
    return text.rlike(f"(?{inline}){pattern}" if inline else pattern)


def add_months(d: Column, n: int) -> Column:
    """ADD_MONTHS: from the last day of a month to the last day of the other."""
    moved = F.add_months(d, n)
    return F.when(d == F.last_day(d), F.last_day(moved)).otherwise(moved)


def iso_dow(d: Column) -> Column:
    """EXTRACT(ISODOW): Monday is 1, Sunday 7."""
    return F.weekday(d) + 1


def epoch(ts: Column) -> Column:
    """EXTRACT(EPOCH) of a timestamp without zone, in whole seconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000)


def overlap(a: Column, b: Column) -> Column:
    """a && b on arrays: a value that isn't null in both."""
    return F.exists(a, lambda x: F.coalesce(F.array_contains(b, x), F.lit(False)))


def contains_all(a: Column, b: Column) -> Column:
    """a @> b on arrays: every value of b is in a."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def array_replace(a: Column, old: object, new: object) -> Column:
    """Every value equal to ``old`` (null equals null) becomes ``new``."""
    return F.transform(a, lambda x: F.when(x.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(x))


def json_path(document: Column, *steps: str | int) -> Column:
    """document #>> steps: text at a path of names and places (from 0)."""
    return F.get_json_object(document, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps))


def xml_text(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x.cast("string"), F.lit(char), F.lit(entity))
    return x


def xml_element(name: str, *content: Column, attributes: dict[str, Column] | None = None) -> Column:
    """XMLELEMENT(name, XMLATTRIBUTES(…), content …): content is escaped text unless it is XML already
    (wrap XML in ``xml``); null attributes and content are left out."""
    shown = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(xml_text(v), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    inside = F.concat(*(F.coalesce(c, F.lit("")) for c in content)) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), *shown)
    return F.when(inside == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inside, F.lit(f"</{name}>")))


def xml_forest(**named: Column) -> Column:
    """XMLFOREST(value AS name, …): an element for each value that isn't null."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"<{k}>"), xml_text(v), F.lit(f"</{k}>")), F.lit("")) for k, v in named.items()))


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """The regular expression of a SIMILAR TO pattern."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in "|*+?{}()[]-,^" or c.isalnum():
            out.append(c)
        else:
            out.append(re.escape(c))
        k += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(text: Column, pattern: str) -> Column:
    return text.rlike(similar_pattern(pattern))


def dow(d: Column) -> Column:
    """EXTRACT(DOW): Sunday is 0."""
    return F.dayofweek(d) - 1


def cast_or(x: Column, kind: str, default: object) -> Column:
    """CAST(x AS kind DEFAULT default ON CONVERSION ERROR)."""
    return F.when(x.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(x.try_cast(kind), F.lit(default).cast(kind)))


def rotate_zone(ts: Column, source: str, target: str) -> Column:
    """A timestamp without zone, read in one zone and written in another."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts)
