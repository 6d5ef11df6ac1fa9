"""Bit-field, strand, context and percentage codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FWD, REV, BOTH, NA = 0, 1, 2, 3
CPG, CHG, CHH, UNKNOWN = 0, 1, 2, 3
MAX_COUNT, MAX_PERCENT_CODE = 65535, 255
CONTEXTS = ("CpG", "CHG", "CHH", "unknown")


def num(x: Column | str | int) -> Column:
    return (F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x).cast("long")


def field_mask(width: int) -> int:
    return (1 << width) - 1


def get_field(code: Column | str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(num(code), shift).bitwiseAND(F.lit(field_mask(width)).cast("long"))


def set_field(code: Column | str | int, value: Column | str | int, shift: int, width: int) -> Column:
    """code with the field replaced; bits of value over the width are dropped."""
    clear = F.lit(~(field_mask(width) << shift)).cast("long")
    return num(code).bitwiseAND(clear).bitwiseOR(F.shiftleft(num(value).bitwiseAND(F.lit(field_mask(width)).cast("long")), shift))


def clamp_field(value: Column | str, width: int) -> Column:
    return F.least(F.greatest(num(value), F.lit(0).cast("long")), F.lit(field_mask(width)).cast("long"))


def strand_code(char: Column | str) -> Column:
    c = F.col(char) if isinstance(char, str) else char
    return F.when(c == "+", FWD).when(c == "-", REV).when(c == ".", BOTH).otherwise(NA)


def strand_char(code: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, "+-.?")), (num(code).bitwiseAND(F.lit(3).cast("long")) + 1).cast("int"))


def pack_metadata(index: Column | str, strand: Column | str, term: Column | str) -> Column:
    """Bits 0-31 metadata index, 32-39 strand, 40-55 short term id."""
    return set_field(set_field(set_field(0, index, 0, 32), strand, 32, 8), term, 40, 16)


def parse_index(code: Column | str) -> Column:
    return get_field(code, 0, 32)


def parse_strand(code: Column | str) -> Column:
    return get_field(code, 32, 8)


def parse_term(code: Column | str) -> Column:
    return get_field(code, 40, 16)


def pack_bed_code(strand: Column | str) -> Column:
    return set_field(0, strand, 32, 8)


def encode_percent(p: Column | str) -> Column:
    x = (F.col(p) if isinstance(p, str) else p).cast("double")
    return F.when(F.isnan(x) | (x <= 0), 0).when(x >= 100, 255).otherwise(F.floor(x * 255 / 100 + 0.5)).cast("int")


def decode_percent(code: Column | str) -> Column:
    return num(code) * F.lit(100.0) / F.lit(255.0)


def percent_code(m: Column | str, u: Column | str) -> Column:
    """The level in 255ths, rounded half up; 0 without counts."""
    m, u = num(m), num(u)
    n = m + u
    return F.when(n <= 0, 0).otherwise(((510 * m + n) - (510 * m + n) % F.greatest(2 * n, F.lit(1))) / F.greatest(2 * n, F.lit(1))).cast("long")


def count_from_percent(code: Column | str, depth: Column | str) -> Column:
    x = 2 * num(depth) * num(code) + 255
    return ((x - x % 510) / 510).cast("long")


def saturating_sum(m: Column | str, u: Column | str) -> Column:
    return F.least(num(m) + num(u), F.lit(MAX_COUNT).cast("long"))


def pack_fields(code: Column | str, depth: Column | str, context: Column | str | int, strand: Column | str | int) -> Column:
    """Bits 0-15 depth, 16-23 level, 24-25 context, 26-27 strand."""
    return set_field(set_field(set_field(set_field(0, depth, 0, 16), code, 16, 8), context, 24, 2), strand, 26, 2)


def pack_payload(m: Column | str, u: Column | str, context: Column | str | int = CPG, strand: Column | str | int = NA) -> Column:
    """The level comes from the counts before the depth saturates; negative counts are none."""
    m, u = F.greatest(num(m), F.lit(0).cast("long")), F.greatest(num(u), F.lit(0).cast("long"))
    return pack_fields(percent_code(m, u), saturating_sum(m, u), context, strand)


def pack_percent_payload(p: Column | str, depth: Column | str, context: Column | str | int = CPG, strand: Column | str | int = NA) -> Column:
    return pack_fields(encode_percent(p), clamp_field(depth, 16), context, strand)


def get_depth(payload: Column | str) -> Column:
    return get_field(payload, 0, 16)


def get_percent_code(payload: Column | str) -> Column:
    return get_field(payload, 16, 8)


def get_context(payload: Column | str) -> Column:
    return get_field(payload, 24, 2)


def get_strand(payload: Column | str) -> Column:
    return get_field(payload, 26, 2)


def is_forward(payload: Column | str) -> Column:
    return get_strand(payload) == FWD


def context_label(context: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, CONTEXTS)), (num(context).bitwiseAND(F.lit(3).cast("long")) + 1).cast("int"))


def meth_fraction(payload: Column | str) -> Column:
    """NaN without depth."""
    return F.when(get_depth(payload) == 0, F.lit(float("nan"))).otherwise(get_percent_code(payload) / F.lit(255.0))


def meth_percent(payload: Column | str) -> Column:
    return F.when(get_depth(payload) == 0, F.lit(float("nan"))).otherwise(decode_percent(get_percent_code(payload)))


def get_meth(payload: Column | str) -> Column:
    return count_from_percent(get_percent_code(payload), get_depth(payload))


def get_unmeth(payload: Column | str) -> Column:
    return get_depth(payload) - get_meth(payload)


def decode_call(letter: Column | str) -> tuple[Column, Column]:
    """(context, methylated) of a call letter, null for other letters."""
    c = F.col(letter) if isinstance(letter, str) else letter
    up = F.upper(c)
    context = F.when(up == "Z", CPG).when(up == "X", CHG).when(up == "H", CHH).when(up == "U", UNKNOWN)
    return context, F.when(context.isNotNull(), c == up)


def infer_strand(path: Column | str) -> Column:
    """From the file name; top-strand marks are looked for first."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    has = lambda *xs: F.greatest(*[F.contains(name, F.lit(x)) for x in xs])
    return F.when(has("CTOT", "OT_", "_OT"), FWD).when(has("CTOB", "OB_", "_OB"), REV).otherwise(NA)


def sanitize_id(x: Column | str) -> Column:
    """Strip known prefixes, all of them, but never everything."""
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"^(?i)((gene|transcript|mrna|rna|cds|protein):)+(.+)$", "$3")


def sanitize_name(x: Column | str) -> Column:
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"[^A-Za-z0-9._-]", "_")


def parse_uint32(x: Column | str) -> Column:
    """Digits only, up to 4294967295, else null."""
    c = F.col(x) if isinstance(x, str) else x
    v = F.when((F.translate(c, "0123456789", "") == "") & (c != ""), c.try_cast("long"))
    return F.when(v <= 4294967295, v)
