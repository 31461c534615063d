"""Scalar functions on ids, all plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import types
from tidelog.types import MASK60

#: The order-preserving alphabets: fixed values.
BASE64 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~"
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: The alphabet of base64(): a fixed value.
_BUILT_IN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _letters(v: Column, alphabet: str, bits: int, count: int, top: int) -> Column:
    """count letters of bits each, the highest first, of which the first starts at bit top."""
    place = lambda i: F.shiftright(v, top - bits * (i + 1)) if top >= bits * (i + 1) else F.shiftleft(v, bits * (i + 1) - top)
    return F.concat(*[F.substr(F.lit(alphabet), (place(i).bitwiseAND((1 << bits) - 1) + 1).cast("int"), F.lit(1)) for i in range(count)])


def encode60(v: Column) -> Column:
    """Ten letters of a 60-bit value; their order is the values' order."""
    raw = F.unhex(F.lpad(F.hex(F.shiftleft(v, 4)), 16, "0"))
    return F.translate(F.substring(F.base64(raw), 1, 10), _BUILT_IN, BASE64)


def encode60_short(v: Column) -> Column:
    """The letters without trailing zeros; 0 is "0"."""
    return F.regexp_replace(encode60(v), "(?<=.)0+$", "")


def encode60_base32(v: Column) -> Column:
    """Twelve letters of five bits without trailing zeros: file names."""
    return F.regexp_replace(_letters(v, BASE32, 5, 12, 60), "(?<=.)0+$", "")


def decode60(s: Column) -> Column:
    """The value of up to ten letters, left-aligned; null for other letters."""
    padded = F.rpad(s, 10, "0")
    terms = [F.shiftleft((F.instr(F.lit(BASE64), F.substr(padded, F.lit(i + 1), F.lit(1))) - 1).cast("bigint"), 54 - 6 * i) for i in range(10)]
    total = terms[0]
    for t in terms[1:]:
        total = total.bitwiseOR(t)
    return F.when(s.rlike("^[0-9A-Za-z_~]{1,10}$"), total)


def sortable(u: Column) -> Column:
    """An id as 22 letters in id order."""
    low = (u["variant"] * 4 + u["version"]).cast("int")
    return F.concat(F.substr(F.lit(BASE64), u["variety"].cast("int") + 1, F.lit(1)), encode60(u["value"]), F.substr(F.lit(BASE64), low + 1, F.lit(1)), encode60(u["origin"]))


def uuid_text(u: Column) -> Column:
    """The short text form: variety, value, version sign and origin, parts that are zero left out."""
    sign = F.substr(F.lit("$%+-"), u["version"].cast("int") + 1, F.lit(1))
    head = F.when(u["variety"] != 0, F.concat(F.substr(F.lit(BASE64), u["variety"].cast("int") + 1, F.lit(1)), F.lit("/"))).otherwise("")
    tail = F.when((u["version"] == 0) & (u["origin"] == 0), "").otherwise(F.concat(sign, encode60_short(u["origin"])))
    generic = u["variant"] != 0
    return F.when(generic, sortable(u)).otherwise(F.concat(head, encode60_short(u["value"]), tail))


def zigzag_encode(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def zigzag_decode(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(1))


def succ_value(v: Column) -> Column:
    """The next 60-bit value; the last one stays."""
    return F.least(v + 1, F.lit(MASK60))


def least_significant60(v: Column) -> Column:
    return v.bitwiseAND(MASK60)


def op_pattern(op_version: Column, ref_version: Column) -> Column:
    """What an op does, by the versions of its id and its reference; null for none of the patterns."""
    of = {(0, 2): "annotation", (0, 3): "annotation_derived", (2, 0): "create", (2, 2): "regular", (2, 3): "ack", (3, 2): "delete", (3, 3): "undelete"}
    out = None
    for (a, b), name in of.items():
        hit = (op_version == a) & (ref_version == b)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def hue(origin: Column) -> Column:
    """A replica's colour."""
    return F.pmod(origin, F.lit(360))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _read(s: Column, alphabet: str, bits: int, count: int) -> Column:
    """The number of up to count letters of bits each, left-aligned."""
    digit = lambda t, i: (F.instr(F.lit(alphabet), F.substr(t, i, F.lit(1))) - 1).cast("bigint")
    return _let(F.rpad(s, count, alphabet[0]), lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.lit(0).cast("bigint"), lambda acc, i: F.shiftleft(acc, bits).bitwiseOR(digit(t, i))))


def words64(u: Column) -> Column:
    """An id's two 64-bit halves (x, y), as signed numbers of the same bits."""
    half = lambda top, low: F.shiftleft(top.cast("bigint"), 60).bitwiseOR(low)
    return _let(u, lambda u: F.struct(half(u["variety"], u["value"]).alias("x"), half(u["variant"] * 4 + u["version"], u["origin"]).alias("y")))


def from_words64(x: Column, y: Column) -> Column:
    """The id of two 64-bit halves; null where one is."""

    def made(w: Column) -> Column:
        low = F.shiftrightunsigned(w["y"], 60)
        u = types.uuid(F.shiftrightunsigned(w["x"], 60), w["x"].bitwiseAND(MASK60), F.shiftright(low, 2), low.bitwiseAND(3), w["y"].bitwiseAND(MASK60))
        return F.when(w["x"].isNotNull() & w["y"].isNotNull(), u)

    return _let(F.struct(x.alias("x"), y.alias("y")), made)


def to_word60(v: Column) -> Column:
    """v where it has 60 bits, else null."""
    return F.when((v >= 0) & (v <= MASK60), v)


def least_significant24(v: Column) -> Column:
    return v.bitwiseAND((1 << 24) - 1)


def succ(u: Column) -> Column:
    """The id with the next value; the last one stays."""
    return u.withField("value", succ_value(u["value"]))


def scoped_name(scope: Column, name: Column) -> Column:
    """The id that a scope and a local name of up to ten letters each make; a global name has the local name ""; null for others."""
    word = lambda s: F.when(s == "", F.lit(0).cast("bigint")).otherwise(decode60(s))
    a, b = word(scope), word(name)
    return F.when(a.isNotNull() & b.isNotNull(), types.uuid(0, a, 0, 0, b))


def global_name(name: Column) -> Column:
    return scoped_name(name, F.lit(""))


def name_of(u: Column) -> Column:
    """(scope, name) of a name id, the name "" for a global one; null for other ids."""
    local = F.when(u["origin"] == 0, "").otherwise(encode60_short(u["origin"]))
    return F.when((u["variety"] == 0) & (u["variant"] == 0) & (u["version"] == 0), F.struct(encode60_short(u["value"]).alias("scope"), local.alias("name")))


def encode64(v: Column) -> Column:
    """Eleven letters of 64 bits, in unsigned order."""
    return _let(v, lambda v: F.concat(F.substr(F.lit(BASE64), F.shiftrightunsigned(v, 60).cast("int") + 1, F.lit(1)), encode60(v.bitwiseAND(MASK60))))


def encode64_base32_short(v: Column) -> Column:
    """Thirteen letters of five bits, of which the first has four, without trailing zeros; 0 is "0"."""
    letter = lambda v, i: F.substr(F.lit(BASE32), F.call_function("shiftrightunsigned", v, i).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return _let(v, lambda v: F.regexp_replace(F.array_join(F.transform(F.sequence(F.lit(60), F.lit(0), F.lit(-5)), lambda i: letter(v, i)), ""), "(?<=.)0+$", ""))


def decode60_base32(s: Column) -> Column:
    """The value of up to twelve letters of five bits, left-aligned; null for other letters."""
    return F.when(s.rlike("^[0-9A-V]{0,12}$"), _read(s, BASE32, 5, 12))


def _decode64(s: Column, tail, letters: str) -> Column:
    first = lambda s: F.shiftleft((F.instr(F.lit(BASE64), F.substr(s, F.lit(1), F.lit(1))) - 1).cast("bigint"), 60)
    return _let(s, lambda s: F.when(s.rlike(f"^[0-9A-F]{letters}$"), first(s).bitwiseOR(tail(F.substr(s, F.lit(2))))))


def decode64(s: Column) -> Column:
    """64 bits of a letter of four bits and up to ten of six; null for other letters."""
    return _decode64(s, lambda t: _read(t, BASE64, 6, 10), "[0-9A-Za-z_~]{0,10}")


def decode64_base32(s: Column) -> Column:
    """64 bits of a letter of four bits and up to twelve of five; null for other letters."""
    return _decode64(s, lambda t: _read(t, BASE32, 5, 12), "[0-9A-V]{0,12}")


def file_name(u: Column) -> Column:
    """An id as a file name, whose letters do not depend on case."""
    return _let(words64(u), lambda w: F.concat(encode64_base32_short(w["x"]), F.lit("-"), encode64_base32_short(w["y"])))


def from_file_name(s: Column) -> Column:
    """The id of a file name in either case; null for others."""
    return _let(F.split(F.upper(s), "-", 2), lambda p: from_words64(decode64_base32(F.get(p, F.lit(0))), decode64_base32(F.get(p, F.lit(1)))))


def is_file_name(s: Column) -> Column:
    """Whether a name is just how its id is written."""
    return _let(s, lambda s: F.coalesce(file_name(from_file_name(s)) == s, F.lit(False)))


def from_sortable(s: Column) -> Column:
    """The id of 22 sortable letters."""
    part = lambda t, at, n: _read(F.substr(t, F.lit(at), F.lit(n)), BASE64, 6, n)

    def made(t: Column) -> Column:
        low = part(t, 12, 1)
        return types.uuid(part(t, 1, 1), part(t, 2, 10), F.shiftright(low, 2), low.bitwiseAND(3), part(t, 13, 10))

    return _let(s, made)


def encode_bytes(b: Column) -> Column:
    """A blob in the letters of this Base64, without padding."""
    return F.translate(F.regexp_replace(F.base64(b), "=+$", ""), _BUILT_IN, BASE64)


def decode_bytes(s: Column) -> Column:
    """The blob of letters; null for others. A single letter after the last four says nothing."""
    cut = F.when(F.length(s) % 4 == 1, F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    standard = F.translate(cut, BASE64, _BUILT_IN)
    return F.when(s.rlike("^[0-9A-Za-z_~]*$"), F.unbase64(F.rpad(standard, (F.ceil(F.length(cut) / 4) * 4).cast("int"), F.lit("="))))
