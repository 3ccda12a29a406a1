"""Internal keys as expressions: the user key, then seq * 256 + op as 8 big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DELETE, MAX_SEQ, PUT


def versions_first(key: str = "key", seq: str = "seq") -> list[Column]:
    """The sort order of versions: key ascending, then newest first."""
    return [F.col(key).asc(), F.col(seq).desc()]


def put_key(key, seq) -> Column:
    return F.struct(_col(key).alias("key"), _col(seq).alias("seq"), F.lit(PUT).cast("byte").alias("op"))


def delete_key(key, seq) -> Column:
    return F.struct(_col(key).alias("key"), _col(seq).alias("seq"), F.lit(DELETE).cast("byte").alias("op"))


def check_op(op) -> Column:
    """The op, or an error if it is neither a put nor a delete."""
    op = _col(op)
    bad = F.raise_error(F.concat(F.lit("corrupt entry: unknown op "), op.cast("string")))
    return F.when(op.isin(PUT, DELETE), op.cast("byte")).otherwise(bad.cast("byte"))


def check_seq(seq) -> Column:
    """The sequence number, or an error if it is outside its 56 bits."""
    seq = _col(seq)
    bad = F.raise_error(F.concat(F.lit("sequence number out of range: "), seq.cast("string")))
    return F.when((seq >= 0) & (seq <= MAX_SEQ), seq).otherwise(bad.cast("long"))


def encode(key, seq, op) -> Column:
    """The internal key's bytes."""
    trailer = F.concat(F.lpad(F.hex(check_seq(seq)), 14, "0"), F.lpad(F.hex(check_op(op).cast("long")), 2, "0"))
    return F.concat(_col(key).cast("binary"), F.unhex(trailer))


def decode(data) -> Column:
    """A struct of key, seq and op; an error for under 8 bytes or an unknown op."""
    data = _col(data)
    size = F.octet_length(data)
    trailer = F.hex(F.substring(data, size - 7, F.lit(8)))
    seq = F.conv(F.substring(trailer, 1, 14), 16, 10).cast("long")
    op = F.conv(F.substring(trailer, 15, 2), 16, 10).cast("int")
    bad = F.raise_error(F.lit("corrupt entry: an internal key has at least 8 bytes"))
    whole = F.struct(F.substring(data, F.lit(1), size - 8).alias("key"), seq.alias("seq"), check_op(op).alias("op"))
    return F.when(size >= 8, whole).otherwise(bad.cast("struct<key: binary, seq: bigint, op: tinyint>"))


def shared_prefix(a, b) -> Column:
    """The number of leading bytes (of hex-encoded pairs) that two binaries share; null if one is null."""
    x, y = F.hex(_col(a).cast("binary")), F.hex(_col(b).cast("binary"))
    most = F.least(F.length(x), F.length(y)) / 2
    # the first place where they differ; hex gives two digits for each byte
    differ = F.filter(F.sequence(F.lit(1), most.cast("int")), lambda k: F.substr(x, 2 * k - 1, F.lit(2)) != F.substr(y, 2 * k - 1, F.lit(2)))
    found = F.when(most >= 1, F.coalesce(F.get(differ, F.lit(0)) - 1, most.cast("int"))).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), found.cast("long"))


def frame_crc(data) -> Column:
    """CRC-32 as the log's frames carry it."""
    return F.crc32(_col(data).cast("binary"))


def little_endian(n) -> Column:
    """A number as four little-endian bytes."""
    h = F.lpad(F.hex(_col(n).cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))


def frame(key, seq, op, value) -> Column:
    """A whole log frame: type, length, payload of internal key and value, checksum."""
    inner, value = encode(key, seq, op), _col(value).cast("binary")
    payload = F.concat(little_endian(F.octet_length(inner)), inner, little_endian(F.octet_length(value)), value)
    return F.concat(F.unhex(F.lit("01")), little_endian(F.octet_length(payload)), payload, little_endian(frame_crc(payload)))


def bloom_bits(n) -> Column:
    """Bits of a filter for n keys at one false positive in a hundred: 64 at least, in whole bytes."""
    n = _col(n)
    raw = F.greatest(F.ceil(n * F.lit(-_LN_RATE) / F.lit(_LN2 * _LN2)), F.lit(64))
    return F.when(n == 0, F.lit(64)).otherwise(F.ceil(raw / 8) * 8).cast("long")


def bloom_hashes(n) -> Column:
    """Hash functions of that filter, from 1 to 30."""
    n = _col(n)
    k = F.round(bloom_bits(n) / n * F.lit(_LN2))
    return F.when(n == 0, F.lit(6)).otherwise(F.least(F.greatest(k, F.lit(1)), F.lit(30))).cast("long")


_LN_RATE, _LN2 = -4.605170185988091, 0.6931471805599453


def level_limit(level) -> Column:
    """Bytes that a level may hold: none set for 0, 10 MiB, 100 MiB, 1 GiB, then ten times more each."""
    level = _col(level)
    out = F.when(level == 0, F.lit((1 << 63) - 1)).when(level == 1, F.lit(10 << 20)).when(level == 2, F.lit(100 << 20))
    return out.otherwise((F.lit(1 << 30) * F.pow(F.lit(10), level - 3)).cast("long")).cast("long")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
