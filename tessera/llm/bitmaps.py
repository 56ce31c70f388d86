"""A bitmap of key hashes: keeps wide rows out of a shuffle.

A row whose bit is unset is certainly not among the keys.  The bitmap has 32 bits a
key, between ``LEAST_BITS`` and ``MOST_BITS`` (64 MB) whatever the input, so it may be
broadcast; when it fills up, more rows pass and only the saving goes, never a row.
DataFrame functions only.  Columns of the rows may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
BITS_PER_KEY = 32
#: Keys to drop per task of the rows that may have one.
HIT_ROWS = 5000


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until no column has one of them in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(rows: DataFrame) -> list[Column]:
    return [named(c) for c in rows.columns]


class KeyBitmap:
    """The bitmap of the keys in one column of a table, sized by its rows."""

    def __init__(self, keys: DataFrame, column: str, bits: int | None = None):
        if bits is None:
            count = getattr(keys, "_tessera_rows", None)  # known of kept tables
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * (keys.count() if count is None else count)).bit_length()))
        self.bits = bits
        at = keys.select(self._position(named(column)).alias("at"))
        self.table = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))

    def _position(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def mark(self, rows: DataFrame, key: Column) -> tuple[DataFrame, Column]:
        """``rows`` with one more column, and that column: the key may be among the keys."""
        at, bucket, bits, hit = fresh(rows.columns, "bitmap_at", "bitmap_bucket", "bitmap_bits", "bitmap_hit")
        bit = F.bitmap_bit_position(F.col(at))
        byte = F.hex(F.substring(bits, F.call_function("shiftright", bit, F.lit(3)).cast("int") + 1, F.lit(1)))
        found = F.coalesce(F.getbit(F.conv(byte, 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
        placed = rows.withColumn(at, self._position(key)).withColumn(bucket, F.bitmap_bucket_number(F.col(at)))
        marked = placed.join(F.broadcast(self.table.toDF(bucket, bits)), bucket, "left").select(*columns_of(rows), found.alias(hit))
        return marked, F.col(hit)


def possible(rows: DataFrame, key: Column, bitmap: KeyBitmap) -> DataFrame:
    """The rows whose key may be among the bitmap's keys."""
    marked, hit = bitmap.mark(rows, key)
    return marked.filter(hit).select(*columns_of(rows))


def anti_by_key(rows: DataFrame, probe: Column, key: Column, dropped: DataFrame) -> DataFrame:
    """Rows whose key is not among those of ``dropped`` (columns ``probe`` and ``key``).

    The bitmap is asked about the cheap probe, and only its hits are shuffled by the
    key; rows with equal keys have equal probes.  Null keys and probes stay.
    """
    marked, hit = KeyBitmap(dropped, "probe").mark(rows, probe)
    own, gone = fresh(marked.columns, "row_key", "gone_key")
    sure = marked.filter(~hit).select(*columns_of(rows))
    keys = dropped.select(F.col("key").alias(gone)).distinct()
    maybe = marked.filter(hit).withColumn(own, key).join(keys, F.col(own) == F.col(gone), "left_anti").select(*columns_of(rows))
    count = getattr(dropped, "_tessera_rows", None)
    if count is not None:  # few wide rows are hit beside those to drop: no more tasks than they need
        maybe = maybe.coalesce(max(4, -(-count // HIT_ROWS)))
    return sure.unionByName(maybe)


def semi_by_id(rows: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id is in ``wanted``; only possible hits are shuffled."""
    hits = possible(rows, named(id_column), KeyBitmap(wanted, id_column))
    return hits.join(wanted.select(named(id_column)).distinct(), id_column, "left_semi").select(*columns_of(rows))
