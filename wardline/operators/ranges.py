"""Longest-prefix match of addresses with a table of address ranges.

An address lies in a range of n bits exactly if its first n bits are the range's,
so each prefix length that occurs is one equi join, and the longest that finds
something decides. A table whose texts are few enough bytes, of up to
``JOINED_LENGTHS`` lengths, is broadcast, one small table a length, and the rows
are not shuffled.

A larger table, or one of more lengths, is met by the distinct addresses only. Each address is put out
once per prefix length under (width, length, prefix, slice); the slice is a hash of the
address, and the table stands under all slices, so a short prefix that covers
most addresses is no hot key. Prefixes of at most 4,096 addresses have one slice. Rows then take their address's answer; rows without
an address spread over all tasks, and Spark splits those of a frequent one.

A range of the same bits listed by several owners belongs to the smallest one. Texts that
are no range match nothing. A range with bits set beyond its length counts as the
range around it, and an address alone as a range of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.addresses import MAPPED, address_steps, prefix_sql
from wardline.operators.matching import BROADCAST_BYTES, with_computed
from wardline.registry import Registry, local_frame

#: prefix lengths that a row is looked up by one after another
JOINED_LENGTHS = 24
#: slices of a prefix where the table is not broadcast
SLICES = 16
#: bits after a prefix up to which it covers too few addresses to be a hot key
FEW_BITS = 12
#: bytes of a table row besides its texts
ROW_BYTES = 64


def with_address(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the address in column ``text`` as hexadecimal, null where it is none."""
    kept = df.columns
    for step in address_steps(text, name):
        df = with_computed(df, **step)
    return df.select(*kept, name)


def parsed_ranges(ranges: DataFrame) -> DataFrame:
    """``cidr, owner`` -> one ``width, bits, prefix, owner`` per range, the smallest owner of each.

    The width is 8 or 32, the number of hexadecimal digits of the family.
    """
    parts = ranges.filter("owner IS NOT NULL").selectExpr(
        "substring_index(trim(cidr), '/', 1) AS _address",
        "contains(cidr, '/') AS _has_bits",
        "CASE WHEN trim(cidr) RLIKE '^[^/]*/(0|[1-9][0-9]{0,2})$' THEN"
        " CAST(substring_index(trim(cidr), '/', -1) AS INT) END AS _bits",
        "owner",
    )
    found = with_address(parts, "_address", "_hex").filter("_hex IS NOT NULL")
    # /96 and more of a mapped IPv4 address counts from its own first bit
    mapped = "(length(_hex) = 8 AND contains(_address, ':'))"
    found = found.selectExpr(
        f"CASE WHEN {mapped} AND _bits < 96 THEN concat('{MAPPED}', _hex) ELSE _hex END AS _hex",
        f"CASE WHEN NOT _has_bits THEN 4 * length(_hex) WHEN {mapped} AND _bits >= 96 THEN _bits - 96 ELSE _bits END AS bits",
        "owner",
    ).filter("bits BETWEEN 0 AND 4 * length(_hex)")
    keyed = found.selectExpr("length(_hex) AS width", "bits", f"{prefix_sql('_hex', 'bits')} AS prefix", "owner")
    return keyed.groupBy("width", "bits", "prefix").agg(F.min("owner").alias("owner"))


def registry_ranges(spark: SparkSession, registry: Registry) -> DataFrame:
    """``cidr, owner`` of all signatures."""
    rows = [{"cidr": text, "owner": sig.id} for sig in registry.all() for text in sig.ip_ranges]
    return local_frame(spark, rows, "cidr string, owner string")


def join_range_owner(
    df: DataFrame,
    address: str,
    ranges: DataFrame,
    out: str,
    *,
    broadcast_bytes: int = BROADCAST_BYTES,
    slices: int = SLICES,
) -> DataFrame:
    """Add ``out``: the owner of the longest of ``ranges`` (cidr, owner) around column ``address``.

    A small job looks at ``ranges`` first: its prefix lengths (at most 162) and their size.
    Where they are few and below ``broadcast_bytes``, the ranges are read as well.
    """
    table = parsed_ranges(ranges)
    lengths = table.groupBy("width", "bits").agg(
        F.sum(F.length("prefix") + F.length("owner") + ROW_BYTES).alias("size")
    )
    found = sorted(((r.width, r.bits, r.size) for r in lengths.collect()), key=lambda r: -r[1])
    if not found:
        return df.withColumn(out, F.lit(None).cast("string"))
    small = sum(size for *_, size in found) <= broadcast_bytes
    if df.isStreaming or (small and len(found) <= JOINED_LENGTHS):
        return _by_lengths(df, address, table, [r[:2] for r in found], out, small)
    return _by_addresses(df, address, table, [r[:2] for r in found], out, slices)


def _by_lengths(
    df: DataFrame, address: str, table: DataFrame, lengths: list[tuple[int, int]], out: str, small: bool
) -> DataFrame:
    spark, parts = df.sparkSession, {}
    if small:
        # below broadcast_bytes: each length becomes a table of its own that Spark knows the size of
        for row in table.collect():
            parts.setdefault((row.width, row.bits), []).append({"_prefix": row.prefix, "_found": row.owner})
    rows, owners = with_address(df, address, "_hex"), []
    for width, bits in lengths:
        owner = f"_owner_{width}_{bits}"
        if small:
            part = F.broadcast(local_frame(spark, parts[width, bits], "_prefix string, _found string"))
        else:
            part = table.filter(f"width = {width} AND bits = {bits}").selectExpr("prefix AS _prefix", "owner AS _found")
        key = F.expr(f"CASE WHEN length(_hex) = {width} THEN {prefix_sql('_hex', bits)} END")
        rows = rows.join(part, key == F.col("_prefix"), "left").drop("_prefix").withColumnRenamed("_found", owner)
        owners.append(F.col(owner))
    return rows.select(*df.columns, F.coalesce(*owners, F.lit(None).cast("string")).alias(out))


def _by_addresses(
    df: DataFrame, address: str, table: DataFrame, lengths: list[tuple[int, int]], out: str, slices: int
) -> DataFrame:
    seen = df.select(F.col(address).alias("_address")).filter("_address IS NOT NULL").distinct()
    keys = ", ".join(
        f"CASE WHEN length(_hex) = {width} THEN named_struct('bits', {bits}, 'prefix', {prefix_sql('_hex', bits)},"
        f" 'slice', {'0' if 4 * width - bits <= FEW_BITS else '_slice'}) END"
        for width, bits in lengths
    )
    cut = with_address(seen, "_address", "_hex").filter("_hex IS NOT NULL")
    cut = cut.withColumn("_slice", F.expr(f"CAST(pmod(xxhash64(_address), {slices}) AS INT)"))
    cut = cut.selectExpr("_address", "length(_hex) AS width", f"inline(array_compact(array({keys})))")
    last = f"IF(4 * width - bits <= {FEW_BITS}, 0, {slices - 1})"
    spread = table.withColumn("slice", F.expr(f"explode(sequence(0, {last}))"))
    # Spark counts what a generator puts out as one row each and would broadcast either side
    owned = cut.join(spread.hint("merge"), ["width", "bits", "prefix", "slice"])
    owned = owned.groupBy("_address").agg(F.max_by("owner", "bits")).toDF("_found_address", "_found_owner")
    nowhere: Column = F.concat(F.lit("\x01"), (F.monotonically_increasing_id() % 1024).cast("string"))
    return (
        df.withColumn("_found_key", F.coalesce(F.col(address), nowhere))
        .join(owned, F.col("_found_key") == F.col("_found_address"), "left")
        .select(*df.columns, F.col("_found_owner").alias(out))
    )
