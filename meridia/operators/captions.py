"""DTVCC caption packets from byte pairs, and the services that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: the longest packet without its header, and the rows that can hold it
LONGEST, ROWS = 127, 64


def reassemble(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, number, packet array<int>) of whole packets, from rows with ``start``, ``b1`` and ``b2``.

    A start row holds a header and one byte, others two bytes; the header's low six bits are
    half the packet's length with the header, zero the longest. A packet that the next start
    cuts short goes; bytes past its length, and before the first start, are ignored. So a
    packet is its first 64 rows at most, whatever the rows until the next start.
    """
    w = Window.partitionBy(key).orderBy(*order)
    n = df.withColumn("number", F.sum(F.col("start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("number > 0")
    n = n.withColumn("_n", F.row_number().over(Window.partitionBy(key, "number").orderBy(*order))).where(F.col("_n") <= ROWS)
    rows = F.array_sort(F.collect_list(F.struct("_n", "start", "b1", "b2")))
    g = n.groupBy(key, "number").agg(rows.alias("rows"))
    code = F.get("rows", F.lit(0))["b1"].bitwiseAND(63)
    got = F.flatten(F.transform("rows", lambda x: F.when(x["start"], F.array(x["b2"])).otherwise(F.array(x["b1"], x["b2"]))))
    g = g.select(key, "number", F.when(code == 0, LONGEST).otherwise(code * 2 - 1).alias("owed"), got.alias("got"))
    return g.where(F.size("got") >= F.col("owed")).select(key, "number", F.slice("got", F.lit(1), F.col("owed")).alias("packet"))


def services(packet: Column) -> Column:
    """Sorted numbers (1 to 63) of the service blocks of a packet.

    A block is a header of three bits service and five bits size; service 7 with a size takes its
    number from the next byte. A zero header, a missing byte or a block past the end stops.
    """
    n = F.size(packet)

    def visit(s: Column, i: Column) -> Column:
        head = F.get(packet, i)
        size = head.bitwiseAND(31)
        wide = (F.shiftright(head, 5) == 7) & (size > 0)
        number = F.when(wide, F.get(packet, i + 1).bitwiseAND(63)).otherwise(F.shiftright(head, 5))
        after = i + 1 + wide.cast("int") + size
        found = F.when(number.between(1, 63), F.array_append(s["found"], number)).otherwise(s["found"])
        ends = (head == 0) | number.isNull() | (after > n)
        nothing = F.struct(F.lit(1 << 30).alias("next"), s["found"].alias("found"))
        return F.when(i < s["next"], s).when(ends, nothing).otherwise(F.struct(after.alias("next"), found.alias("found")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("found"))
    walk = F.aggregate(F.sequence(F.lit(0), n - 1), start, visit, lambda s: F.array_sort(F.array_distinct(s["found"])))
    return F.when(n > 0, walk).otherwise(F.array().cast("array<int>"))
