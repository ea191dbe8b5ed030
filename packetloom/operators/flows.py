"""Flows: units of packets, their numbering and cutting, and payload assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.octets import ROW_BYTES, ROWS_PER_FLOW, from_hex
from packetloom.operators.ranking import bucketed_rank
from packetloom.operators.stored import attach, stored

# Payload kept per flow in hex digits, packets per chunk, seconds per slice.
FLOW_HEX = 2048
CHUNK_PACKETS = 8
SLICE_SECONDS = 3600
MIN_BYTES = 200
MIN_PACKETS = 4

# Seconds per ranking bucket when frames are numbered: what one task sorts of one file.
RANK_SECONDS = 1

# Frame numbers whose lengths are summed together, and the share (one in so many) of all packets that makes a flow hot.
_FRAMES = 32_768
_HOT = 1024


def host_pair(src: str, dst: str) -> list[Column]:
    """The same key for both directions between two hosts."""
    return [F.least(src, dst).alias("host_a"), F.greatest(src, dst).alias("host_b")]


def session_key(src: str, sport: str, dst: str, dport: str) -> list[Column]:
    """The same key for both directions of one conversation: its two ends in order."""
    a, b = F.struct(F.col(src).alias("host"), F.col(sport).alias("port")), F.struct(F.col(dst).alias("host"), F.col(dport).alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return [low["host"].alias("host_a"), low["port"].alias("port_a"), high["host"].alias("host_b"), high["port"].alias("port_b")]


def unit_sizes(packets: DataFrame, keys: list[str], length: str | None = None) -> DataFrame:
    """Packets, and bytes if a length column is named, of every unit."""
    extra = [F.sum(length).alias("n_bytes")] if length else []
    return packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_packets"), *extra)


def large_units(
    packets: DataFrame, keys: list[str], length: str, min_bytes: int = MIN_BYTES, min_packets: int = MIN_PACKETS
) -> DataFrame:
    """Packets of units with at least so many bytes and packets."""
    sizes = unit_sizes(packets, keys, length)
    passing = sizes.where((F.col("n_bytes") >= min_bytes) & (F.col("n_packets") >= min_packets)).select(*keys)
    return packets.join(stored(passing, "large-units"), keys, "left_semi")


def without_small_units(packets: DataFrame, keys: list[str], min_packets: int = MIN_PACKETS) -> DataFrame:
    """Packets of units with more than ``min_packets`` packets."""
    passing = unit_sizes(packets, keys).where(F.col("n_packets") > min_packets).select(*keys)
    return packets.join(stored(passing, "large-units"), keys, "left_semi")


def semi_units(packets: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Packets of the listed units."""
    return packets.join(units.select(*keys), keys, "left_semi")


def first_packets(packets: DataFrame, n: int, frame: str = "frame_no") -> DataFrame:
    """Only the first ``n`` packets of every file, which are numbered from 1."""
    return packets.where(F.col(frame) <= n)


def chunk_id(c: int = CHUNK_PACKETS, frame: str = "frame_no") -> Column:
    """Number of the chunk of ``c`` packets a packet lies in."""
    return F.floor((F.col(frame) - 1) / c).cast("long")


def with_slices(packets: DataFrame, keys: list[str], ts: str = "ts", seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add ``slice_id``: whole time slices since the first packet of the unit."""
    first = stored(packets.groupBy(*keys).agg(F.min(ts).alias("_first")), "first-packet")
    since = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    joined = attach(packets, first, keys)
    return joined.withColumn("slice_id", F.floor(since / F.lit(seconds * 1_000_000)).cast("long")).drop("_first")


def numbered_frames(
    packets: DataFrame, file: list[str], ts: str, tie: list[str], bucket_seconds: int = RANK_SECONDS
) -> DataFrame:
    """Add ``frame_no`` (from 1) and ``time_relative`` seconds within the file.

    Frames are ranked inside time buckets, so that one file may hold most packets. Where the bucket
    counts are too many to broadcast, rows are shuffled by file and bucket once, for join and rank.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(micros / F.lit(bucket_seconds * 1_000_000))
    ranked = bucketed_rank(packets, file, [F.col(c) for c in [ts, *tie]], bucket, "frame_no")
    first = stored(packets.groupBy(*file).agg(F.min(micros).alias("_first")), "first-packet")
    relative = ((micros - F.col("_first")) / F.lit(1_000_000.0)).alias("time_relative")
    return attach(ranked, first, file).select(*packets.columns, "frame_no", relative)


def with_streams(packets: DataFrame, file: list[str], conversation: list[str], frame: str = "frame_no") -> DataFrame:
    """Add ``stream``: conversations of a file numbered from 0 in the order of their first packet."""
    first = stored(packets.groupBy(*file, *conversation).agg(F.min(frame).alias("_first")), "conversations")
    ranked = bucketed_rank(first, file, [F.col("_first")], F.floor(F.col("_first") / 100_000), "_n")
    numbers = stored(ranked.select(*file, *conversation, (F.col("_n") - 1).alias("stream")), "streams")
    return attach(packets, numbers, [*file, *conversation])


def prefix_ends(lengths: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, _last, _rows`` of units longer than ``width``: the last frame that begins inside it, and their rows.

    ``lengths`` is ``keys, _at, _len``. Lengths are summed per 32 768 frame numbers by partial aggregation; the running
    sum over these groups names the one group in which a unit reaches ``width``, and only that group is looked
    at frame by frame. Payloads are not touched.
    """
    some = lengths.where(F.col("_len") > 0).withColumn("_step", F.floor(F.col("_at") / _FRAMES))
    sizes = some.groupBy(*keys, "_step").agg(F.sum("_len").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    unit = Window.partitionBy(*keys)
    upto = sizes.withColumn("_upto", F.sum("_sum").over(unit.orderBy("_step"))).withColumn("_rows", F.sum("_n").over(unit))
    before = (F.col("_upto") - F.col("_sum")).alias("_before")
    reached = upto.select(*keys, "_step", "_rows", "_upto", before).where((F.col("_upto") >= width) & (F.col("_before") < width))
    reached = stored(reached.drop("_upto"), "reached")
    inside = attach(some, reached, [*keys, "_step"])
    begins = F.col("_before") + F.sum("_len").over(Window.partitionBy(*keys, "_step").orderBy("_at")) - F.col("_len")
    inside = inside.withColumn("_begins", begins).where(F.col("_begins") < width)
    return stored(inside.groupBy(*keys).agg(F.max("_at").alias("_last"), F.max("_rows").alias("_rows")), "prefix-ends")


def assembled(
    packets: DataFrame,
    keys: list[str],
    frame: str = "frame_no",
    payload: str = "payload",
    width: int = FLOW_HEX,
) -> DataFrame:
    """Payload of every flow in order, cut at ``width`` hex digits: ``keys, tcp_payload, payload_len``.

    Lengths alone tell where a flow's prefix ends (:func:`prefix_ends`). Packets behind that are dropped before payloads
    move, and one shuffle brings together what is left: at most ``width`` packets of a flow, each adding a
    digit or more. Ends of flows with over 1/1024 of all packets, of which there are at most 1024, make a table of their
    own, small enough for a broadcast; those of others are joined as their size asks for, by the keys that the payloads
    are then grouped by. Frame numbers are
    distinct in a flow: they number the packets of a flow or of its file. A flow whose payloads are all empty
    has an empty one, one without any payload is left out.
    """
    df = packets.where(F.col(payload).isNotNull()).select(
        *keys, F.col(frame).cast("long").alias("_at"), F.substring(payload, 1, width).alias("_text")
    )
    ends = prefix_ends(df.select(*keys, "_at", F.length("_text").alias("_len")), keys, width)
    if not ends.isEmpty():
        hot = F.col("_rows") * _HOT > df.count()
        large = stored(ends.where(hot).drop("_rows"), "large-ends")
        for table in (large, stored(ends.where(~hot).drop("_rows"), "ends")):
            df = attach(df, table, keys, "left").where(F.col("_last").isNull() | (F.col("_at") <= F.col("_last"))).drop("_last")
    # Packets without digits only name the flow: null pieces are not collected.
    pieces = F.array_sort(F.collect_list(F.when(F.length("_text") > 0, F.struct("_at", "_text"))))
    text = F.array_join(F.transform(pieces, lambda s: s["_text"]), "")
    whole = df.groupBy(*keys).agg(F.substring(text, 1, width).alias("_text"))
    octets = from_hex(F.col("_text"), on_odd="nibble")
    return whole.select(*keys, octets.alias("tcp_payload")).withColumn("payload_len", F.octet_length("tcp_payload"))


def _first_rows(packets: DataFrame, keys: list[str], frame: str, payload: str, rows: int, row_bytes: int) -> DataFrame:
    slim = packets.where(F.col(payload).isNotNull()).select(
        *keys, F.col(frame).alias("_at"), F.substring(payload, 1, 2 * row_bytes).alias("_text")
    )
    order = Window.partitionBy(*keys).orderBy("_at")
    first = slim.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows)
    pieces = F.array_sort(F.collect_list(F.struct("_n", "_text")))
    return first.groupBy(*keys).agg(F.transform(pieces, lambda s: s["_text"]).alias("rows"))


def patch_grid(
    packets: DataFrame,
    keys: list[str],
    short: str = "drop",
    frame: str = "frame_no",
    payload: str = "payload",
    rows: int = ROWS_PER_FLOW,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """The first payloads of every flow as rows of hex text: ``keys, rows``.

    Rows are zero-filled to ``row_bytes``. Flows with too few packets are left out
    (``short="drop"``) or filled up with zero rows (``"pad"``); ``"ragged"`` fills nothing.
    The rank limit is a constant, so Spark cuts each flow before the shuffle.
    """
    grid = _first_rows(packets, keys, frame, payload, rows, row_bytes)
    if short == "ragged":
        return grid
    if short not in ("drop", "pad"):
        raise ValueError("short must be 'drop', 'pad' or 'ragged'")
    filled = grid.withColumn("rows", F.transform("rows", lambda t: F.rpad(t, 2 * row_bytes, "0")))
    if short == "drop":
        return filled.where(F.size("rows") == rows)
    blank = F.array_repeat(F.lit("0" * (2 * row_bytes)), F.lit(rows) - F.size("rows"))
    return filled.withColumn("rows", F.concat("rows", blank))
