"""Live flow assembly."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators.flows import FLOW_HEX

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "flow string, start timestamp, end timestamp, n_packets long, payload string"


def _cut(pieces: list, width: int) -> list:
    """Of pieces in order, those that begin inside the first ``width`` digits."""
    kept, length = [], 0
    for piece in sorted(pieces):
        if length >= width:
            break
        kept.append(piece)
        length += len(piece[2])
    return kept


def _merge(sessions: list, new: list, gap: int, width: int) -> list:
    """Sessions ``[first, last, packets, pieces]`` with new ones folded in."""
    merged: list = []
    for first, last, packets, pieces in sorted(sessions + new, key=lambda s: s[0]):
        if merged and first - merged[-1][1] <= gap:
            held = merged[-1]
            held[1] = max(held[1], last)
            held[2] += packets
            held[3].extend(pieces)
        else:
            merged.append([first, last, packets, list(pieces)])
    for session in merged:
        session[3] = _cut(session[3], width)
    return merged


def _sessions(frame: pd.DataFrame, gap: int, width: int) -> list:
    """Sessions of the packets of one batch: sorted once, cut where the gap is too long."""
    if frame.empty:
        return []
    frame = frame.sort_values(["at", "ord"], kind="stable")
    at, sizes = frame["at"].to_numpy(), frame["text"].str.len().to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(at) > gap) + 1).tolist(), len(at)]
    out = []
    for a, b in zip(edges, edges[1:]):
        before = np.cumsum(sizes[a:b]) - sizes[a:b]
        head = frame.iloc[a : a + int(np.searchsorted(before, width))]
        pieces = [list(p) for p in zip(head["at"].tolist(), head["ord"].tolist(), head["text"].tolist())]
        out.append([int(at[a]), int(at[b - 1]), b - a, pieces])
    return out


def live_flows(
    stream: DataFrame,
    flow: Column,
    ts: Column,
    order: Column,
    payload: Column,
    gap_seconds: int,
    delay: str,
    width: int = FLOW_HEX,
) -> DataFrame:
    """Payload prefix of every flow session, emitted once the watermark has passed its end.

    A session ends after ``gap_seconds`` without a packet. Its state holds the packets that make
    up the first ``width`` hex digits and a count, however long it runs; a packet that arrives out
    of order takes its place among them.
    """
    gap = gap_seconds * 1_000_000
    packets = stream.where(payload.isNotNull()).select(
        flow.cast("string").alias("flow"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("at"),
        order.cast("long").alias("ord"),
        F.substring(payload, 1, width).alias("text"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = json.loads(state.get[0]) if state.exists else []
        for frame in frames:
            sessions = _merge(sessions, _sessions(frame, gap, width), gap, width)
        closed_before = state.getCurrentWatermarkMs() * 1000
        done = [s for s in sessions if s[1] + gap < closed_before]
        still = [s for s in sessions if s[1] + gap >= closed_before]
        if still:
            state.update((json.dumps(still),))
            state.setTimeoutTimestamp(max((still[0][1] + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(
                {
                    "flow": key[0],
                    "start": pd.to_datetime([s[0] for s in done], unit="us"),
                    "end": pd.to_datetime([s[1] for s in done], unit="us"),
                    "n_packets": [s[2] for s in done],
                    "payload": ["".join(p[2] for p in s[3])[:width] for s in done],
                }
            )

    return (
        packets.withWatermark("ts", delay)
        .groupBy("flow")
        .applyInPandasWithState(step, OUTPUT, "sessions string", "append", GroupStateTimeout.EventTimeTimeout)
    )
