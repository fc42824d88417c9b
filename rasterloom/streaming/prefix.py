"""Blobs that arrive in pieces: reassembly with decoding as soon as a prefix suffices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.functions import codecs
from rasterloom.functions.codecs.base import CodecError

_OUT = "blob_id string, status string, format string, width bigint, height bigint, mode string, received bigint, message string"
_STATE = "pieces binary, next int, minimum bigint, waiting array<struct<seq:int,piece:binary,last:boolean>>"
ENDED = -1  # as `next`: the blob has its row, and pieces that still come are ignored


def reassemble(pieces: DataFrame, max_bytes: int = 64 << 20, timeout_ms: int = 3_600_000) -> DataFrame:
    """A row for each blob when it ends: status decoded, failed, too_long or abandoned.

    In: a stream of (blob_id string, seq int from 0, piece binary, last boolean). Pieces may come out of order.
    Decoding is tried only once the length that the decoder asked for is there. State is a blob's bytes, at most
    max_bytes; a mark that the blob has its row replaces them, and goes after timeout_ms without a piece."""

    def result(key: str, status: str, data: bytes, message: str | None = None, value=None, fmt: str | None = None) -> pd.DataFrame:
        size = (value.width, value.height, value.mode) if value is not None else (None, None, None)
        return pd.DataFrame([(key, status, fmt, *size, len(data), message)], columns=[x.split()[0] for x in _OUT.split(", ")]).astype({"width": "Int64", "height": "Int64", "received": "Int64"})

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data, following, minimum, waiting = state.get if state.exists else (b"", 0, 1, [])
        data, waiting = bytes(data or b""), {int(w["seq"]): (bytes(w["piece"]), bool(w["last"])) for w in waiting or []}
        if state.hasTimedOut:
            state.remove()
            if following != ENDED:
                yield result(key[0], "abandoned", data)
            return
        if following == ENDED:
            return
        ended = False
        for part in rows:
            for r in part.itertuples(index=False):
                waiting[int(r.seq)] = (bytes(r.piece or b""), bool(r.last))
        while following in waiting:
            piece, last = waiting.pop(following)
            data, following, ended = data + piece, following + 1, ended or last
        held = len(data) + sum(len(p) for p, _ in waiting.values())
        done = None
        if held > max_bytes:
            done = result(key[0], "too_long", data, f"over {max_bytes} bytes")
        elif ended or len(data) >= minimum:
            try:
                fmt, r = codecs.decode(data)
                done = result(key[0], "decoded", data, None, r.value, fmt)
            except CodecError as e:
                if e.kind == "NeedMoreData" and not ended:
                    minimum = max(e.minimum or 0, len(data) + 1)
                elif not ended and e.kind == "UnknownFormat" and len(data) < 16:
                    minimum = len(data) + 1
                else:
                    done = result(key[0], "failed", data, e.message)
        if done is not None:
            state.update((b"", ENDED, 0, []))
            state.setTimeoutDuration(timeout_ms)
            yield done
            return
        state.update((data, following, minimum, [{"seq": s, "piece": p, "last": e} for s, (p, e) in waiting.items()]))
        state.setTimeoutDuration(timeout_ms)

    return pieces.groupBy("blob_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
