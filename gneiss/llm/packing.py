"""Operator 2: packing tokenised documents into sequences of bounded length.

Documents become pieces of at most `capacity` tokens.  Pieces are dealt into groups of about GROUP by
a number that each row gets once, so equal rows spread like any others.  A group is put into
sequences first fit, in the order of arrival, and then improved by local search: a piece or two of
the emptiest sequence move to an underfull one, alone or in exchange for one of its pieces, whichever
raises the sum of squared fills most; where none does, a piece is exchanged for two smaller ones of
any sequence.  The search ends when there are as few sequences as the tokens allow, when no exchange
is left, or after two passes over the underfull sequences that empty none (`patience`).  The CARRIED emptiest loose sequences of each group are opened again with those of
other groups, level by level until one group is left, so that the waste of all groups together comes
down to that of sequences that no exchange within their group could fill.

Null texts are empty documents (just the separator).  Repeated rows are packed as often as they
occur.  Nothing but lengths and the caller's own columns is shuffled, and no group grows with a key.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.base import durable, pick, slices, strings
from gneiss.llm.bpe import text_encoder

GROUP = 2000  # pieces dealt to a group
CARRIED = 16  # sequences that a group hands on
OPENED = 128  # sequences of other groups that are opened together


def pieces(df: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit) of each piece of
    each document's ids, which end with the separator."""
    rows = pick(df, doc_id=id_column, text=text_column)

    def run(batches):
        to_ids = text_encoder(path, False)
        for batch in slices(batches, "text"):
            ids, offset = to_ids(strings(batch, "text"))
            size = np.diff(offset) + 1
            last = np.cumsum(size)
            flat = np.full(last[-1], separator, dtype="<u4")
            body = np.ones(len(flat), bool)
            body[last - 1] = False
            flat[body] = ids
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blob], names=["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def first_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: in the order given, the first with room."""
    bins, room, used = np.zeros(len(lengths), np.int64), np.full(len(lengths), capacity, np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        b = int(np.argmax(room[: used + 1] >= n))  # the bin behind the last is empty
        used = max(used, b + 1)
        bins[i] = b
        room[b] -= n
    return bins


def improve(bins: np.ndarray, lengths: np.ndarray, capacity: int, patience: int = 2) -> int:
    """Local search over the underfull bins, in place; the number of exchanges made.

    The giver is the emptiest bin that has not failed since the last exchange; bins of the same
    lengths as one that failed are not tried again.  Each exchange takes tokens from a bin to one at
    least as full, so the sum of squared fills rises and the search ends."""
    if not len(bins):
        return 0
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    left, made = int(np.count_nonzero(fill)), 0
    nothing = np.arange(len(fill))  # every bin also offers nothing in exchange
    offer, owner = np.concatenate([lengths, np.zeros(len(fill), np.int64)]), np.concatenate([bins, nothing])
    failed: set[bytes] = set()
    tried = np.zeros(len(fill), bool)
    idle, emptied, before = 0, 0, 0  # passes without an emptied bin; bins emptied and exchanges made before this pass
    while left > least:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity) & ~tried)
        if not len(open_bins):  # a pass is over
            idle = 0 if emptied else idle + 1
            if made == before or idle >= patience:
                break
            emptied, before = 0, made
            failed.clear()
            tried[:] = False
            continue
        giver = int(open_bins[np.argmin(fill[open_bins])])
        mine = np.flatnonzero(bins == giver)
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        name = lengths[mine].tobytes()
        move = None
        if name not in failed:
            move = _exchange(giver, mine, offer, owner, fill, lengths, capacity) or _split(giver, mine, bins, fill, lengths, capacity)
        if move is None:
            failed.add(name)
            tried[giver] = True
            continue
        out, back, taker = move
        bins[out] = owner[out] = taker
        bins[back] = owner[back] = giver
        gain = int(lengths[out].sum() - lengths[back].sum())
        fill[taker] += gain
        fill[giver] -= gain
        if not fill[giver]:
            left, emptied = left - 1, emptied + 1
        made += 1
    return made


def _exchange(giver: int, mine: np.ndarray, offer: np.ndarray, owner: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int], int] | None:
    """The exchange that raises the squared fills most: items to give (one or two), those that come
    back (one or none) and the taker; None if no exchange raises them."""
    own = lengths[mine]
    one, at = np.unique(own, return_index=True)
    i, j = np.triu_indices(len(own), 1)
    give, which = np.unique(np.concatenate([one, own[i] + own[j]]), return_index=True)  # ties: a single item
    taken = fill[owner]
    here = np.flatnonzero((taken > 0) & (taken < capacity) & (owner != giver) & (taken >= fill[giver]))
    if not len(here):
        return None
    best = np.searchsorted(give, offer[here] + capacity - taken[here], side="right") - 1
    gain = np.where(best >= 0, give[best], 0) - offer[here]
    rise = np.where(gain > 0, gain * (taken[here] - fill[giver] + gain), 0)
    k = int(np.argmax(rise))
    if rise[k] <= 0:
        return None
    pick_ = int(which[best[k]])
    out = [int(mine[at[pick_]])] if pick_ < len(one) else [int(mine[i[pick_ - len(one)]]), int(mine[j[pick_ - len(one)]])]
    back = int(here[k])
    return out, [back] if back < len(lengths) else [], int(owner[back])


def _split(giver: int, mine: np.ndarray, bins: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int], int] | None:
    """An exchange of one item for two smaller ones of another bin, full ones included, that takes as
    much as there is room for.  The fills may stay as they are: then the giver's tokens are in smaller
    pieces, which fit in more places, and a piece more is in an underfull bin, so this ends as well."""
    order = np.lexsort((lengths, bins))
    order = order[bins[order] != giver]
    size, of = lengths[order], bins[order]
    key = of * (capacity + 1) + size
    for i in mine[::-1]:  # the largest first
        a = int(lengths[i])
        if i != mine[-1] and a == lengths[mine[-1]]:
            continue
        lowest = a - (capacity - fill[of]) - size  # what must come back with each item, at least
        at = np.searchsorted(key, of * (capacity + 1) + np.maximum(lowest, 0))
        at += at == np.arange(len(order))  # not the item itself
        at = np.minimum(at, len(order) - 1)
        total = size + size[at]
        fits = (of[at] == of) & (at != np.arange(len(order))) & (total <= a) & (total >= lowest + size) & (fill[of] >= fill[giver])
        if fits.any():
            k = int(np.argmax(np.where(fits, (a - total) * (capacity + 1.0) + np.minimum(size, size[at]), -1)))
            return [int(i)], [int(order[k]), int(order[at[k]])], int(of[k])
    return None


def pack(df: DataFrame, capacity: int = 2048, length_column: str = "length", group: int = GROUP, carried: int = CARRIED) -> DataFrame:
    """df with sequence_id and offset: rows of a sequence lie gapless from 0 and hold at most
    `capacity` tokens.  Lengths must be 1 to capacity.  Existing columns of these names are replaced."""
    keep = df.drop("sequence_id", "offset", *_OWN)
    todo = durable(keep.withColumn(_ROW, F.monotonically_increasing_id()))
    unit, groups, level = F.col(_ROW), max(1, math.ceil(todo.count() / group)), 0
    done = []
    while True:
        packed = durable(_pack_level(todo, length_column, capacity, unit, groups, level, carried if groups > 1 else 0))
        done.append(packed.filter(~F.col(_LOOSE)).drop(*_OWN))
        if groups == 1:
            break
        todo = packed.filter(_LOOSE)
        groups = math.ceil(todo.select("sequence_id").distinct().count() / max(OPENED, 8 * carried))
        if groups == 0:
            break
        unit, level = F.col("sequence_id"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


_ROW, _DEAL, _LOOSE = _OWN = ("__pack_row", "__pack_deal", "__pack_loose")


def _pack_level(rows: DataFrame, length_column: str, capacity: int, unit: Column, groups: int, level: int, carried: int) -> DataFrame:
    dealt = rows.withColumn(_DEAL, F.pmod(F.xxhash64(unit, F.lit(level)), F.lit(groups))).drop("sequence_id", "offset", _LOOSE)
    fields = [f for f in dealt.schema.fields if f.name != _DEAL]
    fields += [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(_LOOSE, T.BooleanType())]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns=_DEAL).sort_values(_ROW, ignore_index=True)
        lengths = part[length_column].to_numpy(np.int64)
        bins = first_fit(lengths, capacity)
        improve(bins, lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.zeros(len(part), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, weights=lengths)
        loose = np.flatnonzero((fill > 0) & (fill <= capacity - max(1, capacity // 64)))
        loose = loose[np.argsort(fill[loose], kind="stable")][:carried]
        return part.assign(**{"sequence_id": (level << 58) + (int(key[0]) << 24) + bins, "offset": offset, _LOOSE: np.isin(bins, loose)})

    return dealt.groupBy(_DEAL).applyInPandas(run, T.StructType(fields))
