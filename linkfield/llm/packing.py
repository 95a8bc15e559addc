"""Best-fit packing of token pieces into fixed-length sequences, by swap-based local search."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written
from .tokens import encoder, text_slices, tokenizer_path

#: Pieces in one group of any round (on average), rounds at most, and the share of capacity from which a sequence is
#: final before the last round.
GROUP_PIECES, ROUNDS, FULL = 20_000, 6, 0.995

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, open boolean"


def token_pieces(df: DataFrame, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and its end id, cut every capacity ids."""
    path = tokenizer_path(tokenizer)

    def run(batches):
        enc = encoder(path)
        for ids, texts in text_slices(batches, id_col, text_col):
            out = ([], [], [], [], [])
            for doc, tokens in zip(ids, enc.encode(texts), strict=True):
                data = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(data), capacity)):
                    part = data[a : a + capacity]
                    for column, x in zip(out, (doc, k, a, len(part), zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias(id_col), f"`{text_col}`").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each length, longest first, goes to the bin with the least room that still takes it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            with_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class LocalSearch:
    """Bins of indices that give to fuller ones, each step increasing squared fill, until bins are empty.

    A step moves one document of a bin to one with room, or exchanges one or two of its documents for one shorter
    document there; of all such steps the one with the largest gain for the other bin is taken.  They are found by
    length: among documents of one length, only that in the bin with the most room matters.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.where = np.full(len(lengths), -1)
        self.fill = np.array([int(lengths[b].sum()) for b in bins])
        for k, b in enumerate(bins):
            self.where[b] = k
        self.order = np.argsort(lengths, kind="stable")
        self.sizes, self.first = np.unique(lengths[self.order], return_index=True)

    def step(self, e: int) -> bool:
        """One exchange from bin e to a bin at least as full; False if there is none."""
        room = np.where(self.fill >= max(1, self.fill[e]), self.capacity - self.fill, 0)
        room[e] = 0
        rooms = room[self.where[self.order]]
        # by length of what comes back (0: nothing): the most room of a bin that has it
        back = np.concatenate([[0], self.sizes])
        reach = back + np.concatenate([[room.max()], np.maximum.reduceat(rooms, self.first)])
        reach[np.append(False, reach[1:] == self.sizes)] = 0
        furthest = np.maximum.accumulate(reach)
        mine = self.lengths[self.bins[e]]
        have, count = np.unique(mine, return_counts=True)
        i, j = np.triu_indices(len(have))
        ok = (i != j) | (count[i] > 1)
        i, j = np.concatenate([np.arange(len(have)), i[ok]]), np.concatenate([np.full(len(have), -1), j[ok]])
        given = have[i] + np.where(j < 0, 0, have[j])
        at = np.minimum(np.searchsorted(furthest, given), len(back) - 1)
        gain = np.where((reach[at] >= given) & (back[at] < given) & ((at > 0) | (j < 0)), given - back[at], 0)
        k = int(gain.argmax())
        if not gain[k]:
            return False
        if at[k]:
            a, b = self.first[at[k] - 1], len(self.order) if at[k] == len(self.first) else self.first[at[k]]
            taken = int(self.order[a + int(rooms[a:b].argmax())])
            other = int(self.where[taken])
        else:  # the tightest bin that takes it
            fits = np.flatnonzero(room >= gain[k])
            taken, other = -1, int(fits[room[fits].argmin()])
        for n in have[[i[k]]].tolist() + (have[[j[k]]].tolist() if j[k] >= 0 else []):
            x = next(x for x in self.bins[e] if self.lengths[x] == n)
            self.bins[e].remove(x)
            self.bins[other].append(x)
            self.where[x] = other
        if taken >= 0:
            self.bins[other].remove(taken)
            self.bins[e].append(taken)
            self.where[taken] = e
        self.fill[other] += gain[k]
        self.fill[e] -= gain[k]
        return True

    def run(self) -> list[list[int]]:
        """The bins that are left when their number is the least that the total allows, or no bin has a step."""
        total = int(self.lengths.sum())
        least, left, tried = -(-total // self.capacity), len(self.bins), set()
        while left > least:
            fill = np.where(self.fill > 0, self.fill, self.capacity)
            fill[list(tried)] = self.capacity
            e = int(fill.argmin())
            if fill[e] >= self.capacity:
                break
            moved = False
            while self.bins[e] and self.step(e):
                moved = True
            if not self.bins[e]:
                left -= 1
            if moved:
                tried.clear()
            tried.add(e)
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into lengths (each from 1 to capacity)."""
    return LocalSearch(best_fit_decreasing(lengths, capacity), lengths, capacity).run() if len(lengths) else []


def _placer(capacity: int, level: int, last: bool):
    """Packs one group; sequences get numbers that no other group of any round uses."""

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="group").sort_values(["doc_id", "piece", "salt"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset, full = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for k, b in enumerate(pack(lengths, capacity)):
            sequence[b] = (level << 56) + (int(key[0]) << 24) + k
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
            full[b] = last or lengths[b].sum() >= FULL * capacity
        return rows.assign(sequence_id=sequence, offset=offset, open=~full)

    return place


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (PIECES) with sequence_id and offset.

    Pieces are dealt at random to groups of about group_pieces and packed there; what ends up in sequences that are
    filled to less than FULL is counted, dealt anew and packed again in groups of that size.  Every group is final
    when one group takes the rest, when a round has left more than nine tenths of its pieces, or after ROUNDS rounds;
    so no task holds more than about group_pieces.  Equal rows (copies of a document) are dealt apart by their place
    in the written table.
    """
    left = written(pieces, "pieces").withColumn("salt", F.monotonically_increasing_id())
    n, done, level, last = left.count(), None, 0, False
    while True:
        n_groups = max(1, -(-n // group_pieces))
        last = last or n_groups == 1 or level == ROUNDS - 1
        group = F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece", "salt"), F.lit(n_groups))
        placed = written(left.withColumn("group", group).groupBy("group").applyInPandas(_placer(capacity, level, last), PLACED), "placed")
        kept = placed.where("not open").drop("open", "salt")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        left = placed.where("open").drop("open", "sequence_id", "offset")
        before, n, level = n, left.count(), level + 1
        if not n:
            return done
        last = 10 * n > 9 * before


def pack_documents(df: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id, so null and empty texts are one piece of one id.  Only documents of more
    than capacity ids are cut, every capacity ids.  Rows that repeat a document are packed each.  Other columns of df
    are left aside; an empty table gives no rows.
    """
    return pack_pieces(token_pieces(df, capacity, end_id, tokenizer=tokenizer, **columns), capacity)
