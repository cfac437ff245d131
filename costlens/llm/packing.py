"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become token ids (with an end id after each) and only those longer than
a sequence are cut: into full pieces, which are sequences of their own, and a
first piece with the rest.  The pieces that fill no sequence are bin packing:

* every piece goes to the fullest bin that has room for it, longest pieces first;
* then underfull bins exchange pieces, the emptiest bin first.  A bin gives one
  or two pieces and gets back none, one or two (at most three change places:
  moves, one-for-one, two-for-one).  An exchange is made if it raises the sum
  of the squared fills, the best one first; full bins leave the search and
  emptied ones disappear.  It ends when no exchange is left or after ``PASSES``
  rounds over the bins, among at most ``NEIGHBOURS`` bins at a time.

A task packs the documents of its own partition in windows, without a shuffle.
The emptiest bins of a window go on to the next one, and the emptiest ones of
a task (``OPEN_BINS``) are packed again together with those of ``FAN_IN`` other
tasks, level by level, until one block is left: a block never holds more than
``FAN_IN * OPEN_BINS`` sequences, and the rows that move between tasks are few.
Each level is checkpointed, so a lost executor repeats only its own part.

The ids are those of the ``tokenizers`` file of the same vocabulary (tested);
tiktoken finds them several times faster.

Edge cases: a null text counts as empty, an empty document is the end id alone;
any length is tokenized whole; repeated rows are packed as rows of their own;
rows without an id are packed as well; ties between bins go to the lower number;
other columns are never read; no rows give no rows.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, ship

#: Tokens of a sequence, and the id put after every document.
CAPACITY, END_ID = 1024, 2

#: Pieces packed at a time, bins of a block that are packed again, blocks packed together.
WINDOW, OPEN_BINS, FAN_IN = 32_768, 64, 64

#: Bins that exchange pieces with each other at a time, and rounds over them.
NEIGHBOURS, PASSES = 512, 3

#: Marks a place without a set of pieces in the table of exchanges.
ABSENT = 1 << 30


# -- bins --------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of places in ``sizes``): longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: there is a bin with room r
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, len(bins)
            bins.append([])
        bins[bin_].append(at)
        if room > size:
            by_room[room - size].append(bin_)
            rooms |= 1 << (room - size)
    return bins


def _sets(sizes: list[int]) -> list[tuple[int, ...]]:
    """No piece, one or two pieces of a bin, as sizes; equal sizes count once."""
    distinct = sorted(set(sizes))
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:]]
    return [()] + [(a,) for a in distinct] + pairs + [(a, a) for a in distinct if sizes.count(a) > 1]


class LocalSearch:
    """Exchanges between bins, given as lists of sizes; :attr:`contents` holds the result."""

    def __init__(self, contents: list[list[int]], capacity: int):
        self.capacity = capacity
        self.contents = contents
        self.fill = np.array([sum(c) for c in contents], dtype=np.int64)
        self.sets: list[list[tuple[int, ...]]] = [[] for _ in contents]
        self.sums = np.full((len(contents), 1), ABSENT, dtype=np.int64)
        self.counts = np.zeros((len(contents), 1), dtype=np.int8)
        for bin_ in range(len(contents)):
            self._describe(bin_)

    def _describe(self, bin_: int) -> None:
        """Write the sets of pieces that a bin can give back into its row of the table."""
        sets = self.sets[bin_] = _sets(self.contents[bin_])
        missing = len(sets) - self.sums.shape[1]
        if missing > 0:
            self.sums = np.pad(self.sums, ((0, 0), (0, missing)), constant_values=ABSENT)
            self.counts = np.pad(self.counts, ((0, 0), (0, missing)))
        self.sums[bin_] = ABSENT
        self.sums[bin_, : len(sets)] = [sum(x) for x in sets]
        self.counts[bin_, : len(sets)] = [len(x) for x in sets]

    def best(self, giver: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange of ``giver`` that raises the squared fill most: receiver, pieces given, pieces returned."""
        own = self.fill[giver]
        room = np.where((self.fill > 0) & (self.fill < self.capacity), self.capacity - self.fill, 0)
        room[giver] = 0
        top, found = 0, None
        for given in self.sets[giver][1:]:
            more = sum(given) - self.sums
            fits = (more > 0) & (more <= room[:, None]) & (self.counts <= 3 - len(given))
            gain = np.where(fits, more * (self.fill[:, None] - own + more), 0)
            at = int(gain.argmax())
            if gain.flat[at] > top:
                top = gain.flat[at]
                receiver, place = divmod(at, gain.shape[1])
                found = (receiver, given, self.sets[receiver][place])
        return found

    def exchange(self, giver: int, receiver: int, given: tuple[int, ...], returned: tuple[int, ...]) -> None:
        for source, target, sizes in ((giver, receiver, given), (receiver, giver, returned)):
            for size in sizes:
                self.contents[source].remove(size)
                self.contents[target].append(size)
                self.fill[source] -= size
                self.fill[target] += size
        self._describe(giver)
        self._describe(receiver)

    def run(self, passes: int = PASSES) -> None:
        for _ in range(passes):
            changed = False
            for giver in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[giver] < self.capacity and (step := self.best(giver)):
                    self.exchange(giver, *step)
                    changed = True
            if not changed:
                return


def pack(sizes: np.ndarray, capacity: int = CAPACITY, neighbours: int = NEIGHBOURS) -> list[list[int]]:
    """Bins of places in ``sizes`` (each 1 to ``capacity``): best fit, then local search, emptiest bin first."""
    bins = best_fit(sizes, capacity)
    fill = [int(sizes[b].sum()) for b in bins]
    done = [b for b, f in zip(bins, fill) if f == capacity]
    # groups mix empty and nearly full bins, so that each has givers and receivers
    underfull = sorted((i for i, f in enumerate(fill) if f < capacity), key=lambda i: (fill[i], i))
    groups = -(-len(underfull) // neighbours)
    for g in range(groups):
        members = underfull[g::groups]
        places: dict[int, list[int]] = defaultdict(list)
        for i in members:
            for at in bins[i]:
                places[int(sizes[at])].append(at)
        search = LocalSearch([sizes[bins[i]].tolist() for i in members], capacity)
        search.run()
        done += [[places[s].pop() for s in content] for content in search.contents if content]
    return sorted(done, key=lambda b: (-int(sizes[b].sum()), b))


# -- tokens ------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    """One encoder per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def token_ids(text: str | None, coder: tiktoken.Encoding, end_id: int = END_ID) -> np.ndarray:
    """Ids of a whole text and the end id; strings of special tokens become these tokens."""
    text = text or ""
    allowed = "all" if any(s in text for s in coder.special_tokens_set) else set()
    ids = coder.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    return np.append(ids, end_id).astype("<u4")


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens begin: the first one takes what is left beside full pieces."""
    return [0] if n <= capacity else [*([0] if n % capacity else []), *range(n % capacity, n, capacity)]


# -- tasks -------------------------------------------------------------------------------

_PLACED = "sequence_id bigint, offset bigint, block bigint, open boolean"


class _Packer:
    """Pieces of one block in windows: rows are any tuples, packed by their sizes.

    ``put`` returns the placed rows of a full window, ``end`` the rest.  Placed rows
    carry sequence, offset, block and whether their bin is to be packed again.
    """

    def __init__(self, level: int, block: int, capacity: int, window: int, open_bins: int):
        self.base, self.block = (level << 58) + (block << 26), block
        self.capacity, self.window, self.open_bins = capacity, window, open_bins
        self.rows: list[tuple] = []
        self.sizes: list[int] = []
        self.used = 0

    def _placed(self, members: list[int], open_: bool) -> list[tuple]:
        out, offset = [], 0
        for at in members:
            out.append((*self.rows[at], self.base + self.used, offset, self.block, open_))
            offset += self.sizes[at]
        self.used += 1
        return out

    def _flush(self, last: bool) -> list[tuple]:
        sizes = np.array(self.sizes, dtype=np.int64)
        bins = pack(sizes, self.capacity)  # fullest first
        fills = [int(sizes[b].sum()) for b in bins]
        full = sum(f == self.capacity for f in fills)
        closed = max(full, len(bins) - self.open_bins)
        placed = [row for b in bins[:closed] for row in self._placed(b, False)]
        if last:
            return placed + [row for b in bins[closed:] for row in self._placed(b, True)]
        kept = [at for b in bins[closed:] for at in b]
        self.rows, self.sizes = [self.rows[at] for at in kept], [self.sizes[at] for at in kept]
        return placed

    def put(self, row: tuple, size: int) -> list[tuple]:
        self.rows.append(row)
        self.sizes.append(size)
        return self._flush(False) if len(self.rows) >= self.window else []

    def end(self) -> list[tuple]:
        return self._flush(True) if self.rows else []


def pack_documents(docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                   window: int = WINDOW, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece of every document of ``docs``.

    Columns ``doc_id``, ``piece`` (from 0), ``start`` (ids before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), with ``with_ids``
    also ``ids`` (``array<int>``), ``sequence_id`` (unique, with gaps) and ``offset`` (place in
    the sequence).  ``path`` and ``pattern`` are a tiktoken file of ranks and its split pattern.
    """
    ship(docs.sparkSession)
    specials = tuple((special or {}).items())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in f"{own}, {_PLACED}".split(", ")]

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern, specials)
        packer = _Packer(0, TaskContext.get().partitionId(), capacity, window, open_bins)
        types = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                              *([pa.list_(pa.int32())] if with_ids else []), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), coder, end_id)
                starts = cuts(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    part = ids[a:b]
                    row = (doc_id, piece, a, b - a, crc32(part.tobytes()), *([part.astype("<i4")] if with_ids else []))
                    out += packer.put(row, b - a)
            if out:
                yield batch_of(out)
        rest = packer.end()
        if rest:
            yield batch_of(rest)

    def next_level(level: int):
        def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["sequence_id", "offset"], kind="stable")
            packer = _Packer(level, int(key[0]), capacity, len(rows) + 1, open_bins)
            plain = rows[names[: names.index("sequence_id")]].astype(object)
            for row in plain.where(plain.notna(), None).itertuples(index=False, name=None):
                packer.put(row, int(row[3]))
            return pd.DataFrame(packer.end(), columns=names)
        return packed

    done = shared(docs.select("doc_id", "text").mapInArrow(first_level, f"{own}, {_PLACED}"))
    result, level = None, 0
    while True:
        top = done.agg(F.max("block")).first()[0]
        closed = done if not top else done.where(~F.col("open"))
        result = closed if result is None else result.unionByName(closed)
        if not top:  # one block is left
            break
        level += 1
        again = done.where("open").withColumn("block", F.floor(F.col("block") / fan_in))
        done = shared(again.groupBy("block").applyInPandas(next_level(level), f"{own}, {_PLACED}"))
    return result.drop("block", "open")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ``ids`` of each sequence; ``packed`` comes from :func:`pack_documents` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
