"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by a pretoken pattern and every match is encoded separately.
The leaves of a segment tree stand for the byte positions of a pretoken; the
leaf of a live token holds ``rank * width + position`` of the pair it forms with
its right neighbour, or a value above all if that pair is no token.  Every inner
node keeps the minimum of its two children, so the root is the pair of lowest
rank and, among equal ranks, the leftmost one.  A merge changes three leaves
(the merged token, its left neighbour, the token that disappears) and the
logarithmic paths above them.

Distinct pretokens of a batch are encoded together: their trees are the rows of
one numpy matrix per width and all rows do one merge per step.  Wide pretokens,
of which a batch has few, use the same tree over a flat list.  Nothing but
tiktoken's file of ranks is needed; the result equals ``encode_ordinary``.

Workers keep the ids of units they have met.  That memory is bounded by bytes, in
two generations (what is met again moves to the young one, so frequent units
outlive rare ones), and it ends with the task.

Edge cases: a null text counts as empty and gives no ids; an empty text gives an
empty list; any length is encoded whole; repeated rows give repeated results;
columns other than the text and those asked for are never read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bytes of one generation of a memory of units; a worker has two memories of two generations each.
MEMORY_BYTES = 24_000_000

#: Bytes of an entry besides its characters and ids, and characters of the longest unit worth keeping.
ENTRY_BYTES, LONG_UNIT = 190, 32

#: Characters of text encoded at a time.
GROUP_CHARS = 1_000_000

#: Cells (rows times width) of one matrix of trees: bounds the memory of a step.
CELLS = 1 << 18

#: Pretokens of a width that make a matrix worthwhile; fewer are encoded one by one.
FEW = 24

#: Marks that the pattern takes as a match of their own after letters.
MARKS = frozenset(".,;:!?")

#: Two white-space characters in a row; splits at single spaces between others.
DOUBLE_SPACE = re.compile(r"\s\s").search
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)").split

NONE = np.int64(1) << np.int64(62)


class Memory:
    """Ids of units met before, in two generations of at most about ``limit`` bytes each."""

    def __init__(self, limit: int = MEMORY_BYTES):
        self.limit, self.size = limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def missing(self, units: set[str]) -> list[str]:
        """The units without ids; those that only the old generation has are young again."""
        new = units.difference(self.young)
        known = new.intersection(self.old)
        if known:
            self.put(list(known), list(map(self.old.__getitem__, known)))
            new -= known
        return list(new)

    def put(self, units: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(units, ids))
        self.size += sum(map(len, units)) + sum(map(len, ids)) + ENTRY_BYTES * len(units)
        self.long += [u for u in units if len(u) > LONG_UNIT]

    def turn(self) -> None:
        """Called when nothing is looked up: long units go, a full young generation becomes the old one."""
        for unit in self.long:
            self.size -= len(unit) + len(self.young.pop(unit)) + ENTRY_BYTES
        self.long = []
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0


class ByteBPE:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token_size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_size[rank] = len(token)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8)
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[(left << 32) | right] = rank
        keys = np.fromiter(self.pair, dtype=np.int64, count=len(self.pair))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_ranks = np.append(np.fromiter(self.pair.values(), dtype=np.int64, count=len(self.pair))[order], -1)
        self.forget()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        return cls(ranks, pattern)

    # -- one pretoken -----------------------------------------------------

    def encode_one(self, piece: bytes) -> list[int]:
        """Ids of one pretoken, by a segment tree in a flat list."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        tok = [int(self.byte_rank[b]) for b in piece]
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        pair = self.pair.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pair((tok[i] << 32) | tok[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(pos: int, value: int) -> None:
            node = width + pos
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, pos = divmod(tree[1], width)
            gone = right[pos]
            after = right[gone]
            tok[pos] = rank
            right[pos] = after
            put(gone, none)
            if after < n:
                left[after] = pos
                merged = pair((rank << 32) | tok[after])
                put(pos, none if merged is None else merged * width + pos)
            else:
                put(pos, none)
            before = left[pos]
            if before >= 0:
                merged = pair((tok[before] << 32) | rank)
                put(before, none if merged is None else merged * width + before)
        out, pos = [], 0
        while pos < n:
            out.append(tok[pos])
            pos = right[pos]
        return out

    # -- many pretokens of one width ---------------------------------------

    def _pair_values(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray, width: int) -> np.ndarray:
        keys = (a << 32) | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at] * width + pos, NONE)

    def _encode_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pretokens of at most ``width`` bytes: one tree per row, one merge per row and step.

        All matrices are flat; ``base`` and ``root`` are where the rows of tokens and trees begin.
        """
        rows, wide = len(pieces), width + 1
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(rows, width)
        cols = np.arange(width)
        grid = np.zeros((rows, wide), dtype=np.int64)
        grid[:, :width] = self.byte_rank[raw]
        forest = np.full((rows, 2 * width), NONE, dtype=np.int64)
        values = self._pair_values(grid[:, : width - 1], grid[:, 1:width], cols[: width - 1], width)
        forest[:, width : 2 * width - 1] = np.where(cols[: width - 1] < length[:, None] - 1, values, NONE)
        at = width
        while at > 1:
            forest[:, at // 2 : at] = np.minimum(forest[:, at : 2 * at : 2], forest[:, at + 1 : 2 * at : 2])
            at //= 2
        tok, tree = grid.ravel(), forest.ravel()
        right = np.tile(np.arange(1, wide + 1), rows)
        left = np.tile(np.arange(-1, width), rows)
        levels, shift = width.bit_length() - 1, np.int64(width.bit_length() - 1)
        live = np.arange(rows)
        while True:
            top = tree[live * (2 * width) + 1]
            more = top < NONE
            live, top = live[more], top[more]
            if not live.size:
                break
            base, root = live * wide, live * (2 * width)
            rank, pos = top >> shift, top & (width - 1)
            here = base + pos
            gone = right[here]
            after = right[base + gone]
            tok[here] = rank
            right[here] = after
            beyond = base + np.minimum(after, width)
            left[beyond] = pos
            value = self._pair_values(rank, tok[beyond], pos, width)
            value[after >= length[live]] = NONE
            before = left[here]
            has = np.flatnonzero(before >= 0)
            where = before[has]
            tree[root + width + gone] = NONE
            tree[root + width + pos] = value
            tree[root[has] + width + where] = self._pair_values(tok[base[has] + where], rank[has], where, width)
            starts = np.concatenate([root, root, root[has]])
            nodes = np.concatenate([pos, gone, where]) + width
            for _ in range(levels):
                nodes >>= 1
                low = starts + 2 * nodes
                tree[starts + nodes] = np.minimum(tree[low], tree[low + 1])
        alive = np.zeros(rows * wide, dtype=bool)
        at_pos, walk = np.zeros(rows, dtype=np.int64), np.arange(rows)
        while walk.size:
            here = walk * wide + at_pos
            alive[here] = True
            at_pos = right[here]
            more = at_pos < length[walk]
            walk, at_pos = walk[more], at_pos[more]
        flat = tok[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.reshape(rows, wide).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of many distinct pretokens, little-endian 32 bits each."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = CELLS // width
            for start in range(0, len(members), max(step, 1)):
                part = members[start : start + max(step, 1)]
                if len(part) < FEW:
                    coded = [np.array(self.encode_one(pieces[i]), dtype="<u4").tobytes() for i in part]
                else:
                    coded = self._encode_matrix([pieces[i] for i in part], width)
                for i, x in zip(part, coded):
                    out[i] = x
        return out

    # -- texts -------------------------------------------------------------

    def forget(self) -> None:
        """Empty the memories of units (with the space before them) and of pretokens."""
        self.units, self.pieces = Memory(), Memory()

    def _encode_units(self, units: list[str], lead: str) -> list[bytes]:
        """Ids of ``lead + unit`` of each unit."""
        split = []
        for unit in units:
            if unit.isalpha():  # letters only: one match of the pattern
                split.append((lead + unit,))
            elif unit[-1] in MARKS and unit[:-1].isalpha():  # and a mark: two
                split.append((lead + unit[:-1], unit[-1]))
            else:
                split.append(self.split(lead + unit))
        new = self.pieces.missing(set(chain.from_iterable(split)))
        self.pieces.put(new, self.encode_pieces([p.encode("utf-8") for p in new]))
        ids = self.pieces.young
        return [ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts]) for parts in split]

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, little-endian 32 bits each.

        No pretoken goes on over a space between two characters that are no
        white space, so a text falls into units at such spaces, and the ids of
        a unit (with the space before it, but for the first) depend on nothing
        around it.  Units seen before come from the worker's memory.
        """
        units = [(t.split(" ") if DOUBLE_SPACE(t) is None and t[0] > " " < t[-1] else SINGLE_SPACE(t)) if t else []
                 for t in texts]
        firsts = list({u[0] for u in units if u})
        first = dict(zip(firsts, self._encode_units(firsts, "")))
        new = self.units.missing(set(chain.from_iterable(u[1:] for u in units)))
        self.units.put(new, self._encode_units(new, " "))
        inner = self.units.young.__getitem__
        coded = [first[u[0]] + b"".join(map(inner, u[1:])) if u else b"" for u in units]
        self.units.turn()
        self.pieces.turn()
        return coded

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that a list of ids stands for."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        # place of every byte: where its token's bytes are, and how far into the token it is
        shift = self.token_start[ids] - (ends - size)
        return self.token_bytes[np.repeat(shift, size) + np.arange(ends[-1])].tobytes() if len(ends) else b""


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One encoder per Python worker, file and pattern."""
    return ByteBPE.from_file(path, pattern)


def _groups(texts: list[str | None], chars: int = GROUP_CHARS):
    """Ends of consecutive groups of texts with about ``chars`` characters each."""
    size = 0
    for end, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= chars or end == len(texts):
            yield end
            size = 0


#: What :func:`tokenize` can return for a row: Spark type, Arrow type.
OUTPUTS = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("bigint", pa.int64()),
           "ids_sha256": ("string", pa.string()), "decoded": ("binary", pa.binary()),
           "decoded_sha256": ("string", pa.string())}


def _values(name: str, coded: list[bytes], decoded: list[bytes]) -> pa.Array:
    if name == "ids":
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4"), pa.int32()))
    if name == "n_tokens":
        return pa.array([len(x) // 4 for x in coded], pa.int64())
    if name == "decoded":
        return pa.array(decoded, pa.binary())
    return pa.array([sha256(x).hexdigest() for x in (coded if name == "ids_sha256" else decoded)], pa.string())


def tokenize(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded"),
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and the ``outputs`` of its text, all from one pass.

    ``ids`` are the token ids (null text: none), ``decoded`` the bytes that the ids
    decode to, the others their number and SHA-256 digests (lowercase hex; ids as
    little-endian unsigned 32-bit integers).
    """
    ship(docs.sparkSession)
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(kept + [f"{name} {OUTPUTS[name][0]}" for name in outputs])
    names = [*keep, *outputs]
    back = any(name.startswith("decoded") for name in outputs)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        try:
            for batch in batches:
                texts, start = batch.column(len(keep)).to_pylist(), 0
                for end in _groups(texts):
                    ids = bpe.encode_texts(texts[start:end])
                    raw = [bpe.decode(np.frombuffer(x, dtype="<u4")) for x in ids] if back else []
                    given = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(given + [_values(name, ids, raw) for name in outputs], names)
                    start = end
        finally:
            bpe.forget()

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(coded, schema)
