"""Operator 8, best-fit packing of token sequences.

1. Tokenise: each text becomes its ids and an end id. A document longer than ``capacity`` is cut from its end into
   full pieces, so its first piece may be shorter. Texts are cut at spaces where the tokenizer's pattern always starts
   anew; the parts are told apart by Arrow's dictionary encoding, only parts that a worker doesn't remember reach the
   tokenizer, and ids are put together as arrays, so no Python object is made per word of a text.
2. Pieces longer than half a sequence open one each. The others are placed in bulk-synchronous rounds over one table of
   pieces left and of open sequences with their gaps:
   a. pieces and gaps are range-sorted by size, longest first, into ranges of about ``ROWS`` rows; a histogram of sizes (at most two
      numbers per length up to the capacity) tells the ranges, and ties are dealt by a hash, so a hot length spreads over ranges;
   b. each range is swept by a task: gaps go on a stack, a piece takes the top one, its successor, the smallest gap that
      holds it and is free. A gap is offered as often as it holds the longest piece left (``SLOTS`` at most);
   c. what a range couldn't match sweeps on to the ranges of larger gaps: the ranges' counts (two numbers each) tell which
      ranks of whose leftovers belong together, and the leftovers are joined on that rank;
   d. conflicts are so resolved by rank: who comes first in the order has the gap, the others wait. The gaps are updated.
   Pieces longer than every gap, and longer than half of the longest, open sequences, each range packed by itself; so do those longer
   than half of the longest when there are gaps for fewer than one in ``FEW`` of them. What fits one range is
   finished by its task, best-fit decreasing.
3. Offsets are running sums inside each sequence, which holds ``capacity`` pieces at most.

Rounds repeat until all is placed; their number grows with the logarithm of the input. All state is in tables of the shared folder.

Defined cases: a null text is empty and gives the end id alone; an empty table gives no rows; a document id may be
null (as are those that aren't whole numbers) or repeat, as each row is packed for itself; a very long text is cut like any other; which of two equally long
pieces goes where is arbitrary; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.columns import pick, whole
from siltstone.llm import bytescan as bs
from siltstone.scratch import Scratch

CAPACITY, END_ID = 1024, 2
#: Distinct parts that a Python worker remembers (about 200 bytes each), and the longest it does. Results don't depend on them.
MEMO_WORDS, MEMO_BYTES = 120_000, 64
SLICE_BYTES, JOIN_BYTES = 1 << 20, 1 << 15
#: Rows of a range, on average; pieces that a gap takes in one round at most; see above.
ROWS, SLOTS, FEW = 100_000, 64, 8
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes that may end, or begin, a white-space character before or after a space; too many are harmless, too few aren't.
MAY_END, MAY_BEGIN = np.zeros(256, bool), np.zeros(256, bool)
MAY_END[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
MAY_BEGIN[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Classes of ASCII bytes; 0 for white space and bytes of other characters.
LETTER, DIGIT, MARK = 1, 2, 3
CLASS = np.zeros(256, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[[*range(0x30, 0x3A)]] = DIGIT
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER


def part_starts(data: np.ndarray, offs: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where parts begin: places where the tokenizer's pattern always begins a new match, whatever the rest of the text is.

    The pattern matches runs of letters, of digits and of other characters, each with one space before it, white space up to the
    last space before such a run, and an apostrophe with the letters of a contraction; it looks one character ahead. So a match begins
    at each space that has no white space on one side at least, and between letters, digits and other characters, but after an
    apostrophe. Texts marked ``whole`` stay in one part.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    begins = np.zeros(n + 1, bool)
    kind = CLASS[data]
    begins[1:n] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 0x27)
    ends = np.zeros(n + 1, bool)
    ends[offs] = True
    at = np.flatnonzero(data == 0x20)
    after = ends[at + 1] | MAY_BEGIN[data[np.minimum(at + 1, n - 1)]]
    begins[at[~(MAY_END[data[at - 1]] & after)]] = True
    if whole.any():
        begins[:n] &= ~np.repeat(whole, np.diff(offs))
    begins[offs] = True
    return np.flatnonzero(begins[:n])


class WordMemo:
    """ids of parts of texts. Parts that were seen in several slices stay when the memory is full."""

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder, self.most = Tokenizer.from_file(path), most
        self.model = Tokenizer(self.encoder.model)  # for parts that are one match of the pattern, in the byte-level alphabet
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.added = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        vocab = self.encoder.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a character of the byte-level alphabet is a byte
            self.token_bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.size, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def shrink(self) -> None:
        """Keeps, of the parts of two slices or more, those of most slices, up to half of the memory."""
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[: self.most // 2]])
        words = list(self.known)
        self.pool, (start, size) = _gather(self.pool, self.start[keep], self.size[keep]), (np.cumsum(self.size[keep]) - self.size[keep], self.size[keep])
        self.known, self.start, self.size, self.hits = {words[i]: k for k, i in enumerate(keep.tolist())}, start, size, np.zeros(len(keep), np.int64)

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where the parts' begin and how many each has.

        Parts that begin with a space and hold no other white space are encoded many at a time, as they come in a text: the bytes of the
        tokens tell where each ends. Those of ASCII without apostrophes are one match of the pattern each and go to the model alone.
        """
        data, offs = _bytes(parts)
        size = np.diff(offs)
        fits = np.zeros(len(parts), bool)
        two = np.flatnonzero(size > 1)
        fits[two] = (data[offs[two]] == 0x20) & ~MAY_BEGIN[data[offs[two] + 1]]
        for a in self.added:
            fits &= ~pc.match_substring(parts, a).to_numpy(zero_copy_only=False)
        beyond = np.append(0, np.cumsum((CLASS[data] == 0) | (data == 0x27)))  # white space, other characters, apostrophes
        plain = fits & (beyond[offs[1:]] - beyond[offs[:-1]] == 1)
        found, counts, alone = [np.zeros(0, np.uint32)], np.zeros(len(parts), np.int64), [np.flatnonzero(~fits)]
        order = []
        for chosen, encoder, spaces in ((plain, self.model, " \u0120"), (fits & ~plain, self.encoder, " ")):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            data, offs = _bytes(parts.take(pa.array(at)))
            edges = [0, *(np.flatnonzero(np.diff(offs // JOIN_BYTES)) + 1).tolist()]
            edges = [e for e in edges if e < len(at)] + [len(at)]
            texts = [data[offs[i] : offs[j]].tobytes().decode("utf-8", "replace").replace(" ", spaces) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            for i, j, e in zip(edges[:-1], edges[1:], encoder.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                reached, ends = np.cumsum(self.token_bytes[ids]), offs[i + 1 : j + 1] - offs[i]
                last = np.searchsorted(reached, ends)
                if last[-1] == len(reached) - 1 and (reached[last] == ends).all():
                    found.append(ids)
                    counts[at[i:j]] = np.diff(np.append(-1, last))
                    order.append(at[i:j])
                else:
                    alone.append(at[i:j])
        rest = np.concatenate(alone)
        if len(rest):
            lists = [np.array(e.ids, np.uint32) for e in self.encoder.encode_batch_fast([w.decode("utf-8", "replace") for w in parts.take(pa.array(rest)).to_pylist()], add_special_tokens=False)]
            counts[rest] = [len(x) for x in lists]
            found += lists
            order.append(rest)
        order = np.concatenate([np.zeros(0, np.int64), *order])
        start = np.zeros(len(parts), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found), start, counts

    def lookup(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, start, size): the ids of part i are pool[start[i] : start[i] + size[i]]."""
        if len(self.known) > self.most:
            self.shrink()
        names, get = parts.to_pylist(), self.known.get
        at = np.array([get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(at < 0)
        self.hits[at[at >= 0]] += 1
        ids, start, size = self.encode(parts.take(pa.array(new)))
        starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        old = np.flatnonzero(at >= 0)
        starts[old], sizes[old] = self.start[at[old]], self.size[at[old]]
        starts[new], sizes[new] = len(self.pool) + start, size
        pool = np.concatenate([self.pool, ids])
        # short parts are remembered, with the whole pool; long ones are few
        short = new[np.diff(_bytes(parts)[1])[new] <= MEMO_BYTES]
        self.known.update(zip([names[i] for i in short.tolist()], range(len(self.known), len(self.known) + len(short)), strict=True))
        self.start, self.size, self.hits = np.concatenate([self.start, starts[short]]), np.concatenate([self.size, sizes[short]]), np.concatenate([self.hits, np.ones(len(short), np.int64)])
        self.pool = pool if len(short) == len(new) or not sizes[new].max(initial=0) > MEMO_BYTES else self._compact(pool)
        return pool, starts, sizes

    def _compact(self, pool: np.ndarray) -> np.ndarray:
        out, self.start = _gather(pool, self.start, self.size), np.cumsum(self.size) - self.size
        return out

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice of texts in a row, and each text's first (and the end)."""
        texts = _parts(data, offs)
        whole = np.zeros(len(offs) - 1, bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        starts = part_starts(data, offs, whole)
        parts = _parts(data, np.append(starts, len(data))).dictionary_encode()
        pool, start, size = self.lookup(parts.dictionary)
        code = parts.indices.to_numpy(zero_copy_only=False)
        sizes = size[code]
        ends = np.append(0, np.cumsum(sizes))
        return _gather(pool, start[code], sizes), ends[np.searchsorted(starts, offs)]


def _parts(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = parts.buffers()
    offs = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of each, in a row."""
    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]


@functools.lru_cache(1)
def memo(path: str, most: int) -> WordMemo:
    return WordMemo(path, most)


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of ``n`` ids each, one at least."""
    k = -(-n // capacity)
    head = (n - 1) % capacity + 1
    doc = np.repeat(np.arange(len(n)), k)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    first = piece == 0
    return doc, piece, np.where(first, 0, head[doc] + (piece - 1) * capacity), np.where(first, head[doc], capacity)


def tokenized_pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, memo_words: int = MEMO_WORDS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``uid`` tells rows apart. ``with_ids`` adds the ids themselves."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, offs in bs.slices(*bs.text_bytes(batch.column(1)), SLICE_BYTES):
                found, first = memo(path, memo_words).ids(data, offs)
                found = np.insert(found, first[1:], np.uint32(end_id)).astype("<u4")
                doc, piece, start, length = cut(np.diff(first) + 1, capacity)
                ends = np.cumsum(length)
                view = memoryview(found.tobytes())
                crc = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), length.tolist(), strict=True)]
                columns = [pa.array(uid + np.arange(len(doc))), batch.column(0)[i:j].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                uid += len(doc)
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return pick(docs, doc_id=doc_id, text=text).select(whole(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(bs.trimmed(encode, memo), PIECES + (", ids array<int>" if with_ids else ""))


def decreasing(counts: dict[int, int], capacity: int = CAPACITY, open_gaps: list[tuple[int, int]] = ()) -> dict[str, np.ndarray]:
    """Best-fit decreasing of one task's pieces, given how many there are of each length, and (gap, number) of open sequences.

    Segments (length, rank, n, sequence, offset): ranks rank.. of pieces of that length go to sequences sequence.. at offset.
    Sequences are held as intervals of numbers with equal gaps, sorted by (gap, first); the open ones come first, in the given order.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []
    opened = 0
    for gap, n in open_gaps:
        insort(gaps, (gap, opened, opened + n))
        opened += n
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        at = bisect_left(gaps, (size,))
        taken: list[tuple[int, int, int]] = []
        while left and at + len(taken) < len(gaps):
            gap, a, b = gaps[at + len(taken)]
            taken.append((gap, a, b))
            left, rank = _fill(segments, gaps_out := [], size, gap, a, b, rank, left, capacity)
            taken[-1] = (taken[-1], gaps_out)
        if taken:
            del gaps[at : at + len(taken)]
            for _, rest in taken:
                for g in rest:
                    insort(gaps, g)
        if left:
            need = -(-left // (capacity // size))
            _fill(segments, rest := [], size, capacity, opened, opened + need, rank, left, capacity)
            opened += need
            for g in rest:
                insort(gaps, g)
    columns = np.array(sorted(segments), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "n", "sequence", "offset"), columns, strict=True)) | {"sequences": opened}


def _fill(segments: list, rest: list, size: int, gap: int, a: int, b: int, rank: int, left: int, capacity: int) -> tuple[int, int]:
    """Fills the sequences a..b in turn, each with as many pieces as its gap holds; appends what gaps remain."""
    each, used = gap // size, capacity - gap
    full = min(b - a, left // each)
    for j in range(each if full else 0):
        segments.append((size, rank, full, a, used + j * size))
        rank += full
    left -= full * each
    if full and gap - each * size:
        rest.append((gap - each * size, a, a + full))
    a += full
    if a < b and left:
        for j in range(left):
            segments.append((size, rank + j, 1, a, used + j * size))
        if gap - left * size:
            rest.append((gap - left * size, a, a + 1))
        rank, left, a = rank + left, 0, a + 1
    if a < b:
        rest.append((gap, a, b))
    return left, rank


def sweep(size: np.ndarray, is_piece: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One range, sorted longest first and gaps before pieces of their size; ``slots``: how often a gap is offered.

    Returns (piece, gap) of the matches, as row numbers, and the pieces and the slots (a gap's row per slot) left, in order; of
    the slots left the last is the first to be taken by a later range.
    """
    if not len(size):
        return (np.zeros(0, np.int64),) * 4
    gaps = np.flatnonzero(~is_piece)
    slot = np.repeat(gaps, slots[gaps])
    reach = np.cumsum(np.where(is_piece, 0, slots))  # slots on the stack so far, if none were taken
    edges = np.flatnonzero(np.r_[True, is_piece[1:] != is_piece[:-1]])
    stack: list[list[int]] = []
    matched_pieces, matched_slots, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(size)], strict=True):
        if not is_piece[a]:
            stack.append([int(reach[a] - slots[a]), int(reach[b - 1])])
            continue
        while a < b and stack:
            low, high = stack[-1]
            n = min(b - a, high - low)
            matched_pieces.append(np.arange(a, a + n))
            matched_slots.append(np.arange(high - 1, high - 1 - n, -1))
            a += n
            stack[-1][1] -= n
            if stack[-1][1] == low:
                stack.pop()
        left.append(np.arange(a, b))
    over = np.concatenate([np.zeros(0, np.int64), *[np.arange(low, high) for low, high in stack]])
    return np.concatenate(matched_pieces), slot[np.concatenate(matched_slots)], np.concatenate(left), slot[over]


def meet(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Which leftovers of ranges meet. counts: (range, pieces left, slots left), largest sizes first.

    Segments (range of pieces, first rank, range of slots, end rank, n, number): pieces first.. take the slots below end, downward.
    """
    stack: list[list[int]] = []
    out, number = [], 0
    for part, pieces, slots in counts:
        rank = 0
        while rank < pieces and stack:
            n = min(pieces - rank, stack[-1][1])
            out.append((part, rank, stack[-1][0], stack[-1][1], n, number))
            rank, number = rank + n, number + n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if slots:
            stack.append([part, slots])
    return np.array(out, np.int64).reshape(-1, 6)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    held = list(batches)
    return [np.concatenate([np.zeros(0, np.int64), *[b.column(c).to_numpy() for b in held]]) for c in names]


def fill(size: np.ndarray, ids: np.ndarray, gap: np.ndarray, gap_ids: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of each piece, new sequences, their gaps): all pieces, longest first, into gaps and new sequences; a new one is named by its first piece."""
    order = np.argsort(gap, kind="stable")
    gap, gap_ids = gap[order], gap_ids[order]
    lengths, first, n = np.unique(-size, return_index=True, return_counts=True)
    p = decreasing(dict(zip((-lengths).tolist(), n.tolist(), strict=True)), capacity, [(int(g), int(k)) for g, k in zip(*np.unique(gap, return_counts=True), strict=True)])
    stride = int(n.max(initial=0)) + 1
    key = size * stride + np.arange(len(size)) - np.repeat(first, n)
    own = p["length"] * stride + p["rank"]
    at = np.searchsorted(own, key, side="right") - 1
    sequence = p["sequence"][at] + key - own[at]
    name = np.append(gap_ids, np.zeros(p["sequences"] - len(gap_ids), np.int64))
    new = (p["offset"][at] == 0) & (sequence >= len(gap_ids))
    name[sequence[new]] = ids[new]
    filled = np.bincount(sequence, weights=size, minlength=len(name)).astype(np.int64)
    return name[sequence], name[len(gap_ids) :], capacity - filled[len(gap_ids) :]


def _sweeps(capacity: int, longest: int, opens: int, last: bool):
    """Of one range. Kinds of rows out: 3 a new gap, 2 a match (id: piece, other: sequence), 1 a piece left, 0 a gap left (n slots), each with its rank."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        size, kind, ids = _columns(batches, ["size", "kind", "id"])
        order = np.lexsort((ids, kind, -size))
        size, kind, ids = size[order], kind[order], ids[order]
        piece = kind == 1
        one = np.ones(len(size), np.int64)
        out = []
        if last or part < opens:
            names, new, gaps = fill(size[piece], ids[piece], size[~piece], ids[~piece], capacity)
            out = [(2, np.arange(len(names)), ids[piece], names, size[piece], one[: len(names)]), (3, np.arange(len(new)), new, new, gaps, np.ones(len(new), np.int64))]
        else:
            pieces, taken, left, over = sweep(size, piece, np.clip(size // longest, 1, SLOTS))
            new = np.flatnonzero(np.r_[True, over[1:] != over[:-1]]) if len(over) else np.zeros(0, np.int64)
            out = [
                (2, np.arange(len(pieces)), ids[pieces], ids[taken], size[pieces], one[: len(pieces)]),
                (1, np.arange(len(left)), ids[left], ids[left], size[left], one[: len(left)]),
                (0, new, ids[over[new]], ids[over[new]], size[over[new]], np.diff(np.r_[new, len(over)])),
            ]
        for k, *columns in out:
            m = len(columns[0])
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int64)), pa.array(np.full(m, k, np.int64)), *map(pa.array, columns)], ["part", "kind", "rank", "id", "other", "size", "n"])

    return work


SWEPT = "part long, kind long, rank long, id long, other long, size long, n long"


def _numbered(segments: np.ndarray):
    """Gives the leftovers that meet the same number; pieces that meet no slot get -1."""

    def find(parts: np.ndarray, ranks: np.ndarray, part: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The last segment that begins at or before each (part, rank), or -1."""
        order = np.lexsort((ranks, parts))
        keys = (parts[order] << 40) + ranks[order]
        at = np.searchsorted(keys, (part << 40) + rank, side="right") - 1
        return np.where(at >= 0, order[np.maximum(at, 0)], -1) if len(order) else np.full(len(part), -1)

    s_part, s_rank, g_part, g_end, n, number = segments.T

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, kind, rank, ids, size, many = (batch.column(c).to_numpy() for c in ("part", "kind", "rank", "id", "size", "n"))
            is_gap = np.repeat(kind == 0, many)
            part, ids, size = np.repeat(part, many), np.repeat(ids, many), np.repeat(size, many)
            rank = np.repeat(rank - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            match = np.full(len(part), -1, np.int64)
            if len(segments):
                at = find(s_part, s_rank, part, rank)
                hit = ~is_gap & (at >= 0) & (s_part[at] == part) & (rank < s_rank[at] + n[at])
                match[hit] = number[at[hit]] + rank[hit] - s_rank[at[hit]]
                at = find(g_part, g_end - n, part, rank)
                hit = is_gap & (at >= 0) & (g_part[at] == part) & (rank < g_end[at])
                match[hit] = number[at[hit]] + g_end[at[hit]] - 1 - rank[hit]
            keep = ~is_gap | (match >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (match, is_gap, ids, size)], ["match", "is_gap", "id", "size"])

    return work


def _ranges(rows: DataFrame, classes: list[tuple[int, int, int, int]]) -> DataFrame:
    """Adds ``range``. classes: (kind, size, count, first place); a row's place in its class comes from a hash."""
    known = rows.sparkSession.createDataFrame(classes, "_kind long, _size long, _count long, _first long")  # two per length at most
    part = F.shiftrightunsigned(F.xxhash64("id"), 33).cast("double") / float(1 << 31)
    range_ = F.floor((F.col("_first") + F.floor(part * F.col("_count"))) / ROWS).cast("long")
    return rows.join(F.broadcast(known), (F.col("kind") == F.col("_kind")) & (F.col("size") == F.col("_size"))).select("kind", "size", "id", range_.alias("range"))


def place(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> tuple[list[DataFrame], int]:
    """Tables (uid, sequence_id, length) that place all pieces (uid, length) shorter than ``capacity``, and the number of rounds."""
    short = pieces.where(F.col("length") < capacity).select("uid", "length")
    own = short.where(F.col("length") > capacity // 2)
    placed, rounds = [own.select("uid", F.col("uid").alias("sequence_id"), "length")], 0
    state = own.select(F.lit(0).cast("long").alias("kind"), (capacity - F.col("length")).alias("size"), F.col("uid").alias("id"))
    state = scratch.save(state.unionByName(short.where(F.col("length") <= capacity // 2).select(F.lit(1).cast("long").alias("kind"), F.col("length").alias("size"), F.col("uid").alias("id"))))
    while True:
        found = [tuple(r) for r in state.groupBy("kind", "size").count().collect()]  # two per length at most
        lengths = {s: n for k, s, n in found if k == 1}
        if not lengths:
            return placed, rounds
        rounds += 1
        n, least, longest = sum(lengths.values()), min(lengths), max(lengths)
        gaps = {s: n for k, s, n in found if k == 0 and s >= least}
        last = n + sum(gaps.values()) <= ROWS
        half = longest // 2
        room = sum(k * min(max(s // longest, 1), SLOTS) for s, k in gaps.items() if s > half)
        cutoff = half if room * FEW < sum(k for s, k in lengths.items() if s > half) else max(half, *gaps)
        classes, at, opens = [], 0, 0
        for s in sorted(lengths, reverse=True):
            if s > cutoff and not last:
                classes.append((1, s, lengths[s], at))
                at += lengths[s]
        opens = -(-at // ROWS)
        at = opens * ROWS
        for s, k in sorted([(s, 0) for s in gaps] + [(s, 1) for s in lengths if last or s <= cutoff], key=lambda x: (-x[0], x[1])):
            count = lengths[s] if k else gaps[s]
            classes.append((k, s, count, at))
            at += count
        swept = scratch.save(_ranges(state, classes).groupBy("range").applyInArrow(_sweeps(capacity, longest, opens, last), SWEPT))
        matched = swept.where("kind = 2").select(F.col("id").alias("uid"), F.col("other").alias("sequence_id"), F.col("size").alias("length"), (F.col("part") >= opens).alias("known"))
        if last:
            return [*placed, matched.drop("known")], rounds
        over = swept.where("kind < 2")
        of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
        segments = meet(sorted(tuple(c) for c in over.groupBy("part").agg(of(1), of(0)).collect()))  # a row per range
        numbered = over.mapInArrow(_numbered(segments), "match long, is_gap boolean, id long, size long")
        if len(segments):
            met = numbered.where("match >= 0 and not is_gap").select("match", F.col("id").alias("uid"), F.col("size").alias("length"))
            met = met.join(numbered.where("is_gap").select("match", F.col("id").alias("sequence_id")), "match")
            matched = matched.unionByName(met.select("uid", "sequence_id", "length", F.lit(True).alias("known")))
        placed.append(matched.drop("known"))
        filled = matched.where("known").select(F.col("sequence_id").alias("id"), (-F.col("length")).alias("size"))
        open_ = state.where((F.col("kind") == 0) & (F.col("size") >= least)).select("id", "size").unionByName(filled).groupBy("id").agg(F.sum("size").alias("size"))
        open_ = open_.unionByName(swept.where("kind = 3").select("id", "size")).where("size > 0")
        left = numbered.where("match < 0").select(F.lit(1).cast("long").alias("kind"), "size", "id")
        before, state = state, scratch.save(left.unionByName(open_.select(F.lit(0).cast("long").alias("kind"), "size", "id")))
        scratch.drop(before)


def best_fit(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (uid, length, ...) of 1 to ``capacity`` ids."""
    names = pieces.columns
    placed, _ = place(pieces, scratch, capacity)
    rows = functools.reduce(DataFrame.unionByName, placed)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("uid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity).join(rows, "uid").select(*names, "sequence_id", "offset")
    return short.unionByName(pieces.where(F.col("length") >= capacity).select(*names, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, memo_words: int = MEMO_WORDS, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: sequence and offset, offsets of a sequence gapless from 0; with the piece's ids on demand."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession, "packing")
    return best_fit(scratch.save(tokenized_pieces(docs, path, text, doc_id, capacity, end_id, memo_words, with_ids)), scratch, capacity).drop("uid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
