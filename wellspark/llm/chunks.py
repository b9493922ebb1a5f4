"""Texts in batches for the tokenizing operators: cut into chunks, each distinct chunk encoded once and remembered.

A batch of texts is one buffer of bytes. It is cut where the encodings on both sides cannot touch, Arrow numbers the
distinct chunks, only those not met before go to the encoder (all of a batch in one call), and the ids of the texts are
gathered by number. No chunk becomes a Python object.

What a worker remembers is bounded in bytes: :class:`Memory` drops the half of its chunks that was used longest ago
when it is full; long chunks are never kept. :func:`codec` holds one encoder a worker, so that the memory of an earlier
operator goes when the worker serves another one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # texts handled at once; a longer text is a slice of its own
MEMORY_BYTES = 32 << 20
CALL_BYTES = 1 << 16  # unseen chunks given to a tokenizer at once, as its results take many times their room
LONGEST_KEPT = 200  # bytes of a chunk that is remembered

SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True  # white space to every splitter, within ASCII
ASCII_SPACE = SPACE.copy()
ASCII_SPACE[28:32] = True  # and what only some take for it


@lru_cache(maxsize=1)
def codec(kind, *args):
    """``kind(*args)``, one object a worker."""
    return kind(*args)


def slices(batches, size: int = SLICE_BYTES):
    """Record batches (first column carried, second column text) in slices of about ``size`` bytes; null is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.column(0).slice(at, stop - at), texts.slice(at, stop - at)
            pa.default_memory_pool().release_unused()  # several workers share an executor's memory
            at = stop


def flat(texts: pa.Array, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with ``lead`` in front, and the offsets of the texts in them."""
    if lead:
        texts = pc.binary_join_element_wise(pa.scalar(lead), texts, "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    first = np.frombuffer(texts.buffers()[1], np.int32, 1, 4 * texts.offset)[0]
    return np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1], first), offsets


def starts_unicode_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII starts at the places ``at``."""
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80))


def text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    marks = np.zeros(len(data) + 1, bool)
    marks[offsets] = True
    return marks[:-1]


def before_separators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk starts: every text's start, and each single space or newline between two characters that are no space.

    Byte-level vocabularies split there before merging, and a vocabulary without pieces that hold a space after another
    character, or a newline, cannot join the two sides either.
    """
    begins = text_starts(data, offsets)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~ASCII_SPACE[data[at - 1]] & ~ASCII_SPACE[data[at + 1]] & ~begins[at + 1]]  # a text's last byte: no cut
    odd = data[at + 1] >= 0xC2
    odd[odd] = starts_unicode_space(data, at[odd] + 1)
    begins[at[~odd]] = True
    return np.flatnonzero(begins)


def after_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk starts: every text's start, and each byte behind ASCII white space that is none itself."""
    space = SPACE[data]
    begins = text_starts(data, offsets)
    begins[1:] |= space[:-1] & ~space[1:]
    return np.flatnonzero(begins)


def binaries(data, offsets: np.ndarray) -> pa.Array:
    """An array of byte strings: ``data`` cut at ``offsets``."""
    body = data if isinstance(data, bytes) else np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(body)])


def parts(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of byte strings, and the offsets in them."""
    if not len(rows):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, 8 * rows.offset)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(rows.buffers()[2], np.uint8, size, offsets[0]) if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Memory:
    """Encodings of chunks, learned by ``learn(chunks) -> encodings`` (both arrays of byte strings).

    Two Arrow columns of at most ``budget`` bytes in all; beyond that, the half that was used longest ago goes.
    ``learn`` gets some tens of kilobytes of chunks at a time.
    """

    def __init__(self, learn, budget: int = MEMORY_BYTES):
        self.learn, self.budget, self.clock = learn, budget, 0
        self.keys = self.rows = binaries(b"", np.zeros(1))
        self.used = np.zeros(0, np.int32)  # when each was last asked for

    def __call__(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Encodings, and for each of the (distinct) chunks the number of its encoding."""
        self.clock += 1
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        new = at < 0
        if not new.any():
            self.used[at] = self.clock
            return self.rows, at
        self.used[at[~new]] = self.clock
        unseen = keys.filter(pa.array(new))
        learned = pa.concat_arrays([self.learn(part) for part in calls(unseen)])
        at = np.where(new, len(self.rows) + np.cumsum(new) - 1, at)
        rows = pa.concat_arrays([self.rows, learned])
        short = np.diff(parts(unseen)[1]) <= LONGEST_KEPT
        if short.all():
            self.keys, self.rows = pa.concat_arrays([self.keys, unseen]), rows
        else:
            self.keys = pa.concat_arrays([self.keys, unseen.filter(pa.array(short))])
            self.rows = pa.concat_arrays([self.rows, learned.filter(pa.array(short))])
        self.used = np.append(self.used, np.full(len(self.keys) - len(self.used), self.clock, np.int32))
        if self.keys.nbytes + self.rows.nbytes > self.budget:
            late = np.zeros(len(self.used), bool)
            late[np.argsort(self.used, kind="stable")[len(self.used) // 2 :]] = True
            self.keys, self.rows = self.keys.filter(pa.array(late)), self.rows.filter(pa.array(late))
            self.used = self.used[late]
        return rows, at


def calls(keys: pa.Array):
    """The chunks in consecutive groups of about ``CALL_BYTES``."""
    ends, at = np.cumsum(np.diff(parts(keys)[1])), 0
    while at < len(keys):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CALL_BYTES, "right")))
        yield keys.slice(at, stop - at)
        at = stop


def gather(rows: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbered rows (little-endian uint32) in one array, and each one's offset in it."""
    data, offsets = parts(rows.take(pa.array(numbers)))
    return data.view(np.uint32), offsets // 4


def encoded(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, memory: Memory):
    """The ids of all texts in one array, and the offsets of the texts in it. Chunks reach to the next start."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    found = binaries(data, np.append(starts, len(data))).dictionary_encode()
    rows, at = memory(found.dictionary)
    ids, ends = gather(rows, at[found.indices.to_numpy()])
    return ids, ends[np.searchsorted(starts, offsets)]


def int_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


class ByteLevel:
    """Ids of chunks by a byte-level BPE file of the ``tokenizers`` library.

    All unseen chunks go to the tokenizer as one text where their neighbours cannot change them, and are told apart by
    the number of bytes of each token; the others are encoded by themselves. Strings of special tokens are plain text,
    or with ``as_loaded`` what the file says.
    """

    def __init__(self, path: str, as_loaded: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not as_loaded
        added = self.tokenizer.get_added_tokens_decoder()
        # none holds a space or newline, so that none spans two chunks
        self.alone = [t.content.encode() for t in added.values() if as_loaded or not t.special]
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.n_bytes = np.array([len(added[i].content.encode()) if i in added else len(n)
                                 for i, n in enumerate(names)], np.int64)
        self.memory = Memory(self.learn)

    def whole(self, text: str) -> np.ndarray:
        [found] = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without offsets
        return np.array(found.ids, np.uint32)

    def joins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which chunks may stand between others: opened by a space, ending in none, and without special texts."""
        first, last = data[offsets[:-1]], data[offsets[1:] - 1]
        some = ((first == 32) | (first == 10)) & ~ASCII_SPACE[last] & (np.diff(offsets) <= 1000)
        wide = np.flatnonzero(some & (last >= 128))
        ends = offsets[wide + 1]
        some[wide] = ~(starts_unicode_space(data, ends - 2) | starts_unicode_space(data, ends - 3))
        body = data.tobytes()
        for special in self.alone:
            at = body.find(special)
            while at >= 0:
                some[np.searchsorted(offsets, at, "right") - 1] = False
                at = body.find(special, at + 1)
        return some

    def learn(self, keys: pa.Array) -> pa.Array:
        data, offsets = parts(keys)
        some = self.joins(data, offsets)
        found, lengths = [], np.zeros(len(keys), np.int64)
        if some.any():
            together, ends = parts(keys.filter(pa.array(some)))
            ids = self.whole(together.tobytes().decode())
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends[1:]) + 1
            lengths[some] = np.diff(cuts, prepend=0)
        for i in np.flatnonzero(~some).tolist():
            found.append(self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
            lengths[i] = len(found[-1])
        out = np.concatenate([[0], np.cumsum(lengths)])
        body = np.zeros(out[-1], np.uint32)
        if some.any():
            body[np.repeat(some, lengths)] = ids
        for i, own in zip(np.flatnonzero(~some).tolist(), found):
            body[out[i] : out[i + 1]] = own
        return binaries(body.view(np.uint8), 4 * out)

    def encode(self, texts: pa.Array, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of the texts in it."""
        data, offsets = flat(texts, lead)
        return encoded(data, offsets, before_separators(data, offsets), self.memory)
