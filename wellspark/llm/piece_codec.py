"""Encoding with and decoding from a SentencePiece vocabulary, by streaming Viterbi.

The best segmentation maximises the sum of the piece scores of the model file. The search walks the text once: from
every boundary it extends the pieces of a trie, so only boundaries within the longest piece ahead can still change.
When the back-pointer paths of all those boundaries pass through one common boundary, the ids up to it are final, are
committed, and everything before it is forgotten: memory is bounded by the stretch without such a convergence, not by
the text. Where no piece of the vocabulary holds a space after another character, nor a line end, all paths converge
in front of every single space and around line ends; the ids of such a chunk depend on it alone and are remembered per
distinct chunk (:mod:`wellspark.llm.chunks`). Short chunks that a batch brings anew are searched all at once, one array
step per boundary and piece length; longer ones by the stream.

A space becomes U+2581, and one is put in front of the text, as the model asks. A character in no piece is written as
the byte pieces of its UTF-8 form, and so is U+2581 itself when it occurs in the text; decoding therefore gives back
every text exactly.

Edge cases: a null text has null ids and decodes to null; an empty text has no ids; an unknown id on decoding raises.
Ids and extra columns as in the other operators: carried, ignored.
"""

from __future__ import annotations

from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import chunks

SPACE = "▁"
LOW = float("-inf")
UNKNOWN_COST = 10.0  # below the lowest score of a piece, per unknown character
TOGETHER = 48  # characters of a chunk up to which many are searched at once
FOREIGN = 0x110000  # the code of U+2581 where a text itself holds it: in no piece


class Links:
    """The trie's edges as one open-addressed table, (node, character) to node, read for many pairs at once."""

    def __init__(self, edges: dict[int, int]):
        """``edges``: node << 21 | character to node."""
        self.bits = max(4, (2 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.nodes = np.zeros(1 << self.bits, np.int32)
        keys = np.fromiter(edges, np.int64, len(edges))
        nodes = np.fromiter(edges.values(), np.int32, len(edges))
        at = self.home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.nodes[at[free]] = keys[free], nodes[free]  # of several for one slot the last
            again = self.keys[at] != keys
            keys, nodes, at = keys[again], nodes[again], (at[again] + 1) & (len(self.keys) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes below ``nodes`` by ``codes``, -1 where there is none."""
        keys = nodes.astype(np.int64) << 21 | codes
        at = self.home(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            found = there == keys
            out[open_[found]] = self.nodes[at[found]]
            on = ~found & (there >= 0)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Pieces:
    """The pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes | None] = [None] * model.vocab_size()
        self.byte_ids = [0] * 256
        normal = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append((piece, i, model.get_score(i)))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.unknown = min((s for _, _, s in normal), default=0.0) - UNKNOWN_COST
        self.normal = normal
        self.single = {p for p, _, _ in normal if len(p) == 1}
        self.longest = max((len(p) for p, _, _ in normal), default=1)
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in normal)
        self.table = pa.array(self.bytes_of, pa.large_binary())
        self.memory = chunks.Memory(self.learn)

    # what only one of the searches, or no decoding worker, needs is made when it is first asked for

    @cached_property
    def trie(self) -> dict:
        """The pieces for the stream; a node is [children, id or -1, score]."""
        trie: dict = {}
        for piece, i, score in self.normal:
            kids = trie
            for c in piece:
                node = kids.setdefault(c, [{}, -1, 0.0])
                kids = node[0]
            node[1:] = [i, score]
        return trie

    @cached_property
    def links(self) -> tuple[Links, np.ndarray, np.ndarray, np.ndarray]:
        """The same for many chunks at once: edges, the id and score of each node, and the characters in a piece."""
        edges: dict[int, int] = {}
        ids, scores = [-1], [0.0]
        for piece, i, score in self.normal:
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                node = edges.get(key)
                if node is None:
                    node = edges[key] = len(ids)
                    ids.append(-1)
                    scores.append(0.0)
            ids[node], scores[node] = i, score
        known = np.zeros(FOREIGN + 1, bool)
        known[[ord(c) for c in self.single]] = True
        return Links(edges), np.array(ids, np.int32), np.array(scores), known

    def whole(self, text: str) -> bytes:
        """Ids (as little-endian uint32) of a text in which each U+2581 stands for a space."""
        return b"".join(self.stream(text))

    def stream(self, text: str):
        """Yield the ids of ``text`` in committed runs. Boundaries are kept relative to the last committed one."""
        trie, single, unknown, longest, n = self.trie, self.single, self.unknown, self.longest, len(text)
        every = 4 * longest  # look for a common boundary after so many characters
        done, limit = 0, every
        score, start, piece = [0.0], [0], [-1]
        room = min(n, limit) + longest
        score += [LOW] * room
        start += [0] * room
        piece += [-1] * room
        for at in range(n):
            i = at - done
            if i >= limit:
                meet = self._meet(start, i, min(i + longest, n - done + 1), score)
                if meet:
                    yield self._ids(text, done, start, piece, meet)
                    done += meet
                    i -= meet
                    del score[:meet], start[:meet], piece[:meet]
                    start[1:] = [s - meet for s in start[1:]]
                limit = i + every
                more = limit + longest + 1 - len(score)
                score += [LOW] * more
                start += [0] * more
                piece += [-1] * more
            here, kids, j = score[i], trie, i
            if text[at] not in single and here + unknown > score[i + 1]:
                score[i + 1], start[i + 1], piece[i + 1] = here + unknown, i, -1
            for c in text[at : at + longest]:
                node = kids.get(c)
                if node is None:
                    break
                j += 1
                kids, found, gain = node
                if found >= 0 and here + gain > score[j]:
                    score[j], start[j], piece[j] = here + gain, i, found
        if n > done:
            yield self._ids(text, done, start, piece, n - done)

    @staticmethod
    def _meet(start: list[int], low: int, high: int, score: list[float]) -> int:
        """The last boundary that the back-pointer paths of all open boundaries (low and beyond) share."""
        heads = {b for b in range(low, high) if score[b] > LOW}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(start[last])
        return heads.pop()

    def _ids(self, text: str, done: int, start: list[int], piece: list[int], high: int) -> bytes:
        out = []
        while high:
            if piece[high] >= 0:
                out.append(piece[high])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[done + high - 1].encode()))
            high = start[high]
        out.reverse()
        return array("I", out).tobytes()

    def learn(self, keys: pa.Array) -> pa.Array:
        """The ids of unseen chunks: short ones all together, the others by the stream."""
        texts = keys.cast(pa.large_string()).to_pylist()
        short = np.array([len(t) <= TOGETHER for t in texts])
        rows = [self.search([t for t in texts if len(t) <= TOGETHER]),
                pa.array([self.alone(t) for t in texts if len(t) > TOGETHER], pa.large_binary())]
        order = np.argsort(~short, kind="stable")
        return pa.concat_arrays(rows).take(pa.array(np.argsort(order)))

    def alone(self, text: str) -> bytes:
        """A chunk by the stream. U+2581 in it goes to its bytes, the stretches between are encoded by themselves."""
        mark = array("I", [self.byte_ids[b] for b in SPACE.encode()]).tobytes()
        return mark.join([self.whole(part.replace(" ", SPACE)) for part in text.split(SPACE)])

    def search(self, texts: list[str]) -> pa.Array:
        """The same best segmentation for many short chunks: one array step per boundary and piece length.

        The chunks are sorted by length, so that those with a character at some place are the first ones.
        """
        if not texts:
            return pa.array([], pa.large_binary())
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        codes = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[codes == ord(SPACE)] = FOREIGN
        codes[codes == 32] = ord(SPACE)
        links, piece_at, score_at, known = self.links
        first = np.cumsum(lengths) - lengths  # the place of each chunk's first character
        n, room = len(codes), np.repeat(lengths + first, lengths) - np.arange(len(codes))  # characters up to the end
        at, node, steps = np.arange(n), np.zeros(n, np.int32), []
        for k in range(self.longest):  # pieces of k + 1 characters from every place
            node = links(node, codes[at + k])
            on = (node >= 0) & (room[at] > k)
            at, node = at[on], node[on]
            gain = np.full(n, LOW)
            gain[at] = np.where(piece_at[node] >= 0, score_at[node], LOW)
            ids = np.full(n, -1, np.int32)
            ids[at] = piece_at[node]
            steps.append((gain, ids))
            on = room[at] > k + 1
            at, node = at[on], node[on]
            if not len(at):
                break
        unknown = ~known[codes]
        # boundaries: place p of chunk c is p + c, so that each chunk has one more than characters
        base = first + np.arange(len(first))
        score = np.full(n + len(first), LOW)
        score[base] = 0.0
        start, piece = np.zeros(len(score), np.int32), np.full(len(score), -1, np.int32)
        for t in range(int(lengths[0])):
            m = int(np.searchsorted(-lengths, -t, "left"))  # chunks longer than t
            here, place = base[:m] + t, first[:m] + t
            odd = np.flatnonzero(unknown[place])
            self.better(score, start, piece, here[odd], score[here[odd]] + self.unknown, 1, -1)
            for k, (gain, ids) in enumerate(steps):
                own = gain[place]
                some = np.flatnonzero(own > LOW)
                self.better(score, start, piece, here[some], score[here[some]] + own[some], k + 1, ids[place[some]])
        at, whose, ids = lengths.copy(), [], []
        chunk = np.arange(len(first))
        while len(chunk):  # back from all ends at once, one piece a step
            p = base[chunk] + at[chunk]
            whose.append(chunk)
            ids.append(piece[p])
            at[chunk] -= start[p]
            chunk = chunk[at[chunk] > 0]
        whose, ids = np.concatenate(whose)[::-1], np.concatenate(ids)[::-1]
        by = np.argsort(whose, kind="stable")
        whose, ids = whose[by], ids[by]
        odd = np.unique(whose[ids < 0])
        ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(first)))])
        rows = chunks.binaries(ids.astype(np.uint32).view(np.uint8), 4 * ends)
        if len(odd):  # with characters that no piece holds: those as their bytes
            rows = rows.to_pylist()
            for c in odd.tolist():
                rows[c] = self.with_bytes(texts[order[c]], start[base[c] :], piece[base[c] :])
            rows = pa.array(rows, pa.large_binary())
        return rows.take(pa.array(np.argsort(order)))

    def with_bytes(self, text: str, start: np.ndarray, piece: np.ndarray) -> bytes:
        ids, p = [], len(text)
        while p:
            if piece[p] >= 0:
                ids.append(int(piece[p]))
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[p - 1].encode()))
            p -= int(start[p])
        return array("I", reversed(ids)).tobytes()

    @staticmethod
    def better(score, start, piece, here, value, length, ids) -> None:
        """Take the boundaries ``length`` behind ``here`` from there where that scores more; no two are the same."""
        to = here + length
        on = value > score[to]
        to = to[on]
        score[to], start[to] = value[on], length
        piece[to] = ids if isinstance(ids, int) else ids[on]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of the texts in it. An empty text has none."""
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        data, offsets = chunks.flat(pc.binary_join_element_wise(lead, texts, ""))
        starts = (chunks.before_separators(data, offsets) if self.splits
                  else np.flatnonzero(chunks.text_starts(data, offsets)))
        return chunks.encoded(data, offsets, starts, self.memory)

    def encode(self, text: str) -> bytes:
        return self.encode_texts(pa.array([text]))[0].tobytes()

    def decode_lists(self, lists: pa.Array) -> pa.Array:
        """The texts of lists of ids; null for null."""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        pieces = self.table.take(lists.flatten())
        if pieces.null_count:
            raise ValueError("an id without a piece")
        data, at = chunks.parts(pieces)
        ends = at[np.concatenate([[0], np.cumsum(counts)])]
        lead = ends[:-1][np.diff(ends) > 0]  # encoding puts a space in front of a text
        body = np.delete(data, lead).tobytes()
        ends = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
        valid = lists.is_valid()
        if (data[lead] == 32).all() and decodes(body, ends):
            texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)),
                                                     pa.py_buffer(body)).cast(pa.string())
        else:  # bytes that are no text: by themselves
            texts = pa.array([self.decode(row) if row else "" for row in lists.to_pylist()], pa.string())
        return pc.if_else(valid, texts, pa.scalar(None, pa.string()))

    def decode(self, ids) -> str:
        """The text of ``ids``; the space that encoding puts in front is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def decodes(body: bytes, ends: np.ndarray) -> bool:
    """Whether the bytes are UTF-8 and every end stands between two characters."""
    try:
        body.decode()
    except UnicodeDecodeError:
        return False
    inner = ends[ends < len(body)]
    return not ((np.frombuffer(body, np.uint8)[inner] & 0xC0) == 0x80).any()


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches):
        codec = chunks.codec(Pieces, model)
        for batch in batches:
            known = batch.column(1).is_valid()
            for rows, texts in chunks.slices([pa.RecordBatch.from_arrays(
                    [pa.StructArray.from_arrays([batch.column(0), known], ["id", "known"]), batch.column(1)],
                    ["row", "text"])]):
                lists = chunks.int_lists(*codec.encode_texts(texts))
                ids, there = rows.flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pc.if_else(there, lists, pa.scalar(None, lists.type))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text."""

    def run(batches):
        codec = chunks.codec(Pieces, model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codec.decode_lists(part.column(1))],
                                                 ["doc_id", "ids", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
