"""Operator 8, sampled SentencePiece segmentations and lossless decoding.

All segmentations of a text into vocabulary pieces form a lattice. Each piece
weighs exp(alpha * log-prior), where the prior of a BPE vocabulary is Zipf's
over its merge ranks (its scores are minus those ranks). Forward filtering
sums the weights of all ways to reach each place; backward sampling draws a
segmentation from its exact distribution, from the end to the front. The
random numbers are hashes of seed, row key, chunk number and step, so a row
always gets the same segmentation, whatever its partition or neighbours.

No piece has a space after another character, so the lattice of a text is a
chain of the lattices of its chunks (a space run and what follows); each
different chunk is filtered once per task and all its occurrences are drawn
together. Characters without a piece go through byte pieces, so decoding
gives back every text. Pieces are never trained: the model file is a
parameter.

Cases: null and empty texts have no pieces and decode to the empty text; rows
that repeat an id and a text get equal segmentations; a null id seeds like a
fixed value; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Store, numbered, spread
from .common import keep_in_worker, release, table
from .wordhash import U, mix, slices, string_buffers

NULL_KEY = 0x5EED


class Pieces:
    """Pieces with " " for the space mark, their weights and their bytes."""

    def __init__(self, path: str, alpha: float, offset: float = 50.0):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id, self.ids, self.weight = [0] * 256, {}, {}
        self.bytes_of = [b""] * n
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = name.replace("▁", " ")
                self.ids[text] = i
                rank = max(0.0, -sp.get_score(i))
                # single characters carry no merge rank: all get the last one
                rank = n if rank > n else rank
                self.weight[text] = math.exp(-alpha * math.log(rank + offset))
                self.bytes_of[i] = text.encode()
        self.size = n
        self.weights = np.zeros(n)
        for t, i in self.ids.items():
            self.weights[i] = self.weight[t]
        self._trie()
        #: A factor per character, the same for all ways through a chunk,
        #: that keeps the sums of long chunks within range.
        self.lift = float(1.0 / np.median([self.weight[t] ** (1.0 / len(t)) for t in self.ids]))
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.at = np.cumsum(self.n_bytes) - self.n_bytes


    def _trie(self):
        """Sorted keys (state, character) -> next state; pieces that end there."""
        step, piece = {}, [-1]
        for t, i in self.ids.items():
            state = 0
            for ch in t:
                key = (state << 21) + ord(ch)
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                state = step[key]
            piece[state] = i
        self.trie_key = np.array(sorted(step), np.int64)
        self.trie_to = np.array([step[k] for k in self.trie_key.tolist()], np.int64)
        self.trie_piece = np.array(piece, np.int64)


class Lattices(Store):
    """Chunk -> the node at its end; nodes keep their incoming edges.

    Edge e leads back from its node to ``prev[e]`` over piece ``piece[e]``;
    ``cum[e]`` is the node's number plus the running share of its edges, so one
    sorted search draws edges for many nodes at once. A character c without a
    piece is an edge numbered ``size + c`` and drawn as its byte pieces.
    """

    #: Longer chunks are filtered one by one with rescaled sums.
    long = 200

    def __init__(self, pieces: Pieces, edges: int):
        super().__init__()
        self.pieces, self.edges, self.limit = pieces, edges, edges // 12
        self.clear()

    def clear(self):
        self.nodes, self.room = 0, {}
        self.end = np.zeros(0, np.int64)
        self.root = np.zeros(0, bool)
        self.cum = np.zeros(0, np.float64)
        self.prev = np.zeros(0, np.int32)
        self.piece = np.zeros(0, np.int32)

    def crowded(self) -> bool:
        return len(self.cum) > self.edges

    def _append(self, name: str, values: np.ndarray) -> None:
        """Add values to an array that doubles its room when it is full."""
        now = getattr(self, name)
        n = len(now) + len(values)
        room = self.room.get(name, now)
        if n > len(room):
            room = np.empty(max(n, 2 * len(room)), now.dtype)
            room[:len(now)] = now
            self.room[name] = room
        room[len(now):n] = values
        setattr(self, name, room[:n])

    def _edges(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray):
        """(from, to, piece, weight) of every piece found in the chunks; the
        node before character i of chunk c is i + c."""
        p = self.pieces
        owner = np.repeat(np.arange(len(start)), length)
        stop = (start + length)[owner]
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        origin, src, dst, pid = at, [], [], []
        bare = np.ones(len(chars), bool)
        depth = 0
        while len(at):
            key = state * (1 << 21) + chars[at]
            k = np.minimum(np.searchsorted(p.trie_key, key), len(p.trie_key) - 1)
            hit = p.trie_key[k] == key
            at, origin, state = at[hit], origin[hit], p.trie_to[k[hit]]
            full = p.trie_piece[state] >= 0
            src.append(origin[full] + owner[origin[full]])
            dst.append(at[full] + 1 + owner[origin[full]])
            pid.append(p.trie_piece[state[full]])
            if depth == 0:
                bare[origin[full]] = False
            at = at + 1
            on = at < stop[origin]
            at, origin, state = at[on], origin[on], state[on]
            depth += 1
        alone = np.flatnonzero(bare)
        src.append(alone + owner[alone])
        dst.append(alone + 1 + owner[alone])
        pid.append(p.size + chars[alone])
        src, dst, pid = np.concatenate(src), np.concatenate(dst), np.concatenate(pid)
        w = np.ones(len(pid))
        known = pid < p.size
        w[known] = p.weights[pid[known]] * p.lift ** (dst - src)[known]
        return src, dst, pid, w

    def _filter(self, src, dst, w, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Forward sums of all nodes, one place of all chunks after the other."""
        sums = np.zeros(int(length.sum()) + len(length))
        sums[first] = 1.0
        place = np.arange(len(sums)) - np.repeat(first, length + 1)
        order = np.argsort(place[dst], kind="stable")
        src, dst, w = src[order], dst[order], w[order]
        there = place[dst]
        cuts = np.searchsorted(there, np.arange(1, int(there.max(initial=0)) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            np.add.at(sums, dst[lo:hi], sums[src[lo:hi]] * w[lo:hi])
        return sums

    def _filter_long(self, src, dst, w, n: int) -> np.ndarray:
        """Logarithms of the forward sums of one chunk of n characters."""
        logs = np.full(n + 1, -np.inf)
        logs[0] = 0.0
        order = np.argsort(dst, kind="stable")
        src, dst, lw = src[order], dst[order], np.log(w[order])
        cuts = np.searchsorted(dst, np.arange(1, n + 2))
        for j in range(1, n + 1):
            lo, hi = cuts[j - 1], cuts[j]
            logs[j] = np.logaddexp.reduce(logs[src[lo:hi]] + lw[lo:hi])
        return logs

    def learn(self, strings):
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(length) - length
        first = start + np.arange(len(start))
        src, dst, pid, w = self._edges(chars, start, length)
        order = np.argsort(dst, kind="stable")
        src, dst, pid, w = src[order], dst[order], pid[order], w[order]
        share = np.zeros(len(w))
        short = np.repeat(length <= self.long, length + 1)[dst]
        sums = self._filter(src[short], dst[short], w[short], first, length)
        share[short] = sums[src[short]] * w[short] / sums[dst[short]]
        for c in np.flatnonzero(length > self.long):
            lo, hi = np.searchsorted(dst, (first[c], first[c] + length[c] + 1))
            a, b = src[lo:hi] - first[c], dst[lo:hi] - first[c]
            logs = self._filter_long(a, b, w[lo:hi], int(length[c]))
            share[lo:hi] = np.exp(logs[a] + np.log(w[lo:hi]) - logs[b])
        run = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
        tails = np.concatenate([heads[1:], [len(dst)]]) - 1 if len(dst) else heads
        before = np.repeat(run[heads] - share[heads], tails - heads + 1)
        cum = np.minimum(run - before, 1.0)
        cum[tails] = 1.0
        root = np.zeros(len(chars) + len(strings), bool)
        root[first] = True
        self._append("end", self.nodes + first + length)
        self._append("root", root)
        self._append("cum", self.nodes + dst + cum)
        self._append("prev", self.nodes + src)
        self._append("piece", pid)
        self.nodes += len(root)

    def sample(self, col: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts in order, ids per text)."""
        chunk, counts = numbered(col, self, first_space=True, only_spaces=True)
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        number = np.arange(len(chunk)) - first[doc]
        base = mix(keys.astype(np.uint64) ^ mix(np.full(1, seed, np.uint64)))
        state = mix(base[doc] + number.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        node, who, step = self.end[chunk], np.arange(len(chunk)), 0
        length = np.zeros(len(chunk), np.int64)
        drawn = []
        while len(who):
            r = mix(state[who] + U((step + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            u = ((r >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            want = node + u
            order = np.argsort(want)  # in order, so that the search stays within the cache
            e = np.empty(len(want), np.int64)
            e[order] = np.searchsorted(self.cum, want[order], "left")
            drawn.append((who, self.piece[e]))
            length[who] += 1
            node = self.prev[e].astype(np.int64)
            on = ~self.root[node]
            node, who, step = node[on], who[on], step + 1
        at = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.int32)
        for k, (w, t) in enumerate(drawn):
            out[at[w] + length[w] - 1 - k] = t
        per = np.bincount(doc, length, len(counts)).astype(np.int64)
        bare = np.flatnonzero(out >= self.pieces.size)
        if len(bare):  # characters without a piece: their bytes
            raw = [chr(c).encode() for c in (out[bare] - self.pieces.size).tolist()]
            n = np.array([len(b) for b in raw])
            times = np.ones(len(out), np.int64)
            times[bare] = n
            owner = np.repeat(np.arange(len(counts)), per)
            per += np.bincount(owner[bare], n - 1, len(counts)).astype(np.int64)
            wide = np.repeat(out, times)
            wide[wide >= self.pieces.size] = [self.pieces.byte_id[b] for x in raw for b in x]
            out = wide
        return out, per


_LATTICES = keep_in_worker()


#: Lattice edges that a Python worker keeps: 16 bytes each, whatever the
#: length of the chunks. Fewer of them only mean that chunks are filtered again.
EDGES = 4_000_000


def lattices(model: str, alpha: float, edges: int = EDGES) -> Lattices:
    """The Python worker's lattices; they serve the worker's later tasks, too."""
    release(but=_LATTICES)
    if (model, alpha, edges) not in _LATTICES:
        _LATTICES[model, alpha, edges] = Lattices(Pieces(model, alpha), edges)
    return _LATTICES[model, alpha, edges]


def row_keys(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.uint64)


def decode_bytes(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): pieces joined, without the first space."""
    n = pieces.n_bytes[ids]
    raw = pieces.blob[spread(pieces.at[ids], n)]
    cum = np.concatenate([[0], np.cumsum(n)])
    off = cum[np.concatenate([[0], np.cumsum(counts)])]
    has = off[1:] > off[:-1]
    raw = np.delete(raw, off[:-1][has])
    return raw, off - np.concatenate([[0], np.cumsum(has)])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0,
           alpha: float = 1.0, digest: bool = False, edges: int = 2 * EDGES) -> DataFrame:
    """id, ids of a sampled segmentation; with ``digest`` instead of the ids:
    n_pieces, ids_crc32 and whether decoding the ids gives the text back."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        lat = lattices(model, alpha, edges)
        pieces = lat.pieces
        for whole in batches:
            for b in slices(whole, "text"):
                ids, n = lat.sample(b.column("text"), row_keys(b.column("id")), seed)
                off = np.concatenate([[0], np.cumsum(n)])
                if not digest:
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))],
                        names=["id", "ids"])
                    continue
                raw, at = decode_bytes(pieces, ids, n)
                buf, src = string_buffers(b.column("text"))
                view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B") if len(ids) else memoryview(b"")
                crc = [zlib.crc32(view[4 * s:4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                same = [bool(np.array_equal(raw[a:c], buf[d:e])) for a, c, d, e in zip(at[:-1], at[1:], src[:-1], src[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["id", "n_pieces", "ids_crc32", "lossless"])

    return rows.mapInArrow(run, "id long, n_pieces long, ids_crc32 long, lossless boolean" if digest
                           else "id long, ids array<int>")


def with_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0,
                alpha: float = 1.0, out: str = "pieces") -> DataFrame:
    """``docs`` with a further column of sampled piece ids."""
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema][:-1]

    def run(batches):
        lat = lattices(model, alpha)
        for whole in batches:
            for b in slices(whole, text_col):
                ids, n = lat.sample(b.column(text_col), row_keys(b.column(id_col)), seed)
                off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in names] + [pa.ListArray.from_arrays(off, pa.array(ids))], names=names + [out])

    return docs.select(*names).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """id, text from id, ids."""
    def run(batches):
        pieces = lattices(model, 1.0).pieces
        for b in batches:
            ids = b.column("ids")
            off = ids.offsets.to_numpy()
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = decode_bytes(pieces, flat, np.diff(off).astype(np.int64))
            text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int64)),
                                                    pa.py_buffer(np.ascontiguousarray(raw)))
            yield pa.RecordBatch.from_arrays([b.column("id"), text.cast(pa.string())], names=["id", "text"])

    return rows.select("id", "ids").mapInArrow(run, "id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless of every whole document."""
    import public_tokenizers
    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("id", "doc_id")
