"""Operator 11, alignment of two tokenizers over exactly deduplicated texts.

1. Texts are grouped by their full text; what repeats meets as one row with
   its multiplicity (combined before the shuffle, so a text that holds a third
   of all rows costs one row a task).
2. Each different text is encoded once by both tokenizers and aligned on the
   byte offsets of its token ends. Ids are stored in packed pages; about
   ``BLOCK_BYTES`` of a task's texts are a block, which stores its linked id
   pairs with their counts, weighted by multiplicity.
3. Pair counts are summed over blocks, and the highest count of each B id is
   found. The pairs of a block get their totals back by a join on the pair, so
   what moves is a block's different pairs and not every link.
4. A block's totals and its pages meet in one partition; pages stream past the
   totals and sum up their links, which follow from the stored ids again.
5. The measures of a text join all its rows by the text's SHA-256. Spark
   splits that join where one text has many rows.

Both tokenizers work on chunks (``chunks``); a worker encodes a chunk once
while it keeps it. Pairs are bounded by the vocabularies, and nothing of the
corpus is broadcast or collected.

Cases: null and empty texts, and texts that a tokenizer cannot give back byte
by byte (such as one with U+2581), have no tokens: zeros and an empty
``groups_sha256``; null or repeated ids are rows like others; strings of special
tokens are plain text; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Store, numbered, spread
from .common import as_id, keep_in_worker, release, stored, table
from .token_files import Encoder
from .wordhash import slices, string_buffers

#: Text bytes of a block, whose links and pairs one task works on.
BLOCK_BYTES = 64 << 20
#: Rows of pairs that are kept apart before they are added up.
PAIR_ROWS = 1 << 20
#: Text bytes that are encoded at once, and ids of a stored page.
SLICE, PAGE_IDS = 1 << 20, 1 << 14
_MEASURES = ("key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
             "groups_sha256 string")


def _byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


class TokensA(Encoder):
    """Byte-level BPE; strings of special tokens are ordinary text."""

    limit = 500_000

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        back = _byte_level()
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for name, i in self.tokenizer.get_vocab().items():
            self.size[i] = sum(1 for c in name if c in back)

    def tokens(self, col: pa.Array):
        """(ids of space + text of all texts in order, ids per text)."""
        chunk, counts = numbered(col, self, first_space=True, only_spaces=False)
        n = self.length[chunk]
        ids = self.flat[spread(self.start[chunk], n)].astype(np.int64)
        cum = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], cum[np.cumsum(counts)]])
        return ids, np.diff(ends)


class TokensB(Store):
    """Pieces with byte fallback. A chunk also knows whether its pieces give
    its bytes back."""

    limit = 500_000

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.sp.get_piece_size()):
            name = self.sp.id_to_piece(i)
            self.bytes_of.append(bytes([int(name[3:5], 16)]) if self.sp.is_byte(i) else name.replace("▁", " ").encode())
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.space = self.sp.piece_to_id("▁")
        self.clear()

    def clear(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, strings):
        got = self.sp.encode([s[1:] for s in strings], num_threads=1)  # the model adds the first space
        got = [ids if s != " " else [self.space] for ids, s in zip(got, strings)]  # but not to an empty text
        n = np.fromiter(map(len, got), np.int64, len(got))
        good = [b"".join([self.bytes_of[i] for i in ids]) == s.encode() for ids, s in zip(got, strings)]
        new = np.fromiter((i for ids in got for i in ids), np.int32, int(n.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(new)] = new
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.good = np.concatenate([self.good, good])
        self.used += len(new)

    def tokens(self, col: pa.Array):
        """(ids of all texts in order, ids per text, whether the text comes back)."""
        chunk, counts = numbered(col, self, first_space=True, only_spaces=True)
        n = self.length[chunk]
        ids = self.flat[spread(self.start[chunk], n)].astype(np.int64)
        cum = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], cum[np.cumsum(counts)]])
        bad = np.bincount(np.repeat(np.arange(len(counts)), counts), ~self.good[chunk], len(counts))
        return ids, np.diff(ends), bad == 0


_TOKENIZERS = keep_in_worker()


def tokenizers(path_a: str, path_b: str) -> tuple[TokensA, TokensB]:
    """The Python worker's tokenizers; they serve its later tasks, too."""
    release(but=_TOKENIZERS)
    if (path_a, path_b) not in _TOKENIZERS:
        _TOKENIZERS[path_a, path_b] = TokensA(path_a), TokensB(path_b)
    return _TOKENIZERS[path_a, path_b]


def encode_both(col: pa.Array, a: TokensA, b: TokensB):
    """(A ids, A ids per text, B ids, B ids per text); texts that one of the
    tokenizers does not give back have none."""
    ids_a, n_a = a.tokens(col)
    ids_b, n_b, good = b.tokens(col)
    size = np.diff(string_buffers(col)[1])
    text_a = np.repeat(np.arange(len(n_a)), n_a)
    good &= (size > 0) & (np.bincount(text_a, a.size[ids_a], len(n_a)) == size + 1)
    text_b = np.repeat(np.arange(len(n_b)), n_b)
    return ids_a[good[text_a]], np.where(good, n_a, 0), ids_b[good[text_b]], np.where(good, n_b, 0)


def links(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """(A token, B token of every link in order, last A and last B token of
    every group): token ends of both cut the same bytes into spans, one for
    each pair of tokens that overlap."""
    end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)  # 1: an A token ends here, 2: a B token
    ends[end_a] = 1
    ends[end_b] += 2
    kind = ends[np.flatnonzero(ends)]
    is_a, is_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
    link_a, link_b, both = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, kind == 3
    return link_a, link_b, link_a[both], link_b[both]


class Written:
    """Ids as decimals with what follows them in the digest's notation."""

    def __init__(self, n: int):
        for name, after in (("within", ","), ("half", "|"), ("end", ";")):
            setattr(self, name, np.array([f"{i}{after}" for i in range(n)], object))

    def groups(self, ids_a, ids_b, last_a, last_b) -> np.ndarray:
        """The decimals of all tokens, group by group."""
        out = np.empty(len(ids_a) + len(ids_b), object)
        group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
        group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
        at_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]
        at_b = np.arange(len(ids_b)) + (last_a + 1)[group_b]
        out[at_a], out[at_b] = self.within[ids_a], self.within[ids_b]
        out[at_a[last_a]], out[at_b[last_b]] = self.half[ids_a[last_a]], self.end[ids_b[last_b]]
        return out


class PairCounts:
    """Pairs of ids with weighted counts; bounded by a block's pairs."""

    def __init__(self):
        self.pairs, self.n, self.new, self.fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, pairs: np.ndarray, n: np.ndarray):
        self.new.append(_added(pairs, n))
        self.fresh += len(self.new[-1][0])
        if self.fresh > PAIR_ROWS:
            self.total()

    def total(self):
        if self.new:
            every = [(self.pairs, self.n), *self.new]
            self.pairs, self.n = _added(*(np.concatenate(x) for x in zip(*every)))
            self.new, self.fresh = [], 0
        return self.pairs, self.n


def _added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[heads], np.add.reduceat(n, heads) if len(heads) else n[:0]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype).astype(np.int64)


#: A page holds some texts of a block: their keys and digests (32 bytes each),
#: their numbers (A tokens, B tokens, groups) and all their ids, packed.
_PAGE = "block long, keys binary, digests binary, numbers binary, a binary, b binary"


def _pages(block: int, keys: list[bytes], digests: list[bytes], numbers: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
    """Page rows of about ``PAGE_IDS`` ids, one text at least."""
    ends = np.cumsum(numbers, axis=1)
    page = (ends[0] + ends[1]) // PAGE_IDS
    cut = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), len(keys)]
    cols: list[list] = [[] for _ in range(6)]
    for lo, hi in zip(cut[:-1], cut[1:]):
        at_a, at_b = (0, 0) if lo == 0 else ends[:2, lo - 1]
        for col, value in zip(cols, (block, b"".join(keys[lo:hi]), b"".join(digests[lo:hi]),
                                     _pack(np.ascontiguousarray(numbers[:, lo:hi]).astype("<i8")),
                                     _pack(ids_a[at_a:ends[0, hi - 1]].astype("<u2")),
                                     _pack(ids_b[at_b:ends[1, hi - 1]].astype("<u2")))):
            col.append(value)
    n = len(cols[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]], pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.int64())], names=[c.split()[0] for c in _PAGE.split(", ")] + ["pair", "n"])


def aligned(texts: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Different texts (key, text, times) -> pages, block by block, and behind
    them the block's pairs (``pair``, ``n``; no keys)."""
    def pair_rows(block, counts):
        pairs, n = counts.total()
        for lo in range(0, len(pairs), 100_000):
            p = pairs[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), block)), *[pa.nulls(len(p), pa.binary())] * 5, pa.array(p),
                 pa.array(n[lo:lo + 100_000])], names=[c.split()[0] for c in _PAGE.split(", ")] + ["pair", "n"])

    def run(batches):
        a, b = tokenizers(path_a, path_b)
        written = Written(max(len(a.size), len(b.size)))
        block, size, counts = TaskContext.get().partitionId() << 32, 0, PairCounts()
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                ids_a, n_a, ids_b, n_b = encode_both(part.column("text"), a, b)
                link_a, link_b, last_a, last_b = links(ids_a, ids_b, a.size, b.size)
                times = part.column("times").to_numpy().astype(np.int64)
                text = np.repeat(np.arange(len(n_a)), n_a)
                counts.add((ids_b[link_b] << 16) | ids_a[link_a], times[text[link_a]])
                tokens = written.groups(ids_a, ids_b, last_a, last_b)
                stop = np.cumsum(n_a + n_b).tolist()
                sha = [hashlib.sha256("".join(tokens[lo:hi])[:-1].encode()).digest() for lo, hi in zip([0, *stop[:-1]], stop)]
                groups = np.bincount(text[last_a], minlength=part.num_rows)
                yield _pages(block, part.column("key").to_pylist(), sha, np.stack([n_a, n_b, groups]), ids_a, ids_b)
                size += int(a.size[ids_a].sum())
                if size > block_bytes:
                    yield from pair_rows(block, counts)
                    block, size, counts = block + 1, 0, PairCounts()
        yield from pair_rows(block, counts)

    return texts.select("key", "text", "times").mapInArrow(run, f"{_PAGE}, pair long, n long")


def pair_totals(pairs: DataFrame) -> DataFrame:
    """pair, total, best (whether no pair of its B id has a higher total)."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = stored(totals.withColumn("b_id", F.shiftright("pair", 16)), "align-totals")
    highest = totals.groupBy("b_id").agg(F.max("total").alias("highest"))
    return totals.join(highest, "b_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def measures(rows: DataFrame, totals: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per different text: key, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. A block's totals come before its pages."""
    spark = rows.sparkSession
    pairs = rows.where("keys is null").select("block", "pair")
    known = pairs.join(totals, "pair").select("block", F.lit(0).alias("kind"), "pair", "total", "best")
    pages = rows.where("keys is not null").select("block", F.lit(1).alias("kind"), "keys", "digests", "numbers", "a", "b")
    blocks = pairs.agg(F.count_distinct("block"), F.max(F.shiftright("block", 32))).first()
    parts, tasks = max(1, blocks[0]), (blocks[1] or 0) + 1
    place = (F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * tasks) % parts  # a block each, or nearly
    met = (known.unionByName(pages, allowMissingColumns=True).repartitionById(parts, place.cast("int"))
           .sortWithinPartitions("block", "kind", "pair"))
    sizes = spark.sparkContext.broadcast((TokensA(path_a).size, TokensB(path_b).size))  # a number per vocabulary entry
    names = [c.split()[0] for c in _MEASURES.split(", ")]

    def measured(row, size_a, size_b, pair, total, best):
        n_a, n_b, groups = _unpack(row["numbers"], "<i8").reshape(3, -1)
        ids_a, ids_b = _unpack(row["a"], "<u2"), _unpack(row["b"], "<u2")
        n = len(n_a)
        link_a, link_b, _, _ = links(ids_a, ids_b, size_a, size_b)
        text = np.repeat(np.arange(n), n_a)[link_a]
        at = np.searchsorted(pair, (ids_b[link_b] << 16) | ids_a[link_a])
        sums = np.zeros(n, np.int64)
        np.add.at(sums, text, total[at])
        sha = [row["digests"][32 * k:32 * k + 32].hex() if n_a[k] else "" for k in range(n)]
        return pa.RecordBatch.from_arrays(
            [pa.array([row["keys"][32 * k:32 * k + 32] for k in range(n)], pa.binary()), pa.array(n_a), pa.array(n_b),
             pa.array(groups), pa.array(np.bincount(text, minlength=n)),
             pa.array(np.bincount(text[best[at].astype(bool)], minlength=n)), pa.array(sums), pa.array(sha, pa.string())],
            names=names)

    def run(batches):
        release()
        size_a, size_b = sizes.value
        block, found, read = None, None, []
        for whole in batches:
            mark = whole.column("block").to_numpy() * 2 + whole.column("kind").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])).tolist() + [len(mark)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                part = whole.slice(lo, hi - lo)
                if mark[lo] // 2 != block:
                    block, found, read = mark[lo] // 2, None, []
                if mark[lo] % 2 == 0:
                    read.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "total", "best")])
                    continue
                if found is None:
                    found = [np.concatenate(x) for x in zip(*read)] if read else [np.zeros(0, np.int64)] * 3
                    read = []
                for k in range(part.num_rows):
                    yield measured({c: part.column(c)[k].as_py() for c in ("keys", "digests", "numbers", "a", "b")},
                                   size_a, size_b, *found)

    return met.mapInArrow(run, _MEASURES)


def _key(text) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(measures of every row, pair totals of the corpus)."""
    rows = as_id(docs, id_col, F.col(text_col).alias("text"))
    some = rows.where("text <> ''")
    texts = some.groupBy("text").agg(F.count("*").alias("times"))
    found = stored(aligned(texts.withColumn("key", _key("text")), path_a, path_b, block_bytes), "align-texts")
    totals = stored(pair_totals(found.where("keys is null").select("pair", "n")), "align-pairs")
    each = stored(measures(found, totals, path_a, path_b), "align-measures")
    out = rows.select("id", F.when(F.col("text") != "", _key("text")).alias("key")).join(each, "key", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), totals


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    found, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")
