"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

The corpus is read once, block by block, inside the executors.  In each block the distinct pieces
form an inverted index from token pair to positions; merges are applied in rank order over all
positions of a pair at once, and only the touched neighbours are indexed again.  There is no
shuffle: a block never needs another block, because merges never cross a piece.

Pieces are the pre-tokens of the vocabulary's pattern, cut further wherever two neighbouring bytes
stand together in no token of the vocabulary.  No merge can ever cross such a place, so the cut
changes no id; it makes pieces short and very repetitive also in scripts without spaces.

Defined results: a null text and an empty text both give an empty list; strings that look like
special tokens are ordinary text; repeated texts give equal lists; an empty table gives an empty
table; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern that the public 50k byte vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters encoded at once; bounds a worker's memory.
BLOCK_CHARS = 1_000_000
#: Distinct pieces a worker remembers between blocks; it forgets all of them beyond that.
KEPT_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class MergeReplay:
    """Encodes distinct pieces by replaying the merges of a vocabulary in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.cuttable = np.ones((256, 256), dtype=bool)
        for token in ranks:
            for left, right in zip(token, token[1:]):
                self.cuttable[left, right] = False
        self.pair_rank: dict[tuple[int, int], int] = {}

    def rank(self, left: int, right: int) -> int:
        """Rank of the merge of two tokens, -1 if there is none."""
        found = self.pair_rank.get((left, right))
        if found is None:
            found = self.ranks.get(self.token[left] + self.token[right], -1)
            self.pair_rank[left, right] = found
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; all pieces share one inverted index."""
        ids: list[int] = []
        after: list[int] = []
        before: list[int] = []
        first: list[int] = []
        for piece in pieces:
            start = len(ids)
            first.append(start if piece else -1)
            ids.extend(self.byte_id[b] for b in piece)
            before.extend(range(start - 1, start + len(piece) - 1))
            after.extend(range(start + 1, start + len(piece) + 1))
            if piece:
                before[start] = -1
                after[-1] = -1
        where: dict[int, list[int]] = defaultdict(list)
        for at, to in enumerate(after):
            if to >= 0 and (rank := self.rank(ids[at], ids[to])) >= 0:
                where[rank].append(at)
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            touched: list[int] = []
            for at in sorted(where.pop(rank, ())):
                to = after[at]
                if ids[at] < 0 or to < 0 or self.rank(ids[at], ids[to]) != rank:
                    continue
                ids[at], ids[to] = rank, -1
                after[at] = follows = after[to]
                if follows >= 0:
                    before[follows] = at
                    touched.append(at)
                if before[at] >= 0:
                    touched.append(before[at])
            for at in touched:
                if ids[at] >= 0 and (to := after[at]) >= 0 and (new := self.rank(ids[at], ids[to])) >= 0:
                    if new not in where:
                        heapq.heappush(queue, new)
                    where[new].append(at)
        out = []
        for at in first:
            own = []
            while at >= 0:
                own.append(ids[at])
                at = after[at]
            out.append(own)
        return out


class BlockEncoder:
    """Encodes lists of texts; keeps the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.replay = MergeReplay(ranks)
        self.words = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known: dict[object, int] = {}
        self.offset = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def learn(self, new: dict[object, bytes]) -> None:
        """Adds pieces (by key) to the table of known pieces."""
        import numpy as np

        encoded = self.replay.encode(list(new.values()))
        start = len(self.offset) - 1
        for number, key in enumerate(new):
            self.known[key] = start + number
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in encoded for i in ids), dtype=np.int32, count=int(sizes.sum()))])

    def encode(self, texts: list[str]):
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        return self.encode_words(texts, [self.words.findall(text) for text in texts])

    def encode_long(self, text: str, chars: int = BLOCK_CHARS):
        """The same of one long text, worked on in runs of whole words of about ``chars`` characters."""
        import numpy as np

        done, run, size = [], [], 0
        for word in self.words.finditer(text):
            run.append(word.group())
            size += len(run[-1])
            if size >= chars:
                done.append(self.encode_words(["".join(run)], [run])[1])
                run, size = [], 0
        done.append(self.encode_words(["".join(run)], [run])[1])
        ids = np.concatenate(done)
        return np.array([0, len(ids)], dtype=np.int64), ids

    def encode_words(self, texts: list[str], words: list[list[str]]):
        """``encode`` of texts whose words are known."""
        import numpy as np
        import pandas as pd

        if len(self.known) > KEPT_PIECES:
            self.forget()
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        doc_end = np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), dtype=np.int64, count=len(texts)))
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        if not len(data):
            return offsets, np.zeros(0, dtype=np.int32)
        # where characters start, then where words start, then where nothing can merge across
        starts_char = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.cumsum(np.fromiter((len(w) for own in words for w in own), dtype=np.int64))
        begins = np.zeros(len(data), dtype=bool)
        begins[0] = True
        begins[starts_char[ends[:-1]]] = True
        begins[1:] |= self.replay.cuttable[data[:-1], data[1:]]
        at = np.flatnonzero(begins)
        size = np.diff(at, append=len(data))
        # pieces of up to seven bytes are told apart by one integer, longer ones by their bytes
        short = size <= 7
        codes = np.zeros(len(at), dtype=np.int64)
        where, sizes = at[short], size[short]
        key = sizes.astype(np.uint64) << np.uint64(56)
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        for j in range(7):
            more = sizes > j
            if not more.any():
                break
            key |= np.where(more, padded[where + j], 0).astype(np.uint64) << np.uint64(8 * j)
        numbers, distinct = pd.factorize(key)
        raw = data.tobytes()
        distinct = distinct.tolist()
        self.learn({k: (k & ((1 << 56) - 1)).to_bytes(7, "little")[: k >> 56] for k in distinct if k not in self.known})
        codes[short] = np.fromiter((self.known[k] for k in distinct), dtype=np.int64, count=len(distinct))[numbers]
        if not short.all():
            long = [raw[a : a + n] for a, n in zip(at[~short].tolist(), size[~short].tolist())]
            self.learn({k: k for k in dict.fromkeys(long) if k not in self.known})
            codes[~short] = np.fromiter((self.known[k] for k in long), dtype=np.int64, count=len(long))
        start = self.offset[codes]
        count = self.offset[codes + 1] - start
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(start - before[:-1], count) + np.arange(before[-1])]
        offsets[1:] = before[np.searchsorted(at, doc_end, side="left")]
        return offsets, ids


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens.

    The vocabulary is a file of fixed size (50k tokens, under 1 MB); it is read on the driver and
    sent to the executors once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    block = BLOCK_CHARS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = BlockEncoder(shared.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars + len(texts[end] or "") <= block):
                    chars += len(texts[end] or "")
                    end += 1
                whole = texts[begin] or ""
                offsets, ids = encoder.encode_long(whole, block) if len(whole) > block else encoder.encode([t or "" for t in texts[begin:end]])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), lists], names=["id", "ids"])
                begin = end

    key_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)
