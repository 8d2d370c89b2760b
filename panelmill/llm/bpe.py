"""Encoding with a public byte-level BPE vocabulary by recursive queries.

Texts are cut into words by the vocabulary's pattern; a word's encoding depends on nothing else,
so each task encodes the distinct words of a stretch of text and looks the rest up.  The encoding
itself is a recursive query of an embedded DuckDB: rows of (word, position, token) meet the merge
table, each word contracts its pair of least rank from the left until no such pair is left, and words
without a mergeable pair leave the recursion; an ordered aggregation gives each word's ids.

Pairs that a contraction makes always rank after it (checked when a vocabulary is read), so all
places of a word's least pair contract in one step, from the left, and a run of thousands of equal
characters takes a dozen steps.  A word is first cut where no token of the vocabulary has the two
bytes side by side: no merge reaches over such a place.  The recursion runs in instalments, so that
what it holds stays bounded however long a word is.

Nothing is shuffled: this is one pass over the texts, whatever their number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of text whose words are encoded by one recursive query.
STRETCH = 3_000_000
#: Words kept for later stretches before the store starts afresh (it only saves work).
KEPT_WORDS = 400_000
#: Rows of (step, word, position) that one recursive query may produce before the next takes over.
HELD_ROWS = 2_000_000
#: Bytes of the words of one recursive query (a single longer word is one by itself).
QUERY_BYTES = 160_000

# Fixed value: the pattern that cuts texts into words for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in ASCII only, where the standard engine is twice as fast.
ASCII_PATTERN = (
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t\n\r\f\v]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)

CONTRACT = """
WITH RECURSIVE bpe(step, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM seed
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN hit THEN merged ELSE tok END
  FROM (
    SELECT *, n - coalesce(max(CASE WHEN NOT hit THEN n END)
                           OVER (PARTITION BY word ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM (
      SELECT *, coalesce(rank = least, false) AS hit
      FROM (
        SELECT p.step, p.word, p.pos, p.n, p.tok, m.merged, m.rank, min(m.rank) OVER (PARTITION BY p.word) AS least
        FROM (SELECT *, lead(tok) OVER w AS next, row_number() OVER w AS n FROM bpe WHERE step < {steps}
              WINDOW w AS (PARTITION BY word ORDER BY pos)) p
        LEFT JOIN merges m ON m.a = p.tok AND m.b = p.next)
      WHERE least IS NOT NULL))
  WHERE place % 2 = 1)  -- in a run of overlapping pairs the first, third, ... contract; the tokens between are taken up
SELECT step = {steps} AS unfinished, word, pos, tok
FROM (SELECT * FROM bpe QUALIFY step = max(step) OVER (PARTITION BY word))
"""
#: Ordered aggregation of the finished words.
DECODE = "SELECT word, list(tok ORDER BY pos) AS ids FROM finished GROUP BY word"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies, by rule: printable Latin-1
    stands for itself, the rest for the characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte ids, merges (a, b) -> (rank, merged id) and neighbouring bytes of a vocabulary file.

    A vocabulary in which a merge may make a pair of lower rank than its own is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, alphabet = model["vocab"], byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_ids = np.zeros(256, "int32")
        for ch, b in alphabet.items():
            self.byte_ids[b] = ids[ch]
        self.merges = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)]
        made: dict[int, int] = {}
        for _, _, rank, merged in self.merges:
            made[merged] = rank
        if any(made.get(x, -1) >= rank for a, b, rank, _ in self.merges for x in (a, b)):
            raise ValueError(f"{path}: merges are not in the order in which they build on each other")
        #: [x, y]: some merge has byte x before byte y inside its token.
        self.side_by_side = np.zeros((256, 256), bool)
        for a, b in pairs:
            raw = [alphabet[c] for c in a + b]
            self.side_by_side[raw[:-1], raw[1:]] = True


class Encoder:
    """Encodes texts; holds one DuckDB connection with the merge table and the words met so far."""

    def __init__(self, path: str):
        import duckdb
        import regex

        self.vocabulary = Vocabulary(path)
        # Bounded by HELD_ROWS; nothing is written to the worker's disk.
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
        a, b, rank, merged = (pa.array(c, pa.int64()) for c in zip(*self.vocabulary.merges))
        self._db.register("merge_rows", pa.table({"a": a, "b": b, "rank": rank, "merged": merged}))
        self._db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self._db.unregister("merge_rows")
        self._cut, self._cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        #: word -> its ids as little-endian int32 bytes
        self._known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return self._cut_ascii(text) if text.isascii() else self._cut(text)

    def _contract(self, raw: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Index and ids of each word."""
        length = np.fromiter(map(len, raw), "int64", len(raw))
        owner = np.repeat(np.arange(len(raw)), length)
        octets = np.frombuffer(b"".join(raw), "uint8")
        apart = np.ones(len(octets), bool)  # a piece begins here
        apart[1:] = (owner[1:] != owner[:-1]) | ~self.vocabulary.side_by_side[octets[:-1], octets[1:]]
        piece = np.cumsum(apart) - 1
        seed = pa.table({"word": piece, "pos": np.arange(len(octets)), "tok": self.vocabulary.byte_ids[octets].astype("int64")})
        done: list[pa.Table] = []
        while seed.num_rows:
            steps = int(np.clip(HELD_ROWS // seed.num_rows, 1, 1024))
            self._db.register("seed", seed)
            rows = self._db.sql(CONTRACT.format(steps=steps)).to_arrow_table()
            self._db.unregister("seed")
            unfinished = rows["unfinished"]
            done.append(rows.filter(pc.invert(unfinished)).select(["word", "pos", "tok"]))
            seed = rows.filter(unfinished).select(["word", "pos", "tok"])
        finished = pa.concat_tables(done)
        of_piece = owner[apart]
        finished = finished.set_column(0, "word", pa.array(of_piece[finished["word"].to_numpy()]))
        self._db.register("finished", finished)
        decoded = self._db.sql(DECODE).to_arrow_table().combine_chunks()
        self._db.unregister("finished")
        if decoded.num_rows:
            ids = decoded["ids"].combine_chunks() if isinstance(decoded["ids"], pa.ChunkedArray) else decoded["ids"]
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4")
            for w, a, b in zip(decoded["word"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                yield w, flat[a:b].tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words not met yet; words of like length share a query."""
        raw = sorted(((w.encode("utf-8", "surrogatepass"), w) for w in words), key=lambda x: len(x[0]))
        size = np.cumsum([len(r) for r, _ in raw])
        at = 0
        while at < len(raw):
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + QUERY_BYTES, "right")))
            part = raw[at:to]
            for i, ids in self._contract([r for r, _ in part]):
                self._known[part[i][1]] = ids
            at = to

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for an empty and a null one."""
        cut = [self.words(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self._known)
        if len(self._known) + len(new) > KEPT_WORDS:
            self._known = {}
            new = set(chain.from_iterable(cut))
        if new:
            self.learn(new)
        look = self._known.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), "<i4") for words in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file; later tasks of a worker find its words known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def stretches(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Consecutive rows of about STRETCH characters (bytes), at least one row each."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + STRETCH, "right")))
        yield ids.slice(at, to - at), texts.slice(at, to - at).to_pylist()
        at = to


def encode_texts(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", counts_only: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (list of integers) of every row, or ``n_tokens`` if ``counts_only``.

    ``vocabulary`` is the path of the vocabulary's JSON file on every worker.  No special tokens are
    added, and what looks like one is ordinary text.  Defined cases: an empty and a null text have no
    ids (an empty list, 0 tokens); blank texts and control characters are text like any other; texts
    are taken whole; repeated rows come out as often as they come in; a null ``doc_id`` stays null; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    value = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, e = to_arrow_schema(schema), encoder(vocabulary)
        for batch in batches:
            for keys, texts in stretches(batch.column(0), batch.column(1)):
                encoded = e.encode(texts)
                lengths = np.fromiter(map(len, encoded), "int64", len(encoded))
                if counts_only:
                    out = pa.array(lengths)
                else:
                    flat = np.concatenate(encoded) if encoded else np.zeros(0, "int32")
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, out.cast(target.field(1).type)], schema=target)

    return df.select(doc_id, text).mapInArrow(run, schema)
