"""Packing documents into fixed-length sequences by the shortest-pack-first rule over a length histogram.

A document's ids and one closing id are cut into pieces of the sequence length and a rest. Full pieces are
sequences of their own. The rests are packed on their histogram alone (Krell et al., "Efficient Sequence
Packing without Cross-contamination", 2021): lengths go longest first, each rest into the shortest pack, that
with the most room left, and a new pack where none has room; equal packs take one rest each at a time. That
gives a few packing patterns with counts. Patterns meet documents by rank: the k-th rest of a length takes the
k-th place that the patterns have for it.

The driver sees one count for each length and bucket group, never a row of a document. The patterns are
at most twice as many as there are lengths, and a pattern has at most sqrt(2 * size) different lengths,
which bounds the places that are broadcast: under 100,000 at 1,024.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm.common import keep, map_rows, ship

SIZE = 1024
CLOSING_ID = 0
#: How the byte-level vocabulary splits a text before its merges (fixed by the public file format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks whose ids a worker remembers, and the characters of texts that it encodes at once.
REMEMBERED = 400_000
GROUP_CHARS = 1 << 20
#: Rests of one length that are ranked together in one group, on average, and the most groups of a length, whose
#: counts one task sums up; beyond that groups grow.
RANK_GROUP, RANK_GROUPS = 200, 100_000


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that the byte-level file format writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def ranks(path: str) -> tuple[dict[bytes, int], tuple[str, ...]]:
    """The vocabulary of the file by bytes, checked to be in the order of its merges; its added strings.

    Merging the pair whose joint has the lowest id is then what the library does, as long as every
    vocabulary string encodes alone as one token; the tests prove that offline for the whole file.
    """
    spec = json.loads(Path(path).read_text())
    added = tuple(t["content"] for t in spec["added_tokens"])
    letters = byte_letters()
    found = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if any(spec["model"]["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    return found, added


class Encoder:
    """Gives texts' ids as little-endian unsigned 32-bit bytes, the same as the library's.

    A single space between other characters always starts a pre-token, so a text is cut there and the ids
    of a chunk with its space depend on nothing else. Chunks seen before are remembered; the new ones of
    many texts are merged in one call and cut apart by their tokens' byte lengths. Texts in which spaces
    meet other white space are merged whole, and texts that hold an added string go to the library.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary, self.added = ranks(path)
        self.core = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens={})
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, i in vocabulary.items():
            self.width[i] = len(word)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text).astype("<u4", copy=False)

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of chunks that neither start nor end with white space."""
        ids = self.ids(" " + " ".join(chunks))
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        data, at = ids.tobytes(), 0
        for chunk, cut in zip(chunks, (cuts * 4).tolist(), strict=True):
            self.known[chunk] = data[at:cut]
            at = cut

    def many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        room = GROUP_CHARS
        for text in texts:
            group.append(text or "")
            room -= len(group[-1])
            if room <= 0:
                out += self._group(group)
                group, room = [], GROUP_CHARS
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if t else [] for t in texts]
        fresh = set().union(*(p[1:] for p in split)).difference(self.known)
        fresh = [c for c in fresh if c and not c[0].isspace() and not c[-1].isspace()]
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = [c for c in set().union(*(p[1:] for p in split)) if c and not c[0].isspace() and not c[-1].isspace()]
            self.learn(fresh)
        get = self.known.get
        out = []
        for text, parts in zip(texts, split, strict=True):
            if any(s in text for s in self.added):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            found = list(map(get, parts[1:]))
            if None in found or parts and parts[0][-1:].isspace():
                out.append(self.ids(text).tobytes())
            else:
                out.append(self.ids(parts[0]).tobytes() + b"".join(found) if parts else b"")
        return out


def _pieces(path: str, size: int):
    encode = Encoder(path)
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def step(ids: list, texts: list) -> list[tuple]:
        rows = []
        for i, data in zip(ids, encode.many(texts), strict=True):
            data += closing
            total = len(data) // 4
            for start in range(0, total, size):
                part = data[4 * start : 4 * (start + size)]
                rows.append((i, start, len(part) // 4, zlib.crc32(part), total))
        return rows

    return step


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each row's ids cut into pieces of at most size."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_rows(picked, ["doc_id", "text"], _pieces, schema, (path, size))


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns (count, ((length, times), ...)) for a histogram of lengths from 1 to size - 1.

    Longest first, each rest goes to the shortest pack, one at a time; a group of equal packs takes one each in
    one step. Where none has room, a new pack is the shortest until it is full, so that many packs open at once.
    """
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        count = histogram[length]
        while count:
            most = max((r for r, packs in room.items() if packs), default=0)
            if most < length:
                fits = size // length
                packs, times = (count // fits, fits) if count >= fits else (1, count)
                room[size - times * length].append((packs, ((length, times),)))
                count -= packs * times
                continue
            packs, held = room[most].pop()
            use = min(packs, count)
            if use < packs:
                room[most].append((packs - use, held))
            again = held[-1][0] == length
            more = (*held[:-1], (length, held[-1][1] + 1)) if again else (*held, (length, 1))
            room[most - length].append((use, more))
            count -= use
    return [p for packs in room.values() for p in packs]


def places(found: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """Where the k-th rest of each length goes, as sorted intervals of ranks.

    Row: length, first rank, sequence of that rank, times the length is in one sequence, first offset.
    """
    used: Counter[int] = Counter()
    rows = []
    base = 0
    for count, held in sorted(found, key=lambda p: p[1]):
        offset = 0
        for length, times in held:
            rows.append((length, used[length], base, times, offset))
            used[length] += count * times
            offset += length * times
        base += count
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _placed(df: DataFrame, at: dict[str, np.ndarray], first: int, span: int) -> DataFrame:
    """Adds sequence_id and offset to rows with length and rank, by binary search in the intervals."""
    names = [f.name for f in df.schema if f.name != "rank"]
    start = at["length"] * span + at["rank"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(start, length * span + rank, "right") - 1
            k = rank - at["rank"][i]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            extra = [first + at["sequence"][i] + k // at["times"][i], at["offset"][i] + length * (k % at["times"][i])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in extra)], names=[*names, "sequence_id", "offset"])

    ship(df.sparkSession)
    schema = ", ".join([f"{n} {df.schema[n].dataType.simpleString()}" for n in names] + ["sequence_id long", "offset long"])
    return df.mapInArrow(run, schema)


def _ranked(df: DataFrame, group: str, order: list[str], counts: dict[int, int]) -> DataFrame:
    """Adds rank, 0 to n - 1 within each value of group (a long), without gathering a value in one task.

    counts: rows of each value, which are at most as many as there are lengths. Each value is dealt by hash of
    order, which tells all rows apart, into groups of about RANK_GROUP rows; rows are numbered within these, and
    the groups' counts give each group its first rank.
    """
    many = {v: min(RANK_GROUPS, -(-n // RANK_GROUP)) for v, n in counts.items() if n > RANK_GROUP}
    parts = F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col(group)], F.lit(1)) if many else F.lit(1)
    dealt = df.withColumn("part", F.pmod(F.xxhash64(*order), parts))
    key = [group, "part"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    return numbered.join(firsts, key).withColumn("rank", F.col("first") + F.col("at")).drop("part", "at", "first")


def pack(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the columns of ``pieces``, sequence_id and offset.

    Sequences are numbered from 0: first those of full pieces, then the packed ones. Within a sequence offsets
    have no gaps. Null and empty texts have the closing id alone; long texts are encoded whole and cut into
    pieces. Repeated rows are packed once each, told apart by their place in the checkpoint; null ids stay null.
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    cut = keep(pieces(docs, path, size, id_col, text_col)).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "start", "ids_crc32", "row"]
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = histogram.pop(size, 0)
    at = places(patterns(histogram, size))
    span = max([1, *histogram.values()]) + 1
    ranked = _ranked(cut, "length", order, histogram | {size: full}).drop("row")
    whole = ranked.where(F.col("length") == size).withColumns({"sequence_id": F.col("rank"), "offset": F.lit(0).cast("long")}).drop("rank")
    out = whole.unionByName(_placed(ranked.where(F.col("length") < size), at, full, span)) if histogram else whole
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
