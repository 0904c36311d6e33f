"""Token counts with a whole-token shortcut.

The vocabulary is a sentencepiece BPE model whose normaliser leaves texts as they are. In it a space is
the mark U+2581, and one such mark is put before a text. ``proof`` shows, from the vocabulary alone, that
no piece holds a mark after another character; so no merge ever joins a character with a mark behind it,
and a text's tokens are those of its runs of marks with the characters behind them (its pre-tokens).
``whole_tokens`` then encodes every vocabulary string alone, offline, and keeps those that come out as
one token. Pre-tokens among these count one each without merging; the rest are merged by the library and
remembered. Texts that hold a string of the vocabulary's special kinds are encoded whole by the library.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_rows, utf8

MARK = "▁"
#: Pre-tokens whose counts a worker remembers, and the characters of texts that it counts at once.
REMEMBERED = 400_000
GROUP_CHARS = 1 << 20


@lru_cache(maxsize=4)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def proof(path: str) -> bool:
    """Whether texts may be split before each run of marks without changing their tokens."""
    sp = load(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    inner = [p for p in pieces if MARK in p.lstrip(MARK) and not sp.is_control(sp.piece_to_id(p))]
    probes = ["a  b", " a", "a ", "é \n b", "x▁y", "　a b"]
    plain = all("".join(sp.encode(t, out_type=str)).startswith(MARK) or not t for t in probes)
    same = all(sp.decode(sp.encode(t)) == t.replace(MARK, " ") for t in probes)
    return not inner and plain and same


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, without their leading mark, that encode alone as one token."""
    sp = load(path)
    texts = [sp.id_to_piece(i)[1:] for i in range(sp.get_piece_size()) if sp.id_to_piece(i).startswith(MARK) and not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)]
    return frozenset(t.replace(MARK, " ") for t, ids in zip(texts, sp.encode([t.replace(MARK, " ") for t in texts], num_threads=1), strict=True) if len(ids) == 1)


@lru_cache(maxsize=4)
def _prepared(path: str, digest: str) -> frozenset[str]:
    if not proof(path):
        raise ValueError("this vocabulary has pieces across spaces, so texts cannot be split there")
    return whole_tokens(path)


def prepared(path: str) -> frozenset[str]:
    """The whole tokens of a vocabulary whose proof holds, worked out once for each content of the file."""
    return _prepared(path, hashlib.sha256(Path(path).read_bytes()).hexdigest())


class Counter:
    """Counts tokens of whole texts; one for each worker task."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        self.sp = load(path)
        self.start = dict.fromkeys(prepared(path) if whole is None else whole, 1)
        self.start[""] = len(self.sp.encode("a ")) - len(self.sp.encode("a"))  # a lone mark at the end
        #: Their strings get no shortcut.
        self.specials = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if self.sp.is_control(i) or self.sp.is_unknown(i)]
        self.known = self.start.copy()

    def many(self, texts: list[str | None]) -> list[int]:
        """The numbers of tokens of texts; new pre-tokens are merged once for GROUP_CHARS of text."""
        out: list[int] = []
        group: list[str] = []
        room = GROUP_CHARS
        for text in texts:
            group.append(text or "")
            room -= len(group[-1])
            if room <= 0:
                out += self._group(group)
                group, room = [], GROUP_CHARS
        return out + self._group(group)

    def __call__(self, text: str | None) -> int:
        return self.many([text])[0]

    def _group(self, texts: list[str]) -> list[int]:
        split = []
        for text in texts:
            if not text or any(s in text for s in self.specials):
                split.append(None)
                continue
            parts = text.replace(MARK, " ").split(" ")
            split.append(_joined(parts) if "" in parts else parts)  # runs of spaces belong to the pre-token behind them
        wanted = set().union(*(p for p in split if p))
        fresh = list(wanted.difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = self.start.copy()
            fresh = list(wanted.difference(self.known))
        if fresh:
            self.known.update(zip(fresh, map(len, self.sp.encode(fresh, num_threads=1)), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, parts)) if parts is not None else len(self.sp.encode(text)) if text else 0 for text, parts in zip(texts, split, strict=True)]


def _joined(parts: list[str]) -> list[str]:
    """Pre-tokens from a split at every space: empty parts are further spaces before the next."""
    out, spaces = [], 0
    for at, part in enumerate(parts):
        if part or at == len(parts) - 1:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return out


def _counts(path: str, limit: int, whole: frozenset[str]):
    count = Counter(path, whole)

    def step(ids: list, texts: list) -> list[tuple]:
        return [(i, len(utf8(text)), n, n > limit) for i, text, n in zip(ids, texts, count.many(texts), strict=True)]

    return step


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, of its whole text.

    Null and empty texts have 0 bytes and 0 tokens; long ones are counted whole, and what a worker remembers is
    bounded. Null ids, repeated rows and ties are each returned. Other columns, whatever their names, are not read.
    An empty table gives an empty result. Nothing is shuffled. The proof and the whole tokens are worked out once,
    where the query is made, and travel with the function (some 30,000 strings).
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, ["doc_id", "text"], _counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", (path, limit, prepared(path)))
