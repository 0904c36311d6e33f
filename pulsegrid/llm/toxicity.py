"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel is gap-weighted (Lodhi et al., 2002) of order three: strings are alike as far as they share character
triples in order, each weighing DECAY to the power of the span that it covers (SPAN characters at most), so
"idxiot" and "i.d.i.o.t" stay near "idiot". The machine is linear in the kernel's Nyström features at a set of
landmarks, with a squared hinge loss.

A text is read through small windows (its units): every word, every two neighbouring words with the gap between
them, which covers "st upid" and phrases like "drop dead", every three short neighbours likewise, and letters that
are spaced out, joined. Labels belong to documents, so training is multiple-instance (Andrews et al., 2003): every unit of a clean
document is a negative example, and of a toxic document the units that most likely made it toxic are positive;
the machine then chooses these units anew, and adds the clean units that it gets most wrong. Copies of the
positive units with characters inserted or left out, or with a gap, are trained on too. A document's score is that of its most
toxic unit, turned into a probability by a logistic fit on documents that the machine was not trained on.

The machine is a sum over landmarks of kernels, and a kernel is a sum over triples, so all landmarks fold into
one weight for each triple: scoring a unit sums the weights of its own triples, whatever their number.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import STEP_ROWS, keep, map_rows, ship

DECAY, SPAN = 0.55, 7
LANDMARKS = 160
#: Bounds of the sample of labelled documents that training may collect, for each label: rows and bytes of text.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 5000
BYTES_TOXIC, BYTES_CLEAN = 4 << 20, 12 << 20
#: Longer words are scored by windows of so many characters that overlap by half, spaced-out letters by windows of SPACED.
LONGEST, SPACED = 24, 8
#: Bounds of the clean units that a round of training takes at random (a quarter as many are added as the hardest),
#: and of the pairs of neighbours that it chooses from; all clean words are chosen from.
NEGATIVES, PAIRS = 12_000, 60_000
#: Toxic documents that must share two neighbouring words for these to count as what made them toxic.
SHARED = 2
#: How many times likelier in toxic than in clean documents a unit of both must be to count so; a label may be wrong.
ODDS = 20.0
ROUNDS = 5
#: Weight of the errors, and the decision value that positive units are held to; clean ones are held to -1, but a clean
#: document has as many chances to come near as it has units.
COST, MARGIN = 4.0, 2.0
THRESHOLD = 0.3
SEED = 7
#: Words that a worker remembers, and the characters of texts that it scores at once.
REMEMBERED = 400_000
GROUP_CHARS = 1 << 20

#: Classes of characters: letters from 1, digits from 27, other letters, a unit's two ends, and the gap between words.
OTHER, START, END, GAP, CLASSES = 37, 38, 39, 40, 41


class _Classes(dict):
    """Maps code points for str.translate: a letter counts as its base letter, signs are left out."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        base = unicodedata.normalize("NFKD", c)[0].lower() if c != "ß" else "s"
        if "a" <= base <= "z":
            found = chr(1 + ord(base) - ord("a"))
        elif "0" <= base <= "9":
            found = chr(27 + ord(base) - ord("0"))
        else:
            found = chr(OTHER) if c.isalnum() else None
        if len(self) < 100_000:
            self[point] = found
        return found


_CLASSES = _Classes()
_START, _END, _GAP = bytes([START]), bytes([END]), bytes([GAP])


def inner(word: str) -> bytes:
    """The classes of a word's letters and digits."""
    return word.translate(_CLASSES).encode("latin-1")


def windows(classes: bytes, size: int = LONGEST) -> list[bytes]:
    """The classes between a word's ends; several windows that overlap by half where it is long, none for one letter."""
    if len(classes) <= size:
        return [_START + classes + _END] if len(classes) >= 2 else []
    whole = _START + classes + _END
    return [c for c in (whole[at : at + size] for at in range(0, len(whole) - size // 2, size // 2)) if len(c) >= 3]


def codes(word: str) -> list[bytes]:
    return windows(inner(word))


def spaced(letters: bytes) -> list[bytes]:
    """The windows of letters that stand alone, one after another: all of SPACED letters, or the whole."""
    return windows(letters) if len(letters) <= SPACED else [_START + letters[at : at + SPACED] + _END for at in range(len(letters) - SPACED + 1)]


def pair(a: bytes, b: bytes) -> bytes:
    """Two neighbours and the gap between them; of long ones the parts that meet."""
    if len(a) + len(b) > LONGEST:
        a, b = a[-LONGEST // 2 :], b[: LONGEST // 2]
    return _START + a + _GAP + b + _END


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The triples of n places in order, and their weights, scaled to unit norm for words of that length."""
    at = np.array([t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN])
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1)
    return np.ascontiguousarray(at.T), (weight / np.sqrt((weight**2).sum())).astype(np.float32)


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, triples) feature numbers of equally long words, and the triples' weights."""
    (i, j, k), weight = _triples(words.shape[1])
    wide = words.astype(np.int32)
    return (wide * (CLASSES * CLASSES))[:, i] + (wide * CLASSES)[:, j] + wide[:, k], weight


def _by_length(lists: list[bytes], columns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of classes) of equally long words, in steps whose features fit into bounded memory."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, 1_000_000 // (len(_triples(n)[1]) * columns))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            yield part, np.frombuffer(b"".join([lists[r] for r in part.tolist()]), np.uint8).reshape(-1, n)


def kernel_features(lists: list[bytes], table: np.ndarray) -> np.ndarray:
    """Sums of a table's rows (triples by columns) over the features of words."""
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    for rows, words in _by_length(lists, table.shape[1]):
        ids, w = features(words)
        out[rows] = np.tensordot(table[ids], w, axes=(1, 0))
    return out


class Machine:
    """The trained machine: a weight for each triple, a bias, and the logistic fit on documents."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def units(self, lists: list[bytes]) -> np.ndarray:
        """Decision values of units."""
        value = np.empty(len(lists))
        for rows, part in _by_length(lists):
            value[rows] = self.matrix(part)
        return value

    def matrix(self, part: np.ndarray) -> np.ndarray:
        ids, w = features(part)
        return self.weights[ids] @ w + self.bias

    def probability(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30))))


#: The decision value of a text without words.
FLOOR = -2.0


def _runs(parts: list[bytes]) -> Iterator[bytes]:
    """Letters of three or more parts in a row that are one letter each, joined."""
    held: list[bytes] = []
    for p in chain(parts, (b"  ",)):
        if len(p) == 1:
            held.append(p)
        else:
            if len(held) >= 3:
                yield b"".join(held)
            held = []


def _shorts(parts: list[bytes]) -> Iterator[bytes]:
    """Three neighbours of at most three letters each, not all of one, with their gaps."""
    for a, b, c in zip(parts, parts[1:], parts[2:], strict=False):
        if len(a) <= 3 and len(b) <= 3 and len(c) <= 3 and len(a) + len(b) + len(c) >= 4:
            yield _START + a + _GAP + b + _GAP + c + _END


def parts_of(text: str | None) -> list[bytes]:
    """The classes of a text's words, without words of signs alone."""
    return [c for c in map(inner, (text or "").lower().split()) if c]


def units(parts: list[bytes]) -> set[bytes]:
    """All units of a text but its pairs."""
    out = {w for p in set(parts) for w in windows(p)}
    out.update(w for run in _runs(parts) for w in spaced(run))
    out.update(_shorts(parts))
    return out


def pairs(parts: list[bytes]) -> set[bytes]:
    return {pair(a, b) for a, b in zip(parts, parts[1:], strict=False)}


def _noisy(unit: bytes, rng: np.random.Generator) -> bytes:
    """The unit with a character inserted, or doubled, or left out, here and there."""
    out = []
    for c in unit[1:-1]:
        draw = rng.random()
        if draw < 0.04 and len(unit) > 7:
            continue
        out.append(c)
        if draw > 0.86:
            out.append(1 + int(rng.integers(26)) if draw < 0.95 else c)
    return unit[:1] + bytes(out[:LONGEST]) + unit[-1:]


def _gapped(unit: bytes, rng: np.random.Generator) -> bytes:
    """The unit with a gap at some place, at least two characters from its ends."""
    at = int(rng.integers(3, len(unit) - 2))
    return unit[:at] + _GAP + unit[at:]


def _solve(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Newton steps for the squared-hinge machine; x ends in a constant column. Positive units are held to MARGIN."""
    wanted = np.where(y > 0, MARGIN, 1.0)
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(30):
        margin = wanted - y * (x @ w)
        on = np.flatnonzero(margin > 0)
        grad, hess = reg @ w, reg.copy()
        for at in range(0, len(on), 4096):
            i = on[at : at + 4096]
            part = x[i].astype(np.float64)
            grad -= 2 * part.T @ (c[i] * y[i] * margin[i])
            hess += 2 * (part * c[i, None]).T @ part
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _some(found: Iterable[set[bytes]], most: int) -> list[bytes]:
    """At most so many distinct units of all that are found, those with the smallest checksums, in bounded memory."""
    held: set[bytes] = set()
    limit = 1 << 32
    for some in found:
        held.update(u for u in some if zlib.crc32(u) < limit)
        while len(held) > 2 * most:
            limit = sorted(map(zlib.crc32, held))[most]
            held = {u for u in held if zlib.crc32(u) < limit}
    return sorted(held, key=lambda u: (zlib.crc32(u), u))[:most]


def train(docs: list[tuple[str | None, int]]) -> Machine | None:
    """The machine of labelled texts (text, 0 or 1); none where a label has fewer than four texts with words.

    The same texts in the same order always give the same machine. Documents are held as arrays of unit numbers,
    so memory grows with the sample's distinct units. Of pairs of neighbours, those that SHARED toxic documents
    share are numbered, and at most PAIRS others of clean documents.
    """
    rng = np.random.default_rng(SEED)
    texts: tuple[list[str], list[str]] = ([], [])
    for text, y in docs:
        if parts_of(text):
            texts[int(y)].append(text)
    if min(map(len, texts)) < 4:
        return None
    (fit_c, cal_c), (fit_t, cal_t) = (([t for i, t in enumerate(part) if i % 3 < 2], part[2::3]) for part in texts)
    shared = Counter(chain.from_iterable(pairs(parts_of(t)) for t in fit_t))
    shared = {p for p, n in shared.items() if n >= SHARED}
    numbers: dict[bytes, int] = {}
    bags: list[list[np.ndarray]] = []
    for part in (fit_t, fit_c):
        bags.append([])
        for text in part:
            parts = parts_of(text)
            found = [numbers.setdefault(u, len(numbers)) for u in sorted(units(parts) | (pairs(parts) & shared))]
            bags[-1].append(np.array(found, np.int32))
    words = list(numbers)
    in_toxic, in_clean = (np.bincount(np.concatenate(b), minlength=len(words)) for b in bags)
    others = _some((pairs(parts_of(t)) - shared for t in fit_c), PAIRS)
    words += others
    in_toxic, in_clean = np.append(in_toxic, np.zeros(len(others), int)), np.append(in_clean, np.ones(len(others), int))
    del numbers, others
    odds = np.log((in_toxic + 0.1) / len(fit_t)) - np.log((in_clean + 0.1) / len(fit_c))
    positive = Counter(words[u[np.argmax(odds[u])]] for u in bags[0] if len(u))
    own = (in_toxic > 0) & ((in_clean == 0) | (odds > np.log(ODDS)))  # units that may have made a document toxic
    all_clean = np.flatnonzero((in_clean > 0) & ~own)
    negative = all_clean[rng.permutation(len(all_clean))[:NEGATIVES]]
    for at in range(ROUNDS):
        machine = _machine(positive, [words[i] for i in np.unique(negative).tolist()], rng)
        if at + 1 == ROUNDS:
            break
        value = np.concatenate([machine.units(words[i : i + 50_000]) for i in range(0, len(words), 50_000)])
        chosen: Counter[bytes] = Counter()
        for u in bags[0]:
            mine = u[own[u]]
            if len(mine):
                best = mine[np.argmax(value[mine])]
                # a label may be wrong: later on a unit of one document alone must look toxic to the machine
                if at < ROUNDS // 2 or value[best] > 0 or in_toxic[best] >= SHARED:
                    chosen[words[best]] += 1
                chosen.update(words[i] for i in mine[value[mine] > 0.5].tolist() if i != best)
        positive = chosen or positive
        hard = all_clean[np.argsort(-value[all_clean], kind="stable")[: NEGATIVES // 4]]
        negative = np.concatenate([negative, hard])
    del bags
    tops = np.array(Scorer(machine).values(cal_t + cal_c))
    label = np.array([1.0] * len(cal_t) + [0.0] * len(cal_c))
    slope, offset = _logistic(tops, label)
    return Machine(machine.weights, machine.bias, slope, offset)


def _machine(positive: Counter, negative: list[bytes], rng: np.random.Generator) -> Machine:
    lists, weight, label = [], [], []
    for u, n in sorted(positive.items()):
        lists.append(u)
        weight.append(min(n, 20) / 2 + 0.5)
        label.append(1.0)
        for _ in range(2 if n > 1 else 0):
            noisy = _noisy(u, rng)
            if len(noisy) >= 4:
                lists.append(noisy)
                weight.append(min(n, 20) / 8 + 0.25)
                label.append(1.0)
        if n > 1 and len(u) >= 7 and _GAP not in u:
            once = _gapped(u, rng)
            lists += [once, _gapped(once, rng)]
            weight += [min(n, 20) / 8 + 0.25] * 2
            label += [1.0] * 2
    lists += negative
    weight += [1.0] * len(negative)
    label += [-1.0] * len(negative)
    frequent = [u for u, _ in sorted(positive.items(), key=lambda p: (-p[1], p[0]))[: LANDMARKS * 3 // 4]]
    picked = frequent + [negative[i] for i in rng.permutation(len(negative))[: LANDMARKS - len(frequent)]]
    table = np.zeros((CLASSES**3, len(picked)), np.float32)
    for m, u in enumerate(picked):
        ids, v = features(np.frombuffer(u, np.uint8)[None, :])
        np.add.at(table[:, m], ids[0], v)
    kmm = kernel_features(picked, table).astype(np.float64)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    some = values > 1e-5 * values.max()
    whiten = vectors[:, some] / np.sqrt(values[some])
    x = np.hstack([kernel_features(lists, table) @ whiten.astype(np.float32), np.ones((len(lists), 1), np.float32)])
    y, c = np.array(label), COST * np.array(weight)
    c[y > 0] *= (max(c[y < 0].sum(), 1.0) / c[y > 0].sum()) ** 0.5
    w = _solve(x, y, c)
    return Machine((table @ (whiten @ w[:-1])).astype(np.float32), float(w[-1]), 1.0, 0.0)


def _logistic(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic fit with smoothed targets (Platt, 1999), by Newton steps that are halved until the loss falls.

    Both classes weigh alike: their shares are the sample's bounds.
    """
    n1, n0 = label.sum(), (1 - label).sum()
    weight = np.where(label > 0, 0.5 / n1, 0.5 / n0) * (n1 + n0)
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([value, np.ones(len(value))], axis=1)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * beta[0] ** 2)

    beta, at = np.zeros(2), loss(np.zeros(2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        g = x.T @ (weight * (p - target)) + [1e-3 * beta[0], 0]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-9 and loss(beta - step) > at:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        beta = beta - step
        at = loss(beta)
    return float(max(beta[0], 1e-6)), float(beta[1])


class Scorer:
    """Scores whole texts; remembers the classes and values of words."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[str, bytes] = {}
        self.value: dict[bytes, float] = {}

    def many(self, texts: list[str | None]) -> list[float]:
        return [self.machine.probability(v) for v in self.values(texts)]

    def values(self, texts: list[str | None]) -> list[float]:
        """The decision value of each text's most toxic unit."""
        out: list[float] = []
        group: list[str] = []
        room = GROUP_CHARS
        for text in texts:
            group.append(text or "")
            room -= len(group[-1])
            if room <= 0:
                out += self._group(group)
                group, room = [], GROUP_CHARS
        return out + self._group(group)

    def _classes(self, wanted: set[str]) -> dict[str, bytes]:
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known.clear()
            self.value.clear()
        for w in wanted.difference(self.known):
            self.known[w] = inner(w)
        return self.known

    def _worst(self, owners: list[int], lists: list[bytes], out: np.ndarray) -> None:
        if lists:
            np.maximum.at(out, np.array(owners), self.machine.units(lists))

    def _group(self, texts: list[str]) -> list[float]:
        split = [t.lower().split() for t in texts]
        distinct = set().union(*split)
        known = self._classes(distinct)
        numbers: dict[bytes, int] = {}
        local = {w: numbers.setdefault(known[w], len(numbers)) for w in distinct}
        words = list(numbers)
        ids = np.fromiter(map(local.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        text_of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        size = np.fromiter(map(len, words), np.int64, len(words))
        some = size[ids] > 0 if len(ids) else np.zeros(0, bool)
        ids, text_of = ids[some], text_of[some]
        out = np.full(len(texts), FLOOR)
        if not len(ids):
            return out.tolist()
        fresh = [(w, u) for w in numbers if w not in self.value for u in windows(w)]
        self.value.update(dict.fromkeys((w for w in numbers if w not in self.value), FLOOR))
        for (w, _), v in zip(fresh, self.machine.units([u for _, u in fresh]).tolist(), strict=True):
            self.value[w] = max(self.value[w], v)
        own = np.fromiter(map(self.value.__getitem__, words), float, len(words))
        np.maximum.at(out, text_of, own[ids])
        beside = np.flatnonzero(text_of[:-1] == text_of[1:])
        if len(beside):
            both, where = np.unique(ids[beside] * len(words) + ids[beside + 1], return_inverse=True)
            np.maximum.at(out, text_of[beside], self._pairs(words, size, both // len(words), both % len(words))[where])
        owners, lists = self._rare(words, size, ids, text_of)
        self._worst(owners, lists, out)
        return out.tolist()

    def _pairs(self, words: list[bytes], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The values of pairs of words, put together as matrices of equally long parts."""
        flat = np.frombuffer(bytes(LONGEST) + b"".join(words) + bytes(LONGEST), np.uint8)
        ends = LONGEST + np.cumsum(size)
        # a word's first and last characters; what lies beyond the word is not read
        heads, tails = flat[(ends - size)[:, None] + np.arange(LONGEST)], flat[ends[:, None] + np.arange(-LONGEST, 0)]
        long = size[a] + size[b] > LONGEST
        la, lb = np.where(long, np.minimum(size[a], LONGEST // 2), size[a]), np.where(long, np.minimum(size[b], LONGEST // 2), size[b])
        key = la * 64 + lb
        order = np.argsort(key, kind="stable")
        out = np.empty(len(a))
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            m, n = int(la[rows[0]]), int(lb[rows[0]])
            step = max(1, 1_000_000 // len(_triples(m + n + 3)[1]))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                whole = np.empty((len(part), m + n + 3), np.uint8)
                whole[:, 0], whole[:, m + 1], whole[:, -1] = START, GAP, END
                whole[:, 1 : m + 1] = tails[a[part], LONGEST - m :]
                whole[:, m + 2 : -1] = heads[b[part], :n]
                out[part] = self.machine.matrix(whole)
        return out

    def _rare(self, words: list[bytes], size: np.ndarray, ids: np.ndarray, text_of: np.ndarray) -> tuple[list[int], list[bytes]]:
        """The units of spaced-out letters and of short neighbours, with the texts they are in."""
        short = size[ids] <= 3
        three = np.flatnonzero(short[:-2] & short[1:-1] & short[2:] & (text_of[:-2] == text_of[2:]))
        total = size[ids[three]] + size[ids[three + 1]] + size[ids[three + 2]]
        owners, lists = [], []
        for at in three[total >= 4].tolist():
            owners.append(int(text_of[at]))
            lists.append(_START + words[ids[at]] + _GAP + words[ids[at + 1]] + _GAP + words[ids[at + 2]] + _END)
        for text in np.unique(text_of[three[total == 3]]).tolist():
            first, last = np.searchsorted(text_of, [text, text + 1])
            for run in _runs([words[i] for i in ids[first:last].tolist()]):
                for unit in spaced(run):
                    owners.append(text)
                    lists.append(unit)
        return owners, lists


def _scores(machine: Machine | None, rate: float, threshold: float):
    scorer = Scorer(machine) if machine else None

    def step(ids: list, texts: list) -> list[tuple]:
        found = scorer.many(texts) if scorer else [rate] * len(texts)
        return [(i, p, int(p >= threshold)) for i, p in zip(ids, found, strict=True)]

    return step


def fit(docs: DataFrame, labels: DataFrame, allowed=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Machine | None, float]:
    """The machine and the labels' rate, from a bounded sample of the labelled documents.

    allowed: a condition on the id column of labels that may be learned from. For each label the sample holds the
    SAMPLE_TOXIC or SAMPLE_CLEAN ids with the smallest hashes, chosen from the labels alone, as far as their texts
    fit into BYTES_TOXIC or BYTES_CLEAN; only these documents' texts are read. Rows with a null id or label are
    not used; an id that is labelled twice counts as toxic if once; of texts with one id the last is used.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if allowed is not None:
        usable = usable.where(allowed(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = [r for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    if not picked:
        return None, rate
    sample = docs.sparkSession.createDataFrame(picked, "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    once = keep(texts.groupBy("id", "y").agg(F.max("text").alias("text")))
    sizes = {r.id: r.n for r in once.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()}
    room, fits = {1: BYTES_TOXIC, 0: BYTES_CLEAN}, []
    for r in picked:
        if sizes.get(r.id, 0) <= room[r.y]:
            room[r.y] -= sizes.get(r.id, 0)
            fits.append((r.id,))
    chosen = once.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "id long")), "id")
    rows = sorted(chosen.collect(), key=lambda r: r.id)
    return train([(r.text, r.y) for r in rows]), rate


def score(docs: DataFrame, machine: Machine | None, rate: float = 0.0, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs, of its whole text and nothing else.

    Null and empty texts get the score of a text without words; long ones are scored whole, a group of texts at a
    time. Without a machine (no labels, or only one) every score is the labels' rate. Null ids and repeated rows
    pass through, and ties need no order; other columns, whatever their names, are not read. An empty table gives
    an empty result. The weights, 64,000 numbers, travel with the function.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, ["doc_id", "text"], _scores, "doc_id long, score double, predicted int", (machine, rate, threshold))


def keep_clean(docs: DataFrame, machine: Machine | None, rate: float = 0.0, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns.

    Without a machine every row stays: a rate alone says nothing about a text. Null and empty texts stay or go by
    the score of a text without words; long texts count whole; null ids and repeated rows are each decided. Other
    columns may have any names. An empty table stays empty.
    """
    if machine is None:
        return docs
    ship(docs.sparkSession)

    @F.pandas_udf(T.BooleanType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(machine)
        for texts in batches:
            yield pd.Series([p < threshold for at in range(0, len(texts), STEP_ROWS) for p in scorer.many(list(texts[at : at + STEP_ROWS]))], dtype=bool)

    return docs.where(clean(F.col(text_col)))
