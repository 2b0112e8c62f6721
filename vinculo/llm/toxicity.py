"""Toxicity by a gapped subsequence kernel SVM with Nystroem landmarks, trained on labelled documents as bags of windows."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.functions.runtime import ROW, with_rows
from vinculo.llm.texts import alone, map_batches, randoms

#: Labelled documents of each class from which the model is fitted: those with the smallest hashes.
MAX_TOXIC, MAX_CLEAN = 2500, 6000
#: Parts of each of these documents that the fit takes, those with the smallest hashes, and the characters of a part: a
#: longer sentence is several parts. This bounds the bytes of the fit's one task; scores read all of every text.
MAX_SENTENCES, MAX_SENTENCE = 300, 400
#: Clean documents of these on which scores are calibrated.
CALIBRATION = 2000
#: Windows of those clean documents held as negatives: the most frequent ones.
MAX_NEGATIVES = 100_000
#: Phrases of two words that the model may hold.
MAX_PHRASES = 60
LANDMARKS = 192
SPAN, DECAY, WIDTH = 6, 0.5, 24
CACHE_WORDS = 200_000
#: Kernel value from which a word is taken as a spelling of a phrase's word.
ALIKE = 0.5

#: Characters that stand for letters in written insults (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”‘’«»¡¿–—"
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_STEPS = [(a, b) for a, b in itertools.combinations(range(1, SPAN), 2)]
#: Sentence ends: marks before white space, marks that need none (fixed values), line ends.
_STOPS = re.compile(r"(?<=[.!?;:…])\s+|(?<=[。！？；：｡؟۔।॥၊။።])\s*|[\n\r\x0b\x0c\x85\u2028\u2029]+")


def units(text: str | None) -> set[str]:
    """The distinct one-word windows: case-folded, without edge marks; spelled-out letters joined."""
    if not text:
        return set()
    words = text.casefold().split()
    found = set(words)
    if sum(map(len, words)) < 2 * len(words) or any(len(w) == 1 for w in found):
        found.update(m.replace(" ", "") for m in _SPACED.findall(" ".join(words)))
    return {w.strip(_EDGES) or w for w in found}


def sentences(text: str | None) -> list[str]:
    """The text's sentences: parts between end marks or line ends."""
    return [s for s in _STOPS.split(text or "") if s.strip()]


def parts_of(text: str | None) -> list[str]:
    """The text's sentences, those above MAX_SENTENCE characters cut between words (a longer word within); a cut's last word begins the next part too."""
    out = []
    for s in sentences(text):
        at = 0
        while len(s) - at > MAX_SENTENCE:
            end = s.rfind(" ", at + 1, at + MAX_SENTENCE + 1)
            end = end if end > at else at + MAX_SENTENCE
            out.append(s[at:end])
            back = s.rfind(" ", at + 1, end)
            at = back if back > at else end
        out.append(s[at:])
    return out


def couples(sentence: str) -> Iterator[tuple[str, str]]:
    """The two-word windows of a sentence."""
    words = [w.strip(_EDGES) or w for w in sentence.casefold().split()]
    return zip(words, words[1:], strict=False)


def folded(window: str) -> str:
    """Letters and digits only, words parted by one space, compatibility forms composed; look-alike signs read as letters where letters are around."""
    if " " in window:
        return " ".join(map(folded, window.split(" ")))
    if any(c.isalpha() for c in window):
        window = window.translate(LOOKALIKES)
    if not window.isascii():
        window = unicodedata.normalize("NFKC", window)
    return "".join(c for c in window if c.isalnum())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes 1..63 of the windows' pieces of WIDTH characters (space 61, begin 62, end 63), and the window of each piece."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        w = f"\x02{folded(w)}\x03"
        for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
            pieces.append(w[at : at + WIDTH])
            owner.append(i)
    raw = np.frombuffer("".join(p.ljust(WIDTH, "\0") for p in pieces).encode("utf-32-le"), dtype=np.uint32).reshape(-1, WIDTH)
    small = np.where(raw >= 128, 37 + raw % 24, np.where(raw >= 97, raw - 96, np.where(raw >= 48, 27 + (raw - 48) % 10, raw)))
    small = np.where(raw == 32, 61, np.where(raw == 2, 62, np.where(raw == 3, 63, small)))
    return small.astype(np.int32), np.array(owner, dtype=np.int64)


def subsequences(codes: np.ndarray) -> np.ndarray:
    """All 3-character subsequences within SPAN: four times the feature number plus the gap's length, or -1."""
    out = []
    padded = np.pad(codes, ((0, 0), (0, SPAN)))
    for a, b in _STEPS:
        second, third = padded[:, a : a + WIDTH], padded[:, b : b + WIDTH]
        out.append(np.where((codes > 0) & (third > 0), ((codes * 64 + second) * 64 + third) * 4 + (b - 2), -1))
    return np.concatenate(out, axis=1).astype(np.int32)


_GAPS = np.array([DECAY**g for g in range(4)], dtype=np.float32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors of the kernel's feature space: (rows, feature numbers, values, row owners)."""
    codes, owner = _codes(words)
    packed = np.sort(subsequences(codes), axis=1)
    ids = packed >> 2
    values = np.where(ids >= 0, _GAPS[packed & 3], 0)
    new = np.ones(ids.shape, dtype=bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    summed = np.add.reduceat(values.ravel(), np.flatnonzero(new.ravel()))
    row, feature = np.nonzero(new)[0], ids[new]
    norm = np.sqrt(np.bincount(row, weights=summed**2, minlength=len(ids)))
    keep = feature >= 0
    value = summed / np.maximum(norm[row], 1e-9)
    return row[keep], feature[keep], value[keep], owner


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Normalised gapped-subsequence kernel of ``words`` against ``others``; of a long word the best piece."""
    r, f, v, owner = features(others)
    known = np.unique(f)
    table = np.zeros((len(others), len(known)), dtype=np.float32)
    np.add.at(table, (owner[r], np.searchsorted(known, f)), v)
    out = np.zeros((len(words), len(others)), dtype=np.float32)
    for lo in range(0, len(words), 500):
        r, f, v, owner = features(words[lo : lo + 500])
        at = np.minimum(np.searchsorted(known, f), len(known) - 1)
        hit = known[at] == f
        dense = np.zeros((len(owner), len(known)), dtype=np.float32)
        dense[r[hit], at[hit]] = v[hit]
        np.maximum.at(out, owner + lo, dense @ table.T)
    return out


@dataclass
class ToxicModel:
    """Weights of the SVM in the kernel's feature space, its offset, the calibration of scores, and the two-word windows it holds."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float
    phrases: list[tuple[str, str]] = field(default_factory=list)

    @property
    def digest(self) -> bytes:
        return hashlib.blake2b(self.weights.tobytes() + repr((self.offset, self.phrases)).encode(), digest_size=16).digest()

    def margins(self, windows: list[str]) -> np.ndarray:
        """SVM margin of each window: sum over landmarks of coefficient times kernel, plus offset."""
        out = np.full(len(windows), self.offset, dtype=np.float64)
        for lo in range(0, len(windows), 1000):
            part = windows[lo : lo + 1000]
            r, f, v, owner = features(part)
            each = np.bincount(r, weights=v * self.weights[f], minlength=len(owner)) + self.offset
            best = np.full(len(part), -np.inf)
            np.maximum.at(best, owner, each)
            out[lo : lo + len(part)] = best
        return out

    def roles(self, words: list[str]) -> list[tuple[int, int]]:
        """For each word the phrases, as bits, of which it may be the first and the second word."""
        if not self.phrases or not words:
            return [(0, 0)] * len(words)
        bits = [np.array([1 << i for i in range(len(self.phrases))], dtype=object)] * 2
        alike = [kernel(words, [p[side] for p in self.phrases]) >= ALIKE for side in (0, 1)]
        return [(int((bits[0] * a).sum()), int((bits[1] * b).sum())) for a, b in zip(*alike, strict=True)]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def _distinct(bags: list[list[str]]) -> list[list[str]]:
    """Bags without those that look like edited copies: two of six pairs of minimum word hashes occurred before.

    Where that would leave under a fifth (few different words in all), every bag stays.
    """
    seen: set[tuple] = set()
    out = []
    scale = [int(x) | 1 for x in randoms(12, 7)]
    for bag in bags:
        hashes = [hash_of(w) for w in bag] or [0]
        low = [min((h * a) & 0xFFFFFFFFFFFF for h in hashes) for a in scale]
        keys = {(j, low[j], low[j + 1]) for j in range(0, 12, 2)}
        if len(seen & keys) < 2:
            out.append(bag)
        seen |= keys
    return out if 5 * len(out) >= len(bags) else bags


def _witnesses(toxic: list[list[str]], clean: list[list[str]], clean_counts: dict[str, int]) -> dict[str, int]:
    """First choice of the windows that make a document toxic, with the number of toxic documents that hold them.

    Near copies count once. A window is chosen if that many toxic documents and so few clean ones
    hold it that chance is excluded over the whole vocabulary; a two-word window only if neither
    word is rare among clean documents. For documents that no such window explains words follow by
    greedy cover: that of most unexplained documents, down to three.
    """
    toxic = _distinct(toxic)
    often = Counter(w for words in toxic for w in words)
    holders: dict[str, set[int]] = {}
    for i, words in enumerate(toxic):
        for w in words:
            if len(w) > 2 and often[w] >= 3:
                holders.setdefault(w, set()).add(i)
    holders = {w: s for w, s in holders.items() if clean_counts.get(w, 0) * 20 <= len(s)}
    holders = {w: s for w, s in holders.items() if " " not in w or not any(x in holders for x in w.split(" "))}
    share = len(toxic) / max(1, len(toxic) + len(clean))
    surely = np.log(0.01 / max(1, len(clean_counts))) / np.log(min(max(share, 0.02), 0.9))
    chosen = {w: len(s) for w, s in holders.items() if len(s) >= surely}
    done = set().union(*(holders[w] for w in chosen))
    heap = [(-len(s - done), w) for w, s in holders.items() if w not in chosen and " " not in w]
    heapq.heapify(heap)
    while heap:
        n, w = heapq.heappop(heap)
        now = len(holders[w] - done)
        if now < 3:
            continue
        if now < -n:
            heapq.heappush(heap, (-now, w))
            continue
        chosen[w] = len(holders[w])
        done |= holders[w]
    return chosen


def variants(word: str) -> list[str]:
    """Written forms with an inserted or doubled letter, as training examples of a toxic window."""
    inner = range(1, len(word))
    return [word[:i] + c + word[i:] for i in inner for c in ("x", "e", word[i])]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on its active rows."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    before = None
    for _ in range(rounds):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        xa, wa = x[active], weight[active] * c
        w = np.linalg.solve(xa.T @ (xa * wa[:, None]) + ridge, xa.T @ (wa * y[active]))
    return w[:-1], float(w[-1])


def _nystroem(landmarks: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    return kernel(words, landmarks) @ root, root


def _windows(bags: list[tuple[list[str] | Parts, int]]) -> tuple[list[list[str]], list[list[str]]]:
    """The windows of the toxic and of the clean documents: all words, and the two-word windows that three or more toxic documents hold.

    Equal words are one object, and two-word windows are counted in a table of hashes before they are held.
    """
    same: dict[str, str] = {}
    slots = np.zeros(PAIR_SLOTS, dtype=np.uint16)
    split: tuple[list[list[str] | Parts], list[list[str] | Parts]] = ([], [])
    for parts, label in bags:
        split[label == 1].append(parts)
    each = lambda parts: {(a, b) for p in parts for a, b in couples(p) if a.isalpha() and b.isalpha()}
    for parts in split[1]:
        at = np.fromiter({hash(c) & (PAIR_SLOTS - 1) for c in each(parts)}, dtype=np.int64)
        slots[at] = np.minimum(slots[at], 60_000) + 1
    often: Counter[str] = Counter()
    for parts in split[1]:
        often.update(f"{a} {b}" for a, b in each(parts) if slots[hash((a, b)) & (PAIR_SLOTS - 1)] >= 3)
    often = {p: n for p, n in often.items() if n >= 3}
    out: tuple[list[list[str]], list[list[str]]] = ([], [])
    for y in (0, 1):
        for parts in split[y]:
            words = [same.setdefault(w, w) for w in sorted(set().union(*map(units, parts)))]
            pairs = sorted({p for a, b in each(parts) if (p := f"{a} {b}") in often})
            out[y].append(words + [same.setdefault(p, p) for p in pairs])
    return out[1], out[0]


#: Counters of two-word windows in the fit (2 bytes each).
PAIR_SLOTS = 1 << 23


class Parts:
    """The parts of document ``at``, held as Arrow text and decoded each time they are read: as Python strings they take several times as much."""

    def __init__(self, column: pa.ListArray, at: int) -> None:
        self.column, self.at = column, at

    def __iter__(self) -> Iterator[str]:
        return iter(self.column[self.at].values.to_pylist())


def fit_model(rows: list[tuple[str | None | list[str] | Parts, int]]) -> ToxicModel:
    """Fit from (text, label) rows, or from (sentences of the text, label).

    The label is that of a document, whose instances are the one- and two-word windows of its
    sentences: of a toxic one at least one is toxic, of a clean one none (multiple-instance SVM).
    ``_witnesses`` makes the first choice of the toxic instances. Then the machine is trained on
    them and on clean sentences' windows, with landmarks from both, and each toxic document's best
    window with a positive margin is its instance of the next round; hard clean windows are added each round. The
    maximum of a document's margins is calibrated to the labels by logistic regression. Without
    both classes every score is the share of label 1 (0 without rows).
    """
    bags = [(sentences(t) if t is None or isinstance(t, str) else t, y) for t, y in rows]
    toxic, clean = _windows(bags)
    clean_counts: dict[str, int] = dict(Counter(w for b in clean for w in b))
    positives = _witnesses(toxic, clean, clean_counts)
    if not positives or not clean:
        share = len(toxic) / len(bags) if bags else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return ToxicModel(np.zeros(64**3, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    phrases = sorted((p for p in positives if " " in p), key=lambda w: (-positives[w], w))[:MAX_PHRASES]
    positives = {w: n for w, n in positives.items() if " " not in w or w in phrases}
    parts = [{p.split(" ")[side] for p in phrases} for side in (0, 1)]
    if phrases:  # of the clean two-word windows those that share a word with a phrase
        near = Counter(f"{a} {b}" for sents, y in bags if y != 1 for x in {c for s in sents for c in couples(s) if c[0] in parts[0] or c[1] in parts[1]} for a, b in (x,))
        for p, n in near.most_common(4000):
            clean_counts[p] = n
    pool = sorted(clean_counts, key=lambda w: (-clean_counts[w], hash_of(w), w))[:MAX_NEGATIVES]
    close = [w for w in pool if " " in w][:1000]
    used = [w for w in set().union(*map(set, toxic)) if w in positives or w not in clean_counts and " " not in w]
    place = {w: i for i, w in enumerate(used)}
    inside = [np.array([place[w] for w in b if w in place], dtype=np.int64) for b in toxic]
    negatives = list(dict.fromkeys(pool[:4000] + close))
    landmarks, model = None, None
    for round_ in range(3):
        best = sorted(positives, key=lambda w: (-positives[w], w))
        landmarks = best[: LANDMARKS * 2 // 3] + (hard if round_ else close[: LANDMARKS // 6] + pool)[: LANDMARKS // 3]
        bent = sorted({v for w in best[: LANDMARKS // 3] for v in variants(w)}.difference(clean_counts, positives))
        words = best + bent + negatives
        y = np.array([1.0] * (len(best) + len(bent)) + [-1.0] * len(negatives))
        weight = np.array([np.sqrt(positives[w]) for w in best] + [0.3] * len(bent) + [np.sqrt(clean_counts[w]) for w in negatives])
        weight[: -len(negatives)] *= weight[-len(negatives) :].sum() / weight[: -len(negatives)].sum() / 2
        z, root = _nystroem(landmarks, words)
        coefficient, offset = _svm(z, y, weight)
        alpha = root @ coefficient
        r, f, v, owner = features(landmarks)
        weights = np.zeros(64**3, dtype=np.float32)
        np.add.at(weights, f, (v * alpha[owner[r]]).astype(np.float32))
        model = ToxicModel(weights, offset, 1.0, 0.0, [tuple(p.split(" ")) for p in phrases])
        if round_ < 2:
            margins = model.margins(pool)
            hard = [pool[i] for i in np.argsort(-margins)[:2000]]
            negatives = sorted({*negatives, *hard})
            margin = model.margins(used)
            taken = Counter(used[i[np.argmax(margin[i])]] for i in inside if len(i) and margin[i].max() > 0)
            positives = {w: max(n, taken.pop(w, 0)) for w, n in positives.items()} | taken
    chosen = [(b, 1) for b in toxic] + [(b, 0) for b in clean[:CALIBRATION]]
    place = {}
    allowed = set(phrases)
    numbers = [np.array([place.setdefault(w, len(place)) for w in b if " " not in w or w in allowed], dtype=np.int64) for b, _ in chosen]
    margin = model.margins(list(place))
    m = np.array([margin[i].max() if len(i) else offset for i in numbers])
    label = np.array([float(y) for _, y in chosen])
    counts = np.where(label == 1, 1.0, len(clean) / max(1, min(len(clean), CALIBRATION)))
    x, w = np.stack([m, np.ones_like(m)], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = x.T @ (x * (counts * (p * (1 - p) + 1e-6))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (counts * (label - p)) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
    return ToxicModel(weights, offset, float(w[0]), float(w[1]), model.phrases)


def hash_of(word: str) -> int:
    return (zlib.crc32(word.encode()) * 0x9E3779B1) & 0xFFFFFFFF


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(h, y, text) of a bounded sample: per class the documents with the smallest id hashes ``h``.

    Rows without id, text or label, and rows with crc32(id as text) mod 5 = 0, are left out; an id with
    several labels has the greatest, one with several texts that of the smallest hash, so rows are bounded as ids are. Ids
    are chosen first, then the texts of the chosen ones are read.
    """
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold != 0))
    known = known.groupBy("id").agg(F.max("y").alias("y")).join(own.select("id").distinct(), "id")
    chosen = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = own.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return rows.select(F.xxhash64("id").alias("h"), "y", "text")


def fit(rows: DataFrame) -> ToxicModel:
    """The model of ``rows(h, y, text)``, fitted in one task on an executor; only the model, 1 MB, comes to the driver.

    The rows are a bounded sample (see ``training_rows``), of which the task takes ``MAX_SENTENCES`` parts a document (see ``parts_of``).
    """

    def short(batch: dict[str, list]) -> dict[str, list]:
        alone("toxicity")
        parts = [heapq.nsmallest(MAX_SENTENCES, parts_of(t), key=hash_of) for t in batch["text"]]
        return {"h": batch["h"], "y": batch["y"], "parts": parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("toxicity")
        held = [(h, y, Parts(b.column("parts"), i)) for b in batches for i, (h, y) in enumerate(zip(b.column("h").to_pylist(), b.column("y").to_pylist(), strict=True))]
        m = fit_model([(parts, y) for _, y, parts in sorted(held, key=lambda x: x[:2])])
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "numbers": [[m.offset, m.slope, m.shift]], "phrases": [[" ".join(p) for p in m.phrases]]})

    parts = map_batches(rows.select("h", "y", "text"), short, "h long, y int, parts array<string>").repartition(1)
    got = parts.mapInArrow(run, "weights binary, numbers array<double>, phrases array<string>").first()
    if got is None:
        return fit_model([])
    return ToxicModel(np.frombuffer(bytes(got["weights"]), dtype=np.float32), *got["numbers"], [tuple(p.split(" ")) for p in got["phrases"]])


def toxicity_scores(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, score, predicted), from whole texts, without a shuffle.

    The score is the calibrated maximum over the windows' margins: all words, and those two-word
    windows that may spell a phrase of the model. Null, empty and wordless texts get the margin of
    no evidence; very long texts are scored whole. Null and repeated ids give a row each; an empty
    table an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared, digest = spark.sparkContext.broadcast(model), model.digest  # 1 MB, whatever the input

    def run(batch: dict[str, list]) -> dict[str, list]:
        alone("toxicity")
        m = shared.value
        if digest not in _caches:
            _caches.clear()
        cache = _caches.setdefault(digest, {})
        bags = [units(t) for t in batch["text"]]
        new = list(set().union(*bags).difference(cache)) if bags else []
        fresh = dict(zip(new, m.margins(new).tolist(), strict=True))
        margins = [max((cache[w] if w in cache else fresh[w] for w in b), default=m.offset) for b in bags]
        if m.phrases:
            roles = _caches.setdefault(digest + b"roles", {})
            unknown = [w for w in set().union(*bags) if w not in roles] if bags else []
            now = dict(zip(unknown, m.roles(unknown), strict=True))
            of = lambda w: roles[w] if w in roles else now[w]
            for i, (t, b) in enumerate(zip(batch["text"], bags, strict=True)):
                firsts = {w: x for w in b if (x := of(w)[0])}
                if firsts:
                    seconds = {w: x for w in b if (x := of(w)[1])}
                    found = {f"{v} {w}" for s in sentences(t) for v, w in couples(s) if firsts.get(v, 0) & seconds.get(w, 0)}
                    margins[i] = max([margins[i], *m.margins(sorted(found)).tolist()])
            if len(roles) < CACHE_WORDS:
                roles.update(now)
        if len(cache) < CACHE_WORDS:
            cache.update(fresh)
        return {"id": batch["id"], "score": m.probability(np.array(margins, dtype=np.float64)).tolist()}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(own, run, "id long, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Margins, and phrase roles, of words per Python worker, of the model scored last.
_caches: dict[bytes, dict[str, float | tuple[int, int]]] = {}


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; all columns stay.

    Decisions are per row: rows without an id, or of one id with different texts, are judged each
    by its own text.
    """
    model = fit(training_rows(docs, labels, id_col, text_col))
    rows, _ = with_rows(docs, id_col, text_col)
    bad = toxicity_scores(rows, model, ROW, text_col).where("predicted = 1").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)
