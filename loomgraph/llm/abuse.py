"""Abusive, hateful or sexual content by compression distance.

Two zstandard dictionaries are trained on labelled documents: one on offending windows, one on ordinary text. A window of
a document is the more suspect, the fewer bytes it takes with the first than with the second. As a verdict holds for a
whole document, the offending windows are found in rounds: first those of offending documents that ordinary documents
don't hold, then those that the dictionaries of the last round tell apart. Text is folded first: look-alike letters,
digits and signs for letters, letters set apart, marks put between words; and words that are rare in the sample, mostly
names, become one sign.

The sample is bounded (`MOST_OFFENDING`, `MOST_ORDINARY`, in hash order). Where few documents were judged ordinary, ones
without a verdict fill it up to `LEAST_ORDINARY`: nearly all of them are ordinary, and the rules that sort windows bear
that some are not. The threshold is calibrated on judged documents that the model which scores them has not seen (`FOLDS` parts), but never
lies below what a single word can gain. The models are fitted as tasks; every document of the corpus is scored whole.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample of judged documents.
MOST_OFFENDING = 4000
MOST_ORDINARY = 8000
#: Fewer judged ordinary documents are filled up to so many by documents without a verdict.
LEAST_ORDINARY = 2000
#: Documents of more code points are scored like any other, but no model is fitted on them; bounds the bytes of the sample.
LONGEST_SAMPLED = 10_000
#: Parts of the judged documents that are held out in turn.
FOLDS = 4

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 10, 3
#: Bytes of the dictionaries: ordinary text is far more varied.
OFFENDING_BYTES, ORDINARY_BYTES = 112_640, 1_048_576
LEVEL = 9
#: Root of the length below which a window counts as long: few bytes more or less say nothing.
SHORT = 7.0
#: No threshold lies below: a single word that only one dictionary holds gains about 1, which is too little evidence.
LEAST_GAIN = 1.5
#: Windows whose gain a worker remembers; bounds its memory, never the result.
REMEMBERED = 200_000

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝкмтвнгбпАЕОРСУХІЈЅКМТВНαοερτυνικѵ", "aeopcyxijsdhqwkmtbhrbnAEOPCYXIJSKMTBHaoeptuvikv")
SIGNS = str.maketrans("0134578@$€!|+", "oieastbaseiit")
_MARK = re.compile(r"<[^<>\n]{0,40}>|\[/?[a-z]{1,12}\]|&[a-z]{2,6};|&#\d+;", re.I)
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[@$€]?[^\W_]+(?:[@$!|+*'’€]+[^\W_]+)*[$€]?|[^\W\d_]\*+")
_FORMAT = regex.compile(r"\p{Cf}+")
_ACCENT = regex.compile(r"[\p{Mn}\p{Mc}\p{Me}]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[a-zA-Z]")
_STOP = re.compile(r"[.!?…;:。！？]+[\"'»”’)\]*]*(?:\s+|$)|\n+|\s+[-–—]+\s+|[\"“”«»„]")


def fold(text: str) -> str:
    """One spelling for disguised words: compatibility forms, look-alikes in mixed words, no marks, letters joined again, no accents."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "[" in text or "&" in text:
        text = _MARK.sub(" ", text)
    text = _APART.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), text)
    if not text.isascii():
        text = _LETTERS.sub(lambda m: m.group().translate(LOOKALIKES) if not m.group().isascii() and _LATIN.search(m.group()) else m.group(), text)
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text))
    return text.lower().replace("ß", "ss")


@lru_cache(maxsize=REMEMBERED)
def _word(t: str) -> str:
    if any(c.isalpha() for c in t):
        if not t.isalpha():
            t = t.replace("’", "'").translate(SIGNS)
    elif t[0] not in "@$€":
        return "0"
    return re.sub(r"(.)\1{2,}", r"\1\1", t)


def segments(text: str) -> list[list[str]]:
    """The folded words of each stretch between stops, lines, dashes and quotation marks."""
    out = []
    for part in _STOP.split(fold(text)):
        words = [_word(t) for t in _TOKEN.findall(part)]
        if words:
            out.append(words)
    return out


def starred(word: str, known: dict[tuple, list[str]]) -> str:
    """The known word that a word with asterisks stands for."""
    m = re.fullmatch(r"([a-z]+)(\*+)([a-z]*)", word)
    if not m:
        return word
    for w in known.get((word[0], len(word)), ()):
        if w.startswith(m.group(1)) and w.endswith(m.group(3)):
            return w
    return word


class Folder:
    """Cuts texts into windows of known words; runs of unknown ones become '~'."""

    def __init__(self, vocabulary: set[str]) -> None:
        self.vocabulary = vocabulary
        self.by_shape: dict[tuple, list[str]] = {}
        for w in sorted(vocabulary):
            self.by_shape.setdefault((w[0], len(w)), []).append(w)

    def masked(self, words: list[str]) -> list[str]:
        out: list[str] = []
        for w in words:
            if w not in self.vocabulary:
                if "*" in w:
                    w = starred(w, self.by_shape)
                if w not in self.vocabulary:
                    if not out or out[-1] != "~":
                        out.append("~")
                    continue
            out.append(w)
        return out

    def windows(self, text: str) -> list[str]:
        return self.cut(segments(text))

    def cut(self, parts: list[list[str]]) -> list[str]:
        found: dict[str, None] = {}
        for words in parts:
            m = self.masked(words)
            if len(m) <= WINDOW:
                found[" ".join(m)] = None
            else:
                for k in range(0, len(m) - WINDOW + STRIDE, STRIDE):
                    found[" ".join(m[k : k + WINDOW])] = None
        return [w for w in found if w != "~"]


def _dictionary(windows: list[str], size: int, extra: list[str] = []) -> bytes:
    """A dictionary trained on the windows, with `extra` ones appended to its content."""
    import zstandard

    samples = [w.encode() for w in windows]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 2)), samples, k=256, d=8, level=LEVEL).as_bytes() + " ".join(extra).encode()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b" ".join(dict.fromkeys([*samples, *(w.encode() for w in extra)]))[-size:] or b"~"


class Compressor:
    """Compressed lengths of short windows with one dictionary."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        z = zstandard
        d = z.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        self._compress = z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def size(self, window: str) -> int:
        return len(self._compress(window.encode()))


class Model:
    """Two dictionaries, the vocabulary and the threshold; picklable, built once per Python worker."""

    def __init__(self, offending: bytes, ordinary: bytes, vocabulary: list[str], threshold: float) -> None:
        self.offending, self.ordinary, self.vocabulary, self.threshold = offending, ordinary, vocabulary, threshold
        self._ready, self._known = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None, "_known": {}}

    def _parts(self):
        if self._ready is None:
            self._ready = Folder(set(self.vocabulary)), Compressor(self.offending), Compressor(self.ordinary)
        return self._ready

    def gains(self, windows: list[str]) -> list[float]:
        """Bytes saved by the offending dictionary, per root of the window's length."""
        _, bad, good = self._parts()
        known, out = self._known, []
        for w in windows:
            g = known.get(w)
            if g is None:
                g = (good.size(w) - bad.size(w)) / max(SHORT, len(w) ** 0.5)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = g
            out.append(g)
        return out

    def score(self, text: str | None) -> tuple[float, str]:
        """The greatest gain of a window, and the window; 0 for a text without any."""
        if not text:
            return 0.0, ""
        windows = self._parts()[0].windows(text)
        if not windows:
            return 0.0, ""
        g = self.gains(windows)
        k = int(np.argmax(g))
        return g[k], windows[k]


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The highest threshold whose F0.5 on held-out documents is the greatest but for a tolerance.

    Some documents have a verdict of offending without any offence; recall of those would be bought with false alarms.
    """
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f = 1.25 * hit / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    f[np.append(s[1:] == s[:-1], False)] = 0
    k = int(np.flatnonzero(f >= f.max() - 0.003)[0])
    return max(LEAST_GAIN, float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k]))


def _leaning(bad: Counter, good: Counter, rate: float) -> set:
    """What at least two offending documents hold, and far more of them than of the ordinary ones. Some verdicts are wrong, so ordinary ones may hold it too."""
    return {w for w, n in bad.items() if n >= 2 and n > 6 * rate * good[w]}


def _pairs(window: str) -> list[str]:
    words = window.split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])] or words


def _fit(docs: list[list[str]], labels: list[int], vocabulary: list[str], rounds: int) -> Model:
    """Dictionaries from the documents' windows. Windows are first sorted by the word pairs that lean to offending documents, then by the last round's model."""
    bad_docs = [d for d, y in zip(docs, labels) if y]
    good_docs = [d for d, y in zip(docs, labels) if not y]
    bad, good = Counter(w for d in bad_docs for w in d), Counter(w for d in good_docs for w in d)
    rate = len(bad_docs) / max(1, len(good_docs))
    leaning = _leaning(Counter(p for d in bad_docs for p in {p for w in d for p in _pairs(w)}), Counter(p for d in good_docs for p in {p for w in d for p in _pairs(w)}), rate)
    lean = {w: sum(p in leaning for p in q) / len(q) for w in {*bad, *good} for q in (_pairs(w),)}
    offending = [w for w in bad if lean[w] >= 0.4]
    ordinary = [w for w in {*good, *bad} if lean[w] < 0.2]
    hard: list[str] = []
    for k in range(rounds + 1):
        model = Model(
            _dictionary([w for w in sorted(offending) for _ in range(min(bad[w], 3))], OFFENDING_BYTES),
            _dictionary([w for w in sorted(ordinary) for _ in range(min(good[w] + bad[w], 3))], ORDINARY_BYTES, hard), vocabulary, 0.0,
        )
        if k == rounds:
            return model
        seen = sorted({*bad, *good})
        gain = dict(zip(seen, model.gains(seen)))
        cut = float(np.quantile([max((gain[w] for w in d), default=0.0) for d in good_docs], 0.95)) if good_docs else 0.0
        offending = [w for w in bad if lean[w] >= 0.4 or lean[w] >= 0.15 and gain[w] > cut]
        ordinary = [w for w in {*good, *bad} if lean[w] < 0.2 and gain[w] <= cut or lean[w] == 0]
        hard = sorted({*hard, *(w for w in ordinary if lean[w] == 0 and gain[w] > 0.3 * cut)})


def words_of(text: str) -> tuple[list[list[str]], list[str], list[str]]:
    """The segments of a text, and its words in small letters and with a capital one; not those that start a sentence."""
    inside = re.findall(r"[^\W_],? ([^\W\d_]+)", text)
    return segments(text), sorted({w for w in inside if w[0].islower()}), sorted({w.lower() for w in inside if w[0].isupper()})


def windows_of(docs: list[tuple[list[list[str]], list[str], list[str]]], labels: list[int | None]) -> tuple[list[str], list[list[str]]]:
    """(vocabulary, windows of each document). Words that are rare or mostly capitalised are left out, unless they lean to offending documents."""
    bad, good, small, large = Counter(), Counter(), Counter(), Counter()
    for (parts, low, up), y in zip(docs, labels):
        (bad if y else good).update({w for s in parts for w in s if "*" not in w})
        small.update(low)
        large.update(up)
    n = sum(map(bool, labels))
    telling = _leaning(bad, good, n / max(1, len(labels) - n))
    vocabulary = sorted(w for w in {*bad, *good} if bad[w] + good[w] >= 4 and len(w) < 30 and (w in telling and 2 * bad[w] > good[w] or large[w] < 4 * (small[w] + 1)))
    folder = Folder(set(vocabulary))
    return vocabulary, [folder.cut(parts) for parts, _, _ in docs]


def fitted(docs: list[list[str]], labels: list[int | None], vocabulary: list[str], part: int, rounds: int = 2) -> tuple[Model, list[float]]:
    """The model without the `part`-th of `FOLDS` parts of the judged documents, and the scores it gives to those; part -1 holds nothing out."""
    held = {k for n, k in enumerate(k for k, y in enumerate(labels) if y is not None) if n % FOLDS == part}
    rest = [k for k in range(len(docs)) if k not in held]
    model = _fit([docs[k] for k in rest], [labels[k] or 0 for k in rest], vocabulary, rounds)
    return model, [max(model.gains(docs[k]), default=0.0) for k in sorted(held)]


def calibrated(model: Model, held: dict[int, list[float]], labels: list[int | None]) -> Model:
    """The model with the threshold that suits the held-out scores, by part."""
    judged = [y for y in labels if y is not None]
    scores = np.zeros(len(judged))
    for part, got in held.items():
        scores[part::FOLDS] = got
    model.threshold = _best_threshold(scores, np.asarray(judged))
    return model


NOTHING = Model(b"~", b"~", [], float("inf"))


def train(texts: list[str], labels: list[int | None]) -> Model:
    """A model from judged documents (1, 0) and ones without a verdict (None), here and now."""
    if len({*labels} - {None}) < 2:
        return NOTHING
    vocabulary, docs = windows_of([words_of(t) for t in texts], labels)
    held = {f: fitted(docs, labels, vocabulary, f)[1] for f in range(FOLDS)}
    return calibrated(fitted(docs, labels, vocabulary, -1)[0], held, labels)


def sampled(documents: DataFrame, labels: DataFrame, most_offending: int = MOST_OFFENDING, most_ordinary: int = MOST_ORDINARY, least_ordinary: int = LEAST_ORDINARY) -> DataFrame:
    """The bounded training sample (doc_id, text, y): documents with a single verdict, and null for ones without that fill it up.

    Null verdicts don't count; documents with differing ones are left out.
    """
    verdicts = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    d = documents.select("doc_id", "text").where((F.col("text") != "") & (F.length("text") <= LONGEST_SAMPLED))
    order = F.xxhash64("doc_id")
    one = verdicts.where("lo = hi").select("doc_id", F.col("hi").cast("int").alias("y"))
    picked = one.where("y = 1").orderBy(order, "doc_id").limit(most_offending).unionByName(one.where("y = 0").orderBy(order, "doc_id").limit(most_ordinary))
    known = d.join(F.broadcast(picked), "doc_id")
    lacking = max(0, least_ordinary - one.where("y = 0").count())
    if not lacking:
        return known
    other = d.select("doc_id").join(verdicts, "doc_id", "left_anti").orderBy(order, "doc_id").limit(lacking).select("doc_id", F.lit(None).cast("int").alias("y"))
    return known.unionByName(d.join(F.broadcast(other), "doc_id"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the sample; its words are found, and the models fitted, by tasks."""
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, y in zip(b["doc_id"], b["text"], b["y"]):
                parts, small, large = words_of(t)
                rows.append((i, y, "\n".join(map(" ".join, parts)), " ".join(small), " ".join(large)))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "parts", "small", "large"])

    rows = sampled(documents, labels).mapInPandas(words, "doc_id bigint, y int, parts string, small string, large string").collect()
    rows.sort(key=lambda r: r["doc_id"])
    given = [r["y"] for r in rows]
    if len({*given} - {None}) < 2:
        warnings.warn("no verdicts of both kinds: no document can be flagged")
        return NOTHING
    vocabulary, docs = windows_of([([x.split() for x in r["parts"].splitlines()], r["small"].split(), r["large"].split()) for r in rows], given)
    del rows
    spark = documents.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["part"]:
                model, held = fitted(docs, given, vocabulary, part)
                yield pd.DataFrame([(part, held, *((model.offending, model.ordinary) if part < 0 else (None, None)))], columns=["part", "held", "offending", "ordinary"])

    parts = spark.range(-1, FOLDS, 1, FOLDS + 1).select(F.col("id").cast("int").alias("part"))
    got = {r["part"]: r for r in parts.mapInPandas(run, "part int, held array<double>, offending binary, ordinary binary").collect()}
    model = Model(bytes(got[-1]["offending"]), bytes(got[-1]["ordinary"]), vocabulary, 0.0)
    return calibrated(model, {f: got[f]["held"] for f in range(FOLDS)}, given)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, source, score, flagged, passage), one per document.

    The score is the greatest gain of a window, passage that window as folded; a document is flagged when its score
    exceeds the calibrated threshold. Null, empty and blank texts score 0 and are not flagged. Without verdicts of both
    kinds nothing is flagged. Texts are scored whole, whatever their length.
    """
    model = fit(documents, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.score(t if isinstance(t, str) else None) for t in b["text"]]
            s = [x for x, _ in got]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": s, "flagged": [x > model.threshold for x in s], "passage": [w for _, w in got]})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, score double, flagged boolean, passage string")


def rates_by_source(scored: DataFrame) -> DataFrame:
    """Documents, flagged documents and their share, per source (a null source is a source of its own)."""
    n, k = F.count(F.lit(1)), F.sum(F.col("flagged").cast("bigint"))
    return scored.groupBy("source").agg(n.alias("n_docs"), k.alias("n_flagged"), (k / n).alias("rate"))
