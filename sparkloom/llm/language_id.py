"""Language identification by a linear-chain conditional random field over words.

Features of a word: its affixes, character n-grams and lexicon entry. Transitions
between the languages of neighbouring words are learned too, on windows of texts and
on windows spliced from two languages, so that code-switched text is labelled word by
word with forward-backward. A document's language has the largest share of the words'
posterior mass; that share is the score.

The field is fitted on the driver, on a bounded sample: at most ``DOCS`` documents of
each language, at most ``WINDOWS`` windows of ``WIDTH`` words of each, and at most
``ALL_WINDOWS`` windows of all languages together, so that with many languages each has
fewer. Prediction reads whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, prepare, tidy

DOCS, WINDOWS, WIDTH = 150, 8, 32
#: Windows of all languages; so many languages at most are learned, the first by a hash.
ALL_WINDOWS = 12_000
#: Numbers (8 bytes each) that one step of the fit works on.
STEP = 1 << 21
#: Chosen documents (ids and languages, some 30 bytes a row) up to which they are
#: broadcast to the scan of the texts; beyond, which takes very many languages, joined.
BROADCAST_DOCS = 100_000
#: Words of one chain at prediction, and words before and behind it that run along with it
#: so that the state at its ends is the text's; those are then dropped.
CHAIN, MARGIN = 128, 32
#: Letters of one word; longer runs, as of scripts without spaces, are read as consecutive words of so many.
LONGEST = 40
_WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, long ones in pieces; none where no character is a letter."""
    if not text:
        return []
    found = _WORDS.findall(text.lower())
    if found and not found[0].isalpha():
        found = found if any(c.isalpha() for w in found for c in w) else []
    return found


def word_features(word: str) -> list[str]:
    """Affixes, n-grams and the word itself, each with its kind in front."""
    w, n = word, len(word)
    out = ["=" + w, "<" + w[:1], ">" + w[-1:]]
    if n > 1:
        out += ["<" + w[:2], ">" + w[-2:]]
    if n > 2:
        out += ["<" + w[:3], ">" + w[-3:]]
    out += [w[i : i + 2] for i in range(n - 1)]
    out += [w[i : i + 3] for i in range(n - 2)]
    return out


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False
):
    """Posteriors of chains side by side.

    scores: chains x places x labels; only the first lengths[i] places count. Returns
    the posteriors and, with pairs, the expected number of moves between labels.
    """
    n, width, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    m = np.exp(moves - moves.max())
    inside = np.arange(width) < lengths[:, None]
    a = np.empty_like(e)
    b = np.ones_like(e)
    now = e[:, 0] * np.exp(start - start.max())
    a[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, width):
        now = (a[:, t - 1] @ m) * e[:, t]
        a[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(width - 2, -1, -1):
        now = (e[:, t + 1] * b[:, t + 1]) @ m.T
        now /= now.sum(axis=1, keepdims=True)
        b[:, t] = np.where(inside[:, t + 1, None], now, 1.0)
    post = a * b
    post /= post.sum(axis=2, keepdims=True)
    if not pairs:
        return post, None
    moved = np.zeros_like(m)
    for t in range(1, width):  # step by step: chains x labels x labels would not stay small
        ahead = e[:, t] * b[:, t]
        weight = inside[:, t] / np.maximum(((a[:, t - 1] @ m) * ahead).sum(axis=1), 1e-300)
        moved += (a[:, t - 1] * weight[:, None]).T @ ahead
    return post, moved * m


class Field:
    """The fitted conditional random field."""

    def __init__(self, labels: list[str], features: dict[str, int]) -> None:
        self.labels, self.features = labels, features
        k = len(labels)
        self.weights = np.zeros((len(features) + 1, k), np.float32)
        self.start, self.moves = np.zeros(k), np.zeros((k, k))
        self._known: dict[str, int] = {}
        self._scores = np.zeros((0, k), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_scores": self._scores[:0]}

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the words one after another, and where each word's begin."""
        get, none = self.features.get, len(self.features)
        flat, begins = [], []
        for w in words:
            begins.append(len(flat))
            flat += [x for f in word_features(w) if (x := get(f)) is not None] or [none]
        return np.array(flat, np.int64), np.array(begins, np.int64)

    def word_scores(self, words: list[str], bound: int = 150_000) -> np.ndarray:
        """Emission scores; those of words seen before come from a bounded table."""
        known = self._known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > bound:
                known.clear()
                self._scores = self._scores[:0]
                new = list(dict.fromkeys(words))
            flat, begins = self.table(new)
            own = np.add.reduceat(self.weights[flat], begins, axis=0)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._scores = np.concatenate([self._scores, own])
        return self._scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def posteriors(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Posteriors of the words of texts one after another; flat: their emission scores.

        Long texts run in chains side by side; what lies over a margin from a chain's end
        has no say in a label that any float would show.
        """
        out = np.zeros(flat.shape)
        ends = np.cumsum(sizes)
        begin, low, high = [], [], []
        for a, n in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
            for b in range(0, n, CHAIN):
                begin.append(a + b)
                low.append(a + max(0, b - MARGIN))
                high.append(a + min(n, b + CHAIN + MARGIN))
        begin, low, high = (np.array(x, np.int64) for x in (begin, low, high))
        order = np.argsort(high - low, kind="stable")  # like lengths side by side
        step = max(1, min(4096, STEP // (len(self.labels) * (CHAIN + 2 * MARGIN))))
        stops = np.append(begin[1:], len(flat))
        for c in range(0, len(order), step):
            own = order[c : c + step]
            n = high[own] - low[own]
            place = np.minimum(low[own, None] + np.arange(int(n.max())), len(flat) - 1)
            post, _ = forward_backward(flat[place].astype(np.float64), n, self.start, self.moves)
            at = low[own, None] + np.arange(int(n.max()))
            mine = (at >= begin[own, None]) & (at < np.minimum(begin[own] + CHAIN, stops[own])[:, None])
            out[at[mine]] = post[mine]
        return out

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """Per text the share of posterior mass by label; rows of zeros without words."""
        k = len(self.labels)
        out = np.zeros((len(texts), k))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not k:
            return out
        post = self.posteriors(self.word_scores([w for t in texts for w in t]), sizes)
        some = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(post, begin, axis=0) / sizes[some, None]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, words); und with score 0 for texts without a letter."""
        split = [words_of(t) for t in texts]
        shares = self.shares(split)
        return [
            (self.labels[int(np.argmax(s))], float(min(1.0, s.max())), len(w)) if w and len(s) else ("und", 0.0, len(w))
            for w, s in zip(split, shares, strict=True)
        ]

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of one text, which may switch its language."""
        words = words_of(text)
        if not words or not self.labels:
            return []
        post = self.posteriors(self.word_scores(words), np.array([len(words)], np.int64))
        return [(w, self.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, post, strict=True)]


def fit(windows: list[tuple[str, list[str]]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """windows: (language, at most WIDTH words). Ascent on the likelihood by Adagrad."""
    windows = sorted(windows)
    labels = sorted({lang for lang, _ in windows})
    number = {lang: i for i, lang in enumerate(labels)}
    pure = [(w, [number[lang]] * len(w)) for lang, w in windows if w]
    order = np.random.default_rng(7).permutation(len(pure))
    spliced = []
    for i, j in zip(order[::2], order[1::2], strict=False):  # half of each, one after the other
        (a, la), (b, lb) = pure[i], pure[j]
        if la[0] != lb[0]:
            x, y = len(a) // 2, len(b) // 2
            spliced.append((a[:x] + b[y:], la[:x] + lb[y:]))
    chains = [c for c in pure + spliced if c[0]]
    counts = Counter(f for w, _ in pure for word in w for f in set(word_features(word)))
    features = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c > 1))}
    field = Field(labels, features)
    if len(labels) < 2 or not chains:
        return field
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in chains for w in ws))}
    flat, begins = field.table(list(vocabulary))
    sizes = np.diff(np.append(begins, len(flat)))
    n, width, k = len(chains), max(len(w) for w, _ in chains), len(labels)
    words, gold = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    lengths = np.array([len(w) for w, _ in chains])
    for i, (ws, ls) in enumerate(chains):
        words[i, : len(ws)] = [vocabulary[w] for w in ws]
        gold[i, : len(ls)] = ls
    parts = [slice(c, c + step) for step in [max(1, STEP // (k * width))] for c in range(0, n, step)]
    total = int(lengths.sum())
    seen = [np.full_like(x, 1e-8, dtype=np.float64) for x in (field.weights, field.start, field.moves)]
    for _ in range(rounds):
        by_word, starts, moves = np.zeros((len(vocabulary), k)), np.zeros(k), np.zeros((k, k))
        emitted = np.add.reduceat(field.weights[flat], begins, axis=0)
        for own in parts:
            inside = np.arange(width) < lengths[own, None]
            truth = np.eye(k)[gold[own]]
            post, moved = forward_backward(emitted[words[own]].astype(np.float64), lengths[own], field.start, field.moves, pairs=True)
            real = np.bincount((gold[own][:, :-1] * k + gold[own][:, 1:])[inside[:, 1:]], minlength=k * k).reshape(k, k)
            starts += (truth[:, 0] - post[:, 0]).sum(axis=0)
            moves += real - moved
            lack, at = (truth - post)[inside], words[own][inside]
            for j in range(k):
                by_word[:, j] += np.bincount(at, lack[:, j], len(vocabulary))
        by_feature = np.stack([np.bincount(flat, np.repeat(by_word[:, j], sizes), len(features) + 1) for j in range(k)], axis=1)
        for x, g, s in zip((field.weights, field.start, field.moves), (by_feature, starts, moves), seen, strict=True):
            g = g / total - decay * x / len(features)
            s += g * g
            x += (rate * g / np.sqrt(s)).astype(x.dtype)
    field.weights[-1] = 0
    return field


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_windows(
    documents: DataFrame, docs: int = DOCS, windows: int = WINDOWS, width: int = WIDTH, most: int = ALL_WINDOWS
) -> list[tuple[str, list[str]]]:
    """The bounded sample: languages and words of windows spread over sampled texts; at most
    so many windows in all, of documents that many languages share alike.

    Only doc_id and lang are read to choose the documents (the first by a hash in each
    language, found before the shuffle); only chosen texts are cut into windows.
    """
    prepare(documents.sparkSession)
    may = documents.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    langs = may.select("lang").distinct().orderBy(F.xxhash64("lang"), "lang").limit(most + 1)
    langs = materialize(langs.select(F.col("lang").alias("_known")), "languages")
    k = langs.count()
    if k > most:  # one window each is as few as can be
        known = langs.orderBy(F.xxhash64("_known"), "_known").limit(most)
        may, k = may.join(F.broadcast(known), F.col("lang") == F.col("_known"), "left_semi"), most
    docs = min(docs, most // max(1, k))
    windows = min(windows, max(1, most // max(1, k * docs)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        may.select("doc_id", "lang")
        .withColumn("_nth", F.row_number().over(first))
        .filter(F.col("_nth") <= docs)
        .select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang"))
        .distinct()
    )
    chosen = materialize(chosen, "language-sample")
    if chosen.count() <= BROADCAST_DOCS:
        chosen = F.broadcast(chosen)
    texts = may.select("doc_id", "lang", "text").filter("text is not null")
    texts = texts.join(chosen, (texts["doc_id"] == chosen["_doc"]) & (texts["lang"] == chosen["_lang"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                words = words_of(text)
                n = min(windows, -(-len(words) // width))
                for i in range(n):
                    at = (len(words) - width) * i // max(1, n - 1) if len(words) > width else 0
                    out.append({"lang": lang, "words": words[at : at + width]})
            schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = texts.select("lang", "text").mapInArrow(tidy(cut), "lang string, words array<string>")
    return [(r["lang"], list(r["words"])) for r in rows.toLocalIterator()]


def predict(documents: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are und with score 0, as is everything when
    nothing could be learned. Repeated rows get equal results; lang, source and doc_id
    are no inputs; an empty table gives no rows.
    """
    spark = prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(field)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([a for a, *_ in found], pa.string()),
                 pa.array([b for _, b, _ in found], pa.float64())], schema=schema
            )

    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return docs.mapInArrow(tidy(scan), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, then predict for all."""
    return predict(documents, fit(sample_windows(documents)))


def keep_identified(documents: DataFrame, least: float = 0.35, short: int = 20) -> DataFrame:
    """documents without those whose language is und, or has less than the least share.

    Texts of less than short words are too short to be called mixed; of them only und
    goes. Rows are judged where they are read; all columns stay.
    """
    spark = prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(fit(sample_windows(documents)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(column(batch, "text"))
            keep = [lang != "und" and (score >= least or n < short) for lang, score, n in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(tidy(scan), documents.schema)
