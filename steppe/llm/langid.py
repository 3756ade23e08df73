"""Language identification of spans and whole texts.

The script of a word, found by ranges of code points, narrows the languages it
can be in: one that doesn't use the script can't label it, so a word of another
script always begins a span of its own. Letter trigrams score the word in each of them; Viterbi with a
penalty for each switch labels spans of mixed text. A text's language is the
one that labels most of its letters, and its score is the mean over all letters
of the word's probability in that language, times the share of the word's
trigrams that were learned in it. A trigram that a language never showed weighs
the same in all of them, so text of no learned language favours none and scores
low, however the training texts are sized.

The model is fitted in Spark on all documents that it is given, and the cut-off
of ``keep_known`` comes from all of them, too: each is scored by a model of the
other folds. A caller may bound the number of documents by language instead.
What comes to the driver are the trigram counts, so as much as the model itself.
Prediction is a map over all documents without a shuffle.

Words are runs of letters; numerals such as ``½`` and ``Ⅷ`` are none.

Defined results: ``und`` with score 0 for a null text or one without letters,
and for every text if nothing could be learned; ties go to the language that
comes first; words in a script of no learned language count for all languages
alike and score 0; null ids and repeated rows are kept; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steppe.llm.shared import map_batches, materialize

#: Documents of each language to learn from; all where it is None.
TRAIN_DOCS = None
#: Log probability lost by each switch of language, and the least of one word.
SWITCH, FLOOR = 12.0, -6.0
#: Instead of that, for a language whose script the word is not in.
BARRED = -1000.0
#: Share of a language's letters that makes a script one of its own.
SCRIPT_SHARE = 0.02
#: The cut-off of ``keep_known``: each of ``ASIDE`` folds is set aside in turn,
#: all but ``LOST`` of those labelled right have some score, and less than
#: ``MARGIN`` times that is no known language. Fewer than ``ENOUGH`` tell nothing.
ASIDE, LOST, MARGIN, ENOUGH = 5, 0.001, 0.8, 100
UNKNOWN = "und"
CACHE = 1 << 18
#: Letters, and numerals that are no decimal digits; those are told apart by the second pattern.
WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")

#: First code point of ranges and the script of each.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0250, "Other"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0780, "Other"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Other"),
    (0x0E00, "Thai"),
    (0x0E80, "Other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB07, "Other"),
    (0x20000, "Han"),
    (0x30000, "Other"),
)
_STARTS = [s for s, _ in SCRIPTS]
_START, _END = "\x02", "\x03"


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = WORD.findall(text.lower())
    return words if "".join(words).isalpha() else LETTERS.findall(text.lower())


def _code(points: np.ndarray) -> np.ndarray:
    """One number for three neighbouring code points (21 bits each)."""
    p = points.astype(np.uint64)
    return (p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # sorted trigram codes
    logs: np.ndarray  # log probability of each trigram in each language; the last row, of equal values, is for others
    seen: np.ndarray  # 1 where the language showed the trigram; the last row is 0
    allowed: np.ndarray  # script range x language: whether the language uses the script

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each language for each word, and the share of its trigrams seen in it."""
        joined = "".join(f"{_START}{w}{_END}" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        codes = _code(points)
        found = np.searchsorted(self.codes, codes)
        found[(found == len(self.codes)) | (self.codes[np.minimum(found, len(self.codes) - 1)] != codes)] = len(self.codes)
        rows, seen = self.logs[found], self.seen[found]
        inside = np.ones(len(points), bool)  # a trigram that begins at the end of a word reaches into the next
        inside[starts + sizes - 2] = inside[starts + sizes - 1] = False
        rows[~inside[: len(rows)]] = seen[~inside[: len(rows)]] = 0
        total = np.add.reduceat(rows, starts, axis=0)
        allowed = self.allowed[np.searchsorted(_STARTS, points[starts + 1], "right") - 1]
        total = np.where(allowed, total, -np.inf)
        top = total.max(axis=1, keepdims=True)
        total = total - top - np.log(np.exp(total - top).sum(axis=1, keepdims=True))
        known = np.add.reduceat(seen, starts, axis=0) / (sizes - 2)[:, None]
        return np.where(allowed, np.maximum(total, FLOOR), BARRED).astype(np.float32), known.astype(np.float32)


def build(counts: list[tuple[str, str, int]]) -> Model | None:
    """A model from (language, trigram, count)."""
    langs = sorted({lang for lang, _, _ in counts})
    if not langs:
        return None
    at = {lang: i for i, lang in enumerate(langs)}
    names = sorted({t for _, t, _ in counts}, key=lambda t: tuple(map(ord, t)))
    place = {t: i for i, t in enumerate(names)}
    table = np.zeros((len(names) + 1, len(langs)))
    letters = np.zeros((len(SCRIPTS), len(langs)))
    for lang, trigram, n in counts:
        table[place[trigram], at[lang]] += n
        letters[bisect_right(_STARTS, ord(trigram[1])) - 1, at[lang]] += n
    sizes = table.sum(axis=0)
    unseen = 0.5 * len(table) / (sizes.mean() + 0.5 * len(table))  # one share for all languages
    logs = np.log((1 - unseen) * table / sizes + unseen / len(table))
    names_of = [s for _, s in SCRIPTS]
    by_script = np.array([[letters[[n == s for n in names_of], k].sum() for k in range(len(langs))] for s in names_of])
    own = by_script >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    own[~own.any(axis=1)] = True
    codes = np.concatenate([_code(np.array(list(map(ord, t)))) for t in names])
    return Model(langs, codes, logs, (table > 0).astype(np.float32), own)


def _sample(docs: DataFrame, bound: int | None) -> DataFrame:
    """doc_id, lang, text, fold and aside (the first fold) of all documents, or of about ``bound`` of each language."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    fold = F.pmod(F.xxhash64("doc_id", "lang", F.lit(1)), F.lit(ASIDE)).cast("int")
    parts = rows.withColumn("fold", fold).withColumn("aside", F.col("fold") == 0)
    sizes = {} if bound is None else {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return parts
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, bound / n))])
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    return parts.filter(draw < share[F.col("lang")])


def _counts(rows: DataFrame) -> list[tuple[str, str, int, int]]:
    """(language, trigram, fold, count); what is counted first are distinct words."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = rows.select("lang", "fold", words.alias("word")).groupBy("lang", "fold", "word").count()
    padded = F.concat(F.lit(_START), "word", F.lit(_END))
    grams = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))
    grams = counted.select("lang", "fold", "count", F.explode(grams).alias("trigram"))
    table = grams.groupBy("lang", "trigram", "fold").agg(F.sum("count").alias("n"))
    return [(r["lang"], r["trigram"], r["fold"], r["n"]) for r in table.toLocalIterator()]


def fit(docs: DataFrame, bound: int | None = TRAIN_DOCS) -> Model | None:
    """Fit on all documents of ``docs``, or on about ``bound`` of each language."""
    rows = _sample(docs, bound).withColumn("fold", F.lit(0))
    return build([(lang, t, n) for lang, t, _, n in _counts(rows)])


def _right_scores(model: Model | None):
    """Scores of the texts whose language the model finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _labelled(model, SWITCH)
        for batch in batches:
            scores = [score for lang, (found, score) in zip(batch.column(0).to_pylist(), of(batch.column(1)), strict=True) if lang == found]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64())], names=["score"])

    return run


def fit_with_cut(docs: DataFrame, least: float, bound: int | None = TRAIN_DOCS) -> tuple[Model | None, float]:
    """The model of ``fit``, and the least score of a known language.

    Each document is scored by a model of the folds that it is not in. The
    cut-off is ``least`` where too few are labelled right, and never below it.
    """
    rows = _sample(docs, bound)
    counts = _counts(rows)
    model = build([(lang, t, n) for lang, t, _, n in counts])
    if model is None:
        return None, least
    parts = []
    for k in range(ASIDE):
        trial = build([(lang, t, n) for lang, t, fold, n in counts if fold != k])
        parts.append(map_batches(rows.filter(F.col("fold") == k).select("lang", "text"), _right_scores(trial), "score double"))
    scores = materialize(reduce(DataFrame.union, parts), "language-scores")
    n = scores.count()
    if n < ENOUGH:
        return model, least
    lowest = scores.orderBy("score").limit(int(LOST * (n - 1)) + 1).agg(F.max("score")).first()[0]
    return model, max(least, MARGIN * lowest)


def switching_path(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word, by Viterbi with a penalty for each switch.

    No stretch of words in other languages can pay for the switches around it
    if none favours one of them by more than the penalty, and the stretches at
    both ends together do not either; then the best single language is the path.
    """
    n = len(scores)
    best = int(np.argmax(scores.sum(axis=0)))
    gain = np.cumsum(scores - scores[:, [best]], axis=0, dtype=np.float64)
    lowest = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    ends = max(0.0, gain.max()) + (gain[-1] - np.minimum(lowest[-1], gain[-1])).max()
    if (gain - lowest).max() <= penalty and ends <= penalty:
        return np.full(n, best)
    total = scores[0].astype(np.float64)
    leaders, switched = np.zeros(n, np.int64), np.zeros((n, len(total)), bool)
    for t in range(1, n):
        leader = int(total.argmax())
        change = total < total[leader] - penalty
        leaders[t], switched[t] = leader, change
        total = np.where(change, total[leader] - penalty, total) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(total.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = leaders[t] if switched[t, path[t]] else path[t]
    return path


class _Index(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number


class Labeller:
    """Labels texts; remembers the scores of words it has seen."""

    def __init__(self, model: Model, penalty: float = SWITCH):
        self.model, self.penalty = model, penalty
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.scores = np.zeros((1024, len(self.model.langs)), np.float32)
        self.shares = np.zeros_like(self.scores)  # probability times the share of seen trigrams

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Where the scores and shares of the words are."""
        if len(self.index) > CACHE:
            self._reset()
        index = self.index
        rows = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if index.fresh:
            while len(self.scores) < len(index):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
            logs, known = self.model.score(index.fresh)
            fresh = slice(len(index) - len(index.fresh), len(index))
            self.scores[fresh], self.shares[fresh] = logs, np.exp(logs) * known
            index.fresh = []
        return rows

    def label(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words:
            return UNKNOWN, 0.0
        rows = self.rows_of(words)
        sizes = np.fromiter(map(len, words), np.float64, len(words))
        path = switching_path(self.scores[rows], self.penalty)
        weight = np.bincount(path, sizes, len(self.model.langs))
        best = int(np.argmax(weight))
        score = float((self.shares[rows, best] * sizes).sum() / sizes.sum())
        return self.model.langs[best], min(1.0, score)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and language of each stretch of words in one language."""
        found = list(LETTERS.finditer(text or ""))
        if not found:
            return []
        rows = self.rows_of([m.group().lower() for m in found])  # may replace the scores by longer ones
        path = switching_path(self.scores[rows], self.penalty)
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, path, strict=True):
            lang = self.model.langs[k]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], m.end(), lang)
            else:
                out.append((m.start(), m.end(), lang))
        return out


def _labelled(model: Model | None, penalty: float):
    """(language, score) of each text of a column."""
    labeller = Labeller(model, penalty) if model else None
    return lambda texts: [labeller.label(t.as_py()) if labeller else (UNKNOWN, 0.0) for t in texts]


def label(docs: DataFrame, model: Model | None, penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang and score of each document, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _labelled(model, penalty)
        for batch in batches:
            langs, scores = zip(*of(batch.column(1)), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, lang string, score double")


def label_spans(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """doc_id, start, end and lang: one row for each stretch in one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            rows = [(i, *span) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for span in labeller.spans(t.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "end", "lang"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, start int, end int, lang string")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, least: float, bound: int | None = TRAIN_DOCS) -> DataFrame:
    """Documents whose language is known with at least the score learned, or the given one if higher."""
    model, cut = fit_with_cut(docs.filter(~held_out(F.col("doc_id"))), least, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _labelled(model, SWITCH)
        for batch in batches:
            good = [lang != UNKNOWN and score >= cut for lang, score in of(batch.column("text"))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs.schema)
