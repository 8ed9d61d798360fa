"""Language identification of mixed-language text.

A model is counted from labelled documents: for each language its character trigrams (words in lower case, padded) and the
scripts its letters come from.  A word's script narrows the candidates to the languages that use it; each candidate scores
the word by its mean trigram log-probability times the number of trigrams; Viterbi over the words with a switching penalty
labels spans; the document's language is the one whose spans hold most letters.  Letters count for no language where a word
has no candidate, or its best candidate gives it no more than a background model does (characters drawn one by one with
their frequencies in the candidate's training documents); they stay in the whole that a share is taken of.

Training may take a bounded sample: at most ``train_rows`` labelled documents, those with the least hash of their id.

Defined results: a null text and one without letters are ``und`` with score 0; a text whose letters count for no language has the language whose spans hold
most of its letters, with score 0; with no labelled documents everything is ``und``; ties go to the language that sorts first; repeated rows are labelled each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm.common import batch, give_back, held, numbered, read
from treegrammar.llm.tokens import some

#: First code points of script ranges, in order (fixed values of the Unicode block layout); a range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_FIRST, _NAME = [a for a, _ in SCRIPTS], [n for _, n in SCRIPTS]
SCRIPT_NAMES = sorted(set(_NAME))

DIMS = 1 << 15  # trigram buckets
CHARS, STRANGE = 1 << 12, 0.1  # slots of characters; share of the background that goes to all characters alike, as if there were 256
MEMO = 200_000
LONG, RUN = 4096, 512  # words of a document that is cut into runs, and of a run
LANES = 1 << 23  # back pointers of a long document that are held at once
SWITCH, FLOOR, RARE = 6.0, -30.0, 0.01  # penalty of a switch; score of a language that does not use the word's script; share of a language's letters from which it uses a script
TRAIN_ROWS = 6000
MARKS = ".,;:!?|\"'()[]{}<>*#%&$-_/0123456789"


def script(word: str) -> str:
    """Of the word's first letter."""
    return next((_NAME[bisect_right(_FIRST, ord(c)) - 1] for c in word if c.isalpha()), "")


def letters(word: str) -> str:
    """The word in lower case without what stands around its letters; inner marks stay."""
    core = word.strip(MARKS)
    if core.isalpha():
        return core.lower()
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0] : at[-1] + 1].lower() if at else ""


def grams(word: str) -> list[int]:
    """Trigram buckets by a polynomial over code points: the same on every machine."""
    p = [2, *map(ord, word), 3]
    return [(a * 961_748_927 + b * 31_337 + c * 2_654_435_761 >> 4) % DIMS for a, b, c in zip(p, p[1:], p[2:])]


class Model(NamedTuple):
    langs: list[str]
    logp: np.ndarray  # languages by buckets
    uses: dict[str, list[bool]]  # script -> does each language use it
    base: np.ndarray = np.zeros((0, CHARS))  # languages by slots of characters

    def scores(self, cores: list[str]) -> np.ndarray:
        """A row for each word as letters() leaves it: its languages' scores, 0 for all if none is a candidate."""
        return self.judged(cores)[0]

    def judged(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """scores(), and for each word whether a candidate gives it more than any candidate's characters alone do."""
        size = np.fromiter(map(len, cores), np.int64, len(cores))
        points = np.frombuffer("".join([f"\x02{c}\x03" for c in cores]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(size + 2) - size - 2
        bucket = (points[:-2] * 961_748_927 + points[1:-1] * 31_337 + points[2:] * 2_654_435_761 >> 4) % DIMS
        inside = np.ones(len(points), bool)  # all but the trigrams that begin in a word's last two places
        inside[first + size] = inside[first + size + 1] = False
        starts = np.cumsum(size) - size
        out = np.add.reduceat(np.ascontiguousarray(self.logp.T)[bucket[inside[:-2]]], starts, axis=0)
        char = np.ascontiguousarray(self.base.T)[points % CHARS]
        ground = np.add.reduceat((char[:-2] + char[1:-1] + char[2:])[inside[:-2]], starts, axis=0)
        where = np.searchsorted(_FIRST, points[first + 1], side="right") - 1
        can = np.array([self.uses[n] for n in _NAME])[where]
        best = np.where(can, out, -np.inf).max(axis=1, keepdims=True, initial=-1e30)
        out -= best
        known = can.any(axis=1) & (best[:, 0] > np.where(can, ground, -np.inf).max(axis=1, initial=-1e30))
        return np.where(can.any(axis=1, keepdims=True), np.where(can, np.maximum(out, FLOOR), FLOOR), 0).astype(np.float32), known


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Counts the model from the labelled documents that train picks; what reaches the driver is bounded by DIMS and the number of languages."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    # the sample: ids with hashes under a bound that keeps about train_rows of them
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.col("h") < int((train_rows / n - 0.5) * 2**64))
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        seen: dict[tuple[str, str, int], int] = {}
        memo: dict[str, tuple] = {}
        chars: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tri = np.zeros(DIMS, np.int64)
                every = chars.setdefault(lang, np.zeros(CHARS, np.int64))
                for w in text.split():
                    if w not in memo:
                        if len(memo) > MEMO:
                            memo.clear()
                        core = letters(w)
                        memo[w] = (grams(core), SCRIPT_NAMES.index(script(core)), len(core), [ord(c) % CHARS for c in f"\x02{core}\x03"]) if core else ([], 0, 0, [])
                    g, s, k, points = memo[w]
                    for x in g:
                        tri[x] += 1
                    for x in points:
                        every[x] += 1
                    if k:
                        seen[lang, "script", s] = seen.get((lang, "script", s), 0) + k
                for x in np.flatnonzero(tri).tolist():
                    seen[lang, "gram", x] = seen.get((lang, "gram", x), 0) + int(tri[x])
        seen.update(((lang, "char", x), int(every[x])) for lang, every in chars.items() for x in np.flatnonzero(every).tolist())
        if seen:
            langs, kinds, keys = zip(*seen)
            yield batch(schema, lang=langs, kind=kinds, key=keys, n=list(seen.values()))

    found = rows.select("lang", "text").mapInArrow(run, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), DIMS))
    script_n = np.zeros((len(langs), len(SCRIPT_NAMES)))
    char_n = np.zeros((len(langs), CHARS))
    for lang, kind, key, n in found.itertuples(index=False):
        {"gram": counts, "script": script_n, "char": char_n}[kind][langs.index(lang), key] += n
    smooth = 0.1
    logp = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * DIMS)).astype(np.float32)
    share = script_n / np.maximum(script_n.sum(axis=1, keepdims=True), 1)
    base = (1 - STRANGE) * char_n / np.maximum(char_n.sum(axis=1, keepdims=True), 1) + STRANGE / 256
    return Model(langs, logp, {s: (share[:, i] >= RARE).tolist() for i, s in enumerate(SCRIPT_NAMES)}, np.log(base).astype(np.float32))


class Walk:
    """Viterbi over many runs of words at a time, a word of each at a step, longest runs first."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float, value: np.ndarray):
        """scores: of distinct words; ids: a word each, runs one after another; value: what each language is worth before a run. value is then the worth at the runs' ends."""
        k = scores.shape[1]
        self.order = np.argsort(-lengths, kind="stable")
        self.starts, lengths = starts[self.order], lengths[self.order]
        self.came = np.zeros((len(ids), k), np.uint8 if k < 256 else np.uint16)
        self.active = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")  # runs that have a word t
        value = value[self.order]
        for t, n in enumerate(self.active.tolist()):
            at = self.starts[:n] + t
            v = value[:n]
            best = v.argmax(axis=1)
            top = np.take_along_axis(v, best[:, None], 1) - penalty
            switch = v < top
            self.came[at] = np.where(switch, best[:, None], np.arange(k))
            value[:n] = np.where(switch, top, v) + scores[ids[at]]
        self.value = np.empty_like(value)
        self.value[self.order] = value

    def back(self, last: np.ndarray) -> np.ndarray:
        """The language of every word if the runs end with the languages last."""
        out = np.zeros(len(self.came), self.came.dtype)
        state = last[self.order].astype(self.came.dtype)
        for t in range(len(self.active) - 1, -1, -1):
            at = self.starts[: self.active[t]] + t
            s = state[: self.active[t]]
            out[at] = s
            state[: self.active[t]] = self.came[at, s]
        return out


def viterbi(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word of documents that stand one after another in ids. Documents over LONG words are cut into runs, so that the time depends on all words and not on the longest document."""
    k = scores.shape[1]
    out = np.zeros(len(ids), np.uint8 if k < 256 else np.uint16)
    short = lengths <= LONG
    if short.any():
        n = lengths[short]
        take = np.repeat(starts[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        walk = Walk(scores, ids[take], np.cumsum(n) - n, n, penalty, np.zeros((len(n), k), np.float32))
        out[take] = walk.back(walk.value.argmax(axis=1))
    for start, n in zip(starts[~short].tolist(), lengths[~short].tolist()):
        out[start : start + n] = long_viterbi(scores, ids[start : start + n], penalty)
    return out


def long_viterbi(scores: np.ndarray, ids: np.ndarray, penalty: float) -> np.ndarray:
    """The same for one document.  Every run of RUN words is walked once for each language that may stand before it, a few runs at a
    time and for their end values only; these join the runs, and each is walked again from the one language that does stand before it."""
    k, n = scores.shape[1], -(-len(ids) // RUN)
    length = np.minimum(RUN, len(ids) - np.arange(n) * RUN)
    ends = np.empty((n, k, k))
    some_runs = max(1, LANES // (RUN * k * k))
    for i in range(0, n, some_runs):
        runs = np.arange(i, min(n, i + some_runs))
        each = np.repeat(length[runs], k)
        starts = np.cumsum(each) - each
        take = np.repeat(np.repeat(runs * RUN, k) - starts, each) + np.arange(each.sum())
        before = np.tile(np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-1e30)), (len(runs), 1))
        if not i:
            before[:k] = 0  # nothing stands before the first run
        ends[runs] = Walk(scores, ids[take], starts, each, penalty, before).value.reshape(len(runs), k, k)
    worth, best = ends[0, 0], np.zeros((n, k), np.int64)
    for i in range(1, n):
        ways = worth[:, None] + ends[i]
        best[i] = ways.argmax(axis=0)
        worth = ways.max(axis=0)
    last = np.zeros(n, np.int64)
    last[-1] = worth.argmax()
    for i in range(n - 1, 0, -1):
        last[i - 1] = best[i, last[i]]
    before = np.full((n, k), np.float32(-1e30))
    before[np.arange(1, n), last[:-1]] = 0
    before[0] = 0
    return Walk(scores, ids, np.arange(n) * RUN, length, penalty, before).back(last)


class Labeller:
    """Words' scores, remembered; one for each task."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self):
        """Row 0 stands for words without letters."""
        self.memo: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, len(self.model.langs)), np.float32)
        self.size = np.zeros(1, np.int64)
        self.known = np.zeros(1, bool)

    def look_up(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        new = {w: letters(w) for w in set(words).difference(memo)}
        cores = list(set(new.values()).difference(memo))
        if cores:
            memo.update(zip(cores, range(len(self.size), len(self.size) + len(cores))))
            scores, known = self.model.judged(cores)
            self.scores = np.concatenate([self.scores, scores])
            self.known = np.append(self.known, known)
            self.size = np.append(self.size, np.fromiter(map(len, cores), np.int64, len(cores)))
        memo.update((w, memo[c]) for w, c in new.items())
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None], penalty: float) -> list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Words, their languages (index), their letters and those that count for their language, for each text."""
        if len(self.memo) > MEMO:
            self.reset()
        split = [(t or "").split() for t in texts]
        lengths = np.array([len(w) for w in split])
        ends = np.cumsum(lengths)
        ids = self.look_up([w for words in split for w in words])
        lang = viterbi(self.scores, ids, ends - lengths, lengths, penalty)
        size = self.size[ids]
        own = np.where(self.known[ids], size, 0)
        return [(w, lang[e - len(w) : e], size[e - len(w) : e], own[e - len(w) : e]) for w, e in zip(split, ends.tolist())]


def spans(words: list[str], lang: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, word after, language) of each run."""
    cut = np.flatnonzero(np.diff(lang)) + 1
    at = [0, *cut.tolist(), len(words)]
    return [(a, b, int(lang[a])) for a, b in zip(at, at[1:]) if b > a]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans): score is the share of letters that count for lang_pred in its spans; spans: (first word, word after, language)."""
    fields = "doc_id long, lang_pred string, score double, spans array<struct<first:int,after:int,lang:string>>"
    span = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches):
        labeller = Labeller(model) if model.langs else None
        for b in batches:
            for i, j, texts in some(b.column(1)):
                langs, shares, runs = [], [], []
                for words, lang, size, own in labeller.label(texts, penalty) if labeller else [([], *[np.zeros(0, int)] * 3)] * (j - i):
                    if not size.sum():  # no letter
                        langs.append("und")
                        shares.append(0.0)
                        runs.append([])
                        continue
                    by = np.bincount(lang, own, minlength=len(model.langs))
                    best = int(by.argmax() if by.any() else np.bincount(lang, size).argmax())
                    langs.append(model.langs[best])
                    shares.append(float(by[best] / size.sum()))
                    runs.append([{"first": a, "after": z, "lang": model.langs[k]} for a, z, k in spans(words, lang)])
                yield batch(schema, doc_id=b.column(0).slice(i, j - i), lang_pred=langs, score=shares, spans=pa.array(runs, schema.field("spans").type))
        labeller = None
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


def keep_languages(docs: DataFrame, model: Model, least_share: float, text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH) -> DataFrame:
    """docs without the documents that have no language, or none with least_share of their letters; a null lang takes the prediction."""

    text_at, at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        labeller = Labeller(model) if model.langs else None
        for b in batches:
            keep, named = [False] * b.num_rows, [None] * b.num_rows
            for i, _, texts in some(b.column(text_at)) if labeller else ():
                for k, (words, lang, size, own) in enumerate(labeller.label(texts, penalty), i):
                    by = np.bincount(lang, own, minlength=len(model.langs)) if len(words) else np.zeros(1)
                    if by.max() and by.max() >= least_share * size.sum():
                        keep[k], named[k] = True, model.langs[int(by.argmax())]
            b = b.set_column(at, b.schema.field(at), pc.coalesce(b.column(at), pa.array(named, pa.string()).cast(b.schema.field(at).type)))
            yield b.filter(pa.array(keep, pa.bool_()))
        labeller = None
        give_back()

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, ~held(F.col("doc_id"), 3, 1))
    return identify(docs, model).select("doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
