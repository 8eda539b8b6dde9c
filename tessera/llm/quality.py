"""Quality classifier from weak labels.

Two tasks, junk and abuse, each with overlapping heuristic labellers that vote bad, good or abstain. One pass over all
documents stores their votes and features. The counts of vote patterns (at most 3^labellers rows) are all that
expectation-maximisation needs to estimate the labellers' accuracies and the classes' sizes; they give each pattern a
posterior. The posteriors of a bounded sample of documents (SAMPLE, a parameter) train one hashed linear scorer per
task, whose features are the words, their outer shapes and the votes. All documents are then scored from what is
stored; a document is rejected where either scorer finds it more likely bad than not.

Where a table of labels is given, a bounded sample of its rows (LABELLED, a parameter) is split by a hash into FOLDS.
Each fold gives one abuse labeller: a word list of those words that stand almost only in its documents labelled toxic,
counted by distinct neighbouring words so that copies of a document count once. The sample's classes are known to the
EM: their vote patterns count for the known class, and there a fold's own list abstains, so no list is judged by the
rows that it was drawn from. Without labels the fold lists abstain and a prior stands for the missing rows.

Defined cases: null counts as empty; a text without words is junk. Repeated rows get equal scores. A labelled row with
a null label counts as not labelled; of several rows of one id one counts. An empty table gives an empty result. The
sample is chosen by a hash of the text, so the model depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table, text_map, whole_text, written

#: Documents that train the scorers, about.
SAMPLE = 8_000
#: Labelled rows, about, from which the word list of the labelled abuse labeller is drawn, and its most words.
LABELLED = 20_000
MOST_WORDS = 2_000
DIMENSIONS = 1 << 18
EPOCHS = 6
TASKS = ("junk", "abuse")

# fixed values: word lists of the labellers
INSULTS = frozenset(
    (
        "trash idiot stupid moron loser dumb fool imbecile jerk creep "
        "pathetic worthless disgusting clown scum vermin filth garbage freak coward"
    ).split()
)
FUNCTION_WORDS = frozenset(
    (
        "the of and to in is that it for was on are as with be by this at or from an a "
        "le la les de des du et en un une que qui dans pour par sur au aux pas avec est "
        "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch "
        "el los las y una por con para del se no lo su al es"
    ).split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[%*&$#|<>{}\[\]^~=+\\@_]+")
_TAIL = re.compile(r"[%*&$#|<>{}\[\]^~=+\\@_!]+(?=\s|$)")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_CAPITALS = bytes(range(0x41, 0x5B))
#: Parts of the labelled sample, each with a word list of its own.
FOLDS = 2
N_LABELLERS = (7, 1 + FOLDS)
#: What is known of labellers before any count: bad votes on good documents, and the weight of that, as a share of all
#: documents where no label is known and in rows where some are.
FALSE_BAD, PRIOR_SHARE, PRIOR_ROWS = 0.005, 0.25, 20.0
Lists = tuple[frozenset[str], ...]
NO_LISTS: Lists = (frozenset(),) * FOLDS
#: Words whose feature numbers a worker remembers; a full table is emptied.
_REMEMBERED = 200_000


def upper_letters(text: str) -> int:
    """Characters of the whole text that are upper case; A-Z are counted as bytes."""
    data = text.encode()
    beyond = 0 if len(data) == len(text) else sum(map(str.isupper, _BEYOND.findall(text)))
    return len(data) - len(data.translate(None, _CAPITALS)) + beyond


def votes(text: str, lists: Lists = NO_LISTS) -> tuple[tuple[int, ...], tuple[int, ...], list[str]]:
    """Votes of the junk and the abuse labellers (1 bad, -1 good, 0 abstain), and the lower-cased words."""
    words = _WORD.findall(text.lower())
    n, solid = len(words), max(1, len(text) - text.count(" ") - text.count("\n"))
    tokens = max(1, text.count(" ") + text.count("\n") + 1)

    def vote(value: float, good: float, bad: float) -> int:
        """Bad beyond bad, good before good; good may lie on either side."""
        if good < bad:
            return 1 if value > bad else -1 if value < good else 0
        return 1 if value < bad else -1 if value > good else 0

    symbols = sum(map(len, _SYMBOLS.findall(text)))
    letters = sum(map(len, words)) or 1
    upper = upper_letters(text)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = set(words)
    junk = (
        vote(symbols / solid, 0.02, 0.06),
        vote(repeats / max(1, n), 0.05, 0.2),
        vote(upper / letters, 0.2, 0.5),
        vote(len(distinct) / n, 0.35, 0.2) if n >= 50 else 0,
        vote(len(_TAIL.findall(text)) / tokens, 0.05, 0.25),
        vote(sum(w in FUNCTION_WORDS for w in words) / n, 0.1, 0.03) if n >= 20 else 0,
        1 if n == 0 else -1,
    )
    if not n:  # nothing there to judge by ratios
        junk = (*(max(v, 0) for v in junk[:-1]), 1)
    abuse = tuple(0 if not words_ else -1 if distinct.isdisjoint(words_) else 1 for words_ in (INSULTS, *lists))
    return junk, abuse, words


def _code(vote: tuple[int, ...]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v + 1
    return out


def _decode(code: int, size: int) -> list[int]:
    out = []
    for _ in range(size):
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


@dataclass(frozen=True)
class LabelModel:
    """prior: share of bad documents; rates[class, labeller, vote]: how often a labeller that votes at all
    votes bad or good on a class, and how often it abstains."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = patterns + 1
        j = np.arange(patterns.shape[1])
        logs = np.log(self.rates)
        logs[:, :, 1] = 0  # to abstain says nothing
        bad = np.log(self.prior) + logs[1][j, at].sum(1)
        good = np.log1p(-self.prior) + logs[0][j, at].sum(1)
        return 1.0 / (1.0 + np.exp(np.clip(good - bad, -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
    """EM for two classes with independent labellers; starts from 'a document with a bad vote is likely bad'.

    known: 0 or 1 for the patterns of documents whose class is known, -1 for the others; those stay as they are.
    """
    known = np.full(len(patterns), -1) if known is None else known
    q = np.where((patterns == 1).any(1), 0.9, 0.1)
    model = LabelModel(0.5, np.full((2, patterns.shape[1], 3), 1 / 3))
    # labellers are written to be precise: the prior keeps the mixture from calling one of their groups good
    weight = PRIOR_ROWS if (known >= 0).any() else PRIOR_SHARE * counts.sum()
    for _ in range(rounds):
        q = np.where(known >= 0, known, q)
        prior = float((counts @ q + 1) / (counts.sum() + 2))
        rates = np.empty((2, patterns.shape[1], 3))
        for c, share in ((1, counts * q), (0, counts * (1 - q))):
            for v in (-1, 0, 1):
                rates[c, :, v + 1] = share @ (patterns == v)
            # a little prior mass: labellers are better than chance
            rates[c] += np.asarray((0.5, 0.5, 1.5) if c else (0.5 + weight * (1 - FALSE_BAD), 0.5, 0.5 + weight * FALSE_BAD))
            cast = rates[c, :, 0] + rates[c, :, 2]
            rates[c, :, 1] /= rates[c].sum(1)
            rates[c, :, 0] /= cast
            rates[c, :, 2] /= cast
        model = LabelModel(min(max(prior, 1e-4), 1 - 1e-4), rates)
        q = model.posterior(patterns)
    return model


_numbers: dict[str, int] = {}


def _number(name: str) -> int:
    """The number of a feature."""
    out = _numbers.get(name)
    if out is None:
        if len(_numbers) >= _REMEMBERED:
            _numbers.clear()
        out = _numbers[name] = zlib.crc32(name.encode()) % DIMENSIONS
    return out


def features(text: str, lists: Lists = NO_LISTS) -> tuple[int, int, np.ndarray, int]:
    """(junk pattern, abuse pattern, distinct feature numbers, number of vote features at the end of them)."""
    junk, abuse, words = votes(text, lists)
    named = set(map(_number, set(words)))
    named |= {zlib.crc32(b"tail " + t.encode()) % DIMENSIONS for t in set(_TAIL.findall(text))}
    marks = [_number(f"vote {i} {v}") for i, v in enumerate((*junk, *abuse))]
    named.difference_update(marks)
    return _code(junk), _code(abuse), np.asarray([*sorted(named), *marks], np.int32), len(marks)


def _values(index: np.ndarray, marks: int) -> np.ndarray:
    """Words share a vector of length one; votes count whole."""
    words = len(index) - marks
    out = np.ones(len(index), np.float32)
    out[:words] = 1 / np.sqrt(max(1, words))
    return out


def fit_scorer(rows: list[np.ndarray], marks: list[int], target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; weights of DIMENSIONS features and a bias."""
    w, g2 = np.zeros(DIMENSIONS + 1, np.float32), np.full(DIMENSIONS + 1, 1e-3, np.float32)
    order = np.random.default_rng(0)
    values = [_values(r, m) for r, m in zip(rows, marks, strict=True)]
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, x = rows[i], values[i]
            p = 1 / (1 + np.exp(-np.clip(w[index] @ x + w[-1], -30, 30)))
            error = p - target[i]
            grad = error * x + decay * w[index]
            g2[index] += grad * grad
            g2[-1] += error * error
            w[index] -= rate * grad / np.sqrt(g2[index])
            w[-1] -= rate * error / np.sqrt(g2[-1])
    return w


@dataclass(frozen=True)
class Model:
    labels: tuple[LabelModel, ...]
    weights: tuple[np.ndarray, ...]
    lists: Lists = NO_LISTS

    def posteriors(self, task: int, codes: np.ndarray) -> np.ndarray:
        """Posteriors of pattern codes; each code is worked out once."""
        distinct, at = np.unique(codes, return_inverse=True)
        return self.labels[task].posterior(np.asarray([_decode(int(c), N_LABELLERS[task]) for c in distinct]).reshape(-1, N_LABELLERS[task]))[at]

    def score(self, index: np.ndarray, marks: int) -> tuple[float, ...]:
        """(scored junk, scored abuse)."""
        x = _values(index, marks)
        return tuple(float(1 / (1 + np.exp(-np.clip(w[index] @ x + w[-1], -30, 30)))) for w in self.weights)


VOTED = "junk int, abuse int, features binary, marks int"


def voted(docs: DataFrame, lists: Lists = NO_LISTS, text_col: str = "text", text: bool = True) -> DataFrame:
    """docs with the patterns of their votes and their features; without the text where it is not asked for."""
    held = docs.columns if text else [c for c in docs.columns if c != text_col]
    taken = docs.select(F.struct(*[F.col(c) for c in held]).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [features(t.as_py() or "", lists) for t in part.column(1)]
                columns = [pa.array([m[i] for m in made], pa.int32()) for i in (0, 1, 3)]
                bits = pa.array([m[2].tobytes() for m in made], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), columns[0], columns[1], bits, columns[2]], ["_row", "junk", "abuse", "features", "marks"])
        _numbers.clear()  # workers live on for other stages

    return text_map(taken, run, f"_row {taken.schema['_row'].dataType.simpleString()}, {VOTED}")


def labelled_sample(labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id") -> DataFrame:
    """(id, quality, toxic, fold) of about ``labelled`` labelled rows, one of each id."""
    total = labels.count()
    share = int(min(1.0, labelled / max(1, total)) * (1 << 30))
    h = F.xxhash64(id_col)
    some = labels.where(F.pmod(h, F.lit(1 << 30)) < share).select(F.col(id_col).alias("_id"), "quality", "toxic", F.pmod(F.shiftright(h, 32), F.lit(FOLDS)).cast("int").alias("fold"))
    return some.dropna().groupBy("_id", "fold").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def word_lists(docs: DataFrame, some: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lists:
    """For each fold the words that mark its documents labelled toxic."""
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    # the sample's size is bounded by its parameter
    texts = texts.join(F.broadcast(some.select("_id", "fold", "toxic")), "_id").select("fold", "toxic", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                rows = set()
                for fold, toxic, t in zip(*(c.to_pylist() for c in batch.slice(lo, 100).columns), strict=True):
                    words = _WORD.findall(t.lower())
                    rows.update((fold, w, zlib.crc32(before.encode()), int(toxic)) for before, w in zip(["", *words], words, strict=False) if len(w) > 2)
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["fold", "word", "context", "toxic"])

    seen = text_map(texts, run, "fold int, word string, context long, toxic int").groupBy("fold", "word", "context").agg(F.min("toxic").alias("toxic"))
    counts = seen.groupBy("fold", "word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    # a document's words are toxic contexts at the rate of toxic documents; far above it, a word is a mark
    with small_batches(docs.sparkSession):
        marks = counts.where("bad >= 4 AND bad >= 0.96 * n").orderBy(F.desc("bad"), "word", "fold").limit(FOLDS * MOST_WORDS).collect()
    return tuple(frozenset(r["word"] for r in marks if r["fold"] == fold) for fold in range(FOLDS))


def pattern_counts(rows: DataFrame, some: DataFrame | None, id_col: str = "doc_id") -> list[tuple[int, int, int, int, int]]:
    """(task, pattern, known class or -1, fold or -1, documents) over all rows of voted()."""
    none = F.lit(-1)
    if some is None:
        known = rows.withColumns({"quality": none, "toxic": none, "fold": none})
    else:
        known = rows.withColumn("_id", F.col(f"_row.`{id_col}`")).join(F.broadcast(some), "_id", "left")
    bad = F.when(F.col("quality") >= 0, 1 - F.col("quality")).otherwise(none)
    counts = known.groupBy("junk", "abuse", bad.alias("bad"), F.coalesce("toxic", none).alias("toxic"), F.coalesce("fold", none).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    out: Counter[tuple[int, int, int, int]] = Counter()
    for r in counts.collect():
        out[0, r["junk"], r["bad"], -1] += r["n"]
        out[1, r["abuse"], r["toxic"], r["fold"]] += r["n"]
    return [(*key, n) for key, n in sorted(out.items())]


def fit(rows: DataFrame, lists: Lists = NO_LISTS, some: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id") -> Model | None:
    """The model of stored rows of voted(), or None for an empty table."""
    counted = pattern_counts(rows, some, id_col)
    if not counted:
        return None
    models = []
    for task, size in enumerate(N_LABELLERS):
        own = [r for r in counted if r[0] == task]
        patterns = np.asarray([_decode(r[1], size) for r in own])
        if task:  # a list abstains on the rows that it was drawn from
            for i, r in enumerate(own):
                if r[3] >= 0:
                    patterns[i, 1 + r[3]] = 0
        models.append(fit_labels(patterns, np.asarray([r[4] for r in own], float), np.asarray([r[2] for r in own])))
    total = sum(r[4] for r in counted if r[0] == 0)
    # equal texts have equal features and are chosen together: one of each trains
    share = int(min(1.0, sample / total) * (1 << 30))
    chosen = rows.where(F.pmod(F.xxhash64("features", F.lit(10)), F.lit(1 << 30)) < share)
    kept = chosen.groupBy("features", "junk", "abuse", "marks").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("features", F.lit(11)), "features").limit(2 * sample).collect()
    kept.sort(key=lambda r: bytes(r["features"]))
    index = [np.frombuffer(bytes(r["features"]), np.int32) for r in kept]
    marks = [r["marks"] for r in kept]
    model = Model(tuple(models), (), lists)
    weights = tuple(fit_scorer(index, marks, model.posteriors(task, np.asarray([r[name] for r in kept], np.int64))) for task, name in enumerate(TASKS))
    return Model(tuple(models), weights, lists)


def prepared(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> tuple[DataFrame, Model | None]:
    """(stored rows of voted(), model): the labellers run once over docs."""
    some, lists = None, NO_LISTS
    if labels is not None:
        some = written(labelled_sample(labels, labelled, id_col), "labelled")
        lists = word_lists(docs, some, id_col, text_col)
        some = None if some.isEmpty() else some
    rows = written(voted(docs, lists, text_col, text), "voted")
    return rows, fit(rows, lists, some, sample, id_col)


def scored(rows: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """id with posteriors, scores and kept, from rows of voted()."""
    names = [id_col, "p_junk", "p_abuse", "s_junk", "s_abuse", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            post = [model.posteriors(task, batch.column(1 + task).to_numpy()) for task in range(2)]
            score = np.asarray([model.score(np.frombuffer(f.as_buffer(), np.int32), m.as_py()) for f, m in zip(batch.column(3), batch.column(4), strict=True)])
            worst = score.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (*post, *score.T.copy(), 1.0 - worst, worst <= 0.5))], names)

    taken = rows.select(F.col(f"_row.`{id_col}`").alias(id_col), "junk", "abuse", "features", "marks")
    kind = taken.schema[id_col].dataType.simpleString()
    return text_map(taken, run, f"`{id_col}` {kind}, p_junk double, p_abuse double, s_junk double, s_abuse double, score double, kept boolean")


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id with posteriors, scores and kept of documents that the model need not have seen."""
    return scored(voted(docs.select(id_col, text_col), model.lists if model else NO_LISTS, text_col, False), model, id_col)


def keep_good(rows: DataFrame, model: Model | None) -> DataFrame:
    """Of rows of voted() those that the classifier keeps, with docs' own columns; a filter without a shuffle or a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [max(model.score(np.frombuffer(f.as_buffer(), np.int32), m.as_py())) <= 0.5 for f, m in zip(batch.column(1), batch.column(2), strict=True)]
            yield batch.select([0]).filter(pa.array(keep, pa.bool_()))

    taken = rows.select("_row", "features", "marks")
    return text_map(taken, run, f"_row {taken.schema['_row'].dataType.simpleString()}").select("_row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = prepared(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), text=False)
    return scored(rows, model)
