"""Scoring of texts by a word-count base and a causal self-attention language model.

Word counts cover all training documents. The frequent words, a list of fixed length
(``frequent``), travel to the tasks; every other occurrence meets its count in a join, so the
counts may be of any size. Subword frequencies follow from the word counts.

The model is one attention over the first ids of the words of a text and one over the ids inside
a word. Both start from one set of parameters and are trained where their rows are: each task
takes gradient steps on its share, the parameters are averaged over all tasks, and this is
repeated ``rounds`` times; how rows lie in tasks shapes the model. For the first, every training
document is cut into runs of ``SPAN`` words and used in one of the rounds. The second is trained
on the table of distinct training words, each in one of the rounds: counts tell how often a known
word occurs, so what the model has to know is how words are made. The inside of every distinct word
of all texts is scored once, in that table, with the word's count; texts are scored whole and join
those values, the frequent ones in the tasks and the others in the join.

Defined cases: a null or empty text is the end token alone; a null id is never held out; without
training documents all counts are zero and the model has even classes; repeated rows are scored
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.attention_lm import END, VOCABULARY, Adam, Attention, Classes, make_classes, split_words
from quillgraph.llm.packing import tokenizer
from quillgraph.llm.storage import stored

SPAN = 32
#: Words of text scored, counted and learnt from at once, and blocks of positions per gradient step.
CHUNK, COUNTED, TOGETHER, STEP = 400_000, 1_600_000, 800_000, 1024


def _selected(docs: DataFrame, hold: int, held: int, id_col: str, text_col: str) -> DataFrame:
    key = F.col(id_col)
    return docs.select(
        key.cast("long").alias("doc_id"),
        F.coalesce(F.crc32(key.cast("string").cast("binary")) % hold == held, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spans_of(doc: int | None, text: str | None, turn: int, rounds: int) -> Iterator[list[bytes]]:
    """The runs of ``SPAN`` words of a text that round ``turn`` of ``rounds`` uses, the last with the end token.

    Texts are dealt to the rounds by their ids, and each round uses all runs of its texts; :func:`train`
    does this with many texts at a time.
    """
    if (doc or 0) % rounds == turn:
        words = [*words_of(text), b""]
        for k in range(0, len(words), SPAN):
            yield words[k : k + SPAN]


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the numbers of :func:`words_of` all texts side by side, and how many each text has.

    The first word is the empty one, and stands after each text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    codes, real = coded.indices.to_numpy(zero_copy_only=False), pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        kept = real[codes]
        sizes, codes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes)), codes[kept]
    sizes = sizes.astype(np.int64) + 1
    out = np.zeros(sizes.sum(), np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = np.cumsum(real, dtype=np.int32)[codes]
    kinds = coded.dictionary.filter(pa.array(real)).cast(pa.binary())
    return pa.concat_arrays([pa.array([b""], pa.binary()), kinds]), out, sizes


def portions(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``size`` words in column ``text`` at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False) // 6 + 1)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(ends)], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def span_sizes(sizes: np.ndarray) -> np.ndarray:
    """Words per span of texts that lie side by side."""
    spans = -(-sizes // SPAN)
    out = np.full(spans.sum(), SPAN)
    out[np.cumsum(spans) - 1] = (sizes - 1) % SPAN + 1
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word and n, its training occurrences, per portion of a task; the empty word is the end token.

    Words of held-out documents alone have n zero.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, 1, COUNTED):
                kinds, codes, sizes = coded_words(rows.column(1))
                taught = np.repeat(~rows.column(0).to_numpy(zero_copy_only=False), sizes)
                n = np.bincount(codes[taught], minlength=len(kinds))
                yield pa.RecordBatch.from_arrays([kinds, pa.array(n)], names=["word", "n"])

    return docs.select("held_out", "text").mapInArrow(count, "word binary, n long")


def subword_counts(counts: DataFrame, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the training texts of first ids (and ends), and of inner ids (and stops),
    and distinct words by first id.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, VOCABULARY))
        tokens = tokenizer(vocabulary)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            real = np.array([bool(w) for w in words], bool)
            heads, inner, sizes = split_words(tokens, [w for w in words if w])
            total[0] += np.bincount(heads, n[real], VOCABULARY)
            total[1] += np.bincount(inner, np.repeat(n[real], sizes), VOCABULARY)
            total[2] += np.bincount(heads, minlength=VOCABULARY)
            total[0, END] += n[~real].sum()
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["id", "n"])

    rows = counts.mapInArrow(split, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(3 * VOCABULARY)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return tuple(out.reshape(3, VOCABULARY))


class WordMemory:
    """Counts of words, which sharpen what the model says of the inside of a word.

    After a first id with ``all`` training occurrences, of which the counted words have
    ``all - rest``, an inside of probability p and count c gets
    (c + (kinds + rest) * p) / (all + kinds), ``kinds`` being the counted words with that first id.
    These sum to one over all insides, as p does. ``known`` has the counts at hand; if ``kinds`` is
    given, all words are counted, and what is not in ``known`` has its count elsewhere.
    """

    def __init__(self, known: dict[bytes, int], firsts: np.ndarray, vocabulary: str, kinds: np.ndarray | None = None):
        rest = 0.0
        if kinds is None:
            words = [w for w in known if w]
            heads = split_words(tokenizer(vocabulary), words)[0]
            counts = np.fromiter((known[w] for w in words), float, len(words))
            kinds = np.bincount(heads, minlength=VOCABULARY)
            rest = np.maximum(firsts - np.bincount(heads, counts, VOCABULARY), 0)
        seen = firsts + kinds > 0
        self.known = known
        with np.errstate(divide="ignore"):
            self.free = np.where(seen, np.log(kinds + rest), 0.0)
        self.whole = np.where(seen, np.log(np.maximum(firsts + kinds, 1)), 0.0)

    def sharpened(self, words: list[bytes], heads: np.ndarray, inside: np.ndarray) -> np.ndarray:
        counts = np.fromiter((self.known.get(w, 0) for w in words), float, len(words))
        return self.valued(counts, heads, inside)

    def valued(self, counts: np.ndarray, heads: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """:meth:`sharpened` with the counts given."""
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(counts), self.free[heads] + inside) - self.whole[heads]


class Scorer:
    """Both models with their classes."""

    def __init__(self, classes: tuple[Classes, Classes], width: int, params: np.ndarray | None, vocabulary: str):
        self.classes = classes
        parts = (None, None) if params is None else np.split(params, 2)
        self.outer, self.inner = (
            Attention(c.count, width, part, c.prior) for c, part in zip(classes, parts, strict=True)
        )
        self._tokens = tokenizer(vocabulary)

    @property
    def params(self) -> np.ndarray:
        return np.concatenate([self.outer.params, self.inner.params])

    def inner_blocks(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """First ids, all inner ids with stops, and the blocks of the inner stream."""
        heads, inner, sizes = split_words(self._tokens, words)
        starts = self.classes[0].of[heads].astype(np.int32)
        blocks = self.inner.blocks(self.classes[1].of[inner], sizes, starts)
        return heads, inner, (*blocks, sizes)

    def insides(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First ids and log probabilities of the insides of words."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        heads, inner, (keys, targets, mask, sizes) = self.inner_blocks(words)
        each = self.inner.scored(keys, targets, mask) + self.classes[1].within[inner]
        return heads, np.add.reduceat(each, np.cumsum(sizes) - sizes)

    def heads(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """First ids of words; the empty word is the end of a text."""
        words = words.to_numpy(zero_copy_only=False).tolist() if isinstance(words, pa.Array) else words
        real = np.fromiter(map(bool, words), bool, len(words))
        heads = np.full(len(words), END)
        heads[real] = split_words(self._tokens, [w for w in words if w])[0]
        return heads

    def outer_blocks(self, heads: np.ndarray, sizes: np.ndarray) -> tuple:
        return self.outer.blocks(self.classes[0].of[heads], sizes)

    def texts(self, words: list[bytes], sizes: list[int]) -> np.ndarray:
        """Natural log probability of the first ids of texts, each closed by an empty word."""
        return self.streams(self.heads(words), np.asarray(sizes))

    def streams(self, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """:meth:`texts` by first ids."""
        each = self.outer.scored(*self.outer_blocks(heads, sizes)) + self.classes[0].within[heads]
        return np.add.reduceat(each, np.cumsum(sizes) - sizes)


def _steps(model: Attention, adam: Adam, keys: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> None:
    order = np.random.default_rng(len(keys)).permutation(len(keys))
    for k in range(0, len(order), STEP):
        pick = order[k : k + STEP]
        adam.step(model.params, model.gradient(keys[pick], targets[pick], mask[pick])[1])


def _averaged(rows: DataFrame, learn, size: int) -> np.ndarray | None:
    """Mean of the parameters that ``learn`` reaches in each task, weighted by positions.

    A task sends one array; arrays are added in groups of tasks before the last sum.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(size), 0.0
        for batch in batches:
            for raw, n in zip(batch.column("value").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                total += np.frombuffer(raw)
                weight += n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([weight])], names=["value", "weight"])

    shape = "value binary, weight double"
    parts = rows.mapInArrow(learn, shape)
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // 16)
        parts = parts.repartition(tasks).mapInArrow(added, shape)
    found = parts.collect()
    return np.frombuffer(found[0]["value"]) / found[0]["weight"] if found else None


def _learnt(model: Attention, positions: int) -> Iterator[pa.RecordBatch]:
    if positions:
        value = (model.params.astype(float) * positions).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([float(positions)])], names=["value", "weight"])


def train(
    docs: DataFrame,
    counts: DataFrame,
    classes: tuple[Classes, Classes],
    vocabulary: str,
    rounds: int,
    rate: float,
    width: int,
) -> np.ndarray:
    """Parameters of both models after ``rounds`` of local gradient steps and averaging.

    The rounds share all training documents, with all their spans, and all training words of ``counts``
    (word, c), between them.
    """
    taught = docs.where("not held_out").select("doc_id", "text")
    spelled = counts.where("c > 0 and octet_length(word) > 0").select("word")
    params = Scorer(classes, width, None, vocabulary).params
    half = len(params) // 2

    def learn_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(classes, width, params, vocabulary)
        adam, positions = Adam(half, rate), 0
        for batch in batches:
            for rows in portions(batch, 0, TOGETHER):
                kinds, codes, sizes = coded_words(rows.column(0))
                _steps(scorer.outer, adam, *scorer.outer_blocks(scorer.heads(kinds)[codes], span_sizes(sizes)))
                positions += len(codes)
        yield from _learnt(scorer.outer, positions)

    def learn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(classes, width, params, vocabulary)
        adam, positions = Adam(half, rate), 0
        for batch in batches:
            if batch.num_rows:
                _, inner, (keys, targets, mask, _) = scorer.inner_blocks(batch.column(0).to_pylist())
                _steps(scorer.inner, adam, keys, targets, mask)
                positions += len(inner)
        yield from _learnt(scorer.inner, positions)

    for turn in range(rounds):
        mine = spelled.where(F.pmod(F.xxhash64("word"), F.lit(rounds)) == turn)
        texts = taught.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(rounds)) == turn).select("text")
        following = (
            _averaged(texts, learn_texts, half),
            _averaged(mine, learn_words, half),
        )
        parts = np.split(params, 2)
        params = np.concatenate([old if new is None else new for new, old in zip(following, parts, strict=True)]).astype(np.float32)
    return params


def value_words(
    counts: DataFrame, memory: WordMemory, classes: tuple[Classes, Classes], params: np.ndarray, vocabulary: str, width: int
) -> DataFrame:
    """``word, c, value, head``: the natural log probability of the inside of each word, its count known, and its first id."""

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(classes, width, params, vocabulary)
        for batch in batches:
            if batch.num_rows:
                heads, inside = scorer.insides(batch.column(0).to_pylist())
                values = memory.valued(batch.column(1).to_numpy().astype(float), heads, inside)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array(heads)], names=["word", "c", "value", "head"])

    return counts.where("octet_length(word) > 0").select("word", "c").mapInArrow(value, "word binary, c long, value double, head long")


SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "rare array<binary>, times array<int>"
)


def score_rows(
    docs: DataFrame,
    known: dict[bytes, tuple[int, float, int]],
    classes: tuple[Classes, Classes],
    params: np.ndarray,
    vocabulary: str,
    width: int,
) -> DataFrame:
    """Per row both sums over the frequent words, and the other words for the join.

    ``known``: count, value of the inside and first id of each frequent word.
    """
    listed = pa.array([*known], pa.binary())
    firsts = np.array([*(head for *_, head in known.values()), END])
    # A last row of zeros for all other words.
    logs = np.array([*((float(np.log10(c + 1)), value, 1.0) for c, value, _ in known.values()), (0.0, 0.0, 0.0)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(classes, width, params, vocabulary)
        row = TaskContext.get().partitionId() << 33

        def measured(rows: pa.RecordBatch) -> pa.RecordBatch:
            kinds, codes, sizes = coded_words(rows.column(2))
            at = pc.fill_null(pc.index_in(kinds, value_set=listed), len(listed)).to_numpy(zero_copy_only=False)
            base, inside, found = (
                np.add.reduceat(column[at][codes], np.cumsum(sizes) - sizes) for column in np.ascontiguousarray(logs.T)
            )
            rare = np.flatnonzero((at == len(listed))[codes])
            text = np.repeat(np.arange(len(sizes)), sizes)[rare]
            keys, times = np.unique(text * len(kinds) + codes[rare], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * len(kinds)), pa.int32())
            heads, unlisted = firsts[at], np.flatnonzero(at == len(listed))
            heads[unlisted] = scorer.heads(kinds.take(pa.array(unlisted)))
            scores = (scorer.streams(heads[codes], sizes) + inside) / np.log(10)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(sizes))),
                    rows.column(0),
                    rows.column(1),
                    pa.array(sizes),
                    pa.array(found.astype(np.int64)),
                    pa.array(base),
                    pa.array(scores),
                    pa.ListArray.from_arrays(ends, kinds.take(pa.array(keys % len(kinds)))),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
                ],
                names=[part.split()[0] for part in SCORED.split(", ")],
            )

        for batch in batches:
            for rows in portions(batch, 2, CHUNK):
                yield measured(rows)
                row += rows.num_rows

    return docs.mapInArrow(score, SCORED)


def score_texts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k",
    hold: int = 7,
    held: int = 2,
    frequent: int = 1 << 17,
    rounds: int = 2,
    rate: float = 0.02,
    width: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base and model log10 probability of every text."""
    rows = _selected(docs, hold, held, id_col, text_col)
    counts = stored(count_words(rows).groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    taught = counts.where("c > 0")
    total, distinct = taught.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    subwords = subword_counts(taught, vocabulary)
    memory = WordMemory({}, subwords[0], vocabulary, subwords[2])
    classes = tuple(make_classes(c) for c in subwords[:2])
    params = train(rows, counts, classes, vocabulary, rounds, rate, width)
    values = stored(value_words(counts, memory, classes, params, vocabulary, width), "word-values")
    top = values.where("c > 0").orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    known = dict(zip(top["word"].to_pylist(), zip(*(top[name].to_pylist() for name in ("c", "value", "head")), strict=True), strict=True))
    ends = taught.where("octet_length(word) = 0").first()
    if ends:
        known[b""] = (ends["c"], 0.0, END)
    scored = stored(score_rows(rows, known, classes, params, vocabulary, width), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times")
    )
    counted = F.col("c") > 0
    met = (
        rare.join(values, "word")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_base"),
            F.sum(F.when(counted, F.col("times"))).alias("rare_known"),
            F.sum(F.col("times") * F.col("value") / float(np.log(10))).alias("rare_inside"),
        )
    )
    joined = scored.drop("rare", "times").join(met, "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("base")
            + F.coalesce("rare_base", F.lit(0.0))
            - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
        ).alias("base_score"),
        (F.col("score") + F.coalesce("rare_inside", F.lit(0.0))).alias("score"),
    )
