"""Languages of documents and of their parts, by a linear-chain CRF over words.

A word's features are its affixes, its character n-grams and the word itself
(the lexicon); their learned weights, with learned transitions from one word's
language to the next, give every word a distribution over the languages by
forward-backward. Sentences take the language that their words favour, runs of
sentences make segments, and most of the words decide for the document.

The model is fitted on a bounded sample of labelled documents, whose wrong or
mixed labels a second pass puts right. Its bounds are the parameters
``per_language``, ``longest``, ``per_document`` and ``longest_sentence``.
Everything else is done for all documents and whole texts. A fitted model can
be saved and given to later runs.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlattice.llm.text import plain
from rowlattice.session import ship_package, spread

#: Labelled documents of each language that the model is fitted on.
PER_LANGUAGE = 250
#: Characters of a document of the sample at most, its sentences that are drawn, and words read of one.
LONGEST, PER_DOCUMENT, LONGEST_SENTENCE = 100_000, 10, 60
#: Labelled documents from which on a code without a known spelling is a language.
LEAST_DOCUMENTS = 20
BUCKETS = 1 << 17
#: Words decoded in one piece, and what pieces of a longer text share.
PIECE, SHARED = 1024, 32
#: Word types kept by a worker before it starts afresh.
CACHE = 500_000
#: Below this mean chance a sentence has no certain language.
CERTAIN = 0.5
#: Words that make a sentence full.
FULL = 4
#: Words from which on a text without any full sentence has a language.
BARE = 8

#: Spellings of the eight languages' labels.
SPELLINGS = {
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castilian"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
    "ru": ["ru", "rus", "russian", "русский"],
}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+(?![\s\"'»”)\]]|$)[^.!?]*)*(?:[.!?]+[\"'»”)\]]*(?=\s|$)|$)")
_REDIRECT = re.compile(r"\s*#\s*\w+\s*:?\s*\[\[", re.I)


#: Codes that name no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "xx", "xxx", "unk", "nan", "nil", "na")


def _first_part(label: Column) -> Column:
    return F.lower(F.trim(F.split(F.trim(label), "[-_]")[0]))


def label_code(label: Column, spellings: Mapping[str, Sequence[str]] = SPELLINGS, others: Sequence[str] = ()) -> Column:
    """The code of a label in any known spelling, or one of ``others``, else null."""
    first = _first_part(label)
    code = F.when(first.isin(*others), first) if others else F.lit(None).cast("string")
    for name, known in spellings.items():
        code = F.when(first.isin(list(known)), F.lit(name)).otherwise(code)
    return code


def other_languages(documents: DataFrame, lang: str, spellings: Mapping[str, Sequence[str]] = SPELLINGS, least: int = LEAST_DOCUMENTS) -> list[str]:
    """Codes of two or three letters, not spelled above, that label ``least`` documents.

    There are no more than such codes, so the list is small.
    """
    known = {x for names in spellings.values() for x in names} | set(NO_LANGUAGE)
    first = documents.select(_first_part(F.col(lang)).alias("c")).where(F.col("c").rlike("^[a-z]{2,3}$") & ~F.col("c").isin(*known))
    return sorted(r["c"] for r in first.groupBy("c").count().where(F.col("count") >= least).collect())


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % (BUCKETS - 1) + 1


def features(word: str) -> list[int]:
    """Numbers of a word's features; 0 is none."""
    if word.isdigit():
        return [_bucket("#")]
    low = word.casefold()
    out = ["w " + low]
    for n in (1, 2, 3):
        if len(low) >= n:
            out += [f"p {low[:n]}", f"s {low[-n:]}"]
    if len(low) >= 5:
        out.append("s " + low[-4:])
    whole = f"^{low}$"
    grams = [f"g {whole[i : i + n]}" for n in (2, 3) for i in range(len(whole) - n + 1)]
    return [_bucket(f) for f in out + grams]


def sentences(text: str | None) -> list[tuple[int, int, list[str], bool]]:
    """(from, to, words, full) of each sentence of the prose; places are those
    in the text without markup. A heading, caption or name is not full."""
    if not text or _REDIRECT.match(text):
        return []
    prose = plain(text, tables=False)
    out = []
    at = 0
    for gap in [*_PARAGRAPH.finditer(prose), None]:
        end = gap.start() if gap else len(prose)
        for found in _SENTENCE.finditer(prose, at, end):
            piece = found.group()
            tokens = _WORD.findall(piece)
            if tokens:
                letters = len(tokens) - sum(map(str.isdigit, tokens))
                full = letters >= FULL and piece.rstrip("\"'»”)] \n\t")[-1:] in (".", "!", "?") and sum(map(len, tokens)) <= 14 * len(tokens)
                out.append((found.start(), found.end(), tokens, full))
        if gap:
            at = gap.end()
    return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, count_moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Chances of each label at each place: places x sequences x labels.

    Sequences come in order of falling length; ``emissions`` and ``moves`` are
    not logarithms. With ``count_moves``, the expected number of each move.
    """
    places, n, k = emissions.shape
    live = np.array([np.searchsorted(-lengths, -t, "left") for t in range(places)])
    alpha = np.zeros_like(emissions)
    alpha[0] = emissions[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, places):
        m = live[t]
        step = alpha[t - 1, :m] @ moves
        step *= emissions[t, :m]
        step /= step.sum(1, keepdims=True)
        alpha[t, :m] = step
    beta = np.ones_like(emissions)
    expected = np.zeros((k, k)) if count_moves else None
    back = moves.T.copy()
    for t in range(places - 1, 0, -1):
        m = live[t]
        ahead = beta[t, :m] * emissions[t, :m]
        step = ahead @ back
        if expected is not None:
            before = alpha[t - 1, :m]
            norm = (before * step).sum(1, keepdims=True)
            expected += ((before / norm).T @ ahead) * moves
        step /= step.sum(1, keepdims=True)
        beta[t - 1, :m] = step
    alpha *= beta
    alpha /= np.maximum(alpha.sum(2, keepdims=True), 1e-30)
    return alpha, expected


@dataclass
class Model:
    """Weights of features and transitions, and the words met so far."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"labels": self.labels, "weights": self.weights, "moves": self.moves, "known": {}, "scores": None}

    def number(self, words: list[str]) -> np.ndarray:
        """Rows of the words in ``scores``; new words are scored now."""
        known = self.known
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        if fresh:
            if len(known) > CACHE:
                known.clear()
                fresh = list(dict.fromkeys(words))
            start = len(known)
            known.update(zip(fresh, range(start, start + len(fresh))))
            logs = feature_sums(self.weights, *feature_table(fresh))
            logs -= logs.max(1, keepdims=True)
            rows = np.exp(logs).astype(np.float32) + 1e-6
            if self.scores is None or start == 0:
                self.scores = np.empty((max(1024, 2 * len(fresh)), len(self.labels)), np.float32)
            if start + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores[:start], np.empty((start + 2 * len(fresh), len(self.labels)), np.float32)])
            self.scores[start : start + len(fresh)] = rows
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def chances(self, texts: list[list[str]]) -> np.ndarray:
        """The chances of each language at each word of all texts, end to end."""
        every = [w for t in texts for w in t]
        out = np.zeros((len(every), len(self.labels)), np.float32)
        if not every:
            return out
        numbers = self.number(every)
        ends = np.cumsum([len(t) for t in texts])
        parts = []  # (from, to, first to keep, end of what is kept)
        for end, t in zip(ends, texts):
            begin = end - len(t)
            for at in range(0, len(t), PIECE):
                low, high = max(0, at - SHARED), min(len(t), at + PIECE + SHARED)
                parts.append((begin + low, begin + high, at - low, min(len(t), at + PIECE) - low))
        parts.sort(key=lambda p: p[0] - p[1])
        moves = np.exp(self.moves).astype(np.float32)
        for first in range(0, len(parts), 512):
            some = parts[first : first + 512]
            lengths = np.array([p[1] - p[0] for p in some])
            rows = np.zeros((lengths[0], len(some)), np.int64)
            for column, (begin, end, _, _) in enumerate(some):
                rows[: end - begin, column] = numbers[begin:end]
            gamma, _ = forward_backward(self.scores[rows], lengths, moves)
            for column, (begin, _, skip, stop) in enumerate(some):
                out[begin + skip : begin + stop] = gamma[skip:stop, column]
        return out


def feature_table(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words one after another, and where each word's begin.

    Every word has one at least; the last place is the end of the last word.
    """
    found = [features(word) for word in words]
    flat = np.fromiter((x for numbers in found for x in numbers), np.int32)
    return flat, np.append(0, np.cumsum([len(numbers) for numbers in found], dtype=np.int64))


def rows_of(flat: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table of some of the words."""
    lengths = np.diff(offsets)[words]
    begins = np.append(0, np.cumsum(lengths))
    return flat[np.repeat(offsets[words] - begins[:-1], lengths) + np.arange(begins[-1])], begins


def feature_sums(weights: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features."""
    if len(offsets) < 2:
        return np.zeros((0, weights.shape[1]), weights.dtype)
    return np.add.reduceat(weights[flat], offsets[:-1], axis=0)


def cleaned(coded: list[np.ndarray], given: np.ndarray, labels: int, passes: int = 3) -> np.ndarray:
    """Each sentence's label by the words' shares among all labels.

    As long as most sentences of a language have its label, each of its words
    is most frequent there, however many single labels are wrong.
    """
    size = int(max(c.max() for c in coded)) + 1
    words, owner = np.concatenate(coded), np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    common = np.bincount(words, minlength=size) >= 3
    truth = given
    for _ in range(passes):
        counts = np.bincount(words * labels + truth[owner], minlength=size * labels).reshape(size, labels)
        share = np.log((counts + 0.3) / (counts.sum(0) + 0.3 * size)) * common[:, None]
        score = _sums(owner, share[words], len(coded))
        told = np.bincount(owner, common[words], len(coded)) > 0
        truth = np.where(told, score.argmax(1), given)
    return truth


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``index``."""
    return np.stack([np.bincount(index, column, size) for column in values.T], axis=1)


def fit(samples: list[tuple[str, str]], seed: int = 7, rounds: int = 6, per_document: int = PER_DOCUMENT, longest_sentence: int = LONGEST_SENTENCE) -> Model | None:
    """Fit a model on (text, code) pairs, some of them wrong or mixed.

    ``per_document`` sentences of a text are drawn, and ``longest_sentence``
    words of each are read: bounds of the fit alone.

    Training sequences join sentences of one document, or of several of
    different languages so that changes of language are seen. Wrong labels are
    put right before (:func:`cleaned`); the weights are means over the steps
    of the later rounds.
    """
    rng = np.random.default_rng(seed)
    labels = sorted({code for _, code in samples})
    if len(labels) < 2:
        return None
    votes: dict[tuple, np.ndarray] = {}
    for text, code in samples:
        full = [tuple(x[2][:longest_sentence]) for x in sentences(text) if x[3]]
        for i in rng.permutation(len(full))[:per_document]:
            votes.setdefault(full[i], np.zeros(len(labels)))[labels.index(code)] += 1
    # a sentence that many revisions share counts once
    pool = [(list(words), int(v.argmax())) for words, v in votes.items()]
    if not pool:
        return None
    rounds = max(rounds, min(100, 20_000 // len(pool)))  # as many steps for a small sample
    k = len(labels)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in pool for w in s[0]))}
    # only features of the sample's words are fitted; place 0 is no feature
    flat, offsets = feature_table(list(vocabulary))
    used, places = np.unique(np.append(0, flat), return_inverse=True)
    flat = places[1:]
    coded = [np.array([vocabulary[w] for w in s[0]]) for s in pool]
    truth = cleaned(coded, np.array([s[1] for s in pool]), k)
    weights, moves = np.zeros((len(used), k)), np.eye(k) * 2.0
    state = [np.zeros_like(weights), np.zeros_like(moves)]
    mean_weights, mean_moves, steps = np.zeros_like(weights), np.zeros_like(moves), 0
    for turn in range(rounds):
        order = rng.permutation(len(pool))
        sequences, at = [], 0
        while at < len(order):
            n = int(rng.integers(1, 4))
            sequences.append(order[at : at + n])
            at += n
        # half of the sequences hold one language only, as most texts do
        for i in range(0, len(sequences), 2):
            head = sequences[i][0]
            same = np.flatnonzero(truth == truth[head])
            sequences[i] = np.append(head, rng.choice(same, len(sequences[i]) - 1))
        for first in range(0, len(sequences), 128):
            batch = sorted(sequences[first : first + 128], key=lambda s: -sum(len(coded[i]) for i in s))
            lengths = np.array([sum(len(coded[i]) for i in s) for s in batch])
            words = np.zeros((lengths[0], len(batch)), np.int64)
            gold = np.zeros((lengths[0], len(batch)), np.int64)
            for column, s in enumerate(batch):
                words[: lengths[column], column] = np.concatenate([coded[i] for i in s])
                gold[: lengths[column], column] = np.concatenate([np.full(len(coded[i]), truth[i]) for i in s])
            there = np.arange(lengths[0])[:, None] < lengths[None, :]
            types, back = np.unique(words, return_inverse=True)
            back = back.reshape(words.shape)
            some, begins = rows_of(flat, offsets, types)
            logs = feature_sums(weights, some, begins)
            logs -= logs.max(1, keepdims=True)
            scores = np.exp(logs) + 1e-9
            gamma, expected = forward_backward(scores[back], lengths, np.exp(moves), True)
            error = -gamma
            np.put_along_axis(error, gold[..., None], np.take_along_axis(error, gold[..., None], 2) + 1, 2)
            error *= there[..., None]
            by_type = _sums(back.ravel(), error.reshape(-1, k), len(types))
            grad = _sums(some, np.repeat(by_type, np.diff(begins), 0), len(weights))
            grad[0] = 0
            seen = np.zeros((k, k))
            both = there[1:]
            np.add.at(seen, (gold[:-1][both], gold[1:][both]), 1)
            # Adagrad; the constant keeps what is rare from learning wrong labels by heart
            for value, slope, square in ((weights, grad, state[0]), (moves, seen - expected, state[1])):
                square += slope * slope
                value += 0.3 * slope / np.sqrt(square + 10.0)
            weights[0] = 0
            if turn >= rounds // 2:
                mean_weights += weights
                mean_moves += moves
                steps += 1
    fitted = np.zeros((BUCKETS, k), np.float32)
    fitted[used] = mean_weights / steps
    return Model(labels, fitted, mean_moves / steps)


def _letters(tokens: Sequence[str]) -> int:
    return sum(not w.isdigit() for w in tokens)


def read(texts: list[str | None], model: Model) -> list[tuple[str | None, float, list[tuple]]]:
    """(language, confidence, segments) of each text."""
    parsed = [sentences(t) for t in texts]
    gamma = model.chances([[w for s in p for w in s[2]] for p in parsed])
    lengths = np.array([len(s[2]) for p in parsed for s in p], np.int64)
    sums = np.add.reduceat(gamma, np.cumsum(lengths) - lengths) if len(lengths) else gamma
    bests = sums.argmax(1)
    means = (sums[np.arange(len(bests)), bests] / np.maximum(lengths, 1)).tolist()
    out, at = [], 0
    for found in parsed:
        votes = np.zeros(len(model.labels))
        segments: list[list] = []
        # without a full sentence, lines of enough words speak for the text
        bare = not any(x[3] for x in found) and sum(map(_letters, (x[2] for x in found))) >= BARE
        for begin, end, tokens, full in found:
            best, mean, row, at = int(bests[at]), means[at], at, at + 1
            if not full and not (bare and mean >= CERTAIN and _letters(tokens) >= FULL):
                continue
            votes += sums[row]
            code = model.labels[best] if mean >= CERTAIN else None
            if segments and segments[-1][2] == code:
                last = segments[-1]
                last[1], last[3], last[4], last[5] = end, last[3] + full, last[4] + len(tokens), last[5] + mean * len(tokens)
            else:
                segments.append([begin, end, code, int(full), len(tokens), mean * len(tokens)])
        whole = votes.sum()
        best = int(votes.argmax())
        out.append((model.labels[best] if whole else None, float(votes[best] / whole) if whole else 0.0, [(a, b, c, n, w, s / w) for a, b, c, n, w, s in segments]))
    return out


_SEGMENT = pa.list_(pa.struct([("begins", pa.int64()), ("ends", pa.int64()), ("lang", pa.string()), ("sentences", pa.int32()), ("words", pa.int32()), ("confidence", pa.float64())]))
_READ = "found_lang string, confidence double, segments array<struct<begins:bigint,ends:bigint,lang:string,sentences:int,words:int,confidence:double>>"


def read_batches(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """Replace the last column, the text, by what is read in it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            texts = part.columns[-1].to_pylist()
            results = read(texts, model) if model else [(None, 0.0, [])] * len(texts)
            segments = [[dict(zip(("begins", "ends", "lang", "sentences", "words", "confidence"), s)) for s in r[2]] for r in results]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64()), pa.array(segments, _SEGMENT)],
                names=[*part.schema.names[:-1], "found_lang", "confidence", "segments"],
            )


def fit_on(documents: DataFrame, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE, longest: int = LONGEST, spellings: Mapping[str, Sequence[str]] = SPELLINGS, least_documents: int = LEAST_DOCUMENTS, **bounds: int) -> Model | None:
    """Fit on ``per_language`` labelled documents of each language, by hash;
    those of more than ``longest`` characters are left out of the sample."""
    others = other_languages(documents, lang, spellings, least_documents)
    labelled = documents.select(F.col(doc_id).alias("d"), label_code(F.col(lang), spellings, others).alias("c")).where(F.col("c").isNotNull() & F.col("d").isNotNull())
    by_code = Window.partitionBy("c").orderBy(F.xxhash64(F.lit(17), "d"), "d")
    chosen = labelled.withColumn("__place", F.row_number().over(by_code)).where(F.col("__place") <= per_language)
    texts = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    rows = texts.where(F.length("t") <= longest).join(F.broadcast(chosen), "d").select("d", "c", "t").collect()
    return fit([(r["t"], r["c"]) for r in sorted(rows, key=lambda r: (str(r["d"]), r["t"] or ""))], **bounds)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a model as a table of one row, for :func:`load_model`."""
    held = io.BytesIO()
    np.savez_compressed(held, weights=model.weights, moves=model.moves)
    spark.createDataFrame([(json.dumps(model.labels), bytearray(held.getvalue()))], "labels string, arrays binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(path).first()
    arrays = np.load(io.BytesIO(bytes(row["arrays"])))
    return Model(json.loads(row["labels"]), arrays["weights"], arrays["moves"])


def label_languages(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, spellings: Mapping[str, Sequence[str]] = SPELLINGS, **fitting: int) -> DataFrame:
    """The language of each document and of each of its segments.

    Returns ``doc_id``, ``given_lang`` (the code of the label, null if missing
    or not a language), ``found_lang`` and ``confidence`` of the document, and
    ``segments``: runs of full sentences in one language, with their place in
    the text without markup, their numbers of sentences and words, and a
    confidence. A sentence of no certain language has a segment without one.
    The languages are those of the labels: the codes in ``spellings``, and
    other codes that label enough documents. ``fitting`` are the bounds of
    :func:`fit_on` and :func:`fit`; a given ``model`` is used as it is.

    Defined results: null, empty and blanked texts, redirects and gibberish
    have no language, confidence 0 and no segment; a text of ``BARE`` words or
    more without a full sentence has the language of its lines, in segments of
    0 sentences; a very long text is decoded in overlapping pieces, all of it;
    repeated rows are each labelled; with fewer than two languages among the
    labels there is no model and no language is given; other columns are
    ignored. The same documents always give the same model.
    """
    ship_package(documents.sparkSession)
    if model is None:
        model = fit_on(documents, doc_id, text, lang, spellings=spellings, **fitting)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    others = [c for c in model.labels if c not in spellings] if model else []
    chosen = documents.select(F.col(doc_id).alias("d"), label_code(F.col(lang), spellings, others).alias("given_lang"), F.col(text).alias("t"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = spread(chosen).mapInArrow(lambda it: read_batches(it, shared.value), f"d {kinds[doc_id]}, given_lang string, {_READ}")
    return out.withColumnRenamed("d", doc_id)


def corrections(labelled: DataFrame, doc_id: str = "doc_id", least_sentences: int = 2) -> DataFrame:
    """Documents with a missing or wrong label or mixed prose, and their languages.

    One row ``doc_id, lang`` for each language of at least
    ``least_sentences`` full sentences in a row.
    """
    spoken = F.array_distinct(F.transform(F.filter("segments", lambda s: s["lang"].isNotNull() & (s["sentences"] >= least_sentences)), lambda s: s["lang"]))
    wrong = F.col("given_lang").isNull() | (F.col("given_lang") != F.col("found_lang")) | (F.size("spoken") > 1)
    return labelled.withColumn("spoken", spoken).where(wrong).select(F.col(doc_id), F.explode("spoken").alias("lang"))
