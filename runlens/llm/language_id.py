"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has a state, its language. A state's score at a word is a sum of learned weights: of the
word's affixes, of its letter n-grams, of the word itself, and of a lexicon, the shares in which
the languages use it. Learned transitions tie neighbours together, so a text may switch languages
and a word that several languages share goes with those around it. Forward-backward gives the
chance of each language at each word; their means over a text are the shares of its languages.

Features are hashed into tables of fixed size, so the model does not grow with the corpus. The
lexicon counts every word of all labelled rows, by partial sums. Weights are fitted to a sample of
`SAMPLE` rows a language on average, drawn by a hash of the whole row; each gives one piece of
`PIECE` words from a place that the hash picks, and pieces of different languages are joined into
code-switched text, from which the transitions are learned.

A null text and one without a letter have language `und`, score 0 and no spans; so has every text
when no row is labelled. Rows with a null language or text are not learned from, of equal rows one is
drawn. A text of any length is labelled whole, in chunks that are multiplied together as matrices,
so that memory is bounded by the text and time by its length. Empty tables stay empty, repeated rows
are labelled alike, equal chances go to the first language by name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import packed, unpacked, utf8
from runlens.session import stage

UNKNOWN = "und"
#: Rows of a language whose pieces the weights are fitted to, on average.
SAMPLE = 600
#: Words of a piece; joined pieces are of a third of it, half of it, or whole.
PIECE = 24
#: Joined pieces of a training text.
JOINED = 3
#: Slots of the hashed weights and of the lexicon.
SLOT_BITS = 17
LEXICON_BITS = 16
#: Steps of the fit, their size, and the pull of the weights to zero.
STEPS = 40
RATE = 0.15
DECAY = 1e-4
#: Words that a lexicon slot is credited with in every language.
PRIOR = 0.5
#: Words between two looks at a chunk's state; words labelled at once; words that a worker keeps.
CHUNK = 64
AT_ONCE = 1 << 17
KNOWN = 1 << 18
#: Longer words are known by so many of their letters from either end for their n-grams.
ENDS = 48

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Marks the ends of a word among its letters.
_START, _END = "\x02", "\x03"
_KINDS = {"bigram": 11, "trigram": 13, "prefix": 17, "suffix": 19, "word": 23}


def words_of(text: str) -> list[str]:
    """Words in lower case: a letter with the letters and marks that follow it."""
    return _WORD.findall(text.lower())


def _mixed(values: np.ndarray, kind: str, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values + np.uint64(_KINDS[kind])) * _MIX
        return ((values ^ (values >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(
            np.int64)


@dataclass(frozen=True)
class Features:
    """Slots of the features of some words: feature i belongs to word `owner[i]`."""

    owner: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    lexicon: np.ndarray


def features_of(words: list[str]) -> Features:
    """Affixes of one to three letters, n-grams of two and three, and the words themselves."""
    short = [w if len(w) <= 2 * ENDS else w[:ENDS] + w[-ENDS:] for w in words]
    joined = "".join([f"{_START}{w}{_END}" for w in short])
    letters = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in short])
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - np.repeat(start, size)
    base = np.uint64(1_000_003)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=1)), base))
        whole = np.add.reduceat(letters * power[place], start) if len(words) else letters[:0]
        two = letters[:-1] * base + letters[1:]
        three = two[:-1] * base + letters[2:]
    slots, owners, shares = [], [], []

    def add(kind: str, values: np.ndarray, of: np.ndarray, share: np.ndarray | float) -> None:
        slots.append(_mixed(values, kind, SLOT_BITS))
        owners.append(of)
        shares.append(np.broadcast_to(share, of.shape))

    for kind, grams, n in (("bigram", two, 2), ("trigram", three, 3)):
        inside = np.flatnonzero(owner[n - 1:] == owner[:len(owner) - n + 1])
        of = owner[inside]
        add(kind, grams[inside], of, 1 / np.sqrt(np.maximum(1, size[of] - n + 1)))
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n + 2)
        head = np.zeros(len(long), np.uint64)
        tail = np.zeros(len(long), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(n):
                head = head * base + letters[start[long] + 1 + at]
                tail = tail * base + letters[end[long] - 1 - n + at]
        add("prefix", head + np.uint64(n << 40), long, 0.5)
        add("suffix", tail + np.uint64(n << 40), long, 0.5)
    add("word", whole, np.arange(len(words)), 1.0)
    return Features(np.concatenate(owners), np.concatenate(slots), np.concatenate(shares),
                    _mixed(whole, "word", LEXICON_BITS))


# --- forward-backward ----------------------------------------------------------------------------

def _normal(rows: np.ndarray, axes: int | tuple[int, ...] = -1) -> np.ndarray:
    return rows / np.maximum(rows.sum(axis=axes, keepdims=True), 1e-300)


def chances(emission: np.ndarray, sizes: np.ndarray, transition: np.ndarray,
            chunk: int = CHUNK) -> np.ndarray:
    """Chance of each state at each word of texts that follow one another.

    `emission` and `transition` are positive factors, (words, states) and (states, states); before
    the first word every state is as likely. Texts are cut into chunks. The product of a chunk's
    matrices tells how its ends depend on each other; with it the states at all ends are found,
    and then all chunks are walked at once in both directions.
    """
    states = emission.shape[1]
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return np.zeros((0, states))
    pieces = -(-sizes // chunk)
    m = int(pieces.sum())
    first = np.cumsum(pieces) - pieces
    number = np.arange(m) - np.repeat(first, pieces)
    place = np.repeat(np.cumsum(sizes) - sizes, pieces)[:, None] + number[:, None] * chunk + (
        np.arange(chunk))
    used = place < np.repeat(np.cumsum(sizes), pieces)[:, None]
    factor = np.where(used[:, :, None], emission[np.where(used, place, 0)], 1.0).swapaxes(0, 1)
    used = used.T[:, :, None]

    entry = np.full((m, states), 1.0 / states)
    leave = np.ones((m, states))
    longer = np.flatnonzero(np.repeat(pieces > 1, pieces))
    if len(longer):
        product = np.broadcast_to(np.eye(states), (len(longer), states, states))
        for step in range(chunk):
            new = _normal(product @ transition * factor[step, longer, None, :], (1, 2))
            product = np.where(used[step, longer, :, None], new, product)
        whole = np.zeros((m, states, states))
        whole[longer] = product
        for at in range(1, int(pieces.max())):
            here = first[pieces > at] + at
            entry[here] = _normal(np.einsum("mi,mij->mj", entry[here - 1], whole[here - 1]))
        for at in range(int(pieces.max()) - 1, 0, -1):
            here = first[pieces > at] + at
            leave[here - 1] = _normal(np.einsum("mij,mj->mi", whole[here], leave[here]))

    forward = np.empty((chunk, m, states))
    now = entry
    for step in range(chunk):
        now = np.where(used[step], _normal(now @ transition * factor[step]), now)
        forward[step] = now
    now = leave
    for step in range(chunk - 1, -1, -1):
        forward[step] *= now
        now = np.where(used[step], _normal((factor[step] * now) @ transition.T), now)
    both = _normal(forward).swapaxes(0, 1)
    return both[used[:, :, 0].T]


def _factors(score: np.ndarray) -> np.ndarray:
    return np.exp(score - score.max(axis=-1, keepdims=True, initial=-np.inf))


# --- model ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Languages by name, hashed weights, lexicon of log shares and its weight, transitions."""

    languages: tuple[str, ...]
    weights: np.ndarray
    lexicon: np.ndarray
    trust: float
    bias: np.ndarray
    transition: np.ndarray

    def emission(self, words: list[str]) -> np.ndarray:
        """Factor of each language at each word."""
        found = features_of(words)
        score = _summed(self.weights[found.slot] * found.share[:, None], found.owner, len(words))
        return _factors(score + self.trust * self.lexicon[found.lexicon] + self.bias)


def _summed(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def log_shares(counts: np.ndarray, per_language: np.ndarray) -> np.ndarray:
    """Log of each language's share of a word, for counts (words, languages).

    Counts are taken relative to the language's size, so that a common language gains nothing.
    """
    rate = counts * (per_language.mean() / np.maximum(per_language, 1)) + PRIOR
    return np.log(rate / rate.sum(axis=1, keepdims=True))


def _training_texts(pieces: list[tuple[int, list[str]]], seed: int) -> tuple[list[str], np.ndarray,
                                                                             np.ndarray]:
    """Words, their languages, and the sizes of code-switched texts of joined pieces."""
    random = np.random.default_rng(seed)
    words, labels, sizes = [], [], []
    for at in range(0, len(pieces), JOINED):
        size = 0
        for label, piece in pieces[at:at + JOINED]:
            kept = piece[:max(1, len(piece) // int(random.integers(1, 4)))]
            words += kept
            labels += [label] * len(kept)
            size += len(kept)
        sizes.append(size)
    return words, np.array(labels, int), np.array(sizes, int)


def fit_weights(languages: tuple[str, ...], counts: np.ndarray,
                pieces: list[tuple[int, list[str]]], steps: int = STEPS, seed: int = 5) -> Model:
    """Conditional likelihood of code-switched texts, climbed by Adam over all of them at once.

    The lexicon that training sees lacks the word at hand, as a word of a new text may be new.
    """
    n = len(languages)
    lexicon = log_shares(counts, counts.sum(axis=0)).astype(np.float32)
    if not pieces:
        return Model(languages, np.zeros((1 << SLOT_BITS, n), np.float32), lexicon, 1.0,
                     np.zeros(n), np.exp(np.eye(n)))
    order = np.random.default_rng(seed).permutation(len(pieces))
    words, labels, sizes = _training_texts([pieces[i] for i in order], seed)
    distinct = list(dict.fromkeys(words))
    number = {word: at for at, word in enumerate(distinct)}
    of = np.fromiter((number[word] for word in words), int, len(words))
    found = features_of(distinct)
    per_language = counts.sum(axis=0)
    truth = np.eye(n)[labels]
    seen = log_shares(np.maximum(counts[found.lexicon][of] - truth, 0), per_language)
    firsts = np.zeros(len(words), bool)
    firsts[np.cumsum(sizes) - sizes] = True
    switches = np.zeros((n, n))
    np.add.at(switches, (labels[:-1][~firsts[1:]], labels[1:][~firsts[1:]]), 1.0)

    slots, compact = np.unique(found.slot, return_inverse=True)
    at = {"weights": np.zeros((len(slots), n)), "trust": np.ones(1), "bias": np.zeros(n),
          "transition": np.eye(n)}
    moment = {name: np.zeros_like(x) for name, x in at.items()}
    spread = {name: np.zeros_like(x) for name, x in at.items()}
    for step in range(1, steps + 1):
        own = _summed(at["weights"][compact] * found.share[:, None], found.owner, len(distinct))
        factor = _factors(own[of] + at["trust"] * seen + at["bias"])
        matrix = np.exp(at["transition"])
        chance = chances(factor, sizes, matrix)
        rest = truth - chance
        by_word = _summed(rest, of, len(distinct))
        slope = {
            "weights": _summed(by_word[found.owner] * found.share[:, None], compact, len(slots)),
            "trust": np.array([(rest * seen).sum()]), "bias": rest.sum(axis=0),
            "transition": switches - _expected_switches(factor, chance, sizes, matrix, firsts),
        }
        for name, x in at.items():
            g = slope[name] / len(words) - DECAY * x
            moment[name] = 0.9 * moment[name] + 0.1 * g
            spread[name] = 0.99 * spread[name] + 0.01 * g * g
            x += RATE * (moment[name] / (1 - 0.9 ** step)) / (
                np.sqrt(spread[name] / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros((1 << SLOT_BITS, n), np.float32)
    weights[slots] = at["weights"]
    return Model(languages, weights, lexicon, float(at["trust"][0]),
                 at["bias"], np.exp(at["transition"]))


def _expected_switches(factor, chance, sizes, matrix, firsts) -> np.ndarray:
    """Expected number of each transition between neighbours.

    With p the chance at a word and f its factor, the message from the words after it is
    p / forward; training texts are short, so forward is walked over all of them at once.
    """
    m, longest = len(sizes), int(sizes.max(initial=0))
    first = np.cumsum(sizes) - sizes
    total = np.zeros_like(matrix)
    now = np.full((m, matrix.shape[0]), 1.0 / matrix.shape[0])
    for step in range(longest):
        live = np.flatnonzero(sizes > step)
        word = first[live] + step
        ahead = now[live] @ matrix * factor[word]
        if step:
            # p(i, j) is forward(i) * matrix(i, j) * factor(j) * backward(j).
            backward = chance[word] / np.maximum(ahead, 1e-300)
            total += now[live].T @ (factor[word] * backward) * matrix
        now[live] = _normal(ahead)
    return total


# --- Spark ---------------------------------------------------------------------------------------

def is_held_out(doc_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lexicon_counts(rows: DataFrame) -> DataFrame:
    """Counts of words by language and lexicon slot: (lang, slot, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            counters: dict[str, Counter] = {}
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data")):
                counters.setdefault(lang, Counter()).update(
                    words_of(data.as_py().decode("utf-8", "replace")))
            for lang, counter in counters.items():
                table = tables.setdefault(lang, np.zeros(1 << LEXICON_BITS, np.int64))
                if counter:
                    np.add.at(table, features_of_words(list(counter)), list(counter.values()))
        for lang, table in tables.items():
            slots = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots.astype(np.int32)),
                 pa.array(table[slots])], ["lang", "slot", "n"])

    return rows.select("lang", "data").mapInArrow(count, "lang string, slot int, n long").groupBy(
        "lang", "slot").agg(F.sum("n").alias("n"))


def features_of_words(words: list[str]) -> np.ndarray:
    """Lexicon slots."""
    return features_of(words).lexicon


def _pieces(rows: DataFrame) -> DataFrame:
    """A piece of `PIECE` words of each row, from a place that its hash picks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for draw, data in zip(batch.column("draw").to_pylist(), batch.column("data")):
                words = words_of(data.as_py().decode("utf-8", "replace"))
                at = (draw >> 20) % max(1, len(words) - PIECE + 1)
                pieces.append(" ".join(words[at:at + PIECE]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("draw"), pa.array(pieces, pa.string())],
                ["lang", "draw", "piece"])

    return rows.mapInArrow(cut, "lang string, draw long, piece string").filter("piece != ''")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE) -> Model | None:
    """Model of the rows of `docs` that may be learned from; None without any.

    To the driver come the lexicon, of fixed size per language, and the sampled pieces.
    """
    lang = F.col(f"`{lang_col}`")
    rows = docs.filter(~is_held_out(F.col(f"`{id_col}`")) & lang.isNotNull()
                       & F.col(f"`{text_col}`").isNotNull()).select(
        lang.cast("string").alias("lang"), utf8(F.col(f"`{text_col}`")).alias("data"),
        F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("draw"))
    counted = stage(_lexicon_counts(rows), "lexicon")
    per_language = {row["lang"]: row["n"] for row in rows.groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    table = counted.toArrow()
    languages = tuple(sorted(set(table.column("lang").to_pylist())))
    if not languages:
        return None
    number = {name: at for at, name in enumerate(languages)}
    counts = np.zeros((1 << LEXICON_BITS, len(languages)))
    counts[table.column("slot").to_numpy(),
           np.array([number[name] for name in table.column("lang").to_pylist()])] = (
        table.column("n").to_numpy())
    least = F.lit(0.0)
    for name in languages:
        least = F.when(F.col("lang") == name, min(1.0, sample / per_language[name])).otherwise(
            least)
    drawn = rows.filter(F.pmod("draw", F.lit(1 << 20)) < least * (1 << 20))
    found = _pieces(drawn).dropDuplicates(["lang", "draw"]).collect()
    pieces = [(number[row["lang"]], row["piece"].split(" "))
              for row in sorted(found, key=lambda row: (row["draw"], row["lang"]))]
    return fit_weights(languages, counts, pieces)


class Labeller:
    """Labels texts with one model; keeps the factors of words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.number: dict[str, int] = {}
        self.factor = np.empty((0, len(model.languages)))

    def factors(self, words: list[str]) -> np.ndarray:
        if len(self.number) > KNOWN:
            self.number, self.factor = {}, self.factor[:0]
        new = [word for word in dict.fromkeys(words) if word not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.factor = np.concatenate([self.factor, self.model.emission(new)])
        return self.factor[np.fromiter(map(self.number.__getitem__, words), int, len(words))]

    def label(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """Chances (words, languages) of each text."""
        words = [word for text in texts for word in text]
        sizes = np.array([len(text) for text in texts], int)
        found = chances(self.factors(words), sizes, self.model.transition)
        return iter(np.split(found, np.cumsum(sizes)[:-1]))


def spans_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and label of each run of equal labels."""
    first = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    return first, np.diff(np.append(first, len(labels))), labels[first]


_RESULT = ("struct<lang_pred:string,score:double,n_words:bigint,"
           "spans:array<struct<first:bigint,words:bigint,lang:string>>>")


def labelled(text: Column | str, model: Model | None) -> Column:
    """lang_pred, score, n_words and spans of one language each, by word number from 0."""

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            yield _labelled(batch, labeller)

    label.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(label, _RESULT)(utf8(text))


def _labelled(batch: pa.Array, labeller: Labeller | None) -> pa.Array:
    names = np.array(labeller.model.languages if labeller else [], object)
    preds, score, n_words, spans, sizes = [], [], [], [], [0]

    def flush(texts: list[list[str]]) -> None:
        for text, chance in zip(texts, labeller.label(texts)):
            if not text:
                preds.append(UNKNOWN)
                score.append(0.0)
            else:
                share = chance.mean(axis=0)
                preds.append(names[int(share.argmax())])
                score.append(min(1.0, float(share.max())))
                spans.append(spans_of(chance.argmax(axis=1)))
            n_words.append(len(text))
            sizes.append(sizes[-1] + (len(spans[-1][0]) if text else 0))

    held, count = [], 0
    for data in batch:
        words = words_of(data.as_py().decode("utf-8", "replace"))
        if labeller is None:
            preds.append(UNKNOWN)
            score.append(0.0)
            n_words.append(len(words))
            sizes.append(0)
            continue
        held.append(words)
        count += len(words)
        if count >= AT_ONCE:
            flush(held)
            held, count = [], 0
    if held:
        flush(held)
    columns = [np.concatenate([span[k] for span in spans]) if spans else np.empty(0, np.int64)
               for k in range(3)]
    inner = pa.StructArray.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
         pa.array(names[columns[2].astype(int)] if spans else [], pa.string())],
        ["first", "words", "lang"])
    return pa.StructArray.from_arrays(
        [pa.array(preds, pa.string()), pa.array(score, pa.float64()),
         pa.array(n_words, pa.int64()),
         pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)],
        ["lang_pred", "score", "n_words", "spans"])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score, n_words and spans; columns of these names give way."""
    rows = packed(docs, found=labelled(F.col(f"`{text_col}`"), model))
    return unpacked(rows, **{name: F.col(f"found.{name}") for name in (
        "lang_pred", "score", "n_words", "spans")})
