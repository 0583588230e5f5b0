"""Toxicity by a convolutional text classifier, trained in numpy (operator 8).

Words are hashed to embeddings; filters one, two and three words wide run over
the whole text, each keeps its maximum, and a logistic layer weighs the maxima.
Words that are rare in the training sample, or as usual with one label as with
the other, share the zero embedding, so that they cannot collide with telling ones. A filter's response is a sum of one table
row per word, which makes scoring a text a matter of table look-ups. Texts are looked
up together: Arrow splits them into one column of words and finds these in the vocabulary.

All labelled rows take part that are not held out. Words are counted in tasks;
a pass over the fitting rows is one job, in which every shard of them goes on
from the same parameters, and the shards' results are averaged.

Thresholds are calibrated per language of the text, which is read off its own
common words, on training rows kept apart from the fit. Scores are rescaled so
that 0.7 is the threshold everywhere.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityloom.llm.language import held_out
from entityloom.llm.workers import kept
from entityloom.session import materialise, release

#: Fitting rows that one task learns from in a pass, on average.
SHARD_ROWS = 4000
#: Words that a task counts before it sends them on.
COUNTED_WORDS = 200_000
#: Averaged parameters become multiples of 2^-30, so that their sum has no order.
UNIT = float(1 << 30)
#: Steps of the scores by which thresholds are found.
SCORE_STEPS = 1 << 16
BUCKETS = 1 << 16
#: A longer word that is not known falls back on so many of its first letters.
STEM = 6
#: Documents that a word must be in, and its chi-square against the label, to be told apart.
LEAST_DOCUMENTS = 5
LEAST_CHI_SQUARE = 10.8
DIMENSIONS = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 14
BATCH = 64
DECISION = 0.7
#: Rows of each label that a language needs for a threshold of its own.
LEAST_LABELS = 20
#: Characters of texts whose words are looked up together.
CHUNK_CHARACTERS = 1 << 21
WORDS = re.compile(r"[^\W\d_]+")
#: For each character of Latin-1: itself if it is in words, else a space.
LETTERS = bytes(b if WORDS.fullmatch(chr(b)) else 32 for b in range(256))
#: Common words by which the language of a text is told; texts without any are "other".
COMMON = {
    "de": "der die das und ist von ein eine nicht mit auf für zu dem den sich auch",
    "en": "the and of to in is was that it for with as at this be by on are from",
    "es": "el los las una por con para que del como más pero sus y o se",
    "fr": "le les des une dans est pour qui sur pas au par plus avec et du ce",
}


def spaced(text: str) -> str:
    """The words of a text in small letters, with spaces around them."""
    small = text.lower()
    try:
        return small.encode("latin-1").translate(LETTERS).decode("latin-1")
    except UnicodeEncodeError:  # other letters
        return " ".join(WORDS.findall(small))


def words_of(text: str) -> list[str]:
    return spaced(text).split()


def profile(words: list[str]) -> str:
    """Language by the most common words found; the first by name of equals."""
    counts = Counter(words)
    best, most = "other", 0
    for language, common in COMMON.items():
        n = sum(counts[w] for w in common.split())
        if n > most:
            best, most = language, n
    return best


def chunks(texts: Sequence[str]) -> Iterator[list[str]]:
    """The texts in turn, up to ``CHUNK_CHARACTERS`` at once, or one that is longer."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > CHUNK_CHARACTERS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def looked_up(texts: list[str], buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``squeezed`` ids of the texts' words one after the other, the number of each text, and its ``profile``."""
    lists = pc.ascii_split_whitespace(pa.array([spaced(t) for t in texts], pa.string()))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(texts)), sizes)[there.to_numpy(zero_copy_only=False)]
    words = words.filter(there)
    sizes = np.bincount(text, minlength=len(texts))

    names = list(dict.fromkeys([*buckets, *(w for common in COMMON.values() for w in common.split())]))
    vocabulary, unknown = pa.array(names, pa.string()), len(names)
    number = np.array([*(buckets.get(w, 0) for w in names), 0], dtype=np.int32)
    place = pc.index_in(words, vocabulary).fill_null(unknown).to_numpy()
    ids = number[place]
    longer = np.flatnonzero((ids == 0) & (pc.utf8_length(words).to_numpy() > STEM))
    stems = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.take(pa.array(longer)), 0, STEM), "*", "")
    ids[longer] = number[pc.index_in(stems, vocabulary).fill_null(unknown).to_numpy()]

    at = {w: i for i, w in enumerate(names)}
    counts = [np.zeros(len(texts))]  # no common word at all comes first of equals
    for common in COMMON.values():
        times = np.bincount([at[w] for w in common.split()], minlength=unknown + 1)
        counts.append(np.bincount(text, times[place], len(texts)))
    languages = ["other", *COMMON]
    best = np.argmax(counts, axis=0)
    near = _near(ids, np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    return ids[near], np.bincount(text[near], minlength=len(texts)), [languages[i] for i in best]


def _near(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which words ``squeezed`` leaves; ``place`` is the word's number in its text."""
    width = max(WIDTHS)
    near = place < width
    for back in range(width + 1):
        near[back:] |= (ids[: len(ids) - back] != 0) & (place[back:] >= back)
    return near


@dataclass
class Model:
    buckets: dict[str, int]  # known words; 0 is every other word
    tables: list[list[np.ndarray]]  # per width and position: [bucket, filter]
    bias: np.ndarray
    weights: np.ndarray
    base: float
    thresholds: dict[str, float]

    def raw(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The logistic layer's answer for each text; ``sizes`` cuts ``ids`` into texts."""
        pool, _ = pooled_texts(*padded(ids, sizes), self.tables, self.bias)
        return _logistic(np.array([line @ self.weights for line in pool]) + self.base)

    def scores(self, texts: Sequence[str]) -> list[float]:
        found = []
        for chunk in chunks(texts):
            ids, sizes, languages = looked_up(chunk, self.buckets)
            for raw, language in zip(self.raw(ids, sizes).tolist(), languages, strict=True):
                found.append(_scaled(raw, self.thresholds.get(language, self.thresholds[""])))
        return found

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _scaled(raw: float, at: float) -> float:
    if raw < at:
        return min(DECISION * raw / at, np.nextafter(DECISION, 0))
    return min(1.0, DECISION + (1 - DECISION) * (raw - at) / (1 - at))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pooled(ids: np.ndarray, tables, bias: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maximum and place of every filter; a text is padded to the widest filter with word 0."""
    short = max(WIDTHS) - len(ids)
    if short > 0:
        ids = np.concatenate([ids, np.zeros(short, dtype=ids.dtype)])
    best, places = [], []
    for own in tables:
        response = own[0][ids[: len(ids) - len(own) + 1]]
        for j in range(1, len(own)):
            response = response + own[j][ids[j : len(ids) - len(own) + 1 + j]]
        place = response.argmax(axis=0)
        places.append(place)
        best.append(response[place, np.arange(response.shape[1])])
    return np.concatenate(best) + bias, places


def padded(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` and ``sizes`` with each text padded to the widest filter with word 0."""
    whole = np.maximum(sizes, max(WIDTHS))
    first = np.cumsum(whole) - whole
    out = np.zeros(whole.sum(), dtype=ids.dtype)
    out[np.arange(len(ids)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)] = ids
    return out, whole


def pooled_texts(
    ids: np.ndarray, sizes: np.ndarray, tables, bias: np.ndarray, places: bool = False
) -> tuple[np.ndarray, list[np.ndarray]]:
    """``pooled`` for padded texts one after the other: a line for each text; places are those in ``ids``."""
    starts = np.cumsum(sizes) - sizes
    best, found = [], []
    for own in tables:
        n = len(ids) - len(own) + 1
        response = own[0].take(ids[:n], axis=0)
        for j in range(1, len(own)):
            response += own[j].take(ids[j : n + j], axis=0)
        ends = starts + sizes - len(own) + 1
        if places:
            parts = zip(starts.tolist(), ends.tolist(), strict=True)
            found.append(np.array([a + response[a:b].argmax(axis=0) for a, b in parts]))
            best.append(response[found[-1], np.arange(response.shape[1])])
        else:  # windows over two texts lie between the end of one and the start of the next
            cuts = np.column_stack([starts, ends]).ravel()[:-1]
            best.append(np.maximum.reduceat(response, cuts, axis=0)[::2])
    return np.concatenate(best, axis=1) + bias, found


def stem(word: str) -> str:
    """What stands in for a longer word that is not known itself."""
    return word[:STEM] + "*" if len(word) > STEM else ""


def ids_of(words: list[str], buckets: dict[str, int]) -> np.ndarray:
    get = buckets.get
    return np.array([get(w) or (get(stem(w), 0) if len(w) > STEM else 0) for w in words], dtype=np.int32)


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Without what a run of unknown words has beyond the widest filter; every response stays, in its order."""
    width = max(WIDTHS)
    if len(ids) <= width:
        return ids
    known = np.concatenate([np.ones(width, dtype=np.int64), ids != 0])
    near = np.cumsum(known)
    near = near[width:] - np.concatenate([[0], near[: len(ids) - 1]])  # among this word and ``width`` before it
    return ids[near > 0]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, zeros, ones): documents of each label that hold a word, or a word with that beginning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def sent() -> pd.DataFrame:
            words = list(found[0].keys() | found[1].keys())
            made = {"word": words, "zeros": [found[0][w] for w in words], "ones": [found[1][w] for w in words]}
            for counter in found:
                counter.clear()
            return pd.DataFrame(made)

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(words_of(text))
                found[int(toxic)].update(words | {x for w in words if (x := stem(w))})
                if max(map(len, found)) >= COUNTED_WORDS:
                    yield sent()
        yield sent()

    partial = rows.select("text", "toxic").mapInPandas(run, "word string, zeros long, ones long")
    return partial.groupBy("word").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def telling_words(counts: DataFrame, n: int, ones: int) -> list[str]:
    """Words whose documents have another share of labels than the rest."""
    both = F.col("zeros") + F.col("ones")
    expected = both * ones / n
    spread = expected * (1 - ones / n) * (n - both) / n
    off = F.col("ones") - expected
    telling = (both >= LEAST_DOCUMENTS) & (both < n) & (off * off >= LEAST_CHI_SQUARE * spread)
    return sorted(r.word for r in counts.filter(telling).select("word").collect())  # the model's vocabulary


def known_words(words: list[str]) -> dict[str, int]:
    """Row of the embedding of each word; row 0 is for all others."""
    buckets = {w: 1 + zlib.crc32(w.encode()) % (BUCKETS - 1) for w in words}
    used = {b: i + 1 for i, b in enumerate(sorted(set(buckets.values())))}
    return {w: used[b] for w, b in buckets.items()}


def encoded(rows: DataFrame, buckets: dict[str, int]) -> DataFrame:
    """Rows with ``ids`` in place of the text, and its language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, languages = [], []
            for chunk in chunks(batch.pop("text")):
                ids, sizes, told = looked_up(chunk, buckets)
                held += [x.astype("<i4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]
                languages += told
            batch["language"], batch["ids"] = languages, held
            yield batch

    return rows.mapInPandas(run, "doc_id string, toxic int, rest int, language string, ids binary")


def _start(size: int, rng) -> dict[str, np.ndarray]:
    parameters = {
        "e": rng.normal(0, 0.3, (size, DIMENSIONS)),
        "b": np.zeros(FILTERS * len(WIDTHS)),
        "v": rng.normal(0, 0.3, FILTERS * len(WIDTHS)),
        "c": np.zeros(1),
    }
    parameters["e"][0] = 0
    for w in WIDTHS:
        parameters[f"w{w}"] = rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS))
    return parameters


def _tables(parameters: dict[str, np.ndarray]) -> list[list[np.ndarray]]:
    return [[parameters["e"] @ parameters[f"w{w}"][j] for j in range(w)] for w in WIDTHS]


def one_pass(state: dict, ids: list[np.ndarray], labels: np.ndarray, share: float, rng) -> dict:
    """Parameters and Adam's moments after one pass on the logistic loss; both labels weigh the same."""
    parameters, mean, square = ({k: p.copy() for k, p in state[n].items()} for n in ("parameters", "mean", "square"))
    step = state["step"]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    whole, lengths = padded(np.concatenate(ids), np.array([len(x) for x in ids]))
    ids = np.split(whole, np.cumsum(lengths)[:-1])
    order = rng.permutation(len(ids))
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        now = _tables(parameters)
        words = np.concatenate([ids[i] for i in part])
        pool, places = pooled_texts(words, lengths[part], now, parameters["b"], places=True)
        error = _logistic(pool @ parameters["v"] + parameters["c"][0]) - labels[part]
        error *= weight[part] / len(part)
        grads = {k: np.zeros_like(p) for k, p in parameters.items()}
        grads["v"] = pool.T @ error
        grads["c"][0] = error.sum()
        back = error[:, None] * parameters["v"]
        grads["b"] = back.sum(axis=0)
        for n, w in enumerate(WIDTHS):
            own = back[:, n * FILTERS : (n + 1) * FILTERS]
            for j in range(w):
                rows = words[places[n] + j]
                grads[f"w{w}"][j] = np.einsum("bf,bfd->df", own, parameters["e"][rows])
                np.add.at(grads["e"], rows, own[:, :, None] * parameters[f"w{w}"][j].T)
        grads["e"][0] = 0
        step += 1
        for k, p in parameters.items():
            g = grads[k] + 1e-5 * p
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            p -= 0.02 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {"parameters": parameters, "mean": mean, "square": square, "step": step}


def fit(rows: DataFrame, buckets: dict[str, int], n: int, ones: int, seed: int = 7) -> Model:
    """Passes over all ``rows``; a shard holds about ``SHARD_ROWS`` of them, dealt by the hash of their id."""
    spark = rows.sparkSession
    first = _start(max(buckets.values(), default=0) + 1, np.random.default_rng(seed))
    empty = {k: np.zeros_like(p) for k, p in first.items()}
    state: dict = {"parameters": first, "mean": empty, "square": empty, "step": 0}
    shards, share = -(-n // SHARD_ROWS), max(ones / n, 1e-9)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    pairs = rows.select(shard, "doc_id", "toxic", "ids").rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3]))))
    dealt = pairs.partitionBy(shards, int)

    for epoch in range(EPOCHS):
        given = spark.sparkContext.broadcast(state)

        def learnt(part: Iterator[tuple], given=given, epoch=epoch) -> Iterator[tuple]:
            held: dict[int, list] = {}
            for number, row in part:
                held.setdefault(number, []).append(row)
            for number, own in held.items():
                own.sort()
                ids = [np.frombuffer(r[2], dtype="<i4") for r in own]
                labels = np.array([r[1] for r in own], dtype=float)
                after = one_pass(given.value, ids, labels, share, np.random.default_rng([seed, epoch, number]))
                names = ("parameters", "mean", "square")
                scaled = {m: {k: np.rint(len(own) * UNIT * p).astype(np.int64) for k, p in after[m].items()} for m in names}
                yield len(own) * after["step"], len(own), scaled

        steps, rows_seen, total = dealt.mapPartitions(learnt).treeReduce(_summed)
        state = {m: {k: p / (UNIT * rows_seen) for k, p in held.items()} for m, held in total.items()}
        state["step"] = round(steps / rows_seen)
        given.unpersist()
    final = state["parameters"]
    tables = [[t.astype(np.float32) for t in own] for own in _tables(final)]
    return Model(buckets, tables, final["b"], final["v"], float(final["c"][0]), {"": 0.5})


def _summed(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], {m: {k: p + b[2][m][k] for k, p in held.items()} for m, held in a[2].items()}


def best_threshold(zeros: np.ndarray, ones: np.ndarray) -> float:
    """The middle of the gap at which F1 is highest; rows of each label by ascending score step."""
    steps = np.flatnonzero(zeros + ones)[::-1]
    hits = np.cumsum(ones[steps])
    f1 = 2 * hits / (np.cumsum((zeros + ones)[steps]) + max(ones.sum(), 1))
    at = int(f1.argmax())
    below = steps[at + 1] if at + 1 < len(steps) else 0.0
    return float(np.clip((steps[at] + below) / 2 / SCORE_STEPS, 0.02, 0.98))


def calibrate(model: Model, rows: DataFrame) -> None:
    """Thresholds from all ``rows``: the driver gets a count per language, label and score step."""

    @F.pandas_udf("int")
    def step(ids: pd.Series) -> pd.Series:
        if not len(ids):
            return pd.Series([], dtype="int32")
        raw = model.raw(np.frombuffer(b"".join(ids), dtype="<i4"), ids.map(len).to_numpy() // 4)
        return pd.Series([min(int(x * SCORE_STEPS), SCORE_STEPS - 1) for x in raw.tolist()], dtype="int32")

    counted = rows.select("language", "toxic", step("ids").alias("step")).groupBy("language", "toxic", "step")
    found: dict[str, np.ndarray] = {}
    for r in counted.agg(F.count("*").alias("n")).collect():
        found.setdefault(r.language, np.zeros((2, SCORE_STEPS), dtype=np.int64))[r.toxic, r.step] += r.n
    every = sum(found.values(), np.zeros((2, SCORE_STEPS), dtype=np.int64))
    if not every.sum(axis=1).all():
        return
    model.thresholds[""] = best_threshold(*every)
    for language in sorted(found):
        if found[language].sum(axis=1).min() >= LEAST_LABELS:
            model.thresholds[language] = best_threshold(*found[language])


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from all labelled rows whose id is not held out; None without rows of both labels.

    Ids with remainder 0 fit the filters, those with remainder 2 the thresholds. A
    document that is labelled twice counts with each label.
    """
    rest = (F.crc32(F.col("doc_id").cast("string")) % 3).cast("int").alias("rest")
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"), rest)
    texts = docs.filter(~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Texts move once, at any size by the same join, and are read from what is written.
    rows = materialise(texts.join(usable.hint("merge"), "doc_id"), "labelled-texts")
    counts = {(r.rest, r.toxic): r.n for r in rows.groupBy("rest", "toxic").agg(F.count("*").alias("n")).collect()}
    apart = (0, 0) in counts and (0, 1) in counts
    zeros, ones = (sum(n for (r, y), n in counts.items() if y == toxic and (r == 0 or not apart)) for toxic in (0, 1))
    if not zeros or not ones:
        release(rows)
        return None
    fitting = F.col("rest") == 0 if apart else F.lit(True)
    buckets = known_words(telling_words(word_counts(rows.filter(fitting)), zeros + ones, ones))
    kept_rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "rest", "text")
    written = materialise(encoded(kept_rows, buckets), "toxicity")
    release(rows)
    model = fit(written.filter(fitting), buckets, zeros + ones, ones)
    calibrate(model, written.filter("rest = 2"))
    release(written)
    return model


def toxicity(text: Column, model: Model | None) -> Column:
    """Score from 0 to 1 of each whole text; null counts as empty, no model gives 0."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("toxicity", dict)
        for texts in batches:
            yield pd.Series(model.scores(texts) if model else np.zeros(len(texts)), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))
