"""Toxicity by weak supervision.

Voters look at a text: lexicons of insults, lexicons of word stems induced
from labelled rows, and patterns. A generative label model estimates from the
votes on all documents (labels are known for some) how often each voter
speaks up in either class and how voters are correlated within a class; its
posterior is the label on which a linear classifier is trained, over votes
and hashed words and stems. The classifier scores whole texts.

Fitted on bounded samples (LABELLED_ROWS for the stems, TRAINING_ROWS for the
classifier, half of them from either class of the posterior; expected sizes of
hashed samples); without training texts the label model's posterior scores; the label model uses the votes
on all documents, and what reaches the driver is a table of at most one row
per combination of votes and label.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if_small, written

LABELLED_ROWS, TRAINING_ROWS = 20_000, 6_000

#: Insults by what they aim at.
LEXICONS = {
    "intellect": "idiot idiots idiotic stupid stupidity moron morons moronic imbecile dumb dimwit fool",
    "contempt": "pathetic worthless loser losers clown clowns coward useless nobody failure",
    "disgust": "disgusting scum trash garbage filth filthy vermin vile repulsive sickening parasite",
    "abuse": "bastard bitch asshole crap damn shit fuck fucking whore slut jerk retard",
}
PATTERNS = {
    "masked": r"\b[a-z]+[*#@]{2,}[a-z]*",
    "threat": r"\b(?:i|we) (?:will|'ll) (?:kill|hurt|destroy|find) you\b|\bgo (?:die|kill yourself)\b|\b(?:hate|despise) you\b",
    "address": r"\byou(?: are|'re) (?:an? |such an? |so |all )?\w+",
    "shouting": r"(?:\b[A-Z]{3,}\b\W+){6,}",
}
#: Voters of stems induced from labelled rows.
INDUCED = 3
STEM_LENGTHS = (4, 5)
#: A stem counts as toxic if in both halves of the labelled texts so many of the texts with it are toxic, and it occurs
#: in this share of the toxic ones.
STEM_PURITY, STEM_SUPPORT, LEAST_STEM_TEXTS = 0.99, 0.02, 4
STEMS_PER_LENGTH = 500

LISTED = {w: i for i, words in enumerate(LEXICONS.values()) for w in words.split()}
#: A listed word that labelled texts mostly contradict (it means something else in some language) has no voter.
NO_VOTER = -1
VOTERS = [*LEXICONS, *(f"stems_{i}" for i in range(INDUCED)), *PATTERNS]
_LEXICON_VOTERS = len(LEXICONS) + INDUCED
BITS = 18
BUCKETS = 1 << BITS
_WORD = re.compile(r"[^\W\d_]+")
_KNOWN_WORDS = 150_000


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that labels are not learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


# --- votes and features of a text ------------------------------------------------


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


_COMPILED = {name: re.compile(p, 0 if name == "shouting" else re.I) for name, p in PATTERNS.items()}
_TWO_SHOUTED = re.compile(r"[A-Z]{3}\W+[A-Z]{3}")


def _may_match(name: str, text: str, words: set[str]) -> bool:
    """False where a pattern cannot match: spares most texts the search."""
    if name == "masked":
        return "*" in text or "#" in text or "@" in text
    if name == "shouting":
        return _TWO_SHOUTED.search(text) is not None
    if name == "threat" and "go" in words and ("die" in words or "d\u0131e" in words or "\u0130" in text):
        return True
    return "you" in words or "yourself" in words or "your\u017felf" in words


class Voters:
    """The voters of some stems (see ``induce_stems``)."""

    def __init__(self, stems: dict[str, int]):
        self.listed = {w: 1 << i for w, i in LISTED.items() if stems.get(f"={w}") != NO_VOTER}
        self.stems = {s: 1 << len(LEXICONS) + i for s, i in stems.items() if i != NO_VOTER}

    def votes(self, text: str, words: set[str]) -> int:
        out = 0
        for word in self.listed.keys() & words:
            out |= self.listed[word]
        for n in STEM_LENGTHS:
            for stem in self.stems.keys() & {w[:n] for w in words}:
                out |= self.stems[stem]
        for i, (name, pattern) in enumerate(_COMPILED.items()):
            if _may_match(name, text, words) and pattern.search(text):
                out |= 1 << _LEXICON_VOTERS + i
        return out


def _hashed(word: str) -> list[int]:
    """Buckets of a word and of its stems."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    for i, n in enumerate(STEM_LENGTHS, start=1):
        out.append(zlib.crc32(word[:n].encode(), n) % BUCKETS + i * BUCKETS)
    return out


# --- stems from labelled rows -----------------------------------------------------


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stem, texts and toxic texts with it, in the first and in the second half."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = _words(text.as_py())
            stems = {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}
            for stem in stems | {f"={w}" for w in words if w in LISTED}:
                count = counts.setdefault(stem, [0, 0, 0, 0])
                count[2 * half] += 1
                count[2 * half + 1] += bool(label)
    columns = zip(*counts.values(), strict=True) if counts else [[], [], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns)],
        names=["stem", "texts_0", "toxic_0", "texts_1", "toxic_1"],
    )


def _sampled(key: Column, expected: int, of: int) -> Column:
    """A hashed sample of ``expected`` of ``of`` rows (all, if there are fewer)."""
    if expected >= of:
        return F.lit(True)
    # of the whole 64 bits: no table is so large that the sample is empty
    return F.xxhash64(key, F.lit("sample")) < F.lit((expected << 64) // of - (1 << 63)).cast("long")


def induce_stems(docs: DataFrame, labels: DataFrame) -> dict[str, int]:
    """stem -> its voter's number; "=word" -> NO_VOTER for listed words that
    labelled texts contradict. ``docs``: doc_id, text; ``labels``: doc_id,
    toxic, each id once, training rows only."""
    sample = written(labels.where(_sampled(F.col("doc_id"), LABELLED_ROWS, labels.count())), "labelled")
    # copies and most near copies of a text share its least hashed words: one of them counts
    hashed = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w)))
    least_words = F.slice(F.array_sort(hashed), 1, 4)
    texts = (
        docs.join(broadcast_if_small(sample), "doc_id")
        .groupBy(least_words.alias("key"))
        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int").alias("half"))
    )
    total = texts.agg(F.sum("toxic")).first()[0] or 0
    least = max(LEAST_STEM_TEXTS, STEM_SUPPORT * total) / 2
    names = ["texts_0", "toxic_0", "texts_1", "toxic_1"]
    counts = (
        texts.mapInArrow(_stem_counts, "stem string, " + ", ".join(f"{n} long" for n in names))
        .groupBy("stem")
        .agg(*(F.sum(n).alias(n) for n in names))
    )
    counts = written(
        counts.withColumn("toxic", F.col("toxic_0") + F.col("toxic_1")).withColumn("texts", F.col("texts_0") + F.col("texts_1")),
        "stems",
    )
    contradicted = counts.where(
        F.col("stem").startswith("=") & (F.col("texts") >= LEAST_STEM_TEXTS) & (F.col("toxic") < 0.5 * F.col("texts"))
    ).collect()  # of the listed words
    for half in "01":
        counts = counts.where(
            (F.col(f"toxic_{half}") >= least) & (F.col(f"toxic_{half}") >= STEM_PURITY * F.col(f"texts_{half}"))
        )
    best = counts.where(~F.col("stem").startswith("=")).orderBy(F.desc("toxic"), "stem").limit(STEMS_PER_LENGTH * len(STEM_LENGTHS)).collect()
    # stems of listed words and those a shorter stem covers would only repeat another vote
    found = [r["stem"] for r in best if not any(w.startswith(r["stem"]) for w in LISTED)]
    chosen = [s for s in found if not any(s != t and s.startswith(t) for t in found)]
    return {stem: i % INDUCED for i, stem in enumerate(chosen)} | {r["stem"]: NO_VOTER for r in contradicted}


# --- the label model -----------------------------------------------------------------


@dataclass
class LabelModel:
    """Rate of speaking up by class, correlations within a class, class share."""

    share: float
    rates: np.ndarray  # [class, voter]
    correlations: np.ndarray
    weights: np.ndarray  # of each voter's evidence, less than 1 if others repeat it

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of votes (0 or 1)."""
        spoke = np.log(self.rates[1]) - np.log(self.rates[0])
        silent = np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])
        evidence = (votes * spoke + (1 - votes) * silent) @ self.weights
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.share / (1 - self.share)), -50, 50)))

    def linear(self) -> tuple[float, np.ndarray]:
        """Bias and vote weights of the posterior's margin."""
        silent = (np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])) * self.weights
        spoke = (np.log(self.rates[1]) - np.log(self.rates[0])) * self.weights
        return float(np.log(self.share / (1 - self.share)) + silent.sum()), spoke - silent


def unpacked(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(len(VOTERS))) & 1


#: Where labels are known, the rows without one weigh together so much of those with one: votes that never meet in a
#: text (of different languages, say) would otherwise draw the two classes apart along another line than toxicity.
UNLABELLED_WEIGHT = 0.1


def fit_label_model(masks: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over distinct (votes, label) rows; label 0, 1,
    or -1 where it is not known. Starts from the known labels, or from a guess
    where there are none. Correlated voters share their evidence."""
    votes, n = unpacked(masks).astype(float), len(VOTERS)
    model = LabelModel(
        0.1, np.stack([np.full(n, 0.02), np.full(n, 0.3)]), np.zeros((n, n)), np.ones(n)
    )
    known = labels >= 0
    seen = counts
    if len(set(labels[known])) == 2:
        seen = counts * np.where(known, 1.0, UNLABELLED_WEIGHT * counts[known].sum() / max(1.0, counts[~known].sum()))
        model.rates = np.clip(
            np.stack([(counts * (labels == c)) @ votes / counts[labels == c].sum() for c in (0, 1)]), 1e-4, 1 - 1e-4
        )
    for _ in range(rounds):
        y = np.where(known, labels, model.posterior(votes)) if len(votes) else np.zeros(0)
        toxic, clean = seen * y, seen * (1 - y)
        rates = np.stack([(w @ votes + 0.5 * guess) / (w.sum() + 0.5) for w, guess in ((clean, 0.02), (toxic, 0.3))])
        share = (toxic.sum() + 0.1) / (seen.sum() + 1)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        spread = np.zeros((n, n))
        for w, rate in ((clean, rates[0]), (toxic, rates[1])):
            rest = votes - rate
            spread += (rest * w[:, None]).T @ rest
        deviation = np.sqrt(np.maximum(np.diag(spread), 1e-12))
        correlations = spread / np.outer(deviation, deviation)
        np.fill_diagonal(correlations, 0)
        model = LabelModel(float(np.clip(share, 1e-4, 1 - 1e-4)), rates, correlations, np.ones(n))
    model.weights = 1 / (1 + np.maximum(model.correlations, 0).sum(axis=1))
    return model


# --- the classifier ---------------------------------------------------------------------


@dataclass
class ToxicityModel:
    stems: dict[str, int]
    label_model: LabelModel
    bias: float
    vote_weights: np.ndarray
    weights: np.ndarray = field(repr=False)  # of hashed words and stems


class _Scorer(dict):
    """Scores texts; remembers the weights of words up to a bound."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model, self.voters = model, Voters(model.stems)
        self.by_votes: dict[int, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        self[word] = weight = float(sum(self.model.weights[h] for h in _hashed(word)))
        return weight

    def score(self, text: str) -> float:
        words = _words(text)
        votes = self.voters.votes(text, words)
        if votes not in self.by_votes:
            self.by_votes[votes] = self.model.bias + float(unpacked(np.array([votes]))[0] @ self.model.vote_weights)
        margin = self.by_votes[votes]
        if words:
            # fsum does not depend on the order of the set
            margin += math.fsum(map(self.__getitem__, words)) / len(words) ** 0.5
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, margin))))


def _on_votes(votes: np.ndarray, target: np.ndarray, share: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Bias and vote weights by Newton's method; ``share`` weighs the rows."""
    a = np.concatenate([np.ones((len(votes), 1)), votes], axis=1)
    ridge = np.diag([1e-6] + [1e-4] * votes.shape[1])
    x = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        slope = a.T @ (share * (p - target)) + ridge @ x
        x -= np.linalg.solve((a * (share * (p * (1 - p) + 1e-6))[:, None]).T @ a + ridge, slope)
    return x


def fit_classifier(votes: np.ndarray, features: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rounds: int = 60):
    """(bias, vote weights, feature weights): logistic regression on soft
    labels of weighted rows, features over the root of the number of words, by Adam with an L2 penalty. Starts from
    the regression on the votes alone."""
    width = (len(STEM_LENGTHS) + 1) * BUCKETS
    sizes = np.array([len(f) for f in features], dtype=np.int64)
    flat = np.concatenate(features) if len(features) else np.zeros(0, dtype=np.int32)
    used = np.flatnonzero(np.bincount(flat, minlength=width))
    number = np.zeros(width, dtype=np.int32)
    number[used] = np.arange(len(used))
    at = number[flat]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    value = (1 / np.sqrt(np.maximum(sizes // (len(STEM_LENGTHS) + 1), 1))).astype(np.float32)[row]
    share = weight / weight.sum()
    x = np.concatenate([_on_votes(votes, target, share), np.zeros(len(used))])
    penalty = np.concatenate([[0.0], np.full(votes.shape[1], 1e-5), np.full(len(used), 1e-2)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = 1 + votes.shape[1]
    for t in range(1, rounds + 1):
        margin = x[0] + votes @ x[1:k] + np.bincount(row, weights=x[k:][at] * value, minlength=len(sizes))
        wrong = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) * share
        slope = np.concatenate([[wrong.sum()], votes.T @ wrong, np.bincount(at, weights=wrong[row] * value, minlength=len(used))])
        slope += penalty * x
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
    weights = np.zeros(width, dtype=np.float32)
    weights[used] = x[k:]
    return float(x[0]), x[1:k], weights


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Stems, label model and classifier, from the labels of training ids only.

    A null label counts as none; of repeated labels of an id the largest
    holds. Without labels the label model rests on the votes alone.
    """
    rows = _plain(docs, id_col, text_col)
    known = (
        labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
        .agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    stems = induce_stems(rows, known)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            masks = [voters.votes(t, _words(t)) for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32())], names=["doc_id", "text_hash", "votes"]
            )

    hashed_rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    votes_table = written(hashed_rows.mapInArrow(vote, "doc_id long, text_hash long, votes int"), "votes")
    # a row per combination of votes and label, of which there is a fixed number
    votes_by_label = (
        votes_table.join(known, "doc_id", "left")
        .groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    table = votes_by_label.collect()
    masks, marks, counts = (np.array([r[c] for r in table], dtype=np.int64) for c in ("votes", "toxic", "n"))
    label_model = fit_label_model(masks, marks, counts.astype(float))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words = [_words(t) for t in texts]
            votes = [voters.votes(t, w) for t, w in zip(texts, words, strict=True)]
            # sorted: the fit does not depend on a set's order
            hashed = [np.array([h for x in sorted(w) for h in _hashed(x)], dtype="<i4").tobytes() for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.int32()), pa.array(hashed, pa.binary())], names=["votes", "features"]
            )

    # half of the sample from either class of the posterior, so that a rare one has its rows; weights undo it
    training = votes_table.where(~held_out(F.col("doc_id"))).select("text_hash", "votes").distinct()
    training = written(training, "training_votes")
    by_votes = training.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = np.array([r["votes"] for r in by_votes], dtype=np.int64)
    texts = np.array([r["n"] for r in by_votes], dtype=np.int64)
    toxic = label_model.posterior(unpacked(seen).astype(float)) >= 0.5
    found = [int(texts[~toxic].sum()), int(texts[toxic].sum())]
    wanted = [max(TRAINING_ROWS // 2, TRAINING_ROWS - found[1 - c]) for c in (0, 1)]
    of_class = F.col("votes").isin([int(v) for v in seen[toxic]])
    chosen = training.where(
        F.when(of_class, _sampled(F.col("text_hash"), wanted[1], found[1])).otherwise(
            _sampled(F.col("text_hash"), wanted[0], found[0])
        )
    )
    chosen = written(chosen.select("text_hash"), "training_sample")
    sample = (
        hashed_rows.join(broadcast_if_small(chosen), "text_hash", "left_semi")
        .groupBy("text_hash")
        .agg(F.min("text").alias("text"))
        .select("text")
        .mapInArrow(features, "votes int, features binary")
        .collect()
    )  # TRAINING_ROWS rows
    if not sample:
        return ToxicityModel(stems, label_model, *label_model.linear(), np.zeros((len(STEM_LENGTHS) + 1) * BUCKETS, dtype=np.float32))
    masks = np.array([r["votes"] for r in sample], dtype=np.int64)
    votes = unpacked(masks).astype(float)
    target = label_model.posterior(votes)
    weight = np.where(target >= 0.5, *(max(1.0, found[c] / wanted[c]) for c in (1, 0)))
    bias, vote_weights, weights = fit_classifier(
        votes, [np.frombuffer(r["features"], dtype="<i4") for r in sample], target, weight
    )
    return ToxicityModel(stems, label_model, bias, vote_weights, weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) per row.

    A null text counts as empty and an empty one has the score of a text
    without features; a null id stays null and is not held out; repeated rows
    stay repeated; an empty table gives an empty result; other columns are
    not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 3 * 2**18 weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return (
        _plain(docs, id_col, text_col)
        .mapInArrow(scored, "doc_id long, score double")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        )
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not
    predicted toxic. A null text is scored as an empty one; repeated rows stay
    or go together; an empty table stays empty; columns may have any names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index(text_col)
    # plain names inside: mapInArrow takes a dot in a name for a field
    plain = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            keep = [scorer.score(t.as_py() or "") < 0.5 for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(clean, plain.schema).toDF(*names)
