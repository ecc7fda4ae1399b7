"""Language identification as inference of a mixture.

Each language has a character trigram model, learned from a bounded labelled sample: the frequency of each trigram beside
its mean over all languages, mixed with that mean, so a trigram that a language never showed costs the same in any of
them. Trigrams are kept as they are, in one sparse table, so neither the letters told apart nor a language's own numbers
depend on how many languages there are.

A document is a mixture: each word comes from one language, and expectation-maximisation estimates the proportions from the
words' likelihoods. The language set is the one of highest penalised likelihood, log-likelihood minus a penalty for each
member, sought from the best single language by adding or dropping a member as long as that gains. The likelihood is
concave in the proportions, so its slope towards a language bounds what adding it can gain: languages whose slope is below
the penalty need no trial. The prediction is the set's largest member and the score its proportion.

Every value of lang that labelled rows have is learned. Null texts and texts without a letter: ``und`` with score 0. Without
any labelled row every document is ``und``. Repeated rows are predicted alike, a row each. An empty table gives no rows.
Columns other than doc_id and text are ignored, or kept as they are by ``keep_identified``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.base import LETTERS, free_name, held_out, prepare

#: The sample that is learned from: documents of each language, and characters of a document, in ``PASSAGES`` passages if it is longer.
PER_LANGUAGE, MAX_CHARS, PASSAGES = 300, 20_000, 4
#: Share of the mean in each language's trigram frequencies; log-likelihood below a word's best language that is as good as none.
SHARED, FLOOR = 0.02, -12.0
ROUNDS, PENALTY = 25, 3.0
#: Picked ids up to which they go to every task, 300 a language; characters that a task takes apart at once; numbers it remembers.
BROADCAST_ROWS, SEGMENT, REMEMBERED = 1_000_000, 1 << 20, 8_000_000
_EDGE = 1


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of words with an edge before and after each, as integers, and where each word's begin."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    text = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    key = (text[:-2] << 42) | (text[1:-1] << 21) | text[2:]
    keep = np.ones(len(text), dtype=bool)
    keep[starts + sizes] = keep[starts + sizes + 1] = False
    return key[keep[: len(key)]], np.cumsum(sizes) - sizes


@dataclass
class LanguageModel:
    """For each trigram (sorted) the languages that have it, as ``places[k] : places[k + 1]`` of ``owners`` and ``gains``: the
    log-likelihood above that of a language without the trigram."""

    languages: list[str]
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words (rows) under the languages (columns), up to a constant for each word."""
        n = len(self.languages)
        events, starts = trigrams(words)
        word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(events))))
        at = np.minimum(np.searchsorted(self.keys, events), max(0, len(self.keys) - 1))
        there = self.keys[at] == events if len(self.keys) else np.zeros(len(events), dtype=bool)
        at, word = at[there], word[there]
        count = self.places[at + 1] - self.places[at]
        entry = np.repeat(self.places[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        flat = np.repeat(word, count) * n + self.owners[entry]
        return np.bincount(flat, weights=self.gains[entry], minlength=len(words) * n).reshape(len(words), n)


def build(counts: pd.DataFrame) -> LanguageModel:
    """The model of rows (lang, key, n)."""
    languages = sorted(counts.lang.unique())
    lang = counts.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    share = counts.n.to_numpy(dtype=np.float64) / np.bincount(lang, weights=counts.n)[lang]
    keys, at = np.unique(counts.key.to_numpy(dtype=np.int64), return_inverse=True)
    mean = np.bincount(at, weights=share) / len(languages)
    gains = np.log((1 - SHARED) / SHARED * share / mean[at] + 1)
    order = np.lexsort((lang, at))
    places = np.concatenate([[0], np.cumsum(np.bincount(at))])
    return LanguageModel(languages, keys, places, lang[order].astype(np.int32), gains[order].astype(np.float32))


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    words = Counter(w for t in frame.drop_duplicates(["doc_id", "text"]).text for w in LETTERS.findall(t.lower()))
    if not words:
        return pd.DataFrame({"lang": [], "key": [], "n": []}).astype({"lang": "object", "key": "int64", "n": "int64"})
    some = list(words)
    events, starts = trigrams(some)
    weight = np.repeat([words[w] for w in some], np.diff(np.append(starts, len(events))))
    keys, at = np.unique(events, return_inverse=True)
    return pd.DataFrame({"lang": frame.lang.iloc[0], "key": keys, "n": np.bincount(at, weights=weight).astype(np.int64)})


def _passages(text: Column, max_chars: int) -> Column:
    n, size = F.length(text), max_chars // PASSAGES
    parts = [F.substr(text, (F.floor((n - size) * k / (PASSAGES - 1)) + 1).cast("int"), F.lit(size)) for k in range(PASSAGES)]
    return F.when(n <= max_chars, text).otherwise(F.concat_ws(" ", *parts))


def _sent(df: DataFrame) -> DataFrame:
    """A small table, broadcast if it is as small as it should be."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Learn from text and lang of rows that aren't held out: a bounded sample of each language, the smallest hashes of ids.

    Trigrams are counted where the texts are; the driver gets the counts, at most per_language * max_chars a language.
    """
    prepare(docs.sparkSession)
    named = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # hashes below a bound under which a language has four times as many rows as needed, then the smallest of those
    sizes = named.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.count(F.lit(1))).alias("share")).checkpoint()
    near = named.select("doc_id", "lang", F.xxhash64("doc_id").alias("o")).join(_sent(sizes), "lang").where(F.col("o") / F.lit(2.0**64) + 0.5 < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))
    picked = _sent(near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct().checkpoint())
    texts = named.join(picked, ["doc_id", "lang"]).select("doc_id", "lang", _passages(F.col("text"), max_chars).alias("text"))
    counts = texts.groupBy("lang").applyInPandas(_count, "lang string, key long, n long").toPandas()
    return build(counts) if len(counts) else LanguageModel([])


def mixture(like: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for the proportions of the languages (columns), given each word's likelihoods relative to its best language, and
    the log-likelihood under them."""
    n = count.sum()
    share = np.full(like.shape[1], 1 / like.shape[1])
    both = like @ share
    for _ in range(rounds if like.shape[1] > 1 else 0):
        new = share * ((count / both) @ like) / n
        moved = np.abs(new - share).max()
        share, both = new, like @ new
        if moved < 1e-4:
            break
    return share, float(count @ np.log(both))


def choose(loglik: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The language set of highest penalised likelihood, its members by share, for words (rows) that occur so often."""
    like = np.exp(np.maximum(loglik - loglik.max(1, keepdims=True), FLOOR))
    n = count.sum()
    cost = penalty * np.log(n + 1)
    members = [int(np.argmax(count @ np.log(like)))]
    shares, value = mixture(like[:, members], count)
    value -= cost
    while True:
        # what adding a language gains is at most the slope towards it
        slope = (count / (like[:, members] @ shares)) @ like - n
        trials = [sorted({*members, int(k)}) for k in np.flatnonzero(slope > cost) if k not in members]
        trials += [[m for m in members if m != k] for k in members if len(members) > 2]
        found = [(mixture(like[:, some], count), some) for some in trials]
        best = max(((ll - len(some) * cost, share, some) for (share, ll), some in found), key=lambda x: x[0], default=None)
        if best is None or best[0] <= value + 1e-9:
            break
        value, shares, members = best
    by = np.argsort(-shares, kind="stable")
    return [members[i] for i in by], shares[by]


def words_of(text: str | None) -> Counter:
    """How often each word occurs in the whole text; long texts are taken apart in segments."""
    found: Counter = Counter()
    text = text or ""
    lo = 0
    while lo < len(text):
        hi = lo + SEGMENT
        while hi < len(text) and text[hi].isalpha():
            hi += 1
        found.update(LETTERS.findall(text[lo:hi].lower()))
        lo = hi
    if not "".join(found).isalpha():
        for w in [w for w in found if not any(map(str.isalpha, w))]:  # numbers of other kinds, such as superscripts
            del found[w]
    return found


def _predictor(model: LanguageModel):
    @F.pandas_udf("lang_pred string, score double, lang_mix string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        places: dict[str, int] = {}
        rows = np.zeros((0, len(model.languages)), dtype=np.float32)
        for texts in batches:
            counts = [words_of(t) if model.languages else Counter() for t in texts]
            if len(places) * max(1, len(model.languages)) > REMEMBERED:
                places, rows = {}, rows[:0]
            new = list(set().union(*counts) - places.keys())
            if new:
                places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
                rows = np.concatenate([rows, model.likelihoods(new).astype(np.float32)])
            out = []
            for c in counts:
                if not c:
                    out.append(("und", 0.0, ""))
                    continue
                at = np.fromiter(map(places.__getitem__, c), dtype=np.int64, count=len(c))
                members, shares = choose(rows[at].astype(np.float64), np.fromiter(c.values(), dtype=np.float64, count=len(c)))
                out.append((model.languages[members[0]], float(min(1.0, shares[0])), ",".join(f"{model.languages[i]}:{s:.3f}" for i, s in zip(members, shares, strict=True))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "lang_mix"])

    return predict


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix (the set with its proportions): one row for each input row."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", _predictor(model)("text").alias("found")).select("doc_id", held_out().alias("held_out"), "found.lang_pred", "found.score", "found.lang_mix")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """Documents in which a language was found that makes up at least the share ``least``; columns as they came. Null and
    empty texts and those without a letter go; repeated rows stay or go together."""
    prepare(docs.sparkSession)
    found = free_name(docs, "language")
    return docs.withColumn(found, _predictor(model)("text")).where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= least)).drop(found)
