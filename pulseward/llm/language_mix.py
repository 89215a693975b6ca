"""Language identification by mixtures: a document's language proportions by expectation-maximisation.

Every language is a distribution over hashed letter trigrams, counted over all training documents. A document's trigrams
are taken as drawn from a mixture of the languages; expectation-maximisation estimates the proportions. Languages
enter the document's set, largest proportion first, as long as the log-likelihood rises by more than a penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import blocks, map_blocks, mix

BUCKETS = 1 << 13
#: Count added to each bucket of a language.
SMOOTHING = 0.3
#: Steps of expectation-maximisation over all languages, and over a tried set.
STEPS, SET_STEPS = 12, 10
#: A further language must raise the log-likelihood by so many times the log of the number of trigrams.
PENALTY = 2.0
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of all texts (word edges count as a letter) and each text's end in that array."""
    joined = [(t or "").lower() + "\n\n" for t in texts]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in joined])
    value = np.where(letters()[points], points, 0).astype(np.uint64)
    keep = value != 0
    keep[1:] |= value[:-1] != 0  # one gap for a run of other characters
    place = np.cumsum(keep)
    kept_ends = place[ends - 1]
    value = value[keep]
    if len(value) < 2:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    before = np.concatenate((np.zeros(1, np.uint64), value[:-1]))
    after = np.concatenate((value[1:], np.zeros(1, np.uint64)))
    middle = value != 0
    code = mix((before << np.uint64(42)) ^ (value << np.uint64(21)) ^ after)[middle]
    return (code % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(middle)[kept_ends - 1]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets, languages

    def infer(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions (texts, languages) of the selected sets, posterior of the best single language, trigram counts."""
        grams, ends = trigrams(texts)
        starts = np.concatenate(([0], ends[:-1]))
        found, counts = [], []
        for a, b in zip(starts, ends):
            dense = np.bincount(grams[a:b], minlength=BUCKETS)
            found.append(np.flatnonzero(dense))
            counts.append(dense[found[-1]])
        n = len(self.languages)
        share = np.zeros((len(texts), n))
        posterior = np.zeros(len(texts))
        some = np.flatnonzero([len(f) for f in found]) if n else np.zeros(0, np.int64)
        if len(some):
            share[some], posterior[some] = self._mixtures([found[i] for i in some], [counts[i] for i in some])
        return share, posterior, ends - starts

    def _mixtures(self, found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(f) for f in found])
        log_p = self.log_p[np.concatenate(found)]
        weight = np.concatenate(counts).astype(np.float32)
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(weight, starts).astype(np.float64)
        single = np.add.reduceat(log_p * weight[:, None], starts, axis=0).astype(np.float64)
        shift = log_p.max(axis=1)
        likely = np.exp(log_p - shift[:, None])
        base = np.add.reduceat(shift * weight, starts).astype(np.float64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        docs, n = single.shape
        full, _ = _maximise(likely, weight, owner, starts, total, np.full((docs, n), 1 / n, np.float32), STEPS)
        order = np.argsort(-full, axis=1, kind="stable")
        best = single.argmax(axis=1)
        level = single.max(axis=1) - PENALTY * np.log(total)
        share = np.zeros((docs, n))
        share[np.arange(docs), best] = 1
        posterior = 1 / np.exp(np.minimum(single - single.max(axis=1, keepdims=True), 0)).sum(axis=1)
        active = np.arange(docs)
        for size in range(2, n + 1):
            # The set of the best languages, for documents whose last extension paid.
            rows = np.isin(owner, active, assume_unique=False) if len(active) < docs else slice(None)
            inside = np.zeros((len(active), n), np.float32)
            np.put_along_axis(inside, order[active, :size], 1.0, axis=1)
            start_share = inside * np.maximum(full[active], 1e-3)
            start_share /= start_share.sum(axis=1, keepdims=True)
            own = np.repeat(np.arange(len(active)), sizes[active])
            at = np.cumsum(sizes[active]) - sizes[active]
            got, value = _maximise(likely[rows], weight[rows], own, at, total[active], start_share.astype(np.float32), SET_STEPS)
            value = value + base[active] - PENALTY * size * np.log(total[active])
            better = value > level[active]
            active = active[better]
            if not len(active):
                break
            share[active], level[active] = got[better], value[better]
        return share, posterior


def _maximise(likely, weight, owner, starts, total, share, steps) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps`` steps, and their log-likelihood."""
    for _ in range(steps):
        joint = likely * share[owner]
        joint *= (weight / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None].astype(np.float32)
    seen = np.maximum((likely * share[owner]).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(seen) * weight, starts).astype(np.float64)


def held_out(doc_id: Column) -> Column:
    """Documents nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Trigram counts by language over the whole texts of all documents with a language that are not held out.

    The model holds BUCKETS numbers a language, whatever the size of the corpus.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in blocks(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            grams, ends = trigrams(part.column("text").to_pylist())
            owner = np.searchsorted(ends, np.arange(len(grams)), "right")
            for lang in set(langs):
                own = np.bincount(grams[(langs == lang)[owner]], minlength=BUCKETS)
                sums[lang] = sums[lang] + own if lang in sums else own
        for lang, row in sums.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(row[used], pa.int64())}
            )

    counted = known.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    sums = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        column = np.searchsorted(np.array(languages), np.array(table.column("lang").to_pylist()))
        sums[table.column("bucket").to_numpy(), column] += table.column("n").to_numpy()
    return Model(languages, np.log(sums / sums.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score, languages, proportions``.

    ``languages`` is the selected set, largest proportion first; ``lang_pred`` its first, ``und`` for a text that is null or
    has no letter (score 0, no languages), or when nothing was learned. ``score`` is the proportion of ``lang_pred`` times
    the posterior of the best single language.
    """

    def infer(part: pa.RecordBatch) -> dict:
        share, posterior, grams = model.infer(part.column("text").to_pylist())
        predicted, scores, sets, parts = [], [], [], []
        for row, p, n in zip(share, posterior, grams):
            chosen = [i for i in np.argsort(-row, kind="stable") if row[i] > 0] if n else []
            predicted.append(model.languages[chosen[0]] if chosen else UNDETERMINED)
            scores.append(float(min(1.0, row[chosen[0]] * p)) if chosen else 0.0)
            sets.append([model.languages[i] for i in chosen])
            parts.append([float(row[i]) for i in chosen])
        return {
            "doc_id": part.column("doc_id"),
            "lang_pred": pa.array(predicted, pa.string()),
            "score": pa.array(scores, pa.float64()),
            "languages": pa.array(sets, pa.list_(pa.string())),
            "proportions": pa.array(parts, pa.list_(pa.float64())),
        }

    schema = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"
    out = map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), infer, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")
