"""Language of code-switched text: a linear-chain CRF labels each word, forward-backward gives its certainty.

The model is fitted on the driver from a bounded sample of labelled texts and is a few hundred KB, so it goes to the
workers with the task. Word features are hashed; a word's scores are computed once and remembered, within a bound.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import tidy

BITS = 16
#: Letters in a chain position at most: longer runs, as of scripts without blanks, are several positions.
PIECE = 48
#: Marks that features of a kind begin with; features are hashed to the lower BITS bits.
_WORD, _FIRST, _LAST, _UNKNOWN = (zlib.crc32(x) for x in (b"w", b"p", b"s", b"w?"))
MASK = (1 << BITS) - 1
#: Bytes of text judged at a time; a longer text is judged alone.
PART_BYTES = 8_000_000
PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_switches", T.LongType())])


def core(word: str) -> str:
    """A word's letters, lower-cased; empty for a word without one."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def word_pieces(text: str | None) -> list[str]:
    """The words of a text in order; one of over PIECE letters as even pieces of its letters, none left out."""
    words = (text or "").split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    out: list[str] = []
    for word in words:
        letters = core(word) if len(word) > PIECE else ""
        count = -(-len(letters) // PIECE)
        out += [letters[i * len(letters) // count : (i + 1) * len(letters) // count] for i in range(count)] if count > 1 else [word]
    return out


def word_features(letters: str, lexicon: dict[str, int] | set[str]) -> list[int]:
    """Hashed prefixes and suffixes of 1 to 3, inner 2- and 3-grams, and the word itself if the lexicon has it."""
    raw, crc = letters.encode(), zlib.crc32
    cut = raw if len(raw) == len(letters) else letters  # where a letter is a byte, its slices needn't be encoded
    marks = [cut[:1], cut[:2], cut[:3]], [cut[-1:], cut[-2:], cut[-3:]], [cut[i : i + 2] for i in range(len(cut) - 1)] + [cut[i : i + 3] for i in range(len(cut) - 2)]
    first, last, inner = marks if cut is raw else ([x.encode() for x in m] for m in marks)
    out = [crc(raw, _WORD) if letters in lexicon else _UNKNOWN]
    out += [crc(x, _FIRST) for x in first]
    out += [crc(x, _LAST) for x in last]
    out += map(crc, inner)
    return out


class Numbers(dict):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


@dataclass
class CrfModel:
    """Label names, emission weights [feature, label], log transitions [from, to], the lexicon."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: set[str]
    entries: int = 300_000
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    used: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None, "used": 0}

    def _scores(self, cores: list[str]) -> np.ndarray:
        """Emissions exp(score) of words, scaled to a largest of 1; words without letters tell nothing."""
        out = np.ones((len(cores), len(self.labels)), dtype=np.float32)
        some = [i for i, c in enumerate(cores) if c]
        if some:
            ids = [word_features(cores[i], self.lexicon) for i in some]
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64) & MASK
            sums = np.add.reduceat(self.weights[flat], np.cumsum([0, *map(len, ids)])[:-1], axis=0)
            out[some] = np.exp(sums - sums.max(axis=1, keepdims=True))
        return out

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for distinct words."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if self.table is None or len(known) + len(fresh) > self.entries:
            known.clear()
            fresh = words
            self.table, self.used = np.ones((max(self.entries, len(fresh)), len(self.labels) + 1), dtype=np.float32), 0
        for at in range(0, len(fresh), 5_000):
            part = fresh[at : at + 5_000]
            cores = [core(w) for w in part]
            rows = slice(self.used, self.used + len(part))
            self.table[rows, :-1] = self._scores(cores)
            self.table[rows, -1] = [len(c) for c in cores]
            known.update(zip(part, range(rows.start, rows.stop), strict=True))
            self.used = rows.stop
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def forget(self) -> None:
        """Lets go of the words met; workers live on between tasks."""
        self.known, self.table, self.used = {}, None, 0

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over texts that lie one after the other, longest first, all texts in step."""
        starts = np.cumsum(lengths) - lengths
        move = np.exp(self.transitions).astype(np.float32)
        count, longest = len(lengths), int(lengths[0]) if len(lengths) else 0
        alpha = np.empty_like(emissions)
        live_at = np.searchsorted(-lengths, -np.arange(longest + 1), side="left").tolist()  # texts longer than t
        for t in range(longest):
            n = live_at[t]
            at = starts[:n] + t
            now = emissions[at] if t == 0 else (alpha[at - 1] @ move) * emissions[at]
            alpha[at] = now / now.sum(axis=1, keepdims=True)
        beta = np.ones((count, emissions.shape[1]), dtype=np.float32)
        for t in range(longest - 1, 0, -1):
            n = live_at[t]
            at = starts[:n] + t
            ahead = emissions[at] * beta[:n]
            alpha[at] *= beta[:n]
            back = ahead @ move.T
            beta[:n] = back / back.sum(axis=1, keepdims=True)
        at = starts[: live_at[0]] if longest else starts[:0]
        alpha[at] *= beta[: len(at)]
        alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), np.float32(1e-30))
        return alpha

    def predict(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label (-1: no letter), its share of the letters and the changes of label, for each list of words.

        Texts are taken one by one and only their words' numbers kept, 4 bytes a word, until all or ``entries`` distinct
        words are met; so a text's list of words may be made when it is asked for and needn't outlive it.
        """
        judged, numbers, met = [], [], Numbers()
        for words in texts:
            numbers.append(np.fromiter(map(met.__getitem__, words), dtype=np.int32, count=len(words)))
            if len(met) > self.entries:
                judged.append(self._judge(numbers, self.look_up(list(met))))
                numbers, met = [], Numbers()
        judged.append(self._judge(numbers, self.look_up(list(met))))
        best, share, switches = (np.concatenate(x) for x in zip(*judged, strict=True))
        return best, share, switches

    def _judge(self, texts: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """predict() for texts as numbers of their words; ``place`` has the row of ``table`` for each number."""
        n = len(texts)
        best, share, switches = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=np.int64)
        sizes = np.asarray([len(w) for w in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        ends = np.cumsum(sizes[order]) // 400_000
        for part in np.split(order, np.flatnonzero(np.diff(ends)) + 1) if len(order) else []:
            rows = place[np.concatenate([texts[i] for i in part])]
            lengths = sizes[part]
            letters = self.table[rows, -1]
            p = self.marginals(self.table[rows, :-1], lengths)
            starts = np.cumsum(lengths) - lengths
            weighted = p.astype(np.float64)
            weighted *= letters[:, None]
            sums = np.add.reduceat(weighted, starts, axis=0)
            total = np.add.reduceat(letters.astype(np.float64), starts)
            top = p.argmax(axis=1)
            change = np.concatenate([[0], top[1:] != top[:-1]])
            change[starts] = 0
            has = total > 0
            best[part[has]] = sums[has].argmax(axis=1)
            share[part[has]] = sums[has].max(axis=1) / total[has]
            switches[part] = np.add.reduceat(change, starts)
        return best, np.clip(share, 0, 1), switches


def fit_crf(samples: list[tuple[str, str]], *, length: int = 64, epochs: int = 3, batch: int = 32, rate: float = 0.3, seed: int = 7) -> CrfModel:
    """Adagrad on the log-likelihood of label sequences.

    Training sequences are made of stretches of the samples' words, two to forty words of one text after another of
    any language, so that the transitions learn how rare a change of language is.
    """
    labels = sorted({lang for _, lang in samples})
    number = {lang: i for i, lang in enumerate(labels)}
    stretches, seen = [], Counter()
    rng = np.random.default_rng(seed)
    for text, lang in samples:
        cores = [c for c in map(core, word_pieces(text)) if c]
        seen.update(set(cores))
        at = 0
        while at < len(cores):
            step = int(rng.integers(2, 41))
            stretches.append((cores[at : at + step], number[lang]))
            at += step
    lexicon = {w for w, n in seen.items() if n > 1}
    rng.shuffle(stretches)
    words = [w for part, _ in stretches for w in part]
    tags = np.asarray([tag for part, tag in stretches for _ in part], dtype=np.int64)
    count, k = len(words) // length, len(labels)
    weights, move = np.zeros((1 << BITS, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32)
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(move, 1e-2)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = [np.asarray(word_features(w, lexicon), dtype=np.int64) & MASK for w in distinct]
    order = np.asarray([distinct[w] for w in words], dtype=np.int64)
    for _ in range(epochs if count else 0):
        mixed = rng.permutation(count)
        for at in range(0, count, batch):
            part = mixed[at : at + batch]
            positions = (part[:, None] * length + np.arange(length)).ravel()
            feats = [ids[i] for i in order[positions]]
            flat, spans = np.concatenate(feats), np.cumsum([0, *map(len, feats)])
            scores = np.add.reduceat(weights[flat], spans[:-1], axis=0).reshape(len(part), length, k)
            e = np.exp(scores - scores.max(axis=2, keepdims=True)) + np.float32(1e-20)
            gold = tags[positions].reshape(len(part), length)
            m = np.exp(move)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for t in range(length):
                now = e[:, t] if t == 0 else (alpha[:, t - 1] @ m) * e[:, t]
                alpha[:, t] = now / now.sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                back = (e[:, t + 1] * beta[:, t + 1]) @ m.T
                beta[:, t] = back / back.sum(axis=1, keepdims=True)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            pairs = alpha[:, :-1, :, None] * m * (e * beta)[:, 1:, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            grad_m = -pairs.sum(axis=(0, 1))
            np.add.at(grad_m, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            error = -p.reshape(-1, k)
            error[np.arange(len(error)), gold.ravel()] += 1
            touched, where = np.unique(flat, return_inverse=True)
            by_feature = np.repeat(error, np.diff(spans), axis=0)
            grad = np.stack([np.bincount(where, by_feature[:, j], len(touched)) for j in range(k)], axis=1).astype(np.float32)
            seen_w[touched] += grad**2
            weights[touched] += rate * grad / np.sqrt(seen_w[touched])
            seen_m += grad_m**2
            move += rate * grad_m / np.sqrt(seen_m)
    return CrfModel(labels, weights, move, lexicon)


def train_language_model(docs: DataFrame, learn_from: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250, sample_chars: int = 4000) -> CrfModel:
    """Fit on about ``per_language`` texts of each language, drawn by a hash; of each its first ``sample_chars``.

    Only rows with ``learn_from`` true and a language and text are read; the driver holds
    languages * per_language * sample_chars characters.
    """
    rows = docs.where(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return CrfModel([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32), set())
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = F.pmod(F.xxhash64(F.col(doc_id), F.length(text)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(drawn < F.element_at(chance, F.col(lang))).select(F.substring(text, 1, sample_chars), F.col(lang)).collect()
    return fit_crf(sorted((r[0], r[1]) for r in sample))


def predict_language(docs: DataFrame, model: CrfModel, *, doc_id: str = "doc_id", text: str = "text", keep_rows: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_switches for every row, from its whole text alone.

    A text's language is the one with most of its letters, by the words' marginal probabilities; score is its share.
    All letters count; words of over PIECE letters are several positions, so a run without blanks can change language.
    ``und`` and 0 for null and letterless texts, and for all texts if nothing was learned. Repeated rows and null ids
    pass through; other columns are not read; an empty table gives no rows. ``keep_rows`` gives the
    whole row as a struct, ``row``, in place of doc_id. No shuffle.
    """
    # a kept row has its text inside, which needn't come twice
    rows = docs.select(F.struct("*").alias("row")) if keep_rows else docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    place = docs.columns.index(text) if keep_rows else None
    schema = T.StructType([rows.schema.fields[0], *PREDICTED.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.asarray([*model.labels, "und"], dtype=object)
        for batch in batches:
            column = batch.column(1) if place is None else batch.column(0).field(place)
            ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy()) // PART_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, end - at)
                if model.labels:
                    texts = (word_pieces(t.as_py()) for t in column.slice(at, end - at))
                    best, share, switches = model.predict(texts)
                else:
                    best, share, switches = np.full(end - at, -1), np.zeros(end - at), np.zeros(end - at, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(share), pa.array(switches)], names=schema.names)
        model.forget()

    return rows.mapInArrow(tidy(run), schema)
