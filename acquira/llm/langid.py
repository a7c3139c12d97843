"""Language identification by error-correcting output codes over byte trigrams."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.llm.shared import column_bytes

DIMENSIONS = 1 << 13
#: Tasks that add up the counts, so rows that reach the driver: this many for each language.
MERGERS = 4
#: Two languages' losses closer than this share of the better one's make a prediction ambiguous.
AMBIGUOUS = 0.05
#: Classifiers for each doubling of the number of languages.
BITS = 20
SLICE = 1 << 19
#: Rows that are predicted at a time.
ROWS = 1000

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def codewords(n: int, seed: int = 7, draws: int = 200) -> np.ndarray:
    """n rows of +1 and -1, one column for each binary classifier: splits of the languages into two, drawn without repeats.

    BITS for each doubling of the languages are drawn, or all splits if there are fewer; of several draws, the one whose nearest
    two codewords are furthest apart is taken.
    """
    if n <= 1:
        return np.ones((n, 0))
    splits, bits = (1 << (n - 1)) - 1, BITS * max(1, (n - 1).bit_length())
    rng, best, best_least = random.Random(seed), None, -1
    for _ in range(draws if bits < splits else 1):
        chosen = set(range(1, splits + 1)) if bits >= splits else set()
        while len(chosen) < min(bits, splits):
            chosen.add(rng.randint(1, splits))
        columns = sorted(chosen)
        m = np.array([[1.0] * len(columns), *([-1.0 if c >> i & 1 else 1.0 for c in columns] for i in range(n - 1))])
        apart = (m.shape[1] - m @ m.T) / 2 + np.diag(np.full(n, np.inf))
        if (least := apart.min()) > best_least:
            best, best_least = m, least
    return best


def trigrams(raw: np.ndarray, offsets: np.ndarray):
    """For slices of rows: first row, row after the last, the trigrams' feature numbers and each row's first place among them.

    Letters are lower-cased, other ASCII counts as a space, and each row has a space before and after it. A trigram without a
    letter in the middle has the number DIMENSIONS.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1))
        size = np.diff(offsets[row:end + 1])
        at = np.concatenate([[0], np.cumsum(size + 2)])
        b = np.full(int(at[-1]), 0x20, np.uint8)
        part = raw[int(offsets[row]):int(offsets[end])]
        place = np.arange(len(part)) + np.repeat(2 * np.arange(end - row) + 1, size)
        b[place] = _LETTER[part]
        capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
        b[capital] += 0x20
        h = b.astype(np.uint32)
        g = np.full(len(b), DIMENSIONS, np.int64)  # at the middle byte
        v = (h[:-2] * np.uint32(2654435761) ^ h[1:-1] * np.uint32(2246822519) ^ h[2:] * np.uint32(3266489917))
        g[1:-1] = np.where(b[1:-1] == 0x20, DIMENSIONS, (v >> np.uint32(9)) % np.uint32(DIMENSIONS))
        yield row, end, g, at[:-1]
        row = end


@dataclass
class Model:
    """languages, their codewords, each classifier's weights (one row more, of zeros), scale of its margins, and loss weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        """Each classifier's weights are smoothed log odds of the trigrams of its two halves, languages counting alike.

        A classifier is trusted for a language by the share of that language's trigrams whose weight has the right sign.
        """
        languages = sorted(counts)
        p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * DIMENSIONS) for x in languages]).reshape(len(languages), DIMENSIONS)
        code = codewords(len(languages))
        half = lambda sign: np.stack([p[code[:, j] == sign].mean(0) for j in range(code.shape[1])], 1) if code.shape[1] else np.zeros((DIMENSIONS, 0))
        w = np.log(half(1) / half(-1))
        scale = np.abs(p @ w).mean(0) if languages else np.ones(0)
        right = np.stack([(p[i][:, None] * (np.sign(w) == code[i])).sum(0) for i in range(len(languages))]) if languages else np.zeros((0, 0))
        return cls(languages, code, np.vstack([w, np.zeros((1, w.shape[1]))]), np.where(scale > 0, scale, 1), right / np.maximum(right.sum(1, keepdims=True), 1e-12))

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword by weighted exponential loss, its share of the likelihood, and whether the next is about as near."""
        best, score, unsure = [], [], []
        if len(self.languages) == 1:
            n = len(offsets) - 1
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        for _, _, g, at in trigrams(raw, offsets):
            total = np.add.reduceat(self.weights[g], at, axis=0)
            n = np.add.reduceat((g < DIMENSIONS).astype(np.int64), at)
            z = np.clip(total / np.maximum(n, 1)[:, None] / self.scale, -8, 8)
            loss = np.stack([(self.trust[i] * np.exp(-self.code[i] * z)).sum(1) for i in range(len(self.languages))], 1)
            order = np.sort(loss, 1)
            share = np.exp(-(loss - order[:, :1]) * 4)
            best.append(loss.argmin(1))
            score.append(1 / share.sum(1))
            unsure.append((order[:, 1] - order[:, 0]) <= AMBIGUOUS * order[:, 0])
        if not best:
            return np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
        return np.concatenate(best), np.concatenate(score), np.concatenate(unsure)


def learn(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows with text and language; no rows make one without languages."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def emit(counts):
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            raw, offsets = column_bytes(batch.column(1))
            for name in names:
                seen.setdefault(name, np.zeros(DIMENSIONS, np.int64))
            for row, end, g, at in trigrams(raw, offsets):
                owner = np.repeat(number[row:end], np.diff(np.append(at, len(g))))
                c = np.bincount(owner * (DIMENSIONS + 1) + g, minlength=len(names) * (DIMENSIONS + 1)).reshape(len(names), -1)
                for i, name in enumerate(names):
                    seen[name] += c[i, :DIMENSIONS]
        yield from emit(seen)

    def merge(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang] = seen.get(lang, 0) + np.frombuffer(c, np.int64)
        yield from emit(seen)

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(count, schema).repartition(MERGERS).mapInArrow(merge, schema).collect()
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    return Model.of_counts({k: v for k, v in total.items() if v.sum() > 0})


def identify(df: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of df and lang_pred, score, ambiguous; learned from the rows for which ``train`` holds.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no row could be learned from. Predictions
    use the text alone. Columns of df that have one of the three names give way; repeated rows and null ids stay.
    """
    model = learn(df.where(train), text_col=text_col, lang_col=lang_col)
    df = df.drop("lang_pred", "score", "ambiguous")
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    column = df.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, max(b.num_rows, 1), ROWS)):
            texts = batch.column(column)
            raw, offsets = column_bytes(texts)
            kinds = np.zeros(256, bool)
            kinds[65:91] = kinds[97:123] = True
            seen = np.concatenate([[0], np.cumsum(kinds[raw])])
            letters = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
            if m.languages:
                best, score, unsure = m.predict(raw, offsets)
            else:
                letters[:] = False
                best, score, unsure = np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters), bool)
            pred = [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(unsure & letters)], schema.names)

    return df.mapInArrow(run, schema)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))
