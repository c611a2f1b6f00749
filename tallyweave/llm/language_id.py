"""Language identification by error-correcting output codes.

Each language gets a codeword. One binary classifier for each bit reads hashed
character n-grams and predicts that bit; the language whose codeword has the least
loss, weighted by how well each bit is known to work for it, is chosen, and texts
whose two best codewords are close are flagged.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Slots that n-grams are hashed to, and the longest n-gram.
SLOTS, LONGEST = 1 << 15, 3
#: Documents that calibrate the bits, about; they are chosen by hash from all that may be learnt from.
CALIBRATION_ROWS = 20_000
#: Most languages that a model can have: what learning holds in a worker and sends to the
#: driver grows with their number (256 KB and 33,000 small rows each).
LANGUAGES = 128
#: Least lead of the best language's score over the next, else the text is ambiguous.
LEAD = 0.25
PREDICTION = "struct<lang_pred: string, score: double, second: string, ambiguous: boolean>"
_UNIT = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Slots of the n-grams of a text's lower-cased characters, 1 to ``LONGEST``
    long; anything but letters counts as one and the same character, and n-grams
    of that character alone are left out. Empty where there is no letter."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code + 1, 0).astype(np.uint32)
    parts, mixed, some = [], np.zeros(len(code), np.uint32), np.zeros(len(code), bool)
    for n in range(1, min(LONGEST, len(code)) + 1):
        last = len(code) - n + 1
        mixed = (mixed[:last] ^ code[n - 1 :]) * np.uint32(2_654_435_761)
        mixed ^= mixed >> np.uint32(15)
        some = some[:last] | letter[n - 1 :]
        parts.append(((mixed * np.uint32(2_246_822_519 + 2 * n)) >> np.uint32(17))[some])
    return np.concatenate(parts)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Codewords (language, bit) of +1 and -1. Up to seven languages: all two-way
    splits, so that any two differ in half the bits. More: of many random codes
    with 10 log2(n) bits the one whose closest two codewords differ most."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        code = -np.ones((n, len(splits)), np.int8)
        for bit, inside in enumerate(splits):
            code[list(inside), bit] = 1
        return code
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = int(((code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * 10_000).min())
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    """Languages, codewords, n-gram weights (slot, bit), the middle and half-width
    between the two sides of a bit, and how well a bit works for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    width: np.ndarray
    trust: np.ndarray

    def bits(self, text: str | None) -> np.ndarray | None:
        """Mean n-gram weight for each bit; None where there is no letter."""
        slots = grams(text)
        if not len(slots):
            return None
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(slots), 1 << 15):
            total += self.weights[slots[at : at + (1 << 15)]].sum(axis=0, dtype=np.float64)
        return total / len(slots)

    def predict(self, text: str | None) -> tuple[str, float, str | None, bool]:
        """Language, score from 0 to 1, the next language, and ambiguity."""
        found = self.bits(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0, None, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, None, False
        margin = np.clip((found - self.middle) / self.width, -2, 2)
        loss = (self.trust * np.exp(-self.code * margin)).sum(axis=1)
        chance = np.exp(4 * (loss.min() - loss))
        chance /= chance.sum()
        first, second = np.argsort(-chance, kind="stable")[:2]
        return self.languages[first], float(chance[first]), self.languages[second], bool(chance[first] - chance[second] < LEAD)


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """Per language and slot: the share of n-grams, summed over documents in units
    of 1 / ``_UNIT`` (whole numbers, so that sums do not depend on their order);
    slot -1 counts the documents."""

    def of(batches):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SLOTS, np.int64))
        n: dict[str, int] = defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots = grams(text)
                if len(slots):
                    sums[lang] += np.bincount(slots, minlength=SLOTS) * _UNIT // len(slots)
                    n[lang] += 1
        for lang, share in sums.items():
            slot = np.flatnonzero(share)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(slot) + 1), pa.string()), pa.array(np.append(slot, -1), pa.int32()), pa.array(np.append(share[slot], n[lang]), pa.int64())],
                names=["lang", "slot", "n"],
            )

    return labelled.select("lang", "text").mapInArrow(of, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learns from the columns ``text`` and ``lang`` (null: left out).

    The n-gram statistics count every row. Only (language, slot) sums reach the
    driver: at most ``SLOTS`` + 1 for each language. A bit's classifier is the log
    ratio of the two sides' mean n-gram shares, all languages of a side counting
    alike. Its middle, width and trust come from about ``calibration_rows`` rows. More than
    ``LANGUAGES`` different labels raise a ValueError. Repeated rows count as often as they
    come, other columns are ignored, and an empty table gives a model that knows nothing.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different values of lang: clean the labels before learning")
    counts = _gram_counts(rows).toArrow().to_pandas()
    whole = counts[counts["slot"] < 0].set_index("lang")["n"]
    languages = sorted(whole.index)
    code = codewords(len(languages))
    if len(languages) < 2:
        nothing = np.zeros(0)
        return Model(languages, code, np.zeros((SLOTS, 0), np.float32), nothing, nothing, np.zeros((len(languages), 0)))
    share = np.zeros((len(languages), SLOTS))
    for k, lang in enumerate(languages):
        own = counts[(counts["lang"] == lang) & (counts["slot"] >= 0)]
        share[k, own["slot"]] = own["n"] / own["n"].sum()
    floor = 0.05 / SLOTS
    sides = [np.stack([share[code[:, b] == s].mean(axis=0) for b in range(code.shape[1])], axis=1) for s in (1, -1)]
    weights = (np.log(sides[0] + floor) - np.log(sides[1] + floor)).astype(np.float32)
    draft = Model(languages, code, weights, np.zeros(code.shape[1]), np.ones(code.shape[1]), np.ones(code.shape))
    means, rights = _calibrate(rows, draft, min(1.0, calibration_rows / whole.sum()))
    high = np.where(code > 0, means, np.inf).min(axis=0)
    low = np.where(code < 0, means, -np.inf).max(axis=0)
    draft.middle, draft.width = (high + low) / 2, np.maximum((high - low) / 2, 1e-6)
    draft.trust = rights / np.maximum(rights.sum(axis=1, keepdims=True), 1e-9)
    return draft


def _calibrate(rows: DataFrame, model: Model, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Per language and bit: mean of the classifier's output, and the share of
    texts on the right side of zero, over texts chosen by their hash."""

    def of(batches):
        for batch in batches:
            outs: dict[str, list[np.ndarray]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (bits := model.bits(text)) is not None:
                    outs[lang].append(bits)
            frames = []
            for lang, found in outs.items():
                every = np.stack(found)
                right = (every * model.code[model.languages.index(lang)] > 0).sum(axis=0)
                units = np.round(every * _UNIT).astype(np.int64).sum(axis=0)
                frames.append(pd.DataFrame({"lang": lang, "bit": np.arange(every.shape[1]), "units": units, "rights": right, "n": len(every)}))
            if frames:
                yield pa.RecordBatch.from_pandas(pd.concat(frames), preserve_index=False)

    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(fraction * (1 << 20)) + 1)
    found = (
        chosen.mapInArrow(of, "lang string, bit long, units long, rights long, n long")
        .groupBy("lang", "bit")
        .agg(F.sum("units").alias("units"), F.sum("rights").alias("rights"), F.sum("n").alias("n"))
        .toArrow()
        .to_pandas()
    )
    # A language of which no text was chosen counts as lying right at its side.
    means = model.code * float(np.abs(found["units"] / found["n"]).mean() / _UNIT if len(found) else 1.0)
    rights = np.ones(model.code.shape)
    k, b = [model.languages.index(x) for x in found["lang"]], found["bit"].to_numpy()
    means[k, b] = found["units"] / found["n"] / _UNIT
    rights[k, b] = found["rights"] / found["n"]
    return means, rights


def prediction(text: Column, model: Model) -> Column:
    """``PREDICTION`` of each text: null, empty and letterless texts, and any text
    under a model without languages, give ``und`` with score 0. Texts of any length are
    read whole, equal texts give equal predictions, an empty table gives no rows."""

    @F.arrow_udf(PREDICTION)
    def of(texts: pa.Array) -> pa.Array:
        rows = [dict(zip(("lang_pred", "score", "second", "ambiguous"), model.predict(x))) for x in texts.to_pylist()]
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("second", pa.string()), ("ambiguous", pa.bool_())])
        return pa.array(rows, kind)

    return of(text)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id's text, modulo 4, is 2.
    A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train_on(docs: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """A model from the documents that are not held out."""
    return train(docs.filter(~held_out(docs["doc_id"])), calibration_rows)
