"""Toxicity of texts by a weighted finite-state grammar over clauses.

Words become symbols: insults of three strengths, threats, targets, negations,
words of reported speech, and the parts of phrases.  Which words and word
beginnings are insults, and how strong, is learned from labelled texts.
Transducers for contractions, threats, insults, negation, reported speech,
targets and scores are composed into one machine; its best path over a clause is
the clause's score.  The threats' and insults' transducers read phrases of several
words (``you will regret``, ``piece of trash``), which come from fixed lists.  A
text's score is a logistic function of its clauses' scores, fitted to the same
labelled texts.

The labelled texts are at most ``MOST_LABELLED``, chosen by a hash of the id;
of texts alike only one is used, so that copies do not count as evidence.

Defined cases: a null, empty or wordless text has no clause and gets the score
of such texts; without labelled texts of both kinds every score is 0; repeated
rows repeat; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, running
from .labelled import held_out, sample
from .textkernel import _LETTERS, _ODD, NOT_ALNUM, U64, Words, _power_tables, gram_index, grams, mix64, signed, split_batches, unsigned, word_hash
from .transducers import Compiled, Transducer

MOST_LABELLED = 16_000
#: A unit is an insult if its share of toxic texts stands out by so many deviations and in so many texts, and by so much in log odds.
LEAST_Z, LEAST_TEXTS, LEAST_ODDS, MOST_UNITS = 6.0, 4, 1.0, 4000
#: Bytes of a word's beginning that are units besides the whole word.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3

#: Small word lists of the grammar.
THREATS = "kill murder destroy hurt beat punch shoot stab burn hang hunt töten umbringen schlagen verletzen tuer frapper détruire blesser matar golpear destruir".split()
TARGETS = "you your yours yourself he him she her they them their du dich dir dein ihr euch sie tu te toi vous votre vos il ils elles tú ti usted ustedes ellos ellas vosotros".split()
NEGATIONS = "not never isn’t aren’t don’t doesn’t can’t won’t cannot nobody nicht niemals kein keine jamais aucun nunca jamás tampoco ningún".split()
REPORTS = "said says wrote writes called claimed quoted reported allegedly sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
#: "isn't" is the words isn and t: the first parts of contracted negations, and the second.
CONTRACTED, CONTRACTION = "isn aren wasn weren don doesn didn can couldn won wouldn shouldn hasn haven hadn ain".split(), ["t"]
#: Parts of phrases that threaten: what is meant to be done, and what will come to the one addressed.
INTENTS = "will shall going gonna ll werde wirst werdet werden vais vas va allez voy vamos".split()
DOOMS = "suffer regret pay bleed sterben leiden bereuen büßen mourir souffrir regretter payer morir sufrir pagar lamentar".split()
#: German has "die" in most sentences and never "you", so that it is a doom for "you" only.
YOU, DIE = ["you"], ["die"]
#: Parts of phrases that insult: "fucking" before an insult, "piece", "of" and "trash".
STRESSES = "fucking damn damned bloody complete total absolute utter völliger totaler absoluter verdammter verdammte sale gros pauvre maldito maldita puto puta".split()
HEADS, LINKS = "piece waste load bunch pile sack stück haufen tas bande pedazo montón".split(), "of de".split()
THINGS = "shit crap trash garbage dirt filth space air oxygen dreck scheiße müll abschaum merde ordures mierda basura".split()

OTHER, TARGET, NEGATION, REPORT, CONTRACT, APOSTROPHE, INTENT, STRESS, HEAD, LINK, ADDRESSED, DEATH, DOOM, THING, THREAT, MILD, STRONG, STRONGEST = range(18)
SYMBOLS = ("o", "u", "n", "r", "c", "c'", "w", "s", "h", "l", "y", "e", "d", "x", "t", "i1", "i2", "i3")
#: What is left of them after the first three transducers.
_PLAIN = ("o", "u", "n", "r", "t", "i1", "i2", "i3")
_HITS = ("t", "i1", "i2", "i3")
_WEIGHT = {"t": 0.5, "i1": 1.0, "i2": 2.0, "i3": 3.0}
#: What a target near by adds: a word of violence is a threat by whom it is meant for, an insult is one by itself.
_AIMED = {"t": 1.0, "i1": 0.5, "i2": 0.5, "i3": 0.5}
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".!?;:,\n")] = True


def _contractions() -> Transducer:
    """The two words of a contracted negation are one negation."""
    t = Transducer()
    for state in (0, 1):
        for s in SYMBOLS:
            out = "o" if s == "c" else ("n" if state else "o") if s == "c'" else s
            t.arc(state, s, out, 0.0, int(s == "c"))
    return t


def _threats(reach: int = 3, bonus: float = 0.5) -> Transducer:
    """A threat up to ``reach`` words after an intent that is not the target's own weighs more; a doom so after a target's intent is a threat, and elsewhere nothing."""
    t = Transducer()
    states = [("", 0), *((kind, k) for kind in ("u", "y") for k in (1, 2)), *((kind, k) for kind in ("w", "uw", "yw") for k in range(1, reach + 1))]
    t.start = states[0]
    for kind, left in states:
        passed = (kind, left - 1) if left > 1 else t.start
        for s in SYMBOLS:
            if s in ("c", "c'"):
                continue
            to, out = passed, {"y": "u", "w": "o", "d": "o", "e": "o"}.get(s, s)
            if s == "w":
                to = (f"{kind[:1].replace('w', '')}w", reach)
            elif s in ("u", "y") and (kind in ("", "u", "y") or left == 1):
                to = (s, 2)
            if s == "d" and kind in ("uw", "yw") or s == "e" and kind == "yw":
                out = "t"
            t.arc((kind, left), s, out, bonus if s == "t" and kind == "w" else 0.0, to)
    return t


def _insults() -> Transducer:
    """An insult after a stressing word is one step stronger; a head, a link and a thing, or a head and a thing, are a strong insult."""
    t = Transducer()
    for state in ("", "s", "h", "hl"):
        for s in (*_PLAIN, "s", "h", "l", "x"):
            out = s if s in _PLAIN else "o"
            if state == "s" and s in ("i1", "i2"):
                out = {"i1": "i2", "i2": "i3"}[s]
            elif s == "x" and state in ("h", "hl"):
                out = "i2"
            t.arc(state, s, out, 0.0, s if s in ("s", "h") else "hl" if s == "l" and state == "h" else "")
    t.start = ""
    return t


def _negation(reach: int = 3) -> Transducer:
    """A hit up to ``reach`` words after a negation is marked as negated."""
    t = Transducer()
    for state in range(reach + 1):
        for s in _PLAIN:
            t.arc(state, s, f"{s}-" if s in _HITS and state else s, 0.0, reach if s == "n" else max(state - 1, 0))
    return t


def _reported() -> Transducer:
    """Hits after a word of reported speech are marked as reported."""
    t = Transducer()
    symbols = [*_PLAIN, *(f"{h}-" for h in _HITS)]
    for state in (0, 1):
        for s in symbols:
            t.arc(state, s, f"{s}~" if state and s[:-1] in _HITS + tuple(f"{h}" for h in _HITS) or state and s in _HITS else s, 0.0, 1 if s == "r" else state)
    return t


def _target(reach: int = 4) -> Transducer:
    """A hit up to ``reach`` words after a target, or before one, weighs more; the machine guesses the one that comes and must then meet it."""
    t = Transducer()
    hits = [h + m for h in _HITS for m in ("", "-", "~", "-~")]
    for s in [*(x for x in _PLAIN if x not in _HITS), *hits]:
        bonus = _AIMED.get(s.rstrip("-~"), 0.0)
        for state in range(reach + 1):
            t.arc(state, s, s, bonus if s in hits and state else 0.0, reach if s == "u" else max(state - 1, 0))
        if s in hits:
            t.arc(0, s, s, bonus, -reach)
        for owed in range(1, reach + 1):
            if s == "u":
                t.arc(-owed, s, s, 0.0, reach)
            elif owed > 1:
                t.arc(-owed, s, s, bonus if s in hits else 0.0, 1 - owed)
    t.open = set(range(-reach, 0))
    return t


def _scores() -> Transducer:
    """Writes nothing new: the weight of each kind of hit."""
    t = Transducer()
    for h in _HITS:
        for mark, share in (("", 1.0), ("-", 0.4), ("~", 0.6), ("-~", 0.3)):
            t.arc(0, h + mark, "hit", _WEIGHT[h] * share, 0)
    for s in _PLAIN:
        if s not in _HITS:
            t.arc(0, s, "-", 0.0, 0)
    return t


@lru_cache(maxsize=1)
def grammar() -> Compiled:
    marks = _negation().compose(_reported()).compose(_target()).compose(_scores())
    return _contractions().compose(_threats()).compose(_insults()).compose(marks).compiled()


@lru_cache(maxsize=65536)
def clause_score(symbols: bytes) -> float:
    return grammar().best([SYMBOLS[s] for s in symbols])


@lru_cache(maxsize=1)
def _fixed() -> tuple[np.ndarray, np.ndarray]:
    parts = ((CONTRACTED, CONTRACT), (CONTRACTION, APOSTROPHE), (INTENTS, INTENT), (STRESSES, STRESS), (HEADS, HEAD), (LINKS, LINK), (DOOMS, DOOM), (DIE, DEATH), (THINGS, THING))
    pairs = sorted((word_hash(w), s) for words, s in (([w for w in TARGETS if w not in YOU], TARGET), (YOU, ADDRESSED), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), *parts) for w in words)
    return np.array([h for h, _ in pairs], dtype=U64), np.array([s for _, s in pairs], dtype=np.uint8)


def units(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of whole words and of the beginnings of longer ones."""
    power, inverse = _power_tables(len(w.data))
    total = np.zeros(len(w.data) + 1, dtype=U64)
    np.cumsum(_LETTERS[True][w.data] * power[: len(w.data)], out=total[1:])
    out = [(np.arange(len(w.hash)), w.hash)]
    for n in BEGINNINGS:
        at = np.flatnonzero(w.end - w.start > n)
        h = (total[w.start[at] + n] - total[w.start[at]]) * inverse[w.start[at]]
        out.append((at, mix64(h + U64((n + 1000) * int(_ODD) % (1 << 64)))))
    return out


def _looked_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the hashes that are keys.  ``few``: which leading 16 bits any key has."""
    at = np.flatnonzero(few[(h >> U64(48)).astype(np.int64)])
    i = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    hit = keys[i] == h[at]
    return at[hit], values[i[hit]]


def _leading(keys: np.ndarray) -> np.ndarray:
    few = np.zeros(1 << 16, dtype=bool)
    few[(keys >> U64(48)).astype(np.int64)] = True
    return few


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the insults' units
    strength: np.ndarray  # their symbols
    weights: np.ndarray  # of the logistic function
    mean: np.ndarray
    scale: np.ndarray

    def features(self, w: Words) -> np.ndarray:
        """Per text: sum and largest of its clauses' scores, sum for each hundred words, clauses that match, words, whether any matches."""
        symbols = np.zeros(len(w.hash), dtype=np.uint8)
        fixed, kinds = _fixed()
        at, value = _looked_up(w.hash, fixed, kinds, _leading(fixed))
        symbols[at] = value
        if len(self.keys):
            few = _leading(self.keys)
            strong = np.zeros(len(w.hash), dtype=np.uint8)
            for words, h in units(w):
                at, value = _looked_up(h, self.keys, self.strength, few)
                np.maximum.at(strong, words[at], value)
            symbols = np.maximum(symbols, strong)
        hits = np.flatnonzero(symbols >= THREAT)
        ends = np.concatenate([hits, *(_led(symbols, *phrase) for phrase in ((DOOM, INTENT, 3), (DEATH, INTENT, 3), (THING, HEAD, 2)))])
        n = len(w)
        out = np.zeros((n, 6))
        out[:, 4] = np.log1p(w.counts)
        if not len(ends):
            return out
        clause = np.concatenate(([0], np.cumsum(_BREAK[w.data])))[w.start] * 1 + w.text_of * (len(w.data) + 1)
        bounds = np.flatnonzero(np.concatenate(([True], clause[1:] != clause[:-1], [True])))
        mine = np.unique(np.searchsorted(bounds, ends, side="right") - 1)
        text = np.searchsorted(w.first, bounds[mine], side="right") - 1
        raw = symbols.tobytes()
        scores = np.array([clause_score(raw[a:b] if b - a <= 64 else _short(raw[a:b])) for a, b in zip(bounds[mine].tolist(), bounds[mine + 1].tolist(), strict=True)])
        total = np.bincount(text, weights=scores, minlength=n)
        np.maximum.at(out[:, 1], text, scores)
        out[:, 0] = np.log1p(total)
        out[:, 2] = np.log1p(100 * total / np.maximum(w.counts, 1))
        out[:, 3] = np.log1p(np.bincount(text[scores > 0], minlength=n))
        out[:, 5] = total > 0
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _led(symbols: np.ndarray, last: int, lead: int, reach: int) -> np.ndarray:
    """Places of words that may end a phrase, as one that leads it is at most ``reach`` words before."""
    at = np.flatnonzero(symbols == last)
    before = running(symbols == lead)
    return at[before[at] > before[np.maximum(at - reach, 0)]]


def _short(symbols: bytes) -> bytes:
    """A long clause without the runs of other words beyond every reach, which score nothing."""
    a = np.frombuffer(symbols, dtype=np.uint8)
    other = np.concatenate(([0], np.cumsum(a != OTHER)))
    k = np.arange(len(a))
    near = other[np.minimum(k + 5, len(a))] - other[np.maximum(k - 5, 0)] > 0
    return a[near].tobytes()


_COUNTS = pa.schema([("unit", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each kind that hold each unit, summed over the task."""
    held: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, w in split_batches(batch.column(0), lower=True, outside=NOT_ALNUM):
            for words, h in units(w):
                text = np.searchsorted(w.first, words, side="right") - 1
                one = np.unique(mix64(h ^ mix64(text.astype(U64) + U64(1))), return_index=True)[1]
                toxic = label[a:b][text[one]] == 1
                held[0].append(h[one][~toxic])
                held[1].append(h[one][toxic])
    if any(len(h) for h in held[0] + held[1]):
        clean, toxic = (np.unique(np.concatenate(h), return_counts=True) for h in held)
        keys = np.union1d(clean[0], toxic[0])
        columns = {"unit": signed(keys)}
        for name, (k, c) in (("toxic", toxic), ("clean", clean)):
            x = np.zeros(len(keys), dtype=np.int64)
            x[np.searchsorted(keys, k)] = c
            columns[name] = x
        yield record_batch(columns, _COUNTS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three least hashes of each text's three-word runs: texts alike share one."""
    for batch in batches:
        for a, b, w in split_batches(batch.column(1), lower=True):
            at = gram_index(w.first, 3)
            g = grams(w.hash, 3)[at]
            bounds = np.searchsorted(at, w.first)
            least = np.zeros((3, b - a), dtype=np.int64)
            for k, key in enumerate((U64(0x1D8E4E27C47D124F), U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25))):
                mixed = np.append(mix64(g ^ key), U64(0))
                full = np.flatnonzero(np.diff(bounds) > 0)
                low = np.zeros(b - a, dtype=U64)
                if len(full):
                    low[full] = np.minimum.reduceat(mixed[:-1], bounds[:-1][full])
                empty = np.diff(bounds) == 0
                low[empty] = mix64(np.arange(a, b)[empty].astype(U64) ^ key)
                least[k] = low.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *(pa.array(x) for x in least)], names=[*batch.schema.names, "a", "b", "c"])


def distinct_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """The bounded sample of labelled texts, with one of each set of texts alike."""
    rows = sample(docs, labels, label, most)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_sketch, f"doc_id {kind}, text string, label int, a long, b long, c long")
    for key in "abc":
        rows = rows.groupBy(key).agg(F.min_by(F.struct("doc_id", "text", "label", *(k for k in "abc" if k != key)), "doc_id").alias("s")).select("s.doc_id", "s.text", "s.label", *(f"s.{k}" if k != key else k for k in "abc"))
    return rows.select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    from ..sources.workspace import materialise

    rows = materialise(distinct_sample(docs, labels, "toxic", most), "toxic-sample")
    of = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = of.get(1, 0), of.get(0, 0)
    nothing = Model(np.zeros(0, U64), np.zeros(0, np.uint8), np.array([-50.0, 0, 0, 0, 0, 0, 0]), np.zeros(6), np.ones(6))
    if not toxic or not clean:
        return nothing
    counts = rows.select("text", "label").mapInArrow(_count_units, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q"))
    share = toxic / (toxic + clean)
    expected = (F.col("p") + F.col("q")) * share
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("q") + 0.5) / (clean + 1))
    chosen = counts.withColumn("z", (F.col("p") - expected) / F.sqrt(expected * (1 - share))).withColumn("odds", odds)
    chosen = chosen.where((F.col("z") >= LEAST_Z) & (F.col("p") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "unit").limit(MOST_UNITS).collect()
    keys = unsigned([r["unit"] for r in chosen])
    order = np.argsort(keys)
    strength = np.array([MILD + (r["odds"] >= 2.0) + (r["odds"] >= 3.5) for r in chosen], dtype=np.uint8)[order]
    model = Model(keys[order], strength, nothing.weights, nothing.mean, nothing.scale)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in split_batches(batch.column(0), lower=True, outside=NOT_ALNUM):
                f = model.features(w)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(list(f), type=pa.list_(pa.float64()))], names=["label", "f"])

    told = rows.select("text", "label").mapInArrow(features, "label int, f array<double>").collect()  # at most ``most`` rows of six numbers
    x, y = np.array([r["f"] for r in told]), np.array([r["label"] for r in told])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(model.keys, strength, logistic((x - mean) / scale, y), mean, scale)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and score."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(doc_id, batch.schema.field(0).type), ("score", pa.float64())])
            for a, b, w in split_batches(batch.column(1), lower=True, outside=NOT_ALNUM):
                yield record_batch({doc_id: batch.column(0).slice(a, b - a), "score": model.score(model.features(w))}, schema)

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
