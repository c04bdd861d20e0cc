"""Toxicity: a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, quote, other). Small
transducers mark what stands under a negation, in reported speech or next to a target;
they are composed into one machine that is run over each clause that holds an insult or
a threat. A document's features are the weights of its matched clauses by reading
(plain, targeted, negated, reported), and a logistic model over these few features,
fitted with a prior that speaks for the grammar's usual reading, gives the score.

Insults are learned from labels: whole words and word beginnings whose log-odds are
high and whose support among toxic documents (near copies counted once) can't be chance.
Of a beginning and its continuation with about the same support the longer one stays. How unlikely chance must be is
chosen by folds of the training rows.
Threats, targets, negations and reports are fixed lists for four languages.

Fitting uses a bounded sample of the labelled rows (TOXIC_ROWS and CLEAN_ROWS expected
rows); everything else is applied to all rows and whole texts.

Defined results: null and empty texts have no clauses and get the model's score for
that; rows with a null or repeated id are scored like others; without labels of both
kinds the lexicon is empty and the prior weights hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Bounds of the fitting sample, in expected rows.
TOXIC_ROWS, CLEAN_ROWS = 3000, 9000
#: A feature of the lexicon has such log-odds, and its support would arise by chance with one of these probabilities at
#: most: the one that does best where FOLDS parts of the sample are scored by what is learned from the others.
LOG_ODDS, CHANCES, FOLDS = 4.0, (1e-2, 1e-3, 1e-4), 3
SAME_SUPPORT = 0.85
CANDIDATES = 20_000
PREFIXES = (3, 4, 5, 6)

# Function words of the grammar.
THREATS = "kill hurt destroy murder shoot stab beat tuer frapper töten schlagen matar golpear"
TARGETS = "you your yours u he she they them these those people vous tu ton toi du dich dein sie ihr tú usted ustedes"
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine nie nunca jamás tampoco"
REPORTS = "said says called claimed wrote quoted reported according dit écrit sagte schrieb dijo escribió"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]|[.!?;:\n]+")
APART = re.compile(r"[\W\d_]+")
CLAUSE_END = frozenset(".!?;:\n")

#: Readings of a match, and features: insults by reading, threats by reading.
PLAIN, TARGETED, NEGATED, REPORTED = range(4)
FEATURES = 8
#: Prior weights of the logistic model: bias, insults and threats by reading.
PRIOR = np.array([-3.0, 4.0, 5.0, 1.5, 2.0, 1.0, 3.0, 0.2, 0.3])
PRIOR_STRENGTH = 0.05


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, marks). Marks are a set of bits."""

    def __init__(self, step, start):
        self.start, self.arcs = start, {}
        todo = [start]
        while todo:
            s = todo.pop()
            for sym in range(7):
                to, marks = step(s, sym)
                self.arcs[s, sym] = (to, marks)
                if (to, OTHER) not in self.arcs and to not in todo:
                    todo.append(to)


def compose(*machines: Transducer) -> Transducer:
    """The machine that runs all of them at once and joins their marks."""

    def step(states, sym):
        out = [m.arcs[s, sym] for m, s in zip(machines, states, strict=True)]
        return tuple(x[0] for x in out), sum(x[1] for x in out)

    return Transducer(step, tuple(m.start for m in machines))


def _within(symbol: int, reach: int, mark: int) -> Transducer:
    """Marks insults and threats at most `reach` tokens after `symbol`."""

    def step(left, sym):
        hit = mark if left and sym in (INSULT, THREAT) else 0
        return (reach if sym == symbol else max(0, left - 1)), hit

    return Transducer(step, 0)


def _reported(mark: int) -> Transducer:
    """Marks insults and threats after a word of reporting or inside quotes."""

    def step(state, sym):
        said, quoted = state
        if sym == QUOTE:
            quoted = not quoted
        hit = mark if (said or quoted) and sym in (INSULT, THREAT) else 0
        return (said or sym == REPORT, quoted), hit

    return Transducer(step, (False, False))


FORWARD = compose(_within(NEGATION, 3, 1), _reported(2), _within(TARGET, 4, 4))
BACKWARD = _within(TARGET, 3, 4)


class Lexicon:
    """Words and word beginnings with weights, and the fixed lists."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.fixed = {w: sym for sym, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words.split()}
        self.find = ahocorasick.Automaton()
        for key in weights:
            self.find.add_word(" " + key[1:] + " " * (key[0] == "="), True)
        for w in THREATS.split():
            self.find.add_word(f" {w} ", True)
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        best = self.weights.get("=" + word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                best = max(best, self.weights.get("^" + word[:n], 0.0))
        if best > 0:
            return INSULT, best
        sym = self.fixed.get(word, OTHER)
        return sym, 1.0 if sym == THREAT else 0.0

    def features(self, text: str | None) -> np.ndarray:
        """Weights of a text's matched clauses by reading."""
        out = np.zeros(FEATURES)
        low = (text or "").lower()
        if next(self.find.iter(f" {APART.sub(' ', low)} "), None) is None:
            return out
        clause: list[tuple[int, float]] = []
        hit = False
        for token in TOKEN.findall(low):
            if token[0] in CLAUSE_END:
                if hit:
                    self._clause(clause, out)
                clause, hit = [], False
            elif token in "\"“”«»":
                clause.append((QUOTE, 0.0))
            else:
                pair = self.symbol(token)
                hit |= pair[1] > 0
                clause.append(pair)
        if hit:
            self._clause(clause, out)
        return np.minimum(out, 3.0)

    def _clause(self, clause: list[tuple[int, float]], out: np.ndarray) -> None:
        marks = [0] * len(clause)
        for machine, order in ((FORWARD, range(len(clause))), (BACKWARD, range(len(clause) - 1, -1, -1))):
            state = machine.start
            for i in order:
                state, m = machine.arcs[state, clause[i][0]]
                marks[i] |= m
        for (sym, w), m in zip(clause, marks, strict=True):
            if w > 0:
                reading = REPORTED if m & 2 else NEGATED if m & 1 else TARGETED if m & 4 else PLAIN
                out[reading + 4 * (sym == THREAT)] += min(1.0, w / LOG_ODDS)


def word_features(text: str) -> set[str]:
    """Whole words and beginnings of longer words, as keys of the lexicon."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) > 2:
            out.add("=" + w)
            out.update("^" + w[:n] for n in PREFIXES if len(w) > n)
    return out


def marks(text: str) -> list[int]:
    """Four min-hashes over 3-word shingles; near copies share one of them almost surely."""
    words = WORD.findall(text.lower())
    grams = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
    return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in range(4)]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column("h"), pa.array([marks(t) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["h", "marks"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            seen[1 if y else 0].update(word_features(t))
    keys = list(seen[0].keys() | seen[1].keys())
    for k in range(0, len(keys), 100_000):
        own = keys[k : k + 100_000]
        yield pa.record_batch([pa.array(own, pa.string()), pa.array([seen[1][x] for x in own], pa.int64()), pa.array([seen[0][x] for x in own], pa.int64())], names=["feature", "pos", "neg"])


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """text, toxic: a bounded sample of the labelled rows for which `allowed` (over doc_id) holds, one row per text."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_ROWS / max(1, n.get(1, 0)))).otherwise(min(1.0, CLEAN_ROWS / max(1, n.get(0, 0))))
    # TOXIC_ROWS + CLEAN_ROWS ids are expected here: a proven bound for the broadcast
    few = F.broadcast(labels.filter(drawn < share))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(few, "doc_id")
    return materialize(rows.groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")


def one_of_near_copies(marked: list[tuple[str, list[int]]]) -> list[str]:
    """Keys of rows that share no mark with an earlier one, in order of key."""
    seen: set[tuple[int, int]] = set()
    out = []
    for key, own in sorted(marked):
        pairs = set(enumerate(own))
        if not pairs & seen:
            out.append(key)
        seen |= pairs
    return out


def support_for(chance: float, n_pos: int, n_neg: int) -> int:
    """Toxic documents that a feature needs."""
    return max(4, math.ceil(math.log(chance) / math.log(n_pos / (n_pos + n_neg))))


def log_odds(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.1) / n_pos) - math.log((neg + 0.1) / n_neg)


def fit_lexicon(rows: DataFrame, chance: float) -> dict[str, float]:
    """Features with their log-odds from the sample (h, text, toxic)."""
    toxic = one_of_near_copies([(r["h"], r["marks"]) for r in rows.filter("toxic = 1").select("h", "text").mapInArrow(_marked, "h string, marks array<long>").collect()])
    clean = rows.filter("toxic = 0")
    n_neg = clean.count()
    if not toxic or not n_neg:
        return {}
    # at most the sample's rows (TOXIC_ROWS expected): a proven bound for the broadcast
    kept = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in toxic], "h string"))
    used = clean.unionByName(rows.filter("toxic = 1").join(kept, "h")).select("text", "toxic")
    odds = F.log((F.col("pos") + 0.1) / len(toxic)) - F.log((F.col("neg") + 0.1) / n_neg)
    counted = used.mapInArrow(_counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = counted.filter((F.col("pos") >= support_for(chance, len(toxic), n_neg)) & (odds >= LOG_ODDS)).select("feature", "pos", odds.alias("odds")).orderBy(F.desc("pos"), "feature").limit(CANDIDATES).collect()
    return specific({r["feature"]: (r["pos"], r["odds"]) for r in found})


def losses(rows: list[tuple[str, str, int]], fold: int) -> list[float]:
    """Log loss over the rows (h, text, toxic) of a fold, for each of CHANCES, of what is learned from all others."""
    mine = lambda h: int(h[:8], 16) % FOLDS == fold
    known, asked = [r for r in rows if not mine(r[0])], [r for r in rows if mine(r[0])]
    toxic = set(one_of_near_copies([(h, marks(t)) for h, t, y in known if y]))
    used = [r for r in known if not r[2] or r[0] in toxic]
    n_pos, n_neg = len(toxic), len(used) - len(toxic)
    least = [support_for(chance, n_pos, n_neg) if n_pos and n_neg else len(used) + 1 for chance in CHANCES]
    common: Counter = Counter()
    for _, t, y in used:
        if y:
            common.update(word_features(t))
    # only features that some bound lets through are counted in clean texts, of which there are many more
    common = Counter({f: k for f, k in common.items() if k >= min(least)})
    clean: Counter = Counter()
    for _, t, y in used:
        if not y:
            clean.update(word_features(t) & common.keys())
    out = []
    for needed in least:
        found = [(f, pos, log_odds(pos, clean[f], n_pos, n_neg)) for f, pos in common.items() if pos >= needed]
        found = sorted((x for x in found if x[2] >= LOG_ODDS), key=lambda x: (-x[1], x[0]))[:CANDIDATES]
        own = Lexicon(specific({f: (pos, odds) for f, pos, odds in found}))
        x = lambda some: np.array([own.features(t) for _, t, _ in some]).reshape(-1, FEATURES)  # noqa: E731, B023
        w = fit_weights(x(known), np.array([float(r[2]) for r in known]))
        p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x(asked) @ w[1:], -30, 30))), 1e-9, 1 - 1e-9)
        y = np.array([float(r[2]) for r in asked])
        out.append(float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()))
    return out


def choose_chance(rows: DataFrame) -> float:
    """The chance bound with the least loss over the folds of the sample (h, text, toxic); of equal ones the strictest.

    Each fold is a task that reads the sample, which has TOXIC_ROWS + CLEAN_ROWS expected rows whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("fold", "h", "text", "toxic")), strict=True)]
        for fold in sorted({r[0] for r in held}):
            yield pa.record_batch([pa.array(losses([r[1:] for r in held if r[0] == fold], fold), pa.float64()), pa.array(CHANCES)], names=["loss", "chance"])

    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"), "h", "text", "toxic").repartitionById(FOLDS, F.col("fold"))
    found = dealt.mapInArrow(run, "loss double, chance double").groupBy("chance").agg(F.sum("loss").alias("loss")).collect()
    return min(((r["loss"], r["chance"]) for r in found), default=(0.0, min(CHANCES)))[1]


def specific(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Without beginnings that a longer feature matches in about as many documents."""
    longest: Counter = Counter()
    for f, (pos, _) in found.items():
        for n in PREFIXES:
            short = "^" + f[1 : n + 1]
            if short != f and len(f) > n + (f[0] == "^"):
                longest[short] = max(longest[short], pos)
    return {f: odds for f, (pos, odds) in found.items() if longest[f] < SAME_SUPPORT * pos}


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a Gaussian prior around PRIOR."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    keep = np.diag(np.full(len(w), PRIOR_STRENGTH * 10))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - keep @ (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + keep
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights, learned from the labelled rows for which `allowed` holds."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, allowed)
    lexicon = fit_lexicon(rows, choose_chance(rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon)
        for b in batches:
            yield pa.record_batch([pa.array([own.features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("toxic")], names=["x", "y"])

    got = rows.select("text", "toxic").mapInArrow(features, "x array<double>, y int").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, FEATURES)
    return lexicon, fit_weights(x, np.array([float(r["y"]) for r in got]))


def score(df: DataFrame, model: tuple[dict[str, float], np.ndarray], out: str = "score", text: str = "text") -> DataFrame:
    """Adds column `out`, 0 to 1, computed from the text alone."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != out]
    df = df.select(*names)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, w = shared.value
        lexicon = Lexicon(weights)
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(text).to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(p, pa.float64())], names=[*names, out])

    return df.mapInArrow(run, schema)
