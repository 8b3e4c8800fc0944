"""Toxicity by a weighted finite-state pattern grammar.

A lexicon of insulting words and word beginnings is learned from labelled rows; threats, targets, negations and reported
speech are word lists. Words become symbols with the lexicon's weights, and transducers rewrite a clause's symbols: target
marks insults and threats that are addressed, negation those within three words after a negation, reported speech those
after a verb of saying, colons included, and insult and threat turn marked words into matches of a kind. An addressee may
follow, and so may a verb of saying after a comma or closing mark, so these two read the clause from its end as well. Each arc has a weight, which adds to the word's; the arcs of matches get theirs
from how often the kind stands in toxic documents. The transducers are composed once, into a table. A logistic regression
over the best and total weights of matches, by kind, turns them into a score.

Training reads a sample of at most SAMPLE_ROWS labelled rows, chosen by a hash of the id; everything is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import forget, release
from docspark.llm.staging import stage, table

SAMPLE_ROWS = 20_000
BROADCAST_GRAMS = 500_000
MIN_DOCS = 3
MIN_WEIGHT = 2.5
CACHE_BYTES = 12 << 20  # of words whose symbols a task keeps
SLICE_ROWS = 512  # texts held as Python strings at once
SHORTEST, LONGEST = 3, 8  # word beginnings
SCOPE = 3

# fixed values: words of each class, English, German, French and Spanish
THREATS = """
kill kills killed killing murder murders murdered murdering hurt hurts hurting harm harms harming strangle strangling choke choking shoot
shooting stab stabbing beat beating punch punching smash smashing crush crushing destroy destroying burn burning hang hanging drown
drowning poison slaughter butcher attack attacking hunt hunting bury behead execute die dies torture maim
töten tötet tötest umbringen umbringe ermorden erschießen erschieße erschlagen erstechen erwürgen schlagen schlage verprügeln vernichten
zerstören verletzen verbrennen vergiften sterben stirb stirbst krepieren
tuer tue tuerai tuerons tués assassiner égorger étrangler frapper frapperai abattre détruire écraser brûler crever crève mourir pendre blesser massacrer
matar mataré mataremos mato asesinar estrangular apuñalar disparar golpear golpearé pegar destruir aplastar quemar ahogar morir muere herir degollar
""".split()
TARGETS = """
you your yours yourself yourselves u ur ya thou thee y'all you're you'll you've you'd
du dich dir dein deine deinen deinem deiner deines ihr euch euer eure euren eurem
tu toi te ton ta tes tien tienne vous votre vos vôtre t'es
tú ti contigo tuyo tuya tus usted ustedes vosotros vosotras vos os vuestro vuestra su sus eres sois
""".split()
NEGATIONS = """
not no never none neither nor nobody nothing hardly cannot can't don't doesn't didn't isn't aren't wasn't weren't won't wouldn't shouldn't couldn't ain't without
nicht nichts kein keine keinen keinem keiner keines nie niemals niemand weder ohne
ne pas jamais aucun aucune rien personne ni sans point guère
nunca jamás tampoco nada nadie ningún ninguno ninguna sin
""".split()
REPORTED = """
said says say saying told tells tell quoted quote quotes allegedly reported reportedly reports claims claimed called stated states wrote writes according shouted
sagte sagt sagten gesagt behauptet behauptete zitiert zitierte angeblich laut schrieb schreibt berichtet nannte genannt erklärte meinte
dit disait disent déclaré déclare affirme affirmé prétend cité citait selon écrit écrivait raconte traité
dijo dice dicen dicho decía según citó cita afirma afirmó declaró escribió supuestamente cuenta contó llamó
""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA = range(7)  # a comma or closing mark is a symbol after its word
ADDRESSED, NEGATED, QUOTED = 8, 16, 32  # marks that are added to an insult or threat
MATCH = 64  # and the symbols of matches, by kind
KINDS = ("plain", "targeted", "negated", "reported", "threat")
_EDGE = re.compile(r"^\W+|\W+$")
_CLAUSE_END = ".!?;"
_COMMA = re.compile(r"[,\"'“”’»«‹›]$")

Step = Callable[[int, int], tuple[int, int, float]]  # (state, symbol) -> (state, symbol, weight)


def _is_hit(symbol: int) -> bool:
    return symbol < MATCH and symbol & 7 in (INSULT, THREAT)


def target(state: int, symbol: int) -> tuple[int, int, float]:
    return int(state or symbol == TARGET), symbol | ADDRESSED if state and _is_hit(symbol) else symbol, 0.0


def negation(state: int, symbol: int) -> tuple[int, int, float]:
    return SCOPE if symbol == NEGATION else state if symbol == COMMA else max(0, state - 1), symbol | NEGATED if state and _is_hit(symbol) else symbol, 0.0


def reported(state: int, symbol: int) -> tuple[int, int, float]:
    return int(state or symbol == REPORT), symbol | QUOTED if state and _is_hit(symbol) else symbol, 0.0


def reported_after(state: int, symbol: int) -> tuple[int, int, float]:
    """From a clause's end: what stands before a verb of saying is reported, if a comma or closing mark parts them."""
    state = 2 if state == 2 or (state == 1 and symbol == COMMA) else int(state == 1 or symbol == REPORT)
    return state, symbol | QUOTED if state == 2 and _is_hit(symbol) else symbol, 0.0


def insult(weights: tuple[float, ...]) -> Step:
    """Insults become matches, by their marks."""

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        if symbol >= MATCH or symbol & 7 != INSULT:
            return 0, symbol, 0.0
        kind = KINDS.index("reported" if symbol & QUOTED else "negated" if symbol & NEGATED else "targeted" if symbol & ADDRESSED else "plain")
        return 0, MATCH + kind, weights[kind]

    return step


def threat(weights: tuple[float, ...]) -> Step:
    """Threats that are addressed, and neither negated nor reported, become matches."""
    kind = KINDS.index("threat")

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        if symbol >= MATCH or symbol & 7 != THREAT:
            return 0, symbol, 0.0
        return (0, MATCH + kind, weights[kind]) if symbol & (ADDRESSED | NEGATED | QUOTED) == ADDRESSED else (0, OTHER, 0.0)

    return step


def compose(steps: list[Step], symbols: Iterable[int]) -> list[dict[int, tuple[int, int, float]]]:
    """The cascade of transducers, each reading what the one before it writes, as one: for each of its states, from the
    start on, symbol -> (state, symbol, weight)."""
    symbols = list(symbols)
    number, arcs, start = {(0,) * len(steps): 0}, [], [(0,) * len(steps)]
    for states in start:
        arcs.append({})
        for symbol in symbols:
            read, weight, after = symbol, 0.0, []
            for step, state in zip(steps, states, strict=True):
                state, read, w = step(state, read)
                after.append(state)
                weight += w
            if tuple(after) not in number:
                number[tuple(after)] = len(number)
                start.append(tuple(after))
            arcs[-1][symbol] = number[tuple(after)], read, weight
    return arcs


def run(arcs: list[dict[int, tuple[int, int, float]]], symbols: list[int], weights: list[float]) -> tuple[list[int], list[float]]:
    state, read, total = 0, [], []
    for symbol, weight in zip(symbols, weights, strict=True):
        state, symbol, w = arcs[state][symbol]
        read.append(symbol)
        total.append(weight + w)
    return read, total


def _bare(word: str) -> str:
    return word if word.isalpha() else _EDGE.sub("", word)


def _beginnings(word: str) -> list[str]:
    """What the lexicon may hold of a word: its beginnings, and itself marked as whole."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"] * (len(word) > 1)


_NO = (OTHER, 1.0)


class Grammar:
    """The learned lexicon with the word lists, and the composed transducers with their weights: one that reads clauses
    from their end, and one from their beginning."""

    def __init__(self, lexicon: dict[str, float], weights: tuple[float, ...] = (0.0,) * len(KINDS)):
        self.lexicon, self.weights = lexicon, weights
        self.fixed = {w: k for k, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTED)) for w in words}
        self.backward = compose([target, reported_after], range(7))
        read = [hit | marks for hit in (INSULT, THREAT) for marks in (ADDRESSED, QUOTED, ADDRESSED | QUOTED)]
        self.forward = compose([target, negation, reported, insult(weights), threat(weights)], [*range(7), *read])
        self.known: dict[str, tuple[int, float]] = {}
        self.size = 0

    def fresh(self) -> Grammar:
        """The same for a task, whose words go with it."""
        return Grammar(self.lexicon, self.weights)

    def classify(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            self.size += len(word) + 120
            if self.size > CACHE_BYTES:
                self.known.clear()
                self.size = len(word) + 120
            bare = _bare(word)
            kind, weight = self.fixed.get(bare, OTHER), 1.0
            if kind == OTHER:
                found = max((self.lexicon.get(x, 0.0) for x in _beginnings(bare)), default=0.0)
                kind, weight = (INSULT, found) if found else _NO
            got = (kind, weight) if kind else _NO
            if len(word) <= 64:
                self.known[word] = got
        return got

    @staticmethod
    def _closed(words: list[str], classes: list[tuple[int, float]], at: int) -> bool:
        """Whether a colon ends a clause: not after a verb of saying, whose speech it opens."""
        if words[at][-1] != ":":
            return False
        while classes[at][0] != REPORT:
            at -= 1
            if at < 0 or words[at][-1] in _CLAUSE_END:
                return True
        return False

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(kind, weight) of every match in the clauses of a text."""
        words = text.lower().replace("\n", " . ").split()
        classes = [self.classify(w) for w in words]
        hits = [i for i, c in enumerate(classes) if c[0] in (INSULT, THREAT)]
        found, done = [], -1
        for i in hits:
            if i <= done:
                continue
            start = i
            while start > 0 and words[start - 1][-1] not in _CLAUSE_END and not self._closed(words, classes, start - 1):
                start -= 1
            end = i
            while end < len(words) - 1 and words[end][-1] not in _CLAUSE_END and not self._closed(words, classes, end):
                end += 1
            part = [x for k in range(start, end + 1) for x in ([classes[k], (COMMA, 1.0)] if _COMMA.search(words[k]) else [classes[k]])]
            symbols, weights = zip(*part, strict=True)
            symbols, weights = run(self.backward, symbols[::-1], weights[::-1])
            symbols, weights = run(self.forward, symbols[::-1], weights[::-1])
            found += [(s - MATCH, w) for s, w in zip(symbols, weights, strict=True) if s >= MATCH]
            done = end
        return found

    def features(self, text: str) -> list[float]:
        best, total = [0.0] * len(KINDS), [0.0] * len(KINDS)
        for kind, weight in self.matches(text):
            best[kind] = max(best[kind], weight)
            total[kind] += max(weight, 0.0)
        return best + [math.log1p(x) for x in total] + [max(best)]


def _fold_of(ids: Column) -> Column:
    return F.crc32(ids.cast("string")) % 5


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """Labelled rows outside the held-out fold, at most about `rows` of them, by a hash of the id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(_fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / n) if n else 0.0
    return known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))


def _slices(batches):
    forget()
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _counted(only):
    """How many documents hold each word beginning (of those in `only`, if given)."""

    def count(batches):
        for part in _slices(batches):
            found = Counter()
            for text in part["text"].to_pylist():
                grams = {g for w in set((text or "").lower().split()) for g in _beginnings(_bare(w))}
                found.update(grams if only is None else grams & only.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    return count


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Word beginnings that toxic documents hold much more often, with their log odds. Counts stay in Spark; what comes to
    the driver is strong ones alone, of a bounded sample."""
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    counts = lambda toxic, only: train.where(f"toxic = {toxic}").select("text").mapInArrow(_counted(only), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    bad = stage(counts(1, None).where(F.col("n") >= MIN_DOCS))
    only = None
    if bad.count() <= BROADCAST_GRAMS:  # clean documents then send these alone
        only = train.sparkSession.sparkContext.broadcast(frozenset(r["gram"] for r in bad.toLocalIterator()))
    good = counts(0, only).withColumnRenamed("n", "m")
    n, m = F.col("n") + 0.5, F.coalesce("m", F.lit(0)) + 0.5
    # the lower end of the log odds: a few documents alone prove little
    odds = F.log(n / (size.get(1, 0) + 1)) - F.log(m / (size.get(0, 0) + 1)) - F.sqrt(1 / n + 1 / m)
    strong = bad.join(good, "gram", "left").select("gram", odds.alias("weight")).where(F.col("weight") >= MIN_WEIGHT)
    return {r["gram"]: r["weight"] for r in strong.toLocalIterator()}


def _featured(grammar):
    def features(batches):
        own = grammar.value.fresh()
        for part in _slices(batches):
            x = [own.features(t or "") for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return features


def _arc_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """For each kind, the log odds of a document with such a match being toxic, against all."""
    seen = x[:, : len(KINDS)] > 0
    odds = lambda rows: math.log((y[rows].sum() + 0.5) / ((1 - y[rows]).sum() + 0.5))
    return tuple(odds(seen[:, k]) - odds(np.ones(len(y), bool)) if seen[:, k].any() else 0.0 for k in range(len(KINDS)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Grammar, np.ndarray]:
    """The grammar and the weights of the regression. Without rows of both labels, every score is the share of toxic
    ones, or 0 without any."""
    sample = F.broadcast(_sample(labels, rows))  # `rows` rows at most
    joined = docs.join(sample, "doc_id").select("doc_id", "text", "toxic")
    grammar = Grammar(learn_lexicon(joined))

    def measured(g: Grammar) -> tuple[np.ndarray, np.ndarray]:
        sent = docs.sparkSession.sparkContext.broadcast(g)
        got = joined.select("text", "toxic").mapInArrow(_featured(sent), "toxic int, x array<double>").toArrow()  # short rows
        return np.array(got["x"].to_pylist(), float).reshape(len(got), len(g.features(""))), got["toxic"].to_numpy().astype(float)

    x, y = measured(grammar)
    if not len(y):
        return grammar, np.append(np.zeros(len(grammar.features(""))), -30.0)
    weighted = Grammar(grammar.lexicon, _arc_weights(x, y))
    return weighted, _fit(*measured(weighted))


def _scorer(model):
    """Scores of texts; what it keeps of words goes with the task."""
    grammar, w = model.value[0].fresh(), model.value[1]

    def scores(texts: pa.Array) -> np.ndarray:
        x = np.array([grammar.features(t or "") for t in texts.to_pylist()]).reshape(len(texts), len(w) - 1)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

    return scores


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    held_out tells whether crc32 of the id, as text, is divisible by 5; such rows teach nothing. Scores depend on the text
    alone, all of it however long: a null or empty one has no matches and gets the intercept's score. Rows without an id
    are scored with a null held_out; repeated rows are scored each. Labels may be missing or null; a document with several
    is toxic if one says so. Other columns are ignored."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def score(batches):
        scores = _scorer(model)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores(part["text"]))], names=["doc_id", "score"])
        del scores
        release()

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (_fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below 0.5, with their own columns, in one pass over them."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels, rows))

    def keep(batches):
        scores = _scorer(model)
        for part in _slices(batches):
            yield part.filter(pa.array(scores(part[text_col]) < 0.5))
        del scores
        release()

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
