"""Toxicity by a weighted finite-state grammar of clauses.

Four small transducers read a clause's word classes and rewrite them: reported speech
marks what someone else is said to have said, negation marks what follows within a few
words, the target transducer marks what is aimed at a person named just before, and the
threat transducer lets a violent verb through only where a target follows. They are
composed into one table of states and classes, so a clause is one walk through it. What
comes out is a match with its reading (aimed, plain, negated, reported, threat), never
a word by itself; its weight is the word's times what its reading has earned.

The insult class is an acceptor of words and word beginnings with weights: a log ratio
of how often labelled documents of either kind hold them. It is learned, as are the
weights of the readings, so that words of any language enter it by their labels alone.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import need, worker_cache
from verbascope.session import materialise

MAX_ROWS = 20_000
MAX_STEMS = 4_096
LENGTHS = (3, 4, 5, 6, 7)  # of word beginnings that may be learned; whole words of any length may be
READINGS = ("plain", "aimed", "negated", "reported", "threat")
# What the readings are worth where no label says otherwise.
WORTH = {"plain": 1.0, "aimed": 1.3, "negated": 0.4, "reported": 0.4, "threat": 1.5}
THREAT_WEIGHT = 3.0

# Word classes of the grammar, in the languages at hand.
TARGETS = "you your yours yourself u ur he him his she her hers they them their those these people du dich dir ihr euch sie tu te toi vous votre ton ta usted ustedes tú vosotros ellos"
NEGATIONS = "not no never none nobody isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine nie ne pas jamais aucun ni nunca jamás ningún ninguna"
REPORTS = "said says say told tells wrote writes called calls quoted reported claimed stated according allegedly sagte schrieb nannte laut dit disait écrit selon dijo dice escribió llamó según"
THREATS = "kill kills murder hurt destroy punish beat stab shoot crush attack töte töten umbringen tuer frapper détruire matar golpear destruir"

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.,;:!?\n\"“”«»„]")
OPENING, CLOSING, EITHER, MARKS = "“«„", "”»", '"', ".,;:!?\n"
CLASSES = ("word", "insult", "threat", "target", "negation", "report", "open", "close", "quote", "mark", "end", "line")
FIRST_BOUND = CLASSES.index("open")  # this class and those after it bound clauses


@dataclass
class Transducer:
    """Steps (state, symbol) -> (state, symbol); a symbol without a step passes and keeps the state."""

    start: object
    steps: dict

    def step(self, state, symbol):
        return self.steps.get((state, symbol), (state, symbol))


def compose(first: Transducer, then: Transducer, symbols: Iterable) -> Transducer:
    """One transducer that does what the two do in turn, over the states that can be reached."""
    steps, seen, todo = {}, {(first.start, then.start)}, [(first.start, then.start)]
    symbols = list(symbols)
    while todo:
        a, b = todo.pop()
        for s in symbols:
            a2, middle = first.step(a, s)
            b2, out = then.step(b, middle)
            steps[(a, b), s] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer((first.start, then.start), steps)


def reported_speech() -> Transducer:
    """After a verb of saying to the end of the sentence, and inside quotation marks to their close or the line's end."""
    steps = {}
    for state in ("own", "said", "quoted"):
        inside = state != "own"
        for hit in ("insult", "threat"):
            steps[state, hit] = (state, f"{hit}/reported" if inside else hit)
        steps[state, "report"] = ("quoted" if state == "quoted" else "said", "word")
        steps[state, "open"] = ("quoted", "mark")
        steps[state, "close"] = ("own", "mark")
        steps[state, "quote"] = ("own" if state == "quoted" else "quoted", "mark")
        steps[state, "end"] = ("quoted" if state == "quoted" else "own", "end")
        steps[state, "line"] = ("own", "end")
    return Transducer("own", steps)


def negation(reach: int = 3) -> Transducer:
    """A negation holds for the next few words of its clause."""
    steps = {}
    for left in range(reach + 1):
        after = max(0, left - 1)
        for symbol in ("word", "target", "threat/reported", "insult/reported"):
            steps[left, symbol] = (after, symbol)
        for hit in ("insult", "threat"):
            steps[left, hit] = (after, f"{hit}/negated" if left else hit)
        steps[left, "negation"] = (reach, "word")
        steps[left, "mark"] = steps[left, "end"] = (0, "mark")
    return Transducer(0, steps)


def aiming(reach: int = 4) -> Transducer:
    """An insult is aimed if a target stands within the few words before it in its clause."""
    steps = {}
    for left in range(reach + 1):
        after = max(0, left - 1)
        for symbol in ("word", "threat", "threat/negated", "threat/reported", "insult/negated", "insult/reported"):
            steps[left, symbol] = (after, symbol)
        steps[left, "insult"] = (after, "insult/aimed" if left else "insult")
        steps[left, "target"] = (reach, "target")
        steps[left, "mark"] = (0, "mark")
    return Transducer(0, steps)


def threatening(reach: int = 3) -> Transducer:
    """A violent verb is a threat once a target follows in its clause; what stands alone is a word."""
    out = {"insult": "plain", "insult/aimed": "aimed", "insult/negated": "negated", "insult/reported": "reported"}
    steps = {}
    for left, kind in itertools.product(range(reach + 1), ("threat", "negated", "reported")):
        state, after = (left, kind), (max(0, left - 1), kind)
        steps[state, "word"] = (after, None)
        for hit, reading in out.items():
            steps[state, hit] = (after, reading)
        for hit, reading in (("threat", "threat"), ("threat/negated", "negated"), ("threat/reported", "reported")):
            steps[state, hit] = ((reach, reading), None)
        steps[state, "target"] = ((0, kind), f"threat:{kind}" if left else None)
        steps[state, "mark"] = ((0, kind), None)
    return Transducer((0, "threat"), steps)


@dataclass
class Grammar:
    """The composed table: next state and reading of each state and class."""

    next: list[list[int]]
    reading: list[list[int]]  # -1 for none, len(READINGS) + k for a threat read as READINGS[k]

    @staticmethod
    def build() -> Grammar:
        whole = reported_speech()
        for part in (negation(), aiming(), threatening()):
            whole = compose(whole, part, CLASSES)
        number = {whole.start: 0}
        for (state, _), (after, _) in whole.steps.items():
            number.setdefault(state, len(number))
            number.setdefault(after, len(number))
        code = {None: -1} | {r: k for k, r in enumerate(READINGS)} | {f"threat:{r}": len(READINGS) + READINGS.index(r) for r in ("threat", "negated", "reported")}
        after, reading = ([[0] * len(CLASSES) for _ in number] for _ in range(2))
        for (state, symbol), (then, out) in whole.steps.items():
            row, column = number[state], CLASSES.index(symbol)
            after[row][column], reading[row][column] = number[then], code.get(out, -1)
        return Grammar(after, reading)


def word_classes() -> dict[str, int]:
    found = {}
    for name, words in (("threat", THREATS), ("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)):
        found |= dict.fromkeys(words.split(), CLASSES.index(name))
    found |= dict.fromkeys(MARKS, CLASSES.index("mark")) | dict.fromkeys(".!?", CLASSES.index("end")) | {"\n": CLASSES.index("line")}
    return found | dict.fromkeys(OPENING, CLASSES.index("open")) | dict.fromkeys(CLOSING, CLASSES.index("close")) | {EITHER: CLASSES.index("quote")}


def tokens(text: str | None, run: int = 1_000_000) -> Iterator[list[str]]:
    """Words in lower case and the marks that bound clauses and quotations, of about ``run`` characters at a time.

    Runs end at white space, so no word is cut.
    """
    text, start = text or "", 0
    while start < len(text):
        end = len(text)
        if end - start > run:
            end = max(text.rfind(" ", start, start + run), text.rfind("\n", start, start + run)) + 1
            if end <= start:
                end = min((k for k in (text.find(" ", start), text.find("\n", start)) if k >= 0), default=len(text) - 1) + 1
        yield TOKEN.findall(text[start:end].lower())
        start = end


class Reader:
    """Matches of whole texts, by a lexicon of words (``word$``) and word beginnings."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.grammar, self.fixed = lexicon, Grammar.build(), word_classes()
        self.lengths = sorted({len(s) for s in lexicon if s[-1:] != "$"}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {}

    def _class(self, word: str) -> tuple[int, float]:
        """(class, weight): the fixed classes, else the whole word's weight, else that of its longest known beginning."""
        if word in self.fixed:
            at = self.fixed[word]
            return at, THREAT_WEIGHT if CLASSES[at] == "threat" else 0.0
        weight = self.lexicon.get(word + "$")
        if weight is None:
            weight = next((self.lexicon[word[:k]] for k in self.lengths if word[:k] in self.lexicon), None)
        return (0, 0.0) if weight is None else (1, weight)

    def matches(self, text: str | None) -> tuple[list[tuple[int, float, int]], int]:
        """((reading, weight, clause) of every match, number of words)."""
        if len(self.known) > 500_000:
            self.known = {}
        known, found = self.known, []
        state, clause, held, n_words = 0, 0, 0.0, 0
        follow, read = self.grammar.next, self.grammar.reading
        for words in tokens(text):
            for w in set(words):
                if w not in known:
                    known[w] = self._class(w)
            classes = [known[w] for w in words]
            bounds = sum(c >= FIRST_BOUND for c, _ in classes)
            n_words += len(words) - bounds
            if not found and state == 0 and not any(c in (1, 2) for c, _ in classes):
                clause += bounds
                state = self._after(classes)
                continue
            for c, weight in classes:
                reading, state = read[state][c], follow[state][c]
                if c == 2:
                    held = weight
                elif c >= FIRST_BOUND:
                    clause += 1
                if reading >= len(READINGS):
                    found.append((reading - len(READINGS), held, clause))
                elif reading >= 0:
                    found.append((reading, weight, clause))
        return found, n_words

    def _after(self, classes: list[tuple[int, float]]) -> int:
        """The state a run without matches leaves behind: that of its last line."""
        line, state = CLASSES.index("line"), 0
        for c, _ in reversed(classes):
            if c == line:
                break
            state = -1
        if state == 0:
            return 0
        last = max((k for k, (c, _) in enumerate(classes) if c == line), default=-1)
        for c, _ in classes[last + 1 :]:
            state = self.grammar.next[max(state, 0)][c]
        return max(state, 0)

    def features(self, text: str | None) -> list[float]:
        """Weight by reading, the heaviest clause, matches a word, words; logarithms of all but none.

        A clause counts as far as its matches go, so one long invective weighs more
        than as many words spread over a text.
        """
        found, n_words = self.matches(text)
        by, clauses = [0.0] * len(READINGS), Counter()
        for reading, weight, clause in found:
            by[reading] += weight
            clauses[clause] += weight
        total = sum(by)
        return [*(float(np.log1p(max(0.0, v))) for v in by), float(np.log1p(max(clauses.values(), default=0.0))), float(np.log1p(1000.0 * max(0.0, total) / max(1, n_words))), float(np.log1p(n_words))]


@dataclass
class Toxicity:
    """A lexicon, and a logistic curve over the features of the matches."""

    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str | None], reader: Reader | None = None) -> np.ndarray:
        reader = reader or Reader(self.lexicon)
        x = np.array([reader.features(t) for t in texts], dtype=np.float64).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


def beginnings(text: str | None) -> Counter:
    """How often a text holds each word (``word$``) and each beginning of a word."""
    out: Counter = Counter()
    fixed = word_classes()
    words: Counter = Counter()
    for some in tokens(text):
        words.update(some)
    for w, n in words.items():
        if w not in fixed:
            out[w + "$"] += n
            for k in LENGTHS:
                if len(w) >= k:
                    out[w[:k]] += n
    return out


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, texts1, texts0, times1, times0) over labelled texts, combined in each batch before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[Counter, Counter, Counter, Counter] = (Counter(), Counter(), Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, side = beginnings(text), 0 if label == 1 else 1
                held[side].update(own.keys())
                held[2 + side].update(own)
            stems = sorted(set().union(*held))
            numbers = [pa.array([h[s] for s in stems], pa.int64()) for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *numbers], ["stem", "texts1", "texts0", "times1", "times0"])

    names = ("texts1", "texts0", "times1", "times0")
    counted = sample.select("text", "label").mapInArrow(run, "stem string, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("stem").agg(*[F.sum(n).alias(n) for n in names])


def learn_lexicon(counts: DataFrame, n1: int, n0: int, max_stems: int = MAX_STEMS, least: int = 3, ratio: float = 4.0, enough: float = 6.0) -> dict[str, float]:
    """The stems that tell the labels apart best, with their log ratios.

    A stem must be held by ``least`` toxic texts, be ``ratio`` times as frequent there and say ``enough``.
    Stems are taken by how much their texts say (a likelihood ratio); a beginning goes
    before its own extensions, which say the same again, but a longer one of equal say
    is the better defined. At most ``max_stems`` are kept, a documented bound.
    """
    p1, p0 = (F.col("texts1") + 0.5) / (n1 + 1.0), (F.col("texts0") + 0.5) / (n0 + 1.0)
    often = F.log((F.col("times1") + 0.5) / (n1 + 1.0)) - F.log((F.col("times0") + 0.5) / (n0 + 1.0))
    both = (F.col("texts1") + F.col("texts0") + 1.0) / (n1 + n0 + 2.0)
    say = (F.col("texts1") + 0.5) * F.log(p1 / both) + (F.col("texts0") + 0.5) * F.log(p0 / both)
    told = counts.withColumn("often", often).withColumn("say", F.round(say, 6)).where((F.col("texts1") >= least) & (F.col("often") >= float(np.log(ratio))) & (p1 > p0) & (F.col("say") >= enough))
    best = told.orderBy(F.desc("say"), F.desc(F.length("stem")), "stem").limit(max_stems).collect()
    kept: dict[str, float] = {}
    for r in best:
        word = r.stem.rstrip("$")
        if any(word[:k] in kept for k in LENGTHS if k <= len(word)) or any(s.startswith(word) for s in kept):
            continue
        kept[r.stem] = min(5.0, float(r.often))
    return kept


def cover(held: list[tuple[list[int], int]], stems: list[str], enough: float = 6.0) -> list[str]:
    """The stems that still say ``enough`` once others are chosen, the most telling first.

    Every chosen stem halves the weight of the toxic texts that hold it, so that words
    which only share a text with insults (its copies repeat them) are not learned.
    """
    text = np.repeat(np.arange(len(held)), [len(ids) for ids, _ in held])
    stem = np.fromiter(itertools.chain.from_iterable(ids for ids, _ in held), dtype=np.int64, count=len(text))
    toxic = np.array([label == 1 for _, label in held], dtype=bool)
    weight = np.ones(len(held))
    n1, n0 = toxic.sum(), (~toxic).sum()
    clean = np.bincount(stem, ~toxic[text], len(stems))
    by = np.argsort(stem, kind="stable")
    ends = np.searchsorted(stem[by], np.arange(len(stems) + 1))
    chosen: list[int] = []
    left = np.ones(len(stems), dtype=bool)
    while left.any():
        hits = np.bincount(stem, (weight * toxic)[text], len(stems))
        p1, p0, both = (hits + 0.5) / (n1 + 1), (clean + 0.5) / (n0 + 1), (hits + clean + 1) / (n1 + n0 + 2)
        say = np.where(left & (p1 > p0), (hits + 0.5) * np.log(p1 / both) + (clean + 0.5) * np.log(p0 / both), -1.0)
        best = int(np.argmax(say))
        if say[best] < enough:
            break
        chosen.append(best)
        left[best] = False
        weight[text[by[ends[best] : ends[best + 1]]]] *= 0.5
    return [stems[k] for k in chosen]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, drawn towards what the readings are worth by default."""
    prior = np.r_[[WORTH[r] for r in READINGS], 0.5, 0.0, 0.0]
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, b = prior.copy(), float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return w, b
    full = np.c_[x, np.ones(len(x))]
    at = np.r_[w, b]
    pull = np.r_[np.full(x.shape[1], penalty), 1e-6]
    mean = np.r_[prior, 0.0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ at, -30, 30)))
        slope = full.T @ (y - p) - pull * (at - mean)
        bend = (full * (p * (1 - p))[:, None]).T @ full + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        at = at + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return at[:-1], float(at[-1])


def is_held_out(id_col: Column) -> Column:
    """A fifth of the ids, by checksum; a NULL id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learn from labelled rows that are not held out, of ``max_rows`` ids at most (those of the smallest hash).

    Several labels of an id count as their majority, an even vote and NULL as none.
    Where an id has several texts, the one of the least hash stands for it.
    """
    vote = need(labels, id_col, label_col).where(~is_held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    vote = vote.groupBy(F.col(id_col).alias("k")).agg(F.avg(label_col).alias("vote")).where("vote <> 0.5")
    drawn = vote.orderBy(F.xxhash64("k"), "k").limit(max_rows).select("k", (F.col("vote") > 0.5).cast("int").alias("label"))
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most ``max_rows`` rows of an id and a label are sent to every task.
    known = rows.join(F.broadcast(drawn), F.col("id") == F.col("k"))
    one = known.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    sample = materialise(one, "toxicity-sample")
    n1, n0 = sample.agg(F.coalesce(F.sum(F.col("label")), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    told = learn_lexicon(stem_counts(sample), n1, n0)
    stems = list(told)

    @F.pandas_udf("array<int>")
    def which(texts: pd.Series) -> pd.Series:
        number = {s: k for k, s in enumerate(stems)}
        return pd.Series([sorted(number[s] for s in beginnings(t).keys() & number.keys()) for t in texts])

    held = [(r.ids, r.label) for r in sample.select(which("text").alias("ids"), "label").collect()]  # max_rows rows
    lexicon = {s: told[s] for s in cover(held, stems)}

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        reader = Reader(lexicon)
        return pd.Series([reader.features(t) for t in texts])

    found = sample.select(features("text").alias("x"), "label").collect()  # max_rows rows of eight numbers
    x = np.array([r.x for r in found], dtype=np.float64).reshape(-1, len(READINGS) + 3)
    return Toxicity(lexicon, *fit(x, np.array([r.label for r in found], dtype=np.float64)))


def score_text(model: Toxicity, text: Column) -> Column:
    """0..1, higher where label 1 is likelier; NULL counts as empty."""
    mark = hash((tuple(sorted(model.lexicon.items())), tuple(model.weights), model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        readers = worker_cache("toxicity")
        if mark not in readers:
            readers.clear()
            readers[mark] = Reader(model.lexicon)
        return pd.Series(model.scores(texts, readers[mark]))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, learned from ``labels``.

    Only the text enters a score, so repeated rows score alike. NULL ids and texts are
    scored too, a NULL text as an empty one; without labels of both kinds the share of
    toxic ones and the default worth of threats decide; an empty table gives an empty one.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(f"`{id_col}`"), is_held_out(F.col(f"`{id_col}`")).alias("held_out"), score_text(model, F.col(f"`{text_col}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
