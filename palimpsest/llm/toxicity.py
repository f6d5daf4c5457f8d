"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, or other; marks
become quote, end (of a clause) or break (of a line).  Four small transducers
read them: two write ``negated`` and ``reported``, two ``aimed`` for a target
behind and, reading backwards, ahead.  ``compose`` multiplies the forward ones
into one machine.  Its last layer's arcs rewrite every insult or threat by the
marks it carries, each arc with a weight: one that is aimed weighs more than one
that stands alone, and that more than one that is negated or reported.  A clause
is worth its heaviest arc, a text what its clauses' arcs add up to.  Time is
linear in the text.

The weights are a logistic regression on labels.  They are built of steps that
cannot be negative (anything at all, standing, aimed), so the order of the arcs
holds whatever the labels say, and they start from a prior that stays where the
labels say nothing, as with threats that they do not show.

Threats, targets, negations and verbs of report are closed classes and listed.
Insults are an open class: words and word beginnings that toxic texts have and
others do not, learned by weighted covering.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, is_held_out

#: Labelled documents per class that the grammar learns from.
SAMPLE = 3000
#: Shorter words are learned whole; letters of a learned beginning.
STEM_LEAST, STEM_MOST = 4, 9
#: Least log-likelihood ratio of a stem against chance: millions of beginnings are tried.
EVIDENCE = 18.0
#: What a toxic text still counts for each stem already taken that it has.
COVERED = 0.5

# Closed word classes of the four languages.
THREATS = "kill hurt destroy beat burn stab shoot crush töten umbringen verletzen tuer tuerai frapper détruire matar matarte golpear destruir".split()
TARGETS = "you your yourself he him his she her they them their we us people du dich dir ihr euch sie er tu toi te vous il elle ils elles tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never nor neither isn't aren't don't doesn't wasn't won't without nicht kein keine niemals nie ohne ne pas jamais aucun sans ni nunca jamás sin".split()
REPORTS = "said says say claimed claims wrote called quoted reported according sagte sagt behauptet schrieb laut dit disait affirme selon écrit dijo dice afirma según escribió".split()

#: Words over which a negation or a target reaches.
NEAR = 3
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = {**dict.fromkeys(".!?;", "end"), "\n": "break", **dict.fromkeys("\"“”«»", "quote")}
_CLOSED = {w: kind for kind, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "quote", "end", "break")
KINDS, FORMS = ("insult", "threat"), ("negated", "reported", "plain", "aimed")
#: What a transducer can write under a symbol, as bits.
NEGATED, REPORTED, AIMED = 1, 2, 4


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state][symbol]`` is (next state, what is written); it starts in state 0."""

    arcs: tuple[dict[str, tuple[int, int]], ...]

    def run(self, symbols) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, mark = self.arcs[state][s]
            out.append(mark)
        return out


def within(symbol: str, mark: int) -> Transducer:
    """Writes ``mark`` under the NEAR words after ``symbol``, in the same clause; the state is how many are left."""

    def arc(left, s):
        if s in ("end", "break"):
            return 0, 0
        if s == "quote":
            return left, 0
        return (NEAR if s == symbol else max(0, left - 1)), (mark if left else 0)

    return Transducer(tuple({s: arc(left, s) for s in SYMBOLS} for left in range(NEAR + 1)))


def report(mark: int = REPORTED) -> Transducer:
    """Writes ``mark`` from a verb of report to the end of its clause, and between quotes, which
    may hold many clauses but end with the line.  States: bit 1 said, bit 2 quoted."""

    def arc(state, s):
        if s == "break":
            return 0, 0
        if s == "end":
            return state if state & 2 else 0, 0
        if s == "quote":
            return state ^ 2, 0
        return (state | 1 if s == "report" else state), (mark if state else 0)

    return Transducer(tuple({s: arc(state, s) for s in SYMBOLS} for state in range(4)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that writes what both write, over the pairs of states that can be reached."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for x, y in todo:  # grows while it is read
        own = {}
        for s in SYMBOLS:
            (nx, mx), (ny, my) = a.arcs[x][s], b.arcs[y][s]
            if (nx, ny) not in number:
                number[nx, ny] = len(number)
                todo.append((nx, ny))
            own[s] = (number[nx, ny], mx | my)
        arcs.append(own)
    return Transducer(tuple(arcs))


FORWARD = compose(compose(within("negation", NEGATED), report()), within("target", AIMED))
BACKWARD = within("target", AIMED)


def form(marks: int) -> str:
    """The form that the last layer's arc writes for an insult or threat with these marks."""
    return "negated" if marks & NEGATED else "reported" if marks & REPORTED else "aimed" if marks & AIMED else "plain"


@dataclass(frozen=True)
class Lexicon:
    """Insults: whole words, and beginnings by their first STEM_LEAST letters."""

    words: frozenset[str]
    stems: dict[str, tuple[str, ...]]

    @classmethod
    def of(cls, insults) -> "Lexicon":
        table: dict[str, list[str]] = {}
        for s in insults:
            if len(s) >= STEM_LEAST:
                table.setdefault(s[:STEM_LEAST], []).append(s)
        return cls(frozenset(s for s in insults if len(s) < STEM_LEAST), {k: tuple(sorted(v)) for k, v in table.items()})

    def symbol(self, token: str) -> str:
        found = self.stems.get(token[:STEM_LEAST])
        if token in self.words or found and token.startswith(found):
            return "insult"
        return _CLOSED.get(token) or _MARKS.get(token, "other")

    def symbols(self, text: str) -> list[str]:
        """The symbols of a text; none if no insult or threat is among them."""
        tokens = _TOKEN.findall(text.lower().replace("’", "'"))
        if not any(t[:STEM_LEAST] in self.stems or t in self.words or t in _THREATS for t in tokens):
            return []
        out = [self.symbol(t) for t in tokens]
        return out if "insult" in out or "threat" in out else []


_THREATS = frozenset(THREATS)


def clause_outputs(symbols: list[str]) -> list[dict[str, str]]:
    """For each clause that has any: by kind, the form of its heaviest arc."""
    ahead = BACKWARD.run(reversed(symbols))
    out, own = [], {}
    for s, marks, more in zip([*symbols, "end"], [*FORWARD.run(symbols), 0], [*reversed(ahead), 0], strict=True):
        if s in KINDS:
            found = FORMS.index(form(marks | more))
            own[s] = max(own.get(s, found), found)  # FORMS go from the lightest to the heaviest
        elif s in ("end", "break") and own:
            out.append({kind: FORMS[k] for kind, k in own.items()})
            own = {}
    return out


#: Steps that arcs' weights are made of, for each kind: any, standing (plain or aimed), aimed; and the growth with clauses.
STEPS = ("any", "stands", "aimed", "more")
PRIOR = (0.6, 1.5, 0.6, 0.4) * len(KINDS)
#: Least part of its prior that a step keeps.
FLOOR = 0.1


def features(text: str, lexicon: Lexicon) -> list[float]:
    """For each kind, how far its heaviest arc goes up the steps, and log(1 + clauses that have it)."""
    symbols = lexicon.symbols(text)
    clauses = clause_outputs(symbols) if symbols else []
    out = []
    for kind in KINDS:
        own = [FORMS.index(c[kind]) for c in clauses if kind in c]
        top = max(own, default=-1)
        out += [float(top >= 0), float(top >= 2), float(top >= 3), float(np.log1p(len(own)))]
    return out


def arc_weights(weights) -> dict[str, float]:
    """The weight of each arc of the last layer."""
    out = {}
    for k, kind in enumerate(KINDS):
        base, stands, aimed, _ = weights[len(STEPS) * k : len(STEPS) * (k + 1)]
        out |= {f"{kind}_negated": base, f"{kind}_reported": base, f"{kind}_plain": base + stands, f"{kind}_aimed": base + stands + aimed}
    return out


def _candidates(text: str) -> set[str]:
    own = set()
    for w in set(_WORD.findall(text.lower())):
        own.update([w] if len(w) < STEM_LEAST else [w[:k] for k in range(STEM_LEAST, min(len(w), STEM_MOST) + 1)])
    return own


def _ratio(p, n, toxic, other):
    """Log-likelihood ratio of p of ``toxic`` and n of ``other`` texts against chance; 0 unless p is the more likely."""
    total, base = p + n, toxic / (toxic + other)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(total > 0, p / total, 0)
        out = p * np.log(np.where(part > 0, part / base, 1)) + n * np.log(np.where(part < 1, (1 - part) / (1 - base), 1))
    return np.where(part > base, out, 0)


def learn_stems(sample: DataFrame) -> list[str]:
    """Insults from ``sample`` (doc_id, text, label), by weighted covering.

    A candidate is worth the share of toxic texts that have it less ten times
    the share of the others; it needs EVIDENCE.  The best is taken, the shortest
    of equals; toxic texts that have it count COVERED of before from then on,
    so what only goes along with what is known finds no evidence.
    """

    def stems(batches):
        import pyarrow as pa

        for batch in batches:
            labels, out = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _candidates(text.as_py() or "")
                out += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.int64())], names=["stem", "label"])

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return []
    counts = sample.select("label", "text").mapInArrow(stems, "stem string, label long").groupBy("stem")
    counts = counts.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    # bounded by the sample; those that cannot have the evidence even by themselves stay where they are
    rows = counts.filter((F.col("p") / toxic > 10 * F.col("n") / other) & (F.col("p") * float(np.log((toxic + other) / toxic)) >= EVIDENCE)).collect()
    rows = sorted((r for r in rows if _ratio(r["p"], r["n"], toxic, other) >= EVIDENCE), key=lambda r: (len(r["stem"]), r["stem"]))
    if not rows:
        return []
    place = {r["stem"]: k for k, r in enumerate(rows)}

    def having(batches):
        import pyarrow as pa

        for batch in batches:
            own = [sorted(place[w] for w in _candidates(t.as_py() or "") if w in place) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], names=["own"])

    texts = [r["own"] for r in sample.filter("label = 1").select("text").mapInArrow(having, "own array<int>").collect()]
    weight, n = np.ones(len(texts)), np.array([r["n"] for r in rows], float)
    has = np.zeros((len(texts), len(rows)), bool)
    for k, own in enumerate(texts):
        has[k, own] = True
    taken: list[str] = []
    free = np.ones(len(rows), bool)
    while True:
        p = weight @ has
        worth = np.where(free & (_ratio(p, n, weight.sum(), other) >= EVIDENCE), p / weight.sum() - 10 * n / other, -1)
        best = int(worth.argmax())
        if worth[best] <= 0:
            return taken
        stem = rows[best]["stem"]
        taken.append(stem)
        free &= np.array([not (len(stem) >= STEM_LEAST and r["stem"].startswith(stem) or r["stem"] == stem or len(r["stem"]) >= STEM_LEAST and stem.startswith(r["stem"])) for r in rows])
        weight = np.where(has[:, best], weight * COVERED, weight)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 3000) -> tuple[float, np.ndarray]:
    """Bias and weights, pulled towards PRIOR and not below FLOOR of it, by accelerated projected steps."""
    full, prior = np.hstack([np.ones((len(x), 1)), x]), np.array([0.0, *PRIOR])
    beta = ahead = prior
    t, step = 1.0, 4 / (np.linalg.eigvalsh(full.T @ full / len(x))[-1] + 4 * ridge)
    for _ in range(steps):
        grad = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / len(x)
        grad[1:] += ridge * (ahead - prior)[1:]
        new = ahead - step * grad
        new[1:] = np.maximum(new[1:], FLOOR * prior[1:])
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / t_new * (new - beta), new, t_new
    return float(beta[0]), beta[1:]


@dataclass(frozen=True)
class Grammar:
    lexicon: Lexicon
    bias: float
    weights: tuple[float, ...]

    def score(self, text: str | None) -> float:
        total = self.bias + sum(w * f for w, f in zip(self.weights, features(text or "", self.lexicon), strict=True))
        return float(1 / (1 + np.exp(-total)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Grammar:
    """Stems and weights from at most ``limit`` labelled texts per class, none of them held out."""
    picked = bounded_labels(docs.sparkSession, labels, "toxic", limit, held_out=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(picked), "doc_id")  # two times ``limit`` short rows at most
    sample = sample.groupBy("doc_id").agg(F.max("label").cast("long").alias("label"), F.max("text").alias("text"))
    lexicon = Lexicon.of(learn_stems(sample))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features(t.as_py() or "", lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.select("label", "text").mapInArrow(measure, "label long, x array<double>").collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Grammar(lexicon, float(np.log(share / (1 - share))), (0.0,) * len(PRIOR))
    bias, weights = _logistic(np.array([r["x"] for r in rows]), y)
    return Grammar(lexicon, bias, tuple(weights))


def score_toxicity(docs: DataFrame, labels: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null texts score as empty ones.

    Very long texts are read whole.  Rows that repeat a doc_id each keep their
    row, and equal texts get equal scores.  Without labels of both classes the
    score is the same for every text.  An empty table gives an empty one.
    """
    grammar = grammar or fit(docs, labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [grammar.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
