"""Toxicity by a weighted finite-state grammar over clauses.

Words fall into classes: insults, threats, targets, negations, reported speech
and others. Three transducers rewrite a clause's classes letter by letter, each
a table of weighted arcs: one marks what a negation covers, one what stands
behind a word of reporting, and one, not deterministic as a target may stand on
either side, tells targeted insults and threats from plain ones. Their
composition, a product of the tables, is the grammar; of its paths through a
clause exactly one ends in a final state. An insult weighs its log odds times
the weights of the arcs on that path. So clauses are scored as plain, targeted,
negated, reported or threatening, not by their words alone. A logistic model
whose prior follows that order is fitted on the sample and turns the sums of a
text into a score.

Insults are learned: whole words, or word starts that several words share. A
stem's evidence is the documents of either label that hold it, or how many
further words of one document begin with it: what toxic texts circle around
they inflect. Of stems that contain one another the best supported counts. Words
that stand before insults in clean documents alone are learned as negations
(just before) or as words of reporting (earlier in the clause); the lists below
are their start in four languages, with threats and targets.

Most texts hold no insult and no threat: one regular expression over the text
finds them, and the grammar runs only over the clauses that hold one.

What is learned comes from at most `sample` labelled documents of either label,
the first by a hash of doc_id outside the held-out fifth; copies among them
count once.

Edge cases: null and empty texts get the score of a text without any clause
matched; documents that labels disagree about are not learned from; without
labels the prior weights stand; a null doc_id counts as held out; repeated rows
get equal scores; doc_id may be of any type.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, ships, words_sql, written
from .lang_id import held_out

ships(__name__)

SAMPLE = 4_000
SHORTEST, LONGEST = 4, 9
#: A stem's evidence must be this unlikely by chance, over all stems tried (about `TRIED` a document).
CHANCE, TRIED = 1e-3, 200
#: Documents that must hold a stem, and its log odds of standing in a toxic document, at least.
LEAST_DOCS, LEAST_ODDS = 3, 1.5

TARGETS = frozenset("you your yours yourself u ur he she him her they them thou ye du dich dir dein deine ihr euch euer er sie ihn tu te toi ton ta tes vous votre vos il elle ils elles tú usted ustedes ti tus su sus él ella ellos ellas vosotros".split())
NEGATIONS = frozenset("not no never neither nor isn aren wasn don doesn didn nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes quoted quote quotes claimed reported allegedly sagte sagt nannte schrieb zitierte angeblich dit disait appelle appelait écrit cite dijo dice llamó llama escribió citó".split())
THREATS = frozenset("kill murder strangle stab shoot hang destroy crush beat töten umbringen erschießen erwürgen verprügeln tuer étrangler poignarder frapper massacrer matar matarte asesinar golpear apuñalar".split())
#: Words that a negation before them covers.
REACH = 3
KINDS = ("plain", "targeted", "negated", "reported", "threat")
CLASSES = ("insult", "threat", "target", "negation", "report", "other")
#: Bias and the weights of the kinds before anything is learned.
PRIOR = np.array([-3.0, 2.2, 3.0, 1.2, 1.2, 3.0])
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n,]+")


class Transducer:
    """Weighted arcs from (state, letter) to (letter written, weight, next state); starts and finals are sets of states."""

    def __init__(self, starts: Iterable, finals: Iterable, arcs: dict[tuple, list[tuple]]) -> None:
        self.starts, self.finals, self.arcs = frozenset(starts), frozenset(finals), arcs

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: `other` reads what this one writes."""
        letters: dict = {}
        for (state, letter), out in self.arcs.items():
            letters.setdefault(state, []).append((letter, out))
        starts = {(a, b) for a in self.starts for b in other.starts}
        arcs: dict[tuple, list[tuple]] = {}
        seen, todo = set(starts), list(starts)
        while todo:
            state = todo.pop()
            for letter, out in letters.get(state[0], ()):
                for written_, w, a in out:
                    for final, v, b in other.arcs.get((state[1], written_), ()):
                        arcs.setdefault((state, letter), []).append((final, w * v, (a, b)))
                        if (a, b) not in seen:
                            seen.add((a, b))
                            todo.append((a, b))
        return Transducer(starts, {x for x in seen if x[0] in self.finals and x[1] in other.finals}, arcs)

    def paths(self, letters: Iterable[str]) -> list[list[tuple[str, float]]]:
        """What the paths from a start to a final state write, with weights."""
        open_ = {state: [[]] for state in self.starts}
        for letter in letters:
            onward: dict = {}
            for state, runs in open_.items():
                for out, w, to in self.arcs.get((state, letter), ()):
                    onward.setdefault(to, []).extend([*r, (out, w)] for r in runs)
            open_ = onward
        return [r for state, runs in open_.items() if state in self.finals for r in runs]


def _negation() -> Transducer:
    """Counts the words that a negation still covers; insults and threats there are marked."""
    arcs = {}
    for k in range(REACH + 1):
        for c in CLASSES:
            covered = k > 0 and c in ("insult", "threat")
            arcs[k, c] = [(f"{c} negated" if covered else c, 1.0, REACH if c == "negation" else max(k - 1, 0))]
    return Transducer([0], range(REACH + 1), arcs)


def _reported() -> Transducer:
    """Notes a word of reporting; insults and threats behind it that no negation covers are marked."""
    arcs = {}
    for told in (False, True):
        for c in (*CLASSES, "insult negated", "threat negated"):
            arcs[told, c] = [(f"{c} reported" if told and c in ("insult", "threat") else c, 1.0, told or c == "report")]
    return Transducer([False], [False, True], arcs)


def _targeted() -> Transducer:
    """Guesses at the start whether the clause has a target, and fails where the guess is wrong; writes kinds."""
    arcs = {}
    for state in ("none", "awaited", "seen"):
        for c in (*CLASSES, *(f"{c} {how}" for c in ("insult", "threat") for how in ("negated", "reported"))):
            if c == "target":
                if state != "none":
                    arcs[state, c] = [("", 1.0, "seen")]
                continue
            kind = {"insult": "plain" if state == "none" else "targeted", "insult negated": "negated", "insult reported": "reported", "threat": "" if state == "none" else "threat"}.get(c, "")
            arcs[state, c] = [(kind, 1.0, state)]
    return Transducer(["none", "awaited"], ["none", "seen"], arcs)


GRAMMAR = _negation().then(_reported()).then(_targeted())


def clause(tokens: list[tuple[str, float]]) -> dict[str, float]:
    """Weights by kind that the grammar gives the words (class, weight) of one clause."""
    out: dict[str, float] = {}
    (path,) = GRAMMAR.paths(c for c, _ in tokens)
    for (kind, w), (_, weight) in zip(path, tokens):
        if kind:
            out[kind] = out.get(kind, 0.0) + w * weight
    return out


class Lexicon:
    """Insult stems (a trailing $: whole words) with weights; the gate finds them in the words of _WORD and nowhere else."""

    def __init__(self, stems: dict[str, float], negations: Iterable[str] = (), reports: Iterable[str] = ()) -> None:
        self.stems, self.negations, self.reports = stems, NEGATIONS | set(negations), REPORTS | set(reports)
        self.longest = max((len(s.rstrip("$")) for s in stems), default=0)
        trie: dict = {}
        for s in [*stems, *(t + "$" for t in THREATS)]:
            at = trie
            for c in s:
                at = at.setdefault(c, {})
            at[""] = {}
        self.gate = re.compile(r"(?<![^\W\d_])" + _trie_pattern(trie)) if trie else None

    def weight(self, word: str) -> float:
        found = self.stems.get(word + "$", 0.0)
        for k in range(min(len(word), self.longest), SHORTEST - 1, -1):
            found = max(found, self.stems.get(word[:k], 0.0))
        return found

    def classed(self, word: str) -> tuple[str, float]:
        if (w := self.weight(word)) > 0:
            return "insult", w
        for name, words in (("threat", THREATS), ("target", TARGETS), ("negation", self.negations), ("report", self.reports)):
            if word in words:
                return name, 1.0
        return "other", 0.0

    def clauses(self, text: str | None) -> Iterable[list[str]]:
        """The words of each clause that holds an insult or a threat."""
        low, done = (text or "").lower(), -1
        for m in self.gate.finditer(low) if self.gate else ():
            if m.start() < done:
                continue
            a = max((low.rfind(c, 0, m.start()) for c in ".!?;:\n,"), default=-1) + 1
            end = _CLAUSE.search(low, m.end())
            done = end.start() if end else len(low)
            yield _WORD.findall(low, a, done)


def _trie_pattern(trie: dict) -> str:
    if "" in trie:
        return ""
    options = [r"(?![^\W\d_])" if c == "$" else re.escape(c) + _trie_pattern(rest) for c, rest in sorted(trie.items())]
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The saturated sums of clause weights by kind."""
    sums = dict.fromkeys(KINDS, 0.0)
    for words in lexicon.clauses(text):
        for kind, weight in clause([lexicon.classed(w) for w in words]).items():
            sums[kind] += weight
    return [math.log1p(sums[k]) for k in KINDS]


def fitted(x: np.ndarray, y: np.ndarray, strength: float = 0.05) -> np.ndarray:
    """Logistic weights by Newton's method, drawn towards the prior."""
    w = PRIOR.copy()
    if not len(x):
        return w
    x = np.column_stack((np.ones(len(x)), x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.2)  # more matched clauses never lower a score
    return w


def _counted(batches):
    """For each stem: documents that hold it, and further words of a document that begin with it, by label."""
    import pyarrow as pa

    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words: dict[str, int] = {}
            for word in set(_WORD.findall((text or "").lower())):
                for s in (word + "$", *(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))):
                    words[s] = words.get(s, 0) + 1
            for s, n in words.items():
                c = counts.setdefault(s, [0] * 6)
                c[toxic] += 1
                c[2 + toxic] += n > 1
                c[4 + toxic] += n - 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(6))], names=["stem", *_COUNTS])


_COUNTS = ("c", "t", "c2", "t2", "cn", "tn")


def _evidence(t: str, c: str, p: float) -> str:
    """SQL for half the G statistic of `t` of `t` + `c` where the share `p` is expected; 0 where it isn't exceeded."""
    n = f"({t} + {c})"
    return f"if({t} > {n} * {p!r}D, {t} * ln({t} / ({n} * {p!r}D)) + if({c} > 0, {c} * ln({c} / ({n} * {1 - p!r}D)), 0.0D), 0.0D)"


def learned_stems(found: list[tuple[str, float, float]]) -> dict[str, float]:
    """Stems with their odds, from (stem, evidence, odds): of those that contain one another the best supported, the longest of equals."""
    taken: dict[str, float] = {}
    for s, _, odds in sorted(found, key=lambda x: (-x[1], -len(x[0]), x[0])):
        word = s.rstrip("$")
        if not any(word.startswith(x.rstrip("$")) or x.rstrip("$").startswith(word) for x in taken):
            taken[s] = odds
    return taken


def _contexts(lexicon: Lexicon):
    """For each word before an insult: whether it stands just before, and the documents of either label."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[tuple, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = set()
                for words in lexicon.clauses(text):
                    insults = [i for i, w in enumerate(words) if lexicon.weight(w) > 0]
                    for i, w in enumerate(words[: insults[-1]] if insults else ()):
                        near = any(0 < j - i <= REACH for j in insults)
                        if lexicon.classed(w)[0] == "other":
                            seen |= {(w, False), (w, True)} if near else {(w, False)}
                for k in seen:
                    counts.setdefault(k, [0, 0])[toxic] += 1
            keys = list(counts)
            yield pa.record_batch([pa.array([w for w, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.bool_()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], names=["word", "near", "c", "t"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from a bounded sample; only significant stems and words and the sample's features reach the driver."""
    sure = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi").select("doc_id", F.col("lo").cast("int").alias("toxic"))
    free = sure.where(~held_out(F.col("doc_id")))
    first = [free.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = written(first[0].unionByName(first[1]), "sample")
    # At most twice `sample` rows are broadcast. Near copies share the least of their shingles' hashes; one of them counts.
    least = lambda seed: F.expr(let("w", words_sql("lower(text)"), f"array_min(if(size(w) < 3, array(xxhash64('{seed}', w)), transform(sequence(0, size(w) - 3), i -> xxhash64('{seed}', w[i], w[i + 1], w[i + 2]))))"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.xxhash64("text").alias("th"), least("a").alias("m1"), least("b").alias("m2"))
    for m in ("m1", "m2"):
        rows = rows.groupBy("toxic", m).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("toxic", m))), "th").alias("r")).select("toxic", m, "r.*")
    rows = written(rows.select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}), PRIOR
    share = n_toxic / (n_toxic + n_clean)
    odds = lambda t, c: f"ln(({t} + 0.5D) / ({c} + 0.5D) * {(n_clean + 1) / (n_toxic + 1)!r}D)"
    bar = math.log(TRIED * (n_toxic + n_clean)) - math.log(CHANCE)
    counted = rows.mapInArrow(_counted, f"stem string, {', '.join(f'{c} long' for c in _COUNTS)}").groupBy("stem").agg(*[F.sum(c).alias(c) for c in _COUNTS]).where(f"t >= {LEAST_DOCS}")
    single = f"if({odds('t', 'c')} >= {LEAST_ODDS}, {_evidence('t', 'c', share)}, 0.0D)"
    several = f"if(t2 >= {LEAST_DOCS} and {odds('t2', 'c2')} >= {LEAST_ODDS} and not endswith(stem, '$'), {_evidence('tn', 'cn', share)}, 0.0D)"
    told = counted.selectExpr("stem", f"greatest({single}, {several}) as e", f"{odds('t', 'c')} as o").where(f"e >= {bar!r}D")
    stems = learned_stems([tuple(r) for r in told.orderBy("stem").collect()])
    lexicon = Lexicon({s: max(o, 0.5) for s, o in stems.items()})
    around = rows.mapInArrow(_contexts(lexicon), "word string, near boolean, c long, t long").groupBy("word", "near").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    # Among documents that hold an insult most are toxic; a word that turns them clean stands out from that share.
    held = rows.mapInArrow(_holding(lexicon), "toxic int").groupBy("toxic").count().collect()
    k = {r["toxic"]: r["count"] for r in held}
    if k.get(0) and k.get(1):
        clean_share = k[0] / (k[0] + k[1])
        turning = around.where(f"c >= {LEAST_DOCS} and {_evidence('c', 't', clean_share)} >= {bar!r}D").orderBy("word").collect()
        near = {r["word"] for r in turning if r["near"]}
        lexicon = Lexicon(lexicon.stems, near, {r["word"] for r in turning} - near)
    got = rows.mapInArrow(_featurer(lexicon), "x array<double>, toxic int").collect()
    return lexicon, fitted(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float))


def _holding(lexicon: Lexicon):
    """The label of each document that holds a clause with an insult or threat."""

    def run(batches):
        for batch in batches:
            mask = [next(iter(lexicon.clauses(t)), None) is not None for t in batch.column(0).to_pylist()]
            import pyarrow as pa

            yield pa.record_batch([batch.column(1).filter(pa.array(mask, pa.bool_()))], names=["toxic"])

    return run


def _featurer(lexicon: Lexicon):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([features(t, lexicon) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def _scorer(lexicon: Lexicon, weights: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column(2).to_pylist()]).reshape(-1, len(KINDS))
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    lexicon, weights = train(docs, labels, **how)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(lexicon, weights), T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
