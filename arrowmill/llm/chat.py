"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A conversation is a sequence of rows in the order of `turn`, a row a sequence
of lines. Hidden states are the roles. A line shows a speaker marker ("User:",
"Assistant:", "### Instruction", "Q:" and the like), its row's length, its own
length, whether it asks and how it starts. A role may change at a row's first
line or at a marker only. Emissions and changes are learned as smoothed counts
from conversations outside the held-out fifth; markers have a strong prior, so
that transcripts with markers parse without any training.

Decoding is exact Viterbi, yet no conversation needs to fit a task: rows are cut
into chunks of `CHUNK` turns; each chunk gives the best score between any state
before and any state at its end (a max-plus matrix); a conversation's few
matrices are scanned for the states at the chunk borders; then each chunk is
decoded between its border states. Texts move once, by chunk.

Edge cases: null and empty texts are one empty line; rows with equal turns are
ordered by a hash of their text, null turns come first; rows without a conv_id
have no known order, so each is a conversation of its own and is decoded where
it is scanned; without roles to learn the three usual ones are used; repeated
rows are repeated turns. conv_id may be of any type, role values are taken to be
few. A chunk is read by one task, so a conversation's rows must be spread over
turns.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from .common import ships, written
from .lang_id import held_out

ships(__name__)

CHUNK = 64
USUAL = ("assistant", "system", "user")
_MARKERS = (
    ("system", re.compile(r"\s*(?:<\|?(?:im_start\|>)?\s*system\|?>?|\[?system(?: prompt| message)?\]?\s*[:>]|#{2,}\s*system\b:?|<<sys>>)\s*", re.I)),
    ("user", re.compile(r"\s*(?:<\|?(?:im_start\|>)?\s*(?:user|human)\|?>|[\[*]{0,2}(?:user|human|customer|question|prompt|q|me)[\]*]{0,2}\s*[:>]|#{2,}\s*(?:instruction|user|human|input|question)\b:?|\[inst\])\s*", re.I)),
    ("assistant", re.compile(r"\s*(?:<\|?(?:im_start\|>)?\s*(?:assistant|bot|ai|model)\|?>|[\[*]{0,2}(?:assistant|bot|ai|gpt|model|answer|response|agent|a)[\]*]{0,2}\s*[:>]|#{2,}\s*(?:response|assistant|output|answer)\b:?|\[/inst\])\s*", re.I)),
)
FEATURES = (4, 12, 12, 2, 3)  # values of: marker, row length, line length, question, start


def marked(line: str) -> tuple[int, str]:
    """The marker's class (0: none) and the line without it."""
    for i, (_, pattern) in enumerate(_MARKERS):
        if m := pattern.match(line):
            return i + 1, line[m.end() :]
    return 0, line


def observed(text: str | None) -> list[tuple[bool, tuple[int, ...], str]]:
    """For each line: may the role change here, its features, and the line without its marker."""
    text = text or ""
    out = []
    whole = min(11, len(text).bit_length())
    for n, line in enumerate(text.split("\n")):
        marker, rest = marked(line)
        start = 0 if not rest[:1] else 1 if rest[:1].islower() else 2
        out.append((n == 0 or marker > 0, (marker, whole if n == 0 else 0, min(11, len(rest).bit_length()), int(rest.rstrip().endswith("?")), start), rest))
    return out


class Model:
    """Log probabilities; behind the roles comes one more state, the start, that nothing enters."""

    def __init__(self, roles: list[str], emissions: list[np.ndarray], change: np.ndarray, start: np.ndarray) -> None:
        n = len(roles)
        self.roles, self.start = roles, n
        self.emissions = [np.vstack((e, np.zeros(e.shape[1]))) for e in emissions]
        self.change = np.column_stack((np.vstack((change, start)), np.full(n + 1, -np.inf)))
        self.stay = np.where(np.eye(n + 1) > 0, 0.0, -np.inf)
        self.begin = np.where(np.arange(n + 1) == n, 0.0, -np.inf)

    def steps(self, lines: list[tuple[bool, tuple[int, ...], str]]):
        """For each line the max-plus matrix from the state before it to its own."""
        for may, values, _ in lines:
            emission = sum(e[:, v] for e, v in zip(self.emissions, values)) if may else 0.0
            yield (self.change if may else self.stay) + emission


def made(counts: dict[tuple, int], changes: dict[tuple, int]) -> Model:
    """The model of counts (role, feature, value) and (role before or '', role)."""
    roles = sorted({r for r, _, _ in counts}) or list(USUAL)
    at = {r: i for i, r in enumerate(roles)}
    emissions = [np.ones((len(roles), n)) for n in FEATURES]
    for k, (name, _) in enumerate(_MARKERS):
        if name in at:
            emissions[0][:, k + 1] *= 0.01
            emissions[0][at[name], k + 1] = 50.0
    for (role, f, v), n in counts.items():
        emissions[f][at[role], v] += n
    change, start = np.ones((len(roles), len(roles))), np.ones(len(roles))
    for (before, role), n in changes.items():
        if before == "":
            start[at[role]] += n
        elif before in at and role in at:
            change[at[before], at[role]] += n
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(roles, [log(e) for e in emissions], log(change), log(start))


def _counter(batches):
    import pyarrow as pa

    for batch in batches:
        counts: dict[tuple, int] = {}
        for role, before, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for f, v in enumerate(observed(text)[0][1]):
                counts[role, f, v] = counts.get((role, f, v), 0) + 1
            if before is not None:
                counts[role, -1, before] = counts.get((role, -1, before), 0) + 1
        keys = list(counts)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([str(k[2]) for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["role", "f", "v", "n"])


def _ordered(rows: DataFrame) -> DataFrame:
    """`rows` with chunk and a tie-breaking hash."""
    return rows.withColumn("__chunk", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / CHUNK)).withColumn("__tie", F.xxhash64("text"))


def learn(rows: DataFrame) -> Model:
    """The model of all rows with a role outside the held-out conversations; counts alone reach the driver."""
    known = _ordered(rows.where(F.col("role").isNotNull() & ~held_out(F.col("conv_id"))).select("conv_id", "turn", "role", "text"))
    place = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))), "__tie")
    alone = F.col("conv_id").isNull()
    within = F.lag("role").over(Window.partitionBy("conv_id", "__chunk").orderBy(F.col("turn").asc_nulls_first(), "__tie"))
    # A chunk's first row follows the last of the chunk before; a conversation's first row follows nothing.
    last = known.where(~alone).groupBy("conv_id", "__chunk").agg(F.max_by("role", place).alias("last"))
    carried = last.select(F.col("conv_id").alias("__c"), F.col("__chunk").alias("__k"), F.lag("last").over(Window.partitionBy("conv_id").orderBy("__chunk")).alias("carried"))
    inside = known.where(~alone).withColumn("before", within).join(carried, (F.col("conv_id") == F.col("__c")) & (F.col("__chunk") == F.col("__k"))).select("role", F.coalesce("before", "carried", F.lit("")).alias("before"), "text")
    seen = inside.unionByName(known.where(alone).select("role", F.lit("").alias("before"), "text"))
    counts, changes = {}, {}
    for r in seen.mapInArrow(_counter, "role string, f int, v string, n long").groupBy("role", "f", "v").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            changes[r["v"], r["role"]] = r["n"]
        else:
            counts[r["role"], r["f"], int(r["v"])] = r["n"]
    return made(counts, changes)


def _groups(batches, n_keys: int):
    """Runs of rows with equal first columns; rows of a run are lists."""
    run, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[:n_keys] != key:
                yield key, run
                run = []
            key = row[:n_keys]
            run.append(row)
    if run:
        yield key, run


def _joined(m: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (m[:, :, None] + step[None, :, :]).max(axis=1)


def _matrices(model: Model, kind):
    def run(batches):
        import pyarrow as pa

        for (conv, chunk), rows in _groups(batches, 2):
            m = None
            for row in rows:
                for step in model.steps(observed(row[3])):
                    m = step if m is None else _joined(m, step)
            yield pa.record_batch([pa.array([conv], kind), pa.array([chunk], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["conv_id", "__chunk", "m"])

    return run


def _borders(model: Model, kind):
    s = len(model.roles) + 1

    def run(batches):
        import pyarrow as pa

        for (conv,), rows in _groups(batches, 1):
            chunks, back, v = [], [], model.begin
            for _, chunk, m in rows:
                scores = v[:, None] + np.array(m).reshape(s, s)
                chunks.append(chunk)
                back.append(scores.argmax(axis=0))
                v = scores.max(axis=0)
            end, states = int(v.argmax()), []
            for b in reversed(back):
                states.append((int(b[end]), end))
                end = int(b[end])
            states.reverse()
            yield pa.record_batch([pa.array([conv] * len(chunks), kind), pa.array(chunks, pa.int64()), pa.array([x[0] for x in states], pa.int32()), pa.array([x[1] for x in states], pa.int32())], names=["conv_id", "__chunk", "before", "end"])

    return run


def viterbi(model: Model, lines: list, before: int | None = None, end: int | None = None) -> list[int]:
    """The states of `lines`, given the state before them and that of the last line, if known."""
    v, back = model.stay[model.start if before is None else before], []
    for step in model.steps(lines):
        scores = v[:, None] + step
        back.append(scores.argmax(axis=0))
        v = scores.max(axis=0)
    at, out = int(v.argmax()) if end is None else end, []
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return out[::-1]


def canonical(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def _turns(model: Model, kind, single: bool = False):
    """Turns of each chunk between its border states, or (`single`) of each row by itself."""

    def run(batches):
        import pyarrow as pa

        runs = ((row[:2], [row]) for b in batches for row in zip(*(c.to_pylist() for c in b.columns))) if single else _groups(batches, 2)
        for (conv, _), rows in runs:
            lines, of = [], []
            for n, row in enumerate(rows):
                for line in observed(row[3]):
                    lines.append(line)
                    of.append(n)
            states = viterbi(model, lines, rows[0][4], rows[0][5])
            out, part, last = [], 0, None
            for state, n, (_, _, text) in zip(states, of, lines):
                if last == (n, state):
                    out[-1][4].append(text)
                    continue
                part = part + 1 if last and last[0] == n else 0
                out.append((conv, rows[n][2], part, model.roles[state], [text]))
                last = n, state
            texts = ["\n".join(x[4]) for x in out]
            yield pa.record_batch(
                [pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.string()), pa.array(texts, pa.string()), pa.array([canonical(x[3], t) for x, t in zip(out, texts)], pa.string())],
                names=["conv_id", "turn", "part", "role", "text", "rendered"],
            )

    return run


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, part (a row's turns from 0), role, text without markers and the canonical rendering, from conv_id, turn and text."""
    first = _ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "text"))
    own = first.schema["conv_id"].dataType
    kind, typed = to_arrow_type(own), lambda *more: T.StructType([T.StructField("conv_id", own), *(T.StructField(n, t) for n, t in more)])
    turns = typed(("turn", T.LongType()), ("part", T.IntegerType()), ("role", T.StringType()), ("text", T.StringType()), ("rendered", T.StringType()))
    known, loose = first.where("conv_id is not null"), first.where("conv_id is null")
    keys, order = ["conv_id", "__chunk"], [F.col("turn").asc_nulls_first(), F.col("__tie")]
    sequence = known.select("conv_id", "__chunk", "turn", "text", "__tie").repartition(*keys).sortWithinPartitions(*keys, *order)
    matrices = written(sequence.mapInArrow(_matrices(model, kind), typed(("__chunk", T.LongType()), ("m", T.ArrayType(T.DoubleType())))), "matrices")
    borders = written(matrices.repartition("conv_id").sortWithinPartitions("conv_id", "__chunk").mapInArrow(_borders(model, kind), typed(("__chunk", T.LongType()), ("before", T.IntegerType()), ("end", T.IntegerType()))), "borders")
    b = borders.select(F.col("conv_id").alias("__c"), F.col("__chunk").alias("__k"), "before", "end")
    joined = known.join(b, (F.col("conv_id") == F.col("__c")) & (F.col("__chunk") == F.col("__k")))
    ready = joined.select("conv_id", "__chunk", "turn", "text", "before", "end", "__tie").repartition(*keys).sortWithinPartitions(*keys, *order)
    single = loose.select("conv_id", "__chunk", "turn", "text", F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("end"))
    return ready.mapInArrow(_turns(model, kind), turns).unionByName(single.mapInArrow(_turns(model, kind, single=True), turns))


def format_chats(rows: DataFrame) -> DataFrame:
    """Roles are learned from `role` where it may be seen, and never used to decode."""
    return parse(rows, learn(rows)).withColumn("held_out", held_out(F.col("conv_id")))
