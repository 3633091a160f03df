"""Chat formatting: a hidden Markov model recovers who speaks in a raw transcript, then turns are rendered canonically.

A transcript is text. Its non-blank lines are observed through `line_features`: a speaker marker at its start, whether a
blank line stood before it, whether it is the first, its length class, its last character's class and whether it looks
like a list or code. Hidden states are the role and whether the line begins a turn. Emissions are products of one
smoothed table for each feature, transitions one smoothed table; both come from counts that Spark aggregates over
transcripts whose roles are known. The most likely path (Viterbi, in logs) gives roles and turns; markers that agree with the role
are stripped.

Cases. A null, empty or blank transcript has no turns and renders to an empty string. A training transcript with a role
that isn't in `ROLES` is left out whole: its other turns would be learned with wrong neighbours. Ties between paths go to the state that comes first in `STATES`. A transcript is worked on whole in one
task, as a document is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from palimpsest.llm.common import add_columns, col, held_out

#: Share of lines for which the markers' own meaning counts, whatever the training transcripts hold.
MARKED = 0.05
ROLES = ("system", "user", "assistant")
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
#: Speaker markers at the start of a line, by role.
MARKERS = {
    "system": r"system|system prompt|instructions?",
    "user": r"user|human|question|q|customer|me",
    "assistant": r"assistant|ai|bot|answer|a|agent|gpt",
}
_MARKER = re.compile(r"^\s*(?:[#>*\[<|]{0,4}\s*)(?:" + "|".join(f"(?P<{r}>{p})" for r, p in MARKERS.items()) + r")\s*[\]>|*]{0,4}\s*[:：]\s*(?:\*{2})?\s*", re.IGNORECASE)
#: What a blank line may hold, here as in `transcripts`: ASCII white space. A line of other white space is a line.
BLANKS = " \t\n\x0b\f\r"
#: Values of each feature, in the order of line_features.
SIZES = (4, 3, 2, 2, 8, 4)


def line_features(text: str) -> list[tuple[str, tuple[int, ...]]]:
    """(line, features) of the non-blank lines. Features: marker, lines before (first, after blank, after text), ends
    with a question mark, list or code, log length, number of lines to the next blank one up to three."""
    out, blank, lines = [], True, (text or "").split("\n")
    full = [bool(x.strip(BLANKS)) for x in lines]
    for i, line in enumerate(lines):
        if not full[i]:
            blank = True
            continue
        m = _MARKER.match(line)
        marker = 0 if m is None else 1 + ROLES.index(m.lastgroup)
        before = 0 if not out else 1 if blank else 2
        ahead = 0
        while ahead < 3 and i + ahead + 1 < len(lines) and full[i + ahead + 1]:
            ahead += 1
        body = line.strip(BLANKS)
        length = min(7, max(0, len(body).bit_length() - 3))
        out.append((line, (marker, before, int(body[-1] in "?？"), int(bool(re.match(r"[-*•]\s|\d+[.)]\s|```|\s{4}", line))), length, ahead)))
        blank = False
    return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def decode(self, features: list[tuple[int, ...]]) -> list[int]:
        """The most likely states, by Viterbi."""
        if not features:
            return []
        seen = np.array([sum(t[:, f[k]] for k, t in enumerate(self.emit)) for f in features])
        best, back = self.start + seen[0], []
        for row in seen[1:]:
            options = best[:, None] + self.move
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def turns(self, text: str) -> list[tuple[str, str]]:
        lines = line_features(text)
        out: list[tuple[str, list[str]]] = []
        for (line, f), state in zip(lines, self.decode([f for _, f in lines])):
            role, begins = STATES[state]
            if f[0] and ROLES[f[0] - 1] == role:
                line = _MARKER.sub("", line, count=1)
            if begins or not out or out[-1][0] != role:
                out.append((role, [line]))
            else:
                out[-1][1].append(line)
        return [(role, "\n".join(body).strip()) for role, body in out]


def fit(starts: np.ndarray, moves: np.ndarray, emits: list[np.ndarray], smooth: float = 0.5) -> Model:
    log = lambda x: np.log((x + smooth) / (x + smooth).sum(axis=-1, keepdims=True))
    # A line goes on only with the role before it, and no transcript starts in the middle of a turn.
    allowed = np.array([[begins or role == before for role, begins in STATES] for before, _ in STATES])
    first = np.array([begins for _, begins in STATES])
    tables = [log(e) for e in emits]
    # A marker tells the role that it names also where the training transcripts have none; that of another role hardly
    # ever begins a line, unless training shows it.
    named = np.array([[0.05 if begins else 1.0] + [(0.95 if begins else 1e-4) if r == role else 1e-7 for r in ROLES] for role, begins in STATES])
    named /= named.sum(axis=1, keepdims=True)
    seen = emits[0] / np.maximum(emits[0].sum(axis=1, keepdims=True), 1)
    share = np.where(emits[0].sum(axis=1, keepdims=True) > 0, 1 - MARKED, 0)
    tables[0] = np.log(share * seen + (1 - share) * named)
    return Model(np.where(first, log(starts), -1e9), np.where(allowed, log(moves), -1e9), tables)


def transcripts(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, transcript, roles, sizes): turns in order, parted by blank lines, without their roles in the text.

    Blank lines within a turn are dropped; ties of the turn number are ordered by role and text; a null or blank text is no
    turn; a turn whose conv_id is null is a transcript of its own.
    """
    body = F.trim(F.regexp_replace(col(text), r"\n\s*\n", "\n"))
    rows = turns.where(col(text).isNotNull()).select(col(conv_id).alias("conv_id"), F.struct(col(turn).alias("t"), col(role).alias("r"), body.alias("b")).alias("x")).where("x.b <> ''")
    each = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    each = each.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("x").alias("x")))
    return each.select("conv_id", F.array_join("x.b", "\n\n").alias("transcript"), F.col("x.r").alias("roles"))


def fit_chat_model(known: DataFrame, *, conv_id: str = "conv_id", **options) -> Model:
    """From transcripts (conv_id, transcript, roles) outside the held-out fold; counts are summed by Spark."""
    n = len(STATES)

    def count(batches):
        starts, moves, emits = np.zeros(n), np.zeros((n, n)), [np.zeros((n, s)) for s in SIZES]
        for batch in batches:
            for text, roles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before, turn = None, -1
                if any(r not in ROLES for r in roles):
                    continue
                for _, f in line_features(text):
                    turn += f[1] != 2
                    if turn >= len(roles):
                        break
                    state = STATES.index((roles[turn], f[1] != 2))
                    if before is None:
                        starts[state] += 1
                    else:
                        moves[before, state] += 1
                    before = state
                    for table, value in zip(emits, f):
                        table[state, value] += 1
        values = np.concatenate([starts, moves.ravel(), *[e.ravel() for e in emits]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    rows = known.where(~held_out(conv_id) & F.col("transcript").isNotNull()).select("transcript", "roles")
    sums = rows.mapInArrow(count, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(n + n * n + n * sum(SIZES))
    for r in sums:
        flat[r["at"]] = r["value"]
    emits, at = [], n + n * n
    for s in SIZES:
        emits.append(flat[at : at + n * s].reshape(n, s))
        at += n * s
    return fit(flat[:n], flat[n : n + n * n].reshape(n, n), emits, **options)


def render(turns: list[tuple[str, str]]) -> str:
    """Each turn as its role between marks, its text, and an end mark, on lines of their own."""
    return "".join(f"<|{role}|>\n{body}\n<|end|>\n" for role, body in turns)


def format_chats(docs: DataFrame, model: Model, *, text: str = "transcript") -> DataFrame:
    """docs with turns (role, text), n_turns and rendered."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    turn = StructType([StructField("role", StringType()), StructField("text", StringType())])
    fields = [StructField("turns", ArrayType(turn)), StructField("n_turns", IntegerType()), StructField("rendered", StringType())]
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            found = [shared.value.turns(t) for t in texts.to_pylist()]
            return [
                pa.array([[{"role": r, "text": b} for r, b in x] for x in found], kind),
                pa.array([len(x) for x in found], pa.int32()), pa.array([render(x) for x in found], pa.string())]

        return compute

    return add_columns(docs, text, fields, make)
