"""Transcript parsing: a hidden Markov model over speaker markers and line features, then canonical turns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stipple.llm.common import cut, kind_of, prepare, table

ROLES = ("system", "user", "assistant")
#: States: a role's first line and its further lines.
STATES = tuple(f"{x}-{r}" for r in ROLES for x in ("first", "more"))

# Words by which transcripts mark their speakers.
MARKERS = {
    "system": "system sys instruction instructions context prompt developer setup",
    "user": "user human you question q customer client me student prompter asker visitor patient",
    "assistant": "assistant ai bot answer a agent model response chatbot gpt support teacher expert",
}
_NAMES = {w: r for r, ws in MARKERS.items() for w in ws.split()}
#: A marker: optional decoration, a name, and a colon, an angle bracket or the like.
_MARKER = re.compile(r"^\s*(?:[#*>\-\[(<|_]{0,4}\s*)(?:im_start\|>\s*)?([A-Za-z]{1,12})(?:\s*(?:[\])>|*_]{0,4}\s*[:：]\s*[*_]{0,3}|\|>|[\]>])\s*|(?<=#\s)\s*$)", re.I)

#: Numbers of values of the features: marker (none, three roles), place (first line, after a blank line, other), length, last character.
SIZES = (4, 3, 12, 4)
#: Training turns have their role beside the text, not marked in it, so this share of first lines is taken to be marked;
#: a line with another role's marker, or a further line with one, is as rare as one in so many.
MARKED, STRAY = 0.5, 10_000
#: The share of turns that begin without a blank line before them.
CLOSE = 0.01


def marker(line: str) -> tuple[int, str]:
    """The marker's role (0: none) and the line without it."""
    m = _MARKER.match(line)
    role = _NAMES.get(m[1].lower()) if m else None
    return (ROLES.index(role) + 1, line[m.end() :]) if role else (0, line)


def features(line: str, place: int) -> tuple[int, int, int, int]:
    text = line.rstrip()
    end = text[-1:]
    return marker(line)[0], place, min(11, len(line).bit_length()), 1 if end in ("?", "？") else 2 if end in (".", "!", "…") else 3 if end else 0


def lines_of(transcript: str) -> list[tuple[str, int]]:
    """Lines that aren't blank, with their place: 0 the first, 1 after a blank line, 2 other."""
    out, gap = [], False
    for line in transcript.split("\n"):
        if not line.strip():
            gap = True
        else:
            out.append((line, 1 if gap and out else 2 if out else 0))
            gap = False
    return out


class Model:
    """Log probabilities of the first state, the steps, and each feature's values, from counts with one added."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        norm = lambda x: np.log((x + 1.0) / (x + 1.0).sum(-1, keepdims=True))
        s = len(STATES)
        allowed = np.zeros((s, s))
        for a in range(s):
            for b in range(s):  # a further line follows lines of its own turn only
                allowed[a, b] = 0.0 if b % 2 == 0 or b // 2 == a // 2 else -np.inf
        self.start = norm(start) + np.array([0.0, -np.inf] * (s // 2))
        self.step = norm(step) + allowed
        marked = np.full((s, 4), 1.0 / STRAY)
        for a in range(s):
            marked[a, 0] = 1 - MARKED if a % 2 == 0 else 1.0
            if a % 2 == 0:
                marked[a, 1 + a // 2] += MARKED
        close = np.zeros_like(emit[1])
        close[::2, 2] = CLOSE * emit[1][::2].sum(1)
        self.emit = [np.log(marked / marked.sum(1, keepdims=True)), norm(emit[1] + close), *map(norm, emit[2:])]

    def scores(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        at = np.array(rows)
        return sum(e[:, at[:, k]].T for k, e in enumerate(self.emit))

    def viterbi(self, rows: list[tuple[int, ...]], before: np.ndarray | None = None, last: int | None = None) -> list[int]:
        """The likeliest states; of equal ones the first in STATES.

        For a stretch of a transcript: ``before`` has the score of each state on the line before it, ``last`` is the
        state of its last line.
        """
        if not rows:
            return []
        e = self.scores(rows)
        best, back = (self.start if before is None else (before[:, None] + self.step).max(0)) + e[0], []
        for x in e[1:]:
            way = best[:, None] + self.step
            back.append(way.argmax(0))
            best = way.max(0) + x
        out = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def across(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """The best score of a stretch for each state before it (down) and each of its last line (across)."""
        s = len(STATES)
        out = np.where(np.eye(s, dtype=bool), 0.0, -np.inf)
        for x in self.scores(rows) if rows else ():
            out = (out[:, :, None] + self.step[None]).max(1) + x
        return out

    def begun(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """The best score of a stretch that begins a transcript, for each state of its last line."""
        e = self.scores(rows)
        best = self.start + e[0]
        for x in e[1:]:
            best = (best[:, None] + self.step).max(0) + x
        return best


def parse(transcript: str | None, model: Model) -> list[tuple[str, str]]:
    """Turns (role, text without its marker) of a transcript; null or blank: none."""
    lines = lines_of(transcript or "")
    out: list[tuple[str, list[str]]] = []
    for (line, _), s in zip(lines, model.viterbi([features(x, p) for x, p in lines]), strict=True):
        role = ROLES[s // 2]
        if s % 2 == 0:
            out.append((role, []))
        out[-1][1].append(marker(line)[1] if s % 2 == 0 else line)
    return [(r, "\n".join(x).strip()) for r, x in out]


def render(role: str, text: str) -> str:
    """A turn in canonical form; a text can't end its turn early, since its own delimiters are escaped."""
    return f"<|{role}|>\n{text.replace('<|', '<\\|')}\n<|end|>"


def train(turns: DataFrame) -> Model:
    """Counts over all labelled turns (columns conv, turn, role, text), gathered by grouped aggregation.

    Turns of other roles than ROLES, and null ones, are not counted.  A turn is followed by the one of the next
    number.  The driver gets one row for each feature's value and state, and each pair of roles: less than 200.
    """
    known = turns.filter(F.col("role").isin(*ROLES)).select("conv", "turn", "role", "text")
    counts = known.mapInArrow(_count, "kind int, state int, value int, n long").groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))
    role = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), c).cast("int") - 1
    after = known.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = known.select("conv", "turn", "role").join(after, ["conv", "turn"]).groupBy("role", "next").agg(F.count(F.lit(1)).alias("n"))
    begun = known.filter("turn = 0").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.unionByName(pairs.select(F.lit(10).alias("kind"), role(F.col("role")).alias("state"), role(F.col("next")).alias("value"), "n")).unionByName(begun.select(F.lit(11).alias("kind"), role(F.col("role")).alias("state"), F.lit(0).alias("value"), "n")).collect()
    s = len(STATES)
    start, step, emit = np.zeros(s), np.zeros((s, s)), [np.zeros((s, k)) for k in SIZES]
    follow = np.zeros(s // 2)
    for kind, state, value, n in rows:
        if kind < 4:
            emit[kind][state, value] += n
        elif kind == 5:
            step[2 * state, 2 * state + 1] += n
        elif kind == 6:
            step[2 * state + 1, 2 * state + 1] += n
        elif kind == 10:
            follow[state] += n
    for kind, state, value, n in rows:
        if kind == 11:
            start[2 * state] += n
        elif kind == 10:  # a turn ends after its first line or after a further one
            more = step[2 * state, 2 * state + 1] / max(1.0, emit[1][2 * state].sum())
            step[2 * state, 2 * value] += n * (1 - more)
            step[2 * state + 1, 2 * value] += n * more
    return Model(start, step, emit)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of: dict[tuple[int, int, int], int] = {}

    def add(*key: int) -> None:
        of[key] = of.get(key, 0) + 1

    for b in batches:
        for turn, role, text in zip(*(b.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True):
            r = ROLES.index(role)
            for i, (line, place) in enumerate(lines_of(text or "")):
                state = 2 * r + (i > 0)
                for k, v in enumerate(features(line, place if i else 1 if turn else 0)):
                    add(k, state, v)
                if i:
                    add(5 if i == 1 else 6, r, 0)
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in of], pa.int32()) for i in range(3)] + [pa.array(list(of.values()), pa.int64())], names=["kind", "state", "value", "n"])


def parse_transcripts(transcripts: DataFrame, model: Model, id_col: str = "id", text_col: str = "transcript") -> DataFrame:
    """Recover the turns of transcripts: ``id``, ``turn`` int from 0, ``role``, ``text`` and ``rendered``.

    A null, empty or blank transcript has no turns and so no rows.  Null ids and repeated rows pass through; an
    empty table gives none; other columns are ignored whatever their names.
    """
    prepare(transcripts.sparkSession)
    src = transcripts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, turn, role, texts, shown = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, (r, x) in enumerate(parse(t, model)):
                    take.append(i), turn.append(k), role.append(r), texts.append(x), shown.append(render(r, x))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(take, pa.int64())), pa.array(turn, pa.int32()), *(pa.array(x, pa.string()) for x in (role, texts, shown))], names=["id", "turn", "role", "text", "rendered"])

    return src.mapInArrow(run, f"id {kind_of(src.schema['id'].dataType)}, turn int, role string, text string, rendered string")


def held_out(conv: Column) -> Column:
    """A fifth of the conversations, by a hash of their id; no model is trained on these."""
    return F.pmod(F.xxhash64(F.lit(5), conv), F.lit(5)) == 0


Turns = list[tuple[int | None, str | None]]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, Turns]]:
    """(page, conversation, its turns on the page), from rows sorted by these."""
    now, turns = None, []
    for b in batches:
        for page, conv, turn, text in zip(*(b.column(c).to_pylist() for c in ("page", "conv", "turn", "text")), strict=True):
            if (page, conv) != now:
                if now:
                    yield *now, turns
                now, turns = (page, conv), []
            turns.append((turn, text))
    if now:
        yield *now, turns


def _rows(turns: Turns, first: bool) -> tuple[list[tuple[int, ...]], list[list[str]]]:
    """Features of the lines of turns that are parted by blank lines, and the lines of each turn.  first: none before."""
    rows, own = [], []
    for _, text in turns:
        lines = lines_of(text or "")
        own.append([x for x, _ in lines])
        rows += [features(x, place if i else 0 if first and not rows else 1) for i, (x, place) in enumerate(lines)]
    return rows, own


def _chained(edges: list[dict], model: Model) -> dict[tuple[int, object], tuple[bool, np.ndarray | None, int | None]]:
    """For stretches of conversations on several pages: whether lines come before, their scores, and the last state.

    edges: the first and last stretch of every page, in order.  Scores are carried forward through the stretches, then
    states backward, so that the path is the one that is likeliest for the whole conversation.
    """
    out: dict[tuple[int, object], tuple[bool, np.ndarray | None, int | None]] = {}
    at = 0
    while at < len(edges):
        end = at + 1
        while end < len(edges) and edges[end]["conv"] == edges[at]["conv"] and edges[end]["page"] != edges[end - 1]["page"]:
            end += 1
        before, scores = [], None
        for e in edges[at:end] if end - at > 1 else ():
            before.append(scores)
            if e["begun"]:
                scores = np.array(e["begun"]) if scores is None else (scores[:, None] + np.array(e["across"]).reshape(len(STATES), -1)).max(0)
        state = None if scores is None else int(scores.argmax())
        for e, own in reversed(list(zip(edges[at:end], before, strict=False))):
            out[e["page"], e["conv"]] = own is not None, own, state
            if e["begun"] and own is not None:
                state = int((own + np.array(e["across"]).reshape(len(STATES), -1)[:, state]).argmax())
        at = end
    return out


def recover_roles(conversations: DataFrame, model: Model) -> DataFrame:
    """Roles of labelled conversations (conv_id, turn, role, text) as their unmarked transcripts show them.

    A conversation's turns, in order and parted by blank lines, make its transcript: the column ``role`` is not read,
    and borders of turns are not given.  Returns one row for each distinct turn: ``conv_id``, ``turn``, ``n_lines``
    long, ``recovered`` (the decoded role of its first line, null if it has none), ``n_turns`` long (turns that the
    parser begins among its lines, 1 if it is right), ``rendered`` (these in canonical form, without their markers,
    and null without lines) and ``held_out`` boolean.  Repeated turns (same conversation, number and text) count once;
    turns of one number follow each other by a hash of their text, then by it; a null number comes first, a null text
    has no lines, and turns without a conversation form one.  An empty table gives none.

    Turns are dealt by ranges of (conversation, number, hash), so that a long conversation lies on several pages.  Each
    page gives the best scores through its first and last conversation, from every state to every state; the driver
    chains these (two rows a page), and pages are decoded with what comes before and after them: nothing depends on
    where pages are cut.
    """
    spark = conversations.sparkSession
    prepare(spark)
    src = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text")).distinct()
    order = ["conv", "turn", "hash"]
    pages = cut(src.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).withColumn("page", F.spark_partition_id()))
    kind = kind_of(src.schema["conv"].dataType)
    sorted_ = pages.repartition("page").sortWithinPartitions("page", *order, "text").select("page", "conv", "turn", "text")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, object, list, list]] = []
        page = None

        def told(p: int, conv: object, turns: Turns) -> tuple[int, object, list, list]:
            rows = _rows(turns, False)[0]
            return p, conv, model.begun(_rows(turns, True)[0]).tolist() if rows else [], model.across(rows).ravel().tolist()

        last = None
        for p, conv, turns in _stretches(batches):
            if p != page:
                held += [told(*last)] if last else []
                held.append(told(p, conv, turns))
                page, last = p, None
            else:
                last = (p, conv, turns)
        held += [told(*last)] if last else []
        kinds = (pa.int32(), of_conv, pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names=["page", "conv", "begun", "across"])

    of_conv = to_arrow_type(src.schema["conv"].dataType)
    found = [r.asDict() for r in sorted_.mapInArrow(edges, f"page int, conv {kind}, begun array<double>, across array<double>").collect()]
    seen: dict[int, list[dict]] = {}
    for e in found:  # the first stretch of a page was told before its last
        seen.setdefault(e["page"], []).append(e)
    chained = _chained([e for p in sorted(seen) for e in seen[p]], model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, number, n, role, begins, shown = [], [], [], [], [], []
        size = 0
        names = ["conv_id", "turn", "n_lines", "recovered", "n_turns", "rendered"]
        kinds = (of_conv, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())

        def out() -> pa.RecordBatch:
            cols = (convs, number, n, role, begins, shown)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            for c in cols:
                c.clear()
            return batch

        for page, conv, turns in _stretches(batches):
            later, before, last = chained.get((page, conv), (False, None, None))
            rows, lines = _rows(turns, not later)
            states, at = model.viterbi(rows, before, last), 0
            for (turn, _), own in zip(turns, lines, strict=True):
                now = states[at : at + len(own)]
                at += len(own)
                parts: list[tuple[str, list[str]]] = []
                for k, (line, state) in enumerate(zip(own, now, strict=True)):
                    if state % 2 == 0 or not k:
                        parts.append((ROLES[state // 2], []))
                    parts[-1][1].append(marker(line)[1] if state % 2 == 0 else line)
                convs.append(conv), number.append(turn), n.append(len(own)), role.append(parts[0][0] if own else None)
                begins.append(sum(x % 2 == 0 for x in now)), shown.append("\n".join(render(r, "\n".join(x).strip()) for r, x in parts) if own else None)
                size += len(shown[-1] or "")
            if size > 4 << 20:
                yield out()
                size = 0
        yield out()

    out = sorted_.mapInArrow(run, f"conv_id {kind}, turn long, n_lines long, recovered string, n_turns long, rendered string")
    return out.withColumn("held_out", held_out(F.col("conv_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: roles and canonical form of every turn of `conversations`, from unmarked transcripts without given borders."""
    rows = table(spark, sf_dir, "conversations")
    labelled = rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text").filter(~held_out(F.col("conv")))
    return recover_roles(rows, train(labelled))
