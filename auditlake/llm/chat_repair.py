"""Conversation repair: generalised LR parsing with weighted edits over a graph-structured stack.

The roles of a conversation, by their initials, have to read (s?(ua)+)?: nothing, or a system turn at most and then pairs
of a user and an assistant turn.  As a grammar for an LR automaton:

    S -> empty | T | s T        T -> u a | T u a

Rows are dealt by conversation and sorted by turn; each conversation streams through one parser.  Its graph-structured
stack has one top for each state, linked to what lies below it.  A row is kept, given another role, or deleted, and turns
may be inserted before it; each edit pushes a top, reductions pop.  Equal states on top accept the same rest, so they are
merged: the least (cost, audit) stays.  A top carries its audit and the running digest of the repaired text, so no text is
kept: memory grows with the letters of the audit and the digests of rows seen, not with the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row costs that isn't deleted.
TRUNCATED = 5
#: The roles that a row can be given and that inserted turns have.
GIVEN = {"u": "user", "a": "assistant"}

# The automaton: states after shifts and gotos, and reductions (turns of the rule, then the state on T by the state below).
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 4: {"u": 6}, 5: {"u": 6}, 6: {"a": 7}}
REDUCE = {3: 2, 7: 3}
GOTO = {0: 4, 1: 5}
ACCEPT = (0, 4, 5)


class Node:
    """A top of the graph-structured stack, at the same time the cheapest way to it.

    stack is (state, the stack below).  order and tail place the audit among those of other tops: all audits up to a row's
    edit, none a beginning of another, are numbered in ASCII order, and tail holds the letters since.  A top is pushed with
    the step that led to it, (top before, letter, role and text or None); once its row is over, it has an audit, linked
    to those it continues, and the running digest of the repaired text instead.
    """

    __slots__ = ("stack", "cost", "order", "tail", "step", "audit", "digest", "begun")

    def __init__(self, stack, cost, order, tail, step=None):
        self.stack, self.cost, self.order, self.tail, self.step = stack, cost, order, tail, step
        self.audit, self.digest, self.begun = None, None, False

    def key(self):
        return self.cost, self.order, self.tail

    def settle(self) -> None:
        """Turn the steps since the row before into an audit and a digest."""
        steps, at = [], self
        while at.step:
            steps.append(at.step[1:])
            at = at.step[0]
        audit, digest, begun = at.audit, at.digest.copy(), at.begun
        for _, said in reversed(steps):
            if said is not None:
                digest.update((("\n" if begun else "") + f"{said[0]}:{said[1]}").encode("utf-8", "surrogatepass"))
                begun = True
        self.audit, self.digest, self.begun, self.step = (audit, "".join(letter for letter, _ in reversed(steps))), digest, begun, None


def shifted(stack: tuple, turn: str) -> tuple | None:
    """The stack after a shift of the turn and the reduction that it completes."""
    state = SHIFT.get(stack[0], {}).get(turn)
    if state is None:
        return None
    if state not in REDUCE:
        return state, stack
    for _ in range(REDUCE[state] - 1):
        stack = stack[1]
    return GOTO[stack[0]], stack


class Parser:
    """The repair of one conversation: push() rows in order, then finish()."""

    def __init__(self):
        start = Node((0, None), 0, 0, "")
        start.digest = hashlib.sha256()
        self.tops = {0: start}

    @staticmethod
    def _merge(tops: dict, node: Node, stack: tuple | None, cost: int, letter: str, said: tuple[str, str] | None) -> Node | None:
        """The new top, if the edit is possible and no better way to its state is there."""
        if stack is None:
            return None
        old = tops.get(stack[0])
        key = (node.cost + cost, node.order, node.tail + letter)
        if old is not None and old.key() <= key:
            return None
        new = tops[stack[0]] = Node(stack, *key, (node, letter, said))
        return new

    def _insert(self) -> dict:
        """The tops with turns inserted, cheapest first, as an inserted turn adds to the cost."""
        tops, todo = dict(self.tops), list(self.tops.values())
        while todo:
            node = min(todo, key=Node.key)
            todo.remove(node)
            if tops[node.stack[0]] is node:
                for turn, role in GIVEN.items():
                    if new := self._merge(tops, node, shifted(node.stack, turn), COST[INSERT], INSERT, (role, "")):
                        todo.append(new)
        return tops

    def push(self, role: str, text: str, gone: bool, truncated: bool) -> None:
        """One more row; gone: it has to be deleted."""
        tops: dict[int, Node] = {}
        more = TRUNCATED if truncated else 0
        for node in self._insert().values():
            self._merge(tops, node, node.stack, COST[DELETE], DELETE, None)
            if not gone:
                self._merge(tops, node, shifted(node.stack, role[:1]), COST[KEEP] + more, KEEP, (role, text))
                for turn, given in GIVEN.items():
                    self._merge(tops, node, shifted(node.stack, turn), COST[REROLE] + more, REROLE, (given, text))
        for at, node in enumerate(sorted(tops.values(), key=lambda x: (x.order, x.tail))):
            node.settle()
            node.order, node.tail = at, ""
        self.tops = tops

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired turns) of the cheapest repair."""
        tops = self._insert()
        best = min((tops[s] for s in ACCEPT if s in tops), key=Node.key)
        best.settle()
        letters, at = [], best.audit
        while at is not None:
            at, some = at
            letters.append(some)
        return best.cost, "".join(reversed(letters)), best.digest.hexdigest()


SAID = re.compile(r"[^ \t-\r]")
LEGAL = {"su", "ua", "au"}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TYPES = [pa.int64()] * 7 + [pa.string()] * 2


class Conversation:
    def __init__(self):
        self.parser, self.seen, self.before = Parser(), set(), None
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:  # ascending, so that a new turn differs from the last one
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        gone = cut = False
        if not SAID.search(text):
            gone = True
            self.blank += 1
        elif key in self.seen:
            gone = True
            self.duplicate += 1
        elif text.rstrip(" \t\n\v\f\r")[-1] not in ".!?":
            cut = True
            self.truncated += 1
        self.seen.add(key)
        self.parser.push(role, text, gone, cut)

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.parser.finish()


@lean
def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, there), sorted; rows that aren't there stand for their conversation only."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    now, own = (), None
    for batch in batches:
        done = []
        for conv, turn, role, text, there in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (conv,) != now:
                if own:
                    done.append((*now, *own.row()))
                now, own = (conv,), Conversation()
            if there:
                own.add(turn, role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), TYPES, strict=True)], names=names)
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, *own.row()), TYPES, strict=True)], names=names)


def damaged(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text, there) with faults put in by crc32 of `conv_id:turn` modulo `kinds`.

    0: the row isn't there; 1: its text is empty; 2: its text has no full stops, question or exclamation marks; 3: it comes twice;
    4: its role is user.  Null roles and texts are one space, and so are null conv_ids and turns in what is hashed.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % kinds
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role").alias("role"), shown("text").alias("text")).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.expr("if(kind = 3, 2, 1)").alias("times"))
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1, times)"))).drop("times", "_copy")


def repair(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """Faults and the cheapest repair of each conversation of rows (conv_id, turn, role, text); one row a conv_id.

    `there` is false for rows that only name their conversation.  Rows are taken by turn, nulls first, equal ones by role
    and text.  gaps: turn numbers missing between the first and the last; blank, duplicate, truncated: rows by their first fault;
    illegal: neighbours whose initials aren't su, ua or au; cost and audit of the cheapest edits (K keep, R rerole, D delete, I
    insert), ties by ASCII order; repaired_sha256: of the repaired `role:text`, newline-joined.
    Null roles and texts count as one space; a null conv_id is a conversation of its own; repeated rows are duplicates;
    conversations without rows have zeros, an empty audit and the digest of nothing; empty tables give no rows; further
    columns are ignored; texts may be of any length.  A conversation is parsed in order, by one task, as a stream: of each
    row it holds 16 bytes and a letter for each stack top.
    """
    shown = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role"), shown("text"), (F.lit(True) if there is None else there).alias("there"))
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repair, RESULT)
