"""Chat formatting: minimum-cost repair of roles by dynamic programming over an automaton of legal turns."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
#: The automaton: what may follow the turn emitted last. A conversation is empty or ends after ASSISTANT.
LEGAL = {"": (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ("", ASSISTANT)
#: Costs of joining a turn to the one before, of giving it another role (both, if it joins a turn of another role) and of an
#: empty turn put in.
MERGE, RELABEL, INSERT = 2, 5, 4
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
#: Put between the texts of joined turns.
GLUE = "\n\n"
OUT = "conv_id long, n_turns long, n_out long, cost long, n_merged long, n_relabelled long, n_inserted long, rendered string"


@functools.lru_cache(maxsize=65536)
def _cached(roles: tuple) -> tuple:
    return _repair(roles)


def _repair(roles: tuple) -> tuple:
    """(cost, steps): least-cost steps ("emit", role), ("merge", role), ("insert", role); each turn is emitted or merged, in order.

    Of equal costs, that with fewer steps put in, then that which emits more turns, then the first in the order of LEGAL."""
    # state: role emitted last -> (cost, inserted, merged, link to the steps before)
    start = {"": (0, 0, 0, None)}

    def inserted(states: dict) -> dict:
        states = dict(states)
        for _ in range(3):  # no two roles are further apart
            for at in list(states):
                cost, ins, mrg, link = states[at]
                for role in LEGAL[at]:
                    new = (cost + INSERT, ins + 1, mrg, (("insert", role), link))
                    if role not in states or new[:3] < states[role][:3]:
                        states[role] = new
        return states

    states = start
    for r in roles:
        new: dict = {}
        wide = inserted(states)
        for at, (cost, ins, mrg, link) in wide.items():
            for role in LEGAL[at]:
                got = (cost + (role != r) * RELABEL, ins, mrg, (("emit", role), link))
                if role not in new or got[:3] < new[role][:3]:
                    new[role] = got
            if at:
                got = (cost + MERGE + (at != r) * RELABEL, ins, mrg + 1, (("merge", at), link))
                if at not in new or got[:3] < new[at][:3]:
                    new[at] = got
        states = new
    wide = inserted(states) if roles else states
    cost, _, _, link = min((wide[s] for s in FINAL if s in wide), key=lambda x: x[:3])
    steps = []
    while link:
        step, link = link
        steps.append(step)
    return cost, tuple(reversed(steps))


def repair(roles: tuple) -> tuple:
    """The cheapest repair of a sequence of roles; short sequences, of which most tables have few, are remembered."""
    return _cached(roles) if len(roles) <= 64 else _repair(roles)


def apply_steps(steps: tuple, texts: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    at = 0
    for what, role in steps:
        if what == "insert":
            out.append((role, []))
            continue
        if what == "emit":
            out.append((role, []))
        out[-1][1].append(texts[at])
        at += 1
    return [(role, GLUE.join(t)) for role, t in out]


def render(turns: list[tuple[str, str]]) -> str:
    """Marks of the template inside a text are broken by a zero-width space, so that rendered turns can be told apart."""
    safe = lambda t: t.replace("<|im_", "<​|im_")
    return "".join(TEMPLATE.format(role=r, text=safe(t)) for r, t in turns)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_out, cost, n_merged, n_relabelled, n_inserted, rendered): each conversation repaired at least cost,
    so that an optional system turn is followed by turns of user and assistant alternately, assistant last.

    Turns stand in the order of turn, then role, then text (null first); repeated rows are repeated turns. Roles are compared
    trimmed and in lower case; a null or unknown role must be given another one. Null and empty texts are empty turns and stay.
    A null conv_id is a conversation of its own. An empty table gives none. Other columns are not read. A conversation
    is put together in one task, in time linear in its turns; conversations are spread by conv_id."""
    role = F.lower(F.trim(conversations["role"].cast("string")))
    turn = F.struct(conversations["turn"].cast("long").alias("n"), role.alias("r"), F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("t"))
    chats = conversations.groupBy(conversations["conv_id"].cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda x: x["r"]).alias("roles"), F.transform("turns", lambda x: x["t"]).alias("texts"))

    def run(batches):
        for b in batches:
            rows = []
            for conv, roles, texts in zip(*(b.column(k).to_pylist() for k in range(3))):
                cost, steps = repair(tuple(roles))
                turns = apply_steps(steps, texts)
                kinds = [w for w, _ in steps]
                kept = [r for w, r in steps if w != "insert"]
                rows.append((conv, len(roles), len(turns), cost, kinds.count("merge"), sum(a != b for a, b in zip(roles, kept)), kinds.count("insert"), render(turns)))
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.string())], names=[x.split()[0] for x in OUT.split(", ")])

    return chats.mapInArrow(run, OUT)
