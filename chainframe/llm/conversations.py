"""Repairing the turn structure of conversations at least cost.

Rows are dealt to tasks by conversation and sorted by turn, so a task streams through its conversations. Each batch of whole
conversations is repaired by one recursive DuckDB query: a recursion takes one further turn of all conversations at
once and keeps, for each state of the grammar, the least cost and of the cheapest edits the least audit string. Costs depend on
the letters alone, so no cheapest audit begins another one and keeping the least of each state is exact.

A conversation longer than a batch goes through the same query in stretches: the states' costs and audits are carried on (only where the audits
differ; what they share is settled), texts met so far are kept as digests in a DuckDB table, which may spill, and its rows wait on the worker's disk until the
audit is known. Its hash runs over all its text in order, so one task reads it, but never holds it.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.text import tidy

#: Rows repaired by one query, unless one more conversation ends later; text bytes of them, about; DuckDB's memory in a worker.
BATCH, BATCH_BYTES, MEMORY = 4_096, 32 << 20, "256MB"

#: Grammar (s?(ua)+)?: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; it may end in 0 and 3.
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
TURNS = {0: 2, 1: 2, 2: 3, 3: 2}
#: The cheapest end from each state: cost and letters.
ENDS = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}


def _edges() -> str:
    """Ways to take a row from one state to the next, after up to two insertions: what the row needs (or the edit), states, cost, letters."""
    out = []
    for g in range(4):
        h, cost, letters = g, 0, ""
        for _ in range(3):
            out.append(("delete", g, h, cost + 3, letters + "D"))
            out.append(("rerole", g, TURNS[h], cost + 2, letters + "R"))
            out += [(i, g, to, cost, letters + "K") for (i, at), to in KEEPS.items() if at == h]
            h, cost, letters = TURNS[h], cost + 2, letters + "I"
            if h == g:
                break
    return ", ".join(map(str, out))


_WHITE = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"

#: rows (c, k, turn, role, text): each row's initial and first fault.
_FAULTS = f"""
CREATE OR REPLACE TEMP TABLE faults AS
WITH x AS (SELECT c, k, turn, left(role, 1) AS i, right(rtrim(text, {_WHITE}), 1) AS tail, row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 OR (SELECT count(*) FROM seen) > 0 AND EXISTS (SELECT 1 FROM seen s WHERE s.role = rows.role AND s.digest = sha256(rows.text)) AS again FROM rows)
SELECT c, k, turn, i, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM x"""

_COUNTS = """
SELECT c, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(before IS NOT NULL AND concat(before, i) NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(i, k) AS first, arg_max(i, k) AS last
FROM (SELECT *, lag(i) OVER (PARTITION BY c ORDER BY k) AS before FROM faults) GROUP BY c ORDER BY c"""

_STATES = """
WITH RECURSIVE s AS (
  SELECT c, 0 AS k, g, cost, audit FROM seeds
  UNION ALL
  SELECT c, k, g, best.cost, best.audit FROM (
    SELECT s.c, r.k, e.h AS g, min({'cost': s.cost + e.cost + CASE WHEN e.edit <> 'delete' AND r.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': concat(s.audit, e.letters)}) AS best
    FROM s JOIN faults r ON r.c = s.c AND r.k = s.k + 1 JOIN edges e ON e.g = s.g AND (e.edit = 'delete' OR r.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'rerole' OR e.edit = r.i))
    GROUP BY s.c, r.k, e.h))
SELECT s.c, g, cost, audit FROM s JOIN (SELECT seeds.c, coalesce(max(k), 0) AS n FROM (SELECT DISTINCT c FROM seeds) seeds LEFT JOIN faults USING (c) GROUP BY seeds.c) l ON l.c = s.c AND l.n = s.k ORDER BY s.c, g"""


def _connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder})
    con.execute(f"CREATE TEMP TABLE edges AS SELECT * FROM (VALUES {_edges()}) t(edit, g, h, cost, letters)")
    con.execute("CREATE TEMP TABLE seen (role VARCHAR, digest VARCHAR)")
    return con


def _run(con, rows: pa.Table, seeds: list[tuple]) -> tuple[list[tuple], dict[int, list[tuple]]]:
    """Counts by conversation, and each one's states (g, cost, audit) after its rows."""
    con.register("rows", rows)
    con.execute(_FAULTS)
    c, g, cost, audit = zip(*seeds)
    con.register("seeds", pa.table({"c": pa.array(c, pa.int32()), "g": pa.array(g, pa.int32()), "cost": pa.array(cost, pa.int64()), "audit": pa.array(audit, pa.string())}))
    states: dict[int, list[tuple]] = {}
    for c, *state in con.execute(_STATES).fetchall():
        states.setdefault(c, []).append(tuple(state))
    counts = con.execute(_COUNTS).fetchall()
    con.unregister("rows")
    con.unregister("seeds")
    return counts, states


def _closed(states: list[tuple]) -> tuple[int, str]:
    return min((cost + ENDS[g][0], audit + ENDS[g][1]) for g, cost, audit in states)


class _Digest:
    """The hash of repaired rows `role:text`, joined by line feeds."""

    def __init__(self):
        self.hash, self.state, self.some = hashlib.sha256(), 0, False

    def add(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def edit(self, letters: Iterator[str], rows: Iterator[tuple[str, str]]) -> None:
        for letter in letters:
            if letter == "D":
                next(rows)
                continue
            role, text = next(rows) if letter in "KR" else ("", "")
            if letter == "K":
                self.state = KEEPS[role[:1], self.state]
            else:
                self.state = TURNS[self.state]
                role = "user" if self.state == 2 else "assistant"
            self.add(role, text)


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, x in zip(_NAMES, columns)], _NAMES)


def _gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def _whole(con, table: pa.Table, c: np.ndarray) -> pa.RecordBatch:
    """Rows of whole conversations, numbered c from 0; rows that are gone keep their conversation listed."""
    ids, first = table["conv_id"].combine_chunks(), np.flatnonzero(np.diff(c, prepend=-1))
    here = ~table["gone"].to_numpy(zero_copy_only=False)
    live, own = table.filter(pa.array(here)), c[here]
    k = np.arange(len(own)) - np.searchsorted(own, own) + 1
    rows = pa.table({"c": pa.array(own.astype(np.int32)), "k": pa.array(k.astype(np.int32)), "turn": live["turn"], "role": live["role"], "text": live["text"]})
    counts, states = _run(con, rows, [(n, 0, 0, "") for n in range(len(first))])
    known = {x[0]: x[1:] for x in counts}
    roles, texts, out, at = live["role"].to_pylist(), live["text"].to_pylist(), [], 0
    for n, conv in enumerate(ids.take(pa.array(first)).to_pylist()):
        count, low, high, turns, blank, duplicate, truncated, illegal, *_ = known.get(n, (0, None, None, 0, 0, 0, 0, 0))
        cost, audit = _closed(states[n])
        digest = _Digest()
        digest.edit(iter(audit), iter(zip(roles[at : at + count], texts[at : at + count])))
        at += count
        out.append((conv, _gaps(low, high, turns), blank, duplicate, truncated, illegal, cost, audit, digest.hash.hexdigest()))
    return _table(out)


class _Long:
    """One conversation that comes in several stretches."""

    def __init__(self, con, conv, folder: str):
        self.con, self.conv, self.path = con, conv, os.path.join(folder, "rows")
        self.file = open(self.path, "wb")  # noqa: SIM115  closed in end()
        self.states, self.settled = [(0, 0, "")], []
        self.low = self.high = self.last_turn = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, table: pa.Table) -> None:
        table = table.filter(pa.array(~table["gone"].to_numpy(zero_copy_only=False)))
        for at in range(0, table.num_rows, BATCH):
            part = table.slice(at, BATCH)
            n = part.num_rows
            rows = pa.table({"c": pa.array(np.zeros(n, np.int32)), "k": pa.array(np.arange(1, n + 1, dtype=np.int32)), "turn": part["turn"], "role": part["role"], "text": part["text"]})
            counts, states = _run(self.con, rows, [(0, *x) for x in self.states])
            self.con.register("rows", rows)
            self.con.execute("INSERT INTO seen SELECT DISTINCT role, sha256(text) FROM rows")
            self.con.unregister("rows")
            _, _, low, high, turns, blank, duplicate, truncated, illegal, first, last = counts[0]
            if low is not None:
                self.low = low if self.low is None else self.low
                self.turns += turns - (low == self.high)
                self.high = high
            self.illegal += illegal + (self.last is not None and self.last + first not in ("su", "ua", "au"))
            self.last = last
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
            shared = len(os.path.commonprefix([x[2] for x in states[0]]))
            self.settled.append(states[0][0][2][:shared])
            self.states = [(g, cost, audit[shared:]) for g, cost, audit in states[0]]
            pickle.dump((part["role"].to_pylist(), part["text"].to_pylist()), self.file)

    def _rows(self) -> Iterator[tuple[str, str]]:
        with open(self.path, "rb") as file:
            while True:
                try:
                    roles, texts = pickle.load(file)  # noqa: S301  written above
                except EOFError:
                    return
                yield from zip(roles, texts)

    def end(self) -> pa.RecordBatch:
        self.file.close()
        cost, tail = _closed(self.states)
        audit = "".join([*self.settled, tail])
        digest = _Digest()
        digest.edit(iter(audit), self._rows())
        os.remove(self.path)
        self.con.execute("DELETE FROM seen")
        return _table([(self.conv, _gaps(self.low, self.high, self.turns), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hash.hexdigest())])


def _repaired(batch_rows: int, batch_bytes: int):
    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp()
        con = _connection(folder)
        held, size, long = [], (0, 0), None

        def numbered(table: pa.Table) -> np.ndarray:
            ids, null = table["conv_id"].combine_chunks(), table["conv_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy()
            new = np.zeros(len(plain), np.int64)
            new[1:] = (plain[1:] != plain[:-1]) | (null[1:] != null[:-1])
            return np.cumsum(new)

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, batch_rows):
                    held.append(batch.slice(at, batch_rows))
                    size = (size[0] + held[-1].num_rows, size[1] + held[-1].nbytes)
                    if size[0] < batch_rows and size[1] < batch_bytes:
                        continue
                    table = pa.Table.from_batches(held)
                    c = numbered(table)
                    begin = 0
                    if long is not None:  # what goes on of it
                        begin = len(c) if table["conv_id"][0].as_py() != long.conv else int(np.searchsorted(c, 1))
                        begin = 0 if table["conv_id"][0].as_py() != long.conv else begin
                        long.add(table.slice(0, begin))
                        if begin < len(c):
                            yield long.end()
                            long = None
                    last = int(np.searchsorted(c, c[-1]))  # the last conversation may go on
                    if last > begin:
                        yield _whole(con, table.slice(begin, last - begin), c[begin:last] - c[begin])
                        begin = last
                    rest = table.slice(begin)
                    if long is None and rest.num_rows and (rest.num_rows >= batch_rows or rest.nbytes >= batch_bytes):
                        long = _Long(con, rest["conv_id"][0].as_py(), folder)
                        long.add(rest)
                        rest = rest.slice(rest.num_rows)
                    held = rest.to_batches() if rest.num_rows else []
                    size = (rest.num_rows, rest.nbytes if rest.num_rows else 0)
            if held:
                table = pa.Table.from_batches(held)
                c = numbered(table)
                begin = 0
                if long is not None and table["conv_id"][0].as_py() == long.conv:
                    begin = int(np.searchsorted(c, 1))
                    long.add(table.slice(0, begin))
                if long is not None:
                    yield long.end()
                    long = None
                if begin < len(c):
                    yield _whole(con, table.slice(begin), c[begin:] - c[begin])
            elif long is not None:
                yield long.end()
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)
            tidy()

    return repaired


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32 of `conv_id:turn`, modulo 20; null roles and texts are one space, as are nulls in what is hashed."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(hit == 4, "user").otherwise(blank("role"))
    times = F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (hit == 0).alias("gone"), times.alias("time")).drop("time")


def repaired(rows: DataFrame, batch_rows: int = BATCH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, gone): faults, cost and audit of the cheapest repair, and the hash of the repaired rows.

    Rows are taken by turn, nulls first; rows of one turn by role and text, so ties that are left are equal rows. Rows that are gone
    only list their conversation. A null conv_id is a conversation as any other. An empty table gives an empty result.
    """
    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(_repaired(batch_rows, batch_bytes), _OUT)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, damaged by rule and repaired at least cost.

    Repeated rows are duplicates of each other; very long texts are rows as others (a batch is bounded in bytes, but holds one row whole); a very long conversation is
    read in stretches. A conversation of which no row is left has zeros, an empty audit and the hash of nothing. Columns other than conv_id, turn, role and text are ignored.
    """
    return repaired(damaged(conversations))
