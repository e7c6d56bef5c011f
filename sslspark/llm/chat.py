"""Chat formatting by token-level assembly.

A turn is ``### User: ``, the text and ``\\n</turn>\\n`` (or ``### System: ``,
``### Assistant: ``; another role is written out as ``### Role: name ### Text: ``).
Each mark is one reserved id beyond the tokenizer's vocabulary.  The segments
between marks are encoded separately, so no token reaches across a mark, and
special tokens' strings in a text are ordinary text; the reserved ids are
spliced in between.  The loss mask is a prefix sum over the tokens: +1 where
a text to be learned begins, -1 where it ends.

A control string in a text or role is escaped by a backslash before it (and
before the backslashes that already stand there); one backslash less reads it
back.  Marks follow a space or a line end, never a backslash, so a text's last
character can't hide one.

A piece is one turn, so conversations of any length stay spread out; ``place``
gives each piece its place in the conversation by two-pass prefix sums over
ranges of turns.

Defined cases: a null text or role is empty; turns with equal numbers are in
order of role, then of the text's hash; null turn numbers come first; equal
rows are separate turns; rows with a null conversation id are one conversation;
an empty table gives no rows; columns besides id, turn, role and text are not
read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sslspark.llm.common import stored

#: The template: fixed values, their order gives the reserved ids.
HEADS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
ROLE, TEXT, END = "### Role: ", " ### Text: ", "\n</turn>\n"
MARKS = [*HEADS.values(), ROLE, TEXT, END]
CONTROLS = [m.strip() for m in MARKS]

_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({_CONTROL})")
# a mark's own space or line end may follow a text's last backslash; its control string never does
_MARK = re.compile("|".join(re.escape(m[:len(m) - len(m.lstrip())]) + r"(?<!\\)" + re.escape(m.lstrip()) for m in MARKS))
ORDER = ("turn", "role", "tie")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[list[str], list[str]]:
    """Marks and the segments after them (escaped) of a turn."""
    if role in HEADS:
        return [HEADS[role], END], [escape(text), ""]
    return [ROLE, TEXT, END], [escape(role), escape(text), ""]


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    marks, parts = _MARK.findall(formatted), _MARK.split(formatted)
    if parts[0] or len(parts) != len(marks) + 1:
        raise ValueError("the string does not begin with a mark")
    out, role = [], None
    names = {v: k for k, v in HEADS.items()}
    for mark, segment in zip(marks, parts[1:], strict=True):
        if mark == ROLE:
            role = unescape(segment)
        elif mark in names:
            out.append((names[mark], unescape(segment)))
        elif mark == TEXT:
            out.append((role, unescape(segment)))
        elif segment:
            raise ValueError("text between turns")
    return out


class Coder:
    """Ids of segments, and the bytes of ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.first_mark = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.mark_id = {m: self.first_mark + k for k, m in enumerate(MARKS)}
        # byte-level vocabularies write each byte as one character: printable ones as themselves
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.bytes = [b""] * (self.first_mark + len(MARKS))
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for mark, k in self.mark_id.items():
            self.bytes[k] = mark.encode()

    def encode(self, segments: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(segments), 256):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(segments[at:at + 256], add_special_tokens=False)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The formatted string that the ids spell, marks included."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def assemble(code: Coder, turns: list[tuple[str, str]], learn: frozenset[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Formatted strings, ids and masks of turns (role, text)."""
    marks, segments, whose, learned = [], [], [], []
    for k, (role, text) in enumerate(turns):
        m, s = render(role, text)
        marks += m
        segments += s
        whose += [k] * len(m)
        learned += [role in learn and j == len(m) - 2 for j in range(len(m))]
    encoded = code.encode([s for s in segments if s])
    later = iter(encoded)
    ids = [next(later) if s else [] for s in segments]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    ends = np.cumsum(size + 1)  # of each mark and its segment, in the stream of all turns
    stream = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    inside = np.ones(len(stream), bool)
    inside[ends - size - 1] = False
    stream[~inside] = [code.mark_id[m] for m in marks]
    stream[inside] = [i for x in ids for i in x]
    step = np.zeros(len(stream) + 1, np.int64)
    learned_at = np.array(learned, bool) & (size > 0)
    np.add.at(step, (ends - size)[learned_at], 1)
    np.add.at(step, ends[learned_at], -1)
    mask = np.cumsum(step)[:-1].astype(np.uint8)
    last = np.flatnonzero(np.diff(np.array(whose), append=-1))
    cuts = ends[last][:-1]
    text: list[list[str]] = [[] for _ in turns]
    for k, m, s in zip(whose, marks, segments, strict=True):
        text[k] += (m, s)
    return ["".join(t) for t in text], np.split(stream, cuts), np.split(mask, cuts)


def format_turns(conversations: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn: tuple[str, ...] = ("assistant",), batch_chars: int = 2_000_000) -> DataFrame:
    """A piece for each turn: ``<id>, turn, role, tie`` (its order in the
    conversation), ``formatted``, ``ids`` (unsigned 32-bit, little-endian),
    ``loss`` (a byte for each id), ``n_tokens, n_chars``."""
    rows = conversations.select(F.col(id_col), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                                F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"), F.coalesce(text_col, F.lit("")).alias("text"))
    kinds = [to_arrow_type(f.dataType) for f in rows.schema]
    learned = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(tokenizer)
        for batch in batches:
            ends = np.cumsum([len(x) for x in batch.column(4).to_pylist()])
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_chars)))
                part = batch.slice(at, upto - at)
                formatted, ids, masks = assemble(code, list(zip(part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True)), learned)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).cast(kinds[k]) for k in range(4)]
                    + [pa.array(formatted, pa.string()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                       pa.array([x.tobytes() for x in masks], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                       pa.array([len(x) for x in formatted], pa.int64())],
                    names=[id_col, *ORDER, "formatted", "ids", "loss", "n_tokens", "n_chars"])
                at = upto

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:4])
    return rows.mapInArrow(run, schema + ", formatted string, ids binary, loss binary, n_tokens long, n_chars long")


def place(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``<id>, turn, role, tie, copy, token_start, char_start``: where each piece
    begins in its conversation's ids and formatted string (``copy`` numbers equal
    turns).  Only sizes are shuffled, into ranges of turns: a conversation with
    many turns lies in many partitions, and gives one total for each."""
    ranged = pieces.select(id_col, *ORDER, "n_tokens", "n_chars").repartitionByRange(id_col, *ORDER)
    sized = stored(ranged.withColumn("part", F.spark_partition_id()), "sizes")
    inside = Window.partitionBy("part", id_col).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(id_col).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("part", id_col).agg(F.sum("n_tokens").alias("t"), F.sum("n_chars").alias("c"))
    bases = totals.select(F.col("part").alias("_part"), F.col(id_col).alias("_id"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"),
                          F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    copy = F.row_number().over(Window.partitionBy("part", id_col, *ORDER).orderBy("n_tokens"))
    rows = sized.select("*", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("t1"),
                        F.coalesce(F.sum("n_chars").over(inside), F.lit(0)).alias("c1"), copy.alias("copy"))
    return (rows.join(bases, (rows["part"] == bases["_part"]) & rows[id_col].eqNullSafe(bases["_id"]))
            .select(id_col, *ORDER, "copy", (F.col("t") + F.col("t1")).alias("token_start"), (F.col("c") + F.col("c1")).alias("char_start")))


def read_back(pieces: DataFrame, tokenizer: str, id_col: str = "conv_id") -> DataFrame:
    """What the pieces say: ``<id>, turn, role, tie``, the role and text of the
    formatted string (``read_role, read_text``), and ``learned``, the unescaped
    text of the ids under the loss mask; ``n_tokens, n_learned, n_chars``."""
    kinds = [to_arrow_type(pieces.schema[c].dataType) for c in (id_col, *ORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                turns = [parse(x) for x in part.column(4).to_pylist()]
                if any(len(t) != 1 for t in turns):
                    raise ValueError("a piece is not one turn")
                learned, n = [], []
                for ids, loss in zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True):
                    under = np.frombuffer(ids, "<u4")[np.frombuffer(loss, np.uint8) > 0]
                    n.append(len(under))
                    learned.append(unescape(code.decode(under.tolist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).cast(kinds[k]) for k in range(4)]
                    + [pa.array([t[0][0] for t in turns], pa.string()), pa.array([t[0][1] for t in turns], pa.string()), pa.array(learned, pa.string()),
                       part.column(7), pa.array(n, pa.int64()), pa.array([len(x) for x in part.column(4).to_pylist()], pa.int64())],
                    names=names)

    names = [id_col, *ORDER, "read_role", "read_text", "learned", "n_tokens", "n_learned", "n_chars"]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in (id_col, *ORDER))
    return pieces.select(id_col, *ORDER, "formatted", "ids", "loss", "n_tokens").mapInArrow(
        run, schema + ", read_role string, read_text string, learned string, n_tokens long, n_learned long, n_chars long")


def digests(read: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``<id>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens, n_learned`` of each conversation.  All that can be done turn by turn
    is done before; a digest needs its conversation's turns in order, so here
    they are streamed through one task, of which only the running digest is held.

    A learned text equal to its turn's is not shuffled twice."""
    kind = to_arrow_type(read.schema[id_col].dataType)
    slim = read.withColumn("learned", F.when(F.col("learned") != F.when(F.length("learned") > 0, F.col("read_text")).otherwise(""), F.col("learned"))
                           .otherwise(F.when(F.length("learned") > 0, F.lit(None)).otherwise("")))
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_learned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # id, turns, digest, learned characters, digest, characters, tokens, learned tokens
        for batch in batches:
            done = []
            for doc, role, text, learned, tokens, n, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_[0] != doc:
                    done += [] if open_ is None else [open_]
                    open_ = [doc, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                learned = text if learned is None else learned
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(learned)
                open_[4].update(learned.encode())
                open_[5] += chars
                open_[6] += tokens
                open_[7] += n
            if done:
                yield out(done)
        if open_ is not None:
            yield out([open_])

    def out(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        for k in (2, 4):
            cols[k] = [h.hexdigest() for h in cols[k]]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    ordered = slim.repartition(id_col).sortWithinPartitions(id_col, *ORDER)
    return ordered.select(id_col, "read_role", "read_text", "learned", "n_tokens", "n_learned", "n_chars").mapInArrow(
        run, f"`{id_col}` {read.schema[id_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long, n_tokens long, n_learned long")


def oracle_sql() -> str:
    """DuckDB twin of the query (its columns that need no tokenizer)."""
    control = "|".join(re.escape(c).replace(r"\ ", " ").replace(r"\#", "#") for c in CONTROLS)
    heads = " ".join(f"WHEN '{r}' THEN {len(h)}" for r, h in HEADS.items())
    hits = "len(regexp_extract_all({}, '" + control + "'))"
    other = f"{len(ROLE) + len(TEXT)} + length(role) + " + hits.format("role")
    return f"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(COALESCE(SUM(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(CASE role {heads} ELSE {other} END + length(t) + {hits.format("t")} + {len(END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
