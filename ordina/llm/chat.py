"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: The template: ``<turn>role<says>text</turn>`` and a line end for each turn. The three control strings are tokens of
#: their own, so every text begins and ends between two tokens. Inside roles and texts a backslash is doubled and one
#: behind the ``<`` breaks a control string, so that none is ever found there.
OPEN, SAYS, CLOSE = CONTROL = ("<turn>", "<says>", "</turn>")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<turn>(.*?)<says>(.*?)</turn>\n", re.DOTALL)

SCHEMA = "conv_id long, formatted string, input_ids array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """Double backslashes and break control strings; :func:`unescape` takes both back."""
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, "<\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation, and role, start and end (code points) of each escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAYS}", escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that :func:`render` has formatted."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(spans: Sequence[tuple[int, int]], ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted ``spans``.

    Token i stands for the code points from the end of the token before to ``ends[i]``, so no code point falls between
    tokens; of tokens that are parts of one character the first stands for all of it. Spans must begin and end between
    tokens.
    """
    hit = np.zeros(len(ends), bool)
    for a, b in spans:
        if a < b:
            i, j = np.searchsorted(ends, [a, b], "right")
            if i == 0 or ends[i - 1] != a or ends[j - 1] != b:
                raise ValueError("a token crosses the border of a turn's text: the tokenizer does not keep all characters apart")
            hit[i:j] = True
    return hit


def masked_text(formatted: str, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text under a mask, unescaped: what the marked tokens stand for, one run of them after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return "".join(unescape(formatted[(ends[i - 1] if i else 0) : ends[j - 1]]) for i, j in edge.reshape(-1, 2))


def format_chat(
    turns: DataFrame,
    *,
    tokenizer_file: str,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
    chunk_chars: int = 1 << 20,
) -> DataFrame:
    """Format whole conversations, encode each once and mask the tokens of the turns that are learned from.

    Returns one row a conversation: ``conv_id, formatted, input_ids, token_ends, loss_mask``. Tokens end at code points
    of ``formatted``; the mask holds for all tokens of the escaped texts that are learned from and for no other.

    One shuffle by conversation; each task then streams its sorted rows and holds at most ``chunk_chars`` characters
    besides the conversation that it is reading. The tokenizer's file is read once on the driver and broadcast
    (a vocabulary, a few MB); the template's control strings are added to it as tokens, behind its own. Its special
    strings are ordinary text. Null text or role: empty. Null turns come first, equal turns are ordered by role and
    text; rows that repeat are turns of their own. A row without a conversation id is a conversation of its own. An
    empty table gives an empty result; other columns are ignored.
    """
    ship(turns.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        model = turns.sparkSession.sparkContext.broadcast(f.read())
    learned = frozenset(loss_roles)
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("formatted", pa.string()),
            ("input_ids", pa.list_(pa.int32())),
            ("token_ends", pa.list_(pa.int32())),
            ("loss_mask", pa.list_(pa.bool_())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_str(model.value)
        tokenizer.encode_special_tokens = True
        tokenizer.add_tokens([AddedToken(x, normalized=False, special=False) for x in CONTROL])

        def encoded(chunk: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            made = [render(t) for _, t in chunk]
            codes = tokenizer.encode_batch([x for x, _ in made], add_special_tokens=False)
            rows = []
            for (key, _), (text, spans), code in zip(chunk, made, codes, strict=True):
                ends = np.maximum.accumulate(np.fromiter((b for _, b in code.offsets), np.int64, len(code.offsets)))
                ends[-1] = len(text)
                hit = mask([(a, b) for role, a, b in spans if role in learned], ends)
                rows.append({"conv_id": key, "formatted": text, "input_ids": code.ids, "token_ends": ends, "loss_mask": hit})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        chunk: list[tuple[int | None, list[tuple[str, str]]]] = []
        held, last = 0, object()
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key is None or key != last or not chunk:
                    if held > chunk_chars:
                        yield encoded(chunk)
                        chunk, held = [], 0
                    chunk.append((key, []))
                    last = key
                chunk[-1][1].append((role or "", text or ""))
                held += len(text or "")
        if chunk:
            yield encoded(chunk)

    rows = turns.selectExpr(f"cast(`{id_col}` as long) as conv_id", f"`{role_col}` as role", f"`{text_col}` as text", f"`{turn_col}` as turn")
    # Rows without an id are dealt by what they say: they would all meet in one task.
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("role", "text", "turn"))
    ordered = rows.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from :func:`format_chat`'s output alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: turns are parsed from the formatted
    text; the text under the loss is what the mask's tokens stand for, unescaped.
    """
    ship(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for key, text, ends, hit in zip(*batch.columns, strict=True):
                text, ends, hit = text.as_py(), ends.values.to_numpy(), hit.values.to_numpy(zero_copy_only=False)
                turns, whole = sha256(), parse(text)
                for role, said in whole:
                    turns.update(f"{role}\n{said}\n".encode())
                loss = masked_text(text, ends, hit)
                rows.append((key.as_py(), len(whole), turns.hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "token_ends", "loss_mask").mapInArrow(run, schema)
