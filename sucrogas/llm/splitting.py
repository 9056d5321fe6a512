"""Splitting long texts at natural boundaries with an exact token overlap, by pointer doubling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sucrogas.llm.tokens import TOKENIZER_DIR, VOCABULARY, encode, token_bytes

# Levels of boundaries, the best first: page or paragraph, line, sentence, clause, word, any token.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, TOKEN = 5, 4, 3, 2, 1, 0
# White space, and the marks that end sentences and clauses or close quotations.
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_STOPS, _PAUSES, _CLOSERS = (np.array([ord(c) for c in x], dtype=np.uint32) for x in (".!?\u2026", ";:,\u2013", "\"'\u201d\u2019)]"))
#: A better boundary is taken if it lies in the last part of the room; each level down needs a longer piece.
LEAST_FILL = (0.0, 0.9, 0.85, 0.7, 0.5, 0.5)


def _table(*sets: np.ndarray) -> np.ndarray:
    """A lookup per code point: bit i is set for the members of the i-th set."""
    table = np.zeros(0x3001, dtype=np.uint8)
    for i, members in enumerate(sets):
        table[members] |= 1 << i
    return table


_KINDS = _table(_SPACES, _STOPS, _PAUSES, _CLOSERS)


def boundaries(text: str) -> np.ndarray:
    """Level of the cut before each character position 0..len(text).

    Works on runs of white space: a run with a form feed or two line ends (CR LF is one) is a paragraph
    break, with one a line break; these belong to the piece before them.  Other runs separate
    sentences, clauses or words by the mark before them, and may go to either side, as byte-level
    tokens carry the space in front.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    level = np.zeros(len(cp) + 1, dtype=np.int8)
    kind = _KINDS[np.minimum(cp, 0x3000)]
    space = (kind & 1).astype(bool) & (cp <= 0x3000)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], space, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if len(start):
        lf, cr = cp == 10, cp == 13
        breaks = lf | cr
        breaks[1:] &= ~(lf[1:] & cr[:-1])
        so_far = np.concatenate([[0], np.cumsum(breaks + 2 * (cp == 12))])
        n = so_far[end] - so_far[start]
        last = np.maximum(start - 1, 0)
        closed = (kind[last] & 8 > 0) & (last > 0)
        mark = kind[np.where(closed, last - 1, last)]
        soft = np.where(mark & 2 > 0, SENTENCE, np.where(mark & 4 > 0, CLAUSE, WORD))
        found = np.where(n >= 2, PARAGRAPH, np.where(n == 1, LINE, soft))
        level[end] = found
        level[start] = np.where(n == 0, soft, level[start])
    level[0] = level[-1] = PARAGRAPH
    return level


def token_starts(text: str, folder: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Character position of every token boundary (0..n) and whether it lies between characters."""
    ids = np.asarray(encode(text, folder, vocabulary), dtype=np.int64)
    at_byte = np.concatenate([[0], np.cumsum(token_bytes(folder, vocabulary)[ids])]) if len(ids) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    first = np.concatenate([(raw & 0xC0) != 0x80, [True]])
    chars = np.cumsum(first) - 1
    return chars[at_byte], first[at_byte]


def successors(level: np.ndarray, legal: np.ndarray, capacity: int, overlap: int) -> np.ndarray:
    """For every token boundary e the end of the piece that starts ``overlap`` tokens before e.

    The farthest boundary of the best level wins; a level counts only if the piece is then filled to
    its part of the capacity.  The last boundary is its own successor.
    """
    n = len(level) - 1
    ends = np.arange(n + 1)
    begin = np.where(ends == 0, 0, np.maximum(ends - overlap, 0))
    reach = np.minimum(begin + capacity, n)
    out = np.full(n + 1, -1, dtype=np.int64)
    for want in range(TOKEN, PARAGRAPH + 1):
        ok = legal & (level >= want)
        last = np.maximum.accumulate(np.where(ok, ends, -1))[reach]
        enough = (last > ends) & (last - begin >= LEAST_FILL[want] * capacity)
        out = np.where(enough, last, out)
    out = np.where(out <= ends, reach, out)  # only where no boundary is legal
    out = np.where(reach == n, n, out)
    out[n] = n
    return out


def reached(succ: np.ndarray) -> np.ndarray:
    """All boundaries on the path from 0, by squaring the successor table: after k rounds 2**k steps are known."""
    on = np.zeros(len(succ), dtype=bool)
    on[succ[0]] = True
    jump = succ
    while True:
        more = on.copy()
        more[jump[np.flatnonzero(on)]] = True
        if (more == on).all() and jump[succ[0]] == len(succ) - 1:
            return on
        on, jump = more, jump[jump]


def cut(text: str, limits: list[tuple[str, int, int]], folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> list[tuple[str, int, int, int, int, int, int]]:
    """Pieces of one text under each limit it exceeds: (limit, piece, first token, end token, first char, end char, level of the cut)."""
    least = min(c for _, c, _ in limits)
    if len(text.encode("utf-8", "replace")) <= least:  # a token has a byte at least
        return []
    chars, between = token_starts(text, folder, vocabulary)
    n = len(chars) - 1
    if n <= least:
        return []
    at = boundaries(text)
    level = np.where(between, at[np.minimum(chars, len(text))], -1)
    out = []
    for name, capacity, overlap in limits:
        if n <= capacity:
            continue
        # A cut is legal where the piece can end and the next one, ``overlap`` tokens before, can start.
        before = np.maximum(np.arange(n + 1) - overlap, 0)
        legal = between & between[before] & (np.arange(n + 1) > overlap)
        legal[n] = True
        ends = np.flatnonzero(reached(successors(level, legal, capacity, overlap)))
        begin = np.concatenate([[0], np.maximum(ends[:-1] - overlap, 0)])
        out += [(name, i, int(b), int(e), int(chars[b]), int(chars[e]), int(max(level[e], 0))) for i, (b, e) in enumerate(zip(begin, ends, strict=True))]
    return out


PIECE = StructType(
    [StructField("limit_id", StringType())]
    + [StructField(n, IntegerType()) for n in ("piece", "first_token", "end_token", "first_char", "end_char", "cut_level")]
)


def split_documents(
    docs: DataFrame, doc: str, text: str, limits: list[tuple[str, int, int]], folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Ordered pieces of every text that exceeds a limit.

    ``limits`` are (name, capacity, overlap) with overlap < capacity.  A piece has at most ``capacity`` tokens (as the
    document is tokenised), consecutive pieces share exactly ``overlap`` tokens, and cuts lie at the best natural
    boundary near the end of the room: paragraph or page, line, sentence, clause, word; in texts
    without any, between two tokens and never inside a character.  Where byte tokens make an exact
    overlap impossible at every boundary, the farthest token boundary is taken; a character that such a cut
    falls into belongs to the later piece.  NULL, empty and short texts give no row.
    Texts are independent: no shuffle; only offsets cross from Python, the pieces are cut in the JVM.

    Returns the document id, ``limit_id``, ``piece`` (from 0), token and character offsets, ``tokens``, ``cut_level``, ``piece_text``.
    """
    for name, capacity, overlap in limits:
        if not 0 <= overlap < capacity:
            raise ValueError(f"{name}: the overlap must be smaller than the capacity")

    @F.pandas_udf(ArrayType(PIECE))
    def pieces(texts: pd.Series) -> pd.Series:
        names = [f.name for f in PIECE]
        return pd.Series([[dict(zip(names, p, strict=True)) for p in cut(t, limits, folder, vocabulary)] if isinstance(t, str) else [] for t in texts])

    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).withColumn("_p", F.explode(pieces("_text")))
    return rows.select(
        F.col("_id").alias(doc), "_p.*", (F.col("_p.end_token") - F.col("_p.first_token")).alias("tokens"),
        F.substring(F.col("_text"), F.col("_p.first_char") + 1, F.col("_p.end_char") - F.col("_p.first_char")).alias("piece_text"),
    )
