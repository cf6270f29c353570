"""Splitting oversized texts at natural boundaries with overlapping pieces.

Separators form a hierarchy: section, paragraph, sentence or line, word, character. A text is split at sections; what is
still too large is split at paragraphs, and so on down to characters, giving atoms. Atoms are packed greedily into
pieces up to the limit; each piece starts with the last ``overlap`` tokens of the piece before it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens

LEVELS = ("section", "paragraph", "sentence", "word", "character")
#: Where a cut may fall (the end of the match, or the start of its group if it has one).
SECTION = re.compile(r"\n(?=#{1,6} )|\n(?=(?:-{3,}|={3,}|\*{3,})[ \t]*\n)|(?<=\n)```[^\n]*\n|\n{3,}|\f")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
SENTENCE = re.compile(r"""[.!?…]+["'”’»)\]]*(?=\s)|[。！？]+[」』”)]*|\n""")
COMMAS = "、，"
#: Fixed value: the white space of the pattern that comes before the merges.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_IS_SPACE = np.zeros(0x3100, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


class Splitter:
    def __init__(self, enc, lengths: np.ndarray, limit: int, overlap: int):
        if not 0 <= overlap < limit or limit - overlap < 4:
            raise ValueError("the overlap must leave room for at least one character in a piece")
        self.enc, self.lengths, self.limit, self.overlap = enc, lengths, limit, overlap

    @staticmethod
    def cuts(text: str, token_at: np.ndarray, space: np.ndarray, commas: np.ndarray) -> list[np.ndarray]:
        """Token indices at which each level may cut; a level holds those of the coarser ones as well. ``token_at``: the
        token that starts at each character, or -1."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], space.view(np.int8), [0]])))
        found = [np.array([(m.start(), m.end()) for m in p.finditer(text)], dtype=np.int64).reshape(-1, 2) for p in (SECTION, PARAGRAPH, SENTENCE)]
        found.append(np.concatenate([edges.reshape(-1, 2), np.repeat(commas + 1, 2).reshape(-1, 2)]))
        out, known = [], np.zeros(0, dtype=np.int64)
        for pairs in found:
            # a blank may belong to the token before or after it
            after, before = token_at[pairs[:, 1]], token_at[pairs[:, 0]]
            at = np.where(after > 0, after, before)
            known = np.union1d(known, at[at > 0])
            out.append(known)
        return out

    def counter(self, text: str, space: np.ndarray, token_at: np.ndarray):
        """Function of the two ends of a piece (characters): its own tokens. Where blanks follow something else the
        tokenizer starts anew, whatever stands before, so between two such places the tokens of the whole text count;
        only what is left at the two ends is tokenized again."""
        safe = np.flatnonzero(~space[:-1] & space[1:]) + 1
        n = lambda a, b: len(self.enc.encode_ordinary(text[a:b])) if a < b else 0

        def count(a: int, b: int) -> int:
            i, j = np.searchsorted(safe, a), np.searchsorted(safe, b, "right") - 1
            if i >= j:
                return n(a, b)
            first, last = (0 if a == 0 else int(safe[i])), (b if b == len(text) and not space[-1] else int(safe[j]))
            return n(a, first) + int(token_at[last] - token_at[first]) + n(last, b)

        return count

    def atoms(self, lo: int, hi: int, level: int, cuts: list[np.ndarray], most: int, out: list[tuple[int, int]]) -> None:
        if hi - lo <= most:
            out.append((hi, level))
            return
        own = cuts[level]
        inner = own[np.searchsorted(own, lo, "right") : np.searchsorted(own, hi, "left")]
        if level == len(cuts) - 1:  # characters: as long as may be
            at = lo
            while at < hi:
                stop = own[np.searchsorted(own, min(hi, at + most), "right") - 1]
                at = int(stop if stop > at else own[np.searchsorted(own, at, "right")])  # a character may be larger
                out.append((at, level))
            return
        at = lo
        for stop in [*inner.tolist(), hi]:
            self.atoms(at, stop, level if stop - at <= most else level + 1, cuts, most, out)
            at = stop

    def pieces(self, text: str, codes: list[int]) -> list[tuple[int, int, int, int, str]]:
        """(char_start, char_end, n_tokens, overlap_tokens, boundary) per piece. Every token boundary that isn't inside
        a character may be cut at the last level, so there is always a cut."""
        raw = text.encode("utf-8", "replace")
        chars = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        space = (chars < len(_IS_SPACE)) & _IS_SPACE[np.minimum(chars, len(_IS_SPACE) - 1)]
        commas = np.flatnonzero(np.isin(chars, [ord(c) for c in COMMAS]))
        starts = np.concatenate([[0], np.cumsum(self.lengths[codes])])
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        char_of = np.concatenate([np.cumsum(lead) - 1, [len(text)]])  # character of each byte
        at_byte = np.append(np.flatnonzero(lead), len(raw))  # byte of each character
        token_of = np.full(len(raw) + 1, -1, dtype=np.int64)
        token_of[starts] = np.arange(len(starts))
        token_at = token_of[at_byte]
        whole = np.append(lead, True)[starts]
        cuts = self.cuts(text, token_at, space, commas) + [np.flatnonzero(whole)]
        count = self.counter(text, space, token_at)
        n = len(codes)
        ends: list[tuple[int, int]] = []
        # atoms leave room for the overlap, and for tokens that a cut inside a word may add
        self.atoms(0, n, 0, cuts, max(1, self.limit - self.overlap - 3), ends)
        stops = np.array([e for e, _ in ends], dtype=np.int64)
        level_of = dict(ends)
        free = cuts[-1]
        place = char_of[starts]  # character of each token
        out, start, done = [], 0, 0
        while done < n:
            # the furthest end whose tokens, counted anew, fit
            i = int(np.searchsorted(stops, start + self.limit, "right")) - 1
            while True:
                end = int(stops[i]) if i >= 0 and stops[i] > done else None
                if end is None:  # not even one atom fits: cut at a character
                    j = int(np.searchsorted(free, min(n, start + self.limit), "right")) - 1
                    end = int(free[j])
                    while (size := count(int(place[start]), int(place[end]))) > self.limit and free[j - 1] > done:
                        j -= 1
                        end = int(free[j])
                    level = len(LEVELS) - 1
                    break
                size = count(int(place[start]), int(place[end]))
                if size <= self.limit:
                    level = level_of.get(end, len(LEVELS) - 1)
                    break
                i -= 1
            out.append((int(place[start]), int(place[end]), size, done - start, "end" if end == n else LEVELS[level]))
            done = end
            start = int(free[np.searchsorted(free, max(0, end - self.overlap), "right") - 1])
        return out


def split_oversized(
    df: DataFrame, key: str, text: str, limit: int, overlap: int, *, folder: str = tokens.TOKENIZERS,
    vocabulary: str = tokens.VOCABULARY, all_texts: bool = False,
) -> DataFrame:
    """(id, piece_no, char_start, char_end, n_tokens, overlap_tokens, boundary, piece) for texts of more than ``limit``
    tokens; with ``all_texts`` others with any token come out as their one piece.

    Pieces cover the text in order. ``n_tokens`` is the piece's own count and never above the limit. ``overlap_tokens``
    counts tokens of the whole text shared with the piece before: exactly ``overlap``, or up to three more where that
    would cut a character. Null and empty texts have no piece. A key in several rows is split several times.
    """
    path = f"{folder}/{vocabulary}"
    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, piece_no int, char_start int, char_end int, n_tokens int, overlap_tokens int, boundary string, piece string"
    names = ["id", "piece_no", "char_start", "char_end", "n_tokens", "overlap_tokens", "boundary", "piece"]

    def run(batches):
        enc = tokens.encoding(path)
        splitter = Splitter(enc, tokens.lengths(path), limit, overlap)
        rows, held = [], 0
        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                if not t or not all_texts and 4 * len(t) <= limit:  # a token is at least a byte
                    continue
                codes = enc.encode_ordinary(t)
                if len(codes) > limit:
                    found = splitter.pieces(t, codes)
                elif all_texts and codes:
                    found = [(0, len(t), len(codes), 0, "end")]
                else:
                    continue
                for no, (a, b, size, shared, boundary) in enumerate(found):
                    rows.append((i, no, a, b, size, shared, boundary, t[a:b]))
                    held += b - a
                if held > 4_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return texts.mapInPandas(run, schema)
