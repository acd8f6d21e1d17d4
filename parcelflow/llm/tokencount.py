"""Token counts of a byte-pair model by merging alone, without token ids.

A text starts as one symbol per character. The adjacent pair whose union is the piece of the lowest rank,
of several the leftmost, is merged until no adjacent pair is a piece. Pairs wait in a heap, symbols are a
doubly linked list, so a text of n characters takes n log n steps. A character that is no piece counts
as its UTF-8 bytes. The number of tokens is that of the first symbols less the merges.

No piece goes on past a place where another character is followed by a space mark, nor over a line break,
if the model has none such (that is looked up). Then the words between these places are merged apart, and
equal words of the texts at hand only once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
# Words whose counts a worker remembers, none longer than LONG characters; then it forgets them all.
REMEMBERED = 400_000
LONG = 40
# Characters of a text that are cut into words at once.
SLICE = 2_000_000

# Spaces with what follows them, up to a line break; line breaks in a row are a word of their own.
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
# The end of a word.
CUT = re.compile(f"[^{SPACE}\n](?=[{SPACE}\n])|\n(?=[^\n])")


@dataclass
class Merges:
    """The pieces of a model with their ranks; ``cut`` says whether words may be merged apart."""

    ranks: dict[str, float]
    cut: bool
    known: dict[str, int] = field(default_factory=dict)

    def tokens(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return self.symbols_left(marked)
        total = 0
        for part in sliced(marked):
            for word, times in Counter(WORD.findall(part)).items():
                n = self.known.get(word)
                if n is None:
                    n = self.symbols_left(word)
                    if len(word) <= LONG:
                        if len(self.known) >= REMEMBERED:
                            self.known.clear()
                        self.known[word] = n
                total += n * times
        return total

    def symbols_left(self, word: str) -> int:
        """Symbols, bytes of unknown characters counted one by one, less the merges."""
        ranks, symbols = self.ranks, list(word)
        last = len(symbols)
        left = sum(1 if x in ranks else len(x.encode("utf-8", "surrogatepass")) for x in symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        waiting = [
            (ranks[pair], i, pair)
            for i, pair in enumerate(map(str.__add__, symbols, symbols[1:]))
            if pair in ranks
        ]
        heapify(waiting)
        while waiting:
            _, i, pair = heappop(waiting)
            j = after[i]
            # One of the two may have been merged with another symbol since.
            if j >= last or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            left -= 1
            after[i] = k = after[j]
            after[j] = last
            if k < last:
                before[k] = i
                if (longer := pair + symbols[k]) in ranks:
                    heappush(waiting, (ranks[longer], i, longer))
            h = before[i]
            if h >= 0 and (longer := symbols[h] + pair) in ranks:
                heappush(waiting, (ranks[longer], h, longer))
        return left


def sliced(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of about ``size`` characters, cut only where a word ends."""
    begin = 0
    while len(text) - begin > size:
        found = CUT.search(text, begin + size)
        if found is None:
            break
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:]


@cache
def merges(model: str) -> Merges:
    """The merges of a SentencePiece model, one for each Python worker. Byte-pair models with byte pieces,
    an unchanging normaliser and pieces of known characters are taken, others are refused."""
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=located(model))
    ranks, special = {}, 0
    for i in range(loaded.get_piece_size()):
        if loaded.is_byte(i):
            special += 1
        elif not (loaded.is_control(i) or loaded.is_unknown(i)):
            ranks[loaded.id_to_piece(i)] = -loaded.get_score(i)
    probe = "\ufb01\u2460 \uff21  e\u0301 "
    if special != 256 or loaded.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("not a byte-pair model with byte pieces and an unchanging normaliser")
    if not set("".join(ranks)) <= set(ranks):
        raise ValueError("a piece has a character that is no piece")
    apart = not any(SPACE in x.lstrip(SPACE) or ("\n" in x and x.strip("\n")) for x in ranks)
    return Merges(ranks, apart)


def located(model: str) -> str:
    """A path as it is; the file of a public tokenizer for a name without a folder."""
    if "/" in model:
        return model
    import public_tokenizers

    return str(public_tokenizers.path(model))


def count_column(text: Column, model: str = MODEL) -> Column:
    """Tokens of a whole text as a long; 0 for null and empty texts. Begin and end marks are not counted,
    and strings that look like special pieces are ordinary text. The model is found by the executors.

    Memory grows with the longest word, that is, a run without a space or line break.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = merges(model)
        for texts in batches:
            yield pd.Series([found.tokens(t or "") for t in texts], dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null texts count as empty: no bytes, no tokens. All rows stay, repeated ones too, and all columns but
    those of the three names, which are replaced; an empty table gives an empty one. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.withColumn("_tokens", count_column(F.col(text), model))
    return rows.select(
        *kept,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("_tokens").alias("n_tokens"),
        (F.col("_tokens") > limit).alias("over_limit"),
    )
