"""Words of texts that are written without spaces, by a dictionary.

A run of letters and digits is cut where its most probable words meet. The dictionary is a trie; from each place in a run it gives
the words that begin there, and so a graph of words over the run, in which the path of the greatest sum of log probabilities is
found from the end on. A character that begins no word stands alone, with the probability of a word met once. Of paths of equal
probability the one with the longer word first is taken. Runs of letters of alphabets (all but ideographs and kana) are words as
they stand, since those are written with spaces.

The dictionary is a table and may come from the data, as the names of entities and types. It goes to all tasks, so its size is checked.
New words that are not in it are not guessed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters of all words of a dictionary.
MOST_CHARACTERS = 20_000_000
#: Runs of ideographs and kana, and runs of other letters and digits.
RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]+|[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)
DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
END = ""


class Segmenter:
    def __init__(self, words: Iterable[tuple[str, float]]):
        self.trie: dict = {}
        counts: dict[str, float] = {}
        for word, count in words:
            if word and count and count > 0:
                counts[word] = counts.get(word, 0) + count
        self.total = math.log(sum(counts.values()) or 1)
        for word, count in counts.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[END] = math.log(count) - self.total

    def ends(self, run: str, at: int) -> list[tuple[int, float]]:
        """Where words that begin at a place end, and their log probabilities; the character itself if none does."""
        found, node = [], self.trie
        for i in range(at, len(run)):
            node = node.get(run[i])
            if node is None:
                break
            if END in node:
                found.append((i + 1, node[END]))
        return found if found and found[0][0] == at + 1 else [(at + 1, -self.total), *found]

    def cut(self, run: str) -> list[str]:
        """The most probable words of a run without spaces."""
        best = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            best[i] = max((p + best[e][0], e) for e, p in self.ends(run, i))
        words, i = [], 0
        while i < len(run):
            words.append(run[i : best[i][1]])
            i = best[i][1]
        return words

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        for run in RUN.findall(text or ""):
            out += self.cut(run) if DENSE.match(run) else [run]
        return out


def segmenter(dictionary: DataFrame, word: str = "word", count: str = "count") -> Segmenter:
    """From dictionary(word, count), once its size is known to be small enough for all tasks."""
    known = dictionary.where(F.col(word).isNotNull() & (F.col(count) > 0))
    size = known.agg(F.coalesce(F.sum(F.length(word)), F.lit(0))).first()[0]
    if size > MOST_CHARACTERS:
        raise ValueError(f"a dictionary of {size} characters is too large; {MOST_CHARACTERS} at most")
    return Segmenter((r[0], float(r[1])) for r in known.select(word, count).orderBy(word).toLocalIterator())


def segmented(text: Column, dictionary: DataFrame) -> Column:
    """The words of a text, in order; of a null text none."""
    shared = dictionary.sparkSession.sparkContext.broadcast(segmenter(dictionary))

    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.words(t) for t in texts], dtype=object)

    return F.pandas_udf(words, ArrayType(StringType()))(text)


def query_words(query: str, dictionary: Segmenter, most: int = 10) -> list[str]:
    """What is looked for: words of two characters or more, each once, the first `most`."""
    return list(dict.fromkeys(w for w in dictionary.words(query) if len(w) >= 2))[:most]
