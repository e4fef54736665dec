"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are rows of lower-cased words; in scripts written without spaces each character is a word. The CGK random walk reads a row
of words: in step j it puts out the word it stands on and moves on by a random bit of (j, word). Rows that differ in few edits
have walks that differ in few steps, so edit distance becomes Hamming distance. Items of about one length form a class; a
document's windows of that size start at every word. In each of a number of independent walks a few sampled steps of the
embedding make a key, and a window is a candidate for the items with the same key.

The number of walks is calibrated for each class by itself, with items that have as many random edits as are allowed, until
their recall reaches TARGET_RECALL; recall is then measured on other trials (`leak_classes` returns it). A class that does not
get there in MOST_REPEATS walks, and every class if the target is 1, is searched exactly instead: an item of e allowed edits is
cut into e + 1 pieces, of which a match holds at least one as it is.

Candidates are verified by the exact edit distance in words: an item leaks if some part of the document is at most `max_rate` *
its words edits away (so items of fewer than five words must be there word for word), and `edits` is the least over the whole
document.

Only windows that could match are embedded: of their words at most as many as edits are allowed may be words of no item, and
at least as many must be telling words (of few items) as the item has beyond the edits. These counts lose no match.

Items are dealt into blocks of about BLOCK_ITEMS; each block's index is built in a task and kept as a row of a table. One block
at a time is broadcast, documents are read once for each and not shuffled.

Defined cases: null and empty texts leak nothing; repeated items are each reported; rows of null item_id or text, and items
without a word, are left out; of several places of one item in a document the one with the fewest edits counts. Columns of the
same name are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_fresh

MAX_RATE = 0.2
SAMPLED_STEPS = 4
MOST_REPEATS = 128
#: The share of passages with all the edits that are allowed which the walks of each class find; at 1 pieces are used alone.
TARGET_RECALL = 0.98
TRIALS = 400
BLOCK_ITEMS = 10_000
#: A word is telling if it is in at most this share of a block's items, or in at most three.
TELLING_SHARE = 0.02
#: Bytes of text whose words are hashed at a time, and words whose windows are looked at together.
PIECE_BYTES = 1 << 19
BATCH_WORDS = 1 << 19

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: First bytes of three-byte characters of U+3000 to U+9FFF, which are words of their own.
LONE = np.zeros(256, dtype=bool)
LONE[0xE3:0xEA] = True
PRIME = 0x9E3779B97F4A7C15


class WordHasher:
    """64-bit hashes of the words (runs of letters and digits) of a text, by prefix sums over its bytes."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, PIECE_BYTES + 1)
            self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, PRIME, dtype=np.uint64))))
            self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(PRIME, -1, 1 << 64), dtype=np.uint64))))

    def piece(self, data: bytes) -> np.ndarray:
        octets = np.frombuffer(data, dtype=np.uint8)
        inside = np.concatenate(([False], WORD_BYTE[octets], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        if (lone := np.flatnonzero(LONE[octets])).size:
            cuts = np.concatenate((starts, lone, np.minimum(lone + 3, len(octets))))
            starts = np.unique(cuts[inside[1:][cuts]])  # what lies before a cut ends there
            stops = np.minimum(np.append(starts[1:], len(octets)), stops[np.searchsorted(stops, starts, side="right")])
        self._grow(len(octets))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * self.power[: len(octets)])))
        h = (sums[stops] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def words(self, text: str | None) -> np.ndarray:
        data, out, at = (text or "").lower().encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            stop = min(len(data), at + PIECE_BYTES)
            if stop < len(data):  # a piece ends where no word does
                cut = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
                stop = cut + 1 if cut >= at else stop
                while cut < at and stop < len(data) and WORD_BYTE[data[stop]]:
                    stop += 1
            out.append(self.piece(data[at:stop]))
            at = stop
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def edit_distance_within(item: list[int], words: list[int]) -> int:
    """The least number of word edits between item and any part of words, by Myers' bit-parallel columns."""
    n = len(item)
    last, ones = 1 << (n - 1), (1 << n) - 1
    match: dict[int, int] = {}
    for i, x in enumerate(item):
        match[x] = match.get(x, 0) | 1 << i
    up, down, score = ones, 0, n
    best = n
    for w in words:
        eq = match.get(w, 0)
        x = eq | down
        diag = ((((eq & up) + up) ^ up) | eq) & ones
        hp = (down | ~(diag | up)) & ones
        hm = up & diag
        score += bool(hp & last) - bool(hm & last)
        hp, hm = (hp << 1) & ones, (hm << 1) & ones
        up, down = (hm | ~(x | hp)) & ones, hp & x
        best = min(best, score)
    return best


class LeakIndex:
    """The keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float = MAX_RATE, recall: float = TARGET_RECALL, seed: int = 42):
        hasher = WordHasher()
        rows = [(i, hasher.words(t)) for i, t in items]
        rows = [(i, w) for i, w in rows if len(w)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in rows])) if rows else np.zeros(0, dtype=np.uint64)
        self.maybe = np.zeros(1 << 18, dtype=bool)  # a first look before the search
        self.maybe[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True
        self.ids = [i for i, _ in rows]
        self.items = [np.searchsorted(self.vocabulary, w).astype(np.int32) + 1 for _, w in rows]
        self.edits = [int(max_rate * len(w)) for w in self.items]
        rng = np.random.default_rng(seed)
        #: A random number for each word; the step bits are taken from its products with random odd numbers.
        self.drawn = rng.integers(0, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        items_with = np.bincount(np.concatenate([np.unique(w) for w in self.items]), minlength=len(self.vocabulary) + 1) if rows else np.zeros(1)
        self.telling = (items_with > 0) & (items_with <= max(3, TELLING_SHARE * len(rows)))
        self.needs = needs = np.array([int(self.telling[w].sum()) - e for w, e in zip(self.items, self.edits)], dtype=np.int64)
        self.classes = []
        lengths = np.array([len(w) for w in self.items], dtype=np.int64)
        at = 1
        while len(lengths) and at <= lengths.max():
            top = max(at, int(at * 1.25))
            for least, most in ((4, 1 << 30), (2, 3), (-(1 << 30), 1)):
                own = np.flatnonzero((lengths >= at) & (lengths <= top) & (needs >= least) & (needs <= most))
                if len(own):
                    c = {"low": at, "top": top, "edits": int(max_rate * top), "own": own, "pieces": None, "need": int(needs[own].min()), "reach": top + int(max_rate * top), "keys": [], "begun": [], "sampled": [], "odd": []}
                    self.classes.append(c)
                    self._calibrate(c, recall, rng)
            at = top + 1
        self.repeats = max((len(c["keys"]) for c in self.classes), default=0)
        self.walked = np.zeros(len(self.items), dtype=bool)
        for c in self.classes:
            self.walked[c["own"]] = c["pieces"] is None

    @staticmethod
    def _grams(words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        h = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for j in range(n):
            h = (h ^ words[j : len(words) - n + 1 + j].astype(np.uint64)) * np.uint64(PRIME)
            h ^= h >> np.uint64(29)
        return h

    def _pieces(self, own: np.ndarray) -> list[tuple]:
        """For each length of piece: the hashes, ascending, and whose they are and where they stand in the item."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i in own.tolist():
            n, parts = len(self.items[i]), min(self.edits[i] + 1, len(self.items[i]))
            for k in range(parts):
                at, stop = k * n // parts, (k + 1) * n // parts
                found.setdefault(stop - at, []).append((int(self._grams(self.items[i][at:stop], stop - at)[0]), i, at))
        out = []
        for n, rows in sorted(found.items()):
            rows.sort()
            out.append((n, np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))
        return out

    def _piece_hits(self, pieces: list[tuple], words: np.ndarray, stop: int, foreign: np.ndarray, telling: np.ndarray) -> list[np.ndarray]:
        """Rows of item and start of those whose piece stands in words[:stop] and that the counts around it do not rule out."""
        out, sizes, edits = [], np.array([len(w) for w in self.items]), np.array(self.edits)
        for n, keys, owners, offsets in pieces:
            places = np.flatnonzero(foreign[n : stop + 1] == foreign[: max(0, stop + 1 - n)])
            found = self._grams(words[:stop], n)[places]
            lo, many = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
            many -= lo
            hit = np.flatnonzero(many)
            size = many[hit]
            k = np.repeat(lo[hit], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, start = owners[k], np.repeat(places[hit], size) - offsets[k]
            first, last = np.clip(start - edits[i], 0, len(words)), np.clip(start + sizes[i] + edits[i], 0, len(words))
            own = last - first - (foreign[last] - foreign[first]) >= sizes[i] - edits[i]
            own &= telling[last] - telling[first] >= self.needs[i]
            out.append(np.stack([i[own], np.maximum(start[own], 0)], axis=1))
        return out

    def _extend(self, c: dict, repeats: int, rng: np.random.Generator) -> None:
        """Walk the items of a class so many times in all."""
        steps, own = 2 * c["low"], c["own"]
        # One of the sampled steps is among the first quarter: most walks end there, on a word that no item has in that step.
        early = max(1, steps // 4)
        places = 1 << max(10, min(15, (8 * len(own)).bit_length()))
        padded = np.zeros((len(own), steps + 1 + max(len(self.items[i]) for i in own)), dtype=np.int32)
        for row, i in zip(padded, own):
            row[: len(self.items[i])] = self.items[i]
        starts = np.arange(len(own), dtype=np.int64) * padded.shape[1]
        for t in range(len(c["keys"]), repeats):
            c["sampled"].append(np.sort([rng.integers(0, early), *rng.choice(np.arange(early, steps), min(SAMPLED_STEPS, steps - early + 1) - 1, replace=False)]))
            c["odd"].append(rng.integers(0, 1 << 63, steps, dtype=np.uint64) << np.uint64(1) | np.uint64(1))
            c["begun"].append([np.zeros(places, dtype=bool) for _ in c["sampled"][t]])
            alive, keys = self._walk(c, t, padded.ravel(), starts, note=True)
            order = np.argsort(keys, kind="stable")
            c["keys"].append((keys[order], own[alive // padded.shape[1]][order]))

    def _walk(self, c: dict, t: int, words: np.ndarray, starts: np.ndarray, note: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts whose sampled steps all stand on words of items, and their keys.

        A word of no item (0) ends a walk that samples it, and so does the beginning of a key that no item's key has (begun,
        a table of hashed beginnings, which items note first).
        """
        at, keys, sampled, begun = starts.copy(), np.zeros(len(starts), dtype=np.int64), c["sampled"][t].tolist(), c["begun"][t]
        for j in range(sampled[-1] + 1):
            w = words[at]
            if j in sampled:
                keys = (keys * np.int64(0x5851F42D4C957F2D) + w) ^ keys >> np.int64(31)
                table = begun[sampled.index(j)]
                place = (keys ^ keys >> np.int64(27)) & np.int64(len(table) - 1)
                if note:
                    table[place[w > 0]] = True
                keep = (w > 0) & table[place]
                starts, at, w, keys = starts[keep], at[keep], w[keep], keys[keep]
                if not len(at):
                    break
            at += (self.drawn[w] * c["odd"][t][j] >> np.uint64(63)).astype(np.int64)
        return starts, keys

    def _candidates(self, words: np.ndarray, stop: int, classes: list[dict] | None = None, rep_of: dict | None = None) -> dict[int, list[tuple[int, int]]]:
        """item -> (start, stop) of what to verify in words[:stop]; beyond, words is padded with words of no item."""
        foreign = np.concatenate((np.zeros(1, np.int32), np.cumsum(words == 0, dtype=np.int32)))
        telling = np.concatenate((np.zeros(1, np.int32), np.cumsum(self.telling[words], dtype=np.int32)))
        pairs = []
        for c in self.classes if classes is None else classes:
            if c["pieces"] is not None:
                pairs += self._piece_hits(c["pieces"], words, stop, foreign, telling)
                continue
            starts = np.flatnonzero(telling[c["reach"] : stop + c["reach"]] - telling[:stop] >= c["need"]) if c["need"] > 0 else np.arange(stop)
            starts = starts[foreign[starts + c["low"]] - foreign[starts] <= c["edits"]]
            if not len(starts):
                continue
            for t, (keys, owners) in enumerate(c["keys"]):
                alive, found = self._walk(c, t, words, starts)
                lo, n = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
                n -= lo
                hit = np.flatnonzero(n)
                if len(hit):
                    size = n[hit]
                    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    one = np.stack([owners[np.repeat(lo[hit], size) + k], np.repeat(alive[hit], size)], axis=1)
                    pairs.append(one)
                    if rep_of is not None:
                        for i, s in one.tolist():
                            rep_of.setdefault((i, s), t)
        out: dict[int, list[tuple[int, int]]] = {}
        for i, s in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
            # Walks that met need not start alike: the item may begin some edits before the window.
            e, n = self.edits[i], len(self.items[i])
            lo, hi, spans = max(0, s - e), s + n + 2 * e, out.setdefault(i, [])
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], hi)
            else:
                spans.append((lo, hi))
        return out

    def _calibrate(self, c: dict, recall: float, rng: np.random.Generator) -> None:
        """As many walks as the class needs, and the recall that they have on other trials; pieces if MOST_REPEATS are too few."""
        if recall < 1:
            while len(c["keys"]) < MOST_REPEATS:
                self._extend(c, min(MOST_REPEATS, max(16, 2 * len(c["keys"]))), rng)
                first = self._trials(c, rng)
                # One standard deviation more than is asked for, as the trials are a sample.
                need = int(np.ceil(min(1.0, recall + (recall * (1 - recall) / TRIALS) ** 0.5) * TRIALS))
                if first[need - 1] < len(c["keys"]):
                    for part in ("keys", "begun", "sampled", "odd"):
                        c[part] = c[part][: first[need - 1] + 1]
                    found = sum(t < len(c["keys"]) for t in self._trials(c, rng)) / TRIALS
                    if found >= recall - 2 * (recall * (1 - recall) / TRIALS) ** 0.5:
                        c["recall"] = found
                        return
        c |= {"keys": [], "begun": [], "sampled": [], "odd": [], "pieces": self._pieces(c["own"]), "recall": 1.0}

    def _trials(self, c: dict, rng: np.random.Generator) -> list[int]:
        """The walk that first finds each of TRIALS items of the class with all the edits that are allowed, ascending; the
        number of walks for those that none finds."""
        gap = np.zeros(2 * c["reach"] + 2, dtype=np.int32)
        chosen, rows = rng.choice(c["own"], TRIALS).tolist(), [gap]
        for i in chosen:
            words = self.items[i].tolist()
            for _ in range(self.edits[i]):
                p, kind = int(rng.integers(0, max(1, len(words)))), int(rng.integers(0, 3))
                words[p : p + (kind != 1)] = [] if kind == 2 else [int(rng.choice([0, rng.integers(1, len(self.vocabulary) + 1)]))]
            rows += [np.array(words, dtype=np.int32), gap]
        begins = np.cumsum([len(a) + len(b) for a, b in zip(rows[::2], [np.zeros(0), *rows[1::2]])])
        every, reps = np.concatenate(rows), {}
        self._candidates(every, len(every) - len(gap), [c], reps)
        first = [len(c["keys"])] * TRIALS
        for (i, start), t in reps.items():
            trial = int(np.searchsorted(begins, start + len(gap) // 2, side="right")) - 1
            if 0 <= trial < TRIALS and chosen[trial] == i and t < first[trial]:
                # What is verified must hold the whole passage.
                e, n, size = self.edits[i], len(self.items[i]), len(rows[2 * trial + 1])
                if start - e <= begins[trial] and start + n + 2 * e >= begins[trial] + size:
                    first[trial] = t
        return sorted(first)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers of the items' vocabulary from 1 on; 0 for all others."""
        out = np.zeros(len(hashes), dtype=np.int32)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(46)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[some]
        out[some[same]] = place[same] + 1
        return out

    def leaks(self, docs: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """(item id, edits) of each leaked item, for each document's symbols. Documents are looked at together, but are kept
        apart by words of no item, so what one leaks does not depend on the others."""
        gap = np.zeros(max((2 * c["reach"] for c in self.classes), default=0) + 2, dtype=np.int32)
        out: list[list[tuple[int, int]]] = [[] for _ in docs]
        if not self.items or not docs:
            return out
        words = np.concatenate([x for d in docs for x in (d, gap)])
        begins = np.concatenate(([0], np.cumsum([len(d) + len(gap) for d in docs])))
        for i, spans in self._candidates(words, len(words) - len(gap)).items():
            item, best = self.items[i].tolist(), {}
            held = np.zeros(len(self.vocabulary) + 1, dtype=bool)
            held[self.items[i]] = True
            for lo, hi in spans:
                first, last = np.searchsorted(begins, [lo, hi], side="right") - 1
                for d in range(first, min(last, len(docs) - 1) + 1):
                    part = words[max(lo, begins[d]) : min(hi, begins[d] + len(docs[d]))]
                    if held[part].sum() >= len(item) - self.edits[i]:
                        best[d] = min(best.get(d, len(item)), edit_distance_within(item, part.tolist()))
            for d, e in best.items():
                if e <= self.edits[i]:  # a place with fewer edits may be no candidate of the walks
                    out[d].append((self.ids[i], edit_distance_within(item, docs[d].tolist()) if e and self.walked[i] else e))
        return [sorted(x) for x in out]

    def of_texts(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        hasher, out, held, size = WordHasher(), [], [], 0
        for text in texts:
            held.append(self.symbols(hasher.words(text)) if len(self.vocabulary) else np.zeros(0, np.int32))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                out += self.leaks(held)
                held, size = [], 0
        return out + self.leaks(held)


def _blocks(benchmark: DataFrame, max_rate: float, recall: float) -> DataFrame:
    """block, index (a LeakIndex's pickled attributes), classes: one row for each block of items."""
    usable = materialize(benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")), "items")
    n_blocks = -(-usable.count() // BLOCK_ITEMS)
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("row", "text"), F.lit(max(1, n_blocks))).cast("int"))

    def build(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["item_id", "text"])
        index = LeakIndex(list(zip(items["item_id"].tolist(), items["text"])), max_rate, recall)
        classes = [{"least_words": c["low"], "most_words": c["top"], "items": len(c["own"]), "walks": len(c["keys"]), "recall": c["recall"]} for c in index.classes]
        return pd.DataFrame({"block": [items["block"].iloc[0]], "index": [pickle.dumps(vars(index))], "classes": [classes]})

    return materialize(dealt.groupBy("block").applyInPandas(build, "block int, index binary, classes array<struct<least_words:int,most_words:int,items:int,walks:int,recall:double>>"), "index")


def leak_classes(benchmark: DataFrame, max_rate: float = MAX_RATE, recall: float = TARGET_RECALL) -> DataFrame:
    """block, least_words, most_words, items, walks, recall of each class of items; without walks it is searched exactly."""
    return _blocks(benchmark, max_rate, recall).select("block", F.explode("classes").alias("c")).select("block", "c.*")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_rate: float = MAX_RATE, recall: float = TARGET_RECALL) -> DataFrame:
    """docs with leaks: array of (item_id, edits), by item_id. benchmark: item_id, text."""
    kind = "array<struct<item_id:long,edits:int>>"
    blocks = _blocks(benchmark, max_rate, recall)
    numbers = [r.block for r in blocks.select("block").orderBy("block").collect()]  # one for each BLOCK_ITEMS items

    def of_block(number: int) -> Column:
        index = LeakIndex.__new__(LeakIndex)
        vars(index).update(pickle.loads(blocks.where(F.col("block") == number).first()["index"]))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf(kind)
        def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([[{"item_id": i, "edits": e} for i, e in one] for one in shared.value.of_texts(list(texts))], dtype=object)

        return leaks(F.col(text))

    if len(numbers) < 2:
        return with_fresh(docs, {"leaks": of_block(numbers[0]) if numbers else F.array().cast(kind)})
    rows = materialize(docs.withColumn("__leak_row", F.monotonically_increasing_id()), "rows")
    # A block is written before the next one is loaded.
    found = reduce(DataFrame.union, [materialize(rows.select("__leak_row", of_block(n).alias("leaks")).where(F.size("leaks") > 0), "leaks") for n in numbers])
    every = found.groupBy(F.col("__leak_row").alias("__leak_of")).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("__leaks"))
    joined = rows.join(every, F.col("__leak_row") == F.col("__leak_of"), "left")
    return with_fresh(joined, {"leaks": F.coalesce("__leaks", F.array().cast(kind))}).drop("__leak_row", "__leak_of", "__leaks")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that leak an item; their columns stay as they are."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    return find_leaks(marked, benchmark, **how).where(F.size("leaks") == 0).select("__row.*")
