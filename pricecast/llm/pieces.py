"""SentencePiece encoding and decoding with a relational lattice.

Text is cut into words where no piece of the model can reach across: before a run of blanks, and around line feeds.
The words of all documents are counted, and the most frequent ones, ``dictionary`` at most, are encoded by
relations: all substrings of at most the longest piece's length are exploded, joined with the piece table, and the
edges of a word are grouped into its lattice. A higher-order fold then walks the lattice. The dictionary, bounded by
its number of words and their length, is sent to all tasks, which put the documents together.

Two folds are offered. ``viterbi`` finds the path with the highest sum of scores; that is what a unigram model means.
In a BPE model scores are merge ranks and the best path is not the model's encoding (it cuts words into more and other
pieces), so for it ``merges`` folds the lattice by the model's rule: as long as there is one, merge the two
neighbours whose union is the best-ranked edge, leftmost first. Scores that are all whole numbers are ranks.

Words outside the dictionary (rare, or longer than ``longest_word``) are encoded where they occur by the same rule, so
no word is left out and results do not depend on the size of the dictionary. What a task remembers of them is bounded.

Defined results: null and empty texts have no pieces; characters without a piece become byte pieces; the blank mark
U+2581 in a text reads as a blank and decodes to one; decoding gives back every other text exactly; repeated rows are
encoded alike; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import free_name
from pricecast.sources.scratch import settle

BLANK = "▁"
WORD = re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
CACHED = 100_000
REMEMBERED = 200_000
"""Words outside the dictionary that a task keeps; it then begins anew."""


@dataclass(frozen=True)
class Model:
    """The pieces of a model file by id: text, score, kind (0 plain, 1 byte, 2 not for text)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        kinds = tuple(1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0 for i in ids)
        model = Model(tuple(p.id_to_piece(i) for i in ids), tuple(p.get_score(i) for i in ids), kinds)
        plain = [s for s, k in zip(model.pieces, kinds, strict=True) if k == 0]
        if any("\n" in s or BLANK in s.lstrip(BLANK) for s in plain):
            raise ValueError("the model has pieces that reach across words")
        if len(model.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        return model

    @cached_property
    def byte_ids(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == 1]

    @cached_property
    def ranks(self) -> dict[str, tuple[float, int]]:
        """Score and id of the plain pieces."""
        return {s: (score, i) for i, (s, score, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k == 0}

    @cached_property
    def decoded(self) -> list[bytes]:
        out = [s.replace(BLANK, " ").encode() for s in self.pieces]
        for value, i in enumerate(self.byte_ids):
            out[i] = bytes([value])
        return out

    @property
    def is_bpe(self) -> bool:
        scores = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == 0]
        return all(s <= 0 and s == int(s) for s in scores)

    @property
    def longest(self) -> int:
        return max(map(len, self.ranks), default=1)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of two neighbouring pieces whose union is a piece, and the id of that piece."""
        found, width = [], len(self.pieces) + 1
        for s, (_, i) in self.ranks.items():
            for at in range(1, len(s)):
                if (left := self.ranks.get(s[:at])) and (right := self.ranks.get(s[at:])):
                    found.append((left[1] * width + right[1], i))
        keys, ids = np.array(sorted(found), np.int64).reshape(-1, 2).T
        return np.append(keys, np.iinfo(np.int64).max), np.append(ids, -1).astype(np.int32)

    @cached_property
    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted code points that are pieces, and their ids."""
        codes, ids = np.array(sorted((ord(s), i) for s, (_, i) in self.ranks.items() if len(s) == 1), np.int64).reshape(-1, 2).T
        return np.append(codes, 0x110000), np.append(ids, -1).astype(np.int32)

    def of_characters(self, s: str) -> list[int]:
        """A symbol no edge covers, as bytes."""
        found = self.ranks.get(s)
        return [found[1]] if found else [self.byte_ids[b] for b in s.encode("utf-8", "replace")]

    def merged(self, word: str) -> list[int]:
        """The rule of ``merges`` for one word, with a heap of possible merges."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 for none
        before = list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(at: int) -> None:
            middle = end[at]
            if middle < n and (found := ranks.get(word[at : end[middle]])):
                heapq.heappush(heap, (-found[0], at, end[middle]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, at, to = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != to:
                continue
            end[at], end[middle] = to, 0
            if to < n:
                before[to] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        out, at = [], 0
        while at < n:
            out += self.of_characters(word[at : end[at]])
            at = end[at]
        return out

    def merged_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other and the number of each word's, by the same rule in all words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        known, ids = self.characters
        at = np.searchsorted(known, codes)
        letters = np.where(known[at] == codes, ids[at], -1)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        strange = np.zeros(len(words), bool)
        strange[np.searchsorted(ends, np.flatnonzero(letters < 0), side="right")] = True
        strange |= (sizes > SHORT) | (sizes == 0)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = np.flatnonzero((sizes > low) & (sizes <= high) & ~strange)
            for first in range(0, len(rows), 8192):
                part = rows[first : first + 8192]
                parts += [(part[who], n, flat) for who, n, flat in self.merged_rows(letters, starts[part], sizes[part], high)]
        alone = np.flatnonzero(strange)
        lists = [self.merged(words[i]) for i in alone]
        if lists:
            parts.append((alone, np.array(list(map(len, lists))), np.fromiter(chain.from_iterable(lists), np.int32)))
        out_sizes = np.zeros(len(words), np.int64)
        for who, n, _ in parts:
            out_sizes[who] = n
        out_starts = np.cumsum(out_sizes) - out_sizes
        out = np.empty(int(out_sizes.sum()), np.int32)
        for who, n, flat in parts:
            out[np.repeat(out_starts[who] - np.cumsum(n) + n, n) + np.arange(len(flat))] = flat
        return out, out_sizes

    def merged_rows(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers, sizes and ids of words of at most ``width`` letters, as they are done; each round merges once in every row."""
        keys, merged = self.pairs
        scores = np.append(np.array(self.scores, np.float64), NO_PIECE)
        none = len(self.pieces)
        columns = np.arange(width)

        def union(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """The piece of each two neighbours, -1 for none; ``none`` stands behind the end of a word."""
            key = left.astype(np.int64) * (none + 1) + right
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, merged[at], -1)

        who = np.arange(len(sizes))
        inside = columns < sizes[:, None]
        parts = np.where(inside, letters[np.where(inside, starts[:, None] + columns, 0)], none)
        parts = np.concatenate([parts, np.full((len(sizes), 1), none)], axis=1)
        # Pair j is that of the parts j and j + 1.
        pairs = union(parts[:, :-1], parts[:, 1:])
        value = scores[pairs]
        while len(who):
            at = value.argmax(axis=1)
            rows = np.arange(len(who))
            more = value[rows, at] > NO_PIECE
            if not more.all():
                done = parts[~more]
                filled = done != none
                yield who[~more], filled.sum(axis=1), done[filled].astype(np.int32)
                who, parts, pairs, value, at = who[more], parts[more], pairs[more], value[more], at[more]
                rows = np.arange(len(who))
            parts[rows, at] = pairs[rows, at]
            behind = columns > at[:, None]
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = none
            behind = columns[:-1] >= at[:, None]
            pairs[:, :-1] = np.where(behind, pairs[:, 1:], pairs[:, :-1])
            value[:, :-1] = np.where(behind, value[:, 1:], value[:, :-1])
            pairs[:, -1], value[:, -1] = -1, NO_PIECE
            before = np.maximum(at - 1, 0)
            for place in (before, at):
                now = union(parts[rows, place], parts[rows, place + 1])
                pairs[rows, place], value[rows, place] = now, scores[now]

    def best_path(self, word: str) -> list[int]:
        """The rule of ``viterbi`` for one word."""
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for to in range(1, len(word) + 1):
            for at in range(max(0, to - self.longest), to):
                found = self.ranks.get(word[at:to])
                cost = found[0] if found else UNKNOWN if to == at + 1 else None
                if cost is not None and best[at][0] + cost > best[to][0]:
                    best[to] = (best[at][0] + cost, at)
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.of_characters(word[a:b])]


WIDTHS = (6, 8, 10, 12, 16, 24, 48)
"""Words are merged together with others of about their length."""
SHORT = WIDTHS[-1]
NO_PIECE = float("-inf")
UNKNOWN = -1e6
"""Score of a character without a piece on a path."""


def words_of(text: str | None) -> list[str]:
    return WORD.findall((BLANK + text).replace(" ", BLANK)) if text else []


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all documents; each task adds up what it has seen, in portions of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for t in batch[0]:
                seen.update(words_of(t.as_py()))
                if len(seen) >= 2 * CACHED:
                    yield told()
                    seen.clear()
        if seen:
            yield told()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int, longest_word: int) -> DataFrame:
    """Words at or above the lowest count that at most ``most`` words reach."""
    short = counts.where(F.length("word") <= longest_word)
    # At most a million rows: higher counts are not told apart.
    steps = short.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("words")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r.n):
        total += r.words
        if total > most:
            break
        least = r.n
    return short.where(F.col("n") >= least).select("word") if least is not None else short.limit(0).select("word")


def lattices(words: DataFrame, model: Model) -> DataFrame:
    """word and edges (start, end, id, score) of the pieces that occur in it; characters count from 0."""
    spark = words.sparkSession
    plain = list(model.ranks.items())
    pieces = spark.createDataFrame(
        pa.table({"piece": [s for s, _ in plain], "id": pa.array([i for _, (_, i) in plain], pa.int32()), "score": [float(x) for _, (x, _) in plain]})
    )
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    parts = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("start")))).alias("size"))
    parts = parts.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("size")))
    # The piece table is the model's vocabulary.
    edges = parts.join(F.broadcast(pieces), "piece")
    edge = F.struct("start", (F.col("start") + F.col("size")).alias("end"), "id", "score")
    grouped = edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))
    return words.join(grouped, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<start:int,end:int,id:int,score:double>>")))


def cuts_by_merges(word: Column, edges: Column) -> Column:
    """The boundaries that are left when no two neighbours can be merged."""

    def merge(cuts: Column, _: Column) -> Column:
        def possible(e: Column) -> Column:
            inside = F.size(F.filter(cuts, lambda c: (c > e["start"]) & (c < e["end"])))
            return F.array_contains(cuts, e["start"]) & F.array_contains(cuts, e["end"]) & (inside == 1)

        ranked = F.transform(F.filter(edges, possible), lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("left"), e["end"].alias("end")))
        # The best merge is one value that two places need, hence the list of one.
        return F.get(
            F.transform(F.array(F.array_max(ranked)), lambda m: F.when(m.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= -m["left"]) | (c >= m["end"])))),
            F.lit(0),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.sequence(F.lit(0), F.length(word)), merge)


def cuts_by_viterbi(word: Column, edges: Column) -> Column:
    """The boundaries of the path with the highest score, earlier starts first among equals."""
    node = "array<struct<score:double,cuts:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts"))).cast(node)

    def step(best: Column, to: Column) -> Column:
        single = F.struct((to - 1).alias("start"), to.alias("end"), F.lit(-1).alias("id"), F.lit(UNKNOWN).alias("score"))
        here = F.filter(edges, lambda e: e["end"] == to)
        here = F.when(F.exists(here, lambda e: e["start"] == to - 1), here).otherwise(F.concat(here, F.array(single)))
        paths = F.transform(
            here,
            lambda e: F.struct(
                (F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("left"), F.array_append(F.get(best, e["start"])["cuts"], to).alias("cuts")
            ),
        )
        top = F.array_max(paths)
        return F.array_append(best, F.struct(top["score"].alias("score"), top["cuts"].alias("cuts")))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda best: F.get(best, F.size(best) - 1)["cuts"])


def encoded_words(words: DataFrame, model: Model, fold: str) -> DataFrame:
    """word, ids: the lattice of each word folded, bytes for what no edge covers."""
    cut = cuts_by_merges if fold == "merges" else cuts_by_viterbi
    made = lattices(words, model).withColumn("cuts", cut(F.col("word"), F.col("edges")))
    cuts, edges, word = F.col("cuts"), F.col("edges"), F.col("word")
    byte_ids = F.array(*map(F.lit, model.byte_ids))

    def ids(at: Column, to: Column) -> Column:
        found = F.filter(edges, lambda e: (e["start"] == at) & (e["end"] == to))
        digits = F.hex(F.encode(F.substr(word, at + 1, to - at), "UTF-8"))
        raw = F.transform(
            F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1),
            lambda i: F.get(byte_ids, F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")),
        )
        return F.when(F.size(found) > 0, F.transform(found, lambda e: e["id"])).otherwise(raw)

    spans = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), ids)
    return made.select("word", F.flatten(spans).alias("ids"))


class Known(dict):
    """Numbers of words; words that are not in the dictionary are encoded by the model's rule when first met."""

    def __init__(self, model: Model, fold: str, words: list[str], starts: np.ndarray, ids: np.ndarray):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.model, self.fold = model, fold
        self.words = words
        self.fixed_starts, self.fixed_ids = starts, ids
        self.starts, self.ids = starts, ids
        """Of each known word in ``ids``, and the end."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        new = list(islice(reversed(self), len(self) - len(self.starts) + 1))[::-1]
        if not new:
            return
        if self.fold == "merges":
            ids, sizes = self.model.merged_many(new)
        else:
            lists = list(map(self.model.best_path, new))
            ids, sizes = np.fromiter(chain.from_iterable(lists), np.int32), np.array(list(map(len, lists)))
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > len(self.words) + REMEMBERED:
            self.clear()
            self.update(zip(self.words, range(len(self.words)), strict=True))
            self.starts, self.ids = self.fixed_starts, self.fixed_ids
        numbers = []
        for t in texts:
            words = words_of(t)
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self.learn()
        starts, flat = self.starts, self.ids
        sizes = np.diff(starts)
        out = []
        for own in numbers:
            n = sizes[own]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(starts[own] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)])
        return out


def decoded(ids: np.ndarray, model: Model) -> str:
    table = model.decoded
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    into: str = "ids",
    fold: str | None = None,
    dictionary: int = 200_000,
    longest_word: int = 32,
    decodes_into: str | None = None,
) -> DataFrame:
    """Add the piece ids of every whole text; ``path`` is a model file that all machines have.

    ``decodes_into`` names a column that tells whether the ids decode to the text (null as empty), found where they
    are made.
    """
    model = Model.load(path)
    fold = fold or ("merges" if model.is_bpe else "viterbi")
    words = settle(most_frequent(settle(word_counts(docs, text)), dictionary, longest_word))
    known = encoded_words(words, model, fold).toArrow()
    ids = known["ids"].combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int32()))
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    sizes = np.array(ids.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((model, known["word"].to_pylist(), np.r_[0, np.cumsum(sizes)], flat))
    names = docs.columns
    column = free_name(names, into)
    fields = [*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]
    checked = None if decodes_into is None else free_name([*names, column], decodes_into)
    if checked:
        fields.append(T.StructField(checked, T.BooleanType()))
    schema = T.StructType(fields)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, listed, starts, all_ids = sent.value
        memory = Known(own, fold, listed, starts, all_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part[text].to_pylist()
                found = memory.encode(texts)
                offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))]
                if checked:
                    more.append(pa.array([decoded(f, own) == (t or "") for f, t in zip(found, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *more], names=[*names, column, *([checked] if checked else [])])

    return docs.mapInArrow(assemble, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the piece ids stand for; null ids give the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Model.load(path))
    names = encoded.columns
    column = free_name(names, into)
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [decoded(np.array(i.as_py() or [], np.int64), model) for i in part[ids]]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(texts, pa.string())], names=[*names, column])

    return encoded.mapInArrow(read, schema)
