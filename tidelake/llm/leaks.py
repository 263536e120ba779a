"""Evaluation passages inside corpus texts: a distributed positional inverted index of the corpus, and phrase search in it.

The index is sharded by text. A shard holds some hundreds of thousands of words: one row a term (a word, lower case
without accents) with the list of all its places in the shard, and one head row with the texts' keys, where each text
starts, and a sketch of the letters at each place. Every word of every text is in it, whatever will be asked later: a
second suite of passages searches the stored index and reads no text again.

A search brings the lists of the passages' words together, shard by shard. Each sequence of GRAM words of a passage is
a phrase; its lists are intersected at their offsets, from the rarest word of the shard on. Phrases that advance
together in text and passage form a piece: on one diagonal across words of which single letters were changed (the
sketches of both sides tell), or across a page header (a jump in the text only). A word exchanged for another ends the
piece, so formulas that share a frame with the passage stay short pieces. A case has one or two pieces, in the
passage's order, that together hold SHARE of its words. Where it takes two, neither may be a formula: a piece all of
whose phrases stand in more texts that do not hold the passage than in texts that do. A passage copied into any number
of texts is therefore no formula, and the size of the corpus plays no part.

No list and no text is gathered outside its shard, so a word that fills a third of the corpus is spread like the
corpus. Passages are taken in blocks of bounded size; only a block's words and phrases go to every task."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelake.session import ship

GRAM = 5
#: Share of a passage's words that makes a case.
SHARE = 0.4
#: Words that a page header may put between two words of a piece; passage positions between two phrases of a piece.
HEADER, HIDDEN = 24, 14
#: Sketches of a word and of the same word with a letter changed differ in at most so many bits.
CHANGED = 2
#: Words of a shard; a longer text is a shard of its own.
SHARD = 400_000
#: Shards a task searches, one after another.
SHARDS_A_TASK = 6
#: Characters of the passages looked for at once; more are looked for in several blocks.
BLOCK_CHARS = 2_000_000
#: Places looked at together while lists are intersected.
AT_ONCE = 1_000_000
#: Pairs of a text and a passage that are counted in one array.
DENSE = 1 << 23
#: Words a worker remembers the spelling of.
REMEMBERED = 300_000

WORD = re.compile(r"\w+")
#: A hyphen inside a word, with or without a line break after it, is no border.
JOIN = re.compile(r"(?<=[^\W\d_])[-­‐‑][ \t]*\n?[ \t]*(?=[^\W\d_])")
BITS = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.int8)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return WORD.findall(fold(JOIN.sub("", text)))


def sketch(word: str) -> int:
    """Which letters a word has, in 16 bits: one changed letter flips at most two."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 15)
    return out


# the index


class Vocabulary:
    """Numbers of words met by one worker; forgotten when there are too many."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.spelt: list[str] = []
        self.sketches: list[int] = []
        self.pieces: dict[str, tuple[int, ...]] = {}

    def codes(self, text: str) -> list[int]:
        """The word numbers of a text."""
        out: list[int] = []
        pieces = self.pieces
        for piece in JOIN.sub("", text).split():
            known = pieces.get(piece)
            out.extend(self._new(piece) if known is None else known)
        return out

    def _new(self, piece: str) -> tuple[int, ...]:
        made = []
        for w in WORD.findall(fold(piece)):
            n = self.number.get(w)
            if n is None:
                n = self.number[w] = len(self.spelt)
                self.spelt.append(w)
                self.sketches.append(sketch(w))
            made.append(n)
        out = tuple(made)
        if len(piece) < 40:
            self.pieces[piece] = out
        return out


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes, seven bits in each, the lowest first, all but the last marked; and how many bytes each took."""
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = np.flatnonzero(sizes > k)
        out[start[some] + k] = (numbers[some] >> 7 * k & 127) | ((sizes[some] > k + 1) << 7)
    return out, sizes


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of pack(), and where the last byte of each stands."""
    last = np.flatnonzero(packed < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), dtype=np.int64)
    for k in range(int((last - start).max()) + 1 if len(last) else 0):
        some = np.flatnonzero(start + k <= last)
        out[some] |= (packed[start[some] + k].astype(np.int64) & 127) << 7 * k
    return out, last


def shard_rows(vocabulary: Vocabulary, texts: list[list[int]]) -> tuple[list[str], np.ndarray, pa.Array, bytes, bytes]:
    """terms, how many places each has, the places (packed gaps, the first from 0), starts of the texts (int64) and sketches (uint16) of one shard. GRAM empty places part the texts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + GRAM)[:-1]]).astype(np.int64)
    flat = np.fromiter((c for t in texts for c in t), dtype=np.int64, count=int(lengths.sum()))
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(flat))
    order = np.argsort(flat, kind="stable")
    code, at = flat[order], place[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    packed, sizes = pack(gaps)
    ends = np.concatenate([(np.cumsum(sizes) - sizes)[first], [len(packed)]]).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
    marks = np.zeros(int((lengths + GRAM).sum()), dtype=np.uint16)
    marks[place] = np.array(vocabulary.sketches, dtype=np.uint16)[flat] if len(flat) else []
    return [vocabulary.spelt[c] for c in code[first].tolist()], np.diff(np.append(first, len(code))), lists, starts.tobytes(), marks.tobytes()


def build_index(texts: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the index of all texts under a path: shard, term ('' in the head row), n (its places, or the shard's texts), places (in the head row the texts' starts), sketches, keys. Null texts are in no shard.

    One narrow stage. A shard's number is made of the task's, so a task run again writes the same rows."""
    ship(texts.sparkSession)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, held, size = Vocabulary(), [], [], 0
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            terms, counts, lists, starts, marks = shard_rows(known, held)
            n = len(terms)
            heads = pa.array([marks] + [None] * n, pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * (n + 1), pa.int64()), pa.array(["", *terms], pa.string()), pa.array([len(keys), *counts.tolist()], pa.int64()), pa.concat_arrays([pa.array([starts], pa.binary()), lists]), heads, pa.array([keys] + [None] * n, pa.list_(arrow))],
                ["shard", "term", "n", "places", "sketches", "keys"],
            )

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = known.codes(t)
                if held and size + len(codes) + GRAM > SHARD:
                    yield flush()
                    number, keys, held, size = number + 1, [], [], 0
                    if len(known.spelt) + len(known.pieces) > REMEMBERED:
                        known.clear()
                        codes = known.codes(t)
                keys.append(k)
                held.append(codes)
                size += len(codes) + GRAM
        if held:
            yield flush()

    schema = f"shard bigint, term string, n bigint, places binary, sketches binary, keys array<{kind.simpleString()}>"
    rows.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)


# the passages


class Phrases:
    """The passages' words and word sequences, numbered, with where they stand in which passage.

    A passage of fewer than GRAM words is one phrase, which must stand whole."""

    def __init__(self, items: list, passages: list[str]) -> None:
        self.items = items
        texts = [words(p) for p in passages]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.sketches = [np.array([sketch(w) for w in t], dtype=np.uint16) for t in texts]
        rows, item, at = [], [], []
        for i, t in enumerate(texts):
            code = [self.vocabulary[w] for w in t] + [-2] * max(0, GRAM - len(t))
            for q in range(len(code) - GRAM + 1 if t else 0):
                rows.append(code[q : q + GRAM])
                item.append(i)
                at.append(q)
        sizes = np.bincount(np.array(item, dtype=np.int64), minlength=len(texts))
        grams = np.array(rows, dtype=np.int32).reshape(-1, GRAM)
        self.grams, number = np.unique(grams, axis=0, return_inverse=True)
        by = np.argsort(number.reshape(-1), kind="stable")
        self.where_item, self.where_pos = np.array(item, dtype=np.int64)[by], np.array(at, dtype=np.int64)[by]
        self.where_from = np.searchsorted(number.reshape(-1)[by], np.arange(len(self.grams) + 1))
        self.of_item = [number.reshape(-1)[a:b] for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]


def intersect(grams: np.ndarray, places: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and place of every phrase in a shard, by place.

    places: the words' lists one after another, sizes: their lengths by word, at: the word at each place (-1: another).
    The list of a phrase's rarest word is taken; what the next rarer words lack at their offsets falls out first."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.where(grams < 0, np.iinfo(np.int64).max, sizes[grams])  # words that are not asked for come last
    whole = np.flatnonzero(np.where(grams < 0, 1, sizes[grams]).min(axis=1) > 0)
    order = np.argsort(rank[whole], axis=1, kind="stable")
    wanted = np.ascontiguousarray(np.take_along_axis(grams[whole], order, 1).T)  # word by word, the rarest first
    order, rarest = np.ascontiguousarray(order.T), wanted[0]
    upto = np.cumsum(sizes[rarest])
    found, a = [], 0
    while a < len(whole):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
        n = sizes[rarest[a:b]]
        phrase = np.repeat(np.arange(a, b), n)
        flat = np.repeat(start[rarest[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = places[flat] - order[0][phrase]
        keep = (base >= 0) & (base + GRAM <= len(at))
        phrase, base = phrase[keep], base[keep]
        for j in range(1, GRAM):
            want = wanted[j][phrase]
            keep = (want < 0) | (at[base + order[j][phrase]] == want)
            phrase, base = phrase[keep], base[keep]
        found.append((whole[phrase], base))
        a = b
    phrase = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    base = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
    by = np.argsort(base)  # a place has one phrase at most, but for short ones
    return phrase[by], base[by]


def split(group: np.ndarray, value: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups, numbered in their old order, cut where sorted values lie more than gap apart; and the order by group and value."""
    low = int(value.min())
    by = np.argsort(group * (int(value.max()) - low + 1) + (value - low))
    cut = np.concatenate([[False], (np.diff(group[by]) != 0) | (np.diff(value[by]) > gap)])
    out = np.empty_like(group)
    out[by] = np.cumsum(cut)
    return out, by


def candidates(t: Phrases, phrase: np.ndarray, pos: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair (text * items + item), place in the text and in the passage, sorted, of every pair that may reach SHARE.

    Neighbours in a piece lie at most HIDDEN + HEADER words of the text and HIDDEN of the passage apart, and their offsets
    HEADER, so a piece lies in one cluster when clusters are cut at wider gaps. A piece begins with GRAM words and each
    further position adds its distance at most; two pieces in one cluster are GRAM positions apart. The best two
    clusters therefore bound the words of any two pieces: what is left out here can't be a case."""
    start = t.where_from[phrase]
    n = t.where_from[phrase + 1] - start
    flat = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    items, need = len(t.lengths), SHARE * t.lengths
    pair = np.repeat(text.astype(np.int64), n) * items + t.where_item[flat]
    if not len(pair):
        return pair, pair, pair
    if items * (int(text.max()) + 1) <= DENSE:
        many = np.bincount(pair)
        keep = np.flatnonzero((HIDDEN * many >= need[np.arange(len(many)) % items])[pair])
    else:
        names, of, many = np.unique(pair, return_inverse=True, return_counts=True)
        keep = np.flatnonzero((HIDDEN * many >= need[names % items])[of])
    pair, p, q = pair[keep], np.repeat(pos, n)[keep].astype(np.int64), t.where_pos[flat[keep]]
    if not len(pair):
        return pair, p, q
    cluster = split(split(pair, p, HIDDEN + HEADER)[0], p - q, HEADER)[0]
    cluster, by = split(cluster, q, HIDDEN)
    same = np.diff(cluster[by]) == 0
    adds = np.concatenate([[GRAM], np.where(same, np.diff(q[by]), GRAM)])
    most = np.bincount(cluster[by], weights=adds)
    of = np.empty(len(most), dtype=np.int64)
    of[cluster] = pair
    by = np.lexsort((-most, of))
    of, most = of[by], most[by]
    first = np.concatenate([[True], np.diff(of) != 0])
    second = np.concatenate([[False], first[:-1]]) & ~first
    names = of[first]
    total = most[first] + np.bincount(np.searchsorted(names, of[second]), weights=most[second], minlength=len(names))
    names = names[total >= need[names % items]]
    keep = np.flatnonzero(np.isin(pair, names))
    keep = keep[np.lexsort((p[keep], p[keep] - q[keep], pair[keep]))]
    return pair[keep], p[keep], q[keep]


def pieces(p: np.ndarray, q: np.ndarray, text: np.ndarray, passage: np.ndarray) -> list[tuple[int, int, int]]:
    """(end, first, words) of every piece, by its end in the passage, given the phrases' places (sorted by p - q, then p) and the letter sketches of both sides."""
    step, same = np.diff(q), np.diff(p - q) == 0
    joined = same & (step <= GRAM)
    holes = np.flatnonzero(same & (step > GRAM) & (step <= HIDDEN))
    if len(holes):
        n = step[holes] - GRAM
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(holes, n)
        near = BITS[text[p[left] + GRAM + inside] ^ passage[q[left] + GRAM + inside]] <= CHANGED
        joined[holes] = np.logical_and.reduceat(near, np.cumsum(n) - n)
    ends = np.append(np.flatnonzero(~joined), len(q) - 1)
    begins = np.append(0, ends[:-1] + 1)
    # runs on one diagonal: first and last phrase in the text and in the passage
    runs = sorted(zip(p[begins].tolist(), q[begins].tolist(), p[ends].tolist(), q[ends].tolist(), strict=True))
    spans, open_runs = [], []  # of each run that later ones may go on from: last q, last p, first q, words
    for p0, q0, p1, q1 in runs:
        open_runs = [r for r in open_runs if p0 - r[1] <= 2 * GRAM + HEADER]
        first, n = q0, q1 - q0 + GRAM
        for last_q, last_p, earlier, so_far in open_runs:
            dq, dp = q0 - last_q, p0 - last_p
            if 0 < dq <= GRAM + 1 and dp > 0 and dp != dq and -1 <= dp - dq <= HEADER and so_far + q1 - last_q > n:
                first, n = earlier, so_far + q1 - last_q
        open_runs.append((q1, p1, first, n))
        spans.append((min(q1 + GRAM, len(passage)), first, min(n, len(passage))))
    return sorted(set(spans))


def best_two(spans: list[tuple[int, int, int]]) -> int:
    """Most words in one piece, or in two of which one ends before the other begins."""
    most, closed, tops = 0, [], []
    for last, first, n in spans:
        k = bisect_right(closed, first)
        most = max(most, n + (tops[k - 1] if k else 0))
        closed.append(last)
        tops.append(max(n, tops[-1] if tops else 0))
    return most


def without_formulas(spans: list[tuple[int, int, int]], rare: np.ndarray, alone: float) -> list[tuple[int, int, int]]:
    """The pieces with a phrase (a passage position) marked as rare, and those that hold so many words as alone by themselves."""
    return [s for s in spans if s[2] >= alone or rare[s[1] : max(s[1] + 1, s[0] - GRAM + 1)].any()]


def _lists(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of several lists one after another, and how many each has."""
    gaps, last = unpack(np.frombuffer(b"".join(blobs), dtype=np.uint8))
    upto = np.searchsorted(last, np.cumsum([len(b) for b in blobs]), "left") if blobs else np.zeros(0, np.int64)
    sizes = np.diff(upto, prepend=0)
    run = np.cumsum(gaps)
    before = np.concatenate([[0], run[upto[:-1] - 1]]) if len(blobs) else np.zeros(0, np.int64)
    return run - np.repeat(before, sizes), sizes


def search_shard(t: Phrases, starts: np.ndarray, sketches: np.ndarray, terms: list[int], blobs: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Of one shard: (text, item, pieces, passage positions found) of every pair with SHARE of the words in one or two pieces, formulas or not; the phrases in it; the texts with each.

    terms: word numbers, in rising order."""
    places, some = _lists(blobs)
    sizes = np.zeros(len(t.vocabulary), dtype=np.int64)
    sizes[terms] = some
    at = np.full(len(sketches), -1, dtype=np.int32)
    at[places] = np.repeat(np.array(terms, dtype=np.int32), some)
    phrase, base = intersect(t.grams, places, sizes, at)
    text = np.searchsorted(starts, base, "right") - 1
    held, texts = np.unique(np.unique(phrase * len(starts) + text) // max(1, len(starts)), return_counts=True)
    pair, p, q = candidates(t, phrase, base - starts[text], text)
    out = []
    edges = [*np.flatnonzero(np.diff(pair, prepend=-1)).tolist(), len(pair)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        doc, item = divmod(int(pair[lo]), len(t.lengths))
        spans = pieces(p[lo:hi], q[lo:hi], sketches[starts[doc] :], t.sketches[item])
        if best_two(spans) >= max(SHARE * t.lengths[item], min(GRAM, t.lengths[item])):
            out.append((doc, item, spans, np.unique(q[lo:hi])))
    return out, held, texts


# searching


def search_block(index: DataFrame, t: Phrases, path: str) -> None:
    """Writes, under a path, the pairs of one block of passages (key, item: place in the block, words, sure: whether one piece is enough, spans, held) and, shard by shard, how many texts have each phrase.

    One shuffle, of the asked words' lists, by shard."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(t)  # a block of passages: of bounded size
    asked = spark.createDataFrame([("", -1), *t.vocabulary.items()], "term string, number int")
    rows = index.join(F.broadcast(asked), "term").select("shard", "number", "places", "sketches", "keys")
    key_type = index.schema["keys"].dataType.elementType
    arrow, ints = to_arrow_type(key_type), pa.list_(pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        head, terms, blobs, current = None, [], [], None

        def close() -> pa.RecordBatch:
            keys, starts, sketches = head
            found, held, texts = search_shard(phrases, starts, sketches, terms, blobs)
            n = len(found)
            sure = [max(s[2] for s in spans) >= SHARE * phrases.lengths[i] for _, i, spans, _ in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[f[0]] for f in found] + [None], arrow), pa.array([f[1] for f in found] + [None], pa.int32()), pa.array([best_two(f[2]) for f in found] + [None], pa.int64()), pa.array(sure + [None], pa.bool_()),
                    pa.array([None if ok else [x for s in f[2] for x in s] for ok, f in zip(sure, found, strict=True)] + [None], ints), pa.array([f[3].tolist() for f in found] + [None], ints),
                    pa.array([None] * n + [held.astype(np.int32)], ints), pa.array([None] * n + [texts.astype(np.int32)], ints),
                ],
                ["key", "item", "words", "sure", "spans", "held", "phrases", "texts"],
            )

        for b in batches:
            for shard, number, places, sketches, keys in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != current:
                    if head is not None:
                        yield close()
                    head, terms, blobs, current = None, [], [], shard
                if number < 0:
                    head = keys, np.frombuffer(places, dtype=np.int64), np.frombuffer(sketches, dtype=np.uint16)
                else:
                    terms.append(number)
                    blobs.append(places)
        if head is not None:
            yield close()

    shards = index.filter("term = ''").count()
    ordered = rows.repartition(max(1, -(-shards // SHARDS_A_TASK)), "shard").sortWithinPartitions("shard", "number")
    ordered.mapInArrow(run, f"key {key_type.simpleString()}, item int, words bigint, sure boolean, spans array<int>, held array<int>, phrases array<int>, texts array<int>").write.mode("overwrite").parquet(path)


def judge(found: DataFrame, t: Phrases, item_type) -> DataFrame:
    """key, item, words, length: the pairs that are cases without their formulas. Only pairs that need two pieces are judged.

    Brought to the driver: one number for each phrase, and passage position, of the items with such a pair, at most the block's."""
    spark = found.sparkSession
    pairs = found.filter("item is not null")
    doubtful = pairs.filter("not sure").select("item").distinct()
    inside = {i: np.zeros(len(t.of_item[i]), dtype=np.int64) for i in (r["item"] for r in doubtful.collect())}
    everywhere = {}
    if inside:
        for r in pairs.join(F.broadcast(doubtful), "item", "left_semi").select("item", F.explode("held").alias("q")).groupBy("item", "q").agg(F.count("*").alias("n")).collect():
            inside[r["item"]][r["q"]] = r["n"]
        wanted = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([t.of_item[i] for i in inside]))], "phrase int")
        counts = found.filter("phrases is not null").select(F.explode(F.arrays_zip("phrases", "texts")).alias("c")).select(F.col("c.phrases").alias("phrase"), F.col("c.texts").alias("n"))
        everywhere = {r["phrase"]: r["n"] for r in counts.join(F.broadcast(wanted), "phrase").groupBy("phrase").agg(F.sum("n").alias("n")).collect()}
    rare = {i: np.array([everywhere.get(x, 0) - n <= n for x, n in zip(t.of_item[i].tolist(), held.tolist(), strict=True)], dtype=bool) for i, held in inside.items()}
    shared = spark.sparkContext.broadcast((t.items, t.lengths, rare))
    key_type = found.schema["key"].dataType
    kind = to_arrow_type(item_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, lengths, rare = shared.value
        for b in batches:
            rows, out = [], []
            for k, (i, n, sure, spans, held) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                if not sure:
                    mark = np.zeros(len(rare[i]), dtype=bool)
                    mark[held] = rare[i][held]
                    n = best_two(without_formulas(list(zip(spans[::3], spans[1::3], spans[2::3], strict=True)), mark, SHARE * lengths[i]))
                if n >= SHARE * lengths[i]:
                    rows.append(k)
                    out.append((items[i], n, int(lengths[i])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([o[0] for o in out], kind), *(pa.array([o[c] for o in out], pa.int64()) for c in (1, 2))], ["key", "item", "words", "length"])

    return pairs.select("key", "item", "words", "sure", "spans", "held").mapInArrow(run, f"key {key_type.simpleString()}, item {item_type.simpleString()}, words bigint, length bigint")


def search(spark: SparkSession, path: str, passages: DataFrame, item: str, passage: str, scratch: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, item, words, length: every text of a stored index that holds an item's passage, whole or in part.

    Null, blank and wordless passages leak nowhere; those of fewer than GRAM words where they stand whole. Repeated
    passages are each reported. Passages are searched in blocks of about ``block_chars`` characters, each block's pairs
    written once under ``scratch``."""
    ship(spark)
    index = spark.read.parquet(path)
    item_type = passages.schema[item].dataType
    wanted = passages.select(F.col(item).alias("item"), F.col(passage).alias("passage")).filter(F.col("passage").rlike(r"(?U)\w"))
    chars = wanted.agg(F.sum(F.length("passage") + 16).alias("n")).first()["n"] or 0
    blocks = -(-chars // block_chars)
    out = None
    for k in range(max(1, blocks)):
        some = wanted if blocks < 2 else wanted.filter(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == k)
        rows = sorted(some.collect(), key=lambda r: (r["item"] is None, r["item"], r["passage"]))  # one block
        t = Phrases([r["item"] for r in rows], [r["passage"] for r in rows])
        search_block(index, t, f"{scratch}/pairs-{k}")
        found = judge(spark.read.parquet(f"{scratch}/pairs-{k}"), t, item_type)
        out = found if out is None else out.unionAll(found)
    return out


def find(spark: SparkSession, texts: DataFrame, key: str, text: str, passages: DataFrame, item: str, passage: str, scratch: str) -> DataFrame:
    """The index of the texts, written under ``scratch``, and the passages searched in it. Extra columns are ignored."""
    build_index(texts, key, text, f"{scratch}/index")
    return search(spark, f"{scratch}/index", passages, item, passage, scratch)
