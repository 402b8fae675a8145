"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into short passages. Their TF-IDF matrix A (hashed terms, passage frequencies over the whole corpus, very
frequent terms that mark no item left out) gets a distributed randomised SVD: every task multiplies its rows by one sparse
random test matrix G and back, the partial sketches ``A'AG`` are added up by row segments, and a Nystrom step on the
driver gives right singular vectors and values. Stretches of the texts, up to 1.3 times as long as an item, are folded into the
latent space, whitened, and compared by cosine with the item; those near it are checked on words: the longest common
subsequence with the item, and for paraphrases also whether the item's answer stands in the same place. Copies that hold
nearly all words of an item in order are checked whatever their cosine.

The cosine is only taken where a check could succeed. A stretch that keeps 60 % of an item's words must hold some of any 40 %
and a few of them, so the rarest are looked up in the texts, and stretches with fewer hits than that, or fewer of the item's words,
are passed over. This is exact: no pair that the checks would accept is lost by it.

Sizes on the driver and in broadcasts are fixed by ``2**TERM_BITS`` terms and the rank, or by a block of items, never by the
corpus. No document text and no pair list is shuffled or collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, slices, text_buffers, to_all, written
from .tokens import ASCII_LOWER, IS_BREAK, span_hashes, word_spans

TERM_BITS = 16
TERMS = 1 << TERM_BITS
_SEGMENTS = 64


@dataclass
class Item:
    key: object
    words: list[int]
    answer: list[int]


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words (letters and digits, A-Z lower-cased) and each row's first word."""
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_BREAK)
    return (span_hashes(data, starts, ends) & np.uint64(0xFFFFFFFF)).astype("<u4"), first


def _passages(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every passage of ``step`` words, and each row's first passage; a row without words has none."""
    count = -(-np.diff(first) // step)
    bag = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    return first[row] + (np.arange(bag[-1]) - bag[row]) * step, bag


def _added(partials: DataFrame, shape: tuple[int, ...], dtype: str = "<f8") -> np.ndarray:
    """The sum of arrays that tasks gave in segments (``segment int, part binary``), each segment added in one task."""
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, "<f4").astype(dtype)
                total[k] = total[k] + part if k in total else part
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "part": [part.astype("<f4").tobytes()]})

    out = np.zeros((_SEGMENTS, int(np.prod(shape)) // _SEGMENTS), dtype)
    # written, so that what the tasks gave goes from disk at once
    sums = written(partials.repartition(parts, "segment").mapInArrow(add, "segment int, part binary"), "sums")
    for row in sums.toLocalIterator():
        out[row["segment"]] = np.frombuffer(row["part"], "<f4")
    discard(sums)
    return out.reshape(shape)


def _segments(whole: np.ndarray):
    for k, part in enumerate(np.split(whole.astype("<f4").reshape(-1), _SEGMENTS)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "part": [part.tobytes()]})


def encoded(docs: DataFrame, id_col: str, text_col: str, step: int) -> DataFrame:
    """Written table of ``id, mark, words``; each task adds rows with its counts of passages that hold a term."""

    def encode(batches):
        counts, n = np.zeros(TERMS), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                ids, first = word_ids(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                begin, _ = _passages(first, step)
                passage = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
                keys = np.sort(passage * TERMS + (ids & (TERMS - 1)))
                fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                counts += np.bincount(keys[fresh] & (TERMS - 1), minlength=TERMS)
                n += len(begin)
                raw = [ids[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
                none = pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary()), pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(raw, pa.binary()), *none], names)
        for made in _segments(counts):
            row = [pa.nulls(1, id_arrow), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *made.columns, pa.array([n], pa.int64())]
            n = 0
            yield pa.RecordBatch.from_arrays(row, names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_arrow, names = to_arrow_type(kind), ["id", "mark", "words", "segment", "part", "n"]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(encode, f"id {kind.simpleString()}, mark long, words binary, segment int, part binary, n long"), "words")


def _test_matrix(width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random test matrix: each term's column and sign."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, width, TERMS), rng.choice([-1.0, 1.0], TERMS)


def term_weights(rows: DataFrame, items: list[Item], frequent: float) -> tuple[np.ndarray, np.ndarray, int]:
    """idf of every term, 0 for terms to leave out; passages that hold each term, and the number of all passages.

    Left out are terms of over ``frequent`` of all passages that mark no item (in none, or in over 2 % of the items):
    an item's own words count however often its text is found. An item of such terms alone keeps them.
    """
    frequency = _added(rows.where("part is not null").select("segment", "part"), (TERMS,))
    n = rows.agg(F.sum("n")).first()[0] or 0
    held = np.zeros(TERMS, int)
    for item in items:
        held[np.unique(np.array(item.words) & (TERMS - 1))] += 1
    out = (frequency > frequent * n) & ((held == 0) | (held > max(2, 0.02 * len(items))))
    for item in items:
        terms = np.array(item.words) & (TERMS - 1)
        if out[terms].mean() > 0.8:
            out[terms] = False
    idf = np.log((1 + n) / (1 + frequency)) + 1e-3
    return np.where(out, 0, idf).astype(np.float32), frequency, n


def latent_terms(rows: DataFrame, idf: np.ndarray, n: int, step: int, rank: int, spare: int = 8, seed: int = 4) -> np.ndarray:
    """Whitened latent vector of every term, ``idf * V / sigma``, from the randomised SVD of all passages; a last row of zeros."""
    spark, width = rows.sparkSession, rank + spare
    sent = spark.sparkContext.broadcast(idf)

    def sketch(batches):
        weights = sent.value
        column, sign = _test_matrix(width, seed)
        signed = sign * weights
        out = np.zeros((width, TERMS))
        for batch in batches:
            for ids, first, _ in _runs(batch.column(0), 1 << 21):
                begin, _ = _passages(first, step)
                if not len(begin):
                    continue
                passage = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
                terms = (ids & (TERMS - 1)).astype(np.uint16)
                keep = weights[terms] > 0
                terms, passage = terms[keep], passage[keep]
                y = np.bincount(passage + len(begin) * column[terms], weights=signed[terms], minlength=len(begin) * width).reshape(width, -1)
                for k in range(width):
                    out[k] += np.bincount(terms, weights=y[k][passage], minlength=TERMS)
        yield from _segments((out * weights).T)

    words = rows.where("words is not null").select("words")
    # a task's sketch has one size: few tasks with much text each, rather than one for every small file
    size = words.agg(F.sum(F.length("words"))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, size >> 28)
    z = _added(words.coalesce(tasks).mapInArrow(sketch, "segment int, part binary"), (TERMS, width))
    if not z.any():
        return np.zeros((TERMS + 1, rank), np.float32)
    column, sign = _test_matrix(width, seed)
    core = np.stack([sign[column == k] @ z[column == k] for k in range(width)])
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-9
    # the left singular vectors of a tall matrix, from its small square
    z = z @ (vectors[:, good] / np.sqrt(values[good]))
    squares, turn = np.linalg.eigh(z.T @ z)
    best = np.argsort(-squares)[:rank]
    best = best[squares[best] > squares.max() * 1e-12]
    s = np.sqrt(squares[best])
    u = z @ (turn[:, best] / s)
    out = np.zeros((TERMS + 1, rank), np.float32)
    out[:TERMS, : u.shape[1]] = idf[:, None] * u / np.maximum(s, s[0] * 1e-6) * np.sqrt(max(n, 1))
    return out


def _runs(col: pa.Array, limit: int = 1 << 19):
    """Word ids of a binary column: slices of whole rows with each row's first word, and the slice's first row."""
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    for lo, hi in slices(offsets, limit):
        yield data[offsets[lo] : offsets[hi]].view("<u4"), (offsets[lo : hi + 1] - offsets[lo]) // 4, lo


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _items(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> list[Item]:
    out = []
    for row in benchmark.select(item_col, text_col, *([answer_col] if answer_col else [])).toLocalIterator():
        ids = [_ids_of(x) for x in row[1:]]
        if ids[0]:
            # without an answer of its own, an item's answer is its last quarter
            out.append(Item(row[0], ids[0], ids[1] if answer_col and ids[1] else ids[0][-max(3, len(ids[0]) // 4) :]))
    return sorted(out, key=lambda i: (str(i.key), i.words))


def _ids_of(text: str | None) -> list[int]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return word_ids(raw, np.array([0, len(raw)]))[0].tolist()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    rank: int = 64, min_cosine: float = 0.4, same: float = 0.8, paraphrase: float = 0.6, answered: float = 0.75, frequent: float = 0.002, block: int = 1 << 20,
) -> DataFrame:
    """Contaminated pairs: ``id_col, item_col, cosine, lcs, answer, mark`` (``mark``: hash of the text).

    A stretch is at most 1.3 times as long as the item. A pair counts if a stretch of the text holds ``same`` of the item's words
    in order, or if one of ``min_cosine`` holds ``paraphrase`` of them and ``answered`` of its answer; the best stretch is
    reported. Texts and items without words match nothing; repeated rows, and items of equal text, give a pair each; rows
    without an id take part. Items are compared in blocks of about ``block`` words. Empty tables give no rows. Other columns
    are not read.
    """
    return _contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col, answer_col, rank, min_cosine, same, paraphrase, answered, frequent, block)[0]


def _contaminated(docs, benchmark, id_col, text_col, item_col="item_id", item_text_col="text", answer_col=None, rank=64, min_cosine=0.4, same=0.8, paraphrase=0.6, answered=0.75, frequent=0.002, block=1 << 20):
    """:func:`contaminated`, and the table of words that it reads."""
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text_col, answer_col)
    # half the length of the shortest items
    step = max(4, int(np.quantile([len(i.words) for i in items], 0.1)) // 2) if items else 16
    rows = encoded(docs, id_col, text_col, step)
    idf, frequency, n = term_weights(rows, items, frequent)
    vectors = latent_terms(rows, idf, n, step, rank)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, cosine double, lcs double, answer double, mark long"
    terms = spark.sparkContext.broadcast(vectors)
    words = rows.where("words is not null").select("words", "id", "mark")
    found = None
    for part in _blocks(items, block):
        index = spark.sparkContext.broadcast(Index.of(part, frequency, same, paraphrase))
        pairs = words.mapInArrow(_searcher(terms, index, min_cosine, same, paraphrase, answered, id_col, item_col, item_type), schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found, rows


def _blocks(items: list[Item], words: int) -> list[list[Item]]:
    """Blocks of about ``words`` words, and at most ``words // 64`` items; one empty block if there are no items."""
    out, size = [[]], 0
    for item in items:
        if out[-1] and (size >= words or len(out[-1]) >= max(1, words // 64)):
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item.words)
    return out


def reach_of(m: int) -> int:
    """Words of a stretch that is compared with an item of ``m`` words."""
    return -(-m * 13 // 10)


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``low, low + 1, ...`` (``n`` of them) of each pair, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(low - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """A block of items by their rarest words.

    A stretch that holds ``need`` of an item's ``m`` words in order leaves out ``m - need`` at most: of any ``m - need + seeds``
    words it holds ``seeds``. The rarest are taken, so few stretches of the corpus are looked at, and none is missed.
    """

    items: list[Item]
    need: np.ndarray
    strict: np.ndarray
    seeds: np.ndarray
    reach: np.ndarray
    flag: np.ndarray
    rare: np.ndarray
    start: np.ndarray
    owner: np.ndarray
    member: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(items: list[Item], frequency: np.ndarray, same: float, paraphrase: float, seeds: int = 4) -> Index:
        sizes = [len(i.words) for i in items]
        strict = np.array([_least(same, m) for m in sizes], np.int64)
        need = np.minimum(strict, np.array([_least(paraphrase, m) for m in sizes], np.int64))
        seeds = np.minimum(seeds, need)
        rare, owner, member, counts = [], [], [], []
        for k, item in enumerate(items):
            words, times = np.unique(np.array(item.words, np.uint32), return_counts=True)
            order = np.lexsort((words, frequency[words & (TERMS - 1)]))
            taken = order[: 1 + int(np.searchsorted(np.cumsum(times[order]), sizes[k] - need[k] + seeds[k]))]
            rare.append(words[taken])
            owner.append(np.full(len(taken), k))
            others = np.setdiff1d(np.array(item.answer, np.uint32), words)
            member += [np.uint64(k) << np.uint64(32) | x.astype(np.uint64) for x in (words, others)]
            counts += [np.ones(len(words), bool), np.zeros(len(others), bool)]
        rare, owner = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((rare, np.uint32), (owner, np.int64)))
        member, counts = np.concatenate([np.zeros(0, np.uint64), *member]), np.concatenate([np.zeros(0, bool), *counts])
        order, sort = np.argsort(rare, kind="stable"), np.argsort(member)
        rare, at = np.unique(rare[order], return_index=True)
        flag = np.zeros(TERMS, bool)
        flag[rare & (TERMS - 1)] = True
        reach = np.array([reach_of(m) for m in sizes], np.int64)
        return Index(items, need, strict, seeds, reach, flag, rare, np.append(at, len(owner)), owner[order], member[sort], counts[sort])

    def regions(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, row, and least and greatest start of the stretches that hold ``seeds`` of the item's rarest words."""
        at = np.flatnonzero(self.flag[ids & (TERMS - 1)])
        slot = np.searchsorted(self.rare, ids[at])
        known = self.rare[np.minimum(slot, len(self.rare) - 1)] == ids[at] if len(self.rare) else np.zeros(len(at), bool)
        at, slot = at[known], slot[known]
        n = self.start[slot + 1] - self.start[slot]
        k, p = self.owner[_ranges(self.start[slot], n)], np.repeat(at, n)
        order = np.argsort(k, kind="stable")
        k, p = k[order], p[order]
        row = np.searchsorted(first, p, side="right") - 1
        last = np.arange(len(k)) + self.seeds[k] - 1
        i = np.flatnonzero(last < len(k))
        last = last[i]
        i, last = (x[(k[i] == k[last]) & (row[i] == row[last]) & (p[last] - p[i] < self.reach[k[i]])] for x in (i, last))
        k, row, low, high = k[i], row[i], np.maximum(p[last] - self.reach[k[i]] + 1, first[row[i]]), p[i]
        head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1] + 1)])) if len(k) else i
        return k[head], row[head], low[head], high[np.append(head[1:], len(k)) - 1] if len(k) else high

    def stretches(self, ids: np.ndarray, first: np.ndarray):
        """Item, row, start, end and item's words of all stretches that begin with a word of the item and hold ``need`` of them."""
        k, row, low, high = self.regions(ids, first)
        stop = np.minimum(high + self.reach[k], first[row + 1])
        size = np.cumsum(stop - low)
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(size >> 20)) + 1):
            n = stop[part] - low[part]
            at, own = _ranges(low[part], n), np.repeat(part, n)
            keys = k[own].astype(np.uint64) << np.uint64(32) | ids[at].astype(np.uint64)
            slot = np.minimum(np.searchsorted(self.member, keys), len(self.member) - 1)
            inside = self.member[slot] == keys
            sums = np.concatenate([[0], np.cumsum(inside & self.counts[slot])])
            j = np.flatnonzero(inside & (at <= high[own]))
            own, begin = own[j], at[j]
            end = np.minimum(begin + self.reach[k[own]], stop[own])
            have = sums[j + end - begin] - sums[j]
            some = have >= self.need[k[own]]
            yield k[own][some], row[own][some], begin[some], end[some], have[some]


def _least(share: float, m: int) -> int:
    """The fewest of ``m`` words that are ``share`` of them."""
    return max(1, int(np.ceil(share * m - 1e-9)))


def _cosines(table: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cosine of each stretch, every term counted once, with its item's latent vector."""
    out = np.zeros(len(k))
    for lo in range(0, len(k), 2048):
        part = slice(lo, lo + 2048)
        n = end[part] - begin[part]
        window = np.repeat(np.arange(len(n)), n)
        keys = np.unique(window * TERMS + (ids[_ranges(begin[part], n)] & (TERMS - 1)))
        sums = np.add.reduceat(table[keys & (TERMS - 1)], np.searchsorted(keys, np.arange(len(n)) * TERMS), axis=0)
        out[part] = np.einsum("ij,ij->i", sums, queries[k[part]]) / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
    return out


def _searcher(terms, sent, min_cosine, same, paraphrase, answered, id_col, item_col, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_type)

    def search(batches):
        table, index = terms.value, sent.value
        items = index.items
        queries = np.zeros((len(items), table.shape[1]), np.float32)
        for k, item in enumerate(items):
            queries[k] = table[np.unique(np.array(item.words, np.uint32) & (TERMS - 1))].sum(axis=0)
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for ids, first, base in _runs(batch.column(0)) if items else ():
                for k, row, begin, end, have in index.stretches(ids, first):
                    cosine = _cosines(table, queries, ids, k, begin, end)
                    some = np.flatnonzero((cosine >= min_cosine) | (have >= index.strict[k]))
                    # the fullest stretches of a pair first: nothing beats a whole one
                    for c in some[np.lexsort((-have[some], k[some], row[some]))].tolist():
                        item, pair = items[k[c]], (int(row[c]) + base, int(k[c]))
                        known = best.get(pair, (0.0, 0.0))
                        if known[:2] == (1.0, 1.0) or have[c] < known[0] * len(item.words):
                            continue
                        lcs, answer = judged(item, ids[begin[c] : end[c]].tolist(), paraphrase)
                        if (lcs >= same or lcs >= paraphrase and answer >= answered and cosine[c] >= min_cosine) and (lcs, answer) > known[:2]:
                            best[pair] = (lcs, answer, float(cosine[c]))
            at = pa.array([r for r, _ in best], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), pa.array([items[k].key for _, k in best], item_arrow), *(pa.array([v[i] for v in best.values()], pa.float64()) for i in (2, 0, 1)), batch.column(2).take(at)],
                [id_col, item_col, "cosine", "lcs", "answer", "mark"],
            )

    return search


def judged(item: Item, words: list[int], paraphrase: float) -> tuple[float, float]:
    """Share of the item, and of its answer if the item's is ``paraphrase``, that is a common subsequence with ``words``."""
    lcs = common_subsequence(item.words, words) / len(item.words)
    return lcs, common_subsequence(item.answer, words) / len(item.answer) if lcs >= paraphrase - 1e-9 else 0.0


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are contaminated by an item of ``benchmark``.

    Rows are told apart by id and text: of rows that share an id, or have none, those of a clean text stay. Null and empty texts
    stay; repeated rows go or stay together. Empty tables, and an empty benchmark, take nothing away.
    """
    gone_id, gone_mark = free_name(docs, "gone_id", "gone_mark")
    found, words = _contaminated(docs, benchmark, id_col, text_col, **options)
    hit = to_all(written(found.select(F.col(id_col).alias(gone_id), F.col("mark").alias(gone_mark)).distinct(), "hits"))
    discard(words)
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(hit, docs[id_col].eqNullSafe(hit[gone_id]) & (mark == hit[gone_mark]), "left_anti")
