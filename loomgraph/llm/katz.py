"""Operator 1, LM scoring: a Katz back-off bigram model with Good-Turing discounts.

The corpus is cut into blocks of some millions of tokens. A block names each distinct
word or bigram it holds once, with its training count, to the hash bucket that owns it;
the bucket adds the counts of all blocks and replies. So one row of packed numbers moves
per block and bucket, and a word that a third of all texts hold costs one entry per block.
A bigram's bucket goes by its context, except after frequent words (above ``1 / (HOT *
buckets)`` of all tokens, so at most ``HOT * buckets`` of them): what follows these is spread over all
buckets, and their totals are added up in a second small step and sent to all tasks.

Tables written below the shared folder, all partitioned by bucket or block:

* ``blocks``: token sequences as block-local word numbers, and the unigram requests
* ``unigrams``: replies per block; the model's unigrams (word hash, count) per bucket
* ``bigrams``: replies per block; the model's bigrams (context hash, its discounted
  mass and the lower-order mass of its seen words, word hash, count) per bucket

Definitions, evaluated per token from the highest order down:

* ``P(w)`` = d(c) c / N for a training word of count c; all other words share one
  unknown event with the remaining mass.
* ``P(w|h)`` = d(c) c / c(h) for a seen bigram; else a(h) P(w), where
  a(h) = (1 - sum of seen P(w|h)) / (1 - sum of P(w) over words seen after h), so that
  P(.|h) sums to one over the vocabulary and the unknown event.
* d(r) is Good-Turing with Katz's cut-off ``k`` (counts above it are not discounted).
  Where counts of counts do not give 0 < d(r) <= 1, absolute discounting takes over. A
  context left without any mass by this (all its counts above k) lends one count.

Words are 64-bit hashes; within a context 40 bits tell words apart. Bigrams are counted in
``WAVES`` waves of buckets, so that only a part of all requests is under way at a time.

Nulls: a null text is an empty one, i.e. the end token alone; a null id is kept and is
hashed as the empty text. Repeated rows are scored and counted once per row. An empty
table gives an empty result; with no training rows every token is unknown and has
probability one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Workspace, as_bytes, buckets, by_bucket, mix, pack, remainder, smallest, texts, unpack

END, BEGIN = b"", b"\n"
#: Katz's cut-off: counts above it are trusted.
CUTOFF = 5
#: Waves of buckets in which bigrams are counted.
WAVES = 3
#: A context with more than this part of a bucket's share of all tokens is spread over all buckets.
HOT = 4


def discounts(n: list[int], k: int = CUTOFF) -> list[float]:
    """d(1..k) from counts of counts ``n`` (``n[r-1]`` events occur r times, r to k+1)."""
    n = [*n, *[0] * (k + 1)][: k + 1]
    if n[0] and all(n):
        a = (k + 1) * n[k] / n[0]
        if a < 1:
            d = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d) and d[0] < 1:
                return d
    least = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [(r - least) / r for r in range(1, k + 1)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) c for each count."""
    table = np.array([0.0, *[x * (r + 1) for r, x in enumerate(d)]])
    c = counts.astype(np.float64)
    return np.where(counts < len(table), table[np.minimum(counts, len(table) - 1)], c)


class Unigrams:
    """Totals and discounts of order one; small and of fixed size."""

    def __init__(self, stats: list[int]):
        self.total, self.distinct = stats[0], stats[1]
        self.counts_of_counts = stats[2 : 3 + CUTOFF]
        self.d = discounts(self.counts_of_counts)
        kept = self.total - sum((1 - x) * (r + 1) * n for r, (x, n) in enumerate(zip(self.d, self.counts_of_counts, strict=False)))
        self.unknown = (self.total - kept) / self.total if self.total else 1.0
        if self.total and self.unknown <= 0:
            self.unknown = 1 / (self.total + 1)
            self.scale = self.total / (self.total + 1)
        else:
            self.scale = 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        seen = self.scale * discounted(counts, self.d) / max(self.total, 1)
        return np.where(counts > 0, seen, self.unknown)


def _blocks(n_buckets: int, block_tokens: int, id_type: pa.DataType):
    """Pass 0: token sequences of a block in local word numbers, and its words by bucket."""
    out_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(id_type)), ("payload", pa.binary()), ("kind", pa.int32())])

    def flush(block: int, number: dict, ids: list, held: list, tokens: list) -> pa.RecordBatch:
        words = list(number)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        owner = (h % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((h, owner))
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        h, owner = h[order], owner[order]
        lengths = np.array([len(t) for t in tokens], np.uint32)
        seq = rank[np.concatenate(tokens)]
        train = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(seq[train], minlength=len(words))
        edges = np.searchsorted(owner, np.arange(n_buckets + 1))
        rows = [(-1, 0, pack(lengths, np.array(held, np.uint8), seq, h, np.array([rank[number[END]], rank[number[BEGIN]]], np.uint32)), ids)]
        rows += [(b, 1, pack(h[i:j], smallest(counts[i:j])), None) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(id_type)), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def fresh():
            number = defaultdict()
            number.default_factory = number.__len__
            number[END], number[BEGIN]  # noqa: B018
            return number, [], [], [], 0

        number, ids, held, tokens, size = fresh()
        for batch in batches:
            for doc_id, text, out in zip(batch.column(0), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").translate(LOWER).split()
                words.append(END)
                tokens.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id.as_py())
                held.append(out)
                size += len(words)
                if size >= block_tokens:
                    yield flush(block, number, ids, held, tokens)
                    block += 1
                    number, ids, held, tokens, size = fresh()
        if tokens:
            yield flush(block, number, ids, held, tokens)

    return run


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(24)


def _five(x: np.ndarray) -> np.ndarray:
    """The low five bytes of each number, as five byte arrays in one."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def _unfive(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = b.reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _add_unigrams(table: pa.Table) -> pa.Table:
    """One bucket of words: totals over all blocks, a reply to each block, the model's rows and statistics."""
    parts = [unpack(p) for p in table.column("payload").to_pylist()]
    sizes = [len(h) for h, _ in parts]
    words, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate([c for _, c in parts]).astype(np.float64)).astype(np.int64)
    answer = np.split(totals[inverse], np.cumsum(sizes)[:-1])
    seen = totals > 0
    stats = [int(totals.sum()), int(seen.sum()), *[int((totals == r).sum()) for r in range(1, CUTOFF + 2)]]
    bucket = table.column("bucket")[0].as_py()
    rows = [(b, bucket, pack(smallest(a)), None) for b, a in zip(table.column("block").to_pylist(), answer, strict=True)]
    rows.append((-1, bucket, pack(words[seen], smallest(totals[seen])), stats))
    return _reply(rows)


_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64()))])
_REPLY_SQL = "block long, bucket int, payload binary, stats array<long>"


def _reply(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], _REPLY.field(i).type) for i in range(4)], schema=_REPLY)


def _gather(table: pa.Table) -> tuple:
    """Of one block: its token data, unigram totals by local number, bigram replies by bucket."""
    kind = table.column("kind").to_pylist()
    payload, bucket = table.column("payload").to_pylist(), table.column("bucket").to_pylist()
    row = kind.index(0)
    lengths, held, seq, h, marks = unpack(payload[row])
    ones = sorted((b, p) for k, b, p in zip(kind, bucket, payload, strict=True) if k == 2)
    totals = np.concatenate([unpack(p)[0].astype(np.int64) for _, p in ones])
    twos = [p for _, p in sorted((b, p) for k, b, p in zip(kind, bucket, payload, strict=True) if k == 3)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[starts] = marks[1]
    key = (before.astype(np.uint64) << np.uint64(32)) | seq
    return table.column("ids")[row].as_py(), lengths, held.astype(bool), seq, h, totals, key, starts, twos


def _owners(h: np.ndarray, totals: np.ndarray, context: np.ndarray, word: np.ndarray, n_tokens: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each bigram, and which local words are frequent contexts."""
    hot = totals * HOT * n_buckets > n_tokens
    spread = mix(h[context] + mix(h[word]))
    return (np.where(hot[context], spread, h[context]) % np.uint64(n_buckets)).astype(np.int32), hot


def _types(key: np.ndarray, h: np.ndarray, totals: np.ndarray, n_tokens: int, n_buckets: int):
    """The block's distinct bigrams by bucket, context and word: the number of each token's, context, word, bucket, frequent contexts."""
    # Arrays over all tokens are held in 32 bits and freed early; a block has some millions of them.
    order = np.argsort(key, kind="stable").astype(np.int32)
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(head, dtype=np.int32) - 1
    pair = ordered[head]
    del order, ordered, head
    context, word = (pair >> np.uint64(32)).astype(np.int32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int32)
    del pair
    owner, hot = _owners(h, totals, context, word, n_tokens, n_buckets)
    order = np.argsort(owner, kind="stable").astype(np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[number], context[order], word[order], owner[order], hot


def _runs(context: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where a new context or bucket begins."""
    return np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (owner[1:] != owner[:-1])])[: len(context)])


def _ask_bigrams(stats: list[int], n_buckets: int, wave: int):
    def run(table: pa.Table) -> pa.Table:
        _, lengths, held, _, h, totals, key, _, _ = _gather(table)
        number, context, word, owner, hot = _types(key, h, totals, stats[0], n_buckets)
        counts = np.bincount(number, np.repeat(~held, lengths), minlength=len(context)).astype(np.int64)
        del number, key
        edges = np.searchsorted(owner, np.arange(n_buckets + 1))
        block, rows = table.column("block")[0].as_py(), []
        for b in range(wave, n_buckets, WAVES):
            i, j = edges[b], edges[b + 1]
            if j > i:
                at = _runs(context[i:j], owner[i:j])
                own, runs = context[i:j][at], np.diff(np.concatenate([at, [j - i]]))
                rows.append((block, b, pack(h[own], smallest(runs), hot[own].astype(np.uint8), _five(_short(h[word[i:j]])), smallest(counts[i:j]), smallest(totals[word[i:j]])), None))
        return _reply(rows)

    return run


def _add_bigrams(stats: list[int]):
    """One bucket of bigrams: a reply to each block (block >= 0), the model's rows (-1), its part of frequent contexts (-2)."""

    def run(table: pa.Table) -> pa.Table:
        one = Unigrams(stats)
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        sizes, n_contexts = [len(p[4]) for p in parts], [len(p[0]) for p in parts]
        asked = np.concatenate([p[0] for p in parts])
        contexts, first, local = np.unique(asked, return_index=True, return_inverse=True)
        hot = np.concatenate([p[2] for p in parts])[first].astype(bool)
        of = np.repeat(local, np.concatenate([p[1] for p in parts]).astype(np.int64))
        word = np.concatenate([_unfive(p[3]) for p in parts])
        key = mix(contexts)[of] + mix(word)
        types, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([p[4] for p in parts]).astype(np.float64)).astype(np.int64)
        lower = np.concatenate([p[5].astype(np.int64) for p in parts])[first]
        of_type, word = of[first], word[first]
        del key, types, first
        seen = count > 0
        n = len(contexts)
        per = [np.bincount(of_type[count == r], minlength=n) for r in range(1, CUTOFF + 1)]
        above = count > CUTOFF
        per.append(np.bincount(of_type[above], count[above].astype(np.float64), minlength=n).astype(np.int64))
        mass = np.bincount(of_type[seen], one.p(lower[seen]), minlength=n)
        at, split = np.cumsum(n_contexts)[:-1], np.cumsum(sizes)[:-1]
        bucket = table.column("bucket")[0].as_py()
        rows = []
        for b, a, c in zip(table.column("block").to_pylist(), np.split(local, at), np.split(count[inverse], split), strict=True):
            rows.append((b, bucket, pack(smallest(c), mass[a], *[smallest(x[a]) for x in per]), None))
        order = np.lexsort((word[seen], of_type[seen]))
        model = pack(contexts, mass, *[smallest(x) for x in per], smallest(np.bincount(of_type[seen], minlength=n)), _five(word[seen][order]), smallest(count[seen][order]))
        rows.append((-1, bucket, model, [int((count == r).sum()) for r in range(1, CUTOFF + 2)]))
        if hot.any():
            rows.append((-2, bucket, pack(contexts[hot], mass[hot], *[x[hot] for x in per]), None))
        return _reply(rows)

    return run


def _frequent(bigrams: DataFrame) -> dict[str, np.ndarray]:
    """Totals of the frequent contexts over all buckets, by context: at most ``HOT * buckets`` rows reach the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                context, mass, *per = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(mass), *[pa.array(x.astype(np.int64)) for x in per]], names=["context", "mass", *[f"n{r}" for r in range(CUTOFF + 1)]])

    schema = "context long, mass double, " + ", ".join(f"n{r} long" for r in range(CUTOFF + 1))
    sums = bigrams.where("block = -2").select("payload").mapInArrow(read, schema).groupBy("context").agg(F.sum("mass").alias("mass"), *[F.sum(f"n{r}").alias(f"n{r}") for r in range(CUTOFF + 1)])
    rows = sums.orderBy("context").collect()
    contexts = np.array([r.context for r in rows], np.int64).view(np.uint64)
    order = np.argsort(contexts)
    return {"context": contexts[order], "mass": np.array([r.mass for r in rows])[order], "per": np.array([[r[f"n{k}"] for k in range(CUTOFF + 1)] for r in rows], np.float64).reshape(-1, CUTOFF + 1)[order]}


def _score(stats: list[int], pairs: list[int], frequent, n_buckets: int, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        one, d2 = Unigrams(stats), discounts(pairs)
        ids, lengths, held, seq, h, totals, key, starts, twos = _gather(table)
        number, context, word, owner, hot = _types(key, h, totals, stats[0], n_buckets)
        replies = [unpack(p) for p in twos]
        count = np.concatenate([r[0].astype(np.int64) for r in replies])
        own = context[_runs(context, owner)]
        mass, per = np.zeros(len(h)), np.zeros((len(h), CUTOFF + 1))
        mass[own] = np.concatenate([r[1] for r in replies])
        for r in range(CUTOFF + 1):
            per[own, r] = np.concatenate([x[2 + r] for x in replies])
        common = np.flatnonzero(hot)
        common = common[np.isin(h[common], frequent.value["context"])]
        at = np.searchsorted(frequent.value["context"], h[common])
        mass[common], per[common] = frequent.value["mass"][at], frequent.value["per"][at]
        context_total = per @ np.array([*range(1, CUTOFF + 1), 1.0])
        kept = per @ np.array([*[d * (r + 1) for r, d in enumerate(d2)], 1.0])
        score = np.log10(bigram(count, discounted(count, d2), one.p(totals)[word], context_total[context], kept[context], mass[context]))
        base = np.log10((totals + 1) / (one.total + one.distinct + 1))
        add = lambda x: np.add.reduceat(x, starts)
        columns = [ids, held, lengths.astype(np.int64), add((totals > 0)[seq].astype(np.int64)), np.full(len(lengths), one.total), add(base[seq]), add(score[number])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def bigram(count, numerator, lower, total, kept, mass) -> np.ndarray:
    """P(w|h): ``numerator`` d(c)c; ``total`` c(h); ``kept`` sum of d(c)c after h; ``mass`` sum of P(w) seen after h."""
    safe = np.maximum(total, 1.0)
    left = (total - kept) / safe
    bare = left <= 1e-12
    seen = numerator / np.where(bare, safe + 1, safe)
    alpha = np.where(bare, 1 / (safe + 1), left) / np.maximum(1 - mass, 1e-300)
    return np.where(total <= 0, lower, np.where(count > 0, seen, alpha * lower))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, block_tokens: int = 2_000_000) -> DataFrame:
    """Score every text under a model trained on the rows whose ``crc32(id) mod modulus`` is not ``held``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.
    """
    spark = docs.sparkSession
    ws, n = Workspace(spark, "katz"), buckets(spark)
    n_pairs = n * WAVES
    rows = texts(docs, doc_id, text).withColumn("__held", remainder(f"`{doc_id}`", modulus) == held)
    id_type = rows.schema[0].dataType
    arrow_id = pa.schema([("x", _arrow(id_type))]).field(0).type
    schema = f"block long, bucket int, ids array<{id_type.simpleString()}>, payload binary, kind int"
    blocks = ws.write(rows.mapInArrow(_blocks(n, block_tokens, arrow_id), schema), "blocks", "kind")
    ask = blocks.where("kind = 1").select("block", "bucket", "payload")
    unigrams = ws.write(by_bucket(ask, n).applyInArrow(_add_unigrams, _REPLY_SQL), "unigrams")
    stats = _summed(unigrams, 3 + CUTOFF)
    tokens = blocks.where("kind = 0").select("block", "bucket", "ids", "payload", "kind")
    none = F.lit(None).cast(f"array<{id_type.simpleString()}>").alias("ids")
    known = tokens.union(unigrams.where("block >= 0").select("block", "bucket", none, "payload", F.lit(2)))
    ws.drop("blocks/kind=1")
    bigrams = None
    for wave in range(WAVES):
        asked = known.groupBy("block").applyInArrow(_ask_bigrams(stats, n_pairs, wave), _REPLY_SQL)
        part = ws.write(by_bucket(asked, n, F.floor(F.col("bucket") / WAVES)).applyInArrow(_add_bigrams(stats), _REPLY_SQL), f"bigrams-{wave}")
        bigrams = part if bigrams is None else bigrams.union(part)
    pairs = _summed(bigrams, 1 + CUTOFF)
    frequent = spark.sparkContext.broadcast(_frequent(bigrams))
    known = known.union(bigrams.where("block >= 0").select("block", "bucket", none, "payload", F.lit(3)))
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    return known.groupBy("block").applyInArrow(_score(stats, pairs, frequent, n_pairs, pa.schema([(f.name, _arrow(f.dataType)) for f in out])), out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _summed(table: DataFrame, n: int) -> list[int]:
    """Column-wise sum of the buckets' statistics: ``n`` numbers, whatever the input."""
    row = table.where("block = -1").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in row]


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10, -score / n_tokens) if n_tokens else 1.0


def op1_katz_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
