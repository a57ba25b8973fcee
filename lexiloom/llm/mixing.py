"""Problem 7: mixing sources to target weights.

Each (mix, source) has a quota of tokens: its part of the mix's total, at most ``max_repeats`` times what the source has.
A quota is whole passes over the source and a rest; the rest is the start of a fixed random order of its documents. That
order is by a hash, cut into blocks of neighbouring hashes: prefix sums run over the block totals, and only the one block
in which the rest ends is summed document by document, so no task ever sorts a source.

The blocks of all passes are then dealt to output shards by a splitting tree: at each node the counts of blocks by
source are divided among both halves of the shards by a multivariate hypergeometric draw, exact in every source and
seeded by the node, so each shard finds its own counts and offsets on its way from the root without any other. A shard
takes the blocks at its offsets of a random permutation and shuffles their documents locally.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.plans.lineage import cut, spread_join, written
from lexiloom.sources.tables import tasks

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts texts into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Block numbers have at most so many bits, a block at most about so many documents, a shard at least so many blocks.
MAX_BITS, BLOCK_DOCS, SHARD_BLOCKS = 20, 64, 16
#: Shards whose paths are walked together.
SHARDS_A_ROW = 64
#: Rows of the targets that are sent to every task; more of them are joined by a shuffle with salts.
MAX_SIDE = 50_000
# Primes above all numbers of units that matter; a unit's number times one of them is below 2 ** 63.
PRIMES = (998_244_353, 1_000_000_007, 1_000_000_009, 1_073_741_789)


def _sizes(ranks: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def token_sizes(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens): the length of each text in ids of the vocabulary; 0 for null and empty texts."""
    with open(ranks, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").mapInArrow(_sizes(table), "doc_id bigint, source string, tokens bigint")


def _targets(targets: DataFrame) -> DataFrame:
    """(mix_id, source, weight, cap, target_share): one row for each mix and source with a weight over 0.

    Rows that repeat a source of a mix add up and the smallest cap holds; a null or negative weight is 0, and target
    shares are parts of the sum of a mix's weights. A null cap is none, a negative one is 0.
    """
    own = targets.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull() & (F.col("target_share") > 0))
    own = own.groupBy("mix_id", "source").agg(F.sum("target_share").alias("weight"), F.min(F.when(F.col("max_repeats") < 0, 0).otherwise(F.col("max_repeats"))).cast("bigint").alias("cap"))
    return own.withColumn("target_share", F.col("weight") / F.sum("weight").over(W.partitionBy("mix_id")))


def _permuted(unit: Column, n: Column, seed: int) -> Column:
    """Another number below ``n`` for each ``unit`` below ``n``, by a key of the mix and source: times a prime that doesn't
    divide ``n``, plus an offset. Blocks are in random order already, so this parts the copies of a block."""
    key = F.xxhash64(F.lit(seed), "mix_id", "source")
    at = F.pmod(key, F.lit(len(PRIMES)))
    prime = F.get(F.array(*map(F.lit, PRIMES)), at.cast("int"))
    other = F.get(F.array(*map(F.lit, PRIMES)), F.pmod(at + 1, F.lit(len(PRIMES))).cast("int"))
    a = F.when(n % prime == 0, other).otherwise(prime).cast("bigint")
    return F.pmod(F.pmod(unit * a, n) + F.pmod(F.shiftright(key, 8), n), n)


def _place(seed: int) -> Column:
    """63 random bits of a document in a mix: its place in the order of its source."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), 1)


class Mix:
    """The parts of a mixture; each is a DataFrame and is computed from the one before.

    ``total``: the tokens of each mix. Shares come first: by default it is the most at which the caps let every source
    that has documents (and a cap over 0) reach its share, and no more than all documents of the mix's sources have. A
    given total may put shares out of reach; such a source gives all that its cap allows. Either way the others keep
    their proportions. Documents without a token, of no source of a mix or with a null doc_id are not used.
    ``shard_tokens``: about the size of an output shard.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, total: int | None = None, shard_tokens: int = 1_000_000, seed: int = 7) -> None:
        self.spark, self.seed, self.shard_tokens = sizes.sparkSession, seed, shard_tokens
        self.targets = cut(_targets(targets))
        used = sizes.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull() & F.col("source").isNotNull())
        self.sizes = written(used)
        have = self.sizes.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
        quotas = self.targets.join(have, "source", "left").fillna(0, ["have", "docs"])
        reach = F.when((F.col("have") > 0) & (F.col("cap") > 0), F.col("cap") * F.col("have") / F.col("target_share"))
        mix_rows = W.partitionBy("mix_id")
        whole = F.lit(total) if total is not None else F.least(F.sum("have").over(mix_rows).cast("double"), F.min(reach).over(mix_rows))
        wanted = F.floor(F.col("target_share") * whole + 0.5).cast("bigint")
        capped = F.least(wanted, F.col("have") * F.col("cap"))  # least passes over a null cap
        quotas = quotas.withColumn("wanted", wanted).withColumn("quota", F.when(F.col("have") > 0, capped).otherwise(F.lit(0)))
        quotas = quotas.withColumn("passes", F.when(F.col("have") > 0, F.floor(F.col("quota") / F.col("have"))).otherwise(F.lit(0)).cast("bigint"))
        # so many blocks that each is small beside a shard
        blocks = F.greatest(F.col("docs") / BLOCK_DOCS, F.least(F.col("docs").cast("double"), F.col("have") * SHARD_BLOCKS / shard_tokens), F.lit(1.0))
        bits = F.least(F.lit(MAX_BITS), F.ceil(F.log2(blocks))).cast("int")
        #: (mix_id, source, ..., wanted, quota, passes, rest, bits); one row for each row of the targets.
        self.quotas = cut(quotas.withColumn("rest", F.col("quota") - F.col("passes") * F.col("have")).withColumn("bits", bits))

    def wanted(self) -> DataFrame:
        """(mix_id, source, tokens, documents, wanted_tokens, quota, passes, rest): what each source has and gives."""
        return self.quotas.select("mix_id", "source", F.col("have").alias("tokens"), F.col("docs").alias("documents"), F.col("wanted").alias("wanted_tokens"), "quota", "passes", "rest")

    def placed(self) -> DataFrame:
        """(mix_id, source, doc_id, tokens, place, block, passes, rest): each document in each mix that may use it."""
        q = self.quotas.where(F.col("quota") > 0).select("mix_id", "source", "passes", "rest", "bits")
        rows = spread_join(self.sizes, q, ["source"], MAX_SIDE).withColumn("place", _place(self.seed))
        return rows.withColumn("block", F.expr("shiftright(place, 63 - bits)")).drop("bits")

    def copies(self) -> DataFrame:
        """(mix_id, source, block, doc_id, tokens, place, copies): the documents in use and how often.

        The rest ends at the document whose middle it reaches, so it is met to half a document; ties of the hash go by
        doc_id. No document is used more than passes + 1 times, nor more often than the cap.
        """
        rows = self.placed()
        key = ["mix_id", "source"]
        totals = rows.groupBy(*key, "block", "rest").agg(F.sum("tokens").alias("t"))
        before = F.coalesce(F.sum("t").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        blocks = totals.withColumn("before", before).select(*key, "block", "before", (F.col("before") + F.col("t") <= F.col("rest")).alias("in"), (F.col("before") < F.col("rest")).alias("open"))
        rows = rows.join(blocks, [*key, "block"])
        whole = rows.where(F.col("in") | ~F.col("open")).withColumn("more", F.col("in").cast("bigint"))
        # at most one block of a mix and source is cut
        upto = F.coalesce(F.sum("tokens").over(W.partitionBy(*key).orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        edge = rows.where(F.col("open") & ~F.col("in")).withColumn("upto", F.col("before") + upto).withColumn("more", (2 * F.col("upto") + F.col("tokens") <= 2 * F.col("rest")).cast("bigint")).drop("upto")
        used = whole.unionByName(edge).withColumn("copies", F.col("passes") + F.col("more"))
        return used.where(F.col("copies") > 0).select(*key, "block", "doc_id", "tokens", "place", "copies")

    def selection(self) -> DataFrame:
        """(mix_id, shard, position, doc_id, source, copy, tokens): the mixtures, dealt and shuffled.

        ``copy`` counts the uses of a document in a mix from 0; positions count from 0 in each shard.
        """
        used = written(self.copies())
        key = ["mix_id", "source"]
        units = used.groupBy(*key, "block").agg(F.max("copies").alias("n"), F.sum(F.col("tokens") * F.col("copies")).alias("t"))
        # units count on from block to block; the windows are over blocks, of which a source has at most 2 ** MAX_BITS
        own, upto = W.partitionBy(*key), W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        units = units.select(*key, "block", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), F.sum("n").over(own).alias("all"))
        units = units.select(*key, "block", "all", "first", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
        units = units.select(*key, "block", "copy", _permuted(F.col("first") + F.col("copy"), F.col("all"), self.seed + 1).alias("unit"))
        shares = self._deal(used, units)
        dealt = units.join(shares, [*key, "unit"]).select(*key, "block", "copy", "shard")
        docs = used.join(dealt, [*key, "block"]).where(F.col("copy") < F.col("copies"))
        local = W.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(self.seed + 2), "mix_id", "doc_id", "copy"), "doc_id", "copy")
        return docs.select("mix_id", "shard", (F.row_number().over(local) - 1).alias("position"), "doc_id", "source", "copy", "tokens")

    def _deal(self, used: DataFrame, units: DataFrame) -> DataFrame:
        """(mix_id, source, unit, shard): the units of each shard, by its path through the splitting tree."""
        counts = units.groupBy("mix_id", "source").agg(F.count("*").alias("n"))
        tokens = used.groupBy("mix_id").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"))
        # one small row for each mix: its sources' counts are no more than its rows in the targets
        mixes = counts.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")).join(tokens, "mix_id")
        shards = F.greatest(F.lit(1), F.ceil(F.col("t") / self.shard_tokens)).cast("int")
        # in two steps: a mix may have more shards than one task should write out
        some = F.explode(F.sequence(F.lit(0), F.floor((shards - 1) / SHARDS_A_ROW).cast("int")))
        parts = mixes.withColumn("shards", shards).withColumn("part", some).repartition(tasks(used), "mix_id", "part")
        last = F.least(F.col("part") * SHARDS_A_ROW + SHARDS_A_ROW, F.col("shards")) - 1
        leaves = parts.withColumn("shard", F.explode(F.sequence(F.col("part") * SHARDS_A_ROW, last)))
        leaves = leaves.select(F.col("mix_id").cast("bigint"), "shards", "shard", F.col("counts.source").alias("sources"), F.col("counts.n").alias("n"))
        path = leaves.mapInPandas(_leaves(self.seed), "mix_id bigint, source string, shard int, first bigint, n bigint")
        rows = path.where("n > 0").select("mix_id", "source", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("unit"))
        return rows.select(F.col("mix_id").cast(units.schema["mix_id"].dataType), "source", "unit", "shard")

    def shares(self) -> DataFrame:
        """(mix_id, source, target_share, reached_share, wanted_tokens, tokens, documents, uses, short): each row of the
        targets, also those without documents; shares are of all tokens of the mix, 0 if it has none. short: the source
        or its cap doesn't give the wanted tokens."""
        got = self.copies().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("uses"))
        rows = self.quotas.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "uses"])
        all_tokens = F.sum("tokens").over(W.partitionBy("mix_id"))
        return rows.select("mix_id", "source", "target_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)).alias("reached_share"), F.col("wanted").alias("wanted_tokens"), "tokens", "documents", "uses", (F.col("quota") < F.col("wanted")).alias("short"))


def split_counts(counts: np.ndarray, shards: int, shard: int, seed: int, mix: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, counts) by source of one shard: each node gives its left half an exact share of its units."""
    total = int(counts.sum())
    lo, hi, first = 0, shards, np.zeros_like(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        # unit numbers before a shard are even parts of all, so a node's size depends on its bounds alone
        left = mid * total // shards - lo * total // shards
        draw = np.random.default_rng([seed, mix & 0xFFFFFFFF, lo, hi]).multivariate_hypergeometric(counts, left, method="marginals")
        if shard < mid:
            hi, counts = mid, draw
        else:
            lo, first, counts = mid, first + draw, counts - draw
    return first, counts


def _leaves(seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples():
                first, n = split_counts(np.asarray(row.n, np.int64), int(row.shards), int(row.shard), seed, int(row.mix_id))
                out += [(row.mix_id, s, row.shard, int(a), int(k)) for s, a, k in zip(row.sources, first, n)]
            yield pd.DataFrame(out, columns=["mix_id", "source", "shard", "first", "n"])

    return run


def mix(docs: DataFrame, targets: DataFrame, ranks: str = RANKS, **options) -> Mix:
    """The mixture of ``docs`` (doc_id, source, text) for the rows of ``targets``."""
    wanted = cut(targets.where(F.col("source").isNotNull()).select("source").distinct())
    return Mix(token_sizes(spread_join(docs.select("doc_id", "source", "text"), wanted, ["source"], MAX_SIDE, "left_semi"), ranks), targets, **options)
