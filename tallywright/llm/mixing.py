"""Records of several sources mixed to target shares of tokens."""

from __future__ import annotations

import base64
import math
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.session import Workspace

#: Fractional part of the golden ratio: step of the low-discrepancy sequence.
GOLDEN = 0.6180339887498949
#: Tokens in one block, the unit the schedule hands out.
BLOCK_TOKENS = 2048
#: Buckets that the running sums of one source are split over, and slots in one chunk of the schedule.
BUCKETS = 64
CHUNK = 4096
#: Most rows of a list of targets.
MAX_TARGETS = 10_000
DEFAULT_TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed pattern: how the public byte-level vocabulary splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pieces(text: str, most: int = 500_000) -> list[str]:
    """A long text in pieces that the tokenizer reads as it reads the whole: a cut lies behind a letter and before something else, where every
    run of letters ends. Only a run of more than ``most`` letters is cut inside."""
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while cut > at + 1 and not (text[cut - 1].isalpha() and not text[cut].isalpha()):
            cut -= 1
        cut = cut if cut > at + 1 else at + most
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def token_counts(documents: DataFrame, tokenizer_file: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document by a public byte-level tokenizer; null and empty texts have 0 tokens.

    The vocabulary is read on the driver and broadcast (its size is fixed, under 1 MB), so executors need no file.
    """
    with open(tokenizer_file, "rb") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encoder = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [sum(len(encoder.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in pdf["text"]]})

    schema = T.StructType().add("doc_id", "long").add("source", "string").add("tokens", "long")
    return documents.select("doc_id", "source", "text").mapInPandas(count, schema)


def blocks(sized: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, at, doc_id, from_token, tokens): each source's documents in hash order as one stream of tokens, cut into blocks of ``block_tokens``;
    only the last block of a source is shorter. A document that crosses a border gives a row in each block: its tokens from ``from_token`` on, at
    place ``at`` of the block. Documents without tokens take no part.

    Running sums are two-level: inside a hash bucket of a source, plus the sum of the buckets before it, so a source that
    holds a third of all rows is spread over BUCKETS tasks.
    """
    rows = sized.where("source IS NOT NULL AND tokens > 0").withColumn("order", F.xxhash64("doc_id", F.lit("mix"))).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("b"))
    before = per_bucket.withColumn("offset", F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("b")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["source", "bucket"])
    x = placed.select("source", "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "tokens").withColumn("end", F.col("start") + F.col("tokens"))
    size = F.lit(block_tokens).cast("long")
    cut = x.select("source", "doc_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * size)
    return cut.select("source", "block", (first - F.col("block") * size).alias("at"), "doc_id", (first - F.col("start")).alias("from_token"), (F.least("end", (F.col("block") + 1) * size) - first).alias("tokens"))


def schedule(spark: SparkSession, targets: DataFrame, total_tokens: int, sizes: dict[str, int], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, slot, source, rank): which source fills each slot of each mix, and the slot's rank inside its source.

    Slot i of a mix has the point frac((i + 1) * golden ratio); the cumulative target shares map it to a source, so every prefix of the schedule is
    close to the shares. Shares of tokens become shares of slots by the mean tokens of a source's blocks (from ``sizes``, its tokens). Behind the
    sequence every source gets as many slots more as the sequence's discrepancy, a few times the logarithm of its length, may have kept from it; what a source
    gets beyond its target is dropped when slots are filled. ``targets`` is a short list (one row per mix and source) and is read by the driver, MAX_TARGETS rows at
    most; slots are generated and ranked in chunks on the executors.
    """
    parts = []
    rows = targets.where("mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND size_ratio > 0").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    rows = sorted((r.mix_id, r.source, float(r.size_ratio), float(r.target_share)) for r in rows)
    for mix in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == mix]
        wanted = {}
        for _, source, ratio, share in mine:
            tokens = sizes.get(source, 0)
            mean = tokens / math.ceil(tokens / block_tokens) if tokens else block_tokens
            wanted[source] = wanted.get(source, 0.0) + share * ratio * total_tokens / mean
        whole = sum(wanted.values())
        if not whole:
            continue
        slots = math.ceil(whole) + 1
        edge, pick = 0.0, F.lit(None).cast("string")
        cases = []
        for source, number in wanted.items():
            edge += number / whole
            cases.append((edge, source))
        cases[-1] = (2.0, cases[-1][1])
        for edge, source in reversed(cases):
            pick = F.when(F.col("point") < edge, F.lit(source)).otherwise(pick)
        point = F.expr(f"((id + 1) * {GOLDEN!r}D) % 1D")
        extra, sources = math.ceil(8 + 3 * math.log2(slots + 1)), list(wanted)
        tail = spark.range(extra * len(sources)).select(F.lit(mix).alias("mix_id"), (F.col("id") + slots).alias("slot"), F.element_at(F.array(*map(F.lit, sources)), (F.col("id") % len(sources) + 1).cast("int")).alias("source"))
        parts.append(tail)
        parts.append(spark.range(slots).select(F.lit(mix).alias("mix_id"), F.col("id").alias("slot"), point.alias("point")).select("mix_id", "slot", pick.alias("source")))
    if not parts:
        return spark.createDataFrame([], "mix_id string, slot long, source string, rank long")
    slots_ = parts[0]
    for part in parts[1:]:
        slots_ = slots_.unionByName(part)
    slots_ = slots_.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = slots_.groupBy("mix_id", "source", "chunk").agg(F.count("*").alias("c"))
    before = counts.withColumn("skip", F.coalesce(F.sum("c").over(Window.partitionBy("mix_id", "source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = slots_.withColumn("k", F.row_number().over(Window.partitionBy("mix_id", "source", "chunk").orderBy("slot")) - 1)
    return ranked.join(before, ["mix_id", "source", "chunk"]).select("mix_id", "slot", "source", (F.col("skip") + F.col("k")).alias("rank"))


def filled_slots(slots: DataFrame, sized: DataFrame, targets: DataFrame, total_tokens: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Slots with the block they use and how much of it: (mix_id, slot, source, block, repeat, use).

    Block = rank modulo the source's number of blocks. A source takes slots until its target tokens are reached, the last one in part; slots that would
    need more than max_repeats passes over a source stay empty. Blocks are equal, so the tokens before a slot follow from its rank.
    """
    size = F.lit(block_tokens).cast("long")
    sources = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("have")).where("have > 0")
    wanted = targets.where("target_share > 0 AND size_ratio > 0").groupBy("mix_id", "source").agg(
        F.max("max_repeats").alias("max_repeats"), F.ceil(F.round(F.sum(F.col("target_share") * F.col("size_ratio")) * float(total_tokens), 6)).alias("target")
    )
    x = slots.join(F.broadcast(wanted.join(sources, "source")), ["mix_id", "source"]).withColumn("n", F.ceil(F.col("have") / size))  # one row per target, MAX_TARGETS at most
    x = x.withColumn("repeat", F.floor(F.col("rank") / F.col("n"))).withColumn("block", F.col("rank") % F.col("n")).where("repeat < max_repeats")
    before = F.col("repeat") * F.col("have") + F.col("block") * size
    whole = F.least(size, F.col("have") - F.col("block") * size)
    return x.withColumn("use", F.least(whole, F.col("target") - before)).where("use > 0").select("mix_id", "slot", "source", "block", "repeat", "use")


def mixture(filled: DataFrame, blocked: DataFrame) -> DataFrame:
    """Records of every mix: (mix_id, slot, source, block, repeat, doc_id, from_token, tokens). Hot sources meet on (source, block)."""
    return filled.join(blocked, ["source", "block"]).withColumn("tokens", F.least(F.col("tokens"), F.col("use") - F.col("at"))).where("tokens > 0").select("mix_id", "slot", "source", "block", "repeat", "doc_id", "from_token", "tokens")


def share_report(filled: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: target and reached tokens and shares, tokens available with the repeat limit, reachable or not.

    A source without documents has no tokens; documents without a source count in the total only. Shares are of the size the
    mix shall have. Reached tokens are those of the filled slots. ``reachable`` is the plain count beside them: available >= target.
    """
    reached = filled.groupBy("mix_id", "source").agg(F.sum("use").alias("reached_tokens"))
    per_source = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    rows = targets.select("mix_id", "source", "size_ratio", "target_share", "max_repeats").join(per_source, "source", "left").join(reached, ["mix_id", "source"], "left").join(F.broadcast(total))
    size = F.col("size_ratio") * F.col("total_tokens")
    target = F.col("target_share") * size
    available = F.coalesce("tokens", F.lit(0)) * F.col("max_repeats")
    return rows.select(
        "mix_id",
        "source",
        "target_share",
        F.coalesce(F.coalesce("reached_tokens", F.lit(0)) / size, F.lit(0.0)).alias("reached_share"),
        target.alias("target_tokens"),
        F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
        available.alias("available_tokens"),
        (available >= target).alias("reachable"),
    )


def plan_mixes(documents: DataFrame, targets: DataFrame, tokenizer_file: str = DEFAULT_TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled slots, blocks, sized documents) for all mixes; token counts are a table in the shared folder."""
    spark = documents.sparkSession
    sized = Workspace(spark, "mixes").save(token_counts(documents, tokenizer_file))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    named = sized.join(targets.select("source").distinct(), "source", "left_semi")
    sizes = {r.source: r.tokens for r in named.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MAX_TARGETS).collect()}  # sources named in targets only
    slots = schedule(spark, targets, total, sizes, block_tokens)
    return filled_slots(slots, named, targets, total, block_tokens), blocks(named, block_tokens), sized
