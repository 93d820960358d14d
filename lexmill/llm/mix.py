"""Mixing sources to target shares of tokens by balanced sampling (the cube method).

Every document of a source is to appear the same fractional number of times. Its whole
part is certain; the rest is an inclusion probability. The flight phase moves the
probabilities of a few documents at a time along the null space of the constraints
(number of documents, tokens) until all but two of a group are 0 or 1, so both totals
stay exact. Groups are blocks of a source of bounded size; the few undecided of each
block form the blocks of the next round. The last two of a source land on the choice
that misses the totals least.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import write_shared

# Fixed value: the pattern that splits a text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1000  # documents of a block
EPS = 1e-9


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str) -> DataFrame:
    """``keep`` columns and the number of tokens of the whole text by the rank file ``path``; 0 for a null or empty text. Narrow."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for b in batches:
            texts = [x or "" for x in b.column(b.num_columns - 1).to_pylist()]
            counts = list(map(len, encoding.encode_ordinary_batch(texts, num_threads=1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, no blanks around, _ for - and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def allocate(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens each source contributes.

    Without ``total``, the largest at which every source that has any tokens meets its
    target within its repeats. With it, a source that cannot give its share gives all
    its repeats. A source without tokens gives none, and its missing share shows.
    """
    cap = {s: available.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    if total is None:
        total = min((cap[s] / share for s, share, _ in targets if cap[s] > 0 and share and share > 0), default=0.0)
    return {s: float(min((share or 0) * total, cap[s])) for s, share, _ in targets}


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractional probabilities to 0 or 1, keeping their sum and their sum of tokens; at most two stay fractional."""
    p = p.astype(float).copy()
    free = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    window = [free.pop() for _ in range(min(3, len(free)))]
    while len(window) == 3 or (len(window) == 2 and tokens[window[0]] == tokens[window[1]]):
        t = tokens[window].astype(float)
        if len(window) == 2:
            u = np.array([1.0, -1.0])
        else:
            u = np.array([t[2] - t[1], t[0] - t[2], t[1] - t[0]])
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        q = p[window]
        move = np.abs(u) > EPS
        up = np.min(np.where(u[move] > 0, (1 - q[move]) / u[move], -q[move] / u[move]))
        down = np.min(np.where(u[move] > 0, q[move] / u[move], (q[move] - 1) / u[move]))
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q[q < EPS], q[q > 1 - EPS] = 0.0, 1.0
        p[window] = q
        window = [i for i in window if 0 < p[i] < 1]
        while len(window) < 3 and free:
            window.append(free.pop())
    return p


def land(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The last fractional probabilities (two at most after a flight) as the choice that misses the tokens least."""
    p = p.copy()
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    want = float(p[left] @ tokens[left])
    best = min(range(1 << len(left)), key=lambda c: abs(want - sum(int(tokens[i]) for k, i in enumerate(left) if c >> k & 1)))
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)
    return p


def _round(seed: int, last: bool):
    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "body"], kind="stable")
        key = f"{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}|{seed}"
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little"))
        p = flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng)
        if last:
            p = land(p, pdf["tokens"].to_numpy())
        return pdf.assign(p=p)[["doc_id", "body", "source", "tokens", "p"]]

    return run


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, *, path: str, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): doc_id, source, tokens and copies of each document used; the shares reached.

    targets(source, target_share, max_repeats) is a small list, read by the driver, as
    are the totals per source. Documents of other or null sources are not used; null and
    empty texts have no tokens and are not used. Rows alike in doc_id, source and text are
    one document, rows of one doc_id with other texts are others. No document is used more
    than max_repeats times, and a source misses its tokens by less than two documents'. The
    same rows and seed give the same choice, however the rows are laid out.
    """
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select(source_name(F.col("source")), "target_share", "max_repeats").where("source IS NOT NULL").collect()]
    named = documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    listed = named.where(F.col("source").isin([w[0] for w in wanted]) & (F.length("text") > 0)).withColumn("body", F.xxhash64("text"))
    # Texts are tokenized once; the table of sizes is narrow, and repeated rows are one before they are shuffled.
    counted = count_tokens(listed, "text", ["doc_id", "source", "body"], path).where("tokens > 0")
    sized = write_shared(counted.groupBy("doc_id", "source", "body").agg(F.max("tokens").alias("tokens")), "tokens")
    sums = {r[0]: (int(r[1]), int(r[2])) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}  # one row per listed source
    given = allocate({s: v[0] for s, v in sums.items()}, wanted, total)
    rate = {s: given[s] / sums[s][0] for s in sums}
    spark = documents.sparkSession
    rates = spark.createDataFrame([(s, float(r)) for s, r in rate.items()], "source string, rate double")
    each = sized.join(F.broadcast(rates), "source").withColumn("sure", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    open_ = each.where(f"p > {EPS}").select("doc_id", "body", "source", "tokens", "p")
    largest = max((v[1] for v in sums.values()), default=0)
    decided, level = None, 0
    while True:
        blocks = max(1, -(-largest // block))
        cut = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", "body", F.lit(seed + level)), F.lit(blocks)))
        done = cut.groupBy("source", "block").applyInPandas(_round(seed + level, blocks == 1), open_.schema)
        done = write_shared(done, "flight")
        settled = done.where(f"p <= {EPS} OR p >= 1 - {EPS}")
        decided = settled if decided is None else decided.unionByName(settled)
        if blocks == 1:
            break
        open_, largest, level = done.where(f"p > {EPS} AND p < 1 - {EPS}"), 2 * blocks, level + 1
    extra = decided.where("p > 0.5").select("doc_id", "body", "source", F.lit(1).alias("extra"))
    chosen = each.join(extra, ["doc_id", "body", "source"], "left").select("doc_id", "source", "tokens", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")).where("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    plan = spark.createDataFrame([(s, share, repeats, sums.get(s, (0, 0))[0], given[s]) for s, share, repeats in wanted], "source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens double")
    shares = plan.join(F.broadcast(used), "source", "left").na.fill({"used": 0, "documents": 0, "most_copies": 0})
    shares = shares.withColumn("all_tokens", F.sum("used").over(Window.partitionBy(F.lit(0)))).select(  # one row per listed source
        "source", "target_share", "max_repeats", "available_tokens", "planned_tokens", F.col("used").alias("mixed_tokens"), "documents", "most_copies",
        F.when(F.col("all_tokens") > 0, F.col("used") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
    )
    return chosen, shares
