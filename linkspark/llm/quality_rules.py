"""Quality rules whose thresholds carry a guarantee.

Every document gets exact text statistics and, from them, a few rule values. A rule rejects above a cutoff of a
fixed grid. Cutoffs are chosen in three steps:

1. Order. From the loosest to tighter cutoffs, all rules' moves are put into one sequence: always next is the
   move whose newly rejected documents are most surely bad, by the labelled bad documents against the whole
   corpus; moves that are bad for less than `least_precision` are left out. Good labels play no part in it.
2. Holdout. All labelled good documents that pass the base rule say, for each stratum, how many of them are
   rejected by the first 1, 2, ... moves together.
3. Risk control. In each stratum the moves are tested one after the other: a move is taken while the exact
   binomial (Clopper-Pearson) upper bound on the share of good documents that all moves so far reject
   stays under `max_reject`, and the first failure ends the sequence. Testing in an order fixed beforehand needs no
   correction for the number of moves; the error is divided by the number of strata (Bonferroni; strata
   with too few good documents to prove anything test nothing and take no share). So with probability
   1 - error, all rules together reject at most `max_reject` of the good documents in every stratum.

Where nothing can be proven no rule rejects in that stratum. Strata are length classes of the text itself. Good
documents whose statistics are all equal are copies and count once; near copies with other statistics
count as independent.

Null and empty texts have all statistics 0 and fail the base rule. Duplicate rows are judged alike;
labels without a document, null labels and an empty label table add nothing (no cutoff is then proven). Values
equal to a cutoff pass. Empty tables give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stash
from .textvec import Block, blocks, hash_spans, rows_of, segment_sum, windows, word_spans

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_bang", "n_bars")
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
#: Rule name -> value in thousandths; larger is worse.
RULES = {
    "symbols_per_word": "1000 * n_symbols div greatest(n_words, 1)",
    "repeat_words": "1000 * n_repeat_words div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_words, 1)",
    "upper_share": "1000 * n_upper div greatest(word_chars, 1)",
    "bangs_per_word": "1000 * n_bang div greatest(n_words, 1)",
    "bars_per_word": "1000 * n_bars div greatest(n_words, 1)",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
}
#: Cutoffs tried for every rule: a value above the cutoff rejects.
GRID = (0, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900, 1000, 1200, 1500, 2000, 3000)
#: Upper ends of the length classes, in words.
STRATA = (200, 800)


def describe(block: Block) -> list[np.ndarray]:
    """STATS and EXTRA of each row of a block."""
    n, buf = block.size, block.buf
    at = buf[:n]
    starts, ends, row = word_spans(block)
    n_words = np.bincount(row, minlength=block.n)
    words = hash_spans(buf, starts, ends)
    lead = np.concatenate(([0], np.cumsum((at & 0xC0) != 0x80)))  # code points begun before each byte
    word_chars = np.bincount(row, lead[ends] - lead[starts], block.n).astype(np.int64)
    per_row = lambda flag: segment_sum(flag.astype(np.int64), block.offs)

    # Lines with a word that equal an earlier line of their text.
    first = np.zeros(n + 1, bool)
    first[block.offs] = True
    begin = first[:n].copy()
    begin[1:] |= at[:-1] == 10
    ls = np.flatnonzero(begin)
    le = np.append(ls[1:], n)
    le = np.where((le > ls) & (buf[np.maximum(le - 1, 0)] == 10), le - 1, le)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[worded], le[worded]
    lrow, lh = rows_of(ls, block), hash_spans(buf, ls, le)
    order = np.lexsort((lh, lrow))
    again = np.zeros(len(order), bool)
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
    n_dup = np.bincount(lrow[order], again, block.n).astype(np.int64)

    # Words inside three-word windows that occur twice or more in their text.
    w = windows(words, 3)
    same = row[: len(w)] == row[2:][: len(w)] if len(w) else np.zeros(0, bool)
    pos, w = np.flatnonzero(same), w[same]
    order = np.lexsort((w, row[pos]))
    wr, wh = row[pos][order], w[order]
    eq = np.zeros(len(order) + 1, bool)
    eq[1:-1] = (wh[1:] == wh[:-1]) & (wr[1:] == wr[:-1])
    twice = pos[order][eq[1:] | eq[:-1]] if len(order) else pos
    covered = np.zeros(len(row), bool)
    for i in range(3):
        covered[twice + i] = True
    n_repeat = np.bincount(row, covered, block.n).astype(np.int64)
    upper = (at >= 65) & (at <= 90)
    wide = np.zeros(n, bool)
    wide[1:] = (at[:-1] == 0xC3) & (at[1:] >= 0x80) & (at[1:] <= 0x9E)
    return [n_words, word_chars, per_row(IS_SYMBOL[at]), n_dup, n_repeat, per_row(upper | wide), per_row(at == 33), per_row(at == 124)]


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id with STATS and EXTRA."""
    names = ["doc_id", *STATS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), *(pa.array(np.asarray(x, np.int64)) for x in describe(block))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def binomial_upper(failures: int, n: int, level: float) -> float:
    """Largest p for which at most `failures` of n have probability `level` or more: the exact bound."""
    if failures >= n:
        return 1.0

    def at_most(p: float) -> float:
        if p <= 0:
            return 1.0
        i = np.arange(failures + 1)
        x = np.array([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for k in i]) + i * log(p) + (n - i) * np.log1p(-p)
        return float(np.exp(x).sum())

    lo, hi = failures / n, 1.0 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_most(mid) > level else (lo, mid)
    return hi


def stratum() -> Column:
    return sum((F.col("n_words") >= s).cast("int") for s in STRATA)


def steps(stats: DataFrame) -> DataFrame:
    """stats with, for each rule, the number of cutoffs that its value exceeds (s_<rule>), and the stratum s."""
    over = {f"s_{n}": sum((F.expr(e) > g).cast("int") for g in GRID) for n, e in RULES.items()}
    return stats.withColumns({"s": stratum(), **over})


def tails(stepped: DataFrame) -> np.ndarray:
    """[rule, i]: how many rows exceed cutoff i. What reaches the driver is one row for each rule and step."""
    over = F.expr("stack({}, {}) as (rule, step)".format(len(RULES), ", ".join(f"{i}, s_{n}" for i, n in enumerate(RULES))))
    out = np.zeros((len(RULES), len(GRID) + 1), np.int64)
    for r in stepped.select(over).groupBy("rule", "step").count().collect():
        out[r["rule"], r["step"]] += r["count"]
    return out[:, ::-1].cumsum(1)[:, ::-1][:, 1:]


def sequence(bad: np.ndarray, every: np.ndarray, bad_share: float, n_bad: int, n_every: int, least_precision: float) -> list[tuple[int, int]]:
    """Moves (rule, index of the new cutoff), from tails of labelled bad documents and of all documents."""
    share = bad_share * bad / max(n_bad, 1), every / max(n_every, 1)
    at = {r: len(GRID) for r in range(len(bad))}  # no cutoff yet
    out = []
    while True:
        best = None
        for r, i in at.items():
            held = (share[0][r, i], share[1][r, i]) if i < len(GRID) else (0.0, 0.0)
            for j in range(i - 1, -1, -1):
                found, taken = share[0][r, j] - held[0], share[1][r, j] - held[1]
                if found > 0:
                    precision = min(1.0, found / max(taken, 1e-12))
                    if precision >= least_precision and (best is None or (precision, found) > best[:2]):
                        best = (precision, found, r, j)
        if best is None:
            return out
        out.append(best[2:])
        at[best[2]] = best[3]


def positions(moves: list[tuple[int, int]]) -> Column:
    """The number of the first move that rejects a row of steps(), from 0; the number of moves if none does."""
    own = []
    for r, name in enumerate(RULES):
        c = F.lit(len(moves))
        for k, (rule, i) in reversed(list(enumerate(moves))):
            if rule == r:
                c = F.when(F.col(f"s_{name}") > i, k).otherwise(c)
        own.append(c)
    return F.least(*own)


def proven(rejected: dict[int, np.ndarray], max_reject: float, error: float) -> dict[int, int]:
    """stratum -> number of moves taken. rejected[s][k] is how many good documents move k is the first to
    reject; its last entry counts those that no move rejects."""
    able = dict(rejected)
    while able:
        level = error / len(able)
        enough = {s: c for s, c in able.items() if c.sum() and (1 - max_reject) ** int(c.sum()) <= level}
        if len(enough) == len(able):
            break
        able = enough
    out = {}
    for s, c in able.items():
        n, x, k = int(c.sum()), 0, 0
        for k, more in enumerate([*c[:-1].tolist(), None]):
            if more is None or binomial_upper(x + more, n, level) > max_reject:
                break
            x += more
        out[s] = k
    return out


def choose(stats: DataFrame, labels: DataFrame, max_reject: float, error: float, least_precision: float) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(moves, number of moves taken in each stratum), from the statistics of all documents and the labels."""
    labels = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    labels = labels.where("quality = most and doc_id is not null").select("doc_id", "quality")  # those that agree
    passed = steps(stats.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"))
    known = passed.join(labels, "doc_id")
    bad, good = known.where("quality = 0"), known.where("quality = 1").dropDuplicates([*STATS, *EXTRA])
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    n_bad, n_good = n.get(0, 0), n.get(1, 0)
    if not n_bad or not n_good:
        return [], {}
    moves = sequence(tails(bad), tails(passed), n_bad / (n_bad + n_good), n_bad, passed.count(), least_precision)
    rejected: dict[int, np.ndarray] = {}
    for r in good.select("s", positions(moves).alias("k")).groupBy("s", "k").count().collect():
        rejected.setdefault(r["s"], np.zeros(len(moves) + 1, np.int64))[r["k"]] = r["count"]
    return moves, proven(rejected, max_reject, error)


def judge(stats: DataFrame, moves: list[tuple[int, int]], taken: dict[int, int]) -> DataFrame:
    """stats with base_failed and kept."""
    bad = F.lit(False)
    names = list(RULES)
    for s, k in sorted(taken.items()):
        cutoffs = dict(moves[:k])  # a rule's later moves are its tighter ones
        for r, i in sorted(cutoffs.items()):
            bad = bad | ((stratum() == s) & (F.expr(RULES[names[r]]) > GRID[i]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def apply_rules(docs: DataFrame, labels: DataFrame, max_reject: float = 0.05, error: float = 0.05, least_precision: float = 0.8) -> DataFrame:
    """doc_id, STATS, EXTRA, base_failed, kept."""
    stats = stash(text_stats(docs), "statistics")
    return judge(stats, *choose(stats, labels, max_reject, error, least_precision))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *STATS, "base_failed", "kept")
