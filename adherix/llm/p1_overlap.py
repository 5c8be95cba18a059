"""Problem 1: the same or nearly the same records across splits.

Each text is reduced to its words (comments, layout and punctuation left out) and
cut into content-defined chunks: a rolling hash over two words ends a chunk about
every ``1/DENSITY`` words.  Chunk digests are joined between the evaluation and the
training texts, shared chunk lengths are summed into overlap fractions, and pairs
of texts above ``LEAST_OVERLAP`` are checked word by word.

Distinct texts are compared, never their occurrences, so an anchor that recurs in
a third of the records counts once.  Frequent digests are left out of the join by
prefix filtering: of each text the most frequent chunks, up to less than
``LEAST_OVERLAP`` of its length, make no candidates, which loses no pair.  What is
left of a frequent digest is joined within length bands, as texts of too different
lengths are no case, and split by salt, so boilerplate never meets in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adherix.session import broadcast_below, cut

DENSITY = 4
#: Shared share of the longer text below which the words of two texts are not compared.
LEAST_OVERLAP = 0.1
#: Texts of one digest and length band that are joined in one task.
SHARE = 2000
#: Largest share of words that may differ: between the tenth of a case and the third of a text that is none.
MOST_DIFFERENT = 0.2

_TOKEN = re.compile(
    r"""/\*.*?(?:\*/|\Z)|//[^\n]*|(?:(?<=\s)|^)\#[^\n]*|^[ \t]*(?:\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))|<!--.*?-->"""
    r"""|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\w+""",
    re.S | re.M,
)
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Identifiers, keywords and numbers of a code text in any language, without comments."""
    out: list[str] = []
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in "\"'":
            if t[:3] not in ('"""', "'''"):
                out += _WORD.findall(t)
        elif c not in "/#<" and not c.isspace():
            out.append(t)
    return out


class _Hashes(dict):
    """64-bit hash of a word; bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def chunks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests and lengths of the content-defined chunks of a sequence of word hashes; recurring chunks are numbered."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    odd = np.uint64(0x9E3779B97F4A7C15)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    roll = (h * odd) ^ (before * np.uint64(0xC2B2AE3D27D4EB4F))
    roll ^= roll >> np.uint64(29)
    ends = np.nonzero(roll % np.uint64(DENSITY) == 0)[0] + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    at = np.arange(n) - np.repeat(starts, ends - starts)
    mixed = (h ^ (h >> np.uint64(31))) * (np.uint64(2) * at.astype(np.uint64) + np.uint64(1)) * odd
    digest = np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), starts)
    # the n-th occurrence of a chunk meets the n-th of the other text
    order = np.argsort(digest, kind="stable")
    s = digest[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    run = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = run.astype(np.uint64)
    return (digest + nth * odd).view(np.int64), (ends - starts).astype(np.int32)


def _digest(ws: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(ws)) - (1 << 63)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each record the ids of its two texts, and of each text its chunks (once per batch)."""
    cache = _Hashes()
    for b in batches:
        seen: dict[int, bool] = {}
        known: dict[str, int] = {}
        rows = []
        for key, split, source, *texts in zip(b["pair_id"], b["split"], b["source"], b["anchor"], b["comparison"]):
            ids = []
            fresh = []
            for side, text in enumerate(texts):
                tid = known.get(text)
                if tid is None:
                    ws = words(text)
                    known[text] = tid = _digest(ws)
                    if (tid, split) not in seen:
                        fresh.append((tid, side, ws))
                elif (tid, split) not in seen:
                    fresh.append((tid, side, words(text)))
                ids.append(tid)
            rows.append((key, split, source, ids[0], ids[1], None, None, None, None, None))
            for tid, side, ws in fresh:
                if (tid, split) in seen:
                    continue
                seen[tid, split] = True
                d, n = chunks(np.array([cache[w] for w in ws], np.uint64))
                rows.append((key, split, None, None, None, tid, side, len(ws), d, n))
        out = pd.DataFrame(rows, columns=["pair_id", "split", "source", "tid_a", "tid_c", "tid", "side", "n_words", "digests", "lengths"])
        yield out.astype({"tid_a": "Int64", "tid_c": "Int64", "tid": "Int64", "side": "Int32", "n_words": "Int32"})


_SCHEMA = "pair_id long, split string, source string, tid_a long, tid_c long, tid long, side int, n_words int, digests array<long>, lengths array<int>"


def _compare(most_different: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list] = {}

        def counted(text: str):
            got = kept.get(text)
            if got is None:
                if len(kept) > 2000:
                    kept.clear()
                ws = words(text)
                kept[text] = got = (Counter(ws), len(ws))
            return got

        for b in batches:
            out = []
            for te, tt, x, y in zip(b["tid_e"], b["tid_t"], b["text_e"], b["text_t"]):
                (c1, n1), (c2, n2) = counted(x), counted(y)
                most = max(n1, n2)
                same = sum(min(n, c2[w]) for w, n in c1.items() if w in c2)
                out.append((te, tt, 1.0 if not most else same / most))
            got = pd.DataFrame(out, columns=["tid_e", "tid_t", "similarity"])
            yield got[got["similarity"] >= 1 - most_different]

    return run


def _near_texts(pairs: DataFrame, texts: DataFrame, least: float, most_different: float) -> DataFrame:
    """tid_e, tid_t, similarity, overlap: an evaluation text and a training text that are the same or nearly the same."""
    one = texts.groupBy("tid").agg(
        F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"),
        F.min(F.struct("pair_id", "side")).alias("at"), F.first("digests").alias("digests"), F.first("lengths").alias("lengths"), F.first("n_words").alias("n_words"),
    )
    one = cut(one)
    rows = one.select("tid", "in_train", "in_eval", "n_words", F.explode(F.arrays_zip("digests", "lengths")).alias("x")).select("tid", "in_train", "in_eval", "n_words", F.col("x.digests").alias("digest"), F.col("x.lengths").alias("length"))
    used = rows.groupBy("digest").agg(F.sum(F.col("in_train").cast("int")).alias("t"), F.sum(F.col("in_eval").cast("int")).alias("e"), F.count("*").alias("df")).where("t > 0 AND e > 0 AND df > 1").select("digest", "df")
    shared = rows.join(used, "digest")
    w = Window.partitionBy("tid").orderBy(F.desc("df"), F.desc("digest")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = shared.withColumn("_sum", F.sum("length").over(w)).where(F.col("_sum") >= least * F.col("n_words")).select("digest", "tid", "in_train", "in_eval", "n_words")
    # bands grow by the ratio of lengths that may still be near, so a text meets its own band and the next ones
    band = F.floor(F.ln(F.greatest(F.lit(1), F.col("n_words"))) / -math.log(1 - most_different)).cast("int")
    banded = cut(prefix.withColumn("band", band))
    hot = cut(banded.where("in_train").groupBy("digest", "band").count().where(F.col("count") > SHARE).select("digest", "band", F.ceil(F.col("count") / SHARE).cast("int").alias("salts")))
    hot = broadcast_below(hot, hot.count(), 32)
    salts = F.coalesce("salts", F.lit(1))
    e = banded.where("in_eval").select("digest", F.col("tid").alias("tid_e"), F.col("n_words").alias("n_e"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    e = e.join(hot, ["digest", "band"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    t = banded.where("in_train").select("digest", "band", F.col("tid").alias("tid_t"), F.col("n_words").alias("n_t"))
    t = t.join(hot, ["digest", "band"], "left").withColumn("salt", F.pmod(F.xxhash64("tid_t"), salts).cast("int")).drop("salts")
    # texts whose lengths differ by more than the words that may differ are no case
    near_length = (F.least("n_e", "n_t") >= (1 - most_different) * F.greatest("n_e", "n_t")) & (F.col("tid_e") != F.col("tid_t"))
    candidates = e.join(t, ["digest", "band", "salt"]).where(near_length).select("tid_e", "tid_t").distinct()
    held = one.select("tid", "digests", "lengths", "n_words", "at")
    joined = candidates.join(held.toDF("tid_e", "d_e", "l_e", "n_e", "at_e"), "tid_e").join(held.toDF("tid_t", "d_t", "l_t", "n_t", "at_t"), "tid_t")
    # a chunk's length goes with its digest into one number, so the intersection is hashed and brings the lengths along
    packed = lambda d, n: F.zip_with(d, n, lambda x, y: F.shiftleft(x, 20).bitwiseOR(y.cast("long")))
    common = F.aggregate(F.array_intersect(packed("d_e", "l_e"), packed("d_t", "l_t")), F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit((1 << 20) - 1)))
    over = joined.select("tid_e", "tid_t", "at_e", "at_t", (common / F.greatest("n_e", "n_t")).alias("overlap"))
    over = cut(over.where(F.col("overlap") >= least))

    places = over.select(F.col("at_e").alias("at")).union(over.select("at_t")).distinct()
    n = places.count()
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("anchor").alias("text")), F.struct(F.lit(1).alias("side"), F.col("comparison").alias("text")))
    ids = places.select(F.col("at.pair_id").alias("pair_id")).distinct()
    needed = pairs.join(broadcast_below(ids, n, 24), "pair_id", "left_semi").select("pair_id", F.explode(both).alias("x"))
    needed = needed.groupBy(F.struct("pair_id", F.col("x.side").alias("side")).alias("at")).agg(F.first("x.text").alias("text"))
    checked = over.join(needed.toDF("at_e", "text_e"), "at_e").join(needed.toDF("at_t", "text_t"), "at_t").select("tid_e", "tid_t", "text_e", "text_t").mapInPandas(_compare(most_different), "tid_e long, tid_t long, similarity double")
    near = checked.join(over.select("tid_e", "tid_t", "overlap"), ["tid_e", "tid_t"])
    same = one.where("in_train AND in_eval").select(F.col("tid").alias("tid_e"), F.col("tid").alias("tid_t"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("overlap"))
    return near.unionByName(same)


def overlaps(pairs: DataFrame, least: float = LEAST_OVERLAP, most_different: float = MOST_DIFFERENT) -> DataFrame:
    """Every evaluation record and training record that are the same or nearly the same.

    Columns: eval_id, train_id, split, source (of the evaluation record),
    crosswise, similarity (share of common words, the lower of the two texts),
    overlap (share of common chunks).  Anchor must be near anchor and comparison
    near comparison, or crosswise.  Records with a null id, split or text take no
    part; texts without words are the same as each other; repeated rows are one
    record; an empty table gives no rows.
    """
    slim = pairs.select("pair_id", "split", "source", "anchor", "comparison").where("pair_id IS NOT NULL AND split IN ('train', 'validation', 'test') AND anchor IS NOT NULL AND comparison IS NOT NULL")
    parsed = cut(slim.mapInPandas(_texts, _SCHEMA))
    records = parsed.where("tid_a IS NOT NULL").select("pair_id", "split", "source", "tid_a", "tid_c").distinct()
    texts = parsed.where("tid IS NOT NULL").select("pair_id", "split", "tid", "side", "n_words", "digests", "lengths")
    near = cut(_near_texts(slim.select("pair_id", "anchor", "comparison"), texts, least, most_different))

    e = records.where("split <> 'train'").select(F.col("pair_id").alias("eval_id"), "split", "source", "tid_a", "tid_c")
    t = records.where("split = 'train'").select(F.col("pair_id").alias("train_id"), F.col("tid_a").alias("t_a"), F.col("tid_c").alias("t_c"))
    # the comparison first: anchors recur, comparisons hardly ever do
    by_c = near.select(F.col("tid_e").alias("tid_c"), F.col("tid_t").alias("near_c"), F.col("similarity").alias("s_c"), F.col("overlap").alias("o_c"))
    by_a = near.select(F.col("tid_e").alias("tid_a"), F.col("tid_t").alias("near_a"), F.col("similarity").alias("s_a"), F.col("overlap").alias("o_a"))
    wide = e.join(by_c, "tid_c").join(by_a, "tid_a")
    straight = wide.join(t, (F.col("near_a") == F.col("t_a")) & (F.col("near_c") == F.col("t_c"))).withColumn("crosswise", F.lit(False))
    crossed = wide.join(t, (F.col("near_a") == F.col("t_c")) & (F.col("near_c") == F.col("t_a"))).withColumn("crosswise", F.lit(True))
    both = straight.unionByName(crossed).groupBy("eval_id", "train_id", "split", "source").agg(
        F.min("crosswise").alias("crosswise"), F.max(F.least("s_a", "s_c")).alias("similarity"), F.max(F.least("o_a", "o_c")).alias("overlap"))
    return both


def found(pairs: DataFrame) -> DataFrame:
    """pair_id_a < pair_id_b: one record of train and one of validation or test."""
    o = overlaps(pairs)
    return o.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b")).distinct()


def report(pairs: DataFrame) -> DataFrame:
    """Per split and source: evaluation records, those with an overlap in train, and their share."""
    every = pairs.where("pair_id IS NOT NULL AND split IN ('validation', 'test')").groupBy("pair_id").agg(F.max("split").alias("split"), F.max("source").alias("source"))
    hit = overlaps(pairs).select(F.col("eval_id").alias("pair_id")).distinct().withColumn("hit", F.lit(1))
    total = every.join(hit, "pair_id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
    return total.withColumn("share", F.col("overlapping") / F.col("records"))
