"""Problem 6: evaluation texts that leak into the corpus.

A distributed positional inverted index.  Corpus frequencies of the evaluation
terms come from all documents; the rarest term of an item's window of ``WINDOW`` words
is its anchor, and anchors are so placed that every such window holds one.  The
postings (term, document, position) of the anchor terms are stored with their
offset-adjusted neighbours and joined with the anchors on both, so a common term
meets an item only where its neighbourhood agrees; positions less offsets give the
alignments, and each is confirmed and extended in the document's words.  Exact matches
are runs of words; proximity matches are runs that may skip some words on either side.

The corpus is filtered where it is read by a bit table of fixed size over the hashes of
the terms, however many there are; what passes by chance falls to the joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adherix.session import broadcast_below, cut

WINDOW = 18
#: Bits of the table that tells which words may be terms; a word passes by chance with the share of bits set.
BITS = 1 << 22
#: Words a proximity match may skip at once.
SLACK = 3
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower())


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "words": pd.Series([words(t) for t in b["text"]], dtype=object)})


class _Terms(dict):
    """Word to whether it may be a term, by the bit table; bounded memory."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        at = xxhash.xxh64_intdigest(word, seed=42) % (8 * len(self.table))
        self[word] = may = bool(self.table[at >> 3] >> (at & 7) & 1)
        return may


def bit_table(terms: DataFrame) -> np.ndarray:
    """The bits of the terms' hashes: at most ``BITS`` small numbers reach the driver, whatever the number of terms."""
    slots = terms.where("term IS NOT NULL").select(F.pmod(F.xxhash64("term"), F.lit(BITS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
    table = np.zeros(BITS >> 3, np.uint8)
    np.bitwise_or.at(table, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return table


def _frequencies(table: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        may = _Terms(table.value)
        for b in batches:
            for t in b["text"]:
                total.update(filter(may.__getitem__, words(t)))
            if len(total) > 1_000_000:
                yield pd.DataFrame({"term": list(total), "n": list(total.values())})
                total.clear()
        yield pd.DataFrame({"term": list(total), "n": list(total.values())})

    return run


def _key(ws: list[str], at: int, step: int) -> int:
    """Digest of the word at ``at`` and its ``abs(step)`` neighbours on one side."""
    part = ws[at + step : at + 1] if step < 0 else ws[at : at + step + 1]
    return xxhash.xxh3_64_intdigest(f"{step}\0" + "\0".join(part)) - (1 << 63)


def _postings(table: Broadcast | None, contexts: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may = _Terms(table.value) if table is not None else None
        for b in batches:
            terms, docs, places, keys = [], [], [], []
            for doc, t in zip(b["doc_id"], b["text"]):
                ws = words(t)
                for i, w in enumerate(ws):
                    if may is None or may[w]:
                        terms.append(w)
                        docs.append(doc)
                        places.append(i)
                        keys.append([_key(ws, i, c) for c in contexts if 0 <= i + c < len(ws)])
            yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "doc_id": np.array(docs, np.int64), "pos": np.array(places, np.int32), "keys": pd.Series(keys, dtype=object)})

    return run


def postings(documents: DataFrame, table: Broadcast | None = None, contexts: list[int] = ()) -> DataFrame:
    """term, doc_id, pos, keys: the positional inverted index of the documents, of the terms of a bit table or of all.

    ``keys`` are the offset-adjusted neighbours of the posting, one digest for each
    of ``contexts`` (words to the left if negative, to the right if positive).
    """
    return documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(_postings(table, list(contexts)), "term string, doc_id long, pos int, keys array<long>")


def _anchors(window: int):
    """Per item its anchors: rarest terms so placed that every run of ``window`` words holds one.

    A run that covers an anchor holds at least half of the window's other words on
    one side of it, so the neighbours on either side make two keys of which every
    leak has one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, ws, ns in zip(b["item_id"], b["words"], b["ns"]):
                ws, ns, start = list(ws), list(ns), 0
                size = min(window, len(ws))
                context = size // 2
                while size and start + size <= len(ws):
                    at = min(range(start, start + size), key=lambda i: (ns[i], i))
                    rows += [(item, ws[at], at, c, _key(ws, at, c)) for c in {-context, context} if 0 <= at + c < len(ws)]
                    start = at + 1
            yield pd.DataFrame(rows, columns=["item_id", "term", "off", "context", "key"])

    return run


def _runs(ws: list[str], its: list[str], i: int, j: int, slack: int) -> tuple[int, int, int]:
    """From an aligned word: where the run begins and ends in the document, and how many words agree.

    After a word that differs the run goes on at the nearest place where two words
    agree (one at the end of the item), not more than ``slack`` words on either side.
    """

    def along(i: int, j: int, step: int) -> tuple[int, int]:
        n, last = 0, i
        while 0 <= i < len(ws) and 0 <= j < len(its):
            if ws[i] == its[j]:
                n, last, i, j = n + 1, i, i + step, j + step
                continue
            for away in range(1, 2 * slack + 1):
                for di in range(max(0, away - slack), min(slack, away) + 1):
                    x, y = i + step * di, j + step * (away - di)
                    if 0 <= x < len(ws) and 0 <= y < len(its) and ws[x] == its[y]:
                        x2, y2 = x + step, y + step
                        if not 0 <= y2 < len(its) or 0 <= x2 < len(ws) and ws[x2] == its[y2]:
                            i, j = x, y
                            break
                else:
                    continue
                break
            else:
                break
        return n, last

    right, end = along(i, j, 1)
    left, begin = along(i - 1, j - 1, -1)
    return (begin if left else i), end + 1, left + right


def _confirm(window: int, slack: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, cands in zip(b["doc_id"], b["text"], b["cands"]):
                ws = words(text)
                best: dict = {}
                for c in cands:
                    item, its, upto = c["item_id"], list(c["words"]), 0
                    for pos in sorted(c["places"]):
                        if pos < upto:  # inside the run just measured
                            continue
                        begin, upto, n = _runs(ws, its, pos, pos - c["delta"], slack)
                        if n >= min(window, len(its)) and n > best.get(item, (0,))[0]:
                            best[item] = (n, begin, len(its), upto - begin)
                rows += [(doc, item, n, at, n / size, span) for item, (n, at, size, span) in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_words", "at_word", "item_share", "span"])

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """doc_id, item_id, matched_words, at_word, item_share, span: documents that hold ``window`` consecutive words of an item.

    With ``slack`` the words need only stand close together and in order: up to so
    many may be put in, left out or changed between two of them, if half a window of
    them stands unbroken somewhere.  ``span`` is the length of the run in the document.
    An item of fewer words must stand in the document whole.  The longest run per
    document and item is reported.  Null or wordless texts and null ids give no
    rows, on either side; repeated rows count once; empty tables give no rows.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    its = cut(items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().mapInPandas(_item_words, "item_id long, words array<string>").where(F.size("words") > 0))
    terms = its.select(F.explode("words").alias("term")).distinct()
    send = spark.sparkContext.broadcast
    counted = docs.select("text").mapInPandas(_frequencies(send(bit_table(terms))), "term string, n long")
    counts = cut(counted.groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi"))
    flat = its.select("item_id", F.posexplode("words").alias("off", "term")).join(counts, "term", "left")
    known = flat.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "term", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"))).alias("t"))
    chosen = known.select("item_id", F.col("t.term").alias("words"), F.col("t.n").alias("ns")).mapInPandas(_anchors(max(1, window // 2) if slack else window), "item_id long, term string, off int, context int, key long")
    anchors = cut(chosen.join(counts, "term", "left_semi"))  # an anchor that the corpus lacks rules its windows out
    contexts = [r[0] for r in anchors.select("context").distinct().collect()]  # at most twice the window's half
    index = postings(docs, send(bit_table(anchors.select("term"))), contexts)
    hits = index.select("doc_id", "pos", F.explode("keys").alias("key")).join(anchors.select("key", "item_id", "off"), "key").select("doc_id", "item_id", "pos", "off").distinct()
    # anchors of one item that agree on the offset are one alignment
    aligned = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("off")).alias("delta")).agg(F.collect_list("pos").alias("places"))
    held = its.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "words"))).alias("chars")).first()
    each = 64 + int((held["chars"] or 0) / max(1, held["n"])) * 4  # bytes of an item: its words as measured, with room for their headers
    cands = aligned.join(broadcast_below(its, held["n"], each), "item_id")
    by_doc = cut(cands.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "delta", "places")).alias("cands")))
    n_docs = by_doc.count()
    docs = docs.join(broadcast_below(by_doc.select("doc_id"), n_docs, 24), "doc_id", "left_semi")
    confirmed = docs.join(by_doc, "doc_id").mapInPandas(_confirm(window, slack), "doc_id long, item_id long, matched_words int, at_word int, item_share double, span int")
    longest = F.struct("matched_words", -F.col("span"), -F.col("at_word"))
    return confirmed.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max_by("at_word", longest).alias("at_word"), F.max("item_share").alias("item_share"), F.max_by("span", longest).alias("span"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id."""
    return leaks(documents, items).select("doc_id", "item_id")


def proximity(documents: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id, item_id, matched_words, at_word, item_share, span of the documents that hold an item's words close together.

    The exact matches are among them.
    """
    return leaks(documents, items, window, slack)


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item that leaked: its split and suite, the documents concerned and the longest run."""
    hit = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("matched_words").alias("longest_run"), F.max("item_share").alias("item_share"))
    return hit.join(items.select("item_id", "split", "suite").distinct(), "item_id")
