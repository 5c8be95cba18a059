"""Problem 5: the k most similar vectors of every vector, within its domain.

Inverted file with product-quantised residuals.  Coarse centroids and codebooks
are trained per domain on a bounded sample; every vector is indexed.  Neighbouring
cells are packed into blocks of bounded size, and a vector is sent once to each block
that holds a cell it probes, not once to each cell.  Within a block the asymmetric
distances (a query against the decoded codes) pick a shortlist, whose exact cosines
are taken from the vectors; so are those of every other row that its quantisation
error lets reach the k-th of them, so a block's list is exact however alike its rows
are.  The lists of a query are merged.  Exact copies are one class, so a group of
copies of any size is searched once; cells larger than a block are cut into blocks,
and so are the queries of a block, so no task grows with a hot cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adherix.functions.records import latest
from adherix.session import broadcast_below, cut

DIM = 64
K = 10
#: About so many vectors of a domain, and no more than the second number, train its centroids and codebooks.
SAMPLE, LARGEST_SAMPLE = 16_384, 65_536
#: Vectors a cell should hold while a domain is small; in large domains cells grow as the square root of the rows.
CELL = 600
MAX_CELLS = LARGEST_SAMPLE // 4
#: Rows of the index and of the queries that meet in one task.
BLOCK, QUERIES = 8192, 65_536
#: Members of a class of exact copies that are joined with its list in one task.
COPIES = 100_000
SUBSPACES, CODES = 16, 64
#: Rows of a block whose cosines give the first bound; rows that may still reach it follow.
SHORTLIST = 48
#: What rounding may add to a bound.
ROUNDING = 1e-5


def n_cells(rows: int) -> int:
    """Cells of a domain: one for CELL vectors, in large domains as the square root of the rows."""
    return int(max(1, min(rows / CELL, 2 * np.sqrt(rows), MAX_CELLS)))


def n_probes(cells: int) -> int:
    """Cells searched for each query: a share of the cells that falls as they grow in number."""
    return int(min(cells, np.ceil(2.2 * cells**0.6) + 2))


def usable(index: DataFrame, dim: int = DIM) -> DataFrame:
    """ref_id, domain, vec: one record per ref_id whose vector has ``dim`` finite numbers, not all zero."""
    v = F.col("embedding")
    one = latest(index.select("ref_id", "domain", "embedding", "ref_ord"), ["ref_id"], ["ref_ord"], ["domain", "embedding"])
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return one.where(v.isNotNull() & fine & F.col("ref_id").isNotNull() & F.col("domain").isNotNull())


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # so that squares of extreme values stay finite
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10, spherical: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (0 if spherical else 0.5 * (c * c).sum(1)), axis=1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = count > 0
        c[full] = total[full] / count[full, None]
        if spherical:
            c[full] /= np.maximum(np.linalg.norm(c[full], axis=1, keepdims=True), 1e-9)
    return c


def _train(cells_of: dict[str, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        domain = pdf["domain"].iloc[0]
        x = np.frombuffer(b"".join(pdf.sort_values("cls")["vec"]), np.float32).reshape(len(pdf), -1)
        rng = np.random.default_rng(7)
        coarse = _kmeans(x, cells_of[domain], rng, spherical=True)
        rest = x - coarse[np.argmax(x @ coarse.T, axis=1)]
        sub = x.shape[1] // SUBSPACES
        books = [_kmeans(rest[:, i * sub : (i + 1) * sub], CODES, rng) for i in range(SUBSPACES)]
        books = np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in books])
        return pd.DataFrame({"domain": [domain], "coarse": [coarse.tobytes()], "books": [books.tobytes()]})

    return run


def _model(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[0], np.float32).reshape(-1, DIM), np.frombuffer(row[1], np.float32).reshape(SUBSPACES, CODES, -1)


def _to_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        m = _unit(np.stack(b["embedding"].to_numpy()).astype(np.float64))
        yield pd.DataFrame({"cls": b["cls"], "domain": b["domain"], "vec": [r.tobytes() for r in m]})


def _probed(score: np.ndarray) -> np.ndarray:
    """The cells each row probes."""
    p = n_probes(score.shape[1])
    return np.argpartition(-score, p - 1, axis=1)[:, :p] if p < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))


def _packed(coarse: np.ndarray, held: np.ndarray) -> list[tuple[int, int]]:
    """For each cell its first block and its number of blocks: cells that lie together share blocks of ``BLOCK`` rows."""
    order: list[int] = []
    todo = [np.arange(len(coarse))]
    while todo:  # halve along the widest direction until a handful is left
        part = todo.pop()
        if len(part) <= 2:
            order += part.tolist()
            continue
        x = coarse[part] - coarse[part].mean(axis=0)
        along = x @ x[np.argmax((x * x).sum(1))]
        by = part[np.argsort(along, kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    out = [(0, 0)] * len(coarse)
    block, room = -1, 0
    for c in order:
        n = int(held[c])
        if n == 0:
            continue
        if n > BLOCK:
            block, room = block + 1, 0
            out[c] = (block, -(-n // BLOCK))
            block += out[c][1] - 1
            continue
        if n > room:
            block, room = block + 1, BLOCK
        out[c] = (block, 1)
        room -= n
    return out


def _assign(models: Broadcast, shape: Broadcast, queries: bool):
    """Rows for the index (its block, its codes, every share of the queries) or for the queries (each block that holds a probed cell)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for domain, part in b.groupby("domain"):
                coarse, books = _model(models.value[domain])
                first, count, shares = shape.value[domain]
                x = np.frombuffer(b"".join(part["vec"]), np.float32).reshape(len(part), -1)
                score = x @ coarse.T
                cls = part["cls"].to_numpy()
                spread = cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                if queries:
                    asks = np.zeros((len(part), len(shares)), bool)
                    cells = _probed(score)
                    for k in range(int(count.max(initial=0))):
                        on = k < count[cells]
                        asks[np.nonzero(on)[0], (first[cells] + k)[on]] = True
                    rows, block = np.nonzero(asks)
                    share = (spread[rows] % shares[block].astype(np.uint64)).astype(np.int64)
                    codes = np.full(len(rows), b"", object)
                    cell = np.zeros(len(rows), np.int32)
                else:
                    own = np.argmax(score, axis=1)
                    rest = x - coarse[own]
                    sub = x.shape[1] // SUBSPACES
                    coded = np.stack([np.argmax(rest[:, i * sub : (i + 1) * sub] @ books[i].T - 0.5 * (books[i] ** 2).sum(1), axis=1) for i in range(SUBSPACES)], 1).astype(np.uint8)
                    at = first[own] + (spread % np.maximum(count[own], 1).astype(np.uint64)).astype(np.int64)
                    times = shares[at]
                    rows = np.repeat(np.arange(len(part)), times)
                    share = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                    block, cell = at[rows], own[rows].astype(np.int32)
                    codes = np.array([c.tobytes() for c in coded], object)[rows]
                yield pd.DataFrame({"domain": domain, "block": block.astype(np.int32), "share": share.astype(np.int32), "cell": cell, "cls": cls[rows], "vec": part["vec"].to_numpy()[rows], "codes": codes})

    return run


def _probe_counts(models: Broadcast):
    """How many vectors each cell holds and how many queries probe it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for domain, part in b.groupby("domain"):
                coarse, _ = _model(models.value[domain])
                score = np.frombuffer(b"".join(part["vec"]), np.float32).reshape(len(part), -1) @ coarse.T
                t = total.setdefault(domain, np.zeros((2, len(coarse)), np.int64))
                t[0] += np.bincount(np.argmax(score, axis=1), minlength=len(coarse))
                t[1] += np.bincount(_probed(score).reshape(-1), minlength=len(coarse))
        rows = [(d, i, int(t[0, i]), int(t[1, i])) for d, t in total.items() for i in range(t.shape[1])]
        yield pd.DataFrame(rows, columns=["domain", "cell", "held", "probed"])

    return run


def _search(models: Broadcast, k: int):
    def run(key, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"cls": [], "near": [], "sims": []}
        if len(index) and len(asked):
            coarse, books = _model(models.value[key[0]])
            x = np.frombuffer(b"".join(index["vec"]), np.float32).reshape(len(index), -1)
            codes = np.frombuffer(b"".join(index["codes"]), np.uint8).reshape(len(index), SUBSPACES)
            ids = index["cls"].to_numpy()
            q_all = np.frombuffer(b"".join(asked["vec"]), np.float32).reshape(len(asked), -1)
            q_ids = asked["cls"].to_numpy()
            take = min(SHORTLIST, len(ids))
            step = max(1, 2_000_000 // len(ids))
            held = coarse[index["cell"].to_numpy()] + np.concatenate([books[i][codes[:, i]] for i in range(SUBSPACES)], axis=1)
            error = np.linalg.norm(x - held, axis=1) + np.float32(ROUNDING)
            for a in range(0, len(q_all), step):
                q = q_all[a : a + step]
                own = q_ids[a : a + step, None]
                guess = q @ held.T  # the sums of the asymmetric distance tables, for all rows at once
                short = np.argpartition(-guess, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
                exact = np.einsum("qd,qsd->qs", q, x[short])
                exact[ids[short] == own] = -2
                keep = min(k, take)
                order = np.argsort(-exact, axis=1, kind="stable")[:, :keep]
                best, sims = np.take_along_axis(ids[short], order, 1), np.take_along_axis(exact, order, 1)
                if take < len(ids):
                    # q is of unit length, so no cosine exceeds its guess by more than the error of the row
                    guess += error
                    np.put_along_axis(guess, short, -3, 1)
                    may = guess >= sims[:, -1:]
                    again, rows = np.nonzero(may.any(axis=1))[0], np.nonzero(may.any(axis=0))[0]
                    if len(again):
                        rest = np.where(may[np.ix_(again, rows)], q[again] @ x[rows].T, np.float32(-2))
                        rest[ids[rows] == own[again]] = -2
                        more = min(k, len(rows))
                        top = np.argpartition(-rest, more - 1, axis=1)[:, :more]
                        both_ids = np.concatenate([best[again], ids[rows][top]], axis=1)
                        both = np.concatenate([sims[again], np.take_along_axis(rest, top, 1)], axis=1)
                        order = np.argsort(-both, axis=1, kind="stable")[:, :keep]
                        best[again], sims[again] = np.take_along_axis(both_ids, order, 1), np.take_along_axis(both, order, 1)
                for i in range(len(q)):
                    ok = sims[i] > -2
                    if ok.any():
                        out["cls"].append(q_ids[a + i])
                        out["near"].append(best[i][ok])
                        out["sims"].append(sims[i][ok])
        return pd.DataFrame({k: pd.Series(v, dtype="int64" if k == "cls" else object) for k, v in out.items()})

    return run


def most_similar(index: DataFrame, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """ref_id, domain, rank, near_id, similarity: the ``k`` most similar others of each usable vector in its domain.

    Ties are broken by the smaller near_id; similarity is the cosine, held to
    [-1, 1].  Unusable vectors, rows without an id or a domain take no part;
    repeated rows are one record.  A domain of one vector gives no rows, a domain
    of fewer than ``k`` + 1 gives what there is; an empty table gives no rows.
    """
    spark = index.sparkSession
    rows = usable(index).withColumn("cls", F.xxhash64("domain", "embedding"))
    # the first k + 1 members of a class of exact copies stand for it; the window is cut off on the map side
    members = cut(rows.select("ref_id", "domain", "cls"))
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("domain", "cls").orderBy("ref_id"))).where(F.col("_n") <= k + 1)
    copies = first.groupBy("domain", "cls").agg(F.array_sort(F.collect_list("ref_id")).alias("ids"))

    distinct = rows.groupBy("domain", "cls").agg(F.first("embedding").alias("embedding"))
    classes = cut(distinct.mapInPandas(_to_classes, "cls long, domain string, vec binary"))
    size = {r["domain"]: r["count"] for r in classes.groupBy("domain").count().collect()}  # a row per domain
    empty = spark.createDataFrame([], "ref_id long, domain string, rank int, near_id long, similarity double")
    if not size:
        return empty
    cells_of = {d: n_cells(n) for d, n in size.items()}
    share = F.create_map(*[x for d, n in size.items() for x in (F.lit(d), F.lit(min(1.0, min(LARGEST_SAMPLE, max(sample, 4 * cells_of[d])) / n)))])
    drawn = classes.where((F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("domain")])
    trained = drawn.groupBy("domain").applyInPandas(_train(cells_of), "domain string, coarse binary, books binary").collect()
    models = {r["domain"]: (bytes(r["coarse"]), bytes(r["books"])) for r in trained}
    if len(models) < len(size):  # a domain too small to be drawn by chance is trained on all its vectors
        left = classes.where(~F.col("domain").isin(list(models)))
        models |= {r["domain"]: (bytes(r["coarse"]), bytes(r["books"])) for r in left.groupBy("domain").applyInPandas(_train(cells_of), "domain string, coarse binary, books binary").collect()}

    sent = spark.sparkContext.broadcast(models)  # of bounded size a domain
    held: dict = {d: np.zeros((2, len(_model(m)[0])), np.int64) for d, m in models.items()}
    for d, c, h, p in classes.mapInPandas(_probe_counts(sent), "domain string, cell int, held long, probed long").groupBy("domain", "cell").agg(F.sum("held"), F.sum("probed")).collect():  # a row per cell
        held[d][:, c] = h, p
    shape = {}
    for d, (h, p) in held.items():
        packed = np.array(_packed(_model(models[d])[0], h), np.int64).reshape(-1, 2)
        asked = np.zeros(int((packed[:, 0] + packed[:, 1]).max()), np.int64)
        for (at, n), times in zip(packed, p):
            asked[at : at + n] += times
        shape[d] = packed[:, 0], packed[:, 1], -(-np.clip(asked, 1, size[d]) // QUERIES)
    placed = spark.sparkContext.broadcast(shape)
    schema = "domain string, block int, share int, cell int, cls long, vec binary, codes binary"
    keys = ["domain", "block", "share"]
    indexed = classes.mapInPandas(_assign(sent, placed, False), schema)
    asked = classes.mapInPandas(_assign(sent, placed, True), schema)
    lists = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(sent, k), "cls long, near array<long>, sims array<float>")
    merged = lists.groupBy("cls").agg(F.flatten(F.collect_list(F.arrays_zip(F.transform("sims", lambda s: -s.cast("double")).alias("d"), F.col("near").alias("near")))).alias("all"))
    merged = merged.select("cls", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("_p", "_x")).select("cls", (-F.col("_x.d")).alias("sim"), F.col("_x.near").alias("near"))

    # each class: its own copies at similarity 1 and the copies of its near classes, k + 1 at most
    far = merged.join(copies.select(F.col("cls").alias("near"), "ids"), "near").select("cls", F.explode("ids").alias("near_id"), (-F.col("sim")).alias("d"))
    own = copies.select("cls", F.explode("ids").alias("near_id"), F.lit(-1.0).alias("d"))
    listed = far.unionByName(own).groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near_id"))), 1, 2 * k + 2).alias("all"))
    n = sum(size.values())
    # a class of very many copies meets its list in several tasks
    hot = cut(members.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("cls", F.ceil(F.col("n") / COPIES).cast("int").alias("salts")))
    hot = broadcast_below(hot, hot.count(), 32)
    salts = F.coalesce("salts", F.lit(1))
    salted = members.join(hot, "cls", "left").withColumn("salt", F.pmod(F.xxhash64("ref_id"), salts).cast("int")).drop("salts")
    listed = listed.join(hot, "cls", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    result = salted.join(broadcast_below(listed, n, 40 * (k + 1)), ["cls", "salt"])
    others = F.slice(F.filter("all", lambda x: x["near_id"] != F.col("ref_id")), 1, k)
    result = result.select("ref_id", "domain", F.posexplode(others).alias("_p", "_x"))
    sim = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.col("_x.d")))
    return result.select("ref_id", "domain", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.near_id").alias("near_id"), sim.alias("similarity"))


def found(index: DataFrame, least: float = 0.90, k: int = K) -> DataFrame:
    """ref_id_a < ref_id_b: vectors of one domain with a cosine of ``least`` or more, each among the other's ``k`` nearest."""
    near = most_similar(index, k).where(F.col("similarity") >= least - 1e-6)
    pair = near.select(F.least("ref_id", "near_id").alias("ref_id_a"), F.greatest("ref_id", "near_id").alias("ref_id_b"))
    return pair.groupBy("ref_id_a", "ref_id_b").count().where("count = 2").select("ref_id_a", "ref_id_b")
